"""Functions for SQL: what has no built-in form is registered under a name."""
from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..operators import ingest as I
from ..operators import relations as R
from ..operators import search as S

PYTHON_UNIT = "name:string,kind:string,start_line:int,end_line:int,signature:string,returns:string,params:array<string>,decorators:array<string>,docstring:string,complexity:int,lines:int,calls:array<string>,uses:array<string>,source:string"
CHUNK = "name:string,kind:string,start_line:int,end_line:int,source:string"
TYPESCRIPT = "units array<struct<name:string,kind:string,start_line:int,params:array<struct<name:string,type:string,optional:boolean,default:string>>,returns:string,async:boolean,generator:boolean>>, imports array<string>, re_exports array<struct<symbol:string,original:string,source:string,is_type:boolean>>"


def _each(f, kind: str):
    @F.pandas_udf(kind)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield s.map(f)

    return run


def _rows(f, kind: str):
    @F.pandas_udf(kind)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for s in batches:
            yield pd.DataFrame([f(x) for x in s])

    return run


def _snippets():
    @F.pandas_udf("array<struct<before:string,match:string,after:string>>")
    def run(text: pd.Series, query: pd.Series) -> pd.Series:
        return pd.Series([[dict(zip(("before", "match", "after"), x, strict=True)) for x in S.snippets(t, q)] for t, q in zip(text, query, strict=True)], dtype=object)

    return run


def _groups(pairs) -> list[dict]:
    """Groups of an array of pairs (a, b, score, entities, concepts)."""
    made = R.distinct_groups(R.greedy_groups((p["a"], p["b"], p["score"], p["entities"], p["concepts"]) for p in pairs))
    return [{"members": sorted(g.members), "score": float(g.score), "title": R.title_of(g)} for g in made]


def register_functions(spark: SparkSession) -> list[str]:
    """Registers python_units, python_chunks, call_contexts, typescript_units, mock_embedding, hover_types, snippets and consolidation_groups for SQL; gives their names. Names and themes of a text need no function: they are built-in expressions."""
    made = {
        "python_units": _each(I.python_units, f"array<struct<{PYTHON_UNIT}>>"),
        "python_chunks": _each(I.python_chunks, f"array<struct<{CHUNK}>>"),
        "call_contexts": _each(I.call_contexts, "array<struct<scope_type:string,scope_name:string,call_name:string,line:int,is_conditional:boolean,is_loop:boolean,is_try:boolean,arguments:int>>"),
        "typescript_units": _rows(I.typescript_units, TYPESCRIPT),
        "mock_embedding": _each(I.mock_embedding, "array<double>"),
        "hover_types": _rows(I.hover_types, "returns string, params map<string,string>"),
        "snippets": _snippets(),
        "consolidation_groups": _each(_groups, "array<struct<members:array<bigint>,score:double,title:string>>"),
    }
    for name, f in made.items():
        spark.udf.register(name, f)
    return sorted(made)
