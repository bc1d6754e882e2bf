"""Indexes that are stored beside a Parquet table and kept by file.

An index is a folder of generations. A file of the table is known by its path, length and time of change; a refresh reads
only files that no generation holds yet, and what an index has of files that are gone or have changed is passed over. A
generation counts once its list of files is written, which comes last, so one that an executor or a driver left half
made does not; where two writers indexed a file, the first generation's rows of it stand.
"""
from __future__ import annotations

import hashlib
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .lineage import folder


@contextmanager
def batches_of(spark: SparkSession, rows: int):
    """Arrow batches of so many rows for what is planned inside the block."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name, None)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


class FileIndex:
    """build() writes an index of rows (all columns of the table, and file) to a folder, by ``schema``, which has a column file."""

    schema: T.StructType

    def __init__(self, spark: SparkSession, path: str, kind: str, said: str, base: str | None = None):
        self.spark, self.path = spark, path
        self.base = f"{base or folder(spark)}/{kind}-{hashlib.sha256(f'{path} {said}'.encode()).hexdigest()[:24]}"
        self.known: list[str] = []
        self.live: DataFrame | None = None

    def build(self, rows: DataFrame, target: str) -> None:
        raise NotImplementedError

    def _at(self, name: str):
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}")
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()), at

    def generations(self) -> list[str]:
        fs, at = self._at("")
        names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
        return sorted(n for n in names if fs.exists(self._at(f"{n}/files/_SUCCESS")[1]))

    def _listing(self) -> DataFrame:
        """The table's files as they are now: file (a digest), path."""
        now = self.spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(self.path)
        return now.select(F.sha2(F.concat_ws("|", "path", F.col("length").cast("string"), F.unix_micros("modificationTime").cast("string")), 256).alias("file"), "path")

    def _held(self, generation: str) -> DataFrame:
        return self.spark.read.schema("file string, generation string").parquet(f"{self.base}/{generation}/files")

    def _first(self, generations: list[str]) -> dict[str, str]:
        """The first generation of each file that is held."""
        out: dict[str, str] = {}
        for g in generations:
            for r in self._held(g).collect():
                out.setdefault(r["file"], g)
        return out

    def refresh(self):
        """Reads what is not indexed yet. Names of files, not rows, pass through the driver."""
        known, now = self.generations(), {r["file"]: r["path"] for r in self._listing().collect()}
        held = self._first(known)
        new = {f: p for f, p in now.items() if f not in held}
        if new:
            name = f"{len(known):06}-{uuid.uuid4().hex[:8]}"
            rows = self.spark.read.parquet(*new.values())
            meta = rows.metadataColumn("_metadata")
            path = F.url_decode(F.replace(meta["file_path"], F.lit("+"), F.lit("%2B")))
            self.build(rows.withColumn("file", F.sha2(F.concat_ws("|", path, meta["file_size"].cast("string"), F.unix_micros(meta["file_modification_time"]).cast("string")), 256)), f"{self.base}/{name}/rows")
            if not {r["file"] for r in self._rows(name).select("file").distinct().collect()} <= set(new):
                raise RuntimeError(f"files of {self.path} have changed while they were read")
            self.spark.createDataFrame([(f, name) for f in new], "file string, generation string").coalesce(1).write.parquet(f"{self.base}/{name}/files")
            known = self.generations()
            held = self._first(known)
        self.known = known
        # where every file of every generation is there now, and once, nothing has to be passed over
        live = [(f, g) for f, g in held.items() if f in now]
        whole = len(live) == len(held) and len(known) < 2
        self.live = None if whole or not known else self.spark.createDataFrame(live, "file string, generation string")
        return self

    def _rows(self, generation: str) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(f"{self.base}/{generation}/rows")

    def table(self) -> DataFrame:
        """The index's rows of the files that are there now."""
        parts = None
        for g in self.known:
            one = self._rows(g).withColumn("generation", F.lit(g))
            parts = one if parts is None else parts.unionByName(one)
        if parts is None:
            return self.spark.createDataFrame([], self.schema)
        # files are few beside rows; Spark broadcasts the list where it is small, and shuffles otherwise
        return (parts if self.live is None else parts.join(self.live, ["file", "generation"], "left_semi")).drop("generation")
