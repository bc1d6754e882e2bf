"""Predicates and edits on JSON (VARIANT) values and tag arrays."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def json_contains(doc: Column, criteria: dict, path: str = "$") -> Column:
    """Whether the JSON text doc contains criteria: objects recursively, arrays as subsets, scalars by value."""
    out = F.lit(True)
    for key, want in criteria.items():
        at = f"{path}.{key}"
        if isinstance(want, dict):
            out = out & json_contains(doc, want, at)
        elif isinstance(want, list):
            have = F.from_json(F.get_json_object(doc, at), "array<string>")
            for item in want:
                out = out & F.coalesce(F.array_contains(have, str(item)), F.lit(False))
        else:
            text = {True: "true", False: "false"}.get(want, str(want)) if isinstance(want, bool) else str(want)
            out = out & (F.get_json_object(doc, at).eqNullSafe(F.lit(text)) if want is not None else F.get_json_object(doc, at).isNull())
    return out


def merged(base: Column, patch: Column) -> Column:
    """Shallow union of two maps; the patch wins."""
    kept = F.map_filter(base, lambda k, v: ~F.array_contains(F.map_keys(patch), k))
    return F.map_concat(kept, patch)


def all_tags(tags: Column, wanted: list[str]) -> Column:
    out = F.lit(True)
    for t in wanted:
        out = out & F.array_contains(tags, t)
    return out


def any_tag(tags: Column, wanted: list[str]) -> Column:
    return F.arrays_overlap(tags, F.array(*map(F.lit, wanted)))


def has_suffix(tags: Column, suffix: str) -> Column:
    return F.exists(tags, lambda t: t.like(f"%:{suffix}"))


def lifecycle(tags: Column) -> Column:
    """candidate, doubt or sealed, after the tags' suffixes."""
    return F.when(has_suffix(tags, "candidate"), "candidate").when(has_suffix(tags, "doubt"), "doubt").otherwise("sealed")


def normalized_tags(tags: Column) -> Column:
    """Trimmed, in lower case, without empty ones and repeats, in order."""
    return F.array_distinct(F.filter(F.transform(tags, lambda t: F.lower(F.trim(t))), lambda t: t != ""))


def auto_tag_match(tags: Column, auto_tags: Column, keywords: list[str]) -> Column:
    out = F.lit(False)
    for k in [k.lower() for k in keywords][:5]:
        out = out | F.array_contains(tags, k) | auto_tags.contains(k)
    return out


def first_text(doc: Column, fields: list[str]) -> Column:
    """The first of the fields of a JSON text that is a non-blank string."""
    return F.coalesce(*[F.nullif(F.trim(F.get_json_object(doc, f"$.{f}")), F.lit("")) for f in fields])
