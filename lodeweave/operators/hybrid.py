"""Search entry points over a caller's own tables: code, memories and events."""
from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import decay as DE
from ..functions import documents as D
from ..functions import vector as V
from . import search as S
from . import trigram

EQUAL = ("language", "chunk_type", "repository", "project", "memory_type", "author")


def filtered(df: DataFrame, filters: dict | None) -> DataFrame:
    """Equality on the columns of EQUAL; file_path as a substring; return_type without regard to case; param_type over the values of a map; tags (all) and any_tags."""
    for key, want in (filters or {}).items():
        if want is None:
            continue
        if key in EQUAL:
            df = df.where(F.col(key) == want)
        elif key == "file_path":
            df = df.where(F.col("file_path").like(f"%{want}%"))
        elif key == "return_type":
            df = df.where(F.col("return_type").ilike(f"%{want}%"))
        elif key == "param_type":
            df = df.where(_any_value(f"%{want}%"))
        elif key == "tags":
            df = df.where(D.all_tags(F.col("tags"), want))
        elif key == "any_tags":
            df = df.where(D.any_tag(F.col("tags"), want))
        else:
            raise ValueError(f"unknown filter {key!r}")
    return df


def _any_value(pattern: str):
    return F.exists(F.map_values("param_types"), lambda v: v.ilike(pattern))


def nearest(df: DataFrame, column: str, vector: list[float], k: int, key: str = "id", metric: str = "cosine", threshold: float | None = None) -> DataFrame:
    """(key, distance, rank) of the k nearest rows with a vector; those within threshold if one is given."""
    q = F.array(*[F.lit(float(x)) for x in vector])
    distance = V.cosine_distance if metric == "cosine" else V.l2_distance
    x = df.where(F.col(column).isNotNull()).select(key, distance(F.col(column), q).alias("distance"))
    if threshold is not None:
        x = x.where(F.col("distance") <= threshold)
    return S.ranked(x, [F.col("distance").asc_nulls_last(), F.col(key)], k)


def _fused(lists: list[tuple[str, DataFrame, float]], k: int, weighted: bool = True) -> DataFrame:
    if len(lists) == 1:  # one list alone keeps plain reciprocal ranks
        return S.fuse_single(lists[0][1], "id", lists[0][0], k)
    return S.fuse([(n, rows, w if weighted else None) for n, rows, w in lists], "id", k)


def _held(top: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """top, a few dozen rows, as found, and those of rows that it names: a filter by ids, which reaches the scan below whatever joins rows are made of."""
    found = top.collect()
    return top.sparkSession.createDataFrame(found, top.schema), rows.where(F.col("id").isin([r["id"] for r in found]))


def _reranked(top: DataFrame, bodies: DataFrame, query: str, pool: int) -> DataFrame:
    """The first ``pool`` places in the order of BM25, the others behind them as they were; place is the new rank."""
    x = top.join(bodies, "id")
    head = S.bm25(x.where(F.col("rank") <= pool), "id", F.left("__body", F.lit(1000)), S.query_tokens(query))
    both = head.unionByName(x.where(F.col("rank") > pool).withColumn("rerank_score", F.lit(None).cast("double"))).drop("__body")
    order = Window.orderBy(F.col("rank") > pool, F.col("rerank_score").desc_nulls_last(), "rank")
    return both.withColumn("place", F.row_number().over(order).cast("long"))


def search_code(chunks: DataFrame, query: str, vector: list[float] | None = None, column: str = "embedding", filters: dict | None = None, top_k: int = 10, weights: tuple[float, float] | None = None, k: int | None = None, pool: int = 100, rerank: int = 30, threshold: float = 0.3, lexical: bool = True, index: trigram.TrigramIndex | None = None) -> DataFrame:
    """Hybrid search of chunks (id, name, source_code, name_path, embedding): fused, reranked, first top_k with rank, rrf_score, rerank_score and sources.

    Without weights or k they follow from how much the query looks like code; without a vector the search is lexical.
    index: a trigram index of the fields name, source_code and name_path, from which lexical hits come without a scan of texts."""
    if not query.strip():
        raise ValueError("empty query")
    if vector is None and not lexical:
        raise ValueError("neither lexical nor vector search is asked for")
    w, k = weights or S.auto_weights(query), S.adaptive_k(query) if k is None else k
    rows, lists = filtered(chunks, filters), []
    if lexical:
        fields = ["name", "source_code", *(["name_path"] if "." in query else [])]
        if index is None:
            found = S.lexical(rows, [F.coalesce(c, F.lit("")) for c in fields], F.lit(query), threshold).select("id", "score")
        else:
            found = trigram.lexical(index, fields, query, threshold, S.TRIGRAM_LIMIT)
            found = found.join(rows.select("id"), "id", "left_semi") if filters else found
        lists.append(("lexical", S.ranked(found, [F.col("score").desc(), F.col("id")], pool), w[0]))
    if vector is not None:
        lists.append(("vector", nearest(rows, column, vector, pool), w[1]))
    top, rows = _held(S.ranked(_fused(lists, k), S.fused_order("id"), max(top_k, rerank)), rows)
    out = _reranked(top, rows.select("id", F.col("source_code").alias("__body")), query, rerank)
    return out.where(F.col("place") <= top_k).select("id", F.col("place").alias("rank"), "rrf_score", "rerank_score", "sources").join(rows, "id").orderBy("rank")


def search_memories(memories: DataFrame, query: str, now: datetime, vector: list[float] | None = None, entities: list[str] | None = None, tags: list[str] | None = None, filters: dict | None = None, limit: int = 10, offset: int = 0, k: int = 60, pool: int = 50, rerank: int = 30, weighted: bool = False, weights: tuple[float, float, float, float] = (0.5, 0.5, 0.3, 0.2), by_tags: bool = False, least_similarity: float = 0.1, index: trigram.TrigramIndex | None = None) -> DataFrame:
    """Hybrid search of live memories (id, title, embedding_source, embedding, entities, tags, auto_tags, created_at): up to four lists fused, reranked, decayed by age; the decayed score decides.

    by_tags takes the decay rate from tags and the outcome into account; otherwise one rate serves all. index: a trigram index of title and embedding_source."""
    rows = filtered(memories.where("deleted_at IS NULL"), filters)
    newest = [F.col("created_at").desc_nulls_last(), F.col("id")]
    if index is None:
        found = S.memory_lexical(rows, F.col("title"), F.col("embedding_source"), query).select("id", "score")
    else:
        found = trigram.memory_lexical(rows, F.col("title"), F.col("embedding_source"), query, lambda q, least: [index.alike(f, q, least) for f in ("title", "embedding_source")])
        found = found.join(rows.select("id"), "id", "left_semi")
    lists = [("lexical", S.ranked(found, [F.col("score").desc(), F.col("id")], pool), weights[0])]
    if vector is not None:
        near = nearest(rows, "embedding", vector, pool).where(1 - F.col("distance") >= least_similarity)
        lists.append(("vector", near.withColumn("rank", F.row_number().over(Window.orderBy("rank")).cast("long")), weights[1]))
    if entities:
        has = F.exists("entities", lambda e: e["name"].isin(*entities[:5]))
        lists.append(("entity", S.ranked(rows.where(has).select("id", "created_at"), newest, pool), weights[2]))
    if tags:
        lists.append(("tag", S.ranked(rows.where(D.auto_tag_match(F.col("tags"), F.coalesce("auto_tags", F.lit("")), tags)).select("id", "created_at"), newest, pool), weights[3]))
    top, rows = _held(S.ranked(_fused(lists, k, weighted), S.fused_order("id"), max(limit + offset, rerank)), rows)
    out = _reranked(top, rows.select("id", F.concat_ws(" ", "title", "embedding_source").alias("__body")), query, rerank).join(rows, "id")
    age = DE.age_days(F.lit(now).cast("timestamp"), F.col("created_at"))
    factor = DE.decay(age, DE.rate_of_tags(F.col("tags"))) * DE.outcome_factor(F.col("outcome_positive"), F.col("outcome_negative")) if by_tags else DE.decay(age)
    out = out.withColumn("score", F.col("rrf_score") * F.coalesce(factor, F.lit(1.0)))
    final = Window.orderBy(F.col("score").desc(), "place")
    return out.drop("rank").withColumn("rank", F.row_number().over(final).cast("long")).where((F.col("rank") > offset) & (F.col("rank") <= offset + limit)).orderBy("rank")


def search_events(events: DataFrame, vector: list[float] | None = None, metadata: dict | None = None, start: datetime | None = None, end: datetime | None = None, threshold: float | None = None, limit: int = 10, offset: int = 0) -> DataFrame:
    """Events (id, timestamp, metadata, embedding) by L2 distance, or the newest first without a vector.

    Where a threshold leaves nothing and there is no other filter, the nearest ones come without it."""
    x = events
    if metadata:
        x = x.where(D.json_contains(F.col("metadata"), metadata))
    if start is not None:
        x = x.where(F.col("timestamp") >= F.lit(start))
    if end is not None:
        x = x.where(F.col("timestamp") <= F.lit(end))
    if vector is None:
        return x.orderBy(F.col("timestamp").desc_nulls_first(), "id").offset(offset).limit(limit)
    q = F.array(*[F.lit(float(v)) for v in vector])
    x = x.withColumn("distance", V.l2_distance(F.col("embedding"), q))
    if threshold is not None:
        if threshold < 0:
            raise ValueError("negative threshold")
        near = F.col("distance") <= threshold
        if metadata or start is not None or end is not None:
            x = x.where(near)
        else:
            some = F.broadcast(x.agg(F.count_if(near).alias("__n")))
            x = x.crossJoin(some).where(near | (F.col("__n") == 0)).drop("__n")
    return x.orderBy(F.col("distance").asc_nulls_last(), "id").offset(offset).limit(limit)


def list_memories(memories: DataFrame, filters: dict | None = None, lifecycle: str | None = None, consumed: bool | None = None, limit: int = 10, offset: int = 0) -> DataFrame:
    """Live memories, newest first, by tags, lifecycle state and consumption, with the number of all matches (total)."""
    x = filtered(memories.where("deleted_at IS NULL"), filters)
    if lifecycle is not None:
        x = x.where(D.has_suffix(F.col("tags"), "summary") if lifecycle == "summary" else D.lifecycle(F.col("tags")) == lifecycle)
    if consumed is not None:
        x = x.where(F.col("consumed_at").isNotNull() if consumed else F.col("consumed_at").isNull())
    page = x.orderBy(F.col("created_at").desc_nulls_last(), "id").offset(offset).limit(limit)
    return page.crossJoin(F.broadcast(x.agg(F.count("*").alias("total"))))


def page_of(results: DataFrame, limit: int, offset: int = 0) -> tuple[DataFrame, bool, int | None]:
    """(rows, has_next, next_offset) of results with rank."""
    rows = results.where((F.col("rank") > offset) & (F.col("rank") <= offset + limit))
    more = not results.where(F.col("rank") > offset + limit).isEmpty()
    return rows, more, offset + limit if more else None
