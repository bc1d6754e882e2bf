"""Search queries over documents, embeddings and memories.

Embedding vec_id stands for the document with that doc_id; the query vector is
the embedding with the smallest vec_id. A document's name is its first five
words, its source the whole text; the query text is made of words common in one
of the languages."""
from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..catalog import register
from ..functions import decay as DE
from ..functions import documents as D
from ..functions import text as X
from ..functions import vector as V
from ..operators import cells, hybrid, trigram
from ..operators import search as S
from ..sources.tables import MEMORIES_SQL, load, memories, memory_texts, names

QUERY = "The that of and in the tion"


def r(c, n=8):
    return F.round(c, n)


def query_vector(spark, sf) -> DataFrame:
    e = load(spark, sf, "embeddings")
    return e.orderBy("vec_id").limit(1).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))


TRGM = lambda s: f"list_distinct(flatten(list_transform(regexp_extract_all(lower({s}), '[\\p{{L}}\\p{{N}}]+'), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"
SIM = lambda a, b: f"coalesce(len(list_intersect({a}, {b})) * 1.0 / nullif(len({a}) + len({b}) - len(list_intersect({a}, {b})), 0), 0.0)"
QV = "qv AS (SELECT vec_id AS query_id, embedding AS query FROM embeddings ORDER BY vec_id LIMIT 1)"
COS = "list_cosine_similarity(CAST(embedding AS DOUBLE[]), CAST(query AS DOUBLE[]))"
L2 = "list_distance(CAST(embedding AS DOUBLE[]), CAST(query AS DOUBLE[]))"
NAME = "array_to_string(string_split(text, ' ')[1:5], ' ')"
Q_GRAMS = TRGM(f"'{QUERY}'")
LEX = f"""lex AS (SELECT doc_id AS id, score, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM (
  SELECT doc_id, {SIM('n', 'q')} AS by_name, {SIM('g', 'q')} AS by_source, greatest({SIM('n', 'q')}, {SIM('g', 'q')}) AS score FROM (SELECT doc_id, {TRGM(NAME)} AS n, {TRGM('text')} AS g, {Q_GRAMS} AS q FROM documents))
  WHERE (by_name >= 0.3 OR by_source >= 0.3) AND score > 0.1 QUALIFY rank <= 100)"""
VEC = f"vec AS (SELECT vec_id AS id, 1 - {COS} AS distance, row_number() OVER (ORDER BY round(1 - {COS}, 12), vec_id) AS rank FROM embeddings, qv QUALIFY rank <= 100)"


@register("q1_trgm", f"SELECT doc_id, round({SIM('g', 'q')}, 8) AS sim FROM (SELECT doc_id, {TRGM('text')} AS g, {Q_GRAMS} AS q FROM documents)")
def q1(spark, sf):
    return documents_index(spark, sf).similarities("text", QUERY).select(F.col("id").alias("doc_id"), r("sim").alias("sim"))


def documents_index(spark, sf) -> trigram.TrigramIndex:
    """The stored index of the documents' names, titles and texts; files that it does not hold yet are read now."""
    name = F.array_join(F.slice(F.split("text", " "), 1, 5), " ")
    return trigram.TrigramIndex(spark, f"{sf}/documents.parquet", "doc_id", {"name": name, "title": F.left("text", F.lit(60)), "text": F.col("text")}).refresh()


def lexical_list(spark, sf, k=100) -> DataFrame:
    """Names or sources like the query: one of them reaches the operator's limit, and the larger the search's threshold."""
    found = trigram.lexical(documents_index(spark, sf), ["name", "text"], QUERY, 0.1, S.TRIGRAM_LIMIT)
    return S.ranked(found, [F.col("score").desc(), F.col("id")], k)


def vector_list(spark, sf, k=100) -> DataFrame:
    e = load(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding")
    x = e.crossJoin(F.broadcast(query_vector(spark, sf))).select("id", V.cosine_distance(F.col("embedding"), F.col("query")).alias("distance"))
    return S.ranked(x, [F.round("distance", 12), F.col("id")], k)


@register("q2_lexical", f"WITH {LEX} SELECT id, round(score, 8) AS score, rank FROM lex")
def q2(spark, sf):
    return lexical_list(spark, sf).select("id", r("score").alias("score"), "rank")


#: Least similarity of a whole text to a short query, a parameter of the search.
LEAST = 0.15


@register("q3_similarity_threshold", f"SELECT doc_id, round({SIM('g', 'q')}, 8) AS sim FROM (SELECT doc_id, {TRGM('text')} AS g, {Q_GRAMS} AS q FROM documents) WHERE {SIM('g', 'q')} >= {LEAST}")
def q3(spark, sf):
    return documents_index(spark, sf).alike("text", QUERY, LEAST).select(F.col("id").alias("doc_id"), r("sim").alias("sim"))


@register("q4_memory_lexical", f"""WITH {MEMORIES_SQL}, s AS (SELECT id, title ILIKE '%tion%' AS a, content ILIKE '%tion%' AS b, {SIM('gt', 'q')} AS st, {SIM('gs', 'q')} AS ss FROM (SELECT id, title, content, {TRGM('title')} AS gt, {TRGM('content')} AS gs, {TRGM("'tion'")} AS q FROM memories))
SELECT id, round(greatest(st, ss, CASE WHEN a THEN 1.0 WHEN b THEN 0.95 ELSE 0.0 END), 8) AS score FROM s WHERE a OR b OR st >= 0.3 OR ss >= 0.3""")
def q4(spark, sf):
    index = documents_index(spark, sf)
    found = trigram.memory_lexical(memory_texts(spark, sf), F.col("title"), F.col("content"), "tion", lambda query, least: [index.alike(f, query, least) for f in ("title", "text")])
    return found.select("id", r("score").alias("score"))


@register("q5_knn_cosine", f"WITH {QV} SELECT vec_id, round(1 - {COS}, 8) AS distance, round(1 - (1 - {COS}) / 2, 8) AS half, round({COS}, 8) AS complement, row_number() OVER (ORDER BY round(1 - {COS}, 12), vec_id) AS rank FROM embeddings, qv QUALIFY rank <= 10")
def q5(spark, sf):
    x = vector_list(spark, sf, 10)
    return x.select(F.col("id").alias("vec_id"), r("distance").alias("distance"), r(V.similarity_half(F.col("distance"))).alias("half"), r(V.similarity_complement(F.col("distance"))).alias("complement"), "rank")


@register("q6_knn_page", f"WITH {QV} SELECT vec_id, round(1 - {COS}, 8) AS distance FROM embeddings, qv ORDER BY round(1 - {COS}, 12), vec_id LIMIT 5 OFFSET 5")
def q6(spark, sf):
    return vector_list(spark, sf, 10).where("rank > 5").select(F.col("id").alias("vec_id"), r("distance").alias("distance"))


@register("q7_both_domains", f"WITH {QV}, s AS (SELECT vec_id, label % 2 AS domain, 1 - {COS} AS d FROM embeddings, qv) SELECT domain, vec_id, round(d, 8) AS distance, row_number() OVER (PARTITION BY domain ORDER BY round(d, 12), vec_id) AS rank FROM s QUALIFY rank <= 5")
def q7(spark, sf):
    x = load(spark, sf, "embeddings").crossJoin(F.broadcast(query_vector(spark, sf))).select("vec_id", (F.col("label") % 2).alias("domain"), V.cosine_distance(F.col("embedding"), F.col("query")).alias("d"))
    return S.ranked(x, [F.round("d", 12), F.col("vec_id")], 5, ["domain"]).select("domain", "vec_id", r("d").alias("distance"), "rank")


@register("q8_threshold_count", f"WITH {QV}, s AS (SELECT vec_id, 1 - {COS} AS d FROM embeddings, qv) SELECT vec_id, round(d, 8) AS distance, count(*) OVER () AS total FROM s WHERE d <= 0.6")
def q8(spark, sf):
    x = load(spark, sf, "embeddings").crossJoin(F.broadcast(query_vector(spark, sf))).select("vec_id", V.cosine_distance(F.col("embedding"), F.col("query")).alias("d")).where("d <= 0.6")
    return x.crossJoin(F.broadcast(x.agg(F.count("*").alias("total")))).select("vec_id", r("d").alias("distance"), "total")


@register("q9_client_threshold", f"WITH {QV}, {VEC} SELECT id, round(1 - distance, 8) AS similarity, row_number() OVER (ORDER BY rank) AS rank FROM vec WHERE 1 - distance >= 0.1")
def q9(spark, sf):
    x = vector_list(spark, sf).withColumn("similarity", V.similarity_complement(F.col("distance"))).where("similarity >= 0.1")
    return x.withColumn("rank", F.row_number().over(Window.orderBy("rank")).cast("long")).select("id", r("similarity").alias("similarity"), "rank")


@register("q10_knn_l2", f"WITH {QV} SELECT vec_id, round({L2}, 8) AS distance FROM embeddings, qv WHERE label < 8 ORDER BY round({L2}, 12), vec_id LIMIT 10")
def q10(spark, sf):
    x = load(spark, sf, "embeddings").where("label < 8").crossJoin(F.broadcast(query_vector(spark, sf))).select("vec_id", V.l2_distance(F.col("embedding"), F.col("query")).alias("d"))
    return S.ranked(x, [F.round("d", 12), F.col("vec_id")], 10).select("vec_id", r("d").alias("distance"))


@register("q10b_batch_knn", f"WITH qs AS (SELECT vec_id AS query_id, embedding AS query FROM embeddings WHERE vec_id % 50 = 0) SELECT query_id, vec_id, round(1 - {COS}, 8) AS distance, row_number() OVER (PARTITION BY query_id ORDER BY round(1 - {COS}, 12), vec_id) AS rank FROM embeddings, qs QUALIFY rank <= 5")
def q10b(spark, sf):
    """Many query vectors in one job: a stated set against all rows."""
    e = load(spark, sf, "embeddings")
    qs = e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    return S.knn(e, "embedding", qs, 5, "vec_id").select("query_id", "vec_id", r("distance").alias("distance"), "rank")


@register("q10c_cells_knn", f"WITH qs AS (SELECT vec_id AS query_id, embedding AS query FROM embeddings WHERE vec_id % 50 = 0) SELECT query_id, vec_id, round({L2}, 8) AS distance, row_number() OVER (PARTITION BY query_id ORDER BY round({L2}, 12), vec_id) AS rank FROM embeddings, qs QUALIFY rank <= 5")
def q10c(spark, sf):
    """The same stated set of queries over stored cells, by plain distance; one join by cell, however many queries."""
    qs = load(spark, sf, "embeddings").where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    index = cells.CellIndex(spark, f"{sf}/embeddings.parquet", "vec_id", "embedding", "l2", pivots=32).refresh()
    return index.nearest(qs, 5).select("query_id", "vec_id", r("distance").alias("distance"), "rank")


@register("q11_matching_count", f"WITH {QV} SELECT count(*) FILTER (WHERE {L2} <= 1.2) AS near, count(*) AS total FROM embeddings, qv")
def q11(spark, sf):
    x = load(spark, sf, "embeddings").crossJoin(F.broadcast(query_vector(spark, sf)))
    return x.agg(F.count_if(V.l2_distance(F.col("embedding"), F.col("query")) <= 1.2).alias("near"), F.count("*").alias("total"))


def with_fallback(scored: DataFrame, threshold: float, k: int, order: list) -> DataFrame:
    """Rows within the threshold; the plain top k when there are none."""
    within = scored.where(F.col("d") <= threshold)
    any_within = F.broadcast(within.agg(F.count("*").alias("__n")))
    return S.ranked(scored.crossJoin(any_within).where((F.col("d") <= threshold) | (F.col("__n") == 0)).withColumn("fallback", F.col("__n") == 0).drop("__n"), order, k)


@register("q12_fallback", f"""WITH {QV}, s AS (SELECT vec_id, {L2} AS d FROM embeddings, qv), lim AS (SELECT * FROM (VALUES (-1.0), (1.2)) t(lim)), n AS (SELECT lim, count(*) FILTER (WHERE d <= lim) AS n FROM s, lim GROUP BY lim)
SELECT lim::DOUBLE AS threshold, vec_id, round(d, 8) AS distance, n = 0 AS fallback FROM s JOIN n ON n = 0 OR d <= lim QUALIFY row_number() OVER (PARTITION BY lim ORDER BY round(d, 12), vec_id) <= 5""")
def q12(spark, sf):
    """A threshold that leaves nothing, and one that leaves some."""
    x = load(spark, sf, "embeddings").crossJoin(F.broadcast(query_vector(spark, sf))).select("vec_id", V.l2_distance(F.col("embedding"), F.col("query")).alias("d"))
    parts = [with_fallback(x, limit, 5, [F.round("d", 12), F.col("vec_id")]).select(F.lit(limit).alias("threshold"), "vec_id", r("d").alias("distance"), "fallback") for limit in (-1.0, 1.2)]
    return parts[0].unionByName(parts[1])


@register("q13_search_function", f"WITH {QV} SELECT vec_id, round({COS}, 8) AS similarity FROM embeddings, qv WHERE label = 3 ORDER BY round(1 - {COS}, 12), vec_id LIMIT 7")
def q13(spark, sf):
    x = load(spark, sf, "embeddings").where("label = 3").crossJoin(F.broadcast(query_vector(spark, sf))).select("vec_id", V.cosine_distance(F.col("embedding"), F.col("query")).alias("d"))
    return S.ranked(x, [F.round("d", 12), F.col("vec_id")], 7).select("vec_id", r(1 - F.col("d")).alias("similarity"))


_M = lambda sql: f"WITH {MEMORIES_SQL} {sql}"


@register("q14_entity_search", _M("SELECT id, 1.0::DOUBLE AS score FROM memories WHERE list_contains(list_filter(regexp_extract_all(content, '\\p{L}+'), lambda w: regexp_full_match(w, '[A-Z][a-z]{3,}')), 'Hand') AND deleted_at IS NULL ORDER BY created_at DESC, id LIMIT 20"))
def q14(spark, sf):
    m = memories(spark, sf).where(F.array_contains(names("content", 3), "Hand") & F.col("deleted_at").isNull())
    return m.orderBy(F.col("created_at").desc(), "id").limit(20).select("id", F.lit(1.0).alias("score"))


@register("q15_tag_search", _M("SELECT id, 1.0::DOUBLE AS score FROM memories WHERE list_contains(tags, 'x:candidate') ORDER BY created_at DESC, id LIMIT 20"))
def q15(spark, sf):
    return memories(spark, sf).where(F.array_contains("tags", "x:candidate")).orderBy(F.col("created_at").desc(), "id").limit(20).select("id", F.lit(1.0).alias("score"))


@register("q16_tag_listing", _M("SELECT id, created_at, (SELECT count(*) FROM memories WHERE list_has_any(tags, ['de', 'fr'])) AS total FROM memories WHERE list_has_any(tags, ['de', 'fr']) ORDER BY created_at DESC, id LIMIT 10 OFFSET 5"))
def q16(spark, sf):
    m = memories(spark, sf).where(D.any_tag(F.col("tags"), ["de", "fr"])).select("id", "created_at")
    page = m.orderBy(F.col("created_at").desc(), "id").offset(5).limit(10)
    return page.crossJoin(F.broadcast(m.agg(F.count("*").alias("total"))))


@register("q17_memory_list", _M("SELECT id, title FROM memories WHERE deleted_at IS NULL AND lang = 'es' ORDER BY created_at DESC, id LIMIT 15"))
def q17(spark, sf):
    return memories(spark, sf).where("deleted_at IS NULL AND lang = 'es'").orderBy(F.col("created_at").desc(), "id").limit(15).select("id", "title")


def _rrf_sql(lists: list[tuple[str, float | None]], k: int = 60, cut: str = "") -> str:
    one = " UNION ALL ".join(f"SELECT id, rank, {n} AS n, {1.0 if w is None else w} / ({k} + rank) AS part, '{t}' AS name FROM {t}" for n, (t, w) in enumerate(lists))
    return f"fused AS (SELECT id, sum(part ORDER BY n) AS rrf_score, string_agg(name, '+' ORDER BY n) AS sources, min(n) AS first, arg_min(rank, n) AS place FROM ({one}) GROUP BY id)"


_FUSED_RANK = "row_number() OVER (ORDER BY rrf_score DESC, first, place, id)"


@register("q18_rrf", f"WITH {QV}, {LEX}, {VEC}, {_rrf_sql([('lex', None), ('vec', None)])} SELECT id, round(rrf_score, 10) AS rrf_score, sources, {_FUSED_RANK} AS rank FROM fused QUALIFY rank <= 30")
def q18(spark, sf):
    x = S.fuse([("lex", lexical_list(spark, sf), None), ("vec", vector_list(spark, sf), None)], "id")
    return S.ranked(x, S.fused_order("id"), 30).select("id", r("rrf_score", 10).alias("rrf_score"), "sources", "rank")


@register("q19_rrf_weighted", f"WITH {QV}, {LEX}, {VEC}, {_rrf_sql([('lex', 0.4), ('vec', 0.6)])} SELECT id, round(rrf_score, 10) AS rrf_score, sources, {_FUSED_RANK} AS rank FROM fused QUALIFY rank <= 30")
def q19(spark, sf):
    x = S.fuse([("lex", lexical_list(spark, sf), 0.4), ("vec", vector_list(spark, sf), 0.6)], "id")
    return S.ranked(x, S.fused_order("id"), 30).select("id", r("rrf_score", 10).alias("rrf_score"), "sources", "rank")


@register("q20_rrf_named_single", f"WITH {LEX} SELECT id, round(1.0 / (60 + rank), 10) AS rrf_score, 'lexical' AS sources FROM lex")
def q20(spark, sf):
    return S.fuse_single(lexical_list(spark, sf), "id", "lexical").select("id", r("rrf_score", 10).alias("rrf_score"), "sources")


_MARKS = " + ".join(f"(length(text) - length(replace(text, '{m}', ''))) // {len(m)}" for m in ("(", ")", "{", "}", ".", "->", "::"))
_WORDS = "len(list_filter(regexp_split_to_array(text, '[ \\t\\n\\r]+'), lambda w: w <> ''))"


@register("q21_adaptive_k", f"SELECT item_id, CASE WHEN m >= 3 THEN 20 WHEN m = 0 AND w > 5 THEN 80 ELSE 60 END AS k FROM (SELECT item_id, {_MARKS} AS m, {_WORDS} AS w FROM benchmark)")
def q21(spark, sf):
    m, w = S.code_marks_of(F.col("text")), F.size(F.filter(F.split("text", "[ \t\n\r]+"), lambda x: x != ""))
    return load(spark, sf, "benchmark").select("item_id", F.when(m >= 3, 20).when((m == 0) & (w > 5), 80).otherwise(60).alias("k"))


@register("q22_auto_weights", f"SELECT item_id, CASE WHEN m >= 5 THEN 0.3 WHEN m = 0 AND w > 3 THEN 0.5 ELSE 0.4 END::DOUBLE AS lexical FROM (SELECT item_id, {_MARKS} AS m, {_WORDS} AS w FROM benchmark)")
def q22(spark, sf):
    m, w = S.code_marks_of(F.col("text")), F.size(F.filter(F.split("text", "[ \t\n\r]+"), lambda x: x != ""))
    return load(spark, sf, "benchmark").select("item_id", F.when(m >= 5, 0.3).when((m == 0) & (w > 3), 0.5).otherwise(0.4).cast("double").alias("lexical"))


_TOK = "regexp_extract_all(lower({}), '[a-zA-Z0-9\\x{{00C0}}-\\x{{024F}}]+')"


def _bm25_sql(pool: str, tokens: list[str], body: str = "text") -> str:
    q = {t: tokens.count(t) for t in dict.fromkeys(tokens)}
    cols = ", ".join(f"len(list_filter(t, lambda v: v = '{t}')) AS tf{i}" for i, t in enumerate(q))
    dfs = ", ".join(f"sum(CASE WHEN tf{i} > 0 THEN 1 ELSE 0 END) OVER () AS df{i}" for i in range(len(q)))
    score = " + ".join(f"{float(n)} * CASE WHEN tf{i} > 0 THEN ln((n - df{i} + 0.5) / (df{i} + 0.5) + 1.0) * (tf{i} * 2.5) / (tf{i} + 1.5 * (0.25 + 0.75 * len / avg)) ELSE 0.0 END" for i, n in enumerate(q.values()))
    return f"""toks AS (SELECT p.*, {_TOK.format(body)} AS t FROM {pool} p JOIN documents ON doc_id = p.id), tfs AS (SELECT *, len(t) AS len, {cols} FROM toks),
stats AS (SELECT *, count(*) OVER () AS n, avg(len) OVER () AS avg, {dfs} FROM tfs), scored AS (SELECT *, {score} AS rerank_score FROM stats)"""


_TOKENS = S.query_tokens(QUERY)


@register("q23_bm25", f"WITH {LEX}, pool AS (SELECT * FROM lex WHERE rank <= 30), {_bm25_sql('pool', _TOKENS)} SELECT id, round(rerank_score, 8) AS rerank_score, row_number() OVER (ORDER BY round(rerank_score, 12) DESC, rank) AS rank FROM scored")
def q23(spark, sf):
    pool = lexical_list(spark, sf, 30).join(load(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text"), "id")
    x = S.bm25(pool, "id", F.col("text"), _TOKENS)
    return x.select("id", r("rerank_score").alias("rerank_score"), F.row_number().over(Window.orderBy(F.round("rerank_score", 12).desc(), "rank")).cast("long").alias("rank"))


_HYBRID = f"{QV}, {LEX}, {VEC}, {_rrf_sql([('lex', 0.4), ('vec', 0.6)])}, pool AS (SELECT *, {_FUSED_RANK} AS rank FROM fused QUALIFY rank <= 30), {_bm25_sql('pool', _TOKENS, 'left(text, 1000)')}"


def hybrid_pool(spark, sf, weights=(0.4, 0.6), k=60, pool=30) -> DataFrame:
    """Fused lists, cut to a pool, with the documents' texts and BM25 scores of their first 1000 characters, which is all that the reranker of code reads."""
    fused = S.fuse([("lex", lexical_list(spark, sf), weights[0]), ("vec", vector_list(spark, sf), weights[1])], "id", k)
    top = S.ranked(fused, S.fused_order("id"), pool)
    return S.bm25(top.join(load(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text"), "id"), "id", F.left("text", F.lit(1000)), _TOKENS)


@register("q24_hybrid_code", f"WITH {_HYBRID} SELECT * FROM (SELECT id, sources, round(rrf_score, 10) AS rrf_score, round(rerank_score, 8) AS rerank_score, row_number() OVER (ORDER BY round(rerank_score, 12) DESC, rank) AS rank FROM scored) WHERE rank <= 10")
def q24(spark, sf):
    """Lexical and vector lists, weighted fusion, BM25 over the first 30, first 10."""
    x = hybrid_pool(spark, sf)
    final = F.row_number().over(Window.orderBy(F.round("rerank_score", 12).desc(), "rank")).cast("long")
    return x.select("id", "sources", r("rrf_score", 10).alias("rrf_score"), r("rerank_score").alias("rerank_score"), final.alias("rank")).where("rank <= 10")


_MEM_LISTS = f"""{QV}, {LEX}, {VEC}, mlex AS (SELECT id, score, rank FROM lex WHERE rank <= 50), mvec AS (SELECT id, rank FROM vec WHERE rank <= 50),
mtag AS (SELECT id, row_number() OVER (ORDER BY created_at DESC, id) AS rank FROM memories WHERE list_contains(tags, 'x:candidate') QUALIFY rank <= 50),
ment AS (SELECT id, row_number() OVER (ORDER BY created_at DESC, id) AS rank FROM memories WHERE list_contains(list_filter(regexp_extract_all(content, '\\p{{L}}+'), lambda w: regexp_full_match(w, '[A-Z][a-z]{{3,}}')), 'Hand') QUALIFY rank <= 50)"""


@register("q25_hybrid_memory", f"""WITH {MEMORIES_SQL}, {_MEM_LISTS}, {_rrf_sql([('mlex', None), ('mvec', None), ('ment', None), ('mtag', None)])},
pool AS (SELECT *, {_FUSED_RANK} AS rank FROM fused QUALIFY rank <= 30), {_bm25_sql('pool', _TOKENS)},
placed AS (SELECT *, row_number() OVER (ORDER BY round(rerank_score, 12) DESC, rank) AS place FROM scored),
aged AS (SELECT f.*, rrf_score * exp(-0.01 * (epoch_us((SELECT max(created_at) FROM memories)) - epoch_us(m.created_at)) / 86400000000.0) AS score FROM placed f JOIN memories m ON m.id = f.id)
SELECT * FROM (SELECT id, sources, round(score, 10) AS score, round(rerank_score, 8) AS rerank_score, row_number() OVER (ORDER BY round(score, 13) DESC, place) AS rank FROM aged) WHERE rank <= 10""")
def q25(spark, sf):
    """Four branches, unweighted fusion, BM25 over the first 30, decay by age; the decayed score decides, the reranker's order on ties."""
    m, texts = memories(spark, sf), memory_texts(spark, sf)
    newest = [F.col("created_at").desc(), F.col("id")]
    tag = S.ranked(m.where(F.array_contains("tags", "x:candidate")).select("id", "created_at"), newest, 50)
    # the name is looked for first, as plain text; only what holds it is cut into words
    ent = S.ranked(texts.where(F.col("content").contains("Hand")).where(F.array_contains(names("content", 3), "Hand")).select("id", "created_at"), newest, 50)
    fused = S.fuse([("mlex", lexical_list(spark, sf, 50), None), ("mvec", vector_list(spark, sf, 50), None), ("ment", ent, None), ("mtag", tag, None)], "id")
    top = S.ranked(fused, S.fused_order("id"), 30).join(texts.select("id", "content", "created_at"), "id").crossJoin(F.broadcast(texts.agg(F.max("created_at").alias("now"))))
    x = S.bm25(top, "id", F.col("content"), _TOKENS).withColumn("place", F.row_number().over(Window.orderBy(F.round("rerank_score", 12).desc(), "rank")))
    x = x.withColumn("score", F.col("rrf_score") * DE.decay(DE.age_days(F.col("now"), F.col("created_at"))))
    final = F.row_number().over(Window.orderBy(F.round("score", 13).desc(), "place")).cast("long")
    return x.select("id", "sources", r("score", 10).alias("score"), r("rerank_score").alias("rerank_score"), final.alias("rank")).where("rank <= 10")


_AGE = "(epoch_us((SELECT max(created_at) FROM memories)) - epoch_us(created_at)) / 86400000000.0"


@register("q26_decay", _M(f"SELECT id, round(exp(-0.01 * {_AGE}), 8) AS decay FROM memories"))
def q26(spark, sf):
    m = memories(spark, sf)
    return m.crossJoin(F.broadcast(m.agg(F.max("created_at").alias("now")))).select("id", r(DE.decay(DE.age_days(F.col("now"), F.col("created_at")))).alias("decay"))


@register("q27_tag_decay", _M(f"SELECT id, round(CASE WHEN list_contains(tags, 'sys:pattern') THEN 0.005 ELSE 0.01 END, 6)::DOUBLE AS rate, round(exp(-(CASE WHEN list_contains(tags, 'sys:pattern') THEN 0.005 ELSE 0.01 END) * {_AGE}), 8) AS decay FROM memories"))
def q27(spark, sf):
    m = memories(spark, sf)
    rate = DE.rate_of_tags(F.col("tags"))
    return m.crossJoin(F.broadcast(m.agg(F.max("created_at").alias("now")))).select("id", rate.alias("rate"), r(DE.decay(DE.age_days(F.col("now"), F.col("created_at")), rate)).alias("decay"))


@register("q28_outcome", _M("SELECT id, round(CASE WHEN outcome_positive = 0 AND outcome_negative = 0 THEN 1.0 ELSE 1 + 0.5 * (outcome_positive - outcome_negative) / (outcome_positive + outcome_negative + 1) END, 8)::DOUBLE AS factor FROM memories"))
def q28(spark, sf):
    return memories(spark, sf).select("id", r(DE.outcome_factor(F.col("outcome_positive"), F.col("outcome_negative"))).alias("factor"))


@register("q29_half_life", "SELECT p_partkey, CASE WHEN p_size % 5 = 0 THEN NULL ELSE round(0.6931471805599453 / (p_size % 5 / 100.0), 8) END AS days FROM part")
def q29(spark, sf):
    rate = (F.col("p_size") % 5) / 100.0
    return load(spark, sf, "part").select("p_partkey", r(F.nullif(DE.half_life(rate), F.lit(float("inf")))).alias("days"))


_SYNONYMS_SQL = "MAP {" + ", ".join(f"'{k}': {v!r}" for k, v in S.SYNONYMS.items()) + "}"
_QUERY_WORDS = "string_split(['auth', 'error', 'cache', 'query', 'config'][event_id % 5 + 1] || ' ' || event_type || ' in ' || ['token', 'db', 'auth', 'log'][user_id % 4 + 1], ' ')"


@register("q30_query_rewriting", f"SELECT event_id, array_to_string(list_transform(list_filter(list_zip(w, range(1, len(w) + 1)), lambda x: list_position(w, x[1]) = x[2]), lambda x: x[1]), ' ') AS words FROM (SELECT event_id, flatten(list_transform({_QUERY_WORDS}, lambda t: list_concat([t], coalesce(syn[t], [])))) AS w FROM events, (SELECT {_SYNONYMS_SQL} AS syn))")
def q30(spark, sf):
    """Queries made of each event's kind and numbers, every word followed by its synonyms."""
    pick = lambda words, n: F.element_at(F.array(*map(F.lit, words)), (n + 1).cast("int"))
    q = F.concat_ws(" ", pick(["auth", "error", "cache", "query", "config"], F.col("event_id") % 5), "event_type", F.lit("in"), pick(["token", "db", "auth", "log"], F.col("user_id") % 4))
    return load(spark, sf, "events").select("event_id", F.array_join(S.expanded(F.split(q, " ")), " ").alias("words"))


_FIRST_OF = "list_transform(list_filter(list_zip({w}, range(1, len({w}) + 1)), lambda x: list_position({w}, x[1]) = x[2]), lambda x: x[1])[1:{n}]"
_LIST = lambda words: "[" + ", ".join(f"'{w}'" for w in words) + "]"


@register("q31_keywords", f"""WITH runs AS (SELECT conv_id, turn, text, regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+') AS w FROM conversations WHERE role = 'user'),
u AS (SELECT conv_id, turn, list_filter(list_transform(w, lambda x: lower(x)), lambda x: regexp_full_match(x, '[a-z]{{3,}}') AND NOT list_contains({_LIST(S.STOPWORDS)}, x)) AS t,
list_concat(list_concat(list_filter(w, lambda x: regexp_full_match(x, '[A-Z]{{2,}}')), regexp_extract_all(text, '\\bv?[0-9]+\\.[0-9]+(?:\\.[0-9]+)?\\b')), list_filter(w, lambda x: regexp_full_match(x, '[A-Z][a-z]{{2,}}') AND NOT list_contains({_LIST(S.COMMON_CAPITALISED)}, lower(x)))) AS n FROM runs)
SELECT conv_id, turn, array_to_string({_FIRST_OF.format(w='t', n=4)}, ' ') AS themes, array_to_string({_FIRST_OF.format(w='n', n=5)}, ' ') AS names FROM u""")
def q31(spark, sf):
    return load(spark, sf, "conversations").where("role = 'user'").select("conv_id", "turn", F.array_join(S.themes(F.col("text")), " ").alias("themes"), F.array_join(S.names(F.col("text")), " ").alias("names"))


_MARKED = ("secret", "token", "erblest")
_PLACES = " UNION ALL ".join(f"SELECT doc_id, text, unnest(list_filter(range(1, length(text) + 1), lambda i: substr(low, i, {len(t)}) = '{t}')) - 1 AS a, {len(t)} AS len FROM d WHERE contains(low, '{t}')" for t in _MARKED)


@register("q32_snippets", f"""WITH d AS (SELECT doc_id, text, lower(text) AS low FROM documents),
hit AS (SELECT doc_id, text, a, a + len AS b FROM ({_PLACES})),
edge AS (SELECT *, coalesce(a > max(b) OVER (PARTITION BY doc_id ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS new FROM hit),
span AS (SELECT doc_id, any_value(text) AS text, min(a) AS a, max(b) AS b FROM (SELECT *, sum(new::INT) OVER (PARTITION BY doc_id ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS g FROM edge) GROUP BY doc_id, g),
one AS (SELECT doc_id, min(a) AS a FROM span GROUP BY doc_id),
two AS (SELECT s.doc_id, min(s.a) AS a FROM span s JOIN one USING (doc_id) WHERE s.a >= one.a + 150 GROUP BY s.doc_id),
three AS (SELECT s.doc_id, min(s.a) AS a FROM span s JOIN two USING (doc_id) WHERE s.a >= two.a + 150 GROUP BY s.doc_id),
picked AS (SELECT s.* FROM span s JOIN (FROM one UNION ALL FROM two UNION ALL FROM three) p ON p.doc_id = s.doc_id AND p.a = s.a),
wide AS (SELECT *, greatest(0, a - 50) AS lo0, least(length(text), b + 100) AS hi0 FROM picked),
blank AS (SELECT *, instr(reverse(substr(text, greatest(0, lo0 - 20) + 1, lo0 - greatest(0, lo0 - 20))), ' ') AS back, instr(substr(text, hi0 + 1, 20), ' ') AS ahead FROM wide),
cut AS (SELECT *, CASE WHEN lo0 > 0 AND back > 0 AND lo0 - back > 0 THEN lo0 - back + 1 ELSE lo0 END AS lo, CASE WHEN hi0 < length(text) AND ahead > 0 THEN hi0 + ahead - 1 ELSE hi0 END AS hi FROM blank)
SELECT doc_id, CASE WHEN lo > 0 THEN '...' ELSE '' END || substr(text, lo + 1, a - lo) AS before, substr(text, a + 1, b - a) AS match, substr(text, b + 1, hi - b) || CASE WHEN hi < length(text) THEN '...' ELSE '' END AS after FROM cut""")
def q32(spark, sf):
    cut = S.snippets_of(list(_MARKED))
    return load(spark, sf, "documents").select("doc_id", F.explode(cut("text")).alias("s")).select("doc_id", "s.*")


@register("q33_mark", "SELECT doc_id, regexp_replace(text, '(the|tion)', '<mark>\\1</mark>', 'gi') AS text FROM documents")
def q33(spark, sf):
    return load(spark, sf, "documents").select("doc_id", X.mark(F.col("text"), ["the", "tion", "x"]).alias("text"))


@register("q34_first_per_group", f"WITH {LEX} SELECT source, id, rank FROM lex JOIN documents ON doc_id = id QUALIFY row_number() OVER (PARTITION BY source ORDER BY rank) = 1")
def q34(spark, sf):
    x = lexical_list(spark, sf).join(load(spark, sf, "documents").select(F.col("doc_id").alias("id"), "source"), "id")
    return x.groupBy("source").agg(F.min_by(F.struct("id", "rank"), "rank").alias("v")).select("source", "v.*")


@register("q35_page_flags", f"WITH {LEX} SELECT id, rank, (SELECT count(*) FROM lex) > 20 AS has_next, 20::BIGINT AS next_offset FROM lex WHERE rank > 10 AND rank <= 20")
def q35(spark, sf):
    x = lexical_list(spark, sf)
    return x.crossJoin(F.broadcast(x.agg(F.count("*").alias("n")))).where("rank > 10 AND rank <= 20").select("id", "rank", (F.col("n") > 20).alias("has_next"), F.lit(20).cast("long").alias("next_offset"))


@register("q36_search_stats", f"WITH {LEX} SELECT count(*) AS n, round(avg(score), 8) AS mean, round(min(score), 8) AS lo, round(max(score), 8) AS hi FROM lex")
def q36(spark, sf):
    return lexical_list(spark, sf).agg(F.count("*").alias("n"), r(F.avg("score")).alias("mean"), r(F.min("score")).alias("lo"), r(F.max("score")).alias("hi"))


@register("q37_pairwise", f"WITH {QV} SELECT vec_id, round(greatest(0.0, least(1.0, {COS})), 8) AS clipped, round(greatest(0.0, least(1.0, ({COS} + 1) / 2)), 8) AS rescaled FROM embeddings, qv")
def q37(spark, sf):
    cos = V.cosine(F.col("embedding"), F.col("query"))
    return load(spark, sf, "embeddings").crossJoin(F.broadcast(query_vector(spark, sf))).select("vec_id", r(V.clipped(cos)).alias("clipped"), r(V.rescaled(cos)).alias("rescaled"))


@register("q38_autocomplete", "SELECT DISTINCT p_name AS name, length(p_name) AS len FROM part WHERE p_name ILIKE '%ri%' ORDER BY len, name LIMIT 10")
def q38(spark, sf):
    return load(spark, sf, "part").where(F.col("p_name").ilike("%ri%")).select(F.col("p_name").alias("name"), F.length("p_name").cast("long").alias("len")).distinct().orderBy("len", "name").limit(10)


@register("q38b_key_counts", "SELECT key, value, count(*) AS n FROM (SELECT 'k' AS key, json_extract_string(props, '$.k') AS value FROM events) GROUP BY key, value")
def q38b(spark, sf):
    return load(spark, sf, "events").select(F.explode(F.from_json("props", "map<string,string>"))).groupBy("key", "value").agg(F.count("*").alias("n"))


_CODE = f"{QV}, {LEX.replace('lex AS', 'lexical AS', 1)}, {VEC.replace('vec AS', 'vector AS', 1).replace('FROM embeddings, qv', 'FROM embeddings JOIN documents ON doc_id = vec_id, qv')}, {_rrf_sql([('lexical', 0.5), ('vector', 0.5)], 80)}, pool AS (SELECT *, {_FUSED_RANK} AS rank FROM fused QUALIFY rank <= 30), {_bm25_sql('pool', _TOKENS, 'left(text, 1000)')}"


def code_chunks(spark, sf) -> DataFrame:
    """Documents as chunks, with the vectors of their numbers."""
    d = load(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.array_join(F.slice(F.split("text", " "), 1, 5), " ").alias("name"), F.col("text").alias("source_code"), F.col("lang").alias("language"))
    return d.join(load(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding"), "id", "left")


@register("q39_search_code", f"WITH {_CODE} SELECT id, rank, rrf_score, rerank_score, sources FROM (SELECT id, sources, round(rrf_score, 10) AS rrf_score, round(rerank_score, 8) AS rerank_score, row_number() OVER (ORDER BY rerank_score DESC, rank) AS rank FROM scored) WHERE rank <= 10")
def q39(spark, sf):
    """The entry point for code: weights and k follow from the query, lexical hits come from the stored index, all embeddings are of documents."""
    d = load(spark, sf, "documents")
    fields = {"name": F.array_join(F.slice(F.split("text", " "), 1, 5), " "), "source_code": F.col("text")}
    index = trigram.TrigramIndex(spark, f"{sf}/documents.parquet", "doc_id", fields).refresh()
    vector = [float(v) for v in query_vector(spark, sf).first()["query"]]
    found = hybrid.search_code(code_chunks(spark, sf), QUERY, vector, threshold=0.1, index=index)
    return found.select(F.col("id").cast(d.schema["doc_id"].dataType).alias("id"), "rank", r("rrf_score", 10).alias("rrf_score"), r("rerank_score").alias("rerank_score"), "sources")


@register("q39b_list_memories", f"WITH {MEMORIES_SQL}, m AS (SELECT *, count(*) OVER () AS total FROM memories WHERE deleted_at IS NULL AND list_contains(tags, 'en') AND consumed_at IS NULL) SELECT id, title, total FROM m ORDER BY created_at DESC, id LIMIT 10 OFFSET 5")
def q39b(spark, sf):
    return hybrid.list_memories(memories(spark, sf), {"tags": ["en"]}, consumed=False, limit=10, offset=5).select("id", "title", "total")


@register("q39c_search_events", "SELECT event_id AS id, ts FROM events WHERE json_extract_string(props, '$.k') = '42' AND ts >= TIMESTAMP '2024-01-01 06:00:00' ORDER BY ts DESC, id LIMIT 15 OFFSET 3")
def q39c(spark, sf):
    e = load(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("ts").alias("timestamp"), F.col("props").alias("metadata"))
    found = hybrid.search_events(e, metadata={"k": 42}, start=datetime(2024, 1, 1, 6), limit=15, offset=3)
    return found.select("id", F.col("timestamp").alias("ts"))
