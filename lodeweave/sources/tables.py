"""Tables of the data model, read or derived from the supplied Parquet tables.

Each derived table also has its SQL, so that oracles can put it in a WITH clause.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

EPOCH = "2024-01-01 00:00:00"


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


MEMORIES_SQL = f"""memories AS (
  SELECT d.doc_id AS id, left(d.text, 60) AS title, d.text AS content, d.lang, d.source,
         list_value(d.lang, d.source, CASE l.quality WHEN 1 THEN 'sys:pattern' WHEN 0 THEN 'x:candidate' ELSE 'x:doubt' END) AS tags,
         TIMESTAMP '{EPOCH}' + d.doc_id * INTERVAL 1 HOUR AS created_at,
         CASE WHEN l.toxic = 1 THEN TIMESTAMP '{EPOCH}' END AS deleted_at,
         CASE WHEN d.doc_id % 5 = 0 THEN TIMESTAMP '{EPOCH}' END AS consumed_at,
         CAST(coalesce(l.quality, 0) * (d.doc_id % 7) AS BIGINT) AS outcome_positive,
         CAST(coalesce(l.toxic, 0) * (d.doc_id % 3) AS BIGINT) AS outcome_negative
  FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)"""


def memories(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, l = load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels")
    start = F.lit(EPOCH).cast("timestamp_ntz")
    state = F.when(F.col("quality") == 1, "sys:pattern").when(F.col("quality") == 0, "x:candidate").otherwise("x:doubt")
    return d.join(l, "doc_id", "left").select(
        F.col("doc_id").alias("id"), F.left("text", F.lit(60)).alias("title"), F.col("text").alias("content"), "lang", "source",
        F.array("lang", "source", state).alias("tags"),
        (start + F.make_dt_interval(hours=F.col("doc_id").cast("int"))).alias("created_at"),
        F.when(F.col("toxic") == 1, start).alias("deleted_at"),
        F.when(F.col("doc_id") % 5 == 0, start).alias("consumed_at"),
        (F.coalesce("quality", F.lit(0)) * (F.col("doc_id") % 7)).cast("long").alias("outcome_positive"),
        (F.coalesce("toxic", F.lit(0)) * (F.col("doc_id") % 3)).cast("long").alias("outcome_negative"),
    )


def memory_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Those columns of memories that documents alone give: texts then meet no join in which they would be shuffled."""
    start = F.lit(EPOCH).cast("timestamp_ntz")
    return load(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"), F.left("text", F.lit(60)).alias("title"), F.col("text").alias("content"), "lang", "source",
        (start + F.make_dt_interval(hours=F.col("doc_id").cast("int"))).alias("created_at"),
    )


#: Parts have node ids from a million on; every part leads back to one supplier, so that the graph has cycles.
EDGES_SQL = """edges AS (
  SELECT DISTINCT l_suppkey AS src, 1000000 + l_partkey AS dst, 'supplies' AS relation FROM lineitem
  UNION ALL
  SELECT 1000000 + p_partkey AS src, p_partkey % 7 AS dst, 'returns' AS relation FROM part)"""
NODES_SQL = """nodes AS (
  SELECT s_suppkey AS node_id, 'Supplier' AS node_type, s_name AS label FROM supplier
  UNION ALL
  SELECT 1000000 + p_partkey AS node_id, 'Part' AS node_type, p_name AS label FROM part)"""


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links(spark, sf_dir, True)


def links(spark: SparkSession, sf_dir: str, once: bool = False) -> DataFrame:
    """The edges as they are read; a supplier that supplies a part often is there as often, unless each is asked for once."""
    out = load(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("src"), (F.lit(1000000) + F.col("l_partkey")).alias("dst"))
    out = (out.distinct() if once else out).withColumn("relation", F.lit("supplies"))
    back = load(spark, sf_dir, "part").select((F.lit(1000000) + F.col("p_partkey")).alias("src"), (F.col("p_partkey") % 7).alias("dst"), F.lit("returns").alias("relation"))
    return out.unionByName(back)


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = load(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("node_id"), F.lit("Supplier").alias("node_type"), F.col("s_name").alias("label"))
    p = load(spark, sf_dir, "part").select((F.lit(1000000) + F.col("p_partkey")).alias("node_id"), F.lit("Part").alias("node_type"), F.col("p_name").alias("label"))
    return s.unionByName(p)


#: Requests: events as endpoint calls.
REQUESTS_SQL = """requests AS (
  SELECT event_id, ts, '/u/' || user_id AS endpoint, value AS latency, CASE event_type WHEN 'error' THEN 500 WHEN 'click' THEN 404 ELSE 200 END AS status, event_type AS category FROM events)"""


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("event_type") == "error", 500).when(F.col("event_type") == "click", 404).otherwise(200)
    return load(spark, sf_dir, "events").select("event_id", "ts", F.concat(F.lit("/u/"), F.col("user_id").cast("string")).alias("endpoint"), F.col("value").alias("latency"), status.alias("status"), F.col("event_type").alias("category"))


#: Entities of a document: its distinct capitalised words of four letters or more.
ENTITIES_SQL = """ent AS (
  SELECT DISTINCT doc_id AS id, unnest(list_filter(regexp_extract_all(text, '\\p{L}+'), lambda w: regexp_full_match(w, '[A-Z][a-z]{3,}'))) AS name FROM documents)"""


def names(text: str, least: int) -> Column:
    """Words of an ASCII capital and at least ``least`` small ASCII letters; words are runs of letters of any script."""
    return F.filter(F.regexp_extract_all(text, F.lit(r"(\p{L}+)"), F.lit(1)), lambda w: w.rlike(f"^[A-Z][a-z]{{{least},}}$"))


def entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = names("text", 3)
    return load(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.explode(F.array_distinct(found)).alias("name"))
