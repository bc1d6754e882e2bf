"""Joins, aggregates, windows, ordering, set operations and named views."""
from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..catalog import register
from ..operators import quantiles
from ..operators.intervals import containing
from ..operators.relations import sharing
from ..sources.tables import load


def r(c, n=6):
    return F.round(c, n)


@register("j1_inner_filtered", "SELECT o_orderkey, c_mktsegment, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment = 'MACHINERY'")
def j1(spark, sf):
    c = load(spark, sf, "customer").where("c_mktsegment = 'MACHINERY'").select("c_custkey", "c_mktsegment")
    return load(spark, sf, "orders").join(c, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_mktsegment", "o_totalprice")


@register("j2_join_top10", "SELECT c_name, o_orderkey, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def j2(spark, sf):
    # the top is cut before the join: every order has one customer
    top = load(spark, sf, "orders").join(load(spark, sf, "customer").select("c_custkey", "c_name"), F.col("o_custkey") == F.col("c_custkey"))
    return top.orderBy(F.col("o_totalprice").desc(), "o_orderkey").limit(10).select("c_name", "o_orderkey", "o_totalprice")


@register("j3_three_way", "SELECT c_mktsegment, count(*) AS n, round(sum(l_quantity), 4) AS qty FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment")
def j3(spark, sf):
    li, o, c = (load(spark, sf, t) for t in ("lineitem", "orders", "customer"))
    x = li.select("l_orderkey", "l_quantity").join(o.select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    x = x.join(c.select("c_custkey", "c_mktsegment"), F.col("o_custkey") == F.col("c_custkey"))
    return x.groupBy("c_mktsegment").agg(F.count("*").alias("n"), r(F.sum("l_quantity"), 4).alias("qty"))


@register("j4_left_join", "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON o_custkey = c_custkey")
def j4(spark, sf):
    return load(spark, sf, "customer").select("c_custkey").join(load(spark, sf, "orders").select("o_custkey", "o_orderkey"), F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "o_orderkey")


@register("j5_guarded_cast_key", "SELECT e.event_id, c.c_name FROM events e LEFT JOIN customer c ON c.c_custkey = CASE WHEN regexp_matches(json_extract_string(e.props, '$.k'), '^[0-9]+$') THEN TRY_CAST(json_extract_string(e.props, '$.k') AS BIGINT) END")
def j5(spark, sf):
    k = F.get_json_object("props", "$.k")
    e = load(spark, sf, "events").select("event_id", F.when(k.rlike("^[0-9]+$"), k.try_cast("long")).alias("k"))
    return e.join(load(spark, sf, "customer").select("c_custkey", "c_name"), F.col("k") == F.col("c_custkey"), "left").select("event_id", "c_name")


@register("j6_self_join_both_sides", """WITH rel AS (SELECT o_orderkey AS a, o_custkey AS b, o_totalprice AS score FROM orders)
SELECT rel.a, rel.b, s.c_mktsegment AS seg, t.n_name FROM rel JOIN customer s ON s.c_custkey = rel.b JOIN nation t ON t.n_nationkey = s.c_nationkey
WHERE score >= 200000 AND s.c_acctbal > 0 AND t.n_regionkey < 3""")
def j6(spark, sf):
    rel = load(spark, sf, "orders").where("o_totalprice >= 200000").select(F.col("o_orderkey").alias("a"), F.col("o_custkey").alias("b"))
    s = load(spark, sf, "customer").where("c_acctbal > 0")
    t = load(spark, sf, "nation").where("n_regionkey < 3")
    return rel.join(s, F.col("b") == F.col("c_custkey")).join(t, F.col("c_nationkey") == F.col("n_nationkey")).select("a", "b", F.col("c_mktsegment").alias("seg"), "n_name")


@register("j7_or_join", "SELECT n_nationkey AS k, count(*) AS n FROM nation JOIN (SELECT c_nationkey AS a, c_custkey % 25 AS b FROM customer) ON a = n_nationkey OR b = n_nationkey GROUP BY n_nationkey")
def j7(spark, sf):
    """An OR of two equalities is the union of two equi-joins, the second without the first's pairs."""
    e = load(spark, sf, "customer").select(F.col("c_nationkey").cast("long").alias("a"), (F.col("c_custkey") % 25).alias("b"))
    ends = e.select(F.col("a").alias("k")).unionByName(e.where("a <> b").select(F.col("b").alias("k")))
    n = load(spark, sf, "nation").select("n_nationkey")
    return ends.join(n, F.col("k") == F.col("n_nationkey")).groupBy(F.col("n_nationkey").alias("k")).agg(F.count("*").alias("n"))


@register("j8_undirected_join", "SELECT a AS x, count(*) AS n FROM (SELECT c_nationkey AS a, CAST(c_custkey % 25 AS INTEGER) AS b FROM customer UNION ALL SELECT CAST(c_custkey % 25 AS INTEGER), c_nationkey FROM customer) GROUP BY a")
def j8(spark, sf):
    e = load(spark, sf, "customer").select(F.col("c_nationkey").alias("a"), (F.col("c_custkey") % 25).cast("int").alias("b"))
    return e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b"))).groupBy(F.col("a").alias("x")).agg(F.count("*").alias("n"))


@register("j9_semi_join", "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 300000)")
def j9(spark, sf):
    return load(spark, sf, "customer").select("c_custkey", "c_name").join(load(spark, sf, "orders").where("o_totalprice > 300000"), F.col("c_custkey") == F.col("o_custkey"), "left_semi")


@register("j10_anti_join", "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def j10(spark, sf):
    return load(spark, sf, "customer").select("c_custkey", "c_name").join(load(spark, sf, "orders").select("o_custkey"), F.col("c_custkey") == F.col("o_custkey"), "left_anti")


@register("j11_exists_in_filter", "SELECT c_mktsegment, count(*) AS n, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)) AS with_orders FROM customer GROUP BY c_mktsegment")
def j11(spark, sf):
    ends = load(spark, sf, "orders").select("o_custkey").distinct()
    x = load(spark, sf, "customer").join(ends, F.col("c_custkey") == F.col("o_custkey"), "left")
    return x.groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.count_if(F.col("o_custkey").isNotNull()).alias("with_orders"))


@register("j12_cross_one_row", "WITH a AS (SELECT count(*) AS n_orders FROM orders), b AS (SELECT max(o_totalprice) AS top FROM orders) SELECT n_orders, top, n_orders > 1000 AS many FROM a CROSS JOIN b")
def j12(spark, sf):
    o = load(spark, sf, "orders")
    return o.agg(F.count("*").alias("n_orders")).crossJoin(o.agg(F.max("o_totalprice").alias("top"))).select("n_orders", "top", (F.col("n_orders") > 1000).alias("many"))


@register("j13_lateral_unnest", "SELECT word, count(*) AS n FROM (SELECT unnest(string_split(p_name, ' ')) AS word FROM part) GROUP BY word")
def j13(spark, sf):
    return load(spark, sf, "part").select(F.explode(F.split("p_name", " ")).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


@register("j14_recursive", """WITH RECURSIVE t(node, depth) AS (SELECT 0, 0 UNION ALL SELECT n_nationkey, depth + 1 FROM t JOIN nation ON n_nationkey = node + 5 WHERE depth < 4)
SELECT node, depth FROM t""")
def j14(spark, sf):
    return spark.sql("WITH RECURSIVE t(node, depth) AS (SELECT 0, 0 UNION ALL SELECT n_nationkey, depth + 1 FROM t JOIN {nation} ON n_nationkey = node + 5 WHERE depth < 4) SELECT node, depth FROM t", nation=load(spark, sf, "nation"))


@register("j15_lookup", "SELECT s_suppkey, n_name, r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def j15(spark, sf):
    s, n, g = (load(spark, sf, t) for t in ("supplier", "nation", "region"))
    return s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).join(g, F.col("n_regionkey") == F.col("r_regionkey")).select("s_suppkey", "n_name", "r_name")


_SPANS = "spans AS (SELECT o_custkey AS f, o_orderkey AS id, o_orderkey % 97 AS a, o_orderkey % 97 + o_orderkey % 13 AS b FROM orders)"


@register("j16_interval_containment", f"WITH {_SPANS} SELECT c.id AS child, p.id AS parent FROM spans c JOIN spans p ON p.f = c.f AND p.a < c.a AND p.b > c.b")
def j16(spark, sf):
    s = load(spark, sf, "orders").select(F.col("o_custkey").alias("f"), F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 97).alias("a"), (F.col("o_orderkey") % 97 + F.col("o_orderkey") % 13).alias("b"))
    return containing(s, s, "f", "a", "b").select(F.col("inner.id").alias("child"), F.col("outer.id").alias("parent"))


@register("j17_suffix_join", "WITH names AS (SELECT p_partkey AS id, replace(p_name, ' ', '.') AS path FROM part), q AS (SELECT DISTINCT split_part(p_name, ' ', 2) AS x FROM part) SELECT x, count(*) AS n FROM q JOIN names ON path = x OR path LIKE '%.' || x GROUP BY x")
def j17(spark, sf):
    """Every dotted suffix of a path becomes a join key."""
    path = F.split(F.col("p_name"), " ")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(path)), lambda i: F.array_join(F.slice(path, i, F.size(path)), "."))
    keys = load(spark, sf, "part").select("p_partkey", F.explode(suffixes).alias("x"))
    q = load(spark, sf, "part").select(F.get(path, F.lit(1)).alias("x")).where("x is not null").distinct()
    return keys.join(q, "x").groupBy("x").agg(F.count("*").alias("n"))


@register("j18_shared_key_pairs", "WITH m AS (SELECT DISTINCT o_custkey AS id, o_orderdate AS k FROM orders) SELECT DISTINCT a.id AS a, b.id AS b FROM m a JOIN m b ON a.k = b.k AND a.id < b.id")
def j18(spark, sf):
    return sharing(load(spark, sf, "orders").select(F.col("o_custkey").alias("id"), F.col("o_orderdate").alias("k")).distinct())


# --- aggregates --------------------------------------------------------------


@register("a1_count_by_key", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def a1(spark, sf):
    return load(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"))


@register("a2_count_distinct", "SELECT l_returnflag, count(DISTINCT l_suppkey) AS suppliers, count(DISTINCT l_partkey) AS parts, max(l_shipdate) AS last FROM lineitem GROUP BY l_returnflag")
def a2(spark, sf):
    return load(spark, sf, "lineitem").groupBy("l_returnflag").agg(F.count_distinct("l_suppkey").alias("suppliers"), F.count_distinct("l_partkey").alias("parts"), F.max("l_shipdate").alias("last"))


@register("a3_count_filter", "SELECT o_orderstatus, count(*) FILTER (WHERE o_totalprice > 250000) AS big, count(*) FILTER (WHERE o_orderpriority LIKE '1%') AS urgent FROM orders GROUP BY o_orderstatus")
def a3(spark, sf):
    return load(spark, sf, "orders").groupBy("o_orderstatus").agg(F.count_if(F.col("o_totalprice") > 250000).alias("big"), F.count_if(F.col("o_orderpriority").like("1%")).alias("urgent"))


@register("a4_avg_sum_array_filter", "SELECT c_mktsegment, round(avg(c_acctbal) FILTER (WHERE c_acctbal > 0), 6) AS mean, round(sum(c_acctbal) FILTER (WHERE c_acctbal < 0), 4) AS debt, array_to_string(list_sort(array_agg(DISTINCT c_nationkey) FILTER (WHERE c_acctbal < 0)), ',') AS nations FROM customer GROUP BY c_mktsegment")
def a4(spark, sf):
    neg, pos = F.col("c_acctbal") < 0, F.col("c_acctbal") > 0
    return load(spark, sf, "customer").groupBy("c_mktsegment").agg(r(F.avg(F.when(pos, F.col("c_acctbal")))).alias("mean"), r(F.sum(F.when(neg, F.col("c_acctbal"))), 4).alias("debt"), F.array_join(F.sort_array(F.collect_set(F.when(neg, F.col("c_nationkey")))).cast("array<string>"), ",").alias("nations"))


@register("a5_percentile_cont", "SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95, round(quantile_cont(value, 0.99), 6) AS p99 FROM events GROUP BY event_type")
def a5(spark, sf):
    g = quantiles.grouped(load(spark, sf, "events"), ["event_type"], "value", (0.5, 0.95, 0.99))
    return g.select("event_type", *[r(c).alias(c) for c in ("p50", "p95", "p99")])


@register("a5b_approx_percentile")
def a5b(spark, sf):
    """The fast path for percentiles over large groups: a mergeable summary."""
    return load(spark, sf, "events").groupBy("event_type").agg(F.percentile_approx("value", [0.5, 0.95, 0.99], 10_000).alias("p"))


@register("a6_min_max_avg_sum", "SELECT l_linestatus, min(l_quantity) AS lo, max(l_quantity) AS hi, round(avg(l_extendedprice), 4) AS mean, round(sum(l_quantity), 2) AS total FROM lineitem GROUP BY l_linestatus")
def a6(spark, sf):
    return load(spark, sf, "lineitem").groupBy("l_linestatus").agg(F.min("l_quantity").alias("lo"), F.max("l_quantity").alias("hi"), r(F.avg("l_extendedprice"), 4).alias("mean"), r(F.sum("l_quantity"), 2).alias("total"))


@register("a7_having", "SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey HAVING count(*) > 1")
def a7(spark, sf):
    return load(spark, sf, "orders").groupBy("o_custkey").agg(F.count("*").alias("n")).where("n > 1")


@register("a8_guarded_ratio", "SELECT user_id, round(100.0 * count(*) FILTER (WHERE event_type = 'error') / nullif(count(*) FILTER (WHERE event_type <> 'click'), 0), 6) AS pct FROM events GROUP BY user_id")
def a8(spark, sf):
    return load(spark, sf, "events").groupBy("user_id").agg(r(F.try_divide(F.lit(100.0) * F.count_if(F.col("event_type") == "error"), F.count_if(F.col("event_type") != "click"))).alias("pct"))


@register("a9_many_counts", "SELECT (SELECT count(*) FROM documents) AS total, (SELECT count(*) FROM documents WHERE lang = 'en') AS en, (SELECT count(*) FROM documents WHERE lang = 'de') AS de, (SELECT count(*) FROM documents WHERE n_chars > 1000) AS long_ones, (SELECT count(*) FROM documents WHERE source = 'src0') AS src0, (SELECT count(*) FROM documents WHERE text IS NULL) AS no_text, (SELECT count(*) FROM documents WHERE text LIKE '%secret%') AS secret")
def a9(spark, sf):
    c = F.count_if
    return load(spark, sf, "documents").agg(F.count("*").alias("total"), c(F.col("lang") == "en").alias("en"), c(F.col("lang") == "de").alias("de"), c(F.col("n_chars") > 1000).alias("long_ones"), c(F.col("source") == "src0").alias("src0"), c(F.col("text").isNull()).alias("no_text"), c(F.col("text").contains("secret")).alias("secret"))


@register("a10_distinct", "SELECT DISTINCT p_brand, p_type FROM part")
def a10(spark, sf):
    return load(spark, sf, "part").select("p_brand", "p_type").distinct()


@register("a11_avg_json_number", "SELECT event_type, round(avg(CASE WHEN regexp_matches(json_extract_string(props, '$.k'), '^[0-9]+\\.?[0-9]*$') THEN CAST(json_extract_string(props, '$.k') AS DOUBLE) END), 6) AS mean FROM events GROUP BY event_type")
def a11(spark, sf):
    k = F.get_json_object("props", "$.k")
    return load(spark, sf, "events").groupBy("event_type").agg(r(F.avg(F.when(k.rlike(r"^[0-9]+\.?[0-9]*$"), k.try_cast("double")))).alias("mean"))


@register("a12_count_distinct_case", "SELECT l_returnflag, count(DISTINCT CASE WHEN l_linestatus = 'O' THEN l_suppkey END) AS o_supp, count(DISTINCT CASE WHEN l_linestatus = 'F' THEN l_suppkey END) AS f_supp FROM lineitem GROUP BY l_returnflag")
def a12(spark, sf):
    only = lambda s: F.count_distinct(F.when(F.col("l_linestatus") == s, F.col("l_suppkey")))
    return load(spark, sf, "lineitem").groupBy("l_returnflag").agg(only("O").alias("o_supp"), only("F").alias("f_supp"))


@register("a13_ordered_json", "SELECT user_id, string_agg(event_id || ':' || event_type, ',' ORDER BY ts DESC, event_id DESC) AS events FROM events GROUP BY user_id")
def a13(spark, sf):
    e = F.sort_array(F.collect_list(F.struct("ts", "event_id", "event_type")), asc=False)
    return load(spark, sf, "events").groupBy("user_id").agg(e.alias("e")).select("user_id", F.array_join(F.transform("e", lambda x: F.concat(x["event_id"].cast("string"), F.lit(":"), x["event_type"])), ",").alias("events"))


@register("a14_weighted_mean", "WITH g AS (SELECT user_id, event_type, avg(value) AS m, count(*) AS n FROM events GROUP BY user_id, event_type) SELECT event_type, round(sum(m * n) / sum(n), 6) AS mean FROM g GROUP BY event_type")
def a14(spark, sf):
    g = load(spark, sf, "events").groupBy("user_id", "event_type").agg(F.avg("value").alias("m"), F.count("*").alias("n"))
    return g.groupBy("event_type").agg(r(F.sum(F.col("m") * F.col("n")) / F.sum("n")).alias("mean"))


@register("a15_max_per_key", "SELECT o_custkey, max(o_orderdate) AS last FROM orders GROUP BY o_custkey")
def a15(spark, sf):
    return load(spark, sf, "orders").groupBy("o_custkey").agg(F.max("o_orderdate").alias("last"))


@register("a16_latest_version", "SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def a16(spark, sf):
    # max_by combines before the shuffle, a window would not
    best = F.max_by(F.struct("o_orderkey", "o_totalprice"), F.struct("o_orderdate", "o_orderkey")).alias("v")
    return load(spark, sf, "orders").groupBy("o_custkey").agg(best).select("o_custkey", "v.*")


# --- windows -----------------------------------------------------------------


@register("w1_percent_of_total", "SELECT date_trunc('month', o_orderdate) AS month, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS pct FROM orders GROUP BY 1")
def w1(spark, sf):
    m = load(spark, sf, "orders").groupBy(F.date_trunc("month", "o_orderdate").cast("timestamp_ntz").alias("month")).agg(F.count("*").alias("n"))
    return m.select("month", "n", r(F.lit(100.0) * F.col("n") / F.sum("n").over(Window.partitionBy())).alias("pct"))


@register("w2_rank", "SELECT c_mktsegment, c_custkey, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey) AS rank FROM customer QUALIFY rank <= 20")
def w2(spark, sf):
    w = Window.partitionBy("c_mktsegment").orderBy(F.col("c_acctbal").desc(), "c_custkey")
    return load(spark, sf, "customer").withColumn("rank", F.row_number().over(w).cast("long")).where("rank <= 20").select("c_mktsegment", "c_custkey", "rank")


@register("w3_rerank_after_filter", "WITH a AS (SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY vec_id DESC) AS first FROM embeddings) SELECT vec_id, label, row_number() OVER (PARTITION BY label ORDER BY first) AS rank FROM a WHERE vec_id % 3 = 1")
def w3(spark, sf):
    first = F.row_number().over(Window.partitionBy("label").orderBy(F.col("vec_id").desc()))
    a = load(spark, sf, "embeddings").select("vec_id", "label", first.alias("first")).where("vec_id % 3 = 1")
    return a.select("vec_id", "label", F.row_number().over(Window.partitionBy("label").orderBy("first")).cast("long").alias("rank"))


@register("w4_distinct_on", "SELECT DISTINCT ON (p_brand) p_brand, p_partkey, p_name FROM part ORDER BY p_brand, p_partkey")
def w4(spark, sf):
    return load(spark, sf, "part").groupBy("p_brand").agg(F.min_by(F.struct("p_partkey", "p_name"), "p_partkey").alias("v")).select("p_brand", "v.*")


@register("w5_last_n", "SELECT event_id, round(avg(value) OVER w, 6) AS mean, max(value) OVER w AS top FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)")
def w5(spark, sf):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-9, 0)
    return load(spark, sf, "events").select("event_id", r(F.avg("value").over(w)).alias("mean"), F.max("value").over(w).alias("top"))


# --- order, limit, sets ------------------------------------------------------


@register("o1_pagination", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10 OFFSET 10")
def o1(spark, sf):
    return load(spark, sf, "orders").select("o_orderkey", "o_totalprice").orderBy(F.col("o_totalprice").desc(), "o_orderkey").offset(10).limit(10)


@register("o2_multi_key_sort", "SELECT p_partkey, p_name FROM part ORDER BY length(p_name), p_name, p_partkey LIMIT 50")
def o2(spark, sf):
    return load(spark, sf, "part").select("p_partkey", "p_name").orderBy(F.length("p_name"), "p_name", "p_partkey").limit(50)


@register("o3_pool_then_rest", "WITH s AS (SELECT p_partkey, p_size, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS pos FROM part QUALIFY pos <= 60) SELECT p_partkey, row_number() OVER (ORDER BY pos > 30, CASE WHEN pos <= 30 THEN -p_size ELSE 0 END, pos) AS rank FROM s")
def o3(spark, sf):
    # the pool is cut before anything is numbered, so that one task numbers 60 rows
    pool = load(spark, sf, "part").orderBy(F.col("p_retailprice").desc(), "p_partkey").limit(60)
    s = pool.withColumn("pos", F.row_number().over(Window.orderBy(F.col("p_retailprice").desc(), "p_partkey")))
    order = Window.orderBy(F.col("pos") > 30, F.when(F.col("pos") <= 30, -F.col("p_size")).otherwise(0), "pos")
    return s.select("p_partkey", F.row_number().over(order).cast("long").alias("rank"))


@register("o4_union", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def o4(spark, sf):
    return load(spark, sf, "customer").select(F.col("c_nationkey").alias("k")).union(load(spark, sf, "supplier").select("s_nationkey")).distinct()


@register("o5_union_all", "SELECT 'customer' AS what, count(*) AS n FROM customer UNION ALL SELECT 'supplier', count(*) FROM supplier UNION ALL SELECT 'part', count(*) FROM part")
def o5(spark, sf):
    one = lambda t: load(spark, sf, t).agg(F.count("*").alias("n")).select(F.lit(t).alias("what"), "n")
    return one("customer").unionByName(one("supplier")).unionByName(one("part"))


@register("o6_array_sets", "SELECT p_partkey, len(list_intersect(a, b)) AS both, len(list_distinct(list_concat(a, b))) AS either FROM (SELECT p_partkey, list_distinct(string_split(p_name, ' ')) AS a, ['red', 'ring', 'small'] AS b FROM part)")
def o6(spark, sf):
    a, b = F.array_distinct(F.split("p_name", " ")), F.array(F.lit("red"), F.lit("ring"), F.lit("small"))
    return load(spark, sf, "part").select("p_partkey", F.size(F.array_intersect(a, b)).cast("long").alias("both"), F.size(F.array_union(a, b)).cast("long").alias("either"))


# --- views -------------------------------------------------------------------


@register("v1_partition_readiness", "WITH c AS (SELECT count(*) AS n, min(ts) AS first, max(ts) AS last FROM events), t AS (SELECT 500000 AS need) SELECT n, need, round(100.0 * n / need, 4) AS progress, date_diff('day', first, last) AS age_days, CASE WHEN n >= need THEN 'partition now' WHEN n >= need / 2 THEN 'plan' ELSE 'wait' END AS advice FROM c CROSS JOIN t")
def v1(spark, sf):
    c = load(spark, sf, "events").agg(F.count("*").alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"))
    t = spark.range(1).select(F.lit(500000).alias("need"))
    advice = F.when(F.col("n") >= F.col("need"), "partition now").when(F.col("n") >= F.col("need") / 2, "plan").otherwise("wait")
    return c.crossJoin(t).select("n", "need", r(F.lit(100.0) * F.col("n") / F.col("need"), 4).alias("progress"), F.datediff("last", "first").cast("long").alias("age_days"), advice.alias("advice"))


@register("v2_partition_preview", "SELECT date_trunc('month', o_orderdate) AS month, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS pct, CASE WHEN count(*) < 100 THEN 'small' WHEN count(*) < 1000 THEN 'good' ELSE 'large' END AS quality FROM orders GROUP BY 1")
def v2(spark, sf):
    q = F.when(F.col("n") < 100, "small").when(F.col("n") < 1000, "good").otherwise("large")
    return w1(spark, sf).withColumn("quality", q)


@register("v3_index_preview", "SELECT count(DISTINCT date_trunc('month', o_orderdate)) AS months, CAST(ceil(count(*) / 1000.0) AS BIGINT) AS partitions, round(count(*) * 1.0 / count(DISTINCT date_trunc('month', o_orderdate)), 6) AS per_month FROM orders")
def v3(spark, sf):
    m = load(spark, sf, "orders").groupBy(F.date_trunc("month", "o_orderdate").alias("m")).agg(F.count("*").alias("n"))
    return m.agg(F.count("*").alias("months"), F.ceil(F.sum("n") / 1000).cast("long").alias("partitions"), r(F.sum("n") / F.count("*")).alias("per_month"))


_NOW = "(SELECT max(ts) FROM events)"


@register("v4_error_summary", f"SELECT event_type, count(*) AS n, min(ts) AS first, max(ts) AS last FROM events WHERE event_type IN ('error', 'click') AND ts > {_NOW} - INTERVAL 24 HOUR GROUP BY event_type")
def v4(spark, sf):
    e = load(spark, sf, "events")
    now = e.agg(F.max("ts").alias("now"))
    x = e.where(F.col("event_type").isin("error", "click")).crossJoin(F.broadcast(now)).where("ts > now - INTERVAL 24 HOURS")
    return x.groupBy("event_type").agg(F.count("*").alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"))


@register("v4b_error_rate_hourly", "SELECT date_trunc('hour', ts) AS hour, count(*) AS n FROM events WHERE event_type = 'error' GROUP BY 1")
def v4b(spark, sf):
    return load(spark, sf, "events").where("event_type = 'error'").groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")).agg(F.count("*").alias("n"))


@register("v5_recent_sessions", "SELECT user_id, min(ts) AS first, max(ts) AS last, count(*) AS n FROM events GROUP BY user_id")
def v5(spark, sf):
    return load(spark, sf, "events").groupBy("user_id").agg(F.min("ts").alias("first"), F.max("ts").alias("last"), F.count("*").alias("n"))


@register("v6_summarize_session", "SELECT string_agg(event_id || '=' || round(value, 2), ';' ORDER BY ts DESC, event_id DESC) AS summary FROM (SELECT * FROM events WHERE user_id = 8 ORDER BY ts DESC, event_id DESC LIMIT 20)")
def v6(spark, sf):
    last = load(spark, sf, "events").where("user_id = 8").orderBy(F.col("ts").desc(), F.col("event_id").desc()).limit(20)
    e = F.sort_array(F.collect_list(F.struct("ts", "event_id", "value")), asc=False)
    return last.agg(e.alias("e")).select(F.array_join(F.transform("e", lambda x: F.concat(x["event_id"].cast("string"), F.lit("="), F.round(x["value"], 2).cast("string"))), ";").alias("summary"))


@register("v7_forget_session", "SELECT count(*) FILTER (WHERE user_id = 8) AS deleted, count(*) FILTER (WHERE user_id <> 8) AS kept FROM events")
def v7(spark, sf):
    gone = F.col("user_id") == 8
    return load(spark, sf, "events").agg(F.count_if(gone).alias("deleted"), F.count_if(~gone).alias("kept"))
