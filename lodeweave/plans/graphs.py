"""Graph queries: suppliers lead to parts, parts back to suppliers."""
from __future__ import annotations


from pyspark.sql import functions as F

from ..catalog import register
from ..operators import graph as G
from ..operators import quantiles
from ..sources.tables import EDGES_SQL, MEMORIES_SQL, NODES_SQL, edges, links, load, memories, nodes

E = f"WITH RECURSIVE {EDGES_SQL}"


def one(spark, n):
    return spark.createDataFrame([(n,)], "node long")


def node_ids(spark, sf):
    return nodes(spark, sf).select(F.col("node_id").alias("node"))


@register("g1_traverse", f"{E}, {NODES_SQL}, t(node, depth) AS (SELECT 3::BIGINT, 0 UNION SELECT dst, depth + 1 FROM t JOIN edges ON src = node WHERE depth < 2) SELECT node, node_type, label, min(depth) AS depth FROM t JOIN nodes ON node = node_id WHERE node <> 3 GROUP BY ALL")
def g1(spark, sf):
    found = G.traverse(links(spark, sf), one(spark, 3), 2)
    return found.join(nodes(spark, sf), F.col("node") == F.col("node_id")).select("node", "node_type", "label", "depth")


@register("g1b_traverse_inbound", f"{E}, t(node, depth) AS (SELECT 5::BIGINT, 0 UNION SELECT src, depth + 1 FROM t JOIN edges ON dst = node WHERE depth < 2 AND relation = 'returns') SELECT node, min(depth) AS depth FROM t WHERE node <> 5 GROUP BY node")
def g1b(spark, sf):
    return G.traverse(links(spark, sf), one(spark, 5), 2, "inbound", "returns").select("node", "depth")


@register("g2_shortest_path", f"{E}, p AS (SELECT min([9, a.dst, b.dst, c.dst]) AS path FROM edges a JOIN edges b ON b.src = a.dst JOIN edges c ON c.src = b.dst WHERE a.src = 9 AND b.dst <> 9 AND c.dst = (SELECT min(dst) FROM edges WHERE src = 3 AND dst NOT IN (SELECT dst FROM edges WHERE src = 9))) SELECT array_to_string(path, '>') AS path, 3 AS length FROM p WHERE path IS NOT NULL")
def g2(spark, sf):
    e = edges(spark, sf)
    mine = e.where("src = 9").select("dst")
    target = e.where("src = 3").select("dst").join(mine, "dst", "left_anti").agg(F.min("dst")).first()[0]
    found = G.shortest_path(e, 9, -1 if target is None else target, 4)
    return found.select(F.array_join(F.col("path").cast("array<string>"), ">").alias("path"), "length")


@register("g3_expand", f"{E}, u AS (SELECT src, dst FROM edges UNION ALL SELECT dst, src FROM edges), t(node, depth) AS (SELECT 4::BIGINT, 0 UNION ALL SELECT u.dst, depth + 1 FROM t JOIN u ON u.src = node WHERE depth < 2) SELECT node, depth, count(*) AS n FROM t GROUP BY node, depth")
def g3(spark, sf):
    return G.walks(edges(spark, sf), 4, 2)


@register("g4_undirected_path", f"{E}, u AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges) SELECT array_to_string(min([1, a.dst, 2]), '>') AS path FROM u a JOIN u b ON b.src = a.dst WHERE a.src = 1 AND b.dst = 2 HAVING count(*) > 0")
def g4(spark, sf):
    return G.shortest_path(links(spark, sf), 1, 2, 3, "both").select(F.array_join(F.col("path").cast("array<string>"), ">").alias("path"))


@register("g5_incident_endpoints", f"{E} SELECT src AS node, relation, count(*) AS n FROM edges WHERE src < 5 GROUP BY ALL UNION ALL SELECT dst, relation, count(*) FROM edges WHERE dst < 5 AND src >= 5 GROUP BY ALL")
def g5(spark, sf):
    e = edges(spark, sf)
    ends = e.where("src < 5").select(F.col("src").alias("node"), "relation").unionByName(e.where("dst < 5 AND src >= 5").select(F.col("dst").alias("node"), "relation"))
    return ends.groupBy("node", "relation").agg(F.count("*").alias("n"))


def _rank_sql(iterations: int = 10) -> str:
    steps = [f"{E}, {NODES_SQL}, n AS (SELECT count(*) AS n FROM nodes), deg AS (SELECT src, count(*) AS degree FROM edges GROUP BY src), links AS (SELECT DISTINCT e.src, e.dst, degree FROM edges e JOIN deg USING (src)), r0 AS (SELECT node_id AS node, 1.0::DOUBLE / n AS rank FROM nodes, n)"]
    for i in range(1, iterations + 1):
        steps.append(f"r{i} AS MATERIALIZED (SELECT node_id AS node, 0.15::DOUBLE / n.n + 0.85 * coalesce(got, 0) AS rank FROM nodes CROSS JOIN n LEFT JOIN (SELECT dst, sum(rank / degree) AS got FROM links JOIN r{i - 1} ON node = src GROUP BY dst) ON dst = node_id)")
    return ", ".join(steps)


@register("g6_pagerank", f"{_rank_sql()} SELECT node, round(rank / (SELECT sum(rank) FROM r10), 9) AS rank FROM r10")
def g6(spark, sf):
    return G.pagerank(node_ids(spark, sf), edges(spark, sf), iterations=10, tolerance=0.0).select("node", F.round("rank", 9).alias("rank"))


#: Rounds that the SQL spells out, the most that the loop makes.
_ROUNDS = 100
_SETTLED = f"""{_rank_sql(_ROUNDS)}, change AS ({" UNION ALL ".join(f"SELECT {i} AS i, sum(abs(x.rank - y.rank)) AS c FROM r{i} x JOIN r{i - 1} y USING (node)" for i in range(1, _ROUNDS + 1))}),
settled AS (SELECT coalesce(min(i), {_ROUNDS}) AS i FROM change WHERE c < 1e-6), last AS ({" UNION ALL ".join(f"SELECT node, rank FROM r{i} WHERE {i} = (SELECT i FROM settled)" for i in range(1, _ROUNDS + 1))}), k AS (SELECT node, rank / (SELECT sum(rank) FROM last) AS rank FROM last)"""


@register("g6b_pagerank_settled", f"{_SETTLED} SELECT node, round(rank, 9) AS rank FROM k")
def g6b(spark, sf):
    """Ranks of the round in which they have settled, the rule by which the loop ends."""
    return G.pagerank(node_ids(spark, sf), edges(spark, sf)).select("node", F.round("rank", 9).alias("rank"))


@register("g7_coupling", f"{E}, {NODES_SQL} SELECT node_id AS node, coalesce(a, 0) AS afferent, coalesce(e, 0) AS efferent, round(coalesce(coalesce(e, 0) * 1.0 / nullif(coalesce(a, 0) + coalesce(e, 0), 0), 0.0), 8) AS instability FROM nodes LEFT JOIN (SELECT dst, count(DISTINCT src) AS a FROM edges GROUP BY dst) ON dst = node_id LEFT JOIN (SELECT src, count(DISTINCT dst) AS e FROM edges GROUP BY src) ON src = node_id")
def g7(spark, sf):
    return G.coupling(node_ids(spark, sf), edges(spark, sf)).withColumn("instability", F.round("instability", 8))


@register("g8_edge_importance", f"{_SETTLED} SELECT src, dst, round((coalesce(a.rank, 0) + coalesce(b.rank, 0)) / 2, 9) AS importance FROM edges LEFT JOIN k a ON a.node = src LEFT JOIN k b ON b.node = dst WHERE relation = 'returns'")
def g8(spark, sf):
    e = edges(spark, sf)
    k = G.pagerank(node_ids(spark, sf), e)
    x = e.where("relation = 'returns'").join(k.select(F.col("node").alias("src"), F.col("rank").alias("a")), "src", "left").join(k.select(F.col("node").alias("dst"), F.col("rank").alias("b")), "dst", "left")
    return x.select("src", "dst", F.round((F.coalesce("a", F.lit(0.0)) + F.coalesce("b", F.lit(0.0))) / 2, 9).alias("importance"))


@register("g9_hubs", f"{E} SELECT node, count(*) AS total FROM (SELECT src AS node FROM edges UNION ALL SELECT dst FROM edges) GROUP BY node ORDER BY total DESC, node LIMIT 10")
def g9(spark, sf):
    return G.degrees(edges(spark, sf)).orderBy(F.col("total").desc(), "node").limit(10).select("node", "total")


@register("g10_graph_stats", f"{E}, {NODES_SQL} SELECT 'node' AS what, node_type AS kind, count(*) AS n FROM nodes GROUP BY node_type UNION ALL SELECT 'edge', relation, count(*) FROM edges GROUP BY relation")
def g10(spark, sf):
    n = nodes(spark, sf).groupBy(F.col("node_type").alias("kind")).agg(F.count("*").alias("n")).select(F.lit("node").alias("what"), "kind", "n")
    return n.unionByName(edges(spark, sf).groupBy(F.col("relation").alias("kind")).agg(F.count("*").alias("n")).select(F.lit("edge").alias("what"), "kind", "n"))


_TOP = "top AS (SELECT node_id AS node FROM nodes ORDER BY node_id DESC LIMIT 500), small AS (SELECT node FROM top UNION ALL SELECT s_suppkey FROM supplier)"


@register("g11_induced_subgraph", f"{E}, {NODES_SQL}, {_TOP} SELECT src, dst, relation FROM edges WHERE src IN (SELECT node FROM small) AND dst IN (SELECT node FROM small)")
def g11(spark, sf):
    n = node_ids(spark, sf)
    some = n.orderBy(F.col("node").desc()).limit(500).unionByName(n.where("node < 1000000"))
    return G.induced(edges(spark, sf), some)


@register("g12_module_data", f"{E} SELECT relation, count(*) AS n, count(DISTINCT CASE WHEN src >= 1000000 THEN src END) AS part_ends, count(DISTINCT CASE WHEN dst >= 1000000 THEN dst END) AS supplied FROM edges GROUP BY relation")
def g12(spark, sf):
    return edges(spark, sf).groupBy("relation").agg(F.count("*").alias("n"), F.count_distinct(F.when(F.col("src") >= 1000000, F.col("src"))).alias("part_ends"), F.count_distinct(F.when(F.col("dst") >= 1000000, F.col("dst"))).alias("supplied"))


@register("g13_coverage", f"{E}, {NODES_SQL} SELECT node_type, round(count(*) FILTER (WHERE EXISTS (SELECT 1 FROM edges WHERE dst = node_id)) * 1.0 / count(*), 8) AS coverage, CASE WHEN count(*) FILTER (WHERE EXISTS (SELECT 1 FROM edges WHERE dst = node_id)) * 1.0 / count(*) < 0.5 THEN 'poor_coverage' ELSE 'healthy' END AS status FROM nodes GROUP BY node_type")
def g13(spark, sf):
    ends = edges(spark, sf).select(F.col("dst").alias("node_id")).distinct().withColumn("seen", F.lit(1))
    x = nodes(spark, sf).join(ends, "node_id", "left").groupBy("node_type").agg((F.count("seen") / F.count("*")).alias("c"))
    return x.select("node_type", F.round("c", 8).alias("coverage"), F.when(F.col("c") < 0.5, "poor_coverage").otherwise("healthy").alias("status"))


@register("g20_resolution_accuracy", f"{E}, {NODES_SQL} SELECT count(*) AS calls, round(100.0 * count(node_id) / count(*), 6) AS accuracy FROM edges LEFT JOIN nodes ON dst = node_id WHERE relation = 'returns'")
def g20(spark, sf):
    x = edges(spark, sf).where("relation = 'returns'").join(nodes(spark, sf).select("node_id"), F.col("dst") == F.col("node_id"), "left")
    return x.agg(F.count("*").alias("calls"), F.round(F.coalesce(F.try_divide(F.lit(100.0) * F.count("node_id"), F.count("*")), F.lit(100.0)), 6).alias("accuracy"))


#: Percent of the parts that a zoomed-out view starts from, the default of the view.
ZOOM = 30
_IMPORTANCE = "CASE WHEN p_brand = 'Brand#1' THEN 1.0 ELSE least(p_size / 100.0, 1.0) * 0.4 + least(p_retailprice / 500.0, 1.0) * 0.3 + least(length(p_name) / 100.0, 1.0) * 0.3 END"


@register("g21_zoom_scores", f"SELECT p_partkey, round({_IMPORTANCE}, 8)::DOUBLE AS score FROM part ORDER BY round({_IMPORTANCE}, 8) DESC, p_partkey LIMIT (SELECT CAST(ceil(count(*) * {ZOOM} / 100.0) AS BIGINT) FROM part)")
def g21(spark, sf):
    """The best ZOOM percent of the parts."""
    kind = F.when(F.col("p_brand") == "Brand#1", "Module").otherwise("Function")
    score = F.round(G.importance(F.col("p_size"), F.col("p_retailprice"), F.length("p_name"), kind), 8)
    parts = load(spark, sf, "part")
    return quantiles.best(parts.select("p_partkey", score.alias("score")), "score", "p_partkey", ZOOM).orderBy(F.col("score").desc(), "p_partkey")


@register("g21b_zoom_ancestors", f"{E}, par AS (SELECT dst AS node, max(src) AS parent FROM edges GROUP BY dst), best AS (SELECT p_partkey FROM part ORDER BY round({_IMPORTANCE}, 8) DESC, p_partkey LIMIT (SELECT CAST(ceil(count(*) * {ZOOM} / 100.0) AS BIGINT) FROM part)), t(node) AS (SELECT 1000000::BIGINT + p_partkey FROM best UNION SELECT parent FROM t JOIN par USING (node)) SELECT node FROM t")
def g21b(spark, sf):
    chosen = g21(spark, sf).select((F.lit(1000000) + F.col("p_partkey")).alias("node"))
    return G.with_ancestors(chosen, edges(spark, sf))


@register("g22_callers_page", f"{E}, {NODES_SQL}, t(node, depth) AS (SELECT 3::BIGINT, 0 UNION SELECT src, depth + 1 FROM t JOIN edges ON dst = node WHERE depth < 3), d AS (SELECT node, min(depth) AS depth FROM t WHERE node <> 3 GROUP BY node) SELECT node, label, depth FROM d JOIN nodes ON node_id = node ORDER BY label, node LIMIT 5 OFFSET 5")
def g22(spark, sf):
    x = G.traverse(links(spark, sf), one(spark, 3), 3, "inbound").join(nodes(spark, sf), F.col("node") == F.col("node_id"))
    return x.select("node", "label", "depth").orderBy("label", "node").offset(5).limit(5)


@register("g22b_callees_page", f"{E}, {NODES_SQL}, start AS (SELECT min(node_id) AS id FROM nodes WHERE label = (SELECT label FROM nodes WHERE node_id = 3)), t(node, depth) AS (SELECT id, 0 FROM start UNION SELECT dst, depth + 1 FROM t JOIN edges ON src = node WHERE depth < 3), d AS (SELECT node, min(depth) AS depth FROM t WHERE node <> (SELECT id FROM start) GROUP BY node) SELECT node, label, depth FROM d JOIN nodes ON node_id = node ORDER BY label, node LIMIT 20 OFFSET 10")
def g22b(spark, sf):
    n = nodes(spark, sf)
    label = n.where("node_id = 3").select("label").first()["label"]
    return G.calling(links(spark, sf), n, label, "outbound", 3, limit=20, offset=10)


@register("g22c_node_detail", f"{E}, {NODES_SQL}, ends AS (SELECT DISTINCT 'caller' AS role, src AS node FROM edges WHERE dst = 4 AND src <> 4 UNION SELECT DISTINCT 'callee', dst FROM edges WHERE src = 4 AND dst <> 4) SELECT 'self' AS role, node_id AS node, node_type, label FROM nodes WHERE node_id = 4 UNION ALL SELECT role, node, node_type, label FROM ends JOIN nodes ON node_id = node")
def g22c(spark, sf):
    return G.node_detail(links(spark, sf), nodes(spark, sf), 4)


@register("g23_memory_graph", f"WITH {MEMORIES_SQL}, rel AS (SELECT id AS a, id + 1 + id % 3 AS b, (id % 10) / 10.0 AS score FROM memories), kept AS (SELECT a, b FROM rel JOIN memories x ON x.id = a JOIN memories y ON y.id = b WHERE score >= 0.3 AND x.deleted_at IS NULL AND y.deleted_at IS NULL) SELECT node, count(*) AS degree FROM (SELECT a AS node FROM kept UNION ALL SELECT b FROM kept) GROUP BY node")
def g23(spark, sf):
    m = memories(spark, sf)
    live = m.where("deleted_at IS NULL").select("id")
    rel = m.select(F.col("id").alias("a"), (F.col("id") + 1 + F.col("id") % 3).alias("b"), ((F.col("id") % 10) / 10.0).alias("score")).where("score >= 0.3")
    kept = rel.join(live.select(F.col("id").alias("a")), "a", "left_semi").join(live.select(F.col("id").alias("b")), "b", "left_semi")
    return kept.select(F.col("a").alias("node")).unionByName(kept.select(F.col("b").alias("node"))).groupBy("node").agg(F.count("*").alias("degree"))


_REL = "rel AS (SELECT id AS src, id + 1 + id % 3 AS dst, (id % 10) / 10.0 AS score FROM memories UNION ALL SELECT id, id + 2 + id % 5, (id * 7 % 10) / 10.0 FROM memories)"


@register("g24_related", f"""WITH RECURSIVE {MEMORIES_SQL}, {_REL}, best AS (SELECT src, dst, max(score) AS score FROM rel WHERE score >= 0.3 GROUP BY src, dst),
t(node, depth, turns, path) AS (SELECT 13::BIGINT, 0, []::STRUCT(cost DOUBLE, node BIGINT)[], []::BIGINT[] UNION ALL SELECT dst, depth + 1, list_append(turns, {{'cost': (-score)::DOUBLE, 'node': dst}}), list_append(path, node) FROM t JOIN best ON src = node WHERE depth < 4),
first AS (SELECT node, arg_min({{'depth': depth, 'path': path}}, {{'depth': depth, 'turns': turns}}) AS v FROM t WHERE node <> 13 GROUP BY node) SELECT node, v.depth AS depth, array_to_string(v.path, '>') AS path FROM first""")
def g24(spark, sf):
    m = memories(spark, sf)
    i = F.col("id")
    rel = m.select(i.alias("src"), (i + 1 + i % 3).alias("dst"), ((i % 10) / 10.0).alias("score")).unionByName(m.select(i.alias("src"), (i + 2 + i % 5).alias("dst"), ((i * 7 % 10) / 10.0).alias("score")))
    return G.related(rel, 13, 4, 0.3).select("node", "depth", F.array_join(F.col("path").cast("array<string>"), ">").alias("path"))


@register("g25_matrix", f"{E}, c AS (SELECT DISTINCT src, dst FROM edges) SELECT (SELECT count(*) FROM c) AS dependencies, (SELECT count(*) / 2.0 FROM c x JOIN c y ON x.src = y.dst AND x.dst = y.src)::DOUBLE AS circular")
def g25(spark, sf):
    return G.matrix_summary(edges(spark, sf))


@register("g26_tree_stats", f"{E}, roots AS (SELECT src AS root FROM edges GROUP BY src ORDER BY count(*) DESC, src LIMIT 1), t(node, depth) AS (SELECT root, 0 FROM roots UNION SELECT dst, depth + 1 FROM t JOIN edges ON src = node WHERE depth < 2), d AS (SELECT node, min(depth) AS depth FROM t GROUP BY node) SELECT depth, count(*) AS n FROM d GROUP BY depth")
def g26(spark, sf):
    e = edges(spark, sf)
    root = e.groupBy("src").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "src").limit(1).select(F.col("src").alias("node"))
    found = G.traverse(e, root, 2).select("node", "depth").unionByName(root.select("node", F.lit(0).alias("depth")))
    return found.groupBy("depth").agg(F.count("*").alias("n"))


@register("g26b_parent_by_depth", f"{E}, d AS (SELECT dst AS node, min(src) AS parent, count(*) AS incoming FROM edges GROUP BY dst) SELECT node, parent, incoming FROM d")
def g26b(spark, sf):
    """The tree parent of a node: the smallest of its parents."""
    return edges(spark, sf).groupBy(F.col("dst").alias("node")).agg(F.min("src").alias("parent"), F.count("*").alias("incoming"))


@register("g10b_repository_metrics", f"""{_SETTLED}, c AS (SELECT node_id AS node, coalesce(a, 0) + coalesce(e, 0) AS coupling FROM nodes LEFT JOIN (SELECT dst, count(DISTINCT src) AS a FROM edges GROUP BY dst) ON dst = node_id LEFT JOIN (SELECT src, count(DISTINCT dst) AS e FROM edges GROUP BY src) ON src = node_id),
m AS (SELECT p_name || '#' || p_partkey AS name, p_size AS complexity, coupling, rank FROM part JOIN k ON k.node = 1000000 + p_partkey JOIN c ON c.node = 1000000 + p_partkey)
SELECT count(*) AS total_functions, round(avg(complexity), 2) AS avg_complexity, max(complexity) AS max_complexity, arg_min(name, (-complexity, name)) AS most_complex, round(avg(coupling), 2) AS avg_coupling, (SELECT string_agg(name, ',' ORDER BY pos) FROM (SELECT name, row_number() OVER (ORDER BY round(rank, 12) DESC, name) AS pos FROM m) WHERE pos <= 10) AS top_pagerank FROM m""")
def g10b(spark, sf):
    """Parts as functions: their size is the complexity."""
    e, ids = edges(spark, sf), node_ids(spark, sf)
    c = G.coupling(ids, e).select("node", (F.col("afferent") + F.col("efferent")).alias("coupling"))
    k = G.pagerank(ids, e)
    p = load(spark, sf, "part").select((F.lit(1000000) + F.col("p_partkey")).alias("node"), F.concat("p_name", F.lit("#"), F.col("p_partkey").cast("string")).alias("name"), F.col("p_size").alias("complexity"))
    return G.repository_metrics(p.join(c, "node").join(k, "node"))


@register("g25b_matrix_nodes", f"{E}, {NODES_SQL}, chosen AS (SELECT node_id AS node FROM nodes WHERE contains(lower(label), '1') ORDER BY node_id LIMIT 100), cells AS (SELECT DISTINCT src, dst FROM edges WHERE src IN (SELECT node FROM chosen) AND dst IN (SELECT node FROM chosen)) SELECT node, (SELECT count(*) FROM cells WHERE src = node) AS outgoing, (SELECT count(*) FROM cells WHERE dst = node) AS incoming, (SELECT count(*) FROM cells WHERE src = node) + (SELECT count(*) FROM cells WHERE dst = node) AS coupling FROM chosen")
def g25b(spark, sf):
    return G.matrix(edges(spark, sf), nodes(spark, sf).select(F.col("node_id").alias("node"), "label"), "1")[1]


@register("g26c_tree", f"""{E}, {NODES_SQL}, root AS (SELECT src AS node FROM edges WHERE relation = 'supplies' GROUP BY src ORDER BY count(*) DESC, src LIMIT 1), e AS (SELECT DISTINCT src, dst FROM edges WHERE src IN (SELECT node_id FROM nodes) AND dst IN (SELECT node_id FROM nodes)),
t(node, depth) AS (SELECT node, 1 FROM root UNION SELECT dst, depth + 1 FROM t JOIN e ON src = node WHERE depth < 3), d AS (SELECT node, min(depth) AS depth FROM t GROUP BY node),
p AS (SELECT d.node, d.depth, min(e.src) AS parent FROM d LEFT JOIN (e JOIN d x ON x.node = e.src) ON e.dst = d.node AND x.depth = d.depth - 1 GROUP BY d.node, d.depth),
n AS (SELECT p.*, (SELECT count(*) FROM p c WHERE c.parent = p.node) AS children FROM p),
w AS (SELECT n.*, children + coalesce((SELECT sum(c.children) FROM n c WHERE c.parent = n.node), 0) AS descendants FROM n),
g AS (SELECT node, count(*) FILTER (WHERE o = 0) AS incoming, count(*) FILTER (WHERE o = 1) AS outgoing FROM (SELECT src AS node, 1 AS o FROM edges UNION ALL SELECT dst, 0 FROM edges) GROUP BY node)
SELECT node, depth, parent, descendants::BIGINT AS descendants, coalesce(incoming, 0) AS incoming, coalesce(outgoing, 0) AS outgoing, coalesce(incoming, 0) + coalesce(outgoing, 0) AS total FROM w LEFT JOIN g USING (node)""")
def g26c(spark, sf):
    e, n = edges(spark, sf), nodes(spark, sf).select(F.col("node_id").alias("node"), "node_type")
    return G.tree(n, e, G.tree_roots(n, e, "supplies"), 3)
