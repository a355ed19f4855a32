"""A property graph over the star schema: region - nation - customer - order, part - supplier."""

from __future__ import annotations

import re

from pyspark.sql import Window
from pyspark.sql import functions as F

from strandline.operators import dataset, graph, search
from strandline.plans.registry import query, table

_N = """n AS (SELECT 'r' || r_regionkey AS id, ['Region', 'Place'] AS labels, r_name AS name FROM region
UNION ALL SELECT 'n' || n_nationkey, ['Nation', 'Place'], n_name FROM nation UNION ALL SELECT 'c' || c_custkey, ['Customer'], c_name FROM customer)"""
_E = """e AS (SELECT 'r' || n_regionkey AS src, 'n' || n_nationkey AS dst, 'HAS_NATION' AS rel FROM nation
UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey, 'HAS_CUSTOMER' FROM customer)"""


def _id(prefix, column):
    return F.concat(F.lit(prefix), F.col(column).cast("string"))


def nodes(spark, sf_dir):
    part = lambda t, p, k, labels, n: table(spark, sf_dir, t).select(_id(p, k).alias("id"), F.array(*[F.lit(x) for x in labels]).alias("labels"), F.col(n).alias("name"))
    return part("region", "r", "r_regionkey", ["Region", "Place"], "r_name").unionByName(part("nation", "n", "n_nationkey", ["Nation", "Place"], "n_name")).unionByName(part("customer", "c", "c_custkey", ["Customer"], "c_name"))


def edges(spark, sf_dir):
    a = table(spark, sf_dir, "nation").select(_id("r", "n_regionkey").alias("src"), _id("n", "n_nationkey").alias("dst"), F.lit("HAS_NATION").alias("rel"))
    b = table(spark, sf_dir, "customer").select(_id("n", "c_nationkey").alias("src"), _id("c", "c_custkey").alias("dst"), F.lit("HAS_CUSTOMER").alias("rel"))
    return a.unionByName(b)


@query("graph_degree", f"WITH {_N}, {_E}, d AS (SELECT id, count(*) AS k FROM (SELECT src AS id FROM e UNION ALL SELECT dst FROM e) GROUP BY id) SELECT n.id, n.name, coalesce(d.k, 0) AS degree FROM n LEFT JOIN d USING (id)")
def graph_degree(spark, sf_dir):
    return graph.degrees(nodes(spark, sf_dir), edges(spark, sf_dir)).select("id", "name", "degree")


@query("top_degree", f"WITH {_N}, {_E}, d AS (SELECT id, count(*) AS degree FROM (SELECT src AS id FROM e UNION ALL SELECT dst FROM e) GROUP BY id) SELECT n.id, n.name, degree FROM n JOIN d USING (id) ORDER BY degree DESC, n.id LIMIT 50")
def top_degree(spark, sf_dir):
    return graph.degrees(nodes(spark, sf_dir), edges(spark, sf_dir)).where("degree > 0").select("id", "name", "degree").orderBy(F.desc("degree"), "id").limit(50)


@query("label_distribution", f"WITH {_N} SELECT label, count(*) AS n FROM (SELECT unnest(labels) AS label FROM n) GROUP BY label")
def label_distribution(spark, sf_dir):
    return graph.label_counts(nodes(spark, sf_dir))


@query("rel_type_top", f"WITH {_E} SELECT rel, count(*) AS n FROM e GROUP BY rel ORDER BY n DESC, rel LIMIT 20")
def rel_type_top(spark, sf_dir):
    return edges(spark, sf_dir).groupBy("rel").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "rel").limit(20)


@query(
    "bfs_two_hop",
    f"""WITH RECURSIVE {_E}, u AS (SELECT src AS a, dst AS b FROM e UNION SELECT dst, src FROM e),
w AS (SELECT 'r' || r_regionkey AS start, 'r' || r_regionkey AS node, 0 AS hop FROM region UNION SELECT start, u.b, hop + 1 FROM w JOIN u ON w.node = u.a WHERE hop < 2)
SELECT start, node, CAST(min(hop) AS INTEGER) AS hop FROM w GROUP BY start, node""",
)
def bfs_two_hop(spark, sf_dir):
    start = table(spark, sf_dir, "region").select(_id("r", "r_regionkey").alias("start")).withColumn("node", F.col("start"))
    return graph.bfs(edges(spark, sf_dir), start, 2)


@query(
    "path_expand_1_2",
    f"""WITH {_E}, k AS (SELECT *, row_number() OVER (ORDER BY src, dst, rel) AS eid FROM e), u AS (SELECT src AS a, dst AS b, rel, eid FROM k UNION ALL SELECT dst, src, rel, eid FROM k),
s AS (SELECT 'n' || n_nationkey AS start FROM nation),
p AS (SELECT start, CAST(NULL AS VARCHAR) AS mid, b AS fin, rel AS rels, 1 AS hops FROM s JOIN u ON start = a WHERE start <> b
UNION ALL SELECT start, x.b, y.b, x.rel || '>' || y.rel, 2 FROM s JOIN u x ON start = x.a JOIN u y ON x.b = y.a WHERE x.eid <> y.eid AND start <> y.b)
SELECT start, mid, fin, rels, CAST(hops AS INTEGER) AS hops FROM p""",
)
def path_expand_1_2(spark, sf_dir):
    start = table(spark, sf_dir, "nation").select(_id("n", "n_nationkey").alias("start"))
    return graph.paths(edges(spark, sf_dir), start).select("start", "mid", F.col("end").alias("fin"), F.array_join("rels", ">").alias("rels"), "hops")


@query(
    "path_expand_ranked",
    f"""WITH {_E}, k AS (SELECT *, row_number() OVER (ORDER BY src, dst, rel) AS eid FROM e), u AS (SELECT src AS a, dst AS b, rel, eid FROM k UNION ALL SELECT dst, src, rel, eid FROM k),
s AS (SELECT 'n' || n_nationkey AS start FROM nation),
p AS (SELECT start, '' AS mid, b AS fin, 1 AS hops FROM s JOIN u ON start = a WHERE start <> b
UNION ALL SELECT start, x.b, y.b, 2 FROM s JOIN u x ON start = x.a JOIN u y ON x.b = y.a WHERE x.eid <> y.eid AND start <> y.b),
r AS (SELECT *, row_number() OVER (PARTITION BY start ORDER BY hops, substr(fin, 1, 1) DESC, fin, mid) AS k FROM p) SELECT start, mid, fin, CAST(hops AS INTEGER) AS hops, CAST(k AS INTEGER) AS k FROM r WHERE k <= 5""",
)
def path_expand_ranked(spark, sf_dir):
    """Fewer hops first, then by kind of the end; five a start."""
    start = table(spark, sf_dir, "nation").select(_id("n", "n_nationkey").alias("start"))
    p = graph.paths(edges(spark, sf_dir), start).select("start", F.coalesce("mid", F.lit("")).alias("mid"), F.col("end").alias("fin"), "hops")
    w = Window.partitionBy("start").orderBy("hops", F.desc(F.substring("fin", 1, 1)), "fin", "mid")
    return p.withColumn("k", F.row_number().over(w)).where("k <= 5")


@query(
    "semantic_path_collect",
    f"""WITH {_E}, u AS (SELECT src AS a, dst AS b, rel FROM e UNION ALL SELECT dst, src, rel FROM e),
m AS (SELECT o_orderkey AS article, 'c' || o_custkey AS concept, o_totalprice AS score FROM orders UNION ALL SELECT o_orderkey, 'none', 0.0 FROM orders WHERE o_orderkey % 7 = 0)
SELECT article, max(score) AS score, coalesce(list_aggregate(list_sort(list(DISTINCT concept || ' -' || rel || '-> ' || b) FILTER (b IS NOT NULL)), 'string_agg', '; '), '') AS paths FROM m LEFT JOIN u ON concept = a GROUP BY article""",
)
def semantic_path_collect(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    m = o.select(F.col("o_orderkey").alias("article"), _id("c", "o_custkey").alias("concept"), F.col("o_totalprice").alias("score"))
    m = m.unionByName(o.where("o_orderkey % 7 = 0").select(F.col("o_orderkey").alias("article"), F.lit("none").alias("concept"), F.lit(0.0).alias("score")))
    return graph.semantic_paths(m, edges(spark, sf_dir)).withColumn("paths", F.array_join("paths", "; "))


@query(
    "semantic_limit_before_group",
    """WITH r AS (SELECT o_custkey AS a, o_orderkey AS s, o_orderstatus AS rel FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 200) SELECT a, count(*) AS n, count(DISTINCT rel) AS rels FROM r GROUP BY a""",
)
def semantic_limit_before_group(spark, sf_dir):
    """The limit is on joined rows, before they are grouped."""
    r = table(spark, sf_dir, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(200)
    return r.groupBy(F.col("o_custkey").alias("a")).agg(F.count(F.lit(1)).alias("n"), F.count_distinct("o_orderstatus").alias("rels"))


@query(
    "clique_edges",
    """WITH p AS (SELECT DISTINCT l_orderkey AS g, l_partkey AS x FROM lineitem) SELECT a.g AS l_orderkey, a.x AS src, b.x AS dst, 'co_ordered' AS rel FROM p a JOIN p b ON a.g = b.g AND a.x < b.x""",
)
def clique_edges(spark, sf_dir):
    """An order holds a few parts: its pairs are made inside its row."""
    return graph.cliques(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey"), "l_orderkey", "l_partkey", "co_ordered", 64)


@query(
    "upsert_first_last_wins",
    """SELECT user_id, arg_min(event_type, (ts, event_id)) AS first_type, arg_max(event_type, (ts, event_id)) AS last_type, arg_max(value, (ts, event_id)) AS last_value FROM events GROUP BY user_id""",
)
def upsert_first_last_wins(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("user_id", "event_type", "value", "ts", "event_id")
    a = dataset.first_wins(e, ["user_id"], ["ts", "event_id"]).select("user_id", F.col("event_type").alias("first_type"))
    b = dataset.last_wins(e, ["user_id"], ["ts", "event_id"]).select("user_id", F.col("event_type").alias("last_type"), F.col("value").alias("last_value"))
    return a.join(b, "user_id")


@query(
    "upsert_nodes",
    """WITH o AS (SELECT c_custkey AS id, c_name AS title, c_mktsegment AS content FROM customer WHERE c_custkey % 2 = 0),
n AS (SELECT o_custkey AS id, arg_max(CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE {'v': o_orderpriority} END, o_orderkey) AS x, arg_max({'t': CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderpriority END, 'c': o_orderstatus}, o_orderkey) AS r FROM orders GROUP BY 1)
SELECT coalesce(o.id, n.id) AS id, coalesce(r.t, title) AS title, CASE WHEN n.id IS NOT NULL THEN r.c ELSE content END AS content FROM o FULL JOIN n ON o.id = n.id""",
)
def upsert_nodes(spark, sf_dir):
    old = table(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("title"), F.col("c_mktsegment").alias("content"))
    new = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderpriority")).alias("title"), F.col("o_orderstatus").alias("content"), F.col("o_orderkey").alias("pos"))
    return graph.upsert_nodes(old, new, "id", "pos")


@query(
    "upsert_edges",
    f"""WITH {_E}, x AS (SELECT DISTINCT 'c' || o_custkey AS src, 'n' || (o_orderkey % 30) AS dst, 'VISITED' AS rel FROM orders),
ok AS (SELECT * FROM x WHERE src IN (SELECT 'c' || c_custkey FROM customer) AND dst IN (SELECT 'n' || n_nationkey FROM nation)) SELECT * FROM e UNION ALL SELECT * FROM ok""",
)
def upsert_edges(spark, sf_dir):
    new = table(spark, sf_dir, "orders").select(_id("c", "o_custkey").alias("src"), F.concat(F.lit("n"), (F.col("o_orderkey") % 30).cast("string")).alias("dst"), F.lit("VISITED").alias("rel"))
    return graph.upsert_edges(edges(spark, sf_dir), new, nodes(spark, sf_dir))


_BROKEN = f"""WITH {_N}, {_E}, ns AS (SELECT 'whole' AS graph, id FROM n UNION ALL SELECT 'broken', id FROM n UNION ALL SELECT 'broken', id FROM n WHERE list_contains(labels, 'Nation') UNION ALL SELECT 'broken', NULL FROM region),
es AS (SELECT 'whole' AS graph, src, dst, rel FROM e UNION ALL SELECT 'broken', src, dst, rel FROM e UNION ALL SELECT 'broken', src, dst, rel FROM e WHERE rel = 'HAS_NATION' UNION ALL SELECT 'broken', src, 'x' || dst, rel FROM e WHERE rel = 'HAS_CUSTOMER'),
a AS (SELECT graph, count(*) AS nodes, count(id) = count(DISTINCT id) AS ids_unique, count(id) = count(*) AS ids_set FROM ns GROUP BY graph), b AS (SELECT graph, count(*) AS edges, count(*) = count(DISTINCT src || '|' || dst || '|' || rel) AS edges_unique FROM es GROUP BY graph),
c AS (SELECT graph, count(*) FILTER (NOT EXISTS (SELECT 1 FROM ns WHERE ns.graph = es.graph AND ns.id = src) OR NOT EXISTS (SELECT 1 FROM ns WHERE ns.graph = es.graph AND ns.id = dst)) = 0 AS ends_exist FROM es GROUP BY graph)
SELECT graph, nodes, ids_unique, ids_set, edges, edges_unique, ends_exist, ids_unique AND ids_set AND edges_unique AND ends_exist AS passed FROM a JOIN b USING (graph) JOIN c USING (graph)"""


@query("graph_integrity", _BROKEN)
def graph_integrity(spark, sf_dir):
    """The graph as it is, and one with repeated nodes and edges, missing ids and loose ends."""
    n, e = nodes(spark, sf_dir).select("id", "labels"), edges(spark, sf_dir)
    none = table(spark, sf_dir, "region").select(F.lit(None).cast("string").alias("id"), F.array(F.lit("Region")).alias("labels"))
    bad_n = n.unionByName(n.where(F.array_contains("labels", "Nation"))).unionByName(none)
    bad_e = e.unionByName(e.where("rel = 'HAS_NATION'")).unionByName(e.where("rel = 'HAS_CUSTOMER'").withColumn("dst", F.concat(F.lit("x"), "dst")))
    out = graph.integrity(n, e).select(F.lit("whole").alias("graph"), "*").unionByName(graph.integrity(bad_n, bad_e).select(F.lit("broken").alias("graph"), "*"))
    return out.select("graph", "nodes", "ids_unique", "ids_set", "edges", "edges_unique", "ends_exist", "passed")


@query(
    "scope_filter",
    f"WITH {_N} SELECT id, name FROM n WHERE list_contains(labels, 'Nation') OR name LIKE 'AF%'",
)
def scope_filter(spark, sf_dir):
    return nodes(spark, sf_dir).where(F.array_contains("labels", "Nation") | F.col("name").startswith("AF")).select("id", "name")


@query(
    "keyed_rank_union",
    """WITH c AS (SELECT o_custkey AS q, o_orderkey AS item, o_totalprice AS score FROM orders UNION ALL SELECT o_custkey, o_orderkey, 2.0 * sum(l_extendedprice) FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_quantity > 40 GROUP BY 1, 2),
m AS (SELECT q, item, max(score) AS score FROM c GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, item) AS k FROM m) SELECT q, item, round(score, 2) AS score, CAST(k AS INTEGER) AS k FROM r WHERE k <= 3""",
)
def keyed_rank_union(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    a = o.select(F.col("o_custkey").alias("q"), F.col("o_orderkey").alias("item"), F.col("o_totalprice").alias("score"))
    l = table(spark, sf_dir, "lineitem").where("l_quantity > 40").groupBy("l_orderkey").agg(F.sum("l_extendedprice").alias("x"))  # noqa: E741
    b = o.join(l, o["o_orderkey"] == l["l_orderkey"]).select(F.col("o_custkey").alias("q"), F.col("o_orderkey").alias("item"), (2.0 * F.col("x")).alias("score"))
    m = search.best_per_id("q", "item", "score", a, b)
    w = Window.partitionBy("q").orderBy(F.desc("score"), "item")
    return m.withColumn("k", F.row_number().over(w)).where("k <= 3").withColumn("score", F.round("score", 2))


_REFS = r"regexp_extract_all(lower(text), '[a-z]+') "


@query(
    "triples",
    r"""WITH x AS (SELECT doc_id, unnest(regexp_extract_all(text, '([a-z]+) of ([a-z]+)', 1)) AS s, unnest(regexp_extract_all(text, '([a-z]+) of ([a-z]+)', 2)) AS o FROM documents)
SELECT doc_id, s AS subject, o AS object, count(*) AS n FROM x WHERE s <> o GROUP BY ALL""",
)
def triples(spark, sf_dir):
    t = graph.regex_triples(table(spark, sf_dir, "documents"), "doc_id", "text", [("Word", "OF", "Word", r"(?-iuU)([a-z]+) of ([a-z]+)")])
    return t.groupBy("doc_id", "subject", "object").agg(F.count(F.lit(1)).alias("n"))


@query(
    "band_join_500",
    r"""WITH t AS (SELECT doc_id, regexp_split_to_array(text, ' ') AS ws FROM documents), p AS (SELECT doc_id, unnest(ws) AS w, unnest(range(0, len(ws))) AS pos FROM t),
a AS (SELECT * FROM p WHERE w = 'the'), b AS (SELECT * FROM p WHERE w = 'idiot') SELECT a.doc_id, a.pos AS pos_a, b.pos AS pos_b FROM a JOIN b ON a.doc_id = b.doc_id AND abs(a.pos - b.pos) < 50""",
)
def band_join_500(spark, sf_dir):
    p = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", " ")).alias("pos", "w"))
    a, b = p.where("w = 'the'").select("doc_id", F.col("pos").cast("long").alias("pos_a")), p.where("w = 'idiot'").select("doc_id", F.col("pos").cast("long").alias("pos_b"))
    return graph.near_pairs(a, b, "doc_id", "pos_a", "pos_b", 50)


@query(
    "band_join_500_chars",
    r"""WITH t AS (SELECT doc_id, regexp_split_to_array(text, ' ') AS ws FROM documents), p AS (SELECT doc_id, unnest(ws) AS w, unnest(range(0, len(ws))) AS pos FROM t),
c AS (SELECT doc_id, w, CAST(sum(length(w) + 1) OVER (PARTITION BY doc_id ORDER BY pos) - length(w) - 1 AS BIGINT) AS start FROM p),
a AS (SELECT * FROM c WHERE w = 'the'), b AS (SELECT * FROM c WHERE w = 'idiot') SELECT a.doc_id, a.start AS start_a, b.start AS start_b FROM a JOIN b ON a.doc_id = b.doc_id AND abs(a.start - b.start) < 500""",
)
def band_join_500_chars(spark, sf_dir):
    """Words that start less than 500 characters apart; band_join_500 keeps to the 50 word positions that its SQL has."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    a, b = (_starts(d, w).select("doc_id", F.col("start").alias(name)) for w, name in (("the", "start_a"), ("idiot", "start_b")))
    return graph.near_pairs(a, b, "doc_id", "start_a", "start_b", 500)


def _starts(docs, word):
    """doc_id, start: where a word stands between blanks or ends of the text, in characters: what stands before it, added up."""
    parts = F.split("text", f"(?<![^ ]){re.escape(word)}(?![^ ])")
    x = docs.select("doc_id", F.size(parts).alias("n"), F.posexplode(parts).alias("k", "part")).select("doc_id", "n", "k", F.length("part").alias("size"))
    upto = F.sum("size").over(Window.partitionBy("doc_id").orderBy("k").rowsBetween(Window.unboundedPreceding, 0))
    return x.withColumn("start", upto + F.col("k") * len(word)).where("k < n - 1").select("doc_id", "start")
