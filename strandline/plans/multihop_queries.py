"""Neighbours and multi-hop contexts over a graph of nations, customers and orders, and over documents and their sources."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strandline.operators import lookup, multihop, search
from strandline.plans.registry import query, table
from strandline.sources.readers import spread

#: Edges in order of arrival: an order belongs to its customer, a customer to a nation, a nation to a region.
_E = """e AS (SELECT row_number() OVER (ORDER BY k, src, dst) AS eid, src, dst, rel FROM (SELECT 1 AS k, 'c' || o_custkey AS src, 'o' || o_orderkey AS dst, 'PLACED' AS rel FROM orders
UNION ALL SELECT 2, 'c' || c_custkey, 'n' || c_nationkey, 'LIVES_IN' FROM customer UNION ALL SELECT 3, 'n' || n_nationkey, 'r' || n_regionkey, 'PART_OF' FROM nation))"""
_F = """f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY eid) AS n FROM (SELECT src AS node, dst AS other, * FROM e UNION ALL SELECT dst, src, * FROM e WHERE src <> dst)) WHERE n <= {per})"""


def _graph(spark, sf_dir):
    part = lambda t, k, a, x, b, y, rel: table(spark, sf_dir, t).select(F.lit(k).alias("k"), F.concat(F.lit(a), x).alias("src"), F.concat(F.lit(b), y).alias("dst"), F.lit(rel).alias("rel"))
    e = part("orders", 1, "c", "o_custkey", "o", "o_orderkey", "PLACED").unionByName(part("customer", 2, "c", "c_custkey", "n", "c_nationkey", "LIVES_IN")).unionByName(part("nation", 3, "n", "n_nationkey", "r", "n_regionkey", "PART_OF"))
    return e.withColumn("eid", F.struct("k", "src", "dst")).drop("k")  # an order, without numbering all edges in one task


@query(
    "graph_neighbours_bounded",
    f"""WITH {_E}, {_F.format(per=10)}, s AS (SELECT 'c' || c_custkey AS start FROM customer),
h1 AS (SELECT s.start, f.other, [f.n] AS path, 1 AS hop, src, dst, rel FROM s JOIN f ON f.node = s.start),
n1 AS (SELECT start, other AS node, min(path) AS path FROM h1 WHERE other <> start GROUP BY 1, 2), c1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY start ORDER BY path) AS k FROM n1) WHERE k <= 20),
h2 AS (SELECT c1.start, f.other, list_append(path, f.n) AS path, 2 AS hop, src, dst, rel FROM c1 JOIN f USING (node)),
u AS (SELECT *, row_number() OVER (PARTITION BY start ORDER BY hop, path) AS pos FROM (SELECT * FROM h1 UNION ALL SELECT * FROM h2)) SELECT start, CAST(pos AS INTEGER) AS pos, CAST(hop AS INTEGER) AS hop, src, dst, rel FROM u WHERE pos <= 20""",
)
def graph_neighbours_bounded(spark, sf_dir):
    """From every customer, two hops of at most ten edges each, twenty edges in all, in breadth-first order."""
    starts = table(spark, sf_dir, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("start"))
    return multihop.neighbours(_graph(spark, sf_dir), starts, 2, 20)


_ASKED = r"a AS (SELECT item_id AS query_id, list_filter(regexp_split_to_array(trim(lower(text)), '\s+'), lambda w: length(w) > 6)[1:5] AS ws FROM benchmark)"
_DOCS = """d AS (SELECT doc_id, 'd' || doc_id AS id, source || ' ' || doc_id % 7 AS title, text AS content FROM documents)"""
_LINKS = """e AS (SELECT row_number() OVER (ORDER BY doc_id) AS eid, id AS src, lead(id) OVER (PARTITION BY title ORDER BY doc_id) AS dst, 'NEXT' AS rel FROM d)"""


def _docs(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return spread(d).select("doc_id", F.concat(F.lit("d"), "doc_id").alias("id"), F.concat_ws(" ", "source", F.col("doc_id") % 7).alias("title"), F.col("text").alias("content"))


def _links(docs):
    """Each document to the next of its title."""
    w = Window.partitionBy("title").orderBy("doc_id")
    return docs.select(F.col("id").alias("src"), F.lead("id").over(w).alias("dst"), F.lit("NEXT").alias("rel"), F.col("doc_id").alias("eid")).where("dst is not null")


def _starts(spark, sf_dir, docs, k):
    """The first documents, by number, that contain one of a question's first five long words."""
    b = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.explode(F.slice(F.filter(F.split(F.trim(F.lower("text")), r"\s+"), lambda w: F.length(w) > 6), 1, 5)).alias("w")).distinct()
    words = docs.select("doc_id", "id", F.explode(F.array_distinct(F.split(F.lower("content"), r"[\x20\x09-\x0D]+"))).alias("w"))
    hit = words.join(b, "w").select("query_id", "doc_id", "id").distinct()
    first = Window.partitionBy("query_id").orderBy("doc_id")
    return hit.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k).select("query_id", "rank", "id")


_STARTS = r"""w AS (SELECT doc_id, id, unnest(list_distinct(regexp_split_to_array(lower(content), '[\x20\x09-\x0D]+'))) AS w FROM d), b AS (SELECT DISTINCT query_id, unnest(ws) AS w FROM a),
s AS (SELECT query_id, id, rank FROM (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY doc_id) AS rank FROM (SELECT DISTINCT query_id, doc_id, id FROM w JOIN b USING (w))) WHERE rank <= {k})"""


@query(
    "graph_multi_hop_context",
    f"""WITH {_ASKED}, {_DOCS}, {_LINKS.replace('FROM d)', 'FROM d QUALIFY dst IS NOT NULL)')}, {_STARTS.format(k=3)}, {_F.format(per=10)},
h1 AS (SELECT s.id AS start, f.other, [f.n] AS path, 1 AS hop, dst FROM (SELECT DISTINCT id FROM s) s JOIN f ON f.node = s.id),
n1 AS (SELECT start, other AS node, min(path) AS path FROM h1 WHERE other <> start GROUP BY 1, 2), h2 AS (SELECT n1.start, f.other, list_append(path, f.n) AS path, 2 AS hop, dst FROM n1 JOIN f USING (node)),
u AS (SELECT start, dst, row_number() OVER (PARTITION BY start ORDER BY hop, path) AS pos FROM (SELECT * FROM h1 UNION ALL SELECT * FROM h2)), v AS (SELECT u.*, d.title, d.content FROM u JOIN d ON d.id = u.dst WHERE pos <= 3),
i AS (SELECT query_id, rank, 0 AS pos, s.id AS key, '[' || title || ']' || chr(10) || substr(content, 1, 600) AS part FROM s JOIN d USING (id)
  UNION ALL SELECT query_id, rank, pos, title, '  → [' || title || '] (NEXT):' || chr(10) || '  ' || substr(content, 1, 300) FROM s JOIN v ON v.start = s.id WHERE content <> ''),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id, key ORDER BY rank, pos) AS k FROM i)
SELECT query_id, md5(string_agg(part, chr(10) || chr(10) ORDER BY rank, pos)) AS context FROM o WHERE k = 1 GROUP BY query_id""",
)
def graph_multi_hop_context(spark, sf_dir):
    """Search, breadth-first expansion, and a text of starts and their first neighbours that weren't shown."""
    docs = _docs(spark, sf_dir)
    out = multihop.context(_starts(spark, sf_dir, docs, 3), docs.select("id", "title", "content"), _links(docs))
    return out.select("query_id", F.md5("context").alias("context"))


_PATHS = """g1 AS (SELECT s.start, f.other AS a, f.n AS n1, f.src AS s1, f.dst AS d1, f.rel AS r1 FROM (SELECT DISTINCT id AS start FROM s) s JOIN f ON f.node = s.start WHERE f.other <> s.start),
p AS (SELECT start, [a] AS via, [r1] AS rels, [n1] AS ats FROM g1 UNION ALL SELECT start, [a, f.other], [r1, f.rel], [n1, f.n] FROM g1 JOIN f ON f.node = g1.a WHERE NOT (s1 = f.src AND d1 = f.dst AND r1 = f.rel) AND f.other <> start),
t AS (SELECT *, row_number() OVER (PARTITION BY start ORDER BY len(rels), ats) AS pos FROM p QUALIFY pos <= {most}),
x AS (SELECT start, pos, array_to_string(list_transform(list_prepend(start, via), lambda v: 'name ' || v), ' -> ') AS names, array_to_string(rels, ' -> ') AS rels, via[-1] AS fin FROM t),
i AS (SELECT query_id, rank, 0 AS pos, NULL AS key, '[Start: name ' || id || '] (' || kind || ')' || chr(10) || summary AS part FROM s JOIN nn USING (id)
  UNION ALL SELECT query_id, rank, x.pos, names || '|' || rels, 'Path: ' || names || chr(10) || 'Relation chain: ' || rels || chr(10) || 'Evidence: ' || coalesce(nn.summary, '') FROM s JOIN x ON x.start = s.id LEFT JOIN nn ON nn.id = x.fin),
j AS (SELECT * FROM i QUALIFY key IS NULL OR row_number() OVER (PARTITION BY query_id, key ORDER BY rank, pos) = 1), k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank, pos) AS n FROM j QUALIFY n <= {parts})
SELECT query_id, md5(string_agg(part, chr(10) || chr(10) ORDER BY n)) AS context FROM k GROUP BY query_id"""
_NN = """nn AS (SELECT 'c' || c_custkey AS id, 'Customer' AS kind, substr(c_name, 1, 1200) AS summary FROM customer UNION ALL SELECT 'n' || n_nationkey, 'Nation', n_name FROM nation UNION ALL SELECT 'r' || r_regionkey, 'Region', r_name FROM region UNION ALL SELECT 'o' || o_orderkey, 'Order', o_orderstatus FROM orders)"""


def _nodes(spark, sf_dir):
    part = lambda t, p, k, kind, c: table(spark, sf_dir, t).select(F.concat(F.lit(p), k).alias("id"), F.concat(F.lit("name " + p), k).alias("name"), F.lit(kind).alias("kind"), F.col(c).alias("summary"))
    return part("customer", "c", "c_custkey", "Customer", "c_name").unionByName(part("nation", "n", "n_nationkey", "Nation", "n_name")).unionByName(part("region", "r", "r_regionkey", "Region", "r_name")).unionByName(part("orders", "o", "o_orderkey", "Order", "o_orderstatus"))


@query(
    "chunk_anchored_multi_hop",
    f"""WITH {_E}, {_F.format(per=7)}, {_NN}, a AS (SELECT conv_id AS query_id, 'n' || conv_id % 25 AS x, 'c' || conv_id % 100 + 1 AS y, 'o' || conv_id AS z, 'r' || conv_id % 9 AS w FROM conversations GROUP BY conv_id),
s AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY id) AS rank FROM (SELECT DISTINCT query_id, unnest([x, y, z, w]) AS id FROM a) WHERE id IN (SELECT id FROM nn) QUALIFY rank <= 6), {_PATHS.format(most=6, parts=15)}""",
)
def chunk_anchored_multi_hop(spark, sf_dir):
    """Every conversation names nodes by id; those that exist are starts, and their paths give the context."""
    c = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("query_id")).distinct()
    ids = F.array(F.concat(F.lit("n"), F.col("query_id") % 25), F.concat(F.lit("c"), F.col("query_id") % 100 + 1), F.concat(F.lit("o"), F.col("query_id")), F.concat(F.lit("r"), F.col("query_id") % 9))
    asked = c.select("query_id", F.explode(F.array_distinct(ids)).alias("id"))
    nodes = _nodes(spark, sf_dir)
    there = lookup.by_any_id(nodes, asked.select(F.col("id").alias("wanted")), ["id"], "id").select("id")
    first = Window.partitionBy("query_id").orderBy("id")
    starts = asked.join(there, "id").withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= 6)
    return multihop.path_context(starts, nodes, _graph(spark, sf_dir), 3).select("query_id", F.md5("context").alias("context"))


_WEIGHTS = {"ring": 5.0, "small": 3.0, "red": 2.0}


@query(
    "keyword_multi_hop",
    f"""WITH pe AS (SELECT DISTINCT 'p' || l_partkey AS src, 's' || l_suppkey AS dst, 'SOLD_BY' AS rel FROM lineitem), e AS (SELECT row_number() OVER (ORDER BY src, dst) AS eid, * FROM pe), {_F.format(per=7)},
nn AS (SELECT 'p' || p_partkey AS id, 'Part' AS kind, p_name AS summary FROM part UNION ALL SELECT 's' || s_suppkey, 'Supplier', s_name FROM supplier),
q AS (SELECT DISTINCT p_brand AS query_id FROM part), kk AS (SELECT p_brand AS query_id, 'p' || p_partkey AS id, {' + '.join(f"CASE WHEN contains(lower(p_name), '{w}') THEN {v} ELSE 0 END" for w, v in _WEIGHTS.items())} AS kw FROM part),
s AS (SELECT query_id, id, row_number() OVER (PARTITION BY query_id ORDER BY kw DESC, id) AS rank FROM kk WHERE kw > 0 QUALIFY rank <= 3), {_PATHS.format(most=6, parts=15)}""",
)
def keyword_multi_hop(spark, sf_dir):
    """For every brand, the parts whose names weigh most are starts; paths lead over suppliers to other parts."""
    p = table(spark, sf_dir, "part").select(F.concat(F.lit("p"), "p_partkey").alias("id"), F.col("p_brand").alias("query_id"), "p_name")
    top = Window.partitionBy("query_id").orderBy(F.desc("kw"), "id")
    starts = p.withColumn("kw", search.keyword_weight(F.col("p_name"), _WEIGHTS)).where("kw > 0").withColumn("rank", F.row_number().over(top)).where(F.col("rank") <= 3).select("query_id", "rank", "id")
    part = lambda t, a, k, kind, c: table(spark, sf_dir, t).select(F.concat(F.lit(a), k).alias("id"), F.concat(F.lit("name " + a), k).alias("name"), F.lit(kind).alias("kind"), F.col(c).alias("summary"))
    nodes = part("part", "p", "p_partkey", "Part", "p_name").unionByName(part("supplier", "s", "s_suppkey", "Supplier", "s_name"))
    e = table(spark, sf_dir, "lineitem").select(F.concat(F.lit("p"), "l_partkey").alias("src"), F.concat(F.lit("s"), "l_suppkey").alias("dst"), F.lit("SOLD_BY").alias("rel")).distinct()
    return multihop.path_context(starts, nodes, e.withColumn("eid", F.struct("src", "dst")), 3).select("query_id", F.md5("context").alias("context"))
