"""Normal forms, predicates, references, look-ups and benchmark building over articles derived from the documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.functions import normalise as N
from strandline.operators import lookup
from strandline.plans.registry import query, table

#: The documents as articles: law, article number, content that names its origin and other articles.
_A = """a AS (SELECT doc_id AS id, (doc_id % 9 + 1) || '/2016/TT-BB' AS law, CAST(doc_id // 9 AS VARCHAR) AS article, text,
'Nguồn gốc: Điều ' || (doc_id // 9) || ' số ' || (doc_id % 9 + 1) || '/2016/TT-BB. Theo Điều ' || (doc_id * 7 % 60) || ' và Điều ' || (doc_id * 3 % 60)
|| CASE WHEN doc_id % 4 = 0 THEN ' của ' || (doc_id * 5 % 13 + 1) || '/2016/TT-BB' ELSE '' END AS content FROM documents)"""


def articles(spark, sf_dir):
    d = table(spark, sf_dir, "documents").withColumn("law", F.concat((F.col("doc_id") % 9 + 1).cast("string"), F.lit("/2016/TT-BB"))).withColumn("article", F.floor(F.col("doc_id") / 9).cast("string"))
    other = F.when(F.col("doc_id") % 4 == 0, F.concat(F.lit(" của "), (F.col("doc_id") * 5 % 13 + 1).cast("string"), F.lit("/2016/TT-BB"))).otherwise("")
    content = F.concat(F.lit("Nguồn gốc: Điều "), "article", F.lit(" số "), "law", F.lit(". Theo Điều "), (F.col("doc_id") * 7 % 60).cast("string"), F.lit(" và Điều "), (F.col("doc_id") * 3 % 60).cast("string"), other)
    return d.select(F.col("doc_id").alias("id"), "law", "article", "text", content.alias("content"))


@query("nfc_text", "SELECT doc_id, md5(trim(regexp_replace(nfc_normalize(text || ' e' || chr(769)), '[ \\t\\n\\r\\f\\x0B]+', ' ', 'g'))) AS digest FROM documents")
def nfc_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(N.nfc(F.concat("text", F.lit(" é"))).cast("binary")).alias("digest"))


@query("canonical_names", "SELECT s AS source, CASE WHEN k = 'source web' THEN 'web' WHEN k = 'source books' THEN 'book' ELSE k END AS name FROM (SELECT DISTINCT source AS s, lower(trim(regexp_replace('  Source   ' || source || ' ', '\\s+', ' ', 'g'))) AS k FROM documents)")
def canonical_names(spark, sf_dir):
    names = table(spark, sf_dir, "documents").select("source").distinct()
    return names.select("source", N.canonical(F.concat(F.lit("  Source   "), "source", F.lit(" ")), {"source web": "web", "source books": "book"}).alias("name"))


@query(
    "article_labels",
    """SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'Điều ' || (doc_id % 50) || '. Tên' WHEN doc_id % 3 = 1 THEN 'Điều ' || (doc_id % 70) ELSE 'Điều ' || doc_id || ', khoản 4' END AS label FROM documents""",
)
def article_labels(spark, sf_dir):
    d, s = table(spark, sf_dir, "documents"), lambda c: F.col(c).cast("string")
    n = d.select("doc_id", (F.col("doc_id") % 50).alias("a"), (F.col("doc_id") % 70).alias("b"))
    raw = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("14.5.NĐ.10."), s("a"), F.lit(". Tên "))).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("Điều 19.5.LQ."), s("b"), F.lit("."))).otherwise(F.concat(F.lit("Điều "), s("doc_id"), F.lit(", khoản 4")))
    return n.select("doc_id", N.article_label(raw).alias("label"))


@query(
    "evidence_split",
    """SELECT doc_id, n_parts, second FROM (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 3 ELSE 2 END AS n_parts, CASE WHEN doc_id % 2 = 0 THEN 'Điều ' || doc_id || '.' ELSE 'Điều ' || (doc_id + 1) END AS second FROM documents)""",
)
def evidence_split(spark, sf_dir):
    i = F.col("doc_id").cast("string")
    later = F.concat(F.lit("\nĐiều "), (F.col("doc_id") + 1).cast("string"), F.lit(" last"))
    text = F.concat(F.lit("intro\n"), F.lit("line"), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("\nĐiều "), i, F.lit(". body\nmore"))).otherwise(""), later)
    x = table(spark, sf_dir, "documents").select("doc_id", N.evidence_parts(text).alias("p"))
    return x.select("doc_id", F.size("p").alias("n_parts"), F.col("p")[1]["article"].alias("second"))


@query(
    "reference_pools",
    f"""WITH {_A},
s AS (SELECT a.id, min_by(r.ref, r.at) AS same_law FROM a, LATERAL (SELECT unnest(regexp_extract_all(content, 'Điều (\\d+)', 1)) AS ref, generate_subscripts(regexp_extract_all(content, 'Điều (\\d+)', 1), 1) AS at) r
  WHERE r.ref <> a.article AND EXISTS (SELECT 1 FROM a b WHERE b.law = a.law AND b.article = r.ref) GROUP BY a.id),
o AS (SELECT a.id, min_by(r.ref, r.at) AS other_law FROM a, LATERAL (SELECT unnest(regexp_extract_all(content, '(\\d+/\\d+/TT-BB)', 1)) AS ref, generate_subscripts(regexp_extract_all(content, '(\\d+/\\d+/TT-BB)', 1), 1) AS at) r
  WHERE r.ref <> a.law AND EXISTS (SELECT 1 FROM a b WHERE b.law = r.ref) GROUP BY a.id)
SELECT a.id, same_law, other_law, CASE WHEN other_law IS NOT NULL THEN 'hybrid_reasoning' WHEN same_law IS NOT NULL THEN 'graph_traversal' ELSE 'dense_retrieval' END AS pool FROM a LEFT JOIN s USING (id) LEFT JOIN o USING (id)""",
)
def reference_pools(spark, sf_dir):
    return lookup.references(articles(spark, sf_dir)).select("id", "same_law", "other_law", "pool")


@query(
    "direct_articles",
    f"""WITH {_A}, q AS (SELECT item_id AS query_id, (item_id % 9 + 1) || '/2016/TT-BB' AS doc, [item_id % 20, item_id % 7] AS n FROM benchmark),
f AS (SELECT DISTINCT q.query_id, a.id FROM q, a WHERE list_contains(q.n, CAST(a.article AS BIGINT)) AND (a.law = q.doc OR list_contains(regexp_extract_all(a.content, '(\\d+/\\d+/TT-BB)', 1), q.doc)))
SELECT query_id, id, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY id) AS rank FROM f) WHERE rank <= 5""",
)
def direct_articles(spark, sf_dir):
    i = F.col("item_id")
    text = F.concat(F.lit("Điều "), (i % 20).cast("string"), F.lit(" và điều "), (i % 7).cast("string"), F.lit(" của "), (i % 9 + 1).cast("string"), F.lit("/2016/TT-BB?"))
    return lookup.direct_articles(articles(spark, sf_dir), table(spark, sf_dir, "benchmark").select(i.alias("query_id"), text.alias("query")))


@query(
    "article_graph_edges",
    f"""WITH {_A}, r AS (SELECT id || '_' || law AS src, unnest(list_slice(regexp_extract_all(content, '(\\d+/\\d+/TT-BB)', 1), 1, 10)) AS ref FROM a) SELECT DISTINCT src, '*_' || ref AS dst, 'cites' AS rel FROM r""",
)
def article_graph_edges(spark, sf_dir):
    a = articles(spark, sf_dir).select(F.col("id").alias("seq"), F.col("id").cast("string").alias("id"), "law", F.lit("t").alias("title"), "content")
    return lookup.article_graph(a)[1]


@query(
    "article_graph_nodes",
    """SELECT key, law, content, title FROM (SELECT (doc_id % 40) || '_' || source AS key, source AS law, substr(text, 1, 3000) AS content, lang AS title, row_number() OVER (PARTITION BY doc_id % 40, source ORDER BY doc_id DESC) AS k FROM documents WHERE source <> '') WHERE k = 1""",
)
def article_graph_nodes(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where("source <> ''")
    return lookup.article_graph(d.select(F.col("doc_id").alias("seq"), (F.col("doc_id") % 40).cast("string").alias("id"), F.col("source").alias("law"), F.col("lang").alias("title"), F.col("text").alias("content")))[0]


@query(
    "nodes_by_any_id",
    """WITH w AS (SELECT DISTINCT n_name AS wanted FROM nation UNION SELECT 'Customer#000000007' UNION SELECT CAST(c_custkey AS VARCHAR) FROM customer WHERE c_custkey % 11 = 0)
SELECT c_custkey AS id, c_name AS name FROM customer WHERE CAST(c_custkey AS VARCHAR) IN (SELECT wanted FROM w) OR c_name IN (SELECT wanted FROM w) OR c_mktsegment IN (SELECT wanted FROM w)""",
)
def nodes_by_any_id(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("key"), F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), "c_mktsegment")
    wanted = table(spark, sf_dir, "nation").select(F.col("n_name").alias("wanted")).unionByName(c.where("id % 11 = 0").select(F.col("key").alias("wanted"))).unionByName(spark.createDataFrame([("Customer#000000007",)], "wanted string"))
    return lookup.by_any_id(c, wanted, ["key", "name", "c_mktsegment"], "key").select("id", "name")


@query("texts_containing", "WITH e AS (SELECT DISTINCT regexp_extract(text, '[a-z]{6,}') AS entity FROM benchmark) SELECT d.doc_id, e.entity FROM documents d, e WHERE e.entity <> '' AND contains(d.text, e.entity)")
def texts_containing(spark, sf_dir):
    e = table(spark, sf_dir, "benchmark").select(F.regexp_extract("text", "[a-z]{6,}", 0).alias("entity"))
    return lookup.containing(table(spark, sf_dir, "documents").select("doc_id", "text"), e).select("doc_id", "entity")


@query("groups_of_two", "SELECT source, count(*) AS n FROM documents GROUP BY source HAVING count(*) >= 2")
def groups_of_two(spark, sf_dir):
    return lookup.groups_of(table(spark, sf_dir, "documents"), "source")


@query(
    "split_profile",
    """WITH x AS (SELECT CASE WHEN doc_id % 10 < 7 THEN 'train' WHEN doc_id % 10 < 9 THEN 'val' ELSE 'test' END AS split, source AS law, lang AS route, doc_id % 3 AS hop FROM documents),
t AS (SELECT split, route, row_number() OVER (PARTITION BY split ORDER BY count(*) DESC, route) AS k FROM x GROUP BY split, route)
SELECT x.split, count(*) AS n, count(DISTINCT law) AS laws, count_if(hop <= 1) AS single_hop, count_if(hop > 1) AS multi_hop, any_value(t.route) AS top_route FROM x JOIN t ON t.split = x.split AND t.k = 1 GROUP BY x.split""",
)
def split_profile(spark, sf_dir):
    i = F.col("doc_id") % 10
    x = table(spark, sf_dir, "documents").select(F.when(i < 7, "train").when(i < 9, "val").otherwise("test").alias("split"), F.col("source").alias("law"), F.col("lang").alias("route"), (F.col("doc_id") % 3).alias("hop"))
    return lookup.split_profile(x, "split", "law", "route", "hop")


@query(
    "augmentation_targets",
    """WITH n AS (SELECT count_if(doc_id % 4 < 2) AS a, count_if(doc_id % 4 = 2) AS b, count_if(doc_id % 4 = 3) AS c FROM documents),
t AS (SELECT CAST(greatest(250, floor(a * 0.35)) - b AS BIGINT) AS target_graph, CAST(greatest(200, floor(a * 0.30)) - c AS BIGINT) AS target_hybrid FROM n)
SELECT *, CAST(greatest(1, floor((target_graph + 1) / 2)) AS BIGINT) AS calls_graph, CAST(greatest(1, target_hybrid) AS BIGINT) AS calls_hybrid FROM t""",
)
def augmentation_targets(spark, sf_dir):
    k = F.col("doc_id") % 4
    return lookup.targets(table(spark, sf_dir, "documents").select(F.when(k < 2, lookup.DENSE).when(k == 2, lookup.GRAPH).otherwise(lookup.HYBRID).alias("routing_label")))


@query("next_page", "SELECT doc_id, lang FROM documents WHERE doc_id % 3 <> 0 ORDER BY doc_id LIMIT 25")
def next_page(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", F.when(F.col("doc_id") % 3 == 0, True).alias("done"))
    return lookup.next_page(d, "done", "doc_id", 25).select("doc_id", "lang")


@query(
    "metric_bests",
    """WITH c AS (SELECT l_returnflag AS config, CAST(sum(l_quantity) AS DOUBLE) AS quantity, CAST(count(*) AS DOUBLE) AS rows FROM lineitem GROUP BY 1),
m AS (SELECT config, 'quantity' AS metric, quantity AS value FROM c UNION ALL SELECT config, 'rows', rows FROM c)
SELECT metric, arg_min(config, (-value, config)) AS best, max(value) AS greatest, min(value) AS least FROM m GROUP BY metric""",
)
def metric_bests(spark, sf_dir):
    c = table(spark, sf_dir, "lineitem").groupBy(F.col("l_returnflag").alias("config")).agg(F.sum("l_quantity").alias("quantity"), F.count(F.lit(1)).alias("rows"))
    return lookup.best_of(c, "config", ["quantity", "rows"])


@query("column_migration", "SELECT conv_id, turn, role, CAST(NULL AS VARCHAR) AS route, CAST(NULL AS DOUBLE) AS confidence FROM conversations")
def column_migration(spark, sf_dir):
    return lookup.add_columns(table(spark, sf_dir, "conversations"), {"role": "string", "route": "string", "confidence": "double"}).select("conv_id", "turn", "role", "route", "confidence")


@query("source_summary", "SELECT source, count(*) AS n, array_to_string(list(lang ORDER BY doc_id)[1:3], '|') AS samples FROM documents GROUP BY source")
def source_summary(spark, sf_dir):
    return lookup.source_summary(table(spark, sf_dir, "documents"), "source", "doc_id", "lang").withColumn("samples", F.array_join("samples", "|"))


@query(
    "answer_predicates",
    """WITH x AS (SELECT conv_id, turn, CASE (conv_id + turn) % 6 WHEN 0 THEN 'Xin lỗi, KHÔNG  tìm thấy' WHEN 1 THEN 'HTTP 429: Too Many Requests' WHEN 2 THEN 'Lỗi khi tạo câu trả lời: x' WHEN 3 THEN 'Read Timeout' WHEN 4 THEN 'not  enough information' ELSE '' END || text AS t, text FROM conversations)
SELECT conv_id, turn, (conv_id + turn) % 6 IN (0, 4) AS uninformative, (conv_id + turn) % 6 = 1 OR (conv_id + turn) % 6 = 3 AS retryable, (conv_id + turn) % 6 IN (1, 2) AS error, length(trim(t)) >= 80 AS long_enough FROM x WHERE NOT regexp_matches(lower(text), '429|50[23]|quota|timeout|connection|rate.limit')""",
)
def answer_predicates(spark, sf_dir):
    k = (F.col("conv_id") + F.col("turn")) % 6
    head = F.when(k == 0, "Xin lỗi, KHÔNG  tìm thấy").when(k == 1, "HTTP 429: Too Many Requests").when(k == 2, "Lỗi khi tạo câu trả lời: x").when(k == 3, "Read Timeout").when(k == 4, "not  enough information").otherwise("")
    c = table(spark, sf_dir, "conversations").where(~F.rlike(F.lower("text"), F.lit("429|50[23]|quota|timeout|connection|rate.limit"))).select("conv_id", "turn", F.concat(head, "text").alias("t"))
    t = F.col("t")
    return c.select("conv_id", "turn", N.uninformative(t).alias("uninformative"), N.retryable(t).alias("retryable"), N.error_prediction(t).alias("error"), N.long_enough(t, "benchmark").alias("long_enough"))


@query(
    "full_text_terms",
    """SELECT item_id, '"' || replace(replace(w[1], '-', '\\-'), ':', '\\:') || '" OR "' || replace(w[2], '-', '\\-') || '\\*"' AS q FROM (SELECT item_id, regexp_extract_all(text, '[a-z]+') AS w FROM benchmark) WHERE len(w) >= 2""",
)
def full_text_terms(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark").select("item_id", F.regexp_extract_all("text", F.lit("[a-z]+"), F.lit(0)).alias("w")).where("size(w) >= 2")
    return b.select("item_id", N.full_text_query(F.array(F.col("w")[0], F.lit("  "), F.concat(F.col("w")[1], F.lit("* ")))).alias("q"))
