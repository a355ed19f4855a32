"""Steps before indexing and training, over documents, pages, conversations and the star schema."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.operators import prepare
from strandline.plans.registry import query, table
from strandline.sources.readers import spread


@query(
    "titled_chunks",
    r"""WITH w AS (SELECT doc_id, source, list_filter(regexp_split_to_array(CASE WHEN coalesce(source, '') <> '' THEN source || chr(10) || coalesce(text, '') ELSE coalesce(text, '') END, '[\s\x0B]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT doc_id, source, ws, unnest(range(0, len(ws), 224)) AS s FROM w) SELECT doc_id, source, CAST(s // 224 AS INTEGER) AS chunk_idx, md5(array_to_string(ws[s + 1 : s + 256], ' ')) AS chunk FROM s""",
)
def titled_chunks(spark, sf_dir):
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return prepare.titled_chunks(d, "source", "text").select("doc_id", "source", "chunk_idx", F.md5("chunk_text").alias("chunk"))


@query("whole_articles", "SELECT doc_id, md5(substr(trim(coalesce(text, '')), 1, 8000)) AS content FROM documents WHERE length(trim(coalesce(text, ''))) >= 50")
def whole_articles(spark, sf_dir):
    return prepare.whole_articles(table(spark, sf_dir, "documents"), "text").select("doc_id", F.md5("text").alias("content"))


@query(
    "rewritten_questions",
    "SELECT conv_id, turn, md5(regexp_replace(regexp_replace(coalesce(text, ''), 'ion', 'ION', 'g'), 'the ', 'that, ', 'g')) AS q FROM conversations WHERE role = 'user'",
)
def rewritten_questions(spark, sf_dir):
    """Rules one after the other, each over what the one before left."""
    c = table(spark, sf_dir, "conversations").where("role = 'user'")
    return c.select("conv_id", "turn", F.md5(prepare.rewritten(F.coalesce("text", F.lit("")), (("ion", "ION"), ("the ", "that, ")))).alias("q"))


@query(
    "node_summaries",
    """SELECT 'LegalArticle' AS label, p_name AS name, md5('Title: ' || coalesce(p_name, '') || chr(10) || 'Article ID: ' || p_partkey || chr(10) || 'Law ID: ' || coalesce(p_brand, '') || chr(10) || 'Content: ' || coalesce(p_type, '')) AS summary FROM part
UNION ALL SELECT 'VectorChunk', o_orderkey::VARCHAR, md5('Title: ' || chr(10) || 'Doc ID: ' || o_custkey || chr(10) || 'Vector chunk: ' || o_orderkey || chr(10) || 'Content: ' || coalesce(o_orderstatus, '')) FROM orders UNION ALL SELECT 'Nation', n_name, md5(n_name) FROM nation""",
)
def node_summaries(spark, sf_dir):
    """Nodes of three labels with a name by the first field they have, and a text by their label."""
    part = table(spark, sf_dir, "part").select(F.lit("LegalArticle").alias("label"), F.col("p_name").alias("title"), F.col("p_partkey").cast("string").alias("article_id"), F.col("p_brand").alias("doc_id"), F.col("p_type").alias("content"))
    chunk = table(spark, sf_dir, "orders").select(F.lit("VectorChunk").alias("label"), F.col("o_orderkey").cast("string").alias("chunk_id"), F.col("o_custkey").cast("string").alias("doc_id"), F.col("o_orderstatus").alias("content"))
    other = table(spark, sf_dir, "nation").select(F.lit("Nation").alias("label"), F.col("n_name").alias("name"), F.col("n_name").alias("content"))
    x = prepare.augmented(part, chunk, other)
    own = F.coalesce("article_id", "chunk_id")
    return x.select("label", prepare.display(x.columns, ("name", "title", "article_id", "chunk_id")).alias("name"), F.md5(prepare.summary(F.col("label"), F.col("title"), own, F.col("doc_id"), F.col("content"))).alias("summary"))


@query(
    "router_training_rows",
    """WITH r AS (SELECT item_id, trim(coalesce(text, '')) AS q, ['dense_retrieval', 'graph_traversal', 'hybrid_reasoning', 'other', ''][item_id % 5 + 1] AS label FROM benchmark)
SELECT label, 'qa_dataset' AS source, count(*) AS n, md5(string_agg(q, '|' ORDER BY md5(item_id::VARCHAR), q)) AS rows FROM r WHERE q <> '' AND label NOT IN ('other', '') GROUP BY label UNION ALL SELECT 'clarify', 'synthetic_clarify', 60, NULL""",
)
def router_training_rows(spark, sf_dir):
    """Questions with a known label in seeded order, and sixty made-up ones."""
    b = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("question"), F.get(F.array(*(F.lit(v) for v in ("dense_retrieval", "graph_traversal", "hybrid_reasoning", "other", ""))), (F.col("item_id") % 5).cast("int")).alias("routing_label"))
    x = prepare.training_rows(b, "item_id")
    rows = F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("order", "query"))), lambda s: s["query"]), "|"))
    return x.groupBy("label", "source").agg(F.count(F.lit(1)).alias("n"), rows.alias("rows")).withColumn("rows", F.when(F.col("source") == "qa_dataset", F.col("rows")))


@query(
    "chosen_sources",
    """WITH t AS (SELECT DISTINCT c_mktsegment AS s FROM customer ORDER BY s LIMIT 2) SELECT 'customers' AS source_name, count(*) AS n, count(DISTINCT c_mktsegment) AS topics FROM customer WHERE c_mktsegment IN (SELECT s FROM t)
UNION ALL SELECT 'orders', count(*), 0 FROM orders""",
)
def chosen_sources(spark, sf_dir):
    """All sources, one held to its first two topics."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("topic"))
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("key"))
    x = prepare.chosen({"customers": c, "orders": o}, "all", {"customers": ("topic", 2)})
    return x.groupBy("source_name").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("topic").alias("topics"))


@query(
    "value_normalise",
    """SELECT event_id, CASE WHEN event_id % 4 = 0 THEN event_type || '|' || user_id WHEN event_id % 4 = 1 THEN event_type ELSE '' END AS items, CASE WHEN event_id % 3 = 0 THEN false ELSE coalesce(try_cast(json_extract(props, '$.k') AS BIGINT), 0) <> 0 END AS k, false AS missing FROM events""",
)
def value_normalise(spark, sf_dir):
    """Lists and flags of a model's answer, made of the events' values: arrays with empty items, single texts, nothing."""
    quoted = F.concat(F.lit('"'), "event_type", F.lit('"'))
    said = F.when(F.col("event_id") % 4 == 0, F.concat(F.lit("["), quoted, F.lit(', "", null, '), "user_id", F.lit("]"))).when(F.col("event_id") % 4 == 1, quoted).when(F.col("event_id") % 4 == 2, F.lit('""'))
    flags = prepare.flags(F.when(F.col("event_id") % 3 == 0, F.lit("no object")).otherwise(F.col("props")), ("k", "missing"))
    e = table(spark, sf_dir, "events").select("event_id", F.array_join(prepare.string_list(said), "|").alias("items"), flags.alias("f"))
    return e.select("event_id", "items", "f.k", "f.missing")
