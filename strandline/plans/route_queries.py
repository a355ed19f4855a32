"""Routes that run their pipelines, baselines that learn nothing, first-words search and the means of a leakage check."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.functions import routing
from strandline.operators import evaluate, search
from strandline.plans.registry import query, table
from strandline.sources.readers import spread

_ROUTES = ("dense_retrieval", "graph_traversal", "hybrid_reasoning", "clarify", "unheard_of")
_N = "(SELECT count(*) FROM documents)"
#: The pipelines of the query answer with a document's beginning; one without " the " says nothing.
_R = f"""r AS (SELECT conv_id * 1000 + turn AS query_id, {list(_ROUTES)}[(conv_id + turn * 3) % 5 + 1] AS asked FROM conversations), d AS (SELECT doc_id, substr(text, 1, 40) AS answer, source, contains(substr(text, 1, 40), ' the ') AS says FROM documents),
x AS (SELECT r.query_id, CASE WHEN asked = 'unheard_of' THEN 'dense_retrieval' ELSE asked END AS route, v.answer AS va, coalesce(v.says, false) AS vs, g.answer AS ga, coalesce(g.says, false) AS gs, CASE WHEN g.doc_id % 3 > 0 THEN g.source ELSE '' END AS kg, c.answer AS ca
  FROM r LEFT JOIN d v ON v.doc_id = query_id % 1009 LEFT JOIN d g ON g.doc_id = query_id * 7 % 1013 LEFT JOIN d c ON c.doc_id = query_id * 3 % 997),
y AS (SELECT *, CASE WHEN gs THEN ga ELSE va END AS gans, gs OR vs AS gsays, CASE WHEN coalesce(kg, '') = '' THEN CASE WHEN gs THEN 'graph_traversal' ELSE 'dense_retrieval' END WHEN gs THEN 'graph_traversal:' || kg ELSE 'graph_traversal:' || kg || '->dense_retrieval' END AS gpipe,
  CASE WHEN gs THEN coalesce(kg, '') WHEN coalesce(kg, '') = '' THEN 'vector' ELSE kg || '->vector' END AS gkg FROM x)"""


@query(
    "route_run",
    f"""WITH {_R} SELECT query_id, CASE route WHEN 'graph_traversal' THEN gans WHEN 'dense_retrieval' THEN CASE WHEN NOT vs AND gsays THEN gans ELSE va END ELSE ca END AS answer,
CASE route WHEN 'graph_traversal' THEN gpipe WHEN 'dense_retrieval' THEN CASE WHEN NOT vs AND gsays THEN 'dense_retrieval->' || gpipe ELSE route END WHEN 'hybrid_reasoning' THEN route || ':both' ELSE route END AS pipeline,
CASE route WHEN 'graph_traversal' THEN gkg WHEN 'dense_retrieval' THEN CASE WHEN NOT vs AND gsays THEN gkg ELSE '' END WHEN 'hybrid_reasoning' THEN 'both' ELSE '' END AS kg_source FROM y""",
)
def route_run(spark, sf_dir):
    """Every turn is answered by its route's pipeline; answers that say nothing fall back."""
    c = table(spark, sf_dir, "conversations")
    asked = c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), F.get(F.array(*(F.lit(r) for r in _ROUTES)), ((F.col("conv_id") + F.col("turn") * 3) % 5).cast("int")).alias("route"))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.substring("text", 1, 40).alias("answer"), "source")

    def by(key, kg):
        return lambda df: df.withColumn("doc_id", key).join(docs, "doc_id").withColumn("kg_source", kg).select("query_id", "answer", "kg_source")

    q = F.col("query_id")
    kg = F.when(F.col("doc_id") % 3 > 0, F.col("source")).otherwise("")
    pipelines = {"dense_retrieval": by(q % 1009, F.lit("")), "graph_traversal": by(q * 7 % 1013, kg), "hybrid_reasoning": lambda df: df.select("query_id").join(by(q * 3 % 997, F.lit("both"))(df), "query_id", "left").select("query_id", "answer", F.lit("both").alias("kg_source")), "clarify": by(q * 3 % 997, F.lit(""))}
    return routing.run_routes(asked, pipelines, lambda a: ~F.contains(a, F.lit(" the ")))


@query(
    "pattern_baselines",
    """SELECT doc_id, CASE WHEN contains(lower(text), 'wh') THEN 'hybrid_reasoning' WHEN contains(lower(text), 'und') THEN 'graph_traversal' ELSE 'dense_retrieval' END AS keyword,
CASE WHEN contains(lower(text), '|') THEN 'clarify' WHEN contains(lower(text), 'les') THEN 'dense_retrieval' WHEN contains(lower(text), 'zu') THEN 'graph_traversal' ELSE 'dense_retrieval' END AS three_rules FROM documents""",
)
def pattern_baselines(spark, sf_dir):
    """First pattern that matches; a route that training never saw becomes dense retrieval."""
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    keyword = routing.pattern_baseline(F.col("text"), {"hybrid_reasoning": "wh", "graph_traversal": "und"})
    three = routing.pattern_baseline(F.col("text"), {"clarify": r"\|", "hybrid_reasoning": "les", "graph_traversal": "zu"}, ("dense_retrieval", "graph_traversal", "clarify"))
    return d.select("doc_id", keyword.alias("keyword"), three.alias("three_rules"))


_STOP = list(search.STOP)


@query(
    "first_words_search",
    rf"""WITH w AS (SELECT item_id AS query_id, list_filter(list_transform(list_filter(regexp_split_to_array(lower(text), '[\s\x0B]+'), lambda x: x <> ''), lambda x: regexp_replace(x, '[^\p{{L}}\p{{N}}_\p{{M}}]', '', 'g')), lambda x: x <> '') AS c FROM benchmark),
f AS (SELECT query_id, list_filter(c, lambda x: NOT list_contains({_STOP}, x))[1:5] AS a, c[1:3] AS b FROM w), q AS (SELECT DISTINCT query_id, unnest(CASE WHEN len(a) > 0 THEN a ELSE b END) AS word FROM f),
h AS (SELECT DISTINCT query_id, doc_id FROM q JOIN documents d ON contains(lower(coalesce(d.source || chr(10), '') || coalesce(d.text, '')), word)) SELECT query_id, doc_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY doc_id) AS INTEGER) AS rank FROM h QUALIFY rank <= 5""",
)
def first_words_search(spark, sf_dir):
    """A question's first five words that aren't stop words, in two columns, first documents first."""
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return search.word_search(docs, q, "doc_id", 5, ["source", "text"])


@query(
    "leakage_means",
    r"""WITH t AS (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS ts, item_id % 5 = 0 AS test, row_number() OVER (ORDER BY md5(item_id::VARCHAR), item_id) AS r FROM benchmark),
p AS (SELECT CASE WHEN len(list_distinct(a.ts || b.ts)) > 0 THEN len(list_intersect(a.ts, b.ts)) / len(list_distinct(a.ts || b.ts))::DOUBLE ELSE 0 END AS j, a.test <> b.test AS crosses FROM t a JOIN t b ON b.r > a.r AND b.r <= a.r + 10 WHERE a.r <= 5000 AND b.r <= 5000)
SELECT round(coalesce(avg(j) FILTER (crosses), 0), 6) AS boundary_mean, round(coalesce(avg(j) FILTER (NOT crosses), 0), 6) AS within_mean, count(*) FILTER (crosses) AS boundary_pairs, count(*) FILTER (NOT crosses) AS within_pairs FROM p""",
)
def leakage_means(spark, sf_dir):
    b = table(spark, sf_dir, "benchmark").select("item_id", F.array_distinct(search.tokens(F.col("text"))).alias("ts"), (F.col("item_id") % 5 == 0).alias("split"))
    return evaluate.pair_means(b, "item_id", "ts", "split")
