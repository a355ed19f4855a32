"""Keyword search over documents and parts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strandline.operators import search, text_index
from strandline.operators.text_index import TextIndex
from strandline.plans.registry import query, table
from strandline.sources import storage
from strandline.sources.readers import spread

_T = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')"


@query("like_or_search", "SELECT doc_id, source FROM documents WHERE lower(text) LIKE '%idiot%' OR lower(text) LIKE '%pathetic%' OR lower(source) LIKE '%idiot%' ORDER BY doc_id LIMIT 20")
def like_or_search(spark, sf_dir):
    return search.like_any(table(spark, sf_dir, "documents"), ["text", "source"], ["idiot", "pathetic"]).select("doc_id", "source").orderBy("doc_id").limit(20)


@query(
    "bm25_search",
    rf"""WITH q AS (SELECT item_id AS query_id, list_distinct({_T}) AS ts FROM benchmark), qt AS (SELECT query_id, unnest(ts) AS term FROM q),
d AS (SELECT doc_id, {_T} AS ts FROM documents), st AS (SELECT count(*) AS n, avg(len(ts)) AS mean FROM d),
tf AS (SELECT term, doc_id, len, count(*) AS tf FROM (SELECT doc_id, len(ts) AS len, unnest(ts) AS term FROM d) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
s AS (SELECT query_id, doc_id AS doc, round(sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / mean))), 9) AS score FROM tf JOIN qt USING (term) JOIN df USING (term) CROSS JOIN st GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc) AS rank FROM s) SELECT query_id, doc, round(score, 4) AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5""",
)
def bm25_search(spark, sf_dir):
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return search.bm25(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), q, "doc_id", "text", 5).withColumn("score", F.round("score", 4))


_PARTS = {"almond": 4.0, "green": 5.0, "steel": 3.0, "small": 2.0, "brass": 6.0}
_KW = " + ".join(f"CASE WHEN contains(lower(name), '{w}') THEN {v} ELSE 0 END" for w, v in _PARTS.items())


@query(
    "metadata_weighted_search",
    f"""WITH p AS (SELECT p_partkey AS id, p_name || ' ' || p_type || ' ' || p_brand AS name FROM part), d AS (SELECT l_partkey AS id, count(*) AS degree FROM lineitem GROUP BY 1),
s AS (SELECT p.id, name, CAST({_KW} AS DOUBLE) AS score, coalesce(degree, 0) AS degree FROM p LEFT JOIN d USING (id)) SELECT id, name, score, degree FROM s WHERE score > 0 ORDER BY score DESC, degree DESC, length(name), id LIMIT 40""",
)
def metadata_weighted_search(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_name", "p_type", "p_brand").alias("name"))
    d = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("id")).agg(F.count(F.lit(1)).alias("degree"))
    s = p.withColumn("score", search.keyword_weight(F.col("name"), _PARTS)).where("score > 0").join(d, "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0)))
    return s.orderBy(F.desc("score"), F.desc("degree"), F.length("name"), "id").limit(40)


@query(
    "composite_score_rank",
    f"""WITH p AS (SELECT p_partkey AS id, p_brand AS query_id, p_name || ' ' || p_type AS name, CAST(p_size AS DOUBLE) / 5 AS score, p_size AS degree FROM part),
k AS (SELECT *, CAST({_KW} AS DOUBLE) AS kw, CASE WHEN contains(lower(name), 'green') THEN 1 ELSE 0 END + CASE WHEN contains(lower(name), 'brass') THEN 1 ELSE 0 END AS an FROM p),
r AS (SELECT *, 4 * kw + 8 * an + score + CASE WHEN degree > 25 THEN 8 ELSE 2 END - 10 * CASE WHEN contains(lower(name), 'small') AND contains(lower(name), 'steel') THEN 1 ELSE 0 END AS rank_score, kw >= 5 OR (score >= 8 AND kw >= 3) AS good FROM k),
f AS (SELECT *, bool_or(good) OVER (PARTITION BY query_id) AS some_good FROM r), g AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank_score DESC, degree DESC, length(name), name, id) AS rank FROM f WHERE good OR NOT some_good)
SELECT query_id, id, round(rank_score, 4) AS rank_score, CAST(rank AS INTEGER) AS rank FROM g WHERE rank <= 5""",
)
def composite_score_rank(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("query_id"), F.concat_ws(" ", "p_name", "p_type").alias("name"), (F.col("p_size") / 5).alias("score"), F.col("p_size").alias("degree"))
    x = search.composite(p, "name", _PARTS, "score", F.when(F.col("degree") > 25, 8).otherwise(2), "degree", "name", (("small", "steel"),))
    w = Window.partitionBy("query_id").orderBy(F.desc("rank_score"), F.desc("degree"), F.length("name"), "name", "id")
    return x.withColumn("rank", F.row_number().over(w)).where("rank <= 5").select("query_id", "id", F.round("rank_score", 4).alias("rank_score"), "rank")


@query("query_terms")
def query_terms(spark, sf_dir):
    q = table(spark, sf_dir, "benchmark").select("item_id", "text")
    return search.query_terms(q, "text", {"the", "and", "for"}, {"of the": 5.0}).select("item_id", F.to_json("terms").alias("terms"))


def _bm25_sql(name: str, docs: str, k: int) -> str:
    """CTEs of a BM25 search of the questions q(query_id, ts) over docs(doc, ts): name(query_id, doc, score) has the k best."""
    return rf"""{name}_d AS ({docs}), {name}_st AS (SELECT count(*) AS n, avg(len(ts)) AS mean FROM {name}_d),
{name}_tf AS (SELECT term, doc, len, count(*) AS tf FROM (SELECT doc, len(ts) AS len, unnest(ts) AS term FROM {name}_d) GROUP BY ALL), {name}_df AS (SELECT term, count(*) AS df FROM {name}_tf GROUP BY term),
{name}_s AS (SELECT query_id, doc, round(sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / mean))), 9) AS score
  FROM {name}_tf JOIN (SELECT query_id, unnest(ts) AS term FROM q) USING (term) JOIN {name}_df USING (term) CROSS JOIN {name}_st GROUP BY 1, 2),
{name} AS (SELECT query_id, doc, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc) AS rank FROM {name}_s) WHERE rank <= {k})"""


_ASKED = rf"q AS (SELECT item_id AS query_id, list_distinct({_T}) AS ts FROM benchmark)"


@query(
    "fulltext_index_search",
    f"WITH {_ASKED}, {_bm25_sql('a', f'SELECT doc_id AS doc, {_T} AS ts FROM documents', 10)} SELECT query_id, doc, round(score, 4) AS score FROM a",
)
def fulltext_index_search(spark, sf_dir):
    """A written index is loaded, and blocks that can't reach the ten best are left alone."""
    path = storage.scratch(spark, "texts")
    TextIndex.build(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), path, "doc_id", ["text"])
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return TextIndex(spark, path).search(q, 10).select("query_id", "doc", F.round("score", 4).alias("score"))


_TURNS = _T.replace("text", "role || ' ' || text")


@query(
    "fulltext_two_indexes",
    f"""WITH {_ASKED}, {_bm25_sql('a', f"SELECT 'd' || doc_id AS doc, {_T} AS ts FROM documents", 15)}, {_bm25_sql('b', f"SELECT 'c' || conv_id || '-' || turn AS doc, {_TURNS} AS ts FROM conversations", 10)},
u AS (SELECT *, 'document' AS label, 0 AS i FROM a UNION ALL SELECT *, 'turn' AS label, 1 AS i FROM b)
SELECT query_id, doc, round(max(score), 4) AS score, arg_max(label, score) AS label FROM u GROUP BY query_id, doc""",
)
def fulltext_two_indexes(spark, sf_dir):
    """Three times k of one index and twice k of another, each hit with its best score."""
    docs = table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), "doc_id").alias("doc"), "text")
    turns = table(spark, sf_dir, "conversations").select(F.concat(F.lit("c"), "conv_id", F.lit("-"), "turn").alias("doc"), "role", "text")
    a = TextIndex.build(docs, storage.scratch(spark, "texts"), "doc", ["text"])
    b = TextIndex.build(turns, storage.scratch(spark, "turns"), "doc", ["role", "text"])
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    return text_index.candidates(q, 5, ("document", a, 3), ("turn", b, 2)).select("query_id", "doc", F.round("score", 4).alias("score"), "label")


_GENERIC = ("the", "that", "this", "with", "from")


@query(
    "fulltext_term_choice",
    rf"""WITH t AS (SELECT item_id, {_T} AS ts FROM benchmark),
e AS (SELECT item_id, list_concat(list_transform(list_filter(range(1, len(ts)), lambda i: length(ts[i]) >= 8 AND length(ts[i + 1]) >= 8), lambda i: ts[i] || ' ' || ts[i + 1]), []::VARCHAR[]) AS phrases, ts FROM t),
f AS (SELECT item_id, list_concat(phrases, list_filter(ts, lambda x: length(x) >= 12)) AS strong, list_filter(ts, lambda x: length(x) < 12 AND length(x) >= 4 AND x NOT IN {_GENERIC}) AS weak FROM e),
w AS (SELECT item_id, strong, list_filter(weak, lambda x, i: list_position(weak, x) = i AND NOT list_contains(strong, x)) AS weak FROM f)
SELECT item_id, array_to_string(list_concat(strong, weak)[1:8], '|') AS terms FROM w""",
)
def fulltext_term_choice(spark, sf_dir):
    """Phrases of long words and words of twelve letters are heavy; others fill up to eight."""
    ts = search.tokens(F.col("text"))
    q = table(spark, sf_dir, "benchmark").select("item_id", ts.alias("ts"))
    entry = lambda t, w: F.struct(t.alias("text"), w.cast("double").alias("weight"))
    at = F.filter(F.sequence(F.lit(1), F.greatest(F.size("ts"), F.lit(1))), lambda i: (i < F.size("ts")) & (F.length(F.get("ts", i - 1)) >= 8) & (F.length(F.get("ts", i)) >= 8))
    phrases = F.transform(at, lambda i: entry(F.concat_ws(" ", F.get("ts", i - 1), F.get("ts", i)), F.lit(2.0)))
    words = F.transform("ts", lambda t: entry(t, F.when(F.length(t) >= 12, 3.0).otherwise(1.0)))
    return q.select("item_id", F.array_join(text_index.select_terms(F.concat(phrases, words), generic=_GENERIC), "|").alias("terms"))
