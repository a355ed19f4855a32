"""Dataset steps over documents, labels and benchmark."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strandline.functions import features, text
from strandline.operators import dataset, evaluate, search
from strandline.plans.registry import query, table
from strandline.sources.readers import spread

#: SQL: the words between ASCII white space.
_WORDS = r"list_filter(regexp_split_to_array(trim(text, E' \t\n\r\f\x0B'), '[\s\x0B]+'), lambda w: w <> '')"


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


@query(
    "chunk_words",
    f"""WITH w AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
s AS (SELECT doc_id, ws, unnest(range(0, len(ws), 224)) AS s FROM w)
SELECT doc_id, CAST(s // 224 AS INTEGER) AS chunk_idx, md5(array_to_string(ws[s + 1 : s + 256], ' ')) AS chunk_md5 FROM s""",
)
def chunk_words(spark, sf_dir):
    c = dataset.chunks(spread(_docs(spark, sf_dir).select("doc_id", "text")), "text")
    return c.select("doc_id", "chunk_idx", F.md5("chunk_text").alias("chunk_md5"))


@query(
    "chunk_length_stats",
    f"""WITH w AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
s AS (SELECT len(ws[s + 1 : s + 256]) AS n FROM (SELECT ws, unnest(range(0, len(ws), 224)) AS s FROM w))
SELECT count(*) AS chunks, min(n) AS shortest, max(n) AS longest, round(avg(n), 6) AS mean, round(quantile_cont(n, 0.5), 6) AS p50, round(quantile_cont(n, 0.9), 6) AS p90 FROM s""",
)
def chunk_length_stats(spark, sf_dir):
    c = dataset.chunks(_docs(spark, sf_dir).select("doc_id", "text"), "text").select(text.word_count(F.col("chunk_text")).alias("n"))
    return c.agg(F.count(F.lit(1)).alias("chunks"), F.min("n").cast("long").alias("shortest"), F.max("n").cast("long").alias("longest"), F.round(F.avg("n"), 6).alias("mean"), F.round(F.percentile("n", 0.5), 6).alias("p50"), F.round(F.percentile("n", 0.9), 6).alias("p90"))


@query("doc_key_topn", "SELECT source, count(*) AS n, count(DISTINCT lang) AS langs FROM documents GROUP BY source ORDER BY n DESC, source LIMIT 10")
def doc_key_topn(spark, sf_dir):
    return _docs(spark, sf_dir).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("lang").alias("langs")).orderBy(F.desc("n"), "source").limit(10)


@query(
    "truncation_flags",
    r"""WITH t AS (SELECT doc_id, trim(text, E' \t\n\r\f\x0B') AS t FROM documents)
SELECT doc_id, t <> '' AND NOT regexp_matches(t, '[.!?"'')\]]$') AS truncated, length(t) < 30 AS short, regexp_matches(t, '(\(|,| and| of| the)$') AS bad_end FROM t""",
)
def truncation_flags(spark, sf_dir):
    t = text.strip(F.col("text"))
    return _docs(spark, sf_dir).select("doc_id", text.looks_truncated(F.col("text")).alias("truncated"), (F.length(t) < 30).alias("short"), F.rlike(t, F.lit(r"(\(|,| and| of| the)$")).alias("bad_end"))


@query("first_occurrence_dedup", "SELECT min(doc_id) AS doc_id, md5(lower(trim(text))) AS norm_md5 FROM documents GROUP BY lower(trim(text))")
def first_occurrence_dedup(spark, sf_dir):
    d = dataset.distinct_questions(_docs(spark, sf_dir).select("doc_id", "text"), "text", ["doc_id"])
    return d.select("doc_id", F.md5(F.lower(F.trim("text"))).alias("norm_md5"))


@query("cap_k_per_key", "SELECT doc_id, source FROM (SELECT *, row_number() OVER (PARTITION BY coalesce(source, 'UNKNOWN') ORDER BY doc_id) AS k FROM documents) WHERE k <= 3")
def cap_k_per_key(spark, sf_dir):
    return dataset.cap_per_key(_docs(spark, sf_dir).select("doc_id", "source"), "source", ["doc_id"], 3)


@query("group_size_histogram", "SELECT size, count(*) AS groups FROM (SELECT count(*) AS size FROM documents GROUP BY md5(lower(trim(text)))) GROUP BY size")
def group_size_histogram(spark, sf_dir):
    return dataset.group_histogram(_docs(spark, sf_dir).select(F.md5(F.lower(F.trim("text"))).alias("k")), "k")


@query(
    "left_enrich_labels",
    """SELECT d.doc_id, coalesce(CAST(l.quality AS VARCHAR), '') AS gold_context, l.doc_id IS NOT NULL AS matched, CASE WHEN l.doc_id IS NOT NULL THEN 1 ELSE 0 END AS facts,
CASE WHEN l.doc_id IS NOT NULL AND length(d.lang) < 50 THEN CAST(l.quality AS VARCHAR) ELSE d.lang END AS evidence
FROM documents d LEFT JOIN (SELECT doc_id, max(quality) AS quality FROM labels GROUP BY doc_id) l USING (doc_id)""",
)
def left_enrich_labels(spark, sf_dir):
    corpus = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("string").alias("content"), F.col("toxic").cast("string").alias("law"), F.col("doc_id").cast("string").alias("article_id"))
    out = dataset.enrich(_docs(spark, sf_dir).select("doc_id", F.col("lang").alias("evidence")), corpus, "doc_id")
    return out.select("doc_id", "gold_context", (F.size("supporting_facts") > 0).alias("matched"), F.size("supporting_facts").alias("facts"), "evidence")


@query(
    "semi_both_ends",
    """SELECT l_partkey AS src, l_suppkey AS dst, l_orderkey, l_linenumber FROM lineitem
WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size < 25) AND l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 0)""",
)
def semi_both_ends(spark, sf_dir):
    e = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst"), "l_orderkey", "l_linenumber")
    p = table(spark, sf_dir, "part").where("p_size < 25").select("p_partkey")
    s = table(spark, sf_dir, "supplier").where("s_acctbal > 0").select("s_suppkey")
    return e.join(p, e["src"] == p["p_partkey"], "left_semi").join(s, e["dst"] == s["s_suppkey"], "left_semi")


@query("anti_done", "SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def anti_done(spark, sf_dir):
    return dataset.not_done(_docs(spark, sf_dir).select("doc_id", "lang"), table(spark, sf_dir, "labels"), "doc_id")


@query(
    "split_stratified",
    """WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) AS k, count(*) OVER (PARTITION BY lang) AS n FROM documents)
SELECT doc_id, lang, CASE WHEN k <= floor(n * 0.7::DOUBLE) THEN 'train' WHEN k <= floor(n * 0.7::DOUBLE) + floor(n * 0.15::DOUBLE) THEN 'dev' ELSE 'test' END AS split FROM r""",
)
def split_stratified(spark, sf_dir):
    return dataset.stratified_split(_docs(spark, sf_dir).select("doc_id", "lang"), "lang", "doc_id")


@query(
    "split_report",
    """WITH r AS (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) AS k, count(*) OVER (PARTITION BY lang) AS n FROM documents),
s AS (SELECT lang, CASE WHEN k <= floor(n * 0.7::DOUBLE) THEN 'train' WHEN k <= floor(n * 0.7::DOUBLE) + floor(n * 0.15::DOUBLE) THEN 'dev' ELSE 'test' END AS split FROM r)
SELECT split, lang, count(*) AS n, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (PARTITION BY lang), 4) AS percent FROM s GROUP BY split, lang""",
)
def split_report(spark, sf_dir):
    s = dataset.stratified_split(_docs(spark, sf_dir).select("doc_id", "lang"), "lang", "doc_id").groupBy("split", "lang").agg(F.count(F.lit(1)).alias("n"))
    return s.withColumn("percent", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy("lang")), 4))


@query(
    "difficulty_buckets",
    """WITH d AS (SELECT doc_id, (doc_id % 4)::INT AS hops, doc_id % 3 = 0 AS crossing, contains(lower(text), 'if') AS r FROM documents),
x AS (SELECT *, round(0.4::DOUBLE * least(hops / 3.0::DOUBLE, 1.0) + 0.3::DOUBLE * crossing::INT + 0.3::DOUBLE * r::INT, 2) AS difficulty,
 CASE WHEN hops <= 1 AND NOT crossing THEN 'dense_retrieval' WHEN hops >= 2 AND NOT crossing THEN 'graph_traversal' ELSE 'hybrid_reasoning' END AS route FROM d)
SELECT route, CASE WHEN difficulty <= 0.3 THEN 'easy' WHEN difficulty <= 0.6 THEN 'medium' ELSE 'hard' END AS bucket, count(*) AS n, min(difficulty) AS low, max(difficulty) AS high, round(avg(difficulty), 6) AS mean FROM x GROUP BY 1, 2""",
)
def difficulty_buckets(spark, sf_dir):
    d = _docs(spark, sf_dir).select((F.col("doc_id") % 4).cast("int").alias("hops"), (F.col("doc_id") % 3 == 0).alias("crossing"), F.contains(F.lower("text"), F.lit("if")).alias("r"))
    score = F.round(0.4 * F.least(F.col("hops") / 3, F.lit(1.0)) + 0.3 * F.col("crossing").cast("int") + 0.3 * F.col("r").cast("int"), 2)
    route = F.when((F.col("hops") <= 1) & ~F.col("crossing"), "dense_retrieval").when((F.col("hops") >= 2) & ~F.col("crossing"), "graph_traversal").otherwise("hybrid_reasoning")
    x = d.withColumn("difficulty", score).withColumn("route", route).withColumn("bucket", dataset.difficulty_bucket(F.col("difficulty")))
    return x.groupBy("route", "bucket").agg(F.count(F.lit(1)).alias("n"), F.min("difficulty").alias("low"), F.max("difficulty").alias("high"), F.round(F.avg("difficulty"), 6).alias("mean"))


@query("cv_folds", "SELECT doc_id, quality, CAST((row_number() OVER (PARTITION BY quality ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) - 1) % 5 AS INTEGER) AS fold FROM labels")
def cv_folds(spark, sf_dir):
    return dataset.folds(table(spark, sf_dir, "labels").select("doc_id", "quality"), "quality", "doc_id")


@query("class_weights", "SELECT quality, count(*) AS n, round(sum(count(*)) OVER () / (count(*) OVER () * count(*))::DOUBLE, 9) AS weight FROM labels GROUP BY quality")
def class_weights(spark, sf_dir):
    return dataset.class_weights(table(spark, sf_dir, "labels"), "quality").withColumn("weight", F.round("weight", 9))


@query(
    "quota_sample",
    """SELECT doc_id, lang FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) AS k FROM documents)
WHERE k <= CASE lang WHEN 'en' THEN 40 WHEN 'fr' THEN 20 WHEN 'de' THEN 5 ELSE 0 END""",
)
def quota_sample(spark, sf_dir):
    return dataset.quota_sample(_docs(spark, sf_dir).select("doc_id", "lang"), "lang", "doc_id", {"en": 40, "fr": 20, "de": 5})


@query(
    "funnel_counts",
    """SELECT 0 AS pos, 'raw' AS stage, count(*) AS n FROM documents UNION ALL SELECT 1, 'long', count(*) FROM documents WHERE length(trim(text)) >= 30
UNION ALL SELECT 2, 'distinct', count(DISTINCT lower(trim(text))) FROM documents WHERE length(trim(text)) >= 30""",
)
def funnel_counts(spark, sf_dir):
    raw = _docs(spark, sf_dir).select("doc_id", "text")
    long = raw.where(F.length(F.trim("text")) >= 30)
    return dataset.funnel(raw=raw, long=long, distinct=long.select(F.lower(F.trim("text"))).distinct())


@query("id_suffixes", "SELECT doc_id, CASE WHEN k > 1 THEN source || '_' || k ELSE source END AS uid FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents)")
def id_suffixes(spark, sf_dir):
    return dataset.suffix_duplicates(_docs(spark, sf_dir).select("doc_id", F.col("source").alias("uid")), "uid", ["doc_id"])


@query(
    "question_type",
    r"""WITH t AS (SELECT item_id, trim(lower(text)) AS q FROM benchmark)
SELECT item_id, CASE WHEN regexp_matches(q, 'có\s+(được|phải|cần|đúng|bắt buộc)|(được|có thể)\s+.*\s+không\s*\?|có\s+.*\s+hay\s+không|đúng không|phải không') THEN 'yes_no'
WHEN regexp_matches(q, 'nếu\s+.*\s+thì|trường\s+hợp\s+.*\s+(thì|sẽ|phải|được)|khi\s+nào\s+.*\s+(được|phải|cần)|trong\s+trường\s+hợp') THEN 'conditional'
WHEN regexp_matches(q, 'so\s+sánh|khác\s+nhau|giống\s+nhau|sự\s+khác\s+biệt|khác\s+gì|giống\s+gì|giữa\s+.*\s+và\s+') THEN 'comparison'
WHEN regexp_matches(q, 'là\s+gì|được\s+hiểu\s+như\s+thế\s+nào|nghĩa\s+là\s+gì|định\s+nghĩa|khái\s+niệm|nội\s+dung') THEN 'definition'
WHEN regexp_matches(q, 'thủ\s+tục|quy\s+trình|trình\s+tự|các\s+bước|hồ\s+sơ|cách\s+thức|làm\s+thế\s+nào|như\s+thế\s+nào') THEN 'procedural' ELSE 'factoid' END AS question_type FROM t""",
)
def question_type(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select("item_id", features.question_type(F.col("text")).alias("question_type"))


@query(
    "context_pack",
    """WITH r AS (SELECT doc_id, source, length(text) AS n, row_number() OVER (PARTITION BY source ORDER BY length(text) DESC, doc_id) AS k, sum(length(text)) OVER (PARTITION BY source ORDER BY length(text) DESC, doc_id ROWS UNBOUNDED PRECEDING) AS s FROM documents),
o AS (SELECT source, min(k) AS o FROM r WHERE s > 12000 AND k > 1 GROUP BY source)
SELECT r.doc_id, r.source, r.n FROM r LEFT JOIN o USING (source) WHERE o.o IS NULL OR r.k < o.o""",
)
def context_pack(spark, sf_dir):
    d = _docs(spark, sf_dir).select("doc_id", "source", F.length("text").cast("long").alias("n"))
    return dataset.pack(d, "source", [F.desc("n"), "doc_id"], F.col("n"), 12000)


@query(
    "jaccard_pairs",
    r"""WITH t AS (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS ts FROM benchmark)
SELECT a.item_id AS a, b.item_id AS b, round(CASE WHEN len(list_distinct(a.ts || b.ts)) > 0 THEN len(list_intersect(a.ts, b.ts)) / len(list_distinct(a.ts || b.ts))::DOUBLE ELSE 0 END, 6) AS jaccard FROM t a JOIN t b ON a.item_id < b.item_id
WHERE len(list_intersect(a.ts, b.ts)) > 0""",
)
def jaccard_pairs(spark, sf_dir):
    """Pairs that share a token, found through the tokens: no pair without one is looked at."""
    t = table(spark, sf_dir, "benchmark").select("item_id", F.array_distinct(search.tokens(F.col("text"))).alias("ts"))
    x = t.select("item_id", F.size("ts").alias("n"), F.explode("ts").alias("t"))
    y = x.select(F.col("item_id").alias("b"), F.col("n").alias("m"), "t")
    both = x.join(y, "t").where("item_id < b").groupBy(F.col("item_id").alias("a"), "b", "n", "m").agg(F.count(F.lit(1)).alias("k"))
    return both.select("a", "b", F.round(F.col("k") / (F.col("n") + F.col("m") - F.col("k")), 6).alias("jaccard"))


@query(
    "leakage_report",
    r"""WITH t AS (SELECT item_id, list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')) AS ts, item_id % 5 = 0 AS test FROM benchmark),
p AS (SELECT len(list_intersect(a.ts, b.ts)) / len(list_distinct(a.ts || b.ts))::DOUBLE AS j, a.test <> b.test AS crossing FROM t a JOIN t b ON a.item_id < b.item_id WHERE len(list_intersect(a.ts, b.ts)) > 0)
SELECT count(*) FILTER (j >= 0.06) AS high, count(*) FILTER (j >= 0.06 AND crossing) AS crossing, round(coalesce(count(*) FILTER (j >= 0.06 AND crossing) / nullif(count(*) FILTER (j >= 0.06), 0)::DOUBLE, 0), 6) AS rate FROM p""",
)
def leakage_report(spark, sf_dir):
    t = table(spark, sf_dir, "benchmark").select("item_id", F.array_distinct(search.tokens(F.col("text"))).alias("ts"))
    p = evaluate.similar_pairs(t, "item_id", "ts", 0.06).select("jaccard", (F.col("a") % 5 == 0).alias("sa"), (F.col("b") % 5 == 0).alias("sb"))
    return evaluate.leakage(p, "jaccard", "sa", "sb", 0.06)


@query("f1_by_group", "SELECT CASE WHEN grouping(toxic) = 1 THEN NULL ELSE toxic END AS toxic, count(*) AS n, round(avg(quality), 6) AS mean, CAST(grouping(toxic) AS TINYINT) AS total FROM labels GROUP BY ROLLUP (toxic)")
def f1_by_group(spark, sf_dir):
    return evaluate.by_group(table(spark, sf_dir, "labels"), "toxic", "quality")


_RULE = "CASE WHEN contains(d.text, '|') OR contains(d.text, '%%%') THEN 0 ELSE 1 END"


def _judged(spark, sf_dir):
    j = table(spark, sf_dir, "labels").select("doc_id", "quality").join(_docs(spark, sf_dir).select("doc_id", "text"), "doc_id")
    return j.select("quality", F.when(F.contains("text", F.lit("|")) | F.contains("text", F.lit("%%%")), 0).otherwise(1).alias("pred"))


@query("confusion_matrix", f"SELECT l.quality, {_RULE} AS pred, count(*) AS n FROM labels l JOIN documents d USING (doc_id) GROUP BY 1, 2")
def confusion_matrix(spark, sf_dir):
    return evaluate.confusion(_judged(spark, sf_dir), "quality", "pred")


@query(
    "confusion_macro_f1",
    f"""WITH p AS (SELECT l.quality AS t, {_RULE} AS p FROM labels l JOIN documents d USING (doc_id)),
c AS (SELECT c.c, count(*) FILTER (t = c AND p = c) AS tp, count(*) FILTER (t <> c AND p = c) AS fp, count(*) FILTER (t = c AND p <> c) AS fn FROM p CROSS JOIN (SELECT unnest([0, 1]) AS c) c GROUP BY c.c)
SELECT (SELECT count(*) FROM p) AS n, (SELECT round(avg((t = p)::INT), 6) FROM p) AS accuracy, round(avg(2.0::DOUBLE * tp / (2 * tp + fp + fn)), 6) AS macro_f1 FROM c""",
)
def confusion_macro_f1(spark, sf_dir):
    return evaluate.summary(_judged(spark, sf_dir), "quality", "pred")
