"""Benchmark building over documents as articles: quotas over three splits, partners, records."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.operators import benchmark
from strandline.plans.registry import query, table

#: Wanted rows; some pools are smaller than what all splits want.
_QUOTAS = {
    "train": {benchmark.DENSE: 60, benchmark.GRAPH: 40, benchmark.HYBRID: 50_000}, "dev": {benchmark.DENSE: 10, benchmark.GRAPH: 30_000, benchmark.HYBRID: 30}, "test": {benchmark.DENSE: 30, benchmark.GRAPH: 20, benchmark.HYBRID: 10},
}
_CHUNKS = r"""c AS (SELECT doc_id, source || '::' || doc_id AS canonical_id, source AS law, doc_id::VARCHAR AS article, trim(coalesce(text, ''), E' \t\n\r\f\x0B') AS content,
  CASE WHEN doc_id % 3 = 0 THEN 'Part ' || doc_id || '. ab' ELSE '1.' || doc_id % 9 || '. Điều ' || doc_id || '. Subject ' || lang || ' ' || doc_id % 13 || ' - Luật ' || source END AS title,
  CASE WHEN doc_id % 3 = 0 THEN 'ab' ELSE 'Subject ' || lang || ' ' || doc_id % 13 END AS topic, (doc_id + 20)::VARCHAR AS same_ref, 'src' || doc_id % 25 AS other_law,
  CASE WHEN doc_id % 10 < 5 THEN 'dense_retrieval' WHEN doc_id % 10 < 8 THEN 'graph_traversal' ELSE 'hybrid_reasoning' END AS label FROM documents WHERE doc_id % 6 <> 0),
u AS (SELECT * FROM c WHERE length(content) >= 80 AND coalesce(law, '') <> '')"""
_W = "w AS (SELECT * FROM (VALUES " + ", ".join(f"('{p}', '{s}', {sum(q[p] for q in list(_QUOTAS.values())[:k])}, {_QUOTAS[s][p]})" for k, s in enumerate(_QUOTAS) for p in _QUOTAS[s]) + ") v(label, split, b, want))"
_S = f"""{_W}, r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5(canonical_id), canonical_id) AS r, count(*) OVER (PARTITION BY label) AS n FROM u),
s AS (SELECT r.*, split, NOT (r > b AND r <= b + want) AS reused FROM r JOIN w USING (label) WHERE (r > b AND r <= b + want) OR (r <= b AND r <= want - greatest(0, least(want, n - b))))"""


def _chunks(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    k = F.col("doc_id")
    title = F.when(k % 3 == 0, F.concat(F.lit("Part "), k, F.lit(". ab"))).otherwise(F.concat(F.lit("1."), k % 9, F.lit(". Điều "), k, F.lit(". Subject "), "lang", F.lit(" "), k % 13, F.lit(" - Luật "), "source"))
    label = F.when(k % 10 < 5, benchmark.DENSE).when(k % 10 < 8, benchmark.GRAPH).otherwise(benchmark.HYBRID)
    return d.select(F.concat("source", F.lit("::"), k).alias("canonical_id"), (k % 6 != 0).alias("has_canonical_id"), F.col("source").alias("law_number"), title.alias("title"), F.col("text").alias("content"), label.alias("routing_label"), (k + 20).cast("string").alias("same_ref"), F.concat(F.lit("src"), k % 25).alias("other_law"))


@query("benchmark_quota_splits", f"WITH {_CHUNKS}, {_S} SELECT split, label AS routing_label, canonical_id, reused FROM s")
def benchmark_quota_splits(spark, sf_dir):
    """Splits take what they want of each pool, one after the other; only a dry pool gives rows again."""
    x = benchmark.quota_splits(benchmark.usable(_chunks(spark, sf_dir)), "routing_label", "canonical_id", _QUOTAS)
    return x.select("split", "routing_label", "canonical_id", "reused")


_PICK = "[('0x' || substr(md5(x.canonical_id), 1, 6))::BIGINT % 5 + 1]"


def _fill(templates, **values):
    sql = f"{list(templates)}{_PICK}"
    for name, v in values.items():
        sql = f"replace({sql}, '{{{name}}}', {v})"
    return sql


_TA, _TB = "CASE WHEN length(x.topic) >= 4 THEN x.topic ELSE 'Điều ' || x.article END", "CASE WHEN length(p.topic) >= 4 THEN p.topic ELSE 'Điều ' || p.article END"


@query(
    "benchmark_records",
    f"""WITH {_CHUNKS}, {_S}, o AS (SELECT law, canonical_id, row_number() OVER (PARTITION BY law ORDER BY md5(canonical_id), canonical_id) AS k FROM u),
q AS (SELECT s.*, CASE label WHEN 'graph_traversal' THEN coalesce(i.canonical_id, (SELECT arg_min(canonical_id, k) FROM o WHERE o.law = s.law AND o.canonical_id <> s.canonical_id AND k <= 2)) WHEN 'hybrid_reasoning' THEN h.canonical_id END AS partner
  FROM s LEFT JOIN (SELECT canonical_id FROM u) i ON i.canonical_id = s.law || '::' || s.same_ref LEFT JOIN (SELECT law, canonical_id, k FROM o) h ON h.law = s.other_law AND h.k = 1), x AS (SELECT *, CASE WHEN partner IS NULL THEN 'dense_retrieval' ELSE label END AS kind FROM q)
SELECT x.split, x.canonical_id, kind AS routing_label, CASE kind WHEN 'graph_traversal' THEN {_fill(benchmark.GRAPH_QUESTIONS, law='x.law', topic_a=_TA, topic_b=_TB)}
  WHEN 'hybrid_reasoning' THEN {_fill(benchmark.HYBRID_QUESTIONS, law_a='x.law', law_b='p.law', topic_a=_TA, topic_b=_TB)} ELSE 'Nội dung Điều ' || x.article || ' của văn bản ' || x.law || ' quy định như thế nào?' END AS question,
  md5(substr(CASE kind WHEN 'dense_retrieval' THEN x.content ELSE substr(x.content, 1, 1500) || chr(10) || chr(10) || substr(p.content, 1, 1400) END, 1, 3000)) AS answer,
  CASE kind WHEN 'dense_retrieval' THEN 1 ELSE 2 END AS hop_count, CASE kind WHEN 'dense_retrieval' THEN 0.35 WHEN 'graph_traversal' THEN 0.6 ELSE 0.65 END::DOUBLE AS difficulty, kind = 'hybrid_reasoning' AS is_cross_doc,
  CASE kind WHEN 'dense_retrieval' THEN x.canonical_id ELSE x.canonical_id || '|' || partner END AS relevant FROM x LEFT JOIN u p ON p.canonical_id = x.partner""",
)
def benchmark_records(spark, sf_dir):
    """Questions of the three kinds with partners: the article referred to, else another of the law; another law's; else dense."""
    a = benchmark.usable(_chunks(spark, sf_dir))
    rows = benchmark.partners(benchmark.quota_splits(a, "routing_label", "canonical_id", _QUOTAS), a)
    out = benchmark.records(rows, a)
    return out.select("split", "canonical_id", "routing_label", "question", F.md5("answer").alias("answer"), "hop_count", "difficulty", "is_cross_doc", F.array_join("relevant", "|").alias("relevant"))
