"""Vector search over the embeddings table."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strandline.operators import dataset, evaluate, vector
from strandline.operators.vector_index import VectorIndex
from strandline.plans.registry import query, table
from strandline.sources import storage

#: The SQL of a cosine in double precision.
_COS = """list_inner_product(a.embedding::DOUBLE[], q.embedding::DOUBLE[])
  / (sqrt(list_inner_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_inner_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])))"""


def _queries(df, condition: str):
    return df.where(condition).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"))


@query(
    "vector_topk_exact",
    f"""WITH s AS (SELECT q.vec_id AS query_id, a.vec_id, {_COS} AS score FROM embeddings a CROSS JOIN (SELECT * FROM embeddings WHERE vec_id % 50 = 0) q),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, vec_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10""",
)
def vector_topk_exact(spark, sf_dir):
    emb = table(spark, sf_dir, "embeddings")
    return vector.top_k(emb, _queries(emb, "vec_id % 50 = 0"), 10).select("query_id", "vec_id", F.round("score", 6).alias("score"), "rank")


@query(
    "vector_topk_filtered",
    f"""WITH s AS (SELECT q.vec_id AS query_id, a.vec_id, {_COS} AS score FROM embeddings a CROSS JOIN (SELECT * FROM embeddings WHERE vec_id % 50 = 0) q WHERE a.label = 3),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, vec_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5""",
)
def vector_topk_filtered(spark, sf_dir):
    """The filter goes before the cut, not after it."""
    emb = table(spark, sf_dir, "embeddings")
    return vector.top_k(emb.where("label = 3"), _queries(emb, "vec_id % 50 = 0"), 5).select("query_id", "vec_id", F.round("score", 6).alias("score"), "rank")


@query(
    "vector_topk_per_label_union",
    f"""WITH s AS (SELECT q.vec_id AS query_id, a.vec_id, a.label, {_COS} AS score FROM embeddings a CROSS JOIN (SELECT * FROM embeddings WHERE vec_id % 50 = 0) q),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id, label ORDER BY score DESC, vec_id) AS k FROM s),
t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS g FROM r WHERE k <= 5),
a AS (SELECT query_id, label, max(score) AS best, count(*) AS hits FROM t WHERE g <= 12 GROUP BY 1, 2)
SELECT query_id, label, round(best, 6) AS best, hits FROM a""",
)
def vector_topk_per_label_union(spark, sf_dir):
    """Top k of each label, united, cut again, and aggregated."""
    emb = table(spark, sf_dir, "embeddings")
    found = vector.top_k_per(emb, _queries(emb, "vec_id % 50 = 0"), "label", 5)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    top = found.withColumn("g", F.row_number().over(w)).where("g <= 12")
    return top.groupBy("query_id", "label").agg(F.max("score").alias("best"), F.count(F.lit(1)).alias("hits")).withColumn("best", F.round("best", 6))


@query(
    "vector_overfetch_lowvalue",
    f"""WITH s AS (SELECT q.vec_id AS query_id, a.vec_id, {_COS} AS score FROM embeddings a CROSS JOIN (SELECT * FROM embeddings WHERE vec_id % 50 = 0) q),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS k FROM s),
d AS (SELECT r.*, d.text, NOT (contains(lower(coalesce(d.text, '')), 'reserved') OR contains(lower(coalesce(d.text, '')), 'password')) AS ok FROM r LEFT JOIN documents d ON d.doc_id = r.vec_id WHERE k <= 15),
f AS (SELECT *, bool_or(ok) OVER (PARTITION BY query_id) AS keep_all FROM d),
g AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM f WHERE ok OR NOT keep_all)
SELECT query_id, vec_id, round(score, 6) AS score, CAST(n AS INTEGER) AS rank FROM g WHERE n <= 5""",
)
def vector_overfetch_lowvalue(spark, sf_dir):
    """Three times what is wanted, less placeholders unless nothing else is left, cut to what is wanted."""
    emb, docs = table(spark, sf_dir, "embeddings"), table(spark, sf_dir, "documents").select("doc_id", "text")
    found = vector.top_k(emb, _queries(emb, "vec_id % 50 = 0"), 15)
    x = found.join(docs, found["vec_id"] == docs["doc_id"], "left")
    x = dataset.low_value_filter(x, "query_id", "text", ["reserved", "password"])
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return x.withColumn("n", F.row_number().over(w)).where("n <= 5").select("query_id", "vec_id", F.round("score", 6).alias("score"), F.col("n").alias("rank"))


@query(
    "exact_id_pin",
    f"""WITH q AS (SELECT vec_id AS query_id, embedding, vec_id + 1 AS pin FROM embeddings WHERE vec_id % 50 = 0),
s AS (SELECT q.query_id, q.pin, a.vec_id, {_COS} AS score FROM embeddings a CROSS JOIN q),
r AS (SELECT query_id, vec_id, CASE WHEN vec_id = pin THEN 1.0 ELSE score END AS score, vec_id = pin AS pinned FROM s),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY pinned DESC, score DESC, vec_id) AS rank FROM r)
SELECT query_id, vec_id, round(score, 6) AS score, pinned, CAST(rank AS INTEGER) AS rank FROM k WHERE rank <= 5""",
)
def exact_id_pin(spark, sf_dir):
    """An exact id comes first with score 1, the search's hits after it."""
    emb = table(spark, sf_dir, "embeddings")
    q = _queries(emb, "vec_id % 50 = 0")
    pins = q.select("query_id", (F.col("query_id") + 1).alias("vec_id")).join(emb.select("vec_id"), "vec_id")
    return vector.pin(vector.top_k(emb, q, 5), pins, 5).select("query_id", "vec_id", F.round("score", 6).alias("score"), "pinned", "rank")


@query(
    "hit_at_k",
    f"""WITH s AS (SELECT q.vec_id AS query_id, q.label AS gold, a.vec_id, a.label, {_COS} AS score FROM embeddings a CROSS JOIN (SELECT * FROM embeddings WHERE vec_id % 50 = 0) q WHERE a.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS k FROM s),
h AS (SELECT query_id, min(CASE WHEN label = gold THEN k END) AS first FROM r WHERE k <= 8 GROUP BY query_id)
SELECT count(*) AS n, round(avg(coalesce(first <= 1, false)::INT), 6) AS hit_1, round(avg(coalesce(first <= 3, false)::INT), 6) AS hit_3, round(avg(coalesce(first <= 5, false)::INT), 6) AS hit_5, round(avg(coalesce(first <= 8, false)::INT), 6) AS hit_8 FROM h""",
)
def hit_at_k(spark, sf_dir):
    emb = table(spark, sf_dir, "embeddings")
    q = _queries(emb, "vec_id % 50 = 0")
    found = vector.top_k(emb, q, 9).where("query_id <> vec_id").join(emb.select("vec_id", "label"), "vec_id")
    found = found.join(emb.select(F.col("vec_id").alias("query_id"), F.col("label").alias("gold")), "query_id")
    return evaluate.hit_at(found, "query_id", found["label"] == found["gold"], ["score desc", "vec_id"], (1, 3, 5, 8))


@query(
    "vector_index_all_cells",
    f"""WITH s AS (SELECT q.vec_id AS query_id, a.vec_id, {_COS} AS score FROM embeddings a CROSS JOIN (SELECT * FROM embeddings WHERE vec_id % 50 = 0) q),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, vec_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 10""",
)
def vector_index_all_cells(spark, sf_dir):
    """An index is written with half of the vectors, the rest is appended, and it is loaded and searched in every cell."""
    emb = table(spark, sf_dir, "embeddings")
    path = storage.scratch(spark, "vectors")
    VectorIndex.build(emb.where("vec_id % 2 = 0"), path).append(emb.where("vec_id % 2 <> 0"))
    return VectorIndex(spark, path).search(_queries(emb, "vec_id % 50 = 0"), 10).select("query_id", "vec_id", F.round("score", 6).alias("score"), "rank")


@query(
    "vector_index_filtered",
    f"""WITH s AS (SELECT q.vec_id AS query_id, a.vec_id, {_COS} AS score FROM embeddings a CROSS JOIN (SELECT * FROM embeddings WHERE vec_id % 50 = 0) q WHERE a.label IN (2, 5)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, vec_id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 5""",
)
def vector_index_filtered(spark, sf_dir):
    """A filter over stored columns holds before the cut."""
    emb = table(spark, sf_dir, "embeddings")
    index = VectorIndex.build(emb, storage.scratch(spark, "vectors"))
    return index.search(_queries(emb, "vec_id % 50 = 0"), 5, where=F.col("label").isin(2, 5)).select("query_id", "vec_id", F.round("score", 6).alias("score"), "rank")
