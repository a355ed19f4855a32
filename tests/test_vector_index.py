"""The index on disk: rows of the exact search, pruned folders, recall, appends, loads; blocks of many queries."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.operators import vector
from strandline.operators.vector_index import VectorIndex, recall

SCHEMA = "vec_id long, embedding array<float>, label int"


def clustered(n=3000, size=24, seed=5):
    r = np.random.Generator(np.random.PCG64(seed))
    centres = r.normal(size=(40, size))
    x = centres[r.integers(0, 40, n)] + 0.35 * r.normal(size=(n, size))
    return [(i, v.tolist(), i % 4) for i, v in enumerate(x.astype(np.float32))]


@pytest.fixture(scope="module")
def tables(spark):
    rows = clustered()
    rows += [(5000, None, 0), (5001, [0.0] * 24, 1), (5002, [1.0, 2.0], 1), (5003, [float("nan")] * 24, 2), (5004, [None] * 24, 2)]
    rows += [(6000 + i, rows[7][1], 3) for i in range(900)]  # a hot cell
    df = spark.createDataFrame(rows, SCHEMA).cache()
    return df, df.where("vec_id % 50 = 0 and vec_id < 5000").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vec"))


def rows(df):
    return sorted((r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in df.collect())


def test_all_cells_are_the_exact_search(spark, tables, tmp_path, monkeypatch):
    monkeypatch.setattr(vector, "VECTOR_BLOCK", 70)
    monkeypatch.setattr(vector, "QUERY_BLOCK", 7)
    df, q = tables
    VectorIndex.build(df.where("vec_id < 1500"), str(tmp_path / "i"), cells=20).append(df.where("vec_id >= 1500"))
    index = VectorIndex(spark, str(tmp_path / "i"))
    assert rows(index.search(q, 7)) == rows(vector.top_k(df.where("vec_id <> 5002"), q, 7))
    some = F.col("label") == 3
    assert rows(index.search(q, 3, where=some)) == rows(vector.top_k(df.where("vec_id <> 5002").where(some), q, 3))


def test_few_cells_have_recall_and_prune(spark, tables, tmp_path):
    df, q = tables
    index = VectorIndex.build(df, str(tmp_path / "i"), cells=40)
    found = index.search(q.limit(10), 10, probes=2)
    plan = found._jdf.queryExecution().explainString(spark.sparkContext._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "PartitionFilters: [cell" in plan
    r = recall(index.search(q, 10, probes=4), vector.top_k(df, q, 10)).first()
    assert r.queries == 60 and r.recall >= 0.9


def test_many_queries_meet_in_blocks(tables, monkeypatch):
    df, q = tables
    want = rows(vector.top_k(df, q, 4))
    per = sorted((r.query_id, r.label, r["rank"], r.vec_id) for r in vector.top_k_per(df, q, "label", 2).collect())
    monkeypatch.setattr(vector, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(vector, "VECTOR_BLOCK", 500)
    assert rows(vector.top_k(df, q, 4)) == want
    assert sorted((r.query_id, r.label, r["rank"], r.vec_id) for r in vector.top_k_per(df, q, "label", 2).collect()) == per


def test_an_empty_index(spark, tmp_path):
    none = spark.createDataFrame([], SCHEMA)
    index = VectorIndex.build(none, str(tmp_path / "i"))
    q = spark.createDataFrame([(1, [1.0, 0.5])], "query_id long, query_vec array<float>")
    assert index.search(q, 3).collect() == []
    assert index.append(spark.createDataFrame([(1, [1.0], 0)], SCHEMA)) is None
