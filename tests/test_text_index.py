"""The full-text index: rows of the plain BM25, fewer postings scored, unions of two indexes, choice of terms."""

import random

import pytest
from pyspark.sql import functions as F

from strandline.operators import search, text_index
from strandline.operators.text_index import TextIndex


@pytest.fixture(scope="module")
def docs(spark):
    r = random.Random(4)
    common, rare = ["the", "of", "and", "to", "in"], [f"term{k}" for k in range(400)]
    rows = []
    for i in range(1500):
        n = r.randint(5, 120)
        rows.append((i, " ".join(r.choice(common) if r.random() < 0.7 else r.choice(rare) for _ in range(n)), r.choice(["alpha", "beta", None])))
    rows += [(3000, None, "gamma"), (3001, "", None), (3002, "The THE the", "alpha"), (3003, "term1 " * 3000, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, title string").cache()


def asked(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "query_id long, query string")


def rows(df):
    return sorted((x.query_id, x["rank"], x.doc, round(x.score, 6)) for x in df.collect())


def test_rows_are_those_of_the_plain_search(spark, docs, tmp_path):
    TextIndex.build(docs, str(tmp_path / "i"), "doc_id", ["text"])
    index = TextIndex(spark, str(tmp_path / "i"))
    q = asked(spark, "the term5 term17", "of and", "term399", "nothing here is", "", "the the term1 term2 term3 term4 of")
    for k in (1, 6, 200):
        assert rows(index.search(q, k)) == rows(search.bm25(docs, q, "doc_id", "text", k))
    scored, every = index.opened(asked(spark, "the of and term5 term17 term80"), 3)
    assert scored < 0.5 * every


def test_postings_are_gathered_before_they_move():
    import pyarrow as pa

    ts = [["a", "b", "a"], [], ["b"], ["a", "c", "c", "c"]]
    batch = pa.RecordBatch.from_arrays([pa.array([5, 6, 7, 8]), pa.array([len(t) for t in ts], pa.int32()), pa.array([0, 0, 1, 1], pa.int32()), pa.array([0, 0, 1, 1], pa.int32()), pa.array(ts, pa.list_(pa.string()))], ["doc", "len", "range", "part", "ts"])
    found = [r for b in text_index._gathered([batch]) for r in b.to_pylist()]
    parts = [r["part"] for r in found]
    assert len(parts) == len(set(parts))  # one row a part, however many postings
    got = sorted((t, d, g, n, f) for r in found for t, d, g, n, f in zip(r["term"], r["doc"], r["range"], r["len"], r["tf"]))
    assert got == [("a", 5, 0, 3, 2), ("a", 8, 1, 4, 1), ("b", 5, 0, 3, 1), ("b", 7, 1, 1, 1), ("c", 8, 1, 4, 3)]


def test_ranges_are_kept_without_their_terms(spark, docs, tmp_path):
    index = TextIndex.build(docs, str(tmp_path / "i"), "doc_id", ["text"])
    terms = asked(spark, "the of and term5").select("query_id", F.explode(F.split("query", " ")).alias("term"))
    known, ranges, found, n = index._survivors(terms, 3)
    with text_index._by_range(spark):  # postings are dealt by range alone, not once more for each query
        plan = index._opened(known, ranges, n)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(range" in plan and "hashpartitioning(query_id" not in plan
    assert ranges.columns == ["query_id", "range", "least", "weak_sum", "from"] and found.count() <= ranges.count()


def test_two_columns_are_one_text(spark, docs, tmp_path):
    index = TextIndex.build(docs, str(tmp_path / "i"), "doc_id", ["title", "text"])
    q = asked(spark, "gamma", "alpha term7")
    joined = docs.withColumn("text", F.concat_ws(" ", "title", "text"))
    assert rows(index.search(q, 5)) == rows(search.bm25(joined, q, "doc_id", "text", 5))
    assert rows(index.search(q, 5))[0][2] == 3000


def test_empty_tables(spark, docs, tmp_path):
    none = TextIndex.build(docs.where("false"), str(tmp_path / "i"), "doc_id", ["text"])
    assert none.search(asked(spark, "the"), 3).collect() == []
    index = TextIndex.build(docs, str(tmp_path / "j"), "doc_id", ["text"])
    assert index.search(asked(spark).where("false"), 3).collect() == []


def test_candidates_keep_the_best_score(spark, docs, tmp_path):
    a = TextIndex.build(docs.where("doc_id < 800"), str(tmp_path / "a"), "doc_id", ["text"])
    b = TextIndex.build(docs.where("doc_id >= 400"), str(tmp_path / "b"), "doc_id", ["text"])
    q = asked(spark, "term5 term6", "term100")
    got = {(r.query_id, r.doc): (r.score, r.label) for r in text_index.candidates(q, 4, ("a", a, 3), ("b", b, 2)).collect()}
    want = {}
    for label, index, n in (("a", a, 12), ("b", b, 8)):
        for r in index.search(q, n).collect():
            if (r.query_id, r.doc) not in want or r.score > want[(r.query_id, r.doc)][0]:
                want[(r.query_id, r.doc)] = (r.score, label)
    assert got == want


def test_select_terms(spark):
    entry = "array<struct<text:string,weight:double>>"
    rows = [
        ([("luật", 1.0), ("thuế", 1.0), (" phạt tiền ", 1.0), ("đất đai", 4.0), ("abc", 1.0), ("hợp đồng", None), ("thuế", 1.0), ("nặng", 3.0), ("", 9.0), (None, 9.0)], ["phạt tiền", "đất đai", "hợp đồng", "nặng", "thuế"]),
        ([(f"từ {k}", 1.0) for k in range(12)], [f"từ {k}" for k in range(8)]),
        ([], []),
    ]
    df = spark.createDataFrame([(r[0],) for r in rows], f"terms {entry}")
    assert [r.x for r in df.select(text_index.select_terms(F.col("terms")).alias("x")).collect()] == [r[1] for r in rows]
