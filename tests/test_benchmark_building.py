"""Quotas over splits against a loop, partners with their fallbacks, topics of titles, records."""

import hashlib

import pytest
from pyspark.sql import functions as F

from strandline.operators import benchmark


@pytest.mark.parametrize("sizes", [{"a": 30, "b": 5}, {"a": 3, "b": 0}, {"a": 9, "b": 12}])
def test_quota_splits_are_those_of_the_loop(spark, sizes):
    quotas = {"train": {"a": 6, "b": 4}, "dev": {"a": 3, "b": 9}, "test": {"a": 8, "b": 2, "none": 5}}
    rows = [(p, f"{p}{k}") for p, n in sizes.items() for k in range(n)] + [("a", "a0"), ("other", "x")]
    got = {}
    for r in benchmark.quota_splits(spark.createDataFrame(rows, "pool string, key string"), "pool", "key", quotas).collect():
        got.setdefault((r.split, r.pool), set()).add((r.key, r.reused))
    want, used = {}, set()
    for split, q in quotas.items():
        for p, n in q.items():
            pool = sorted({k for x, k in rows if x == p}, key=lambda k: hashlib.md5(k.encode()).hexdigest())
            picked = [k for k in pool if k not in used][:n]
            used |= set(picked)
            again = [k for k in pool if k not in picked][: n - len(picked)]
            if picked or again:
                want[(split, p)] = {(k, False) for k in picked} | {(k, True) for k in again}
    assert got == want


def articles(spark):
    rows = [("L1::1", "L1"), ("L1::2", "L1"), ("L1::3", "L1"), ("L2::9", "L2"), ("L3::4", "L3"), ("bad", "L1"), ("L9::1", "")]
    df = spark.createDataFrame([(c, law, f"1.2. Điều {k}. Chủ đề {k} - Luật {law}", f"{c} " * 30, True) for k, (c, law) in enumerate(rows)], "canonical_id string, law_number string, title string, content string, has_canonical_id boolean")
    return benchmark.usable(df.unionByName(df.limit(1).withColumns({"canonical_id": F.lit("L1::7"), "content": F.lit("short")})))


def test_partners_and_records(spark):
    a = articles(spark)
    assert {r.canonical_id for r in a.collect()} == {"L1::1", "L1::2", "L1::3", "L2::9", "L3::4"}
    asked = [("L1::1", "L1", "graph_traversal", "2", None), ("L1::2", "L1", "graph_traversal", "77", None), ("L2::9", "L2", "graph_traversal", "1", None), ("L1::3", "L1", "hybrid_reasoning", None, "L3"), ("L3::4", "L3", "hybrid_reasoning", None, "L8"), ("L1::3", "L1", "dense_retrieval", "1", "L2")]
    rows = spark.createDataFrame(asked, "canonical_id string, law_number string, routing_label string, same_ref string, other_law string").withColumn("split", F.lit("dev"))
    x = benchmark.partners(rows, a)
    got = {(r.canonical_id, r.routing_label): (r.kind, r.partner) for r in x.collect()}
    assert got[("L1::1", "graph_traversal")] == ("graph_traversal", "L1::2") and got[("L1::2", "graph_traversal")][1] in ("L1::1", "L1::3")
    assert got[("L2::9", "graph_traversal")] == ("dense_retrieval", None) and got[("L1::3", "hybrid_reasoning")] == ("hybrid_reasoning", "L3::4")
    assert got[("L3::4", "hybrid_reasoning")] == ("dense_retrieval", None) and got[("L1::3", "dense_retrieval")] == ("dense_retrieval", None)
    out = {(r.canonical_id, r.routing_label): r for r in benchmark.records(x, a).collect()}
    r = out[("L1::1", "graph_traversal")]
    assert "Chủ đề 0" in r.question and "L1" in r.question and "{" not in r.question and r.answer == ("L1::1 " * 30).strip() + "\n\n" + ("L1::2 " * 30).strip() and r.relevant == ["L1::1", "L1::2"] and (r.hop_count, r.is_cross_doc, r.difficulty) == (2, False, 0.6)
    assert out[("L2::9", "dense_retrieval")].question == "Nội dung Điều 9 của văn bản L2 quy định như thế nào?" and out[("L2::9", "dense_retrieval")].hop_count == 1


def test_topics(spark):
    titles = {"39.1. Điều 5.2.LQ. Phạm vi điều chỉnh - Luật số 1": "Phạm vi điều chỉnh", "1.2. điều 7. 3.1.2. Đối tượng – phần sau": "Đối tượng", "Mục 1. Nguyên tắc - abc": "Nguyên tắc", "": "", "x" * 200: "x" * 80, None: ""}
    df = spark.createDataFrame([(t,) for t in titles], "t string")
    assert {r.t: r.x for r in df.select("t", benchmark.topic(F.col("t")).alias("x")).collect()} == titles
