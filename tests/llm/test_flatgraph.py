"""The flat graph against brute force: crowds, split shards, the pass over blocks, counts from both ends."""

from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandline.llm import flatgraph


def embeddings(seed):
    r = np.random.Generator(np.random.PCG64(seed))
    rows = []
    for k in range(900):
        x = r.normal(size=12)
        if k % 3 and rows:
            x = np.array(rows[-1][2]) + r.normal(size=12) * 0.12
        rows.append((k, int(r.integers(0, 2)) if not k % 3 else rows[-1][1], [float(np.float32(v)) for v in x]))
    rows += [(2000 + k, 1, [v + 1e-3 * k for v in rows[4][2]]) for k in range(40)]
    return rows + [(3000, 1, None), (3001, 1, [0.0] * 12), (3002, 1, [float("nan")] * 12), (3003, None, rows[3][2]), (3004, 1, [None] * 12), (3005, 1, []), (3006, 0, [1.0, 2.0]), (3007, 0, [1.0, 2.0]), (5, rows[5][1], rows[5][2]), (3008, 1, [float("inf")] * 12)]


def truth(rows):
    fine = [k for k, (_, l, v) in enumerate(rows) if l is not None and v and None not in v and np.isfinite(v).all() and np.any(v)]
    n, low, linked = [0] * len(rows), [r[0] for r in rows], []
    for i, j in combinations(fine, 2):
        if rows[i][1] == rows[j][1] and len(rows[i][2]) == len(rows[j][2]):
            a, b = np.array(rows[i][2]), np.array(rows[j][2])
            if a @ b / np.sqrt((a @ a) * (b @ b)) >= 0.93:
                linked.append((i, j))
                n[i] += 1
                n[j] += 1
    changed = True
    while changed:
        changed = False
        for i, j in linked:
            if low[i] != low[j]:
                low[i] = low[j] = min(low[i], low[j])
                changed = True
    return sorted((r[0], n[k], low[k]) for k, r in enumerate(rows))


def found(spark, rows):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, label int, embedding array<double>, links string, hub int")
    return sorted((r.vec_id, r.n_links, r.component_id) for r in flatgraph.near_duplicates(df).collect())


@pytest.mark.parametrize("most, crowd, enough", [(3000, 8, 0.97), (150, 8, 0.97), (150, 10**6, 0.97), (3000, 8, 2), (100, 10**6, 2)])
def test_flat_graph(spark, monkeypatch, most, crowd, enough):
    for name, value in (("MOST", most), ("CROWD", crowd), ("ENOUGH", enough), ("BLOCK", 90), ("SPLIT_SAMPLE", 200)):
        monkeypatch.setattr(flatgraph, name, value)
    rows = embeddings(7)
    got, want = found(spark, rows), truth(rows)
    if enough > 1:  # no recall is enough: all rows are compared
        assert got == want
    assert len(got) == len(want) and all(a[0] == b[0] and a[1] <= b[1] for a, b in zip(got, want))
    assert sum(x[1] for x in got) >= 0.97 * sum(x[1] for x in want)
    assert sum(x[1] for x in got) % 2 == 0  # every link counts for both ends
    assert np.mean([a == b for a, b in zip(got, want)]) > 0.95


def test_crowds_and_their_shells(spark, monkeypatch):
    """A third of all rows in one crowd, others at all angles around it: members' links are exact without a graph."""
    monkeypatch.setattr(flatgraph, "BLOCK", 100)
    r = np.random.Generator(np.random.PCG64(2))
    center = r.normal(size=16)
    rows = [(k, 3, (center * (1 + k) + r.normal(size=16) * (1 + k) * 0.03).tolist()) for k in range(300)]
    rows += [(1000 + k, 3, (center + r.normal(size=16) * 0.05 * (1 + k % 12)).tolist()) for k in range(400)]
    rows += [(2000 + k, 3, r.normal(size=16).tolist()) for k in range(200)]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    rest, crowd = flatgraph.crowds(flatgraph.classes(df), 0.93)
    members = {x.cid for x in flatgraph.classes(df).collect()} - {x.cid for x in rest.collect()}
    assert len(members) > 250
    got = {x.cid: x.n for x in crowd.groupBy("cid").agg({"links": "sum"}).withColumnRenamed("sum(links)", "n").collect()}
    n = {i: k for i, k, _ in truth(rows)}
    ids = {x.cid: x.rep for x in flatgraph.classes(df).collect()}
    assert all(got[c] == n[ids[c]] for c in members)
    assert found(spark, rows) == truth(rows)


def test_empty_table_and_query(spark, tmp_path):
    df = spark.createDataFrame([(k, 1, [1.0, float(k % 3)]) for k in range(9)], "vec_id long, label int, embedding array<float>")
    assert flatgraph.near_duplicates(df.limit(0)).count() == 0
    df.write.parquet(str(tmp_path / "embeddings.parquet"))
    out = flatgraph.op9_flatgraph(spark, str(tmp_path))
    assert out.dtypes == [("vec_id", "bigint"), ("n_links", "bigint"), ("component_id", "bigint"), ("kept", "boolean")]
    assert [tuple(x) for x in out.orderBy("vec_id").collect()] == [(k, 5 if k % 3 else 2, 1 if k % 3 else 0, k < 2) for k in range(9)]


def test_a_crowd_does_not_hide_what_the_searches_lose(spark, monkeypatch, caplog):
    """600 vectors in a crowd, 300 pairs beside it, and searches that find nothing: the audit sees it, and all are compared."""
    r = np.random.Generator(np.random.PCG64(8))
    middle = r.normal(size=24)
    rows = [(k, 1, (middle + 0.01 * r.normal(size=24)).tolist()) for k in range(600)]
    for k in range(300):
        x = r.normal(size=24)
        rows += [(1000 + 2 * k, 1, x.tolist()), (1001 + 2 * k, 1, (x + 0.03 * r.normal(size=24)).tolist())]
    monkeypatch.setattr(flatgraph, "graph_links", lambda rest, overlap, threshold: rest.select("cid", F.lit(0).cast("long").alias("links"), F.col("cid").alias("root")))
    with caplog.at_level("INFO"):
        got = {i: n for i, n, _ in found(spark, rows)}
    assert sum(got[i] >= 1 for i in range(1000, 1600)) == 600 and min(got[k] for k in range(600)) >= 599
    said = [float(m.message.rsplit(" ", 1)[1]) for m in caplog.records if "outside crowds" in m.message]
    assert said[0] == 0 and said[-1] == 1
