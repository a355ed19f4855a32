"""Connected components by DataFrame joins."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm import common

ROUNDS = 60
#: Up to so many edges (16 bytes each), counted before, are settled in one task; more by joins.
LOCAL_EDGES = 500_000


def smallest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of the edges and the smallest node that each reaches: labels spread over edges, with pointer jumping."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y, root = at[: len(a)], at[len(a) :], np.arange(len(nodes))
    while len(x):
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        while True:
            jumped = new[new]
            if (jumped == new).all():
                break
            new = jumped
        if (new == root).all():
            break
        root = new
    return nodes, nodes[root]


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts = [(b.column("a").to_numpy(), b.column("b").to_numpy()) for b in batches]
    a, b = (np.concatenate([np.zeros(0, np.int64), *(p[k] for p in parts)]) for k in (0, 1))
    nodes, comp = smallest(a, b)
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(comp)], ["node", "comp"])


def components(edges: DataFrame) -> DataFrame:
    """edges: a, b (long). node, comp: each node's smallest reachable node, nodes of at least one edge.

    Few edges are settled in one task. Else alternating large-star and small-star steps; each takes a node's smallest neighbour by a partial aggregation and
    joins it back, so a hub's neighbours are never gathered in one task. Every step is cut off in the shared folder."""
    now = common.durable(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    if now.count() <= LOCAL_EDGES:
        return now.coalesce(1).mapInArrow(common.freeing(_settle), "node long, comp long")
    for _ in range(ROUNDS):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
        # large star: larger neighbours move to the smallest of all
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        # small star: smaller neighbours, and the node itself, move to the smallest of them
        joined = large.join(low, "a")
        small = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(joined.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        new = common.durable(small, "edges")
        n, left = new.count(), new.join(now, ["a", "b"], "left_anti").limit(1).count()
        same = left == 0 and n == now.count()
        common.discard(now)
        now = new
        if same:
            break
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("comp")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("comp")).distinct())
