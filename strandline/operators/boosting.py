"""Boosted trees for several classes: one regression tree a class and round on the gradients of the softmax loss.

Trees are grown by Spark's regression learner; a leaf's value is a Newton step, the sum of its rows' gradients over the sum of
their curvatures plus a ridge, from one aggregation by leaf. Trees are kept as small arrays, so scoring is one pass over Arrow
batches whatever their number, and margins are written after each round, so plans don't grow."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.sources import storage


@dataclass
class Tree:
    """feature (-1: a leaf), threshold, left, right, value by node; node 0 is the root. A row goes left where x <= threshold."""

    feature: list[int]
    threshold: list[float]
    left: list[int]
    right: list[int]
    value: list[float]

    def leaves(self, x: np.ndarray) -> np.ndarray:
        feature, threshold, left, right = (np.array(a) for a in (self.feature, self.threshold, self.left, self.right))
        at = np.zeros(len(x), np.int64)
        while (inner := feature[at] >= 0).any():
            rows = np.flatnonzero(inner)
            node = at[rows]
            at[rows] = np.where(x[rows, feature[node]] <= threshold[node], left[node], right[node])
        return at


def _parse(text: str) -> Tree:
    """The tree of a model's debug string, whose lines are If, Else and Predict in depth-first order."""
    lines = [line.strip() for line in text.splitlines()[1:] if line.strip()]
    tree = Tree([], [], [], [], [])

    def node(at: int) -> tuple[int, int]:
        me = len(tree.feature)
        for a, v in ((tree.feature, -1), (tree.threshold, 0.0), (tree.left, -1), (tree.right, -1), (tree.value, 0.0)):
            a.append(v)
        if m := re.match(r"If \(feature (\d+) <= (\S+)\)", lines[at]):
            tree.feature[me], tree.threshold[me] = int(m[1]), float(m[2])
            tree.left[me], at = node(at + 1)
            tree.right[me], at = node(at + 1)  # past Else
            return me, at
        return me, at + 1

    node(0)
    return tree


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


@dataclass
class Boosted:
    names: list[str]
    labels: list[str]
    rate: float
    start: list[float]
    rounds: list[list[Tree]]

    def _margins(self, x: np.ndarray) -> np.ndarray:
        f = np.tile(np.array(self.start), (len(x), 1))
        for trees in self.rounds:
            for k, t in enumerate(trees):
                f[:, k] += self.rate * np.array(t.value)[t.leaves(x)]
        return f

    def predict(self, df: DataFrame) -> DataFrame:
        """df with predicted, confidence, probabilities (in the order of labels). Features that df lacks, or are null, count as 0."""
        x = df.withColumn("_x", F.array(*(F.coalesce(F.col(n).cast("double"), F.lit(0.0)) if n in df.columns else F.lit(0.0) for n in self.names)))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                f = self._margins(_matrix(b.column(b.num_columns - 1)))
                p = np.exp(f - f.max(1, keepdims=True))
                yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(list(p / p.sum(1, keepdims=True)), pa.list_(pa.float64()))], [*b.schema.names[:-1], "probabilities"])

        out = x.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField("probabilities", T.ArrayType(T.DoubleType()))]))
        best = F.array_position("probabilities", F.array_max("probabilities")).cast("int") - 1
        return out.withColumns({"predicted": F.get(F.array(*(F.lit(v) for v in self.labels)), best), "confidence": F.array_max("probabilities")})

    def save(self, spark: SparkSession, path: str) -> None:
        """One JSON text, with the names of the features."""
        body = {"names": self.names, "labels": self.labels, "rate": self.rate, "start": self.start, "rounds": [[vars(t) for t in r] for r in self.rounds]}
        spark.createDataFrame([(json.dumps(body),)], "value string").coalesce(1).write.mode("overwrite").text(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Boosted:
        body = json.loads(spark.read.text(path).first()[0])
        return cls(body["names"], body["labels"], body["rate"], body["start"], [[Tree(**t) for t in r] for r in body["rounds"]])

    def importances(self) -> list[tuple[str, int]]:
        """How often each feature parts a node, the commonest first."""
        n = dict.fromkeys(self.names, 0)
        for trees in self.rounds:
            for t in trees:
                for f in t.feature:
                    if f >= 0:
                        n[self.names[f]] += 1
        return sorted(n.items(), key=lambda kv: (-kv[1], kv[0]))


def fit(df: DataFrame, names: list[str], label: str = "label", rounds: int = 20, depth: int = 4, rate: float = 0.3, ridge: float = 1.0, subsample: float = 1.0, seed: int = 42) -> Boosted:
    """df: the named features and a label (text, few values; rows without one are left out). Classes start at the logarithm of their
    share. With subsample, each round grows its trees on a seeded share of the rows."""
    counts = {r[label]: r["count"] for r in df.where(F.col(label).isNotNull()).groupBy(label).count().collect()}  # a row a class
    labels = sorted(counts, key=str)
    total = sum(counts.values())
    model = Boosted(list(names), [str(v) for v in labels], rate, [float(np.log(counts[v] / total)) for v in labels], [])
    y = F.array(*(F.when(F.col(label) == v, 1.0).otherwise(0.0) for v in labels))
    x = F.array(*(F.coalesce(F.col(n).cast("double"), F.lit(0.0)) for n in names))
    data = storage.cut(df.where(F.col(label).isNotNull()).select(x.alias("x"), y.alias("y"), F.array(*(F.lit(v) for v in model.start)).alias("f")), "boost")
    for r in range(rounds):
        most = F.array_max("f")
        e = F.transform("f", lambda v: F.exp(v - most))
        p = F.transform(e, lambda v: v / F.aggregate(e, F.lit(0.0), lambda s, u: s + u))
        now = data.withColumn("p", p)
        now = now.withColumn("g", F.zip_with("y", "p", lambda a, b: a - b))
        some = now if subsample >= 1 else now.sample(subsample, seed + r)
        some = some.withColumn("features", array_to_vector("x")).cache()
        trees = []
        for k in range(len(labels)):
            grown = DecisionTreeRegressor(featuresCol="features", labelCol="t", maxDepth=depth, seed=seed, minInstancesPerNode=2).fit(some.withColumn("t", F.col("g")[k]))
            tree = _parse(grown.toDebugString)
            at = _leaves(tree)
            sums = some.select("x", F.col("g")[k].alias("g"), (F.col("p")[k] * (1 - F.col("p")[k])).alias("h")).mapInArrow(at, "leaf long, g double, h double").groupBy("leaf").agg(F.sum("g").alias("g"), F.sum("h").alias("h"))
            for s in sums.collect():  # 2^depth rows at most
                tree.value[s["leaf"]] = s["g"] / (s["h"] + ridge)
            trees.append(tree)
        some.unpersist()
        model.rounds.append(trees)
        data = storage.cut(data.mapInArrow(_step(trees, rate), data.schema), "boost")
    return model


def _leaves(tree: Tree):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(tree.leaves(_matrix(b.column("x")))), b.column("g"), b.column("h")], ["leaf", "g", "h"])

    return run


def _step(trees: list[Tree], rate: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, f = _matrix(b.column("x")), _matrix(b.column("f"))
            for k, t in enumerate(trees):
                f[:, k] += rate * np.array(t.value)[t.leaves(x)]
            yield pa.RecordBatch.from_arrays([b.column("x"), b.column("y"), pa.array(list(f), pa.list_(pa.float64()))], ["x", "y", "f"])

    return run
