"""A vector index on disk: centroids, and vectors as Parquet in one folder per cell.

A search takes the nearest cells of each query, reads only their folders (partition pruning), and ranks what is in them
exactly. With all cells it gives the rows of vector.top_k. Centroids come from k-means by cosine over a bounded, seeded sample
of SAMPLE vectors; every vector is indexed. Vectors without a direction (null, zero, with null or NaN components) or of another
length than the first build's are in no result, and aren't written."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.operators import vector as vec
from strandline.sources import storage

SAMPLE, SEED = 50_000, 11
#: Cells at most: their centroids are broadcast, and their numbers are listed in the plan's partition filter.
MOST_CELLS = 4096


def _units(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Places and unit vectors of the rows that have a direction and the length."""
    n = np.array(column.value_lengths().fill_null(0))
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    at = np.flatnonzero(n == size)
    x = flat[(np.cumsum(n) - n)[at][:, None] + np.arange(size)]
    length = np.sqrt((x * x).sum(1))
    fine = (length > 0) & np.isfinite(length)
    return at[fine], x[fine] / length[fine, None]


def _cells(centroids, column: int, most: int):
    """Adds `cell` to the rows that have a direction: the nearest cells, `most` of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = centroids.value
        for b in batches:
            at, x = _units(b.column(column), c.shape[1])
            for lo in range(0, len(at), 4096):
                near = -(x[lo : lo + 4096] @ c.T)
                few = np.argsort(near, axis=1, kind="stable")[:, :most] if most > 1 else near.argmin(1)[:, None]
                rows = b.take(pa.array(np.repeat(at[lo : lo + 4096], few.shape[1])))
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(few.reshape(-1).astype(np.int32))], [*rows.schema.names, "cell"])

    return run


def with_cell(schema: T.StructType) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField("cell", T.IntegerType())])


class VectorIndex:
    """An index at a path; build() and the constructor give one."""

    def __init__(self, spark: SparkSession, path: str, id_col: str = "vec_id", vector: str = "embedding"):
        self.spark, self.path, self.id_col, self.vector = spark, path.rstrip("/"), id_col, vector
        rows = spark.read.parquet(f"{self.path}/centroids").orderBy("cell").collect()  # MOST_CELLS rows at most
        self.centroids = np.array([r["centroid"] for r in rows], np.float64)
        self._kind = T.StructType.fromJson(json.loads(rows[0]["vectors"]))
        self._sent = spark.sparkContext.broadcast(self.centroids)

    @classmethod
    def build(cls, vectors: DataFrame, path: str, id_col: str = "vec_id", vector: str = "embedding", cells: int | None = None) -> VectorIndex:
        """Writes a new index over whatever is at the path. All columns of `vectors` are kept for filters; none may be named
        cell. cells: by default the root of the number of vectors."""
        spark = vectors.sparkSession
        length = vec.norm(F.col(vector))
        some = vectors.where((length > 0) & (length < float("inf"))).orderBy(F.xxhash64(F.lit(SEED), F.col(id_col)), F.col(id_col)).limit(SAMPLE).select(F.transform(vector, lambda x: x.cast("double")).alias("v"))
        size = some.agg(F.mode(F.size("v"))).first()[0] or 0
        some = some.where(F.size("v") == size).select(array_to_vector("v").alias("features"))
        n = vectors.count()
        k = max(1, min(cells or int(n**0.5), MOST_CELLS, some.count() or 1))
        found = KMeans(k=k, distanceMeasure="cosine", seed=SEED, maxIter=10).fit(some).clusterCenters() if k > 1 else [np.ones(size)]
        c = np.array(found, np.float64).reshape(k, size)
        c = c / np.maximum(np.sqrt((c * c).sum(1)), 1e-300)[:, None]
        kind = T.StructType().add("cell", T.IntegerType()).add("centroid", T.ArrayType(T.DoubleType())).add("vectors", T.StringType())
        spark.createDataFrame([(i, row.tolist(), with_cell(vectors.schema).json()) for i, row in enumerate(c)], kind).coalesce(1).write.mode("overwrite").parquet(f"{path}/centroids")
        index = cls(spark, path, id_col, vector)
        index._write(vectors, "overwrite")
        return index

    def append(self, vectors: DataFrame) -> None:
        """Adds vectors to the cells that are there."""
        self._write(vectors, "append")

    def _write(self, vectors: DataFrame, mode: str) -> None:
        rows = vectors.mapInArrow(_cells(self._sent, vectors.columns.index(self.vector), 1), with_cell(vectors.schema))
        # a cell's rows go to few files; a large cell is split
        rows.hint("rebalance", "cell").write.mode(mode).partitionBy("cell").parquet(f"{self.path}/vectors")

    def vectors(self) -> DataFrame:
        return self.spark.read.schema(self._kind).parquet(f"{self.path}/vectors")

    def search(self, queries: DataFrame, k: int, probes: int | None = None, where: Column | None = None, query_vector: str = "query_vec") -> DataFrame:
        """query_id, id, score, rank: the k best rows of each query in its `probes` nearest cells (all without it), ties by id.
        The filter holds before the cut."""
        most = min(probes or len(self.centroids), len(self.centroids))
        q = queries.select("query_id", query_vector)
        asked = storage.cut(q.mapInArrow(_cells(self._sent, 1, most), with_cell(q.schema)), "probes")
        wanted = [r["cell"] for r in asked.select("cell").distinct().collect()]  # MOST_CELLS numbers at most
        rows = self.vectors().where(F.col("cell").isin(wanted))
        rows = rows if where is None else rows.where(where)
        found = vec.best_in_cells(rows, asked, k, [self.id_col], self.vector, query_vector)
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc(self.id_col))
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def recall(found: DataFrame, exact: DataFrame, id_col: str = "vec_id") -> DataFrame:
    """One row: the mean share of each query's exact rows that were found."""
    hit = exact.select("query_id", id_col).join(found.select("query_id", id_col).withColumn("_hit", F.lit(1.0)), ["query_id", id_col], "left")
    return hit.groupBy("query_id").agg(F.avg(F.coalesce("_hit", F.lit(0.0))).alias("r")).agg(F.avg("r").alias("recall"), F.count(F.lit(1)).alias("queries"))
