"""Exact vector search: cosine, top-k per query, filters before the cut, unions of searches, pinned ids."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision, left to right."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Null if either vector is null or zero."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n)


#: Query vectors up to so many bytes are broadcast and the index is read once; beyond, both sides meet in blocks.
BROADCAST_BYTES = 64 << 20
#: Rows of the index and queries of a block.
VECTOR_BLOCK, QUERY_BLOCK = 20_000, 2_000
#: Cosines that are held at once, in doubles.
CELLS = 1 << 22


def top_k(index: DataFrame, queries: DataFrame, k: int, id_col: str = "vec_id", vector: str = "embedding", query_vector: str = "query_vec") -> DataFrame:
    """The k nearest rows of the index for each query, by cosine, ties by id: query_id, id, score, rank.

    Rows and queries meet as matrix products; of each batch the k best rows a query are kept (and their ties), so few rows
    are moved. Null and zero vectors, and ones with null or NaN components, are in no result."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc(id_col))
    return _best(index, queries, k, [id_col], vector, query_vector).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _best(index: DataFrame, queries: DataFrame, k: int, keep: list[str], vector: str, query_vector: str, group: str | None = None) -> DataFrame:
    """The stated query set against all rows: query_id, what is kept of the row, score."""
    q = queries.select("query_id", query_vector)
    n = q.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max(F.size(query_vector)), F.lit(0)).alias("size")).first()
    if n["n"] * max(1, n["size"]) * 8 <= BROADCAST_BYTES:
        kind = T.StructType([q.schema["query_id"], *(index.schema[c] for c in keep), T.StructField("score", T.DoubleType())])
        asked = index.sparkSession.sparkContext.broadcast(q.toArrow())
        return index.select(*keep, vector).mapInArrow(lambda batches: _product(asked.value, k, keep, group)(batches), kind)
    return best_in_cells(index.withColumn("cell", F.lit(0)), q.withColumn("cell", F.lit(0)), k, keep, vector, query_vector, group)


def best_in_cells(index: DataFrame, queries: DataFrame, k: int, keep: list[str], vector: str, query_vector: str, group: str | None = None) -> DataFrame:
    """Rows of the index against the queries of their cell (both have `cell`, a bounded number of values). A cell's rows and
    queries are dealt over blocks, each pair of which is one task's group, so neither a large cell nor a popular one gathers."""
    kind = T.StructType([queries.schema["query_id"], *(index.schema[c] for c in keep), T.StructField("score", T.DoubleType())])
    parts = lambda n, most: F.greatest(F.ceil(F.col(n) / most), F.lit(1)).cast("int")
    sizes = index.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).join(queries.groupBy("cell").agg(F.count(F.lit(1)).alias("m")), "cell")
    blocks = F.broadcast(sizes.select("cell", parts("n", VECTOR_BLOCK).alias("vs"), parts("m", QUERY_BLOCK).alias("qs")))  # a row a cell
    turn = F.monotonically_increasing_id()
    left = index.select("cell", *keep, vector).withColumn("_t", turn).join(blocks, "cell").withColumn("v", F.pmod("_t", "vs")).withColumn("q", F.explode(F.sequence(F.lit(0), F.col("qs") - 1)))
    right = queries.select("cell", "query_id", query_vector).withColumn("_t", turn).join(blocks, "cell").withColumn("q", F.pmod("_t", "qs")).withColumn("v", F.explode(F.sequence(F.lit(0), F.col("vs") - 1)))
    left, right = left.select("cell", F.col("v").cast("int"), F.col("q").cast("int"), *keep, vector), right.select("cell", F.col("v").cast("int"), F.col("q").cast("int"), "query_id", query_vector)

    def pairs(rows: pa.Table, asked: pa.Table) -> pa.Table:
        found = _product(asked.select([3, 4]), k, keep, group)(rows.select(list(range(3, 4 + len(keep)))).to_batches())
        return pa.Table.from_batches(found, schema=pa.schema([asked.schema.field(3), *(rows.schema.field(3 + z) for z in range(len(keep))), pa.field("score", pa.float64())]))

    return left.groupBy("cell", "v", "q").cogroup(right.groupBy("cell", "v", "q")).applyInArrow(pairs, kind)


def _product(queries: pa.Table, k: int, keep: list[str], group: str | None):
    def units(column) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """Places and unit vectors of a list column, by length."""
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        size = np.array(column.value_lengths().fill_null(0))
        flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)  # nulls become NaN
        start, found = np.cumsum(size) - size, {}
        for d in np.unique(size[size > 0]).tolist():
            at = np.flatnonzero(size == d)
            x = flat[start[at][:, None] + np.arange(d)]
            length = np.sqrt((x * x).sum(1))
            fine = length > 0
            found[d] = at[fine], x[fine] / length[fine, None]
        return found

    asked, ids = units(queries.column(1)), queries.column(0).combine_chunks()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            groups = np.array(b.column(group).to_pylist(), object) if group else None
            for d, (at, x) in units(b.column(len(keep))).items():
                if d not in asked or not len(at):
                    continue
                qi, q = asked[d]
                sets = [np.arange(len(at))] if group is None else [np.flatnonzero(groups[at] == g) if g is not None else np.flatnonzero([v is None for v in groups[at]]) for g in dict.fromkeys(groups[at].tolist())]
                for mine in sets:
                    step = max(1, CELLS // len(mine))
                    for lo in range(0, len(qi), step):
                        cos = q[lo : lo + step] @ x[mine].T
                        if k < len(mine):
                            r, c = np.nonzero(cos >= np.partition(cos, len(mine) - k, axis=1)[:, len(mine) - k][:, None])
                        else:
                            r, c = (z.reshape(-1) for z in np.indices(cos.shape))
                        rows = b.take(pa.array(at[mine[c]]))
                        yield pa.RecordBatch.from_arrays([ids.take(pa.array(qi[lo + r])), *(rows.column(z) for z in range(len(keep))), pa.array(cos[r, c])], ["query_id", *keep, "score"])

    return run


def top_k_per(index: DataFrame, queries: DataFrame, group: str, k: int, id_col: str = "vec_id", vector: str = "embedding", query_vector: str = "query_vec") -> DataFrame:
    """The k nearest rows of each group for each query."""
    s = _best(index, queries, k, [id_col, group], vector, query_vector, group)
    w = Window.partitionBy("query_id", group).orderBy(F.desc("score"), id_col)
    return s.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def pin(found: DataFrame, pins: DataFrame, k: int, id_col: str = "vec_id") -> DataFrame:
    """Rows found by exact id first, with score 1, then the search's, without repeats, cut to k."""
    p = pins.select("query_id", id_col, F.lit(1.0).alias("score"), F.lit(True).alias("pinned"))
    rest = found.select("query_id", id_col, "score", F.lit(False).alias("pinned")).join(p.select("query_id", id_col), ["query_id", id_col], "left_anti")
    w = Window.partitionBy("query_id").orderBy(F.desc("pinned"), F.desc("score"), id_col)
    return p.unionByName(rest).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def normalised(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """Unit vectors of doubles, for an index that is written; null and zero vectors give null."""
    n = norm(F.col(vector))
    return df.withColumn(vector, F.when(n > 0, F.transform(vector, lambda x: x.cast("double") / n)))
