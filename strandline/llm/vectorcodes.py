"""Vector code compression: product codes learned by weighted Lloyd rounds over distinct parts.

A component x becomes the integer floor(4096 * x); a vector is cut into PARTS equal consecutive parts. Equal integer parts
of a position are one row with a weight, so a vector that a third of all rows repeat costs one row and is counted before
the shuffle. Each round is one pass over these rows, with the codebooks (PARTS x ENTRIES parts) in the tasks' closure and
one row of sums per entry and component coming back. Codes and errors are then joined back to the vectors; parts that many
vectors share are dealt over several salted copies of their row.

Defined cases: vectors that are null or hold null, infinite or not-a-number components are dropped, as are those whose
length isn't that of the vector with the smallest id, or isn't a positive multiple of PARTS. Integers are held to +-2^k
with the largest k for which no distance can overflow (k = 27 at 64 components: components beyond +-32768 count as that).
Repeated rows are vectors of their own; the seeds are the smallest distinct ids (null last), each with the smallest of its
vectors by components. With fewer ids than entries the codebooks have as many entries as there are ids. Equal distances go
to the lower index. A label whose error sum passes a long gets null. An empty table gives an empty result."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.llm import common

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
#: A part or label of more rows than the whole divided by this is dealt over salted copies; so at most PARTS * SHARE values are broadcast.
SHARE = 512
#: So many labels (some 30 bytes each) are broadcast; more are joined by shuffle.
BROADCAST_LABELS = 200_000


def bound(size: int) -> int:
    """The limit of integer components for which the distance of two vectors of this size fits a long."""
    return 1 << min(30, (60 - (size - 1).bit_length()) // 2)


def finite(vector: Column) -> Column:
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))


def integers(vector: Column, scale: int, most: int) -> Column:
    return F.transform(vector, lambda x: F.floor(F.least(F.greatest(x.cast("double") * F.lit(float(scale)), F.lit(float(-most))), F.lit(float(most)))).cast("int"))


def _nearest(pos: np.ndarray, part: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of each part's nearest entry, the lower one of equals, and the squared distance."""
    code, err = np.zeros(len(pos), np.int64), np.zeros(len(pos), np.int64)
    for p in range(len(books)):
        at = np.flatnonzero(pos == p)
        x, best = part[at], np.full(len(at), np.iinfo(np.int64).max)
        which = np.zeros(len(at), np.int64)
        for e, entry in enumerate(books[p]):
            gap = x - entry
            d = np.einsum("ij,ij->i", gap, gap)
            closer = d < best
            best[closer], which[closer] = d[closer], e
        code[at], err[at] = which, best
    return code, err


def _arrays(b: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    part = b.column("part").flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, width)
    return b.column("pos").to_numpy(), part, b.column("n").to_numpy()


def _sums(books: np.ndarray):
    parts, entries, width = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, count = np.zeros((parts * entries, width), np.int64), np.zeros(parts * entries, np.int64)
        for b in batches:
            pos, part, n = _arrays(b, width)
            slot = pos * entries + _nearest(pos, part, books)[0]
            np.add.at(total, slot, part * n[:, None])
            np.add.at(count, slot, n)
        used = np.flatnonzero(count)
        slot, at = np.repeat(used, width), np.tile(np.arange(width), len(used))
        yield pa.RecordBatch.from_arrays([pa.array(slot), pa.array(at), pa.array(total[slot, at]), pa.array(count[slot])], ["slot", "at", "total", "n"])

    return run


def _assign(books: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            code, err = _nearest(*_arrays(b, books.shape[2])[:2], books)
            yield pa.RecordBatch.from_arrays([b.column("pos"), b.column("part"), b.column("n"), pa.array(code), pa.array(err)], ["pos", "part", "n", "code", "err"])

    return run


def seeds(kept: DataFrame, entries: int) -> list[list[int]]:
    """Integer vectors of the smallest distinct ids. kept: vec_id, v."""
    ids = [r.vec_id for r in kept.select("vec_id").distinct().orderBy(F.asc_nulls_last("vec_id")).limit(entries).collect()]
    named = F.col("vec_id").isin([i for i in ids if i is not None])
    rows = kept.where(named | F.col("vec_id").isNull() if None in ids else named).groupBy("vec_id").agg(F.min("v").alias("v")).collect()
    found = {r.vec_id: list(r.v) for r in rows}
    return [found[i] for i in ids]


def lloyd(parts: DataFrame, books: np.ndarray, rounds: int) -> np.ndarray:
    """Codebooks after the rounds. parts: pos (int), part (array of int), n (long), each (pos, part) once."""
    for _ in range(rounds):
        found = parts.mapInArrow(_sums(books), "slot long, at long, total long, n long").groupBy("slot", "at").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total"), F.sum("n").alias("n"))
        flat = books.reshape(-1, books.shape[2]).copy()
        for r in found.collect():  # one row an entry and component
            flat[r.slot, r.at] = int(r.total) // r.n
        if (flat.reshape(books.shape) == books).all():  # every further round would give the same
            break
        books = flat.reshape(books.shape)
    return books


def salted(rows: DataFrame, table: DataFrame, keys: list[str], total: int, by: Column) -> DataFrame:
    """rows joined with the table's row of the same keys (nulls equal). table: keys, n (rows with these keys) and others.

    Keys of more than total / SHARE rows, which are few, are broadcast with their number of copies; each such row goes to the
    copy that `by` names."""
    copies = F.ceil(F.col("n") * F.lit(SHARE) / F.lit(float(max(total, 1)))).cast("int")
    named = table.withColumns({f"_{k}": F.col(k) for k in keys}).drop(*keys).withColumn("_copies", F.greatest(copies, F.lit(1)))
    many = named.where("_copies > 1").select(*(F.col(f"_{k}").alias(f"_hot_{k}") for k in keys), "_copies")
    same = lambda prefix: [F.col(k).eqNullSafe(F.col(f"{prefix}{k}")) for k in keys]
    rows = rows.join(F.broadcast(many), same("_hot_"), "left").withColumn("_salt", F.coalesce(F.pmod(by, F.col("_copies")), F.lit(0)).cast("int")).drop("_copies", *(f"_hot_{k}" for k in keys))
    named = named.withColumn("_copy", F.explode(F.sequence(F.lit(0), F.col("_copies") - 1)))
    return rows.join(named, [*same("_"), F.col("_salt") == F.col("_copy")]).drop("n", "_salt", "_copy", "_copies", *(f"_{k}" for k in keys))


def encode(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, np.ndarray]:
    """vectors: vec_id, embedding, label; other columns are ignored. The coded vectors (vec_id, label, code, error), written
    to the shared folder, and the codebooks as integers by part, entry and component. parts <= 8, entries <= 256."""
    assert 1 <= parts <= 8 and 1 <= entries <= 256
    spark = vectors.sparkSession
    common.prepare(spark)
    kept = vectors.select("vec_id", "label", "embedding").where(finite(F.col("embedding")))
    first = kept.agg(F.min_by(F.size("embedding"), F.struct(F.col("vec_id").isNull(), "vec_id", F.size("embedding"))).alias("size")).first()
    size = first["size"] or 0
    schema = vectors.select("vec_id", "label").schema.simpleString()[len("struct<") : -1] + ",code:string,error:bigint"
    if not size or size % parts:
        return spark.createDataFrame([], schema), np.zeros((parts, 0, 0), np.int64)
    width = size // parts
    kept = kept.where(F.size("embedding") == size).select("vec_id", "label", integers(F.col("embedding"), scale, bound(size)).alias("v"))
    books = np.array(seeds(kept, entries), np.int64).reshape(-1, parts, width).transpose(1, 0, 2).copy()
    split = F.posexplode(F.array(*(F.slice("v", p * width + 1, width) for p in range(parts)))).alias("pos", "part")
    distinct = common.durable(kept.select(split).groupBy("pos", "part").agg(F.count("*").alias("n")), "parts")
    books = lloyd(distinct, books, rounds)
    assigned = common.durable(distinct.mapInArrow(_assign(books), "pos int, part array<int>, n long, code long, err long"), "assigned")
    total = assigned.agg(F.sum("n")).first()[0]
    rows = kept.withColumn("rid", F.monotonically_increasing_id()).select("rid", "vec_id", "label", split)
    joined = salted(rows, assigned, ["pos", "part"], total, F.xxhash64("rid"))
    code = F.bit_or(F.expr(f"shiftleft(code, cast(8 * ({parts} - 1 - pos) as int))"))
    coded = joined.groupBy("rid").agg(F.first("vec_id").alias("vec_id"), F.first("label").alias("label"), F.lower(F.lpad(F.hex(code), 2 * parts, "0")).alias("code"), F.sum("err").alias("error"))
    return common.durable(coded.drop("rid"), "codes"), books


def digest(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def with_label_errors(coded: DataFrame) -> DataFrame:
    """Adds label_error, the error summed over equal labels, nulls together. coded: label, error and others."""
    sums = common.durable(coded.groupBy("label").agg(F.count("*").alias("n"), F.try_sum("error").alias("label_error")), "labels")
    found = sums.agg(F.count("*").alias("labels"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows")).first()
    if found.labels <= BROADCAST_LABELS:
        small = F.broadcast(sums.withColumnRenamed("label", "_label").drop("n"))
        return coded.join(small, F.col("label").eqNullSafe(F.col("_label"))).drop("_label")
    return salted(coded, sums, ["label"], found.rows, F.xxhash64("vec_id", "code"))


def op11_codes(spark, sf_dir: str) -> DataFrame:
    coded, books = encode(common.table(spark, sf_dir, "embeddings"))
    return with_label_errors(coded).select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))


def oracle(parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> str:
    gap = "list_sum(list_transform(range(1, len(d.part) + 1), lambda i: (d.part[i] - c.part[i]) * (d.part[i] - c.part[i])))::BIGINT"
    near = f"(SELECT d.pos, d.part, any_value(d.n) AS n, min(struct_pack(d := {gap}, e := c.e)) AS best FROM d JOIN c{{r}} c ON d.pos = c.pos GROUP BY d.pos, d.part)"
    out = [f"""WITH k AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT rid, pos, v[pos * len(v) // {parts} + 1 : (pos + 1) * len(v) // {parts}] AS part FROM k, range({parts}) t(pos)),
d AS MATERIALIZED (SELECT pos, part, count(*) AS n FROM p GROUP BY ALL),
s AS (SELECT vec_id, min(rid) AS rid, row_number() OVER (ORDER BY vec_id) - 1 AS e FROM k GROUP BY vec_id ORDER BY vec_id LIMIT {entries}),
c0 AS MATERIALIZED (SELECT pos, e, part FROM s JOIN p USING (rid))"""]
    for r in range(rounds):
        out.append(f"""a{r} AS MATERIALIZED {near.format(r=r)},
m{r} AS (SELECT pos, best.e AS e, i, sum(n * part[i]) AS total, sum(n) AS n FROM a{r}, (SELECT unnest(range(1, (SELECT max(len(part)) FROM d) + 1)) AS i) GROUP BY ALL),
u{r} AS (SELECT pos, e, list(floor_div ORDER BY i) AS part FROM (SELECT pos, e, i, ((total - ((total % n) + n) % n) // n)::BIGINT AS floor_div FROM m{r}) GROUP BY pos, e),
c{r + 1} AS MATERIALIZED (SELECT c.pos, c.e, coalesce(u.part, c.part) AS part FROM c{r} c LEFT JOIN u{r} u ON c.pos = u.pos AND c.e = u.e)""")
    out.append(f"""f AS MATERIALIZED {near.format(r=rounds)},
g AS (SELECT rid, string_agg(printf('%02x', best.e), '' ORDER BY p.pos) AS code, sum(best.d)::BIGINT AS error FROM p JOIN f ON p.pos = f.pos AND p.part = f.part GROUP BY rid)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(array_to_string(part, ','), ',' ORDER BY pos, e)) FROM c{rounds}) AS codebooks_sha256 FROM k JOIN g USING (rid)""")
    return ",\n".join(out)
