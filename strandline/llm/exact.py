"""Exact dedup by composable polynomial fingerprints.

A text is normalised (each run of white space becomes one space) and read in chunks. A chunk's fingerprint is
sum(b[i] * B^i) modulo a prime, for two primes; fingerprints of neighbours combine by length-shifted arithmetic,
h(x + y) = h(x) + B^len(x) * h(y), so chunks are hashed side by side, a text of any length is streamed, and the parts
of a huge document could as well come from different tasks. Texts of equal fingerprint and length are then compared
with the group's first text, chunk by chunk; a text that differs, should a fingerprint collide, is grouped by its
SHA-256 among those that differ.

Groups are found by partial aggregation. A group of any size is compared in parallel: the first text is copied once for
SALT members.

Defined cases: null counts as empty, and empty texts are equal; a null id is larger than any other; rows that repeat an
id with the same text count each and share the verdict; an empty table gives an empty result; other columns stay out."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm import common, textvec

PRIMES = (2147483647, 2147483629)
BASES = (911382323, 972663749)
CHUNK = 4096
STREAM = 4 << 20
SALT = 500

_IN_CHUNK = []
for _p, _b in zip(PRIMES, BASES):
    _row = [1]
    for _ in range(CHUNK):
        _row.append(_row[-1] * _b % _p)
    _IN_CHUNK.append(np.array(_row, np.int64))


def combine(left: tuple[int, int], right: tuple[int, int], left_length: int) -> tuple[int, int]:
    """The fingerprint of a text from those of its two parts."""
    return tuple((a + pow(b, left_length, p) * c) % p for a, c, p, b in zip(left, right, PRIMES, BASES))


def prints(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Fingerprints, 2 x rows, of the rows of a block: all chunks at once, then each row's chunks shifted and summed."""
    n, out = len(off) - 1, np.zeros((2, len(off) - 1), np.int64)
    size = np.diff(off)
    chunks = -(-size // CHUNK)
    if not chunks.sum():
        return out
    first = np.r_[0, np.cumsum(chunks)]
    row = np.repeat(np.arange(n), chunks)
    number = np.arange(first[-1]) - first[row]
    starts = off[row] + number * CHUNK
    at = np.arange(len(data)) - np.repeat(starts, np.diff(np.r_[starts, len(data)]))
    live = np.flatnonzero(chunks)
    for k, p in enumerate(PRIMES):
        part = np.add.reduceat((data.astype(np.int64) + 1) * _IN_CHUNK[k][at], starts) % p
        shift, step = [1], int(_IN_CHUNK[k][CHUNK])
        for _ in range(int(number.max())):
            shift.append(shift[-1] * step % p)
        part = part * np.array(shift, np.int64)[number] % p
        out[k][live] = np.add.reduceat(part, first[live]) % p
    return out


def normalise(data: np.ndarray, off: np.ndarray, inside: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Each run of white space as one space. inside: what precedes the block, in the same text, is white space."""
    ws = textvec.SPACE[data]
    keep = np.ones(len(data), bool)
    keep[1:] = ~(ws[1:] & ws[:-1])
    starts = off[:-1][off[:-1] < len(data)]
    keep[starts] = True
    if inside and len(data) and ws[0]:
        keep[0] = False
    total = np.r_[0, np.cumsum(keep)]
    return np.where(ws, np.uint8(0x20), data)[keep], total[off]


def of_text(body: np.ndarray) -> tuple[tuple[int, int], int, str]:
    """Fingerprint, length and SHA-256 of one normalised text, streamed."""
    found, length, sha, inside = (0, 0), 0, hashlib.sha256(), False
    for i in range(0, len(body), STREAM):
        part, _ = normalise(body[i : i + STREAM], np.array([0, len(body[i : i + STREAM])]), inside)
        h = prints(part, np.array([0, len(part)]))
        found, length, inside = combine(found, (int(h[0][0]), int(h[1][0])), length), length + len(part), bool(textvec.SPACE[body[min(len(body), i + STREAM) - 1]])
        sha.update(part.tobytes())
    return found, length, sha.hexdigest()


def _prints(with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = textvec.raw(b.column("text"))
            n = b.num_rows
            fp, length, sha = np.zeros(n, np.int64), np.zeros(n, np.int64), [""] * n
            lo = 0
            while lo < n:
                if off[lo + 1] - off[lo] > STREAM:
                    h, length[lo], sha[lo] = of_text(data[off[lo] : off[lo + 1]])
                    fp[lo] = h[0] << 31 | h[1]
                    lo += 1
                    continue
                hi = max(lo + 1, int(np.searchsorted(off, off[lo] + textvec.BLOCK, "right")) - 1)
                d, o = normalise(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
                h = prints(d, o)
                fp[lo:hi], length[lo:hi] = h[0] << 31 | h[1], np.diff(o)
                body = d.tobytes()
                for k in range(lo, hi):
                    sha[k] = hashlib.sha256(body[o[k - lo] : o[k - lo + 1]]).hexdigest()
                lo = hi
            more = [b.column("text")] if with_text else []
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("tkey"), pa.array(fp), pa.array(length), pa.array(sha), *more], ["doc_id", "tkey", "fp", "length", "sha", *["text"] * with_text])

    return run


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """same: the two normalised texts agree, chunk by chunk."""
    for b in batches:
        (ld, lo), (rd, ro) = textvec.raw(b.column("text")), textvec.raw(b.column("first_text"))
        same = np.zeros(b.num_rows, bool)
        for k in range(b.num_rows):
            x, y = ld[lo[k] : lo[k + 1]], rd[ro[k] : ro[k + 1]]
            same[k] = np.array_equal(x, y) or _equal(x, y)
        names = ["doc_id", "tkey", "sha", "fp", "length"]
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in names), pa.array(same)], [*names, "same"])


def _chunks(body: np.ndarray) -> Iterator[bytes]:
    """Normalised bytes in pieces of CHUNK."""
    held, inside = b"", False
    for i in range(0, len(body), STREAM):
        raw = body[i : i + STREAM]
        part, _ = normalise(raw, np.array([0, len(raw)]), inside)
        inside = bool(textvec.SPACE[raw[-1]])
        held += part.tobytes()
        whole = len(held) // CHUNK * CHUNK
        for j in range(0, whole, CHUNK):
            yield held[j : j + CHUNK]
        held = held[whole:]
    yield held


def _equal(x: np.ndarray, y: np.ndarray) -> bool:
    a, b = _chunks(x), _chunks(y)
    while True:
        u, v = next(a, None), next(b, None)
        if u != v:
            return False
        if u is None:
            return True


def classes(docs: DataFrame) -> DataFrame:
    """docs: doc_id, text. One row a document: doc_id, tkey (xxhash64 of the text as it was), keep_id, group_size,
    text_sha256."""
    common.prepare(docs.sparkSession)
    docs = docs.select("doc_id", F.xxhash64("text").alias("tkey"), "text")
    key = ["fp", "length"]
    p = common.durable(docs.mapInArrow(common.freeing(_prints(False)), "doc_id long, tkey long, fp long, length long, sha string"), "prints")
    groups = common.durable(p.groupBy(*key).agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1"), "groups")
    # from here on texts move only of groups with two members or more
    members = docs.mapInArrow(common.freeing(_prints(True)), "doc_id long, tkey long, fp long, length long, sha string, text string").join(groups, key)
    members = common.durable(members.withColumn("salts", F.ceil(F.col("n") / SALT).cast("int")), "members")
    first = members.where(F.col("doc_id").eqNullSafe(F.col("first_id"))).dropDuplicates(key)
    first = first.select(*key, F.col("text").alias("first_text"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    salted = members.withColumn("salt", F.pmod(F.xxhash64("doc_id", "sha"), F.col("salts")).cast("int")).select("doc_id", "tkey", "sha", *key, "salt", "text")
    found = salted.join(first, [*key, "salt"]).select("doc_id", "tkey", "sha", *key, "text", "first_text").mapInArrow(common.freeing(_compare), "doc_id long, tkey long, sha string, fp long, length long, same boolean")
    found = common.durable(found.withColumn("part", F.when(F.col("same"), F.lit("")).otherwise(F.col("sha"))), "compared")
    sizes = found.groupBy(*key, "part").agg(F.min("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    many = found.join(sizes, [*key, "part"]).select("doc_id", "tkey", "keep_id", "group_size", F.col("sha").alias("text_sha256"))
    one = p.join(groups.select(*key), key, "left_anti").select("doc_id", "tkey", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.col("sha").alias("text_sha256"))
    return one.unionByName(many)


def op10_exact(spark, sf_dir: str) -> DataFrame:
    out = classes(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "keep_id", "group_size", (F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"), "text_sha256")


ORACLE = r"""
WITH d AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents),
g AS (SELECT t, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, sha256(d.t) AS text_sha256 FROM d JOIN g USING (t)
"""
