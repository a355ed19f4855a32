"""Suffix-array dedup: removes every byte that a repeated string of WINDOW bytes covers.

1. Each window of WINDOW bytes has a minimiser, the least hash of the GRAM-byte strings in it. Neighbouring windows of
   one minimiser form a slice. Equal windows have equal minimisers, so all places of a repeated window lie in slices of
   one minimiser, and each window lies in one slice.
2. Minimisers that occur once in all are done with. Slices that are equal as a whole are counted by partial aggregation, and
   one of them stands for all.
3. The different slices of a minimiser come together in a block of bounded size. Its suffixes are sorted to the depth
   of the window and give the Burrows-Wheeler transform; breadth-first backward extension derives common prefixes by
   increasing value and stops at WINDOW - 1. Neighbours in suffix order that got no value share a whole window.
4. A minimiser with more than HOT different slices (a common passage in different surroundings) is not gathered in a
   block: its windows are counted by hash, with partial aggregation.

Defined cases: null counts as empty; texts under WINDOW bytes lose nothing; repeated rows are copies of each other and
lose all bytes that a window covers; windows are judged on the input, and never cross documents; an empty table gives
an empty result; other columns stay out."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm import common, textvec

WINDOW, GRAM = 200, 64
#: Bytes of slices per block on average, and of a block's text at most (three ranks must fit 63 bits).
BLOCK, MOST = 700_000, 1 << 21
HOT = 3000
PART = 4 << 20


def parts(off: np.ndarray, window: int) -> Iterator[tuple[int, int, int, int]]:
    """(first row, last row, start, end) of blocks; a row of over PART bytes comes in parts that overlap by a window."""
    n, lo = len(off) - 1, 0
    while lo < n:
        if off[lo + 1] - off[lo] > PART:
            for s in range(off[lo], off[lo + 1] - window + 1, PART):
                yield lo, lo + 1, s, min(off[lo + 1], s + PART + window - 1)
            lo += 1
            continue
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + textvec.BLOCK, "right")) - 1)
        wide = np.flatnonzero(np.diff(off[lo : hi + 1]) > PART)
        hi = lo + int(wide[0]) if len(wide) else hi
        yield lo, hi, off[lo], off[hi]
        lo = hi


def least(x: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Minimum of each `width` neighbours, and whether it stands there twice; put together from powers of two."""
    n = len(x) - width + 1
    low, tie, have = x, np.zeros(len(x), bool), 1
    out = None
    at = 0
    while True:
        if width & have:
            a, t = low[at : at + n], tie[at : at + n]
            if out is None:
                out, twice = a.copy(), t.copy()
            else:
                twice = (out == a) | np.where(a < out, t, twice)
                out = np.minimum(out, a)
            at += have
        if have * 2 > width:
            return out, twice
        a, b = low[:-have], low[have:]
        tie = (a == b) | np.where(a < b, tie[:-have], tie[have:])
        low = np.minimum(a, b)
        have *= 2


def slices(data: np.ndarray, off: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, ...]:
    """Of a block: first window, number of windows, minimiser and hash of each slice, and whether it holds its
    minimiser twice: only then can it repeat a window of its own."""
    n, none = len(data), (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),) * 2 + (np.zeros(0, bool),)
    m = n - window + 1
    if m <= 0:
        return none
    sums = textvec.prefix_sums(data)
    _, q = textvec.powers(n)
    low = textvec.mix((sums[gram:] - sums[:-gram]) * q[: n - gram + 1])
    low, tie = least(low, window - gram + 1)
    inside = np.ones(m, bool)
    for o in off[1:-1].tolist():
        inside[max(0, o - window + 1) : o] = False
    at = np.flatnonzero(inside)
    if not len(at):
        return none
    f = low[at]
    new = np.r_[True, (f[1:] != f[:-1]) | (at[1:] != at[:-1] + 1)]
    first = np.flatnonzero(new)
    start = at[first]
    count = np.diff(np.r_[first, len(at)])
    return start, count, f[first], textvec.span_hash(data, start, start + count + window - 1), np.logical_or.reduceat(tie[at], first)


def cut(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """docs: dkey, text. dkey, a (first byte), n (windows), f (minimiser), h (hash of the slice), own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = textvec.raw(b.column("text"))
            keys = b.column("dkey").to_numpy()
            for lo, hi, s, e in parts(off, window):
                o = np.clip(off[lo : hi + 1], s, e) - s
                a, n, f, h, own = slices(data[s:e], o, window, gram)
                row = np.searchsorted(o, a, "right") - 1
                yield pa.RecordBatch.from_arrays([pa.array(keys[lo + row]), pa.array(a + s - off[lo + row]), pa.array(n), pa.array(f.view(np.int64)), pa.array(h.view(np.int64)), pa.array(own)], ["dkey", "a", "n", "f", "h", "own"])

    return docs.select("dkey", "text").mapInArrow(run, "dkey long, a long, n long, f long, h long, own boolean")


def suffixes(text: np.ndarray, depth: int) -> np.ndarray:
    """Suffix order of a text that ends in a byte which it holds once, to a depth of `depth` at least."""
    n = len(text)
    padded = np.r_[text, np.zeros(8, np.uint8)]
    key = np.zeros(n, np.uint64)
    for i in range(8):
        key = key << np.uint64(8) | padded[i : i + n].astype(np.uint64)
    have = 8
    while True:
        order = np.argsort(key, kind="stable")
        k = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.r_[True, k[1:] != k[:-1]])
        if have >= depth or rank[order[-1]] == n:
            return order
        far = np.zeros(n + 2 * have, np.int64)
        far[:n] = rank
        key = (far[:n] << 42 | far[have : have + n] << 21 | far[2 * have : 2 * have + n]).astype(np.uint64)
        have *= 3


def repeats(text: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix order, and a class for each place in it: suffixes of one class share their first `window` bytes.

    Breadth-first backward extension. The intervals of a level belong to strings of one length; an interval's suffixes
    are extended to the left by the transform's symbols, which moves them to the intervals of the next level. Where an
    interval ends for the first time, the common prefix of the suffixes on both sides has the level's length."""
    n = len(text)
    order = suffixes(text, window + 8)
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    bwt = text[order - 1]
    to = place[order - 1]  # where the suffix extended by its symbol stands
    known = np.zeros(n + 1, bool)  # places whose common prefix with the one before is derived
    known[[0, n]] = True
    lb, rb = np.array([0]), np.array([n])
    mark = np.full(n, -1, np.int64)
    for _ in range(window):  # common prefixes 0, 1, ..., window - 1
        size = rb - lb
        total = int(size.sum())
        if not total:
            break
        ids = np.repeat(np.arange(len(lb)), size)
        at = np.arange(total) - np.repeat(np.cumsum(size) - size, size) + np.repeat(lb, size)
        moved, code = to[at], ids * 256 + bwt[at]
        if total * 8 > n:
            mark[moved] = code
            where = np.flatnonzero(mark >= 0)
            code = mark[where]
            mark[where] = -1
        else:
            by = np.argsort(moved)
            where, code = moved[by], code[by]
        first = np.flatnonzero(np.r_[True, (code[1:] != code[:-1]) | (where[1:] != where[:-1] + 1)])
        begin, end = where[first], where[np.r_[first[1:], len(where)] - 1] + 1
        new = ~known[end]
        known[end[new]] = True
        lb, rb = begin[new], end[new]
    return order, np.cumsum(known[:n]) - 1


def _block(window: int):
    def run(table: pa.Table) -> pa.Table:
        """cnt = 1 slices of a block: dkey, start and end of what repeats."""
        body, off = textvec.raw(table["body"])
        cnt, dkey, a = table["cnt"].to_numpy(), table["dkey"].to_numpy(), table["a"].to_numpy()
        f = table["f"].to_numpy()
        found: list[tuple] = []
        order = np.argsort(f, kind="stable")
        size = np.diff(off)[order]
        run_of = np.r_[True, f[order][1:] != f[order][:-1]]
        lo = 0
        while lo < len(order):  # whole minimisers, up to MOST bytes
            hi, total = lo, 0
            while hi < len(order):
                step = hi + 1
                while step < len(order) and not run_of[step]:
                    step += 1
                more = int(size[hi:step].sum())
                if total and total + more + 1 >= MOST:
                    break
                total, hi = total + more, step
            mine = order[lo:hi]
            lo = hi
            text = np.concatenate([*(body[off[k] : off[k + 1]] for k in mine), np.array([0xFF], np.uint8)])
            if len(text) >= MOST:
                raise ValueError("a minimiser's slices exceed a block")
            sizes = np.diff(off)[mine]
            start = np.r_[0, np.cumsum(sizes)]
            valid = np.zeros(len(text), np.int64)
            owner = np.repeat(np.arange(len(mine)), sizes)
            inside = np.arange(len(owner)) - start[owner] <= sizes[owner] - window
            valid[: len(owner)][inside] = cnt[mine[owner[inside]]]
            suffix, cls = repeats(text, window)
            weight = np.bincount(cls, valid[suffix])
            hit = np.zeros(len(text), bool)
            hit[suffix] = (weight[cls] >= 2) & (valid[suffix] == 1)
            at = np.flatnonzero(hit)
            if len(at):
                new = np.flatnonzero(np.r_[True, (at[1:] != at[:-1] + 1) | (owner[at[1:]] != owner[at[:-1]])])
                s, e = at[new], at[np.r_[new[1:], len(at)] - 1]
                who = mine[owner[s]]
                base = a[who] - start[owner[s]]
                found.append((dkey[who], base + s, base + e + window))
        got = [np.concatenate(x) for x in zip(*found)] if found else [np.zeros(0, np.int64)] * 3
        return pa.table({"dkey": pa.array(got[0]), "s": pa.array(got[1]), "e": pa.array(got[2])})

    return run


def _windows(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Every window of slices of hot minimisers, by hash."""
        for b in batches:
            body, off = textvec.raw(b.column("body"))
            dkey, a, f, cnt = (b.column(c).to_numpy() for c in ("dkey", "a", "f", "cnt"))
            for k in range(b.num_rows):
                d = body[off[k] : off[k + 1]]
                m = len(d) - window + 1
                h = textvec.span_hash(d, np.arange(m), np.arange(m) + window)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(m, f[k])), pa.array(h.view(np.int64)), pa.array(np.full(m, dkey[k])), pa.array(a[k] + np.arange(m)), pa.array(np.full(m, cnt[k]))], ["f", "w", "dkey", "s", "cnt"])

    return run


def _bodies(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The bytes of the slices that stand for their likes."""
        for b in batches:
            data, off = textvec.raw(b.column("text"))
            wanted = b.column("wanted")
            flat, count = wanted.flatten(), np.array(wanted.value_lengths())
            row = np.repeat(np.arange(b.num_rows), count)
            col = {x: flat.field(x).to_numpy() for x in ("a", "n", "f", "cnt", "g")}
            s = off[row] + col["a"]
            e = s + col["n"] + window - 1
            whole = data.tobytes()
            for lo in range(0, len(row), 20_000):
                sl = slice(lo, lo + 20_000)
                body = pa.array([whole[i:j] for i, j in zip(s[sl].tolist(), e[sl].tolist())], pa.binary())
                yield pa.RecordBatch.from_arrays([b.column("dkey").take(pa.array(row[sl])), *(pa.array(col[x][sl]) for x in ("a", "f", "cnt", "g")), body], ["dkey", "a", "f", "cnt", "g", "body"])

    return run


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        data, off = textvec.raw(b.column("text"))
        spans = b.column("spans").to_pylist()
        size = np.diff(off)
        removed, runs, sha = np.zeros(len(spans), np.int64), np.zeros(len(spans), np.int64), []
        for k, found in enumerate(spans):
            body = data[off[k] : off[k + 1]]
            if found:
                x = np.array(sorted((p["s"], p["e"]) for p in found), np.int64)
                top = np.maximum.accumulate(x[:, 1])
                new = np.flatnonzero(np.r_[True, x[1:, 0] > top[:-1]])
                s, e = x[new, 0], top[np.r_[new[1:], len(x)] - 1]
                change = np.zeros(len(body) + 1, np.int8)
                change[s] += 1
                change[e] -= 1
                keep = np.cumsum(change[:-1]) == 0
                removed[k], runs[k] = len(body) - int(keep.sum()), len(s)
                body = body[keep]
            sha.append(hashlib.sha256(body.tobytes()).hexdigest())
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(size), pa.array(removed), pa.array(runs), pa.array(sha, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def spans(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """docs: dkey (equal for equal rows only), text. dkey, spans: what repeats in it, as overlapping stretches s to e."""
    s = common.durable(cut(docs, window, gram), "slices")
    often = s.groupBy("f").agg(F.count(F.lit(1)).alias("all"), F.min("h").alias("h0"), F.max("h").alias("h1"), F.bool_or("own").alias("own")).where("all > 1 or own").drop("own")
    s2 = common.durable(s.join(often, "f").withColumn("pure", (F.col("all") > 1) & (F.col("h0") == F.col("h1"))).select("dkey", "a", "n", "f", "h", "pure"), "candidates")
    common.discard(s)
    common.tidy(docs.sparkSession)
    mixed = s2.where("not pure")
    kinds = common.durable(mixed.groupBy("f", "h").agg(F.count(F.lit(1)).alias("cnt"), F.min(F.struct("dkey", "a", "n")).alias("rep")), "kinds")
    hosts = kinds.groupBy("f").agg(F.count(F.lit(1)).alias("g"), F.sum(F.col("rep.n") + window).alias("bytes"))
    many = F.greatest(F.col("g"), F.ceil(F.col("bytes") * hot / (MOST // 2)))  # few but long slices count by their bytes
    kinds2 = kinds.join(hosts.select("f", many.alias("g")), "f")
    wanted = kinds2.groupBy(F.col("rep.dkey").alias("dkey")).agg(F.collect_list(F.struct(F.col("rep.a").alias("a"), F.col("rep.n").alias("n"), "f", "cnt", "g")).alias("wanted"))
    text = docs.select("dkey", "text").join(wanted, "dkey").dropDuplicates(["dkey"]).select("dkey", "text", "wanted")
    body = common.durable(text.mapInArrow(_bodies(window), "dkey long, a long, f long, cnt long, g long, body binary"), "bodies")
    common.tidy(docs.sparkSession)
    total = kinds.agg(F.sum(F.col("rep.n") + window)).first()[0] or 0
    blocks = max(1, -(-int(total) // BLOCK))
    cool = body.where(F.col("g") <= hot).withColumn("block", F.pmod(F.xxhash64("f"), F.lit(blocks)))
    one = cool.groupBy("block").applyInArrow(_block(window), "dkey long, s long, e long")
    warm = body.where(F.col("g") > hot).mapInArrow(_windows(window), "f long, w long, dkey long, s long, cnt long")
    known = warm.groupBy("f", "w").agg(F.sum("cnt").alias("k")).where("k > 1")
    two = warm.where("cnt = 1").join(known, ["f", "w"]).select("dkey", "s", (F.col("s") + window).alias("e"))
    end = (F.col("a") + F.col("n") + window - 1).alias("e")
    copies = mixed.join(kinds.where("cnt > 1").select("f", "h"), ["f", "h"]).select("dkey", F.col("a").alias("s"), end)
    pure = s2.where("pure").select("dkey", F.col("a").alias("s"), end)
    every = pure.unionByName(copies).unionByName(one).unionByName(two)
    return common.durable(every.groupBy("dkey").agg(F.collect_set(F.struct("s", "e")).alias("spans")), "spans")


def remove_repeats(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """docs: doc_id, text. One row each: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    common.prepare(docs.sparkSession)
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("dkey", F.xxhash64("doc_id", "text"))
    found = spans(d, window, gram, hot)
    common.tidy(docs.sparkSession)
    out = d.join(found, "dkey", "left").select("doc_id", "text", "spans")
    return out.mapInArrow(_apply, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def op5_suffix(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(common.table(spark, sf_dir, "documents"))
