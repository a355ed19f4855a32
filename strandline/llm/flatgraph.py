"""Embedding near-dedup on a robust-pruned flat graph.

1. Equal vectors of one label form a class, found by partial aggregation; a class counts as often as it has rows.
2. Hubs stand for crowds of near copies. They are chosen on a bounded sample: a vector with CROWD or more of the sample's
   vectors of its label within half the threshold's angle. All that lies within that angle of one hub is linked with one
   another, by the triangle inequality of angles, so a crowd of any size is counted and needs no comparisons; a third of
   all rows may be one. What could link to a member from outside lies in the hub's shell (the threshold's angle beyond
   its farthest member) and is compared with all members, block by block.
3. The other vectors are dealt to shards of MOST at most: a larger one is split by k-means on a sample of it, each vector
   going to the `overlap` nearest centroids, until all are small enough. A shard is one task's work.
4. In every shard a graph is built: each vector's nearest neighbours, thinned by robust pruning (a neighbour goes if one
   that is kept is closer to it than 1 / ALPHA of its own distance), with edges both ways. A vector's adjacency lists
   from all its shards are united.
5. Each vector searches its shards over the united lists: greedily from the medoid, then expanding over all that lies in
   range. A link found from either end counts for both, in the first shard that holds both. Cosines that decide are
   those of the whole vectors in double precision.
6. Shards return counts and a spanning forest of their links, never pairs; components come from joins.
7. Recall is audited in every run, on AUDIT classes outside crowds against all rows outside in blocks. Below ENOUGH the overlap is widened; if the
   widest doesn't reach it, all vectors of a label are compared in blocks.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components, and vectors of null label, are
linked with nothing; vectors of different lengths are never linked; repeated rows are links of each other; a null id has
no part in the smallest id; an empty table gives an empty result; other columns stay out."""

from __future__ import annotations

import functools
import logging
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm import common, graphs

THRESHOLD = 0.93
#: Vectors that hubs are chosen from, how many of them make a crowd, and most hubs (512 bytes each at 64 dimensions).
SAMPLE, CROWD, HUBS = 10_000, 8, 2048
#: Vectors of a shard, and of a block of comparisons, at most; those that a shard's centroids come from; centroids of a split.
MOST, BLOCK, SPLIT_SAMPLE, SPLIT = 1000, 1500, 2000, 64
LEVELS = 8
CANDIDATES, DEGREE, ALPHA, BEAM = 48, 16, 1.2, 24
#: What is expanded lies in range or below it by this much.
SLACK = 0.08
OVERLAPS = (2, 4)
LOG = logging.getLogger(__name__)
AUDIT, ENOUGH = 2000, 0.97
#: What rounding may do to an angle.
TINY = 1e-6


def vectors(column: pa.Array) -> np.ndarray:
    """A list column of equal lengths as a matrix of doubles."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def classes(emb: DataFrame) -> DataFrame:
    """vec_id, label, embedding: cid, rep (smallest id), label, embedding, copies, of vectors that can be linked."""
    e = F.col("embedding").cast("array<double>")
    fine = F.col("label").isNotNull() & (F.size(e) > 0) & F.forall(e, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(e, lambda x: x != 0)
    x = emb.select("vec_id", "label", e.alias("embedding")).where(F.coalesce(fine, F.lit(False)))
    x = x.groupBy("label", "embedding").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    return x.withColumn("cid", F.xxhash64("label", "embedding"))


def robust_prune(x: np.ndarray) -> np.ndarray:
    """x: unit vectors. n x DEGREE neighbours, -1 where there are fewer."""
    n = len(x)
    m = min(CANDIDATES, n - 1)
    out = np.full((n, DEGREE), -1, np.int64)
    if m <= 0:
        return out
    near, sim = np.empty((n, m), np.int64), np.empty((n, m))
    for lo in range(0, n, 512):
        s = x[lo : lo + 512] @ x.T
        s[np.arange(len(s)), np.arange(lo, lo + len(s))] = -2
        top = np.argpartition(-s, m - 1, axis=1)[:, :m]
        v = np.take_along_axis(s, top, 1)
        order = np.argsort(-v, axis=1, kind="stable")
        near[lo : lo + 512], sim[lo : lo + 512] = np.take_along_axis(top, order, 1), np.take_along_axis(v, order, 1)
    dist = np.sqrt(np.maximum(2 - 2 * sim, 0))
    alive = np.ones((n, m), bool)
    rows = np.arange(n)
    for r in range(DEGREE):
        pick = alive.argmax(1)
        some = alive[rows, pick]
        if not some.any():
            break
        chosen = near[rows, pick]
        out[some, r] = chosen[some]
        for lo in range(0, n, 512):
            sl = slice(lo, lo + 512)
            d = np.sqrt(np.maximum(2 - 2 * np.einsum("nk,nmk->nm", x[chosen[sl]], x[near[sl]]), 0))
            alive[sl] &= ALPHA * d > dist[sl]
        alive[rows, pick] = False
    return out


def _lists(table: pa.Table) -> pa.Table:
    """Adjacency of one block, edges both ways: cid, neighbours."""
    x, cid = unit(vectors(table["embedding"])), table["cid"].to_numpy()
    g = robust_prune(x)
    a, k = np.nonzero(g >= 0)
    b = g[a, k]
    pairs = np.unique(np.r_[a * len(x) + b, b * len(x) + a])
    src, dst = pairs // len(x), pairs % len(x)
    off = np.searchsorted(src, np.arange(len(x) + 1)).astype(np.int32)
    return pa.table({"cid": pa.array(cid), "next": pa.ListArray.from_arrays(pa.array(off), pa.array(cid[dst]))})


def _inside(x: np.ndarray, y: np.ndarray, cos: np.ndarray, t: float) -> np.ndarray:
    """cos >= t; a cosine next to it is taken of the vectors as they are, alike from both sides."""
    found = cos >= t
    for a, b in zip(*np.nonzero(np.abs(cos - t) < 1e-9)):
        found[a, b] = (x[a] * y[b]).sum() / (np.sqrt((x[a] ** 2).sum()) * np.sqrt((y[b] ** 2).sum())) >= t
    return found


class Graph:
    """A shard with united lists, as a matrix of who lists whom."""

    def __init__(self, x: np.ndarray, cid: np.ndarray, lists: pa.Array):
        self.x, n = x, len(x)
        order = np.argsort(cid)
        flat, size = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.array(lists.value_lengths().fill_null(0), np.int64)
        at = np.minimum(np.searchsorted(cid[order], flat), n - 1)
        inside = cid[order][at] == flat
        self.next = np.zeros((n, n), bool)
        self.next[np.repeat(np.arange(n), size)[inside], order[at[inside]]] = True
        self.wide = self.next.astype(np.float32)
        self.medoid = int((x @ x.mean(0)).argmax()) if n else 0

    def search(self, start: np.ndarray, t: float) -> np.ndarray:
        """For the nodes `start` as queries: which nodes they find with a cosine of t or more."""
        q, n, m = self.x[start], len(self.x), len(start)
        done, seen = np.zeros((m, n), bool), np.zeros((m, n), bool)
        sim = np.full((m, n), -2.0)
        rows = np.arange(m)

        def look(new: np.ndarray, of: np.ndarray) -> None:
            new &= ~seen[of]
            r, c = np.nonzero(new)
            r = of[r]
            for lo in range(0, len(r), 1 << 15):
                a, b = r[lo : lo + (1 << 15)], c[lo : lo + (1 << 15)]
                sim[a, b] = (q[a] * self.x[b]).sum(1)
            seen[r, c] = True

        first = np.zeros((m, n), bool)
        first[:, self.medoid] = True
        first[rows, start] = True
        look(first, rows)
        active, k = rows, min(BEAM, n) - 1
        while len(active):
            s = np.where(done[active], -3.0, sim[active])
            best = s.argmax(1)
            # a query stops when what is next is no better than the worst of its full beam
            worst = -np.partition(-sim[active], k, axis=1)[:, k]
            top = s[np.arange(len(active)), best]
            go = (top > -2) & (top >= worst)
            active, best = active[go], best[go]
            done[active, best] = True
            look(self.next[best], active)
        while True:  # expand over the range
            front = (sim >= t - SLACK) & ~done
            of = np.flatnonzero(front.any(1))
            if not len(of):
                return sim >= t
            done |= front
            look(front[of].astype(np.float32) @ self.wide > 0, of)


def _roots(found: np.ndarray) -> np.ndarray:
    """The smallest node of each node's component; found is symmetric."""
    root = np.arange(len(found))
    while True:
        low = np.minimum(root, np.where(found, root[None], len(found)).min(1, initial=len(found)))
        low = np.minimum(low, low[low])
        if (low == root).all():
            return root
        root = low


def _search(threshold: float):
    def run(table: pa.Table) -> pa.Table:
        """One shard: cid, links (of pairs whose first common shard this is), root."""
        x, cid, copies = vectors(table["embedding"]), table["cid"].to_numpy(), table["copies"].to_numpy()
        n, here = len(x), table["shard_no"][0].as_py()
        g = Graph(unit(x), cid, table["next"].combine_chunks())
        found = np.zeros((n, n), bool)
        for lo in range(0, n, 512):
            found[lo : lo + 512] = g.search(np.arange(lo, min(n, lo + 512)), threshold - 1e-9)
        found |= found.T
        np.fill_diagonal(found, False)
        for lo in range(0, n, 512):
            found[lo : lo + 512] &= _inside(x[lo : lo + 512], x, g.x[lo : lo + 512] @ g.x.T, threshold)
        found &= found.T
        counted = found.copy()
        lists = table["shards"].combine_chunks()
        shard, of = lists.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(n), np.array(lists.value_lengths(), np.int64))
        for other in np.unique(shard[shard < here]):
            both = of[shard == other]
            counted[np.ix_(both, both)] = False
        return pa.table({"cid": pa.array(cid), "links": pa.array(counted @ copies), "root": pa.array(cid[_roots(found)])})

    return run


def _cross(threshold: float):
    def run(table: pa.Table) -> pa.Table:
        """A block of left rows against one of right rows: cid, links (for rows that `gets`), root."""
        x, cid, copies = vectors(table["embedding"]), table["cid"].to_numpy(), table["copies"].to_numpy()
        gets, right = (table[c].to_numpy(zero_copy_only=False).astype(bool) for c in ("gets", "right"))
        u, a, b = unit(x), np.flatnonzero(~right), np.flatnonzero(right)
        found = np.zeros((len(a), len(b)), bool)
        for lo in range(0, len(a), 512):
            part = a[lo : lo + 512]
            found[lo : lo + 512] = _inside(x[part], x[b], u[part] @ u[b].T, threshold) & (cid[part][:, None] != cid[b][None])
        links = np.zeros(len(x), np.int64)
        links[a], links[b] = found @ copies[b], copies[a] @ found
        root = np.arange(len(x))
        while len(a) and len(b):
            low = root.copy()
            low[a] = np.minimum(low[a], np.where(found, root[b][None], len(x)).min(1))
            low[b] = np.minimum(low[b], np.where(found, low[a][:, None], len(x)).min(0))
            low = np.minimum(low, low[low])
            if (low == root).all():
                break
            root = low
        return pa.table({"cid": pa.array(cid), "links": pa.array(np.where(gets, links, 0)), "root": pa.array(cid[root])})

    return run


def hubs(rows: DataFrame, threshold: float) -> dict:
    """Unit vectors of the hubs by label and length, chosen on the sample: crowded ones first."""
    sample = common.bounded_rows(rows.select("cid", "label", "embedding"), "cid", SAMPLE).toArrow()
    labels, length = np.array(sample["label"].to_pylist(), object), np.array(sample["embedding"].combine_chunks().value_lengths()) if sample.num_rows else np.zeros(0)
    near, found, total = np.cos(np.arccos(threshold) / 2), {}, 0
    for key in sorted(set(zip(labels.tolist(), length.tolist())), key=str):
        x = unit(vectors(sample["embedding"].take(pa.array(np.flatnonzero((labels == key[0]) & (length == key[1]))))))
        count = np.concatenate([(x[lo : lo + 512] @ x.T >= near).sum(1) for lo in range(0, len(x), 512)])
        free, chosen = np.ones(len(x), bool), []
        for k in np.argsort(-count, kind="stable").tolist():
            if count[k] < CROWD or total >= HUBS:
                break
            mine = free & (x @ x[k] >= near)
            if free[k] and mine.sum() >= CROWD:
                chosen.append(x[k])
                free[mine] = False
                total += 1
        if chosen:
            found[key] = np.stack(chosen)
    return found


def _place(cast, threshold: float):
    wide = float(np.arccos(threshold))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each class's hub (-1: none) and angle to it, and the hubs whose shell may hold it."""
        known = cast.value
        first = dict(zip(known, np.cumsum([0, *(len(v) for v in known.values())])))
        for b in batches:
            labels, length = np.array(b.column("label").to_pylist(), object), np.array(b.column("embedding").value_lengths())
            hub, angle = np.full(b.num_rows, -1), np.zeros(b.num_rows)
            row, far, to = [np.zeros(0, np.int64)], [np.zeros(0)], [np.zeros(0, np.int64)]
            for key in set(zip(labels.tolist(), length.tolist())) & set(known):
                at = np.flatnonzero((labels == key[0]) & (length == key[1]))
                a = np.arccos(np.clip(unit(vectors(b.column("embedding").take(pa.array(at)))) @ known[key].T, -1, 1))
                best = a.argmin(1)
                close = a[np.arange(len(at)), best]
                member = close <= wide / 2 - TINY
                hub[at[member]], angle[at[member]] = first[key] + best[member], close[member]
                a[np.flatnonzero(member), best[member]] = 9
                r, c = np.nonzero(a <= 1.5 * wide + TINY)
                row.append(at[r])
                far.append(a[r, c])
                to.append(first[key] + c)
            order = np.argsort(np.concatenate(row), kind="stable")
            off = np.searchsorted(np.concatenate(row)[order], np.arange(b.num_rows + 1)).astype(np.int32)
            shell = pa.StructArray.from_arrays([pa.array(np.concatenate(to)[order]), pa.array(np.concatenate(far)[order])], ["to", "far"])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(hub), pa.array(angle), pa.ListArray.from_arrays(pa.array(off), shell)], [*b.schema.names, "hub", "angle", "shell"])

    return run


def _blocked(left: DataFrame, right: DataFrame, sizes: DataFrame, threshold: float) -> DataFrame:
    """left, right: k, cid, copies, embedding, gets; sizes: k, n_left, n_right. All of left against all of right of equal k."""
    blocks = lambda c: F.greatest(F.ceil(F.col(c) / BLOCK), F.lit(1)).cast("int")
    s = F.broadcast(sizes.select("k", blocks("n_left").alias("bl"), blocks("n_right").alias("br")))
    mine = lambda c: F.pmod(F.xxhash64("cid"), F.col(c)).cast("int")
    a = left.join(s, "k").select("k", "cid", "copies", "embedding", "gets", F.lit(False).alias("right"), mine("bl").alias("i"), F.explode(F.sequence(F.lit(0), F.col("br") - 1)).alias("j"))
    b = right.join(s, "k").select("k", "cid", "copies", "embedding", "gets", F.lit(True).alias("right"), F.explode(F.sequence(F.lit(0), F.col("bl") - 1)).alias("i"), mine("br").alias("j"))
    return a.unionByName(b).groupBy("k", "i", "j").applyInArrow(_cross(threshold), "cid long, links long, root long")


def crowds(rows: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """The classes without a hub; and cid, links, root of all links of members."""
    cast = rows.sparkSession.sparkContext.broadcast(hubs(rows, threshold))
    placed = rows.select("cid", "copies", "label", "embedding").mapInArrow(_place(cast, threshold), "cid long, copies long, label " + rows.schema["label"].dataType.simpleString() + ", embedding array<double>, hub long, angle double, shell array<struct<to:long,far:double>>")
    placed = common.durable(placed, "placed")
    member = placed.where("hub >= 0")
    of = common.durable(member.groupBy("hub").agg(F.sum("copies").alias("total"), F.count(F.lit(1)).alias("n_left"), F.max("angle").alias("reach"), F.min("cid").alias("star")), "hubs")  # HUBS rows at most
    links = member.join(F.broadcast(of), "hub").select("cid", (F.col("total") - F.col("copies")).alias("links"), F.col("star").alias("root"))
    shell = placed.select("cid", "copies", "embedding", (F.col("hub") < 0).alias("gets"), F.explode("shell").alias("s"))
    shell = shell.join(F.broadcast(of.select(F.col("hub").alias("k"), "reach")), F.col("s.to") == F.col("k")).where(F.col("s.far") <= F.lit(float(np.arccos(threshold)) + TINY) + F.col("reach"))
    shell = common.durable(shell.select("k", "cid", "copies", "embedding", "gets"), "shells")
    sizes = of.select(F.col("hub").alias("k"), "n_left").join(shell.groupBy("k").agg(F.count(F.lit(1)).alias("n_right")), "k")
    left = member.select(F.col("hub").alias("k"), "cid", "copies", "embedding", F.lit(True).alias("gets"))
    outside = _blocked(left, shell, sizes, threshold)
    return placed.where("hub < 0").select("cid", "copies", "label", "embedding"), common.durable(links.unionByName(outside), "crowds")


def _kmeans(table: pa.Table) -> pa.Table:
    """Centroids of one shard from its sample."""
    x = unit(vectors(table["embedding"]))
    k = int(min(SPLIT, -(-table["n"][0].as_py() * 3 // MOST), len(x)))
    c = x[np.random.Generator(np.random.PCG64(5)).permutation(len(x))[:k]]
    for _ in range(8):
        near = (x @ c.T).argmax(1)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        size = np.sqrt((sums * sums).sum(1, keepdims=True))
        c = np.where(size > 0, sums / np.maximum(size, 1e-12), c)
    return pa.table({"shard": pa.array([table["shard"][0].as_py()] * k, pa.string()), "center": pa.array(list(c), pa.list_(pa.float64()))})


def _deal(overlap: int, last: bool):
    def run(rows: pa.Table, centers: pa.Table) -> pa.Table:
        """Rows of a shard to their nearest centroids; where splits don't end, by number."""
        c, cid = vectors(centers["center"]), rows["cid"].to_numpy()
        k = min(overlap, len(c))
        near = (cid % SPLIT)[:, None] if last else np.argsort(-(unit(vectors(rows["embedding"])) @ c.T), axis=1, kind="stable")[:, :k]
        at = pa.array(np.repeat(np.arange(len(cid)), near.shape[1]))
        name = rows["shard"][0].as_py() if len(cid) else ""
        return pa.table({"cid": rows["cid"].take(at), "copies": rows["copies"].take(at), "embedding": rows["embedding"].take(at), "shard": pa.array([f"{name}/{z}" for z in near.reshape(-1).tolist()], pa.string())})

    return run


def shards(rows: DataFrame, overlap: int) -> DataFrame:
    """cid, copies, embedding, shard: shards of MOST rows at most (but for chance, after LEVELS splits)."""
    kind = "cid long, copies long, embedding array<double>, shard string"
    now = rows.select("cid", "copies", "embedding", F.concat_ws("/", F.col("label").cast("string"), F.size("embedding")).alias("shard"))
    done = None
    for level in range(LEVELS):
        sizes = common.durable(now.groupBy("shard").agg(F.count(F.lit(1)).alias("n")), "sizes")
        big = sizes.where(F.col("n") > MOST)
        if not big.limit(1).count():
            break
        small = now.join(sizes.where(F.col("n") <= MOST), "shard").select("cid", "copies", "embedding", "shard")
        done = small if done is None else done.unionByName(small)
        large = now.join(big, "shard")
        some = large.where(F.pmod(F.xxhash64(F.lit(level), "cid"), F.ceil(F.col("n") / SPLIT_SAMPLE)) == 0)
        centers = common.durable(some.groupBy("shard").applyInArrow(_kmeans, "shard string, center array<double>"), "centers")
        blocks = F.ceil(F.col("n") / BLOCK).cast("int")
        left = large.withColumn("block", F.pmod(F.xxhash64("cid"), blocks).cast("int")).select("shard", "block", "cid", "copies", "embedding")
        right = centers.join(big, "shard").select("shard", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"), "center")
        now = common.durable(left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block")).applyInArrow(_deal(overlap, level == LEVELS - 1), kind), "dealt")
    return now if done is None else done.unionByName(now)


def graph_links(rows: DataFrame, overlap: int, threshold: float) -> DataFrame:
    """cid, links, root of the links that searches find."""
    dealt = common.durable(shards(rows, overlap).dropDuplicates(["cid", "shard"]).withColumn("shard_no", F.xxhash64("shard")), "shards")
    lists = dealt.select("shard", "cid", "embedding").groupBy("shard").applyInArrow(_lists, "cid long, next array<long>")
    united = lists.groupBy("cid").agg(F.array_distinct(F.flatten(F.collect_list("next"))).alias("next"))  # some 2 * DEGREE a shard
    where = dealt.groupBy("cid").agg(F.collect_set("shard_no").alias("shards"))
    nodes = dealt.join(united, "cid").join(where, "cid").select("shard", "shard_no", "cid", "copies", "embedding", "next", "shards")
    return nodes.groupBy("shard").applyInArrow(_search(threshold), "cid long, links long, root long")


def block_links(rows: DataFrame, threshold: float) -> DataFrame:
    """The same by comparing all rows of a label in blocks."""
    x = rows.select(F.concat_ws("/", F.col("label").cast("string"), F.size("embedding")).alias("k"), "cid", "copies", "embedding")
    sizes = common.durable(x.groupBy("k").agg(F.count(F.lit(1)).alias("n_left"), F.count(F.lit(1)).alias("n_right")), "sizes")
    return _blocked(x.withColumn("gets", F.lit(True)), x.withColumn("gets", F.lit(False)), sizes, threshold)


def recall(rows: DataFrame, links: DataFrame, threshold: float) -> float:
    """Mean share of its links that was found of each class that has any, of AUDIT classes against all rows, block by block; 1 if
    none of them has a link. rows and links: those of the searches alone, without crowds, whose links are exact and would hide
    what the searches lose."""
    some = common.bounded_rows(rows.select("cid", "label", "embedding"), "cid", AUDIT).toArrow()
    if not some.num_rows:
        return 1.0
    cids, labels, vecs = some["cid"].to_pylist(), some["label"].to_pylist(), [np.array(v) for v in some["embedding"].to_pylist()]
    cast = rows.sparkSession.sparkContext.broadcast((cids, labels, vecs))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, tags, qs = cast.value
        total = np.zeros(len(ids), np.int64)
        for b in batches:
            label, cid, copies = np.array(b.column("label").to_pylist(), object), b.column("cid").to_numpy(), b.column("copies").to_numpy()
            length = np.array(b.column("embedding").value_lengths())
            for tag, dim in sorted({(t, len(q)) for t, q in zip(tags, qs)}, key=str):
                at, mine = np.flatnonzero((label == tag) & (length == dim)), [k for k in range(len(ids)) if tags[k] == tag and len(qs[k]) == dim]
                if len(at):
                    s = unit(np.stack([qs[k] for k in mine])) @ unit(vectors(b.column("embedding").take(pa.array(at)))).T >= threshold
                    s &= np.array([ids[k] for k in mine])[:, None] != cid[at][None]
                    total[mine] += s @ copies[at]
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(total)], ["cid", "true"])

    true = rows.select("cid", "label", "copies", "embedding").mapInArrow(run, "cid long, true long").groupBy("cid").agg(F.sum("true").alias("true"))
    share = F.when(F.col("true") > 0, F.least(F.col("true"), F.coalesce("links", F.lit(0))) / F.col("true"))
    return true.join(links, "cid", "left").agg(F.coalesce(F.avg(share), F.lit(1.0)).alias("recall")).first()["recall"]


def near_duplicates(emb: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """emb: vec_id, label, embedding. One row each: vec_id, n_links, component_id."""
    common.prepare(emb.sparkSession)
    emb = emb.select("vec_id", "label", "embedding")
    rows = common.durable(classes(emb), "vectors")
    rest, crowd = crowds(rows, threshold)
    ways = [functools.partial(graph_links, rest, overlap, threshold) for overlap in OVERLAPS]
    for way in [*ways, functools.partial(block_links, rest, threshold)]:
        found = common.durable(way(), "found")
        share = recall(rest, found.groupBy("cid").agg(F.sum("links").alias("links")), threshold)
        LOG.info("recall of links outside crowds: %.4f", share)
        if share >= ENOUGH:
            break
    links = common.durable(crowd.unionByName(found).groupBy("cid").agg(F.sum("links").alias("links")), "counted")
    comps = graphs.components(crowd.unionByName(found).where("cid <> root").select(F.col("cid").alias("a"), F.col("root").alias("b")))
    named = rows.select("cid", "rep", "copies").join(comps.withColumnRenamed("node", "cid"), "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))
    smallest = named.groupBy("comp").agg(F.min("rep").alias("component_id"))
    named = common.durable(named.join(smallest, "comp").join(links, "cid", "left").select("cid", "component_id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links")), "named")
    e = F.col("embedding").cast("array<double>")
    x = emb.select("vec_id", F.xxhash64("label", e).alias("cid"), F.col("label").isNull().alias("none"))
    x = x.join(named, (x["cid"] == named["cid"]) & ~x["none"], "left")
    return x.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))


def op9_flatgraph(spark, sf_dir: str) -> DataFrame:
    out = near_duplicates(common.table(spark, sf_dir, "embeddings"))
    return out.select("vec_id", "n_links", "component_id", F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))
