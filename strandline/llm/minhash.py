"""MinHash near-dedup with bottom-k sketches from one hash function.

1. Each text becomes its set of distinct word shingles (64-bit hashes); texts of equal sets form one class. A class
   keeps the K smallest hashes, its sketch.
2. Inverted lists of retained values give candidates. Two sets of the wanted similarity share `least` of K retained
   values (at 0.85 all but one pair in some 10^8 at the very threshold, fewer above it), so if values are ordered by how many classes retain them, the pair shares
   one of its K - least + 1 rarest. Only these keys are listed: a value of a common passage is a key of texts that
   hardly hold anything else.
3. Lists of up to LIST classes give all their pairs. From longer ones each class is paired with the list's hub, its
   most central class (of the most shared values), over its HUBS rarest long lists.
   Classes of long lists that fall into several components are listed anew by the exact rule, over their whole sets: of
   n shingles, in order of rarity, the n - ceil(t * n) + 1 first. Lists that are long again are listed by what tells their
   members from the list's hub, and so on for DEPTH times (differences()): a crowd of texts that are nearly, but not
   quite, similar enough is never paired with itself.
4. Pairs are filtered by the estimate from the sketch of the union, and verified by the Jaccard similarity of the whole
   sets. Pairs inside one component are not verified any more. Components come from joins.

Defined cases: words are parted by [\\x20\\x09-\\x0D]+, A-Z is lower-cased; a text of fewer words than a shingle is one
shingle; null texts and texts without words have no shingles and are linked with nothing; repeated rows are copies of
one another; a null id has no part in the smallest id; an empty table gives an empty result; other columns stay out."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm import common, graphs, textvec

K = 64
LIST = 8
HUBS = 3
#: Times that long lists are listed anew by differences; what is still apart then is paired.
DEPTH = 1
SIGMAS = 6.4
#: Candidate classes up to this many (16 bytes each) are broadcast to fetch their texts; more are joined by shuffle.
BROADCAST_IDS = 1_000_000

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def least(k: int, threshold: float) -> int:
    """Retained values that two sets of the threshold's similarity share, but for SIGMAS standard deviations."""
    return max(1, math.floor(k * threshold - SIGMAS * math.sqrt(k * threshold * (1 - threshold))))


def shingle_sets(column: pa.Array, width: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each row."""
    data, off = textvec.raw(column)
    parts: list[list[np.ndarray]] = [[] for _ in range(len(off) - 1)]
    for d, o, rows in textvec.pieces(data, off, width - 1):
        low = _LOWER[d]
        s, e, row = textvec.words(low, o)
        h = textvec.span_hash(low, s, e)
        sh, sr = textvec.follow(h, row, width)
        first = np.searchsorted(sr, np.arange(len(o)))
        words = np.searchsorted(row, np.arange(len(o)))
        for k in range(len(o) - 1):
            if first[k + 1] > first[k]:
                parts[rows[k]].append(np.unique(sh[first[k] : first[k + 1]]))
            elif words[k + 1] > words[k]:  # the whole sequence is one shingle
                x = np.full(1, 1 + words[k + 1] - words[k], np.uint64)
                for w in h[words[k] : words[k + 1]]:
                    x = textvec.mix(x * textvec.BASE + w)
                parts[rows[k]].append(x)
    return [p[0] if len(p) == 1 else np.unique(np.concatenate(p)) if p else np.zeros(0, np.uint64) for p in parts]


def class_ids(sets: list[np.ndarray]) -> np.ndarray:
    """A 64-bit fingerprint of each set, equal for equal sets."""
    sums = np.array([textvec.mix(s).sum(dtype=np.uint64) if len(s) else np.uint64(0) for s in sets], np.uint64)
    return textvec.mix(sums ^ np.array([len(s) for s in sets], np.uint64) * textvec.BASE).view(np.int64)


def sketches(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, tkey (xxhash64 of the text), n (size of the set), cid (its class), sketch (the K smallest hashes, as signed numbers)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = shingle_sets(b.column("text"), width)
            n = np.array([len(s) for s in sets], np.int64)
            flat = np.concatenate([np.zeros(0, np.uint64), *(s[:K] for s in sets)]).view(np.int64)
            off = np.r_[0, np.cumsum(np.minimum(n, K))].astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("tkey"), pa.array(n), pa.array(class_ids(sets)), pa.ListArray.from_arrays(pa.array(off), pa.array(flat))], ["doc_id", "tkey", "n", "cid", "sketch"])

    return docs.select("doc_id", F.xxhash64("text").alias("tkey"), "text").mapInArrow(common.freeing(run), "doc_id long, tkey long, n long, cid long, sketch array<long>")


def _near(a: np.ndarray, b: np.ndarray) -> tuple[int, int]:
    """Of the K smallest of the union of two sketches: how many both hold, and how many there are."""
    x, y = a.view(np.uint64), b.view(np.uint64)
    u = np.union1d(x, y)[:K]
    return int(np.isin(u, x, assume_unique=True)[np.isin(u, y, assume_unique=True)].sum()), len(u)


def _estimate(low: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for c in ("sa", "sb"):
                col = b.column(c)
                found.append((col.values.to_numpy(zero_copy_only=False), col.offsets.to_numpy()))
            (va, oa), (vb, ob) = found
            est = np.zeros(b.num_rows)
            for k in range(b.num_rows):
                both, size = _near(va[oa[k] : oa[k + 1]], vb[ob[k] : ob[k + 1]])
                est[k] = both / size if size else 0.0
            keep = pa.array(est >= low)
            yield pa.RecordBatch.from_arrays([b.column("a").filter(keep), b.column("b").filter(keep), pa.array(est).filter(keep)], ["a", "b", "est"])

    return run


class _Job:
    def __init__(self, docs: DataFrame, width: int, percent: int):
        self.docs, self.width, self.percent = docs.select("doc_id", "text"), width, percent
        common.prepare(docs.sparkSession)
        self.need = least(K, percent / 100)
        self.edges: DataFrame | None = None
        self.comps: DataFrame | None = None

    def near(self, pairs: DataFrame) -> DataFrame:
        """The pairs (a, b) that the sketch of the union lets pass, with est."""
        s = self.classes.select("cid", "sketch")
        x = pairs.join(s.select(F.col("cid").alias("a"), F.col("sketch").alias("sa")), "a").join(s.select(F.col("cid").alias("b"), F.col("sketch").alias("sb")), "b")
        return common.durable(x.select("a", "b", "sa", "sb").mapInArrow(common.freeing(_estimate(self.need / K)), "a long, b long, est double"), "near")

    def sets(self, pairs: DataFrame) -> DataFrame:
        """cid, set: the whole shingle sets of the classes of pairs, read from their smallest documents."""
        ids = pairs.select(F.col("a").alias("cid")).unionByName(pairs.select(F.col("b").alias("cid"))).distinct()
        ids = common.durable(self.classes.select("cid", F.col("rep").alias("doc_id")).join(ids, "cid"), "ids")
        if ids.count() <= BROADCAST_IDS:
            ids = F.broadcast(ids)
        width = self.width

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:  # an id may stand for several texts
                found = shingle_sets(b.column("text"), width)
                keep = np.flatnonzero(class_ids(found) == b.column("cid").to_numpy())
                flat = np.concatenate([np.zeros(0, np.uint64), *(found[k] for k in keep)]).view(np.int64)
                off = np.r_[0, np.cumsum([len(found[k]) for k in keep])].astype(np.int32)
                yield pa.RecordBatch.from_arrays([b.column("cid").take(pa.array(keep)), pa.ListArray.from_arrays(pa.array(off), pa.array(flat))], ["cid", "set"])

        out = self.docs.join(ids, self.docs["doc_id"].eqNullSafe(ids["doc_id"])).select("cid", "text").mapInArrow(common.freeing(run), "cid long, set array<long>")
        out = common.durable(out, "sets")
        ends = out.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("cid").alias("k")).first()
        return out if ends["n"] == ends["k"] else common.durable(out.dropDuplicates(["cid"]), "sets")  # rows repeat

    def link(self, pairs: DataFrame, sets: DataFrame) -> None:
        """Verifies pairs on the whole sets, adds the links, and renews the components."""
        x = pairs.select("a", "b").join(sets.select(F.col("cid").alias("a"), F.col("set").alias("sa")), "a").join(sets.select(F.col("cid").alias("b"), F.col("set").alias("sb")), "b")
        x = x.select("a", "b", (F.size("sa") + F.size("sb")).alias("total"), F.size(F.array_intersect("sa", "sb")).alias("both"))
        self.add(x.where(F.col("both") * 100 >= (F.col("total") - F.col("both")) * self.percent).select("a", "b"))

    def add(self, links: DataFrame) -> None:
        stars = links if self.comps is None else links.unionByName(self.comps.select(F.col("node").alias("a"), F.col("comp").alias("b")))
        self.comps = common.durable(graphs.components(stars), "comps")

    def apart(self, pairs: DataFrame) -> DataFrame:
        """The pairs whose ends are not in one component."""
        c = self.comps
        x = pairs.join(c.select(F.col("node").alias("a"), F.col("comp").alias("ca")), "a", "left").join(c.select(F.col("node").alias("b"), F.col("comp").alias("cb")), "b", "left")
        return x.where("coalesce(ca, a) <> coalesce(cb, b)").drop("ca", "cb")

    def run(self) -> DataFrame:
        ratio = self.percent / 100
        rows = common.durable(sketches(self.docs, self.width), "sketches")
        self.classes = common.durable(rows.where("n > 0").groupBy("cid").agg(F.min("doc_id").alias("rep"), F.any_value("n").alias("n"), F.any_value("sketch").alias("sketch")), "classes")
        values = self.classes.select("cid", "n", F.explode("sketch").alias("v"))
        shared = values.groupBy("v").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
        # K values a class at most; those that no other class has count as rarest
        mine = values.join(shared, "v").groupBy("cid", "n").agg(F.sort_array(F.collect_list(F.struct("df", "v"))).alias("vs"))
        mine = mine.withColumn("common", F.size("vs"))
        size = F.least(F.col("n"), F.lit(K)).cast("int")
        keys = size - F.floor(size * F.lit(self.need) / K).cast("int") + 1 - (size - F.size("vs"))
        mine = mine.withColumn("keys", keys).where("keys > 0").select("cid", "n", "common", F.explode(F.transform(F.slice("vs", 1, F.col("keys")), lambda x: x["v"])).alias("v"))
        mine = common.durable(mine, "keys")
        lists = mine.groupBy("v").agg(F.count(F.lit(1)).alias("m"), F.max_by("cid", F.struct("common", "cid")).alias("hub")).where("m > 1")
        listed = common.durable(mine.join(lists, "v"), "listed")
        short, long = listed.where(F.col("m") <= LIST), listed.where(F.col("m") > LIST)
        fits = (F.least("n", "n2") >= F.greatest("n", "n2") * ratio)
        other = short.select("v", F.col("cid").alias("cid2"), F.col("n").alias("n2"))
        pairs = short.join(other, "v").where(F.col("cid") < F.col("cid2")).where(fits).select(F.col("cid").alias("a"), F.col("cid2").alias("b"))
        rank = F.row_number().over(Window.partitionBy("cid").orderBy("m", "v"))  # K rows a class at most
        hubs = long.withColumn("rank", rank).where((F.col("rank") <= HUBS) & (F.col("cid") != F.col("hub"))).select(F.least("cid", "hub").alias("a"), F.greatest("cid", "hub").alias("b"))
        near = self.near(pairs.unionByName(hubs).distinct())
        sets = self.sets(near)
        # a spanning choice first: each class with the likeliest of its partners
        both = near.unionByName(near.select(F.col("b").alias("a"), F.col("a").alias("b"), "est"))
        best = both.groupBy("a").agg(F.max(F.struct("est", "b")).alias("x")).select(F.least("a", "x.b").alias("a"), F.greatest("a", "x.b").alias("b")).distinct()
        best = common.durable(best, "best")
        self.link(best, sets)
        self.link(common.durable(self.apart(near.join(best, ["a", "b"], "left_anti")), "rest"), sets)
        self.tested = near.select("a", "b")
        self.long_lists(long, ratio)
        return self.result(rows)

    def split(self, listed: DataFrame) -> DataFrame:
        """listed: v, cid and more. Members of the lists that hold several components, with comp, and top: the
        largest component of the list."""
        c = self.comps
        x = listed.join(c.select(F.col("node").alias("cid"), "comp"), "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))
        x = common.durable(x, "members")
        top = x.groupBy("v", "comp").agg(F.count(F.lit(1)).alias("k")).groupBy("v").agg(F.max(F.struct("k", "comp")).alias("top"), F.sum("k").alias("m")).where("top.k < m")
        return common.durable(x.join(top.select("v", F.col("top.comp").alias("top")), "v"), "split")

    def compare(self, pairs: DataFrame, sets: DataFrame) -> None:
        """Filters and verifies pairs that were not looked at before."""
        pairs = common.durable(pairs.distinct().join(self.tested, ["a", "b"], "left_anti"), "new")
        more = self.near(pairs)
        self.tested = self.tested.unionByName(pairs)
        if more.limit(1).count():
            self.link(common.durable(self.apart(more), "apart"), sets)

    def long_lists(self, long: DataFrame, ratio: float) -> None:
        x = self.split(long)
        if not x.limit(1).count():
            return
        sets = self.sets(x.select(F.col("cid").alias("a"), F.col("cid").alias("b")).distinct())
        lists = self.split(common.durable(self.exact_keys(sets), "exact"))
        pair = (F.least("cid", "cid2").alias("a"), F.greatest("cid", "cid2").alias("b"))
        fits = F.least("n", "n2") >= F.greatest("n", "n2") * ratio
        for depth in range(DEPTH + 1):
            if not lists.limit(1).count():
                return
            size = lists.groupBy("v").agg(F.count(F.lit(1)).alias("m"))
            sized = common.durable(lists.join(size, "v"), "sized")
            short = sized if depth == DEPTH else sized.where(F.col("m") <= LIST)
            # the one of the smaller difference probes; top and top are in one component
            y = short.select("v", *(F.col(c).alias(f"{c}2") for c in ("cid", "n", "d", "rest", "comp", "top")))
            # if this is the first item that the two share, they share as many more as are left to both at most
            enough = (F.least("rest", "rest2") + 1) * (2 * (100 + self.percent)) >= (F.col("d") + F.col("d2")) * (100 + self.percent) - (F.col("n") + F.col("n2")) * (100 - self.percent)
            found = [x.join(z, "v").where("comp <> comp2 and struct(d, cid) < struct(d2, cid2)").where(fits & enough).select(*pair) for x, z in ((short.where("probe and comp <> top"), y), (short.where("probe and comp = top"), y.where("comp2 <> top2")))]
            self.compare(found[0].unionByName(found[1]), sets)
            if depth < DEPTH:
                lists = self.split(self.differences(sized.where(F.col("m") > LIST), sets))

    def differences(self, lists: DataFrame, sets: DataFrame) -> DataFrame:
        """lists: v, cid, common. New lists of the same classes by what tells them from their list's hub, so that classes of
        one passage, near copies that aren't near enough, part without being paired.

        Let D be how many shingles two sets don't share. They are linked if (100 + percent) * D <= (100 - percent) * (sum
        of sizes). With each one's difference to the hub, D is at most the sum of the two, and twice what the differences
        share is the sum less D. So either the sizes alone say that they are linked, which a star around the class of the
        least excess joins up, or linked ones share as much of their differences as the prefix of the exact rule needs."""
        p = self.percent
        # few hubs serve all lists: a class leans to the hub of most lists among its own, a list to what most members lean to
        first = common.durable(lists.groupBy("v").agg(F.max_by("cid", F.struct("common", "cid")).alias("hub")), "hubs")
        serves = first.groupBy("hub").agg(F.count(F.lit(1)).alias("lists"))
        mine = lists.select("v", "cid").join(first, "v").join(serves, "hub").groupBy("cid").agg(F.max(F.struct("lists", "hub"))["hub"].alias("leans"))
        votes = lists.select("v", "cid").join(mine, "cid").groupBy("v", "leans").agg(F.count(F.lit(1)).alias("n"))
        hub = votes.groupBy("v").agg(F.max(F.struct("n", "leans"))["leans"].alias("hub"))
        members = common.durable(lists.select("v", "cid").join(hub, "v").select("hub", "cid").distinct(), "members")
        x = members.join(sets, "cid").join(sets.select(F.col("cid").alias("hub"), F.col("set").alias("of")), "hub")
        x = x.select("hub", "cid", F.size("set").alias("n"), F.concat(F.array_except("set", "of"), F.array_except("of", "set")).alias("apart"))
        x = common.durable(x.withColumn("excess", F.size("apart") * (100 + p) - F.col("n") * (100 - p)), "differences")
        star = x.groupBy("hub").agg(F.min(F.struct("excess", "cid")).alias("least"))
        sure = x.join(star, "hub").where((F.col("excess") + F.col("least.excess") <= 0) & (F.col("cid") != F.col("least.cid")))
        self.add(common.durable(sure.select(F.col("cid").alias("a"), F.col("least.cid").alias("b")).distinct(), "sure"))
        items = x.select("hub", "cid", "n", F.size("apart").alias("d"), F.explode("apart").alias("item"))
        shared = items.groupBy("hub", "item").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
        mine = items.join(shared, ["hub", "item"]).groupBy("hub", "cid", "n", "d").agg(F.sort_array(F.collect_list(F.struct("df", "item"))).alias("vs"))
        # what is shared at least with any linked one, and with one whose difference is as large or larger
        prefix = lambda share: (F.size("vs") + 1 - F.greatest(F.lit(1), F.col("d") - F.floor(F.col("n") * share))).cast("int")
        mine = mine.withColumn("keys", prefix((100 - p) / p)).where("keys > 0").withColumn("probes", prefix((100 - p) / (2 * p))).withColumn("common", F.size("vs"))
        out = mine.select("hub", "cid", "n", "d", "common", "probes", F.posexplode(F.slice("vs", 1, F.col("keys"))).alias("at", "x"))
        return common.durable(out.select(F.xxhash64("hub", "x.item").alias("v"), "cid", "n", "common", "d", (F.col("at") < F.col("probes")).alias("probe"), (F.col("common") - F.col("at") - 1).alias("rest")), "lists")

    def exact_keys(self, sets: DataFrame) -> DataFrame:
        """v, cid, n, common, d, probe, rest: the keys of the exact rule. A class more of whose shingles than the rule takes occur in no
        other class has none, and no link among these classes."""
        percent = self.percent
        values = sets.select("cid", F.size("set").cast("long").alias("n"), F.explode("set").alias("v"))
        shared = values.groupBy("v").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
        mine = values.join(shared, "v").groupBy("cid", "n").agg(F.sort_array(F.collect_list(F.struct("df", "v"))).alias("vs")).withColumn("common", F.size("vs"))
        keys = F.col("n") - F.floor((F.col("n") * percent + 99) / 100) + 1 - (F.col("n") - F.col("common"))
        mine = mine.withColumn("keys", keys.cast("int")).where("keys > 0")
        return mine.select("cid", "n", "common", F.lit(0).alias("d"), F.lit(True).alias("probe"), F.lit(0).alias("rest"), F.explode(F.transform(F.slice("vs", 1, F.col("keys")), lambda x: x["v"])).alias("v"))

    def result(self, rows: DataFrame) -> DataFrame:
        named = self.classes.select("cid", "rep").join(self.comps.select(F.col("node").alias("cid"), "comp"), "cid", "left").withColumn("comp", F.coalesce("comp", "cid"))
        smallest = named.groupBy("comp").agg(F.min("rep").alias("component_id"))
        named = common.durable(named.join(smallest, "comp").select("cid", "component_id"), "named")
        linked = rows.where("n > 0").select("doc_id", "tkey", F.col("n").alias("n_shingles"), "cid").join(named, "cid").drop("cid")
        alone = rows.where("n = 0").select("doc_id", "tkey", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
        return linked.unionByName(alone)


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """docs: doc_id, text. doc_id, tkey, n_shingles, component_id: texts of percent / 100 similarity or more are linked."""
    return _Job(docs, width, percent).run()


def op6_minhash(spark, sf_dir: str) -> DataFrame:
    out = near_duplicates(common.table(spark, sf_dir, "documents"), 3, 85)
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
