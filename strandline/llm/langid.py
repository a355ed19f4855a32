"""Language ID: an interpolated Kneser-Ney character language model per language.

A text is read as letters in lower case, every run of other characters as one space. Highest-order counts are gathered
from every text that is learned from; lower orders count distinct left neighbours, as Kneser-Ney has it. The models are
kept as sorted arrays of n-gram hashes, one per order, with a column of log-probabilities per language, so one look-up
serves all languages. A character counts by its low 16 bits, so four fit a 64-bit code and hashing it loses nothing. A text goes to the language of lowest cross-entropy per character.

Every counted n-gram is kept. A model of up to LOCAL cells is fitted in the driver and broadcast; a larger one is fitted by
joins, goes to the driver's disk part by part, and workers map its files, so no process holds it.

Rejection is calibrated on all rows learned from: a text is rejected if its cross-entropy is above what all but a REJECT
share of its language's rows have, and a margin. A language of fewer than 1 / REJECT rows has too few for that share: its
limit is the larger of its own and that of the rows of all languages. The score is the language's share of
exp(-sharpness * cross-entropy), which is calibrated the same way.

Defined cases: null texts and texts without a letter are `und` with score 0, and rejected; rows of null lang are not
learned from; repeated rows get equal results; other columns are ignored; nothing to learn from makes every text `und`."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import SparkFiles
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm import common, textvec

ORDER = 4
DISCOUNT = 0.75
#: Cells (n-grams of the highest order times languages) up to which a model is fitted in the driver, and rows of a part of a larger one.
LOCAL, PART = 4_000_000, 500_000
#: Looked up at once: so many values of n-grams x languages. Longer tables than INDEXED are searched by bisection.
CELLS, INDEXED = 2 << 20, 1 << 22
REJECT, MARGIN = 0.001, 1.1
BINS = 4096
SHARPNESS = (1.0, 2.0, 4.0, 8.0, 16.0, 32.0)
UNDEFINED = "und"
_INDEX_BITS = 18

_state: dict = {}


def _letters() -> np.ndarray:
    """For each code point: 0 if it is no letter, else its lower case. Built once per process."""
    if "low" not in _state:
        points = np.zeros(0x110000, np.uint32)
        for i in range(0x110000):
            ch = chr(i)
            if ch.isalpha():
                low = ch.lower()
                points[i] = ord(low[0])
        _state["low"] = points
    return _state["low"]


def decode(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of a block of UTF-8, and the offsets of its rows in them."""
    lead = (data & 0xC0) != 0x80
    total = np.r_[0, np.cumsum(lead)]
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le", "replace"), np.uint32)
    if len(points) != total[-1]:  # bytes that are no UTF-8
        rows = [data[a:b].tobytes().decode("utf-8", "replace").encode("utf-32-le", "replace") for a, b in zip(off[:-1], off[1:])]
        return np.frombuffer(b"".join(rows), np.uint32), np.r_[0, np.cumsum([len(r) // 4 for r in rows])]
    return points, total[off]


def letters(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Letters in lower case, 0 for each run of others, and before each row's first letter. Rows keep their order."""
    points, po = decode(data, off)
    low = _letters()[points]
    keep = low > 0
    keep[1:] |= low[:-1] > 0
    first = po[:-1][np.diff(po) > 0]
    keep[first] = True
    # a row begins with a space: put one in where its first character is a letter
    size = np.diff(np.r_[0, np.cumsum(keep)][po])
    begins = np.zeros(len(size), bool)
    some = np.flatnonzero(np.diff(po) > 0)
    begins[some] = low[po[:-1][some]] > 0
    out = np.insert(low[keep], np.r_[0, np.cumsum(size)][:-1][begins], 0)
    return out, np.r_[0, np.cumsum(size + begins)]


def grams(x: np.ndarray, off: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the n-grams within rows, and the place of each one's last character."""
    m = len(x) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    c = (x & np.uint32(0xFFFF)).astype(np.uint64)
    h = c[:m].copy()
    for i in range(1, n):
        h <<= np.uint64(16)
        h |= c[i : i + m]
    inside = np.ones(m, bool)
    for o in off[1:-1].tolist():
        inside[max(0, o - n + 1) : o] = False
    at = np.flatnonzero(inside)
    return h[at], at + n - 1


def counts(docs: DataFrame) -> DataFrame:
    """docs: text, lang. lang, gram (its code), n: of all texts; counts of a task are summed before the shuffle."""
    common.prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, dict[int, int]] = {}

        def flush():
            for lang, found in total.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(found), pa.string()), pa.array(list(found), pa.int64()), pa.array(list(found.values()), pa.int64())], ["lang", "gram", "n"])
            total.clear()

        for b in batches:
            data, off = textvec.raw(b.column("text"))
            langs = b.column("lang").to_pylist()
            for d, o, rows in textvec.pieces(data, off, 0):
                x, xo = letters(d, o)
                h, last = grams(x, xo, ORDER)
                names = sorted({langs[r] for r in rows})
                code = np.repeat(np.array([names.index(langs[r]) for r in rows]), np.diff(xo))[last]
                for k, lang in enumerate(names):
                    u, n = np.unique(h[code == k], return_counts=True)
                    found = total.setdefault(lang, {})
                    for g, c in zip(u.view(np.int64).tolist(), n.tolist()):
                        found[g] = found.get(g, 0) + c
            if sum(map(len, total.values())) > 400_000:
                yield from flush()
        yield from flush()

    found = docs.where("lang is not null and text is not null").select("text", "lang").mapInArrow(common.freeing(run), "lang string, gram long, n long")
    return found.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


@dataclass
class Model:
    """hashes[n], logs[n]: sorted n-gram hashes and log-probabilities, a column per language, for n from 1 to ORDER;
    back[n]: log back-off weight of each context of length n. floor: log-probability of an unseen character. files: the
    arrays are in files of this name that Spark ships; opened() maps them."""

    langs: list[str]
    hashes: list[np.ndarray]
    logs: list[np.ndarray]
    back: list[np.ndarray]
    floor: np.ndarray
    limit: np.ndarray
    sharpness: float = 1.0
    files: str = ""

    def opened(self) -> Model:
        if not self.files:
            return self
        at = lambda kind, k: SparkFiles.get(f"{self.files}-{kind}{k}")
        wide = lambda kind, k: np.memmap(at(kind, k), np.float32, "r").reshape(-1, len(self.langs))
        orders = range(1, ORDER + 1)
        hashes = [self.hashes[0], *(np.memmap(at("hashes", k), np.uint64, "r") for k in orders)]
        logs, back = [self.logs[0], *(wide("logs", k) for k in orders)], [self.back[0], *(wide("back", k) for k in orders[:-1])]
        return Model(self.langs, hashes, logs, back, self.floor, self.limit, self.sharpness)


def fit(found: DataFrame) -> Model:
    """found: lang, gram, n as counts() gives it."""
    langs = [r[0] for r in found.select("lang").distinct().orderBy("lang").collect()]
    if found.count() * len(langs) > LOCAL:
        return _fit_large(found, langs)
    rows = found.select("lang", "gram", "n").toArrow()
    lang, gram, n = np.array(rows["lang"].to_pylist(), object), rows["gram"].to_numpy().astype(np.int64).view(np.uint64), rows["n"].to_numpy().astype(float)
    per = [_kneser_ney(gram[lang == name], n[lang == name]) for name in langs]
    model = Model(langs, [np.zeros(0, np.uint64)], [np.zeros((0, len(langs)), np.float32)], [np.zeros((0, len(langs)), np.float32)], np.array([p["floor"] for p in per]), np.full(len(langs), np.inf))
    for k in range(1, ORDER + 1):
        every = np.unique(np.concatenate([np.zeros(0, np.uint64), *(textvec.mix(p["gram"][k]) for p in per)]))
        v, w = np.full((len(every), len(langs)), np.nan, np.float32), np.zeros((len(every), len(langs)), np.float32)
        for j, p in enumerate(per):
            v[np.searchsorted(every, textvec.mix(p["gram"][k])), j] = p["log"][k]
            if k < ORDER:
                h = textvec.mix(p["context"][k])
                at = np.minimum(np.searchsorted(every, h), len(every) - 1)
                ok = every[at] == h
                w[at[ok], j] = p["back"][k][ok]
        model.hashes.append(every)
        model.logs.append(np.where(np.isnan(v), model.floor.astype(np.float32), v) if k == 1 else v)
        model.back.append(w)
    return model


def _fit_large(found: DataFrame, langs: list[str]) -> Model:
    """What fit() gives, by joins. A context or a lower n-gram has at most as many neighbours as there are characters."""
    spark = found.sparkSession
    common.prepare(spark)
    index = spark.createDataFrame(list(zip(langs, range(len(langs)))), "lang string, j int")
    lower = lambda k: F.col("gram").bitwiseAND(F.lit((1 << 16 * k) - 1))
    before = F.shiftrightunsigned("gram", 16)
    count = {ORDER: found.join(F.broadcast(index), "lang").select("j", "gram", "n")}
    for k in range(ORDER - 1, 0, -1):
        count[k] = common.durable(count[k + 1].groupBy("j", lower(k).alias("gram")).agg(F.count(F.lit(1)).alias("n")), "ngrams")
    sums = sorted((r.j, r.total, DISCOUNT * r.kinds / r.total / 0x11000) for r in count[1].groupBy("j").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds")).collect())
    one = spark.createDataFrame(sums, "j int, total long, floor double")
    p = count[1].join(F.broadcast(one), "j").select("j", "gram", (F.greatest(F.col("n") - DISCOUNT, F.lit(0.0)) / F.col("total") + F.col("floor")).alias("p"))
    rows = None
    for k in range(1, ORDER + 1):
        if k > 1:
            w = Window.partitionBy("j", before)
            x = count[k].select("j", "gram", "n", F.sum("n").over(w).alias("sums"), F.count(F.lit(1)).over(w).alias("kinds"), lower(k - 1).alias("under"))
            p = x.join(p.select("j", F.col("gram").alias("under"), F.col("p").alias("q")), ["j", "under"])
            p = p.select("j", "gram", (F.greatest(F.col("n") - DISCOUNT, F.lit(0.0)) / F.col("sums") + DISCOUNT * F.col("kinds") / F.col("sums") * F.col("q")).alias("p"))
            p = common.durable(p, "ngrams")
        values = p.select("gram", "j", F.log("p").cast("float").alias("log"), F.lit(None).cast("float").alias("back"))
        if k < ORDER:
            context = count[k + 1].groupBy("j", before.alias("gram")).agg(F.log(DISCOUNT * F.count(F.lit(1)) / F.sum("n")).cast("float").alias("back"))
            values = values.unionByName(context.select("gram", "j", F.lit(None).cast("float").alias("log"), "back"))
        values = values.groupBy("gram").agg(F.collect_list(F.struct("j", "log", "back")).alias("v"), F.count("log").alias("n")).where("n > 0").select(F.lit(k).alias("k"), "gram", "v")
        rows = values if rows is None else rows.unionByName(values)
    floor = np.log([x[2] for x in sums])
    wide = np.zeros((0, len(langs)), np.float32)
    return Model(langs, [np.zeros(0, np.uint64)], [wide], [wide], floor, np.full(len(langs), np.inf), 1.0, _ship(common.durable(rows, "ngrams"), floor))


def _ship(rows: DataFrame, floor: np.ndarray) -> str:
    """rows: k, gram, v (j, log, back). Writes the sorted arrays to files that Spark ships to executors; their name."""
    spark, n = rows.sparkSession, len(floor)
    flip = np.uint64(1 << 63)  # orders as signed what mix() orders as unsigned

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = textvec.mix(b.column("gram").to_numpy().view(np.uint64)) ^ flip
            yield pa.RecordBatch.from_arrays([b.column("k"), pa.array(h.view(np.int64)), b.column("v")], ["k", "key", "v"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            order, v = b.column("k").to_numpy(), b.column("v")
            at, flat = pc.list_parent_indices(v).to_numpy(), pc.list_flatten(v)
            j, log, back = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(3))
            logs, backs = np.full((len(order), n), np.nan, np.float32), np.zeros((len(order), n), np.float32)
            some = ~np.isnan(log)
            logs[at[some], j[some]] = log[some]
            some = ~np.isnan(back)
            backs[at[some], j[some]] = back[some]
            h = b.column("key").to_numpy().view(np.uint64) ^ flip
            for k in np.unique(order).tolist():
                mine = order == k
                block = np.where(np.isnan(logs[mine]), floor.astype(np.float32), logs[mine]) if k == 1 else logs[mine]
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), *(pa.array([x.tobytes()], pa.binary()) for x in (h[mine], block, backs[mine]))], ["k", "hashes", "logs", "back"])

    keyed = rows.mapInArrow(common.freeing(key), "k int, key long, v array<struct<j: int, log: float, back: float>>")
    parts = keyed.repartitionByRange(rows.count() * n // (8 * PART) + 1, "k", "key").sortWithinPartitions("k", "key")
    blocks = parts.mapInArrow(common.freeing(pack), "k int, hashes binary, logs binary, back binary")
    folder, name = tempfile.mkdtemp(prefix="strandline_model_"), f"langid-{uuid.uuid4().hex}"
    atexit.register(shutil.rmtree, folder, True)  # the driver serves it while the context lives
    out = {(kind, k): open(os.path.join(folder, f"{name}-{kind}{k}"), "wb") for kind in ("hashes", "logs", "back") for k in range(1, ORDER + 1)}
    try:
        for r in blocks.toLocalIterator():
            for kind in ("hashes", "logs", "back"):
                out[kind, r.k].write(r[kind])
    finally:
        for file in out.values():
            file.close()
    for file in out.values():
        spark.sparkContext.addFile(file.name)
    return name


def _kneser_ney(gram: np.ndarray, n: np.ndarray, discount: float = DISCOUNT) -> dict:
    """Interpolated probabilities of one language by order, from the counts of its highest order; back[k] is the
    logarithm of what a context of k characters leaves to the order below."""
    order = np.argsort(gram)
    codes, count = {ORDER: gram[order]}, {ORDER: n[order]}
    mask = {k: np.uint64((1 << 16 * k) - 1) for k in range(ORDER)}
    for k in range(ORDER - 1, 0, -1):  # continuation counts: distinct left neighbours
        codes[k], c = np.unique(codes[k + 1] & mask[k], return_counts=True)
        count[k] = c.astype(float)
    total = count[1].sum()
    floor = discount * len(codes[1]) / total / 0x11000
    out: dict = {"gram": [None], "log": [None], "context": [None], "back": [None], "floor": float(np.log(floor))}
    p = np.maximum(count[1] - discount, 0) / total + floor
    out["gram"].append(codes[1])
    out["log"].append(np.log(p))
    for k in range(2, ORDER + 1):
        contexts, inv = np.unique(codes[k] >> np.uint64(16), return_inverse=True)
        sums, kinds = np.bincount(inv, count[k]), np.bincount(inv)
        left = discount * kinds / sums
        under = p[np.searchsorted(codes[k - 1], codes[k] & mask[k - 1])]
        p = np.maximum(count[k] - discount, 0) / sums[inv] + left[inv] * under
        out["gram"].append(codes[k])
        out["log"].append(np.log(p))
        out["context"].append(contexts)
        out["back"].append(np.log(left))
    return out


class Scorer:
    """Looks n-grams up in the sorted arrays; a table by leading bits says where to begin."""

    def __init__(self, model: Model):
        self.m = model = model.opened()
        self.begin = []
        for h in model.hashes:
            self.begin.append(np.searchsorted(h, np.arange(1 << _INDEX_BITS, dtype=np.uint64) << np.uint64(64 - _INDEX_BITS)).astype(np.int32))
        self.span = [int(np.diff(np.r_[b, len(h)]).max()) if len(h) else 0 for b, h in zip(self.begin, model.hashes)]

    def find(self, k: int, h: np.ndarray) -> np.ndarray:
        """Places of codes in the array of order k, -1 where there is none."""
        h = textvec.mix(h)
        table = self.m.hashes[k]
        out = np.full(len(h), -1, np.int64)
        if not len(table):
            return out
        if len(table) > INDEXED:
            u, inv = np.unique(h, return_inverse=True)
            at = np.minimum(np.searchsorted(table, u), len(table) - 1)
            return np.where(table[at] == u, at, -1)[inv]
        at = self.begin[k][(h >> np.uint64(64 - _INDEX_BITS)).astype(np.int64)]
        todo = np.arange(len(h))
        for step in range(self.span[k]):
            place = np.minimum(at[todo] + step, len(table) - 1)
            hit = table[place] == h[todo]
            out[todo[hit]] = place[hit]
            todo = todo[~hit & (table[place] < h[todo])]
            if not len(todo):
                break
        return out

    def logs(self, x: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Summed log-probabilities, rows x languages, and the characters scored in each row."""
        m, n = self.m, len(off) - 1
        total, size = np.zeros((n, len(m.langs))), np.zeros(n, np.int64)
        h, last = grams(x, off, ORDER)
        row = np.repeat(np.arange(n), np.diff(off))[last]
        size += np.bincount(row, minlength=n)
        step = max(1, CELLS // len(m.langs))
        for lo in range(0, len(h), step):
            value = self._order(ORDER, h[lo : lo + step])
            for j in range(len(m.langs)):
                total[:, j] += np.bincount(row[lo : lo + step], value[:, j], n)
        # the first characters of a row have shorter contexts
        for k in range(2, ORDER):
            at = off[:-1] + k - 1
            ok = np.flatnonzero(at < off[1:])
            if len(ok):
                total[ok] += self._order(k, self._code(x, at[ok], k))
                size[ok] += 1
        return total, size

    @staticmethod
    def _code(x: np.ndarray, last: np.ndarray, k: int) -> np.ndarray:
        """Codes of the k characters up to each place."""
        h = np.zeros(len(last), np.uint64)
        for i in range(k):
            h = h << np.uint64(16) | (x[last - (k - 1 - i)] & np.uint32(0xFFFF)).astype(np.uint64)
        return h

    def _order(self, k: int, h: np.ndarray) -> np.ndarray:
        """Log-probabilities of n-grams of order k; those that a language lacks back off to the order below."""
        m = self.m
        place = self.find(k, h)
        if k == 1:
            return np.where((place < 0)[:, None], m.floor.astype(np.float32), m.logs[1][place])
        out = m.logs[k][place]
        out[place < 0] = np.nan
        need = np.flatnonzero(np.isnan(out).any(1))
        if len(need):
            u, inv = np.unique(h[need], return_inverse=True)
            context = self.find(k - 1, u >> np.uint64(16))
            back = np.where((context < 0)[:, None], 0, m.back[k - 1][context])
            filled = (self._order(k - 1, u & np.uint64((1 << 16 * (k - 1)) - 1)) + back)[inv]
            out[need] = np.where(np.isnan(out[need]), filled, out[need])
        return out


def _entropies(scorer: Scorer, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Cross-entropy per character, rows x languages, and the number of characters, 0 where there is no letter."""
    data, off = textvec.raw(column)
    n = len(off) - 1
    total, size = np.zeros((n, len(scorer.m.langs))), np.zeros(n, np.int64)
    for d, o, rows in textvec.pieces(data, off, 0):
        x, xo = letters(d, o)
        some = np.diff(np.r_[0, np.cumsum(x > 0)][xo]) > 0
        t, s = scorer.logs(x, xo)
        np.add.at(total, rows, np.where(some[:, None], t, 0))
        np.add.at(size, rows, np.where(some, s, 0))
    return -total / np.maximum(size, 1)[:, None], size


def calibrate(model: Model, docs: DataFrame) -> Model:
    """Sets the limits of rejection and the sharpness of the score on all of docs (text, lang): per language a histogram
    of its rows' cross-entropies, BINS a nat, and the loss of each sharpness, summed in Spark."""
    if not model.langs:
        return model
    spark = docs.sparkSession
    common.prepare(spark)
    cast = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = cast.value
        scorer, index = Scorer(m), {x: j for j, x in enumerate(m.langs)}
        found: dict[tuple[int, int], int] = {}
        loss = np.zeros(len(SHARPNESS))
        for b in batches:
            e, size = _entropies(scorer, b.column("text"))
            true = np.array([index.get(x, -1) for x in b.column("lang").to_pylist()], np.int64)
            some = np.flatnonzero((size > 0) & (true >= 0))
            e, true = e[some], true[some]
            own = e[np.arange(len(e)), true]
            cells, n = np.unique(np.stack([true, np.ceil(own * BINS).astype(np.int64)], 1), axis=0, return_counts=True)
            for (j, at), c in zip(cells.tolist(), n.tolist()):
                found[j, at] = found.get((j, at), 0) + c
            for i, s in enumerate(SHARPNESS):
                z = -(e - e.min(1, keepdims=True)) * s
                loss[i] -= (z[np.arange(len(e)), true] - np.log(np.exp(z).sum(1))).sum()
        rows = [(j, at, c, 0.0) for (j, at), c in found.items()] + [(-1, i, 0, x) for i, x in enumerate(loss.tolist())]
        yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*rows), (pa.int32(), pa.int64(), pa.int64(), pa.float64()))], ["j", "at", "n", "loss"])

    rows = docs.where("lang is not null and text is not null").select("text", "lang").mapInArrow(common.freeing(run), "j int, at long, n long, loss double")
    got = rows.groupBy("j", "at").agg(F.sum("n").alias("n"), F.sum("loss").alias("loss")).orderBy("j", "at").toArrow()
    j, at, n, loss = (got[c].to_numpy() for c in ("j", "at", "n", "loss"))
    if not n.sum():
        return model
    every = np.argsort(at[j >= 0], kind="stable")
    pooled = _quantile(at[j >= 0][every], n[j >= 0][every])
    for k in range(len(model.langs)):
        mine = j == k
        own = _quantile(at[mine], n[mine])
        model.limit[k] = (own if n[mine].sum() >= 1 / REJECT else max(own, pooled)) * MARGIN
    # of equal losses, the first
    model.sharpness = SHARPNESS[int(at[j < 0][np.argmin(loss[j < 0])])]
    return model


def _quantile(at: np.ndarray, n: np.ndarray) -> float:
    """The upper edge of the bin (bins in order) which all but a REJECT share of the rows don't exceed; 0 without rows."""
    below = np.cumsum(n)
    return at[np.searchsorted(below, np.ceil((1 - REJECT) * below[-1]))] / BINS if len(n) else 0.0


def predict(docs: DataFrame, model: Model, keep_text: bool = False) -> DataFrame:
    """docs, which has a column text, with lang_pred, score, entropy and rejected, and without text unless it is kept."""
    spark = docs.sparkSession
    common.prepare(spark)
    cast = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = cast.value
        scorer = Scorer(m)
        names = np.array([*m.langs, UNDEFINED], object)
        for b in batches:
            n = b.num_rows
            if m.langs:
                e, size = _entropies(scorer, b.column("text"))
                best, ok = e.argmin(1), size > 0
                low = e[np.arange(n), best]
                score = np.where(ok, 1 / np.exp(-(e - low[:, None]) * m.sharpness).sum(1), 0.0)
                rejected = ~ok | (low > m.limit[best])
                lang = names[np.where(ok, best, -1)]
            else:
                lang, score, low, rejected = np.full(n, UNDEFINED, object), np.zeros(n), np.zeros(n), np.ones(n, bool)
            kept = [i for i, x in enumerate(b.schema.names) if keep_text or x != "text"]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in kept), pa.array(lang, pa.string()), pa.array(score), pa.array(low), pa.array(rejected)], [*(b.schema.names[i] for i in kept), "lang_pred", "score", "entropy", "rejected"])

    out = type(docs.schema)([f for f in docs.schema.fields if keep_text or f.name != "text"]).add("lang_pred", "string").add("score", "double").add("entropy", "double").add("rejected", "boolean")
    return docs.mapInArrow(common.freeing(run), out)


def learn(docs: DataFrame) -> Model:
    """docs: doc_id, text, lang, all of them learned from."""
    found = common.durable(counts(docs), "ngrams")
    return calibrate(fit(found), docs)


def op4_langid(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = learn(docs.where(common.crc_mod(F.col("doc_id"), 3) != 1))
    out = predict(docs.select("doc_id", "text"), model)
    return out.select("doc_id", F.coalesce(common.crc_mod(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")
