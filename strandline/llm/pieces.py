"""SentencePiece encoding and decoding by a relational lattice.

1. A text, with the dummy prefix and spaces as U+2581, is cut into segments wherever no piece of the vocabulary holds the
   two characters side by side: no path crosses such a place, so the best path of a text is the best paths of its
   segments, and each distinct segment is worked on once. Pieces that a path of other pieces beats in any text are left
   out before (load()).
2. The substrings of a segment, of the lengths that pieces of the same first characters have, are exploded and equi-joined to
   the piece table, which is broadcast (its size is the vocabulary's). A character without a piece gets an edge of its UTF-8 bytes, at the
   least score less 10. Edges name their segment by an eight-byte number.
3. Edges are grouped by segment and sorted by end and start; a higher-order aggregate folds them into the best score and
   path at each place. Of equal scores the one of the earlier start is kept.
   A segment of over PART characters is folded in parts, once for each place at which a path may enter the part; what
   the parts say of entries and exits is folded in turn, and gives each part's entry and exit of the best path.
4. Documents are put together from segments in vectors: up to FREQUENT of the commonest are broadcast, a document's
   other ones come to it by joins on their numbers.

Scores are those of the model file, summed in double precision: the path is the one of the largest sum, as the library
finds it if the file's model type is set to unigram. A vocabulary that was trained by merging has ranks for scores, and
the library would merge by rank, which is no sum over a path; ids of such a file therefore are not the merges' ids, but
decode to the text all the same.

Defined cases: null counts as empty and has no ids; a segment of any length has its best path; U+2581 in a text reads as
a space when decoded, as it does in the library (`exact` is false then); repeated rows get equal results; an empty table
gives an empty result; other columns stay, but for those named ids or exact, which the result's columns replace."""

from __future__ import annotations

import functools
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.llm import common, textvec

#: The vocabulary file, where the session's setting MODEL_KEY names no other.
MODEL, MODEL_KEY = "/opt/tokenizers/piece_bpe_32k.model", "spark.strandline.pieces.model"
SPACE = "▁"
UNKNOWN_PENALTY = 10.0
#: Characters of a substring that are looked up before longer ones of its start are made.
HEAD = 3
#: Characters that one fold takes; longer segments are folded in parts.
PART = 256
#: Segments that are broadcast at most: numbers, offsets and ids of so many, some 40 bytes each.
FREQUENT = 400_000
PER_TASK = 40_000
#: Bytes of text that are worked on at once.
UNIT = 1 << 20
_LOW = 2**31


@dataclass
class Pieces:
    text: list[str]
    score: list[float]
    normal: np.ndarray  # pieces of text, not controls or bytes
    bytes_from: int  # id of <0x00>; the other bytes follow
    used: list[int] = field(default_factory=list)  # those that can lie on a best path

    def __post_init__(self):
        self.used = self.used or self._unbeaten()

    def _unbeaten(self) -> list[int]:
        """Normal pieces but those that shorter ones put together beat. The beaten lie on no best path."""
        score = {self.text[i]: self.score[i] for i in np.flatnonzero(self.normal)}

        def split(t: str) -> float:
            best = [0.0] + [-np.inf] * len(t)
            for e in range(1, len(t) + 1):
                for s in range(1 if e == len(t) else 0, e):
                    if t[s:e] in score:
                        best[e] = max(best[e], best[s] + score[t[s:e]])
            return best[-1]

        return [int(i) for i in np.flatnonzero(self.normal) if len(t := self.text[i]) == 1 or split(t) <= (x := self.score[i]) + 1e-6 * (1 + abs(x))]

    def heads(self) -> list[tuple[str, list[int]]]:
        """The first HEAD characters of pieces, each with 1 and the lengths of all pieces that a text which goes on like this
        can begin with. Where a text goes on otherwise, only shorter ones than HEAD can be pieces."""
        used = {self.text[i] for i in self.used}
        lens: dict[str, set[int]] = {}
        for t in used:
            if len(t) >= HEAD:
                lens.setdefault(t[:HEAD], {1, *(k for k in range(2, HEAD) if t[:k] in used)}).add(len(t))
        return [(t, sorted(n)) for t, n in sorted(lens.items())]

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(self.text[i], i, float(self.score[i])) for i in self.used], "piece string, id int, score double")

    @property
    def longest(self) -> int:
        return max(len(self.text[i]) for i in self.used)

    @property
    def unknown(self) -> float:
        return min(self.score[i] for i in np.flatnonzero(self.normal)) - UNKNOWN_PENALTY

    def bytes_of(self) -> tuple[np.ndarray, np.ndarray]:
        """The bytes that ids decode to, as one array and offsets."""
        out = []
        for i, t in enumerate(self.text):
            byte = i - self.bytes_from
            out.append(bytes([byte]) if 0 <= byte < 256 else t.replace(SPACE, " ").encode() if self.normal[i] else b"")
        return np.frombuffer(b"".join(out), np.uint8), np.r_[0, np.cumsum([len(x) for x in out])]

    def cutter(self) -> Cutter:
        long = [self.text[i] for i in self.used if len(self.text[i]) > 1]
        chars = sorted({c for t in long for c in t})
        kind = np.zeros(max(map(ord, [*chars, SPACE])) + 2, np.uint16)  # all characters beyond are of the last one's kind, none
        kind[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        kind[0x20] = kind[ord(SPACE)]
        side = np.zeros((len(chars) + 1, len(chars) + 1), bool)
        for t in long:
            k = kind[[ord(c) for c in t]]
            side[k[:-1], k[1:]] = True
        return Cutter(kind, side)


@dataclass
class Cutter:
    """Where a text can be cut: the kind of each character, and which kinds stand side by side in a piece."""

    kind: np.ndarray
    side: np.ndarray

    def begins(self, body: np.ndarray, new: np.ndarray) -> np.ndarray:
        """Starts of the segments of a block of texts; new: where texts start."""
        begin = np.zeros(len(body), bool)
        begin[new] = True
        n, lo, last = len(body), 0, 0
        while lo < n:
            hi = min(n, lo + UNIT)
            while hi < n and body[hi] & 0xC0 == 0x80:
                hi += 1
            part = body[lo:hi]
            at = np.flatnonzero(part & 0xC0 != 0x80)
            code = part[at].astype(np.uint32)
            wide = np.flatnonzero(code >= 0xC0)
            if len(wide):
                more = np.r_[part, np.zeros(4, np.uint8)].astype(np.uint32) & 0x3F
                p, lead = at[wide], code[wide]
                two = (lead & 0x1F) << 6 | more[p + 1]
                three = (lead & 0x0F) << 12 | more[p + 1] << 6 | more[p + 2]
                four = (lead & 0x07) << 18 | more[p + 1] << 12 | more[p + 2] << 6 | more[p + 3]
                code[wide] = np.where(lead < 0xE0, two, np.where(lead < 0xF0, three, four))
            k = self.kind[np.minimum(code, len(self.kind) - 1)].astype(np.int64)
            width = self.side.shape[1]
            begin[at[1:][~self.side.ravel()[k[:-1] * width + k[1:]]] + lo] = True
            begin[lo] |= lo and not self.side[last, k[0]]
            last = k[-1]
            lo = hi
        return np.flatnonzero(begin)


@functools.lru_cache(4)
def _load(path: str) -> Pieces:
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path)
    n = m.get_piece_size()
    text = [m.id_to_piece(i) for i in range(n)]
    normal = np.array([not (m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i)) for i in range(n)])
    first = m.piece_to_id("<0x00>")
    if not all(m.is_byte(first + k) and text[first + k] == f"<0x{k:02X}>" for k in range(256)):
        raise ValueError("the model has no byte pieces in a row")
    return Pieces(text, [m.get_score(i) for i in range(n)], normal, first)


def load(where: str | SparkSession = MODEL) -> Pieces:
    """The pieces of a model file, or of the one that the session's setting names."""
    return _load(where if isinstance(where, str) else where.conf.get(MODEL_KEY, MODEL))


def segments(data: np.ndarray, off: np.ndarray, cutter: Cutter) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A block with a space put before each row that isn't empty; start, end and row of each segment."""
    some = np.flatnonzero(np.diff(off) > 0)
    body = np.insert(data, off[some], 0x20)
    o = np.r_[0, np.cumsum(np.diff(off) + (np.diff(off) > 0))]
    if not len(body):
        z = np.zeros(0, np.int64)
        return body, z, z, z
    starts = cutter.begins(body, o[some])
    return body, starts, np.r_[starts[1:], len(body)], np.searchsorted(o, starts, "right") - 1


def _blocks(column: pa.Array, cutter: Cutter) -> Iterator[tuple]:
    """Segments of a column, some rows at a time: first row, rows, then as segments() has it, then the distinct segments'
    numbers, first places and each segment's place among them."""
    data, off = textvec.raw(column)
    n, lo = len(off) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(off, off[lo] + UNIT, "right")) - 1)
        body, s, e, row = segments(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo], cutter)
        yield lo, hi - lo, body, s, e, row, *textvec.unique(textvec.span_hash(body, s, e))
        lo = hi


def _numbered(row: np.ndarray, number: np.ndarray, width: int, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Occurrences of segments, in order of place. First occurrences of each in its row, in order of row and place; the
    pair (row, segment) of each occurrence; each pair's number in its row, by first occurrence; pairs of each row."""
    _, first, pair = textvec.unique(row * width + number)
    at = row[first]
    many = np.bincount(at, minlength=rows)
    return first, pair, np.arange(len(first)) - (np.cumsum(many) - many)[at], many


def distinct_segments(docs: DataFrame, cutter) -> DataFrame:
    """h, seg, n: the distinct segments of all texts, their numbers, and how often they occur."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:  # a batch's own are summed first
            found = [(h, textvec.strings(body, s[first], e[first]), np.bincount(number, minlength=len(h))) for _, _, body, s, e, _, h, first, number in _blocks(b.column("text"), cutter.value)]
            if not found:
                continue
            h, first, number = textvec.unique(np.concatenate([x[0] for x in found]))
            n = np.bincount(number, np.concatenate([x[2] for x in found]), len(h)).astype(np.int64)
            segs = pa.concat_arrays([x[1] for x in found]).take(pa.array(first))
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), segs, pa.array(n)], ["h", "seg", "n"])

    return docs.select("text").mapInArrow(common.freeing(run), "h long, seg string, n long").groupBy("h", "seg").agg(F.sum("n").alias("n"))


def substrings(segs: DataFrame, pieces: Pieces) -> DataFrame:
    """segs: h, i, t, starts. h, i, s, len, piece: from each start its character, and the substrings that can be a piece: of
    the lengths of the pieces that begin with the same HEAD characters. No other substring is one."""
    heads = segs.sparkSession.createDataFrame(pieces.heads(), "head string, lens array<int>")
    heads = F.broadcast(heads.select(F.xxhash64("head").alias("k"), F.col("head").alias("hit"), "lens"))
    x = segs.select("h", "i", "t", F.length("t").alias("size"), F.explode(F.sequence(F.lit(0), F.col("starts") - 1)).alias("s"))
    x = x.withColumn("head", F.col("t").substr(F.col("s") + 1, F.lit(HEAD))).withColumn("k", F.xxhash64("head"))
    x = x.join(heads, (x["k"] == heads["k"]) & (x["head"] == heads["hit"]), "left")
    few = F.array(*(F.lit(k) for k in range(1, HEAD)))
    x = x.select("h", "i", "t", "size", "s", F.explode(F.coalesce("lens", few)).alias("len")).where(F.col("len") <= F.col("size") - F.col("s"))
    return x.select("h", "i", "s", "len", F.col("t").substr(F.col("s") + 1, F.col("len")).alias("piece"))


def lattice(segs: DataFrame, pieces: Pieces) -> DataFrame:
    """segs: h, i, t, starts (edges start before this place). h, i, edges: the edges sorted by end and start, each with
    score and v, its start above and its code below 32 bits. A code is an id, or -1 less the code point of a character
    without a piece."""
    # an eight-byte key probes the table far faster than a string; the strings are compared where it hits
    table = F.broadcast(pieces.table(segs.sparkSession).select(F.xxhash64("piece").alias("k"), F.length("piece").alias("most"), F.col("piece").alias("hit"), "id", "score"))
    x = substrings(segs, pieces).withColumn("k", F.xxhash64("piece"))
    x = x.join(table, (x["k"] == table["k"]) & (x["len"] <= table["most"]) & F.startswith(x["piece"], table["hit"]), "left").where("id is not null or len = 1")
    code = F.coalesce("id", -F.ascii("piece") - 1).cast("long") + F.lit(_LOW)
    edge = F.struct((F.col("s") + F.col("len")).alias("e"), F.shiftleft(F.col("s").cast("long"), 32).bitwiseOR(code).alias("v"), F.coalesce("score", F.lit(pieces.unknown)).alias("score"))
    return x.select("h", "i", edge.alias("edge")).groupBy("h", "i").agg(F.sort_array(F.collect_list("edge")).alias("edges"))


def _fold(edges: Column | str, entry: Column | int, finish) -> Column:
    """Folds edges into the best path to each place, for paths that enter at the place `entry`. The state holds the
    places done with, and the place in work with its best sum and the edge that comes in; finish gets them as an array
    of (e, sum, path)."""
    entry = F.lit(entry).cast("int") if isinstance(entry, int) else entry
    none = F.array().cast("array<bigint>")

    def place(e, total, path):
        return F.struct(e.alias("e"), total.alias("sum"), path.alias("path"))

    def ended(p):
        """The place in work as one that is done with."""
        path = F.when(p["last"] < 0, none).otherwise(F.concat(F.get(p["done"], F.shiftright(p["last"], 32).cast("int"))["path"], F.array(p["last"])))
        return F.concat(p["done"], F.array(place(p["e"], p["sum"], path)))

    def step(p, x):
        s = F.shiftright(x["v"], 32).cast("int")
        total = F.when(s == p["e"], p["sum"]).otherwise(F.get(p["done"], s)["sum"]) + x["score"]
        new = lambda done: F.struct(done.alias("done"), x["e"].alias("e"), total.alias("sum"), x["v"].alias("last"))
        return F.when(x["e"] > p["e"], new(ended(p))).when(total > p["sum"], new(p["done"])).otherwise(p)

    unreached = place(F.lit(0), F.lit(float("-inf")), none)
    kind = "array<struct<e:int,sum:double,path:array<bigint>>>"
    before = F.array_repeat(unreached, entry).cast(kind)
    start = F.struct(before.alias("done"), entry.alias("e"), F.lit(0.0).alias("sum"), F.lit(-1).cast("long").alias("last"))
    return F.aggregate(edges, start, step, lambda p: finish(ended(p)))


def _codes(path: Column) -> Column:
    return F.transform(path, lambda v: (v.bitwiseAND(F.lit(2**32 - 1)) - F.lit(_LOW)).cast("int"))


def paths(segs: DataFrame, pieces: Pieces, tasks: int) -> DataFrame:
    """segs: h, seg, n. h, n, codes: the path of the largest sum."""
    segs = segs.select("h", "n", F.translate("seg", " ", SPACE).alias("t"))
    short = segs.where(F.length("t") <= PART).repartition(tasks, "h")
    edges = lattice(short.select("h", F.col("n").alias("i"), "t", F.length("t").alias("starts")), pieces)
    out = edges.select("h", F.col("i").alias("n"), _fold("edges", 0, lambda p: _codes(F.element_at(p, -1)["path"])).alias("codes"))
    long = segs.where(F.length("t") > PART)
    if not long.limit(1).count():
        return out
    return out.unionByName(_long_paths(long, pieces))


def _long_paths(segs: DataFrame, pieces: Pieces) -> DataFrame:
    """The same for segments of more than PART characters, in parts."""
    most = pieces.longest
    x = segs.withColumn("size", F.length("t")).withColumn("i", F.explode(F.sequence(F.lit(0), F.floor((F.col("size") - 1) / PART).cast("int"))))
    at = F.col("i") * PART
    parts = x.select("h", "i", F.col("t").substr(at + 1, F.lit(PART + most - 1)).alias("t"), F.least(F.lit(PART), F.col("size") - at).alias("starts"), (at + PART >= F.col("size")).alias("final"))
    tops = parts.select("h", "i", "starts", "final")
    parts = common.durable(lattice(parts.repartition("h", "i"), pieces).join(tops, ["h", "i"]), "parts")
    entries = F.when(F.col("i") == 0, F.lit(0)).otherwise(F.least(F.lit(most - 1), F.col("starts")))

    def exits(k):
        """Where paths that enter at k leave: an exit's place is the next part's entry. v shows ties their order."""
        left = lambda p: F.filter(p, lambda y: (y["e"] >= F.col("starts")) & (y["sum"] > float("-inf")))
        return _fold("edges", k, lambda p: F.transform(left(p), lambda y: F.struct((y["e"] - F.col("starts")).alias("j"), F.reverse(y["path"]).alias("back"), k.alias("k"), y["sum"].alias("sum"))))

    every = F.sort_array(F.flatten(F.transform(F.sequence(F.lit(0), entries), exits)))
    # of equal sums the path whose last edges start earlier: the order of the paths read backwards
    ranked = F.transform(every, lambda y, r: F.struct(y["j"].alias("j"), y["k"].alias("k"), y["sum"].alias("sum"), (-r).alias("rank")))
    ways = common.durable(parts.select("h", "i", ranked.alias("ways")), "ways")
    whole = ways.groupBy("h").agg(F.sort_array(F.collect_list(F.struct("i", "ways"))).alias("parts"))
    state = "array<struct<sum:double,entries:array<int>>>"

    def through(v, part):
        def best(j):
            mine = F.filter(part["ways"], lambda y: y["j"] == j)
            top = F.array_max(F.transform(mine, lambda y: F.struct((F.get(v, y["k"])["sum"] + y["sum"]).alias("sum"), y["rank"].alias("rank"), y["k"].alias("k"))))
            entries_of = F.concat(F.get(v, top["k"])["entries"], F.array(top["k"]))
            return F.struct(F.coalesce(top["sum"], F.lit(float("-inf"))).alias("sum"), F.coalesce(entries_of, F.array().cast("array<int>")).alias("entries"))

        return F.transform(F.sequence(F.lit(0), F.lit(most - 1)), best).cast(state)

    start = F.array(F.struct(F.lit(0.0).alias("sum"), F.array().cast("array<int>").alias("entries"))).cast(state)
    chosen = whole.select("h", F.aggregate("parts", start, through, lambda v: F.get(v, F.lit(0))["entries"]).alias("entries"))
    chosen = chosen.select("h", "entries", F.posexplode("entries").alias("i", "k")).select("h", "i", "k", F.coalesce(F.get("entries", F.col("i") + 1), F.lit(0)).alias("j"))
    one = lambda p: _codes(F.get(F.filter(p, lambda y: y["e"] == F.col("starts") + F.col("j")), F.lit(0))["path"])
    got = parts.join(chosen, ["h", "i"]).select("h", "i", _fold("edges", F.col("k"), one).alias("codes"))
    got = got.groupBy("h").agg(F.flatten(F.sort_array(F.collect_list(F.struct("i", "codes")))["codes"]).alias("codes"))
    return got.join(segs.select("h", "n"), "h").select("h", "n", "codes")


def expand(codes: np.ndarray, size: np.ndarray, bytes_from: int) -> tuple[np.ndarray, np.ndarray]:
    """Codes as ids: a character without a piece becomes its bytes. ids, and how many each list has."""
    odd = np.flatnonzero(codes < 0)
    if not len(odd):
        return codes.astype(np.int32), size
    body = [chr(-c - 1).encode() for c in codes[odd].tolist()]
    count = np.ones(len(codes), np.int64)
    count[odd] = [len(x) for x in body]
    out = np.repeat(codes, count)
    at = np.repeat(np.cumsum(count)[odd] - count[odd], count[odd])
    more = count[odd]
    out[at + np.arange(len(at)) - np.repeat(np.cumsum(more) - more, more)] = np.frombuffer(b"".join(body), np.uint8).astype(np.int64) + bytes_from
    total = np.r_[0, np.cumsum(count)][np.r_[0, np.cumsum(size)]]
    return out.astype(np.int32), np.diff(total)


class Known:
    """Ids of segments by number, as sorted arrays. A copy of it lies on the disk of every executor, so it is kept small."""

    def __init__(self, h: np.ndarray, codes: np.ndarray, size: np.ndarray, bytes_from: int):
        ids, size = expand(codes.astype(np.int64), size.astype(np.int64), bytes_from)
        order = np.argsort(h)
        ids = textvec.gather(ids, (np.cumsum(size) - size)[order], size[order])
        small = np.uint16 if ids.max(initial=0) < 1 << 16 else np.int32
        self.__setstate__((h[order], size[order].astype(np.int32), ids.astype(small)))

    def __getstate__(self) -> tuple:
        return self.h, self.size, self.ids

    def __setstate__(self, state: tuple) -> None:
        self.h, self.size, self.ids = state
        self.start = np.cumsum(self.size, dtype=np.int64) - self.size

    def find(self, h: np.ndarray) -> np.ndarray:
        if not len(self.h):
            return np.full(len(h), -1)
        at = np.minimum(np.searchsorted(self.h, h), len(self.h) - 1)
        return np.where(self.h[at] == h, at, -1)


def _known(table: pa.Table, bytes_from: int) -> Known:
    if not table.num_rows:
        return Known(np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), bytes_from)
    lists = table["codes"].combine_chunks()
    return Known(table["h"].to_numpy().view(np.uint64), lists.flatten().to_numpy(zero_copy_only=False), np.array(lists.value_lengths()), bytes_from)


def decode_bytes(ids: np.ndarray, table: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    flat, off = table
    return textvec.gather(flat, off[ids], off[ids + 1] - off[ids])


def decode(docs: DataFrame, pieces: Pieces) -> DataFrame:
    """docs: ids (array<int>) and other columns. Adds text (in place of a column of that name): the pieces' bytes, less
    the dummy prefix; null ids give null. Bytes that are no UTF-8 become U+FFFD."""
    common.prepare(docs.sparkSession)
    docs = docs.drop("text")
    table = pieces.bytes_of()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("ids")
            size = np.array(lists.value_lengths().fill_null(0))
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            off = np.r_[0, np.cumsum(size)]
            valid = lists.is_valid().to_pylist()
            out = []
            for k in range(b.num_rows):
                t = decode_bytes(flat[off[k] : off[k + 1]], table).tobytes().decode("utf-8", "replace")
                out.append((t[1:] if t.startswith(" ") else t) if valid[k] else None)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out, pa.string())], [*b.schema.names, "text"])

    return docs.mapInArrow(run, type(docs.schema)([*docs.schema.fields]).add("text", "string"))


def _commonest(found: DataFrame, most: int) -> DataFrame:
    """Segments that occur more often than all others and are `most` at most, by a histogram of counts."""
    step = F.floor(F.log2("n") * 16)
    total, least = 0, None
    for r in found.where("n > 1").groupBy(step.alias("b")).count().orderBy(F.desc("b")).collect():  # some 1,000 rows at most
        total += r["count"]
        if total > most:
            break
        least = r["b"]
    return found.where((F.col("n") > 1) & (step >= least)) if least is not None else found.where("false")


def encode(docs: DataFrame, pieces: Pieces, frequent: int = FREQUENT) -> DataFrame:
    """docs: text and other columns. All of them but text, with ids, and exact: the ids decode to the text."""
    spark = docs.sparkSession
    common.prepare(spark)
    others = [c for c in docs.columns if c not in ("text", "ids", "exact")]
    docs = docs.select(F.struct(*others).alias("row"), "text")
    cutter = spark.sparkContext.broadcast(pieces.cutter())
    first = pieces.bytes_from
    segs = common.durable(distinct_segments(docs, cutter), "segments")
    tasks = max(1, -(-segs.count() // PER_TASK))
    found = common.durable(paths(segs, pieces, tasks), "paths")
    common.discard(segs)
    common.tidy(spark)
    cast = spark.sparkContext.broadcast(_known(_commonest(found, frequent).select("h", "codes").toArrow(), first))

    def rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each text's other segments, with their numbers in the text."""
        known = cast.value
        for b in batches:
            keys = b.column("key").to_numpy()
            for lo, n, _, _, _, row, h, _, number in _blocks(b.column("text"), cutter.value):
                at = np.flatnonzero((known.find(h) < 0)[number])
                first, _, rank, _ = _numbered(row[at], number[at], len(h), n)
                at = at[first]
                if len(at):
                    yield pa.RecordBatch.from_arrays([pa.array(keys[lo + row[at]]), pa.array(h[number[at]].view(np.int64)), pa.array(rank.astype(np.int32))], ["key", "h", "rank"])

    keyed = docs.withColumn("key", F.xxhash64("text"))
    # copies share a key
    wanted = keyed.select("key", "text").mapInArrow(common.freeing(rare), "key long, h long, rank int").repartition("h").distinct()
    own = wanted.join(found.select("h", "codes"), "h").groupBy("key").agg(F.collect_list(F.struct("rank", "codes")).alias("own"))
    own = own.select("key", F.col("own.rank").alias("ranks"), F.flatten("own.codes").alias("codes"), F.transform("own.codes", F.size).alias("sizes"))
    shared = _dictionary(docs)
    packed = keyed.mapInArrow(common.freeing(_pack(cutter, cast, shared)), keyed.select("row").schema.add("key", "long").add("zip", "binary"))
    joined = packed.join(own, "key", "left").select("row", "zip", "ranks", "codes", "sizes")
    table = pieces.bytes_of()

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = cast.value
        unzip = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(shared))
        for b in batches:
            text = [unzip.decompress(z) if z else b"" for z in b.column("zip").to_pylist()]
            column = pa.array(text, pa.binary()).view(pa.string())
            # a text's own segments, in the order of its numbers
            count = np.array(b.column("ranks").value_lengths().fill_null(0), np.int64)
            flat = {c: b.column(c).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for c in ("ranks", "codes", "sizes")}
            ids, size = expand(flat["codes"], flat["sizes"], first)
            order = np.lexsort((flat["ranks"], np.repeat(np.arange(b.num_rows), count)))
            mine_start, mine_size, mine_from = (np.cumsum(size) - size)[order], size[order], np.r_[0, np.cumsum(count)]
            store = np.concatenate([known.ids, ids]).astype(np.int32)
            lists, sizes, exact = [], [], []
            for lo, n, body, s, e, row, h, _, number in _blocks(column, cutter.value):
                at = known.find(h)[number]
                miss = np.flatnonzero(at < 0)
                _, pair, rank, most = _numbered(row[miss], number[miss], len(h), n)
                if (most > count[lo : lo + n]).any():
                    raise ValueError("a segment has no path")
                other = mine_from[lo + row[miss]] + rank[pair]
                start, length = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
                hit = np.flatnonzero(at >= 0)
                start[hit], length[hit] = known.start[at[hit]], known.size[at[hit]]
                start[miss], length[miss] = mine_start[other] + len(known.ids), mine_size[other]
                ids = textvec.gather(store, start, length)
                per = np.bincount(row, length, n).astype(np.int64)
                back = decode_bytes(ids, table)
                cut = np.r_[0, np.cumsum(per)]
                from_back, from_body = np.r_[0, np.cumsum(table[1][ids + 1] - table[1][ids])][cut], np.r_[0, np.cumsum(np.bincount(row, e - s, n))].astype(np.int64)
                right = np.ones(n, bool)
                if not np.array_equal(back, body):
                    for k in range(n):
                        right[k] = np.array_equal(back[from_back[k] : from_back[k + 1]], body[from_body[k] : from_body[k + 1]])
                        if not right[k] and SPACE.encode() not in text[lo + k] and _valid(text[lo + k]):
                            raise ValueError("two segments share a number")
                lists.append(ids)
                sizes.append(per)
                exact.append(right)
            off = np.r_[0, np.cumsum(np.concatenate([np.zeros(0, np.int64), *sizes]))].astype(np.int32)
            out = pa.ListArray.from_arrays(pa.array(off), pa.array(np.concatenate([np.zeros(0, np.int32), *lists])))
            yield pa.RecordBatch.from_arrays([b.column("row"), out, pa.array(np.concatenate([np.zeros(0, bool), *exact]))], ["row", "ids", "exact"])

    done = joined.mapInArrow(common.freeing(assemble), keyed.select("row").schema.add("ids", T.ArrayType(T.IntegerType())).add("exact", "boolean"))
    return done.select("row.*", "ids", "exact")


def _valid(text: bytes) -> bool:
    try:
        text.decode()
    except UnicodeDecodeError:
        return False
    return True


def _dictionary(docs: DataFrame) -> bytes:
    """What texts are compressed with: strings that are common in beginnings of a thousand texts. It changes no result."""
    some = docs.select(F.substring("text", 1, 4096).alias("t")).where("length(t) > 0").take(1000)
    try:
        return zstandard.train_dictionary(1 << 16, [r["t"].encode() for r in some]).as_bytes()
    except zstandard.ZstdError:  # too few for one
        return b""


def _pack(cutter, cast, shared: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Texts travel compressed. A text without segments of its own gets a key that nothing joins, so copies of one
        text spread."""
        zipper = zstandard.ZstdCompressor(level=6, dict_data=zstandard.ZstdCompressionDict(shared))
        known, seen = cast.value, 0
        for b in batches:
            data, off = textvec.raw(b.column("text"))
            whole = data.tobytes()
            z = [zipper.compress(whole[i:j]) if j > i else None for i, j in zip(off[:-1].tolist(), off[1:].tolist())]
            key = b.column("key").to_numpy().copy()
            for lo, n, _, _, _, row, h, _, number in _blocks(b.column("text"), cutter.value):
                plain = np.bincount(row, (known.find(h) < 0)[number], n) == 0
                at = np.flatnonzero(plain) + lo
                key[at] = textvec.mix(key[at].view(np.uint64) + (np.arange(len(at)) + seen).astype(np.uint64)).view(np.int64)
                seen += n
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(key), pa.array(z, pa.binary())], ["row", "key", "zip"])

    return run


def op8_pieces(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    out = encode(docs, load(spark))
    return out.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), "exact", "ids")
