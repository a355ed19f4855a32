"""Toxicity: noisy-channel deobfuscation, then a score of the restored text.

A word that holds digits or symbols among its letters, letters repeated three times or more, or letters spaced out one
by one is read as a lattice: each character stands for itself, for a letter that it resembles, or (separators and
repeats) for nothing, at the channel's cost. Letters beyond a to z stay as they are, and digits and separators where
that is likelier: 3rd, well-known and l'état are read as written. Viterbi picks the letters that are likeliest under a character trigram
model counted over every text of the table. Words that need no restoring are a lattice of one path and stay.
The restored text is scored by logistic regression on the presence of hashed words and word beginnings.

Defined cases: null and empty texts have no features and get the score of the bias; rows with null labels are not
learned from; repeated rows get equal scores; other columns are ignored; no labels give the score 0.5 everywhere."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm import common, textvec
from strandline.llm.ftrl import Ftrl, sigmoid, sparse_rows

MAX_TRAIN = 16000
THRESHOLD = 0.3
BITS = 20
#: Letters that a character may stand for.
LOOKS = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "£": "l"}
SEPARATORS = " .-_*~'"
LOOK_COST, REPEAT_COST, SEPARATOR_COST, INNER_COST, GAP_COST, OWN_COST = 0.7, 0.4, 0.3, 3.0, 1.0, 1.0
#: Words longer than this are no words of a language; they are restored in parts of this length.
LONGEST = 64

#: A through Z in lower case are 1 to 26, all else 0.
_LETTER = np.zeros(256, np.int64)
for _i in range(26):
    _LETTER[[ord("a") + _i, ord("A") + _i]] = _i + 1
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
#: What parts words once a text is restored: all ASCII but letters.
_GAP = np.ones(256, bool)
_GAP[0x80:] = False
_GAP[[*range(ord("a"), ord("z") + 1), *range(ord("A"), ord("Z") + 1)]] = False

def trigrams(docs: DataFrame) -> DataFrame:
    """code, n: counts of letter trigrams of all texts, 0 standing for whatever is no letter. 27^3 codes at most."""
    common.prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(27**3, np.int64)
        for b in batches:
            data, off = textvec.raw(b.column(0))
            for d, o, _ in textvec.pieces(data, off, 0):
                c = _LETTER[d].astype(np.int64)
                one, two = np.zeros((2, len(c) + 1), np.int64)
                one[1:], two[2:] = c, c[:-1]
                first = o[:-1][np.diff(o) > 0]
                one[first] = two[first] = 0  # a text knows nothing of the text before it
                two[first + 1] = 0
                total += np.bincount(two[:-1] * 729 + one[:-1] * 27 + c, minlength=27**3)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["code", "n"])

    return docs.select("text").mapInArrow(run, "code int, n long").groupBy("code").agg(F.sum("n").alias("n"))


def language(counts: DataFrame) -> np.ndarray:
    """Costs, -ln p(c | a b), of a 27 x 27 x 27 table; trigrams interpolated with bigrams and letters."""
    n = np.zeros((27, 27, 27))
    for code, k in counts.collect():  # 19,683 rows at most
        n[code // 729, code // 27 % 27, code % 27] = k
    one = (n.sum((0, 1)) + 1) / (n.sum() + 27)
    two = (n.sum(0) + 50 * one) / (n.sum((0, 2))[:, None] + 50)
    three = (n + 50 * two[None]) / (n.sum(2, keepdims=True) + 50)
    return -np.log(three)


class Decoder:
    """Viterbi over the lattice of a word; the state is the last two letters that were put out."""

    def __init__(self, cost: np.ndarray):
        self.cost, self.known = cost.tolist(), {}

    def restore(self, word: str) -> str:
        found = self.known.get(word)
        if found is None:
            found = "".join(self._viterbi(word[i : i + LONGEST]) for i in range(0, len(word), LONGEST))
            if len(self.known) > 200_000:
                self.known.clear()
            self.known[word] = found
        return found

    @staticmethod
    def options(word: str, k: int) -> list[tuple[int, float, str]]:
        """What the character at k may stand for: the model's symbol (0: no letter of it, -1: nothing), cost, output."""
        ch = word[k]
        code = ord(ch) - 96
        again = [(-1, REPEAT_COST, "")] if k and word[k - 1] == ch else []
        if 1 <= code <= 26:
            return [(code, 0.0, ch), *again]
        looks = [(ord(x) - 96, LOOK_COST, x) for x in LOOKS.get(ch, "")]
        if ch in SEPARATORS:  # it parts words, or letters of one
            alone = ch != "'" and (k < 2 or word[k - 2] in SEPARATORS or k + 2 >= len(word) or word[k + 2] in SEPARATORS)  # beside a single letter
            return [*looks, *again, (-1, SEPARATOR_COST if alone else INNER_COST, ""), (0, GAP_COST, ch)]
        return [*looks, *again, (0, OWN_COST if looks else 0.0, ch)]  # other letters and signs stay

    def step(self, a: int, b: int, c: int) -> float:
        """The model's cost of c after a and b; what is no letter costs nothing more after its like."""
        return 0.0 if b == c == 0 else self.cost[a][b][c]

    def _viterbi(self, word: str) -> str:
        states: dict[tuple[int, int], tuple[float, str]] = {(0, 0): (0.0, "")}
        for k in range(len(word)):
            options = self.options(word, k)
            new: dict[tuple[int, int], tuple[float, str]] = {}
            for (a, b), (total, out) in states.items():
                for c, channel, said in options:
                    if c < 0:
                        key, value = (a, b), (total + channel, out)
                    else:
                        key, value = (b, c), (total + channel + self.step(a, b, c), out + said)
                    if key not in new or value < new[key]:
                        new[key] = value
            states = new
        return min((total + self.step(a, b, 0), out) for (a, b), (total, out) in states.items())[1]


def suspects(data: np.ndarray, off: np.ndarray) -> list[tuple[int, int, int]]:
    """Start, end and row of the spans of a block that may be obfuscated."""
    starts, ends, row = textvec.words(data, off)
    if not len(starts):
        return []
    letter = (_LETTER[data] > 0) | (data >= 0x80)
    cls = _ODD[data]
    inner = np.zeros(len(data), bool)  # a look-alike or separator with a letter on its right
    inner[:-1] = cls[:-1] & letter[1:]
    plain = np.zeros(len(data), bool)  # digits and the like that follow a letter
    plain[1:] = _LOOK[data[1:]] & letter[:-1] & ~_TAIL[data[1:]]
    low = _LOWER[data]
    three = np.zeros(len(data), bool)
    three[2:] = (low[2:] == low[1:-1]) & (low[2:] == low[:-2]) & (_LETTER[data[2:]] > 0)
    flag = np.add.reduceat((inner | plain | three).astype(np.int32), starts)
    some = np.add.reduceat(letter.astype(np.int32), starts)
    flag, some = flag.astype(bool), some.astype(int)
    out = [(int(starts[k]), int(ends[k]), int(row[k])) for k in np.flatnonzero(flag & (some > 0))]
    # letters spaced out: three or more words of one character in a row
    single = (ends - starts == 1) & (letter[starts] | _LOOK[data[starts]])
    if len(single) > 2:
        edge = np.flatnonzero(np.diff(np.r_[False, single, False].astype(np.int8)))
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
            lo = a
            while lo < b:
                hi = lo
                while hi < b and row[hi] == row[lo]:
                    hi += 1
                if hi - lo >= 3:
                    out.append((int(starts[lo]), int(ends[hi - 1]), int(row[lo])))
                lo = hi
    return sorted(out)


_LOOK = np.zeros(256, bool)
_LOOK[[ord(x) for x in LOOKS if ord(x) < 128]] = True
_ODD = _LOOK.copy()
_ODD[[ord(x) for x in SEPARATORS if x != " "]] = True
#: Symbols that end a word without standing for a letter.
_TAIL = np.zeros(256, bool)
_TAIL[[ord(x) for x in "!$+|@"]] = True


def restored(data: np.ndarray, off: np.ndarray, decoder: Decoder) -> tuple[np.ndarray, np.ndarray]:
    """The block with suspected spans restored."""
    found = suspects(data, off)
    if not found:
        return data, off
    body, out, at, grown, shift = data.tobytes(), [], 0, np.zeros(len(off) - 1, np.int64), 0
    for s, e, r in found:
        if s < at:
            continue
        word = body[s:e].decode("utf-8", "replace").lower().rstrip(".,;:!?*%&#$\"')]}").lstrip("\"'([{*%&#.,;:")
        new = decoder.restore(word).encode()
        out += [body[at:s], new]
        grown[r] += len(new) - (e - s)
        at = e
    out.append(body[at:])
    return np.frombuffer(b"".join(out), np.uint8), off + np.r_[0, np.cumsum(grown)]


def features(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers and rows: words of letters, and their first four, five and six bytes."""
    low = _LOWER[data]
    s, e, row = textvec.words(low, off, _GAP)
    hs, rs = [textvec.span_hash(low, s, e)], [row]
    for n in (4, 5, 6):
        far = e - s > n
        hs.append(textvec.span_hash(low, s[far], s[far] + n) ^ np.uint64(n))
        rs.append(row[far])
    return (np.concatenate(hs) >> np.uint64(64 - BITS)).astype(np.int64), np.concatenate(rs)


def _vectors(cost: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(cost)
        for b in batches:
            data, off = textvec.raw(b.column("text"))
            out: list[set] = [set() for _ in range(b.num_rows)]
            for d, o, rows in textvec.pieces(data, off, 0):
                idx, r = features(*restored(d, o, decoder))
                code = np.unique(r << BITS | idx)
                for k in range(len(o) - 1):
                    lo, hi = np.searchsorted(code, [k << BITS, (k + 1) << BITS])
                    out[rows[k]].update((code[lo:hi] & ((1 << BITS) - 1)).tolist())
            yield pa.RecordBatch.from_arrays([b.column("label"), pa.array([sorted(x) for x in out], pa.list_(pa.int32()))], ["label", "idx"])

    return run


def learn(docs: DataFrame, labels: DataFrame, cost: np.ndarray, max_train: int = MAX_TRAIN) -> tuple[np.ndarray, float]:
    """labels: doc_id, label (0 or 1). Learns from max_train labelled documents at most, by a seeded hash of the id."""
    common.prepare(docs.sparkSession)
    chosen = common.bounded_rows(labels.where("doc_id is not null and label in (0, 1)").groupBy("doc_id").agg(F.max("label").cast("int").alias("label")), "doc_id", max_train)
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "label")  # max_train rows of 12 bytes
    rows = sample.mapInArrow(_vectors(cost), "label int, idx array<int>").toArrow()
    return Ftrl(bits=BITS, alpha=0.3, l1=1.0, l2=0.1, epochs=4).fit(sparse_rows(rows, 0.5))


def score(docs: DataFrame, cost: np.ndarray, weights: np.ndarray, bias: float) -> DataFrame:
    """docs, without text, with a column score. docs has a column text and none named score."""
    spark = docs.sparkSession
    common.prepare(spark)
    live = np.flatnonzero(weights)
    model = spark.sparkContext.broadcast((live.astype(np.int32), weights[live], cost))  # 8 MB at most at 20 bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, values, c = model.value
        w = np.zeros(1 << BITS, np.float32)
        w[at] = values
        decoder = Decoder(c)
        for b in batches:
            data, off = textvec.raw(b.column("text"))
            hits = [np.zeros(0, np.int64)]
            for d, o, rows in textvec.pieces(data, off, 0):
                idx, r = features(*restored(d, o, decoder))
                on = w[idx] != 0
                hits.append(rows[r[on]] << BITS | idx[on])
            code = np.unique(np.concatenate(hits))
            s = np.bincount(code >> BITS, w[code & ((1 << BITS) - 1)] * 0.5, b.num_rows)[: b.num_rows]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(b.num_columns) if b.schema.names[i] != "text"), pa.array(sigmoid(s + bias))], [*(x for x in b.schema.names if x != "text"), "score"])

    out = type(docs.schema)([f for f in docs.schema.fields if f.name != "text"]).add("score", "double")
    return docs.mapInArrow(run, out)


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = common.table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label"))
    cost = language(trigrams(docs))
    w, bias = learn(docs, labels.where(common.crc_mod(F.col("doc_id"), 4) != 2), cost)
    out = score(docs, cost, w, bias)
    return out.select("doc_id", F.coalesce(common.crc_mod(F.col("doc_id"), 4) == 2, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
