"""Quality classifier: hashed word n-gram logistic regression, learned by follow-the-regularised-leader updates and
applied as a sparse dot product.

Features are hashed runs of one to three words, each word taken as it stands and as its shape (`Wor-d,` -> `Aa-a,`,
with a mark if it repeats the word before). A value is the run's share of the text's runs of its kind, so a text's
length doesn't matter and a score is one gather and one sum over its words.

Defined cases: a null or empty text has no features and gets the score of the bias; repeated rows get equal scores;
null labels are not learned from; other columns are ignored; no labels at all give the score 0.5 everywhere."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandline.llm import common, textvec
from strandline.llm.ftrl import Ftrl, sigmoid, sparse_rows

#: At most so many labelled rows are learned from.
MAX_TRAIN = 8000
THRESHOLD = 0.3
BITS = 18
#: (length of the run, kind) of each feature group, with its scale.
GROUPS = ((1, "shape", 6.0), (2, "shape", 6.0), (3, "shape", 4.0), (1, "word", 3.0), (2, "word", 1.5))


def _shape_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    t[ord("a") : ord("z") + 1] = ord("a")
    t[ord("A") : ord("Z") + 1] = ord("A")
    t[ord("0") : ord("9") + 1] = ord("0")
    t[0x80:] = ord("a")
    return t


_SHAPE = _shape_table()


def shape_bytes(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each byte's class, runs of one class inside a word written once."""
    c = _SHAPE[data]
    upper = np.zeros(len(data), bool)  # U+00C0 to U+00DE in UTF-8
    upper[:-1] = (data[:-1] == 0xC3) & (data[1:] < 0x9F)
    c[upper] = ord("A")
    c[1:][upper[:-1]] = ord("A")
    keep = np.ones(len(c), bool)
    keep[1:] = (c[1:] != c[:-1]) | textvec.SPACE[data[1:]]
    keep[off[:-1][off[:-1] < len(c)]] = True
    total = np.r_[0, np.cumsum(keep)]
    return c[keep], total[off]


def features(data: np.ndarray, off: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """Feature numbers, rows and scale of each group."""
    starts, ends, row = textvec.words(data, off)
    word = textvec.span_hash(data, starts, ends)
    sd, so = shape_bytes(data, off)
    ss, se, _ = textvec.words(sd, so)
    shape = textvec.span_hash(sd, ss, se)
    if len(word):
        again = np.zeros(len(word), bool)
        again[1:] = (word[1:] == word[:-1]) & (row[1:] == row[:-1])
        shape = shape ^ (again.astype(np.uint64) * np.uint64(0x5BD1E995))
    for k, (n, kind, scale) in enumerate(GROUPS):
        h, r = textvec.follow(word if kind == "word" else shape, row, n, k + 1)
        yield (h >> np.uint64(64 - BITS)).astype(np.int64), r, scale


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sparse vectors of the rows that are learned from."""
    for b in batches:
        data, off = textvec.raw(b.column("text"))
        out: list[dict] = [{} for _ in range(b.num_rows)]
        sums: list[dict] = [{} for _ in range(b.num_rows)]
        for d, o, rows in textvec.pieces(data, off, 2):
            for g, (idx, r, scale) in enumerate(features(d, o)):
                code, count = np.unique(r << BITS | idx, return_counts=True)
                for k in range(len(o) - 1):
                    lo, hi = np.searchsorted(code, [k << BITS, (k + 1) << BITS])
                    if hi > lo:
                        part = sums[rows[k]].setdefault(g, {})
                        for i, c in zip((code[lo:hi] & ((1 << BITS) - 1)).tolist(), count[lo:hi].tolist()):
                            part[i] = part.get(i, 0) + c
        for k, groups in enumerate(sums):
            for g, part in groups.items():
                scale = GROUPS[g][2] / sum(part.values())
                for i, c in part.items():
                    out[k][i] = out[k].get(i, 0.0) + c * scale
        yield pa.RecordBatch.from_arrays(
            [b.column("label"), pa.array([sorted(x) for x in out], pa.list_(pa.int32())), pa.array([[x[i] for i in sorted(x)] for x in out], pa.list_(pa.float32()))], ["label", "idx", "val"]
        )


def learn(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> tuple[np.ndarray, float]:
    """docs: doc_id, text; labels: doc_id, label (0 or 1), of at most max_train documents by a seeded hash of the id."""
    spark = docs.sparkSession
    common.prepare(spark)
    chosen = common.bounded_rows(labels.where("doc_id is not null and label in (0, 1)").groupBy("doc_id").agg(F.max("label").cast("int").alias("label")), "doc_id", max_train)
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "label")  # max_train rows of 12 bytes
    rows = sample.mapInArrow(_vectors, "label int, idx array<int>, val array<float>").toArrow()
    return Ftrl(bits=BITS).fit(sparse_rows(rows))


def score(docs: DataFrame, weights: np.ndarray, bias: float) -> DataFrame:
    """docs with a column score; its other columns stay as they are. docs has a column text and none named score."""
    spark = docs.sparkSession
    common.prepare(spark)
    model = spark.sparkContext.broadcast(weights)  # 1 MB at 18 bits

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = model.value
        for b in batches:
            data, off = textvec.raw(b.column("text"))
            n = b.num_rows
            top, base = np.zeros((len(GROUPS), n)), np.zeros((len(GROUPS), n))
            for d, o, rows in textvec.pieces(data, off, 2):
                m = len(o) - 1
                for g, (idx, r, scale) in enumerate(features(d, o)):
                    np.add.at(top[g], rows, np.bincount(r, w[idx], m) * scale)
                    np.add.at(base[g], rows, np.bincount(r, minlength=m))
            s = sigmoid((top / np.maximum(base, 1)).sum(0) + bias)
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(b.num_columns) if b.schema.names[i] != "text"), pa.array(s)], [*(x for x in b.schema.names if x != "text"), "score"])

    kept = [f for f in docs.schema.fields if f.name != "text"]
    out = type(docs.schema)([*kept]).add("score", "double")
    return docs.mapInArrow(run, out)


def op1_quality(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = common.table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    w, bias = learn(docs, labels.where(common.crc_mod(F.col("doc_id"), 5) != 0))
    out = score(docs, w, bias)
    return out.select("doc_id", F.coalesce(common.crc_mod(F.col("doc_id"), 5) == 0, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
