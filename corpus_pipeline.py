"""The corpus pipeline: language ID, exact dedup, near dedup, mixing, encoding.

Each stage takes the documents that its predecessor kept and returns rows with the columns of documents; the last one
returns encoded documents. A stage's output is written as Parquet and read again. Stages name columns of their own only
beside a packed row, so extra columns of any name pass through.

Defined cases: documents that language ID rejects (null texts, texts without letters, texts that no model explains) go;
of equal texts, and of a group of near duplicates, the row of the smallest doc_id stays, once if rows repeat; documents
without words stay where only duplicates go, and are no part of a mix, which takes words; an empty table stays empty."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandline.llm import common, exact, langid, minhash, mixing, pieces

#: SQL has no language models, sketches or lattices.
ORACLE_SQL = None
#: Dropped rows up to this many (20 bytes each) are broadcast; more are joined by shuffle.
BROADCAST_ROWS = 1_000_000


def _without(docs: DataFrame, dropped: DataFrame) -> DataFrame:
    """docs without the rows that dropped lists by id and hash of the text; of rows that repeat both, one."""
    few = lambda x: F.broadcast(x) if x.count() <= BROADCAST_ROWS else x
    rows = docs.select(F.struct(*docs.columns).alias("row"), F.xxhash64("text").alias("key"))
    same = lambda y: F.col("row.doc_id").eqNullSafe(y["_id"]) & (F.col("key") == y["_key"])
    gone = few(common.durable(dropped.select(F.col("doc_id").alias("_id"), F.col("tkey").alias("_key")).distinct(), "dropped"))
    left = rows.join(gone, same(gone), "left_anti")
    again = left.groupBy(F.col("row.doc_id").alias("_id"), F.col("key").alias("_key")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    again = common.durable(again.select("_id", "_key"), "repeated")
    if again.limit(1).count():  # only the texts of rows that repeat are moved
        again = few(again)
        once = left.join(again, same(again), "left_semi").withColumns({"id": F.col("row.doc_id"), "text": F.col("row.text")}).dropDuplicates(["id", "text"])
        left = left.join(again, same(again), "left_anti").unionByName(once.select("row", "key"))
    return left.select("row.*")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what no language model explains."""
    model = langid.learn(docs.select("doc_id", "text", "lang"))
    others = [c for c in docs.columns if c != "text"]
    out = langid.predict(docs.select("text", F.struct(*others).alias("row")), model, keep_text=True)
    return out.where("not rejected").select(*(F.col("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts keeps the one of the smallest id."""
    found = exact.classes(docs.select("doc_id", "text"))
    return _without(docs, found.where(~F.col("doc_id").eqNullSafe(F.col("keep_id"))))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by 0.8 or more of their shingles of five words, keeps the one of the smallest id."""
    found = minhash.near_duplicates(docs.select("doc_id", "text"), 5, 80)
    return _without(docs, found.where(~F.col("doc_id").eqNullSafe(F.col("component_id"))))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each document as often as the mix has it."""
    rows = mixing.sized(docs.select("doc_id", "text", "source", F.struct(*docs.columns).alias("row")))
    taken = mixing.take(rows).where("copies > 0 and size > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).select("row.*")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_pieces, ids, exact (they decode to the text)."""
    out = pieces.encode(docs.select("doc_id", "text"), pieces.load(spark))
    return out.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), "ids", "exact")


STAGES = [
    ("language_id", language),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("mixing", mix),
    ("sentencepiece", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each stage's output cut off as Parquet in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = f"{common.shared_dir(spark)}/strandline/pipeline-{name}-{uuid.uuid4().hex}"
        before = len(common.written(spark))
        stage(spark, docs, sf_dir).write.parquet(path)
        common.sweep(spark, before)  # the stage's own tables; its result is written
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
