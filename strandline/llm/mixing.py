"""Mixing sources to target weights by Pareto order sampling.

A source's target is its share, by weight, of all words, held to CAP times its own size; what a held source leaves is
shared out again by weight. With r = target / size, every document of the source is taken floor(r) times for certain,
and the rest of r is the inclusion probability p of one copy more. Documents are ranked by random odds over inclusion
odds, (u / (1 - u)) / (p / (1 - p)), and taken in that order up to the words that are still wanted; the document at the
border is taken if that brings the sum nearer. u is a hash of the id, so reruns agree.

A source of any size is ranked in parallel: sizes are summed over BUCKETS ranges of u (partial sums per task), running
sums find the one range that the border falls into, and only that range's documents are put in order.

Defined cases: null and empty texts have size 0 and are taken 0 words; null sources form one source, the last; a null
id ranks by the hash of the empty string; repeated rows are documents of their own; an empty table gives an empty
result; a source without words has the target 0; other columns are ignored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.llm import common

WORD = r"[^\x20\x09-\x0D]+"
CAP = 3
BUCKETS = 4096
#: A table of sources up to this many rows (some 100 bytes each) is broadcast; a larger one is joined by shuffle.
BROADCAST_SOURCES = 20_000


def random_share(doc_id: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of the id's MD5."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit(""))), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def targets(sources: DataFrame, cap: float = CAP) -> DataFrame:
    """sources: source, source_size, one row each. Adds target. Weights run 1, 2, 3 by code point, null last."""
    everything = Window.orderBy(F.asc_nulls_last("source"))  # a row per source, not per document
    s = sources.withColumn("weight", ((F.row_number().over(everything) - 1) % 3 + 1).cast("double")).withColumn("total", F.sum("source_size").over(Window.partitionBy()))
    s = s.withColumn("limit", F.lit(float(cap)) * F.col("source_size"))
    by_room = Window.orderBy(F.col("limit") / F.col("weight"), F.asc_nulls_last("source"))
    # in order of room a unit of weight, the held sources come first
    s = s.withColumn("used", F.coalesce(F.sum("limit").over(by_room.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    s = s.withColumn("left_weight", F.sum("weight").over(by_room.rowsBetween(0, Window.unboundedFollowing)))
    s = s.withColumn("share", (F.col("total") - F.col("used")) / F.col("left_weight"))
    free = F.min(F.when(F.col("share") * F.col("weight") <= F.col("limit"), F.struct("used", "share"))).over(Window.partitionBy())
    s = s.withColumn("free", free)
    held = F.col("free").isNull() | (F.col("used") < F.col("free.used")) | (F.col("free.share") * F.col("weight") > F.col("limit"))
    return s.select("source", "source_size", F.when(held, F.col("limit")).otherwise(F.col("free.share") * F.col("weight")).alias("target"))


def sized(docs: DataFrame) -> DataFrame:
    """docs: doc_id, text and any others, with size and u in place of text."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    return docs.withColumns({"size": size, "u": random_share(F.col("doc_id"))}).drop("text")


def plan(docs: DataFrame) -> DataFrame:
    """docs: doc_id, text, source. One row a document: doc_id, source, size, source_size, target, copies (long)."""
    return take(common.durable(sized(docs.select("doc_id", "text", "source")), "mix"))


def take(sized: DataFrame) -> DataFrame:
    """sized: doc_id, source, size, u and any other columns, which stay."""
    bucket = F.floor(F.col("u") * BUCKETS).cast("int")
    sums = sized.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("words"))
    goals = targets(sums.groupBy("source").agg(F.sum("words").alias("source_size")))
    goals = goals.withColumn("whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
    goals = goals.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    key = lambda c: F.coalesce(F.concat(F.lit("s"), c), F.lit("n"))
    b, g = sums.withColumn("k", key(F.col("source"))).drop("source"), goals.withColumn("k", key(F.col("source"))).drop("source")
    run = Window.partitionBy("k").orderBy("bucket")  # BUCKETS rows a source
    b = b.withColumn("upto", F.sum("words").over(run)).withColumn("before", F.col("upto") - F.col("words"))
    edge = b.join(g.select("k", "rest"), "k").where((F.col("before") < F.col("rest")) & (F.col("upto") > F.col("rest"))).groupBy("k").agg(F.min_by(F.struct("bucket", "before"), "bucket").alias("edge"))
    # without an edge all ranges end at or below the rest, or the rest is nothing
    last = b.join(g.select("k", "rest"), "k").where(F.col("upto") <= F.col("rest")).groupBy("k").agg(F.max("bucket").alias("last"))
    g = common.durable(g.join(edge, "k", "left").join(last, "k", "left"), "goals")
    if g.count() <= BROADCAST_SOURCES:
        g = F.broadcast(g)
    d = sized.withColumn("k", key(F.col("source"))).withColumn("bucket", bucket).join(g, "k")
    on_edge = F.coalesce(F.col("bucket") == F.col("edge.bucket"), F.lit(False))
    order = Window.partitionBy("k").orderBy("odds", "doc_id", "size")
    p = F.col("rest") / F.col("source_size")
    close = d.where(on_edge).withColumn("odds", F.when(F.col("u") < 1, F.try_divide(F.col("u") / (1 - F.col("u")), p / (1 - p))))
    close = close.withColumn("upto", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) + F.col("edge.before"))
    close = close.withColumn("extra", (F.col("upto") - F.col("size") / 2 <= F.col("rest")).cast("long")).drop("odds", "upto")
    clear = d.where(~on_edge).withColumn("extra", (F.col("bucket") <= F.coalesce(F.col("last"), F.lit(-1))).cast("long"))
    copies = F.when(F.col("size") > 0, F.least(F.col("whole") + F.col("extra"), F.lit(CAP))).otherwise(F.lit(0)).cast("long")
    out = clear.unionByName(close).withColumn("copies", copies)
    return out.drop("k", "bucket", "whole", "rest", "edge", "last", "extra", "u")


def op7_mixing(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return plan(docs).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::DOUBLE AS weight,
  3.0::DOUBLE * source_size AS lim, (sum(source_size) OVER ())::DOUBLE AS total FROM s),
x AS (SELECT *, coalesce(sum(lim) OVER (ORDER BY lim / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used,
  sum(weight) OVER (ORDER BY lim / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS left_weight FROM w),
y AS (SELECT *, (total - used) / left_weight AS share FROM x),
z AS (SELECT *, first_value(CASE WHEN share * weight <= lim THEN used END IGNORE NULLS) OVER (ORDER BY used ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS fu,
  first_value(CASE WHEN share * weight <= lim THEN share END IGNORE NULLS) OVER (ORDER BY used ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS fs FROM y),
t AS (SELECT source, source_size, CASE WHEN fu IS NULL OR used < fu OR fs * weight > lim THEN lim ELSE fs * weight END AS target FROM z),
j AS (SELECT d.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN floor(t.target / t.source_size)::BIGINT ELSE 0 END AS whole
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
r AS (SELECT *, target - whole * source_size AS rest, sum(size) OVER (PARTITION BY source ORDER BY u, doc_id, size ROWS UNBOUNDED PRECEDING) AS upto FROM j)
SELECT doc_id, size, source_size, target,
  (least(whole + CASE WHEN size > 0 AND upto - size / 2.0::DOUBLE <= rest THEN 1 ELSE 0 END, 3) * size)::BIGINT AS taken FROM r
"""
