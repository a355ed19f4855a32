"""Retrieval, classification and text metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions import text
from strandline.operators.dataset import seeded


def hit_at(found: DataFrame, query_id: str, hit: Column, order: list[str], ks: tuple) -> DataFrame:
    """One row: n, hit_k for each k: the share of queries with a hit among their first k rows."""
    w = Window.partitionBy(query_id).orderBy(*[F.expr(o) if " " not in o else F.desc(o.split()[0]) for o in order])
    first = found.withColumn("_k", F.row_number().over(w)).groupBy(query_id).agg(F.min(F.when(hit, F.col("_k"))).alias("_first"))
    share = lambda k: F.round(F.avg(F.coalesce(F.col("_first") <= k, F.lit(False)).cast("int")), 6).alias(f"hit_{k}")
    return first.agg(F.count(F.lit(1)).alias("n"), *[share(k) for k in ks])


def confusion(df: DataFrame, true: str, pred: str) -> DataFrame:
    return df.groupBy(true, pred).agg(F.count(F.lit(1)).alias("n"))


def per_class(df: DataFrame, true: str, pred: str) -> DataFrame:
    """cls, tp, fp, fn, precision, recall, f1; 0 where a denominator is 0."""
    c = confusion(df, true, pred)
    sides = c.select(F.col(true).alias("cls"), F.when(F.col(true) == F.col(pred), F.col("n")).otherwise(0).alias("tp"), F.lit(0).alias("fp"), F.when(F.col(true) != F.col(pred), F.col("n")).otherwise(0).alias("fn"))
    other = c.where(F.col(true) != F.col(pred)).select(F.col(pred).alias("cls"), F.lit(0).alias("tp"), F.col("n").alias("fp"), F.lit(0).alias("fn"))
    s = sides.unionByName(other).groupBy("cls").agg(*[F.sum(x).cast("long").alias(x) for x in ("tp", "fp", "fn")])
    zero = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    s = s.withColumn("precision", zero(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", zero(F.col("tp"), F.col("tp") + F.col("fn")))
    return s.withColumn("f1", zero(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")))


def summary(df: DataFrame, true: str, pred: str) -> DataFrame:
    """One row: n, accuracy, macro_f1."""
    macro = per_class(df, true, pred).agg(F.round(F.avg("f1"), 6).alias("macro_f1"))
    acc = df.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg((F.col(true) == F.col(pred)).cast("int")), 6).alias("accuracy"))
    return acc.join(F.broadcast(macro))  # one row each


def token_f1(pred: Column, gold: Column) -> Column:
    """Overlap F1 of the tokens of two answers (Rajpurkar et al., 2016), counting repeats."""
    norm = lambda c: F.filter(F.split(F.regexp_replace(F.lower(c), r"(?U)[^\p{L}\p{N}\s]", " "), r"(?U)\s+"), lambda x: x != "")
    p, g = norm(pred), norm(gold)
    number = lambda a: F.transform(a, lambda x, i: F.concat_ws("#", x, F.size(F.filter(F.slice(a, 1, i + 1), lambda y: y == x)).cast("string")))
    same = F.size(F.array_intersect(number(p), number(g)))
    return F.when((F.size(p) == 0) | (F.size(g) == 0), (F.size(p) == F.size(g)).cast("double")).otherwise(F.coalesce(F.try_divide(2.0 * same, F.size(p) + F.size(g)), F.lit(0.0)))


def exact_match(pred: Column, gold: Column) -> Column:
    norm = lambda c: F.lower(text.collapse(F.regexp_replace(c, r"(?U)[^\p{L}\p{N}\s]", " ")))
    return (norm(pred) == norm(gold)).cast("int")


def by_group(df: DataFrame, group: str, metric: str) -> DataFrame:
    """group, n, mean: of each group, and of all rows where group is null."""
    return df.rollup(group).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(metric), 6).alias("mean"), F.grouping(group).alias("total"))


def leakage(pairs: DataFrame, similarity: str, split_a: str, split_b: str, least: float = 0.7) -> DataFrame:
    """One row: high (pairs of `least` or more), crossing (of them, pairs over two splits), rate."""
    high = F.col(similarity) >= least
    cross = high & (F.col(split_a) != F.col(split_b))
    x = pairs.agg(F.count_if(high).alias("high"), F.count_if(cross).alias("crossing"))
    return x.withColumn("rate", F.round(F.coalesce(F.try_divide(F.col("crossing"), F.col("high")), F.lit(0.0)), 6))


def similar_pairs(df: DataFrame, key: str, tokens: str, least: float) -> DataFrame:
    """a, b, jaccard of all pairs (a < b) of rows whose sets of tokens are at least so similar, least above 0.

    Tokens stand in order of rarity; of a set of n only the first n - ceil(least * n) + 1 are joined, as two sets that are so similar
    share one of these, and only sets of fitting sizes meet. Common tokens come last, so they pair nothing but what can hold."""
    x = df.select(F.col(key).alias("id"), F.array_distinct(tokens).alias("ts")).where(F.size("ts") > 0)
    seen = x.select(F.explode("ts").alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("df"))
    ranked = x.select("id", F.explode("ts").alias("t")).join(seen, "t").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("df", "t"))).alias("r"))
    ranked = ranked.withColumn("n", F.size("r")).withColumn("ts", F.transform("r", lambda s: s["t"])).drop("r")
    head = F.slice("ts", 1, (F.col("n") - F.ceil(F.lit(least) * F.col("n") - F.lit(1e-9)) + 1).cast("int"))
    keyed = ranked.select("id", "n", F.explode(head).alias("t"))
    other = keyed.select(F.col("id").alias("b"), F.col("n").alias("m"), "t")
    fits = (F.least("n", "m") >= F.lit(least) * F.greatest("n", "m") - F.lit(1e-9)) & (F.col("id") < F.col("b"))
    near = keyed.join(other, "t").where(fits).select(F.col("id").alias("a"), "b").distinct()
    side = lambda k: ranked.select(F.col("id").alias(k), F.col("ts").alias(f"ts_{k}"))
    both = F.size(F.array_intersect("ts_a", "ts_b"))
    out = near.join(side("a"), "a").join(side("b"), "b").select("a", "b", (both / (F.size("ts_a") + F.size("ts_b") - both)).alias("jaccard"))
    return out.where(F.col("jaccard") >= F.lit(least) - F.lit(1e-12))


#: Rows, in seeded order, whose pairs with their next ones make the sample of a mean: 50,000 pairs at most.
SAMPLED_ROWS, NEXT = 5_000, 10


def pair_means(df: DataFrame, key: str, tokens: str, split: str) -> DataFrame:
    """One row: the mean similarity of pairs over two splits and of pairs within one, and how many. Pairs are each of the first rows in
    seeded order with the ten after it: a stated sample, joined by place."""
    few = df.select(F.col(key).alias("id"), F.array_distinct(tokens).alias("ts"), F.col(split).alias("split")).orderBy(seeded(F.col(key)), key).limit(SAMPLED_ROWS)
    at = few.withColumn("r", F.row_number().over(Window.orderBy(seeded(F.col("id")), "id")))  # SAMPLED_ROWS rows
    other = at.select(F.col("r").alias("s"), F.col("ts").alias("us"), F.col("split").alias("other"))
    p = at.withColumn("s", F.explode(F.transform(F.sequence(F.lit(1), F.lit(NEXT)), lambda k: F.col("r") + k))).join(other, "s")
    both, either = F.size(F.array_intersect("ts", "us")), F.size(F.array_union("ts", "us"))
    p = p.withColumns({"j": F.when(either > 0, both / either).otherwise(0.0), "crosses": ~F.col("split").eqNullSafe(F.col("other"))})
    mean = lambda cond: F.round(F.coalesce(F.avg(F.when(cond, F.col("j"))), F.lit(0.0)), 6)
    return p.agg(mean(F.col("crosses")).alias("boundary_mean"), mean(~F.col("crosses")).alias("within_mean"), F.count_if("crosses").alias("boundary_pairs"), F.count_if(~F.col("crosses")).alias("within_pairs"))
