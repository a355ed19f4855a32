"""Question/answer dataset steps: keyed dedup, filters, caps, enrichment, splits, sampling, reports.

Order matters to several rules ("first wins"), so it is a column that the caller names; rows never rely on file order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions import features, text
from strandline.functions import patterns as P


def seeded(key: Column) -> Column:
    """A fixed random order: both engines of the tests know MD5."""
    return F.md5(key.cast("string"))


def first_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key: one aggregation, no sort of a key's rows."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return picked.select(*keys, "_r.*").select(*df.columns)


def last_wins(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return picked.select(*keys, "_r.*").select(*df.columns)


def distinct_questions(df: DataFrame, question: str, order: list[str]) -> DataFrame:
    """First occurrence of each question, compared trimmed and in lower case."""
    return first_wins(df.withColumn("_norm", F.lower(F.trim(question))), ["_norm"], order).drop("_norm")


def bad_ending(answer: Column) -> Column:
    t = text.strip(answer)
    out = F.lit(False)
    for e in P.BAD_ENDINGS:
        out = out | F.endswith(t, F.lit(e))
    return out


def quality_filter(df: DataFrame, answer: str, least: int = 30) -> DataFrame:
    """Answers of `least` letters or more that don't end in the middle of a sentence."""
    return df.where((F.length(text.strip(F.col(answer))) >= least) & ~bad_ending(F.col(answer)))


def accept_generated(question: Column, answer: Column, letters: str = "[àáảãạăằắẳẵặâầấẩẫậèéẻẽẹêềếểễệìíỉĩịòóỏõọôồốổỗộơờớởỡợùúủũụưừứửữựỳýỷỹỵđ]") -> Column:
    """Gate of generated pairs: long enough, no echo of the question, and in the language."""
    q, a = F.lower(text.strip(question)), F.lower(text.strip(answer))
    return (F.length(q) >= 20) & (F.length(a) >= 30) & ~F.contains(a, q) & F.rlike(q, F.lit("(?iuU)" + letters))


def cap_per_key(df: DataFrame, key: str, order: list[str], k: int = 3) -> DataFrame:
    """The first k rows of each key; a null key groups as UNKNOWN."""
    w = Window.partitionBy(F.coalesce(F.col(key).cast("string"), F.lit("UNKNOWN"))).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= k).drop("_n")


def group_histogram(df: DataFrame, key: str) -> DataFrame:
    """size, groups: how many groups there are of each size."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("size")).groupBy("size").agg(F.count(F.lit(1)).alias("groups"))


def enrich(qa: DataFrame, corpus: DataFrame, key: str = "article_key", order: list[str] | None = None, least: int = 50) -> DataFrame:
    """Left join to the article corpus, whose last row of a key wins. Rows without an article, or with an empty one, get
    gold_context '' and no facts; evidence of under `least` letters gives way to the article."""
    c = last_wins(corpus.select(key, "content", "law", "article_id", *(order or [])), [key], order or ["content"]).drop(*(order or []))
    j = qa.join(c.withColumnRenamed("content", "_content").withColumnRenamed("law", "_law").withColumnRenamed("article_id", "_article"), key, "left")
    hit = F.coalesce(F.length("_content") > 0, F.lit(False))
    fact = F.struct(F.col("_law").alias("law_id"), F.col("_article").alias("article_id"))
    j = j.withColumn("gold_context", F.when(hit, F.col("_content")).otherwise("")).withColumn("supporting_facts", F.when(hit, F.array(fact)).otherwise(F.array().cast(f"array<{_type(c)}>")))
    evidence = F.coalesce(F.col("evidence"), F.lit("")) if "evidence" in qa.columns else F.lit("")
    return j.withColumn("evidence", F.when(hit & (F.length(evidence) < least), F.col("_content")).otherwise(evidence)).drop("_content", "_law", "_article")


def _type(c: DataFrame) -> str:
    return f"struct<law_id:{c.schema['law'].dataType.simpleString()},article_id:{c.schema['article_id'].dataType.simpleString()}>"


def label(df: DataFrame, hops: Column, cross: Column, question: Column) -> DataFrame:
    """routing_label, difficulty, has_reasoning, question_type from the number of articles and of documents."""
    r = features.has_reasoning(question)
    route = F.when((hops <= 1) & ~cross, "dense_retrieval").when((hops >= 2) & ~cross, "graph_traversal").otherwise("hybrid_reasoning")
    d = F.round(0.4 * F.least(hops / 3, F.lit(1.0)) + 0.3 * cross.cast("int") + 0.3 * r.cast("int"), 2)
    return df.withColumns({"routing_label": route, "difficulty": d, "has_reasoning": r, "question_type": features.question_type(question)})


def difficulty_bucket(d: Column) -> Column:
    return F.when(d <= 0.3, "easy").when(d <= 0.6, "medium").otherwise("hard")


def hash_rank(df: DataFrame, group: str, key: str) -> DataFrame:
    """df with _k, the place of a row in its group in seeded order, from 1, and _n, the group's size.

    Rows are ranked inside (group, range of the hash); what precedes a range comes from its counts. So a group of any
    size is ranked in as many tasks as there are ranges."""
    x = df.withColumn("_h", seeded(F.col(key))).withColumn("_b", F.substring("_h", 1, 3))
    counts = x.groupBy(group, "_b").agg(F.count(F.lit(1)).alias("_c"))
    run = Window.partitionBy(group).orderBy("_b")  # 4,096 rows a group
    counts = counts.withColumn("_before", F.sum("_c").over(run) - F.col("_c")).withColumn("_n", F.sum("_c").over(Window.partitionBy(group)))
    counts = counts.select(F.col(group).alias("_g"), F.col("_b").alias("_b2"), "_before", "_n")
    j = x.join(counts, x[group].eqNullSafe(counts["_g"]) & (x["_b"] == counts["_b2"]))
    inside = Window.partitionBy(group, "_b").orderBy("_h", key)
    return j.withColumn("_k", F.row_number().over(inside) + F.col("_before")).drop("_h", "_b", "_g", "_b2", "_before")


def stratified_split(df: DataFrame, stratum: str, key: str, train: float = 0.70, dev: float = 0.15) -> DataFrame:
    """split: train, dev and test by whole shares of each stratum, the remainder to test, in seeded order."""
    x = hash_rank(df, stratum, key)
    a, b = F.floor(F.col("_n") * train), F.floor(F.col("_n") * dev)
    return x.withColumn("split", F.when(F.col("_k") <= a, "train").when(F.col("_k") <= a + b, "dev").otherwise("test")).drop("_k", "_n")


def folds(df: DataFrame, stratum: str, key: str, k: int = 5) -> DataFrame:
    return hash_rank(df, stratum, key).withColumn("fold", ((F.col("_k") - 1) % k).cast("int")).drop("_k", "_n")


def class_weights(df: DataFrame, label_col: str) -> DataFrame:
    """label, n, weight = rows / (classes * n)."""
    per = df.groupBy(label_col).agg(F.count(F.lit(1)).alias("n"))
    return per.withColumn("weight", F.sum("n").over(Window.partitionBy()) / (F.count(F.lit(1)).over(Window.partitionBy()) * F.col("n")))


def quota_sample(df: DataFrame, pool: str, key: str, quotas: dict[str, int]) -> DataFrame:
    """At most quotas[p] rows of each pool, in seeded order, none twice."""
    q = F.create_map(*[F.lit(x) for kv in quotas.items() for x in kv])
    order = Window.partitionBy(pool).orderBy(seeded(F.col(key)), key)
    most = df.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= max(quotas.values(), default=0))  # each task keeps so many
    return most.where(F.col("_n") <= F.coalesce(F.try_element_at(q, F.col(pool)), F.lit(0))).drop("_n")


def funnel(**stages: DataFrame) -> DataFrame:
    """stage, n: row counts of the stages, in order."""
    out = None
    for k, (name, df) in enumerate(stages.items()):
        row = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("pos"), F.lit(name).alias("stage"), "n")
        out = row if out is None else out.unionByName(row)
    return out


def suffix_duplicates(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The second and later rows of an id get _2, _3, ... in order of arrival."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return df.withColumn("_n", n).withColumn(key, F.when(F.col("_n") > 1, F.concat(F.col(key).cast("string"), F.lit("_"), F.col("_n"))).otherwise(F.col(key).cast("string"))).drop("_n")


def valid_endpoints(edges: DataFrame, nodes: DataFrame, src: str, dst: str, node: str) -> DataFrame:
    """Edges whose two ends are nodes: two semi joins."""
    n = nodes.select(F.col(node).alias("_id")).distinct()
    return edges.join(n, edges[src] == n["_id"], "left_semi").join(n, edges[dst] == n["_id"], "left_semi")


def not_done(df: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return df.join(done.select(key), key, "left_anti")


def chunks(df: DataFrame, column: str, size: int = 256, overlap: int = 32) -> DataFrame:
    """Words in windows of `size`, each `overlap` into the one before, from every start below the number of words:
    chunk_idx, chunk_text. Text without words has no chunk."""
    w = df.withColumn("_w", text.words(F.col(column))).where(F.size("_w") > 0)
    starts = F.sequence(F.lit(0), F.size("_w") - 1, F.lit(size - overlap))
    w = w.select("*", F.posexplode(starts).alias("chunk_idx", "_s"))
    return w.withColumn("chunk_text", F.array_join(F.slice("_w", F.col("_s") + 1, size), " ")).drop("_w", "_s")


def low_value_filter(df: DataFrame, query_id: str, column: str, phrases: list[str]) -> DataFrame:
    """Drops placeholder rows, unless a query would be left without any."""
    low = F.lower(text.collapse(F.coalesce(F.col(column), F.lit(""))))
    bad = F.lit(False)
    for p in phrases:
        bad = bad | F.contains(low, F.lit(p))
    w = Window.partitionBy(query_id)
    return df.withColumn("_ok", ~bad).withColumn("_any", F.max("_ok").over(w)).where("_ok or not _any").drop("_ok", "_any")


def pack(df: DataFrame, query_id: str, order: list, size: Column, budget: int) -> DataFrame:
    """The rows of each query, in order, before the first that would overflow the budget; the first row always."""
    w = Window.partitionBy(query_id).orderBy(*order)
    x = df.withColumn("_n", F.row_number().over(w)).withColumn("_sum", F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    over = F.min(F.when((F.col("_sum") > budget) & (F.col("_n") > 1), F.col("_n"))).over(Window.partitionBy(query_id))
    return x.withColumn("_over", over).where("_over is null or _n < _over").drop("_n", "_sum", "_over")
