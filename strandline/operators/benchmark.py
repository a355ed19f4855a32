"""Benchmark building: articles into pools, quotas over splits without reuse, partners, question and answer records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions import text as T
from strandline.operators.dataset import seeded

DENSE, GRAPH, HYBRID = "dense_retrieval", "graph_traversal", "hybrid_reasoning"
#: Questions of the three kinds, and the records' limits, scores and types.
DENSE_QUESTION = "Nội dung {label} của văn bản {law} quy định như thế nào?"
GRAPH_QUESTIONS = (
    "Theo văn bản {law}, quy định về {topic_a} và {topic_b} được nêu cụ thể như thế nào? Hãy tổng hợp đầy đủ từ các quy định liên quan trong văn bản này.",
    "Trong văn bản {law}, {topic_a} và {topic_b} đều được quy định. Nội dung chi tiết của hai quy định này là gì?",
    "Theo {law}, cần hiểu như thế nào về {topic_a}? Ngoài ra, văn bản này còn quy định thêm điều gì về {topic_b} liên quan?",
    "Văn bản {law} có những quy định nào về {topic_a}? Đồng thời, quy định về {topic_b} trong cùng văn bản là gì? Hãy nêu đầy đủ cả hai.",
    "Theo {law}, hãy trình bày toàn bộ nội dung quy định liên quan đến {topic_a} cũng như {topic_b} trong văn bản này.",
)
HYBRID_QUESTIONS = (
    "Theo quy định của văn bản {law_a} và văn bản {law_b}, nội dung về {topic_a} được quy định như thế nào? Hãy tổng hợp đầy đủ từ cả hai văn bản.",
    "Để hiểu đầy đủ về {topic_a}, cần tham chiếu cả văn bản {law_a} và văn bản {law_b}. Nội dung tương ứng ở hai văn bản này là gì?",
    "Văn bản {law_a} về {topic_a} có liên quan đến văn bản {law_b}. Hãy tổng hợp nội dung quy định từ cả hai văn bản về vấn đề này.",
    "Theo cả văn bản {law_a} lẫn văn bản {law_b}, quy định về {topic_a} và {topic_b} bao gồm những nội dung gì?",
    "Văn bản {law_a} và văn bản {law_b} cùng điều chỉnh lĩnh vực liên quan đến {topic_a}. Hãy nêu đầy đủ nội dung quy định từ từng văn bản.",
)
#: What a title of an article holds before and after its topic, and the numbering of topics.
TITLE = r"(?iuU)^\d+\.\d+\.\s*[Đđ]iều\s+\d+(?:\.\d+)*(?:\.[A-ZĐa-z]+\d*)*\.\s*(.+?)(?:\s*[-–]\s*(?:Luật|Nghị định|Thông tư|Quyết định|Chỉ thị|Pháp lệnh|Hiến pháp).*)?$"
NUMBERED = r"(?U)^\d+(?:\.\d+)+\.\s*"
ARTICLE = "Điều "
LEAST, ANSWER, FIRST, SECOND, TOPIC, SHORT = 80, 3000, 1500, 1400, 80, 4
KINDS = {DENSE: (1, False, "factual", 0.35, False), GRAPH: (2, False, "relational_multihop", 0.60, True), HYBRID: (2, True, "cross_doc_multihop", 0.65, True)}


def usable(chunks: DataFrame) -> DataFrame:
    """Chunks with an id that has both parts, a law, and 80 letters or more; `article` is the id's second part."""
    content = T.strip(F.coalesce("content", F.lit("")))
    ok = F.coalesce(F.col("has_canonical_id"), F.lit(False)) & (F.coalesce("law_number", F.lit("")) != "") & F.contains("canonical_id", F.lit("::")) & (F.length(content) >= LEAST)
    return chunks.where(ok).withColumns({"content": content, "article": F.element_at(F.split("canonical_id", "::", 2), 2)})


def quota_splits(df: DataFrame, pool: str, key: str, quotas: dict[str, dict[str, int]]) -> DataFrame:
    """df's rows with `split` and `reused`. quotas: rows wanted of each pool, by split.

    A pool's keys stand in seeded order, once each; every split begins where the one before stopped. Where a pool runs dry, a split
    takes the pool's first keys again that it hasn't itself. The order's limit is pushed before the shuffle, so a large pool sends
    no more rows of a task than all splits want."""
    labels = sorted({p for q in quotas.values() for p in q})
    total = {p: sum(q.get(p, 0) for q in quotas.values()) for p in labels}
    most = max(total.values(), default=0)
    order = Window.partitionBy(pool).orderBy(seeded(F.col(key)), key)
    once = df.where(F.col(pool).isin(labels)).dropDuplicates([pool, key]).withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= most)
    once = once.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(pool)))  # at most `most` rows a pool
    wanted, begun = [], dict.fromkeys(labels, 0)
    for split, q in quotas.items():
        for p in labels:
            wanted.append(F.struct(F.lit(p).alias("pool"), F.lit(split).alias("split"), F.lit(begun[p]).alias("begin"), F.lit(q.get(p, 0)).alias("want")))
            begun[p] += q.get(p, 0)
    x = once.withColumn("_w", F.explode(F.filter(F.array(*wanted), lambda w: w["pool"] == F.col(pool))))
    r, n, begin, want = F.col("_r"), F.col("_n"), F.col("_w.begin"), F.col("_w.want")
    fresh = (r > begin) & (r <= begin + want)
    left = want - F.greatest(F.lit(0), F.least(want, n - begin))
    again = ~fresh & (r <= left) & (r <= begin)
    return x.where(fresh | again).withColumns({"split": F.col("_w.split"), "reused": again}).drop("_r", "_n", "_w")


def first_articles(articles: DataFrame, law: str = "law_number", key: str = "canonical_id", most: int = 2) -> DataFrame:
    """law, firsts: the first articles of each law in seeded order, `most` at most."""
    w = Window.partitionBy(law).orderBy(seeded(F.col(key)), key)
    few = articles.dropDuplicates([key]).withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most)
    return few.groupBy(law).agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", key))), lambda x: x[key]).alias("firsts"))


def partners(rows: DataFrame, articles: DataFrame, label: str = "routing_label") -> DataFrame:
    """rows: canonical_id, law_number, label, same_ref (an article of the same law, or null), other_law (or null). Adds partner, a
    canonical_id, and `kind`: graph questions pair with the article referred to, else any other one of the law; hybrid ones with an
    article of the other law; what finds no partner is a dense question."""
    firsts = first_articles(articles)
    ids = articles.select(F.col("canonical_id").alias("_id")).distinct()
    x = rows.withColumn("_ref", F.when(F.col(label) == GRAPH, F.concat("law_number", F.lit("::"), "same_ref")))
    x = x.join(ids, x["_ref"] == ids["_id"], "left")
    x = x.join(firsts.withColumnRenamed("firsts", "_own"), "law_number", "left").join(firsts.select(F.col("law_number").alias("other_law"), F.col("firsts").alias("_other")), "other_law", "left")
    any_other = F.get(F.filter("_own", lambda a: a != F.col("canonical_id")), 0)
    partner = F.when(F.col(label) == GRAPH, F.coalesce(F.when(F.col("_id") != F.col("canonical_id"), F.col("_id")), any_other)).when(F.col(label) == HYBRID, F.get("_other", 0))
    return x.withColumn("partner", partner).withColumn("kind", F.when(F.col("partner").isNull(), DENSE).otherwise(F.col(label))).drop("_ref", "_id", "_own", "_other")


def topic(title: Column, pattern: str = TITLE, numbered: str = NUMBERED) -> Column:
    """What a title is about: the pattern's group without what follows a dash and without numbering, else the last sentence part before
    a dash, cut at 80 letters."""
    t = T.strip(F.coalesce(title, F.lit("")))
    first = T.strip(F.regexp_replace(T.strip(F.regexp_extract(t, pattern, 1)), r"(?U)\s*[-–]\s*.+$", ""))
    first = T.strip(F.regexp_replace(first, numbered, ""))
    part = F.element_at(F.split(F.element_at(F.split(F.coalesce(title, F.lit("")), " - ", 2), 1), r"\."), -1)
    return F.when(F.rlike(t, F.lit(pattern)), first).otherwise(F.substring(T.strip(part), 1, TOPIC))


def _filled(template: Column, **values: Column) -> Column:
    for name, v in values.items():
        template = F.replace(template, F.lit("{" + name + "}"), v)
    return template


def records(rows: DataFrame, articles: DataFrame) -> DataFrame:
    """rows: what partners() gives, with split. articles: canonical_id, law_number, article, title, content, each id once. One record a row:
    split, canonical_id, question, answer, routing_label, hop_count, is_cross_doc, question_type, difficulty, has_reasoning, relevant. A
    template is chosen by the id's hash."""
    a = articles.select("canonical_id", F.col("article").alias("art"), "title", "content")
    b = articles.select(F.col("canonical_id").alias("partner"), F.col("article").alias("art_b"), F.col("title").alias("title_b"), F.col("content").alias("content_b"), F.col("law_number").alias("law_b"))
    x = rows.select("split", "canonical_id", "law_number", "partner", "kind").join(a, "canonical_id").join(b, "partner", "left")
    label, label_b = F.concat(F.lit(ARTICLE), "art"), F.concat(F.lit(ARTICLE), "art_b")
    named = lambda t, fallback: F.when(F.length(t) >= SHORT, t).otherwise(fallback)
    values = {"topic_a": named(topic(F.coalesce("title", F.col("law_number"))), label), "topic_b": named(topic(F.coalesce("title_b", F.col("law_b"))), label_b)}
    pick = lambda ts: F.get(F.array(*(F.lit(t) for t in ts)), (F.conv(F.substring(seeded(F.col("canonical_id")), 1, 6), 16, 10).cast("long") % len(ts)).cast("int"))
    question = (
        F.when(F.col("kind") == GRAPH, _filled(pick(GRAPH_QUESTIONS), law=F.col("law_number"), **values))
        .when(F.col("kind") == HYBRID, _filled(pick(HYBRID_QUESTIONS), law_a=F.col("law_number"), law_b=F.col("law_b"), **values))
        .otherwise(_filled(F.lit(DENSE_QUESTION), label=label, law=F.col("law_number")))
    )
    both = F.concat(F.substring("content", 1, FIRST), F.lit("\n\n"), F.substring("content_b", 1, SECOND))
    answer = F.substring(F.when(F.col("kind") == DENSE, F.col("content")).otherwise(both), 1, ANSWER)
    fixed = [F.when(F.col("kind") == GRAPH, F.lit(g)).when(F.col("kind") == HYBRID, F.lit(h)).otherwise(F.lit(d)).alias(n) for n, d, g, h in zip(("hop_count", "is_cross_doc", "question_type", "difficulty", "has_reasoning"), KINDS[DENSE], KINDS[GRAPH], KINDS[HYBRID], strict=True)]
    relevant = F.array_compact(F.array(F.col("canonical_id"), F.when(F.col("kind") != DENSE, F.col("partner"))))
    return x.select("split", "canonical_id", question.alias("question"), answer.alias("answer"), F.col("kind").alias("routing_label"), *fixed, relevant.alias("relevant"))
