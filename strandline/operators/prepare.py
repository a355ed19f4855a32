"""Small steps before indexing and training: titled chunks, rewritten questions, display texts, training rows, chosen sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandline.functions import routing
from strandline.operators import dataset

#: Questions that need clarifying, for a class that no corpus has; their number.
CLARIFY = (
    "Ông ấy có quyền gì?", "Luật đó quy định như thế nào?", "Điều đó có đúng không?", "Người đó có bị xử phạt không?", "Cơ quan đó có thẩm quyền gì?", "Quy định có áp dụng không?", "Họ phải làm gì?",
    "Vấn đề đó giải quyết ra sao?", "Bên đó có trách nhiệm gì?", "Điều khoản đó nói gì?", "Luật này áp dụng cho ai?", "Nó có còn hiệu lực không?", "Trường hợp đó được xử lý như thế nào?", "Bà ấy có được miễn không?", "Quyết định đó có hợp lệ không?",
)
SAMPLES = 60
#: Everyday words and what statutes call them, in the order they are replaced.
SYNONYMS = (
    (r"(?iuU)\b(bằng|xe)\s+(B1|B2|C|D|E|F)\b", "xe ô tô"), (r"(?iuU)\bxe máy\b", "xe mô tô, xe gắn máy"), (r"(?iuU)\bsổ đỏ\b", "Giấy chứng nhận quyền sử dụng đất"),
    (r"(?iuU)\bvượt đèn đỏ\b", "không chấp hành hiệu lệnh của đèn tín hiệu giao thông"), (r"(?iuU)\btước bằng\b", "tước quyền sử dụng Giấy phép lái xe"),
)
#: Letters of an article that is embedded whole, and that one must have.
WHOLE, LEAST = 8000, 50
FLAGS = ("missing_entity", "pronoun_reference", "multi_interpretation", "incomplete_context")


def titled_chunks(df: DataFrame, title: str, content: str, size: int = 256, overlap: int = 32) -> DataFrame:
    """Windows of words of the title and the content below it; the other columns go along with each."""
    t = F.coalesce(F.col(title), F.lit(""))
    text = F.when(t != "", F.concat(t, F.lit("\n"), F.coalesce(F.col(content), F.lit("")))).otherwise(F.coalesce(F.col(content), F.lit("")))
    return dataset.chunks(df.withColumn("_text", text), "_text", size, overlap).drop("_text")


def whole_articles(df: DataFrame, content: str) -> DataFrame:
    """The other way to an index: one text an article, cut, of those that are long enough."""
    text = F.trim(F.coalesce(F.col(content), F.lit("")))
    return df.withColumn(content, F.substring(text, 1, WHOLE)).where(F.length(text) >= LEAST)


def rewritten(query: Column, rules: tuple = SYNONYMS) -> Column:
    """Everyday words by the statutes' words."""
    for pattern, word in rules:
        query = F.regexp_replace(query, pattern, word)
    return query


def display(columns: list[str], fields: tuple[str, ...] = ("name", "title", "article_id", "doc_id", "chunk_id"), fallback: str = "") -> Column:
    """The first of the fields that isn't null, of those that a table has."""
    return F.coalesce(*(F.col(f).cast("string") for f in fields if f in columns), F.lit(fallback))


def summary(label: Column, title: Column, own_id: Column, doc_id: Column, content: Column) -> Column:
    """A node's text for a prompt, by its label."""
    t, i, d, c = (F.coalesce(x.cast("string"), F.lit("")) for x in (title, own_id, doc_id, content))
    article = F.concat(F.lit("Title: "), t, F.lit("\nArticle ID: "), i, F.lit("\nLaw ID: "), d, F.lit("\nContent: "), c)
    chunk = F.concat(F.lit("Title: "), t, F.lit("\nDoc ID: "), d, F.lit("\nVector chunk: "), i, F.lit("\nContent: "), c)
    return F.when(label == "LegalArticle", article).when(label == "VectorChunk", chunk).otherwise(c)


def string_list(value: Column) -> Column:
    """A JSON value as a list of texts: null and empty ones are none, a single text is a list of it, empty and null items go."""
    items = F.filter(F.from_json(value, "array<string>"), lambda x: x.isNotNull() & (x != ""))
    v = F.trim(value)
    one = F.from_json(F.concat(F.lit('{"v":'), v, F.lit("}")), "v string")["v"]
    return F.when(F.startswith(v, F.lit("[")), F.coalesce(items, F.array().cast("array<string>"))).when(one.isNull() | (one == ""), F.array().cast("array<string>")).otherwise(F.array(one))


def flags(value: Column, names: tuple[str, ...] = FLAGS) -> Column:
    """A JSON object's flags as booleans: what is missing, null, false, 0, empty or no object is false."""
    o = F.from_json(value, ", ".join(f"{n} string" for n in names))
    return F.struct(*((~F.coalesce(o[n], F.lit("")).isin("", "false", "0", "0.0", "[]", "{}", "null")).alias(n) for n in names))


def training_rows(labelled: DataFrame, key: str, samples: int = SAMPLES, templates: tuple[str, ...] = CLARIFY) -> DataFrame:
    """query, label, source, order: labelled questions (question, routing_label) and made-up ones that need clarifying, in seeded order."""
    spark = labelled.sparkSession
    real = routing.labelled(labelled).select(F.col("question").alias("query"), F.col("routing_label").alias("label"), F.lit("qa_dataset").alias("source"), dataset.seeded(F.col(key)).alias("order"))
    pick = (F.conv(F.substring(F.md5(F.concat(F.lit("clarify"), F.col("id"))), 1, 6), 16, 10).cast("long") % len(templates)).cast("int")
    made = spark.range(samples).select(F.get(F.array(*(F.lit(t) for t in templates)), pick).alias("query"), F.lit("clarify").alias("label"), F.lit("synthetic_clarify").alias("source"), F.md5(F.concat(F.lit("clarify-"), F.col("id"))).alias("order"))
    return real.unionByName(made)


def augmented(base: DataFrame, *more: DataFrame) -> DataFrame:
    """All rows, one below the other; what a part lacks is null."""
    for m in more:
        base = base.unionByName(m, allowMissingColumns=True)
    return base


def exists(df: DataFrame) -> bool:
    """Whether there is a row; no more than one is read."""
    return bool(df.limit(1).count())


def chosen(sources: dict[str, DataFrame], choice: str = "all", caps: dict[str, tuple[str, int]] | None = None) -> DataFrame:
    """Rows of the chosen source, or of all, with their source; caps: source -> (column, most): its first so many values of the
    column, in order, count (a sampling option of the caller)."""
    if choice != "all" and choice not in sources:
        raise ValueError(f"{choice} is none of {', '.join(sources)}")
    parts = []
    for name, df in sources.items():
        if choice in ("all", name):
            if caps and name in caps:
                column, most = caps[name]
                df = df.join(F.broadcast(df.select(column).distinct().orderBy(column).limit(most)), column, "left_semi")  # `most` values
            parts.append(df.withColumn("source_name", F.lit(name)))
    return augmented(*parts)
