"""Keyword search: OR of LIKE, BM25 over an inverted index, weighted terms, composite ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions import text
from strandline.operators import lookup
from strandline.sources import storage


TOKEN = r"(?U)[\p{L}\p{N}_]+"


def tokens(c: Column) -> Column:
    """Runs of letters, digits and underscores, in lower case."""
    return F.regexp_extract_all(F.lower(c), F.lit(TOKEN), F.lit(0))


def like_any(df: DataFrame, columns: list[str], words: list[str]) -> DataFrame:
    """Rows of which a column contains a word; wildcards in words are letters like any other."""
    cond = F.lit(False)
    for w in words:
        for c in columns:
            cond = cond | F.contains(F.lower(F.col(c)), F.lit(w.lower()))
    return df.where(cond)


def postings(docs: DataFrame, doc_id: str, column: str, wanted: DataFrame | None = None) -> DataFrame:
    """term, doc, tf, len: the inverted index, of all terms or of those in `wanted` (term)."""
    t = docs.select(F.col(doc_id).alias("doc"), tokens(F.coalesce(F.col(column), F.lit(""))).alias("ts"))
    rows = t.select("doc", F.size("ts").alias("len"), F.explode("ts").alias("term"))
    rows = rows if wanted is None else rows.join(wanted, "term", "left_semi")
    return rows.groupBy("term", "doc", "len").agg(F.count(F.lit(1)).alias("tf"))


#: Distinct query terms (some 50 bytes each) that are broadcast before documents are counted; more are joined by shuffle.
BROADCAST_TERMS = 500_000


def bm25(docs: DataFrame, queries: DataFrame, doc_id: str, column: str, k: int, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """queries: query_id, query. The k best documents of each query: query_id, doc, score, rank.

    Tokens that no query has are dropped before anything is moved; document frequencies and the mean length are counted over all
    documents. For repeated searches of one table, text_index keeps the postings and scores fewer."""
    terms = queries.select("query_id", F.explode(F.array_distinct(tokens(F.col("query")))).alias("term"))
    wanted = terms.select("term").distinct()
    wanted = F.broadcast(wanted) if wanted.count() <= BROADCAST_TERMS else wanted
    stats = docs.select(F.regexp_count(F.lower(F.coalesce(F.col(column), F.lit(""))), F.lit(TOKEN)).alias("len")).agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("mean")).first()
    hit = storage.cut(postings(docs, doc_id, column, wanted), "postings")
    idf = F.log(1 + (F.lit(stats["n"]) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    asked = storage.cut(terms.join(hit.groupBy("term").agg(F.count(F.lit(1)).alias("df")), "term").select("query_id", "term", idf.alias("idf")), "asked")
    s = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.lit(stats["mean"] or 1.0)))
    few = asked.count() <= BROADCAST_TERMS
    # dealt by document before the join, the sums of a query and document need no further shuffle
    x = (hit.repartition("doc").join(F.broadcast(asked), "term") if few else hit.join(asked, "term")).select("query_id", "doc", s.alias("s"))
    s = x.groupBy("query_id", "doc").agg(F.round(F.sum("s"), 9).alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc")
    return s.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def keyword_weight(haystack: Column, weights: dict[str, float]) -> Column:
    """Sum of the weights of the keywords that the text contains."""
    low = F.lower(haystack)
    out = F.lit(0.0)
    for word, w in weights.items():
        out = out + F.when(F.contains(low, F.lit(word)), F.lit(float(w))).otherwise(0.0)
    return out


def composite(df: DataFrame, haystack: str, weights: dict[str, float], score: str, boost: Column, degree: str, name: str, contradictions: tuple = ()) -> DataFrame:
    """Start-node rank: 4 * keywords + 8 * anchors (weight 5 or more) + score + boost - 10 * contradictions; ties by degree,
    then the shorter name. Rows of little signal are kept only where a query has no other."""
    kw = keyword_weight(F.col(haystack), weights)
    anchors = keyword_weight(F.col(haystack), {w: 1.0 for w, v in weights.items() if v >= 5})
    low, against = F.lower(F.col(haystack)), F.lit(0)
    for a, b in contradictions:
        against = against + (F.contains(low, F.lit(a)) & F.contains(low, F.lit(b))).cast("int")
    x = df.withColumn("kw", kw).withColumn("rank_score", 4 * F.col("kw") + 8 * anchors + F.col(score) + boost - 10 * against)
    good = (F.col("kw") >= 5) | ((F.col(score) >= 8) & (F.col("kw") >= 3))
    x = x.withColumn("_good", good).withColumn("_any", F.max("_good").over(Window.partitionBy("query_id"))).where("_good or not _any").drop("_good", "_any")
    w = Window.partitionBy("query_id").orderBy(F.desc("rank_score"), F.desc(degree), F.length(name), name)
    return x.withColumn("rank", F.row_number().over(w))


def best_per_id(query_id: str, item: str, score: str, *sets: DataFrame) -> DataFrame:
    """Union of candidate sets, each item with its best score."""
    out = sets[0]
    for s in sets[1:]:
        out = out.unionByName(s)
    return out.groupBy(query_id, item).agg(F.max(score).alias(score))


def ngrams(ts: Column, n: int) -> Column:
    """Runs of n tokens, joined by spaces."""
    return F.when(F.size(ts) >= n, F.transform(F.sequence(F.lit(0), F.size(ts) - n), lambda i: F.array_join(F.slice(ts, i + 1, n), " "))).otherwise(F.array().cast("array<string>"))


def query_terms(df: DataFrame, query: str, stop: set[str], phrases: dict[str, float], most: int = 12) -> DataFrame:
    """df with `terms`: at most `most` structs of text and weight, references before phrases before words, without
    repeats: heavier first, then of more words, then in order of appearance."""
    low = F.lower(F.col(query))
    ts = F.filter(tokens(F.col(query)), lambda t: (F.length(t) >= 3) & ~t.isin(*stop) if stop else F.length(t) >= 3)
    refs = F.regexp_extract_all(low, F.lit(r"(?iuU)\b\d{1,5}/\d{4}/[A-ZÀ-ỸĐ0-9-]+"), F.lit(0))
    entry = lambda t, w: F.struct(t.alias("text"), F.lit(float(w)).alias("weight"))
    parts = [F.transform(refs, lambda t: entry(t, 10)), F.transform(refs, lambda t: entry(F.regexp_replace(t, "[/-]", " "), 9))]
    if phrases:
        parts.append(F.array_compact(F.array(*[F.when(F.contains(low, F.lit(p)), entry(F.lit(p), w)) for p, w in phrases.items()])))
    parts.append(F.transform(F.slice(F.array_distinct(ngrams(ts, 3)), 1, 8), lambda t: entry(t, 4)))
    parts.append(F.transform(F.slice(F.array_distinct(ngrams(ts, 2)), 1, 8), lambda t: entry(t, 3)))
    parts.append(F.transform(F.array_distinct(ts), lambda t: entry(t, 1)))
    found = F.concat(*parts)
    texts = F.transform(found, lambda x: x["text"])
    ranked = F.array_sort(F.transform(found, lambda x, i: F.struct((-x["weight"]).alias("w"), (-F.size(text.words(x["text"]))).alias("n"), i.alias("i"), x["text"].alias("text"), x["weight"].alias("weight"))))
    once = F.filter(ranked, lambda x: F.array_position(texts, x["text"]) == x["i"] + 1)
    return df.withColumn("terms", F.slice(F.transform(once, lambda x: F.struct(x["text"].alias("text"), x["weight"].alias("weight"))), 1, most))


#: Words that an English question isn't searched for; words of a question that are.
STOP = ("what", "is", "the", "a", "an", "of", "and", "or", "in", "on", "with", "for", "to", "was", "were", "first", "last")
FIRST_WORDS, FALLBACK_WORDS = 5, 3


def search_words(query: Column, english: bool = True) -> Column:
    """The words of a question that a search by LIKE takes: in English the first five without punctuation and stop words, else the first
    five as they are; where none is left, the first three without punctuation."""
    raw = text.words(F.lower(F.coalesce(query, F.lit(""))))
    clean = F.filter(F.transform(raw, lambda w: F.regexp_replace(w, r"(?U)[^\w]", "")), lambda w: w != "")
    first = F.slice(F.filter(clean, lambda w: ~w.isin(*STOP)) if english else raw, 1, FIRST_WORDS)
    return F.when(F.size(first) > 0, first).otherwise(F.slice(clean, 1, FALLBACK_WORDS))


def word_search(docs: DataFrame, queries: DataFrame, order: str, k: int, columns: list[str], english: bool = True) -> DataFrame:
    """queries: query_id, query. query_id, rank and `order` of the first k documents, by order, that have a word of the question in a column,
    upper and lower case alike. All words are looked for in one pass over the documents; the first k of a question are among the first k
    of its words, so no more than those are moved."""
    asked = queries.select("query_id", F.explode(F.array_distinct(search_words(F.col("query"), english))).alias("entity"))
    texts = docs.select(order, F.lower(F.concat_ws("\n", *columns)).alias("text"))
    hit = lookup.first_containing(texts, asked.select("entity"), order, k).join(asked, "entity").select("query_id", order).distinct()
    w = Window.partitionBy("query_id").orderBy(order)
    return hit.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
