"""Evidence to context: source ids, numbered blocks, merged contexts, prompts; models that are called behind a boundary."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.functions import text

#: Patterns of source ids in graph contexts, in order of priority; at most so many ids are kept.
SOURCE_ID = r"Nguồn gốc ID:\s*([\d]+/\d{4}/[\w/\-]+::\d+)"
SOURCE_LINE = r"Nguồn gốc:\s*Điều\s+(\d+)[^\n]{0,120}?số\s+([\d]+/\d{4}/[\w/\-]+)"
LAW_LINE, ARTICLE_LINE, DOC_LINE = r"Law ID:\s*([^\n]+)", r"Article ID:\s*([^\n]+)", r"Doc ID:\s*([^\n]+)"
BARE = (r"\b\d{1,4}/(?:\d{4}/)?[A-ZĐ]{1,12}(?:-[A-ZĐ]{1,12}){0,4}\b", r"\bpd_\d{3}_\d{3}_\d{4}\b")
BLOCK, MOST_SOURCES = "[Start:", 12
PREFIXES = ("hf_processed_", "phapdien_processed_")
HEAD_ARTICLE = r"(?iuU)^(?:\*\*|###\s*|#+\s*)?(Điều\s+\d+[a-zA-Z]*)"


def source_id(ids: list[Column], chunk: Column) -> Column:
    """The first id that is set; a canonical one stays, else prefixes go and the chunk's leading article is added."""
    raw = F.coalesce(*[F.nullif(c.cast("string"), F.lit("")) for c in ids])
    law = raw
    for p in PREFIXES:
        law = F.regexp_replace(law, "^" + p, "")
    article = F.trim(F.regexp_extract(F.coalesce(chunk, F.lit("")), HEAD_ARTICLE, 1))
    return F.when(F.rlike(raw, F.lit(r"^[^:]+::\d")), raw).when(article != "", F.concat(law, F.lit("::"), article)).otherwise(law)


def context_sources(context: Column, most: int = MOST_SOURCES) -> Column:
    """Source ids that a context names, those of a higher priority first, without repeats."""
    all_of = lambda p, g, c=context: F.regexp_extract_all(c, F.lit(p), F.lit(g))
    one = F.transform(all_of("(?U)" + SOURCE_ID, 1), lambda x: F.trim(x))
    pairs = F.arrays_zip(all_of("(?iuU)" + SOURCE_LINE, 1).alias("a"), all_of("(?iuU)" + SOURCE_LINE, 2).alias("d"))
    two = F.transform(pairs, lambda p: F.concat(F.regexp_replace(p["d"], r"[.,]+$", ""), F.lit("::"), p["a"]))
    blocks = F.split(context, r"\[Start:")

    def of(b):
        law, art, doc = (F.trim(F.regexp_extract(b, p, 1)) for p in (LAW_LINE, ARTICLE_LINE, DOC_LINE))
        return F.when((law != "") & (art != ""), F.concat(law, F.lit("::"), art)).when(doc != "", doc)

    three = F.array_compact(F.transform(blocks, of))
    four = F.concat(*[all_of("(?U)" + p, 0) for p in BARE])
    return F.slice(F.array_distinct(F.concat(one, two, three, four)), 1, most)


def numbered(df: DataFrame, query_id: str, order: list, title: Column, body: Column) -> DataFrame:
    """query_id, context: the query's evidence in order, as numbered blocks. Evidence of a query is a top-k."""
    n = F.row_number().over(Window.partitionBy(query_id).orderBy(*order))
    x = df.withColumn("_n", n).withColumn("_b", F.concat(F.lit("["), F.col("_n"), F.lit("] "), title, F.lit("\n"), body))
    x = x.groupBy(query_id).agg(F.array_sort(F.collect_list(F.struct("_n", "_b"))).alias("_bs"))
    return x.select(query_id, F.array_join(F.transform("_bs", lambda b: b["_b"]), "\n\n").alias("context"))


def merge(vector: Column, graph: Column, vector_header: str, graph_header: str, nothing: str, limits: tuple = (12_000, 3_500, 16_000), mark: str = "...") -> Column:
    """Both contexts under their headers, each and the whole cut to its limit; a graph context that says that nothing was
    found is left out, and without any context the result is `nothing`."""
    v = text.truncated(F.coalesce(vector, F.lit("")), limits[0], mark)
    g = text.truncated(F.coalesce(graph, F.lit("")), limits[1], mark)
    parts = F.array_compact(F.array(F.when(v != "", F.concat(F.lit(vector_header + "\n"), v)), F.when((g != "") & ~F.contains(g, F.lit(nothing)), F.concat(F.lit(graph_header + "\n"), g))))
    return F.when((v == "") & (g == ""), nothing).otherwise(text.truncated(F.array_join(parts, "\n\n"), limits[2], mark))


def prompt(query: Column, context: Column, history: Column, instruction: str) -> Column:
    return F.concat(F.lit(instruction + "\n\nContext:\n"), F.coalesce(context, F.lit("")), F.lit("\n\nHistory:\n"), F.coalesce(F.nullif(history, F.lit("")), F.lit("None")), F.lit("\n\nQuestion: "), query)


def templates(key: Column, language: Column, table: dict[tuple[str, str], str], fallback: str = "en") -> Column:
    """A message by key and language; the fallback language's if there is none, else the key itself."""
    m = F.create_map(*[F.lit(x) for (k, lang), v in table.items() for x in (f"{k}/{lang}", v)])
    return F.coalesce(F.try_element_at(m, F.concat(key, F.lit("/"), language)), F.try_element_at(m, F.concat(key, F.lit(f"/{fallback}"))), key)


def hash_embedder(dim: int = 64) -> Callable[[list[str]], list[list[float]]]:
    """A stand-in for an embedding model: signed hashes of words, as unit vectors. The same on every machine."""
    import zlib

    def embed(texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = [0.0] * dim
            for w in t.lower().split():
                h = zlib.crc32(w.encode())
                v[h % dim] += 1.0 if h >> 16 & 1 else -1.0
            n = sum(x * x for x in v) ** 0.5
            out.append([x / n for x in v] if n else v)
        return out

    return embed


def embed(df: DataFrame, column: str, model: Callable[[list[str]], list[list[float]]], out: str = "embedding", batch: int = 64) -> DataFrame:
    """df with a column of vectors from a model that takes lists of texts; null texts count as empty."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            texts = p[column].fillna("").tolist()
            yield p.assign(**{out: [v for i in range(0, len(texts), batch) for v in model(texts[i : i + batch])]})

    return df.mapInPandas(run, T.StructType([*df.schema.fields]).add(out, T.ArrayType(T.DoubleType())))


def rerank(df: DataFrame, query_id: str, order: list, score: Column | None, k: int) -> DataFrame:
    """The k rows of each query of the highest relevance; without a score, 1 - i / n of the order they come in."""
    w = Window.partitionBy(query_id)
    x = df.withColumn("_i", F.row_number().over(w.orderBy(*order)) - 1)
    x = x.withColumn("relevance", score if score is not None else 1.0 - F.col("_i") / F.count(F.lit(1)).over(w))
    return x.withColumn("rank", F.row_number().over(w.orderBy(F.desc("relevance"), "_i"))).where(F.col("rank") <= k).drop("_i")


def fill_missing(nodes: DataFrame, column: str, computed: DataFrame, key: str) -> DataFrame:
    """Incremental write-back: only nulls of the column are filled, from rows of their key."""
    c = computed.select(key, F.col(column).alias("_new"))
    return nodes.join(c, key, "left").withColumn(column, F.coalesce(column, "_new")).drop("_new")
