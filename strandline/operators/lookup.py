"""References between articles, look-ups by number and by id, the article graph, pools and targets of a benchmark."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.functions import normalise as N

#: Labels of the benchmark's pools.
HYBRID, GRAPH, DENSE = "hybrid_reasoning", "graph_traversal", "dense_retrieval"
#: Entities that texts are searched for at a time; a larger list goes in blocks.
ENTITIES = 200_000
#: Bytes of rows that a task holds before it gives them on.
BYTES = 8 << 20


def _first(articles: DataFrame, found: Column, key: str, corpus: DataFrame, on: list[str], name: str) -> DataFrame:
    """Of the references of each article the first that the corpus has: an array's places, an equi-join, the least place."""
    refs = articles.select("id", "law", "article", F.posexplode(F.array_distinct(found)).alias("at", "ref")).withColumnRenamed("ref", key)
    hits = refs.join(corpus, on, "left_semi")
    return hits.groupBy("id").agg(F.min_by(key, "at").alias(name))


def references(articles: DataFrame) -> DataFrame:
    """articles: id, law, article (number as text), content. Adds same_law (the first referenced article of the same law
    that exists and isn't itself), other_law (the first other law that exists) and the pool they put the article in."""
    own = F.regexp_extract_all("content", F.lit(N.ARTICLE_NUMBER), F.lit(1))
    same = F.filter(own, lambda x: x != F.col("article"))
    norm = lambda c: F.upper(F.regexp_replace(c, r"(?U)\s+", ""))
    others = F.filter(F.transform(F.regexp_extract_all("content", F.lit(N.DOC_NUMBER), F.lit(1)), norm), lambda x: x != norm(F.col("law")))
    of_law = articles.select("law", F.col("article").alias("ref_article")).distinct()
    laws = articles.select(norm(F.col("law")).alias("ref_law")).distinct()
    a = _first(articles, same, "ref_article", of_law, ["law", "ref_article"], "same_law")
    b = _first(articles, others, "ref_law", laws, ["ref_law"], "other_law")
    out = articles.join(a, "id", "left").join(b, "id", "left")
    return out.withColumn("pool", F.when(F.col("other_law").isNotNull(), HYBRID).when(F.col("same_law").isNotNull(), GRAPH).otherwise(DENSE))


def direct_articles(articles: DataFrame, queries: DataFrame, most: int = 5) -> DataFrame:
    """queries: query_id, query. Articles that originate in a document and article which the query names: query_id, id,
    rank. A content tells its origin by `Nguồn gốc: Điều N` before a blank, comma, stop or bracket; of a query's article
    numbers the first eight count. Both sides are taken apart and joined by equality, not searched for each other."""
    q = queries.select("query_id", F.explode(N.doc_numbers(F.col("query"))).alias("doc"), F.slice(N.article_numbers(F.col("query")), 1, 8).alias("n"))
    q = q.select("query_id", "doc", F.explode("n").alias("n"))
    origin = F.transform(F.regexp_extract_all("content", F.lit(r"Nguồn gốc: Điều (\d+)[ ,.)]"), F.lit(1)), lambda x: x.cast("int"))
    a = articles.select("id", F.explode(F.array_distinct(origin)).alias("n"), N.doc_numbers(F.col("content")).alias("docs")).select("id", "n", F.explode("docs").alias("doc"))
    found = q.join(a, ["doc", "n"]).select("query_id", "id").distinct()
    ranked = found.groupBy("query_id").agg(F.slice(F.sort_array(F.collect_set("id")), 1, most).alias("ids"))
    return ranked.select("query_id", F.posexplode("ids").alias("rank", "id")).withColumn("rank", F.col("rank") + 1)


def by_any_id(nodes: DataFrame, ids: DataFrame, fields: list[str], key: str) -> DataFrame:
    """Nodes one of whose fields is among ids (a column `wanted`): a union of equi-joins, each node once."""
    wanted = ids.select(F.col("wanted")).distinct()
    some = None
    for f in fields:
        hit = nodes.where(F.col(f).isNotNull()).join(wanted, F.col(f) == F.col("wanted"), "left_semi").select(key)
        some = hit if some is None else some.unionByName(hit)
    return nodes.join(some.distinct(), key, "left_semi")


def _passes(texts: DataFrame, entities: DataFrame, run, kind: T.StructType) -> DataFrame:
    """Union of texts.mapInArrow(run(entities sent along)) over blocks of ENTITIES of the entities, spread by hash."""
    known = entities.where(F.coalesce("entity", F.lit("")) != "").select("entity").distinct()
    blocks, out = max(1, -(-known.count() // ENTITIES)), None
    for b in range(blocks):
        some = known.where(F.pmod(F.xxhash64("entity"), F.lit(blocks)) == b) if blocks > 1 else known
        sent = texts.sparkSession.sparkContext.broadcast([r["entity"] for r in some.collect()])  # some ENTITIES short strings
        part = texts.mapInArrow(run(sent), kind)
        out = part if out is None else out.unionByName(part)
    return out


def containing(texts: DataFrame, entities: DataFrame, text: str = "text") -> DataFrame:
    """texts with a column entity, once for each entity (column `entity`) that the text contains.

    An automaton over the entities reads each text once, so the work is the texts' length and what is found. ENTITIES of them go
    along at a time; more take further passes. Rows leave a task in batches of bounded bytes, however many entities a text has."""
    at = texts.columns.index(text)
    return _passes(texts, entities, lambda sent: _hits(sent, at), T.StructType([*texts.schema.fields, T.StructField("entity", T.StringType())]))


def first_containing(texts: DataFrame, entities: DataFrame, order: str, k: int, text: str = "text") -> DataFrame:
    """order, entity: the first k different values of `order` (nulls first) whose texts contain an entity. Texts stay where they are
    read, and a batch of them gives its first k of each entity."""
    at, by = texts.columns.index(text), texts.columns.index(order)
    kind = T.StructType([texts.schema[order], T.StructField("entity", T.StringType())])
    found = _passes(texts, entities, lambda sent: _first_hits(sent, at, by, k), kind).distinct()
    w = Window.partitionBy("entity").orderBy(order)
    return found.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= k).drop("_rank")


def _automaton(sent) -> ahocorasick.Automaton:
    automaton = ahocorasick.Automaton()
    for e in sent.value:
        automaton.add_word(e, e)
    if len(automaton):
        automaton.make_automaton()
    return automaton


def _hits(sent, column: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(sent)
        if not len(automaton):
            return
        for b in batches:
            each = b.nbytes // max(1, b.num_rows)
            rows, found, held = [], [], 0

            def out():
                return pa.RecordBatch.from_arrays([*b.take(pa.array(rows, pa.int64())).columns, pa.array(found, pa.string())], [*b.schema.names, "entity"])

            for k, text in enumerate(b.column(column)):
                body = text.as_py()
                for e in sorted({e for _, e in automaton.iter(body)} if body else ()):
                    rows.append(k)
                    found.append(e)
                    held += each + 4 * len(body) + len(e)
                    if held > BYTES:
                        yield out()
                        rows, found, held = [], [], 0
            if rows:
                yield out()

    return run


def _first_hits(sent, column: int, by: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = _automaton(sent)
        if not len(automaton):
            return
        for b in batches:
            texts, keys = b.column(column), b.column(by)
            first, rows, found = {}, [], []
            # an order that Arrow and Spark might see differently is left to Spark
            whole = pa.types.is_floating(keys.type) or pa.types.is_nested(keys.type)
            for i in range(b.num_rows) if whole else pc.sort_indices(keys, null_placement="at_start").to_pylist():
                body, key = texts[i].as_py(), None if whole else keys[i].as_py()
                for e in {e for _, e in automaton.iter(body)} if body else ():
                    seen = first.setdefault(e, [0, first])  # different keys so far, the last of them (none yet: no key)
                    if whole or (seen[0] < k and key != seen[1]):
                        seen[:] = seen[0] + 1, key
                        rows.append(i)
                        found.append(e)
            if rows:
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(rows, pa.int64())), pa.array(found, pa.string())], [b.schema.names[by], "entity"])

    return run


def article_graph(articles: DataFrame, most_refs: int = 10) -> tuple[DataFrame, DataFrame]:
    """articles: seq, id, law, title, content. Nodes (key, law, content cut at 3000, title; of one key the last stays), and
    edges (src, dst, rel) to the first document numbers of a content."""
    key = F.when(F.coalesce(F.col("law"), F.lit("")) != "", F.concat_ws("_", "id", "law")).otherwise(F.col("id"))
    x = articles.where(F.coalesce(F.col("id"), F.lit("")) != "").withColumn("key", key)
    nodes = x.groupBy("key").agg(F.max_by(F.struct("law", F.substring("content", 1, 3000).alias("content"), "title"), "seq").alias("x")).select("key", "x.*")
    refs = F.slice(F.regexp_extract_all("content", F.lit(N.DOC_NUMBER), F.lit(1)), 1, most_refs)
    edges = x.select(F.col("key").alias("src"), F.explode(refs).alias("ref")).select("src", F.concat(F.lit("*_"), "ref").alias("dst"), F.lit("cites").alias("rel")).distinct()
    return nodes, edges


def groups_of(df: DataFrame, key: str, least: int = 2) -> DataFrame:
    """key, n: groups of at least so many rows."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def split_profile(df: DataFrame, split: str, law: str, route: str, hop: str) -> DataFrame:
    """Per split: rows, different laws, rows by hop of one and of more, and the commonest route (ties by name)."""
    by = df.groupBy(split, route).agg(F.count(F.lit(1)).alias("k")).groupBy(split).agg(F.min_by(route, F.struct(-F.col("k"), F.col(route))).alias("top_route"))
    out = df.groupBy(split).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(law).alias("laws"), F.count_if(F.col(hop) <= 1).alias("single_hop"), F.count_if(F.col(hop) > 1).alias("multi_hop"))
    return out.join(by, split)


def targets(df: DataFrame, label: str = "routing_label") -> DataFrame:
    """One row: how many graph and hybrid questions are to be made, and the calls for them, from the labels there are."""
    n = df.agg(*(F.count_if(F.col(label) == x).alias(a) for x, a in ((DENSE, "a"), (GRAPH, "b"), (HYBRID, "c"))))
    n = n.select((F.greatest(F.lit(250), F.floor(F.col("a") * 0.35)) - F.col("b")).cast("long").alias("target_graph"), (F.greatest(F.lit(200), F.floor(F.col("a") * 0.30)) - F.col("c")).cast("long").alias("target_hybrid"))
    return n.select("*", F.greatest(F.lit(1), F.floor((F.col("target_graph") + 1) / 2)).cast("long").alias("calls_graph"), F.greatest(F.lit(1), "target_hybrid").cast("long").alias("calls_hybrid"))


def next_page(df: DataFrame, done: str, order: str, size: int) -> DataFrame:
    """The next rows that aren't processed, by id."""
    return df.where(F.col(done).isNull()).orderBy(order).limit(size)


def best_of(df: DataFrame, config: str, metrics: list[str]) -> DataFrame:
    """metric, best (the config of the greatest value, ties by name), greatest, least."""
    long = df.select(config, F.explode(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics))).alias("x")).select(config, "x.*")
    return long.groupBy("metric").agg(F.min_by(config, F.struct(-F.col("value"), F.col(config))).alias("best"), F.max("value").alias("greatest"), F.min("value").alias("least"))


def add_columns(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """A table's missing columns as nulls of their types; those that are there stay as they are."""
    return df.withColumns({c: F.lit(None).cast(kind) for c, kind in columns.items() if c not in df.columns})


def source_summary(df: DataFrame, source: str, order: str, title: str, samples: int = 3) -> DataFrame:
    """source, n, samples: a count and the first titles of each source. The rank's limit is pushed before the shuffle, so
    a large source sends few rows of each task."""
    rank = F.row_number().over(Window.partitionBy(source).orderBy(order, title))
    first = df.select(source, order, title).withColumn("_rank", rank).where(F.col("_rank") <= samples).groupBy(source).agg(F.transform(F.sort_array(F.collect_list(F.struct("_rank", title))), lambda x: x[title]).alias("samples"))
    return df.groupBy(source).agg(F.count(F.lit(1)).alias("n")).join(first, source)
