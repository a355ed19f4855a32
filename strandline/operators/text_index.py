"""A full-text index on disk: postings in blocks with upper bounds, searched without scoring what can't reach the top k.

Documents are dealt by length over ranges of some RANGE neighbours. A block holds one term's postings in one range, and the most
that any of them adds to a BM25 score (without the term's idf). A search first reads only the blocks' headers: the bounds of a
query's terms add up, range by range, to the most that a document there can score. The SEEDS best ranges are scored; the k-th score
found is the threshold. In each range, the terms of smallest bounds whose sum stays below it can't bring a document there by
themselves: only the blocks of the other terms are opened, the documents found whose score could still reach the threshold are
kept, and the remaining terms are looked up for these alone. Bounds are never below the scores, so the rows are those of
search.bm25.

Little is moved or kept: a build deals each posting once, gathered by term where the texts are read; a search deals blocks by range,
once however many queries ask for them, and a query's ranges are kept with the least bound that is opened, not with their terms.

Postings are partitioned by a hash of the term: a search reads the folders of its terms. Document frequencies come from the
headers, so they count all documents, as do the number of documents and their mean length."""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.operators import search
from strandline.sources import storage

#: Documents of a range, about; folders of postings; ranges that are scored first for each query.
RANGE, SHARDS, SEEDS = 64, 32, 4
#: Score that rounding may lose; ranges this close below the threshold are scored.
SLACK = 1e-6
#: Query terms (some 50 bytes each) and ranges that are broadcast; more are joined by shuffle.
BROADCAST_TERMS = 500_000
#: Tokens that are gathered at a time; tokens, or postings scored for a query, of a task.
GATHER, TASK = 1_000_000, 1_000_000
#: Parts of a folder of a small table; a large one has more, so that a common term's postings are dealt over tasks.
PARTS = 4


def shard(term: Column) -> Column:
    return F.pmod(F.crc32(term.cast("binary")), F.lit(SHARDS)).cast("int")


@contextmanager
def _by_range(spark: SparkSession):
    """What runs inside joins rows of a query and range where both sides are dealt by range, without dealing them again."""
    name = "spark.sql.requireAllClusterKeysForCoPartition"
    before = spark.conf.get(name)
    spark.conf.set(name, "false")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _near(df: DataFrame) -> DataFrame:
    """df, marked for a broadcast if it is small enough."""
    return F.broadcast(df) if df.count() <= BROADCAST_TERMS else df


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc, len, range, part, ts: the postings of some GATHER tokens at a time, a row for each part of a folder, in order of terms."""
    lists = ["term", "doc", "range", "len", "tf"]
    for b in batches:
        ends, lo = pc.cumulative_sum(pc.cast(b.column("len"), pa.int64())).to_numpy(), 0
        while lo < b.num_rows:
            hi = max(lo + 1, int(ends.searchsorted((ends[lo - 1] if lo else 0) + GATHER, "right")))
            some, lo = b.slice(lo, hi - lo), hi
            ts = some.column("ts")
            terms = pc.list_flatten(ts).dictionary_encode()
            folder = pa.array([zlib.crc32(x.encode()) % SHARDS for x in terms.dictionary.to_pylist()], pa.int32())
            t = pa.table({"row": pc.list_parent_indices(ts), "at": terms.indices}).group_by(["row", "at"], use_threads=False).aggregate([([], "count_all")]).combine_chunks()
            row, at = t["row"].combine_chunks(), t["at"].combine_chunks()
            part = pc.add(pc.multiply(some.column("part").take(row), pa.scalar(SHARDS, pa.int32())), folder.take(at))
            x = pa.table({"part": part, "at": at, "tf": pc.cast(t["count_all"], pa.int32()), "row": row}).sort_by([("part", "ascending"), ("at", "ascending")])
            x = pa.table({"part": x["part"], "term": terms.dictionary.take(x["at"]), "tf": x["tf"], **{c: some.column(c).take(x["row"].combine_chunks()) for c in ("doc", "range", "len")}})
            x = x.group_by("part", use_threads=False).aggregate([(c, "list") for c in lists])
            yield from x.select(["part", *(f"{c}_list" for c in lists)]).rename_columns(["part", *lists]).to_batches()


class TextIndex:
    """An index at a path; build() and the constructor give one."""

    def __init__(self, spark: SparkSession, path: str, k1: float = 1.2, b: float = 0.75):
        self.spark, self.path, self.k1, self.b = spark, path.rstrip("/"), k1, b
        s = spark.read.parquet(f"{self.path}/stats").first()
        self.n, self.mean, self._kind = s["n"], s["mean"] or 1.0, T.StructType.fromJson(json.loads(s["blocks"]))

    @classmethod
    def build(cls, docs: DataFrame, path: str, doc_id: str, columns: list[str], k1: float = 1.2, b: float = 0.75) -> TextIndex:
        """Writes a new index over whatever is at the path; several columns are read as one text."""
        spark = docs.sparkSession
        text = F.concat_ws(" ", *columns) if len(columns) > 1 else F.coalesce(F.col(columns[0]), F.lit(""))
        t = docs.select(F.col(doc_id).alias("doc"), search.tokens(text).alias("ts")).withColumn("len", F.size("ts"))
        sizes = storage.cut(t.groupBy("len").agg(F.count(F.lit(1)).alias("n")), "sizes")  # a row a length
        field = T.StructField("doc", t.schema["doc"].dataType)
        posting = T.ArrayType(T.StructType([field, T.StructField("tf", T.IntegerType()), T.StructField("len", T.IntegerType())]))
        kind = T.StructType([T.StructField("term", T.StringType()), T.StructField("range", T.LongType()), T.StructField("df", T.IntegerType()), T.StructField("bound", T.DoubleType()), T.StructField("postings", posting), T.StructField("shard", T.IntegerType())])
        tokens = F.sum(F.col("len") * F.col("n"))
        stats = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), (tokens / F.sum("n")).alias("mean"), F.coalesce(tokens, F.lit(0)).alias("tokens")).withColumn("blocks", F.lit(kind.json()))
        stats.coalesce(1).write.mode("overwrite").parquet(f"{path}/stats")
        index = cls(spark, path, k1, b)
        many = spark.read.parquet(f"{path}/stats").first()["tokens"] // TASK
        parts = max(PARTS, many // SHARDS)
        # neighbours in length share a range: bounds are close to the scores. Those of one length are dealt by hash, so that no text moves
        before = F.sum("n").over(Window.orderBy("len")) - F.col("n")
        lengths = _near(storage.cut(sizes.select("len", "n", before.alias("before")), "lengths"))
        place = F.col("before") + F.pmod(F.xxhash64("doc"), F.col("n"))
        ranged = t.join(lengths, "len").select("doc", "len", F.shiftright(place, RANGE.bit_length() - 1).cast("int").alias("range"), "ts")
        lists = [("term", T.StringType()), ("doc", field.dataType), ("range", T.IntegerType()), ("len", T.IntegerType()), ("tf", T.IntegerType())]
        gathered = ranged.withColumn("part", F.pmod(F.xxhash64("range"), F.lit(parts)).cast("int")).mapInArrow(_gathered, T.StructType([T.StructField("part", T.IntegerType()), *(T.StructField(c, T.ArrayType(d)) for c, d in lists)]))
        dealt = gathered.repartition(int(min(parts * SHARDS, max(spark.sparkContext.defaultParallelism, many))), "part")
        rows = dealt.select("part", F.inline(F.arrays_zip(*(c for c, _ in lists)))).withColumn("range", F.col("range").cast("long"))
        tf = rows.groupBy("part", "term", "range", "doc", "len").agg(F.sum("tf").cast("int").alias("tf"))
        blocks = tf.groupBy("part", "term", "range").agg(F.count(F.lit(1)).cast("int").alias("df"), F.max(index._gain(F.col("tf"), F.col("len"))).alias("bound"), F.collect_list(F.struct("doc", "tf", "len")).alias("postings"))
        blocks = blocks.select("term", "range", "df", "bound", "postings", (F.col("part") % SHARDS).alias("shard"))
        blocks.sortWithinPartitions("shard", "term", "range").write.mode("overwrite").partitionBy("shard").parquet(f"{path}/blocks")
        storage.tidy(spark)
        return index

    def _gain(self, tf: Column, length: Column) -> Column:
        """What a posting adds to a score, without the idf of its term."""
        return tf * (self.k1 + 1) / (tf + self.k1 * (1 - self.b + self.b * length / self.mean))

    def blocks(self) -> DataFrame:
        return self.spark.read.schema(self._kind).parquet(f"{self.path}/blocks")

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        """queries: query_id, query. The k best documents of each query: query_id, doc, score, rank; ties by document."""
        terms = queries.select("query_id", F.explode(F.array_distinct(search.tokens(F.col("query")))).alias("term"))
        return self.search_terms(terms, k)

    def search_terms(self, terms: DataFrame, k: int) -> DataFrame:
        """terms: query_id, term, each once."""
        known, _, docs, n = self._survivors(terms, k)
        with _by_range(self.spark):
            return storage.cut(self._top(self._opened(known, docs, n), k), "found")

    def _survivors(self, terms: DataFrame, k: int) -> tuple[DataFrame, DataFrame, DataFrame, int]:
        """The terms with their idf; query_id, range, the least bound of the blocks that were opened; query_id, range, docs that can be
        among the k best; partitions that ranges are dealt over."""
        asked = terms.withColumn("shard", shard(F.col("term")))
        wanted = storage.cut(asked.select("shard", "term").distinct(), "terms")
        heads = storage.cut(self._of_terms(wanted).select("term", "range", "df", "bound"), "heads")
        df = heads.groupBy("term").agg(F.sum("df").alias("df"))
        known = storage.cut(asked.join(df, "term").select("query_id", "shard", "term", "df", F.log(1 + (F.lit(self.n) - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf")), "known")
        n = max(self.spark.sparkContext.defaultParallelism, (known.agg(F.sum("df")).first()[0] or 0) // TASK)
        # dealt by range, what belongs to a query and range needs no further shuffle
        bounds = heads.repartition(n, "range").join(_near(known), "term").select("query_id", "range", (F.col("idf") * F.col("bound")).alias("bound"))
        best = Window.partitionBy("query_id").orderBy(F.desc("most"), "range")
        seeds = bounds.groupBy("query_id", "range").agg(F.sum("bound").alias("most")).withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= SEEDS)
        seeds = storage.cut(seeds.select("query_id", "range", F.lit(0.0).alias("from")), "seeds")
        storage.tidy(self.spark)
        with _by_range(self.spark):
            reached = _near(storage.cut(self._top(self._opened(known, seeds, n), k).where(F.col("rank") == k).select("query_id", (F.col("score") - SLACK).alias("least")), "reached"))
        # terms whose bounds, the smaller ones first, together stay below the threshold are weak
        least, none = F.coalesce(F.col("least"), F.lit(0.0)), F.lit(None).cast("double")
        start = F.struct(F.lit(0.0).alias("most"), F.lit(0.0).alias("weak_sum"), none.alias("from"))

        def add(s: Column, x: Column) -> Column:
            most = s["most"] + x
            weak = most < least
            return F.struct(most.alias("most"), F.when(weak, most).otherwise(s["weak_sum"]).alias("weak_sum"), F.when(weak, none).otherwise(F.coalesce(s["from"], x)).alias("from"))

        left = bounds.groupBy("query_id", "range").agg(F.array_sort(F.collect_list("bound")).alias("bounds")).join(reached, "query_id", "left")
        left = left.select("query_id", "range", "least", F.aggregate("bounds", start, add).alias("s")).select("query_id", "range", "least", "s.weak_sum", "s.from").where("from is not null")
        left = storage.cut(left, "ranges")
        storage.tidy(self.spark)
        partial = self._opened(known, left, n).groupBy("query_id", "range", "doc").agg(F.sum("gain").alias("score"), F.max("least").alias("least"), F.max("weak_sum").alias("weak_sum"))
        close = partial.where(F.col("least").isNull() | (F.col("score") + F.col("weak_sum") >= F.col("least")))
        docs = close.groupBy("query_id", "range").agg(F.collect_list(F.struct("doc")).alias("docs"), F.lit(0.0).alias("from"))
        with _by_range(self.spark):
            docs = storage.cut(docs, "docs")
        storage.tidy(self.spark)
        return known, left, docs, n

    def _of_terms(self, wanted: DataFrame) -> DataFrame:
        """The blocks of these terms (shard, term), from their folders alone."""
        shards = [r["shard"] for r in wanted.select("shard").distinct().collect()]  # SHARDS of them at most
        return self.blocks().where(F.col("shard").isin(shards)).join(_near(wanted), ["shard", "term"], "left_semi")

    def _opened(self, known: DataFrame, ranges: DataFrame, n: int) -> DataFrame:
        """query_id, range, doc, gain of the postings in the blocks of (query_id, range) whose bounds are `from` or more, of `docs` alone
        where ranges have them; with the other columns of ranges."""
        blocks = self._of_terms(known.select("shard", "term").distinct())
        if "docs" in ranges.columns:  # other documents' postings stay where they are
            every = _near(storage.cut(ranges.groupBy("range").agg(F.array_distinct(F.flatten(F.collect_list("docs"))).alias("every")), "every"))
            blocks = blocks.join(every, "range").withColumn("postings", F.filter("postings", lambda p: F.array_contains("every", F.struct(p["doc"])))).where(F.size("postings") > 0)
        else:
            blocks = blocks.join(_near(ranges.select("range").distinct()), "range", "left_semi")
        dealt = blocks.select("term", "range", "bound", "postings.doc", "postings.tf", "postings.len").repartition(n, "range")
        pairs = dealt.join(_near(known.select("query_id", "term", "idf")), "term")
        found = pairs.join(ranges.repartition(n, "range").hint("shuffle_hash"), ["query_id", "range"]).where(F.col("idf") * F.col("bound") >= F.col("from"))
        more = [c for c in ranges.columns if c not in ("query_id", "range", "from", "docs")]
        postings = F.arrays_zip("doc", "tf", "len")
        postings = F.filter(postings, lambda p: F.array_contains("docs", F.struct(p["doc"]))) if "docs" in ranges.columns else postings
        rows = found.select("query_id", "range", "idf", *more, F.inline(postings))
        return rows.select("query_id", "range", "doc", *more, (F.col("idf") * self._gain(F.col("tf"), F.col("len"))).alias("gain"))

    def _top(self, scored: DataFrame, k: int) -> DataFrame:
        s = scored.groupBy("query_id", "doc").agg(F.round(F.sum("gain"), 9).alias("score"))
        w = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc")
        return s.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)

    def opened(self, queries: DataFrame, k: int) -> tuple[int, int]:
        """Postings that a search scores, and postings of its terms in all."""
        terms = queries.select("query_id", F.explode(F.array_distinct(search.tokens(F.col("query")))).alias("term"))
        known, ranges, docs, n = self._survivors(terms, k)
        return self._opened(known, ranges, n).count() + self._opened(known, docs, n).count(), known.agg(F.sum("df")).first()[0] or 0


#: Words too general to search for by themselves.
GENERIC = ("hiệu", "lực", "trách", "nhiệm", "thẩm", "quyền", "quyết", "hành", "chính", "pháp", "luật", "ngày", "tháng", "năm", "trước", "sau")
#: Terms at most, weight from which a word counts as a phrase, letters of a word that fills up.
MOST_TERMS, HEAVY, LETTERS = 8, 3.0, 4


def select_terms(terms: Column, most: int = MOST_TERMS, generic: tuple[str, ...] = GENERIC) -> Column:
    """Texts of an array of (text, weight): heavy ones and phrases in their order, then, while there is room, other words of four
    letters or more that aren't generic and aren't there yet."""
    trimmed = F.transform(terms, lambda t: F.struct(F.trim(t["text"]).alias("text"), t["weight"].alias("weight")))
    named = F.filter(trimmed, lambda t: F.coalesce(F.length(t["text"]), F.lit(0)) > 0)
    strong = lambda t: (F.coalesce(t["weight"], F.lit(1.0)) >= HEAVY) | F.contains(t["text"], F.lit(" "))
    first = F.transform(F.filter(named, strong), lambda t: t["text"])
    rest = F.transform(F.filter(named, lambda t: ~strong(t) & (F.length(t["text"]) >= LETTERS) & ~t["text"].isin(*generic)), lambda t: t["text"])
    return F.slice(F.concat(first, F.array_except(rest, first)), 1, most)


def candidates(queries: DataFrame, k: int, *indexes: tuple[str, TextIndex, int]) -> DataFrame:
    """queries: query_id, query. Union of searches, each of (label, index, times) with max(k, k * times) rows, every document with its best
    score: query_id, doc, score, label (of the best score, the earlier index at equal scores)."""
    out = None
    for at, (label, index, times) in enumerate(indexes):
        s = index.search(queries, max(k, k * times)).select("query_id", "doc", "score", F.lit(label).alias("label"), F.lit(-at).alias("_at"))
        out = s if out is None else out.unionByName(s)
    best = F.max(F.struct("score", "_at", "label"))
    return out.groupBy("query_id", "doc").agg(best.alias("b")).select("query_id", "doc", "b.score", "b.label")
