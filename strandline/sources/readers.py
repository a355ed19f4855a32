"""Sources: JSON arrays and lines, folders, Parquet, CSV, query lists, script variables, HTML pages, multi-hop corpora.

Readers take explicit schemas; a line that can't be parsed is kept aside, dropped or fatal, as the caller says."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ARTICLE = T.ArrayType(T.StructType().add("number", "string").add("title", "string").add("note", "string").add("body", "string"))
#: Classes that mark the parts of an article.
ARTICLE_START, ARTICLE_NOTE, ARTICLE_BODY = "pDieu", "pGhiChu", ("pNoiDung", "pDan", "pItem")
ARTICLE_NUMBER = re.compile(r"Điều\s+([\d\.]+a?)", re.IGNORECASE)


def json_array(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A file that is one JSON array."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def json_lines(spark: SparkSession, path: str, schema: T.StructType, bad: str = "keep") -> DataFrame:
    """JSON lines; blank lines don't count. bad: `keep` adds _corrupt_record, `drop` leaves bad lines out, `fail` raises."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    mode = {"keep": "PERMISSIVE", "drop": "PERMISSIVE", "fail": "FAILFAST"}[bad]
    full = T.StructType([*schema.fields, T.StructField("_corrupt_record", T.StringType())]) if bad != "fail" else schema
    x = lines.select(F.from_json("value", full, {"mode": mode, "columnNameOfCorruptRecord": "_corrupt_record"}).alias("r")).select("r.*")
    return x.where("_corrupt_record is null").drop("_corrupt_record") if bad == "drop" else x


def json_folder(spark: SparkSession, path: str, schema: T.StructType, doc_id: str = "doc_id") -> DataFrame:
    """A folder of JSON files; a record without an id is named after its file."""
    x = spark.read.schema(schema).option("multiLine", True).json(path).withColumn("_file", F.col("_metadata.file_name"))
    stem = F.regexp_replace("_file", r"\.json$", "")
    return x.withColumn(doc_id, F.coalesce(F.col(doc_id).cast("string"), stem)).drop("_file")


def parquet(spark: SparkSession, path: str, max_rows: int | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df.limit(max_rows) if max_rows is not None else df


def csv(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    r = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    return (r.schema(schema) if schema else r).csv(path)


def query_list(spark: SparkSession, path: str) -> DataFrame:
    """One query a line, without blanks."""
    return spark.read.text(path).select(F.trim("value").alias("query")).where("query <> ''")


def first_existing(spark: SparkSession, *paths: str) -> str:
    """The first path that is there, in any store that Spark reads."""
    jvm = spark.sparkContext._jvm
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
            return p
    raise FileNotFoundError(", ".join(paths))


def _balanced(text: str, name: str) -> str | None:
    m = re.search(rf"\bvar\s+{re.escape(name)}\s*=\s*(?=[\[{{])", text)
    if not m:
        return None
    opening = text[m.end()]
    closing = {"[": "]", "{": "}"}[opening]
    # strings are skipped as a whole, escapes in them included
    depth = 0
    for token in re.finditer(r'"(?:\\.|[^"\\])*"|\'(?:\\.|[^\'\\])*\'|[\[\]{}]', text[m.end() :], re.S):
        if token[0] == opening:
            depth += 1
        elif token[0] == closing:
            depth -= 1
            if not depth:
                return text[m.end() : m.end() + token.end()]
    return "[]"


def script_variable(name: str):
    """A column function: the array or object that a script assigns to a variable, as JSON without trailing commas; null
    if it isn't assigned, `[]` if it never ends."""

    @F.pandas_udf("string")
    def extract(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield s.map(lambda t: _balanced(t, name) if t is not None else None)

    return lambda c: F.regexp_replace(extract(c), r",\s*([}\]])", "$1")


class _Segmenter(HTMLParser):
    """Text by element, with classes; an element's text is that of all within it, parts parted by one space."""

    VOID = {"br", "img", "hr", "input", "meta", "link", "area", "base", "col", "embed", "source", "track", "wbr"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: list[dict] = []
        self.found: list[dict] = []

    def handle_starttag(self, tag, attrs):
        node = {"tag": tag, "cls": dict(attrs).get("class") or "", "parts": []}
        self.found.append(node)
        if tag not in self.VOID:
            self.open.append(node)

    def handle_endtag(self, tag):
        for k in range(len(self.open) - 1, -1, -1):
            if self.open[k]["tag"] == tag:
                del self.open[k:]
                return

    def handle_data(self, data):
        t = data.strip()
        if t:
            for node in self.open:
                node["parts"].append(t)


def articles(html: str | None, start: str = ARTICLE_START, note: str = ARTICLE_NOTE, body: tuple = ARTICLE_BODY) -> list[dict]:
    """The articles of a page: an element of class `start` begins one, others of class `note` and `body` fill it."""
    p = _Segmenter()
    p.feed(html or "")
    p.close()
    out: list[dict] = []
    for node in p.found:
        t = " ".join(node["parts"])
        if start in node["cls"]:
            m = ARTICLE_NUMBER.search(t)
            out.append({"number": m[1] if m else "", "title": t, "note": "", "body": []})
        elif out and t and note in node["cls"]:
            out[-1]["note"] = t.strip("()")
        elif out and t and any(b in node["cls"] for b in body):
            out[-1]["body"].append(t)
    return [x | {"body": "\n".join(x["body"])} for x in out]


@F.pandas_udf(ARTICLE)
def _articles(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in parts:
        yield s.map(articles)


def html_articles(df: DataFrame, column: str = "html") -> DataFrame:
    """df exploded to its pages' articles: pos, number, title, note, body."""
    rest = [c for c in df.columns if c != column]
    return df.select(*rest, F.posexplode(_articles(F.col(column))).alias("pos", "a")).select(*rest, "pos", "a.*")


@F.pandas_udf(T.ArrayType(T.StructType().add("tag", "string").add("text", "string")))
def _elements(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in parts:
        out = []
        for html in s:
            p = _Segmenter()
            p.feed(html or "")
            p.close()
            out.append([{"tag": n["tag"], "text": " ".join(n["parts"])} for n in p.found if n["parts"]])
        yield pd.Series(out)


def html_elements(df: DataFrame, column: str = "html", tags: tuple = ("title", "h1", "h2", "h3", "p", "li")) -> DataFrame:
    """df exploded to the text of its pages' elements of some tags: pos, tag, text."""
    rest = [c for c in df.columns if c != column]
    x = df.select(*rest, F.posexplode(_elements(F.col(column))).alias("pos", "e"))
    return x.where(F.col("e.tag").isin(*tags)).select(*rest, "pos", "e.*")


HOTPOT = T.StructType().add("_id", "string").add("question", "string").add("context", T.ArrayType(T.ArrayType(T.StringType()))).add("supporting_facts", T.ArrayType(T.ArrayType(T.StringType())))


def multi_hop_nodes(items: DataFrame) -> DataFrame:
    """Questions with context [[title, sentences as JSON], ...]: qid, title, content, and whether the title supports."""
    x = items.select(F.col("_id").alias("qid"), F.transform("supporting_facts", lambda f: f[0]).alias("facts"), F.explode("context").alias("c"))
    content = F.array_join(F.from_json(F.col("c")[1], "array<string>"), " ")
    return x.select("qid", F.col("c")[0].alias("title"), content.alias("content"), F.array_contains("facts", F.col("c")[0]).alias("supports"))


def multi_hop_corpus(lines: DataFrame, id_col: str = "id") -> DataFrame:
    """Lines with ids like `hotpot_<qid>_<i>`: adds qid, null where the id has fewer parts."""
    p = F.split(id_col, "_")
    return lines.withColumn("qid", F.when(F.size(p) >= 3, F.get(p, F.lit(1))))


def spread(df: DataFrame) -> DataFrame:
    """df over as many partitions as the cluster has cores, where its files give fewer: for work that costs more than moving the
    rows, on tables of few files. A large table has partitions enough and stays as it is."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df
