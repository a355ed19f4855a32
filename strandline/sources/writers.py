"""Sinks: checkpoints of steps, append-only logs, CSV of fixed columns, manifests, reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The columns of an evaluation sheet, in order.
EVALUATION = (
    "ID", "System", "Query", "Ground_Truth", "Generated_Answer", "Expected_Route", "Route", "Actual_Route", "KG_Source", "Sources", "Context_Chars",
    "Context_Preview", "Steps", "Stage2", "Stage2_Override", "Time_ms", "EM", "F1", "Acc",
)


def checkpoint(df: DataFrame, path: str, kind: str = "parquet") -> DataFrame:
    """Writes a step's result over what was there, and returns it as read back."""
    df.write.mode("overwrite").format(kind).save(path)
    r = df.sparkSession.read.schema(df.schema)
    return r.format(kind).load(path)


def append_log(df: DataFrame, path: str) -> None:
    df.write.mode("append").json(path)


def evaluation_csv(df: DataFrame, path: str) -> None:
    """The sheet's columns in their order; those that df lacks are empty."""
    cols = [F.col(c).cast("string").alias(c) if c in df.columns else F.lit("").alias(c) for c in EVALUATION]
    df.select(*cols).write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def training_csv(df: DataFrame, path: str, labels: list[str]) -> None:
    """query, label, label_idx, source."""
    idx = reduce(lambda w, kv: w.when(F.col("label") == kv[1], kv[0]), enumerate(labels[1:], 1), F.when(F.col("label") == labels[0], 0))
    df.select("query", "label", idx.alias("label_idx"), "source").write.mode("overwrite").option("header", True).csv(path)


def manifest(**tables: DataFrame) -> DataFrame:
    """One row: the number of rows of each table, as columns."""
    rows = [df.agg(F.count(F.lit(1)).alias(n)) for n, df in tables.items()]
    return reduce(lambda a, b: a.join(F.broadcast(b)), rows)  # one row each


def report(title: str, sections: dict[str, DataFrame], most: int = 50) -> str:
    """A Markdown report; each section shows at most `most` rows, which is what a reader wants."""
    out = [f"# {title}"]
    for name, df in sections.items():
        out += ["", f"## {name}", "", "| " + " | ".join(df.columns) + " |", "|" + " --- |" * len(df.columns)]
        out += ["| " + " | ".join(str(v) for v in row) + " |" for row in df.limit(most).collect()]
    return "\n".join(out) + "\n"
