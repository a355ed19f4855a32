"""Sessions and routing logs as streams. Watermarks bound the state; what a batch job does over tables, these do as
events arrive."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STATE = T.StructType().add("texts", T.ArrayType(T.StringType())).add("n", "long")
OUT = T.StructType().add("session", "string").add("n", "long").add("last_turns", T.ArrayType(T.StringType()))


def file_stream(spark: SparkSession, path: str, schema: T.StructType, kind: str = "parquet", per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).format(kind).load(path)


def gap_sessions(events: DataFrame, user: str, ts: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """user, start, end, n of each session that a pause of `gap` ends."""
    w = events.withWatermark(ts, late).groupBy(user, F.session_window(ts, gap).alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return w.select(user, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def window_counts(events: DataFrame, ts: str, key: str, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    w = events.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), key).agg(F.count(F.lit(1)).alias("n"))
    return w.select(F.col("w.start").alias("start"), key, "n")


def last_turns(turns: DataFrame, session: str, text: str, k: int = 5, idle_ms: int | None = 1_800_000) -> DataFrame:
    """session, n, last_turns after each batch; a session that is idle for idle_ms is forgotten, without it none is."""

    def update(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        kept, n = (list(state.get[0]), state.get[1]) if state.exists else ([], 0)
        for p in parts:
            n += len(p)
            kept = (kept + p[text].tolist())[-k:]
        state.update((kept, n))
        if idle_ms:
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame({"session": [str(key[0])], "n": [n], "last_turns": [kept]})

    return turns.groupBy(session).applyInPandasWithState(update, OUT, STATE, "update", GroupStateTimeout.ProcessingTimeTimeout if idle_ms else GroupStateTimeout.NoTimeout)


#: A routing log holds two kinds of records; those of the pipeline have an answer's length.
ROUTING_LOG = "timestamp string, query string, final_route string, pipeline_latency_ms double, answer_length long, stage1 struct<route:string,confidence:double>, stage2 struct<invoked:boolean,route:string>"


def split_log(log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Routing records, and pipeline records."""
    return log.where("answer_length is null"), log.where("answer_length is not null")
