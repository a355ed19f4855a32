"""Conversation sessions as tables: turns, last turns, histories, summaries, retention, and what events do to them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandline.functions import text


def exchanges(messages: DataFrame, session: str = "conv_id", turn: str = "turn") -> DataFrame:
    """Each user message with the assistant's answer that follows it, if one does: session, turn, query, response."""
    w = Window.partitionBy(session).orderBy(turn)
    x = messages.withColumn("_role", F.lead("role").over(w)).withColumn("_text", F.lead("text").over(w)).where("role = 'user'")
    return x.select(session, turn, F.col("text").alias("query"), F.when(F.col("_role") == "assistant", F.col("_text")).alias("response"))


def last_turns(turns: DataFrame, session: str, order: str, k: int = 5) -> DataFrame:
    """The last k turns of each session; pos counts them from the oldest."""
    w = Window.partitionBy(session)
    x = turns.withColumn("_n", F.row_number().over(w.orderBy(F.desc(order)))).where(F.col("_n") <= k)
    return x.withColumn("pos", F.row_number().over(w.orderBy(order))).drop("_n")


def history(turns: DataFrame, session: str, order: str, k: int = 5, cut: int = 300) -> DataFrame:
    """session, history: its last turns, numbered, answers cut."""
    line = F.concat(F.lit("Q"), F.col("pos"), F.lit(": "), F.col("query"), F.lit("\nA"), F.col("pos"), F.lit(": "), F.substring(F.coalesce("response", F.lit("")), 1, cut))
    x = last_turns(turns, session, order, k).groupBy(session).agg(F.array_sort(F.collect_list(F.struct("pos", line.alias("line")))).alias("ls"))
    return x.select(session, F.array_join(F.transform("ls", lambda s: s["line"]), "\n").alias("history"))


def summary(turns: DataFrame, session: str, order: str) -> DataFrame:
    """session, n, first, last, title: the first query, cut at 50 letters."""
    s = turns.groupBy(session).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first"), F.max(order).alias("last"), F.min_by("query", order).alias("_q"))
    return s.withColumn("title", text.session_title(F.col("_q"))).drop("_q")


def keep_first(turns: DataFrame, session: str, order: str, n: int) -> DataFrame:
    return turns.withColumn("_n", F.row_number().over(Window.partitionBy(session).orderBy(order))).where(F.col("_n") <= n).drop("_n")


def expire(turns: DataFrame, ts: str, now: Column, minutes: int = 30) -> DataFrame:
    return turns.where(F.col(ts) >= now - F.expr(f"interval {minutes} minutes"))


def gap_sessions(events: DataFrame, user: str, ts: str, minutes: int = 30) -> DataFrame:
    """Events of a user less than `minutes` apart form a session: user, start, end, n."""
    return events.groupBy(user, F.session_window(ts, f"{minutes} minutes").alias("w")).agg(F.count(F.lit(1)).alias("n")).select(user, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def latest_state(sessions: DataFrame, titles: DataFrame, deleted: DataFrame, session: str = "session_id") -> DataFrame:
    """Append-only events to the present table: the first insert of a session, its last title, without deleted ones."""
    first = sessions.groupBy(session).agg(F.min_by("title", "ts").alias("_t"), F.min("ts").alias("created_at"), F.max("ts").alias("_u"))
    last = titles.groupBy(session).agg(F.max_by("title", "ts").alias("_new"), F.max("ts").alias("_nu"))
    x = first.join(last, session, "left").join(deleted.select(session), session, "left_anti")
    return x.select(session, F.coalesce("_new", "_t").alias("title"), "created_at", F.greatest("_u", F.coalesce("_nu", F.col("_u"))).alias("updated_at"))


def last_referent(turns: DataFrame, session: str, order: str, pattern: str) -> DataFrame:
    """The first match of the latest turn that has one, its query before its response."""
    p = text.FLAGS + pattern
    hit = F.coalesce(F.nullif(F.regexp_extract("query", p, 0), F.lit("")), F.nullif(F.regexp_extract(F.coalesce("response", F.lit("")), p, 0), F.lit("")))
    return turns.withColumn("_h", hit).where("_h is not null").groupBy(session).agg(F.max_by("_h", order).alias("referent"))


def replace_pronouns(query: Column, referent: Column, pattern: str) -> Column:
    """Pronouns give way to the referent, taken literally; without a referent the query stays."""
    return F.when(referent.isNull(), query).otherwise(F.array_join(F.split(query, text.FLAGS + pattern), referent))
