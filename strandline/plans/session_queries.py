"""Sessions over conversations and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.operators import sessions
from strandline.plans.registry import query, table

_X = """x AS (SELECT conv_id, turn, role, text AS query, CASE WHEN lead(role) OVER w = 'assistant' THEN lead(text) OVER w END AS response FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
t AS (SELECT conv_id, turn, query, response FROM x WHERE role = 'user')"""


_TS = "yyyy-MM-dd HH:mm:ss.SSSSSS"


def _turns(spark, sf_dir):
    return sessions.exchanges(table(spark, sf_dir, "conversations"))


@query("session_last5", f"WITH {_X}, r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM t) SELECT conv_id, turn, query, response FROM r WHERE n <= 5")
def session_last5(spark, sf_dir):
    return sessions.last_turns(_turns(spark, sf_dir), "conv_id", "turn").drop("pos")


@query("session_summary", f"WITH {_X} SELECT conv_id, count(*) AS n, min(turn) AS first, max(turn) AS last, CASE WHEN length(arg_min(query, turn)) > 50 THEN substr(arg_min(query, turn), 1, 50) || '...' ELSE arg_min(query, turn) END AS title FROM t GROUP BY conv_id")
def session_summary(spark, sf_dir):
    return sessions.summary(_turns(spark, sf_dir), "conv_id", "turn")


@query(
    "history_string",
    f"""WITH {_X}, r AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM t), p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS pos FROM r WHERE n <= 5)
SELECT conv_id, string_agg('Q' || pos || ': ' || query || E'\\nA' || pos || ': ' || substr(coalesce(response, ''), 1, 300), E'\\n' ORDER BY pos) AS history FROM p GROUP BY conv_id""",
)
def history_string(spark, sf_dir):
    return sessions.history(_turns(spark, sf_dir), "conv_id", "turn")


@query("session_keep_first", "SELECT conv_id, turn, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations) WHERE n <= 2")
def session_keep_first(spark, sf_dir):
    return sessions.keep_first(table(spark, sf_dir, "conversations"), "conv_id", "turn", 2).select("conv_id", "turn", "role")


@query(
    "session_gap_30m",
    """WITH g AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w >= INTERVAL 30 MINUTE THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S.%f') AS started, count(*) AS n FROM s GROUP BY user_id, k""",
)
def session_gap_30m(spark, sf_dir):
    s = sessions.gap_sessions(table(spark, sf_dir, "events"), "user_id", "ts")
    return s.select("user_id", F.date_format("start", _TS).alias("started"), "n")


@query(
    "session_expire",
    "SELECT event_id, user_id FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 30 MINUTE",
)
def session_expire(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    now = e.agg(F.max("ts").alias("_now"))
    return sessions.expire(e.crossJoin(F.broadcast(now)), "ts", F.col("_now")).select("event_id", "user_id")  # _now is one row


@query(
    "session_state",
    """WITH s AS (SELECT user_id AS session_id, arg_min(event_type, (ts, event_id)) AS t, min(ts) AS c, max(ts) AS u FROM events WHERE event_type <> 'error' GROUP BY 1),
n AS (SELECT user_id AS session_id, arg_max('title ' || event_id, (ts, event_id)) AS t, max(ts) AS u FROM events WHERE event_type = 'purchase' GROUP BY 1)
SELECT s.session_id, coalesce(n.t, s.t) AS title, strftime(s.c, '%Y-%m-%d %H:%M:%S.%f') AS created_at, strftime(greatest(s.u, coalesce(n.u, s.u)), '%Y-%m-%d %H:%M:%S.%f') AS updated_at FROM s LEFT JOIN n USING (session_id) WHERE s.session_id NOT IN (SELECT user_id FROM events WHERE event_type = 'error' AND user_id % 3 = 0)""",
)
def session_state(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("order", F.struct("ts", "event_id"))
    s = e.where("event_type <> 'error'").select(F.col("user_id").alias("session_id"), F.col("event_type").alias("title"), F.col("order").alias("ts"))
    t = e.where("event_type = 'purchase'").select(F.col("user_id").alias("session_id"), F.concat(F.lit("title "), F.col("event_id")).alias("title"), F.col("order").alias("ts"))
    d = e.where("event_type = 'error' and user_id % 3 = 0").select(F.col("user_id").alias("session_id")).distinct()
    out = sessions.latest_state(s, t, d)
    return out.select("session_id", "title", F.date_format("created_at.ts", _TS).alias("created_at"), F.date_format("updated_at.ts", _TS).alias("updated_at"))


@query(
    "last_referent",
    rf"""WITH {_X}, h AS (SELECT conv_id, turn, coalesce(nullif(regexp_extract(query, '[a-z]+tion'), ''), nullif(regexp_extract(coalesce(response, ''), '[a-z]+tion'), '')) AS r FROM t) SELECT conv_id, arg_max(r, turn) AS referent FROM h WHERE r IS NOT NULL GROUP BY conv_id""",
)
def last_referent(spark, sf_dir):
    return sessions.last_referent(_turns(spark, sf_dir), "conv_id", "turn", "(?-iuU)[a-z]+tion")
