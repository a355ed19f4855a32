"""Written stores: SQLite files, sessions merged batch by batch, files taken in once, deletes that touch few buckets."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandline.operators import sessions
from strandline.plans import graph_queries, session_queries
from strandline.plans.registry import query, table
from strandline.sources import sqlite, storage
from strandline.sources.buckets import BucketTable
from strandline.streaming import store


@query(
    "sqlite_scan",
    "SELECT conv_id, count(*) AS n, max(length(text)) AS longest, min(turn) AS first FROM conversations WHERE role = 'user' AND turn >= 2 GROUP BY conv_id",
)
def sqlite_scan(spark, sf_dir):
    """Turns written as SQLite files and read back in ranges of row ids; both conditions go into the files' own queries."""
    sqlite.register(spark)
    path = storage.scratch(spark, "sqlite")
    table(spark, sf_dir, "conversations").write.format("sqlite").option("table", "turns").mode("overwrite").save(path)
    turns = spark.read.format("sqlite").option("table", "turns").option("rows", 500).load(path)
    found = turns.where("role = 'user' and turn >= 2")
    return found.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.max(F.length("text")).alias("longest"), F.min("turn").alias("first"))


def _turns(spark, sf_dir):
    x = sessions.exchanges(table(spark, sf_dir, "conversations"))
    user = F.when(F.col("conv_id") % 3 == 0, "default").otherwise(F.concat(F.lit("u"), F.col("conv_id") % 3))
    return x.select(
        F.col("conv_id").cast("string").alias("session_id"), user.alias("username"), F.col("turn").alias("turn_id"), F.coalesce("query", F.lit("")).alias("query"), F.coalesce("response", F.lit("")).alias("response"),
        F.lit("hybrid_reasoning").alias("route"), F.col("turn").cast("double").alias("ts"), F.lit(0.0).alias("latency_ms"), F.lit(0.0).alias("router_latency_ms"),
    )


_S = f"""WITH {session_queries._X}, u AS (SELECT conv_id::VARCHAR AS session_id, conv_id % 3 AS third, turn, coalesce(query, '') AS query FROM t),
s AS (SELECT session_id, third, arg_min(query, (turn // 2 % 3) * 100000 + turn) AS q, arg_min(turn, (turn // 2 % 3) * 100000 + turn)::DOUBLE AS created_at, max(turn)::DOUBLE AS updated_at, count(*) AS turns FROM u GROUP BY ALL)"""


def _stored(spark, sf_dir) -> store.SessionStore:
    """Three batches of turns, each given twice."""
    out, turns = store.SessionStore(spark, storage.scratch(spark, "sessions")), _turns(spark, sf_dir)
    for batch in (0, 1, 1, 0, 2, 2):
        out.add_turns(turns.where(F.expr("turn_id div 2 % 3") == batch), "turns", batch)
    return out


@query(
    "session_store_merge",
    f"""{_S} SELECT session_id, CASE WHEN length(q) > 50 THEN substr(q, 1, 50) || '...' ELSE q END AS title, created_at, updated_at,
  CASE WHEN third = 0 THEN 'default' ELSE 'u' || third END AS username, turns FROM s""",
)
def session_store_merge(spark, sf_dir):
    """The first turn that comes opens a session, the latest moves it, replayed batches change nothing."""
    s = _stored(spark, sf_dir)
    return s.sessions().join(s.turns().groupBy("session_id").agg(F.count(F.lit(1)).alias("turns")), "session_id").select("session_id", "title", "created_at", "updated_at", "username", "turns")


@query(
    "session_store_delete",
    f"""{_S}, k AS (SELECT *, session_id::BIGINT % 4 AS fourth FROM s) SELECT session_id, CASE WHEN fourth = 2 THEN least(turns, 1) ELSE turns END AS turns FROM k WHERE NOT fourth = 0""",
)
def session_store_delete(spark, sf_dir):
    """A quarter is cleared by its users, a quarter by another user (nothing happens), a quarter is cut to its first turn."""
    s = _stored(spark, sf_dir)
    fourth = F.col("session_id").cast("long") % 4
    s.clear(s.sessions().where(fourth == 0))
    s.clear(s.sessions().where(fourth == 1).withColumn("username", F.lit("another")))
    s.truncate(s.sessions().where(fourth == 2), 1)
    return s.turns().groupBy("session_id").agg(F.count(F.lit(1)).alias("turns"))


@query("ingest_incremental", "SELECT event_type, count(*) AS n, count(DISTINCT event_id) AS ids, round(sum(value), 4) AS total FROM events GROUP BY event_type")
def ingest_incremental(spark, sf_dir):
    """Files taken in by two runs of a stream over one checkpoint; the second sees new files only."""
    events = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    inbox, checkpoint = storage.scratch(spark, "inbox"), storage.scratch(spark, "ingest")
    into = BucketTable(spark, storage.scratch(spark, "events"), events.schema, "user_id", 8)
    for part in (0, 1):
        events.where(F.pmod("event_id", F.lit(2)) == part).write.mode("append").parquet(inbox)
        files = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 4).parquet(inbox)
        store.ingest(files, into, checkpoint)
    return into.read().groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("event_id").alias("ids"), F.round(F.sum("value"), 4).alias("total"))


@query(
    "graph_delete_label",
    f"""WITH {graph_queries._N}, {graph_queries._E}, k AS (SELECT * FROM n WHERE NOT list_contains(labels, 'Nation')), l AS (SELECT * FROM e WHERE src IN (SELECT id FROM k) AND dst IN (SELECT id FROM k))
SELECT 'nodes' AS kind, count(*) AS n FROM k UNION ALL SELECT 'edges', count(*) FROM l UNION ALL SELECT 'deleted', count(*) FROM n WHERE list_contains(labels, 'Nation')""",
)
def graph_delete_label(spark, sf_dir):
    """All nodes of a label go with their edges; buckets without one aren't written."""
    n, e = graph_queries.nodes(spark, sf_dir), graph_queries.edges(spark, sf_dir)
    nodes, edges = BucketTable(spark, storage.scratch(spark, "nodes"), n.schema, "id"), BucketTable(spark, storage.scratch(spark, "edges"), e.schema, "src")
    nodes.append(n)
    edges.append(e)
    gone = store.delete_label(nodes, edges, "Nation")
    count = lambda kind, df: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "n")
    return count("nodes", nodes.read()).unionByName(count("edges", edges.read())).unionByName(spark.range(1).select(F.lit("deleted").alias("kind"), F.lit(gone).cast("long").alias("n")))
