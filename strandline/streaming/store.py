"""A session store and incremental ingest over bucket tables.

Sessions and turns are rows of one table, so what a turn does to both is one commit: a session's first row wins, its
`updated_at` is the latest of its user's turns, and the turn is added."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandline.functions import text
from strandline.sources.buckets import BucketTable

#: kind is 'session' or 'turn'; a turn's id is its place in the order of arrival.
SCHEMA = "kind string, session_id string, username string, title string, created_at double, updated_at double, turn_id long, query string, response string, route string, ts double, latency_ms double, router_latency_ms double"
TURN = "session_id string, username string, turn_id long, query string, response string, route string, ts double, latency_ms double, router_latency_ms double"
_TURN = [c.split()[0] for c in TURN.split(", ")]


class SessionStore:
    def __init__(self, spark: SparkSession, path: str, buckets: int = 16):
        self.table = BucketTable(spark, path, SCHEMA, "session_id", buckets)

    def sessions(self) -> DataFrame:
        return self.table.read().where("kind = 'session'").select("session_id", "title", "created_at", "updated_at", "username")

    def turns(self) -> DataFrame:
        return self.table.read().where("kind = 'turn'").select(*_TURN)

    def add_turns(self, turns: DataFrame, stream: str = "", batch: int | None = None) -> bool:
        """turns: the columns of TURN. False if the stream's batch is in already."""
        if batch is not None and batch <= self.table.last_batch(stream):
            return False
        new = turns.select(*_TURN)

        def change(old: DataFrame) -> DataFrame:
            order = F.struct("ts", "turn_id")
            opened = new.groupBy("session_id").agg(F.min_by(F.struct("query", "ts", "username"), order).alias("f"))
            opened = opened.select("session_id", F.lit(1).alias("_new"), text.session_title(F.col("f.query")).alias("title"), F.col("f.ts").alias("created_at"), F.col("f.ts").alias("updated_at"), F.coalesce("f.username", F.lit("default")).alias("username"))
            known = old.where("kind = 'session'").select("session_id", F.lit(0).alias("_new"), "title", "created_at", "updated_at", "username")
            first = known.unionByName(opened).groupBy("session_id").agg(F.min_by(F.struct("title", "created_at", "updated_at", "username"), "_new").alias("s")).select("session_id", "s.*")
            # only a turn of the session's own user moves updated_at
            moved = new.groupBy("session_id", F.coalesce("username", F.lit("default")).alias("username")).agg(F.max("ts").alias("moved"))
            sessions = first.join(moved, ["session_id", "username"], "left").withColumn("updated_at", F.greatest("updated_at", F.coalesce("moved", F.col("updated_at")))).drop("moved").withColumn("kind", F.lit("session"))
            kept = old.where("kind = 'turn'")
            return kept.unionByName(new.withColumn("kind", F.lit("turn")), allowMissingColumns=True).unionByName(sessions, allowMissingColumns=True)

        return self.table.rewrite(self.table.touched(new), change, stream, batch)

    def clear(self, sessions: DataFrame) -> bool:
        """sessions: session_id, username. Those that belong to the user go, with their turns; others stay."""
        asked = sessions.select("session_id", F.coalesce("username", F.lit("default")).alias("username"))
        owned = self.sessions().select("session_id", F.coalesce("username", F.lit("default")).alias("username")).join(asked, ["session_id", "username"], "left_semi").select("session_id").distinct()
        return self.table.rewrite(self.table.touched(owned), lambda old: old.join(owned, "session_id", "left_anti"))

    def truncate(self, sessions: DataFrame, keep: int) -> bool:
        """sessions: session_id, username. Of each only the first turns stay. The default user may cut any session."""
        asked = sessions.select("session_id", F.coalesce("username", F.lit("default")).alias("username")).distinct()
        owned = self.sessions().select("session_id", F.coalesce("username", F.lit("default")).alias("username"))
        fits = asked.where("username = 'default'").select("session_id").unionByName(asked.join(owned, ["session_id", "username"], "left_semi").select("session_id")).distinct()

        def change(old: DataFrame) -> DataFrame:
            hit = old.where("kind = 'turn'").join(fits, "session_id", "left_semi")
            late = hit.withColumn("_n", F.row_number().over(Window.partitionBy("session_id").orderBy("turn_id"))).where(F.col("_n") > keep).select("session_id", "turn_id")
            return old.join(late, ["session_id", "turn_id"], "left_anti")

        return self.table.rewrite(self.table.touched(fits), change)

    def expire(self, before: float) -> bool:
        """Turns before a time go; sessions stay."""
        old = F.expr("kind = 'turn'") & (F.col("ts") < before)
        return self.table.rewrite(self.table.touched(self.table.read().where(old)), lambda df: df.where(~F.coalesce(old, F.lit(False))))

    def follow(self, turns: DataFrame, checkpoint: str, stream: str = "turns") -> None:
        """Takes a stream's turns that are there, batch by batch, and returns. A batch that was in when its run died is left out."""
        run_available(turns, checkpoint, lambda df, batch: self.add_turns(df, stream, batch))


def run_available(stream: DataFrame, checkpoint: str, f: Callable[[DataFrame, int], object]) -> None:
    """Calls f with each batch that is there, and waits for the end."""
    query = stream.writeStream.foreachBatch(lambda df, batch: f(df, batch) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def ingest(files: DataFrame, table: BucketTable, checkpoint: str, change: Callable[[DataFrame], DataFrame] = lambda df: df, stream: str = "files") -> None:
    """Adds the rows of files that were not taken in before. The checkpoint knows which files a batch has, and the table's log which
    batches are in: a second run reads new files only, and a run that dies loses and repeats nothing."""

    def take(df: DataFrame, batch: int) -> None:
        if batch > table.last_batch(stream):
            table.append(change(df), stream, batch)

    run_available(files, checkpoint, take)


def delete_label(nodes: BucketTable, edges: BucketTable, label: str) -> int:
    """Nodes that have the label go, with the edges at either end: the number of nodes. nodes: id, labels; edges: src, dst.
    Only buckets that hold one are written again; edges first, so that no edge is ever without its ends."""
    hit = F.array_contains("labels", label)
    gone = nodes.read().where(hit).select("id").distinct()
    n = gone.count()
    if n:
        loose = lambda df: df.join(gone, df["src"] == gone["id"], "left_semi").unionByName(df.join(gone, df["dst"] == gone["id"], "left_semi"))
        left = lambda df: df.join(gone.select(F.col("id").alias("src")), "src", "left_anti").join(gone.select(F.col("id").alias("dst")), "dst", "left_anti").select(df.columns)
        edges.rewrite(edges.touched(loose(edges.read())), left)
        nodes.rewrite(nodes.touched(gone), lambda df: df.where(~F.coalesce(hit, F.lit(False))))
    return n
