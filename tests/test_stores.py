"""SQLite files, bucket tables, the session store and incremental ingest: replays, runs that die, files that stay."""

import os
import sqlite3

import pytest
from pyspark.sql import functions as F

from strandline.sources import sqlite, storage
from strandline.sources.buckets import BucketTable
from strandline.streaming import store

TURNS = store.TURN


def turn(session, n, user="ann", query=None):
    return (session, user, n, query or f"question {n} of {session}", "answer", "graph_traversal", float(n), 1.0, 0.5)


def test_sqlite_store_of_three_tables(spark, tmp_path):
    path = str(tmp_path / "s.db")
    with sqlite3.connect(path) as c:
        c.execute("CREATE TABLE users (username TEXT PRIMARY KEY, password_hash TEXT NOT NULL, created_at REAL NOT NULL) WITHOUT ROWID")
        c.execute("CREATE TABLE sessions (session_id TEXT PRIMARY KEY, title TEXT NOT NULL, created_at REAL, updated_at REAL, username TEXT DEFAULT 'default')")
        c.execute("CREATE TABLE turns (id INTEGER PRIMARY KEY AUTOINCREMENT, session_id TEXT, query TEXT, latency_ms REAL, raw BLOB, odd INTEGER)")
        c.executemany("INSERT INTO users VALUES (?, ?, ?)", [("ann", "x", 1.0), ("bob", "y", 2.5)])
        c.executemany("INSERT INTO sessions VALUES (?, ?, ?, ?, ?)", [(f"s{i}", f"Điều {i}", i, i + 1, None if i % 2 else "ann") for i in range(7)])
        c.executemany("INSERT INTO turns (session_id, query, latency_ms, raw, odd) VALUES (?, ?, ?, ?, ?)", [(f"s{i % 7}", f"q{i}", i / 2, b"\x00\xff", i if i % 5 else "text") for i in range(250)])
        c.execute("DELETE FROM turns WHERE id BETWEEN 60 AND 90")
    sqlite.register(spark)
    read = lambda t, **o: spark.read.format("sqlite").options(table=t, **o).load(path)
    assert sorted(map(tuple, read("users").collect())) == [("ann", "x", 1.0), ("bob", "y", 2.5)]
    assert read("sessions").where("username is null").count() == 3 and read("sessions").where("title = 'Điều 4'").first().session_id == "s4"
    turns = read("turns", rows=40)
    assert turns.rdd.getNumPartitions() == 7 and turns.dtypes == [("id", "bigint"), ("session_id", "string"), ("query", "string"), ("latency_ms", "double"), ("raw", "binary"), ("odd", "bigint")]
    assert turns.count() == 219 and turns.where("odd is null").count() == len([i for i in range(250) if i % 5 == 0 and not 60 <= i + 1 <= 90])
    got = turns.where("id > 100 and session_id in ('s1', 's2') and latency_ms <= 90").select("id").collect()
    assert sorted(r.id for r in got) == [i + 1 for i in range(250) if i + 1 > 100 and i % 7 in (1, 2) and i / 2 <= 90]
    assert bytes(turns.first().raw) == b"\x00\xff"


def test_sqlite_filters_reach_the_file():
    from pyspark.sql.datasource import EqualTo, GreaterThan, Not

    r = sqlite.Reader("x", "t", 10, sqlite.T.StructType.fromDDL("a long, b string, c binary"))
    list(r.pushFilters([EqualTo(("b",), "u"), GreaterThan(("a",), 3), EqualTo(("c",), b"1"), Not(EqualTo(("a",), 1))]))
    assert r.where == ['"b" = ?', '"a" > ?'] and r.args == ["u", 3]


def test_sqlite_sink_overwrites_and_appends(spark, tmp_path):
    sqlite.register(spark)
    df = spark.createDataFrame([(i, f"t{i}" if i % 3 else None, i / 4) for i in range(50)], "id long, text string, x double")
    path = str(tmp_path / "out")
    for mode, n in (("overwrite", 50), ("append", 100), ("overwrite", 50)):
        df.repartition(3).write.format("sqlite").option("table", "rows").mode(mode).save(path)
        back = spark.read.format("sqlite").option("table", "rows").load(path)
        assert back.count() == n
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))


def folders_of(table, buckets):
    named = table._last()[1]["folders"]
    return {b: sorted(f for d in named.get(str(b), []) for f in os.listdir(f"{table.path}/{d}") if f.endswith(".parquet")) for b in buckets}


def test_rewrites_leave_other_files(spark, tmp_path):
    t = BucketTable(spark, str(tmp_path / "t"), "id long, x string", "id", 8)
    assert t.read().collect() == [] and t.compact() is None
    df = spark.createDataFrame([(i, "a") for i in range(80)], "id long, x string")
    assert t.append(df) and t.append(df.where("id < 3"))
    hit = t.touched(df.where("id = 5"))
    others = [b for b in range(8) if b not in hit]
    before = folders_of(t, others)
    t.rewrite(hit, lambda old: old.where("id <> 5"))
    assert folders_of(t, others) == before and len(hit) == 1
    assert sorted(r.id for r in t.read().collect()) == sorted([i for i in range(80) if i != 5] + [0, 1, 2])
    t.compact(1)
    assert t.read().count() == 82 and t.vacuum() > 0 and t.read().count() == 82
    with pytest.raises(FileExistsError):
        storage.write_text(spark, f"{t.path}/log/{1:012d}.json", "{}")


def test_replayed_batches_change_nothing(spark, tmp_path):
    s = store.SessionStore(spark, str(tmp_path / "s"), 4)
    frame = lambda *rows: spark.createDataFrame(rows, TURNS)
    long = "x" * 60
    first = frame(turn("a", 1, query=long), turn("a", 2), turn("b", 1, user=None))
    assert s.add_turns(first, "t", 0) and not s.add_turns(first, "t", 0)
    second = frame(turn("a", 9), turn("b", 7, user="eve"), turn("c", 5))
    assert s.add_turns(second, "t", 1) and not s.add_turns(second, "t", 1) and not s.add_turns(first, "t", 0)
    got = {r.session_id: (r.title, r.created_at, r.updated_at, r.username) for r in s.sessions().collect()}
    assert got == {"a": (long[:50] + "...", 1.0, 9.0, "ann"), "b": ("question 1 of b", 1.0, 1.0, "default"), "c": ("question 5 of c", 5.0, 5.0, "ann")}
    assert s.turns().count() == 6
    ask = lambda *rows: spark.createDataFrame(rows, "session_id string, username string")
    s.clear(ask(("a", "eve"), ("c", "ann"), ("nobody", "ann")))
    assert {r.session_id for r in s.sessions().collect()} == {"a", "b"} and s.turns().count() == 5
    s.truncate(ask(("a", "eve"), ("b", None)), 1)
    assert sorted((r.session_id, r.turn_id) for r in s.turns().collect()) == [("a", 1), ("a", 2), ("a", 9), ("b", 1)]
    s.truncate(ask(("a", "ann")), 2)
    s.expire(2.0)
    assert sorted((r.session_id, r.turn_id) for r in s.turns().collect()) == [("a", 2)] and s.sessions().count() == 2


def test_sessions_follow_a_stream(spark, tmp_path):
    inbox, s = str(tmp_path / "in"), store.SessionStore(spark, str(tmp_path / "s"), 4)
    for n in (1, 2):
        spark.createDataFrame([turn(x, n) for x in "ab"], TURNS).coalesce(1).write.mode("append").json(inbox)
        s.follow(spark.readStream.schema(TURNS).option("maxFilesPerTrigger", 1).json(inbox), str(tmp_path / "cp"))
        assert s.turns().count() == 2 * n
    assert s.sessions().count() == 2


def test_a_run_that_dies_loses_and_repeats_nothing(spark, tmp_path):
    inbox, checkpoint = str(tmp_path / "in"), str(tmp_path / "cp")
    into = BucketTable(spark, str(tmp_path / "t"), "id long, x string", "id", 4)
    put = lambda lo, hi: spark.createDataFrame([(i, "a") for i in range(lo, hi)], "id long, x string").coalesce(1).write.mode("append").parquet(inbox)
    for k in range(4):
        put(10 * k, 10 * k + 10)
    seen, commit = [], into._commit

    def dying(rows, replaced, stream, batch):
        seen.append(rows.count())
        if len(seen) == 3:  # written, not in the log
            rows.write.parquet(f"{into.path}/data/lost")
            raise RuntimeError("the machine is gone")
        done = commit(rows, replaced, stream, batch)
        if len(seen) == 2:  # in the log, but the stream doesn't know
            raise RuntimeError("the machine is gone")
        return done

    files = lambda: spark.readStream.schema("id long, x string").option("maxFilesPerTrigger", 1).parquet(inbox)
    into._commit = dying
    for _ in range(2):
        with pytest.raises(Exception, match="the machine is gone"):
            store.ingest(files(), into, checkpoint)
    assert into.read().count() == 20
    store.ingest(files(), into, checkpoint)
    assert sorted(r.id for r in into.read().collect()) == list(range(40))
    put(40, 50)
    seen.clear()
    store.ingest(files(), into, checkpoint)
    assert seen == [10] and sorted(r.id for r in into.read().collect()) == list(range(50))


def test_deletes_by_label(spark, tmp_path):
    nodes = BucketTable(spark, str(tmp_path / "n"), "id string, labels array<string>", "id", 8)
    edges = BucketTable(spark, str(tmp_path / "e"), "src string, dst string, rel string", "src", 8)
    nodes.append(spark.createDataFrame([("a", ["X", "Y"]), ("b", ["Y"]), ("c", None), ("d", ["Y"])], "id string, labels array<string>"))
    edges.append(spark.createDataFrame([("a", "b", "r"), ("b", "c", "r"), ("c", "a", "r"), ("d", "c", "r")], "src string, dst string, rel string"))
    others = [b for b in range(8) if b not in nodes.touched(nodes.read().where("id = 'a'"))]
    before = folders_of(nodes, others)
    assert store.delete_label(nodes, edges, "X") == 1 and store.delete_label(nodes, edges, "none") == 0
    assert folders_of(nodes, others) == before
    assert {r.id for r in nodes.read().collect()} == {"b", "c", "d"} and sorted((r.src, r.dst) for r in edges.read().collect()) == [("b", "c"), ("d", "c")]
    assert store.delete_label(nodes, edges, "Y") == 2 and edges.read().count() == 0
    assert nodes.read().select(F.col("id")).collect()[0].id == "c"
