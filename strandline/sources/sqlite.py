"""SQLite files as a Spark source and sink: spark.read.format("sqlite"), df.write.format("sqlite").

A path is a file, or a folder of files (*.db), that the driver and the executors see. A table is read in ranges of row ids, one
task each; comparisons with constants go into the files' own queries. A sink writes one file a task into a folder.

    register(spark)
    spark.read.format("sqlite").option("table", "turns").option("rows", 50000).load("/shared/sessions.db")"""

from __future__ import annotations

import os
import sqlite3
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, WriterCommitMessage

#: Row ids of a task.
ROWS = 100_000
BATCH = 4096
_COMPARE = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}
_KINDS = {pa.int64(): "INTEGER", pa.int32(): "INTEGER", pa.bool_(): "INTEGER", pa.float64(): "REAL", pa.float32(): "REAL", pa.binary(): "BLOB"}


def _local(path: str) -> str:
    return path.removeprefix("file://")


def _files(path: str) -> list[str]:
    path = _local(path)
    return sorted(os.path.join(path, n) for n in os.listdir(path) if n.endswith(".db")) if os.path.isdir(path) else [path]


def _open(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{path}?mode=ro", uri=True)


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


def _type(declared: str) -> T.DataType:
    """The column's affinity, by SQLite's rules."""
    d = (declared or "").upper()
    if "INT" in d:
        return T.LongType()
    if any(x in d for x in ("CHAR", "CLOB", "TEXT")):
        return T.StringType()
    if not d or "BLOB" in d:
        return T.BinaryType()
    if any(x in d for x in ("REAL", "FLOA", "DOUB")):
        return T.DoubleType()
    return T.StringType() if any(x in d for x in ("DATE", "TIME")) else T.DoubleType()


def _value(v: object, kind: T.DataType) -> object:
    """The stored value as the column's type; null where it can't be."""
    try:
        if v is None:
            return None
        if isinstance(kind, T.LongType):
            return int(v) if int(v) == (v if isinstance(v, (int, float)) else int(v)) else None
        if isinstance(kind, T.DoubleType):
            return float(v)
        if isinstance(kind, T.BinaryType):
            return v if isinstance(v, bytes) else str(v).encode()
        return v.decode(errors="replace") if isinstance(v, bytes) else str(v)
    except (TypeError, ValueError, OverflowError):
        return None


@dataclass
class Range(InputPartition):
    path: str
    low: int | None
    high: int | None


class Reader(DataSourceReader):
    def __init__(self, path: str, table: str, rows: int, schema: T.StructType):
        self.path, self.table, self.rows, self.schema = path, table, rows, schema
        self.where: list[str] = []
        self.args: list[object] = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        """Takes what SQLite and Spark understand alike; yields the rest. Texts compare by bytes in both."""
        kinds = {f.name: f.dataType for f in self.schema.fields}
        for f in filters:
            name = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            plain = lambda v: isinstance(v, (int, float, str)) and not isinstance(v, bool)
            if name not in kinds or isinstance(kinds[name], T.BinaryType):
                yield f
            elif type(f) in _COMPARE and plain(f.value):
                self.where.append(f"{_quoted(name)} {_COMPARE[type(f)]} ?")
                self.args.append(f.value)
                yield f  # a value of another type than its column's is null to Spark, which looks again
            elif isinstance(f, In) and f.value and all(map(plain, f.value)):
                self.where.append(f"{_quoted(name)} IN ({', '.join('?' * len(f.value))})")
                self.args.extend(f.value)
                yield f
            elif isinstance(f, IsNotNull):
                self.where.append(f"{_quoted(name)} IS NOT NULL")
                yield f
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        out: list[InputPartition] = []
        for path in _files(self.path):
            with _open(path) as c:
                try:
                    low, high = c.execute(f"SELECT min(rowid), max(rowid) FROM {_quoted(self.table)}").fetchone()
                except sqlite3.OperationalError:  # WITHOUT ROWID
                    out.append(Range(path, None, None))
                    continue
            if low is not None:
                out += [Range(path, at, min(at + self.rows - 1, high)) for at in range(low, high + 1, self.rows)]
        return out or [Range("", None, None)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        where, args = list(self.where), list(self.args)
        if partition.low is not None:
            where.append("rowid BETWEEN ? AND ?")
            args += [partition.low, partition.high]
        names, kinds = [f.name for f in self.schema.fields], [f.dataType for f in self.schema.fields]
        arrow = [{T.LongType: pa.int64(), T.DoubleType: pa.float64(), T.BinaryType: pa.binary()}.get(type(k), pa.string()) for k in kinds]
        with _open(partition.path) as c:
            c.text_factory = lambda b: b.decode(errors="replace")
            found = c.execute(f"SELECT {', '.join(map(_quoted, names))} FROM {_quoted(self.table)}" + (f" WHERE {' AND '.join(where)}" if where else ""), args)
            while rows := found.fetchmany(BATCH):
                yield pa.RecordBatch.from_arrays([pa.array([_value(r[k], kinds[k]) for r in rows], arrow[k]) for k in range(len(names))], names)


@dataclass
class Written(WriterCommitMessage):
    path: str


class Writer(DataSourceWriter):
    def __init__(self, path: str, table: str, schema: T.StructType, overwrite: bool):
        self.path, self.table, self.schema = _local(path), table, schema
        os.makedirs(self.path, exist_ok=True)
        self.old = _files(self.path) if overwrite else []

    def write(self, rows: Iterator) -> Written:
        os.makedirs(self.path, exist_ok=True)
        path = os.path.join(self.path, f"part-{uuid.uuid4().hex}.tmp")
        names = [f.name for f in self.schema.fields]
        kind = {T.LongType: "INTEGER", T.IntegerType: "INTEGER", T.ShortType: "INTEGER", T.ByteType: "INTEGER", T.BooleanType: "INTEGER", T.DoubleType: "REAL", T.FloatType: "REAL", T.BinaryType: "BLOB"}
        with sqlite3.connect(path) as c:
            c.execute(f"CREATE TABLE {_quoted(self.table)} ({', '.join(f'{_quoted(f.name)} {kind.get(type(f.dataType), "TEXT")}' for f in self.schema.fields)})")
            c.executemany(f"INSERT INTO {_quoted(self.table)} VALUES ({', '.join('?' * len(names))})", (tuple(None if v is None else v if isinstance(v, (int, float, str, bytes)) else bytes(v) if isinstance(v, bytearray) else str(v) for v in r) for r in rows))
        c.close()
        return Written(path)

    def commit(self, messages: list[Written | None]) -> None:
        for m in messages:
            if m:
                os.rename(m.path, m.path.removesuffix(".tmp") + ".db")
        for path in self.old:
            os.remove(path)

    def abort(self, messages: list[Written | None]) -> None:
        for m in messages:
            if m and os.path.exists(m.path):
                os.remove(m.path)


class SqliteSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "sqlite"

    def schema(self) -> T.StructType:
        found = T.StructType()
        for path in _files(self.options["path"])[:1]:
            with _open(path) as c:
                for _, name, declared, *_ in c.execute(f"PRAGMA table_info({_quoted(self.options['table'])})"):
                    found.add(name, _type(declared))
        if not len(found):
            raise ValueError(f"no table {self.options['table']} in {self.options['path']}")
        return found

    def reader(self, schema: T.StructType) -> Reader:
        return Reader(self.options["path"], self.options["table"], int(self.options.get("rows", ROWS)), schema)

    def writer(self, schema: T.StructType, overwrite: bool) -> Writer:
        return Writer(self.options["path"], self.options["table"], schema, overwrite)


def register(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SqliteSource)
