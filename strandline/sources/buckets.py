"""Tables of Parquet folders by bucket of a key, with a log of commits.

A commit writes new folders for the buckets that it touches, and then one small log entry that names the folders of every
bucket. Until the entry is there nothing has changed; folders of other buckets are never written again, so their files keep
their names. An entry holds the last batch number of each stream too: a batch that is replayed changes nothing, and one that
died before its entry has left no trace but a folder that no entry names. One writer at a time."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandline.sources import storage

#: Buckets at most: their numbers and folders are listed in a log entry.
MOST_BUCKETS = 4096


def _nullable(kind: T.DataType) -> T.DataType:
    """The type with nulls allowed at every level, as files give it back."""
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, _nullable(f.dataType), True) for f in kind.fields])
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(_nullable(kind.elementType), True)
    return T.MapType(kind.keyType, _nullable(kind.valueType), True) if isinstance(kind, T.MapType) else kind


class BucketTable:
    """A table at a path, created where nothing is there. Rows of one key are in one bucket."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType | str, key: str, buckets: int = 16):
        assert 1 <= buckets <= MOST_BUCKETS
        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), key, buckets
        self.schema = _nullable(schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema))

    def bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key.cast("string")), F.lit(self.buckets)).cast("int")

    def _last(self) -> tuple[int, dict]:
        names = [n for n in storage.files(self.spark, f"{self.path}/log") if n.endswith(".json")]
        if not names:
            return 0, {"folders": {}, "batches": {}}
        return int(names[-1].removesuffix(".json")), json.loads(storage.read_text(self.spark, f"{self.path}/log/{names[-1]}"))

    def read(self, only: list[int] | None = None) -> DataFrame:
        """All rows, or those of some buckets."""
        folders = self._last()[1]["folders"]
        paths = [f"{self.path}/{f}" for b, fs in folders.items() if only is None or int(b) in only for f in fs]
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*paths)

    def last_batch(self, stream: str) -> int:
        """The number of the stream's last batch that is in, -1 without one."""
        return self._last()[1]["batches"].get(stream, -1)

    def touched(self, keys: DataFrame) -> list[int]:
        """Buckets of these keys: MOST_BUCKETS numbers at most."""
        return sorted(r[0] for r in keys.select(self.bucket(F.col(self.key))).distinct().collect())

    def append(self, rows: DataFrame, stream: str = "", batch: int | None = None) -> bool:
        """Adds rows; their buckets' folders stay. False if the batch is in already."""
        return self._commit(rows, None, stream, batch)

    def rewrite(self, touched: list[int], change: Callable[[DataFrame], DataFrame], stream: str = "", batch: int | None = None) -> bool:
        """Replaces the rows of these buckets by what `change` makes of them; their keys stay in the same buckets."""
        return bool(touched) and self._commit(change(self.read(touched)), touched, stream, batch)

    def _commit(self, rows: DataFrame, replaced: list[int] | None, stream: str, batch: int | None) -> bool:
        number, entry = self._last()
        if batch is not None and batch <= entry["batches"].get(stream, -1):
            return False
        folder = f"data/{uuid.uuid4().hex}"
        named = rows.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema.fields)).withColumn("bucket", self.bucket(F.col(self.key)))
        named.hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{self.path}/{folder}")
        new = {name.removeprefix("bucket="): [f"{folder}/{name}"] for name in storage.folders(self.spark, f"{self.path}/{folder}") if name.startswith("bucket=")}
        old = {b: fs for b, fs in entry["folders"].items() if replaced is None or int(b) not in replaced}
        batches = entry["batches"] | ({} if batch is None else {stream: batch})
        text = json.dumps({"folders": old | {b: old.get(b, []) + fs for b, fs in new.items()}, "batches": batches})
        storage.write_text(self.spark, f"{self.path}/log/{number + 1:012d}.json", text)
        return True

    def compact(self, most: int = 8) -> None:
        """Buckets of more than `most` folders get one."""
        many = [int(b) for b, fs in self._last()[1]["folders"].items() if len(fs) > most]
        self.rewrite(many, lambda df: df)

    def vacuum(self) -> int:
        """Deletes folders that the last entry doesn't name; number of folders deleted. For when nobody reads older entries."""
        named = {f.split("/")[1] for fs in self._last()[1]["folders"].values() for f in fs}
        loose = [f for f in storage.folders(self.spark, f"{self.path}/data") if f not in named]
        for f in loose:
            storage.delete(self.spark, f"{self.path}/data/{f}")
        return len(loose)
