"""What the operators of this subpackage share: reading, durable cuts, shipping code, seeded order."""

from __future__ import annotations

import atexit
import ctypes
import gc
import importlib
import os
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of one Arrow batch sent to a Python worker.
BATCH_BYTES = 16 << 20
BATCH_ROWS = 4096


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def prepare(spark: SparkSession) -> None:
    """Bounds Arrow batches and makes the package importable in Python workers, once per context."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    sc = spark.sparkContext
    if getattr(sc, "_strandline_shipped", False):
        return
    top = os.path.dirname(importlib.import_module("strandline").__file__)
    d = tempfile.mkdtemp(prefix="strandline_code_")  # the driver serves it while the context lives
    atexit.register(shutil.rmtree, d, True)
    path = os.path.join(d, f"strandline_{uuid.uuid4().hex[:8]}.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, names in os.walk(top):
            for n in sorted(names):
                if n.endswith(".py"):
                    full = os.path.join(folder, n)
                    z.write(full, os.path.join("strandline", os.path.relpath(full, top)))
    sc.addPyFile(path)
    sc._strandline_shipped = True


def shared_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where it is unset: on one machine a fresh local folder, on a cluster a
    folder in the warehouse, which all executors see."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        sc = spark.sparkContext
        found = getattr(sc, "_strandline_dir", None)
        if not found:
            if sc.master.startswith("local["):
                found = "file://" + tempfile.mkdtemp(prefix="strandline_")
                atexit.register(shutil.rmtree, found.removeprefix("file://"), True)
            else:
                found = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_strandline"
            sc._strandline_dir = found
    return found.rstrip("/")


def _delete(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def written(spark: SparkSession) -> list[str]:
    """Folders that durable() wrote and nothing deleted yet, the latest last."""
    sc = spark.sparkContext
    if not hasattr(sc, "_strandline_written"):
        sc._strandline_written = []
    return sc._strandline_written


def sweep(spark: SparkSession, first: int = 0) -> None:
    """Deletes what durable() wrote since written() had `first` folders. For a caller who has written the result: frames
    that weren't written can't be read any more."""
    paths = written(spark)
    while len(paths) > first:
        _delete(spark, paths.pop())


def durable(df: DataFrame, name: str) -> DataFrame:
    """Writes df once to the shared folder and reads it back: lineage ends there and a lost executor costs nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/strandline/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    written(spark).append(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._strandline_path = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes what durable() wrote for df."""
    paths = written(df.sparkSession)
    if df._strandline_path in paths:
        paths.remove(df._strandline_path)
        _delete(df.sparkSession, df._strandline_path)


def crc_mod(column, n: int):
    """crc32 of the id's decimal text, modulo n."""
    return F.pmod(F.crc32(column.cast("string").cast("binary")), F.lit(n))


def bounded_rows(df: DataFrame, key: str, n: int) -> DataFrame:
    """At most n rows, those with the smallest seeded hash of the key: a top-n, so no task holds more than n rows."""
    return df.orderBy(F.xxhash64(F.lit(20260), F.col(key)), F.col(key)).limit(n)


def freeing(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]):
    """run, for mapInArrow. Once a task's rows are done, what the allocators keep goes back to the system: a worker stays
    for later tasks, and would hold it beside stages that run no Python."""

    def freed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc has it
                trim(0)

    return freed


def tidy(spark: SparkSession) -> None:
    """Lets Spark drop shuffle files of results that are written: they go when their last reference is collected."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()
