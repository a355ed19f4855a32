"""Folders of written tables: where they lie, what is in them, how they are put in place and deleted."""

from __future__ import annotations

import atexit
import gc
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def work_dir(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where it is unset: on one machine a fresh local folder, on a cluster a
    folder in the warehouse, which all executors see."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if not found:
        found = getattr(sc, "_strandline_work", None)
    if not found:
        if sc.master.startswith("local["):
            found = "file://" + tempfile.mkdtemp(prefix="strandline_work_")
            atexit.register(shutil.rmtree, found.removeprefix("file://"), True)
        else:
            found = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_strandline"
        sc._strandline_work = found
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A path in the work folder that nothing has used."""
    return f"{work_dir(spark)}/strandline/{name}-{uuid.uuid4().hex}"


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def move(spark: SparkSession, path: str, to: str) -> bool:
    """Renames; false if the target exists already or the file system declines."""
    fs, p = _fs(spark, path)
    return bool(fs.rename(p, spark.sparkContext._jvm.org.apache.hadoop.fs.Path(to)))


def folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders in a folder, in order; none if it isn't there."""
    fs, p = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p) if s.isDirectory()) if fs.exists(p) else []


def cut(df: DataFrame, name: str) -> DataFrame:
    """df written once to the work folder and read back: lineage ends there, and a lost executor costs nothing."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tidy(spark: SparkSession) -> None:
    """Lets Spark drop shuffle files of results that are written: they go when their last reference is collected."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def files(spark: SparkSession, path: str) -> list[str]:
    """Names of the files in a folder, in order; none if it isn't there."""
    fs, p = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p) if s.isFile()) if fs.exists(p) else []


def read_text(spark: SparkSession, path: str) -> str:
    """A small file, whole."""
    return "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file, put in place by renaming; an existing one is an error."""
    if exists(spark, path):
        raise FileExistsError(path)
    folder, _, name = path.rpartition("/")
    fs, p = _fs(spark, f"{folder}/_{name}.{uuid.uuid4().hex}")
    out = fs.create(p, False)
    out.write(bytearray(text.encode()))
    out.close()
    if not move(spark, p.toString(), path):
        raise FileExistsError(path)
