"""Reading the tables and writing intermediate ones to the shared folder."""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str, *columns: str) -> DataFrame:
    """A table of a data folder, pruned to ``columns`` if any are given."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    return df.select(*columns) if columns else df


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Only where the session names none
    (tests, a laptop) a temporary one is set."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="plumbline-")
        sc.setCheckpointDir(folder)
    return folder


def _path(spark: SparkSession, path: str):
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jpath, jpath.getFileSystem(spark._jsc.hadoopConfiguration())


def literal(paths: list[str]) -> list[str]:
    """Paths in which what Spark takes for wildcards is escaped."""
    return [re.sub(r"([\[\]{}*?\\,^])", r"\\\1", p) for p in paths]


def shared_path(spark: SparkSession, path: str) -> str:
    """Where a result named ``path`` goes: a path with a scheme as it is; another one to the local disk in a local session, and on a cluster, where
    executors have disks of their own, to the default file system."""
    if "://" in path or path.startswith("file:") or not spark.sparkContext.master.startswith("local"):
        return path
    return f"file://{os.path.abspath(path)}"


def write_bytes(spark: SparkSession, path: str, data: bytes) -> None:
    """A small file, written by the driver to :func:`shared_path`."""
    jpath, fs = _path(spark, shared_path(spark, path))
    if fs.getScheme() == "file":
        at = jpath.toUri().getPath()
        os.makedirs(os.path.dirname(at), exist_ok=True)
        with open(at, "wb") as f:
            f.write(data)
        return
    out = fs.create(jpath, True)
    try:
        out.write(bytearray(data))
    finally:
        out.close()


def delete(spark: SparkSession, path: str) -> None:
    jpath, fs = _path(spark, path)
    fs.delete(jpath, True)


def _delete_quietly(spark: SparkSession, path: str) -> None:
    try:
        delete(spark, path)
    except Exception:  # the JVM may be gone at exit
        pass


_CUTS: list[str] = []


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: its lineage ends there, so a lost
    executor costs no recomputation. The files are deleted when the driver exits, or at the end of :func:`scope`."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _CUTS:
        atexit.register(_delete_all, spark)
    _CUTS.append(path)
    return spark.read.schema(df.schema).parquet(path)


def _delete_all(spark: SparkSession, since: int = 0) -> None:
    gone = _CUTS[since:]
    del _CUTS[since:]
    for path in gone:
        _delete_quietly(spark, path)


@contextmanager
def scope(spark: SparkSession):
    """For long sessions: what is written by :func:`cut` within is deleted at the end; results that are still needed must have been written by then."""
    since = len(_CUTS)
    try:
        yield
    finally:
        _delete_all(spark, since)
