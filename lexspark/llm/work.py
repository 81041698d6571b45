"""Tables in, and work tables between the jobs of one operator."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import re
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data folder, read by Spark alone, so that any store it knows will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(id_col: Column, n: int) -> Column:
    """crc32(id as text) mod n; a null id counts as the empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit(""))) % F.lit(n)


def free(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores before it as it takes to be the name of no column, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; a local one is made only for a local session that names none."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    made = f"file://{tempfile.mkdtemp(prefix='lexspark-')}"
    spark.sparkContext.setCheckpointDir(made)
    return made


def drop_dir(spark: SparkSession, path: str) -> None:
    try:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session has ended; its folder is the cluster's to clear
        return


def memory_returned() -> None:
    """Gives back what a Python worker has freed: workers live on and would keep the most that any task of theirs took."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL(None).malloc_trim(0)


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


WRITERS = "spark.sql.maxConcurrentOutputFileWriters"


@contextlib.contextmanager
def setting(spark: SparkSession, key: str, value: str):
    """A setting that holds for what is run inside."""
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def shuffles_freed(spark: SparkSession):
    """What is written inside gives back the files of its shuffles when it is done, not when the driver collects garbage."""
    return setting(spark, CLEANUP, "true")


def work_path(spark: SparkSession, name: str) -> str:
    """A new folder under the shared one, dropped with the session at the latest."""
    path = f"{shared_dir(spark)}/lexspark-{name}-{uuid.uuid4().hex}"
    atexit.register(drop_dir, spark, path)
    return path


def written(df: DataFrame, name: str, by: list[str] | None = None) -> DataFrame:
    """``df`` written to the shared folder and read again: lineage ends there, and a lost executor costs nothing."""
    spark = df.sparkSession
    path = work_path(spark, name)
    with shuffles_freed(spark), setting(spark, WRITERS, str(16 if by else 0)):  # a folder's rows need no sort while few are open
        (df.write.partitionBy(*by) if by else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Gives back the folders of written tables that nothing reads any more."""
    for t in tables:
        for folder in {f[: m.end()] for f in t.inputFiles() if (m := re.search(r"/lexspark-[\w-]+-[0-9a-f]{32}(?=/)", f))}:
            drop_dir(t.sparkSession, folder)
