"""A session with the settings that the engine is tuned for, and the folder for tables between jobs."""

from __future__ import annotations

import contextlib
import contextvars
import math
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession

#: Bytes of files whose texts one task takes apart: terms and pairs of so many fit in a task's memory.
TASK_BYTES = 2 << 20
#: The same for tables of words, which are denser than texts.
WORD_BYTES = 2 << 20


def session(name: str = "loomspark", **settings: str) -> SparkSession:
    """AQE with skew handling, UTC, zstd Parquet. On a cluster the submitted settings win over these defaults."""
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.parquet.compression.codec": "zstd",
    }
    builder = SparkSession.builder.appName(name)
    for k, v in (defaults | settings).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, which driver and executors share; a temporary folder stands for it in local mode only."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="loomspark-")
        spark.sparkContext.setCheckpointDir(path)
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


#: Shuffles of a job are removed when it ends, not when the driver happens to collect its garbage.
SHUFFLES_GO = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}

#: The folder of the tables that pass, if there is one.
_passing: contextvars.ContextVar[str | None] = contextvars.ContextVar("passing", default=None)


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{_passing.get() or shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def passing(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """Tables stored inside are removed at the end; it gives a ``stored`` for what stays, which must read none of them any more."""
    outer, folder = _passing.get(), new_folder(spark, "passing")

    def kept(df: DataFrame, name: str) -> DataFrame:
        token = _passing.set(outer)
        try:
            return stored(df, name)
        finally:
            _passing.reset(token)

    token = _passing.set(folder)
    try:
        yield kept
    finally:
        _passing.reset(token)
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def spread(df: DataFrame) -> DataFrame:
    """``df`` in as many partitions as the session has cores, if its scan gives fewer (a small file): for work that is heavy by row."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def file_bytes(df: DataFrame) -> int:
    """Bytes of the files that ``df`` reads, from their listing; no job runs."""
    spark = df.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    paths = [jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(f)) for f in df.inputFiles()]
    return sum(p.getFileSystem(conf).getFileStatus(p).getLen() for p in paths)


def parts_of(df: DataFrame, size: int = TASK_BYTES) -> int:
    """Partitions of about ``size`` bytes of the files of ``df``, at least one a core."""
    return max(df.sparkSession.sparkContext.defaultParallelism, math.ceil(file_bytes(df) / size))


def dealt(df: DataFrame, *keys: str, size: int = TASK_BYTES) -> DataFrame:
    """``df`` dealt out by ``keys`` in partitions of about ``size`` bytes of its files, at least one a core.

    Their number grows with the input, so that what a task holds does not. All rows of a key are in one
    partition: aggregates and windows over ``keys`` and more need no further shuffle.
    """
    return df.repartition(parts_of(df, size), *keys)


@contextlib.contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Session settings that hold inside."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a Parquet table in the shared folder and read again: worked out once, read by columns, safe from lost executors."""
    path = new_folder(df.sparkSession, name)
    with settings(df.sparkSession, SHUFFLES_GO):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def subfolders(spark: SparkSession, path: str) -> list[str]:
    """The finished tables in a folder at a path that Spark can read, by name; none if it does not exist."""
    jvm = spark.sparkContext._jvm.org.apache.hadoop.fs
    target = jvm.Path(path)
    fs = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = fs.listStatus(target) if fs.exists(target) else []
    return sorted(f.getPath().toString() for f in found if f.isDirectory() and fs.exists(jvm.Path(f.getPath(), "_SUCCESS")))
