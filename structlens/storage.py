"""Cutting lineage with tables written to the folder that all executors share."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, SparkSession
from pyspark.util import inheritable_thread_target


def shared_root(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir.

    Only a plain local session, which has a single machine by definition, gets
    a folder of its own when the setting is absent; a cluster without one is an
    error, because a machine-local folder is lost with its machine.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    known = spark.sparkContext._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get().rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that every executor can reach")
    folder = tempfile.mkdtemp(prefix="structlens-")
    spark.sparkContext.setCheckpointDir(f"file://{folder}")
    return spark.sparkContext._jsc.sc().getCheckpointDir().get().rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df once and return a reader of what was written.

    Used where a result feeds several consumers: the written table survives the
    loss of executors and its ids stay fixed however often a stage is retried.
    """
    spark = df.sparkSession
    path = f"{shared_root(spark)}/structlens/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _WRITTEN:
        atexit.register(release, spark)
    _WRITTEN.append(path)
    return spark.read.schema(df.schema).parquet(path)


def together(spark: SparkSession, *tasks: Callable) -> list:
    """What each task returns, in order, all at work at once: the planning of one overlaps the jobs of others. The first error is raised when all have ended."""
    with ThreadPoolExecutor(len(tasks)) as pool:
        running = [pool.submit(inheritable_thread_target(spark)(task)) for task in tasks]
    return [x.result() for x in running]


#: Tables written and not yet removed, oldest first.
_WRITTEN: list[str] = []


def release(spark: SparkSession, keep: int = 0) -> int:
    """Remove the tables written so far but the last `keep`, and say how many; done at exit too.

    For long sessions between queries: results that are still to be read from
    those tables can no longer be.
    """
    gone = _WRITTEN[: len(_WRITTEN) - keep] if keep else _WRITTEN[:]
    del _WRITTEN[: len(gone)]
    for path in gone:
        _remove(spark, path)
    return len(gone)


def spread(df: DataFrame) -> DataFrame:
    """df over at least as many tasks as the session has cores, for work in Python on rows of one small file.

    Input in enough splits, as any large input is, stays where it is.
    """
    wanted = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= wanted else df.repartition(wanted)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:
        pass
