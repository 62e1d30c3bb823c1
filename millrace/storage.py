"""Intermediate tables in the folder that the cluster shares.

Lineage is cut by writing Parquet below ``spark.checkpoint.dir``: the files
outlive lost executors, are columnar, and are computed once.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_written: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; where none is named, a temporary one on a local master, and an error on any other."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="millrace-")
        context.setCheckpointDir(named)
    return named.rstrip("/")


def stored(df: DataFrame, label: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` once to the shared folder, in folders by the columns ``by``, and read it back."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/millrace-{label}-{uuid.uuid4().hex}"
    (df.write.partitionBy(*by) if by else df.write).parquet(path)
    _written.append(path)
    found = spark.read.schema(df.schema).parquet(path)
    found.millrace_path = path
    return found


def claimed(path: str) -> str:
    """A path in the shared folder that goes with the intermediate tables."""
    _written.append(path)
    return path


def stored_counted(df: DataFrame, label: str, metrics: dict[str, Column]) -> tuple[DataFrame, dict]:
    """Store ``df``, with aggregates over its rows that are taken while its tasks write them, once each even if a task runs again."""
    watch = Observation()
    found = stored(df.observe(watch, *(x.alias(k) for k, x in metrics.items())), label)
    return found, watch.get


#: Rows of a table of keys that is broadcast at most; their keys are short.
SMALL_ROWS = 1_000_000


def small(keys: DataFrame) -> DataFrame:
    """A stored table of short keys, broadcast if it is counted to be small; else left to a shuffled join."""
    return F.broadcast(keys) if keys.count() <= SMALL_ROWS else keys


def discard(df: DataFrame) -> None:
    """Delete the files of a stored table that nothing reads any more."""
    _delete(df.sparkSession, df.millrace_path)
    _written.remove(df.millrace_path)


def release(spark: SparkSession) -> None:
    """Delete every intermediate table of this process; call it once results are written."""
    while _written:
        _delete(spark, _written.pop())


def _delete(spark: SparkSession, path: str) -> None:
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def _at_exit() -> None:
    spark = SparkSession.getActiveSession()
    if spark is not None and _written:
        try:
            release(spark)
        except Exception:  # the JVM may be gone already
            _written.clear()


atexit.register(_at_exit)


def range_parts(df: DataFrame, bytes_each: int = 128 << 20) -> int:
    """Ranges into which a table is dealt: the session's shuffle partitions, and more where its estimated size asks for it."""
    estimate = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    most = 100_000
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(most, -(-estimate // bytes_each)) if estimate < bytes_each * most else 1)
