"""Named datasets that outlive a session: Parquet tables, and a log that only grows, with a file for each record."""

from __future__ import annotations

import json
import uuid
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.profiling import visible
from ..storage import shared_dir
from .single import exists

_SCHEMA = "view string, name string, parent string, created_at timestamp, warnings array<string>, has_trail boolean"


def folder(spark: SparkSession, root: str | None = None) -> str:
    """Where datasets are kept: the given folder, or one in the cluster's shared folder."""
    return root.rstrip("/") if root else f"{shared_dir(spark)}/millrace-datasets"


def register(df: DataFrame, name: str, parent: str | None = None, warnings: list[str] | None = None, trail: DataFrame | None = None, root: str | None = None) -> str:
    """Writes a table, with the trail of the steps that made it, and then its record; returns its id, which is a view's name in this session.

    Nothing is written over, so writers need not know of each other; a record
    that can be read stands for a table that is whole.
    """
    spark, view = df.sparkSession, f"dataset_{uuid.uuid4().hex}"
    home = folder(spark, root)
    if parent is not None and not exists(spark, f"{home}/log/{parent}.json"):
        raise KeyError(parent)
    df.write.parquet(f"{home}/tables/{view}")
    if trail is not None:
        trail.write.parquet(f"{home}/trails/{view}")
    record = {"view": view, "name": name, "parent": parent, "created_at": datetime.now(UTC).isoformat(), "warnings": list(warnings or []), "has_trail": trail is not None}
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(f"{home}/log/{view}.json")
    out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, False)
    try:
        out.write(bytearray(json.dumps(record).encode()))
    finally:
        out.close()
    get(spark, view, root).createOrReplaceTempView(view)
    return view


def get(spark: SparkSession, view: str, root: str | None = None) -> DataFrame:
    """The table of a dataset, whichever session registered it; an unknown id raises KeyError."""
    home = folder(spark, root)
    if not exists(spark, f"{home}/log/{view}.json"):
        raise KeyError(view)
    return spark.read.parquet(f"{home}/tables/{view}")


def datasets(spark: SparkSession, root: str | None = None) -> DataFrame:
    """All registered datasets, with what each was derived from."""
    log = f"{folder(spark, root)}/log"
    return spark.read.schema(_SCHEMA).json(log) if exists(spark, log) else spark.createDataFrame([], _SCHEMA)


def audit_trail(spark: SparkSession, view: str, root: str | None = None) -> DataFrame:
    """The steps that made a dataset, in order; KeyError if it is unknown or was registered without them."""
    home = folder(spark, root)
    if not exists(spark, f"{home}/trails/{view}"):
        raise KeyError(view)
    return spark.read.parquet(f"{home}/trails/{view}").orderBy("position")


def ancestors(spark: SparkSession, view: str, root: str | None = None) -> list[str]:
    """Names of the datasets that one was derived from, the nearest first."""
    home, found = folder(spark, root), []
    parent = spark.read.schema(_SCHEMA).json(f"{home}/log/{view}.json").first().parent
    while parent is not None:
        record = spark.read.schema(_SCHEMA).json(f"{home}/log/{parent}.json").first()
        found.append(record.name)
        parent = record.parent
    return found


def summary(spark: SparkSession, view: str, root: str | None = None) -> dict:
    """Rows and columns of a dataset, with its record."""
    df = get(spark, view, root)
    record = datasets(spark, root).where(F.col("view") == view).first()
    return {"rows": df.count(), "columns": visible(df)} | record.asDict()
