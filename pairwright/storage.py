"""Tables in the folder that driver and executors share; they cut lineage and survive lost executors."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession


def application_folder(spark: SparkSession) -> str:
    """This application's folder below spark.checkpoint.dir. Only a local session may go without that setting."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file:///tmp/checkpoints"
    return f"{base.rstrip('/')}/pairwright/{spark.sparkContext.applicationId}"


def shared_folder(spark: SparkSession, label: str) -> str:
    return f"{application_folder(spark)}/{label}-{uuid.uuid4().hex}"


def stored(spark: SparkSession, df: DataFrame, label: str) -> DataFrame:
    path = shared_folder(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def together(spark: SparkSession, *runs: Callable) -> list:
    """What some functions return that run jobs of their own; small jobs side by side leave fewer cores idle."""
    with ThreadPoolExecutor(len(runs)) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(spark)(r)) for r in runs]]


def all_stored(spark: SparkSession, label: str, *dfs: DataFrame) -> list[DataFrame]:
    """`stored` for each of them, at the same time."""
    return together(spark, *[lambda d=d: stored(spark, d, label) for d in dfs])


def discard(spark: SparkSession, *paths) -> None:
    """Removes folders, or what `stored` returned, that no later read needs."""
    for p in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(getattr(p, "_stored_at", p))
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def clean(spark: SparkSession) -> None:
    """Removes all that this application has stored; to be called once its results have been written."""
    discard(spark, application_folder(spark))
