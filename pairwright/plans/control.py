"""Stopping a running diff: its jobs carry a tag, and cancelling the tag stops them."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession


@contextmanager
def cancellable(spark: SparkSession, tag: str | None = None) -> Iterator[str]:
    """Jobs started inside carry the tag that is yielded."""
    tag = tag or f"diff-{uuid.uuid4().hex}"
    spark.sparkContext.addJobTag(tag)
    try:
        yield tag
    finally:
        spark.sparkContext.removeJobTag(tag)


def cancel(spark: SparkSession, tag: str) -> None:
    spark.sparkContext.cancelJobsWithTag(tag)
