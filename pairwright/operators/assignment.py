"""Greedy one-to-one assignment: every left row, in order of idx_a, takes its best right row that is still free.

Best is by the given columns, then the lowest idx_b. Buckets that share no rows are independent. Small buckets run a
short loop each; buckets of more than LARGE pairs go by set-based rounds instead: a pair is committed when the right
row is the left row's best among what remains, and no earlier left row could still claim it. Both give the serial
result.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..storage import discard, stored

#: Pairs of a bucket that one task may hold.
LARGE = 200_000


def greedy(spark: SparkSession, pairs: DataFrame, bucket: str, best: list[str], large: int = LARGE) -> DataFrame:
    """pairs: bucket, idx_a, idx_b and the columns of `best` (higher first). Returns the chosen (idx_a, idx_b)."""
    narrow = pairs.select(F.col(bucket).alias("bucket"), "idx_a", "idx_b", *best)
    hot = narrow.groupBy("bucket").count().where(F.col("count") > large).select("bucket")
    any_hot = hot.limit(1).count() > 0
    order = [*best, "idx_b"]

    def serial(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["idx_a", *order], ascending=[True, *[False] * len(best), True], kind="stable")
        taken: set = set()
        done: set = set()
        out = []
        for a, b in zip(pdf["idx_a"].tolist(), pdf["idx_b"].tolist()):
            if a not in done and b not in taken:
                done.add(a)
                taken.add(b)
                out.append((a, b))
        return pd.DataFrame(out, columns=["idx_a", "idx_b"]).astype("int64")

    small = narrow.join(hot, "bucket", "left_anti") if any_hot else narrow
    chosen = small.groupBy("bucket").applyInPandas(serial, "idx_a long, idx_b long")
    return chosen.unionByName(rounds(spark, narrow.join(hot, "bucket", "left_semi"), best)) if any_hot else chosen


def rounds(spark: SparkSession, pairs: DataFrame, best: list[str]) -> DataFrame:
    """The set-based form; every round commits at least the first left row of what remains."""
    left = stored(spark, pairs.select("idx_a", "idx_b", *best), "rounds")
    total = None
    while left.limit(1).count():
        top = F.row_number().over(Window.partitionBy("idx_a").orderBy(*[F.desc(c) for c in best], "idx_b"))
        first = F.min("idx_a").over(Window.partitionBy("idx_b"))
        marked = left.withColumns({"rank": top, "first": first})
        won = stored(spark, marked.where("rank = 1 AND first = idx_a").select("idx_a", "idx_b"), "won")
        total = won if total is None else total.unionByName(won)
        before = left
        left = stored(spark, left.join(won.select("idx_a"), "idx_a", "left_anti").join(won.select("idx_b"), "idx_b", "left_anti").select("idx_a", "idx_b", *best), "rounds")
        discard(spark, before)
    return total if total is not None else left.select("idx_a", "idx_b")


def propose_and_resolve(pairs: DataFrame, best: list[str]) -> DataFrame:
    """Each left row proposes its best right row; each right row takes its best proposal; losers get no second one."""
    desc = [F.desc(c) for c in best]
    own = pairs.withColumn("r", F.row_number().over(Window.partitionBy("idx_a").orderBy(*desc, "idx_b"))).where("r = 1")
    return own.withColumn("r", F.row_number().over(Window.partitionBy("idx_b").orderBy(*desc, "idx_a"))).where("r = 1").drop("r")


def rank_zip(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Rows of equal key paired first with first, second with second, in order of idx."""
    nth = lambda d, i: d.select(F.col(key).alias("key"), F.col("idx").alias(i), F.row_number().over(Window.partitionBy(key).orderBy("idx")).alias("n"))
    return nth(a, "idx_a").join(nth(b, "idx_b"), ["key", "n"]).select("idx_a", "idx_b")
