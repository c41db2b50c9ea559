"""A whole diff as one JSON document, and back. Bodies are joined late and streamed to the file, never gathered."""

from __future__ import annotations

import json
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S
from ..operators.matching import Diff
from ..operators.results import ranked
from ..sinks import exports

VERSION = "1.0"


def bodies(program: DataFrame, ids: DataFrame) -> DataFrame:
    """ids (idx and what else it has) with whole functions as structs."""
    whole = program.select("idx", F.struct(*[f.name for f in S.FUNCTION]).alias("function"))
    return ids.join(whole, "idx").select(*ids.columns, "function")


def function_rows(d: Diff, program: DataFrame, side: str) -> DataFrame:
    """(ord, body): the matched functions of a side in the order of matching, then its leftovers by idx."""
    rest = d.unmatched_a if side == "a" else d.unmatched_b
    order = d.matches.select(F.struct(F.col("phase"), F.col("idx_a").alias("at")).alias("ord"), F.col(f"idx_{side}").alias("idx"))
    order = order.unionByName(rest.select(F.struct(F.lit(99).alias("phase"), F.col("idx").alias("at")).alias("ord"), "idx"))
    return bodies(program, order).select("ord", F.to_json("function", {"ignoreNullFields": "false"}).alias("body"))


def match_rows(d: Diff, program_a: DataFrame, program_b: DataFrame) -> DataFrame:
    """(ord, body): matches with both functions inside."""
    side = lambda p, s: bodies(p, d.matches.select(F.col(f"idx_{s}").alias("idx"))).select(F.col("idx").alias(f"idx_{s}"), F.col("function").alias(f"function_{s}"))
    m = d.matches.join(side(program_a, "a"), "idx_a").join(side(program_b, "b"), "idx_b")
    body = F.to_json(F.struct("function_a", "function_b", "similarity", "confidence", "match_type", "details"), {"ignoreNullFields": "false"})
    return m.select(F.struct("phase", F.col("idx_a").alias("at")).alias("ord"), body.alias("body"))


def save_document(d: Diff, program_a: DataFrame, program_b: DataFrame, path_a: str, path_b: str, path: str) -> None:
    """Functions are the matched ones, then the leftovers. Hashes of the inputs are left empty and time is 0."""
    n = d.matches.count()
    meta = {"created_at": datetime.now(UTC).isoformat(), "plugin_version": VERSION, "binary_a_hash": "", "binary_b_hash": "", "total_functions_a": n + d.unmatched_a.count(), "total_functions_b": n + d.unmatched_b.count(), "total_matches": n, "analysis_time_seconds": 0.0}
    lists = {"functions_a": function_rows(d, program_a, "a"), "functions_b": function_rows(d, program_b, "b"), "matches": match_rows(d, program_a, program_b)}
    exports.save_diff(lists, {"binary_a_path": path_a, "binary_b_path": path_b}, {"metadata": meta}, path)


def save_result(d: Diff, program_a: DataFrame, program_b: DataFrame, name_a: str, name_b: str, path: str, seconds: float = 0.0) -> None:
    """The bare result: matches, leftovers, overall similarity, time and names."""
    rest = lambda p, u: bodies(p, u.select("idx")).select(F.col("idx").alias("ord"), F.to_json("function", {"ignoreNullFields": "false"}).alias("body"))
    lists = {"matched_functions": match_rows(d, program_a, program_b), "unmatched_functions_a": rest(program_a, d.unmatched_a), "unmatched_functions_b": rest(program_b, d.unmatched_b)}
    exports.save_diff(lists, {}, {"similarity_score": similarity_score(d), "analysis_time": seconds, "binary_a_name": name_a, "binary_b_name": name_b}, path)


MATCH = f"struct<function_a: {S.FUNCTION.simpleString()}, function_b: {S.FUNCTION.simpleString()}, similarity: double, confidence: double, match_type: string, details: {S.DETAILS.simpleString()}>"


def matches_of(spark: SparkSession, doc: dict) -> DataFrame:
    """The matches of a loaded document, as rows with nested functions."""
    rows = spark.createDataFrame([(i, json.dumps(m)) for i, m in enumerate(doc["matches"])], "seq long, j string")
    return rows.select("seq", F.from_json("j", MATCH).alias("m")).select("seq", "m.*")


def read_matches(bodies: DataFrame) -> DataFrame:
    """(ord, body) rows of matches, parsed again."""
    return bodies.select("ord", F.from_json("body", MATCH).alias("m")).select("ord", "m.*")


def in_order(rows: DataFrame) -> DataFrame:
    """Adds `seq`, the place by `ord` from 0."""
    return ranked(rows, "ord", name="seq").withColumn("seq", F.col("seq") - 1)


def match_count(d: Diff | None) -> int:
    """0 for no diff at all."""
    return d.matches.count() if d is not None else 0


def similarity_score(d: Diff | None) -> float:
    return d.matches.agg(F.coalesce(F.avg("similarity"), F.lit(0.0))).first()[0] if d is not None else 0.0
