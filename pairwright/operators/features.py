"""One narrow feature row per function, computed once; every later operator reads only these."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import kernels as K


def constant_operand(o: Column) -> Column:
    """`#...`, `0x...`, or a whole number of 64 bits with an optional sign and no blanks."""
    number = o.rlike(r"^[+-]?[0-9]+\z") & F.expr("true") & o.try_cast("bigint").isNotNull()
    return o.startswith("#") | o.startswith("0x") | number


def quoted_operand(o: Column) -> Column:
    return o.startswith('"') & o.endswith('"')


def extract_features(program: DataFrame) -> DataFrame:
    """program: rows of schema.PROGRAM. Lists are never null afterwards; absent hashes are derived from structure."""
    empty = lambda c, kind: F.coalesce(F.col(c), F.array().cast(kind))
    p = program.select(
        "idx",
        F.coalesce("name", F.lit("")).alias("name"),
        F.coalesce("address", F.lit(0)).cast("decimal(20,0)").alias("address"),
        F.coalesce("size", F.lit(0)).cast("decimal(20,0)").alias("size"),
        F.coalesce("cyclomatic_complexity", F.lit(0)).alias("complexity"),
        "cfg_hash",
        "call_graph_hash",
        empty("basic_blocks", program.schema["basic_blocks"].dataType).alias("bbs"),
        empty("instructions", program.schema["instructions"].dataType).alias("instrs"),
    )
    edges = lambda b: F.coalesce(b["edges"], F.array().cast("array<decimal(20,0)>"))
    operands = lambda i: F.coalesce(i["operands"], F.array().cast("array<string>"))
    p = p.withColumns({
        "mnemonics": F.transform("instrs", lambda i: F.coalesce(i["mnemonic"], F.lit(""))),
        "degrees": F.transform("bbs", lambda b: F.size(edges(b))),
        "targets": F.flatten(F.transform("bbs", edges)),
        "operands": F.flatten(F.transform("instrs", operands)),
        "addresses": F.transform("bbs", lambda b: b["address"]),
        "bb_hashes": F.transform("bbs", lambda b: F.coalesce(b["mnemonic_hash"], F.sha2(F.array_join(F.transform(b["instructions"], lambda i: i["mnemonic"]), " "), 256))),
    })
    calls = F.filter("instrs", lambda i: F.lower(F.coalesce(i["mnemonic"], F.lit(""))).contains("call") & (F.size(operands(i)) > 0))
    p = p.withColumn("calls", F.array_distinct(F.transform(calls, lambda i: operands(i)[0])))
    ordinal = lambda t: F.array_position("addresses", t)
    shape = F.array_join(F.transform("bbs", lambda b: F.array_join(F.transform(edges(b), lambda t: ordinal(t).cast("string")), ",")), ";")
    return p.select(
        "idx", "name", "address", "size",
        F.size("bbs").cast("bigint").alias("n_bb"),
        F.size("instrs").cast("bigint").alias("n_instr"),
        "complexity",
        F.coalesce("cfg_hash", F.sha2(shape, 256)).alias("cfg_hash"),
        F.coalesce("call_graph_hash", F.sha2(F.array_join(F.array_sort("calls"), ","), 256)).alias("call_graph_hash"),
        F.size("targets").cast("bigint").alias("edges_total"),
        F.size(F.filter("targets", lambda t: F.array_contains("addresses", t))).cast("bigint").alias("edges_cfg"),
        F.array_sort("degrees").alias("degrees"),
        K.occurrence_tags(F.col("bb_hashes")).alias("bb_tags"),
        K.occurrence_tags(F.col("mnemonics")).alias("mnemonic_tags"),
        "calls",
        F.array_distinct(F.filter("operands", constant_operand)).alias("constants"),
        F.array_distinct(F.filter("operands", quoted_operand)).alias("strings"),
        F.array_join("mnemonics", " ").alias("sequence"),
        K.md_index(F.col("size"), F.size("bbs"), F.size("instrs"), F.col("complexity")).alias("md_index"),
        K.small_primes_product(F.col("mnemonics")).alias("primes_product"),
        K.fuzzy_hash(F.transform("bbs", lambda b: F.struct(F.size(F.coalesce(b["instructions"], F.array().cast(program.schema["instructions"].dataType))).alias("n"), F.size(edges(b)).alias("e"))), F.col("mnemonics")).alias("fuzzy_hash"),
        K.is_auto_generated_name(F.col("name")).alias("is_auto"),
    )
