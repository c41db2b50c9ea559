"""The nested record types: instructions, basic blocks, functions, matches."""

from pyspark.sql import types as T

U64 = T.DecimalType(20, 0)

INSTRUCTION = T.StructType([
    T.StructField("address", U64),
    T.StructField("mnemonic", T.StringType()),
    T.StructField("operands", T.ArrayType(T.StringType())),
    T.StructField("bytes", T.BinaryType()),
    T.StructField("length", T.LongType()),
])

BLOCK = T.StructType([
    T.StructField("address", U64),
    T.StructField("size", U64),
    T.StructField("instructions", T.ArrayType(INSTRUCTION)),
    T.StructField("edges", T.ArrayType(U64)),
    T.StructField("mnemonic_hash", T.StringType()),
    T.StructField("instruction_count", T.LongType()),
])

FUNCTION = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("address", U64),
    T.StructField("size", U64),
    T.StructField("basic_blocks", T.ArrayType(BLOCK)),
    T.StructField("instructions", T.ArrayType(INSTRUCTION)),
    T.StructField("cyclomatic_complexity", T.LongType()),
    T.StructField("call_graph_hash", T.StringType()),
    T.StructField("cfg_hash", T.StringType()),
    T.StructField("instruction_count", T.LongType()),
    T.StructField("call_count", T.LongType()),
])

#: The program table: a function's place in it is its identity and the last tie-breaker.
PROGRAM = T.StructType([T.StructField("idx", T.LongType()), *FUNCTION.fields])

DETAILS = T.StructType([T.StructField(f"{k}_similarity", T.DoubleType()) for k in ("cfg", "bb", "instruction", "edge", "name", "call")])

MATCH_TYPES = ("Exact", "Structural", "Heuristic", "Manual")
