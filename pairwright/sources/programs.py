"""Programs as DataFrames: a small fixture, files, and programs derived from event and order tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S

#: The functions of the small fixture (name, address, size, complexity, blocks).
FIXTURE = (
    ("main", 0x1000, 200, 5, 3),
    ("printf", 0x1200, 50, 1, 1),
    ("malloc", 0x1300, 80, 2, 2),
    ("strcmp", 0x1400, 120, 3, 4),
    ("memcpy", 0x1500, 90, 2, 2),
    ("init_function", 0x1600, 150, 4, 3),
    ("cleanup_function", 0x1700, 100, 3, 2),
    ("process_data", 0x1800, 300, 8, 6),
)
#: Every block of the fixture is push, mov, call at these offsets.
BLOCK_STRIDE = 40


def fixture_program(spark: SparkSession, name: str = "") -> DataFrame:
    """Eight functions; the same for any program name."""
    spec = spark.createDataFrame([(i, *row) for i, row in enumerate(FIXTURE)], "idx long, name string, address long, size long, cyclomatic_complexity long, blocks int")
    u64 = lambda c: c.cast(S.U64)
    code = F.unhex(F.lit("554889e5"))

    def instruction(at: Column, offset: int, mnemonic: str, operands: Column) -> Column:
        return F.struct(u64(at + offset).alias("address"), F.lit(mnemonic).alias("mnemonic"), operands.alias("operands"), code.alias("bytes"), F.lit(4).cast("long").alias("length"))

    def block(k: Column) -> Column:
        at = F.col("address") + k * BLOCK_STRIDE
        target = F.array(F.concat(F.lit("func_"), F.col("idx").cast("string")))
        instrs = F.array(instruction(at, 0, "push", F.array(F.lit("rbp"))), instruction(at, 4, "mov", F.array(F.lit("rsp"), F.lit("rbp"))), instruction(at, 8, "call", target))
        edges = F.when(k < F.col("blocks") - 1, F.array(u64(at + BLOCK_STRIDE))).otherwise(F.array().cast("array<decimal(20,0)>"))
        return F.struct(u64(at).alias("address"), F.lit(BLOCK_STRIDE).cast(S.U64).alias("size"), instrs.alias("instructions"), edges.alias("edges"), F.concat_ws("_", F.lit("bb_hash"), F.col("idx").cast("string"), k.cast("string")).alias("mnemonic_hash"), F.lit(3).cast("long").alias("instruction_count"))

    bbs = spec.withColumn("basic_blocks", F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), block))
    return bbs.select(
        "idx", "name", u64(F.col("address")).alias("address"), u64(F.col("size")).alias("size"), "basic_blocks",
        F.flatten(F.transform("basic_blocks", lambda b: b["instructions"])).alias("instructions"),
        "cyclomatic_complexity",
        F.concat(F.lit("cg_"), F.col("name")).alias("call_graph_hash"),
        F.concat(F.lit("cfg_"), F.col("name")).alias("cfg_hash"),
        (F.col("blocks") * 3).cast("long").alias("instruction_count"),
        F.when(F.col("cyclomatic_complexity") > 2, 2).otherwise(1).cast("long").alias("call_count"),
    )


def read_program(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """A program of schema.PROGRAM; missing fields take their type's default, unknown ones are ignored.

    fmt: `json` for one document a file, `jsonl` for one record a line, or any format that Spark reads.
    """
    reader = spark.read.schema(S.PROGRAM)
    if fmt in ("json", "jsonl"):
        return with_defaults(reader.option("multiLine", fmt == "json").option("mode", "FAILFAST").json(path))
    return with_defaults(reader.format(fmt).load(path))


def with_defaults(df: DataFrame) -> DataFrame:
    """Nulls become 0, the empty text, the empty list or empty bytes, in nested records too; idx is left as it is."""
    return df.select(*[_default(F.col(f.name), f.dataType).alias(f.name) if f.name != "idx" else F.col("idx") for f in df.schema])


def _default(c: Column, kind) -> Column:
    name = kind.typeName()
    if name == "array":
        return F.coalesce(F.transform(c, lambda x: _default(x, kind.elementType)), F.array().cast(kind))
    if name == "struct":
        return F.struct(*[_default(c[f.name], f.dataType).alias(f.name) for f in kind])
    zero = {"string": F.lit(""), "binary": F.lit(b"")}.get(name, F.lit(0).cast(kind))
    return F.coalesce(c, zero)


#: Instruction of each kind of event.
EVENT_MNEMONICS = {"purchase": "call", "view": "mov", "click": "push", "signup": "lea", "error": "jmp"}


def events_program(spark: SparkSession, sf_dir: str, side: str) -> DataFrame:
    """Users as functions, days as basic blocks, events as instructions.

    Sides a and b are two versions that each lack some users or events; side w is the whole table.

    A function's place is its user's id: places need an order, not to be gapless, so no global numbering is made.
    """
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "user_id", "event_type", "ts", "props")
    if side != "w":
        e = e.where("user_id % 10 <> 4") if side == "a" else e.where("user_id % 10 <> 3 AND event_id % 100 <> 7")
    k = F.regexp_extract("props", r'"k": *(-?[0-9]+)', 1).cast("bigint")
    base = (F.col("user_id") + 1) * 4096
    mnemonic = F.coalesce(*[F.when(F.col("event_type") == t, m) for t, m in EVENT_MNEMONICS.items()], F.lit("nop"))
    operands = F.when(mnemonic == "call", F.array(F.concat(F.lit("fn_"), (k % 12).cast("string")))).when(mnemonic == "jmp", F.array(F.concat(F.lit('"e'), k.cast("string"), F.lit('"'))))
    operands = operands.otherwise(F.array(F.concat(F.lit("r"), (F.col("event_id") % 4).cast("string")), k.cast("string")))
    e = e.select("user_id", "event_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), mnemonic.alias("mnemonic"), operands.alias("operands"))
    instr = F.struct("event_id", "mnemonic", "operands")
    days = e.groupBy("user_id", "day").agg(F.array_sort(F.collect_list(instr)).alias("code"))
    users = days.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("day", "code"))).alias("days"))
    start = lambda i: (base + i * 64).cast(S.U64)

    def code(x: Column) -> Column:
        return F.struct((base + x["event_id"] % 4096).cast(S.U64).alias("address"), x["mnemonic"].alias("mnemonic"), x["operands"].alias("operands"), F.lit(None).cast("binary").alias("bytes"), F.lit(16).cast("long").alias("length"))

    def block(d: Column, i: Column) -> Column:
        following = F.when(i < F.size("days") - 1, F.array(start(i + 1))).otherwise(F.array().cast("array<decimal(20,0)>"))
        back = F.when(F.exists(d["code"], lambda x: x["mnemonic"] == "jmp"), F.array(start(F.lit(0)))).otherwise(F.array().cast("array<decimal(20,0)>"))
        words = F.array_join(F.transform(d["code"], lambda x: x["mnemonic"]), " ")
        return F.struct(start(i).alias("address"), (F.size(d["code"]) * 16).cast(S.U64).alias("size"), F.transform(d["code"], code).alias("instructions"), F.concat(following, back).alias("edges"), F.sha2(words, 256).alias("mnemonic_hash"), F.size(d["code"]).cast("long").alias("instruction_count"))

    text = F.array_join(F.flatten(F.transform("days", lambda d: F.transform(d["code"], lambda x: F.concat_ws(":", d["day"], x["mnemonic"])))), " ")
    p = users.withColumns({"basic_blocks": F.transform("days", block), "text": text})
    p = p.withColumn("instructions", F.flatten(F.transform("basic_blocks", lambda b: b["instructions"])))
    edges = F.aggregate("basic_blocks", F.lit(0), lambda s, b: s + F.size(b["edges"]))
    calls = F.array_distinct(F.transform(F.filter("instructions", lambda i: i["mnemonic"] == "call"), lambda i: i["operands"][0]))
    uid = F.col("user_id")
    return p.select(
        uid.cast("long").alias("idx"),
        F.when(uid % 2 == 1, F.concat(F.lit("user_"), uid.cast("string"))).otherwise(F.concat(F.lit("sub_"), F.lower(F.hex(uid)))).alias("name"),
        base.cast(S.U64).alias("address"),
        (F.size("instructions") * 16).cast(S.U64).alias("size"),
        "basic_blocks", "instructions",
        (edges - F.size("basic_blocks") + 2).cast("long").alias("cyclomatic_complexity"),
        F.sha2(F.array_join(F.array_sort(calls), ","), 256).alias("call_graph_hash"),
        F.sha2("text", 256).alias("cfg_hash"),
        F.size("instructions").cast("long").alias("instruction_count"),
        F.size(calls).cast("long").alias("call_count"),
    )


def halves_program(spark: SparkSession, sf_dir: str, side: str) -> DataFrame:
    """Coarse functions with many ties: a user's events of the first (a) or second (b) half of the months.

    A block for each kind of event, with one or two instructions; names and addresses repeat, 0 among them, and so do
    the hashes of a quarter of the functions.
    """
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_type", "ts")
    e = e.where(F.dayofmonth("ts") <= 15) if side == "a" else e.where(F.dayofmonth("ts") > 15)
    m = F.coalesce(*[F.when(F.col("event_type") == t, m) for t, m in EVENT_MNEMONICS.items()], F.lit("nop"))
    kinds = e.groupBy("user_id", m.alias("m")).agg(F.count("*").alias("n"))
    users = kinds.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("m", "n"))).alias("kinds"))
    uid, base = F.col("user_id"), (F.col("user_id") % 50) * 4096
    start = lambda i: (base + i * 64).cast(S.U64)

    def block(x: Column, i: Column) -> Column:
        operands = F.when(x["m"] == "call", F.array(F.concat(F.lit("fn_"), (uid % 4).cast("string")))).when(x["m"] == "jmp", F.array(F.concat(F.lit('"e'), (x["n"] % 3).cast("string"), F.lit('"'))))
        operands = operands.otherwise(F.array(F.lit("r1"), (x["n"] % 4).cast("string")))
        code = F.transform(F.sequence(F.lit(1), F.least(x["n"], F.lit(2))), lambda k: F.struct((base + i * 64 + k * 16).cast(S.U64).alias("address"), x["m"].alias("mnemonic"), operands.alias("operands"), F.lit(None).cast("binary").alias("bytes"), F.lit(16).cast("long").alias("length")))
        none = F.array().cast("array<decimal(20,0)>")
        edges = F.concat(F.when(i < F.size("kinds") - 1, F.array(start(i + 1))).otherwise(none), F.when(x["m"] == "jmp", F.array(start(F.lit(0)))).otherwise(none))
        words = F.array_join(F.transform(code, lambda y: y["mnemonic"]), " ")
        return F.struct(start(i).alias("address"), (F.size(code) * 16).cast(S.U64).alias("size"), code.alias("instructions"), edges.alias("edges"), F.sha2(words, 256).alias("mnemonic_hash"), F.size(code).cast("long").alias("instruction_count"))

    p = users.withColumn("basic_blocks", F.transform("kinds", block)).withColumn("instructions", F.flatten(F.transform("basic_blocks", lambda b: b["instructions"])))
    edges = F.aggregate("basic_blocks", F.lit(0), lambda s, b: s + F.size(b["edges"]))
    words = F.array_join(F.transform("kinds", lambda x: x["m"]), ",")
    calls = F.array_distinct(F.transform(F.filter("instructions", lambda i: i["mnemonic"] == "call"), lambda i: i["operands"][0]))
    return p.select(
        uid.cast("long").alias("idx"),
        F.when(uid % 3 == 0, F.concat(F.lit("sub_"), F.lower(F.hex(uid)))).otherwise(F.concat(F.lit("grp_"), (uid % 7).cast("string"))).alias("name"),
        base.cast(S.U64).alias("address"),
        (F.size("instructions") * 16 + (uid % 3) * 4).cast(S.U64).alias("size"),
        "basic_blocks", "instructions",
        (edges - F.size("basic_blocks") + 2).cast("long").alias("cyclomatic_complexity"),
        F.sha2(F.array_join(F.array_sort(calls), ","), 256).alias("call_graph_hash"),
        F.sha2(F.concat_ws(":", words, F.when(uid % 4 == 0, (uid % 5).cast("string")).otherwise(F.concat(F.lit(side), uid.cast("string")))), 256).alias("cfg_hash"),
        F.size("instructions").cast("long").alias("instruction_count"),
        F.size(calls).cast("long").alias("call_count"),
    )


def orders_program(spark: SparkSession, sf_dir: str, side: str) -> DataFrame:
    """Orders as functions (even keys are side a), line items as instructions: many small functions."""
    parity = 0 if side == "a" else 1
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").where(F.col("o_orderkey") % 2 == parity).select("o_orderkey", "o_custkey")
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_orderkey", "l_linenumber", "l_returnflag", "l_partkey", "l_suppkey", "l_extendedprice").where(F.col("l_orderkey") % 2 == parity)
    mnemonic = F.when(F.col("l_returnflag") == "A", "call").when(F.col("l_returnflag") == "R", "mov").otherwise("add")
    rows = li.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", mnemonic.alias("m")))).alias("items"))
    p = o.join(rows, F.col("o_orderkey") == F.col("l_orderkey"))
    base = (F.col("o_orderkey") + 1) * 4096
    instr = lambda x: F.struct(base.cast(S.U64).alias("address"), x["m"].alias("mnemonic"), F.array(F.concat(F.lit("fn_"), (x["l_suppkey"] % 7).cast("string"))).alias("operands"), F.lit(None).cast("binary").alias("bytes"), F.lit(16).cast("long").alias("length"))
    lines = F.array_sort(F.array_distinct(F.transform("items", lambda x: x["l_linenumber"])))

    def block(line: Column, i: Column) -> Column:
        own = F.transform(F.filter("items", lambda x: x["l_linenumber"] == line), instr)
        edges = F.when(i < F.size(lines) - 1, F.array((base + (i + 1) * 64).cast(S.U64))).otherwise(F.array().cast("array<decimal(20,0)>"))
        return F.struct((base + i * 64).cast(S.U64).alias("address"), (F.size(own) * 16).cast(S.U64).alias("size"), own.alias("instructions"), edges.alias("edges"), F.sha2(F.array_join(F.transform(own, lambda x: x["mnemonic"]), " "), 256).alias("mnemonic_hash"), F.size(own).cast("long").alias("instruction_count"))

    p = p.withColumn("basic_blocks", F.transform(lines, block)).withColumn("instructions", F.transform("items", instr))
    return p.select(
        F.col("o_orderkey").cast("long").alias("idx"),
        F.concat(F.lit("cust_"), F.col("o_custkey").cast("string")).alias("name"),
        base.cast(S.U64).alias("address"), (F.size("items") * 16).cast(S.U64).alias("size"), "basic_blocks", "instructions",
        F.lit(1).cast("long").alias("cyclomatic_complexity"), F.lit(None).cast("string").alias("call_graph_hash"), F.lit(None).cast("string").alias("cfg_hash"),
        F.size("items").cast("long").alias("instruction_count"), F.lit(0).cast("long").alias("call_count"),
    )


def lite_features(program: DataFrame) -> DataFrame:
    """Flat features of the lite profile: counts of at least 1, one row per address (the last values, in first place).

    A size of 0 becomes the span of the blocks, instructions are counted block by block (3 for a block whose list is
    missing), a function without blocks counts as one of each. The structural key is a 64-bit hash of the text that
    the profile hashes; equal texts are equal keys, and a text that cannot be made has the key 0.
    """
    n_bb = F.size("basic_blocks")
    blocks = F.transform("basic_blocks", lambda b: F.concat(F.size(b["edges"]).cast("string"), b["size"].cast("string")))
    size = F.coalesce("size", F.lit(0))
    text = F.concat(n_bb.cast("string"), F.array_join(blocks, ""), size.cast("string"))
    top, low = F.array_max(F.transform("basic_blocks", lambda b: b["address"] + b["size"])) - 1, F.array_min(F.transform("basic_blocks", lambda b: b["address"]))
    counts = F.transform("basic_blocks", lambda b: F.when(b["instruction_count"] > 0, b["instruction_count"]).when(b["instructions"].isNotNull(), F.size(b["instructions"])).otherwise(3).cast("bigint"))
    f = program.select(
        "idx", "name", "address",
        F.greatest(F.when(size > 0, size).otherwise(F.coalesce(top - low, F.lit(1))), F.lit(1)).cast("decimal(20,0)").alias("size"),
        F.greatest(n_bb, F.lit(1)).cast("bigint").alias("n_bb"),
        F.greatest(F.coalesce(F.aggregate(counts, F.lit(0).cast("bigint"), lambda s, x: s + x), F.lit(1)), F.lit(1)).alias("n_instr"),
        F.when(text.isNotNull(), F.xxhash64(text)).otherwise(F.lit(0).cast("bigint")).alias("structural_hash"),
    )
    last = F.max_by(F.struct("name", "size", "n_bb", "n_instr", "structural_hash"), "idx").alias("f")
    return f.groupBy("address").agg(F.min("idx").alias("idx"), last).select("idx", "address", "f.*")


def instruction_hashes(program: DataFrame) -> DataFrame:
    """idx, address and a 64-bit hash of mnemonics, instruction lengths and the start address. No phase reads it.

    As the address is part of it, functions at different addresses never share one.
    """
    words = F.transform("instructions", lambda i: F.concat(F.coalesce(i["mnemonic"], F.lit("")), F.coalesce(i["length"], F.lit(0)).cast("string")))
    return program.select("idx", "address", F.xxhash64(F.concat(F.array_join(words, ""), F.col("address").cast("string"))).alias("instruction_hash"))
