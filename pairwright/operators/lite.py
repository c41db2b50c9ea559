"""The lite profile: three serial phases on flat features, and its general weighted score."""

from __future__ import annotations

from functools import reduce
from operator import add

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..storage import stored
from . import assignment, classes

#: Acceptance thresholds of the phases, and what phases one and two add.
THRESHOLDS, BONUS = (0.6, 0.5, 0.4), (0.1, 0.05, 0.0)
#: Weights of the general score.
WEIGHTS = {"hash": 10.0, "bb": 2.0, "instr": 2.0, "edge": 1.5, "hist": 8.0, "string": 7.0, "string_high": 12.0, "call": 5.0, "flow": 4.0, "const": 3.0, "prime": 6.0, "name": 1.0}
#: Prefixes that are cut from a lower-cased name, each once, in this order.
NAME_PREFIXES = ("sub_", "fcn_", "fcn.", "function_", "func_", "f_")
CONSTANT_LIMIT = 65536
#: The technique that every match of the profile is given, and what it adds to the confidence.
TECHNIQUE, TECHNIQUE_BONUS = "Structural", 0.02


def stripped_name(name: Column) -> Column:
    return F.regexp_replace(F.lower(name), "^" + "".join(f"({p.replace('.', chr(92) + '.')})?" for p in NAME_PREFIXES), "")


def share(x: Column, y: Column) -> Column:
    """1 - |x - y| / max of two counts of at least 1."""
    return 1.0 - F.abs(x - y).cast("double") / F.greatest(x, y)


def core_similarity(a: Column, b: Column) -> Column:
    """What of the weighted sum is no name's: hash, blocks, edges (as blocks), instructions, flow."""
    bb, ins = share(a["n_bb"], b["n_bb"]), share(a["n_instr"], b["n_instr"])
    same = F.when((a["structural_hash"] == b["structural_hash"]) & (a["structural_hash"] != 0), WEIGHTS["hash"]).otherwise(0.0)
    return same + 7.5 * bb + 2.0 * ins + 8.0


def similarity(a: Column, b: Column) -> Column:
    """The score that the profile's features leave: hash, blocks, edges (as blocks), instructions, flow, name."""
    name_a, name_b = stripped_name(a["name"]), stripped_name(b["name"])
    named = ~(name_a.startswith("0x") & name_b.startswith("0x"))
    core = core_similarity(a, b)
    return F.when(named, (core + F.when(name_a == name_b, 1.0).otherwise(0.0)) / 28.5).otherwise(core / 27.5)


#: Fixed value: how far a score may be moved at random so that like scores differ.
JITTER = 0.001


def jittered(score: Column, seed: int) -> Column:
    """A score moved by up to JITTER either way, within [0, 1]. Matching leaves it out, so that results repeat."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), score + (F.rand(seed) * 2 - 1) * JITTER))


def _phase(spark: SparkSession, pairs: DataFrame, phase: int) -> DataFrame:
    """pairs: key, a, b. A right row at address 0 is never taken, but a left row whose best it is gets nothing."""
    s = pairs.select("key", F.col("a.idx").alias("idx_a"), F.col("b.idx").alias("idx_b"), (F.col("b.address") == 0).alias("zero"), F.least(F.lit(1.0), similarity(F.col("a"), F.col("b")) + BONUS[phase]).alias("score"))
    s = stored(spark, s.where(F.col("score") > THRESHOLDS[phase]), "scored")
    order = Window.partitionBy("idx_a").orderBy(F.desc("score"), "idx_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    s = s.withColumn("behind", F.max("zero").over(order)).where(~F.col("behind")).drop("behind", "zero")
    chosen = assignment.greedy(spark, s, "key", ["score"])
    return s.join(chosen, ["idx_a", "idx_b"]).select(F.lit(phase + 1).alias("phase"), "idx_a", "idx_b", F.col("score").alias("similarity"))


#: What the score reads, besides names.
FEATURES = ("structural_hash", "n_bb", "n_instr")
#: Rows that a phase pairs, and by what.
KEYS = (
    (lambda: F.col("structural_hash") != 0, lambda: F.col("structural_hash").cast("string")),
    (lambda: F.col("name") != "sub_*", lambda: F.col("name")),
    (lambda: F.lit(True), lambda: F.lit("all")),
)


def _scores(phase: int):
    """As `classes.match_scores`, for the sum without names and what names add to it."""

    def score(u, v, flags, name):
        s = np.minimum(1.0, np.where(name == 2.0, u / 27.5, (u + name) / 28.5) + BONUS[phase])
        return s, v, s > THRESHOLDS[phase]

    return score


def _core(pairs: DataFrame) -> DataFrame:
    return pairs.withColumns({"u": core_similarity(F.col("a"), F.col("b")), "v": F.lit(0.0), "flags": F.lit(0)})


def phase_matches(spark: SparkSession, a: DataFrame, b: DataFrame, phase: int) -> DataFrame:
    """phase, idx_a, idx_b, similarity of one phase; buckets of many pairs go by classes of rows that score alike."""
    use, key = KEYS[phase]
    a, b = a.where(use()), b.where(use())
    rows = [d.select(key().alias("key"), "idx", stripped_name(F.col("name")).alias("name"), "address", *FEATURES) for d in (a, b)]
    columns = ("key", "idx", "name", "kind", (F.col("address") == 0).alias("zero"), *FEATURES)
    rows = [stored(spark, d.select(*columns), "classes") for d in classes.alike(*rows, FEATURES)]
    crowded = stored(spark, classes.crowded(*rows), "crowded")
    any_crowded = crowded.limit(1).count() > 0
    few = [d.join(crowded, key() == crowded["key"], "left_anti") if any_crowded else d for d in (a, b)]
    out = _phase(spark, candidates(*few, phase), phase)
    if not any_crowded:
        return out
    chosen = classes.choose(*[d.join(crowded, "key") for d in rows], FEATURES, _core, classes.assigner(_scores(phase), classes.Sameness))
    left, right = (d.select(F.col("idx").alias(f"idx_{s}"), F.struct(*d.columns).alias(s)) for d, s in ((a, "a"), (b, "b")))
    score = F.least(F.lit(1.0), similarity(F.col("a"), F.col("b")) + BONUS[phase])
    return out.unionByName(stored(spark, chosen, "chosen").join(left, "idx_a").join(right, "idx_b").select(F.lit(phase + 1).alias("phase"), "idx_a", "idx_b", score.alias("similarity")))


def match(spark: SparkSession, a: DataFrame, b: DataFrame) -> DataFrame:
    """phase, idx_a, idx_b, similarity, confidence of the three phases."""
    a, b = stored(spark, a, "lite"), stored(spark, b, "lite")
    used = None
    for phase in range(3):
        free_a = a if used is None else a.join(used.select(F.col("idx_a").alias("idx")), "idx", "left_anti")
        free_b = b if used is None else b.join(used.select(F.col("idx_b").alias("idx")), "idx", "left_anti")
        found = stored(spark, phase_matches(spark, free_a, free_b, phase), "lite")
        used = found if used is None else used.unionByName(found)
    return used.withColumns({"confidence": F.least(F.lit(1.0), F.col("similarity") + TECHNIQUE_BONUS), "technique": F.lit(TECHNIQUE)})


def candidates(a: DataFrame, b: DataFrame, phase: int) -> DataFrame:
    left, right = a.select(F.struct(*a.columns).alias("a")), b.select(F.struct(*b.columns).alias("b"))
    if phase == 0:
        on, key = (F.col("a.structural_hash") == F.col("b.structural_hash")) & (F.col("a.structural_hash") != 0), F.col("a.structural_hash").cast("string")
    elif phase == 1:
        on, key = (F.col("a.name") == F.col("b.name")) & (F.col("a.name") != "sub_*"), F.col("a.name")
    else:
        return leftover_pairs(left, right).withColumn("key", F.lit("all"))
    return left.join(right, on).withColumn("key", key)


def leftover_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """Pairs of leftovers (structs a and b) that can pass the last threshold; by definition each meets each.

    Equal hashes pass always: an equi-join. Without them a pair needs 7.5 s + 2 s' over 2.4 for its shares of blocks
    and instructions (the named form of the score, with equal names; the nameless one needs more). As s' is 1 at most,
    block counts lie within a factor of 18.75: pairs meet by bands of powers of 2 of the block count, five to either
    side, which is an equi-join as well. The comparison itself stays leftovers times leftovers of like size.
    """
    band = lambda c: F.floor(F.log2(c.cast("double"))).cast("int")
    a, b = F.col("a"), F.col("b")
    same = left.join(right, (F.col("a.structural_hash") == F.col("b.structural_hash")) & (F.col("a.structural_hash") != 0))
    spread = left.withColumn("band", F.explode(F.transform(F.sequence(F.lit(-5), F.lit(5)), lambda d: d + band(F.col("a.n_bb")))))
    near = (F.col("a.structural_hash") != F.col("b.structural_hash")) | (F.col("a.structural_hash") == 0)
    bound = 7.5 * share(a["n_bb"], b["n_bb"]) + 2.0 * share(a["n_instr"], b["n_instr"]) > THRESHOLDS[2] * 28.5 - 9.0 - 1e-9
    return same.unionByName(spread.join(right.withColumn("band", band(F.col("b.n_bb"))), "band").where(near & bound).drop("band"))


# ---------------------------------------------------------------- the general score


def prime_similarity(a: Column, b: Column) -> Column:
    """Half Jaccard, 0.3 by length, 0.2 by the products of the first primes."""
    k = F.least(F.lit(5), F.size(a), F.size(b))
    product = lambda p: F.aggregate(F.slice(p, F.lit(1), F.greatest(k, F.lit(1))), F.lit(1).cast("double"), lambda s, x: s * x.cast("double"))
    length = F.least(F.size(a), F.size(b)).cast("double") / F.greatest(F.size(a), F.size(b))
    products = F.least(product(a), product(b)) / F.greatest(product(a), product(b))
    score = 0.5 * K.jaccard(F.array_distinct(a), F.array_distinct(b)) + 0.3 * length + 0.2 * products
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)))


def general_similarity(techniques: list[tuple[str, Column, Column | float]]) -> tuple[Column, Column]:
    """(score, dominant technique) of (name, similarity, weight) in order; a null similarity leaves its weight out.

    The score is the weighted mean. The dominant technique has the largest sum of weighted similarities, the first on
    ties; a full hash comes before all, and `Mixed` stands where none has any.
    """
    weights = [w if isinstance(w, Column) else F.lit(w) for _, _, w in techniques]
    gains = [F.coalesce(s * w, F.lit(0.0)) for (_, s, _), w in zip(techniques, weights)]
    total = reduce(add, [F.when(s.isNotNull(), w).otherwise(0.0) for (_, s, _), w in zip(techniques, weights)])
    score = F.when(total > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), reduce(add, gains) / total))).otherwise(0.0)
    own = {n: reduce(add, [g for (m, _, _), g in zip(techniques, gains) if m == n]) for n, _, _ in techniques}
    largest = F.greatest(*own.values())
    first = F.coalesce(*[F.when(g == largest, F.lit(n)) for n, g in own.items()])
    return score, F.when(own["Hash Match"] >= WEIGHTS["hash"], "Hash Match").when(largest > 0, first).otherwise("Mixed")


#: Names of the general score's techniques, in order.
TECHNIQUES = ("Hash Match", "Basic Block Count", "Instruction Count", "Edge Count", "Mnemonic Histogram", "String References", "Callgraph", "Control Flow", "Numeric Constants", "Prime Features", "Name Similarity")


def techniques(a: Column, b: Column) -> list[tuple[str, Column, Column | float]]:
    """All techniques over two feature structs: structural_hash, n_bb, n_instr, n_edges, histogram (map), strings,
    call_count, caller_count, node_count, density, connected, constants (numbers), primes, name.

    Counts of zero, empty maps and empty lists leave their technique out.
    """
    both = lambda c, value: F.when((a[c] > 0) & (b[c] > 0), value)
    full = lambda c, value: F.when((F.size(a[c]) > 0) & (F.size(b[c]) > 0), value)
    part = lambda c, least=1.0: 1.0 - F.least(F.lit(1.0), F.abs(a[c] - b[c]).cast("double") / F.greatest(F.lit(least), a[c].cast("double"), b[c].cast("double")))
    strings = F.when((F.size(a["strings"]) > 0) & (F.size(b["strings"]) > 0), K.jaccard(a["strings"], b["strings"]))
    called = (a["call_count"] > 0) | (b["call_count"] > 0)
    small_a, small_b = small_constants(a["constants"]), small_constants(b["constants"])
    consts = F.when((F.size(small_a) > 0) | (F.size(small_b) > 0), K.jaccard(F.array_distinct(small_a), F.array_distinct(small_b)))
    name_a, name_b = stripped_name(a["name"]), stripped_name(b["name"])
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    hash_, bb, ins, edge, hist, string, call, flow, const, prime, name = TECHNIQUES
    return [
        (hash_, flag(a["structural_hash"] == b["structural_hash"]), WEIGHTS["hash"]),
        (bb, both("n_bb", part("n_bb")), WEIGHTS["bb"]),
        (ins, both("n_instr", part("n_instr")), WEIGHTS["instr"]),
        (edge, both("n_edges", part("n_edges")), WEIGHTS["edge"]),
        (hist, full("histogram", K.cosine(a["histogram"], b["histogram"])), WEIGHTS["hist"]),
        (string, strings, F.when(strings > 0.8, WEIGHTS["string_high"]).otherwise(WEIGHTS["string"])),
        (call, F.when(called, part("call_count")), WEIGHTS["call"]),
        (call, F.when(called, part("caller_count")), WEIGHTS["call"]),
        (flow, both("node_count", part("node_count")), WEIGHTS["flow"]),
        (flow, part("density", 0.001), WEIGHTS["flow"]),
        (flow, flag(a["connected"] == b["connected"]), WEIGHTS["flow"]),
        (const, full("constants", consts), WEIGHTS["const"]),
        (prime, full("primes", prime_similarity(a["primes"], b["primes"])), WEIGHTS["prime"]),
        (name, F.when(~(name_a.startswith("0x") & name_b.startswith("0x")), flag(name_a == name_b)), WEIGHTS["name"]),
    ]


def small_constants(xs: Column) -> Column:
    return F.filter(xs, lambda x: x < CONSTANT_LIMIT)
