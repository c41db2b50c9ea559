"""The six matching phases over two feature tables, and what follows from their matches."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..storage import all_stored, stored, together
from . import assignment, blocks, classes

SIMILARITY, CONFIDENCE = 0.6, 0.5
DETAILS = ("cfg", "bb", "instruction", "edge", "name", "call")
COLUMNS = ["phase", "idx_a", "idx_b", "similarity", "confidence", "match_type", "details"]


def as_pairs(idx_pairs: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """Feature structs a and b beside pairs of idx."""
    left = a.select(F.col("idx").alias("idx_a"), F.struct(*a.columns).alias("a"))
    right = b.select(F.col("idx").alias("idx_b"), F.struct(*b.columns).alias("b"))
    return idx_pairs.join(left, "idx_a").join(right, "idx_b")


def key_pairs(a: DataFrame, b: DataFrame, key: Column) -> DataFrame:
    """All pairs of equal key: an equi-join, so AQE splits what is skewed."""
    left = a.select(key.alias("key"), F.struct(*a.columns).alias("a"))
    right = b.select(key.alias("key"), F.struct(*b.columns).alias("b"))
    return left.join(right, "key").select("key", F.col("a.idx").alias("idx_a"), F.col("b.idx").alias("idx_b"), "a", "b")


def scored(pairs: DataFrame) -> DataFrame:
    """Adds details, similarity and confidence of each pair. Parts are columns of their own, so each is computed once."""
    a, b = F.col("a"), F.col("b")
    out = pairs.withColumns({f"_{k}": v for k, v in K.match_details(a, b).items()})
    out = out.withColumn("similarity", K.match_similarity({k: F.col(f"_{k}") for k in K.MATCH_PARTS}))
    out = out.withColumn("confidence", K.confidence(a, b, F.col("similarity")))
    return out.withColumn("details", F.struct(*[F.col(f"_{k}").alias(f"{k}_similarity") for k in DETAILS])).drop(*[f"_{k}" for k in K.MATCH_PARTS])


def gate(scored_pairs: DataFrame, similarity: float = SIMILARITY, confidence: float = CONFIDENCE) -> DataFrame:
    """Pairs over both thresholds. The row number keeps the filter above the scores, which it would else repeat."""
    rows = scored_pairs.withColumn("_row", F.monotonically_increasing_id())
    return rows.where((F.col("_row") >= 0) & (F.col("confidence") >= confidence) & (F.col("similarity") >= similarity)).drop("_row")


def exact_key() -> Column:
    return F.concat_ws("_", "cfg_hash", "call_graph_hash")


#: Phase, key, rows that take part, and the label of its matches.
KEYED_PHASES = (
    (2, "name", lambda: F.col("name"), lambda: ~F.col("is_auto"), "Structural"),
    (3, "md_index", lambda: F.col("md_index"), lambda: F.lit(True), "Heuristic"),
    (4, "primes", lambda: F.col("primes_product").cast("string"), lambda: F.lit(True), "Heuristic"),
    (5, "degrees", lambda: F.array_join(F.transform("degrees", lambda d: d.cast("string")), ","), lambda: F.lit(True), "Structural"),
)


def exact_matches(a: DataFrame, b: DataFrame) -> DataFrame:
    """Phase 1: equal hashes, in order; no threshold."""
    key = exact_key()
    zipped = assignment.rank_zip(a.select("idx", key.alias("key")), b.select("idx", key.alias("key")), "key")
    return labelled(scored(as_pairs(zipped, a, b)), 1, "Exact")


def labelled(pairs: DataFrame, phase: int, label: str) -> DataFrame:
    return pairs.withColumns({"phase": F.lit(phase), "match_type": F.lit(label)}).select(*COLUMNS)


def keyed_candidates(a: DataFrame, b: DataFrame, phase: int, similarity: float = SIMILARITY, confidence: float = CONFIDENCE) -> DataFrame:
    """Pairs of one of the keyed phases that pass both thresholds, with their scores."""
    _, _, key, use, _ = next(p for p in KEYED_PHASES if p[0] == phase)
    return gate(scored(key_pairs(a.where(use()), b.where(use()), key())), similarity, confidence)


def _grounds(x: Column, y: Column) -> Column:
    """The grounds of a confidence as bits."""
    return reduce(add, [F.when(g, 1 << i).otherwise(0) for i, g in enumerate(K.confidence_grounds(x, y))])


def class_parts(pairs: DataFrame) -> DataFrame:
    """u, v, flags of pairs of classes (structs a and b): a match score's parts before and after the name's, and grounds."""
    x, y = F.col("a"), F.col("b")
    terms = [(k, K.sanitize(K.MATCH_PARTS[k](x, y)) * w) for k, w in K.MATCH_WEIGHTS if k != "name"]
    before = [k for k, _ in K.MATCH_WEIGHTS].index("name")
    return pairs.withColumns({"u": reduce(add, [t for _, t in terms[:before]]), "v": reduce(add, [t for _, t in terms[before:]]), "flags": _grounds(x, y)})


def keyed_matches(spark: SparkSession, a: DataFrame, b: DataFrame, phase: int, similarity: float = SIMILARITY, confidence: float = CONFIDENCE) -> DataFrame:
    """Buckets of many pairs go by classes of rows that score alike, the others by their pairs."""
    _, _, key, use, label = next(p for p in KEYED_PHASES if p[0] == phase)
    alike = classes.alike(a.where(use()), b.where(use()), classes.MATCH_FEATURES)
    alike = all_stored(spark, "classes", *[d.select(key().alias("key"), "idx", "name", "kind", F.lit(False).alias("zero"), *classes.MATCH_FEATURES) for d in alike])
    crowded = stored(spark, classes.crowded(*alike), "crowded")
    any_crowded = crowded.limit(1).count() > 0
    few = [d.join(crowded, key() == crowded["key"], "left_anti") if any_crowded else d for d in (a, b)]

    def by_pairs() -> DataFrame:
        # Scores are computed once: the count of hot buckets, the assignment and the last join read the narrow table.
        pairs = stored(spark, keyed_candidates(*few, phase, similarity, confidence).drop("a", "b"), "scored")
        chosen = assignment.greedy(spark, pairs, "key", ["confidence", "similarity"])
        return labelled(pairs.join(chosen, ["idx_a", "idx_b"]), phase, label)

    def by_classes() -> DataFrame:
        assign = classes.assigner(classes.match_scores(similarity, confidence), classes.Edits)
        chosen = stored(spark, classes.choose(*[d.join(crowded, "key") for d in alike], classes.MATCH_FEATURES, class_parts, assign), "chosen")
        return labelled(scored(as_pairs(chosen, a, b)), phase, label)

    return reduce(DataFrame.unionByName, together(spark, by_pairs, by_classes) if any_crowded else [by_pairs()])


#: What the blended score reads, besides names.
FUZZY_FEATURES = (*classes.MATCH_FEATURES, "constants", "strings", "sequence")


def blended(pairs: DataFrame) -> DataFrame:
    """Pairs with details and the blended score."""
    x, y = F.col("a"), F.col("b")
    blend = K.sanitize(K.BLEND_MATCH * F.col("similarity") + K.BLEND_COMPREHENSIVE * K.comprehensive_similarity(x, y))
    pairs = scored(pairs).drop("confidence").withColumn("similarity", blend)
    return pairs.withColumn("confidence", K.confidence(x, y, F.col("similarity")))


def _alike(a: DataFrame, b: DataFrame) -> list[DataFrame]:
    """idx, name, kind and features f of both sides."""
    return [d.select("idx", "name", "kind", F.struct(*FUZZY_FEATURES).alias("f")) for d in classes.alike(a, b, FUZZY_FEATURES)]


def fuzzy_candidates(a: DataFrame, b: DataFrame, similarity: float = SIMILARITY, confidence: float = CONFIDENCE) -> DataFrame:
    """idx, similarity and confidence of all pairs whose blended score passes the thresholds.

    The definition compares every leftover of one side with every one of the other: tasks do so by blocks of rows. A
    bound that needs no edit distance comes first, sequences are compared for what it leaves. No pair is lost.
    """
    spark = a.sparkSession
    none = F.lit(None).cast("struct<confidence: double, similarity: double>").alias("reach")
    rows = [d.select("*", none) for d in all_stored(spark, "classes", *_alike(a, b))]
    found = blocks.met(spark, *blocks.packed(spark, *rows), blocks.all_pairs(similarity, confidence), blocks.PAIRS)
    return found.select("idx_a", "idx_b", "similarity", "confidence")


def best_proposals(spark: SparkSession, a: DataFrame, b: DataFrame, similarity: float, confidence: float) -> DataFrame:
    """idx_a, idx_b, confidence, similarity: each left row's best right row, the lowest idx on ties.

    Rows of equal class and name propose alike and are proposed alike, so only the first of them counts. What a row
    reaches with the first row of its own name rules nearly all pairs of versions of one program out by their bounds.
    Only what is left compares names, then sequences, in the order of their bounds.
    """
    left, right = all_stored(spark, "classes", *[d.groupBy("kind", "name").agg(F.min("idx").alias("idx"), F.first("f").alias("f")) for d in _alike(a, b)])
    own = left.select("name", F.col("idx").alias("idx_a")).join(right.groupBy("name").agg(F.min("idx").alias("idx_b")), "name").drop("name")
    full = lambda d: d.select("idx", "name", "f.*")
    reach = gate(blended(as_pairs(own, full(left), full(right))), similarity, confidence).select(F.col("idx_a").alias("idx"), F.struct("confidence", "similarity").alias("reach"))
    left = stored(spark, left.join(reach, "idx", "left"), "reach")
    right = right.withColumn("reach", F.lit(None).cast(left.schema["reach"].dataType))
    found = blocks.met(spark, *blocks.packed(spark, left, right), blocks.best_pairs(similarity, confidence), blocks.PAIRS)
    best = found.groupBy("idx_a").agg(F.max(F.struct("confidence", "similarity", (-F.col("idx_b")).alias("last"))).alias("p"))
    return best.select("idx_a", (-F.col("p.last")).alias("idx_b"), "p.confidence", "p.similarity")


def fuzzy_matches(a: DataFrame, b: DataFrame, similarity: float = SIMILARITY, confidence: float = CONFIDENCE) -> DataFrame:
    """Phase 6: each leftover proposes once, the best proposal for each right row wins."""
    spark = a.sparkSession
    proposals = stored(spark, best_proposals(spark, a, b, similarity, confidence), "proposals")
    chosen = assignment.propose_and_resolve(proposals, ["confidence", "similarity"]).select("idx_a", "idx_b")
    return labelled(blended(as_pairs(chosen, a, b)), 6, "Heuristic")


@dataclass
class Diff:
    """Matches with their leftovers; all are DataFrames."""

    matches: DataFrame
    unmatched_a: DataFrame
    unmatched_b: DataFrame
    features_a: DataFrame
    features_b: DataFrame


def match_functions(spark: SparkSession, a: DataFrame, b: DataFrame, similarity: float = SIMILARITY, confidence: float = CONFIDENCE) -> DataFrame:
    """All six phases; each sees only what the ones before left free."""
    used = stored(spark, exact_matches(a, b), "matches")
    for phase, *_ in (*KEYED_PHASES, (6,)):
        free_a = a.join(used.select(F.col("idx_a").alias("idx")), "idx", "left_anti")
        free_b = b.join(used.select(F.col("idx_b").alias("idx")), "idx", "left_anti")
        found = fuzzy_matches(free_a, free_b, similarity, confidence) if phase == 6 else keyed_matches(spark, free_a, free_b, phase, similarity, confidence)
        used = used.unionByName(stored(spark, found, "matches"))
    return used


def diff(spark: SparkSession, a: DataFrame, b: DataFrame, similarity: float = SIMILARITY, confidence: float = CONFIDENCE) -> Diff:
    """a, b: feature tables. A leftover is a function whose address no match of its side has."""
    a, b = all_stored(spark, "features", a, b)
    m = match_functions(spark, a, b, similarity, confidence)
    rest = lambda f, i: f.join(m.select(F.col(i).alias("idx")).join(f, "idx").select("address").distinct(), "address", "left_anti").select(*f.columns)
    return Diff(m, rest(a, "idx_a"), rest(b, "idx_b"), a, b)


def summary(d: Diff) -> DataFrame:
    """One row: counts, counts by type, mean similarity and confidence (0 without matches)."""
    count = lambda t: F.count_if(F.col("match_type") == t).alias(f"{t.lower()}_matches")
    m = d.matches.agg(F.count("*").alias("total_matches"), *[count(t) for t in ("Exact", "Structural", "Heuristic", "Manual")], F.coalesce(F.avg("similarity"), F.lit(0.0)).alias("similarity_score"), F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("average_confidence"))
    n = lambda f, c: f.agg(F.count("*").alias(c))
    return m.crossJoin(n(d.unmatched_a, "unmatched_a")).crossJoin(n(d.unmatched_b, "unmatched_b"))


def statistics(matches: DataFrame, total_a: int, total_b: int) -> DataFrame:
    """As `summary`, but leftovers are totals less matches."""
    s = summary(Diff(matches, matches.limit(0), matches.limit(0), matches, matches)).drop("unmatched_a", "unmatched_b")
    return s.withColumns({"unmatched_a": F.lit(total_a) - F.col("total_matches"), "unmatched_b": F.lit(total_b) - F.col("total_matches")})
