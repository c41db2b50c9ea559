"""Similarity kernels as Column expressions.

Pairwise kernels take two feature structs (see operators.features) and return a double; terms are added in the order
that the semantics give, so sums agree to the last bit. Nothing here leaves the JVM.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The parts of a match score and their weights, in the order in which they are added.
MATCH_WEIGHTS = (("cfg", 0.30), ("call", 0.20), ("bb", 0.15), ("instruction", 0.15), ("name", 0.10), ("edge", 0.10))
#: The parts of the comprehensive score.
COMPREHENSIVE_WEIGHTS = (("cf", 0.3), ("call", 0.2), ("const", 0.2), ("string", 0.1), ("seq", 0.2))
BLEND_MATCH, BLEND_COMPREHENSIVE = 0.6, 0.4
#: The first 25 primes.
PRIMES = (2, 3, 5, 7, 11, 13, 17, 19, 23, 29, 31, 37, 41, 43, 47, 53, 59, 61, 67, 71, 73, 79, 83, 89, 97)
#: How names look that a disassembler made up, after any number of leading `j_`.
AUTO_PREFIXES = ("sub_", "SUB_", "FUN_", "fun_", "loc_", "fcn.", "func_")
AUTO_NAMES = ("", "unnamed")


def sanitize(x: Column) -> Column:
    """NaN to 0, then clamped to [0, 1]."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(F.nanvl(x, F.lit(0.0)), F.lit(0.0))))


def ratio(x: Column, y: Column, both_zero: float = 1.0) -> Column:
    """1 - |x - y| / max; one of them zero: 0."""
    x, y = x.cast("double"), y.cast("double")
    return F.when((x == 0) & (y == 0), F.lit(both_zero)).when((x == 0) | (y == 0), 0.0).otherwise(1.0 - F.abs(x - y) / F.greatest(x, y))


def jaccard(a: Column, b: Column) -> Column:
    """Of distinct arrays; two empty ones are alike."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b)).cast("double")), F.lit(1.0))


def multiset_share(tags_a: Column, tags_b: Column, n_a: Column, n_b: Column) -> Column:
    """Size of the multiset intersection over the larger count; tags number equal elements."""
    share = F.size(F.array_intersect(tags_a, tags_b)).cast("double") / F.greatest(n_a, n_b)
    return F.when((n_a == 0) & (n_b == 0), 1.0).when((n_a == 0) | (n_b == 0), 0.0).otherwise(share)


def occurrence_tags(a: Column) -> Column:
    """Each element with the number of its occurrence, so that sets of tags act as multisets. No order."""
    count = lambda m: F.size(F.filter(a, lambda x: x == m))
    return F.flatten(F.transform(F.array_distinct(a), lambda m: F.transform(F.sequence(F.lit(1), count(m)), lambda k: F.concat(m, F.lit("#"), k.cast("string")))))


def cosine(a: Column, b: Column) -> Column:
    """Of two maps string to count; a zero norm gives 0."""
    dot = F.aggregate(F.map_keys(a), F.lit(0.0), lambda s, k: s + F.coalesce(F.try_element_at(a, k).cast("double") * F.try_element_at(b, k).cast("double"), F.lit(0.0)))
    norm = lambda m: F.sqrt(F.aggregate(F.map_values(m), F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))
    return F.when((norm(a) == 0) | (norm(b) == 0), 0.0).otherwise(dot / (norm(a) * norm(b)))


def histogram(a: Column) -> Column:
    """Array of strings to map of counts."""
    return F.map_from_entries(F.transform(F.array_distinct(a), lambda m: F.struct(m, F.size(F.filter(a, lambda x: x == m)).cast("bigint"))))


def _padded(s: Column) -> Column:
    """One sentinel for each byte beyond the characters: lengths are in bytes, comparisons by character."""
    return F.concat(s, F.repeat(F.lit("￿"), F.octet_length(s) - F.char_length(s)))


def edit_distance(a: Column, b: Column) -> Column:
    # Equal strings, of copies or of namesakes, need no table of distances.
    return F.when(a == b, 0).otherwise(F.levenshtein(_padded(a), _padded(b)))


def normalized_edit_distance(a: Column, b: Column) -> Column:
    longest = F.greatest(F.octet_length(a), F.octet_length(b))
    return F.when(longest == 0, 1.0).otherwise(1.0 - edit_distance(a, b).cast("double") / longest)


def edit_bound(bytes_a: Column, bytes_b: Column) -> Column:
    """At least the normalised edit similarity: the distance is no less than the difference of lengths."""
    longest = F.greatest(bytes_a, bytes_b)
    return F.when(longest == 0, 1.0).otherwise(F.least(bytes_a, bytes_b).cast("double") / longest)


# ---------------------------------------------------------------- names and hashes


def is_auto_generated_name(name: Column) -> Column:
    bare = F.regexp_replace(name, "^(j_)+", "")
    prefixes = "|".join(p.replace(".", r"\.") for p in AUTO_PREFIXES)
    return bare.rlike(f"^({prefixes})") | bare.isin(*AUTO_NAMES)


def md_index(size: Column, n_bb: Column, n_instr: Column, complexity: Column) -> Column:
    return F.substr(F.sha2(F.concat_ws(":", size.cast("string"), n_bb.cast("string"), n_instr.cast("string"), complexity.cast("string")), 256), F.lit(1), F.lit(16))


def byte_sum(s: Column) -> Column:
    digits = F.hex(s.cast("binary"))
    pairs = F.when(F.length(digits) > 0, F.sequence(F.lit(1), F.greatest(F.length(digits) - 1, F.lit(1)), F.lit(2))).otherwise(F.array().cast("array<int>"))
    return F.aggregate(pairs, F.lit(0).cast("bigint"), lambda s, i: s + F.conv(F.substr(digits, i, F.lit(2)), 16, 10).cast("bigint"))


def small_primes_product(mnemonics: Column) -> Column:
    """Product of a prime for each mnemonic, modulo 2^64, as decimal(20, 0)."""
    primes = F.array(*[F.lit(p).cast("decimal(3,0)") for p in PRIMES])
    step = lambda acc, m: ((acc * F.get(primes, (byte_sum(m) % len(PRIMES)).cast("int"))) % F.lit("18446744073709551616").cast("decimal(20,0)")).cast("decimal(20,0)")
    return F.aggregate(mnemonics, F.lit(1).cast("decimal(20,0)"), step)


def fuzzy_hash(block_counts: Column, mnemonics: Column) -> Column:
    """block_counts: array of (instructions, edges)."""
    blocks = F.array_join(F.transform(block_counts, lambda b: F.concat(F.lit("bb"), b["n"].cast("string"), F.lit("e"), b["e"].cast("string"), F.lit("_"))), "")
    words = F.array_join(F.transform(mnemonics, lambda m: F.concat(m, F.lit("_"))), "")
    return F.substr(F.sha2(F.concat(blocks, words), 256), F.lit(1), F.lit(16))


# ---------------------------------------------------------------- pairs of functions


def control_flow_similarity(a: Column, b: Column) -> Column:
    return F.when((a["n_bb"] == 0) & (b["n_bb"] == 0), 1.0).otherwise(0.6 * ratio(a["n_bb"], b["n_bb"]) + 0.4 * ratio(a["edges_cfg"], b["edges_cfg"]))


def cfg_similarity(a: Column, b: Column) -> Column:
    return F.when(a["cfg_hash"] == b["cfg_hash"], 1.0).otherwise(control_flow_similarity(a, b))


def basic_block_similarity(a: Column, b: Column) -> Column:
    return multiset_share(a["bb_tags"], b["bb_tags"], a["n_bb"], b["n_bb"])


def instruction_similarity(a: Column, b: Column) -> Column:
    return multiset_share(a["mnemonic_tags"], b["mnemonic_tags"], a["n_instr"], b["n_instr"])


def edge_similarity(a: Column, b: Column) -> Column:
    return ratio(a["edges_total"], b["edges_total"])


def name_similarity(a: Column, b: Column) -> Column:
    return normalized_edit_distance(a["name"], b["name"])


def call_similarity(a: Column, b: Column) -> Column:
    return jaccard(a["calls"], b["calls"])


def constant_similarity(a: Column, b: Column) -> Column:
    return jaccard(a["constants"], b["constants"])


def string_similarity(a: Column, b: Column) -> Column:
    return jaccard(a["strings"], b["strings"])


def sequence_similarity(a: Column, b: Column) -> Column:
    """Edit similarity of the mnemonics joined by spaces."""
    none_a, none_b = a["n_instr"] == 0, b["n_instr"] == 0
    return F.when(none_a & none_b, 1.0).when(none_a | none_b, 0.0).otherwise(normalized_edit_distance(a["sequence"], b["sequence"]))


MATCH_PARTS = {"cfg": cfg_similarity, "call": call_similarity, "bb": basic_block_similarity, "instruction": instruction_similarity, "name": name_similarity, "edge": edge_similarity}
COMPREHENSIVE_PARTS = {"cf": control_flow_similarity, "call": call_similarity, "const": constant_similarity, "string": string_similarity, "seq": sequence_similarity}


def weighted(parts: dict[str, Column], weights) -> Column:
    return reduce(add, [parts[k] * w for k, w in weights])


def match_details(a: Column, b: Column) -> dict[str, Column]:
    return {k: sanitize(f(a, b)) for k, f in MATCH_PARTS.items()}


def match_similarity(parts: dict[str, Column]) -> Column:
    return sanitize(weighted(parts, MATCH_WEIGHTS))


def comprehensive_similarity(a: Column, b: Column) -> Column:
    total = reduce(add, [F.lit(w) for _, w in COMPREHENSIVE_WEIGHTS])
    return weighted({k: f(a, b) for k, f in COMPREHENSIVE_PARTS.items()}, COMPREHENSIVE_WEIGHTS) / total


def confidence_grounds(a: Column, b: Column) -> list[Column]:
    """Equal block counts, close complexity, close size: what raises a similarity to a confidence, in order."""
    largest = F.greatest(a["size"], b["size"]).cast("double")
    near = F.abs(a["size"].cast("double") - b["size"].cast("double")) / largest < 0.1
    return [a["n_bb"] == b["n_bb"], F.abs(a["complexity"] - b["complexity"]) < 2, (largest > 0) & near]


def raised(similarity: Column, grounds: list[Column]) -> Column:
    return sanitize(reduce(add, [F.when(g, 0.1).otherwise(0.0) for g in grounds], similarity))


def confidence(a: Column, b: Column, similarity: Column) -> Column:
    """The similarity, raised for equal block counts, close complexity and close size."""
    return raised(similarity, confidence_grounds(a, b))


def block_mnemonic_similarity(a: Column, b: Column) -> Column:
    """Jaccard of the mnemonic sets of two basic blocks."""
    words = lambda x: F.array_distinct(F.transform(x["instructions"], lambda i: i["mnemonic"]))
    return jaccard(words(a), words(b))


def block_matrix(blocks_a: Column, blocks_b: Column) -> Column:
    return F.transform(blocks_a, lambda x: F.transform(blocks_b, lambda y: block_mnemonic_similarity(x, y)))


# ---------------------------------------------------------------- bands


def band(x: Column, high: float, medium: float, strict: bool = False) -> Column:
    over = (lambda c, t: c > t) if strict else (lambda c, t: c >= t)
    return F.when(over(x, high), "high").when(over(x, medium), "medium").otherwise("low")


def html_band(conf: Column) -> Column:
    return F.concat(band(conf, 0.67, 0.34), F.lit("-confidence"))


def text_band(conf: Column) -> Column:
    return band(conf, 0.8, 0.6, strict=True)


def log_band(sim: Column) -> Column:
    return band(sim, 0.9, 0.7)
