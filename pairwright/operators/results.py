"""The flat results view of a diff: filters, sorts, bands, block pairing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..functions.text import formatted, hex_address
from ..storage import stored

#: The two column orders of the results table; numbers sort by value, texts by their lower case.
VIEW_COLUMNS = ("similarity", "confidence", "name_a", "address_a", "name_b", "address_b", "match_type", "size_a", "size_b", "bb_a", "bb_b", "instr_a", "instr_b")
MODEL_COLUMNS = ("name_a", "address_a", "name_b", "address_b", "similarity", "confidence", "match_type", "size_a", "size_b", "bb_a", "bb_b", "instr_a", "instr_b")
TEXT_COLUMNS = ("name_a", "name_b", "match_type")


def results_view(matches: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """One flat row per match, in the order of phases; `seq` is that order. Bodies are joined late, by idx."""
    side = lambda f, s: f.select(F.col("idx").alias(f"idx_{s}"), F.col("name").alias(f"name_{s}"), F.col("address").alias(f"address_{s}"), F.col("size").alias(f"size_{s}"), F.col("n_bb").alias(f"bb_{s}"), F.col("n_instr").alias(f"instr_{s}"))
    flat = matches.drop("details").join(side(a, "a"), "idx_a").join(side(b, "b"), "idx_b")
    return flat.select(F.struct("phase", "idx_a").alias("seq"), *VIEW_COLUMNS, "phase", "idx_a", "idx_b")


def threshold(text) -> float:
    """What a threshold box means; text that is no number is 0."""
    try:
        return float(text)
    except (TypeError, ValueError):
        return 0.0


def filter_results(results: DataFrame, match_type: str = "All", similarity="0.0", confidence="0.0", needle: str = "") -> DataFrame:
    out = results.where((F.col("similarity") >= threshold(similarity)) & (F.col("confidence") >= threshold(confidence)))
    if match_type != "All":
        out = out.where(F.col("match_type") == match_type)
    if needle:
        low = needle.lower()
        out = out.where(F.lower("name_a").contains(low) | F.lower("name_b").contains(low))
    return out


def sort_results(results: DataFrame, column: int, descending: bool = False, order: tuple = VIEW_COLUMNS, fold_case: bool = True, position: str = "seq") -> DataFrame:
    """Sorted by one of the 13 columns; stable in `position` in both directions."""
    return results.orderBy(*_sort_key(column, descending, order, fold_case), position)


def _sort_key(column: int, descending: bool, order: tuple, fold_case: bool) -> list[Column]:
    name = order[column]
    key = F.lower(name) if name in TEXT_COLUMNS and fold_case else F.col(name)
    return [key.desc() if descending else key.asc()]


class SortedTable:
    """A table that is sorted again and again: the same column toggles its direction, another starts ascending, and
    rows of equal keys keep the places that the sorts before gave them. Filtering anew goes back to the order of loading.

    A stable sort after sorts by other columns is one sort by all of them, the last first; so no places are numbered.
    """

    def __init__(self, order: tuple = VIEW_COLUMNS, fold_case: bool = True):
        self.order, self.fold_case = order, fold_case
        self.done: list[tuple[int, bool]] = []

    def click(self, column: int) -> SortedTable:
        descending = bool(self.done) and self.done[0][0] == column and not self.done[0][1]
        self.done = [(column, descending), *(x for x in self.done if x[0] != column)]
        return self

    def reset(self) -> SortedTable:
        self.done = []
        return self

    def rows(self, results: DataFrame) -> DataFrame:
        return results.orderBy(*[k for c, d in self.done for k in _sort_key(c, d, self.order, self.fold_case)], "seq")


def report_order(results: DataFrame) -> DataFrame:
    return results.orderBy(F.desc("confidence"), "address_a", "address_b")


def ranked(rows: DataFrame, *order: Column | str, name: str = "n") -> DataFrame:
    """Adds each row's place, from 1, in an order over all rows.

    Rows are dealt out in ranges of the order and numbered inside; only the size of each range reaches the driver, and
    no task holds more than a range.
    """
    spark = rows.sparkSession
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    inside = stored(spark, dealt.withColumns({"_range": F.spark_partition_id(), "_row": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}), "ranges")
    sizes, before = dict(inside.groupBy("_range").count().collect()), []
    for k in range(max(sizes, default=0) + 1):
        before.append(before[-1] + sizes.get(k - 1, 0) if before else 0)
    offset = F.get(F.split(F.lit(",".join(map(str, before))), ",").cast("array<bigint>"), F.col("_range"))
    return inside.withColumn(name, offset + F.col("_row") + 1).drop("_range", "_row")


def numbered(results: DataFrame) -> DataFrame:
    """By similarity, highest first, with a number from 1."""
    return ranked(results, F.desc("similarity"), "seq")


def bands(results: DataFrame) -> DataFrame:
    return results.withColumns({"html_band": K.html_band(F.col("confidence")), "text_band": K.text_band(F.col("confidence")), "log_band": K.log_band(F.col("similarity"))})


def type_counts(matches: DataFrame) -> DataFrame:
    """Matches of each type, 0 where there are none."""
    return matches.agg(*[F.count_if(F.col("match_type") == t).alias(t.lower()) for t in ("Exact", "Structural", "Heuristic", "Manual")])


def find_pair(results: DataFrame, address_a: int, address_b: int) -> DataFrame:
    """The first match of two addresses."""
    return results.where((F.col("address_a") == address_a) & (F.col("address_b") == address_b)).orderBy("seq").limit(1)


def pair_blocks(pairs: DataFrame) -> DataFrame:
    """pairs: idx_a, idx_b, blocks_a, blocks_b (arrays of blocks); the i-th with the i-th, null where one side ends."""
    n = F.greatest(F.size("blocks_a"), F.size("blocks_b"))
    i = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    rows = pairs.withColumn("i", F.explode(i))
    x, y = F.get("blocks_a", F.col("i")), F.get("blocks_b", F.col("i"))
    return rows.select("idx_a", "idx_b", F.col("i").cast("long").alias("block"), x["address"].alias("address_a"), F.when(x.isNotNull(), F.size(x["instructions"])).cast("long").alias("instr_a"), y["address"].alias("address_b"), F.when(y.isNotNull(), F.size(y["instructions"])).cast("long").alias("instr_b"))


def cut_name(c: Column) -> Column:
    """Names of more than 28 bytes are cut to 25 bytes, whole characters, and three dots."""
    ends = F.transform(F.sequence(F.lit(1), F.lit(25)), lambda n: F.substr(c, F.lit(1), n))
    head = F.array_max(F.transform(F.filter(ends, lambda x: F.octet_length(x) <= 25), lambda x: F.struct(F.char_length(x).alias("n"), x.alias("x"))))["x"]
    return F.when(F.octet_length(c) > 28, F.concat(head, F.lit("..."))).otherwise(c)


def first_row(results: DataFrame) -> DataFrame:
    """What a viewer shows at first: the top of the list."""
    return results.orderBy("seq").limit(1)


def table_cells(results: DataFrame, order: tuple = VIEW_COLUMNS) -> DataFrame:
    """seq and the 13 texts of a results table, in either column order."""
    text = lambda c: F.col(c).cast("decimal(20,0)").cast("string")
    show = {"similarity": lambda c: formatted(F.col(c), ".4f"), "confidence": lambda c: formatted(F.col(c), ".4f"), "address_a": lambda c: hex_address(F.col(c)), "address_b": lambda c: hex_address(F.col(c))}
    cell = lambda c: F.coalesce(show[c](c) if c in show else F.col(c) if c in TEXT_COLUMNS else text(c), F.lit(""))
    return results.select("seq", *[cell(c).alias(c) for c in order])


def functions_at(pairs: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """pairs (address_a, address_b) with the functions at both addresses; a pair goes if either is missing.

    Of several functions at an address the last one counts.
    """
    last = lambda f, s: f.groupBy(F.col("address").alias(f"address_{s}")).agg(F.max_by(F.struct(*[c for c in f.columns if c != "address"]), "idx").alias(f"function_{s}"))
    return pairs.join(last(a, "a"), "address_a").join(last(b, "b"), "address_b")
