"""Text reports of a diff: lines are made by the executors and streamed to the driver in order.

The wording of titles and labels is fixed: reports are read by people and scripts that know it.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ..functions.kernels import log_band, text_band
from ..functions.text import formatted, hex_address, padded
from ..operators.results import cut_name, numbered, report_order

#: Terminal colours of a report's parts.
ANSI = {"header": "\x1b[36m", "label": "\x1b[34m", "good": "\x1b[32m", "bad": "\x1b[31m", "info": "\x1b[36m", "line": "\x1b[33m", "bold": "\x1b[1m", "off": "\x1b[0m", "Exact": "\x1b[32m", "Structural": "\x1b[33m", "Heuristic": "\x1b[35m", "Manual": "\x1b[36m", "high": "\x1b[32m", "medium": "\x1b[33m", "low": "\x1b[31m"}
PLAIN = dict.fromkeys(ANSI, "")
RULE = "-" * 60


def text_report(results: DataFrame, unmatched_a: DataFrame, unmatched_b: DataFrame, summary: Row, colour: bool = False) -> str:
    return "".join(report_lines(results, unmatched_a, unmatched_b, summary, ANSI if colour else PLAIN))


def report_lines(results: DataFrame, unmatched_a: DataFrame, unmatched_b: DataFrame, summary: Row, c: dict) -> Iterable[str]:
    title = lambda t: f"{c['bold']}{c['label']}{t}:{c['off']}\n"
    bar = f"{c['bold']}{c['header']}{'=' * 60}"
    yield f"{bar}\n{c['bold']}{c['header']}                 BINARY DIFF REPORT{c['off']}\n{bar}\n\n"
    yield title("SUMMARY")
    for colour, name, value in (("good", "Total Matches", summary.total_matches), ("bad", "Unmatched Functions A", summary.unmatched_a), ("bad", "Unmatched Functions B", summary.unmatched_b), ("info", "Overall Similarity", f"{summary.similarity_score:.4f}")):
        yield f"  {c[colour]}{name}:{c['off']} {value}\n"
    yield "\n" + title("MATCH TYPE BREAKDOWN")
    for t in ("Exact", "Structural", "Heuristic", "Manual"):
        yield f"  {t} Matches: {summary[f'{t.lower()}_matches']}\n"
    yield "\n" + title("DETAILED MATCHES") + f"{c['line']}{RULE}{c['off']}\n"
    for n, r in enumerate(report_order(results.withColumn("text", match_text(c))).toLocalIterator(prefetchPartitions=True), 1):
        yield f"{c['bold']}{n}. {r.text}\n"
    for label, rest in (("A", unmatched_a), ("B", unmatched_b)):
        rows = list(rest.orderBy("idx").toLocalIterator())
        if rows:
            yield f"UNMATCHED FUNCTIONS IN BINARY {label}:\n{c['line']}{RULE}{c['off']}\n"
            yield from (f"  {r['name']} (0x{int(r.address):x}) - {int(r.size)} bytes, {r.n_bb} BBs\n" for r in rows)
            yield "\n"


def match_text(c: dict = PLAIN) -> Column:
    """What a report says of a match, below its number."""
    text = lambda x: F.col(x).cast("decimal(20,0)").cast("string")
    band = text_band(F.col("confidence"))
    paint = lambda k, v: F.concat(F.lit(c[k]), v, F.lit(c["off"]))
    banded = lambda v: F.concat(F.when(band == "high", c["high"]).when(band == "medium", c["medium"]).otherwise(c["low"]), v, F.lit(c["off"]))
    kind = F.coalesce(*[F.when(F.col("match_type") == t, paint(t, F.col("match_type"))) for t in ("Exact", "Structural", "Heuristic", "Manual")], F.col("match_type"))
    parts = [
        F.lit(c["good"]), F.col("name_a"), F.lit(" <-> "), F.col("name_b"), F.lit(c["off"] + "\n   Addresses: "),
        paint("info", hex_address(F.col("address_a"))), F.lit(" <-> "), paint("info", hex_address(F.col("address_b"))),
        F.lit("\n   Similarity: "), banded(formatted(F.col("similarity"), ".4f")), F.lit(" | Confidence: "), banded(formatted(F.col("confidence"), ".4f")), F.lit(" | Type: "), kind,
        F.lit("\n   Size: "), text("size_a"), F.lit(" bytes <-> "), text("size_b"), F.lit(" bytes\n   Basic Blocks: "), text("bb_a"), F.lit(" <-> "), text("bb_b"),
        F.lit("\n   Instructions: "), text("instr_a"), F.lit(" <-> "), text("instr_b"), F.lit("\n"),
    ]
    return F.concat(*parts)


#: Widths of the boxed table's columns.
WIDTHS = (29, 29, 10, 10, 10, 6, 6, 4, 4)


def table_lines(results: DataFrame) -> DataFrame:
    """(seq, line): rows of the boxed table; long names are cut."""
    count = lambda x: F.col(x).cast("decimal(20,0)").cast("string")
    cells = [cut_name(F.col("name_a")), cut_name(F.col("name_b")), formatted(F.col("similarity"), ".4f"), formatted(F.col("confidence"), ".4f"), F.col("match_type"), *map(count, ("size_a", "size_b", "bb_a", "bb_b"))]
    return results.select("seq", F.concat(F.lit("│ "), F.concat_ws(" │ ", *[padded(c, w) for c, w in zip(cells, WIDTHS)]), F.lit(" │")).alias("line"))


def summary_table(results: DataFrame) -> str:
    """A boxed table; long names are cut."""
    width = 149
    line = lambda left, right: left + "─" * width + right + "\n"
    cells = lambda v: "│ " + " │ ".join(f"{x:<{w}}" for x, w in zip(v, WIDTHS)) + " │\n"
    out = [line("┌", "┐"), "│" + "FUNCTION MATCHES".center(120) + "│\n", line("├", "┤"), cells(("Function A", "Function B", "Similarity", "Confidence", "Type", "Size A", "Size B", "BB A", "BB B")), line("├", "┤")]
    out += [r.line + "\n" for r in table_lines(results).orderBy("seq").toLocalIterator(prefetchPartitions=True)]
    return "".join([*out, line("└", "┘")])


def listing_lines(results: DataFrame) -> DataFrame:
    """(n, line, band): numbered by similarity, highest first."""
    n = F.col("n").cast("bigint")
    line = F.concat(n.cast("string"), F.lit(". "), F.col("name_a"), F.lit(" <-> "), F.col("name_b"), F.lit(" (similarity: "), formatted(F.col("similarity"), ".3f"), F.lit(", confidence: "), formatted(F.col("confidence"), ".3f"), F.lit(")"))
    return numbered(results).select(n.alias("n"), line.alias("line"), log_band(F.col("similarity")).alias("band"))


def log_listing(results: DataFrame) -> str:
    """Numbered, by similarity, with counts of the three bands."""
    bands, out = {"high": 0, "medium": 0, "low": 0}, []
    for r in listing_lines(results).orderBy("n").toLocalIterator(prefetchPartitions=True):
        out.append(r.line + "\n")
        bands[r.band] += 1
    return "".join([*out, *(f"{k}: {v}\n" for k, v in bands.items())])


def block_lines(blocks: DataFrame) -> DataFrame:
    """(idx_a, idx_b, block, line): rows of results.pair_blocks as a comparison shows them."""
    shown = lambda at, n: F.when(F.col(at).isNull(), "<missing>").otherwise(F.concat(hex_address(F.col(at)), F.lit(" ("), F.col(n).cast("string"), F.lit(" instrs)")))
    return blocks.select("idx_a", "idx_b", "block", F.concat(F.lit("  Block "), F.col("block").cast("string"), F.lit(": "), shown("address_a", "instr_a"), F.lit(" | "), shown("address_b", "instr_b")).alias("line"))


def statistics_text(s: Row) -> str:
    """A diff's statistics, one fact a line."""
    facts = [("Total Matches", s.total_matches), *((f"  - {t}", s[f"{t.lower()}_matches"]) for t in ("Exact", "Structural", "Heuristic", "Manual"))]
    facts += [("Average Similarity", f"{s.similarity_score:.4f}"), ("Average Confidence", f"{s.average_confidence:.4f}"), ("Unmatched Functions A", s.unmatched_a), ("Unmatched Functions B", s.unmatched_b)]
    return "=== Diff Statistics ===\n" + "".join(f"{k}: {v}\n" for k, v in facts)


def print_statistics(s: Row) -> None:
    print(statistics_text(s), end="")


def block_listing(name_a: str, name_b: str, blocks: DataFrame, facts: dict) -> str:
    """Blocks of a pair side by side (rows of results.pair_blocks), then instruction and complexity counts."""
    n = blocks.agg(F.count("address_a").alias("a"), F.count("address_b").alias("b")).first()
    out = [f"Function Comparison: {name_a} vs {name_b}\n{'=' * 50}\nBasic Block Comparison:\n", f"  Function A: {n['a']} blocks\n  Function B: {n['b']} blocks\n"]
    out += [r.line + "\n" for r in block_lines(blocks).orderBy("block").toLocalIterator()]
    out.append(f"\nInstruction Statistics:\n  Function A: {facts['instr_a']} instructions\n  Function B: {facts['instr_b']} instructions\n  Complexity A: {facts['complexity_a']}\n  Complexity B: {facts['complexity_b']}\n")
    return "".join(out)


def progress_bar(done: int, total: int, width: int) -> str:
    if total == 0:
        return ""
    full = int(done / total * width)
    return f"[{'█' * full}{'░' * (width - full)}] {done}/{total} ({done / total * 100:.1f}%)"


def status_line(similarity: Column) -> Column:
    return F.concat(F.lit("Similarity: "), formatted(similarity, ".2%"))
