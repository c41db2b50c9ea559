"""Line diffs of two texts, as table functions to be joined laterally; they need a sequence matcher, so they are Python."""

from __future__ import annotations

import difflib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf


@udtf(returnType="tag string, i1 int, i2 int, j1 int, j2 int")
class Opcodes:
    """Runs of equal, replaced, deleted and inserted lines."""

    def eval(self, a: str, b: str):
        for tag, i1, i2, j1, j2 in difflib.SequenceMatcher(None, (a or "").split("\n"), (b or "").split("\n")).get_opcodes():
            yield tag, i1, i2, j1, j2


@udtf(returnType="n int, tag string, line_a int, text_a string, line_b int, text_b string")
class SideBySide:
    """Rows for two panes. Deleted and inserted lines leave the other side empty; replaced runs are not padded."""

    def eval(self, a: str, b: str):
        x, y = (a or "").split("\n"), (b or "").split("\n")
        n = 0
        for tag, i1, i2, j1, j2 in difflib.SequenceMatcher(None, x, y).get_opcodes():
            for k in range(max(i2 - i1, j2 - j1)):
                i, j = i1 + k, j1 + k
                left = (i + 1, x[i]) if i < i2 else (None, None)
                right = (j + 1, y[j]) if j < j2 else (None, None)
                yield n, tag, *left, *right
                n += 1


@udtf(returnType="n int, kind string, line string")
class UnifiedDiff:
    """Lines of a unified diff with three lines of context."""

    def eval(self, a: str, b: str, name_a: str, name_b: str):
        lines = difflib.unified_diff((a or "").split("\n"), (b or "").split("\n"), f"Binary A - {name_a}", f"Binary B - {name_b}", lineterm="")
        for n, line in enumerate(lines):
            kind = "file" if line.startswith(("+++", "---")) else {"+": "added", "-": "removed"}.get(line[:1], "hunk" if line.startswith("@@") else "context")
            yield n, kind, line


def diff_lines(pairs: DataFrame, table_function, *columns: str) -> DataFrame:
    """pairs joined laterally with one of the functions above over its text columns."""
    return pairs.lateralJoin(table_function(*[F.col(c).outer() for c in columns]))


def escape_html(c: Column) -> Column:
    for old, new in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), (" ", "&nbsp;"), ("\t", "&nbsp;" * 4)):
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


#: The text forms of a function; the first stands in for a missing one.
MODES = ("Disassembly", "Low Level IL", "Medium Level IL", "High Level IL", "Pseudo-C")


def function_text(mode: str, columns: dict[str, str]) -> Column:
    """The text column of a mode, else the disassembly, else a note. columns: mode to column name."""
    if mode not in MODES:
        raise ValueError(f"no such text form: {mode}")
    return F.coalesce(*[F.col(columns[m]) for m in dict.fromkeys((mode, MODES[0])) if m in columns], F.lit("No text available"))


def pair_view(pairs: DataFrame, mode: str, columns_a: dict[str, str], columns_b: dict[str, str], unified: bool = False) -> DataFrame:
    """The diff of each pair in one of the text forms, side by side or unified (which needs name_a and name_b).

    A pair of which a side is missing (null idx) has no view.
    """
    texts = pairs.where(F.col("idx_a").isNotNull() & F.col("idx_b").isNotNull()).withColumns({"text_of_a": function_text(mode, columns_a), "text_of_b": function_text(mode, columns_b)})
    if unified:
        return diff_lines(texts, UnifiedDiff, "text_of_a", "text_of_b", "name_a", "name_b").select("idx_a", "idx_b", "n", "kind", "line")
    return diff_lines(texts, SideBySide, "text_of_a", "text_of_b").select("idx_a", "idx_b", "n", "tag", "line_a", "text_a", "line_b", "text_b")
