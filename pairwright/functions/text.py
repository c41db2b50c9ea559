"""Texts of numbers and names as the file formats want them."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def formatted(c: Column, spec: str) -> Column:
    """A number by a Python format, from the exact double: the JVM rounds half up on the shortest decimal instead."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for arr in batches:
            yield pa.array([None if v is None else format(v, spec) for v in arr.to_pylist()], pa.string())

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "string")(c.cast("double"))


def hex_address(c: Column, width: int = 0, prefix: str = "0x") -> Column:
    digits = F.lower(F.conv(c.cast("string"), 10, 16))
    return F.concat(F.lit(prefix), F.lpad(digits, width, "0") if width else digits)


def formula_safe(c: Column) -> Column:
    """A quote before what a spreadsheet would take for a formula; null is the empty text."""
    c = F.coalesce(c, F.lit(""))
    return F.when(c.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), c)).otherwise(c)


def csv_field(c: Column) -> Column:
    """Quoted where a comma, a quote or a line end is inside."""
    return F.when(c.rlike('[,"\\r\\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(c)


def sql_text(c: Column) -> Column:
    return F.concat(F.lit("'"), F.replace(F.coalesce(c, F.lit("")), F.lit("'"), F.lit("''")), F.lit("'"))


def html_text(c: Column) -> Column:
    """With the five signs escaped that mean something in HTML."""
    for old, new in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def padded(c: Column, width: int) -> Column:
    """To at least `width` characters, filled with blanks on the right; never cut."""
    return F.concat(c, F.repeat(F.lit(" "), F.greatest(F.lit(width) - F.char_length(c), F.lit(0))))
