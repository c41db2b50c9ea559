"""File sinks. Lines are made by the executors and streamed to one file, or written by them side by side.

Numbers are formatted in Python, from the exact double. No sink holds more than one partition of lines on the driver.
"""

from __future__ import annotations

import json
import sqlite3
import textwrap
from collections.abc import Iterable, Iterator
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from ..functions.kernels import html_band
from ..functions.text import csv_field, formatted, formula_safe, hex_address, html_text, sql_text

#: Titles of the exported columns.
HEADER = ("Function A", "Address A", "Function B", "Address B", "Similarity", "Confidence", "Match Type", "Size A", "Size B", "BB Count A", "BB Count B", "Instr Count A", "Instr Count B")
SQL_COLUMNS = ("function_a_name", "function_a_address", "function_b_name", "function_b_address", "similarity", "confidence", "match_type", "size_a", "size_b", "bb_count_a", "bb_count_b", "instr_count_a", "instr_count_b")
SQL_TYPES = ("TEXT", "TEXT", "TEXT", "TEXT", "REAL", "REAL", "TEXT", *["INTEGER"] * 6)
COUNTS = ("size_a", "size_b", "bb_a", "bb_b", "instr_a", "instr_b")


def _rows(results: DataFrame) -> Iterable[Row]:
    return results.orderBy("seq").toLocalIterator(prefetchPartitions=True)


def _counts(r: Row) -> tuple:
    return int(r.size_a), int(r.size_b), r.bb_a, r.bb_b, r.instr_a, r.instr_b


# ---------------------------------------------------------------- lines


def _scores() -> list[Column]:
    return [formatted(F.col(c), ".4f") for c in ("similarity", "confidence")]


def _texts(address, name) -> list[Column]:
    counts = [F.col(c).cast("decimal(20,0)").cast("string") for c in COUNTS]
    return [name(F.col("name_a")), address(F.col("address_a")), name(F.col("name_b")), address(F.col("address_b")), *_scores(), name(F.col("match_type")), *counts]


def csv_lines(results: DataFrame, compat: bool = False) -> DataFrame:
    """(seq, line): quoted, with guarded names and full addresses; `compat` has bare fields and short addresses instead."""
    bare = lambda c: F.coalesce(c, F.lit(""))
    cells = _texts(lambda c: hex_address(c, prefix=""), bare) if compat else _texts(lambda c: hex_address(c, 16), lambda c: csv_field(formula_safe(c)))
    return results.select("seq", F.concat_ws(",", *cells).alias("line"))


def insert_lines(results: DataFrame) -> DataFrame:
    """(seq, line): one INSERT for each match."""
    quoted = lambda c: F.concat(F.lit("'"), hex_address(c, 16), F.lit("'"))
    head = f"INSERT INTO function_matches ({', '.join(SQL_COLUMNS)}) VALUES ("
    return results.select("seq", F.concat(F.lit(head), F.concat_ws(", ", *_texts(quoted, sql_text)), F.lit(");")).alias("line"))


def html_lines(results: DataFrame, escape: bool = True) -> DataFrame:
    """(seq, line): one table row for each match, its class by confidence."""
    cells = _texts(lambda c: hex_address(c, 16), html_text if escape else lambda c: c)[:7]
    body = F.concat(*[x for c in cells for x in (F.lit("<td>"), c, F.lit("</td>"))])
    return results.select("seq", F.concat(F.lit('<tr class="'), html_band(F.col("confidence")), F.lit('">'), body, F.lit("</tr>")).alias("line"))


def records(results: DataFrame) -> DataFrame:
    """(seq, record): matches as nested records, as the JSON sinks write them."""
    side = lambda s: F.struct(F.col(f"name_{s}").alias("name"), F.col(f"address_{s}").cast("decimal(20,0)").alias("address"), F.col(f"size_{s}").cast("decimal(20,0)").alias("size"), F.col(f"bb_{s}").alias("basic_blocks"), F.col(f"instr_{s}").alias("instructions"))
    return results.select("seq", F.struct(side("a").alias("function_a"), side("b").alias("function_b"), "similarity", "confidence", "match_type").alias("record"))


def gui_record(results: DataFrame) -> DataFrame:
    """One row: the whole result as a viewer loads it. Times are 0, leftovers are left empty, instructions too.

    One nested value by definition; for results of a size that a person looks at.
    """
    side = lambda s: F.struct(F.col(f"name_{s}").alias("name"), F.col(f"address_{s}").cast("bigint").alias("address"), F.col(f"size_{s}").cast("bigint").alias("size"), F.col(f"bb_{s}").alias("basic_blocks"), F.array().cast("array<string>").alias("instructions"))
    one = F.struct("seq", side("a").alias("function_a"), side("b").alias("function_b"), "similarity", "confidence", "match_type")
    listed = F.transform(F.array_sort(F.collect_list(one)), lambda x: x.dropFields("seq"))
    none = F.array().cast("array<string>")
    return results.agg(listed.alias("matched_functions")).withColumns({"unmatched_functions_a": none, "unmatched_functions_b": none, "similarity_score": F.coalesce(F.aggregate("matched_functions", F.lit(0.0), lambda s, x: s + x["similarity"]) / F.nullif(F.size("matched_functions"), F.lit(0)), F.lit(0.0)), "analysis_time": F.lit(0.0)})


def write_lines(lines: DataFrame, folder: str) -> None:
    """Side by side by the executors, in ranges of seq: part files in order, whatever the size of the result."""
    lines.repartitionByRange("seq").sortWithinPartitions("seq").select("line").write.text(folder)


def _stream(lines: DataFrame) -> Iterator[str]:
    return (r.line for r in _rows(lines))


# ---------------------------------------------------------------- files


def to_csv(results: DataFrame, path: str, compat: bool = False) -> None:
    end = "\n" if compat else "\r\n"
    with open(path, "w", newline="", encoding="utf-8") as f:
        f.write(",".join(HEADER) + end)
        f.writelines(line + end for line in _stream(csv_lines(results, compat)))


def _table() -> str:
    columns = ",\n".join(["    id INTEGER PRIMARY KEY AUTOINCREMENT", *(f"    {c} {t}" for c, t in zip(SQL_COLUMNS, SQL_TYPES)), "    created_at TIMESTAMP DEFAULT CURRENT_TIMESTAMP"])
    return f"CREATE TABLE IF NOT EXISTS function_matches (\n{columns}\n);\n"


def to_sql_script(results: DataFrame, path: str) -> None:
    with open(path, "w", encoding="utf-8") as f:
        f.write(_table() + "\n")
        f.writelines(line + "\n" for line in _stream(insert_lines(results)))


def fill_sqlite(con: sqlite3.Connection, results: DataFrame) -> None:
    """Appends to the table of an open database, which is made if need be; doubles in full."""
    with con:
        con.execute(_table())
        marks = ", ".join("?" * len(SQL_COLUMNS))
        rows = ((r.name_a, f"0x{int(r.address_a):016x}", r.name_b, f"0x{int(r.address_b):016x}", r.similarity, r.confidence, r.match_type, *_counts(r)) for r in _rows(results))
        con.executemany(f"INSERT INTO function_matches ({', '.join(SQL_COLUMNS)}) VALUES ({marks})", rows)


def to_sqlite(results: DataFrame, path: str) -> None:
    """Appends on a second run."""
    con = sqlite3.connect(path)
    fill_sqlite(con, results)
    con.close()


def _plain(v):
    """Rows and decimals as JSON has them."""
    return {k: _plain(x) for k, x in v.asDict().items()} if isinstance(v, Row) else int(v) if type(v).__name__ == "Decimal" else v


def _listed(items: Iterable) -> Iterator[str]:
    """A JSON list at depth one of an indented document, item by item."""
    first = True
    for x in items:
        yield ("[\n" if first else ",\n") + textwrap.indent(json.dumps(x, indent=2, ensure_ascii=False), "    ")
        first = False
    yield "[]" if first else "\n  ]"


def to_json(results: DataFrame, path: str, binary_a: str = "", binary_b: str = "") -> None:
    """Metadata and results; not only ASCII."""
    meta = {"export_time": datetime.now(UTC).isoformat(), "total_results": results.count(), "binary_a": binary_a, "binary_b": binary_b}
    with open(path, "w", encoding="utf-8") as f:
        f.write('{\n  "metadata": ' + textwrap.indent(json.dumps(meta, indent=2, ensure_ascii=False), "  ").lstrip() + ',\n  "results": ')
        f.writelines(_listed(_plain(r.record) for r in _rows(records(results))))
        f.write("\n}")


def pair_document(results: DataFrame, a: DataFrame, b: DataFrame, address_a: int, address_b: int, view: str = "Disassembly", mode: str = "Side-by-Side", binary_a: str = "N/A", binary_b: str = "N/A") -> dict:
    """One pair: both sides with their counts and texts, whether they match or not, and the first match of the two.

    a, b: rows with name, address, size, n_bb, n_instr and code; an address that is not there has empty counts.
    """
    from ..operators.results import find_pair

    def side(f: DataFrame, at: int) -> dict:
        r = f.where(F.col("address") == at).select("name", "size", "n_bb", "n_instr", "code").first()
        return {"name": r["name"] if r else "Unknown", "address": f"0x{at:x}", "size": int(r["size"]) if r else 0, "basic_blocks_count": r["n_bb"] if r else 0, "instructions_count": r["n_instr"] if r else 0, "code": r["code"] if r else f"Function not found at address 0x{at:x}"}

    meta = {"export_time": datetime.now(UTC).isoformat(), "view_mode": view, "diff_mode": mode, "binary_a": binary_a, "binary_b": binary_b}
    doc = {"metadata": meta, "function_a": side(a, address_a), "function_b": side(b, address_b)}
    found = find_pair(results, address_a, address_b).first()
    return doc | ({"match_info": {k: found[k] for k in ("similarity", "confidence", "match_type")}} if found else {})


def pair_to_json(path: str, *args, **kwargs) -> None:
    Path(path).write_text(json.dumps(pair_document(*args, **kwargs), indent=2, ensure_ascii=False), encoding="utf-8")


def to_html(results: DataFrame, path: str, binary_a: str = "", binary_b: str = "", totals: tuple[int, int] | None = None, escape: bool = True) -> None:
    """A report with a summary and a banded table; names are escaped unless told not to."""
    import html

    safe = html.escape if escape else str
    n = results.count()
    n_a, n_b = totals or (n, n)
    facts = (("Binary A", safe(binary_a)), ("Binary B", safe(binary_b)), ("Total Functions A", n_a), ("Total Functions B", n_b), ("Total Matches", n), ("Created", datetime.now(UTC).isoformat()))
    style = ".high-confidence{background:#cfc}.medium-confidence{background:#ffc}.low-confidence{background:#fcc}td,th{border:1px solid #ccc;padding:4px}"
    head = ["<!DOCTYPE html>", f'<html><head><meta charset="utf-8"><title>Binary Diff Report</title><style>{style}</style></head><body>', "<h1>Binary Diff Report</h1>", *(f"<p><b>{k}:</b> {v}</p>" for k, v in facts), "<table>", "<tr>" + "".join(f"<th>{h}</th>" for h in HEADER[:7]) + "</tr>"]
    with open(path, "w", encoding="utf-8") as f:
        f.writelines(x + "\n" for x in head)
        f.writelines(x + "\n" for x in _stream(html_lines(results, escape)))
        f.write("</table></body></html>")


# ---------------------------------------------------------------- whole diffs


#: What a stored diff must have, and its metadata; a file without one of them is an error.
REQUIRED = ("binary_a_path", "binary_b_path", "functions_a", "functions_b", "matches", "metadata")
REQUIRED_METADATA = ("created_at", "plugin_version", "binary_a_hash", "binary_b_hash", "total_functions_a", "total_functions_b", "total_matches", "analysis_time_seconds")


def save_diff(lists: dict[str, DataFrame], head: dict, metadata: dict, path: str) -> None:
    """A diff as one JSON document: fields of `head`, then lists of records (ord, body as JSON), then the metadata; streamed."""
    with open(path, "w", encoding="utf-8") as f:
        f.write("{\n" + "".join(f"  {json.dumps(k)}: {json.dumps(v)},\n" for k, v in head.items()))
        for name, rows in lists.items():
            f.write(f"  {json.dumps(name)}: ")
            f.writelines(_listed(json.loads(r.body) for r in rows.orderBy("ord").toLocalIterator(prefetchPartitions=True)))
            f.write(",\n")
        tail = metadata if "metadata" not in metadata else metadata["metadata"]
        f.write(("  \"metadata\": " + textwrap.indent(json.dumps(tail, indent=2), "  ").lstrip()) if "metadata" in metadata else ",\n".join(f"  {json.dumps(k)}: {json.dumps(v)}" for k, v in tail.items()))
        f.write("\n}")


def load_diff(path: str) -> dict:
    doc = json.loads(Path(path).read_text(encoding="utf-8"))
    missing = [k for k in REQUIRED if k not in doc] or [k for k in REQUIRED_METADATA if k not in doc["metadata"]]
    if missing:
        raise ValueError(f"missing fields: {', '.join(missing)}")
    return doc
