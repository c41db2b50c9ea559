"""Every query that SQL can express, against DuckDB over the smallest tables."""

import difflib
import glob
import os

import pytest

from pairwright.plans import registry

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def canonical(pdf):
    cell = lambda v: None if v is None or v != v else round(float(v), 5) if isinstance(v, (int, float)) and not isinstance(v, bool) else v
    cols = sorted(pdf.columns)
    return cols, sorted((tuple(cell(v.item() if hasattr(v, "item") else v) for v in row) for row in pdf[cols].itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_equals_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(p).split('.')[0]} as select * from '{p}'")
    assert canonical(registry.QUERIES[name](spark, SF).toPandas()) == canonical(con.execute(registry.ORACLES[name]).df())


def plain_side_by_side(a, b):
    """Both panes line by line, with numbers of their own."""
    out = []
    for tag, i1, i2, j1, j2 in difflib.SequenceMatcher(None, a, b).get_opcodes():
        left, right = [(i + 1, a[i]) for i in range(i1, i2)], [(j + 1, b[j]) for j in range(j1, j2)]
        n = max(len(left), len(right))
        out += [(tag, *x, *y) for x, y in zip(left + [(None, None)] * (n - len(left)), right + [(None, None)] * (n - len(right)))]
    return [(n, *row) for n, row in enumerate(out)]


def test_text_diffs_equal_a_plain_loop(spark):
    """SQL has no sequence matcher: the four queries of text diffs against the standard library, pair by pair."""
    texts = {r.idx_a: r for r in registry._texts(spark, SF).collect()}
    assert len(texts) > 5
    got = {n: {} for n in ("line_diff", "side_by_side", "unified_diff", "pair_view")}
    for n, own in got.items():
        for r in registry.QUERIES[n](spark, SF).collect():
            own.setdefault(r.idx_a, []).append(r)
    low = lambda t: "\n".join(x.split(" ")[0] for x in t.split("\n"))
    for i, r in texts.items():
        a, b = r.code_a.split("\n"), r.code_b.split("\n")
        assert sorted((x.tag, x.i1, x.i2, x.j1, x.j2) for x in got["line_diff"][i]) == sorted(difflib.SequenceMatcher(None, a, b).get_opcodes())
        assert sorted((x.n, x.tag, x.line_a, x.text_a, x.line_b, x.text_b) for x in got["side_by_side"][i]) == plain_side_by_side(a, b)
        heads = f"Binary A - {r.name_a}", f"Binary B - {r.name_b}"
        for name, left in (("unified_diff", a), ("pair_view", low(r.code_a).split("\n"))):
            assert [x.line for x in sorted(got[name].get(i, []), key=lambda x: x.n)] == list(difflib.unified_diff(left, b, *heads, lineterm=""))


def test_entry():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
