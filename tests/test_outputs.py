import json
import sqlite3
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from pairwright.operators import features, matching, results, textdiff
from pairwright.plans import document
from pairwright.sinks import exports, reports
from pairwright.sources import programs

ROWS = [
    (1, "main", 0x1000, "=cmd", 0x2000, 0.62345, 0.98, "Exact", 200, 200, 1, 2, 3, 4),
    (2, "it's,\"<x>", 0, "x" * 40, 2**64 - 1, 0.00015, 0.5, "Structural", 50, 60, 1, 1, 1, 1),
]


@pytest.fixture(scope="module")
def view(spark):
    schema = "n long, name_a string, address_a decimal(20,0), name_b string, address_b decimal(20,0), similarity double, confidence double, match_type string, size_a decimal(20,0), size_b decimal(20,0), bb_a long, bb_b long, instr_a long, instr_b long"
    rows = [(r[0], r[1], Decimal(r[2]), r[3], Decimal(r[4]), *r[5:8], Decimal(r[8]), Decimal(r[9]), *r[10:]) for r in ROWS]
    return spark.createDataFrame(rows, schema).withColumn("seq", F.struct(F.lit(1).alias("phase"), F.col("n").alias("idx_a"))).drop("n")


def test_csv(view, tmp_path):
    exports.to_csv(view, str(tmp_path / "a.csv"))
    lines = (tmp_path / "a.csv").read_bytes().decode().split("\r\n")
    assert lines[1] == "main,0x0000000000001000,'=cmd,0x0000000000002000,0.6234,0.9800,Exact,200,200,1,2,3,4"
    assert lines[2].startswith('"it\'s,""<x>",0x0000000000000000,') and ",0.0001,0.5000," in lines[2]
    exports.to_csv(view, str(tmp_path / "b.csv"), compat=True)
    assert (tmp_path / "b.csv").read_text().split("\n")[1] == "main,1000,=cmd,2000,0.6234,0.9800,Exact,200,200,1,2,3,4"


def test_sql_script_and_sqlite(view, tmp_path):
    exports.to_sql_script(view, str(tmp_path / "a.sql"))
    con = sqlite3.connect(":memory:")
    con.executescript((tmp_path / "a.sql").read_text())
    assert con.execute("select function_a_name, function_b_address, similarity from function_matches order by id").fetchall() == [("main", "0x0000000000002000", 0.6234), ("it's,\"<x>", "0x" + "f" * 16, 0.0001)]
    for _ in range(2):
        exports.to_sqlite(view, str(tmp_path / "a.db"))
    con = sqlite3.connect(tmp_path / "a.db")
    assert con.execute("select count(*), max(similarity) from function_matches").fetchone() == (4, 0.62345)


def test_json_and_html(view, tmp_path):
    exports.to_json(view, str(tmp_path / "a.json"), "a.exe", "b.exe")
    doc = json.loads((tmp_path / "a.json").read_text())
    assert doc["metadata"]["total_results"] == 2 and doc["results"][1]["function_b"]["address"] == 2**64 - 1
    exports.to_html(view, str(tmp_path / "a.html"), "a<", "b")
    page = (tmp_path / "a.html").read_text()
    assert "&lt;x&gt;" in page and 'class="high-confidence"' in page and 'class="medium-confidence"' in page
    exports.to_html(view, str(tmp_path / "b.html"), escape=False)
    assert "<x>" in (tmp_path / "b.html").read_text()
    side = lambda s: view.select(F.col(f"name_{s}").alias("name"), F.col(f"address_{s}").alias("address"), F.col(f"size_{s}").alias("size"), F.col(f"bb_{s}").alias("n_bb"), F.col(f"instr_{s}").alias("n_instr"), F.lit("mov").alias("code"))
    exports.pair_to_json(str(tmp_path / "p.json"), view, side("a"), side("b"), 0x1000, 0x2000)
    doc = json.loads((tmp_path / "p.json").read_text())
    assert doc["match_info"]["match_type"] == "Exact" and doc["function_a"] == {"name": "main", "address": "0x1000", "size": 200, "basic_blocks_count": 1, "instructions_count": 3, "code": "mov"}
    exports.pair_to_json(str(tmp_path / "p.json"), view, side("a"), side("b"), 0x1000, 2)
    doc = json.loads((tmp_path / "p.json").read_text())
    assert "match_info" not in doc and doc["function_a"]["instructions_count"] == 3 and doc["function_b"]["basic_blocks_count"] == 0
    exports.to_json(view.limit(0), str(tmp_path / "e.json"))
    assert json.loads((tmp_path / "e.json").read_text())["results"] == []
    exports.write_lines(exports.csv_lines(view), str(tmp_path / "lines"))
    assert "".join(p.read_text() for p in sorted((tmp_path / "lines").glob("part-*"))).startswith("main,0x0000000000001000,")


def test_filters_and_sorts(view):
    names = lambda df: [r.name_a for r in df.collect()]
    assert names(results.filter_results(view)) == ["main", "it's,\"<x>"]
    assert names(results.filter_results(view, "Exact")) == ["main"]
    assert names(results.filter_results(view, similarity="0.1", confidence="junk")) == ["main"]
    assert names(results.filter_results(view, needle="XXX")) == ["it's,\"<x>"]
    assert names(results.sort_results(view, 3)) == ["it's,\"<x>", "main"]
    assert names(results.sort_results(view, 2, descending=True)) == ["main", "it's,\"<x>"]
    assert results.find_pair(view, 0x1000, 0x2000).count() == 1


def test_reports_and_document(spark, tmp_path):
    program = programs.fixture_program(spark)
    f = features.extract_features(program)
    d = matching.diff(spark, f, f.where("idx < 6"))
    v = results.results_view(d.matches, d.features_a, d.features_b)
    text = reports.text_report(v, d.unmatched_a, d.unmatched_b, matching.summary(d).first())
    assert "Total Matches: 6" in text and "UNMATCHED FUNCTIONS IN BINARY A" in text and "IN BINARY B" not in text
    assert "\x1b[36m" in reports.text_report(v, d.unmatched_a, d.unmatched_b, matching.summary(d).first(), colour=True)
    assert reports.summary_table(v).count("\n") == 12 and "1. " in reports.log_listing(v)
    assert reports.progress_bar(1, 4, 8) == "[██░░░░░░] 1/4 (25.0%)" and reports.progress_bar(1, 0, 8) == ""
    document.save_document(d, program, program.where("idx < 6"), "a", "b", str(tmp_path / "d.json"))
    doc = exports.load_diff(str(tmp_path / "d.json"))
    assert (len(doc["functions_a"]), len(doc["functions_b"]), doc["metadata"]["total_matches"]) == (8, 6, 6)
    assert [f["name"] for f in doc["functions_a"]][-2:] == ["cleanup_function", "process_data"] and doc["functions_a"][0]["instructions"][0]["mnemonic"] == "push"
    back = document.matches_of(spark, doc)
    assert [r.function_a["name"] for r in back.orderBy("seq").collect()] == ["main", "printf", "malloc", "strcmp", "memcpy", "init_function"]
    document.save_result(d, program, program.where("idx < 6"), "a", "b", str(tmp_path / "r.json"))
    result = json.loads((tmp_path / "r.json").read_text())
    assert len(result["matched_functions"]) == 6 and len(result["unmatched_functions_a"]) == 2 and result["similarity_score"] == document.similarity_score(d) == 1.0
    assert (document.match_count(d), document.match_count(None), document.similarity_score(None)) == (6, 0, 0.0)
    (tmp_path / "bad.json").write_text("{}")
    with pytest.raises(ValueError):
        exports.load_diff(str(tmp_path / "bad.json"))
    del doc["metadata"]["plugin_version"]
    (tmp_path / "bad.json").write_text(json.dumps(doc))
    with pytest.raises(ValueError, match="plugin_version"):
        exports.load_diff(str(tmp_path / "bad.json"))


def test_text_diffs(spark):
    df = spark.createDataFrame([("p", "a\nb\nc", "a\nx\nc\nd"), ("q", None, "z")], "id string, a string, b string")
    ops = textdiff.diff_lines(df, textdiff.Opcodes, "a", "b").where("id = 'p'").select("tag", "i1", "i2", "j1", "j2").collect()
    assert [tuple(r) for r in ops] == [("equal", 0, 1, 0, 1), ("replace", 1, 2, 1, 2), ("equal", 2, 3, 2, 3), ("insert", 3, 3, 3, 4)]
    side = textdiff.diff_lines(df, textdiff.SideBySide, "a", "b").where("id = 'p'").orderBy("n").collect()
    assert [(r.line_a, r.line_b) for r in side] == [(1, 1), (2, 2), (3, 3), (None, 4)]
    uni = textdiff.diff_lines(df.withColumns({"x": F.lit("f"), "y": F.lit("g")}), textdiff.UnifiedDiff, "a", "b", "x", "y").where("id = 'p'").orderBy("n").collect()
    assert uni[0].line == "--- Binary A - f" and {r.kind for r in uni} == {"file", "hunk", "context", "added", "removed"}


def test_defaults_and_stream(spark, tmp_path):
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "a.json").write_text(json.dumps([{"idx": 0, "name": "f", "extra": 1}, {"idx": 1}]))
    p = programs.read_program(spark, str(tmp_path / "p"), "json")
    rows = {r.idx: r for r in features.extract_features(p).collect()}
    assert rows[1]["name"] == "" and rows[0].n_bb == 0 and rows[0].is_auto is False and rows[1].is_auto is True
    from pairwright.streaming import stream_features

    programs.fixture_program(spark).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(programs.fixture_program(spark).schema).parquet(str(tmp_path / "in"))
    stream_features(stream, str(tmp_path / "out"), str(tmp_path / "ck")).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 8


def test_cells_and_first_row(view):
    cells = [tuple(r)[1:] for r in results.table_cells(view, results.MODEL_COLUMNS).orderBy("seq").collect()]
    assert cells[0][:7] == ("main", "0x1000", "=cmd", "0x2000", "0.6234", "0.9800", "Exact")
    assert [r.name_a for r in results.first_row(view).collect()] == ["main"]
    table = results.SortedTable()
    names = lambda: [r.name_a for r in table.rows(view).collect()]
    assert names() == ["main", "it's,\"<x>"] and table.click(7) and names() == ["it's,\"<x>", "main"]
    assert table.click(7).done == [(7, True)] and names() == ["main", "it's,\"<x>"]
    assert table.click(9).done == [(9, False), (7, True)] and table.click(7).done == [(7, False), (9, False)]
    assert table.reset().done == []
    assert [r.name_a for r in results.sort_results(view, 0, order=results.MODEL_COLUMNS, fold_case=False).collect()][0] == "it's,\"<x>"


def test_cancelling_a_tag_stops_its_jobs(spark):
    import threading
    import time

    from pairwright.plans import control

    failed = []

    def run():
        with control.cancellable(spark, "t1"):
            try:
                spark.range(0, 4000, 1, 4000).repartition(4000, "id").selectExpr("sum(hash(id))").collect()
                for _ in range(500):
                    spark.range(10**8).selectExpr("sum(hash(id))").collect()
            except Exception as e:
                failed.append(e)

    t = threading.Thread(target=run)
    t.start()
    deadline = time.time() + 30
    while t.is_alive() and time.time() < deadline:
        time.sleep(0.3)
        control.cancel(spark, "t1")
    t.join(5)
    assert failed and not t.is_alive()


def test_places_over_all_rows(spark):
    df = spark.range(0, 5000, 1, 7).select((F.col("id") * 7919 % 5003).alias("k"), "id")
    got = results.ranked(df, F.desc("k"), "id").collect()
    assert [r.k for r in sorted(got, key=lambda r: r.n)] == sorted((r.k for r in got), reverse=True)
    assert sorted(r.n for r in got) == list(range(1, 5001))
    assert results.ranked(df.limit(0), "k").count() == 0
