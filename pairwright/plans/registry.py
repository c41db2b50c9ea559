"""Named queries of the engine and the SQL that says the same.

Queries run over two programs derived from `events` (see sources.programs) unless their name says otherwise; those of
one program take the whole table. Queries on pairs take the functions of both programs that share an address, or all
pairs of equal key. Names with `halves_` run over two coarse programs in which nearly everything is tied.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..functions import text as T
from ..operators import assignment, features, lite, matching, results, textdiff
from ..sinks import exports, reports
from ..sources import programs
from ..storage import all_stored, shared_folder, stored
from . import document
from . import oracle as O

QUERIES: dict = {}
ORACLES: dict = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def program(spark: SparkSession, sf: str, side: str) -> DataFrame:
    return programs.events_program(spark, sf, side)


def feats(spark: SparkSession, sf: str, side: str) -> DataFrame:
    return features.extract_features(program(spark, sf, side))


def both(spark: SparkSession, sf: str, of=None) -> tuple[DataFrame, DataFrame]:
    """Features of both sides, extracted once for a query that reads them several times."""
    return tuple(all_stored(spark, "features", *[(of or feats)(spark, sf, s) for s in "ab"]))


def aligned(spark: SparkSession, sf: str) -> DataFrame:
    """Feature structs a and b of functions at equal addresses."""
    a, b = feats(spark, sf, "a"), feats(spark, sf, "b")
    return matching.key_pairs(a, b, F.col("address"))


def r6(c):
    return F.round(c, 6)


def _on_all(columns: str) -> str:
    return f"{O.PROGRAM} SELECT {columns} FROM f WHERE side = 'w'"


@query("scan_functions", _on_all("idx, name, address::BIGINT AS address, size::BIGINT AS size, n_bb, n_instr, complexity, cfg AS cfg_hash, cg AS call_graph_hash"))
def scan_functions(spark, sf):
    return feats(spark, sf, "w").select("idx", "name", F.col("address").cast("bigint"), F.col("size").cast("bigint"), "n_bb", "n_instr", "complexity", "cfg_hash", "call_graph_hash")


@query("feature_extract", _on_all("idx, edges AS edges_total, edges AS edges_cfg, len(calls) AS n_calls, len(consts) AS n_constants, len(strs) AS n_strings, array_to_string(list_sort(calls), ',') AS calls, array_to_string(degs, ',') AS degrees, seq AS sequence"))
def feature_extract(spark, sf):
    f = feats(spark, sf, "w")
    n = lambda c: F.size(c).cast("bigint")
    return f.select("idx", "edges_total", "edges_cfg", n("calls").alias("n_calls"), n("constants").alias("n_constants"), n("strings").alias("n_strings"), F.array_join(F.array_sort("calls"), ",").alias("calls"), F.array_join(F.transform("degrees", lambda d: d.cast("string")), ",").alias("degrees"), "sequence")


@query("md_index", _on_all("idx, substr(sha256(size || ':' || n_bb || ':' || n_instr || ':' || complexity), 1, 16) AS md_index"))
def md_index(spark, sf):
    return feats(spark, sf, "w").select("idx", "md_index")


@query("primes_product", _on_all("idx, primes::VARCHAR AS primes_product"))
def primes_product(spark, sf):
    return feats(spark, sf, "w").select("idx", F.col("primes_product").cast("string"))


@query("fuzzy_hash", _on_all("idx, substr(sha256(shape || array_to_string(ms, '_') || '_'), 1, 16) AS fuzzy_hash"))
def fuzzy_hash(spark, sf):
    return feats(spark, sf, "w").select("idx", "fuzzy_hash")


@query("auto_name_filter", _on_all("idx, name") + " AND NOT regexp_matches(name, '^(sub_|SUB_|FUN_|fun_|loc_|fcn[.]|func_)') AND name NOT IN ('', 'unnamed')")
def auto_name_filter(spark, sf):
    return feats(spark, sf, "w").where(~F.col("is_auto")).select("idx", "name")


# ---------------------------------------------------------------- candidate pairs and matches


def _scores(df: DataFrame) -> DataFrame:
    return df.select("idx_a", "idx_b", r6(F.col("similarity")).alias("similarity"), r6(F.col("confidence")).alias("confidence"))


def _candidates(phase: int):
    return lambda spark, sf: _scores(matching.keyed_candidates(feats(spark, sf, "a"), feats(spark, sf, "b"), phase))


for _name, _phase in {"name_pairs": 2, "md_pairs": 3, "primes_pairs": 4, "degree_pairs": 5}.items():
    query(_name, f"{O.PROGRAM}{O.pairs(O.KEYED[_phase][0])} SELECT {O.SCORES} FROM p WHERE {O.GATE}")(_candidates(_phase))


@query("exact_match", f"{O.PROGRAM}{O.EXACT}{O.pairs('EXISTS (SELECT 1 FROM e WHERE e.idx_a = x.idx AND e.idx_b = y.idx)')} SELECT {O.SCORES}, 'Exact' AS match_type FROM p")
def exact_match(spark, sf):
    return _typed(matching.exact_matches(*both(spark, sf))).drop("phase")


_FREE = O.free("e")


def _typed(m: DataFrame) -> DataFrame:
    return m.select("phase", "idx_a", "idx_b", r6(F.col("similarity")).alias("similarity"), r6(F.col("confidence")).alias("confidence"), "match_type")


_MATCHES = "SELECT phase, idx_a, idx_b, round(sim, 6) AS similarity, round(conf, 6) AS confidence, match_type FROM "


def halves(spark: SparkSession, sf: str, side: str) -> DataFrame:
    return features.extract_features(programs.halves_program(spark, sf, side))


def _after_exact(spark, sf, of=feats):
    a, b = both(spark, sf, of)
    e = stored(spark, matching.exact_matches(a, b).select("idx_a", "idx_b"), "exact")
    return a.join(e.select(F.col("idx_a").alias("idx")), "idx", "left_anti"), b.join(e.select(F.col("idx_b").alias("idx")), "idx", "left_anti"), e


def _keyed(phase: int, of):
    def run(spark, sf):
        a, b, _ = _after_exact(spark, sf, of)
        return _typed(matching.keyed_matches(spark, a, b, phase))

    return run


for _name, _phase in {"name_match": 2, "md_match": 3, "primes_match": 4, "structural_match": 5}.items():
    for _prefix, _of, _program in (("", feats, O.PROGRAM), ("halves_", halves, O.HALVES)):
        query(_prefix + _name, f"{_program}{O.EXACT}{O.keyed(_phase, 'e')} {_MATCHES}m{_phase}")(_keyed(_phase, _of))


@query("fuzzy_pairs", f"{O.PROGRAM}{O.EXACT}{O.pairs(_FREE, blend=True)} SELECT {O.SCORES} FROM p WHERE {O.GATE}")
def fuzzy_pairs(spark, sf):
    a, b, _ = _after_exact(spark, sf)
    return _scores(matching.fuzzy_candidates(a, b))


def _fuzzy(of):
    def run(spark, sf):
        a, b, _ = _after_exact(spark, sf, of)
        return _typed(matching.fuzzy_matches(a, b))

    return run


query("fuzzy_match", f"{O.PROGRAM}{O.EXACT}{O.fuzzy('e')} {_MATCHES}m6")(_fuzzy(feats))
query("halves_fuzzy_match", f"{O.HALVES}{O.EXACT}{O.fuzzy('e')} {_MATCHES}m6")(_fuzzy(halves))


# ---------------------------------------------------------------- whole diffs


def _diff(spark, sf, of=feats):
    return matching.diff(spark, of(spark, sf, "a"), of(spark, sf, "b"))


_DIFF, _HALVES_DIFF = O.diff(O.PROGRAM), O.diff(O.HALVES)
_REST = "SELECT idx, name, address::BIGINT AS address FROM "
_SUMMARY = """ SELECT count(*) AS total_matches, count(*) FILTER (match_type = 'Exact') AS exact_matches, count(*) FILTER (match_type = 'Structural') AS structural_matches, count(*) FILTER (match_type = 'Heuristic') AS heuristic_matches, 0::BIGINT AS manual_matches,
round(coalesce(avg(sim), 0.0), 6) AS similarity_score, round(coalesce(avg(conf), 0.0), 6) AS average_confidence, (SELECT count(*) FROM ua) AS unmatched_a, (SELECT count(*) FROM ub) AS unmatched_b FROM m"""


def _whole(prefix: str, of, sql: str) -> None:
    rest = lambda f: f.select("idx", "name", F.col("address").cast("bigint"))
    query(f"{prefix}full_diff", f"{sql} {_MATCHES}m")(lambda spark, sf: _typed(_diff(spark, sf, of).matches))
    query(f"{prefix}unmatched_a", f"{sql} {_REST}ua")(lambda spark, sf: rest(_diff(spark, sf, of).unmatched_a))
    query(f"{prefix}unmatched_b", f"{sql} {_REST}ub")(lambda spark, sf: rest(_diff(spark, sf, of).unmatched_b))
    query(f"{prefix}summary", sql + _SUMMARY)(lambda spark, sf: matching.summary(_diff(spark, sf, of)).withColumns({c: r6(F.col(c)) for c in ("similarity_score", "average_confidence")}))


_whole("", feats, _DIFF)
_whole("halves_", halves, _HALVES_DIFF)


@query("statistics_text", f"""{_DIFF}, s AS ({_SUMMARY}) SELECT '=== Diff Statistics ===' || chr(10) || 'Total Matches: ' || total_matches || chr(10) || '  - Exact: ' || exact_matches || chr(10) || '  - Structural: ' || structural_matches || chr(10) || '  - Heuristic: ' || heuristic_matches || chr(10) || '  - Manual: ' || manual_matches || chr(10)
|| 'Average Similarity: ' || format('{{:.4f}}', similarity_score) || chr(10) || 'Average Confidence: ' || format('{{:.4f}}', average_confidence) || chr(10) || 'Unmatched Functions A: ' || unmatched_a || chr(10) || 'Unmatched Functions B: ' || unmatched_b || chr(10) AS text FROM s""")
def statistics_text(spark, sf):
    return spark.createDataFrame([(reports.statistics_text(QUERIES["summary"](spark, sf).first()),)], "text string")


_SAVED = _DIFF + ", o AS (SELECT row_number() OVER (ORDER BY phase, idx_a) - 1 AS place, * FROM m)"


def _halves_documents(spark, sf):
    p = {s: stored(spark, program(spark, sf, s), "program") for s in "ab"}
    return matching.diff(spark, *(features.extract_features(p[s]) for s in "ab")), p


@query("saved_matches", f"""{_SAVED} SELECT place AS seq, x.name AS name_a, y.name AS name_b, x.n_instr AS instr_a, y.n_bb AS bb_b, round(sim, 6) AS similarity, round(conf, 6) AS confidence, match_type FROM o JOIN f x ON x.side = 'a' AND x.idx = idx_a JOIN f y ON y.side = 'b' AND y.idx = idx_b""")
def saved_matches(spark, sf):
    """Matches written with both whole functions inside, and read again from the files."""
    d, p = _halves_documents(spark, sf)
    folder = shared_folder(spark, "saved")
    document.match_rows(d, p["a"], p["b"]).write.json(folder)
    back = document.read_matches(spark.read.schema("ord struct<phase: int, at: bigint>, body string").json(folder))
    one = lambda f, c: F.col(f"function_{f}.{c}")
    return document.in_order(back).select(F.col("seq").cast("bigint"), one("a", "name").alias("name_a"), one("b", "name").alias("name_b"), F.size(one("a", "instructions")).cast("bigint").alias("instr_a"), F.size(one("b", "basic_blocks")).cast("bigint").alias("bb_b"), r6(F.col("similarity")).alias("similarity"), r6(F.col("confidence")).alias("confidence"), "match_type")


@query("saved_functions", _SAVED + ", ".join([""] + [f"""{s} AS (SELECT '{s}' AS side, idx_{s} AS idx, place FROM o UNION ALL SELECT '{s}', idx, (SELECT count(*) FROM o) + row_number() OVER (ORDER BY idx) - 1 FROM u{s})""" for s in "ab"]) + " SELECT side, place AS seq, name, address::BIGINT AS address FROM (FROM a UNION ALL FROM b) JOIN f USING (side, idx)")
def saved_functions(spark, sf):
    """Both lists of functions of a stored diff: the matched ones in order, then the leftovers."""
    d, p = _halves_documents(spark, sf)
    name, address = F.get_json_object("body", "$.name").alias("name"), F.get_json_object("body", "$.address").cast("bigint").alias("address")
    lists = [document.in_order(document.function_rows(d, p[s], s)).select(F.lit(s).alias("side"), F.col("seq").cast("bigint"), name, address) for s in "ab"]
    return lists[0].unionByName(lists[1])


@query("exact_leftovers", f"{O.PROGRAM}{O.EXACT} SELECT side, idx, name FROM f WHERE (side = 'a' AND idx NOT IN (SELECT idx_a FROM e)) OR (side = 'b' AND idx NOT IN (SELECT idx_b FROM e))")
def exact_leftovers(spark, sf):
    a, b, _ = _after_exact(spark, sf)
    return a.select(F.lit("a").alias("side"), "idx", "name").unionByName(b.select(F.lit("b").alias("side"), "idx", "name"))


_EXACT_PAIRS = O.pairs("EXISTS (SELECT 1 FROM e WHERE e.idx_a = x.idx AND e.idx_b = y.idx)")


@query("statistics", f"{O.PROGRAM}{O.EXACT}{_EXACT_PAIRS} SELECT count(*) AS total_matches, count(*) AS exact_matches, 0::BIGINT AS structural_matches, 0::BIGINT AS heuristic_matches, 0::BIGINT AS manual_matches, round(coalesce(avg(sim), 0.0), 6) AS similarity_score, round(coalesce(avg(conf), 0.0), 6) AS average_confidence, (SELECT count(*) FROM f WHERE side = 'a') - count(*) AS unmatched_a, (SELECT count(*) FROM f WHERE side = 'b') - count(*) AS unmatched_b FROM p")
def statistics(spark, sf):
    a, b = both(spark, sf)
    s = matching.statistics(matching.exact_matches(a, b), a.count(), b.count())
    return s.withColumns({c: r6(F.col(c)) for c in ("similarity_score", "average_confidence")})


def _labelled(a: DataFrame, b: DataFrame) -> DataFrame:
    """Aligned pairs as matches: by confidence, each of the three types occurs."""
    s = matching.scored(matching.key_pairs(a, b, F.col("address")))
    label = F.when(F.col("a.cfg_hash") == F.col("b.cfg_hash"), "Exact").when(F.col("a.n_bb") == F.col("b.n_bb"), "Structural").otherwise("Heuristic")
    return s.withColumns({"phase": F.lit(1), "match_type": label, "similarity": r6(F.col("similarity")), "confidence": r6(F.col("confidence"))})


_VIEW = f"""{O.PROGRAM}{O.pairs(O.ALIGNED, extra=", x.name AS name_a, y.name AS name_b, x.address::BIGINT AS address_a, y.address::BIGINT AS address_b, x.size::BIGINT AS size_a, y.size::BIGINT AS size_b, x.n_bb AS bb_a, y.n_bb AS bb_b, x.n_instr AS instr_a, y.n_instr AS instr_b, CASE WHEN x.cfg = y.cfg THEN 'Exact' WHEN x.n_bb = y.n_bb THEN 'Structural' ELSE 'Heuristic' END AS match_type")}, v AS (SELECT idx_a, round(sim, 6) AS similarity, round(conf, 6) AS confidence, name_a, name_b, address_a, address_b, match_type, size_a, size_b, bb_a, bb_b, instr_a, instr_b FROM p)"""


def view(spark, sf) -> DataFrame:
    a, b = both(spark, sf)
    v = results.results_view(_labelled(a, b).select(*matching.COLUMNS), a, b)
    return v.withColumns({c: F.col(c).cast("bigint") for c in ("address_a", "address_b", "size_a", "size_b")})


_VIEW_COLUMNS = ", ".join(results.VIEW_COLUMNS)


@query("results_view", f"{_VIEW} SELECT {_VIEW_COLUMNS} FROM v")
def results_view(spark, sf):
    return view(spark, sf).select(*results.VIEW_COLUMNS)


@query("type_counts", f"{_VIEW} SELECT count(*) FILTER (WHERE match_type = 'Exact') AS exact, count(*) FILTER (WHERE match_type = 'Structural') AS structural, count(*) FILTER (WHERE match_type = 'Heuristic') AS heuristic, 0::BIGINT AS manual FROM v")
def type_counts(spark, sf):
    return results.type_counts(_labelled(*both(spark, sf)))


def _band(kind: str, expression: str):
    sql = f"{_VIEW} SELECT {expression} AS band, count(*) AS n FROM v GROUP BY 1"
    query(f"bands_{kind}", sql)(lambda spark, sf: results.bands(view(spark, sf)).groupBy(F.col(f"{kind}_band").alias("band")).agg(F.count("*").alias("n")))


_band("html", "CASE WHEN confidence >= 0.67 THEN 'high-confidence' WHEN confidence >= 0.34 THEN 'medium-confidence' ELSE 'low-confidence' END")
_band("text", "CASE WHEN confidence > 0.8 THEN 'high' WHEN confidence > 0.6 THEN 'medium' ELSE 'low' END")
_band("log", "CASE WHEN similarity >= 0.9 THEN 'high' WHEN similarity >= 0.7 THEN 'medium' ELSE 'low' END")


@query("filter_results", f"{_VIEW} SELECT {_VIEW_COLUMNS} FROM v WHERE match_type = 'Structural' AND similarity >= 0.7 AND confidence >= 0.5 AND (contains(lower(name_a), 'user_1') OR contains(lower(name_b), 'user_1'))")
def filter_results(spark, sf):
    return results.filter_results(view(spark, sf), "Structural", "0.7", "0.5", "USER_1").select(*results.VIEW_COLUMNS)


@query("sort_results", f"{_VIEW} SELECT row_number() OVER (ORDER BY similarity DESC, idx_a) AS n, name_a, similarity FROM v")
def sort_results(spark, sf):
    return results.numbered(view(spark, sf)).select(F.col("n").cast("bigint"), "name_a", "similarity")


@query("sort_by_column", f"{_VIEW} SELECT row_number() OVER (ORDER BY size_b DESC, idx_a) - 1 AS n, name_a, size_b FROM v")
def sort_by_column(spark, sf):
    v = results.sort_results(view(spark, sf), 8, descending=True).select("name_a", "size_b").toPandas()
    return spark.createDataFrame([(i, r.name_a, int(r.size_b)) for i, r in enumerate(v.itertuples())], "n long, name_a string, size_b long")


@query("sort_again", f"{_VIEW} SELECT row_number() OVER (ORDER BY match_type, bb_a DESC, lower(name_b), idx_a) - 1 AS n, name_b, bb_a, match_type FROM v")
def sort_again(spark, sf):
    """Clicks on the name, twice on the block count, then on the type: later sorts keep the places of the ones before."""
    table = results.SortedTable().click(4).click(9).click(9).click(6)
    rows = table.rows(view(spark, sf)).select("name_b", "bb_a", "match_type").toLocalIterator()
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "n long, name_b string, bb_a long, match_type string")


@query("sort_model", f"{_VIEW} SELECT row_number() OVER (ORDER BY name_b, idx_a) - 1 AS n, name_b FROM v")
def sort_model(spark, sf):
    rows = results.sort_results(view(spark, sf), 2, order=results.MODEL_COLUMNS, fold_case=False).select("name_b").toLocalIterator()
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "n long, name_b string")


@query("report_order", f"{_VIEW} SELECT row_number() OVER (ORDER BY confidence DESC, address_a, address_b) - 1 AS n, name_a, confidence FROM v")
def report_order(spark, sf):
    rows = results.report_order(view(spark, sf)).select("name_a", "confidence").toLocalIterator()
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "n long, name_a string, confidence double")


@query("reset_filters", f"{_VIEW} SELECT {_VIEW_COLUMNS} FROM v WHERE similarity >= 0.0 AND confidence >= 0.0")
def reset_filters(spark, sf):
    """Default filters, with texts that are no numbers: everything stays."""
    return results.filter_results(view(spark, sf), similarity="", confidence="junk").select(*results.VIEW_COLUMNS)


@query("find_pair", f"{_VIEW} SELECT {_VIEW_COLUMNS} FROM v WHERE address_a = (SELECT min(address_a) FROM v)")
def find_pair(spark, sf):
    v = view(spark, sf)
    at = v.agg(F.min("address_a")).first()[0]
    return results.find_pair(v, at, at).select(*results.VIEW_COLUMNS)


@query("first_row", f"{_VIEW} SELECT {_VIEW_COLUMNS} FROM v ORDER BY idx_a LIMIT 1")
def first_row(spark, sf):
    return results.first_row(view(spark, sf)).select(*results.VIEW_COLUMNS)


_F4 = "format('{{:.4f}}', {c})"
_SCORE4 = ", ".join(_F4.format(c=c) for c in ("similarity", "confidence"))
_HEX16 = "lower(format('0x{{:016x}}', {c}))"
_COUNT_TEXTS = ", ".join(f"{c}::VARCHAR" for c in exports.COUNTS)


def _lines(df: DataFrame) -> DataFrame:
    return df.select(F.col("seq.idx_a").alias("idx_a"), "line")


@query("export_csv", f"{_VIEW} SELECT idx_a, concat_ws(',', name_a, {_HEX16.format(c='address_a')}, name_b, {_HEX16.format(c='address_b')}, {_SCORE4}, match_type, {_COUNT_TEXTS}) AS line FROM v")
def export_csv(spark, sf):
    return _lines(exports.csv_lines(view(spark, sf)))


@query("export_csv_bare", f"{_VIEW} SELECT idx_a, concat_ws(',', name_a, lower(format('{{:x}}', address_a)), name_b, lower(format('{{:x}}', address_b)), {_SCORE4}, match_type, {_COUNT_TEXTS}) AS line FROM v")
def export_csv_bare(spark, sf):
    return _lines(exports.csv_lines(view(spark, sf), compat=True))


@query("export_csv_guarded", r"""WITH g AS (SELECT event_id, CASE event_id % 7 WHEN 0 THEN '=' WHEN 1 THEN '+' WHEN 2 THEN '-' WHEN 3 THEN '@' WHEN 4 THEN chr(9) WHEN 5 THEN chr(13) ELSE '' END || event_type || CASE event_id % 3 WHEN 0 THEN ',x' WHEN 1 THEN '"y"' ELSE '' END AS t FROM events),
h AS (SELECT event_id, CASE WHEN regexp_matches(t, '^[=+\-@\t\r]') THEN chr(39) || t ELSE t END AS t FROM g)
SELECT event_id, CASE WHEN regexp_matches(t, '[,"\r\n]') THEN '"' || replace(t, '"', '""') || '"' ELSE t END AS field FROM h""")
def export_csv_guarded(spark, sf):
    """Fields that a spreadsheet would take for formulas, and such as need quotes."""
    e = spark.read.parquet(f"{sf}/events.parquet")
    head = F.coalesce(F.get(F.array(*map(F.lit, ("=", "+", "-", "@", "\t", "\r"))), (F.col("event_id") % 7).cast("int")), F.lit(""))
    tail = F.coalesce(F.get(F.array(F.lit(",x"), F.lit('"y"')), (F.col("event_id") % 3).cast("int")), F.lit(""))
    return e.select("event_id", T.csv_field(T.formula_safe(F.concat(head, "event_type", tail))).alias("field"))


@query("export_sql", f"{_VIEW} SELECT idx_a, 'INSERT INTO function_matches ({', '.join(exports.SQL_COLUMNS)}) VALUES (' || concat_ws(', ', chr(39) || name_a || chr(39), chr(39) || {_HEX16.format(c='address_a')} || chr(39), chr(39) || name_b || chr(39), chr(39) || {_HEX16.format(c='address_b')} || chr(39), {_SCORE4}, chr(39) || match_type || chr(39), {_COUNT_TEXTS}) || ');' AS line FROM v")
def export_sql(spark, sf):
    return _lines(exports.insert_lines(view(spark, sf)))


@query("export_html", f"{_VIEW} SELECT idx_a, '<tr class=\"' || CASE WHEN confidence >= 0.67 THEN 'high' WHEN confidence >= 0.34 THEN 'medium' ELSE 'low' END || '-confidence\"><td>' || concat_ws('</td><td>', name_a, {_HEX16.format(c='address_a')}, name_b, {_HEX16.format(c='address_b')}, {_SCORE4}, match_type) || '</td></tr>' AS line FROM v")
def export_html(spark, sf):
    return _lines(exports.html_lines(view(spark, sf)))


@query("export_html_bare", ORACLES["export_html"])
def export_html_bare(spark, sf):
    return _lines(exports.html_lines(view(spark, sf), escape=False))


@query("export_json", f"{_VIEW} SELECT idx_a, name_a, address_b, size_a, bb_b, instr_a, similarity, confidence, match_type FROM v")
def export_json(spark, sf):
    """Records written as JSON and read again."""
    folder = shared_folder(spark, "records")
    rows = exports.records(view(spark, sf))
    rows.write.json(folder)
    back = spark.read.schema(rows.schema).json(folder)
    return back.select("seq.idx_a", F.col("record.function_a.name").alias("name_a"), F.col("record.function_b.address").cast("bigint").alias("address_b"), F.col("record.function_a.size").cast("bigint").alias("size_a"), F.col("record.function_b.basic_blocks").alias("bb_b"), F.col("record.function_a.instructions").alias("instr_a"), "record.similarity", "record.confidence", "record.match_type")


@query("export_sqlite", f"{_VIEW} SELECT count(*) AS n, round(sum(similarity), 6) AS similarity, min(name_a) AS first_name, max({_HEX16.format(c='address_b')}) AS last_address, sum(instr_b)::BIGINT AS instructions FROM v")
def export_sqlite(spark, sf):
    """Written to a database (in memory here), and summed by that database."""
    import sqlite3

    con = sqlite3.connect(":memory:")
    exports.fill_sqlite(con, view(spark, sf))
    row = con.execute("SELECT count(*), round(sum(similarity), 6), min(function_a_name), max(function_b_address), sum(instr_count_b) FROM function_matches").fetchone()
    con.close()
    return spark.createDataFrame([row], "n long, similarity double, first_name string, last_address string, instructions long")


@query("gui_record", f"{_VIEW} SELECT row_number() OVER (ORDER BY idx_a) - 1 AS n, name_a, bb_b, similarity, 0 AS leftovers, 0.0::DOUBLE AS analysis_time, round(avg(similarity) OVER (), 6) AS score FROM v")
def gui_record(spark, sf):
    g = exports.gui_record(view(spark, sf))
    return g.select(F.posexplode("matched_functions").alias("n", "m"), (F.size("unmatched_functions_a") + F.size("unmatched_functions_b")).alias("leftovers"), "analysis_time", r6(F.col("similarity_score")).alias("score")).select(F.col("n").cast("bigint"), F.col("m.function_a.name").alias("name_a"), F.col("m.function_b.basic_blocks").alias("bb_b"), "m.similarity", "leftovers", "analysis_time", "score")


@query("pair_document", f"{_VIEW}, one AS (SELECT * FROM v WHERE address_a = (SELECT min(address_a) FROM v)) SELECT name_a, lower(format('0x{{:x}}', address_a)) AS address_a, size_a, bb_a, instr_b, similarity, match_type, 'Unknown' AS missing, 0::BIGINT AS missing_blocks, size_a AS unmatched_size, false AS unmatched_found FROM one")
def pair_document(spark, sf):
    """The pair at the lowest address, and its left function with an address that is not there."""
    v = stored(spark, view(spark, sf), "view")
    at = int(v.agg(F.min("address_a")).first()[0])
    side = lambda s: v.select(F.col(f"name_{s}").alias("name"), F.col(f"address_{s}").alias("address"), F.col(f"size_{s}").alias("size"), F.col(f"bb_{s}").alias("n_bb"), F.col(f"instr_{s}").alias("n_instr"), F.lit("").alias("code"))
    d, e = (exports.pair_document(v, side("a"), side("b"), at, b) for b in (at, 1))
    a, b, m = d["function_a"], d["function_b"], d["match_info"]
    row = (a["name"], a["address"], a["size"], a["basic_blocks_count"], b["instructions_count"], m["similarity"], m["match_type"], e["function_b"]["name"], e["function_b"]["basic_blocks_count"], e["function_a"]["size"], "match_info" in e)
    return spark.createDataFrame([row], "name_a string, address_a string, size_a long, bb_a long, instr_b long, similarity double, match_type string, missing string, missing_blocks long, unmatched_size long, unmatched_found boolean")


@query("table_cells", f"{_VIEW} SELECT name_a, lower(format('0x{{:x}}', address_a)) AS address_a, name_b, lower(format('0x{{:x}}', address_b)) AS address_b, {_F4.format(c='similarity')} AS similarity, {_F4.format(c='confidence')} AS confidence, match_type, size_a::VARCHAR AS size_a, size_b::VARCHAR AS size_b, bb_a::VARCHAR AS bb_a, bb_b::VARCHAR AS bb_b, instr_a::VARCHAR AS instr_a, instr_b::VARCHAR AS instr_b FROM v")
def table_cells(spark, sf):
    return results.table_cells(view(spark, sf), results.MODEL_COLUMNS).drop("seq")


@query("report_matches", f"""{_VIEW} SELECT idx_a, name_a || ' <-> ' || name_b || chr(10) || '   Addresses: ' || lower(format('0x{{:x}}', address_a)) || ' <-> ' || lower(format('0x{{:x}}', address_b)) || chr(10)
|| '   Similarity: ' || {_F4.format(c='similarity')} || ' | Confidence: ' || {_F4.format(c='confidence')} || ' | Type: ' || match_type || chr(10) || '   Size: ' || size_a || ' bytes <-> ' || size_b || ' bytes' || chr(10)
|| '   Basic Blocks: ' || bb_a || ' <-> ' || bb_b || chr(10) || '   Instructions: ' || instr_a || ' <-> ' || instr_b || chr(10) AS text FROM v""")
def report_matches(spark, sf):
    return view(spark, sf).select("idx_a", reports.match_text().alias("text"))


@query("report_table", f"""{_VIEW} SELECT idx_a, '│ ' || concat_ws(' │ ', rpad(name_a, 29, ' '), rpad(name_b, 29, ' '), rpad({_F4.format(c='similarity')}, 10, ' '), rpad({_F4.format(c='confidence')}, 10, ' '), rpad(match_type, 10, ' '), rpad(size_a::VARCHAR, greatest(6, length(size_a::VARCHAR))::INTEGER, ' '), rpad(size_b::VARCHAR, greatest(6, length(size_b::VARCHAR))::INTEGER, ' '), rpad(bb_a::VARCHAR, greatest(4, length(bb_a::VARCHAR))::INTEGER, ' '), rpad(bb_b::VARCHAR, greatest(4, length(bb_b::VARCHAR))::INTEGER, ' ')) || ' │' AS line FROM v""")
def report_table(spark, sf):
    return _lines(reports.table_lines(view(spark, sf)))


@query("report_listing", f"""{_VIEW}, n AS (SELECT row_number() OVER (ORDER BY similarity DESC, idx_a) AS n, * FROM v) SELECT n, n || '. ' || name_a || ' <-> ' || name_b || ' (similarity: ' || format('{{:.3f}}', similarity) || ', confidence: ' || format('{{:.3f}}', confidence) || ')' AS line, CASE WHEN similarity >= 0.9 THEN 'high' WHEN similarity >= 0.7 THEN 'medium' ELSE 'low' END AS band FROM n""")
def report_listing(spark, sf):
    return reports.listing_lines(view(spark, sf))


@query("status_lines", f"{_VIEW} SELECT idx_a, 'Similarity: ' || format('{{:.2f}}', similarity * 100) || '%' AS line FROM v")
def status_lines(spark, sf):
    return view(spark, sf).select("idx_a", reports.status_line(F.col("similarity")).alias("line"))


@query("short_names", "SELECT event_id, CASE WHEN strlen(props || event_type) > 28 THEN left(props || event_type, 25) || '...' ELSE props || event_type END AS name FROM events")
def short_names(spark, sf):
    return spark.read.parquet(f"{sf}/events.parquet").select("event_id", results.cut_name(F.concat("props", "event_type")).alias("name"))


@query("escaped_html", "SELECT event_id, replace(replace(replace(replace(replace('<' || props || '> & ' || event_type || chr(9), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), ' ', '&nbsp;'), chr(9), '&nbsp;&nbsp;&nbsp;&nbsp;') AS text FROM events")
def escaped_html(spark, sf):
    return spark.read.parquet(f"{sf}/events.parquet").select("event_id", textdiff.escape_html(F.concat(F.lit("<"), "props", F.lit("> & "), "event_type", F.lit("\t"))).alias("text"))


@query("functions_at", f"{O.HALVES}, l AS (SELECT side, address, max_by(struct_pack(idx := idx, name := name), idx) AS f FROM f GROUP BY side, address), p AS (SELECT DISTINCT user_id AS u FROM events) SELECT u, x.f.idx AS idx_a, y.f.name AS name_b FROM p JOIN l x ON x.side = 'a' AND x.address = u * 4096 JOIN l y ON y.side = 'b' AND y.address = (u + 1) * 4096")
def functions_at(spark, sf):
    """Pairs of addresses, most of them without a function on either side."""
    u = spark.read.parquet(f"{sf}/events.parquet").select(F.col("user_id").alias("u")).distinct()
    pairs = u.withColumns({"address_a": (F.col("u") * 4096).cast("decimal(20,0)"), "address_b": ((F.col("u") + 1) * 4096).cast("decimal(20,0)")})
    side = lambda s: programs.halves_program(spark, sf, s).select("address", "idx", "name")
    return results.functions_at(pairs, side("a"), side("b")).select("u", F.col("function_a.idx").alias("idx_a"), F.col("function_b.name").alias("name_b"))


#: Golden rows of the fixture program, from the formulas (see FIXTURES.md).
_FIXTURE = """SELECT * FROM (VALUES
('main', 4096, 3, 2, 9, 5, 'cfd4818b5746f083', '3863020001874643', '79177009bff6b9d9'),
('printf', 4608, 1, 0, 3, 1, '99de1a09d1f406db', '156907', '00f11b9ada29e4f3'),
('malloc', 4864, 2, 1, 6, 2, '766e1d12da05deac', '24619806649', 'b80158491384b181'),
('strcmp', 5120, 4, 3, 12, 3, 'adf22c9818d0b39b', '15839069075438957489', '2638109d026ff5e6'),
('memcpy', 5376, 2, 1, 6, 2, '5db2a5a750525e3b', '24619806649', 'b80158491384b181'),
('init_function', 5632, 3, 2, 9, 4, '15e6144b48b7e7c9', '3863020001874643', '79177009bff6b9d9'),
('cleanup_function', 5888, 2, 1, 6, 3, '6eec744ef716ea33', '24619806649', 'b80158491384b181'),
('process_data', 6144, 6, 5, 18, 8, 'aaa50e7914a7e17a', '14597318149971827177', '0fc8016e1c733798'))
AS t(name, address, n_bb, edges_total, n_instr, complexity, md_index, primes_product, fuzzy_hash)"""


@query("fixture_features", _FIXTURE)
def fixture_features(spark, sf):
    f = features.extract_features(programs.fixture_program(spark))
    return f.select("name", *[F.col(c).cast("int") for c in ("address", "n_bb", "edges_total", "n_instr", "complexity")], "md_index", F.col("primes_product").cast("string"), "fuzzy_hash")


@query("fixture_summary", "SELECT 8::BIGINT AS total_matches, 8::BIGINT AS exact_matches, 0::BIGINT AS structural_matches, 0::BIGINT AS heuristic_matches, 0::BIGINT AS manual_matches, 1.0::DOUBLE AS similarity_score, 1.0::DOUBLE AS average_confidence, 0::BIGINT AS unmatched_a, 0::BIGINT AS unmatched_b")
def fixture_summary(spark, sf):
    f = features.extract_features(programs.fixture_program(spark))
    return matching.summary(matching.diff(spark, f, f))


@query("read_defaults", "SELECT event_id AS idx, CASE WHEN event_id % 2 = 0 THEN event_type ELSE '' END AS name, 0::BIGINT AS size, CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END AS blocks, CASE WHEN event_id % 3 = 0 THEN 0 ELSE -1 END AS block_edges, CASE WHEN event_id % 3 = 0 THEN '' ELSE 'none' END AS block_hash FROM events")
def read_defaults(spark, sf):
    """Programs as JSON of which fields are missing, in blocks too."""
    e = spark.read.parquet(f"{sf}/events.parquet")
    folder = shared_folder(spark, "program")
    name = F.when(F.col("event_id") % 2 == 0, F.to_json(F.struct(F.col("event_id").alias("idx"), F.col("event_type").alias("name")))).otherwise(F.to_json(F.struct(F.col("event_id").alias("idx"))))
    block = F.when(F.col("event_id") % 3 == 0, F.concat(F.regexp_replace(name, r"\}$", ""), F.lit(', "basic_blocks": [{"address": 7}], "unknown": 1}'))).otherwise(name)
    e.select(block.alias("line")).write.text(folder)
    p = programs.read_program(spark, folder, "jsonl")
    first = F.get("basic_blocks", 0)
    return p.select("idx", "name", F.col("size").cast("bigint"), F.size("basic_blocks").alias("blocks"), F.when(first.isNotNull(), F.size(first["edges"])).otherwise(-1).alias("block_edges"), F.coalesce(first["mnemonic_hash"], F.lit("none")).alias("block_hash"))


@query("scores_without_numbers", "SELECT event_id, CASE event_id % 4 WHEN 0 THEN 0.0 WHEN 1 THEN 1.0 WHEN 2 THEN 0.0 ELSE 0.25 END::DOUBLE AS score FROM events")
def scores_without_numbers(spark, sf):
    """NaN counts as 0, what is beyond 1 or below 0 is cut."""
    raw = F.get(F.array(F.lit(float("nan")), F.lit(7.5), F.lit(-3.0), F.lit(0.25)), (F.col("event_id") % 4).cast("int"))
    return spark.read.parquet(f"{sf}/events.parquet").select("event_id", K.sanitize(raw).alias("score"))


# ---------------------------------------------------------------- kernels on aligned pairs


def _kernel(name: str, sql: str, column):
    """One kernel over aligned pairs."""
    text = f"{O.PROGRAM} SELECT x.idx AS idx_a, y.idx AS idx_b, round({sql}, 6) AS score FROM f x JOIN f y ON x.side = 'a' AND y.side = 'b' AND {O.ALIGNED}"
    query(name, text)(lambda spark, sf: aligned(spark, sf).select("idx_a", "idx_b", r6(column(F.col("a"), F.col("b"))).alias("score")))


_kernel("jaccard_calls", O.PARTS["call"], K.call_similarity)
_kernel("jaccard_consts", O.PARTS["const"], K.constant_similarity)
_kernel("jaccard_strings", O.PARTS["string"], K.string_similarity)
_kernel("control_flow", O.FLOW, K.control_flow_similarity)
_kernel("cfg_similarity", O.PARTS["cfg"], K.cfg_similarity)
_kernel("block_similarity", O.PARTS["bb"], K.basic_block_similarity)
_kernel("instruction_similarity", O.PARTS["instruction"], K.instruction_similarity)
_kernel("edge_similarity", O.PARTS["edge"], K.edge_similarity)
_kernel("edit_distance", O.PARTS["name"], K.name_similarity)
_kernel("sequence_similarity", O.PARTS["seq"], K.sequence_similarity)
_kernel("comprehensive", " + ".join(f"{w} * ({O.PARTS[k]})" for k, w in K.COMPREHENSIVE_WEIGHTS), K.comprehensive_similarity)

_COUNT = "list_transform({d}, lambda v: len(list_filter({x}, lambda z: z = v))::DOUBLE)"
_D = "list_distinct(list_concat(x.ms, y.ms))"
_kernel("cosine", f"list_cosine_similarity({_COUNT.format(d=_D, x='x.ms')}, {_COUNT.format(d=_D, x='y.ms')})", lambda a, b: K.cosine(K.histogram(F.split(a["sequence"], " ")), K.histogram(F.split(b["sequence"], " "))))

query("match_details", f"{O.PROGRAM}{O.pairs(O.ALIGNED)} SELECT idx_a, idx_b, " + ", ".join(f"round(s_{k}, 6) AS {k}" for k, _ in K.MATCH_WEIGHTS) + " FROM p")(
    lambda spark, sf: matching.scored(aligned(spark, sf)).select("idx_a", "idx_b", *[r6(F.col(f"details.{k}_similarity")).alias(k) for k, _ in K.MATCH_WEIGHTS])
)
query("confidence", f"{O.PROGRAM}{O.pairs(O.ALIGNED)} SELECT {O.SCORES} FROM p")(lambda spark, sf: _scores(matching.scored(aligned(spark, sf))))


def _with_blocks(spark, sf) -> DataFrame:
    side = lambda s: program(spark, sf, s).select("address", F.col("idx").alias(f"idx_{s}"), F.col("basic_blocks").alias(f"blocks_{s}"))
    return side("a").join(side("b"), "address")


@query("block_pairing", f"{O.PROGRAM}, bx AS (SELECT f.side, f.idx, f.address, blk.i - 1 AS block, f.address + (blk.i - 1) * 64 AS at, len(blk.ms) AS n FROM f JOIN blk USING (side, user_id)), al AS (SELECT x.idx AS idx_a, y.idx AS idx_b, x.address FROM f x JOIN f y ON x.side = 'a' AND y.side = 'b' AND {O.ALIGNED}) SELECT al.idx_a, al.idx_b, coalesce(p.block, q.block) AS block, coalesce(p.at::VARCHAR, '<missing>') AS address_a, coalesce(p.n, 0) AS instr_a, coalesce(q.at::VARCHAR, '<missing>') AS address_b, coalesce(q.n, 0) AS instr_b FROM (SELECT * FROM bx WHERE side = 'a' AND address IN (SELECT address FROM al)) p FULL JOIN (SELECT * FROM bx WHERE side = 'b' AND address IN (SELECT address FROM al)) q ON p.address = q.address AND p.block = q.block JOIN al ON al.address = coalesce(p.address, q.address)")
def block_pairing(spark, sf):
    rows = results.pair_blocks(_with_blocks(spark, sf))
    shown = {f"address_{s}": F.coalesce(F.col(f"address_{s}").cast("string"), F.lit("<missing>")) for s in "ab"}
    return rows.withColumns(shown | {f"instr_{s}": F.coalesce(f"instr_{s}", F.lit(0)) for s in "ab"})


@query("bb_matrix", f"{O.PROGRAM}, bx AS (SELECT f.side, f.idx, f.address, blk.i - 1 AS block, list_distinct(blk.ms) AS ms FROM f JOIN blk USING (side, user_id)) SELECT x.idx AS idx_a, y.idx AS idx_b, x.block AS block_a, y.block AS block_b, round({O._JACCARD.format(c='ms')}, 6) AS score FROM bx x JOIN bx y ON x.side = 'a' AND y.side = 'b' AND {O.ALIGNED}")
def bb_matrix(spark, sf):
    m = _with_blocks(spark, sf).select("idx_a", "idx_b", F.posexplode(K.block_matrix(F.col("blocks_a"), F.col("blocks_b"))).alias("block_a", "row"))
    return m.select("idx_a", "idx_b", F.col("block_a").cast("bigint"), F.posexplode("row").alias("block_b", "score")).withColumns({"block_b": F.col("block_b").cast("bigint"), "score": r6(F.col("score"))})


# ---------------------------------------------------------------- lite profile


def _lite(spark, sf, side: str) -> DataFrame:
    return programs.lite_features(program(spark, sf, side))


@query("lite_similarity", f"{O.PROGRAM}{O.LITE} SELECT x.idx AS idx_a, y.idx AS idx_b, round({O.LITE_SCORE}, 6) AS score FROM lp x JOIN lp y ON x.side = 'a' AND y.side = 'b' AND {O.ALIGNED}")
def lite_similarity(spark, sf):
    pairs = matching.key_pairs(_lite(spark, sf, "a"), _lite(spark, sf, "b"), F.col("address"))
    return pairs.select("idx_a", "idx_b", r6(lite.similarity(F.col("a"), F.col("b"))).alias("score"))


_LITE_COLUMNS = "SELECT phase, idx_a, idx_b, round(sim, 6) AS similarity"


def _halves_lite(spark, sf, side: str) -> DataFrame:
    return programs.lite_features(programs.halves_program(spark, sf, side))


def _lite_queries(prefix: str, of, sql: str) -> None:
    def one(phase):
        def run(spark, sf):
            a, b = of(spark, sf, "a"), of(spark, sf, "b")
            return lite._phase(spark, lite.candidates(a, b, phase), phase).withColumn("similarity", r6(F.col("similarity")))

        return run

    def full(spark, sf):
        m = lite.match(spark, of(spark, sf, "a"), of(spark, sf, "b"))
        return m.select("phase", "idx_a", "idx_b", r6(F.col("similarity")).alias("similarity"), r6(F.col("confidence")).alias("confidence"), "technique")

    query(f"{prefix}lite_exact", f"{O.lite(sql, 1)} {_LITE_COLUMNS} FROM l")(one(0))
    query(f"{prefix}lite_full", f"{O.lite(sql)} {_LITE_COLUMNS}, round(least(1.0, sim + 0.02), 6) AS confidence, 'Structural' AS technique FROM l")(full)


@query("lite_name", f"{O.PROGRAM}{O.LITE} SELECT 2 AS phase, x.idx AS idx_a, y.idx AS idx_b, round(least(1.0, {O.LITE_SCORE} + 0.05), 6) AS similarity FROM lp x JOIN lp y ON x.side = 'a' AND y.side = 'b' AND x.name = y.name WHERE least(1.0, {O.LITE_SCORE} + 0.05) > 0.5")
def lite_name(spark, sf):
    m = lite._phase(spark, lite.candidates(_lite(spark, sf, "a"), _lite(spark, sf, "b"), 1), 1)
    return m.withColumn("similarity", r6(F.col("similarity")))


_lite_queries("", _lite, O.PROGRAM)
_lite_queries("halves_", _halves_lite, O.HALVES)


@query("lite_features", f"{O.HALVES}{O.LITE} SELECT side, idx, name, address::BIGINT AS address, size::BIGINT AS size, n_bb, n_instr, count(*) OVER (PARTITION BY key) AS same_structure FROM lp")
def lite_features(spark, sf):
    both = _halves_lite(spark, sf, "a").withColumn("side", F.lit("a")).unionByName(_halves_lite(spark, sf, "b").withColumn("side", F.lit("b")))
    sizes = both.groupBy("structural_hash").agg(F.count("*").alias("same_structure"))
    return both.join(sizes, "structural_hash").select("side", "idx", "name", F.col("address").cast("bigint"), F.col("size").cast("bigint"), "n_bb", "n_instr", "same_structure")


@query("instruction_hashes", f"{O.HALVES}, h AS (SELECT side, idx, array_to_string(list_transform(ms, lambda m: m || '16'), '') || address AS key FROM f) SELECT side, idx, count(*) OVER (PARTITION BY key) AS same FROM h")
def instruction_hashes(spark, sf):
    sides = [programs.instruction_hashes(programs.halves_program(spark, sf, s)).withColumn("side", F.lit(s)) for s in "ab"]
    both_sides = sides[0].unionByName(sides[1])
    return both_sides.join(both_sides.groupBy("instruction_hash").agg(F.count("*").alias("same")), "instruction_hash").select("side", "idx", "same")


@query("jitter", f"{O.lite(O.HALVES)} SELECT idx_a, idx_b, true AS near FROM l")
def jitter(spark, sf):
    """Scores of the lite profile, moved at random: within bounds, whatever the seed."""
    m = lite.match(spark, _halves_lite(spark, sf, "a"), _halves_lite(spark, sf, "b")).withColumn("moved", lite.jittered(F.col("similarity"), 7))
    return m.select("idx_a", "idx_b", ((F.abs(F.col("moved") - F.col("similarity")) <= lite.JITTER) & F.col("moved").between(0, 1)).alias("near"))


def _general(spark, sf, side: str) -> DataFrame:
    """What the general score compares, of the coarse programs."""
    f = halves(spark, sf, side).join(_halves_lite(spark, sf, side).select("idx", "structural_hash"), "idx")
    words = F.split("sequence", " ")
    primes = F.array_sort(F.array_distinct(F.transform(words, lambda m: F.get(F.array(*map(F.lit, K.PRIMES)), (K.byte_sum(m) % len(K.PRIMES)).cast("int")))))
    return f.select(
        "idx", "structural_hash", "name", "n_bb", "n_instr", F.col("edges_total").alias("n_edges"), K.histogram(words).alias("histogram"), "strings",
        F.size("calls").alias("call_count"), F.size("strings").alias("caller_count"), F.col("n_bb").alias("node_count"), (F.col("edges_total") / F.col("n_bb")).alias("density"),
        (F.col("edges_total") >= F.col("n_bb")).alias("connected"), F.transform("constants", lambda x: x.cast("bigint") * 30000).alias("constants"), primes.alias("primes"),
    )


_G = "1.0 - least(1.0, abs({x} - {y})::DOUBLE / greatest({least}, {x}, {y}))"
_PART = lambda c, least="1": _G.format(x=f"x.{c}", y=f"y.{c}", least=least)
_SETS = "CASE WHEN len(list_distinct(list_concat({x}, {y}))) = 0 THEN 1.0 ELSE len(list_intersect({x}, {y}))::DOUBLE / len(list_distinct(list_concat({x}, {y}))) END"
_PROD = "list_reduce(list_prepend(1.0::DOUBLE, list_transform({x}.primes_of[1:least(5, len(x.primes_of), len(y.primes_of))], lambda v: v::DOUBLE)), lambda p, q: p * q)"
#: Similarity of each technique, null where it is left out, and its weight.
_TECHNIQUES = [
    ("Hash Match", "CASE WHEN x.key = y.key THEN 1.0 ELSE 0.0 END", "10.0"),
    ("Basic Block Count", _PART("n_bb"), "2.0"),
    ("Instruction Count", _PART("n_instr"), "2.0"),
    ("Edge Count", f"CASE WHEN x.edges > 0 AND y.edges > 0 THEN {_PART('edges')} END", "1.5"),
    ("Mnemonic Histogram", f"list_cosine_similarity({_COUNT.format(d=_D, x='x.ms')}, {_COUNT.format(d=_D, x='y.ms')})", "8.0"),
    ("String References", f"CASE WHEN len(x.strs) > 0 AND len(y.strs) > 0 THEN {_SETS.format(x='x.strs', y='y.strs')} END", f"CASE WHEN {_SETS.format(x='x.strs', y='y.strs')} > 0.8 THEN 12.0 ELSE 7.0 END"),
    ("Callgraph", f"CASE WHEN len(x.calls) > 0 OR len(y.calls) > 0 THEN {_G.format(x='len(x.calls)', y='len(y.calls)', least='1')} END", "5.0"),
    ("Callgraph", f"CASE WHEN len(x.calls) > 0 OR len(y.calls) > 0 THEN {_G.format(x='len(x.strs)', y='len(y.strs)', least='1')} END", "5.0"),
    ("Control Flow", _PART("n_bb"), "4.0"),
    ("Control Flow", _G.format(x="(x.edges::DOUBLE / x.n_bb)", y="(y.edges::DOUBLE / y.n_bb)", least="0.001"), "4.0"),
    ("Control Flow", "CASE WHEN (x.edges >= x.n_bb) = (y.edges >= y.n_bb) THEN 1.0 ELSE 0.0 END", "4.0"),
    ("Numeric Constants", f"CASE WHEN len(x.consts) > 0 AND len(y.consts) > 0 AND len(x.low) + len(y.low) > 0 THEN {_SETS.format(x='x.low', y='y.low')} END", "3.0"),
    ("Prime Features", f"0.5 * ({_SETS.format(x='x.primes_of', y='y.primes_of')}) + 0.3 * (least(len(x.primes_of), len(y.primes_of))::DOUBLE / greatest(len(x.primes_of), len(y.primes_of))) + 0.2 * (least({_PROD.format(x='x')}, {_PROD.format(x='y')}) / greatest({_PROD.format(x='x')}, {_PROD.format(x='y')}))", "6.0"),
    ("Name Similarity", "CASE WHEN x.bare = y.bare THEN 1.0 ELSE 0.0 END", "1.0"),
]
_GENERAL = f"""{O.HALVES}{O.LITE}, gf AS (SELECT f.*, lp.key, lp.bare, list_filter(list_transform(consts, lambda v: v::BIGINT * 30000), lambda v: v < 65536) AS low, list_sort(list_distinct(list_transform(ms, lambda m: ({O.PRIME})))) AS primes_of FROM f JOIN lp USING (side, idx)),
tp AS (SELECT x.idx AS idx_a, y.idx AS idx_b, {', '.join(f'({t}) AS t{i}, ({w}) AS w{i}' for i, (_, t, w) in enumerate(_TECHNIQUES))} FROM gf x JOIN gf y ON x.side = 'a' AND y.side = 'b' AND x.address = y.address),
gs AS (SELECT idx_a, idx_b, ({' + '.join(f'coalesce(t{i} * w{i}, 0.0)' for i in range(len(_TECHNIQUES)))}) / ({' + '.join(f'CASE WHEN t{i} IS NULL THEN 0.0 ELSE w{i} END' for i in range(len(_TECHNIQUES)))}) AS score,
{', '.join(' + '.join(f'coalesce(t{i} * w{i}, 0.0)' for i, (m, *_) in enumerate(_TECHNIQUES) if m == n) + f' AS g{k}' for k, n in enumerate(lite.TECHNIQUES))} FROM tp)
SELECT idx_a, idx_b, round(least(1.0, score), 6) AS score, CASE WHEN g0 >= 10 THEN 'Hash Match' {' '.join(f"WHEN g{k} = greatest({', '.join(f'g{j}' for j in range(len(lite.TECHNIQUES)))}) THEN '{n}'" for k, n in enumerate(lite.TECHNIQUES))} END AS technique FROM gs"""


@query("general_score", _GENERAL)
def general_score(spark, sf):
    """The general weighted score with all its techniques, and the one that weighs most."""
    a, b = (programs.halves_program(spark, sf, s).select("idx", "address") for s in "ab")
    lowest = lambda f: f.join(f.groupBy("address").agg(F.min("idx").alias("idx")), ["address", "idx"])
    pairs = lowest(a).withColumnRenamed("idx", "idx_a").join(lowest(b).withColumnRenamed("idx", "idx_b"), "address")
    both = matching.as_pairs(pairs.select("idx_a", "idx_b"), _general(spark, sf, "a"), _general(spark, sf, "b"))
    score, technique = lite.general_similarity(lite.techniques(F.col("a"), F.col("b")))
    return both.select("idx_a", "idx_b", r6(score).alias("score"), technique.alias("technique"))


# ---------------------------------------------------------------- text diffs


def _texts(spark, sf) -> DataFrame:
    """One line for each instruction, of both functions at an address."""
    line = lambda i: F.concat_ws(" ", i["mnemonic"], F.array_join(i["operands"], ", "))
    side = lambda s: program(spark, sf, s).select("address", F.col("idx").alias(f"idx_{s}"), F.col("name").alias(f"name_{s}"), F.array_join(F.transform("instructions", line), "\n").alias(f"code_{s}"))
    return side("a").join(side("b"), "address")


@query("line_diff")
def line_diff(spark, sf):
    return textdiff.diff_lines(_texts(spark, sf), textdiff.Opcodes, "code_a", "code_b").select("idx_a", "idx_b", "tag", "i1", "i2", "j1", "j2")


@query("side_by_side")
def side_by_side(spark, sf):
    return textdiff.diff_lines(_texts(spark, sf), textdiff.SideBySide, "code_a", "code_b").select("idx_a", "n", "tag", "line_a", "text_a", "line_b", "text_b")


@query("unified_diff")
def unified_diff(spark, sf):
    return textdiff.diff_lines(_texts(spark, sf), textdiff.UnifiedDiff, "code_a", "code_b", "name_a", "name_b").select("idx_a", "n", "kind", "line")


@query("pair_view")
def pair_view(spark, sf):
    """A text form that only the left side has: the right one falls back to its disassembly."""
    texts = _texts(spark, sf).withColumn("low_a", F.regexp_replace("code_a", " .*", ""))
    return textdiff.pair_view(texts, "Low Level IL", {"Disassembly": "code_a", "Low Level IL": "low_a"}, {"Disassembly": "code_b"}, unified=True)


@query("block_listing", f"{ORACLES['block_pairing'].replace('SELECT al.idx_a', 'SELECT idx_a, idx_b, block, format({q}  Block {{}}: {{}} | {{}}{q}, block, CASE WHEN address_a = {q}<missing>{q} THEN address_a ELSE lower(format({q}0x{{:x}}{q}, address_a::BIGINT)) || {q} ({q} || instr_a || {q} instrs){q} END, CASE WHEN address_b = {q}<missing>{q} THEN address_b ELSE lower(format({q}0x{{:x}}{q}, address_b::BIGINT)) || {q} ({q} || instr_b || {q} instrs){q} END) AS line FROM (SELECT al.idx_a').replace('{q}', chr(39)).replace('{{', '{').replace('}}', '}')})")
def block_listing(spark, sf):
    return reports.block_lines(results.pair_blocks(_with_blocks(spark, sf)))


# ---------------------------------------------------------------- volume: programs of orders


@query("orders_zip", """WITH n AS (SELECT l_orderkey AS k, count(*) AS n_instr, count(DISTINCT l_linenumber) AS n_bb FROM lineitem GROUP BY 1),
f AS (SELECT o_orderkey AS idx, o_orderkey % 2 AS side, substr(sha256((n_instr * 16) || ':' || n_bb || ':' || n_instr || ':1'), 1, 16) AS md FROM orders JOIN n ON k = o_orderkey),
z AS (SELECT *, row_number() OVER (PARTITION BY side, md ORDER BY idx) AS nth FROM f)
SELECT x.idx AS idx_a, y.idx AS idx_b, x.md AS md_index FROM z x JOIN z y ON x.side = 0 AND y.side = 1 AND x.md = y.md AND x.nth = y.nth""")
def orders_zip(spark, sf):
    f = {s: features.extract_features(programs.orders_program(spark, sf, s)).select("idx", "md_index") for s in "ab"}
    return assignment.rank_zip(f["a"], f["b"], "md_index").join(f["a"].withColumnRenamed("idx", "idx_a"), "idx_a")
