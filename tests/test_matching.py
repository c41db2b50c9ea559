import random
import threading

import pytest
from pyspark.sql import functions as F

from pairwright import schema as S
from pairwright import storage
from pairwright.operators import assignment, classes, features, lite, matching
from pairwright.sources import programs

from . import plain


def frame(spark, rows):
    from decimal import Decimal

    def fix(r):
        ins = lambda xs: [(Decimal(i["address"]), i["mnemonic"], i["operands"], i["bytes"], i["length"]) for i in xs]
        bbs = [(Decimal(b["address"]), Decimal(b["size"]), ins(b["instructions"]), [Decimal(e) for e in b["edges"]], b["mnemonic_hash"], b["instruction_count"]) for b in r["basic_blocks"]]
        return (r["idx"], r["name"], Decimal(r["address"]), Decimal(r["size"]), bbs, ins(r["instructions"]), r["cyclomatic_complexity"], r["call_graph_hash"], r["cfg_hash"], r["instruction_count"], r["call_count"])

    return spark.createDataFrame([fix(r) for r in rows], S.PROGRAM)


@pytest.mark.parametrize("seed", [1, 2])
def test_six_phases_equal_the_loops(spark, seed):
    rng = random.Random(seed)
    a, b = plain.program(rng, 22), plain.program(rng, 22)
    # Scores are rounded on both sides, so that the last bit of a sum does not order ties.
    fa, fb = (features.extract_features(frame(spark, x)) for x in (a, b))
    got = sorted((r.phase, r.idx_a, r.idx_b) for r in matching.match_functions(spark, fa, fb).collect())
    assert got == sorted(plain.match(a, b))


def test_pair_scores_and_gate(spark):
    rng = random.Random(5)
    a, b = plain.program(rng, 12), plain.program(rng, 12)
    fa, fb = (features.extract_features(frame(spark, x)) for x in (a, b))
    got = {(r.idx_a, r.idx_b): (r.similarity, r.confidence) for r in matching.fuzzy_candidates(fa, fb).collect()}
    want = {}
    for x in a:
        for y in b:
            s = plain.blend(x, y)
            if s >= 0.6:
                want[x["idx"], y["idx"]] = (s, plain.confidence(x, y, s))
    assert set(got) == set(want)
    assert all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)


def test_leftovers_go_by_address(spark):
    rng = random.Random(9)
    a, b = plain.program(rng, 12), plain.program(rng, 9)
    d = matching.diff(spark, *(features.extract_features(frame(spark, x)) for x in (a, b)))
    taken = {a[r.idx_a]["address"] for r in d.matches.collect()}
    assert sorted(r.idx for r in d.unmatched_a.collect()) == [x["idx"] for x in a if x["address"] not in taken]
    s = matching.summary(d).first()
    assert s.total_matches == d.matches.count() and 0 <= s.similarity_score <= 1


def test_fixture_golden_values(spark):
    f = features.extract_features(programs.fixture_program(spark))
    got = {r["name"]: r for r in f.collect()}
    # Golden values of the fixture.
    want = {
        "main": ("cfd4818b5746f083", 3863020001874643, "79177009bff6b9d9"),
        "printf": ("99de1a09d1f406db", 156907, "00f11b9ada29e4f3"),
        "strcmp": ("adf22c9818d0b39b", 15839069075438957489, "2638109d026ff5e6"),
        "process_data": ("aaa50e7914a7e17a", 14597318149971827177, "0fc8016e1c733798"),
    }
    assert {k: (got[k].md_index, int(got[k].primes_product), got[k].fuzzy_hash) for k in want} == want
    s = matching.summary(matching.diff(spark, f, f)).first()
    assert (s.total_matches, s.exact_matches, s.similarity_score, s.unmatched_a, s.unmatched_b) == (8, 8, 1.0, 0, 0)
    pairs = {(r.a["name"], r.b["name"]): r for r in matching.scored(matching.key_pairs(f, f, F.lit(1))).collect()}
    r = pairs["main", "init_function"]
    assert (round(r.similarity, 6), round(r.confidence, 6)) == (0.565385, 0.765385)
    fuzzy = {(f_.idx_a, f_.idx_b): f_.similarity for f_ in matching.fuzzy_candidates(f, f).collect()}
    assert round(fuzzy[0, 5], 6) == 0.659231 and round(fuzzy[2, 4], 6) == 0.66


@pytest.mark.parametrize("seed", range(3))
def test_rounds_equal_the_loop(spark, seed):
    rng = random.Random(seed)
    rows = [("k", a, b, float(rng.randrange(3))) for a in range(12) for b in range(12) if rng.random() < 0.5]
    pairs = spark.createDataFrame(rows, "key string, idx_a long, idx_b long, score double")
    serial = {tuple(r) for r in assignment.greedy(spark, pairs, "key", ["score"]).collect()}
    by_rounds = {tuple(r) for r in assignment.greedy(spark, pairs, "key", ["score"], large=1).collect()}
    assert serial == by_rounds


def lite_loop(a, b):
    def score(x, y):
        bare = lambda n: lite_name(n)
        h = 10.0 if x["structural_hash"] == y["structural_hash"] != 0 else 0.0
        r = lambda p, q: 1 - abs(p - q) / max(p, q)
        core = h + 7.5 * r(x["n_bb"], y["n_bb"]) + 2 * r(x["n_instr"], y["n_instr"]) + 8
        n = bare(x["name"]), bare(y["name"])
        return core / 27.5 if all(v.startswith("0x") for v in n) else (core + (n[0] == n[1])) / 28.5

    matched, used, out = set(), set(), []
    for phase, (bonus, gate) in enumerate(((0.1, 0.6), (0.05, 0.5), (0.0, 0.4))):
        for x in a:
            if x["idx"] in matched:
                continue
            best, top = None, 0
            for y in b:
                if y["idx"] in used:
                    continue
                if phase == 0 and not (x["structural_hash"] == y["structural_hash"] != 0) or phase == 1 and (x["name"] != y["name"] or x["name"] == "sub_*"):
                    continue
                s = min(1.0, score(x, y) + bonus)
                if round(s, 9) > round(top, 9) and (phase < 2 or s > 0.4):
                    best, top = y, s
            if best and best["address"] and top > gate:
                matched.add(x["idx"])
                used.add(best["idx"])
                out.append((phase + 1, x["idx"], best["idx"]))
    return sorted(out)


def lite_name(n):
    n = n.lower()
    for p in ("sub_", "fcn_", "fcn.", "function_", "func_", "f_"):
        n = n.removeprefix(p)
    return n


@pytest.mark.parametrize("seed", [1, 4])
def test_lite_phases_equal_the_loops(spark, seed):
    rng = random.Random(seed)
    make = lambda n: [{"idx": i, "name": rng.choice(["a", "sub_*", "f_b", "0x1", "sub_0x2"]), "address": 16 * i, "size": 1, "n_bb": rng.choice([1, 2, 5]), "n_instr": rng.choice([1, 3]), "structural_hash": rng.choice([0, 1, 2])} for i in range(n)]
    a, b = make(9), make(8)
    schema = "idx long, name string, address decimal(20,0), size decimal(20,0), n_bb long, n_instr long, structural_hash long"
    from decimal import Decimal

    df = lambda rows: spark.createDataFrame([(r["idx"], r["name"], Decimal(r["address"]), Decimal(r["size"]), r["n_bb"], r["n_instr"], r["structural_hash"]) for r in rows], schema)
    got = sorted((r.phase, r.idx_a, r.idx_b) for r in lite.match(spark, df(a), df(b)).collect())
    assert got == lite_loop(a, b)


def tied(rng, n):
    """Functions of few kinds; names in few forms, some of them shared, so that nearly all scores are ties."""
    out = plain.program(rng, n)
    for r in out:
        r["name"] = rng.choice(["main", "run", "rün", f"run_{rng.randrange(n)}", f"sub_{r['idx']:x}"])
    return out


@pytest.mark.parametrize("phase", [2, 3, 4, 5])
def test_classes_equal_the_pairs(spark, monkeypatch, phase):
    rng = random.Random(phase)
    a, b = (features.extract_features(frame(spark, tied(rng, 60))) for _ in range(2))
    rows = lambda: sorted(tuple(r) for r in matching.keyed_matches(spark, a, b, phase, 0.3, 0.3).drop("details").collect())
    by_pairs = rows()
    monkeypatch.setattr(classes, "CROWDED", 0)
    assert rows() == by_pairs and by_pairs


def test_tied_bucket_needs_no_rounds(spark, monkeypatch):
    """Rounds commit one row each where all left rows want the same right one."""
    monkeypatch.setattr(assignment, "rounds", None)
    f = features.extract_features(programs.fixture_program(spark)).where("idx = 0")
    many = f.withColumn("idx", F.explode(F.sequence(F.lit(0), F.lit(599))))
    got = [(r.idx_a, r.idx_b) for r in matching.keyed_matches(spark, many, many, 2).collect()]
    assert sorted(got) == [(i, i) for i in range(600)]


@pytest.mark.parametrize("seed", range(3))
def test_proposals_of_classes_equal_all_pairs(spark, seed):
    rng = random.Random(seed)
    a, b = tied(rng, 30), tied(rng, 30)
    for x in (*a, *b):
        x["size"] = x["size"] or 16
    fa, fb = (features.extract_features(frame(spark, x)) for x in (a, b))
    s = {(x["idx"], y["idx"]): round(plain.blend(x, y), 9) for x in a for y in b}
    c = {(i, j): round(plain.confidence(a[i], b[j], v), 9) for (i, j), v in s.items() if v >= 0.6}
    first = {}
    for i, j in sorted(c, key=lambda k: (-c[k], -s[k], k[1])):
        first.setdefault(i, j)
    got = {r.idx_a: (r.idx_b, round(r.similarity, 9), round(r.confidence, 9)) for r in matching.best_proposals(spark, fa, fb, 0.6, 0.5).collect()}
    assert {i: (s[i, g], c[i, g]) for i, (g, _, _) in got.items()} == {i: (s[i, j], c[i, j]) for i, j in first.items()} == {i: v[1:] for i, v in got.items()}
    winner = {}
    for i in sorted(first, key=lambda i: (-got[i][2], -got[i][1], i)):
        winner.setdefault(got[i][0], i)
    assert {(r.idx_b, r.idx_a) for r in matching.fuzzy_matches(fa, fb).collect()} == set(winner.items())


def test_copies_are_compared_once(spark):
    """Four million pairs of one class: each finds its namesake, without an edit distance for each pair."""
    f = features.extract_features(programs.fixture_program(spark)).where("idx = 7").withColumn("sequence", F.repeat(F.lit("mov call "), 300))
    many = f.withColumn("idx", F.explode(F.sequence(F.lit(0), F.lit(1999)))).withColumn("name", F.concat(F.lit("f"), F.col("idx").cast("string")))
    got = sorted((r.idx_a, r.idx_b) for r in matching.fuzzy_matches(many, many).select("idx_a", "idx_b").collect())
    assert got == [(i, i) for i in range(2000)]


@pytest.mark.parametrize("seed", [1, 4, 6])
def test_lite_classes_equal_the_loops(spark, monkeypatch, seed):
    monkeypatch.setattr(classes, "CROWDED", 0)
    test_lite_phases_equal_the_loops(spark, seed)


def test_tied_leftovers_of_lite_need_no_rounds(spark, monkeypatch):
    monkeypatch.setattr(assignment, "rounds", None)
    side = lambda s: spark.range(500).selectExpr("id AS idx", f"concat('{s}', id) AS name", "CAST(16 * id + 16 AS DECIMAL(20,0)) AS address", "CAST(1 AS DECIMAL(20,0)) AS size", "5L AS n_bb", "7L AS n_instr", "0L AS structural_hash")
    got = sorted((r.phase, r.idx_a, r.idx_b) for r in lite.match(spark, side("x"), side("y")).collect())
    assert got == [(3, i, i) for i in range(500)]


def test_whole_diff_of_classes_equals_the_loops(spark, monkeypatch):
    monkeypatch.setattr(classes, "CROWDED", 0)
    test_six_phases_equal_the_loops(spark, 1)


def plain_edits(x, y):
    row = list(range(len(y) + 1))
    for i, p in enumerate(x, 1):
        row, last = [i], row
        for j, q in enumerate(y, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (p != q)))
    return row[-1]


@pytest.mark.parametrize("width", [0, 1, 9, 16, 17, 32, 33, 64, 65])
def test_names_are_compared_by_bits(monkeypatch, width):
    rng = random.Random(width)
    names = [n for n in ("".join(rng.choice("ab0é字") for _ in range(rng.randint(0, width))) for _ in range(60)) if len(n.encode()) <= width] + ["x" * width]
    if width <= 64:  # a table of distances for each name took nearly all the time of a crowded bucket
        monkeypatch.setattr(classes.Edits, "_by_rows", None, raising=False)
    edits = classes.Edits(names)
    assert edits.width == width
    for n in [*names[:20], "", "ab" * 40]:
        p = classes._points(n)
        far = [plain_edits(p, classes._points(m)) for m in names]
        longest = [max(len(p), len(classes._points(m))) for m in names]
        assert edits.to(n).tolist() == [1.0 - d / k if k else 1.0 for d, k in zip(far, longest)]
    assert (edits.word is None) == (width > 64)


def test_sides_of_a_diff_are_stored_together(spark, monkeypatch):
    """Each waits for the other, so one after the other would not end."""
    barrier, plain = threading.Barrier(2, timeout=60), storage.stored
    met = []

    def meeting(s, df, label):
        if label in ("features", "classes"):
            met.append(label)
            barrier.wait()
        return plain(s, df, label)

    monkeypatch.setattr(storage, "stored", meeting)
    test_six_phases_equal_the_loops(spark, 2)
    assert "classes" in met


def test_a_failed_run_of_several_is_raised(spark):
    with pytest.raises(ZeroDivisionError):
        storage.together(spark, lambda: 1, lambda: 1 // 0)
    assert storage.together(spark, lambda: 1, lambda: 2) == [1, 2]
