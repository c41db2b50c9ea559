import random

import numpy as np
import pytest

from pairwright.llm import jaccard

from . import tables


def shingles(t):
    w = [x.lower() for x in (t or "").encode().split()]
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, min(len(w), 1)))}


def brute(rows):
    """(id, set size, least id of the component) of each row."""
    sets = [shingles(t) for _, t, *_ in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return sorted(((r[0], len(s), least.get(find(i)) if s else r[0]) for i, (r, s) in enumerate(zip(rows, sets))), key=str)


def run(spark, df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.join_classes(spark, df).collect()), key=str)


def corpus(rng, groups, passage):
    rows, n = [], 0
    for size, length, rate in groups:
        base = tables.prose(rng, length).split()
        for _ in range(size):
            w = [tables.prose(rng, 1) if rng.random() < rate else x for x in base]
            rows.append((n, " ".join(w)))
            n += 1
    for _ in range(40):  # one passage in many unlike texts
        rows.append((n, tables.prose(rng, 60) + " " + passage + " " + tables.prose(rng, 60)))
        n += 1
    return rows


@pytest.mark.parametrize("seed, block", [(1, 1024), (2, 10)])
def test_components_equal_brute_force(spark, monkeypatch, seed, block):
    """Long runs, whole and in blocks: near copies of one text, some beyond the threshold, and a passage that many texts share."""
    monkeypatch.setattr(jaccard, "RUN_BLOCK", block)
    rng = random.Random(seed)
    rows = corpus(rng, [(60, 80, 0.015), (40, 120, 0.03), (25, 30, 0.01), (10, 200, 0.005), (30, 6, 0.02)], tables.prose(rng, 55))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert run(spark, df) == brute(rows)


def test_edges(spark):
    rows = [r[:2] for r in tables.EDGES]
    assert run(spark, tables.edges(spark)) == brute(rows)
    assert run(spark, tables.empty(spark)) == []


def test_tree_join_equals_set_overlap():
    rng = np.random.default_rng(1)
    for _ in range(40):
        base = rng.choice(10_000, 300, replace=False).astype(np.uint64)
        draw = lambda: np.sort(np.concatenate([base[rng.random(300) < 0.93], rng.choice(10_000, rng.integers(1, 30), replace=False).astype(np.uint64) + np.uint64(20_000)]))
        x, others = draw(), [draw() for _ in range(12)]
        want = [jaccard.linked(len(x), len(y), len(np.intersect1d(x, y))) for y in others]
        assert jaccard.tree_join(x, others) == want
    assert jaccard.tree_join(x, []) == []
    # Many sequences below one prefix that x lacks: the first is read, the subtree is left.
    looked = []
    real = np.searchsorted
    far = [np.concatenate([np.arange(1, 200), rng.choice(10_000, 300, replace=False) + 1000]).astype(np.uint64) for _ in range(50)]
    x = np.arange(20_000, 20_480).astype(np.uint64)
    jaccard.np.searchsorted = lambda *a, **k: looked.append(1) or real(*a, **k)
    try:
        assert not any(jaccard.tree_join(x, far))
    finally:
        jaccard.np.searchsorted = real
    assert len(looked) <= 4


def test_sketches_never_rule_out_a_link():
    rng = np.random.default_rng(2)
    for n in (5, 50, 400, 3000):
        for _ in range(20):
            x = rng.integers(0, 2**63, n).astype(np.uint64)
            y = np.concatenate([x[rng.random(n) < 0.9], rng.integers(0, 2**63, max(1, n // 10)).astype(np.uint64)])
            sk = [np.frombuffer(jaccard.parity_sketch(v), np.uint64) for v in (x, y)]
            for _, members, bits in jaccard._differing_bits(sk, np.array([0])):
                if 1 in members.tolist():
                    d = int(bits[0, members.tolist().index(1)])
                    assert d >= 1 << 39 or d <= len(set(x.tolist()) ^ set(y.tolist()))


def test_id_filter(spark):
    test = jaccard.id_filter(spark.createDataFrame([(i,) for i in range(0, 100, 7)], "x long"))
    got = {r["id"]: r["t"] for r in spark.range(1000).withColumn("t", test("id")).collect()}
    assert all(got[i] for i in range(0, 100, 7)) and sum(got.values()) < 30


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(30)] + [(100, 100 + i) for i in range(1, 20)] + [(7, 100)] + [(500, 501)]
    got = {r["node"]: r["comp"] for r in jaccard.components(spark, spark.createDataFrame(links, "a long, b long")).collect()}
    assert {v for k, v in got.items() if k < 400} == {0} and got[501] == 500


def test_links_of_a_large_group_are_all_counted(spark, monkeypatch):
    """Long runs of near copies, with equal copies among them, in one block and in many."""
    rng = random.Random(4)
    rows = corpus(rng, [(60, 80, 0.015), (40, 120, 0.03), (12, 40, 0.0), (30, 6, 0.02)], tables.prose(rng, 55))
    sets = [shingles(t) for _, t in rows]
    first = {}
    for (d, _), s in zip(rows, sets):
        first.setdefault(frozenset(s), d)
    cls = [first[frozenset(s)] for s in sets]
    links = {(i, j) for i, a in enumerate(sets) for j, b in enumerate(sets) if i != j and 100 * len(a & b) >= 80 * len(a | b)}
    want = {i: (cls[i], len({cls[j] for x, j in links if x == i} - {cls[i]}), sum(x == i for x, _ in links)) for i in range(len(rows))}
    pairs = sorted({(cls[i], cls[j]) for i, j in links if cls[i] < cls[j]})
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for size in (jaccard.BLOCK_CLASSES, 16):
        monkeypatch.setattr(jaccard, "BLOCK_CLASSES", size)
        assert {r.doc_id: (r.class_id, r.class_links, r.n_links) for r in jaccard.join_classes(spark, df).collect()} == want
        assert sorted((r.a, r.b) for r in jaccard.join_pairs(spark, df).collect()) == pairs


def test_overlaps_equal_set_overlap():
    rng = np.random.default_rng(5)
    base = rng.choice(10_000, 300, replace=False).astype(np.uint64)
    draw = lambda: np.sort(np.concatenate([base[rng.random(300) < 0.9], rng.choice(10_000, 40, replace=False).astype(np.uint64) + np.uint64(20_000)]))
    xs, ys = [draw() for _ in range(40)], [draw() for _ in range(30)]
    assert jaccard.overlaps(xs, ys).tolist() == [[len(np.intersect1d(x, y)) for y in ys] for x in xs]


def test_stars_of_links():
    rng = np.random.default_rng(6)
    for n, m in ((2, 1), (50, 30), (50, 200), (1000, 900)):
        u, v = rng.integers(-n, n, m), rng.integers(-n, n, m)
        got = dict(zip(*(x.tolist() for x in jaccard.stars(u, v))))
        root = {}
        for x in sorted(set(u.tolist()) | set(v.tolist())):
            if x not in root:
                seen, todo = {x}, [x]
                while todo:
                    y = todo.pop()
                    near = set(v[u == y].tolist() + u[v == y].tolist()) - seen
                    seen |= near
                    todo += near
                root |= dict.fromkeys(seen, x)
        assert got == {k: r for k, r in root.items() if k != r}
    assert [len(x) for x in jaccard.stars(*(np.zeros(0, np.int64),) * 2)] == [0, 0]


def test_components_go_on_from_known_ones(spark):
    """Few jobs: no round over what is stars already, and later links join the stars of earlier ones."""
    at = lambda df: {r["node"]: r["comp"] for r in df.collect()}
    pairs = lambda x: spark.createDataFrame(x, "a long, b long")
    first = jaccard.components(spark, pairs([(5, 9), (9, 7), (20, 21), (30, 31)]))
    assert at(first) == {9: 5, 7: 5, 21: 20, 31: 30}
    got = at(jaccard.components(spark, pairs([(7, 21), (40, 31)]), first))
    assert got == {9: 5, 7: 5, 20: 5, 21: 5, 31: 30, 40: 30}


def test_join_leaves_no_shuffle_files(spark):
    """They would stay until the driver's JVM collects its garbage, which counts as disk until then."""
    import glob
    import os

    rng = random.Random(7)
    df = spark.createDataFrame(corpus(rng, [(30, 80, 0.015)], tables.prose(rng, 55)), "doc_id long, text string").repartition(5)
    folders = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    left = lambda: {f for d in folders for f in glob.glob(os.path.join(d.getPath(), "*", "shuffle_*"))}
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was, before = spark.conf.get(key), left()
    jaccard.join_classes(spark, df)
    assert not left() - before and spark.conf.get(key) == was
