import random

import pytest

from pairwright.llm import decontaminate as D

from . import tables


def least_edits(pattern, text):
    """Edits between the pattern and the best place of the text."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, q in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (p != q)))
        row = new
    return min(row)


def brute(items, text):
    """Items of which a window, wherever it starts, lies in the text within its edits."""
    out = set()
    t = D.fold(text)
    for i, s in items:
        s = D.fold(s)
        if len(s) < D.Q:
            at = t.find(s) if s else -1
            while at >= 0 and ((t[at - 1 : at].isalnum() if at else False) or t[at + len(s) : at + len(s) + 1].isalnum()):
                at = t.find(s, at + 1)
            windows = []
            out |= {i} if at >= 0 else set()
        elif len(s) < D.SHORT:
            windows = [(s, D.budget(len(s)))]
        else:
            windows = [(s[k : k + n], e) for n, e in D.SIZES for k in range(len(s) - n + 1)]
        if any(w in t or least_edits(w, t) <= e for w, e in windows):
            out.add(i)
    return out


def edited(rng, s, n):
    for _ in range(n):
        k = rng.randrange(len(s))
        s = rng.choice([s[:k] + s[k + 1 :], s[:k] + "z" + s[k:], s[:k] + "y" + s[k + 1 :]])
    return s


def test_no_place_within_the_budget_is_missed():
    rng = random.Random(3)
    items = [(i, tables.prose(rng, n)) for i, n in enumerate([1, 2, 3, 5, 9, 16, 16, 30])]
    texts = [tables.prose(rng, 30)]
    for _, s in items:
        for n in (0, 1, 2, 4, 5, 6, 9):
            texts.append(tables.prose(rng, 12) + "  " + edited(rng, s.upper() if n == 1 else s, n) + "\n" + tables.prose(rng, 5))
    texts = rng.sample(texts, 24)
    q = D.Queries(items)
    got = {(r[0], r[1]) for r in q.documents(texts)}
    assert got == {(k, i) for k, t in enumerate(texts) for i in brute(items, t)}


def test_frames(spark):
    rng = random.Random(5)
    items = [(i, tables.prose(rng, 20)) for i in range(4)]
    bench = spark.createDataFrame([*items, (9, None), (10, ""), (11, items[0][1])], "item_id long, text string")
    docs = tables.edges(spark).select("doc_id", "text").union(spark.createDataFrame([(50, "x " + items[0][1]), (51, tables.LONG + " " + items[2][1])], "doc_id long, text string"))
    got = sorted((r.doc_id, r.item_id) for r in D.find_leaks(docs, bench).collect())
    assert got == [(50, 0), (50, 11), (51, 2)]
    lists = {r["doc_id"]: r["leaks"] for r in D.contaminated(docs, bench).collect()}
    assert sorted(lists[50]) == [0, 11] and lists[1] == [] and lists[5] == []
    assert D.find_leaks(tables.empty(spark), bench).count() == 0
    assert D.find_leaks(docs, bench.limit(0)).count() == 0


def test_blocks_give_the_same(spark, monkeypatch):
    rng = random.Random(6)
    bench = spark.createDataFrame([(i, tables.prose(rng, 15)) for i in range(9)], "item_id long, text string")
    docs = spark.createDataFrame([(i, tables.prose(rng, 9) + " " + r.text) for i, r in enumerate(bench.collect())], "doc_id long, text string")
    whole = sorted(D.find_leaks(docs, bench).collect())
    monkeypatch.setattr(D, "BLOCK_CHARS", 300)
    assert len(list(D.query_blocks(bench))) > 1 and sorted(D.find_leaks(docs, bench).collect()) == whole


@pytest.mark.parametrize("size, most", D.SIZES)
def test_excerpts_of_the_stated_length_and_edits_are_always_found(size, most):
    rng = random.Random(8)
    items = [(i, tables.prose(rng, 30)) for i in range(6)]
    q = D.Queries(items)
    for n in range(most + 1):
        texts, want = [], []
        for i, s in items:
            s = D.fold(s)
            for _ in range(8):
                at = rng.randrange(len(s) - size + 1)
                texts.append(tables.prose(rng, 12) + " " + edited(rng, s[at : at + size], n) + " " + tables.prose(rng, 12))
                want.append(i)
        got = {(r[0], r[1]) for r in q.documents(texts)}
        assert set(enumerate(want)) <= got


def test_unrelated_prose_is_left_alone():
    rng, other = random.Random(9), random.Random(10)
    q = D.Queries([(i, tables.prose(rng, 60)) for i in range(30)])
    assert q.documents([tables.prose(other, 400) for _ in range(60)]) == []


def test_short_items_are_found_as_they_are():
    q = D.Queries([(0, "abc def"), (1, "é!"), (2, " \n "), (3, None), (4, "a.b"), (5, "12")])
    texts = ["xx abc  DEF yy", "xabc def", "abc defs, abc def", "É!", "xa.b a.bx", "a.b", "x 12", "123", "", None]
    assert [(r, i) for r, i, *_ in q.documents(texts)] == [(0, 0), (2, 0), (3, 1), (5, 4), (6, 5)]


@pytest.mark.parametrize("letters", ["z", "zy", "- "])
def test_texts_and_items_that_repeat_one_gram_take_bounded_memory(letters):
    import tracemalloc

    q = D.Queries([(i, letters * (600 // len(letters))) for i in range(20)] + [(20, tables.prose(random.Random(1), 40))])
    tracemalloc.start()
    got = {(r, i) for r, i, *_ in q.documents([letters * (20_000 // len(letters)), "q" * 20_000])}
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got == {(0, i) for i in range(20)} and peak < 500 << 20


def test_slices_of_hits_give_the_same(monkeypatch):
    rng = random.Random(11)
    items = [(i, tables.prose(rng, 40)) for i in range(12)] + [(12, "ab" * 40)]
    texts = [tables.prose(rng, 30) + " " + edited(rng, s[:90], 5) + " " + tables.prose(rng, 9) + "ab" * rng.randrange(60) for _, s in items]
    whole = {r[:2] for r in D.Queries(items).documents(texts)}
    monkeypatch.setattr(D, "MAX_HITS", 50)
    assert {r[:2] for r in D.Queries(items).documents(texts)} == whole and len(whole) >= 12
