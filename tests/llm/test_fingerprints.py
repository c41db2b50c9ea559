import hashlib
import random

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from pairwright.llm import fingerprints as fp

from . import tables


def keys(text):
    k, at = fp.paragraph_keys(pa.array([text]))
    return k[at[0] : at[1]]


def apart(x, y):
    one = lambda k: fp.Prints(k, np.array([0, len(k)]))
    return fp.differing(one(x), np.zeros(1, int), one(y), np.zeros(1, int))[0]


def test_peeling_recovers_the_differing_digests():
    rng = random.Random(1)
    paragraphs = [tables.prose(rng, 9) for _ in range(300)]
    for size, swaps in ((0, 0), (1, 1), (5, 2), (40, 3), (300, 200)):
        a = paragraphs[:size]
        b = [tables.prose(rng, 9) if rng.random() < swaps / max(1, size) else p for p in a]
        x, y = keys("\n".join(a)), keys("\n".join(b))
        at = lambda k: np.array([0, len(k)])
        assert apart(x, y) == len(set(x.tolist()) ^ set(y.tolist()))
        done, _, found, sign = fp.peel(fp.subtract(fp.sketch(x, at(x), 3072), fp.sketch(y, at(y), 3072)))
        assert done[0] and set(found.tolist()) == set(x.tolist()) ^ set(y.tolist())
        assert {k for k, s in zip(found.tolist(), sign.tolist()) if s == 1} == set(x.tolist()) - set(y.tolist())


@settings(max_examples=40, deadline=None)
@given(st.lists(st.sampled_from("abcdefgh")), st.lists(st.sampled_from("abcdefghijk")))
def test_differences_of_multisets(a, b):
    from collections import Counter

    x, y = keys("\n".join(a)), keys("\n".join(b))
    p, q = Counter(a), Counter(b)
    assert apart(x, y) == sum(((p - q) + (q - p)).values())


def test_small_sketch_fails_and_says_so():
    x = keys("\n".join(tables.prose(random.Random(k), 3) for k in range(200)))
    done, *_ = fp.peel(fp.subtract(fp.sketch(x, np.array([0, len(x)]), fp.CELLS), fp.sketch(x[:0], np.array([0, 0]), fp.CELLS)))
    assert not done[0]


def test_repeats_count_and_text_form_reads_back():
    assert len(set(keys("same line\nsame line\nother").tolist())) == 3


def test_fingerprints_give_their_digests_back_and_fold():
    rng = random.Random(8)
    texts = ["\n".join(tables.prose(rng, 5) for _ in range(n)) for n in (0, 1, 2, 7, 30, 300, 4000)]
    p = fp.Prints(*fp.paragraph_keys(pa.array(texts)))
    for k, t in enumerate(texts):
        assert fp.digests(p.written(k)).tolist() == sorted(keys(t).tolist())
        size = int(p.size[k])
        assert size <= max(fp.CELLS, 8 * len(keys(t)))
        for m in (fp.CELLS, 2 * fp.CELLS, size):
            if m <= size:
                folded = fp.fold_to(fp.read(p.written(k)), m)
                want = fp.sketch(keys(t), np.array([0, len(keys(t))]), m)
                assert all((x == y).all() for x, y in zip(folded, want))


def expected(rows):
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    out = []
    for i, (doc, text, *_) in enumerate(order):
        t, following = text or "", order[(i + 1) % len(order)][1] or ""
        e = t[: len(t) - len(t) // 2] + following[: len(t) // 2]
        a, b, c = (set(keys(s).tolist()) for s in (t, e, following))
        like = lambda p, q: len(p & q) / len(p | q) if p | q else 1.0
        out.append((doc, len(t), hashlib.sha256(e.encode()).hexdigest(), round(like(a, b), 9), round(like(a, c), 9)))
    return sorted(out, key=str)


def run(spark, df):
    return sorted(((r.doc_id, r.n_chars, r.edited_sha256, round(r.near_edited, 9), round(r.near_next, 9)) for r in fp.fingerprint_documents(spark, df).collect()), key=str)


def test_edits_and_neighbours_equal_brute_force(spark):
    rng = random.Random(4)
    rows = [(i * 7 % 101, "\n".join(tables.prose(rng, rng.randint(0, 30)) for _ in range(rng.randint(0, 6)))) for i in range(101)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert run(spark, df) == expected(rows)
    got = fp.fingerprint_documents(spark, df).collect()
    by_text = {}
    texts = dict(rows)
    for r in got:
        by_text.setdefault(texts[r.doc_id], set()).add(r.fingerprint)
    assert all(len(v) == 1 for v in by_text.values())
    own = {r.doc_id: r for r in got}
    for i, r in own.items():  # both likenesses again, from the returned strings alone
        following = own[(i + 1) % 101]
        assert fp.compare(r.fingerprint, r.edited_fingerprint) == r.near_edited and fp.compare(r.fingerprint, following.fingerprint) == r.near_next


def test_edges(spark):
    assert run(spark, tables.edges(spark)) == expected(tables.EDGES)
    assert run(spark, tables.empty(spark)) == []
    one = [(5, "only one\nhere")]
    assert run(spark, spark.createDataFrame(one, "doc_id long, text string")) == expected(one)
