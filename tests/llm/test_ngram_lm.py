import math
import os
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from pairwright.llm import ngram_lm

from . import tables


def words(t):
    return [w.lower() for w in (t or "").encode().split()] + ["<end>"]


def discounts(counts):
    """From the numbers of things that were counted once, twice, three and four times."""
    n1, n2, n3, n4 = (sum(n == k for n in counts) for k in (1, 2, 3, 4))
    y = n1 / (n1 + 2 * n2) if n1 else 0.5
    d1 = 1 - 2 * y * n2 / n1 if n1 else 0.5
    d2 = 2 - 3 * y * n3 / n2 if n2 else d1
    d3 = 3 - 4 * y * n4 / n3 if n3 else d2
    return [min(max(d, 0.1), k) for k, d in ((1, d1), (2, d2), (3, d3))]


class Plain:
    """Interpolated modified Kneser-Ney over trigrams, with dicts."""

    def __init__(self, texts):
        self.three, self.uni = Counter(), Counter()
        for t in texts:
            w = words(t)
            for u, v, x in zip(["<start>", "<start>", *w], ["<start>", *w], w):
                self.three[u, v, x] += 1
                self.uni[x] += 1
        self.two = Counter((v, x) for _, v, x in self.three)
        self.one = Counter(x for _, x in self.two)
        self.d = {k: discounts(c.values()) for k, c in ((3, self.three), (2, self.two), (1, self.one))}
        self.ctx = {3: defaultdict(list), 2: defaultdict(list)}
        for k, c in ((3, self.three), (2, self.two)):
            for key, n in c.items():
                self.ctx[k][key[:-1]].append(n)

    def off(self, k, n):
        return self.d[k][min(n, 3) - 1] if n else 0

    def level(self, k, counts, context, key, lower):
        own = self.ctx[k].get(context)
        if not own:
            return lower
        n = counts.get(key, 0)
        return (n - self.off(k, n)) / sum(own) + sum(self.off(k, c) for c in own) / sum(own) * lower

    def p(self, x, u, v):
        n = self.one.get(x, 0)
        low = (n - self.off(1, n) + sum(self.off(1, c) for c in self.one.values()) / (len(self.uni) + 1)) / len(self.two)
        return self.level(3, self.three, (u, v), (u, v, x), self.level(2, self.two, (v,), (v, x), low))


@pytest.mark.parametrize("shard_tokens, split", [(2_000_000, 1e9), (100, 0.25)])
def test_equals_the_plain_model(spark, monkeypatch, shard_tokens, split):
    """No middle word split, and few tokens a shard, so that frequent ones are."""
    monkeypatch.setattr(ngram_lm, "SHARD_TOKENS", shard_tokens)
    monkeypatch.setattr(ngram_lm, "SPLIT", split)
    rng = random.Random(1)
    rows = [(i, tables.prose(rng, rng.randint(0, 40)) + rng.choice(["", " Unseen%d" % i, " THA"]), i % 5 == 0) for i in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string, held_out boolean")
    model = ngram_lm.train(spark, df.where(~F.col("held_out")))
    plain = Plain([t for _, t, h in rows if not h])
    total, v = sum(plain.uni.values()), len(plain.uni)
    assert (model["tokens"], model["vocabulary"], model["pair_types"], model["triple_types"]) == (total, v, len(plain.two), len(plain.three))
    assert len(model["deal"].hot) == 0 if split > 1 else model["deal"].parts.max() > 1
    for r in ngram_lm.score(df, model).collect():
        w = words(rows[r.doc_id][1])
        assert r.score == pytest.approx(sum(math.log10(plain.p(x, u, c)) for u, c, x in zip(["<start>", "<start>", *w], ["<start>", *w], w)), rel=1e-9)
        assert r.base_score == pytest.approx(sum(math.log10((plain.uni[x] + 1) / (total + v + 1)) for x in w), rel=1e-9)
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(plain.uni[x] > 0 for x in w), total)
    for u, c in (("<start>", "<start>"), ("<start>", "tha"), ("tha", "tha"), ("never", "tha"), ("tha", "never")):  # probabilities of all words and one unknown sum to 1
        assert sum(plain.p(x, u, c) for x in plain.uni) + plain.p("<unknown>", u, c) == pytest.approx(1.0)


def test_edges(spark):
    df = tables.edges(spark).withColumn("held_out", F.lit(False))
    got = {r.doc_id: r for r in ngram_lm.score(df, ngram_lm.train(spark, df)).collect()}
    assert got[1].n_tokens == got[2].n_tokens == got[3].n_tokens == 1 and got[5].n_tokens == 40_001
    assert all(r.score < 0 for r in got.values())
    none = ngram_lm.train(spark, df.limit(0))
    assert {(r.score, r.base_score, r.n_known) for r in ngram_lm.score(df, none).collect()} == {(0.0, 0.0, 0)}
    assert ngram_lm.score(tables.empty(spark).withColumn("held_out", F.lit(False)), none).count() == 0


def test_tables_give_rows_back():
    import numpy as np

    rng = np.random.default_rng(3)
    for n in (1, 63, 64, 65, 5000):
        key = np.sort(rng.integers(0, 2**63, n).astype(np.uint64) * np.uint64(2))
        a, b = rng.geometric(0.6, n), rng.integers(0, 3, n)
        places, stored, bits, before, code, va, vb = ngram_lm.unpack(ngram_lm._table(key, a, b))
        c = ngram_lm._codes(np.arange(n), bits, before, code)
        assert (va[c] == a).all() and (vb[c] == b).all() and len(stored) == n and places[-1] == n
        assert (ngram_lm._from_planes(ngram_lm._planes(key)) == key).all()


def test_open_shards_hold_no_descriptors(tmp_path):
    for s in range(200):
        ngram_lm._write(f"file://{tmp_path}", f"triple-{s}", ngram_lm.pack(np.array([s])))
    model, before = ngram_lm.Model(f"file://{tmp_path}"), len(os.listdir("/proc/self/fd"))
    assert [int(model.arrays(f"triple-{s}")[0][0]) for s in range(200)] == list(range(200))
    assert len(os.listdir("/proc/self/fd")) <= before


def test_checkpoint_folder_without_a_store(spark, tmp_path, monkeypatch):
    """A plain path is a folder on a file system: mapped in place, as addFile takes no local folder on a cluster."""
    monkeypatch.setattr(type(spark.sparkContext), "addFile", lambda *a, **b: pytest.fail("copied"))
    conf = spark._jsparkSession.sessionState().conf()
    conf.setConfString("spark.checkpoint.dir", str(tmp_path))
    try:
        m = ngram_lm.train(spark, spark.createDataFrame([("a b c",)], "text string"))
        assert m["folder"].startswith("file:") and m["tokens"] == 4
    finally:
        conf.unsetConf("spark.checkpoint.dir")
