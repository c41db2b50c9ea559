"""The fuzzy phase by blocks: edit distances of many pairs, the best of a block, and what is stored."""

import os
import random
import urllib.parse

import pytest
from pyspark.sql import functions as F

from pairwright.operators import blocks, classes, features, matching
from pairwright.storage import application_folder

from . import plain
from .test_matching import frame, plain_edits


@pytest.mark.parametrize("letters, longest", [("ab", 5), ("abé字 ", 70), ("abc", 140), ("xyz", 300)])
@pytest.mark.parametrize("table", [blocks.TABLE, 4000])
def test_distances_equal_the_table(monkeypatch, letters, longest, table):
    monkeypatch.setattr(blocks, "TABLE", table)
    rng = random.Random(longest)
    x, y = (["", *("".join(rng.choice(letters) for _ in range(rng.randint(0, longest))) for _ in range(n))] for n in (7, 8))
    pairs = [(i, j) for i in range(len(x)) for j in range(len(y))]
    want = [plain_edits(classes._points(x[i]), classes._points(y[j])) for i, j in pairs]
    a, b = blocks.Texts(x), blocks.Texts(y)
    for times in (1, 40):  # few pairs go one by one
        i, j = (blocks.np.array([p[k] for p in pairs] * times) for k in (0, 1))
        assert blocks.distances(a, b, i, j).tolist() == want * times


def _features(spark, seed, n):
    rng = random.Random(seed)
    return [features.extract_features(frame(spark, plain.program(rng, n))) for _ in range(2)]


def _block(spark, side, reach=None):
    """All of a side as one block."""
    rows = side.withColumn("reach", F.lit(None).cast("struct<confidence: double, similarity: double>"))
    return blocks.pickle.loads(blocks.packed(spark, rows)[0].first()["packed"])


def test_best_of_a_block_equals_all_pairs_and_compares_few_sequences(spark, monkeypatch):
    left, right = (_block(spark, d) for d in matching._alike(*_features(spark, 3, 50)))
    every = blocks.all_pairs(0.6, 0.5)(left, right)
    order = every.sort_values(["idx_a", "confidence", "similarity", "idx_b"], ascending=[True, False, False, True])
    want = order.groupby("idx_a").first().reset_index()[["idx_a", "idx_b", "similarity", "confidence"]]
    compared, plain_compare = [], blocks.Scores.compare
    monkeypatch.setattr(blocks.Scores, "compare", lambda self, i, j: compared.append(len(i)) or plain_compare(self, i, j))
    got = blocks.best_pairs(0.6, 0.5)(left, right).sort_values("idx_a")
    assert got.values.tolist() == want.values.tolist()
    assert sum(compared) < 50 * 50 / 3
    # A row that reaches as much elsewhere keeps only what does as well.
    best = dict(zip(want["idx_a"], zip(want["confidence"], want["similarity"])))
    left[1]["c"], left[1]["s"] = (blocks.np.array([best.get(i, (2.0, 2.0))[k] for i in left[1]["idx"].tolist()]) for k in (0, 1))
    assert blocks.best_pairs(0.6, 0.5)(left, right).sort_values("idx_a").values.tolist() == want.values.tolist()
    left[1]["s"] += 0.01
    assert not len(blocks.best_pairs(0.6, 0.5)(left, right))


def _stored_bytes(spark):
    top = urllib.parse.urlparse(application_folder(spark)).path
    return sum(os.path.getsize(f"{d}/{f}") for d, _, names in os.walk(top) for f in names)


@pytest.mark.parametrize("run", [lambda s, a, b: matching.fuzzy_matches(a, b), lambda s, a, b: matching.fuzzy_candidates(a, b, 0.0, 0.0)], ids=["matches", "candidates"])
def test_what_is_stored_grows_with_rows_not_pairs(spark, run):
    grown = []
    for n in (80, 240):
        a, b = _features(spark, 7, n)
        before = _stored_bytes(spark)
        run(spark, a, b).count()
        grown.append(_stored_bytes(spark) - before)
    assert grown[1] < 4 * grown[0], grown
