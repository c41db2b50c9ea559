import random
import zlib

import pytest

from pairwright.llm import sharding

from . import tables


def test_sizes_near_equal_and_places_gapless(spark):
    rng = random.Random(1)
    rows = [(i, "x" * int(rng.paretovariate(1) * 50 % 5000)) for i in range(3000)]
    got = sharding.place(spark, spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text", 8).collect()
    assert len(got) == 3000
    loads = [sum(r["size"] for r in got if r["shard"] == k) for k in range(8)]
    assert max(loads) - min(loads) <= 2
    for k in range(8):
        own = sorted(r["slot"] for r in got if r["shard"] == k)
        assert own == list(range(len(own)))
    text = dict(rows)
    assert all(r["text_crc32"] == zlib.crc32(text[r["doc_id"]].encode()) and r["size"] == len(text[r["doc_id"]]) + 1 for r in got)


def test_map_is_stored_by_version_and_edited(spark, tmp_path):
    path = str(tmp_path / "map")
    df = spark.createDataFrame([(i, "y" * (i % 97)) for i in range(500)], "doc_id long, text string")
    sharding.place(spark, df, "doc_id", "text", 8, map_path=path).count()
    first, edited = sharding.load_map(spark, path, 1), sharding.load_map(spark, path, 2)
    assert first == sharding.first_map(sharding.N_SLOTS, 8) and len(edited) == sharding.N_SLOTS
    assert sum(a != b for a, b in zip(first, edited)) < 100  # an edit, not a new map


def test_growth_moves_slots_only_into_the_new_shard():
    rng = random.Random(2)
    weights = {s: rng.randrange(1, 1000) for s in range(4096)}
    even = sharding.rebalance(sharding.first_map(4096, 8), weights, 8)
    grown = sharding.rebalance(even, weights, 9, only_into=8)
    assert all(a == b or b == 8 for a, b in zip(even, grown))
    loads = [sum(w for s, w in weights.items() if grown[s] == k) for k in range(9)]
    assert max(loads) - min(loads) < 0.01 * sum(loads)


@pytest.mark.parametrize("weights", [{}, {1: 10}, {1: 10**9, 2: 1, 3: 1}, dict.fromkeys(range(20), 5)])
def test_rebalance_ends_on_odd_weights(weights):
    out = sharding.rebalance(sharding.first_map(64, 8), weights, 8)
    loads = [sum(w for s, w in weights.items() if out[s] == k) for k in range(8)]
    assert sum(loads) == sum(weights.values()) and max(loads) <= max([*weights.values(), sum(weights.values()) // 8 + 5], default=0)


def test_edges(spark):
    got = sharding.place(spark, tables.edges(spark), "doc_id", "text", 8, keep=["lang"]).collect()
    assert len(got) == len(tables.EDGES) and {r["size"] for r in got if r["doc_id"] in (1, 2)} == {1}
    assert sharding.place(spark, tables.empty(spark), "doc_id", "text", 8).count() == 0
