import math

import pytest
from pyspark.sql import functions as F

from pairwright.functions import kernels as K
from pairwright.operators import features, lite, results, textdiff

from . import plain


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


def arr(*xs):
    return F.array(*map(F.lit, xs)) if xs else F.array().cast("array<string>")


@pytest.mark.parametrize("name", ["", "j_j_sub_1", "j_", "fcn.1", "fcnx", "unnamed", "main", "j_main", "FUN_a", "loc_", "func"])
def test_auto_names(spark, name):
    assert one(spark, K.is_auto_generated_name(F.lit(name))) == plain.is_auto(name)


@pytest.mark.parametrize("a,b", [("", ""), ("a", ""), ("é", "e"), ("éé", "é"), ("日本", "日"), ("abc", "axc"), ("ñx", "xñ")])
def test_edit_distance_counts_bytes(spark, a, b):
    assert one(spark, K.normalized_edit_distance(F.lit(a), F.lit(b))) == pytest.approx(plain.edit(a, b))


@pytest.mark.parametrize("o", ["+5", "-7", " 5", "1.5", "9223372036854775807", "9223372036854775808", "-9223372036854775808", "-", "#x", "0x", "", "5\n", "٣"])
def test_constants(spark, o):
    want = bool(plain.constants({"instructions": [{"operands": [o]}]})) if o else False
    assert bool(one(spark, features.constant_operand(F.lit(o)))) == want


def test_quoted(spark):
    assert one(spark, features.quoted_operand(F.lit('"'))) and not one(spark, features.quoted_operand(F.lit('"a')))


def test_empty_rules(spark):
    assert one(spark, K.jaccard(arr(), arr())) == 1.0
    assert one(spark, K.jaccard(arr("a"), arr())) == 0.0
    z, n = F.lit(0), F.lit(3)
    assert [one(spark, K.ratio(*p)) for p in ((z, z), (z, n), (n, n))] == [1.0, 0.0, 1.0]
    tags = lambda *x: K.occurrence_tags(arr(*x))
    assert one(spark, K.multiset_share(tags(), tags(), z, z)) == 1.0
    assert one(spark, K.multiset_share(tags("a"), tags(), F.lit(1), z)) == 0.0
    assert one(spark, K.multiset_share(tags("a", "a", "b"), tags("a", "b", "b"), n, n)) == pytest.approx(2 / 3)


def test_sanitize_and_cosine(spark):
    assert [one(spark, K.sanitize(F.lit(x))) for x in (math.nan, -1.0, 0.4, 3.0)] == [0.0, 0.0, 0.4, 1.0]
    h = lambda *x: K.histogram(arr(*x))
    assert one(spark, K.cosine(h("a", "a"), h("b"))) == 0.0
    assert one(spark, K.cosine(h(), h("b"))) == 0.0
    assert one(spark, K.cosine(h("a", "b"), h("a", "b"))) == pytest.approx(1.0)


def test_primes_wrap_to_zero(spark):
    word = next(chr(c) for c in range(97, 123) if c % 25 == 0)
    assert int(one(spark, K.small_primes_product(arr(*[word] * 64)))) == 0
    assert int(one(spark, K.small_primes_product(arr(*[word] * 63)))) == 2**63
    assert int(one(spark, K.small_primes_product(arr("", "call")))) == 2 * 41


def test_bands(spark):
    values = [0.9, 0.8, 0.67, 0.6, 0.34, 0.1]
    got = [tuple(one(spark, f(F.lit(v))) for f in (K.html_band, K.text_band, K.log_band)) for v in values]
    assert [g[0] for g in got] == ["high-confidence"] * 3 + ["medium-confidence"] * 2 + ["low-confidence"]
    assert [g[1] for g in got] == ["high", "medium", "medium", "low", "low", "low"]
    assert [g[2] for g in got] == ["high", "medium", "low", "low", "low", "low"]


def test_lite_general_score(spark):
    hash_, bb, edge, flow = (lite.TECHNIQUES[k] for k in (0, 1, 3, 7))
    score, top = lite.general_similarity([(hash_, F.lit(1.0), 10.0), (bb, F.lit(0.5), 2.0), (edge, F.lit(None).cast("double"), 1.5)])
    assert one(spark, score) == pytest.approx(11 / 12) and one(spark, top) == "Hash Match"
    assert one(spark, lite.general_similarity([(hash_, F.lit(0.0), 10.0), (bb, F.lit(0.0), 2.0)])[1]) == "Mixed"
    assert one(spark, lite.general_similarity([(hash_, F.lit(0.0), 10.0), (bb, F.lit(0.5), 2.0), (edge, F.lit(1.0), 1.0)])[1]) == bb
    parts = [(hash_, F.lit(0.0), 10.0), (bb, F.lit(1.0), 2.0), (flow, F.lit(0.5), 4.0), (flow, F.lit(0.5), 4.0)]
    assert one(spark, lite.general_similarity(parts)[1]) == flow
    i = lambda *x: F.array(*map(F.lit, x)) if x else F.array().cast("array<int>")
    assert one(spark, lite.prime_similarity(i(), i())) == 1.0
    assert one(spark, lite.prime_similarity(i(2), i())) == 0.0
    assert one(spark, lite.prime_similarity(i(2, 3), i(2, 5))) == pytest.approx(0.5 / 3 + 0.3 + 0.2 * 0.6)
    assert one(spark, lite.small_constants(i(1, 65535, 65536))) == [1, 65535]


def test_text_helpers(spark):
    assert one(spark, textdiff.escape_html(F.lit("a<b>&\t c"))) == "a&lt;b&gt;&amp;" + "&nbsp;" * 5 + "c"
    assert one(spark, results.cut_name(F.lit("x" * 29))) == "x" * 25 + "..."
    assert one(spark, results.cut_name(F.lit("x" * 28))) == "x" * 28
    assert one(spark, results.hex_address(F.lit("18446744073709551615"), 16)) == "0x" + "f" * 16
    assert [results.threshold(x) for x in ("0.5", "x", None)] == [0.5, 0.0, 0.0]
