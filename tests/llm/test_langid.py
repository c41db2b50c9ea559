import random

from pyspark.sql import functions as F

from pairwright.llm import langid

from . import tables

SYLLABLES = {"en": ["th", "ing", "er", "and", "ou"], "de": ["sch", "ung", "ei", "tz", "keit"], "fr": ["eau", "que", "oi", "ez", "eux"], "es": ["ció", "ñ", "ar", "os", "ue"]}


def corpus(seed, n):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        lang = rng.choice(sorted(SYLLABLES))
        mixed = lambda: rng.choice(SYLLABLES[lang] if rng.random() < 0.8 else SYLLABLES[rng.choice(sorted(SYLLABLES))])
        out.append((i, " ".join("".join(mixed() for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(5, 60))), lang))
    return out


def test_held_out_accuracy_and_score(spark):
    df = spark.createDataFrame(corpus(1, 400), "doc_id long, text string, lang string")
    model = langid.fit(df.where("doc_id % 4 <> 2"))
    got = langid.identify(df.where("doc_id % 4 = 2"), model).collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) >= 0.97 * len(got)
    assert all(0 <= r["score"] <= 1 for r in got)
    assert model["families"] == ["germanic", "romance"] and ("lang", "de", "en") in model["decide"]


def test_prediction_reads_the_text_alone(spark):
    df = spark.createDataFrame(corpus(2, 60), "doc_id long, text string, lang string")
    model = langid.fit(df)
    a = langid.identify(df, model).select("doc_id", "lang_pred", "score").collect()
    b = langid.identify(df.withColumns({"lang": F.lit("xx"), "source": F.lit("s")}), model).select("doc_id", "lang_pred", "score").collect()
    assert sorted(a) == sorted(b)


def test_edges(spark):
    df = tables.edges(spark)
    model = langid.fit(df)
    got = {r["doc_id"]: r for r in langid.identify(df, model).collect()}
    assert all(got[k]["lang_pred"] == "und" and got[k]["score"] == 0 for k in (1, 2, 3)) and got[5]["lang_pred"] != "und"
    assert langid.identify(tables.empty(spark), model).count() == 0
    none = langid.fit(df.where("lang is null"))
    assert {r["lang_pred"] for r in langid.identify(df, none).collect()} == {"und"}
    one = langid.fit(df.where("lang = 'de'"))
    assert {r["lang_pred"] for r in langid.identify(df.where("text = 'word'"), one).collect()} == {"de"}


def test_every_language_is_learned(spark):
    """Ninety languages, most of them rare, each in letters of its own."""
    rng = random.Random(4)
    rows = []
    for k in range(90):
        own = [chr(0x4E00 + 30 * k + j) for j in range(12)]
        rows += [(100 * k + i, " ".join("".join(rng.choice(own) for _ in range(4)) for _ in range(12)), f"l{k}") for i in range(60 if k < 3 else 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(df)
    assert len(model["langs"]) == 90
    got = langid.identify(df, model).collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) >= 0.98 * len(got)


def plain_prediction(model, text):
    """Family by its own margin, then votes between languages, gram by gram with dicts."""
    import math

    low = (text or "").lower()
    if not any(c.isalpha() for c in low):
        return "und", 0.0
    folded = [c if c.isalpha() else " " for c in low + "  "]
    buckets = []
    code = [32, 32, *map(ord, folded)]
    for i in range(2, len(code)):
        two = (code[i] * 0x9E3779B1 + code[i - 1] * 0x85EBCA6B) % 2**32
        three = (two + code[i - 2] * 0xC2B2AE35 + 0x27D4EB2F) % 2**32
        for h in (two, three):
            h ^= h >> 15
            buckets.append((h * 0x2C1B3C6D) % 2**32 >> 17)
    p = []
    for k in range(len(model["decide"])):
        margin = sum(float(model["w"][b, k]) for b in buckets) / len(buckets) + float(model["b"][k])
        p.append(1 / (1 + math.exp(-float(model["slope"][k]) * margin)))
    fams, langs = model["families"], model["langs"]
    fp = {}
    for (kind, a, b), x in zip(model["decide"], p):
        if kind == "family":
            fp[a] = x
            if b is not None:
                fp[b] = 1 - x
    if len(fams) == 1:
        fp = {fams[0]: 1.0}
    elif len(fams) > 2:
        total = sum(fp.values()) + 1e-12
        fp = {f: x / total for f, x in fp.items()}
    family = max(fams, key=lambda f: fp[f])
    own = [k for k in langs if model["family"][k] == family]
    votes = {k: [] for k in own}
    for (kind, a, b), x in zip(model["decide"], p):
        if kind == "lang" and a in votes:
            votes[a].append(x)
            votes[b].append(1 - x)
    mean = {k: sum(v) / len(v) if v else 1.0 for k, v in votes.items()}
    best = max(own, key=lambda k: mean[k])
    return best, min(1.0, max(0.0, fp[family] * min(1.0, mean[best])))


def test_predictions_equal_a_plain_version(spark):
    rows = corpus(3, 200) + [(900, None, "en"), (901, "42 !", "en"), (902, "ß", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(df.where("doc_id % 4 <> 2"))
    for r in langid.identify(df, model).collect():
        lang, score = plain_prediction(model, r["text"])
        assert r["lang_pred"] == lang and abs(r["score"] - score) < 1e-6


def test_svm_separates_as_a_plain_one_does():
    """The dual solution against subgradient steps on the same objective."""
    import numpy as np

    rng = np.random.default_rng(1)
    dense = np.vstack([rng.normal(0.5, 1, (60, 6)), rng.normal(-0.5, 1, (60, 6))])
    y = np.repeat([1.0, -1.0], 60)
    rows = [(np.append(np.arange(6), langid.BUCKETS), np.append(x, 1.0)) for x in dense]
    w = langid._svm(rows, y, epochs=300)[[*range(6), langid.BUCKETS]]
    x = np.hstack([dense, np.ones((120, 1))])
    loss = lambda v: 0.5 * v @ v + np.maximum(0, 1 - y * (x @ v)).sum()
    v = np.zeros(7)
    for t in range(1, 20_000):
        v -= (v - (x * (y * ((1 - y * (x @ v)) > 0))[:, None]).sum(0)) / (t + 50)
    assert loss(w) <= loss(v) * 1.01
