"""Hierarchical language identification: the family first, then one-versus-one linear SVMs inside it.

Features: hashed character bi- and trigrams of the lower-cased text (everything but letters is one separator), as
shares of the text's grams. Each decision is one weight vector, so a text's margin is the sum of the weights of its
grams: one gather per gram for all decisions at once.

The classifier is fitted on a bounded sample: about SAMPLE_PER_LANG documents of each language, fewer where there are
so many languages that it would be over SAMPLE_ALL in all, chosen by a hash of the id over the whole training part
(among texts of up to SAMPLE_CHARS characters, where a language has any). Every language that a labelled row names is
learned. Every text is scored whole.

Defined cases: a text that is null or has no letter is `und` with score 0; with no labelled rows every text is `und`;
with one language that language is predicted with score 1; a language none of whose texts has a letter is not learned;
repeated rows are predicted each; very long texts are read whole; an empty table stays empty; further columns pass
through, but one named as an output is replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, text_slices, tidy

BUCKETS = 1 << 15
#: Documents of each language that the classifier may learn from (a documented bound).
SAMPLE_PER_LANG = 500
#: Documents of all languages together, and the longest text taken where a language has shorter ones.
SAMPLE_ALL, SAMPLE_CHARS = 64_000, 50_000
#: Languages that share a branch of the hierarchy (fixed values); any other language is a family of its own.
FAMILIES = {
    "en": "germanic", "de": "germanic", "nl": "germanic", "sv": "germanic", "da": "germanic", "no": "germanic",
    "fr": "romance", "es": "romance", "it": "romance", "pt": "romance", "ro": "romance", "ca": "romance",
    "ru": "slavic", "uk": "slavic", "pl": "slavic", "cs": "slavic",
}
UND = "und"
_LETTER: list[np.ndarray] = []


def _letters() -> np.ndarray:
    if not _LETTER:
        _LETTER.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _LETTER[0]


def grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of each gram of all texts, each text's first gram, and whether it has a letter."""
    low = [(t or "").lower() + "  " for t in texts]
    c = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
    ends = np.cumsum(np.fromiter(map(len, low), np.int64, len(low)))
    starts = ends - np.fromiter(map(len, low), np.int64, len(low))
    letter = _letters()[c]
    # Two blanks stand before every text, the first of a slice as well, so a text's grams are its own.
    x = np.append(np.uint32([32, 32]), np.where(letter, c, 32).astype(np.uint32))
    has = np.logical_or.reduceat(letter, starts) if len(starts) else np.zeros(0, bool)
    two = x * np.uint32(0x9E3779B1)
    two[1:] += x[:-1] * np.uint32(0x85EBCA6B)
    three = two.copy()
    three[2:] += x[:-2] * np.uint32(0xC2B2AE35) + np.uint32(0x27D4EB2F)
    out = np.empty(2 * len(c), np.uint16)
    for k, h in enumerate((two[2:], three[2:])):
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        out[k::2] = h >> np.uint32(17)
    return out, 2 * starts, has


def _sparse(batches):
    for b in batches:
        for s in text_slices(b, 1):
            g, at, has = grams(s.column(1).to_pylist())
            ends = np.append(at[1:], len(g))
            rows = [np.unique(g[i:j], return_counts=True) for i, j in zip(at, ends)]
            keep = [i for i in range(len(rows)) if has[i]]
            yield pa.RecordBatch.from_arrays(
                [pa.array([s.column(0)[i].as_py() for i in keep], pa.string()), pa.array([rows[i][0].astype(np.int32) for i in keep], pa.list_(pa.int32())), pa.array([(rows[i][1] / rows[i][1].sum()).astype(np.float32) for i in keep], pa.list_(pa.float32()))], names=["lang", "f", "v"]
            )


def _svm(rows: list, y: np.ndarray, epochs: int = 12, c: float = 1.0) -> np.ndarray:
    """Linear SVM by dual coordinate descent; the last weight is the bias."""
    w = np.zeros(BUCKETS + 1)
    a, n = np.zeros(len(rows)), [float(v @ v) for _, v in rows]
    # Classes weigh the same, however many rows each has.
    top = np.where(y > 0, c * len(y) / max(1, 2 * (y > 0).sum()), c * len(y) / max(1, 2 * (y < 0).sum()))
    rng = np.random.default_rng(7)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            f, v = rows[i]
            d = min(max(a[i] + (1 - y[i] * (w[f] @ v)) / n[i], 0.0), top[i]) - a[i]
            if d:
                a[i] += d
                w[f] += d * y[i] * v
    return w


def _slope(m: np.ndarray, y: np.ndarray) -> float:
    """The factor that turns margins into log odds with the least log loss."""
    grid = np.geomspace(0.5, 8, 25)
    return float(grid[np.argmin([np.logaddexp(0, -g * m * y).mean() + 0.01 * g for g in grid])])


def fit(train: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = SAMPLE_PER_LANG, families: dict[str, str] = FAMILIES) -> dict:
    """The model: languages, families, decisions (positive side, negative side), weights and slopes."""
    bound_batches(train.sparkSession)
    known = train.where(F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}"))
    fits = F.char_length(text_col) <= SAMPLE_CHARS
    counts = {r[0]: (r[1], r[2]) for r in known.groupBy(lang_col).agg(F.count("*"), F.count_if(fits)).collect()}
    if not counts:
        return {"langs": []}
    per_lang = min(per_lang, max(20, SAMPLE_ALL // len(counts)))
    u = (F.xxhash64(F.col(id_col).cast("string"), F.lit(1)).cast("double") / 2.0**64) + 0.5
    # Small languages are taken whole, so none is left out by chance.
    rates = train.sparkSession.createDataFrame([(k, bool(short), 1.0 if (short or n) <= 4 * per_lang / 3 else per_lang / (short or n)) for k, (n, short) in sorted(counts.items())], "__l string, __short boolean, __rate double")
    rated = known.join(F.broadcast(rates), F.col(lang_col) == F.col("__l"))
    picked = rated.where((u < F.col("__rate")) & (fits | ~F.col("__short"))).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    got = picked.mapInArrow(_sparse, "lang string, f array<int>, v array<float>").toArrow()
    lang = got["lang"].to_pylist()
    df = np.bincount(np.concatenate([np.asarray(x.values) for x in got["f"]]) if len(lang) else np.zeros(0, int), minlength=BUCKETS)
    # Rare grams count a little more; the square root of the mean share evens the scale out.
    mean = np.bincount(np.concatenate([np.asarray(x.values) for x in got["f"]]), np.concatenate([np.asarray(x.values) for x in got["v"]]), BUCKETS) / max(1, len(lang)) if len(lang) else np.zeros(BUCKETS)
    scale = np.where(df >= 2, 1.0 / np.sqrt(mean + 1e-6), 0.0)
    rows = [(np.append(np.asarray(f.values), BUCKETS), np.append(np.asarray(v.values) * scale[np.asarray(f.values)], 1.0)) for f, v in zip(got["f"], got["v"])]
    # A fixed order, so that the model does not depend on how tasks were dealt.
    by = sorted(range(len(rows)), key=lambda i: (lang[i], rows[i][0].tobytes(), rows[i][1].tobytes()))
    rows, lang = [rows[i] for i in by], [lang[i] for i in by]
    langs = sorted(set(lang))
    fam = {k: families.get(k, k) for k in langs}
    fams = sorted(set(fam.values()))
    decide = [("family", k, None) for k in fams] if len(fams) > 2 else [("family", fams[0], fams[1])] if len(fams) == 2 else []
    decide += [("lang", a, b) for i, a in enumerate(langs) for b in langs[i + 1 :] if fam[a] == fam[b]]
    weights, bias, slopes = np.zeros((BUCKETS, max(1, len(decide))), np.float32), np.zeros(len(decide)), np.ones(len(decide))
    for k, (kind, a, b) in enumerate(decide):
        name = [fam[x] for x in lang] if kind == "family" else lang
        use = [i for i, x in enumerate(name) if x == a or b is None or x == b]
        y = np.array([1.0 if name[i] == a else -1.0 for i in use])
        own = [rows[i] for i in use]
        w = _svm(own, y)
        m = np.array([w[f] @ v for f, v in own])
        weights[:, k], bias[k], slopes[k] = w[:-1] * scale, w[-1], _slope(m, y)
    return {"langs": langs, "family": fam, "families": fams, "decide": decide, "w": weights, "b": bias, "slope": slopes}


def predict(model: dict, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    langs = model["langs"]
    if not langs or not texts:
        return [UND] * len(texts), np.zeros(len(texts))
    g, at, has = grams(texts)
    ends = np.append(at[1:], len(g))
    m = np.stack([np.add.reduceat(model["w"][:, k][g], at, dtype=np.float64) for k in range(max(1, len(model["decide"])))], 1)
    with np.errstate(over="ignore"):
        p = 1 / (1 + np.exp(-model["slope"] * (m[:, : len(model["decide"])] / (ends - at)[:, None] + model["b"])))
    fams = model["families"]
    fp = np.ones((len(texts), len(fams)))
    col = {(kind, a, b): k for k, (kind, a, b) in enumerate(model["decide"])}
    if len(fams) == 2:
        fp[:, 0] = p[:, col["family", fams[0], fams[1]]]
        fp[:, 1] = 1 - fp[:, 0]
    elif len(fams) > 2:
        fp = np.stack([p[:, col["family", f, None]] for f in fams], 1)
        fp /= fp.sum(1, keepdims=True) + 1e-12
    votes = np.zeros((len(texts), len(langs)))
    for (kind, a, b), k in col.items():
        if kind == "lang":
            votes[:, langs.index(a)] += p[:, k]
            votes[:, langs.index(b)] += 1 - p[:, k]
    size = {f: sum(v == f for v in model["family"].values()) for f in fams}
    for j, k in enumerate(langs):
        votes[:, j] = votes[:, j] / (size[model["family"][k]] - 1) if size[model["family"][k]] > 1 else 1.0
    best_f = np.argmax(fp, 1)
    mask = np.array([[model["family"][k] == f for k in langs] for f in fams])[best_f]
    best = np.argmax(np.where(mask, votes, -1.0), 1)
    score = fp[np.arange(len(texts)), best_f] * np.minimum(1, votes[np.arange(len(texts)), best])
    return [langs[i] if h else UND for i, h in zip(best, has)], np.where(has, np.clip(score, 0, 1), 0.0)


def identify(df: DataFrame, model: dict, text_col: str = "text", lang_out: str = "lang_pred", score_out: str = "score") -> DataFrame:
    """df with the predicted language and its score; only the text travels to Python."""

    bound_batches(df.sparkSession)

    def score(batches):
        for arr in batches:
            names, values = [], []
            for s in text_slices(pa.RecordBatch.from_arrays([arr], names=["t"])):
                a, b = predict(model, s.column(0).to_pylist())
                names += a
                values.append(b)
            yield pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(np.concatenate(values) if values else np.zeros(0))], ["lang", "score"])

    from collections.abc import Iterator

    score = tidy(score)
    score.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    udf = F.arrow_udf(score, "lang string, score double")
    return df.withColumn("__lid", udf(F.col(text_col))).withColumns({lang_out: F.col("__lid.lang"), score_out: F.col("__lid.score")}).drop("__lid")
