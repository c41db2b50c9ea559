"""The fuzzy phase's comparison of all with all, by blocks of rows that tasks hold as arrays.

Rows are dealt to blocks of about PER rows, rows of equal features together; each block is packed once into one value,
and tasks meet a left block with a right one, so pairs are never stored nor shuffled. Scores are the sums of
`functions.kernels` in the same order, to the last bit. Words are compared by hashes of 64 bits. Features that rows
share are scored once a pair of classes; sequences and names are compared by bits, many pairs at a time.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import kernels as K
from ..storage import all_stored
from .classes import _points

#: Rows of a block, and at least so many before rows are dealt to more blocks than cores need.
PER, LEAST = 512, 64
#: Blocks of either side that one task meets at most.
MET = 4
#: Words of 64 points that the columns of one batch of edit distances hold, and bytes of its table.
BATCH, TABLE = 32_768, 1 << 25
#: Cells of a matrix that counts shared words.
CELLS = 1 << 22
WORDS, NUMBERS = ("calls", "bb_tags", "mnemonic_tags", "constants", "strings"), ("n_bb", "n_instr", "edges_cfg", "edges_total", "size", "complexity")
PAIRS = "idx_a long, idx_b long, similarity double, confidence double"
_ROOM = 1e-9  # for the last bits of a sum


# ---------------------------------------------------------------- edit distances


class Texts:
    """Strings as points, one after the other."""

    def __init__(self, texts):
        each = [np.array(_points(t), np.int32) for t in texts]
        self.size = np.array([len(p) for p in each], np.int64)
        self.start = np.cumsum(self.size) - self.size
        self.points = np.concatenate([*each, np.zeros(0, np.int32)])


def distances(a: Texts, b: Texts, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Edit distance of the i-th text of a and the j-th of b, for arrays of i and j (Myers, Hyyro; words chained)."""
    letters = np.unique(a.points)
    none = len(letters)
    code_a = np.searchsorted(letters, a.points)
    code_b = np.searchsorted(letters, b.points).clip(0, max(0, none - 1))
    code_b = np.where(letters[code_b] == b.points, code_b, none) if none else np.zeros(len(b.points), np.int64)
    out = np.maximum(a.size[i], b.size[j])
    words = -(-a.size[i] // 64)
    part = i // max(1, TABLE // (8 * (none + 1) * max(1, int(words.max(initial=1)))))
    todo = np.flatnonzero((a.size[i] > 0) & (b.size[j] > 0))
    todo = todo[np.lexsort((-b.size[j[todo]], part[todo], words[todo]))]
    cuts = np.flatnonzero((np.diff(words[todo]) != 0) | (np.diff(part[todo]) != 0)) + 1
    for run in np.split(todo, cuts):
        if not len(run):
            continue
        w = int(words[run[0]])
        if len(run) < 24 * w:
            for k in run.tolist():
                x, y = a.start[i[k]], b.start[j[k]]
                out[k] = _whole(a.points[x : x + a.size[i[k]]].tolist(), b.points[y : y + b.size[j[k]]].tolist())
            continue
        rows, at = np.unique(i[run], return_inverse=True)
        table = np.zeros((w, len(rows), none + 1), np.uint64)
        for p in range(int(a.size[rows].max())):
            has = np.flatnonzero(a.size[rows] > p)
            table[p // 64, has, code_a[a.start[rows[has]] + p]] |= np.uint64(1 << p % 64)
        table = table.reshape(w, -1)
        step = max(256, BATCH // w)
        for s in range(0, len(run), step):
            k = run[s : s + step]
            out[k] = _batch(table, at[s : s + step] * (none + 1), a.size[i[k]], code_b, b.start[j[k]], b.size[j[k]])
    return out


def _batch(table: np.ndarray, base: np.ndarray, size: np.ndarray, codes: np.ndarray, at: np.ndarray, long: np.ndarray) -> np.ndarray:
    """Distances of patterns (of so many words in the table) and texts, the longest text first."""
    w, n = len(table), len(size)
    one, top = np.uint64(1), np.uint64(63)
    up, down = np.full((w, n), ~np.uint64(0)), np.zeros((w, n), np.uint64)
    last = ((size - 1) % 64).astype(np.uint64)
    score, at = size.astype(np.uint64), at.copy()
    c, more_in, less_in = np.empty(n, np.int64), np.empty(n, np.uint64), np.empty(n, np.uint64)
    eq, xv, h, more, less, t = (np.empty(n, np.uint64) for _ in range(6))
    open_ = np.searchsorted(-long, -np.arange(int(long[0])), side="left")  # texts longer than this place
    for m in open_.tolist():
        if m < len(c):
            c, more_in, less_in, eq, xv, h, more, less, t = (x[:m] for x in (c, more_in, less_in, eq, xv, h, more, less, t))
        np.take(codes, at[:m], out=c, mode="clip")
        at[:m] += 1
        c += base[:m]
        for k in range(w):
            pv, mv = up[k, :m], down[k, :m]
            np.take(table[k], c, out=eq, mode="clip")
            np.bitwise_or(eq, mv, out=xv)
            if k:
                eq |= less_in
            np.bitwise_and(eq, pv, out=h)
            h += pv
            h ^= pv
            h |= eq
            np.bitwise_and(pv, h, out=less)
            np.bitwise_or(h, pv, out=more)
            np.invert(more, out=more)
            more |= mv
            if k == w - 1:
                np.right_shift(more, last[:m], out=t)
                t &= one
                score[:m] += t
                np.right_shift(less, last[:m], out=t)
                t &= one
                score[:m] -= t
            else:
                np.right_shift(more, top, out=h)
                np.right_shift(less, top, out=t)
            np.left_shift(more, one, out=more)
            np.left_shift(less, one, out=less)
            if k:
                more |= more_in
                less |= less_in
            else:
                more |= one
            if k < w - 1:
                more_in[:], less_in[:] = h, t
            np.bitwise_or(xv, more, out=pv)
            np.invert(pv, out=pv)
            pv |= less
            np.bitwise_and(more, xv, out=mv)
    return score.astype(np.int64)


def _whole(x: list[int], y: list[int]) -> int:
    """One distance, the pattern as one long number."""
    if x == y:
        return 0
    place: dict[int, int] = {}
    for p, v in enumerate(x):
        place[v] = place.get(v, 0) | 1 << p
    full, last = (1 << len(x)) - 1, len(x) - 1
    up, down, score = full, 0, len(x)
    for v in y:
        eq = place.get(v, 0)
        xv = eq | down
        h = (((eq & up) + up) ^ up) | eq
        more, less = down | full & ~(h | up), up & h
        score += (more >> last & 1) - (less >> last & 1)
        more, less = (more << 1 | 1) & full, less << 1 & full
        up, down = less | full & ~(xv | more), more & xv
    return score


# ---------------------------------------------------------------- blocks


def packed(spark: SparkSession, *sides: DataFrame) -> list[DataFrame]:
    """Blocks of each side's rows: kind, idx, name, f (struct of features); of the left ones also reach (confidence, similarity), or none."""
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def blocks(rows: DataFrame) -> DataFrame:
        total = rows.count()
        per = max(LEAST, min(PER, total // (2 * parts) + 1))
        n = max(1, -(-total // per))
        many = rows.groupBy("kind").agg(F.ceil(F.count("*") / per).alias("chunks"))
        chunk = F.pmod(F.xxhash64("idx"), F.col("chunks"))
        words = [F.transform(F.col("f")[c], lambda x: F.xxhash64(x)).alias(c) for c in WORDS]
        numbers = [F.col("f")[c].cast("double" if c == "size" else "bigint").alias(c) for c in NUMBERS]
        flat = rows.join(many, "kind").select(
            F.pmod(F.xxhash64("kind", chunk), F.lit(n)).alias("block"), "kind", "idx", "name", F.col("reach.confidence").alias("c"), F.col("reach.similarity").alias("s"),
            F.when(F.col("f.cfg_hash").isNotNull(), F.xxhash64("f.cfg_hash")).cast("string").alias("cfg"), F.col("f.sequence").alias("sequence"), *words, *numbers,
        )
        return flat.groupBy("block").applyInPandas(_pack, "packed binary")

    return all_stored(spark, "blocks", *[blocks(d) for d in sides])


def _pack(pdf: pd.DataFrame) -> pd.DataFrame:
    kind, first, of = np.unique(pdf["kind"].to_numpy(str), return_index=True, return_inverse=True)
    one = pdf.iloc[first]
    rows = {"idx": pdf["idx"].to_numpy(np.int64), "kind": of, "name": Texts(pdf["name"]), "c": pdf["c"].to_numpy(float), "s": pdf["s"].to_numpy(float)}
    kinds = {"cfg": one["cfg"].fillna("").to_numpy(str), "seq": Texts(one["sequence"])} | {c: one[c].to_numpy(float if c == "size" else np.int64) for c in NUMBERS}
    for c in WORDS:
        each = [np.unique(np.asarray(x, np.int64)) for x in one[c]]
        kinds[c] = np.repeat(np.arange(len(each)), [len(x) for x in each]), np.concatenate([*each, np.zeros(0, np.int64)]), np.array([len(x) for x in each])
    return pd.DataFrame({"packed": [pickle.dumps((kinds, rows), protocol=5)]})


def met(spark: SparkSession, left: DataFrame, right: DataFrame, compare, schema: str) -> DataFrame:
    """compare(left block, right block): a frame, for all pairs of blocks."""

    def dealt(d: DataFrame, name: str) -> DataFrame:
        n = d.count()
        return d.select(F.col("packed").alias(name)).repartition(max(1, min(n, int(spark.conf.get("spark.sql.shuffle.partitions"))), -(-n // MET)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for x, y in zip(pdf["a"], pdf["b"]):
                yield compare(pickle.loads(x), pickle.loads(y))

    return dealt(left, "a").crossJoin(dealt(right, "b").hint("shuffle_replicate_nl")).mapInPandas(run, schema)


# ---------------------------------------------------------------- scores


def _clamped(x: np.ndarray) -> np.ndarray:
    return np.maximum(0.0, np.minimum(1.0, x))


def _shared(x: tuple, y: tuple, shape: tuple[int, int]) -> np.ndarray:
    """How many words each left and each right class share."""
    common = np.intersect1d(x[1], y[1])
    out = np.zeros(shape, np.float64)
    if not len(common):
        return out

    def places(side: tuple) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(common, side[1]).clip(0, len(common) - 1)
        has = common[at] == side[1]
        order = np.argsort(at[has], kind="stable")
        return at[has][order], side[0][has][order]

    (wa, ka), (wb, kb) = places(x), places(y)
    step = max(1, CELLS // max(shape))
    for s in range(0, len(common), step):
        la, lb = (slice(*np.searchsorted(w, (s, s + step))) for w in (wa, wb))
        width = min(step, len(common) - s)
        counts = np.bincount(wa[la] - s, minlength=width), np.bincount(wb[lb] - s, minlength=width)
        if counts[0] @ counts[1] * 100 < shape[0] * shape[1] * width:
            # Few meet: each left place meets the right ones of its word.
            n = counts[1][wa[la] - s]
            begin = (np.cumsum(counts[1]) - counts[1])[wa[la] - s]
            right = kb[lb][np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            out += np.bincount(np.repeat(ka[la], n) * shape[1] + right, minlength=shape[0] * shape[1]).reshape(shape)
            continue
        ma, mb = np.zeros((shape[0], width), np.float32), np.zeros((shape[1], width), np.float32)
        ma[ka[la], wa[la] - s] = 1
        mb[kb[lb], wb[lb] - s] = 1
        out += ma @ mb.T
    return out


def _ratio(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    x, y = x.astype(float)[:, None], y.astype(float)[None, :]
    return np.where((x == 0) & (y == 0), 1.0, np.where((x == 0) | (y == 0), 0.0, 1.0 - np.abs(x - y) / np.maximum(1, np.maximum(x, y))))


def _letters(t: Texts) -> np.ndarray:
    """Counts of each text's points, taken modulo 64."""
    return np.bincount(np.repeat(np.arange(len(t.size)), t.size) * 64 + t.points % 64, minlength=64 * len(t.size)).reshape(-1, 64)


class Scores:
    """Parts of the scores of all classes of two blocks. Sequences are compared when asked for."""

    def __init__(self, a: dict, b: dict):
        self.a, self.b = a, b
        self.shape = shape = len(a["n_bb"]), len(b["n_bb"])
        shared = {c: _shared(a[c], b[c], shape) for c in WORDS}

        def jaccard(c: str) -> np.ndarray:
            union = a[c][2][:, None] + b[c][2][None, :] - shared[c]
            return np.where(union == 0, 1.0, shared[c] / np.maximum(1, union))

        def share(c: str, n: str) -> np.ndarray:
            x, y = a[n][:, None], b[n][None, :]
            return np.where((x == 0) & (y == 0), 1.0, np.where((x == 0) | (y == 0), 0.0, shared[c] / np.maximum(1, np.maximum(x, y))))

        edges = _ratio(a["edges_cfg"], b["edges_cfg"])
        flow = np.where((a["n_bb"][:, None] == 0) & (b["n_bb"][None, :] == 0), 1.0, 0.6 * _ratio(a["n_bb"], b["n_bb"]) + 0.4 * edges)
        call = jaccard("calls")
        same = (a["cfg"][:, None] == b["cfg"][None, :]) & (a["cfg"] != "")[:, None]
        part = {"cfg": np.where(same, 1.0, flow), "call": call, "bb": share("bb_tags", "n_bb"), "instruction": share("mnemonic_tags", "n_instr"), "edge": _ratio(a["edges_total"], b["edges_total"])}
        keys = [k for k, _ in K.MATCH_WEIGHTS]
        terms = {k: _clamped(part[k]) * w for k, w in K.MATCH_WEIGHTS if k != "name"}
        self.u = sum((terms[k] for k in keys[1 : keys.index("name")]), terms[keys[0]])
        after = keys[keys.index("name") + 1 :]
        self.v = sum((terms[k] for k in after[1:]), terms[after[0]])
        self.parts = {"cf": flow, "call": call, "const": jaccard("constants"), "string": jaccard("strings")}
        largest = np.maximum(a["size"][:, None], b["size"][None, :])
        near = (largest > 0) & (np.abs(a["size"][:, None] - b["size"][None, :]) / np.where(largest > 0, largest, 1.0) < 0.1)
        self.grounds = [a["n_bb"][:, None] == b["n_bb"][None, :], np.abs(a["complexity"][:, None] - b["complexity"][None, :]) < 2, near]
        # An edit changes a letter: the distance is no less than the letters that are not shared.
        x, y = _letters(a["seq"]), _letters(b["seq"])
        alike = np.zeros(shape, np.int64)
        for k in np.flatnonzero(x.any(0) & y.any(0)):
            alike += np.minimum(x[:, k][:, None], y[:, k][None, :])
        longest = np.maximum(a["seq"].size[:, None], b["seq"].size[None, :])
        self.at_most = self._full(slice(None), self._of_sequence(np.s_[:, :], longest - alike, longest)) + _ROOM
        self.full = np.full(shape, np.nan)

    def _of_sequence(self, at, distance: np.ndarray, longest: np.ndarray) -> np.ndarray:
        none_a, none_b = np.broadcast_to((self.a["n_instr"] == 0)[:, None], self.shape)[at], np.broadcast_to((self.b["n_instr"] == 0)[None, :], self.shape)[at]
        like = np.where(longest == 0, 1.0, 1.0 - distance.astype(float) / np.maximum(1, longest))
        return np.where(none_a & none_b, 1.0, np.where(none_a | none_b, 0.0, like))

    def _full(self, at, sequence: np.ndarray) -> np.ndarray:
        part = {k: p[at] for k, p in self.parts.items()} | {"seq": sequence}
        (k0, w0), *rest = K.COMPREHENSIVE_WEIGHTS
        total, weights = part[k0] * w0, w0
        for k, w in rest:
            total, weights = total + part[k] * w, weights + w
        return total / weights

    def compare(self, i: np.ndarray, j: np.ndarray) -> None:
        """From now on `full` has these pairs of classes."""
        i, j = np.divmod(np.unique(i * self.shape[1] + j), self.shape[1])
        new = np.isnan(self.full[i, j])
        i, j = i[new], j[new]
        if len(i):
            distance = distances(self.a["seq"], self.b["seq"], i, j)
            self.full[i, j] = self._full((i, j), self._of_sequence((i, j), distance, np.maximum(self.a["seq"].size[i], self.b["seq"].size[j])))

    def named(self, i, j, name, full: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Confidence and similarity of pairs of classes for a similarity of names."""
        match = _clamped(self.u[i, j] + name * dict(K.MATCH_WEIGHTS)["name"] + self.v[i, j])
        s = _clamped(K.BLEND_MATCH * match + K.BLEND_COMPREHENSIVE * full[i, j])
        c = s
        for g in self.grounds:
            c = c + np.where(g[i, j], 0.1, 0.0)
        return _clamped(c), s


def _names(a: dict, b: dict, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    longest = np.maximum(a["name"].size[i], b["name"].size[j])
    return _clamped(np.where(longest == 0, 1.0, 1.0 - distances(a["name"], b["name"], i, j).astype(float) / np.maximum(1, longest)))


def all_pairs(similarity: float, confidence: float):
    """Every pair of rows that passes both thresholds."""

    def compare(left: tuple, right: tuple) -> pd.DataFrame:
        (ka, a), (kb, b) = left, right
        scores = Scores(ka, kb)
        for full in (scores.at_most, scores.full):
            every = np.s_[:], np.s_[:]
            c, s = scores.named(*every, 1.0, full)
            open_ = (c >= confidence - _ROOM) & (s >= similarity - _ROOM)  # nan: not compared, as its bound fails
            if full is scores.at_most:
                scores.compare(*np.nonzero(open_))
        i, j = np.nonzero(open_[a["kind"]][:, b["kind"]])
        c, s = scores.named(a["kind"][i], b["kind"][j], _names(a, b, i, j), scores.full)
        good = (c >= confidence) & (s >= similarity)
        return pd.DataFrame({"idx_a": a["idx"][i[good]], "idx_b": b["idx"][j[good]], "similarity": s[good], "confidence": c[good]})

    return compare


def best_pairs(similarity: float, confidence: float):
    """Each left row's best right row of the block, the lowest idx on ties, if it passes and may do as well as the row's reach.

    Pairs are looked at in the order of their bounds; a row is done when no bound reaches its best."""

    def compare(left: tuple, right: tuple) -> pd.DataFrame:
        (ka, a), (kb, b) = left, right
        scores = Scores(ka, kb)
        n = len(a["idx"])
        best_c, best_s, found = np.where(np.isnan(a["c"]), -1.0, a["c"]), np.where(np.isnan(a["s"]), -1.0, a["s"]), np.full(n, -1, np.int64)

        def open_(i: np.ndarray, c: np.ndarray, s: np.ndarray) -> np.ndarray:
            better = (c > best_c[i] + _ROOM) | ((c >= best_c[i] - _ROOM) & (s >= best_s[i] - _ROOM))
            return better & (c >= confidence - _ROOM) & (s >= similarity - _ROOM)

        c, s = scores.named(np.s_[:], np.s_[:], 1.0, scores.at_most)
        i = np.arange(n)[:, None]
        row, kind = np.nonzero(open_(i, c[a["kind"]], s[a["kind"]]))
        # Right rows of these classes.
        order = np.argsort(b["kind"], kind="stable")
        many = np.bincount(b["kind"], minlength=len(kb["n_bb"]))
        size = many[kind]
        i = np.repeat(row, size)
        j = order[np.repeat((np.cumsum(many) - many)[kind] - (np.cumsum(size) - size), size) + np.arange(size.sum())]
        name = _names(a, b, i, j)
        c, s = scores.named(a["kind"][i], b["kind"][j], name, scores.at_most)
        take = 2
        while True:
            keep = open_(i, c, s)
            i, j, name, c, s = i[keep], j[keep], name[keep], c[keep], s[keep]
            if not len(i):
                break
            if take == 2:
                rank = np.lexsort((-s, -c, i))
                i, j, name, c, s = i[rank], j[rank], name[rank], c[rank], s[rank]
            first = np.flatnonzero(np.concatenate([[True], np.diff(i) != 0]))
            now = np.arange(len(i)) - np.repeat(first, np.diff(np.append(first, len(i)))) < take
            x, y = i[now], j[now]
            scores.compare(a["kind"][x], b["kind"][y])
            cx, sx = scores.named(a["kind"][x], b["kind"][y], name[now], scores.full)
            good = (cx >= confidence) & (sx >= similarity)
            x, y, cx, sx = x[good], b["idx"][y[good]], cx[good], sx[good]
            rank = np.lexsort((y, -sx, -cx, x))
            rank = rank[np.concatenate([[True], np.diff(x[rank]) != 0])[: len(rank)]]
            x, y, cx, sx = x[rank], y[rank], cx[rank], sx[rank]
            # The reach is of another row, maybe of another block: what only equals it counts as found.
            new = found[x] < 0
            more = (cx > best_c[x]) | ((cx == best_c[x]) & ((sx > best_s[x]) | ((sx == best_s[x]) & (y < found[x])))) | new & (cx >= best_c[x] - _ROOM) & ((cx > best_c[x] + _ROOM) | (sx >= best_s[x] - _ROOM))
            x, y, cx, sx = x[more], y[more], cx[more], sx[more]
            best_c[x], best_s[x], found[x] = cx, sx, y
            i, j, name, c, s = i[~now], j[~now], name[~now], c[~now], s[~now]
            take *= 4
        has = found >= 0
        return pd.DataFrame({"idx_a": a["idx"][has], "idx_b": found[has], "similarity": best_s[has], "confidence": best_c[has]})

    return compare
