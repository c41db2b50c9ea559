"""Rows that score alike, and greedy assignment over them.

Functions of equal features differ in a score only by their names, so scores are computed once for each pair of
classes, without the name's part, and never for all pairs of rows. A bucket is then assigned in the serial order: the
rows of a class that share a name wait in order of idx, and a left row looks at the first of each such queue.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What the score of a match reads, besides names.
MATCH_FEATURES = ("cfg_hash", "calls", "bb_tags", "mnemonic_tags", "n_bb", "n_instr", "edges_cfg", "edges_total", "size", "complexity")
#: Features that are only compared with the other side's.
HASHES = {"cfg_hash", "structural_hash"}
#: Buckets of more pairs go by classes.
CROWDED = 10_000
#: Pairs of classes that one task may hold; a bucket of more goes by pairs of rows.
HELD = 2_000_000
#: Entries of queues that are kept for left rows alike; beyond it they are looked up anew.
KEPT = 20_000_000
_DONE = np.iinfo(np.int64).max

#: Input of `assign`: left rows (side 0: idx, class, name), right rows (side 1, the same), pairs of classes (side 2:
#: left class, right class) with two parts of the score and flags. `zero`: a right row that is never used up.
COLUMNS = ("key", "side", "x", "y", "name", "u", "v", "flags", "zero")


def alike(a: DataFrame, b: DataFrame, features: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """Both sides with `kind`, equal for rows of equal features; a hash that only one side has counts as none."""

    def with_kind(d: DataFrame, other: DataFrame) -> DataFrame:
        for c in HASHES & set(features):
            both = other.select(c).distinct().withColumn("_both", F.lit(True))
            d = d.join(both, c, "left").withColumn(c, F.when(F.col("_both"), F.col(c))).drop("_both")
        lists = {f.name for f in d.schema if f.dataType.typeName() == "array"}
        return d.withColumn("kind", F.md5(F.to_json(F.struct(*[F.array_sort(c).alias(c) if c in lists else F.col(c) for c in features]))))

    return with_kind(a, b), with_kind(b, a)


def crowded(a: DataFrame, b: DataFrame) -> DataFrame:
    """Keys (of rows with key and kind) whose pairs are many and whose pairs of classes can be held."""
    n = lambda d, s: d.groupBy("key").agg(F.count("*").cast("double").alias(f"n_{s}"), F.count_distinct("kind").cast("double").alias(f"k_{s}"))
    both = n(a, "a").join(n(b, "b"), "key")
    return both.where((F.col("n_a") * F.col("n_b") > CROWDED) & (F.col("k_a") * F.col("k_b") <= HELD)).select("key")


def choose(a: DataFrame, b: DataFrame, features: tuple[str, ...], parts: Callable[[DataFrame], DataFrame], assign: Callable) -> DataFrame:
    """a, b: key, idx, name, zero, kind and features. parts: adds u, v, flags to pairs of classes (structs a and b),
    leaving out those that no name makes pass. Returns the chosen (idx_a, idx_b)."""
    rows, kinds = [], []
    for d in (a, b):
        k = d.groupBy("key", "kind").agg(F.min("idx").alias("class"), F.first(F.struct(*features)).alias("f"))
        kinds.append(k)
        rows.append(d.select("key", "kind", "idx", "name", "zero").join(k.select("key", "kind", "class"), ["key", "kind"]))
    pairs = parts(kinds[0].select("key", F.col("class").alias("x"), F.col("f").alias("a")).join(kinds[1].select("key", F.col("class").alias("y"), F.col("f").alias("b")), "key"))
    none = F.lit(None)
    whole = pairs.select("key", F.lit(2).alias("side"), "x", "y", none.cast("string").alias("name"), "u", "v", "flags", F.lit(False).alias("zero"))
    for side, r in enumerate(rows):
        whole = whole.unionByName(r.select("key", F.lit(side).alias("side"), F.col("idx").alias("x"), F.col("class").alias("y"), "name", none.cast("double").alias("u"), none.cast("double").alias("v"), none.cast("int").alias("flags"), "zero"))
    return whole.select(*COLUMNS).groupBy("key").applyInPandas(assign, "idx_a long, idx_b long")


# ---------------------------------------------------------------- names


def _points(name: str) -> list[int]:
    """Characters, and one sentinel for each byte beyond them."""
    return [ord(c) for c in name] + [0xFFFF] * (len(name.encode()) - len(name))


class Edits:
    """Edit similarity of a name to each of some; another than itself has `below` at most.

    Names of up to 64 points are compared by bits, a column of the table of distances at once (Myers, Hyyro).
    """

    def __init__(self, names: list[str]):
        points = [_points(n) for n in names]
        self.size = np.array([len(p) for p in points], np.int32)
        self.width = int(self.size.max())
        self.at = np.full((self.width, len(names)), -1, np.int32)
        for i, p in enumerate(points):
            self.at[: len(p), i] = p
        self.word = next((w for w in (np.uint16, np.uint32, np.uint64) if self.width <= 8 * w().nbytes), None)
        self.places: dict[int, np.ndarray] = {}

    def below(self, name: str) -> float:
        return 1.0 - 1.0 / max(self.width, len(name.encode()), 1)

    def same(self, name: str) -> float:
        return 1.0

    def to(self, name: str) -> np.ndarray:
        points = _points(name)
        longest = np.maximum(self.size, len(points))
        return np.where(longest == 0, 1.0, 1.0 - (self._by_rows(points) if self.word is None else self._by_bits(points)).astype(np.float64) / np.maximum(longest, 1))

    def _by_rows(self, points: list[int]) -> np.ndarray:
        steps = np.arange(self.width + 1, dtype=np.int32)[:, None]
        row = np.repeat(steps, len(self.size), axis=1)
        for i, p in enumerate(points, 1):
            new = row + 1
            np.minimum(new[1:], row[:-1] + (self.at != p), out=new[1:])
            new[0] = i
            row = np.minimum.accumulate(new - steps, axis=0) + steps
        return row[self.size, np.arange(len(self.size))]

    def _where(self, point: int) -> np.ndarray:
        """Bit j of each name: whether its j-th point is this one."""
        if point not in self.places:
            if (len(self.places) + 1) * len(self.size) > KEPT:
                self.places.clear()
            bits = np.zeros(len(self.size), self.word)
            for j, row in enumerate(self.at):
                bits |= (row == point).astype(self.word) << self.word(j)
            self.places[point] = bits
        return self.places[point]

    def _by_bits(self, points: list[int]) -> np.ndarray:
        one = self.word(1)
        last = (self.size - 1).clip(0).astype(self.word)
        up, down = np.full(len(self.size), ~self.word(0)), np.zeros(len(self.size), self.word)
        out = self.size.copy()
        for p in points:
            same = self._where(p) | down
            level = (((same & up) + up) ^ up) | same
            less, more = up & level, down | ~(up | level)
            out += (more >> last & one).astype(np.int32)
            out -= (less >> last & one).astype(np.int32)
            more = more << one | one
            down, up = more & level, less << one | ~(more | level)
        return np.where(self.size == 0, len(points), out)


class Sameness:
    """1 for the same name, else 0; 2 for two names that are both only addresses."""

    def __init__(self, names: list[str]):
        self.names, self.bare = np.array(names, object), np.array([n.startswith("0x") for n in names])

    def below(self, name: str) -> float:
        return 2.0

    def same(self, name: str) -> float:
        return 2.0 if name.startswith("0x") else 1.0

    def to(self, name: str) -> np.ndarray:
        return np.where(self.bare, 2.0, self.names == name) if name.startswith("0x") else (self.names == name).astype(np.float64)


def _clamped(x: np.ndarray) -> np.ndarray:
    return np.maximum(0.0, np.minimum(1.0, x))


def match_scores(similarity: float, confidence: float):
    """confidence, similarity and whether both pass, from u (parts before the name), v (after it) and flags."""

    def score(u, v, flags, name):
        s = _clamped(u + name * 0.1 + v)
        c = s
        for bit in (1, 2, 4):
            c = c + np.where(flags & bit, 0.1, 0.0)
        c = _clamped(c)
        return c, s, (c >= confidence) & (s >= similarity)

    return score


# ---------------------------------------------------------------- the serial order


def assigner(score: Callable, names: type) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """The function for a bucket's rows of COLUMNS. score(u, v, flags, likeness of names): two ranks and a mask."""

    def assign(pdf: pd.DataFrame) -> pd.DataFrame:
        a, b, p = (pdf[pdf["side"] == s] for s in range(3))
        if not (len(a) and len(b) and len(p)):
            return pd.DataFrame({"idx_a": np.zeros(0, np.int64), "idx_b": np.zeros(0, np.int64)})
        return pd.DataFrame(_serial(a.sort_values("x"), b, p, score, names), columns=["idx_a", "idx_b"]).astype("int64")

    return assign


def _serial(a: pd.DataFrame, b: pd.DataFrame, p: pd.DataFrame, score: Callable, names: type) -> Iterator[tuple[int, int]]:
    ka, left_class = np.unique(a["y"].to_numpy(np.int64), return_inverse=True)
    kb, right_class = np.unique(b["y"].to_numpy(np.int64), return_inverse=True)
    shape = (len(ka), len(kb))
    u, v, flags = np.full(shape, np.nan), np.full(shape, np.nan), np.zeros(shape, np.int8)
    at = np.searchsorted(ka, p["x"].to_numpy(np.int64)), np.searchsorted(kb, p["y"].to_numpy(np.int64))
    u[at], v[at], flags[at] = p["u"].to_numpy(float), p["v"].to_numpy(float), p["flags"].to_numpy(np.int8)
    # Queues: right rows of one class, name and mark, in order of idx.
    codes, right_names = pd.factorize(b["name"])
    right_names = list(right_names)
    idx, zero = b["x"].to_numpy(np.int64), b["zero"].to_numpy(bool)
    order = np.lexsort((idx, zero, codes, right_class))
    idx, zero, codes, right_class = idx[order], zero[order], codes[order], right_class[order]
    changed = (np.diff(right_class) != 0) | (np.diff(codes) != 0) | (np.diff(zero.astype(int)) != 0)
    start = np.flatnonzero(np.concatenate([[True], changed]))
    end = np.append(start[1:], len(idx))
    q_class, q_name, q_zero, head = right_class[start], codes[start], zero[start], idx[start]
    place = start.copy()
    waiting = np.bincount(q_class, minlength=len(kb))  # queues of a class that are not empty
    of_name: dict[int, np.ndarray] = dict(enumerate(np.split(np.argsort(q_name, kind="stable"), np.cumsum(np.bincount(q_name, minlength=len(right_names)))[:-1])))
    code_of = {n: i for i, n in enumerate(right_names)}
    like = names(right_names)
    left_codes, left_names = pd.factorize(a["name"])
    often = np.bincount(left_codes)
    _, group, size = np.unique(np.stack([left_class, left_codes]), axis=1, return_inverse=True, return_counts=True)
    group = group.ravel()
    left = size.copy()  # rows of a group that are still to come
    likeness: dict[int, np.ndarray] = {}
    best_of: dict[int, np.ndarray] = {}
    kept, hopeless = 0, np.zeros(len(size), bool)
    live = np.arange(len(start))

    def best(queues, c, t):
        one, two, good = score(u[c, q_class[queues]], v[c, q_class[queues]], flags[c, q_class[queues]], t)
        good &= ~np.isnan(one)
        if not good.any():
            return None, queues[:0]
        queues, one, two = queues[good], one[good], two[good]
        top = one == one.max()
        queues, two = queues[top], two[top]
        return (one[top][0], two.max()), queues[two == two.max()]

    for i, g, c, n in zip(a["x"].tolist(), group.tolist(), left_class.tolist(), left_codes.tolist()):
        left[g] -= 1
        if hopeless[g]:
            continue
        top = best_of.get(g)
        if top is not None:
            top = top[head[top] != _DONE]
        if top is None or not len(top):
            name, top = left_names[n], None
            own = of_name.get(code_of.get(name, -1))
            own = own[head[own] != _DONE] if own is not None else ()
            if len(own):
                reach, top = best(own, c, np.full(len(own), like.same(name)))
                if reach:
                    k = np.flatnonzero(waiting)
                    one, two, good = score(u[c, k], v[c, k], flags[c, k], np.full(len(k), like.below(name)))
                    if (good & ((one > reach[0]) | ((one == reach[0]) & (two >= reach[1])))).any():
                        top = None  # another name may do as well
                else:
                    top = None
            if top is None:
                gone = head[live] == _DONE
                if gone.sum() * 4 > len(live):
                    live = live[~gone]
                    gone = head[live] == _DONE
                queues = live[~gone] if gone.any() else live
                t = likeness.get(n)
                if t is None:
                    t = like.to(name)
                    if often[n] > 1 and len(likeness) * len(t) < KEPT:
                        likeness[n] = t
                _, top = best(queues, c, t[q_name[queues]])
            if not len(top):
                hopeless[g] = True
                continue
        if left[g]:
            kept += len(top) - len(best_of.get(g, ()))
            if kept > KEPT:
                best_of.clear()
                kept = len(top)
            best_of[g] = top.astype(np.int32)
        else:
            kept -= len(best_of.pop(g, ()))
        q = top[np.argmin(head[top])]
        if q_zero[q]:
            continue
        yield i, int(head[q])
        place[q] += 1
        if place[q] < end[q]:
            head[q] = idx[place[q]]
        else:
            head[q] = _DONE
            waiting[q_class[q]] -= 1
