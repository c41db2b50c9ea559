"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests.

A text's paragraphs are its lines, long ones cut every PIECE_WORDS words; each is hashed (A-Z lower-cased, white
space ignored), with its occurrence number, so repeated paragraphs count. A sketch has cells (count, xor of keys, xor
of key checks); every key sits in three cells. Two sketches subtract cell by cell and what is left peels: a cell that
holds one key gives it away, it is removed from its other cells, and so on, until the differing digests are known.

A fingerprint is a sketch of 3 x 2^k cells, about 1.5 a paragraph: the least of these sizes at which it peels by
itself, so it gives all of its digests back. Cells are the leading bits of hashes, so a sketch folds to half its size
by adding neighbours. Two fingerprints are compared at the least size first; if peeling gets stuck, again four times
larger, as far as both go; beyond that by the digests that each of them gives back. So the likeness of two
fingerprints is a function of the two strings (`compare`), and exact: (a + b - d) / (a + b + d) for a and b
paragraphs of which d differ, their Jaccard index.

Defined cases: a null text counts as empty; two texts without paragraphs are alike (1); equal texts have equal
fingerprints; null or repeated document ids are ordered by (id, text), nulls first, and each row has its own
successor; the last document's successor is the first; a single document follows itself; texts of any length are
sketched whole, the fingerprint grows with them; an empty table gives no rows; further columns are ignored, whatever
their names.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, mix, range_numbers, text_buffer, text_slices, word_hashes

PIECE_WORDS = 16
#: Cells of the least sketch, three times a power of two; a retry has four times as many.
CELLS = 12
GROW = 4
#: Cells that are peeled at once: what a worker holds for it stays below some 30 MB.
PEEL_CELLS = 1 << 18
_SALTS = [np.uint64(x) for x in (0x9AE16A3B2F90404F, 0xC949D7C7509E6557, 0xFF51AFD7ED558CCD)]
_CHECK = np.uint64(0xC4CEB9FE1A85EC53)


def paragraph_keys(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 64-bit keys of all texts' paragraphs, row after row, and each row's first key."""
    data, off = text_buffer(arr)
    h, at, starts, _ = word_hashes(data, off, with_starts=True)
    if not len(h):
        return h, np.zeros(len(arr) + 1, np.int64)
    lines = np.cumsum(data == 10)[starts]
    new = np.ones(len(h), bool)
    new[1:] = lines[1:] != lines[:-1]
    new[at[:-1][at[:-1] < len(h)]] = True
    idx = np.arange(len(h))
    begin = np.maximum.accumulate(np.where(new, idx, 0))
    cut = np.flatnonzero((idx - begin) % PIECE_WORDS == 0)
    pos = ((idx - begin) % PIECE_WORDS + 1).astype(np.uint64)
    keys = mix(np.add.reduceat(mix(h + pos * _SALTS[0]), cut))
    row = np.searchsorted(at, cut, "right") - 1
    # The n-th occurrence of a paragraph in a text has a key of its own.
    order = np.lexsort((keys, row))
    k, r = keys[order], row[order]
    same = np.zeros(len(k), bool)
    same[1:] = (k[1:] == k[:-1]) & (r[1:] == r[:-1])
    n = np.arange(len(k))
    nth = n - np.maximum.accumulate(np.where(same, 0, n))
    return np.where(nth > 0, mix(k + nth.astype(np.uint64) * _SALTS[1]), k), np.searchsorted(r, np.arange(len(arr) + 1))


def _cells(keys: np.ndarray, m: int) -> np.ndarray:
    third = m // 3
    shift = np.uint64(65 - third.bit_length())
    return np.stack([(mix(keys ^ s) >> shift).astype(np.int64) + j * third for j, s in enumerate(_SALTS)])


def _check(keys: np.ndarray) -> np.ndarray:
    return (mix(keys ^ _CHECK) >> np.uint64(32)).astype(np.uint32)


def sketch(keys: np.ndarray, at: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(counts, key xors, check xors), each of shape (rows, m)."""
    rows = len(at) - 1
    row = np.repeat(np.arange(rows), np.diff(at))
    count, ksum, csum = np.zeros(rows * m, np.int32), np.zeros(rows * m, np.uint64), np.zeros(rows * m, np.uint32)
    check = _check(keys)
    for cell in _cells(keys, m):
        flat = row * m + cell
        np.add.at(count, flat, 1)
        np.bitwise_xor.at(ksum, flat, keys)
        np.bitwise_xor.at(csum, flat, check)
    return count.reshape(rows, m), ksum.reshape(rows, m), csum.reshape(rows, m)


def subtract(a, b):
    return a[0] - b[0], a[1] ^ b[1], a[2] ^ b[2]


def peel(diff) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per row: whether all was recovered. Per recovered digest: row, key, sign (1: only in the first)."""
    count, ksum, csum = (x.copy() for x in diff)
    rows, m = count.shape
    found_row, found_key, found_sign = [], [], []
    live = np.arange(rows)
    while len(live):
        pure = (np.abs(count[live]) == 1) & (csum[live] == _check(ksum[live]))
        r, c = np.nonzero(pure)
        if not len(r):
            break
        r = live[r]
        keys, sign = ksum[r, c], count[r, c]
        first = np.unique(np.stack([r.astype(np.uint64), keys]), axis=1, return_index=True)[1]
        r, keys, sign = r[first], keys[first], sign[first]
        check = _check(keys)
        for cell in _cells(keys, m):
            np.subtract.at(count, (r, cell), sign)
            np.bitwise_xor.at(ksum, (r, cell), keys)
            np.bitwise_xor.at(csum, (r, cell), check)
        found_row.append(r)
        found_key.append(keys)
        found_sign.append(sign)
        live = np.unique(r)
    done = ~(count.any(1) | ksum.any(1) | csum.any(1))
    cat = lambda xs, t: np.concatenate(xs) if xs else np.zeros(0, t)
    return done, cat(found_row, np.int64), cat(found_key, np.uint64), cat(found_sign, np.int32)


def _take(keys: np.ndarray, at: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    n = np.diff(at)[rows]
    ends = np.cumsum(n)
    idx = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(at[rows] - (ends - n), n)
    return keys[idx], np.concatenate([[0], ends]).astype(np.int64)


def fold_to(sk, m: int):
    """Sketches (rows, cells) at a smaller size."""
    count, ksum, csum = sk
    rows, size = count.shape
    if size == m:
        return sk
    by = (rows, m, size // m)
    return count.reshape(by).sum(2, dtype=np.int32), np.bitwise_xor.reduce(ksum.reshape(by), 2), np.bitwise_xor.reduce(csum.reshape(by), 2)


class Prints:
    """The fingerprints of some texts: sketches by size, and the digests that they give back."""

    def __init__(self, keys: np.ndarray, at: np.ndarray):
        self.keys, self.at, self.n = keys, at, np.diff(at)
        want = np.maximum(-(-3 * self.n // (2 * CELLS)), 1)
        self.size = CELLS << np.ceil(np.log2(want)).astype(np.int64)
        self.by: dict[int, tuple[np.ndarray, tuple]] = {}
        self.place = np.zeros(len(self.n), np.int64)
        todo = np.arange(len(self.n))
        while len(todo):
            m = int(self.size[todo].min())
            rows = todo[self.size[todo] == m]
            step, parts, stuck = max(1, PEEL_CELLS // m), [], []
            for s in range(0, len(rows), step):
                part = rows[s : s + step]
                sk = sketch(*_take(keys, at, part), m)
                done = peel(sk)[0]
                parts.append(tuple(x[done] for x in sk))
                stuck.append(part[~done])
            stuck = np.concatenate(stuck)
            kept = np.setdiff1d(rows, stuck)
            self.place[kept] = np.arange(len(kept))
            self.by[m] = (kept, tuple(np.concatenate(c) for c in zip(*parts)))
            self.size[stuck] = 2 * m  # it does not peel by itself: twice as large
            todo = np.setdiff1d(todo, kept)

    def at_size(self, rows: np.ndarray, m: int):
        """Sketches of some rows, folded to m cells."""
        out = [np.zeros((len(rows), m), t) for t in (np.int32, np.uint64, np.uint32)]
        for size in np.unique(self.size[rows]).tolist():
            i = np.flatnonzero(self.size[rows] == size)
            for o, x in zip(out, fold_to(tuple(c[self.place[rows[i]]] for c in self.by[size][1]), m)):
                o[i] = x
        return tuple(out)

    def written(self, row: int) -> str:
        """A fingerprint as text: the power of its size, bytes of a count, and its cells, base64."""
        count, ksum, csum = (c[self.place[row]] for c in self.by[int(self.size[row])][1])
        width = next(w for w in (1, 2, 4) if int(count.max()) < 1 << 8 * w)
        head = bytes([(int(self.size[row]) // CELLS).bit_length() - 1, width])
        return base64.b64encode(head + count.astype(f"<u{width}").tobytes() + ksum.astype("<u8").tobytes() + csum.astype("<u4").tobytes()).decode()


def differing(a: Prints, rows_a: np.ndarray, b: Prints, rows_b: np.ndarray) -> np.ndarray:
    """How many digests differ, pair by pair of fingerprints: by sketches of growing size, then by what they give back."""
    out = np.full(len(rows_a), -1, np.int64)
    both = np.minimum(a.size[rows_a], b.size[rows_b])
    apart = np.abs(a.n[rows_a] - b.n[rows_b])
    todo, m = np.arange(len(rows_a)), CELLS
    while len(todo):
        last = both[todo] < m
        rest, todo = todo[last], todo[~last]
        if len(rest):
            (x, x_at), (y, y_at) = _take(a.keys, a.at, rows_a[rest]), _take(b.keys, b.at, rows_b[rest])
            row = np.concatenate([np.repeat(np.arange(len(rest)), np.diff(t)) for t in (x_at, y_at)])
            key = np.concatenate([x, y])
            order = np.lexsort((key, row))
            row, key = row[order], key[order]
            same = np.bincount(row[1:][(key[1:] == key[:-1]) & (row[1:] == row[:-1])], minlength=len(rest))
            out[rest] = a.n[rows_a[rest]] + b.n[rows_b[rest]] - 2 * same
        fits = apart[todo] <= m  # a sketch of m cells can't give back more than m digests
        rows, failed = todo[fits], [todo[~fits]]
        step = max(1, PEEL_CELLS // m)
        for s in range(0, len(rows), step):
            part = rows[s : s + step]
            done, r, _, _ = peel(subtract(a.at_size(rows_a[part], m), b.at_size(rows_b[part], m)))
            out[part[done]] = np.bincount(r, minlength=len(part))[done]
            failed.append(part[~done])
        todo, m = np.sort(np.concatenate(failed)), m * GROW
    return out


def likeness(n_a, n_b, d) -> np.ndarray:
    both = n_a + n_b
    return np.where(both == 0, 1.0, (both - d) / np.maximum(both + d, 1))


def read(fingerprint: str):
    """The sketch of a fingerprint: (counts, key xors, check xors), one row each."""
    raw = base64.b64decode(fingerprint)
    m, width = CELLS << raw[0], raw[1]
    return np.frombuffer(raw, f"<u{width}", m, 2)[None].astype(np.int32), np.frombuffer(raw, "<u8", m, 2 + width * m)[None], np.frombuffer(raw, "<u4", m, 2 + (width + 8) * m)[None]


def digests(fingerprint: str) -> np.ndarray:
    """All paragraph digests, given back by peeling."""
    done, _, keys, _ = peel(read(fingerprint))
    if not done[0]:
        raise ValueError("a fingerprint that does not peel is damaged")
    return np.sort(keys)


def compare(a: str, b: str) -> float:
    """The likeness of two fingerprints, from the two strings alone."""
    x, y = digests(a), digests(b)
    at = lambda k: np.array([0, len(k)])
    p, q = Prints(x, at(x)), Prints(y, at(y))
    return float(likeness(len(x), len(y), differing(p, np.zeros(1, np.int64), q, np.zeros(1, np.int64))[0]))


# ---------------------------------------------------------------- neighbours


def edited(text: str, following: str) -> str:
    """The last floor(n / 2) code points replaced by as many of the next text, or all it has."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def successors(spark: SparkSession, df: DataFrame, id_col: str, text_col: str, handle, schema: str) -> DataFrame:
    """mapInArrow over documents in ascending id order; `handle(batches)` sees (id, text, ahead).

    Documents are dealt into id ranges (quantiles of the ids), one per reducer, in one shuffle. The first document of
    each range is sent to the range before it as well, marked `ahead`, and so arrives there last: every document meets
    its successor without a second pass. Only range bounds reach the driver.
    """
    bound_batches(spark)
    d = df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    d, n = range_numbers(d, "id", int(spark.conf.get("spark.sql.shuffle.partitions")))
    d = d.withColumnRenamed("to", "bucket")
    firsts = {r["bucket"]: None if r["nulls"] else r["first"] for r in d.groupBy("bucket").agg(F.min("id").alias("first"), F.count_if(F.col("id").isNull()).alias("nulls")).collect()}
    used = sorted(firsts)
    if not used:
        return spark.createDataFrame([], schema)
    before = F.create_map(*[x for i, b in enumerate(used) for x in (F.lit(b), F.lit(used[i - 1]))])
    first = F.create_map(*[x for b in used for x in (F.lit(b), F.lit(firsts[b]).cast("bigint"))])
    here = F.struct(F.col("bucket").alias("to"), F.lit(False).alias("ahead"))
    there = F.struct(before[F.col("bucket")].alias("to"), F.lit(True).alias("ahead"))
    sent = d.withColumn("go", F.explode(F.when(F.col("id").eqNullSafe(first[F.col("bucket")]), F.array(here, there)).otherwise(F.array(here))))
    dealt = sent.select("id", "text", "go.ahead", "go.to").repartitionById(n, F.col("to")).sortWithinPartitions("ahead", F.asc_nulls_first("id"), "text")
    return dealt.select("id", "text", "ahead").mapInArrow(handle, schema)


SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _pairs(batches) -> Iterator[tuple[list, list]]:
    """Slices of (ids, texts) with one text more than ids: the successor of the last."""
    ids, texts = [], []
    for b in batches:
        for s in text_slices(b, 1):
            for i, t, ahead in zip(s.column(0).to_pylist(), s.column(1).to_pylist(), s.column(2).to_pylist()):
                if ahead:
                    if len(texts) == len(ids):
                        texts.append(t)
                else:
                    ids.append(i)
                    texts.append(t)
            if len(ids) > 1 and len(texts) == len(ids):
                yield ids[:-1], texts
                ids, texts = ids[-1:], texts[-1:]
    if ids:
        yield ids, texts


def _handle(batches):
    for ids, texts in _pairs(batches):
        n = len(ids)
        new = [edited(texts[i], texts[i + 1]) for i in range(n)]
        own = Prints(*paragraph_keys(pa.array(texts, pa.large_string())))
        other = Prints(*paragraph_keys(pa.array(new, pa.large_string())))
        i = np.arange(n)
        near = lambda p, rows: likeness(own.n[:n], p.n[rows], differing(own, i, p, rows))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(ids, pa.int64()),
                pa.array([len(t) for t in texts[:n]], pa.int64()),
                pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in new]),
                pa.array([own.written(k) for k in range(n)]),
                pa.array([other.written(k) for k in range(n)]),
                pa.array(near(other, i)),
                pa.array(near(own, i + 1)),
            ],
            names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )


def fingerprint_documents(spark: SparkSession, df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return successors(spark, df, id_col, text_col, _handle, SCHEMA)
