"""Interpolated modified Kneser-Ney trigram model: counted in Spark, stored as sorted hash arrays, memory-mapped.

Words are `[^\\x20\\x09-\\x0D]+` with A-Z lower-cased; every text ends in one end token and starts after two start
marks that are only contexts. Spark jobs build the model in a folder that all executors share:

1. a pass counts tokens and words that make up a good part of a task's; how many shards there are follows from the
   first, and which middle words are split over several of them from the second;
2. each task counts the word triples of its texts in runs of RUN tokens and sends, for each shard, one packed array of
   distinct triples by middle word and context (so what is shuffled is pre-aggregated, a few bytes a triple);
3. a shard holds whole contexts (u, v), and all contexts of a middle word v unless v is split. It is merged and writes
   its triples with counts, its contexts with totals and N1, N2, N3+, and for words that are not split the pairs (v, w)
   with the number of different u before them, and each v's totals of those;
4. pairs of split words are merged by pair; then words, with their counts and the number of different v before them.

Middle words are split by their contexts, so no shard grows with one frequent word; shards grow in number with the
tokens, about SHARD_TOKENS each. Scoring tasks map the files and look sorted runs of keys up, so a worker's own memory
does not grow with the model. Keys are 46 bits of a hash inside a shard, 32 of them stored beside a table of places:
of three million keys one in twenty million shares its own with another and then reads its count.

Files are written under a temporary name and renamed, and their content is a function of the input, so a task that is
run again, or twice, changes nothing. A folder on a file system is mapped in place; any other store goes through
SparkContext.addFile, one copy of the model an executor.

Defined cases: null and empty texts score their end token alone; without training rows N = V = 0 and every score is 0;
repeated rows count as often as they occur; words that were never seen get the uniform share of the lowest level;
texts of any length are scored whole; further columns are ignored, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import math
import mmap
import os
import sys
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bound_batches, discard, mix, shared_folder, sorted_counts, stored, text_buffer, text_slices, tidy, word_hashes

END, START = np.uint64(0x1D8E4E27C47D124F), np.uint64(0xA0761D6478BD642F)
#: Tokens that a counting task holds before it packs and sends them.
RUN = 2_000_000
#: Training tokens for each shard, and the part of those from which on a middle word is split, a shard for each part.
SHARD_TOKENS, SPLIT = 3_000_000, 0.25
#: Bits of a key inside a shard: a table of places by the first, the others stored.
_BUCKETS, _STORED = 14, 32
_KEY = np.uint64(64 - _BUCKETS - _STORED)
_TURN, _TURN3 = np.uint64(0xE7037ED1A0B428DB), np.uint64(0x8EBC6AF09C88C6E3)


# ---------------------------------------------------------------- packing and files


def pack(*arrays: np.ndarray) -> bytes:
    """Unsigned arrays, each in the narrowest width that holds it."""
    head, body = [len(arrays)], []
    for a in arrays:
        top = int(a.max()) if len(a) else 0
        width = next(w for w in (1, 2, 4, 8) if top < 1 << 8 * w)
        head += [len(a), width]
        body.append(a.astype(f"<u{width}").tobytes())
    return np.array(head, "<i8").tobytes() + b"".join(body)


def unpack(raw, mapped: bool = False) -> list[np.ndarray]:
    n = int(np.frombuffer(raw, "<i8", 1)[0])
    head = np.frombuffer(raw, "<i8", 2 * n, 8)
    at, out = 8 + 16 * n, []
    for k in range(n):
        size, width = int(head[2 * k]), int(head[2 * k + 1])
        out.append(np.frombuffer(raw, f"<u{width}", size, at) if size else np.zeros(0, f"<u{width}"))
        at += size * width
    return out


def _write(folder: str, name: str, raw: bytes) -> None:
    if folder.startswith("file:"):
        path = "/" + folder.removeprefix("file:").lstrip("/")
        os.makedirs(path, exist_ok=True)
        tmp = f"{path}/.{name}.{uuid.uuid4().hex}"
        with open(tmp, "wb") as f:
            f.write(raw)
        os.replace(tmp, f"{path}/{name}")
    else:
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(folder)
        store.create_dir(path, recursive=True)
        with store.open_output_stream(f"{path}/{name}") as f:
            f.write(raw)


def _mapped(path: str) -> mmap.mmap:
    """A file's bytes. A map holds no descriptor (before Python 3.13 it does), so their limit does not bound the shards."""
    with open(path, "rb") as f:
        return mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ, **({"trackfd": False} if sys.version_info >= (3, 13) else {}))


class Model:
    """The mapped files of one folder; a shard that has no file is empty."""

    def __init__(self, folder: str):
        from pyspark import SparkFiles

        self.path = "/" + folder.removeprefix("file:").lstrip("/") if folder.startswith("file:") else SparkFiles.get(folder.rsplit("/", 1)[-1])
        self.maps: dict[str, list[np.ndarray]] = {}

    def arrays(self, name: str) -> list[np.ndarray]:
        if name not in self.maps:
            path = f"{self.path}/{name}"
            self.maps[name] = unpack(_mapped(path)) if os.path.exists(path) else []
        return self.maps[name]

    def words(self, kind: str, keys: np.ndarray, shards: int, n: int) -> list[np.ndarray]:
        """The n columns stored beside each of the sorted word hashes; 0 where one is not there."""
        out = [np.zeros(len(keys), np.int64) for _ in range(n)]
        cuts = np.searchsorted(_word_shard(keys, shards), np.arange(shards + 1))
        for s in np.flatnonzero(np.diff(cuts)):
            got = self.arrays(f"{kind}-{s}")
            if not got or not len(got[0]):
                continue
            q = keys[cuts[s] : cuts[s + 1]]
            at = np.minimum(np.searchsorted(got[0], q), len(got[0]) - 1)
            hit = np.flatnonzero(got[0][at] == q)
            for o, col in zip(out, got[1:]):
                o[cuts[s] + hit] = col[at[hit]]
        return out

    def find(self, kind: str, shard: np.ndarray, key: np.ndarray, n: int) -> list[np.ndarray]:
        """The n values of each key in its shard's table; 0 where it is not there. Looked up in order, each once."""
        tag, first, back = np.unique(key, return_index=True, return_inverse=True)
        own = shard[first]
        order = np.argsort(own, kind="stable")  # in a shard, keys stay in order
        own, tag = own[order], tag[order] >> _KEY
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        out = [np.zeros(len(tag), np.int64) for _ in range(n)]
        cuts = np.append(_first(own), len(own))
        for a, b in zip(cuts[:-1], cuts[1:]):
            got = self.arrays(f"{kind}-{own[a]}")
            if not got:
                continue
            places, stored, other, before, code, values = *got[:5], got[5:]
            q = tag[a:b]
            bucket, q = (q >> np.uint64(_STORED)).astype(np.int64), (q & np.uint64((1 << _STORED) - 1)).astype(np.uint32)
            lo, end = places[bucket].astype(np.int64), places[bucket + 1].astype(np.int64)
            hi = end.copy()
            for _ in range(int((hi - lo).max()).bit_length()):
                mid = (lo + hi) >> 1
                less = (stored[np.minimum(mid, len(stored) - 1)] < q) & (lo < hi)
                lo, hi = np.where(less, mid + 1, lo), np.where(less, hi, mid)
            hit = np.flatnonzero((lo < end) & (stored[np.minimum(lo, len(stored) - 1)] == q))
            c = _codes(lo[hit], other, before, code)
            for o, v in zip(out, values):
                o[a + hit] = v[c]
        return [o[place[back]] for o in out]


def _table(key: np.ndarray, *columns: np.ndarray) -> bytes:
    """A file for `find`: keys in order, and rows of columns as codes into a list of the different ones.

    The most frequent row is code 0 and takes a bit; only the others have a code written.
    """
    key = key >> _KEY
    places = np.searchsorted(key >> np.uint64(_STORED), np.arange((1 << _BUCKETS) + 1, dtype=np.uint64))
    h = np.zeros(len(key), np.uint64)
    for c in columns:
        h = mix(h * _TURN + c.astype(np.uint64))
    _, first, code, n = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
    rank = np.argsort(np.argsort(-n, kind="stable"))
    first = first[np.argsort(rank)]
    code = rank[code]
    bits = np.packbits(np.append(code > 0, np.zeros(-len(code) % 64, bool)), bitorder="little").view(np.uint64)
    before = np.cumsum(np.bitwise_count(bits), dtype=np.int64) - np.bitwise_count(bits)
    return pack(places, key & np.uint64((1 << _STORED) - 1), bits, before, code[code > 0], *[c[first] for c in columns])


def _codes(i: np.ndarray, bits: np.ndarray, before: np.ndarray, code: np.ndarray) -> np.ndarray:
    """The codes of some rows of a table."""
    word, at = bits[i >> 6].astype(np.uint64), (i & 63).astype(np.uint64)
    out = np.zeros(len(i), np.int64)
    own = np.flatnonzero(word >> at & np.uint64(1))
    rank = before[i[own] >> 6].astype(np.int64) + np.bitwise_count(word[own] & ((np.uint64(1) << at[own]) - np.uint64(1)))
    out[own] = code[rank]
    return out


def _planes(sorted_words: np.ndarray) -> np.ndarray:
    """Differences of sorted hashes, byte by byte: those that are nearly all 0 compress well."""
    return np.diff(sorted_words, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T.ravel()


def _from_planes(raw: np.ndarray) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(raw.astype(np.uint8).reshape(8, -1).T).view(np.uint64).ravel(), dtype=np.uint64)


_OPEN: dict[str, Model] = {}


def opened(folder: str) -> Model:
    if folder not in _OPEN:
        _OPEN.clear()
        _OPEN[folder] = Model(folder)
    return _OPEN[folder]


def _word_shard(h: np.ndarray, shards: int) -> np.ndarray:
    """By the top 24 bits, so that sorted hashes are grouped by shard."""
    return ((h >> np.uint64(40)) * np.uint64(shards) >> np.uint64(24)).astype(np.int64)


def pair_key(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    return mix(mix(v * _TURN) ^ w)


def triple_key(pair: np.ndarray, w: np.ndarray) -> np.ndarray:
    return mix(mix(pair * _TURN3) ^ w)


class Deal:
    """Which shard a context (u, v) is in: that of v, or one of several where v is split."""

    def __init__(self, shards: int, split: dict[int, int]):
        """split: how many shards share a middle word, for those that more than one do."""
        self.shards = shards
        self.hot = np.array(sorted(split), np.uint64)
        self.parts = np.array([split[int(h)] for h in self.hot], np.int64)

    def is_hot(self, v: np.ndarray) -> np.ndarray:
        if not len(self.hot):
            return np.zeros(len(v), bool)
        return self.hot[np.minimum(np.searchsorted(self.hot, v), len(self.hot) - 1)] == v

    def context(self, u: np.ndarray, v: np.ndarray) -> np.ndarray:
        out = (mix(v ^ _TURN) % np.uint64(self.shards)).astype(np.int64)
        at = np.flatnonzero(self.is_hot(v))
        if len(at):
            k = (mix(u[at] ^ _TURN3) % self.parts[np.searchsorted(self.hot, v[at])].astype(np.uint64)).astype(np.int64)
            out[at] = (out[at] + k) % self.shards
        return out

    def pair(self, v: np.ndarray, key: np.ndarray) -> np.ndarray:
        """Where the pairs of v are: in its own shard, or by pair (numbers from `shards` on) where v is split."""
        own = (mix(v ^ _TURN) % np.uint64(self.shards)).astype(np.int64)
        return np.where(self.is_hot(v), self.shards + (key % np.uint64(self.shards)).astype(np.int64), own)


def tokens(arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts, each text followed by END; each text's first token."""
    h, off = word_hashes(*text_buffer(arr))
    rows = len(arr)
    out = np.full(len(h) + rows, END, np.uint64)
    out[np.arange(len(h)) + np.repeat(np.arange(rows), np.diff(off))] = h
    return out, off + np.arange(rows + 1)


def contexts(t: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two tokens before each; start marks before a text's first."""
    u, v = np.empty_like(t), np.empty_like(t)
    v[1:] = t[:-1]
    v[at[:-1]] = START
    u[1:] = v[:-1]
    u[at[:-1]] = START
    return u, v


# ---------------------------------------------------------------- counting


def _frequent(batches):
    """Rows (word, n): the number of tokens (word null), and words that occur several times in a slice of texts."""
    for b in batches:
        for s in text_slices(b):
            t, _ = tokens(s.column(0))
            h, n = sorted_counts(t)
            top = n >= max(4, len(t) >> 16)
            yield pa.RecordBatch.from_arrays([pa.array([None, *h[top].view(np.int64).tolist()], pa.int64()), pa.array([len(t), *n[top].tolist()], pa.int64())], names=["word", "n"])


def _packed(u: np.ndarray, v: np.ndarray, w: np.ndarray, deal: Deal) -> Iterator[tuple[int, bytes]]:
    """(shard, blob) of a run's triples: by middle word and context, each with its followers and how often."""
    import zstandard

    words, inv = np.unique(np.concatenate([u, v, w]), return_inverse=True)
    bits = np.uint64(21)
    if len(words) >= 1 << 21:  # too many different words for one 64-bit sort key
        for half in (slice(None, len(w) // 2), slice(len(w) // 2, None)):
            yield from _packed(u[half], v[half], w[half], deal)
        return
    iu, iv, iw = np.split(inv.astype(np.uint64), 3)
    key = iv << (bits + bits) | iu << bits | iw
    key, n = sorted_counts(key)
    low = np.uint64((1 << 21) - 1)
    first = np.flatnonzero(np.concatenate([[True], (key[1:] >> bits) != (key[:-1] >> bits)]))
    fans = np.diff(np.append(first, len(key)))
    cv, cu = (key[first] >> (bits + bits)).astype(np.int64), (key[first] >> bits & low).astype(np.int64)
    shard = deal.context(words[cu], words[cv])
    order = np.argsort(shard, kind="stable")
    cuts = np.searchsorted(shard[order], np.arange(deal.shards + 1))
    for s in np.flatnonzero(np.diff(cuts)):
        own = order[cuts[s] : cuts[s + 1]]
        f = fans[own]
        ends = np.cumsum(f)
        rows = np.arange(int(ends[-1])) + np.repeat(first[own] - (ends - f), f)
        used, local = np.unique(np.concatenate([cv[own], cu[own], (key[rows] & low).astype(np.int64)]), return_inverse=True)
        lv, lu, lw = local[: len(own)], local[len(own) : 2 * len(own)], local[2 * len(own) :]
        yield int(s), zstandard.compress(pack(_planes(words[used]), np.diff(lv, prepend=0), lu, f, lw, n[rows]), 1)


def _count(deal: Deal):
    def run(batches):
        held: list[tuple] = []
        size = 0

        def rows():
            got = list(_packed(*(np.concatenate(c) for c in zip(*held)), deal))
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in got], pa.int32()), pa.array([r[1] for r in got], pa.binary())], names=["shard", "blob"])

        for b in batches:
            for s in text_slices(b):
                t, at = tokens(s.column(0))
                held.append((*contexts(t, at), t))
                size += len(t)
                if size >= RUN:
                    yield rows()
                    held, size = [], 0
        if size:
            yield rows()

    return run


def _of_counts(n: np.ndarray) -> list[int]:
    return [int((n == k).sum()) for k in (1, 2, 3, 4)]


#: kind: `triples` and `pairs` (statistics of a shard), `hot` (packed pairs of split words), `words`, `middle` (a split word).
STATS = "kind string, shard long, blob binary, types long, n1 long, n2 long, n3 long, n4 long, total long"


def _stat_rows(rows: list) -> pa.Table:
    names = ["kind", "shard", "blob", "types", "n1", "n2", "n3", "n4", "total"]
    kinds = [pa.string(), pa.int64(), pa.binary(), *[pa.int64()] * 6]
    return pa.table([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)


def _first(sorted_keys: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]])) if len(sorted_keys) else np.zeros(0, np.int64)


def _sums(order_by: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Distinct keys in order; totals of n, and how many are 1, 2, 3 and more."""
    o = np.argsort(order_by, kind="stable")
    k, c = order_by[o], n[o]
    at = _first(k)
    return k[at], [np.add.reduceat(x.astype(np.int64), at) if len(at) else np.zeros(0, np.int64) for x in (c, c == 1, c == 2, c >= 3)]


def _word_rows(w: np.ndarray, types: np.ndarray, total: np.ndarray, shards: int) -> list:
    """Counts and numbers of different words before, added up by word and packed by word shard."""
    words, types = sorted_counts(w, types) if len(w) else (w, types)
    _, total = sorted_counts(w, total) if len(w) else (w, total)
    cuts = np.searchsorted(_word_shard(words, shards), np.arange(shards + 1))
    return [("words", int(k), pack(words[a:b], types[a:b], total[a:b]), 0, 0, 0, 0, 0, 0) for k, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a]


def _merge(folder: str, deal: Deal):
    """The shards of a partition, one as a rule: triples and contexts, and the pairs of middle words that are not split."""
    import zstandard

    def run(batches):
        held: dict[int, list] = {}
        for b in batches:
            for s, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                held.setdefault(s, []).append(raw)
        for s in sorted(held):
            yield from one(s, held.pop(s)).to_batches()

    def one(s: int, blobs: list[bytes]) -> pa.Table:
        us, vs, ws, ns = [], [], [], []
        while blobs:
            words, dv, lu, f, lw, n = unpack(zstandard.decompress(blobs.pop()))
            words = _from_planes(words)
            f = f.astype(np.int64)
            lv = np.cumsum(dv.astype(np.int64))
            us.append(np.repeat(words[lu], f).astype(np.uint64))
            vs.append(np.repeat(words[lv], f).astype(np.uint64))
            ws.append(words[lw].astype(np.uint64))
            ns.append(n.astype(np.int64))
        u, v, w, n = (np.concatenate(x) for x in (us, vs, ws, ns))
        del us, vs, ws, ns
        context = pair_key(u, v)
        del u
        triple = triple_key(context, w)
        order = np.argsort(triple, kind="stable")
        triple = triple[order]
        at = _first(triple)
        n = np.add.reduceat(n[order], at)
        order = order[at]
        _write(folder, f"triple-{s}", _table(triple[at], n))
        del triple
        v, w, context = v[order], w[order], context[order]
        names, sums = _sums(context, n)
        _write(folder, f"context-{s}", _table(names, *sums))
        del context, names, sums
        # Pairs: how many different u stand before each (all of them are in this shard, unless v is split).
        pair = pair_key(v, w)
        order = np.argsort(pair, kind="stable")
        pair = pair[order]
        at = _first(pair)
        before, total = np.diff(np.append(at, len(pair))), np.add.reduceat(n[order], at)
        v, w, pair = v[order[at]], w[order[at]], pair[at]
        hot = deal.is_hot(v)
        rows = [("triples", s, None, len(n), *_of_counts(n), int(n.sum()))]
        if not hot.all():
            own = ~hot
            _write(folder, f"pair-{s}", _table(pair[own], before[own]))
            names, sums = _sums(mix(v[own]), before[own])
            _write(folder, f"middle-{s}", _table(names, *sums))
            rows.append(("pairs", s, None, int(own.sum()), *_of_counts(before[own]), int(before[own].sum())))
        rows += _word_rows(w, (~hot).astype(np.int64), total, deal.shards)
        if hot.any():
            v, w, before, to = v[hot], w[hot], before[hot], deal.pair(v[hot], pair[hot])
            order = np.argsort(to, kind="stable")
            cuts = _first(to[order])
            for a, b in zip(cuts, np.append(cuts[1:], len(order))):
                i = order[a:b]
                words, local = np.unique(np.concatenate([v[i], w[i]]), return_inverse=True)
                rows.append(("hot", int(to[i[0]]), zstandard.compress(pack(_planes(words), local[: len(i)], local[len(i) :], before[i]), 1), 0, 0, 0, 0, 0, 0))
        return _stat_rows(rows)

    return run


def _merge_hot(folder: str, shards: int):
    """The pairs of split words whose keys meet here: different u before them, from all shards."""
    import zstandard

    def run(key, table):
        s = key[0].as_py()
        vs, ws, ns = [], [], []
        for raw in table["blob"]:
            words, lv, lw, n = unpack(zstandard.decompress(raw.as_py()))
            words = _from_planes(words)
            vs.append(words[lv].astype(np.uint64))
            ws.append(words[lw].astype(np.uint64))
            ns.append(n.astype(np.int64))
        v, w, n = (np.concatenate(x) for x in (vs, ws, ns))
        pair = pair_key(v, w)
        order = np.argsort(pair, kind="stable")
        pair = pair[order]
        at = _first(pair)
        n = np.add.reduceat(n[order], at)
        v, w = v[order[at]], w[order[at]]
        _write(folder, f"pair-{s}", _table(pair[at], n))
        names, sums = _sums(v, n)
        middle = [("middle", int(h), None, 0, int(a), int(b), int(c), 0, int(t)) for h, t, a, b, c in zip(names.view(np.int64), *sums)]
        return _stat_rows([("pairs", s, None, len(n), *_of_counts(n), int(n.sum())), *middle, *_word_rows(w, np.ones(len(w), np.int64), np.zeros(len(w), np.int64), shards)])

    return run


def _merge_words(folder: str):
    def run(key, table):
        s = key[0].as_py()
        got = [unpack(raw.as_buffer()) for raw in table["blob"]]
        w, types, total = (np.concatenate([g[i] for g in got]) for i in range(3))
        words, types2 = sorted_counts(w.astype(np.uint64), types.astype(np.int64))
        _, total = sorted_counts(w.astype(np.uint64), total.astype(np.int64))
        _write(folder, f"word-{s}", pack(words, total, types2))
        return _stat_rows([("word", s, None, len(words), *_of_counts(types2), int(total.sum()))])

    return run


def discounts(n1: int, n2: int, n3: int, n4: int) -> tuple[float, float, float]:
    """Modified Kneser-Ney, kept in [0.1, k] so that small or odd corpora leave mass for the unseen."""
    y = n1 / (n1 + 2 * n2) if n1 else 0.5
    d1 = 1 - 2 * y * n2 / n1 if n1 else 0.5
    d2 = 2 - 3 * y * n3 / n2 if n2 else d1
    d3 = 3 - 4 * y * n4 / n3 if n3 else d2
    return tuple(float(min(max(d, 0.1), k)) for k, d in ((1, d1), (2, d2), (3, d3)))


def train(spark: SparkSession, docs: DataFrame, text_col: str = "text") -> dict:
    """Counts `docs` and writes the model; returns its description (a few numbers, the split words and the folder)."""
    bound_batches(spark)
    texts = docs.select(text_col)
    seen = stored(spark, texts.mapInArrow(_frequent, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "frequent")
    total = seen.where("word IS NULL").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    shards = max(16, -(-total // SHARD_TOKENS))
    # At most shards / SPLIT words can be that frequent.
    hot = seen.where(F.col("word").isNotNull() & (F.col("n") >= SPLIT * total / shards)).collect()
    deal = Deal(shards, {r["word"] & (1 << 64) - 1: min(shards, math.ceil(r["n"] * shards / (SPLIT * total))) for r in hot})
    discard(spark, seen)
    folder = shared_folder(spark, "kneser-ney")
    counted = texts.mapInArrow(tidy(_count(deal)), "shard int, blob binary")
    # A partition for each shard, so that tasks are even and hold one at a time.
    merged = stored(spark, counted.repartitionById(shards, F.col("shard")).mapInArrow(tidy(_merge(folder, deal)), STATS), "shards")
    split = stored(spark, merged.where("kind = 'hot'").select("shard", "blob").groupBy("shard").applyInArrow(_merge_hot(folder, shards), STATS), "split")
    both = merged.unionByName(split)
    add = [F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("types", "n1", "n2", "n3", "n4", "total")]
    triples, pairs = (both.where(F.col("kind") == k).agg(*add).first() for k in ("triples", "pairs"))
    middle = {r["shard"] & (1 << 64) - 1: (r["total"], r["n1"], r["n2"], r["n3"]) for r in split.where("kind = 'middle'").groupBy("shard").agg(*add).collect()}
    words = both.where("kind = 'words'").select("shard", "blob").groupBy("shard").applyInArrow(_merge_words(folder), STATS).agg(*add).first()
    discard(spark, merged, split)
    if not folder.startswith("file:") and triples["types"]:
        spark.sparkContext.addFile(folder, recursive=True)
    k = ("n1", "n2", "n3", "n4")
    d = discounts(*(words[x] for x in k))
    return {
        "folder": folder, "deal": deal, "tokens": words["total"], "vocabulary": words["types"], "pair_types": pairs["types"], "triple_types": triples["types"],
        "middle": np.array([middle.get(int(h), (0, 0, 0, 0)) for h in deal.hot], np.int64).reshape(-1, 4),
        "triple_discounts": discounts(*(triples[x] for x in k)), "pair_discounts": discounts(*(pairs[x] for x in k)), "word_discounts": d,
        "word_rest": d[0] * words["n1"] + d[1] * words["n2"] + d[2] * max(0, words["types"] - words["n1"] - words["n2"]),
    }


# ---------------------------------------------------------------- scoring


def _discount(n: np.ndarray, d: tuple) -> np.ndarray:
    return np.array([0.0, *d])[np.minimum(n, 3)]


def _mixed(n: np.ndarray, sums: list[np.ndarray], d: tuple, lower: np.ndarray) -> np.ndarray:
    """A level's discounted share, and what its context leaves for the level below; that alone in an unseen context."""
    total, n1, n2, n3 = sums
    rest = np.where(total > 0, (d[0] * n1 + d[1] * n2 + d[2] * n3) / np.maximum(total, 1), 1.0)
    return (n - _discount(n, d)) / np.maximum(total, 1) + rest * lower


def score_tokens(m: dict, t: np.ndarray, u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """log10 probability of each token after the two before it, and each token's training count."""
    if not m["tokens"]:
        return np.zeros(len(t)), np.zeros(len(t), np.int64)
    model, deal = opened(m["folder"]), m["deal"]
    words, wi = np.unique(t, return_inverse=True)
    count, before = model.words("word", words, deal.shards, 2)
    low = (before - _discount(before, m["word_discounts"]) + m["word_rest"] / (m["vocabulary"] + 1)) / m["pair_types"]
    names, vi = np.unique(v, return_inverse=True)
    middle = model.find("middle", deal.pair(names, names), mix(names), 4)
    hot = np.flatnonzero(deal.is_hot(names))
    for o, c in zip(middle, m["middle"].T):
        o[hot] = c[np.searchsorted(deal.hot, names[hot])]
    pair = pair_key(v, t)
    two = _mixed(model.find("pair", deal.pair(v, pair), pair, 1)[0], [c[vi] for c in middle], m["pair_discounts"], low[wi])
    context, shard = pair_key(u, v), deal.context(u, v)
    three = _mixed(model.find("triple", shard, triple_key(context, t), 1)[0], model.find("context", shard, context, 4), m["triple_discounts"], two)
    return np.log10(three), count[wi]


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score(df: DataFrame, m: dict, id_col: str = "doc_id", text_col: str = "text", flag_col: str = "held_out") -> DataFrame:
    """Each document's tokens, known tokens, add-one unigram score and model score (log10)."""

    def run(batches):
        for b in batches:
            for s in text_slices(b, 2):
                t, at = tokens(s.column(2))
                lp, count = score_tokens(m, t, *contexts(t, at))
                base = np.log10((count + 1) / (m["tokens"] + m["vocabulary"] + 1))
                per = lambda x: np.add.reduceat(x, at[:-1])
                yield pa.RecordBatch.from_arrays(
                    [s.column(0), s.column(1), pa.array(np.diff(at)), pa.array(per((count > 0).astype(np.int64))), pa.array(np.full(len(at) - 1, m["tokens"], np.int64)), pa.array(per(base)), pa.array(per(lp))],
                    names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(flag_col).alias("held_out"), F.col(text_col).alias("text")).mapInArrow(tidy(run), SCORES)
