"""Benchmark decontamination by the q-gram lemma, diagonal bands and banded alignment.

Texts are compared lower-cased with white space folded. A window is any run of 48 or 64 characters of a benchmark item,
wherever it starts (an item under 48 is one window); 4 or 6 edits are allowed in it (about one in ten of a shorter
one). By the q-gram lemma, a place within k edits of a window of n characters shares n - q + 1 - k q of its q-grams
with it, all on diagonals (text position less item position) that span at most k. So:

1. Shared q-grams are counted in overlapping diagonal bands: sorted by band and item position, a window reaches its
   bound where as many different positions lie within its length. Regions that reach none go.
2. The lemma again, with q = 2 and on the band's diagonals alone, for every window of the regions left: most chance
   likenesses share a word or two and go here.
3. The windows left are verified by an alignment confined to the band.

No window within its edits is missed, so a document is contaminated by an item if and only if it holds one. An excerpt
of 48 characters with up to 4 edits, or of 64 with up to 6, is found wherever it was cut from the item. The lemma
would allow 5 and 7, with a bound of one shared q-gram, which rules next to nothing out.

The benchmark is the query set: it goes to every task, in blocks of at most BLOCK_CHARS characters, one pass over the
documents for each block. Documents are read whole and never shuffled. Shared q-grams are spread out MAX_HITS at a
time, in slices of the text that overlap by a window, so texts and items that repeat one q-gram take no more memory.

Defined cases: null or empty texts match nothing, nor do null items or those of white space; items under q
characters are found as they are, between signs that are no letters or digits; NUL counts as white space; equal items
are each reported; repeated rows report each; empty tables give no rows; further columns are ignored by `find_leaks`
and kept by `contaminated`, but one named as its output is replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, mix, text_slices, tidy

Q = 8
#: Window sizes and the edits allowed in them, and the characters for each edit in a shorter item.
SIZES = ((48, 4), (64, 6))
SHORT, WINDOW, EDITS = SIZES[0][0], SIZES[-1][0], SIZES[-1][1]
EDITS_PER = 10
#: Benchmark characters that are broadcast at once.
BLOCK_CHARS = 250_000
#: Pairs of a text's and an item's q-gram that are held at once; window starts that are looked at together.
MAX_HITS, STARTS = 2_000_000, 64
PAD = 2 * WINDOW
_MULS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def fold(text: str | None) -> str:
    return " ".join((text or "").replace("\0", " ").lower().split())


def points(s: str) -> np.ndarray:
    return np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32)


def gram_hashes(c: np.ndarray) -> np.ndarray:
    """A hash of the Q code points from each place on, by doubling (Q = 8)."""
    h = c.astype(np.uint64)
    for width, mul in zip((1, 2, 4), _MULS):
        if len(h) <= width:
            return np.zeros(0, np.uint64)
        h = h[:-width] * mul + h[width:]
    return mix(h)


def budget(n: int) -> int:
    """Edits allowed in a window of n characters; the bound of the lemma stays at 1 or more."""
    return max(0, min(n // EDITS_PER, (n - Q) // Q))


class Queries:
    """Some items side by side, and the places of their q-grams."""

    def __init__(self, items: list[tuple[int, str]]):
        self.items = items
        folded = [fold(t) for _, t in items]
        self.short = [(i, t) for i, t in enumerate(folded) if 0 < len(t) < Q]
        long = [(i, t) for i, t in enumerate(folded) if len(t) >= Q]
        self.owner = np.array([i for i, _ in long], np.int64)
        self.size = np.array([len(t) for _, t in long], np.int64)
        self.start = PAD + np.cumsum(self.size + PAD) - self.size - PAD
        gap = "\0" * PAD
        self.text = points(gap + "".join(t + gap for _, t in long))
        n = np.minimum(self.size, WINDOW)
        k = np.where(self.size >= WINDOW, EDITS, np.where(self.size >= SHORT, SIZES[0][1], [budget(x) for x in n.tolist()])).astype(np.int64) if len(n) else n
        n = np.where((self.size >= SHORT) & (self.size < WINDOW), SHORT, n)
        # The least number of shared q-grams in a window of an item, and how far apart the first and last of them lie.
        self.bound, self.reach = n - Q + 1 - k * Q, n - Q
        h = gram_hashes(self.text)
        at = np.concatenate([np.arange(s, s + z - Q + 1) for s, z in zip(self.start, self.size)]) if len(long) else np.zeros(0, np.int64)
        order = np.argsort(h[at], kind="stable")
        self.at = at[order]
        self.gram, first = np.unique(h[self.at], return_index=True)
        self.first = np.append(first, len(at))
        self.bits = 22
        self.seen = np.zeros(1 << self.bits, bool)
        self.seen[(self.gram >> np.uint64(64 - self.bits)).astype(np.int64)] = True
        self.item_at = np.repeat(np.arange(len(long)), self.size + PAD) if len(long) else np.zeros(0, np.int64)

    def item_of(self, at: np.ndarray) -> np.ndarray:
        """Which of the long items a place of the item text is in."""
        return self.item_at[np.clip(at - PAD, 0, len(self.item_at) - 1)]

    def hits(self, buf: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(item place, text place) of shared q-grams, slice by slice; slices overlap by all that a region spans."""
        if not len(self.gram):
            return
        h = gram_hashes(buf)
        p = np.flatnonzero(self.seen[(h >> np.uint64(64 - self.bits)).astype(np.int64)])
        g = np.searchsorted(self.gram, h[p])
        ok = self.gram[np.minimum(g, len(self.gram) - 1)] == h[p]
        p, g = p[ok], g[ok]
        # A region that reaches the least bound has that many hits close by.
        span = WINDOW + 2 * EDITS + Q
        least = int(self.bound.min())
        for _ in range(2):
            if not len(p):
                return
            keep = np.flatnonzero(np.searchsorted(p, p + span) - np.searchsorted(p, p - span) >= least)
            p, g = p[keep], g[keep]
        n = self.first[g + 1] - self.first[g]
        ends = np.cumsum(n)
        lo = 0
        while lo < len(p):
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + MAX_HITS, "right")))
            begin = int(np.searchsorted(p, p[lo] - span))
            m = n[begin:hi]
            stop = np.cumsum(m)
            idx = np.arange(int(stop[-1])) - np.repeat(stop - m, m) + np.repeat(self.first[g[begin:hi]], m)
            yield self.at[idx], np.repeat(p[begin:hi], m)
            lo = hi

    def regions(self, at: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(item, lowest window start, lowest diagonal) of regions whose band holds as many q-grams as the lemma asks."""
        stride = len(self.text) + 1
        band = (pos - at + len(self.text)) // EDITS
        key = np.concatenate([band * stride + at, (band - 1) * stride + at])  # bands of two cells, overlapping by one
        key.sort()
        key = key[np.append(True, key[1:] != key[:-1])] if len(key) else key
        item = self.item_of(key % stride)
        ahead = np.arange(len(key)) + self.bound[item] - 1
        ok = np.flatnonzero(ahead < len(key))
        ok = ok[key[ahead[ok]] - key[ok] <= self.reach[item[ok]]]
        key, item = key[ok], item[ok]
        first = key % stride - self.start[item]
        block = np.unique(np.stack([key // stride, item, first // STARTS]), axis=1)
        band, item, block = block
        return item, self.start[item] + block * STARTS - (WINDOW - Q), band * EDITS - len(self.text)

    def windows(self, item: np.ndarray, low: np.ndarray, diag: np.ndarray, buf: np.ndarray) -> Iterator[np.ndarray]:
        """Columns (region, window start, size, edits allowed, characters to spare) of windows that pass the lemma for q = 2."""
        width = STARTS + WINDOW - Q + WINDOW
        off = np.arange(width + 2 * EDITS)
        for s in range(0, len(item), 512):
            own = np.arange(s, min(s + 512, len(item)))
            x = self.text[np.clip(low[own][:, None] + off[:width], 0, len(self.text) - 1)]
            y = buf[np.clip((low + diag)[own][:, None] + off, 0, len(buf) - 1)]
            same = np.zeros((len(own), width - 1), bool)
            for d in range(2 * EDITS):
                e = x == y[:, d : d + width]
                same |= e[:, :-1] & e[:, 1:]
            total = np.zeros((len(own), width), np.int16)
            np.cumsum(same, axis=1, dtype=np.int16, out=total[:, 1:])
            size, begin = self.size[item[own]][:, None], self.start[item[own]][:, None]
            for n, k in SIZES:
                have = total[:, n - 1 :] - total[:, : width - n + 1]
                at = low[own][:, None] + np.arange(have.shape[1])
                r, c = np.nonzero((have >= n - 1 - 2 * k) & (at >= begin) & (at + n <= begin + size) & (size >= SHORT))
                yield np.stack([own[r], at[r, c], np.full(len(r), n), np.full(len(r), k), have[r, c] - (n - 1 - 2 * k)])
            # An item under the least size is one window.
            r = np.flatnonzero((size[:, 0] < SHORT) & (begin[:, 0] >= low[own]) & (begin[:, 0] + size[:, 0] <= low[own] + width))
            if len(r):
                n, c = size[r, 0], begin[r, 0] - low[own[r]]
                k = np.array([budget(v) for v in n.tolist()], np.int64)
                have = total[r, c + n - 1] - total[r, c]
                spare = have - np.maximum(n - 1 - 2 * k, 0)
                fine = spare >= 0
                yield np.stack([own[r], begin[r, 0], n, k, spare])[:, fine]

    def align(self, at: np.ndarray, size: np.ndarray, place: np.ndarray, buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Least edits between each window and the text on the diagonals of its band, and where the text's part ends.

        place: where the window starts in the text on the lowest diagonal.
        """
        off = np.arange(2 * EDITS)
        d = np.zeros((len(at), 2 * EDITS), np.int32)
        for i in range(int(size.max(initial=0))):
            j = place[:, None] + i + off
            y = np.where((j >= 0) & (j < len(buf)), buf[np.clip(j, 0, len(buf) - 1)], 0)
            t = d + (y != self.text[np.minimum(at + i, len(self.text) - 1)][:, None])
            t[:, :-1] = np.minimum(t[:, :-1], d[:, 1:] + 1)
            t = np.minimum.accumulate(t - off, 1) + off
            d = np.where((i < size)[:, None], t, d)
        return d.min(1).astype(np.int64), place + size + d.argmin(1)

    def search(self, buf: np.ndarray, row_of) -> dict[tuple[int, int], tuple[int, int, int]]:
        """(row, item) to (edits, window start in the item, end in buf) of a verified window.

        The windows of a row and item are tried by how much more than needed they share, most first, then by place.
        """
        found: dict[tuple[int, int], tuple[int, int, int]] = {}
        done = np.zeros(0, np.int64)
        for at, pos in self.hits(buf):
            if len(done):  # what is found needs no more hits
                keep = ~np.isin(row_of(pos) * len(self.owner) + self.item_of(at), done)
                at, pos = at[keep], pos[keep]
            if not len(at):
                continue
            item, low, diag = self.regions(at, pos)
            if not len(item):
                continue
            pair = row_of(low + (WINDOW - Q) + STARTS // 2 + diag + EDITS) * len(self.owner) + item
            for s in range(0, len(item), 1 << 14):
                part = slice(s, s + (1 << 14))
                got = [w for w in self.windows(item[part], low[part], diag[part], buf) if w.shape[1]]
                if not got:
                    continue
                r, start, size, k, spare = np.concatenate(got, 1)
                r += s
                order = np.lexsort((start + diag[r], start, size, -spare, pair[r]))
                r, start, size, k = r[order], start[order], size[order], k[order]
                if len(done):
                    keep = ~np.isin(pair[r], done)
                    r, start, size, k = r[keep], start[keep], size[keep], k[keep]
                most = 1
                while len(r):  # the best of each pair, then more of those that are open
                    first = np.flatnonzero(np.concatenate([[True], pair[r][1:] != pair[r][:-1]]))
                    rank = np.arange(len(r)) - np.repeat(first, np.diff(np.append(first, len(r))))
                    try_now = np.flatnonzero(rank < most)
                    most *= 8
                    for b in range(0, len(try_now), 4096):
                        i = try_now[b : b + 4096]
                        edits, end = self.align(start[i], size[i], start[i] + diag[r[i]], buf)
                        for j in np.flatnonzero(edits <= k[i]).tolist():
                            x, own = i[j], int(item[r[i[j]]])
                            row, _ = divmod(int(pair[r[x]]), len(self.owner))
                            found.setdefault((row, int(self.owner[own])), (int(edits[j]), int(start[x] - self.start[own]), int(end[j])))
                    open_ = np.ones(len(r), bool)
                    open_[try_now] = False
                    place = {int(o): n for n, o in enumerate(self.owner)}
                    done = np.array([row * len(self.owner) + place[o] for row, o in found], np.int64)
                    open_ &= ~np.isin(pair[r], done)
                    r, start, size, k = r[open_], start[open_], size[open_], k[open_]
        return found

    def documents(self, texts: list[str | None]) -> list[tuple[int, int, int, int, int]]:
        """(row, item id, edits, window's place in the item, its end in the folded text) for each contaminated pair."""
        folded = [fold(t) for t in texts]
        starts, at = [], PAD
        for t in folded:
            starts.append(at)
            at += len(t) + PAD
        pad = "\0" * PAD
        begin = np.array(starts, np.int64)
        row_of = lambda place: np.maximum(np.searchsorted(begin, place + PAD // 2, "right") - 1, 0)
        found = self.search(points(pad + pad.join(folded) + pad), row_of)
        out = {(r, i): (e, w, min(max(0, p - starts[r]), len(folded[r]))) for (r, i), (e, w, p) in found.items()}
        for i, s in self.short:
            bare = re.compile(rf"(?<![^\W_]){re.escape(s)}(?![^\W_])")
            for r, t in enumerate(folded):
                if s in t and (m := bare.search(t)):
                    out[r, i] = (0, 0, m.end())
        return [(r, self.items[i][0], *v) for (r, i), v in sorted(out.items())]


MATCHES = "doc_id long, item_id long, edits long, item_start long, end long"


def query_blocks(benchmark: DataFrame, item_col: str = "item_id", item_text: str = "text"):
    """The benchmark's windows, in blocks of bounded size; one block for an empty benchmark."""
    items = benchmark.where(F.col(item_text).isNotNull()).select(F.col(item_col).cast("long").alias("i"), F.col(item_text).alias("t"))
    total = items.agg(F.sum(F.char_length("t"))).first()[0] or 0
    blocks = max(1, -(-total // BLOCK_CHARS))
    for b in range(blocks):
        own = items.where(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == b).collect()
        yield Queries(sorted((r["i"] if r["i"] is not None else -1, r["t"]) for r in own))


def find_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document and item found in it: the edits of a verified window, its place in the item, its end in the folded text."""
    bound_batches(docs.sparkSession)
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return reduce(DataFrame.unionByName, [narrow.mapInArrow(_searcher(q), MATCHES) for q in query_blocks(benchmark)])


def _searcher(queries: Queries):
    def run(batches):
        for b in batches:
            for s in text_slices(b, 1, 2 << 20):
                rows = queries.documents(s.column(1).to_pylist())
                ids = s.column(0).to_pylist()
                cols = list(zip(*[(ids[r[0]], *r[1:]) for r in rows])) or [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "item_id", "edits", "item_start", "end"])

    return run


def _lister(queries: Queries):
    def run(batches):
        for arr in batches:
            lists: list[list[int]] = [[] for _ in range(len(arr))]
            done = 0
            for s in text_slices(pa.RecordBatch.from_arrays([arr], names=["t"]), limit=2 << 20):
                for r in queries.documents(s.column(0).to_pylist()):
                    lists[done + r[0]].append(r[1])
                done += s.num_rows
            yield pa.array(lists, pa.list_(pa.int64()))

    run = tidy(run)
    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return run


def contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", out: str = "leaks") -> DataFrame:
    """docs with the ids of the items found in each, as an array; only the text travels to Python."""
    bound_batches(docs.sparkSession)
    found = [F.arrow_udf(_lister(q), "array<bigint>")(F.col(text_col)) for q in query_blocks(benchmark)]
    return docs.withColumn(out, F.concat(*found) if len(found) > 1 else found[0])
