"""SentencePiece encoding and decoding by max-plus scans.

A text is the dummy prefix and the text with spaces as U+2581; its best segmentation is the path of highest score
through the lattice of vocabulary pieces. No piece holds a line feed, and a piece holds U+2581 only in the run that it
begins with, so the lattice falls apart into units at those places: a run of spaces and what follows it. Equal units
are solved once. A unit longer than CHUNK code points is cut into chunks. A chunk's boundary state is how far the last
piece of the chunk before reaches into it (0 to LONGEST - 1), and its transfer matrix has, for each state on entry and
on exit, the best score between them. Matrices combine by (max, +), which is associative; once the states at all
boundaries are known, each chunk is traced back alone. All chunks, entry states and units run in lockstep as lanes of
numpy arrays. A model of which pieces cross spaces has lines as units.

Scores are whole numbers (fixed point), so sums are exact in any order; of paths of equal score the one with the
longest last piece is taken, place by place. A model of kind unigram has log probabilities. One of kind BPE stores
merge ranks instead (a piece's place in the vocabulary); there the score of a piece is the log of a Zipf share of its
rank, and ids are those that the library gives for a unigram model of these pieces and scores, not those of greedy
merging. Nothing is trained. Characters outside the vocabulary cost UNKNOWN more than the rarest piece and become byte
pieces, as in the library; so does a literal U+2581, which the library would take for a space. So decoding gives back
every text exactly.

Defined cases: null texts give null ids; the empty text has none; texts of any length are encoded whole; rows repeat
as in the input; an empty table stays empty; further columns pass through, but one named as the output is replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, IdTable, mix, run_hashes, text_buffer, text_slices, tidy

CHUNK = 64
#: Solved units a worker keeps.
CACHE = 1_000_000
#: Fixed point of scores (sums of single precision are exact too); a path without a piece.
UNIT, NONE = 1 << 8, -(1 << 60)
#: Fixed value: what an unknown character costs beyond the rarest piece.
UNKNOWN = 10.0
#: A literal U+2581 in a text: a lone surrogate, which no text holds.
LITERAL = "\udc81"
#: A NUL in a text; code point 0 pads rows.
NUL = 0x110000
SPACE = "▁"
_MUL = np.uint64(0x9E3779B97F4A7C15)


class Vocabulary:
    """Pieces of a SentencePiece model with whole-number scores and a hash table of their strings."""

    def __init__(self, model_file: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = sp.get_piece_size()
        self.bytes: dict[int, int] = {}
        pieces: list[tuple[str, int, float]] = []
        self.text: list[bytes] = [b""] * n
        for i in range(n):
            s = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.bytes[int(s[3:5], 16)] = i
                self.text[i] = bytes([int(s[3:5], 16)])
            elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
                self.text[i] = s.replace(SPACE, " ").encode()
                if "\n" not in s:
                    pieces.append((s, i, sp.get_score(i)))
        scores = np.array([p[2] for p in pieces])
        real = scores[scores > -1e8]
        ranked = len(real) > 1 and bool((real == np.round(real)).all())
        # Ranks are places in the vocabulary, also of pieces that the model never merges (runs of spaces).
        logs = -np.log(2.0 + np.array([p[1] for p in pieces]) - min(p[1] for p in pieces)) if ranked else scores
        logs = np.round(logs * UNIT) / UNIT
        self.crosses = any(SPACE in s.lstrip(SPACE) for s, _, _ in pieces)
        self.scores = np.full(n, NONE, np.int64)
        self.longest = max([len(p[0]) for p in pieces], default=1)
        self.unknown = int(round((logs.min(initial=0.0) - UNKNOWN) * UNIT))
        hashes = np.array([self._hash(p[0]) for p in pieces], np.uint64)
        assert len(np.unique(hashes)) == len(hashes)
        for (_, i, _), x in zip(pieces, logs):
            self.scores[i] = int(round(x * UNIT))
        self.bits = max(12, int(np.ceil(np.log2(4 * max(1, len(pieces))))))
        self.key, self.id = np.zeros(1 << self.bits, np.uint64), np.full(1 << self.bits, -1, np.int32)
        self.probes = 1
        for h, (_, i, _) in zip(hashes.tolist(), pieces):
            at, tries = h >> (64 - self.bits), 1
            while self.id[at] >= 0:
                at, tries = (at + 1) & ((1 << self.bits) - 1), tries + 1
            self.key[at], self.id[at] = h, i
            self.probes = max(self.probes, tries)

    @staticmethod
    def _hash(s: str) -> int:
        h = np.zeros(1, np.uint64)
        for c in s:
            h = h * _MUL + np.uint64(ord(c) + 1)
        return int(mix(h)[0])

    def find(self, h: np.ndarray) -> np.ndarray:
        """Piece ids of hashed strings, -1 where there is none."""
        h = mix(h)
        at = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        out = np.where(self.key[at] == h, self.id[at], -1)
        for k in range(1, self.probes):
            todo = np.flatnonzero((out < 0) & (self.id[at] >= 0))
            if not len(todo):
                break
            at[todo] = (at[todo] + 1) & ((1 << self.bits) - 1)
            out[todo] = np.where(self.key[at[todo]] == h[todo], self.id[at[todo]], -1)
        return out


def _lattice(v: Vocabulary, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For rows of code points (0: none), the id and score of the piece of each length that ends at each place."""
    rows, n = c.shape
    ids = np.full((rows, n + 1, v.longest + 1), -1, np.int32)
    h = np.zeros((rows, n), np.uint64)
    for length in range(1, v.longest + 1):
        if length > n:
            break
        # h[:, s] hashes the `length` code points from s on.
        h = h[:, : n - length + 1] * _MUL + (c[:, length - 1 :] + 1).astype(np.uint64)
        live = (c[:, length - 1 :] > 0) & (c[:, : n - length + 1] > 0)
        got = np.full(live.shape, -1, np.int32)
        got[live] = v.find(h[live])
        ids[:, length:, length] = got
    scores = np.where(ids >= 0, v.scores[np.maximum(ids, 0)], NONE)
    # One code point that is no piece goes as bytes: id -2.
    alone = (ids[:, 1:, 1] < 0) & (c > 0)
    ids[:, 1:, 1][alone] = -2
    scores[:, 1:, 1][alone] = v.unknown
    return ids, scores


def _viterbi(scores: np.ndarray, best: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best score of a path to each place, the length of its last piece, and the place that it set out from.

    best: scores to set out with, NONE elsewhere; it is changed. On ties the longest last piece is taken, and before all
    what was there at first: that is a piece from further back.
    """
    lanes, n1, k1 = scores.shape
    back = np.zeros((lanes, n1), np.int8)
    origin = np.broadcast_to(np.arange(n1, dtype=np.int32), (lanes, n1)).copy()
    for t in range(1, n1):
        k = min(k1 - 1, t)
        cand = best[:, t - k : t] + scores[:, t, k:0:-1]
        pick = cand.argmax(1)
        got = cand[np.arange(lanes), pick]
        better = np.flatnonzero((got > best[:, t]) & (got > NONE // 2))
        step = (k - pick)[better]
        best[better, t], back[better, t], origin[better, t] = got[better], step, origin[better, t - step]
    return best, back, origin


def _from(lanes: int, n1: int, entry) -> np.ndarray:
    """Scores to set out with, from one place in each lane."""
    best = np.full((lanes, n1), NONE, np.int64)
    best[np.arange(lanes), entry] = 0
    return best


def _emit(v: Vocabulary, codes: np.ndarray, picked: np.ndarray, back: np.ndarray, start: int, end: int) -> list[int]:
    """Ids from one place to another; picked: the id of the last piece at each place."""
    out: list[int] = []
    while end > start:
        i = int(picked[end])
        if i >= 0:
            out.append(i)
        else:
            ch = int(codes[end - 1])
            ch = 0 if ch == NUL else ch
            raw = SPACE.encode() if ch == ord(LITERAL) else chr(ch).encode("utf-8", "surrogatepass")
            out += [v.bytes[b] for b in reversed(raw)]
        end -= int(back[end])
    return out[::-1]


def _points(s: str) -> np.ndarray:
    return np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)


def max_plus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Product of transfer matrices: the best way over any state between."""
    return np.maximum((a[:, :, None] + b[None, :, :]).max(1), NONE)


def scan_long(v: Vocabulary, unit: str, chunk: int = CHUNK) -> list[int]:
    """One long unit by chunks: transfer matrices, their scan, then every chunk traced back by itself.

    Chunks go in groups; of a group only the matrices are kept, and later a piece and its length for each place.
    """
    c, m = np.where(_points(unit) == 0, NUL, _points(unit)), v.longest
    n = len(c)
    chunk = max(chunk, m)  # no piece spans more than two chunks
    starts = np.arange(0, n, chunk)
    groups = [starts[g : g + max(1, 4096 // m)] for g in range(0, len(starts), max(1, 4096 // m))]

    def lattices(own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rows = np.zeros((len(own), chunk + m - 1), np.int64)
        for r, s in enumerate(own):
            part = c[s : s + chunk + m - 1]
            rows[r, : len(part)] = part
        ids, scores = _lattice(v, rows)
        # A piece belongs to the chunk in which it starts: none may start at or past the chunk's end.
        for t in range(chunk + 1, chunk + m):
            scores[:, t, : t - chunk + 1] = NONE
        return ids, scores

    mats = []
    for own in groups:
        _, scores = lattices(own)
        best, _, _ = _viterbi(np.repeat(scores, m, 0), _from(len(own) * m, scores.shape[1], np.tile(np.arange(m), len(own))))
        mats.append(best.reshape(len(own), m, -1)[:, :, chunk : chunk + m])
    mats = np.concatenate(mats)
    # Best scores from the front into each boundary state, by an associative scan (doubling).
    scan, step = [x for x in mats], 1
    while step < len(scan):
        scan = [x if i < step else max_plus(scan[i - step], x) for i, x in enumerate(scan)]
        step *= 2
    first = np.where(np.arange(m) == 0, 0, NONE)
    picked, backs, origins = [], [], []
    for g, own in enumerate(groups):
        ids, scores = lattices(own)
        best = np.full(scores.shape[:2], NONE, np.int64)
        at = g * len(groups[0])
        best[:, :m] = [scan[at + r - 1][0] if at + r else first for r in range(len(own))]
        _, back, origin = _viterbi(scores, best)
        picked.append(np.take_along_axis(ids, back[:, :, None].astype(np.int64), 2)[:, :, 0])
        backs.append(back)
        origins.append(origin)
    picked, backs, origins = (np.concatenate(x) for x in (picked, backs, origins))
    # Where each chunk is left and entered: one look for each; then all chunks are traced alone.
    end, path = n - int(starts[-1]), []
    for k in range(len(starts) - 1, -1, -1):
        into = int(origins[k, end])
        path.append((k, into, end))
        end = chunk + into
    return [i for k, into, end in reversed(path) for i in _emit(v, c[starts[k] : starts[k] + chunk + m], picked[k], backs[k], into, end)]


def solve(v: Vocabulary, units: list[str]) -> list[list[int]]:
    """Ids of each unit; units of like length share a lattice."""
    out: list[list[int]] = [[] for _ in units]
    order = sorted((i for i in range(len(units)) if 0 < len(units[i]) <= CHUNK), key=lambda i: len(units[i]))
    at = 0
    while at < len(order):
        lanes = max(64, 60_000 // (len(units[order[at]]) * (v.longest + 1)) * 4)
        own = order[at : at + lanes]
        at += len(own)
        width = len(units[own[-1]])
        flat = _points("".join(units[i].ljust(width, "\0") for i in own)).reshape(len(own), width)
        for r, i in enumerate(own):
            if "\0" in units[i]:  # a real NUL would read as padding
                own_part = flat[r, : len(units[i])]
                own_part[own_part == 0] = NUL
        ids, scores = _lattice(v, flat)
        _, back, _ = _viterbi(scores, _from(len(own), scores.shape[1], 0))
        ends = np.fromiter((len(units[i]) for i in own), np.int64, len(own))
        lane = np.arange(len(own))
        steps = []
        pos = ends.copy()
        while pos.any():  # all lanes step back together
            k = back[lane, pos].astype(np.int64)
            steps.append(np.where(pos > 0, ids[lane, pos, k], -1))
            pos = np.where(pos > 0, pos - k, 0)
        table = np.stack(steps[::-1], 1).tolist() if steps else []
        for r, i in enumerate(own):
            row = [x for x in table[r] if x != -1]
            out[i] = row if -2 not in row else _emit(v, flat[r], np.take_along_axis(ids[r], back[r][:, None].astype(np.int64), 1)[:, 0], back[r], 0, len(units[i]))
    for i, u in enumerate(units):
        if len(u) > CHUNK:
            out[i] = scan_long(v, u)
    return out


class Coder:
    """Encodes and decodes texts; keeps solved units."""

    def __init__(self, model_file: str):
        self.v = Vocabulary(model_file)
        self.table = IdTable(CACHE)
        self.piece_size = np.array([len(t) for t in self.v.text], np.int64)
        self.piece_at = np.cumsum(self.piece_size) - self.piece_size
        self.piece_bytes = np.frombuffer(b"".join(self.v.text), np.uint8)

    def encode_array(self, arr: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all texts, how many each has, and whether they decode to the text."""
        data, off = text_buffer(arr)
        lens = np.diff(off)
        full = lens > 0
        # A space before each text that is not empty is its dummy prefix; then every run of spaces begins a unit.
        begin = off[:-1] + np.cumsum(full) - full
        buf = np.full(len(data) + int(full.sum()), 32, np.uint8)
        inside = np.ones(len(buf), bool)
        inside[begin[full]] = False
        buf[inside] = data
        rows = len(lens)
        if not len(buf):
            return np.zeros(0, np.uint16), np.zeros(rows, np.int64), np.ones(rows, bool)
        first = buf == 10
        if not self.v.crosses:
            first |= buf == 32
            first[1:] &= (buf[:-1] != 32) | (buf[1:] == 10)
        first[1:] |= buf[:-1] == 10
        first[begin[full]] = True
        start = np.flatnonzero(first)
        ends = np.append(start[1:], len(buf))
        raw = buf.tobytes()

        def units(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            texts = [raw[a:b].decode("utf-8", "surrogatepass").replace(SPACE, LITERAL).replace(" ", SPACE) for a, b in zip(start[at].tolist(), ends[at].tolist())]
            solved = solve(self.v, texts)
            size = np.fromiter(map(len, solved), np.int64, len(solved))
            return np.fromiter((i for ids in solved for i in ids), np.int64, int(size.sum())), np.stack([np.cumsum(size) - size, size])

        ids, n = self.table.ids(run_hashes(buf, start), units)
        total = np.concatenate([[0], np.cumsum(n)])
        per_row = np.diff(total[np.searchsorted(start, np.append(begin, len(buf)))])
        back = self.decode_bytes(ids)
        if np.array_equal(back, buf):
            return ids, per_row, np.ones(rows, bool)
        cuts = np.concatenate([[0], np.cumsum(per_row)])
        texts = [raw[a + 1 : a + 1 + k].decode("utf-8", "surrogatepass") if k else "" for a, k in zip(begin.tolist(), lens.tolist())]
        return ids, per_row, np.array([self.decode(ids[a:b]) == t for a, b, t in zip(cuts, cuts[1:], texts)], bool)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        ids, n, _ = self.encode_array(pa.array(texts, pa.string()))
        return np.split(ids, np.cumsum(n)[:-1]) if texts else []

    def decode_bytes(self, ids: np.ndarray) -> np.ndarray:
        n = self.piece_size[ids]
        ends = np.cumsum(n)
        idx = np.repeat(self.piece_at[ids] - (ends - n), n)
        idx += np.arange(len(idx))
        return self.piece_bytes[idx]

    def decode(self, ids: np.ndarray) -> str:
        return self.decode_bytes(np.asarray(ids, np.int64)).tobytes()[1:].decode("utf-8", "surrogatepass")


_CODERS: dict[str, Coder] = {}


def coder(model_file: str) -> Coder:
    if model_file not in _CODERS:
        _CODERS[model_file] = Coder(model_file)
    return _CODERS[model_file]


def encode(df: DataFrame, model_file: str, text_col: str = "text", out: str = "pieces") -> DataFrame:
    """df with struct `out`: ids, and whether decoding them gave the text back."""

    bound_batches(df.sparkSession)

    def run(batches):
        c = coder(model_file)
        for arr in batches:
            parts, same = [], []
            for s in text_slices(pa.RecordBatch.from_arrays([arr], names=["t"])):
                ids, n, fine = c.encode_array(s.column(0))
                same += fine.tolist()
                parts.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(n)]), pa.int32()), pa.array(ids.astype(np.int32))))
            lists = pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.int32()))
            yield pa.StructArray.from_arrays([lists, pa.array(same, pa.bool_())], ["ids", "round_trip"])

    from collections.abc import Iterator

    run = tidy(run)
    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    udf = F.arrow_udf(run, "ids array<int>, round_trip boolean")
    return df.withColumn(out, F.when(F.col(text_col).isNotNull(), udf(F.col(text_col))))


def decode(df: DataFrame, model_file: str, ids_col: str = "ids", out: str = "text") -> DataFrame:
    def run(batches):
        c = coder(model_file)
        for arr in batches:
            yield pa.array([None if not x.is_valid else c.decode(np.asarray(x.values)) for x in arr], pa.string())

    from collections.abc import Iterator

    run = tidy(run)
    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return df.withColumn(out, F.arrow_udf(run, "string")(F.col(ids_col)))
