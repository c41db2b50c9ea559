"""Token-id files: an adaptive context-mixing range coder over ids, in independent, checksummed blocks.

Format. A segment is one binary record: magic and version; counts; the documents' ids and lengths; the order-0 table
(ids in use and their shares of 2^18); then for each block its words and the crc32 of its ids. Blocks start from the
same reset state and need only the segment's head. Segments are rows of a Parquet table (part, seq, before, n_ids,
segment), so writing is committed by Spark and a lost task is simply run again. Parts are ascending ranges of
document ids, in order inside.

Model. P(id) = a [id = p2] + b [id = p1] + (1 - a - b) P0(id). p2 and p1 are the ids last seen after the two ids, and
the id, before (hashed tables, the first with confidence); a and b adapt, per block, by that confidence; P0 is the
segment's table. One interval of 2^24 codes an id. A block is one lane; all lanes of a segment step together, so every
numpy operation handles up to LANES blocks.

Defined cases: a null text is empty and has its end id alone; null and repeated document ids are kept, ordered by
(id, text), nulls first; an empty table gives no files' rows; a damaged block raises ValueError; further columns are
ignored; texts are encoded whole.
"""

from __future__ import annotations

import json
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import IdTable, bound_batches, by_range, text_buffer, text_slices, word_hashes
from .ngram_lm import pack, unpack

MAGIC = b"CMRC\x01"
END_ID = 1
LANES, BLOCK_MIN, BLOCK_MAX = 2048, 512, 4096
#: A segment ends with the slice of documents that takes it here.
SEGMENT_IDS = 1 << 22
#: Pieces whose ids a worker keeps.
CACHE = 2_000_000

_ORDER0, _TOTAL, _SLOTS = 18, 24, 10
_LOW_P, _HIGH_P = 64, 57344  # of 2^16; then at least 2^18 of 2^24 is left to order 0
_MASK48 = (1 << 48) - 1


# ---------------------------------------------------------------- the model, one step of all lanes


class _State:
    def __init__(self, lanes: int):
        self.lane = np.arange(lanes, dtype=np.int64)
        self.base = self.lane << _SLOTS
        self.t1 = np.zeros(lanes << _SLOTS, np.int32)
        self.t2 = np.zeros(lanes << _SLOTS, np.int32)
        self.pa = np.full(lanes * 4, 4096, np.int32)
        self.pb = np.full(lanes * 4, 4096, np.int32)
        self.ctx0 = self.lane * 4
        self.x1 = np.zeros(lanes, np.int64)
        self.x2 = np.zeros(lanes, np.int64)

    def predict(self):
        h1 = self.x1 * 0x9E3B
        self.h1 = ((h1 >> 5) & ((1 << _SLOTS) - 1)) + self.base
        h2 = h1 * 0x2C1B
        h2 ^= self.x2 * 0x85EBCA6B
        h2 >>= 11
        h2 &= (1 << _SLOTS) - 1
        h2 += self.base
        self.h2 = h2
        self.q1, self.e2 = self.t1.take(self.h1), self.t2.take(h2)
        self.q2 = self.e2 & 0xFFFF
        self.ctx = (self.e2 >> 16) + self.ctx0
        self.a16, self.b16 = self.pa.take(self.ctx), self.pb.take(self.ctx)
        a = self.a16.astype(np.int64) << 8
        b = (((1 << _TOTAL) - a) >> 16) * self.b16
        b *= self.q1 != self.q2
        self.a, self.ab = a, a + b
        self.rest = (1 << _TOTAL) - self.ab

    def interval(self, lo: np.ndarray, hi: np.ndarray, hit2: np.ndarray, hit1: np.ndarray):
        """Start and size of the ids' intervals; lo and hi are fresh arrays of order-0 bounds."""
        lo *= self.rest
        hi *= self.rest
        lo >>= _ORDER0
        hi >>= _ORDER0
        hi -= lo
        lo += self.ab
        lo = np.where(hit1, self.a, lo)
        lo *= ~hit2
        hi = np.where(hit1, self.ab - self.a, hi)
        return lo, np.where(hit2, self.a, hi)

    def update(self, x: np.ndarray, hit2: np.ndarray, hit1: np.ndarray):
        """x: ids (int32); hit2, hit1: whether each prediction was right."""
        target = hit2 * np.int32(_HIGH_P - _LOW_P)
        target += _LOW_P
        target -= self.a16
        target >>= 5
        target += self.a16
        self.pa[self.ctx] = target
        target = hit1 * np.int32(_HIGH_P - _LOW_P)
        target += _LOW_P
        target -= self.b16
        target >>= 5
        target *= ~hit2
        target += self.b16
        self.pb[self.ctx] = target
        self.t1[self.h1] = x
        e = self.e2
        less = e - (1 << 16)
        more = np.minimum(e + (1 << 16), self.q2 | (3 << 16))
        self.t2[self.h2] = np.where(hit2, more, np.where(less >= 0, less, x))
        self.x2 = self.x1
        self.x1 = x.astype(np.int64)


def _order0(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids in use and their shares of 2^18, each at least 1."""
    count = np.bincount(ids)
    used = np.flatnonzero(count)
    n = count[used]
    share = 1 + (n * ((1 << _ORDER0) - len(used)) // n.sum())
    share[n.argmax()] += (1 << _ORDER0) - share.sum()
    return used, share


def _tables(used: np.ndarray, share: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    size = int(used.max()) + 1
    lo, hi = np.zeros(size, np.int64), np.zeros(size, np.int64)
    ends = np.cumsum(share)
    hi[used], lo[used] = ends, ends - share
    return lo, hi, np.repeat(used.astype(np.int32), share)


def _encode_lanes(x: np.ndarray, used: np.ndarray, share: np.ndarray) -> list[np.ndarray]:
    """The words of each lane; x has a row for each step."""
    steps, lanes = x.shape
    lo, hi, _ = _tables(used, share)
    s = _State(lanes)
    width = 2 * steps + 8
    out = np.zeros(lanes * width, np.uint32)
    pos = np.arange(lanes, dtype=np.int64) * width + 1  # a spare word takes no carry in fact
    first = pos - 1
    low, rng = np.zeros(lanes, np.int64), np.full(lanes, _MASK48, np.int64)
    for t in range(steps):
        v = x[t]
        s.predict()
        hit2, hit1 = v == s.q2, v == s.q1
        start, size = s.interval(lo.take(v), hi.take(v), hit2, hit1)
        r = rng >> _TOTAL
        start *= r
        low += start
        rng = np.multiply(r, size, out=r)
        if low.max() > _MASK48:
            over = np.flatnonzero(low > _MASK48)
            out[pos[over] - 1] += 1
            low[over] &= _MASK48
        # The word is written for all lanes; those that do not need it write it again later.
        out[pos] = low >> 32
        need = rng < 1 << 32
        pos += need
        shift = need * np.int64(16)
        low <<= shift
        low &= _MASK48
        rng <<= shift
        if rng.min() < 1 << 32:
            i = np.flatnonzero(rng < 1 << 32)
            out[pos[i]] = low[i] >> 32
            pos[i] += 1
            low[i] = (low[i] << 16) & _MASK48
            rng[i] <<= 16
        s.update(v, hit2, hit1)
    for k in (32, 16, 0):
        out[pos] = (low >> k) & 0xFFFF
        pos += 1
    grid = out.reshape(lanes, width)
    used_words = pos - first
    for k in range(int(used_words.max()) - 1, 0, -1):  # settle carries, last word first
        grid[:, k - 1] += grid[:, k] >> 16
        grid[:, k] &= 0xFFFF
    return [grid[j, 1 : used_words[j]].astype("<u2") for j in range(lanes)]


@np.errstate(divide="ignore", invalid="ignore")  # damaged words may lead anywhere; the checksum tells
def _decode_lanes(words: list[np.ndarray], steps: int, used: np.ndarray, share: np.ndarray) -> np.ndarray:
    lanes = len(words)
    lo, hi, inverse = _tables(used, share)
    s = _State(lanes)
    width = max(len(w) for w in words) + 4
    flat = np.zeros(lanes * width, np.int64)
    for j, w in enumerate(words):
        flat[j * width : j * width + len(w)] = w
    pos = np.arange(lanes, dtype=np.int64) * width
    d = (flat[pos] << 32) | (flat[pos + 1] << 16) | flat[pos + 2]
    pos += 3
    rng = np.full(lanes, _MASK48, np.int64)
    out = np.empty((steps, lanes), np.int32)
    for t in range(steps):
        s.predict()
        r = rng >> _TOTAL
        # Quotients of 48 by 24 bits and 42 by 24: exact in doubles.
        v = np.minimum((d / r).astype(np.int64), (1 << _TOTAL) - 1)
        hit2, below = v < s.a, v < s.ab
        v -= s.ab
        v += 1
        v <<= _ORDER0
        v -= 1
        c = (v / s.rest).astype(np.int64)
        x = np.where(below, s.q1, inverse.take(c, mode="clip"))
        x = np.where(hit2, s.q2, x)
        hit1 = x == s.q1
        start, size = s.interval(lo.take(x, mode="clip"), hi.take(x, mode="clip"), hit2, hit1)
        start *= r
        d -= start
        rng = np.multiply(r, size, out=r)
        need = rng < 1 << 32
        shift = need * np.int64(16)
        d <<= shift
        d |= flat.take(pos, mode="clip") * need
        pos += need
        rng <<= shift
        if rng.min() < 1 << 32:
            i = np.flatnonzero(rng < 1 << 32)
            d[i] = (d[i] << 16) | flat.take(pos[i], mode="clip")
            pos[i] += 1
            rng[i] <<= 16
        out[t] = x
        s.update(x, hit2, hit1)
    return out


# ---------------------------------------------------------------- segments


def write_segment(doc_ids: list, lengths: np.ndarray, ids: np.ndarray) -> bytes:
    """doc_ids may hold None; lengths sum to len(ids) > 0; ids are below 2^16."""
    n = len(ids)
    block = int(min(max(-(-n // LANES), BLOCK_MIN), max(BLOCK_MAX, -(-n // LANES))))
    lanes = -(-n // block)
    used, share = _order0(ids)
    x = np.full(lanes * block, used[share.argmax()], np.int32)
    x[:n] = ids
    words = _encode_lanes(np.ascontiguousarray(x.reshape(lanes, block).T), used, share)
    sums = np.array([zlib.crc32(ids[k * block : (k + 1) * block].astype("<u4").tobytes()) for k in range(lanes)], np.uint64)
    known = np.array([0 if i is None else i for i in doc_ids], np.int64)
    first = int(known.min(initial=0))
    head = zlib.compress(pack(np.array([n, block, abs(first)]), np.array([int(first < 0)]), np.array([i is None for i in doc_ids], np.uint8), (known - first).astype(np.uint64), lengths, used, share - 1, np.array([len(w) for w in words]), sums), 6)
    return MAGIC + len(head).to_bytes(4, "little") + head + b"".join(w.tobytes() for w in words)


def read_segment(raw: bytes) -> tuple[list, np.ndarray, np.ndarray]:
    """(document ids, lengths, ids) of a segment; ValueError if it or a block of it is damaged."""
    if raw[:5] != MAGIC:
        raise ValueError("not a token segment")
    size = int.from_bytes(raw[5:9], "little")
    try:
        counts, sign, null, known, lengths, used, share, n_words, sums = unpack(zlib.decompress(raw[9 : 9 + size]))
    except zlib.error as e:
        raise ValueError("damaged segment head") from e
    n, block, first = (int(v) for v in counts)
    first = -first if int(sign[0]) else first
    ends = 9 + size + 2 * np.cumsum(n_words.astype(np.int64))
    words = [np.frombuffer(raw, "<u2", int(k), int(e) - 2 * int(k)) for k, e in zip(n_words, ends)]
    ids = _decode_lanes(words, block, used.astype(np.int64), share.astype(np.int64) + 1).T.ravel()[:n]
    for k, want in enumerate(sums.tolist()):
        if zlib.crc32(ids[k * block : (k + 1) * block].astype("<u4").tobytes()) != want:
            raise ValueError(f"damaged block {k}")
    docs = [None if z else int(d) + first for d, z in zip(known.astype(np.int64), null)]
    return docs, lengths.astype(np.int64), ids


# ---------------------------------------------------------------- tokenizing


_ALNUM = np.zeros(256, bool)
_ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123)]] = True
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def in_pieces(spec: dict) -> bool:
    """Whether ids of a text are those of its pieces between white space: a BPE with word ends that folds case and space."""
    names = lambda x: {y.get("type") for y in (x or {}).get("normalizers") or (x or {}).get("pretokenizers") or [x or {}]}
    special = [t for t in spec.get("added_tokens") or [] if t.get("special") and t["content"].startswith("<") and not (t.get("lstrip") or t.get("rstrip"))]
    return spec["model"].get("type") == "BPE" and spec["model"].get("end_of_word_suffix") == "</w>" and names(spec.get("normalizer")) == {"NFC", "Replace", "Lowercase"} and "Split" in names(spec.get("pre_tokenizer")) and bool(special)


class Tokens:
    """Ids of whole texts by the tokenizers library, which solves each distinct piece between ASCII white space once.

    The tokenizer folds white space and case, splits at white space and between letters and other signs, and its
    Unicode composition never crosses white space; so a text's ids are those of its pieces in a row, and those of a
    word with a full stop or comma behind it are the word's and the sign's. Pieces are found and told apart by a hash
    of their bytes as they are (special tokens are matched before case is folded), a slice of texts at a time; solved
    ones stay in sorted arrays. `in_pieces` says whether a tokenizer is of this kind; any other encodes whole texts.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocabulary = self.tokenizer.get_vocab()
        if max(vocabulary.values()) >= 1 << 16:
            raise ValueError("ids of 2^16 and more do not fit the format")
        self.whole = not in_pieces(json.loads(self.tokenizer.to_str()))
        if self.whole:
            return
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.mark = next(t.content for t in self.tokenizer.get_added_tokens_decoder().values() if t.special and t.content.startswith("<"))
        self.mark_id = self.tokenizer.token_to_id(self.mark)
        self.table = IdTable(CACHE)

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.uint16)

    def _solve(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in a row, and how many each has."""
        size = np.zeros(len(words), np.int64)
        parts: dict[int, np.ndarray] = {}
        letters = [i for i, w in enumerate(words) if w.isalpha()]
        other = [i for i, w in enumerate(words) if not w.isalpha()]
        for k in range(0, len(letters), 2000):  # the last id of each word of letters ends a word
            own = letters[k : k + 2000]
            ids = self._ids(" ".join([words[i] for i in own]))
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) == len(own):
                size[own] = np.diff(ends, prepend=0)
                parts[k] = ids
            else:
                other += own
        order = [i for k in sorted(parts) for i in letters[k : k + 2000]]
        out = [parts[k] for k in sorted(parts)]
        plain = [i for i in other if "<" not in words[i]]
        for k in range(0, len(plain), 500):  # a special token between two texts keeps them apart and shows in the ids
            own = plain[k : k + 500]
            ids = self._ids(self.mark.join([words[i] for i in own]))
            cuts = np.flatnonzero(ids == self.mark_id)
            size[own] = np.diff(np.concatenate([[-1], cuts, [len(ids)]])) - 1
            out.append(np.delete(ids, cuts))
            order += own
        for i in other:
            if "<" in words[i]:
                out.append(self._ids(words[i]))
                size[i] = len(out[-1])
                order.append(i)
        flat = np.concatenate(out) if out else np.zeros(0, np.uint16)
        n = size[order]
        begin = np.zeros(len(words), np.int64)
        begin[order] = np.cumsum(n) - n
        return flat, np.stack([begin, size])

    def encode(self, arr: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """16-bit ids of all texts, each followed by END_ID, and how many each text has."""
        if self.whole:
            got = [np.array(self._ids(t or ""), np.uint16) for t in arr.to_pylist()]
            return np.concatenate([np.append(x, np.uint16(END_ID)) for x in got]) if got else np.zeros(0, np.uint16), np.array([len(x) + 1 for x in got], np.int64)
        data, off = text_buffer(arr)
        rows = len(off) - 1
        if not len(data):
            return np.full(rows, END_ID, np.uint16), np.ones(rows, np.int64)
        cut = np.zeros(len(data), bool)
        sign = (data == 46) | (data == 44)
        cut[1:] = sign[1:] & _ALNUM[data[:-1]]
        last = np.ones(len(data), bool)
        last[:-1] = _BLANK[data[1:]]
        last[off[1:][off[1:] > 0] - 1] = True
        h, row_at, start, end = word_hashes(data, off, True, cut & last, fold=False)
        raw = data.tobytes()

        def solve(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            return self._solve([raw[a:b].decode("utf-8", "surrogatepass") for a, b in zip(start[at].tolist(), end[at].tolist())])

        ids, n = self.table.ids(h, solve)
        per_row = np.diff(np.concatenate([[0], np.cumsum(n)])[row_at])
        out = np.full(len(ids) + rows, END_ID, np.uint16)
        keep = np.ones(len(out), bool)
        keep[np.cumsum(per_row + 1) - 1] = False
        out[keep] = ids
        return out, per_row + 1


_OPEN: dict[str, Tokens] = {}


def _tokens(path: str) -> Tokens:
    if path not in _OPEN:
        _OPEN[path] = Tokens(path)
    return _OPEN[path]


SEGMENTS = "part int, seq int, before long, n_ids long, segment binary"


def _writer(path: str):
    def run(batches) -> Iterator[pa.RecordBatch]:
        tokens = _tokens(path)
        docs: list = []
        ids: list[np.ndarray] = []
        lengths: list[np.ndarray] = []
        part, seq, before, size = 0, 0, 0, 0

        def flush():
            nonlocal docs, ids, lengths, size, seq, before
            raw = write_segment(docs, np.concatenate(lengths), np.concatenate(ids))
            row = pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([seq], pa.int32()), pa.array([before], pa.int64()), pa.array([size], pa.int64()), pa.array([raw], pa.binary())], names=["part", "seq", "before", "n_ids", "segment"])
            before, seq = before + size, seq + 1
            docs, ids, lengths, size = [], [], [], 0
            return row

        for b in batches:
            for s in text_slices(b, 1):
                part = s.column(2)[0].as_py()
                x, n = tokens.encode(s.column(1))
                docs += s.column(0).to_pylist()
                ids.append(x)
                lengths.append(n)
                size += len(x)
                if size >= SEGMENT_IDS:
                    yield flush()
        if docs:
            yield flush()

    return run


def write_files(spark: SparkSession, df: DataFrame, folder: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    bound_batches(spark)
    dealt, _ = by_range(spark, df.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")))
    ordered = dealt.sortWithinPartitions(F.asc_nulls_first("id"), "text").select("id", "text", "to")
    ordered.mapInArrow(_writer(tokenizer), SEGMENTS).write.parquet(folder)


def _reader(batches):
    for b in batches:
        for k in range(b.num_rows):
            docs, n, ids = read_segment(b.column("segment")[k].as_py())
            ends = np.cumsum(n)
            crc = [zlib.crc32(ids[e - m : e].astype("<u4").tobytes()) for m, e in zip(n.tolist(), ends.tolist())]
            part, before = b.column("part")[k].as_py(), b.column("before")[k].as_py()
            yield pa.RecordBatch.from_arrays([pa.array([part] * len(docs), pa.int32()), pa.array(docs, pa.int64()), pa.array(before + ends - n), pa.array(n), pa.array(crc, pa.int64())], names=["part", "doc_id", "start", "n_tokens", "ids_crc32"])


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, decoded from the files.

    Only the number of ids of each part reaches the driver.
    """
    files = spark.read.schema(SEGMENTS).parquet(folder)
    sizes = {r[0]: r[1] for r in files.groupBy("part").agg(F.sum("n_ids")).collect()}
    starts, total = {}, 0
    for p in sorted(sizes):
        starts[p], total = total, total + sizes[p]
    offsets = F.split(F.lit(",".join(str(starts.get(p, 0)) for p in range(max(sizes, default=0) + 1))), ",").cast("array<bigint>")
    rows = files.mapInArrow(_reader, "part int, doc_id long, start long, n_tokens long, ids_crc32 long")
    return rows.select("doc_id", (F.col("start") + F.get(offsets, F.col("part"))).alias("start"), "n_tokens", "ids_crc32")


def read_ids(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, ids) of each document, with its end id."""

    def run(batches):
        for b in batches:
            for raw in b.column("segment"):
                docs, n, ids = read_segment(raw.as_py())
                ends = np.concatenate([[0], np.cumsum(n)])
                yield pa.RecordBatch.from_arrays([pa.array(docs, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids, pa.int32()))], names=["doc_id", "ids"])

    return spark.read.schema(SEGMENTS).parquet(folder).mapInArrow(run, "doc_id long, ids array<int>")
