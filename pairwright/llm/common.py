"""Shared plumbing of the training-data operators: shared storage, Arrow batching, word hashing."""

from __future__ import annotations

import functools
import hashlib
import re
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text handled at once by a numpy kernel; one longer text is a slice of its own.
SLICE_BYTES = 2 << 20


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches of texts stay near 8 MB, in the JVM and in Python, unless the session asks for a size of its own."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) in (None, "67108864b", "67108864", "64m"):
        spark.conf.set(key, "8m")


def give_back() -> None:
    """Freed memory goes back to the system: workers are used again, and would keep what their largest task held."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


def tidy(run):
    """A function over record batches that gives memory back after the last one."""

    def out(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession, label: str) -> str:
    """A fresh folder of this application below spark.checkpoint.dir, which driver and executors share.

    Only a local session (tests, notebooks) may go without that setting. What an application has stored lies below
    `pairwright/<application id>` there and may be removed once its results have been written (`clean`).
    """
    return f"{_application_folder(spark)}/{label}-{uuid.uuid4().hex}"


def _application_folder(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file:///tmp/checkpoints"
    path = spark._jvm.org.apache.hadoop.fs.Path(base)  # a folder named without its store is in the default one
    base = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    return f"{base.rstrip('/')}/pairwright/{spark.sparkContext.applicationId}"


def clean(spark: SparkSession) -> None:
    """Removes all that this application has stored."""
    discard(spark, _application_folder(spark))


def stored(spark: SparkSession, df: DataFrame, label: str) -> DataFrame:
    """Cuts lineage: writes df to the shared folder and reads it back."""
    path = shared_folder(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(spark: SparkSession, *paths) -> None:
    """Removes folders (or what `stored` returned) that no later read needs."""
    for p in paths:
        p = getattr(p, "_stored_at", p)
        hp = spark._jvm.org.apache.hadoop.fs.Path(p)
        hp.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hp, True)


def releases_shuffles(run):
    """run(spark, ...) with the shuffle files of each query removed as it ends.

    Else they stay until the driver's JVM happens to collect its garbage, so disk use depends on chance. A Spark that
    does not know the setting leaves them.
    """
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

    @functools.wraps(run)
    def out(spark: SparkSession, *args, **kwargs):
        was = spark.conf.get(key, None)
        spark.conf.set(key, "true")
        try:
            return run(spark, *args, **kwargs)
        finally:
            spark.conf.unset(key) if was is None else spark.conf.set(key, was)

    return out


def driver_gives_back(spark: SparkSession) -> None:
    """The driver's JVM collects what the plans of many small jobs have left; it would rather grow to its limit."""
    spark._jvm.System.gc()


def fold_of(col, modulus: int):
    """crc32 of an id as text, modulo; a null id counts as the empty text."""
    return F.crc32(F.coalesce(col.cast("string"), F.lit(""))) % modulus


# ---------------------------------------------------------------- Arrow text slices


def text_slices(batch, column: int = 0, limit: int = SLICE_BYTES):
    """Cuts an Arrow record batch into runs of rows of about `limit` text bytes each."""
    import pyarrow as pa
    import pyarrow.compute as pc

    if not batch.num_rows:
        return
    n = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0)).astype(np.int64)
    ends = np.cumsum(n)
    start = 0
    while start < batch.num_rows:
        done = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, done + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def text_buffer(arr) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets of an Arrow string array; nulls are empty texts."""
    import pyarrow as pa
    import pyarrow.compute as pc

    if arr.null_count:
        arr = pc.fill_null(arr, "")
    wide = pa.types.is_large_string(arr.type) or pa.types.is_large_binary(arr.type)
    off = np.frombuffer(arr.buffers()[1], dtype=np.int64 if wide else np.int32)[arr.offset : arr.offset + len(arr) + 1].astype(np.int64)
    data = np.frombuffer(arr.buffers()[2], dtype=np.uint8) if arr.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


# ---------------------------------------------------------------- hashing

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply), a bijection."""
    x = x ^ (x >> np.uint64(30))
    x = x * _M1
    x ^= x >> np.uint64(27)
    x *= _M2
    x ^= x >> np.uint64(31)
    return x


_P = 0x9E3779B97F4A7C15 | 1
_P_INV = pow(_P, -1, 1 << 64)
_LUT = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD_LUT = _LUT[_LOWER]
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_POW: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POW.get("p", ())) < n:
        m = max(n, 1 << 16)
        for k, base in (("p", _P), ("q", _P_INV)):
            out = np.ones(1, np.uint64)
            step = base
            while len(out) < m:  # doubling: p^0..p^(k-1), then times p^k
                out = np.concatenate([out, out * np.uint64(pow(base, len(out), 1 << 64))])
            _POW[k] = out[:m]
    return _POW["p"], _POW["q"]


def word_hashes(data: np.ndarray, off: np.ndarray, with_starts: bool = False, cut: np.ndarray | None = None, fold: bool = True) -> tuple[np.ndarray, ...]:
    """64-bit hashes of all words `[^\\x20\\x09-\\x0D]+`, A-Z lower-cased if `fold`, and each row's first index.

    `cut` marks bytes that begin a word of their own as well. Returns (hashes, row offsets into hashes[, first byte
    of each word, byte after its last]). One pass of prefix sums of a polynomial; no Python per word.
    """
    n = len(data)
    if n == 0:
        empty = np.zeros(0, np.uint64), np.zeros(len(off), np.int64)
        return (*empty, np.zeros(0, np.int64), np.zeros(0, np.int64)) if with_starts else empty
    word = ~_SPACE[data]
    first = word.copy()
    first[1:] &= ~word[:-1]
    rows = off[:-1][off[:-1] < off[1:]]
    first[rows] = word[rows]
    if cut is not None:
        first |= cut & word
    starts = np.flatnonzero(first)
    last = word.copy()
    last[:-1] &= ~word[1:] | first[1:]
    ends = np.flatnonzero(last)
    p, q = _powers(n + 1)
    h = (_WORD_LUT if fold else _LUT)[data]
    h *= p[:n]
    np.cumsum(h, out=h)
    tok = h[ends]
    inner = starts > 0
    tok[inner] -= h[starts[inner] - 1]
    tok *= q[starts]
    tok += (ends - starts).astype(np.uint64)
    out = mix(tok), np.searchsorted(starts, off)
    return (*out, starts, ends + 1) if with_starts else out


def run_hashes(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """64-bit hashes of the runs of bytes that begin at `starts` and cover `data` from the first of them on."""
    p, q = _powers(len(data) + 1)
    h = _LUT[data]
    h *= p[: len(data)]
    np.cumsum(h, out=h)
    ends = np.append(starts[1:], len(data))
    tok = h[ends - 1]
    inner = starts > 0
    tok[inner] -= h[starts[inner] - 1]
    tok *= q[starts]
    tok += (ends - starts).astype(np.uint64)
    return mix(tok)


class IdTable:
    """Ids of solved strings by hash, in sorted arrays: some 30 bytes a string, however many workers keep."""

    def __init__(self, most: int, kind=np.uint16):
        self.most, self.kind = most, kind
        self.forget()

    def forget(self) -> None:
        self.key, self.at, self.size = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.pool = np.zeros(0, self.kind)

    def ids(self, hashes: np.ndarray, solve) -> tuple[np.ndarray, np.ndarray]:
        """All ids in the order of `hashes`, and how many each has; `solve(places)` gives ids and (begin, size) of new ones."""
        u, first, inv = np.unique(hashes, return_index=True, return_inverse=True)
        at = np.searchsorted(self.key, u)
        new = np.ones(len(u), bool)
        inside = at < len(self.key)
        new[inside] = self.key[at[inside]] != u[inside]
        if len(self.key) + new.sum() > self.most and len(self.key):
            self.forget()
            new[:] = True
        if new.any():
            flat, where = solve(first[new])
            key = np.concatenate([self.key, u[new]])
            order = np.argsort(key, kind="stable")
            self.key = key[order]
            self.at = np.concatenate([self.at, where[0] + len(self.pool)])[order]
            self.size = np.concatenate([self.size, where[1]])[order]
            self.pool = np.concatenate([self.pool, flat.astype(self.kind)])
            at = np.searchsorted(self.key, u)
        n = self.size[at][inv]
        ends = np.cumsum(n)
        idx = np.repeat(self.at[at][inv] - (ends - n), n)
        idx += np.arange(len(idx))
        return self.pool[idx], n


def sorted_counts(values: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values in order and their (weighted) counts."""
    if not len(values):
        return values, np.zeros(0, np.int64)
    if weights is None:
        values = np.sort(values)
        at = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
        return values[at], np.diff(np.append(at, len(values)))
    order = np.argsort(values, kind="stable")
    values, weights = values[order], weights[order]
    at = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
    return values[at], np.add.reduceat(weights, at)


def digest64(data: bytes) -> int:
    """A signed 64-bit digest."""
    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little", signed=True)


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer file lies; the same place on every machine of the cluster."""
    import public_tokenizers

    return public_tokenizers.path(name)


def by_range(spark: SparkSession, df: DataFrame, column: str = "id") -> tuple[DataFrame, int]:
    """Deals df into ascending ranges of a long column, one partition each; adds `to`, the range's number.

    Bounds are quantiles over all rows; nulls go first. One shuffle; only the bounds reach the driver.
    """
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    out, n = range_numbers(df, column, parts)
    return out.repartitionById(n, F.col("to")), n


def range_numbers(df: DataFrame, column: str, parts: int) -> tuple[DataFrame, int]:
    q = df.agg(F.percentile_approx(column, [i / parts for i in range(1, parts)], 100 * parts).alias("q")).first()["q"] if parts > 1 else []
    bounds = sorted(set(q or []))
    literal = F.split(F.lit(",".join(map(str, bounds))), ",").cast("array<bigint>") if bounds else F.array().cast("array<bigint>")
    bucket = F.coalesce(F.size(F.filter(literal, lambda b: b <= F.col(column))), F.lit(0))
    return df.withColumn("to", F.when(F.col(column).isNull(), 0).otherwise(bucket)), len(bounds) + 1
