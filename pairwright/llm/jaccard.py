"""Exact n-gram Jaccard join by prefix trees, with the classes of linked documents.

A document's set is its distinct SHINGLE-word shingles (64-bit hashes; A-Z lower-cased, words as in `common`). Two
documents link when 100 |A n B| >= 80 |A u B|. Equal sets are one class from the start, so copies cost one row each.

All sets follow one global order of shingles: by frequency level (a table of counters over all documents, of a size
set by their number, turned into base-2 levels), then by hash. What follows from it:

1. Prefix filter. Sets that link share a shingle among the first n - ceil(0.8 n) + 1, rare first. Only these are
   dealt out, packed by hash of the shingle; classes that share one make a run.
2. Runs give candidate pairs that pass the length bound and the bound by what is left of both sets. Short runs give
   all pairs. Long ones (a large group of near copies, say) first give a chain and a hub, whose links make
   components; later rounds ask only for pairs between different components whose parity sketches do not rule a link
   out, the closest at first, then all that are left. So no link between components is missed, and pairs inside one
   are not spelled out. A run of more than RUN_BLOCK classes is dealt out as pairs of blocks, so no task takes it whole.
3. Parity sketches rule pairs out that cannot link. The others are verified by prefix trees. A class is joined with a
   batch of its candidates, stored as sorted sequences, common shingles first; runs of equal prefixes are the tree's
   branches. The walk keeps the overlap of each shared prefix, leaves a sequence when the overlap so far and what
   remains cannot reach what is required, and a whole subtree when no sequence of any length below can.
4. Links become components: stars of what each task holds, then large-star/small-star rounds in Spark.
5. Every link has both ends in one component. Components are dealt out as blocks of classes, each two blocks once, and
   all their overlaps are counted exactly. So every class and document gets its true number of links, also where the
   rounds of step 2 had no need of a pair.

Only bounded things reach the driver: the level table, a bitmap, counts. Lineage is cut by tables in the shared folder.

Shingles and sets are told apart by 64-bit hashes: results are exact but for collisions, whose chance is the square of
the number of different ones over 2^65 (one in 40,000 for 10^7 sets).

Defined cases: null or wordless texts have the empty set and link with nothing; under SHINGLE words the whole sequence
is the one shingle; repeated rows are equal sets; null ids take part as nulls (a class of nulls only has a null id);
empty tables give no rows; texts of any length are shingled whole; further columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bound_batches, discard, driver_gives_back, mix, releases_shuffles, sorted_counts, stored, text_buffer, text_slices, tidy, word_hashes
from .ngram_lm import pack, unpack

SHINGLE = 5
#: Runs up to this many classes give all their pairs at once.
SHORT_RUN = 8
#: Closest partners that a class outside a run's largest component gets in the round before the full one.
SOME = 2
#: Candidates of one class that are verified in one batch.
BATCH = 256
#: Classes of a run that one task compares with as many others; longer runs are dealt out as pairs of such blocks.
RUN_BLOCK = 1024
#: Classes, and shingles, of a component that make up about one block when links are counted.
BLOCK_CLASSES, BLOCK_SHINGLES = 1024, 1_000_000
#: Links that one task turns into stars before the rounds.
LINK_ROWS = 1_000_000
#: Prefix rows that a task holds before it packs and sends them.
RUN_ROWS = 1_000_000
_BITMAP_BITS = 24
_C = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


# ---------------------------------------------------------------- sets


def shingle_sets(arr: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all texts, row after row and in order; each row's first; each row's class."""
    h, off = word_hashes(*text_buffer(arr))
    n = np.diff(off)
    k = np.maximum(n - SHINGLE + 1, np.minimum(n, 1))
    row = np.repeat(np.arange(len(n)), k)
    i = np.arange(len(row)) - np.repeat(np.cumsum(k) - k, k) + np.repeat(off[:-1], k)
    h, end, s = np.append(h, np.zeros(SHINGLE, np.uint64)), off[1:][row], np.zeros(len(i), np.uint64)
    for j in range(SHINGLE):
        s += np.where(i + j < end, h[i + j], np.uint64(0)) * _C[j % len(_C)] + np.uint64(j) * (i + j < end)
    s = mix(s)
    order = np.lexsort((s, row))
    s, row = s[order], row[order]
    keep = np.ones(len(s), bool)
    keep[1:] = (s[1:] != s[:-1]) | (row[1:] != row[:-1])
    s, row = s[keep], row[keep]
    at = np.searchsorted(row, np.arange(len(n) + 1))
    return s, at, class_ids(s, at)


def class_ids(s: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A 64-bit name of each set: sums do not depend on order, and the size is part of it."""
    out = np.zeros(len(at) - 1, np.uint64)
    full = np.flatnonzero(np.diff(at))
    if len(full):
        out[full] = mix(np.add.reduceat(mix(s ^ _C[0]), at[full]) ^ mix(np.add.reduceat(mix(s ^ _C[1]), at[full])) + np.diff(at)[full].astype(np.uint64) * _C[2])
    return out.view(np.int64)


def prefix_size(n: np.ndarray) -> np.ndarray:
    return n - (4 * n + 4) // 5 + 1


def may_link(n1, n2, p1=None, p2=None):
    """Length bound, and the bound by what is left behind the shared shingle."""
    ok = 5 * np.minimum(n1, n2) >= 4 * np.maximum(n1, n2)
    return ok if p1 is None else ok & (np.minimum(n1 - p1, n2 - p2) >= -(-4 * (n1 + n2) // 9))


def linked(n1, n2, both) -> bool:
    return 100 * both >= 80 * (n1 + n2 - both)


def _cells(s: np.ndarray, bits: int) -> np.ndarray:
    return (s >> np.uint64(64 - bits)).astype(np.int64)


# ---------------------------------------------------------------- pass 1: classes and levels


def _describe(bits: int, part_bits: int = 16):
    import zstandard

    def run(batches):
        seen = np.zeros(1 << bits, np.uint16)
        names = ["kind", "doc_id", "n", "cls", "blob"]
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
        for b in batches:
            for t in text_slices(b, 1):
                s, at, cls = shingle_sets(t.column(1))
                at_cell, n_cell = sorted_counts(_cells(s, bits))
                seen[at_cell] = np.minimum(seen[at_cell] + n_cell, 0xFFFF)
                m = len(cls)
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(m), kinds[0]), t.column(0), pa.array(np.diff(at)), pa.array(cls), pa.nulls(m, kinds[4])], names=names)
        rows = []
        for k in range(max(1, (1 << bits) >> part_bits)):
            part = seen[k << part_bits : (k + 1) << part_bits]
            if part.any():
                rows.append((k, zstandard.compress(pack(part), 1)))
        m = len(rows)
        yield pa.RecordBatch.from_arrays([pa.array(np.ones(m), kinds[0]), pa.array([r[0] for r in rows], kinds[1]), pa.nulls(m, kinds[2]), pa.nulls(m, kinds[3]), pa.array([r[1] for r in rows], kinds[4])], names=names)

    return run


def _add_up(key, table):
    import zstandard

    total = reduce(np.add, (unpack(zstandard.decompress(x.as_py()))[0].astype(np.int64) for x in table["blob"]))
    level = np.log2(np.maximum(total, 1)).astype(np.uint8) + (total > 0)
    return pa.table({"part": pa.array([key[0].as_py()], pa.int64()), "blob": pa.array([level.astype(np.uint8).tobytes()], pa.binary())})


def levels_of(parts: list, bits: int, part_bits: int = 16) -> np.ndarray:
    out = np.zeros(1 << bits, np.uint8)
    for r in parts:
        out[r["part"] << part_bits : (r["part"] << part_bits) + len(r["blob"])] = np.frombuffer(r["blob"], np.uint8)
    return out


# ---------------------------------------------------------------- pass 2: prefixes to runs and candidate pairs


def _prefixes(levels, bits: int, parts: int):
    def run(batches):
        lv = levels.value
        held: list[tuple] = []
        size = 0

        def flush():
            cls = np.concatenate([x[0] for x in held])
            n = np.concatenate([x[1] for x in held])
            base = np.cumsum([0] + [len(x[0]) for x in held])
            doc = np.concatenate([x[2] + np.int32(b) for x, b in zip(held, base)])
            key, pos = (np.concatenate([x[i] for x in held]) for i in (3, 4))
            held.clear()
            _, first = np.unique(cls, return_index=True)
            keep = np.zeros(len(cls), bool)
            keep[first] = True
            keep = keep[doc]
            doc, key, pos = doc[keep], key[keep], pos[keep]
            part = (mix(key) % np.uint64(parts)).astype(np.int32)
            order = np.argsort(part, kind="stable")
            part, doc, key, pos = part[order], doc[order], key[order], pos[order]
            cuts = np.searchsorted(part, np.arange(parts + 1))
            rows = []
            for p in np.flatnonzero(np.diff(cuts)):
                a, b = cuts[p], cuts[p + 1]
                own, idx = np.unique(doc[a:b], return_inverse=True)
                rows.append((int(p), pack(key[a:b], idx, pos[a:b], cls[own].view(np.uint64), n[own])))
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], names=["part", "blob"])

        for b in batches:
            for t in text_slices(b):
                s, at, cls = shingle_sets(t.column(0))
                n = np.diff(at)
                row = np.repeat(np.arange(len(n)), n)
                level = lv[_cells(s, bits)]
                order = np.lexsort((s, level, row))
                pos = np.arange(len(s)) - at[:-1][row]
                # Level 1 means that no other document has the shingle.
                use = (pos < prefix_size(n)[row]) & (level[order] > 1)
                held.append((cls, n.astype(np.int32), row[use].astype(np.int32), s[order[use]], pos[use].astype(np.int32)))
                del s, level, order, pos, row
                size += int(use.sum())
                if size >= RUN_ROWS:
                    yield flush()
                    held, size = [], 0
        if size:
            yield flush()

    return run


CANDIDATES = "kind int, key long, a long, b long, n long, pos long"


def _candidate_table(kind: int, **cols) -> pa.Table:
    m = len(next(iter(cols.values())))
    return pa.table({c: pa.array(np.full(m, kind), pa.int32()) if c == "kind" else pa.array(cols[c], pa.int64()) if c in cols else pa.nulls(m, pa.int64()) for c in ("kind", "key", "a", "b", "n", "pos")})


def _distinct_pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(a):
        return a, b
    lo, hi = np.minimum(a, b), np.maximum(a, b)
    order = np.lexsort((hi, lo))
    lo, hi = lo[order], hi[order]
    keep = np.ones(len(lo), bool)
    keep[1:] = (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1])
    return lo[keep], hi[keep]


def _runs(key, table):
    """Candidate pairs of a part's runs (kind 0), and the rows of its long runs (kind 1)."""
    cols: list[list] = [[], [], [], []]
    for raw in table["blob"]:
        k, idx, pos, cls, n = unpack(raw.as_buffer())
        for c, x in zip(cols, (k.astype(np.uint64), cls[idx].astype(np.uint64).view(np.int64), n[idx].astype(np.int64), pos.astype(np.int64))):
            c.append(x)
    k, cls, n, pos = (np.concatenate(c) for c in cols)
    del cols
    order = np.lexsort((cls, n, k))
    k, cls, n, pos = k[order], cls[order], n[order], pos[order]
    keep = np.ones(len(k), bool)
    keep[1:] = (k[1:] != k[:-1]) | (cls[1:] != cls[:-1])
    k, cls, n, pos = k[keep], cls[keep], n[keep], pos[keep]
    edge = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1], [True]]))
    size = np.repeat(np.diff(edge), np.diff(edge))
    first = np.repeat(edge[:-1], np.diff(edge))
    left = first + size - np.arange(len(k))
    pairs = []
    for d in range(1, SHORT_RUN):  # pairs d apart, of all short runs; neighbours by size, of long ones
        i = np.flatnonzero((left > d) & ((size <= SHORT_RUN) | (d == 1)) & (size > 1))
        i = i[may_link(n[i], n[i + d], pos[i], pos[i + d])]
        pairs.append((cls[i], cls[i + d]))
    long = size > SHORT_RUN
    if long.any():
        # A hub for each long run: the member that comes first in one fixed shuffle of all classes.
        o = np.lexsort((mix(cls.view(np.uint64)), k))
        hub = np.repeat(o[edge[:-1]], np.diff(edge))
        i = np.flatnonzero(long & (hub != np.arange(len(k))))
        i = i[may_link(n[i], n[hub[i]], pos[i], pos[hub[i]])]
        pairs.append((cls[i], cls[hub[i]]))
    a, b = _distinct_pairs(*(np.concatenate([p[i] for p in pairs]) for i in range(2)))
    return pa.concat_tables([_candidate_table(0, a=a, b=b), _candidate_table(1, key=k[long].view(np.int64), a=cls[long], n=n[long], pos=pos[long])])


def parity_sketch(own: np.ndarray) -> bytes:
    """One bit per cell: whether an odd number of the set's shingles fall there; about four cells a shingle.

    Sketches of two sets differ in at most as many bits as the sets differ in shingles, and a sketch folds to half
    its size by xor of its halves. So a count of differing bits rules pairs out, and never one that links.
    """
    m = 1 << int(min(20, max(9, np.ceil(np.log2(4 * len(own))))))
    return np.packbits(np.bincount((own & np.uint64(m - 1)).astype(np.int64), minlength=m).astype(np.uint8) & 1, bitorder="little").tobytes()


def _differing_bits(sketches: list[np.ndarray], outside: np.ndarray):
    """(rows of outside, members, differing bits) blocks, so that each pair of a row and a member shows once.

    Sizes more than a factor of two apart are left out: such sets cannot link.
    """
    words = np.array([len(x) for x in sketches])
    for w in np.unique(words):
        members = np.flatnonzero((words == w) | (words == 2 * w))
        m = np.stack([sketches[j] if words[j] == w else sketches[j][:w] ^ sketches[j][w:] for j in members])
        place = {int(j): k for k, j in enumerate(members)}
        rows = [r for r, i in enumerate(outside.tolist()) if words[i] in (w, 2 * w)]
        step = max(1, (1 << 21) // (len(members) * int(w)))
        for s in range(0, len(rows), step):
            r = np.array(rows[s : s + step])
            own = m[[place[int(i)] for i in outside[r]]]
            bits = np.bitwise_count(own[:, None] ^ m[None]).sum(2, dtype=np.int64)
            smaller = np.minimum(words[outside[r]][:, None], words[members][None]) == w
            yield r, members, np.where(smaller, bits, np.int64(1) << 40)


def _crossing(full: bool):
    """Pairs of long runs, or of two blocks of one, whose components differ and that may link: SOME closest a class, or all."""

    def run(key, table):
        k, cls, comp, n, pos, bi, bj, part = (table[c].to_numpy() for c in ("key", "a", "comp", "n", "pos", "i", "j", "part"))
        sketch = table["sketch"].combine_chunks() if table["sketch"].num_chunks != 1 else table["sketch"].chunk(0)
        order = np.lexsort((cls, bj, bi, k))
        k, cls, comp, n, pos, bi, bj, part = (x[order] for x in (k, cls, comp, n, pos, bi, bj, part))
        edge = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]) | (bi[1:] != bi[:-1]) | (bj[1:] != bj[:-1]), [True]]))
        out: list[tuple] = [(np.zeros(0, np.int64),) * 2]
        for lo, hi in zip(edge[:-1], edge[1:]):
            names, inv, count = np.unique(comp[lo:hi], return_inverse=True, return_counts=True)
            if len(names) < 2:
                continue
            top = int(count.argmax())
            outside = np.flatnonzero(inv != top)
            side, two = part[lo:hi], bi[lo] != bj[lo]  # two blocks: only pairs across them
            sketches = [np.frombuffer(sketch[int(i)].as_buffer(), np.uint64) for i in order[lo:hi]]
            for r, members, bits in _differing_bits(sketches, outside):
                i, j = outside[r][:, None], members[None]
                n1, n2 = n[lo + i], n[lo + j]
                ok = (inv[i] != inv[j]) & ((inv[j] == top) | (j > i)) & may_link(n1, n2, pos[lo + i], pos[lo + j])
                ok &= bits <= n1 + n2 - 2 * -(-4 * (n1 + n2) // 9)
                if two:
                    ok &= side[i] != side[j]
                if not full and ok.shape[1] > SOME:
                    rank = np.where(ok, bits, np.int64(1) << 40) * 4096 + (mix(cls[lo + i].view(np.uint64) ^ cls[lo + j].view(np.uint64) * _C[3]) >> np.uint64(52)).astype(np.int64)
                    ok &= rank <= np.partition(rank, SOME - 1, 1)[:, SOME - 1 : SOME]
                x, y = np.nonzero(ok)
                out.append(_distinct_pairs(cls[lo + outside[r][x]], cls[lo + members[y]]))
            if len(out) > 256:
                out = [_distinct_pairs(*(np.concatenate([p[x] for p in out]) for x in range(2)))]
        a, b = _distinct_pairs(*(np.concatenate([p[x] for p in out]) for x in range(2)))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


# ---------------------------------------------------------------- pass 3: sets of classes that are in a pair


def _wanted_sets(levels, bits: int, bitmap: np.ndarray):
    """(class, set in tree order: common first) of the documents that stand for a wanted class."""

    def run(batches):
        lv = levels.value
        for b in batches:
            for t in text_slices(b, 1):
                s, at, cls = shingle_sets(t.column(1))
                ids = t.column(0).fill_null(-1).to_numpy(zero_copy_only=False)
                bit = (cls ^ ids) & ((1 << _BITMAP_BITS) - 1)
                rows = np.flatnonzero((bitmap[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 & (np.diff(at) > 0))
                sets, sketches = [], []
                for r in rows.tolist():
                    own = s[at[r] : at[r + 1]]
                    sets.append(own[np.lexsort((own, ~lv[_cells(own, bits)]))].tobytes())
                    sketches.append(parity_sketch(own))
                yield pa.RecordBatch.from_arrays([pa.array(cls[rows]), pa.array(np.diff(at)[rows]), pa.array(sets, pa.binary()), pa.array(sketches, pa.binary())], names=["cls", "size", "seq", "sketch"])

    return run


# ---------------------------------------------------------------- verification by prefix trees


def tree_join(x: np.ndarray, others: list[np.ndarray]) -> list[bool]:
    """Which of `others` link with x; all are distinct hashes in one global order.

    Sorted as sequences, sets that share a prefix stand side by side: that order is the tree, depth first. seen[d] is
    the overlap of x with the first d shingles of the branch; only the part of the branch that is new is looked up. A
    linked set has no more than a quarter of |x| shingles that x lacks: where a branch has more, whatever its length
    may still be, the subtree below is left and all that share the prefix go unread.
    """
    out = [False] * len(others)
    if not others:
        return out
    sorted_x = np.sort(x)
    order = sorted(range(len(others)), key=lambda i: others[i].astype(">u8").tobytes())
    prev, seen, dead = np.zeros(0, np.uint64), np.zeros(1, np.int64), 1 << 62
    for i in order:
        y = others[i]
        m = min(len(prev), len(y))
        diff = np.flatnonzero(prev[:m] != y[:m])
        depth = int(diff[0]) if len(diff) else m
        if depth >= dead or not may_link(len(x), len(y)):
            continue
        need = -(-4 * (len(x) + len(y)) // 9)
        depth = min(depth, len(seen) - 1)
        counts, d = [seen[: depth + 1]], depth
        alive = True
        while d < len(y):
            o = int(counts[-1][-1])
            if o + min(len(y) - d, len(x) - o) < need:
                alive = False  # what remains cannot reach it, here or below
                break
            step = y[d : d + 128]
            at = np.minimum(np.searchsorted(sorted_x, step), len(sorted_x) - 1)
            counts.append(o + np.cumsum(sorted_x[at] == step))
            d += len(step)
        seen, prev = np.concatenate(counts), y
        lost = np.flatnonzero(4 * (np.arange(len(seen)) - seen) > len(x))
        dead = int(lost[0]) if len(lost) else 1 << 62
        if alive:
            out[i] = linked(len(x), len(y), int(seen[-1]))
    return out


def _verify(key, table):
    """Rows (a, b, seq of b), where a = b brings a's own set; returns the pairs that link."""
    a, b = table["a"].to_numpy(), table["b"].to_numpy()
    seqs = table["seq"].combine_chunks() if table["seq"].num_chunks != 1 else table["seq"].chunk(0)
    order = np.lexsort((b, a))
    got_a, got_b = [], []
    edge = np.flatnonzero(np.concatenate([[True], a[order][1:] != a[order][:-1], [True]]))
    for lo, hi in zip(edge[:-1], edge[1:]):
        own: dict[int, np.ndarray] = {}
        for i in order[lo:hi].tolist():
            own.setdefault(int(b[i]), np.frombuffer(seqs[i].as_buffer(), np.uint64))
        name = int(a[order[lo]])
        x = own.pop(name)
        names = list(own)
        for y, yes in zip(names, tree_join(x, list(own.values()))):
            if yes:
                got_a.append(name)
                got_b.append(y)
    return pa.table({"a": pa.array(got_a, pa.int64()), "b": pa.array(got_b, pa.int64())})


def _open_pairs(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """Whether the sketches of two sets leave room for a link."""
    for sizes_a, sizes_b, sketches_a, sketches_b in batches:
        out = []
        for n1, n2, x, y in zip(sizes_a.to_pylist(), sizes_b.to_pylist(), sketches_a, sketches_b):
            x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
            while len(x) != len(y):
                x, y = (x[: len(x) // 2] ^ x[len(x) // 2 :], y) if len(x) > len(y) else (x, y[: len(y) // 2] ^ y[len(y) // 2 :])
            out.append(int(np.bitwise_count(x ^ y).sum()) <= n1 + n2 - 2 * -(-4 * (n1 + n2) // 9))
        yield pa.array(out, pa.bool_())


def open_pairs(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs that sketches do not rule out; sketches are some 1/16 of the sets in size."""
    side = lambda c: sets.select(F.col("cls").alias(c), F.col("size").alias(f"size_{c}"), F.col("sketch").alias(f"sketch_{c}"))
    both = pairs.hint("merge").join(side("a"), "a").hint("merge").join(side("b"), "b")
    return both.where(F.arrow_udf(_open_pairs, "boolean")("size_a", "size_b", "sketch_a", "sketch_b")).select("a", "b").distinct()


def verify(spark: SparkSession, pairs: DataFrame, sets: DataFrame) -> DataFrame:
    buckets = max(16, int(spark.conf.get("spark.sql.shuffle.partitions")))
    n = F.floor((F.row_number().over(Window.partitionBy("a").orderBy("b")) - 1) / BATCH)
    batched = pairs.withColumn("bucket", F.pmod(F.xxhash64("a", n), F.lit(buckets)).cast("int"))
    # A bitmap keeps the sets of no pair at home; neither side of the joins has a bound, so none is broadcast.
    wanted = id_filter(pairs.select("a").union(pairs.select("b")))
    seqs = sets.where(wanted("cls")).select("cls", "seq").hint("merge")
    partners = batched.join(seqs, batched["b"] == seqs["cls"]).select("bucket", "a", "b", "seq")
    own = batched.select("bucket", "a").distinct().join(seqs, F.col("a") == seqs["cls"]).select("bucket", "a", F.col("a").alias("b"), "seq")
    return partners.unionByName(own).groupBy("bucket").applyInArrow(_verify, "a long, b long")


# ---------------------------------------------------------------- components


def stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All nodes of the edges but the least of each component, and that least node for each."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    top = np.arange(len(nodes))
    while True:
        lo, hi = np.minimum(top[a], top[b]), np.maximum(top[a], top[b])
        if not (lo < hi).any():
            return nodes[top < np.arange(len(nodes))], nodes[top[top < np.arange(len(nodes))]]
        np.minimum.at(top, hi, lo)
        while (top[top] != top).any():
            top = top[top]


def _stars(batches):
    got = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if got:
        u, v = stars(*(np.concatenate(x) for x in zip(*got)))
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])


def tangled(edges: DataFrame) -> bool:
    """Whether edges (u, v), u > v, are more than stars around the least node of each component."""
    end = lambda c, up: edges.select(F.col(c).alias("x"), F.lit(up).alias("up"))
    nodes = end("u", 1).unionByName(end("v", 0)).groupBy("x").agg(F.sum("up").alias("up"), F.count("*").alias("ends"))
    return nodes.where("up > 1 OR up = 1 AND ends > 1").agg(F.count("*")).first()[0] > 0


def components(spark: SparkSession, links: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(node, comp) with comp the least node of each component, by large-star and small-star rounds.

    Tasks first turn the links that they hold into stars, which saves rounds. `known` is what an earlier call gave: its
    stars stand for all the links of that call.
    """
    driver_gives_back(spark)
    tasks = max(4, -(-links.count() // LINK_ROWS))
    edges = links.select("a", "b").coalesce(tasks).mapInArrow(_stars, "u long, v long")
    if known is not None:
        edges = edges.unionByName(known.select(F.col("node").alias("u"), F.col("comp").alias("v")))
    edges = stored(spark, edges.distinct(), "edges")
    while tangled(edges):
        # Large star: the larger neighbours of a node go to the least of its neighbourhood.
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # Small star: a node and its smaller neighbours go to the least of them.
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        new = stored(spark, small.where("u <> v").distinct(), "edges")
        discard(spark, edges)
        edges = new
        driver_gives_back(spark)
    return edges.select(F.col("u").alias("node"), F.col("v").alias("comp"))


# ---------------------------------------------------------------- all links inside the components


def overlaps(xs: list[np.ndarray], ys: list[np.ndarray]) -> np.ndarray:
    """Shingles that each of xs shares with each of ys: frequent ones by products of 0/1 matrices, rare ones pair by pair."""
    out = np.zeros((len(xs), len(ys)), np.float32)
    if not xs or not ys:
        return out.astype(np.int64)
    side = lambda sets: (np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(v) for v in sets]))
    (s, i), (t, j) = side(xs), side(ys)
    both = np.intersect1d(s, t)
    if not len(both):
        return out.astype(np.int64)

    def postings(s, i):
        at = np.minimum(np.searchsorted(both, s), len(both) - 1)
        ok = both[at] == s
        at, i = at[ok], i[ok]
        order = np.argsort(at, kind="stable")
        return at[order], i[order], np.searchsorted(at[order], np.arange(len(both) + 1))

    (s, i, first), (t, j, other) = postings(s, i), postings(t, j)
    n, m = np.diff(first), np.diff(other)
    rare = n * m <= 256
    often = np.flatnonzero(~rare)
    for lo in range(0, len(often), 2048):
        col = np.full(len(both), -1)
        col[often[lo : lo + 2048]] = np.arange(len(often[lo : lo + 2048]))
        a, b = np.zeros((len(xs), 2048), np.float32), np.zeros((len(ys), 2048), np.float32)
        for d, rows, keys in ((a, i, s), (b, j, t)):
            c = col[keys]
            d[rows[c >= 0], c[c >= 0]] = 1
        out += a @ b.T
    out = out.astype(np.int64)
    # Each entry of s with all entries of t that have its shingle, so many at once.
    own = np.flatnonzero(rare[s])
    ends = np.cumsum(m[s[own]])
    lo = 0
    while lo < len(own):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + (1 << 21), "right")))
        e = own[lo:hi]
        c = m[s[e]]
        k = np.arange(int(c.sum())) - np.repeat(np.cumsum(c) - c, c) + np.repeat(other[s[e]], c)
        out += np.bincount(np.repeat(i[e], c) * len(ys) + j[k], minlength=out.size).reshape(out.shape)
        lo = hi
    return out


def _inside(pairs: bool):
    """The links of two blocks of a component, each once: as pairs, or as numbers of linked classes and documents."""

    def run(key, table):
        comp, i, j, part, cls, docs = (table[c].to_numpy() for c in ("comp", "i", "j", "part", "cls", "docs"))
        seqs = table["seq"].combine_chunks() if table["seq"].num_chunks != 1 else table["seq"].chunk(0)
        order = np.lexsort((cls, part, j, i, comp))
        comp, i, j, part, cls, docs = (x[order] for x in (comp, i, j, part, cls, docs))
        new = np.ones(len(cls), bool)
        new[1:] = (comp[1:] != comp[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])
        fresh = new.copy()
        fresh[1:] |= cls[1:] != cls[:-1]  # a set may have been sent twice
        edge = np.append(np.flatnonzero(new), len(cls))
        out: list[tuple] = [(np.zeros(0, np.int64),) * 3]
        for lo, hi in zip(edge[:-1], edge[1:]):
            own = lo + np.flatnonzero(fresh[lo:hi])
            x = own[part[own] == i[lo]]
            y = own[part[own] == j[lo]]
            one = i[lo] == j[lo]
            sets = {r: np.frombuffer(seqs[int(order[r])].as_buffer(), np.uint64) for r in own.tolist()}
            xs, ys = [sets[r] for r in x.tolist()], [sets[r] for r in y.tolist()]
            n, m = np.array([len(v) for v in xs], np.int64)[:, None], np.array([len(v) for v in ys], np.int64)[None]
            ok = linked(n, m, overlaps(xs, ys))
            if one:
                np.fill_diagonal(ok, False)
            if pairs:
                a, b = np.nonzero(np.triu(ok) if one else ok)
                out.append((np.minimum(cls[x[a]], cls[y[b]]), np.maximum(cls[x[a]], cls[y[b]]), np.ones(len(a), np.int64)))
            else:
                out.append((cls[x], ok.sum(1), ok @ docs[y]))
                if not one:
                    out.append((cls[y], ok.sum(0), docs[x] @ ok))
        return pa.table([pa.array(np.concatenate(c), pa.int64()) for c in zip(*out)], names=["a", "b", "n"] if pairs else ["cls", "links", "docs"])

    return run


def links_inside(known: DataFrame, reps: DataFrame, sets: DataFrame, parts: int, pairs: bool = False) -> DataFrame:
    """All links between classes: (a, b, n = 1), each once, or per class and pair of blocks (cls, links, docs).

    The two ends of a link are in one component, so a comparison of all its classes finds every link. Large components
    are cut by a hash into blocks that tasks share; a task reads two blocks, not a group.
    """
    members = known.select(F.col("node").alias("cls"), "comp").union(known.select("comp", "comp")).distinct()
    sized = members.join(sets.select("cls", "size").distinct(), "cls").join(reps.select("cls", "docs"), "cls")
    total = sized.groupBy("comp").agg(F.greatest(F.ceil(F.count("*") / BLOCK_CLASSES), F.ceil(F.sum("size") / BLOCK_SHINGLES)).alias("blocks"))
    dealt = sized.join(total, "comp").withColumn("part", F.pmod(F.xxhash64("cls", F.lit(5)), F.col("blocks")))
    seqs = sets.select("cls", "seq").hint("merge")
    dealt = dealt.join(seqs, "cls").withColumn("q", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = dealt.withColumns({"i": F.least("part", "q"), "j": F.greatest("part", "q")})
    # Components of one block share tasks; each two blocks of a larger one are a group of their own.
    task = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("comp"), F.lit(4 * parts))).otherwise(F.xxhash64("comp", "i", "j")).alias("task")
    return dealt.select(task, "comp", "i", "j", "part", "cls", "docs", "seq").groupBy("task").applyInArrow(_inside(pairs), "a long, b long, n long" if pairs else "cls long, links long, docs long")


# ---------------------------------------------------------------- bitmaps of bounded size


def bitmap_of(bits: DataFrame) -> np.ndarray:
    """A bitmap of 2^_BITMAP_BITS bits from rows `bit`, put together in Spark."""
    parts = bits.groupBy(F.shiftright("bit", 15).alias("part")).agg(F.bitmap_construct_agg(F.col("bit").bitwiseAND(32767)).alias("blob"))
    out = np.zeros(1 << (_BITMAP_BITS - 3), np.uint8)
    for r in parts.collect():
        out[r["part"] * 4096 : (r["part"] + 1) * 4096] = np.frombuffer(r["blob"], np.uint8)
    return out


def id_filter(ids: DataFrame):
    """A test for columns of ids: false only for ids that are not in `ids` (one column). Nulls count as -1."""
    bit = lambda c: F.xxhash64(F.coalesce(F.col(c).cast("long"), F.lit(-1))).bitwiseAND((1 << _BITMAP_BITS) - 1)
    bitmap = bitmap_of(ids.select(bit(ids.columns[0]).alias("bit")))

    def look(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for arr in batches:
            b = arr.to_numpy(zero_copy_only=False)
            yield pa.array((bitmap[b >> 3] >> (b & 7).astype(np.uint8)) & 1 == 1)

    look.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    test = F.arrow_udf(look, "boolean")
    return lambda column: test(bit(column))


# ---------------------------------------------------------------- the join


def _join(spark: SparkSession, docs: DataFrame, id_col: str, text_col: str):
    """Documents with their classes; classes; components; sets of the classes that are in a pair; what can go at the end."""
    bound_batches(spark)
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    bits = int(min(26, max(16, np.ceil(np.log2(max(1, docs.count()) * 32)))))
    parts = max(16, int(spark.conf.get("spark.sql.shuffle.partitions")))
    told = stored(spark, d.mapInArrow(tidy(_describe(bits)), "kind int, doc_id long, n long, cls long, blob binary"), "classes")
    sums = told.where("kind = 1").select(F.col("doc_id").alias("part"), "blob").groupBy("part").applyInArrow(_add_up, "part long, blob binary")
    levels = spark.sparkContext.broadcast(levels_of(sums.collect(), bits))
    rows = stored(spark, told.where("kind = 0").select("doc_id", "n", "cls"), "classes")
    discard(spark, told)  # the counters of all tasks are most of it
    reps = rows.where("n > 0").groupBy("cls").agg(F.min("doc_id").alias("rep"), F.count("*").alias("docs"))

    packed = d.select("text").mapInArrow(tidy(_prefixes(levels, bits, parts)), "part int, blob binary")
    found = stored(spark, packed.groupBy("part").applyInArrow(_runs, CANDIDATES), "runs")
    runs = found.where("kind = 1").select("key", "a", "n", "pos")
    pairs = stored(spark, found.where("kind = 0").select("a", "b").distinct(), "pairs")
    used = pairs.select(F.col("a").alias("cls")).union(pairs.select("b")).union(runs.select("a")).distinct()
    bit = F.col("cls").bitwiseXOR(F.coalesce("rep", F.lit(-1))).bitwiseAND((1 << _BITMAP_BITS) - 1)
    marks = reps.join(used, "cls", "left_semi").select(bit.alias("bit"))
    bitmap = bitmap_of(marks)
    sets = stored(spark, d.mapInArrow(tidy(_wanted_sets(levels, bits, bitmap)), "cls long, size long, seq binary, sketch binary"), "sets")

    candidates, pairs = pairs, stored(spark, open_pairs(pairs, sets), "pairs")
    discard(spark, candidates)
    links = stored(spark, verify(spark, pairs, sets), "links")
    known = components(spark, links)
    if runs.limit(1).count():
        drawn = sets.select("cls", "sketch")
        for full in (False, True):
            own = runs.join(known, runs["a"] == known["node"], "left").select("key", "a", F.coalesce("comp", "a").alias("comp"), "n", "pos")
            # Most runs lie in one component by now: only the others take sketches along (a bitmap may let some more by).
            mixed = own.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("rows")).where("lo <> hi")
            mixed = stored(spark, mixed.select("key", F.ceil(F.col("rows") / RUN_BLOCK).alias("blocks")), "mixed")
            own = stored(spark, own.where(id_filter(mixed.select("key"))("key")), "mixed")
            runs = own.select("key", "a", "n", "pos")  # a later round can only find pairs in these
            dealt = own.join(drawn, F.col("a") == drawn["cls"]).drop("cls").join(mixed.where("blocks > 1"), "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1).cast("long")))
            dealt = dealt.withColumn("part", F.pmod(F.xxhash64("a", F.lit(9)), F.col("blocks"))).withColumn("q", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
            dealt = dealt.withColumns({"i": F.least("part", "q"), "j": F.greatest("part", "q")})
            task = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("key"), F.lit(parts))).otherwise(F.xxhash64("key", "i", "j")).alias("task")
            dealt = dealt.select(task, "key", "a", "comp", "n", "pos", "i", "j", "part", "sketch")
            more = stored(spark, dealt.groupBy("task").applyInArrow(_crossing(full), "a long, b long").distinct().join(pairs, ["a", "b"], "left_anti"), "pairs")
            if not more.limit(1).count():
                discard(spark, more)
                continue
            pairs = pairs.unionByName(more)
            known = components(spark, stored(spark, verify(spark, more, sets), "links"), known)
    return rows, reps, known, sets, found


@releases_shuffles
def join_classes(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", links: bool = True) -> DataFrame:
    """doc_id, n_shingles, component_id, class_id, and with `links` the true numbers of links, class_links and n_links.

    class_id is the least id of the documents with an equal set. class_links counts the other classes that the
    document's class links with, n_links the other documents that the document links with, copies among them.
    """
    rows, reps, known, sets, found = _join(spark, docs, id_col, text_col)
    named = reps.join(known, reps["cls"] == known["node"], "left").select("cls", "rep", "docs", F.coalesce("comp", "cls").alias("comp"))
    least = named.groupBy("comp").agg(F.min("rep").alias("component_id"))
    by_class = named.join(least, "comp").select("cls", "component_id", F.col("rep").alias("class_id"), "docs")
    counts = []
    if links:
        parts = max(16, int(spark.conf.get("spark.sql.shuffle.partitions")))
        ends = links_inside(known, reps, sets, parts).groupBy("cls").agg(F.sum("links").alias("links"), F.sum("docs").alias("partners"))
        by_class = by_class.join(ends, "cls", "left").withColumns({"class_links": F.coalesce("links", F.lit(0)), "n_links": F.coalesce("partners", F.lit(0)) + F.col("docs") - 1}).drop("links", "partners")
        counts = ["class_links", "n_links"]
    by_class = stored(spark, by_class, "components")
    discard(spark, sets, found)
    out = rows.join(by_class, "cls", "left")
    empty = F.col("n") == 0
    own = [F.when(empty, F.col("doc_id")).otherwise(F.col(c)).alias(c) for c in ("component_id", "class_id")]
    return out.select("doc_id", F.col("n").alias("n_shingles"), *own, *[F.when(empty, F.lit(0)).otherwise(F.col(c)).cast("long").alias(c) for c in counts])


@releases_shuffles
def join_pairs(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every pair of linked classes once, as class ids, the lesser one first. Documents of one class link as well."""
    _, reps, known, sets, found = _join(spark, docs, id_col, text_col)
    parts = max(16, int(spark.conf.get("spark.sql.shuffle.partitions")))
    pairs = links_inside(known, reps, sets, parts, pairs=True)
    side = lambda c: reps.select(F.col("cls").alias(c), F.col("rep").alias(f"rep_{c}"))
    out = stored(spark, pairs.join(side("a"), "a").join(side("b"), "b").select(F.least("rep_a", "rep_b").alias("a"), F.greatest("rep_a", "rep_b").alias("b")), "links")
    discard(spark, sets, found)
    return out
