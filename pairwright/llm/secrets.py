"""Secret scanning: patterns, and a character convolutional network over every candidate and its context.

Base findings are pattern matches and always stay. The network reads every other candidate with 24 characters of
context on either side. Candidates are runs of `[A-Za-z0-9+/_.=-]` that are not wholly inside a base finding: from 12
characters on with a letter and a digit, from 16 on with a capital behind a small letter or digit, from 24 on whatever
they hold; so a key of which a pattern sees only a part is read whole. Longer candidates are read in overlapping
pieces, whole. The network is trained here, in numpy, on labelled findings that a seeded generator writes; its scores
are calibrated (Platt) on held-out findings, and the threshold of each length band is the highest that still keeps
RECALL of the held-out secrets, whatever that is.

Spans are (kind, start, end, score) in code points, end exclusive, ordered by start, then kind as in KINDS.

Defined cases: a null or empty text has no spans; repeated rows are scanned each; further columns pass through, but one
named as the output is replaced; texts are read whole, whatever their length; an empty table stays empty.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, text_buffer, text_slices, tidy

#: The base patterns and the order of kinds.
KINDS = ("assign", "access", "hex", "cnn")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HINTS = (b"passw", b"secret", b"token", b"api")

RECALL = 0.98
CONTEXT, PIECE, WIDTH, FILTERS = 24, 64, 5, 24
#: Least lengths of candidates: with letter and digit, with inner capitals, any.
MIXED, CAMEL, ANY = 12, 16, 24
LENGTH = CONTEXT + PIECE + CONTEXT
#: Character ids: 0 padding, 1 any other, 2.. printable ASCII; the same again for characters inside the candidate.
_IDS = np.ones(256, np.int64)
_IDS[32:127] = np.arange(2, 97)
ALPHABET = 97

_RUN = np.zeros(256, bool)
_RUN[[ord(c) for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"]] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[48:58] = True
_ALPHA = np.zeros(256, bool)
_ALPHA[65:91] = _ALPHA[97:123] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_HEX = np.zeros(256, bool)
_HEX[48:58] = _HEX[97:103] = True


# ---------------------------------------------------------------- labelled findings


def _candidate(s: str) -> bool:
    """Whether a run is read at all; `scan_texts` says the same of many runs at once."""
    letter, digit = any(c.isalpha() for c in s), any(c.isdigit() for c in s)
    camel = any(b.isupper() and (a.islower() or a.isdigit()) for a, b in zip(s, s[1:]))
    return len(s) >= ANY or len(s) >= MIXED and letter and digit or len(s) >= CAMEL and camel


def labelled_findings(n: int, seed: int) -> list[tuple[str, str, str, int]]:
    """(left context, candidate, right context, label): secrets of usual forms, and strings that only look alike."""
    r = np.random.default_rng(seed)
    low, up, dig = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"

    def rand(alphabet: str, k: int) -> str:
        return "".join(alphabet[i] for i in r.integers(0, len(alphabet), k))

    parts = ["th", "in", "er", "an", "re", "on", "at", "en", "nd", "ti", "es", "or", "te", "of", "ed", "is", "it", "al", "ar", "st", "to", "nt", "ng", "se", "ha", "ou", "le", "de", "une", "sch", "ung", "que", "cion", "ment"]
    word = lambda: "".join(parts[i] for i in r.integers(0, len(parts), r.integers(1, 5)))
    words = lambda k: " ".join(word() for _ in range(k))
    b64, url = low + up + dig + "+/", low + up + dig + "-_"

    def secret() -> str:
        k = int(r.integers(0, 14))
        size = int(r.integers(20, 64))
        hexa = "0123456789abcdef"
        return [
            lambda: rand("0123456789ABCDEF", int(r.choice([32, 40, 64]))),
            lambda: rand(b64, size) + "=" * int(r.integers(0, 3)),
            lambda: rand(url, size),
            lambda: rand(low, 3) + "_" + rand(low + up + dig, 36),
            lambda: "sk-" + rand(low + up + dig, int(r.integers(24, 49))),
            lambda: f"{rand(url, 24)}.{rand(url, 30)}.{rand(url, 30)}",
            lambda: rand(low + dig, size),
            lambda: rand(up + dig, int(r.integers(16, 33))),
            lambda: f"xox{rand('abp', 1)}-{rand(dig, 11)}-{rand(dig, 12)}-{rand(low + up + dig, 24)}",
            lambda: str(r.choice(["github_pat_", "glpat-", "AIza", "SG.", "hf_", "npm_", "pk_live_", "sk_test_"])) + rand(low + up + dig + "_", int(r.integers(20, 45))),
            lambda: f"eyJ{rand(url, 24)}.eyJ{rand(url, 40)}.{rand(url, 43)}",
            lambda: rand(hexa, int(r.integers(24, 41))) + rand(b64, int(r.integers(8, 24))),
            lambda: rand(low + up + dig, int(r.integers(14, 20))),
            lambda: rand(low + up, size),
        ][k]()

    def plain() -> str:
        k = int(r.integers(0, 26))
        num = lambda a, b: str(r.integers(a, b))
        return [
            lambda: f"{word()}{num(0, 99)}.{word()}.example.com",
            lambda: f"mail{num(0, 9)}.{word()}.{word()}.org/{word()}",
            lambda: f"20{num(10, 30)}-{num(10, 12)}-{num(10, 28)}T{num(10, 23)}.{num(10, 59)}.{num(10, 59)}Z",
            lambda: "/".join(word() for _ in range(5)) + f"/{word()}{num(1, 99)}.html",
            lambda: "-".join([rand("0123456789abcdef", 8), rand("0123456789abcdef", 4), rand("0123456789abcdef", 4), rand("0123456789abcdef", 4)]),
            lambda: "_".join(word() for _ in range(4)) + num(0, 999),
            lambda: "".join(word() for _ in range(6)) + num(0, 99),
            lambda: rand(low, 1) * int(r.integers(16, 40)) + num(0, 9),
            lambda: f"v{num(0, 9)}.{num(0, 30)}.{num(0, 99)}-{word()}.{word()}.{num(0, 999)}",
            lambda: f"{rand(low, int(r.integers(6, 12)))}.{num(10, 99)}.{word()}-{word()}{num(0, 9)}",
            lambda: "-".join(word() + num(0, 9) for _ in range(5)),
            lambda: num(10**9, 10**10) + "." + word() + "." + word() + word() + word(),
            lambda: f"{str(r.choice(['IMG', 'VID', 'DSC', 'PXL', 'Screenshot', 'scan']))}_20{num(10, 30)}{num(10, 12)}{num(10, 28)}_{num(10**5, 10**9)}{str(r.choice(['', '_HDR', '_BURST', '-edited']))}.{str(r.choice(['jpg', 'png', 'mp4', 'pdf']))}",
            lambda: f"v={rand(url, 11)}",
            lambda: f"//www.{word()}.com/watch" if r.random() < 0.5 else f"//{word()}.{word()}.com/{word()}/{num(10**5, 10**9)}",
            lambda: f"10.{num(1000, 9999)}/{word()}.{num(1990, 2030)}.{num(10**4, 10**6)}",
            lambda: f"{num(1, 20)}.{num(0, 20)}.{num(0, 99)}-{str(r.choice(['alpha', 'beta', 'rc', 'SNAPSHOT', 'release']))}.{num(0, 20)}",
            lambda: "".join(word().capitalize() for _ in range(int(r.integers(3, 6)))),
            lambda: word() + "".join(word().capitalize() for _ in range(int(r.integers(2, 5)))) + str(r.choice(["", "2", "V3", "Test1"])),
            lambda: "_".join(word().upper() for _ in range(int(r.integers(3, 6)))) + str(r.choice(["", "_1", "_V2"])),
            lambda: str(r.choice(["-", "=", ".", "_", "=-", "._"])) * int(r.integers(24, 60)),
            lambda: num(10**11, 10**12) + num(10**11, 10**12) + num(1, 10**6),
            lambda: f"{word()}-{word()}-{word()}-{word()}-{word()}-{num(1, 20000)}",
            lambda: f"ISBN-13/{num(970, 980)}-{num(1, 9)}-{num(100, 999)}-{num(10**4, 10**5)}-{num(1, 9)}",
            lambda: f"{word()}/{word()}-{num(1, 99)}.{num(1, 9)}.{num(1, 9)}.tar.gz",
            lambda: f"{word()}{num(1, 99)}={word()}{num(1, 99)}.{word()}",
        ][k]()

    out = []
    keys = ["key", "auth", "bearer", "credential", "access", "private", "pwd", "client"]
    for i in range(n):
        y = int(i % 2 == 0)
        s = secret() if y else plain()
        if not _candidate(s):
            s += f"{word()}{rand(dig, 1)}{word()}{word()}" if not y else rand(low + up + dig, 12)
        left = words(4) + " "
        if r.random() < (0.4 if y else 0.1):
            left = words(2) + " " + str(r.choice(keys)) + str(r.choice([": ", "=", " is ", ' = "']))
        out.append((left[-CONTEXT:], s, (" " + words(4))[:CONTEXT], y))
    return out


# ---------------------------------------------------------------- the network


def _inputs(items: list[tuple[str, str, str]]) -> tuple[np.ndarray, np.ndarray]:
    """Character ids of each piece, and the item it belongs to. A piece is centred in a row of LENGTH."""
    rows, owner = [], []
    for i, (left, s, right) in enumerate(items):
        step = PIECE // 2
        for at in range(0, max(1, len(s) - PIECE + step), step):
            piece = s[at : at + PIECE]
            a = (left + s[:at])[-CONTEXT:]
            b = (s[at + PIECE :] + right)[:CONTEXT]
            x = np.zeros(LENGTH, np.int64)
            enc = lambda t: _IDS[np.minimum(np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32), 255)]
            if a:
                x[CONTEXT - len(a) : CONTEXT] = enc(a)
            x[CONTEXT : CONTEXT + len(piece)] = enc(piece) + ALPHABET
            if b:
                x[CONTEXT + len(piece) : CONTEXT + len(piece) + len(b)] = enc(b)
            rows.append(x)
            owner.append(i)
    return np.stack(rows) if rows else np.zeros((0, LENGTH), np.int64), np.array(owner, np.int64)


def _features(m: dict, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pooled features: the largest and the mean response inside the candidate, and the largest in the context."""
    n = LENGTH - WIDTH + 1
    z = sum(m["E"][k][x[:, k : k + n]] for k in range(WIDTH)) + m["b"]
    a = np.maximum(z, 0)
    inside = (x[:, WIDTH // 2 : WIDTH // 2 + n] >= ALPHABET)[:, :, None]
    count = inside.sum(1)
    top, ctx = np.where(inside, a, -1).argmax(1), np.where(inside, -1, a).argmax(1)
    pick = lambda at: np.take_along_axis(a, at[:, None, :], 1)[:, 0]
    h = np.concatenate([pick(top), (a * inside).sum(1) / np.maximum(count, 1), pick(ctx)], 1)
    return h, top, ctx


def train(n: int = 3000, epochs: int = 6, seed: int = 11) -> dict:
    """The network with its calibration and thresholds; a function of its arguments alone."""
    r = np.random.default_rng(seed)
    data = labelled_findings(n, seed)
    x, owner = _inputs([d[:3] for d in data])
    y = np.array([d[3] for d in data], float)[owner]
    m = {"E": r.normal(0, 0.15, (WIDTH, 2 * ALPHABET, FILTERS)), "b": np.zeros(FILTERS), "w": r.normal(0, 0.1, 3 * FILTERS), "c": np.zeros(1)}
    mom = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in m.items()}
    t, n_pos = 0, LENGTH - WIDTH + 1
    for _ in range(epochs):
        order = r.permutation(len(x))
        for s in range(0, len(x), 64):
            i = order[s : s + 64]
            xb = x[i]
            h, top, ctx = _features(m, xb)
            p = 1 / (1 + np.exp(-np.clip(h @ m["w"] + m["c"], -30, 30)))
            d = (p - y[i]) / len(i)
            g = {"w": h.T @ d, "c": np.array([d.sum()]), "E": np.zeros_like(m["E"]), "b": np.zeros(FILTERS)}
            dh = d[:, None] * m["w"]
            lanes, f = np.arange(len(i))[:, None], np.arange(FILTERS)[None]
            for at, part in ((top, dh[:, :FILTERS] * (h[:, :FILTERS] > 0)), (ctx, dh[:, 2 * FILTERS :] * (h[:, 2 * FILTERS :] > 0))):
                g["b"] += part.sum(0)
                for k in range(WIDTH):
                    np.add.at(g["E"][k], (xb[lanes, at + k], np.broadcast_to(f, at.shape)), part)
            inside = xb[:, WIDTH // 2 : WIDTH // 2 + n_pos] >= ALPHABET
            z = sum(m["E"][k][xb[:, k : k + n_pos]] for k in range(WIDTH)) + m["b"]
            share = (dh[:, None, FILTERS : 2 * FILTERS] * (z > 0)) * (inside / np.maximum(inside.sum(1, keepdims=True), 1))[:, :, None]
            g["b"] += share.sum((0, 1))
            for k in range(WIDTH):
                flat = xb[:, k : k + n_pos][inside]
                np.add.at(g["E"][k], flat, share[inside])
            t += 1
            for k, v in g.items():
                a, b = mom[k]
                a += 0.1 * (v - a)
                b += 0.001 * (v * v - b)
                m[k] = m[k] - 0.004 * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.999**t)) + 1e-8)
    held = labelled_findings(max(400, n // 3), seed + 1)
    logit = logits(m, [d[:3] for d in held])
    label = np.array([d[3] for d in held])
    a, b = 1.0, 0.0
    for _ in range(200):  # Platt: two numbers, by gradient steps
        q = 1 / (1 + np.exp(-np.clip(a * logit + b, -30, 30)))
        a -= 0.05 * ((q - label) * logit).mean()
        b -= 0.05 * (q - label).mean()
    m |= {"platt": (a, b), "bands": []}
    long = np.array([len(d[1]) >= 32 for d in held])
    for band in (~long, long):
        pos = np.sort(calibrated(m, logit[band & (label == 1)]))
        m["bands"].append(float(pos[int((1 - RECALL) * len(pos))]) if len(pos) else 0.5)
    return m


def logits(m: dict, items: list[tuple[str, str, str]]) -> np.ndarray:
    """One logit per candidate: the largest of its pieces."""
    out = np.full(len(items), -30.0)
    for s in range(0, len(items), 256):
        x, owner = _inputs(items[s : s + 256])
        for q in range(0, len(x), 512):
            np.maximum.at(out, owner[q : q + 512] + s, _features(m, x[q : q + 512])[0] @ m["w"] + m["c"])
    return out


def calibrated(m: dict, logit: np.ndarray) -> np.ndarray:
    a, b = m["platt"]
    return 1 / (1 + np.exp(-np.clip(a * logit + b, -30, 30)))


# ---------------------------------------------------------------- scanning


def _runs(mask: np.ndarray, off: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of at least `least` bytes that do not cross rows."""
    cut = np.ones(len(mask) + 1, bool)
    np.not_equal(mask[1:], mask[:-1], out=cut[1:-1])
    cut[off] = True
    edges = np.flatnonzero(cut)
    a, b = edges[:-1], edges[1:]
    keep = (b - a >= least) & mask[np.minimum(a, len(mask) - 1)]
    return a[keep], b[keep]


def scan_texts(model: dict, arr: pa.Array) -> list[list[tuple[str, int, int, float]]]:
    data, off = text_buffer(arr)
    out: list[list] = [[] for _ in range(len(arr))]
    if not len(data):
        return out
    raw = data.tobytes()
    run_a, run_b = _runs(_RUN[data], off, MIXED)
    if len(run_a):
        edges = np.stack([run_a, run_b], 1).ravel()
        among = lambda flag: np.add.reduceat(np.append(flag, False).astype(np.int64), edges)[::2] > 0
        upper = _UPPER[data]
        camel = np.zeros(len(data), bool)
        camel[1:] = upper[1:] & (_ALPHA | _DIGIT)[data[:-1]] & ~upper[:-1]
        camel[run_a] = False
        n = run_b - run_a
        keep = (n >= ANY) | among(_DIGIT[data]) & among(_ALPHA[data]) | (n >= CAMEL) & among(camel)
        run_a, run_b = run_a[keep], run_b[keep]
    hex_a, hex_b = _runs(_HEX[data], off, 24)
    run_row, hex_row = np.searchsorted(off, run_a, "right") - 1, np.searchsorted(off, hex_a, "right") - 1
    rows = set(run_row.tolist()) | set(hex_row.tolist())
    low = raw.lower()
    for hint in (*HINTS, b"AKIA"):
        where, text = 0, raw if hint == b"AKIA" else low
        while (where := text.find(hint, where)) >= 0:
            row = int(np.searchsorted(off, where, "right")) - 1
            rows.add(row)
            where = int(off[row + 1])
    items, places = [], []
    for row in sorted(rows):
        o, e = int(off[row]), int(off[row + 1])
        text = raw[o:e].decode("utf-8", "surrogatepass")
        # Byte offsets to code points: how many bytes before are not continuation bytes.
        points = np.concatenate([[0], np.cumsum((data[o:e] & 0xC0) != 0x80)])
        found = [("assign", x.start(), x.end()) for x in ASSIGN.finditer(text) if len(x[2]) >= 6]
        found += [("access", x.start(), x.end()) for x in ACCESS.finditer(text) if x.end() - x.start() >= 20]
        lo, hi = np.searchsorted(hex_row, [row, row + 1])
        found += [("hex", int(points[a - o]), int(points[b - o])) for a, b in zip(hex_a[lo:hi].tolist(), hex_b[lo:hi].tolist())]
        out[row] = [(k, a, b, 1.0) for k, a, b in found]
        lo, hi = np.searchsorted(run_row, [row, row + 1])
        for a, b in zip(run_a[lo:hi].tolist(), run_b[lo:hi].tolist()):
            a, b = int(points[a - o]), int(points[b - o])
            if not any(x <= a and b <= y for _, x, y in found):
                items.append((text[max(0, a - CONTEXT) : a], text[a:b], text[b : b + CONTEXT]))
                places.append((row, a, b))
    if items:
        for (row, a, b), p in zip(places, calibrated(model, logits(model, items)).tolist()):
            if p >= model["bands"][int(b - a >= 32)]:
                out[row].append(("cnn", a, b, p))
    rank = {k: i for i, k in enumerate(KINDS)}
    for row in rows:
        out[row].sort(key=lambda x: (x[1], rank[x[0]]))
    return out


SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))


def scan(df: DataFrame, model: dict, text_col: str = "text", out: str = "secrets") -> DataFrame:
    """df with an array of spans; only the text travels to Python."""

    bound_batches(df.sparkSession)

    def find(batches):
        for arr in batches:
            found = []
            for s in text_slices(pa.RecordBatch.from_arrays([arr], names=["t"])):
                found += [[dict(zip(("kind", "start", "end", "score"), x)) for x in y] for y in scan_texts(model, s.column(0))]
            yield pa.array(found, SPANS)

    from collections.abc import Iterator

    find = tidy(find)
    find.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return df.withColumn(out, F.arrow_udf(find, "array<struct<kind:string,start:bigint,end:bigint,score:double>>")(F.col(text_col)))


def redact(text_col: str, spans_col: str, mask: str = "[SECRET]"):
    """The text with every span replaced by a mark; overlapping spans are one. A Column, whole texts."""
    text, spans = F.coalesce(F.col(text_col), F.lit("")), F.col(spans_col)
    start = F.struct(F.lit("").alias("done"), F.lit(0).cast("bigint").alias("at"))

    def step(acc, s):
        gap = F.substr(text, (acc["at"] + 1).cast("int"), F.greatest(s["start"] - acc["at"], F.lit(0)).cast("int"))
        mark = F.when(s["start"] >= acc["at"], F.lit(mask)).otherwise("")
        return F.struct(F.concat(acc["done"], gap, mark).alias("done"), F.greatest(acc["at"], s["end"]).alias("at"))

    done = F.aggregate(spans, start, step, lambda acc: F.concat(acc["done"], F.substr(text, (acc["at"] + 1).cast("int"), F.lit(2**31 - 1))))
    return F.when(F.size(spans) == 0, F.col(text_col)).otherwise(done)
