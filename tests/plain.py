"""The matching semantics as plain loops over dicts: what the Spark plans must equal."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

AUTO = ("sub_", "SUB_", "FUN_", "fun_", "loc_", "fcn.", "func_")
PRIMES = [2, 3, 5, 7, 11, 13, 17, 19, 23, 29, 31, 37, 41, 43, 47, 53, 59, 61, 67, 71, 73, 79, 83, 89, 97]


def program(rng: random.Random, n: int) -> list[dict]:
    """Small functions with many ties, empty ones, outside edges, repeated addresses."""
    out = []
    for i in range(n):
        blocks, address = [], rng.choice([0, 4096, 8192, 12288, 4096 * (i + 1)])
        for k in range(rng.choice([0, 1, 1, 2, 3])):
            ins = [{"address": address, "mnemonic": rng.choice(["mov", "call", "SYSCALL", "add"]), "operands": rng.choice([[], ["f1"], ["0x1", '"s"'], ["+5", " 5"], ["f2", "#x"]]), "bytes": None, "length": 4} for _ in range(rng.choice([0, 1, 2]))]
            edges = [address + 40 * rng.randrange(4) for _ in range(rng.choice([0, 1, 2]))]
            blocks.append({"address": address + 40 * k, "size": 40, "instructions": ins, "edges": edges, "mnemonic_hash": rng.choice(["h1", "h2", "h3"]), "instruction_count": len(ins)})
        out.append({
            "idx": i, "name": rng.choice(["main", "sub_1", "j_sub_2", "init", "run", ""]), "address": address, "size": rng.choice([0, 16, 20, 100]),
            "basic_blocks": blocks, "instructions": [x for b in blocks for x in b["instructions"]], "cyclomatic_complexity": rng.choice([1, 2, 5]),
            "call_graph_hash": rng.choice(["c1", "c2", ""]), "cfg_hash": rng.choice(["g1", "g2", "g3", ""]), "instruction_count": 0, "call_count": 0,
        })
    return out


def is_auto(name: str) -> bool:
    while name.startswith("j_"):
        name = name[2:]
    return name in ("", "unnamed") or name.startswith(AUTO)


def ratio(x, y):
    return 1.0 if x == y == 0 else 0.0 if 0 in (x, y) else 1.0 - abs(x - y) / max(x, y)


def jaccard(a, b):
    a, b = set(a), set(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def multiset(a, b):
    if not a and not b:
        return 1.0
    return sum((Counter(a) & Counter(b)).values()) / max(len(a), len(b)) if a and b else 0.0


def edit(a: str, b: str) -> float:
    """Sized by bytes, compared by characters; past the last character both sides read nothing, and nothing equals nothing."""
    x, y = list(a) + [None] * (len(a.encode()) - len(a)), list(b) + [None] * (len(b.encode()) - len(b))
    if not x and not y:
        return 1.0
    row = list(range(len(y) + 1))
    for i, p in enumerate(x, 1):
        new = [i]
        for j, q in enumerate(y, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (p != q)))
        row = new
    return 1.0 - row[-1] / max(len(x), len(y))


def mnemonics(f):
    return [i["mnemonic"] for i in f["instructions"]]


def operands(f):
    return [o for i in f["instructions"] for o in i["operands"]]


def calls(f):
    return {i["operands"][0] for i in f["instructions"] if "call" in i["mnemonic"].lower() and i["operands"]}


def constants(f):
    def number(o):
        body = o[1:] if o[:1] in ("+", "-") else o
        return body.isascii() and body.isdigit() and -(2**63) <= int(o) < 2**63

    return {o for o in operands(f) if o.startswith(("#", "0x")) or number(o)}


def strings(f):
    return {o for o in operands(f) if o.startswith('"') and o.endswith('"')}


def edges(f):
    return [e for b in f["basic_blocks"] for e in b["edges"]]


def flow(a, b):
    inside = lambda f: sum(e in {b["address"] for b in f["basic_blocks"]} for e in edges(f))
    n = len(a["basic_blocks"]), len(b["basic_blocks"])
    return 1.0 if n == (0, 0) else 0.6 * ratio(*n) + 0.4 * ratio(inside(a), inside(b))


def similarity(a, b):
    parts = {
        "cfg": 1.0 if a["cfg_hash"] == b["cfg_hash"] else flow(a, b), "call": jaccard(calls(a), calls(b)),
        "bb": multiset([x["mnemonic_hash"] for x in a["basic_blocks"]], [x["mnemonic_hash"] for x in b["basic_blocks"]]), "instruction": multiset(mnemonics(a), mnemonics(b)),
        "name": edit(a["name"], b["name"]), "edge": ratio(len(edges(a)), len(edges(b))),
    }
    return min(1.0, 0.30 * parts["cfg"] + 0.20 * parts["call"] + 0.15 * parts["bb"] + 0.15 * parts["instruction"] + 0.10 * parts["name"] + 0.10 * parts["edge"])


def sequence(a, b):
    x, y = mnemonics(a), mnemonics(b)
    return 1.0 if not x and not y else 0.0 if not x or not y else edit(" ".join(x), " ".join(y))


def blend(a, b):
    full = 0.3 * flow(a, b) + 0.2 * jaccard(calls(a), calls(b)) + 0.2 * jaccard(constants(a), constants(b)) + 0.1 * jaccard(strings(a), strings(b)) + 0.2 * sequence(a, b)
    return min(1.0, 0.6 * similarity(a, b) + 0.4 * full)


def confidence(a, b, s):
    s += 0.1 * (len(a["basic_blocks"]) == len(b["basic_blocks"])) + 0.1 * (abs(a["cyclomatic_complexity"] - b["cyclomatic_complexity"]) < 2)
    top = max(a["size"], b["size"])
    return min(1.0, s + 0.1 * (top > 0 and abs(a["size"] - b["size"]) / max(top, 1) < 0.1))


def md_index(f):
    return hashlib.sha256(f"{f['size']}:{len(f['basic_blocks'])}:{len(f['instructions'])}:{f['cyclomatic_complexity']}".encode()).hexdigest()[:16]


def primes(f):
    p = 1
    for m in mnemonics(f):
        p = p * PRIMES[sum(m.encode()) % 25] % 2**64
    return p


def match(a: list[dict], b: list[dict]) -> list[tuple]:
    """(phase, idx_a, idx_b) in the order of matching."""
    used_a, used_b, out = set(), set(), []

    def take(phase, x, y):
        used_a.add(x["idx"])
        used_b.add(y["idx"])
        out.append((phase, x["idx"], y["idx"]))

    for x in a:
        for y in b:
            if y["idx"] not in used_b and f"{x['cfg_hash']}_{x['call_graph_hash']}" == f"{y['cfg_hash']}_{y['call_graph_hash']}":
                take(1, x, y)
                break
    degrees = lambda f: sorted(len(q["edges"]) for q in f["basic_blocks"])
    keys = ((2, lambda f: None if is_auto(f["name"]) else f["name"]), (3, md_index), (4, primes), (5, degrees))
    for phase, key in keys:
        for x in a:
            if x["idx"] in used_a or key(x) is None:
                continue
            best = None
            for y in b:
                if y["idx"] not in used_b and key(y) == key(x):
                    s = similarity(x, y)
                    c = confidence(x, y, s)
                    if round(s, 9) >= 0.6 and c >= 0.5 and (best is None or (round(c, 9), round(s, 9)) > best[0]):
                        best = ((round(c, 9), round(s, 9)), y)
            if best:
                take(phase, x, best[1])
    proposals = []
    for x in a:
        if x["idx"] not in used_a:
            own = [(round(confidence(x, y, blend(x, y)), 9), round(blend(x, y), 9), -y["idx"], y) for y in b if y["idx"] not in used_b and round(blend(x, y), 9) >= 0.6]
            if own:
                c, s, _, y = max(own, key=lambda t: t[:3])
                proposals.append((-c, -s, x["idx"], x, y))
    for *_, x, y in sorted(proposals, key=lambda t: t[:3]):
        if y["idx"] not in used_b:
            take(6, x, y)
    return out
