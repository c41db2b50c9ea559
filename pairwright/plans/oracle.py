"""SQL that says what the queries say, over the same tables (a dialect with lists and lambdas)."""

from __future__ import annotations

from ..functions.kernels import COMPREHENSIVE_WEIGHTS, MATCH_WEIGHTS

#: The programs derived from `events` (a, b and the whole, w), one row per function in `f`.
PROGRAM = r"""
WITH RECURSIVE ev AS (
  SELECT event_id, user_id, strftime(ts, '%Y-%m-%d') AS day,
    CASE event_type WHEN 'purchase' THEN 'call' WHEN 'view' THEN 'mov' WHEN 'click' THEN 'push' WHEN 'signup' THEN 'lea' WHEN 'error' THEN 'jmp' ELSE 'nop' END AS m,
    CAST(regexp_extract(props, '"k": *(-?[0-9]+)', 1) AS BIGINT) AS k
  FROM events
), sided AS (
  SELECT 'a' AS side, * FROM ev WHERE user_id % 10 <> 4
  UNION ALL SELECT 'b', * FROM ev WHERE user_id % 10 <> 3 AND event_id % 100 <> 7
  UNION ALL SELECT 'w', * FROM ev
), grouped AS (
  SELECT side, user_id, day, list(m ORDER BY event_id) AS ms, bool_or(m = 'jmp') AS err FROM sided GROUP BY side, user_id, day
), blk AS (
  SELECT *, row_number() OVER w AS i, (row_number() OVER w < count(*) OVER (PARTITION BY side, user_id))::INT + err::INT AS deg
  FROM grouped WINDOW w AS (PARTITION BY side, user_id ORDER BY day)
), fb AS (
  SELECT side, user_id, count(*) AS n_bb, sum(deg)::BIGINT AS edges, list(deg ORDER BY deg) AS degs,
    list(sha256(array_to_string(ms, ' ')) ORDER BY day) AS bbs,
    string_agg('bb' || len(ms) || 'e' || deg || '_', '' ORDER BY day) AS shape
  FROM blk GROUP BY side, user_id
), fi AS (
  SELECT side, user_id, count(*) AS n_instr, string_agg(m, ' ' ORDER BY day, event_id) AS seq, list(m ORDER BY day, event_id) AS ms,
    sha256(string_agg(day || ':' || m, ' ' ORDER BY day, event_id)) AS cfg,
    coalesce(list(DISTINCT 'fn_' || (k % 12)) FILTER (WHERE m = 'call'), []::VARCHAR[]) AS calls,
    coalesce(list(DISTINCT CAST(k AS VARCHAR)) FILTER (WHERE m NOT IN ('call', 'jmp')), []::VARCHAR[]) AS consts,
    coalesce(list(DISTINCT '"e' || k || '"') FILTER (WHERE m = 'jmp'), []::VARCHAR[]) AS strs
  FROM sided GROUP BY side, user_id
), f AS MATERIALIZED (
  SELECT side, user_id AS idx, user_id,
    CASE WHEN user_id % 2 = 1 THEN 'user_' || user_id ELSE 'sub_' || format('{:x}', user_id) END AS name,
    (user_id + 1) * 4096 AS address, n_instr * 16 AS size, n_bb, n_instr, edges - n_bb + 2 AS complexity, edges, degs, bbs, shape, seq, ms,
    cfg, sha256(array_to_string(list_sort(calls), ',')) AS cg, calls, consts, strs, {primes} AS primes
  FROM fb JOIN fi USING (side, user_id)
)"""

#: The coarse programs of two halves of the months, with the same columns.
HALVES = r"""
WITH RECURSIVE k0 AS (
  SELECT CASE WHEN day(ts) <= 15 THEN 'a' ELSE 'b' END AS side, user_id,
    CASE event_type WHEN 'purchase' THEN 'call' WHEN 'view' THEN 'mov' WHEN 'click' THEN 'push' WHEN 'signup' THEN 'lea' WHEN 'error' THEN 'jmp' ELSE 'nop' END AS m
  FROM events
), kinds AS (
  SELECT side, user_id, m, count(*) AS n, least(count(*), 2) AS c, row_number() OVER w AS i,
    (row_number() OVER w < count(*) OVER (PARTITION BY side, user_id))::INT + (m = 'jmp')::INT AS deg
  FROM k0 GROUP BY side, user_id, m WINDOW w AS (PARTITION BY side, user_id ORDER BY m)
), blk AS (
  SELECT *, i AS day, CASE WHEN c = 2 THEN [m, m] ELSE [m] END AS ms FROM kinds
), fb AS (
  SELECT side, user_id, count(*) AS n_bb, sum(deg)::BIGINT AS edges, list(deg ORDER BY deg) AS degs, sum(c)::BIGINT AS n_instr,
    list(sha256(array_to_string(ms, ' ')) ORDER BY i) AS bbs, flatten(list(ms ORDER BY i)) AS ms,
    string_agg('bb' || c || 'e' || deg || '_', '' ORDER BY i) AS shape, string_agg(m, ',' ORDER BY i) AS words,
    coalesce(list(DISTINCT 'fn_' || (user_id % 4)) FILTER (WHERE m = 'call'), []::VARCHAR[]) AS calls,
    coalesce(list(DISTINCT (n % 4)::VARCHAR) FILTER (WHERE m NOT IN ('call', 'jmp')), []::VARCHAR[]) AS consts,
    coalesce(list(DISTINCT '"e' || (n % 3) || '"') FILTER (WHERE m = 'jmp'), []::VARCHAR[]) AS strs
  FROM blk GROUP BY side, user_id
), f AS MATERIALIZED (
  SELECT side, user_id AS idx, user_id,
    CASE WHEN user_id % 3 = 0 THEN 'sub_' || format('{:x}', user_id) ELSE 'grp_' || (user_id % 7) END AS name,
    (user_id % 50) * 4096 AS address, n_instr * 16 + (user_id % 3) * 4 AS size, n_bb, n_instr, edges - n_bb + 2 AS complexity, edges, degs, bbs, shape, array_to_string(ms, ' ') AS seq, ms,
    sha256(words || ':' || CASE WHEN user_id % 4 = 0 THEN (user_id % 5)::VARCHAR ELSE side || user_id END) AS cfg, sha256(array_to_string(calls, ',')) AS cg, calls, consts, strs, {primes} AS primes
  FROM fb
)"""

_SHARE = "CASE WHEN x.{c} = 0 AND y.{c} = 0 THEN 1.0 WHEN x.{c} = 0 OR y.{c} = 0 THEN 0.0 ELSE 1.0 - abs(x.{c} - y.{c})::DOUBLE / greatest(x.{c}, y.{c}) END"
_JACCARD = "CASE WHEN len(list_distinct(list_concat(x.{c}, y.{c}))) = 0 THEN 1.0 ELSE len(list_intersect(x.{c}, y.{c}))::DOUBLE / len(list_distinct(list_concat(x.{c}, y.{c}))) END"
_MULTISET = "list_sum(list_transform(list_distinct(x.{c}), lambda v: least(len(list_filter(x.{c}, lambda z: z = v)), len(list_filter(y.{c}, lambda z: z = v)))))::DOUBLE / greatest(len(x.{c}), len(y.{c}))"
_EDIT = "1.0 - levenshtein(x.{c}, y.{c})::DOUBLE / greatest(length(x.{c}), length(y.{c}))"
FLOW = f"(0.6 * ({_SHARE.format(c='n_bb')}) + 0.4 * ({_SHARE.format(c='edges')}))"
PARTS = {
    "cfg": f"CASE WHEN x.cfg = y.cfg THEN 1.0 ELSE {FLOW} END",
    "call": _JACCARD.format(c="calls"),
    "bb": _MULTISET.format(c="bbs"),
    "instruction": _MULTISET.format(c="ms"),
    "name": _EDIT.format(c="name"),
    "edge": _SHARE.format(c="edges"),
    "cf": FLOW,
    "const": _JACCARD.format(c="consts"),
    "string": _JACCARD.format(c="strs"),
    "seq": _EDIT.format(c="seq"),
}
_CLAMP = "least(1.0, greatest(0.0, {}))"


def _conf(sim: str) -> str:
    return _CLAMP.format(f"{sim} + (CASE WHEN xb = yb THEN 0.1 ELSE 0.0 END) + (CASE WHEN abs(xc - yc) < 2 THEN 0.1 ELSE 0.0 END) + (CASE WHEN abs(xs - ys)::DOUBLE / greatest(xs, ys) < 0.1 THEN 0.1 ELSE 0.0 END)")


def pairs(on: str, blend: bool = False, extra: str = "", name: str = "") -> str:
    """CTEs `p`: idx pairs that satisfy `on`, with parts, sim and conf. `name` sets several of them apart."""
    parts = {k: PARTS[k] for k, _ in MATCH_WEIGHTS} | ({k: PARTS[k] for k, _ in COMPREHENSIVE_WEIGHTS} if blend else {})
    sim = " + ".join(f"{w} * s_{k}" for k, w in MATCH_WEIGHTS)
    if blend:
        sim = f"0.6 * ({sim}) + 0.4 * ({' + '.join(f'{w} * s_{k}' for k, w in COMPREHENSIVE_WEIGHTS)})"
    cols = ", ".join(f"{v} AS s_{k}" for k, v in parts.items())
    return f""", q0{name} AS (
  SELECT x.idx AS idx_a, y.idx AS idx_b, {cols}, x.n_bb AS xb, y.n_bb AS yb, x.complexity AS xc, y.complexity AS yc, x.size AS xs, y.size AS ys{extra}
  FROM f x JOIN f y ON x.side = 'a' AND y.side = 'b' AND {on}
), q1{name} AS (SELECT *, {_CLAMP.format(sim)} AS sim FROM q0{name}), p{name} AS MATERIALIZED (SELECT *, {_conf("sim")} AS conf FROM q1{name})"""


#: Pairs of functions at the same address.
ALIGNED = "x.address = y.address"
GATE = "conf >= 0.5 AND sim >= 0.6"
SCORES = "idx_a, idx_b, round(sim, 6) AS similarity, round(conf, 6) AS confidence"
EXACT = """, z AS (SELECT *, row_number() OVER (PARTITION BY side, cfg, cg ORDER BY idx) AS nth FROM f),
e AS (SELECT x.idx AS idx_a, y.idx AS idx_b FROM z x JOIN z y ON x.side = 'a' AND y.side = 'b' AND x.cfg = y.cfg AND x.cg = y.cg AND x.nth = y.nth)"""
PRIME = "CASE m WHEN 'call' THEN 41 WHEN 'mov' THEN 43 WHEN 'push' THEN 89 WHEN 'lea' THEN 17 WHEN 'jmp' THEN 5 ELSE 0 END"

#: Products modulo 2^64, which collide beyond equal multisets.
PRIMES = f"list_reduce(list_prepend(1::HUGEINT, list_transform(ms, lambda m: ({PRIME})::HUGEINT)), lambda p, q: (p * q) % 18446744073709551616::HUGEINT)"
PROGRAM, HALVES = (p.replace("{primes}", PRIMES) for p in (PROGRAM, HALVES))


def greedy(name: str, source: str, best: str) -> str:
    """CTE `w{name}` (idx_a, idx_b): each left row of `source`, in order of idx_a, takes its best right row that is free.

    A right row marked by a column `zero` is never used up, and whoever would take it gets nothing.
    """
    return f""", c{name} AS MATERIALIZED (
  SELECT idx_a, row_number() OVER (ORDER BY idx_a) AS n, list(idx_b ORDER BY {best}, idx_b) AS bs, list(zero ORDER BY {best}, idx_b) AS zs FROM {source} GROUP BY idx_a
), r{name} AS (
  SELECT 0::BIGINT AS n, []::BIGINT[] AS used, NULL::BIGINT AS idx_a, NULL::BIGINT AS idx_b
  UNION ALL
  SELECT n, CASE WHEN b IS NULL THEN used ELSE list_append(used, b) END, idx_a, b FROM (
    SELECT n, used, idx_a, CASE WHEN zs[pk] THEN NULL ELSE bs[pk] END AS b FROM (
      SELECT c.n, r.used, c.idx_a, c.bs, c.zs, list_filter(range(1, len(c.bs) + 1), lambda i: c.zs[i] OR NOT list_contains(r.used, c.bs[i]))[1] AS pk
      FROM r{name} r JOIN c{name} c ON c.n = r.n + 1))
), w{name} AS MATERIALIZED (SELECT idx_a, idx_b FROM r{name} WHERE idx_b IS NOT NULL)"""


#: Join condition of each keyed phase, and the label of its matches.
KEYED = {
    2: ("x.name = y.name AND NOT regexp_matches(x.name, '^(sub_|SUB_|FUN_|fun_|loc_|fcn[.]|func_)') AND x.name NOT IN ('', 'unnamed')", "Structural"),
    3: ("x.size = y.size AND x.n_bb = y.n_bb AND x.n_instr = y.n_instr AND x.complexity = y.complexity", "Heuristic"),
    4: ("x.primes = y.primes", "Heuristic"),
    5: ("x.degs = y.degs", "Structural"),
}


def free(used: str) -> str:
    return f"x.idx NOT IN (SELECT idx_a FROM {used}) AND y.idx NOT IN (SELECT idx_b FROM {used})"


def keyed(phase: int, used: str) -> str:
    """CTE `m{phase}`: the matches of a keyed phase among what `used` leaves."""
    on, label = KEYED[phase]
    k = str(phase)
    return f"""{pairs(f"{on} AND {free(used)}", name=k)}, g{k} AS MATERIALIZED (SELECT idx_a, idx_b, sim, conf, false AS zero FROM p{k} WHERE {GATE}){greedy(k, f"g{k}", "conf DESC, sim DESC")},
m{k} AS MATERIALIZED (SELECT {k} AS phase, idx_a, idx_b, sim, conf, '{label}' AS match_type FROM g{k} JOIN w{k} USING (idx_a, idx_b))"""


def fuzzy(used: str) -> str:
    """CTE `m6`: the matches of the last phase among what `used` leaves."""
    return f"""{pairs(free(used), blend=True, name="6")}, o1 AS (SELECT *, row_number() OVER (PARTITION BY idx_a ORDER BY conf DESC, sim DESC, idx_b) AS r FROM p6 WHERE {GATE}),
o2 AS (SELECT *, row_number() OVER (PARTITION BY idx_b ORDER BY conf DESC, sim DESC, idx_a) AS r2 FROM o1 WHERE r = 1),
m6 AS MATERIALIZED (SELECT 6 AS phase, idx_a, idx_b, sim, conf, 'Heuristic' AS match_type FROM o2 WHERE r2 = 1)"""


def diff(program: str) -> str:
    """CTEs `m` (all matches), `ua` and `ub` (functions whose address no match has)."""
    out = program + EXACT + pairs("EXISTS (SELECT 1 FROM e WHERE e.idx_a = x.idx AND e.idx_b = y.idx)", name="1")
    out += ", m1 AS MATERIALIZED (SELECT 1 AS phase, idx_a, idx_b, sim, conf, 'Exact' AS match_type FROM p1)"
    for phase in (2, 3, 4, 5, 6):
        used = f"u{phase}"
        out += f", {used} AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT idx_a, idx_b FROM m{k}" for k in range(1, phase)) + ")"
        out += fuzzy(used) if phase == 6 else keyed(phase, used)
    out += ", m AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT * FROM m{k}" for k in range(1, 7)) + ")"
    for s in "ab":
        out += f", u{s} AS MATERIALIZED (SELECT * FROM f WHERE side = '{s}' AND address NOT IN (SELECT f.address FROM m JOIN f ON f.side = '{s}' AND f.idx = m.idx_{s}))"
    return out


#: Lite features: `lp` has one row per address, with the last function's values in the first one's place.
LITE = """, lf AS (SELECT side, user_id, string_agg(deg::VARCHAR || (len(ms) * 16)::VARCHAR, '' ORDER BY day) AS own FROM blk GROUP BY side, user_id),
l0 AS (SELECT f.*, f.n_bb::VARCHAR || own || size::VARCHAR AS key, regexp_replace(lower(name), '^(sub_)?(fcn_)?(fcn[.])?(function_)?(func_)?(f_)?', '') AS bare,
  row_number() OVER (PARTITION BY side, address ORDER BY idx DESC) AS back, min(idx) OVER (PARTITION BY side, address) AS first FROM f JOIN lf USING (side, user_id)),
lp AS MATERIALIZED (SELECT side, first AS idx, name, address, size, n_bb, n_instr, key, bare FROM l0 WHERE back = 1)"""
LITE_SCORE = f"((CASE WHEN x.key = y.key THEN 10.0 ELSE 0.0 END) + 7.5 * ({_SHARE.format(c='n_bb')}) + 2.0 * ({_SHARE.format(c='n_instr')}) + 8.0 + (CASE WHEN x.bare = y.bare THEN 1.0 ELSE 0.0 END)) / 28.5"
_LITE_PHASES = ((1, "x.key = y.key", 0.1, 0.6), (2, "x.name = y.name AND x.name <> 'sub_*'", 0.05, 0.5), (3, "true", 0.0, 0.4))


def lite(program: str, last: int = 3) -> str:
    """CTE `l`: the matches of the lite phases up to `last`."""
    out = program + LITE
    for phase, on, bonus, least in _LITE_PHASES[:last]:
        k, used = f"l{phase}", f"ul{phase}"
        out += f", {used} AS MATERIALIZED (" + (" UNION ALL ".join(f"SELECT idx_a, idx_b FROM ml{j}" for j in range(1, phase)) or "SELECT 0 AS idx_a, 0 AS idx_b WHERE false") + ")"
        out += f", s{k} AS MATERIALIZED (SELECT x.idx AS idx_a, y.idx AS idx_b, least(1.0, {LITE_SCORE} + {bonus}) AS sim, y.address = 0 AS zero FROM lp x JOIN lp y ON x.side = 'a' AND y.side = 'b' AND {on} AND {free(used)})"
        out += f", t{k} AS MATERIALIZED (SELECT * FROM s{k} WHERE sim > {least}){greedy(k, f't{k}', 'sim DESC')}, m{k} AS MATERIALIZED (SELECT {phase} AS phase, idx_a, idx_b, sim FROM t{k} JOIN w{k} USING (idx_a, idx_b))"
    return out + ", l AS (" + " UNION ALL ".join(f"SELECT * FROM ml{j}" for j in range(1, last + 1)) + ")"
