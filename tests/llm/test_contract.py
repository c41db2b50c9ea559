"""The registered queries: against SQL where it can say them, and the pipeline against a brute-force version."""

import glob
import hashlib
import math
import os
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from pairwright.llm import decontaminate, queries, secrets
from tests.test_queries import canonical

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    import duckdb

    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.execute(f"create view {os.path.basename(p).split('.')[0]} as select * from '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_equals_sql(spark, con, name):
    assert canonical(queries.QUERIES[name](spark, SF).toPandas()) == canonical(con.execute(queries.ORACLES[name]).df())


def rows_of(spark, name):
    return {r.doc_id: r for r in queries.QUERIES[name](spark, SF).collect()}


@pytest.fixture(scope="module")
def docs(con):
    return con.execute("select doc_id, text, lang from documents order by doc_id").fetchall()


def fold(doc_id, n):
    return zlib.crc32(str(doc_id).encode()) % n == 2


def test_op1_columns(spark, docs):
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), t or "")) + [None]
    count = Counter(w for d, t, _ in docs if not fold(d, 7) for w in words(t))
    n, v = sum(count.values()), len(count)
    got = rows_of(spark, "op1_lm_scoring")
    assert set(got) == {d for d, *_ in docs}
    better = 0.0
    for d, t, _ in docs:
        r, w = got[d], words(t)
        base = sum(math.log10((count[x] + 1) / (n + v + 1)) for x in w)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (fold(d, 7), len(w), sum(count[x] > 0 for x in w), n)
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score < 0
        better += r.score - base if r.held_out else 0
    assert better > 0


def test_op2_columns(spark, docs):
    from .test_secrets import base

    got = rows_of(spark, "op2_secret_scans")
    for d, t, _ in docs:
        r, spans = got[d], base(t or "")
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(x[0] == k for x in spans) for k in ("assign", "access", "hex")]
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        every = [x.split(":") for x in r.spans.split(",") if x]
        assert ",".join(":".join(x) for x in every if x[0] != "cnn") == joined
        assert [int(x[1]) for x in every] == sorted(int(x[1]) for x in every)


def test_op3_columns(spark, docs):
    got = rows_of(spark, "op3_sharding")
    places, sizes = {}, Counter()
    for d, t, _ in docs:
        r, raw = got[d], (t or "").encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(raw) + 1 if t is not None else 1, zlib.crc32(raw), "bytes", None)
        places.setdefault(r.shard, []).append(r.slot)
        sizes[r.shard] += r["size"]
    assert set(places) <= set(range(8)) and all(sorted(v) == list(range(len(v))) for v in places.values())
    assert max(sizes.values()) - min(sizes[k] for k in range(8)) <= max(0.02 * sum(sizes.values()) / 8, max(len((t or "").encode()) for _, t, _ in docs) + 1)


def test_op7_columns(spark, docs):
    got = rows_of(spark, "op7_language_id")
    known = {lang for *_, lang in docs if lang}
    right = []
    for d, t, lang in docs:
        r = got[d]
        assert r.held_out == fold(d, 4) and 0 <= r.score <= 1
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in t or "")) and r.lang_pred in known | {"und"}
        if r.held_out and lang and r.lang_pred != "und":
            right.append(r.lang_pred == lang)
    assert sum(right) >= 0.95 * len(right)


def test_op8_columns(spark, docs):
    from pairwright.llm.common import tokenizer_path
    from pairwright.llm.pieces import coder

    c = coder(tokenizer_path(queries.PIECE_MODEL))
    got = rows_of(spark, "op8_sentencepiece")
    for d, t, _ in docs:
        r = got[d]
        assert (r.ids is None) == (t is None) and r.n_pieces == len(r.ids or [])
        assert t is None or r.round_trip and c.decode(np.array(r.ids, int)) == t


def test_op9_columns(spark, docs):
    from pairwright.llm import fingerprints as fp

    got = rows_of(spark, "op9_document_fingerprints")
    seen = {}
    for (d, t, _), (e, u, _) in zip(docs, docs[1:] + docs[:1]):
        r, t, u = got[d], t or "", u or ""
        new = t[: len(t) - len(t) // 2] + u[: len(t) // 2]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(new.encode()).hexdigest())
        assert fp.compare(r.fingerprint, r.edited_fingerprint) == r.near_edited and fp.compare(r.fingerprint, got[e].fingerprint) == r.near_next
        assert seen.setdefault(t, r.fingerprint) == r.fingerprint
        p = fp.Prints(*fp.paragraph_keys(pa.array([new])))
        assert p.written(0) == r.edited_fingerprint


def test_op10_columns(spark, docs):
    from tokenizers import Tokenizer

    from pairwright.llm.common import tokenizer_path

    own = Tokenizer.from_file(tokenizer_path(queries.ID_TOKENIZER))
    got, start = rows_of(spark, "op10_token_files"), 0
    for (d, t, _), e in zip(docs, own.encode_batch([t or "" for _, t, _ in docs], add_special_tokens=False)):
        ids = np.array([*e.ids, 1], "<u4")
        assert tuple(got[d]) == (d, start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_benchmark_passages_are_found(spark, con):
    docs, items = con.execute("select doc_id, text from documents").fetchall(), con.execute("select item_id, text from benchmark").fetchall()
    whole = {(d, i) for d, t in docs for i, s in items if decontaminate.fold(s) in decontaminate.fold(t)}
    got = {(r.doc_id, r.item_id) for r in queries.QUERIES["op4_benchmark_decontamination"](spark, SF).collect()}
    assert whole <= got and len(got - whole) <= 2


def test_pipeline_equals_brute_force(spark, con):
    import corpus_pipeline
    from pairwright.llm.pieces import coder
    from pairwright.llm.common import tokenizer_path

    docs = con.execute("select doc_id, text from documents").fetchall()
    items = [decontaminate.fold(t) for (t,) in con.execute("select text from benchmark").fetchall()]
    first = {r[0] for r in con.execute(f"select component_id from ({queries.OP5_SQL})").fetchall()}
    model = secrets.train()
    import pyarrow as pa

    want = {}
    for d, t in docs:
        if t and re.search(r"[^\W\d_]", t) and d in first and not any(i in decontaminate.fold(t) for i in items):
            at, out = 0, ""
            for _, a, b, _ in secrets.scan_texts(model, pa.array([t]))[0]:
                if a >= at:
                    out += t[at:a] + "[SECRET]"
                at = max(at, b)
            want[d] = out + t[at:]
    c = coder(tokenizer_path(queries.PIECE_MODEL))
    import numpy as np

    rows = corpus_pipeline.run(spark, SF).collect()
    assert {r.doc_id: c.decode(np.array(r.ids)) for r in rows} == want and all(r.round_trip for r in rows)
    assert len(rows) == len(want)


def test_stages_take_edge_tables(spark):
    import corpus_pipeline

    from . import tables

    for df in (tables.edges(spark), tables.empty(spark)):
        from pyspark.sql import functions as F

        docs = df.withColumns({"source": F.lit("s"), "n_chars": F.lit(1).cast("long")})
        for name, stage in corpus_pipeline.STAGES[:-1]:
            docs = corpus_pipeline.stored(spark, stage(spark, docs, SF), name)
            assert docs.columns == [*df.columns, "source", "n_chars"]
        assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == docs.count()
