import random

import pytest

from pairwright.llm import pieces
from pairwright.llm.common import tokenizer_path

from . import tables

MODEL = "piece_bpe_32k.model"


@pytest.fixture(scope="module")
def coder():
    return pieces.Coder(tokenizer_path(MODEL))


def best_score(v, table, u):
    """Viterbi over the whole unit, place by place."""
    best = [0] + [pieces.NONE] * len(u)
    for t in range(1, len(u) + 1):
        for k in range(min(v.longest, t), 0, -1):
            s = table.get(u[t - k : t])
            if s is None and k == 1:
                s = v.unknown
            if s is not None:
                best[t] = max(best[t], best[t - k] + s)
    return best[-1]


def test_paths_are_best_whole_or_in_chunks(coder):
    import sentencepiece

    v = coder.v
    sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(MODEL))
    table = {sp.id_to_piece(i): int(v.scores[i]) for i in range(len(v.scores)) if v.scores[i] > pieces.NONE}
    raw = {i for i in v.bytes.values()}

    def score(ids):
        """Bytes of one character cost one unknown: as many as begin one."""
        back = {i: b for b, i in v.bytes.items()}
        return sum(v.unknown * ((back[i] & 0xC0) != 0x80) if i in raw else int(v.scores[i]) for i in ids)

    rng = random.Random(3)
    units = ["hello", "▁the", "a\0b", "日本語🙂é", "x" * 70, "internationalization" * 20, "z" * 64, "z" * 65, "z" * 128, *("".join(rng.choice("abcdeé🙂ñst\0") for _ in range(n)) for n in (3, 63, 64, 65, 200, 700))]
    for u, ids in zip(units, pieces.solve(v, units)):
        want = best_score(v, table, u)
        assert score(ids) == want
        for chunk in (17, 20, 64):
            assert score(pieces.scan_long(v, u, chunk)) == want


def test_max_plus_is_associative():
    import numpy as np

    rng = np.random.default_rng(1)
    a, b, c = (rng.integers(-1000, 0, (4, 4)) for _ in range(3))
    assert (pieces.max_plus(pieces.max_plus(a, b), c) == pieces.max_plus(a, pieces.max_plus(b, c))).all()


@pytest.mark.parametrize("text", ["", " ", "  a", "a  b\n\n c ", "▁a ▁ b▁", "\0", "a\0", "🙂" * 500, "tab\tand\x0bmore", "x" * 5000])
def test_round_trip(coder, text):
    assert coder.decode(coder.encode([text])[0]) == text


def test_frames(spark):
    df = tables.edges(spark)
    out = pieces.encode(df, tokenizer_path(MODEL)).select("doc_id", "text", "pieces.ids", "pieces.round_trip")
    rows = out.collect()
    assert all(r["ids"] is None if r["text"] is None else r["round_trip"] for r in rows)
    back = pieces.decode(out.drop("text"), tokenizer_path(MODEL)).collect()
    assert sorted((r["doc_id"] or 0, r["text"] or "") for r in back) == sorted((r[0] or 0, r[1] or "") for r in tables.EDGES)
    assert pieces.encode(tables.empty(spark), tokenizer_path(MODEL)).count() == 0


def test_ids_equal_the_library_on_a_unigram_model_of_the_same_scores(coder, tmp_path):
    """The public pieces with the scores used here, written as a unigram model that the library reads."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    with open(tokenizer_path(MODEL), "rb") as f:
        proto.ParseFromString(f.read())
    proto.trainer_spec.model_type = 1
    v = coder.v
    for i, p in enumerate(proto.pieces):
        if v.scores[i] > pieces.NONE:
            p.score = v.scores[i] / pieces.UNIT
    path = str(tmp_path / "unigram.model")
    with open(path, "wb") as f:
        f.write(proto.SerializeToString())
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    rng = random.Random(9)
    parts = ["the", "The", "internationalization", "über", "日本語", "🙂", "ñandú", "x" * 70, "0x1F4A9", "...", "def f(x):", "z" * 130, "Ж", "\u0378", "a\u0301"]
    texts = ["".join(rng.choice(parts) + " " * rng.choice([0, 0, 1, 1, 1, 2, 3, 5, 8, 17, 40]) + rng.choice(["", "", "\n", "\t"]) for _ in range(rng.randint(0, 40))) for _ in range(300)]
    texts += [" ", "  ", "\n\n ", " " * 70 + "x", "x" + " " * 200, tables.prose(rng, 800)]
    want = library.encode(texts)
    got = coder.encode(texts)
    assert [g.tolist() for g in got] == want
    unigram = pieces.Coder(path)  # and the model itself can be read: its scores are log probabilities
    assert [g.tolist() for g in unigram.encode(texts)] == want
    assert all(coder.decode(g) == t for g, t in zip(got, texts))
