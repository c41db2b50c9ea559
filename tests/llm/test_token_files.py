import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pairwright.llm import token_files as tf
from pairwright.llm.common import shared_folder, tokenizer_path

from . import tables

FILE = "word_bpe_49k.json"


@pytest.fixture(scope="module")
def tokens():
    return tf.Tokens(tokenizer_path(FILE))


def plain(tokens, texts):
    return [e.ids + [tf.END_ID] for e in tokens.tokenizer.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def test_ids_equal_the_library(tokens):
    texts = ["", "  ", "a.", "a..", "é.", "x,.", "3.", "İ.ΣΑΣ, ΣΑΣ", "it's. 'S", "<|endoftext|>a <|startoftext|>.", "á. é ́x", "a\tb\x0bc\x1cd\x85e f", "Ⅷ.", "a.b,c", "日本.", "🙂,", "Å x", "ﬁ,", "1,000.", tables.LONG, None, "a\0b"]
    ids, n = tokens.encode(pa.array(texts))
    ends = np.cumsum(n)
    assert [ids[e - k : e].tolist() for k, e in zip(n, ends)] == plain(tokens, texts)


def test_mixed_strings_equal_the_library_in_any_order():
    """Case variants of special tokens, signs, white space: a fresh table meets them in each order."""
    rng = random.Random(5)
    parts = ["<|endoftext|>", "<|ENDOFTEXT|>", "<|EndOfText|>", "<|startoftext|>", "<|STARTOFTEXT|>", "<", "|>", "The", "the", "THE", "it's", "IT'S", " ", " ", "\n", ".", ",", "3", "É", "é", "e\u0301", "İ", "日本", "🙂", "\x85"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 7))) for _ in range(10_000)]
    own = tf.Tokens(tokenizer_path(FILE))
    want = plain(own, texts)
    for order in (list(range(len(texts))), list(range(len(texts)))[::-1]):
        fresh = tf.Tokens(tokenizer_path(FILE))
        for k in range(0, len(order), 997):
            at = order[k : k + 997]
            ids, n = fresh.encode(pa.array([texts[i] for i in at]))
            assert [ids[e - m : e].tolist() for m, e in zip(n, np.cumsum(n))] == [want[i] for i in at]


@pytest.mark.parametrize("file", [FILE, "byte_bpe_50k.json"])
def test_a_tokenizer_of_another_kind_encodes_whole_texts(file):
    own = tf.Tokens(tokenizer_path(file))
    assert own.whole == (file != FILE)
    texts = ["The the  THE\n\n x.", "", "<|endoftext|> <|ENDOFTEXT|>", None, " a"]
    ids, n = own.encode(pa.array(texts))
    assert [ids[e - k : e].tolist() for k, e in zip(n, np.cumsum(n))] == plain(own, texts)


@pytest.mark.parametrize("ids", [[1], [1, 1, 1], list(range(600)) * 3, [5] * 20_000, np.random.default_rng(0).integers(0, 49408, 30_000).tolist(), [0, 65535]])
def test_segments_read_back(ids):
    ids = np.array(ids)
    docs, n, got = tf.read_segment(tf.write_segment([None, -5], np.array([1, len(ids) - 1]), ids))
    assert (docs, n.tolist()) == ([None, -5], [1, len(ids) - 1]) and (got == ids).all()


@settings(max_examples=25, deadline=None)
@given(st.lists(st.integers(0, 60) | st.integers(0, 65535), min_size=1, max_size=400), st.integers(1, 6))
def test_any_ids_read_back(ids, times):
    ids = np.array(ids * times)
    assert (tf.read_segment(tf.write_segment([7], np.array([len(ids)]), ids))[2] == ids).all()


def test_repeating_ids_shrink_and_damage_shows():
    ids = np.tile(np.random.default_rng(1).integers(0, 49408, 300), 40)
    raw = tf.write_segment([1], np.array([len(ids)]), ids)
    assert len(raw) < len(ids)
    for at in (0, 60, len(raw) - 100):
        bad = bytearray(raw)
        bad[at] ^= 0x55
        with pytest.raises(ValueError):
            tf.read_segment(bytes(bad))


def test_files_in_order(spark, tokens):
    for df, rows in ((tables.edges(spark), tables.EDGES), (tables.empty(spark), [])):
        folder = shared_folder(spark, "test-tokens")
        tf.write_files(spark, df, folder, tokenizer_path(FILE))
        order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
        want, start = [], 0
        for r, ids in zip(order, plain(tokens, [r[1] for r in order])):
            want.append((r[0], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
            start += len(ids)
        assert sorted((tuple(r) for r in tf.read_files(spark, folder).collect()), key=str) == sorted(want, key=str)
        assert sorted(len(r.ids) for r in tf.read_ids(spark, folder).collect()) == sorted(w[2] for w in want)
