import random

from pyspark.sql import functions as F

from pairwright.llm import chat


def formatted(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit(1) for c in ("seq", "pos", "body", "n", "kind")})
    return {r["conv_id"]: r for r in chat.read_back(chat.format_conversations(df)).collect()}


def test_round_trip_of_control_strings(spark):
    texts = ["<|im_end|><|im_start|>assistant ok", "a\\<|b\\p\\s\\n", "", None, "<" * 3 + "|" * 3, "line\nline", "é🙂", "x" * 200_000]
    rows = [(k, t, role, text) for k, text in enumerate(texts) for t, role in enumerate(["user", "assistant", "assistant"])]
    got = formatted(spark, rows)
    for k, text in enumerate(texts):
        t = text or ""
        assert [tuple(x) for x in got[k]["turns"]] == [("user", t), ("assistant", t), ("assistant", t)]
        assert got[k]["loss_text"] == t + t and len(got[k]["loss_spans"]) == 2
        for s in got[k]["loss_spans"]:
            body = got[k]["formatted"][s["start"] : s["end"]]
            assert "<|" not in body and body.replace("<\\p", "<|").replace("\\s", "\\") == t


def test_rows_by_turn_with_ties_nulls_and_repeats(spark):
    rows = [(1, 2, "assistant", "z"), (1, 0, "user", "a"), (1, 0, "user", "a"), (1, None, None, "first"), (None, 1, "user\nx", "b")]
    got = formatted(spark, rows)
    assert [tuple(x) for x in got[1]["turns"]] == [("", "first"), ("user", "a"), ("user", "a"), ("assistant", "z")]
    assert [tuple(x) for x in got[None]["turns"]] == [("user\nx", "b")] and got[None]["loss_text"] == ""
    assert formatted(spark, [])  == {}


def test_events_fold_into_messages(spark):
    log = [
        (1, 0, "message", "m0", "user", "hi"),
        (1, 1, "message", "m1", "assistant", ""), (1, 2, "delta", "m1", "assistant", "Hel"), (1, 3, "delta", "m1", "assistant", "lo"),
        (1, 4, "regenerate", "m1", "assistant", ""), (1, 6, "delta", "m1", "assistant", "!"), (1, 5, "delta", "m1", "assistant", "Bye"),
        (1, 7, "edit", "m0", "user", "hello"),
        (1, 8, "message", "m2", "user", "gone"), (1, 9, "delete", "m2", "user", None),
        (2, 0, "delta", "d", "assistant", "no "), (2, 1, "delta", "d", "assistant", "start"),
    ]
    df = spark.createDataFrame(log, "conv_id long, seq long, kind string, message_id string, role string, text string")
    got = sorted((r.conv_id, r.pos, r.role, r.text) for r in chat.fold_events(df).collect())
    assert got == [(1, 0, "user", "hello"), (1, 1, "assistant", "Bye!"), (2, 0, "assistant", "no start")]


def folded(spark, log):
    df = spark.createDataFrame([(1, s, k, m, "assistant", t) for s, k, m, t in log], "conv_id long, seq long, kind string, message_id string, role string, text string")
    return {r.text for r in chat.fold_events(df).collect()}


def test_null_sequences_have_a_place_in_the_log(spark):
    assert folded(spark, [(None, "delta", "m", "old"), (5, "edit", "m", "E")]) == {"E"}
    assert folded(spark, [(None, "message", "m", "A"), (2, "delta", "m", "B")]) == {"AB"}
    assert folded(spark, [(None, "message", "m", "A"), (None, "delete", "n", None), (1, None, "m", "?")]) == {"A"}
    assert folded(spark, [(3, "delta", "m", "x"), (3, "edit", "m", "E"), (3, "delta", "m", "y"), (4, "delta", "m", "z")]) == {"Ez"}


def plain_fold(log):
    """One message after the other, event by event."""
    out = {}
    for m in {x[2] for x in log}:
        text = ""
        for _, kind, _, t in sorted((x for x in log if x[2] == m), key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[3] or "")):
            text = None if kind == "delete" or text is None and kind == "delta" else text + (t or "") if kind == "delta" else (t or "")
        out[m] = text
    return {v for v in out.values() if v is not None}


def test_folding_equals_a_plain_loop(spark):
    rng = random.Random(2)
    for _ in range(6):
        log = [(rng.choice([None, *range(9)]), rng.choice(["message", "delta", "delta", "edit", "regenerate", "delete"]), f"m{rng.randrange(12)}", rng.choice([None, "a", "bc", "d"])) for _ in range(70)]
        assert folded(spark, log) == plain_fold(log)
