"""Chat formatting from an event log, DataFrame functions only.

`fold_events` rebuilds final messages: a log is partitioned by conversation and message, sorted by sequence, and
folded. Event kinds: `message`, `edit` and `regenerate` set a message's text (a regeneration drops what was streamed
before it), `delta` appends to it, `delete` removes the message (what is streamed to it afterwards is lost). `render` writes one text per conversation with turn
marks, and the spans of the assistant's texts (the loss mask). `read_back` parses such a text again.

Control strings inside roles and texts are escaped reversibly: a backslash becomes `\\s`, `<|` becomes `<\\p`, and in
roles a line feed becomes `\\n`; so an escaped text never holds `<|`.

Defined cases: null role or text: empty; null sequence numbers sort first, in the log and among messages; equal ones go
by kind, then text in the log, by role, then text among messages; events of an unknown or null kind are passed over;
repeated rows are kept as turns of their own; a null conversation or message id is one; an empty table gives no rows;
texts of any length are kept whole; further columns are ignored, whatever their names. One conversation is one output row, so its texts meet in one task by definition of the result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
RESETS = ("message", "edit", "regenerate", "delete")


def escape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\s")), F.lit("<|"), F.lit("<\\p"))


def unescape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("<\\p"), F.lit("<|")), F.lit("\\s"), F.lit("\\"))


def escape_role(c: Column) -> Column:
    return F.replace(escape(c), F.lit("\n"), F.lit("\\n"))


def unescape_role(c: Column) -> Column:
    return unescape(F.replace(c, F.lit("\\n"), F.lit("\n")))


def events_of_rows(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Finished turns as a log: each row is a message of its own."""
    return rows.select(F.col(conv).alias("conv_id"), F.col(turn).cast("long").alias("seq"), F.lit("message").alias("kind"), F.monotonically_increasing_id().cast("string").alias("message_id"), F.col(role).alias("role"), F.col(text).alias("text"))


def fold_events(events: DataFrame) -> DataFrame:
    """(conv_id, seq, kind, message_id, role, text) to final messages (conv_id, pos, role, text).

    A message's log is folded by place in its sorted order, so null and equal sequence numbers have one too: what
    stands after the last event that sets or removes the text is streamed onto it.
    """
    e = F.struct("seq", "kind", F.coalesce("text", F.lit("")).alias("text"))
    folded = events.groupBy("conv_id", "message_id").agg(F.min("seq").alias("pos"), F.max("role").alias("role"), F.array_sort(F.collect_list(e)).alias("log"))
    places = F.transform("log", lambda x, i: F.when(x["kind"].isin(*RESETS), i + 1).otherwise(0))
    folded = folded.withColumn("at", F.array_max(places))  # from 1; 0: only deltas
    last = F.get("log", F.col("at") - 1)
    rest = F.slice("log", F.col("at") + 1, F.size("log"))
    tail = F.array_join(F.transform(F.filter(rest, lambda x: x["kind"] == "delta"), lambda x: x["text"]), "")
    kept = folded.where((F.col("at") == 0) | (last["kind"] != "delete"))
    return kept.select("conv_id", "pos", F.coalesce("role", F.lit("")).alias("role"), F.concat(F.coalesce(last["text"], F.lit("")), tail).alias("text"))


def render(messages: DataFrame) -> DataFrame:
    """conv_id, formatted, loss_spans (code points from 0, end exclusive), n_turns."""
    head = F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n"))
    m = messages.select("conv_id", "pos", "role", "text", head.alias("head"), escape(F.col("text")).alias("body"))
    m = m.withColumn("len", F.char_length("head") + F.char_length("body") + len(END) + 1)
    order = Window.partitionBy("conv_id").orderBy("pos", "role", "text")
    before = F.sum("len").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("len")
    m = m.withColumn("start", before + F.char_length("head")).withColumn("n", F.row_number().over(order))
    turn = F.struct("n", "head", "body", F.when(F.col("role") == "assistant", F.struct(F.col("start").cast("long").alias("start"), (F.col("start") + F.char_length("body")).cast("long").alias("end"))).alias("span"))
    g = m.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    text = F.array_join(F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(END + "\n"))), "")
    return g.select("conv_id", text.alias("formatted"), F.filter(F.transform("turns", lambda t: t["span"]), lambda s: s.isNotNull()).alias("loss_spans"))


def read_back(rendered: DataFrame) -> DataFrame:
    """Adds `turns` (role, text) and `loss_text`, both from the formatted text alone and its spans."""
    split = F.split("formatted", r"<\|im_start\|>")
    parts = F.slice(split, F.lit(2), F.greatest(F.size(split) - 1, F.lit(0)))

    def turn(p: Column) -> Column:
        role = F.substring_index(p, "\n", 1)
        body = F.substr(p, F.char_length(role) + 2, F.char_length(p) - F.char_length(role) - 2 - len(END))
        return F.struct(unescape_role(role).alias("role"), unescape(body).alias("text"))

    loss = F.array_join(F.transform("loss_spans", lambda s: unescape(F.substr("formatted", (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))), "")
    return rendered.withColumn("turns", F.transform(parts, turn)).withColumn("loss_text", loss)


def format_conversations(rows: DataFrame) -> DataFrame:
    return render(fold_events(events_of_rows(rows)))
