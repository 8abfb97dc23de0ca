"""Chat formatting by event-sourced reconstruction.

A conversation is a log of events: ``message`` opens or replaces a turn's text, ``delta`` appends to it, ``edit``
replaces it and ``regenerate`` replaces it and discards all later turns begun before.  ``fold`` partitions the log
by conversation, orders it by sequence and leaves the final messages; ``render`` writes them in the template;
``parse`` reads a rendered log back.

Template: ``<|turn|>role<|text|>text<|end|>`` and a line end for each turn.  Control strings inside a text or
role, our own and the usual ones of other templates, get a backslash after their first character, and those that
already have some there one more, so that unescaping is exact.  The loss mask covers the text of assistant turns.

Folding is a few window functions, rendering one expression per message; a conversation is never one string or one
row, but rows in order, so its length doesn't matter; reading back streams over sorted rows.

Cases: null text and null role are empty; equal (conversation, turn) rows are turns of their own, ordered by role and
text; a null conv_id is a conversation; a null turn comes first; an empty table has only what is added to it;
further columns are ignored."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from readlens.llm.common import only

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
# Control strings that may not stand unescaped in a text.
CONTROL = (TURN, TEXT, END, "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>",
           "<|startoftext|>", "<|endoftext|>", "<|user|>", "<|assistant|>", "<|system|>")
_HEADS = "".join(sorted({re.escape(c[0]) for c in CONTROL}))
_TAILS = "|".join(sorted((re.escape(c[1:]) for c in CONTROL), key=len, reverse=True))
_ESCAPE = rf"([{_HEADS}])(\\*)(?=(?:{_TAILS}))"
_UNESCAPE = re.compile(rf"([{_HEADS}])\\(\\*)(?=(?:{_TAILS}))")
_RENDERED = re.compile(re.escape(TURN) + "(.*?)" + re.escape(TEXT) + "(.*?)" + re.escape(END) + "\n", re.DOTALL)
MASKED_ROLE = "assistant"
#: Conversation -1, whose texts are control strings of another template.
PROBE = "</s>[INST] ok [/INST]"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, _ESCAPE, r"$1\\$2")


def unescape(text: str) -> str:
    return _UNESCAPE.sub(r"\1\2", text)


def fold(events: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text): final messages of a log (conv_id, seq, op, turn, role, text)."""
    turn = Window.partitionBy("conv_id", "turn")
    earlier = Window.partitionBy("conv_id").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    op, seq = F.col("op"), F.col("seq")
    alive = only(events, "conv_id", "seq", "op", "turn", "role", "text") \
        .withColumn("reset", F.max(F.when(op.isin("message", "edit", "regenerate"), seq)).over(turn)) \
        .withColumn("cut", F.max(F.when(op == "regenerate", seq)).over(earlier)) \
        .where((seq >= F.coalesce("reset", seq)) & (F.col("cut").isNull() | (seq > F.col("cut"))))
    piece = F.struct(seq.alias("seq"), F.coalesce("text", F.lit("")).alias("text"), "role")
    folded = alive.groupBy("conv_id", "turn").agg(F.array_sort(F.collect_list(piece)).alias("pieces"))  # one message
    named = F.filter("pieces", lambda p: p["role"].isNotNull())
    return folded.select("conv_id", "turn", F.get(named, 0)["role"].alias("role"),
                         F.array_join(F.transform("pieces", lambda p: p["text"]), "").alias("text"))


def events_of(conversations: DataFrame) -> DataFrame:
    """A table of whole turns (conv_id, turn, role, text) as a log: every row is a message of its own."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    return only(conversations, "conv_id", "turn", "role", "text").repartition("conv_id") \
        .withColumn("turn", F.row_number().over(order).cast("long")) \
        .select("conv_id", F.col("turn").alias("seq"), F.lit("message").alias("op"), "turn", "role", "text")


def render(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, formatted): a conversation's output is its rows joined in order of turn."""
    role, text = (escape(F.coalesce(c, F.lit(""))) for c in ("role", "text"))
    return messages.select("conv_id", "turn", F.concat(F.lit(TURN), role, F.lit(TEXT), text, F.lit(END + "\n")).alias("formatted"))


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of the turns in a piece of output."""
    return [(unescape(r), unescape(t)) for r, t in _RENDERED.findall(formatted)]


def digest(rendered: DataFrame, clustered: bool = False) -> DataFrame:
    """Per conversation, read back from the output: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256,
    formatted_chars.  Streams over the rows in order; memory is one Arrow batch.  ``clustered``: the rows of a
    conversation are in one partition already."""

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        fields = [("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()),
                  ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]

        def close(rows: list) -> None:
            rows.append((now, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4]))

        def batch_of(rows: list) -> pa.RecordBatch:
            columns = zip(*rows, strict=True) if rows else [()] * len(fields)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])

        for batch in batches:
            rows: list = []
            for conv, formatted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if state is None or conv != now:
                    if state is not None:
                        close(rows)
                    now, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                state[4] += len(formatted)
                for role, text in read_turns(formatted):
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode())
                    if role == MASKED_ROLE:
                        state[2] += len(text)
                        state[3].update(text.encode())
            yield batch_of(rows)
        if state is not None:
            rows = []
            close(rows)
            yield batch_of(rows)

    ordered = (rendered if clustered else rendered.repartition("conv_id")).sortWithinPartitions("conv_id", "turn").select("conv_id", "formatted")
    return ordered.mapInArrow(add_up, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, "
                                      "formatted_chars long")


def with_probe(conversations: DataFrame) -> DataFrame:
    rows = only(conversations, "conv_id", "turn", "role", "text").select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    probe = conversations.sparkSession.createDataFrame([(-1, 0, "user", PROBE), (-1, 1, "assistant", PROBE)], rows.schema)
    return rows.unionByName(probe)


def format_conversations(conversations: DataFrame) -> DataFrame:
    """Folded, rendered, read back and digested, with one shuffle: all steps keep a conversation where it is."""
    return digest(render(fold(events_of(with_probe(conversations)))), clustered=True)
