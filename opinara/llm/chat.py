"""Chat formatting with Spark expressions only.

The turns of a conversation are collected as structs and sorted; adjacent turns
of the same role are merged into one block by array functions; the blocks are
concatenated:

    <|role|>user<|turn|>text<|turn|>text<|end|><|role|>assistant<|turn|>text<|end|>

Inside roles and texts, anything that reads like a control string gets a
backslash after its ``<`` (and one more, if it has some already), so marks can
be told from text and every text can be restored.  The loss mask lists the code
point spans of the assistant's texts in the formatted string.

Defined cases: NULL roles and texts count as empty; turns come by number, NULL
first, ties by role and text; repeated rows are turns of their own; a NULL
conversation is a conversation of its own; an empty table gives no rows; other
columns are ignored.  A conversation is one row of output and has to fit one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinara.llm.columns import let, whole

ROLE, TURN, END = "<|role|>", "<|turn|>", "<|end|>"
LEARNED = "assistant"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|(role|turn|end)\|>", r"<\\$1|$2|>")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|(role|turn|end)\|>", r"<$1|$2|>")


def _shifted(turns: Column) -> Column:
    """The array moved on by one, so that each turn meets the one before it."""
    return F.concat(F.array(F.lit(None).cast("string")), F.transform(F.slice(turns, 1, F.size(turns) - 1), lambda t: t["role"]))


def _segments(turns: Column) -> Column:
    """Per turn: what stands before its text, and the text, both as formatted."""
    return F.zip_with(
        turns,
        _shifted(turns),
        lambda t, before: F.struct(
            F.when(before.eqNullSafe(t["role"]), F.lit(TURN))
            .otherwise(F.concat(F.when(before.isNull(), F.lit("")).otherwise(F.lit(END)), F.lit(ROLE), escape(t["role"]), F.lit(TURN)))
            .alias("head"),
            escape(t["text"]).alias("body"),
            (t["role"] == LEARNED).alias("learned"),
        ),
    )


def _length(s: Column) -> Column:
    return F.char_length(s["head"]).cast("long") + F.char_length(s["body"])


def _spans(segments: Column) -> Column:
    """Start (from 1) and length of the learned texts.

    Running sums in two levels: over parts of about the square root of the
    number of segments, then within each part, since an array that grows by
    one costs its length.
    """
    nothing = F.array().cast("array<struct<start:bigint,length:bigint>>")

    def step(state, s):
        begin = state["at"] + F.char_length(s["head"])
        span = F.array(F.struct(begin.alias("start"), F.char_length(s["body"]).cast("long").alias("length")))
        return F.struct(
            (state["at"] + _length(s)).alias("at"), F.when(s["learned"], F.concat(state["spans"], span)).otherwise(state["spans"]).alias("spans")
        )

    def within(part, start):
        return F.aggregate(part, F.struct(start.alias("at"), nothing.alias("spans")), step, lambda state: state["spans"])

    def of_parts(parts):
        totals = F.transform(parts, lambda part: F.aggregate(part, F.lit(0).cast("long"), lambda total, s: total + _length(s)))
        starts = F.aggregate(
            totals,
            F.struct(F.lit(1).cast("long").alias("at"), F.array().cast("array<bigint>").alias("starts")),
            lambda state, total: F.struct((state["at"] + total).alias("at"), F.concat(state["starts"], F.array(state["at"])).alias("starts")),
            lambda state: state["starts"],
        )
        return let(starts, lambda known: F.flatten(F.zip_with(parts, known, within)))

    def cut(width):
        firsts = F.sequence(F.lit(1), F.size(segments), width)
        return let(F.transform(firsts, lambda first: F.slice(segments, first, width)), of_parts)

    return let(F.ceil(F.sqrt(F.size(segments))).cast("int"), cut)


def format_chats(turns: DataFrame) -> DataFrame:
    """Per conversation: ``conv_id``, ``formatted`` and ``loss_mask`` (spans of code points)."""
    collected = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.struct(F.col("turn").cast("long").alias("turn"), whole("role").alias("role"), whole("text").alias("text")).alias("one"),
    )
    chats = collected.groupBy("conv_id").agg(F.collect_list("one").alias("turns"))
    made = let(
        F.array_sort(F.col("turns")),
        lambda sorted_turns: let(
            _segments(sorted_turns),
            lambda s: F.struct(
                F.concat(F.array_join(F.transform(s, lambda x: F.concat(x["head"], x["body"])), ""), F.lit(END)).alias("formatted"),
                _spans(s).alias("loss_mask"),
            ),
        ),
    )
    return chats.select("conv_id", made.alias("made")).select("conv_id", "made.formatted", "made.loss_mask")


def read_turns(formatted: Column) -> Column:
    """Array of (role, text), one per turn, read back from a formatted string."""
    blocks = F.filter(F.split(formatted, r"<\|end\|>"), lambda b: b != "")

    def of_block(block):
        return let(
            F.split(block, r"<\|turn\|>"),
            lambda parts: F.transform(
                F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))),
                lambda text: F.struct(
                    unescape(F.substring(parts[0], len(ROLE) + 1, 1 << 30)).alias("role"), unescape(text).alias("text")
                ),
            ),
        )

    return F.flatten(F.transform(blocks, of_block))


def learned_text(formatted: Column, loss_mask: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(
        F.transform(loss_mask, lambda s: unescape(F.substring(formatted, s["start"].cast("int"), s["length"].cast("int")))), ""
    )
