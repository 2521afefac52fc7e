"""Repair of conversation structure: faults are marked by Spark, roles repaired by generalised LR.

A row's first fault counts: ``blank`` (white space only), ``duplicate`` (role
and text were met earlier in the conversation), ``truncated`` (does not end in
a full stop, exclamation or question mark).  Duplicates are found by numbering
the rows of a conversation that say the same, which moves rows by conversation,
role and text.  Then the rows are dealt by conversation and sorted, and each
task reads them as a stream: a conversation's rows are never held together, so
one that has a third of all rows costs its task time and no memory.  (Its
repair and the digest of its repaired text depend on the rows in order.)  What
grows with a conversation is its audit, one letter a row, which is part of the
result.

Defined cases: NULL roles and texts count as one space; rows come by turn, NULL
first, ties by role and text; repeated rows are duplicates of the first; the
NULL conversation is one conversation; role initials other than those of
``system``, ``user`` and ``assistant`` fit nowhere and are rewritten or deleted;
an empty table gives no rows; other columns are ignored, whatever their names.
Long texts pass as they are.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opinara.llm import role_grammar
from opinara.llm.columns import SPACE

# Pairs of neighbouring role initials that are right.
LEGAL = ("su", "ua", "au")

_RESULT = (
    "conv_id bigint, gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, "
    "cost bigint, audit string, repaired_sha256 string"
)
_TURN = "conv_id bigint, row bigint, turn bigint, role string, text string, fault string"


def spaced(column: str) -> Column:
    """A text column in which NULL is one space."""
    return F.coalesce(F.col(column).cast("string"), F.lit(" "))


def marked(turns: DataFrame) -> DataFrame:
    """``conv_id``, ``turn``, ``role``, ``text`` and ``fault`` of every row."""
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), spaced("role").alias("role"), spaced("text").alias("text")
    )
    said = F.row_number().over(Window.partitionBy("conv_id", "role", "text").orderBy(F.col("turn").asc_nulls_first()))
    trimmed = F.trim(F.col("text"), F.lit(SPACE))
    fault = (
        F.when(trimmed == "", "blank")
        .when(F.col("nth") > 1, "duplicate")
        .when(~F.substring(trimmed, -1, 1).isin(".", "!", "?"), "truncated")
    )
    return rows.withColumn("nth", said).select("conv_id", "turn", "role", "text", fault.alias("fault"))


def _in_order(rows: DataFrame) -> DataFrame:
    # Of equal rows the faultless one comes first.
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text", F.col("fault").asc_nulls_first())


class _Conversation:
    """Counts and the repair of the conversation whose rows a task is reading."""

    def __init__(self, conv_id):
        self.conv_id = conv_id
        self.counts = {"blank": 0, "duplicate": 0, "truncated": 0}
        self.illegal = self.distinct = 0
        self.first = self.last = self.role = None
        self.repair = role_grammar.Repair(hashlib.sha256())

    def take(self, turn, role: str, text: str, fault: str | None) -> None:
        if fault:
            self.counts[fault] += 1
        if turn is not None and turn != self.last:
            self.first = turn if self.first is None else self.first
            self.last = turn
            self.distinct += 1
        if self.role is not None and self.role[:1] + role[:1] not in LEGAL:
            self.illegal += 1
        self.role = role
        self.repair.row(role, text, fault)

    def result(self) -> tuple:
        gaps = self.last - self.first + 1 - self.distinct if self.distinct else 0
        cost, audit, digest = self.repair.best()
        return self.conv_id, gaps, *self.counts.values(), self.illegal, cost, audit, digest.hexdigest()


def repair(rows: DataFrame) -> DataFrame:
    """One row a conversation of ``marked`` rows: counts of faults, cost, audit, digest of the repaired lines ``role:text``."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in _RESULT.split(", ")]
        kinds = [pa.string() if c.endswith("string") else pa.int64() for c in _RESULT.split(", ")]
        current, done = None, []

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done), kinds)], names)

        for batch in batches:
            for conv_id, turn, role, text, fault in zip(*(c.to_pylist() for c in batch.columns)):
                if current is None or conv_id != current.conv_id:
                    if current is not None:
                        done.append(current.result())
                    current = _Conversation(conv_id)
                current.take(turn, role, text, fault)
            if done:
                yield out()
                done = []
        if current is not None:
            done.append(current.result())
            yield out()

    return _in_order(rows).mapInArrow(read, _RESULT)


def _numbered(rows: DataFrame) -> DataFrame:
    """The rows in order, numbered from 0 in each conversation."""

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        started, current, at = False, None, 0
        for batch in batches:
            places = []
            for conv_id in batch.column(0).to_pylist():
                if not started or conv_id != current:
                    started, current, at = True, conv_id, 0
                places.append(at)
                at += 1
            columns = dict(zip(batch.schema.names, batch.columns)) | {"row": pa.array(places, pa.int64())}
            names = [c.split()[0] for c in _TURN.split(", ")]
            yield pa.RecordBatch.from_arrays([columns[n] for n in names], names)

    return _in_order(rows).mapInArrow(number, _TURN)


def _edits(audits: DataFrame) -> DataFrame:
    """One row an edit: ``conv_id``, its ``place`` in the audit, the ``letter``, and the number ``row`` of the row it is of."""

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for conv_id, audit in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for begin in range(0, len(audit), 1 << 16):
                    before = begin - audit.count("I", 0, begin)
                    rows, letters = [], audit[begin : begin + (1 << 16)]
                    for letter in letters:
                        rows.append(None if letter == "I" else before)
                        before += letter != "I"
                    n = len(letters)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([conv_id] * n, pa.int64()), pa.array(range(begin, begin + n), pa.int64()), pa.array(list(letters)), pa.array(rows, pa.int64())],
                        ["conv_id", "place", "letter", "row"],
                    )

    return audits.select("conv_id", "audit").mapInArrow(spell, "conv_id bigint, place bigint, letter string, row bigint")


def repaired_turns(rows: DataFrame, repaired: DataFrame) -> DataFrame:
    """The repaired conversations, one row a turn: ``conv_id``, ``position`` (from 0), ``role``, ``text``, ``edit``.

    A turn that is kept keeps its role; the roles of rewritten and inserted ones
    follow from the position, since users and assistants take turns.
    """
    named = _numbered(rows)
    edits = _edits(repaired).filter("letter <> 'D'").alias("e")
    joined = edits.join(named.alias("r"), F.expr("e.conv_id <=> r.conv_id AND e.row = r.row"), "left")
    order = Window.partitionBy("e.conv_id").orderBy("e.place")
    placed = joined.select(
        "e.conv_id",
        (F.row_number().over(order) - 1).alias("position"),
        F.when(F.col("e.letter") == "K", F.col("r.role")).alias("kept_role"),
        F.coalesce("r.text", F.lit("")).alias("text"),
        F.col("e.letter").alias("edit"),
        F.first(F.when(F.col("e.letter") == "K", F.substring("r.role", 1, 1))).over(order).alias("opening"),
    )
    at = F.col("position") - F.when(F.col("opening") == "s", 1).otherwise(0)
    given = F.when(at % 2 == 0, role_grammar.ROLES[0]).otherwise(role_grammar.ROLES[1])
    return placed.select("conv_id", "position", F.coalesce("kept_role", given).alias("role"), "text", "edit")
