"""Chat formatting: a finite-state machine over roles and a declarative template.

The state is the role that spoke last (``START`` before the first turn). A template
says for each role in which states it may speak and which segments it emits; every
segment carries its own loss flag. A turn that speaks out of order, or in a role
that the template does not know, is formatted all the same and marked ``ok`` =
false; the machine goes on from it. All is built of DataFrame functions.

Control strings inside roles and texts are escaped, reversibly: each backslash is
doubled, and behind the first character of every control string stands ``\\-``.
An escaped text holds no control string, so that output is read back by splitting.

Conversations with a thousandth of all turns or more (and ``LONG`` at least) are cut
into ranges of their order, and each range takes the role and the number of turns
before it from a table with one row per range. So ``turns`` gathers no conversation;
``conversations`` must, since it returns each as one value.

Turns go in the order of ``turn`` (null first), equal ones by role, then by a hash of
the text; repeated rows are turns each. A null text is empty, a null role is the
empty role, a null ``conv_id`` is a conversation of its own. An empty table gives no
row; texts may have any length a string can have; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumaprof.llm.common import HOT_SHARE, written

START = "start"
#: Slots of a segment.
ROLE, TEXT = "{role}", "{text}"
#: Turns from which on a conversation can be cut into ranges.
LONG = 2048


@dataclass(frozen=True)
class Segment:
    """A literal, or one of the slots, and whether the loss covers it."""

    text: str
    loss: bool = False


@dataclass(frozen=True)
class Rule:
    """The states in which a role may speak, and what it emits."""

    after: tuple[str, ...]
    segments: tuple[Segment, ...]


@dataclass(frozen=True)
class Template:
    """``first`` is emitted on leaving ``START``; ``other`` formats roles without a rule; a valid conversation ends in one of ``ends``."""

    rules: Mapping[str, Rule]
    other: tuple[Segment, ...]
    first: Segment
    ends: tuple[str, ...]
    control: tuple[str, ...]

    def __post_init__(self):
        literals = {s.text for pieces in [self.other, (self.first,), *(r.segments for r in self.rules.values())]
                    for s in pieces if s.text not in (ROLE, TEXT)}
        if not literals <= set(self.control):
            raise ValueError(f"literals that are no control strings: {sorted(literals - set(self.control))}")
        for one in self.control:
            if len(one) < 2 or "\\" in one:
                raise ValueError(f"a control string has two characters at least and no backslash: {one!r}")
            for other in self.control:
                if any(other.startswith(one[n:]) or one[n:].startswith(other) for n in range(1, len(one))):
                    raise ValueError(f"control strings overlap: {one!r}, {other!r}")


def _turn(loss: bool) -> tuple[Segment, ...]:
    return (Segment("<|im_start|>"), Segment(ROLE), Segment("<|im_sep|>"), Segment(TEXT, loss), Segment("<|im_end|>"))


#: One marked turn after the other; the loss covers what the assistant says.
MARKED = Template(
    rules={
        "system": Rule((START,), _turn(False)),
        "user": Rule((START, "system", "assistant"), _turn(False)),
        "assistant": Rule(("user",), _turn(True)),
    },
    other=_turn(False),
    first=Segment("<s>"),
    ends=("user", "assistant"),
    control=("<|im_start|>", "<|im_sep|>", "<|im_end|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"),
)


def escaped(text: Column, template: Template) -> Column:
    control = "|".join(re.escape(c) for c in template.control)
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return F.regexp_replace(doubled, f"(?s)(?={control})(.)", r"$1\\-")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(?:-|(\\))", "$1")


def _number(rows: DataFrame, *keys: str) -> DataFrame:
    """``position`` and ``before`` (the role that spoke last) inside of each group."""
    order = Window.partitionBy(*keys).orderBy("turn", "role", "_hash")
    return rows.withColumn("position", F.row_number().over(order).cast("bigint") - 1).withColumn("before", F.lag("role").over(order))


def _placed(rows: DataFrame, long_from: int) -> list[DataFrame]:
    """All turns with their position and the role before: those of short conversations, then those of long ones if there are any."""
    total = rows.count()
    long = [r["conv_id"] for r in rows.groupBy("conv_id").agg(F.count("*").alias("n"))
            .filter(F.col("n") >= max(long_from, total * HOT_SHARE)).collect()]  # 1 / HOT_SHARE at most
    if not long:
        return [_number(rows, "conv_id")]
    is_long = reduce(Column.__or__, [F.col("conv_id").eqNullSafe(F.lit(c).cast("bigint")) for c in long])
    dealt = rows.filter(is_long).withColumn("_deal", F.xxhash64(F.monotonically_increasing_id()))
    ranges = written(dealt.repartitionByRange("conv_id", "turn", "role", "_hash", "_deal").drop("_deal")
                     .withColumn("_range", F.spark_partition_id()), "turns")
    # One row per range and conversation in it: as many as partitions and long conversations.
    ends = ranges.groupBy("conv_id", "_range").agg(
        F.count("*").alias("_n"), F.max_by("role", F.struct("turn", "role", "_hash")).alias("_last"))
    order = Window.partitionBy("conv_id").orderBy("_range")
    carried = ends.select(
        F.col("conv_id").alias("_conv"), F.col("_range").alias("_at"), F.lag("_last").over(order).alias("_carried"),
        F.coalesce(F.sum("_n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_ahead"))
    numbered = _number(ranges, "conv_id", "_range").join(
        F.broadcast(carried), F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("_range") == F.col("_at")))
    whole = numbered.withColumn("before", F.coalesce("before", "_carried")).withColumn("position", F.col("position") + F.col("_ahead"))
    return [_number(rows.filter(~is_long), "conv_id"), whole.select(*rows.columns, "position", "before")]


def _emitted(placed: DataFrame, template: Template) -> DataFrame:
    """The transition of each turn: its state, whether the role may speak in it, and the segments."""
    state = F.when(F.col("before").isNull(), F.lit(START)).otherwise(F.col("before"))
    slots = placed.select("conv_id", "position", "turn", "role", "text", state.alias("state"), F.col("before").isNull().alias("_first"),
                          escaped(F.col("role"), template).alias("_role"), escaped(F.col("text"), template).alias("_text"))

    def cells(pieces: tuple[Segment, ...]) -> Column:
        values = {ROLE: F.col("_role"), TEXT: F.col("_text")}
        return F.array(*[F.struct(values.get(p.text, F.lit(p.text)).alias("text"), F.lit(p.loss).alias("loss")) for p in pieces])

    emitted, ok = cells(template.other), F.lit(False)
    for role, rule in template.rules.items():
        speaks = F.col("role") == role
        emitted = F.when(speaks, cells(rule.segments)).otherwise(emitted)
        ok = ok | (speaks & F.when(F.col("_first"), F.lit(START in rule.after)).otherwise(
            F.col("state").isin([s for s in rule.after if s != START])))
    emitted = F.when(F.col("_first"), F.concat(cells((template.first,)), emitted)).otherwise(emitted)
    return slots.select("conv_id", "position", "turn", "role", "state", ok.alias("ok"), emitted.alias("segments"))


def _read(rows: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return rows.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
                       F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), text.alias("text"), F.xxhash64(text).alias("_hash"))


def turns(rows: DataFrame, template: Template = MARKED, long_from: int = LONG) -> DataFrame:
    """(conv_id, position, turn, role, state, ok, segments): every turn with its segments of (text, loss), position from 0."""
    return reduce(DataFrame.unionByName, [_emitted(p, template) for p in _placed(_read(rows), long_from)])


def conversations(rows: DataFrame, template: Template = MARKED, long_from: int = LONG) -> DataFrame:
    """(conv_id, segments, formatted, valid): each conversation whole; valid if all turns are in order and it may end there.

    Short conversations are gathered where they were numbered, without another shuffle.
    """
    def gathered(placed: DataFrame) -> DataFrame:
        one = _emitted(placed, template).groupBy("conv_id").agg(
            F.sort_array(F.collect_list(F.struct("position", "segments"))).alias("_turns"), F.every("ok").alias("_ok"),
            F.max_by("role", "position").isin(list(template.ends)).alias("_ends"))
        return one.select("conv_id", F.flatten(F.transform("_turns", lambda t: t["segments"])).alias("segments"),
                          (F.col("_ok") & F.col("_ends")).alias("valid"))

    whole = reduce(DataFrame.unionByName, [gathered(p) for p in _placed(_read(rows), long_from)])
    return whole.select("conv_id", "segments", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "valid")


def turns_of(formatted: Column, template: Template = MARKED) -> Column:
    """The (role, text) pairs that a formatted conversation says, read from the string alone."""
    opening, separator, closing = (s.text for s in template.other if s.text not in (ROLE, TEXT))
    pieces = F.split(formatted, re.escape(opening), -1)

    def turn(piece: Column) -> Column:
        said = F.substring_index(F.element_at(F.split(piece, re.escape(separator), 2), 2), closing, 1)
        return F.struct(unescaped(F.substring_index(piece, separator, 1)).alias("role"), unescaped(said).alias("text"))

    return F.transform(F.slice(pieces, F.lit(2), F.size(pieces)), turn)


def under_loss(segments: Column) -> Column:
    """All text under the loss mask, in order, unescaped."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescaped(s["text"])), "")


def digests(rows: DataFrame, template: Template = MARKED, long_from: int = LONG) -> DataFrame:
    """One row per conversation: what is read back from its output, as counts and digests."""
    read = conversations(rows, template, long_from).select(
        "conv_id", "valid", F.length("formatted").cast("bigint").alias("formatted_chars"),
        turns_of(F.col("formatted"), template).alias("_turns"), under_loss(F.col("segments")).alias("_loss"))
    said = F.array_join(F.transform("_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("_turns").cast("bigint").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"),
        F.length("_loss").cast("bigint").alias("loss_chars"), F.sha2("_loss", 256).alias("loss_sha256"), "formatted_chars", "valid")
