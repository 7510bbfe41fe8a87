"""Preference data from chosen and rejected conversations.

Turns of the two sides are compared by a signature of their rows, turn by
turn; the first turn that differs, or that one side lacks, ends the longest
common prefix.  The prefix is rendered once, as the prompt; the turns from
there on are the chosen and the rejected completion, in which only what the
trained role says is to be learned.

The result is one row a rendered turn, not a conversation, so the longest
conversation needs no more memory than its longest turn: prefixes come from
minima over turns, nothing is gathered.  Only native expressions are used.

Repeated rows of a turn count once; different rows of one turn are rendered
in the order of role and text.  Null roles are ``unknown``, null texts empty;
rows without a conversation or turn are left out.  A side that is missing
has no turns: the other is all completion and ``paired`` is false.  Equal
sides are all prompt.  Marks inside texts are broken up, so no turn can
forge another.  An empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """``open + role + after_role + text + close``; training covers text and ``close``."""

    open: str = "<|im_start|>"
    after_role: str = "\n"
    close: str = "<|im_end|>"
    after: str = "\n"
    trained_role: str = "assistant"

    def clean(self, text: Column) -> Column:
        for mark in (self.open, self.close):
            if mark:
                text = F.replace(text, F.lit(mark), F.lit(mark[0] + " " + mark[1:]))
        return text


def format_preferences(
    turns: DataFrame,
    pairs: DataFrame,
    template: Template | None = None,
    conversation: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
) -> DataFrame:
    """Rows ``(pair_id, paired, part, turn, role, rendered, masked_chars, trained_chars)``.

    ``pairs(pair_id, chosen, rejected)`` names conversations.  ``part`` is
    prompt, chosen or rejected; of ``rendered`` the first ``masked_chars`` are
    masked and the next ``trained_chars`` trained.
    """
    sides = pairs.select("pair_id", F.explode(F.array(*[F.struct(F.lit(s).alias("side"), F.col(s).alias("conv")) for s in ("chosen", "rejected")])).alias("x"))
    sides = sides.select("pair_id", "x.side", "x.conv").where("conv is not null and pair_id is not null")
    return _format(_rows(turns, conversation, turn, role, text).join(sides, "conv"), template or Template())


def format_neighbours(
    turns: DataFrame, template: Template | None = None, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """Pairs of conversation ``2 k``, chosen, and ``2 k + 1``, rejected; the pair is ``k``.  No join is needed."""
    rows = _rows(turns, conversation, turn, role, text)
    pair = F.floor(F.col("conv") / 2).cast("bigint")
    return _format(rows.withColumn("pair_id", pair).withColumn("side", F.when(F.pmod("conv", F.lit(2)) == 0, "chosen").otherwise("rejected")), template or Template())


def _rows(turns: DataFrame, conversation: str, turn: str, role: str, text: str) -> DataFrame:
    rows = turns.select(
        F.col(conversation).alias("conv"),
        F.col(turn).cast("bigint").alias("turn"),
        F.coalesce(F.col(role), F.lit("unknown")).alias("role"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    ).where("conv is not null and turn is not null")
    return rows.withColumn("h", F.xxhash64("role", "text"))


def _format(rows: DataFrame, template: Template) -> DataFrame:
    signed = rows.groupBy("pair_id", "turn", "side").agg(F.xxhash64(F.array_sort(F.collect_set("h"))).alias("s"))
    met = signed.groupBy("pair_id", "turn").agg(F.count("*").alias("n"), F.min("s").alias("a"), F.max("s").alias("b"), F.max("side").alias("last"), F.min("side").alias("first"))
    ends = met.groupBy("pair_id").agg(
        F.min(F.when((F.col("n") < 2) | (F.col("a") != F.col("b")), F.col("turn"))).alias("end"),
        (F.min("first") != F.max("last")).alias("paired"),
    )
    # Repeated rows count once; their text is taken from one of them.
    once = rows.groupBy("pair_id", "side", "turn", "role", "h").agg(F.first("text").alias("text"))
    at = once.join(ends, "pair_id")
    shared = F.col("end").isNull() | (F.col("turn") < F.col("end"))
    at = at.where(~shared | (F.col("side") == "chosen")).withColumn("part", F.when(shared, "prompt").otherwise(F.col("side")))
    # The name of a role comes from the data as well.
    head = F.concat(F.lit(template.open), template.clean(F.col("role")), F.lit(template.after_role))
    body = F.concat(template.clean(F.col("text")), F.lit(template.close))
    trained = (F.col("part") != "prompt") & (F.col("role") == template.trained_role)
    rendered = F.concat(head, body, F.lit(template.after))
    return at.select(
        "pair_id",
        "paired",
        "part",
        "turn",
        "role",
        rendered.alias("rendered"),
        F.when(trained, F.length(head)).otherwise(F.length(rendered)).cast("bigint").alias("masked_chars"),
        F.when(trained, F.length(body)).otherwise(F.lit(0)).cast("bigint").alias("trained_chars"),
    )
