"""Preference formatting: chosen and rejected conversations as one prompt and two masked completions.

The turns of a pair are compared from the first on; those that are equal in role
and text on both sides (the longest common prefix) are rendered once as the
prompt, the rest of either side as its completion. A turn is rendered as
``<|role|>``, a line break, its text, ``<|end|>`` and a line break. The mask of a
completion lists the spans (code points, end excluded) that a loss is taken on:
texts of ``assistant`` turns with their end marks.

Only aggregates and column expressions are used. A pair makes one training
example, that is one row, so its turns meet in one row; nothing else does.

Defined cases: turns stand in the order of their numbers, ties by role and text;
a null number comes first, a null role or text is an empty one; repeated turns
are turns; a pair that one side lacks has an empty conversation there; equal
conversations are all prompt; rows with a null pair id form one pair; extra
columns are ignored; empty tables give an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridwright.llm.frames import column, text_of

END = "<|end|>"
TRAINED_ROLE = "assistant"


def rendered(turn: Column) -> Column:
    return F.concat(F.lit("<|"), turn["role"], F.lit("|>\n"), turn["text"], F.lit(END + "\n"))


def _render_all(turns: Column) -> Column:
    return F.array_join(F.transform(turns, rendered), "")


def _spans(turns: Column) -> Column:
    """The trained spans of the rendered turns."""
    def add(state: Column, turn: Column) -> Column:
        start = state["at"] + F.length(turn["role"]) + 5  # the role stands between <| and |> and a line break
        span = F.array(F.struct(start.alias("start"), (start + F.length(turn["text"]) + len(END)).alias("end")))
        return F.struct(
            (start + F.length(turn["text"]) + len(END) + 1).alias("at"),
            F.when(turn["role"] == TRAINED_ROLE, F.concat(state["spans"], span)).otherwise(state["spans"]).alias("spans"))

    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    return F.aggregate(turns, F.struct(F.lit(0).cast("long").alias("at"), none.alias("spans")), add, lambda s: s["spans"])


def conversations(turns: DataFrame, pair: str, turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``pair`` and its ``turns`` in order, as structs of role and text."""
    listed = F.array_sort(F.collect_list(F.struct(column(turn).alias("turn"), text_of(role).alias("role"), text_of(text).alias("text"))))
    return turns.groupBy(column(pair).alias("pair")).agg(
        F.transform(listed, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))


def format_pairs(chosen: DataFrame, rejected: DataFrame, pair: str, turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``pair``, ``prompt``, ``prompt_turns``, ``chosen``, ``chosen_mask``, ``rejected``, ``rejected_mask``."""
    left = conversations(chosen, pair, turn, role, text).withColumnRenamed("turns", "good")
    right = conversations(rejected, pair, turn, role, text).select(F.col("pair").alias("other"), F.col("turns").alias("bad"))
    empty = F.array().cast("array<struct<role:string,text:string>>")
    both = left.join(right, left["pair"].eqNullSafe(right["other"]), "full").select(
        F.coalesce("pair", "other").alias("pair"), F.coalesce("good", empty).alias("good"), F.coalesce("bad", empty).alias("bad"))
    shorter = F.least(F.size("good"), F.size("bad"))
    same = F.transform(F.slice("good", F.lit(1), shorter), lambda t, i: t.eqNullSafe(F.get("bad", i)))
    first_other = F.array_position(same, False)
    both = both.withColumn("prompt_turns", F.when(first_other > 0, first_other - 1).otherwise(shorter).cast("int"))
    rest = {c: F.slice(c, F.col("prompt_turns") + 1, F.size(c)) for c in ("good", "bad")}
    return both.select(
        "pair", _render_all(F.slice("good", F.lit(1), F.col("prompt_turns"))).alias("prompt"), "prompt_turns",
        _render_all(rest["good"]).alias("chosen"), _spans(rest["good"]).alias("chosen_mask"),
        _render_all(rest["bad"]).alias("rejected"), _spans(rest["bad"]).alias("rejected_mask"))


def weakened(turns: DataFrame, pair: str, turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """A rejected side for conversations that have none: the last assistant turn is made worse.

    It gets the text of the conversation's first assistant turn if that is another
    turn with another text, else the first half of its own text.
    """
    mine = F.col("a_role") == TRAINED_ROLE
    rows = turns.select(column(pair).alias("a_pair"), column(turn).alias("a_turn"), text_of(role).alias("a_role"), text_of(text).alias("a_text"))
    facts = rows.filter(mine).groupBy("a_pair").agg(
        F.max("a_turn").alias("last"), F.min(F.struct("a_turn", "a_text")).alias("first")).withColumnRenamed("a_pair", "of")
    worse = F.when((F.col("first.a_turn") < F.col("last")) & (F.col("first.a_text") != F.col("a_text")), F.col("first.a_text")).otherwise(
        F.substring("a_text", F.lit(1), F.floor(F.length("a_text") / 2).cast("int")))
    return rows.join(facts, rows["a_pair"].eqNullSafe(facts["of"]), "left").select(
        F.col("a_pair").alias(pair), F.col("a_turn").alias(turn), F.col("a_role").alias(role),
        F.when(mine & (F.col("a_turn") == F.col("last")), worse).otherwise(F.col("a_text")).alias(text))
