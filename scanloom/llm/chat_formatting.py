"""Preference pairs of conversations as one prompt and two masked completions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed marks of the rendering.
OPEN, CLOSE = "<|", "|>\n"
END = "\n"


def rendered(role: Column, text: Column) -> Column:
    """One turn: its role as a head line, its text, an end."""
    return F.concat(F.lit(OPEN), role, F.lit(CLOSE), text, F.lit(END))


def gathered(turns: DataFrame, name: str) -> DataFrame:
    """One row per conversation, its turns in order as an array of (turn, role, text)."""
    turn = F.struct(
        F.coalesce(F.col("turn").cast("bigint"), F.lit(-1)).alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    rows = turns.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("bigint").alias("conv_id"), turn.alias("x"))
    return rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("x")).alias(name))


def masked(turns: Column) -> Column:
    """``start:length`` of every assistant text with its end, by code points of the rendered completion, with spaces between.

    Heads and turns of other roles are masked.
    """
    size = F.length(rendered(F.lit(""), F.lit("")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("spans"))

    def step(acc: Column, t: Column) -> Column:
        whole = size + F.length(t["role"]) + F.length(t["text"])
        said = F.length(t["text"]) + len(END)
        span = F.concat((acc["at"] + whole - said).cast("string"), F.lit(":"), said.cast("string"))
        return F.struct(
            (acc["at"] + whole).alias("at"),
            F.when(t["role"] == "assistant", F.concat(acc["spans"], F.array(span))).otherwise(acc["spans"]).alias("spans"),
        )

    return F.concat_ws(" ", F.aggregate(turns, start, step, lambda acc: acc["spans"]))


def preference_pairs(chosen: DataFrame, rejected: DataFrame) -> DataFrame:
    """Prompt and paired completions of every conversation that is in both tables.

    Both have conv_id, turn, role and text; other columns are ignored. The prompt is the longest common prefix of turns
    (role and text equal), rendered once. Returns conv_id, n_prefix, prompt, chosen, rejected, chosen_mask,
    rejected_mask; a mask lists the trained spans of its completion. Turns are ordered by number, then role and
    text, so repeated rows are repeated turns; a NULL number comes first; NULL roles and texts count as empty; rows
    without conv_id belong to no conversation. Equal conversations have empty completions. An empty table gives an
    empty result.

    One shuffle by conversation: the two sides meet on the key they were gathered by.
    """
    pairs = gathered(chosen, "a").join(gathered(rejected, "b"), "conv_id")
    bare = lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))
    differ = F.zip_with("a", "b", lambda x, y: x.isNull() | y.isNull() | (bare(x) != bare(y)))
    first = F.coalesce(F.array_position(differ, True), F.lit(0))
    n = F.when(first > 0, first - 1).otherwise(F.size("a")).cast("int")
    rows = pairs.withColumn("n_prefix", n)
    text = lambda turns: F.array_join(F.transform(turns, lambda t: rendered(t["role"], t["text"])), "")
    tail = lambda c: F.slice(F.col(c), F.col("n_prefix") + 1, F.size(c) + 1)
    return rows.select(
        "conv_id", "n_prefix", text(F.slice("a", F.lit(1), F.col("n_prefix"))).alias("prompt"), text(tail("a")).alias("chosen"),
        text(tail("b")).alias("rejected"), masked(tail("a")).alias("chosen_mask"), masked(tail("b")).alias("rejected_mask"),
    )


def swapped_answers(turns: DataFrame) -> DataFrame:
    """A rejected version of every conversation: its last assistant turn says what its neighbour's last one says.

    Neighbours are the conversations 2i and 2i + 1; without a neighbour's answer the turn is empty.
    """
    turns = turns.select("conv_id", "turn", "role", "text")
    said = turns.where("role = 'assistant' and turn is not null and conv_id is not null")
    last = said.groupBy("conv_id").agg(
        F.max("turn").alias("last"), F.max(F.struct("turn", F.coalesce(F.col("text"), F.lit("")).alias("text")))["text"].alias("other")
    )
    # conv_id ^ 1 is 2i + 1 for 2i and 2i for 2i + 1.
    other = last.select(F.col("conv_id").bitwiseXOR(F.lit(1)).alias("conv_id"), "other")
    swap = last.select("conv_id", "last").join(other, "conv_id", "left")
    here = (F.col("turn") == F.col("last")) & (F.col("role") == "assistant")
    return turns.join(swap, "conv_id", "left").select(
        "conv_id", "turn", "role", F.when(here, F.coalesce("other", F.lit(""))).otherwise(F.col("text")).alias("text")
    )
