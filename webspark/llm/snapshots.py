"""Collapse of conversations that were logged again and again while they grew.

A log that writes the whole conversation after every turn holds each of its beginnings. Rolling hashes
over the turns name every beginning; a conversation whose whole hash is the beginning of a longer one
is dropped by an anti-join, of equal ones the first stays, and what stays is rendered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The marks around a turn, as in the common chat markup.
START, END = "<|im_start|>", "<|im_end|>"


def _turn_hash(seed: int) -> Column:
    """Hash of a turn and its place. Null and empty differ."""
    return F.xxhash64(
        F.lit(seed), "ws_at", F.col("role").isNull(), "role", F.col("text").isNull(), "text"
    )


def prefixes(turns: DataFrame, id_column: str = "conv_id", order_column: str = "turn", role_column: str = "role", text_column: str = "text") -> DataFrame:
    """``(conv_id, at, size, h1, h2)``: two rolling hashes (128 bits) after every turn.

    Turns stand in order of ``turn``, ties by role and text; they are counted anew from 1, so gaps
    and other starts don't matter. A hash after a turn is the hash before it, combined with that turn's.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    whole = Window.partitionBy("conv_id")
    rows = turns.select(
        F.col(id_column).alias("conv_id"),
        F.col(order_column).alias("turn"),
        F.col(role_column).alias("role"),
        F.col(text_column).alias("text"),
    )
    hashed = rows.withColumn("ws_at", F.row_number().over(order)).select(
        "conv_id", "turn", "role", F.xxhash64("text").alias("ws_text"), "ws_at",
        _turn_hash(1).alias("h1"), _turn_hash(2).alias("h2"),
    )
    rolling = Window.partitionBy("conv_id").orderBy("ws_at").rowsBetween(Window.unboundedPreceding, 0)
    return hashed.select(
        "conv_id",
        F.col("ws_at").alias("at"),
        F.max("ws_at").over(whole).alias("size"),
        F.bit_xor("h1").over(rolling).alias("h1"),
        F.bit_xor("h2").over(rolling).alias("h2"),
    )


def maximal(turns: DataFrame, **columns: str) -> DataFrame:
    """``(conv_id, size, copies)`` of the conversations that no longer one begins with; of equal ones
    the smallest id, with the number of copies."""
    rolled = prefixes(turns, **columns)
    state = ["at", "h1", "h2"]
    # Combined inside each task first: an opening that all conversations share is one row per task.
    beginnings = rolled.where("at < size").select(*state).distinct()
    whole = rolled.where("at = size").groupBy(*state).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("copies"))
    return whole.join(beginnings, state, "left_anti").select("conv_id", F.col("at").alias("size"), "copies")


def render(role: Column, text: Column) -> Column:
    """One turn in chat markup; a null role is ``unknown``, a null text empty."""
    return F.concat(
        F.lit(START), F.coalesce(role, F.lit("unknown")), F.lit("\n"), F.coalesce(text, F.lit("")), F.lit(END + "\n")
    )


def collapse(
    turns: DataFrame,
    id_column: str = "conv_id",
    order_column: str = "turn",
    role_column: str = "role",
    text_column: str = "text",
) -> DataFrame:
    """``(conv_id, n_turns, copies, rendered)`` of every conversation that stays, rendered turn by turn.

    A row is a turn; repeated rows are turns of their own. Turns of a null id are left out, as nothing
    tells which conversation they belong to. A null turn number comes first. Role and text are compared
    as they are. A conversation is one row of the result, so it is bounded by what a row can hold. An
    empty table gives an empty one, other columns are not read.
    """
    known = turns.where(F.col(id_column).isNotNull())
    names = {"id_column": id_column, "order_column": order_column, "role_column": role_column, "text_column": text_column}
    stay = maximal(known, **names)
    rows = known.select(
        F.col(id_column).alias("conv_id"),
        F.struct(
            F.col(order_column).alias("turn"), F.col(role_column).alias("role"), F.col(text_column).alias("text")
        ).alias("ws_turn"),
    ).join(stay, "conv_id")
    gathered = rows.groupBy("conv_id", "size", "copies").agg(F.sort_array(F.collect_list("ws_turn")).alias("ws_turns"))
    return gathered.select(
        "conv_id",
        F.col("size").cast("long").alias("n_turns"),
        "copies",
        F.array_join(F.transform("ws_turns", lambda t: render(t["role"], t["text"])), "").alias("rendered"),
    )
