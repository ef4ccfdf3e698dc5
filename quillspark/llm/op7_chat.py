"""Chat formatting after cumulative-snapshot collapse.

A log that saves a conversation after every turn holds it as many times as it has turns.
Every turn gets a rolling hash of the turns up to it: the exclusive or of hashes that hold
the place, role and text of each turn, twice 64 bits. A conversation whose last hash is the
hash of an earlier turn of another one is a snapshot of it; an anti-join keeps the others,
and of equal conversations the least conv_id. Only these are rendered.

Equal prefixes are made distinct, with pre-aggregation, before they are joined, so a first
turn of a third of all conversations is one row per task. Turns are collected per
conversation, whose rendering is one value of the output.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TURN = ("<|", "|>\n", "\n<|end|>\n")


def render(role: Column, text: Column) -> Column:
    """One turn; a null role is ``unknown``, a null text is empty."""
    return F.concat(F.lit(TURN[0]), F.coalesce(role, F.lit("unknown")), F.lit(TURN[1]), F.coalesce(text, F.lit("")), F.lit(TURN[2]))


def collapse(turns: DataFrame) -> DataFrame:
    """``conv_id``, ``n_turns`` and ``n_copies`` (equal conversations) of the maximal ones."""
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first())
    placed = turns.where("conv_id is not null").select("conv_id", "turn", "role", "text").withColumn("place", F.row_number().over(order))
    # the hash passes over nulls, so that a field is null is hashed with it
    said = [F.col("role"), F.isnull("role"), F.col("text"), F.isnull("text")]
    marked = placed.select("conv_id", "place", "turn", "role", "text", F.xxhash64("place", *said).alias("x"), F.xxhash64(*reversed(said), F.lit(31), "place").alias("y"))
    rolling = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    hashed = marked.select(
        "conv_id", "place", F.bit_xor("x").over(rolling).alias("hx"), F.bit_xor("y").over(rolling).alias("hy"), F.lead("place").over(order).isNull().alias("is_last")
    )
    whole = hashed.where("is_last").groupBy("hx", "hy", "place").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_copies"))
    prefixes = hashed.where("not is_last").select("hx", "hy", "place").distinct()
    return whole.join(prefixes, ["hx", "hy", "place"], "left_anti").select("conv_id", F.col("place").cast("long").alias("n_turns"), "n_copies")


def format_chats(turns: DataFrame) -> DataFrame:
    """Per maximal conversation: ``conv_id``, ``n_turns``, ``n_copies`` and ``text``.

    Turns are in the order of turn, then role, then text, nulls first; a repeated row is a
    turn again. Null roles and texts differ from all others. Rows without conv_id are left
    out. Other columns are not read; an empty table gives an empty result.
    """
    chosen = collapse(turns)
    rows = turns.select("conv_id", "turn", "role", "text").join(chosen, "conv_id")
    one = F.struct(F.col("turn"), F.col("role"), F.col("text"))
    told = rows.groupBy("conv_id", "n_turns", "n_copies").agg(F.sort_array(F.collect_list(one)).alias("turns"))
    return told.select("conv_id", "n_turns", "n_copies", F.array_join(F.transform("turns", lambda t: render(t["role"], t["text"])), "").alias("text"))
