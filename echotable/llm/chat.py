"""Chat formatting after a collapse of cumulative snapshots.

A log often holds a conversation several times, each copy a few turns longer. Every turn gets a
rolling hash of its conversation up to that turn: two running XORs of 64-bit hashes of (place, role,
text), whose order the place fixes. A conversation whose last hash is the hash of a proper prefix of
another is a snapshot of it; an anti-join keeps the others. Of equal conversations the smallest id
stays. The turns of those kept are rendered in order.

A conversation is rendered into one string, so its turns meet in one row; nothing else gathers more
than a running hash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def prefixes(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``(conv, place, h1, h2, next)`` of each turn: rolling hashes, and the place of a later turn if any.

    Turns are in the order of ``turn``, then role, then text; nulls come first, and a null role or
    text hashes as an empty one. Rows with a null conversation form one conversation.
    """
    rows = turns.select(
        F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    order = Window.partitionBy("conv").orderBy("turn", "role", "text")
    placed = rows.withColumn("place", F.row_number().over(order))
    placed = placed.select("conv", "place", F.xxhash64(F.lit(1), "place", "role", "text").alias("a"), F.xxhash64(F.lit(2), "text", "role", "place").alias("b"))
    sofar = Window.partitionBy("conv").orderBy("place").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return placed.select(
        "conv", "place", F.bit_xor("a").over(sofar).alias("h1"), F.bit_xor("b").over(sofar).alias("h2"), F.lead("place").over(Window.partitionBy("conv").orderBy("place")).alias("next")
    )


def maximal(turns: DataFrame, **cols: str) -> DataFrame:
    """``(conv, n_turns)`` of the conversations that no longer conversation starts with."""
    hashes = prefixes(turns, **cols)
    whole = hashes.where("next is null").groupBy("h1", "h2", "place").agg(F.min("conv").alias("conv"))
    inner = hashes.where("next is not null").select("h1", "h2", "place").distinct()
    kept = whole.join(inner, ["h1", "h2", "place"], "left_anti")
    # min() skips null: the null conversation stands only where no other equals it
    return kept.select("conv", F.col("place").cast("long").alias("n_turns"))


def render(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``(conv_id, n_turns, text)`` of each maximal conversation, in turn markup.

    A turn is ``<|role|>``, a line break, its text, ``<|end|>`` and a line break. Of equal conversations
    the smallest id is given. An empty table gives none; other columns are ignored.
    """
    cols = {"conv_col": conv_col, "turn_col": turn_col, "role_col": role_col, "text_col": text_col}
    kept = maximal(turns, **cols)
    rows = turns.select(
        F.col(conv_col).alias("c"), F.col(turn_col).alias("turn"),
        F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    rows = rows.join(kept, F.col("c").eqNullSafe(F.col("conv")))
    ordered = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    whole = rows.groupBy("conv", "n_turns").agg(ordered.alias("turns"))
    marked = F.transform("turns", lambda t: F.concat(F.lit("<|"), t.role, F.lit("|>\n"), t.text, F.lit("<|end|>\n")))
    return whole.select(F.col("conv").alias("conv_id"), "n_turns", F.array_join(marked, "").alias("text"))
