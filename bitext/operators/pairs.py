"""Building parallel pairs: turn pairing, order-aligned zip, pivot chains."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import strip


def part_key(whole: str, part: str) -> Column:
    """Key of a part of a row (a turn of a conversation, a line of a document):
    ``'<whole>:<part>'``.  No two parts share it, however many there are; it is
    null where either column is null."""
    return F.concat(F.col(whole).cast("string"), F.lit(":"), F.col(part).cast("string"))


def turn_pairs(conversations: DataFrame, src_role: str = "user", tgt_role: str = "assistant",
               src: str = "src", tgt: str = "tgt") -> DataFrame:
    """Turn t of ``src_role`` paired with turn t+1 of ``tgt_role`` in the same
    conversation → ``(pair_id, conv_id, turn, src, tgt)``.

    An equi-join on (conv_id, turn) rather than a ``lead`` window, so one very
    long conversation is spread over many tasks instead of one.
    """
    a = conversations.where(F.col("role") == src_role).select(
        "conv_id", "turn", F.col("text").alias(src))
    b = conversations.where(F.col("role") == tgt_role).select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias(tgt))
    return (a.join(b, ["conv_id", "turn"], "inner")
             .select(part_key("conv_id", "turn").alias("pair_id"), "conv_id", "turn", src, tgt))


def turn_chains(conversations: DataFrame, roles=("user", "assistant", "user"),
                names=("en", "tl", "rin")) -> DataFrame:
    """Three consecutive turns (t, t+1, t+2) with the given roles → a pivot chain
    ``(chain_id, names[0], names[1], names[2])``."""
    parts = []
    for k, (role, name) in enumerate(zip(roles, names)):
        parts.append(conversations.where(F.col("role") == role).select(
            "conv_id", (F.col("turn") - k).alias("turn"), F.col("text").alias(name)))
    out = parts[0].join(parts[1], ["conv_id", "turn"]).join(parts[2], ["conv_id", "turn"])
    return out.select(part_key("conv_id", "turn").alias("chain_id"), *names)


def zip_rows(left: DataFrame, right: DataFrame, row_id: str = "row_id") -> DataFrame:
    """Re-pair two projections of one table that both carry ``row_id``
    (the order-aligned ``zip`` of the reference made explicit)."""
    return left.join(right, row_id, "inner")


def with_row_id(df: DataFrame, order_cols, row_id: str = "row_id") -> DataFrame:
    """Stable 0-based row id following ``order_cols`` (a total order): a
    range-partitioned numbering with per-partition offsets, not a single-task
    window or an RDD."""
    from .ordering import row_number_by
    return row_number_by(df, [], list(order_cols), "_rn").withColumn(row_id, F.col("_rn") - 1).drop("_rn")


def table_from_columns(df: DataFrame, columns: dict) -> DataFrame:
    """Build a table from aligned columns of one plan: a ``select`` with aliases."""
    return df.select(*[(F.col(v) if isinstance(v, str) else v).alias(k) for k, v in columns.items()])


def clean_pairs(pairs: DataFrame, src: str = "src", tgt: str = "tgt") -> DataFrame:
    """Strip both sides and drop pairs with a null or blank side."""
    s, t = strip(src), strip(tgt)
    return (pairs.withColumns({src: s, tgt: t})
                 .where(F.col(src).isNotNull() & F.col(tgt).isNotNull()
                        & (F.col(src) != "") & (F.col(tgt) != "")))
