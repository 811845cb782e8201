"""Exact positions in an order without gathering the rows, or a hot group, in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from filescape.session import cut

_BLOCK_BITS = 33  # monotonically_increasing_id keeps the row number of a partition below them


def _columns(order: Sequence[Column | str]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in order]


def sorted_once(
    df: DataFrame, spread_by: Sequence[str], order: Sequence[Column | str]
) -> DataFrame:
    """`df` in `order`, evaluated once.

    A global sort first samples its input for range bounds, which would run a scan a second
    time. After a shuffle by `spread_by` the sample is taken from the shuffled rows.
    """
    return df.repartition(*spread_by).orderBy(*order)


def _sorted_blocks(df: DataFrame, order: list[Column]) -> DataFrame:
    placed = df.repartitionByRange(*order).sortWithinPartitions(*order)
    return cut(placed.withColumn("_seq", F.monotonically_increasing_id()))


def global_rank(df: DataFrame, order: Sequence[Column | str], name: str = "rank") -> DataFrame:
    """Add the 1-based position of each row in `order`.

    Rows are range partitioned and numbered inside their block; the blocks before it are
    counted from one row per block, so the offsets never exceed the number of partitions.
    """
    blocks = _sorted_blocks(df, _columns(order)).withColumn(
        "_block", F.shiftright("_seq", _BLOCK_BITS)
    )
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        blocks.groupBy("_block")
        .agg(F.count("*").alias("_n"))
        .select("_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    )
    inside = F.col("_seq").bitwiseAND((1 << _BLOCK_BITS) - 1)
    return blocks.join(F.broadcast(offsets), "_block").select(
        *df.columns, (F.col("_before") + inside + 1).cast("bigint").alias(name)
    )


def rank_within(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column | str], name: str = "rank"
) -> DataFrame:
    """Add the 1-based position of each row among the rows with the same `keys`.

    A group larger than a block spans several blocks. Only the first group of a block can
    have started before it, so the counts to add are at most one row per block.
    """
    keys = list(keys)
    order = _columns(order)
    blocks = _sorted_blocks(df, [F.col(k) for k in keys] + order).withColumn(
        "_block", F.shiftright("_seq", _BLOCK_BITS)
    )
    counts = blocks.groupBy(*keys, "_block").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        counts.withColumn("_before", F.sum("_n").over(before))
        .where("_before is not null")
        .select(*keys, "_block", "_before")
    )
    local = F.row_number().over(Window.partitionBy(*keys, "_block").orderBy("_seq"))
    return (
        blocks.withColumn("_local", local)
        .join(F.broadcast(offsets), [*keys, "_block"], "left")
        .select(
            *df.columns,
            (F.coalesce("_before", F.lit(0)) + F.col("_local")).cast("bigint").alias(name),
        )
    )
