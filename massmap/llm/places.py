"""Numbering rows inside groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def numbered(
    frame: DataFrame, group: list[str], unit: list[Column], order: list[Column], blocks: int, name: str,
    facts: DataFrame | None = None,
) -> DataFrame:
    """Add each row's 0-based place in its group, without bringing a group to one task.

    Rows are dealt into ``blocks`` blocks by the hash of ``unit``; places inside a
    block are counted there, and what the blocks before hold is added. One row per
    group and block is compared across blocks. Places depend on the rows alone if
    ``order`` is total within a block. ``frame`` is read twice: pass a table, or
    something as cheap to read. ``facts`` may hold one row per group; its other
    columns are added on the way.
    """
    dealt = frame.withColumn("__block", F.pmod(F.xxhash64(*unit), F.lit(blocks)).cast("int"))
    held = dealt.groupBy(*group, "__block").agg(F.count(F.lit(1)).alias("__held"))
    before = Window.partitionBy(*group).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = held.select(*group, "__block", F.coalesce(F.sum("__held").over(before), F.lit(0)).alias("__before"))
    added = [column for column in facts.columns if column not in group] if facts is not None else []
    if facts is not None:
        offsets = offsets.join(facts, group)
    inside = Window.partitionBy(*group, "__block").orderBy(*order)
    placed = dealt.withColumn(name, F.row_number().over(inside) - 1)
    return placed.join(offsets, [*group, "__block"]).select(
        *[F.col(f"`{column}`") for column in frame.columns], *added,
        (F.col(name) + F.col("__before")).cast("bigint").alias(name),
    )
