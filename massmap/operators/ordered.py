"""Ranks and running totals over groups of any size.

A plain window sends one group to one task. These operators range-partition on
group *and* order instead, so a group that holds a third of all rows is spread
over many tasks, number rows inside each slice, and add what the slices before
it hold. Only one small row per slice is compared across slices.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from massmap.session import written

_SLICE = "__slice"


def _sliced(frame: DataFrame, group: list[str], order: list[Column]) -> DataFrame:
    """Rows in global order with the number of the slice they sit in.

    The slices are written once, so counting them and reading them see the very
    same cut even if a task is run again.
    """
    ranged = frame.repartitionByRange(*[F.col(name) for name in group], *order)
    return written(ranged.withColumn(_SLICE, F.spark_partition_id()), "slices")


def running_totals(
    frame: DataFrame, group: list[str], order: list[Column], totals: dict[str, Column]
) -> DataFrame:
    """Add, per row, the sum of each expression over the group up to that row."""
    sliced = _sliced(frame, group, order)
    for name, value in totals.items():
        sliced = sliced.withColumn(name, value)
    per_slice = sliced.groupBy(*group, _SLICE).agg(*[F.sum(name).alias(f"__{name}") for name in totals])
    before = Window.partitionBy(*group).orderBy(_SLICE).rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_slice.select(
        *group, _SLICE, *[F.coalesce(F.sum(f"__{name}").over(before), F.lit(0)).alias(f"__{name}") for name in totals]
    )
    inside = (
        Window.partitionBy(*group, _SLICE).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    summed = sliced.select(
        *[F.col(name) for name in sliced.columns if name not in totals],
        *[F.sum(name).over(inside).alias(name) for name in totals],
    )
    joined = summed.join(offsets, [*group, _SLICE])
    return joined.select(
        *frame.columns, *[(F.col(name) + F.col(f"__{name}")).alias(name) for name in totals]
    )


def ranked(frame: DataFrame, group: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    """Add the 1-based position of each row in its group. ``order`` must be total."""
    return running_totals(frame, group, order, {name: F.lit(1).cast("bigint")})


def top(frame: DataFrame, group: list[str], order: list[Column], count: int, name: str = "rank") -> DataFrame:
    """The first ``count`` rows per group, numbered from 1.

    Up to 1000 Spark cuts every map task to ``count`` rows per group before the
    shuffle. Beyond that the group itself may be large, so slices rank it.
    """
    if count > 1000:
        return ranked(frame, group, order, name).where(F.col(name) <= count)
    window = Window.partitionBy(*group).orderBy(*order)
    return frame.withColumn(name, F.row_number().over(window)).where(F.col(name) <= count)


def far_page(
    frame: DataFrame, group: list[str], order: list[Column], asked: int, limit: int, name: str = "rank"
) -> DataFrame:
    """Places ``asked + 1`` to ``asked + limit`` of each group, or its last page where it ends before.

    Adds the place as ``name``, ``total`` (rows of the group) and ``offset`` (where its page
    begins). ``asked`` is a multiple of ``limit`` and ``order`` total. Slices are counted first,
    and rows are sorted only in those that a page reaches into. ``frame`` should be slim: it is
    range-partitioned and written whole.
    """
    sliced = _sliced(frame, group, order)
    earlier = Window.partitionBy(*group).orderBy(_SLICE).rowsBetween(Window.unboundedPreceding, -1)
    counted = sliced.groupBy(*group, _SLICE).agg(F.count("*").alias("__rows")).select(
        *group, _SLICE, "__rows",
        F.coalesce(F.sum("__rows").over(earlier), F.lit(0)).alias("__before"),
        F.sum("__rows").over(Window.partitionBy(*group)).alias("total"),
    )
    last = F.floor((F.col("total") - 1) / limit) * limit
    placed = counted.withColumn("offset", F.least(F.lit(asked), last).cast("bigint"))
    reached = placed.where("__before < offset + {0} AND __before + __rows > offset".format(limit)).drop("__rows")
    inside = Window.partitionBy(*group, _SLICE).orderBy(*order)
    numbered = sliced.join(reached, [*group, _SLICE]).withColumn(name, F.col("__before") + F.row_number().over(inside))
    return numbered.where((F.col(name) > F.col("offset")) & (F.col(name) <= F.col("offset") + limit)).select(
        *frame.columns, name, "total", "offset"
    )
