"""Lines of two sides as numbers: a dictionary join.

Every distinct line of a pair of files gets a number, dense from 0 in order of first
appearance, the older side first. The dictionary is grouped by the text of the line, so
equal numbers mean equal texts, not equal hashes. What comes out is slim: alignments and
overlaps that read numbers move no text.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def interned(
    pairs: DataFrame, keys: Sequence[str] = ("repo", "path"), before: str = "before_line_texts", after: str = "after_line_texts"
) -> DataFrame:
    """``(keys, before_ids, after_ids, distinct_lines)``, one row for each row of ``pairs``.

    ``keys`` must tell rows apart; a null key matches a null key. A null or empty side has no
    numbers. The lines of a file are spread by their text; only its dictionary and its
    numbers meet in one task.
    """
    keys = list(keys)
    sides = F.expr(
        f"concat(transform(coalesce(`{before}`, array()), (line, at) -> struct(0 as side, at as at, line as line)), "
        f"transform(coalesce(`{after}`, array()), (line, at) -> struct(1 as side, at as at, line as line)))"
    )
    rows = pairs.select(*keys, F.explode(sides).alias("one")).select(*keys, "one.*")
    places = rows.groupBy(*keys, "line").agg(
        F.min(F.struct("side", "at")).alias("first"), F.collect_list(F.struct("side", "at")).alias("places")
    )
    order = Window.partitionBy(*keys).orderBy("first")
    numbered = places.select(*keys, (F.row_number().over(order) - 1).alias("id"), "places")
    spots = numbered.select(*keys, "id", F.explode("places").alias("spot"))

    def ids(side: int) -> str:
        return f"transform(array_sort(filter(collect_list(struct(spot.side as side, spot.at as at, id)), s -> s.side = {side})), s -> s.id)"

    found = spots.groupBy(*keys).agg(
        F.expr(ids(0)).alias("before_ids"), F.expr(ids(1)).alias("after_ids"), (F.max("id") + 1).cast("bigint").alias("distinct_lines")
    )
    none = F.array().cast("array<int>")
    lacking = (F.coalesce(F.size(before), F.lit(0)) <= 0) & (F.coalesce(F.size(after), F.lit(0)) <= 0)
    empty = pairs.where(lacking).select(
        *keys, none.alias("before_ids"), none.alias("after_ids"), F.lit(0).cast("bigint").alias("distinct_lines")
    )
    return found.unionByName(empty)
