"""Weights rolled up a folder hierarchy.

Rows are first summed per folder they sit in, then that much smaller table is
expanded to the folders above and summed again. The expansion therefore costs
folders x depth rather than files x depth, and both sums combine on the map
side, so the root of a huge repository costs one row per task.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from massmap.functions.fixed_values import FLAVORS
from massmap.functions.paths import base_name, depth_of, folder_chain, folder_of
from massmap.operators.ordered import running_totals


def direct_totals(
    files: DataFrame, sums: Mapping[str, Column], keys: Sequence[str] = ("repo",), path: str = "path"
) -> DataFrame:
    """One row per folder that holds files itself, summing only those files."""
    placed = files.withColumn("folder", folder_of(F.col(path)))
    return placed.groupBy(*keys, "folder").agg(*[F.sum(value).alias(name) for name, value in sums.items()])


def subtree_totals(
    direct: DataFrame, sums: Sequence[str], keys: Sequence[str] = ("repo",), most: Mapping[str, Column] | None = None
) -> DataFrame:
    """One row per folder, summing everything below it.

    ``most`` adds maxima over the folders below, of expressions that may read
    ``folder`` (the folder summed into) and ``below`` (the folder added).
    """
    spread = direct.withColumnRenamed("folder", "below").withColumn(
        "folder", F.explode(folder_chain(F.col("below")))
    )
    return spread.groupBy(*keys, "folder").agg(
        *[F.sum(name).alias(name) for name in sums],
        *[F.max(value).alias(name) for name, value in (most or {}).items()],
    )


def folders(files: DataFrame, keys: Sequence[str] = ("repo",), path: str = "path") -> DataFrame:
    """Every folder of a tree, also those that only hold folders."""
    holding = files.select(*keys, folder_of(F.col(path)).alias("below")).distinct()
    every = holding.select(*keys, F.explode(folder_chain(F.col("below"))).alias("folder")).distinct()
    return every.select(
        *keys,
        "folder",
        base_name(F.col("folder")).alias("name"),
        folder_of(F.col("folder")).alias("parent"),
        depth_of(F.col("folder")).alias("depth"),
    )


def flavor_sums(flavor: Column, weight: Column) -> dict[str, Column]:
    """Magnitude per flavor, one column each: a sum over a fixed list, not a pivot pass."""
    return {
        f"flavor_{name}": F.when(flavor == name, F.abs(weight)).otherwise(F.lit(0)).cast("bigint")
        for name in FLAVORS
    }


def weigh_tree(
    frame: DataFrame,
    path: str,
    weights: Sequence[str],
    flavor: str | None = None,
    keys: Sequence[str] = (),
) -> DataFrame:
    """Subtree and direct totals of any path-keyed table with numeric weights."""
    sums: dict[str, Column] = {"files": F.lit(1).cast("bigint"), **{name: F.col(name) for name in weights}}
    if flavor is not None:
        sums.update(flavor_sums(F.col(flavor), F.col(weights[0])))
    direct = direct_totals(frame, sums, keys, path)
    own = {f"direct_{name}": name for name in ("files", *weights)}
    with_own = direct.select("*", *[F.col(name).alias(alias) for alias, name in own.items()])
    spread = with_own.withColumnRenamed("folder", "below").withColumn("folder", F.explode(folder_chain(F.col("below"))))
    here = F.col("folder") == F.col("below")
    return spread.groupBy(*keys, "folder").agg(
        *[F.sum(name).alias(name) for name in sums],
        *[F.sum(F.when(here, F.col(alias)).otherwise(F.lit(0))).alias(alias) for alias in own],
    )


def running_weights(files: DataFrame, weights: Sequence[str], keys: Sequence[str] = ("repo",)) -> DataFrame:
    """Running totals over path order: any subtree is a difference of two of them."""
    return running_totals(
        files.select(*keys, "path", *weights),
        list(keys),
        [F.col("path")],
        {f"running_{name}": F.coalesce(F.col(name), F.lit(0)) for name in weights},
    )
