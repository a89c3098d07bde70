"""Folders that hold one entry per language, and the files that are such an entry."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from massmap.functions.classify import locale_name, locale_shaped, regioned_locale
from massmap.functions.fixed_values import I18N_FOLDERS, LOCALE_LEVEL_SHARE, MIN_LOCALE_ENTRIES
from massmap.functions.paths import base_name, folder_chain, folder_names, folder_of, stem
from massmap.functions.text import one_of
from massmap.session import written


def _lower_folder(path):
    return F.array_join(folder_names(path), "/")


def locale_levels(listing: DataFrame, keys: Sequence[str] = ("repo",)) -> DataFrame:
    """``(keys, folder)`` of every locale level of a complete listing, lower-cased.

    Distinct (folder, entry) pairs come first, so a folder of a billion copies of
    one name costs one row, and the verdict is a plain aggregate.
    """
    lower = F.lower(F.col("path"))
    placed = listing.select(*keys, _lower_folder(F.col("path")).alias("folder"), stem(base_name(lower)).alias("entry"))
    entries = placed.distinct()
    chains = (
        entries.select(*keys, "folder")
        .distinct()
        .select(*keys, F.explode(folder_chain(F.col("folder"))).alias("child"))
        .where(F.col("child") != "")
        .distinct()
        .select(*keys, folder_of(F.col("child")).alias("folder"), base_name(F.col("child")).alias("entry"))
    )
    judged = (
        entries.unionByName(chains)
        .distinct()
        .groupBy(*keys, "folder")
        .agg(
            F.bool_and(locale_shaped(F.col("entry"))).alias("all_shaped"),
            F.count_if(locale_name(F.col("entry"))).alias("known"),
            F.count("*").alias("entries"),
        )
    )
    by_entries = (
        F.col("all_shaped")
        & (F.col("known") >= MIN_LOCALE_ENTRIES)
        & (F.col("known") >= F.col("entries") * LOCALE_LEVEL_SHARE)
    )
    return judged.where(one_of(base_name(F.col("folder")), I18N_FOLDERS) | by_entries).select(*keys, "folder")


def with_locale_copy(
    files: DataFrame, levels: DataFrame, keys: Sequence[str] = ("repo",), name: str = "locale_copy"
) -> DataFrame:
    """Add whether each file is one language's copy of something.

    ``files`` should be slim: give it its texts afterwards. It is joined once, on its
    own folder, to the few folders that matter.
    A file counts when a level is its own folder and its stem is a locale, or
    when a locale-named folder above it sits in a level. The levels are asked
    twice, so they are written once instead of being worked out twice.
    """
    levels = written(levels, "levels")
    placed = files.withColumn("__folder", _lower_folder(F.col("path"))).withColumn(
        "__stem", stem(base_name(F.lower(F.col("path"))))
    )
    steps = (
        files.select(*keys, _lower_folder(F.col("path")).alias("__folder"))
        .distinct()
        .withColumn("step", F.explode(folder_chain(F.col("__folder"))))
        .withColumn("folder", folder_of(F.col("step")))
    )
    inside = (
        steps.where(locale_name(base_name(F.col("step"))))
        .join(levels, [*keys, "folder"], "left_semi")
        .select(*keys, "__folder", F.lit(True).alias("__inside"))
    )
    own = levels.select(*keys, F.col("folder").alias("__folder"), F.lit(True).alias("__level"))
    marks = inside.unionByName(own, allowMissingColumns=True).groupBy(*keys, "__folder").agg(
        F.coalesce(F.bool_or("__inside"), F.lit(False)).alias("__inside"),
        F.coalesce(F.bool_or("__level"), F.lit(False)).alias("__level"),
    )
    joined = placed.join(marks, [*keys, "__folder"], "left")
    copy = (
        regioned_locale(F.col("__stem"))
        | F.exists(F.split(F.col("__folder"), "/"), regioned_locale)
        | F.coalesce(F.col("__inside"), F.lit(False))
        | (F.coalesce(F.col("__level"), F.lit(False)) & locale_name(F.col("__stem")))
    )
    return joined.withColumn(name, copy).select(*files.columns, name)
