"""Reading trees and snapshots, keeping a measured index, previews, exports."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_tree(spark: SparkSession, root: str, repo: str, located: bool = False) -> DataFrame:
    """A directory as ``(repo, path, mode, size, content)`` with paths below ``root``.

    Size filters reach the file listing, and content is only opened when selected.
    ``located`` adds ``location``, the whole path of the file.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    below = F.substring_index(F.col("path"), f"{root.rstrip('/').split('://')[-1].rstrip('/')}/", -1)
    return files.select(
        F.lit(repo).alias("repo"), below.alias("path"), F.lit("100644").alias("mode"),
        F.col("length").alias("size"), "content", *([F.col("path").alias("location")] if located else []),
    )


def revision(snapshots: DataFrame, repo: str | None = None, rev: str | None = None) -> DataFrame:
    """One revision's complete listing; on a table partitioned by repo and rev, a pruned read."""
    if repo is not None:
        snapshots = snapshots.where(F.col("repo") == repo)
    return snapshots if rev is None else snapshots.where(F.col("rev") == rev)


def revisions(snapshots: DataFrame, wanted: DataFrame) -> DataFrame:
    """The complete listings of the revisions ``(repo, rev)`` asked for, however many.

    What is asked for twice is listed once; a revision that is not there has no rows.
    """
    return snapshots.join(wanted.select("repo", "rev"), ["repo", "rev"], "left_semi").select(*snapshots.columns)


def distinct_listing(listing: DataFrame, keys: Sequence[str] = ("repo",)) -> DataFrame:
    return listing.select(*keys, "path").distinct()


def save_index(files: DataFrame, place: str, mode: str = "errorifexists") -> None:
    """Keep a measured index: ordered by path inside each file, so path prefixes skip row groups.

    Rows are spread by repository and path together; a huge repository is many
    files, a small one a single one.
    """
    ordered = files.repartitionByRange("repo", "path").sortWithinPartitions("repo", "path")
    ordered.write.mode(mode).parquet(place)


def load_index(spark: SparkSession, place: str) -> DataFrame:
    return spark.read.parquet(place)


def export_snapshot(
    place: str, files: DataFrame, folders: DataFrame, spine: DataFrame | None, previews: DataFrame
) -> None:
    """Write files, folders, spine and one source record per file: all of them or nothing.

    The parts are written to a staging folder beside ``place``, which takes the name
    ``place`` in one step once every part is there. A place that holds anything is
    refused before any work and again at that step. Whatever fails, the staging folder goes and
    ``place`` is as it was, so the next try starts afresh. On stores without an
    atomic rename the step is only as safe as theirs.
    """
    spark = files.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs
    target = hadoop.Path(place.rstrip("/"))
    store = target.getFileSystem(spark._jsc.hadoopConfiguration())
    staging = hadoop.Path(f"{target.toString()}.staging-{uuid.uuid4().hex}")

    def refuse_if_taken() -> None:
        if store.exists(target) and (store.getFileStatus(target).isFile() or len(store.listStatus(target))):
            raise FileExistsError(f"{place} is not empty")

    refuse_if_taken()
    parts = {"files": files, "folders": folders, "sources": previews}
    if spine is not None:
        parts["spine"] = spine
    try:
        for name, frame in parts.items():
            frame.write.mode("errorifexists").parquet(f"{staging.toString()}/{name}")
        refuse_if_taken()
        if store.exists(target):
            store.delete(target, False)  # refuses a folder that has filled up meanwhile
        if target.getParent() is not None:
            store.mkdirs(target.getParent())
        if not store.rename(staging, target):
            raise OSError(f"{staging.toString()} could not take the name {place}")
    finally:
        if store.exists(staging):
            store.delete(staging, True)


def cut_text(text: Column, limit: int) -> Column:
    """The longest whole-character prefix of a text within ``limit`` UTF-8 bytes."""
    raw = F.encode(text, "UTF-8")
    # A UTF-8 character is at most four bytes, so one of these four cuts is whole.
    cuts = [F.try_validate_utf8(F.substring(raw, 1, limit - drop).cast("string")) for drop in range(4)]
    return F.when(F.octet_length(text) <= limit, text).otherwise(F.coalesce(*cuts))


def previews(texts: DataFrame, limit: int | None = None) -> DataFrame:
    """Whole texts, or their first ``limit`` bytes: ``(repo, path, content, truncated, total_bytes, error)``; unmeasured rows state why instead."""
    return texts.select(
        "repo",
        "path",
        (F.col("text") if limit is None else cut_text(F.col("text"), limit)).alias("content"),
        (F.octet_length("text") > (F.octet_length("text") if limit is None else limit)).alias("truncated"),
        F.octet_length("text").cast("bigint").alias("total_bytes"),
        F.when(F.col("measurement") != "measured", F.concat(F.lit("file is "), "measurement")).alias("error"),
    )


def cut_lines(aligned: DataFrame, keys: Sequence[str] = ("repo",), limit: int | None = None) -> DataFrame:
    """Leading whole lines of each file's aligned listing within ``limit`` bytes.

    The running sum stays inside one file; a file that was read as one row sets its size.
    """
    from pyspark.sql import Window

    so_far = Window.partitionBy(*keys, "path").orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    size = F.sum(F.octet_length("text") + 1).over(so_far)
    sized = aligned.withColumn("bytes", size.cast("bigint"))
    return sized if limit is None else sized.where(F.col("bytes") <= limit)
