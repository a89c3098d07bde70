"""Continuous rescan: newly arriving file versions replace the rows they outdate.

An index is a folder of slices and of manifests. A slice is all paths of one hash
bucket; a manifest names the slice of every bucket. Nothing is overwritten: a batch
writes the slices it touches anew and then one manifest of one file, which is the
switch. Readers of an older manifest keep their slices.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from massmap.session import written

BUCKETS = 64


def keep_newest(frame: DataFrame) -> DataFrame:
    """The newest version of every path. One aggregate; a version is one row, so no group is wide.

    Of a removal and a file of the same version the removal stays.
    """
    keys = ["repo", "path"]
    others = [name for name in frame.columns if name not in keys]
    order = F.struct("version", "removed") if "removed" in others else F.col("version")
    newest = frame.groupBy(*keys).agg(F.max_by(F.struct(*others), order).alias("newest"))
    return newest.select(*keys, "newest.*")


def with_bucket(frame: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """A slice of the table that one batch rewrites: by path, so a huge repository is many slices."""
    return frame.withColumn("bucket", F.pmod(F.xxhash64("repo", "path"), F.lit(buckets)).cast("int"))


def removed_paths(held: DataFrame, listing: DataFrame, repos: DataFrame, version: int) -> DataFrame:
    """Removals for the paths of ``repos`` that a complete ``(repo, path)`` listing of them no longer has.

    A repository is met in ``BUCKETS`` parts, so one that holds most rows is not one task.
    """
    part = F.pmod(F.xxhash64("path"), F.lit(BUCKETS)).cast("int")
    parts = repos.select("repo").distinct().withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(BUCKETS - 1))))
    of_repos = held.withColumn("part", part).join(parts, ["repo", "part"], "left_semi").drop("part")
    gone = of_repos.join(listing.select("repo", "path"), ["repo", "path"], "left_anti")
    return gone.withColumns(
        {"version": F.lit(version).cast(held.schema["version"].dataType), "removed": F.lit(True)}
    )


def merge_batch(index: str, buckets: int = BUCKETS) -> Callable[[DataFrame, int], None]:
    """Batch writer for ``foreachBatch``. Running a batch twice leaves the same rows.

    A row with ``removed`` set takes its path out of the index; it stays as a mark, so
    that an older version arriving late does not bring the path back. ``buckets`` counts
    for a new index, an old one keeps its own: more buckets, fewer rows rewritten a path.
    """

    def merge(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        number, parts, slices = _manifest(spark, index)
        parts = parts or buckets
        if "removed" not in batch.columns:
            batch = batch.withColumn("removed", F.lit(False))
        flagged = batch.withColumn("removed", F.coalesce("removed", F.lit(False)))
        arrived = written(with_bucket(keep_newest(flagged), parts), "arrived")
        # At most one row a bucket.
        touched = [row.bucket for row in arrived.select("bucket").distinct().collect()]
        if not touched:
            return
        outdated = [_slice(index, slices[bucket], bucket) for bucket in touched if bucket in slices]
        if outdated:
            plain = arrived.drop("bucket")
            held = spark.read.schema(plain.schema).parquet(*outdated)
            arrived = with_bucket(keep_newest(plain.unionByName(held)), parts)
        # A try that was cut short left this number without a manifest.
        arrived.repartition(len(touched), "bucket").write.mode("overwrite").partitionBy("bucket").parquet(
            f"{index}/slices/{number + 1}"
        )
        now = slices | dict.fromkeys(touched, number + 1)
        rows = [(number + 1, parts, bucket, at) for bucket, at in sorted(now.items())]
        manifest = spark.createDataFrame(rows, "number int, buckets int, bucket int, slice int")
        manifest.coalesce(1).write.mode("append").parquet(f"{index}/manifests")

    return merge


def current(spark: SparkSession, index: str) -> DataFrame:
    """The rows of the newest manifest without removed paths."""
    _, _, slices = _manifest(spark, index)
    if not slices:
        raise ValueError(f"nothing has been merged into {index}")
    rows = spark.read.parquet(*[_slice(index, number, bucket) for bucket, number in slices.items()])
    return rows.where("NOT removed").drop("removed")


def _slice(index: str, number: int, bucket: int) -> str:
    return f"{index}/slices/{number}/bucket={bucket}"


def _manifest(spark: SparkSession, index: str) -> tuple[int, int, dict[int, int]]:
    """Number, bucket count and slices of the newest manifest: one row a bucket."""
    if not _exists(spark, f"{index}/manifests"):
        return 0, 0, {}
    manifests = spark.read.schema("number int, buckets int, bucket int, slice int").parquet(f"{index}/manifests")
    newest = manifests.agg(F.max("number")).first()[0]
    if newest is None:  # cut short before the first one was complete
        return 0, 0, {}
    rows = manifests.where(F.col("number") == newest).collect()
    return newest, rows[0].buckets, {row.bucket: row.slice for row in rows}


def _exists(spark: SparkSession, place: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(place)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def rescan(
    versions: DataFrame, measure: Callable[[DataFrame], DataFrame], index: str, checkpoint: str, buckets: int = BUCKETS
) -> StreamingQuery:
    """Measure a stream of ``(repo, path, version, text[, removed])`` and merge it into the index.

    Measuring is stateless, so the stream keeps no state; the checkpoint moves
    only after a batch is merged. ``current`` reads the index.
    """
    return (
        measure(versions)
        .writeStream.option("checkpointLocation", checkpoint)
        .foreachBatch(merge_batch(index, buckets))
        .trigger(availableNow=True)
        .start()
    )
