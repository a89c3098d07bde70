"""Session helpers: a local session for tests and benches, and lineage cuts."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(
    cores: str = "8", shuffle_partitions: int = 8, driver_memory: str = "8g", folder: str | None = None
) -> SparkSession:
    """A one-machine session for tests and benches. Clusters bring their own.

    ``folder`` is where intermediate tables go; without one a new folder of this
    machine is made, which all tasks of a local session share.
    """
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("massmap")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", driver_memory)
        .config("massmap.input.partitions", cores)
        .config("spark.checkpoint.dir", folder or tempfile.mkdtemp(prefix="massmap-"))
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Executors come and go, so nothing that must outlive a task is put anywhere
    else. Only a local session may fall back to a folder of this machine.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):  # local-cluster has executors of its own
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    fallback = os.path.join(tempfile.gettempdir(), f"massmap-{spark.sparkContext.applicationId}")
    spark.conf.set("spark.checkpoint.dir", fallback)
    return fallback


def written(frame: DataFrame, label: str = "stage") -> DataFrame:
    """The same rows, read back from a table in the shared folder.

    Cuts lineage, survives lost executors, and makes a frame that many answers
    read cost one computation. Reading back also prunes columns per answer.
    """
    spark = frame.sparkSession
    place = f"{shared_folder(spark)}/massmap-{label}-{uuid.uuid4().hex}"
    frame.write.parquet(place)
    return spark.read.schema(frame.schema).parquet(place)
