"""F: the lookups as joins, each on its own."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import oracle as O
from massmap.functions.paths import folder_chain, folder_of
from massmap.operators.hierarchy import folders
from massmap.operators.locales import locale_levels
from massmap.sources import adapters as A


def listing(spark, sf):
    return A.corpus(spark, sf).select("repo", "path")


def f3(spark, sf):
    """Files that sit in a locale level."""
    rows = listing(spark, sf).withColumn("folder", F.lower(folder_of(F.col("path"))))
    return rows.join(locale_levels(listing(spark, sf)), ["repo", "folder"], "left_semi").select("repo", "path")


def f4(spark, sf):
    """Folders no listed folder holds, by joining their ancestors to the list as a table."""
    listed = A.table(spark, sf, "documents").select(F.col("source").alias("repo"), F.get(F.array(*[F.lit(f"m0/{f}") for f in A.FOLDERS]), (F.col("doc_id") % 31).cast("int")).alias("step")).where("step LIKE '%docs%'").distinct()
    every = folders(listing(spark, sf)).select("repo", "folder")
    below = every.withColumn("step", F.explode(folder_chain(F.col("folder")))).join(listed, ["repo", "step"], "left_semi")
    return every.join(below, ["repo", "folder"], "left_anti")


def f7(spark, sf):
    """Each folder with the number of its child folders."""
    rows = folders(listing(spark, sf))
    children = rows.where("parent IS NOT NULL").groupBy("repo", F.col("parent").alias("folder")).agg(F.count("*").alias("children"))
    return rows.select("repo", "folder").join(children, ["repo", "folder"], "left").select("repo", "folder", F.coalesce("children", F.lit(0)).alias("children"))


def f8(spark, sf):
    """Descendants of every folder, counted by an equi join on ancestors."""
    rows = listing(spark, sf)
    steps = rows.select("repo", F.explode(folder_chain(folder_of(F.col("path")))).alias("folder"))
    return folders(rows).select("repo", "folder").join(steps.groupBy("repo", "folder").agg(F.count("*").alias("below")), ["repo", "folder"])


def f9(spark, sf):
    """Paths with their stored size; a path without one is unreadable."""
    stored = A.byte_snapshots(spark, sf).where("size IS NOT NULL").select("repo", "path", "size")
    joined = listing(spark, sf).join(stored, ["repo", "path"], "left")
    return joined.select("repo", "path", F.col("size").isNull().alias("unreadable"))


FOLDERS = f"folders AS (SELECT DISTINCT repo, unnest({O.folders_above('path')}) AS folder FROM corpus)"

ENTRIES = [
    ("f3_in_locale_level", f3, O.with_ctes(f"{O.CORPUS},{O.PARTS},{O.LEVELS}", "SELECT n.repo, n.path FROM named n JOIN levels v ON v.repo = n.repo AND v.dir = n.dir")),
    ("f4_outside_listed_folders", f4, O.with_ctes(f"{O.CORPUS},{FOLDERS}, listed AS (SELECT DISTINCT source AS repo, ({O.array(f'm0/{f}' for f in A.FOLDERS)})[1 + doc_id % 31] AS step FROM documents)",
     "SELECT repo, folder FROM folders f WHERE NOT EXISTS (SELECT 1 FROM listed l WHERE l.repo = f.repo AND contains(l.step, 'docs') AND (f.folder = l.step OR starts_with(f.folder, l.step || '/')))")),
    ("f7_folder_children", f7, O.with_ctes(f"{O.CORPUS},{FOLDERS}", f"SELECT repo, folder, (SELECT count(*) FROM folders c WHERE c.repo = f.repo AND c.folder <> '' AND {O.folder('c.folder')} = f.folder) AS children FROM folders f")),
    ("f8_descendants", f8, O.with_ctes(f"{O.CORPUS},{FOLDERS}", "SELECT f.repo, f.folder, count(*) AS below FROM folders f JOIN corpus c ON c.repo = f.repo AND (f.folder = '' OR starts_with(c.path, f.folder || '/')) GROUP BY ALL")),
    ("f9_sizes_by_path", f9, O.with_ctes(O.CORPUS, "SELECT repo, path, doc_id % 11 = 7 AS unreadable FROM corpus")),
]
