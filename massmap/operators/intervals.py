"""Trees of a run of commits: which content a path had, from which commit to which.

A listed range is a row of trees: every commit's own, and before a commit that does not
follow the one listed before it, its parent's. Each tree's slim listing is read once. A
path that keeps its mode and content over neighbouring trees is one interval, and all
changes of the range are where intervals begin and end. These ends come from one join of
the listing with itself, a place further on, by repository, path and place: a path that
changes in every commit of a long range is spread like any other. No content is read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from massmap.operators.changes import with_blob
from massmap.operators.ordered import ranked


def tree_row(listed: DataFrame) -> DataFrame:
    """``(repo, place, rev, sha)``: trees in order; ``sha`` is null for one that is only compared with."""
    placed = ranked(listed.select("repo", "ord", "sha", "parent"), ["repo"], [F.col("ord")], "turn")
    before = placed.select("repo", (F.col("turn") + 1).alias("turn"), F.col("sha").alias("__before"))
    linked = placed.join(before, ["repo", "turn"], "left").withColumn("follows", F.expr("__before <=> parent"))
    own = linked.select("repo", "turn", F.lit(1).alias("step"), F.col("sha").alias("rev"), "sha")
    parents = linked.where("NOT follows").select(
        "repo", "turn", F.lit(0).alias("step"), F.col("parent").alias("rev"), F.lit(None).cast("string").alias("sha")
    )
    return ranked(own.unionByName(parents), ["repo"], [F.col("turn"), F.col("step")], "place").select("repo", "place", "rev", "sha")


def tree_entries(trees: DataFrame, snapshots: DataFrame) -> DataFrame:
    """``(repo, place, sha, path, mode, blob)`` of every tree; ``snapshots`` has ``rev``, and names contents by ``blob`` or is read for it."""
    slim = with_blob(snapshots).select("repo", "rev", "path", "mode", "blob")
    return trees.join(slim, ["repo", "rev"]).select("repo", "place", "sha", "path", "mode", "blob")


def interval_ends(entries: DataFrame) -> DataFrame:
    """``(repo, path, place, status, modes, blobs)`` wherever a path differs from the tree before."""
    now = entries.select("repo", "path", "place", F.col("mode").alias("after_mode"), F.col("blob").alias("after_blob"), F.lit(True).alias("is"))
    before = entries.select(
        "repo", "path", (F.col("place") + 1).alias("place"), F.col("mode").alias("before_mode"), F.col("blob").alias("before_blob"),
        F.lit(True).alias("was"),
    )
    both = now.join(before, ["repo", "path", "place"], "full_outer")
    same = "`is` <=> was AND before_mode <=> after_mode AND before_blob <=> after_blob"
    status = "CASE WHEN was IS NULL THEN 'added' WHEN `is` IS NULL THEN 'deleted' ELSE 'modified' END AS status"
    return both.where(f"NOT ({same})").selectExpr(
        "repo", "path", "place", status, "before_mode", "after_mode", "before_blob", "after_blob"
    )


def path_intervals(entries: DataFrame) -> DataFrame:
    """``(repo, path, mode, blob, from_place, to_place)``: maximal runs of trees in which a path stays the same.

    The n-th beginning of a path belongs to its n-th end; both are numbered slice by slice.
    """
    ends = interval_ends(entries)
    begun = ends.where("status != 'deleted'").select("repo", "path", F.col("place").alias("from_place"), F.col("after_mode").alias("mode"), F.col("after_blob").alias("blob"))
    over = ends.where("status != 'added'").select("repo", "path", (F.col("place") - 1).alias("to_place"))
    path = ["repo", "path"]
    first = ranked(begun, path, [F.col("from_place")], "turn")
    last = ranked(over, path, [F.col("to_place")], "turn")
    return first.join(last, [*path, "turn"]).select("repo", "path", "mode", "blob", "from_place", "to_place")


def interval_changes(entries: DataFrame, trees: DataFrame) -> DataFrame:
    """Changes of every listed commit, in the columns of ``changed_paths`` keyed by ``(repo, sha)``."""
    commits = trees.where("sha IS NOT NULL").select("repo", "place", "sha")
    return interval_ends(entries).join(commits, ["repo", "place"]).select(
        "repo", "sha", "path", F.col("path").alias("base_path"), "status", "before_mode", "after_mode", "before_blob", "after_blob"
    )


def changed_contents(changes: DataFrame, snapshots: DataFrame) -> DataFrame:
    """``(repo, blob, size, content)``: each content that a change names, once."""
    names = F.explode(F.array("before_blob", "after_blob")).alias("blob")
    wanted = changes.select("repo", names).where("blob IS NOT NULL").distinct()
    held = with_blob(snapshots).select("repo", "blob", "size", "content").join(wanted, ["repo", "blob"], "left_semi")
    return held.dropDuplicates(["repo", "blob"])


def changed_sides(changes: DataFrame, contents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both snapshots of every commit, of the changed paths alone: ``(repo, sha, path, mode, size, content, blob)``."""

    def side(path: str, at: str) -> DataFrame:
        rows = changes.where(F.col(f"{at}_blob").isNotNull())
        rows = rows.select("repo", "sha", F.col(path).alias("path"), F.col(f"{at}_mode").alias("mode"), F.col(f"{at}_blob").alias("blob"))
        return rows.join(contents, ["repo", "blob"])

    return side("base_path", "before"), side("path", "after")
