"""Every commit of a range against its own first parent, in one job."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from massmap.operators.intervals import changed_contents, changed_sides, interval_changes, tree_entries, tree_row
from massmap.plans.diff import compared
from massmap.session import written

COUNTS = ["added_tokens", "removed_tokens", "added_lines", "removed_lines", "added_code_lines", "removed_code_lines"]


def commit_sides(listed: DataFrame, snapshots: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The two snapshots of every listed commit, keyed by ``(repo, sha)``.

    ``snapshots`` is ``(repo, rev, path, mode, size, content[, blob])``. A commit
    without a parent has the empty tree before it, which is simply no rows.
    """
    others = [name for name in snapshots.columns if name not in ("repo", "rev")]
    before = listed.select("repo", "sha", F.col("parent").alias("rev")).join(snapshots, ["repo", "rev"])
    after = listed.select("repo", "sha", F.col("sha").alias("rev")).join(snapshots, ["repo", "rev"])
    return before.select("repo", "sha", *others), after.select("repo", "sha", *others)


def commit_files(listed: DataFrame, snapshots: DataFrame, renames: bool = True, **options) -> DataFrame:
    """Every listed commit against its parent, one row per changed file.

    Changes are the ends of intervals (see ``operators/intervals.py``); each changed
    content is fetched once, however many commits name it.
    """
    trees = written(tree_row(listed), "trees")
    entries = written(tree_entries(trees, snapshots), "entries")
    changes = written(interval_changes(entries, trees), "changes")
    contents = written(changed_contents(changes, snapshots), "contents")
    before, after = changed_sides(changes, contents)
    listing = entries.where("sha IS NOT NULL").select("repo", "sha", "path")
    return compared(changes, before, after, listing, keys=("repo", "sha"), renames=renames, **options)


def commit_totals(files: DataFrame, keys: Sequence[str] = ("repo", "sha")) -> DataFrame:
    """Per commit; nobody wrote a generated file, so it is not part of a commit."""
    written_by_hand = files.where("measurement = 'measured' AND NOT generated")
    return written_by_hand.groupBy(*keys).agg(
        F.count("*").alias("files"), *[F.sum(name).alias(name) for name in COUNTS]
    )


def spine(listed: DataFrame, files: DataFrame, working_tree: DataFrame | None = None) -> DataFrame:
    """Listed commits with their totals, then the uncommitted change where there is one.

    ``working_tree`` is the file rows of the tree against each repository's newest commit.
    """
    totals = commit_totals(files)
    zero = F.lit(0).cast("bigint")
    entries = listed.join(totals, ["repo", "sha"], "left").select(
        "repo", "ord", F.lit("commit").alias("kind"), "sha", "parent", "subject", "body",
        *[F.coalesce(F.col(name), zero).alias(name) for name in ("files", *COUNTS)],
    )
    if working_tree is None:
        return entries
    head = listed.groupBy("repo").agg(F.max("ord").alias("last"), F.max_by("sha", "ord").alias("parent"))
    loose = working_tree.select("repo").distinct()
    sums = commit_totals(working_tree, ("repo",))
    last = loose.join(head, "repo").join(sums, "repo", "left").select(
        "repo", (F.col("last") + 1).alias("ord"), F.lit("workingTree").alias("kind"),
        F.lit(None).cast("string").alias("sha"), "parent", F.lit("Uncommitted changes").alias("subject"),
        F.lit("").alias("body"), *[F.coalesce(F.col(name), zero).alias(name) for name in ("files", *COUNTS)],
    )
    return entries.unionByName(last)


def heaviest_churn(entries: DataFrame, measure: str = "tokens") -> DataFrame:
    return entries.groupBy("repo").agg(
        F.max(F.col(f"added_{measure}") + F.col(f"removed_{measure}")).alias("heaviest")
    )
