"""Commit histories as tables: ancestry, ranges, and runs of commits.

``commits`` is ``(repo, sha, parents, author_date, ...)``.
"""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from massmap.functions.links import body, first_parent, subject
from massmap.operators.ordered import ranked, running_totals, top
from massmap.session import written


def ancestors(commits: DataFrame, seeds: DataFrame) -> DataFrame:
    """``(repo, seed, sha)``: every commit reachable from each seed, itself included."""
    return reachable(commits, seeds.select("repo", F.col("sha").alias("seed"), "sha"), ["seed"])


def reachable(
    commits: DataFrame, starts: DataFrame, labels: Sequence[str] = (), stop: DataFrame | None = None
) -> DataFrame:
    """``(repo, labels, sha)`` reachable from ``starts`` of the same columns, themselves included.

    Walks with different labels share their joins and do not see each other.
    ``stop`` ``(repo, sha)`` is closed under going back, and no walk enters it.

    First parents are followed in strides of 1, 2, 4, ... commits. What a walk
    has reached holds everything behind it, so a step that lands there goes no
    further, and strides end with the longest stretch that is still new. Side
    lines merged into it start the next round: a straight history of a million
    commits takes twenty joins, a round of short side lines two or three.
    Parents that are no rows of ``commits`` are reached and lead nowhere. Null
    shas start no walk.
    """
    keys = ["repo", *labels, "sha"]
    strides = [_first_parents(commits)]
    sides = commits.select("repo", "sha", F.explode(F.expr("slice(parents, 2, greatest(size(parents) - 1, 0))")).alias("__back"))
    reached: list[DataFrame] = []

    def unseen(rows: DataFrame) -> DataFrame:
        rows = rows.where("sha IS NOT NULL").distinct()
        if stop is not None:
            rows = rows.join(stop, ["repo", "sha"], "left_anti").select(*keys)
        return written(rows.join(_all(reached), keys, "left_anti") if reached else rows, "reached")

    frontier = unseen(starts.select(*keys))
    if frontier.isEmpty():
        return frontier
    while not frontier.isEmpty():
        line, stride = [frontier], 0
        reached.append(frontier)
        while True:
            if stride == len(strides):
                strides.append(_doubled(strides[-1]))
            found = unseen(_all(line).join(strides[stride], ["repo", "sha"]).select("repo", *labels, F.col("__back").alias("sha")))
            if found.isEmpty():
                break
            line.append(found)
            reached.append(found)
            stride += 1
        frontier = unseen(_all(line).join(sides, ["repo", "sha"]).select("repo", *labels, F.col("__back").alias("sha")))
    return _all(reached)


def _all(parts: list[DataFrame]) -> DataFrame:
    return functools.reduce(DataFrame.unionByName, parts)


def _first_parents(commits: DataFrame) -> DataFrame:
    step = commits.select("repo", "sha", F.get("parents", F.lit(0)).alias("__back")).where("__back IS NOT NULL").distinct()
    return written(step, "stride")


def _doubled(step: DataFrame) -> DataFrame:
    """Jumps twice as long."""
    ahead = step.select("repo", F.col("sha").alias("__back"), F.col("__back").alias("__further"))
    return written(step.join(ahead, ["repo", "__back"]).select("repo", "sha", F.col("__further").alias("__back")), "stride")


def commit_range(commits: DataFrame, base: DataFrame, target: DataFrame) -> DataFrame:
    """``(repo, sha)`` reachable from the target and not from the base.

    The walk from the target ends where the base has been.
    """
    return reachable(commits, target.select("repo", "sha"), stop=reachable(commits, base.select("repo", "sha")))


def merge_base(commits: DataFrame, one: DataFrame, other: DataFrame) -> DataFrame:
    """``(repo, sha)`` of the nearest common ancestors.

    Common ancestors are closed under going back, so the nearest are those that
    are no parent of another one. Both sides are walked in the same joins.
    """
    sides = one.select("repo", "sha", F.lit(0).alias("side")).unionByName(other.select("repo", "sha", F.lit(1).alias("side")))
    met = reachable(commits, sides, ["side"]).groupBy("repo", "sha").agg(F.count("*").alias("sides"))
    common = written(met.where("sides = 2").select("repo", "sha"), "common")
    behind = commits.join(common, ["repo", "sha"], "left_semi").select("repo", F.explode("parents").alias("sha"))
    return common.join(behind, ["repo", "sha"], "left_anti")


def revision_pairs(requests: DataFrame, names: DataFrame) -> DataFrame:
    """Add ``base_sha``, ``target_sha`` and ``refusal`` to requests ``(repo, base, target)``.

    ``names`` is ``(repo, name, sha)``, one row a name; what is not among them names a commit
    itself. Two names of one commit describe an empty change, which is refused.
    """
    found = requests
    for side in ("base", "target"):
        at = names.select("repo", F.col("name").alias(side), F.col("sha").alias(f"__{side}"))
        found = found.join(at, ["repo", side], "left").withColumn(f"{side}_sha", F.coalesce(f"__{side}", side)).drop(f"__{side}")
    same = F.format_string("nothing to compare: %s and %s are the same commit", "base", "target")
    return found.withColumn("refusal", F.when(F.col("base_sha") == F.col("target_sha"), same))


def merge_base_pairs(commits: DataFrame, requests: DataFrame) -> DataFrame:
    """Add ``base_sha``, the merge base, and ``refusal`` to one request ``(repo, base, target)`` per repository.

    Of several nearest common ancestors the smallest name is taken. Without one there is
    nothing to compare with; a target that is its own merge base has no change.
    """
    one, other = (requests.select("repo", F.col(side).alias("sha")) for side in ("base", "target"))
    nearest = merge_base(commits, one, other).groupBy("repo").agg(F.min("sha").alias("base_sha"))
    unrelated = F.format_string("no merge base between %s and %s", "base", "target")
    empty = F.format_string(
        "nothing to compare: %s is an ancestor of %s, so %s...%s is empty", "target", "base", "base", "target"
    )
    refusal = F.when(F.col("base_sha").isNull(), unrelated).when(F.col("base_sha") == F.col("target"), empty)
    return requests.join(nearest, "repo", "left").withColumn("refusal", refusal)


def without_merges(commits: DataFrame) -> DataFrame:
    return commits.where(F.size("parents") < 2)


def listed_commits(commits: DataFrame, limit: int | None = None) -> DataFrame:
    """The commits of each repository's range, oldest first as ``ord``.

    With a ``limit`` only the newest are listed and ``omitted`` counts the rest.
    """
    straight = without_merges(commits)
    order = [F.col("author_date").desc(), F.col("sha").desc()]
    newest = (
        ranked(straight, ["repo"], order, "newest") if limit is None else top(straight, ["repo"], order, limit, "newest")
    )
    totals = straight.groupBy("repo").agg(F.count("*").alias("total"))
    within = newest.join(totals, "repo")
    last = F.col("total") if limit is None else F.least(F.col("total"), F.lit(limit))
    return within.select(
        "repo",
        "sha",
        (last - F.col("newest")).cast("int").alias("ord"),
        first_parent(F.col("parents")).alias("parent"),
        subject(F.col("message")).alias("subject"),
        body(F.col("message")).alias("body"),
        "author",
        "author_date",
        (F.col("total") - last).alias("omitted"),
    )


def listed_refs(refs: DataFrame, limit: int | None = None) -> DataFrame:
    """Newest branches, remote branches and tags ``(repo, name, kind, sha, date)`` per repository."""
    order = [F.col("date").desc(), F.col("ref").asc()]
    newest = ranked(refs, ["repo"], order, "place") if limit is None else top(refs, ["repo"], order, limit, "place")
    kind = (
        F.when(F.col("ref").startswith("refs/heads/"), "branch")
        .when(F.col("ref").startswith("refs/remotes/"), "remote")
        .when(F.col("ref").startswith("refs/tags/"), "tag")
    )
    named = newest.withColumn("kind", kind).withColumn("name", F.regexp_replace("ref", "^refs/(heads|remotes|tags)/", ""))
    symbolic = (F.col("kind") == "remote") & F.col("name").endswith("/HEAD")
    return named.where(F.col("kind").isNotNull() & ~symbolic).select("repo", "place", "name", "kind", "sha")


# --- runs of a listed range: a repository of any length is spread over many tasks ----
def chained(spine: DataFrame) -> DataFrame:
    """Add ``run``: entries share it while each one's parent is the entry before."""
    order = [F.col("ord")]
    placed = ranked(spine, ["repo"], order, "__place")
    before = placed.select("repo", (F.col("__place") + 1).alias("__place"), F.col("sha").alias("__before"))
    follows = F.coalesce(F.col("__before") == F.col("parent"), F.lit(False))
    linked = placed.join(before, ["repo", "__place"], "left").select(*spine.columns, follows.alias("__follows"))
    runs = running_totals(linked, ["repo"], order, {"run": F.when(F.col("__follows"), 0).otherwise(1)})
    return runs.select(*spine.columns, F.col("run").cast("int").alias("run"))


def slid(spans: DataFrame, spine: DataFrame, delta: int) -> DataFrame:
    """Spans ``(repo, start, end)`` moved by whole entries; null where they cannot go."""
    runs = chained(spine).select("repo", "ord", "run")
    at = runs.select("repo", (F.col("ord") - delta).alias("start"), F.col("run").alias("start_run"))
    to = runs.select("repo", (F.col("ord") - delta).alias("end"), F.col("run").alias("end_run"))
    found = spans.join(at, ["repo", "start"], "left").join(to, ["repo", "end"], "left")
    allowed = F.col("start_run") == F.col("end_run")
    return found.select(
        "repo", "start", "end",
        F.when(allowed, F.col("start") + delta).alias("new_start"),
        F.when(allowed, F.col("end") + delta).alias("new_end"),
    )


def extended(anchors: DataFrame, spine: DataFrame) -> DataFrame:
    """Spans from ``(repo, anchor, reached)``, stopping at the first break of the chain."""
    runs = chained(spine)
    bounds = runs.groupBy("repo", "run").agg(F.min("ord").alias("first"), F.max("ord").alias("last"))
    placed = anchors.join(runs.select("repo", F.col("ord").alias("anchor"), "run"), ["repo", "anchor"]).join(
        bounds, ["repo", "run"]
    )
    stop = F.greatest(F.col("first"), F.least(F.col("last"), F.col("reached")))
    return placed.select(
        "repo", "anchor", "reached",
        F.least(F.col("anchor"), stop).alias("start"), F.greatest(F.col("anchor"), stop).alias("end"),
    )


def comparisons_of(spans: DataFrame, spine: DataFrame) -> DataFrame:
    """The comparison each span asks for: from the parent of its first entry to its last."""
    first = spine.select("repo", F.col("ord").alias("start"), F.col("parent").alias("base"))
    last = spine.select("repo", F.col("ord").alias("end"), F.col("sha").alias("target"))
    joined = spans.join(first, ["repo", "start"]).join(last, ["repo", "end"])
    kind = F.when(F.col("target").isNull(), "revisionToWorkingTree").otherwise("revisionPair")
    return joined.select("repo", "start", "end", kind.alias("kind"), "base", "target")


def spans_of(requests: DataFrame, spine: DataFrame, ranges: DataFrame | None = None) -> DataFrame:
    """Spans of ``(repo, base, target)`` comparisons; no row if the run between is broken.

    ``ranges`` are the comparisons the spine was listed for: the whole range is no span of
    it. A null target is the working tree.
    """
    runs = chained(spine)
    ends = runs.select("repo", F.col("sha").alias("__target"), F.col("ord").alias("end"), F.col("run").alias("end_run"))
    starts = runs.groupBy("repo", F.col("parent").alias("base")).agg(
        F.min("ord").alias("start"), F.min_by("run", "ord").alias("start_run")
    )
    if ranges is not None:
        whole = ranges.select("repo", "base", F.col("target").alias("__target"))
        requests = requests.join(
            whole.withColumnsRenamed({"repo": "__repo", "base": "__base"}),
            (F.col("repo") == F.col("__repo")) & (F.col("base") == F.col("__base")) & F.col("target").eqNullSafe(F.col("__target")),
            "left_anti",
        )
    found = requests.join(
        ends.withColumnRenamed("repo", "__repo"),
        (F.col("repo") == F.col("__repo")) & F.col("target").eqNullSafe(F.col("__target")),
    ).drop("__repo", "__target")
    return (
        found.join(starts, ["repo", "base"])
        .where("start <= `end` AND start_run = end_run")
        .select("repo", "base", "target", "start", "end")
    )
