"""Commit messages, revisions, comparisons, remotes and review urls as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from massmap.functions import fixed_values as V
from massmap.functions.text import trimmed


def subject(message: Column) -> Column:
    return trimmed(F.substring_index(message, "\n", 1))


def body(message: Column, most: int | None = None) -> Column:
    """The message below its subject; with ``most``, cut with an ellipsis past so many characters."""
    rest = trimmed(F.when(message.contains("\n"), F.regexp_replace(message, r"^[^\n]*\n", "")).otherwise(""))
    if most is None:
        return rest
    cut = F.regexp_replace(F.substring(rest, 1, most), rf"[{V.SPACE}]+\z", "")
    return F.when(F.length(rest) > most, F.concat(cut, F.lit("..."))).otherwise(rest)


def first_parent(parents: Column) -> Column:
    return F.coalesce(F.get(parents, F.lit(0)), F.lit(V.EMPTY_TREE))


def short_revision(rev: Column) -> Column:
    number = F.regexp_extract(rev, V.REVIEW_REF, 1)
    return (
        F.when(number != "", F.concat(F.lit("PR "), number))
        .when(rev.rlike(V.WHOLE_OBJECT_NAME), F.substring(rev, 1, 10))
        .otherwise(rev)
    )


def comparison_label(kind: Column, base: Column, target: Column) -> Column:
    pair = F.concat(short_revision(base), F.lit(" -> "), short_revision(target))
    return (
        F.when(kind == "workingTree", "HEAD -> working tree")
        .when(kind == "staged", "HEAD -> index")
        .when(kind == "revisionToWorkingTree", F.concat(short_revision(base), F.lit(" -> working tree")))
        .when(kind == "revisionPair", pair)
        .when(kind == "mergeBase", F.concat(pair, F.lit(", from the merge base")))
    )


def comparison_key(kind: Column, base: Column, target: Column) -> Column:
    """One string that two requests share exactly when they are the same comparison."""
    return (
        F.when(kind.isin("workingTree", "staged"), kind)
        .when(kind == "revisionToWorkingTree", F.concat_ws(" ", kind, base))
        .otherwise(F.concat_ws(" ", kind, base, target))
    )


def _project_path(raw: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(raw, r"\.git$", ""), "^/+|/+$", "")


def project(remote: Column) -> Column:
    """``struct<host, path, web_path>`` of a remote in either spelling; null if it is none."""
    scp = remote.rlike(V.SCP_REMOTE)
    pattern_known = scp | remote.rlike(V.URL_REMOTE)

    def part(group: int) -> Column:
        return F.when(scp, F.regexp_extract(remote, V.SCP_REMOTE, group)).otherwise(
            F.regexp_extract(remote, V.URL_REMOTE, group)
        )

    web = _project_path(part(2))
    return F.when(
        pattern_known,
        F.struct(F.lower(part(1)).alias("host"), F.lower(web).alias("path"), web.alias("web_path")),
    )


def commit_url_base(remote: Column) -> Column:
    place = project(remote)
    route = F.when(place["host"].contains("gitlab"), "-/commit").otherwise("commit")
    return F.when(
        place.isNotNull(), F.concat(F.lit("https://"), F.concat_ws("/", place["host"], place["web_path"], route), F.lit("/"))
    )


def review(url: Column) -> Column:
    """``struct<host, path, number, label>`` of a review page; null for any other url."""
    host, path, route, number = (F.regexp_extract(url, V.REVIEW_URL, group) for group in (1, 2, 3, 4))
    label = F.when(route == "merge_requests", F.concat(F.lit("MR !"), number)).otherwise(
        F.concat(F.lit("PR #"), number)
    )
    return F.when(
        url.rlike(V.REVIEW_URL),
        F.struct(F.lower(host).alias("host"), F.lower(_project_path(path)).alias("path"),
                 number.cast("bigint").alias("number"), label.alias("label")),
    )
