"""Which paths are read at all, and why the others are not."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from massmap.functions import fixed_values as V
from massmap.functions.paths import base_name, folder_chain, folder_of
from massmap.functions.text import decoded

EXPORT_MARKER = ".massmap-export"


def _folder_parts(path: Column) -> Column:
    """Folder names above a file, as written."""
    parts = F.split(path, "/")
    return F.filter(F.slice(parts, F.lit(1), F.size(parts) - 1), lambda part: (part != "") & (part != "."))


def in_folder_named(path: Column, names: Sequence[str]) -> Column:
    if not names:
        return F.lit(False)
    return F.arrays_overlap(_folder_parts(path), F.array(*[F.lit(name) for name in names]))


def walkable(listing: DataFrame) -> DataFrame:
    """What a directory walk keeps. A repository listing does not skip these folders."""
    return listing.where(~in_folder_named(F.col("path"), V.SKIPPED_FOLDERS))


def outside_exports(
    listing: DataFrame, inventory: DataFrame | None = None, marker: str = EXPORT_MARKER, keys: Sequence[str] = ("repo",)
) -> DataFrame:
    """Drop everything under a folder that holds an export marker file.

    The folders under a marker are worked out on distinct folders; the listing
    itself is anti-joined once on the folder each path sits in.
    """
    source = listing if inventory is None else inventory
    roots = (
        source.where(base_name(F.col("path")) == marker)
        .select(*keys, folder_of(F.col("path")).alias("root"))
        .distinct()
    )
    placed = listing.withColumn("__folder", folder_of(F.col("path")))
    hidden = (
        placed.select(*keys, "__folder")
        .distinct()
        .withColumn("root", F.explode(folder_chain(F.col("__folder"))))
        .join(roots, [*keys, "root"], "left_semi")
        .select(*keys, "__folder")
        .distinct()
    )
    return placed.join(hidden, [*keys, "__folder"], "left_anti").select(*listing.columns)


def unread_reason(path: Column, mode: Column, size: Column, exclude: Sequence[str], max_bytes: int | None) -> Column:
    """Why a scan does not read a file; null when it does. No content is needed."""
    reason = (
        F.when(in_folder_named(path, exclude), "excluded")
        .when(mode == V.SYMLINK_MODE, "symlink")
        .when(mode == V.SUBMODULE_MODE, "submodule")
        .when(size.isNull(), "unreadable")
    )
    return reason if max_bytes is None else reason.when(size > max_bytes, "too-large")


def admit(
    snapshots: DataFrame, exclude: Sequence[str] = (), max_bytes: int | None = None
) -> DataFrame:
    """Add ``measurement`` and ``text``; rows refused by name never read ``content``.

    Files of any size are read unless the caller sets a ceiling.

    The two branches are separate so that the refused one prunes the content
    column out of its scan.
    """
    reason = unread_reason(F.col("path"), F.col("mode"), F.col("size"), exclude, max_bytes)
    others = [name for name in snapshots.columns if name != "content"]
    refused = (
        snapshots.select(*others)
        .withColumn("measurement", reason)
        .where(F.col("measurement").isNotNull())
        .withColumn("text", F.lit(None).cast("string"))
    )
    read = snapshots.where(reason.isNull()).withColumn("__read", decoded(F.col("content")))
    accepted = read.select(
        *others,
        F.when(F.col("content").isNull(), "unreadable")
        .otherwise(F.coalesce(F.col("__read.reason"), F.lit("measured")))
        .alias("measurement"),
        F.col("__read.text").alias("text"),
    )
    return refused.unionByName(accepted)


def ignored(
    listing: DataFrame, rules: DataFrame, keys: Sequence[str] = ("repo",)
) -> DataFrame:
    """``(keys, path)`` of files an ignore file covers.

    ``rules`` is ``ignore_rules`` output. Each candidate is a file or a folder
    above one; the last rule of a scope that matches it decides in that scope,
    any scope may ignore it, and an ignored folder takes everything below.

    A scope is one row with all its rules in order, so candidates meet scopes,
    never rules: rows stay paths by depth however long an ignore file is.
    """
    files = listing.select(*keys, "path", F.col("path").alias("entry"), F.lit(False).alias("is_folder"))
    holding = listing.select(*keys, folder_of(F.col("path")).alias("folder")).distinct()
    steps = holding.select(*keys, "folder", F.explode(folder_chain(F.col("folder"))).alias("entry")).where("entry != ''")
    entries = files.select(*keys, "entry", "is_folder").unionByName(
        steps.select(*keys, "entry").distinct().withColumn("is_folder", F.lit(True))
    )
    scoped = entries.withColumn("base", F.explode(folder_chain(folder_of(F.col("entry")))))
    inside = F.when(F.col("base") == "", F.col("entry")).otherwise(
        F.substr(F.col("entry"), F.length("base") + 2)
    )
    verdicts = (
        scoped.join(_scopes(rules, keys), [*keys, "base"])
        .where(_last_match_ignores(inside, F.col("is_folder"), F.col("runs")))
        .select(*keys, "entry", "is_folder")
        .distinct()
    )
    ignored_folders = verdicts.where("is_folder").select(*keys, "entry")
    covered = steps.join(ignored_folders, [*keys, "entry"], "left_semi").select(*keys, "folder").distinct()
    by_folder = (
        listing.withColumn("folder", folder_of(F.col("path")))
        .join(covered, [*keys, "folder"], "left_semi")
        .select(*keys, "path")
    )
    by_name = verdicts.where("NOT is_folder").select(*keys, F.col("entry").alias("path"))
    return by_folder.unionByName(by_name).distinct()


def _scopes(rules: DataFrame, keys: Sequence[str]) -> DataFrame:
    """``(keys, base, runs)``: the rules of each ignore file as one row, in order.

    Neighbours that all ignore or all re-admit are one run, whose order among
    themselves decides nothing: a run is one pattern for folders and one, without
    the rules for folders only, for files (null if none is left).
    """
    scope = Window.partitionBy(*keys, "base").orderBy("position")
    turned = F.coalesce((F.col("negated") != F.lag("negated").over(scope)).cast("int"), F.lit(0))
    numbered = rules.withColumn("__turned", turned).withColumn("__run", F.sum("__turned").over(scope))
    runs = numbered.groupBy(*keys, "base", "__run", "negated").agg(
        F.concat_ws("|", F.collect_set("pattern")).alias("folders"),
        F.concat_ws("|", F.collect_set(F.when(~F.col("folders_only"), F.col("pattern")))).alias("files"),
    )
    run = F.struct("__run", "negated", "folders", F.when(F.col("files") != "", F.col("files")).alias("files"))
    return runs.groupBy(*keys, "base").agg(F.sort_array(F.collect_list(run)).alias("runs"))


def _last_match_ignores(entry: Column, is_folder: Column, runs: Column) -> Column:
    """Whether the last run of a scope that matches is one that ignores."""
    matches = lambda run: F.call_function("rlike", entry, F.when(is_folder, run["folders"]).otherwise(run["files"]))
    return F.aggregate(
        runs, F.lit(False), lambda verdict, run: F.when(matches(run), ~run["negated"]).otherwise(verdict)
    )


def ignore_rules(ignore_files: DataFrame, keys: Sequence[str] = ("repo",)) -> DataFrame:
    """Rules of ignore files ``(keys, path, text)``: base, position, pattern, negated, folders_only.

    Globs become regular expressions column-wise: ``**`` crosses folders, ``*``
    and ``?`` do not, a pattern with an inner slash is tied to its folder.
    """
    lines = ignore_files.select(
        *keys,
        folder_of(F.col("path")).alias("base"),
        F.posexplode(F.split("text", "\r?\n")).alias("position", "raw"),
    )
    unspaced = F.regexp_replace("raw", r"([^\\])[ \t]+$", "$1")
    rules = lines.withColumn("rule", unspaced).where(~F.col("rule").rlike(r"^\s*$|^#"))
    negated = F.col("rule").startswith("!")
    body = F.regexp_replace(F.regexp_replace("rule", r"^!", ""), r"^\\([#!])", "$1")
    folders_only = body.endswith("/")
    glob = F.regexp_replace(body, "/$", "")
    tied = F.regexp_replace(glob, r"^\*\*/", "").contains("/") | glob.startswith("/")
    escaped = F.regexp_replace(F.regexp_replace(glob, "^/", ""), r"([.+^$(){}|])", r"\\$1")
    marked = F.regexp_replace(F.regexp_replace(F.regexp_replace(escaped, r"^\*\*/", "\x01"), r"/\*\*$", "\x02"),
                              r"/\*\*/", "\x03")
    simple = F.regexp_replace(F.regexp_replace(F.regexp_replace(marked, r"\*+", "[^/]*"), r"\?", "[^/]"), r"\[!", "[^")
    crossed = F.replace(
        F.replace(F.replace(simple, F.lit("\x01"), F.lit("(?:.*/)?")), F.lit("\x02"), F.lit("/.*")),
        F.lit("\x03"), F.lit("/(?:.*/)?"),
    )
    # letter case plays no part in a match
    pattern = F.concat(F.lit("(?iu)"), F.when(tied, "^").otherwise("(?:^|/)"), crossed, F.lit("$"))
    return rules.select(
        *keys,
        "base",
        "position",
        negated.alias("negated"),
        folders_only.alias("folders_only"),
        pattern.alias("pattern"),
    )
