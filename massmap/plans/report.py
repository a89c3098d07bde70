"""The thresholded report of a file table, as rows, for every repository at once."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from massmap.functions.classify import flavor
from massmap.functions.figures import (
    baseline_column, change_text, comment_share, compact, file_count, heaviest_first, share_text, signed, status_letter,
    weight_column,
)
from massmap.functions.fixed_values import (
    COMMENT_SHARE_NOTED, DEFAULT_REPORT_THRESHOLD, FLAVORS, NAMED_FILES, REASON_LABELS,
)
from massmap.functions.paths import base_name, folder_chain, folder_of
from massmap.operators.hierarchy import direct_totals
from massmap.operators.ordered import ranked, top
from massmap.plans.view import SEPARATOR
from massmap.session import written

HEADINGS = {
    "code": "CODE", "test": "TESTS", "text": "DOCS", "i18n": "I18N", "data": "DATA & CONFIG", "other": "OTHER",
    "generated": "GENERATED",
}
LABELS = {
    "code": "code", "test": "tests", "text": "docs", "i18n": "i18n", "data": "data", "other": "other",
    "generated": "generated",
}
UNITS = {"tokens": "tokens", "lines": "lines", "code_lines": "loc"}
WALKED = ["code", "test"]
SUMS = ["weight", "baseline", "added", "removed", "files", "lines", "comment_lines", "added_lines", "added_comment_lines"]
SECTION = ["repo", "section"]


def literal_map(value: Column, table: Mapping[str, str]) -> Column:
    entries = [F.lit(item) for pair in table.items() for item in pair]
    return F.try_element_at(F.create_map(*entries), value)


def check_request(aspect: str, threshold: float, is_diff: bool) -> None:
    if not is_diff and aspect != "after":
        raise ValueError("a scan has one content, so its report has no aspect but 'after'")
    if not 0 <= threshold <= 100:
        raise ValueError(f"threshold is a percentage from 0 to 100, not {threshold}")


def weighed(files: DataFrame, measure: str, aspect: str) -> DataFrame:
    """Measured files with their section and the figures a section sums."""
    return files.where("measurement = 'measured'").withColumns(
        {
            "section": flavor(F.col("generated"), F.col("kind")),
            "weight": F.col(weight_column(measure, aspect)),
            "baseline": F.col(baseline_column(measure, aspect)),
            "added": F.col(weight_column(measure, "added")),
            "removed": F.col(weight_column(measure, "removed")),
        }
    )


def section_folders(files: DataFrame, measure: str, aspect: str) -> DataFrame:
    """Subtree sums per flavor and folder."""
    rows = weighed(files, measure, aspect)
    sums = {name: F.col(name) for name in SUMS if name != "files"}
    direct = direct_totals(rows, {**sums, "files": F.lit(1).cast("bigint")}, SECTION)
    own = direct.withColumn("own_files", F.col("files"))
    spread = own.withColumnRenamed("folder", "below").withColumn("folder", F.explode(folder_chain(F.col("below"))))
    here = F.col("folder") == F.col("below")
    return spread.groupBy(*SECTION, "folder").agg(
        *[F.sum(name).alias(name) for name in SUMS],
        F.sum(F.when(here, F.col("own_files")).otherwise(0)).cast("bigint").alias("own_files"),
    )


def section_totals(files: DataFrame, measure: str, aspect: str) -> DataFrame:
    """Per flavor and for the whole (section null), with each flavor's share of the whole."""
    rows = weighed(files, measure, aspect)
    totals = rows.groupingSets([["repo", "section"], ["repo"]], "repo", "section").agg(
        *[F.sum(name).alias(name) for name in SUMS if name != "files"], F.count("*").alias("files")
    )
    whole = totals.where("section IS NULL").select("repo", F.col("baseline").alias("whole"))
    return totals.join(whole, "repo").withColumn(
        "share", F.when(F.col("whole") > 0, F.abs("weight") / F.col("whole")).otherwise(0.0)
    ).drop("whole")


def coverage(files: DataFrame) -> DataFrame:
    measured = F.col("measurement") == "measured"
    return files.groupBy("repo").agg(
        F.count("*").alias("files"),
        F.count_if(measured).alias("measured"),
        F.count_if(measured & F.col("generated")).alias("generated"),
        F.count_if(~measured).alias("not_measured"),
    )


def unmeasured(files: DataFrame) -> DataFrame:
    return files.where("measurement != 'measured'").select(
        "repo", "path", literal_map(F.col("measurement"), REASON_LABELS).alias("reason")
    )


def tests_to_code(files: DataFrame, measure: str, is_diff: bool) -> DataFrame:
    """Test weight against code weight (churn in a comparison); no row where code is nothing."""
    rows = weighed(files, measure, "churn" if is_diff else "after")

    def of(section: str) -> Column:
        return F.sum(F.when(F.col("section") == section, F.col("weight")).otherwise(0)).cast("bigint")

    sums = rows.groupBy("repo").agg(of("test").alias("tests"), of("code").alias("code")).where("code > 0")
    return sums.withColumn("text", share_text(F.col("tests") / F.col("code")))




def named_files(files: DataFrame, measure: str, aspect: str) -> DataFrame:
    """The three heaviest files of each flavor."""
    return top(
        weighed(files, measure, aspect), SECTION, [F.abs("weight").desc(), F.col("path").asc()], NAMED_FILES
    ).select(*SECTION, "rank", "path", "weight")


def _weight_text(weight: Column, aspect: str) -> Column:
    return signed(weight) if aspect == "net" else compact(weight)


def describe_change(added: Column, removed: Column, unit: str) -> Column:
    change = change_text(added, removed)
    return F.concat(
        F.when(change != "", F.concat(F.lit("churn "), compact(added + removed), F.lit(f" {unit} ("), change, F.lit(")")))
        .otherwise(f"churn 0 {unit}"),
        F.lit(", net "), signed(added - removed),
    )


def describe_totals(unit: str, is_diff: bool) -> Column:
    size = (
        describe_change(F.col("added"), F.col("removed"), unit)
        if is_diff
        else F.concat(compact(F.col("weight")), F.lit(f" {unit}"))
    )
    return F.concat(size, F.lit(", "), file_count(F.col("files")))


def one_line_sections(files: DataFrame, measure: str, aspect: str, is_diff: bool) -> DataFrame:
    """Flavors that are not walked: a heading, the totals and the heaviest files, as text."""
    totals = section_totals(files, measure, aspect).where(
        F.col("section").isNotNull() & ~F.col("section").isin(WALKED)
    )
    named = named_files(files, measure, aspect).groupBy(*SECTION).agg(
        F.array_sort(F.collect_list(F.struct("rank", F.concat_ws(" ", "path", _weight_text(F.col("weight"), aspect)).alias("text")))).alias("named")
    )
    listed = F.array_join(F.transform("named", lambda n: n["text"]), ", ")
    note = F.when(F.col("section") == "generated", ", excluded above").otherwise("")
    return totals.join(named, SECTION).select(
        *SECTION,
        F.concat(literal_map(F.col("section"), HEADINGS), F.lit("  "), describe_totals(UNITS[measure], is_diff), note,
                 F.lit(": "), listed).alias("text"),
    )


def header(files: DataFrame, measure: str, aspect: str, threshold: float, is_diff: bool) -> DataFrame:
    """Headline texts per repository: size or change, flavor split, ratio, coverage."""
    totals = section_totals(files, measure, aspect)
    split = (
        totals.where("section IS NOT NULL")
        .withColumn("place", F.array_position(F.array(*[F.lit(name) for name in FLAVORS]), F.col("section")))
        .groupBy("repo")
        .agg(
            F.array_join(
                F.transform(
                    F.array_sort(
                        F.collect_list(
                            F.struct(
                                "place",
                                F.concat_ws(
                                    " ", literal_map(F.col("section"), LABELS), _weight_text(F.col("weight"), aspect),
                                    share_text(F.col("share")),
                                ).alias("text"),
                            )
                        )
                    ),
                    lambda entry: entry["text"],
                ),
                "  ",
            ).alias("split")
        )
    )
    unit = UNITS[measure]
    word = f"{aspect} " if is_diff else ""
    if is_diff:
        statuses = files.groupBy("repo").agg(
            F.count("*").alias("all_files"),
            *[F.count_if(F.col("status") == s).alias(s) for s in ("added", "modified", "deleted", "renamed")],
        )
        counted = [
            F.when(F.col(s) > 0, F.concat(compact(F.col(s)), F.lit(f" {s}"))) for s in ("added", "modified", "deleted", "renamed")
        ]
        sized = statuses.select("repo", F.concat_ws(", ", file_count(F.col("all_files")), *counted).alias("size"))
        whole = totals.where("section IS NULL").select(
            "repo",
            F.concat(
                describe_change(F.col("added"), F.col("removed"), unit), F.lit(", added is "),
                share_text(comment_share(F.col("added_lines"), F.col("added_comment_lines"))), F.lit(" comment"),
            ).alias("change"),
        )
        sized = sized.join(whole, "repo", "left")
    else:
        figures = files.groupBy("repo").agg(
            F.count("*").alias("all_files"),
            *[F.coalesce(F.sum(m), F.lit(0)).alias(m) for m in ("tokens", "lines", "code_lines", "comment_lines")],
        )
        sized = figures.select(
            "repo",
            F.concat(
                F.lit("tree of "), file_count(F.col("all_files")), F.lit(": "), compact(F.col("tokens")), F.lit(" tokens, "),
                compact(F.col("lines")), F.lit(" lines, "), compact(F.col("code_lines")), F.lit(" loc, "),
                share_text(comment_share(F.col("lines"), F.col("comment_lines"))), F.lit(" comment"),
            ).alias("size"),
            F.lit(None).cast("string").alias("change"),
        )
    ratio = tests_to_code(files, measure, is_diff).select(
        "repo", F.concat(F.lit("Tests weigh "), "text", F.lit(" of code churn." if is_diff else " of code.")).alias("ratio")
    )
    counts = coverage(files)
    return (
        counts.join(sized, "repo")
        .join(split, "repo", "left")
        .join(ratio, "repo", "left")
        .select(
            "repo",
            "size",
            "change",
            F.concat(F.lit(f"{word}{unit} by flavor: "), F.coalesce("split", F.lit(""))).alias("split"),
            "ratio",
            F.lit(f"A node is expanded at >= {threshold}% of its section.").alias("rule"),
            F.concat(
                F.lit("Coverage: "), F.col("files"), F.lit(" files, "), F.col("measured"), F.lit(" measured, "),
                F.col("generated"), F.lit(" generated, "), F.col("not_measured"), F.lit(" not measured."),
            ).alias("coverage"),
        )
    )


# --- the walk ------------------------------------------------------------------
def _passes(threshold: float) -> Column:
    return (F.col("total") > 0) & (F.abs("weight") / F.col("total") >= threshold / 100)


def walk_nodes(files: DataFrame, measure: str, aspect: str, threshold: float) -> tuple[DataFrame, DataFrame]:
    """Folders and files of the walked sections with ``passes`` and whether they print.

    A node prints when it and every folder above it reach the threshold; the
    root always prints. Only folders are expanded to their ancestors; a file
    asks the one folder it sits in.
    """
    folders = section_folders(files, measure, aspect).where(F.col("section").isin(WALKED))
    totals = folders.where("folder = ''").select(*SECTION, F.col("baseline").alias("total"))
    judged = folders.join(totals, SECTION).withColumn("passes", _passes(threshold) | (F.col("folder") == ""))
    judged = judged.withColumn("parent", folder_of(F.col("folder")))
    children = judged.where("folder != ''").groupBy(*SECTION, F.col("parent").alias("folder")).agg(
        F.count("*").alias("child_folders")
    )
    judged = judged.join(children, [*SECTION, "folder"], "left").withColumn(
        "chained", (F.coalesce("child_folders", F.lit(0)) == 1) & (F.col("own_files") == 0)
    )
    judged = written(judged, "walk")
    steps = judged.select(*SECTION, "folder", F.explode(folder_chain(F.col("folder"))).alias("step"))
    marks = judged.select(*SECTION, F.col("folder").alias("step"), "passes", "chained", F.abs("weight").alias("size"))
    proper = F.col("step") != F.col("folder")
    solid = proper & ~F.col("chained")
    lines = steps.join(marks, [*SECTION, "step"]).groupBy(*SECTION, "folder").agg(
        F.bool_and("passes").alias("prints"),
        F.count_if(solid).cast("int").alias("depth"),
        F.max_by(F.when(solid, F.col("step")), F.when(solid, F.length("step"))).alias("holder"),
        F.array_sort(F.collect_list(F.struct(F.length("step").alias("at"), F.col("step"), F.col("size")))).alias("chain"),
    )
    nodes = judged.join(lines, [*SECTION, "folder"])
    rows = weighed(files, measure, aspect).where(F.col("section").isin(WALKED)).withColumn("folder", folder_of(F.col("path")))
    items = rows.join(totals, SECTION).withColumn("passes", _passes(threshold))
    return nodes, items


def _key_part(size: Column, name: Column) -> Column:
    return F.concat(F.lit("1"), heaviest_first(size), name)


def walk(
    files: DataFrame, measure: str = "tokens", aspect: str = "after", threshold: float = DEFAULT_REPORT_THRESHOLD,
    is_diff: bool = False,
) -> DataFrame:
    """Rows ``(repo, section, ord, depth, label, weight, share, trailer)`` in reading order."""
    nodes, items = walk_nodes(files, measure, aspect, threshold)
    solid = nodes.where("prints AND NOT chained")
    # A folder's label reaches back to the nearest printed folder above it, so a
    # run of single-folder folders reads as one row.
    label = F.when(F.col("folder") == "", "./").otherwise(
        F.concat(
            F.when(F.coalesce("holder", F.lit("")) == "", F.col("folder")).otherwise(
                F.substr(F.col("folder"), F.length("holder") + 2)
            ),
            F.lit("/"),
        )
    )
    key = F.array_join(
        F.transform("chain", lambda s: _key_part(s["size"], base_name(s["step"]))), SEPARATOR
    )
    change = change_text(F.col("added"), F.col("removed"))
    counted = file_count(F.col("files"))
    folder_trailer = F.when(change != "", F.concat_ws("  ", counted, change)).otherwise(counted) if is_diff else counted
    folder_rows = solid.select(
        *SECTION, "depth", label.alias("label"), "weight", "total", folder_trailer.alias("trailer"), key.alias("key")
    )
    inside = solid.select(*SECTION, "folder", F.col("depth").alias("above"), key.alias("folder_key"))
    shown = items.where("passes").join(inside, [*SECTION, "folder"])
    file_rows = shown.select(
        *SECTION,
        (F.col("above") + 1).alias("depth"),
        F.col("name").alias("label"),
        "weight",
        "total",
        _file_trailer(measure, is_diff).alias("trailer"),
        F.concat_ws(SEPARATOR, "folder_key", _key_part(F.abs("weight"), F.col("name"))).alias("key"),
    )
    rest_rows = _rest(nodes, items, inside, is_diff)
    rows = folder_rows.unionByName(file_rows).unionByName(rest_rows)
    ordered = ranked(rows, SECTION, [F.col("key")], "ord")
    share = F.when(F.col("total") > 0, F.abs("weight") / F.col("total")).otherwise(0.0)
    return ordered.select(
        *SECTION, "ord", "depth", "label", _weight_text(F.col("weight"), aspect).alias("weight"),
        share_text(share).alias("share"), "trailer",
    )


def _rest(nodes: DataFrame, items: DataFrame, inside: DataFrame, is_diff: bool) -> DataFrame:
    """One row per expanded folder for the children below the threshold."""
    figures = ["weight", "files", "added", "removed"]
    below = nodes.where("folder != ''").select(*SECTION, F.col("parent").alias("folder"), "passes", "total", *figures)
    loose = items.withColumn("files", F.lit(1).cast("bigint")).select(*SECTION, "folder", "passes", "total", *figures)
    sums = (
        below.unionByName(loose)
        .groupBy(*SECTION, "folder", "total")
        .agg(
            F.count_if("passes").alias("shown"),
            F.count_if(~F.col("passes")).alias("hidden"),
            *[F.sum(F.when(~F.col("passes"), F.col(c)).otherwise(0)).cast("bigint").alias(c) for c in figures],
        )
        .where("shown > 0 AND hidden > 0")
        .join(inside, [*SECTION, "folder"])
    )
    trailer = change_text(F.col("added"), F.col("removed")) if is_diff else F.lit("")
    return sums.select(
        *SECTION,
        (F.col("above") + 1).alias("depth"),
        F.concat(F.lit("... "), file_count(F.col("files"))).alias("label"),
        "weight",
        "total",
        trailer.alias("trailer"),
        F.concat_ws(SEPARATOR, "folder_key", F.lit("2")).alias("key"),
    )


def _file_trailer(measure: str, is_diff: bool) -> Column:
    if is_diff:
        change = change_text(F.col("added"), F.col("removed"))
        letter = F.when(F.col("status") == "unchanged", " ").otherwise(status_letter(F.col("status")))
        moved = F.when(
            (F.col("status") == "renamed") & F.col("previous_path").isNotNull(),
            F.concat(F.lit("from "), "previous_path"),
        )
        return F.concat_ws("  ", letter, F.when(change != "", change), moved)
    commented = comment_share(F.col("lines"), F.col("comment_lines"))
    size = F.lit(None).cast("string") if measure == "code_lines" else F.concat(compact(F.col("code_lines")), F.lit(" loc"))
    noted = F.when(commented >= COMMENT_SHARE_NOTED, F.concat(share_text(commented), F.lit(" comment")))
    structure = F.when(
        F.col("language").isNotNull(),
        F.concat(compact(F.col("functions")), F.lit(" fn, "), compact(F.col("branches")), F.lit(" br")),
    )
    return F.when(F.col("section") == "code", F.concat_ws(", ", size, noted, structure)).otherwise("")


def report(
    files: DataFrame, measure: str = "tokens", aspect: str = "after", threshold: float = DEFAULT_REPORT_THRESHOLD,
    is_diff: bool = False,
) -> dict[str, DataFrame]:
    """The parts of a report: headline texts, walked sections, one-line sections, unmeasured paths."""
    check_request(aspect, threshold, is_diff)
    return {
        "header": header(files, measure, aspect, threshold, is_diff),
        "walk": walk(files, measure, aspect, threshold, is_diff),
        "sections": one_line_sections(files, measure, aspect, is_diff),
        "unmeasured": unmeasured(files),
    }
