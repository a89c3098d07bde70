"""Answers to one view request, for every repository of a file table at once.

A request names filters, exclusions, a scope to look into and a selection. The
file table is read twice: once summed per folder, from which tree, tiles, strip
and headline figures all follow, and once for the ranked files.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from massmap.functions.classify import flavor
from massmap.functions.figures import baseline_column, heaviest_first, metric_for, share, weight_column
from massmap.functions.fixed_values import FILE_KINDS, FLAVORS, MAX_RIBBON_PARTS, MIN_RIBBON_SHARE
from massmap.functions.paths import base_name, depth_of, folder_chain, folder_of, folders_above, is_inside
from massmap.operators.hierarchy import direct_totals, flavor_sums, subtree_totals
from massmap.operators.ordered import far_page, top
from massmap.session import written

DIRECT = "."
SEPARATOR = "\x01"


@dataclass(frozen=True)
class View:
    """A request. Values outside what a request may say fall back or are clamped."""

    kinds: tuple[str, ...] = tuple(FILE_KINDS)
    measure: str = "tokens"
    aspect: str = "net"
    show_generated: bool = False
    query: str = ""
    excluded_folders: tuple[str, ...] = ()
    excluded_direct: tuple[str, ...] = ()
    expanded: tuple[str, ...] = ()
    tree_sort: str = "name"
    scope: str = ""
    selected: str = ""
    selected_direct: bool = False
    file_scope: str = "subtree"
    metric: str = "tokens"
    min_weight: float = 0
    limit: int = 100
    offset: int = 0
    tiles: int = 3
    is_diff: bool = False

    def settled(self) -> "View":
        return replace(
            self,
            aspect=self.aspect if self.is_diff else "after",
            metric=metric_for(self.metric, self.is_diff),
            min_weight=max(0, self.min_weight),
            limit=min(1000, max(1, int(self.limit))),
            offset=max(0, int(self.offset)),
            tiles=min(6, max(1, int(self.tiles))),
        )

    @property
    def weight(self) -> str:
        return weight_column(self.measure, self.aspect)

    @property
    def baseline(self) -> str:
        return baseline_column(self.measure, self.aspect)


def _list(values) -> Column:
    return F.array(*[F.lit(value) for value in values]) if values else F.array().cast("array<string>")


def _any_of(values: Column, listed) -> Column:
    return F.arrays_overlap(values, _list(listed)) if listed else F.lit(False)


def marked(files: DataFrame, view: View) -> DataFrame:
    """Files with their folder, flavor, active weight and the four filter marks."""
    query = view.query.strip().lower()
    folder = folder_of(F.col("path"))
    frame = files.withColumn("folder", folder).withColumn("flavor", flavor(F.col("generated"), F.col("kind")))
    seen = F.contains(F.lower("path"), F.lit(query)) if query else F.lit(True)
    shown = F.when(F.col("generated"), F.lit(view.show_generated)).otherwise(F.col("kind").isin(list(view.kinds)))
    out = _any_of(folder_chain(F.col("folder")), view.excluded_folders)
    if view.excluded_direct:
        out = out | F.col("folder").isin(list(view.excluded_direct))
    frame = frame.withColumns({"path_visible": seen, "category_visible": seen & shown, "left_out": out})
    return frame.withColumns(
        {
            "is_measured": F.col("measurement") == "measured",
            "included": F.col("category_visible") & ~F.col("left_out"),
            "available": F.col("path_visible") & ~F.col("left_out"),
            "weight": F.col(view.weight),
        }
    )


SUPPORTING = [
    "tokens", "lines", "code_lines", "before_tokens", "before_lines", "before_code_lines", "churn_tokens",
    "churn_lines", "churn_code_lines",
]


def folder_sums(view: View) -> dict[str, Column]:
    """Everything any answer needs of a folder, summed in one pass."""
    measured = F.col("is_measured")
    counted = F.col("included") & measured
    one, zero = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")

    def only(condition: Column, value: Column) -> Column:
        return F.when(condition, F.coalesce(value, zero)).otherwise(zero)

    size = F.abs(F.coalesce(F.col("weight"), zero))
    signed_flavors = {
        f"signed_{name}": only(F.col("path_visible") & measured & (F.col("flavor") == name), F.col("weight"))
        for name in FLAVORS
    }
    return {
        "weight": only(counted, F.col("weight")),
        "added": only(counted, F.col(weight_column(view.measure, "added"))),
        "removed": only(counted, F.col(weight_column(view.measure, "removed"))),
        **{name: only(counted, F.col(name)) for name in SUPPORTING},
        "files": only(counted, one),
        **{name: only(counted, value) for name, value in flavor_sums(F.col("flavor"), F.col("weight")).items()},
        "category_count": only(F.col("category_visible"), one),
        "path_count": only(F.col("path_visible"), one),
        "unmeasured_count": only(F.col("path_visible") & ~measured, one),
        "generated_count": only(F.col("path_visible") & measured & F.col("generated"), one),
        "category_weight": only(F.col("category_visible"), size),
        "flavor_baseline": only(F.col("available"), size),
        "all_weight": only(measured, F.col(view.baseline)),
        "widest_tokens": only(measured, F.col(weight_column("tokens", "churn" if view.is_diff else "after"))),
        "widest_lines": only(measured, F.col(weight_column("lines", "churn" if view.is_diff else "after"))),
        **signed_flavors,
    }


def direct_frame(files: DataFrame, view: View) -> DataFrame:
    return direct_totals(marked(files, view), folder_sums(view))


def subtree_frame(direct: DataFrame, view: View) -> DataFrame:
    """Subtree sums per folder, with the marks its checkbox draws."""

    def deepest(listed, chain: Column) -> Column:
        hits = F.transform(F.array_intersect(chain, _list(listed)), F.length)
        return F.coalesce(F.array_max(hits), F.lit(-1))

    chain = folder_chain(F.col("below"))
    below = F.greatest(
        F.when(deepest(view.excluded_folders, chain) > F.length("folder"), 1).otherwise(0),
        F.when(deepest(view.excluded_direct, chain) >= F.length("folder"), 1).otherwise(0),
    )
    sums = list(folder_sums(view))
    summed = subtree_totals(direct, sums, ("repo",), {"__below": below})
    folder = F.col("folder")
    out = _any_of(folder_chain(folder), view.excluded_folders)
    listed = folder.isin(list(view.excluded_folders)) if view.excluded_folders else F.lit(False)
    return summed.select(
        "repo",
        "folder",
        *sums,
        (~out).alias("included"),
        (~out & (F.col("__below") == 1)).alias("indeterminate"),
        (out & ~listed).alias("disabled"),
    )


def scopes(subtree: DataFrame, view: View) -> DataFrame:
    """Per repository, the folder the request re-roots on: the one named, else the root.

    With it come the two wholes that shares divide by.
    """
    rows = subtree.where(F.col("folder").isin("", view.scope))
    picked = rows.groupBy("repo").agg(
        F.max_by(F.struct("folder", "weight", "added", "removed", "flavor_baseline"), F.length("folder")).alias("s")
    )
    churn = F.col("s.added") + F.col("s.removed")
    whole = churn if view.aspect == "net" else F.col("s.weight")
    return picked.select(
        "repo",
        F.col("s.folder").alias("scope"),
        churn.alias("visible_churn"),
        whole.alias("visible_weight"),
        F.col("s.flavor_baseline").alias("scope_flavor_baseline"),
    )


def selections(subtree: DataFrame, view: View) -> DataFrame:
    """``scopes`` with the selected folder: outside the scope or unknown, the scope itself."""
    known = subtree.where(F.col("folder") == view.selected).select("repo", F.col("folder").alias("chosen"))
    joined = scopes(subtree, view).join(known, "repo", "left")
    inside = F.col("chosen").isNotNull() & is_inside(F.col("chosen"), F.col("scope"))
    return joined.select(
        "repo", "scope", "visible_churn", "visible_weight", "scope_flavor_baseline",
        F.when(inside, F.col("chosen")).otherwise(F.col("scope")).alias("selected"),
        (F.lit(view.selected_direct) & inside).alias("selected_direct"),
    )


def _shares(frame: DataFrame) -> list[Column]:
    return [
        share(F.col("weight"), F.col("visible_weight")).alias("share_of_scope"),
        share(F.col("added"), F.col("visible_churn")).alias("share_added"),
        share(F.col("removed"), F.col("visible_churn")).alias("share_removed"),
    ]


def tree(direct: DataFrame, subtree: DataFrame, view: View) -> DataFrame:
    """Tree rows; ``sort_key`` orders them as they are drawn."""
    everything = bool(view.query.strip())
    where = selections(subtree, view)
    visible = subtree.where("path_count > 0").join(where, "repo").where(is_inside(F.col("folder"), F.col("scope")))
    scope_depth = depth_of(F.col("scope"))
    above = F.filter(folders_above(F.col("folder")), lambda f: is_inside(f, F.col("scope")))
    above = F.when(F.col("folder") == "", F.array().cast("array<string>")).otherwise(above)
    opened = F.lit(True) if everything else F.size(F.array_except(above, _list(view.expanded))) == 0
    is_open = F.lit(True) if everything else F.col("folder").isin(list(view.expanded) or [None])
    is_open = F.coalesce(is_open, F.lit(False))
    shown = visible.where(opened)
    depth = depth_of(F.col("folder")) - scope_depth
    folder_rows = shown.select(
        "repo", F.col("folder").alias("path"), F.lit("folder").alias("row_kind"),
        base_name(F.col("folder")).alias("name"), depth.alias("depth"),
        F.col("path_count").alias("files"), F.col("unmeasured_count").alias("unmeasured_files"),
        "weight", "added", "removed", *_shares(shown),
        F.lit(True).alias("has_children"), is_open.alias("expanded"), "included", "indeterminate", "disabled",
        (F.col("category_count") == 0).alias("filtered_out"),
        (~F.col("selected_direct") & (F.col("selected") == F.col("folder"))).alias("selected"),
        F.abs("category_weight").alias("sort_weight"), "scope",
    )
    parents = shown.where(is_open).select(
        "repo", "folder", "visible_weight", "visible_churn", "selected", "selected_direct", "scope",
        F.col("included").alias("folder_included"),
    )
    listed = F.col("folder").isin(list(view.excluded_direct)) if view.excluded_direct else F.lit(False)
    own = direct.where("path_count > 0").join(parents, ["repo", "folder"])
    direct_rows = own.select(
        "repo", F.col("folder").alias("path"), F.lit("files").alias("row_kind"), F.lit(DIRECT).alias("name"),
        (depth + 1).alias("depth"), F.col("path_count").alias("files"),
        F.col("unmeasured_count").alias("unmeasured_files"), "weight", "added", "removed", *_shares(own),
        F.lit(False).alias("has_children"), F.lit(False).alias("expanded"),
        (F.col("folder_included") & ~listed).alias("included"), F.lit(False).alias("indeterminate"),
        (~F.col("folder_included")).alias("disabled"), (F.col("category_count") == 0).alias("filtered_out"),
        (F.col("selected_direct") & (F.col("selected") == F.col("folder"))).alias("selected"),
        F.lit(0).cast("bigint").alias("sort_weight"), "scope",
    )
    return _with_sort_key(folder_rows, direct_rows, view.tree_sort).drop("sort_weight", "scope")


def _with_sort_key(folder_rows: DataFrame, direct_rows: DataFrame, order: str) -> DataFrame:
    """A string that sorts rows as drawn: per level the own files, then folders by weight or name.

    A level contributes one part, so a folder's key is its parts joined; for the
    weight order each part needs the weight of the folder above, hence the join.
    """

    def part(weight: Column, name: Column) -> Column:
        heavy = heaviest_first(weight) if order == "weight" else F.lit("")
        return F.concat(F.lit("1"), heavy, name)

    parts = folder_rows.select("repo", F.col("path").alias("step"), part(F.col("sort_weight"), F.col("name")).alias("part"))
    every = folder_rows.select("repo", "path", "scope", F.explode(folder_chain(F.col("path"))).alias("step"))
    steps = every.where(is_inside(F.col("step"), F.col("scope"))).join(parts, ["repo", "step"])
    keys = steps.groupBy("repo", "path").agg(
        F.array_join(
            F.transform(
                F.array_sort(F.collect_list(F.struct(F.length("step").alias("at"), "part"))), lambda s: s["part"]
            ),
            SEPARATOR,
        ).alias("folder_key")
    )
    rows = folder_rows.unionByName(direct_rows).join(keys, ["repo", "path"])
    tail = F.when(F.col("row_kind") == "files", F.lit(f"{SEPARATOR}0")).otherwise("")
    return rows.withColumn("sort_key", F.concat("folder_key", tail)).drop("folder_key")


def expandable(subtree: DataFrame, view: View) -> DataFrame:
    return (
        subtree.where("path_count > 0")
        .join(scopes(subtree, view), "repo")
        .where(is_inside(F.col("folder"), F.col("scope")))
        .select("repo", "folder")
    )


# --- parts of a folder: strip and tiles ---------------------------------------
CARD = ["weight", "added", "removed", "files", *[f"flavor_{name}" for name in FLAVORS]]


def _parts(direct: DataFrame, subtree: DataFrame, holders: DataFrame) -> DataFrame:
    """The child folders of one folder per repository, and its own files as ``.``.

    ``holders`` is ``(repo, holder, ...)`` and adds its other columns.
    """
    children = subtree.where("folder != ''").withColumn("holder", folder_of(F.col("folder")))
    folders = children.join(holders, ["repo", "holder"]).select(
        "repo", F.col("folder").alias("path"), base_name(F.col("folder")).alias("name"),
        F.lit("folder").alias("row_kind"), "path_count", *CARD, *[c for c in holders.columns if c != "repo"],
    )
    own = direct.withColumnRenamed("folder", "holder").join(holders, ["repo", "holder"]).select(
        "repo", F.col("holder").alias("path"), F.lit(DIRECT).alias("name"), F.lit("files").alias("row_kind"),
        "path_count", *CARD, *[c for c in holders.columns if c != "repo"],
    )
    return folders.unionByName(own)


def _tail(rest: DataFrame, group: list[str]) -> DataFrame:
    """What the drawn parts leave, as one part."""
    return rest.groupBy(*group).agg(F.count("*").alias("__parts"), *[F.sum(c).alias(c) for c in CARD]).select(
        *group, F.lit(None).cast("string").alias("path"),
        F.concat(F.col("__parts").cast("string"), F.lit(" more folders")).alias("name"),
        F.lit("folder").alias("row_kind"), *CARD,
    )


def ribbon(direct: DataFrame, subtree: DataFrame, view: View) -> DataFrame:
    """The scope's parts, heaviest first; the light rest in one. Own files always stay.

    The cut is by the twenty heaviest, found without sorting all parts in one place.
    """
    holders = scopes(subtree, view).withColumn("holder", F.col("scope"))
    parts = _parts(direct, subtree, holders).where("weight != 0")
    size = F.abs("weight")
    strip = parts.groupBy("repo").agg(F.sum(size).alias("strip"))
    order = [size.desc(), (F.col("row_kind") == "files").asc(), F.col("path").asc()]
    first = top(parts, ["repo"], order, MAX_RIBBON_PARTS, "place").join(strip, "repo")
    wide = first.where((size / F.col("strip") >= MIN_RIBBON_SHARE) | (F.col("row_kind") == "files"))
    late = (
        parts.where("row_kind = 'files'")
        .join(wide.select("repo", "row_kind"), ["repo", "row_kind"], "left_anti")
        .withColumn("place", F.lit(MAX_RIBBON_PARTS + 1))
    )
    drawn = wide.drop("strip").unionByName(late)
    rest = parts.join(drawn.select("repo", "path", "row_kind"), ["repo", "path", "row_kind"], "left_anti")
    tail = _tail(rest, ["repo", "visible_weight"]).withColumn("place", F.lit(MAX_RIBBON_PARTS + 2))
    both = drawn.select("repo", "visible_weight", "path", "name", "row_kind", *CARD, "place").unionByName(
        tail.select("repo", "visible_weight", "path", "name", "row_kind", *CARD, "place")
    )
    return both.select(
        "repo", "place", "path", "name", "row_kind", *CARD,
        share(F.col("weight"), F.col("visible_weight")).alias("share_of_scope"),
    )


def tiles(direct: DataFrame, subtree: DataFrame, view: View) -> DataFrame:
    """One row of at most ``view.tiles`` tiles for the selected folder."""
    holders = selections(subtree, view).withColumn("holder", F.col("selected"))
    parts = _parts(direct, subtree, holders)
    folders = parts.where("row_kind = 'folder' AND path_count > 0 AND NOT selected_direct")
    own = parts.where("row_kind = 'files'").select("repo", F.col("path_count").alias("own_count"), *CARD)
    counts = folders.groupBy("repo").agg(F.count("*").alias("folders"))
    base = (
        holders.select("repo", "selected", "visible_weight")
        .join(counts, "repo", "left")
        .join(own, "repo", "left")
        .withColumn("folders", F.coalesce("folders", F.lit(0)))
        .withColumn("own_count", F.coalesce("own_count", F.lit(0)).cast("bigint"))
    )
    draws = (F.col("own_count") > 0) | (F.col("folders") == 0)
    room = F.when(draws, view.tiles - 1).otherwise(view.tiles)
    take = F.when(F.col("folders") <= room, F.col("folders")).otherwise(F.greatest(room - 1, F.lit(0)))
    plan = base.withColumns({"draws": draws, "room": room, "take": take})
    zero = F.lit(0).cast("bigint")
    first = plan.where("draws").select(
        "repo", F.lit(0).alias("place"), F.col("selected").alias("path"), F.lit(DIRECT).alias("name"),
        F.lit("files").alias("row_kind"), *[F.coalesce(F.col(c), zero).alias(c) for c in CARD if c != "files"],
        F.col("own_count").alias("files"), "visible_weight",
    )
    heavy = top(folders.withColumn("files", F.col("path_count")), ["repo"],
                [F.abs("weight").desc(), F.col("path").asc()], view.tiles, "place")
    drawn = heavy.join(plan.select("repo", "take"), "repo").where("place <= take")
    columns = ["repo", "place", "path", "name", "row_kind", *CARD, "visible_weight"]
    rest = folders.withColumn("files", F.col("path_count")).join(drawn.select("repo", "path"), ["repo", "path"], "left_anti")
    tail = (
        _tail(rest, ["repo", "visible_weight"])
        .join(plan.where("room >= 1").select("repo"), "repo", "left_semi")
        .withColumn("place", F.lit(view.tiles + 1))
    )
    rows = first.select(*columns).unionByName(drawn.select(*columns)).unionByName(tail.select(*columns))
    return rows.select(
        *[c for c in columns if c != "visible_weight"],
        share(F.col("weight"), F.col("visible_weight")).alias("share_of_scope"),
    )


# --- headline, selection, ranked files -----------------------------------------
def summary(subtree: DataFrame, view: View) -> DataFrame:
    root = subtree.where("folder = ''").select(
        "repo", F.col("all_weight").alias("project_weight"),
        F.greatest("widest_tokens", "widest_lines").alias("widest_weight"),
    )
    figures = ["weight", "added", "removed", "files", *SUPPORTING]
    scope = subtree.join(scopes(subtree, view).select("repo", F.col("scope").alias("folder")), ["repo", "folder"])
    return root.join(
        scope.select(
            "repo", F.col("folder").alias("scope_path"), F.col("all_weight").alias("scope_weight"),
            *[F.col(c).alias(f"selected_{c}") for c in figures],
        ),
        "repo",
    )


def detail(direct: DataFrame, subtree: DataFrame, view: View) -> DataFrame:
    """The selected folder, or its own files: figures, trail of folders above, counts."""
    chosen = selections(subtree, view)
    figures = ["weight", "added", "removed", "files", *SUPPORTING]
    counts = ["path_count", "unmeasured_count", "generated_count", "files"]
    whole = subtree.select("repo", F.col("folder").alias("selected"), *[F.col(c).alias(f"all_{c}") for c in {*figures, *counts}])
    own = direct.select("repo", F.col("folder").alias("selected"), *[F.col(c).alias(f"own_{c}") for c in {*figures, *counts}])
    rows = chosen.join(whole, ["repo", "selected"]).join(own, ["repo", "selected"], "left")
    near = F.col("selected_direct") | F.lit(view.file_scope == "folder")

    def pick(name: str, direct_only: Column) -> Column:
        return F.when(direct_only, F.coalesce(F.col(f"own_{name}"), F.lit(0))).otherwise(F.col(f"all_{name}"))

    above = F.when(F.col("selected") == "", F.array().cast("array<string>")).otherwise(folders_above(F.col("selected")))
    trail = F.when(F.col("selected_direct"), folder_chain(F.col("selected"))).otherwise(above)
    weight = pick("weight", F.col("selected_direct"))
    return rows.select(
        "repo",
        F.col("selected").alias("path"),
        F.when(F.col("selected_direct"), DIRECT).otherwise(base_name(F.col("selected"))).alias("title"),
        trail.alias("trail"),
        *[pick(c, F.col("selected_direct")).alias(c) for c in figures],
        share(weight, F.col("visible_weight")).alias("share_of_scope"),
        pick("files", near).alias("shown_files"),
        pick("path_count", near).alias("available_files"),
        pick("unmeasured_count", near).alias("unmeasured_files"),
        pick("generated_count", near).alias("generated_files"),
        F.col("scope_flavor_baseline").alias("flavor_baseline"),
    )


def flavor_stats(direct: DataFrame, subtree: DataFrame, view: View) -> DataFrame:
    """Signed weight of every flavor in the selection, empty ones too, in drawing order."""
    chosen = selections(subtree, view)
    signed = [f"signed_{name}" for name in FLAVORS]
    whole = subtree.select("repo", F.col("folder").alias("selected"), *signed)
    own = direct.select("repo", F.col("folder").alias("selected"), *[F.col(c).alias(f"own_{c}") for c in signed])
    rows = chosen.join(whole, ["repo", "selected"]).join(own, ["repo", "selected"], "left")
    near = F.col("selected_direct") | F.lit(view.file_scope == "folder")
    entries = F.array(
        *[
            F.struct(
                F.lit(place).alias("place"),
                F.lit(name).alias("flavor"),
                F.when(near, F.coalesce(F.col(f"own_signed_{name}"), F.lit(0))).otherwise(F.col(f"signed_{name}")).alias("weight"),
                F.lit(view.show_generated if name == "generated" else name in view.kinds).alias("enabled"),
            )
            for place, name in enumerate(FLAVORS)
        ]
    )
    return rows.select("repo", F.inline(entries))


def _metric_column(view: View) -> str:
    known = {"added", "removed", "churn", "net"}
    return weight_column(view.measure, view.metric) if view.metric in known else view.metric


def matching(files: DataFrame, subtree: DataFrame, view: View) -> DataFrame:
    """Files of the selection that every filter and the floor on magnitude keep."""
    chosen = selections(subtree, view).select("repo", "selected", "selected_direct")
    near = F.col("selected_direct") | F.lit(view.file_scope == "folder")
    placed = marked(files, view).where("included").join(chosen, "repo")
    kept = placed.where(F.when(near, F.col("folder") == F.col("selected")).otherwise(is_inside(F.col("folder"), F.col("selected"))))
    if view.min_weight:
        kept = kept.where(~F.col("is_measured") | (F.abs("weight") >= view.min_weight))
    return kept.select("repo", *[c for c in files.columns if c != "repo"], "flavor", "weight", "folder")


def ranking_order(view: View) -> list[Column]:
    """By the sorted column, then the active weight, then the path. A name never decides the cut."""
    none = F.lit(0).cast("bigint")
    by_weight = [F.abs(F.coalesce("weight", none)).desc(), F.col("path").asc()]
    if view.metric == "name":
        return by_weight
    return [F.abs(F.coalesce(_metric_column(view), none)).desc(), *by_weight]


def ranked_page(files: DataFrame, subtree: DataFrame, view: View) -> DataFrame:
    """One page of the ranking, with its total and the offset it was clamped to.

    A far page is found on paths and sort columns alone; only its rows are looked up whole.
    """
    found = matching(files, subtree, view)
    asked = view.offset // view.limit * view.limit
    if asked + view.limit > 1000:
        sorted_by = {"weight"} if view.metric == "name" else {"weight", _metric_column(view)}
        slim = found.select("repo", "path", *sorted(sorted_by))
        page = far_page(slim, ["repo"], ranking_order(view), asked, view.limit)
        places = page.select("repo", "path", "rank", F.col("total").alias("ranked_total"), F.col("offset").alias("ranked_offset"))
        return found.join(places, ["repo", "path"]).select(*found.columns, "rank", "ranked_total", "ranked_offset")
    totals = found.groupBy("repo").agg(F.count("*").alias("ranked_total"))
    last = F.floor((F.col("ranked_total") - 1) / view.limit) * view.limit
    paged = totals.withColumn("ranked_offset", F.least(F.lit(asked), last).cast("bigint"))
    numbered = top(found, ["repo"], ranking_order(view), asked + view.limit)
    return numbered.join(paged, "repo").where(
        (F.col("rank") > F.col("ranked_offset")) & (F.col("rank") <= F.col("ranked_offset") + view.limit)
    )


def view(files: DataFrame, request: View) -> dict[str, DataFrame]:
    """Every answer of a request. The folder sums are written once and shared."""
    request = request.settled()
    direct = written(direct_frame(files, request), "folders")
    subtree = written(subtree_frame(direct, request), "subtrees")
    return {
        "summary": summary(subtree, request),
        "ribbon": ribbon(direct, subtree, request),
        "tree": tree(direct, subtree, request),
        "detail": detail(direct, subtree, request),
        "tiles": tiles(direct, subtree, request),
        "flavors": flavor_stats(direct, subtree, request),
        "ranked": ranked_page(files, subtree, request),
        "files": matching(files, subtree, request),
        "expandable": expandable(subtree, request),
    }
