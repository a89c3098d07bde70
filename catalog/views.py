"""E, G, H, L and the filtered parts of D: answers to view and report requests."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from catalog import oracle as O
from catalog.classify import change_sql, compact_sql, files_sql, share_text_sql, signed_sql
from massmap.functions import fixed_values as V
from massmap.operators import hierarchy as H
from massmap.operators.ordered import ranked
from massmap.plans import report as R
from massmap.plans import view as W
from massmap.plans.scan import scan
from massmap.session import shared_folder, written
from massmap.sources import adapters as A
from massmap.sources.corpus import load_index, save_index

FLAT = W.View(kinds=("code", "test", "text", "data"), expanded=("", "m0", "m0/src", "m1"), selected="m0",
              excluded_folders=("m0/docs", "m0/src/app"), excluded_direct=("m0/tests", "m0/lib/util"), tiles=4).settled()
SEARCH = W.View(kinds=("code", "i18n", "data"), show_generated=True, query=" MAIN ", scope="m0/src", tree_sort="weight",
                selected="m0/src/main", measure="lines", metric="comment_lines", min_weight=3, limit=5, offset=5).settled()
DIRECT = W.View(selected="m0/src", selected_direct=True, measure="code_lines", metric="name", limit=7, show_generated=True).settled()


_INDEXES: dict[tuple[str, str], str] = {}


def files(spark, sf):
    """The measured index: scanned once per session, saved, and read back by every request.

    This is how the index is meant to be used; ``c5`` and ``a9`` time the scan itself.
    """
    key = (spark.sparkContext.applicationId, sf)
    if key not in _INDEXES:
        place = f"{shared_folder(spark)}/massmap-index-{uuid.uuid4().hex}"
        save_index(scan(A.byte_snapshots(spark, sf), exclude=("config",)), place)
        _INDEXES[key] = place
    return load_index(spark, _INDEXES[key])


def frames(spark, sf, view):
    direct = written(W.direct_frame(files(spark, sf), view), "folders")
    return direct, written(W.subtree_frame(direct, view), "subtrees")


def answer(build, view):
    """A query of one answer from the folder sums."""
    def run(spark, sf):
        direct, subtree = frames(spark, sf, view)
        return build(direct, subtree, view)

    return run


def of_files(build, view):
    def run(spark, sf):
        table = files(spark, sf)
        subtree = written(W.subtree_frame(W.direct_frame(table, view), view), "subtrees")
        return build(table, subtree, view)

    return run


# --- SQL of a request ---------------------------------------------------------
def in_list(column: str, items) -> str:
    return f"{column} IN {O.values(items)}" if items else "false"


def inside(column: str, root: str) -> str:
    return f"({root} = '' OR {column} = {root} OR starts_with({column}, {root} || '/'))"


def chain(column: str) -> str:
    return f"CASE WHEN {column} = '' THEN [''] ELSE list_append({O.folders_above(column)}, {column}) END"


SUPPORTING = [c for c in W.SUPPORTING]


def marked_sql(view: W.View) -> str:
    query = view.query.strip().lower()
    seen = f"contains(lower(path), {O.q(query)})" if query else "true"
    shown = f"CASE WHEN generated THEN {str(view.show_generated).lower()} ELSE {in_list('kind', view.kinds)} END"
    out = f"list_has_any({chain('folder')}, {O.array(view.excluded_folders)})" if view.excluded_folders else "false"
    return f"""
marked AS (
  SELECT *, {view.measure} AS weight, {seen} AS seen, {seen} AND {shown} AS shown,
    {out} OR {in_list('folder', view.excluded_direct)} AS left_out FROM rows),
spread AS (SELECT *, unnest({O.folders_above('path')}) AS above FROM marked)"""


def sums_sql() -> str:
    counted = "shown AND NOT left_out AND is_measured"
    zero = [n for n in SUPPORTING if n not in ("tokens", "lines", "code_lines")]
    parts = [f"coalesce(sum(CASE WHEN {counted} THEN weight END), 0)::BIGINT AS weight", "0::BIGINT AS added", "0::BIGINT AS removed"]
    parts += [f"coalesce(sum(CASE WHEN {counted} THEN {n} END), 0)::BIGINT AS {n}" for n in ("tokens", "lines", "code_lines")]
    parts += [f"0::BIGINT AS {n}" for n in zero]
    parts += [f"count(*) FILTER ({counted}) AS files"]
    parts += [f"coalesce(sum(CASE WHEN {counted} AND flavor = '{f}' THEN abs(weight) END), 0)::BIGINT AS flavor_{f}" for f in V.FLAVORS]
    parts += ["count(*) FILTER (shown) AS category_count", "count(*) FILTER (seen) AS path_count",
              "count(*) FILTER (seen AND NOT is_measured) AS unmeasured_count",
              "count(*) FILTER (seen AND is_measured AND generated) AS generated_count",
              "coalesce(sum(CASE WHEN shown THEN weight END), 0)::BIGINT AS category_weight",
              "coalesce(sum(CASE WHEN seen AND NOT left_out THEN weight END), 0)::BIGINT AS flavor_baseline",
              "coalesce(sum(weight), 0)::BIGINT AS all_weight", "coalesce(sum(tokens), 0)::BIGINT AS widest_tokens",
              "coalesce(sum(lines), 0)::BIGINT AS widest_lines"]
    parts += [f"coalesce(sum(CASE WHEN seen AND is_measured AND flavor = '{f}' THEN weight END), 0)::BIGINT AS signed_{f}" for f in V.FLAVORS]
    return ", ".join(parts)


def view_ctes(view: W.View) -> str:
    out = f"list_has_any({chain('folder')}, {O.array(view.excluded_folders)})" if view.excluded_folders else "false"
    below = " OR ".join(
        [f"EXISTS (SELECT 1 FROM folder_list g WHERE g.repo = s.repo AND g.folder = {O.q(x)} AND g.folder <> s.folder AND {inside('g.folder', 's.folder')})" for x in view.excluded_folders]
        + [f"EXISTS (SELECT 1 FROM folder_list g WHERE g.repo = s.repo AND g.folder = {O.q(x)} AND {inside('g.folder', 's.folder')})" for x in view.excluded_direct]
    ) or "false"
    return f"""{O.SCANNED},{marked_sql(view)},
direct AS (SELECT repo, folder, {sums_sql()} FROM marked GROUP BY repo, folder),
summed AS (SELECT repo, above AS folder, {sums_sql()} FROM spread GROUP BY repo, above),
folder_list AS (SELECT repo, folder FROM summed),
subtree AS (SELECT s.*, NOT {out} AS included, NOT {out} AND ({below}) AS indeterminate,
  {out} AND NOT {in_list('folder', view.excluded_folders)} AS disabled FROM summed s),
scoped AS (SELECT r.repo, coalesce(max(s.folder), '') AS scope FROM (SELECT DISTINCT repo FROM rows) r
  LEFT JOIN subtree s ON s.repo = r.repo AND s.folder = {O.q(view.scope)} GROUP BY r.repo),
scopes AS (SELECT c.repo, c.scope, s.weight AS visible_weight, s.flavor_baseline AS scope_flavor_baseline
  FROM scoped c JOIN subtree s ON s.repo = c.repo AND s.folder = c.scope),
chosen AS (SELECT c.*, coalesce(s.folder, c.scope) AS selected, {str(view.selected_direct).lower()} AND s.folder IS NOT NULL AS selected_direct
  FROM scopes c LEFT JOIN subtree s ON s.repo = c.repo AND s.folder = {O.q(view.selected)} AND {inside('s.folder', 'c.scope')})"""


def view_sql(view: W.View, body: str) -> str:
    return O.with_ctes(view_ctes(view), body)


def share_sql(part: str, whole: str) -> str:
    return f"CASE WHEN {whole} > 0 THEN least(1.0, abs({part})::DOUBLE / {whole}) ELSE 0.0 END"


DEPTH = "CASE WHEN {0} = '' THEN 0 ELSE len(string_split({0}, '/')) END"


def tree_sql(view: W.View) -> str:
    everything = bool(view.query.strip())
    above = f"list_filter({O.folders_above('s.folder')}, lambda f: {inside('f', 'c.scope')})"
    opened = "true" if everything else f"(s.folder = '' OR len(list_filter({above}, lambda f: NOT list_contains({O.array(view.expanded)}, f))) = 0)"
    is_open = "true" if everything else in_list("folder", view.expanded)
    return view_sql(view, f"""
, shown_folders AS (SELECT s.*, c.scope, c.visible_weight, c.selected, c.selected_direct, {DEPTH.format('s.folder')} - {DEPTH.format('c.scope')} AS depth
  FROM subtree s JOIN chosen c USING (repo) WHERE path_count > 0 AND {inside('s.folder', 'c.scope')} AND {opened})
SELECT repo, folder AS path, 'folder' AS row_kind, {O.base('folder')} AS name, depth::INT AS depth, path_count AS files, unmeasured_count AS unmeasured_files,
  weight, added, removed, {share_sql('weight', 'visible_weight')} AS share_of_scope, 0.0::DOUBLE AS share_added, 0.0::DOUBLE AS share_removed,
  true AS has_children, {is_open} AS expanded, included, indeterminate, disabled, category_count = 0 AS filtered_out,
  NOT selected_direct AND selected = folder AS selected FROM shown_folders
UNION ALL
SELECT d.repo, d.folder, 'files', '.', f.depth + 1, d.path_count, d.unmeasured_count, d.weight, d.added, d.removed,
  {share_sql('d.weight', 'f.visible_weight')}, 0.0, 0.0, false, false, f.included AND NOT {in_list('d.folder', view.excluded_direct)}, false, NOT f.included,
  d.category_count = 0, f.selected_direct AND f.selected = d.folder
FROM direct d JOIN shown_folders f ON f.repo = d.repo AND f.folder = d.folder WHERE d.path_count > 0 AND {is_open.replace('folder', 'f.folder')}""".replace("\n, shown_folders", ", shown_folders", 1))


CARD = ", ".join(["weight", "added", "removed", "files", *[f"flavor_{f}" for f in V.FLAVORS]])
CARD_SUMS = ", ".join(f"sum({c.strip()})::BIGINT AS {c.strip()}" for c in CARD.split(","))


def ribbon_sql(view: W.View) -> str:
    return view_sql(view, f""", strip_parts AS (
  SELECT s.repo, s.folder AS path, {O.base('s.folder')} AS name, 'folder' AS row_kind, {CARD}, c.visible_weight FROM subtree s JOIN scopes c ON c.repo = s.repo
    AND s.folder <> '' AND {O.folder('s.folder')} = c.scope WHERE weight <> 0
  UNION ALL SELECT d.repo, d.folder, '.', 'files', {CARD}, c.visible_weight FROM direct d JOIN scopes c ON c.repo = d.repo AND d.folder = c.scope WHERE weight <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY abs(weight) DESC, row_kind = 'files', path) AS place,
  sum(abs(weight)) OVER (PARTITION BY repo) AS strip FROM strip_parts),
judged AS (SELECT *, row_kind = 'files' OR (place <= 20 AND abs(weight)::DOUBLE / strip >= 0.005) AS drawn FROM placed)
SELECT repo, least(place, 21)::INT AS place, path, name, row_kind, {CARD}, {share_sql('weight', 'visible_weight')} AS share_of_scope FROM judged WHERE drawn
UNION ALL
SELECT repo, 22, NULL, count(*) || ' more folders', 'folder', {CARD_SUMS.replace(' AS ', ' AS t_')}, {share_sql('sum(weight)', 'any_value(visible_weight)')} FROM judged WHERE NOT drawn GROUP BY repo""")


def tiles_sql(view: W.View) -> str:
    card_with_count = CARD.replace("files,", "path_count AS files,")
    return view_sql(view, f""", folders AS (
  SELECT s.repo, s.folder AS path, {O.base('s.folder')} AS name, {card_with_count}, c.visible_weight FROM subtree s JOIN chosen c ON c.repo = s.repo
    AND s.folder <> '' AND {O.folder('s.folder')} = c.selected WHERE s.path_count > 0 AND NOT c.selected_direct),
own AS (SELECT c.repo, c.selected AS path, {", ".join("coalesce(" + x.strip() + ", 0) AS " + x.strip() for x in CARD.split(",") if x.strip() != "files")}, coalesce(d.path_count, 0) AS files, c.visible_weight,
  (SELECT count(*) FROM folders f WHERE f.repo = c.repo) AS n FROM chosen c LEFT JOIN direct d ON d.repo = c.repo AND d.folder = c.selected),
plan AS (SELECT *, files > 0 OR n = 0 AS draws, CASE WHEN files > 0 OR n = 0 THEN {view.tiles} - 1 ELSE {view.tiles} END AS room FROM own),
placed AS (SELECT f.*, row_number() OVER (PARTITION BY f.repo ORDER BY abs(f.weight) DESC, f.path) AS place, p.room,
  CASE WHEN p.n <= p.room THEN p.n ELSE greatest(p.room - 1, 0) END AS take FROM folders f JOIN plan p ON p.repo = f.repo)
SELECT repo, 0 AS place, path, '.' AS name, 'files' AS row_kind, {CARD}, {share_sql('weight', 'visible_weight')} AS share_of_scope FROM plan WHERE draws
UNION ALL SELECT repo, place, path, name, 'folder', {CARD}, {share_sql('weight', 'visible_weight')} FROM placed WHERE place <= take
UNION ALL SELECT repo, {view.tiles} + 1, NULL, count(*) || ' more folders', 'folder', {CARD_SUMS.replace(' AS ', ' AS t_')},
  {share_sql('sum(weight)', 'any_value(visible_weight)')} FROM placed WHERE place > take AND room >= 1 GROUP BY repo""")


FIGURE_NAMES = ["weight", "added", "removed", "files", *SUPPORTING]


def summary_sql(view: W.View) -> str:
    return view_sql(view, f"""SELECT c.repo, r.all_weight AS project_weight, greatest(r.widest_tokens, r.widest_lines) AS widest_weight, c.scope AS scope_path,
  s.all_weight AS scope_weight, {", ".join(f"s.{n} AS selected_{n}" for n in FIGURE_NAMES)}
FROM scopes c JOIN subtree r ON r.repo = c.repo AND r.folder = '' JOIN subtree s ON s.repo = c.repo AND s.folder = c.scope""")


def picked(name: str, near: str) -> str:
    return f"CASE WHEN {near} THEN coalesce(d.{name}, 0) ELSE s.{name} END"


def detail_sql(view: W.View) -> str:
    near = f"(c.selected_direct OR {str(view.file_scope == 'folder').lower()})"
    return view_sql(view, f"""SELECT c.repo, c.selected AS path, CASE WHEN c.selected_direct THEN '.' ELSE {O.base('c.selected')} END AS title,
  CASE WHEN c.selected_direct THEN {chain('c.selected')} WHEN c.selected = '' THEN [] ELSE {O.folders_above('c.selected')} END AS trail,
  {", ".join(f"{picked(n, 'c.selected_direct')} AS {n}" for n in FIGURE_NAMES)},
  {share_sql(picked('weight', 'c.selected_direct'), 'c.visible_weight')} AS share_of_scope,
  {picked('files', near)} AS shown_files, {picked('path_count', near)} AS available_files, {picked('unmeasured_count', near)} AS unmeasured_files,
  {picked('generated_count', near)} AS generated_files, c.scope_flavor_baseline AS flavor_baseline
FROM chosen c JOIN subtree s ON s.repo = c.repo AND s.folder = c.selected LEFT JOIN direct d ON d.repo = c.repo AND d.folder = c.selected""")


def flavors_sql(view: W.View) -> str:
    near = f"(c.selected_direct OR {str(view.file_scope == 'folder').lower()})"
    rows = " UNION ALL ".join(
        f"SELECT c.repo, {at} AS place, '{f}' AS flavor, {picked(f'signed_{f}', near)} AS weight, "
        f"{str(view.show_generated if f == 'generated' else f in view.kinds).lower()} AS enabled "
        "FROM chosen c JOIN subtree s ON s.repo = c.repo AND s.folder = c.selected LEFT JOIN direct d ON d.repo = c.repo AND d.folder = c.selected"
        for at, f in enumerate(V.FLAVORS)
    )
    return view_sql(view, rows)


def matching_sql(view: W.View) -> str:
    near = f"(c.selected_direct OR {str(view.file_scope == 'folder').lower()})"
    floor = f"AND (NOT m.is_measured OR abs(m.weight) >= {view.min_weight})" if view.min_weight else ""
    return f""", found AS (SELECT m.* FROM marked m JOIN chosen c ON c.repo = m.repo
  WHERE m.shown AND NOT m.left_out AND CASE WHEN {near} THEN m.folder = c.selected ELSE {inside('m.folder', 'c.selected')} END {floor})"""


def ranked_sql(view: W.View) -> str:
    metric = "" if view.metric == "name" else f"abs(coalesce({view.metric}, 0)) DESC, "
    asked = view.offset // view.limit * view.limit
    return view_sql(view, matching_sql(view) + f""",
numbered AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY {metric}abs(coalesce(weight, 0)) DESC, path) AS rank,
  count(*) OVER (PARTITION BY repo) AS ranked_total FROM found),
paged AS (SELECT *, least({asked}, (ranked_total - 1) // {view.limit} * {view.limit}) AS ranked_offset FROM numbered)
SELECT repo, path, rank, weight, ranked_total, ranked_offset FROM paged WHERE rank > ranked_offset AND rank <= ranked_offset + {view.limit}""")


def page(view):
    def run(spark, sf):
        return of_files(W.ranked_page, view)(spark, sf).select("repo", "path", "rank", "weight", "ranked_total", "ranked_offset")

    return run


# --- D: hierarchy ---------------------------------------------------------------
MEASURES = ("tokens", "lines", "code_lines", "comment_lines")


def d1(spark, sf):
    return H.folders(files(spark, sf))


def subtree_columns(view, *columns):
    return answer(lambda direct, subtree, v: subtree.select("repo", "folder", *columns), view)


def direct_columns(view, *columns):
    return answer(lambda direct, subtree, v: direct.select("repo", "folder", *columns), view)


SLICES = [f"flavor_{f}" for f in V.FLAVORS]


def d4(spark, sf):
    rows = subtree_columns(FLAT, *SLICES)(spark, sf)
    return rows.unpivot(["repo", "folder"], SLICES, "flavor", "weight").where("weight > 0").withColumn(
        "flavor", F.regexp_replace("flavor", "^flavor_", ""))


D4_SQL = view_sql(FLAT, "SELECT repo, folder, flavor, weight FROM (" + " UNION ALL ".join(
    f"SELECT repo, folder, '{f}' AS flavor, flavor_{f} AS weight FROM subtree" for f in V.FLAVORS) + ") WHERE weight > 0")


def d5(spark, sf):
    return H.running_weights(files(spark, sf), ["tokens", "lines"])


def d16(spark, sf):
    return files(spark, sf).where("language IS NOT NULL").groupBy("repo").agg(F.array_sort(F.collect_set("language")).alias("languages"))


def i4(spark, sf):
    """Every strip adds up to its scope: drawn parts and tail against the scope's own sum."""
    direct, subtree = frames(spark, sf, FLAT)
    strip = W.ribbon(direct, subtree, FLAT).groupBy("repo").agg(F.sum("weight").alias("strip"), F.sum("files").alias("files"))
    return strip.join(W.summary(subtree, FLAT).select("repo", F.col("selected_weight").alias("scope")), "repo")


I4_SQL = view_sql(FLAT, "SELECT repo, weight AS strip, weight AS scope, coalesce((SELECT sum(files) FROM direct d WHERE d.repo = s.repo AND d.weight <> 0), 0)::BIGINT AS files FROM subtree s WHERE folder = '' AND weight <> 0")


def d18_sql(view):
    return "SELECT repo, shown_files, available_files, unmeasured_files, generated_files FROM (" + detail_sql(view) + ")"


def tree_order(spark, sf):
    rows = answer(W.tree, SEARCH)(spark, sf)
    return ranked(rows, ["repo"], [F.col("sort_key")], "ord").select("repo", "ord", "path", "row_kind")


def tree_order_sql(view: W.View) -> str:
    """Order by the chain of (weight, name) down to each row, as arrays."""
    inner = tree_sql(view)
    head, body = inner.split("\nSELECT repo, folder AS path", 1)
    return head + f""", tree_rows AS (SELECT repo, folder AS path{body}),
keys AS (SELECT t.repo, t.path, list([lpad((1000000000000 - s.category_weight)::VARCHAR, 14, '0'), {O.base('s.folder')}] ORDER BY length(s.folder)) AS key
  FROM (SELECT DISTINCT repo, path FROM tree_rows) t JOIN shown_folders s ON s.repo = t.repo AND {inside('t.path', 's.folder')} GROUP BY t.repo, t.path)
SELECT r.repo, row_number() OVER (PARTITION BY r.repo ORDER BY CASE WHEN row_kind = 'files' THEN list_append(k.key, ['', '']) ELSE k.key END) AS ord, r.path, r.row_kind
FROM tree_rows r JOIN keys k ON k.repo = r.repo AND k.path = r.path"""


# --- reports --------------------------------------------------------------------
SECTION_CTES = f"""{O.SCANNED},
weighed AS (SELECT *, flavor AS section, tokens AS weight FROM rows WHERE is_measured),
section_rows AS (SELECT repo, section, folder, weight, lines, comment_lines FROM weighed),
section_spread AS (SELECT repo, section, weight, lines, comment_lines, folder AS own, unnest({O.folders_above('path')}) AS folder FROM weighed),
sections AS (SELECT repo, section, folder, sum(weight)::BIGINT AS weight, count(*) AS files, sum(lines)::BIGINT AS lines, sum(comment_lines)::BIGINT AS comment_lines,
  count(*) FILTER (own = folder) AS own_files FROM section_spread GROUP BY ALL)"""


def section_sql(body: str) -> str:
    return O.with_ctes(SECTION_CTES, body)


def d9(spark, sf):
    return R.section_folders(files(spark, sf), "tokens", "after").select("repo", "section", "folder", "weight", "baseline", "files", "lines", "comment_lines", "own_files")


def d10(spark, sf):
    return R.section_totals(files(spark, sf), "tokens", "after").select("repo", "section", "weight", "files", "lines", "comment_lines", F.round("share", 6).alias("share"))


D10_SQL = section_sql("""SELECT repo, section, weight, files, lines, comment_lines, round(CASE WHEN whole > 0 THEN weight::DOUBLE / whole ELSE 0 END, 6) AS share FROM (
  SELECT repo, section, sum(weight)::BIGINT AS weight, count(*) AS files, sum(lines)::BIGINT AS lines, sum(comment_lines)::BIGINT AS comment_lines,
    (SELECT sum(weight) FROM weighed x WHERE x.repo = w.repo) AS whole FROM weighed w GROUP BY GROUPING SETS ((repo, section), (repo)))""")

CASE_HEADINGS = O.case_of("section", R.HEADINGS)
CASE_LABELS = O.case_of("section", R.LABELS)
NAMED = """heaviest AS (SELECT * FROM (SELECT repo, section, path, weight, row_number() OVER (PARTITION BY repo, section ORDER BY weight DESC, path) AS rank FROM weighed) WHERE rank <= 3)"""


def l7_sql() -> str:
    order = "CASE section " + " ".join(f"WHEN '{f}' THEN {at}" for at, f in enumerate(V.FLAVORS)) + " END"
    return section_sql(f""", per AS (SELECT repo, section, weight, files FROM sections WHERE folder = ''),
whole AS (SELECT repo, sum(weight)::BIGINT AS w FROM per GROUP BY repo),
split AS (SELECT repo, string_agg({CASE_LABELS} || ' ' || {compact_sql('weight')} || ' ' || {share_text_sql('(CASE WHEN w > 0 THEN weight::DOUBLE / w ELSE 0 END)')}, '  ' ORDER BY {order}) AS split FROM per JOIN whole USING (repo) GROUP BY repo),
ratio AS (SELECT repo, sum(CASE WHEN section = 'test' THEN weight ELSE 0 END)::DOUBLE / sum(CASE WHEN section = 'code' THEN weight ELSE 0 END) AS r FROM per GROUP BY repo HAVING sum(CASE WHEN section = 'code' THEN weight ELSE 0 END) > 0),
sizes AS (SELECT repo, count(*) AS n, coalesce(sum(tokens), 0)::BIGINT AS t, coalesce(sum(lines), 0)::BIGINT AS l, coalesce(sum(code_lines), 0)::BIGINT AS c, coalesce(sum(comment_lines), 0)::BIGINT AS m,
  count(*) FILTER (is_measured) AS measured, count(*) FILTER (is_measured AND generated) AS generated, count(*) FILTER (NOT is_measured) AS not_measured FROM rows GROUP BY repo)
SELECT s.repo, 'tree of ' || {files_sql('n')} || ': ' || {compact_sql('t')} || ' tokens, ' || {compact_sql('l')} || ' lines, ' || {compact_sql('c')} || ' loc, '
    || {share_text_sql('(CASE WHEN l > 0 THEN m::DOUBLE / l ELSE 0 END)')} || ' comment' AS size, NULL::VARCHAR AS change,
  'tokens by flavor: ' || coalesce(split, '') AS split, CASE WHEN r IS NOT NULL THEN 'Tests weigh ' || {share_text_sql('r')} || ' of code.' END AS ratio,
  'A node is expanded at >= 3% of its section.' AS rule,
  'Coverage: ' || n || ' files, ' || measured || ' measured, ' || generated || ' generated, ' || not_measured || ' not measured.' AS coverage
FROM sizes s LEFT JOIN split p ON p.repo = s.repo LEFT JOIN ratio t ON t.repo = s.repo""")


ONE_LINE_SQL = section_sql(f""", {NAMED},
lists AS (SELECT repo, section, string_agg(path || ' ' || {compact_sql('weight')}, ', ' ORDER BY rank) AS listed FROM heaviest GROUP BY repo, section)
SELECT s.repo, s.section, {O.case_of('s.section', R.HEADINGS)} || '  ' || {compact_sql('s.weight')} || ' tokens, ' || {files_sql('s.files')}
  || CASE WHEN s.section = 'generated' THEN ', excluded above' ELSE '' END || ': ' || listed AS text
FROM sections s JOIN lists l ON l.repo = s.repo AND l.section = s.section WHERE s.folder = '' AND s.section NOT IN ('code', 'test')""")


def walk_sql(threshold: float) -> str:
    """The walk by recursion from the root down, with a key that sorts it."""
    def key(size: str, name: str) -> str:
        return f"'1' || lpad((1000000000000 - {size})::VARCHAR, 14, '0') || {name}"

    return section_sql(f""", tot AS (SELECT repo, section, weight AS total FROM sections WHERE folder = '' AND section IN ('code', 'test')),
kids AS (SELECT s.*, {O.folder('s.folder')} AS parent, t.total, t.total > 0 AND abs(s.weight)::DOUBLE / t.total >= {threshold} / 100.0 AS passes
  FROM sections s JOIN tot t USING (repo, section)),
nodes AS (SELECT k.*, k.own_files = 0 AND (SELECT count(*) FROM kids c WHERE c.repo = k.repo AND c.section = k.section AND c.folder <> '' AND c.parent = k.folder) = 1 AS chained FROM kids k),
down AS (
  SELECT repo, section, folder, weight, files, total, chained, 0 AS depth, './' AS label, '' AS pending, {key('weight', "''")} AS key FROM nodes WHERE folder = ''
  UNION ALL
  SELECT n.repo, n.section, n.folder, n.weight, n.files, n.total, n.chained, CASE WHEN d.chained THEN d.depth ELSE d.depth + 1 END,
    CASE WHEN d.chained THEN CASE WHEN d.folder = '' THEN '' ELSE d.label END ELSE '' END || {O.base('n.folder')} || '/', '',
    d.key || chr(1) || {key('n.weight', O.base('n.folder'))}
  FROM down d JOIN nodes n ON n.repo = d.repo AND n.section = d.section AND n.folder <> '' AND n.parent = d.folder WHERE n.passes),
open_folders AS (SELECT * FROM down WHERE NOT chained),
items AS (SELECT w.*, t.total, t.total > 0 AND w.weight::DOUBLE / t.total >= {threshold} / 100.0 AS passes FROM weighed w JOIN tot t USING (repo, section)),
below AS (SELECT repo, section, parent AS folder, passes, weight, files FROM nodes WHERE folder <> '' UNION ALL SELECT repo, section, folder, passes, weight, 1 FROM items),
rest AS (SELECT repo, section, folder, sum(weight) FILTER (NOT passes)::BIGINT AS weight, sum(files) FILTER (NOT passes)::BIGINT AS files FROM below GROUP BY ALL HAVING bool_or(passes) AND NOT bool_and(passes)),
printed AS (
  SELECT repo, section, depth, label, weight, total, {files_sql('files')} AS trailer, key FROM open_folders
  UNION ALL SELECT i.repo, i.section, o.depth + 1, i.name, i.weight, i.total, CASE WHEN i.section = 'code' THEN concat_ws(', ', {compact_sql('i.code_lines')} || ' loc',
      CASE WHEN i.lines > 0 AND i.comment_lines::DOUBLE / i.lines >= 0.2 THEN {share_text_sql('(i.comment_lines::DOUBLE / i.lines)')} || ' comment' END,
      CASE WHEN i.language IS NOT NULL THEN {compact_sql('i.functions')} || ' fn, ' || {compact_sql('i.branches')} || ' br' END) ELSE '' END,
    o.key || chr(1) || {key('i.weight', 'i.name')} FROM items i JOIN open_folders o ON o.repo = i.repo AND o.section = i.section AND o.folder = i.folder WHERE i.passes
  UNION ALL SELECT r.repo, r.section, o.depth + 1, '... ' || {files_sql('r.files')}, r.weight, o.total, '', o.key || chr(1) || '2'
    FROM rest r JOIN open_folders o ON o.repo = r.repo AND o.section = r.section AND o.folder = r.folder)
SELECT repo, section, row_number() OVER (PARTITION BY repo, section ORDER BY key) AS ord, depth::INT AS depth, label, {compact_sql('weight')} AS weight,
  {share_text_sql('(CASE WHEN total > 0 THEN weight::DOUBLE / total ELSE 0 END)')} AS share, trailer FROM printed""")


def walk_query(threshold, *columns):
    def run(spark, sf):
        rows = R.walk(files(spark, sf), threshold=threshold)
        return rows.select(*columns) if columns else rows

    return run


# --- plain hierarchies -----------------------------------------------------------
def l12(spark, sf):
    """Order lines weighed over region, nation and customer: any path-keyed table."""
    lineitem = A.table(spark, sf, "lineitem").select("l_orderkey", "l_quantity")
    orders = A.table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey"), "o_orderstatus")
    customer = A.table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("n_nationkey"))
    nation = A.table(spark, sf, "nation").select("n_nationkey", "n_name", F.col("n_regionkey").alias("r_regionkey"))
    region = A.table(spark, sf, "region").select("r_regionkey", "r_name")
    per_order = lineitem.groupBy("l_orderkey").agg(F.sum("l_quantity").cast("bigint").alias("quantity"), F.count("*").alias("lines"))
    placed = per_order.join(orders, "l_orderkey").join(customer, "c_custkey").join(nation, "n_nationkey").join(region, "r_regionkey")
    frame = placed.select(
        F.concat_ws("/", "r_name", "n_name", F.col("c_custkey").cast("string"), F.col("l_orderkey").cast("string")).alias("path"),
        "quantity", "lines", F.when(F.col("o_orderstatus") == "F", "code").when(F.col("o_orderstatus") == "O", "test").otherwise("data").alias("flavor"))
    return H.weigh_tree(frame, "path", ["quantity", "lines"], "flavor")


L12_SQL = f"""WITH o AS (SELECT l_orderkey, sum(l_quantity)::BIGINT AS quantity, count(*) AS lines FROM lineitem GROUP BY 1),
p AS (SELECT r_name || '/' || n_name || '/' || c_custkey || '/' || l_orderkey AS path, quantity, lines,
  CASE o_orderstatus WHEN 'F' THEN 'code' WHEN 'O' THEN 'test' ELSE 'data' END AS flavor
  FROM o JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey),
s AS (SELECT *, {O.folder('path')} AS own, unnest({O.folders_above('path')}) AS folder FROM p)
SELECT folder, count(*) AS files, sum(quantity)::BIGINT AS quantity, sum(lines)::BIGINT AS lines,
  {", ".join(f"coalesce(sum(quantity) FILTER (flavor = '{f}'), 0)::BIGINT AS flavor_{f}" for f in V.FLAVORS)},
  count(*) FILTER (own = folder) AS direct_files, coalesce(sum(quantity) FILTER (own = folder), 0)::BIGINT AS direct_quantity,
  coalesce(sum(lines) FILTER (own = folder), 0)::BIGINT AS direct_lines FROM s GROUP BY folder"""


def l12_pages(spark, sf):
    pages = A.page_files(spark, sf)
    frame = pages.select("repo", "path", F.length("text").cast("bigint").alias("chars"))
    return H.weigh_tree(frame, "path", ["chars"], None, ["repo"])


def l12_pages_sql() -> str:
    from catalog.classify import PAGE_FILES

    return f"""WITH {PAGE_FILES}, s AS (SELECT repo, length(text) AS chars, {O.folder('path')} AS own, unnest({O.folders_above('path')}) AS folder FROM page_files)
SELECT repo, folder, count(*) AS files, sum(chars)::BIGINT AS chars, count(*) FILTER (own = folder) AS direct_files,
  coalesce(sum(chars) FILTER (own = folder), 0)::BIGINT AS direct_chars FROM s GROUP BY ALL"""


def l1(spark, sf):
    """One frame that holds a line per answer of a request, each read off its own frame."""
    answers = W.view(files(spark, sf), FLAT)
    counted = [frame.groupBy("repo").agg(F.count("*").alias("rows")).select("repo", F.lit(name).alias("answer"), "rows")
               for name, frame in answers.items()]
    total = counted[0]
    for frame in counted[1:]:
        total = total.unionByName(frame)
    return total


def l1_sql() -> str:
    parts = {"summary": summary_sql(FLAT), "ribbon": ribbon_sql(FLAT), "tree": tree_sql(FLAT), "detail": detail_sql(FLAT),
             "tiles": tiles_sql(FLAT), "flavors": flavors_sql(FLAT), "ranked": ranked_sql(FLAT),
             "files": view_sql(FLAT, matching_sql(FLAT) + " SELECT repo FROM found"),
             "expandable": view_sql(FLAT, f"SELECT s.repo FROM subtree s JOIN scopes c USING (repo) WHERE path_count > 0 AND {inside('s.folder', 'c.scope')}")}
    return " UNION ALL ".join(f"SELECT repo, '{n}' AS answer, count(*) AS rows FROM ({sql}) GROUP BY repo" for n, sql in parts.items())


def e10(spark, sf):
    """What a request becomes, for each repository's mode (all are scans here)."""
    asked = W.View(aspect="churn", metric="net", limit=5000, tiles=9, offset=-3).settled()
    repos = files(spark, sf).groupBy("repo").agg(F.sum(asked.weight).alias("weight"))
    return repos.select("repo", "weight", F.lit(asked.aspect).alias("aspect"), F.lit(asked.metric).alias("metric"),
                        F.lit(asked.limit).alias("lim"), F.lit(asked.tiles).alias("tiles"), F.lit(asked.offset).alias("off"))


def b38(spark, sf):
    """How much of each project the filters keep."""
    rows = answer(lambda d, s, v: W.summary(s, v), FLAT)(spark, sf)
    kept = F.when(F.col("project_weight") > 0, F.abs("selected_weight") / F.col("project_weight"))
    return rows.select("repo", F.round(kept, 6).alias("kept"))


MARK_COLUMNS = ["repo", "path", "path_visible", "category_visible", "included", "available"]


def marks(view):
    return lambda spark, sf: W.marked(files(spark, sf), view).select(*MARK_COLUMNS)


def marks_sql(view):
    return O.with_ctes(f"{O.SCANNED},{marked_sql(view)}", "SELECT repo, path, seen AS path_visible, shown AS category_visible, shown AND NOT left_out AS included, seen AND NOT left_out AS available FROM marked")


ENTRIES = [
    ("b38_kept_share", b38, "SELECT repo, round(CASE WHEN project_weight > 0 THEN abs(selected_weight)::DOUBLE / project_weight END, 6) AS kept FROM (" + summary_sql(FLAT) + ")"),
    ("d1_folders", d1, O.with_ctes(O.SCANNED, f"""SELECT DISTINCT repo, folder, {O.base('folder')} AS name, CASE WHEN folder <> '' THEN {O.folder('folder')} END AS parent, ({DEPTH.format('folder')})::INT AS depth
      FROM (SELECT repo, unnest({O.folders_above('path')}) AS folder FROM rows)""")),
    ("d2_folder_rollup", subtree_columns(FLAT, "weight", "added", "removed", *SUPPORTING, "files"),
     view_sql(FLAT, f"SELECT repo, folder, weight, added, removed, {', '.join(SUPPORTING)}, files FROM subtree")),
    ("d3_direct_totals", direct_columns(FLAT, "weight", "tokens", "lines", "code_lines", "files"),
     view_sql(FLAT, "SELECT repo, folder, weight, tokens, lines, code_lines, files FROM direct")),
    ("d4_flavor_slices", d4, D4_SQL),
    ("d5_unfiltered_weights", subtree_columns(FLAT, "all_weight", "widest_tokens", "widest_lines"),
     view_sql(FLAT, "SELECT repo, folder, all_weight, widest_tokens, widest_lines FROM subtree")),
    ("d6_subtree_counts", subtree_columns(SEARCH, "category_count", "path_count", "unmeasured_count"),
     view_sql(SEARCH, "SELECT repo, folder, category_count, path_count, unmeasured_count FROM subtree")),
    ("d7_flavor_baseline", subtree_columns(FLAT, "flavor_baseline"), view_sql(FLAT, "SELECT repo, folder, flavor_baseline FROM subtree")),
    ("d9_section_folders", d9, section_sql("SELECT repo, section, folder, weight, weight AS baseline, files, lines, comment_lines, own_files FROM sections")),
    ("d10_flavor_split", d10, D10_SQL),
    ("d14_coverage", lambda spark, sf: R.coverage(files(spark, sf)), O.with_ctes(O.SCANNED, """SELECT repo, count(*) AS files, count(*) FILTER (is_measured) AS measured,
      count(*) FILTER (is_measured AND generated) AS generated, count(*) FILTER (NOT is_measured) AS not_measured FROM rows GROUP BY repo""")),
    ("d14_unmeasured_paths", lambda spark, sf: R.unmeasured(files(spark, sf)),
     O.with_ctes(O.SCANNED, f"SELECT repo, path, {O.case_of('measurement', V.REASON_LABELS)} AS reason FROM rows WHERE NOT is_measured")),
    ("d15_tests_to_code", lambda spark, sf: R.tests_to_code(files(spark, sf), "tokens", False),
     section_sql(f"""SELECT repo, tests, code, {share_text_sql('(tests::DOUBLE / code)')} AS text FROM (SELECT repo, coalesce(sum(weight) FILTER (section = 'test'), 0)::BIGINT AS tests,
       coalesce(sum(weight) FILTER (section = 'code'), 0)::BIGINT AS code FROM weighed GROUP BY repo) WHERE code > 0""")),
    ("d16_languages", d16, O.with_ctes(O.SCANNED, "SELECT repo, list_sort(list(DISTINCT language)) AS languages FROM rows WHERE language IS NOT NULL GROUP BY repo")),
    ("d17_flavor_stats", answer(W.flavor_stats, FLAT), flavors_sql(FLAT)),
    ("d17_flavor_stats_direct", answer(W.flavor_stats, DIRECT), flavors_sql(DIRECT)),
    ("d18_selection_counts", answer(lambda d, s, v: W.detail(d, s, v).select("repo", "shown_files", "available_files", "unmeasured_files", "generated_files"), SEARCH), d18_sql(SEARCH)),
    ("d19_widest_figure", answer(lambda d, s, v: W.summary(s, v).select("repo", "widest_weight"), FLAT),
     "SELECT repo, widest_weight FROM (" + summary_sql(FLAT) + ")"),
    ("e1_path_search", marks(SEARCH), marks_sql(SEARCH)),
    ("e2_flavor_switches", marks(W.View(kinds=("text", "i18n"), show_generated=True).settled()), marks_sql(W.View(kinds=("text", "i18n"), show_generated=True).settled())),
    ("e3_folder_exclusions", subtree_columns(FLAT, "included", "indeterminate", "disabled"), view_sql(FLAT, "SELECT repo, folder, included, indeterminate, disabled FROM subtree")),
    ("e4_direct_exclusions", marks(W.View(excluded_direct=("m0/src", "m0/docs")).settled()), marks_sql(W.View(excluded_direct=("m0/src", "m0/docs")).settled())),
    ("e5_included_available", marks(FLAT), marks_sql(FLAT)),
    ("e6_drill_scope", answer(lambda d, s, v: W.selections(s, v).select("repo", "scope", "selected", "selected_direct", "visible_weight"), SEARCH),
     view_sql(SEARCH, "SELECT repo, scope, selected, selected_direct, visible_weight FROM chosen")),
    ("e7_file_scope", of_files(lambda f, s, v: W.matching(f, s, v).select("repo", "path"), W.View(selected="m0/src", file_scope="folder").settled()),
     view_sql(W.View(selected="m0/src", file_scope="folder").settled(), matching_sql(W.View(selected="m0/src", file_scope="folder").settled()) + " SELECT repo, path FROM found")),
    ("e8_weight_floor", of_files(lambda f, s, v: W.matching(f, s, v).select("repo", "path", "weight"), W.View(min_weight=300).settled()),
     view_sql(W.View(min_weight=300).settled(), matching_sql(W.View(min_weight=300).settled()) + " SELECT repo, path, weight FROM found")),
    ("e9_report_threshold", walk_query(12, "repo", "section", "label", "depth"), "SELECT repo, section, label, depth FROM (" + walk_sql(12) + ")"),
    ("e10_settled_request", e10, O.with_ctes(O.SCANNED, "SELECT repo, sum(tokens)::BIGINT AS weight, 'after' AS aspect, 'tokens' AS metric, 1000 AS lim, 6 AS tiles, 0 AS off FROM rows GROUP BY repo")),
    ("g1_ranked_files", lambda spark, sf: ranked(files(spark, sf).withColumn("weight", F.col("tokens")), ["repo"], W.ranking_order(W.View(metric="lines").settled())).select("repo", "path", "rank"),
     O.with_ctes(O.SCANNED, "SELECT repo, path, row_number() OVER (PARTITION BY repo ORDER BY coalesce(lines, 0) DESC, coalesce(tokens, 0) DESC, path) AS rank FROM rows")),
    ("g2_heaviest_of_flavor", lambda spark, sf: R.named_files(files(spark, sf), "tokens", "after"), section_sql(f", {NAMED} SELECT repo, section, rank, path, weight FROM heaviest")),
    ("g3_ribbon", answer(W.ribbon, FLAT), ribbon_sql(FLAT)),
    ("g4_tiles", answer(W.tiles, FLAT), tiles_sql(FLAT)),
    ("g5_running_weights", d5, O.with_ctes(O.SCANNED, """SELECT repo, path, tokens, lines, sum(coalesce(tokens, 0)) OVER w AS running_tokens, sum(coalesce(lines, 0)) OVER w AS running_lines
      FROM rows WINDOW w AS (PARTITION BY repo ORDER BY path ROWS UNBOUNDED PRECEDING)""")),
    ("h1_magnitude_order", page(W.View(kinds=tuple(V.FILE_KINDS), show_generated=True, limit=10).settled()), ranked_sql(W.View(kinds=tuple(V.FILE_KINDS), show_generated=True, limit=10).settled())),
    ("h2_name_never_cuts", page(DIRECT), ranked_sql(DIRECT)),
    ("h3_pages", page(SEARCH), ranked_sql(SEARCH)),
    ("h3_far_pages", page(W.View(kinds=tuple(V.FILE_KINDS), show_generated=True, limit=9, offset=100000).settled()), ranked_sql(W.View(kinds=tuple(V.FILE_KINDS), show_generated=True, limit=9, offset=100000).settled())),
    ("h4_complete_list", of_files(lambda f, s, v: W.matching(f, s, v).select("repo", "path", "flavor"), FLAT), view_sql(FLAT, matching_sql(FLAT) + " SELECT repo, path, flavor FROM found")),
    ("h5_tree_order", tree_order, tree_order_sql(SEARCH)),
    ("h8_path_order", lambda spark, sf: ranked(files(spark, sf).select("repo", "path"), ["repo"], [F.col("path")], "place"),
     O.with_ctes(O.SCANNED, "SELECT repo, path, row_number() OVER (PARTITION BY repo ORDER BY path) AS place FROM rows")),
    ("i2_parts_and_tail", answer(W.ribbon, W.View(show_generated=True, scope="m0").settled()), ribbon_sql(W.View(show_generated=True, scope="m0").settled())),
    ("i4_parts_add_up", i4, "SELECT repo, strip, scope, files FROM (" + view_sql(FLAT, "SELECT repo, weight AS strip, weight AS scope, files FROM subtree WHERE folder = '' AND weight <> 0") + ")"),
    ("l1_view", l1, l1_sql()),
    ("l2_tree", answer(lambda d, s, v: W.tree(d, s, v).drop("sort_key"), FLAT), tree_sql(FLAT)),
    ("l2_tree_search", answer(lambda d, s, v: W.tree(d, s, v).drop("sort_key"), SEARCH), tree_sql(SEARCH)),
    ("l3_detail", answer(W.detail, FLAT), detail_sql(FLAT)),
    ("l3_detail_direct", answer(W.detail, DIRECT), detail_sql(DIRECT)),
    ("l4_tiles", answer(W.tiles, SEARCH), tiles_sql(SEARCH)),
    ("l5_ribbon", answer(W.ribbon, SEARCH), ribbon_sql(SEARCH)),
    ("l6_summary", answer(lambda d, s, v: W.summary(s, v), SEARCH), summary_sql(SEARCH)),
    ("l7_report_header", lambda spark, sf: R.header(files(spark, sf), "tokens", "after", 3, False), l7_sql()),
    ("l7_one_line_sections", lambda spark, sf: R.one_line_sections(files(spark, sf), "tokens", "after", False), ONE_LINE_SQL),
    ("l8_report_walk", walk_query(3, "repo", "section", "ord", "depth", "label"), "SELECT repo, section, ord, depth, label FROM (" + walk_sql(3) + ")"),
    ("l9_chain_collapse", walk_query(30, "repo", "section", "label", "weight"), "SELECT repo, section, label, weight FROM (" + walk_sql(30) + ")"),
    ("l10_report", walk_query(3), walk_sql(3)),
    ("l11_expandable", answer(lambda d, s, v: W.expandable(s, v), SEARCH), view_sql(SEARCH, f"SELECT s.repo, s.folder FROM subtree s JOIN scopes c USING (repo) WHERE path_count > 0 AND {inside('s.folder', 'c.scope')}")),
    ("l12_weigh_tree", l12, L12_SQL),
    ("l12_weigh_pages", l12_pages, l12_pages_sql()),
]
