"""J, F and the rest of A: two snapshots compared."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import oracle as O
from massmap.functions import fixed_values as V
from massmap.operators import changes as C
from massmap.operators.interning import interned
from massmap.plans import diff as P
from massmap.plans import report as R
from massmap.plans import view as W
from massmap.plans.scan import scan
from massmap.session import written
from massmap.sources import adapters as A
from massmap.sources import corpus as S

EXTENSIONS = [".md", ".py", ".ts", ".css", ".html", ".sql", ".yaml", ".test.js", ".json"]
FOLDERS = ["src", "docs", "lib/core", "dist", "tests"]

REVISIONS = f"""
docs AS (SELECT source AS repo, doc_id, doc_id % 10 AS c, text,
  'part' || (doc_id % 7) || '/' || ({O.array(FOLDERS)})[1 + doc_id % 5] || '/' || doc_id || ({O.array(EXTENSIONS)})[1 + doc_id % 9] AS path FROM documents),
edits AS (SELECT doc_id, u.pos, u.line, CASE WHEN u.pos % 7 = 3 THEN 'drop' WHEN u.pos % 11 = 5 THEN 'edit' ELSE 'keep' END AS op
  FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM docs) d, LATERAL (SELECT unnest(range(0, len(d.l))) AS pos, unnest(d.l) AS line) u),
edited AS (SELECT doc_id, coalesce(string_agg(CASE op WHEN 'edit' THEN line || ' +' ELSE line END, chr(10) ORDER BY pos) FILTER (op <> 'drop'), '') AS text FROM edits GROUP BY doc_id),
before_side AS (SELECT repo, doc_id, path, text FROM docs WHERE c <> 1),
after_side AS (SELECT repo, doc_id, CASE WHEN c = 3 THEN 'moved/' || path ELSE path END AS path, CASE WHEN c IN (1, 3, 4) THEN d.text ELSE e.text END AS text
  FROM docs d JOIN edited e USING (doc_id) WHERE c <> 2),
raw_changes AS (SELECT coalesce(b.repo, a.repo) AS repo, coalesce(b.path, a.path) AS path, b.doc_id AS bid, b.text AS btext, a.text AS atext,
  CASE WHEN b.path IS NULL THEN 'added' WHEN a.path IS NULL THEN 'deleted' ELSE 'modified' END AS status
  FROM before_side b FULL JOIN after_side a ON a.repo = b.repo AND a.path = b.path WHERE b.path IS NULL OR a.path IS NULL OR a.text <> b.text),
numbered AS (SELECT *, row_number() OVER (PARTITION BY repo, status, coalesce(btext, atext) ORDER BY path) AS turn FROM raw_changes WHERE status <> 'modified'),
pairs AS (SELECT a.repo, a.path, d.path AS base_path, d.bid, d.btext, a.atext FROM numbered d JOIN numbered a
  ON a.repo = d.repo AND a.status = 'added' AND d.status = 'deleted' AND a.atext = d.btext AND a.turn = d.turn),
paired AS (
  SELECT repo, path, path AS base_path, status, bid, coalesce(btext, '') AS btext, coalesce(atext, '') AS atext FROM raw_changes r
  WHERE NOT EXISTS (SELECT 1 FROM pairs p WHERE p.repo = r.repo AND ((r.status = 'added' AND p.path = r.path) OR (r.status = 'deleted' AND p.base_path = r.path)))
  UNION ALL SELECT repo, path, base_path, 'renamed', bid, btext, atext FROM pairs),
changes AS (SELECT *, row_number() OVER () AS cid FROM paired)"""

SIDE_SYNTAX = "regexp_extract(path, '(\\.[a-z]+)$', 1)"
SYNTAX_OF = "CASE " + SIDE_SYNTAX + " WHEN '.py' THEN 'python' WHEN '.ts' THEN 'typescript' WHEN '.js' THEN 'javascript' WHEN '.css' THEN 'c_block' WHEN '.html' THEN 'markup' WHEN '.sql' THEN 'sql' WHEN '.yaml' THEN 'hash' END"

DIFFED = f"""{REVISIONS},
sides AS (SELECT cid * 2 AS sid, btext AS text, {SYNTAX_OF.replace('path', 'base_path')} AS syntax FROM changes
  UNION ALL SELECT cid * 2 + 1, atext, {SYNTAX_OF} FROM changes),
{O.verdicts_cte('sides', 'sid')},
lined AS (SELECT v.sid // 2 AS cid, v.sid % 2 = 1 AS is_after, v.n, v.verdict, l.line FROM verdicts v JOIN verdicts_lines l ON l.sid = v.sid AND l.n = v.n),
kept_edits AS (SELECT doc_id, op, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS n FROM edits WHERE op <> 'drop'),
touched AS (
  SELECT l.* FROM lined l JOIN changes c USING (cid) WHERE (c.status = 'deleted' AND NOT is_after) OR (c.status = 'added' AND is_after)
  UNION ALL SELECT l.* FROM lined l JOIN changes c USING (cid) JOIN edits e ON e.doc_id = c.bid AND e.pos = l.n - 1 AND e.op <> 'keep' WHERE c.status = 'modified' AND NOT is_after
  UNION ALL SELECT l.* FROM lined l JOIN changes c USING (cid) JOIN kept_edits k ON k.doc_id = c.bid AND k.n = l.n AND k.op = 'edit' WHERE c.status = 'modified' AND is_after),
side_totals AS (SELECT cid, count(*) FILTER (is_after AND verdict = 'c') AS code_lines, count(*) FILTER (is_after AND verdict = 'm') AS comment_lines,
  count(*) FILTER (is_after AND verdict = 'b') AS blank_lines, count(*) FILTER (NOT is_after AND verdict <> 'b') AS before_lines,
  count(*) FILTER (NOT is_after AND verdict = 'c') AS before_code_lines FROM lined GROUP BY cid),
touched_totals AS (SELECT cid, {", ".join(
    f"count(*) FILTER ({side} AND verdict = '{v}') AS {name}_{what}" for side, name in (("is_after", "added"), ("NOT is_after", "removed")) for v, what in (("c", "code_lines"), ("m", "comment_lines")))},
  count(*) FILTER (is_after) AS added_physical_lines, count(*) FILTER (NOT is_after) AS removed_physical_lines,
  {O.tokens("coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (is_after), '')")} AS added_tokens,
  {O.tokens("coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (NOT is_after), '')")} AS removed_tokens FROM touched GROUP BY cid),
corpus AS (SELECT repo, cid AS doc_id, path, CASE WHEN atext <> '' THEN atext ELSE btext END AS text FROM changes),
{O.PARTS.lstrip()},
judged AS (SELECT doc_id AS cid, {O.KIND.replace('locale_copy', 'false')} AS kind, {O.GENERATED_BY_PATH} OR {O.GENERATED_BY_CONTENT} AS generated FROM named),
diffed AS (SELECT c.repo, c.path, c.status, CASE WHEN c.status = 'renamed' THEN c.base_path END AS previous_path, j.kind, j.generated,
  {O.tokens('c.atext')} AS tokens, {O.tokens('c.btext')} AS before_tokens,
  {", ".join(f"coalesce({n}, 0)::BIGINT AS {n}" for n in ("code_lines", "comment_lines", "blank_lines", "before_lines", "before_code_lines", "added_code_lines", "added_comment_lines", "removed_code_lines", "removed_comment_lines", "added_physical_lines", "removed_physical_lines", "added_tokens", "removed_tokens"))},
  (coalesce(code_lines, 0) + coalesce(comment_lines, 0))::BIGINT AS lines,
  (coalesce(added_code_lines, 0) + coalesce(added_comment_lines, 0))::BIGINT AS added_lines,
  (coalesce(removed_code_lines, 0) + coalesce(removed_comment_lines, 0))::BIGINT AS removed_lines
  FROM changes c JOIN judged j USING (cid) LEFT JOIN side_totals USING (cid) LEFT JOIN touched_totals USING (cid))"""

PLAIN = ["repo", "path", "status", "previous_path", "kind", "generated"]
COUNTS = ["tokens", "before_tokens", "lines", "code_lines", "comment_lines", "blank_lines", "before_lines", "before_code_lines",
          "added_tokens", "removed_tokens", "added_lines", "removed_lines", "added_code_lines", "removed_code_lines",
          "added_comment_lines", "removed_comment_lines", "added_physical_lines", "removed_physical_lines"]

_DIFFS: dict[tuple[str, str], str] = {}


def diff_rows(spark, sf):
    """The comparison, measured once per session and saved as an index is."""
    from catalog.sources import place

    key = (spark.sparkContext.applicationId, sf)
    if key not in _DIFFS:
        home = place(spark, "diff")
        P.diff(*A.revisions(spark, sf)).write.parquet(home)
        _DIFFS[key] = home
    return S.load_index(spark, _DIFFS[key])


def columns(*names):
    return lambda spark, sf: diff_rows(spark, sf).select(*names)


def columns_sql(*names):
    return O.with_ctes(DIFFED, f"SELECT {', '.join(names)} FROM diffed")


def j9(spark, sf):
    rows = P.diff(*A.revisions(spark, sf))
    nets = [f"{s}_{m}" for s in ("churn", "net") for m in ("tokens", "lines", "code_lines")]
    return rows.select(*PLAIN, *COUNTS, *nets)


J9_SQL = O.with_ctes(DIFFED, f"SELECT {', '.join(PLAIN + COUNTS)}, " + ", ".join(
    f"added_{m} {sign} removed_{m} AS {name}_{m}" for name, sign in (("churn", "+"), ("net", "-")) for m in ("tokens", "lines", "code_lines")) + " FROM diffed")


def changed(spark, sf):
    return C.changed_paths(*A.revisions(spark, sf))


def a12(spark, sf):
    """Pages nobody committed, beside the changes of the documents."""
    changes = changed(spark, sf)
    loose = A.page_files(spark, sf).select(F.lit("src0").alias("repo"), "path", F.lit(None).cast("string").alias("mode"), F.col("text").cast("binary").alias("content"))
    return C.with_untracked(changes, loose).select("repo", "path", "status", "after_blob")


def a12_sql() -> str:
    from catalog.classify import PAGE_FILES

    return O.with_ctes(f"{REVISIONS},{PAGE_FILES}", """SELECT repo, path, status, CASE WHEN status <> 'deleted' THEN sha256(atext) END AS after_blob FROM raw_changes
      UNION ALL SELECT 'src0', path, 'added', sha256(text) FROM page_files""")


def pairs_of_lines(spark, sf):
    """Both line arrays of every changed file."""
    from massmap.functions.lines import split_lines

    before, after = A.revisions(spark, sf)
    texts = P.changed_texts(C.changed_paths(before, after), before, after)
    return written(texts.select("repo", "path", "status", split_lines(F.col("before_text")).alias("before_line_texts"),
                                split_lines(F.col("after_text")).alias("after_line_texts")), "lines")


LINE_PAIRS = f"""{REVISIONS}, line_pairs AS (SELECT repo, path, status, {O.split_lines("coalesce(btext, '')").replace("coalesce(btext, '')[-1]", "right(coalesce(btext, ''), 1)")} AS b,
  {O.split_lines("coalesce(atext, '')").replace("coalesce(atext, '')[-1]", "right(coalesce(atext, ''), 1)")} AS a FROM raw_changes),
heads AS (SELECT *, coalesce(list_min(list_filter(range(1, greatest(len(a), len(b)) + 1), lambda i: a[i] IS DISTINCT FROM b[i])) - 1, len(b)) AS head FROM line_pairs),
ends AS (SELECT *, coalesce(list_min(list_filter(range(1, greatest(len(a), len(b)) - head + 1),
    lambda i: CASE WHEN i > len(a) - head OR i > len(b) - head THEN true ELSE a[-i] IS DISTINCT FROM b[-i] END)) - 1, len(b) - head) AS tail FROM heads)"""


def j1(spark, sf):
    return C.with_common_ends(pairs_of_lines(spark, sf)).select("repo", "path", "head", "tail")


def j2(spark, sf):
    rows = C.with_line_diff(pairs_of_lines(spark, sf), cap=8)
    capped = F.col("capped")
    return rows.select("repo", "path", "capped", F.when(capped, F.size("removed")).alias("removed"), F.when(capped, F.size("added")).alias("added"))


def j3(spark, sf):
    return C.with_line_diff(pairs_of_lines(spark, sf)).select("repo", "path", F.size("removed").alias("removed"), F.size("added").alias("added"))


J3_SQL = O.with_ctes(REVISIONS, """SELECT repo, path, CASE status WHEN 'added' THEN 0 WHEN 'deleted' THEN nl ELSE (SELECT count(*) FROM edits e WHERE e.doc_id = r.bid AND op <> 'keep' AND (line <> '' OR pos + 1 < total)) END::INT AS removed,
  CASE status WHEN 'deleted' THEN 0 WHEN 'added' THEN nl ELSE (SELECT count(*) FROM edits e WHERE e.doc_id = r.bid AND op = 'edit') END::INT AS added
FROM (SELECT *, len(string_split(coalesce(btext, ''), chr(10))) AS total, CASE WHEN coalesce(btext, atext) = '' THEN 0 ELSE len(string_split(coalesce(btext, atext), chr(10))) - CASE WHEN right(coalesce(btext, atext), 1) = chr(10) THEN 1 ELSE 0 END END AS nl FROM raw_changes) r""")

J4_SQL = O.with_ctes(LINE_PAIRS, """SELECT repo, path, sum(greatest(s, 0))::BIGINT AS added, sum(greatest(-s, 0))::BIGINT AS removed FROM (
  SELECT repo, path, line, sum(step) AS s FROM (SELECT repo, path, unnest(b) AS line, -1 AS step FROM line_pairs UNION ALL SELECT repo, path, unnest(a), 1 FROM line_pairs) GROUP BY ALL) GROUP BY repo, path""")


def aligned(spark, sf):
    return C.aligned_lines(C.with_line_diff(pairs_of_lines(spark, sf)))


def j6(spark, sf):
    """Each side read back whole from the one alignment."""
    rows = written(aligned(spark, sf), "aligned")
    out = None
    for side in ("before", "after"):
        lines = C.side_of(rows, side).groupBy("repo", "path").agg(F.array_sort(F.collect_list(F.struct("ord", "text"))).alias("l"))
        part = lines.select("repo", "path", F.lit(side).alias("side"), F.md5(F.array_join(F.transform("l", lambda x: x["text"]), "\n").cast("binary")).alias("digest"))
        out = part if out is None else out.unionByName(part)
    return out


J6_SQL = O.with_ctes(LINE_PAIRS, """SELECT repo, path, 'before' AS side, md5(array_to_string(b, chr(10))) AS digest FROM line_pairs WHERE len(b) > 0
  UNION ALL SELECT repo, path, 'after', md5(array_to_string(a, chr(10))) FROM line_pairs WHERE len(a) > 0""")


def f6(spark, sf):
    """Lines of both sides as numbers, and the same alignment worked out on numbers alone."""
    ids = written(interned(pairs_of_lines(spark, sf)), "ids")
    aligned = C.with_line_diff(ids, "before_ids", "after_ids")
    told = [F.array_join(c, ",").alias(c) for c in ("before_ids", "after_ids")]
    return aligned.select("repo", "path", "distinct_lines", *told, F.size("removed").alias("removed"), F.size("added").alias("added"))


F6_SQL = O.with_ctes(LINE_PAIRS, """SELECT p.repo, p.path, coalesce(distinct_lines, 0)::BIGINT AS distinct_lines,
  coalesce(before_ids, '') AS before_ids, coalesce(after_ids, '') AS after_ids, j.removed, j.added
FROM line_pairs p LEFT JOIN (SELECT repo, path, count(DISTINCT id) AS distinct_lines, string_agg(id, ',' ORDER BY spot) FILTER (side = 0) AS before_ids,
    string_agg(id, ',' ORDER BY spot) FILTER (side = 1) AS after_ids
  FROM (SELECT repo, path, side, spot, (dense_rank() OVER (PARTITION BY repo, path ORDER BY opened) - 1)::VARCHAR AS id FROM (
    SELECT *, min(side * 1000000000 + spot) OVER (PARTITION BY repo, path, line) AS opened FROM (
      SELECT repo, path, 0 AS side, generate_subscripts(b, 1) AS spot, unnest(b) AS line FROM line_pairs
      UNION ALL SELECT repo, path, 1, generate_subscripts(a, 1), unnest(a) FROM line_pairs)))
  GROUP BY repo, path) i ON i.repo = p.repo AND i.path = p.path
JOIN (""" + J3_SQL + """) j ON j.repo = p.repo AND j.path = p.path""")


def marked_lines(spark, sf):
    """Document lines as an aligned listing: every 17th and 23rd line is a change."""
    from massmap.functions.lines import split_lines

    lines = A.table(spark, sf, "documents").select(F.col("source").alias("repo"), F.col("doc_id").cast("string").alias("path"),
                                                   F.posexplode(split_lines(F.col("text"))).alias("ord", "text"))
    marker = F.when(F.col("ord") % 17 == 5, "-").when(F.col("ord") % 23 == 7, "+").otherwise(" ")
    return lines.withColumn("marker", marker)


MARKED_LINES = f"""marked_lines AS (SELECT repo, path, u.ord, u.text, CASE WHEN u.ord % 17 = 5 THEN '-' WHEN u.ord % 23 = 7 THEN '+' ELSE ' ' END AS marker
  FROM (SELECT source AS repo, doc_id::VARCHAR AS path, {O.split_lines('text')} AS l FROM documents) d, LATERAL (SELECT unnest(range(0, len(d.l)))::INT AS ord, unnest(d.l) AS text) u)"""

G9_SQL = f"""WITH {MARKED_LINES}, n AS (SELECT *, max(CASE WHEN marker <> ' ' THEN 1 ELSE 0 END) OVER (PARTITION BY repo, path ORDER BY ord ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS near FROM marked_lines),
r AS (SELECT *, ord - row_number() OVER (PARTITION BY repo, path, near ORDER BY ord) AS run FROM n)
SELECT repo, path, ord, marker, text, 0::BIGINT AS hidden FROM r WHERE near = 1
UNION ALL SELECT repo, path, min(ord), 'gap', NULL, count(*) FROM r WHERE near = 0 GROUP BY repo, path, run"""

G10_SQL = f"""WITH {MARKED_LINES} SELECT * FROM (SELECT repo, path, ord, marker, sum(strlen(text) + 1) OVER (PARTITION BY repo, path ORDER BY ord ROWS UNBOUNDED PRECEDING)::BIGINT AS bytes FROM marked_lines) WHERE bytes <= 3000"""


def g11(spark, sf):
    return aligned(spark, sf).groupBy("repo", "path").agg(F.max("before_line").alias("before_lines"), F.max("after_line").alias("after_lines"), F.count("*").alias("printed"))


G11_SQL = O.with_ctes(LINE_PAIRS, "SELECT p.repo, p.path, nullif(len(b), 0)::INT AS before_lines, nullif(len(a), 0)::INT AS after_lines, (len(b) + j.added)::BIGINT AS printed "
                      "FROM line_pairs p JOIN (" + J3_SQL + ") j ON j.repo = p.repo AND j.path = p.path")


def d13(spark, sf):
    rows = diff_rows(spark, sf)
    return rows.groupBy("repo").agg(*[F.count_if(F.col("status") == s).alias(s) for s in C.STATUSES], F.count_if("capped").alias("capped"),
                                    F.count_if(F.col("measurement") == "too-large").alias("too_large"))


def j11(spark, sf):
    before, after = A.revisions(spark, sf)
    out = None
    for side, rows in (("before", before), ("after", after)):
        part = scan(rows).groupBy("repo").agg(F.count("*").alias("files"), F.sum("tokens").alias("tokens")).withColumn("side", F.lit(side))
        out = part if out is None else out.unionByName(part)
    return out


NET = W.View(is_diff=True, aspect="net", metric="net", show_generated=True, expanded=("", "part1", "moved")).settled()


def net_view(build):
    def run(spark, sf):
        direct = written(W.direct_frame(diff_rows(spark, sf), NET), "folders")
        return build(direct, written(W.subtree_frame(direct, NET), "subtrees"))

    return run


NET_SUMS = f"""{DIFFED}, net_folders AS (SELECT repo, folder, sum(added_tokens - removed_tokens)::BIGINT AS weight, sum(added_tokens)::BIGINT AS added, sum(removed_tokens)::BIGINT AS removed, count(*) AS files,
  {", ".join(f"coalesce(sum(abs(added_tokens - removed_tokens)) FILTER (CASE WHEN generated THEN 'generated' ELSE kind END = '{f}'), 0)::BIGINT AS flavor_{f}" for f in V.FLAVORS)}
  FROM (SELECT *, unnest({O.folders_above('path')}) AS folder FROM diffed) GROUP BY repo, folder)"""


def l10_diff(spark, sf):
    return R.walk(diff_rows(spark, sf), "tokens", "churn", 5, True).groupBy("repo", "section").agg(F.count("*").alias("rows"), F.max("depth").alias("deepest"))


def f1_similar(spark, sf):
    """The moved documents again, this time edited on the way: only their likeness tells."""
    before, after = A.revisions(spark, sf)
    text = F.concat(F.col("content").cast("string"), F.lit("\nmoved"))
    moved = F.col("path").startswith("moved/")
    edited = after.withColumn("content", F.when(moved, text.cast("binary")).otherwise(F.col("content")))
    changes = C.with_renames(C.changed_paths(before, edited))
    return C.with_similar_renames(written(changes, "changes"), before, edited).select("repo", "path", "base_path", "status")


ENTRIES = [
    ("f6_interned_lines", f6, F6_SQL),
    ("f1_similar_renames", f1_similar, None),
    ("a11_changed_paths", lambda spark, sf: changed(spark, sf).select("repo", "path", "status", "before_mode", "after_mode"),
     O.with_ctes(REVISIONS, "SELECT repo, path, status, CASE WHEN status <> 'added' THEN '100644' END AS before_mode, CASE WHEN status <> 'deleted' THEN '100644' END AS after_mode FROM raw_changes")),
    ("a12_untracked", a12, a12_sql()),
    ("d13_status_counts", d13, O.with_ctes(REVISIONS, "SELECT repo, " + ", ".join(f"count(*) FILTER (status = '{s}') AS {s}" for s in C.STATUSES) + ", 0::BIGINT AS capped, 0::BIGINT AS too_large FROM changes GROUP BY repo")),
    ("d20_touched_buckets", columns("repo", "path", "added_lines", "added_code_lines", "added_comment_lines"), columns_sql("repo", "path", "added_lines", "added_code_lines", "added_comment_lines")),
    ("f1_exact_renames", lambda spark, sf: C.with_renames(changed(spark, sf)).select("repo", "path", "base_path", "status"), O.with_ctes(REVISIONS, "SELECT repo, path, base_path, status FROM changes")),
    ("f2_snapshots_by_path", lambda spark, sf: changed(spark, sf).groupBy("repo", "status").agg(F.count("*").alias("paths")), O.with_ctes(REVISIONS, "SELECT repo, status, count(*) AS paths FROM raw_changes GROUP BY ALL")),
    ("g9_folded_context", lambda spark, sf: C.folded(marked_lines(spark, sf)), G9_SQL),
    ("g10_byte_ceiling", lambda spark, sf: S.cut_lines(marked_lines(spark, sf), limit=3000).select("repo", "path", "ord", "marker", "bytes"), G10_SQL),
    ("g11_line_numbers", g11, G11_SQL),
    ("j1_common_ends", j1, O.with_ctes(LINE_PAIRS, "SELECT repo, path, head::INT AS head, tail::INT AS tail FROM ends")),
    ("j2_capped_regions", j2, O.with_ctes(LINE_PAIRS, """SELECT repo, path, capped, CASE WHEN capped THEN o END::INT AS removed, CASE WHEN capped THEN i END::INT AS added FROM (
      SELECT *, o + i > 8 AS capped FROM (SELECT repo, path, len(b) - head - tail AS o, len(a) - head - tail AS i FROM ends))""")),
    ("j3_minimal_counts", j3, J3_SQL),
    ("j4_multiset_diff", lambda spark, sf: C.multiset_diff(pairs_of_lines(spark, sf)), J4_SQL),
    ("j5_aligned_lines", aligned, None),
    ("j6_sides_of_alignment", j6, J6_SQL),
    ("j7_touched_verdicts", columns("repo", "path", "removed_lines", "removed_code_lines", "removed_comment_lines"), columns_sql("repo", "path", "removed_lines", "removed_code_lines", "removed_comment_lines")),
    ("j8_touched_tokens", columns("repo", "path", "added_tokens", "removed_tokens"), columns_sql("repo", "path", "added_tokens", "removed_tokens")),
    ("j9_changed_files", j9, J9_SQL),
    ("j10_renamed_rows", lambda spark, sf: diff_rows(spark, sf).where("status = 'renamed'").select("repo", "path", "previous_path", "tokens", "before_tokens", "churn_tokens"),
     O.with_ctes(DIFFED, "SELECT repo, path, previous_path, tokens, before_tokens, added_tokens + removed_tokens AS churn_tokens FROM diffed WHERE status = 'renamed'")),
    ("j11_review_sides", j11, O.with_ctes(REVISIONS, f"""SELECT repo, 'before' AS side, count(*) AS files, sum({O.tokens('text')})::BIGINT AS tokens FROM before_side GROUP BY repo
      UNION ALL SELECT repo, 'after', count(*), sum({O.tokens('text')})::BIGINT FROM after_side GROUP BY repo""")),
    ("l1_net_summary", net_view(lambda d, s: W.summary(s, NET).select("repo", "selected_weight", "selected_added", "selected_removed", "selected_files", "project_weight")),
     O.with_ctes(NET_SUMS, "SELECT repo, weight AS selected_weight, added AS selected_added, removed AS selected_removed, files AS selected_files, added + removed AS project_weight FROM net_folders WHERE folder = ''")),
    ("l5_net_ribbon", net_view(lambda d, s: W.ribbon(d, s, NET).select("repo", "name", "weight", "share_of_scope")),
     O.with_ctes(NET_SUMS, """SELECT f.repo, f.folder AS name, f.weight, CASE WHEN r.added + r.removed > 0 THEN least(1.0, abs(f.weight)::DOUBLE / (r.added + r.removed)) ELSE 0.0 END AS share_of_scope
       FROM net_folders f JOIN net_folders r ON r.repo = f.repo AND r.folder = '' WHERE f.folder <> '' AND NOT contains(f.folder, '/') AND f.weight <> 0""")),
    ("l10_comparison_report", l10_diff, None),
]
