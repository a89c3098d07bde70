"""A: reading, admitting, saving and previewing files."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from catalog import oracle as O
from massmap.functions import fixed_values as V
from massmap.functions import lines as L
from massmap.functions import text as T
from massmap.operators import admission as D
from massmap.operators import hierarchy as H
from massmap.plans.scan import scan
from massmap.session import shared_folder
from massmap.sources import adapters as A
from massmap.sources import corpus as S
from massmap.sources.digests import with_digest
from massmap.streaming import rescan as M


def place(spark, label):
    return f"{shared_folder(spark)}/massmap-{label}-{uuid.uuid4().hex}"


def a1(spark, sf):
    """The folder of tables itself, read as a tree of files."""
    tree = S.read_tree(spark, sf, "tables", located=True)
    return with_digest(tree).select("repo", "path", "size", "blob")


def a2(spark, sf):
    rows = S.revision(A.commit_snapshots(spark, sf))
    return rows.groupBy("repo", "rev").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))


A2_SQL = """WITH s AS (SELECT conv_id::VARCHAR AS repo, conv_id || ':' || (turn + shift) AS rev, strlen(text) AS size
  FROM conversations, (VALUES (0), (0), (0), (1)) p(shift)) SELECT repo, rev, count(*) AS files, sum(size)::BIGINT AS bytes FROM s GROUP BY ALL"""


def a2_newest(spark, sf):
    """The listing of every conversation's last commit."""
    turns = A.table(spark, sf, "conversations").groupBy("conv_id").agg(F.max("turn").alias("turn"))
    heads = turns.select(F.col("conv_id").cast("string").alias("repo"), F.concat("conv_id", F.lit(":"), "turn").alias("rev"))
    return S.revisions(A.commit_snapshots(spark, sf), heads).select("repo", "rev", "path", "size")


A2_NEWEST_SQL = """WITH last AS (SELECT conv_id, max(turn) AS head FROM conversations GROUP BY conv_id)
SELECT conv_id::VARCHAR AS repo, conv_id || ':' || head AS rev, unnest(CASE WHEN turn = head THEN ['turns/' || turn || '.md', 'notes.md', 'dist/notes.md']
  ELSE ['turns/' || turn || '.md'] END) AS path, strlen(text) AS size FROM conversations JOIN last USING (conv_id) WHERE turn >= head - 1"""


def listing(spark, sf):
    return A.corpus(spark, sf).select("repo", "path")


def a4(spark, sf):
    rows = listing(spark, sf)
    reason = F.when(D.in_folder_named(F.col("path"), ["docs", "app"]), "excluded")
    return rows.withColumn("reason", reason)


def a5(spark, sf):
    return D.outside_exports(listing(spark, sf), marker="LICENSE")


A5_SQL = O.with_ctes(f"{O.CORPUS},{O.PARTS}", """SELECT repo, path FROM named n WHERE NOT EXISTS (SELECT 1 FROM named m WHERE m.repo = n.repo AND m.name = 'LICENSE'
  AND (m.folder = '' OR starts_with(n.path, m.folder || '/')))""")

IGNORE = "# rules\n*.MD\n!README.md\n/m0/dist/\nCoverage/\ntests/*.py\n**/fixtures/**\n"
INNER = "*.json\n!config.json\n/APP/core\n*.sql\n!SCHEMA.*\n*.vue\n!page.*\n*.V?E\n"


def ignore_files(spark, sf):
    repos = A.table(spark, sf, "documents").select(F.col("source").alias("repo")).distinct()
    outer = repos.select("repo", F.lit(".gitignore").alias("path"), F.lit(IGNORE).alias("text"))
    return outer.unionByName(repos.select("repo", F.lit("m0/src/.gitignore").alias("path"), F.lit(INNER).alias("text")))


def a6(spark, sf):
    return D.ignored(listing(spark, sf), D.ignore_rules(ignore_files(spark, sf)))


A6_SQL = O.with_ctes(f"{O.CORPUS},{O.PARTS}", r"""SELECT repo, path FROM named WHERE
  (regexp_matches(name, '\.md$') AND name <> 'README.md') OR starts_with(path, 'm0/dist/') OR regexp_matches(path, '(^|/)coverage/')
  OR regexp_matches(path, '^tests/[^/]*\.py$') OR regexp_matches(path, '(^|/)fixtures/')
  OR (starts_with(path, 'm0/src/') AND regexp_matches(name, '\.json$') AND name <> 'config.json') OR starts_with(path, 'm0/src/app/core/')
  OR (starts_with(path, 'm0/src/') AND name = 'page.vue')""")


def a7(spark, sf):
    documents = A.table(spark, sf, "documents")
    return S.distinct_listing(documents.select(F.col("source").alias("repo"), F.concat_ws("/", "lang", F.concat("source", F.lit(".txt"))).alias("path")))


def a8(spark, sf):
    rows = A.byte_snapshots(spark, sf).where("content IS NOT NULL").withColumn("read", T.decoded(F.col("content")))
    return rows.select("doc_id", F.col("read.reason").alias("reason"), F.md5(F.col("read.text").cast("binary")).alias("digest"))


A8_SQL = O.with_ctes(O.CORPUS, """SELECT doc_id, CASE WHEN doc_id % 11 IN (4, 6) THEN 'binary' WHEN doc_id % 11 = 5 THEN 'unsupported-encoding' END AS reason,
  CASE WHEN doc_id % 11 NOT IN (4, 5, 6) THEN md5(text) END AS digest FROM corpus WHERE doc_id % 11 <> 7""")


def a9(spark, sf):
    return D.admit(A.byte_snapshots(spark, sf), ("config",)).select("doc_id", "path", "measurement")


def a10(spark, sf):
    rows = D.admit(A.byte_snapshots(spark, sf), (), 2000)
    return rows.groupBy("repo", "measurement").agg(F.count("*").alias("files"))


A10_SQL = O.with_ctes(O.CORPUS, r"""SELECT repo, measurement, count(*) AS files FROM (SELECT repo, CASE WHEN doc_id % 7 = 3 THEN 'symlink' WHEN doc_id % 7 = 5 THEN 'submodule'
  WHEN doc_id % 11 = 7 THEN 'unreadable' WHEN size > 2000 THEN 'too-large' WHEN doc_id % 11 IN (4, 6) THEN 'binary' WHEN doc_id % 11 = 5 THEN 'unsupported-encoding' ELSE 'measured' END AS measurement
  FROM (SELECT *, CASE doc_id % 11 WHEN 1 THEN 2 + 2 * {u} WHEN 2 THEN 2 + 2 * {u} WHEN 3 THEN 3 + strlen(text) WHEN 4 THEN 1 + strlen(text)
    WHEN 5 THEN 2 + strlen(text) WHEN 6 THEN 1 + strlen(text) ELSE strlen(text) END AS size FROM corpus)) GROUP BY ALL""".replace("{u}", O.utf16("text")))


def a13(spark, sf):
    """Save the index, read it back, and roll it up: derived tables are rebuilt, not stored."""
    home = place(spark, "saved")
    S.save_index(scan(A.byte_snapshots(spark, sf), exclude=("config",)), home)
    back = S.load_index(spark, home)
    return H.weigh_tree(back.where("measurement = 'measured'"), "path", ["tokens", "lines"], None, ["repo"])


A13_SQL = O.with_ctes(O.SCANNED, f"""SELECT repo, folder, count(*) AS files, sum(tokens)::BIGINT AS tokens, sum(lines)::BIGINT AS lines, count(*) FILTER (own = folder) AS direct_files,
  coalesce(sum(tokens) FILTER (own = folder), 0)::BIGINT AS direct_tokens, coalesce(sum(lines) FILTER (own = folder), 0)::BIGINT AS direct_lines
  FROM (SELECT repo, tokens, lines, folder AS own, unnest({O.folders_above('path')}) AS folder FROM rows WHERE is_measured) GROUP BY repo, folder""")


def a14(spark, sf):
    from catalog.commits import spine
    from catalog.views import files

    home = place(spark, "export")
    index = files(spark, sf)
    texts = D.admit(A.byte_snapshots(spark, sf), ("config",))
    S.export_snapshot(home, index, H.folders(index), spine(spark, sf), S.previews(texts))
    counts = [spark.read.parquet(f"{home}/{name}").groupBy("repo").agg(F.count("*").alias("rows")).withColumn("part", F.lit(name)) for name in ("files", "folders", "sources", "spine")]
    return counts[0].unionByName(counts[1]).unionByName(counts[2]).unionByName(counts[3])


A14_SQL = O.with_ctes(O.CORPUS, f"""SELECT repo, count(*) AS rows, 'files' AS part FROM corpus GROUP BY repo
UNION ALL SELECT repo, count(*), 'sources' FROM corpus GROUP BY repo
UNION ALL SELECT repo, count(DISTINCT folder), 'folders' FROM (SELECT repo, unnest({O.folders_above('path')}) AS folder FROM corpus) GROUP BY repo
UNION ALL SELECT conv_id::VARCHAR, count(*), 'spine' FROM conversations GROUP BY conv_id""")


def a15(spark, sf):
    texts = A.table(spark, sf, "documents").select(F.lit("all").alias("repo"), F.col("doc_id").cast("string").alias("path"), "text", F.lit("measured").alias("measurement"))
    return S.previews(texts, 1001).select("path", "content", "truncated", "total_bytes")


A15_SQL = """SELECT doc_id::VARCHAR AS path, CASE WHEN strlen(text) <= 1001 THEN text ELSE
  (SELECT max_by(substr(text, 1, k), k) FROM (SELECT unnest(range(250, 1002)) AS k) WHERE strlen(substr(text, 1, k)) <= 1001) END AS content,
  strlen(text) > 1001 AS truncated, strlen(text) AS total_bytes FROM documents"""


def a16(spark, sf):
    rows = D.admit(A.byte_snapshots(spark, sf), ("config",)).where("measurement != 'measured'")
    return S.previews(rows).select("repo", "path", "content", "error")


def rescanned(spark, sf):
    """Conversation turns as arriving versions of one file per role; every fifth turn removes the file."""
    # As a pattern the table may be one file or a folder of files; a stream takes no plain file, and a folder's files bear any name.
    versions = spark.readStream.schema(A.table(spark, sf, "conversations").schema).parquet(f"{sf}/conversations.parque[t]")
    named = versions.select(F.col("conv_id").cast("string").alias("repo"), F.concat("role", F.lit(".md")).alias("path"), F.col("turn").alias("version"), "text", (F.col("turn") % 5 == 4).alias("removed"))

    def measure(frame):
        return frame.withColumn("tokens", T.pre_tokens(F.col("text"))).withColumn("lines", F.size(L.split_lines(F.col("text"))).cast("bigint")).drop("text")

    index = place(spark, "rescan")
    query = M.rescan(named, measure, index, place(spark, "progress"))
    query.awaitTermination()
    return index


def m1(spark, sf):
    """The newest version of every file; removed ones are gone."""
    return M.current(spark, rescanned(spark, sf)).select("repo", "path", "version", "tokens", "lines")


def m1_listing(spark, sf):
    """A complete listing of every third conversation names user files only; a later batch removes the others."""
    index = rescanned(spark, sf)
    turns = A.table(spark, sf, "conversations").where(F.col("conv_id") % 3 == 0)
    listed = turns.select(F.col("conv_id").cast("string").alias("repo"), F.concat("role", F.lit(".md")).alias("path"))
    gone = M.removed_paths(M.current(spark, index), listed.where("path = 'user.md'"), listed, 1_000_000)
    M.merge_batch(index)(gone, 1)
    return M.current(spark, index).select("repo", "path", "version", "tokens", "lines")


M1_SQL = f"""SELECT conv_id::VARCHAR AS repo, role || '.md' AS path, turn AS version, {O.tokens('text')} AS tokens, len({O.split_lines('text')})::BIGINT AS lines
FROM conversations c WHERE turn = (SELECT max(turn) FROM conversations d WHERE d.conv_id = c.conv_id AND d.role = c.role)
  AND turn % 5 <> 4"""

ENTRIES = [
    ("a1_read_tree", a1, None),
    ("a2_newest_revisions", a2_newest, A2_NEWEST_SQL),
    ("a2_revisions", a2, A2_SQL),
    ("a3_walkable", lambda spark, sf: D.walkable(listing(spark, sf)),
     O.with_ctes(f"{O.CORPUS},{O.PARTS}", f"SELECT repo, path FROM named WHERE NOT list_has_any(string_split(path, '/')[1:-2], {O.array(V.SKIPPED_FOLDERS)})")),
    ("a4_excluded_folders", a4, O.with_ctes(O.CORPUS, "SELECT repo, path, CASE WHEN list_has_any(string_split(path, '/')[1:-2], ['docs', 'app']) THEN 'excluded' END AS reason FROM corpus")),
    ("a5_export_markers", a5, A5_SQL),
    ("a6_ignored", a6, A6_SQL),
    ("a7_distinct_listing", a7, "SELECT DISTINCT source AS repo, lang || '/' || source || '.txt' AS path FROM documents"),
    ("a8_decoded", a8, A8_SQL),
    ("a9_measurement", a9, O.with_ctes(f"{O.CORPUS},{O.ADMISSION}", "SELECT doc_id, path, measurement FROM admission JOIN corpus USING (doc_id)")),
    ("a10_size_ceiling", a10, A10_SQL),
    ("a13_saved_index", a13, A13_SQL),
    ("a14_export", a14, A14_SQL),
    ("a15_previews", a15, A15_SQL),
    ("a16_unmeasured_previews", a16, O.with_ctes(f"{O.CORPUS},{O.ADMISSION}", "SELECT repo, path, NULL::VARCHAR AS content, 'file is ' || measurement AS error FROM admission JOIN corpus USING (doc_id) WHERE measurement <> 'measured'")),
    ("i3_candidates_less_refused", lambda spark, sf: D.outside_exports(
        listing(spark, sf).where(~D.in_folder_named(F.col("path"), ["docs"])), listing(spark, sf), "LICENSE"),
     A5_SQL + " AND NOT list_contains(string_split(path, '/')[1:-2], 'docs')"),
    ("m1_rescan", m1, M1_SQL),
    ("m1_complete_listing", m1_listing, M1_SQL + " AND (conv_id % 3 <> 0 OR role = 'user')"),
]
