"""K, D11, D12, G6 to G8, H6, H7: commit histories."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import oracle as O
from massmap.functions import fixed_values as V
from massmap.operators import commits as C
from massmap.plans import spine as P
from massmap.session import written
from massmap.sources import adapters as A


def branched(spark, sf):
    """Conversation turns as a history with side lines: 2 leaves from 0, 3 merges 2 and 1, and so on."""
    turn = F.col("turn")
    name = lambda step: F.concat(F.col("conv_id"), F.lit(":"), turn - step)
    parents = (
        F.when(turn == 0, F.array().cast("array<string>"))
        .when(turn % 4 == 2, F.array(name(2)))
        .when(turn % 4 == 3, F.array(name(1), name(2)))
        .otherwise(F.array(name(1)))
    )
    return A.commits(spark, sf).join(
        A.table(spark, sf, "conversations").select(F.concat("conv_id", F.lit(":"), "turn").alias("sha"), parents.alias("p")), "sha"
    ).select("repo", "sha", F.col("p").alias("parents"), "author", "author_date", "message")


BRANCHED = """branched AS (SELECT conv_id::VARCHAR AS repo, conv_id || ':' || turn AS sha, turn, text,
  CASE WHEN turn = 0 THEN [] WHEN turn % 4 = 2 THEN [conv_id || ':' || (turn - 2)] WHEN turn % 4 = 3 THEN [conv_id || ':' || (turn - 1), conv_id || ':' || (turn - 2)]
    ELSE [conv_id || ':' || (turn - 1)] END AS parents FROM conversations),
edges AS (SELECT repo, sha, unnest(parents) AS parent FROM branched),
back AS (SELECT repo, sha AS seed, sha FROM branched UNION SELECT b.repo, b.seed, e.parent FROM back b JOIN edges e ON e.repo = b.repo AND e.sha = b.sha)"""


def tips(spark, sf, remainder=None):
    """The newest turn of each conversation, or the newest of one remainder by four."""
    turns = A.table(spark, sf, "conversations")
    if remainder is not None:
        turns = turns.where(F.col("turn") % 4 == remainder)
    last = turns.groupBy("conv_id").agg(F.max("turn").alias("turn"))
    return last.select(F.col("conv_id").cast("string").alias("repo"), F.concat("conv_id", F.lit(":"), "turn").alias("sha"))


def k1(spark, sf):
    return C.ancestors(branched(spark, sf), tips(spark, sf))


K1_SQL = O.with_ctes(BRANCHED, "SELECT repo, seed, sha FROM back WHERE (repo, seed) IN (SELECT repo, max_by(sha, turn) FROM branched GROUP BY repo)")


def k2(spark, sf):
    return C.merge_base(branched(spark, sf), tips(spark, sf, 1), tips(spark, sf, 2))


TIPS = """tip AS (SELECT repo, turn % 4 AS r, max_by(sha, turn) AS sha FROM branched GROUP BY ALL),
one AS (SELECT b.repo, b.sha FROM back b JOIN tip t ON t.repo = b.repo AND t.sha = b.seed AND t.r = 1),
other AS (SELECT b.repo, b.sha FROM back b JOIN tip t ON t.repo = b.repo AND t.sha = b.seed AND t.r = 2),
common AS (SELECT * FROM one INTERSECT SELECT * FROM other)"""
K2_SQL = O.with_ctes(f"{BRANCHED},{TIPS}", "SELECT repo, sha FROM common c WHERE NOT EXISTS (SELECT 1 FROM edges e JOIN common d ON d.repo = e.repo AND d.sha = e.sha WHERE e.repo = c.repo AND e.parent = c.sha)")


def i5(spark, sf):
    return C.commit_range(branched(spark, sf), tips(spark, sf, 1), tips(spark, sf))


I5_SQL = O.with_ctes(f"{BRANCHED},{TIPS}", """SELECT DISTINCT repo, sha FROM back b WHERE (repo, seed) IN (SELECT repo, max_by(sha, turn) FROM branched GROUP BY repo)
  AND NOT EXISTS (SELECT 1 FROM one o WHERE o.repo = b.repo AND o.sha = b.sha)""")


def listed(spark, sf):
    return C.listed_commits(A.commits(spark, sf))


def spine(spark, sf):
    rows = written(listed(spark, sf), "listed")
    return P.spine(rows, written(P.commit_files(rows, A.commit_snapshots(spark, sf)), "commits"))


def plain_lines(text: str) -> str:
    return f"len(list_filter({O.split_lines(text)}, lambda l: {O.rx('l', '[^' + V.SPACE + ']')}))"


def k4(spark, sf):
    return spine(spark, sf).select("repo", "sha", "ord", "parent", "subject", "files", *P.COUNTS)


# A commit adds its own turn, replaces the notes and drops the turn before the last;
# equal texts of a dropped and an added turn are a rename. Notes lines are compared
# as multisets, which is what a minimal script gives when no kept line moves.
K4_SQL = O.with_ctes(f"""t AS (SELECT conv_id, turn, text FROM conversations),
s AS (SELECT c.conv_id, c.turn, c.text, p.text AS prev, g.text AS gone FROM t c LEFT JOIN t p ON p.conv_id = c.conv_id AND p.turn = c.turn - 1
  LEFT JOIN t g ON g.conv_id = c.conv_id AND g.turn = c.turn - 2),
l AS (SELECT conv_id, turn, line, sum(step) AS step FROM (SELECT conv_id, turn, unnest({O.split_lines('text')}) AS line, 1 AS step FROM s
  UNION ALL SELECT conv_id, turn, unnest({O.split_lines('prev')}), -1 FROM s WHERE prev IS NOT NULL) GROUP BY ALL),
n AS (SELECT conv_id, turn, coalesce(sum(greatest(step, 0)) FILTER ({O.rx('line', '[^' + V.SPACE + ']')}), 0) AS i, coalesce(sum(greatest(-step, 0)) FILTER ({O.rx('line', '[^' + V.SPACE + ']')}), 0) AS o FROM l GROUP BY ALL),
e AS (SELECT conv_id, turn, side, line, spot, row_number() OVER (PARTITION BY conv_id, turn, side, line ORDER BY spot) AS nth
  FROM (SELECT conv_id, turn, 1 AS side, {O.split_lines('text')} AS parts, unnest(range(len(parts))) AS spot, parts[spot + 1] AS line FROM s
    UNION ALL SELECT conv_id, turn, -1, {O.split_lines('prev')} AS parts, unnest(range(len(parts))) AS spot, parts[spot + 1] FROM s WHERE prev IS NOT NULL)),
j AS (SELECT conv_id, turn, side, string_agg(line, chr(10) ORDER BY spot) AS lines
  FROM e LEFT JOIN (SELECT conv_id, turn, -side AS side, line, nth FROM e) o USING (conv_id, turn, side, line, nth) WHERE o.conv_id IS NULL GROUP BY ALL),
k AS (SELECT conv_id, turn, max({O.tokens("lines")}) FILTER (side = 1) AS ti, max({O.tokens("lines")}) FILTER (side = -1) AS tu FROM j GROUP BY ALL),
f AS (SELECT s.*, coalesce(ti, 0) AS ti, coalesce(tu, 0) AS tu, {O.tokens('text')} AS whole, CASE WHEN gone IS NULL THEN 0 ELSE {O.tokens('gone')} END AS dropped, coalesce(gone = text, false) AS moved, coalesce(i, 0) AS i, coalesce(o, 0) AS o, {plain_lines('text')} AS own, CASE WHEN gone IS NULL THEN 0 ELSE {plain_lines('gone')} END AS lost FROM s LEFT JOIN n USING (conv_id, turn) LEFT JOIN k USING (conv_id, turn))""",
    f"""SELECT conv_id::VARCHAR AS repo, conv_id || ':' || turn AS sha, turn::INT AS ord, CASE WHEN turn = 0 THEN '{V.EMPTY_TREE}' ELSE conv_id || ':' || (turn - 1) END AS parent,
  {O.trim("string_split(text, chr(10))[1]")} AS subject, (CASE WHEN prev IS DISTINCT FROM text THEN 1 ELSE 0 END + CASE WHEN moved THEN 1 WHEN gone IS NULL THEN 1 ELSE 2 END)::BIGINT AS files,
  (ti + CASE WHEN moved THEN 0 ELSE whole END)::BIGINT AS added_tokens, (tu + CASE WHEN moved THEN 0 ELSE dropped END)::BIGINT AS removed_tokens,
  (i + CASE WHEN moved THEN 0 ELSE own END)::BIGINT AS added_lines, (o + CASE WHEN moved THEN 0 ELSE lost END)::BIGINT AS removed_lines,
  (i + CASE WHEN moved THEN 0 ELSE own END)::BIGINT AS added_code_lines, (o + CASE WHEN moved THEN 0 ELSE lost END)::BIGINT AS removed_code_lines FROM f""")


def with_working_tree(spark, sf):
    """Two of three conversations have uncommitted work: their last turn written again."""
    rows = listed(spark, sf)
    head = rows.groupBy("repo").agg(F.max_by("sha", "ord").alias("sha"))
    loose = head.where(F.col("repo").cast("bigint") % 3 != 0).select(
        "repo", F.lit("measured").alias("measurement"), F.lit(False).alias("generated"), *[F.lit(1).cast("bigint").alias(c) for c in P.COUNTS])
    totals = rows.select("repo", "sha", F.lit("measured").alias("measurement"), F.lit(False).alias("generated"), *[F.lit(2).cast("bigint").alias(c) for c in P.COUNTS])
    return P.spine(rows, totals, loose).select("repo", "ord", "kind", "sha", "parent", "files", "added_tokens")


I1_SQL = f"""SELECT conv_id::VARCHAR AS repo, turn::INT AS ord, 'commit' AS kind, conv_id || ':' || turn AS sha, CASE WHEN turn = 0 THEN '{V.EMPTY_TREE}' ELSE conv_id || ':' || (turn - 1) END AS parent, 1::BIGINT AS files, 2::BIGINT AS added_tokens FROM conversations
UNION ALL SELECT conv_id::VARCHAR, (max(turn) + 1)::INT, 'workingTree', NULL, conv_id || ':' || max(turn), 1, 1 FROM conversations WHERE conv_id % 3 <> 0 GROUP BY conv_id"""


def broken(spark, sf):
    """A listed range where every fourth entry follows another line of history."""
    rows = listed(spark, sf)
    return rows.withColumn("parent", F.when(F.col("ord") % 4 == 3, F.concat(F.lit("x"), F.col("parent"))).otherwise(F.col("parent")))


def spans(spark, sf):
    rows = broken(spark, sf).groupBy("repo").agg(F.max("ord").alias("last"))
    return rows.select("repo", F.explode(F.sequence(F.lit(0), F.col("last"))).alias("start"), "last").select(
        "repo", "start", F.least(F.col("start") + 1, F.col("last")).alias("end"))


LISTED = f"""listed AS (SELECT conv_id::VARCHAR AS repo, turn::INT AS ord, conv_id || ':' || turn AS sha, CASE WHEN turn % 4 = 3 THEN 'x' ELSE '' END || CASE WHEN turn = 0 THEN '{V.EMPTY_TREE}' ELSE conv_id || ':' || (turn - 1) END AS parent,
  CASE WHEN turn = 0 OR turn % 4 = 3 THEN 1 ELSE 0 END AS starts FROM conversations),
runs AS (SELECT *, (sum(starts) OVER (PARTITION BY repo ORDER BY ord))::INT AS run, max(ord) OVER (PARTITION BY repo) AS last FROM listed),
spans AS (SELECT repo, ord AS start, least(ord + 1, last) AS "end" FROM runs)"""


def g7(spark, sf):
    return C.slid(spans(spark, sf), broken(spark, sf), 1)


G7_SQL = f"""WITH {LISTED} SELECT s.repo, s.start, s."end", CASE WHEN a.run = b.run THEN s.start + 1 END AS new_start, CASE WHEN a.run = b.run THEN s."end" + 1 END AS new_end
FROM spans s LEFT JOIN runs a ON a.repo = s.repo AND a.ord = s.start + 1 LEFT JOIN runs b ON b.repo = s.repo AND b.ord = s."end" + 1"""


def g8(spark, sf):
    rows = broken(spark, sf)
    last = rows.groupBy("repo").agg(F.max("ord").alias("last"))
    anchors = rows.join(last, "repo").select("repo", F.col("ord").alias("anchor"), (F.col("last") - F.col("ord")).alias("reached"))
    return C.extended(anchors, rows)


G8_SQL = f"""WITH {LISTED}, bounds AS (SELECT repo, run, min(ord) AS first, max(ord) AS final FROM runs GROUP BY ALL)
SELECT repo, ord AS anchor, last - ord AS reached, least(ord, greatest(first, least(final, last - ord))) AS start, greatest(ord, greatest(first, least(final, last - ord))) AS "end"
FROM runs JOIN bounds USING (repo, run)"""


def k6(spark, sf):
    rows = broken(spark, sf)
    whole = rows.groupBy("repo").agg(F.min_by("parent", "ord").alias("base"), F.max_by("sha", "ord").alias("target"))
    return C.spans_of(C.comparisons_of(spans(spark, sf), rows).select("repo", "base", "target"), rows, whole)


K6_SQL = f"""WITH {LISTED}, asked AS (SELECT s.repo, a.parent AS base, b.sha AS target FROM spans s JOIN runs a ON a.repo = s.repo AND a.ord = s.start JOIN runs b ON b.repo = s.repo AND b.ord = s."end")
SELECT q.repo, q.base, q.target, a.ord AS start, b.ord AS "end" FROM asked q JOIN runs a ON a.repo = q.repo AND a.parent = q.base JOIN runs b ON b.repo = q.repo AND b.sha = q.target WHERE a.ord <= b.ord AND a.run = b.run
  AND NOT EXISTS (SELECT 1 FROM runs f JOIN runs l ON l.repo = f.repo WHERE f.repo = q.repo AND f.ord = 0 AND l.ord = l.last AND f.parent = q.base AND l.sha = q.target)"""


def h6(spark, sf):
    turns = A.table(spark, sf, "conversations")
    forms = F.array(*[F.concat(F.lit(p), "turn") for p in ("refs/heads/b", "refs/remotes/origin/r", "refs/tags/v", "refs/notes/n")], F.lit("refs/remotes/origin/HEAD"))
    refs = turns.select(F.col("role").alias("repo"), F.concat(F.get(forms, (F.col("conv_id") % 5).cast("int")), F.when(F.col("conv_id") % 5 < 4, F.concat(F.lit("-"), "conv_id")).otherwise("")).alias("ref"),
                        F.md5(F.col("text").cast("binary")).alias("sha"), F.timestamp_seconds(F.col("turn") * 1000 + F.col("conv_id")).alias("date"))
    return C.listed_refs(refs, 150)


H6_SQL = """WITH r AS (SELECT role AS repo, CASE conv_id % 5 WHEN 0 THEN 'refs/heads/b' || turn || '-' || conv_id WHEN 1 THEN 'refs/remotes/origin/r' || turn || '-' || conv_id
  WHEN 2 THEN 'refs/tags/v' || turn || '-' || conv_id WHEN 3 THEN 'refs/notes/n' || turn || '-' || conv_id ELSE 'refs/remotes/origin/HEAD' END AS ref, md5(text) AS sha, turn * 1000 + conv_id AS date FROM conversations),
p AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY date DESC, ref) AS place FROM r)
SELECT repo, place, regexp_replace(ref, '^refs/(heads|remotes|tags)/', '') AS name, CASE split_part(ref, '/', 2) WHEN 'heads' THEN 'branch' WHEN 'remotes' THEN 'remote' ELSE 'tag' END AS kind, sha
FROM p WHERE place <= 150 AND split_part(ref, '/', 2) <> 'notes' AND ref <> 'refs/remotes/origin/HEAD'"""


def h7(spark, sf):
    return C.listed_commits(branched(spark, sf), 3).select("repo", "sha", "ord", "omitted")


H7_SQL = """WITH s AS (SELECT conv_id::VARCHAR AS repo, conv_id || ':' || turn AS sha, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS newest, count(*) OVER (PARTITION BY conv_id) AS total FROM conversations WHERE turn % 4 <> 3)
SELECT repo, sha, (least(total, 3) - newest)::INT AS ord, total - least(total, 3) AS omitted FROM s WHERE newest <= 3"""


def d11(spark, sf):
    return k4(spark, sf).select("repo", "sha", "files", *P.COUNTS)


def d12(spark, sf):
    """The most one commit adds and removes, in each of the three measures."""
    entries = written(spine(spark, sf), "entries")
    lines, code, tokens = (P.heaviest_churn(entries, m).withColumnRenamed("heaviest", f"heaviest_{m}") for m in ("lines", "code_lines", "tokens"))
    return lines.join(code, "repo").join(tokens, "repo")


def f10(spark, sf):
    before, after = P.commit_sides(listed(spark, sf), A.commit_snapshots(spark, sf))
    counts = [side.groupBy("repo", "sha").agg(F.count("*").alias("files"), F.sum("size").alias("bytes")).withColumn("side", F.lit(name)) for name, side in (("before", before), ("after", after))]
    return counts[0].unionByName(counts[1])


F10_SQL = """WITH s AS (SELECT conv_id, turn + shift AS rev, strlen(text) AS size FROM conversations, (VALUES (0), (0), (0), (1)) p(shift)),
t AS (SELECT conv_id, rev, count(*) AS files, sum(size)::BIGINT AS bytes FROM s GROUP BY ALL)
SELECT c.conv_id::VARCHAR AS repo, c.conv_id || ':' || c.turn AS sha, 'after' AS side, files, bytes FROM conversations c JOIN t ON t.conv_id = c.conv_id AND t.rev = c.turn
UNION ALL SELECT c.conv_id::VARCHAR, c.conv_id || ':' || c.turn, 'before', files, bytes FROM conversations c JOIN t ON t.conv_id = c.conv_id AND t.rev = c.turn - 1 WHERE c.turn > 0"""


def k8(spark, sf):
    """Every turn against the name of its conversation's newest one; the newest itself is refused."""
    turns = A.commits(spark, sf).select("repo", F.lit("tip").alias("base"), F.col("sha").alias("target"))
    return C.revision_pairs(turns, tips(spark, sf).withColumn("name", F.lit("tip")))


K8_SQL = """SELECT conv_id::VARCHAR AS repo, 'tip' AS base, conv_id || ':' || turn AS target, conv_id || ':' || last AS base_sha, conv_id || ':' || turn AS target_sha,
  CASE WHEN turn = last THEN 'nothing to compare: tip and ' || conv_id || ':' || turn || ' are the same commit' END AS refusal
FROM (SELECT conv_id, turn, max(turn) OVER (PARTITION BY conv_id) AS last FROM conversations)"""


def k2_pairs(spark, sf):
    """Tips of two lines against each other; where one contains the other the comparison is refused."""
    one, other = (tips(spark, sf, r).withColumnRenamed("sha", side) for r, side in ((1, "base"), (2, "target")))
    return C.merge_base_pairs(branched(spark, sf), one.join(other, "repo"))


K2_PAIRS_SQL = O.with_ctes(f"{BRANCHED},{TIPS}", """SELECT a.repo, a.sha AS base, b.sha AS target, m.sha AS base_sha,
  CASE WHEN m.sha IS NULL THEN 'no merge base between ' || a.sha || ' and ' || b.sha
    WHEN m.sha = b.sha THEN 'nothing to compare: ' || b.sha || ' is an ancestor of ' || a.sha || ', so ' || a.sha || '...' || b.sha || ' is empty' END AS refusal
FROM tip a JOIN tip b ON b.repo = a.repo AND a.r = 1 AND b.r = 2 LEFT JOIN (SELECT repo, min(sha) AS sha FROM (""" + K2_SQL[K2_SQL.rindex("SELECT repo, sha FROM common c"):] + """) GROUP BY repo) m ON m.repo = a.repo""")


ENTRIES = [
    ("d11_commit_totals", d11, "SELECT repo, sha, files, " + ", ".join(P.COUNTS) + " FROM (" + K4_SQL + ")"),
    ("d12_heaviest_churn", d12, "SELECT repo, " + ", ".join(f"max(added_{m} + removed_{m}) AS heaviest_{m}" for m in ("lines", "code_lines", "tokens")) + " FROM (" + K4_SQL + ") GROUP BY repo"),
    ("f10_commit_sides", f10, F10_SQL),
    ("g6_chained_runs", lambda spark, sf: C.chained(broken(spark, sf)).select("repo", "ord", "run"), f"WITH {LISTED} SELECT repo, ord, run FROM runs"),
    ("g7_slid_spans", g7, G7_SQL),
    ("g8_extended_spans", g8, G8_SQL),
    ("h6_listed_refs", h6, H6_SQL),
    ("h7_newest_commits", h7, H7_SQL),
    ("i1_with_working_tree", with_working_tree, I1_SQL),
    ("i5_commit_range", i5, I5_SQL),
    ("k1_ancestors", k1, K1_SQL),
    ("k2_merge_base", k2, K2_SQL),
    ("k2_merge_base_pairs", k2_pairs, K2_PAIRS_SQL),
    ("k3_without_merges", lambda spark, sf: C.without_merges(branched(spark, sf)).select("repo", "sha"), O.with_ctes(BRANCHED, "SELECT repo, sha FROM branched WHERE len(parents) < 2")),
    ("k4_spine", k4, K4_SQL),
    ("k5_span_comparisons", lambda spark, sf: C.comparisons_of(spans(spark, sf), broken(spark, sf)),
     f"""WITH {LISTED} SELECT s.repo, s.start, s."end", 'revisionPair' AS kind, a.parent AS base, b.sha AS target FROM spans s JOIN runs a ON a.repo = s.repo AND a.ord = s.start JOIN runs b ON b.repo = s.repo AND b.ord = s."end" """),
    ("k6_comparison_spans", k6, K6_SQL),
    ("k8_no_empty_comparison", k8, K8_SQL),
]
