"""B: path parts, kinds, generated files, languages, figures as text, links."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import oracle as O
from massmap.functions import classify as C
from massmap.functions import figures as G
from massmap.functions import fixed_values as V
from massmap.functions import links as K
from massmap.functions import paths as P
from massmap.functions import text as T
from massmap.operators.locales import locale_levels, with_locale_copy
from massmap.plans.scan import scan_texts
from massmap.sources import adapters as A


def corpus_files(spark, sf):
    """The corpus through the whole scan."""
    texts = A.admitted_corpus(spark, sf)
    return scan_texts(texts, locale_levels(A.corpus(spark, sf)))


def paths(spark, sf):
    return A.corpus(spark, sf).select("repo", "path")


def over_corpus(**columns):
    """A query of columns over the corpus, keyed by document."""
    return lambda spark, sf: A.corpus(spark, sf).select("doc_id", *[make().alias(n) for n, make in columns.items()])


def named_sql(*columns: str) -> str:
    return O.with_ctes(f"{O.CORPUS},{O.PARTS}", f"SELECT doc_id, {', '.join(columns)} FROM named")


path, text = lambda: F.col("path"), lambda: F.col("text")
name = lambda: P.base_name(path())

# Names that are and are not locales, from the documents' own languages.
LOCALE_TAILS = ["", "-us", "_cn", "-latn", "_hant-tw", "-map", "_da_map", "-LATN", "x", "-rs-latn", "_br"]


def locale_candidate():
    tails = F.array(*[F.lit(t) for t in LOCALE_TAILS])
    return F.concat("lang", F.get(tails, (F.col("doc_id") % len(LOCALE_TAILS)).cast("int")))


def locale_query(judge):
    def run(spark, sf):
        documents = A.table(spark, sf, "documents").select("doc_id", locale_candidate().alias("entry"))
        return documents.select("doc_id", "entry", judge(F.col("entry")).alias("is_locale"))

    return run


LOCALE_SQL = f"(SELECT doc_id, lang || ({O.array(LOCALE_TAILS)})[1 + doc_id % {len(LOCALE_TAILS)}] AS entry FROM documents)"


def b2(spark, sf):
    frame = paths(spark, sf)
    judged = with_locale_copy(frame, locale_levels(frame))
    return judged.select("repo", "path", C.kind_by_path(F.col("path"), F.col("locale_copy")).alias("kind"))


def b7(spark, sf):
    frame = paths(spark, sf)
    return with_locale_copy(frame, locale_levels(frame))


def d8(spark, sf):
    return locale_levels(paths(spark, sf))


def d8_languages(spark, sf):
    return locale_levels(A.language_tree(spark, sf))


# Segments: digests of the texts in the shapes bundlers write, and plain words.
def b10(spark, sf):
    digest = F.md5(F.col("text").cast("binary"))
    segment = (
        F.when(F.col("doc_id") % 4 == 0, F.substring(digest, 1, 8))
        .when(F.col("doc_id") % 4 == 1, F.concat(F.upper(F.substring(digest, 1, 5)), F.substring(digest, 6, 5)))
        .when(F.col("doc_id") % 4 == 2, F.translate(F.substring(digest, 1, 9), "abcdef", "012345"))
        .otherwise(F.concat("source", F.lit("segment")))
    )
    return A.table(spark, sf, "documents").select("doc_id", segment.alias("segment")).withColumn(
        "is_hash", C.content_hash(F.col("segment"))
    )


B10_SQL = f"""WITH s AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN substr(md5(text), 1, 8)
  WHEN 1 THEN upper(substr(md5(text), 1, 5)) || substr(md5(text), 6, 5)
  WHEN 2 THEN translate(substr(md5(text), 1, 9), 'abcdef', '012345') ELSE source || 'segment' END AS segment FROM documents)
SELECT doc_id, segment, {O.content_hash('segment')} AS is_hash FROM s"""


def b13(spark, sf):
    pages = A.page_files(spark, sf)
    meta = F.lit('<meta name=generator content="builder"/>')
    page_id = F.regexp_extract("path", r"([0-9]+)\.html$", 1).cast("bigint")
    html = F.when(page_id % 3 == 0, F.concat(meta, "text")).otherwise(F.col("text"))
    return pages.select("path", C.html_generator(F.col("path"), html).alias("by_tool"))


PAGE_FILES = """
places AS (SELECT page_id, html, regexp_replace(regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', ''), '/+$', '') AS place FROM pages),
page_files AS (SELECT regexp_extract(place, '^([^/]+)', 1) AS repo, page_id,
  regexp_replace(place, '^[^/]+/?', '') || '/' || page_id || '.html' AS path, html AS text FROM places)"""

B13_SQL = f"""WITH {PAGE_FILES}, made AS (SELECT path, '.html' AS ext,
  CASE WHEN page_id % 3 = 0 THEN '<meta name=generator content="builder"/>' || text ELSE text END AS text FROM page_files)
SELECT path, {O.html_generator('ext', 'text')} AS by_tool FROM made"""


def b15(spark, sf):
    frame = A.corpus(spark, sf)
    return frame.select("doc_id", C.minified(F.col("text")).alias("minified"),
                        T.utf16_length(F.col("text")).alias("length"))


# --- figures -------------------------------------------------------------------
def parts_sold(spark, sf):
    """Whole figures per part: quantity sold and returned, before as a second reading."""
    lines = A.table(spark, sf, "lineitem")
    returned = F.col("l_returnflag") == "R"
    return lines.groupBy("l_partkey").agg(
        F.sum(F.when(~returned, F.col("l_quantity")).otherwise(0)).cast("bigint").alias("added"),
        F.sum(F.when(returned, F.col("l_quantity")).otherwise(0)).cast("bigint").alias("removed"),
        F.sum(F.when(F.col("l_linestatus") == "O", F.col("l_quantity")).otherwise(0)).cast("bigint").alias("before"),
        F.floor(F.sum(F.round(F.col("l_extendedprice") * 100).cast("bigint")) / 100).cast("bigint").alias("price"),
    )


PARTS_SOLD = """sold AS (SELECT l_partkey, sum(CASE WHEN l_returnflag <> 'R' THEN l_quantity ELSE 0 END)::BIGINT AS added,
  sum(CASE WHEN l_returnflag = 'R' THEN l_quantity ELSE 0 END)::BIGINT AS removed,
  sum(CASE WHEN l_linestatus = 'O' THEN l_quantity ELSE 0 END)::BIGINT AS before,
  (sum(round(l_extendedprice * 100)::BIGINT) // 100)::BIGINT AS price FROM lineitem GROUP BY l_partkey)"""


def sold_query(**columns):
    def run(spark, sf):
        return parts_sold(spark, sf).select("l_partkey", *[make().alias(n) for n, make in columns.items()])

    return run


def sold_sql(**columns: str) -> str:
    return f"WITH {PARTS_SOLD} SELECT l_partkey, " + ", ".join(f"{sql} AS {n}" for n, sql in columns.items()) + " FROM sold"


def tenths_sql(x: str) -> str:
    n = f"(floor({x} * 10) + CASE WHEN ({x} * 16 - (floor({x} * 10) * 2 + 1)) + {x} * 4 >= 0 THEN 1 ELSE 0 END)::BIGINT"
    return f"(({n} // 10) || '.' || ({n} % 10))"


def compact_sql(value: str) -> str:
    def scaled(number: str, unit: str) -> str:
        return f"(CASE WHEN {number} < 9.95 THEN {tenths_sql(number)} ELSE floor({number} + 0.5)::BIGINT::VARCHAR END || '{unit}')"

    size = f"abs({value})"
    text_ = f"CASE WHEN {size} < 1000 THEN {size}::BIGINT::VARCHAR WHEN {size} < 1000000 THEN {scaled(f'({size}::DOUBLE / 1000)', 'k')} ELSE {scaled(f'({size}::DOUBLE / 1000000)', 'M')} END"
    return f"(CASE WHEN {value} < 0 THEN '-' ELSE '' END || {text_})"


def signed_sql(value: str) -> str:
    return f"(CASE WHEN {value} = 0 THEN '0' WHEN {value} < 0 THEN '-' || {compact_sql(f'abs({value})')} ELSE '+' || {compact_sql(value)} END)"


def share_text_sql(value: str) -> str:
    return (f"(CASE WHEN {value} * 100 >= 99.5 THEN '100%' WHEN {value} * 100 < 0.5 THEN CASE WHEN {value} > 0 THEN '<1%' ELSE '0%' END "
            f"ELSE floor({value} * 100 + 0.5)::BIGINT || '%' END)")


def files_sql(value: str) -> str:
    return f"(CASE WHEN {value} = 1 THEN '1 file' ELSE {compact_sql(value)} || ' files' END)"


def change_sql(added: str, removed: str) -> str:
    return (f"concat_ws(' ', CASE WHEN {added} > 0 THEN '+' || {compact_sql(added)} END, "
            f"CASE WHEN {removed} > 0 THEN '-' || {compact_sql(removed)} END)")


def relative_sql(value: str, net: bool) -> str:
    sign = f"CASE WHEN {value} < 0 THEN '-' WHEN {value} > 0 THEN '+' ELSE '' END || " if net else ""
    return (f"CASE WHEN before = 0 THEN CASE WHEN {value} = 0 THEN '0.0%' ELSE 'new' END "
            f"ELSE {sign}{tenths_sql(f'(abs({value}::DOUBLE / before) * 100)')} || '%' END")


added, removed, before = (lambda: F.col("added")), (lambda: F.col("removed")), (lambda: F.col("before"))


def b20(spark, sf):
    frame = parts_sold(spark, sf).select("l_partkey", F.col("added").alias("added_tokens"), F.col("removed").alias("removed_tokens"),
                                         (F.col("added") + F.col("removed")).alias("churn_tokens"),
                                         (F.col("added") - F.col("removed")).alias("net_tokens"), F.col("price").alias("tokens"))
    return frame.select("l_partkey", *[F.col(G.weight_column("tokens", a)).alias(a) for a in G.ASPECTS],
                        F.col(G.baseline_column("tokens", "net")).alias("whole_of_net"))


def b35_remotes(spark, sf):
    pages = A.table(spark, sf, "pages")
    host = F.regexp_extract("url", "^https?://([^/]+)", 1)
    host = F.when(F.col("page_id") % 5 == 0, F.concat(F.lit("GitLab."), host)).otherwise(host)
    project = F.concat(F.lit("Team/"), "page_id")
    remote = (
        F.when(F.col("page_id") % 4 == 0, F.concat(F.lit("git@"), host, F.lit(":"), project, F.lit(".git")))
        .when(F.col("page_id") % 4 == 1, F.concat(F.lit("ssh://git@"), host, F.lit(":2222/"), project))
        .when(F.col("page_id") % 4 == 2, F.concat(F.lit("https://"), host, F.lit("/"), project, F.lit(".git")))
        .otherwise(F.col("page_id").cast("string"))
    )
    frame = pages.select("page_id", remote.alias("remote"))
    place = K.project(F.col("remote"))
    return frame.select("page_id", place["host"].alias("host"), place["path"].alias("path"),
                        K.commit_url_base(F.col("remote")).alias("commits"))


B35_SQL = f"""WITH h AS (SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 'GitLab.' ELSE '' END || regexp_extract(url, '^https?://([^/]+)', 1) AS h FROM pages),
r AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'git@' || h || ':Team/' || page_id || '.git' WHEN 1 THEN 'ssh://git@' || h || ':2222/Team/' || page_id
  WHEN 2 THEN 'https://' || h || '/Team/' || page_id || '.git' ELSE page_id::VARCHAR END AS remote FROM h),
m AS (SELECT page_id, CASE WHEN {O.rx('remote', V.SCP_REMOTE)} THEN regexp_extract(remote, {O.q(V.SCP_REMOTE)}, 1)
    WHEN {O.rx('remote', V.URL_REMOTE)} THEN regexp_extract(remote, {O.q(V.URL_REMOTE)}, 1) END AS host,
  CASE WHEN {O.rx('remote', V.SCP_REMOTE)} THEN regexp_extract(remote, {O.q(V.SCP_REMOTE)}, 2)
    WHEN {O.rx('remote', V.URL_REMOTE)} THEN regexp_extract(remote, {O.q(V.URL_REMOTE)}, 2) END AS raw FROM r),
w AS (SELECT page_id, lower(host) AS host, regexp_replace(regexp_replace(raw, '\\.git$', ''), '^/+|/+$', '', 'g') AS web FROM m)
SELECT page_id, host, lower(web) AS path, 'https://' || host || '/' || web || CASE WHEN contains(host, 'gitlab') THEN '/-/commit/' ELSE '/commit/' END AS commits FROM w"""


def b35_reviews(spark, sf):
    place = F.regexp_extract("url", "^(https?://[^/?#]+)", 1)
    page = (
        F.when(F.col("page_id") % 3 == 0, F.concat(place, F.lit("/Team/App/pull/"), "page_id", F.lit("?x=1")))
        .when(F.col("page_id") % 3 == 1, F.concat(place, F.lit("/team/sub/app/-/merge_requests/"), "page_id"))
        .otherwise(F.col("url"))
    )
    frame = A.table(spark, sf, "pages").select("page_id", page.alias("page"))
    got = K.review(F.col("page"))
    return frame.select("page_id", *[got[part].alias(part) for part in ("host", "path", "number", "label")])


B35_REVIEW_SQL = f"""WITH p AS (SELECT page_id, CASE page_id % 3 WHEN 0 THEN regexp_extract(url, '^(https?://[^/?#]+)', 1) || '/Team/App/pull/' || page_id || '?x=1'
  WHEN 1 THEN regexp_extract(url, '^(https?://[^/?#]+)', 1) || '/team/sub/app/-/merge_requests/' || page_id ELSE url END AS page FROM pages),
m AS (SELECT page_id, page, {O.rx('page', V.REVIEW_URL)} AS hit FROM p)
SELECT page_id, CASE WHEN hit THEN lower(regexp_extract(page, {O.q(V.REVIEW_URL)}, 1)) END AS host,
  CASE WHEN hit THEN lower(regexp_extract(page, {O.q(V.REVIEW_URL)}, 2)) END AS path,
  CASE WHEN hit THEN regexp_extract(page, {O.q(V.REVIEW_URL)}, 4)::BIGINT END AS number,
  CASE WHEN hit THEN CASE regexp_extract(page, {O.q(V.REVIEW_URL)}, 3) WHEN 'pull' THEN 'PR #' ELSE 'MR !' END || regexp_extract(page, {O.q(V.REVIEW_URL)}, 4) END AS label FROM m"""


def b36(spark, sf):
    digest = F.sha1(F.col("text").cast("binary"))
    rev = (
        F.when(F.col("turn") % 3 == 0, digest)
        .when(F.col("turn") % 3 == 1, F.concat(F.lit("refs/review/pull/"), "conv_id"))
        .otherwise(F.concat(F.lit("v"), "turn"))
    )
    kinds = ["workingTree", "staged", "revisionToWorkingTree", "revisionPair", "mergeBase"]
    kind = F.get(F.array(*[F.lit(k) for k in kinds]), (F.col("conv_id") % 5).cast("int"))
    frame = A.table(spark, sf, "conversations").select("conv_id", "turn", rev.alias("base"), kind.alias("kind"), F.lit("main").alias("target"))
    return frame.select("conv_id", "turn", K.short_revision(F.col("base")).alias("short"),
                        K.comparison_label(F.col("kind"), F.col("base"), F.col("target")).alias("label"),
                        K.comparison_key(F.col("kind"), F.col("base"), F.col("target")).alias("key"))


B36_SQL = """WITH c AS (SELECT conv_id, turn, CASE turn % 3 WHEN 0 THEN sha1(text) WHEN 1 THEN 'refs/review/pull/' || conv_id ELSE 'v' || turn END AS base,
  (['workingTree','staged','revisionToWorkingTree','revisionPair','mergeBase'])[1 + conv_id % 5] AS kind FROM conversations),
s AS (SELECT *, CASE turn % 3 WHEN 0 THEN substr(base, 1, 10) WHEN 1 THEN 'PR ' || conv_id ELSE base END AS short FROM c)
SELECT conv_id, turn, short, CASE kind WHEN 'workingTree' THEN 'HEAD -> working tree' WHEN 'staged' THEN 'HEAD -> index'
  WHEN 'revisionToWorkingTree' THEN short || ' -> working tree' WHEN 'revisionPair' THEN short || ' -> main' ELSE short || ' -> main, from the merge base' END AS label,
  CASE WHEN kind IN ('workingTree','staged') THEN kind WHEN kind = 'revisionToWorkingTree' THEN kind || ' ' || base ELSE kind || ' ' || base || ' main' END AS key FROM s"""


def b39(spark, sf):
    events = A.table(spark, sf, "events")
    now = F.lit("2026-01-01 00:00:00").cast("timestamp")
    return events.select("event_id", G.age(F.col("ts"), now).alias("age"),
                         G.run_length(F.floor(F.col("value") * 1000)).alias("length"))


B39_SQL = """WITH e AS (SELECT event_id, greatest(0, floor(epoch(TIMESTAMP '2026-01-01 00:00:00')) - floor(epoch(ts))) AS s,
  greatest(0, floor(floor(value * 1000) / 1000.0 + 0.5))::BIGINT AS r FROM events)
SELECT event_id, CASE WHEN s < 45 THEN 'just now' WHEN s < 3600 THEN floor(s / 60.0 + 0.5)::BIGINT || 'm ago'
  WHEN s < 86400 THEN floor(s / 3600.0 + 0.5)::BIGINT || 'h ago' ELSE floor(s / 86400.0 + 0.5)::BIGINT || 'd ago' END AS age,
  (r // 60) || ':' || lpad((r % 60)::VARCHAR, 2, '0') AS length FROM e"""


def b34(spark, sf):
    turns = A.table(spark, sf, "conversations")
    return turns.select("conv_id", "turn", K.subject(F.col("text")).alias("subject"), K.body(F.col("text"), V.MAX_COMMIT_BODY).alias("body"))


B34_REST = O.trim("CASE WHEN contains(text, chr(10)) THEN regexp_replace(text, '^[^\\n]*\\n', '') ELSE '' END")
B34_SQL = f"""WITH c AS (SELECT conv_id, turn, {O.trim("string_split(text, chr(10))[1]")} AS subject, {B34_REST} AS rest FROM conversations)
SELECT conv_id, turn, subject, CASE WHEN length(rest) > 400 THEN regexp_replace(substr(rest, 1, 400), '[{V.SPACE}]+$', '') || '...' ELSE rest END AS body FROM c"""


def b37(spark, sf):
    return A.commits(spark, sf).select("repo", "sha", K.first_parent(F.col("parents")).alias("parent"))


def b19(spark, sf):
    return corpus_files(spark, sf).select("repo", "path", "kind", "generated", C.flavor(F.col("generated"), F.col("kind")).alias("flavor"))


def b8(spark, sf):
    from massmap.plans.scan import refined_kind, with_literal_share

    frame = A.corpus(spark, sf)
    # Every text as the strings of a source file, so that catalogues occur.
    quoted = F.concat(F.lit('x = "'), F.regexp_replace(F.translate("text", '"\\`', "   "), "\n", '"\ny = "'), F.lit('"'))
    wrapped = frame.withColumn("text", F.when(F.col("doc_id") % 3 == 0, quoted).otherwise(F.col("text")))
    named = wrapped.withColumn("language", C.language(P.base_name(F.col("path")), F.col("text")))
    shaped = with_literal_share(named)
    return shaped.select("doc_id", "literal_chars", "content_chars", "largest_literal",
                         refined_kind(F.col("path"), F.lit(False), F.col("language")).alias("kind"))


QUOTED = f"""quoted AS (SELECT * REPLACE (CASE WHEN doc_id % 3 = 0 THEN 'x = "' || replace(translate(text, '"\\`', '   '), chr(10), '"' || chr(10) || 'y = "') || '"' ELSE text END AS text) FROM named),
langs AS (SELECT *, false AS locale_copy, {O.LANGUAGE} AS language FROM quoted),
{O.WHOLE},
shaped AS (SELECT l.*, coalesce({O.utf16(O.SOLID.format("regexp_replace(l.text, w.whole, chr(92) || '1', 'g')"))}, 0)::BIGINT AS content_chars,
  list_transform(list_filter(regexp_extract_all(l.text, w.whole, 1), lambda x: x <> ''), lambda x: {O.utf16(O.SOLID.format('x'))}) AS sizes
  FROM langs l LEFT JOIN whole_markers w ON w.language = l.language),
summed AS (SELECT *, coalesce(list_sum(sizes), 0)::BIGINT AS literal_chars, coalesce(list_max(sizes), 0)::BIGINT AS largest_literal FROM shaped)"""
B8_SQL = O.with_ctes(f"{O.CORPUS},{O.PARTS},{QUOTED}", f"""SELECT doc_id, literal_chars, content_chars, largest_literal,
  CASE WHEN ({O.KIND}) = 'code' AND language IS NOT NULL AND language NOT IN {O.values(V.QUOTING_LANGUAGES)} AND content_chars >= 1000
    AND literal_chars >= content_chars * 0.9 AND largest_literal <= literal_chars * 0.25
  THEN CASE WHEN {O.rx('lower(path)', V.I18N_PATH)} THEN 'i18n' ELSE 'data' END ELSE ({O.KIND}) END AS kind FROM summed""")


def b31(spark, sf):
    frame = paths(spark, sf)
    root = F.lit("m0/src")
    return frame.select("repo", "path", P.relative_to(F.col("path"), root).alias("relative"), P.is_inside(F.col("path"), root).alias("inside"))


STATUSES = ["added", "modified", "deleted", "renamed", "unchanged"]


def b32(spark, sf):
    status = F.get(F.array(*[F.lit(s) for s in STATUSES]), (F.col("o_orderkey") % 5).cast("int"))
    return A.table(spark, sf, "orders").select("o_orderkey", G.status_letter(status).alias("letter"))


def b33(spark, sf):
    files = corpus_files(spark, sf)
    value = G.comment_share(F.col("lines"), F.col("comment_lines"))
    return files.select("repo", "path", F.round(value, 6).alias("share"), (value >= V.COMMENT_SHARE_NOTED).alias("noted"),
                        ((value >= 0.4) & (F.col("lines") >= 40)).alias("marked"))


ENTRIES = [
    ("b1_path_parts", over_corpus(name=name, ext=lambda: P.extension(F.lower(name())), stem=lambda: P.stem(name()),
                                  folders=lambda: F.array_join(P.folder_names(path()), "|")),
     named_sql("name", "ext", "stem", "coalesce(array_to_string(dirs, '|'), '') AS folders")),
    ("b2_kind_by_path", b2, O.with_ctes(O.CLASSIFIED, f"SELECT repo, path, {O.KIND} AS kind FROM copies")),
    ("b3_named_like_test", over_corpus(is_test=lambda: C.named_like_test(name())), named_sql(f"{O.NAMED_LIKE_TEST} AS is_test")),
    ("b4_stemmed_like_test", over_corpus(is_test=lambda: C.stemmed_like_test(name())), named_sql(f"{O.STEMMED_LIKE_TEST} AS is_test")),
    ("b5_locale_name", locale_query(C.locale_name), f"SELECT doc_id, entry, {O.locale_name('entry')} AS is_locale FROM {LOCALE_SQL}"),
    ("b6_regioned_locale", locale_query(C.regioned_locale), f"SELECT doc_id, entry, {O.regioned('entry')} AS is_locale FROM {LOCALE_SQL}"),
    ("b7_locale_copy", b7, O.with_ctes(O.CLASSIFIED, "SELECT repo, path, locale_copy FROM copies")),
    ("b8_kind_by_content", b8, B8_SQL),
    ("b9_generated_by_path", over_corpus(generated=lambda: C.generated_by_path(path())), named_sql(f"{O.GENERATED_BY_PATH} AS generated")),
    ("b10_content_hash", b10, B10_SQL),
    ("b11_generated_by_content", over_corpus(generated=lambda: C.generated_by_content(path(), text())), named_sql(f"{O.GENERATED_BY_CONTENT} AS generated")),
    ("b12_generated_header", over_corpus(generated=lambda: C.generated_header(text())), named_sql(f"{O.generated_header('text')} AS generated")),
    ("b13_html_generator", b13, B13_SQL),
    ("b14_source_mapped", over_corpus(mapped=lambda: C.source_mapped(text())), named_sql(f"{O.rx('text', V.SOURCE_MAP_COMMENT)} AS mapped")),
    ("b15_minified", b15, named_sql(f"{O.minified('text')} AS minified", f"{O.utf16('text')} AS length")),
    ("b16_interpreter", over_corpus(program=lambda: C.interpreter(text())), named_sql(f"{O.interpreter('text')} AS program")),
    ("b17_language", over_corpus(language=lambda: C.language(name(), text())), named_sql(f"{O.LANGUAGE} AS language")),
    ("b18_comment_syntax", over_corpus(syntax=lambda: C.comment_syntax(name(), text())), named_sql(f"{O.COMMENT_SYNTAX} AS syntax")),
    ("b19_flavor", b19, O.with_ctes(O.MEASURED, "SELECT repo, path, kind, generated, flavor FROM flavored")),
    ("b20_weight_columns", b20, f"WITH {PARTS_SOLD} SELECT l_partkey, added, removed, added + removed AS churn, added - removed AS net, price AS \"after\", added + removed AS whole_of_net FROM sold"),
    ("b21_aspect_totals", lambda spark, sf: parts_sold(spark, sf).select(
        "l_partkey", *[v.alias(k) for k, v in G.aspect_totals(F.col("added"), F.col("removed"), F.col("price")).items()]),
     f"WITH {PARTS_SOLD} SELECT l_partkey, added, removed, added - removed AS net, added + removed AS churn, price AS \"after\" FROM sold"),
    ("b22_share", sold_query(share=lambda: F.round(G.share(F.col("added") - F.col("removed"), F.col("before")), 6)),
     sold_sql(share="round(CASE WHEN before > 0 THEN least(1.0, abs(added - removed)::DOUBLE / before) ELSE 0.0 END, 6)")),
    ("b23_relative_change", sold_query(churn=lambda: G.relative_change(F.col("added") + F.col("removed"), F.col("before"), False),
                                       net=lambda: G.relative_change(F.col("added") - F.col("removed"), F.col("before"), True)),
     sold_sql(churn=relative_sql("(added + removed)", False), net=relative_sql("(added - removed)", True))),
    ("b24_compact", sold_query(compact=lambda: G.compact(F.col("price")), small=lambda: G.compact(F.col("added") - F.col("removed"))),
     sold_sql(compact=compact_sql("price"), small=compact_sql("(added - removed)"))),
    ("b25_figure_texts", sold_query(signed=lambda: G.signed(F.col("added") - F.col("removed")),
                                    share=lambda: G.share_text(F.col("removed") / (F.col("added") + F.col("removed") + 1)),
                                    files=lambda: G.file_count(F.col("added")), change=lambda: G.change_text(F.col("added"), F.col("removed")),
                                    grouped=lambda: G.grouped(F.col("price")), signed_grouped=lambda: G.signed_grouped(F.col("removed") - F.col("price"))),
     sold_sql(signed=signed_sql("(added - removed)"), share=share_text_sql("(removed::DOUBLE / (added + removed + 1))"),
              files=files_sql("added"), change=change_sql("added", "removed"), grouped="format('{:,}', price)",
              signed_grouped="CASE WHEN removed = price THEN '0' WHEN removed < price THEN '-' || format('{:,}', price - removed) ELSE '+' || format('{:,}', removed - price) END")),
    ("b26_pre_tokens", lambda spark, sf: A.table(spark, sf, "documents").select("doc_id", T.pre_tokens(F.col("text")).alias("tokens")),
     f"SELECT doc_id, {O.tokens('text')} AS tokens FROM documents"),
    ("b27_solid_chars", lambda spark, sf: A.table(spark, sf, "documents").select("doc_id", T.solid_chars(F.col("text")).alias("solid")),
     f"SELECT doc_id, {O.utf16(O.SOLID.format('text'))} AS solid FROM documents"),
    ("b28_literal_share", lambda spark, sf: b8(spark, sf).drop("kind"), B8_SQL.replace("SELECT doc_id, literal_chars, content_chars, largest_literal,\n", "SELECT * EXCLUDE (kind) FROM (SELECT doc_id, literal_chars, content_chars, largest_literal,\n") + ")"),
    ("b29_structure", lambda spark, sf: corpus_files(spark, sf).select("repo", "path", "language", "functions", "classes", "branches"),
     O.with_ctes(O.MEASURED, "SELECT repo, path, language, functions, classes, branches FROM files")),
    ("b30_unix_newlines", lambda spark, sf: A.table(spark, sf, "documents").select(
        "doc_id", T.unix_newlines(F.regexp_replace("text", "\n", "\r\n")).alias("text")), "SELECT doc_id, text FROM documents"),
    ("b31_relative_paths", b31, O.with_ctes(O.CORPUS, """SELECT repo, path, CASE WHEN path = 'm0/src' THEN '.' WHEN starts_with(path, 'm0/src/') THEN substr(path, 8) ELSE path END AS relative,
      path = 'm0/src' OR starts_with(path, 'm0/src/') AS inside FROM corpus""")),
    ("b32_status_letter", b32, "SELECT o_orderkey, (['A','M','D','R','='])[1 + o_orderkey % 5] AS letter FROM orders"),
    ("b33_comment_share", b33, O.with_ctes(O.MEASURED, """SELECT repo, path, round(CASE WHEN lines > 0 THEN comment_lines::DOUBLE / lines ELSE 0 END, 6) AS share,
      CASE WHEN lines > 0 THEN comment_lines::DOUBLE / lines ELSE 0 END >= 0.2 AS noted,
      CASE WHEN lines > 0 THEN comment_lines::DOUBLE / lines ELSE 0 END >= 0.4 AND lines >= 40 AS marked FROM files""")),
    ("b34_commit_text", b34, B34_SQL),
    ("b35_remotes", b35_remotes, B35_SQL),
    ("b35_reviews", b35_reviews, B35_REVIEW_SQL),
    ("b36_comparison_labels", b36, B36_SQL),
    ("b37_first_parent", b37, f"SELECT conv_id::VARCHAR AS repo, conv_id || ':' || turn AS sha, CASE WHEN turn = 0 THEN '{V.EMPTY_TREE}' ELSE conv_id || ':' || (turn - 1) END AS parent FROM conversations"),
    ("b39_age", b39, B39_SQL),
    ("d8_locale_levels", d8, O.with_ctes(f"{O.CORPUS},{O.PARTS},{O.LEVELS}", "SELECT repo, dir AS folder FROM levels")),
    ("d8_language_folders", d8_languages, O.with_ctes(
        f"corpus AS (SELECT 'all' AS repo, doc_id, source || '/' || lang || '/' || doc_id || '.txt' AS path, text FROM documents),{O.PARTS},{O.LEVELS}",
        "SELECT repo, dir AS folder FROM levels")),
]
