"""C: physical lines and their verdicts."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import oracle as O
from catalog.classify import PAGE_FILES
from massmap.functions import lines as L
from massmap.functions import paths as P
from massmap.operators.spans import bucket_by_spans
from massmap.plans.scan import measured
from massmap.sources import adapters as A


def c1(spark, sf):
    documents = A.table(spark, sf, "documents")
    return documents.select("doc_id", F.posexplode(L.split_lines(F.col("text"))).alias("line_no", "line"))


C1_SQL = f"""SELECT doc_id, u.line_no::INT AS line_no, u.line FROM (SELECT doc_id, {O.split_lines('text')} AS l FROM documents) d,
LATERAL (SELECT unnest(range(0, len(d.l))) AS line_no, unnest(d.l) AS line) u"""


def spans(spark, sf):
    """Two spans per document: one inside a line, one over several lines."""
    documents = A.table(spark, sf, "documents")
    number = F.col("doc_id")
    one = F.struct((number % 5).cast("int").alias("start_row"), F.lit(0).alias("start_col"),
                   (number % 5).cast("int").alias("end_row"), (number % 400).cast("int").alias("end_col"))
    many = F.struct((number % 3).cast("int").alias("start_row"), (number % 2).cast("int").alias("start_col"),
                    (number % 3 + number % 4 + 1).cast("int").alias("end_row"), (number % 600).cast("int").alias("end_col"))
    return documents.select(number, F.inline(F.array(one, many)))


def c2(spark, sf):
    lines = c1(spark, sf)
    return bucket_by_spans(lines, spans(spark, sf), ["doc_id"]).select("doc_id", "line_no", "bucket")


C2_SQL = f"""WITH lines AS ({C1_SQL}),
spans AS (SELECT doc_id, doc_id % 5 AS sr, 0 AS sc, doc_id % 5 AS er, doc_id % 400 AS ec FROM documents
  UNION ALL SELECT doc_id, doc_id % 3, doc_id % 2, doc_id % 3 + doc_id % 4 + 1, doc_id % 600 FROM documents),
hits AS (SELECT l.doc_id, l.line_no, any_value(l.line) AS line, bool_or(l.line_no > sr AND l.line_no < er) AS inner_line,
    min(CASE WHEN l.line_no = er AND sr < er THEN 0 WHEN l.line_no = sr THEN sc END) AS s,
    max(CASE WHEN l.line_no = sr AND sr < er THEN length(l.line) WHEN l.line_no = er THEN ec END) AS e
  FROM lines l LEFT JOIN spans p ON p.doc_id = l.doc_id AND l.line_no BETWEEN p.sr AND p.er GROUP BY l.doc_id, l.line_no)
SELECT doc_id, line_no, CASE WHEN NOT {O.rx('line', '[^' + O.V.SPACE + ']')} THEN 'blank' WHEN inner_line THEN 'comment'
  WHEN e IS NOT NULL AND NOT {O.rx('substr(line, 1, s)', '[^' + O.V.SPACE + ']')} AND NOT {O.rx('substr(line, (e + 1)::BIGINT)', '[^' + O.V.SPACE + ']')} THEN 'comment'
  ELSE 'code' END AS bucket FROM hits"""


def c3(spark, sf):
    """The verdict of every line of the corpus and of the web pages."""
    corpus = A.corpus(spark, sf).select(F.lit("corpus").alias("source"), F.col("doc_id").alias("id"), P.base_name(F.col("path")).alias("name"), "text")
    pages = A.page_files(spark, sf).select(
        F.lit("pages").alias("source"), F.regexp_extract("path", r"([0-9]+)\.html$", 1).cast("bigint").alias("id"),
        P.base_name(F.col("path")).alias("name"), "text")
    both = corpus.unionByName(pages).withColumn("syntax", L.syntax_name(F.col("name"), F.col("text")))
    judged = both.select("source", "id", L.line_verdicts(L.split_lines(F.col("text")), F.col("syntax")).alias("verdicts"))
    letters = F.filter(F.split("verdicts", ""), lambda letter: letter != "")
    return judged.select("source", "id", F.posexplode(letters).alias("line_no", "letter")).select(
        "source", "id", "line_no", L.bucket_name(F.col("letter")).alias("bucket"))


C3_SQL = O.with_ctes(
    f"{O.CORPUS},{O.PARTS},{PAGE_FILES}, sourced AS (SELECT doc_id, text, coalesce({O.LANGUAGE}, {O.COMMENT_SYNTAX}) AS syntax FROM named "
    f"UNION ALL SELECT -1 - page_id, text, 'markup' FROM page_files), {O.verdicts_cte('sourced', 'doc_id')}",
    """SELECT CASE WHEN doc_id < 0 THEN 'pages' ELSE 'corpus' END AS source, CASE WHEN doc_id < 0 THEN -1 - doc_id ELSE doc_id END AS id,
  (n - 1)::INT AS line_no, CASE verdict WHEN 'c' THEN 'code' WHEN 'm' THEN 'comment' ELSE 'blank' END AS bucket FROM verdicts""")


def c4(spark, sf):
    frame = A.corpus(spark, sf).withColumn("name", P.base_name(F.col("path")))
    return measured(frame).select("doc_id", "lines", "code_lines", "comment_lines", "blank_lines")


def c5(spark, sf):
    frame = A.corpus(spark, sf).withColumn("name", P.base_name(F.col("path")))
    return measured(frame).select("doc_id", "language", "tokens", "lines", "code_lines", "comment_lines", "blank_lines",
                                  "functions", "classes", "branches")


ENTRIES = [
    ("c1_split_lines", c1, C1_SQL),
    ("c2_spans_to_buckets", c2, C2_SQL),
    ("c3_marker_buckets", c3, C3_SQL),
    ("c4_line_totals", c4, O.with_ctes(O.MEASURED, "SELECT doc_id, lines, code_lines, comment_lines, blank_lines FROM files")),
    ("c5_measured_texts", c5, O.with_ctes(O.MEASURED, "SELECT doc_id, language, tokens, lines, code_lines, comment_lines, blank_lines, functions, classes, branches FROM files")),
]
