"""Line verdicts of files of any length, against a scanner that reads one character at a time."""

import random

from pyspark.sql import functions as F

from massmap.functions import lines as L


def scanned(text):
    """Letters of a file of ``//`` and ``/* */`` comments and of one-line strings."""
    letters, inside = [], False
    for line in text.split("\n")[: -1 if text.endswith("\n") else None] if text else []:
        at, code = 0, False
        while at < len(line):
            if inside:
                if line.startswith("*/", at):
                    inside, at = False, at + 1
            elif line.startswith("/*", at):
                inside, at = True, at + 1
            elif line.startswith("//", at):
                break
            elif line[at] == '"':
                code = True
                at += 1
                while at < len(line) and line[at] != '"':
                    at += 2 if line[at] == "\\" else 1
            elif line[at] != " ":
                code = True
            at += 1
        letters.append("b" if not line.strip() else "c" if code else "m")
    return "".join(letters)


def test_an_open_comment_passes_every_block(spark):
    draw = random.Random(5)
    parts = ["/*", "*/", "//", '"', '\\"', "x", " ", " y = 1;", "\n", "\n", "\n\n"]
    texts = ["", "\n", "x", "/*", "/*\n\n*/x", "/*\n" + "inner\n" * 1000 + "*/ done\n"]
    texts += ["".join(draw.choice(parts) for _ in range(draw.randrange(1, 160))) for _ in range(400)]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, text string").repartition(4)
    got = rows.select("id", L.line_verdicts(L.split_lines(F.col("text")), F.lit("cpp")).alias("letters")).collect()
    for row in got:
        assert row.letters == scanned(texts[row.id]), texts[row.id]


def test_a_null_text_has_no_verdicts(spark):
    rows = spark.createDataFrame([(None, "java"), (None, None)], "text string, syntax string")
    letters = rows.select(L.line_verdicts(L.split_lines(F.col("text")), F.col("syntax")).alias("v")).collect()
    assert {r.v for r in letters} == {None}
