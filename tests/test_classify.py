import pytest
from pyspark.sql import functions as F

from massmap.functions import classify as C
from massmap.functions import lines as L
from massmap.functions import text as T
from massmap.operators.locales import locale_levels, with_locale_copy

KINDS = {
    "src/app.ts": "code", "Tool.scala": "code", "src/FooTest.scala": "code", "api/LedgerTest.java": "test",
    "lib/basket-spec.js": "test", "contest.rb": "code", "tests/conftest.py": "test", "tests/page.html": "other",
    "tests/fixtures/events.json": "data", "docs/testdata/out.txt": "data", "docs/guide.rst": "text", "LICENSE": "text",
    "go.mod": "data", "po/de.po": "i18n", "app/i18n/strings.json": "i18n", "app/i18n/reader.go": "code",
    "content/pt_BR/index.md": "i18n", "config/da_map.yml": "data", "test_notes.md": "test", ".env": "code",
}


def test_kinds(spark):
    frame = spark.createDataFrame([("r", path) for path in KINDS], "repo string, path string")
    judged = with_locale_copy(frame, locale_levels(frame))
    got = {r.path: r.kind for r in judged.select("path", C.kind_by_path(F.col("path"), F.col("locale_copy")).alias("kind")).collect()}
    assert got == KINDS


def test_locale_levels_need_company(spark):
    paths = ["site/en/a.md", "site/fr/a.md", "site/de/a.md", "cmp/lt.md", "cmp/ne.md", "cmp/conditional.md", "locales/xx.json"]
    frame = spark.createDataFrame([("r", path) for path in paths], "repo string, path string")
    assert {r.folder for r in locale_levels(frame).collect()} == {"site", "locales"}


@pytest.mark.parametrize("text, expected", [
    ("// Code generated by \"x\"; DO NOT EDIT.\n", True), ("# @generated\n", True), ("@Generated()\nclass A {}\n", False),
    ("/* Warning: this file is auto-generated */\n", True), ("// values generated at runtime\n", False),
    ("\n" * 8 + "# @generated\n", False),
])
def test_headers(spark, text, expected):
    assert spark.range(1).select(C.generated_header(F.lit(text))).collect()[0][0] is expected


def test_interpreters(spark):
    texts = ["#!/bin/bash\n", "#!/usr/bin/env -S python3.12 -u\n", "#!/usr/bin/perl5\nx", "#! \n", "x"]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in frame.select(C.interpreter(F.col("t"))).collect()] == ["bash", "python", "perl", None, None]


LINES = [
    ("a.swift", 'let a = "/* not a comment"\nlet b = 1 // note\n/* open\n\nstill */ let c = 2\n', "cc" "mbc"),
    ("a.lua", "--[[ long\nremark ]]\nx = 1 -- note\n-- whole\n", "mmcm"),
    ("a.css", "/* a */\n// kept as code\nb {}\n", "mcc"),
    ("a.html", "<!-- a\n\nb -->\n<p title=\"<!--\">x</p>\n", "mbmc"),
    ("a.properties", "! note\n# note\nk='#'\n", "mmc"),
    ("notes.md", "# head\n\ntext", "cbc"),
    ("Dockerfile.dev", "# a\nRUN x # y\n", "mc"),
    ("a.py", '"""Doc\nmore\n"""\nq = """\n# in a string\n"""\nx = 1\n', "mmmcccc"),
    ("never.less", "a {}\n/* open\nb\n", "cmm"),
    ("empty.ts", "", ""),
]


def test_verdicts(spark):
    frame = spark.createDataFrame(LINES, "name string, text string, expected string")
    got = frame.withColumn("syntax", L.syntax_name(F.col("name"), F.col("text"))).select(
        "name", "expected", L.line_verdicts(L.split_lines(F.col("text")), F.col("syntax")).alias("verdicts"))
    assert [(r.name, r.verdicts) for r in got.collect()] == [(r.name, r.expected) for r in got.collect()]


def test_long_strings_do_not_overflow(spark):
    text = 'x = "' + "a\\" * 200_000 + '" // tail\n'
    frame = spark.createDataFrame([("a.kt", text), ("b.js", "`" + "y" * 400_000 + "\n// in a string\n`\n")], "name string, text string")
    got = frame.withColumn("syntax", L.syntax_name(F.col("name"), F.col("text"))).select(
        L.line_verdicts(L.split_lines(F.col("text")), F.col("syntax")).alias("v")).collect()
    assert [r.v for r in got] == ["c", "ccc"]


def test_decoding(spark):
    cases = [
        (b"plain", "plain", None), (b"\xff\xfea\x00", "a", None), (b"\xfe\xff\x00a", "a", None), (b"\xef\xbb\xbfx", "x", None),
        (b"a\x00", None, "binary"), (b"\xe9 ", None, "unsupported-encoding"), (b"a\x07", None, "binary"), (b"", "", None),
        (b"\xff\xfe\x00\xd8a\x00", None, "unsupported-encoding"), (b"\xff\xfe\x3d\xd8\x00\xde", "\U0001f600", None),
    ]
    frame = spark.createDataFrame([(at, c[0]) for at, c in enumerate(cases)], "at int, content binary")
    got = {r.at: (r.d.text, r.d.reason) for r in frame.select("at", T.decoded(F.col("content")).alias("d")).collect()}
    assert got == {at: c[1:] for at, c in enumerate(cases)}


def test_one_of_never_matches_across_entries(spark):
    frame = spark.createDataFrame([("a",), ("a,b",), ("",), (None,)], "v string")
    assert [r[0] for r in frame.select(T.one_of(F.col("v"), ["a", "b"])).collect()] == [True, False, False, None]
