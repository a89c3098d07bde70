"""Contents are decoded once a row, and cheaper forms count as the plain ones do."""

from pyspark.sql import functions as F

from massmap.functions import classify
from massmap.functions import fixed_values as V
from massmap.functions import text as T
from massmap.operators import similar

ODD = ["", " ", "a", "a1b22c4444", "ß ſ İK", "x\x0b\t\r\n y", "١٢٣٤٥ ok", "é!?  __", "😀😀 z", "﻿a﻿", "a b　　c", "½²\x00\x7f"]


def plan(frame):
    return frame._jdf.queryExecution().optimizedPlan().toString()


def test_contents_are_decoded_once_a_row(spark, tmp_path):
    spark.createDataFrame([("r", "a", b"one\n")], "repo string, path string, content binary").write.parquet(str(tmp_path / "c"))
    held = spark.read.parquet(str(tmp_path / "c"))
    read = held.withColumn("__read", T.decoded(F.col("content"))).select("path", "__read.text", "__read.reason")
    assert plan(read).count("[\\x00-\\x08") == 1
    snapshot = held.withColumn("size", F.length("content").cast("bigint"))
    lines = similar.lines_by_code(held.select("repo", "path"), snapshot, ["repo"], None)
    assert plan(lines).count("[\\x00-\\x08") == 1
    assert [tuple(r) for r in lines.select("path", "bytes").orderBy("bytes").collect()] == [("a", 1), ("a", 4)]


def test_decoding_of_odd_bytes(spark):
    cases = [
        (b"", "", None), (b"\xef\xbb\xbf", "", None), (b"\xef\xbb\xbfa\n", "a\n", None), (b"\xef\xbb\xbf\xef\xbb\xbfa", "﻿a", None),
        (b"a\xef\xbb\xbf", "a﻿", None), (b"\xef\xbba", None, "unsupported-encoding"), (b"\xef\xbb\xbf\xe9 ", None, "unsupported-encoding"),
        (b"a\x00b", None, "binary"), (b"a\x07b", None, "binary"), (b"\xff\xfea\x00", "a", None), (b"\xfe\xff\x00a", "a", None),
        (b"\xff\xfe\x00\xd8", None, "unsupported-encoding"), (b"\xff\xfe\x07\x00", None, "binary"), (None, None, "unsupported-encoding"),
    ]
    frame = spark.createDataFrame([(n, case[0]) for n, case in enumerate(cases)], "n int, content binary")
    got = frame.select("n", T.decoded(F.col("content")).alias("d")).select("n", "d.text", "d.reason").orderBy("n").collect()
    assert [(r.text, r.reason) for r in got] == [case[1:] for case in cases]


def test_units_are_counted_as_the_pattern_finds_them(spark):
    frame = spark.createDataFrame([(text,) for text in [*ODD, "".join(ODD), None]], "t string")
    rows = frame.select(T.pre_tokens(F.col("t")).alias("got"), F.regexp_count("t", F.lit(V.PRE_TOKEN)).alias("plain")).collect()
    assert all(r.got == r.plain for r in rows) and rows[3].got == 7
    assert "regexp_extract_all" not in plan(frame.select(T.pre_tokens(F.col("t"))))


def test_minified_is_the_mean_of_trimmed_lines(spark):
    long, short = "x" * 999, "y"
    texts = ["", " " * 3000, long, f"{long}\n{long}\n{long}", f" {long}\t\n\n\n{long}　\n  \n{long}", f"{long}\n{long}\n{long}\n" + f"{short}\n" * 3,
             f"{long}\n{long}\n{long}\n" + f"{short}\n" * 2, "😀" * 1000, "  a" * 700 + "\n" + " " * 5000, "a\n" + " " * 3000 + "\nb", None]

    def plain(text):
        if text is None:
            return None
        units = lambda s: len(s.encode("utf-16-be")) // 2
        lengths = [n for n in (units(line.strip(" \t　")) for line in text.split("\n")) if n]
        return bool(units(text) >= V.MIN_MINIFIED_CHARS and lengths and sum(lengths) >= len(lengths) * V.MIN_MINIFIED_LINE_LENGTH)

    frame = spark.createDataFrame(list(enumerate(texts)), "n int, t string")
    got = [r[0] for r in frame.orderBy("n").select(classify.minified(F.col("t"))).collect()]
    assert got == [plain(text) for text in texts] and True in got


def test_every_header_pattern_asks_for_a_hint_word(spark):
    assert all(any(word in pattern.replace(r"\b", " ").lower() for word in V.GENERATED_HEADER_WORDS) for pattern in V.GENERATED_HEADERS)
    lines = ["// Code GENERATED by x", "# Any Modifications to this file WILL BE LOST", "# DO NOT EDIT: machine generated", "# nothing", "x = 'generated'", None]
    frame = spark.createDataFrame([(n, line) for n, line in enumerate(lines)], "n int, t string")
    got = [r[0] for r in frame.orderBy("n").select(classify.generated_header(F.col("t"))).collect()]
    assert got == [True, True, True, False, False, None]
