"""The given tables as the inputs the operators read.

``corpus`` lays documents out as the files of many repositories, ``page_files``
does the same with web pages, ``revisions`` makes two snapshots to compare, and
``commits`` with ``commit_snapshots`` read conversations as commit histories.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# 31 folders, 43 names and 13 headers: coprime counts, so documents meet every mix.
FOLDERS = [
    "src", "src/app", "src/app/core", "lib/util", "tests", "tests/unit", "docs", "docs/guide", "locales",
    "locales/en", "i18n/de", "content/zh-cn", "content/en", "config", "fixtures/golden", "test/fixtures/data",
    "dist", "src/generated", "web/static/js", "packages/api/__generated__", "src/main/java/com/acme",
    "src/test/java/com/acme", "scripts", "styles", "data", "translations", "src/id", "lang/fr", "src/intl",
    "coverage", "vendor/node_modules",
]
NAMES = [
    "main.ts", "util.py", "README.md", "index.html", "app.css", "config.json", "messages.po", "fr.json",
    "pt_BR.json", "service_test.go", "test_api.py", "LedgerTest.java", "ParcelTests.kt", "basket-spec.js",
    "contest.rb", "LICENSE", "requirements.txt", "go.sum", "package-lock.json", "bundle.min.js",
    "panel-Qm7XbW2k.js", "shell.5e81d40f.js", "MyComponent.js", "chunk.20240101.js", "types.gen.lua",
    "contracts.generated.ts", "album_gen.md", "Dockerfile", "Makefile", ".env", ".pnp.cjs", "build.sh", "run",
    "schema.sql", "notes.txt", "diagram.svg", "page.vue", "settings.yaml", "en.yml", "zh_Hant_TW.md", "fix.patch",
    "init.lua", "main.tf",
]
HEADERS = [
    "", '// Code generated by "tool"; DO NOT EDIT.\n', "#!/usr/bin/env -S python3.12 -u\n",
    "/* block\n   comment */ x = 1;\n", "# note\n", "<!-- markup\n\n comment -->\n", "s = 'a # b // c /* d'\n",
    "-- remark\n--[[ long\nremark ]] y = 2\n", "<html><head><meta content=\"x\" name=\"generator\" ></head>\n",
    "#!/bin/bash -e\n", "\"\"\"doc\nstring\"\"\"\ndef f(a):\n    return 'x' if a else \"y\"\n",
    "//# sourceMappingURL=x.map\n", "/* never closed\n",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(frame: DataFrame) -> DataFrame:
    """Deal rows out to the number of tasks the session asks for in ``massmap.input.partitions``.

    A table of one file is one task, however many cores wait. Without the setting
    the files split by themselves and nothing is shuffled; data sizes play no part.
    """
    asked = frame.sparkSession.conf.get("massmap.input.partitions", None)
    return frame.repartition(int(asked)) if asked else frame


def _pick(values: list[str], number: Column) -> Column:
    return F.get(F.array(*[F.lit(value) for value in values]), (number % len(values)).cast("int"))


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(repo, doc_id, path, text): every document once, whole, as a source file."""
    number = F.col("doc_id")
    module = F.floor(number / (len(FOLDERS) * len(NAMES)))
    return spread(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).select(
        F.col("source").alias("repo"),
        "doc_id",
        F.concat(F.lit("m"), module, F.lit("/"), _pick(FOLDERS, number), F.lit("/"), _pick(NAMES, number)).alias("path"),
        F.concat(_pick(HEADERS, number), F.col("text")).alias("text"),
    )


def admitted_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus(spark, sf_dir).withColumn("measurement", F.lit("measured"))


def language_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as ``source/lang/id.txt``: folders that hold one entry per language."""
    return table(spark, sf_dir, "documents").select(
        F.lit("all").alias("repo"),
        F.concat_ws("/", "source", "lang", F.concat("doc_id", F.lit(".txt"))).alias("path"),
        "text",
    )


def page_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(repo, path, text): one repository per host, the page under its url path."""
    place = F.regexp_replace(F.regexp_replace("url", "^https?://", ""), "[?#].*$", "")
    place = F.regexp_replace(place, "/+$", "")
    return spread(table(spark, sf_dir, "pages")).select(
        F.regexp_extract(place, "^([^/]+)", 1).alias("repo"),
        F.concat(F.regexp_replace(place, "^[^/]+/?", ""), F.lit("/"), F.col("page_id"), F.lit(".html")).alias("path"),
        F.col("html").alias("text"),
    )


MODES = ["100644", "100755", "100644", "120000", "100644", "160000", "100644"]


def byte_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(repo, doc_id, path, mode, size, content): the corpus as bytes in many encodings."""
    form = F.col("doc_id") % 11
    utf8 = F.col("text").cast("binary")
    content = (
        F.when(form == 1, F.concat(F.unhex(F.lit("FFFE")), F.encode("text", "UTF-16LE")))
        .when(form == 2, F.concat(F.unhex(F.lit("FEFF")), F.encode("text", "UTF-16BE")))
        .when(form == 3, F.concat(F.unhex(F.lit("EFBBBF")), utf8))
        .when(form == 4, F.concat(utf8, F.unhex(F.lit("00"))))
        .when(form == 5, F.concat(utf8, F.unhex(F.lit("E920"))))
        .when(form == 6, F.concat(utf8, F.unhex(F.lit("07"))))
        .when(form == 7, F.lit(None).cast("binary"))
        .otherwise(utf8)
    )
    return (
        corpus(spark, sf_dir)
        .withColumn("mode", _pick(MODES, F.col("doc_id")))
        .withColumn("content", content)
        .withColumn("size", F.length("content").cast("bigint"))
        .select("repo", "doc_id", "path", "mode", "size", "content")
    )


def revisions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Two snapshots ``(repo, path, mode, size, content)`` of the documents.

    Of every ten documents one is only before, one only after, one moves
    unchanged, one stays, and the rest lose and change lines.
    """
    number = F.col("doc_id")
    part = F.concat(F.lit("part"), number % 7)
    name = F.concat(number, _pick([".md", ".py", ".ts", ".css", ".html", ".sql", ".yaml", ".test.js", ".json"], number))
    path = F.concat_ws("/", part, _pick(["src", "docs", "lib/core", "dist", "tests"], number), name)
    documents = spread(table(spark, sf_dir, "documents").select("doc_id", "source", "text")).select(
        F.col("source").alias("repo"), number, path.alias("path"), "text"
    )
    case = number % 10
    lines = F.split("text", "\n", -1)
    edited = F.array_join(
        F.filter(
            F.transform(
                lines, lambda line, at: F.when(at % 7 == 3, None).when(at % 11 == 5, F.concat(line, F.lit(" +"))).otherwise(line)
            ),
            lambda line: line.isNotNull(),
        ),
        "\n",
    )
    before = documents.where(case != 1).select("repo", "path", F.col("text").alias("body"))
    moved = F.when(case == 3, F.concat(F.lit("moved/"), "path")).otherwise(F.col("path"))
    after = documents.where(case != 2).select(
        "repo", moved.alias("path"), F.when(case.isin(1, 3, 4), F.col("text")).otherwise(edited).alias("body")
    )
    return _as_snapshot(before), _as_snapshot(after)


def _as_snapshot(frame: DataFrame) -> DataFrame:
    content = F.col("body").cast("binary")
    return frame.withColumn("mode", F.lit("100644")).withColumn("size", F.length(content).cast("bigint")).withColumn(
        "content", content
    ).drop("body")


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(repo, sha, parents, author, author_date, message): one commit per conversation turn."""
    turns = table(spark, sf_dir, "conversations")
    sha = F.concat(F.col("conv_id"), F.lit(":"), F.col("turn"))
    parent = F.concat(F.col("conv_id"), F.lit(":"), F.col("turn") - 1)
    return turns.select(
        F.col("conv_id").cast("string").alias("repo"),
        sha.alias("sha"),
        F.when(F.col("turn") == 0, F.array().cast("array<string>")).otherwise(F.array(parent)).alias("parents"),
        F.col("role").alias("author"),
        F.timestamp_seconds(F.col("turn") * 3600 + F.col("conv_id")).alias("author_date"),
        F.col("text").alias("message"),
    )


def commit_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(repo, rev, path, mode, size, content): a revision holds its turn and the one before.

    A commit therefore adds one file, edits two (one of them generated) and, from
    the third on, deletes one.
    """
    turns = table(spark, sf_dir, "conversations")
    places = F.array(
        F.struct(F.lit(0).alias("shift"), F.concat(F.lit("turns/"), F.col("turn"), F.lit(".md")).alias("path")),
        F.struct(F.lit(0).alias("shift"), F.lit("notes.md").alias("path")),
        F.struct(F.lit(0).alias("shift"), F.lit("dist/notes.md").alias("path")),
        F.struct(F.lit(1).alias("shift"), F.concat(F.lit("turns/"), F.col("turn"), F.lit(".md")).alias("path")),
    )
    spread = turns.select("conv_id", "turn", "text", F.explode(places).alias("place"))
    rows = spread.select(
        F.col("conv_id").cast("string").alias("repo"),
        F.concat(F.col("conv_id"), F.lit(":"), F.col("turn") + F.col("place.shift")).alias("rev"),
        F.col("place.path").alias("path"),
        F.col("text").alias("body"),
    )
    return _as_snapshot(rows)
