"""A tree of files to one row per file: tokens, lines, structure, flavor."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from massmap.functions import classify, lines
from massmap.functions import fixed_values as V
from massmap.functions.paths import base_name
from massmap.functions.text import TokenCounter, pre_tokens, solid_chars
from massmap.operators.admission import admit
from massmap.operators.locales import locale_levels, with_locale_copy

CHANGE_COUNTS = [
    *(f"{side}_{measure}" for measure in ("tokens", "lines", "code_lines") for side in ("added", "removed", "churn", "net")),
    "added_comment_lines", "removed_comment_lines", "added_physical_lines", "removed_physical_lines",
]
BEFORE_COUNTS = ["before_tokens", "before_lines", "before_code_lines"]
BEFORE_STRUCTURE = ["before_functions", "before_classes", "before_branches"]
AFTER_COUNTS = ["tokens", "lines", "code_lines", "comment_lines", "blank_lines", "functions", "classes", "branches"]
FILE_COLUMNS = [
    "path", "name", "kind", "generated", "measurement", "status", "previous_path", "before_mode", "after_mode",
    "language", *AFTER_COUNTS[:5], *BEFORE_COUNTS, *CHANGE_COUNTS, *AFTER_COUNTS[5:], *BEFORE_STRUCTURE,
]


def measured(frame: DataFrame, text: str = "text", name: str = "name", prefix: str = "",
             tokens: TokenCounter = pre_tokens) -> DataFrame:
    """Add every figure one text yields. Catalyst drops the ones nobody selects."""
    body, lang = F.col(text), F.col(f"{prefix}language")
    frame = frame.withColumn(f"{prefix}language", classify.language(F.col(name), body))
    frame = frame.withColumn(f"{prefix}syntax", F.coalesce(lang, classify.comment_syntax(F.col(name), body)))
    frame = frame.withColumn(f"{prefix}line_texts", lines.split_lines(body))
    frame = frame.withColumn(f"{prefix}verdicts", lines.line_verdicts(F.col(f"{prefix}line_texts"), F.col(f"{prefix}syntax")))
    verdicts = F.col(f"{prefix}verdicts")
    code, comment, blank = (lines.count_verdict(verdicts, letter) for letter in "cmb")
    frame = frame.withColumn(f"{prefix}bare", lines.bare_code(body, lang))
    bare = F.col(f"{prefix}bare")
    return frame.withColumns(
        {
            f"{prefix}tokens": tokens(body),
            f"{prefix}lines": code + comment,
            f"{prefix}code_lines": code,
            f"{prefix}comment_lines": comment,
            f"{prefix}blank_lines": blank,
            **{
                f"{prefix}{metric}": lines.structure_count(bare, lang, position)
                for position, metric in enumerate(("functions", "classes", "branches"))
            },
        }
    )


def with_literal_share(frame: DataFrame, text: str = "text", language: str = "language") -> DataFrame:
    """Add literal_chars, content_chars and largest_literal; 0 without a language."""
    sizes = F.transform(lines.string_literals(F.col(text), F.col(language)), solid_chars)
    frame = frame.withColumn("__sizes", sizes)
    zero = F.lit(0).cast("bigint")
    return frame.withColumns(
        {
            "literal_chars": F.coalesce(F.aggregate("__sizes", zero, lambda total, size: total + size), zero),
            "largest_literal": F.coalesce(F.array_max("__sizes"), zero),
            "content_chars": F.coalesce(
                solid_chars(lines.content_without_comments(F.col(text), F.col(language))), zero
            ),
        }
    ).drop("__sizes")


def refined_kind(path: Column, locale_copy: Column, language: Column) -> Column:
    return classify.kind_by_content(
        classify.kind_by_path(path, locale_copy), path, language,
        F.col("literal_chars"), F.col("content_chars"), F.col("largest_literal"),
    )


def scan(
    snapshots: DataFrame,
    keys: Sequence[str] = ("repo",),
    exclude: Sequence[str] = (),
    max_bytes: int | None = None,
    tokens: TokenCounter = pre_tokens,
) -> DataFrame:
    """Measure every file of ``(keys, path, mode, size, content)`` rows.

    Unmeasured files keep their row with the reason and null figures.
    """
    listing = snapshots.select(*keys, "path")
    levels = locale_levels(listing, keys)
    return scan_texts(admit(snapshots, exclude, max_bytes), levels, keys, tokens)


def scan_texts(
    admitted: DataFrame, levels: DataFrame, keys: Sequence[str] = ("repo",), tokens: TokenCounter = pre_tokens
) -> DataFrame:
    """``scan`` after admission: rows carry ``path``, ``text`` and ``measurement``."""
    named = admitted.select(*keys, "path", "measurement", "text").withColumn("name", base_name(F.col("path")))
    figures = with_literal_share(measured(named, tokens=tokens))
    made = F.coalesce(classify.generated_by_content(F.col("path"), F.col("text")), F.lit(False))
    # texts are judged where they are read; only slim rows meet the locale folders
    figures = with_locale_copy(figures.withColumn("__made", made).drop("text"), levels, keys)
    read = F.col("measurement") == "measured"
    path = F.col("path")
    zero = F.when(read, F.lit(0).cast("bigint"))
    return figures.select(
        *keys,
        "path",
        "name",
        refined_kind(path, F.col("locale_copy"), F.col("language")).alias("kind"),
        (classify.generated_by_path(path) | F.col("__made")).alias("generated"),
        "measurement",
        F.lit("unchanged").alias("status"),
        *[F.lit(None).cast("string").alias(name) for name in ("previous_path", "before_mode", "after_mode")],
        F.when(read, F.col("language")).alias("language"),
        *[F.when(read, F.col(name)).alias(name) for name in AFTER_COUNTS[:5]],
        *[zero.alias(name) for name in (*BEFORE_COUNTS, *CHANGE_COUNTS)],
        *[F.when(read, F.col(name)).alias(name) for name in AFTER_COUNTS[5:]],
        *[zero.alias(name) for name in BEFORE_STRUCTURE],
    )
