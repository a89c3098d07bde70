"""Two snapshots to one row per changed file."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from massmap.functions import classify
from massmap.functions import fixed_values as V
from massmap.functions.lines import split_lines
from massmap.functions.paths import base_name
from massmap.functions.text import TokenCounter, decoded, pre_tokens, unix_newlines
from massmap.operators.admission import in_folder_named
from massmap.operators.changes import (
    changed_paths, joined_lines, verdict_count, with_line_diff, with_renames, with_similar_renames,
)
from massmap.operators.locales import locale_levels, with_locale_copy
from massmap.session import written
from massmap.plans.scan import FILE_COLUMNS, measured, refined_kind, with_literal_share


def _named_refusal(exclude: Sequence[str]) -> Column:
    """Reasons that need no content. A submodule outranks a link here."""
    def either(mode: str) -> Column:
        return F.coalesce(F.col("before_mode") == mode, F.lit(False)) | F.coalesce(
            F.col("after_mode") == mode, F.lit(False)
        )

    return (
        F.when(in_folder_named(F.col("path"), exclude), "excluded")
        .when(either(V.SUBMODULE_MODE), "submodule")
        .when(either(V.SYMLINK_MODE), "symlink")
    )


SIDE_FIGURES = [
    "tokens", "lines", "code_lines", "comment_lines", "blank_lines", "functions", "classes", "branches",
    "literal_chars", "content_chars", "largest_literal",
]


def _side(
    changes: DataFrame, snapshot: DataFrame, keys: Sequence[str], at: str, prefix: str, max_bytes: int | None,
    tokens: TokenCounter,
) -> DataFrame:
    """Texts of one side of the changed files with every figure, or why there is no text.

    The slim change list is joined to the snapshot, so contents are filtered
    before they move, and each text is measured in the task that reads it. A
    side is judged whole, under the name it has on that side.
    """
    size = F.coalesce(F.col("size"), F.length("content").cast("bigint"))
    wanted = changes.select(*keys, "path", F.col(at).alias("__at"))
    held = snapshot.select(*keys, F.col("path").alias("__at"), "size", "content")
    found = wanted.join(held, [*keys, "__at"])
    too_large = F.lit(False) if max_bytes is None else size > max_bytes
    read = found.withColumn("__read", F.when(~too_large, decoded(F.col("content")))).select(
        *keys,
        "path",
        base_name(F.col("__at")).alias("name"),
        unix_newlines(F.col("__read.text")).alias("text"),
        F.when(F.col("content").isNull(), "unreadable")
        .when(too_large, "too-large")
        .otherwise(F.coalesce(F.col("__read.reason"), F.lit("measured")))
        .alias("reason"),
    )
    figures = with_literal_share(measured(read, tokens=tokens))
    made = F.coalesce(classify.generated_by_content(F.col("path"), F.col("text")), F.lit(False))
    return figures.select(
        *keys, "path",
        *[F.col(c).alias(f"{prefix}_{c}") for c in ("text", "reason", "language", "verdicts", *SIDE_FIGURES)],
        made.alias(f"{prefix}_made"),
    )


def changed_texts(
    changes: DataFrame, before: DataFrame, after: DataFrame, keys: Sequence[str] = ("repo",),
    exclude: Sequence[str] = (), max_bytes: int | None = None, tokens: TokenCounter = pre_tokens,
) -> DataFrame:
    """Changed paths with both texts, both measured, and ``measurement``.

    A side that does not exist is an empty text; a file either side refuses has none.
    """
    named = changes.withColumn("__refusal", _named_refusal(exclude))
    open_rows = named.where(F.col("__refusal").isNull())
    on = [*keys, "path"]
    old = _side(open_rows.where("status != 'added'"), before, keys, "base_path", "before", max_bytes, tokens)
    new = _side(open_rows.where("status != 'deleted'"), after, keys, "path", "after", max_bytes, tokens)
    joined = named.join(old, on, "left").join(new, on, "left")

    def reason(side: str, absent: str) -> Column:
        return F.when(F.col("status") == absent, "measured").otherwise(
            F.coalesce(F.col(f"{side}_reason"), F.lit("unreadable"))
        )

    first, second = reason("before", "added"), reason("after", "deleted")
    measurement = F.coalesce(F.col("__refusal"), F.when(first != "measured", first).otherwise(second))
    whole = F.col("measurement") == "measured"
    filled = {}
    for side in ("before", "after"):
        for text in ("text", "verdicts"):
            filled[f"{side}_{text}"] = F.when(whole, F.coalesce(F.col(f"{side}_{text}"), F.lit("")))
        for figure in SIDE_FIGURES:
            filled[f"{side}_{figure}"] = F.when(whole, F.coalesce(F.col(f"{side}_{figure}"), F.lit(0).cast("bigint")))
        filled[f"{side}_made"] = F.coalesce(F.col(f"{side}_made"), F.lit(False))
    sides = [f"{side}_language" for side in ("before", "after")]
    return joined.withColumn("measurement", measurement).withColumns(filled).select(
        *changes.columns, "measurement", *sides, *filled
    )


def with_both_sides(texts: DataFrame) -> DataFrame:
    """Split both sides into lines and align them."""
    return with_line_diff(
        texts.withColumns({f"{side}_line_texts": split_lines(F.col(f"{side}_text")) for side in ("before", "after")})
    )


def diff(
    before: DataFrame,
    after: DataFrame,
    keys: Sequence[str] = ("repo",),
    exclude: Sequence[str] = (),
    max_bytes: int | None = None,
    tokens: TokenCounter = pre_tokens,
    renames: bool = True,
    similar: bool = True,
) -> DataFrame:
    """One row per changed file, in the columns a scan has, plus ``capped``.

    ``renames`` pairs moved files of equal content, ``similar`` then those that
    also changed.

    Snapshots are ``(keys, path, mode, size, content[, blob])``; with ``blob``
    stored, unchanged contents are never read.
    """
    return compared(
        changed_paths(before, after, keys), before, after, after, keys, exclude, max_bytes, tokens, renames, similar
    )


def compared(
    changes: DataFrame,
    before: DataFrame,
    after: DataFrame,
    listing: DataFrame,
    keys: Sequence[str] = ("repo",),
    exclude: Sequence[str] = (),
    max_bytes: int | None = None,
    tokens: TokenCounter = pre_tokens,
    renames: bool = True,
    similar: bool = True,
) -> DataFrame:
    """As :func:`diff`, from a list of changed paths.

    ``before`` and ``after`` need no more than these paths; ``listing`` names all
    paths of the newer side, for the locale folders.
    """
    if renames:
        changes = written(with_renames(changes, keys), "changes")
    if renames and similar:
        changes = with_similar_renames(changes, before, after, keys, max_bytes=max_bytes)
    levels = locale_levels(
        listing.where(~in_folder_named(F.col("path"), exclude)).select(*keys, "path"), keys
    )
    changes = written(with_locale_copy(changes, levels, keys), "changes")  # slim rows, before they get their texts
    return file_rows(changed_texts(changes, before, after, keys, exclude, max_bytes, tokens), keys, tokens)


def file_rows(texts: DataFrame, keys: Sequence[str], tokens: TokenCounter = pre_tokens) -> DataFrame:
    path = F.col("path")
    language = F.coalesce(F.col("after_language"), F.col("before_language"))
    frame = with_both_sides(texts).withColumn("language", language)
    # What the text says of its maker: the after image, or the before image where that is empty.
    made = F.when(F.col("after_text") != "", F.col("after_made")).otherwise(F.col("before_made"))
    touched = {}
    for side, source in (("added", "after"), ("removed", "before")):
        verdicts, indices = F.col(f"{source}_verdicts"), F.col(side)
        touched[f"{side}_code_lines"] = verdict_count(verdicts, indices, "c")
        touched[f"{side}_comment_lines"] = verdict_count(verdicts, indices, "m")
        touched[f"{side}_physical_lines"] = F.size(indices).cast("bigint")
        touched[f"{side}_tokens"] = tokens(joined_lines(F.col(f"{source}_line_texts"), indices))
    frame = frame.withColumns(touched)
    frame = frame.withColumns(
        {f"{side}_lines": F.col(f"{side}_code_lines") + F.col(f"{side}_comment_lines") for side in ("added", "removed")}
    )
    frame = frame.withColumns(
        {
            **{f"churn_{m}": F.col(f"added_{m}") + F.col(f"removed_{m}") for m in ("tokens", "lines", "code_lines")},
            **{f"net_{m}": F.col(f"added_{m}") - F.col(f"removed_{m}") for m in ("tokens", "lines", "code_lines")},
            **{m: F.col(f"after_{m}") for m in SIDE_FIGURES},
            "name": base_name(path),
            "generated": classify.generated_by_path(path) | ((F.col("measurement") == "measured") & made),
            "previous_path": F.when(F.col("status") == "renamed", F.col("base_path")),
        }
    )
    frame = frame.withColumn("kind", refined_kind(path, F.col("locale_copy"), F.col("language")))
    read = F.col("measurement") == "measured"
    plain = {"path", "name", "kind", "generated", "measurement", "status", "previous_path", "before_mode", "after_mode"}
    return frame.select(
        *keys,
        *[F.col(c) if c in plain else F.when(read, F.col(c)).alias(c) for c in FILE_COLUMNS],
        F.when(read, F.col("capped")).alias("capped"),
    )
