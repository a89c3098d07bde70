"""Columns over whole texts: trimming, lengths, decoding, counting."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from massmap.functions.fixed_values import BINARY_CONTROLS, PRE_TOKEN, SPACE


def quoted(value: str) -> str:
    """A string as it stands in SQL."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def asked(value: Column, condition: str) -> Column:
    """A condition on one value ``v``, stated as SQL: the plan takes it in one piece instead of a call per part."""
    return F.call_function("exists", F.array(value), F.expr(f"v -> {condition}"))


def among(value: str, listed: list[str]) -> str:
    """Membership in a fixed list as SQL; Spark makes a long list a hash set."""
    return f"{value} IN ({', '.join(map(quoted, listed))})"


def one_of(value: Column, listed: list[str]) -> Column:
    """Membership in a fixed list: a hash set built once."""
    return asked(value, among("v", listed))


def fixed_list(listed: list[str]) -> Column:
    """A fixed list as an array; constant folding turns it into one literal."""
    return F.split(F.lit(",".join(listed)), ",")


def once(value: Column, use: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once per row and use it in many places."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def has_content(text: Column) -> Column:
    """True where anything but white space (Unicode, with BOM) is left."""
    return text.rlike(f"[^{SPACE}]")


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, rf"^[{SPACE}]+|[{SPACE}]+\z", "")


def utf16_length(text: Column) -> Column:
    """Length in UTF-16 code units; every size threshold counts in them."""
    return (F.length(F.encode(text, "UTF-16BE")) / 2).cast("bigint")


def unix_newlines(text: Column) -> Column:
    """CRLF to LF. Both sides of a comparison get this, a plain scan does not."""
    return F.regexp_replace(text, "\r\n", "\n")


def solid_chars(text: Column) -> Column:
    """Characters above the space character, in UTF-16 units."""
    return utf16_length(F.regexp_replace(text, r"[\x00-\x20]+", ""))


def pre_tokens(text: Column) -> Column:
    """Default token unit: letter runs, digit groups up to three, symbol runs, space runs.

    Every character belongs to one unit, so a text whose units are one letter each is as long as
    it has units; none of them is kept as a string of its own.
    """
    return F.length(F.regexp_replace(text, PRE_TOKEN, "u")).cast("bigint")


TokenCounter = Callable[[Column], Column]


def vocabulary_counter(load_encoder: Callable[[], object]) -> TokenCounter:
    """Token counter over a user's own vocabulary, as an Arrow-batched UDF.

    ``load_encoder`` runs once per Python worker and returns an object whose
    ``encode_ordinary(text)`` gives the tokens; control-token spellings count
    as ordinary text.
    """
    import pandas as pd

    def count(batches):
        encoder = load_encoder()
        for batch in batches:
            yield batch.map(lambda text: None if text is None else len(encoder.encode_ordinary(text)))

    # Real classes, not postponed strings: pandas_udf reads them to pick its kind.
    from collections.abc import Iterator

    count.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(count, "bigint")


def byte_order(content: Column) -> Column:
    """``utf-16le``, ``utf-16be`` or ``utf-8``, from the first two bytes."""
    head = F.hex(F.substring(content, 1, 2))
    return F.when(head == "FFFE", "utf-16le").when(head == "FEFF", "utf-16be").otherwise("utf-8")


def _valid_utf16(content: Column, big_endian: bool) -> Column:
    """Whole code units only, and surrogates only as high-low pairs."""
    units = F.regexp_replace(F.hex(content), "(....)", "$1 ")
    high, low, any_half = (
        ("D[89AB]..", "D[CDEF]..", "D[89A-F]..") if big_endian else ("..D[89AB]", "..D[CDEF]", "..D[89A-F]")
    )
    unpaired = F.regexp_replace(units, f"{high} {low} ", "").rlike(f"{any_half} ")
    return (F.length(content) % 2 == 0) & ~unpaired


def decoded(content: Column) -> Column:
    """``struct<text, reason>``: the text without its BOM, or why there is none."""
    order = byte_order(content)
    units = F.substring(content, 3, 2147483647)
    text = (
        F.when(order == "utf-16le", F.when(_valid_utf16(units, False), F.decode(units, "UTF-16LE")))
        .when(order == "utf-16be", F.when(_valid_utf16(units, True), F.decode(units, "UTF-16BE")))
        .when(F.hex(F.substring(content, 1, 3)) == "EFBBBF", F.try_validate_utf8(F.substring(content, 4, 2147483647).cast("string")))
        .otherwise(F.try_validate_utf8(content.cast("string")))
    )
    has_nul = (order == "utf-8") & F.contains(content, F.lit(b"\x00"))

    def judged(text: Column) -> Column:
        return (
            F.when(has_nul, "binary")
            .when(text.isNull(), "unsupported-encoding")
            .when(text.rlike(BINARY_CONTROLS), "binary")
        )

    def read(text: Column) -> Column:
        reason = lambda why: F.struct(F.when(why.isNull(), text).alias("text"), why.alias("reason"))
        return once(judged(text), reason)

    return once(text, read)
