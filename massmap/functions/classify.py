"""What a file is, from its path and its text. Column in, column out."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from massmap.functions import fixed_values as V
from massmap.functions.paths import base_name, extension, folder_names, stem
from massmap.functions.text import among, asked, fixed_list, has_content, once, one_of, quoted, trimmed, utf16_length


def under_any(path: Column, folders: list[str]) -> Column:
    return F.arrays_overlap(folder_names(path), fixed_list(folders))


# --- locales ----------------------------------------------------------------
def locale_shaped(name: Column) -> Column:
    return name.rlike(V.LOCALE_NAME)


def _locale_name() -> str:
    language, qualifier, region = (f"regexp_extract(v, {quoted(V.LOCALE_NAME)}, {group})" for group in (1, 2, 3))
    return (
        f"({among(language, V.LANGUAGE_CODES + V.LEGACY_LANGUAGE_CODES)} AND IF({region} != '', "
        f"{among(qualifier, V.SCRIPT_CODES)} AND {among(region, V.REGION_CODES)}, "
        f"{qualifier} = '' OR {among(qualifier, V.REGION_CODES + V.SCRIPT_CODES)}))"
    )


def locale_name(name: Column) -> Column:
    """A language code, alone or with a real region, script, or script and region."""
    return asked(name, _locale_name())


def regioned_locale(name: Column) -> Column:
    return asked(name, f"{_locale_name()} AND regexp_extract(v, {quoted(V.LOCALE_NAME)}, 2) != ''")


# --- tests ------------------------------------------------------------------
def named_like_test(name: Column) -> Column:
    return F.lower(name).rlike(V.TEST_PREFIX_OR_SUFFIX)


def stemmed_like_test(name: Column) -> Column:
    """Read off the name as written: the camel form is told by its capital."""
    return stem(name).rlike(V.SEPARATED_TEST_STEM) | stem(name).rlike(V.CAMEL_TEST_STEM)


# --- kind by path -----------------------------------------------------------
def kind_by_path(path: Column, locale_copy: Column) -> Column:
    """Name first, format second, place last; anything unknown is code."""
    name = base_name(path)
    lower_name = F.lower(name)
    ext = extension(lower_name)
    return (
        F.when(one_of(ext, V.I18N_EXTENSIONS), "i18n")
        .when(named_like_test(name), "test")
        .when(locale_copy, "i18n")
        .when(one_of(lower_name, V.DATA_NAMES), "data")
        .when(one_of(lower_name, V.TEXT_NAMES), "text")
        .when(one_of(ext, V.DATA_EXTENSIONS), F.when(under_any(path, V.I18N_FOLDERS), "i18n").otherwise("data"))
        .when(one_of(ext, V.TEXT_EXTENSIONS), F.when(under_any(path, V.FIXTURE_FOLDERS), "data").otherwise("text"))
        .when(
            one_of(ext, V.CODE_EXTENSIONS),
            F.when(stemmed_like_test(name) | under_any(path, V.TEST_FOLDERS), "test").otherwise("code"),
        )
        .when(one_of(ext, V.OTHER_EXTENSIONS), "other")
        .otherwise("code")
    )


def kind_by_content(
    kind: Column, path: Column, language: Column, literal_chars: Column, content_chars: Column, largest: Column
) -> Column:
    """Code that is nearly all string payload is a catalogue or data."""
    payload = (
        (kind == "code")
        & language.isNotNull()
        & ~one_of(language, V.QUOTING_LANGUAGES)
        & (content_chars >= V.MIN_CONTENT_CHARS)
        & (literal_chars >= content_chars * V.DATA_LITERAL_SHARE)
        & (largest <= literal_chars * V.MAX_LITERAL_DOMINANCE)
    )
    refiled = F.when(F.lower(path).rlike(V.I18N_PATH), "i18n").otherwise("data")
    return F.when(F.coalesce(payload, F.lit(False)), refiled).otherwise(kind)


# --- generated --------------------------------------------------------------
def content_hash(segment: Column) -> Column:
    """A bundler digest: hex with a digit and a letter, or both letter cases."""
    long_word = segment.rlike(rf"^[A-Za-z0-9_]{{{V.MIN_HASH_LENGTH},}}$")
    hexadecimal = segment.rlike("^[0-9a-f]+$")
    return long_word & F.when(hexadecimal, segment.rlike("[0-9]") & segment.rlike("[a-f]")).otherwise(
        segment.rlike("[a-z]") & segment.rlike("[A-Z]")
    )


def generated_by_path(path: Column) -> Column:
    name = base_name(path)
    lower_name = F.lower(name)
    segments = F.split(stem(name), V.STEM_SEPARATOR)
    hashed = F.exists(F.slice(segments, F.lit(2), F.size(segments)), content_hash)
    suffix = reduce(lambda left, right: left | right, [lower_name.endswith(s) for s in V.GENERATED_SUFFIXES])
    return (
        under_any(path, V.GENERATED_FOLDERS)
        | one_of(lower_name, V.GENERATED_NAMES)
        | lower_name.rlike(V.GENERATED_NAME_FAMILY)
        | suffix
        | (one_of(extension(lower_name), V.BUNDLE_EXTENSIONS) & hashed)
        | stem(name).rlike(V.GENERATED_STEM)
    )


def _head_lines(text: Column, characters: int, lines: int) -> Column:
    return F.slice(F.split(F.substring(text, 1, characters), "\n", -1), 1, lines)


def generated_header(text: Column) -> Column:
    """An opening comment line, after any notice, that says a tool wrote the file."""
    marker = "(?i)" + "|".join(f"(?:{pattern})" for pattern in V.GENERATED_HEADERS)

    def says_so(line: Column) -> Column:
        words = F.regexp_replace(F.regexp_replace(line, V.COMMENT_OPENING, ""), V.HEADER_NOTICE, "")
        return line.rlike(V.COMMENT_OPENING) & words.rlike(marker)

    # Each of the patterns holds one of these words, so most texts need no look at their lines.
    opening = F.lower(F.substring(text, 1, V.HEADER_CHARS))
    hinted = reduce(lambda left, right: left | right, [opening.contains(word) for word in V.GENERATED_HEADER_WORDS])
    return hinted & F.exists(_head_lines(text, V.HEADER_CHARS, V.HEADER_LINES), says_so)


def html_generator(path: Column, text: Column) -> Column:
    head = F.array_join(_head_lines(text, V.HTML_HEADER_CHARS, V.HTML_HEADER_LINES), "\n")
    tags = F.regexp_extract_all(head, F.lit(V.HTML_META_TAG), F.lit(0))
    return extension(F.lower(path)).isin(V.HTML_EXTENSIONS) & F.exists(
        tags, lambda tag: tag.rlike(V.HTML_GENERATOR_NAME)
    )


def source_mapped(text: Column) -> Column:
    return text.rlike(V.SOURCE_MAP_COMMENT)


def minified(text: Column) -> Column:
    """Mean length of a non-blank line, in UTF-16 units, that nobody types."""

    def long_lines(units: Column) -> Column:
        def of(held: Column) -> Column:
            least = F.size(held) * V.MIN_MINIFIED_LINE_LENGTH
            total = F.aggregate(held, F.lit(0).cast("bigint"), lambda acc, line: acc + utf16_length(trimmed(line)))
            # Trimmed lines are no longer than the text: most texts end here.
            return (F.size(held) > 0) & (units >= least) & (total >= least)

        return (units >= V.MIN_MINIFIED_CHARS) & once(F.filter(F.split(text, "\n", -1), has_content), of)

    return once(utf16_length(text), long_lines)


def generated_by_content(path: Column, text: Column) -> Column:
    bundle = extension(F.lower(path)).isin(V.BUNDLE_EXTENSIONS)
    return ~path.rlike(V.PATCH_FILE) & (
        generated_header(text) | html_generator(path, text) | (bundle & (source_mapped(text) | minified(text)))
    )


def flavor(generated: Column, kind: Column) -> Column:
    return F.when(generated, "generated").otherwise(kind)


# --- language ---------------------------------------------------------------
def interpreter(text: Column) -> Column:
    """The program a leading ``#!`` line names, without version digits; null if none."""
    line = trimmed(F.regexp_extract(text, r"^#!([^\n]*)", 1))
    words = F.filter(F.split(line, f"[{V.SPACE}]+"), lambda word: word != "")
    first = F.lower(base_name(F.get(words, F.lit(0))))
    arguments = F.filter(F.slice(words, F.lit(2), F.size(words)), lambda word: ~word.startswith("-"))
    name = F.when(first == "env", F.lower(base_name(F.get(arguments, F.lit(0))))).otherwise(first)
    plain = F.regexp_replace(name, V.INTERPRETER_VERSION, "")
    return F.when(text.startswith("#!"), F.when(plain == "", name).otherwise(plain))


def _lookup(key: Column, table: dict[str, str]) -> Column:
    """CASE by value, grouped by result so each result is one IN list."""
    by_result: dict[str, list[str]] = {}
    for known, result in table.items():
        by_result.setdefault(result, []).append(known)
    chain = F.when(F.lit(False), F.lit(None).cast("string"))
    for result, keys in by_result.items():
        chain = chain.when(one_of(key, keys), result)
    return chain


def language(name: Column, text: Column) -> Column:
    shell = F.when(one_of(interpreter(text), V.SHELL_INTERPRETERS), "bash")
    return F.coalesce(_lookup(extension(F.lower(name)), V.LANGUAGE_BY_EXTENSION), shell)


def comment_syntax(name: Column, text: Column) -> Column:
    """Name of the marker row that covers a file; null where none does."""
    lower_name = F.lower(name)
    return F.coalesce(
        F.when(lower_name.rlike(V.SYNTAX_NAME_PREFIX), "hash"),
        _lookup(lower_name, V.SYNTAX_BY_NAME),
        _lookup(extension(lower_name), V.SYNTAX_BY_EXTENSION),
        F.when(one_of(interpreter(text), V.HASH_INTERPRETERS), "hash"),
    )


