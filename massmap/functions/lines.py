"""Line verdicts of a whole text, as column expressions that stay in the JVM.

A verdict string holds one letter per physical line: ``c`` code, ``m`` comment,
``b`` blank. It is compact enough to travel with a row, and any line's verdict
is one ``substring`` away.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from massmap.functions import fixed_values as V
from massmap.functions.classify import comment_syntax, language
from massmap.functions.text import has_content, once

BUCKETS = {"c": "code", "m": "comment", "b": "blank"}
_OPENED, _OPENED_SPAN = "\x01", "\x02"
_SPAN_MARK = "="


def split_lines(text: Column) -> Column:
    """Physical lines; a final newline ends the last line and opens none."""
    lines = F.split(text, "\n", -1)
    return F.when(text == "", F.array().cast("array<string>")).otherwise(
        F.when(F.element_at(lines, -1) == "", F.slice(lines, F.lit(1), F.size(lines) - 1)).otherwise(lines)
    )


def _openers(syntax: dict) -> list[str]:
    starts = [opener for opener, _ in syntax["block"]] + syntax.get("doc", []) + syntax.get("spans", [])
    return starts + syntax["line"] + syntax["quotes"]


def marker_patterns(syntax: dict) -> dict[str, str]:
    """The regular expressions one marker row compiles to.

    All are one alternation, tried left to right at each position, so the first
    thing that opens wins. ``keep`` replaces every comment by nothing and every
    string by itself; ``state`` replaces everything by nothing but an opener
    still unclosed at the end; ``whole`` is ``keep`` for a text of many lines.
    """
    e = re.escape
    blocks = [(f"{e(o)}", e(c), e(o)) for o, c in syntax["block"]]
    docs = [(rf"\A[\s\x0B]*[rRuUbB]{{0,2}}{e(q)}", e(q), e(q)) for q in syntax.get("doc", [])]
    pairs = docs + blocks
    spans = [e(q) for q in syntax.get("spans", [])]
    # Possessive loops: Java walks them without a stack frame per character, so a
    # string of a megabyte is as safe as one of ten.
    strings = [rf"{e(q)}(?:\\.|[^{e(q)}\\])*+(?:{e(q)}|\\?\z)" for q in syntax["quotes"]]
    line_strings = [rf"{e(q)}(?:\\[^\n]|[^{e(q)}\\\n])*+(?:{e(q)}|\\|)" for q in syntax["quotes"]]
    closed = [f"{o}.*?{c}" for o, c, _ in pairs]
    to_end = [f"{o}.*" for o, _, _ in pairs]
    closed_spans = [
        f"{e(q)}.*?{e(q)}" if len(q) > 1 else rf"{e(q)}(?:\\.|[^{e(q)}\\])*+{e(q)}" for q in syntax.get("spans", [])
    ]
    open_spans = [f"{q}.*" for q in spans]
    line = [f"{e(m)}.*" for m in syntax["line"]]
    whole_line = [rf"{e(m)}[^\n]*" for m in syntax["line"]]

    def either(*groups: list[str]) -> str:
        return "|".join(item for group in groups for item in group) or r"[^\s\S]"

    whole_docs = [rf"(?:\A|\n)[ \t]*[rRuUbB]{{0,2}}{e(q)}(?:.*?{e(q)}|.*)" for q in syntax.get("doc", [])]
    whole_blocks = [f"{o}(?:.*?{c}|.*)" for o, c, _ in blocks]
    return {
        "keep": f"(?s){either(closed, to_end, line)}|({either(closed_spans, open_spans, strings)})",
        "state": f"(?s){either(closed)}|({either(to_end)})|{either(closed_spans)}|({either(open_spans)})"
        f"|{either(line, strings)}",
        "opened": f"{_OPENED}[^\"'\\x01\\x02]*?({either([raw for _, _, raw in pairs])})",
        "opened_span": f"{_OPENED_SPAN}({either(spans)})",
        "whole": f"(?s){either(whole_docs, whole_blocks, whole_line)}|({either(closed_spans, open_spans, line_strings)})",
        "hint": "[" + "".join(re.escape(m) for m in sorted({m[0] for m in _openers(syntax)} | {"\\"})) + "]",
        "carries": "true" if pairs or spans else "",
    }


PATTERNS = {name: marker_patterns(row) for name, row in {**V.SYNTAXES, **V.LANGUAGE_SYNTAXES}.items()}


def pattern_column(syntax: Column, which: str) -> Column:
    """Look a pattern up by the name of its marker row; null without one."""
    entry, pair = "\x04", "\x05"
    table = entry.join(f"{name}{pair}{patterns[which]}" for name, patterns in PATTERNS.items())
    return F.try_element_at(F.str_to_map(F.lit(table), F.lit(entry), F.lit(pair)), syntax)


def syntax_name(name: Column, text: Column) -> Column:
    """Marker row of a file: that of its language, else that of its format."""
    return F.coalesce(language(name, text), comment_syntax(name, text))


def _verdict(line: Column, keep: Column) -> Column:
    return F.when(has_content(F.regexp_replace(line, keep, F.lit("$1"))), "c").otherwise("m")


def _extract(text: Column, pattern: Column) -> Column:
    return F.call_function("regexp_extract", text, pattern, F.lit(1))


def line_verdicts(lines: Column, syntax: Column) -> Column:
    """One letter per line from comment markers.

    Only files whose marker row has pairs that may stay open take the sequential
    form; the rest judge each line alone. The sequential form reads a file of n
    lines as blocks of about sqrt(n): what is open passes from line to line and
    from block to block, and no letter is copied more than sqrt(n) times.
    """
    carrying = [name for name, patterns in PATTERNS.items() if patterns["carries"]]

    def plain_code(line: Column, row: Column) -> Column:
        """No character that could start a comment or a string: no need to look further."""
        return ~F.call_function("rlike", line, row["hint"])

    def alone(row: Column) -> Column:
        return F.array_join(
            F.transform(
                lines,
                lambda line: F.when(~has_content(line), "b")
                .when(plain_code(line, row), "c")
                .otherwise(_verdict(line, row["keep"])),
            ),
            "",
        )

    def carried(row: Column) -> Column:
        def step(acc: Column, line: Column) -> Column:
            full = F.concat(acc["open"], line)
            left = F.regexp_replace(full, row["state"], F.lit(f"{_OPENED}$1{_OPENED_SPAN}$2"))
            comment, span = _extract(left, row["opened"]), _extract(left, row["opened_span"])
            still_open = (
                F.when(comment != "", comment).when(span != "", F.concat(F.lit(_SPAN_MARK), span)).otherwise("")
            )
            added = F.struct(F.lit("").alias("open"), F.concat(acc["verdicts"], F.lit("c")).alias("verdicts"))
            judged = F.struct(
                still_open.alias("open"),
                F.concat(acc["verdicts"], _verdict(full, row["keep"])).alias("verdicts"),
            )
            blank = F.struct(acc["open"].alias("open"), F.concat(acc["verdicts"], F.lit("b")).alias("verdicts"))
            return (
                F.when(~has_content(line), blank)
                .when((acc["open"] == "") & plain_code(line, row), added)
                .otherwise(judged)
            )

        def over_blocks(held: Column) -> Column:
            """A state passes from block to block; only a block's own letters grow while its lines are read."""
            size = F.ceil(F.sqrt(F.size(held))).cast("int")

            def block(acc: Column, number: Column) -> Column:
                entered = F.struct(acc["open"].alias("open"), F.lit("").alias("verdicts"))
                read = F.aggregate(F.slice(held, number * size + 1, size), entered, step)
                return once(
                    read,
                    lambda left: F.struct(
                        left["open"].alias("open"), F.array_append(acc["blocks"], left["verdicts"]).alias("blocks")
                    ),
                )

            start = F.struct(F.lit("").alias("open"), F.array().cast("array<string>").alias("blocks"))
            blocks = F.sequence(F.lit(0), F.floor((F.size(held) - 1) / size).cast("int"))
            return F.when(F.size(held) == 0, "").otherwise(
                F.aggregate(blocks, start, block, lambda acc: F.array_join(acc["blocks"], ""))
            )

        return once(lines, over_blocks)

    row = F.struct(
        *[pattern_column(syntax, part).alias(part) for part in ("keep", "state", "opened", "opened_span", "hint")]
    )
    plain = F.array_join(F.transform(lines, lambda line: F.when(has_content(line), "c").otherwise("b")), "")
    return (
        F.when(syntax.isNull(), plain)
        .when(syntax.isin(carrying), once(row, carried))
        .otherwise(once(row, alone))
    )


def count_verdict(verdicts: Column, letter: str) -> Column:
    return (F.length(verdicts) - F.length(F.replace(verdicts, F.lit(letter), F.lit("")))).cast("bigint")


def bucket_name(letter: Column) -> Column:
    return F.when(letter == "c", "code").when(letter == "m", "comment").otherwise("blank")


# --- whole-text forms ---------------------------------------------------------
def content_without_comments(text: Column, lang: Column) -> Column:
    return F.when(
        lang.isNotNull(), F.regexp_replace(text, pattern_column(lang, "whole"), F.lit("$1"))
    )


def string_literals(text: Column, lang: Column) -> Column:
    """Every string of a source text; what looks like one inside a comment is not."""
    found = F.regexp_extract_all(text, pattern_column(lang, "whole"), F.lit(1))
    return F.when(lang.isNotNull(), F.filter(found, lambda literal: literal != ""))


def bare_code(text: Column, lang: Column) -> Column:
    """The text with comments and strings blanked, for counting declarations."""
    return F.when(lang.isNotNull(), F.regexp_replace(text, pattern_column(lang, "whole"), F.lit(" ")))


def structure_count(code: Column, lang: Column, position: int) -> Column:
    """Declarations (0), types (1) or decision points (2) by pattern; 0 without a rule."""
    chain = F.when(lang.isNull(), F.lit(0))
    for name, patterns in V.STRUCTURE_PATTERNS.items():
        if patterns[position] is not None:
            chain = chain.when(lang == name, F.regexp_count(code, F.lit(patterns[position])))
    return chain.otherwise(F.lit(0)).cast("bigint")
