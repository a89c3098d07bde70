"""Secrets in texts: exact patterns, and literals that an assignment gives to a sensitive name.

The patterns are matched in linear time. Besides, the text is lexed as source or
configuration code: names, strings, numbers, operators and brackets, whatever else it
holds. A small parser reads name-literal pairs from the tokens: ``name = "x"``,
``name: x``, ``"name": "x"``, ``name => "x"``, ``name := "x"``, ``export NAME=x``,
``--name x`` and ``name("x")``, where a literal may be joined from several strings. A
pair whose value is a name is an alias. Constants are propagated along aliases inside the
document, so a literal is scored by the most sensitive name that it reaches, not only
by the name it was first given to. What is added never overlaps a pattern's span.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from massmap.llm.common import keyed, own_id, raw_texts

KINDS = ("assign", "access", "hex", "flow")
#: A literal is a secret from this score on: what its name says plus what it looks like.
THRESHOLD = 1.0

# --- patterns -----------------------------------------------------------------------------
_WORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")
_ASSIGN = re.compile(
    r"""(?:password|passwd|secret|token|api_?key)["']?+\x20*+[:=]\x20*+["']?+([A-Za-z0-9+/_.=-]++)""", re.ASCII | re.IGNORECASE
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}+")
_HEX = re.compile(r"[0-9a-f]{24,}+")


def pattern_spans(text: str) -> list[tuple[str, int, int]]:
    """Leftmost non-overlapping matches per kind, by start, then kind.

    The part of a run that a shorter bound skips is too short for any later start in
    the same run, so the lengths are part of the patterns for access keys and hex runs.
    Not so for assignments: a match whose value is too short still uses up its text.
    """
    low = text.lower()
    found = []
    if any(word in low for word in _WORDS):
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return [(KINDS[kind], start, end) for start, kind, end in sorted(found)]


# --- lexing ---------------------------------------------------------------------------------
#: One token. Strings end on their own line, so an apostrophe in prose cannot swallow more than that line's rest.
_TOKEN = re.compile(
    r"""(?P<string>"(?:[^"\\\n]|\\.)*+"|'(?:[^'\\\n]|\\.)*+'|`[^`\n]*+`)"""
    r"""|(?P<name>--?[A-Za-z][\w-]*+|[A-Za-z_$][\w$]*+(?:[.-][A-Za-z_$][\w$]*+)*+)"""
    r"""|(?P<give>:=|=>|==+|!=|<=|>=|=|:)"""
    r"""|(?P<join>[+.]|\|\|)"""
    r"""|(?P<mark>[(){}\[\],;\n])"""
    r"""|(?P<bare>[^\s"'`(){}\[\],;=:]++)""",
    re.ASCII,
)
_BARE = re.compile(r"[^\s\"'`,;(){}\[\]]++")
#: Where code may be: a text without any of these characters gives no name anything.
_GIVES = re.compile(r"[=:(]|--")

#: What parts of a name say about a value, highest first.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 0.9, "secret": 1.0, "credential": 0.9, "credentials": 0.9,
    "apikey": 1.0, "token": 0.9, "bearer": 0.9, "pass": 0.7, "auth": 0.6, "private": 0.6, "salt": 0.6, "signing": 0.6, "access": 0.5,
    "session": 0.5, "encryption": 0.6, "key": 0.5, "api": 0.3, "client": 0.2, "license": 0.3,
}
#: What parts of a name speak against it: the name of a place, a count or a form rather than of the value itself.
HARMLESS = {
    "name", "file", "path", "dir", "url", "uri", "host", "port", "type", "size", "length", "len", "count", "max", "min", "timeout",
    "field", "label", "header", "prefix", "suffix", "format", "column", "index", "regex", "pattern", "public", "id", "hint", "message",
}
_PLACEHOLDER = re.compile(
    r"(?i)^(?:\$\{.*\}|\{\{.*\}\}|<.*>|%\(.*\)s|%s|x{3,}|\*+|\.{3,}|(?:your|my|the|some|an?)[-_ ].*|change.?me.*|example.*|"
    r"placeholder.*|dummy.*|test|todo|none|null|nil|true|false|undefined|redacted|secret|password|token)$"
)
_CAMEL = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")


def name_score(name: str) -> float:
    """How strongly a name says that its value is secret; the last parts of a name decide most."""
    parts = [part.lower() for part in _CAMEL.findall(name)]
    if not parts:
        return 0.0
    joined = [a + b for a, b in zip(parts, parts[1:])]
    weights = [SENSITIVE.get(part, 0.0) for part in (*parts, *joined)]
    score = min(max(weights) + 0.3 * (sum(weights) - max(weights)), 1.2)
    return score - (0.8 if parts[-1] in HARMLESS else 0.0)


def literal_score(value: str) -> float:
    """How much a literal looks like a generated or chosen secret; negative for words, addresses and placeholders."""
    if len(value) < 6 or len(value) > 4096 or _PLACEHOLDER.match(value) or re.search(r"\s|://", value):
        return -2.0
    kinds = sum(bool(re.search(kind, value)) for kind in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))
    if kinds == 1:  # a plain word or number
        return -0.6
    counts = Counter(value)
    entropy = -sum(n / len(value) * math.log2(n / len(value)) for n in counts.values())
    return min(0.15 * (kinds - 1) + 0.12 * (entropy - 2), 0.8)


def generated(value: str) -> bool:
    """Whether an unquoted word is a random string rather than an identifier."""
    return sum(c.isdigit() for c in value) >= 3 and literal_score(value) >= 0.45


def _tokens(text: str) -> list[tuple[str, int, int]]:
    return [(m.lastgroup, m.start(), m.end()) for m in _TOKEN.finditer(text)]


def _value(text: str, tokens: list[tuple[str, int, int]], at: int) -> tuple[str, str, int, int, int] | None:
    """The literal or name that begins at a token: (form, value, start, end, next token)."""
    if at >= len(tokens):
        return None
    kind, start, end = tokens[at]
    if kind == "string":
        value, first, last = text[start + 1 : end - 1], start + 1, end - 1
        at += 1
        while at + 1 < len(tokens) and tokens[at][0] == "join" and tokens[at + 1][0] == "string":  # "a" + "b"
            _, begin, stop = tokens[at + 1]
            value, last, at = value + text[begin + 1 : stop - 1], stop - 1, at + 2
        return "literal", value, first, last, at
    if kind == "name" and not text.startswith("-", start) and (
        at + 1 == len(tokens) or tokens[at + 1][1] > end or tokens[at + 1][0] == "mark"
    ):
        return "name", text[start:end], start, end, at + 1
    if kind in ("name", "bare"):
        whole = _BARE.match(text, start)
        while at < len(tokens) and tokens[at][1] < whole.end():
            at += 1
        return "literal", whole.group(), start, whole.end(), at
    return None


def pairs(text: str) -> Iterator[tuple[str, str, str, int, int]]:
    """(name, form, value, start, end) of everything in a text that gives a name a literal or another name."""
    tokens = _tokens(text)
    at = 0
    while at < len(tokens):
        kind, start, end = tokens[at]
        given = None
        if kind in ("name", "string"):
            name = text[start:end].strip("\"'`")
            after = tokens[at + 1] if at + 1 < len(tokens) else None
            sign = after and text[after[1] : after[2]]
            if after and after[0] == "give" and sign in ("=", ":", ":=", "=>"):
                given = _value(text, tokens, at + 2)
            elif after and sign == "(" and after[1] == end and kind == "name":
                given = _value(text, tokens, at + 2)
                if given and given[0] == "name":
                    given = None
            elif after and name.startswith("--") and "\n" not in text[end : after[1]]:
                given = _value(text, tokens, at + 1)
                if given and given[0] == "name":
                    given = ("literal", *given[1:])
            if given:
                yield name.lstrip("-"), *given[:4]
                # a value may itself be the next name (``a = b = "x"``)
                at = at + 2 if given[0] == "name" else max(given[4], at + 1)
                continue
        at += 1


def flow_spans(text: str, threshold: float = THRESHOLD) -> list[tuple[int, int]]:
    """Literals that reach a sensitive name, by start.

    A name's score is the highest of its own and of the names it is passed on to. Names
    and aliases form a graph; scores are relaxed from the highest down, each name
    settling once, so cycles end and work is linear in the aliases but for a sort.
    """
    if not _GIVES.search(text) or not any(word in text.lower() for word in SENSITIVE):
        return []
    literals: list[tuple[str, str, int, int]] = []
    unquoted: list[tuple[str, str, int, int]] = []
    sources: dict[str, set[str]] = {}
    score: dict[str, float] = {}
    for name, form, value, start, end in pairs(text):
        short = name.rsplit(".", 1)[-1]
        score.setdefault(short, name_score(name))
        score[short] = max(score[short], name_score(name))
        if form == "name":
            source = value.rsplit(".", 1)[-1]
            sources.setdefault(short, set()).add(source)
            score.setdefault(source, name_score(value))
            unquoted.append((short, value, start, end))
        else:
            literals.append((short, value, start, end))
    given = {short for short, *_ in literals} | set(sources)
    # configuration leaves quotes out: a "name" that nothing is given to may be a value
    literals += [one for one in unquoted if one[1].rsplit(".", 1)[-1] not in given and generated(one[1])]
    best: dict[str, float] = {}
    for top in sorted(score, key=lambda name: (-score[name], name)):
        waiting = [top]
        while waiting:
            name = waiting.pop()
            if name in best:
                continue
            best[name] = score[top]
            waiting.extend(sources.get(name, ()))
    return sorted(
        (start, end) for name, value, start, end in literals
        if best[name] >= 0.5 and best[name] + literal_score(value) >= threshold
    )


def spans_of(text: str, threshold: float = THRESHOLD) -> list[tuple[str, int, int, bool]]:
    """All spans by start, then kind as listed: (kind, start, end, base)."""
    base = pattern_spans(text)
    covered: list[list[int]] = []
    for _, start, end in base:
        if covered and start <= covered[-1][1]:
            covered[-1][1] = max(covered[-1][1], end)
        else:
            covered.append([start, end])
    out, at = [(start, KINDS.index(kind), end, True) for kind, start, end in base], 0
    for start, end in flow_spans(text, threshold):
        while at < len(covered) and covered[at][1] <= start:
            at += 1
        if at == len(covered) or covered[at][0] >= end:
            out.append((start, KINDS.index("flow"), end, False))
    return [(KINDS[kind], start, end, own) for start, kind, end, own in sorted(out)]


# --- application ------------------------------------------------------------------------------
def _found(threshold: float):
    kind_of = pa.list_(
        pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())])
    )

    def find(batches):
        for batch in batches:
            rows = [
                [{"kind": kind, "start": start, "end": end, "base": own} for kind, start, end, own in spans_of(raw.decode("utf-8", "replace"), threshold)]
                for raw in raw_texts(batch.column(1))
            ]
            yield pa.record_batch([batch.column(0), pa.array(rows, kind_of)], ["doc", "spans"])

    return find


def secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: the id and ``spans`` (kind, start, end, base) by start, then kind.

    Offsets are code points, the end is exclusive; ``base`` tells spans of the patterns from
    those that the assignments add (kind ``flow``: the literal without its quotes).

    A null or empty text has no spans. Null ids stay null; repeated rows are documents of
    their own. A text is one row however long it is, since a constant may be used anywhere
    in its document; work is linear in its length. Other columns are not read, so their
    names cannot clash. An empty table gives an empty result.
    """
    done = keyed(docs, id_col, text_col).mapInArrow(
        _found(threshold), "doc long, spans array<struct<kind:string,start:long,end:long,base:boolean>>"
    )
    return done.select(own_id().alias(id_col), "spans")


def digest(done: DataFrame) -> DataFrame:
    told = "array_join(transform({}, s -> concat_ws(':', s.kind, s.start, s.end)), ',')"
    count = "cast(size(filter(spans, s -> s.kind = '{0}')) as bigint) as n_{0}"
    return done.selectExpr(
        "doc_id", *[count.format(kind) for kind in KINDS[:3]],
        f"sha2({told.format('filter(spans, s -> s.base)')}, 256) as base_sha256", f"{told.format('spans')} as spans",
    )
