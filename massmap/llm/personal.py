"""Personal data: exact patterns, and a semi-Markov CRF for spans that they miss.

The patterns are matched in linear time. Around digits and ``@`` the text is cut
into tokens, and whole candidate spans are scored by a semi-Markov CRF that is
trained on what the patterns find in a bounded sample, and on variants of it that
they cannot find. What the CRF adds never overlaps a pattern's span.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from massmap.llm.common import keyed, own_id, raw_texts
from massmap.llm.semicrf import Lattice, SemiCRF

KINDS = ("email", "ip", "card", "phone")
#: Regions of text from which the CRF learns, at most.
SAMPLE = 1200
#: An entity has at most so many tokens and characters.
MOST_TOKENS, MOST_CHARS = 24, 64
_CONTEXT = 24

_LOCAL_REVERSED = re.compile(r"[A-Za-z0-9._%+-]+")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]")


# --- patterns -----------------------------------------------------------------------------
def luhn(digits: str) -> bool:
    total = 0
    for place, digit in enumerate(reversed(digits)):
        value = int(digit) * (1 + place % 2)
        total += value - 9 if value > 9 else value
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Every ``@`` with a domain, and the run before it; no text between two of them is read twice."""
    floor, at = 0, text.find("@")
    while at >= 0:
        before = _LOCAL_REVERSED.match(text[floor:at][::-1])
        domain = _DOMAIN.match(text, at + 1) if before else None
        if domain:
            yield at - before.end(), domain.end()
        floor = domain.end() if domain else at + 1
        at = text.find("@", floor)


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def pattern_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by kind as listed, then start; failing matches are dropped without a retry."""
    out = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    if not _DIGITS.search(text):
        return out
    out += [("ip", *m.span()) for m in _IP.finditer(text) if all(map(_small, m.group().split(".")))]
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
                out.append(("phone", *m.span()))
    return out


# --- regions, tokens and candidates -----------------------------------------------------------
_TRIGGER = re.compile(r"[0-9@][A-Za-z0-9._%+@()-]*")
_BEFORE = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+@()-")
_TOKEN = re.compile(r"[0-9]+|[A-Za-z]+|[^0-9A-Za-z]")
_WORD = re.compile(r"[A-Za-z]+")


def regions(text: str) -> Iterator[tuple[int, int]]:
    """Stretches around digits and ``@``; those that only a space parts are one."""
    begin = end = -1
    for m in _TRIGGER.finditer(text):
        start = m.start()
        least = max(end, start - MOST_CHARS, 0)
        while start > least and text[start - 1] in _BEFORE:
            start -= 1
        if begin >= 0 and (start <= end or text[end:start] == " "):
            end = m.end()
            continue
        if begin >= 0:
            yield begin, end
        begin, end = start, m.end()
    if begin >= 0:
        yield begin, end


def _shape(digits_only: list[str]) -> str:
    return "-".join(str(min(len(part), 20)) for part in digits_only[:8])


def _features(kind: str, span: str, before: str, after: str, word: str) -> tuple[str, ...]:
    """What the whole span looks like, and what it stands between."""
    groups = re.findall("[0-9]+", span)
    digits = "".join(groups)
    edge = lambda c: "none" if not c else "space" if c.isspace() else "word" if c.isalnum() else c
    out = ["bias", f"before:{edge(before)}", f"after:{edge(after)}", f"word:{word}"]
    if kind == "email":
        local, _, domain = span.partition("@")
        last = domain.rsplit(".", 1)[-1]
        out += [f"labels:{min(domain.count('.') + 1, 5)}", f"ending:{min(len(last), 5)}{last.isalpha()}", f"local:{min(len(local), 8)}"]
        out.append(f"clean:{local[-1:].isalnum() and '..' not in span}")
    elif kind == "ip":
        out += [f"range:{all(map(_small, groups))}", f"zeros:{any(len(g) > 1 and g[0] == '0' for g in groups)}"]
    elif kind == "card":
        out += [f"luhn:{luhn(digits)}", f"digits:{len(digits)}", f"shape:{_shape(groups)}", f"marks:{''.join(sorted(set(span) - set('0123456789')))}"]
        out.append(f"luhn:{luhn(digits)} digits:{13 <= len(digits) <= 19}")
    else:
        out += [f"digits:{len(digits)}", f"shape:{_shape(groups)}", f"plus:{span[0] == '+'}", f"marks:{''.join(sorted(set(span) - set('0123456789')))}"]
        out.append(f"plus:{span[0] == '+'} groups:{min(len(groups), 6)}")
    return tuple(out)


_PLAIN_EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+")
_PLAIN_IP = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
_PLAIN_CARD = re.compile(r"[0-9][0-9 .-]*[0-9]")
_PLAIN_PHONE = re.compile(r"[+(]?[0-9][0-9 ().-]*[0-9]")


def _kinds(span: str) -> list[str]:
    """Kinds that a span could be at all; this keeps the lattice small."""
    digits = sum(c.isdigit() for c in span)
    out = []
    if "@" in span and _PLAIN_EMAIL.fullmatch(span):
        out.append("email")
    if span.count(".") == 3 and _PLAIN_IP.fullmatch(span):
        out.append("ip")
    if 12 <= digits <= 19 and _PLAIN_CARD.fullmatch(span):
        out.append("card")
    if 7 <= digits <= 15 and _PLAIN_PHONE.fullmatch(span):
        out.append("phone")
    return out


def lattice_of(text: str, begin: int, end: int) -> tuple[Lattice, list[int]]:
    """Candidates of a region, and where its tokens begin in the text (with the region's end)."""
    places = [begin + m.start() for m in _TOKEN.finditer(text[begin:end])] + [end]
    n = len(places) - 1
    ending: list[list[tuple[int, str, tuple[str, ...]]]] = [[] for _ in range(n + 1)]
    words = _WORD.findall(text[max(0, begin - _CONTEXT) : begin])
    word = words[-1].lower() if words else ""
    for i in range(n):
        first = text[places[i]]
        if not (first.isalnum() or first in "+("):
            continue
        for j in range(i + 1, min(n, i + MOST_TOKENS) + 1):
            if places[j] - places[i] > MOST_CHARS:
                break
            if not text[places[j] - 1].isalnum():
                continue
            span = text[places[i] : places[j]]
            for kind in _kinds(span):
                before = text[places[i] - 1] if places[i] else ""
                after = text[places[j]] if places[j] < len(text) else ""
                ending[j].append((i, kind, _features(kind, span, before, after, word)))
    return Lattice(n, ending), places


# --- training ---------------------------------------------------------------------------------
def _cuts(batches):
    """Regions with some context, cut to a bounded length, and a hash to choose among them."""
    for batch in batches:
        out = []
        for doc, raw in zip(batch.column(0).to_pylist(), raw_texts(batch.column(1))):
            text = raw.decode("utf-8", "replace")
            for begin, end in regions(text):
                cut = text[max(0, begin - _CONTEXT) : min(end, begin + 300) + 8]
                out.append((xxhash.xxh64_intdigest(cut.encode(), 1) - (1 << 63), cut))
        # of one batch no more than the whole sample can be chosen
        out = sorted(set(out))[:SAMPLE]
        yield pa.record_batch(
            [pa.array([row[0] for row in out], pa.int64()), pa.array([row[1] for row in out], pa.string())], ["rank", "cut"]
        )


def _replaced(text: str, spans: list[tuple[str, int, int]], at: int, new: str, tail: str = ""):
    """The text with span ``at`` written as ``new`` and followed by ``tail``; all spans moved along."""
    kind, a, b = spans[at]
    more = len(new) + len(tail) - (b - a)
    moved = [(k, x + more, y + more) if x >= b else (k, x, y) for n, (k, x, y) in enumerate(spans) if n != at]
    return text[:a] + new + tail + text[b:], [*moved, (kind, a, a + len(new))]


def _variants(text: str, spans: list[tuple[str, int, int]]) -> Iterator[tuple[str, list[tuple[str, int, int]]]]:
    """The text itself, and forms of it that the patterns miss: no country code, dots, a number beside it."""
    yield text, spans
    for at, (kind, a, b) in enumerate(spans):
        found = text[a:b]
        number = str(xxhash.xxh32_intdigest(found.encode()) % 10 ** (2 + at % 5))
        if kind == "phone" and (cut := re.match(r"\+[0-9]{1,3} ", found)) and len(found) - cut.end() >= 10:
            yield _replaced(text, spans, at, found[cut.end() :])
            yield _replaced(text, spans, at, found[cut.end() :], " " + number)
        if kind == "card" and len(found) == 16 and found.isdigit():
            yield _replaced(text, spans, at, ".".join(found[k : k + 4] for k in range(0, 16, 4)))
            yield _replaced(text, spans, at, found, " " + number)


def _doubtful(text: str) -> bool:
    """A chain of digit groups that is no card as a whole but holds one says nothing about cards."""
    chains = [m.group() for m in _CARD.finditer(text)]
    return any(
        13 <= len(run) <= 19 and luhn(run) for chain in chains for run in re.findall("[0-9]+", chain) if run != chain
    )


def _example(text: str, spans: list[tuple[str, int, int]]):
    for begin, end in regions(text):
        lattice, places = lattice_of(text, begin, end)
        token = {place: k for k, place in enumerate(places)}
        gold, last = [], 0
        for kind, a, b in sorted(spans, key=lambda span: span[1]):
            if a in token and b in token and token[a] >= last:
                gold.append((token[a], token[b], kind))
                last = token[b]
        yield lattice, gold


def trained(cuts: list[str]) -> SemiCRF:
    examples = [
        example for cut in cuts if not _doubtful(cut) for text, spans in _variants(cut, pattern_spans(cut)) for example in _example(text, spans)
    ]
    return SemiCRF(KINDS).fit(examples)


def train(docs: DataFrame, text_col: str = "text", *, sample: int = SAMPLE) -> SemiCRF:
    """Learn from at most ``sample`` regions: those with the smallest hashes, so reruns agree."""
    cuts = docs.select(F.lit(0).cast("bigint").alias("doc"), F.col(text_col).alias("text")).mapInArrow(
        _cuts, "rank long, cut string"
    )
    rows = cuts.distinct().orderBy("rank", "cut").limit(sample).collect()
    return trained([row.cut for row in rows])


# --- application --------------------------------------------------------------------------------
def model_spans(text: str, model: SemiCRF, taken: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Entities of the best segmentation of each region that overlap no taken span."""
    ordered = sorted((a, b) for _, a, b in taken)
    at, out = 0, []
    for begin, end in regions(text):
        lattice, places = lattice_of(text, begin, end)
        if not any(lattice.ending):
            continue
        while at < len(ordered) and ordered[at][1] <= begin:
            at += 1
        for i, j, kind in model.best(lattice):
            a, b = places[i], places[j]
            k = at
            while k < len(ordered) and ordered[k][0] < b and ordered[k][1] <= a:
                k += 1
            if k == len(ordered) or ordered[k][0] >= b:
                out.append((kind, a, b))
    return out


def _found(model: SemiCRF):
    kind_of = pa.list_(
        pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())])
    )

    def find(batches):
        for batch in batches:
            rows = []
            for raw in raw_texts(batch.column(1)):
                text = raw.decode("utf-8", "replace")
                base = pattern_spans(text)
                more = model_spans(text, model, base)
                spans = [(KINDS.index(kind), a, b, True) for kind, a, b in base]
                spans += [(KINDS.index(kind), a, b, False) for kind, a, b in more]
                rows.append([{"kind": KINDS[k], "start": a, "end": b, "base": own} for k, a, b, own in sorted(spans)])
            yield pa.record_batch([batch.column(0), pa.array(rows, kind_of)], ["doc", "spans"])

    return find


def personal_data(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, model: SemiCRF | None = None, sample: int = SAMPLE
) -> DataFrame:
    """One row per document: the id and ``spans`` (kind, start, end, base) by kind, then start.

    Offsets are code points, the end is exclusive; ``base`` tells spans of the patterns
    from those that the CRF adds. Without a ``model`` one is trained on the documents.

    A null or empty text has no spans. Null ids stay null; repeated rows are documents
    of their own. Other columns are not read, so their names cannot clash. An empty table
    gives an empty result.
    """
    model = model or train(docs, text_col, sample=sample)
    done = keyed(docs, id_col, text_col).mapInArrow(
        _found(model), "doc long, spans array<struct<kind:string,start:long,end:long,base:boolean>>"
    )
    return done.select(own_id().alias(id_col), "spans")


def digest(done: DataFrame) -> DataFrame:
    base = F.filter("spans", lambda s: s["base"])
    told = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("bigint")

    return done.select(
        "doc_id", *[count(kind).alias(f"n_{kind}") for kind in KINDS], F.sha2(told(base), 256).alias("base_sha256"),
        told(F.col("spans")).alias("spans"),
    )
