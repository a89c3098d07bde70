import itertools
import math
import random
import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from massmap.llm import personal
from massmap.llm.semicrf import OUTSIDE, Lattice, SemiCRF
from tests.llm.brute import sha

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def by_definition(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            fine = {
                "email": True,
                "ip": kind == "ip" and all(int(p) <= 255 for p in m.group().split(".")),
                "card": 13 <= len(digits) <= 19 and personal.luhn(digits),
                "phone": 9 <= len(digits) <= 15,
            }[kind]
            if fine:
                out.append((kind, *m.span()))
    return out


TEXTS = [
    "a@b.c@d.e x@y x@y.z. .@-.-@a.b", "1.2.3.4.5.6.7.8 300.1.1.1 01.002.3.4 1..2.3.4", "4111 1111 1111 1111 4111-1111-1111-1111 12",
    "+1 (017) 555-7713 + 5 +49.30.1234567. +1--2 +12345678901234567", "é٣ mail ü@x.de 4539578763621486é", "@", "+", "",
    "token = \"04dbebab91ab85687d33eeaaf9ac699e1188f962\" Version 2.0.",
]


@pytest.mark.parametrize("text", TEXTS)
def test_patterns_by_definition(text):
    assert personal.pattern_spans(text) == by_definition(text)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="aé@.+- ()0123459", max_size=60))
def test_patterns_by_definition_on_any_text(text):
    assert personal.pattern_spans(text) == by_definition(text)


def test_long_runs_take_linear_time():
    started = time.time()
    for run in ("a" * 300_000, "1" * 300_000, "a." * 150_000, "+1 " * 100_000, "1.1." * 80_000, "@" * 300_000, "1 " * 100_000):
        personal.pattern_spans(run)
        list(personal.regions(run))
    assert time.time() - started < 20


def segmentations(lattice, end=None):
    end = lattice.length if end is None else end
    if end == 0:
        yield []
        return
    for start, label, features in [(end - 1, OUTSIDE, ()), *lattice.ending[end]]:
        for before in segmentations(lattice, start):
            yield [*before, (start, end, label, features)]


def random_lattice(draw, length=6):
    ending = [[] for _ in range(length + 1)]
    for end in range(1, length + 1):
        for _ in range(draw.randint(0, 3)):
            start = draw.randint(max(0, end - 3), end - 1)
            ending[end].append((start, draw.choice("xy"), tuple(draw.sample("pqrs", 2))))
    return Lattice(length, ending)


def test_sums_and_best_segmentation_by_enumeration():
    draw = random.Random(1)
    for _ in range(30):
        lattice = random_lattice(draw)
        model = SemiCRF(("x", "y"))
        model.weights = {(l, f): draw.gauss(0, 1) for l, f in itertools.product("xy", "pqrs")}
        model.follows = {(a, b): draw.gauss(0, 1) for a, b in itertools.product((OUTSIDE, "x", "y"), repeat=2)}

        def score(way):
            labels = [OUTSIDE, *[s[2] for s in way]]
            own = sum(model.weights.get((s[2], f), 0) for s in way for f in s[3])
            return own + sum(model.follows[pair] for pair in zip(labels, labels[1:]))

        ways = list(segmentations(lattice))
        total, features, follows = model.expectations(lattice)
        assert total == pytest.approx(math.log(sum(math.exp(score(w)) for w in ways)))
        for key in model.weights:
            mean = sum(math.exp(score(w) - total) * sum(s[2] == key[0] and key[1] in s[3] for s in w) for w in ways)
            assert features.get(key, 0.0) == pytest.approx(mean, abs=1e-9)
        for a, b in model.follows:
            mean = 0.0
            for w in ways:
                labels = [OUTSIDE, *[s[2] for s in w]]
                mean += math.exp(score(w) - total) * sum(p == (a, b) for p in zip(labels, labels[1:]))
            assert follows.get((a, b), 0.0) == pytest.approx(mean, abs=1e-9)
        best = max(map(score, ways))
        found = model.best(lattice)
        ends = {e: (s, l) for s, e, l in found}
        assert any(
            score(w) == pytest.approx(best) and [(s, e, l) for s, e, l, _ in w if l != OUTSIDE] == found for w in ways
        ), ends


def written_text(draw, hidden):
    word = lambda: "".join(draw.choice("aeioustrn") for _ in range(draw.randint(2, 8)))
    parts, spans, at = [], [], 0
    for _ in range(60):
        roll = draw.random()
        if roll < 0.04:
            part, kind = f"+1 ({draw.randint(100, 999)}) 555-{draw.randint(1000, 9999)}", "phone"
        elif roll < 0.06 and hidden:
            part, kind = f"({draw.randint(100, 999)}) 555-{draw.randint(1000, 9999)}", "phone"
        elif roll < 0.1:
            part, kind = f"{word()}.{draw.randint(1, 99)}@mail{draw.randint(1, 9)}.example.com", "email"
        elif roll < 0.14:
            part, kind = ".".join(str(draw.randint(1, 255)) for _ in range(4)), "ip"
        elif roll < 0.2:
            digits = "".join(str(draw.randint(0, 9)) for _ in range(15))
            part = next(digits + c for c in "0123456789" if personal.luhn(digits + c) == (roll < 0.18))
            kind = "card" if roll < 0.18 else None
        elif roll < 0.25:
            part, kind = draw.choice([f"{draw.randint(0, 99)}.{draw.randint(0, 9)}", str(draw.randint(0, 10**6)), f"{draw.getrandbits(150):x}"]), None
        else:
            part, kind = word(), None
        if kind:
            spans.append((kind, at, at + len(part)))
        parts.append(part)
        at += len(part) + 1
    return " ".join(parts), spans


def test_held_out_accuracy():
    """What the patterns cannot see is found, and nothing is found that is not there."""
    draw = random.Random(3)
    cuts = []
    for _ in range(60):
        text, _ = written_text(draw, hidden=False)
        cuts += [text[max(0, a - 24) : b + 8] for a, b in personal.regions(text)]
    model = personal.trained(cuts[:500])
    right = wrong = missed = 0
    for _ in range(60):
        text, spans = written_text(draw, hidden=True)
        base = personal.pattern_spans(text)
        hidden = {s for s in spans if not any(s[1] < b and a < s[2] for _, a, b in base)}
        added = set(personal.model_spans(text, model, base))
        right += len(added & hidden)
        wrong += len(added - hidden)
        missed += len(hidden - added)
    assert right >= 0.9 * (right + missed) and right >= 20
    assert wrong <= 0.05 * right


def test_query_rows(spark):
    docs = [(i, text, "x") for i, text in enumerate(TEXTS)] + [(50, None, "x"), (None, TEXTS[3], "x"), (0, TEXTS[0], "x"), (51, "1 " * 200_000, "x")]
    frame = spark.createDataFrame(docs, "doc_id long, text string, spans string").repartition(3)
    got = personal.digest(personal.personal_data(frame)).collect()
    assert len(got) == len(docs)
    for row in got:
        text = next(t for d, t, _ in docs if d == row.doc_id) or ""
        spans = by_definition(text)
        told = [f"{k}:{a}:{b}" for k, a, b in spans]
        assert [row.n_email, row.n_ip, row.n_card, row.n_phone] == [sum(s[0] == k for s in spans) for k in personal.KINDS]
        assert row.base_sha256 == sha(",".join(told).encode())
        assert set(told) <= set(row.spans.split(",")) | {""}
    assert personal.personal_data(frame.limit(0)).count() == 0
