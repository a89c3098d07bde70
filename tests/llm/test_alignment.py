import random
from collections import Counter
from itertools import accumulate

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from massmap.llm import alignment
from tests.llm.brute import sha

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def both():
    return alignment.loaded(alignment.ByteLevel, A), alignment.loaded(alignment.Pieces, B)


def test_equal_runs_and_groups():
    rng = random.Random(1)
    for _ in range(400):
        n = rng.randrange(1, 60)
        share = rng.choice([0.1, 0.5, 0.9, 1.0])
        a = sorted({n, *(x for x in range(1, n) if rng.random() < share)})
        b = sorted({n, *(x for x in range(1, n) if rng.random() < share)})
        ends_a, ends_b = np.array(a), np.array(b)
        raw_a, raw_b = ends_a.tobytes(), ends_b.tobytes()
        for _ in range(5):
            i, j = rng.randrange(len(a)), rng.randrange(len(b))
            room = min(len(a) - i, len(b) - j)
            most = 0
            while most < room and a[i + most] == b[j + most]:
                most += 1
            assert alignment.equal_run(raw_a, raw_b, 8 * i, 8 * j, 8 * room) == 8 * most
        inner_a, inner_b = alignment.inner_ends(ends_a, ends_b)
        assert inner_a == [i for i, end in enumerate(a) if end not in set(b)]
        assert inner_b == [j for j, end in enumerate(b) if end not in set(a)]


def test_a_long_diagonal_is_skipped():
    a = np.arange(1, 1_000_001)
    b = np.delete(a, [500, 700_000])
    assert alignment.inner_ends(a, b) == ([500, 700_000], [])


def test_strings_are_found_in_their_places():
    rng = random.Random(2)
    strings = [b"", b"\0", b"a", b"\0\0", b"12345678", b"123456789", b"12345678\0", b"x" * 16, b"x" * 17, bytes(range(40))]
    held = alignment.Spelled(strings)
    for _ in range(300):
        ids = np.array([rng.randrange(len(strings)) for _ in range(rng.randrange(8))], np.int64)
        text = b"".join(strings[k] for k in ids)
        assert held.ends(ids, text).tolist() == list(accumulate(len(strings[k]) for k in ids))
        assert held.ends(ids, text + b"\0") is None
        if text:
            at = rng.randrange(len(text))
            assert held.ends(ids, text[:at] + bytes([text[at] ^ 1]) + text[at + 1 :]) is None and held.ends(ids, text[:-1]) is None


def test_short_and_long_runs_about_the_near_limit():
    for run in range(1, 3 * alignment._NEAR):
        a = [k for k in range(1, 4 * run + 1) if k != run + 1]
        b = [k for k in range(1, 4 * run + 1) if k != 2 * run + 1]
        if a[-1] == b[-1]:
            assert alignment.inner_ends(np.array(a), np.array(b)) == (
                [i for i, end in enumerate(a) if end not in b], [i for i, end in enumerate(b) if end not in a]
            )


def by_definition(text, both):
    """n_a, n_b, groups as text, links as id pairs; None without tokens."""
    a, b = both
    if not text:
        return None
    ids_a = a.tokenizer.encode(" " + text, add_special_tokens=False).ids
    ids_b = b.model.encode(text)
    parts_a, parts_b = [a.bytes[k] for k in ids_a], [b.bytes[k] for k in ids_b]
    if not b"".join(parts_a) == b"".join(parts_b) == (" " + text).encode():
        return None
    ends_a, ends_b = list(accumulate(map(len, parts_a))), list(accumulate(map(len, parts_b)))
    told, i, j = [], 0, 0
    for end in sorted(set(ends_a) & set(ends_b)):
        k, m = ends_a.index(end) + 1, ends_b.index(end) + 1
        told.append(",".join(map(str, ids_a[i:k])) + "|" + ",".join(map(str, ids_b[j:m])))
        i, j = k, m
    links = [
        (x, y)
        for x, p, q in zip(ids_a, [0, *ends_a], ends_a) for y, u, v in zip(ids_b, [0, *ends_b], ends_b) if p < v and u < q
    ]
    return len(ids_a), len(ids_b), ";".join(told), links


def expected(docs, both):
    done = {n: by_definition(text, both) for n, (_, text) in enumerate(docs)}
    counts = Counter(link for one in done.values() if one for link in one[3])
    highest = {}
    for (_, y), n in counts.items():
        highest[y] = max(highest.get(y, 0), n)
    out = []
    for n, (doc, _) in enumerate(docs):
        if done[n] is None:
            out.append((doc, 0, 0, 0, 0, 0, 0, ""))
            continue
        n_a, n_b, told, links = done[n]
        out.append((
            doc, n_a, n_b, told.count(";") + 1, len(links), sum(counts[x] == highest[x[1]] for x in links),
            sum(counts[x] for x in links), sha(told.encode()),
        ))
    return sorted(out, key=repr)


TEXTS = [
    "The quick brown fox", "ünïcödé – “quotes” …", "日本語のテキスト 🎉🎉", "<|endoftext|> <s> </s> <unk> <0x41>", "a\nb\r\n\tc  d   e", "▁ already", " lead and trail ",
    "x" * 50, "\x00\x01\x7f", "ﬁ ligature ½ Ⅷ", "1234567890 3.14159", "é ​﻿", "''''' ----- \"\"\"", "   ", "\n", "of the of the of the", "don't I'LL 's",
]


def test_frame_against_definition(spark, both):
    docs = [(n, text) for n, text in enumerate(TEXTS)] + [(None, "of the"), (None, None), (99, ""), (0, TEXTS[0]), (0, "of the " * 700)]
    frame = spark.createDataFrame([(*d, 1, 2) for d in docs], "doc_id long, text string, row int, pair int")
    want = expected(docs, both)
    assert any(one[1] for one in want) and sum(one[1] == 0 for one in want) >= 3
    for head in (1, 40, alignment.HEAD):
        assert sorted(map(tuple, alignment.align_tokens(frame, A, B, head=head).collect()), key=repr) == want
    assert alignment.align_tokens(frame.limit(0), A, B).count() == 0


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_any_text(both, text):
    if any(0xD800 <= ord(c) < 0xE000 for c in text):
        return
    want, got = by_definition(text, both), alignment.align(text, *both)
    assert (want is None) == (got is None)
    if got:
        keys, times = got.pairs(len(both[1].bytes))
        held = Counter({(k // len(both[1].bytes), k % len(both[1].bytes)): n for k, n in zip(keys.tolist(), times.tolist())})
        told = got.told(alignment.words(len(both[0].bytes), "|"), alignment.words(len(both[1].bytes), ";"))
        assert (len(got.ids_a), len(got.ids_b), told, held) == (*want[:3], Counter(want[3]))


def test_given_documents(spark, both, sf_dir):
    frame = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs = [(r.doc_id, r.text) for r in frame.select("doc_id", "text").collect()][:60]
    few = spark.createDataFrame(docs, "doc_id long, text string")
    docs = [d for d in docs if len(d[1] or "") < 4000]
    few = few.where("length(text) < 4000")
    assert sorted(map(tuple, alignment.align_tokens(few, A, B).collect()), key=repr) == expected(docs, both)
