import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from massmap.llm import binpack, packing

PATH = public_tokenizers.path("byte_bpe_50k.json")
ODD = [
    "", " ", "  \n\n x", "it's we'll 'sx '''s", "a<|endoftext|> b<|endoftext|>", "naïve ßüö ñ ²³ ª", "中文 текст x",
    "\x1c\x1d a", "tab\t\tx  y   ", "12 345,67", "x" * 200, "​", "a\u0085b", "¿qué? ¡no!", "<|endoftext|>", "\x00 a",
]


def test_ids_are_those_of_the_tokenizer(spark, sf_dir):
    reference = Tokenizer.from_file(PATH)
    encode = packing.Encoder(PATH)
    texts = ODD + [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").limit(80).collect()]
    for text in texts:
        ids = reference.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(encode.ids(text), "<u4").tolist() == ids


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab'stre lvm1²é\n\t  .,!ªÿ<|endoftext|>"), max_size=40))
def test_pieces_never_change_ids(text):
    encode = packing.encoder(PATH)
    assert encode.ids(text) == encode.whole(text)


def check_plan(counts, plan, capacity):
    used = Counter()
    for filling, bins in plan:
        assert sum(size * n for size, n in filling) <= capacity
        for size, n in filling:
            used[size] += n * bins
    assert used == Counter({s: n for s, n in counts.items() if n})
    return sum(bins for _, bins in plan)


@settings(max_examples=120, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 4), max_size=8))
def test_plans_hold_every_item_and_beat_best_fit(counts):
    plan = binpack.complete(counts, 30)
    bins = check_plan(counts, plan, 30)
    assert bins <= check_plan(counts, binpack.best_fit(counts, 30), 30)
    assert bins >= binpack.lower_bound(counts, 30)


def optimum(items, capacity):
    best = [len(items)]

    def place(at, rooms):
        if len(rooms) >= best[0]:
            return
        if at == len(items):
            best[0] = len(rooms)
            return
        for k in sorted(set(range(len(rooms))), key=lambda k: rooms[k]):
            if rooms[k] >= items[at]:
                place(at + 1, rooms[:k] + [rooms[k] - items[at]] + rooms[k + 1 :])
        place(at + 1, rooms + [capacity - items[at]])

    place(0, [])
    return best[0]


def test_small_cases_are_optimal():
    draw = random.Random(5)
    for _ in range(150):
        items = sorted((draw.randint(3, 60) for _ in range(draw.randint(1, 9))), reverse=True)
        counts = Counter(items)
        bins = check_plan(counts, binpack.complete(counts, 100), 100)
        assert bins == optimum(items, 100)


def test_best_fit_is_beaten_where_it_errs():
    counts = Counter([4, 4, 3, 3, 3, 3])
    assert check_plan(counts, binpack.complete(counts, 10), 10) == 2
    assert check_plan(counts, binpack.best_fit(counts, 10), 10) == 3


def test_packing_round_trip(spark):
    draw = random.Random(1)
    words = "alpha beta gamma delta naïve été straße 42 don't \n".split(" ")
    docs = [(i, " ".join(draw.choices(words, k=draw.randint(0, 900))), i) for i in range(150)]
    docs += [(1000, None, 1), (1001, "", 1), (None, "no id", 1), (1002, "x y " * 4000, 1), (1003, "same", 1), (1003, "same", 1)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, sequence_id int").repartition(5)
    rows = packing.pack(frame, PATH, length=256, keep_ids=True).collect()
    encode = packing.encoder(PATH)
    texts = {}
    for doc, text, _ in docs:
        texts.setdefault(doc, []).append(encode.ids(text or "") + b"\2\0\0\0")
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for row in rows:
        by_doc[row.doc_id].append(row)
        by_sequence[row.sequence_id].append((row.offset, row.length))
        assert row.ids_crc32 == zlib.crc32(row.ids) and len(row.ids) == 4 * row.length
    assert set(by_doc) == set(texts)
    for doc, pieces in by_doc.items():
        pieces.sort(key=lambda r: r.piece)
        assert b"".join(bytes(p.ids) for p in pieces) == b"".join(texts[doc])
        if doc != 1003:
            assert [p.piece for p in pieces] == list(range(len(pieces)))
            assert all(p.length == 256 for p in pieces[1:]) and (len(pieces) == 1 or pieces[0].length <= 256)
            assert [p.start for p in pieces] == [sum(q.length for q in pieces[:k]) for k in range(len(pieces))]
    for held in by_sequence.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 256
    total = sum(row.length for row in rows)
    assert len(by_sequence) <= -(-total // 256) + 2


@pytest.mark.parametrize("rows", [0])
def test_empty_table(spark, rows):
    frame = spark.createDataFrame([(1, "x")], "doc_id long, text string").limit(rows)
    assert packing.pack(frame, PATH).count() == 0
