import random

import numpy as np
import pytest

from massmap.llm import repeats, substrings, suffixes
from tests.llm import brute

SCHEMA = "doc_id long, text string, n_words string, kept_text int"


def noisy(seed):
    """Texts with shared passages, copies, periodic runs, repeats inside a document and awkward rows."""
    draw = random.Random(seed)
    vocabulary = [f"w{i}é" if i % 7 == 0 else f"w{i}" for i in range(400)]
    passage = [draw.choice(vocabulary) for _ in range(70)]
    docs = []
    for doc in range(60):
        words = [draw.choice(vocabulary) for _ in range(draw.randint(0, 120))]
        if doc % 3 == 0:
            at = draw.randint(0, len(words))
            a = draw.randint(0, 30)
            words[at:at] = passage[a : a + draw.randint(15, 40)]
        if doc % 5 == 0:
            words += ["x"] * draw.randint(18, 60)
        if doc % 11 == 0:
            words = words + words[:45]
        docs.append((doc * 3, draw.choice([" ", "\n", "\t ", "  "]).join(words), "clash", 1))
    docs += [(1000 + i, docs[9][1], None, None) for i in range(12)]
    docs += [(2000, None, None, None), (2001, "", None, None), (2002, " \n ", None, None)]
    docs += [(2003, "short one", None, None), (None, docs[12][1], None, None), (2004, "ab " * 5000, None, None)]
    draw.shuffle(docs)
    return docs


@pytest.mark.parametrize("split_over", [4096, 3])
def test_words_match_brute_force(spark, split_over):
    docs = noisy(1)
    frame = spark.createDataFrame(docs, SCHEMA).repartition(5)
    got = {
        row.doc_id: (row.n_words, row.n_removed, row.kept_sha256)
        for row in substrings.digest(substrings.dedup_substrings(frame, split_over=split_over)).collect()
    }
    assert got == brute.words_removed([doc[:2] for doc in docs])


@pytest.mark.parametrize("split_over", [4096, 3])
def test_bytes_match_brute_force(spark, split_over):
    docs = noisy(2)
    frame = spark.createDataFrame(docs, SCHEMA).repartition(5)
    got = {
        row.doc_id: (row.n_bytes, row.n_removed, row.n_spans, row.kept_sha256)
        for row in suffixes.digest(suffixes.dedup_suffixes(frame, split_over=split_over)).collect()
    }
    assert got == brute.bytes_removed([doc[:2] for doc in docs])


def test_long_documents_are_cut_into_overlapping_pieces(spark, monkeypatch):
    monkeypatch.setattr(repeats, "CHUNK", 500)
    docs = [doc for doc in noisy(3) if doc[0] is not None]
    frame = spark.createDataFrame(docs, SCHEMA)
    texts = [(doc, text) for doc, text, _, _ in docs]
    for size, gram, hashed in ((20, 6, repeats.hashed_words), (100, 32, repeats.hashed_bytes)):
        import pyarrow as pa

        starts = set()
        column = pa.array([text for _, text in texts])
        for rows, offsets, lengths, units in hashed(column, size):
            found = repeats.anchored_runs(units, lengths, size, gram)
            for piece, first, run, _, _ in zip(*found) if found else []:
                row, begin = int(rows[piece]), int(offsets[piece] + first)
                here = {(row, begin + k) for k in range(run)}
                assert not here & starts
                starts |= here
        expected = {
            (row, k)
            for row, (_, text) in enumerate(texts)
            for k in range(len((text or "").encode().split() if size == 20 else (text or "").encode()) - size + 1)
        }
        assert starts == expected
    assert frame.count() == len(docs)


def test_repeated_rows_and_empty_table(spark):
    text = " ".join(f"w{i}" for i in range(40))
    frame = spark.createDataFrame([(1, text), (1, text), (2, text)], "doc_id long, text string")
    rows = sorted((r.doc_id, r.n_removed) for r in substrings.dedup_substrings(frame).collect())
    assert rows == [(1, 0), (1, 0), (2, 40)]
    rows = sorted((r.doc_id, r.n_removed) for r in suffixes.dedup_suffixes(frame).collect())
    assert rows == [(1, 0), (1, 0), (2, len(text))]
    assert substrings.dedup_substrings(frame.limit(0)).count() == 0
    assert suffixes.dedup_suffixes(frame.limit(0)).count() == 0


def test_suffixes_sort_like_bytes():
    draw = random.Random(4)
    groups, strings = [], []
    for group in range(30):
        stem = bytes(draw.choice(b"ab") for _ in range(40))
        for _ in range(draw.randint(1, 20)):
            cut = draw.randint(0, 40)
            strings.append(stem[:cut] + bytes(draw.choice(b"ab") for _ in range(draw.randint(0, 3))))
            groups.append(group)
    order, common = suffixes.Suffixes(strings).merge_sorted(np.array(groups))
    got = [(groups[i], strings[i]) for i in order]
    assert got == sorted(zip(groups, strings))
    for k in range(1, len(got)):
        if got[k][0] == got[k - 1][0]:
            x, y = got[k - 1][1], got[k][1]
            same = next((i for i in range(min(len(x), len(y))) if x[i] != y[i]), min(len(x), len(y)))
            assert common[k] == same


def test_hash_collisions_are_caught(monkeypatch):
    """With a useless hash every comparison lies; the bytes still decide."""
    monkeypatch.setattr(repeats, "BYTE_CODES", np.zeros(256, np.uint64))
    strings = [b"banana", b"band", b"ban", b"apple", b"band"]
    order, common = suffixes.Suffixes(strings).merge_sorted(np.zeros(5, np.int64))
    assert [strings[i] for i in order] == sorted(strings)
    assert common.tolist() == [-1, 0, 3, 3, 4]
