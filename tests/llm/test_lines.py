import random

import pytest

from massmap.llm import lines
from massmap.llm.common import keyed
from tests.llm import brute

SCHEMA = "doc_id long, text string, removed int, other string"


def rows():
    draw = random.Random(3)
    stock = [f"line {i}" for i in range(25)] + ["", "  ", "\t"]
    passage = [f"shared {i}" for i in range(12)]
    docs = []
    for doc in range(90):
        text = [draw.choice(stock) for _ in range(draw.randint(0, 14))]
        if doc % 4 == 0:
            a = draw.randint(0, 6)
            at = draw.randint(0, len(text))
            text[at:at] = passage[a : a + draw.randint(2, 6)]
        docs.append((doc, "\n".join(text), 1, f"o{doc}"))
    docs += [(200 + i, docs[8][1], None, None) for i in range(8)]
    docs += [(300, None, None, None), (301, "", None, None), (302, "\n\n", None, None), (303, "same\n" * 400, None, None)]
    docs += [(None, docs[8][1], None, None), (304, "a\n\nb\n \nc\nd\n" * 5, None, None)]
    return docs


@pytest.mark.parametrize("min_lines", [1, 2, 3, 5])
def test_matches_brute_force(spark, min_lines):
    docs = rows()
    frame = spark.createDataFrame(docs, SCHEMA).repartition(5)
    done = lines.dedup_lines(frame, min_lines=min_lines)
    assert sorted(done.columns) == ["doc_id", "n_lines", "n_removed", "other", "removed", "text"]
    got = {r.doc_id: (r.n_lines, r.n_removed, r.text) for r in done.collect()}
    assert got == brute.lines_left([doc[:2] for doc in docs], min_lines)


def longest_earlier(docs, min_lines):
    """Every longest run that also starts earlier, by comparing all pairs of starts."""
    lines = {doc: [line for line in text.split("\n") if line.strip()] for doc, text in docs}
    starts = sorted((doc, i) for doc in lines for i in range(len(lines[doc])))
    runs = {}
    for at, (doc, i) in enumerate(starts):
        best = (0, None)
        for of_doc, of_i in starts[:at]:
            n = 0
            while i + n < len(lines[doc]) and of_i + n < len(lines[of_doc]) and lines[doc][i + n] == lines[of_doc][of_i + n]:
                n += 1
            if n > best[0]:
                best = (n, (of_doc, of_i))
        runs[doc, i] = best
    return sorted(
        (doc, i, n, *of) for (doc, i), (n, of) in runs.items()
        if n >= min_lines and runs.get((doc, i - 1), (0, None))[0] != n + 1
    )


@pytest.mark.parametrize("min_lines", [1, 3])
def test_every_maximal_run_and_its_first_place(spark, min_lines):
    draw = random.Random(11)
    docs = [(doc, "\n".join(draw.choice("abc") for _ in range(draw.randint(0, 25)))) for doc in range(14)]
    docs += [(50, docs[3][1] + "\nx\n" + docs[5][1]), (51, "a\n" * 37), (52, "b\n" + "a\n" * 21)]
    frame = keyed(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), "doc_id", "text")
    got = sorted((r.doc, r.i, r.n, r.of_doc, r.of_i) for r in lines.repeated_runs(frame, min_lines).collect())
    assert got == longest_earlier(docs, min_lines)


def test_few_lines_of_many_words_go(spark):
    long, half = " ".join(f"w{i}" for i in range(50)), " ".join(f"h{i}" for i in range(26))
    docs = [
        (1, f"{long}\nx\n{half}\n \n{half}\ny"), (2, f"own\n{long}\nother"), (3, f"{half}\n{half}\nz"), (4, f"z\n{half}\nu"),
        (5, " ".join(f"w{i}" for i in range(49))), (6, " ".join(f"w{i}" for i in range(49))), (7, long), (8, f"{long}\n" * 3),
    ]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: (r.n_lines, r.n_removed, r.text) for r in lines.dedup_lines(frame).collect()}
    assert got == brute.lines_left(docs)
    assert got[2][2] == "own\nother" and got[3][2] == "z" and got[7][2] == "" and got[4][1] == got[6][1] == 0
    alone = {r.doc_id: r.n_removed for r in lines.dedup_lines(frame, min_words=None).collect()}
    assert alone[2] == alone[7] == 0 and set(alone.values()) == {0}


def test_texts_that_differ_under_one_id(spark):
    frame = spark.createDataFrame([(1, "a\nb\nc\nd"), (2, "a\nb\nc\nd"), (2, "x"), (2, None)], "doc_id long, text string")
    assert lines.dedup_lines(frame).count() == 4


def test_runs_are_maximal_and_point_to_their_source(spark):
    a = [f"a{i}" for i in range(10)]
    docs = [(1, "\n".join(a)), (2, "\n".join(["x", *a[2:8], "y"])), (3, "\n".join(["z", *a[2:8]]))]
    frame = keyed(spark.createDataFrame(docs, "doc_id long, text string"), "doc_id", "text")
    got = sorted((r.doc, r.i, r.n, r.of_doc, r.of_i) for r in lines.repeated_runs(frame, 3).collect())
    assert got == [(2, 1, 6, 1, 2), (3, 1, 6, 1, 2)]


def test_repeated_rows_and_empty_table(spark):
    text = "a\nb\nc\nd"
    frame = spark.createDataFrame([(1, text), (1, text), (2, text)], "doc_id long, text string")
    assert sorted((r.doc_id, r.n_removed) for r in lines.dedup_lines(frame).collect()) == [(1, 0), (1, 0), (2, 4)]
    assert lines.dedup_lines(frame.limit(0)).count() == 0


def test_no_python_in_the_plan(spark):
    frame = spark.createDataFrame(rows(), SCHEMA)
    plan = lines.dedup_lines(frame)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "ArrowEval"))
