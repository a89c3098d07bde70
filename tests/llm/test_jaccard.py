import random
from itertools import combinations

import corpus_pipeline as P
from massmap.llm import jaccard

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def grams(text, n=5):
    words = (text or "").lower().split()
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def similarity(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def grouped(texts, least=0.8):
    """{id: smallest id reachable} by comparing all pairs."""
    sets = {doc: grams(text) for doc, text in texts.items()}
    above = {doc: doc for doc in sets}

    def find(doc):
        while above[doc] != doc:
            doc = above[doc]
        return doc

    for a, b in combinations(sorted(sets), 2):
        if similarity(sets[a], sets[b]) >= least:
            one, other = sorted((find(a), find(b)))
            above[other] = one
    return {doc: find(doc) for doc in sets}


def edited(draw, text, edits):
    words = text.split()
    for at in draw.sample(range(len(words)), edits):
        words[at] = f"neu{draw.randrange(10**6)}"
    return " ".join(words)


def copies():
    """Texts with copies at similarities on both sides of 0.8, and one large group that one bucket holds."""
    draw = random.Random(21)
    vocabulary = [f"wort{i}" for i in range(4000)]
    text = lambda n: " ".join(draw.choices(vocabulary, k=n))
    texts = {i: text(draw.randint(80, 400)) for i in range(80)}
    for i in range(80):
        texts[100 + i] = edited(draw, texts[i], max(1, round(len(texts[i].split()) * draw.uniform(0.01, 0.05))))
    common = text(300)
    texts |= {300 + i: edited(draw, common, 4) for i in range(60)}
    return texts | {400: "", 401: None, 402: " \n", 403: "too short", 404: "Too  short", 405: texts[7].upper()}


def test_groups_match_brute_force_jaccard(spark):
    texts = copies()
    expected = grouped(texts)
    frame = spark.createDataFrame([(d, t) for d, t in texts.items()], "doc_id long, text string")
    found = {r.doc: r.component for r in jaccard.near_duplicates(frame).collect()}
    assert found == expected
    links = [similarity(grams(texts[i]), grams(texts[100 + i])) for i in range(80)]
    assert sum(0.8 <= s < 0.9 for s in links) > 15 and sum(0.6 < s < 0.8 for s in links) > 15


def test_the_stage_drops_what_is_alike_and_nothing_else(spark):
    texts = copies()
    groups = grouped(texts)
    frame = spark.createDataFrame([(d, t, "de", "s", len(t or "")) for d, t in texts.items()], SCHEMA)
    kept = {r.doc_id for r in P.near_duplicates(spark, frame, "").collect()}
    assert kept == {doc for doc, first in groups.items() if doc == first}


def test_ids_that_are_null_or_come_twice(spark):
    a, b = "a b c d e f g h", "p q r s t u v w"
    frame = spark.createDataFrame([(None, a), (3, a), (5, b), (5, b), (6, "x y")], "doc_id long, text string")
    found = {(r.doc, r.component) for r in jaccard.near_duplicates(frame).collect()}
    assert found == {(-(2**63), -(2**63)), (3, -(2**63)), (5, 5), (6, 6)}


def test_a_template_below_the_threshold_makes_no_pairs(spark, monkeypatch):
    draw = random.Random(3)
    common = [f"c{i}" for i in range(300)]
    texts = {i: " ".join(common + [f"o{i}x{k}" for k in range(130)]) for i in range(400)}
    texts |= {1000 + i: edited(draw, texts[i], 2) for i in range(3)}
    seen = []
    alike, blocked = jaccard._verified, jaccard._blocked
    monkeypatch.setattr(jaccard, "_verified", lambda pairs, sets, least: seen.append((pairs.count(), sets.count())) or alike(pairs, sets, least))
    monkeypatch.setattr(jaccard, "_blocked", lambda members, *rest: seen.append(members.count()) or blocked(members, *rest))
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found = {r.doc: r.component for r in jaccard.near_duplicates(frame).collect()}
    assert {doc: first for doc, first in found.items() if doc != first} == {1000: 0, 1001: 1, 1002: 2}
    assert seen[0][1] == 6 and seen[0][0] < len(texts) and seen[1] < 400


def test_a_group_around_a_centre_with_members_on_both_sides(spark, monkeypatch):
    draw = random.Random(5)
    centre = " ".join(f"c{i}" for i in range(146))
    texts = {i: edited(draw, centre, draw.randint(1, 8)) for i in range(150)}
    expected = grouped(texts)
    assert len(set(expected.values())) > 3
    frame = spark.createDataFrame([(d, t, 1, 2) for d, t in texts.items()], "doc_id long, text string, doc int, hashes int")
    for side in (8, 256):
        monkeypatch.setattr(jaccard, "SIDE", side)
        assert {r.doc: r.component for r in jaccard.near_duplicates(frame).collect()} == expected


def test_an_empty_table_and_ids_with_several_texts(spark):
    frame = spark.createDataFrame([(1, "a b c d e f"), (1, "p q r s t u"), (2, "p q r s t u"), (3, "A b c d e f")], "doc_id long, text string")
    assert {r.doc: r.component for r in jaccard.near_duplicates(frame).collect()} == {1: 1, 2: 1, 3: 1}
    assert jaccard.near_duplicates(frame.limit(0)).count() == 0
