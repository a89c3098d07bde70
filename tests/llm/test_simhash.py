import random

import numpy as np
import pytest

from massmap.llm import simhash
from massmap.llm.components import Forest, components
from tests.llm import brute


def test_documents_match_brute_force(spark):
    draw = random.Random(1)
    words = [f"word{i}" for i in range(300)]
    docs = []
    for doc in range(80):
        text = [draw.choice(words) for _ in range(draw.randint(1, 200))]
        docs.append((doc * 2, " ".join(text), "x"))
        if doc % 4 == 0:
            for copy in range(3):
                text[draw.randrange(len(text))] = draw.choice(words)
                docs.append((1000 + doc * 4 + copy, "\n".join(text).upper(), "x"))
    docs += [(500, None, "x"), (502, "", "x"), (None, " \t", None), (504, "one", "x"), (506, "ONE", "x"), (508, "one two", "x")]
    docs += [(510, "a b c " * 40000, "x")]
    draw.shuffle(docs)
    frame = spark.createDataFrame(docs, "doc_id long, text string, component_id string").repartition(6)
    prints = {doc: brute.fingerprint(text) for doc, text, _ in docs}
    groups = brute.linked(prints)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.digest(simhash.near_duplicates(frame)).collect()}
    assert got == {doc: (f"{prints[doc]:016x}", groups[doc]) for doc in prints}
    assert len(set(groups.values())) < len(groups)


@pytest.mark.parametrize("blocks,radius", [(None, 3), (6, 3), (8, 6)])
def test_planted_fingerprints_are_all_linked(spark, blocks, radius):
    """Every pair up to the radius apart, whichever bits, and none beyond; one large cluster."""
    draw = random.Random(2)
    prints = set()
    for _ in range(60):
        base = draw.getrandbits(64)
        prints.add(base)
        for bits in range(1, radius + 2):
            prints.add(base ^ sum(1 << bit for bit in draw.sample(range(64), bits)))
    center = draw.getrandbits(64)
    for _ in range(1200):
        prints.add(center ^ sum(1 << bit for bit in draw.sample(range(20), draw.randint(1, 7))))
    rows = [(i, p - (1 << 64) if p >> 63 else p) for i, p in enumerate(sorted(prints))]
    frame = spark.createDataFrame(rows, "doc long, fingerprint long")
    found = components(simhash.links(frame, radius=radius, blocks=blocks)).collect()
    group = {}
    for row in found:
        group.setdefault(row.component, set()).add(row.node)
    values = np.array([r[1] for r in rows]).view(np.uint64)
    forest = Forest()
    for i, value in enumerate(values):
        for j in np.flatnonzero(np.bitwise_count(values[i + 1 :] ^ value) <= radius) + i + 1:
            forest.link(i, int(j))
    expected = {}
    for i in forest.parent:
        expected.setdefault(forest.find(i), set()).add(rows[i][1])
    assert sorted(map(sorted, group.values())) == sorted(map(sorted, expected.values()))


def test_components_of_long_chains_and_hubs(spark):
    draw = random.Random(3)
    chain = list(range(0, 400))
    draw.shuffle(chain)
    links = list(zip(chain, chain[1:])) + [(1000, 1000 + k) for k in range(1, 300)] + [(2000, 2001), (2001, 2000), (2002, 2002)]
    draw.shuffle(links)
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "a long, b long").repartition(7)).collect()}
    assert got == {**{k: 0 for k in range(400)}, **{1000 + k: 1000 for k in range(300)}, 2000: 2000, 2001: 2000}


@pytest.mark.parametrize("rows", [0, 1])
def test_tiny_tables(spark, rows):
    frame = spark.createDataFrame([(7, "a b c d")], "doc_id long, text string").limit(rows)
    assert [r.component_id for r in simhash.near_duplicates(frame).collect()] == [7] * rows
