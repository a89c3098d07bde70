import random
from collections import defaultdict

import pytest

from massmap.llm import mixing

SCHEMA = "doc_id long, text string, source string, size string, other int"


def rows():
    draw = random.Random(2)
    docs = []
    for doc in range(700):
        source = draw.choice(["a"] * 6 + ["b", "c", "Z", "é", None])
        docs.append((doc, "w " * draw.randint(0, 300), source, "clash", doc))
    docs += [(1000, None, "a", None, 1), (1001, "", "empty", None, 1), (1002, "x", "one", None, 1)]
    docs += [(2000 + i, "same words here", "copies", None, 1) for i in range(300)]
    docs += [(3000, "w " * 60000, "a", None, 1), (None, "no id", "b", None, 1), (7, docs[7][1], docs[7][2], None, 1)]
    return docs


def brute_targets(sizes, factor=1.5, weights=(5, 2, 1), cap=2.0):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {name: weights[k % len(weights)] for k, name in enumerate(names)}
    share = {name: factor * sum(sizes.values()) * weight[name] / sum(weight.values()) for name in names}
    stopped = set()
    while True:
        above = {n for n in names if n not in stopped and share[n] > cap * sizes[n] + 1e-9}
        if not above:
            return share
        excess = sum(share[n] - cap * sizes[n] for n in above)
        stopped |= above
        for n in above:
            share[n] = cap * sizes[n]
        rest = [n for n in names if n not in stopped]
        for n in rest:
            share[n] += excess * weight[n] / sum(weight[m] for m in rest)


def test_targets_copies_and_sizes(spark):
    docs = rows()
    frame = spark.createDataFrame(docs, SCHEMA).repartition(5)
    done = mixing.mix(frame)
    assert done.columns == ["doc_id", "text", "source", "other", "size", "source_size", "target", "rate", "copies", "taken"]
    got = done.collect()
    assert len(got) == len(docs)
    sizes, taken, biggest, wanted = defaultdict(int), defaultdict(int), defaultdict(int), defaultdict(float)
    for doc in docs:
        sizes[doc[2]] += len((doc[1] or "").split())
    expected = brute_targets(sizes)
    for row in got:
        assert row.size == len((row.text or "").split())
        assert row.source_size == sizes[row.source]
        assert row.target == pytest.approx(expected[row.source])
        assert 0 <= row.copies <= 2 and row.taken == row.copies * row.size
        assert row.rate - 1 < row.copies < row.rate + 1
        taken[row.source] += row.taken
        wanted[row.source] += row.rate * row.size
        biggest[row.source] = max(biggest[row.source], row.size)
    for source, target in expected.items():
        assert wanted[source] == pytest.approx(target, rel=1e-6, abs=1e-6)
        assert abs(taken[source] - target) <= 0.51 * biggest[source] + 1e-6
    assert sum(taken.values()) == pytest.approx(1.5 * sum(sizes.values()), rel=0.2)


def test_rates_tilt_exponentially(spark):
    """Within a source the logarithm of an uncapped rate is proportional to the size."""
    import math

    by_source = defaultdict(set)
    for row in mixing.mix(spark.createDataFrame(rows(), SCHEMA)).collect():
        if 0 < row.rate < 2 and row.size > 0:
            by_source[row.source].add(round(math.log(row.rate) / row.size, 9))
    assert by_source and all(len(values) == 1 for values in by_source.values())


def test_reruns_agree_however_rows_are_dealt(spark):
    frame = spark.createDataFrame(rows(), SCHEMA)
    first = sorted(map(str, mixing.digest(frame.repartition(3)).collect()))
    assert first == sorted(map(str, mixing.digest(frame.repartition(11)).collect()))


def test_empty_table(spark):
    frame = spark.createDataFrame(rows(), SCHEMA)
    assert mixing.mix(frame.limit(0)).count() == 0
    assert mixing.mix(frame.where("text is null")).count() == 1
