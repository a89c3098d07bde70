import math
import random

import numpy as np
import pytest

from massmap.llm import neighbours

SCHEMA = "vec_id long, embedding array<float>, label int, score string"


def exact(rows, k=20, every=20):
    fine = {}
    for vec, x, *_ in rows:
        if vec is not None and x is not None and len(x) == 16 and all(v is not None and math.isfinite(v) for v in x) and any(x):
            fine[vec] = np.array(x, np.float32).astype(float)
    ids = np.array(sorted(fine))
    base = np.array([fine[i] for i in ids])
    out = {}
    for query in ids[ids % every == 0]:
        scores = (base * fine[query]).sum(axis=1)
        order = sorted((-s, i) for s, i in zip(scores.tolist(), ids.tolist()) if i != query)[:k]
        out[query] = [(i, -s) for s, i in order]
    return out


def recall(got, expected):
    hits = total = 0
    for query, near in expected.items():
        least = near[-1][1] if near else 0
        total += len(near)
        hits += sum(score >= least - 1e-9 for _, score in got.get(query, []))
    return hits / max(1, total)


def table():
    draw = np.random.default_rng(1)
    centres = draw.standard_normal((12, 16)) * 2
    rows = []
    for i in range(1500):
        x = centres[i % 12] + draw.standard_normal(16) * draw.choice([0.2, 1.0])
        rows.append((i, [float(v) for v in x], 1, "clash"))
    rows += [(5000 + i, rows[40][1], 1, None) for i in range(400)]  # a very common vector
    rows += [(6000, None, 1, None), (6020, [0.0] * 16, 1, None), (6040, [float("nan")] * 16, 1, None)]
    rows += [(6060, [None] + [1.0] * 15, 1, None), (6080, [float("inf")] + [1.0] * 15, 1, None), (6100, [1.0] * 7, 1, None)]
    rows += [(None, [1.0] * 16, 1, None), (6120, [], 1, None), (7, rows[7][1], 1, None), (6140, [-0.0] + rows[40][1][1:], 1, None)]
    return rows


@pytest.mark.parametrize("cell_rows", [100000, 100])
def test_recall_and_ties(spark, cell_rows):
    rows = table()
    random.Random(2).shuffle(rows)
    frame = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = {}
    for row in neighbours.nearest(frame, cell_rows=cell_rows).orderBy("query_id", "rank").collect():
        got.setdefault(row.query_id, []).append((row.vec_id, row.score))
        assert row.rank == len(got[row.query_id])
    expected = exact(rows)
    assert set(got) == set(expected)
    assert all(len(near) == 20 for near in got.values())
    assert recall(got, expected) >= 0.95
    scores = {(q, i): s for q, near in exact(rows, 10**6).items() for i, s in near}
    for query, near in got.items():
        assert near == sorted(near, key=lambda p: (-p[1], p[0]))
        assert all(s == pytest.approx(scores[query, i], abs=1e-12) for i, s in near)
    common = [i for i, _ in got[40]][:20]
    assert common == sorted(common) and common[0] == 5000
    assert [i for i, _ in got[5000]][:1] == [40]


def test_few_candidates_and_empty_table(spark):
    rows = [(20 * i, [float(i), 1.0], 1, "") for i in range(4)] + [(3, [1.0, 2.0], 1, "")]
    frame = spark.createDataFrame(rows, SCHEMA)
    got = neighbours.nearest(frame).collect()
    assert len(got) == 4 * 4 and {r.query_id for r in got} == {0, 20, 40, 60}
    assert neighbours.nearest(frame.limit(0)).count() == 0
    assert neighbours.nearest(frame.where("vec_id = 20")).count() == 0


def test_recall_on_the_given_table(spark, sf_dir):
    frame = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    got = {}
    for row in neighbours.nearest(frame, cell_rows=64).orderBy("query_id", "rank").collect():
        got.setdefault(row.query_id, []).append((row.vec_id, row.score))
    rows = frame.collect()
    ids = np.array([r.vec_id for r in rows])
    base = np.array([r.embedding for r in rows], float)
    expected = {}
    for at in np.flatnonzero(ids % 20 == 0):
        scores = base @ base[at]
        near = sorted((-s, i) for s, i in zip(scores.tolist(), ids.tolist()) if i != ids[at])[:20]
        expected[ids[at]] = [(i, -s) for s, i in near]
    assert recall(got, expected) >= 0.95


def test_chi_square_quantiles():
    assert neighbours.chi_square_quantile(0.95, 8) == pytest.approx(15.5073, abs=1e-3)
    assert neighbours.chi_square_quantile(0.5, 1) == pytest.approx(0.4549, abs=1e-3)
