"""Pages far behind the first rows, against plain sorting."""

import random

import pytest
from pyspark.sql import functions as F

from massmap.operators import ordered


@pytest.fixture(scope="module")
def told(spark):
    draw = random.Random(8)
    rows = [("hot", f"p{n:05}", draw.randrange(40)) for n in range(3000)]
    rows += [("small", f"p{n}", draw.randrange(3)) for n in range(25)] + [("one", "p", 1)]
    return rows, spark.createDataFrame(rows, "repo string, path string, weight long").repartition(5)


@pytest.mark.parametrize("asked, limit", [(0, 10), (1490, 10), (2990, 10), (100000, 9), (2000, 1000), (2500, 2500)])
def test_a_page_holds_the_places_a_sort_gives(told, asked, limit):
    rows, frame = told
    order = [F.col("weight").desc(), F.col("path").asc()]
    got = [tuple(r) for r in ordered.far_page(frame, ["repo"], order, asked, limit).collect()]
    expected = []
    for repo in ("hot", "small", "one"):
        whole = sorted((row for row in rows if row[0] == repo), key=lambda row: (-row[2], row[1]))
        start = min(asked, (len(whole) - 1) // limit * limit)
        expected += [(*row, start + at + 1, len(whole), start) for at, row in enumerate(whole[start : start + limit])]
    assert sorted(got) == sorted(expected)


def test_an_empty_table_has_no_page(told):
    _, frame = told
    assert ordered.far_page(frame.limit(0), ["repo"], [F.col("path")], 2000, 10).collect() == []
