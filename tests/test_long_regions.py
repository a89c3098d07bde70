"""Changed regions longer than the former cap."""

import random
import time

from massmap.operators import changes as C

PAIR = "repo string, path string, before_line_texts array<string>, after_line_texts array<string>"


def common_lines(before, after):
    """Length of a longest common subsequence, by bit rows."""
    place = {}
    for at, line in enumerate(after):
        place[line] = place.get(line, 0) | 1 << at
    full = (1 << len(after)) - 1
    row = full
    for line in before:
        hit = row & place.get(line, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(after) - row.bit_count()


def test_large_regions_are_aligned_minimally(spark):
    pick = random.Random(3)
    base = [f"line {i}" for i in range(9000)]
    fewer = ["new head", *[x for i, x in enumerate(base) if i % 10 and i], "new tail"]
    pairs = {
        "unique": (base, fewer),
        "repeating": tuple([f"{side} head", *[str(pick.randrange(60)) for _ in range(6000)], f"{side} tail"] for side in "ab"),
        "long and thin": (["x", *[str(i) for i in range(0, 200, 3)], "y"], ["v", *[str(pick.randrange(300)) for _ in range(12000)], "w"]),
    }
    frame = spark.createDataFrame([("r", path, *sides) for path, sides in pairs.items()], PAIR)
    for row in C.with_line_diff(frame).collect():
        before, after = pairs[row.path]
        shared = common_lines(before, after)
        assert not row.capped
        assert (len(row.removed), len(row.added)) == (len(before) - shared, len(after) - shared), row.path
        out, came = set(row.removed), set(row.added)
        assert [x for i, x in enumerate(before) if i not in out] == [x for i, x in enumerate(after) if i not in came]


def test_few_edits_in_very_long_files(spark):
    """The cost follows the edits: bit rows alone would take 300,000 times 300,000 / 64 steps."""
    pick = random.Random(4)
    before = [f"line {i % 5000}" for i in range(300_000)]
    after = list(before)
    for _ in range(200):
        at = pick.randrange(len(after))
        after[at : at + pick.randrange(2)] = [f"line {pick.randrange(5000)}"] * pick.randrange(2)
    frame = spark.createDataFrame([("r", "long", before, after)], PAIR)
    started = time.time()
    row = C.with_line_diff(frame).collect()[0]
    assert time.time() - started < 60
    out, came = set(row.removed), set(row.added)
    assert [x for i, x in enumerate(before) if i not in out] == [x for i, x in enumerate(after) if i not in came]
    assert 100 < len(row.removed) + len(row.added) <= 400


def test_furthest_paths_are_minimal_past_their_reach_too(spark):
    """More than 1,000 differences, so paths give up, parts are halved and start anew."""
    pick = random.Random(6)
    before = [str(pick.randrange(400)) for _ in range(7000)]
    after = [x if pick.random() > 0.12 else str(pick.randrange(400)) for x in before]
    before, after = ["a", *before, "b"], ["c", *after, "d"]
    row = C.with_line_diff(spark.createDataFrame([("r", "p", before, after)], PAIR)).collect()[0]
    shared = common_lines(before, after)
    assert (len(row.removed), len(row.added)) == (len(before) - shared, len(after) - shared)
