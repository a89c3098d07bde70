"""Lines as numbers, and files that meet in blocks."""

import random

from massmap.operators import changes as C
from massmap.operators import similar
from massmap.operators.interning import interned
from tests.test_templated_renames import likeness, renamed

PAIR = "repo string, path string, before_line_texts array<string>, after_line_texts array<string>"


def by_hand(before, after):
    names = {}
    return [[names.setdefault(line, len(names)) for line in side or []] for side in (before, after)], len(names)


def test_numbers_by_first_appearance(spark):
    pick = random.Random(2)
    line = lambda: pick.choice(["", "a", "b ", "A", "ü", "x" * 300])
    pairs = {f"p{i}": ([line() for _ in range(pick.randrange(9))], [line() for _ in range(pick.randrange(9))]) for i in range(40)}
    pairs |= {"none": (None, None), "empty": ([], []), "old": (["a"], None), "new": (None, ["a", "a"]), None: (["q"], ["q"])}
    rows = interned(spark.createDataFrame([("r", path, *sides) for path, sides in pairs.items()], PAIR)).collect()
    assert {r.path: ([r.before_ids, r.after_ids], r.distinct_lines) for r in rows} == {p: by_hand(*s) for p, s in pairs.items()}
    assert len(rows) == len(pairs)


def test_alignment_on_numbers_is_that_on_texts(spark):
    pick = random.Random(7)
    pairs = [("r", f"p{i}", *[[str(pick.randrange(12)) for _ in range(pick.randrange(40))] for _ in "ab"]) for i in range(30)]
    frame = spark.createDataFrame(pairs, PAIR)
    texts = {r.path: (r.removed, r.added) for r in C.with_line_diff(frame).collect()}
    ids = {r.path: (r.removed, r.added) for r in C.with_line_diff(interned(frame), "before_ids", "after_ids").collect()}
    assert ids == texts


def test_large_buckets_of_unlike_files_meet_in_blocks(spark, monkeypatch):
    """Files drawn from few popular lines: every bucket is large and few pairs in it are alike."""
    monkeypatch.setattr(similar, "MEETING", 1)
    monkeypatch.setattr(similar, "SIDE", 2)
    pick = random.Random(11)
    popular = [f"popular line {i}" for i in range(24)]
    draw = lambda: "\n".join(pick.sample(popular, 8))
    old, new = {f"old/{i}": draw() for i in range(14)}, {f"new/{i}": draw() for i in range(14)}
    found = renamed(spark, old, new)
    alike = {(o, n) for o in old for n in new if likeness(old[o], new[n]) >= 0.5}
    assert len(alike) > 8 and set(found.items()) <= alike and len(set(found.values())) == len(found)
    left = {(o, n) for o, n in alike if o not in found and n not in found.values()}
    assert not left
