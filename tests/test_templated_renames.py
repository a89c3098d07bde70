"""Files of one template, each with its own line edited, against all pairs."""

import random

from massmap.operators import changes as C

PLAIN = "100644"


def snapshot(spark, files):
    rows = [("r", path, PLAIN, len(body), body.encode()) for path, body in files.items()]
    return spark.createDataFrame(rows, "repo string, path string, mode string, size long, content binary")


def templated(count, lines=20):
    pick = random.Random(count)
    template = [f"setting {k} = {k * k}" for k in range(lines)]
    old = {f"old/{n:03d}": "\n".join([*template[:9], f"own {n} " + "x" * pick.randrange(30), *template[9:]]) for n in range(count)}
    places = pick.sample(range(count), count)
    new = {f"new/{places[n]:03d}": "\n".join([*template[:9], f"edited {n} " + "y" * pick.randrange(30), *template[9:]]) for n in range(count)}
    return old, new


def likeness(one, other):
    sizes = []
    for body in (one, other):
        held = {}
        for line in body.split("\n"):
            held[line] = held.get(line, 0) + len(line) + 1
        sizes.append(held)
    a, b = sizes
    return sum(min(n, b.get(line, 0)) for line, n in a.items()) / max(sum(a.values()), sum(b.values()))


def renamed(spark, old, new):
    before, after = snapshot(spark, old), snapshot(spark, new)
    rows = C.with_similar_renames(C.changed_paths(before, after), before, after).collect()
    return {r.base_path: r.path for r in rows if r.status == "renamed"}


def assert_best_first(old, new, pairs):
    """No two files are more alike than both are to the partners they got."""
    got = {old_path: likeness(old[old_path], new[path]) for old_path, path in pairs.items()}
    back = {path: old_path for old_path, path in pairs.items()}
    assert len(back) == len(pairs) and all(n >= 0.5 for n in got.values())
    for one, body in old.items():
        for other, text in new.items():
            like = likeness(body, text)
            assert like < 0.5 or like <= max(got.get(one, 0), got.get(back.get(other), 0))


def test_thirty_files_of_one_template(spark):
    old, new = templated(30)
    pairs = renamed(spark, old, new)
    assert len(pairs) == 30
    assert_best_first(old, new, pairs)


def test_partners_beside_a_crowd_and_a_rare_line(spark):
    """A rare line shared with a stranger hides no partner, and files without one stay."""
    old, new = templated(20)
    old = {path: body + f"\nrare {path[-3:]}" for path, body in old.items()}
    new |= {f"strange/{n:03d}": f"rare {n:03d}\n" + "\n".join(f"text {n} {k}" for k in range(40)) for n in range(20)}
    pairs = renamed(spark, old, new)
    assert len(pairs) == 20 and all(path.startswith("new/") for path in pairs.values())
    assert_best_first(old, new, pairs)


def test_a_template_of_more_files_than_meet_at_once(spark):
    old, new = templated(150)
    assert len(renamed(spark, old, new)) == 150
