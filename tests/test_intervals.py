"""Changes of a range as the ends of intervals, against comparing every pair of trees."""

import random

from massmap.operators import intervals as I

TREE = "repo string, rev string, path string, mode string, size long, content binary"


def history():
    pick, trees, listed = random.Random(9), {}, []
    tree, before = {}, "0000"
    for at in range(40):
        if at in (0, 13, 14, 27):  # another line of history: its parent is no listed commit
            before = f"base{at}"
            tree = {f"p{k}": pick.choice("abc") for k in range(6)} if at else {}
            trees[before] = dict(tree)
        for k in pick.sample(range(8), 3):
            if pick.random() < 0.4:
                tree.pop(f"p{k}", None)
            else:
                tree[f"p{k}"] = pick.choice("abc")
        trees[f"c{at}"] = dict(tree)
        listed.append(("r", at, f"c{at}", before))
        before = f"c{at}"
    return trees, listed


def test_changes_and_intervals(spark):
    trees, listed = history()
    rows = [("r", rev, path, "100644", 1, body.encode()) for rev, tree in trees.items() for path, body in tree.items()]
    snapshots = spark.createDataFrame(rows, TREE)
    order = I.tree_row(spark.createDataFrame(listed, "repo string, ord int, sha string, parent string"))
    entries = I.tree_entries(order, snapshots)
    wanted = set()
    for _, _, sha, parent in listed:
        old, new = trees.get(parent, {}), trees[sha]
        for path in old.keys() | new.keys():
            if old.get(path) != new.get(path):
                wanted.add((sha, path, "added" if path not in old else "deleted" if path not in new else "modified"))
    changes = I.interval_changes(entries, order)
    found = [(r.sha, r.path, r.status) for r in changes.collect()]
    assert len(found) == len(set(found)) and set(found) == wanted
    places = {r.place: r.rev for r in order.collect()}
    assert sorted(places) == list(range(1, len(places) + 1)) and len(places) == len(trees)
    held = {(place, path): body for place, rev in places.items() for path, body in trees[rev].items()}
    covered = {}
    for r in I.path_intervals(entries).collect():
        bodies = {held[at, r.path] for at in range(r.from_place, r.to_place + 1)}
        assert len(bodies) == 1
        for at in (r.from_place - 1, r.to_place + 1):
            assert held.get((at, r.path)) not in bodies
        covered.update({(at, r.path): r.blob for at in range(r.from_place, r.to_place + 1)})
    assert covered.keys() == held.keys()
    before, after = I.changed_sides(changes, I.changed_contents(changes, snapshots))
    assert {(r.sha, r.path, bytes(r.content).decode()) for r in after.collect()} == {
        (sha, path, trees[sha][path]) for sha, path, status in wanted if status != "deleted"
    }
    assert before.count() == sum(status != "added" for *_, status in wanted)
