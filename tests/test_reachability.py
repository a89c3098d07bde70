"""Reachability over histories with merges, against a walk in plain Python."""

import random

import pytest

from massmap.operators import commits as K


def history(draw, repo, length):
    """Short side lines, merges of two to four parents, roots of their own, and a parent that is not listed."""
    rows = []
    for at in range(length):
        parents = [f"{at - 1}"] if at and draw.random() < 0.95 else ["elsewhere"] if draw.random() < 0.3 else []
        if at > 3 and draw.random() < 0.3:
            parents += [str(draw.randrange(at - 1)) for _ in range(draw.randrange(1, 4))]
        if at > 5 and draw.random() < 0.3 and parents:
            parents[0] = str(draw.randrange(at - 4, at))
        rows.append((repo, str(at), parents))
    return rows


def behind(rows, repo, starts):
    parents = {sha: p for r, sha, p in rows if r == repo}
    seen, todo = set(), list(starts)
    while todo:
        sha = todo.pop()
        if sha not in seen:
            seen.add(sha)
            todo += parents.get(sha, [])
    return seen


@pytest.fixture(scope="module")
def told(spark):
    draw = random.Random(11)
    rows = history(draw, "a", 90) + history(draw, "b", 40) + [("c", "0", []), ("c", "1", ["0"])]
    return rows, spark.createDataFrame(rows, "repo string, sha string, parents array<string>").repartition(4)


def seeds(spark, pairs):
    return spark.createDataFrame(pairs, "repo string, sha string")


def test_every_seed_reaches_what_a_walk_reaches(spark, told):
    rows, commits = told
    pairs = [("a", "89"), ("a", "40"), ("a", "40"), ("a", "7"), ("b", "39"), ("b", "missing"), ("b", None)]
    got = [(r.repo, r.seed, r.sha) for r in K.ancestors(commits, seeds(spark, pairs)).collect()]
    assert len(got) == len(set(got))
    assert set(got) == {(repo, seed, sha) for repo, seed in pairs if seed for sha in behind(rows, repo, [seed])}


def test_ranges_and_merge_bases(spark, told):
    rows, commits = told
    one, other = [("a", "80"), ("b", "30"), ("c", "0")], [("a", "89"), ("b", "35"), ("c", "1")]
    reach = lambda side: {(repo, sha) for repo, seed in side for sha in behind(rows, repo, [seed])}
    got = K.commit_range(commits, seeds(spark, one), seeds(spark, other)).collect()
    assert sorted((r.repo, r.sha) for r in got) == sorted(reach(other) - reach(one))
    common = reach(one) & reach(other)
    parents = {(repo, p) for repo, sha, all_of in rows if (repo, sha) in common for p in all_of}
    got = K.merge_base(commits, seeds(spark, one), seeds(spark, other)).collect()
    assert sorted((r.repo, r.sha) for r in got) == sorted(common - parents)


def test_nothing_to_walk(spark, told):
    _, commits = told
    assert K.ancestors(commits, seeds(spark, [])).columns == ["repo", "seed", "sha"]
    assert K.ancestors(commits.limit(0), seeds(spark, [("a", "3")])).collect() == [("a", "3", "3")]
    assert K.commit_range(commits, seeds(spark, [("a", "5")]), seeds(spark, [("a", "5")])).count() == 0


def test_short_side_lines_do_not_walk_the_history_again(spark, monkeypatch):
    """Steps of the second round end where the first has been."""
    main = 600
    rows = [("r", f"{n}", ([f"{n - 1}"] if n else []) + ([f"s{n}"] if n % 10 == 9 else [])) for n in range(main)]
    rows += [("r", f"s{n}", [f"{n - 4}"]) for n in range(9, main, 10)]
    commits = spark.createDataFrame(rows, "repo string, sha string, parents array<string>")
    sizes, original = [], K.written

    def counted(frame, label="stage"):
        table = original(frame, label)
        sizes.append((label, table.count()))
        return table

    monkeypatch.setattr(K, "written", counted)
    found = K.ancestors(commits, seeds(spark, [("r", f"{main - 1}")]))
    assert found.count() == len(rows)
    assert sum(n for label, n in sizes if label == "reached") == len(rows)  # nothing is reached twice
    assert sum(label == "stride" for label, _ in sizes) <= 11
    assert sum(label == "reached" for label, _ in sizes) <= 15
