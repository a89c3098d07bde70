"""Ignore files of many turns between ignoring and re-admitting, against plain Python."""

import fnmatch
import random

from massmap.operators import admission as D


def ignored(path, files):
    """Last match of each scope decides there; an ignored folder takes everything below."""
    parts = path.split("/")
    for depth in range(1, len(parts) + 1):
        entry, is_folder = parts[:depth], depth < len(parts)
        for base, rules in files.items():
            above = base.split("/") if base else []
            if entry[: len(above)] != above or len(entry) <= len(above):
                continue
            verdict = False
            for rule in rules:
                glob = rule.lstrip("!").lower()
                if (is_folder or not glob.endswith("/")) and fnmatch.fnmatchcase(entry[-1].lower(), glob.rstrip("/")):
                    verdict = not rule.startswith("!")
            if verdict:
                return True
    return False


def test_the_last_match_of_a_long_ignore_file_decides(spark):
    draw = random.Random(3)
    globs = ["*.a", "*.B", "x*", "?y.*", "q/", "R", "*", "q.a", "z?.c/"]
    files = {
        base: [draw.choice(["", "", "!"]) + draw.choice(globs[:-3] + globs[-2:]) for _ in range(size)]
        for base, size in (("", 60), ("q", 25), ("p/R", 40))
    }
    files["p"] = ["*", "!*.a", "!R"]
    names = ["q", "R", "r", "p", "xy.a", "zy.b", "q.a", "z1.c", "k.c", "k"]
    paths = sorted({"/".join(draw.choice(names) for _ in range(draw.randrange(1, 5))) for _ in range(400)})
    listing = spark.createDataFrame([("one", p) for p in paths] + [("two", p) for p in paths], "repo string, path string")
    texts = [("one", f"{base}/.gitignore".lstrip("/"), "\n".join(rules)) for base, rules in files.items()]
    rules = D.ignore_rules(spark.createDataFrame(texts, "repo string, path string, text string"))
    got = [(r.repo, r.path) for r in D.ignored(listing, rules).collect()]
    expected = sorted(("one", p) for p in paths if ignored(p, files))
    assert sorted(got) == expected and 0 < len(expected) < len(paths)


def test_no_rules_and_comments_only(spark):
    listing = spark.createDataFrame([("r", "a/b")], "repo string, path string")
    for text in ("", "# only a remark\n\n"):
        rules = D.ignore_rules(spark.createDataFrame([("r", ".gitignore", text)], "repo string, path string, text string"))
        assert D.ignored(listing, rules).collect() == []
