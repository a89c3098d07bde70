import random

from pyspark.sql import functions as F

from massmap.operators import changes as C
from massmap.operators.ordered import ranked, running_totals, top
from massmap.plans.diff import diff


def longest_common(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = row[:]
        for j, y in enumerate(b):
            row[j + 1] = before[j] + 1 if x == y else max(before[j + 1], row[j])
    return row[-1]


def line_pairs(spark, count, longest):
    pick = random.Random(7)
    rows = []
    for trial in range(count):
        letters = "abcd"[: pick.randint(1, 4)]
        rows.append(("r", str(trial), *[[pick.choice(letters) for _ in range(pick.randint(0, longest))] for _ in range(2)]))
    schema = "repo string, path string, before_line_texts array<string>, after_line_texts array<string>"
    return rows, spark.createDataFrame(rows, schema)


def test_minimal_and_readable_back(spark):
    rows, frame = line_pairs(spark, 600, 14)
    got = {r.path: r for r in C.with_line_diff(frame).collect()}
    for _, trial, before, after in rows:
        common = longest_common(before, after)
        found = got[trial]
        assert len(found.removed) == len(before) - common and len(found.added) == len(after) - common
        assert [x for i, x in enumerate(before) if i not in found.removed] == [x for i, x in enumerate(after) if i not in found.added]
    printed = C.aligned_lines(C.with_line_diff(frame)).orderBy("path", "ord").collect()
    sides = {}
    for line in printed:
        old, new = sides.setdefault(line.path, ([], []))
        if line.marker != "+":
            old.append(line.text)
            assert line.before_line == len(old)
        if line.marker != "-":
            new.append(line.text)
            assert line.after_line == len(new)
    for _, trial, before, after in rows:
        assert sides.get(trial, ([], [])) == (before, after)


def test_cap_replaces_the_whole_region(spark):
    rows = [("r", "x", ["h", *map(str, range(6)), "t"], ["h", *map(str, range(5, -1, -1)), "t"])]
    frame = spark.createDataFrame(rows, "repo string, path string, before_line_texts array<string>, after_line_texts array<string>")
    over = C.with_line_diff(frame, cap=11).collect()[0]
    assert over.capped and over.removed == list(range(1, 7)) and over.added == list(range(1, 7))
    assert not C.with_line_diff(frame, cap=12).collect()[0].capped


def snapshot(spark, files):
    rows = [("r", path, mode, len(body) if body is not None else None, body) for path, mode, body in files]
    return spark.createDataFrame(rows, "repo string, path string, mode string, size bigint, content binary")


def test_comparison_rows(spark):
    plain = "100644"
    before = snapshot(spark, [
        ("lib/sum.ts", plain, b"let p = 1;\nlet q = 2;\nlet r = 3;\n"), ("lib/dead.ts", plain, b"f();\ng();\nh();\n"),
        ("notes/a.txt", plain, b"kept\n"), ("ends.txt", plain, b"one\r\ntwo\r\n"), ("pipe", plain, b"x"),
        ("blob.dat", plain, b"fine\n"), ("start.sh", plain, b"echo\n"),
    ])
    after = snapshot(spark, [
        ("lib/sum.ts", plain, b"// first\n// second\nlet p = 1;\nlet q = 5;\nlet r = 3;\nlet s;\n"),
        ("lib/new.ts", plain, b"// top\nrun();\n"), ("notes/b/a.txt", plain, b"kept\n"), ("ends.txt", plain, b"one\ntwo\n"),
        ("pipe", "120000", b"goal"), ("blob.dat", plain, b"q\x00r"), ("start.sh", "100755", b"echo\n"),
    ])
    got = {r.path: r for r in diff(before, after).collect()}
    edited = got["lib/sum.ts"]
    assert (edited.added_comment_lines, edited.added_code_lines, edited.removed_code_lines) == (2, 2, 1)
    gone = got["lib/dead.ts"]
    assert (gone.status, gone.lines, gone.net_lines, gone.before_lines) == ("deleted", 0, -3, 3)
    fresh = got["lib/new.ts"]
    assert (fresh.added_code_lines, fresh.added_comment_lines) == (1, 1)
    moved = got["notes/b/a.txt"]
    assert (moved.status, moved.previous_path, moved.churn_lines) == ("renamed", "notes/a.txt", 0)
    assert got["ends.txt"].churn_lines == 0
    assert (got["pipe"].measurement, got["pipe"].tokens) == ("symlink", None)
    assert got["blob.dat"].measurement == "binary"
    assert (got["start.sh"].status, got["start.sh"].churn_tokens) == ("modified", 0)
    for row in got.values():
        if row.measurement == "measured":
            assert row.lines == row.code_lines + row.comment_lines
            for m in ("tokens", "lines", "code_lines"):
                assert row[f"churn_{m}"] == row[f"added_{m}"] + row[f"removed_{m}"]
                assert row[f"net_{m}"] == row[f"added_{m}"] - row[f"removed_{m}"]
            assert row.added_lines <= row.added_physical_lines and row.removed_lines <= row.removed_physical_lines


def test_equal_contents_pair_one_to_one(spark):
    plain = "100644"
    before = snapshot(spark, [(f"old/{n:03d}", plain, b"") for n in range(40)])
    after = snapshot(spark, [(f"new/{n:03d}", plain, b"") for n in range(30)])
    rows = C.with_renames(C.changed_paths(before, after)).collect()
    moved = {r.base_path: r.path for r in rows if r.status == "renamed"}
    assert moved == {f"old/{n:03d}": f"new/{n:03d}" for n in range(30)}
    assert sum(r.status == "deleted" for r in rows) == 10 and len(rows) == 40


def test_similar_files_are_renames(spark):
    plain = "100644"
    body = [f"line {n} of this file\n" for n in range(40)]
    before = snapshot(spark, [("a/one.txt", plain, "".join(body).encode()), ("a/other.txt", plain, b"nothing alike\nat all\n")])
    edited = body[:5] + ["fresh\n"] + body[6:]
    after = snapshot(spark, [("b/one.txt", plain, "".join(edited).encode()), ("b/far.txt", plain, b"quite\ndifferent\n")])
    rows = {r.path: r for r in diff(before, after).collect()}
    assert (rows["b/one.txt"].status, rows["b/one.txt"].previous_path) == ("renamed", "a/one.txt")
    assert (rows["b/one.txt"].added_lines, rows["b/one.txt"].removed_lines) == (1, 1)
    assert rows["b/far.txt"].status == "added" and rows["a/other.txt"].status == "deleted"


def test_ranks_agree_with_windows_on_a_hot_group(spark):
    frame = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("g"), F.col("id") % 50)).alias("repo"),
        (F.col("id") * 7919 % 97).alias("weight"), F.col("id").cast("string").alias("path"))
    order = [F.col("weight").desc(), F.col("path").asc()]
    from pyspark.sql import Window

    window = Window.partitionBy("repo").orderBy(*order)
    expected = frame.withColumn("rank", F.row_number().over(window)).withColumn(
        "total", F.sum("weight").over(window.rowsBetween(Window.unboundedPreceding, 0)))
    got = ranked(frame, ["repo"], order).join(running_totals(frame, ["repo"], order, {"total": F.col("weight")}), ["repo", "weight", "path"])
    assert got.select("repo", "path", "rank", "total").exceptAll(expected.select("repo", "path", "rank", "total")).isEmpty()
    assert got.count() == 3000
    far = top(frame, ["repo"], order, 1001).groupBy("repo").count().where("repo = 'hot'").collect()[0][1]
    assert far == 1000


def test_verdicts_of_many_lines_take_linear_time(spark):
    import time

    def took(lines):
        frame = spark.range(1).select(F.repeat(F.lit("c"), lines).alias("v"), F.sequence(F.lit(0), F.lit(lines - 1)).alias("at"))
        best = None
        for _ in range(3):
            started = time.time()
            assert frame.select(C.verdict_count(F.col("v"), F.col("at"), "c").alias("n")).collect()[0].n == lines
            best = min(best or 1e9, time.time() - started)
        return best

    took(1000)
    assert took(320_000) < 20 * took(40_000) + 1


def test_files_with_a_shared_opening_find_their_own_partner(spark):
    plain = "100644"
    opening = [f"shared {k}\n" for k in range(30)]
    old, new = [], []
    for n in range(30):
        own = [f"own {n} {k}\n" for k in range(20)]
        fresh = [f"fresh {n} {k}\n" for k in range(15)]
        old.append((f"a/{n:02d}.txt", plain, "".join(opening + own).encode()))
        new.append((f"b/{(n * 7) % 30:02d}-{n}.txt", plain, "".join(opening + own[:5] + fresh).encode()))
    before, after = snapshot(spark, old), snapshot(spark, new)
    rows = C.with_similar_renames(C.changed_paths(before, after), before, after).collect()
    pairs = {int(r.base_path[2:4]): int(r.path.split("-")[1][:-4]) for r in rows if r.status == "renamed"}
    assert pairs == {n: n for n in range(30)}
