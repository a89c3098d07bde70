import pytest
from pyspark.sql import functions as F

from massmap.functions import text as T
from massmap.operators import admission as D
from massmap.operators import commits as K
from massmap.sources import corpus as S
from massmap.streaming import rescan as M


def test_tree_is_read_below_its_root(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "a.ts").write_bytes(b"let a;\n")
    (tmp_path / "big.bin").write_bytes(b"x" * 100)
    tree = S.read_tree(spark, str(tmp_path), "r")
    assert {(r.path, r.size) for r in tree.select("path", "size").collect()} == {("src/a.ts", 7), ("big.bin", 100)}


def test_ignore_rules_scope_and_order(spark):
    rules = [("r", ".gitignore", "*.log\n!keep.log\n/build/\ndocs/**/*.tmp\n\\#odd\n"), ("r", "src/.gitignore", "gen\n!x.log\n")]
    paths = ["a.log", "keep.log", "build/x", "src/build/x", "docs/a/b/c.tmp", "docs/c.tmp", "#odd", "src/gen/deep/f.ts", "gen/f.ts", "src/x.log"]
    listing = spark.createDataFrame([("r", p) for p in paths], "repo string, path string")
    found = D.ignored(listing, D.ignore_rules(spark.createDataFrame(rules, "repo string, path string, text string")))
    assert {r.path for r in found.collect()} == {"a.log", "build/x", "docs/a/b/c.tmp", "docs/c.tmp", "#odd", "src/gen/deep/f.ts", "src/x.log"}


def test_previews_keep_characters_whole(spark):
    frame = spark.createDataFrame([("é" * 10,), ("abc",)], "t string")
    assert [r[0] for r in frame.select(S.cut_text(F.col("t"), 7)).collect()] == ["ééé", "abc"]


def history(spark):
    edges = {"a": [], "b": ["a"], "c": ["b"], "x": ["b"], "m": ["c", "x"], "d": ["m"]}
    rows = [("r", sha, parents, f"2024-01-0{at + 1} 00:00:00") for at, (sha, parents) in enumerate(edges.items())]
    return spark.createDataFrame(rows, "repo string, sha string, parents array<string>, at string").withColumn(
        "author_date", F.col("at").cast("timestamp"))


def seed(spark, sha):
    return spark.createDataFrame([("r", sha)], "repo string, sha string")


def test_history(spark):
    commits = history(spark)
    assert {r.sha for r in K.ancestors(commits, seed(spark, "d")).collect()} == set("abcxmd")
    assert {r.sha for r in K.merge_base(commits, seed(spark, "c"), seed(spark, "x")).collect()} == {"b"}
    assert {r.sha for r in K.commit_range(commits, seed(spark, "c"), seed(spark, "d")).collect()} == {"x", "m", "d"}


def test_long_straight_history(spark):
    commits = spark.range(500).select(
        F.lit("r").alias("repo"), F.col("id").cast("string").alias("sha"),
        F.when(F.col("id") == 0, F.array().cast("array<string>")).otherwise(F.array((F.col("id") - 1).cast("string"))).alias("parents"))
    assert K.ancestors(commits, seed(spark, "499")).count() == 500


def test_rescan_keeps_the_newest(spark, tmp_path):
    source, index, progress = (str(tmp_path / name) for name in ("in", "index", "progress"))
    schema = "repo string, path string, version bigint, text string"

    def arrive(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        M.rescan(stream, lambda f: f.withColumn("tokens", T.pre_tokens(F.col("text"))).drop("text"), index, progress).awaitTermination()
        return {(r.path, r.version, r.tokens) for r in M.current(spark, index).collect()}

    assert arrive([("r", "a", 1, "one"), ("r", "b", 1, "one two")]) == {("a", 1, 1), ("b", 1, 3)}
    assert arrive([("r", "a", 3, "one two"), ("r", "a", 2, "x"), ("r", "c", 1, "")]) == {("a", 3, 3), ("b", 1, 3), ("c", 1, 0)}
    M.merge_batch(index)(spark.createDataFrame([("r", "b", 0, 9)], "repo string, path string, version bigint, tokens bigint"), 7)
    assert {(r.path, r.version) for r in M.current(spark, index).collect()} == {("a", 3), ("b", 1), ("c", 1)}


def test_rescan_takes_removed_paths_out(spark, tmp_path):
    index = str(tmp_path / "index")
    schema = "repo string, path string, version bigint, removed boolean"

    def merge(rows, number):
        M.merge_batch(index, 4)(spark.createDataFrame(rows, schema), number)
        return {(r.repo, r.path, r.version) for r in M.current(spark, index).collect()}

    first = [("r", "a", 1, None), ("r", "b", 1, False), ("s", "a", 1, False), ("t", "x", 1, False)]
    assert merge(first, 0) == {("r", "a", 1), ("r", "b", 1), ("s", "a", 1), ("t", "x", 1)}
    before = M.current(spark, index)
    removal = [("r", "a", 5, True), ("s", "a", 1, True)]
    assert merge(removal, 1) == merge(removal, 1) == {("r", "b", 1), ("t", "x", 1)}
    assert before.count() == 4  # a reader of the older manifest keeps its slices
    assert merge([("r", "a", 4, False)], 2) == {("r", "b", 1), ("t", "x", 1)}  # an older version comes late
    assert merge([("r", "a", 6, False)], 3) == {("r", "a", 6), ("r", "b", 1), ("t", "x", 1)}
    listing = spark.createDataFrame([("r", "a")], "repo string, path string")
    repos = spark.createDataFrame([("r",), ("t",)], "repo string")
    M.merge_batch(index)(M.removed_paths(M.current(spark, index), listing, repos, 9), 4)
    assert {(r.repo, r.path) for r in M.current(spark, index).collect()} == {("r", "a")}
    assert merge([], 5) == {("r", "a", 6)}


def test_empty_comparisons_are_refused_and_the_whole_range_is_no_span(spark):
    pairs = spark.createDataFrame([("r", "main", "c"), ("r", "a", "main"), ("r", "c", "c")], "repo string, base string, target string")
    names = spark.createDataFrame([("r", "main", "c")], "repo string, name string, sha string")
    refused = {(r.base, r.target): r.refusal for r in K.revision_pairs(pairs, names).collect()}
    assert refused[("main", "c")] == "nothing to compare: main and c are the same commit"
    assert refused[("a", "main")] is None and refused[("c", "c")] is not None
    commits = spark.createDataFrame(
        [(repo, sha, parents) for repo in "pqo" for sha, parents in (("a", []), ("b", ["a"]), ("c", ["a"]), ("z", []))],
        "repo string, sha string, parents array<string>")
    asked = spark.createDataFrame([("p", "b", "c"), ("q", "b", "a"), ("o", "b", "z")], "repo string, base string, target string")
    got = {r.repo: (r.base_sha, r.refusal) for r in K.merge_base_pairs(commits, asked).collect()}
    assert got == {
        "p": ("a", None), "q": ("a", "nothing to compare: a is an ancestor of b, so b...a is empty"),
        "o": (None, "no merge base between b and z"),
    }
    spine = spark.createDataFrame([("r", 0, "b", "a"), ("r", 1, "c", "b"), ("r", 2, None, "c")], "repo string, ord int, sha string, parent string")
    spans = spark.createDataFrame([("r", "a", "c"), ("r", "b", "c"), ("r", "b", None)], "repo string, base string, target string")
    whole = spark.createDataFrame([("r", "a", "c")], "repo string, base string, target string")
    assert {(r.base, r.target, r.start, r.end) for r in K.spans_of(spans, spine, whole).collect()} == {("b", "c", 1, 1), ("b", None, 1, 2)}


def test_ignore_rules_do_not_mind_letter_case(spark):
    from massmap.operators import admission as D

    paths = ["README.MD", "Build/x.o", "build/keep.txt", "src/Main.go", "docs/KEEP.md"]
    listing = spark.createDataFrame([("r", path) for path in paths], "repo string, path string")
    rules = D.ignore_rules(spark.createDataFrame([("r", ".gitignore", "*.md\nBUILD/\n!keep.md\n")], "repo string, path string, text string"))
    assert {r.path for r in D.ignored(listing, rules).collect()} == {"README.MD", "Build/x.o", "build/keep.txt"}


def test_files_of_any_size_are_read_unless_a_ceiling_is_asked_for(spark):
    from massmap.operators import admission as D

    body = b"x = 1\n" * 600_000
    frame = spark.createDataFrame([("r", "big.py", "100644", len(body), body)], "repo string, path string, mode string, size bigint, content binary")
    assert D.admit(frame).first().measurement == "measured"
    assert D.admit(frame, max_bytes=2 << 20).first().measurement == "too-large"


def test_an_export_is_whole_or_nothing(spark, tmp_path):
    place = tmp_path / "out" / "bundle"
    files = spark.createDataFrame([("r", "a.py")], "repo string, path string")
    spine = spark.createDataFrame([("r", "c1")], "repo string, sha string")
    broken = files.withColumn("content", F.raise_error(F.lit("unreadable disk")))
    with pytest.raises(Exception, match="unreadable disk"):
        S.export_snapshot(str(place), files, files, spine, broken)
    assert not place.exists() and list(tmp_path.glob("**/*staging*")) == []
    place.mkdir(parents=True)  # an empty folder is no earlier export
    S.export_snapshot(str(place), files, files, spine, files)
    assert sorted(p.name for p in place.iterdir()) == ["files", "folders", "sources", "spine"]
    assert spark.read.parquet(str(place / "spine")).count() == 1
    with pytest.raises(FileExistsError):
        S.export_snapshot(str(place), files, files, None, files)
    assert [p.name for p in place.parent.iterdir()] == ["bundle"] and (place / "spine").exists()


def test_asked_revisions_are_listed_once(spark):
    rows = [("r", "1", "a"), ("r", "2", "a"), ("r", "2", "b"), ("s", "1", "c")]
    listed = spark.createDataFrame(rows, "repo string, rev string, path string")
    wanted = spark.createDataFrame([("r", "2"), ("r", "2"), ("s", "9")], "repo string, rev string")
    assert sorted(map(tuple, S.revisions(listed, wanted).collect())) == [("r", "2", "a"), ("r", "2", "b")]


def test_rescan_reads_a_table_that_is_a_folder(spark, sf_dir, tmp_path):
    from catalog.sources import m1, m1_listing

    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    turns.repartition(3).write.parquet(str(tmp_path / "conversations.parquet"))
    for query in (m1, m1_listing):
        folder, file = (sorted(map(tuple, query(spark, place).collect())) for place in (str(tmp_path), sf_dir))
        assert folder and folder == file
