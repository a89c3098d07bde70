from pyspark.sql import functions as F

from massmap.plans import view as W
from tests.weighted import weighted

TREE = [
    {"path": "HELP.md", "tokens": 9, "kind": "text"},
    {"path": "kit/start.go", "tokens": 60},
    {"path": "kit/tools.go", "tokens": 25},
    {"path": "kit/inner/parse.go", "tokens": 15},
    {"path": "checks/start_test.go", "tokens": 12, "kind": "test"},
    {"path": "out/all.js", "tokens": 350, "generated": True},
    {"path": "kit/icon.png", "measurement": "binary", "kind": "code"},
]


def answers(spark, rows, **request):
    return W.view(weighted(spark, rows), W.View(**request))


def test_tree_detail_and_summary(spark):
    got = answers(spark, TREE, expanded=("", "kit"))
    drawn = [(r.depth, r.path, r.row_kind, r.weight, r.files) for r in got["tree"].orderBy("sort_key").collect()]
    assert drawn == [
        (0, "", "folder", 121, 7), (1, "", "files", 9, 1), (1, "checks", "folder", 12, 1), (1, "kit", "folder", 100, 4),
        (2, "kit", "files", 85, 3), (2, "kit/inner", "folder", 15, 1), (1, "out", "folder", 0, 1),
    ]
    by_path = {(r.path, r.row_kind): r for r in got["tree"].collect()}
    assert by_path["out", "folder"].filtered_out
    assert by_path["kit", "files"].unmeasured_files == 1
    one = got["summary"].collect()[0]
    assert (one.project_weight, one.selected_weight, one.selected_files) == (471, 121, 5)
    stats = {r.flavor: (r.weight, r.enabled) for r in got["flavors"].collect()}
    assert stats["generated"] == (350, False) and stats["code"] == (100, True) and stats["i18n"] == (0, True)
    seen = got["detail"].collect()[0]
    assert (seen.shown_files, seen.available_files, seen.unmeasured_files, seen.generated_files) == (5, 7, 1, 1)


def test_weight_order(spark):
    got = answers(spark, TREE, expanded=("", "kit"), tree_sort="weight", show_generated=True)
    drawn = [r.path for r in got["tree"].where("row_kind = 'folder'").orderBy("sort_key").collect()]
    assert drawn == ["", "out", "kit", "kit/inner", "checks"]


def test_exclusions_inherit_and_mark(spark):
    got = answers(spark, TREE, expanded=("", "kit"), excluded_folders=("kit",), excluded_direct=("checks",))
    rows = {(r.path, r.row_kind): r for r in got["tree"].collect()}
    assert not rows["kit", "folder"].included and not rows["kit", "folder"].disabled
    assert rows["kit/inner", "folder"].disabled
    assert rows["", "folder"].indeterminate and rows["checks", "folder"].indeterminate
    assert rows["", "folder"].weight == 9


def test_ribbon_tail(spark):
    heavy = [{"path": "base/x.go", "tokens": 9000}] + [{"path": f"bit{n}/y.go", "tokens": 1} for n in range(9)]
    names = [r.name for r in answers(spark, heavy)["ribbon"].orderBy("place").collect()]
    assert names == ["base", "9 more folders"]
    even = [{"path": f"lane{n:02d}/z.go", "tokens": 4} for n in range(23)]
    names = [r.name for r in answers(spark, even)["ribbon"].orderBy("place").collect()]
    assert len(names) == 21 and names[-1] == "3 more folders"


def test_tiles_fill_one_row(spark):
    rows = [{"path": f"p{n}/a.ts", "tokens": n} for n in range(1, 6)] + [{"path": "x.ts", "tokens": 1}]
    names = [r.name for r in answers(spark, rows, tiles=3)["tiles"].orderBy("place").collect()]
    assert names == [".", "p5", "4 more folders"]
    names = [r.name for r in answers(spark, rows, tiles=1)["tiles"].orderBy("place").collect()]
    assert names == ["."]


def test_pages_clamp_and_names_never_cut(spark):
    rows = [{"path": f"f{n:02d}.ts", "tokens": 100 - n} for n in range(10)]
    page = answers(spark, rows, limit=4, offset=100)["ranked"]
    got = page.orderBy("rank").collect()
    assert [r.path for r in got] == ["f08.ts", "f09.ts"] and got[0].ranked_offset == 8 and got[0].ranked_total == 10
    named = answers(spark, rows, limit=3, metric="name")["ranked"].orderBy("path").collect()
    assert [r.path for r in named] == ["f00.ts", "f01.ts", "f02.ts"]
    floor = answers(spark, TREE, min_weight=40)["files"].select(F.collect_set("path")).collect()[0][0]
    assert set(floor) == {"kit/start.go", "kit/icon.png"}


def test_scope_and_selection(spark):
    got = answers(spark, TREE, scope="kit", selected="checks")
    assert got["detail"].collect()[0].path == "kit"
    assert {r.folder for r in got["expandable"].collect()} == {"kit", "kit/inner"}
    direct = answers(spark, TREE, selected="kit", selected_direct=True)
    one = direct["detail"].collect()[0]
    assert (one.title, one.trail, one.weight) == (".", ["", "kit"], 85)
    assert {r.path for r in direct["files"].collect()} == {"kit/start.go", "kit/tools.go", "kit/icon.png"}
