"""Histories longer than the former limit."""

from catalog import commits as K
from massmap.operators import commits


def long_history(spark, folder, turns=260):
    rows = [(1, t, "user", f"text {t}\nsecond") for t in range(turns)] + [(2, t, "user", f"other {t}") for t in range(3)]
    spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").write.parquet(f"{folder}/conversations.parquet")
    return str(folder)


def test_a_long_history_is_listed_and_chained_whole(spark, tmp_path):
    sf = long_history(spark, tmp_path)
    rows = K.listed(spark, sf).collect()
    assert {(r.repo, r.ord, r.sha, r.omitted) for r in rows} == {("1", t, f"1:{t}", 0) for t in range(260)} | {("2", t, f"2:{t}", 0) for t in range(3)}
    runs = {(r.repo, r.ord): r.run for r in commits.chained(K.broken(spark, sf)).collect()}
    # an entry starts a run at 0 and wherever its parent was broken
    starts = lambda t: 1 + sum(1 for at in range(1, t + 1) if at % 4 == 3)
    assert runs == {("1", t): starts(t) for t in range(260)} | {("2", t): starts(t) for t in range(3)}


def test_the_spine_of_a_long_history_holds_every_commit(spark, tmp_path):
    found = {(r.repo, r.ord) for r in K.k4(spark, long_history(spark, tmp_path, 210)).select("repo", "ord").collect()}
    assert found == {("1", t) for t in range(210)} | {("2", t) for t in range(3)}
