from pyspark.sql import functions as F

from massmap.functions.figures import heaviest_first
from massmap.functions.links import body


def test_weights_of_any_size_sort_heaviest_first(spark):
    weights = [0, 1, -1, 7, 10**18, 10**18 + 1, 5 * 10**18, -(10**18), 2**63 - 1, -(2**63)]
    keyed = spark.createDataFrame([(w,) for w in weights], "w long").select("w", heaviest_first(F.col("w")).alias("key")).collect()
    assert [r.w for r in sorted(keyed, key=lambda r: r.key)] == sorted(weights, reverse=True)
    assert {len(r.key) for r in keyed} == {20}


def test_a_commit_body_is_whole_unless_a_length_is_asked_for(spark):
    frame = spark.createDataFrame([("s\n\n" + "x" * 900,), ("s",)], "m string")
    whole = [r.b for r in frame.select(body(F.col("m")).alias("b")).collect()]
    assert whole == ["x" * 900, ""]
    assert frame.select(body(F.col("m"), 400).alias("b")).first().b == "x" * 400 + "..."
