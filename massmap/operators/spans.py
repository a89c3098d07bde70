"""Line verdicts from comment spans a user brings, as a join of lines and spans."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from massmap.functions.text import has_content


def bucket_by_spans(lines: DataFrame, spans: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add ``bucket`` to ``(keys, line_no, line)`` from ``(keys, start_row, start_col, end_row, end_col)``.

    A span is spread to the rows it touches, so lines meet spans in an equi
    join. A line is comment when nothing but white space lies outside what its
    spans cover; blank wins over all; rows past the end meet no line.
    """
    first, last = F.col("line_no") == F.col("start_row"), F.col("line_no") == F.col("end_row")
    touched = spans.select("*", F.explode(F.sequence("start_row", "end_row")).alias("line_no"))
    per_line = touched.groupBy(*keys, "line_no").agg(
        F.bool_or(~first & ~last).alias("covered"),
        F.min(F.when(last & ~first, 0).when(first, F.col("start_col"))).alias("begins"),
        F.max(F.when(last, F.col("end_col"))).alias("ends"),
        F.bool_or(first & ~last).alias("runs_on"),
    )
    line = F.col("line")
    ends = F.greatest(F.col("ends"), F.when(F.col("runs_on"), F.length(line)))
    outside = F.concat(F.substr(line, F.lit(1), F.col("begins")), F.substr(line, ends + 1))
    joined = lines.join(per_line, [*keys, "line_no"], "left")
    bucket = (
        F.when(~has_content(line), "blank")
        .when(F.col("covered"), "comment")
        .when(ends.isNotNull() & ~has_content(outside), "comment")
        .otherwise("code")
    )
    return joined.select(*keys, "line_no", "line", bucket.alias("bucket"))
