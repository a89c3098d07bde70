"""Measured file rows from a few figures, for tests that weigh without texts."""

from pyspark.sql import functions as F

from massmap.plans.scan import FILE_COLUMNS

TEXTS = {"path", "name", "kind", "measurement", "status", "previous_path", "before_mode", "after_mode", "language"}


def weighted(spark, rows, repo="r"):
    """``rows`` are dicts; tokens stand for every after measure, added and removed for every side."""
    filled = []
    for row in rows:
        size, added, removed = row.get("tokens", 0), row.get("added", 0), row.get("removed", 0)
        comment = row.get("comment_lines", 0)
        figures = {name: 0 for name in FILE_COLUMNS if name not in TEXTS and name != "generated"}
        figures.update(tokens=size, lines=size, code_lines=size - comment, comment_lines=comment,
                       functions=row.get("functions", 0), branches=row.get("branches", 0))
        for measure in ("tokens", "lines", "code_lines"):
            figures.update({f"added_{measure}": added, f"removed_{measure}": removed,
                            f"churn_{measure}": added + removed, f"net_{measure}": added - removed})
        if row.get("measurement", "measured") != "measured":
            figures = {name: None for name in figures}
        filled.append({
            "path": row["path"], "name": row["path"].rsplit("/", 1)[-1], "kind": row.get("kind", "code"),
            "generated": row.get("generated", False), "measurement": row.get("measurement", "measured"),
            "status": row.get("status", "unchanged"), "previous_path": row.get("previous_path"),
            "before_mode": None, "after_mode": None, "language": row.get("language"), **figures,
        })
    types = {name: "string" if name in TEXTS else "boolean" if name == "generated" else "bigint" for name in FILE_COLUMNS}
    schema = ", ".join(f"{name} {types[name]}" for name in FILE_COLUMNS)
    ordered = [tuple(row[name] for name in FILE_COLUMNS) for row in filled]
    return spark.createDataFrame(ordered, schema).select(F.lit(repo).alias("repo"), *FILE_COLUMNS)
