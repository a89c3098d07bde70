"""All registered queries and their SQL."""

from __future__ import annotations

from catalog import changes, classify, commits, lines, sources, views
from catalog import joins
from catalog import oracle as O
from massmap.functions.fixed_values import FLAVORS

QUERIES = {}
ORACLES = {}
for section in (sources, classify, lines, joins, views, changes, commits):
    for name, query, sql in section.ENTRIES:
        QUERIES[name] = query
        if sql is not None:
            ORACLES[name] = sql

ENTRY_SQL = O.with_ctes(
    O.MEASURED,
    f"""SELECT repo, folder, count(*) AS files, {", ".join(f"sum({m})::BIGINT AS {m}" for m in views.MEASURES)},
  {", ".join(f"coalesce(sum(tokens) FILTER (flavor = '{f}'), 0)::BIGINT AS flavor_{f}" for f in FLAVORS)},
  count(*) FILTER (own = folder) AS direct_files,
  {", ".join(f"coalesce(sum({m}) FILTER (own = folder), 0)::BIGINT AS direct_{m}" for m in views.MEASURES)}
FROM (SELECT repo, flavor, {", ".join(views.MEASURES)}, folder AS own, unnest({O.folders_above('path')}) AS folder FROM flavored) GROUP BY repo, folder""",
)
