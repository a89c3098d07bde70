"""Mixing sources to target weights by entropy balancing.

Every document gets a rate: how often it should be taken. Of all rates that give
each source its target number of words and never exceed ``cap``, the ones closest
to one (in relative entropy) are ``min(cap, exp(lambda * size / scale))`` with one
multiplier per source. The multipliers solve a convex dual; Newton steps on it run
as a join and an aggregation over (source, size) cells. Rates become whole copies
by systematic rounding, so a source misses its target by less than about one document.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from massmap.llm.places import numbered
from massmap.operators.ordered import ranked
from massmap.session import written

WEIGHTS = (5, 2, 1)
_BLOCKS = 512
#: Newton steps at most; a step that leaves the bracket of a source is replaced by its middle.
STEPS = 80
TOLERANCE = 1e-9
_WORD = r"[^\x20\x09-\x0D]+"


def cells_of(docs: DataFrame, text_col: str, source_col: str) -> DataFrame:
    """(source, size, n): documents by source and number of words."""
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(_WORD)), F.lit(0)).cast("bigint")
    cells = docs.select(F.col(source_col).alias("source"), size.alias("size"))
    return cells.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n"))


def targets(cells: DataFrame, *, factor: float = 1.5, weights: tuple = WEIGHTS, cap: float = 2.0) -> DataFrame:
    """(source, s, weight, source_size, target): the words each source should give.

    Sources in code-point order, null last, take the weights in turn and share
    ``factor`` times all words. A target stops at ``cap`` times its source's words;
    what is above goes to the others by weight, until none is above: every target is
    the smaller of its stop and a common multiple of its weight.
    """
    sizes = cells.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).cast("bigint").alias("source_size"))
    sources = ranked(sizes, [], [F.col("source").asc_nulls_last()], "s")
    turn = F.get(F.array(*[F.lit(float(weight)) for weight in weights]), F.pmod(F.col("s") - 1, F.lit(len(weights))).cast("int"))
    sources = written(sources.withColumn("weight", turn), "sources")
    stop = cap * F.col("source_size")
    wanted = factor * (sources.agg(F.sum("source_size")).first()[0] or 0)
    level, settled = 0.0, None
    while True:
        above = F.lit(level) * F.col("weight") > stop
        now = sources.agg(
            F.sum(F.when(above, stop).otherwise(0.0)).alias("stopped"),
            F.sum(F.when(~above, F.col("weight")).otherwise(0.0)).alias("sharing"),
            F.count(F.when(above, 1)).alias("n"),
        ).first()
        if now.n == settled or not now.sharing:
            break
        level, settled = (wanted - now.stopped) / now.sharing, now.n
    return sources.withColumn("target", F.least(stop, F.lit(level) * F.col("weight")))


def balanced(cells: DataFrame, sources: DataFrame, *, cap: float = 2.0) -> DataFrame:
    """(source, size, n, s, source_size, target, rate): Newton's method on the dual, all sources at once."""
    named = cells.join(sources.drop("weight").withColumnRenamed("source", "__source"), F.col("source").eqNullSafe(F.col("__source")))
    named = written(named.drop("__source"), "cells")
    worded = named.where("size > 0")
    log_cap = math.log(cap)
    state = worded.groupBy("s").agg(
        F.first("target").alias("target"), F.first("source_size").alias("total"),
        (F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("scale"), F.min("size").alias("least"),
    )
    # outside this bracket even the smallest document alone would settle the sign
    nearest = F.col("least") / F.col("scale")
    state = state.select(
        "s", "target", "scale",
        F.least(F.lit(0.0), F.log(F.col("target") / F.col("total")) / nearest).alias("low"),
        (F.lit(log_cap) / nearest).alias("high"),
        F.lit(0.0).alias("multiplier"),
        (F.col("target") >= cap * F.col("total") * (1 - 1e-12)).alias("full"),
    )
    state = state.withColumn("multiplier", F.when(F.col("full"), F.col("high")).otherwise(F.col("multiplier")))
    state = written(state, "dual")
    step = F.col("size") / F.col("scale")
    for _ in range(STEPS):
        rate = F.least(F.lit(cap), F.exp(F.col("multiplier") * step))
        mass = F.col("n") * F.col("size") * rate
        slopes = F.when(rate < cap, mass * step).otherwise(0.0)
        sums = worded.select("s", "size", "n").join(state, "s").groupBy("s").agg(
            F.sum(mass).alias("mass"), F.sum(slopes).alias("slope")
        )
        gap = F.col("mass") - F.col("target")
        done = F.col("full") | (F.abs(gap) <= TOLERANCE * F.col("target")) | (
            F.col("high") - F.col("low") <= 1e-15 * F.greatest(F.abs(F.col("high")), F.abs(F.col("low")))
        )
        low = F.when(gap < 0, F.col("multiplier")).otherwise(F.col("low"))
        high = F.when(gap > 0, F.col("multiplier")).otherwise(F.col("high"))
        moved = state.join(sums, "s").withColumns({"done": done, "low": low, "high": high, "gap": gap})
        newton = F.col("multiplier") - F.col("gap") / F.when(F.col("slope") > 0, F.col("slope"))
        inside = (newton > F.col("low")) & (newton < F.col("high"))
        moved = moved.withColumn(
            "multiplier",
            F.when(F.col("done"), F.col("multiplier"))
            .when(F.coalesce(inside, F.lit(False)), newton)
            .otherwise((F.col("low") + F.col("high")) / 2),
        )
        state = written(moved.select("s", "target", "scale", "low", "high", "multiplier", "full", "done"), "dual")
        if not state.where(~F.col("done")).limit(1).count():
            break
        state = state.drop("done")
    multipliers = state.select("s", "multiplier", "scale", "full")
    rate = F.when(F.col("size") == 0, 1.0).when(F.col("full"), F.lit(cap)).otherwise(
        F.least(F.lit(cap), F.exp(F.col("multiplier") * step))
    )
    return named.join(multipliers, "s", "left").withColumn("rate", rate).drop("multiplier", "scale", "full")


def copies_of(cells: DataFrame) -> DataFrame:
    """Whole copies per cell: ``cell_copies`` of its ``n`` documents.

    Cells of a source are rounded along their running sum of rates, largest documents
    first, so that what one size misses the next one makes up. A source has at most
    one cell per size.
    """
    order = Window.partitionBy("s").orderBy(F.col("size").desc())
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = cells.withColumn("__after", F.sum(F.col("n") * F.col("rate")).over(upto))
    rounded = F.floor(F.col("__after") + 0.5)
    before = F.coalesce(F.lag(rounded).over(order), F.lit(0))
    return summed.withColumn("cell_copies", (rounded - before).cast("bigint")).drop("__after")


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", *,
    factor: float = 1.5, weights: tuple = WEIGHTS, cap: float = 2.0,
) -> DataFrame:
    """``docs`` with ``size``, ``source_size``, ``target``, ``rate``, ``copies`` and ``taken``.

    ``taken`` is copies times size; the taken words of a source come to its target
    but for rounding to whole documents, and no document is taken more than ``cap``
    times. Which documents of equal source and size get the odd copy is decided by
    the hash of the id, so reruns agree. Columns of these names in the input are
    replaced; all others stay.

    A null or empty text has size 0 and is taken once, for no words. A null source
    is a source of its own and comes last. Repeated rows are documents of their own.
    An empty table gives an empty result.
    """
    cells = written(cells_of(docs, text_col, source_col), "cells")
    facts = copies_of(balanced(cells, targets(cells, factor=factor, weights=weights, cap=cap), cap=cap))
    facts = written(facts, "facts")
    names = ["size", "source_size", "target", "rate", "copies", "taken"]
    own = [name for name in docs.columns if name not in names]
    size = F.coalesce(F.regexp_count(F.col(text_col), F.lit(_WORD)), F.lit(0)).cast("bigint")
    key = F.coalesce(F.concat(F.lit("="), F.col(source_col)), F.lit(""))  # so that null meets null
    frame = docs.select(*[F.col(f"`{name}`") for name in own], size.alias("size"), key.alias("__source"))
    facts = facts.select(
        F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit("")).alias("__source"),
        "size", "n", "cell_copies", "source_size", "target", "rate",
    )
    order = [F.xxhash64(id_col), F.col(id_col), F.xxhash64(text_col)]
    placed = numbered(frame, ["__source", "size"], [F.col(id_col)], order, _BLOCKS, "__place", facts)
    upto = lambda place: F.floor(place * F.col("cell_copies") / F.col("n"))
    copies = (upto(F.col("__place") + 1) - upto(F.col("__place"))).cast("bigint")
    return placed.withColumn("copies", copies).select(
        *[F.col(f"`{name}`") for name in own], "size", "source_size", "target", "rate", "copies",
        (F.col("copies") * F.col("size")).alias("taken"),
    )


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns; texts are read for their sizes only and not moved."""
    done = mix(docs.select("doc_id", "text", "source"))
    return done.select("doc_id", "size", "source_size", "target", "taken", "copies", "rate")
