"""Which files of two sides are alike by their lines: a weighted set-similarity join.

A file is its distinct lines, each weighing its bytes in the file. Two files are alike
if what they share weighs at least a given part of the heavier one. Lines stand in one
order for all files, rarest first; ``rest`` is what a line and all after it weigh. Two
files that are alike share a line whose ``rest`` is large enough in both, so only such
leading lines make buckets, and a bucket is asked only for pairs that its ``rest`` still
allows. What two files share is worked out by merging their sorted line codes.

In a bucket with few files on one side all meet. In a larger one the n-th of one side
meets the n-th of the other, which settles groups of one template without their pairs.
What stays open then is compared block by block inside a task, and of a pair of blocks
only each file's best partner comes out.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from massmap.functions.text import decoded
from massmap.operators.ordered import ranked
from massmap.session import written

#: Buckets with at most so many files on one side meet all of each other; this doubles per round up to ``SIDE``.
MEETING = 64
#: Files of one side that a task compares with as many of the other in one step.
SIDE = 256


def lines_by_code(paths: DataFrame, snapshot: DataFrame, keys: Sequence[str], max_bytes: int | None) -> DataFrame:
    """``(keys, path, code, bytes)``: the distinct lines of each readable file by hash, with their bytes in the file."""
    held = snapshot.select(*keys, "path", "size", "content")
    if max_bytes is not None:
        held = held.where(F.col("size") <= max_bytes)
    rows = paths.select(*keys, "path").join(held, [*keys, "path"]).withColumn("text", decoded(F.col("content"))["text"])
    # An empty text has no lines. As a filter this would be pushed below the join, where every content is decoded for it.
    lines = rows.select(*keys, "path", F.explode(F.when(F.col("text") != "", F.split("text", "\n", -1))).alias("line"))
    return lines.groupBy(*keys, "path", F.xxhash64("line").alias("code")).agg(F.sum(F.octet_length("line") + 1).alias("bytes"))


def _weighed(lines: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Lines that both sides hold, with the ``size`` of their file and the ``rest`` from this line on."""
    holders = lines.groupBy(*keys, "code").agg(F.count(F.lit(1)).alias("files"), F.count_distinct("side").alias("sides"))
    file = Window.partitionBy(*keys, "side", "path")
    after = file.orderBy(F.col("files").desc(), F.col("code").desc()).rowsBetween(Window.unboundedPreceding, 0)
    sized = lines.withColumn("size", F.sum("bytes").over(file))
    common = sized.join(holders.where("sides = 2"), [*keys, "code"])
    return common.withColumn("rest", F.sum("bytes").over(after)).select(*keys, "side", "path", "code", "bytes", "size", "rest")


def _sides(rows: DataFrame, keys: Sequence[str], *more: str) -> tuple[DataFrame, DataFrame]:
    def one(side: str, path: str, name: str) -> DataFrame:
        held = [F.col(c).alias(f"{name}_{c}") for c in ("size", "rest")]
        return rows.where(F.col("side") == side).select(*keys, "code", *more, F.col("path").alias(path), *held)

    return one("out", "base_path", "old"), one("in", "path", "new")


def _allowed(least: float) -> Column:
    """What is left from the shared line on may still be enough; a little below, so that rounding loses no pair."""
    return F.least("old_rest", "new_rest") >= F.greatest("old_size", "new_size") * F.lit(least - 1e-9)


def _shared_bytes(batches):
    """What the lines of two files have in common, by merging ascending codes."""
    for batch in batches:
        columns = dict(zip(batch.schema.names, batch.columns))
        shared = []
        for row in range(batch.num_rows):
            old, new = (np.asarray(columns[name][row].values) for name in ("old_codes", "new_codes"))
            _, a, b = np.intersect1d(old, new, assume_unique=True, return_indices=True)
            weights = [np.asarray(columns[name][row].values) for name in ("old_bytes", "new_bytes")]
            shared.append(int(np.minimum(weights[0][a], weights[1][b]).sum()))
        kept = [name for name in batch.schema.names if not name.endswith(("_codes", "_bytes"))]
        yield pa.record_batch([*[columns[name] for name in kept], pa.array(shared, pa.int64())], [*kept, "shared"])


def _files(weighed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row per file: the codes it shares with the other side, ascending, and what each weighs."""
    held = weighed.groupBy(*keys, "side", "path").agg(
        F.first("size").alias("size"), F.array_sort(F.collect_list(F.struct("code", "bytes"))).alias("lines")
    )
    return held.select(*keys, "side", "path", "size", F.col("lines.code").alias("codes"), F.col("lines.bytes").alias("bytes"))


def _scored(pairs: DataFrame, files: DataFrame, keys: Sequence[str], least: float) -> DataFrame:
    """``(keys, path, base_path, likeness)`` of the pairs that are alike."""
    old = files.where("side = 'out'").select(
        *keys, F.col("path").alias("base_path"), F.col("size").alias("old_size"), F.col("codes").alias("old_codes"), F.col("bytes").alias("old_bytes")
    )
    new = files.where("side = 'in'").select(
        *keys, "path", F.col("size").alias("new_size"), F.col("codes").alias("new_codes"), F.col("bytes").alias("new_bytes")
    )
    rows = pairs.join(old, [*keys, "base_path"]).join(new, [*keys, "path"]).select(
        *keys, "path", "base_path", F.greatest("old_size", "new_size").alias("heavier"), "old_codes", "old_bytes", "new_codes", "new_bytes"
    )
    kind = ", ".join(f"`{name}` {rows.schema[name].dataType.simpleString()}" for name in [*keys, "path", "base_path", "heavier"])
    likeness = F.col("shared") / F.col("heavier")
    done = rows.mapInArrow(_shared_bytes, f"{kind}, shared long")
    return done.select(*keys, "path", "base_path", likeness.alias("likeness")).where(F.col("likeness") >= least)


def best_partners(old: list[tuple], new: list[tuple], least: float) -> list[tuple[int, int, float]]:
    """Each file's best partner on the other side, as (old place, new place, likeness). A file is (size, codes, bytes)."""
    holders: dict[int, tuple[list, list, list, list]] = {}
    for side, files in enumerate((old, new)):
        for place, (_, codes, weights) in enumerate(files):
            for code, weight in zip(codes.tolist(), weights.tolist()):
                held = holders.setdefault(code, ([], [], [], []))
                held[2 * side].append(place)
                held[2 * side + 1].append(weight)
    shared = np.zeros((len(old), len(new)))
    for a, weight_a, b, weight_b in holders.values():
        if a and b:
            shared[np.ix_(a, b)] += np.minimum.outer(weight_a, weight_b)
    sizes = [np.array([file[0] for file in files], float) for files in (old, new)]
    likeness = shared / np.maximum.outer(*sizes)
    pairs = {(i, int(likeness[i].argmax())) for i in range(len(old))} | {(int(likeness[:, j].argmax()), j) for j in range(len(new))}
    return [(i, j, float(likeness[i, j])) for i, j in sorted(pairs) if likeness[i, j] >= least]


def _met_in_blocks(open_: DataFrame, files: DataFrame, keys: Sequence[str], least: float) -> DataFrame:
    """Edges between the two sides of every bucket, the best of each file and pair of blocks."""
    bucket = [*keys, "code"]
    placed = ranked(open_.select(*bucket, "side", "path"), [*bucket, "side"], [F.col("path")], "turn")
    placed = written(placed.withColumn("block", F.expr(f"(turn - 1) div {SIDE}")), "blocks")
    blocks = placed.select(*bucket, "side", "block").distinct()
    pairs = blocks.where("side = 'out'").select(*bucket, F.col("block").alias("old_block")).join(
        blocks.where("side = 'in'").select(*bucket, F.col("block").alias("new_block")), bucket
    )
    parts = F.explode(F.expr("array(struct('out' as side, old_block as block), struct('in' as side, new_block as block))"))
    dealt = pairs.select(*bucket, "old_block", "new_block", parts.alias("part")).select(*bucket, "old_block", "new_block", "part.*")
    rows = dealt.join(placed, [*bucket, "side", "block"]).join(files, [*keys, "side", "path"])
    rows = rows.withColumn("pair", F.xxhash64(*bucket, "old_block", "new_block"))

    def compare(table: pa.Table) -> pa.Table:
        sides = {"out": [], "in": []}
        for row in range(table.num_rows):
            one = {name: table[name][row] for name in ("side", "size", "codes", "bytes")}
            sides[one["side"].as_py()].append((row, (one["size"].as_py(), np.asarray(one["codes"].values), np.asarray(one["bytes"].values))))
        found = best_partners([file for _, file in sides["out"]], [file for _, file in sides["in"]], least)
        at = pa.array([sides["in"][j][0] for _, j, _ in found], pa.int64())
        paths = table["path"].take(pa.array([sides["out"][i][0] for i, _, _ in found], pa.int64()))
        held = table.select([*keys, "path"]).take(at)
        return held.append_column("base_path", paths).append_column("likeness", pa.array([x for *_, x in found], pa.float64()))

    kind = ", ".join(f"`{name}` {rows.schema[name].dataType.simpleString()}" for name in [*keys, "path"])
    sent = rows.select("pair", *keys, "side", "path", "size", "codes", "bytes")
    return sent.groupBy("pair").applyInArrow(compare, f"{kind}, base_path string, likeness double").distinct()


def best_pairs(edges: DataFrame, keys: Sequence[str]) -> DataFrame | None:
    """One-to-one pairs: in each round those that are each other's best; until none is left.

    Equal likeness is settled by a hash of the pair, so that ties do not cost a round each.
    """
    edges = edges.withColumn("lot", F.xxhash64("base_path", "path"))
    pairs = None
    while not edges.isEmpty():
        mine = edges.groupBy(*keys, "path").agg(F.max(F.struct("likeness", "lot", "base_path")).alias("best"))
        theirs = edges.groupBy(*keys, "base_path").agg(F.max(F.struct("likeness", "lot", "path")).alias("best"))
        won = mine.select(*keys, "path", F.col("best.base_path").alias("base_path")).join(
            theirs.select(*keys, "base_path", F.col("best.path").alias("path")), [*keys, "path", "base_path"]
        )
        won = written(won, "pairs")
        pairs = won if pairs is None else pairs.unionByName(won)
        edges = written(
            edges.join(won.select(*keys, "path"), [*keys, "path"], "left_anti").join(
                won.select(*keys, "base_path"), [*keys, "base_path"], "left_anti"
            ),
            "edges",
        )
    return pairs


def alike(lines: DataFrame, keys: Sequence[str], least: float) -> DataFrame | None:
    """``(keys, path, base_path)``: files of side ``in`` with the file of side ``out`` they are most alike to, one to one.

    ``lines`` is ``(keys, side, path, code, bytes)``. None if no two files are alike.
    """
    weighed = written(_weighed(written(lines, "codes"), keys), "lines")  # read twice, and contents are read for it
    leading = F.col("rest") >= F.col("size") * F.lit(least - 1e-9)
    open_, bucket, bound, met, pairs = weighed.where(leading), [*keys, "code"], MEETING, None, None
    files = None
    while True:
        held = open_.groupBy(*bucket).agg(F.count_if(F.col("side") == "out").alias("outs"), F.count_if(F.col("side") == "in").alias("ins"))
        held = held.where("outs > 0 AND ins > 0").select(*bucket, (F.least("outs", "ins") > bound).alias("large"))
        open_ = written(open_.join(held, bucket).select(*keys, "side", "path", "code", "size", "rest", "large"), "open")
        if open_.isEmpty():
            break
        if files is None:
            files = written(_files(weighed.join(open_.select(*keys, "side", "path").distinct(), [*keys, "side", "path"], "left_semi"), keys), "files")
        small, large = open_.where("NOT large").drop("large"), open_.where("large").drop("large")
        if bound > SIDE:
            edges = _met_in_blocks(open_, files, keys, least)
            large = open_.drop("large")
        else:
            old, new = _sides(small, keys)
            meeting = new.join(old, bucket).where(_allowed(least)).select(*keys, "path", "base_path")
            old, new = _sides(ranked(large, [*bucket, "side"], [F.col("path")], "turn"), keys, "turn")
            in_turn = new.join(old, [*bucket, "turn"]).where(_allowed(least)).select(*keys, "path", "base_path")
            candidates = meeting.unionByName(in_turn).distinct()
            if met is not None:
                candidates = candidates.join(met, [*keys, "path", "base_path"], "left_anti")
            candidates = written(candidates, "candidates")
            met = candidates if met is None else met.unionByName(candidates)
            edges = _scored(candidates, files, keys, least)
        won = best_pairs(written(edges, "edges"), keys)
        open_ = large
        if won is not None:
            pairs = won if pairs is None else pairs.unionByName(won)
            gone = won.select(*keys, F.col("base_path").alias("path"), F.lit("out").alias("side"))
            open_ = open_.join(gone.unionByName(won.select(*keys, "path", F.lit("in").alias("side"))), [*keys, "path", "side"], "left_anti")
        elif bound > SIDE:
            break  # the best partners of all that is open are not alike
        bound *= 2
    return pairs
