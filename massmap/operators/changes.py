"""What changed between two snapshots: the list of paths, and the lines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from massmap.functions.fixed_values import CONTEXT_LINES
from massmap.operators import similar
from massmap.operators.ordered import ranked
from massmap.session import written

STATUSES = ["added", "modified", "deleted", "renamed"]


def with_blob(snapshot: DataFrame) -> DataFrame:
    """Add the content's own name, if the table does not carry it already."""
    if "blob" in snapshot.columns:
        return snapshot
    return snapshot.withColumn("blob", F.sha2(F.col("content"), 256))


def changed_paths(before: DataFrame, after: DataFrame, keys: Sequence[str] = ("repo",)) -> DataFrame:
    """``(keys, path, base_path, status, modes, blobs)`` of every path that differs.

    Only paths, modes and content names are compared; no content is shuffled.
    """
    on = [*keys, "path"]
    old = with_blob(before).select(*on, F.col("mode").alias("before_mode"), F.col("blob").alias("before_blob"),
                                   F.lit(True).alias("in_before"))
    new = with_blob(after).select(*on, F.col("mode").alias("after_mode"), F.col("blob").alias("after_blob"),
                                  F.lit(True).alias("in_after"))
    both = old.join(new, on, "full_outer")
    status = (
        F.when(F.col("in_before").isNull(), "added").when(F.col("in_after").isNull(), "deleted").otherwise("modified")
    )
    differs = ~(F.col("before_blob").eqNullSafe(F.col("after_blob")) & F.col("before_mode").eqNullSafe(F.col("after_mode")))
    one_sided = F.col("in_before").isNull() | F.col("in_after").isNull()
    return both.where(one_sided | differs).select(
        *on,
        F.col("path").alias("base_path"),
        status.alias("status"),
        "before_mode",
        "after_mode",
        "before_blob",
        "after_blob",
    )


def with_untracked(changes: DataFrame, untracked: DataFrame, keys: Sequence[str] = ("repo",)) -> DataFrame:
    """Append working-tree paths no revision knows, as additions."""
    on = [*keys, "path"]
    new = with_blob(untracked).join(changes.select(*on), on, "left_anti")
    return changes.unionByName(
        new.select(*on, F.col("path").alias("base_path"), F.lit("added").alias("status"),
                   F.lit(None).cast("string").alias("before_mode"), F.lit(None).cast("string").alias("after_mode"),
                   F.lit(None).cast("string").alias("before_blob"), F.col("blob").alias("after_blob"))
    )


def with_renames(changes: DataFrame, keys: Sequence[str] = ("repo",)) -> DataFrame:
    """Pair deleted and added paths of equal content, one to one, in path order.

    The n-th deleted path of a content goes to the n-th added one, so a content
    that a million empty files share makes a million rows and never their pairs.
    """
    # A slim table, read by every step below; the snapshots are compared once.
    changes = written(changes, "changes")
    on = [*keys, "blob"]
    deleted = F.col("status") == "deleted"
    added = F.col("status") == "added"
    sides = changes.where(deleted | added).withColumn(
        "blob", F.when(deleted, F.col("before_blob")).otherwise(F.col("after_blob"))
    ).where(F.col("blob").isNotNull())
    shared = (
        sides.groupBy(*on)
        .agg(F.bool_or(deleted).alias("out"), F.bool_or(added).alias("in"))
        .where("out AND in")
        .select(*on)
    )
    candidates = sides.join(shared, on, "left_semi")
    numbered = ranked(candidates, [*on, "status"], [F.col("path")], "turn")
    out = numbered.where(deleted).select(*on, "turn", F.col("path").alias("base_path"),
                                         F.col("before_mode").alias("old_mode"))
    came = numbered.where(added).select(*on, "turn", "path", "after_mode")
    pairs = came.join(out, [*on, "turn"]).select(
        *keys, "path", "base_path", F.lit("renamed").alias("status"), F.col("old_mode").alias("before_mode"),
        "after_mode", F.col("blob").alias("before_blob"), F.col("blob").alias("after_blob"),
    )
    gone = pairs.select(*keys, F.col("base_path").alias("path"), F.lit("deleted").alias("status"))
    taken = gone.unionByName(pairs.select(*keys, "path", F.lit("added").alias("status")))
    return changes.join(taken, [*keys, "path", "status"], "left_anti").select(*changes.columns).unionByName(pairs)


SIMILARITY = 0.5


def with_similar_renames(
    changes: DataFrame, before: DataFrame, after: DataFrame, keys: Sequence[str] = ("repo",), least: float = SIMILARITY,
    max_bytes: int | None = None,
) -> DataFrame:
    """Pair deleted and added paths whose lines are at least half the same, best pairs first.

    No pair that is alike is out of sight, and each one reported was compared on all of
    its lines (see ``operators/similar.py``). Only contents of keys with files on both
    sides are read.
    """
    one_sided = changes.where("status IN ('deleted', 'added')").select(*keys, "path", "status")
    two = one_sided.groupBy(*keys).agg(F.count_distinct("status").alias("sides")).where("sides = 2").select(*keys)
    open_ = one_sided.join(two, list(keys), "left_semi")
    lines = similar.lines_by_code(open_.where("status = 'deleted'"), before, keys, max_bytes).withColumn("side", F.lit("out"))
    lines = lines.unionByName(
        similar.lines_by_code(open_.where("status = 'added'"), after, keys, max_bytes).withColumn("side", F.lit("in"))
    )
    pairs = similar.alike(lines, keys, least)
    if pairs is None:
        return changes
    out = changes.where("status = 'deleted'").select(*keys, F.col("path").alias("base_path"),
                                                     F.col("before_mode").alias("old_mode"), F.col("before_blob").alias("old_blob"))
    renamed = changes.where("status = 'added'").drop("base_path").join(pairs, [*keys, "path"]).join(out, [*keys, "base_path"]).select(
        *keys, "path", "base_path", F.lit("renamed").alias("status"), F.col("old_mode").alias("before_mode"), "after_mode",
        F.col("old_blob").alias("before_blob"), "after_blob",
    )
    gone = pairs.select(*keys, F.col("base_path").alias("path"), F.lit("deleted").alias("status"))
    taken = gone.unionByName(pairs.select(*keys, "path", F.lit("added").alias("status")))
    return changes.join(taken, [*keys, "path", "status"], "left_anti").select(*changes.columns).unionByName(
        renamed.select(*changes.columns)
    )


# --- lines of one changed file, as arrays in its row ---------------------------
def _same_run(left: Column, right: Column) -> Column:
    """How many leading entries two arrays share."""
    first_difference = F.array_position(F.zip_with(left, right, lambda a, b: a.eqNullSafe(b)), False)
    return F.when(first_difference == 0, F.size(left)).otherwise(first_difference - 1).cast("int")


def _between(values: Column, start: Column, length: Column) -> Column:
    return F.slice(values, start + 1, length)


def _indices(start: Column, length: Column) -> Column:
    none = F.array().cast("array<int>")
    return F.when(length > 0, F.sequence(start, start + length - 1)).otherwise(none)


def minimal_alignment():
    """Arrow UDF: the lines a minimal script removes and adds, for one region per row.

    A region of up to 10,000 lines is settled by bit rows: one big integer per line of
    one side holds the whole frontier of the other. A larger one drops the lines that
    only one side has and follows the furthest-reaching path of each number of
    differences, so its cost is the square of the differences, not the lines. Past 1,000
    differences it is halved where the bit-row frontiers of both halves meet
    (Hirschberg), and the halves start anew. Every way is minimal and takes linear space.
    Everything lives inside so that executors need no package installed to run it.
    """
    import numpy as np
    import pandas as pd

    # Lines of both sides up to which all rows are kept: at most 3 MB of bits.
    direct = 10_000
    # Differences that furthest-reaching paths follow: half a million steps, and as many numbers kept, at most.
    reach = 1_000

    def equal_run(old, new, x, y, most):
        """How many of ``most`` lines agree from two places on: probes of doubling length, then halving."""
        done, step = 0, 1
        while done < most:
            step = min(step, most - done)
            if old[8 * (x + done) : 8 * (x + done + step)] != new[8 * (y + done) : 8 * (y + done + step)]:
                break
            done, step = done + step, 2 * step
        else:
            return done
        same, differ = 0, step
        while differ - same > 1:
            half = (same + differ) // 2
            low, high = done + same, done + half
            if old[8 * (x + low) : 8 * (x + high)] == new[8 * (y + low) : 8 * (y + high)]:
                same = half
            else:
                differ = half
        return done + same

    def furthest(old, new):
        """Runs (old place, new place, lines) of a minimal script, or None past ``reach`` differences."""
        n, m = len(old), len(new)
        old, new = (np.array(side, np.int64).tobytes() for side in (old, new))
        paths = [[0] * 3]  # of d differences: how far each diagonal from -d - 1 to d + 1 goes on the old side
        for d in range(min(reach, n + m) + 1):
            last, now = paths[-1], [-1] * (2 * d + 3)
            for k in range(-d, d + 1, 2):
                if not -m <= k <= n:
                    continue
                at = k + d  # diagonal k among those of d - 1 differences, one to the left of its own
                if d == 0:
                    x = 0
                else:
                    down = last[at + 1] if at + 1 < len(last) else -1
                    right = last[at - 1] if at >= 1 else -1
                    x = max(down, right + 1 if right >= 0 else -1)
                y = x - k
                if x < 0 or x > n or y < 0 or y > m:
                    continue
                x += equal_run(old, new, x, y, min(n - x, m - y))
                now[at + 1] = x
                if x >= n and x - k >= m:
                    paths.append(now)
                    return runs_of(paths, n, m)
            paths.append(now)
        return None

    def runs_of(paths, n, m):
        x, y, runs = n, m, []
        for d in range(len(paths) - 2, 0, -1):
            k, last = x - y, paths[d]
            at = k + d
            down = last[at + 1] if at + 1 < len(last) else -1
            right = last[at - 1] if at >= 1 else -1
            came = max(down, right + 1 if right >= 0 else -1)
            if x > came:
                runs.append((came, came - k, x - came))
            x, y = (right, right - k + 1) if right >= 0 and right + 1 >= down else (down, down - k - 1)
        if x:
            runs.append((0, 0, x))
        return runs

    def one(before, after):
        if len(before) + len(after) <= direct:
            return small(before, after)
        common = set(before) & set(after)
        left = [at for at, line in enumerate(before) if line in common]
        right = [at for at, line in enumerate(after) if line in common]
        names = {line: name for name, line in enumerate(common)}
        old, new = [names[before[at]] for at in left], [names[after[at]] for at in right]
        kept_old, kept_new = set(), set()
        parts = [(0, len(old), 0, len(new))]
        while parts:
            a, b, c, d = parts.pop()
            while a < b and c < d and old[a] == new[c]:
                kept_old.add(left[a])
                kept_new.add(right[c])
                a, c = a + 1, c + 1
            while a < b and c < d and old[b - 1] == new[d - 1]:
                b, d = b - 1, d - 1
                kept_old.add(left[b])
                kept_new.add(right[d])
            if a == b or c == d:
                continue
            if b - a + d - c <= direct:
                script = small(old[a:b], new[c:d])
                out, came = set(script["removed"]), set(script["added"])
                kept_old.update(left[a + at] for at in range(b - a) if at not in out)
                kept_new.update(right[c + at] for at in range(d - c) if at not in came)
                continue
            runs = furthest(old[a:b], new[c:d])
            if runs is not None:
                for x, y, lines in runs:
                    kept_old.update(left[a + x : a + x + lines])
                    kept_new.update(right[c + y : c + y + lines])
                continue
            if b - a == 1:
                at = next((at for at in range(c, d) if new[at] == old[a]), None)
                if at is not None:
                    kept_old.add(left[a])
                    kept_new.add(right[at])
                continue
            middle = (a + b) // 2
            ahead = frontier(old[a:middle], new[c:d])
            behind = frontier(old[middle:b][::-1], new[c:d][::-1])[::-1]
            cut = c + int(np.argmax(ahead + behind))
            parts += [(a, middle, c, cut), (middle, b, cut, d)]
        return {
            "removed": [at for at in range(len(before)) if at not in kept_old],
            "added": [at for at in range(len(after)) if at not in kept_new],
        }

    def frontier(before, after):
        """How many lines all of ``before`` shares with each beginning of ``after``, in linear space."""
        n = len(after)
        places, masks = {}, {}
        for at, line in enumerate(after):
            places.setdefault(line, []).append(at)

        def mask(line):
            if line in masks:
                return masks[line]
            bits = np.zeros(n, np.uint8)
            bits[places.get(line, [])] = 1
            found = int.from_bytes(np.packbits(bits, bitorder="little").tobytes(), "little")
            if len(places.get(line, [])) * 512 > n:  # of such lines there are fewer than 512
                masks[line] = found
            return found

        full = (1 << n) - 1
        row = full
        for line in before:
            hit = row & mask(line)
            row = ((row + hit) | (row - hit)) & full
        bits = np.unpackbits(np.frombuffer(row.to_bytes((n + 7) // 8, "little"), np.uint8), bitorder="little")[:n]
        return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])

    def small(before, after):
        place = {}
        for at, line in enumerate(after):
            place[line] = place.get(line, 0) | (1 << at)
        full = (1 << len(after)) - 1
        row, rows = full, []
        for line in before:
            hit = row & place.get(line, 0)
            row = ((row + hit) | (row - hit)) & full
            rows.append(row)
        removed, added = [], []
        i, j = len(before), len(after)
        while i and j:
            if rows[i - 1] >> (j - 1) & 1:
                j -= 1
                added.append(j)
                continue
            i -= 1
            if i and not rows[i - 1] >> (j - 1) & 1:
                removed.append(i)
            else:
                j -= 1
        removed.extend(range(i - 1, -1, -1))
        added.extend(range(j - 1, -1, -1))
        return {"removed": removed[::-1], "added": added[::-1]}

    def align(before: pd.Series, after: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([one(list(b), list(a)) for b, a in zip(before, after)], columns=["removed", "added"])

    align.__annotations__ = {"before": pd.Series, "after": pd.Series, "return": pd.DataFrame}
    return F.pandas_udf(align, "removed array<int>, added array<int>")


def with_common_ends(frame: DataFrame, before: str = "before_line_texts", after: str = "after_line_texts") -> DataFrame:
    """Add ``head`` and ``tail``: how many lines both sides share at each end, never overlapping."""
    old, new = F.col(before), F.col(after)
    frame = frame.withColumn("head", _same_run(old, new))
    rest_old = F.reverse(_between(old, F.col("head"), F.size(old) - F.col("head")))
    rest_new = F.reverse(_between(new, F.col("head"), F.size(new) - F.col("head")))
    return frame.withColumn("tail", _same_run(rest_old, rest_new))


def with_line_diff(
    frame: DataFrame, before: str = "before_line_texts", after: str = "after_line_texts",
    cap: int | None = None,
) -> DataFrame:
    """Add ``removed`` and ``added`` (line indices) and ``capped`` to rows holding both sides, as texts or as numbers.

    Common head and tail are trimmed in the JVM. A region with one empty side,
    or past a ``cap`` that is given, is wholly replaced; only what is left goes to Python.
    """
    old, new = F.col(before), F.col(after)
    frame = with_common_ends(frame, before, after).withColumnsRenamed({"head": "__head", "tail": "__tail"})
    frame = frame.withColumns(
        {
            "__out": F.size(old) - F.col("__head") - F.col("__tail"),
            "__in": F.size(new) - F.col("__head") - F.col("__tail"),
        }
    )
    frame = frame.withColumn("capped", F.lit(False) if cap is None else F.col("__out") + F.col("__in") > cap)
    open_region = ~F.col("capped") & (F.col("__out") > 0) & (F.col("__in") > 0)
    none = F.coalesce(F.slice(old, 1, 0), F.array().cast(frame.schema[before].dataType))  # also where there is no text
    frame = frame.withColumns(
        {
            "__old": F.when(open_region, _between(old, F.col("__head"), F.col("__out"))).otherwise(none),
            "__new": F.when(open_region, _between(new, F.col("__head"), F.col("__in"))).otherwise(none),
        }
    )
    frame = frame.withColumn("__aligned", minimal_alignment()(F.col("__old"), F.col("__new")))

    def side(name: str, size: str) -> Column:
        shifted = F.transform(F.col(f"__aligned.{name}"), lambda at: at + F.col("__head"))
        return F.when(open_region, shifted).otherwise(_indices(F.col("__head"), F.col(size)))

    frame = frame.withColumns({"removed": side("removed", "__out"), "added": side("added", "__in")})
    return frame.drop("__head", "__tail", "__out", "__in", "__old", "__new", "__aligned")


def verdict_count(verdicts: Column, indices: Column, letter: str) -> Column:
    """How many of these lines got this verdict in their own whole text.

    The letters are bound once per row: inside the filter they would be split again for every line.
    """
    row = F.struct(F.split(verdicts, "").alias("letters"), indices.alias("lines"))
    counted = F.transform(
        F.array(row), lambda r: F.size(F.filter(r["lines"], lambda at: F.get(r["letters"], at) == letter))
    )
    return F.get(counted, F.lit(0)).cast("bigint")


def joined_lines(lines: Column, indices: Column) -> Column:
    return F.array_join(F.transform(indices, lambda at: F.get(lines, at)), "\n")


def aligned_lines(frame: DataFrame, keys: Sequence[str] = ("repo",), before: str = "before_line_texts",
                  after: str = "after_line_texts") -> DataFrame:
    """One row per printed line ``(keys, path, ord, marker, text, before_line, after_line)``.

    Removals stand before the additions that replace them. Each line is keyed by
    the number of kept lines in front of it, so nothing has to be walked.
    """
    old, new = F.col(before), F.col(after)

    def kept(lines: Column, touched: str) -> Column:
        return F.array_except(_indices(F.lit(0), F.size(lines)), F.col(touched))

    nothing = F.lit(None).cast("int")

    def entry(gap: Column, side: int, marker: str, text: Column, left: Column, right: Column) -> Column:
        return F.struct(
            gap.cast("int").alias("gap"), F.lit(side).alias("side"), (F.coalesce(left, right)).alias("at"),
            F.lit(marker).alias("marker"), text.alias("text"), (left + 1).alias("before_line"),
            (right + 1).alias("after_line"),
        )

    removed = F.transform(F.col("removed"), lambda at, nth: entry(at - nth, 0, "-", F.get(old, at), at, nothing))
    added = F.transform(F.col("added"), lambda at, nth: entry(at - nth, 1, "+", F.get(new, at), nothing, at))
    same = F.transform(
        F.arrays_zip(kept(old, "removed").alias("l"), kept(new, "added").alias("r")),
        lambda pair, nth: entry(nth, 2, " ", F.get(new, pair["r"]), pair["l"], pair["r"]),
    )
    return frame.select(
        *keys, "path", F.posexplode(F.array_sort(F.concat(removed, added, same))).alias("ord", "line")
    ).select(*keys, "path", "ord", "line.marker", "line.text", "line.before_line", "line.after_line")


def side_of(aligned: DataFrame, side: str) -> DataFrame:
    return aligned.where(F.col("marker") != ("+" if side == "before" else "-"))


def folded(aligned: DataFrame, keys: Sequence[str] = ("repo",), context: int = CONTEXT_LINES) -> DataFrame:
    """Keep lines near a change; each other run becomes one row with its length.

    Windows run over one file's lines, which the file size ceiling bounds.
    """
    from pyspark.sql import Window

    within = Window.partitionBy(*keys, "path").orderBy("ord")
    near = F.max((F.col("marker") != " ").cast("int")).over(within.rowsBetween(-context, context)) == 1
    shown = aligned.withColumn("shown", near)
    starts = (F.col("shown") != F.lag("shown").over(within)) | F.lag("shown").over(within).isNull()
    runs = shown.withColumn("run", F.sum(starts.cast("int")).over(within))
    lines = runs.where("shown").select(*keys, "path", "ord", "marker", "text", F.lit(0).cast("bigint").alias("hidden"))
    gaps = runs.where("NOT shown").groupBy(*keys, "path", "run").agg(
        F.min("ord").alias("ord"), F.count("*").alias("hidden")
    ).select(*keys, "path", "ord", F.lit("gap").alias("marker"), F.lit(None).cast("string").alias("text"), "hidden")
    return lines.unionByName(gaps)


def multiset_diff(frame: DataFrame, keys: Sequence[str] = ("repo",), before: str = "before_line_texts",
                  after: str = "after_line_texts") -> DataFrame:
    """Order-free lower bound of the change: surplus copies of each line per side."""
    sides = frame.select(*keys, "path", F.explode(before).alias("line"), F.lit(-1).alias("step")).unionByName(
        frame.select(*keys, "path", F.explode(after).alias("line"), F.lit(1).alias("step"))
    )
    surplus = sides.groupBy(*keys, "path", "line").agg(F.sum("step").alias("step"))
    return surplus.groupBy(*keys, "path").agg(
        F.sum(F.greatest(F.col("step"), F.lit(0))).alias("added"),
        F.sum(F.greatest(-F.col("step"), F.lit(0))).alias("removed"),
    )
