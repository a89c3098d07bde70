"""Line dedup: a suffix array over line-ID sequences by distributed prefix doubling.

The lines of all documents that hold a word are sequences of line IDs. Two passes
find what repeats:

1. ``prefix_levels`` doubles prefixes: level 0 groups suffixes by their first line,
   level k + 1 pairs the level-k group of a suffix with that of the suffix 2^k lines
   further on. A group is named after its earliest suffix. Suffixes that are alone drop
   out of every later level, and doubling ends when all are, so the work follows
   what repeats and the number of rounds the logarithm of the longest repeated run.
2. ``lcp_intervals`` reads the intervals of common prefixes off the levels, longest step
   first: the suffixes at a node of length l whose next 2^k lines are equal move to a
   node of length l + 2^k, and the earliest of them also stays behind for all. After
   the last step suffixes at one node have exactly its length in common, so each later
   one starts the longest run that also starts earlier, and the node's earliest suffix
   is where that run was first.

A run inside a longer one with the same end is no maximal run and is left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from massmap.llm.common import HAS_WORD, NULL_ID, keyed, once
from massmap.session import written

#: What a suffix is at: the node's earliest suffix, its length, and the name of the next lines.
_NEXT = ["node_doc", "node_i", "n", "name_doc", "name_i"]


def line_sequences(texts: DataFrame, min_lines: int, min_words: int | None) -> DataFrame:
    """(doc, i, need, a, b): every worded line with two independent 64-bit hashes.

    ``need`` is the number of lines from here on that make a run worth deleting:
    ``min_lines``, or fewer if they hold ``min_words`` words.
    """
    worded = F.filter(
        F.transform(
            F.split("text", "\n", -1),
            lambda line: F.when(
                line.rlike(HAS_WORD),
                F.struct(
                    F.xxhash64(line).alias("a"), F.xxhash64(F.lit("b"), line).alias("b"),
                    (F.lit(0) if min_words is None else F.regexp_count(line, F.lit(HAS_WORD + "+"))).alias("words"),
                ),
            ),
        ),
        lambda line: line.isNotNull(),
    )

    def need(lines, i):
        total, words = F.lit(1), F.lit(0)
        for ahead in range(min_lines - 1 if min_words is not None else 0):
            words = words + F.coalesce(F.get(lines, i + ahead)["words"], F.lit(0))
            total = total + F.when(words < min_words, 1).otherwise(0)
        return total if min_words is not None else F.lit(min_lines)

    rows = once(
        worded,
        lambda lines: F.transform(
            lines, lambda line, i: F.struct(need(lines, i).alias("need"), line["a"].alias("a"), line["b"].alias("b"))
        ),
    )
    return texts.select("doc", F.posexplode(rows).alias("i", "line")).select("doc", "i", "line.need", "line.a", "line.b")


def _named(rows: DataFrame, key: list[str]) -> DataFrame:
    """(doc, i, need, name_doc, name_i): suffixes with an equal one elsewhere, named after the earliest of them."""
    groups = rows.groupBy(*key).agg(
        F.min(F.struct("doc", "i")).alias("first"), F.count(F.lit(1)).alias("members")
    )
    groups = groups.where("members > 1").drop("members")
    return rows.join(groups, key).select(
        "doc", "i", "need", F.col("first.doc").alias("name_doc"), F.col("first.i").alias("name_i")
    )


def prefix_levels(lines: DataFrame) -> list[DataFrame]:
    """Level k: the suffixes whose first 2^k lines occur at least twice, by the name of their group."""
    level = _named(lines, ["a", "b"])
    # rows with the same id are one document
    level = level.repartition("doc").groupBy("doc", "i").agg(
        F.min(F.struct("name_doc", "name_i", "need")).alias("least")
    )
    level = level.select("doc", "i", "least.need", "least.name_doc", "least.name_i")
    levels = []
    length = 1
    while True:
        level = written(level, "lines")
        if level.isEmpty():
            return levels
        levels.append(level)
        further = Window.partitionBy("doc").orderBy("i").rangeBetween(length, length)
        pairs = level.select(
            "doc", "i", "need", F.col("name_doc").alias("d1"), F.col("name_i").alias("i1"),
            F.first("name_doc").over(further).alias("d2"), F.first("name_i").over(further).alias("i2"),
        ).where(F.col("d2").isNotNull())
        level = _named(pairs, ["d1", "i1", "d2", "i2"])
        length *= 2


def lcp_intervals(levels: list[DataFrame], min_lines: int) -> DataFrame | None:
    """(doc, i, need, node_doc, node_i, n): suffixes at the nodes of their common prefixes.

    Suffixes of one node, the node's earliest among them, have exactly their first
    ``n`` lines in common, pair by pair. A suffix is at every node whose other
    suffixes begin later. None if no line occurs twice.
    """
    at_nodes = None
    for k in reversed(range(len(levels))):
        step = 2**k
        # suffixes at no node yet; of those that moved, the earliest still stands for all
        rows = levels[k]
        if k + 1 < len(levels):
            moved = levels[k + 1].where("name_doc != doc or name_i != i").select("doc", "i")
            rows = rows.join(moved, ["doc", "i"], "left_anti")
        if 2 * step - 1 < min_lines:  # these end with fewer than 2 * step lines in common
            rows = rows.where(F.col("need") < 2 * step)
        rows = rows.select(
            "doc", "i", "need", F.lit(NULL_ID).alias("node_doc"), F.lit(-1).alias("node_i"), F.lit(0).alias("n"),
            "name_doc", "name_i",
        )
        if at_nodes is not None:
            ahead = levels[k].select("doc", F.col("i").alias("at"), "name_doc", "name_i")
            going = at_nodes.withColumn("at", F.col("i") + F.col("n")).join(ahead, ["doc", "at"], "left")
            rows = rows.unionByName(going.drop("at"))
        rows = written(rows, "nodes")
        groups = rows.where(F.col("name_doc").isNotNull()).groupBy(*_NEXT).agg(
            F.min(F.struct("doc", "i")).alias("first"), F.count(F.lit(1)).alias("members")
        )
        groups = groups.where("members > 1").drop("members")
        first = F.col("first")
        goes = F.when(
            first.isNotNull(),
            F.struct(first["doc"].alias("node_doc"), first["i"].alias("node_i"), (F.col("n") + step).alias("n")),
        )
        stays = F.when(
            (F.col("n") > 0) & (first.isNull() | (first == F.struct("doc", "i"))), F.struct("node_doc", "node_i", "n")
        )
        nodes = rows.join(groups, _NEXT, "left").select(
            "doc", "i", "need", F.explode(F.array_compact(F.array(goes, stays))).alias("node")
        )
        at_nodes = nodes.select("doc", "i", "need", "node.*")  # read once, by the next step or the answer
    return at_nodes


def repeated_runs(texts: DataFrame, min_lines: int, min_words: int | None = None) -> DataFrame:
    """(doc, i, n, of_doc, of_i): maximal runs of ``n`` worded lines from the i-th on that also start earlier, at of_doc, of_i.

    Only runs of at least ``min_lines`` lines, or of ``min_words`` words.
    """
    at_nodes = lcp_intervals(prefix_levels(line_sequences(texts, min_lines, min_words)), min_lines)
    if at_nodes is None:
        return texts.sparkSession.createDataFrame([], "doc long, i int, n int, of_doc long, of_i int")
    later = at_nodes.where("(node_doc != doc or node_i != i) and n >= need")
    # ends never fall from one suffix to the next, so what lies inside another run ends with the one before
    before = Window.partitionBy("doc").orderBy("i")
    runs = later.withColumn("reached", F.lag(F.col("i") + F.col("n")).over(before))
    return runs.where("reached is null or reached < i + n").select(
        "doc", "i", "n", F.col("node_doc").alias("of_doc"), F.col("node_i").alias("of_i")
    )


def deleted_ranges(texts: DataFrame, min_lines: int, min_words: int | None = None) -> DataFrame:
    """(doc, gone): per document the disjoint ranges (i, n) of worded lines that later copies take up, in order."""
    order = Window.partitionBy("doc").orderBy("i")
    end = F.col("i") + F.col("n")
    ranges = repeated_runs(texts, min_lines, min_words).withColumn("end", end).withColumn(
        "fresh", F.when(F.col("i") < F.lag(end).over(order), 0).otherwise(1)
    ).withColumn("range", F.sum("fresh").over(order))
    ranges = ranges.groupBy("doc", "range").agg(F.min("i").alias("i"), F.max("end").alias("end"))
    return ranges.groupBy("doc").agg(
        F.sort_array(F.collect_list(F.struct("i", (F.col("end") - F.col("i")).alias("n")))).alias("gone")
    )


def dedup_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, min_lines: int = 3,
    min_words: int | None = 50,
) -> DataFrame:
    """``docs`` with later copies of repeated line runs deleted from the text.

    Lines end at ``\\n``; lines without a word are not part of the sequences, but go
    when they lie inside a deleted run. A line is deleted if it is part of a repeated
    run that also starts earlier (smaller id, or same document, earlier line) and has at
    least ``min_lines`` worded lines or ``min_words`` words, so one long line is enough;
    None counts lines alone. Runs are judged on the input; those that share a line are
    one deleted range. Adds ``n_lines`` (worded),
    ``n_removed`` (worded) and ``removed`` (ranges p to q of lines); columns of these
    names in the input are replaced, the text column holds what is left, and all
    other columns stay.

    A null text stays null, with no lines; an empty one stays empty. A null id is a
    document of its own that comes first. Rows with the same id are one document,
    returned as often as it came; if their texts differ, one line counts for each place and
    ranges beyond the end of a text are cut there. An empty table gives an empty result.
    """
    # both sides grow with the corpus: the hint keeps the join the same at every size
    gone = deleted_ranges(keyed(docs, id_col, text_col), min_lines, min_words).select(
        F.col("doc").alias("__doc"), F.col("gone").alias("__gone")
    ).hint("merge")
    joined = docs.withColumn("__key", F.coalesce(F.col(id_col).cast("bigint"), F.lit(NULL_ID))).join(
        gone, F.col("__key") == F.col("__doc"), "left"
    )
    gone_here = F.coalesce(F.col("__gone"), F.array().cast("array<struct<i:int,n:int>>"))
    nowhere = F.array().cast("array<struct<p:int,q:int>>")

    def worded(lines):
        """The places of the lines that hold a word."""
        places = F.transform(lines, lambda line, p: F.when(line.rlike(HAS_WORD), p))
        return F.filter(places, lambda place: place.isNotNull())

    def placed(row):
        """Ranges of worded lines as first and last places among all lines."""
        ends = F.transform(
            row["gone"],
            lambda range_: F.struct(
                F.get(row["places"], range_["i"]).alias("p"),
                F.get(row["places"], F.least(range_["i"] + range_["n"], F.size(row["places"])) - 1).alias("q"),
            ),
        )
        return F.when(F.size(row["gone"]) == 0, nowhere).otherwise(F.filter(ends, lambda cut: cut["p"].isNotNull()))

    def pieces(row):
        """The lines between the deleted ranges, as slices."""
        cut, all_ = row["cuts"], row["lines"]
        return F.flatten(
            F.transform(
                F.sequence(F.lit(0), F.size(cut)),
                lambda k: F.slice(
                    all_,
                    F.coalesce(F.get(cut, k - 1)["q"], F.lit(-1)) + 2,
                    F.coalesce(F.get(cut, k)["p"], F.size(all_)) - F.coalesce(F.get(cut, k - 1)["q"], F.lit(-1)) - 1,
                ),
            )
        )

    def left(row):
        return F.when(F.size(row["cuts"]) == 0, F.col(text_col)).otherwise(F.array_join(pieces(row), "\n"))

    def removed(row):
        """Worded lines inside the deleted ranges."""
        return F.aggregate(
            row["gone"], F.lit(0),
            lambda total, range_: total
            + F.greatest(F.least(range_["i"] + range_["n"], F.size(row["places"])) - range_["i"], F.lit(0)),
        )

    lines = F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1)
    done = once(
        lines, lambda all_: F.struct(all_.alias("lines"), worded(all_).alias("places"), gone_here.alias("gone"))
    )
    done = once(
        done,
        lambda row: F.struct(
            row["lines"].alias("lines"), F.size(row["places"]).alias("before"), removed(row).alias("removed"),
            placed(row).alias("cuts"),
        ),
    )
    done = once(
        done,
        lambda row: F.struct(
            row["before"].alias("before"), row["removed"].alias("removed"), row["cuts"].alias("cuts"),
            left(row).alias("text"),
        ),
    )
    out = joined.withColumn("__done", done)
    return out.select(
        *[F.col(f"`{name}`") for name in docs.columns if name not in (text_col, "n_lines", "n_removed", "removed")],
        F.when(F.col(text_col).isNotNull(), F.col("__done.text")).alias(text_col),
        F.col("__done.before").cast("bigint").alias("n_lines"),
        F.col("__done.removed").cast("bigint").alias("n_removed"),
        F.when(F.col(text_col).isNotNull(), F.col("__done.cuts")).otherwise(nowhere).alias("removed"),
    )


def digest(done: DataFrame) -> DataFrame:
    return done.select(
        "doc_id", "n_lines", "n_removed", F.size("removed").cast("bigint").alias("n_ranges"),
        F.sha2(F.col("text"), 256).alias("kept_sha256"),
    )
