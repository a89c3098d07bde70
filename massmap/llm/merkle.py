"""A Merkle manifest of a table: one digest for all rows, and a proof for every row.

A row's digest is a leaf. The leaves of a group are ranked, and the base-``ARITY``
digits of the rank are columns. Grouping the digits away one after the other, the
lowest first, nests each run of children as structs in their parent's row. All
digits of a block of ``ARITY ** DIGITS`` leaves are grouped away under one
partitioning, so a block costs one exchange and its struct has a fixed largest
size. The digests of the blocks are the leaves of the next, much smaller, round.

On the way back a block's struct is opened by a transform that notes for each child
the digests to its left and right, and an explode, digit by digit. No row looks its
siblings up. Between two rounds a block's struct meets the steps above it in a
grouping by block.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from massmap.operators.ordered import ranked
from massmap.session import written

ARITY = 3
#: Digits of the rank that are grouped away inside one block: 243 leaves.
DIGITS = 5
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest_of(values: Sequence[Column]) -> Column:
    """Lowercase hexadecimal SHA-256 of the values, each as its UTF-8 length, a colon and itself; null is a hyphen."""
    parts = []
    for value in values:
        told = value.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(told).cast("string"), F.lit(":"), told), F.lit("-")))
    return F.sha2(F.concat(*parts), 256)


def fold(leaf: Column, proof: Column) -> Column:
    """The digest that a leaf and the steps of its proof, lowest first, come to."""
    return F.aggregate(proof, leaf, lambda below, step: F.sha2(F.concat(step["before"], below, step["after"]), 256))


#: A level's only node is not digested again; a run of one that is not the first has others before it.
_SEVERAL = "({place} > 0 or size({kids}) > 1)"
_JOINED = "concat_ws('', transform({kids}, kid -> kid.h))"


def _nested(nodes: DataFrame, group: str) -> DataFrame:
    """One row per block: ``node``, structs of ``h`` and ``kids``, nested as deep as a block has digits.

    ``nodes`` has the group, its 0-based ``place`` there, and ``node`` with ``h``.
    """
    digits = [f"__d{k}" for k in range(DIGITS)]
    rows = nodes.selectExpr(
        group, f"place div {ARITY**DIGITS} as block",
        *[f"cast(place div {ARITY**k} % {ARITY} as int) as {name}" for k, name in enumerate(digits)], "node",
    ).repartition(group, "block")  # every grouping below finds its rows where they are
    for k, digit in enumerate(digits):
        held = [group, "block", *digits[k + 1 :]]
        place = " + ".join(f"{ARITY**above} * {name}" for above, name in enumerate([*digits[k + 1 :], "block"]))
        rows = rows.groupBy(*held).agg(
            F.expr(f"transform(array_sort(collect_list(struct({digit}, node))), kid -> kid.node) as kids")
        ).selectExpr(
            *held, f"struct(if({_SEVERAL.format(place=f'({place})', kids='kids')}, "
            f"sha2({_JOINED.format(kids='kids')}, 256), kids[0].h) as h, kids) as node",
        )
    return written(rows, "blocks")


def _rounds(nodes: DataFrame, group: str) -> tuple[list[DataFrame], DataFrame]:
    """The blocks of every round, lowest first, and a row per group: the group and ``h``."""
    rounds = []
    while True:
        blocks = _nested(nodes, group)
        rounds.append(blocks)
        if not blocks.agg(F.max("block").alias("last")).first().last:
            return rounds, blocks.select(group, F.col("node.h").alias("h"))
        nodes = blocks.select(group, F.col("block").alias("place"), F.struct(F.col("node.h").alias("h")).alias("node"))


def _opened(blocks: DataFrame, above: DataFrame, group: str, carried: list[str]) -> DataFrame:
    """The nodes below ``blocks``: group, ``place``, ``node``, ``proof`` and what ``above`` carries.

    ``above`` has a row per block: group, ``block``, the ``proof`` above it and ``carried``.
    """
    rows = blocks.unionByName(above, allowMissingColumns=True).groupBy(group, "block").agg(
        *[F.first(name, ignorenulls=True).alias(name) for name in ("node", "proof", *carried)]
    ).withColumnRenamed("block", "place")
    before = _JOINED.format(kids="slice(node.kids, 1, digit)")
    after = _JOINED.format(kids=f"slice(node.kids, digit + 2, {ARITY})")
    for _ in range(DIGITS):
        rows = rows.selectExpr(
            group, "place", "proof", *carried, _SEVERAL.format(place="place", kids="node.kids") + " as several",
            f"explode(transform(node.kids, (it, digit) -> struct(it, digit, {before} as before, {after} as after))) as one",
        ).selectExpr(
            group, f"place * {ARITY} + one.digit as place", "one.it as node",
            "if(several, concat(array(struct(one.before, one.after)), proof), proof) as proof", *carried,
        )
    return rows


def _proved(rounds: list[DataFrame], tops: DataFrame, group: str, carried: list[str]) -> DataFrame:
    """From one row per group, with the ``proof`` above it, down to the leaves."""
    rows = tops.withColumn("place", F.lit(0).cast("bigint"))
    for blocks in reversed(rounds):
        above = rows.select(group, F.col("place").alias("block"), "proof", *carried)
        rows = _opened(blocks, above, group, carried)
    return rows


def manifest(
    docs: DataFrame, fields: Sequence[str] = FIELDS, order_col: str = "doc_id", group_col: str = "source", *,
    altered: dict[str, Column] | None = None,
) -> DataFrame:
    """Digest every row, roll the digests up per group and the groups up to one root, and prove each row.

    Per row: ``order_col``, ``leaf``, ``subroot`` (of the group), ``root`` and ``proof``, an
    array of ``before`` and ``after``: the joined digests to the left and right of the
    node on each level from the leaf to the root. ``altered`` gives other values for
    some of the fields; ``claimed`` is the leaf of the row with these (without them,
    the leaf), to be held against the proof of the row itself by :func:`fold`.

    Within a group the leaves ascend by ``order_col``, nulls first, equal ones by digest, so
    repeated rows are leaves of their own and their order cannot matter. Groups ascend by
    the bytes of their name, the null group first. A null field counts as a hyphen and
    differs from an empty one. An empty table gives an empty result. Texts of any length
    are read where they lie; only digests move. Columns that are not named are not
    read, so their names cannot clash.
    """
    now = {name: F.col(f"`{name}`") for name in fields}
    own, other = digest_of(list(now.values())), digest_of(list((now | (altered or {})).values()))
    name = F.coalesce(F.concat(F.lit("1"), F.col(f"`{group_col}`").cast("string")), F.lit("0"))
    leaves = written(
        docs.select(name.alias("group"), F.col(f"`{order_col}`").alias("doc"), own.alias("h"), other.alias("claimed")), "leaves"
    )
    order = [F.col("doc").asc_nulls_first(), F.col("h"), F.col("claimed")]
    placed = ranked(leaves, ["group"], order, "rank").select(
        "group", (F.col("rank") - 1).alias("place"), F.struct("h", "claimed", "doc").alias("node")
    )
    rounds, groups = _rounds(placed, "group")
    listed = ranked(groups.withColumn("all", F.lit(0)), ["all"], [F.col("group")], "rank").select(
        "all", (F.col("rank") - 1).alias("place"), F.struct("h", "group").alias("node")
    )
    upper, root = _rounds(listed, "all")
    nothing = F.array().cast("array<struct<before:string,after:string>>")
    tops = _proved(upper, root.select("all", F.col("h").alias("root"), nothing.alias("proof")), "all", ["root"]).select(
        F.col("node.group").alias("group"), F.col("node.h").alias("subroot"), "root", "proof"
    )
    return _proved(rounds, tops, "group", ["subroot", "root"]).select(
        F.col("node.doc").alias(order_col), F.col("node.h").alias("leaf"), F.col("node.claimed").alias("claimed"),
        "subroot", "root", "proof",
    )


def tampered(docs: DataFrame) -> dict[str, Column]:
    """Documents whose id has an even CRC-32 lose the line feeds of their text."""
    chosen = F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 2 == 0
    return {"text": F.when(chosen, F.translate("text", "\n", "")).otherwise(F.col("text"))}


def digest(proved: DataFrame) -> DataFrame:
    siblings = F.transform("proof", lambda step: F.concat(step["before"], step["after"]))
    return proved.select(
        "doc_id", "leaf", "subroot", "root", F.sha2(F.concat_ws("", siblings), 256).alias("proof_sha256"),
        fold(F.col("claimed"), F.col("proof")).alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))
