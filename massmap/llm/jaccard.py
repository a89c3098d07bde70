"""Near-dedup by shingle similarity: SimHash links and banded min-hashes propose, the shingles decide.

Documents with the same set of shingles are one node, named after the smallest id.
Candidates are the SimHash links of the nodes and the nodes that share a band, that
is some min-hashes in a row. A candidate becomes a link only if the Jaccard similarity
of the two sets of shingle hashes reaches ``least``.

Most candidates never meet. Of the nodes that share a band with another one, the
shingles are counted; what no other such node holds can be in no intersection. A node
with more than ``1 - least`` of such shingles has no partner at all, which takes out
documents that share a template and differ in the rest, however many they are. The
others first meet the member of each bucket that has the fewest shingles of its own,
the one closest to what a group has in common. Only buckets that this leaves in several
components go on: their members are dealt into blocks, ordered by component, and pairs
of blocks that do not lie in one component are compared inside a task, which returns a
spanning forest of the links it finds. So no pair of documents is a row unless one of
them is such a nearest member, and sets, not texts, are moved.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from massmap.llm import simhash
from massmap.llm.common import keyed, raw_texts
from massmap.llm.components import Forest, components
from massmap.operators.ordered import ranked
from massmap.session import written

SEED = 42
#: Two sets at 0.8 share one of 20 bands of 5 min-hashes with probability 1 - (1 - 0.8 ** 5) ** 20 = 0.9996.
BANDS, ROWS = 20, 5
#: Shingles hashed by all functions at a time, and shingles looked at together when blocks are compared.
_BLOCK = 1 << 11
#: Members of a bucket that are compared with as many others in one step.
SIDE = 256


def shingles(text: bytes, shingle: int) -> set[bytes]:
    words = text.lower().split()
    if len(words) <= shingle:
        return {b" ".join(words)} if words else set()
    return {b" ".join(gram) for gram in zip(*[words[k:] for k in range(shingle)])}


def hashed(text: bytes, shingle: int) -> np.ndarray:
    """The distinct shingles of a text as ascending hashes."""
    held = shingles(text, shingle)
    return np.sort(np.fromiter((xxhash.xxh64_intdigest(gram, SEED) for gram in held), np.uint64, len(held)))


def _sketches(shingle: int, bands: int, rows: int):
    def find(batches):
        draw = np.random.default_rng(SEED)
        flips = draw.integers(0, 1 << 64, (bands * rows, 1), np.uint64)
        factors = draw.integers(0, 1 << 64, (bands * rows, 1), np.uint64) | np.uint64(1)
        for batch in batches:
            names, keys = [], []
            for text in raw_texts(batch.column(1)):
                hashes = hashed(text, shingle)
                names.append(xxhash.xxh3_128_digest(hashes.tobytes()))
                if not len(hashes):
                    keys.append([])
                    continue
                least = np.full(bands * rows, np.iinfo(np.uint64).max, np.uint64)
                for at in range(0, len(hashes), _BLOCK):
                    mixed = (hashes[None, at : at + _BLOCK] ^ flips) * factors
                    np.minimum(least, mixed.min(axis=1), out=least)
                keys.append([xxhash.xxh64_intdigest(row.tobytes(), SEED) for row in least.reshape(bands, rows)])
            yield pa.record_batch(
                [
                    batch.column(0), pa.array(names, pa.binary()),
                    pa.array([np.array(k, np.uint64).view(np.int64) for k in keys], pa.list_(pa.int64())),
                ],
                ["doc", "set", "keys"],
            )

    return find


def _sets(shingle: int):
    def find(batches):
        for batch in batches:
            sets = [hashed(text, shingle).view(np.int64) for text in raw_texts(batch.column(1))]
            yield pa.record_batch([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], ["doc", "hashes"])

    return find


def shared_sets(texts: DataFrame, shingle: int) -> DataFrame:
    """(doc, n, own, hashes): the size of each set, how much of it no other one has, and what others have, ascending."""
    sets = texts.mapInArrow(_sets(shingle), "doc long, hashes array<long>").withColumn("set", F.xxhash64("hashes"))
    sets = written(sets.dropDuplicates(["doc", "set"]), "sets")  # an id may come with several texts
    spread = sets.select("doc", "set", F.explode("hashes").alias("hash"))
    several = spread.groupBy("hash").agg(F.count(F.lit(1)).alias("docs")).where("docs > 1").select("hash")
    met = spread.join(several, "hash").groupBy("doc", "set").agg(F.array_sort(F.collect_list("hash")).alias("met"))
    both = sets.select("doc", "set", F.size("hashes").alias("n")).join(met, ["doc", "set"], "left")
    return both.select(
        "doc", "n", (F.col("n") - F.coalesce(F.size("met"), F.lit(0))).alias("own"),
        F.coalesce("met", F.array().cast("array<long>")).alias("hashes"),
    )


def _reach(common, n, m, least: float):
    """Whether so many common shingles make sets of n and m alike."""
    return common >= least * (n + m - common)


def _alike(least: float):
    def find(batches):
        for batch in batches:
            left, right = batch.column(3), batch.column(5)
            good = [
                row for row, (n, m) in enumerate(zip(batch.column(2).to_pylist(), batch.column(4).to_pylist()))
                if _reach(len(np.intersect1d(left[row].values, right[row].values, assume_unique=True)), n, m, least)
            ]
            if good:
                yield pa.record_batch([batch.column(0), batch.column(1)], ["a", "b"]).take(pa.array(good))

    return find


def _verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose sets are alike."""
    one = sets.select(F.col("doc").alias("a"), F.col("n").alias("n_a"), F.col("own").alias("own_a"), F.col("hashes").alias("left"))
    other = sets.select(F.col("doc").alias("b"), F.col("n").alias("n_b"), F.col("own").alias("own_b"), F.col("hashes").alias("right"))
    fits = pairs.join(other, "b").join(one, "a").where(_possible(F.col("n_a"), F.col("own_a"), F.col("n_b"), F.col("own_b"), least))
    return fits.select("a", "b", "n_a", "left", "n_b", "right").mapInArrow(_alike(least), "a long, b long")


def _possible(n, own, m, other_own, least: float):
    """Sets without their own shingles must still reach ``least``; both must have so much that the other may have."""
    return ((n - own) >= least * (m + own)) & ((m - other_own) >= least * (n + other_own))


def _compared(least: float):
    """Links between the two blocks of each group: (block pair, side, doc, n, own, component, hashes)."""

    def compare(table: pa.Table) -> pa.Table:
        side = np.asarray(table["side"])
        doc, n, own, group = (np.asarray(table[name]) for name in ("doc", "n", "own", "group"))
        hashes = table["hashes"].combine_chunks()
        rows = np.repeat(np.arange(len(doc)), np.asarray(hashes.value_lengths()))
        codes = np.unique(np.asarray(hashes.flatten()), return_inverse=True)[1]
        order = np.argsort(codes, kind="stable")
        rows, codes = rows[order], codes[order]
        left = np.flatnonzero(side == 0)
        right = np.flatnonzero(side == 1) if (side == 1).any() else left
        common = np.zeros((len(doc), len(doc)), np.float32) if right is left else np.zeros((len(left), len(right)), np.float32)
        place = np.zeros(len(doc), np.int64)
        place[left], place[right] = np.arange(len(left)), np.arange(len(right))
        for low in range(0, int(codes[-1]) + 1 if len(codes) else 0, _BLOCK):
            a, b = np.searchsorted(codes, [low, low + _BLOCK])
            flat, at = rows[a:b], codes[a:b] - low
            held = np.zeros((2, max(len(left), len(right)), _BLOCK), np.float32)
            second = np.zeros(len(flat), np.int64) if right is left else side[flat]
            held[second, place[flat], at] = 1
            common += held[0, : len(left)] @ held[0 if right is left else 1, : len(right)].T
        n_a, n_b = n[left][:, None], n[right][None, :]
        alike = _reach(common, n_a, n_b, least) & (group[left][:, None] != group[right][None, :])
        forest = Forest()
        for i, j in zip(*np.nonzero(alike)):
            forest.link(int(doc[left[i]]), int(doc[right[j]]))
        nodes, roots = forest.links()
        return pa.table({"a": pa.array(nodes, pa.int64()), "b": pa.array(roots, pa.int64())})

    return compare


def _blocked(members: DataFrame, sets: DataFrame, bucket: list[str], least: float) -> DataFrame:
    """All links inside buckets between members of different components."""
    placed = ranked(members, bucket, [F.col("group"), F.col("doc")], "turn")
    placed = written(placed.withColumn("block", F.expr(f"cast((turn - 1) div {SIDE} as int)")).drop("turn"), "blocks")
    blocks = placed.groupBy(*bucket, "block").agg(F.min("group").alias("low"), F.max("group").alias("high"))
    one, other = (blocks.select(*bucket, *[F.col(c).alias(f"{c}{side}") for c in ("block", "low", "high")]) for side in (0, 1))
    pairs = one.join(other, bucket).where(
        "block0 <= block1 and not (low0 = high0 and low1 = high1 and low0 = low1)"
    ).select(*bucket, "block0", "block1")
    dealt = pairs.select(*bucket, "block0", "block1", F.explode(F.expr(
        "if(block0 = block1, array(struct(0 as side, block0 as block)), "
        "array(struct(0 as side, block0 as block), struct(1 as side, block1 as block)))"
    )).alias("part")).select(*bucket, "block0", "block1", "part.*")
    rows = dealt.join(placed, [*bucket, "block"]).join(sets, "doc")
    key = F.xxhash64(*bucket, "block0", "block1").alias("pair")
    rows = rows.select(key, "side", "doc", "n", "own", "group", "hashes")
    return rows.groupBy("pair").applyInArrow(_compared(least), "a long, b long")


def _simhash_pairs(texts: DataFrame, shingle: int, radius: int) -> DataFrame:
    """Documents (a, b) along the links of their fingerprints."""
    prints = written(simhash.fingerprints(texts, "doc", "text", shingle=shingle), "fingerprints")
    firsts = prints.groupBy("fingerprint").agg(F.min("doc").alias("first"))
    same = prints.join(firsts, "fingerprint").select(F.col("first").alias("a"), F.col("doc").alias("b"))
    ends = [firsts.select(F.col("fingerprint").alias(side), F.col("first").alias(f"of_{side}")) for side in "ab"]
    linked = simhash.links(prints, radius=radius).join(ends[0], "a").join(ends[1], "b")
    linked = linked.select(F.least("of_a", "of_b").alias("a"), F.greatest("of_a", "of_b").alias("b"))
    return same.unionByName(linked).where("a != b").distinct()


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, shingle: int = 5, least: float = 0.8,
    radius: int = 6, bands: int = BANDS, rows: int = ROWS,
) -> DataFrame:
    """(doc, component): each distinct id with the smallest id it is connected to.

    Links are pairs whose sets of ``shingle``-word shingles have a Jaccard similarity of
    ``least`` or more; every link has been verified on the 64-bit hashes of all shingles.
    Texts without a word are alike. Null ids are ``NULL_ID``; rows with the same id are one
    document. Other columns are not read, so their names cannot clash. An empty table gives an
    empty result.
    """
    texts = keyed(docs, id_col, text_col)
    sketches = written(texts.mapInArrow(_sketches(shingle, bands, rows), "doc long, set binary, keys array<long>"), "sketches")
    nodes = sketches.groupBy("set").agg(F.min("doc").alias("first"), F.any_value("keys").alias("keys"))
    nodes = written(nodes, "nodes")
    copies = sketches.join(nodes.select("set", "first"), "set").select(F.col("first").alias("a"), F.col("doc").alias("b"))
    spread = nodes.select(F.col("first").alias("doc"), F.posexplode("keys").alias("band", "key"))
    bucket = ["band", "key"]
    shared = spread.groupBy(*bucket).agg(F.count(F.lit(1)).alias("members")).where("members > 1").select(*bucket)
    members = written(spread.join(shared, bucket), "members")
    single = texts.join(nodes.select(F.col("first").alias("doc")).distinct(), "doc", "left_semi")
    proposed = written(_simhash_pairs(single, shingle, radius), "pairs")
    wanted = members.select("doc").unionByName(proposed.select(F.col("a").alias("doc"))).unionByName(proposed.select(F.col("b").alias("doc")))
    sets = shared_sets(single.join(wanted.distinct(), "doc", "left_semi"), shingle)
    sets = written(sets.where((F.col("n") - F.col("own")) >= least * F.col("n")), "sets")

    # in every bucket the member with the fewest shingles of its own meets all others
    known = members.join(sets.select("doc", F.struct((F.col("own") / F.col("n")).alias("rest"), "doc").alias("near")), "doc")
    members = written(known, "members")
    nearest = members.groupBy(*bucket).agg(F.min("near.rest").alias("rest"), F.min("near").alias("near"))
    first = members.join(nearest.select(*bucket, F.col("near.doc").alias("a")), bucket).where("doc != a")
    pairs = proposed.unionByName(first.select(F.least("a", "doc").alias("a"), F.greatest("a", "doc").alias("b"))).distinct()
    links = written(_verified(pairs, sets, least), "links")

    placed = members.join(components(links), F.col("doc") == F.col("node"), "left").select(
        "doc", *bucket, F.coalesce("component", "doc").alias("group")
    )
    placed = written(placed, "members")
    several = placed.groupBy(*bucket).agg(F.min("group").alias("low"), F.max("group").alias("high")).where("low != high")
    links = links.unionByName(_blocked(placed.join(several.select(*bucket), bucket), sets, bucket, least))
    everything = components(written(links.unionByName(copies), "links"))
    ids = sketches.select("doc").distinct()
    return ids.join(everything, F.col("doc") == F.col("node"), "left").select(
        "doc", F.coalesce("component", "doc").alias("component")
    )
