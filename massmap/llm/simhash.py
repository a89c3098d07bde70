"""SimHash near-dedup: fingerprints in pigeonhole blocks.

A fingerprint is split into ``blocks`` blocks. Two fingerprints that differ in at
most ``radius`` bits differ in at most ``radius`` blocks, so they agree on at
least ``blocks - radius`` whole blocks. There is one table for every choice of
that many blocks; pairs that share a key of a table are verified by their
Hamming distance. Only distinct fingerprints are compared.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from massmap.llm.common import keyed, own_id, raw_texts
from massmap.llm.components import Forest, components
from massmap.session import written

BITS = 64
SEED = 42
#: Shingles whose bits are counted at a time, and fingerprints compared with all of a bucket at a time.
_BLOCK = 1 << 15
_PAIRS = 1 << 20
#: A bucket up to this size is compared pair by pair; a larger one is split by further blocks first.
DIRECT = 512
#: Fingerprints that an average bucket may hold.
BUCKET = 64


# --- fingerprints -----------------------------------------------------------------------
def _shingle_hashes(words: list[bytes], shingle: int):
    if not words:
        return
    if len(words) <= shingle:
        yield xxhash.xxh64_intdigest(b" ".join(words), SEED)
        return
    for gram in zip(*[words[k:] for k in range(shingle)]):
        yield xxhash.xxh64_intdigest(b" ".join(gram), SEED)


def _fingerprints(shingle: int):
    def bits(hashes: np.ndarray) -> np.ndarray:
        return np.unpackbits(hashes.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)

    def settle(counts: np.ndarray, total: np.ndarray) -> np.ndarray:
        majority = counts * 2 > total[:, None]
        return np.packbits(majority, axis=1).view(">u8").reshape(-1).astype(np.int64)

    def find(batches):
        for batch in batches:
            counts = np.zeros((batch.num_rows, BITS), np.int64)
            total = np.zeros(batch.num_rows, np.int64)
            rows, hashes, weight = [], [], 0

            def add(rows=rows, hashes=hashes, counts=counts):
                if hashes:
                    sizes = np.array([len(part) for part in hashes])
                    heads = np.cumsum(sizes) - sizes
                    counts[rows] += np.add.reduceat(bits(np.concatenate(hashes)), heads, axis=0, dtype=np.int64)
                    rows.clear()
                    hashes.clear()

            for row, text in enumerate(raw_texts(batch.column(1))):
                stream = _shingle_hashes(text.lower().split(), shingle)
                while True:
                    part = np.fromiter((h for _, h in zip(range(_BLOCK), stream)), np.uint64)
                    if not len(part):
                        break
                    total[row] += len(part)
                    if rows and rows[-1] == row:
                        add()
                    rows.append(row)
                    hashes.append(part)
                    weight += len(part)
                    if weight > _BLOCK:
                        add()
                        weight = 0
            add()
            yield pa.record_batch([batch.column(0), pa.array(settle(counts, total))], ["doc", "fingerprint"])

    return find


def fingerprints(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, shingle: int = 3
) -> DataFrame:
    """(doc, fingerprint): a bit is 1 if it is set in more than half of the shingle hashes.

    Words are taken in lower case (A-Z only), shingles with repeats; a text of fewer
    words is one shingle, a null or empty text has the fingerprint zero.
    """
    return keyed(docs, id_col, text_col).mapInArrow(_fingerprints(shingle), "doc long, fingerprint long")


# --- links ----------------------------------------------------------------------------------
def masks(blocks: int, radius: int) -> list[int]:
    """The bits of every choice of ``blocks - radius`` blocks."""
    edges = [BITS * k // blocks for k in range(blocks + 1)]
    parts = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    return [sum(choice) for choice in combinations(parts, blocks - radius)]


def blocks_for(prints: int, radius: int) -> int:
    """The fewest blocks whose keys are long enough to leave about ``BUCKET`` fingerprints to a bucket.

    Any number of blocks above ``radius`` finds the same links; more blocks make more
    tables with smaller buckets.
    """
    wanted = max(1.0, math.log2(max(1, prints) / BUCKET))
    return next(n for n in range(radius + 1, BITS + 1) if (BITS // n) * (n - radius) >= wanted or n >= 2 * radius + 2)


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def links_within(prints: np.ndarray, free: int, radius: int, forest: Forest) -> None:
    """Link distinct fingerprints of one bucket that differ in at most ``radius`` of the ``free`` bits.

    A large bucket is split again by the same principle: of ``radius + 1`` parts of
    the free bits, a close pair agrees on one. With so few free bits that a part
    would be a single bit, the bucket itself is small.
    """
    n = len(prints)
    if n < 2:
        return
    places = [bit for bit in range(BITS) if free >> bit & 1]
    if n <= DIRECT or len(places) < 2 * (radius + 1):
        step = max(1, _PAIRS // n)
        for at in range(0, n - 1, step):
            block = prints[at : at + step]
            near = np.bitwise_count(block[:, None] ^ prints[None, at + 1 :]) <= radius
            row, col = np.nonzero(np.triu(near))
            for a, b in zip(block[row].view(np.int64).tolist(), prints[at + 1 + col].view(np.int64).tolist()):
                forest.link(a, b)
        return
    for k in range(radius + 1):
        part = sum(1 << bit for bit in places[k :: radius + 1])
        key = prints & np.uint64(part)
        order = np.argsort(key, kind="stable")
        cuts = np.flatnonzero(np.diff(key[order])) + 1
        for bucket in np.split(prints[order], cuts):
            links_within(bucket, free & ~part, radius, forest)


def _links(chosen: list[int], radius: int):
    def bucket(table: int, held: list[np.ndarray], forest: Forest):
        prints = np.unique(np.concatenate(held))
        links_within(prints, ((1 << BITS) - 1) & ~chosen[table], radius, forest)

    def find(batches):
        held, open_ = [], None
        for batch in batches:
            forest = Forest()
            table, key = np.asarray(batch.column(0)), np.asarray(batch.column(1))
            prints = np.asarray(batch.column(2)).view(np.uint64)
            heads = np.flatnonzero(np.append(True, (table[1:] != table[:-1]) | (key[1:] != key[:-1])))
            ends = np.append(heads[1:], len(key))
            for a, b in zip(heads.tolist(), ends.tolist()):
                name = (int(table[a]), int(key[a]))
                if name != open_:
                    if len(held) > 1 or held and len(held[0]) > 1:
                        bucket(open_[0], held, forest)
                    held, open_ = [], name
                held.append(prints[a:b])
            nodes, roots = forest.links()
            if nodes:
                yield pa.record_batch([pa.array(nodes, pa.int64()), pa.array(roots, pa.int64())], ["a", "b"])
        forest = Forest()
        if held:
            bucket(open_[0], held, forest)
        nodes, roots = forest.links()
        if nodes:
            yield pa.record_batch([pa.array(nodes, pa.int64()), pa.array(roots, pa.int64())], ["a", "b"])

    return find


def links(prints: DataFrame, *, radius: int = 3, blocks: int | None = None) -> DataFrame:
    """Links between distinct fingerprints at most ``radius`` bits apart.

    What comes out of a bucket is a spanning forest of its links, never all pairs
    of a group; it connects exactly what the links connect.
    """
    distinct = prints.select("fingerprint").distinct()
    if blocks is None:
        distinct = written(distinct, "prints")
        blocks = blocks_for(distinct.count(), radius)
    chosen = masks(blocks, radius)
    table = F.explode(
        F.array(*[F.struct(F.lit(k).alias("table"), F.lit(_signed(mask)).alias("mask")) for k, mask in enumerate(chosen)])
    )
    rows = distinct.select("fingerprint", table.alias("t"))
    rows = rows.select(
        F.col("t.table").alias("table"), F.col("fingerprint").bitwiseAND(F.col("t.mask")).alias("key"), "fingerprint"
    )
    dealt = rows.repartition("table", "key").sortWithinPartitions("table", "key")
    return dealt.mapInArrow(_links(chosen, radius), "a long, b long")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, shingle: int = 3, radius: int = 3,
    blocks: int | None = None,
) -> DataFrame:
    """One row per document: the id, ``fingerprint`` (long) and ``component_id``.

    ``component_id`` is the smallest id reachable over links of at most ``radius``
    differing bits, the document's own included. Texts without a word have the
    fingerprint zero and are linked like any other. A null id is smaller than all
    others and is reported as null; rows with the same id are returned each with
    its own fingerprint. Other columns are not read, so their names cannot clash.
    An empty table gives an empty result.
    """
    prints = written(fingerprints(docs, id_col, text_col, shingle=shingle), "fingerprints")
    groups = components(links(prints, radius=radius, blocks=blocks))
    firsts = prints.groupBy("fingerprint").agg(F.min("doc").alias("first"))
    named = firsts.join(groups, F.col("fingerprint") == F.col("node"), "left").select(
        "fingerprint", "first", F.coalesce("component", "fingerprint").alias("component")
    )
    smallest = named.groupBy("component").agg(F.min("first").alias("smallest"))
    of_print = named.join(smallest, "component").select("fingerprint", "smallest")
    return prints.join(of_print, "fingerprint").select(
        own_id().alias(id_col), "fingerprint", own_id("smallest").alias("component_id")
    )


def digest(done: DataFrame) -> DataFrame:
    return done.select(
        "doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id"
    )
