"""Finding windows that occur before: what word-level and byte-level substring dedup share.

A document is a sequence of units (words or bytes). A window is ``size``
consecutive units. Every window is anchored at its smallest-hashed gram of
``gram`` units, so equal windows have equal anchors, and consecutive windows
with the same anchor form a run.

1. ``repeated_runs``: runs are dealt by the hash of their anchor. An anchor seen
   once in the whole corpus cannot belong to a repeated window; its run is done.
2. ``segments``: the other runs are cut out of the texts and sent, as one string
   each, to the bucket of their anchor. Equal strings of one flush travel once;
   of them only the earliest can be the first occurrence.
3. ``covered``: each bucket is judged exactly by the method of the operator.

A bucket with more than ``split_over`` runs is hot: its runs are sent window by
window, each to the bucket of its own hash, so that equal windows still meet but
the bucket is spread over the cluster. No task holds more than one bucket of at
most ``split_over`` runs besides the batch it reads.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from massmap.llm.common import binaries, raw_texts, utf8

#: Units that are hashed at a time; positions within them take the low bits of a sliding minimum.
CHUNK = 1 << 20
_LOW_BITS = 22
_PLACE = np.uint64((1 << _LOW_BITS) - 1)
_BASE = 0x9E3779B97F4A7C15 | 1
_MEMBER = np.dtype([("doc", "<i8"), ("start", "<i4"), ("info", "<i4")])
_SPAN = np.dtype([("doc", "<i8"), ("start", "<i4"), ("n", "<i4")])
#: Bytes of strings gathered before equal ones are merged and sent.
FLUSH = 8 << 20
_HOT = 1 << 16


@dataclass(frozen=True)
class Windows:
    """What a window is, and how texts become units."""

    size: int
    gram: int
    #: texts -> (row, offset in the row, length, hashed units) of pieces, in chunks of at most CHUNK units
    hashed: Callable[[pa.Array, int], Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]]
    #: one text -> a function (start, units) -> packed string
    cutter: Callable[[bytes], Callable[[int, int], bytes]]
    #: packed strings of whole buckets -> spans of windows that are not the first
    judge: Callable[[list[int], list[int], list[bytes], list[int], list[int], int], list[tuple[int, int, int]]]

    @property
    def width(self) -> int:
        return self.size - self.gram + 1


# --- polynomial prefix hashes modulo 2**64 -----------------------------------------
_POWERS: dict[str, np.ndarray] = {}


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """1, b, b**2, ... (or of the inverse of b), wrapping; kept per worker and grown on demand."""
    name = "inverse" if inverse else "power"
    known = _POWERS.get(name)
    if known is None or len(known) < n:
        base = pow(_BASE, -1, 1 << 64) if inverse else _BASE
        steps = np.full(max(n, 1 << 16), base, np.uint64)
        steps[0] = 1
        known = _POWERS[name] = np.cumprod(steps, dtype=np.uint64)
    return known[:n]


def prefix_hashes(units: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(units) + 1, np.uint64)
    np.cumsum(units * powers(len(units)), dtype=np.uint64, out=sums[1:])
    return sums


def mixed(values: np.ndarray) -> np.ndarray:
    """Spread every bit over the word, so that the order of hashes says nothing about the texts."""
    values = (values ^ (values >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    values = (values ^ (values >> np.uint64(29))) * np.uint64(0xCA9B0C7EBA1DA115)
    return values ^ (values >> np.uint64(32))


#: A random word per byte, by rule, so that short byte strings do not have small hashes.
BYTE_CODES = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))


def gram_hashes(units: np.ndarray, gram: int) -> np.ndarray:
    sums = prefix_hashes(units)
    n = len(units) - gram + 1
    return mixed((sums[gram:] - sums[:n]) * powers(n, inverse=True))


def sliding_min(keys: np.ndarray, width: int) -> np.ndarray:
    done = 1
    while done < width:
        step = min(done, width - done)
        keys = np.minimum(keys[:-step], keys[step:])
        done += step
    return keys


def anchored_runs(units: np.ndarray, lengths: np.ndarray, size: int, gram: int):
    """Runs of windows with one anchor: piece, first window, windows, anchor's distance, anchor's hash."""
    if len(units) < size:
        return None
    grams = gram_hashes(units, gram)
    keys = (grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64)
    lowest = (sliding_min(keys, size - gram + 1) & _PLACE).astype(np.int64)
    begins = np.cumsum(lengths) - lengths
    counts = np.maximum(lengths - size + 1, 0)
    total = int(counts.sum())
    if not total:
        return None
    piece = np.repeat(np.arange(len(lengths)), counts)
    inside = np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts)
    at = begins[piece] + inside
    anchor = lowest[at]
    fresh = np.ones(total, bool)
    fresh[1:] = (anchor[1:] != anchor[:-1]) | (piece[1:] != piece[:-1])
    first = np.flatnonzero(fresh)
    run = np.diff(np.append(first, total))
    return piece[first], inside[first], run, anchor[first] - at[first], grams[anchor[first]].view(np.int64)


def chunked(lengths: np.ndarray, size: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Rows, offsets and lengths of pieces of at most CHUNK units; a longer row is cut into overlapping pieces."""
    ends = np.cumsum(lengths)
    row = 0
    while row < len(lengths):
        if lengths[row] > CHUNK:
            for start in range(0, int(lengths[row]) - size + 1, CHUNK - size + 1):
                yield (
                    np.array([row]), np.array([start]), np.array([min(CHUNK, int(lengths[row]) - start)])
                )
            row += 1
            continue
        done = ends[row] - lengths[row]
        stop = max(row + 1, int(np.searchsorted(ends, done + CHUNK, side="right")))
        longer = np.flatnonzero(lengths[row:stop] > CHUNK)
        stop = row + int(longer[0]) if len(longer) else stop
        rows = np.arange(row, stop)
        yield rows, np.zeros(len(rows), np.int64), lengths[row:stop]
        row = stop


# --- texts that travel ---------------------------------------------------------------
def _packed(batches):
    pack = zstandard.ZstdCompressor(level=1).compress
    for batch in batches:
        yield pa.record_batch(
            [batch.column(0), pa.array([pack(text) for text in raw_texts(batch.column(1))], pa.binary())], ["doc", "text"]
        )


def packed_texts(docs: DataFrame) -> DataFrame:
    """``docs`` with compressed texts: they are moved once, to meet their runs and again their spans."""
    return docs.mapInArrow(_packed, "doc long not null, text binary")  # not null: no filter sets the two reads apart


def unpacked(texts: pa.Array) -> Iterator[bytes]:
    unpack = zstandard.ZstdDecompressor().decompress
    return (unpack(text) for text in raw_texts(texts))


# --- 1: runs whose anchor occurs more than once ---------------------------------------
def _runs(windows: Windows):
    def find(batches):
        for batch in batches:
            docs = np.asarray(batch.column(0))
            for rows, offsets, lengths, units in windows.hashed(batch.column(1), windows.size):
                found = anchored_runs(units, lengths, windows.size, windows.gram)
                if found is None:
                    continue
                piece, first, run, distance, anchor = found
                members = np.empty(len(piece), _MEMBER)
                members["doc"] = docs[rows[piece]]
                members["start"] = offsets[piece] + first
                members["info"] = run | (distance << 8)
                order = np.argsort(anchor, kind="stable")
                anchor = anchor[order]
                heads = np.flatnonzero(np.append(True, anchor[1:] != anchor[:-1]))
                ends = np.append(heads, len(anchor)) * _MEMBER.itemsize
                yield pa.record_batch(
                    [pa.array(anchor[heads]), binaries(members[order].view(np.uint8), ends)], ["v", "members"]
                )

    return find


def _repeated(split_over: int):
    def told(members: np.ndarray, hot: np.ndarray):
        info = members["info"]
        return pa.record_batch(
            [
                pa.array(members["doc"]), pa.array(members["start"]),
                pa.array(np.where(hot, info | _HOT, info).astype(np.int32)),
            ],
            ["doc", "start", "info"],
        )

    def find(batches):
        held_v, held = np.zeros(0, np.int64), np.zeros(0, _MEMBER)
        flowing = None  # the anchor whose bucket is already known to be hot
        for batch in batches:
            ends, data = utf8(batch.column(1))
            members = np.frombuffer(data[ends[0] : ends[-1]].tobytes(), _MEMBER)
            v = np.repeat(np.asarray(batch.column(0)), np.diff(ends) // _MEMBER.itemsize)
            if flowing is not None:
                more = int(np.searchsorted(v, flowing, side="right"))
                if more:
                    yield told(members[:more], np.ones(more, bool))
                v, members = v[more:], members[more:]
                if not len(v):
                    continue
                flowing = None
            v, members = np.append(held_v, v), np.append(held, members)
            heads = np.flatnonzero(np.append(True, v[1:] != v[:-1]))
            sizes = np.diff(np.append(heads, len(v)))
            if sizes[-1] > split_over:
                flowing, cut = v[-1], len(v)
            else:
                cut, sizes = heads[-1], sizes[:-1]
            held_v, held = v[cut:], members[cut:]
            size = np.repeat(sizes, sizes)
            keep = size > 1
            if keep.any():
                yield told(members[:cut][keep], (size > split_over)[keep])
        if len(held_v) > 1:
            yield told(held, np.zeros(len(held_v), bool))

    return find


def repeated_runs(docs: DataFrame, windows: Windows, split_over: int) -> DataFrame:
    """(doc, start, info) of every run whose anchor occurs at least twice in the corpus."""
    runs = docs.mapInArrow(_runs(windows), "v long, members binary")
    dealt = runs.repartition("v").sortWithinPartitions("v")
    return dealt.mapInArrow(_repeated(split_over), "doc long, start int, info int")


# --- 2: cut the runs out and send them to their buckets -----------------------------------
def _segments(windows: Windows):
    size = windows.size

    def flush(first: dict, later: list, spread: int):
        if first:
            keys, values = list(first.keys()), list(first.values())
            yield pa.record_batch(
                [
                    pa.array([key[0] for key in keys], pa.int64()),
                    pa.array([value[2] for value in values], pa.int32()),
                    pa.array([key[1] for key in keys], pa.binary()),
                    pa.array([value[0] for value in values], pa.int64()),
                    pa.array([value[1] for value in values], pa.int32()),
                ],
                ["v", "at", "packed", "doc", "start"],
            )
        if later:
            spans = np.array(later, _SPAN)
            yield pa.record_batch(
                [
                    pa.array([spread], pa.int64()), pa.array([-1], pa.int32()), pa.array([spans.tobytes()], pa.binary()),
                    pa.array([0], pa.int64()), pa.array([0], pa.int32()),
                ],
                ["v", "at", "packed", "doc", "start"],
            )

    def cut(batches):
        first: dict[tuple[int, bytes], tuple[int, int, int]] = {}
        later: list[tuple[int, int, int]] = []
        weight = 0
        for batch in batches:
            docs = np.asarray(batch.column(0)).tolist()
            runs = batch.column(2)
            ends = runs.offsets.to_numpy().tolist()
            flat = runs.values
            starts = np.asarray(flat.field("start")).tolist()
            infos = np.asarray(flat.field("info")).tolist()
            for row, text in enumerate(unpacked(batch.column(1))):
                piece, doc = windows.cutter(text), docs[row]
                for k in range(ends[row], ends[row + 1]):
                    start, info = starts[k], infos[k]
                    n, at = info & 255, (info >> 8) & 255
                    if info & _HOT:
                        whole = []
                        for j in range(n):
                            packed = piece(start + j, size)
                            whole.append(((xxhash.xxh64_intdigest(packed) - (1 << 63), packed), (doc, start + j, 0), size))
                    else:
                        anchor = xxhash.xxh64_intdigest(piece(start + at, windows.gram)) - (1 << 63)
                        whole = [((anchor, piece(start, n + size - 1)), (doc, start, at), n + size - 1)]
                    for key, value, units in whole:
                        known = first.get(key)
                        if known is None:
                            first[key] = value
                            weight += len(key[1]) + 200
                        elif known[:2] == value[:2]:
                            continue
                        else:
                            if value[:2] < known[:2]:
                                first[key], known = value, first[key]
                            else:
                                known = value
                            later.append((known[0], known[1], units))
                            weight += 120
                if weight > FLUSH:
                    yield from flush(first, later, xxhash.xxh64_intdigest(text) - (1 << 63))
                    first, later, weight = {}, [], 0
        yield from flush(first, later, len(later))

    return cut


# --- 3: judge buckets ------------------------------------------------------------------------
def joined(spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Touching or overlapping (doc, start, units) as one."""
    out: list[list[int]] = []
    for doc, start, n in sorted(spans):
        if out and out[-1][0] == doc and start <= out[-1][1] + out[-1][2]:
            out[-1][2] = max(out[-1][2], start + n - out[-1][1])
        else:
            out.append([doc, start, n])
    return [tuple(span) for span in out]


def _covered(windows: Windows):
    def settle(rows: list[tuple[int, int, bytes, int, int]]) -> Iterator[pa.RecordBatch]:
        """Whole buckets: merge equal strings, then let the method judge those that differ."""
        spans: list[tuple[int, int, int]] = []
        first: dict[tuple[int, bytes], tuple[int, int, int]] = {}
        for v, at, packed, doc, start in rows:
            known = first.get((v, packed))
            if known is None:
                first[v, packed] = (doc, start, at)
            elif known[:2] != (doc, start):
                if (doc, start) < known[:2]:
                    first[v, packed], late = (doc, start, at), known
                else:
                    late = (doc, start, at)
                units = packed.count(b" ") + 1 if windows.cutter is word_cutter else len(packed)
                spans.append((late[0], late[1], units))
        sizes: dict[int, int] = {}
        for v, _ in first:
            sizes[v] = sizes.get(v, 0) + 1
        mixed_keys = [key for key in first if sizes[key[0]] > 1]
        if mixed_keys:
            values = [first[key] for key in mixed_keys]
            spans += windows.judge(
                [key[0] for key in mixed_keys], [value[2] for value in values], [key[1] for key in mixed_keys],
                [value[0] for value in values], [value[1] for value in values], windows.size,
            )
        if spans:
            found = np.array(joined(spans), _SPAN)
            yield pa.record_batch(
                [pa.array(found["doc"]), pa.array(found["start"]), pa.array(found["n"])], ["doc", "start", "n"]
            )

    def find(batches):
        held: list[tuple[int, int, bytes, int, int]] = []
        for batch in batches:
            rows = list(zip(*[batch.column(i).to_pylist() for i in range(5)]))
            passed = [row[2] for row in rows if row[1] < 0]
            for spans in passed:
                found = np.frombuffer(spans, _SPAN)
                yield pa.record_batch(
                    [pa.array(found["doc"]), pa.array(found["start"]), pa.array(found["n"])], ["doc", "start", "n"]
                )
            rows = held + ([row for row in rows if row[1] >= 0] if passed else rows)
            if not rows:
                continue
            cut = len(rows) - 1
            while cut > 0 and rows[cut - 1][0] == rows[-1][0]:
                cut -= 1
            held = rows[cut:]
            yield from settle(rows[:cut])
        yield from settle(held)

    return find


def covered(docs: DataFrame, windows: Windows, split_over: int) -> DataFrame:
    """Each document (``doc``, ``text`` compressed) with ``spans``: (start, n) of units in repeated windows, or null.

    A window is repeated if it also starts earlier. ``docs`` holds ``doc`` (no nulls)
    and ``text``. Rows with the same ``doc`` are the same document. Texts are moved
    once: both joins read the same exchange.
    """
    by_doc = (
        repeated_runs(docs, windows, split_over)
        .groupBy("doc")
        .agg(F.collect_list(F.struct("start", "info")).alias("runs"))
    )
    texts = packed_texts(docs)
    cut = texts.join(by_doc, "doc").mapInArrow(
        _segments(windows), "v long, at int, packed binary, doc long, start int"
    )
    spans = cut.repartition("v").sortWithinPartitions("v").mapInArrow(_covered(windows), "doc long, start int, n int")
    gathered = spans.groupBy("doc").agg(F.collect_list(F.struct("start", "n")).alias("spans"))
    return texts.join(gathered, "doc", "left")


def marked(starts: np.ndarray, sizes: np.ndarray, length: int) -> np.ndarray:
    """Which of ``length`` units the spans cover."""
    edges = np.zeros(length + 1, np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, np.minimum(starts + sizes, length), -1)
    return np.cumsum(edges[:-1]) > 0


def spans_by_row(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray] | None]:
    present = column.is_valid().to_pylist()
    ends = column.offsets.to_numpy()
    starts, sizes = np.asarray(column.values.field("start")), np.asarray(column.values.field("n"))
    for row, there in enumerate(present):
        a, b = ends[row], ends[row + 1]
        yield (starts[a:b].astype(np.int64), sizes[a:b].astype(np.int64)) if there and b > a else None


# --- units -------------------------------------------------------------------------------------
class _WordHashes(dict):
    """Hash of each word, remembered; forgets all when it has become large."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 400_000:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


_WORDS = _WordHashes()


def hashed_words(texts: pa.Array, size: int):
    """Words of many rows as hashed units. Rows are split one chunk at a time."""

    def told(rows, codes):
        lengths = np.array([len(code) for code in codes], np.int64)
        units = np.concatenate(codes)
        done = 0
        for local, offsets, long in chunked(lengths, size):
            if offsets[0]:
                begin = int(np.sum(lengths[: local[0]])) + int(offsets[0])
            else:
                begin = int(np.sum(lengths[: local[0]]))
            done = begin + int(long.sum())
            yield np.array(rows)[local], offsets, long, units[begin:done]

    rows, codes, weight = [], [], 0
    ends, data = utf8(texts)
    for row, (a, b) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist())):
        words = data[a:b].tobytes().split()
        if len(words) < size:
            continue
        rows.append(row)
        codes.append(np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words)))
        weight += len(words)
        if weight >= CHUNK // 4:
            yield from told(rows, codes)
            rows, codes, weight = [], [], 0
    if rows:
        yield from told(rows, codes)


def word_cutter(text: bytes):
    words = text.split()
    return lambda start, units: b" ".join(words[start : start + units])


def hashed_bytes(texts: pa.Array, size: int):
    ends, data = utf8(texts)
    lengths = np.diff(ends)
    for rows, offsets, long in chunked(lengths, size):
        begin = int(ends[rows[0]] + offsets[0])
        yield rows, offsets, long, BYTE_CODES[data[begin : begin + int(long.sum())]]


def byte_cutter(text: bytes):
    return lambda start, units: text[start : start + units]
