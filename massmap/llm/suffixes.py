"""Suffix-array dedup: repeated byte strings are removed where they come later.

The suffix array is sparse: only suffixes at anchors are sorted, since equal
strings of ``size`` bytes have the same anchor at the same distance. In each
bucket the suffixes that start at the anchor, and the reversed texts before it,
are merge-sorted; two are compared by binary search for their longest common
extension over prefix polynomial hashes, a logarithmic number of hash
comparisons instead of a byte-by-byte one. Every extension that the finished
order relies on is then verified on the bytes; a bucket with a hash collision is
sorted again by its bytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from massmap.llm import repeats
from massmap.llm.common import keyed, own_id


class Suffixes:
    """Strings side by side in one buffer with the prefix hashes that compare them."""

    def __init__(self, strings: list[bytes]):
        self.strings = strings
        self.sizes = np.array([len(s) for s in strings], np.int64)
        self.begins = np.cumsum(self.sizes) - self.sizes
        self.data = np.frombuffer(b"".join(strings), np.uint8)
        self.sums = repeats.prefix_hashes(repeats.BYTE_CODES[self.data])
        self.powers = repeats.powers(len(self.data) + 1)
        self.steps = [1 << k for k in reversed(range(int(self.sizes.max(initial=0)).bit_length()))]

    def extension(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Longest common prefix of each pair, by binary search on hashes."""
        sa, sb = self.begins[a], self.begins[b]
        limit = np.minimum(self.sizes[a], self.sizes[b])
        ha, hb, pa_, pb = self.sums[sa], self.sums[sb], self.powers[sa], self.powers[sb]
        got = np.zeros(len(a), np.int64)
        for step in self.steps:
            wanted = got + step
            fits = wanted <= limit
            capped = np.where(fits, wanted, 0)
            same = (self.sums[sa + capped] - ha) * pb == (self.sums[sb + capped] - hb) * pa_
            got = np.where(fits & same, wanted, got)
        return got

    def next_byte(self, at: np.ndarray, l: np.ndarray) -> np.ndarray:  # noqa: E741
        """The byte after the first l, or -1 at the end: a prefix sorts before what it begins."""
        ended = l >= self.sizes[at]
        where = np.where(ended, 0, self.begins[at] + l)
        return np.where(ended, -1, self.data[where].astype(np.int64) if len(self.data) else -1)

    def less(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        common = self.extension(a, b)
        return self.next_byte(a, common) < self.next_byte(b, common)

    def merge_sorted(self, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Order within each group (given as adjacent equal numbers) and the extension to the one before.

        All groups are merged at once: in round w every element finds its place
        among the w elements of the run beside its own.
        """
        n = len(group)
        heads = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        sizes = np.diff(np.append(heads, n))
        begin, size = np.repeat(heads, sizes), np.repeat(sizes, sizes)
        order = np.arange(n)
        run = 1
        while run < sizes.max():
            place = np.flatnonzero(size > run)
            inside = place - begin[place]
            mine = inside // run
            left = mine % 2 == 0
            sibling = begin[place] + (mine ^ 1) * run
            low = np.minimum(sibling, begin[place] + size[place])
            high = np.minimum(sibling + run, begin[place] + size[place])
            first = low.copy()
            own = order[place]
            while True:
                open_ = np.flatnonzero(low < high)
                if not len(open_):
                    break
                middle = (low[open_] + high[open_]) // 2
                other, is_left = order[middle], left[open_]
                a, b = np.where(is_left, other, own[open_]), np.where(is_left, own[open_], other)
                after = self.less(a, b) == is_left
                low[open_] = np.where(after, middle + 1, low[open_])
                high[open_] = np.where(after, high[open_], middle)
            target = begin[place] + (mine // 2) * 2 * run + inside % run + (low - first)
            merged = order.copy()
            merged[target] = own
            order = merged
            run *= 2
        common = np.zeros(n, np.int64)
        common[1:] = self.extension(order[:-1], order[1:])
        common[heads] = -1
        return self._verified(order, common, heads, sizes)

    def _verified(self, order, common, heads, sizes):
        """Hold every neighbour against its bytes; sort a group by its bytes if a hash has lied."""
        inner = np.flatnonzero(common >= 0)
        a, b, l = order[inner - 1], order[inner], common[inner]  # noqa: E741
        right = self.next_byte(a, l) <= self.next_byte(b, l)
        ended = (self.next_byte(a, l) == -1) & (self.next_byte(b, l) == -1)
        right &= ended | (self.next_byte(a, l) != self.next_byte(b, l))
        widest = int(l.max(initial=0))
        if widest:
            reach = np.arange(widest)
            for at in range(0, len(inner), 4096):
                cut = slice(at, at + 4096)
                used = reach[None, :] < l[cut, None]
                last = len(self.data) - 1
                x = self.data[np.minimum(self.begins[a[cut], None] + reach, last)]
                y = self.data[np.minimum(self.begins[b[cut], None] + reach, last)]
                right[cut] &= ~((x != y) & used).any(axis=1)
        for group in np.unique(np.searchsorted(heads, inner[~right], side="right") - 1):
            at = slice(heads[group], heads[group] + sizes[group])
            exact = sorted(order[at].tolist(), key=lambda i: self.strings[i])
            order[at] = exact
            for k in range(1, len(exact)):
                x, y = self.strings[exact[k - 1]], self.strings[exact[k]]
                same = 0
                while same < min(len(x), len(y)) and x[same] == y[same]:
                    same += 1
                common[heads[group] + k] = same
        return order, common


def _classes(order: np.ndarray, common: np.ndarray, least: int) -> np.ndarray:
    """Number of the interval of the suffix array that shares ``least`` bytes, per suffix."""
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(common < least)
    return number


def judge_by_suffixes(anchors, distances, packed, docs, starts, size):
    """Windows at distance o before the anchor are equal if they share size - o bytes after it and o before it."""
    group = np.array(anchors, np.int64)
    by_group = np.argsort(group, kind="stable")
    group = group[by_group]
    texts = [packed[i] for i in by_group]
    at = np.array(distances, np.int64)[by_group]
    doc = np.array(docs, np.int64)[by_group]
    start = np.array(starts, np.int64)[by_group]
    after = Suffixes([text[a:] for text, a in zip(texts, at.tolist())])
    before = Suffixes([text[:a][::-1] for text, a in zip(texts, at.tolist())])
    after_order, after_common = after.merge_sorted(group)
    before_order, before_common = before.merge_sorted(group)
    n = len(texts)
    earliest = np.lexsort((start + at, doc))
    widest = int(at.max())
    late = np.zeros((n, widest + 2), bool)
    for o in range(widest + 1):
        some = earliest[(at[earliest] >= o) & (after.sizes[earliest] >= size - o)]
        if len(some) < 2:
            continue
        pair = _classes(after_order, after_common, size - o)[some] * (n + 1)
        pair += _classes(before_order, before_common, o)[some]
        _, first, back = np.unique(pair, return_index=True, return_inverse=True)
        kept = some[first][back]
        late[some, o] = (doc[some] != doc[kept]) | (start[some] + at[some] != start[kept] + at[kept])
    edges = np.diff(np.concatenate((np.zeros((n, 1), np.int8), late.view(np.int8)), axis=1), axis=1)
    row, near = np.nonzero(edges == 1)
    _, far = np.nonzero(edges == -1)
    first = start[row] + at[row] - (far - 1)
    return list(zip(doc[row].tolist(), first.tolist(), (far - 1 - near + size).tolist()))


def byte_windows(size: int, gram: int) -> repeats.Windows:
    return repeats.Windows(
        size, gram, repeats.hashed_bytes, repeats.byte_cutter, judge_by_suffixes
    )


def _kept(batches):
    for batch in batches:
        counts, removed, kept, runs = [], [], [], []
        for text, spans in zip(repeats.unpacked(batch.column(1)), repeats.spans_by_row(batch.column(2))):
            counts.append(len(text))
            if spans is None:
                removed.append(0)
                kept.append(text)
                runs.append([])
                continue
            gone = repeats.marked(*spans, len(text))
            edges = np.flatnonzero(np.diff(np.concatenate(([0], gone.view(np.int8), [0]))))
            removed.append(int(gone.sum()))
            kept.append(np.frombuffer(text, np.uint8)[~gone].tobytes())
            runs.append([{"start": int(a), "n": int(b - a)} for a, b in zip(edges[::2], edges[1::2])])
        yield pa.record_batch(
            [
                batch.column(0), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()),
                pa.array(kept, pa.binary()),
                pa.array(runs, pa.list_(pa.struct([("start", pa.int64()), ("n", pa.int64())]))),
            ],
            ["doc", "n_bytes", "n_removed", "kept", "removed"],
        )


def dedup_suffixes(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, size: int = 100, gram: int = 24,
    split_over: int = 4096,
) -> DataFrame:
    """Remove each byte covered by a ``size``-byte string that also starts earlier.

    Earlier means a smaller id, or an earlier start in the same document; strings
    are judged on the input, overlaps count and matches never cross documents.
    Returns one row per input row: the id, ``n_bytes``, ``n_removed``, ``kept``
    (the remaining bytes; a cut may fall inside a character, so it is binary) and
    ``removed`` (maximal byte spans). Other columns are not read, so their names
    cannot clash.

    A null or empty text has no bytes. A null id is a document of its own that
    comes first. Rows with the same id are one document, returned as often as it
    came. A document shorter than ``size`` loses nothing. An empty table gives an
    empty result.
    """
    texts = keyed(docs, id_col, text_col)
    done = repeats.covered(texts, byte_windows(size, gram), split_over).mapInArrow(
        _kept, "doc long, n_bytes long, n_removed long, kept binary, removed array<struct<start:long,n:long>>"
    )
    return done.select(own_id().alias(id_col), "n_bytes", "n_removed", "kept", "removed")


def digest(done: DataFrame) -> DataFrame:
    return done.select(
        "doc_id", "n_bytes", "n_removed", F.size("removed").cast("bigint").alias("n_spans"),
        F.sha2(F.col("kept"), 256).alias("kept_sha256"),
    )
