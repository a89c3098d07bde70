"""Substring dedup by super-k-mers: repeated runs of words are removed where they come later.

Consecutive word windows that share a minimiser travel as one packed string (a
super-k-mer) to the bucket of that minimiser. Inside a bucket the windows are
sorted, so equal ones lie side by side and every occurrence but the earliest is
a repeat. Nothing is approximate: hashes only decide where strings meet, and
words are compared.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from massmap.llm import repeats
from massmap.llm.common import keyed, own_id


def judge_by_sorting(anchors, distances, packed, docs, starts, size):
    """Sort the windows of each bucket; all but the earliest of equal ones are repeats."""
    by_bucket: dict[int, list[int]] = {}
    for at, anchor in enumerate(anchors):
        by_bucket.setdefault(anchor, []).append(at)
    late = []
    for members in by_bucket.values():
        found = []
        for at in members:
            words, doc, start = packed[at].split(b" "), docs[at], starts[at]
            found += [
                (b" ".join(words[j : j + size]), doc, start + j) for j in range(len(words) - size + 1)
            ]
        found.sort()
        kept = (None, None, None)
        for window in found:
            if window[0] != kept[0]:
                kept = window
            elif window != kept:
                late.append((window[1], window[2], size))
    return late


def word_windows(size: int, minimiser: int) -> repeats.Windows:
    return repeats.Windows(
        size, minimiser, repeats.hashed_words, repeats.word_cutter, judge_by_sorting
    )


def _kept(batches):
    for batch in batches:
        counts, removed, kept, runs = [], [], [], []
        for text, spans in zip(repeats.unpacked(batch.column(1)), repeats.spans_by_row(batch.column(2))):
            words = text.split()
            counts.append(len(words))
            if spans is None:
                removed.append(0)
                kept.append(b" ".join(words))
                runs.append([])
                continue
            gone = repeats.marked(*spans, len(words))
            edges = np.flatnonzero(np.diff(np.concatenate(([0], gone.view(np.int8), [0]))))
            removed.append(int(gone.sum()))
            kept.append(b" ".join([word for word, out in zip(words, gone.tolist()) if not out]))
            runs.append([{"start": int(a), "n": int(b - a)} for a, b in zip(edges[::2], edges[1::2])])
        yield pa.record_batch(
            [
                batch.column(0), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()),
                pa.array(kept, pa.binary()).cast(pa.string()),
                pa.array(runs, pa.list_(pa.struct([("start", pa.int64()), ("n", pa.int64())]))),
            ],
            ["doc", "n_words", "n_removed", "kept_text", "removed"],
        )


def dedup_substrings(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, size: int = 20, minimiser: int = 6,
    split_over: int = 4096,
) -> DataFrame:
    """Remove each word covered by a window of ``size`` words that also starts earlier.

    Earlier means a smaller id, or an earlier start in the same document; windows
    are judged on the input. Returns one row per input row: the id, ``n_words``,
    ``n_removed``, ``kept_text`` (kept words joined by one space) and ``removed``
    (word spans). Other columns are not read, so their names cannot clash.

    A null or empty text has no words. A null id is a document of its own that
    comes first. Rows with the same id are one document, returned as often as it
    came. A document shorter than a window loses nothing. An empty table gives an
    empty result.
    """
    texts = keyed(docs, id_col, text_col)
    done = repeats.covered(texts, word_windows(size, minimiser), split_over).mapInArrow(
        _kept, "doc long, n_words long, n_removed long, kept_text string, removed array<struct<start:long,n:long>>"
    )
    return done.select(own_id().alias(id_col), "n_words", "n_removed", "kept_text", "removed")


def digest(done: DataFrame) -> DataFrame:
    return done.select(
        "doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text"), 256).alias("kept_sha256")
    )
