"""Helpers that several operators share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Between words: the six ASCII spaces. ``bytes.split()`` breaks at the same six.
WORD_BREAK = r"[\x20\x09-\x0D]+"
HAS_WORD = r"[^\x20\x09-\x0D]"
#: What a null identifier is called while rows are matched; it sorts before all others.
NULL_ID = -(2**63)


def once(value: Column, use) -> Column:
    """Evaluate ``value`` once per row and hand it to a lambda, which may read it for every element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def words_of(text: Column) -> Column:
    """The words of a text as an array; a null text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), WORD_BREAK, -1), lambda word: word != "")


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only what matching needs: ``doc`` without nulls, and ``text``."""
    return docs.select(
        F.coalesce(F.col(id_col).cast("bigint"), F.lit(NULL_ID)).alias("doc"), F.col(text_col).alias("text")
    )


def own_id(key: str = "doc") -> Column:
    return F.when(F.col(key) != F.lit(NULL_ID), F.col(key))


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a column of texts without copying; null texts are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, b"" if pa.types.is_binary(texts.type) or pa.types.is_large_binary(texts.type) else "")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    if not len(texts):
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    ends = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1]
    return ends.astype(np.int64), np.frombuffer(data or b"", np.uint8)


def raw_texts(texts: pa.Array) -> list[bytes]:
    """Each text as UTF-8 bytes; null texts are empty."""
    ends, data = utf8(texts)
    whole = data.tobytes() if len(ends) > 1 else b""
    return [whole[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]


def binaries(pieces: np.ndarray, ends: np.ndarray) -> pa.Array:
    """A binary column over one buffer: value i is pieces[ends[i] : ends[i + 1]]."""
    return pa.BinaryArray.from_buffers(
        pa.binary(), len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(pieces))]
    )
