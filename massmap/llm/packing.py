"""Best-fit packing: documents into token sequences of a fixed length.

Documents become token ids where they are read; only longer ones are cut. The
sizes of what must be packed form a histogram of at most ``length`` entries, on
which a branch and bound over bin completions decides the fillings. Documents are
then numbered within their size and look up their sequence and offset in the
slots of that size: no document passes through the driver.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from massmap.llm import binpack
from massmap.llm.common import keyed, own_id, raw_texts
from massmap.llm.places import numbered
from massmap.session import written

LENGTH = 1024
END = 2
#: Letters, digits and marks on which the pre-tokenizer's Unicode classes are beyond doubt.
_PLAIN = re.compile(r"[^\t\n\r\x20-\x7E\xA1-ɏ]")
_BLOCKS = 512


def _byte_marks() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: itself if visible, else the next unused."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [byte for byte in range(256) if byte not in visible]
    return {chr(byte): byte for byte in visible} | {chr(256 + k): byte for k, byte in enumerate(hidden)}


def _ranks(path: str) -> dict[bytes, int] | None:
    """Byte strings by id if the file's ids are its merge order, as the fast encoder takes them for granted."""
    with open(path, encoding="utf-8") as file:
        model = json.load(file)["model"]
    marks = _byte_marks()
    merges = model.get("merges") or []
    merged = ["".join(pair) if isinstance(pair, list) else pair.replace(" ", "") for pair in merges]
    ids = [model["vocab"].get(token, -1) for token in merged]
    if model.get("type") != "BPE" or ids != list(range(256, 256 + len(ids))):
        return None
    tokens = [token for token, number in model["vocab"].items() if number < 256 + len(ids)]
    if not all(set(token) <= set(marks) for token in tokens):
        return None
    return {bytes(marks[c] for c in token): model["vocab"][token] for token in tokens}


class Encoder:
    """Ids of a byte-level tokenizer file.

    Ordinary text goes through a faster encoder that is built from the ranks of the
    same file and gives the same ids; text with other characters, on whose classes
    two Unicode versions might differ, is encoded by the tokenizer itself.
    """

    def __init__(self, path: str):
        import tiktoken
        from public_tokenizers import PATTERN
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = {
            token.content: number for number, token in self.tokenizer.get_added_tokens_decoder().items()
        }
        marks = "|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))
        self.cut = re.compile(f"({marks})").split if marks else None
        ranks = _ranks(path)
        self.fast = ranks and tiktoken.Encoding(
            "ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}
        ).encode_ordinary

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def ids(self, text: str) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if not self.fast or _PLAIN.search(text):
            return self.whole(text)
        if not any(mark in text for mark in self.special):
            return array("I", self.fast(text)).tobytes()
        ids = array("I")
        for part in self.cut(text):
            ids.extend([self.special[part]] if part in self.special else self.fast(part))
        return ids.tobytes()


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def _pieces(path: str, length: int, keep_ids: bool):
    end = np.uint32(END).astype("<u4").tobytes()

    def find(batches):
        encode = encoder(path)
        for batch in batches:
            docs = batch.column(0).to_pylist()
            rows: list[tuple] = []
            for doc, text in zip(docs, raw_texts(batch.column(1))):
                ids = encode.ids(text.decode("utf-8", "replace")) + end
                total = len(ids) // 4
                first = total % length or length
                cuts = [0, *range(first, total + 1, length)]
                for piece, (a, b) in enumerate(zip(cuts, cuts[1:])):
                    part = ids[4 * a : 4 * b]
                    rows.append((doc, piece, a, b - a, zlib.crc32(part), part if keep_ids else None))
                if len(rows) > 20_000:
                    yield _batch(rows)
                    rows = []
            if rows:
                yield _batch(rows)

    return find


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
    names = ["doc", "piece", "start", "length", "ids_crc32", "ids"]
    return pa.record_batch([pa.array(column, kind) for column, kind in zip(zip(*rows), kinds)], names)


def slots(plan: binpack.Plan) -> dict[int, list[tuple[int, int, int, int, int]]]:
    """Per size: (first place, places, first sequence, items per sequence, offset of the first)."""
    out: dict[int, list[tuple[int, int, int, int, int]]] = {}
    sequence = 0
    taken: dict[int, int] = {}
    for filling, bins in plan:
        offset = 0
        for size, each in filling:
            low = taken.get(size, 0)
            out.setdefault(size, []).append((low, each * bins, sequence, each, offset))
            taken[size] = low + each * bins
            offset += each * size
        sequence += bins
    return out


def pack(
    docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", *, length: int = LENGTH,
    keep_ids: bool = False,
) -> DataFrame:
    """Pack documents into as few sequences of at most ``length`` tokens as the search finds.

    A document is its ids and an end token. Only a longer one is cut: its first
    piece takes the remainder and all others are full. Returns per piece: the id,
    ``piece`` (from 0), ``start``, ``length``, ``ids_crc32``, ``sequence_id`` and
    ``offset`` in it; with ``keep_ids`` also ``ids`` (little-endian 32-bit). Offsets
    of a sequence are gapless. Other columns are not read, so their names cannot
    clash.

    A null or empty text is just its end token; a null id stays null. Repeated rows
    are packed as often as they came. An empty table gives an empty result. The
    collected histogram has at most ``length`` rows and the joined slots one row
    per size, however large the corpus is.
    """
    spark = docs.sparkSession
    pieces = keyed(docs, id_col, text_col).mapInArrow(
        _pieces(tokenizer, length, keep_ids), "doc long, piece int, start long, length long, ids_crc32 long, ids binary"
    )
    if not keep_ids:
        pieces = pieces.drop("ids")
    pieces = written(pieces, "pieces")
    histogram = {row.length: row.n for row in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    found = slots(binpack.complete(histogram, length))
    table = spark.createDataFrame(
        [(size, [tuple(slot) for slot in of_size]) for size, of_size in found.items()],
        "length long, slots array<struct<low:long,places:long,sequence:long,each:long,offset:long>>",
    )
    placed = numbered(
        pieces, ["length"], [F.col("doc"), F.col("piece")], [F.col(c) for c in ("doc", "piece", "start", "ids_crc32")], _BLOCKS, "place"
    )
    # one row per size, so never more than `length` rows
    seated = placed.join(F.broadcast(table), "length").withColumn(
        "slot",
        F.get(
            F.filter("slots", lambda s: (s["low"] <= F.col("place")) & (F.col("place") < s["low"] + s["places"])),
            F.lit(0),
        ),
    )
    inside = F.col("place") - F.col("slot.low")
    kept = ["ids"] if keep_ids else []
    return seated.select(
        own_id().alias(id_col), "piece", "start", "length", "ids_crc32",
        (F.col("slot.sequence") + F.floor(inside / F.col("slot.each"))).cast("bigint").alias("sequence_id"),
        (F.col("slot.offset") + F.pmod(inside, F.col("slot.each")) * F.col("length")).cast("bigint").alias("offset"),
        *kept,
    )
