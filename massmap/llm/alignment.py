"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes.

Where both tokenizers end a token at the same byte, a group ends. Inside a document
both sides are arrays of token ends. While groups are one token to one token, the end
arrays are equal at a fixed index shift, a diagonal. Such a run is measured by
comparing slices of doubling length at the current shift and, where a slice differs,
by halving it. The irregular group behind a run is resolved token by token, and the
shift is set anew.

How often two ids are linked is counted over the whole corpus. What a document needs
back are the counts of its own pairs. Pairs that hold at least one of ``HEAD`` links
of the corpus are at most ``HEAD`` pairs; they are broadcast. No other pair can hold
more than that share, so the rest is joined by pair without a hot key.
"""

from __future__ import annotations

import hashlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from massmap.llm.common import keyed, own_id, raw_texts
from massmap.llm.packing import _PLAIN, Encoder, _byte_marks
from massmap.session import written

#: Pairs with at least this part of all links are looked up by broadcast: at most so many rows.
HEAD = 1 << 16


# --- strings by number ----------------------------------------------------------------------
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.dtype("<u8"))  # the first k bytes of eight


class Spelled:
    """The byte strings of a vocabulary, eight bytes of each at a time."""

    def __init__(self, strings: list[bytes]):
        self.sizes = np.array([len(string) for string in strings], np.int64)
        self.parts, longest = [], max(map(len, strings), default=0)
        for at in range(0, longest, 8):
            self.parts.append(np.frombuffer(b"".join(string[at : at + 8].ljust(8, b"\0") for string in strings), "<u8"))

    def ends(self, ids: np.ndarray, text: bytes) -> np.ndarray | None:
        """Where each string ends in the text, which is all of them one after another; None if it is not."""
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        if (ends[-1] if len(ends) else 0) != len(text):
            return None
        padded, at = text + bytes(8), ends - sizes
        seen = np.ndarray(len(text) + 1, "<u8", padded, strides=(1,))  # eight bytes from each place on
        for part in self.parts:
            if ((seen[at] ^ part[ids]) & _MASKS[np.minimum(sizes, 8)]).any():
                return None
            longer = np.flatnonzero(sizes > 8)
            if not len(longer):
                break
            ids, at, sizes = ids[longer], at[longer] + 8, sizes[longer] - 8
        return ends


# --- tokenizers ---------------------------------------------------------------------------
class ByteLevel(Encoder):
    """A byte-level vocabulary file; strings of special tokens inside a text are plain text."""

    def __init__(self, path: str):
        super().__init__(path)
        self.tokenizer.encode_special_tokens = True
        self.cut = None
        marks = _byte_marks()
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.bytes = [
            bytes(marks[c] for c in token) if set(token) <= set(marks) else token.encode()
            for token in (self.tokenizer.id_to_token(k) or "" for k in range(size))
        ]
        self.spelled = Spelled(self.bytes)

    def ids(self, text: str) -> np.ndarray:
        raw = array("I", self.fast(text)).tobytes() if self.fast and not _PLAIN.search(text) else self.whole(text)
        return np.frombuffer(raw, np.uint32).astype(np.int64)


class Pieces:
    """A sentence-piece model; it puts a space before the text by itself."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes = []
        for number in range(self.model.get_piece_size()):
            piece = self.model.id_to_piece(number)
            if len(piece) == 6 and piece.startswith("<0x") and piece.endswith(">"):
                self.bytes.append(bytes([int(piece[3:5], 16)]))
            else:
                self.bytes.append(piece.replace("▁", " ").encode())
        self.spelled = Spelled(self.bytes)

    def ids(self, text: str) -> np.ndarray:
        return self.model.encode_as_numpy(text).astype(np.int64)


_LOADED: dict[tuple[type, str], ByteLevel | Pieces] = {}


def loaded(kind: type, path: str):
    if (kind, path) not in _LOADED:
        _LOADED[kind, path] = kind(path)
    return _LOADED[kind, path]


# --- one document ---------------------------------------------------------------------------
_WIDE = 8  # bytes of an end
_NEAR = 16  # so many ends are compared one by one before slices are


def equal_run(a: bytes, b: bytes, i: int, j: int, most: int) -> int:
    """How many of ``most`` ends agree from ``i`` and ``j`` on (all counted in bytes).

    Probes of doubling length, then halving in the last one.
    """
    done, step = 0, 4 * _WIDE
    while done < most:
        step = min(step, most - done)
        if a[i + done : i + done + step] != b[j + done : j + done + step]:
            break
        done += step
        step *= 2
    else:
        return done
    same, differ = 0, step // _WIDE  # so many ends agree behind `done`, so many do not
    while differ - same > 1:
        half = (same + differ) // 2
        if a[i + done + same * _WIDE : i + done + half * _WIDE] == b[j + done + same * _WIDE : j + done + half * _WIDE]:
            same = half
        else:
            differ = half
    return done + same * _WIDE


def inner_ends(a: np.ndarray, b: np.ndarray) -> tuple[list[int], list[int]]:
    """Per side the indexes of tokens that end inside a group; every other token ends one.

    Both arrays ascend and end with the same number. One-to-one stretches are skipped
    on the diagonal; only irregular groups are walked token by token.
    """
    raw_a, raw_b = a.astype(np.int64).tobytes(), b.astype(np.int64).tobytes()
    a, b = a.tolist(), b.tolist()
    inner_a, inner_b, i, j, size_a, size_b = [], [], 0, 0, len(a), len(b)
    while i < size_a:
        near = min(i + _NEAR, size_a, i + size_b - j)
        while i < near and a[i] == b[j]:
            i += 1
            j += 1
        if i == near:  # the run may go on, and for long
            if i == size_a:
                break
            run = equal_run(raw_a, raw_b, _WIDE * i, _WIDE * j, _WIDE * min(size_a - i, size_b - j)) // _WIDE
            i, j = i + run, j + run
            continue
        end_a, end_b = a[i], b[j]
        while end_a != end_b:
            if end_a < end_b:
                inner_a.append(i)
                i += 1
                end_a = a[i]
            else:
                inner_b.append(j)
                j += 1
                end_b = b[j]
        i, j = i + 1, j + 1
    return inner_a, inner_b


class Aligned:
    """Two token sequences of the same bytes."""

    def __init__(self, ids_a: np.ndarray, ids_b: np.ndarray, ends_a: np.ndarray, ends_b: np.ndarray):
        self.ids_a, self.ids_b, self.ends_a, self.ends_b = ids_a, ids_b, ends_a, ends_b
        inner_a, inner_b = inner_ends(ends_a, ends_b)
        self.last_a, self.last_b = np.ones(len(ids_a), bool), np.ones(len(ids_b), bool)
        self.last_a[inner_a] = False
        self.last_b[inner_b] = False
        self.n_groups = len(ids_a) - len(inner_a)

    def links(self) -> tuple[np.ndarray, np.ndarray]:
        """Index pairs of tokens whose byte ranges overlap: one for each byte where either side ends a token."""
        size = int(self.ends_a[-1]) + 1
        is_a, is_b = np.zeros(size, bool), np.zeros(size, bool)
        is_a[self.ends_a], is_b[self.ends_b] = True, True
        at = np.flatnonzero(is_a | is_b)
        return np.cumsum(is_a)[at] - is_a[at], np.cumsum(is_b)[at] - is_b[at]

    def pairs(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """Distinct linked ids as ``a * width + b``, ascending, and how many links hold each."""
        at_a, at_b = self.links()
        keys = self.ids_a[at_a] * width + self.ids_b[at_b]
        keys.sort()
        new = np.ones(len(keys), bool)
        np.not_equal(keys[1:], keys[:-1], out=new[1:])
        firsts = np.flatnonzero(new)
        return keys[firsts], np.diff(firsts, append=len(keys))

    def told(self, words_a: np.ndarray, words_b: np.ndarray) -> str:
        """Groups as text. ``words_*``: per id its number with a comma, then per id with the mark behind a group's last."""
        groups_a, groups_b = np.cumsum(self.last_a) - self.last_a, np.cumsum(self.last_b) - self.last_b
        behind_a = np.flatnonzero(self.last_a) + 1  # tokens of A up to the end of each group
        behind_b = np.concatenate([[0], np.flatnonzero(self.last_b) + 1])
        out = np.empty(len(self.ids_a) + len(self.ids_b), words_a.dtype)
        out[np.arange(len(self.ids_a)) + behind_b[groups_a]] = words_a[self.ids_a + self.last_a * (len(words_a) // 2)]
        out[np.arange(len(self.ids_b)) + behind_a[groups_b]] = words_b[self.ids_b + self.last_b * (len(words_b) // 2)]
        return out.tobytes().translate(None, b"\0")[:-1].decode()


def words(size: int, mark: str) -> np.ndarray:
    """Numbers with a comma, then with ``mark``, each in eight bytes that zeros fill up."""
    told = [f"{k},".encode() for k in range(size)] + [f"{k}{mark}".encode() for k in range(size)]
    return np.frombuffer(b"".join(word.ljust(8, b"\0") for word in told), np.uint64)


def align(text: str | None, a: ByteLevel, b: Pieces) -> Aligned | None:
    """None for a text without tokens: null, empty, or not the same bytes on both sides."""
    if not text:
        return None
    ids_a, ids_b = a.ids(" " + text), b.ids(text)
    whole = (" " + text).encode()
    ends_a, ends_b = a.spelled.ends(ids_a, whole), b.spelled.ends(ids_b, whole)
    return None if ends_a is None or ends_b is None else Aligned(ids_a, ids_b, ends_a, ends_b)


# --- the corpus -------------------------------------------------------------------------------
_KIND = "doc long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<int>"


def _aligned(path_a: str, path_b: str):
    kinds = [pa.int64()] * 5 + [pa.string(), pa.list_(pa.int64()), pa.list_(pa.int32())]
    names = ["doc", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"]

    def batch_of(rows):
        return pa.record_batch([pa.array(column, kind) for column, kind in zip(zip(*rows), kinds)], names)

    def find(batches):
        a, b = loaded(ByteLevel, path_a), loaded(Pieces, path_b)
        width = len(b.bytes)
        words_a, words_b = words(len(a.bytes), "|"), words(width, ";")
        for batch in batches:
            rows, held = [], 0
            for doc, raw in zip(batch.column(0).to_pylist(), raw_texts(batch.column(1))):
                done = align(raw.decode("utf-8", "replace"), a, b)
                if done is None:
                    rows.append((doc, 0, 0, 0, 0, "", [], []))
                    continue
                keys, times = done.pairs(width)
                digest = hashlib.sha256(done.told(words_a, words_b).encode()).hexdigest()
                rows.append((doc, len(done.ids_a), len(done.ids_b), done.n_groups, int(times.sum()), digest, keys, times.astype(np.int32)))
                held += len(keys)
                if held > 500_000:
                    yield batch_of(rows)
                    rows, held = [], 0
            if rows:
                yield batch_of(rows)

    return find


def pair_counts(links: DataFrame, width: int) -> DataFrame:
    """Per pair its links in the corpus, ``n``, and ``best``: whether no pair of its B id has more."""
    counts = written(links.groupBy("pair").agg(F.sum("times").alias("n")), "pairs").withColumn("b", F.expr(f"pair % {width}"))
    # one row per B id, so never more than the vocabulary has
    highest = F.broadcast(counts.groupBy("b").agg(F.max("n").alias("highest")))
    return counts.join(highest, "b").select("pair", "n", (F.col("n") == F.col("highest")).alias("best"))


def align_tokens(
    docs: DataFrame, tokenizer_a: str, tokenizer_b: str, id_col: str = "doc_id", text_col: str = "text", *, head: int = HEAD
) -> DataFrame:
    """Align the tokens of a byte-level and a sentence-piece tokenizer in every document.

    Per document: the id, ``n_a``, ``n_b``, ``n_groups``, ``n_links``, ``n_best`` (links whose pair
    has the most links in the corpus of all pairs with the same B id, ties included),
    ``count_sum`` (links of the corpus that hold the pair, summed over the document's
    links) and ``groups_sha256``. ``head`` sets only how pairs are looked up.

    A text that is null, empty or does not come back from both tokenizers byte by byte
    with a space before it has no tokens: zeros, and an empty ``groups_sha256``. Null ids
    stay null. Repeated rows are documents of their own and count as often as they came.
    A document is aligned in one piece however long it is, in time that its tokens
    bound; its pairs are one row of the written table. Other columns are not read, so
    their names cannot clash. An empty table gives an empty result.
    """
    from sentencepiece import SentencePieceProcessor

    width = SentencePieceProcessor(model_file=tokenizer_b).get_piece_size()
    done = keyed(docs, id_col, text_col).mapInArrow(_aligned(tokenizer_a, tokenizer_b), _KIND)
    done = written(done.withColumn("row", F.monotonically_increasing_id()), "aligned")
    links = done.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("link")).select("row", "link.pairs", "link.times")
    links = links.withColumnRenamed("pairs", "pair")
    counts = written(pair_counts(links.select("pair", "times"), width), "counts")
    total = counts.agg(F.sum("n").alias("n")).first().n or 0
    frequent = F.col("n") * head >= total
    known = F.broadcast(counts.where(frequent))  # at most `head` pairs can hold that share
    rare = links.join(known.select("pair"), "pair", "left_anti").join(counts.where(~frequent), "pair")
    found = [
        part.groupBy("row").agg(
            F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum")
        )
        for part in (links.join(known, "pair"), rare)
    ]
    facts = ["doc", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    rows = done.select("row", F.struct(*facts).alias("facts"))
    for part in found:
        rows = rows.unionByName(part, allowMissingColumns=True)
    whole = rows.groupBy("row").agg(
        F.max("facts").alias("facts"), F.coalesce(F.sum("n_best"), F.lit(0)).alias("n_best"),
        F.coalesce(F.sum("count_sum"), F.lit(0)).alias("count_sum"),
    )
    return whole.select("facts.*", "n_best", "count_sum").select(
        own_id().alias(id_col), "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"
    )
