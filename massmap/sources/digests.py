"""SHA-256 of files of any length by tasks that each read one step of a file.

A SHA-256 is read from the first byte to the last, but what it knows after a step are
32 bytes. So the steps of a file run one after another, each in a task of its own that
takes these bytes from the one before, and the files run beside each other.
"""

from __future__ import annotations

import _hashlib
import ctypes
import ctypes.util
import functools
import re
import struct

from pyarrow import ArrowException
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from massmap.operators.ordered import ranked
from massmap.session import written

STEP = 128 << 20
_PIECE = 4 << 20
_ROUNDS_A_TABLE = 16


class _Context(ctypes.Structure):
    """``SHA256_CTX`` of openssl/sha.h; hashlib uses the same library but cannot resume."""

    _fields_ = [
        ("words", ctypes.c_uint32 * 8), ("low", ctypes.c_uint32), ("high", ctypes.c_uint32),
        ("data", ctypes.c_uint32 * 16), ("num", ctypes.c_uint), ("length", ctypes.c_uint),
    ]


@functools.cache
def _library() -> ctypes.CDLL | None:
    """The libcrypto that hashlib is linked to, else the machine's; None if neither can be reached."""
    for name in (getattr(_hashlib, "__file__", None), ctypes.util.find_library("crypto")):
        library = ctypes.CDLL(name) if name else None
        if hasattr(library, "SHA256_Update"):
            library.SHA256_Update.argtypes = [ctypes.c_void_p, ctypes.c_char_p, ctypes.c_size_t]
            return library
    return None


def _opened(location: str):
    scheme, authority, below = re.fullmatch(r"([^:/]+):(?://([^/]*))?/(.*)", location, re.S).groups()
    store, top = FileSystem.from_uri(f"{scheme}://{authority or ''}/")
    return store.open_input_file(f"{top.rstrip('/')}/{below}")


def _reachable(location: str) -> bool:
    """Whether parts of files can be read there; some stores only Spark reads, and only whole files."""
    try:
        with _opened(location):
            return True
    except (OSError, ValueError, ArrowException):
        return False


def resumed(location: str, size: int, at: int, step: int, state: bytes | None) -> bytes | None:
    """The state after the step that begins at ``at``, or the digest if the file ends in it.

    ``state`` are the eight words after the step before; steps are whole 64-byte blocks.
    Past the end of a file it is the digest already and stays.
    """
    if at >= size:
        return state
    library, context = _library(), _Context()
    library.SHA256_Init(ctypes.byref(context))
    if at:
        context.words[:] = struct.unpack(">8I", state)
        context.high, context.low = divmod(at * 8, 1 << 32)
    left = min(step, size - at)
    with _opened(location) as stream:
        if stream.size() != size:
            raise OSError(f"{location} changed while it was read")
        stream.seek(at)
        while left:
            piece = stream.read(min(left, _PIECE))
            if not piece:
                raise OSError(f"{location} changed while it was read")
            library.SHA256_Update(ctypes.byref(context), piece, len(piece))
            left -= len(piece)
    if at + step < size:
        return struct.pack(">8I", *context.words)
    digest = ctypes.create_string_buffer(32)
    library.SHA256_Final(digest, ctypes.byref(context))
    return digest.raw


def with_digest(tree: DataFrame, step: int = STEP) -> DataFrame:
    """A located tree with ``blob``, the SHA-256 of each whole file, instead of content and location.

    Files up to ``step`` bytes are read whole, packed into tasks by Spark. Longer ones
    take a round per step, in which every file that is not done has a task of its own.
    Where parts of files cannot be read, a file is read whole whatever its length.
    """
    if step % 64:
        raise ValueError("a step is a multiple of 64 bytes")
    longer = tree.where(F.col("size") > step).drop("content")
    # Not a row per file: stores are few, and lengths count in steps.
    lengths = longer.groupBy(F.substring_index("location", ":", 1).alias("scheme"), F.ceil(F.col("size") / step).alias("steps")).agg(
        F.count("*").alias("files"), F.min("location").alias("one")).collect()
    stores = {row.scheme: row.one for row in lengths}
    stepped = bool(stores) and _library() is not None and all(map(_reachable, stores.values()))
    # The bound reaches the file source, which then opens no longer file.
    whole = tree.where(F.col("size") <= step) if stepped else tree
    answer = whole.withColumn("blob", F.sha2("content", 256)).drop("content", "location")
    if not stepped:
        return answer

    @F.udf("binary")
    def carried(location, size, at, state):
        return resumed(location, size, at, step, state)

    # Longest first: the files that are open in a round are the first ones, one to a task.
    states = ranked(longer, [], [F.desc("size"), F.asc("location")], "place").withColumn(
        "state", F.lit(None).cast("binary"))
    states = written(states, "digests")
    for done in range(max(row.steps for row in lengths)):
        files = sum(row.files for row in lengths if row.steps > done)
        dealt = states.repartitionById(files, F.pmod(F.col("place"), F.lit(files)).cast("int"))
        states = dealt.withColumn("state", carried("location", "size", F.lit(done * step).cast("bigint"), "state"))
        if done % _ROUNDS_A_TABLE == _ROUNDS_A_TABLE - 1:
            states = written(states, "digests")
    found = states.withColumn("blob", F.lower(F.hex("state"))).drop("state", "place", "location")
    return answer.unionByName(found)
