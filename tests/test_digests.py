import hashlib

import pytest

from catalog.sources import a1
from massmap.sources import corpus as S
from massmap.sources import digests as D

MOST = "spark.sql.sources.binaryFile.maxLength"


@pytest.fixture
def most(spark):
    """Sets the longest file that Spark's binary source reads whole."""
    yield lambda size: spark.conf.set(MOST, size)
    spark.conf.unset(MOST)


def put(folder, sizes):
    folder.mkdir(parents=True)
    for size in sizes:
        (folder / f"f {size}#?%20.bin").write_bytes(hashlib.shake_128(str(size).encode()).digest(size))


def digests(root):
    return {str(file.relative_to(root)): hashlib.sha256(file.read_bytes()).hexdigest() for file in root.rglob("*.bin")}


def test_listing_of_a_file_longer_than_a_task_reads(spark, tmp_path, most):
    put(tmp_path / "small", [1, 700])
    with open(tmp_path / "long.bin", "wb") as file:
        file.truncate(D.STEP)
        file.seek(0, 2)
        file.write(b"end")
    most(D.STEP)  # a content read whole fails beyond, as it always does beyond 2 GB
    rows = a1(spark, str(tmp_path)).collect()
    assert {row.path: row.blob for row in rows} == digests(tmp_path)
    assert {row.path: row.size for row in rows}["long.bin"] == D.STEP + 3


def test_digests_in_steps(spark, tmp_path, most):
    put(tmp_path / "at its ends", [1, 63, 64, 1023, 1024, 1025, 1088, 2047, 2048, 2049])
    put(tmp_path / "é" / "longer", [5000, 19 * 1024 + 1])
    most(1024)
    found = D.with_digest(S.read_tree(spark, str(tmp_path), "r", located=True), 1024)
    assert found.columns == ["repo", "path", "mode", "size", "blob"]
    rows = found.collect()
    assert {row.path: row.blob for row in rows} == digests(tmp_path) and len(rows) == 12


def test_step_counts_past_32_bits(tmp_path):
    place, size, step, state = tmp_path / "sparse.bin", (1 << 29) + 100, 1 << 28, None
    with open(place, "wb") as file:
        file.truncate(size)
    for at in (0, step, 2 * step, 3 * step):
        state = D.resumed(f"file:{place}", size, at, step, state)
    with open(place, "rb") as file:
        assert state.hex() == hashlib.file_digest(file, "sha256").hexdigest()


def test_a_changed_file_is_no_digest(tmp_path):
    put(tmp_path / "x", [2000])
    with pytest.raises(OSError, match="changed"):
        D.resumed(f"file:{tmp_path}/x/f 2000#?%20.bin", 3000, 1024, 1024, bytes(32))


def test_stores_that_give_no_parts_are_read_whole(spark, tmp_path, monkeypatch):
    put(tmp_path / "x", [100, 3000])
    monkeypatch.setattr(D, "_reachable", lambda location: False)
    rows = D.with_digest(S.read_tree(spark, str(tmp_path), "r", located=True), 1024).collect()
    assert {row.path: row.blob for row in rows} == digests(tmp_path)


def test_unknown_stores_are_not_reachable(tmp_path):
    put(tmp_path / "x", [3])
    assert D._reachable(f"file:{tmp_path}/x/f 3#?%20.bin")
    assert not D._reachable("nowhere://host/x")
