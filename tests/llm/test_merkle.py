import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from massmap.llm import merkle

KIND = "doc_id long, source string, lang string, n_chars long, text string"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    told = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    return h(*map(told, row))


def tree(leaves):
    """The root, and per leaf its (before, after) from the bottom up, by definition."""
    places = list(range(len(leaves)))
    proofs = [[] for _ in leaves]
    level = list(leaves)
    while len(level) > 1:
        for number, place in enumerate(places):
            run = place // 3
            proofs[number].append(("".join(level[3 * run : place]), "".join(level[place + 1 : 3 * run + 3])))
        level = [h(*level[i : i + 3]) for i in range(0, len(level), 3)]
        places = [place // 3 for place in places]
    return level[0], proofs


def expected(rows):
    groups = {}
    for row in rows:
        groups.setdefault(row[1], []).append(row)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    subs = {}
    for name in names:
        held = sorted(groups[name], key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        subs[name] = (held, *tree([leaf(r) for r in held]))
    root, tops = tree([subs[name][1] for name in names])
    out = []
    for name, top in zip(names, tops):
        held, sub, proofs = subs[name]
        for row, proof in zip(held, proofs):
            steps = proof + top
            told = row
            if row[0] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0 and row[4] is not None:
                told = (*row[:4], row[4].replace("\n", ""))
            folded = leaf(told)
            for before, after in steps:
                folded = h(before, folded, after)
            out.append((row[0], leaf(row), sub, root, h(*[b + a for b, a in steps]), folded, folded == root))
    return sorted(out, key=repr)


def got(spark, rows):
    docs = spark.createDataFrame(rows, KIND).withColumn("block", F.lit(1)).withColumn("node", F.lit("x"))
    done = merkle.digest(merkle.manifest(docs, altered=merkle.tampered(docs)))
    return sorted(map(tuple, done.collect()), key=repr)


def test_against_definition(spark):
    rows = [(i, f"s{i % 2}" if i % 3 else "hot", "en", i, "a\nb" * (i % 4)) for i in range(700)]
    rows += [(None, None, None, None, None), (None, None, None, None, ""), (-5, "", "ü", -1, "\n"), (7, "ß", "x", 3, "ß\n" * 40_000)]
    rows += [rows[5], rows[5], (5, rows[5][1], "fr", 5, "other")]
    assert got(spark, rows) == expected(rows)


def test_tree_shapes(spark):
    rows = [(i, f"{n}", "en", 0, "") for n in (1, 2, 3, 4, 9, 10, 243, 244, 245, 730) for i in range(n)]
    assert got(spark, rows) == expected(rows)


@pytest.mark.parametrize("n", [1, 4])
def test_one_group(spark, n):
    rows = [(i, "only", "en", 0, "") for i in range(n)]
    assert got(spark, rows) == expected(rows)


def test_many_groups_and_small_blocks(spark, monkeypatch):
    monkeypatch.setattr(merkle, "DIGITS", 2)
    rows = [(i, f"g{i % 95}" if i % 4 else "g0", "en", i, "t\n") for i in range(900)]
    assert got(spark, rows) == expected(rows)


def test_empty_table(spark):
    assert got(spark, []) == []


def test_other_fields_and_a_changed_row(spark):
    docs = spark.createDataFrame([(1, "a", "x"), (2, "a", "y"), (3, None, "z")], "k long, g string, v string")
    done = merkle.manifest(docs, ["k", "v"], "k", "g", altered={"v": F.when(F.col("k") == 2, "w").otherwise(F.col("v"))})
    held = {r.k: r.ok for r in done.select("k", (merkle.fold(F.col("claimed"), F.col("proof")) == F.col("root")).alias("ok")).collect()}
    assert held == {1: True, 2: False, 3: True}
