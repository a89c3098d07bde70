import random
from collections import Counter, defaultdict

import corpus_pipeline as P
import public_tokenizers
from tokenizers import Tokenizer

from tests.llm import brute
from tests.llm.test_jaccard import grouped
from tests.llm.test_mixing import brute_targets

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents():
    draw = random.Random(8)
    words = [f"wort{i}" for i in range(3000)]

    def text(n):
        parts = [draw.choice(words) + draw.choice([" ", " ", " ", " ", "\n"]) for _ in range(n)]
        return "".join(parts).strip()

    rows = [(i, text(draw.randint(60, 400)), "de", f"src{i % 4}") for i in range(60)]
    rows += [(100 + i, rows[i][1], "de", "src1") for i in range(10)]  # exact copies
    for i in range(10):  # near copies: one word of many, line by line so that line dedup leaves something
        parts = rows[20 + i][1].split(" ")
        parts[len(parts) // 2] = "anders"
        rows.append((200 + i, " ".join(parts).replace("\n", " "), "de", "src2"))
    rows += [(300, "too short", "de", "src0"), (301, None, None, None), (302, "", "de", "src0"), (303, "a b " * 300, "de", "src0")]
    rows += [(304, text(3000), "de", None)]
    return [(*row, len(row[1] or "")) for row in rows]


def test_every_stage_against_plain_python(spark, tmp_path):
    docs = documents()
    frame = spark.createDataFrame(docs, SCHEMA)
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    # quality rules: no host fails often here, so the base rules decide
    kept = P.quality_rules(spark, frame, "").collect()
    figures = {doc: brute.quality(text) for doc, text, *_ in docs}
    assert {r.doc_id for r in kept} == {d for d, f in figures.items() if f[0] >= 50 and 100 * f[4] <= 50 * f[0]}
    held = spark.createDataFrame(kept, SCHEMA)
    # line dedup
    lined = P.line_dedup(spark, held, "").collect()
    expected = brute.lines_left([(r.doc_id, r.text) for r in kept])
    assert {r.doc_id: r.text for r in lined} == {doc: text for doc, (_, _, text) in expected.items()}
    assert all(r.n_chars == len(r.text) for r in lined)
    # near duplicates
    held = spark.createDataFrame(lined, SCHEMA)
    single = P.near_duplicates(spark, held, "").collect()
    groups = grouped({r.doc_id: r.text for r in lined}, P.SIMILARITY)
    assert {r.doc_id for r in single} == {doc for doc, first in groups.items() if doc == first}
    assert len(single) < len(lined)
    # mixing: whole copies, each source near its target
    held = spark.createDataFrame(single, SCHEMA)
    mixed = P.source_mixing(spark, held, "").collect()
    copies = Counter(r.doc_id for r in mixed)
    texts = {r.doc_id: r for r in single}
    assert max(copies.values()) <= 2 and all(texts[r.doc_id] == r for r in mixed)
    sizes, taken, largest = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in single:
        n = len(r.text.split())
        sizes[r.source] += n
        taken[r.source] += n * copies[r.doc_id]
        largest[r.source] = max(largest[r.source], n)
    for source, target in brute_targets(sizes).items():
        assert abs(taken[source] - target) <= 0.51 * largest[source] + 1
    # packing
    packed = P.best_fit_packing(spark, spark.createDataFrame(mixed, SCHEMA), "").collect()
    encode = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")).encode
    lengths = {doc: len(encode(r.text, add_special_tokens=False).ids) + 1 for doc, r in texts.items()}
    total = Counter()
    rooms = defaultdict(list)
    for r in packed:
        total[r.doc_id] += r.length
        rooms[r.sequence_id].append((r.offset, r.length))
    assert total == Counter({doc: lengths[doc] * n for doc, n in copies.items()})
    for room in rooms.values():
        ends = [0]
        for offset, length in sorted(room):
            assert offset == ends[-1]
            ends.append(offset + length)
        assert ends[-1] <= 1024
    # the stages one after the other
    whole = P.run(spark, str(tmp_path)).collect()
    assert sum(r.length for r in whole) == sum(total.values()) and Counter(r.doc_id for r in whole).keys() == total.keys()


def test_stages_keep_the_columns_and_take_an_empty_table(spark):
    frame = spark.createDataFrame(documents()[:0], SCHEMA)
    for name, stage in P.STAGES[:-1]:
        out = stage(spark, frame, "")
        assert out.columns == frame.columns and out.count() == 0, name
    assert P.STAGES[-1][1](spark, frame, "").count() == 0
