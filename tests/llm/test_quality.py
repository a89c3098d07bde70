import random

from pyspark.sql import functions as F

from massmap.llm import quality
from tests.llm import brute

SCHEMA = "doc_id long, text string, source string, kept string"


def rows():
    draw = random.Random(1)
    words = ["the", "a", "größe", "x", "é#", "|", "of", "longer-than-ten-letters"] + [f"w{i}" for i in range(60)]
    docs = []
    for doc in range(120):
        text = "".join(draw.choice(words) + draw.choice([" ", " ", " ", "\n", "\t", "\x0b", "  "]) for _ in range(draw.randint(0, 160)))
        if doc % 6 == 0:
            text += text
        docs.append((doc, text, f"host{doc % 5}", "clash"))
    docs += [(200, None, None, None), (201, "", None, None), (202, "a b a b a b " * 3000, "host1", None), (202, "a b a b a b " * 3000, "host1", None)]
    docs += [(300 + i, "| # | # " * 30 + " ".join(f"u{i}x{j}" for j in range(60)), "junk", None) for i in range(30)]
    docs += [(400, " ".join(f"clean{j}" for j in range(80)), "junk", None)]
    return docs


def test_figures_match_brute_force(spark):
    docs = rows()
    got = quality.measured(spark.createDataFrame(docs, SCHEMA)).select("doc_id", "quality.*").collect()
    assert len(got) == len(docs)
    expected = {doc: brute.quality(text) for doc, text, _, _ in docs}
    for row in got:
        assert (row.n_words, row.word_chars, row.n_symbols, row.n_dup_lines, row.n_repeat_words) == expected[row.doc_id]


def test_hosts_are_shrunk_and_judged(spark):
    frame = spark.createDataFrame(rows(), SCHEMA)
    scored = quality.measured(frame)
    hosts = {r.host: r for r in quality.host_verdicts(scored).collect()}
    total = sum(r.docs for r in hosts.values())
    mean = sum(r.failed_symbols for r in hosts.values()) / total
    spread = sum(r.docs * (r.failed_symbols / r.docs - mean) ** 2 for r in hosts.values()) / total
    between = spread - mean * (1 - mean) * len(hosts) / total
    weight = max(mean * (1 - mean) / between - 1, 10)
    for row in hosts.values():
        assert abs(row.rate_symbols - (row.failed_symbols + mean * weight) / (row.docs + weight)) < 1e-9
    assert "symbols" in hosts["junk"].rejected_for
    done = {r.doc_id: r for r in quality.host_rules(frame).collect()}
    assert not any(done[300 + i].kept for i in range(30)) and done[400].kept
    assert not done[200].kept and done[200].base_failed
    assert all(r.kept != r.base_failed for r in done.values() if not r.bad_host)


def test_one_document_does_not_condemn_its_host(spark):
    good = " ".join(f"word{j}" for j in range(80))
    docs = [(i, good, f"h{i % 4}", None) for i in range(400)] + [(999, "# " * 40 + good, "lonely", None)]
    done = {r.doc_id: r.kept for r in quality.host_rules(spark.createDataFrame(docs, SCHEMA)).collect()}
    assert done[1] and done[999] is True


def test_empty_table(spark):
    frame = spark.createDataFrame([(1, "x", "y", "z")], SCHEMA).limit(0)
    assert quality.host_rules(frame).count() == 0
    assert quality.digest(frame).count() == 0


def test_no_python_in_the_plan(spark):
    frame = spark.createDataFrame(rows(), SCHEMA)
    plan = quality.host_rules(frame)._jdf.queryExecution().executedPlan().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))
    assert quality.host_rules(frame).select(F.count("*")).first()[0] == len(rows())
