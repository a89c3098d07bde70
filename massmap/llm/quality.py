"""Host-level quality rules.

Rules are judged on every document; their failures are added up per host, the
rates are shrunk towards what hosts usually have by an empirical beta prior, and
the verdict on the host goes back to its documents: on a host that keeps failing
a rule, a document is only kept if it fails no rule itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from massmap.llm.common import HAS_WORD, once, words_of
from massmap.session import written

SYMBOLS = "#*$%&|<>"
FIGURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]
#: Rules of the contract's base; a document that fails one is rejected whatever its host is like.
BASE_RULES = ["too_short", "repetitive"]
#: Rules that one document may fail on a good host.
HOST_RULES = ["symbols", "duplicate_lines", "word_length"]


def _windows(words: Column) -> Column:
    """A hash for every three consecutive words (64 bits; equal windows are told apart within one text only)."""
    return F.when(
        F.size(words) >= 3,
        F.transform(
            F.sequence(F.lit(0), F.size(words) - 3),
            lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)),
        ),
    ).otherwise(F.array().cast("array<bigint>"))


def _words_covered(windows: Column) -> Column:
    """Words in windows that occur at least twice: sort the windows, keep equal neighbours, join their places."""
    ordered = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def repeated(s: Column) -> Column:
        same_before = lambda k: F.coalesce(F.get(s, k - 1)["h"] == F.get(s, k)["h"], F.lit(False))
        places = F.transform(
            F.sequence(F.lit(0), F.size(s) - 1),
            lambda k: F.when(same_before(k) | same_before(k + 1), F.get(s, k)["i"]),
        )
        return F.sort_array(F.filter(places, lambda place: place.isNotNull()))

    def covered(p: Column) -> Column:
        return F.aggregate(
            F.sequence(F.lit(1), F.size(p)),
            F.lit(3).cast("bigint"),
            lambda total, k: total
            + F.when(k < F.size(p), F.least(F.lit(3), F.get(p, k) - F.get(p, k - 1))).otherwise(0),
        )

    return once(once(ordered, repeated), covered)


def _repeat_words(words: Column) -> Column:
    return once(
        _windows(words),
        lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), _words_covered(h)).otherwise(F.lit(0)),
    )


def figures(text: Column) -> Column:
    """A struct of FIGURES for one text; a null text counts as empty."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda line: line.rlike(HAS_WORD))
    of_words = once(
        words_of(text),
        lambda words: F.struct(
            F.size(words).alias("n"), F.length(F.array_join(words, "")).alias("chars"), _repeat_words(words).alias("again")
        ),
    )
    of_lines = once(lines, lambda kept: F.struct(F.size(kept).alias("n"), F.size(F.array_distinct(kept)).alias("own")))
    parts = once(
        F.struct(of_words.alias("w"), of_lines.alias("l")),
        lambda p: F.struct(
            p["w"]["n"].cast("bigint").alias("n_words"),
            p["w"]["chars"].cast("bigint").alias("word_chars"),
            (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
            p["l"]["n"].cast("bigint").alias("n_lines"),
            (p["l"]["n"] - p["l"]["own"]).cast("bigint").alias("n_dup_lines"),
            p["w"]["again"].cast("bigint").alias("n_repeat_words"),
        ),
    )
    return parts


def rules(
    figure: Column, *, min_words: int = 50, repeat_pct: int = 50, symbol_pct: int = 10, dup_line_pct: int = 30,
    word_chars: tuple[int, int] = (3, 10),
) -> dict[str, Column]:
    """Failed rules as booleans, by name."""
    n = figure["n_words"]
    return {
        "too_short": n < min_words,
        "repetitive": 100 * figure["n_repeat_words"] > repeat_pct * n,
        "symbols": 100 * figure["n_symbols"] > symbol_pct * n,
        "duplicate_lines": 100 * figure["n_dup_lines"] > dup_line_pct * figure["n_lines"],
        "word_length": (figure["word_chars"] < word_chars[0] * n) | (figure["word_chars"] > word_chars[1] * n),
    }


def measured(docs: DataFrame, text_col: str = "text", **limits) -> DataFrame:
    """``docs`` with a struct ``quality``: FIGURES and one boolean per rule."""
    with_figures = docs.withColumn("quality", figures(F.col(text_col)))
    figure = F.col("quality")
    return with_figures.withColumn(
        "quality",
        F.struct(
            *[figure[name].alias(name) for name in FIGURES],
            *[failed.alias(name) for name, failed in rules(figure, **limits).items()],
        ),
    )


def host_verdicts(
    quality_docs: DataFrame, host_col: str = "source", *, max_rate: float = 0.5, least_prior: float = 10.0
) -> DataFrame:
    """One row per host: documents, and for each rule the failures, the shrunk rate and whether it is too high.

    The prior of a rule is the beta distribution fitted to the hosts by moments: the
    mean is the rate over all documents, the variance is that of the hosts' rates
    (weighted by documents) less what chance alone would give hosts of their sizes.
    It counts as ``least_prior`` documents at least, so that a handful of documents
    never condemns a host; hosts that differ by chance only get the common rate. A
    null host is a host like any other.
    """
    names = BASE_RULES + HOST_RULES
    hosts = quality_docs.groupBy(F.col(host_col).alias("host")).agg(
        F.count(F.lit(1)).alias("docs"),
        *[F.sum(F.col("quality")[name].cast("bigint")).alias(f"failed_{name}") for name in names],
    )
    hosts = written(hosts, "hosts")
    docs = F.col("docs")
    moments = hosts.agg(
        F.count(F.lit(1)).alias("hosts"), F.sum("docs").alias("docs"),
        *[F.sum(f"failed_{name}").alias(f"failed_{name}") for name in names],
        *[F.sum(F.col(f"failed_{name}") * F.col(f"failed_{name}") / docs).alias(f"square_{name}") for name in names],
    ).first()
    out = hosts
    for name in names:
        total = moments["docs"] or 1
        mean = (moments[f"failed_{name}"] or 0) / total
        chance = mean * (1 - mean)
        between = (moments[f"square_{name}"] or 0.0) / total - mean * mean - chance * moments["hosts"] / total
        if between > 0:
            weight = max(chance / between - 1, least_prior)
            shrunk = (F.col(f"failed_{name}") + mean * weight) / (docs + weight)
        else:
            shrunk = F.lit(mean)
        out = out.withColumn(f"rate_{name}", shrunk)
    too_high = [F.when(F.col(f"rate_{name}") > max_rate, F.lit(name)) for name in names]
    return out.withColumn("rejected_for", F.array_compact(F.array(*too_high)))


def judged(quality_docs: DataFrame, hosts: DataFrame, host_col: str = "source") -> DataFrame:
    """Join the verdicts on hosts back to their documents: adds ``failed``, ``base_failed``, ``bad_host``, ``kept``.

    Spark joins by broadcast if the verdicts are small by its own threshold and
    otherwise by sorting, where adaptive execution splits a host that is too large.
    """
    verdicts = hosts.select(F.col("host").alias("__host"), (F.size("rejected_for") > 0).alias("__bad"))
    joined = quality_docs.join(verdicts, F.col(host_col).eqNullSafe(F.col("__host")), "left")
    quality = F.col("quality")
    failed = F.array_compact(F.array(*[F.when(quality[name], F.lit(name)) for name in BASE_RULES + HOST_RULES]))
    out = joined.withColumn("failed", failed)
    out = out.withColumn("base_failed", quality["too_short"] | quality["repetitive"])
    out = out.withColumn("bad_host", F.coalesce(F.col("__bad"), F.lit(False)))
    kept = ~F.col("base_failed") & ~(F.col("bad_host") & (F.size("failed") > 0))
    return out.withColumn("kept", kept).drop("__host", "__bad")


def host_rules(
    docs: DataFrame, text_col: str = "text", host_col: str = "source", *, max_rate: float = 0.5, **limits
) -> DataFrame:
    """``docs`` with ``quality``, ``failed`` (rules), ``base_failed``, ``bad_host`` and ``kept``.

    Columns of these names in the input are replaced; all others stay. A null or
    empty text has no words and is too short. A null host is a host of its own.
    Repeated rows are documents of their own. An empty table gives an empty result.
    Texts are read twice, for the hosts and for the answer, but never shuffled.
    """
    scored = measured(docs, text_col, **limits)
    return judged(scored, host_verdicts(scored, host_col, max_rate=max_rate), host_col)


def digest(docs: DataFrame) -> DataFrame:
    """The contract's columns. Texts are measured once: only figures and hosts go on."""
    scored = written(measured(docs.select("doc_id", "text", "source")).drop("text"), "quality")
    done = judged(scored, host_verdicts(scored))
    quality = F.col("quality")
    return done.select(
        "doc_id", *[quality[name].alias(name) for name in FIGURES if name != "n_lines"], "base_failed", "kept"
    )
