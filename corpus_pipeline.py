"""A corpus made ready for training: five stages over the documents table.

Each stage works on everything its predecessor kept, and its decisions take effect.
All but the last return documents (the columns of the table); the last returns the
packed pieces.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from massmap.llm import jaccard, lines, mixing, packing, quality
from massmap.llm.common import own_id
from massmap.session import written

#: Near duplicates share so much of their five-word shingles (Jaccard).
SHINGLE, SIMILARITY = 5, 0.8
#: Fingerprints up to so many bits apart are candidates, besides the documents that share a band of min-hashes.
RADIUS = 6


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules or the rules of a bad host reject go."""
    return quality.host_rules(docs).where("kept").select(docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated line runs go from the texts; every document stays."""
    done = lines.dedup_lines(docs)
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return done.select(docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays.

    A text that line dedup has left without a word is a copy as a whole; such texts
    have the same empty set of shingles, so one of them stays.
    """
    groups = jaccard.near_duplicates(docs, shingle=SHINGLE, least=SIMILARITY, radius=RADIUS)
    kept = groups.where("doc = component").select(own_id().alias("__kept"))
    return docs.join(kept, F.col("doc_id").eqNullSafe(F.col("__kept")), "left_semi")


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    done = mixing.mix(docs).where("copies > 0")
    return done.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(docs.columns)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("SimHash near-dedup", near_duplicates),
    ("source mixing", source_mixing),
    ("best-fit packing", best_fit_packing),
]

#: Fingerprints, multipliers and the search for fillings are not SQL; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        docs = written(stage(spark, docs, sf_dir), f"stage{number}")
    return docs
