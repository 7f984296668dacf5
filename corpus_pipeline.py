"""The corpus pipeline: toxicity, near-duplicates, repeated strings, benchmark passages, then the mix.

Each stage takes all documents that the stage before it kept and returns documents; the last returns the
mix, in which a document stands as often as it is taken.
"""

from __future__ import annotations

import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tidemark.llm import decontaminate, minhash, mixing, suffix, toxicity  # noqa: E402
from tidemark.llm.common import cut  # noqa: E402


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored 0.5 or more go."""
    return toxicity.drop_toxic(docs, _table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: five-word shingles, similarity 0.8 or more."""
    return minhash.keep_one(docs, shingle=5, percent=80)


#: Bytes of a repeated string that goes: a passage of fifty words has hardly less.
PASSAGE_BYTES = 200


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes covered by a repeated string of ``PASSAGE_BYTES`` go; n_chars follows the text."""
    out = suffix.remove_repeated(docs, PASSAGE_BYTES)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth of the words stand in benchmark windows go."""
    return decontaminate.drop_contaminated(docs, _table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target takes it."""
    return mixing.mix(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash_near_dedup", near_dedup),
    ("suffix_dedup", suffix_dedup),
    ("decontaminate", drop_contaminated),
    ("mix_sources", mix),
]

#: Toxicity is learned and repeated strings are judged byte by byte; SQL can say neither.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs = _table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
