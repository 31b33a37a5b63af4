"""Corpus pipeline: quality rules, near duplicates, secrets, mixing, packing.

``STAGES`` lists ``(name, function)``; each function takes ``(spark, docs,
sf_dir)`` and returns a DataFrame, which is written as Parquet and read again as
the next stage's ``docs``. All but the last return the columns of documents;
the last returns the pieces of the packed sequences.
"""

from __future__ import annotations

import os
import sys
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from sigeval.llm import jaccard, mixing, packing, quality, secrets  # noqa: E402
from sigeval.llm.common import discard, materialize, recording  # noqa: E402
from sigeval.session import read_table  # noqa: E402


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return quality.kept_documents(docs, read_table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays (five words, 0.8)."""
    return jaccard.distinct_documents(docs, words=5, percent=80)


def secret_scans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are masked in the texts."""
    return secrets.redact(docs)


def mixing_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are drawn to the target weights."""
    return mixing.mixed(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed training sequences."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2)


_LEFT: dict[str, list[str]] = {}     # application -> scratch tables of the stage before


def _stage(fn):
    """A stage starts when the one before it has been written, so the scratch tables
    of that one have no reader left and go."""
    @wraps(fn)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        app = spark.sparkContext.applicationId
        discard(spark, *_LEFT.pop(app, []))
        with recording() as made:
            out = fn(spark, docs, sf_dir)
        _LEFT[app] = made
        return out
    return run_stage


STAGES = [(name, _stage(fn)) for name, fn in (
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("secret_scans", secret_scans),
    ("mixing_weights", mixing_weights),
    ("packing", packed),
)]
# tokenizing and similarity joins have no SQL form; see tests/llm
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
