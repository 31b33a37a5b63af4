"""Registered queries of the corpus operators, and their DuckDB SQL."""

from __future__ import annotations

import corpus_pipeline
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import read_table
from . import conversation_repair, fixity, hnsw, jaccard, licenses, lm_score, mixing, packing, pieces, quality, secrets, spelling, token_output

QUERIES: dict = {}
ORACLES: dict = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output.token_output(read_table(spark, sf_dir, "documents"),
                                     public_tokenizers.path("byte_bpe_50k.json"), end_id=2)


@query
def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score(read_table(spark, sf_dir, "documents"))


@query
def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(read_table(spark, sf_dir, "documents"))


@query
def op4_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_duplicates(read_table(spark, sf_dir, "documents"), words=4, percent=85)


@query
def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


ORACLES["op5_quality"] = quality.oracle()


@query
def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read_table(spark, sf_dir, "documents"))


@query
def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"),
                        public_tokenizers.path("word_bpe_49k.json"), end_id=2)


@query
def op8_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = read_table(spark, sf_dir, "embeddings")
    return hnsw.nearest(table, table.where(F.col("vec_id") % 50 == 0), k=5)


@query
def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.sample(read_table(spark, sf_dir, "documents"))


@query
def op10_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The archive of all pages against a replica in which one byte of some
    records' first line has changed."""
    spoiled = F.expr("concat(substr(record, 1, page_id % 8), '#', substr(record, page_id % 8 + 2))")
    return fixity.audit_damage(read_table(spark, sf_dir, "pages"), F.col("page_id") % 97 == 13, spoiled)


ORACLES["op10_fixity"] = fixity.oracle()


@query
def op11_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digests(pieces.encode_documents(read_table(spark, sf_dir, "documents"),
                                                  public_tokenizers.path("piece_bpe_32k.model"), end_id=2))


@query
def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.occurrences(read_table(spark, sf_dir, "documents")))


@query
def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_repair.repair(conversation_repair.damage(read_table(spark, sf_dir, "conversations")))


@query
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf_dir)
