"""Derived tables shared by the queries: encoded sequences, splits, the small
dictionaries, and deterministic reply tables standing in for model output.

All randomness is ``md5(seed:id)`` so Spark and DuckDB derive the same rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import features as X
from ..functions.hashing import seeded_bucket
from ..operators.encode import encode_sequences
from ..session import read_table


# ---------------------------------------------------------------- base tables
def seqs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, user_id, chunk, sequence) encoded from ``events``."""
    return encode_sequences(read_table(spark, sf_dir, "events"))


def split_of(id_col) -> Column:
    b = seeded_bucket("split", id_col, 10)
    out = None
    for name, lo, hi in K.SPLIT_BUCKETS:
        cond = b.between(lo, hi)
        out = F.when(cond, F.lit(name)) if out is None else out.when(cond, F.lit(name))
    return out


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encoded sequences with split, counted peaks and threshold label."""
    s = seqs(spark, sf_dir)
    return s.select(
        "id", "user_id", "chunk", "sequence",
        split_of(F.col("id")).alias("split"),
        X.total_peaks("sequence").alias("total_peaks"),
        X.label_by_threshold(X.total_peaks("sequence")).alias("label"),
    )


def label_ranges(spark: SparkSession) -> DataFrame:
    rows = [("in", c, lo, hi) for c, lo, hi in K.IN_RANGES] + \
           [("ood", c, lo, hi) for c, lo, hi in K.OOD_RANGES]
    return spark.createDataFrame(rows, "regime string, label string, lo bigint, hi bigint")


def classes(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(enumerate(K.CLASSES)), "ord bigint, label string")


# ---------------------------------------------------------------- replies
def reply_text(style: Column, seq: Column, true_label: Column) -> Column:
    """Deterministic stand-in for a model reply, by style 0..7."""
    nxt = X.next_class(true_label)
    payload = F.concat(
        F.lit('{"conceptos": {"C1_picos_estrechos": '), X.narrow_peaks(seq).cast("string"),
        F.lit(', "C2_picos_anchos": '), X.wide_peaks(seq).cast("string"),
        F.lit('}, "fc_clase": "'), true_label, F.lit('"}'))
    return (F.when(style == 0, X.target_json(seq, true_label))
            .when(style == 1, F.concat(F.lit("Counting the peaks first.\n```json\n"), payload,
                                       F.lit("\n```")))
            .when(style == 2, F.concat(F.lit("```\n"), payload, F.lit("\n```")))
            .when(style == 3, F.concat(F.lit("This strip looks "), F.lower(true_label),
                                       F.lit(" to me.")))
            .when(style == 4, X.target_json(seq, nxt))
            .when(style == 5, F.concat(F.lit("Either "), true_label, F.lit(" or "), nxt,
                                       F.lit(".")))
            .when(style == 6, F.concat(F.lit('{"Narrow_peaks": '),
                                       X.narrow_peaks(seq).cast("string"),
                                       F.lit(', "Label": ')))
            .otherwise(F.lit("")))


def with_replies(df: DataFrame, seed: Column | str = "resp", out: str = "raw_response") -> DataFrame:
    """Adds the deterministic reply for each row of ``df`` (needs id, sequence,
    label). ``seed`` may be a column (one seed per run)."""
    seed_col = F.lit(seed) if isinstance(seed, str) else seed
    key = F.md5(F.concat(seed_col, F.lit(":"), F.col("id")))
    style = F.pmod(F.conv(F.substring(key, 1, 8), 16, 10).cast("bigint"), F.lit(8))
    return df.withColumn(out, reply_text(style, F.col("sequence"), F.col("label")))


def responses(spark: SparkSession, sf_dir: str, seed: str = "resp") -> DataFrame:
    return with_replies(labelled(spark, sf_dir), seed).select("id", "raw_response")


# ---------------------------------------------------------------- choice task
def choice_name(label) -> Column:
    lab = F.col(label) if isinstance(label, str) else label
    return F.try_element_at(F.array(*[F.lit(n) for n in K.CHOICE_NAMES]), (lab + 1).cast("int"))


def alt_name(name) -> Column:
    """``X: name`` -> ``(X) name``."""
    n = F.col(name) if isinstance(name, str) else name
    return F.concat(F.lit("("), F.replace(n, F.lit(": "), F.lit(") ")))


def choice_replies(emb: DataFrame, seed: str = "choice") -> DataFrame:
    """(vec_id, label, raw): right name, alt spelling, next name, two names, none."""
    k = len(K.CHOICE_NAMES)
    style = seeded_bucket(seed, F.col("vec_id"), 5)
    name = choice_name(F.col("label"))
    nxt = choice_name(F.pmod(F.col("label") + 1, F.lit(k)))
    raw = (F.when(style == 0, name)
           .when(style == 1, alt_name(name))
           .when(style == 2, nxt)
           .when(style == 3, F.concat(nxt, F.lit(" or "), name))
           .otherwise(F.lit("No idea.")))
    return emb.select("vec_id", F.col("label").cast("bigint").alias("label"), raw.alias("raw"))
