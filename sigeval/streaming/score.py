"""Scoring replies as they arrive (Structured Streaming).

Completion jobs write replies in batches; these helpers score them
incrementally. Parsing and correctness are stateless row expressions, the
truth table is a static DataFrame joined per micro-batch (stream-static
join), and the running per-class counters are a streaming aggregation whose
state holds one row per class.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import constants as K
from ..operators import parse as P
from ..session import checkpoint_dir

REPLY_SCHEMA = "id string, raw_response string"


def scored(replies: DataFrame, truth: DataFrame, approach: str = "regular",
           id_col: str = "id", label_col: str = "label", extra: tuple[str, ...] = ()) -> DataFrame:
    """Replies (batch or stream) joined to their true labels and scored;
    ``extra`` names columns of the replies to keep."""
    t = truth.select(F.col(id_col).alias("_tid"), F.col(label_col).alias("label"))
    j = replies.join(t, replies[id_col] == t["_tid"], "inner").drop("_tid")
    if approach == "regular":
        pred = F.coalesce(P.parse_keyword("raw_response"), F.lit(K.UNKNOWN))
        ok = P.correct_icl(pred, F.col("label"))
    elif approach == "tuned":
        pred = P.parse_embedded_json("raw_response")
        ok = P.correct_tuned(pred, F.col("label"))
    else:
        raise ValueError(f"unknown approach {approach}")
    return j.select(id_col, "label", pred.alias("pred"), ok.alias("correct"), *extra)


def running_metrics(scored_rows: DataFrame) -> DataFrame:
    """Per-class correct / total counters (streaming state: one row per class)."""
    return scored_rows.groupBy("label").agg(
        F.count_if("correct").cast("bigint").alias("correct"),
        F.count(F.lit(1)).cast("bigint").alias("total"))


def start_scoring(spark: SparkSession, reply_dir: str, truth: DataFrame, query_name: str,
                  approach: str = "regular", available_now: bool = True) -> StreamingQuery:
    """Watch ``reply_dir`` for parquet reply files and keep per-class
    counters in an in-memory table ``query_name``. The stream checkpoint goes
    under the session's shared checkpoint folder."""
    stream = spark.readStream.schema(REPLY_SCHEMA).parquet(reply_dir)
    metrics = running_metrics(scored(stream, truth, approach))
    ckpt = os.path.join(checkpoint_dir(spark), f"stream-{query_name}")
    w = (metrics.writeStream.outputMode("complete").format("memory").queryName(query_name)
         .option("checkpointLocation", ckpt))
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()
