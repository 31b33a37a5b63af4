"""E2 — replies that come late or repeatedly: the last one per id counts.

State per id holds the reply that counts (its time and score). A newer reply takes its
place and writes two change rows, one that withdraws the old score and one that
adds the new; an older or equal one writes nothing. So counters over the change
rows are corrected, never doubled, whatever the order of arrival. State expires
``keep`` after its reply by the watermark; replies later than that are dropped by
it. Change rows go to Parquet files, one folder per stream, with the stream's
checkpoint in the shared folder.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..session import checkpoint_dir
from .score import scored

REPLY_SCHEMA = "id string, ts timestamp, raw_response string"
CHANGE_SCHEMA = "id string, label string, correct bigint, total bigint"
_STATE = "ts timestamp, reply string, label string, correct boolean"


def _correct(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState, keep_ms: int) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:
        state.remove()
        return
    best = state.get if state.exists else None
    before = best
    for frame in frames:
        for row in frame.itertuples(index=False):
            # of equal times the greatest text counts, so that order of arrival doesn't matter
            if best is None or (row.ts, row.raw_response or "") > (best[0], best[1] or ""):
                best = (row.ts.to_pydatetime(), row.raw_response, row.label, bool(row.correct))
    if best is not None:
        state.update(best)
        until = int(pd.Timestamp(best[0]).timestamp() * 1000) + keep_ms
        state.setTimeoutTimestamp(max(until, state.getCurrentWatermarkMs() + 1))
    if best is before or best is None:
        return
    changes = [(key[0], best[2], int(best[3]), 1)]
    if before is not None:
        changes.append((key[0], before[2], -int(before[3]), -1))
    yield pd.DataFrame(changes, columns=["id", "label", "correct", "total"])


def corrected_scores(replies: DataFrame, truth: DataFrame, approach: str = "regular", delay: str = "1 day",
                     keep_ms: int = 24 * 3600 * 1000) -> DataFrame:
    """A stream of replies (id, ts, raw_response) -> change rows per id."""
    rows = scored(replies.withColumn("_reply", F.col("raw_response")), truth, approach, extra=("ts", "_reply"))
    rows = rows.select("id", "ts", F.col("_reply").alias("raw_response"), "label", "correct").withWatermark("ts", delay)
    return rows.groupBy("id").applyInPandasWithState(
        lambda key, frames, state: _correct(key, frames, state, keep_ms), CHANGE_SCHEMA, _STATE, "append",
        GroupStateTimeout.EventTimeTimeout)


def start_corrections(spark: SparkSession, reply_dir: str, truth: DataFrame, out_dir: str, name: str,
                      files_per_batch: int | None = None, available_now: bool = True, **options) -> StreamingQuery:
    """Watches ``reply_dir`` for reply files and appends change rows to ``out_dir``."""
    source = spark.readStream.schema(REPLY_SCHEMA)
    if files_per_batch:
        source = source.option("maxFilesPerTrigger", files_per_batch)
    changes = corrected_scores(source.parquet(reply_dir), truth, **options)
    writer = (changes.writeStream.outputMode("append").format("parquet").option("path", out_dir)
              .option("checkpointLocation", os.path.join(checkpoint_dir(spark), f"stream-{name}")))
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")).start()


def corrected_metrics(spark: SparkSession, out_dir: str) -> DataFrame:
    """Per class correct and total of the change rows written so far."""
    rows = spark.read.schema(CHANGE_SCHEMA).parquet(out_dir)
    return rows.groupBy("label").agg(F.sum("correct").alias("correct"), F.sum("total").alias("total")).where("total != 0")
