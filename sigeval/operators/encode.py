"""C8 — encode an event stream into fixed-length symbol sequences.

Each user's events are ordered by ``(ts, event_id)``, mapped to one symbol per
event type, and cut into consecutive chunks of ``chunk_length`` symbols; a
user's last chunk may be shorter. One output row per ``(user, chunk)``. Events
without a user or of an unknown type fail the job.

Plan shape: the per-user numbering is the skew-safe
:func:`~sigeval.operators.ordering.row_number_by_key` by hours (a user holding
a third of all events is spread over the hours), and the chunk assembly is a
``groupBy(user, chunk)`` whose groups never exceed ``chunk_length`` rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from .ordering import row_number_by_key


def event_symbol(event_type) -> Column:
    et = F.col(event_type) if isinstance(event_type, str) else event_type
    out = None
    for name, sym in K.EVENT_SYMBOLS:
        out = F.when(et == name, F.lit(sym)) if out is None else out.when(et == name, F.lit(sym))
    return out


def encode_sequences(events: DataFrame, chunk_length: int = K.CHUNK_LENGTH,
                     user_col: str = "user_id", time_col: str = "ts",
                     tie_col: str = "event_id", type_col: str = "event_type",
                     bucket_unit: str = "HOUR") -> DataFrame:
    """events -> (id STRING, user_id BIGINT, chunk BIGINT, sequence STRING)."""
    sym = event_symbol(type_col)
    checked = F.when(F.col(user_col).isNotNull() & sym.isNotNull(), sym).otherwise(F.raise_error(
        F.concat_ws(" ", F.lit("event without a user or of unknown type:"), F.col(tie_col).cast("string"))))
    ev = events.select(F.col(user_col).alias("user_id"), F.col(time_col).alias("_ts"),
                       F.col(tie_col).alias("_tie"), checked.alias("_sym"))
    numbered = row_number_by_key(ev, ["user_id"], ["_ts", "_tie"], F.date_trunc(bucket_unit, "_ts"), out="_rn")
    chunks = (numbered
              .select("user_id",
                      F.floor(F.col("_rn") / chunk_length).cast("bigint").alias("chunk"),
                      (F.col("_rn") % chunk_length).cast("int").alias("_pos"),
                      "_sym")
              .groupBy("user_id", "chunk")
              .agg(F.collect_list(F.struct("_pos", "_sym")).alias("_parts")))
    return (chunks
            .select(
                F.format_string("u%d_%d", "user_id", "chunk").alias("id"),
                "user_id", "chunk",
                F.array_join(F.transform(F.array_sort("_parts"), lambda p: p["_sym"]), "")
                .alias("sequence")))
