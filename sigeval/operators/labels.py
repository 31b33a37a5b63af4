"""C6 / C7 — labels from peak counts.

The threshold label is a column expression (:func:`features.label_by_threshold`);
the regime labels come from a small range table (regime, label, lo, hi). The
ranges of the two regimes overlap, so a row can match several ranges; the
table is a handful of rows, so it is broadcast and joined with a range
condition (a broadcast nested-loop join whose build side is bounded by the
range table, not by the data).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def range_labels(df: DataFrame, ranges: DataFrame, peaks_col: str = "total_peaks") -> DataFrame:
    """Every (row, matching range) pair: adds ``regime`` and ``label`` of each
    inclusive ``[lo, hi]`` range that contains ``peaks_col``; rows matching
    no range are dropped."""
    r = ranges.select("regime", F.col("label").alias("_range_label"), "lo", "hi")
    j = df.join(F.broadcast(r), df[peaks_col].between(r["lo"], r["hi"]), "inner")
    return j.drop("lo", "hi").withColumnRenamed("_range_label", "label")
