"""C7 beyond a broadcast — values joined to a large table of inclusive ranges.

A range of length ``n`` lies in at most two aligned intervals of the least power of
two that is not below ``n``, its *level*. So each range is entered in one or two
bins of its level, and each value looks in one bin of every level that the
ranges have (at most 64, known after one small aggregate). The join is an equi join
on (level, bin) with an exact check; no nested loop at any size. Bins with very
many values are split by the adaptive skew join, as the ranges of a bin are the
other side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_LEVEL = 62


def _level(length):
    """Least k with 2^k >= length, by the digits of length - 1 in base two."""
    digits = F.length(F.bin(length - 1))
    return F.when(length <= 1, F.lit(0)).otherwise(digits)


def range_join(rows: DataFrame, ranges: DataFrame, value: str, lo: str = "lo", hi: str = "hi") -> DataFrame:
    """Pairs of a row and a range with ``lo <= value <= hi`` (integers); the columns
    of both sides. Null values, null ends and empty ranges match nothing."""
    spans = ranges.where((F.col(lo) <= F.col(hi))).withColumn("_level", _level(F.col(hi) - F.col(lo) + 1))
    levels = sorted(r[0] for r in spans.select("_level").distinct().collect())
    if not levels:
        levels = [0]
    binned = spans.withColumn("_bin", F.explode(F.array_distinct(F.array(
        F.expr(f"shiftright(cast({lo} as bigint), cast(_level as int))"),
        F.expr(f"shiftright(cast({hi} as bigint), cast(_level as int))")))))
    looked = rows.where(F.col(value).isNotNull()).withColumn("_look", F.explode(F.array(*[
        F.struct(F.lit(k).alias("l"), F.shiftright(F.col(value).cast("bigint"), k).alias("b")) for k in levels])))
    joined = looked.join(binned, (F.col("_look.l") == F.col("_level")) & (F.col("_look.b") == F.col("_bin"))
                         & F.col(value).between(F.col(lo), F.col(hi)))
    return joined.drop("_look", "_level", "_bin")
