"""Skew-safe row numbering in one lazy plan.

``row_number() OVER (PARTITION BY key ORDER BY ...)`` sends every row of a key
to one task. The operators below give the same numbers without that:

1. The caller names a *bucket*: columns that rise with the order (the hour of a
   time stamp, the first digits of a hash key), so a key's rows fall into many
   buckets, one after the other.
2. Rows are numbered inside ``(key, bucket)``.
3. Rows per ``(key, bucket)`` are counted with map-side combine; a running sum
   over those small counts says how many rows of the key precede each bucket.
4. A join on ``(key, bucket)`` adds the two.

Nothing is sampled, collected or written; the plan is the same at every size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint_dir

_N = "__n"
_OFF = "__offset"
_LOCAL = "__local_rn"


def pin(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the session's shared checkpoint folder."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def hash_bucket(key: str, digits: int = 5) -> Column:
    """Bucket of a hexadecimal sort key: its first digits. With five, the running
    sum sees at most 2^20 counts at every size, and a bucket of a table of 10^12
    rows holds a million."""
    return F.substring(key, 1, digits)


def _bucketed(df: DataFrame, bucket) -> tuple[DataFrame, list[str]]:
    columns = list(bucket) if isinstance(bucket, (list, tuple)) else [bucket]
    names = [f"__b{i}" for i in range(len(columns))]
    return df.withColumns(dict(zip(names, columns))), names


def row_number_by_key(df: DataFrame, keys: list[str], order: list[str], bucket,
                      out: str = "rn") -> DataFrame:
    """0-based row number of each row within ``keys`` ordered by ``order``.

    ``order`` must be a total order within a key (end it with a unique column);
    ``bucket`` (a column or several) must not fall as ``order`` rises. Rows with
    a null key are numbered within the null group as well."""
    rows, buckets = _bucketed(df, bucket)
    local = rows.withColumn(_LOCAL, (F.row_number().over(
        Window.partitionBy(*keys, *buckets).orderBy(*order)) - 1).cast("bigint"))
    before = Window.partitionBy(*keys).orderBy(*buckets).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (rows.groupBy(*keys, *buckets).agg(F.count(F.lit(1)).alias(_N))
               .withColumn(_OFF, F.coalesce(F.sum(_N).over(before), F.lit(0)).cast("bigint")))
    local, offsets = local.alias("l"), offsets.alias("o")
    cond = [F.col(f"l.{k}").eqNullSafe(F.col(f"o.{k}")) for k in (*keys, *buckets)]
    return local.join(offsets, cond).select(*(F.col(f"l.{c}").alias(c) for c in df.columns),
                                            (F.col(f"o.{_OFF}") + F.col(f"l.{_LOCAL}")).alias(out))


def ranged_index(df: DataFrame, order: list, out: str = "pos") -> DataFrame:
    """0-based position in any order, where no bucket is known: rows are dealt to
    tasks by ranges of ``order`` and written once (a second evaluation would draw
    other ranges); the ranges are the buckets. Equal rows may take any of their
    places."""
    ranged = pin(df.repartitionByRange(*order).withColumn("__range", F.spark_partition_id())
                 .sortWithinPartitions(*order).withColumn("__row", F.monotonically_increasing_id()))
    return global_index(ranged, ["__row"], F.col("__range"), out=out).drop("__range", "__row")


def global_index(df: DataFrame, order: list[str], bucket, out: str = "pos",
                 total: str | None = None) -> DataFrame:
    """0-based position of every row in the total order ``order`` (which must
    be unique), numbered per bucket. The running sum sees one row per bucket.
    ``total`` optionally adds the row count."""
    rows, buckets = _bucketed(df, bucket)
    local = rows.withColumn(_LOCAL, (F.row_number().over(
        Window.partitionBy(*buckets).orderBy(*order)) - 1).cast("bigint"))
    ordered = Window.orderBy(*buckets)
    offsets = (rows.groupBy(*buckets).agg(F.count(F.lit(1)).alias(_N))
               .select(*buckets,
                       F.coalesce(F.sum(_N).over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
                       .cast("bigint").alias(_OFF),
                       F.sum(_N).over(Window.partitionBy(F.lit(1))).cast("bigint").alias(_N)))
    local, offsets = local.alias("l"), offsets.alias("o")
    cond = [F.col(f"l.{b}").eqNullSafe(F.col(f"o.{b}")) for b in buckets]
    sel = [F.col(f"l.{c}").alias(c) for c in df.columns] + [(F.col(f"o.{_OFF}") + F.col(f"l.{_LOCAL}")).alias(out)]
    if total:
        sel.append(F.col(f"o.{_N}").alias(total))
    return local.join(offsets, cond).select(*sel)
