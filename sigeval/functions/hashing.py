"""Seeded, partition-independent keys.

``md5(seed:id)`` is identical in Spark and DuckDB, so a shuffle, a sample or a
split decided by it is reproducible across engines and across task retries
(unlike ``rand()``, whose value depends on the partition layout).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .util import as_col


def seeded_key(seed: str, col) -> Column:
    """md5 hex string of ``seed:value`` — a sort key for seeded shuffles."""
    return F.md5(F.concat(F.lit(f"{seed}:"), as_col(col).cast("string")))


def seeded_int(seed: str, col) -> Column:
    """First 8 hex digits of :func:`seeded_key` as an unsigned 32-bit BIGINT."""
    return F.conv(F.substring(seeded_key(seed, col), 1, 8), 16, 10).cast("bigint")


def seeded_bucket(seed: str, col, n: int) -> Column:
    """Deterministic bucket in ``[0, n)``."""
    return F.pmod(seeded_int(seed, col), F.lit(n)).cast("bigint")
