from __future__ import annotations

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether ``path`` exists in whatever file system it names."""
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(jpath)


def as_col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c) -> Column:
    """Trims leading and trailing ASCII white space, newlines and tabs included
    (``trim`` only removes spaces). Other code points that Python's
    ``str.strip()`` trims (1c to 1f, 85, a0 and the like) stay."""
    return F.btrim(as_col(c), F.lit(" \t\n\x0b\f\r"))


def json_string(c) -> Column:
    """A string column rendered as a JSON string literal (quotes, backslashes
    and control characters escaped)."""
    c = as_col(c)
    esc = F.replace(c, F.lit("\\"), F.lit("\\\\"))
    esc = F.replace(esc, F.lit('"'), F.lit('\\"'))
    esc = F.replace(esc, F.lit("\n"), F.lit("\\n"))
    esc = F.replace(esc, F.lit("\r"), F.lit("\\r"))
    esc = F.replace(esc, F.lit("\t"), F.lit("\\t"))
    return F.concat(F.lit('"'), esc, F.lit('"'))


def json_bool(c) -> Column:
    return F.when(as_col(c), F.lit("true")).otherwise(F.lit("false"))
