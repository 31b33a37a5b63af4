"""Splittable reading of CSV whose quoted fields hold newlines (A1, A7).

A reader that starts in the middle of such a file can't tell whether it stands
inside quotes. Here every byte range is scanned for both cases, and the case is
settled afterwards:

1. The file is read as text lines, by as many tasks as it has ranges. A running sum
   of quotes gives each line its parity relative to the start of its range.
2. Each range reports the parity of all its quotes, and how many records start in it
   if it begins outside quotes, and if inside: three numbers.
3. A running sum over these numbers fixes every range's state and the number of its
   first record.
4. Lines get the number of their record. Lines of one record are put together (a record
   that crosses ranges too), and each record is parsed by itself.

Doubled quotes change nothing in a parity, so they need no care. Quotes inside unquoted
fields, which no CSV writer emits, are not supported. Nothing is read on the
driver but the header record.
"""

from __future__ import annotations

import csv
import io

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

LINE_OPTIONS = {"lineSep": "\n"}
RECORD_OPTIONS = {"quote": '"', "escape": '"', "multiLine": "true", "mode": "PERMISSIVE"}


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, range, line, value, record, starts): every line with the number of its
    record within its file (from 0, blank lines between records left out)."""
    raw = spark.read.options(**LINE_OPTIONS).text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("range"),
        F.monotonically_increasing_id().alias("line"), "value")
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    blank = F.col("value").isin("", "\r")
    here = Window.partitionBy("file", "range").orderBy("line")
    before = F.coalesce(F.sum("_quotes").over(here.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    lines = raw.withColumn("_quotes", quotes).withColumn("_parity", (before % 2).cast("int"))
    # a line starts a record if it begins outside quotes: parity 0 if the range does, else 1
    outside = (F.col("_parity") == 0) & ~blank
    inside = (F.col("_parity") == 1) & ~blank
    upto = here.rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumns({"_n0": F.sum(outside.cast("bigint")).over(upto),
                               "_n1": F.sum(inside.cast("bigint")).over(upto)})
    ranges = lines.groupBy("file", "range").agg(
        (F.sum("_quotes") % 2).cast("int").alias("_odd"), F.max("_n0").alias("_all0"), F.max("_n1").alias("_all1"))
    earlier = Window.partitionBy("file").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    state = (F.coalesce(F.sum("_odd").over(earlier), F.lit(0)) % 2).cast("int")
    ranges = ranges.withColumn("_state", state).withColumn("_first", F.coalesce(F.sum(
        F.when(F.col("_state") == 0, F.col("_all0")).otherwise(F.col("_all1"))).over(earlier), F.lit(0)))
    joined = lines.join(ranges.select("file", "range", "_state", "_first"), ["file", "range"])
    begun = F.when(F.col("_state") == 0, F.col("_n0")).otherwise(F.col("_n1"))
    quoted = F.col("_parity") != F.col("_state")
    return (joined.where(quoted | ~blank)       # blank lines inside quotes belong to their record
            .select("file", "range", "line", "value", (F.col("_first") + begun - 1).cast("bigint").alias("record")))


def records(spark: SparkSession, path: str) -> DataFrame:
    """(file, record, text) of every record, header included."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("range", "line", "value"))),
                                    lambda x: x["value"]), "\n")
    return (numbered_lines(spark, path).groupBy("file", "record").agg(text.alias("text"))
            .withColumn("text", F.regexp_replace("text", r"\r$", "")))


def read_quoted_csv(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """Rows of a CSV file or folder with headers, with ``_file`` and ``_record``
    (from 1) for their place. Without ``schema`` all columns are strings, named by
    the header; files with another header than the first one are an error."""
    rows = records(spark, path)
    headers = rows.where("record = 0").groupBy("text").agg(F.min("file").alias("file")).orderBy("file").limit(2).collect()
    if not headers:
        names: list[str] = [f.name for f in schema] if schema else []
    else:
        names = next(csv.reader(io.StringIO(headers[0].text)))
        if len(headers) > 1 and schema is None:
            raise ValueError(f"files under {path} have different headers")
    schema = schema or T.StructType([T.StructField(n, T.StringType()) for n in names])
    if not schema.fields:
        return spark.createDataFrame([], "_file string, _record bigint")
    parsed = F.from_csv("text", _ddl(schema), RECORD_OPTIONS)
    return rows.where("record > 0").select(parsed.alias("r"), F.col("file").alias("_file"), F.col("record").alias("_record")) \
        .select("r.*", "_file", "_record")


def _ddl(schema: T.StructType) -> str:
    return ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in schema)


def file_positions(rows: DataFrame) -> DataFrame:
    """Adds ``file_pos``, the 0-based place of each row of :func:`read_quoted_csv`
    over all files in order of their path: one running sum over the files."""
    before = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
    per_file = (rows.groupBy("_file").agg(F.max("_record").alias("_n"))
                .select(F.col("_file").alias("_f"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")))
    return rows.join(per_file, rows["_file"] == per_file["_f"]).withColumn(
        "file_pos", (F.col("_before") + F.col("_record") - 1).cast("bigint")).drop("_f", "_before")
