"""E1 — resumable completion: every reply goes to a log, and what the log holds
is never asked again.

The log is a Parquet folder of ``(run, id, raw_response, error, attempt)``.
:func:`complete_logged` leaves out the prompts that have a reply (an anti join
on run and id), deals the rest out in tasks of about ``rows_per_task`` prompts
and appends their replies. Tasks publish their file as they end, not when the job
ends, so a job that is killed keeps what its finished tasks paid for; only
the calls of tasks that were running can be made again, at most
``rows_per_task`` for each. Failed calls are logged too and asked again by the
next attempt; of the rows of one ``(run, id)`` a reply beats an error, and a later
attempt an earlier one.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.util import path_exists
from .complete import complete_batch

LOG_SCHEMA = "run string, id string, raw_response string, error string, attempt int"
# a task's file is published when the task ends
PUBLISH_PER_TASK = {"mapreduce.fileoutputcommitter.algorithm.version": "2",
                    "mapreduce.fileoutputcommitter.marksuccessfuljobs": "false"}
_KEY_SEPARATOR = "\x1f"


def log_rows(spark: SparkSession, path: str) -> DataFrame:
    """All rows of the log; none if it does not exist yet."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], LOG_SCHEMA)
    return spark.read.schema(LOG_SCHEMA).parquet(path)


def logged_replies(spark: SparkSession, path: str, run: str | None = None) -> DataFrame:
    """``(run, id, raw_response, error)``, one row per prompt that was asked."""
    rows = log_rows(spark, path)
    if run is not None:
        rows = rows.where(F.col("run") == run)
    value = F.struct("raw_response", "error")
    # equal attempts (a task published twice) are told apart by their text, so the choice is stable
    rank = F.struct(F.col("error").isNull().alias("a"), F.col("attempt").alias("b"),
                    F.col("raw_response").alias("c"), F.col("error").alias("d"))
    return (rows.groupBy("run", "id").agg(F.max_by(value, rank).alias("_v"))
            .select("run", "id", "_v.raw_response", "_v.error"))


def complete_logged(prompts: DataFrame, client_factory: Callable[[], object], path: str, run: str | None = None,
                    rows_per_task: int = 256, fail_fast: bool = False, **options) -> DataFrame:
    """``prompts`` (id, messages[, run]) -> their replies ``(run, id,
    raw_response, error)`` from the log, after asking for those it lacks.

    ``run`` names the run of all prompts; without it the prompts have a column
    ``run``. With ``fail_fast`` a failed call raises, after all replies of this
    attempt are in the log. ``options`` go to :func:`complete_batch`."""
    spark = prompts.sparkSession
    if run is not None:
        prompts = prompts.withColumn("run", F.lit(run))
    prompts = prompts.select("run", F.col("id").cast("string").alias("id"), "messages")
    before = log_rows(spark, path)
    answered = before.where("error is null").select("run", "id").distinct()
    todo = prompts.join(answered, ["run", "id"], "left_anti")
    n = todo.count()
    if n:
        attempt = (before.agg(F.max("attempt")).first()[0] or 0) + 1
        todo = todo.repartition(-(-n // rows_per_task), "run", "id")
        key = F.split("id", _KEY_SEPARATOR, 2)
        replies = complete_batch(todo.withColumn("id", F.concat_ws(_KEY_SEPARATOR, "run", "id")), client_factory,
                                 **options)
        (replies.select(key[0].alias("run"), key[1].alias("id"), "raw_response", "error",
                        F.lit(attempt).alias("attempt"))
         .write.mode("append").options(**PUBLISH_PER_TASK).parquet(path))
        if fail_fast:
            failed = log_rows(spark, path).where((F.col("attempt") == attempt) & F.col("error").isNotNull()).take(1)
            if failed:
                raise RuntimeError(f"run {failed[0].run}, id {failed[0].id}: {failed[0].error}")
    wanted = prompts.select("run", "id").distinct()
    return logged_replies(spark, path).join(wanted, ["run", "id"], "left_semi")
