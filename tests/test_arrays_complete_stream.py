import os

import pytest
from pyspark.sql import functions as F

from sigeval.operators import arrays as J
from sigeval.operators.complete import RuleClient, complete_batch
from sigeval.streaming import score as S


def test_mask(spark):
    df = spark.createDataFrame([([0, 5, 7, 0],)], "ids array<bigint>")
    r = df.select(J.mask_ids("ids", masked=(0,)).alias("m"),
                  J.mask_prefix(F.col("ids"), F.lit(2)).alias("p"),
                  J.pad_to(F.col("ids"), F.lit(6)).alias("pad")).collect()[0]
    assert r.m == [-100, 5, 7, -100] and r.p == [-100, -100, 7, 0] and r.pad == [0, 5, 7, 0, 0, 0]


def _msgs(spark, rows):
    return spark.createDataFrame(
        [(i, [("system", "s"), ("user", u)]) for i, u in rows],
        "id string, messages array<struct<role:string,content:string>>")


def test_complete_batch_errors_recorded(spark):
    df = _msgs(spark, [("a", "Strip: ||||||||||||"), ("b", "no strip here")])
    got = {r.id: r for r in complete_batch(df, RuleClient).collect()}
    assert '"Label": "Tachy"' in got["a"].raw_response and got["a"].error is None
    assert got["b"].raw_response is None and "no sequence" in got["b"].error


def test_complete_batch_fail_fast(spark):
    df = _msgs(spark, [("b", "no strip here")])
    with pytest.raises(Exception):
        complete_batch(df, RuleClient, fail_fast=True).collect()


def test_streaming_scoring(spark, tmp_dir):
    reply_dir = os.path.join(tmp_dir, "replies")
    spark.createDataFrame([("1", "Brady!"), ("2", "normal"), ("3", "???")], S.REPLY_SCHEMA) \
        .write.parquet(os.path.join(reply_dir, "b0"))
    truth = spark.createDataFrame([("1", "Brady"), ("2", "Tachy"), ("3", "Tachy")], "id string, label string")
    q = S.start_scoring(spark, os.path.join(reply_dir, "*"), truth, "scores_t")
    q.awaitTermination(120)
    got = {r.label: (r.correct, r.total) for r in spark.table("scores_t").collect()}
    assert got == {"Brady": (1, 1), "Tachy": (0, 2)}


def test_complete_batch_retries_and_threads(spark):
    class _Flaky(RuleClient):
        """Fails the first call for every prompt, then answers."""

        def __init__(self):
            self.seen = set()

        def predict(self, messages, max_tokens=500):
            key = messages[-1]["content"]
            if key not in self.seen:
                self.seen.add(key)
                raise TimeoutError("first call times out")
            return super().predict(messages, max_tokens)

    rows = [(str(i), "Strip: " + "|" * i + "..") for i in range(1, 16)]
    df = _msgs(spark, rows)
    plain = {r.id: r.raw_response for r in complete_batch(df, RuleClient).collect()}
    threaded = {r.id: r.raw_response for r in complete_batch(df, RuleClient, threads_per_task=4).collect()}
    assert threaded == plain
    no_retry = complete_batch(df, _Flaky).collect()
    assert all(r.error and "TimeoutError" in r.error for r in no_retry)
    retried = {r.id: (r.raw_response, r.error)
               for r in complete_batch(df, _Flaky, retries=1, retry_wait_s=0.01, threads_per_task=3).collect()}
    assert {k: v[0] for k, v in retried.items()} == plain and all(v[1] is None for v in retried.values())


def test_streaming_scoring_resumes_from_checkpoint(spark, tmp_dir):
    """A restarted stream continues from its checkpoint: counters from the
    first run are kept and only the new reply file is read."""
    reply_dir = os.path.join(tmp_dir, "replies2")
    truth = spark.createDataFrame([(str(i), "Brady") for i in range(6)], "id string, label string")
    spark.createDataFrame([("0", "brady"), ("1", "tachy")], S.REPLY_SCHEMA) \
        .write.parquet(os.path.join(reply_dir, "b0"))
    q = S.start_scoring(spark, os.path.join(reply_dir, "*"), truth, "scores_resume")
    q.awaitTermination(120)
    assert [(r.correct, r.total) for r in spark.table("scores_resume").collect()] == [(1, 2)]
    spark.createDataFrame([("2", "Brady"), ("3", "b r a d y"), ("4", "BRADY!")], S.REPLY_SCHEMA) \
        .write.parquet(os.path.join(reply_dir, "b1"))
    q = S.start_scoring(spark, os.path.join(reply_dir, "*"), truth, "scores_resume")
    q.awaitTermination(120)
    assert [(r.correct, r.total) for r in spark.table("scores_resume").collect()] == [(3, 5)]
