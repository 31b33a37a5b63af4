"""Late and repeated replies; positions by ranges; large balanced samples."""

import datetime as dt
import os
import random

from pyspark.sql import functions as F

from sigeval import runs
from sigeval.operators import sampling as G
from sigeval.sources import io
from sigeval.streaming import corrections as C
from conftest import SF_SMALL

CLASSES = ["Brady", "Normal", "Tachy"]


def at(minute):
    return dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minute)


def test_a_stream_with_repeats_ends_at_the_batch_numbers(spark, tmp_dir):
    rng = random.Random(2)
    truth = {f"i{k}": rng.choice(CLASSES) for k in range(40)}
    replies = [(i, at(rng.randrange(50)), rng.choice([*CLASSES, "?", None])) for i in truth for _ in range(rng.randrange(4))]
    replies += replies[:9]                                  # exact repeats
    rng.shuffle(replies)
    table = spark.createDataFrame(list(truth.items()), "id string, label string")
    src, out = os.path.join(tmp_dir, "in"), os.path.join(tmp_dir, "out")
    seen = []
    for n in range(3):                                      # three arrivals, the stream is stopped in between
        part = replies[n::3]
        seen += part
        spark.createDataFrame(part, C.REPLY_SCHEMA).repartition(2).write.parquet(os.path.join(src, str(n)))
        C.start_corrections(spark, f"{src}/*", table, out, f"corr-{os.path.basename(tmp_dir)}", files_per_batch=1).awaitTermination()
        last = {}
        for i, ts, text in seen:
            if i not in last or (ts, text or "") > last[i]:
                last[i] = (ts, text or "")
        want = {}
        for i, (_, text) in last.items():
            c, t = want.get(truth[i], (0, 0))
            want[truth[i]] = (c + (text == truth[i]), t + 1)
        got = {r.label: (r.correct, r.total) for r in C.corrected_metrics(spark, out).collect()}
        assert got == want


def test_row_ids_by_ranges(spark, tmp_dir):
    rows = [(None if i % 3 else f"x{i}", (i * 7919) % 1000) for i in range(1000)]
    df = spark.createDataFrame(rows, "id string, k int").repartition(5)
    got = {r.k: r.id for r in G.with_row_id(df, order=["k"]).collect()}
    assert got == {k: i or str(k) for i, k in rows}
    path = os.path.join(tmp_dir, "files")
    os.mkdir(path)
    for n, name in enumerate(["b.csv", "a.csv", "c.csv"]):
        with open(os.path.join(path, name), "w") as f:
            f.write("v\n" + "".join(f"{name}-{i}\n" for i in range(5 + 300 * n)))
    read = G.with_row_id(spark.read.option("header", True).csv(path)).collect()
    order = sorted(read, key=lambda r: int(r.id))
    assert [r.v for r in order] == [f"{n}-{i}" for n, k in (("a.csv", 305), ("b.csv", 5), ("c.csv", 605)) for i in range(k)]


def test_a_large_sample_has_the_same_ranks(spark, monkeypatch):
    df = spark.range(300).select(F.concat(F.lit("r"), F.col("id")).alias("id"), F.element_at(
        F.array(*map(F.lit, CLASSES)), (F.col("id") % 3 + 1).cast("int")).alias("label"))
    small = sorted((r.id, r.class_rank) for r in G.sample_balanced(df, 20).collect())
    monkeypatch.setattr(G, "LARGE_SAMPLE", 5)
    assert sorted((r.id, r.class_rank) for r in G.sample_balanced(df, 20).collect()) == small


def test_balanced_sets_and_training_config(spark, tmp_dir):
    events = spark.read.parquet(f"{SF_SMALL.replace('0.001', '0.01')}/events.parquet")
    data = runs.build_datasets(events, balanced=True)
    for name in ("icl", "test", "test_ood"):
        counts = {r.label: r["count"] for r in data[name].groupBy("label").count().collect()}
        assert len(set(counts.values())) == 1, (name, counts)
    _, plan = runs.training_records(data["train"], model_name="m-1", out_dir=tmp_dir)
    config = io.read_training_config(spark, os.path.join(tmp_dir, "training_config.json")).first()
    assert config.model_name == "m-1" and config.num_train_samples == plan.first().num_train_samples
    assert spark.read.json(os.path.join(tmp_dir, "train.jsonl")).columns == ["completion", "prompt"]
