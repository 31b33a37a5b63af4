import os

import pytest
from pyspark.sql import functions as F

from sigeval import runs
from sigeval.operators.complete import RuleClient
from conftest import SF_SMALL


@pytest.fixture(scope="module")
def built(spark):
    ev = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    return runs.build_datasets(ev)


def test_build_datasets_writes_files(spark, tmp_dir):
    ev = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    out = runs.build_datasets(ev, os.path.join(tmp_dir, "data"))
    m = out["manifest"].collect()[0]
    assert m.sequence_length == 25 and m.icl_total + m.test_total + m.n_train_pool > 32
    from sigeval.sources import io
    back = io.read_examples_csv(spark, os.path.join(tmp_dir, "data", "test", "test_metadata.csv"))
    ids = sorted(r.id for r in back.collect())
    assert ids == [f"test_{i:04d}" for i in range(m.test_total)]
    chat = spark.read.json(os.path.join(tmp_dir, "data", "train", "finetune_messages.jsonl"))
    assert [x.role for x in chat.collect()[0].messages] == ["system", "user", "assistant"]


def test_evaluate_icl_rule_client(spark, built, tmp_dir):
    pred, metrics = runs.evaluate_icl(built["icl"], built["test"], RuleClient, n_shots=1,
                                      out_dir=os.path.join(tmp_dir, "out"), run_ts="t0")
    rows = pred.collect()
    assert rows and all(r.correct for r in rows) and all(r.error is None for r in rows)
    m = {r.metric: r.value for r in metrics.collect()}
    assert m["Overall Accuracy"] == "1.0" and m["Timestamp"] == "t0"
    saved = spark.read.parquet(os.path.join(tmp_dir, "out", "predictions"))
    assert saved.where((F.col("n_shots") == 1) & (F.col("model") == "local-model")).count() == len(rows)


def test_evaluate_icl_zero_shot_and_checks(spark, built):
    pred, _ = runs.evaluate_icl(None, built["test"], RuleClient, n_shots=0)
    assert pred.where("correct").count() == pred.count()
    with pytest.raises(FileNotFoundError):
        runs.evaluate_icl(None, built["test"], RuleClient, n_shots=0, task=2)
    with pytest.raises(ValueError):
        runs.evaluate_icl(None, built["test"], RuleClient, task=5)


def test_evaluate_tuned(spark, built):
    pred, summary = runs.evaluate_tuned(built["test"], RuleClient, examples=built["icl"], n_shots=1,
                                        max_samples=5, adapter_path="none", task=1, ood=False)
    s = summary.collect()[0]
    assert s.total_samples == pred.count() <= 5 and s.accuracy == 1.0
    assert set(s.per_class) <= {"Brady", "Normal", "Tachy"}


def test_training_records(spark, built):
    pairs, plan = runs.training_records(built["train"])
    p = plan.collect()[0]
    assert p.total_steps == (p.num_train_samples // 1) * 3 // 4
    r = pairs.orderBy("pos").collect()[0]
    assert r.prompt.endswith("<start_of_turn>model\n") and '"Label": ' in r.completion


def test_evaluate_icl_concept_mode(spark, built):
    pred, metrics = runs.evaluate_icl(built["icl"], built["test"], RuleClient, n_shots=1, approach="cbm")
    rows = pred.collect()
    assert rows and all(r.correct for r in rows)
    assert all(r.raw_response.startswith("```json") for r in rows)
