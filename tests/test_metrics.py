from pyspark.sql import functions as F

from sigeval.operators import metrics as M
from conftest import one


def preds(spark, rows):
    return spark.createDataFrame(rows, "id string, label string, correct boolean")


def test_unknown_true_label(spark):
    df = preds(spark, [("1", "Brady", True), ("2", "Brady", False), ("3", "Other", True)])
    acc = one(M.accuracy(df))
    assert (acc.correct, acc.total) == (2, 3)
    fixed = {r.label: (r.tp, r.total) for r in M.per_class_fixed(df).collect()}
    assert fixed == {"Brady": (1, 2), "Normal": (0, 0), "Tachy": (0, 0)}
    dyn = {r.label: (r.correct, r.total) for r in M.per_class_observed(df).collect()}
    assert dyn == {"Brady": (1, 2), "Other": (1, 1)}


def test_empty_accuracy_is_zero(spark):
    acc = one(M.accuracy(preds(spark, [])))
    assert (acc.correct, acc.total, acc.accuracy) == (0, 0, 0.0)


def test_metrics_long_shape(spark):
    df = preds(spark, [("1", "Brady", True), ("2", "Tachy", False)])
    rows = M.metrics_long(df, 1, 4, "regular", False, "m", run_ts="2024-01-01T00:00:00").orderBy("ord").collect()
    assert len(rows) == 18
    assert [r.metric for r in rows[:3]] == ["Overall Accuracy", "Correct Predictions", "Total Predictions"]
    assert rows[0].value == "0.5" and rows[6].value == "False"
    assert rows[-1].metric == "Tachy Total" and rows[-1].value == "1"


def test_weighted_f1_matches_sklearn_formula(spark):
    y = [0, 0, 1, 1, 2, 2, 2]
    p = [0, 1, 1, 1, 2, -1, 0]
    df = spark.createDataFrame(list(zip(y, p)), "label long, pred long")
    r = one(M.weighted_f1(df))
    # hand computation of support-weighted F1
    labels = set(y) | set(p)
    tot = 0.0
    for c in labels:
        tp = sum(1 for a, b in zip(y, p) if a == b == c)
        sup = sum(1 for a in y if a == c)
        npred = sum(1 for b in p if b == c)
        f1 = 2 * tp / (sup + npred) if sup + npred else 0.0
        tot += sup * f1
    assert r.weighted_f1 == round(tot / len(y), 6)
    assert r.accuracy == round(4 / 7, 6)


def test_weighted_f1_no_right_label(spark):
    df = spark.createDataFrame([(0, -1), (1, -1)], "label long, pred long")
    r = one(M.weighted_f1(df))
    assert r.accuracy == 0.0 and r.weighted_f1 == 0.0


def test_step_budget(spark):
    r = one(spark.range(1).select(*M.step_budget(F.lit(1500), batch=1, accum=4, epochs=3, warmup_ratio=0.1)))
    assert (r.total_steps, r.warmup_steps) == (1125, 112)


def test_balance_check(spark):
    df = spark.createDataFrame([("Brady",)] * 5 + [("Normal",)] * 4, "label string")
    assert {r.balanced for r in M.balance_check(df).collect()} == {False}


def test_run_summary_map(spark):
    df = preds(spark, [("1", "Brady", True), ("2", "Normal", False)])
    r = one(M.run_summary(df, task=1, n_shots=0))
    assert r.per_class["Brady"].correct == 1 and r.per_class["Normal"].total == 1


def test_observed_classes_sorted(spark):
    df = preds(spark, [("1", "Tachy", True), ("2", "Brady", False), ("3", "Normal", True)])
    assert [r.label for r in M.per_class_observed(df).collect()] == ["Brady", "Normal", "Tachy"]


def test_token_share_total(spark):
    rows = M.token_share(spark.createDataFrame([("a b c", "d"), ("e", "f g h")], "prompt string, completion string"))
    r = one(M.token_share_total(rows))
    assert (r.prompt_tokens, r.completion_tokens, r.completion_share) == (4, 4, 50.0)
