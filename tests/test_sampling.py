import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from sigeval.operators import sampling as G
from sigeval.operators.ordering import global_index, row_number_by_key


def labelled(spark, counts):
    rows = [(f"{c}{i}", c) for c, n in counts.items() for i in range(n)]
    return spark.createDataFrame(rows, "id string, label string")


def test_class_short_of_n(spark):
    df = labelled(spark, {"Brady": 6, "Normal": 9, "Tachy": 2, "Other": 5})
    got = {r.label: r["count"] for r in G.sample_balanced(df, 4).groupBy("label").count().collect()}
    assert got == {"Brady": 4, "Normal": 4, "Tachy": 2}


def test_balanced_dataset_takes_smallest_class(spark):
    df = labelled(spark, {"Brady": 6, "Normal": 9, "Tachy": 3})
    out = G.balanced_dataset(df).collect()
    assert len(out) == 9
    assert sorted(r.dataset_pos for r in out) == list(range(9))


def test_train_val_split_exact_and_disjoint(spark):
    df = spark.range(103).select(F.concat(F.lit("x"), F.col("id").cast("string")).alias("id"))
    out = G.train_val_split(df, 0.8, 0.2, seed=7).collect()
    tr = {r.id for r in out if r.split == "train"}
    va = {r.id for r in out if r.split == "validation"}
    assert len(tr) == 82 and len(va) == 21 and not (tr & va)
    fixed = G.train_val_split(df, 50, 10, seed=7).groupBy("split").count().collect()
    assert {r.split: r["count"] for r in fixed} == {"train": 50, "validation": 10}


def test_shuffle_positions_are_a_permutation(spark):
    df = spark.range(57).select(F.col("id").cast("string").alias("id"))
    pos = sorted(r.pos for r in G.shuffle(df, 3).collect())
    assert pos == list(range(57))


def test_first_per_class_is_min_key(spark):
    df = labelled(spark, {"Brady": 5, "Normal": 5})
    got = {r.label: r.id for r in G.first_per_class(df, 42).collect()}
    keyed = G.with_shuffle_key(df, 42).collect()
    for lab in ("Brady", "Normal"):
        best = min((r.shuffle_key, r.id) for r in keyed if r.label == lab)
        assert got[lab] == best[1]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 50)), min_size=1, max_size=120))
def test_row_number_by_key_matches_window(spark, pairs):
    # key 0 is deliberately hot
    rows = [(k if i % 3 else 0, t, i) for i, (k, t) in enumerate(pairs)]
    df = spark.createDataFrame(rows, "k int, t int, u int")
    w = Window.partitionBy("k").orderBy("t", "u")
    want = {(r.u, r.rn) for r in df.select("u", (F.row_number().over(w) - 1).alias("rn")).collect()}
    for width in (1, 7, 100):     # many buckets per key, few, one
        got = {(r.u, r.rn) for r in row_number_by_key(df, ["k"], ["t", "u"], F.floor(F.col("t") / width)).collect()}
        assert got == want


def test_global_index_total(spark):
    df = spark.range(40).select((F.col("id") * 7 % 40).alias("v"))
    out = global_index(df, ["v"], F.floor(F.col("v") / 7), total="n").collect()
    assert all(r.pos == r.v for r in out) and {r.n for r in out} == {40}


def test_sample_n_and_head(spark):
    df = spark.range(30).select(F.col("id").cast("string").alias("id"))
    assert G.sample_n(df, 5).count() == 5
    assert G.head_n(df, 0).count() == 30
    assert [r.id for r in G.head_n(df, 3).collect()] == ["0", "1", "10"]


def test_examples_by_class_keeps_empty(spark):
    df = labelled(spark, {"Brady": 2})
    got = {r.label: r.n_examples for r in G.examples_by_class(df).collect()}
    assert got == {"Brady": 2, "Normal": 0, "Tachy": 0}


def test_window_group_limit_planned(spark):
    df = labelled(spark, {"Brady": 50, "Normal": 50, "Tachy": 50})
    plan = G.sample_balanced(df, 4)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_encode_is_the_same_for_any_bucket(spark):
    from sigeval.operators.encode import encode_sequences
    ev = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    hours = sorted(tuple(r) for r in encode_sequences(ev).collect())
    months = sorted(tuple(r) for r in encode_sequences(ev, bucket_unit="MONTH").collect())
    assert hours == months and sum(len(r[3]) for r in hours) == ev.count()


def test_encode_refuses_unknown_events(spark):
    from sigeval.operators.encode import encode_sequences
    ev = spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("event_type", F.lit("other"))
    with pytest.raises(Exception, match="unknown type"):
        encode_sequences(ev).collect()


def test_row_id_fallback(spark):
    df = spark.createDataFrame([("a", 3), (None, 1), ("c", 2)], "id string, k int")
    got = sorted((r.k, r.id) for r in G.with_row_id(df, order=["k"]).collect())
    assert got == [(1, "0"), (2, "c"), (3, "a")]
    no_id = spark.createDataFrame([(5,), (4,)], "k int")
    assert sorted(r.id for r in G.with_row_id(no_id, order=["k"]).collect()) == ["0", "1"]


def test_one_user_holding_a_third_of_events_is_spread(spark):
    """Every third event goes to user 0: its rows are numbered hour by hour, so
    no window group comes near that user's share."""
    from sigeval.operators.encode import encode_sequences
    ev = spark.read.parquet("/root/testdata/sf0.01/events.parquet")
    skewed = ev.withColumn("user_id", F.when(F.col("event_id") % 3 == 0, F.lit(0)).otherwise(F.col("user_id") + 1))
    held = skewed.where("user_id = 0").count()
    assert 0.3 < held / skewed.count() < 0.36
    most = skewed.groupBy("user_id", F.date_trunc("HOUR", "ts")).count().agg(F.max("count")).first()[0]
    assert most < held / 50
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    plain = skewed.withColumn("n", F.row_number().over(w) - 1)
    want = plain.where("user_id = 0").orderBy("n").select("event_type").collect()
    got = "".join(r.sequence for r in encode_sequences(skewed).where("user_id = 0").orderBy("chunk").collect())
    from sigeval import constants as K
    symbols = dict(K.EVENT_SYMBOLS)
    assert got == "".join(symbols[r.event_type] for r in want)
