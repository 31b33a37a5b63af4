from pyspark.sql import functions as F

from sigeval.functions import features as X


def run(spark, seqs, *cols):
    df = spark.createDataFrame([(s,) for s in seqs], "sequence string")
    return df.select("sequence", *cols).collect()


def test_empty_sequence(spark):
    r = run(spark, [""], X.noise_pct("sequence").alias("n"), X.rr_irregularity("sequence").alias("i"),
            X.peak_positions("sequence").alias("p"))[0]
    assert r.n is None and r.i == 0.0 and r.p == []


def test_single_peak(spark):
    r = run(spark, ["..|.."], X.rr_intervals("sequence").alias("rr"),
            X.rr_irregularity("sequence").alias("i"))[0]
    assert r.rr == [1.0] and r.i == 0.0


def test_artifact_threshold_strict(spark):
    rows = run(spark, ["_" + "." * 19, "_" + "." * 18], X.artifact_flag("sequence").alias("f"))
    assert [r.f for r in rows] == [False, True]


def test_thresholds(spark):
    df = spark.createDataFrame([(n,) for n in (0, 7, 8, 11, 12, 25)], "t bigint")
    got = [r.l for r in df.select(X.label_by_threshold("t").alias("l")).collect()]
    assert got == ["Brady", "Brady", "Normal", "Normal", "Tachy", "Tachy"]


def test_counts_sum_to_length(spark):
    s = "|:.~_" * 7 + "||"
    r = run(spark, [s], X.narrow_peaks("sequence").alias("a"), X.wide_peaks("sequence").alias("b"),
            X.count_symbol("sequence", ".").alias("c"), X.count_symbol("sequence", "~").alias("d"),
            X.count_symbol("sequence", "_").alias("e"), X.total_peaks("sequence").alias("t"))[0]
    assert r.a + r.b + r.c + r.d + r.e == len(s)
    assert r.t == r.a + r.b == s.count("|") + s.count(":")


def test_irregularity_matches_numpy(spark):
    import numpy as np
    s = "..|....:..|.........|..:....."
    pos = [i for i, c in enumerate(s) if c in "|:"]
    iv = np.diff(pos)
    expect = round(float(np.std(iv) / np.mean(iv)), 3)
    r = run(spark, [s], X.rr_irregularity("sequence").alias("i"),
            X.peak_intervals("sequence").alias("iv"))[0]
    assert r.iv == list(iv) and r.i == expect


def test_rr_clamp(spark):
    s = "|" + "." * 60 + "|..|"
    r = run(spark, [s], X.rr_intervals("sequence").alias("rr"))[0]
    assert r.rr == [50.0, 5.0]


def test_target_json_spacing(spark):
    import json
    df = spark.createDataFrame([("||:.", "Brady")], "sequence string, label string")
    r = df.select(X.target_json("sequence", F.col("label")).alias("a"),
                  X.target_json("sequence", F.col("label"), indent=2).alias("b")).collect()[0]
    want = {"Narrow_peaks": 2, "Wide_peaks": 1, "Total_peaks": 3, "Label": "Brady"}
    assert r.a == json.dumps(want)
    assert r.b == json.dumps(want, indent=2)


def test_concepts_json_matches_python(spark):
    import json
    df = spark.createDataFrame([("|.~_:.._~..|",)], "sequence string")
    r = df.select(X.concepts("sequence").alias("c")).select(
        "c", X.concepts_json(F.col("c")).alias("j")).collect()[0]
    d = r.c.asDict()
    assert r.j == json.dumps(d, ensure_ascii=False, indent=2)
    typ = df.select(X.concepts("sequence").alias("c")).schema["c"].dataType
    null = df.select(X.concepts_json(F.lit(None).cast(typ)).alias("j")).collect()[0]
    assert null.j == "{}"


def test_concepts_default_irregularity(spark):
    df = spark.createDataFrame([("|..:",)], "sequence string")
    r = df.select(X.concepts_or_stored(df.columns).alias("c")).collect()[0].c
    assert r["C4_irregularidad"] == 0.05 and r["C1_picos_estrechos"] == 1


def test_augment_keeps_peaks(spark):
    from sigeval.operators.augment import augment_noise
    seqs = ["|..:....|" * 3, "." * 40, ""]
    df = spark.createDataFrame([(f"r{i}", s) for i, s in enumerate(seqs)], "id string, sequence string")
    rows = df.select("sequence", augment_noise(F.col("sequence"), F.col("id")).alias("a")).collect()
    for r in rows:
        assert len(r.a) == len(r.sequence)
        assert r.a.count("|") == r.sequence.count("|") and r.a.count(":") == r.sequence.count(":")
        assert set(r.a) <= set("|:._~")


def test_range_overlap(spark):
    from sigeval.operators.labels import range_labels
    from sigeval.plans.tables import label_ranges
    df = spark.createDataFrame([(p,) for p in (5, 9, 15, 20, 1)], "total_peaks bigint")
    got = {}
    for r in range_labels(df, label_ranges(spark)).collect():
        got.setdefault(r.total_peaks, set()).add(r.regime)
    assert got == {5: {"in", "ood"}, 9: {"in", "ood"}, 15: {"in", "ood"}, 20: {"ood"}}
