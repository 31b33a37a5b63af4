"""Snapshot commits, label search, range joins, typed payloads, observed sizes."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from sigeval.operators import parse as P
from sigeval.operators.label_search import first_label
from sigeval.operators.ranges import range_join
from sigeval.sources import io
from sigeval.sources import snapshot as S
from conftest import SF_SMALL


# ---------------------------------------------------------------- snapshots
def test_a_reader_sees_the_old_or_the_new_run(spark, tmp_dir):
    path = os.path.join(tmp_dir, "t")
    with pytest.raises(FileNotFoundError):
        S.read_snapshot(spark, path)
    rows = lambda v: spark.createDataFrame([("a", 1, v), ("a", 2, v), ("b", 3, v)], "k string, i int, v string")
    S.write_snapshot(rows("old"), path, by=("k",))
    before = S.read_snapshot(spark, path)
    failing = rows("new").withColumn("v", F.when(F.col("i") == 3, F.raise_error(F.lit("task fails"))).otherwise(F.col("v")))
    with pytest.raises(Exception, match="task fails"):
        S.write_snapshot(failing.repartition(3), path, by=("k",))
    assert {tuple(r) for r in S.read_snapshot(spark, path).collect()} == {("a", 1, "old"), ("a", 2, "old"), ("b", 3, "old")}
    S.write_snapshot(rows("new").where("k = 'a'"), path, by=("k",))
    want = {("a", 1, "new"), ("a", 2, "new"), ("b", 3, "old")}
    assert {tuple(r) for r in S.read_snapshot(spark, path).collect()} == want
    assert {r.v for r in before.collect()} == {"old"}       # a reader that began before still reads its files
    assert S.expire(spark, path) >= 1
    assert {tuple(r) for r in S.read_snapshot(spark, path).collect()} == want
    S.write_snapshot(rows("last").where("k = 'b'"), path, by=("k",), replace_all=True)
    assert {tuple(r) for r in S.read_snapshot(spark, path).collect()} == {("b", 3, "last")}


def test_unpartitioned_and_empty_tables(spark, tmp_dir):
    path = os.path.join(tmp_dir, "u")
    S.write_snapshot(spark.range(3).toDF("i"), path)
    assert S.read_snapshot(spark, path).count() == 3
    S.write_snapshot(spark.range(0).toDF("i"), path)
    assert S.read_snapshot(spark, path).count() == 0


def test_a_second_writer_is_refused(spark, tmp_dir, monkeypatch):
    path = os.path.join(tmp_dir, "w")
    S.write_snapshot(spark.range(3).toDF("i"), path)
    found, real = [], S._leaves

    def slow(*args):
        if not found:
            found.append(1)
            S.write_snapshot(spark.range(5).toDF("i"), path)
        return real(*args)

    monkeypatch.setattr(S, "_leaves", slow)
    with pytest.raises(RuntimeError, match="another writer"):
        S.write_snapshot(spark.range(9).toDF("i"), path)
    assert S.read_snapshot(spark, path).count() == 5


# ---------------------------------------------------------------- label search
@pytest.mark.parametrize("block_chars", [1 << 24, 3000])
def test_ten_thousand_labels_over_documents(spark, block_chars):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect()
    rng = random.Random(5)
    texts = [r.text for r in docs if r.text]
    names = []
    for i in range(10_000 if block_chars > 3000 else 400):
        t = rng.choice(texts)
        at = rng.randrange(max(1, len(t) - 30))
        names.append((i, t[at:at + rng.randrange(12, 30)] if i % 2 else f"nowhere {i}"))
    names += [(-7, None), (1, ""), (None, "the")]
    rng.shuffle(names)
    table = spark.createDataFrame(names, "label bigint, name string")
    df = spark.createDataFrame([*map(tuple, docs), (-1, None), (-2, "")], "doc_id bigint, text string")
    got = {r.doc_id: r.pred for r in first_label(df, "text", table, block_chars=block_chars).collect()}
    good = sorted((i, n) for i, n in names if n and i is not None)
    for r in [*docs, *[]]:
        assert got[r.doc_id] == next((i for i, n in good if n in (r.text or "")), -1)
    assert got[-1] == got[-2] == -1
    assert first_label(df, "text", table.limit(0)).where("pred != -1").count() == 0


# ---------------------------------------------------------------- ranges
def test_ranges_of_any_length(spark):
    rng = random.Random(1)
    spans = [(i, lo := rng.randrange(-5000, 5000), lo + rng.choice([-1, 0, 1, 2, 3, 7, 8, 9, 100, 4000])) for i in range(400)]
    spans += [(900, -(2 ** 40), 2 ** 40), (901, None, 5), (902, 5, None), (903, 5, 5)]
    values = [rng.randrange(-6000, 9000) for _ in range(500)] + [None, 5, 5]
    rows = spark.createDataFrame([(v,) for v in values], "v bigint")
    ranges = spark.createDataFrame(spans, "r bigint, lo bigint, hi bigint")
    got = sorted((r.v, r.r) for r in range_join(rows, ranges, "v").collect())
    assert got == sorted((v, r) for v in values if v is not None for r, lo, hi in spans
                         if lo is not None and hi is not None and lo <= v <= hi)


def test_a_million_ranges_without_a_nested_loop(spark):
    ranges = spark.range(1_000_000).select(F.col("id").alias("r"), (F.col("id") * 3).alias("lo"), (F.col("id") * 3 + F.col("id") % 50).alias("hi"))
    rows = spark.range(0, 3_000_000, 1000).select(F.col("id").alias("v"))
    joined = range_join(rows, ranges, "v")
    plan = joined._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan
    # value v lies in range r if 3r <= v <= 3r + r % 50: r from v // 3 downwards
    want = sum(1 for v in range(0, 3_000_000, 1000) for r in range(max(0, v // 3 - 17), v // 3 + 1) if 3 * r <= v <= 3 * r + r % 50)
    assert joined.count() == want
    assert range_join(rows, ranges.limit(0), "v").count() == 0


# ---------------------------------------------------------------- VARIANT
def test_positions_stay_numbers_both_ways(spark, tmp_dir):
    line = {"sequence": "|.:", "concepts": None, "fc_class": "Brady", "rr_intervals": [1.0],
            "metadata": {"narrow_peaks": 1, "peak_positions": [[0, "|"], [12, ":"]]}}
    src = os.path.join(tmp_dir, "s.jsonl")
    with open(src, "w") as f:
        f.write(json.dumps(line) + "\n")
    df = io.read_samples_jsonl(spark, src)
    assert [tuple(p) for p in df.first().metadata.peak_positions] == [(0, "|"), (12, ":")]
    out = os.path.join(tmp_dir, "out")
    io.write_samples_jsonl(df, out)
    text = spark.read.text(out).first().value
    assert '"peak_positions":[[0,"|"],[12,":"]]' in text
    assert [tuple(p) for p in io.read_samples_jsonl(spark, out).first().metadata.peak_positions] == [(0, "|"), (12, ":")]


def test_concepts_have_types(spark):
    keys = ["C1_picos_estrechos", "C2_picos_anchos", "C3_pct_ruido", "C4_irregularidad", "C5_artefactos_significativos"]
    reply = '```json\n{"conceptos": {"%s": 3, "%s": "x", "%s": 2.5, "%s": 1, "%s": true, "more": [1]}, "fc_clase": "Brady"}\n```' % tuple(keys)
    rows = spark.createDataFrame([(reply,), ("no json",), (None,)], "r string")
    a, b, c = rows.select(P.concept_values("r").alias("c")).collect()
    assert [a.c[k] for k in keys] == [3, None, 2.5, 1.0, True] and b.c is None and c.c is None


def test_counts_are_observed_by_the_write(spark):
    df = spark.range(1000).select("id", (F.col("id") % 3).alias("k"))
    back, sizes = io.write_observed(df, "observed", {"n": F.count(F.lit(1)), "zeros": F.count_if(F.col("k") == 0), "top": F.max("id")})
    assert sizes == {"n": 1000, "zeros": 334, "top": 999} and back.count() == 1000
