"""Quoted CSV read by ranges against the reader that takes a file as a whole."""

import os
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sigeval.sources import io, quoted_csv

SCHEMA = "id string, sequence string, true_class string, predicted_class string, correct boolean, raw_response string"


@pytest.fixture()
def small_ranges(spark):
    names = {"spark.sql.files.maxPartitionBytes": "2000", "spark.sql.files.openCostInBytes": "0"}
    old = {k: spark.conf.get(k) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def replies(n):
    texts = ['plain', 'two\nlines', '"quoted", and\n\n"more"\n', '""', 'a,b', ' "{""Label"": ""Brady""}"', "long " * 300 + "\n" * 40, "é\nü"]
    return [(f"r{i:05d}", "|.:" * (i % 5), "Brady", None if i % 7 == 0 else "Normal", i % 2 == 0, texts[i % len(texts)]) for i in range(n)]


def test_one_large_file_by_many_tasks(spark, tmp_dir, small_ranges):
    path = os.path.join(tmp_dir, "p.csv")
    rows = replies(900)
    io.write_predictions_csv(spark.createDataFrame(rows, SCHEMA).coalesce(1), path)
    assert len([f for f in os.listdir(path) if f.endswith(".csv")]) == 1
    whole = spark.read.options(**io.CSV_OPTIONS).schema(SCHEMA).csv(path)
    assert whole.rdd.getNumPartitions() == 1
    lines = quoted_csv.numbered_lines(spark, path)
    assert lines.select("file", "range").distinct().count() > 50
    assert lines.select("range", "line").count() > 5000
    got = io.read_predictions_csv(spark, path)
    assert Counter(got.collect()) == Counter(whole.collect())
    # CSV has one spelling for null and empty
    assert Counter(tuple(r) for r in got.collect()) == Counter(tuple(v if v != "" else None for v in r) for r in rows)


def test_examples_keep_their_order_over_ranges_and_files(spark, tmp_dir, small_ranges):
    path = os.path.join(tmp_dir, "m")
    os.mkdir(path)
    want = []
    for f in ("a.csv", "b.csv", "c.csv"):
        with open(os.path.join(path, f), "w", newline="") as out:
            out.write('note,sequence,label,"odd name"\r\n')
            for i in range(200 if f != "b.csv" else 0):
                out.write(f'"{f}\n\n{i}","{i % 3 * "|"}",Brady,x\r\n' + "\r\n" * (i % 11 == 0))
                want.append(f"{f}\n\n{i}")
    got = io.read_examples_csv(spark, path).orderBy("file_pos").collect()
    assert [r.note for r in got] == want and [r.file_pos for r in got] == list(range(len(want)))
    assert set(got[0].asDict()) == {"note", "sequence", "label", "odd name", "file_pos"}


@settings(max_examples=12, deadline=None)
@given(st.lists(st.tuples(st.text(alphabet='a",\n\r é', max_size=12), st.text(alphabet='b"\n x', max_size=30)), min_size=1, max_size=12),
       st.integers(1, 40))
def test_any_fields_in_any_ranges(spark, tmp_path_factory, rows, size):
    import csv
    path = str(tmp_path_factory.mktemp("csv") / "f.csv")
    with open(path, "w", newline="") as out:
        w = csv.writer(out, quoting=csv.QUOTE_ALL, lineterminator="\n")
        w.writerow(["a", "b"])
        w.writerows(rows)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
    try:
        got = [(r.a or "", r.b or "") for r in quoted_csv.read_quoted_csv(spark, path).orderBy("_record").collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == rows


def test_headers_must_agree(spark, tmp_dir):
    for name, head in (("a.csv", "x,y"), ("b.csv", "x,z")):
        with open(os.path.join(tmp_dir, name), "w") as out:
            out.write(head + "\n1,2\n")
    with pytest.raises(ValueError, match="headers"):
        quoted_csv.read_quoted_csv(spark, tmp_dir)


def test_empty_file(spark, tmp_dir):
    path = os.path.join(tmp_dir, "e.csv")
    open(path, "w").close()
    assert quoted_csv.read_quoted_csv(spark, path).count() == 0
