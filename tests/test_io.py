import json
import os

import pytest
from pyspark.sql import functions as F

from sigeval.sources import io


def test_csv_missing_label(spark, tmp_dir):
    p = os.path.join(tmp_dir, "m.csv")
    with open(p, "w") as f:
        f.write("id,sequence\na,..|\n")
    with pytest.raises(ValueError, match="label"):
        io.read_examples_csv(spark, p)
    with pytest.raises(FileNotFoundError):
        io.read_examples_csv(spark, os.path.join(tmp_dir, "absent.csv"))


def test_csv_reads_by_name(spark, tmp_dir):
    p = os.path.join(tmp_dir, "m.csv")
    with open(p, "w") as f:
        f.write("label,total_picos,sequence,id\nBrady,2,|:.,t_0000\n")
    r = io.read_examples_csv(spark, p).collect()[0]
    assert (r.sequence, r.label, r.total_picos) == ("|:.", "Brady", 2)


def test_predictions_roundtrip_quotes_newlines(spark, tmp_dir):
    raw = 'He said "Tachy"\nthen, maybe "Brady"'
    df = spark.createDataFrame([("i1", "|", "Tachy", "Tachy", True, raw)], io.PREDICTION_SCHEMA)
    out = os.path.join(tmp_dir, "pred")
    io.write_predictions_csv(df, out)
    back = io.read_predictions_csv(spark, out).collect()[0]
    assert back.raw_response == raw and back.correct is True


def test_metadata_id_above_9999(spark):
    df = spark.createDataFrame([(12345, "|", "Brady"), (7, ":", "Brady")], "dataset_pos long, sequence string, label string")
    ids = sorted(r.id for r in io.metadata_frame(df, "name").collect())
    assert ids == ["name_0007", "name_12345"]


def test_tsv_roundtrip_and_bad_line(spark, tmp_dir):
    p = os.path.join(tmp_dir, "d.tsv")
    with open(p, "w") as f:
        f.write("..|\tBrady\n\n|:|\tTachy\n")
    got = [tuple(r) for r in io.read_tsv(spark, p).collect()]
    assert got == [("..|", "Brady"), ("|:|", "Tachy")]
    bad = os.path.join(tmp_dir, "bad.tsv")
    with open(bad, "w") as f:
        f.write("..|\tBrady\textra\n")
    with pytest.raises(Exception):
        io.read_tsv(spark, bad).collect()


def test_jsonl_pairs(spark, tmp_dir):
    p = os.path.join(tmp_dir, "s.jsonl")
    sample = {"sequence": "|..:", "concepts": {"C1_picos_estrechos": 1, "C2_picos_anchos": 1,
              "C3_pct_ruido": 0.0, "C4_irregularidad": 0.0, "C5_artefactos_significativos": False},
              "fc_class": "Brady", "rr_intervals": [3.0],
              "metadata": {"target_fc_class": "Brady", "peak_positions": [[0, "|"], [3, ":"]]}}
    with open(p, "w") as f:
        f.write(json.dumps(sample) + "\n")
    r = io.read_samples_jsonl(spark, p).collect()[0]
    assert [(x.pos, x.kind) for x in r.metadata.peak_positions] == [(0, "|"), (3, ":")]
    out = os.path.join(tmp_dir, "s2")
    io.write_samples_jsonl(io.read_samples_jsonl(spark, p), out)
    again = io.read_samples_jsonl(spark, out).collect()[0]
    assert again.metadata.peak_positions == r.metadata.peak_positions


def test_training_config_fallback(spark, tmp_dir):
    assert io.read_training_config(spark, os.path.join(tmp_dir, "none"), "D").collect()[0].system_prompt == "D"
    p = os.path.join(tmp_dir, "cfg.json")
    with open(p, "w") as f:
        f.write(json.dumps({"model_name": "m"}) + "\n")
    assert io.read_training_config(spark, p, "D").collect()[0].system_prompt == "D"


def test_partitioned_overwrite(spark, tmp_dir):
    out = os.path.join(tmp_dir, "parts")
    df = spark.createDataFrame([("a", "train"), ("b", "test")], "id string, split string")
    io.write_partitioned(df, out)
    io.write_partitioned(spark.createDataFrame([("c", "test")], "id string, split string"), out)
    got = sorted(tuple(r) for r in spark.read.parquet(out).select("id", "split").collect())
    assert got == [("a", "train"), ("c", "test")]
    assert [r.id for r in io.select_split(spark.read.parquet(out), "test").collect()] == ["c"]


def test_templates_table(spark):
    from sigeval.operators.render import TEMPLATE_DIR
    t = io.read_templates(spark, str(TEMPLATE_DIR))
    got = {(r.task, r.approach, r.prompt_type) for r in t.collect()}
    assert (1, "regular", "system_prompt") in got and (1, "cbm", "user_prompt_few_shot") in got
    assert len(got) == 6


def test_image_folder(spark, tmp_dir):
    for cls, n in (("b_cls", 2), ("a_cls", 1)):
        os.makedirs(os.path.join(tmp_dir, "img", cls))
        for i in range(n):
            with open(os.path.join(tmp_dir, "img", cls, f"{i}.png"), "wb") as f:
                f.write(b"\x89PNG" + bytes([i]))
    got = sorted((r.class_name, r.label) for r in io.read_image_folder(spark, os.path.join(tmp_dir, "img")).collect())
    assert got == [("a_cls", 0), ("b_cls", 1), ("b_cls", 1)]
