import json
import os

from pyspark.sql import functions as F

from sigeval.operators import arrays as J
from sigeval.operators import metrics as M
from sigeval.operators import parse as P
from sigeval.operators import render as R
from sigeval.operators.complete import RuleClient, complete_batch, persist_completions
from sigeval.sources import io


def test_append_turn(spark):
    df = spark.createDataFrame([([("user", "hi")],)], "m array<struct<role:string,content:string>>")
    r = df.select(R.append_turn("m", "model", F.lit("{}")).alias("m")).collect()[0]
    assert [(x.role, x.content) for x in r.m] == [("user", "hi"), ("model", "{}")]


def test_render_through_template(spark):
    df = spark.createDataFrame([([("user", "hi"), ("assistant", "yo")],)],
                               "m array<struct<role:string,content:string>>")
    r = df.select(R.TURN_TEMPLATE.render(F.col("m"), add_generation_prompt=False).alias("t")).collect()[0]
    assert r.t == "<bos><start_of_turn>user\nhi<end_of_turn>\n<start_of_turn>model\nyo<end_of_turn>\n"


def test_strict_json_and_concepts_payload(spark):
    df = spark.createDataFrame([('{"a": 1}',), ("{'a': 1}",), ('{"a": 1} x',), (None,)], "r string")
    got = [r.v for r in df.select(P.strict_json_valid("r").alias("v")).collect()]
    assert got == [True, False, False, None]
    rep = spark.createDataFrame([('```json\n{"conceptos": {"C1": 2}, "fc_clase": "Brady"}\n```',)], "r string")
    c = rep.select(P.parse_fenced_concepts("r").alias("c")).collect()[0].c
    assert json.loads(c) == {"C1": 2}


def test_pluggable_tokenizer(spark):
    df = spark.createDataFrame([("a b c",), (None,)], "t string")
    ids = J.token_ids_udf(lambda: (lambda s: [len(w) for w in s.split()]))
    got = [r.i for r in df.select(ids("t").alias("i")).collect()]
    assert got == [[1, 1, 1], None]
    counted = M.token_share(spark.createDataFrame([("a b", "c")], "prompt string, completion string"))
    r = counted.collect()[0]
    assert (r.prompt_tokens, r.completion_tokens, r.completion_share) == (2, 1, 33.333333)


def test_persist_completions_is_stable(spark):
    calls = spark.sparkContext.accumulator(0)

    class Counting(RuleClient):
        def predict(self, messages, max_tokens=500):
            calls.add(1)
            return super().predict(messages, max_tokens)

    df = spark.createDataFrame([(str(i), [("user", "Strip: ||..:")]) for i in range(6)],
                               "id string, messages array<struct<role:string,content:string>>")
    done = persist_completions(complete_batch(df, Counting, num_slots=3))
    first = calls.value
    assert done.count() == 6 and done.where("error is null").count() == 6
    assert calls.value == first == 6   # later actions read the checkpoint


def test_metrics_and_summary_sinks(spark, tmp_dir):
    pred = spark.createDataFrame([("1", "Brady", True), ("2", "Tachy", False)],
                                 "id string, label string, correct boolean")
    out = os.path.join(tmp_dir, "metrics")
    io.write_metrics_csv(M.metrics_long(pred, 1, 2, "regular", True, "m"), out)
    back = spark.read.option("header", "true").csv(out).collect()
    assert back[0].metric == "Overall Accuracy" and len(back) == 17
    assert {r.metric: r.value for r in back}["OOD"] == "True"
    sj = os.path.join(tmp_dir, "summary")
    io.write_summary_json(M.run_summary(pred, task=1, n_shots=2), sj)
    s = spark.read.json(sj).collect()[0]
    assert s.total_samples == 2 and s.per_class.Brady.correct == 1
