from pyspark.sql import functions as F

from sigeval.operators import parse as P


def parsed(spark, replies, fn):
    df = spark.createDataFrame([(r,) for r in replies], "r string")
    return [x.p for x in df.select(fn(F.col("r")).alias("p")).collect()]


def test_keyword_priority_and_substring(spark):
    got = parsed(spark, ["tachy, not brady", "abnormal rhythm", "nothing", "  NORMAL\n"], P.parse_keyword)
    assert got == ["Brady", "Normal", None, "Normal"]


def test_null_reply(spark):
    df = spark.createDataFrame([(None, "Brady")], "r string, label string")
    r = df.select(F.coalesce(P.parse_keyword("r"), F.lit("Unknown")).alias("icl"),
                  P.parse_embedded_json("r").alias("ft")).collect()[0]
    assert r.icl == "Unknown" and r.ft is None
    r2 = df.select(P.correct_icl(F.lit("Unknown"), F.col("label")).alias("a"),
                   P.correct_tuned(F.lit(None).cast("string"), F.col("label")).alias("b")).collect()[0]
    assert r2.a is False and r2.b is False


def test_fenced_json(spark):
    body = '{"conceptos": {"a": 1}, "fc_clase": "Tachy"}'
    replies = [
        "see:\n```json\n" + body + "\n```",
        "```\n" + body + "\n```",
        "```json\n" + body,                 # unclosed -> null
        body,                               # no fence, whole reply parses
        '{"fc_clase": "Tachy"}',            # missing conceptos
        "```only one fence",
        "5",
    ]
    assert parsed(spark, replies, P.parse_fenced_json) == ["Tachy", "Tachy", None, "Tachy", None, None, None]


def test_embedded_json(spark):
    replies = ['{"x": 1} Tachy', '{"Label": "tachy"}', '{"Label": null}',
               'text {"Label": "Normal", "n": {"a": 1}} more', "{broken", "nothing here"]
    assert parsed(spark, replies, P.parse_embedded_json) == ["Tachy", "tachy", None, "Normal", None, None]


def test_label_case_counts_incorrect(spark):
    df = spark.createDataFrame([('{"Label": "tachy"}', "Tachy")], "r string, label string")
    r = df.select(P.correct_tuned(P.parse_embedded_json("r"), F.col("label")).alias("c")).collect()[0]
    assert r.c is False


def test_choice_and_exact(spark):
    replies = ["C: gamma", "(C) gamma", "D: delta or C: gamma", "No idea.", "B: beta "]
    assert parsed(spark, replies, P.parse_choice) == [2, 2, 2, -1, 1]
    assert parsed(spark, replies, P.parse_exact) == [2, -1, -1, -1, -1]


def test_completion_label(spark):
    assert parsed(spark, ['{"Narrow_peaks": 1, "Label": "Brady"}'], P.completion_label) == ["Brady"]
