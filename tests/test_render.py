from pyspark.sql import functions as F

from sigeval.operators import render as R


def test_fill_template_braces_and_values(spark):
    df = spark.createDataFrame([("{examples} in value",)], "s string")
    r = df.select(R.fill_template("A {{x}} {sequence}!", sequence=F.col("s")).alias("t")).collect()[0]
    assert r.t == "A {x} {examples} in value!"


def test_example_regular_format(spark):
    df = spark.createDataFrame([("|:..|", "Brady")], "s string, l string")
    r = df.select(R.example_regular("s", "l", F.lit(3)).alias("e")).collect()[0]
    assert r.e == ("Example 3:\nSequence: |:..|\nNarrow peaks (|): 2\nWide peaks (:): 1\n"
                   "Total peaks: 3\nClassification: Brady")


def test_few_shot_block_and_zero_shot_fallback(spark):
    ex = spark.createDataFrame([("b", "..|", "Brady", "k2"), ("a", "|:", "Tachy", "k1")],
                               "id string, sequence string, label string, shuffle_key string")
    blk = R.few_shot_block(ex).collect()[0]
    assert blk.n_examples == 2 and blk.examples.startswith("Example 1:\nSequence: |:")
    assert "\n\nExample 2:\nSequence: ..|" in blk.examples
    empty = R.few_shot_block(ex.limit(0)).collect()[0]
    assert empty.n_examples == 0 and empty.examples == ""
    t = spark.createDataFrame([("...",)], "s string")
    r = t.select(R.user_prompt(F.col("s"), "Z {sequence}", "F {examples} {sequence}", F.lit("")).alias("p")).collect()[0]
    assert r.p == "Z ..."


def test_merge_system_and_pieces(spark):
    conv = spark.createDataFrame([
        (1, 0, "system", "Be brief."), (1, 1, "user", "Hi"), (1, 2, "assistant", "Hello"),
        (2, 0, "user", "Q"), (2, 1, "assistant", "A"),
        (3, 0, "system", "Alone"),
    ], "conv_id long, turn long, role string, text string")
    got = sorted(tuple(r) for r in R.merge_system(conv).collect())
    assert got == [(1, 1, "user", "Be brief.\n\nHi"), (1, 2, "assistant", "Hello"),
                   (2, 0, "user", "Q"), (2, 1, "assistant", "A"), (3, 0, "system", "Alone")]
    chat = {r.conv_id: r.chat for r in R.assemble_chat(R.chat_turn_pieces(conv)).collect()}
    assert chat[2] == ("<bos><start_of_turn>user\nQ<end_of_turn>\n<start_of_turn>model\nA<end_of_turn>\n"
                       "<start_of_turn>model\n")


def test_merge_system_gaps_and_nulls(spark):
    conv = spark.createDataFrame([
        (1, 0, "system", "S"), (1, 3, "user", "after a gap"), (1, 5, "user", "later"),
        (2, 0, None, "no role"), (2, None, "user", "no turn"), (2, 1, "user", "x"),
        (None, 0, "system", "N"), (None, 1, "user", None),
        (4, 0, "system", None), (4, 2, "assistant", "a"), (4, None, None, None),
    ], "conv_id long, turn long, role string, text string")
    got = {tuple(r) for r in R.merge_system(conv).collect()}
    assert got == {(1, 3, "user", "S\n\nafter a gap"), (1, 5, "user", "later"),
                   (2, 0, None, "no role"), (2, None, "user", "no turn"), (2, 1, "user", "x"),
                   (None, 1, "user", "N\n\n"), (4, 2, "user", "\n\na"), (4, None, None, None)}
    assert R.merge_system(conv.where("false")).count() == 0


def test_tuned_prompt_and_records(spark):
    df = spark.createDataFrame([("|:.", "Brady")], "sequence string, label string")
    r = df.select(R.tuned_prompt(F.col("sequence"), "SYS").alias("p"),
                  R.chat_record(F.col("sequence"), F.col("label"), "SYS").alias("m")).collect()[0]
    assert r.p == "<bos><start_of_turn>user\nSYS\n\nSequence: |:.<end_of_turn>\n<start_of_turn>model\n"
    assert [m.role for m in r.m] == ["system", "user", "assistant"]
    assert r.m[1].content == "Sequence: |:."


def test_checks(spark):
    import pytest
    with pytest.raises(ValueError):
        R.check_task(4)
    with pytest.raises(ValueError):
        R.check_approach("other")
    with pytest.raises(FileNotFoundError):
        R.load_prompt("regular", "system_prompt", task=3)
    assert "{sequence}" in R.load_prompt("regular", "user_prompt_zero_shot")
