"""Rendered chats and loss masks on tokens with offsets."""

import hashlib

import pytest
from pyspark.sql import functions as F

from sigeval.operators import arrays as J
from sigeval.operators import render as R
from sigeval.sources import io

SCHEMA = "conv_id bigint, turn bigint, role string, text string, folder string"


def chat(rows):
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
    turns = "".join(f"<start_of_turn>{'model' if r[2] == 'assistant' else r[2] or ''}\n{r[3] or ''}<end_of_turn>\n" for r in rows)
    return f"<bos>{turns}<start_of_turn>model\n"


def test_parts_join_to_the_chat(spark, tmp_dir):
    rows = [(1, 0, "user", "a\nb"), (1, 1, "assistant", 'q"'), (1, 9, "user", "x"), (None, 5, "user", "n"), (None, None, None, None),
            (2, 3, "user", ""), (3, 0, "user", "r"), (3, 0, "user", "r"), *[(7, i, "user", f"turn {i}") for i in range(3000)]]
    table = spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)
    parts = R.chat_parts(table, part_turns=3)
    io.write_chats(parts, f"{tmp_dir}/chats")
    back = io.read_chats(spark, f"{tmp_dir}/chats")
    index = {r.conv_id: r for r in io.chat_index(back).collect()}
    got = {}
    for r in back.orderBy("part").collect():
        got.setdefault(r.conv_id, []).append(r)
    assert set(got) == set(index) == {1, None, 2, 3, 7}
    for conv, found in got.items():
        text = "".join(r.text for r in found)
        assert text == chat([r for r in rows if r[0] == conv])
        digests = "\n".join(hashlib.sha256(r.text.encode()).hexdigest() for r in found)
        assert index[conv].bytes == len(text.encode()) and index[conv].n_parts == len(found)
        assert index[conv].sha256 == hashlib.sha256(digests.encode()).hexdigest()
        assert all(r.folder == int(index[conv].path.split("=")[1]) for r in found)
    assert len(got[7]) == 1000 and max(r.n_turns for r in got[7]) == 3


def test_a_long_chat_is_written_by_several_tasks(spark, tmp_dir):
    table = spark.range(40_000).select(F.lit(1).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.lit("user").alias("role"),
                                       F.repeat(F.lit("word "), 40).alias("text"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        io.write_chats(R.chat_parts(table, part_turns=64), f"{tmp_dir}/long")
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    rows = io.read_chats(spark, f"{tmp_dir}/long").groupBy(F.col("_metadata.file_name")).count().collect()
    assert len(rows) >= 6 and max(r["count"] for r in rows) < 300     # of 625 parts


def test_empty_conversations(spark):
    assert R.chat_parts(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("crossing,want", [("mask", 3), ("keep", 2)])
def test_a_token_across_the_border(spark, crossing, want):
    row = spark.createDataFrame([("x", "ab cd\n{e}", 6)], "id string, text string, border int")
    got = J.tokens(row, "text", "border", crossing=crossing).first()
    assert got.tokens == ["ab", " cd", "\n{", "e", "}"] and got.n_masked == want
    spans = J.token_spans_udf(lambda: lambda s: [(5, 0, 2), (6, 3, 5), (7, 5, 7), (8, 7, 8)])
    n = row.select(J.masked_spans(spans("text"), F.col("border"), crossing).alias("n")).first().n
    assert n == want


def test_windows_have_every_branch(spark):
    rows = spark.createDataFrame([("x", "ab cd\n{e}", 6), ("y", "q", 1)], "id string, text string, border int")
    toks = J.tokens(rows, "text", "border")
    vocab = {r.token: r.token_id for r in J.fit_vocabulary(toks).collect()}
    assert sorted(vocab.values()) == list(range(J.RESERVED, J.RESERVED + len(vocab)))
    w = J.windows(J.encode(toks, J.fit_vocabulary(toks)), 5, image_slots=2)
    got = {(r.id, r.window): (r.ids, r.labels) for r in w.select(
        "id", "window", "ids", J.window_labels("ids", "n_masked", "window", 5).alias("labels")).collect()}
    v = vocab
    assert got["x", 0] == ([1, 2, 2, v["ab"], v[" cd"]], [-100] * 5)
    assert got["x", 1] == ([v["\n{"], v["e"], v["}"], 0, 0], [-100, v["e"], v["}"], -100, -100])
    assert got["y", 0] == ([1, 2, 2, v["q"], 0], [-100] * 5) and len(got) == 3


def test_a_real_tokenizer_gives_spans(spark):
    tokenizers = pytest.importorskip("tokenizers")
    vocabulary = pytest.importorskip("public_tokenizers")
    path = vocabulary.path("byte_bpe_50k.json")

    def factory():
        tok = tokenizers.Tokenizer.from_file(path)

        def spans(text):
            e = tok.encode(text)
            return [(i, a, b) for i, (a, b) in zip(e.ids, e.offsets)]
        return spans

    prompt, completion = "Classify:\n", '{"Label": "Brady"}'
    row = spark.createDataFrame([(prompt + completion, len(prompt))], "text string, border int")
    got = row.select(J.token_spans_udf(factory)("text").alias("s"), "border").select(
        "s", J.masked_spans("s", F.col("border")).alias("n")).first()
    assert 0 < got.n < len(got.s) and got.s[got.n].start >= len(prompt) > got.s[got.n - 1].start
