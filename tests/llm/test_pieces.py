"""Pieces against the sentencepiece library."""

import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from sigeval.llm import pieces

MODEL = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=MODEL)
SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, ids long, decoded string, n_tokens string"
ODD = ["", " ", "  ", "   a", "a  b", " a b ", "a\nb", "a \nb", "a\n b\n", "\n", "\n\n\nx\n", "▁x", "x▁ ▁y▁", "▁", "\x00a\x01", "é́ ﬁ １",
       "\ta b\r\n", "🙂 x🙂🙂", "<0xE4> <s> </s> <unk> <0x0A>", "日本語のテキスト 漢字", " 　﻿", "aaaaaaaaaaaaaaaaaaaaaa",
       "ababababababa", "the thethethe", " " * 77 + "x" + " " * 40, "_" * 63 + "=" * 41, "\U0010ffff", "ＡＢ½①", "naïve ςΣ ẞ"]


def check(texts):
    v = pieces.vocabulary(MODEL)
    got = v.encode(texts, 2)
    want = [LIBRARY.encode(t, add_eos=True) for t in texts]
    for t, a, b in zip(texts, got, want):
        assert a.tolist() == b, t
    assert v.decode(got) == [LIBRARY.decode(ids) for ids in want]


def test_odd_texts():
    check(ODD)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text(st.one_of(st.sampled_from("ab e\n▁th<0xin>.  "), st.characters(exclude_categories=["Cs"])), max_size=60),
                min_size=1, max_size=6))
def test_random_texts(texts):
    check(texts)


def test_repetitive_words_of_every_piece():
    """Runs and mixtures of pieces, where the order of merges shows most."""
    v = pieces.vocabulary(MODEL)
    names = [n for i, n in enumerate(v.names) if not LIBRARY.is_control(i) and not LIBRARY.is_byte(i)]
    check([n.replace("▁", " ") * 7 for n in names[::7]])
    rng = np.random.default_rng(3)
    check(["".join(names[i] for i in rng.integers(1, len(names), 30)).replace("▁", "") for _ in range(3000)])
    check(["".join(rng.choice(list("aeinorst"), 60)) for _ in range(2000)])


def test_a_very_long_word():
    rng = np.random.default_rng(4)
    check(["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz0123456789+/"), 30_000)), "ab" * 40_000, "x" * 100_001])


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 31_999)), max_size=25), min_size=1, max_size=5))
def test_decoding_any_ids(sequences):
    v = pieces.vocabulary(MODEL)
    assert v.decode([np.array(s, np.int32) for s in sequences]) == [LIBRARY.decode(s) for s in sequences]


def test_a_forgetful_worker_gives_the_same_ids(monkeypatch):
    monkeypatch.setattr(pieces, "MEMO_WORDS", 3)
    monkeypatch.setattr(pieces, "BATCH_WORDS", 2)
    for _ in range(3):
        check(["one two three four five six", "six five four", "seven"])


def expected(doc, text):
    ids = LIBRARY.encode(text or "", add_eos=True)
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return doc, len(ids), digest(" ".join(map(str, ids))), digest(LIBRARY.decode(ids))


def test_documents(spark):
    rows = [(i, t) for i, t in enumerate(ODD)] + [(None, None), (1, None), (1, "again again"), (1, "again again"),
                                                 (9, "very long text " * 60_000), (None, "no id")]
    table = spark.createDataFrame([(*r, 1, "x", "y") for r in rows], SCHEMA)
    got = pieces.digests(pieces.encode_documents(table, MODEL))
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert Counter(map(tuple, got.collect())) == Counter(expected(*r) for r in rows)


def test_small_table(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    got = pieces.digests(pieces.encode_documents(docs, MODEL)).collect()
    assert Counter(map(tuple, got)) == Counter(expected(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())


def test_empty_table(spark):
    table = spark.createDataFrame([], SCHEMA)
    assert pieces.digests(pieces.encode_documents(table, MODEL)).count() == 0


def test_other_models_are_refused(tmp_path):
    with pytest.raises(Exception):
        pieces.Vocabulary(str(tmp_path / "absent.model"))
