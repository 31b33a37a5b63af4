"""Spelling variants against a plain model that compares all pairs of words."""

import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sigeval.llm import spelling as S

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, word string, n long, code string, form string"


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    return a[i + 1:] == b[i + 1:] if len(a) == len(b) else a[i + 1:] == b[i:] if len(a) > len(b) else a[i:] == b[i + 1:]


def spoilt(doc, run):
    h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
    at = h % len(run)
    return run[:at] + run[at + 1:] if h % 199 == 0 else run


def naive(rows):
    counts = Counter(spoilt(d, re.sub("[A-Z]", lambda m: m[0].lower(), run))
                     for d, text in rows for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""))
    words = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    near = {w: [v for v in words if one_edit(w, v)] for w in words}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 5 * words[w] else None
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        yield w, form[w], root, words[w], len(near[w]), words.get(form[w])


def check(spark, rows):
    table = spark.createDataFrame([(*r, "x", 1, "y", "z") for r in rows], SCHEMA)
    got = S.variants(S.occurrences(table))
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    rows_got = got.collect()
    assert Counter(map(tuple, rows_got)) == Counter(naive(rows))
    return rows_got


def test_small_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    assert len(check(spark, rows)) > 100


def test_chains_ties_and_letters(spark):
    # aaaaaa <- aaaaab <- aaaabb <- aaabbb, five times rarer at each step; ties; letters beyond ASCII
    rows = [(1, "aaaaaa " * 700), (2, "Aaaaab " * 130), (3, "aaaabb " * 25), (4, "aaabbb " * 5), (None, None), (5, ""),
            (6, "zebrax zebray " * 30 + "zebraz " * 6), (6, "zebraz " * 0), (None, "straße straßen Straße " * 6),
            (7, "ÉTOILÉ " * 40 + "étoilé " * 5 + "ÉTOILé " * 8), (8, "short words are left out " * 9), (9, "long" * 20_000),
            (10, "×÷×÷×÷ " * 5 + "×÷×÷×× " * 30), (11, "\x00 12 abcdef9abcdeg_abcdeh " * 5), (12, "𝔘nicode ñandúes " * 7)]
    got = {r.word: r for r in check(spark, rows)}
    assert got["aaabbb"].root == "aaaaaa" and got["aaabbb"].form == "aaaabb"
    assert got["zebraz"].form == "zebrax"


def test_spoiled_runs_lose_a_letter(spark):
    doc, run = next((d, r) for d in range(4000) for r in ["mountain"] if zlib.crc32(f"{d}:{r}".encode()) % 199 == 0)
    got = check(spark, [(doc, "mountain " * 6), (doc + 1, "mountain " * 40)])
    assert len(got) == 2


def test_empty_table(spark):
    table = spark.createDataFrame([], SCHEMA)
    assert S.variants(S.occurrences(table)).count() == 0


@pytest.mark.parametrize("n_words", [1, 4000, 10 ** 9])
def test_every_near_pair_meets(spark, n_words):
    """Whatever the number of symbols, all near pairs and only they are found."""
    words = ["abcdef", "abcde", "abcdefg", "xbcdef", "abxdef", "abdef", "ééééé", "éééééé", "éééèéé", "aabbcc", "aabcc", "zzzzzz"]
    vocab = spark.createDataFrame([(w, 1) for w in words], "word string, n long")
    got = {(r.word, r.other) for r in S.near_pairs(vocab, n_words).collect()}
    assert got == {(a, b) for a in words for b in words if one_edit(a, b)}


def test_neighbourhood_is_full(spark):
    symbols = S.symbols_for(1)
    got = spark.createDataFrame([("aab",)], "w string").select(S.neighbourhood(F.col("w"), symbols)).first()[0]
    want = {"aab"} | {"aab"[:i] + "aab"[i + 1:] for i in range(3)}
    want |= {"aab"[:i] + c + "aab"[i + 1:] for i in range(3) for c in symbols}
    want |= {"aab"[:i] + c + "aab"[i:] for i in range(4) for c in symbols}
    assert sorted(got) == sorted(want)
