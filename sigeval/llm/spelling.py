"""Spelling variant grouping by reduced-alphabet generation.

Two words are near if one inserted, deleted or replaced code point makes one of the
other. A near pair stays near, or becomes equal, when every letter is replaced by
one of a few symbols. So:

1. Letters are hashed to ``k`` symbols, and the distinct reduced words are listed.
2. Every reduced word generates its full one-edit neighbourhood over the symbols,
   itself included: about ``(2 k + 1) * length`` keys instead of the
   ``181 * length`` of the 90 letters.
3. The keys are joined with the list of reduced words, which drops nearly all.
4. The words behind both sides are joined on, and verified on the letters.

A word finds each near word exactly once, by their one pair of reduced words. With
``k`` at the sixth root of the vocabulary's size (words have six letters or more), a
reduced word stands for about one word at every size, so candidates grow with the
vocabulary and not with its square. No task sees more than one word's
neighbourhood at a time; what is hot is a join row, which adaptive joins split.

A word's form is its most frequent near word if that is ``ratio`` times as frequent;
forms are followed by pointer doubling. Counts rise ``ratio``-fold with every step,
so a chain has at most ``log_ratio(max n)`` links, which gives the number of rounds.

Defined results: null texts have no words, a null id counts as the empty string;
every row is counted, repeated or not; an empty table gives an empty result; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
import zlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, text_or_empty

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
RUN = "[A-Za-zÀ-ÿ]+"                                # fixed value
LETTERS = LOWER + "".join(map(chr, range(0xC0, 0x100)))       # what runs hold after lower-casing
LEAST_SYMBOLS = 4


def occurrences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", spoil_every: int = 199) -> DataFrame:
    """One row ``word`` per run of letters, lower-cased in A-Z. Of each run whose
    crc32 with its document's id ``spoil_every`` divides, one letter is lost."""
    runs = docs.select(
        F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("_id"),
        F.explode(F.regexp_extract_all(F.translate(text_or_empty(text_col), UPPER, LOWER), F.lit(RUN), 0)).alias("_run"))
    h, size = F.crc32(F.concat("_id", F.lit(":"), "_run")), F.length("_run")
    at = (h % size).cast("int")
    run = F.col("_run")
    spoiled = F.concat(run.substr(F.lit(1), at), run.substr(at + 2, size))
    return runs.select(F.when(h % spoil_every == 0, spoiled).otherwise(run).alias("word"))


def vocabulary(words: DataFrame, least_length: int = 6, least_count: int = 5) -> DataFrame:
    """(word, n) of the words long and frequent enough; partial counts per task
    before the shuffle."""
    return (words.where(F.length("word") >= least_length).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
            .where(F.col("n") >= least_count))


def symbols_for(n_words: int) -> str:
    """The ``k`` symbols for a vocabulary of this size: its sixth root."""
    k = max(LEAST_SYMBOLS, math.ceil(n_words ** (1 / 6)))
    return LETTERS[:min(k, len(LETTERS))]


def reduced(word: Column, symbols: str) -> Column:
    """``word`` with each letter replaced by the symbol it hashes to."""
    image = "".join(symbols[zlib.crc32(c.encode()) % len(symbols)] for c in LETTERS)
    return F.translate(word, LETTERS, image)


def neighbourhood(word: Column, symbols: str) -> Column:
    """``word`` and all strings one edit from it over ``symbols``, each once."""
    size = F.length(word)
    head = lambda i: word.substr(F.lit(1), i)                 # noqa: E731 - the first i letters
    tail = lambda i: word.substr(i + 1, size)                 # noqa: E731 - all but the first i
    letters = F.array(*map(F.lit, symbols))
    at, between = F.sequence(F.lit(1), size), F.sequence(F.lit(0), size)
    deleted = F.transform(at, lambda i: F.concat(head(i - 1), tail(i)))
    replaced = F.transform(at, lambda i: F.transform(letters, lambda c: F.concat(head(i - 1), c, tail(i))))
    inserted = F.transform(between, lambda i: F.transform(letters, lambda c: F.concat(head(i), c, tail(i))))
    return F.array_distinct(F.concat(deleted, F.flatten(replaced), F.flatten(inserted)))


def near_pairs(vocab: DataFrame, n_words: int) -> DataFrame:
    """(word, n, other, other_n) for every ordered pair of near words of ``vocab``."""
    symbols = symbols_for(n_words)
    coded = materialize(vocab.select("word", "n", reduced(F.col("word"), symbols).alias("code")), "spelling-codes")
    codes = coded.select("code").distinct()
    keys = codes.select("code", F.explode(neighbourhood(F.col("code"), symbols)).alias("other_code"))
    met = keys.join(codes.select(F.col("code").alias("other_code")), "other_code", "left_semi")
    others = coded.select(F.col("word").alias("other"), F.col("n").alias("other_n"), F.col("code").alias("other_code"))
    return (met.join(coded, "code").join(others, "other_code")
            .where(F.levenshtein("word", "other", 1) == 1).select("word", "n", "other", "other_n"))


def roots(forms: DataFrame, rounds: int) -> DataFrame:
    """(word, root): ``forms`` (word, form) followed to the last, doubling the
    distance in each round."""
    links = forms.select("word", F.col("form").alias("root"))
    for i in range(rounds):
        onward = links.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        links = materialize(links.join(onward, "root", "left").select(
            "word", F.coalesce("_next", "root").alias("root")), f"spelling-roots-{i}")
    return links


def variants(words: DataFrame, least_length: int = 6, least_count: int = 5, ratio: int = 5) -> DataFrame:
    """``words`` (word) -> (word, form, root, n, n_near, form_n) for each word that
    is long and frequent enough."""
    vocab = materialize(vocabulary(words, least_length, least_count), "spelling-words")
    size = vocab.agg(F.count(F.lit(1)).alias("words"), F.max("n").alias("n")).first()
    # the greatest n decides; of equal ones the least in code-point order
    best = F.min(F.struct((-F.col("other_n")).alias("_order"), F.col("other"), F.col("other_n")))
    near = (near_pairs(vocab, size.words).groupBy("word", "n").agg(F.count(F.lit(1)).alias("n_near"), best.alias("best"))
            .select("word", "n_near", F.when(F.col("best.other_n") >= ratio * F.col("n"), F.col("best")).alias("best")))
    judged = materialize(vocab.join(near, "word", "left").select(
        "word", F.col("best.other").alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"),
        F.col("best.other_n").alias("form_n")), "spelling-forms")
    links = max(1, math.ceil(math.log(max(size.n or 1, 2), ratio)))
    root = roots(judged.where("form is not null").select("word", "form"), math.ceil(math.log2(links)))
    return judged.join(root, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
