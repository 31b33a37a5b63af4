"""Licence scan over a positional rare-token index.

The index holds, for every word of the licence templates, its postings
``(template, position)``. A first pass counts over all documents in how many
each template word occurs; that gives the words' IDF. Of each template the places of
highest IDF are looked up in a file; each occurrence of their words votes for
the start that the template would then have. Votes whose starts lie near each
other intersect the postings by relative position, so a word inserted or lost
shifts the votes behind it but does not part them. A stretch with enough votes is
verified: one of the template's mandatory phrases must stand in it, and it must
hold the template's words in their order. Its score is the share of the
template's words that it so holds.

A notice may lack up to ``1 - MIN_SHARE`` of the template's words and have up to
``SPARE_SHARE`` of its length in words between, changed ones aside. So many
places as it may lack, and ``MIN_VOTES`` more, are looked up per template: every
notice that could be verified gets its votes, however many a file has.
Templates of which a file lacks too many words are left out before.

Fixed phrases (:data:`PHRASES`) are found in every file, with or without an
alignment.

The document counts are one small row per template word and task, so the driver
gets at most one number per template word.

Edge cases: null text is empty; repeated and null ids give one row per input
row; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import record_batch, slices, text_or_empty

MIN_VOTES = 2
MIN_SHARE = 0.6           # of a template's words in order
SPARE_SHARE = 0.25        # of a template's length, more words than it has
PHRASE_SCORE = 0.5        # of a file that has only a fixed phrase
# fixed values: phrases and their labels
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
# fixed values: label, short public notice, mandatory phrases (any one of them)
TEMPLATES = (
    ("mit", "released under the mit license", ("mit license",)),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and "
            "associated documentation files to deal in the software without restriction", ("hereby granted free of charge",)),
    ("apache-2.0", "licensed under the apache license version 2 0", ("apache license",)),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the "
                   "license at http www apache org licenses license 2 0", ("in compliance with the license",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided "
            "that the following conditions are met", ("source and binary forms",)),
    ("gpl", "this work is licensed under the gnu general public license version 3", ("gnu general public license",)),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu "
            "general public license as published by the free software foundation", ("general public license",)),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0",
     ("mozilla public license",)),
    ("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license",
     ("creative commons attribution",)),
    ("unlicense", "this is free and unencumbered software released into the public domain",
     ("released into the public domain",)),
)
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: str) -> list[bytes]:
    """Lower-cased (A-Z) runs of digits, letters a-z and non-ASCII characters."""
    return text.encode().translate(_FOLD).split()


class Index:
    """Postings of the template words and their IDF."""

    def __init__(self, templates=TEMPLATES):
        self.labels = [t[0] for t in templates]
        self.words = [words_of(t[1]) for t in templates]
        self.keys = [[words_of(p) for p in t[2]] for t in templates]
        self.postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        for t, ws in enumerate(self.words):
            for i, w in enumerate(ws):
                self.postings[w].append((t, i))
        # words that must stand in order, and the longest stretch that may hold them
        self.least = [math.ceil(MIN_SHARE * len(ws)) for ws in self.words]
        self.reach = [len(ws) + math.ceil(SPARE_SHARE * len(ws)) for ws in self.words]
        self.places: list[dict[bytes, int]] = []        # a word's places in the template as bits
        for ws in self.words:
            bits: dict[bytes, int] = defaultdict(int)
            for i, w in enumerate(ws):
                bits[w] |= 1 << i
            self.places.append(dict(bits))
        self.idf: dict[bytes, float] = {}
        self.rare: dict[bytes, list[tuple[int, int]]] = {}

    def weigh(self, counts: dict[bytes, int], n_docs: int) -> "Index":
        self.idf = {w: math.log((n_docs + 1) / (counts.get(w, 0) + 1)) for w in self.postings}
        self.rare = defaultdict(list)
        for t, ws in enumerate(self.words):
            places = sorted(range(len(ws)), key=lambda i: (-self.idf[ws[i]], ws[i], i))
            for i in places[:len(ws) - self.least[t] + MIN_VOTES]:
                self.rare[ws[i]].append((t, i))
        return self

    def in_order(self, t: int, stretch: list[bytes]) -> int:
        """The most words of template ``t`` that ``stretch`` holds in their order
        (longest common subsequence; the zero bits of ``free`` count it)."""
        full = (1 << len(self.words[t])) - 1
        free = full
        for w in stretch:
            if bits := self.places[t].get(w):
                met = free & bits
                free = ((free + met) | (free - met)) & full
        return len(self.words[t]) - free.bit_count()

    def matches(self, words: list[bytes], present: set[bytes]) -> Iterator[tuple[str, float, int]]:
        """Verified notices ``(label, score, start)``, the best of those that overlap."""
        possible = {t for t, ws in enumerate(self.words) if sum(w in present for w in ws) >= self.least[t]}
        if not possible:
            return
        rare = {w: kept for w in present.intersection(self.rare) if (kept := [x for x in self.rare[w] if x[0] in possible])}
        votes: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for at, w in enumerate(words):
            for t, i in rare.get(w, ()):
                votes[t].append((at, i))
        for t, cast in votes.items():
            reach, lost = self.reach[t], len(self.words[t]) - self.least[t]
            # a stretch begins with a word of the template and holds a mandatory phrase
            starts = {s for key in self.keys[t] for at in phrase_starts(words, key)
                      for s in range(max(0, at + len(key) - reach), at + 1) if words[s] in self.places[t]}
            best: tuple[int, int] | None = None
            for s in sorted(starts):
                near = cast[bisect_left(cast, (s, -1)):bisect_left(cast, (s + reach, -1))]
                # words in order in the stretch vote for starts within these bounds
                agreed = {i for at, i in near if -lost <= at - i - s <= reach - self.least[t]}
                if len(agreed) < MIN_VOTES:
                    continue
                held = self.in_order(t, words[s:s + reach])
                if held < self.least[t]:
                    continue
                if best and s >= best[1] + len(self.words[t]):
                    yield self.labels[t], best[0] / len(self.words[t]), best[1]
                    best = None
                if best is None or held > best[0]:
                    best = held, s
            if best:
                yield self.labels[t], best[0] / len(self.words[t]), best[1]


def phrase_starts(words: list[bytes], phrase: list[bytes]) -> Iterator[int]:
    """Every place where ``phrase`` stands."""
    at = -1
    while True:
        try:
            at = words.index(phrase[0], at + 1)
        except ValueError:
            return
        if words[at:at + len(phrase)] == phrase:
            yield at


PHRASE_WORDS = [(words_of(p), label) for p, label in PHRASES.items()]


def phrase_places(words: list[bytes], present: set[bytes]) -> list[tuple[int, str]]:
    """Start and label of every place where a fixed phrase stands."""
    out = []
    for phrase, label in PHRASE_WORDS:
        if all(w in present for w in phrase):
            out += [(at, label) for at in phrase_starts(words, phrase)]
    return out


def document_counts(docs: DataFrame, vocabulary: list[bytes]) -> tuple[dict[bytes, int], int]:
    """In how many documents each word of ``vocabulary`` occurs, and how many
    documents there are. Counts leave a task as one row per word."""
    schema = pa.schema([("word", pa.binary()), ("n", pa.int64())])
    wanted = frozenset(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for b in slices(batches):
            for text in b.column("text").to_pylist():
                seen.update(wanted.intersection(words_of(text)))
                seen[b""] += 1
        yield record_batch(schema, {"word": list(seen), "n": list(seen.values())})

    rows = (docs.select(text_or_empty().alias("text")).mapInArrow(count, "word binary, n long")
            .groupBy("word").agg(F.sum("n").alias("n")).collect())     # one row per template word
    counts = {bytes(r["word"]): r["n"] for r in rows}
    return counts, counts.pop(b"", 0)


OUT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()),
                 ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()),
                 ("score", pa.float64())])


def scan_text(text: str, index: Index) -> tuple:
    words = words_of(text)
    every = set(words)
    places = phrase_places(words, every)
    starts, base = [p[0] for p in places], sorted({p[1] for p in places})
    found = list(index.matches(words, present)) if (present := every.intersection(index.postings)) else []
    score = max([PHRASE_SCORE * bool(places), *(f[1] for f in found)])
    return (len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(base),
            ",".join(sorted({*base, *(f[0] for f in found)})), float(score))


def scan(docs: DataFrame, templates=TEMPLATES) -> DataFrame:
    """One row per document with its phrases, licence labels and score."""
    index = Index(templates)
    index.weigh(*document_counts(docs, list(index.postings)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            rows = [(doc_id, *scan_text(text, index))
                    for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist())]
            yield record_batch(OUT, dict(zip(OUT.names, map(list, zip(*rows)))))

    return (docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty().alias("text"))
            .mapInArrow(run, "doc_id long, n_words long, n_base long, first_word long, last_word long, "
                             "base_labels string, labels string, score double"))
