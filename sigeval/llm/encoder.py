"""Whole-text encoding with a tokenizer file, remembering the ids of words.

Both supported vocabularies treat a text as a sequence of units that never
influence each other, so the ids of a text are the ids of its units in order.
Units repeat a lot; each worker keeps the ids of those it has met (a bounded
memo) and hands only new units to the tokenizers library. For byte-level BPE the
new units go there as one text, and its ids are cut at the units by the byte
lengths of the tokens.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np

from .common import REMEMBERED

MEMO_UNITS = 1_200_000      # units a worker remembers before it starts afresh

NEW_BYTES = 1 << 16         # text handed to the library at once

_OTHER_SPACE = re.compile(r"[^\S \n]")
_BETWEEN = re.compile(r"(?<=\S) (?=\S)")
_LETTERS = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+")
_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"       # ASCII punctuation but the apostrophe


def spaced_units(text: str) -> list[str]:
    """Byte-level BPE: a single space between two visible characters always
    starts a unit and belongs to it; units after the first are given without it.
    Other white space stays inside units."""
    if "  " in text or " \n" in text or "\n " in text or _OTHER_SPACE.search(text):
        return _BETWEEN.split(text)
    return text.split(" ")


def marked_word(line: str) -> tuple[str, str] | None:
    """A line of letters and then marks, which the library never joins."""
    word = line.rstrip(_MARKS)
    if word.isalpha() and (word.isascii() or _LETTERS.fullmatch(word)):
        return word, line[len(word):]
    return None


def bare_units(text: str) -> list[str]:
    """Word-end BPE: white space separates units and is dropped."""
    return [u for u in text.replace("\n", " ").split(" ") if u]


class Encoder:
    """Encodes texts to little-endian id bytes: 16 bits wide where every id of
    the vocabulary fits, else 32 bits."""

    def __init__(self, path: str, end_id: int | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # texts that hold the spelling of a special token keep it as plain text
        self.tokenizer.encode_special_tokens = True
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 65536 else "<u4")
        self.end = b"" if end_id is None else np.array([end_id], self.dtype).tobytes()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.units = self._unit_rule(spec)
        self.spaced = self.units is spaced_units
        self.memo: dict[str, bytes] = {}        # ids of units, for spaced ones with their space
        self.firsts: dict[str, bytes] = {}      # ids of spaced units that start a text
        if self.spaced:
            # a byte-level token's characters stand for one byte each
            self.bytes_of = np.zeros(self.tokenizer.get_vocab_size(), np.int64)
            for token, i in self.tokenizer.get_vocab(with_added_tokens=True).items():
                self.bytes_of[i] = len(token)

    @staticmethod
    def _unit_rule(spec: dict):
        pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
        if norm is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space"):
            return spaced_units
        first = (pre.get("pretokenizers") or [{}])[0]
        if first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert"):
            return bare_units
        return lambda text: [text]      # unknown rules: whole texts

    def encode(self, texts: list[str]) -> list[bytes]:
        if len(self.memo) > MEMO_UNITS:
            self.memo.clear()
        if len(self.firsts) > MEMO_UNITS:
            self.firsts.clear()
        split = [self.units(t) for t in texts]
        if not self.spaced:
            self._learn_alone(list(set().union(*split).difference(self.memo)), self.memo)
            ids = self.memo.__getitem__
            return [b"".join(map(ids, units)) + self.end for units in split]
        heads = [units.pop(0) for units in split]
        known = self.memo.get
        found = [list(map(known, units)) for units in split]
        missing = []
        for units, ids in zip(split, found):
            at = -1
            for _ in range(ids.count(None)):
                at = ids.index(None, at + 1)
                missing.append((ids, at, units[at]))
        self._learn({u for _, _, u in missing}, set(heads))
        for ids, at, unit in missing:
            ids[at] = self.memo[unit]
        return [self.firsts[h] + b"".join(ids) + self.end for h, ids in zip(heads, found)]

    def _learn(self, new: set[str], heads: set[str]) -> None:
        """The ids of spaced units, and of those that start a text."""
        # words with marks, also on several lines, are put together from their parts:
        # a single line end between them is a token of its own
        alone, marked, several = set(), [], []
        for u in new:
            if u.isalpha():
                alone.add(u)
            elif "\n" not in u:
                if part := marked_word(u):
                    alone.add(part[0])
                    heads.add(part[1])
                    marked.append((u, *part))
                else:
                    alone.add(u)
            elif None in (parts := [marked_word(line) for line in u.split("\n")]):
                alone.add(u)
            else:
                alone.add(parts[0][0])
                heads.update(w for w, _ in parts[1:])
                heads.update(m for _, m in parts if m)
                several.append((u, parts))
        alone = alone.difference(self.memo)     # looks up the few, not all of the memo
        heads.add("\n")
        self._learn_alone(list(heads.difference(self.firsts)), self.firsts)
        # in a text of their own, units with white space at an end (the last of a
        # text, or around other white space) would join with their neighbours
        apart = {u for u in alone if not u or u[0].isspace() or u[-1].isspace()}
        self._learn_together(list(alone.difference(apart)))
        self._learn_alone(list(apart), self.memo, " ")
        memo, firsts = self.memo, self.firsts
        firsts[""] = b""
        for unit, word, marks in marked:
            memo[unit] = memo[word] + firsts[marks]
        for unit, ((word, marks), *lines) in several:
            ids = memo[word] + firsts[marks]
            for w, m in lines:
                ids += firsts["\n"] + firsts[w] + firsts[m]
            memo[unit] = ids

    def _learn_alone(self, new: list[str], memo: dict[str, bytes], before: str = "") -> None:
        for at in range(0, len(new), 4096):
            part = new[at:at + 4096]
            for unit, e in zip(part, self.tokenizer.encode_batch_fast([before + u for u in part],
                                                                      add_special_tokens=False)):
                memo[unit] = np.array(e.ids, self.dtype).tobytes()

    def _learn_together(self, new: list[str]) -> None:
        wide, memo = self.dtype.itemsize, self.memo
        sizes = np.fromiter((len(u.encode()) + 1 for u in new), np.int64, len(new))
        ends = np.cumsum(sizes)
        first = 0
        while first < len(new):
            done = int(ends[first - 1]) if first else 0
            last = max(first + 1, int(np.searchsorted(ends, done + NEW_BYTES)))
            part = new[first:last]
            text = " " + " ".join(part)
            ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.dtype)
            # a unit ends with the token that completes its bytes
            cuts = ((np.searchsorted(np.cumsum(self.bytes_of[ids]), ends[first:last] - done) + 1) * wide).tolist()
            raw, start = ids.tobytes(), 0
            for unit, cut in zip(part, cuts):
                memo[unit] = raw[start:cut]
                start = cut
            first = last


_ENCODERS: dict[tuple, Encoder] = {}
REMEMBERED.append(_ENCODERS.clear)


def encoder(path: str, end_id: int | None = None) -> Encoder:
    """The worker's encoder of this file (Python workers live for many tasks)."""
    key = (path, end_id)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(path, end_id)
    return _ENCODERS[key]
