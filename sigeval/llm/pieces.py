"""SentencePiece encoding and decoding by vectorised merge rounds.

The model's own rule: a text is a chain of characters; the neighbouring pair that
makes the best-scored piece is merged, the leftmost of equal ones, until no pair
makes a piece; what is left outside the vocabulary is spelt in byte pieces.

Merges never cross a place where no piece of the vocabulary has its two
characters side by side, so a text is the chain of its *words*: cuts before every
run of spaces, and around line ends, are checked against the vocabulary when it is
loaded. Each worker remembers the ids of words (a bounded memo) and encodes the new
ones of a batch together (:meth:`Vocabulary.merge`):

* all words lie in one flat numpy array of symbols, with the rank of each
  neighbouring pair beside it;
* a round takes each word's least rank (a segmented minimum), merges that pair in
  every word at once, at all its places from left to right that don't overlap, looks
  up the ranks of the pairs that changed, and compacts the arrays;
* words without a pair leave; rounds go on until none remains.

Where a piece has a better-ranked extension (the one case in which a merge could
come before the next place of the same pair), only the leftmost place merges.

Decoding gathers the bytes of all pieces of a batch by index arithmetic.

Defined results: null text counts as empty and gives the end id alone; repeated
rows and null ids are encoded like any other; an empty table gives an empty result;
other columns are ignored, whatever their names. Texts are encoded whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, text_or_empty

SPACE = "▁"                # how the vocabulary writes a space (fixed value)
MEMO_WORDS = 500_000            # words a worker remembers before it starts afresh
BATCH_WORDS = 65_536            # new words merged together
NONE = np.int32(2 ** 31 - 1)    # rank of a pair that makes no piece
GONE = np.int32(-1)

_RUNS = {True: re.compile(f"{SPACE}+[^{SPACE}\n]*|\n[^{SPACE}\n]*"), False: re.compile(f"{SPACE}+[^{SPACE}]*")}


class Vocabulary:
    """Tables of a SentencePiece BPE model with byte pieces, identity
    normalisation and a leading space; other models are refused."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.names = [model.id_to_piece(i) for i in range(n)]
        if any(model.normalize(t) != SPACE + t.replace(" ", SPACE) for t in ("a  b ", " ﬁ \t１", "́é\n")):
            raise ValueError(f"{path}: only identity normalisation with a leading space is supported")
        self.byte_ids = np.full(256, -1, np.int32)
        self.unknown, plain = model.unk_id(), {}
        shown, normal = [], np.zeros(n, bool)
        for i, name in enumerate(self.names):
            if model.is_byte(i):
                value = int(name[3:5], 16)
                self.byte_ids[value] = i
                shown.append(bytes([value]))
            elif model.is_control(i):
                shown.append(b"")
            elif model.is_unknown(i):
                shown.append(" ⁇ ".encode())
            elif model.is_unused(i):
                raise ValueError(f"{path}: unused pieces are not supported")
            else:
                plain[name] = i
                normal[i] = True
                shown.append(name.replace(SPACE, " ").encode())
        if (self.byte_ids < 0).any():
            raise ValueError(f"{path}: a model without byte pieces is not supported")
        self._decoding_tables(shown, normal, model)
        self._merge_tables(plain, model)
        joined = "\n\n".join(plain)          # no piece holds two line ends
        self.cuts_at_space = re.search(f"[^{SPACE}\n]{SPACE}", joined) is None
        self.cuts_at_line = all("\n" not in name for name in plain)
        self.memo: dict[str, bytes] = {}

    def _merge_tables(self, plain: dict[str, int], model) -> None:
        # symbols: the ids, then characters that occur in pieces without being one
        letters = {c for name in plain for c in name}
        number = dict(plain)
        for c in sorted(letters):
            number.setdefault(c, len(self.names) + len(number) - len(plain))
        self.n_symbols = len(self.names) + len(number) - len(plain)
        self.of_char = np.full(0x110000, GONE, np.int32)
        for c in letters:
            self.of_char[ord(c)] = number[c]
        self.of_char[ord(" ")] = self.of_char[ord(SPACE)]
        by_rank = sorted((name for name in plain if len(name) > 1), key=lambda name: -model.get_score(plain[name]))
        rank = {name: r for r, name in enumerate(by_rank)}
        self.rank = np.full(self.n_symbols, NONE, np.int32)
        self.one_place = np.zeros(self.n_symbols, bool)      # pieces with a better-ranked extension
        pairs = {}
        for name, r in rank.items():
            self.rank[plain[name]] = r
            for k in range(1, len(name)):
                left, right = name[:k], name[k:]
                if left in number and right in number:
                    pairs[number[left] * self.n_symbols + number[right]] = plain[name]
                    for part in (left, right):
                        if rank.get(part, -1) > r:
                            self.one_place[number[part]] = True
        self.pair_keys = np.array(sorted(pairs), np.int64)
        self.pair_made = np.array([pairs[k] for k in sorted(pairs)], np.int32)

    def _decoding_tables(self, shown: list[bytes], normal, model) -> None:
        self.shown = np.frombuffer(b"".join(shown), np.uint8)
        self.shown_length = np.array([len(s) for s in shown], np.int64)
        self.shown_start = np.cumsum(self.shown_length) - self.shown_length
        self.silent = np.array([model.is_control(i) for i in range(len(shown))])
        self.leading = normal & np.array([name.startswith(SPACE) for name in self.names])

    # ------------------------------------------------------------ words
    def words(self, text: str) -> list[str]:
        """The words of ``text``: as they are if they start with a line end or with
        several spaces, else without the one space they start with."""
        if not text:
            return []
        chain = SPACE + text.replace(" ", SPACE)
        if not self.cuts_at_space:
            return [SPACE + chain]            # kept whole: marked by two spaces, see spelt()
        if SPACE * 2 not in chain and chain[-1] != SPACE:
            return (chain.replace("\n", SPACE + "\n") if self.cuts_at_line else chain)[1:].split(SPACE)
        return [w if w[0] == "\n" or w[1:2] == SPACE else w[1:] for w in _RUNS[self.cuts_at_line].findall(chain)]

    def spelt(self, word: str) -> str:
        if not self.cuts_at_space:
            return word[1:]
        return word if word[:1] in (SPACE, "\n") and word else SPACE + word

    # ------------------------------------------------------------ merge rounds
    def pair(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Piece and rank that each pair of symbols makes (rank ``NONE`` if none)."""
        key = left.astype(np.int64) * self.n_symbols + right
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        made = np.where((self.pair_keys[at] == key) & (left >= 0) & (right >= 0), self.pair_made[at], GONE)
        return made, np.where(made >= 0, self.rank[made], NONE)

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words in a row, number of ids of each word)."""
        spelt = [self.spelt(w) for w in words]
        chars = np.frombuffer("".join(spelt).encode("utf-32-le", "surrogatepass"), "<u4")
        length = np.array([len(w) for w in spelt], np.int64)
        result = np.full(len(chars), np.int32(-2))              # final symbol at its first character, else -2
        symbol, place = self.of_char[chars], np.arange(len(chars))
        word = np.repeat(np.arange(len(spelt)), length)
        rank = np.full(len(symbol), NONE, np.int32)             # of the pair (i, i + 1)
        made = np.full(len(symbol), GONE, np.int32)

        def look_up(at):
            at = at[(at >= 0) & (at + 1 < len(symbol))]
            made[at], rank[at] = self.pair(symbol[at], symbol[at + 1])
            across = at[word[at] != word[at + 1]]
            rank[across] = NONE

        look_up(np.arange(len(symbol)))
        while len(symbol):
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            size = np.diff(np.r_[first, len(symbol)])
            least = np.minimum.reduceat(rank, first)            # segmented minimum
            least_here = np.repeat(least, size)
            finished = least_here == NONE
            if finished.any():
                result[place[finished]] = symbol[finished]
                stay = ~finished
                symbol, place, word, rank, made, least_here = (
                    x[stay] for x in (symbol, place, word, rank, made, least_here))
                if not len(symbol):
                    break
            here = np.flatnonzero(rank == least_here)
            close = np.flatnonzero(np.diff(here) == 1)
            if len(close):                                      # overlapping places: every second one of a run
                start = np.r_[True, np.diff(here) != 1]
                offset = np.arange(len(here)) - np.maximum.accumulate(np.where(start, np.arange(len(here)), 0))
                here = here[offset % 2 == 0]
            single = self.one_place[made[here]]
            if single.any():
                again = np.r_[False, word[here][1:] == word[here][:-1]]
                here = here[~(single & again)]
            symbol[here] = made[here]
            keep = np.ones(len(symbol), bool)
            keep[here + 1] = False
            now = np.cumsum(keep)[here] - 1
            symbol, place, word, rank, made = (x[keep] for x in (symbol, place, word, rank, made))
            rank[now] = NONE                                    # a last symbol has no pair
            look_up(now)
            look_up(now - 1)
        return self._spell_out(chars, result, length)

    def _spell_out(self, chars, result, length) -> tuple[np.ndarray, np.ndarray]:
        """Symbols outside the vocabulary become the byte pieces of their character."""
        place = np.flatnonzero(result != -2)
        symbol = result[place]
        outside = (symbol < 0) | (symbol >= len(self.names))
        n_ids = np.ones(len(place), np.int64)
        spelt = [chr(c).encode("utf-8", "surrogatepass") for c in chars[place[outside]]]
        n_ids[outside] = [len(s) for s in spelt]
        ids = np.repeat(symbol, n_ids)
        if spelt:
            ids[np.repeat(outside, n_ids)] = self.byte_ids[np.frombuffer(b"".join(spelt), np.uint8)]
        ends = np.cumsum(length)
        total = np.r_[0, np.cumsum(n_ids)]
        upto = total[np.searchsorted(place, ends)]
        return ids.astype(np.int32), np.diff(np.r_[0, upto])

    def encode(self, texts: list[str], end_id: int | None = None) -> list[np.ndarray]:
        """Ids of each text, with ``end_id`` last."""
        split = [self.words(t) for t in texts]
        if len(self.memo) > MEMO_WORDS:
            self.memo.clear()
        memo = self.memo
        new = list({w for words in split for w in words if w not in memo})
        for first in range(0, len(new), BATCH_WORDS):
            part = new[first:first + BATCH_WORDS]
            ids, counts = self.merge(part)
            raw, ends = ids.tobytes(), np.cumsum(counts) * 4
            for w, a, b in zip(part, [0, *ends[:-1].tolist()], ends.tolist()):
                memo[w] = raw[a:b]
        end = b"" if end_id is None else np.array([end_id], np.int32).tobytes()
        return [np.frombuffer(b"".join([memo[w] for w in words]) + end, np.int32) for words in split]

    # ------------------------------------------------------------ decoding
    def decode(self, sequences: list[np.ndarray]) -> list[str]:
        """Text of each id sequence, as the library's ``decode`` gives it."""
        ids = np.concatenate(sequences) if sequences else np.zeros(0, np.int32)
        n = self.shown_length[ids]
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        raw = self.shown[np.arange(total) + np.repeat(self.shown_start[ids] - (ends - n), n)].tobytes()
        sizes = np.array([len(s) for s in sequences], np.int64)
        bounds = np.r_[0, ends][np.r_[0, np.cumsum(sizes)]].tolist()
        texts = []
        for s, a, b in zip(sequences, bounds, bounds[1:]):
            heard = s[:16][~self.silent[s[:16]]]
            if not len(heard):
                heard = s[~self.silent[s]][:1]
            if len(heard) and self.leading[heard[0]]:
                a += 1
            try:
                texts.append(raw[a:b].decode())
            except UnicodeDecodeError:
                texts.append(self._broken(s))
        return texts

    def _broken(self, ids: np.ndarray) -> str:
        """Runs of byte pieces that are no UTF-8: a replacement for every byte that
        starts no character."""
        out, run, first = [], bytearray(), True
        is_byte = np.zeros(len(self.names), bool)
        is_byte[self.byte_ids] = True

        def close():
            while run:
                for k in range(1, 5):
                    try:
                        out.append(bytes(run[:k]).decode())
                        del run[:k]
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    out.append("�")
                    del run[:1]

        for i in ids.tolist():
            a = self.shown_start[i]
            shown = self.shown[a:a + self.shown_length[i]].tobytes()
            if is_byte[i]:
                run += shown
                first = False
                continue
            close()
            out.append((shown[1:] if first and self.leading[i] else shown).decode())
            first = first and bool(self.silent[i])
        close()
        return "".join(out)


_LOADED: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    """The worker's tables of this file (Python workers live for many tasks)."""
    if path not in _LOADED:
        _LOADED[path] = Vocabulary(path)
    return _LOADED[path]


def encode_documents(docs: DataFrame, path: str, end_id: int | None = 2, id_col: str = "doc_id",
                     text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: (doc_id, ids ARRAY<INT>, decoded STRING), with
    ``decoded`` made from the ids."""
    spec = "doc_id bigint, ids array<int>, decoded string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for batch in slices(batches):
            ids = v.encode(batch.column("text").to_pylist(), end_id)
            offsets = np.r_[0, np.cumsum([len(s) for s in ids])].astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(ids)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()), lists, pa.array(v.decode(ids), pa.string())],
                names=["doc_id", "ids", "decoded"])

    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"),
                       text_or_empty(text_col).alias("text")).mapInArrow(run, spec)


def digests(encoded: DataFrame) -> DataFrame:
    """Hashes of the ids (decimal, joined by a space) and of the decoded text."""
    return encoded.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"),
                          F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"),
                          F.sha2("decoded", 256).alias("decoded_sha256"))
