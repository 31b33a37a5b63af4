"""Bounded-space online packing of documents into fixed windows.

Every task keeps at most ``open_windows`` unfinished windows. A document's ids
go, in order of arrival, into the open window they fit best (least room left).
If they fit none, a new window is opened while the bound allows; else the
fullest window is topped up with the head of the document (documents may be
cut) and emitted, and the rest is placed anew. Documents longer than a window
give whole windows first. Emitted windows are full, so only the windows still
open at the end of a task have room; these leftovers, at most
``open_windows`` per task, are merged in rounds of ``FAN_IN`` tasks by the same
rule. What the last round holds is cut into sequences whose lengths are powers
of two, which take no padding either.

Leftover windows travel with their ids, bounded by tasks x windows x size;
finished pieces are descriptors only. A task's output depends on its input
partition alone, so a retry gives the same pieces, and the first round is a
table in the shared folder.

Edge cases: null text is empty (one end id); repeated or null ids are separate
documents; an empty table gives no pieces; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keyed, materialize, record_batch, slices
from .encoder import encoder

WINDOW = 4096
OPEN_WINDOWS = 16
FAN_IN = 64
PIECES = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
          "sequence_id long, offset long, task int, ids binary")
PIECES_ARROW = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens",
                                                    "sequence_id", "offset")]
                         + [("task", pa.int32()), ("ids", pa.binary())])


class Packer:
    """``finished`` collects descriptor rows; open windows are lists of
    ``(doc_id, start, doc_tokens, ids)`` pieces."""

    def __init__(self, first_sequence: int, size: int, open_windows: int):
        self.next, self.size, self.most = first_sequence, size, open_windows
        self.windows: list[list] = []      # [filled, pieces]
        self.finished: list[tuple] = []

    def _finish(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc_id, start, total, ids in pieces:
            crc = zlib.crc32(ids.astype("<u4").tobytes())
            self.finished.append((doc_id, start, len(ids), crc, total, self.next, offset, None, None))
            offset += len(ids)
        self.next += 1

    def place(self, doc_id, start: int, total: int, ids: np.ndarray) -> None:
        while len(ids) >= self.size:
            self._finish([(doc_id, start, total, ids[:self.size])])
            start, ids = start + self.size, ids[self.size:]
        while len(ids):
            room = [w for w in self.windows if w[0] + len(ids) <= self.size]
            if room:
                best = max(room, key=lambda w: w[0])
            elif len(self.windows) < self.most:
                best = [0, []]
                self.windows.append(best)
            else:
                best = max(self.windows, key=lambda w: w[0])
            take = min(len(ids), self.size - best[0])
            best[1].append((doc_id, start, total, ids[:take]))
            best[0] += take
            start, ids = start + take, ids[take:]
            if best[0] == self.size:
                self._finish(best[1])
                self.windows = [w for w in self.windows if w is not best]

    def leftovers(self, task: int) -> list[tuple]:
        return [(doc_id, start, len(ids), None, total, None, None, task, ids.astype("<u4").tobytes())
                for _, pieces in self.windows for doc_id, start, total, ids in pieces]

    def close(self) -> None:
        """Cut what is open into sequences of power-of-two lengths."""
        pieces = [p for _, ps in self.windows for p in ps]
        held = sum(len(p[3]) for p in pieces)
        while held:
            want, row = 1 << (held.bit_length() - 1), []
            held -= want
            while want:
                doc_id, start, total, ids = pieces.pop(0)
                row.append((doc_id, start, total, ids[:want]))
                if len(ids) > want:
                    pieces.insert(0, (doc_id, start + want, total, ids[want:]))
                want -= len(row[-1][3])
            self._finish(row)
        self.windows = []


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return record_batch(PIECES_ARROW, dict(zip(PIECES_ARROW.names, map(list, zip(*rows)))))


def pack(docs: DataFrame, tokenizer: str, end_id: int = 2, size: int = WINDOW,
         open_windows: int = OPEN_WINDOWS) -> DataFrame:
    """Pieces ``(doc_id, start, length, ids_crc32, doc_tokens, sequence_id,
    offset)`` of all sequences."""
    if size & (size - 1):
        raise ValueError("the window must be a power of two")

    def first_round(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        enc, packer = encoder(tokenizer, end_id), Packer(task << 32, size, open_windows)
        for b in slices(batches):
            for doc_id, raw in zip(b.column("doc_id").to_pylist(), enc.encode(b.column("text").to_pylist())):
                ids = np.frombuffer(raw, enc.dtype)
                packer.place(doc_id, 0, len(ids), ids)
            if packer.finished:
                yield _rows(packer.finished)
                packer.finished = []
        if left := packer.leftovers(task):
            yield _rows(left)

    def merge(level: int, last: bool):
        def run(left: pa.Table) -> pa.Table:
            rows = left.to_pylist()
            group = rows[0]["task"] // FAN_IN
            # full windows come out one after another; one at most stays open
            packer = Packer((level << 56) | (group << 32), size, 1)
            # largest pieces first, so that small ones fill up what is left
            for r in sorted(rows, key=lambda r: (-r["length"], r["task"], r["doc_id"] or 0, r["start"], r["ids"])):
                packer.place(r["doc_id"], r["start"], r["doc_tokens"], np.frombuffer(r["ids"], "<u4"))
            if last:
                packer.close()
            out = packer.finished + packer.leftovers(group)
            return pa.Table.from_batches([_rows(out)], PIECES_ARROW)
        return run

    names = PIECES_ARROW.names[:7]
    placed = materialize(keyed(docs).mapInArrow(first_round, PIECES), "packed")
    done, left = placed.where(F.col("ids").isNull()).select(names), placed.where(F.col("ids").isNotNull())
    top = left.agg(F.max("task")).first()[0]
    level = 1
    while top is not None:
        last = top < FAN_IN
        left = left.withColumn("_group", F.floor(F.col("task") / FAN_IN))
        merged = left.groupBy("_group").applyInArrow(_without_group(merge(level, last)), PIECES)
        if last:
            return done.unionByName(merged.select(names))
        merged = materialize(merged, "packed")
        done = done.unionByName(merged.where(F.col("ids").isNull()).select(names))
        left, level, top = merged.where(F.col("ids").isNotNull()), level + 1, top // FAN_IN
    return done


def _without_group(run):
    return lambda table: run(table.select(PIECES_ARROW.names))
