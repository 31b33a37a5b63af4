"""Token ids as binary training input: Arrow files of equal-length sequences.

Layout of one output folder:

* ``ids-SSSSS.arrow`` — an Arrow IPC file (the stream format framed by a footer
  that locates every record batch). Columns ``input_ids``
  ``FixedSizeList<uint16|uint32>[L]`` and ``mask`` ``FixedSizeList<bool>[L]``,
  ``ROWS`` sequences per batch, uncompressed: sequence ``i`` of a shard is row
  ``i % ROWS`` of batch ``i // ROWS`` and is viewed in the mapped file without
  copying: its ids, and its mask as packed bits, least significant first
  (``unpacked`` spreads them). Sequences have a multiple of eight ids, so a mask
  starts at a byte. Only the last sequence of a shard is padded (mask false).
* ``docs-SSSSS.arrow`` — ``doc_id``, ``first`` (position in the shard's id
  stream) and ``n_tokens`` of every document, in stream order.

Shards are range partitions of the documents in ascending ``doc_id`` order
(nulls first; equal ids by content hash), so the shards in order are the corpus
in order. A task writes under a name of its own and renames when complete, so
a retried or doubled task leaves one whole shard. The manifest (one row per
shard) is a table in the shared folder.

Edge cases: null text counts as empty (just the end id); repeated ids and rows
are separate documents; an empty table gives no shards and no rows; other
columns are ignored.
"""

from __future__ import annotations

import os
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, record_batch, scratch_path, slices, text_or_empty
from .encoder import encoder

LENGTH = 2048             # ids per sequence
ROWS = 64                 # sequences per record batch
PAD_ID = 0
MANIFEST = "shard int, ids_file string, docs_file string, n_docs long, n_tokens long"
DOCS = pa.schema([("doc_id", pa.int64()), ("first", pa.int64()), ("n_tokens", pa.int64())])


def ids_schema(length: int, dtype: np.dtype) -> pa.Schema:
    return pa.schema([("input_ids", pa.list_(pa.from_numpy_dtype(dtype), length)),
                      ("mask", pa.list_(pa.bool_(), length))])


class ShardWriter:
    """Appends documents to one shard, holding at most one record batch."""

    def __init__(self, folder: str, shard: int, length: int, dtype: np.dtype):
        self.fs, self.folder = pafs.FileSystem.from_uri(folder)
        self.fs.create_dir(self.folder, recursive=True)
        self.length, self.dtype = length, dtype
        tag = uuid.uuid4().hex
        self.names = [f"{kind}-{shard:05d}.arrow" for kind in ("ids", "docs")]
        self.drafts = [f"{self.folder}/.{tag}-{n}" for n in self.names]
        self.outs = [self.fs.open_output_stream(d) for d in self.drafts]
        self.schema = ids_schema(length, dtype)
        self.files = [pa.ipc.new_file(o, s) for o, s in zip(self.outs, (self.schema, DOCS))]
        self.pending, self.docs = bytearray(), []
        self.n_docs = self.n_tokens = 0

    def append(self, doc_id: int | None, ids: bytes) -> None:
        n = len(ids) // self.dtype.itemsize
        self.docs.append((doc_id, self.n_tokens, n))
        self.pending += ids
        self.n_docs, self.n_tokens = self.n_docs + 1, self.n_tokens + n
        block = ROWS * self.length * self.dtype.itemsize
        while len(self.pending) >= block:
            self._sequences(bytes(self.pending[:block]))
            del self.pending[:block]
        if len(self.docs) >= 65536:
            self._documents()

    def _sequences(self, ids: bytes) -> None:
        flat = np.frombuffer(ids, self.dtype)
        rows = -(-len(flat) // self.length)
        real = np.zeros(rows * self.length, bool)
        real[:len(flat)] = True
        if len(flat) < len(real):
            flat = np.concatenate([flat, np.full(len(real) - len(flat), PAD_ID, self.dtype)])
        self.files[0].write_batch(pa.RecordBatch.from_arrays(
            [pa.FixedSizeListArray.from_arrays(pa.array(a), self.length) for a in (flat, real)],
            schema=self.schema))

    def _documents(self) -> None:
        if self.docs:
            ids, first, n = zip(*self.docs)
            self.files[1].write_batch(record_batch(DOCS, {"doc_id": ids, "first": first, "n_tokens": n}))
            self.docs = []

    def close(self) -> list[str]:
        if self.pending:
            self._sequences(bytes(self.pending))
        self._documents()
        for f, o in zip(self.files, self.outs):
            f.close()
            o.close()
        for draft, name in zip(self.drafts, self.names):
            self.fs.move(draft, f"{self.folder}/{name}")
        return self.names


def write_sequences(docs: DataFrame, folder: str, tokenizer: str, end_id: int,
                    length: int = LENGTH) -> DataFrame:
    """Encode every document, append ``end_id`` and write the shards to
    ``folder`` (a URI that pyarrow opens on every executor). Returns the
    manifest. ``length`` is a multiple of eight."""
    if length < 8 or length % 8:
        raise ValueError(f"sequence length must be a multiple of eight: {length}")
    ordered = (docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_or_empty().alias("text"))
               .withColumn("_tie", F.xxhash64("text"))
               .repartitionByRange("doc_id", "_tie").sortWithinPartitions("doc_id", "_tie")
               .select("doc_id", "text"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, writer, shard = encoder(tokenizer, end_id), None, TaskContext.get().partitionId()
        for b in slices(batches):
            writer = writer or ShardWriter(folder, shard, length, enc.dtype)
            for doc_id, ids in zip(b.column("doc_id").to_pylist(), enc.encode(b.column("text").to_pylist())):
                writer.append(doc_id, ids)
        if writer:
            a, d = writer.close()
            yield pa.RecordBatch.from_pylist([{"shard": shard, "ids_file": a, "docs_file": d,
                                               "n_docs": writer.n_docs, "n_tokens": writer.n_tokens}],
                                             schema=pa.schema([("shard", pa.int32()), ("ids_file", pa.string()),
                                                               ("docs_file", pa.string()), ("n_docs", pa.int64()),
                                                               ("n_tokens", pa.int64())]))

    return materialize(ordered.mapInArrow(write, MANIFEST), "token-manifest")


def open_shard(folder: str, name: str) -> pa.ipc.RecordBatchFileReader:
    """A shard's reader: mapped where the folder is a local or mounted one."""
    fs, path = pafs.FileSystem.from_uri(folder)
    full = os.path.join(path, name)
    local = isinstance(fs, pafs.LocalFileSystem)
    return pa.ipc.open_file(pa.memory_map(full) if local else fs.open_input_file(full))


def sequence(reader: pa.ipc.RecordBatchFileReader, i: int) -> tuple[np.ndarray, np.ndarray]:
    """Random access: views of the ids and of the packed mask of sequence ``i``."""
    b = reader.get_batch(i // ROWS)
    ids, mask = b.column("input_ids"), b.column("mask")
    length, row = ids.type.list_size, i % ROWS
    bits = np.frombuffer(mask.flatten().buffers()[1], np.uint8)
    return (ids[row].values.to_numpy(zero_copy_only=True),
            bits[row * length // 8:(row + 1) * length // 8])


def unpacked(mask: np.ndarray) -> np.ndarray:
    """A packed mask as booleans, one per id."""
    return np.unpackbits(mask, bitorder="little").view(bool)


def id_stream(reader: pa.ipc.RecordBatchFileReader) -> Iterator[np.ndarray]:
    """The unmasked ids of a shard, batch by batch."""
    for i in range(reader.num_record_batches):
        b = reader.get_batch(i)
        ids = b.column("input_ids").flatten().to_numpy(zero_copy_only=True)
        if i + 1 < reader.num_record_batches:
            yield ids
        else:
            yield ids[b.column("mask").flatten().to_numpy(zero_copy_only=False)]


def read_documents(manifest: DataFrame, folder: str) -> DataFrame:
    """Read the shards back: ``doc_id, start, n_tokens, ids_crc32`` per
    document, ``start`` counted over the whole corpus."""
    # one row per shard, so this window is small at every size of the corpus
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.withColumn("offset", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))
    out = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()),
                     ("ids_crc32", pa.int64())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in (r for b in batches for r in b.to_pylist()):
            stream = id_stream(open_shard(folder, row["ids_file"]))
            held = np.zeros(0, np.uint16)
            index = open_shard(folder, row["docs_file"])
            for k in range(index.num_record_batches):
                docs = index.get_batch(k)
                crcs = []
                for n in docs.column("n_tokens").to_pylist():
                    crc = 0
                    while n:
                        if not len(held):
                            held = next(stream)
                        crc = zlib.crc32(held[:n].astype("<u4").tobytes(), crc)
                        n, held = n - len(held[:n]), held[n:]
                    crcs.append(crc)
                start = pa.array(docs.column("first").to_numpy() + row["offset"])
                yield record_batch(out, {"doc_id": docs.column("doc_id"), "start": start,
                                         "n_tokens": docs.column("n_tokens"), "ids_crc32": crcs})

    shards = max(1, manifest.count())
    return (placed.select("shard", "ids_file", "docs_file", "offset").repartition(shards, "shard")
            .mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long"))


def token_output(docs: DataFrame, tokenizer: str, end_id: int = 2, length: int = LENGTH,
                 folder: str | None = None) -> DataFrame:
    """Write the corpus as token files and return the documents read back."""
    folder = folder or scratch_path(docs.sparkSession, "token-files")
    if "://" not in folder:
        folder = folder.replace("file:", "") if folder.startswith("file:") else folder
    return read_documents(write_sequences(docs, folder, tokenizer, end_id, length), folder)
