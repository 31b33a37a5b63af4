"""Exact n-gram Jaccard join with adaptive multi-match prefixes.

A document's set is its distinct word shingles. All sets are sorted in one
order, by the exact number of texts that hold a shingle, so that the front of a
set is rare. If two sets
of sizes ``a`` and ``b`` share what the threshold asks, then their prefixes of
``size - need(size) + m`` shingles share at least ``m``, where ``need(size)`` is
the least overlap with any partner. Each document picks its own ``m``: a longer
prefix visits more postings but must share more of them, which removes
candidates before they are verified. The choice minimises the estimated cost,
from those numbers. A pair must share ``min(m_x, m_y)``
prefix shingles.

Steps:

1. Equal texts collapse to one by their digest, in a block of texts before they are
   dealt out and all after step 2.
2. Every shingle of the texts is counted: blocks of sets are dealt out by
   ranges of hashes, each range sorts its shingles, and only those of several texts
   go back to their block. A set of which too many shingles stand in no other text
   can't link (``alive`` is false) and needs no postings. Of the others, equal sets
   collapse to one, which a 128-bit digest of the shingles names.
3. Prefix postings are joined with one leading document per shingle. Every pair
   of a document and a leader whose sizes and overlap bounds fit is verified: a
   leader sees only the postings that it leads, so several matches can't be asked
   for here. This links groups of near copies to a leader without forming their
   pairs.
4. Linked documents are connected. Only where a shingle's postings still hold
   different components can an untested link matter: there, pairs of members of
   *different* components are counted, filtered by sizes, by the bound on their
   overlap and by the documents' ``m``, and verified. Postings whose size no band of
   partners' sizes can match are dropped before pairs are formed, and so are those that the
   leader rules out: documents that fall short of the leader must share what the
   leader lacks (see ``_beside_leaders``). Most of such documents meet by what they
   have in common beside the leader (``_met_beside``), the rest by the leader's
   shingle (``_meeting``). No link between components is lost, and none is formed
   inside one.
5. The links of 3 and 4 are connected again.

Verification intersects whole sets exactly (shingles are 64-bit hashes); only
sets of documents in candidate pairs are shuffled. Components are found by
repeated smallest-label exchange with checkpointed tables; nothing of the
documents reaches the driver.

Edge cases: null or blank text has an empty set and links with nothing; fewer
words than a shingle form one shingle; repeated and null ids are separate rows
(a component is named by the smallest id in it, null if all are null); an empty
table gives no rows.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from functools import reduce
from itertools import count

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, let_go, materialize, record_batch, slices, small_batches, text_or_empty

BLOCK_BYTES = 4 << 20     # text whose sets are dealt out together
BLOCK_SETS = 1 << 15      # of so many sets at most, and one slice's
SLICE_BYTES = 1 << 20     # text handled at once
RANGE_BYTES = 4 << 20     # text per range of hashes
MOST_MATCHES = 4
MOST_BITS = 1 << 26       # of the filter that picks texts
BANDS = 3                 # of sizes, over which sizes grow from one to the largest it links with
PASSES = 4                # over the sets when pairs are verified, at most
PASS_BYTES = 96 << 20        # text whose sets one pass may shuffle
SCAN_COST, VERIFY_COST = 1.0, 20.0      # of one posting; of one candidate


def shingle_sets(texts: list[str], words: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each text."""
    ids: defaultdict = defaultdict(count().__next__)
    per_text = [np.fromiter(map(ids.__getitem__, ws), np.int64, len(ws))
                for ws in (t.encode().lower().split() for t in texts)]
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, ids), np.uint64, len(ids))
    out = []
    for word_ids in per_text:
        h = hashes[word_ids]
        if 0 < len(h) < words:
            out.append(np.array([xxhash.xxh3_64_intdigest(h.tobytes(), seed=len(h))], np.uint64))
            continue
        mixed = np.zeros(max(0, len(h) - words + 1), np.uint64)
        for i in range(words if len(h) else 0):
            mixed = (mixed ^ h[i:len(mixed) + i]) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(29)
        out.append(np.unique(mixed))
    return out


def needed(size, percent: int):
    """Least overlap with any partner at ``percent`` similarity."""
    return -(-size * percent // 100)


def choose_matches(frequencies: np.ndarray, base: int) -> int:
    """How many shared prefix shingles to ask for: ``frequencies`` are those of
    the sorted set, ``base`` is the prefix length for one match."""
    best, cheapest = 1, float("inf")
    for m in range(1, MOST_MATCHES + 1):
        length = base + m - 1
        if length > len(frequencies):
            break
        visits = float(frequencies[:length].sum())
        cost = SCAN_COST * visits + VERIFY_COST * (visits - length) / m
        if cost < cheapest:
            best, cheapest = m, cost
    return best


# of a block of texts: ``info`` has the sizes, keys and marks of its sets; else the
# shingles ``h`` that fall into a range of hashes, the places ``at`` of their sets
# within the block, and in how many texts each is
DEALT = pa.schema([("part", pa.int32()), ("block", pa.int64()), ("info", pa.binary()), ("at", pa.binary()),
                   ("h", pa.binary()), ("df", pa.binary())])
_DEALT = "part int, block long, info binary, at binary, h binary, df binary"
INFO = np.dtype([("n", "<i8"), ("k", "V16"), ("mark", "V16")])


def _blocks(batches: Iterator[pa.RecordBatch], words: int) -> Iterator[tuple[list[bytes], list[np.ndarray]]]:
    """Keys and sets of about ``BLOCK_BYTES`` of text (a block's places fit two bytes);
    equal texts of a block are taken once. Texts are held a slice at a time."""
    found: dict[bytes, np.ndarray] = {}
    held = 0
    for b in slices(batches, size=SLICE_BYTES):
        new = {k: t for k, t in zip(b.column("k").to_pylist(), b.column("text").to_pylist()) if k not in found}
        found.update(zip(new, shingle_sets(list(new.values()), words)))
        held += sum(map(len, new.values()))
        if held >= BLOCK_BYTES or len(found) >= BLOCK_SETS:
            keys, sets, found, held = list(found), list(found.values()), {}, 0
            yield keys, sets
    if found:
        yield list(found), list(found.values())


def _deal(words: int, ranges: int):
    narrow = np.uint16 if ranges < 1 << 16 else np.uint32      # the sort of two bytes is by radix

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        let_go()
        first = TaskContext.get().partitionId() << 32
        for number, (keys, sets) in enumerate(_blocks(batches, words)):
            block = first + number
            info = np.zeros(len(sets), INFO)
            info["n"] = [len(s) for s in sets]
            info["k"] = np.frombuffer(b"".join(keys), "V16")
            info["mark"] = np.frombuffer(b"".join(xxhash.xxh3_128_digest(s.tobytes()) for s in sets), "V16")
            yield record_batch(DEALT, {"part": [block % ranges], "block": [block], "info": [info.tobytes()],
                                       "at": [None], "h": [None], "df": [None]})
            h = np.concatenate(sets)
            sets.clear()
            part = (((h >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)).astype(narrow)
            order = np.argsort(part, kind="stable")
            h, at = h[order], np.repeat(np.arange(len(info), dtype=np.uint16), info["n"])[order]
            cuts = np.concatenate([[0], np.cumsum(np.bincount(part, minlength=ranges))]).tolist()
            del part, order
            for i, (x, y) in enumerate(zip(cuts, cuts[1:])):
                if x < y:
                    yield record_batch(DEALT, {"part": [i], "block": [block], "info": [None], "at": [at[x:y].tobytes()],
                                               "h": [h[x:y].tobytes()], "df": [None]})
    return run


def _count_range(rows: list[dict]) -> Iterator[pa.RecordBatch]:
    """Of the shingles of one range, those that several texts hold."""
    held = [np.frombuffer(r["h"], np.uint64) for r in rows]
    if not held:
        return
    h = np.concatenate(held)
    order = np.argsort(h)
    ends = np.flatnonzero(np.concatenate([h[order[1:]] != h[order[:-1]], [True]]))
    many = np.diff(ends, prepend=-1)
    df = np.empty(len(h), np.uint32)
    df[order] = np.repeat(many, many)
    first = 0
    for r, own in zip(rows, held):
        n = df[first:first + len(own)]
        first += len(own)
        shared = n > 1
        if shared.any():
            yield record_batch(DEALT, {"part": [r["part"]], "block": [r["block"]], "info": [None],
                                       "at": [np.frombuffer(r["at"], np.uint16)[shared].tobytes()],
                                       "h": [own[shared].tobytes()], "df": [n[shared].tobytes()]})


def _count_ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows come sorted by ``part``; a range is held at once."""
    part, rows = None, []
    for b in batches:
        for r in b.to_pylist():
            if r["part"] != part:
                yield from _count_range(rows)
                part, rows = r["part"], []
            if r["info"] is not None:
                yield record_batch(DEALT, {c: [v] for c, v in r.items()})
            else:
                rows.append(r)
    yield from _count_range(rows)


SETS = pa.schema([("k", pa.binary()), ("n", pa.int64()), ("m", pa.int32()), ("mark", pa.binary()), ("alive", pa.bool_()),
                  ("first", pa.int64()), ("prefix", pa.list_(pa.int64()))])
_SETS = "k binary, n long, m int, mark binary, alive boolean, first long, prefix array<long>"


def _prefixes(percent: int):
    """The sets of one block: ``prefix`` has the shingles of the prefix that other
    texts hold too, of which the first stands at place ``first`` of the sorted set."""
    def run(block: pa.Table) -> pa.Table:
        info, found = None, []
        for r in block.to_pylist():
            if r["info"] is not None:
                info = np.frombuffer(r["info"], INFO)
            else:
                found.append(tuple(np.frombuffer(r[c], t) for c, t in (("at", np.uint16), ("h", np.int64), ("df", np.uint32))))
        at, h, df = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, t) for t in (np.uint16, np.int64, np.uint32))
        order = np.lexsort((h, df, at))
        h, df = h[order], df[order].astype(np.int64)
        cuts = np.searchsorted(at[order], np.arange(len(info) + 1)).tolist()
        matches, alive, firsts, prefixes = [], [], [], []
        for n, x, y in zip(info["n"].tolist(), cuts, cuts[1:]):
            alone, m, prefix = n - (y - x), 1, h[:0]
            lives = n > 0 and y - x >= needed(n, percent)
            if lives:
                base = n - needed(n, percent) + 1
                m = choose_matches(np.concatenate([np.ones(alone, np.int64), df[x:y]]), base)
                prefix = h[x:x + base + m - 1 - alone]
            matches.append(m)
            alive.append(lives)
            firsts.append(alone)
            prefixes.append(prefix)
        return pa.Table.from_batches([record_batch(SETS, {
            "k": [v.tobytes() for v in info["k"]], "n": info["n"], "m": matches,
            "mark": [v.tobytes() if n else None for n, v in zip(info["n"].tolist(), info["mark"])],
            "alive": alive, "first": firsts, "prefix": pa.array(prefixes, pa.list_(pa.int64()))})])
    return run


def prefix_sets(texts: DataFrame, total: int, words: int, percent: int) -> DataFrame:
    """``k, n, m, mark, alive, first, prefix`` of every row of ``texts`` (``k, text``,
    about ``total`` bytes of text)."""
    ranges = max(8, -(-total // RANGE_BYTES))
    dealt = texts.select("k", "text").mapInArrow(_deal(words, ranges), _DEALT)
    counted = dealt.repartition(ranges, "part").sortWithinPartitions("part").mapInArrow(_count_ranges, _DEALT)
    return counted.groupBy("block").applyInArrow(_prefixes(percent), _SETS)


def measured(pairs: DataFrame, sets: DataFrame, total: int, percent: int) -> DataFrame:
    """:func:`_measured` of all pairs, written in passes by the hash of
    ``b``: a pass shuffles only the sets that its pairs name, and its shuffles are
    freed before the next one, so the disk holds a fraction of the sets twice. The sets
    of few texts (``total`` bytes) take fewer passes, as each has its own jobs."""
    passes = min(PASSES, 1 + total // PASS_BYTES)
    turn = lambda c: F.pmod(F.xxhash64(c), F.lit(passes))
    parts = []
    for i in range(passes):
        few = pairs.where(turn("b") == i).select("a", "b")
        leaders = materialize(few.select(F.col("a").alias("mark")).distinct(), "leaders")
        parts.append(materialize(_measured(few, sets.where(turn("mark") == i), sets.join(leaders, "mark", "left_semi"),
                                           percent), "measured"))
        discard(pairs.sparkSession, leaders)
    return reduce(DataFrame.unionByName, parts)


def _measured(pairs: DataFrame, b_sets: DataFrame, a_sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``(a, b)`` with ``n`` (size of b), their exact overlap ``o``,
    whether they link, and ``rest``: what b has beside a (null where the two
    share too little for it to count, see ``_beside_leaders``); the sets are
    ``mark, shingles`` (hashes as bytes) of every mark in ``pairs``."""
    both = (pairs.select("a", "b")
            .join(b_sets.select(F.col("mark").alias("b"), F.col("shingles").alias("sb")), "b")
            .join(a_sets.select(F.col("mark").alias("a"), F.col("shingles").alias("sa")), "a"))
    out = pa.schema([("a", pa.binary()), ("b", pa.binary()), ("n", pa.int64()), ("o", pa.int64()), ("linked", pa.bool_()),
                     ("rest", pa.list_(pa.int64()))])

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, overlaps, ok, rest = [], [], [], []
            for x, y in zip(batch.column("sa"), batch.column("sb")):
                p, q = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                common = np.intersect1d(p, q, assume_unique=True)
                shared = len(common)
                sizes.append(len(q))
                overlaps.append(shared)
                ok.append(100 * shared >= percent * (len(p) + len(q) - shared))
                rest.append(np.setdiff1d(q, common, assume_unique=True).view(np.int64)
                            if (100 + percent) * shared >= percent * len(q) else None)
            yield record_batch(out, {"a": batch.column("a"), "b": batch.column("b"), "n": sizes, "o": overlaps, "linked": ok,
                                     "rest": pa.array(rest, pa.list_(pa.int64()))})

    return both.mapInArrow(check, "a binary, b binary, n long, o long, linked boolean, rest array<long>")


def _beside_leaders(compared: DataFrame, percent: int) -> DataFrame:
    """``a, r, o, s`` of the documents ``r`` that were compared with the leader
    ``a``: ``s`` bounds how many of the shingles that r has beside a are in
    another such document.

    Two documents x, y with overlaps o with a leader share at most
    ``min(o_x, o_y) + min(s_x, s_y)``. With q = percent / (100 + percent), a pair
    needs q * (n_x + n_y). So a document with o < q * n can't link with one that
    has n - o < q * n: only the others' shingles beside the leader are counted,
    and a document with n - o >= q * n keeps them all as its bound."""
    compared = compared.withColumn("near", (100 + percent) * (F.col("n") - F.col("o")) < percent * F.col("n"))
    beside = compared.where("rest is not null").select("a", "b", "near", F.explode("rest").alias("z"))
    several = beside.groupBy("a", "z").agg(F.count(F.lit(1)).alias("df")).where("df > 1").select("a", "z")
    counted = beside.where("near").join(several, ["a", "z"]).groupBy("a", "b").agg(F.count(F.lit(1)).alias("s"))
    return (compared.join(counted, ["a", "b"], "left")
            .select("a", F.col("b").alias("r"), "o",
                    F.when(F.col("near"), F.coalesce("s", F.lit(0))).otherwise(F.col("n") - F.col("o")).alias("s")))


def _across(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """The pairs of rows of ``left`` (component ``ca``) and ``right`` (``cb``) with equal
    keys and ``ca < cb``. Components are paired before their members, so that none is
    paired with itself."""
    both = left.select(*keys, "ca").distinct().join(right.select(*keys, "cb").distinct(), keys).where("ca < cb")
    return both.join(left, [*keys, "ca"]).join(right, [*keys, "cb"])


def _meeting(placed: DataFrame, percent: int) -> DataFrame:
    """The postings whose documents must be paired by their common shingle.

    With q = percent / (100 + percent), a pair needs q * (n_x + n_y), of which the leader
    holds min(o_x, o_y) at most. What else it needs both have beside the leader:
    :func:`_met_beside` finds those pairs, whose common shingles beside it are few, where
    the leader's are in all its copies. Left are the pairs of two kinds:

    0. the leader may hold all they need. A document's partner then has at most o / q - n
       shingles, and one of two documents of different components is none of the leader's.
    1. one shares so little with the leader that its ``rest`` is not kept (o < q * n), and
       neither is near the leader (see ``_beside_leaders``)."""
    placed = (placed.withColumn("reach", F.floor(F.col("o") * (100 + percent) / percent) - F.col("n"))
              .withColumn("bare", (100 + percent) * F.col("o") < percent * F.col("n")))
    facing = (placed.groupBy("h", F.col("band2").alias("band"), F.col("band").alias("band2"))
              .agg(F.max("reach").alias("most"), F.max(F.when(F.col("c") != F.col("lead"), F.col("reach"))).alias("outside"),
                   F.max("bare").alias("bare2")))
    inside = ((F.col("n") <= F.when(F.col("c") == F.col("lead"), F.col("outside")).otherwise(F.col("most")))
              & (F.col("reach") >= F.col("small2")))
    away = ((100 + percent) * (F.col("n") - F.col("o")) >= percent * F.col("n")) & (F.col("bare") | F.col("bare2"))
    kinds = F.filter(F.array(F.when(inside, 0), F.when(away, 1)), lambda kind: kind.isNotNull())
    return placed.join(facing, ["h", "band", "band2"]).withColumn("kind", F.explode(kinds))


def _met_beside(placed: DataFrame, overlaps: DataFrame, percent: int) -> DataFrame:
    """The pairs ``ra, rb`` of documents of one leader and different components that need
    more than the leader can hold of their overlap and may have as much in common beside it.

    Only shingles beside the leader that different components have can be common to such a
    pair. A document needs at least ``need`` of its ``size`` ones, so those but the
    ``need - 1`` of most documents find its partners."""
    least = F.greatest(F.col("small2"), F.ceil(F.col("n") * percent / 100))
    open_ones = (placed.where("a != r").groupBy("a", "r", "n", "c", "o").agg(F.min(least).alias("least"))
                 .withColumn("need", F.greatest(F.lit(1), F.ceil((F.col("n") + F.col("least")) * percent / (100 + percent)) - F.col("o"))))
    beside = (overlaps.where("rest is not null").select("a", F.col("b").alias("r"), F.explode("rest").alias("z"))
              .join(open_ones, ["a", "r"]))
    split = (beside.groupBy("a", "z").agg(F.count(F.lit(1)).alias("df"), F.min("c").alias("low"), F.max("c").alias("high"))
             .where("low < high").select("a", "z", "df"))
    own = Window.partitionBy("a", "r")
    beside = materialize(beside.join(split, ["a", "z"])
                         .withColumn("at", F.row_number().over(own.orderBy("df", "z")) - 1)
                         .withColumn("size", F.count(F.lit(1)).over(own)).where("at <= size - need")
                         .select("a", "z", "c", "n", "o", "r", "at", "size"), "split-beside")
    side = lambda x: beside.select("a", "z", *(F.col(c).alias(c + x) for c in ("c", "n", "o", "r", "at", "size")))
    need = percent * (F.col("na") + F.col("nb"))
    after = F.least(F.max("sizea") - F.max("ata"), F.max("sizeb") - F.max("atb")) - 1
    return (_across(side("a"), side("b"), ["a", "z"])
            .where((100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")) & ((100 + percent) * F.least("oa", "ob") < need))
            .groupBy("a", "ra", "rb", "na", "nb", F.least("oa", "ob").alias("o"))
            .agg(F.count(F.lit(1)).alias("k"), after.alias("after"))
            .where((100 + percent) * (F.col("o") + F.col("k") + F.col("after")) >= need).select("ra", "rb"))


def components(links: DataFrame) -> DataFrame:
    """``(v, c)``: the smallest mark that each mark of ``links`` reaches."""
    edges = materialize(links.select("a", "b").unionAll(links.select(F.col("b"), F.col("a"))).distinct(), "links")
    labels = materialize(edges.groupBy(F.col("a").alias("v")).agg(F.least(F.min("b"), F.col("v")).alias("c")), "labels")
    last = labels
    while True:
        near = (edges.join(labels, edges["b"] == labels["v"]).groupBy(F.col("a").alias("v"))
                .agg(F.min("c").alias("near")))
        # the smallest label around, then that label's own label
        step = labels.join(near, "v").select("v", F.col("c").alias("old"), F.least("c", "near").alias("c"))
        owner = labels.select(F.col("v").alias("w"), F.col("c").alias("up"))
        step = materialize(step.join(owner, F.col("c") == F.col("w"))
                           .select("v", F.least("c", "up").alias("c"), (F.least("c", "up") < F.col("old")).alias("moved")),
                           "labels")
        discard(links.sparkSession, last)
        last, labels = step, step.select("v", "c")
        if not step.where("moved").limit(1).count():
            discard(links.sparkSession, edges)
            return labels


def identified(docs: DataFrame) -> DataFrame:
    """``docs`` with ``doc_id`` (bigint), ``text`` (null: empty), and a key that
    any scan gives alike: ``d`` (the id, null as the smallest bigint) and ``k``
    (the text's digest)."""
    text = text_or_empty()
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text.alias("text"),
                       F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(1 << 63))).alias("d"),
                       F.unhex(F.md5(text.cast("binary"))).alias("k"))


def _named(d: str = "d", k: str = "k"):
    return F.unhex(F.md5(F.concat(F.col(d).cast("string").cast("binary"), F.col(k))))


def among(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of ``texts`` (``d, k, text``) whose ``(d, k)`` may be in ``wanted``: all
    that are, and few others. A Bloom filter of bounded size goes to the texts, so that
    the exact join that follows doesn't shuffle them all."""
    spark = texts.sparkSession
    bits = min(MOST_BITS, max(1 << 15, 1 << (16 * wanted.count()).bit_length()))
    # the four words of the digest are as many hashes of the key
    places = F.array(*(F.conv(F.substring(F.hex(_named()), 1 + 8 * i, 8), 16, 10).cast("long") % bits for i in range(4)))
    filled = (wanted.select(F.explode(places).alias("p")).groupBy(F.shiftright("p", 15).alias("piece"))
              .agg(F.bitmap_construct_agg(F.col("p") % (1 << 15)).alias("held")))
    bitmap = np.zeros(bits >> 3, np.uint8)
    for r in filled.collect():      # of bounded size; one job, not one per partition
        bitmap[r["piece"] << 12:(r["piece"] + 1) << 12] = np.frombuffer(r["held"], np.uint8)
    shared = spark.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = shared.value
        for b in batches:
            at = np.frombuffer(b"".join(b.column("key").to_pylist()), ">u4").reshape(-1, 4) % bits
            maybe = ((held[at >> 3] >> (at & 7).astype(np.uint8)) & 1).all(1)
            if maybe.any():
                yield b.select(["d", "k", "text"]).filter(pa.array(maybe))

    return texts.withColumn("key", _named()).mapInArrow(run, "d long, k binary, text string")


def join(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, d, k, n_shingles, component_id`` per row of ``docs``, and the
    key ``(keep_d, keep_k)`` of the document that stands for its component (of
    smallest id; its own key where the set is empty)."""
    spark = docs.sparkSession
    source = identified(docs)
    rows = materialize(source.select("doc_id", "d", "k", F.octet_length("text").alias("bytes")), "document-keys")
    # equal texts: one stands for all
    same = materialize(rows.groupBy("k").agg(F.min("doc_id").alias("least"),
                                             F.min(F.struct(F.col("doc_id").isNull().alias("o"), "d", "k")).alias("lead")),
                       "equal-texts")
    total = rows.agg(F.sum("bytes")).first()[0] or 0
    # equal texts have equal sets, of which one is taken below
    with small_batches(spark):
        sets = materialize(prefix_sets(source, total, words, percent), "sets")
    kinds = materialize(sets.select("k", "n", "mark", "alive").dropDuplicates(["k"])
                        .join(same.select("k", "least", "lead"), "k"), "kinds")
    # equal sets: one stands for all
    equal = materialize(kinds.where("alive").groupBy("mark").agg(F.min("least").alias("least"), F.min("lead").alias("lead")),
                        "equal-sets")
    reps = sets.where("alive").select("mark", "n", "m", "first", "prefix").dropDuplicates(["mark"])
    posts = materialize(reps.select(F.col("mark").alias("r"), "n", "m", "first", F.posexplode("prefix").alias("at", "h"))
                        .withColumn("at", F.col("at") + F.col("first")).drop("first"), "postings")
    several = posts.groupBy("h").agg(F.count(F.lit(1)).alias("df")).where("df > 1").select("h")
    # only shingles of several documents. What precedes a posting in its prefix
    # and is in no other prefix is in no partner either, since a partner with
    # this shingle in its prefix would have had it there too: ``cap`` bounds the
    # overlap with any partner met here
    ranked = F.row_number().over(Window.partitionBy("r").orderBy("at")) - 1
    shared = materialize(posts.join(several, "h").withColumn("cap", F.col("n") - (F.col("at") - ranked)),
                         "shared-postings")
    discard(spark, posts)
    # a posting is led by the document that has least of its own before it: the
    # original rather than a copy
    heads = (shared.groupBy("h").agg(F.min(F.struct((F.col("n") - F.col("cap")).alias("own"), "n", F.col("r").alias("a"), "m",
                                                    "cap", "at")).alias("head"))
             .select("h", "head.a", F.col("head.n").alias("na"), F.col("head.m").alias("ma"), F.col("head.cap").alias("cap_a"),
                     F.col("head.at").alias("at_a")))

    def fits(a: str, b: str, cap_a: str | None = None, cap_b: str | None = None):
        near = 100 * F.least(a, b) >= percent * F.greatest(a, b)
        return near if cap_a is None else near & (
            (100 + percent) * F.least(cap_a, cap_b) >= percent * (F.col(a) + F.col(b)))

    stars = (shared.join(heads, "h").where((F.col("r") != F.col("a")) & fits("n", "na", "cap", "cap_a"))
             .groupBy("a", F.col("r").alias("b")).agg(F.min(F.least("m", "ma")).alias("m")).select("a", "b"))
    stars = materialize(stars, "star-pairs")
    wanted = materialize(equal.join(shared.select(F.col("r").alias("mark")).distinct(), "mark", "left_semi")
                         .select("mark", F.col("lead.d").alias("d"), F.col("lead.k").alias("k")), "wanted")
    # repeated rows go while they lie together by (d, k), before the larger sets are made
    texts = (among(source.select("d", "k", "text"), wanted).join(wanted, ["d", "k"])
             .dropDuplicates(["d", "k"]).select("mark", "text"))
    with small_batches(spark):
        held = materialize(texts.mapInArrow(_shingle_bytes(words), "mark binary, shingles binary"), "shingles")
    compared = measured(stars, held, total, percent)
    links = compared.where("linked").select("a", "b")

    # postings whose documents are not all connected yet
    parts = components(links)
    placed = (shared.select("h", "r", "n", "m", "cap", "at")
              .join(parts.select(F.col("v").alias("r"), "c"), "r", "left")
              .withColumn("c", F.coalesce("c", "r"))
              .join(heads.select("h", "a").join(parts.select(F.col("v").alias("a"), F.col("c").alias("lead")), "a", "left")
                    .select("h", "a", F.coalesce("lead", "a").alias("lead")), "h"))
    # sizes that a posting's partners may have, by bands of sizes, of which a posting
    # faces a fixed number whatever its shingle's documents are
    band = F.floor(F.log(F.col("n").cast("double")) * (BANDS / math.log(100 / min(percent, 99)))).cast("int")
    placed = placed.withColumn("band", band)
    sizes = placed.groupBy("h", "band").agg(F.max("cap").alias("best"), F.min("c").alias("low"), F.max("c").alias("high"),
                                            F.min("n").alias("small"), F.max("n").alias("large"))
    own, other = (sizes.select("h", *(F.col(c).alias(c + side) for c in sizes.columns[1:])) for side in ("", "2"))
    # the least size of a partner in the band
    least = F.greatest(F.col("small2"), F.ceil(F.col("n") * percent / 100))
    facing = (own.join(other, "h")
              .where((F.abs(F.col("band") - F.col("band2")) <= BANDS + 1)
                     & (100 * F.least("large", "large2") >= percent * F.greatest("small", "small2"))
                     & ((100 + percent) * F.least("best", "best2") >= percent * (F.col("small") + F.col("small2")))
                     # of all the documents of both bands, some must be in different components
                     & (F.least("low", "low2") < F.greatest("high", "high2")))
              .select("h", "band", "band2", "best2", "small2", "large2", "low2", "high2"))
    placed = materialize(placed.join(facing, ["h", "band"])
                         .where((100 * F.col("large2") >= percent * F.col("n")) & (100 * F.col("n") >= percent * F.col("small2"))
                                & ((100 + percent) * F.least("cap", "best2") >= percent * (F.col("n") + least))
                                & ((F.col("c") != F.col("low2")) | (F.col("c") != F.col("high2"))))
                         .select("h", "n", "band", "band2", "small2", "r", "m", "cap", "at", "c", "a", "lead"), "open-postings")
    # what the leaders rule out. A document that links with its leader is in the
    # leader's component, so of a pair across components one has at most ``far``
    # in common with the leader
    asked = placed.where("a != r").select("a", F.col("r").alias("b")).distinct()
    unmet = materialize(asked.join(compared.select("a", "b"), ["a", "b"], "left_anti"), "unmet-pairs")
    rest = measured(unmet, held, total, percent)
    overlaps = materialize(compared.join(asked, ["a", "b"], "left_semi").unionByName(rest), "overlaps")
    beside = materialize(_beside_leaders(overlaps, percent), "beside-leaders")
    placed = (placed.join(beside, ["a", "r"], "left")
              .withColumn("s", F.when(F.col("a") == F.col("r"), 0).otherwise(F.col("s")))
              .withColumn("o", F.when(F.col("a") == F.col("r"), F.col("n")).otherwise(F.col("o"))))
    outside = placed.groupBy("h", "band", "band2").agg(F.max(F.when(F.col("c") != F.col("lead"), F.col("o"))).alias("far"))
    far = (outside.unionAll(outside.select("h", F.col("band2").alias("band"), F.col("band").alias("band2"), "far"))
           .groupBy("h", "band", "band2").agg(F.max("far").alias("far")).where("far is not null"))
    placed = materialize(placed.join(far, ["h", "band", "band2"])
                         .withColumn("cap", F.least("cap", F.least("o", "far") + F.col("s")))
                         .where((100 + percent) * F.col("cap") >= percent * (F.col("n") + least))
                         .select("h", "n", "band", "band2", "small2", "r", "m", "cap", "at", "c", "a", "lead", "o", "s"),
                         "facing-postings")
    met = _meeting(placed, percent)
    side = lambda x, band, band2: met.select(
        "h", "kind", F.col(band).alias("pa"), F.col(band2).alias("pb"), F.col("c").alias("c" + x), F.col("n").alias("n" + x),
        F.col("r").alias("r" + x), F.col("m").alias("m" + x), F.col("cap").alias("cap_" + x), F.col("at").alias("at_" + x),
        F.col("o").alias("o" + x), F.col("s").alias("s" + x))
    held_by_leader = (100 + percent) * F.least("oa", "ob") >= percent * (F.col("na") + F.col("nb"))
    uncounted = (((100 + percent) * F.col("oa") < percent * F.col("na"))
                 | ((100 + percent) * F.col("ob") < percent * F.col("nb")))
    # the overlap is at most what the prefixes share and what follows the last of it
    after = F.least(F.max(F.col("na")) - F.max("at_a"), F.max(F.col("nb")) - F.max("at_b")) - 1
    pairs = (_across(side("a", "band", "band2"), side("b", "band2", "band"), ["h", "pa", "pb", "kind"])
             .where(fits("na", "nb", "cap_a", "cap_b") & F.when(F.col("kind") == 0, held_by_leader).otherwise(~held_by_leader & uncounted)
                    & ((100 + percent) * (F.least("oa", "ob") + F.least("sa", "sb")) >= percent * (F.col("na") + F.col("nb"))))
             .groupBy("ra", "rb")
             .agg(F.count(F.lit(1)).alias("k"), F.min(F.least("ma", "mb")).alias("m"), after.alias("after"),
                  F.max(F.col("na") + F.col("nb")).alias("both"))
             .where((F.col("k") >= F.col("m")) & ((100 + percent) * (F.col("k") + F.col("after")) >= percent * F.col("both")))
             .select("ra", "rb"))
    pairs = (pairs.unionAll(_met_beside(placed, overlaps, percent))
             .select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct())
    tested = stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    pairs = materialize(pairs.join(tested, ["a", "b"], "left_anti"), "cross-pairs")
    more = materialize(measured(pairs, held, total, percent).where("linked").select("a", "b"), "cross-links")
    final = components(links.unionByName(more)) if more.limit(1).count() else parts

    names = (kinds.join(final, F.col("mark") == F.col("v"), "left")
             .select("k", "n", "least", "lead", F.coalesce("c", F.when(F.col("alive"), F.col("mark")), "k").alias("c")))
    ids = names.groupBy("c").agg(F.min("least").alias("component_id"), F.min("lead").alias("lead"))
    named = names.select("k", "n", "c").join(ids, "c").select("k", "n", "component_id", "lead")
    empty = F.col("n") == 0
    return (rows.select("doc_id", "d", "k").join(named, "k")
            .select("doc_id", "d", "k", F.col("n").alias("n_shingles"),
                    F.when(empty, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"),
                    F.when(empty, F.col("d")).otherwise(F.col("lead.d")).alias("keep_d"),
                    F.when(empty, F.col("k")).otherwise(F.col("lead.k")).alias("keep_k")))


def _shingle_bytes(words: int):
    schema = pa.schema([("mark", pa.binary()), ("shingles", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            sets = shingle_sets(b.column("text").to_pylist(), words)
            yield record_batch(schema, {"mark": b.column("mark"), "shingles": [s.tobytes() for s in sets]})
    return run


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every document."""
    return join(docs, words, percent).select("doc_id", "n_shingles", "component_id")


def distinct_documents(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` that stay when each component keeps one document
    (of smallest id, one row of it); documents without words all stay."""
    found = join(docs, words, percent)
    keepers = (found.where((F.col("d") == F.col("keep_d")) & (F.col("k") == F.col("keep_k")))
               .groupBy("d", "k").agg(F.max("n_shingles").alias("_n")))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_row"),
                       F.coalesce(F.col("doc_id").cast("bigint"), F.lit(-(1 << 63))).alias("d"),
                       F.unhex(F.md5(text_or_empty().cast("binary"))).alias("k"))
    once = Window.partitionBy("d", "k").orderBy(F.lit(0))
    return (rows.join(keepers, ["d", "k"]).withColumn("_nth", F.row_number().over(once))
            .where((F.col("_nth") == 1) | (F.col("_n") == 0)).select("_row.*"))
