"""Nearest neighbours with one navigable small-world graph per shard.

Distinct vectors are dealt into shards of about ``SHARD`` by id hash. A shard's
index is one row of flat arrays: its vectors, and per layer the members and an
``int32`` neighbour array (``-1`` for none). Every vector is in layer 0; a
vector reaches layer ``l`` with probability ``LINKS ** -l`` (from its id hash).
A layer links each member to its nearest members in the layer, chosen so that
they lie in different directions, and back. A search descends greedily through
the layers and then keeps a beam of ``BEAM`` vectors in layer 0; blocks of
queries advance together. Shard results are rescored in double precision on the
original vectors and merged by a top-k window.

Equal vectors are indexed once with their ``k + 1`` smallest ids, which is all
that a top-k answer can hold of them, so a vector that fills the table costs
nothing. Vectors of one length are a space of their own, with its own shards. A task
reads a shard's index once with up to about ``QUERIES_AT_ONCE`` queries; a query is
searched in every shard of its space.

Edge cases: vectors that are null, empty, zero or hold null or non-finite
components take no part, nor do null ids; a query's candidates are the vectors of its
own length; repeated ids of different vectors are candidates each; with fewer than ``k`` candidates all are returned; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, record_batch

SHARD = 8192
LINKS = 16                # per member above layer 0; twice as many in layer 0
CANDIDATES = 48           # nearest members among which links are chosen
BEAM = 128
EXPAND = 4                # vectors of the beam that are expanded at a time
QUERY_BLOCK = 256         # that advance together
QUERIES_AT_ONCE = 16384   # of one task beside a shard's index


def unit(vectors: np.ndarray) -> np.ndarray:
    v = vectors.astype(np.float64)
    return (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)


def layer_links(vectors: np.ndarray, most: int) -> np.ndarray:
    """Neighbour array ``[n, most]`` of one layer (unit vectors)."""
    n = len(vectors)
    if n < 2:
        return np.full((n, most), -1, np.int32)
    c = min(CANDIDATES, n - 1)
    source, target, rank = [], [], []
    for first in range(0, n, 512):
        part = vectors[first:first + 512]
        own = np.arange(first, first + len(part))
        near = part @ vectors.T
        near[np.arange(len(part)), own] = -np.inf
        cand = np.argpartition(-near, c - 1, axis=1)[:, :c]
        sims = np.take_along_axis(near, cand, 1)
        order = np.argsort(-sims, axis=1, kind="stable")
        cand, sims = np.take_along_axis(cand, order, 1), np.take_along_axis(sims, order, 1)
        held = vectors[cand]
        mutual = held @ held.transpose(0, 2, 1)
        kept = np.zeros((len(part), c), bool)
        for j in range(c):
            # nearer to the member than to every link chosen so far
            rival = np.where(kept[:, :j], mutual[:, j, :j], -np.inf).max(1, initial=-np.inf)
            kept[:, j] = (rival < sims[:, j]) & (kept.sum(1) < most // 2)
        # spread links first, then the nearest of the others
        place = np.argsort(np.where(kept, 0, c) + np.arange(c), axis=1, kind="stable")[:, :most // 2]
        source.append(np.repeat(own, place.shape[1]))
        target.append(np.take_along_axis(cand, place, 1).reshape(-1))
        rank.append(np.tile(np.arange(place.shape[1]), len(part)))
    source, target, rank = map(np.concatenate, (source, target, rank))
    a, b = np.concatenate([source, target]), np.concatenate([target, source])
    r = np.concatenate([rank, rank + most])
    order = np.lexsort((r, b, a))
    a, b, r = a[order], b[order], r[order]
    first = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])
    a, b, r = a[first], b[first], r[first]
    order = np.lexsort((r, a))
    a, b = a[order], b[order]
    place = np.arange(len(a)) - np.searchsorted(a, a)
    out = np.full((n, most), -1, np.int32)
    fits = place < most
    out[a[fits], place[fits]] = b[fits]
    return out


def build(vectors: np.ndarray, draws: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Members and neighbour arrays per layer. Neighbours are positions in the
    shard; ``draws`` are uniform in (0, 1]."""
    v, levels = unit(vectors), np.floor(-np.log(draws) / math.log(LINKS)).astype(int)
    members, links = [], []
    for level in range(int(levels.max(initial=0)) + 1):
        own = np.flatnonzero(levels >= level).astype(np.int32)
        local = layer_links(v[own], 2 * LINKS if level == 0 else LINKS)
        members.append(own)
        links.append(np.where(local >= 0, own[local], -1).astype(np.int32))
    return members, links


def _distances(v: np.ndarray, queries: np.ndarray, ids: np.ndarray) -> np.ndarray:
    return np.where(ids >= 0, np.einsum("qmd,qd->qm", v[ids], queries), -np.inf)


def search(v: np.ndarray, members: list, links: list, queries: np.ndarray, beam: int = BEAM) -> np.ndarray:
    """Positions ``[queries, beam]`` of the best found, best first (-1: none)."""
    q, n = len(queries), len(v)
    at = np.full(q, members[-1][0])
    for level in range(len(members) - 1, 0, -1):
        where = np.full(n, -1, np.int64)
        where[members[level]] = np.arange(len(members[level]))
        best = _distances(v, queries, at[:, None])[:, 0]
        while True:
            near = links[level][where[at]]
            sims = _distances(v, queries, near)
            top = sims.argmax(1)
            better = sims[np.arange(q), top] > best
            if not better.any():
                break
            at = np.where(better, near[np.arange(q), top], at)
            best = np.where(better, sims[np.arange(q), top], best)
    seen = np.zeros((q, n + 1), bool)
    row = np.arange(q)[:, None]
    seen[row[:, 0], at] = True
    seen[:, n] = True
    ids = np.full((q, beam), -1, np.int64)
    sims = np.full((q, beam), -np.inf, np.float32)
    ids[:, 0], sims[:, 0] = at, _distances(v, queries, at[:, None])[:, 0]
    fresh = ids >= 0
    while fresh.any():
        # the best few that have not been expanded
        pick = np.argsort(np.where(fresh, -sims, np.inf), axis=1, kind="stable")[:, :EXPAND]
        use = np.take_along_axis(fresh, pick, 1)
        fresh[row, pick] = False
        nodes = np.where(use, np.take_along_axis(ids, pick, 1), -1)
        near = np.where(nodes[..., None] >= 0, links[0][nodes], -1).reshape(q, -1)
        near = np.where(near >= 0, near, n)
        near = np.where(seen[row, near], n, near)
        near.sort(axis=1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = n
        seen[row, near] = True
        near = np.where(near == n, -1, near)
        new = _distances(v, queries, near)
        ids, sims = np.concatenate([ids, near], 1), np.concatenate([sims, new.astype(np.float32)], 1)
        fresh = np.concatenate([fresh, near >= 0], 1)
        order = np.argsort(-sims, axis=1, kind="stable")[:, :beam]
        ids, sims, fresh = (np.take_along_axis(x, order, 1) for x in (ids, sims, fresh))
        fresh &= ids >= 0
    return ids


def valid(table: DataFrame) -> DataFrame:
    """Rows that take part, as ``(vec_id, v array<float>)``."""
    ok = (F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0)
          & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
          & F.exists("v", lambda x: x != 0))
    return table.select(F.col("vec_id").cast("bigint").alias("vec_id"),
                        F.col("embedding").cast("array<float>").alias("v")).where(ok)


INDEX = pa.schema([("shard", pa.int64()), ("dim", pa.int32()), ("vectors", pa.binary()), ("ids", pa.list_(pa.list_(pa.int64()))),
                   ("members", pa.list_(pa.binary())), ("links", pa.list_(pa.binary()))])
_INDEX = ("shard long, dim int, vectors binary, ids array<array<long>>, members array<binary>, links array<binary>")


def build_index(rows: DataFrame, k: int, shard: int = SHARD) -> tuple[DataFrame, DataFrame]:
    """The index table (one row per vector length and shard) and the number of
    shards of each length (``dim, shards``)."""
    nth = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    distinct = materialize(rows.withColumn("_n", nth).where(F.col("_n") <= k + 1)
                           .groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")), "vectors")
    distinct = distinct.withColumn("dim", F.size("v"))
    spaces = materialize(distinct.groupBy("dim").agg(F.ceil(F.count(F.lit(1)) / shard).alias("shards")), "spaces")
    draw = (F.pmod(F.xxhash64(F.col("ids")[0], F.lit(5)), F.lit(1 << 52)) + 1) / float(1 << 52)
    placed = distinct.join(spaces, "dim").select("dim", "v", "ids", F.pmod(F.xxhash64(F.col("ids")[0]), "shards").alias("shard"),
                                                 draw.alias("draw"))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("draw").combine_chunks()      # one order, whatever order the rows came in
        dim = len(table["v"][0])
        vectors = table["v"].chunk(0).flatten().to_numpy().reshape(-1, dim)
        members, links = build(vectors, table["draw"].to_numpy())
        return pa.Table.from_batches([record_batch(INDEX, {
            "shard": [table["shard"][0].as_py()], "dim": [dim], "vectors": [vectors.astype("<f4").tobytes()],
            "ids": [table["ids"].to_pylist()], "members": [[m.tobytes() for m in members]],
            "links": [[x.tobytes() for x in links]]})])

    return materialize(placed.groupBy("dim", "shard").applyInArrow(run, _INDEX), "graph-index"), spaces


FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])


def _search_shard(k: int, beam: int):
    def run(asked: pa.Table, index: pa.Table) -> pa.Table:
        if not asked.num_rows or not index.num_rows:
            return FOUND.empty_table()
        row = {c: index[c][0] for c in index.column_names}
        dim = row["dim"].as_py()
        vectors = np.frombuffer(row["vectors"].as_buffer(), "<f4").reshape(-1, dim)
        members = [np.frombuffer(m.as_buffer(), np.int32) for m in row["members"]]
        links = [np.frombuffer(x.as_buffer(), np.int32).reshape(len(m), -1) for x, m in zip(row["links"], members)]
        ids = row["ids"].values
        v, wide = unit(vectors), vectors.astype(np.float64)
        norms = np.linalg.norm(wide, axis=1)
        asked = asked.combine_chunks()
        query_ids = asked["vec_id"].to_numpy()
        queries = asked["v"].chunk(0).flatten().to_numpy().reshape(-1, dim)
        out = []
        for first in range(0, len(queries), QUERY_BLOCK):
            block = queries[first:first + QUERY_BLOCK]
            found = search(v, members, links, unit(block), beam)[:, :4 * k]
            for own, q, places in zip(query_ids[first:].tolist(), block.astype(np.float64), found):
                places = places[places >= 0]
                scores = (wide[places] * q).sum(1) / (norms[places] * np.sqrt((q * q).sum()))
                near = [(-s, c) for s, p in zip(scores.tolist(), places.tolist()) for c in ids[p].as_py() if c != own]
                out += [(own, c, -s) for s, c in sorted(near)[:k]]
        return pa.Table.from_batches([record_batch(FOUND, dict(zip(FOUND.names, map(list, zip(*out)))))] if out else [], FOUND)
    return run


def nearest(table: DataFrame, queries: DataFrame, k: int = 5, shard: int = SHARD, beam: int = BEAM) -> DataFrame:
    """``query_id, rank, vec_id, score``: the ``k`` nearest found in ``table``
    for every row of ``queries`` (tables with ``vec_id, embedding``)."""
    index, spaces = build_index(valid(table), k, shard)
    asked = materialize(valid(queries).distinct(), "graph-queries")
    parts = max(1, -(-asked.count() // QUERIES_AT_ONCE))
    keys = ["dim", "shard", "part"]
    every = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("shards") - 1))
    asked = (asked.withColumn("dim", F.size("v")).join(spaces, "dim")
             .select("dim", "vec_id", "v", F.pmod(F.xxhash64("vec_id"), F.lit(parts)).alias("part"), every.alias("shard")))
    beside = index.withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(parts - 1).cast("bigint"))))
    found = (asked.groupBy(*keys).cogroup(beside.groupBy(*keys))
             .applyInArrow(_search_shard(k, beam), "query_id long, vec_id long, score double"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (found.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k)
            .select("query_id", "rank", "vec_id", "score"))
