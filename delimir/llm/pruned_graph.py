"""Approximate nearest neighbours by a robust-pruned directed graph per shard.

Equal vectors are one node; a node remembers the least ids of its copies, as many as any answer can
name, so a vector that a third of all rows share costs one node.  Nodes are dealt to shards by hash.
In a shard a greedy beam search over the graph so far proposes each node's neighbours; pruning
keeps the nearest and drops what an already kept neighbour is ALPHA times nearer to; reverse edges
are added and pruned alike.  Inner product becomes Euclidean distance by one more coordinate that
gives all nodes of a shard the same length.

A query's beam search visits every shard, so shards grow with the table up to a bound, and beams with
the root of that (``beam_of``); beams are scored again in double precision on the original vectors, and
the best of all shards are merged.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import written

K = 20
EVERY = 20
#: Nodes of a shard: at least SHARD, so many that there are about SHARDS shards, at most MOST, which is what a task's memory is made for.
SHARD, SHARDS, MOST = 8192, 16, 131072
#: Out-edges, beams while building and searching a shard of SHARD nodes, and how much nearer a kept neighbour must be.
DEGREE = 32
BUILD_BEAM, SEARCH_BEAM = 64, 128
ALPHA = 1.2
ENTRIES = 8
#: Nodes that a beam expands in one step, and rows that are searched together.
WIDE, BATCH = 4, 512
QUERY_BLOCK = 2048


def shard_size(n: int, least: int = SHARD, shards: int = SHARDS, most: int = MOST) -> int:
    """Nodes of a shard of a table of n nodes."""
    return max(least, min(most, -(-n // shards)))


def beam_of(beam: int, nodes: int, least: int = SHARD) -> int:
    """The beam for a shard of so many nodes: recall falls with a graph's size unless beams grow."""
    return max(beam, math.ceil(beam * math.sqrt(nodes / least)))


def lifted(vectors: np.ndarray) -> np.ndarray:
    """Nodes with the coordinate that turns inner products into distances, in single precision."""
    norms = (vectors * vectors).sum(1)
    top = norms.max() if len(norms) else 1.0
    scale = 1 / np.sqrt(top)
    return np.concatenate([vectors * scale, np.sqrt(np.maximum(0, 1 - norms / top))[:, None]], axis=1).astype(np.float32)


def entries(n: int, x: np.ndarray) -> np.ndarray:
    """Where searches start: the node nearest to the mean, and evenly spaced ones."""
    return np.unique(np.append(np.linspace(0, n - 1, min(ENTRIES, n)).astype(np.int64), int(np.argmax(x @ x.mean(0)))))


def beam_search(x: np.ndarray, graph: np.ndarray, q: np.ndarray, starts: np.ndarray, beam: int, wide: int = WIDE) -> np.ndarray:
    """The ``beam`` nearest nodes met for each query, nearest first (-1: fewer)."""
    n, b = len(x), len(q)
    rows = np.arange(b)[:, None]
    seen = np.zeros((b, n + 1), bool)
    seen[:, n] = True
    seen[:, starts] = True
    ids = np.full((b, beam), n, np.int64)
    dist = np.full((b, beam), np.inf, np.float32)
    done = np.ones((b, beam), bool)
    k = min(beam, len(starts))
    first = -2 * (q @ x[starts].T)
    order = np.argsort(first, axis=1, kind="stable")[:, :k]
    ids[:, :k], dist[:, :k], done[:, :k] = starts[order], np.take_along_axis(first, order, 1), False
    edges = np.concatenate([np.where(graph < 0, n, graph), np.full((1, graph.shape[1]), n, graph.dtype)])
    padded = np.concatenate([x, np.zeros((1, x.shape[1]), np.float32)])
    live = np.arange(b)
    while len(live):
        r = rows[: len(live)]
        todo = ~done[live]
        # the first ``wide`` open entries of each beam
        rank = np.cumsum(todo, axis=1)
        pick = todo & (rank <= wide)
        slot = np.argsort(~pick, axis=1, kind="stable")[:, :wide]
        valid = np.take_along_axis(pick, slot, 1)
        nodes = np.where(valid, np.take_along_axis(ids[live], slot, 1), n)
        done[live[:, None], slot] |= valid
        near = edges[nodes].reshape(len(live), -1).astype(np.int64)
        near = np.where(seen[live[:, None], near], n, near)
        near.sort(axis=1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = n
        seen[live[:, None], near] = True
        d = -2 * np.einsum("bkd,bd->bk", padded[near], q[live], optimize=True)
        d[near == n] = np.inf
        all_d = np.concatenate([dist[live], d], axis=1)
        order = np.argpartition(all_d, beam - 1, axis=1)[:, :beam] if all_d.shape[1] > beam else np.tile(np.arange(beam), (len(live), 1))
        best = np.take_along_axis(all_d, order, 1)
        fine = np.argsort(best, axis=1, kind="stable")
        order = np.take_along_axis(order, fine, 1)
        dist[live] = np.take_along_axis(all_d, order, 1)
        all_i = np.concatenate([ids[live], near], axis=1)
        all_f = np.concatenate([done[live], near == n], axis=1)
        ids[live], done[live] = all_i[r, order], all_f[r, order]
        live = live[~done[live].all(axis=1)]
    return np.where(np.isinf(dist), -1, ids)


def prune(x: np.ndarray, point: np.ndarray, cand: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Robust pruning of many points at once: diverse near neighbours of each (-1: fewer).  cand: -1 is none."""
    cand = np.where(cand == point[:, None], -1, cand)
    srt = np.sort(cand, axis=1)
    srt[:, 1:][srt[:, 1:] == srt[:, :-1]] = -1
    c = x[np.maximum(srt, 0)]
    own = 2 - 2 * np.einsum("bkd,bd->bk", c, x[point], optimize=True)
    own[srt < 0] = np.inf
    between = 2 - 2 * (c @ c.transpose(0, 2, 1))
    out = np.full((len(point), degree), -1, np.int64)
    rows = np.arange(len(point))
    for k in range(degree):
        j = np.argmin(own, axis=1)
        ok = np.isfinite(own[rows, j])
        if not ok.any():
            break
        out[ok, k] = srt[rows[ok], j[ok]]
        own[(alpha * alpha) * between[rows, j] <= own] = np.inf
        own[rows, j] = np.inf
    return out


def build(x: np.ndarray, degree: int = DEGREE, beam: int = BUILD_BEAM, alpha: float = ALPHA, seed: int = 11) -> np.ndarray:
    """Out-neighbours (n, degree) of each node, -1 for none."""
    n = len(x)
    rng = np.random.default_rng(seed)
    if n <= degree + 1:
        full = np.tile(np.arange(n), (n, 1))
        return np.array([np.append(np.delete(r, i), [-1] * (degree - n + 1)) for i, r in enumerate(full)], np.int64).reshape(n, degree)
    graph = np.full((n, degree), -1, np.int64)
    graph[:, : degree // 2] = rng.integers(0, n, (n, degree // 2))
    starts = entries(n, x)
    order = rng.permutation(n)
    for at in range(0, n, BATCH):
        point = order[at : at + BATCH]
        found = beam_search(x, graph, x[point], starts, beam)
        for lo in range(0, len(point), 128):
            p = point[lo : lo + 128]
            graph[p] = prune(x, p, np.concatenate([found[lo : lo + 128], graph[p]], axis=1), degree, alpha)
        # reverse edges, by their target
        src = np.repeat(point, degree)
        dst = graph[point].ravel()
        src, dst = src[dst >= 0], dst[dst >= 0]
        by = np.argsort(dst, kind="stable")
        src, dst = src[by], dst[by]
        target, first, count = np.unique(dst, return_index=True, return_counts=True)
        for lo in range(0, len(target), 128):
            t, f, c = target[lo : lo + 128], first[lo : lo + 128], count[lo : lo + 128]
            more = np.full((len(t), int(c.max())), -1, np.int64)
            more[np.repeat(np.arange(len(t)), c), np.concatenate([np.arange(k) for k in c])] = src[np.concatenate([np.arange(a, a + k) for a, k in zip(f, c, strict=True)])]
            both = np.concatenate([graph[t], more], axis=1)
            free = (graph[t] >= 0).sum(1) + c <= degree
            if free.any():
                srt = -np.sort(-both[free], axis=1)
                graph[t[free]] = srt[:, :degree]
            if (~free).any():
                graph[t[~free]] = prune(x, t[~free], both[~free], degree, alpha)
    return graph


def _vectors(table: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, v array<double>) of the rows that take part."""
    v = F.col("v")
    ok = v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != float("inf"))) & F.exists(v, lambda e: e != 0)
    return table.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{vec_col}`").cast("array<double>").alias("v")).where(F.col("id").isNotNull() & F.coalesce(ok, F.lit(False)))


def nodes(rows: DataFrame, k: int = K) -> DataFrame:
    """(dim, h, v, ids): distinct vectors with the k + 1 least ids of their copies.

    Each task sends the least ids of each vector it holds, so copies are gathered before they move.
    """

    names, schema = ["dim", "h", "h2", "v", "ids"], "dim int, h long, h2 long, v array<double>, ids array<long>"

    def out(held: dict[tuple, tuple[list, list]]) -> pa.RecordBatch:
        keys = list(held)
        return pa.RecordBatch.from_arrays([pa.array([len(held[x][1]) for x in keys], pa.int32()), pa.array([x[0] for x in keys], pa.int64()), pa.array([x[1] for x in keys], pa.int64()), pa.array([held[x][1] for x in keys], pa.list_(pa.float64())), pa.array([sorted(held[x][0])[: k + 1] for x in keys], pa.list_(pa.int64()))], names=names)

    def add(ids: list, more: list) -> None:
        ids += more
        if len(ids) > 4 * k + 4:
            ids.sort()
            del ids[k + 1 :]

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, tuple[list, list]] = {}
        for b in batches:
            vs = b.column(3)
            for i, (row, h, h2) in enumerate(zip(*(b.column(j).to_pylist() for j in range(3)), strict=True)):
                if (h, h2) not in held:
                    held[h, h2] = ([], vs[i].as_py())
                add(held[h, h2][0], [row])
            if len(held) >= 20_000:
                yield out(held)
                held = {}
        if held:
            yield out(held)

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by vector: a vector's ids are merged as they come, never held together."""
        held: dict[tuple, tuple[list, list]] = {}
        for b in batches:
            for i, key in enumerate(zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True)):
                if key not in held:
                    if len(held) >= 4096:
                        yield out(held)
                        held = {}
                    held[key] = ([], b.column(3)[i].as_py())
                add(held[key][0], b.column(4)[i].as_py())
        if held:
            yield out(held)

    zero = F.transform("v", lambda e: F.when(e == 0, 0.0).otherwise(e))  # 0 and -0 are equal
    some = rows.select("id", F.xxhash64(zero).alias("h"), F.xxhash64(F.lit(7), zero).alias("h2"), zero.alias("v"))
    some = some.mapInArrow(least, schema)
    return some.repartition("dim", "h", "h2").sortWithinPartitions("dim", "h", "h2").mapInArrow(merged, schema)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy().reshape(-1, dim)


def index(table: DataFrame, id_col: str, vec_col: str, shard: int = SHARD, shards: int = SHARDS, most: int = MOST, k: int = K) -> DataFrame:
    """(dim, shard, shards, vectors, graph, ids, at): one row per shard, as written to the shared folder."""
    all_nodes = written(nodes(_vectors(table, id_col, vec_col), k), "nodes")
    counts = {r["dim"]: -(-r["n"] // shard_size(r["n"], shard, shards, most)) for r in all_nodes.groupBy("dim").agg(F.count("*").alias("n")).collect()}
    if not counts:
        counts = {0: 1}
    parts = F.try_element_at(F.create_map(*[F.lit(x) for kv in sorted(counts.items()) for x in kv]), "dim")
    dealt = all_nodes.withColumn("shards", parts).withColumn("shard", F.pmod("h", "shards").cast("int"))
    dealt = dealt.repartition(sum(counts.values()), "dim", "shard").sortWithinPartitions("dim", "shard", "h", "h2")

    def make(batches):
        now, vs, ids, total = None, [], [], 0

        def out():
            x = np.concatenate(vs)
            g = build(lifted(x), beam=beam_of(BUILD_BEAM, len(x), shard)).astype(np.int32)
            at = np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int64)
            return pa.RecordBatch.from_arrays([pa.array([now[0]], pa.int32()), pa.array([now[1]], pa.int32()), pa.array([total], pa.int32()), pa.array([x.tobytes()]), pa.array([g.tobytes()]), pa.array([np.array([i for one in ids for i in one], np.int64).tobytes()]), pa.array([at.tobytes()])], names=["dim", "shard", "shards", "vectors", "graph", "ids", "at"])

        for b in batches:
            dims, sh = b.column(0).to_numpy(), b.column(1).to_numpy()
            cut = [0, *(np.flatnonzero((np.diff(dims) != 0) | (np.diff(sh) != 0)) + 1).tolist(), b.num_rows]
            for lo, hi in zip(cut[:-1], cut[1:], strict=True):
                if lo == hi:
                    continue
                key = (int(dims[lo]), int(sh[lo]))
                if key != now:
                    if vs:
                        yield out()
                    now, vs, ids, total = key, [], [], b.column(2)[lo].as_py()
                part = b.slice(lo, hi - lo)
                vs.append(_matrix(part.column(3), key[0]))
                ids += part.column(4).to_pylist()
        if vs:
            yield out()

    return written(dealt.select("dim", "shard", "shards", "v", "ids").mapInArrow(make, "dim int, shard int, shards int, vectors binary, graph binary, ids binary, at binary"), "graph")


def search(table: DataFrame, queries: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = K, beam: int = SEARCH_BEAM, shard: int = SHARD, shards: int = SHARDS, most: int = MOST) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each query row, itself left out.

    ``queries`` has the same columns as ``table``.  Vectors that are null, empty, zero or hold null
    or non-finite numbers take no part; vectors of other dimensions aren't compared.  Ties go to
    smaller ids; rows with one id are rows of their own, and a query leaves out one of them.
    """
    graphs = index(table, id_col, vec_col, shard, shards, most, k)
    asked = _vectors(queries, id_col, vec_col).select(F.monotonically_increasing_id().alias("row"), F.col("id").alias("q"), F.size("v").alias("dim"), "v")
    asked = written(asked.withColumn("block", (F.col("row") / QUERY_BLOCK).cast("long")), "queries")
    blocks = asked.groupBy("dim", "block").agg(F.collect_list(F.struct("row", "q", "v")).alias("asked"))
    # every block of queries meets every shard of its dimension, by shard
    spread = blocks.join(graphs.groupBy("dim").agg(F.max("shards").alias("shards")), "dim").withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1))).drop("shards")
    met = spread.join(graphs.drop("shards"), ["dim", "shard"]).select("dim", "asked", "vectors", "graph", "ids", "at")

    def run(batches):
        for b in batches:
            for r in range(b.num_rows):
                dim, asked_ = b.column(0)[r].as_py(), b.column(1)[r]
                x = np.frombuffer(b.column(2)[r].as_buffer(), np.float64).reshape(-1, dim)
                g = np.frombuffer(b.column(3)[r].as_buffer(), np.int32).reshape(len(x), -1)
                ids, at = np.frombuffer(b.column(4)[r].as_buffer(), np.int64), np.frombuffer(b.column(5)[r].as_buffer(), np.int64)
                rows = asked_.values
                row, own, q = rows.field("row").to_numpy(), rows.field("q").to_numpy(), _matrix(rows.field("v"), dim)
                xl = lifted(x)
                starts = entries(len(x), xl)
                for lo in range(0, len(q), BATCH):
                    qs = q[lo : lo + BATCH]
                    ql = np.concatenate([qs, np.zeros((len(qs), 1))], axis=1).astype(np.float32)
                    found = beam_search(xl, g, ql, starts, beam_of(beam, len(x), shard))
                    out = [[], [], [], []]
                    for j, f in enumerate(found):
                        f = f[f >= 0]
                        s = (x[f] * qs[j]).sum(1)
                        n = at[f + 1] - at[f]
                        vec = np.concatenate([ids[at[i] : at[i + 1]] for i in f]) if len(f) else np.zeros(0, np.int64)
                        s = np.repeat(s, n)
                        best = np.lexsort((vec, -s))[: k + 1]
                        vec, s = vec[best], s[best]
                        mine = np.flatnonzero(vec == own[lo + j])[:1]
                        vec, s = np.delete(vec, mine)[:k], np.delete(s, mine)[:k]
                        for o, v in zip(out, (np.full(len(vec), row[lo + j]), np.full(len(vec), own[lo + j]), vec, s), strict=True):
                            o.append(v)
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(o)) for o in out], names=["row", "query_id", "vec_id", "score"])

    got = met.mapInArrow(run, "row long, query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("row").orderBy(F.col("score").desc(), "vec_id"))
    return got.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
