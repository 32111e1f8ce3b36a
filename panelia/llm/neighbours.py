"""Approximate nearest neighbours: a robust-pruned directed graph for each shard, searched by beams.

Vectors are dealt into shards of about ``shard_rows`` by a hash of their id, so that no source or group of
copies fills one.  In a shard, equal vectors are one point.  The graph is built in batches: greedy searches
from the medoid propose neighbours of each point of a batch, robust pruning keeps a proposal unless a kept
neighbour is nearer to it by the factor ``alpha``, and the edges are added in both directions, again pruned
where a point has more than ``degree``.  Queries are searched in every shard with a beam; distances of the
result are computed in double precision on the original vectors.

The graphs are built once and kept in the shared folder.  The queries (a stated set, a hundredth of the rows) go
to the tasks that read them in blocks of about ``query_block``, one after the other, so that neither a graph
nor a query travels with each pair of both; a task's results are cut to k per query before they are merged.

Defined cases: vectors that are null, zero, or hold null or non-finite components take no part; vectors of
different lengths are never compared; ties go to the smaller vec_id; repeated ids are candidates of their own,
but never of a query with the same id; fewer than k candidates are all returned.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import stored
from .words import bound_batches, tidy


@dataclass(frozen=True)
class Settings:
    k: int = 10
    degree: int = 32
    beam: int = 64
    search_beam: int = 160
    alpha: float = 1.2
    batch: int = 512
    shard_rows: int = 8192
    query_block: int = 16384
    seed: int = 11


def beam_search(points: np.ndarray, norms: np.ndarray, graph: np.ndarray, start: int, queries: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
    """For each query the ``beam`` points that a greedy search keeps, with their squared distances, nearest first.

    ``graph`` holds the neighbours by row, -1 where there is none.  All queries advance together: each expands
    the nearest point of its beam that it has not expanded yet.
    """
    n, m = len(queries), len(points)
    q2 = (queries**2).sum(1)
    ids = np.full((n, beam), -1, np.int64)
    dist = np.full((n, beam), np.inf, np.float32)
    done = np.ones((n, beam), bool)
    seen = np.zeros((n, m), bool)
    ids[:, 0], done[:, 0] = start, False
    dist[:, 0] = norms[start] + q2 - 2 * (queries @ points[start])
    seen[:, start] = True
    rows = np.arange(n)
    while len(rows):
        waiting = np.where(done[rows], np.inf, dist[rows])
        at = waiting.argmin(1)
        open_ = np.isfinite(waiting[np.arange(len(rows)), at])
        rows, at = rows[open_], at[open_]
        if not len(rows):
            break
        done[rows, at] = True
        near = graph[ids[rows, at]]
        fresh = (near >= 0) & ~seen[rows[:, None], near]
        seen[rows[:, None], np.where(near >= 0, near, start)] = True
        d = norms[near] + q2[rows, None] - 2 * np.einsum("ij,ikj->ik", queries[rows], points[near])
        d = np.where(fresh, d, np.inf).astype(np.float32)
        all_d = np.concatenate([dist[rows], d], 1)
        best = np.argpartition(all_d, beam - 1, axis=1)[:, :beam]
        dist[rows] = np.take_along_axis(all_d, best, 1)
        ids[rows] = np.take_along_axis(np.concatenate([ids[rows], near], 1), best, 1)
        done[rows] = np.take_along_axis(np.concatenate([done[rows], ~fresh], 1), best, 1)
    order = np.argsort(dist, axis=1, kind="stable")
    dist = np.take_along_axis(dist, order, 1)
    return np.where(np.isfinite(dist), np.take_along_axis(ids, order, 1), -1), dist


def robust_prune(points: np.ndarray, norms: np.ndarray, base: np.ndarray, ids: np.ndarray, dist: np.ndarray, degree: int, alpha: float) -> np.ndarray:
    """Neighbours for each point of ``base`` out of its proposals (-1: none): nearest first, dropping those that a kept one covers."""
    n = len(base)
    out = np.full((n, degree), -1, np.int64)
    order = np.argsort(np.where(ids < 0, np.inf, dist), axis=1, kind="stable")
    ids, dist = np.take_along_axis(ids, order, 1), np.take_along_axis(dist, order, 1)
    alive = (ids >= 0) & (ids != base[:, None])
    vectors, lengths = points[ids], norms[ids]
    for slot in range(degree):
        any_ = alive.any(1)
        if not any_.any():
            break
        pick = alive.argmax(1)
        row = np.arange(n)
        chosen = ids[row, pick]
        out[any_, slot] = chosen[any_]
        between = lengths + norms[chosen][:, None] - 2 * np.einsum("ij,ikj->ik", points[chosen], vectors)
        covered = alpha * alpha * between <= dist
        alive &= ~(covered & any_[:, None])
        alive[row, pick] &= ~any_
    return out


def build(points: np.ndarray, s: Settings) -> tuple[np.ndarray, int, np.ndarray]:
    """The graph, its entry point (the medoid), and the squared norms."""
    n = len(points)
    norms = (points**2).sum(1)
    start = int(((points - points.mean(0)) ** 2).sum(1).argmin())
    graph = np.full((n, s.degree), -1, np.int64)
    order = np.random.default_rng(s.seed).permutation(n)
    order = np.concatenate([[start], order[order != start]])
    done, size = 1, 16
    while done < n:
        new = order[done : done + min(size, s.batch)]
        ids, dist = beam_search(points, norms, graph, start, points[new], s.beam)
        # points of one batch don't see each other in the graph: they are proposals too
        inside = norms[new][:, None] + norms[new][None] - 2 * (points[new] @ points[new].T)
        m = min(s.degree, len(new))
        close = np.argpartition(inside, m - 1, axis=1)[:, :m]
        ids = np.concatenate([ids, new[close]], 1)
        dist = np.concatenate([dist, np.take_along_axis(inside, close, 1)], 1)
        graph[new] = robust_prune(points, norms, new, ids, dist, s.degree, s.alpha)
        # edges back
        source = np.repeat(new, s.degree)
        target = graph[new].ravel()
        source, target = source[target >= 0], target[target >= 0]
        by = np.argsort(target, kind="stable")
        source, target = source[by], target[by]
        heads, first, counts = np.unique(target, return_index=True, return_counts=True)
        width = int(counts.max(initial=0))
        extra = np.full((len(heads), width), -1, np.int64)
        extra[np.repeat(np.arange(len(heads)), counts), np.arange(len(target)) - np.repeat(first, counts)] = source
        both = np.concatenate([graph[heads], extra], 1)
        # a neighbour that is there twice is proposed once
        ordered = np.sort(both, axis=1)
        ordered[:, 1:][ordered[:, 1:] == ordered[:, :-1]] = -1
        d = norms[ordered] + norms[heads][:, None] - 2 * np.einsum("ij,ikj->ik", points[heads], points[ordered])
        fits = (ordered >= 0).sum(1) <= s.degree
        packed = np.take_along_axis(ordered, np.argsort(ordered < 0, axis=1, kind="stable"), 1)[:, : s.degree]
        packed = np.pad(packed, ((0, 0), (0, s.degree - packed.shape[1])), constant_values=-1)
        pruned = robust_prune(points, norms, heads[~fits], ordered[~fits], d[~fits], s.degree, s.alpha)
        packed[~fits] = pruned
        graph[heads] = packed
        done += len(new)
        size *= 2
    return graph, start, norms


@dataclass(frozen=True)
class Index:
    """Distinct points of a shard, their members' ids by point, the graph and its entry."""

    points: np.ndarray
    members: np.ndarray
    start_of: np.ndarray
    graph: np.ndarray
    entry: int


def index_shard(ids: np.ndarray, vectors: np.ndarray, s: Settings) -> Index:
    points, klass = np.unique(vectors, axis=0, return_inverse=True)
    klass = klass.ravel()
    order = np.lexsort((ids, klass))
    graph, entry, _ = build(points.astype(np.float32), s)
    return Index(points, ids[order], np.searchsorted(klass[order], np.arange(len(points) + 1)), graph.astype(np.int32), entry)


def search_shard(index: Index, query_ids: np.ndarray, queries: np.ndarray, s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query id, vec id, distance): the k nearest of the shard that the beams find, exactly measured."""
    points, members, start_of, graph, entry = index.points, index.members, index.start_of, index.graph, index.entry
    small = points.astype(np.float32)
    norms = (small**2).sum(1)
    out: list[tuple[np.ndarray, ...]] = []
    # 64 MB at most of marks of seen points, and of differences to the points found
    block = max(1, min(len(queries), (64 << 20) // max(1, len(points), 8 * s.search_beam * points.shape[1])))
    for a in range(0, len(queries), block):
        q, qi = queries[a : a + block], query_ids[a : a + block]
        found, _ = beam_search(small, norms, graph, entry, q.astype(np.float32), min(s.search_beam, max(len(points), 1)))
        exact = np.sqrt(((points[np.maximum(found, 0)] - q[:, None]) ** 2).sum(2))
        exact = np.where(found >= 0, exact, np.inf)
        # every point stands for its members; k + 1 of the smallest ids suffice
        per = np.minimum(start_of[1:] - start_of[:-1], s.k + 1)
        best = np.argsort(exact, axis=1, kind="stable")
        near, dist = np.take_along_axis(found, best, 1), np.take_along_axis(exact, best, 1)
        row = np.repeat(np.arange(len(q)), near.shape[1])
        near, dist = near.ravel(), dist.ravel()
        real = near >= 0
        row, near, dist = row[real], near[real], dist[real]
        many = per[near]
        inner = np.arange(int(many.sum())) - np.repeat(np.cumsum(many) - many, many)
        vec = members[np.repeat(start_of[near], many) + inner]
        row, dist = np.repeat(row, many), np.repeat(dist, many)
        keep = vec != qi[row]
        row, vec, dist = row[keep], vec[keep], dist[keep]
        by = np.lexsort((vec, dist, row))
        row, vec, dist = row[by], vec[by], dist[by]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        top = rank < s.k
        out.append((qi[row[top]], vec[top], dist[top]))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (query_ids, query_ids, np.empty(0))


def usable(frame: DataFrame) -> DataFrame:
    """(vec_id, v, dim) of the vectors that take part, in double precision."""
    v = F.col("embedding").cast("array<double>")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return frame.select("vec_id", v.alias("v")).where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & finite & F.exists("v", lambda x: x != 0)).withColumn("dim", F.size("v"))


def nearest(frame: DataFrame, s: Settings = Settings(), is_query: str = "vec_id % 100 = 0") -> DataFrame:
    """query_id, rank, vec_id, score: for each query the k nearest found."""
    bound_batches(frame.sparkSession)
    rows = usable(frame).withColumn("vec_id", F.col("vec_id").cast("long"))
    # the number of shards and blocks by dimension: one row a dimension
    sizes = {r["dim"]: (r["n"], r["q"]) for r in rows.groupBy("dim").agg(F.count("*").alias("n"), F.count_if(F.expr(is_query)).alias("q")).collect()}
    shards = {d: -(-n // s.shard_rows) for d, (n, _) in sizes.items()}
    blocks = {d: max(1, -(-q // s.query_block)) for d, (_, q) in sizes.items()}
    pick = lambda table: F.coalesce(F.element_at(F.create_map(*(F.lit(x) for p in table.items() for x in p)), F.col("dim")), F.lit(1)) if table else F.lit(1)
    shard = F.pmod(F.xxhash64("vec_id"), pick(shards)).cast("int")
    block = F.pmod(F.xxhash64("vec_id", F.lit(1)), pick(blocks)).cast("int")

    def arrays(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        ids = np.asarray(table["vec_id"])
        return ids, np.asarray(table["v"].combine_chunks().flatten()).reshape(len(ids), -1)

    def build_index(key: tuple, table: pa.Table) -> pa.Table:
        i = index_shard(*arrays(table), s)
        small = i.points.astype(np.float32)
        # half the bytes where that is exact
        points = small if (small == i.points).all() else i.points
        packed = {"points": points, "members": i.members, "start_of": i.start_of, "graph": i.graph}
        columns = {"dim": (key[0].as_py(), pa.int32()), "shard": (key[1].as_py(), pa.int32()), **{n: (np.ascontiguousarray(x).tobytes(), pa.binary()) for n, x in packed.items()}, "entry": (i.entry, pa.int32()), "width": (points.itemsize, pa.int32())}
        return pa.table({k: pa.array([v], t) for k, (v, t) in columns.items()})

    dealt = rows.withColumn("shard", shard).groupBy("dim", "shard")
    indexes = stored(dealt.applyInArrow(build_index, "dim int, shard int, points binary, members binary, start_of binary, graph binary, entry int, width int"), "ann-shards")
    asked = stored(rows.where(is_query).dropDuplicates(["vec_id", "v"]).withColumn("block", block), "ann-queries")

    def found(dim: int, number: int) -> DataFrame:
        """The k nearest of a block's queries in the shards of each task; the block goes to the shards, which stay where they are."""
        shared = frame.sparkSession.sparkContext.broadcast(arrays(asked.where((F.col("dim") == dim) & (F.col("block") == number)).select("vec_id", "v").toArrow()))

        @tidy
        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            qids, queries = shared.value
            kept = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
            for batch in batches:
                for at in range(batch.num_rows):
                    r = {n: c[at] for n, c in zip(batch.schema.names, batch.columns, strict=True)}
                    whole = lambda name, kind=np.int64: np.frombuffer(r[name].as_buffer(), kind)  # noqa: B023, E731
                    points = whole("points", f"f{r['width'].as_py()}").reshape(-1, dim).astype(float)
                    i = Index(points, whole("members"), whole("start_of"), whole("graph", np.int32).reshape(len(points), -1), r["entry"].as_py())
                    q, vec, dist = (np.concatenate(x) for x in zip(kept, search_shard(i, qids, queries, s), strict=True))
                    by = np.lexsort((vec, dist, q))
                    q, vec, dist = q[by], vec[by], dist[by]
                    top = np.arange(len(q)) - np.searchsorted(q, q) < s.k
                    kept = q[top], vec[top], dist[top]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in kept], names=["query_id", "vec_id", "score"])

        part = stored(indexes.where(F.col("dim") == dim).mapInArrow(search, "query_id long, vec_id long, score double"), "ann-found")
        shared.unpersist()
        return part

    part = [found(d, b) for d, (_, q) in sizes.items() if q for b in range(blocks[d])]
    part = reduce(DataFrame.unionByName, part) if part else frame.sparkSession.createDataFrame([], "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return part.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= s.k).select("query_id", "rank", "vec_id", "score")
