"""Substring dedup by compaction of a word de Bruijn graph.

A window of K words is an edge of the graph from the run of its first K - 1 words to that of its last K - 1.  Every
window whose words also start earlier (smaller document, or same document and earlier place) is a repeat; the words
that repeats cover are removed.

1. Candidates.  Of the M-word sub-windows of a window the one with the least hash (leftmost) is its anchor: equal
   windows have equal anchors.  Anchors are counted over all documents with map-side sums; those that occur
   twice or more go into a bitmap of fixed size, so that windows without a repeated anchor drop out.
2. Edges.  A task sorts the candidate windows of a slice: all but the first of equal ones are repeats already,
   and only the first goes on.  Neighbouring windows with one anchor travel as one row of node hashes, so that a
   passage that a third of all documents share sends a few rows per slice.  Rows meet by their anchors; windows are
   equal if both of their nodes are.  Of equal windows all but the one with the least source coordinates are
   repeats.
3. Compaction.  Repeated edges that follow each other at their sources are segments.  The degrees of all nodes of
   distinct repeated edges are summed; segments are cut at nodes that branch.  Where one piece ends in a node and
   one begins there, they are joined if the source coordinates agree; chains of joined pieces compact into paths
   by pointer jumping, a join a round and as many rounds as the logarithm of the longest chain.
4. Spans.  The places where a document holds a piece, shifted by the piece's place in its path, are verified
   to follow each other, and so become one span for each repeated passage.  Spans are joined with the texts of the
   documents that have any (again by a bitmap of fixed size).

Defined cases: a null text has no words; rows that repeat a doc_id share coordinates: equal coordinates don't
remove each other, later places of the id do; a null doc_id comes before all others; other columns are ignored.
A text of fewer than K words keeps all; a very long one is a slice by itself.  No windows, group or number of copies
is capped.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bits import bitmap, maybe
from .shared import stored
from .words import BASE, bound_batches, combine, hash_words, mix, ngram_hashes, signed, slices, split_words, tidy

K, M = 20, 10
ANCHOR_BITS, DOC_BITS = 27, 25
FLUSH = 1_500_000
NO_ID = np.iinfo(np.int64).min


def anchors(hashes: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The starts of the windows, the hash of each window's anchor, and the anchor's place."""
    none = np.empty(0, np.int64)
    if len(hashes) < K:
        return none, np.empty(0, np.uint64), none
    start = np.flatnonzero(owner[: len(owner) - K + 1] == owner[K - 1 :])
    at, value = ngram_hashes(hashes, owner, M)
    grams = np.full(len(hashes), np.iinfo(np.uint64).max, np.uint64)
    grams[at] = value
    # least of K - M + 1 neighbours, by two overlapping powers of two
    width = K - M + 1
    low, size = grams, 1
    while size * 2 <= width:
        low = np.minimum(low[: len(low) - size], low[size:])
        size *= 2
    least = np.minimum(low[start], low[start + width - size])
    place = np.full(len(start), -1, np.int64)
    for step in range(width - 1, -1, -1):
        place = np.where(grams[start + step] == least, start + step, place)
    return start, least, place


@tidy
def count_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parts, size = [], 0

    def emit(part):
        for i in range(0, len(part[0]), 500_000):
            yield pa.RecordBatch.from_arrays([pa.array(signed(part[0][i : i + 500_000])), pa.array(part[1][i : i + 500_000])], names=["h", "n"])

    for batch in batches:
        for part in slices(batch):
            owner, words = split_words(part.column("text"))
            _, least, place = anchors(hash_words(words), owner)
            chosen = least[np.unique(place, return_index=True)[1]]
            parts.append(combine([(chosen, np.ones(len(chosen), np.int64))]))
            size += len(parts[-1][0])
            if size > FLUSH:
                yield from emit(combine(parts))
                parts, size = [], 0
    if parts:
        yield from emit(combine(parts))


def spans_of(group: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows (sorted by group and start) that touch or overlap, as (group, first word, end word)."""
    if not len(start):
        return group, start, start
    new = np.concatenate([[True], (group[1:] != group[:-1]) | (start[1:] > start[:-1] + K)])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(start)) - 1
    return group[first], start[first], start[last] + K


EDGES = "h long, doc long, key long, a int, b int, path array<long>, again array<int>"


def edge_hash(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(u * BASE + v)


def equal_edges(u: np.ndarray, v: np.ndarray, doc: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of edges in the order of their coordinates: the first equal edge of each, and whether it is a repeat (equal coordinates are none)."""
    w = edge_hash(u, v)
    order = np.argsort(w, kind="stable")
    same = np.concatenate([[False], (u[order][1:] == u[order][:-1]) & (v[order][1:] == v[order][:-1])]) if len(order) else np.zeros(0, bool)
    first = np.empty(len(u), np.int64)
    first[order] = order[np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))] if len(order) else order
    return first, (first != np.arange(len(u))) & ~((doc == doc[first]) & (place == place[first]))


def edges_of(part: pa.RecordBatch, bits: np.ndarray) -> pa.RecordBatch:
    """Rows of candidate windows that come first in this slice, one anchor each, and spans [a, b) that repeat inside it.

    A row holds the nodes at the words a, a + 1, ... (one more than it has windows), and which of its windows the
    slice repeats; a span has no nodes, and a key that spreads spans.
    """
    part = part.take(pc.sort_indices(part.column("doc_id"), null_placement="at_start"))
    owner, words = split_words(part.column("text"))
    hashes = hash_words(words)
    start, least, anchor = anchors(hashes, owner)
    candidate = maybe(bits, least)
    start, least, anchor = start[candidate], least[candidate], anchor[candidate]
    node = np.zeros(len(hashes), np.uint64)
    at, value = ngram_hashes(hashes, owner, K - 1)
    node[at] = value
    begin = np.searchsorted(owner, np.arange(part.num_rows))
    row = owner[start]
    place = start - begin[row]
    ids = np.asarray(pc.fill_null(part.column("doc_id").cast(pa.int64()), int(NO_ID)))
    keys = np.asarray(part.column("key"))
    # rows of one id share coordinates
    head, later = equal_edges(node[start], node[start + 1], ids[row], place)
    first = np.flatnonzero(~later)
    new = np.flatnonzero(np.concatenate([[True], (np.diff(start[first]) != 1) | (np.diff(anchor[first]) != 0) | (np.diff(row[first]) != 0)])) if len(first) else first
    size = np.diff(np.append(new, len(first)))
    offsets = np.concatenate([[0], np.cumsum(size + 1)])
    nodes = np.empty(len(first) + len(new), np.uint64)
    nodes[np.arange(len(first)) + np.repeat(np.arange(len(new)), size)] = node[start[first]]
    nodes[offsets[1:] - 1] = node[start[first[new + size - 1]] + 1]
    path = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(signed(nodes)))
    mark = np.zeros(len(start), bool)
    mark[head[later]] = True
    mark, run = mark[first], np.repeat(np.arange(len(new)), size)
    again = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.bincount(run[mark], minlength=len(new)))]), pa.int32()), pa.array((np.arange(len(first)) - new[run])[mark].astype(np.int32)))
    top = first[new]
    g, a, b = spans_of(row[later], place[later])
    spread = signed(mix(ids[g].view(np.uint64) ^ a.astype(np.uint64)))
    n, m = len(top), len(g)
    columns = [
        pa.array(np.concatenate([signed(least[top]), spread])),
        pa.array(np.concatenate([ids[row[top]], ids[g]])),
        pa.array(np.concatenate([keys[row[top]], keys[g]])),
        pa.array(np.concatenate([place[top], a]).astype(np.int32)),
        pa.array(np.concatenate([np.zeros(n, np.int64), b]).astype(np.int32)),
        pa.concat_arrays([path, pa.nulls(m, path.type)]),
        pa.concat_arrays([again, pa.nulls(m, again.type)]),
    ]
    return pa.RecordBatch.from_arrays(columns, names=["h", "doc", "key", "a", "b", "path", "again"])


#: A segment (its n + 1 nodes, its source doc, key and a), a place that holds edges off, off + 1, ... of a segment
#: (the words [a, b) of doc), or a span [a, b) that needs no segment.
FOUND = "seg long, nodes array<long>, doc long, key long, a int, b int, off int"


def runs(*broken: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of the runs that the given breaks between neighbours leave."""
    breaks = np.logical_or.reduce(broken)
    new = np.flatnonzero(np.concatenate([[True], breaks]))
    return new, np.append(new[1:], len(breaks) + 1) - 1


def repeats_of(table: pa.Table) -> pa.RecordBatch:
    """FOUND of whole groups of one anchor; rows are sorted by h, doc, a."""
    is_path = np.asarray(pc.is_valid(table["path"]))
    ready, paths = table.filter(pa.array(~is_path)), table.filter(pa.array(is_path)).combine_chunks()
    sizes = np.asarray(pc.list_value_length(paths["path"])).astype(np.int64)
    nodes = np.asarray(pc.list_flatten(paths["path"])).view(np.uint64)
    ends = np.cumsum(sizes)
    u, v = np.delete(nodes, ends - 1), np.delete(nodes, ends - sizes)
    row = np.repeat(np.arange(len(sizes)), sizes - 1)
    inner = np.arange(len(u)) - np.repeat(ends - sizes - np.arange(len(sizes)), sizes - 1)
    doc, key, a = (np.asarray(paths[c]) for c in ("doc", "key", "a"))
    place = a[row] + inner
    first, later = equal_edges(u, v, doc[row], place)
    again = np.flatnonzero(later)
    lists = paths["again"]
    window = ends - sizes - np.arange(len(sizes))
    marked = np.repeat(window, np.asarray(pc.list_value_length(lists))) + np.asarray(pc.list_flatten(lists))
    source = np.unique(first[np.concatenate([again, marked])])
    names, none = ["seg", "nodes", "doc", "key", "a", "b", "off"], pa.nulls
    parts = [pa.RecordBatch.from_arrays([none(ready.num_rows, pa.int64()), none(ready.num_rows, pa.list_(pa.int64())), *(ready[c].combine_chunks() for c in ("doc", "key", "a", "b")), none(ready.num_rows, pa.int32())], names=names)]
    if len(source):
        one, end = runs(np.diff(source) != 1, np.diff(row[source]) != 0)
        size = end - one + 1
        number = np.repeat(np.arange(len(one)), size)
        segment, offset = np.zeros(len(u), np.int64), np.zeros(len(u), np.int64)
        segment[source], offset[source] = number, np.arange(len(source)) - one[number]
        name = signed(edge_hash(u, v))[source[one]]
        bounds = np.concatenate([[0], np.cumsum(size + 1)])
        line = np.empty(len(source) + len(one), np.uint64)
        line[np.arange(len(source)) + number] = u[source]
        line[bounds[1:] - 1] = v[source[end]]
        s = source[one]
        i32 = lambda x: pa.array(x, pa.int32())
        parts.append(pa.RecordBatch.from_arrays([pa.array(name), pa.ListArray.from_arrays(i32(bounds), pa.array(signed(line))), pa.array(doc[row[s]]), pa.array(key[row[s]]), i32(place[s]), none(len(s), pa.int32()), none(len(s), pa.int32())], names=names))
        if len(again):
            where, off = segment[first[again]], offset[first[again]]
            one, end = runs(np.diff(again) != 1, np.diff(row[again]) != 0, np.diff(where) != 0, np.diff(off) != 1)
            s = again[one]
            parts.append(pa.RecordBatch.from_arrays([pa.array(name[where[one]]), none(len(s), pa.list_(pa.int64())), pa.array(doc[row[s]]), pa.array(key[row[s]]), i32(place[s]), i32(place[again[end]] + K), i32(off[one])], names=names))
    return pa.concat_batches([p.cast(parts[0].schema) for p in parts])


@tidy
def by_group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``repeats_of`` over sorted batches; the last group of a batch waits for the next batch."""
    waiting: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        h = np.asarray(batch.column("h"))
        cut = int(np.searchsorted(h, h[-1]))
        if cut:
            yield repeats_of(pa.Table.from_batches([*waiting, batch.slice(0, cut)]))
            waiting = []
        waiting.append(batch.slice(cut))
    if waiting:
        yield repeats_of(pa.Table.from_batches(waiting))


def keyed(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("key"), "text")


def repeats(docs: DataFrame) -> DataFrame:
    """FOUND of all documents."""
    spark = docs.sparkSession
    counts = docs.select("text").mapInArrow(count_anchors, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    shared = spark.sparkContext.broadcast(bitmap(counts.where("n > 1"), "h", ANCHOR_BITS))

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                yield edges_of(part, shared.value)

    # what has one anchor meets in one place; a hot anchor has a row or two for each slice
    met = docs.mapInArrow(run, EDGES).repartition("h").sortWithinPartitions("h", "doc", "a")
    return stored(met.mapInArrow(by_group, FOUND), "repeated-edges")


def pieces_of(found: DataFrame) -> DataFrame:
    """(piece, seg, low, high, u, v, doc, key, a): segments cut at the nodes that branch; a piece holds the edges [low, high) of its segment."""
    segments = found.where("nodes is not null").select("seg", "nodes", "doc", "key", "a", (F.size("nodes") - 1).alias("n"))
    nodes = segments.select("seg", "n", F.posexplode("nodes").alias("i", "node"))
    degrees = nodes.groupBy("node").agg(F.count_if(F.col("i") < F.col("n")).alias("n_out"), F.count_if(F.col("i") > 0).alias("n_in"))
    branching = degrees.where("n_out > 1 or n_in > 1").select("node")
    cuts = nodes.where("i > 0 and i < n").join(branching, "node").groupBy("seg").agg(F.array_sort(F.collect_list("i")).alias("cuts"))
    bounds = segments.join(cuts, "seg", "left").withColumn("bounds", F.concat(F.array(F.lit(0)), F.coalesce("cuts", F.array().cast("array<int>")), F.array("n")))
    cut = bounds.select("*", F.posexplode(F.slice("bounds", 1, F.size("bounds") - 1)).alias("k", "low")).withColumn("high", F.get("bounds", F.col("k") + 1))
    piece = F.when(F.col("k") == 0, F.col("seg")).otherwise(F.xxhash64("seg", "k"))
    return cut.select(piece.alias("piece"), "seg", "low", "high", F.get("nodes", "low").alias("u"), F.get("nodes", "high").alias("v"), "doc", "key", (F.col("a") + F.col("low")).alias("a"))


def linked(pieces: DataFrame) -> DataFrame:
    """(piece, path, before): each piece's predecessor and its edges; itself where a path begins.

    A node is passed through if one piece ends and one begins there, with neighbouring source coordinates.
    """
    n = F.col("high") - F.col("low")
    begins = pieces.groupBy("u").agg(F.count("*").alias("n_out"), F.min(F.struct("piece", "doc", "key", "a")).alias("y")).where("n_out = 1")
    ends = pieces.groupBy("v").agg(F.count("*").alias("n_in"), F.min(F.struct("piece", "doc", "key", "a", n.alias("n"))).alias("x")).where("n_in = 1")
    through = begins.join(ends, F.col("u") == F.col("v")).where("x.doc = y.doc and x.key = y.key and x.a + x.n = y.a")
    links = through.select(F.col("y.piece").alias("piece"), F.col("x.piece").alias("path"), F.col("x.n").alias("before"))
    return pieces.select("piece").join(links, "piece", "left").select("piece", F.coalesce("path", "piece").alias("path"), F.coalesce("before", F.lit(0)).alias("before"))


def compacted(pieces: DataFrame) -> DataFrame:
    """(piece, path, before): the first piece of each piece's path, and the edges before the piece in it."""
    chain = stored(linked(pieces), "paths", narrow=True)
    while True:
        ahead = chain.where("piece <> path").select(F.col("piece").alias("s"), F.col("path").alias("p"), F.col("before").alias("d"))
        joined = chain.join(ahead, F.col("path") == F.col("s"), "left")
        new = stored(joined.select("piece", F.coalesce("p", "path").alias("path"), (F.col("before") + F.coalesce("d", F.lit(0))).alias("before"), F.col("p").isNotNull().alias("moved")), "paths", narrow=True)
        chain = new.select("piece", "path", "before")
        if new.where("moved").isEmpty():
            return chain


def repeated_spans(found: DataFrame) -> DataFrame:
    """(doc, key, a, b): verified spans of words that repeat, one for each passage; those of one document possibly overlapping."""
    pieces = stored(pieces_of(found), "pieces")
    placed = pieces.select("piece", "seg", "low", "high").join(compacted(pieces), "piece")
    held = found.where("off is not null").join(placed, "seg").withColumn("stop", F.col("off") + F.col("b") - F.col("a") - K + 1)
    held = held.withColumn("from", F.greatest("off", "low")).withColumn("to", F.least("stop", "high")).where("from < to")
    at = F.col("a") + F.col("from") - F.col("off")
    held = held.select("doc", "key", "path", at.alias("a"), (at + F.col("to") - F.col("from") + K - 1).alias("b"), (at - F.col("from") + F.col("low") - F.col("before")).alias("shift"))
    order = Window.partitionBy("doc", "key", "path", "shift").orderBy("a")
    # the next place holds the path's next edges: its first window follows the last one
    follows = F.col("a") <= F.max("b").over(order.rowsBetween(Window.unboundedPreceding, -1)) - K + 1
    islands = held.withColumn("i", F.sum(F.when(follows, 0).otherwise(1)).over(order))
    whole = islands.groupBy("doc", "key", "path", "shift", "i").agg(F.min("a").alias("a"), F.max("b").alias("b"))
    return whole.select("doc", "key", "a", "b").unionByName(found.where("seg is null").select("doc", "key", "a", "b"))


def repeated_paths(docs: DataFrame) -> DataFrame:
    """(path, doc_id, a, n_words): each compacted path of repeated windows, where it is first."""
    pieces = stored(pieces_of(repeats(keyed(docs))), "pieces")
    n = F.sum(F.col("high") - F.col("low")).alias("n")
    whole = compacted(pieces).join(pieces, "piece").groupBy("path").agg(n, F.min_by(F.struct("doc", "a"), "before").alias("at"))
    return whole.select("path", F.when(F.col("at.doc") != int(NO_ID), F.col("at.doc")).alias("doc_id"), F.col("at.a").alias("a"), (F.col("n") + K - 1).alias("n_words"))


def keep_words(text: str | None, spans: list | None) -> tuple[int, int, list[bytes]]:
    """Words, removed words, and the words that stay."""
    words = (text or "").encode().split()  # bytes split at ASCII white space
    if not spans:
        return len(words), 0, words
    gone = np.zeros(len(words) + 1, np.int32)
    for s in spans:
        gone[s["a"]] += 1
        gone[s["b"]] -= 1
    keep = np.cumsum(gone[:-1]) == 0
    return len(words), int((~keep).sum()), [w for w, k in zip(words, keep.tolist(), strict=True) if k]


def dedup(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 (and kept_text) of every document."""
    spark = docs.sparkSession
    bound_batches(spark)
    docs = keyed(docs)
    spans = stored(repeated_spans(repeats(docs)).groupBy("doc", "key").agg(F.collect_list(F.struct("a", "b")).alias("spans")), "spans")
    touched = spark.sparkContext.broadcast(bitmap(spans.select(F.xxhash64("doc", "key").alias("h")), "h", DOC_BITS))
    result = "n_words long, n_removed long, kept_sha256 string" + (", kept_text string" if with_text else "")
    names = ["n_words", "n_removed", "kept_sha256"] + ["kept_text"] * with_text

    def finish(texts: list, spans: list) -> list[pa.Array]:
        found = [keep_words(t, s) for t, s in zip(texts, spans, strict=True)]
        kept = [b" ".join(w) for _, _, w in found]
        out = [pa.array([n for n, _, _ in found], pa.int64()), pa.array([g for _, g, _ in found], pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string())]
        return out + [pa.array([x.decode() for x in kept], pa.string())] * with_text

    @tidy
    def untouched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                mask = maybe(touched.value, np.asarray(part.column("h")).view(np.uint64))
                clean = finish(pc.if_else(pa.array(mask), None, part.column("text")).to_pylist(), [None] * part.num_rows)
                open_text = pc.if_else(pa.array(mask), pc.fill_null(part.column("text"), ""), None)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("id"), part.column("key"), open_text, *clean], names=["doc_id", "id", "key", "text", *names])

    @tidy
    def rest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                done = finish(part.column("text").to_pylist(), part.column("spans").to_pylist())
                is_open = pc.is_valid(part.column("text"))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pc.if_else(is_open, d, part.column(n)) for d, n in zip(done, names, strict=True))], names=["doc_id", *names])

    ids = docs.withColumn("id", F.coalesce("doc_id", F.lit(int(NO_ID)))).withColumn("h", F.xxhash64("id", "key"))
    first = ids.mapInArrow(untouched, f"doc_id long, id long, key long, text string, {result}")
    joined = first.join(spans.withColumnRenamed("doc", "id"), ["id", "key"], "left")
    return joined.mapInArrow(rest, f"doc_id long, {result}")
