"""Language-model scoring with a weighted backoff automaton.

Words and one end mark per text are tokens.  The model is a bigram model with a Dirichlet prior (MacKay and Peto):
the smoothed unigrams, ``prior`` tokens strong, are the prior of every word's followers,

    P(w | v) = (c(v w) + prior * P(w)) / (c(v) + prior),    P(w) = (c(w) + add) / (N + add * (V + 1)).

As an automaton, every training word is a state: an arc (v, w), one for each bigram of the training documents
however rare, carries log P(w | v); where a state has no arc for a token, its failure arc of weight
log(prior / (c(v) + prior)) leads to the root, whose arcs are the unigrams.  One traversal of a text from left to
right carries the state (the last word) and accumulates the weights.

The model is nowhere gathered.  Documents are cut into slices; a slice's distinct words and bigrams are keys that
go to buckets by their leading bits, one sorted and compressed row for a slice and bucket.  A bucket sums the
training counts of its keys and sends each slice the sums in the order of that slice's keys.  So a slice meets
just the part of the automaton that its texts pass through, a word or bigram that all documents share costs one
key for each slice, and all work is in proportion to the text.  Buckets grow in number with the corpus.  Keys are
64-bit hashes.

Defined cases: a null or empty text has the end mark only; without training documents every token has
probability 1 in both models' formulas (N = V = 0); repeated rows are scored (and counted) one by one; a very
long text is a slice by itself; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .shared import stored
from .words import BASE, as_string, bound_batches, encode, hash_strings, mix, planes, slices, split_words, tidy, unplanes

END = hash_strings(pa.array(["end of text"]), seed=1)[0]


@dataclass(frozen=True)
class Settings:
    add: float = 0.1
    prior: float = 32.0
    folds: int = 10
    #: Bytes of text in a slice, and tokens for which there is a bucket.
    slice_bytes: int = 16 << 20
    bucket_tokens: int = 2_000_000
    least_buckets: int = 64


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Owner and code of every token, the end marks included, in order; the hashes of the codes, ascending."""
    owner, words = split_words(pc.ascii_lower(as_string(texts)))
    codes, dictionary = encode(words)
    hashes = np.append(hash_strings(dictionary), END)
    order = np.argsort(hashes, kind="stable")
    rank = np.empty(len(order), np.int32)
    rank[order] = np.arange(len(order))
    n = len(texts)
    ends = np.cumsum(np.bincount(owner, minlength=n))
    return np.insert(owner, ends, np.arange(n, dtype=owner.dtype)), np.insert(rank[codes], ends, rank[-1]), hashes[order]


def pair_keys(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(first * BASE + second)


def distinct(values: np.ndarray, below: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values (under ``below``), ascending, and the place of every value among them."""
    n = len(values)
    if not n:
        return values, np.empty(0, np.int64)
    bits = n.bit_length()
    if below.bit_length() + bits <= 63:  # a sort of packed numbers takes a fraction of the time
        packed = np.sort((values << bits) | np.arange(n))
        ordered, at = packed >> bits, packed & ((1 << bits) - 1)
    else:
        at = np.argsort(values, kind="stable")
        ordered = values[at]
    new = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    back = np.empty(n, np.int64)
    back[at] = np.cumsum(new) - 1
    return ordered[new], back


def by_hash(keys: np.ndarray) -> np.ndarray:
    """An order of the keys by their leading bits, the same whenever the keys are."""
    bits = np.uint64(max(1, len(keys)).bit_length())
    return (np.sort((keys >> bits << bits) | np.arange(len(keys), dtype=np.uint64)) & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)


def bigrams(owner: np.ndarray, codes: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Where bigrams end, the distinct ones as v * words + w, each one's place among them, and their keys."""
    at = np.flatnonzero(owner[1:] == owner[:-1]) + 1
    size = len(hashes)
    pairs, place = distinct(codes[at - 1].astype(np.int64) * size + codes[at], size * size)
    return at, pairs, place, pair_keys(hashes[pairs // size], hashes[pairs % size])


def held_out(folds: int) -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % folds == 0


#: A slice: its documents' ids, whether they train, their numbers of tokens, the tokens' codes and the codes' hashes.
BODY = "n long, trains binary, sizes binary, codes binary, hashes binary"


def sliced(docs: DataFrame, training: Column, s: Settings) -> DataFrame:
    """(slice, ids, BODY): the tokens of all documents."""
    bound_batches(docs.sparkSession, s.slice_bytes >> 20 or 1)
    kept = docs.select("doc_id", "text", F.coalesce(training, F.lit(False)).alias("trains"))
    kind = kept.schema["doc_id"].dataType.simpleString()

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, limit=s.slice_bytes):
                owner, codes, hashes = tokens(part.column("text"))
                sizes = np.bincount(owner, minlength=part.num_rows)
                trains = np.asarray(part.column("trains").cast(pa.uint8()))
                body = [planes(trains), planes(sizes.astype(np.uint32)), planes(codes.view(np.uint32)), planes(np.diff(hashes, prepend=np.uint64(0)))]
                # named by what it holds, and so the same when a lost task runs again
                name = xxhash.xxh3_64_intdigest(b"".join(body) + repr(part.column("doc_id").to_pylist()).encode())
                ids = part.column("doc_id")
                row = [pa.array([np.uint64(name).view(np.int64)]), pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids), pa.array([len(owner)]), *(pa.array([x], pa.binary()) for x in body)]
                yield pa.RecordBatch.from_arrays(row, names=["slice", "ids", "n", "trains", "sizes", "codes", "hashes"])

    return stored(kept.mapInArrow(run, f"slice long, ids array<{kind}>, {BODY}"), "lm-slices")


def opened(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Owner and code of every token, the hashes, and which documents train."""
    sizes = unplanes(row["sizes"], np.uint32)
    with np.errstate(over="ignore"):
        hashes = np.cumsum(unplanes(row["hashes"], np.uint64), dtype=np.uint64)
    return np.repeat(np.arange(len(sizes)), sizes), unplanes(row["codes"], np.uint32).astype(np.int64), hashes, unplanes(row["trains"], np.uint8).astype(bool)


def rows_of(batch: pa.RecordBatch) -> Iterator[dict]:
    for i in range(batch.num_rows):
        yield {name: column[i].as_py() for name, column in zip(batch.schema.names, batch.columns, strict=True)}


def keys_by_bucket(keys: np.ndarray, n: np.ndarray, buckets: int) -> list[tuple[bytes, bytes]]:
    """Of ascending keys and their training counts, what goes to each bucket."""
    edges = np.searchsorted(keys, np.array([(b << 64) // buckets for b in range(1, buckets)], np.uint64))
    edges = [0, *edges.tolist(), len(keys)]
    return [(planes(np.diff(keys[a:b], prepend=np.uint64(0))), planes(n[a:b])) for a, b in zip(edges, edges[1:], strict=False)]


def sent_keys(table: DataFrame, buckets: int) -> DataFrame:
    """(bucket, slice, words, wn, pairs, pn): keys and training counts of each slice."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in rows_of(batch):
                owner, codes, hashes, trains = opened(row)
                used = trains[owner]
                at, pairs, place, keys = bigrams(owner, codes, hashes)
                order = by_hash(keys)
                words = keys_by_bucket(hashes, np.bincount(codes[used], minlength=len(hashes)).astype(np.uint32), buckets)
                arcs = keys_by_bucket(keys[order], np.bincount(place[used[at]], minlength=len(pairs)).astype(np.uint32)[order], buckets)
                columns = [pa.array(np.arange(buckets, dtype=np.int32)), pa.array(np.full(buckets, row["slice"])), *(pa.array([x[k] for x in part], pa.binary()) for part in (words, arcs) for k in (0, 1))]
                yield pa.RecordBatch.from_arrays(columns, names=["bucket", "slice", "words", "wn", "pairs", "pn"])

    return table.select("slice", "trains", "sizes", "codes", "hashes").mapInArrow(run, "bucket int, slice long, words binary, wn binary, pairs binary, pn binary")


def in_groups(batches: Iterator[pa.RecordBatch], by: str) -> Iterator[list[dict]]:
    """Rows that follow each other with one value of ``by``."""
    waiting: list[dict] = []
    for batch in batches:
        for row in rows_of(batch):
            if waiting and waiting[-1][by] != row[by]:
                yield waiting
                waiting = []
            waiting.append(row)
    if waiting:
        yield waiting


def summed(rows: list[dict], keys: str, n: str) -> tuple[list[bytes], int, int]:
    """For each row the corpus counts of its keys, in their order; the sum of all counts, and the keys that have any."""
    with np.errstate(over="ignore"):
        own = [np.cumsum(unplanes(r[keys], np.uint64), dtype=np.uint64) for r in rows]
    every, back = np.unique(np.concatenate(own), return_inverse=True, sorted=True) if own else (np.empty(0, np.uint64), np.empty(0, np.int64))
    total = np.bincount(back, np.concatenate([unplanes(r[n], np.uint32) for r in rows]), len(every)).astype(np.uint64)
    edges = np.cumsum([0, *map(len, own)])
    return [planes(total[back[a:b]]) for a, b in zip(edges, edges[1:], strict=False)], int(total.sum()), int((total > 0).sum())


def counted(sent: DataFrame) -> DataFrame:
    """(bucket, slice, wc, pc, n, v, arcs): corpus counts for each slice, and a row of the bucket's own sums without slice."""

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in in_groups(batches, "bucket"):
            words, n, v = summed(rows, "words", "wn")
            pairs, _, arcs = summed(rows, "pairs", "pn")
            k = len(rows)
            none = [None] * k
            columns = [([r["bucket"] for r in rows] + [rows[0]["bucket"]], pa.int32()), ([r["slice"] for r in rows] + [None], pa.int64()), (words + [None], pa.binary()), (pairs + [None], pa.binary()), (none + [n], pa.int64()), (none + [v], pa.int64()), (none + [arcs], pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in columns], names=["bucket", "slice", "wc", "pc", "n", "v", "arcs"])

    return sent.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "bucket int, slice long, wc binary, pc binary, n long, v long, arcs long")


def traverse(owner: np.ndarray, codes: np.ndarray, hashes: np.ndarray, c: np.ndarray, pair_count: np.ndarray, total: float, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """The unigram weight and the automaton's weight of every token; ``pair_count`` in the order of the bigrams' hashes."""
    at, pairs, place, keys = bigrams(owner, codes, hashes)
    unigram = (c + s.add) / total
    root = np.log10(unigram)
    failure = np.where(c > 0, np.log10(s.prior / (c + s.prior)), 0.0)
    n = np.empty(len(pairs))
    n[by_hash(keys)] = pair_count
    state, word = pairs // len(hashes), pairs % len(hashes)
    arc = np.log10((n + s.prior * unigram[word]) / (c[state] + s.prior))
    step = np.where(n > 0, arc, failure[state] + root[word])
    weight = root[codes]
    weight[at] = step[place]
    return root[codes], weight


RESULT = "n_tokens long, n_known long, base_score double, score double"


def scored(table: DataFrame, counts: DataFrame, total: float, s: Settings) -> DataFrame:
    """(doc_id, RESULT) of every document of the slices."""
    kind, id_type = table.schema["ids"].dataType.elementType.simpleString(), to_arrow_type(table.schema["ids"].dataType.elementType)
    bodies = table.select("slice", F.lit(-1).alias("bucket"), "ids", "trains", "sizes", "codes", "hashes", F.lit(None).cast("binary").alias("wc"), F.lit(None).cast("binary").alias("pc"))
    sums = counts.where("slice is not null").select("slice", "bucket", F.lit(None).cast(f"array<{kind}>").alias("ids"), *(F.lit(None).cast("binary").alias(x) for x in ("trains", "sizes", "codes", "hashes")), "wc", "pc")
    met = bodies.unionByName(sums).repartition("slice").sortWithinPartitions("slice", "bucket")

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in in_groups(batches, "slice"):
            bodies = [r for r in rows if r["bucket"] < 0]
            owner, codes, hashes, _ = opened(bodies[0])
            # equal slices have equal counts, and send them as often as there are slices
            sums = [r for r in rows if r["bucket"] >= 0][:: len(bodies)]
            c, pair_count = (np.concatenate([unplanes(r[k], np.uint64) for r in sums]).astype(np.float64) for k in ("wc", "pc"))
            if len(c) != len(hashes):
                raise RuntimeError("counts of a slice are missing")
            base, weight = traverse(owner, codes, hashes, c, pair_count, total, s)
            n = len(bodies[0]["ids"])
            sums = [np.bincount(owner, minlength=n), np.bincount(owner, c[codes] > 0, n).astype(np.int64), np.bincount(owner, base, n), np.bincount(owner, weight, n)]
            for body in bodies:
                yield pa.RecordBatch.from_arrays([pa.array(body["ids"], id_type), *map(pa.array, sums)], names=["doc_id", "n_tokens", "n_known", "base_score", "score"])

    return met.mapInArrow(run, f"doc_id {kind}, {RESULT}")


@dataclass(frozen=True)
class Model:
    """slices: tokens by slice; counts: corpus counts by slice and bucket; training tokens n, distinct words v, bigrams."""

    slices: DataFrame
    counts: DataFrame
    n: int
    v: int
    arcs: int


def fit(docs: DataFrame, s: Settings = Settings(), training: Column | None = None) -> Model:
    """Counts of the training rows (by default those that are not held out) for every document."""
    table = sliced(docs, ~held_out(s.folds) if training is None else training, s)
    size = table.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    counts = stored(counted(sent_keys(table, max(s.least_buckets, math.ceil(size / s.bucket_tokens)))), "lm-counts")
    sums = counts.agg(*(F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in ("n", "v", "arcs"))).first()
    return Model(table, counts, sums["n"], sums["v"], sums["arcs"])


def language_model_scores(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every document."""
    model = fit(docs.select("doc_id", "text"), s)
    found = scored(model.slices, model.counts, model.n + s.add * (model.v + 1), s)
    return found.select("doc_id", held_out(s.folds).alias("held_out"), "n_tokens", "n_known", F.lit(model.n).cast("long").alias("train_tokens"), "base_score", "score")
