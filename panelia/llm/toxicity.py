"""Toxicity: a factorization machine over hashed terms.

A document is the set of its distinct words.  Every word stands for hashed terms (the word and its
prefixes), its linear weight and factor vector are the sums over these terms, and the score is

    sigmoid(bias + sum_w a(w) + sum_{w < w'} <v(w), v(w')>)

so that pairs of words (an insult with a group mention) count beyond their additive weights.

The model is learnt on a bounded sample of labelled rows (``max_positive``, ``max_negative``, chosen by a
hash of the id, one text for each id); executors count and screen its terms by their log odds and its z-score, so
that the table that the driver trains and broadcasts holds at most ``max_terms`` terms.  Words that tell nothing
alone are screened by pairs: of the ``pair_words`` most frequent words, those of a pair whose joint presence moves
the log odds by ``min_pair_odds`` beyond the sum of its words' shares, with a z-score of ``min_pair_z``, come in
too (at most ``max_pair_terms``).  Every document is then scored whole, in one narrow pass.

Defined cases: a null or empty text has no word and gets sigmoid(bias); null or contradictory labels
are dropped / count as 1 when any row of the id says 1; without labels of both kinds every score is the
share of the label that is there (0.0 without labels); repeated documents are scored one by one, and learnt from
once; a very long text is a set of words like any other; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import free_name, pack, stored, unpack
from .words import as_string, bound_batches, encode, hash_strings, release, signed, slices, tidy

EDGE = ".,;:!?|\"'()[]{}<>*_-"
PREFIXES = (3, 4, 5, 6, 7, 8)


@dataclass(frozen=True)
class Settings:
    max_positive: int = 6_000
    max_negative: int = 14_000
    folds: int = 5
    factors: int = 8
    epochs: int = 150
    rate: float = 0.05
    decay: float = 1e-3
    min_count: int = 3
    min_z: float = 3.0
    min_log_odds: float = 1.0
    max_terms: int = 1 << 16
    pair_words: int = 1024
    min_pair_odds: float = 1.0
    min_pair_z: float = 6.0
    max_pair_terms: int = 256
    seed: int = 7


@dataclass(frozen=True)
class Model:
    """terms: sorted hashes; weights and factors by term; bias."""

    terms: np.ndarray
    weights: np.ndarray
    factors: np.ndarray
    bias: float


def vocabulary(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Distinct pairs (text, word) as two arrays, and the dictionary of words."""
    lists = pc.ascii_split_whitespace(pc.utf8_lower(as_string(texts)))
    words = pc.utf8_trim(lists.flatten(), EDGE)
    owner = np.repeat(np.arange(len(lists), dtype=np.int64), np.asarray(pc.list_value_length(lists)))
    codes, dictionary = encode(words)
    if not len(codes):
        return owner, codes.astype(np.int64), dictionary
    empty = np.asarray(pc.equal(dictionary, ""))[codes]
    pairs = np.unique(owner[~empty] * len(dictionary) + codes[~empty])
    return pairs // len(dictionary), pairs % len(dictionary), dictionary


def word_terms(dictionary: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The word's index and the hash of each of its terms: the word, and its proper prefixes of PREFIXES characters."""
    rows, terms = [np.arange(len(dictionary))], [hash_strings(dictionary)]
    length = np.asarray(pc.utf8_length(dictionary))
    for n in PREFIXES:
        longer = np.flatnonzero(length > n)
        if not len(longer):
            continue
        cut = pc.utf8_slice_codeunits(dictionary.take(pa.array(longer)), 0, n)
        codes, short = encode(cut)
        rows.append(longer)
        terms.append(hash_strings(short, n)[codes])
    return np.concatenate(rows), np.concatenate(terms)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


def known_terms(dictionary: pa.Array, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of a word's index and the place of a term of it in ``terms`` (sorted)."""
    rows, hashes = word_terms(dictionary)
    if not len(terms):
        return rows[:0], rows[:0]
    at = np.minimum(np.searchsorted(terms, hashes), len(terms) - 1)
    hit = terms[at] == hashes
    return rows[hit], at[hit]


def word_vectors(dictionary: pa.Array, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words that hold a known term (ascending), with their weights and factors."""
    rows, at = known_terms(dictionary, model.terms)
    words, back = np.unique(rows, return_inverse=True)
    weights = np.bincount(back, model.weights[at], len(words))
    factors = np.stack([np.bincount(back, model.factors[at, f], len(words)) for f in range(model.factors.shape[1])], 1) if len(words) else np.zeros((0, model.factors.shape[1]))
    return words, weights, factors


def score_texts(texts: pa.Array, model: Model) -> np.ndarray:
    doc, code, dictionary = vocabulary(texts)
    words, weights, factors = word_vectors(dictionary, model)
    place = np.full(len(dictionary), -1, np.int64)
    place[words] = np.arange(len(words))
    at = place[code] if len(code) else code
    doc, at = doc[at >= 0], at[at >= 0]
    n = len(texts)
    z = np.full(n, model.bias) + np.bincount(doc, weights[at], n)
    for f in range(factors.shape[1]):
        v = factors[at, f]
        z += 0.5 * (np.bincount(doc, v, n) ** 2 - np.bincount(doc, v * v, n))
    return sigmoid(z)


def term_counts(texts: pa.Array, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The terms of the texts, in how many texts each is, in how many of label 1, and whether it is a whole word."""
    doc, code, dictionary = vocabulary(texts)
    rows, hashes = word_terms(dictionary)
    terms, term = np.unique(hashes, return_inverse=True)
    order = np.argsort(code, kind="stable")
    start = np.searchsorted(code[order], np.arange(len(dictionary) + 1))
    size = (start[1:] - start[:-1])[rows]
    inner = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    pair = np.unique(np.repeat(term, size) * np.int64(len(y)) + doc[order][np.repeat(start[rows], size) + inner]) if len(rows) else np.empty(0, np.int64)
    t, d = pair // max(len(y), 1), pair % max(len(y), 1)
    whole = np.zeros(len(terms), bool)
    whole[term[: len(dictionary)]] = True
    return terms, np.bincount(t, minlength=len(terms)), np.bincount(t, y[d], len(terms)).astype(np.int64), whole


def screen(terms: np.ndarray, count: np.ndarray, pos: np.ndarray, positive: int, negative: int, s: Settings) -> np.ndarray:
    """The terms that tell the labels apart, sorted; at most ``max_terms``, by the z-score of the log odds."""
    a, b = (pos + 0.5) / (positive + 1), (count - pos + 0.5) / (negative + 1)
    odds = np.abs(np.log(a / (1 - a)) - np.log(b / (1 - b)))
    z = odds / np.sqrt(1 / (pos + 0.5) + 1 / (count - pos + 0.5))
    keep = np.flatnonzero((count >= s.min_count) & (odds >= s.min_log_odds) & (z >= s.min_z))
    return np.sort(terms[keep[np.lexsort((terms[keep], -z[keep]))][: s.max_terms]])


def known_words(texts: pa.Array, terms: np.ndarray) -> pa.Array:
    """The distinct words of each text that hold a known term."""
    doc, code, dictionary = vocabulary(texts)
    known = np.zeros(len(dictionary), bool)
    known[known_terms(dictionary, terms)[0]] = True
    keep = known[code]
    offsets = np.concatenate([[0], np.cumsum(np.bincount(doc[keep], minlength=len(texts)))])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), dictionary.take(pa.array(code[keep])).cast(pa.string()))


def frequent(terms: np.ndarray, count: np.ndarray, whole: np.ndarray, s: Settings) -> np.ndarray:
    """The hashes of the ``pair_words`` most frequent words, sorted."""
    at = np.flatnonzero(whole & (count >= s.min_count))
    return np.sort(terms[at[np.lexsort((terms[at], -count[at]))][: s.pair_words]])


def joint_counts(doc: np.ndarray, word: np.ndarray, y: np.ndarray, m: int) -> np.ndarray:
    """By label, in how many texts each pair of m words is (on the diagonal: each word)."""
    out = np.zeros((2, m, m), np.float32)
    place = np.searchsorted(doc, np.arange(0, len(y) + 1024, 1024))
    for i, (a, b) in enumerate(zip(place, place[1:], strict=False)):
        some = np.zeros((1024, m), np.float32)
        some[doc[a:b] - 1024 * i, word[a:b]] = 1
        label = np.zeros(1024, bool)
        part = y[1024 * i : 1024 * (i + 1)] > 0
        label[: len(part)] = part
        for k in (0, 1):
            rows = some[label == bool(k)]
            out[k] += rows.T @ rows
    return out


def paired_terms(lists: pa.Array, y: np.ndarray, often: np.ndarray, s: Settings) -> np.ndarray:
    """The frequent words that tell labels apart in pairs, though each alone may not: hashes, sorted."""
    code, dictionary = encode(lists.flatten().cast(pa.large_string()))
    if not len(code) or not len(often):
        return often[:0]
    hashes = hash_strings(dictionary)
    at = np.minimum(np.searchsorted(often, hashes), len(often) - 1)
    word = np.where(often[at] == hashes, at, -1)[code]
    doc = np.repeat(np.arange(len(lists)), np.asarray(pc.list_value_length(lists)))
    both = joint_counts(doc[word >= 0], word[word >= 0], y, len(often))
    odds, variance = np.zeros((2, len(often), len(often)), np.float32)
    for k, sign in ((1, 1), (0, -1)):
        n, joint, own = np.float32((y > 0).sum() if k else (y == 0).sum()), both[k], np.diag(both[k])
        for cell, plus in ((joint, 1), (own[:, None] - joint, -1), (own[None, :] - joint, -1), (n - own[:, None] - own[None, :] + joint, 1)):
            odds += sign * plus * np.log(cell + 0.5)
            variance += 1 / (cell + 0.5)
    z = np.triu(np.where(np.abs(odds) >= s.min_pair_odds, np.abs(odds) / np.sqrt(variance), 0), 1)
    a, b = np.nonzero(z >= s.min_pair_z)
    order = np.lexsort((b, a, -z[a, b]))
    best = np.stack([a[order], b[order]], 1).ravel()
    first = np.sort(np.unique(best, return_index=True)[1])[: s.max_pair_terms]
    return np.sort(often[best[first]])


def holding(lists: pa.Array, terms: np.ndarray) -> pa.Array:
    """The lists without the words that hold none of the terms."""
    flat = lists.flatten()
    code, dictionary = encode(flat.cast(pa.large_string()))
    known = np.zeros(len(dictionary), bool)
    known[known_terms(dictionary, terms)[0]] = True
    keep = known[code]
    doc = np.repeat(np.arange(len(lists)), np.asarray(pc.list_value_length(lists)))
    offsets = np.concatenate([[0], np.cumsum(np.bincount(doc[keep], minlength=len(lists)))])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat.filter(pa.array(keep)))


def learn(lists: pa.Array, y: np.ndarray, terms: np.ndarray, often: np.ndarray, s: Settings) -> Model:
    """The model of the terms and of the paired words among the frequent ones; lists hold the words of both."""
    terms = np.union1d(terms, paired_terms(lists, y, often, s))
    lists = holding(lists, terms)
    release()
    return train(lists, y, terms, s)


def constant(y: np.ndarray, s: Settings) -> Model:
    share = y.mean() if len(y) else 0.0
    return Model(np.empty(0, np.uint64), np.empty(0), np.zeros((0, s.factors)), float(np.log((share + 1e-9) / (1 - share + 1e-9))))


def train(lists: pa.Array, y: np.ndarray, terms: np.ndarray, s: Settings) -> Model:
    """Minimise log loss with Adam over the whole sample, given as known words."""
    code, dictionary = encode(lists.flatten().cast(pa.large_string()))
    doc = np.repeat(np.arange(len(lists)), np.asarray(pc.list_value_length(lists)))
    wrow, wterm = known_terms(dictionary, terms)
    n, m, p = len(y), len(dictionary), y.sum()
    rng = np.random.default_rng(s.seed)
    theta = {"w": np.zeros(len(terms)), "v": rng.normal(0, 0.05, (len(terms), s.factors)), "b": np.array([np.log(p / (n - p))])}
    first, second = ({k: np.zeros_like(x) for k, x in theta.items()} for _ in range(2))
    for step in range(1, s.epochs + 1):
        ww = np.bincount(wrow, theta["w"][wterm], m)
        wv = np.stack([np.bincount(wrow, theta["v"][wterm, f], m) for f in range(s.factors)], 1)
        total = np.stack([np.bincount(doc, wv[code, f], n) for f in range(s.factors)], 1)
        z = theta["b"] + np.bincount(doc, ww[code], n) + 0.5 * (total**2).sum(1) - 0.5 * np.bincount(doc, (wv**2).sum(1)[code], n)
        g = (sigmoid(z) - y) / n
        gw = np.bincount(code, g[doc], m)
        gv = np.stack([np.bincount(code, g[doc] * (total[doc, f] - wv[code, f]), m) for f in range(s.factors)], 1)
        grad = {
            "w": np.bincount(wterm, gw[wrow], len(terms)) + s.decay * theta["w"] / max(len(terms), 1) ** 0.5,
            "v": np.stack([np.bincount(wterm, gv[wrow, f], len(terms)) for f in range(s.factors)], 1) + s.decay * theta["v"],
            "b": np.array([g.sum()]),
        }
        for k, x in theta.items():
            first[k] = 0.9 * first[k] + 0.1 * grad[k]
            second[k] = 0.999 * second[k] + 0.001 * grad[k] ** 2
            x -= s.rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-9)
    return Model(terms, theta["w"], theta["v"], float(theta["b"][0]))


def fit_texts(texts: pa.Array, labels: np.ndarray, s: Settings = Settings()) -> Model:
    """The model of a sample that is in memory."""
    y = labels.astype(np.float64)
    if not len(y) or y.min() == y.max():
        return constant(y, s)
    found, count, pos, whole = term_counts(texts, y)
    terms, often = screen(found, count, pos, int(y.sum()), int(len(y) - y.sum()), s), frequent(found, count, whole, s)
    return learn(known_words(texts, np.union1d(terms, often)), y, terms, often, s)


def fold(doc_id: str | F.Column, folds: int = 5):
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % folds


def sample(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> DataFrame:
    """At most ``max_positive + max_negative`` rows (text, toxic), none of them held out."""
    known = (
        labels.select(F.col("doc_id"), F.col("toxic").cast("int").alias("toxic"))
        .where("doc_id is not null and toxic in (0, 1)")
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
        .where(fold("doc_id", s.folds) != 0)
        .withColumn("h", F.xxhash64("doc_id"))
    )
    chosen = known.where("toxic = 1").orderBy("h", "doc_id").limit(s.max_positive).unionByName(known.where("toxic = 0").orderBy("h", "doc_id").limit(s.max_negative))
    # broadcast: at most max_positive + max_negative pairs
    found = docs.select("doc_id", "text").join(F.broadcast(chosen.drop("h")), "doc_id")
    return found.groupBy("doc_id", "toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("doc_id", "text", "toxic")


def fit(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> Model:
    """Terms are counted and screened on the executors; only the sample's known and frequent words come to the driver."""
    spark = docs.sparkSession
    bound_batches(spark)
    rows = stored(sample(docs, labels, s), "tox-sample", narrow=True)
    sizes = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    if len(sizes) < 2:
        return constant(np.repeat([0.0, 1.0], [sizes.get(0, 0), sizes.get(1, 0)]), s)

    @tidy
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, limit=2 << 20):
                terms, n, pos, whole = term_counts(part.column("text"), np.asarray(part.column("toxic")).astype(np.float64))
                yield pa.RecordBatch.from_arrays([pa.array(signed(terms)), pa.array(n), pa.array(pos), pa.array(whole)], names=["term", "n", "pos", "whole"])

    counts = rows.mapInArrow(count, "term long, n long, pos long, whole boolean").groupBy("term", "whole").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos")).where(F.col("n") >= s.min_count)
    counts = stored(counts, "tox-terms", narrow=True)
    a, b = (F.col("pos") + 0.5) / (sizes[1] + 1), (F.col("n") - F.col("pos") + 0.5) / (sizes[0] + 1)
    odds = F.abs(F.log(a / (1 - a)) - F.log(b / (1 - b)))
    z = odds / F.sqrt(1 / (F.col("pos") + 0.5) + 1 / (F.col("n") - F.col("pos") + 0.5))
    told = counts.where((odds >= s.min_log_odds) & (z >= s.min_z)).withColumn("z", z)
    # at most max_terms and pair_words rows
    best = lambda frame, by, most: np.sort(np.asarray(frame.orderBy(F.desc(by), "term").limit(most).select("term").toArrow()["term"]).view(np.uint64))
    terms, often = best(told, "z", s.max_terms), best(counts.where("whole"), "n", s.pair_words)
    shared = spark.sparkContext.broadcast(np.union1d(terms, often))

    @tidy
    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, limit=2 << 20):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("toxic"), known_words(part.column("text"), shared.value)], names=["doc_id", "toxic", "words"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    known = rows.mapInArrow(keep, f"doc_id {kind}, toxic int, words array<string>").withColumn("words", F.array_sort("words")).orderBy("doc_id", F.hash("words")).toArrow()
    y, lists = np.asarray(known["toxic"]).astype(np.float64), known["words"].combine_chunks()
    del known
    return learn(lists, y, terms, often, s)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with a column ``toxicity`` (0 to 1; underscores before a name that is taken); all columns stay."""
    spark: SparkSession = docs.sparkSession
    bound_batches(spark)
    names = [*docs.columns, free_name("toxicity", docs.columns)]
    shared = spark.sparkContext.broadcast(model)  # at most max_terms terms

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, limit=2 << 20):
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(score_texts(part.column("text"), shared.value))], names=names)

    schema = T.StructType([*docs.schema.fields, T.StructField(names[-1], T.DoubleType())])
    return docs.mapInArrow(run, schema)


def toxicity(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    scored = score(docs.select("doc_id", "text"), fit(docs, labels, s))
    return scored.select(
        "doc_id",
        (fold("doc_id", s.folds) == 0).alias("held_out"),
        F.col("toxicity").alias("score"),
        F.when(F.col("toxicity") >= 0.5, 1).otherwise(0).cast("int").alias("predicted"),
    )


def keep_clean(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, s: Settings = Settings()) -> DataFrame:
    """The documents whose score stays below ``threshold``, with all their columns."""
    needed = ("doc_id", "text")
    scored = score(pack(docs, *needed), fit(docs.select(*needed), labels, s))
    return unpack(scored.where(F.col("toxicity") < threshold), docs.columns, needed)
