"""Operators work on all documents: cases that a part of the job would pass over."""

import collections

import numpy as np
import pyarrow as pa
import pytest

from panelia.llm import jaccard, lm, media, mixing, sentencepieces, shared

# --- SentencePiece


def test_every_document_is_compared(spark):
    rows = [(i, f"text {i}  of  words \U0001f600 日本▁語 ") for i in range(40)] + [(None, "no id"), (None, " "), (None, None)]
    out = sentencepieces.encode_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(out) == len(rows) and all(r["parity"] is True for r in out)


class Odd:
    """The library's processor with another encoding of one word."""

    def __init__(self, own, word):
        self.own, self.word = own, word

    def encode(self, texts, num_threads=1):
        if isinstance(texts, str):
            return self.own.encode(texts)
        return [[0] if t == self.word else x for t, x in zip(texts, self.own.encode(texts), strict=True)]


def test_a_differing_chunk_is_seen_in_each_document():
    import sentencepiece

    own = sentencepiece.SentencePieceProcessor(model_file=sentencepieces.MODEL)
    codec = sentencepieces.Codec(open(sentencepieces.MODEL, "rb").read())
    texts = ["one rare word", "one word", "", None, " ", "a ", "  two   spaces  ", "rare", "▁ marks ▁▁", "tab\trare\n"]
    assert codec.by_chunk
    assert codec.encode_checked(pa.array(texts), own)[3].all()
    assert codec.encode_checked(pa.array(texts), Odd(own, "rare"))[3].tolist() == [t not in ("one rare word", "rare") for t in texts]
    codec.by_chunk = False
    assert codec.encode_checked(pa.array(texts), own)[3].all()
    assert codec.encode_checked(pa.array(texts), Odd(own, "rare"))[3].tolist() == [t != "rare" for t in texts]


# --- mixing


def skewed(spark):
    """The reviewer's sources: 400k, 300k, 100k, 20k and 5k characters; documents of 1,000."""
    sizes = {"a": 400, "b": 300, "c": 100, "d": 20, "e": 5}
    rows = [(k * 1000 + i, "x" * 1000, s) for k, (s, n) in enumerate(sizes.items()) for i in range(n)]
    return sizes, spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)


def test_the_mix_keeps_all_documents(spark):
    sizes, docs = skewed(spark)
    assert mixing.mix(docs).where("in_mix").count() == sum(sizes.values())
    assert sorted(r["doc_id"] for r in mixing.interleave(docs).collect()) == sorted(r["doc_id"] for r in docs.collect())


def test_a_written_mix_keeps_its_order(spark):
    _, docs = skewed(spark)
    s = mixing.Settings(block_chars=4000)
    slot = {r["doc_id"]: (r["slot"], r["before"]) for r in mixing.schedule(docs, s).collect()}
    placed = mixing.with_places(shared.stored(mixing.interleave(docs, s), "test-mix")).orderBy("mix_file", "mix_row").collect()
    order = [slot[r["doc_id"]] for r in placed]
    assert len(order) == len(slot) and order == sorted(order)
    assert mixing.with_places(docs).where("mix_file is null").count() == docs.count()


def test_shares_before_a_source_is_dry(spark):
    """Until the first source has no block left, each has its share of the slots to within less than one block."""
    sizes, docs = skewed(spark)
    rows = mixing.schedule(docs, mixing.Settings(block_chars=1000)).collect()
    size = mixing.quotas({k: (1000 * n) ** 0.7 for k, n in sizes.items()}, 1000)
    period = sum(size.values())
    first_dry = min(max(r["slot"] for r in rows if r["source"] == k) for k in sizes)
    taken = dict.fromkeys(sizes, 0)
    by_slot = {r["slot"]: r["source"] for r in rows}
    for slot in range(first_dry):
        if slot in by_slot:
            taken[by_slot[slot]] += 1
        assert all(abs(taken[k] - (slot + 1) * size[k] / period) < 1 for k in sizes)


@pytest.mark.parametrize("weights", [None, {"a": 1.0, "b": 1.0, "c": 1.0, "d": 1.0, "e": 1.0}])
def test_a_horizon_takes_surplus_only(spark, weights):
    sizes, docs = skewed(spark)
    s = mixing.Settings(weights=weights, coverage=0.5)
    kept = collections.Counter(r["source"] for r in mixing.interleave(docs, s).collect())
    wanted = weights or {k: (1000 * n) ** s.alpha for k, n in sizes.items()}
    for k, n in sizes.items():
        if n / sum(sizes.values()) < 0.95 * wanted[k] / sum(wanted.values()):
            assert kept[k] == n
    assert not weights or sum(kept.values()) < sum(sizes.values())


# --- Jaccard join


def test_keep_one_with_null_and_repeated_ids(spark):
    def text(k):
        return " ".join(f"t{k}w{i}" for i in range(60))

    near = text(1).replace("t1w59", "other")
    rows = [(None, text(k)) for k in range(5)] + [(7, text(k)) for k in range(5, 9)] + [(None, near), (None, text(0)), (7, text(5)), (8, text(6)), (None, None), (None, None), (3, " "), (3, " "), (9, text(2))]
    kept = collections.Counter((r["doc_id"], r["text"]) for r in jaccard.keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect())
    assert kept[None, text(1)] + kept[None, near] == 1
    one = [(None, text(0)), (9, text(2)), (None, text(3)), (None, text(4)), *((7, text(k)) for k in range(5, 9))]
    assert kept[None, None] == kept[3, " "] == 2
    assert all(kept[x] == 1 for x in one) and sum(kept.values()) == len(one) + 5


# --- media


def test_every_sample_is_in_a_frame():
    quiet = bytes([128]) * (3 * media.UNIT)
    loud = quiet[:-16] + bytes([0, 255, 255, 0]) * 4
    assert not np.array_equal(media.features(quiet)[0], media.features(loud)[0])
    for n in (1, 2, 3, 10):
        samples = n * media.UNIT // media.DOWN
        assert (len(media.features(bytes(n * media.UNIT))[0]) - 1) * media.HOP + media.FRAME >= samples


def test_the_digest_is_made_from_stored_tensors(monkeypatch):
    made = []
    kept = media.tensor_array
    monkeypatch.setattr(media, "tensor_array", lambda blobs: made.append(len(blobs)) or kept(blobs))
    text = "some words of a text " * 2000
    feature = media.digest(text)[-1]
    assert made and made[0] > 1
    assert feature == media.summary(*media.features(media.pad(text.encode())))


# --- language model


def test_bigrams_seen_once_are_arcs(spark):
    docs = spark.createDataFrame([(i, f"once{i} rare{i} common") for i in range(12)], "doc_id long, text string")
    model = lm.fit(docs)
    training = docs.where(~lm.held_out(lm.Settings().folds)).count()
    # (once, rare) and (rare, common) of each training document, and (common, end)
    assert training > 3 and model.arcs == 2 * training + 1
