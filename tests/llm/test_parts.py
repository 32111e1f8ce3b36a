"""Shared parts, and the pipeline stage by stage."""

import collections
import random

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from panelia.llm import bits, components, jaccard, lm, secrets, sentencepieces, shared, substrings, toxicity, words

from .conftest import rows
from .test_operators import base_spans, brute_components, by_row


def test_slices_give_what_whole_batches_give():
    """Arrow kernels that misread slices inside their buffers must not be met."""
    texts = [r[1] for r in rows()] * 3
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array(range(len(texts)))], names=["text", "i"])
    whole = [[w for t in words.split_words(pa.array([x]))[1].to_pylist() for w in [t]] for x in texts]
    model = toxicity.fit_texts(pa.array(texts), np.arange(len(texts)) % 2, toxicity.Settings(min_count=1, min_z=0.0, min_log_odds=0.0, epochs=5))
    scores = toxicity.score_texts(pa.array(texts), model)
    for limit in (1, 200, 3000):
        seen = 0
        for part in words.slices(batch, limit=limit):
            owner, found = words.split_words(part.column("text"))
            got = [[] for _ in range(part.num_rows)]
            for o, w in zip(owner, found.to_pylist(), strict=True):
                got[o].append(w)
            assert got == whole[seen : seen + part.num_rows]
            assert toxicity.score_texts(part.column("text"), model) == pytest.approx(scores[seen : seen + part.num_rows], rel=1e-9)
            own, codes, hashes = lm.tokens(part.column("text"))
            every = [h[c].tolist() for t in texts[seen : seen + part.num_rows] for _, c, h in [lm.tokens(pa.array([t]))]]
            assert hashes[codes].tolist() == sum(every, []) and (np.diff(own) >= 0).all()
            seen += part.num_rows
        assert seen == len(texts)


def test_hashes_of_strings():
    texts = ["", "a", "b", "ab", "a\0", "x" * 7, "x" * 8, "x" * 9, "x" * 16, "x" * 17, "x" * 255, "x" * 256, "x" * 257, "x" * 5000, "é日本", "\0", "\0\0"]
    whole = words.hash_strings(pa.array(texts))
    assert len(set(whole.tolist())) == len(texts)
    assert whole.tolist() == [words.hash_strings(pa.array([t]))[0] for t in texts]
    assert words.hash_strings(pa.array(["?", *texts, "?"]).slice(1, len(texts))).tolist() == whole.tolist()
    assert not set(words.hash_strings(pa.array(texts), 1).tolist()) & set(whole.tolist())
    many = pa.array([str(i) for i in range(300_000)])
    assert len(np.unique(words.hash_strings(many))) == len(many)


def test_planes_and_distinct_values():
    rng = np.random.default_rng(0)
    for n in (0, 1, 1000):
        for kind in (np.uint8, np.uint32, np.uint64):
            x = rng.integers(0, np.iinfo(kind).max, n, dtype=kind)
            assert (words.unplanes(words.planes(x), kind) == x).all()
        for below in (50, 1 << 60):
            x = rng.integers(0, below, n)
            values, back = lm.distinct(x, below)
            assert (values[back] == x).all() and (np.diff(values) > 0).all()


def test_bitmaps_miss_nothing(spark):
    frame = spark.range(5000).selectExpr("xxhash64(id) as h")
    table = bits.bitmap(frame, "h", 14)
    hashes = np.array([r["h"] for r in frame.collect()]).view(np.uint64)
    assert bits.maybe(table, hashes).all()
    assert bits.bitmap(frame.limit(0), "h", 14).sum() == 0


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(300, 200), (200, 250)]
    random.Random(1).shuffle(edges)
    got = {r["node"]: r["comp"] for r in components.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 160)}, 300: 200, 200: 200, 250: 200}


def test_anchors_agree_on_equal_windows():
    rng = np.random.default_rng(0)
    h = rng.integers(0, 50, 400, dtype=np.uint64)
    h[200:260] = h[20:80]
    owner = np.repeat([0, 1], [150, 250]).astype(np.int32)
    start, least, place = substrings.anchors(h, owner)
    offset = dict(zip(start.tolist(), (place - start).tolist(), strict=True))
    value = dict(zip(start.tolist(), least.tolist(), strict=True))
    for i in range(20, 80 - substrings.K + 1):
        assert value[i] == value[i + 180] and offset[i] == offset[i + 180]
    constant = substrings.anchors(np.zeros(60, np.uint64), np.zeros(60, np.int32))
    assert len(np.unique(constant[2])) == len(constant[0])


def test_columns_never_clash(awkward):
    packed = shared.pack(awkward, "doc_id", "text")
    assert packed.columns == ["doc_id", "text", shared.REST]
    again = shared.unpack(packed, awkward.columns, ("doc_id", "text"))
    assert again.columns == awkward.columns and again.count() == awkward.count()
    assert shared.free_name("ids", ["IDS", "_ids"]) == "__ids"


def test_pipeline_stages(spark):
    """Each stage on what the stage before it kept."""
    import sentencepiece

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    kept = [docs]
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        kept.append(shared.stored(stage(spark, kept[-1], sf), f"test-{name}"))
        assert i == len(corpus_pipeline.STAGES) - 1 or kept[-1].columns == columns
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    clean = {r["doc_id"] for r in toxicity.toxicity(docs, labels).where("predicted = 0").collect()}
    assert {r["doc_id"] for r in kept[1].select("doc_id").collect()} == clean
    found = brute_components(by_row(kept[1]), jaccard.Settings())
    assert sorted(r["doc_id"] for r in kept[2].select("doc_id").collect()) == sorted(i for i, _, c in found if i == c)
    before = dict(by_row(kept[2]))
    after = dict(by_row(kept[3]))
    assert before.keys() == after.keys()
    for i, t in before.items():
        spans = base_spans(t)
        assert after[i].count(secrets.MARK) >= bool(spans) and (spans or after[i] == t or secrets.MARK in after[i])
        assert all(t[a:b] not in after[i] for a, _, b in spans)
    mixed = collections.Counter(i for i, _ in by_row(kept[4]))
    assert set(mixed) <= set(after) and max(mixed.values()) == 1 and len(mixed) > 0.5 * len(after)
    own = sentencepiece.SentencePieceProcessor(model_file=sentencepieces.MODEL)
    for r in kept[5].collect():
        assert r["ids"] == own.encode(r["text"]) and r["round_trip"]
    assert corpus_pipeline.run(spark, sf).count() == kept[5].count()
