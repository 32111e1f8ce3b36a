"""SentencePiece encoding and decoding on the tokenizers library.

The model's protobuf is parsed here; its normaliser, metaspace marker, scores and byte fallback are rebuilt as
a tokenizers model: unigram scores where the model is of the unigram type, else a BPE whose merges are ranked
by the scores of what they make.  Batches are encoded by the library's threads.

Where no piece holds a marker after another character, no piece reaches over a run of markers into the next
chunk, so that chunks (markers and what follows) are encoded by themselves; then each distinct chunk of a
batch is encoded once.  Encodings are decoded and compared with the whole text, and compared with those of the
sentencepiece library: each distinct chunk of a batch, so that a document agrees when all its chunks do and they
are the whole text.  Every ``verify_every``-th document (by a hash of its id) is compared as a whole besides; so
is every document where chunks can't be encoded by themselves.

Defined cases: a null or empty text has no ids and decodes to an empty text; repeated rows are encoded one by
one; all columns of the documents stay, and an added column whose name is taken gets an underscore before it.
"""

from __future__ import annotations

import itertools
import os
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import free_name, pack, unpack
from .words import bound_batches, encode, slices, tidy

MARK = "▁"
#: Chunks that the library encodes at a time.
BATCH = 1 << 14
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """The fields of a protobuf message: number and raw value."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        elif kind == 2:
            size = varint()
            yield key >> 3, data[at : at + size]
            at += size
        else:
            size = {1: 8, 5: 4}[kind]
            yield key >> 3, data[at : at + size]
            at += size


@dataclass
class Spec:
    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    charsmap: bytes = b""
    dummy_prefix: bool = True
    squeeze: bool = True
    escape: bool = True


def parse(data: bytes) -> Spec:
    spec = Spec()
    for number, value in fields(data):
        if number == 1:
            piece = dict(fields(value))
            spec.pieces.append((piece.get(1, b"").decode(), struct.unpack("<f", piece.get(2, b"\0\0\0\0"))[0], piece.get(3, NORMAL)))
        elif number == 2:
            trainer = dict(fields(value))
            spec.kind, spec.byte_fallback = trainer.get(3, UNIGRAM), bool(trainer.get(35, 0))
        elif number == 3:
            rule = dict(fields(value))
            spec.charsmap = rule.get(2, b"")
            spec.dummy_prefix, spec.squeeze, spec.escape = bool(rule.get(3, 1)), bool(rule.get(4, 1)), bool(rule.get(5, 1))
    return spec


def merges(spec: Spec) -> list[tuple[str, str]]:
    """Pairs of pieces by the score of the piece that they make, best first."""
    usable = {p for p, _, kind in spec.pieces if kind in (NORMAL, USER)}
    ranked = sorted((p for p in spec.pieces if p[2] in (NORMAL, USER) and len(p[0]) > 1), key=lambda p: -p[1])
    return [(p[:i], p[i:]) for p, _, _ in ranked for i in range(1, len(p)) if p[:i] in usable and p[i:] in usable]


class Codec:
    """A rebuilt model: ``tokenizer`` for whole texts, ``chunks`` for normalised chunks."""

    def __init__(self, data: bytes, threads: int = 2):
        os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
        os.environ["TOKENIZERS_PARALLELISM"] = "true"
        from tokenizers import Tokenizer, decoders

        self.spec = spec = parse(data)
        if not spec.escape:
            raise ValueError("models without the metaspace marker are not supported")
        self.chunks = Tokenizer(self.model())
        self.chunks.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()])
        #: Chunks are independent, and the text is kept as it is but for markers.
        self.by_chunk = spec.kind == BPE and not spec.charsmap and not spec.squeeze and spec.dummy_prefix and not any(MARK in p.lstrip(MARK) for p, _, _ in spec.pieces)

    def model(self):
        from tokenizers import models

        spec = self.spec
        unknown = next(i for i, p in enumerate(spec.pieces) if p[2] == UNKNOWN)
        if spec.kind == UNIGRAM:
            return models.Unigram([(p, s) for p, s, _ in spec.pieces], unknown, spec.byte_fallback)
        if spec.kind != BPE:
            raise ValueError("the model is neither unigram nor BPE")
        return models.BPE({p: i for i, (p, _, _) in enumerate(spec.pieces)}, merges(spec), unk_token=spec.pieces[unknown][0], fuse_unk=True, byte_fallback=spec.byte_fallback)

    @cached_property
    def tokenizer(self):
        """Of whole texts, with the model's normaliser; where chunks do, only decoding makes it."""
        from tokenizers import Regex, Tokenizer, decoders, normalizers

        spec = self.spec
        steps = [normalizers.Precompiled(spec.charsmap)] if spec.charsmap else []
        if spec.squeeze:
            steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
        if spec.dummy_prefix:
            steps.append(normalizers.Prepend(MARK))
        steps.append(normalizers.Replace(" ", MARK))
        found = Tokenizer(self.model())
        found.normalizer = normalizers.Sequence(steps)
        ends = [decoders.Strip(" ", 1, 0)] if spec.dummy_prefix else []
        found.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *ends])
        return found

    def encode_texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        """The ids of all texts, the offsets of each text in them, and the decoded texts."""
        return self.encode_checked(texts)[:3]

    def encode_checked(self, texts: pa.Array, own=None, threads: int = 1) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray]:
        """As ``encode_texts``, and whether each text's ids are those of ``own``, the library's processor (None: not compared)."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        if not self.by_chunk:
            found = self.tokenizer.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)
            ids = [e.ids for e in found]
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int64)
            same = np.array([a == b for a, b in zip(ids, own.encode(texts.to_pylist(), num_threads=threads), strict=True)], bool) if own and ids else np.ones(len(ids), bool)
            return np.fromiter(itertools.chain.from_iterable(ids), np.int32), offsets, pa.array(self.tokenizer.decode_batch(ids, skip_special_tokens=False), pa.large_string()), same
        owner, chunks, back = chunked(texts)
        codes, dictionary = encode(chunks)
        parts, sizes_of, spelled, agree = [], [], [], [np.empty(0, bool)]
        for i in range(0, len(dictionary), BATCH):  # encodings are large while they live
            some = dictionary.slice(i, BATCH).to_pylist()
            found = [e.ids for e in self.chunks.encode_batch_fast(some, add_special_tokens=False)]
            if own:
                agree.append(np.fromiter((a == b for a, b in zip(found, library_ids(own, some, threads), strict=True)), bool, len(found)))
            sizes_of.append(np.fromiter(map(len, found), np.int64, len(found)))
            parts.append(np.fromiter(itertools.chain.from_iterable(found), np.int32))
            spelled.append(pa.array(self.chunks.decode_batch(found, skip_special_tokens=False), pa.string()))
        size = np.concatenate([np.empty(0, np.int64), *sizes_of])
        flat = np.concatenate([np.empty(0, np.int32), *parts])
        start = np.cumsum(size) - size
        sizes = size[codes]
        at = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(start[codes], sizes)
        by_text = np.bincount(owner, sizes, len(texts)).astype(np.int64) if len(owner) else np.zeros(len(texts), np.int64)
        decoded = pa.concat_arrays(spelled) if spelled else pa.array([], pa.string())
        lists = pa.ListArray.from_arrays(pa.array(back, pa.int32()), decoded.take(pa.array(codes)))
        # the prefix's space goes
        text = pc.utf8_slice_codeunits(pc.binary_join(lists, ""), 1).cast(pa.large_string()) if len(lists) else texts
        same = np.ones(len(texts), bool)
        if own and len(texts):
            whole = pc.binary_join(pa.ListArray.from_arrays(pa.array(back, pa.int32()), chunks.cast(pa.string())), "").cast(pa.large_string())
            wanted = pc.binary_join_element_wise(pa.scalar(MARK, pa.large_string()), pc.replace_substring(texts, " ", MARK), pa.scalar("", pa.large_string()))
            same = np.asarray(pc.or_(pc.equal(whole, wanted), pc.equal(pc.binary_length(texts), 0)))
            same = same & (np.bincount(owner, ~np.concatenate(agree)[codes], len(texts)) == 0)
        return flat[at], np.concatenate([[0], np.cumsum(by_text)]), text, same

    def decode_ids(self, ids: list[list[int]]) -> list[str]:
        return self.tokenizer.decode_batch(ids, skip_special_tokens=False)


@lru_cache(maxsize=1)
def worker_codec(data: bytes, threads: int) -> tuple[Codec, object]:
    """The rebuilt model and the library's, once for a worker process."""
    import sentencepiece

    return Codec(data, threads), sentencepiece.SentencePieceProcessor(model_proto=data)


def library_ids(own, chunks: list[str], threads: int) -> list[list[int]]:
    """The library's ids of chunks; it puts the first marker before them itself."""
    found = own.encode([c[1:] for c in chunks], num_threads=threads)
    # an empty text has no ids: a lone marker is what a last space adds
    return [x if len(c) > 1 else own.encode("a ")[len(own.encode("a")) :] for c, x in zip(chunks, found, strict=True)]


def chunked(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Owner and chunks (markers and what follows) of the texts with their prefix, and the offsets of each text in them."""
    lists = pc.split_pattern(texts, " ")
    words = lists.flatten()
    n = len(texts)
    counts = np.asarray(pc.list_value_length(lists)).astype(np.int64)
    counts[np.asarray(pc.equal(pc.binary_length(texts), 0))] = 0
    every = np.asarray(pc.list_value_length(lists)).astype(np.int64)
    owner = np.repeat(np.arange(n), every)
    used = np.repeat(counts > 0, every)
    size = np.asarray(pc.binary_length(words)).astype(np.int64)
    last = np.zeros(len(owner), bool)
    last[np.cumsum(every) - 1] = True
    # an empty word is a marker that the next word of the text takes on, or that ends the text
    keep = used & ((size > 0) | last)
    place = np.arange(len(owner))
    before = np.maximum.accumulate(np.where(keep | np.concatenate([[True], owner[1:] != owner[:-1]]), place, 0)) if len(owner) else place
    first = np.concatenate([[True], owner[1:] != owner[:-1]]) if len(owner) else np.zeros(0, bool)
    previous = np.concatenate([[0], before[:-1]]) if len(owner) else place
    start = np.where(first, place, np.where(keep[previous], previous + 1, previous)) if len(owner) else place
    marks = place - start + 1
    at = np.flatnonzero(keep)
    kept, m = words.take(pa.array(at)), marks[at]
    out = pc.binary_join_element_wise(pa.scalar(MARK, pa.large_string()), kept, pa.scalar("", pa.large_string()))
    if (m > 1).any():
        many = np.flatnonzero(m > 1)
        longer = [MARK * int(k) + w for k, w in zip(m[many], kept.take(pa.array(many)).to_pylist(), strict=True)]
        mask = np.zeros(len(at), bool)
        mask[many] = True
        out = pc.replace_with_mask(out, pa.array(mask), pa.array(longer, pa.large_string()))
    back = np.concatenate([[0], np.cumsum(np.bincount(owner[at], minlength=n))]).astype(np.int64)
    return owner[at], out, back


def encode_documents(docs: DataFrame, model_path: str = MODEL, verify_every: int = 16, threads: int = 2) -> DataFrame:
    """``docs`` with ids, n_tokens, round_trip (the ids decode to the text) and parity (the ids are the library's)."""
    bound_batches(docs.sparkSession, 4)
    with open(model_path, "rb") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())  # one model file
    needed = ("doc_id", "text")
    docs, columns = pack(docs, *needed), docs.columns
    names = docs.columns
    added = [T.StructField("ids", T.ArrayType(T.IntegerType(), False)), T.StructField("n_tokens", T.LongType()), T.StructField("round_trip", T.BooleanType()), T.StructField("parity", T.BooleanType())]

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, own = worker_codec(shared.value, threads)
        for batch in batches:
            for part in slices(batch, limit=4 << 20):
                texts = pc.fill_null(part.column("text").cast(pa.large_string()), "")
                ids, offsets, decoded, parity = codec.encode_checked(texts, own, threads)
                chosen = [i for i, x in enumerate(part.column("doc_id").to_pylist()) if codec.by_chunk and zlib.crc32(str(x).encode()) % verify_every == 0]
                for i, x in zip(chosen, own.encode(texts.take(pa.array(chosen, pa.int64())).to_pylist(), num_threads=threads) if chosen else [], strict=True):
                    parity[i] &= np.array_equal(ids[offsets[i] : offsets[i + 1]], x)
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([*part.columns, lists, pa.array(np.diff(offsets)), pc.equal(decoded, texts), pa.array(parity, pa.bool_())], names=[*names, *(f.name for f in added)])

    found = docs.mapInArrow(run, T.StructType([*docs.schema.fields, *added]))
    return unpack(found, columns, needed, *(F.col(f.name).alias(free_name(f.name, columns)) for f in added))


def decode_documents(encoded: DataFrame, model_path: str = MODEL, column: str = "ids") -> DataFrame:
    """``encoded`` with a column ``decoded`` (underscores before a name that is taken): the text of the ids (null: empty)."""
    with open(model_path, "rb") as f:
        shared = encoded.sparkSession.sparkContext.broadcast(f.read())
    names = [*encoded.columns, free_name("decoded", encoded.columns)]

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, _ = worker_codec(shared.value, 2)
        for batch in batches:
            ids = [x or [] for x in batch.column(column).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(codec.decode_ids(ids), pa.string())], names=names)

    return encoded.mapInArrow(run, T.StructType([*encoded.schema.fields, T.StructField(names[-1], T.StringType())]))
