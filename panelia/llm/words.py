"""Vectorised text primitives shared by the operators: words, 64-bit hashes, n-gram hashes.

Everything here works on one Arrow array at a time, so memory is bounded by the batch.  A null text
is an empty text.  White space is the ASCII set ``\\x20 \\x09-\\x0D`` and nothing else.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import SparkSession

#: Text bytes that a kernel handles at a time; longer single texts are handled whole.
SLICE_BYTES = 8 << 20
#: Strings of more bytes are hashed one by one.
LONG = 256
BASE = np.uint64(0x9E3779B97F4A7C15)


def bound_batches(spark: SparkSession, mb: int = 16) -> None:
    """Bound the Arrow batches that Python workers get, in bytes, since a text may be very long."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(mb << 20))


def release() -> None:
    """Give unused memory back to the system: workers live on, and their allocators would keep it."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def tidy(run: Callable) -> Callable:
    """A function of batches that releases memory after each of them."""

    @wraps(run)
    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def fed() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch
                del batch
                release()

        yield from run(fed())
        release()

    return tidied


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (multiply and xor-shift)."""
    x = x.astype(np.uint64, copy=True)
    with np.errstate(over="ignore"):
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
    return x


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive slices of a batch, each with at most ``limit`` bytes of text or one row.

    Slices are copies: some Arrow kernels read a slice that begins inside its buffers wrongly.
    """

    def copy(a: int, b: int) -> pa.RecordBatch:
        return batch if (a, b) == (0, batch.num_rows) else batch.take(pa.array(np.arange(a, b)))

    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0)).astype(np.int64)
    start, total = 0, 0
    for i, size in enumerate(sizes):
        if i > start and total + size > limit:
            yield copy(start, i)
            start, total = i, 0
        total += int(size)
    if batch.num_rows > start:
        yield copy(start, batch.num_rows)


def as_string(column: pa.Array) -> pa.Array:
    return pc.fill_null(column.cast(pa.large_string()), "")


def split_words(texts: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """The index of the text of every word, and the words, in order."""
    lists = pc.ascii_split_whitespace(as_string(texts))
    words = lists.flatten()
    owner = np.repeat(np.arange(len(lists), dtype=np.int32), np.asarray(pc.list_value_length(lists)))
    filled = np.asarray(pc.greater(pc.binary_length(words), 0))
    if not filled.all():
        words, owner = words.filter(pa.array(filled)), owner[filled]
    return owner, words


def encode(words: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Codes of the words in their dictionary, and the dictionary."""
    coded = words.dictionary_encode()
    return np.asarray(coded.indices), coded.dictionary


def hash_strings(strings: pa.Array, seed: int = 0) -> np.ndarray:
    """64-bit hashes, eight bytes of all strings at a time; strings of over ``LONG`` bytes one by one."""
    n = len(strings)
    if not n:
        return np.empty(0, np.uint64)
    raw = strings.cast(pa.large_binary())
    _, offsets, data = raw.buffers()
    offsets = np.frombuffer(offsets, np.int64)[raw.offset : raw.offset + n + 1]
    bytes_ = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data else np.empty(0, np.uint8)
    padded = np.concatenate([bytes_, np.zeros(8, np.uint8)])
    eights = np.ndarray(len(padded) - 7, "<u8", padded, strides=(1,))
    start, size = offsets[:-1] - offsets[0], np.diff(offsets)
    out = mix(size.astype(np.uint64) + (np.uint64(seed) << np.uint64(32)) + BASE)
    at, done = np.flatnonzero((size > 0) & (size <= LONG)), 0
    while len(at):
        left = size[at] - done
        chunk = eights[start[at] + done] & (~np.uint64(0) >> (64 - 8 * np.minimum(left, 8)).astype(np.uint64))
        with np.errstate(over="ignore"):
            out[at] = mix(out[at] * BASE + chunk)
        done += 8
        at = at[left > 8]
    for i in np.flatnonzero(size > LONG):
        out[i] = xxhash.xxh3_64_intdigest(bytes_[start[i] : start[i] + size[i]].tobytes(), seed)
    return out


def hash_words(words: pa.Array) -> np.ndarray:
    codes, dictionary = encode(words)
    return hash_strings(dictionary)[codes] if len(codes) else np.empty(0, np.uint64)


def ngram_hashes(hashes: np.ndarray, owner: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The start index and the 64-bit hash of every run of ``n`` words inside one text.

    The hash is a polynomial in the words' hashes modulo 2**64, shifted to a common degree and mixed.
    """
    if len(hashes) < n:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    start = np.flatnonzero(owner[: len(owner) - n + 1] == owner[n - 1 :])
    with np.errstate(over="ignore"):
        acc = np.zeros(len(start), np.uint64)
        for j in range(n):
            acc = acc * BASE + hashes[start + j]
    return start, mix(acc)


def combine(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The sums of the counts (second) by their keys (first)."""
    keys, n = (np.concatenate(c) for c in zip(*parts, strict=True))
    order = np.argsort(keys)
    keys, n = keys[order], n[order]
    new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.empty(0, np.int64)
    return keys[new], np.add.reduceat(n, new) if len(new) else n


def planes(x: np.ndarray) -> bytes:
    """Integers as compressed planes of their bytes, after their number."""
    raw = np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T).tobytes()
    return len(x).to_bytes(8, "little") + (pa.compress(raw, codec="zstd", asbytes=True) if raw else b"")


def unplanes(data: bytes, kind: type) -> np.ndarray:
    n, size = int.from_bytes(data[:8], "little"), np.dtype(kind).itemsize
    if not n:
        return np.empty(0, kind)
    raw = np.frombuffer(pa.decompress(data[8:], n * size, codec="zstd"), np.uint8)
    return np.ascontiguousarray(raw.reshape(size, n).T).view(kind).ravel()
