"""Media columns: a text's bytes as 8-bit audio, with log-mel features and energy segments.

The UTF-8 bytes of a text (null: empty), padded with bytes 255 to a positive multiple of 576, are the
samples of an unsigned 8-bit mono WAV file.  The file's bytes are the media column; features come from the
samples that are read back out of it:

* polyphase resampling by 1/2 with a windowed-sinc filter (one branch of the filter per input phase),
* log-mel filterbanks over frames of 256 resampled samples, 128 apart,
* energy segments by hysteresis: a segment opens at or above ``OPEN`` and lasts until the level, in dB over the
  median frame, falls below ``CLOSE``.

Frames of a recording are dealt into tensors of a fixed shape (FRAMES x MELS, zero-padded, with the number of
real frames) that carry their time span; ``tensors`` returns them in long form, one row per tensor, as bytes
that ``tensor_array`` reads as an Arrow fixed-shape tensor array.

Memory: one recording at a time, its frames in blocks of ``BLOCK``.  Nothing is shuffled.  Equal texts give
equal values: every recording is computed by itself.  Repeated ids are recordings of their own; other columns
are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .words import bound_batches, slices, tidy

UNIT = 576
RATE_IN, RATE_OUT, DOWN = 16_000, 8_000, 2
FRAME, HOP, MELS, FRAMES, TAPS = 256, 128, 24, 64, 16
OPEN, CLOSE = 3.0, 0.5
BLOCK = 1 << 12
HEADER = struct.Struct("<4sI4s4sIHHIIHH4sI")


def pad(data: bytes) -> bytes:
    return data + b"\xff" * (-len(data) % UNIT if data else UNIT)


def write_wav(samples: bytes) -> bytes:
    """An unsigned 8-bit mono WAV file."""
    return HEADER.pack(b"RIFF", 36 + len(samples), b"WAVE", b"fmt ", 16, 1, 1, RATE_IN, RATE_IN, 1, 8, b"data", len(samples)) + samples


def read_wav(media: bytes) -> bytes:
    fields = HEADER.unpack_from(media)
    if fields[0] != b"RIFF" or fields[2] != b"WAVE" or fields[10] != 8 or fields[12] != len(media) - HEADER.size:
        raise ValueError("not an 8-bit WAV file of this module")
    return media[HEADER.size :]


@cache
def filters() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The resampling filter by phase (DOWN x TAPS), the frame window, the mel filterbank."""
    n = TAPS * DOWN
    t = np.arange(n) - (n - 1) / 2
    h = np.sinc(t / DOWN) / DOWN * np.hamming(n)
    phases = (h / h.sum()).reshape(TAPS, DOWN).T.astype(np.float32)
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(mel(60), mel(RATE_OUT / 2), MELS + 2) / 2595) - 1)
    f = np.fft.rfftfreq(FRAME, 1 / RATE_OUT)
    up = (f[:, None] - edges[:-2]) / (edges[1:-1] - edges[:-2])
    down = (edges[2:] - f[:, None]) / (edges[2:] - edges[1:-1])
    return phases, np.hanning(FRAME).astype(np.float32), np.maximum(0, np.minimum(up, down)).astype(np.float32)


def resample(samples: np.ndarray) -> np.ndarray:
    """Polyphase decimation by DOWN; as many outputs as whole groups of DOWN samples."""
    phases = filters()[0]
    n = len(samples) // DOWN
    left = TAPS // 2
    by_phase = np.zeros((DOWN, n + TAPS), np.float32)
    by_phase[:, left : left + n] = samples[: n * DOWN].reshape(n, DOWN).T
    out = np.zeros(n, np.float32)
    for p in range(DOWN):
        out += np.convolve(by_phase[p], phases[p, ::-1], "valid")[:n]
    return out


def log_mel(signal: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log-mel energies (frames x MELS) and the level of each frame in dB."""
    _, window, bank = filters()
    # the last hop is filled up, so that every sample is in a frame
    signal = np.pad(signal, (0, FRAME - len(signal) if len(signal) < FRAME else -(len(signal) - FRAME) % HOP))
    frames = np.lib.stride_tricks.sliding_window_view(signal, FRAME)[::HOP]
    mels, level = np.empty((len(frames), MELS), np.float32), np.empty(len(frames), np.float32)
    for i in range(0, len(frames), BLOCK):
        block = frames[i : i + BLOCK] * window
        spectrum = np.fft.rfft(block, axis=1)
        power = (spectrum.real**2 + spectrum.imag**2).astype(np.float32)
        mels[i : i + BLOCK] = np.log(power @ bank + 1e-6)
        level[i : i + BLOCK] = 10 * np.log10((block**2).mean(1) + 1e-9)
    return mels, level


def segments(level: np.ndarray) -> list[tuple[int, int]]:
    """Hysteresis: frames [start, end) from a level of OPEN over the median until it falls below CLOSE."""
    over = level - np.median(level)
    state = np.where(over >= OPEN, 1, np.where(over < CLOSE, -1, 0))
    known = np.maximum.accumulate(np.where(state != 0, np.arange(len(state)), -1))
    active = np.concatenate([[0], np.where(known >= 0, state[known] > 0, False).astype(np.int8), [0]])
    edge = np.flatnonzero(np.diff(active))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def features(payload: bytes) -> tuple[np.ndarray, list[tuple[float, float]]]:
    """The log-mel frames of the samples and the segments' time spans in seconds."""
    signal = resample((np.frombuffer(payload, np.uint8).astype(np.float32) - 128) / 128)
    mels, level = log_mel(signal)
    return mels, [(a * HOP / RATE_OUT, min((b - 1) * HOP + FRAME, len(signal)) / RATE_OUT) for a, b in segments(level)]


def summary(mels: np.ndarray, spans: list[tuple[float, float]]) -> str:
    """Frames, mean log-mel energy of four bands of the filterbank, number of segments and their seconds."""
    bands = mels.mean(0, dtype=np.float64).reshape(4, -1).mean(1)
    return f"frames={len(mels)};mel={','.join(f'{x:.3f}' for x in bands)};segments={len(spans)};seconds={sum(b - a for a, b in spans):.3f}"


def stored_rows(doc_id, text: str | None) -> Iterator[tuple]:
    """The rows of a recording: doc_id, chunk, media, tensor, n_frames, start_s, end_s, segments."""
    media = write_wav(pad((text or "").encode()))
    payload = read_wav(media)
    mels, spans = features(payload)
    end = len(payload) // DOWN / RATE_OUT
    for k in range(0, len(mels), FRAMES):
        part = mels[k : k + FRAMES]
        full = np.zeros((FRAMES, MELS), np.float32)
        full[: len(part)] = part
        chunk, start, following = k // FRAMES, k * HOP / RATE_OUT, (k + FRAMES) * HOP / RATE_OUT
        inside = [{"start_s": a, "end_s": b} for a, b in spans if start <= a < following]
        yield doc_id, chunk, media if chunk == 0 else None, full.tobytes(), len(part), start, min(((k + len(part) - 1) * HOP + FRAME) / RATE_OUT, end), inside


def digest(text: str | None) -> tuple:
    """What the stored rows of a text hold, read back: the media, the frames of the Arrow tensors, the spans."""
    rows = list(stored_rows(None, text))
    media = rows[0][2]
    payload = read_wav(media)
    frames = tensor_array(pa.array([r[3] for r in rows], pa.binary())).to_numpy_ndarray()
    mels = np.concatenate([f[: r[4]] for f, r in zip(frames, rows, strict=True)])
    spans = [(x["start_s"], x["end_s"]) for r in rows for x in r[7]]
    return len((text or "").encode()), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(media), hashlib.sha256(media).hexdigest(), summary(mels, spans)


DIGEST = pa.schema(
    [("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())]
)


def media_digest(docs: DataFrame) -> DataFrame:
    """doc_id and what was stored, read back and computed for every document."""
    bound_batches(docs.sparkSession)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                columns = list(zip(*map(digest, part.column("text").to_pylist()), strict=True)) or [()] * len(DIGEST)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(c, f.type) for c, f in zip(columns, DIGEST, strict=True))], names=["doc_id", *DIGEST.names])

    kept = docs.select("doc_id", "text")
    kind = kept.schema["doc_id"].dataType.simpleString()
    return kept.mapInArrow(run, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def tensor_array(blobs: pa.Array) -> pa.Array:
    """Tensors of ``tensors`` (float32 bytes) as an Arrow fixed-shape tensor array."""
    flat = np.frombuffer(b"".join(blobs.to_pylist()), np.float32).reshape(-1, FRAMES, MELS)
    return pa.FixedShapeTensorArray.from_numpy_ndarray(np.ascontiguousarray(flat))


def tensors(docs: DataFrame) -> DataFrame:
    """Media and features: doc_id, chunk, media (in chunk 0 only), tensor, n_frames, start_s, end_s, segments.

    ``tensor`` holds FRAMES x MELS float32 values, ``segments`` the spans that begin in this chunk.
    """
    bound_batches(docs.sparkSession)
    spans_type = pa.list_(pa.struct([("start_s", pa.float64()), ("end_s", pa.float64())]))

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, limit=1 << 20):
                ids = part.column("doc_id")
                out = [r for i, t in zip(ids.to_pylist(), part.column("text").to_pylist(), strict=True) for r in stored_rows(i, t)]
                if out:
                    types = [ids.type, pa.int32(), pa.binary(), pa.binary(), pa.int32(), pa.float64(), pa.float64(), spans_type]
                    names = ["doc_id", "chunk", "media", "tensor", "n_frames", "start_s", "end_s", "segments"]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    kept = docs.select("doc_id", "text")
    kind = kept.schema["doc_id"].dataType.simpleString()
    return kept.mapInArrow(run, f"doc_id {kind}, chunk int, media binary, tensor binary, n_frames int, start_s double, end_s double, segments array<struct<start_s: double, end_s: double>>")
