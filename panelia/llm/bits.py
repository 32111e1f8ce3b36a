"""Bitmaps of hashes: a filter of fixed size, whatever the data; false positives only cost work."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def bitmap(frame: DataFrame, column: str, log2_bits: int) -> np.ndarray:
    """The bitmap of a column of 64-bit hashes, 2**log2_bits bits: leading bits choose the word, the last six the bit."""
    shift = 64 - (log2_bits - 6)
    places = frame.select(F.shiftrightunsigned(column, shift).alias("i"), F.expr(f"shiftleft(1L, cast({column} & 63 as int))").alias("b"))
    # at most 2**(log2_bits - 6) rows
    rows = places.groupBy("i").agg(F.bit_or("b").alias("b")).toArrow()
    out = np.zeros(1 << (log2_bits - 6), np.uint64)
    out[np.asarray(rows["i"])] = np.asarray(rows["b"]).view(np.uint64)
    return out


def maybe(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Whether each hash (uint64) may be in the bitmap."""
    shift = np.uint64(64 - int(len(bits)).bit_length() + 1)
    return ((bits[(hashes >> shift).astype(np.int64)] >> (hashes & np.uint64(63))) & np.uint64(1)).astype(bool)
