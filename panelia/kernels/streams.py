"""Random streams named by logical parts: draws depend on the names only, never on batches or workers."""

from __future__ import annotations

import json

import numpy as np


def seed_sequence(*parts) -> np.random.SeedSequence:
    """Entropy: the length and the little-endian 32-bit words of the parts' canonical JSON, zero-padded."""
    text = json.dumps(parts, sort_keys=True, separators=(",", ":"), allow_nan=False).encode()
    words = np.frombuffer(text.ljust(-(-len(text) // 4) * 4, b"\0"), "<u4")
    return np.random.SeedSequence([len(text), *map(int, words)])


def generator(*parts) -> np.random.Generator:
    return np.random.default_rng(seed_sequence(*parts))


def integer_seed(*parts) -> int:
    return int(seed_sequence(*parts).generate_state(1, np.uint32)[0])


def multiplicities(seed: int, stage: str, replicate: int, n: int) -> np.ndarray:
    """How often each of n people is drawn in a replicate."""
    return np.bincount(generator(seed, stage, replicate, "subject_multiplicity").integers(0, n, size=n), minlength=n)
