"""One-to-one matching of two increasing event trains, and runs of nearby events."""

from __future__ import annotations

import numpy as np


def increasing(*trains) -> list[np.ndarray]:
    out = [np.asarray(t, float) for t in trains]
    if any(not np.isfinite(t).all() or (np.diff(t) <= 0).any() for t in out):
        raise ValueError("event times must be finite and increase")
    return out


def optimal_match(a, b, tolerance: float) -> list[tuple[int, int]]:
    """Most matches within the tolerance, then least total error; matches never cross.

    One score holds both goals: a match is worth more than all errors together.  A row of the table is a running
    maximum, so that it takes one vector operation.
    """
    a, b = increasing(a, b)
    n, m = len(a), len(b)
    if tolerance < 0:
        raise ValueError("the tolerance must not be negative")
    if not n or not m:
        return []
    worth = 1.0 + tolerance * (min(n, m) + 1)
    table = np.zeros((n + 1, m + 1))
    for i in range(n):
        error = np.abs(a[i] - b)
        paired = np.where(error <= tolerance, table[i, :-1] + worth - error, -np.inf)
        table[i + 1, 1:] = np.maximum.accumulate(np.maximum(table[i, 1:], paired))
    pairs, i, j = [], n, m
    while i and j:
        if table[i, j] == table[i, j - 1]:
            j -= 1
        elif table[i, j] == table[i - 1, j]:
            i -= 1
        else:
            i, j = i - 1, j - 1
            pairs.append((i, j))
    return pairs[::-1]


def greedy_match(a, b, tolerance: float, slack: float = 1e-12, offset: float = 0.0) -> list[tuple[int, int]]:
    """The first feasible partner for each event in turn; maximal in number for one fixed offset."""
    a, b = increasing(a, b)
    pairs, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        gap = a[i] + offset - b[j]
        if abs(gap) <= tolerance + slack:
            pairs.append((i, j))
        i, j = i + (gap <= 0 or abs(gap) <= tolerance + slack), j + (gap > 0 or abs(gap) <= tolerance + slack)
    return pairs


def match_report(reference, candidates, tolerance: float) -> dict:
    """Counts and timing errors of the optimal matching."""
    pairs = optimal_match(reference, candidates, tolerance)
    n, m, k = len(reference), len(candidates), len(pairs)
    errors = [float(candidates[j] - reference[i]) for i, j in pairs]
    return {
        "tp": k, "fn": n - k, "fp": m - k,
        "sensitivity": k / n if n else None, "positive_predictive_value": k / m if m else None,
        "mean_absolute_error": float(np.mean(np.abs(errors))) if errors else None, "errors": errors, "pairs": pairs,
    }


def event_jaccard(a, b, tolerance: float) -> float:
    """Matched share of the union of two trains; 1 where both are empty."""
    k = len(greedy_match(a, b, tolerance, 0.0))
    union = len(a) + len(b) - k
    return k / union if union else 1.0


def audit_offsets(a, b, tolerance: float, near: float = 0.0) -> dict:
    """The constant clock offset with the most matches, then the least residual, then the least size.

    Offsets are tried where the set of feasible pairs can change, and between those places.  ``ambiguous``: another
    offset matches as many events but other ones, with a residual that is at most ``near`` greater.
    """
    a, b = increasing(a, b)
    if not len(a) or not len(b):
        return {"status": "missing_events", "offset": None, "matches": 0, "residual": None, "ambiguous": False}
    gaps = (b[None, :] - a[:, None]).ravel()
    edges = np.unique(np.concatenate([gaps - tolerance, gaps + tolerance]))
    found: dict[tuple, tuple] = {}
    for seed in np.concatenate([edges, (edges[1:] + edges[:-1]) / 2]):
        pairs = greedy_match(a, b, tolerance, 1e-9, seed)
        if not pairs:
            continue
        offset = float(np.median([b[j] - a[i] for i, j in pairs]))
        again = greedy_match(a, b, tolerance, 1e-9, offset)
        pairs, offset = (again, offset) if len(again) >= len(pairs) else (pairs, float(seed))
        residual = max(abs(b[j] - a[i] - offset) for i, j in pairs)
        key = tuple(pairs)
        if key not in found or residual < found[key][1]:
            found[key] = (-len(pairs), residual, abs(offset), offset)
    ranked = sorted(found.values())
    best = ranked[0]
    return {"status": "ranked", "offset": best[3], "matches": -best[0], "residual": best[1], "ambiguous": any(r[0] == best[0] and r[1] <= best[1] + near for r in ranked[1:])}


def cluster_from_first(times, span: float) -> np.ndarray:
    """A number for each event; a cluster holds what lies within ``span`` of its first event (it doesn't chain)."""
    (t,) = increasing(times)
    label, start, out = -1, -np.inf, np.empty(len(t), np.int64)
    for i, x in enumerate(t):
        if x - start > span:
            label, start = label + 1, x
        out[i] = label
    return out


def vote_clusters(leads: list, span: int) -> list[tuple[int, int]]:
    """(place, votes): detections of several leads grouped from the first, one vote a lead, median place.

    Of several detections of a lead in a group the one nearest to the group's median counts.
    """
    items = sorted((int(p), lead) for lead, peaks in enumerate(leads) for p in peaks)
    out, i = [], 0
    while i < len(items):
        j = i
        while j < len(items) and items[j][0] - items[i][0] <= span:
            j += 1
        group = items[i:j]
        middle = float(np.median([p for p, _ in group]))
        chosen = {}
        for p, lead in group:
            if lead not in chosen or abs(p - middle) < abs(chosen[lead] - middle):
                chosen[lead] = p
        out.append((int(round(np.median(list(chosen.values())))), len(chosen)))
        i = j
    return out


def strongest_apart(places, scores, distance: int) -> np.ndarray:
    """Places kept by falling score (earlier first on ties), each at least ``distance`` from those kept before."""
    kept: list[int] = []
    for p in sorted(np.unique(np.asarray(places, np.int64)).tolist(), key=lambda q: (-scores[q], q)):
        if all(abs(p - q) >= distance for q in kept):
            kept.append(p)
    return np.array(sorted(kept), np.int64)
