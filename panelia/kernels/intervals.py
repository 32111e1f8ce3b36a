"""Sequential rules on gaps between events: refractory spans, and an anchor that is lost at every flagged gap."""

from __future__ import annotations

import numpy as np

PLAUSIBLE, FLAGGED = "plausible", "flagged"


def refractory(events, distance: int, least_votes: int = 2) -> list[tuple[int, int]]:
    """(place, votes) in order; of those within ``distance`` of the last kept one the one with more votes stays."""
    kept: list[tuple[int, int]] = []
    for place, votes in sorted((int(p), int(v)) for p, v in events):
        if votes < least_votes:
            continue
        if not kept or place - kept[-1][0] >= distance:
            kept.append((place, votes))
        elif votes > kept[-1][1]:
            kept[-1] = (place, votes)
    return kept


def anchored(values, low: float, high: float, jump: float, reverse: bool = False) -> list[dict]:
    """Each gap is plausible if it is in range and close to the anchor, the plausible gap before it.

    A flagged gap takes the anchor away; the next gap in range becomes the anchor, and begins a new block.
    """
    values = np.asarray(values, float)
    out: list[dict] = [{} for _ in values]
    anchor, block, fresh = None, 0, True
    for i in reversed(range(len(values))) if reverse else range(len(values)):
        v = values[i]
        in_range = bool(low <= v <= high)
        relock = in_range and anchor is None and not fresh
        close = in_range and (anchor is None or abs(v - anchor) / max(anchor, 1e-30) <= jump)
        block += relock
        anchor = v if close else None
        out[i] = {"in_range": in_range, "close": bool(close), "status": PLAUSIBLE if close else FLAGGED, "block": block, "relock": relock}
        fresh = False
    return out


def gap_rows(events, rate: float, low: float = 0.3, high: float = 1.8, jump: float = 0.25, refractory_seconds: float = 0.2) -> list[dict]:
    """Gaps in seconds between refractory-filtered events, with what ``anchored`` says of each."""
    kept = refractory(events, max(1, round(refractory_seconds * rate)))
    places = np.array([p for p, _ in kept], float)
    gaps = np.diff(places) / rate
    return [{"start": float(places[i] / rate), "gap": float(gaps[i]), **row} for i, row in enumerate(anchored(gaps, low, high, jump))]


def gap_statistics(rows: list[dict]) -> dict:
    """Rate and RMSSD of plausible gaps; successive gaps count only inside one block."""
    ok = [r for r in rows if r["status"] == PLAUSIBLE]
    d = [b["gap"] - a["gap"] for a, b in zip(rows, rows[1:], strict=False) if a["status"] == b["status"] == PLAUSIBLE and a["block"] == b["block"]]
    return {
        "n_plausible": len(ok), "n_flagged": len(rows) - len(ok), "rate_per_minute": 60 / float(np.mean([r["gap"] for r in ok])) if ok else None,
        "n_pairs": len(d), "rmssd_ms": 1000 * float(np.sqrt(np.mean(np.square(d)))) if d else None,
    }


def normal_gaps(times, kinds, start: float, end: float, blocked=()) -> dict:
    """Mean, SD and RMSSD (ms) of gaps between normal beats inside a window and outside blocked spans."""
    t = np.asarray(times, float)
    if (np.diff(t) <= 0).any() or end <= start:
        raise ValueError("beats must increase, and the window must have a length")
    a, b = t[:-1], t[1:]
    inside = (a >= start) & (b < end)
    normal = np.array([x == y == "normal" for x, y in zip(kinds, kinds[1:], strict=False)], bool)
    clear = np.ones(len(a), bool)
    for lo, hi in blocked:
        clear &= ~((a < hi) & (b > lo))
    valid = inside & normal & clear
    gap = 1000 * (b - a)
    d = np.diff(gap)[valid[1:] & valid[:-1]]
    n = int(valid.sum())
    return {
        "n": n, "n_pairs": len(d), "fraction": n / int(inside.sum()) if inside.any() else None, "mean_ms": float(gap[valid].mean()) if n else None,
        "sd_ms": float(gap[valid].std(ddof=1)) if n > 1 else None, "rmssd_ms": float(np.sqrt(np.mean(d**2))) if len(d) else None,
    }
