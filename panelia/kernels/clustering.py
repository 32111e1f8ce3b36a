"""Clustering of short complete curves, agreement of partitions, shapelets."""

from __future__ import annotations

from itertools import permutations

import numpy as np


def dtw_to(x: np.ndarray, y: np.ndarray, radius: int = 2) -> np.ndarray:
    """Dynamic-time-warping distances (squared cost, band of ``radius``, square root) of the rows of x to those of y.

    Two rows of the table of partial costs are held, each of as many cells as the band has.
    """
    x, y = np.asarray(x, float), np.asarray(y, float)
    m, shape = x.shape[1], (len(x), len(y))
    before = {0: np.zeros(shape)}
    for i in range(1, m + 1):
        now: dict[int, np.ndarray] = {}
        for j in range(max(1, i - radius), min(m, i + radius) + 1):
            cost = x[:, None, i - 1] - y[None, :, j - 1]
            cost *= cost
            ways = [w for w in (before.get(j), now.get(j - 1), before.get(j - 1)) if w is not None]
            least = ways[0] if len(ways) == 1 else np.minimum(ways[0], ways[1])
            cost += np.minimum(least, ways[2], out=least) if len(ways) == 3 else least
            now[j] = cost
        before = now
    return np.sqrt(before[m])


def dtw_matrix(x: np.ndarray, radius: int = 2) -> np.ndarray:
    """The distances of ``dtw_to`` of all pairs of rows."""
    return dtw_to(x, x, radius)


def dtw(a, b, radius: int = 2) -> float:
    return float(dtw_matrix(np.array([a, b], float), radius)[0, 1])


def medoids(distance: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 50) -> tuple[np.ndarray, np.ndarray]:
    """k medoids from a farthest-first start, and the labels."""
    chosen = [int(rng.integers(len(distance)))]
    while len(chosen) < k:
        far = distance[:, chosen].min(1)
        far[chosen] = -1
        chosen.append(int(far.argmax()))
    for _ in range(rounds):
        labels = distance[:, chosen].argmin(1)
        new = []
        for c in range(k):
            own = np.flatnonzero(labels == c)
            new.append(int(own[distance[np.ix_(own, own)].sum(1).argmin()]) if len(own) else chosen[c])
        if new == chosen:
            break
        chosen = new
    return np.array(chosen), distance[:, chosen].argmin(1)


def squared(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return ((x[:, None] - centres[None]) ** 2).sum(2)


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator, starts: int = 5, rounds: int = 300) -> tuple[np.ndarray, np.ndarray]:
    """Centres and labels of the best of several k-means++ starts."""
    x = np.asarray(x, float)
    best = None
    for _ in range(starts):
        centres = x[[int(rng.integers(len(x)))]]
        while len(centres) < k:
            d = squared(x, centres).min(1)
            centres = np.vstack([centres, x[rng.choice(len(x), p=d / d.sum() if d.sum() else None)]])
        for _ in range(rounds):
            labels = squared(x, centres).argmin(1)
            new = np.array([x[labels == c].mean(0) if (labels == c).any() else centres[c] for c in range(k)])
            if np.allclose(new, centres, atol=1e-10):
                break
            centres = new
        inertia = squared(x, centres).min(1).sum()
        if best is None or inertia < best[0]:
            best = inertia, centres
    return best[1], squared(x, best[1]).argmin(1)


def memberships(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Fuzzy memberships for fuzzifier 2."""
    u = 1 / np.maximum(squared(np.asarray(x, float), centres), 1e-24)
    return u / u.sum(1, keepdims=True)


def fuzzy(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 150) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fuzzy c-means from k-means centres: centres, labels, memberships."""
    x = np.asarray(x, float)
    centres, _ = kmeans(x, k, rng)
    for _ in range(rounds):
        w = memberships(x, centres) ** 2
        new = w.T @ x / w.sum(0)[:, None]
        done = np.abs(new - centres).max() < 1e-6
        centres = new
        if done:
            break
    u = memberships(x, centres)
    return centres, u.argmax(1), u


def adjusted_rand(a, b) -> float:
    """Agreement of two partitions beyond chance."""
    table = np.zeros((max(a) + 1, max(b) + 1))
    np.add.at(table, (np.asarray(a), np.asarray(b)), 1)
    pairs = lambda n: n * (n - 1) / 2
    both, rows, columns, every = pairs(table).sum(), pairs(table.sum(1)).sum(), pairs(table.sum(0)).sum(), pairs(table.sum())
    chance, top = rows * columns / every if every else 0.0, (rows + columns) / 2
    return 1.0 if top == chance else float((both - chance) / (top - chance))


def matched_jaccard(a, b, k: int) -> float:
    """Mean Jaccard index of classes under the best one-to-one naming (k is small)."""
    table = np.zeros((k, k))
    np.add.at(table, (np.asarray(a), np.asarray(b)), 1)
    union = table.sum(1)[:, None] + table.sum(0)[None] - table
    share = np.divide(table, union, out=np.zeros((k, k)), where=union > 0)
    return float(max(share[range(k), p].mean() for p in permutations(range(k))))


def membership_entropy(u: np.ndarray) -> float:
    return float(-(u * np.log(np.maximum(u, np.finfo(float).tiny))).sum(1).mean())


def shapelet_distances(x: np.ndarray, shapelets: np.ndarray) -> np.ndarray:
    """The least mean squared distance of each shapelet to a run of consecutive values of each row."""
    x, shapelets = np.asarray(x, float), np.asarray(shapelets, float)
    if not np.isfinite(x).all() or not np.isfinite(shapelets).all() or shapelets.shape[1] > x.shape[1]:
        raise ValueError("values must be finite, and shapelets no longer than the rows")
    runs = np.lib.stride_tricks.sliding_window_view(x, shapelets.shape[1], axis=1)
    return np.stack([((runs - s) ** 2).mean(2).min(1) for s in shapelets], 1)


def select_shapelets(x: np.ndarray, labels: np.ndarray, length: int, most: int, rng: np.random.Generator) -> tuple[np.ndarray, list[dict]]:
    """For each class the sampled training run that tells it apart best (squared mean gap over summed variances)."""
    x, labels = np.asarray(x, float), np.asarray(labels)
    out, notes = [], []
    for c in np.unique(labels):
        places = [(r, s) for r in np.flatnonzero(labels == c) for s in range(x.shape[1] - length + 1)]
        taken = [places[i] for i in rng.choice(len(places), min(most, len(places)), replace=False)]
        runs = np.array([x[r, s : s + length] for r, s in taken])
        d = shapelet_distances(x, runs)
        own, other = d[labels == c], d[labels != c]
        contrast = (own.mean(0) - other.mean(0)) ** 2 / (own.var(0) + other.var(0) + 1e-12)
        best = int(contrast.argmax())
        out.append(runs[best])
        notes.append({"row": int(taken[best][0]), "start": int(taken[best][1]), "label": int(c), "contrast": float(contrast[best])})
    return np.array(out), notes


def classifier_metrics(truth, predicted, k: int) -> dict[str, float]:
    """Accuracy, balanced accuracy over the classes that occur, macro F1 over all k (0 where undefined)."""
    table = np.zeros((k, k))
    np.add.at(table, (np.asarray(truth), np.asarray(predicted)), 1)
    hit, real, said = np.diag(table), table.sum(1), table.sum(0)
    f1 = np.divide(2 * hit, real + said, out=np.zeros(k), where=real + said > 0)
    return {"accuracy": float(hit.sum() / table.sum()), "balanced_accuracy": float((hit / np.maximum(real, 1))[real > 0].mean()), "macro_f1": float(f1.mean())}
