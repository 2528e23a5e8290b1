"""Dense numeric kernels in NumPy, called on groups from Arrow."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd

#: Bandwidth of the one-dimensional density.
H = 0.5
#: Numbers of a block of a kernel matrix.
CELLS = 4 << 20


def log_density(x: np.ndarray, data: np.ndarray, h: float = H) -> np.ndarray:
    """Log of the Gaussian kernel density of each column of data at x (points by dimensions), dimension by dimension, in blocks of both."""
    out = np.empty(x.shape)
    rows, cols = 64, max(1, CELLS // (64 * x.shape[1]))
    for i in range(0, len(x), rows):
        own = x[i : i + rows, None, :]
        top, total = np.full((own.shape[0], x.shape[1]), -np.inf), np.zeros((own.shape[0], x.shape[1]))
        for j in range(0, len(data), cols):
            z = -((own - data[None, j : j + cols, :]) ** 2) / (2 * h * h)
            higher = np.maximum(top, z.max(axis=1))
            total = total * np.exp(top - higher) + np.exp(z - higher[:, None, :]).sum(axis=1)
            top = higher
        out[i : i + rows] = np.log(total) + top
    return out - np.log(len(data) * h * np.sqrt(2 * np.pi))


def rbf_rows(x: np.ndarray, y: np.ndarray, gamma: float) -> np.ndarray:
    """For each x the sum of the kernel over y, in blocks."""
    out = np.zeros(len(x))
    rows = max(1, CELLS // max(1, len(y)))
    for i in range(0, len(x), rows):
        out[i : i + rows] = np.exp(-gamma * _squares(x[i : i + rows], y)).sum(axis=1)
    return out


def rbf_sum(x: np.ndarray, y: np.ndarray, gamma: float) -> float:
    return float(rbf_rows(x, y, gamma).sum())


def rbf_mean(x: np.ndarray, y: np.ndarray, gamma: float) -> float:
    return rbf_sum(x, y, gamma) / (len(x) * len(y))


def _squares(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * x @ y.T, 0)


def mmd(x: np.ndarray, y: np.ndarray, gamma: float | None = None) -> float:
    """Squared maximum mean discrepancy, biased: diagonals count. gamma defaults to 1 over the dimension."""
    g = gamma if gamma is not None else 1 / x.shape[1]
    return rbf_mean(x, x, g) + rbf_mean(y, y, g) - 2 * rbf_mean(x, y, g)


def silverman2(points: np.ndarray) -> float:
    """Bandwidth of a joint density: 1.06 times the mean over columns of the lesser of std and IQR/1.34, times n**-0.2; 1 below 5 points; 1e-3 at least."""
    n = len(points)
    if n < 5:
        return 1.0
    std = points.std(axis=0, ddof=1)
    q = np.percentile(points, [25, 75], axis=0)
    return max(1.06 * float(np.minimum(std, (q[1] - q[0]) / 1.34).mean()) * n**-0.2, 1e-3)


def _halves(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    lr = np.stack(rows["lr"].to_numpy()).astype(float)
    d = lr.shape[1] // 2
    return lr[:, :d], lr[:, d:]


def kde_gain(own: tuple, goal: tuple, cand: tuple) -> np.ndarray:
    """Mean over dimensions of the rise in the goal pairs' log-density at the training singletons' mean when a donor's two singletons join."""
    data = (goal[0] + goal[1]) / 2
    total, n = (own[0] + own[1]).sum(axis=0), 2 * len(own[0])
    before = log_density((total / n)[None, :], data)[0]
    out = np.empty(len(cand[0]))
    for i in range(0, len(out), 256):
        moved = (total + cand[0][i : i + 256] + cand[1][i : i + 256]) / (n + 2)
        out[i : i + 256] = (log_density(moved, data) - before).mean(axis=1)
    return out


def mmd_gain(own: tuple, goal: tuple, cand: tuple) -> np.ndarray:
    """Fall of the discrepancy between training singletons and goal pairs when a donor's two singletons join: only sums of kernel rows change."""
    data = (goal[0] + goal[1]) / 2
    train = np.concatenate(own)
    g, n, m = 1 / data.shape[1], len(train), len(data)
    xx, xy, yy = rbf_sum(train, train, g), rbf_sum(train, data, g), rbf_mean(data, data, g)
    before = xx / n**2 + yy - 2 * xy / (n * m)
    a, b = cand
    across = np.exp(-g * np.maximum(((a - b) ** 2).sum(1), 0))
    new_xx = xx + 2 * (rbf_rows(a, train, g) + rbf_rows(b, train, g)) + 2 + 2 * across
    new_xy = xy + rbf_rows(a, data, g) + rbf_rows(b, data, g)
    return before - (new_xx / (n + 2) ** 2 + yy - 2 * new_xy / ((n + 2) * m))


def _principal(x: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    mean = x.mean(axis=0)
    _, _, vt = np.linalg.svd(x - mean, full_matrices=False)
    v = vt[:k]
    sign = np.sign(v[np.arange(len(v)), np.abs(v).argmax(axis=1)])
    return mean, v * sign[:, None]


def kde2d_density(own: tuple, goal: tuple, cand: tuple) -> np.ndarray:
    """Log-density of donors' pair vectors under the goal pairs' joint density in their first two principal components."""
    data, x = (goal[0] + goal[1]) / 2, (cand[0] + cand[1]) / 2
    for k in (20, 2):
        mean, v = _principal(data, min(k, *data.shape))
        data, x = (data - mean) @ v.T, (x - mean) @ v.T
    h = silverman2(data)
    out = np.empty(len(x))
    rows = max(1, CELLS // len(data))
    for i in range(0, len(x), rows):
        z = -_squares(x[i : i + rows], data) / (2 * h * h)
        top = z.max(axis=1)
        out[i : i + rows] = np.log(np.exp(z - top[:, None]).sum(axis=1)) + top
    return out - np.log(len(data) * 2 * np.pi * h * h)


def score_block(context: pd.DataFrame, cand: pd.DataFrame, kernel) -> pd.DataFrame:
    """target, donor, pair_idx, score: minus the kernel's value, so that smaller is better. Without goal pairs nothing is scored."""
    own, goal = context[context["kind"] == "own"], context[context["kind"] == "goal"]
    if not (len(own) and len(goal) and len(cand)):
        return pd.DataFrame({"target": [], "donor": [], "pair_idx": [], "score": []})
    order = lambda df: df.sort_values("place")
    value = kernel(_halves(order(own)), _halves(order(goal)), _halves(cand))
    return pd.DataFrame({"target": cand["target"], "donor": cand["donor"], "pair_idx": cand["pair_idx"], "score": -value})


def farthest_first(rows: pd.DataFrame, budget: int) -> pd.DataFrame:
    """Of rows with donor >= 0, those picked one after the other as farthest (by 1 - dot) from centers (donor -1) and picks before; score is the pick's number."""
    centers = rows[rows["donor"] < 0]
    cand = rows[rows["donor"] >= 0].sort_values(["donor", "pair_idx"])
    k = min(len(cand), max(0, budget - int(rows["own_n"].iloc[0])))
    if k == 0 or not len(cand):
        return cand.iloc[:0].assign(score=pd.Series(dtype=float))[["target", "donor", "pair_idx", "score", "v", "own_n"]]
    x = np.stack(cand["v"].to_numpy()).astype(float)
    near = np.full(len(x), np.inf)
    c = np.stack(centers["v"].to_numpy()).astype(float) if len(centers) else np.zeros((0, x.shape[1]))
    for i in range(0, len(c), 8192):
        near = np.minimum(near, (1 - x @ c[i : i + 8192].T).min(axis=1))
    picks = []
    for _ in range(k):
        i = int(np.round(near, 9).argmax())
        picks.append(i)
        near = np.minimum(near, 1 - x @ x[i])
        near[picks] = -1.0
    out = cand.iloc[picks].assign(score=np.arange(len(picks), dtype=float))
    return out[["target", "donor", "pair_idx", "score", "v", "own_n"]]


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    near = np.full(len(x), np.inf)
    for i in range(0, len(c), 8192):
        near = np.minimum(near, (1 - x @ c[i : i + 8192].T).min(axis=1))
    return near


def farthest(centers: dict[int, np.ndarray], picked: dict[int, set], keep: int):
    """A mapInPandas function over domain, pair_idx, v: each target's `keep` rows of other domains that are farthest from its centers and not picked."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best: dict[int, pd.DataFrame] = {}
        for rows in batches:
            if not len(rows):
                continue
            x = np.stack(rows["v"].to_numpy()).astype(float)
            for t, c in centers.items():
                other = (rows["domain"] != t).to_numpy()
                if picked[t]:
                    other &= np.array([key not in picked[t] for key in zip(rows["domain"], rows["pair_idx"], strict=True)])
                own = rows[other]
                near = _nearest(x[other], c)
                own = pd.DataFrame({"target": t, "donor": own["domain"], "pair_idx": own["pair_idx"], "far": np.round(near, 9), "near": near, "v": own["v"]})
                both = pd.concat([best[t], own]) if t in best else own
                best[t] = both.sort_values(["far", "donor", "pair_idx"], ascending=[False, True, True]).head(keep)
        yield from (b for b in best.values() if len(b))

    return run


def picks_before(rows: pd.DataFrame, pool: int, most: int) -> list[int]:
    """Places of the farthest-first picks among the first `pool` rows, as long as they come before the row after these, if there is one."""
    key = lambda i, far: (-far, rows["donor"].iloc[i], rows["pair_idx"].iloc[i])
    bound = key(pool, rows["far"].iloc[pool]) if len(rows) > pool else None
    x, near = np.stack(rows["v"].iloc[:pool].to_numpy()).astype(float), rows["near"].to_numpy()[:pool].copy()
    places = np.lexsort((rows["pair_idx"].to_numpy()[:pool], rows["donor"].to_numpy()[:pool]))
    x, near = x[places], near[places]
    picks: list[int] = []
    while len(picks) < min(most, len(x)):
        far = np.round(near, 9)
        far[picks] = -2.0
        i = int(far.argmax())
        if bound is not None and key(int(places[i]), far[i]) > bound:
            break
        picks.append(i)
        near = np.minimum(near, 1 - x @ x[i])
    return [int(places[i]) for i in picks]
