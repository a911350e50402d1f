"""Small estimators fitted inside a task on one community's weeks (NumPy)."""

from __future__ import annotations

import numpy as np


def newton_logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray, penalty: float, rounds: int = 50) -> tuple[np.ndarray, float]:
    """Weighted logistic regression, L2 on the slopes only."""
    n, k = x.shape
    d = np.hstack([x, np.ones((n, 1))])
    ridge = np.full(k + 1, penalty)
    ridge[-1] = 1e-9
    b = np.zeros(k + 1)

    def loss(v):
        z = d @ v
        return float(w @ (np.logaddexp(0.0, z) - y * z) + 0.5 * (ridge * v * v).sum())

    current = loss(b)
    for _ in range(rounds):
        p = 1.0 / (1.0 + np.exp(-np.clip(d @ b, -35, 35)))
        grad = d.T @ (w * (p - y)) + ridge * b
        hess = (d * (w * p * (1 - p))[:, None]).T @ d + np.diag(ridge + 1e-9)
        step, scale = np.linalg.solve(hess, grad), 1.0
        while scale > 1e-4 and loss(b - scale * step) > current:
            scale /= 2
        b = b - scale * step
        now = loss(b)
        if abs(current - now) < 1e-10 * (1 + abs(current)):
            break
        current = now
    return b[:-1], float(b[-1])


def scale_of(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    mean, std = x.mean(axis=0), x.std(axis=0)
    return mean, np.where(std > 1e-12, std, 1.0)


def fit_binary(x: np.ndarray, y: np.ndarray, l2: float = 1.0, cap: float = 8.0) -> tuple[np.ndarray, float]:
    """Coefficients on the raw features; positives weighted by min(negatives / positives, cap)."""
    mean, std = scale_of(x)
    n_pos = y.sum()
    w = np.where(y == 1, min((len(y) - n_pos) / n_pos, cap) if n_pos else 1.0, 1.0)
    coef, b = newton_logistic((x - mean) / std, y, w, l2)
    coef = coef / std
    return coef, b - float(coef @ mean)


def search_l2(x: np.ndarray, y: np.ndarray, grid: tuple[float, ...], splits: int = 3) -> float:
    """Penalty with the best mean recall over expanding time splits (needs more than 30 rows)."""
    if len(y) <= 30 or len(grid) < 2:
        return grid[0]
    size = len(y) // (splits + 1)
    best, best_score = grid[0], -1.0
    for l2 in grid:
        scores = []
        for i in range(1, splits + 1):
            end = len(y) - (splits - i + 1) * size
            tr, te = slice(0, end), slice(end, end + size)
            if 0 < y[tr].sum() < end and y[te].sum():
                coef, b = fit_binary(x[tr], y[tr], l2)
                scores.append(float(((x[te] @ coef + b) >= 0)[y[te] == 1].mean()))
        score = float(np.mean(scores)) if scores else 0.0
        if score > best_score:
            best, best_score = l2, score
    return best


def fit_classes(x: np.ndarray, y: np.ndarray, n_class: int = 4, l2: float = 1e-2, tolerance: float = 1e-4, rounds: int = 5000) -> tuple[np.ndarray, np.ndarray, bool]:
    """Softmax regression on min-max scaled inputs, classes weighted inversely to their count, and whether it converged.

    The loss is the weighted mean plus half of ``l2`` times the squared slopes.  Its curvature is at most half of the
    largest eigenvalue of the weighted second moments (with the intercept) plus ``l2``; steps of one over that, with
    momentum that begins anew whenever it points uphill, don't diverge.  Converged: no entry of the gradient is over
    ``tolerance``.
    """
    if not np.isfinite(x).all():
        raise ArithmeticError("inputs of a model must be finite")
    low, span = x.min(axis=0), np.ptp(x, axis=0)
    span = np.where(span > 0, span, 1.0)
    s = np.hstack([(x - low) / span - 0.5, np.ones((len(x), 1))])
    counts = np.bincount(y, minlength=n_class)
    seen = counts > 0
    weight = np.where(seen, len(y) / (n_class * np.maximum(counts, 1)), 0.0)
    w = weight[y] / weight[y].sum()
    target = np.eye(n_class)[y]
    ridge = np.full(s.shape[1], l2)
    ridge[-1] = 0.0
    step = 1.0 / (0.5 * np.linalg.norm(s * np.sqrt(w)[:, None], 2) ** 2 + l2)
    a = np.zeros((n_class, s.shape[1]))
    a[~seen, -1] = -20.0  # a class never seen is never predicted

    def gradient(a: np.ndarray) -> np.ndarray:
        z = s @ a.T
        p = np.exp(z - z.max(axis=1, keepdims=True))
        g = (p / p.sum(axis=1, keepdims=True) - target) * w[:, None]
        return (g.T @ s + ridge * a) * seen[:, None]

    ahead, t, converged = a, 1.0, False
    for _ in range(rounds):
        g = gradient(ahead)
        if np.abs(g).max() <= tolerance:
            a, converged = ahead, True
            break
        new = ahead - step * g
        if (g * (new - a)).sum() > 0:
            ahead, t = a, 1.0
            continue
        nt = (1 + (1 + 4 * t * t) ** 0.5) / 2
        ahead, a, t = new + (t - 1) / nt * (new - a), new, nt
    if not np.isfinite(a).all():
        raise ArithmeticError("the fit of a softmax model diverged")
    coef = a[:, :-1] / span
    return coef, a[:, -1] - coef @ (low + 0.5 * span), converged


def softmax(z: np.ndarray) -> np.ndarray:
    p = np.exp(z - z.max(axis=1, keepdims=True))
    return p / p.sum(axis=1, keepdims=True)


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[list[float], list[float]]:
    """Knots of the increasing least-squares fit (pool adjacent violators)."""
    xs, inv = np.unique(x, return_inverse=True)
    n = np.bincount(inv)
    blocks: list[list[float]] = []  # value, weight, first x, last x
    for v, m, k in zip(np.bincount(inv, y) / n, n, xs):
        blocks.append([float(v), float(m), float(k), float(k)])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v2, m2, _, last = blocks.pop()
            v1, m1, first, _ = blocks.pop()
            blocks.append([(v1 * m1 + v2 * m2) / (m1 + m2), m1 + m2, first, last])
    knots = [(k, b[0]) for b in blocks for k in dict.fromkeys((b[2], b[3]))]
    return [k for k, _ in knots], [min(1.0, max(0.0, v)) for _, v in knots]


def fit_calibrator(p: np.ndarray, y: np.ndarray, method: str = "platt", min_samples: int = 20, min_class: int = 3) -> dict:
    """Identity with too little support, else Platt (L2, C = 1) or isotonic."""
    base = {"type": "identity", "coef": 1.0, "intercept": 0.0, "x": [], "y": []}
    ok = np.isfinite(p) & np.isfinite(y)
    p, y = p[ok], y[ok]
    if len(p) < min_samples or min((y == 1).sum(), (y == 0).sum()) < min_class:
        return base
    if method == "isotonic":
        xs, ys = isotonic(p, y)
        return {**base, "type": "isotonic", "x": xs, "y": ys}
    coef, b = newton_logistic(p[:, None], y, np.ones(len(y)), 1.0)
    return {**base, "type": "platt", "coef": float(coef[0]), "intercept": b}


def calibrate(p: np.ndarray, cal: dict) -> np.ndarray:
    if cal["type"] == "platt":
        return 1.0 / (1.0 + np.exp(-(cal["coef"] * p + cal["intercept"])))
    if cal["type"] == "isotonic" and len(cal["x"]) >= 2:
        return np.interp(p, cal["x"], cal["y"])
    return np.clip(p, 0.0, 1.0)
