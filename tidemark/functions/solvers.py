"""Small dense programs over asset-by-asset statistics, in NumPy on the driver.

Every input is of the size of the assets, never of the rows, after Spark has reduced them."""

from __future__ import annotations

import numpy as np

from . import programs


def quadratic(h: np.ndarray, c: np.ndarray, a: np.ndarray, b: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray | None:
    """The x that minimises x'Hx/2 + c'x with Ax = b and low <= x <= high, H positive semidefinite; None if there is
    none. A primal active-set method from a feasible point, steps by the null space of the working set; it raises if it
    doesn't come to an end."""
    n = len(c)
    h = h + 1e-12 * max(1.0, float(np.trace(h)) / n) * np.eye(n)
    x = feasible(a, b, low, high)
    if x is None:
        return None
    work = np.zeros(n, int)  # -1 at its lower bound, 1 at its upper
    work[x <= low + 1e-12] = -1
    work[x >= high - 1e-12] = 1
    for _ in range(200 * n + 200):
        free = np.flatnonzero(work == 0)
        g = h @ x + c
        step = np.zeros(n)
        if len(free):
            af = a[:, free]
            kkt = np.block([[h[np.ix_(free, free)], af.T], [af, np.zeros((len(a), len(a)))]])
            step[free] = np.linalg.lstsq(kkt, np.concatenate([-g[free], np.zeros(len(a))]), rcond=None)[0][: len(free)]
        if np.abs(step).max(initial=0.0) < 1e-11:
            lam = np.linalg.lstsq(a[:, free].T, -g[free], rcond=None)[0] if len(free) else _multipliers(a, g, work)
            reduced = g + a.T @ lam
            wrong = np.where(work == -1, -reduced, np.where(work == 1, reduced, 0.0))
            worst = int(np.argmax(wrong))
            if wrong[worst] <= 1e-9 * max(1.0, float(np.abs(g).max())):
                return np.clip(x, low, high)
            work[worst] = 0
            continue
        room = np.full(n, np.inf)
        up, down = step > 1e-15, step < -1e-15
        room[up] = (high[up] - x[up]) / step[up]
        room[down] = (low[down] - x[down]) / step[down]
        k = int(np.argmin(room))
        if room[k] < 1:
            x = x + max(room[k], 0.0) * step
            work[k] = 1 if step[k] > 0 else -1
            x[k] = high[k] if step[k] > 0 else low[k]
        else:
            x = x + step
    raise ArithmeticError("the active-set method didn't settle")


def _multipliers(a: np.ndarray, g: np.ndarray, work: np.ndarray) -> np.ndarray:
    """For a vertex: multipliers that make the reduced gradient right at every bound, or nearest to it."""
    lam = np.zeros(len(a))
    for _ in range(500):
        wrong = np.where(work == -1, np.minimum(g + a.T @ lam, 0), np.maximum(g + a.T @ lam, 0))
        if np.abs(wrong).max() < 1e-12:
            break
        lam -= np.linalg.lstsq(a.T, wrong, rcond=None)[0]
    return lam


def feasible(a: np.ndarray, b: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray | None:
    """A point of Ax = b within bounds, or None: bounded least squares by active sets on |Ax - b|."""
    n = len(low)
    if (low > high + 1e-12).any():
        return None
    x = np.clip(np.full(n, 1.0 / n), low, high)
    work = np.zeros(n, bool)
    for _ in range(100 * n):
        free = np.flatnonzero(~work)
        gap = b - a @ x
        if np.abs(gap).max() < 1e-10:
            return x
        step = np.zeros(n)
        if len(free):
            step[free] = np.linalg.lstsq(a[:, free], gap, rcond=None)[0]
        if np.abs(step).max(initial=0.0) < 1e-13:
            g = a.T @ gap
            release = work & (((x <= low) & (g > 1e-12)) | ((x >= high) & (g < -1e-12)))
            if not release.any():
                return None
            work[int(np.argmax(np.where(release, np.abs(g), -1)))] = False
            continue
        up, down = step > 1e-15, step < -1e-15
        room = np.full(n, np.inf)
        room[up], room[down] = (high[up] - x[up]) / step[up], (low[down] - x[down]) / step[down]
        k = int(np.argmin(room))
        if room[k] < 1:
            x = x + max(room[k], 0.0) * step
            x[k] = high[k] if step[k] > 0 else low[k]
            work[k] = True
        else:
            x = x + step
    return x if np.abs(b - a @ x).max() < 1e-8 else None


def box(n: int, low: float, high: float) -> tuple[np.ndarray, np.ndarray]:
    return np.full(n, low), np.full(n, high)


def min_variance(sigma: np.ndarray, low: float = 0.0, high: float = 1.0, extra: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray | None:
    n = len(sigma)
    a, b = np.ones((1, n)), np.ones(1)
    if extra:
        a, b = np.vstack([a, extra[0]]), np.append(b, extra[1])
    return quadratic(sigma, np.zeros(n), a, b, *box(n, low, high))


def utility(mu: np.ndarray, sigma: np.ndarray, aversion: float, low: float = 0.0, high: float = 1.0) -> np.ndarray | None:
    n = len(mu)
    return quadratic(aversion * sigma, -mu, np.ones((1, n)), np.ones(1), *box(n, low, high))


def max_sharpe(mu: np.ndarray, sigma: np.ndarray, rf: float, low: float = 0.0, high: float = 1.0, extra: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray | None:
    """The weights of the greatest (mu'w - rf) / sqrt(w'Sw); None if no weights fit.

    Within bounds alone it is on the frontier's critical lines while some weights earn more than rf, and at a vertex, by
    branch and bound, where none do. With equalities it is one program in scaled weights; where none of those weights
    earn more than rf, the best of the peaks is taken that ascents from every asset and pair of assets reach: a search
    that random portfolios didn't beat in tests, not a proof."""
    n = len(mu)
    bounds = box(n, low, high)
    if extra is None or not len(extra[0]):
        found = programs.corners(mu, sigma, *bounds)
        if not found:
            return None
        if found[0].weights @ mu > rf:
            return programs.best_ratio(found, mu, sigma, rf)
        return programs.best_vertex(mu, sigma, rf, *bounds)[0]
    if (best := programs.max_sharpe(mu, sigma, rf, *bounds, extra)) is not None:
        return best
    safe = min_variance(sigma, low, high, extra)
    if safe is None:
        return None
    top = linear_max(mu, low, high, extra)
    ratio = lambda w: float((w @ mu - rf) / np.sqrt(max(w @ sigma @ w, 1e-18)))
    return max((_ascent(w, mu, sigma, rf, low, high, extra) for w in (safe, top, *_vertices(n, low, high, extra))), key=ratio)


def _vertices(n: int, low: float, high: float, extra: tuple[np.ndarray, np.ndarray]) -> list[np.ndarray]:
    """The weights that are greatest in each asset, and in each pair of assets."""
    goals = [np.eye(n)[i] + (np.eye(n)[j] if j != i else 0) * 0.999 for i in range(n) for j in range(n)]
    return [w for g in goals if (w := linear_max(g, low, high, extra)) is not None]


def _ascent(w: np.ndarray, mu: np.ndarray, sigma: np.ndarray, rf: float, low: float, high: float, extra: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """From w to a local peak of the ratio: along the line to the vertex that its slope points at, as far as it rises."""
    for _ in range(50):
        risk = float(np.sqrt(max(w @ sigma @ w, 1e-18)))
        slope = mu / risk - (w @ mu - rf) * (sigma @ w) / risk**3
        to = linear_max(slope, low, high, extra)
        if to is None or slope @ (to - w) <= 1e-12:
            return w
        steps = np.linspace(0, 1, 65)
        line = w + steps[:, None] * (to - w)
        values = (line @ mu - rf) / np.sqrt(np.maximum(np.einsum("ij,jk,ik->i", line, sigma, line), 1e-18))
        best = int(np.argmax(values))
        if best == 0:
            return w
        w = line[best]
    return w


def linear_max(mu: np.ndarray, low: float, high: float, extra: tuple[np.ndarray, np.ndarray] | None = None) -> np.ndarray | None:
    """The greatest mu'w with sum one, extra equalities and bounds: the quadratic program with a vanishing curvature."""
    n = len(mu)
    a, b = np.ones((1, n)), np.ones(1)
    if extra is not None and len(extra[0]):
        a, b = np.vstack([a, extra[0]]), np.append(b, extra[1])
    scale = max(float(np.abs(mu).max()), 1e-12)
    return quadratic(1e-9 * np.eye(n), -mu / scale, a, b, *box(n, low, high))


def risk_parity(sigma: np.ndarray, budget: np.ndarray | None = None) -> np.ndarray:
    """Weights whose risk shares are the budget (equal if none): coordinate descent on y'Sy/2 - sum b ln y."""
    n = len(sigma)
    b = np.full(n, 1.0 / n) if budget is None else np.asarray(budget, float) / np.sum(budget)
    y = 1 / np.sqrt(np.diag(sigma))
    for _ in range(2000):
        was = y.copy()
        for i in range(n):
            rest = sigma[i] @ y - sigma[i, i] * y[i]
            y[i] = (-rest + np.sqrt(rest * rest + 4 * sigma[i, i] * b[i])) / (2 * sigma[i, i])
        if np.abs(y - was).max() < 1e-14 * np.abs(y).max():
            break
    return y / y.sum()


def risk_shares(w: np.ndarray, sigma: np.ndarray) -> np.ndarray:
    return w * (sigma @ w) / (w @ sigma @ w)


def positive_definite(sigma: np.ndarray) -> np.ndarray:
    """sigma, its diagonal raised by 1.1 times the least eigenvalue's size if that is negative."""
    least = float(np.linalg.eigvalsh(sigma).min())
    return sigma + (1.1 * -least) * np.eye(len(sigma)) if least < 0 else sigma
