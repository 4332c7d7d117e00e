"""Quadratic programs with inequalities, whole frontiers by critical lines, and ratios where no asset beats cash.

All sizes are of assets and limits; Spark has reduced the rows before."""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field

import numpy as np

Rows = tuple[np.ndarray, np.ndarray]


@dataclass
class Solved:
    """The point, or None with a proof that there is none: multipliers whose combination of the limits says 0 <= -1."""

    x: np.ndarray | None
    #: Of the inequalities (rows @ x <= values, then lower, then upper bounds), not negative.
    below: np.ndarray = field(default_factory=lambda: np.zeros(0))
    low: np.ndarray = field(default_factory=lambda: np.zeros(0))
    high: np.ndarray = field(default_factory=lambda: np.zeros(0))
    #: Of the equalities.
    equal: np.ndarray = field(default_factory=lambda: np.zeros(0))


def _none(n: int) -> Rows:
    return np.zeros((0, n)), np.zeros(0)


def program(h: np.ndarray, c: np.ndarray, equal: Rows | None = None, below: Rows | None = None, low: np.ndarray | None = None, high: np.ndarray | None = None) -> Solved:
    """The x that minimises x'Hx/2 + c'x with E x = e, A x <= b and low <= x <= high; H positive definite up to a ridge.

    A dual active-set method: it starts at the least point of the equalities alone and takes in one violated limit at a
    time, along a path on which multipliers stay right; a limit that no step can meet proves that there is no point."""
    n = len(c)
    rows, values = equal or _none(n)
    caps, limits = below or _none(n)
    low = np.full(n, -np.inf) if low is None else low
    high = np.full(n, np.inf) if high is None else high
    scale = max(float(np.trace(h)) / n, 1e-300)
    inverse = np.linalg.inv(h / scale + 1e-12 * np.eye(n))
    c = c / scale
    # every inequality as normal'x >= value
    normals = np.vstack([-caps, np.eye(n), -np.eye(n)])
    bounds = np.concatenate([-limits, low, -high])
    sizes = np.maximum(np.linalg.norm(normals, axis=1), 1e-300)
    normals, bounds = normals / sizes[:, None], bounds / sizes
    given = np.isfinite(bounds)

    fixed, fixed_values, proof = _independent(rows, values)
    if proof is not None:
        return Solved(None, equal=proof)
    base = inverse @ fixed.T
    x = -inverse @ c
    if len(fixed):
        x = x + base @ np.linalg.solve(fixed @ base, fixed_values - fixed @ x)
    active: list[int] = []
    held = np.zeros(0)  # multipliers of active
    for _ in range(50 * (n + len(bounds)) + 50):
        slack = np.where(given, normals @ x - np.where(given, bounds, 0.0), np.inf)
        slack[active] = np.inf
        p = int(np.argmin(slack))
        if slack[p] >= -1e-11 * (1 + np.abs(x).max()):
            return _finished(x, active, held, sizes, normals, bounds, scale, h, c, rows, len(caps), n)
        own = 0.0
        while True:
            together = np.vstack([fixed, normals[active]])
            normal = normals[p]
            spread = inverse @ together.T
            part = np.linalg.lstsq(together @ spread, spread.T @ normal, rcond=1e-13)[0] if len(together) else np.zeros(0)
            step = inverse @ normal - spread @ part
            part = part[len(fixed) :]
            reach = float(normal @ step)
            blocking = [(held[k] / part[k], k) for k in range(len(active)) if part[k] > 1e-13]
            most, leaves = min(blocking, default=(np.inf, -1))
            full = (bounds[p] - float(normal @ x)) / reach if reach > 1e-11 * float(normal @ inverse @ normal) else np.inf
            length = min(most, full)
            if not np.isfinite(length):
                return _proof(p, active, part, fixed, sizes, normals, rows, len(caps), n)
            if np.isfinite(full):
                x = x + length * step
            held, own = held - length * part, own + length
            if length == full:
                active.append(p)
                held = np.append(held, own)
                break
            active.pop(leaves)
            held = np.delete(held, leaves)
    raise ArithmeticError("the dual active-set method didn't settle")


def _independent(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray | None]:
    """Equalities as independent ones; multipliers that prove them at odds, if they are."""
    if not len(rows):
        return rows, values, None
    u, s, vt = np.linalg.svd(rows, full_matrices=False)
    rank = int((s > 1e-11 * max(s[0], 1e-300)).sum())
    rest = values - u[:, :rank] @ (u[:, :rank].T @ values)
    if np.abs(rest).max() > 1e-9 * (1 + np.abs(values).max()):
        return rows, values, -rest / float(rest @ values)
    return vt[:rank], (u[:, :rank].T @ values) / s[:rank], None


def _split(multipliers: dict[int, float], sizes: np.ndarray, n_caps: int, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    flat = np.zeros(n_caps + 2 * n)
    for k, value in multipliers.items():
        flat[k] = value / sizes[k]
    return flat[:n_caps], flat[n_caps : n_caps + n], flat[n_caps + n :]


def _finished(x, active, held, sizes, normals, bounds, scale, h, c, rows, n_caps, n) -> Solved:
    below, low, high = (scale * part for part in _split(dict(zip(active, np.maximum(held, 0.0), strict=True)), sizes, n_caps, n))
    gradient = h @ x + scale * c - low + high - scale * sum((normals[k] * v for k, v in zip(active, held, strict=True) if k < n_caps), np.zeros(n))
    equal = np.linalg.lstsq(rows.T, -gradient, rcond=None)[0] if len(rows) else np.zeros(0)
    return Solved(x, below, low, high, equal)


def _proof(p, active, part, fixed, sizes, normals, rows, n_caps, n) -> Solved:
    """normal p is a combination of active ones with parts that aren't positive, and of equalities: all limits together
    say that zero is below minus one."""
    mix = {p: 1.0} | {k: max(-float(v), 0.0) for k, v in zip(active, part, strict=True)}
    total = sum(normals[k] * v for k, v in mix.items())
    equal = np.linalg.lstsq(rows.T, total, rcond=None)[0] if len(rows) else np.zeros(0)
    below, low, high = _split(mix, sizes, n_caps, n)
    return Solved(None, below, low, high, equal)


def residual(solved: Solved, h: np.ndarray, c: np.ndarray, equal: Rows | None = None, below: Rows | None = None, low: np.ndarray | None = None, high: np.ndarray | None = None) -> float:
    """The greatest breach of the optimality conditions: slope, limits, signs, and multipliers of limits that are slack."""
    n, x = len(c), solved.x
    rows, values = equal or _none(n)
    caps, limits = below or _none(n)
    low = np.full(n, -np.inf) if low is None else low
    high = np.full(n, np.inf) if high is None else high
    slope = h @ x + c + rows.T @ solved.equal + caps.T @ solved.below - solved.low + solved.high
    room = np.concatenate([limits - caps @ x, x - low, high - x])
    lam = np.concatenate([solved.below, solved.low, solved.high])
    slack = np.where(np.isfinite(room), lam * np.where(np.isfinite(room), room, 0.0), lam)
    parts = [np.abs(slope), np.abs(rows @ x - values), np.maximum(-room[np.isfinite(room)], 0.0), np.maximum(-lam, 0.0), np.abs(slack)]
    return max(float(part.max(initial=0.0)) for part in parts)


def linear(c: np.ndarray, equal: Rows | None, below: Rows | None, low: np.ndarray, high: np.ndarray) -> np.ndarray | None:
    """The x of the least c'x within limits, or None: proximal steps, each a projection, end after finitely many."""
    n = len(c)
    c = c / max(float(np.abs(c).max()), 1e-300)
    x = np.zeros(n)
    for _ in range(500):
        found = program(np.eye(n), c - x, equal, below, low, high).x
        if found is None:
            return None
        if np.abs(found - x).max() < 1e-12:
            return found
        x = found
    return x


def _with_budget(n: int, equal: Rows | None) -> Rows:
    rows, values = equal or _none(n)
    return np.vstack([np.ones(n), rows]), np.append(1.0, values)


def max_sharpe(mu: np.ndarray, sigma: np.ndarray, rf: float, low: np.ndarray, high: np.ndarray, equal: Rows | None = None, below: Rows | None = None) -> np.ndarray | None:
    """The weights (of sum one) of the greatest ratio within limits, where some of them earn more than rf: one program in
    weights scaled so that they earn one above rf, in which every limit is a cone. None if no weights do."""
    n = len(mu)
    rows, values = equal or _none(n)
    caps, limits = below or _none(n)
    one = np.ones(n)
    cones = np.vstack([caps - np.outer(limits, one), np.outer(low, one) - np.eye(n), np.eye(n) - np.outer(high, one)])
    excess = mu - rf
    size = max(float(np.abs(excess).max()), 1e-300)
    found = program(sigma, np.zeros(n), (np.vstack([excess / size, rows - np.outer(values, one)]), np.append(1.0, np.zeros(len(rows)))), (cones, np.zeros(len(cones)))).x
    return None if found is None or found.sum() <= 1e-12 else found / found.sum()


def turnover_cut(x: np.ndarray, held: np.ndarray, most: float) -> tuple[np.ndarray, float] | None:
    """The inequality that x breaks if it is further than most from held, summed over assets; None if it isn't."""
    sign = np.where(x >= held, 1.0, -1.0)
    return (sign, most + float(sign @ held)) if float(np.abs(x - held).sum()) > most + 1e-10 else None


def with_turnover(solve, n: int, below: Rows | None, held: np.ndarray | None, most: float) -> np.ndarray | None:
    """solve(below) with a limit on turnover from held: of its 2**n inequalities those that a solution breaks are added."""
    caps, limits = below or _none(n)
    for _ in range(200):
        x = solve((caps, limits))
        if x is None or held is None or (cut := turnover_cut(x, held, most)) is None:
            return x
        caps, limits = np.vstack([caps, cut[0]]), np.append(limits, cut[1])
    raise ArithmeticError("the limit on turnover didn't settle")


@dataclass
class Corner:
    """A portfolio at which the set of assets between their bounds changes; weights are straight lines between corners.
    price is what a unit of mean is worth in variance / 2 there."""

    price: float
    weights: np.ndarray


def corners(mu: np.ndarray, sigma: np.ndarray, low: np.ndarray, high: np.ndarray) -> list[Corner]:
    """All corner portfolios of sum one within bounds, from the greatest mean to the least variance (price 0), by the
    critical line algorithm; none if bounds leave no portfolio. Of equal means the first asset counts as the greater."""
    n = len(mu)
    if low.sum() > 1 + 1e-12 or high.sum() < 1 - 1e-12 or (low > high).any():
        return []
    spread = max(float(np.abs(mu).max()), 1e-12)
    if len(set(mu.tolist())) < n:
        mu = mu - 1e-11 * spread * np.arange(n)
    at, room = low.astype(float).copy(), 1.0 - float(low.sum())
    free: list[int] = []
    for i in np.argsort(-mu, kind="stable").tolist():
        add = min(high[i] - low[i], room)
        at[i], room = at[i] + add, room - add
        if add > 0:
            free = [i]
        if room <= 1e-15:
            break
    free = free or [int(np.argmax(mu))]
    sigma = sigma + 1e-14 * max(1e-300, float(np.trace(sigma)) / n) * np.eye(n)
    price, found = np.inf, []
    for _ in range(100 * n + 100):
        bound = [i for i in range(n) if i not in free]
        size = len(free)
        kkt = np.zeros((size + 1, size + 1))
        kkt[:size, :size], kkt[:size, size], kkt[size, :size] = sigma[np.ix_(free, free)], 1.0, 1.0
        right = np.zeros((size + 1, 2))
        right[:size, 0], right[size, 0], right[:size, 1] = -sigma[np.ix_(free, bound)] @ at[bound], 1.0 - at[bound].sum(), mu[free]
        line = np.linalg.solve(kkt, right)
        start, slope = at.copy(), np.zeros(n)  # weights at price 0, and for each unit of price
        start[free], slope[free] = line[:size, 0], line[:size, 1]
        pull, tilt = sigma @ start + line[size, 0], sigma @ slope + line[size, 1] - mu
        events = []
        for i in free:
            if size > 1 and abs(slope[i]) > 1e-15:
                to = low[i] if slope[i] > 0 else high[i]
                events.append(((to - start[i]) / slope[i], i, to))
        for i in bound:
            if low[i] < high[i] and ((at[i] <= low[i] and tilt[i] > 1e-15) or (at[i] > low[i] and tilt[i] < -1e-15)):
                events.append((-pull[i] / tilt[i], i, None))
        events = [(min(when, price), i, to) for when, i, to in events if when <= price + 1e-12 * (1 + abs(price) if np.isfinite(price) else 1)]
        when, i, to = max(events, key=lambda e: e[0], default=(0.0, -1, None))
        here = np.clip(start + max(when, 0.0) * slope, low, high)
        if not found or found[-1].price - max(when, 0.0) > 1e-12 * (1 + found[-1].price):
            found.append(Corner(max(float(when), 0.0), here))
        if when <= 0 or i < 0:
            return found
        at, price = start + when * slope, when
        if to is None:
            free = sorted([*free, i])
        else:
            at[i] = to
            free = [k for k in free if k != i]
    raise ArithmeticError("the critical line didn't come to its end")


def at_mean(found: list[Corner], mu: np.ndarray, target: float) -> np.ndarray | None:
    """The weights of least variance at a mean between those of the corners; None outside of them."""
    means = np.array([c.weights @ mu for c in found])
    slack = 1e-10 * (1 + np.abs(means).max())
    if not len(means) or target > means[0] + slack or target < means[-1] - slack:
        return None
    k = int(np.clip(np.searchsorted(-means, -target, "left"), 1, max(len(means) - 1, 1)))
    if len(means) == 1:
        return found[0].weights
    part = np.clip((means[k - 1] - target) / max(means[k - 1] - means[k], 1e-300), 0.0, 1.0)
    return found[k - 1].weights + part * (found[k].weights - found[k - 1].weights)


def best_ratio(found: list[Corner], mu: np.ndarray, sigma: np.ndarray, rf: float) -> np.ndarray:
    """The greatest ratio on the corners' lines, on each by the zero of its slope; right where some corner earns more
    than rf."""
    best, weights = -np.inf, found[0].weights
    for a, b in zip(found, found[1:] or found, strict=False):
        move = b.weights - a.weights
        m, dm = a.weights @ mu - rf, move @ mu
        v, cross, own = a.weights @ sigma @ a.weights, a.weights @ sigma @ move, move @ sigma @ move
        turn = m * own - dm * cross
        at = (dm * v - m * cross) / turn if abs(turn) > 1e-300 else 0.0
        for t in (0.0, 1.0, float(np.clip(at, 0.0, 1.0))):
            ratio = (m + t * dm) / np.sqrt(max(v + 2 * t * cross + t * t * own, 1e-300))
            if ratio > best:
                best, weights = ratio, a.weights + t * move
    return weights


def best_vertex(mu: np.ndarray, sigma: np.ndarray, rf: float, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray | None, float, float]:
    """Where no weights earn more than rf: the weights of the greatest ratio, the ratio, and a bound that none exceeds.

    Risk over loss is quasi-convex, so its greatest value is at a vertex: all weights but one at a bound. Branch and bound
    over which: a branch's risk is at most that of a linear function above it, its loss at least the least there is."""
    n = len(mu)
    loss = rf - mu

    def fill(goal: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray | None:
        w, room = a.copy(), 1.0 - a.sum()
        if room < -1e-12 or b.sum() < 1 - 1e-12:
            return None
        for i in np.argsort(-goal, kind="stable"):
            add = min(b[i] - a[i], max(room, 0.0))
            w[i], room = w[i] + add, room - add
        return w

    def ratio(w: np.ndarray) -> float:
        return float(-(w @ loss) / np.sqrt(max(w @ sigma @ w, 1e-300)))

    def limit(a: np.ndarray, b: np.ndarray) -> tuple[float, np.ndarray] | None:
        reach = np.maximum(sigma * a, sigma * b).sum(axis=1)  # at least (sigma w)_i
        risky, safe = fill(np.where(reach > 0, reach, 0.0), a, b), fill(-loss, a, b)
        if risky is None:
            return None
        top = float(np.maximum(risky * reach, 0.0).sum())
        return -float(safe @ loss) / np.sqrt(max(top, 1e-300)), max((risky, safe), key=ratio)

    first = limit(low, high)
    if first is None:
        return None, -np.inf, -np.inf
    best, value = first[1], ratio(first[1])
    queue = [(-first[0], 0, low, high, -1)]  # the last is the weight that may stand between its bounds, once chosen
    count = 0
    while queue:
        bound, _, a, b, inner = heapq.heappop(queue)
        if -bound <= value + 1e-12 * abs(value):
            break
        open_ = [i for i in range(n) if a[i] < b[i] and i != inner]
        if not open_:
            continue
        i = max(open_, key=lambda k: (b[k] - a[k]) * np.sqrt(sigma[k, k]))
        children = [(np.where(np.arange(n) == i, side, a), np.where(np.arange(n) == i, side, b), inner) for side in (a[i], b[i])]
        if inner < 0:
            children.append((a, b, i))
        for lower, upper, chosen in children:
            found = limit(lower, upper)
            if found is None:
                continue
            if ratio(found[1]) > value:
                best, value = found[1], ratio(found[1])
            count += 1
            heapq.heappush(queue, (-found[0], count, lower, upper, chosen))
    return best, value, value + 1e-12 * abs(value)
