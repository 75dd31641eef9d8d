"""Kernels on small inputs: assignment, linkage, knee, cliques, tails, ordination.  NumPy only."""

from __future__ import annotations

import math

import numpy as np


def assign(gain: np.ndarray) -> list[tuple[int, int]]:
    """Pairs (row, column) of greatest total gain, by shortest augmenting paths with potentials; every row or every column is paired."""
    flip = gain.shape[0] > gain.shape[1]
    cost = -(gain.T if flip else gain)
    n, m = cost.shape
    u, v = np.zeros(n + 1), np.zeros(m + 1)
    match = np.zeros(m + 1, int)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        least, way, used = np.full(m + 1, np.inf), np.zeros(m + 1, int), np.zeros(m + 1, bool)
        while True:
            used[j0] = True
            row = match[j0]
            free = ~used[1:]
            reduced = cost[row - 1] - u[row] - v[1:]
            better = free & (reduced < least[1:])
            least[1:][better], way[1:][better] = reduced[better], j0
            j1 = 1 + int(np.where(free, least[1:], np.inf).argmin())
            delta = least[j1]
            u[match[used]] += delta
            v[used] -= delta
            least[~used] -= delta
            j0 = j1
            if match[j0] == 0:
                break
        while j0:
            match[j0], j0 = match[way[j0]], way[j0]
    pairs = [(match[j] - 1, j - 1) for j in range(1, m + 1) if match[j]]
    return sorted((b, a) if flip else (a, b) for a, b in pairs)


def cophenetic(distance: np.ndarray) -> float | None:
    """Correlation of distances with the heights at which average linkage joins; null if either is constant."""
    n = len(distance)
    d = distance.astype(float).copy()
    np.fill_diagonal(d, np.inf)
    members = {i: [i] for i in range(n)}
    heights = np.zeros((n, n))
    while len(members) > 1:
        keys = sorted(members)
        block = d[np.ix_(keys, keys)]
        i, j = np.unravel_index(int(block.argmin()), block.shape)
        a, b = sorted((keys[i], keys[j]))
        height = d[a, b]
        for x in members[a]:
            for y in members[b]:
                heights[x, y] = heights[y, x] = height
        na, nb = len(members[a]), len(members[b])
        for c in keys:
            if c not in (a, b):
                d[a, c] = d[c, a] = (na * d[a, c] + nb * d[b, c]) / (na + nb)
        members[a] += members.pop(b)
    upper = np.triu_indices(n, 1)
    x, y = distance[upper], heights[upper]
    if n < 3 or x.std() == 0 or y.std() == 0:
        return None
    return float(np.corrcoef(x, y)[0, 1])


def knee(x: np.ndarray, y: np.ndarray, sensitivity: float = 1.0) -> float | None:
    """Last knee of a concave increasing curve (Kneedle, read online); null if there is none."""
    order = np.argsort(x)
    x, y = np.asarray(x, float)[order], np.asarray(y, float)[order]
    if len(x) < 3 or np.ptp(y) == 0:
        return None
    gap = (y - y.min()) / np.ptp(y) - (x - x.min()) / np.ptp(x)
    found, bar, at = None, None, None
    step = sensitivity * float(np.abs(np.diff((x - x.min()) / np.ptp(x))).mean())
    for i in range(1, len(x)):
        if i < len(x) - 1 and gap[i] >= gap[i - 1] and gap[i] >= gap[i + 1]:
            at, bar = i, gap[i] - step
        elif bar is not None and gap[i] < bar:
            found, bar = float(x[at]), None
    return found


def peak(ranks: np.ndarray, values: np.ndarray, near: float = 0.02) -> int | None:
    """Of local maxima within ``near`` of the highest, the one before the longest fall toward lower ranks; ties go to the higher rank."""
    order = np.argsort(-ranks)
    r, v = ranks[order], values[order]
    n = len(v)
    tops = [i for i in range(n) if v[i] > v[i - 1] and v[i] > v[(i + 1) % n]]
    if not tops:
        return None
    highest = max(v[i] for i in tops)
    best, longest = None, -1
    for i in tops:
        if v[i] >= (1 - near) * highest:
            run = 0
            while i + run + 1 < n and v[i + run + 1] < v[i + run]:
                run += 1
            if run > longest:
                best, longest = int(r[i]), run
    return best


def cliques(n: int, edges: set[tuple[int, int]]) -> list[list[int]]:
    """Maximal cliques (Bron and Kerbosch with pivots), largest first, then by members."""
    near = {i: set() for i in range(n)}
    for a, b in edges:
        near[a].add(b)
        near[b].add(a)
    out = []
    todo = [(set(), set(range(n)), set())]
    while todo:
        r, p, x = todo.pop()
        if not p and not x:
            out.append(sorted(r))
            continue
        pivot = max(p | x, key=lambda u: len(near[u] & p))
        for v in sorted(p - near[pivot]):
            todo.append((r | {v}, p & near[v], x & near[v]))
            p = p - {v}
            x = x | {v}
    return sorted(out, key=lambda c: (-len(c), c))


def normal_tail(z: float) -> float:
    """P(|N| >= |z|)."""
    return math.erfc(abs(z) / math.sqrt(2))


def mann_whitney_tail(u: float, n1: int, n2: int) -> float:
    """Two-sided p of U without ties: subsets counted by the U that they give."""
    ways = np.zeros((n1 + 1, n1 * n2 + 1))
    ways[0, 0] = 1
    # The k-th value in order adds to U the values of the other group below it.
    for k in range(n1 + n2):
        for size in range(min(k + 1, n1), 0, -1):
            below = k - (size - 1)
            if 0 <= below <= n2:
                ways[size, below:] += ways[size - 1, : n1 * n2 + 1 - below]
    counts = ways[n1]
    far = int(max(u, n1 * n2 - u))
    return min(1.0, 2 * float(counts[far:].sum() / counts.sum()))


def kruskal(a: np.ndarray, b: np.ndarray) -> tuple[float, float]:
    """H with tie correction and p of two groups."""
    every = np.concatenate([a, b])
    _, inverse, counts = np.unique(every, return_inverse=True, return_counts=True)
    ends = np.cumsum(counts)
    ranks = (ends - (counts - 1) / 2)[inverse]
    n = len(every)
    fix = 1 - float((counts.astype(float) ** 3 - counts).sum()) / (n**3 - n)
    if fix == 0:
        return 0.0, 1.0
    h = (12 / (n * (n + 1)) * (ranks[: len(a)].sum() ** 2 / len(a) + ranks[len(a) :].sum() ** 2 / len(b)) - 3 * (n + 1)) / fix
    return h, chi2_tail(h, 1)


def chi2_tail(x: float, df: int) -> float:
    """P(chi-square >= x), by the series or the continued fraction of the incomplete gamma function."""
    if x <= 0:
        return 1.0
    a, z = df / 2, x / 2
    front = math.exp(-z + a * math.log(z) - math.lgamma(a))
    if z < a + 1:
        total = term = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-16:
            n += 1
            term *= z / n
            total += term
        return max(0.0, 1 - total * front)
    b, tiny = z + 1 - a, 1e-300
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or tiny)
        c = b + an / c or tiny
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return front * h


def principal_coordinates(distance: np.ndarray, axes: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """Classical scaling: coordinates and each axis's share; axes point so that their largest entry is positive."""
    n = len(distance)
    centre = np.eye(n) - 1 / n
    values, vectors = np.linalg.eigh(-centre @ (distance**2) @ centre / 2)
    order = np.argsort(-values)
    values, vectors = np.maximum(values[order], 0), vectors[:, order]
    sign = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(n)])
    points = vectors * sign * np.sqrt(values)
    return points[:, :axes], values[:axes] / max(values.sum(), 1e-300)


def smacof(distance: np.ndarray, axes: int = 2, seed: int = 0, rounds: int = 300) -> np.ndarray:
    """Metric scaling by majorisation from a seeded start."""
    n = len(distance)
    points = np.random.default_rng(seed).standard_normal((n, axes))
    for _ in range(rounds):
        apart = np.sqrt(((points[:, None] - points[None]) ** 2).sum(-1))
        with np.errstate(divide="ignore", invalid="ignore"):
            b = -np.where(apart > 0, distance / apart, 0.0)
        b[np.arange(n), np.arange(n)] = -b.sum(axis=1)
        points = b @ points / n
    return points
