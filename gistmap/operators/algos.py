"""Iterative algorithms on arrays: density and agglomerative clustering, communities, mixtures, layouts.

Pure functions of numpy arrays. They run in one task, so callers check sizes against ``MAX_ROWS`` first
(density clustering, whose memory grows with the rows alone, against ``MAX_DENSITY_ROWS``; communities and the
spring layout, whose memory grows with nodes and edges alone, have no limit).
"""

from __future__ import annotations

import math
from collections import deque
from heapq import heappop, heappush

import numpy as np

MAX_ROWS, MAX_DENSITY_ROWS = 8_000, 100_000

#: Pairs of points that are compared at once.
PAIRS = 1 << 17


def check(n: int, most: int = MAX_ROWS) -> None:
    if n > most:
        raise ValueError(f"{n} rows exceed the {most} that one task takes")


def hdbscan(x: np.ndarray, min_cluster_size: int = 3, min_samples: int = 4) -> np.ndarray:
    """Labels by hierarchical density clustering (excess of mass); -1 is noise."""
    n = len(x)
    check(n, MAX_DENSITY_ROWS)
    if n < max(2, min_cluster_size):
        return np.full(n, -1)
    # squared distances, rounded: equal ones stay equal, however a product is computed
    sq, k = (x * x).sum(axis=1), min(min_samples, n) - 1
    core = np.empty(n)
    for at in range(0, n, 256):
        near = sq[at : at + 256, None] + sq[None, :] - 2 * x[at : at + 256] @ x.T
        core[at : at + 256] = np.partition(near, k, axis=1)[:, k]
    core = np.maximum(0.0, np.round(core, 12))
    # minimum spanning tree; no edge is shorter than the core distance of its ends, so rows that have come down to theirs wait no more
    best, frm, done = np.full(n, np.inf), np.zeros(n, int), np.zeros(n, bool)
    wait, y, j = np.arange(n), x, 0
    done[0] = True
    edges = []
    for _ in range(n - 1):
        reach = np.maximum(np.round(sq[wait] + sq[j] - 2 * (y @ x[j]), 12), np.maximum(core[wait], core[j]))
        closer = (reach < best[wait]) & ~done[wait]
        best[wait[closer]], frm[wait[closer]] = reach[closer], j
        j = int(best.argmin())
        edges.append((math.sqrt(best[j]), int(frm[j]), j))
        done[j], best[j] = True, np.inf
        left = ~done[wait] & (best[wait] > core[wait])
        if np.count_nonzero(left) < 0.8 * len(wait):
            wait = wait[left]
            y = x[wait]
    edges.sort()
    # single-linkage tree
    parent, size = list(range(2 * n - 1)), [1] * n + [0] * (n - 1)
    kids: dict[int, tuple[int, int, float]] = {}

    def find(a: int) -> int:
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a

    for k, (d, a, b) in enumerate(edges):
        ra, rb, new = find(a), find(b), n + k
        parent[ra] = parent[rb] = new
        size[new] = size[ra] + size[rb]
        kids[new] = (ra, rb, d)

    def points(a: int) -> list[int]:
        out, stack = [], [a]
        while stack:
            v = stack.pop()
            if v < n:
                out.append(v)
            else:
                stack += kids[v][:2]
        return out

    # condense: clusters with birth, members leaving, children
    clusters = [{"birth": 0.0, "stability": 0.0, "kids": [], "points": []}]
    stack = [(2 * n - 2, 0)]
    while stack:
        node, c = stack.pop()
        lam = 1 / kids[node][2] if node >= n and kids[node][2] > 0 else 1e12
        here = clusters[c]
        if node < n:
            here["points"].append(node)
            continue
        a, b, _ = kids[node]
        big = [v for v in (a, b) if size[v] >= min_cluster_size]
        for v in (a, b):
            if size[v] < min_cluster_size:
                here["stability"] += (lam - here["birth"]) * size[v]
                here["points"] += points(v)
        if len(big) == 2:
            for v in big:
                here["stability"] += (lam - here["birth"]) * size[v]
                clusters.append({"birth": lam, "stability": 0.0, "kids": [], "points": []})
                here["kids"].append(len(clusters) - 1)
                stack.append((v, len(clusters) - 1))
        elif big:
            stack.append((big[0], c))
    chosen: dict[int, bool] = {}
    value = [0.0] * len(clusters)
    for c in range(len(clusters) - 1, -1, -1):
        below = sum(value[k] for k in clusters[c]["kids"])
        chosen[c] = c != 0 and clusters[c]["stability"] >= below
        value[c] = clusters[c]["stability"] if chosen[c] else below
    labels, nxt = np.full(n, -1), 0
    stack2 = [(0, None)]
    while stack2:
        c, label = stack2.pop()
        if label is None and chosen[c]:
            label, nxt = nxt, nxt + 1
        if label is not None:
            labels[clusters[c]["points"]] = label
        stack2 += [(k, label) for k in clusters[c]["kids"]]
    return labels


def ward(x: np.ndarray, clusters: int) -> np.ndarray:
    """Labels of agglomerative clustering by least growth of variance."""
    n = len(x)
    check(n)
    clusters = min(clusters, n)
    d = ((x[:, None, :] - x[None, :, :]) ** 2).sum(axis=2) if n <= 2_000 else np.maximum(0, (x * x).sum(1)[:, None] + (x * x).sum(1)[None, :] - 2 * x @ x.T)
    np.fill_diagonal(d, np.inf)
    size, alive, members = np.ones(n), np.ones(n, bool), {i: [i] for i in range(n)}
    near = d.argmin(axis=1) if n > 1 else np.zeros(n, int)
    value = d[np.arange(n), near] if n > 1 else np.full(n, np.inf)
    for _ in range(n - clusters):
        i = int(np.where(alive, value, np.inf).argmin())
        j = int(near[i])
        a, b, s = size[i], size[j], size
        new = ((a + s) * d[i] + (b + s) * d[j] - s * d[i, j]) / (a + b + s)
        new[~alive] = np.inf
        new[[i, j]] = np.inf
        d[i], d[:, i] = new, new
        d[j], d[:, j] = np.inf, np.inf
        alive[j] = False
        size[i] += size[j]
        members[i] += members.pop(j)
        stale = alive & ((near == i) | (near == j))
        stale[i] = True
        for k in np.flatnonzero(stale):
            near[k] = d[k].argmin()
            value[k] = d[k, near[k]]
        lower = alive & (new < value)
        near[lower], value[lower] = i, new[lower]
    labels = np.empty(n, int)
    for k, (_, m) in enumerate(sorted(members.items(), key=lambda kv: min(kv[1]))):
        labels[m] = k
    return labels


def leiden_cpm(n: int, edges: list[tuple[int, int]], gamma: float, seed: int = 42) -> np.ndarray:
    """Communities of an unweighted graph maximising edges inside minus gamma times pairs inside.

    Local moving, refinement inside communities (which keeps them connected) and aggregation, until stable.
    """
    rng = np.random.default_rng(seed)
    graph: list[dict[int, float]] = [{} for _ in range(n)]
    for a, b in edges:
        if a != b:
            graph[a][b] = graph[a].get(b, 0) + 1.0
            graph[b][a] = graph[b].get(a, 0) + 1.0
    weight = [1.0] * n
    # the part of the current graph that a node has come into
    part = np.arange(n)
    label = list(range(n))

    def move(label: list[int], inside: list[int] | None) -> bool:
        total, count = [0.0] * (len(label) + 1), [0] * (len(label) + 1)
        for v, c in enumerate(label):
            total[c] += weight[v]
            count[c] += 1
        # labels nobody has, the least first; some may have been taken since
        free = [c for c in range(len(label) + 1) if not count[c]]
        queue = deque(int(v) for v in rng.permutation(len(label)))
        waiting, changed = bytearray(b"\x01") * len(label), False
        while queue:
            v = queue.popleft()
            waiting[v] = 0
            mine = label[v]
            total[mine] -= weight[v]
            count[mine] -= 1
            if not count[mine]:
                total[mine] = 0.0
                heappush(free, mine)
            links: dict[int, float] = {}
            for u, w in graph[v].items():
                if inside is None or inside[u] == inside[v]:
                    links[label[u]] = links.get(label[u], 0.0) + w
            best, gain = mine, links.get(mine, 0.0) - gamma * weight[v] * total[mine]
            for c in sorted(links):
                g = links[c] - gamma * weight[v] * total[c]
                if g > gain + 1e-12:
                    best, gain = c, g
            if gain < -1e-12:
                while count[free[0]]:
                    heappop(free)
                best = free[0]
            label[v] = best
            total[best] += weight[v]
            count[best] += 1
            if best != mine:
                changed = True
                for u in graph[v]:
                    if label[u] != best and not waiting[u] and (inside is None or inside[u] == inside[v]):
                        queue.append(u)
                        waiting[u] = 1
        return changed

    while True:
        changed = move(label, None)
        fine = list(range(len(label)))
        move(fine, label)
        names = {c: i for i, c in enumerate(dict.fromkeys(fine))}
        if len(names) == len(label) and not changed:
            break
        fine = [names[c] for c in fine]
        size = len(names)
        merged: list[dict[int, float]] = [{} for _ in range(size)]
        for v, nb in enumerate(graph):
            for u, w in nb.items():
                if fine[u] != fine[v]:
                    merged[fine[v]][fine[u]] = merged[fine[v]].get(fine[u], 0.0) + w
            graph[v] = {}
        new_weight, new_label = [0.0] * size, [0] * size
        for v, c in enumerate(fine):
            new_weight[c] += weight[v]
            new_label[c] = label[v]
        part = np.array(fine)[part]
        same = size == len(label)
        graph, weight = merged, new_weight
        ids = {c: i for i, c in enumerate(dict.fromkeys(new_label))}
        label = [ids[c] for c in new_label]
        if same and not changed:
            break
    # a community whose parts are not linked falls apart
    return connected_labels(n, edges, np.array(label)[part] if n else part)


def connected_labels(n: int, edges: list[tuple[int, int]], label: np.ndarray) -> np.ndarray:
    parent = list(range(n))

    def find(a: int) -> int:
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a

    for a, b in edges:
        if label[a] == label[b]:
            parent[find(a)] = find(b)
    names: dict[int, int] = {}
    return np.array([names.setdefault(find(v), len(names)) for v in range(n)])


def dp_mixture(x: np.ndarray, components: int = 60, concentration: float = 5.0, covariance_scale: float = 0.3, dof: float = 10.0, iterations: int = 500, seed: int = 42) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Variational stick-breaking Gaussian mixture: (weights, means, covariances)."""
    n, d = x.shape
    check(n)
    k = max(1, min(components, n))
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(n, k, replace=False)]
    resp = np.zeros((n, k))
    resp[np.arange(n), ((x[:, None] - centres[None]) ** 2).sum(2).argmin(1)] = 1.0
    prior_mean, prior_cov = x.mean(0), covariance_scale * np.eye(d)
    before = -np.inf
    for _ in range(iterations):
        nk = resp.sum(0) + 1e-10
        means = resp.T @ x / nk[:, None]
        # sticks
        a, b = 1 + nk, concentration + np.concatenate([np.cumsum(nk[::-1])[::-1][1:], [0.0]])
        stick, rest = digamma(a) - digamma(a + b), digamma(b) - digamma(a + b)
        log_weight = stick + np.concatenate([[0.0], np.cumsum(rest)[:-1]])
        beta, nu = 1.0 + nk, dof + nk
        m = (prior_mean[None] + nk[:, None] * means) / beta[:, None]
        covs = np.empty((k, d, d))
        for c in range(k):
            diff = x - means[c]
            s = (resp[:, c, None] * diff).T @ diff
            off = means[c] - prior_mean
            covs[c] = (prior_cov + s + nk[c] / beta[c] * np.outer(off, off)) / nu[c]
        log_p = np.empty((n, k))
        for c in range(k):
            chol = np.linalg.cholesky(covs[c])
            y = np.linalg.solve(chol, (x - m[c]).T)
            log_det = -2 * np.log(np.diag(chol)).sum() - d * math.log(nu[c]) + sum(digamma((nu[c] - i) / 2) for i in range(d)) + d * math.log(2)
            log_p[:, c] = log_weight[c] + 0.5 * (log_det - d / beta[c] - (y * y).sum(0))
        top = log_p.max(1, keepdims=True)
        norm = top[:, 0] + np.log(np.exp(log_p - top).sum(1))
        resp = np.exp(log_p - norm[:, None])
        if abs(norm.mean() - before) < 1e-4:
            break
        before = norm.mean()
    share = a / (a + b)
    weights = share * np.concatenate([[1.0], np.cumprod(1 - share)[:-1]])
    return weights / weights.sum(), m, covs


def digamma(v):
    v = np.asarray(v, float)
    out = np.zeros_like(v)
    for _ in range(6):
        out = out - np.where(v < 6, 1 / v, 0)
        v = np.where(v < 6, v + 1, v)
    i = 1 / (v * v)
    return out + np.log(v) - 0.5 / v - i * (1 / 12 - i * (1 / 120 - i / 252))


def neighbour_layout(x: np.ndarray, n_neighbors: int = 10, min_dist: float = 0.05, epochs: int = 200, seed: int = 42) -> np.ndarray:
    """Two-dimensional layout of a fuzzy nearest-neighbour graph (cosine), started from principal components."""
    n = len(x)
    check(n)
    if n <= 2:
        return np.zeros((n, 2)) if n < 2 else np.array([[-1.0, 0.0], [1.0, 0.0]])
    k = min(n_neighbors, n - 1)
    unit = x / np.maximum(1e-12, np.linalg.norm(x, axis=1, keepdims=True))
    sims = unit @ unit.T
    np.fill_diagonal(sims, -np.inf)
    near = np.argsort(-sims, axis=1, kind="stable")[:, :k]
    dist = 1 - np.take_along_axis(sims, near, 1)
    rho, target = dist[:, 0], math.log2(max(2, k))
    sigma = np.ones(n)
    for _ in range(32):
        got = np.exp(-np.maximum(0, dist - rho[:, None]) / sigma[:, None]).sum(1)
        sigma = np.clip(sigma * np.where(got > target, 0.8, 1.25), 1e-4, 1e3)
    w = np.zeros((n, n))
    np.put_along_axis(w, near, np.exp(-np.maximum(0, dist - rho[:, None]) / sigma[:, None]), 1)
    w = w + w.T - w * w.T
    mean = x - x.mean(0)
    u, s, _ = np.linalg.svd(mean, full_matrices=False)
    y = u[:, :2] * s[:2]
    if y.shape[1] < 2:
        y = np.pad(y, ((0, 0), (0, 2 - y.shape[1])))
    y = 10 * y / max(1e-12, np.abs(y).max())
    rng = np.random.default_rng(seed)
    a, b = np.nonzero(w)
    weight = w[a, b]
    for e in range(epochs):
        step = 1 - e / epochs
        diff = y[a] - y[b]
        d2 = (diff**2).sum(1)
        pull = -2.0 * weight / (1 + d2)
        pull = np.where(d2 < min_dist**2, 0.0, pull)
        move = np.zeros_like(y)
        np.add.at(move, a, pull[:, None] * diff)
        other = rng.integers(0, n, len(a))
        diff = y[a] - y[other]
        d2 = (diff**2).sum(1)
        push = 2.0 / ((0.01 + d2) * (1 + d2))
        np.add.at(move, a, np.clip(push[:, None] * diff, -4, 4) * 0.2)
        y = y + step * np.clip(move, -4, 4) * 0.25
    return y


def spring_layout(n: int, edges: list[tuple[int, int, float]], iterations: int = 50, seed: int = 42) -> np.ndarray:
    """Force-directed positions (attraction by weight, repulsion between all); pairs are met in blocks, edges alone are kept."""
    if n < 2:
        return np.zeros((n, 2))
    pos = np.random.default_rng(seed).random((n, 2))
    k, heat = math.sqrt(1 / n), 0.1
    # of several weights of a pair the last counts
    weights: dict[tuple[int, int], float] = {}
    for a, b, w in edges:
        weights[min(a, b), max(a, b)] = w
    ends = np.array(list(weights), int).reshape(-1, 2)
    a, b, w = np.concatenate([ends[:, 0], ends[:, 1]]), np.concatenate([ends[:, 1], ends[:, 0]]), np.tile(np.array(list(weights.values()), float), 2)
    rows = max(1, PAIRS // n)
    for _ in range(iterations):
        x, y = np.ascontiguousarray(pos.T)
        force = np.empty((n, 2))
        for at in range(0, n, rows):
            dx, dy = x[at : at + rows, None] - x, y[at : at + rows, None] - y
            push = dx * dx
            push += dy * dy
            np.maximum(push, 1e-4, out=push)
            np.divide(k * k, push, out=push)
            force[at : at + rows, 0] = np.einsum("ij,ij->i", push, dx)
            force[at : at + rows, 1] = np.einsum("ij,ij->i", push, dy)
        dx, dy = x[a] - x[b], y[a] - y[b]
        pull = w * np.maximum(0.01, np.sqrt(dx * dx + dy * dy)) / k
        force[:, 0] -= np.bincount(a, pull * dx, n)
        force[:, 1] -= np.bincount(a, pull * dy, n)
        size = np.maximum(0.01, np.sqrt((force**2).sum(1)))
        pos = pos + force * (heat / size)[:, None]
        heat -= 0.1 / (iterations + 1)
    return pos
