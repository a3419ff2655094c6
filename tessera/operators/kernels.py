"""Clustering kernels on one machine's arrays, from the published algorithms, NumPy only.

Each is O(n^2) at most and meant for what one task may hold: centroids, replicate samples,
projections of a bounded number of rows.  The distributed operators around them check sizes.
"""

from __future__ import annotations

import numpy as np


def pairwise(x: np.ndarray, y: np.ndarray | None = None) -> np.ndarray:
    y = x if y is None else y
    return np.sqrt(np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1)[None, :] - 2 * x @ y.T, 0))


def ward_merges(x: np.ndarray) -> np.ndarray:
    """Ward's agglomeration by nearest-neighbour chains: rows ``(a, b, height, size)``, by height."""
    n = len(x)
    d = pairwise(x) ** 2
    np.fill_diagonal(d, np.inf)
    size, alive, name = np.ones(n), np.ones(n, bool), np.arange(n)
    merges, chain = [], []
    for _ in range(n - 1):
        if not chain:
            chain = [int(np.nonzero(alive)[0][0])]
        while True:
            a = chain[-1]
            row = np.where(alive, d[a], np.inf)
            b = int(row.argmin())
            if len(chain) > 1 and row[chain[-2]] <= row[b]:
                b = chain[-2]
            if len(chain) > 1 and b == chain[-2]:
                break
            chain.append(b)
        a, b = chain.pop(), chain.pop()
        h, sa, sb = d[a, b], size[a], size[b]
        merges.append((name[a], name[b], np.sqrt(h), sa + sb))
        new = ((sa + size) * d[a] + (sb + size) * d[b] - size * h) / (sa + sb + size)  # Lance-Williams
        d[a], d[:, a] = new, new
        d[a, a] = np.inf
        size[a], alive[b] = sa + sb, False
        d[b], d[:, b] = np.inf, np.inf
        name[a] = n + len(merges) - 1
    if not merges:
        return np.zeros((0, 4))
    raw = np.array(merges)
    order = np.argsort(raw[:, 2], kind="stable")
    rename = np.arange(2 * n - 1)
    rename[n + order] = n + np.arange(len(order))
    out = raw[order]
    out[:, :2] = np.sort(rename[out[:, :2].astype(int)], axis=1)
    return out


def cut(merges: np.ndarray, n: int, k: int) -> np.ndarray:
    """Labels 0, 1, ... of ``k`` groups, numbered by their first member."""
    parent = np.arange(2 * n - 1)
    for i, (a, b, *_) in enumerate(merges[: max(0, n - k)]):
        parent[int(a)] = parent[int(b)] = n + i
    out = np.empty(n, int)
    for i in range(n):
        r = i
        while parent[r] != r:
            r = parent[r]
        out[i] = r
    _, first, inv = np.unique(out, return_index=True, return_inverse=True)
    rank = np.empty(len(first), int)
    rank[np.argsort(first)] = np.arange(len(first))
    return rank[inv]


def ward(x: np.ndarray, k: int) -> np.ndarray:
    return cut(ward_merges(x), len(x), min(k, len(x)))


def core_distances(x: np.ndarray, k: int, block: int = 1024) -> np.ndarray:
    k = min(k, len(x) - 1)
    return np.concatenate([np.partition(pairwise(x[i : i + block], x), k, axis=1)[:, k] for i in range(0, len(x), block)])


def reachability_tree(x: np.ndarray, core: np.ndarray) -> np.ndarray:
    """Minimum spanning tree of mutual reachability distances, rows ``(a, b, w)`` by weight (Prim)."""
    n = len(x)
    best, source, out_of = np.full(n, np.inf), np.zeros(n, int), np.ones(n, bool)
    at, edges = 0, []
    for _ in range(n - 1):
        out_of[at] = False
        d = np.maximum(np.maximum(np.sqrt(((x - x[at]) ** 2).sum(1)), core), core[at])
        nearer = out_of & (d < best)
        best[nearer], source[nearer] = d[nearer], at
        nxt = int(np.where(out_of, best, np.inf).argmin())
        edges.append((source[nxt], nxt, best[nxt]))
        at = nxt
    e = np.array(edges) if edges else np.zeros((0, 3))
    return e[np.argsort(e[:, 2], kind="stable")]


def _hierarchy(tree: np.ndarray, n: int):
    root = list(range(2 * n - 1))
    size = [1] * n + [0] * (n - 1)

    def find(a: int) -> int:
        while root[a] != a:
            root[a] = root[root[a]]
            a = root[a]
        return a

    left, right, height = [0] * (n - 1), [0] * (n - 1), [0.0] * (n - 1)
    for i, (a, b, w) in enumerate(tree):
        ra, rb = find(int(a)), find(int(b))
        left[i], right[i], height[i] = ra, rb, w
        root[ra] = root[rb] = n + i
        size[n + i] = size[ra] + size[rb]
    return left, right, height, size


def density_clusters(x: np.ndarray, smallest: int, samples: int | None = None) -> tuple[np.ndarray, dict]:
    """HDBSCAN: labels (noise -1, ids by first member) and what prediction and validity need.

    Excess of mass selects among the condensed tree's clusters; the root is never one.
    ``samples`` unset equals ``smallest``.
    """
    n = len(x)
    if n < 2 * smallest or n < 3:
        return np.full(n, -1), {"core": np.full(n, np.inf), "tree": np.zeros((0, 3))}
    core = core_distances(x, (samples or smallest))
    tree = reachability_tree(x, core)
    left, right, height, size = _hierarchy(tree, n)

    def leaves(node: int) -> list[int]:
        out, stack = [], [node]
        while stack:
            v = stack.pop()
            if v < n:
                out.append(v)
            else:
                stack += [left[v - n], right[v - n]]
        return out

    birth, parent, stability, members = {0: 0.0}, {0: -1}, {0: 0.0}, {0: []}
    stack = [(2 * n - 2, 0)]
    while stack:
        node, c = stack.pop()
        lam = 1 / height[node - n] if height[node - n] > 0 else 1e12
        kids = (left[node - n], right[node - n])
        big = [k for k in kids if size[k] >= smallest]
        if len(big) == 2:
            for k in kids:
                new = len(birth)
                birth[new], parent[new], stability[new], members[new] = lam, c, 0.0, []
                stability[c] += (lam - birth[c]) * size[k]
                stack.append((k, new))
            continue
        for k in kids:
            if k in big and k >= n:
                stack.append((k, c))
            else:
                stability[c] += (lam - birth[c]) * size[k]
                members[c] += leaves(k)
    kids_of: dict[int, list[int]] = {}
    for c, p in parent.items():
        kids_of.setdefault(p, []).append(c)
    chosen, value = set(), dict(stability)
    for c in sorted(birth, reverse=True):
        below = sum(value[k] for k in kids_of.get(c, []))
        if c == 0:
            continue
        if not kids_of.get(c) or stability[c] >= below:
            chosen.add(c)
        else:
            value[c] = below
    for c in sorted(chosen):
        p = parent[c]
        while p > 0:
            if p in chosen:
                chosen.discard(c)
                break
            p = parent[p]
    owner = {}
    for c in sorted(birth):
        owner[c] = c if c in chosen else owner.get(parent[c], -1)
    raw = np.full(n, -1)
    for c, m in members.items():
        raw[m] = owner[c]
    out = np.full(n, -1)
    seen: dict[int, int] = {}
    for i, c in enumerate(raw):
        if c >= 0:
            out[i] = seen.setdefault(int(c), len(seen))
    return out, {"core": core, "tree": tree}


def predict_density(x: np.ndarray, labels: np.ndarray, core: np.ndarray, new: np.ndarray, samples: int, slack: float = 1.0) -> np.ndarray:
    """Labels of new rows: that of the nearest fitted row by mutual reachability, noise if it is noise or too far.

    Too far: beyond ``slack`` times the largest core distance of the label's rows.
    """
    if not len(new) or not len(x):
        return np.full(len(new), -1)
    reach = {c: core[labels == c].max() * slack for c in np.unique(labels[labels >= 0])}
    out = []
    for i in range(0, len(new), 1024):
        d = pairwise(new[i : i + 1024], x)
        own = np.partition(d, min(samples, len(x) - 1), axis=1)[:, min(samples, len(x) - 1)]
        m = np.maximum(np.maximum(d, core[None, :]), own[:, None])
        j = m.argmin(1)
        got = labels[j]
        out.append(np.where((got >= 0) & (m[np.arange(len(j)), j] <= np.array([reach.get(c, 0) for c in got])), got, -1))
    return np.concatenate(out)


def relative_validity(tree: np.ndarray, labels: np.ndarray) -> float:
    """Density-based validity from the spanning tree: separation against sparseness, weighted by size."""
    ids = np.unique(labels[labels >= 0])
    if len(ids) < 2:
        return -1.0
    la, lb, w = labels[tree[:, 0].astype(int)], labels[tree[:, 1].astype(int)], tree[:, 2]
    total = 0.0
    for c in ids:
        inner, outer = (la == c) & (lb == c), (la == c) ^ (lb == c)
        sparse = w[inner].max() if inner.any() else 0.0
        apart = w[outer].min() if outer.any() else np.inf
        v = 1.0 if not np.isfinite(apart) else (apart - sparse) / max(apart, sparse, 1e-300)
        total += (labels == c).sum() / len(labels) * v
    return float(total)


def optics_order(x: np.ndarray, samples: int) -> tuple[np.ndarray, np.ndarray]:
    """OPTICS ordering and reachability distances."""
    n = len(x)
    core = core_distances(x, samples - 1)
    reach, todo, order = np.full(n, np.inf), np.ones(n, bool), []
    for _ in range(n):
        at = int(np.where(todo, reach, np.inf).argmin()) if np.isfinite(reach[todo]).any() else int(np.nonzero(todo)[0][0])
        todo[at] = False
        order.append(at)
        d = np.maximum(np.sqrt(((x - x[at]) ** 2).sum(1)), core[at])
        reach = np.where(todo & (d < reach), d, reach)
    return np.array(order), reach


def optics(x: np.ndarray, samples: int, quantile: float = 0.9) -> np.ndarray:
    """Labels from OPTICS: valleys of the reachability plot below its given quantile, of ``samples`` rows at least."""
    order, reach = optics_order(x, samples)
    eps = np.quantile(reach[np.isfinite(reach)], quantile) if np.isfinite(reach).any() else 0
    out, label, run = np.full(len(x), -1), 0, []
    for i in [*order.tolist(), -1]:
        if i >= 0 and reach[i] <= eps:
            run.append(i)
            continue
        if len(run) >= samples:
            out[run] = label
            label += 1
        run = [i]
    return out


def louvain(n: int, edges: np.ndarray, resolution: float = 1.0, rounds: int = 20) -> np.ndarray:
    """Modularity communities of a weighted graph ``(a, b, w)``: local moves in id order, then aggregation."""
    w = np.zeros((n, n))
    for a, b, v in edges:
        w[int(a), int(b)] += v
        w[int(b), int(a)] += v
    mapping, graph = np.arange(n), w
    for _ in range(rounds):
        m2 = graph.sum()
        if m2 == 0:
            break
        deg, com = graph.sum(1), np.arange(len(graph))
        moved = True
        while moved:
            moved = False
            for i in range(len(graph)):
                tot = np.bincount(com, weights=deg, minlength=len(graph))
                tot[com[i]] -= deg[i]
                link = np.bincount(com, weights=graph[i] * (np.arange(len(graph)) != i), minlength=len(graph))
                gain = link - resolution * deg[i] * tot / m2
                best = int(gain.argmax())
                if gain[best] > gain[com[i]] + 1e-12:
                    com[i], moved = best, True
        ids, inv = np.unique(com, return_inverse=True)
        mapping = inv[mapping]
        if len(ids) == len(graph):
            break
        hot = np.eye(len(ids))[inv]
        graph = hot.T @ graph @ hot
    _, first, inv = np.unique(mapping, return_index=True, return_inverse=True)
    rank = np.empty(len(first), int)
    rank[np.argsort(first)] = np.arange(len(first))
    return rank[inv]


def hungarian(gain: np.ndarray) -> list[tuple[int, int]]:
    """Assignment of greatest total gain (potentials and augmenting paths); rectangular tables allowed."""
    transposed = gain.shape[0] > gain.shape[1]
    g = gain.T if transposed else gain
    n, m = g.shape
    cost = (g.max() if g.size else 0) - g
    u, v, owner, way = np.zeros(n + 1), np.zeros(m + 1), np.zeros(m + 1, int), np.zeros(m + 1, int)
    for i in range(1, n + 1):
        owner[0], j0 = i, 0
        least, used = np.full(m + 1, np.inf), np.zeros(m + 1, bool)
        while True:
            used[j0] = True
            i0 = owner[j0]
            free = ~used[1:]
            now = cost[i0 - 1] - u[i0] - v[1:]
            better = free & (now < least[1:])
            least[1:][better], way[1:][better] = now[better], j0
            j1 = int(np.where(free, least[1:], np.inf).argmin()) + 1
            delta = least[j1]
            u[owner[used]] += delta
            v[used] -= delta
            least[~used] -= delta
            j0 = j1
            if owner[j0] == 0:
                break
        while j0:
            j1 = way[j0]
            owner[j0], j0 = owner[j1], j1
    pairs = [(owner[j] - 1, j - 1) for j in range(1, m + 1) if owner[j]]
    return sorted((b, a) if transposed else (a, b) for a, b in pairs)
