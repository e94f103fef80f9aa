"""Order-dependent steps on the granules of one data set, as NumPy folds.

They run in one task over granules, about the root of the points; `plans.pipelines` checks the number.
"""

from __future__ import annotations

import math

import numpy as np

TINY = 1e-12


def scaled(v: np.ndarray) -> np.ndarray:
    lo, hi = v.min(), v.max()
    return np.zeros(len(v)) if hi - lo <= 1e-15 else (v - lo) / (hi - lo)


def unit(v: np.ndarray) -> np.ndarray:
    lo, hi = np.quantile(v, [0.05, 0.95])
    if hi - lo <= TINY:
        lo, hi = v.min(), v.max()
    return np.clip((v - lo) / (hi - lo), 0, 1) if hi - lo > TINY else np.ones(len(v))


def peaks(rho: np.ndarray, d: np.ndarray, mode: str = "strict") -> tuple[np.ndarray, np.ndarray]:
    """(delta, parent); parent -1: none. Modes as in operators.dpc.attributes."""
    m = len(rho)
    order = np.lexsort((np.arange(m), -rho))
    delta, parent = np.zeros(m), np.full(m, -1)
    for pos, i in enumerate(order):
        ahead = np.flatnonzero(rho > rho[i]) if mode in ("strict", "row") else order[:pos]
        if len(ahead):
            parent[i] = ahead[d[i, ahead].argmin()]
            delta[i] = d[i, parent[i]]
        elif mode != "strict":
            delta[i] = d[i].max()
    if mode == "strict":
        delta[order[0]] = delta.max()
    if mode == "ball":
        parent[parent < 0] = 0
        if delta.max() < 1:
            delta *= 10
    return delta, parent


def spread(d: np.ndarray) -> np.ndarray:
    v = d[np.triu_indices(len(d), 1)]
    return v[v > 0]


def centres(score: np.ndarray, d: np.ndarray, k: int, rule: str = "separated", scale=None, near=None, tau: float = 0.20) -> list[int]:
    """Greedy selection in the order of the score, refilled by score up to k.

    top: no test. separated: at least max(q25, tau * median) from all chosen. basin: too close only if
    also neighbours. local: at least 0.8 of the mean local scale from each.
    """
    order = [int(i) for i in np.lexsort((np.arange(len(score)), -score))]
    k = max(1, min(k, len(order)))
    if rule == "top":
        return order[:k]
    v = spread(d)
    least = max(np.quantile(v, 0.25), tau * np.median(v), TINY) if len(v) else TINY
    chosen: list[int] = []

    def fits(i: int) -> bool:
        if rule == "local":
            return all(d[i, c] >= 0.4 * (scale[i] + scale[c]) for c in chosen)
        if rule == "basin":
            return not any(d[i, c] < least and (c in near[i] or i in near[c]) for c in chosen)
        return all(d[i, c] >= least for c in chosen)

    for i in order:
        if len(chosen) < k and fits(i):
            chosen.append(i)
    return chosen + [i for i in order if i not in chosen][: k - len(chosen)]


def proposals(gamma: np.ndarray, d: np.ndarray, delta: np.ndarray) -> list[list[int]]:
    """Centre lists of five rules on the sorted gammas: the largest relative drop, all of a fifth of the
    first, all over mean + deviation / 2 of the scaled ones, the elbow, the first two if the second is
    half as large and far. Of each list only what is farther than the median positive delta from all
    before stays; equal lists count once."""
    order = [int(i) for i in np.lexsort((np.arange(len(gamma)), -gamma))]
    g = gamma[order]
    if len(g) == 1 or np.allclose(g, g[0]):
        return [order[:1]]
    tau = float(np.median(delta[delta > 0])) if (delta > 0).any() else 0.0
    norm = (g - g.min()) / (g.max() - g.min() + TINY)
    drop = np.maximum((g[:-1] - g[1:]) / (np.abs(g[:-1]) + TINY), 0)
    chord = np.abs(np.linspace(0, 1, len(g)) * (norm[-1] - norm[0]) - (norm - norm[0]))
    strong = g[1] / (g[0] + TINY) >= 0.5 and d[order[0], order[1]] > tau
    sizes = [drop.argmax() + 1, np.flatnonzero(g >= 0.2 * g[0]).max(initial=0) + 1, np.flatnonzero(norm >= norm.mean() + 0.5 * norm.std()).max(initial=0) + 1, chord.argmax() + 1 if len(g) > 2 else 1, 1 + strong]
    out: list[list[int]] = []
    for k in sizes:
        kept: list[int] = []
        for i in order[: max(1, int(k))]:
            if all(d[i, c] > tau for c in kept):
                kept.append(i)
        if kept not in out:
            out.append(kept)
    return out


def simulated_score(kept: list[int], gamma: np.ndarray, parent: np.ndarray, d: np.ndarray) -> float:
    """Separation of the centres over mean distance to the own centre, + 0.35 of the share of gamma, less
    0.60 of the share of single-granule clusters, 0.25 of the sizes' variation, 0.20 of the centres' share."""
    label = chain(parent, kept, d)
    size = np.bincount(label, minlength=len(kept)).astype(float)
    outer = np.mean([d[a, b] for n, a in enumerate(kept) for b in kept[n + 1 :]]) if len(kept) > 1 else 0.0
    inner = np.mean([d[i, kept[c]] for i, c in enumerate(label)])
    vary = size.std() / (size.mean() + TINY) if len(kept) > 1 else 0.0
    return outer / (inner + TINY) + 0.35 * gamma[kept].sum() / (gamma.sum() + TINY) - 0.60 * (size <= 1).mean() - 0.25 * vary - 0.20 * len(kept) / len(gamma)


def best_count(gamma: np.ndarray, delta: np.ndarray, parent: np.ndarray, d: np.ndarray) -> list[int]:
    """The best scored of the proposals, the first of equal ones."""
    found = proposals(gamma, d, delta)
    scores = [simulated_score(kept, gamma, parent, d) for kept in found]
    return found[int(np.argmax(scores))]


def best_labels(gamma, rho, parent, d, counts, tau: float = 0.20, margin: float = 1.75, graph: bool = True) -> tuple[list[int], np.ndarray]:
    """(centres, labels) of the best internal score over numbers of centres, plain and by the graph;
    the first of equal ones."""
    best = None
    for k in counts:
        chosen = centres(gamma, d, k, tau=tau)
        plain = chain(parent, chosen, d)
        for label in [plain, graph_vote(rho, d, plain, chosen, margin)] if graph else [plain]:
            s = internal(d, rho, label)
            if best is None or s > best[0]:
                best = (s, chosen, label)
    return best[1], best[2]


def chain(parent: np.ndarray, chosen: list[int], d: np.ndarray, noise: bool = False) -> np.ndarray:
    label = np.full(len(parent), -1)
    label[chosen] = np.arange(len(chosen))
    for i in range(len(parent)):
        path, at = [], i
        while label[at] < 0 and parent[at] >= 0 and at not in path:
            path.append(at)
            at = parent[at]
        got = label[at] if label[at] >= 0 else (len(chosen) if noise else -1)
        if got >= 0:
            label[path] = got
    left = label < 0
    label[left] = len(chosen) if noise else d[np.ix_(np.flatnonzero(left), chosen)].argmin(axis=1)
    return label


def strong_graph(rho: np.ndarray, d: np.ndarray, chosen: list[int]) -> np.ndarray:
    """In the order of density each granule takes the vote of its nearest denser ones."""
    m = len(rho)
    k = max(2, math.ceil(math.log2(max(2, m))))
    v = spread(d)
    mid = np.median(v) if len(v) else 1.0
    label = np.full(m, -1)
    label[chosen] = np.arange(len(chosen))
    for i in np.lexsort((np.arange(m), -rho)):
        if label[i] >= 0:
            continue
        near = [j for j in np.argsort(d[i], kind="stable") if rho[j] > rho[i] and label[j] >= 0][:k]
        votes: dict[int, float] = {}
        for j in near:
            votes[label[j]] = votes.get(label[j], 0.0) + rho[j] / (d[i, j] + 1e-9 * mid)
        label[i] = max(votes, key=votes.get) if votes else int(d[i, chosen].argmin())
    return label


def graph_vote(rho, d, label, chosen, margin=1.75) -> np.ndarray:
    """One conservative round of votes; kept only if no cluster is over 85% and at most 35% change."""
    m = len(rho)
    k = max(2, math.ceil(math.log2(max(2, m))))
    v = spread(d)
    mid = np.median(v) if len(v) else 1.0
    new = label.copy()
    for i in set(range(m)) - set(chosen):
        votes: dict[int, float] = {}
        for j in [j for j in np.argsort(d[i], kind="stable") if rho[j] > rho[i]][:k]:
            votes[label[j]] = votes.get(label[j], 0.0) + rho[j] / (d[i, j] + 1e-9 * mid)
        if votes and (best := max(votes, key=votes.get)) != label[i] and votes[best] > margin * max(votes.get(label[i], 0.0), TINY):
            new[i] = best
    good = np.bincount(new).max() / m <= 0.85 and (new != label).mean() <= 0.35
    return new if good else label


def neighbours(d: np.ndarray, cap: int | None = None) -> tuple[int, list[list[int]], np.ndarray, np.ndarray]:
    """(lambda, mutual neighbours, ranks, occurrence) of the natural neighbour search."""
    m = len(d)
    rank = np.empty((m, m), int)
    for i in range(m):
        row = d[i].copy()
        row[i] = np.inf
        rank[i, np.argsort(row, kind="stable")] = np.arange(1, m + 1)
    mutual = np.maximum(rank, rank.T)
    np.fill_diagonal(mutual, m + 1)
    first, lam, streak, was = mutual.min(axis=1), max(1, m - 1), 0, -1
    for k in range(1, m):
        left = int((first > k).sum())
        streak = streak + 1 if left == was else 0
        was = left
        if left == 0 or streak >= math.ceil(math.log(m) + math.log(k)):
            lam = k
            break
    out = []
    for i in range(m):
        near = [int(j) for j in np.flatnonzero(mutual[i] <= lam)] or [int(rank[i].argmin())]
        near.sort(key=lambda j: (rank[i, j] + rank[j, i], d[i, j]))
        out.append(near[:cap] if cap else near)
    return lam, out, rank, (rank <= lam).sum(axis=0) / (m * lam)


def internal(d: np.ndarray, rho: np.ndarray, label: np.ndarray) -> float:
    found = np.unique(label)
    if len(found) < 2:
        return -1e18
    reps = [int(np.flatnonzero(label == c)[rho[label == c].argmax()]) for c in found]
    sep = np.mean([d[a, b] for n, a in enumerate(reps) for b in reps[n + 1 :]])
    comp = np.mean([d[np.ix_(label == c, label == c)].mean() for c in found])
    size = np.array([(label == c).mean() for c in found])
    return sep / (comp + TINY) * (0.2 if size.max() > 0.85 else 1) * (0.5 if size.min() < 0.02 else 1)


def agree(d, near, label) -> float:
    w = s = 0.0
    for i, js in enumerate(near):
        for j in js:
            w += 1 / (1 + d[i, j])
            s += (label[i] == label[j]) / (1 + d[i, j])
    return s / w if w else 0.0


def fuzzy(d, near, occ, n, rho, label, chosen, least=0.60, margin=0.15, closer=0.98) -> np.ndarray:
    """One-shot proposals by neighbours' votes: a granule moves where its best share is at least
    `least` and `margin` ahead, a denser neighbour is there and the nearest members are closer."""
    new = label.copy()
    for i in set(range(len(label))) - set(chosen):
        votes: dict[int, float] = {}
        for j in near[i]:
            w = math.sqrt(max(occ[j], TINY)) * rho[j] * math.sqrt(math.log1p(n[j])) / (1 + d[i, j])
            votes[label[j]] = votes.get(label[j], 0.0) + w
        total = sum(votes.values())
        best = max(votes, key=votes.get) if votes else label[i]
        if best == label[i] or total <= 0:
            continue
        share = votes[best] / total
        second = max((v for c, v in votes.items() if c != best), default=0.0) / total
        there, here = (np.sort(d[i][(label == c) & (np.arange(len(label)) != i)])[:3] for c in (best, label[i]))
        nearer = not len(here) or there.mean() < closer * here.mean()
        if share >= least and share - second >= margin and nearer and any(rho[j] > rho[i] and label[j] == best for j in near[i]):
            new[i] = best
    return new


def reliable(d, near, rho, n, label, chosen, share=0.70, rounds=2) -> np.ndarray:
    """Sweeps in the order of density that use labels just given; a vote counts from `share` on."""
    scale = np.array([max(max(d[i, js], default=0.0), TINY) for i, js in enumerate(near)])
    out = label.copy()
    for _ in range(rounds):
        for i in np.lexsort((np.arange(len(rho)), -rho)):
            if i in chosen:
                continue
            votes: dict[int, float] = {}
            for j in near[i]:
                votes[out[j]] = votes.get(out[j], 0.0) + math.exp(-((d[i, j] / scale[i]) ** 2)) * rho[j] * math.sqrt(n[j])
            total = sum(votes.values())
            if total > 0 and votes[best := max(votes, key=votes.get)] / total >= share:
                out[i] = best
    return out


def accept(d, rho, n, near, old, new, largest=0.85, changed=0.35, smallest=0.0, gain=0.0) -> np.ndarray:
    """new if it keeps the clusters and the limits and neither score nor consistency falls."""
    share = np.bincount(new, weights=n, minlength=old.max() + 1) / n.sum()
    ok = (new != old).any() and len(np.unique(new)) == len(np.unique(old)) and share.max() <= largest and share[share > 0].min() >= smallest and (new != old).mean() <= changed
    a, b = internal(d, rho, old), internal(d, rho, new)
    return new if ok and b + TINY >= a * (1 + gain) and agree(d, near, new) + TINY >= agree(d, near, old) else old
