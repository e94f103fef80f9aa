"""Small fixtures with values worked out by hand or by plain loops: formulas, greedy choice, the grid."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from granula.functions import folds, shapes
from granula.operators import candidates, dpc, granule, grid, labels, natural, shape


def test_the_cap_comes_before_the_penalties(spark):
    g = spark.createDataFrame([(1, 3, 100.0, 1.0, 1.0), (2, 3, 2.0, 1.0, 1.0), (3, 9, 100.0, 1.0, 1.0), (4, 9, 100.0, 1e-6, 1e-6), (5, 1, 50.0, 1.0, 1.0)], "g long, n long, density double, a double, c double")
    got = {r.g: r.penalised for r in granule.penalised(g, 4).collect()}
    assert got == pytest.approx({1: 3 * 0.2, 2: 2 * 0.2, 3: 100.0, 4: 5.0, 5: 1 * 0.2 * 0.05})


def test_penalised_granules_in_any_dimension_agree_with_the_kernel(spark):
    r = np.random.default_rng(1)
    rows = [(i, [float(x) for x in r.normal(size=3) * (0 if g == 2 else 1)], g) for g, n in ((0, 3), (1, 40), (2, 6)) for i in range(100 * g, 100 * g + n)]
    p = spark.createDataFrame(rows, "point_id long, features array<double>, g long")
    got = {x.g: x for x in shape.granules(p, "adaptive").collect()}
    for g in range(3):
        s = shapes.Shape(np.array([f for _, f, k in rows if k == g]), "adaptive")
        assert got[g].density == pytest.approx(s.density) and got[g].penalised == pytest.approx(s.penalised())


def test_adaptive_branches():
    r = np.random.default_rng(3)
    small = shapes.Shape(r.normal(size=(3, 4)), "adaptive")
    medium = shapes.Shape(r.normal(size=(63, 30)), "adaptive")
    sketch = shapes.Shape(r.normal(size=(64, 24)), "adaptive")
    assert [s.mode for s in (small, medium, sketch, shapes.Shape(np.ones((5, 2)), "adaptive"))] == ["small", "medium", "sketch", "degenerate"]
    cov = np.linalg.eigvalsh(np.cov(r.normal(size=(9, 3)).T, bias=True))
    assert len(small.eig) == 4 and small.tail == small.eig.min()  # all axes, the flat ones too
    assert small.eig.min() == pytest.approx(1e-6 * max(small.whole.sum() / 4, 1.0), rel=1e-3)
    assert len(medium.eig) == 11 and medium.tail == pytest.approx(medium.whole[11:].mean())
    x = r.normal(size=(80, 24))
    s = shapes.Shape(x, "adaptive")
    e = np.linalg.eigvalsh(np.cov(x.T, bias=True))[::-1]
    assert s.eig == pytest.approx(e[:10]) and s.tail == pytest.approx(e[10:].sum() / 14)  # no shrinkage here
    assert s.squared(x)[0] == pytest.approx(((x[0] - x.mean(axis=0)) @ s.basis) ** 2 @ (1 / s.eig) + (((x[0] - x.mean(axis=0)) ** 2).sum() - (((x[0] - x.mean(axis=0)) @ s.basis) ** 2).sum()) / s.tail)
    assert len(cov) == 3


def star(spark):
    """A hub 0 with neighbours 1 to 3, and 4 beside 3."""
    links = [(0, 1, 1.0), (0, 2, 2.0), (0, 3, 4.0), (3, 4, 0.5)]
    rows = [(i, j, d, 1, 2) for a, b, d in links for i, j in ((a, b), (b, a))]
    return spark.createDataFrame(rows, "i long, j long, d double, r int, s int"), links


def test_support_counts_lists_over_their_median(spark):
    e, _ = star(spark)
    g = spark.createDataFrame([(i,) for i in range(6)], "g long")
    got = {r.g: r.support for r in natural.support(e, g).collect()}
    assert got == {0: 3.0, 1: 1.0, 2: 1.0, 3: 2.0, 4: 1.0, 5: 0.0}  # in-degrees 3, 1, 1, 2, 1, median 1


def test_assisted_gamma_takes_the_spread_of_support(spark):
    d = spark.createDataFrame([(i, float(10 ** i), 1.0) for i in range(5)], "g long, rho double, gamma double")
    sup = spark.createDataFrame([(0, 0.0), (1, 1.0), (2, 1.0), (3, 2.0), (4, 3.0)], "g long, support double")
    none = spark.createDataFrame([(i, 0.0) for i in range(5)], "g long, prominence double")
    got = {r.g: r.gamma for r in dpc.natural_gamma(d, none, sup).collect()}
    assert got == pytest.approx({0: math.exp(-0.5), 1: 1.0, 2: 1.0, 3: math.exp(0.5), 4: math.exp(1.0)}, rel=1e-6)


def test_natural_weighted_density_by_hand(spark):
    e, links = star(spark)
    rho, n, occ = [8.0, 1.0, 2.0, 4.0, 0.5], [9, 3, 4, 5, 2], [0.5, 0.25, 0.125, 0.25, 0.125]
    g = spark.createDataFrame([(i, n[i], rho[i]) for i in range(5)], "g long, n long, density double")
    o = spark.createDataFrame(list(enumerate(occ)), "g long, occurrence double")
    near = {i: {} for i in range(5)}
    for a, b, d in links:
        near[a][b] = near[b][a] = d

    def unit(v):
        lo, hi = np.quantile(v, [0.05, 0.95])
        return np.clip((np.array(v) - lo) / (hi - lo), 0, 1)

    own = unit(np.log1p(rho))
    scale = [np.median(list(near[i].values())) for i in range(5)]
    sim = lambda i, j: 0.5 * math.exp(-(near[i][j] ** 2) / (scale[i] * scale[j])) + 0.5 / 4
    raw = [sum(sim(i, j) * occ[j] ** 0.5 * math.log1p(n[j]) ** 0.5 * (0.5 + 0.5 * own[j]) for j in near[i]) for i in range(5)]
    rel = [rho[i] / np.median([rho[j] for j in near[i]]) for i in range(5)]
    want = 0.55 * own + 0.25 * unit(np.log1p(raw)) + 0.2 * unit(np.log1p(rel))
    got = {r.g: r.weighted for r in natural.weighted_density(e, g, o).collect()}
    assert [got[i] for i in range(5)] == pytest.approx(want, abs=1e-9)


def test_ambiguity_flags(spark):
    e, _ = star(spark)
    lab = spark.createDataFrame([(0, 0, 1.0), (1, 0, 0.5), (2, None, 0.0), (3, 1, 0.9), (4, 1, 0.9)], "g long, label int, confidence double")
    d = spark.createDataFrame([(0, 99.0, None), (1, 1.0, 0), (2, 2.0, 0), (3, 4.0, 0), (4, 9.0, 3)], "g long, delta double, parent long")
    got = {r.g: {k for k in ("open", "weak", "mixed", "wide", "far") if r[k]} for r in natural.ambiguous(e, lab, d).collect()}
    # Radii 4, 1, 2, 4, 0.5: the limit is 2 + 1.5 * 1.5 = 4.25. 0 has no parent, so its delta is none.
    assert got == {0: {"mixed"}, 1: {"weak"}, 2: {"open"}, 3: {"mixed"}, 4: {"far"}}


def test_merged_clusters_take_the_denser_ones_name(spark):
    d = spark.createDataFrame([(0, 1.0), (1, 9.0), (2, 5.0), (3, 4.0)], "g long, rho double")
    lab = spark.createDataFrame([(0, 0), (1, 2), (2, 1), (3, 3)], "g long, label int")
    at = [0.0, 0.1, 5.0, 9.0]
    pairs = spark.createDataFrame([(i, j, abs(at[i] - at[j])) for i in range(4) for j in range(4) if i != j], "i long, j long, d double")
    # The limit is 4: labels 0 and 2 become 2, the denser one, and 1 and 3 become 1, which comes first.
    assert {r.g: r.label for r in labels.merge_light(d, lab, pairs).collect()} == {0: 1, 1: 1, 2: 0, 3: 0}


@pytest.mark.parametrize("seed", [0, 1])
def test_greedy_rounds_equal_the_walk(spark, seed):
    r = np.random.default_rng(seed)
    m = 120
    order = [(int(g), k + 1) for k, g in enumerate(r.permutation(m))]
    conflicts = {(int(a), int(b)) for a, b in r.integers(0, m, size=(400, 2)) if a != b}
    if seed:  # a chain that follows the order: the longest way
        conflicts |= {(order[k][0], order[k + 1][0]) for k in range(12)}
    both = conflicts | {(b, a) for a, b in conflicts}
    chosen = []
    for g, _ in order:
        if not any((g, c) in both for c in chosen):
            chosen.append(g)
    o = spark.createDataFrame(order, "g long, pick int")
    c = spark.createDataFrame(sorted(conflicts), "g long, h long")
    for most in (1, 5, 1000):
        assert [x.g for x in dpc.greedy(o, c, most).orderBy("pick").collect()] == chosen[:most]


@pytest.mark.parametrize(("dims", "bins"), [(1, 6), (5, 4), (9, 5)])
def test_touching_cells_and_regions_in_any_dimension(spark, dims, bins):
    r = np.random.default_rng(dims)
    x = np.clip(r.normal(0.5, 0.25, size=(150, dims)), 0, 1)
    p = spark.createDataFrame([(i, [float(v) for v in x[i]]) for i in range(len(x))], "id long, features array<double>")
    key = np.minimum(bins - 1, np.floor(x * bins)).astype(int)
    node = {}
    for i, k in enumerate(map(tuple, key)):
        node.setdefault(k, i)
    want = {(node[a], node[b]) for a in node for b in node if a != b and max(abs(np.subtract(a, b))) <= 1}
    celled = grid.cells(p, bins)
    occ = grid.occupied(celled)
    touch = grid.adjacent(occ)
    assert {(a.u, a.v) for a in touch.collect()} == want
    root = {i: i for i in node.values()}
    for _ in root:
        for u, v in want:
            root[u] = root[v] = min(root[u], root[v])
    comp = grid.components(occ, touch)
    assert {a.node: a.component for a in comp.collect()} == root
    of = [root[node[tuple(k)]] for k in key]
    size = {c: of.count(c) for c in set(of)}
    order = sorted((c for c in size if size[c] >= 2), key=lambda c: (-size[c], c))
    got = {a.id: a.seed for a in grid.seeds(celled, comp, occ, 2).collect()}
    assert got == {i: order.index(c) if c in order else -1 for i, c in enumerate(of)}


def test_an_empty_grid(spark):
    occ = grid.occupied(grid.cells(spark.createDataFrame([], "id long, features array<double>"), 4))
    assert grid.adjacent(occ).collect() == [] and grid.components(occ, grid.adjacent(occ)).select(F.count("*")).first()[0] == 0


@pytest.mark.parametrize("seed", [1, 4, 8])
def test_scored_lists_equal_the_lists_one_by_one(spark, seed):
    r = np.random.default_rng(seed)
    x = r.normal(size=(50, 2)) + 5 * r.integers(0, 3, size=(50, 1))
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    rho = r.gamma(2, size=50)
    delta, parent = folds.peaks(rho, d)
    table = spark.createDataFrame([(i, float(rho[i]), float(delta[i]), int(parent[i]) if parent[i] >= 0 else None, float(rho[i] * delta[i])) for i in range(50)], "g long, rho double, delta double, parent long, gamma double")
    pairs = spark.createDataFrame([(i, j, float(d[i, j])) for i in range(50) for j in range(50) if i != j], "i long, j long, d double")
    lists, best = candidates.scored(table, pairs)
    want = {len(k): folds.simulated_score(k, rho * delta, parent, d) for k in folds.proposals(rho * delta, d, delta)}
    assert {a.k: a.score for a in lists.collect()} == pytest.approx(want)
    assert [a.g for a in best.orderBy("label").collect()] == folds.best_count(rho * delta, delta, parent, d)
