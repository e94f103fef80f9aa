"""The metric index and the propagation rounds against plain sequential readings."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from granula.functions.state import durable
from granula.operators import dpc, granule, graph, index, natural


def cloud(m, dims, seed, blobs=5):
    r = np.random.default_rng(seed)
    x = r.normal(size=(m, dims)) * r.choice([0.2, 1.0], size=(m, 1)) + 3.0 * r.integers(0, blobs, size=(m, 1))
    x[m // 2 : m // 2 + 9] = x[0]  # ties
    return x, np.round(r.gamma(2, size=m), 1), r.integers(1, 30, size=m)


def table(spark, x, rho, n):
    return spark.createDataFrame([(i, float(rho[i]), [float(v) for v in x[i]], int(n[i])) for i in range(len(x))], "g long, density double, centre array<double>, n long")


def gaps(x):
    return np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))


@pytest.mark.parametrize("dims", [1, 6])
def test_the_index_finds_the_nearest_of_all_pairs_and_touches_few(spark, monkeypatch, dims):
    monkeypatch.setattr(index, "BLOCK", 40)  # many groups for each cell
    x, rho, n = cloud(900, dims, dims)
    d = gaps(x)
    rows = durable(index.balls(table(spark, x, rho, n)))
    got = index.nearest(rows, 4)
    np.fill_diagonal(d, np.inf)
    want = {(i, int(j), k + 1) for i in range(900) for k, j in enumerate(np.argsort(d[i], kind="stable")[:4])}
    assert {(a.i, a.j, a.r) for a in got.links.collect()} == want
    assert got.touched < 900 * 900 / 2
    up = np.where(rho[None] > rho[:, None], d, np.inf)
    want = {(i, int(j)) for i in range(900) for j in np.argsort(up[i], kind="stable")[:3] if np.isfinite(up[i, j])}
    assert {(a.i, a.j) for a in index.nearest(rows, 3, denser=True).links.collect()} == want


def test_the_index_in_the_granules_shapes(spark):
    r = np.random.default_rng(4)
    rows = [(i, *map(float, r.normal(size=2) * [3, 0.3] + 4 * r.integers(0, 9, size=2)), int(r.integers(0, 90))) for i in range(900)]
    g = durable(granule.granules(spark.createDataFrame(rows, "id long, x double, y double, g long")))
    pairs = durable(dpc.mahalanobis_pairs(g))
    want = {(a.i, a.j, a.r) for a in natural.ranks(pairs).where("r <= 5").collect()}
    assert {(a.i, a.j, a.r) for a in index.nearest(index.plane(g), 5).links.collect()} == want
    assert {(a.i, a.j, a.r) for a in index.zero_based(index.nearest(index.plane(g), 5).links).collect()} == {(i, j, k - 1) for i, j, k in want}
    near = {a.g: (a.parent, round(a.delta, 9)) for a in dpc.attributes(g, pairs).collect()}
    assert {a.g: (a.parent, round(a.delta, 9)) for a in index.attributes(durable(index.plane(g))).collect()} == near


def test_the_index_on_few_granules(spark):
    one = index.balls(table(spark, np.zeros((1, 2)), [1.0], [3]))
    assert index.nearest(one, 3).links.collect() == [] == index.nearest(one.limit(0), 3).links.collect()
    assert [(a.delta, a.parent) for a in index.attributes(one).collect()] == [(0.0, None)]


def in_order(rho):
    return sorted(range(len(rho)), key=lambda i: (-rho[i], i))


def test_strong_graph_equals_the_walk_in_the_order_of_density(spark):
    x, rho, n = cloud(160, 3, 7)
    m, d = len(x), gaps(x)
    k = max(2, math.ceil(math.log2(m)))
    chosen = in_order(rho)[:40:9]
    rows = durable(index.balls(table(spark, x, rho, n)))
    links = durable(graph.strong_links(rows))
    mid = np.median([a.d for a in links.collect() if a.d > 0])
    label = np.full(m, -1)
    label[chosen] = range(len(chosen))
    near = [int(d[i, chosen].argmin()) for i in range(m)]
    for i in in_order(rho):
        if label[i] < 0:
            up = [j for j in np.argsort(d[i], kind="stable") if rho[j] > rho[i]][:k]
            votes = {}
            for j in up:
                votes[label[j]] = votes.get(label[j], 0.0) + rho[j] / (d[i, j] + 1e-9 * mid)
            label[i] = max(votes, key=votes.get) if votes else near[i]
    c = spark.createDataFrame([(g, k) for k, g in enumerate(chosen)], "g long, label int")
    got = graph.strong_graph(links, rows, c, spark.createDataFrame(list(enumerate(near)), "g long, near int"))
    assert {a.g: a.label for a in got.collect()} == dict(enumerate(label.tolist()))


def test_reliable_equals_the_sweeps_one_by_one(spark):
    x, rho, n = cloud(120, 2, 9, 4)
    m, d = len(x), gaps(x)
    np.fill_diagonal(d, np.inf)
    rank = np.argsort(np.argsort(d, axis=1, kind="stable"), axis=1, kind="stable") + 1
    links = sorted((i, int(rank[i, j]), j) for i in range(m) for j in range(m) if i != j and max(rank[i, j], rank[j, i]) <= 6)
    near = {i: [j for a, _, j in links if a == i] for i in range(m)}
    chosen = in_order(rho)[:60:15]
    label, sure = np.full(m, -1), np.zeros(m)
    label[chosen], sure[chosen] = range(len(chosen)), 1.0
    sweeps, more = 0, True
    while more:
        more, sweeps = False, sweeps + 1
        for i in in_order(rho):
            if label[i] >= 0:
                continue
            gap = [d[i, j] for j in near[i] if d[i, j] > 0]
            scale, votes = (np.median(gap) if gap else 1.0), {}
            for j in near[i]:
                if label[j] >= 0:
                    votes[label[j]] = votes.get(label[j], 0.0) + math.exp(-((d[i, j] / scale) ** 2)) * max(rho[j], 1e-12) * math.sqrt(n[j])
            if votes and (best := max(votes, key=votes.get)) >= 0 and votes[best] / (sum(votes.values()) + 1e-12) >= 0.7:
                label[i], sure[i], more = best, votes[best] / (sum(votes.values()) + 1e-12), True
    assert sweeps > 2 and (label >= 0).sum() > len(chosen)
    e = spark.createDataFrame([(i, j, float(d[i, j]), r) for i, r, j in links], "i long, j long, d double, r int")
    c = spark.createDataFrame([(g, k) for k, g in enumerate(chosen)], "g long, label int")
    got = graph.reliable(e, table(spark, x, rho, n).withColumnRenamed("density", "rho"), c).collect()
    assert {a.g: -1 if a.label is None else a.label for a in got} == dict(enumerate(label.tolist()))
    assert all(abs(a.confidence - sure[a.g]) < 1e-9 for a in got)


def test_propagation_without_links(spark):
    g = spark.createDataFrame([(1, 1.0, 2), (2, 0.5, 2)], "g long, rho double, n long")
    c = spark.createDataFrame([(1, 0)], "g long, label int")
    none = spark.createDataFrame([], "i long, j long, d double, r int")
    assert sorted((a.g, a.label, a.confidence) for a in graph.reliable(none, g, c).collect()) == [(1, 0, 1.0), (2, None, 0.0)]
    strong = graph.strong_graph(none.withColumn("rho_j", F.lit(1.0)), g, c, spark.createDataFrame([(2, 0)], "g long, near int"))
    assert sorted((a.g, a.label) for a in strong.collect()) == [(1, 0), (2, 0)]
