"""Steps of large granules against the plain reading of one task."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from granula.functions import shapes
from granula.plans import pipelines


@pytest.mark.parametrize(("n", "d", "step"), [(300, 64, 0), (300, 3, 0.5), (5, 1, 1), (9000, 2, 0.25)])
def test_the_farthest_pair_by_products_is_the_first_of_all(n, d, step):
    x = np.random.default_rng(d).normal(size=(n, d)) + 1000
    x = np.round(x / step) * step if step else x  # ties
    best, want = -1.0, None
    for i in range(n):
        gap = ((x[i] - x[i:]) ** 2).sum(axis=1)
        if gap.max() > best:
            best, want = gap.max(), (i, i + int(gap.argmax()))
    assert shapes.farthest_pair(x, 5000 if n < 1000 else 1 << 22) == want


def test_two_means_by_sums_give_the_halves_of_one_task(spark, monkeypatch):
    r = np.random.default_rng(3)
    x = np.concatenate([r.normal(size=(150, 5)) + 2 * k for k in (0, 1)])
    x[150:180] = x[150]
    p = spark.createDataFrame([(i, [float(v) for v in x[i]], "r" if i % 3 else "s") for i in range(300)], "point_id long, features array<double>, g string")
    writes = []
    durable = pipelines.durable
    monkeypatch.setattr(pipelines, "durable", lambda t: writes.append(1) or durable(t))
    got = {a.point_id: a.child for a in pipelines.split_level(p.repartition(3), pipelines.CONFIGS["ball_dpc_2means"]).collect()}
    assert len(writes) <= 6  # not a table for each round
    for g in (np.flatnonzero(np.arange(300) % 3 > 0), np.arange(0, 300, 3)):
        assert [got[i] for i in g] == list(shapes.halves(x[g], "full", 1, "means"))


def test_far_granules_are_asked_by_bundles_where_bounds_tell_little(spark, monkeypatch):
    from granula.operators import index

    monkeypatch.setattr(index, "BLOCK", 40)
    x = np.random.default_rng(9).normal(size=(300, 48))
    x[200:205] = x[0]
    rows = spark.createDataFrame([(i, float(i % 7), [float(v) for v in x[i]], [], 1.0) for i in range(300)], "g long, rho double, centre array<double>, cov array<double>, top double")
    asked, ask = [], index._ask
    monkeypatch.setattr(index, "_ask", lambda data, queries, *a: asked.append(queries.count()) or ask(data, queries, *a))
    got = {(a.i, a.j, a.r) for a in index.nearest(rows, 3).links.collect()}
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    np.fill_diagonal(d, np.inf)
    assert got == {(i, int(j), k + 1) for i in range(300) for k, j in enumerate(np.argsort(d[i], kind="stable")[:3])}
    assert max(asked) <= 300 * 3  # not once for each of 18 cells
