"""The distributed clustering step against the folds, which walk dense matrices."""

from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from granula.functions.state import durable
from granula.operators import index
from granula.plans import cluster, pipelines


def stats_table(spark, m, dims, seed, ties=True):
    r = np.random.default_rng(seed)
    x = r.normal(size=(m, dims)) + 4.0 * r.integers(0, 4, size=(m, 1))
    rho = np.round(r.gamma(2, size=m), 1 if ties else 9)
    rows = []
    for i in range(m):
        a = r.normal(size=(dims, dims)) * 0.3
        rows.append((f"r{i:05b}", int(r.integers(1, 30)), [float(v) for v in x[i]], [float(v) for v in (a @ a.T + 0.2 * np.eye(dims)).ravel()], float(rho[i])))
    return durable(spark.createDataFrame(rows, "g string, n long, centre array<double>, h array<double>, rho double"))


def both(stats, cfg):
    got = cluster.cluster(stats, cfg).toPandas().sort_values("g").reset_index(drop=True)
    fold = stats.withColumn("one", F.lit(1)).groupBy("one").applyInPandas(pipelines._fold(cfg), "g string, label int, delta double, gamma double")
    return got, fold.toPandas().sort_values("g").reset_index(drop=True)


CASES = {
    "adaptive": pipelines.Config(graph=True, k=4),
    "noise": pipelines.Config(centres="top", delta="row", labels="noise", k=3),
    "strong": pipelines.Config(labels="strong", k=4),
    "ball": pipelines.Config(density="ball", delta="ball", centres="top", k=5),
    "size": pipelines.Config(density="size", delta="ordered", centres="top", k=3),
    "more": pipelines.Config(k=500),
    "counts": pipelines.Config(graph=True, counts=(2, 4)),
    "scored": pipelines.Config(centres="scored"),
}


@pytest.mark.parametrize("name", CASES)
def test_cluster_equals_the_fold(spark, monkeypatch, name):
    monkeypatch.setattr(index, "BLOCK", 24)  # several cells and blocks
    monkeypatch.setattr(cluster, "BATCH", 7)
    monkeypatch.setattr(cluster, "BINS", 16)
    cfg = CASES[name]
    got, want = both(stats_table(spark, 70, 3, 5, ties=cfg.delta in ("ordered", "ball")), cfg)
    assert (got.g == want.g).all() and (got.label == want.label).all()
    assert np.allclose(got.delta, want.delta) and np.allclose(got.gamma, want.gamma)


def test_one_granule(spark):
    got = cluster.cluster(stats_table(spark, 1, 2, 1), pipelines.Config()).collect()
    assert [(x.label, x.delta) for x in got] == [(0, 0.0)]


def test_quantiles_of_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(index, "BLOCK", 9)
    monkeypatch.setattr(cluster, "BINS", 8)
    r = np.random.default_rng(2)
    x = np.round(r.normal(size=(40, 2)), 1)
    rows = spark.createDataFrame([(i, [float(v) for v in x[i]], []) for i in range(40)], "g long, centre array<double>, cov array<double>")
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))[np.triu_indices(40, 1)]
    for shares in ((0.25, 0.5), (0.0, 1.0), (0.333,)):
        assert np.allclose(cluster.quantiles(rows, 40, shares), np.quantile(d[d > 0], shares))
    assert cluster.quantiles(rows.limit(1), 1, (0.5,)) == [0.0]


@pytest.mark.parametrize("name", ["nn_refined_dpc", "weighted_nn_dpc", "fuzzy_nn_dpc"])
def test_refined_runs_label_every_granule_with_the_centres_labels(spark, name):
    stats = stats_table(spark, 60, 2, 3, ties=False)
    got = cluster.cluster(stats, replace(pipelines.CONFIGS[name], k=4)).collect()
    assert len({x.g for x in got}) == len(got) == 60
    assert {x.label for x in got} == {0, 1, 2, 3} and all(x.delta >= 0 for x in got)
