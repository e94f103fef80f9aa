"""What the farthest-pair split writes and shuffles, and its pairs among copies and near ties."""

import os

import numpy as np
import pytest

from granula.functions import shapes, state
from granula.operators import tree
from granula.plans import pipelines


def shuffled(spark):
    e = spark.sparkContext._jsc.sc().statusStore().executorList(True)
    return sum(e.apply(i).totalShuffleWrite() for i in range(e.size()))


def written(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, files in os.walk(path) for f in files if f.endswith(".parquet"))


def table(spark, x, g=lambda i: "r"):
    return spark.createDataFrame([(i, [float(v) for v in x[i]], g(i)) for i in range(len(x))], "point_id long, features array<double>, g string")


def test_pairs_of_blocks_are_not_shuffled(spark, monkeypatch):
    monkeypatch.setattr(tree, "BLOCK", 20)
    x = np.random.default_rng(1).normal(size=(3000, 32))
    x /= np.linalg.norm(x, axis=1)[:, None]  # all about as far from the centre: each block meets each
    p = state.durable(table(spark, x))
    before = shuffled(spark)
    got = tree.farthest_pairs(p).first()
    i, j = shapes.farthest_pair(x)
    assert (got.a, got.b) == (list(x[i]), list(x[j]))
    assert shuffled(spark) - before < 4 * x.nbytes


def test_a_level_s_tables_are_deleted_after_it(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(state, "shared_dir", lambda _: str(tmp_path))
    x = np.random.default_rng(2).normal(size=(3000, 16))
    most = []
    split_level = pipelines.split_level
    monkeypatch.setattr(pipelines, "split_level", lambda *a: most.append(written(tmp_path)) or split_level(*a))
    pipelines.granulate(table(spark, x).drop("g"), pipelines.CONFIGS["ball_dpc_tree"], 100)
    one = 1.5 * x.nbytes  # points once, with ids and what parquet adds
    assert len(most) > 5 and max(most) < 2 * one
    assert written(tmp_path) < 2 * one


def test_the_first_of_tied_pairs_among_copies_whatever_the_buffers(spark, monkeypatch):
    monkeypatch.setattr(tree, "BLOCK", 4)  # a task's buffer holds 64 points
    x = np.round(np.random.default_rng(3).normal(size=(700, 2)) * 2)
    x[600:] = x[:100]
    x[300:400] = x[7]
    at = {g: np.flatnonzero([i % 2 == g for i in range(700)]) for g in (0, 1)}
    got = {r.g: (r.a, r.b) for r in tree.farthest_pairs(table(spark, x, lambda i: str(i % 2)).repartition(2)).collect()}
    for g, ids in at.items():
        y = x[ids]
        gap = ((y[:, None] - y[None]) ** 2).sum(axis=2)
        i, j = np.argwhere(np.triu(gap == gap.max()))[0]
        assert got[str(g)] == (list(y[i]), list(y[j]))
    same = table(spark, np.ones((100, 2)))
    assert [(r.a, r.b) for r in tree.farthest_pairs(same).collect()] == [([1.0, 1.0], [1.0, 1.0])]
    assert {r.child for r in tree.split(same).collect()} == {0}


@pytest.mark.parametrize("far", [1e3, 1e6])
def test_pairs_closer_than_single_precision_are_told_apart(far):
    r = np.random.default_rng(4)
    x = r.normal(size=(400, 5)) * 1e-3
    x[200:, 0] += far
    gap = np.stack([((a - x) ** 2).sum(axis=1) for a in x])
    i, j = np.argwhere(np.triu(gap == gap.max()))[0]
    assert shapes.farthest_pair(x) == (i, j)
    assert shapes.farthest_pair(x, 5000) == (i, j)


def test_qualities_of_large_granules(spark):
    x = np.random.default_rng(5).normal(size=(90, 3))
    got = {r.g: r.quality for r in tree.qualities(table(spark, x, lambda i: str(i % 2)).repartition(3)).collect()}
    for g in (0, 1):
        y = x[g::2]
        assert got[str(g)] == pytest.approx(45 * np.exp(-0.5 * np.sqrt(((y - y.mean(axis=0)) ** 2).sum(axis=1)).max()))
