"""Kernels, folds and pipelines against plain re-derivations and invariants."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from granula.functions import folds, shapes
from granula.operators import score
from granula.plans import pipelines
from granula.sources import io


def blobs(m):
    """Two tilted ellipses of m points each, on a spiral of golden angles."""
    k = np.arange(m) + 0.5
    unit = np.sqrt(k / m)[:, None] * np.stack([np.cos(2.399963 * k), np.sin(2.399963 * k)], axis=1)
    left, right = unit * [2.5, 0.4], unit * [1.7, 0.6]
    tilt = np.array([[0.94, 0.34], [-0.34, 0.94]])
    return np.concatenate([left @ tilt - [3.1, 0.4], right @ tilt.T + [2.6, 1.2]])


@pytest.fixture(scope="module")
def points(spark):
    x = blobs(90)
    return spark.createDataFrame([(i, [float(v) for v in row], int(i >= 90)) for i, row in enumerate(x)], "point_id long, features array<double>, label int")


@pytest.mark.parametrize("kind", ["full", "inverse", "pinv", "lowrank", "auto"])
def test_full_rank_shapes_agree(kind):
    x = blobs(60)
    a, b = shapes.Shape(x), shapes.Shape(x, kind, rank=2)
    assert np.allclose(a.squared(x), b.squared(x), rtol=1e-4)
    assert np.isclose(a.density, b.density, rtol=1e-3)
    assert (a.squared(x) <= a.rho**2 * (1 + 1e-9)).all()


def test_degenerate_shapes():
    one = shapes.Shape(np.array([[1.0, 2.0]]))
    assert one.rho == 0 and one.density == pytest.approx(1e24)
    assert shapes.Shape(np.ones((5, 2)), "adaptive").flat
    assert shapes.halves(np.ones((5, 2))) is None
    line = np.arange(10.0)[:, None]
    assert shapes.halves(line) is not None


def test_lowrank_distance_equals_the_dense_one():
    r = np.random.default_rng(3)
    for d, ranks in ((2, (1, 1)), (9, (3, 2)), (5, (0, 2)), (4, (0, 0))):
        sides = [(np.linalg.qr(r.normal(size=(d, d)))[0][:k], r.uniform(0.1, 4, k)) for k in ranks]
        h = sum(u.T * e @ u for u, e in sides) / 2 + 1e-3 * np.eye(d)
        x = r.normal(size=d)
        assert shapes.lowrank_distance(x, sides, 1e-3) == pytest.approx(float(np.sqrt(x @ np.linalg.solve(h, x))), rel=1e-6)


@pytest.mark.parametrize("name", ["ellipsoid_dpc", "adaptive_dpc", "ball_dpc_tree", "ball_dpc_dm", "nn_candidate_dpc", "fuzzy_nn_dpc", "weighted_nn_dpc", "gridseed_dpc"])
def test_pipelines_label_every_point(points, name):
    from dataclasses import replace

    out = pipelines.run(points, replace(pipelines.CONFIGS[name], k=2, dims=2))
    rows = out["assignments"].collect()
    assert sorted(r.point_id for r in rows) == list(range(180))
    assert all(r.label is not None and r.label >= 0 for r in rows)
    assert out["granules"].agg(F.sum("n")).first()[0] == 180


def test_pipelines_use_all_components(spark):
    from dataclasses import replace

    r = np.random.default_rng(9)  # the groups differ in the last of 12 components alone
    x = np.concatenate([r.normal(size=(80, 11)) * 0.1, np.repeat([0.0, 50.0], 40)[:, None]], axis=1)
    p = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "point_id long, features array<double>")
    out = pipelines.run(p, replace(pipelines.CONFIGS["adaptive_dpc"], k=2, scaler="none"))
    assert {len(q.centre) for q in out["granules"].collect()} == {12}
    label = {q.point_id: q.label for q in out["assignments"].collect()}
    assert len({label[i] for i in range(40)} & {label[i] for i in range(40, 80)}) == 0


def test_distributed_levels_give_the_same_leaves(points):
    from dataclasses import replace

    cfg = replace(pipelines.CONFIGS["adaptive_dpc"], rounds=0, dims=2)
    parts = []
    for most in (10_000, 20):
        rows = pipelines.granulate(points.select("point_id", "features"), cfg, most)[0].collect()
        parts.append({r.point_id: r.g for r in rows})
    assert parts[0] == parts[1]


@pytest.mark.parametrize(("name", "least"), [("lowrank_dpc", 1), ("autorank_dpc", 1), ("adaptive_shape_dpc", 2), ("adaptive_shape_dpc", 30), ("pinv_dpc", 1), ("ellipsoid_dpc", 1)])
def test_distributed_levels_use_the_configured_shape(spark, name, least):
    from dataclasses import replace

    r = np.random.default_rng(8)
    x = r.normal(size=(300, 24)) * np.linspace(0.2, 3, 24) + 4 * r.integers(0, 2, (300, 1))
    p = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "point_id long, features array<double>")
    cfg = replace(pipelines.CONFIGS[name], rounds=0, min_leaf=least)
    parts = [{q.point_id: q.g for q in pipelines.granulate(p, cfg, most)[0].collect()} for most in (10_000, 60)]
    assert parts[0] == parts[1]
    assert len(set(parts[0].values())) > 2


def test_natural_neighbours_closed_form_equals_rounds():
    r = np.random.default_rng(3)
    for _ in range(20):
        x = r.standard_cauchy((25, 2))
        d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
        lam, near, rank, _ = folds.neighbours(d)
        m, was, streak = len(d), None, 0
        for k in range(1, m):
            empty = {i for i in range(m) if not any(rank[i, j] <= k and rank[j, i] <= k for j in range(m) if j != i)}
            streak = streak + 1 if empty == was else 0
            was = empty
            if not empty or streak >= np.ceil(np.log(m) + np.log(k)):
                break
        assert lam == k


def test_alignment_is_the_best_of_all_permutations():
    r = np.random.default_rng(5)
    for _ in range(20):
        g = r.integers(0, 30, (5, 5)).tolist()
        got = sum(g[i][c] for i, c in enumerate(score._assign(g)))
        assert got == max(sum(g[i][p[i]] for i in range(5)) for p in itertools.permutations(range(5)))


def test_wilcoxon_p_by_enumeration():
    stats = [sum(r for r, s in zip(range(1, 7), signs, strict=True) if s) for signs in itertools.product((0, 1), repeat=6)]
    assert score.wilcoxon_p(6, 3) == pytest.approx(min(1.0, 2 * sum(v <= 3 for v in stats) / 64))


def test_metrics_of_equal_partitions(spark):
    t = score.contingency(spark.createDataFrame([(i % 3, (i + 1) % 3) for i in range(30)], "label int, pred int"))
    assert score.accuracy(t)[0] == 1.0 and score.nmi(t).first()[0] == pytest.approx(1.0) and score.ari(t).first()[0] == pytest.approx(1.0)


def test_sources(spark, tmp_path):
    (tmp_path / "m.txt").write_text("2 1\n1.0 2.0\n3 4\n5 6\n")
    rows = {r.point_id: (r.features, r.label) for r in io.read_header_counts(spark, str(tmp_path / "m.txt")).collect()}
    assert rows == {0: ([1.0, 2.0], 1), 1: ([3.0, 4.0], 1), 2: ([5.0, 6.0], 0)}
    (tmp_path / "c.csv").write_text("1,2,7\n3,x,8\n")
    got = io.read_delimited(spark, str(tmp_path / "c.csv"), label=2)
    assert sorted((r.features[0], r.label) for r in got.collect()) == [(1.0, 7), (3.0, 8)]
    assert io.validate(got, 2).first().not_finite == 1
    with pytest.raises(ValueError):
        io.align(spark.range(3).withColumnRenamed("id", "point_id"), spark.range(2).withColumnRenamed("id", "point_id"))
    with pytest.raises(KeyError):
        io.load(spark, "/nowhere", "absent")
