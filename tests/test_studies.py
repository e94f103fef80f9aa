"""Sources, sinks, studies and distributed levels."""

import gzip
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from granula.__main__ import main
from granula.functions import folds, shapes
from granula.operators import labels, score, shape
from granula.plans import pipelines
from granula.sources import io
from tests.conftest import SF
from tests.test_clustering import blobs


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("sets")
    x = blobs(60)
    for name in ("rice", "banknote"):
        (root / f"{name}.txt").write_text("\n".join(" ".join(f"{v:.6f}" for v in row) for row in x))
        (root / f"{name}_label.txt").write_text("\n".join(str(float(i >= 60)) for i in range(120)))
    (root / "banknote_label.txt").write_text("0\n1\n")
    return str(root)


def test_formats_of_public_sets(spark, tmp_path):
    with gzip.open(tmp_path / "c.csv.gz", "wt") as f:
        f.write("\n".join(",".join(str(r * 100 + c) for c in range(54)) + f",{r + 1}" for r in range(3)))
    got = {r.label: r.features for r in io.read_covertype(spark, str(tmp_path / "c.csv.gz")).collect()}
    assert sorted(got) == [0, 1, 2] and got[2][0] == 200.0 and len(got[0]) == 54
    (tmp_path / "p.dat").write_text("\n".join("\t".join(map(str, [7, 9, r % 2, *range(74)])) for r in range(2)))
    got = io.read_protein(spark, str(tmp_path / "p.dat")).collect()
    assert sorted(r.label for r in got) == [0, 1] and all(r.features == [float(v) for v in range(74)] for r in got)


def test_registry_of_sets(spark, folder):
    assert len(io.DATASETS) == 12 and next(iter(io.DATASETS)) == "iris"
    assert io.open_dataset(spark, folder, "rice").where("label = 1").count() == 60
    with pytest.raises(KeyError):
        io.open_dataset(spark, folder, "absent")
    with pytest.raises(ValueError, match="120 points and 2 labels"):
        io.open_dataset(spark, folder, "banknote")


def test_sinks(spark, tmp_path):
    rows = [{"set": "a_b", "acc": 0.5, "n": 3}, {"set": "a_b", "acc": 0.25, "error": "x"}, {"set": "c", "acc": 1.0}]
    io.write_results(io.results(spark, rows), str(tmp_path / "r"))
    got = spark.read.csv(str(tmp_path / "r"), header=True).collect()
    assert sorted((r.set, r.acc, r.n) for r in got) == [("a_b", "0.2500", None), ("a_b", "0.5000", "3"), ("c", "1.0000", None)]
    assert io.text_table(rows, ["set", "acc"]).splitlines() == ["set  acc", "a_b  0.500", "a_b  0.250", "c    1.000"]
    tex = io.latex_table(rows, ["set", "acc"], "set")
    assert r"\multirow{2}{*}{a\_b} & 0.500 \\" in tex and "\n & 0.250" in tex
    io.write_label_map(spark.createDataFrame([("x", 1), ("w", 0), ("x", 1)], "v string, code int"), "v", "code", str(tmp_path / "m"))
    assert [r.value for r in spark.read.text(str(tmp_path / "m")).collect()] == ["w -> 0", "x -> 1"]


def test_run_all_reports_errors(spark, folder, tmp_path):
    rows = main(["--base-dir", folder, "--datasets", "rice", "banknote", "iris", "--output-csv", str(tmp_path / "o")], spark)
    assert [r["name"] for r in rows] == ["rice", "banknote", "iris"]
    assert rows[0]["acc"] > 0.5 and not rows[0]["error"] and "granules" in rows[0] and "seconds_granules" in rows[0]
    assert "120 points" in rows[1]["error"] and rows[2]["error"] and rows[2]["acc"] == -1.0
    assert spark.read.csv(str(tmp_path / "o"), header=True).count() == 3


def test_studies_have_a_row_for_each_variant(spark, folder):
    points = io.open_dataset(spark, folder, "rice")
    base = replace(pipelines.CONFIGS["adaptive_dpc"], k=2, rounds=1)
    rows = pipelines.ablate(points, base, {k: pipelines.INCREMENTAL[k] for k in ("plain", "+ graph")})
    assert [r["name"] for r in rows] == ["plain", "+ graph"] and not any(r["error"] for r in rows)
    rows = pipelines.sensitivity(points, base, {"tau": (0.1, 0.4)}, repeats=2)
    assert [(r["parameter"], r["value"]) for r in rows] == [("tau", 0.1), ("tau", 0.4)]
    assert len(pipelines.INCREMENTAL) == 7 and list(pipelines.SENSITIVITY) == ["gain", "tau", "split_factor", "margin"]


@pytest.mark.parametrize(("name", "change"), [("axis_median_dpc", {}), ("distance_gate_dpc", {}), ("ball_dpc_2means", {}), ("ball_dpc_dm", {}), ("distance_gate_dpc", {"shape": "auto"})])
def test_levels_of_every_split_give_the_same_leaves(spark, name, change):
    r = np.random.default_rng(12)
    x = r.normal(size=(240, 6)) * np.linspace(0.3, 2, 6) + 5 * r.integers(0, 3, (240, 1))
    p = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "point_id long, features array<double>")
    cfg = replace(pipelines.CONFIGS[name], rounds=0, **change)
    parts = [{q.point_id: q.g for q in pipelines.granulate(p, cfg, most)[0].collect()} for most in (10_000, 80)]
    groups = [{frozenset(i for i in part if part[i] == g) for g in set(part.values())} for part in parts]
    assert groups[0] == groups[1] and len(groups[0]) > 2


def naive_leaves(x, ids, num, t, least, inverse=True):
    """Granules of the plain rules, written out: split to a fixpoint, then rounds on outlying ones."""
    h = lambda at: np.cov(x[at].T, bias=True) + 1e-6 * np.eye(x.shape[1]) if len(at) > 1 else 1e-6 * np.eye(x.shape[1])

    def facts(at):
        diff = x[at] - x[at].mean(axis=0)
        m2 = np.maximum(np.einsum("ij,jk,ik->i", diff, np.linalg.inv(h(at)), diff), 0)
        axes = np.sqrt(m2.max()) * np.sqrt(np.maximum(np.linalg.eigvalsh(h(at)), 1e-12))
        return axes.sum(), len(at) ** 2 / (max(axes.sum(), 1e-12) * max(np.sqrt(m2).sum(), 1e-12))

    def cut(at):
        y = x[at]
        p1 = y[((y - y.mean(axis=0)) ** 2).sum(axis=1).argmin()]
        p2 = y[((y - p1) ** 2).sum(axis=1).argmax()]
        p3 = y[((y - p2) ** 2).sum(axis=1).argmax()]
        left = ((y - p2) ** 2).sum(axis=1) < ((y - p3) ** 2).sum(axis=1)
        if left.all() or not left.any():
            return None
        m2 = []
        for side in (at[left], at[~left]):
            diff = y - x[side].mean(axis=0)
            m2.append(np.einsum("ij,jk,ik->i", diff, np.linalg.inv(h(side)), diff))
        left = np.maximum(m2[0], 0) < np.maximum(m2[1], 0)
        return None if left.all() or not left.any() else (at[left], at[~left])

    done, todo = [], [ids]
    while todo:
        at = todo.pop()
        two = cut(at) if len(at) >= num else None
        if two:
            todo += two
        else:
            done.append(at)
    for _ in range(10):
        size = [facts(at) for at in done]
        mean, new = np.mean([a for a, _ in size]), []
        for at, (axes, dens) in zip(done, size, strict=True):
            two = cut(at) if axes > 2 * mean else None
            new += two if two and min(map(len, two)) >= least and sum(facts(k)[1] for k in two) > t * dens else (at,)
        if len(new) == len(done):
            break
        done = new
    return {frozenset(at.tolist()) for at in done}


@pytest.mark.parametrize("seed", [1, 2])
def test_granules_against_a_plain_reading_of_the_rules(spark, seed):
    r = np.random.default_rng(seed)
    x = np.concatenate([r.normal(size=(150, 3)) * [1, 0.4, 2], r.standard_cauchy((60, 3)) + 6])
    p = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "point_id long, features array<double>")
    cfg = pipelines.Config(scaler="none", gain=0.9)
    got = {}
    for q in pipelines.granulate(p, cfg)[0].collect():
        got.setdefault(q.g, set()).add(q.point_id)
    n = len(x)
    assert set(map(frozenset, got.values())) == naive_leaves(x, np.arange(n), max(5, int(np.ceil(np.sqrt(n)))), 0.9, max(2, int(np.ceil(0.1 * np.sqrt(n)))))


def test_farthest_pair_is_the_first_of_all_pairs():
    r = np.random.default_rng(4)
    for d in (1, 2, 7):
        x = r.normal(size=(90, d))
        full = ((x[:, None] - x[None]) ** 2).sum(axis=2)
        assert shapes.farthest_pair(x, 500) == tuple(int(v) for v in np.unravel_index(full.argmax(), full.shape))


def test_best_count_and_best_labels():
    x = blobs(25)
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
    rho = 1 / np.sort(d, axis=1)[:, 1:6].mean(axis=1)
    delta, parent = folds.peaks(rho, d)
    found = folds.proposals(rho * delta, d, delta)
    scores = [folds.simulated_score(k, rho * delta, parent, d) for k in found]
    assert folds.best_count(rho * delta, delta, parent, d) == found[int(np.argmax(scores))] and len(found) > 1
    chosen, label = folds.best_labels(rho * delta, rho, parent, d, (2, 3, 5))
    best = max(folds.internal(d, rho, lab) for k in (2, 3, 5) for c in [folds.centres(rho * delta, d, k)] for p in [folds.chain(parent, c, d)] for lab in (p, folds.graph_vote(rho, d, p, c)))
    assert folds.internal(d, rho, label) == best and len(set(label)) == len(chosen)


def test_moments_of_a_hot_granule(spark):
    r = np.random.default_rng(2)
    x = r.normal(size=(500, 4))
    p = spark.createDataFrame([(i, [float(v) for v in row], 0 if i % 5 else i) for i, row in enumerate(x)], "point_id long, features array<double>, g long").repartition(7)
    got = {q.g: q for q in shape.moments(p).collect()}
    at = np.array([i for i in range(500) if i % 5 or i == 0])
    assert got[0].n == len(at) and np.allclose(got[0].v[:4], x[at].sum(axis=0)) and np.allclose(got[0].v[4:], (x[at].T @ x[at]).ravel())


def test_points_without_label_are_an_error(spark):
    points = spark.createDataFrame([(1, 0), (2, 5)], "id long, g long")
    with pytest.raises(Exception, match="no label for point 2"):
        labels.to_points(points, spark.createDataFrame([(0, 3)], "g long, label int")).collect()


def test_wilcoxon_sides(spark):
    import itertools

    stats = [sum(k for k, s in zip(range(1, 8), signs, strict=True) if s) for signs in itertools.product((0, 1), repeat=7)]
    for w in (0, 5, 14, 28):
        assert score.wilcoxon_p(7, w, "greater") == pytest.approx(sum(v >= w for v in stats) / 128)
    rows = spark.createDataFrame([("t", float(i), 0.4 * i * (-1) ** (i == 2)) for i in range(1, 9)] + [("u", 1.0, 0.0), ("u", 2.0, 1.0), ("u", 0.0, 3.0)], "test string, a double, b double")
    got = {q.test: q for q in score.wilcoxon_tests(rows).collect()}
    assert got["t"].p_greater == pytest.approx(1 / 256) and got["t"].p_two == pytest.approx(2 / 256)
    assert 0 < got["u"].p_two <= 1 and got["u"].m == 3


def test_refinement_stops_before_a_cluster_is_empty(spark):
    p = spark.createDataFrame([(i, float(i), 0.0) for i in range(6)], "id long, x double, y double")
    start = spark.createDataFrame([(i, int(i == 5)) for i in range(6)], "id long, label int")
    got = {r.id: r.label for r in labels.centroid_refine(p, start).collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 0, 4: 1, 5: 1} or set(got.values()) == {0, 1}
    one = start.withColumn("label", F.lit(3))
    assert {r.label for r in labels.centroid_refine(p, one).collect()} == {3}


def test_trials_that_differ_after_granulation_share_one(spark, monkeypatch):
    made = []
    plain = pipelines.granulate
    monkeypatch.setattr(pipelines, "granulate", lambda points, cfg, *a: made.append(cfg) or plain(points, cfg, *a))
    p = io.load(spark, SF).where("point_id < 120")
    rows = pipelines.sweep(p, pipelines.Config(dims=3), {"scaler": ["standard", "none"], "k": [2, 3]})
    assert len(rows) == 4 and len(made) == 2 and all(r["acc"] > 0 for r in rows)
    alone = pipelines.evaluate(p, rows[0]["config"])
    assert [alone[x] for x in ("acc", "nmi", "ari", "granules")] == [rows[0][x] for x in ("acc", "nmi", "ari", "granules")]
