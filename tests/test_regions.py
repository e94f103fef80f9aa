"""Regions of touching cells by blocks against the list of touching cells."""

import numpy as np
import pandas as pd
import pytest

from granula.functions.state import durable
from granula.operators import grid


@pytest.mark.parametrize(("dims", "bins", "n"), [(2, 40, 200), (24, 4, 200)])
def test_regions_are_the_components_of_touching_cells(spark, monkeypatch, dims, bins, n):
    monkeypatch.setattr(grid, "BLOCK", 40)  # many blocks
    x = np.clip(np.random.default_rng(dims).normal(0.5, 0.2, size=(n, dims)), 0, 1)
    p = spark.createDataFrame([(i, [float(v) for v in x[i]]) for i in range(n)], "id long, features array<double>")
    occ = durable(grid.occupied(grid.cells(p, bins)))
    want = {r.node: r.component for r in grid.components(occ, grid.adjacent(occ)).collect()}
    assert 1 < len(set(want.values())) < len(want)
    assert {r.node: r.component for r in grid.regions(occ).collect()} == want


@pytest.mark.parametrize(("dims", "bins"), [(1, 2), (1, 9), (5, 4), (40, 5), (3, 900)])
def test_touching_cells_of_two_blocks(dims, bins):
    r = np.random.default_rng(dims)
    x, y = (np.minimum(r.integers(0, bins, size=(90, 1)) + r.integers(0, 3, size=(90, dims)), bins - 1) for _ in range(2))
    want = {(i, j) for i in range(90) for j in range(90) if np.abs(x[i] - y[j]).max() <= 1}
    assert want and set(zip(*(a.tolist() for a in grid._touching(x, y)), strict=True)) == want


def test_regions_write_no_list_of_touching_cells():
    """All cells touch all: what two blocks give is bounded by their cells, not by the pairs."""
    x = np.random.default_rng(1).integers(0, 2, size=(200, 9))
    got = grid._join_blocks(*[pd.DataFrame({"cell": list(x), "component": np.arange(200) + 200 * k}) for k in (0, 1)])
    assert len(got) == 399 and set(got["v"]) == {0}


def test_regions_of_nothing(spark):
    none = spark.createDataFrame([], "id long, features array<double>")
    assert grid.regions(durable(grid.occupied(grid.cells(none, 4)))).collect() == []
    one = grid.cells(spark.createDataFrame([(7, [0.5])], "id long, features array<double>"), 4)
    assert [tuple(r) for r in grid.regions(durable(grid.occupied(one))).collect()] == [(7, 7)]
