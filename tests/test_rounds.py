"""The median split and the rounds of outlier refinement against a plain reading of their rules."""

import math

import numpy as np
import pytest

from granula.operators import rounds, split

EPS = 1e-6


class Ellipse:
    def __init__(self, rows):
        self.rows = rows
        x = np.array([r[1:3] for r in rows])
        self.n, self.x, self.c = len(x), x, x.mean(axis=0)
        self.h = (x - self.c).T @ (x - self.c) / len(x) + EPS * np.eye(2)
        m = np.sqrt(self.squared(x))
        self.axes = m.max() * np.sqrt(np.maximum(np.linalg.eigvalsh(self.h), 1e-12)).sum()
        self.density = self.n**2 / (max(self.axes, 1e-12) * max(m.sum(), 1e-12))

    def squared(self, x):
        return np.maximum(((x - self.c) @ np.linalg.inv(self.h) * (x - self.c)).sum(axis=1), 0)

    def parts(self, child):
        return [[r for r, c in zip(self.rows, child, strict=True) if c == k] for k in (0, 1)]


def halves(e, how):
    """Two ellipses, or None."""
    if how == "median":
        (a, b), (_, c) = e.h
        t = 0.5 * math.atan2(2 * b, a - c)
        at = (e.x - e.c) @ [math.cos(t), math.sin(t)]
        child = at > np.median(at)
        if not child.any():
            order = sorted(range(e.n), key=lambda i: (at[i], e.rows[i][0]))
            child[order[e.n // 2 :]] = True
    else:
        i = lambda d: min(range(e.n), key=lambda k: (d[k], e.rows[k][0]))
        to = lambda q: ((e.x - q) ** 2).sum(axis=1)
        p2 = e.x[i(-to(e.x[i(to(e.c))]))]
        child = to(p2) >= to(e.x[i(-to(p2))])
    two = e.parts(child)
    if not all(two):
        return None
    two = [Ellipse(x) for x in two]
    two = e.parts(two[0].squared(e.x) >= two[1].squared(e.x))
    return [Ellipse(x) for x in two] if all(two) else None


def plain(rows, rule, factor, gain, most):
    groups = {}
    for r in rows:
        groups.setdefault((r[3], ""), []).append(r)
    now, n = {k: Ellipse(v) for k, v in groups.items()}, len(rows)
    leaf = {"core": math.ceil(math.sqrt(n)) * 0.1, "whole": 4}.get(rule, max(2, math.ceil(0.1 * math.sqrt(n))))
    for _ in range(most):
        mid = (np.median if rule == "four" else np.mean)([e.axes for e in now.values()])
        new = {}
        for key, e in now.items():
            two = halves(e, "median" if rule == "four" else "ends") if e.axes > factor * mid else None
            ok = two is not None and min(t.n for t in two) >= leaf and sum(t.density for t in two) > gain * e.density
            if ok and rule == "four":
                small, large = sorted(t.n for t in two)
                ok = not (small <= leaf and large >= e.n - leaf) and sum(t.axes for t in two) < e.axes
            if ok and rule == "whole":
                ok = all(t.n > 1 and np.trace(t.h) > 2 * EPS + 1e-12 for t in two)
            new.update({(key[0], key[1] + str(i)): t for i, t in enumerate(two)} if ok else {key: e})
        now = new
    return {r[0]: key for key, e in now.items() for r in e.rows}


def table(spark, rows):
    return spark.createDataFrame(rows, "id long, x double, y double, g long")


@pytest.mark.parametrize("rule", list(rounds.RULES))
@pytest.mark.parametrize("most", [1, 10])
def test_rounds_equal_the_plain_rules(spark, rule, most):
    r = np.random.default_rng(3)
    at = [((0, 0), 1.0, 40), ((0, 3), 0.2, 30), ((5, 5), 0.1, 30), ((9, 0), 3.0, 60), ((9, 9), 0.1, 8)]
    rows = [(i, float(x), float(y), g) for i, (x, y, g) in enumerate((*r.normal(c, s, 2), g) for g, (c, s, n) in enumerate(at) for _ in range(n))]
    rows += [(1000 + i, 4.0 + 30 * (i % 2), 4.0, 7) for i in range(12)]  # two places: children of one place each
    rows += [(2000 + i, 100.0 * (i // 2 % 2) + 10 * (i % 2), 0.0, 8) for i in range(24)]  # two pairs of places
    got = {x.id: (x.g, x.path) for x in rounds.refine(table(spark, rows), rule, 1.0, 0.9, most).collect()}
    want = plain(rows, rule, 1.0, 0.9, most)
    assert got == want
    assert any(p for _, p in want.values()) and (most == 1 or max(len(p) for _, p in want.values()) > 1)
    assert any(p for g, p in want.values() if g == 7) == (rule != "whole")


def test_a_child_of_core_size_may_be_one_point(spark):
    rows = [(i, float(i % 3), float(i % 2), 0) for i in range(8)] + [(8, 50.0, 0.0, 0)] + [(10 + i, 0.01 * i, 0.0, 1) for i in range(30)]
    path = lambda rule: {x.path for x in rounds.refine(table(spark, rows), rule, 1.0, 0.5, 1).where("g = 0").collect()}
    assert path("core") == {"0", "1"} and path("leaf") == {""}


def test_median_split_halves_where_none_is_above(spark):
    rows = [(0, 0.0, 0.0, 1), *((i, 1.0, 0.0, 1) for i in range(1, 5))] + [(10 + i, 2.0, 2.0, 2) for i in range(6)] + [(20, 1.0, 1.0, 3)]
    first = {r.id: r.child for r in split.split_axis_median(table(spark, rows)).collect()}
    assert first == {0: 0, 1: 0, 2: 1, 3: 1, 4: 1, **{10 + i: int(i >= 3) for i in range(6)}}
    assert {r.id: r.child for r in split.split_median_ellipsoid(table(spark, rows)).collect()} == {0: 0, 1: 1, 2: 1, 3: 1, 4: 1}


def test_no_points(spark):
    assert rounds.refine(table(spark, []), "four").collect() == []
