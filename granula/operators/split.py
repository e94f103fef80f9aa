"""Splits of granules, one level at a time, their gates, and grid seeds."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granula.functions.state import durable
from granula.operators import granule


def threshold(n: int, factor: float = 1.0, floor: int = 5) -> int:
    return max(floor, math.ceil(math.sqrt(n) * factor))


def _distance2(to: str) -> F.Column:
    return F.expr(f"(x - {to}x) * (x - {to}x) + (y - {to}y) * (y - {to}y)")


def _two(points: DataFrame) -> DataFrame:
    """Only granules with both children."""
    return _both(points, 1)


def _both(points: DataFrame, least: int) -> DataFrame:
    """Only granules both of whose children have at least so many points: counts, joined back."""
    points = durable(points)
    ok = points.groupBy("g").agg(F.sum("child").alias("ones"), F.count("*").alias("all")).where(f"ones >= {least} and all - ones >= {least}")
    return points.join(ok.select("g"), "g", "left_semi")


def split_once(points: DataFrame, ties_left: bool = False) -> DataFrame:
    """By distance to the two end points: child 0 iff d1 < d2 (or <=); unsplittable ones drop out."""
    ends = granule.endpoints(points)
    d1, d2 = _distance2("p2"), _distance2("p3")
    return _two(points.join(ends, "g").withColumn("child", F.when((d1 <= d2) if ties_left else (d1 < d2), 0).otherwise(1)).select(*points.columns, "child"))


def reassign(first: DataFrame) -> DataFrame:
    """Splits once more by Mahalanobis distance to the children of a first split (ties: child 1)."""
    kids = granule.moments(first.withColumn("g", F.struct("g", "child")))
    shape = F.struct("cx", "cy", "a", "b", "c")
    pair = kids.groupBy(F.col("g.g").alias("g")).agg(*(F.max(F.when(F.col("g.child") == i, shape)).alias(f"k{i}") for i in (0, 1)))
    m2 = "greatest(({k}.c * (x - {k}.cx) * (x - {k}.cx) - 2 * {k}.b * (x - {k}.cx) * (y - {k}.cy) + {k}.a * (y - {k}.cy) * (y - {k}.cy)) / ({k}.a * {k}.c - {k}.b * {k}.b), 0)"
    child = F.expr(f"if({m2.format(k='k0')} < {m2.format(k='k1')}, 0, 1)")
    return _two(first.drop("child").join(pair, "g").select(*(c for c in first.columns if c != "child"), child.alias("child")))


def split_ellipsoid(points: DataFrame) -> DataFrame:
    """End points first, then once more by Mahalanobis distance to the children."""
    return reassign(split_once(points))


def split_axis_median(points: DataFrame) -> DataFrame:
    """Projection on the first principal axis, cut at its median: child 0 iff at most the median. Where no
    point is above the median, the first half in the order of projection and id is child 0."""
    m = granule.moments(points).select("g", "cx", "cy", F.expr("0.5 * atan2(2 * b, a - c)").alias("t"))
    pr = durable(points.join(m, "g").withColumn("pr", F.expr("(x - cx) * cos(t) + (y - cy) * sin(t)")))
    cut = durable(pr.groupBy("g").agg(F.median("pr").alias("cut"), F.max("pr").alias("top"), F.count("*").alias("n")))
    out = pr.join(cut, "g")
    above = out.where("top > cut").withColumn("child", F.when(F.col("pr") <= F.col("cut"), 0).otherwise(1))
    at = F.row_number().over(Window.partitionBy("g").orderBy("pr", "id"))
    flat = out.where("not top > cut").withColumn("child", F.when(at <= F.floor(F.col("n") / 2), 0).otherwise(1))
    return _two(above.select(*points.columns, "child").union(flat.select(*points.columns, "child")))


def split_median_ellipsoid(points: DataFrame) -> DataFrame:
    """The median of the first axis first, then by Mahalanobis distance to the children."""
    return reassign(split_axis_median(points))


def children(split: DataFrame) -> DataFrame:
    """Granule rows of the children of a split: g, child and the columns of granule.granules."""
    got = granule.granules(split.withColumn("g", F.struct("g", "child")))
    return got.select(F.col("g.g").alias("g"), F.col("g.child").alias("child"), *(c for c in got.columns if c != "g"))


def judge(points: DataFrame, min_leaf: int, gain: float = 1.0, axis_gate: float = 0.10, parent_gate: float = 0.25, pair_gate: float = 1.0) -> DataFrame:
    """The acceptance gates of one split: leaf sizes, density gain, distance gates in the parent's
    axes and metric and in the pair's metric, the sum of axes, no child whose points are all the same."""
    kids = children(split_ellipsoid(points))
    a, b = (kids.where(F.col("child") == i).select("g", *(F.col(x).alias(f"{x}_{i}") for x in ("n", "cx", "cy", "a", "b", "c", "density", "l1", "l2"))) for i in (0, 1))
    both = granule.granules(points).join(a, "g").join(b, "g").withColumn("dx", F.expr("cx_0 - cx_1")).withColumn("dy", F.expr("cy_0 - cy_1"))
    pair = "(a_0 + a_1) / 2 as pa", "(b_0 + b_1) / 2 as pb", "(c_0 + c_1) / 2 as pc"
    both = both.selectExpr("*", *pair)
    return both.selectExpr(
        "g", "n_0", "n_1",
        f"least(n_0, n_1) >= {min_leaf} as leaf_ok",
        f"density_0 + density_1 > {gain} * density as density_ok",
        f"(l1 + l2) / 2 <= 1e-12 or sqrt(dx * dx + dy * dy) >= {axis_gate} * (l1 + l2) / 2 as axis_ok",
        f"sqrt((c * dx * dx - 2 * b * dx * dy + a * dy * dy) / det) >= {parent_gate} * greatest(rho, 1e-12) as parent_ok",
        f"sqrt((pc * dx * dx - 2 * pb * dx * dy + pa * dy * dy) / (pa * pc - pb * pb)) >= {pair_gate} as pair_ok",
        "not (least(n_0, n_1) <= {m} and greatest(n_0, n_1) >= n - {m}) as balance_ok".format(m=min_leaf),
        "l1_0 + l2_0 + l1_1 + l2_1 < l1 + l2 as axes_ok",
        f"least(n_0, n_1) > 1 and least(a_0 + c_0, a_1 + c_1) > {2 * granule.EPS + granule.TINY} as shape_ok",
    )


def refine_round(points: DataFrame, factor: float = 2.0, gain: float = 1.0, least: int | None = None, by: str = "mean") -> DataFrame:
    """One round of outlier refinement: points with child, null where the granule stays. A granule of
    outlying axes splits if both children have `least` points (else max(2, a tenth of the root of all
    points)) and their densities add up to over gain times its own."""
    if least is None:
        least = max(2, math.ceil(0.1 * math.sqrt(points.count())))
    g = granule.granules(points)
    tried = split_ellipsoid(points.join(outlier_candidates(g, factor, by).select("g"), "g", "left_semi"))
    kids = children(tried).groupBy("g").agg(F.min("n").alias("least"), F.sum("density").alias("sum"))
    ok = kids.join(g, "g").where(f"least >= {least} and sum > {gain} * density").select("g")
    return points.join(tried.join(ok, "g", "left_semi").select("id", "child"), "id", "left").select(*points.columns, "child")


def outlier_candidates(g: DataFrame, factor: float = 2.0, by: str = "mean") -> DataFrame:
    """Granules whose axes add up to over factor times the mean (or median) sum."""
    mid = g.agg((F.avg if by == "mean" else F.median)(F.expr("l1 + l2")).alias("mid"))
    return g.crossJoin(F.broadcast(mid)).where(F.expr(f"l1 + l2 > {factor} * mid")).drop("mid")


def farthest_pair_split(points: DataFrame, min_samples: int = 2) -> DataFrame:
    """By the farthest pair of each granule (ties: smallest ids): left iff d_alpha <= d_beta.

    Only points that can be in it are paired: with the distance L of the end points and the radius R
    about the centre, those whose distance to the centre is at least L - R."""
    ends, c = granule.endpoints(points), points.groupBy("g").agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"))
    away = points.join(c, "g").withColumn("dc", F.sqrt(_distance2("c")))
    bound = away.groupBy("g").agg(F.max("dc").alias("r")).join(ends, "g").selectExpr("g", "sqrt((p2x - p3x) * (p2x - p3x) + (p2y - p3y) * (p2y - p3y)) - r as least")
    outer = away.join(bound, "g").where("dc >= least - 1e-9 * abs(least)").select(*points.columns)
    p, q = outer.alias("p"), outer.select("g", *(F.col(c).alias(f"q{c}") for c in ("id", "x", "y"))).alias("q")
    d = F.expr("(x - qx) * (x - qx) + (y - qy) * (y - qy)")
    far = p.join(q, "g").where("id < qid").groupBy("g").agg(F.max(F.struct(d.alias("d"), (-F.col("id")).alias("i"), (-F.col("qid")).alias("j"), "x", "y", "qx", "qy")).alias("f"))
    ends = far.selectExpr("g", "f.x as ax", "f.y as ay", "f.qx as bx", "f.qy as by")
    out = points.join(ends, "g").withColumn("child", F.when(_distance2("a") <= _distance2("b"), 0).otherwise(1)).select(*points.columns, "child")
    return _both(out, min_samples)


def prune_level(parents: DataFrame, kids: DataFrame) -> DataFrame:
    """parents (g, quality), kids (g, best): keeps a node iff its quality reaches its children's sum."""
    s = kids.groupBy("g").agg(F.sum("best").alias("below"))
    return parents.join(s, "g", "left").withColumn("keep", F.col("quality") >= F.coalesce("below", F.lit(0.0))).withColumn("best", F.greatest("quality", F.coalesce("below", F.lit(0.0))))


def dm_gate(points: DataFrame, min_split: int = 6, min_child: int = 3) -> DataFrame:
    """Mean-distance gate: the split stands iff the children's weighted mean distance is smaller."""
    big = points.join(points.groupBy("g").count().where(f"count >= {min_split}").select("g"), "g", "left_semi")
    kids = split_once(big)
    both = granule.balls(kids.withColumn("g", F.struct("g", "child")))
    per = both.groupBy(F.col("g.g").alias("g")).agg(F.min("n").alias("least"), (F.sum(F.expr("n * dm")) / F.sum("n")).alias("kids_dm"))
    return granule.balls(points).select("g", "dm").join(per, "g").select("g", "dm", "kids_dm", F.expr(f"least >= {min_child} and kids_dm < dm").alias("split"))


def radius_gate(b: DataFrame) -> DataFrame:
    """Balls whose radius reaches twice the larger of mean and median of the positive radii."""
    t = b.where("r > 0").agg(F.greatest(F.avg("r"), F.median("r")).alias("mid"))
    return b.crossJoin(F.broadcast(t)).select("g", "r", (2 * F.col("mid")).alias("threshold"), F.expr("r >= 2 * mid and r > 1e-5").alias("split"))


def bins(n: int, dims: int, per_cell: int = 16) -> int:
    return min(64, max(4, math.ceil(math.ceil(n / per_cell) ** (1 / dims))))


def cells(points: DataFrame, k: int) -> DataFrame:
    """points (x, y in [0, 1]) with their cell kx, ky of a grid of k by k."""
    at = lambda c: F.least(F.lit(k - 1), F.greatest(F.lit(0), F.floor(F.col(c) * k))).cast("int")
    return points.withColumn("kx", at("x")).withColumn("ky", at("y"))


def occupied(celled: DataFrame) -> DataFrame:
    return celled.groupBy("kx", "ky").agg(F.count("*").alias("n"), F.avg("x").alias("mx"), F.avg("y").alias("my"), F.min("id").alias("first"))


def adjacent(occ: DataFrame) -> DataFrame:
    """Pairs of occupied cells that touch: each cell looks up its neighbours, by equi-join."""
    step = F.expr("explode(array(-1, 0, 1))")
    near = occ.select("kx", "ky").withColumn("dx", step).withColumn("dy", step).where("dx != 0 or dy != 0").selectExpr("kx", "ky", "kx + dx as nx", "ky + dy as ny")
    return near.join(occ.selectExpr("kx as nx", "ky as ny"), ["nx", "ny"], "left_semi").select("kx", "ky", "nx", "ny")


def grid_components(occ: DataFrame, k: int, checkpoint) -> DataFrame:
    """(kx, ky, component): the smallest kx * k + ky reachable; minimum labels to a fixpoint."""
    edges = checkpoint(adjacent(occ).selectExpr(f"kx * {k} + ky as u", f"nx * {k} + ny as v"))
    lab = checkpoint(occ.selectExpr(f"kx * {k} + ky as u", f"kx * {k} + ky as component"))
    while True:
        best = edges.join(lab.withColumnRenamed("u", "v"), "v").groupBy("u").agg(F.min("component").alias("m"))
        step = lab.join(best, "u", "left").select("u", F.col("component").alias("old"), F.least("component", F.coalesce("m", "component")).alias("c"))
        up = lab.select(F.col("u").alias("c"), F.col("component").alias("up"))
        new = checkpoint(step.join(up, "c").select("u", "old", F.least("c", "up").alias("component")))
        if not new.where("old != component").limit(1).count():
            return new.selectExpr(f"cast(floor(u / {k}) as int) as kx", f"cast(u % {k} as int) as ky", "cast(component as int) as component")
        lab = new.select("u", "component")


def seeds(celled: DataFrame, comp: DataFrame) -> DataFrame:
    """One granule per component, larger ones first (ties: first point): id, g."""
    joined = celled.join(comp, ["kx", "ky"])
    size = joined.groupBy("component").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    order = size.select("component", (F.row_number().over(Window.orderBy(F.desc("n"), "first")) - 1).cast("long").alias("seed"))
    return joined.join(F.broadcast(order), "component").select("id", "seed")
