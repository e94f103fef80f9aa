"""Granules of a membership (id, x, y, g): moments, shapes, radii, densities.

Closed forms in two dimensions, all of them aggregates and projections; any dimension goes through
granula.functions.shapes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

EPS, TINY = 1e-6, 1e-12


def moments(points: DataFrame, eps: float = EPS) -> DataFrame:
    """g, n, cx, cy and the shape matrix [[a, b], [b, c]] = population covariance + eps * I."""
    return points.groupBy("g").agg(
        F.count("*").alias("n"), F.avg("x").alias("cx"), F.avg("y").alias("cy"),
        (F.covar_pop("x", "x") + eps).alias("a"), F.covar_pop("x", "y").alias("b"), (F.covar_pop("y", "y") + eps).alias("c"),
    )


def inverse(m: DataFrame) -> DataFrame:
    det = F.expr("a * c - b * b")
    return m.select("*", det.alias("det"), (F.col("c") / det).alias("ia"), (-F.col("b") / det).alias("ib"), (F.col("a") / det).alias("ic"))


def cholesky(m: DataFrame) -> DataFrame:
    """The lower factor [[l11, 0], [l21, l22]]."""
    l11 = F.sqrt("a")
    return m.select("*", l11.alias("l11"), (F.col("b") / l11).alias("l21"), F.sqrt(F.col("c") - F.col("b") * F.col("b") / F.col("a")).alias("l22"))


def mahalanobis(points: DataFrame, m: DataFrame) -> DataFrame:
    """points with their granule's moments and m2, the squared Mahalanobis distance to its centre."""
    return points.join(m, "g").withColumn("det", F.expr("a * c - b * b")).withColumn("m2", F.expr("greatest((c * (x - cx) * (x - cx) - 2 * b * (x - cx) * (y - cy) + a * (y - cy) * (y - cy)) / det, 0)"))


def axes(g: DataFrame) -> DataFrame:
    """Adds the shape's eigenvalues and the semi-axis lengths l1 >= l2 for the covering radius rho."""
    root = F.expr("sqrt((a - c) * (a - c) / 4 + b * b)")
    g = g.withColumn("e1", F.greatest((F.col("a") + F.col("c")) / 2 + root, F.lit(TINY))).withColumn("e2", F.greatest((F.col("a") + F.col("c")) / 2 - root, F.lit(TINY)))
    return g.withColumn("l1", F.col("rho") * F.sqrt("e1")).withColumn("l2", F.col("rho") * F.sqrt("e2"))


def granules(points: DataFrame, eps: float = EPS) -> DataFrame:
    """One row per granule: moments, covering radius rho, axes, sum of distances ms, density."""
    per = mahalanobis(points, moments(points, eps)).groupBy("g", "n", "cx", "cy", "a", "b", "c", "det").agg(F.sqrt(F.max("m2")).alias("rho"), F.sum(F.sqrt("m2")).alias("ms"))
    return axes(per).withColumn("density", F.expr(f"n * n / (greatest(l1 + l2, {TINY}) * greatest(ms, {TINY}))"))


def penalised(g: DataFrame, small: int = 4) -> DataFrame:
    """The density of a small granule counts at most its size; then small granules keep 1/5 and degenerate
    ones, whose points are all the same, 1/20."""
    flat = (F.col("n") <= 1) | (F.col("a") + F.col("c") <= 2 * EPS + TINY)
    few = F.col("n") < small
    d = F.when(few, F.least("density", F.greatest(F.lit(1.0), F.col("n").cast("double")))).otherwise(F.col("density"))
    return g.withColumn("degenerate", flat).withColumn("penalised", d * F.when(flat, 0.05).otherwise(1.0) * F.when(few, 0.2).otherwise(1.0))


def endpoints(points: DataFrame) -> DataFrame:
    """Major axis of each granule: p1 nearest the centre, p2 farthest from p1, p3 farthest from p2;
    ties to the smaller id. Three aggregates, no sort."""
    c = points.groupBy("g").agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"))
    far = lambda to: F.expr(f"(x - {to}x) * (x - {to}x) + (y - {to}y) * (y - {to}y)")
    p1 = points.join(c, "g").groupBy("g").agg(F.min(F.struct(far("c").alias("d"), "id", "x", "y")).alias("p"))
    last = p1.select("g", F.col("p.x").alias("qx"), F.col("p.y").alias("qy"))
    out = None
    for name in ("p2", "p3"):
        got = points.join(last, "g").groupBy("g").agg(F.max(F.struct(far("q").alias("d"), (-F.col("id")).alias("nid"), "x", "y")).alias("p"))
        last = got.select("g", F.col("p.x").alias("qx"), F.col("p.y").alias("qy"))
        mine = got.select("g", (-F.col("p.nid")).alias(f"{name}_id"), F.col("p.x").alias(f"{name}x"), F.col("p.y").alias(f"{name}y"))
        out = mine if out is None else out.join(mine, "g")
    return out


def axis_endpoints(points: DataFrame) -> DataFrame:
    """Extremes of the projection on the first principal axis; ties to the smaller id."""
    m = moments(points)
    theta = F.expr("0.5 * atan2(2 * b, a - c)")
    proj = points.join(m.select("g", "cx", "cy", theta.alias("t")), "g").withColumn("pr", F.expr("(x - cx) * cos(t) + (y - cy) * sin(t)"))
    return proj.groupBy("g").agg(F.min(F.struct("pr", "id")).getField("id").alias("low_id"), F.max(F.struct("pr", (-F.col("id")).alias("n"))).getField("n").alias("n")).select("g", "low_id", (-F.col("n")).alias("high_id"))


def ellipse(g: DataFrame) -> DataFrame:
    """Width, height and angle in degrees of the drawn ellipse."""
    return g.select("g", (2 * F.col("l1")).alias("width"), (2 * F.col("l2")).alias("height"), F.degrees(F.expr("0.5 * atan2(2 * b, a - c)")).alias("angle"))


def balls(points: DataFrame) -> DataFrame:
    """Per granule as a ball: centre, radius, mean distance dm, elementwise mean |x - c| (mr),
    density by size and by n / (r^2 * mr), quality coverage * exp(-r / 2)."""
    c = points.groupBy("g").agg(F.count("*").alias("n"), F.avg("x").alias("cx"), F.avg("y").alias("cy"))
    d = points.join(c, "g").withColumn("d", F.expr("sqrt((x - cx) * (x - cx) + (y - cy) * (y - cy))"))
    out = d.groupBy("g", "n", "cx", "cy").agg(F.max("d").alias("r"), F.avg("d").alias("dm"), F.avg(F.expr("(abs(x - cx) + abs(y - cy)) / 2")).alias("mr"))
    # No point is farther than the largest distance, so the ball covers all n.
    return out.withColumn("density", F.expr("case when r = 0 then 0 else n / (r * r * mr) end")).withColumn("quality", F.expr("n * exp(-0.5 * r)"))
