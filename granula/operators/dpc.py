"""Pairs of granules, density-peak attributes, centres.

A granule table has g and the columns of granule.granules. Pairs (i, j, d) hold both directions. The
pair relation is quadratic in granules by definition, and granules are about the root of the points;
one side is broadcast only up to BROADCAST_ROWS granules, otherwise blocks of granules are joined.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granula.functions.state import durable

BROADCAST_ROWS = 100_000
BLOCKS = 64


def two_sides(g: DataFrame, cols: list[str], condition: str = "g < h") -> DataFrame:
    """Pairs of granules with the columns cols, the second one's as <col>_h (its g as h)."""
    right = g.select(*(F.col(c).alias({"g": "h"}.get(c, f"{c}_h")) for c in cols))
    left = g.select(*cols)
    if g.count() <= BROADCAST_ROWS:
        return left.join(F.broadcast(right), F.expr(condition))
    left = left.withColumn("u", F.pmod(F.xxhash64("g"), F.lit(BLOCKS))).withColumn("v", F.explode(F.sequence(F.lit(0), F.lit(BLOCKS - 1))))
    right = right.withColumn("v", F.pmod(F.xxhash64("h"), F.lit(BLOCKS))).withColumn("u", F.explode(F.sequence(F.lit(0), F.lit(BLOCKS - 1))))
    return left.join(right, ["u", "v"]).where(condition).drop("u", "v")


def mirror(half: DataFrame) -> DataFrame:
    return half.select(F.col("g").alias("i"), F.col("h").alias("j"), "d").union(half.select("h", "g", "d"))


def mahalanobis_pairs(g: DataFrame) -> DataFrame:
    """Distance in the mean of both shapes."""
    both = two_sides(g, ["g", "cx", "cy", "a", "b", "c"]).selectExpr("g", "h", "cx - cx_h as dx", "cy - cy_h as dy", "(a + a_h) / 2 as a", "(b + b_h) / 2 as b", "(c + c_h) / 2 as c")
    return mirror(both.selectExpr("g", "h", "sqrt(greatest((c * dx * dx - 2 * b * dx * dy + a * dy * dy) / (a * c - b * b), 0)) as d"))


def euclid_pairs(g: DataFrame) -> DataFrame:
    return mirror(two_sides(g, ["g", "cx", "cy"]).selectExpr("g", "h", "sqrt((cx - cx_h) * (cx - cx_h) + (cy - cy_h) * (cy - cy_h)) as d"))


def pruned_pairs(g: DataFrame, margin: float = 3.0) -> DataFrame:
    """(g, h, pruned, d): far pairs (over margin times the outer radii) get the plain distance."""
    both = two_sides(g.withColumn("outer", F.greatest("l1", "l2")), ["g", "cx", "cy", "a", "b", "c", "outer"])
    both = both.selectExpr("g", "h", "cx - cx_h as dx", "cy - cy_h as dy", "(a + a_h) / 2 as a", "(b + b_h) / 2 as b", "(c + c_h) / 2 as c", "outer + outer_h as reach")
    far = f"sqrt(dx * dx + dy * dy) > {margin} * reach"
    return both.selectExpr("g", "h", f"{far} as pruned", f"case when {far} then sqrt(dx * dx + dy * dy) else sqrt(greatest((c * dx * dx - 2 * b * dx * dy + a * dy * dy) / (a * c - b * b), 0)) end as d")


def with_order(g: DataFrame, rho: str = "density") -> DataFrame:
    """g, rho and pos: the place in the order of density descending, then g."""
    return g.select("g", F.col(rho).cast("double").alias("rho")).withColumn("pos", F.row_number().over(Window.orderBy(F.desc("rho"), "g")))


def _candidates(g: DataFrame, pairs: DataFrame) -> DataFrame:
    o = with_order(g)
    both = pairs.join(o.withColumnRenamed("g", "i"), "i")
    return both.join(o.select(F.col("g").alias("j"), F.col("rho").alias("rho_j"), F.col("pos").alias("pos_j")), "j")


def attributes(g: DataFrame, pairs: DataFrame, mode: str = "strict") -> DataFrame:
    """g, rho, delta, parent, gamma.

    strict: nearest granule of higher density; the densest takes the largest delta, a tied maximum
    0. row: without a denser one, the largest distance of its row; row_positive: the same, of positive
    ones. max_or_row: strict, but the densest takes its row's largest if no delta is over 0. ordered: nearest of all that come
    earlier by (density, g); ball: likewise, parent 0 for the first, and all deltas times 10 if none
    reaches 1. patched: strict, else the predecessor in the order.
    """
    c = _candidates(g, pairs)
    ahead = F.col("rho_j") > F.col("rho") if mode not in ("ordered", "ball") else F.col("pos_j") < F.col("pos")
    tie = "pos_j" if mode in ("ordered", "ball") else "j"
    per = c.groupBy(F.col("i").alias("g")).agg(F.min(F.when(ahead, F.struct("d", F.col(tie).alias("t"), "j"))).alias("best"), F.max(F.when(F.col("d") > 0, F.col("d")) if mode == "row_positive" else F.col("d")).alias("row_max"))
    per = with_order(g).join(per, "g", "left").select("g", "rho", "pos", F.col("best.d").alias("d"), F.col("best.j").alias("parent"), "row_max")
    all_ = Window.partitionBy()
    if mode == "strict":
        delta = F.coalesce("d", F.when(F.col("pos") == 1, F.max("d").over(all_)).otherwise(0.0))
    elif mode == "max_or_row":
        top = F.max("d").over(all_)
        delta = F.coalesce("d", F.when(F.col("pos") == 1, F.when(top > 0, top).otherwise(F.col("row_max"))).otherwise(0.0))
    elif mode == "patched":
        before = Window.orderBy("pos")
        step = c.where("pos_j = pos - 1").select(F.col("i").alias("g"), F.col("d").alias("step"))
        per = per.join(step, "g", "left").withColumn("parent", F.coalesce("parent", F.lag("g").over(before))).withColumn("d", F.coalesce("d", "step"))
        delta = F.coalesce("d", F.max("d").over(all_))
    else:
        delta = F.coalesce("d", "row_max")
    per = per.withColumn("delta", F.coalesce(delta, F.lit(0.0)))
    if mode == "ball":
        per = per.withColumn("delta", F.when(F.max("delta").over(all_) < 1, F.col("delta") * 10).otherwise(F.col("delta"))).withColumn("parent", F.coalesce("parent", F.lit(0)))
    return per.select("g", "rho", "delta", "parent", (F.col("rho") * F.col("delta")).alias("gamma"))


def _ranked(dpc: DataFrame, by: str = "gamma") -> DataFrame:
    return dpc.withColumn("pick", F.row_number().over(Window.orderBy(F.desc(by), "g")))


def top_k(dpc: DataFrame, k: int, by: str = "gamma") -> DataFrame:
    """g, label: the k largest, labelled 0.. in that order."""
    return dpc.select("g", by).orderBy(F.desc(by), "g").limit(max(1, k)).select("g", (F.row_number().over(Window.orderBy(F.desc(by), "g")) - 1).alias("label"))


def above_mean(dpc: DataFrame, least: int = 2, most: int = 10) -> DataFrame:
    """gamma over mean + deviation, padded to least and cut to most."""
    all_ = Window.partitionBy()
    r = _ranked(dpc.withColumn("t", F.avg("gamma").over(all_) + F.stddev_pop("gamma").over(all_)))
    r = r.withColumn("k", F.count_if(F.col("gamma") > F.col("t")).over(all_))
    return r.where(F.col("pick") <= F.least(F.lit(most), F.greatest(F.lit(least), "k"))).select("g", (F.col("pick") - 1).alias("label"))


def knee(dpc: DataFrame, least: int = 2, most: int = 10) -> DataFrame:
    """Up to the point of the sorted, normalised gamma curve that is farthest from its chord."""
    all_ = Window.partitionBy()
    r = _ranked(dpc).withColumn("m", F.count("*").over(all_)).withColumn("lo", F.min("gamma").over(all_)).withColumn("hi", F.max("gamma").over(all_))
    r = r.withColumn("px", F.expr("(pick - 1) / greatest(m - 1, 1)")).withColumn("py", F.expr("case when hi - lo <= 1e-12 then 0 else (gamma - lo) / (hi - lo) end"))
    far = r.agg(F.max(F.struct(F.expr("round(abs(px + py - 1), 12)").alias("f"), (-F.col("pick")).alias("n"))).getField("n").alias("n"))
    k = F.least(F.lit(most), F.greatest(F.lit(least), F.when(F.col("hi") - F.col("lo") <= 1e-12, least).otherwise(-F.col("n"))))
    return r.crossJoin(F.broadcast(far)).where(F.col("pick") <= k).select("g", (F.col("pick") - 1).alias("label"))


def robust(dpc: DataFrame, g: DataFrame, mode: str = "knee", k: int | None = None, least: int = 1, most: int | None = None, small: int = 4) -> DataFrame:
    """Centres among granules that are neither small nor degenerate: the k largest if k is given, else by
    threshold (`above_mean`) or `knee`. Without any such granule the k largest of all, or the largest."""
    ok = dpc.join(g.where((F.col("n") >= small) & ~F.col("degenerate")).select("g"), "g", "left_semi")
    if not ok.limit(1).count():
        return top_k(dpc, k or 1)
    if k is not None:
        return top_k(ok, k)
    every = most if most is not None else (1 << 31) - 1
    return {"threshold": above_mean, "knee": knee}[mode](ok, least, every)


def robust_top_k(dpc: DataFrame, g: DataFrame, k: int, small: int = 4) -> DataFrame:
    return robust(dpc, g, k=k, small=small)


def two_peaks(dpc: DataFrame) -> DataFrame:
    """The best delta * (1 + rho / 20) on either side of the median density, by gamma."""
    m = dpc.agg(F.median("rho").alias("mid"))
    s = dpc.crossJoin(F.broadcast(m)).withColumn("right", F.col("rho") > F.col("mid")).withColumn("s", F.expr("delta * (1 + 0.05 * rho)"))
    best = s.groupBy("right").agg(F.max(F.struct("s", (-F.col("g")).alias("n"), "gamma")).alias("b"))
    return best.select((-F.col("b.n")).alias("g"), (F.row_number().over(Window.orderBy(F.desc("b.gamma"), F.desc("b.n"))) - 1).alias("label"))


def rectangle(dpc: DataFrame, rho: tuple[float, float], delta: tuple[float, float]) -> DataFrame:
    inside = F.col("rho").between(*rho) & F.col("delta").between(*delta)
    return _ranked(dpc.where(inside)).select("g", (F.col("pick") - 1).alias("label"))


def rectangle_default(dpc: DataFrame, rho: float = 0.85, delta: float = 0.90) -> DataFrame:
    """What is selected if nobody draws a rectangle: both at least their quantiles."""
    low = dpc.agg(F.percentile("rho", F.lit(rho)).alias("r"), F.percentile("delta", F.lit(delta)).alias("d"))
    inside = dpc.crossJoin(F.broadcast(low)).where((F.col("rho") >= F.col("r")) & (F.col("delta") >= F.col("d"))).drop("r", "d")
    return _ranked(inside).select("g", (F.col("pick") - 1).alias("label"))


def separation(pairs: DataFrame, factor: float = 0.20) -> DataFrame:
    """One row: the least distance between centres, max(25% quantile, factor * median, 1e-12)."""
    return pairs.where("d > 0 and i < j").agg(F.greatest(F.percentile("d", F.lit(0.25)), factor * F.median("d"), F.lit(1e-12)).alias("min_sep"))


def greedy(order: DataFrame, conflicts: DataFrame, most: int) -> DataFrame:
    """g, pick of the first `most` granules, in the order of pick (g, pick), that conflict (g, h, either
    way) with none chosen before.

    In rounds: who has no open conflict with an earlier one is chosen, who conflicts with a chosen one
    goes; both leave their conflicts. What stands at the end is the sequential choice, and its first
    part is sure once all that are still open come later. For orders that do not follow the conflicts the
    rounds are few, whatever `most`.
    """
    at = order.select("g", "pick")
    both = conflicts.select("g", "h").union(conflicts.select("h", "g")).distinct()
    edges = durable(both.join(at, "g").join(at.select(F.col("g").alias("h"), F.col("pick").alias("before")), "h").where("before < pick").select("g", "h"))
    open_, chosen = durable(at), at.limit(0)
    while True:
        heads = durable(open_.join(edges.select("g").distinct(), "g", "left_anti"))
        chosen = durable(chosen.union(heads))
        gone = durable(edges.join(heads.select(F.col("g").alias("h")), "h", "left_semi").select("g").distinct())
        open_ = durable(open_.join(heads.select("g"), "g", "left_anti").join(gone, "g", "left_anti"))
        left = open_.agg(F.min("pick").alias("next")).first()["next"]
        if left is None or chosen.where(F.col("pick") < left).count() >= most:
            return chosen.orderBy("pick").limit(most)
        # Only conflicts between granules that are both open are left.
        edges = durable(edges.join(open_.select("g"), "g", "left_semi").join(open_.select(F.col("g").alias("h")), "h", "left_semi").select("g", "h"))


def _chosen(order: DataFrame, conflicts: DataFrame, k: int, least: int | None = None) -> DataFrame:
    """g, label of the greedy choice, refilled by pick up to `least` (or k)."""
    order = durable(order)
    first = durable(greedy(order, conflicts, k).select("g", F.lit(0).alias("late")))
    most = max(first.count(), min(k, least if least is not None else k))
    r = order.select("g", "pick").join(first, "g", "left").withColumn("late", F.coalesce("late", F.lit(1))).orderBy("late", "pick").limit(most)
    return r.select("g", (F.row_number().over(Window.orderBy("late", "pick")) - 1).alias("label"))


def _within(pairs: DataFrame, limit: DataFrame, condition: str = "d < min_sep") -> DataFrame:
    return pairs.crossJoin(F.broadcast(limit)).where(condition).select(F.col("i").alias("g"), F.col("j").alias("h"))


def separated(dpc: DataFrame, pairs: DataFrame, k: int, factor: float = 0.20, by: str = "gamma") -> DataFrame:
    """Greedy: in the order of gamma, accept what keeps the least distance to all accepted; then
    refill by gamma."""
    return _chosen(_ranked(dpc, by).select("g", "pick"), _within(pairs, separation(pairs, factor)), k)


def pool(dpc: DataFrame, pairs: DataFrame, least: int = 2, factor: float = 0.25, most: int | None = None, k: int | None = None, prune: bool = True) -> DataFrame:
    """Automatic number: of the first max(3k, 3 least, root of the granules, most) by gamma, k where gamma
    drops most, those that keep the least distance; at least `least`, at most `most`. A given k, within
    those limits, takes the k largest, with prune those that keep the distance, refilled by gamma."""
    m = dpc.count()
    if k is not None:
        k = max(least, min(k, m, most if most is not None else k))
        return separated(dpc, pairs, k, factor) if prune else top_k(dpc, k)
    top = dpc.agg(F.max("gamma").alias("hi"), F.min("gamma").alias("lo"))
    unit = dpc.crossJoin(F.broadcast(top)).withColumn("u", F.expr("if(hi - lo <= 1e-12, 0, (gamma - lo) / (hi - lo))"))
    r = _ranked(unit).withColumn("next", F.lead("u").over(Window.orderBy("pick"))).where("next is not null").where(F.col("pick") <= max(math.ceil(math.sqrt(m)) + least, least))
    drop = r.agg(F.max(F.struct(F.round(F.expr("(u - next) / greatest(u, 1e-12)"), 12).alias("drop"), (-F.col("pick")).alias("n"))).alias("b")).first().b
    k = max(least, -drop.n) if drop else least
    size = min(m, max(3 * k, 3 * least, math.ceil(math.sqrt(m)), most or 0))
    return _chosen(_ranked(dpc).select("g", "pick").where(F.col("pick") <= size), _within(pairs, separation(pairs, factor)), min(size, most or size), least)


def basin_separated(dpc: DataFrame, pairs: DataFrame, edges: DataFrame, k: int, factor: float = 0.20) -> DataFrame:
    """As separated, but too near counts only between natural neighbours (either way)."""
    near = edges.select(F.col("i").alias("g"), F.col("j").alias("h"))
    near = near.union(near.select("h", "g")).distinct()
    return _chosen(_ranked(dpc).select("g", "pick"), _within(pairs, separation(pairs, factor)).join(near, ["g", "h"], "left_semi"), k)


def locally_separated(dpc: DataFrame, pairs: DataFrame, scales: DataFrame, k: int, factor: float = 0.8) -> DataFrame:
    """As separated, but the least distance is factor times the mean of both local scales (g, scale)."""
    s = scales.select("g", "scale")
    near = pairs.join(s.toDF("i", "si"), "i").join(s.toDF("j", "sj"), "j").where(f"d < {factor} * 0.5 * (si + sj)").select(F.col("i").alias("g"), F.col("j").alias("h"))
    return _chosen(_ranked(dpc).select("g", "pick"), near, k)


def not_redundant(dpc: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
    """Of the first k by gamma those farther than the median positive delta from all kept before."""
    tau = dpc.where("delta > 0").agg(F.coalesce(F.median("delta"), F.lit(0.0)).alias("tau"))
    return _chosen(_ranked(dpc).select("g", "pick").where(F.col("pick") <= k), _within(pairs, tau, "d <= tau"), k, 1)


def relative_drop(dpc: DataFrame, least: int = 2) -> DataFrame:
    """One row: k and drop, where the relative drop of gamma in its head is largest."""
    m = F.count("*").over(Window.partitionBy())
    r = _ranked(dpc).withColumn("next", F.lead("gamma").over(Window.orderBy("pick"))).withColumn("m", m)
    r = r.where(F.expr(f"next is not null and pick >= {least} and pick <= ceil(sqrt(m)) + {least}")).withColumn("drop", F.expr("(gamma - next) / greatest(gamma, 1e-12)"))
    return r.agg(F.max(F.struct(F.round("drop", 12).alias("drop"), (-F.col("pick")).alias("n"))).alias("b")).select((-F.col("b.n")).alias("k"), F.col("b.drop").alias("drop"))


def natural_gamma(dpc: DataFrame, prominence: DataFrame, support: DataFrame, ws: float = 0.5, wp: float = 0.5) -> DataFrame:
    """gamma * exp(ws * clip((support - median) / MAD, -2, 2) + wp * prominence); support: `natural.support`."""
    med = support.agg(F.median("support").alias("mid"))
    dev = support.crossJoin(F.broadcast(med)).agg(F.first("mid").alias("mid"), F.median(F.abs(F.col("support") - F.col("mid"))).alias("mad"))
    both = dpc.join(prominence, "g").join(support, "g").crossJoin(F.broadcast(dev))
    return both.withColumn("gamma", F.expr(f"gamma * exp({ws} * least(2, greatest(-2, (support - mid) / (mad + 1e-12))) + {wp} * prominence)")).select("g", "gamma")
