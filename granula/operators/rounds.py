"""Rounds of outlier refinement (X9-X11, X15): granules with outlying axes split again where a rule admits it.

A granule is tried once: its split and the rule know only its own points, so one that was refused is
refused in every later round. A round reads the points of the new candidates alone, and the rows of
granules that stay are not computed again.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granula.functions.state import durable
from granula.operators import granule, split

#: rule -> (middle of the axes' sums, split, bound on a child's size by the number of all points, condition
#: on least and most, the children's sizes, on axes, the sum of theirs, and on flat, their smallest trace).
RULES = {
    "leaf": ("mean", split.split_ellipsoid, lambda n: max(2, math.ceil(0.1 * math.sqrt(n))), "least >= {leaf}"),
    "core": ("mean", split.split_ellipsoid, lambda n: math.ceil(math.sqrt(n)) * 0.1, "least >= {leaf}"),
    "four": ("median", split.split_median_ellipsoid, lambda n: max(2, math.ceil(0.1 * math.sqrt(n))), "least >= {leaf} and not (least <= {leaf} and most >= n - {leaf}) and axes < l1 + l2"),
    "whole": ("mean", split.split_ellipsoid, lambda n: 4, "least >= {leaf} and least > 1 and flat > {flat}"),
}


def refine(points: DataFrame, rule: str = "leaf", factor: float = 2.0, gain: float = 2.0, rounds: int = 10) -> DataFrame:
    """points (id, x, y, g) with path, the children taken from g on ('' where g never split).

    Each round tries the granules whose axes add up to over factor times the mean (or median) sum. A
    split stands if it meets the rule and the children's densities add up to over gain times the
    parent's. Ends after so many rounds, or when none was admitted. No points: no rows.
    """
    mid, cut, bound, gate = RULES[rule]
    cols = points.columns
    now = durable(points.withColumn("g", F.struct("g", F.lit("").alias("path"))))
    gate = gate.format(leaf=repr(float(bound(now.count()))), flat=2 * granule.EPS + granule.TINY)
    state = durable(granule.granules(now).withColumn("tried", F.lit(False)))
    for _ in range(rounds):
        out = durable(split.outlier_candidates(state, factor, mid).where("not tried").select("g"))
        if out.isEmpty():
            break
        halves = durable(cut(now.join(out, "g", "left_semi")))
        kids = durable(split.children(halves))
        both = kids.groupBy("g").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.sum(F.expr("l1 + l2")).alias("axes"), F.min(F.expr("a + c")).alias("flat"), F.sum("density").alias("dense"))
        ok = durable(state.join(both, "g").where(f"{gate} and dense > {gain} * density").select("g"))
        if ok.isEmpty():
            break
        deeper = F.struct(F.col("g.g").alias("g"), F.concat("g.path", F.col("child").cast("string")).alias("path"))
        stay = state.join(ok, "g", "left_anti").join(out.withColumn("now", F.lit(True)), "g", "left").withColumn("tried", F.col("tried") | F.col("now").isNotNull()).drop("now")
        new = kids.join(ok, "g", "left_semi").withColumn("g", deeper).withColumn("tried", F.lit(False))
        state = durable(stay.unionByName(new.select(*stay.columns)))
        moved = halves.join(ok, "g", "left_semi").withColumn("g", deeper)
        now = durable(now.join(ok, "g", "left_anti").unionByName(moved.select(*now.columns)))
    return now.select(*(F.col("g.g").alias("g") if c == "g" else F.col(c) for c in cols), F.col("g.path").alias("path"))
