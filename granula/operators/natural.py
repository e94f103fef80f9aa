"""Natural neighbours of granules and what is built on them."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granula.operators.scale import unit_scale, vector_minmax_or_zero


def ranks(pairs: DataFrame) -> DataFrame:
    """i, j, d, r: r = 1 for the nearest; ties to the smaller j."""
    return pairs.withColumn("r", F.row_number().over(Window.partitionBy("i").orderBy("d", "j")))


def mutual_ranks(knn: DataFrame) -> DataFrame:
    """i, j, d, r, s, m: r and s the ranks either way, m the larger one."""
    back = knn.select(F.col("i").alias("j"), F.col("j").alias("i"), F.col("r").alias("s"))
    return knn.join(back, ["i", "j"]).withColumn("m", F.greatest("r", "s"))


def search(knn: DataFrame, rule: str = "stable") -> DataFrame:
    """One row: natural_k, the k at which the search for natural neighbours stops.

    A granule has a mutual neighbour at k iff the least of its mutual ranks is at most k, so the
    search is a function of that histogram: no rounds. stable: none is left, or as many have been
    left for ceil(ln M + ln k) rounds. coverage: 95% have one and the number stood for 2 rounds, at
    most ceil(2 log2 M). empty: none is left and the number stood for 2 rounds, at most
    max(4, ceil(sqrt M) + 4).
    """
    first = mutual_ranks(knn).groupBy("i").agg(F.min("m").alias("first"))
    m = first.count()
    most = {"stable": m - 1, "coverage": min(m - 1, max(1, math.ceil(2 * math.log2(max(2, m))))), "empty": min(m - 1, max(4, math.ceil(math.sqrt(m)) + 4))}[rule]
    ks = first.sparkSession.range(1, max(1, most) + 1).withColumnRenamed("id", "k")
    left = ks.crossJoin(first.groupBy("first").agg(F.count("*").alias("c"))).groupBy("k").agg(F.sum(F.when(F.col("first") > F.col("k"), F.col("c")).otherwise(0)).alias("left"))
    by = Window.orderBy("k")
    left = left.withColumn("same", (F.col("left") == F.lag("left").over(by)).cast("int")).withColumn("block", F.sum(F.when(F.col("same") == 1, 0).otherwise(1)).over(by))
    left = left.withColumn("streak", F.row_number().over(Window.partitionBy("block").orderBy("k")) - 1)
    stop = {
        "stable": F.expr(f"left = 0 or streak >= ceil(ln({max(1, m)}) + ln(k))"),
        "coverage": F.expr(f"1 - left / {max(1, m)} >= 0.95 and streak >= 2"),
        "empty": F.expr("left = 0 and streak >= 2"),
    }[rule]
    return left.agg(F.coalesce(F.min(F.when(stop, F.col("k"))), F.max("k")).alias("natural_k"))


def edges(knn: DataFrame, lam: int, fallback: bool = True) -> DataFrame:
    """i, j, d, r, s, is_fallback: mutual neighbours at lambda; the nearest for who has none."""
    near = mutual_ranks(knn).where(F.col("m") <= lam).select("i", "j", "d", "r", "s", F.lit(False).alias("is_fallback"))
    if not fallback:
        return near
    rest = mutual_ranks(knn).where("r = 1").join(near.select("i").distinct(), "i", "left_anti").select("i", "j", "d", "r", "s", F.lit(True).alias("is_fallback"))
    return near.union(rest)


def cap_degree(e: DataFrame, cap: int) -> DataFrame:
    w = Window.partitionBy("i").orderBy(F.col("r") + F.col("s"), "d", "j")
    return e.withColumn("o", F.row_number().over(w)).where(F.col("o") <= cap).drop("o")


def occurrence(knn: DataFrame, lam: int) -> DataFrame:
    """g, occurrence: share of all first-lambda places that a granule takes."""
    m = Window.partitionBy()
    seen = knn.where(F.col("r") <= lam).groupBy(F.col("j").alias("g")).agg(F.count("*").alias("c"))
    all_ = knn.select(F.col("i").alias("g")).distinct().withColumn("m", F.count("*").over(m))
    return all_.join(seen, "g", "left").select("g", (F.coalesce("c", F.lit(0)) / (F.col("m") * lam)).alias("occurrence"))


def support(e: DataFrame, g: DataFrame) -> DataFrame:
    """g, support: how many neighbour lists a granule is in, over the median of those in any; at most 3."""
    seen = e.groupBy(F.col("j").alias("g")).agg(F.count("*").alias("c"))
    mid = seen.agg(F.greatest(F.coalesce(F.median("c"), F.lit(1.0)), F.lit(1e-12)).alias("mid"))
    return g.select("g").join(seen, "g", "left").crossJoin(F.broadcast(mid)).select("g", F.least(F.lit(3.0), F.coalesce("c", F.lit(0)) / F.col("mid")).alias("support"))


def radii(e: DataFrame) -> DataFrame:
    """g, degree, radius (largest neighbour distance) and scale (median positive one)."""
    return e.groupBy(F.col("i").alias("g")).agg(F.count("*").alias("degree"), F.max("d").alias("radius"), F.greatest(F.coalesce(F.median(F.when(F.col("d") > 0, F.col("d"))), F.lit(1e-12)), F.lit(1e-12)).alias("scale"))


def outliers(r: DataFrame) -> DataFrame:
    return r.withColumn("outlier", F.col("radius") > F.avg("radius").over(Window.partitionBy())).select("g", "radius", "outlier")


def similarity(e: DataFrame, r: DataFrame, w: float = 0.3) -> DataFrame:
    """i, j, sim = (1 - w) exp(-(d^2 / (s_i s_j))) + w / (1 + r + s)."""
    s = r.select("g", "scale")
    both = e.join(s.select(F.col("g").alias("i"), F.col("scale").alias("si")), "i").join(s.select(F.col("g").alias("j"), F.col("scale").alias("sj")), "j")
    return both.withColumn("sim", F.expr(f"{1 - w} * exp(-(d * d) / (si * sj)) + {w} / (1 + r + s)"))


def consistency(e: DataFrame, labels: DataFrame, form: str = "directed", mass: DataFrame | None = None) -> DataFrame:
    """One row: the share of the edges' weight that joins equal labels.

    directed: every edge weighs 1 / (1 + d); 0 without edges. similarity: every pair once, either way,
    weighs its `similarity`; 1 without edges. mass: edges to a later granule weigh the root of both
    sizes (mass: g, n) over 1 + d; 0 without edges.
    """
    empty = 0.0
    if form == "similarity":
        s = similarity(e, radii(e), 0.5)
        pair = s.select(F.least("i", "j").alias("i"), F.greatest("i", "j").alias("j"), F.col("sim").alias("w"))
        e, empty = pair.groupBy("i", "j").agg(F.max("w").alias("w")), 1.0
    elif form == "mass":
        n = mass.select("g", "n")
        e = e.where("j > i").join(n.toDF("i", "ni"), "i").join(n.toDF("j", "nj"), "j").withColumn("w", F.sqrt(F.col("ni") * F.col("nj")) / (1 + F.col("d")))
    else:
        e = e.withColumn("w", 1 / (1 + F.col("d")))
    both = e.join(labels.select(F.col("g").alias("i"), F.col("label").alias("li")), "i").join(labels.select(F.col("g").alias("j"), F.col("label").alias("lj")), "j")
    return both.agg(F.coalesce(F.sum(F.when(F.col("li") == F.col("lj"), F.col("w")).otherwise(0.0)) / F.sum("w"), F.lit(empty)).alias("consistency"))


def structural_density(e: DataFrame, g: DataFrame) -> DataFrame:
    """g, structural = degree + sum of exp(-d^2 / (s_i s_j)) sqrt(n_i n_j) (1 + degree_j)."""
    r = radii(e).join(g.select("g", "n"), "g")
    both = e.join(r.selectExpr("g as i", "scale as si", "n as ni"), "i").join(r.selectExpr("g as j", "scale as sj", "n as nj", "degree as dj"), "j")
    return both.groupBy(F.col("i").alias("g")).agg((F.count("*") + F.sum(F.expr("exp(-(d * d) / (si * sj)) * sqrt(ni * nj) * (1 + dj)"))).alias("structural"))


def hybrid_density(g: DataFrame, structural: DataFrame, alpha: float | None = None) -> DataFrame:
    """g, hybrid: alpha * scaled density + (1 - alpha) * scaled structural + 1e-12 * g; alpha by the
    granule's size against the median, within 0.2 and 0.8, unless given."""
    both = g.select("g", "n", "density").join(structural, "g")
    mid = g.agg(F.median("n").alias("mid"))
    a = F.expr("least(0.8, greatest(0.2, n / (n + mid)))") if alpha is None else F.lit(alpha)
    both = both.crossJoin(F.broadcast(mid)).withColumn("a", a).withColumn("u", vector_minmax_or_zero(F.col("density"))).withColumn("v", vector_minmax_or_zero(F.col("structural")))
    return both.select("g", F.expr("a * u + (1 - a) * v + 1e-12 * g").alias("hybrid"))


def weighted_density(e: DataFrame, g: DataFrame, occurrence: DataFrame, weights=(0.55, 0.25, 0.20), powers=(0.5, 0.5), rank_weight: float = 0.5) -> DataFrame:
    """g, weighted: the weighted mean of three parts, + 1e-12 * g. Own: log density, scaled to its 5%-95%
    range. Neighbours': log of the sum of similarity * occurrence ** powers[0] * log size ** powers[1] *
    (1 + their own part) / 2. Relative: log of the density over the median of the neighbours'. The
    last two are scaled likewise; without neighbours they come from 0 and 1."""
    w = [x / sum(weights) for x in weights]
    own = g.select("g", "n", "density", unit_scale(F.log1p(F.greatest("density", F.lit(0.0)))).alias("own"))
    side = own.join(occurrence, "g", "left").select(
        F.col("g").alias("j"), F.col("density").alias("dj"),
        (F.pow(F.greatest(F.coalesce("occurrence", F.lit(0.0)), F.lit(1e-12)), powers[0]) * F.pow(F.log1p("n"), powers[1]) * (0.5 + 0.5 * F.col("own"))).alias("weight"),
    )
    per = similarity(e, radii(e), rank_weight).join(side, "j").groupBy(F.col("i").alias("g")).agg(F.sum(F.col("sim") * F.col("weight")).alias("near"), F.median("dj").alias("mid"))
    both = own.join(per, "g", "left").withColumn("near", F.coalesce("near", F.lit(0.0))).withColumn("rel", F.coalesce(F.col("density") / (F.col("mid") + 1e-12), F.lit(1.0)))
    near, rel = (unit_scale(F.log1p(F.greatest(c, F.lit(0.0)))) for c in ("near", "rel"))
    return both.select("g", (w[0] * F.col("own") + w[1] * near + w[2] * rel + 1e-12 * F.col("g")).alias("weighted"))


def prominence(e: DataFrame, g: DataFrame) -> DataFrame:
    """g, prominence = clip(ln(density / median density of the neighbours), -1, 1); 0 without any."""
    d = g.select("g", "density")
    mid = e.join(d.selectExpr("g as j", "density as dj"), "j").groupBy(F.col("i").alias("g")).agg(F.median("dj").alias("mid"))
    return d.join(mid, "g", "left").select("g", F.coalesce(F.expr("least(1, greatest(-1, ln(greatest(density, 1e-12) / greatest(mid, 1e-12))))"), F.lit(0.0)).alias("prominence"))


def membership(e: DataFrame, labels: DataFrame, occ: DataFrame) -> DataFrame:
    """g, label, membership: neighbours vote with (their weight's share) * weight * (their
    occurrence's share), weight 1 / (1 + d)."""
    w = e.withColumn("w", 1 / (1 + F.col("d")))
    into = w.groupBy(F.col("i").alias("j")).agg(F.sum("w").alias("wj"))
    both = w.join(into, "j").join(occ.selectExpr("g as j", "occurrence"), "j").join(labels.selectExpr("g as j", "label"), "j")
    both = both.withColumn("o", F.sum("occurrence").over(Window.partitionBy("i")))
    return both.groupBy(F.col("i").alias("g"), "label").agg(F.sum(F.expr("w / wj * w * occurrence / greatest(o, 1e-12)")).alias("membership"))


def ambiguous(e: DataFrame, labels: DataFrame, dpc: DataFrame, factor: float = 1.5, share: float = 0.70) -> DataFrame:
    """g with flags: open (no label), weak (a confidence over 0 and under share), mixed (neighbours of several
    labels), wide (radius over the limit), far (the nearest denser granule over the limit), ambiguous (any).

    labels: g, label and maybe confidence. The limit is the median of the positive radii and factor
    times their median deviation from it; without any nothing is over it.
    """
    sure = F.col("confidence") if "confidence" in labels.columns else F.lit(1.0)
    own = labels.select("g", F.col("label").isNull().alias("open"), F.coalesce((sure > 0) & (sure < share), F.lit(False)).alias("weak"))
    near = e.join(labels.selectExpr("g as j", "label"), "j").groupBy(F.col("i").alias("g")).agg(F.coalesce(F.min("label") != F.max("label"), F.lit(False)).alias("mixed"), F.max("d").alias("radius"))
    t = own.join(near, "g", "left").join(dpc.select("g", "delta", "parent"), "g")
    mid = near.where("radius > 0").agg(F.median("radius").alias("mid"))
    limit = near.where("radius > 0").crossJoin(F.broadcast(mid)).agg(F.coalesce(F.first("mid") + factor * F.median(F.abs(F.col("radius") - F.col("mid"))), F.lit(float("inf"))).alias("top"))
    t = t.crossJoin(F.broadcast(limit)).selectExpr("g", "open", "weak", "not open and coalesce(mixed, false) as mixed", "not open and coalesce(radius > top, false) as wide", "not open and coalesce(parent is not null and delta > top, false) as far")
    return t.withColumn("weak", F.expr("not open and weak")).withColumn("ambiguous", F.expr("open or weak or mixed or wide or far"))
