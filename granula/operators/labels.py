"""Labels of granules and points: propagation, votes, gates, refinement (L1-L20, J8-J9; of L20 one round)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granula.functions.state import durable


def nearest_centre(pairs: DataFrame, centres: DataFrame) -> DataFrame:
    """g, label of the nearest centre; ties to the smaller label."""
    near = pairs.join(F.broadcast(centres.select(F.col("g").alias("j"), "label")), "j")
    return near.groupBy(F.col("i").alias("g")).agg(F.min(F.struct("d", "label")).getField("label").alias("near"))


def chains(dpc: DataFrame, centres: DataFrame) -> DataFrame:
    """g, root: where the parent links lead, stopping at centres; pointer jumping in log2 steps."""
    steps = math.ceil(math.log2(max(2, dpc.count()))) + 1
    ptr = dpc.join(centres.select("g", F.lit(True).alias("c")), "g", "left").select("g", F.when(F.col("c"), F.col("g")).otherwise(F.coalesce("parent", "g")).alias("root"))
    ptr = durable(ptr)
    while steps > 0:  # three hops by one table make links of four times the length
        up = ptr.select(F.col("g").alias("root"), F.col("root").alias("up"))
        hop = lambda t: t.join(up, "root").select("g", F.col("up").alias("root"))  # noqa: B023, E731
        ptr, steps = durable(hop(hop(hop(ptr)))), steps - 2
    return ptr


def propagate(dpc: DataFrame, centres: DataFrame, pairs: DataFrame | None = None, noise: bool = False, base: int = 0) -> DataFrame:
    """g, label: a centre's label runs down its chains. What no centre reaches takes the nearest
    centre's label, or one of its own with noise."""
    roots = chains(dpc, centres).join(centres.select(F.col("g").alias("root"), "label"), "root", "left")
    if noise or pairs is None:
        k = centres.agg(F.count("*").cast("int").alias("k"))
        return roots.crossJoin(F.broadcast(k)).select("g", (F.coalesce("label", "k") + base).alias("label"))
    return roots.join(nearest_centre(pairs, centres), "g", "left").select("g", (F.coalesce("label", "near", F.lit(0)) + base).alias("label"))


def graph_vote(dpc: DataFrame, pairs: DataFrame, labels: DataFrame, centres: DataFrame, margin: float = 1.75, factor: float = 1.0) -> DataFrame:
    """g, label after one round of votes by the k nearest denser granules, weighing rho / distance;
    a label changes iff the best vote is over margin times the current label's. Centres stay."""
    m = dpc.count()
    k = max(2, math.ceil(math.ceil(math.log2(max(2, m))) * factor))
    mid = pairs.where("d > 0").agg(F.median("d").alias("mid"))
    e = pairs.join(dpc.select(F.col("g").alias("i"), "rho"), "i").join(dpc.select(F.col("g").alias("j"), F.col("rho").alias("rho_j")), "j").where("rho_j > rho")
    e = e.withColumn("r", F.row_number().over(Window.partitionBy("i").orderBy("d", "j"))).where(F.col("r") <= k).join(labels.select(F.col("g").alias("j"), "label"), "j")
    votes = e.crossJoin(F.broadcast(mid)).groupBy(F.col("i").alias("g"), "label").agg(F.sum(F.expr("rho_j / (d + 1e-9 * mid)")).alias("v"), F.min("r").alias("first"))
    best = votes.groupBy("g").agg(F.max(F.struct("v", (-F.col("first")).alias("f"), "label")).alias("b"))
    now = labels.join(votes.withColumnRenamed("v", "own"), ["g", "label"], "left").join(best, "g", "left").join(centres.select("g", F.lit(True).alias("c")), "g", "left")
    change = F.col("c").isNull() & (F.col("b.v") > margin * F.greatest(F.coalesce("own", F.lit(0.0)), F.lit(1e-12)))
    return now.select("g", F.when(change, F.col("b.label")).otherwise(F.col("label")).alias("label"))


def ratios(labels: DataFrame, weight: str | None = None) -> DataFrame:
    """One row: shares of the largest and the smallest label (by rows, or by a weight column)."""
    per = labels.groupBy("label").agg((F.count("*") if weight is None else F.sum(weight)).alias("s"))
    return per.agg((F.max("s") / F.sum("s")).alias("largest"), (F.min("s") / F.sum("s")).alias("smallest"), F.count("*").alias("clusters"))


def changed(old: DataFrame, new: DataFrame) -> DataFrame:
    return old.join(new.withColumnRenamed("label", "label_new"), "g").agg(F.avg((F.col("label") != F.col("label_new")).cast("double")).alias("changed"))


def safe(old: DataFrame, new: DataFrame, largest: float = 0.85, most: float = 0.35) -> DataFrame:
    """One row: the graph's labels may replace the old ones."""
    return ratios(new).crossJoin(changed(old, new)).select("largest", "changed", ((F.col("largest") <= largest) & (F.col("changed") <= most)).alias("accepted"))


def representatives(dpc: DataFrame, labels: DataFrame) -> DataFrame:
    """label, g, rho of each label's densest granule; ties to the smaller g."""
    return dpc.join(labels, "g").groupBy("label").agg(F.max(F.struct("rho", (-F.col("g")).alias("n"))).alias("b")).select("label", (-F.col("b.n")).alias("g"), F.col("b.rho").alias("rho"))


def representative_pairs(reps: DataFrame, pairs: DataFrame) -> DataFrame:
    a, b = reps.select(F.col("g").alias("i"), F.col("label").alias("li")), reps.select(F.col("g").alias("j"), F.col("label").alias("lj"))
    return pairs.join(F.broadcast(a), "i").join(F.broadcast(b), "j").where("li < lj").select("li", "lj", "d")


def merge_light(dpc: DataFrame, labels: DataFrame, pairs: DataFrame, quantile: float = 0.20) -> DataFrame:
    """g, label: clusters whose representatives are within the quantile of their distances become
    one, named by the label with the densest representative (ties: the smallest); names are coded anew
    in their order."""
    reps = durable(representatives(dpc, labels))
    rp = representative_pairs(reps, pairs).where("d > 0")
    cut = rp.agg(F.percentile("d", F.lit(quantile)).alias("cut"))
    e = rp.crossJoin(F.broadcast(cut)).where("d <= cut").select("li", "lj")
    e = e.union(e.select("lj", "li"))
    e = durable(e)
    root = durable(labels.select("label").distinct().withColumn("root", F.col("label")))
    for _ in range(math.ceil(math.log2(max(2, root.count()))) + 1):
        best = e.join(root.withColumnRenamed("label", "lj"), "lj").groupBy(F.col("li").alias("label")).agg(F.min("root").alias("m"))
        root = durable(root.join(best, "label", "left").select("label", F.least("root", F.coalesce("m", "root")).alias("root")))
        up = root.select(F.col("label").alias("root"), F.col("root").alias("up"))
        root = durable(root.join(up, "root").select("label", F.least("root", "up").alias("root")))
    name = root.join(reps, "label").groupBy("root").agg(F.max(F.struct("rho", (-F.col("label")).alias("n"))).alias("b")).select("root", (-F.col("b.n")).alias("name"))
    code = root.join(name, "root").select("label", (F.dense_rank().over(Window.orderBy("name")) - 1).alias("code"))
    return labels.join(code, "label").select("g", F.col("code").alias("label"))


def to_points(points: DataFrame, labels: DataFrame) -> DataFrame:
    """id, label; raises for a point whose granule has no label."""
    lost = F.raise_error(F.concat(F.lit("no label for point "), F.col("id").cast("string"))).cast("int")
    return points.select("id", "g").join(labels, "g", "left").select("id", F.coalesce("label", lost).alias("label"))


def centroid_round(points: DataFrame, labels: DataFrame) -> DataFrame:
    """One Lloyd round on points (id, x, y) with labels (id, label); ties to the smaller label. The
    centroids, one for each label, reach the points as one array: no point is shuffled for them."""
    c = points.join(labels, "id").groupBy("label").agg(F.avg("x").alias("mx"), F.avg("y").alias("my"))
    one = c.agg(F.collect_list(F.struct("mx", "my", "label")).alias("cs"))
    near = F.expr("array_min(transform(cs, c -> struct((x - c.mx) * (x - c.mx) + (y - c.my) * (y - c.my) as d, c.label as label))).label")
    return points.crossJoin(F.broadcast(one)).select("id", near.alias("label"))


def centroid_refine(points: DataFrame, labels: DataFrame, rounds: int = 2) -> DataFrame:
    """Lloyd rounds on points (id, x, y); a round that empties a cluster or changes nothing is the last
    and does not count."""
    now = durable(labels.select("id", "label"))
    k = now.select("label").distinct().count()
    for _ in range(rounds if k > 1 else 0):
        new = durable(centroid_round(points, now))
        moved = new.join(now.withColumnRenamed("label", "old"), "id").where("label != old").limit(1).count()
        if not moved or new.select("label").distinct().count() < k:
            break
        now = new
    return now


def wants_refinement(labels: DataFrame, k: int) -> DataFrame:
    """One row: the points' clusters are out of balance (limits .85/.05 up to two clusters, else .70/.03)."""
    high, low = (0.85, 0.05) if k <= 2 else (0.70, 0.03)
    return ratios(labels).selectExpr("largest", "smallest", f"largest > {high} or smallest < {low} as refine")


def keep_refined(old: DataFrame, new: DataFrame) -> DataFrame:
    """One row: new labels stay if there are as many clusters and neither ratio is worse."""
    a, b = ratios(old).toDF("l0", "s0", "c0"), ratios(new).toDF("l1", "s1", "c1")
    return a.crossJoin(b).selectExpr("l0", "l1", "s0", "s1", "c0 = c1 and l1 <= l0 and s1 >= s0 as keep")


def safe_for_k(old: DataFrame, new: DataFrame, k: int, most: float = 0.35) -> DataFrame:
    """`safe` for a known number of clusters: k of them, none over .92 or under .01 (from three
    clusters on .65 and .025)."""
    high, low = (0.92, 0.01) if k <= 2 else (0.65, 0.025)
    both = ratios(new).crossJoin(changed(old, new))
    return both.selectExpr("largest", "smallest", "clusters", "changed", f"clusters = {k} and largest <= {high} and smallest >= {low} and changed <= {most} as accepted")


def changed_mass(old: DataFrame, new: DataFrame, mass: DataFrame) -> DataFrame:
    """One row: the share of the points (mass: g, n) whose granule changes its label."""
    both = old.join(new.withColumnRenamed("label", "label_new"), "g").join(mass, "g")
    return both.agg((F.sum(F.when(F.col("label") != F.col("label_new"), F.col("n")).otherwise(0)) / F.greatest(F.sum("n"), F.lit(1))).alias("changed_mass"))
