"""Refinement of granule labels by natural neighbours: proposals, acceptance, choice (L10-L15, L18, L19,
A7, A8).

All proposals of a pass are computed from the same labels, so a pass is joins and aggregates over the
edges (i, j, d, r, s) and the pairs (i, j, d). Every operator takes dpc (g, rho, delta, parent), labels
(g, label) and mass (g, n) tables.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granula.functions.state import durable
from granula.operators import dpc as peaks
from granula.operators import labels as lab
from granula.operators import natural, score
from granula.operators.scale import unit_scale


@dataclass(frozen=True)
class Rules:
    """When a granule may change its label."""

    probability: float = 0.60  # least share of the best label
    margin: float = 0.15  # between the best and the second share
    signals: int = 2  # of uncertainty
    closer: float = 0.98  # the new cluster's nearest members against the old one's
    members: int = 3
    neighbours: int = 1
    lower: float = 0.30  # weight of neighbours that are no denser


RULES_B, RULES_C = Rules(), Rules(probability=0.62, neighbours=2)


def _signs(dpc: DataFrame, labels: DataFrame, edges: DataFrame) -> DataFrame:
    """g, rho, label, degree, mixed, parted (the parent has another label), same (share of neighbours
    of the own label) of the granules with neighbours."""
    own = dpc.select("g", "rho", "parent").join(labels, "g").join(labels.toDF("parent", "up"), "parent", "left")
    near = edges.join(labels.toDF("j", "lj"), "j").join(labels.toDF("i", "li"), "i").groupBy(F.col("i").alias("g"))
    near = near.agg(F.count("*").alias("degree"), (F.min("lj") != F.max("lj")).alias("mixed"), F.avg((F.col("lj") == F.col("li")).cast("double")).alias("same"))
    return own.join(near, "g").select("g", "rho", "label", "degree", "mixed", F.coalesce(F.col("up") != F.col("label"), F.lit(False)).alias("parted"), "same")


def _best(votes: DataFrame) -> DataFrame:
    """g, best, v, second of votes (g, label, v); ties to the smaller label."""
    o = F.row_number().over(Window.partitionBy("g").orderBy(F.desc("v"), "label"))
    top = votes.withColumn("o", o).where("o <= 2").groupBy("g")
    return top.agg(F.max(F.when(F.col("o") == 1, F.col("label"))).alias("best"), F.max("v").alias("v"), F.coalesce(F.max(F.when(F.col("o") == 2, F.col("v"))), F.lit(0.0)).alias("second"))


def _supported(dpc: DataFrame, labels: DataFrame, edges: DataFrame) -> DataFrame:
    """g, best: labels that some denser neighbour has."""
    rho = dpc.select("g", "rho")
    both = edges.join(rho.toDF("i", "ri"), "i").join(rho.toDF("j", "rj"), "j").where("rj > ri").join(labels.toDF("j", "best"), "j")
    return both.select(F.col("i").alias("g"), "best").distinct().withColumn("supported", F.lit(True))


def _nearness(labels: DataFrame, pairs: DataFrame, members: int) -> DataFrame:
    """g, label, far: mean distance to a cluster's nearest members other than g itself."""
    r = F.row_number().over(Window.partitionBy("i", "label").orderBy("d", "j"))
    near = pairs.join(labels.select(F.col("g").alias("j"), "label"), "j").withColumn("r", r).where(F.col("r") <= members)
    return near.groupBy(F.col("i").alias("g"), "label").agg(F.avg("d").alias("far"))


def _closest(t: DataFrame, labels: DataFrame, pairs: DataFrame, members: int) -> DataFrame:
    near = durable(_nearness(labels, pairs, members))
    t = t.join(near.toDF("g", "best", "there"), ["g", "best"], "left").join(near.toDF("g", "label", "here"), ["g", "label"], "left")
    inf = F.lit(float("inf"))
    return t.withColumn("there", F.coalesce("there", inf)).withColumn("here", F.coalesce("here", inf))


def _outcome(t: DataFrame, centres: DataFrame, tests: list[tuple[str, str]], labels: DataFrame) -> DataFrame:
    """g, label, outcome for every granule: the first test that stops it, else changed."""
    steps = [("centre", "c is not null"), ("alone", "v is null"), *tests]
    t = labels.join(t.drop("label"), "g", "left").join(centres.select("g", F.lit(True).alias("c")), "g", "left")
    out = reduce(lambda e, s: F.when(F.expr(s[1]), s[0]).otherwise(e), reversed(steps), F.lit("changed"))
    return t.withColumn("outcome", out).select("g", F.when(F.col("outcome") == "changed", F.col("best")).otherwise(F.col("label")).cast("int").alias("label"), "outcome")


def propose_membership(dpc: DataFrame, labels: DataFrame, edges: DataFrame, occurrence: DataFrame, centres: DataFrame, pairs: DataFrame, margin: float = 1.5) -> DataFrame:
    """A: among granules with mixed neighbours, a parent of another label or a wide radius, the label of
    the largest fuzzy membership, if it is over margin times the own, a denser neighbour has it and its
    representative is closer. outcome tells where a granule stopped: centre, alone, certain, same,
    margin, support, distance, changed."""
    votes = durable(natural.membership(edges, labels, occurrence).withColumnRenamed("membership", "v"))
    wide = natural.outliers(natural.radii(edges)).select("g", "outlier")
    reps = lab.representatives(dpc, labels).select("label", F.col("g").alias("rep"))
    own = votes.select("g", "label", F.col("v").alias("own"))
    t = _signs(dpc, labels, edges).join(wide, "g").join(_best(votes), "g", "left").join(own, ["g", "label"], "left").join(_supported(dpc, labels, edges), ["g", "best"], "left")
    to = pairs.select(F.col("i").alias("g"), F.col("j").alias("rep"), "d")
    for name, key in (("there", "best"), ("here", "label")):
        t = t.join(reps.toDF(key, "rep"), key, "left").join(to.withColumnRenamed("d", name), ["g", "rep"], "left").withColumn(name, F.coalesce(name, F.lit(0.0))).drop("rep")
    t = t.drop("label").join(labels, "g").withColumn("old", F.col("label"))
    return _outcome(t, centres, [("certain", "not (mixed or parted or outlier)"), ("same", "best = old"), ("margin", f"v <= {margin} * greatest(coalesce(own, 0), 1e-15)"), ("support", "supported is null"), ("distance", "there >= here")], labels)


def propose_weighted(dpc: DataFrame, labels: DataFrame, edges: DataFrame, occurrence: DataFrame, centres: DataFrame, pairs: DataFrame, mass: DataFrame, rules: Rules = RULES_B) -> DataFrame:
    """B: shares of neighbours' votes weighed by similarity, occurrence, density, size and whether they
    are denser; a wide local scale (over the 75% quantile) and an uncertain own label are signals."""
    r = natural.radii(edges)
    rho = dpc.select("g", "rho", (0.2 + 0.8 * unit_scale(F.col("rho"))).alias("u"))
    e = natural.similarity(edges, r, 0.5).join(rho.select(F.col("g").alias("i"), F.col("rho").alias("ri")), "i").join(rho.toDF("j", "rj", "u"), "j")
    e = e.join(occurrence.toDF("j", "occ"), "j").join(mass.toDF("j", "n"), "j").join(labels.select(F.col("g").alias("j"), "label"), "j")
    e = e.withColumn("w", F.expr(f"sim * sqrt(greatest(occ, 1e-12)) * u * sqrt(ln(1 + n)) * if(rj > ri, 1, {rules.lower})"))
    votes = durable(_shares(e))
    cut = r.agg(F.percentile("scale", F.lit(0.75)).alias("cut"))
    wide = r.crossJoin(F.broadcast(cut)).select("g", (F.col("scale") > F.col("cut")).alias("wide"))
    own = votes.select("g", "label", F.col("v").alias("own"))
    t = _signs(dpc, labels, edges).join(wide, "g").join(_best(votes), "g", "left").join(own, ["g", "label"], "left").join(_supported(dpc, labels, edges), ["g", "best"], "left")
    t = _closest(t, labels, pairs, rules.members).withColumn("signals", F.expr(f"int(mixed) + int(parted) + int(coalesce(own, 0) < {rules.probability}) + int(wide)")).withColumn("old", F.col("label"))
    tests = [("certain", f"signals < {rules.signals}"), ("same", "best = old"), ("margin", f"v < {rules.probability} or v - second < {rules.margin}"), ("support", "supported is null"), ("distance", f"there = double('inf') or there >= {rules.closer} * here")]
    return _outcome(t, centres, tests, labels)


def propose_assisted(dpc: DataFrame, labels: DataFrame, edges: DataFrame, support: DataFrame, centres: DataFrame, pairs: DataFrame, mass: DataFrame, rules: Rules = RULES_C) -> DataFrame:
    """C: as B with votes by nearness, ranks, support (`natural.support`), size and log density, at least two
    neighbours, and the other cluster being closer as a signal in place of a wide scale."""
    log = dpc.select("g", "rho", F.log1p(F.greatest("rho", F.lit(0.0))).alias("u"))
    ends = log.agg(F.min("u").alias("lo"), F.max("u").alias("hi"))
    rho = log.crossJoin(F.broadcast(ends)).select("g", "rho", F.expr("if(hi > lo, (u - lo) / (hi - lo), 1D)").alias("u"))
    e = edges.join(rho.select(F.col("g").alias("i"), F.col("rho").alias("ri")), "i").join(rho.toDF("j", "rj", "u"), "j")
    e = e.join(support.toDF("j", "sup"), "j").join(mass.toDF("j", "n"), "j").join(labels.select(F.col("g").alias("j"), "label"), "j")
    e = e.withColumn("w", F.expr(f"1 / (1 + d) * (0.5 + 0.5 / (1 + r + s)) * (0.5 + 0.25 * least(sup, 2)) * sqrt(ln(1 + n)) * (0.5 + 0.5 * u) * if(rj > ri, 1, {rules.lower})"))
    t = _closest(_signs(dpc, labels, edges).join(_best(_shares(e)), "g", "left"), labels, pairs, rules.members).withColumn("old", F.col("label"))
    t = t.withColumn("signals", F.expr(f"int(mixed) + int(parted) + int(same < {rules.probability}) + int(here < double('inf') and best != old and there < here)"))
    tests = [("alone", f"degree < {rules.neighbours}"), ("certain", f"signals < {rules.signals}"), ("same", "best = old"), ("margin", f"v < {rules.probability} or v - second < {rules.margin}"), ("distance", f"there = double('inf') or (here < double('inf') and there > {rules.closer} * here)")]
    return _outcome(t, centres, tests, labels)


def _shares(e: DataFrame) -> DataFrame:
    """g, label, v: the share of a granule's votes (i, label, w) that a label has."""
    votes = e.groupBy(F.col("i").alias("g"), "label").agg(F.sum("w").alias("v"))
    return votes.withColumn("v", F.col("v") / F.sum("v").over(Window.partitionBy("g")))


def assign_rounds(dpc: DataFrame, labels: DataFrame, edges: DataFrame, ambiguous: DataFrame, centres: DataFrame, pairs: DataFrame, mass: DataFrame, margin: float = 0.15, rounds: int = 10) -> DataFrame:
    """Batch rounds over the ambiguous granules (g): each takes the label of the largest membership, by
    nearness, the neighbour's own context, density and size, if its margin over the second is enough.
    A round sees the labels of the one before; labels below 0 that are left take the nearest centre's."""
    w = edges.withColumn("w", 1 / (1 + F.col("d")))
    into = w.groupBy(F.col("i").alias("j")).agg(F.greatest(F.sum("w"), F.lit(1e-12)).alias("wj"))
    trust = dpc.select("g", "rho").join(mass, "g").select(F.col("g").alias("j"), F.expr("greatest(rho, 1e-12) * sqrt(greatest(n, 1))").alias("t"))
    open_ = ambiguous.select(F.col("g").alias("i")).join(centres.select(F.col("g").alias("i")), "i", "left_anti")
    votes = durable(w.join(into, "j").join(trust, "j").join(open_, "i", "left_semi").select("i", "j", F.expr("w / wj * w * t").alias("v")))
    now = durable(labels)
    for _ in range(rounds):
        got = votes.join(now.select(F.col("g").alias("j"), "label").where("label >= 0"), "j").groupBy(F.col("i").alias("g"), "label").agg(F.sum("v").alias("v"))
        move = _best(got).where(f"(v - second) / (v + 1e-12) >= {margin}").select("g", "best")
        new = durable(now.join(move, "g", "left").select("g", F.coalesce("best", "label").cast("int").alias("label"), (F.coalesce("best", "label") != F.col("label")).alias("moved")))
        now = new.select("g", "label")
        if not new.where("moved").limit(1).count():
            break
    near = lab.nearest_centre(pairs, centres)
    return now.join(near, "g", "left").select("g", F.when(F.col("label") < 0, F.col("near")).otherwise(F.col("label")).cast("int").alias("label"))


def _limits(old: DataFrame, new: DataFrame, mass: DataFrame | None = None) -> DataFrame:
    """One row: largest and smallest (of new; by mass if given), changed, changed_mass, same_count."""
    weigh = lambda x: x.join(mass, "g") if mass is not None else x
    a = lab.ratios(old).select(F.col("clusters").alias("before"))
    out = lab.ratios(weigh(new), None if mass is None else "n").crossJoin(a).crossJoin(lab.changed(old, new))
    out = out.crossJoin(lab.changed_mass(old, new, mass) if mass is not None else out.sparkSession.range(1).select(F.lit(0.0).alias("changed_mass")))
    return out.selectExpr("largest", "smallest", "changed", "changed_mass", "before = clusters as same_count")


def _scores(make, old: DataFrame, new: DataFrame) -> DataFrame:
    return make(old).select(F.col("score").alias("old_score")).crossJoin(make(new).select(F.col("score").alias("new_score")))


def _consistencies(old: DataFrame, new: DataFrame, edges: DataFrame) -> DataFrame:
    return natural.consistency(edges, old).toDF("old_consistency").crossJoin(natural.consistency(edges, new).toDF("new_consistency"))


def accept_membership(dpc: DataFrame, old: DataFrame, new: DataFrame, pairs: DataFrame, edges: DataFrame, largest: float = 0.85, changed: float = 0.35) -> DataFrame:
    """A: something changes, within the limits, and neither score nor consistency falls."""
    t = _limits(old, new).crossJoin(_scores(lambda x: score.internal_score(dpc, x, pairs), old, new)).crossJoin(_consistencies(old, new, edges))
    return t.withColumn("accepted", F.expr(f"changed > 0 and same_count and largest <= {largest} and changed <= {changed} and new_score + 1e-12 >= old_score and new_consistency + 1e-12 >= old_consistency"))


def accept_weighted(dpc: DataFrame, old: DataFrame, new: DataFrame, pairs: DataFrame, edges: DataFrame, mass: DataFrame, gain: float = 0.002, tolerance: float = 0.002, changed: float = 0.20, points: float = 0.10, largest: float = 0.90) -> DataFrame:
    """B: few granules and points change and the point-weighted score gains by `gain`."""
    make = lambda x: score.mass_score(dpc, x, pairs, mass, False, 0.90, 0.01, 0.25)
    t = _limits(old, new, mass).crossJoin(_scores(make, old, new)).crossJoin(_consistencies(old, new, edges)).withColumn("gain", F.expr("(new_score - old_score) / (abs(old_score) + 1e-12)"))
    return t.withColumn("accepted", F.expr(f"changed > 0 and same_count and changed <= {changed} and changed_mass <= {points} and largest <= {largest} and gain >= {gain} and new_consistency + {tolerance} >= old_consistency"))


def accept_assisted(old: DataFrame, new: DataFrame, mass: DataFrame, changed: float = 0.15, points: float = 0.08, largest: float = 0.92) -> DataFrame:
    """C: the limits alone."""
    return _limits(old, new, mass).withColumn("accepted", F.expr(f"same_count and changed <= {changed} and changed_mass <= {points} and largest <= {largest}"))


def accept_rounds(dpc: DataFrame, old: DataFrame, new: DataFrame, pairs: DataFrame, changed: float = 0.35, largest: float = 0.85, smallest: float = 0.01, tolerance: float = 1e-12) -> DataFrame:
    """D: within the limits, and the score does not fall."""
    t = _limits(old, new).crossJoin(_scores(lambda x: score.internal_score(dpc, x, pairs, largest, smallest), old, new))
    return t.withColumn("accepted", F.expr(f"same_count and changed <= {changed} and largest <= {largest} and smallest >= {smallest} and new_score + {tolerance} >= old_score"))


def pick_candidate(dpc: DataFrame, pairs: DataFrame, edges: DataFrame, mass: DataFrame, baseline: DataFrame, candidates: dict[str, DataFrame], least: float = 0.005) -> DataFrame:
    """name, score, consistency, changed, gain, chosen of the baseline and of each candidate labelling
    that equals none before it. Gain: log of the score's ratio to the baseline's, + 0.25 of the gain in
    consistency, - 0.75 of the share of granules changed; the baseline stays unless one gains `least`."""
    named = [("baseline", baseline), *candidates.items()]
    all_ = durable(reduce(DataFrame.union, [x.select(F.lit(c).alias("c"), F.lit(name).alias("name"), "g", F.col("label").cast("int").alias("label")) for c, (name, x) in enumerate(named)]))
    same = all_.groupBy("c", "name").agg(F.sha2(F.concat_ws(",", F.transform(F.sort_array(F.collect_list(F.struct("g", "label"))), lambda x: x["label"].cast("string"))), 256).alias("sha"))
    keep = same.withColumn("o", F.row_number().over(Window.partitionBy("sha").orderBy("c"))).where("o = 1").select("c")
    cand = durable(all_.join(keep, "c", "left_semi"))
    with_mass = cand.join(mass, "g")
    reps = dpc.join(cand, "g").groupBy("c", "label").agg(F.max(F.struct("rho", (-F.col("g")).alias("n"))).getField("n").alias("n")).select("c", "label", (-F.col("n")).alias("rep"))
    size = with_mass.groupBy("c", "label").agg(F.sum("n").alias("m"))
    r = reps.join(size, ["c", "label"])
    sep = r.select("c", F.col("rep").alias("i"), F.col("m").alias("mi"), F.col("label").alias("li")).join(r.select("c", F.col("rep").alias("j"), F.col("m").alias("mj"), F.col("label").alias("lj")), "c").where("li < lj").join(pairs, ["i", "j"])
    sep = sep.groupBy("c").agg((F.sum(F.expr("mi * mj * d")) / F.sum(F.expr("mi * mj"))).alias("separation"))
    comp = with_mass.join(reps, ["c", "label"]).join(pairs.toDF("g", "rep", "d"), ["g", "rep"], "left").groupBy("c").agg((F.sum(F.coalesce("d", F.lit(0.0)) * F.col("n")) / F.sum("n")).alias("compactness"))
    part = size.groupBy("c").agg((F.max("m") / F.sum("m")).alias("largest"), (F.min("m") / F.sum("m")).alias("smallest"), F.count("*").alias("clusters"))
    w = edges.join(mass.toDF("i", "ni"), "i").join(mass.toDF("j", "nj"), "j").selectExpr("i", "j", "sqrt(ni * nj) / (1 + d) as w").where("i < j").distinct()
    both = w.join(cand.select("c", F.col("g").alias("i"), F.col("label").alias("li")), "i").join(cand.select("c", F.col("g").alias("j"), F.col("label").alias("lj")), ["c", "j"])
    cons = both.groupBy("c").agg((F.sum(F.when(F.col("li") == F.col("lj"), F.col("w")).otherwise(0.0)) / F.sum("w")).alias("consistency"))
    base = cand.where("c = 0").select("g", F.col("label").alias("old"))
    moved = cand.join(base, "g").groupBy("c", "name").agg(F.avg((F.col("label") != F.col("old")).cast("double")).alias("changed"))
    t = moved.join(part, "c").join(comp, "c").join(sep, "c", "left").join(cons, "c", "left")
    t = durable(t.selectExpr("c", "name", "changed", "coalesce(consistency, 0D) as consistency", "if(clusters < 2, -1e18D, separation / (compactness + 1e-12) * if(largest > 0.92, 0.20, 1) * if(smallest < 0.01, 0.50, 1)) as score"))
    zero = t.where("c = 0").select(F.col("score").alias("s0"), F.col("consistency").alias("a0"))
    t = t.crossJoin(F.broadcast(zero)).withColumn("gain", F.expr("ln(greatest(score, 1e-12) / greatest(s0, 1e-12)) + 0.25 * (consistency - a0) - 0.75 * changed"))
    best = F.row_number().over(Window.orderBy(F.desc(F.when((F.col("c") > 0) & (F.col("gain") >= least), F.col("gain")).otherwise(F.when(F.col("c") == 0, F.lit(least / 2)))), "c"))
    return t.withColumn("o", best).select("name", "score", "consistency", "changed", "gain", (F.col("o") == 1).alias("chosen"))


def best_labels(dpc: DataFrame, pairs: DataFrame, counts, margin: float = 1.75, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """(candidates, labels): for every number of centres the plain labels and, if they are safe, those
    of the graph; the best internal score wins, the first of equal ones. strict: the score for a known
    number of clusters. candidates: k, mode, score, chosen."""
    made: list[tuple[int, str, DataFrame]] = []
    for k in dict.fromkeys(counts):
        centres = durable(peaks.separated(dpc, pairs, k))
        plain = durable(lab.propagate(dpc, centres, pairs))
        voted = durable(lab.graph_vote(dpc, pairs, plain, centres, margin))
        made.append((k, "single", plain))
        if (lab.safe_for_k(plain, voted, k) if strict else lab.safe(plain, voted)).first().accepted:
            made.append((k, "graph", voted))
    make = lambda k, x: score.strict_score(dpc, x, pairs, k) if strict else score.internal_score(dpc, x, pairs)
    rows = [make(k, x).select(F.lit(c).alias("c"), F.lit(k).alias("k"), F.lit(mode).alias("mode"), "score") for c, (k, mode, x) in enumerate(made)]
    table = durable(reduce(DataFrame.union, rows))
    table = table.withColumn("chosen", F.row_number().over(Window.orderBy(F.desc("score"), "c")) == 1)
    return table.select("k", "mode", "score", "chosen"), made[table.where("chosen").first().c][2]


def best_config(rows: DataFrame) -> DataFrame:
    """rows (k, score, consistency) with chosen: the best score; within 1e-12 of it the best
    consistency, then the smallest k."""
    top = rows.agg(F.max("score").alias("top"))
    t = rows.crossJoin(F.broadcast(top)).withColumn("tied", F.expr("score >= top - 1e-12"))
    o = F.row_number().over(Window.orderBy(F.desc("tied"), F.desc(F.when(F.col("tied"), F.col("consistency")).otherwise(F.col("score"))), "k"))
    return t.withColumn("o", o).select("k", "score", "consistency", (F.col("o") == 1).alias("chosen"))
