"""Internal scores, external metrics, paired tests."""

from __future__ import annotations

import itertools
import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granula.operators.labels import ratios, representative_pairs, representatives
from granula.operators.scale import unit_scale


def internal_score(dpc: DataFrame, labels: DataFrame, pairs: DataFrame, high: float = 0.85, low: float = 0.02) -> DataFrame:
    """One row: separation, compactness, score. Mean distance of representatives over the mean of
    the clusters' block means (zero diagonals included); times 0.20 if a cluster is over `high`, times
    0.50 if one is under `low`; one cluster: -1e18."""
    raw = F.expr(f"separation / (compactness + 1e-12) * if(largest > {high}, 0.20, 1) * if(smallest < {low}, 0.50, 1)")
    return _blocks(dpc, labels, pairs).select(F.coalesce("separation", F.lit(0.0)).alias("separation"), "compactness", F.when(F.col("clusters") < 2, -1e18).otherwise(raw).alias("score"))


def strict_score(dpc: DataFrame, labels: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
    """One row: the internal score for exactly k clusters: -1e18 with another number or with a cluster
    over .92 or under .01 (k = 2; else .65 and .025); less for what the largest has over its share, and
    a tenth if a cluster is a single granule."""
    high, low = (0.92, 0.01) if k == 2 else (0.65, 0.025)
    raw = F.expr(f"separation / (compactness + 1e-12) / (1 + 8 * greatest(largest - {1 / k}, 0)) * if(least <= 1, 0.10, 1)")
    bad = F.expr(f"clusters < 2 or clusters != {k} or largest > {high} or smallest < {low}")
    return _blocks(dpc, labels, pairs).select("separation", "compactness", F.when(bad, -1e18).otherwise(raw).alias("score"))


def _blocks(dpc: DataFrame, labels: DataFrame, pairs: DataFrame) -> DataFrame:
    """One row: separation, compactness, the clusters' ratios and `least`, the smallest size."""
    sep = representative_pairs(representatives(dpc, labels), pairs).agg(F.avg("d").alias("separation"))
    a, b = labels.selectExpr("g as i", "label as li"), labels.selectExpr("g as j", "label as lj")
    size = labels.groupBy("label").agg(F.count("*").alias("m"))
    inner = pairs.join(a, "i").join(b, "j").where("li = lj").groupBy(F.col("li").alias("label")).agg(F.sum("d").alias("s"))
    comp = size.join(inner, "label", "left").agg(F.avg(F.coalesce(F.expr("s / (m * m)"), F.lit(0.0))).alias("compactness"), F.min("m").alias("least"))
    return sep.crossJoin(comp).crossJoin(ratios(labels))


def weighted_score(dpc: DataFrame, labels: DataFrame, pairs: DataFrame, mass: DataFrame) -> DataFrame:
    """One row: separation over the mass-weighted mean distance to the representatives."""
    reps = representatives(dpc, labels)
    sep = representative_pairs(reps, pairs).agg(F.avg("d").alias("separation"))
    own = labels.join(reps.select("label", F.col("g").alias("rep")), "label").join(mass, "g")
    d = own.join(pairs.selectExpr("i as g", "j as rep", "d"), ["g", "rep"], "left")
    comp = d.agg((F.sum(F.coalesce("d", F.lit(0.0)) * F.col("n")) / F.sum("n")).alias("compactness"))
    return sep.crossJoin(comp).selectExpr("separation", "compactness", "separation / (compactness + 1e-12) as score")


def mass_score(dpc: DataFrame, labels: DataFrame, pairs: DataFrame, mass: DataFrame, products: bool = True, high: float = 0.92, low: float = 0.01, factor: float = 0.20) -> DataFrame:
    """One row: weighted_score, its separation weighed by products of the clusters' masses (or plain),
    times `factor` if a cluster has over `high` of the mass, times 0.50 if one has under `low`; one
    cluster: -1e18."""
    size = labels.join(mass, "g").groupBy("label").agg(F.sum("n").alias("m"))
    reps = representatives(dpc, labels)
    far = representative_pairs(reps, pairs).join(size.toDF("li", "mi"), "li").join(size.toDF("lj", "mj"), "lj")
    w = F.expr("mi * mj") if products else F.lit(1.0)
    sep = far.agg((F.sum(w * F.col("d")) / F.sum(w)).alias("separation"))
    comp = weighted_score(dpc, labels, pairs, mass).select("compactness")
    raw = F.expr(f"separation / (compactness + 1e-12) * if(largest > {high}, {factor}, 1) * if(smallest < {low}, 0.50, 1)")
    return sep.crossJoin(comp).crossJoin(ratios(labels.join(mass, "g"), "n")).select("separation", "compactness", F.when(F.col("clusters") < 2, -1e18).otherwise(raw).alias("score"))


def contingency(labels: DataFrame, true: str = "label", pred: str = "pred") -> DataFrame:
    return labels.groupBy(F.col(true).alias("t"), F.col(pred).alias("p")).agg(F.count("*").alias("n"))


def nmi(table: DataFrame) -> DataFrame:
    """Mutual information over the arithmetic mean of the entropies; two single clusters: 1."""
    n = table.agg(F.sum("n").alias("all"))
    t, p = (table.groupBy(c).agg(F.sum("n").alias(f"n{c}")) for c in "tp")
    mi = table.join(t, "t").join(p, "p").crossJoin(F.broadcast(n)).agg(F.sum(F.expr("n / all * ln(n * all / (nt * np))")).alias("mi"))
    ent = lambda d, c: d.crossJoin(F.broadcast(n)).agg((-F.sum(F.expr(f"n{c} / all * ln(n{c} / all)"))).alias(f"h{c}"))
    return mi.crossJoin(ent(t, "t")).crossJoin(ent(p, "p")).select(F.expr("case when ht + hp = 0 then 1.0 else greatest(0.0, mi / ((ht + hp) / 2)) end").alias("nmi"))


def ari(table: DataFrame) -> DataFrame:
    two = lambda c: F.sum(F.expr(f"{c} * ({c} - 1) / 2D"))
    t, p = (table.groupBy(c).agg(F.sum("n").alias("m")).agg(two("m").alias(f"s{c}")) for c in "tp")
    one = table.agg(two("n").alias("s"), F.sum("n").alias("all")).crossJoin(t).crossJoin(p)
    expect = "st * sp / (all * (all - 1) / 2D)"
    return one.select(F.expr(f"case when (st + sp) / 2 = {expect} then 1.0 else (s - {expect}) / ((st + sp) / 2 - {expect}) end").alias("ari"))


def _assign(gain: list[list[int]]) -> list[int]:
    """Column of each row of a square matrix in an assignment of the largest total: shortest
    augmenting paths with potentials."""
    n = len(gain)
    cost = [[-v for v in row] for row in gain]
    inf = float("inf")
    u, v, owner, way = [0.0] * (n + 1), [0.0] * (n + 1), [0] * (n + 1), [0] * (n + 1)
    for row in range(1, n + 1):
        owner[0], col = row, 0
        least, used = [inf] * (n + 1), [False] * (n + 1)
        while True:
            used[col] = True
            r, step, nxt = owner[col], inf, 0
            for c in range(1, n + 1):
                if not used[c]:
                    d = cost[r - 1][c - 1] - u[r] - v[c]
                    if d < least[c]:
                        least[c], way[c] = d, col
                    if least[c] < step:
                        step, nxt = least[c], c
            for c in range(n + 1):
                if used[c]:
                    u[owner[c]] += step
                    v[c] -= step
                else:
                    least[c] -= step
            col = nxt
            if not owner[col]:
                break
        while col:
            owner[col] = owner[way[col]]
            col = way[col]
    out = [0] * n
    for c in range(1, n + 1):
        out[owner[c] - 1] = c - 1
    return out


def accuracy(table: DataFrame) -> tuple[float, dict]:
    """(accuracy, predicted -> true label) under the best one-to-one alignment. The table has one
    row per pair of labels; over 2000 labels it raises."""
    rows = table.limit(2000 * 2000 + 1).collect()
    ts, ps = sorted({r.t for r in rows}), sorted({r.p for r in rows})
    k = max(len(ts), len(ps))
    if k > 2000:
        raise ValueError("over 2000 labels")
    if not k:
        return 0.0, {}
    gain = [[0] * k for _ in range(k)]
    for r in rows:
        gain[ps.index(r.p)][ts.index(r.t)] = r.n
    to = _assign(gain)
    total = sum(map(sum, gain))
    return sum(gain[i][to[i]] for i in range(k)) / total, {ps[i]: ts[to[i]] if to[i] < len(ts) else -1 for i in range(len(ps))}


def wilcoxon(pairs: DataFrame) -> DataFrame:
    """pairs (test, a, b): test, m, w_plus, w_minus, statistic; zero differences drop out, tied
    ranks are averaged."""
    d = pairs.selectExpr("test", "round(a - b, 12) as d").where("d != 0").withColumn("ad", F.abs("d"))
    w = Window.partitionBy("test")
    d = d.withColumn("r", F.rank().over(w.orderBy("ad")) + (F.count("*").over(Window.partitionBy("test", "ad")) - 1) / 2)
    out = d.groupBy("test").agg(F.count("*").alias("m"), F.sum(F.when(F.col("d") > 0, F.col("r")).otherwise(0.0)).alias("w_plus"), F.sum(F.when(F.col("d") < 0, F.col("r")).otherwise(0.0)).alias("w_minus"))
    return out.withColumn("statistic", F.least("w_plus", "w_minus"))


def wilcoxon_p(m: int, statistic: float, side: str = "two") -> float:
    """Exact p of a signed-rank statistic without ties: subsets of 1..m by their sum. two: of the
    smaller rank sum; greater: of the sum of the positive ranks, for a > b."""
    ways = [1] + [0] * (m * (m + 1) // 2)
    for r in range(1, m + 1):
        for s in range(len(ways) - 1, r - 1, -1):
            ways[s] += ways[s - r]
    if side == "greater":
        return sum(itertools.islice(ways, math.ceil(statistic), None)) / 2**m
    return min(1.0, 2 * sum(itertools.islice(ways, int(statistic) + 1)) / 2**m)


def wilcoxon_tests(pairs: DataFrame, exact: int = 50) -> DataFrame:
    """wilcoxon with p_two and p_greater: exact up to `exact` differences without ties, else by the
    normal approximation with tie correction. One row for each test goes through Python."""
    d = pairs.selectExpr("test", "round(abs(a - b), 12) as ad").where("ad != 0").groupBy("test", "ad").agg(F.count("*").alias("t"))
    tied = d.groupBy("test").agg(F.sum(F.expr("t * t * t - t")).alias("ties"))

    def run(batches):
        for pdf in batches:
            two, one = [], []
            for m, plus, minus, ties in zip(pdf["m"], pdf["w_plus"], pdf["w_minus"], pdf["ties"], strict=True):
                if m <= exact and not ties:
                    two.append(wilcoxon_p(m, min(plus, minus)))
                    one.append(wilcoxon_p(m, plus, "greater"))
                else:
                    sd = math.sqrt((m * (m + 1) * (2 * m + 1) - ties / 2) / 24)
                    z = (plus - m * (m + 1) / 4) / sd if sd else 0.0
                    two.append(math.erfc(abs(z) / math.sqrt(2)))
                    one.append(math.erfc(z / math.sqrt(2)) / 2)
            yield pdf.drop(columns="ties").assign(p_two=two, p_greater=one)

    t = wilcoxon(pairs).join(tied, "test").select("test", "m", "w_plus", "w_minus", "statistic", "ties")
    names = ", ".join(f"`{n}` {k}" for n, k in t.drop("ties").dtypes)
    return t.mapInPandas(run, f"{names}, p_two double, p_greater double")


def repeat_means(rows: DataFrame, by: str, columns: list[str]) -> DataFrame:
    """Means of the metrics of repeated runs, with their number."""
    return rows.groupBy(by).agg(*(F.avg(c).alias(c) for c in columns), F.count("*").alias("repeats"))


def centre_score(rho: F.Column, delta: F.Column, occurrence: F.Column) -> F.Column:
    """Scaled density times scaled delta, up to a fifth more for what is often a neighbour."""
    return unit_scale(rho) * unit_scale(delta) * (1 + 0.2 * unit_scale(occurrence))


def summary(rows: DataFrame, rank: str, mode: str) -> DataFrame:
    """One row: least, mean and largest rank, and how many rows have each mode."""
    counts = rows.groupBy(mode).agg(F.count("*").alias("c")).agg(F.sort_array(F.collect_list(F.concat_ws("=", mode, "c"))).alias("m")).select(F.concat_ws(" ", "m").alias("modes"))
    return rows.agg(F.min(rank).alias("least"), F.avg(rank).alias("mean"), F.max(rank).alias("most")).crossJoin(counts)


def holm(tests: DataFrame, alpha: float = 0.05) -> DataFrame:
    """tests (test, p): adjusted p, flags before and after."""
    by = Window.orderBy("p", "test")
    t = tests.withColumn("i", F.row_number().over(by)).withColumn("m", F.count("*").over(Window.partitionBy()))
    adj = F.least(F.lit(1.0), F.max(F.expr("(m - i + 1) * p")).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return t.withColumn("adjusted", adj).select("test", "p", "adjusted", (F.col("p") < alpha).alias("raw_significant"), (F.col("adjusted") < alpha).alias("significant"))


def win_tie_loss(pairs: DataFrame, tol: float = 1e-8) -> DataFrame:
    d = pairs.withColumn("d", F.col("a") - F.col("b"))
    return d.groupBy("test").agg(F.count_if(F.col("d") > 0).alias("win"), F.count_if(F.abs("d") <= F.lit(tol)).alias("tie"), F.count_if(F.col("d") < 0).alias("loss"))
