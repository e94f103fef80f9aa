"""The clustering step of a run as a distributed plan: attributes, centres, labels of granules.

Nearest denser granules, and the several that vote, come from the pivot index; nothing is a matrix of
granules, no group holds all of them. Two things look at all pairs, block by block: the quantile and the
median that set the least distance of centres, for they are defined over all pairs (a histogram that is
refined leaves a task, not a distance); and the row of a granule that has no denser one. Centres
(k of them) and bounded batches of candidates are what the driver gets.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granula.functions.state import durable
from granula.operators import candidates, dpc, graph, index, natural, refine, score
from granula.operators import labels as lab
from granula.sources import io

#: Candidates for centres that the driver fetches at a time, and bins of a histogram.
BATCH, BINS = 256, 4096
#: Granules whose pairs are a table of the size of the points' own: they are about the root of the points.
KEPT = 8192


def distances(x: np.ndarray, xc: np.ndarray | None, y: np.ndarray, yc: np.ndarray | None) -> np.ndarray:
    """All distances of rows x and y, plain or in the mean of both shapes."""
    if xc is None or not xc.size:
        return index._gaps(x, y)
    out, n = np.empty((len(x), len(y))), x.shape[1]
    yc = yc.reshape(-1, n, n)
    step = max(1, (1 << 18) // (n * n))
    for i, (row, shape) in enumerate(zip(x, xc.reshape(-1, n, n), strict=True)):
        for a in range(0, len(y), step):
            diff = row - y[a : a + step]
            out[i, a : a + step] = np.sqrt(np.maximum((diff * np.linalg.solve((shape + yc[a : a + step]) / 2, diff[:, :, None])[:, :, 0]).sum(axis=1), 0))
    return out


def _arrays(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    return index._stack(pdf["centre"]), index._stack(pdf["cov"])


def to_few(rows: DataFrame, few: pd.DataFrame) -> DataFrame:
    """g, d: the distances to each of a few granules (g, centre, cov), in their order."""
    y, yc = _arrays(few)

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"g": pdf["g"], "d": list(distances(*_arrays(pdf), y, yc))})

    return rows.select("g", "centre", "cov").mapInPandas(run, "g long, d array<double>")


def _block_pairs(rows: DataFrame, m: int, run, schema: str) -> DataFrame:
    """run(i, j, distances) over the pairs i < j of a block of granules and another or itself. In shapes, where a
    distance is a system of equations, blocks are small, so that the work is dealt out."""
    blocks = -(-m // index.block(rows))
    part = F.pmod(F.xxhash64("g"), F.lit(blocks)).cast("int")
    every = F.sequence(F.lit(0), F.lit(blocks - 1))
    left = rows.select("g", "centre", "cov", part.alias("a")).withColumn("b", F.explode(F.filter(every, lambda x: x >= F.col("a"))))
    right = rows.select("g", "centre", "cov", part.alias("b")).withColumn("a", F.explode(F.filter(every, lambda x: x <= F.col("b"))))

    def both(key, p: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        none = np.zeros(0, np.int64)
        if not len(p) or not len(q):
            return run(none, none, np.zeros(0))
        i, j = np.repeat(p["g"].to_numpy(), len(q)), np.tile(q["g"].to_numpy(), len(p))
        d = distances(*_arrays(p), *_arrays(q)).ravel()
        ok = i < j if key[0] == key[1] else i != j
        return run(np.minimum(i, j)[ok], np.maximum(i, j)[ok], d[ok])

    right = right.toDF(*right.columns)
    return left.groupBy("a", "b").cogroup(right.groupBy("a", "b")).applyInPandas(both, schema)


def half_pairs(rows: DataFrame, m: int) -> DataFrame:
    """i < j, d of all granules, written once."""
    return durable(_block_pairs(rows, m, lambda i, j, d: pd.DataFrame({"i": i, "j": j, "d": d}), "i long, j long, d double"))


def quantiles(rows: DataFrame, m: int, shares: tuple[float, ...], pairs: DataFrame | None = None) -> list[float]:
    """Quantiles, interpolated, of all positive pair distances: histograms about the wanted ranks, each
    round BINS times finer, until a bin's values fit into one more histogram or are all the same. The
    distances of up to KEPT granules are written once (or come as pairs), else each round makes them again."""
    if pairs is None and m <= KEPT:
        pairs = half_pairs(rows, m)

    def each(run, schema: str) -> DataFrame:
        if pairs is None:
            return _block_pairs(rows, m, lambda i, j, d: run(d[d > 0]), schema)

        def batches_(batches):
            for pdf in batches:
                yield run(pdf["d"].to_numpy())

        return pairs.where("i < j and d > 0").select("d").mapInPandas(batches_, schema)

    ends = each(lambda d: pd.DataFrame({"lo": [d.min(initial=np.inf)], "hi": [d.max(initial=-np.inf)], "n": [len(d)]}), "lo double, hi double, n long").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"), F.sum("n").alias("n")).first()
    if not ends["n"]:
        return [0.0] * len(shares)
    ranks = sorted({int(r) for s in shares for r in (math.floor(s * (ends["n"] - 1)), math.ceil(s * (ends["n"] - 1)))})
    spans = {r: (ends["lo"], ends["hi"], 0) for r in ranks}  # low, high (both within), values below low
    found: dict[int, float] = {}
    while spans:
        asked = sorted({(lo, hi) for lo, hi, _ in spans.values()})

        def count(d, asked=asked):
            out = []
            for s, (lo, hi) in enumerate(asked):
                v = d[(d >= lo) & (d <= hi)]
                bin_ = np.minimum((v - lo) * (BINS / (hi - lo)) if hi > lo else np.zeros(len(v)), BINS - 1).astype(int)
                order = np.argsort(bin_, kind="stable")
                at, start, n = np.unique(bin_[order], return_index=True, return_counts=True)
                if len(at):
                    v = v[order]
                    out.append(pd.DataFrame({"s": s, "bin": at, "n": n, "lo": np.minimum.reduceat(v, start), "hi": np.maximum.reduceat(v, start)}))
            return pd.concat(out) if out else pd.DataFrame({"s": [], "bin": [], "n": [], "lo": [], "hi": []})

        got = each(count, "s int, bin int, n long, lo double, hi double").groupBy("s", "bin").agg(F.sum("n").alias("n"), F.min("lo").alias("lo"), F.max("hi").alias("hi")).toPandas()
        later = {}
        for r, (lo, hi, below) in spans.items():
            t = got[got["s"] == asked.index((lo, hi))].sort_values("bin")
            upto = below + t["n"].cumsum().to_numpy()
            k = int(np.searchsorted(upto, r, "right"))
            row, under = t.iloc[k], int(upto[k] - t["n"].iloc[k])
            if row["lo"] == row["hi"] or row["n"] == 1:
                found[r] = float(row["lo"])
            elif row["n"] == 2:
                found[r] = float(row["lo"] if r == under else row["hi"])
            else:
                later[r] = (float(row["lo"]), float(row["hi"]), under)
        spans = later
    out = []
    for s in shares:
        at = s * (ends["n"] - 1)
        a, b = found[math.floor(at)], found[math.ceil(at)]
        out.append(a + (b - a) * (at - math.floor(at)))
    return out


def attributes(rows: DataFrame, links: DataFrame, mode: str) -> DataFrame:
    """g, rho, delta, parent of the nearest links (i, j, d, r): the modes strict, row, ordered and ball of
    `dpc.attributes`; links of the last two come from an order without ties."""
    near = links.where("r = 1").select(F.col("i").alias("g"), F.col("j").alias("parent"), F.col("d").alias("delta"))
    t = durable(rows.select("g", "rho").join(near, "g", "left"))
    if mode == "strict":
        most = t.agg(F.max("delta").alias("most"), F.min(F.struct((-F.col("rho")).alias("n"), "g")).getField("g").alias("first"))
        t = t.crossJoin(F.broadcast(most)).withColumn("delta", F.coalesce("delta", F.when(F.col("g") == F.col("first"), F.col("most")), F.lit(0.0)))
        return t.select("g", "rho", "delta", "parent")
    # The farthest granule of those without a denser one, a batch of them at a time.
    lone = t.where("parent is null").join(rows.select("g", "centre", "cov"), "g").orderBy("g")
    far: list[tuple[int, float]] = []
    for batch in _batches(lone.select("g", "centre", "cov")):
        top = to_few(rows, batch).select(F.posexplode("d").alias("p", "d")).groupBy("p").agg(F.max("d").alias("d")).collect()
        far += [(int(batch["g"].iloc[x["p"]]), x["d"]) for x in top]
    most = t.sparkSession.createDataFrame(far, "g long, far double")
    t = t.join(most, "g", "left").withColumn("delta", F.coalesce("delta", "far", F.lit(0.0)))
    if mode == "ball":
        t = durable(t)
        top = t.agg((F.max("delta") < 1).alias("low"), F.min(F.when(F.col("parent").isNull(), F.col("g"))).alias("first"))
        t = t.crossJoin(F.broadcast(top)).withColumn("delta", F.when(F.col("low"), F.col("delta") * 10).otherwise(F.col("delta")))
    return t.select("g", "rho", "delta", "parent")


def _batches(rows: DataFrame):
    """rows (g, ...) in the order of g, BATCH at a time."""
    last = None
    while True:
        got = (rows if last is None else rows.where(F.col("g") > last)).orderBy("g").limit(BATCH).toPandas()
        if len(got):
            yield got
        if len(got) < BATCH:
            return
        last = int(got["g"].iloc[-1])


def chosen_centres(rows: DataFrame, score: DataFrame, k: int, least: float) -> pd.DataFrame:
    """label, g, centre, cov of at most k centres: in the order of score (g, score), those at least `least`
    from all chosen before; what lacks to k comes by score. Candidates come in batches; what
    the chosen ones rule out is dropped where the rows are."""
    table = durable(rows.select("g", "centre", "cov").join(score, "g"))
    by = [F.desc("score"), "g"]
    first = table.orderBy(*by).limit(max(k, BATCH)).toPandas()  # for the refill, too
    kept, open_ = pd.DataFrame(first.iloc[:0]), first
    while len(open_) and len(kept) < k:
        for n in range(len(open_)):
            row = open_.iloc[n : n + 1]
            if len(kept) < k and (not len(kept) or least <= 0 or distances(*_arrays(row), *_arrays(kept)).min() >= least):
                kept = pd.concat([kept, row])
        last = open_.iloc[-1]
        if len(open_) < BATCH or len(kept) >= k:
            break
        rest = table.where((F.col("score") < float(last["score"])) | ((F.col("score") == float(last["score"])) & (F.col("g") > int(last["g"]))))
        free = to_few(rest, kept).where(F.array_min("d") >= least).select("g")
        open_ = rest.join(free, "g").orderBy(*by).limit(BATCH).toPandas()
    more = first[~first["g"].isin(kept["g"])].iloc[: max(0, k - len(kept))]
    kept = pd.concat([kept, more]).reset_index(drop=True)
    return kept.assign(label=range(len(kept)))[["label", "g", "centre", "cov"]]


def all_pairs(rows: DataFrame, m: int) -> DataFrame:
    """i, j, d of all granules, both ways; each distance is made once."""
    half = half_pairs(rows, m)
    return half.union(half.select("j", "i", "d"))


class Natural:
    """The natural neighbours of a run's granules and what hangs on them."""

    def __init__(self, pairs: DataFrame, rule: str):
        knn = durable(natural.ranks(pairs))
        lam = natural.search(knn, rule).first()["natural_k"] or 1
        self.edges = durable(natural.edges(knn, lam))
        self.occurrence = durable(natural.occurrence(knn, lam))


#: The search for natural neighbours that each refinement goes with.
SEARCH = {"fuzzy": "stable", "weighted": "coverage", "reliable": "stable"}


def refined(kind: str, near: Natural, dp: DataFrame, label: DataFrame, centres: DataFrame, pairs: DataFrame, mass: DataFrame) -> DataFrame:
    """The labels after a refinement's own proposal, if its own test accepts them; else as they were."""
    e, occ = near.edges, near.occurrence
    if kind == "fuzzy":
        new = durable(refine.propose_membership(dp, label, e, occ, centres, pairs).select("g", "label"))
        ok = refine.accept_membership(dp, label, new, pairs, e)
    elif kind == "weighted":
        new = durable(refine.propose_weighted(dp, label, e, occ, centres, pairs, mass).select("g", "label"))
        ok = refine.accept_weighted(dp, label, new, pairs, e, mass)
    else:
        sure = durable(graph.reliable(e, dp.select("g", "rho").join(mass, "g"), centres))
        doubt = durable(natural.ambiguous(e, sure, dp).where("ambiguous").select("g"))
        held = centres.select("g", F.lit(True).alias("c"))
        start = sure.join(doubt.withColumn("a", F.lit(True)), "g", "left").join(held, "g", "left").select("g", F.when(F.col("c").isNull() & (F.col("a") | F.col("label").isNull()), -1).otherwise(F.col("label")).cast("int").alias("label"))
        new = durable(refine.assign_rounds(dp, start, e, doubt, centres, pairs, mass))
        ok = refine.accept_rounds(dp, label, new, pairs)
    return new if ok.first()["accepted"] else label


def cluster(stats: DataFrame, cfg) -> DataFrame:
    """g, label, delta, gamma of the granules (g, n, rho, centre, h) by a pipeline's Config."""
    spark = stats.sparkSession
    plain = cfg.density in ("ball", "size")
    names = durable(io.number_by(stats.select("g", "n", "rho", "centre", "h"), "g").withColumnRenamed("g", "name").withColumnRenamed("point_id", "g"))
    top = F.lit(1.0) if plain else F.col("top")
    shaped = names if plain else names.mapInPandas(_with_top, "name string, n long, rho double, centre array<double>, h array<double>, g long, top double")
    rows = durable(shaped.select("g", "rho", "centre", (F.array().cast("array<double>") if plain else F.col("h")).alias("cov"), top.alias("top")))
    m = rows.count()
    mass = names.select("g", "n")
    pairs = near = None
    if cfg.refine != "none" or cfg.counts or cfg.centres not in ("top", "separated"):
        pairs = all_pairs(rows, m)
    if cfg.refine != "none":
        near = Natural(pairs, SEARCH[cfg.refine])
        sized = rows.select("g", F.col("rho").alias("density")).join(mass, "g")
        if cfg.refine == "weighted":
            dense = natural.weighted_density(near.edges, sized, near.occurrence).withColumnRenamed("weighted", "rho")
        elif cfg.refine == "reliable":
            dense = natural.hybrid_density(sized, natural.structural_density(near.edges, sized)).withColumnRenamed("hybrid", "rho")
        if cfg.refine != "fuzzy":
            rows = durable(rows.drop("rho").join(dense, "g").select("g", "rho", "centre", "cov", "top"))
    votes = max(2, math.ceil(math.log2(max(2, m)))) if cfg.graph or cfg.labels == "strong" else 1
    if cfg.delta in ("ordered", "ball"):  # an order without ties in place of the density
        ranked = io.number_by(rows.withColumn("down", -F.col("rho")), "down", "g").select("g", (-F.col("point_id")).cast("double").alias("rho"), "centre", "cov", "top")
        links = index.nearest(ranked, votes, denser=True).links
    else:
        links = index.nearest(rows, votes, denser=True).links
    links = durable(links.join(rows.select(F.col("g").alias("j"), F.col("rho").alias("rho_j")), "j").select("i", "j", "d", "r", "rho_j"))
    dp = durable(attributes(rows, links, cfg.delta).withColumn("gamma", F.col("rho") * F.col("delta")))
    if cfg.counts and m > 1:
        label = refine.best_labels(dp, pairs, cfg.counts, cfg.margin)[1]
        return _named(names, label, dp)
    few = _centres(rows, dp, m, cfg, pairs, near)
    centres = spark.createDataFrame([(int(g), int(x)) for g, x in zip(few["g"], few["label"], strict=True)], "g long, label int")
    nearest = durable(to_few(rows, few).select("g", F.expr("array_position(d, array_min(d)) - 1").cast("int").alias("near")))
    if cfg.labels == "strong":
        label = graph.strong_graph(links, rows, centres, nearest)
    else:
        roots = lab.chains(dp.select("g", "parent"), centres).join(F.broadcast(centres.select(F.col("g").alias("root"), "label")), "root", "left")
        other = F.lit(len(few)) if cfg.labels == "noise" else F.col("near")
        label = durable(roots.join(nearest, "g").select("g", F.coalesce("label", other).cast("int").alias("label")))
    if cfg.graph:
        new = durable(lab.graph_vote(dp, links.select("i", "j", "d"), label, centres, cfg.margin))
        label = new if lab.safe(label, new).first()["accepted"] else label
    if near is not None and m > 1:
        label = refined(cfg.refine, near, dp, label, centres, pairs, mass)
    return _named(names, label, dp)


def _named(names: DataFrame, label: DataFrame, dp: DataFrame) -> DataFrame:
    return names.select("g", "name").join(label, "g").join(dp, "g").select(F.col("name").alias("g"), F.col("label").cast("int").alias("label"), "delta", "gamma")


def _centres(rows: DataFrame, dp: DataFrame, m: int, cfg, pairs: DataFrame | None, near: Natural | None) -> pd.DataFrame:
    """label, g, centre, cov of the centres by the Config's rule."""
    k = max(1, min(cfg.k, m))
    if cfg.centres in ("top", "separated") or m < 2:
        least = 0.0
        if cfg.centres == "separated":
            low, mid = quantiles(rows, m, (0.25, 0.5), pairs)
            least = max(low, cfg.tau * mid, 1e-12)
        return chosen_centres(rows, dp.select("g", F.col("gamma").alias("score")), k, least)
    if cfg.centres == "scored":
        found = candidates.scored(dp, pairs)[1]
    elif cfg.centres == "basin":
        found = dpc.basin_separated(dp, pairs, near.edges, k, cfg.tau)
    else:
        by = dp.join(near.occurrence, "g").withColumn("gamma", score.centre_score(F.col("rho"), F.col("delta"), F.col("occurrence")))
        found = dpc.locally_separated(by, pairs, natural.radii(near.edges), k)
    return found.join(rows.select("g", "centre", "cov"), "g").orderBy("label").toPandas()[["label", "g", "centre", "cov"]]


def _with_top(batches):
    """Adds the largest eigenvalue of h."""
    for pdf in batches:
        n = [math.isqrt(len(h)) for h in pdf["h"]]
        yield pdf.assign(top=[float(np.linalg.eigvalsh(np.asarray(h).reshape(k, k))[-1]) for h, k in zip(pdf["h"], n, strict=True)])
