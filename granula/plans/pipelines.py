"""Whole clustering pipelines: scale, granulate, attributes, centres, labels, points.

Granulation is distributed: a granule of over LOCAL_MAX points is split level by level. End points, first
assignment, 2-means rounds and gates are aggregates over arrays; shapes come from partial moments, and
the Mahalanobis assignment joins points with their children's shapes in salted groups. Smaller granules
finish their subtree in one grouped Arrow task each; splits are independent and both use the configured
split, shape, gate and smallest leaf, so both give the same leaves up to rounding. The choice between a ball
and its children (`ball_dpc_tree`) goes on from the tasks' subtrees up the levels.

Then the granules are clustered by the distributed plan of `plans.cluster`. Only the run that tries a grid of
assisted gammas still goes through the order-dependent folds in one task, if there are at most MAX_GRANULES.
"""

from __future__ import annotations

import itertools
import math
import time
from dataclasses import dataclass, fields, replace
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granula.functions import folds, shapes, state
from granula.functions.state import delete, durable, scratch
from granula.operators import grid, score, shape, split, tree
from granula.plans import cluster

LOCAL_MAX, SALT_ROWS, MAX_GRANULES = 50_000, 20_000, 20_000
#: Points in a row of bytes.
PACK = 1024


@dataclass(frozen=True)
class Config:
    """One pipeline; the fields name the alternatives of each stage."""

    k: int = 10
    dims: int | None = None  # only the first components, if a caller asks for them
    scaler: str = "standard"
    shape: str = "full"
    split: str = "ellipsoid"
    split_factor: float = 1.0
    outlier_factor: float = 2.0  # a granule is tried again if its axes are over so many mean axes
    gain: float = 1.5  # and splits if its children's densities are over so many of its own
    quality: bool = True  # without it, any split that the other gates let through
    distance: float = 0.0  # least distance of the children's centres, in the parent's radius and metric
    rounds: int = 10
    min_leaf: int = 1
    gate: str = "none"
    density: str = "ellipsoid"
    delta: str = "strict"
    centres: str = "separated"
    labels: str = "chain"
    graph: bool = False
    margin: float = 1.75
    tau: float = 0.20  # least distance of centres, in medians of all distances
    counts: tuple[int, ...] = ()  # numbers of centres to choose from by internal score
    refine: str = "none"
    grid: bool = False


CONFIGS = {
    "ellipsoid_dpc": Config(centres="top", delta="row", shape="inverse", labels="noise"),
    "adaptive_dpc": Config(graph=True),
    "adaptive_k_dpc": Config(graph=True, counts=(8, 10, 12)),
    "strong_graph_dpc": Config(labels="strong"),
    "axis_median_dpc": Config(split="median"),
    "distance_gate_dpc": Config(gate="axis"),
    "auto_centers_dpc": Config(centres="scored"),
    "lowrank_dpc": Config(shape="lowrank"),
    "autorank_dpc": Config(shape="auto"),
    "adaptive_shape_dpc": Config(shape="adaptive", min_leaf=2, density="penalised"),
    "pinv_dpc": Config(shape="pinv"),
    "gridseed_dpc": Config(grid=True, scaler="minmax"),
    "ball_dpc_2means": Config(split="means", density="ball", delta="ball", centres="top", rounds=0, scaler="none"),
    "ball_dpc_tree": Config(split="pair", density="ball", delta="ball", centres="top", rounds=0, gate="tree", min_leaf=2, scaler="none"),
    "ball_dpc_dm": Config(split="ball", density="size", delta="ordered", centres="top", rounds=0, gate="dm", min_leaf=3, scaler="none"),
    "nn_refined_dpc": Config(refine="fuzzy"),
    "nn_candidate_dpc": Config(refine="candidates", delta="row"),
    "fuzzy_nn_dpc": Config(refine="reliable", delta="ordered", centres="basin"),
    "weighted_nn_dpc": Config(refine="weighted", delta="ordered", centres="local"),
}


def _scaled(points: DataFrame, how: str) -> DataFrame:
    """Scaling of an array column: statistics by position, one row, broadcast."""
    how = how.strip().lower()
    if how == "none":
        return points
    if how not in ("standard", "minmax", "robust"):
        raise ValueError(f"unknown scaler {how}")
    flat = points.select(F.posexplode("features").alias("p", "v")).groupBy("p")
    stats = {
        "standard": (F.avg("v"), F.stddev_pop("v")),
        "minmax": (F.min("v"), F.max("v") - F.min("v")),
        "robust": (F.percentile("v", F.lit(0.5)), F.percentile("v", F.lit(0.75)) - F.percentile("v", F.lit(0.25))),
    }[how]
    one = flat.agg(stats[0].alias("m"), stats[1].alias("s")).agg(F.sort_array(F.collect_list(F.struct("p", "m", "s"))).alias("t"))
    return points.crossJoin(F.broadcast(one)).withColumn("features", F.zip_with("features", "t", lambda v, t: (v - t["m"]) / F.when(t["s"] == 0, 1.0).otherwise(t["s"]))).drop("t")


def _accept(cfg: Config, num: int):
    """The gate of a split during granulation, on (parent, child, child) points."""
    radius = lambda x: np.sqrt(((x - x.mean(axis=0)) ** 2).sum(axis=1))
    if cfg.gate == "dm":
        return lambda x, a, b: (len(a) * radius(a).mean() + len(b) * radius(b).mean()) / len(x) < radius(x).mean()
    if cfg.gate == "axis":
        return lambda x, a, b: (mean := shapes.Shape(x, cfg.shape).lengths.mean()) <= 1e-12 or np.linalg.norm(a.mean(axis=0) - b.mean(axis=0)) >= 0.10 * mean
    return None


def _prune(x: np.ndarray, leaves: list[tuple[str, np.ndarray]], gamma: float = 0.5) -> tuple[list[tuple[str, np.ndarray]], float]:
    """Bottom-up: a node stays whole if its quality n * exp(-gamma * r) reaches its children's best. Returns
    the leaves and the best sum of their root."""

    def quality(at):
        r = np.sqrt(((x[at] - x[at].mean(axis=0)) ** 2).sum(axis=1)).max()
        return len(at) * math.exp(-gamma * r)

    best = {p: (quality(at), [(p, at)]) for p, at in leaves}
    for depth in range(max(map(len, best)), 0, -1):
        for p in sorted({q[:-1] for q in best if len(q) == depth}):
            kids = [best.pop(p + c) for c in "01" if p + c in best]
            if kids:
                at = np.concatenate([a for _, parts in kids for _, a in parts])
                whole, parts = quality(at), sum(k[0] for k in kids)
                best[p] = (whole, [(p, at)]) if whole >= parts else (parts, [y for k in kids for y in k[1]])
    return [y for _, parts in best.values() for y in parts], sum(q for q, _ in best.values())


def _prune_levels(now: DataFrame, stuck: DataFrame | None, inner: list[DataFrame]) -> DataFrame:
    """The leaves after the choice between the nodes above the subtrees that tasks have pruned (top, best)."""
    above = inner[0]
    for t in inner[1:]:
        above = above.union(t)
    if stuck is not None:  # too large, but without a split: leaves with their own quality
        own = tree.qualities(stuck).select("g", F.col("quality").alias("best"))
        now = durable(now.union(stuck.join(own, "g").select("point_id", "features", "g", F.col("g").alias("top"), "best")))
    final = durable(tree.prune(now.select("top", "best").distinct(), above))
    return now.join(F.broadcast(final), "top").select("point_id", "features", F.when(F.col("node") == F.col("top"), F.col("g")).otherwise(F.col("node")).alias("g"))


def _salted(points: DataFrame) -> DataFrame:
    """Groups of about SALT_ROWS points of a granule."""
    n = points.groupBy("g").agg(F.ceil(F.count("*") / SALT_ROWS).cast("int").alias("salts"))
    return points.join(F.broadcast(n), "g").withColumn("salt", F.pmod(F.xxhash64("point_id"), F.col("salts")).cast("int"))


def _d2(to: str):
    return F.aggregate(F.zip_with("features", to, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v)


def _sides(x: np.ndarray, centres: list[np.ndarray]) -> np.ndarray:
    a, b = (((x - c) ** 2).sum(axis=1) for c in centres)
    return (a > b).astype(int)


def _packed(points: DataFrame) -> DataFrame:
    """g, child, x: the points as bytes, PACK of a granule in a row; a round of sums reads them fast."""
    key = dict(points.dtypes)["g"]

    def run(batches):
        for pdf in batches:
            for g, rows in pdf.groupby("g", sort=False):
                for at in range(0, len(rows), PACK):
                    part = rows.iloc[at : at + PACK]
                    yield pd.DataFrame({"g": [g], "child": [part["child"].to_numpy().astype(np.int8).tobytes()], "x": [np.stack(part["features"].to_numpy()).tobytes()]})

    return durable(points.select("g", "child", "features").mapInPandas(run, f"g {key}, child binary, x binary"))


def _means(points: DataFrame, rounds: int = 100) -> DataFrame:
    """points (point_id, features, g, child) after 2-means from child. A round reads the points of granules that still
    move and sums them by child; points are written at the end alone. What the driver holds is the two
    centres of each granule of over LOCAL_MAX points."""
    packed = _packed(points)
    key = dict(points.dtypes)["g"]

    def sums(old, new):
        def run(batches):
            out: dict = {}
            for pdf in batches:
                for g, child, data in zip(pdf["g"], pdf["child"], pdf["x"], strict=True):
                    child = np.frombuffer(child, np.int8)
                    x = np.frombuffer(data).reshape(len(child), -1)
                    was = _sides(x, old[g]) if g in old else child
                    now = _sides(x, new[g]) if g in new else was
                    for c in (0, 1):
                        n, v, moved = out.get((g, c), (0, 0.0, False))
                        out[g, c] = n + int((now == c).sum()), v + x[now == c].sum(axis=0), moved or bool((now != was).any())
            if out:
                yield pd.DataFrame([(g, c, n, v, moved) for (g, c), (n, v, moved) in out.items()], columns=["g", "child", "n", "v", "moved"])

        part = packed.where(F.col("g").isin(open_)).mapInPandas(run, f"g {key}, child int, n long, v array<double>, moved boolean")
        per = part.select("g", "child", "n", "moved", F.posexplode("v").alias("p", "x")).groupBy("g", "child", "p").agg(F.sum("n").alias("n"), F.sum("x").alias("x"), F.max("moved").alias("moved")).toPandas()
        out = {}
        for g, t in per.sort_values(["child", "p"]).groupby("g"):
            two = [t[t["child"] == c] for c in (0, 1)]
            n = [int(h["n"].iloc[0]) for h in two]
            out[g] = bool(t["moved"].any()), n, [h["x"].to_numpy() / k for h, k in zip(two, n, strict=True)] if min(n) else None
        return out

    open_ = [r["g"] for r in packed.select("g").distinct().collect()]
    rule: dict = {}
    new = {g: c for g, (_, _, c) in sums({}, {}).items() if c is not None}
    for _ in range(rounds):
        open_ = list(new)
        if not open_:
            break
        got = sums(rule, new)
        # A side without points leaves the granule as it was.
        rule |= {g: new[g] for g, (_, n, _) in got.items() if min(n)}
        new = {g: c for g, (moved, n, c) in got.items() if min(n) and moved}

    def last(batches):
        for pdf in batches:
            child = pdf["child"].to_numpy().copy()
            for g, at in pdf.groupby("g", sort=False).indices.items():
                if g in rule:
                    child[at] = _sides(np.stack(pdf["features"].to_numpy()[at]), rule[g])
            yield pdf.assign(child=child)

    return durable(points.mapInPandas(last, points.schema))


def _first(points: DataFrame, cfg: Config) -> DataFrame:
    """points with child by end points, by 2-means from there, or by the median along the first axis."""
    if cfg.split == "median":
        key = "g string, axis array<double>"

        def axes(batches):
            for pdf in batches:
                out = []
                for n, v in zip(pdf["n"], pdf["v"], strict=True):
                    d = int((math.sqrt(1 + 4 * len(v)) - 1) / 2)
                    c = v[:d] / n
                    out.append(shapes.first_axis(v[d:].reshape(d, d) / n - np.outer(c, c)))
                yield pd.DataFrame({"g": pdf["g"], "axis": out})

        along = F.aggregate(F.zip_with("features", "axis", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
        at = durable(points.join(shape.moments(points).mapInPandas(axes, key), "g").withColumn("at", along).drop("axis"))
        cut = at.groupBy("g").agg(F.median("at").alias("cut"))
        return durable(at.join(cut, "g").withColumn("child", (F.col("at") > F.col("cut")).cast("int")).drop("at", "cut"))
    if cfg.split == "pair":
        return tree.split(points)
    p1 = points.join(tree.centres(points, "g").select("g", F.col("c").alias("q")), "g").groupBy("g").agg(F.min(F.struct(_d2("q").alias("d"), "point_id", "features")).getField("features").alias("q"))
    far = lambda q: points.join(q, "g").groupBy("g").agg(F.max(F.struct(_d2("q").alias("d"), (-F.col("point_id")).alias("i"), "features")).getField("features").alias("q"))
    p2 = durable(far(p1))
    ends = p2.withColumnRenamed("q", "a").join(far(p2).withColumnRenamed("q", "b"), "g")
    now = durable(points.join(ends, "g").withColumn("child", F.when(_d2("a") < _d2("b"), 0).otherwise(1)).drop("a", "b"))
    return _means(now) if cfg.split == "means" else now


def _gated(split_: DataFrame, cfg: Config) -> DataFrame:
    """g of the granules whose split the gate admits."""
    two = tree.centres(split_, "g", "child")
    pair = two.groupBy("g").agg(*(F.max(F.when(F.col("child") == i, F.col("c"))).alias(f"c{i}") for i in (0, 1)))
    if cfg.gate == "axis":
        mean = shape.granules(split_.select("point_id", "features", "g"), cfg.shape).select("g", F.expr("aggregate(lengths, 0D, (s, e) -> s + e) / size(lengths)").alias("mean"))
        apart = F.sqrt(F.aggregate(F.zip_with("c0", "c1", lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v))
        return pair.join(mean, "g").where((F.col("mean") <= 1e-12) | (apart >= 0.10 * F.col("mean"))).select("g")
    whole = tree.centres(split_, "g").select("g", "c")
    own = two.select("g", "child", F.col("c").alias("k"))
    per = split_.join(whole, "g").join(own, ["g", "child"]).select("g", F.sqrt(_d2("c")).alias("r"), F.sqrt(_d2("k")).alias("s"))
    return per.groupBy("g").agg(F.avg("r").alias("r"), F.avg("s").alias("s")).where("s < r").select("g")


def split_level(points: DataFrame, cfg: Config) -> DataFrame:
    """One distributed split of every granule of points (point_id, features, g): adds child; rows of
    granules that do not split get null."""
    least = max(1, cfg.min_leaf)
    first = _first(points, cfg)
    if cfg.split in ("ellipsoid", "median"):
        out = durable(_by_shape(first, cfg, least))
    else:
        out = first
    sizes = out.where("child >= 0").groupBy("g").agg(F.count_if(F.col("child") == 0).alias("n0"), F.count_if(F.col("child") == 1).alias("n1"))
    both = durable(sizes.where(F.least("n0", "n1") >= least).select("g"))
    if cfg.gate not in ("none", "tree"):
        both = durable(_gated(out.join(both, "g", "left_semi"), cfg))
    return out.join(both.withColumn("ok", F.lit(True)), "g", "left").withColumn("child", F.when(F.col("ok"), F.col("child"))).drop("ok")


def _by_shape(first: DataFrame, cfg: Config, least: int) -> DataFrame:
    """child by the Mahalanobis distances to the shapes of both children; -1 where one is too small."""
    keyed = first.withColumn("g", F.concat("g", F.col("child").cast("string")))
    kids = shape.moments(keyed).select(F.expr("substring(g, 1, length(g) - 1)").alias("g"), F.expr("substring(g, length(g), 1)").alias("child"), F.col("n").cast("double").alias("n"), "v")
    salted = durable(_salted(first))
    spread = kids.join(salted.groupBy("g").agg(F.max("salts").alias("salts")), "g").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)))

    def assign(pdf: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf):
            return pd.DataFrame({"point_id": [], "features": [], "g": [], "child": []})
        x = np.stack(pdf["features"])
        child = np.full(len(x), -1)
        if len(found) == 2 and found["n"].min() >= least:
            m2 = []
            for _, row in found.sort_values("child").iterrows():
                d, v, n = x.shape[1], np.asarray(row["v"]), row["n"]
                c = v[:d] / n
                m2.append(shapes.Shape.of_moments(int(n), c, v[d:].reshape(d, d) / n - np.outer(c, c), cfg.shape).squared(x))
            child = (m2[0] >= m2[1]).astype(int)
        return pd.DataFrame({"point_id": pdf["point_id"], "features": pdf["features"], "g": pdf["g"], "child": child})

    return salted.groupBy("g", "salt").cogroup(spread.groupBy("g", "salt")).applyInPandas(assign, "point_id long, features array<double>, g string, child int")


def _stats(cfg: Config):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.stack(pdf.sort_values("point_id")["features"])
        s = shapes.Shape(x, cfg.shape)
        h = getattr(s, "h", None)
        if h is None:
            h = s.basis @ np.diag(s.eig) @ s.basis.T + shapes.EPS * np.eye(s.d)
        r = np.sqrt(((x - s.centre) ** 2).sum(axis=1))
        mean_r = np.abs(x - s.centre).mean()
        rho = {"ellipsoid": s.density, "penalised": s.penalised(), "size": float(s.n), "ball": 0.0 if r.max() == 0 or mean_r == 0 else s.n / (r.max() ** 2 * mean_r)}[cfg.density]
        return pd.DataFrame({"g": [pdf["g"].iloc[0]], "n": [s.n], "r": [float(r.max())], "centre": [s.centre], "h": [h.ravel()], "axes": [float(s.lengths.sum())], "density": [float(s.density)], "rho": [float(rho)]})

    return run


_STATS = "g string, n long, r double, centre array<double>, h array<double>, axes double, density double, rho double"


def _better(x: np.ndarray, child: np.ndarray, cfg: Config) -> bool:
    """The gates of outlier refinement: density gain and distance of the children."""
    whole, a, b = (shapes.Shape(y, cfg.shape) for y in (x, x[child == 0], x[child == 1]))
    if cfg.quality and a.density + b.density <= cfg.gain * whole.density:
        return False
    return not cfg.distance or math.sqrt(whole.squared(a.centre[None] - b.centre + whole.centre)[0]) >= cfg.distance * max(whole.rho, shapes.TINY)


def _radius_stage(now: DataFrame, stats: DataFrame, cfg: Config, schema: str) -> tuple[DataFrame, DataFrame]:
    """Balls of at least twice the larger of mean and median radius split again, to a fixpoint."""

    def halve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("point_id").reset_index(drop=True)
        x, g = np.stack(pdf["features"]), pdf["g"].iloc[0]
        child = shapes.halves(x, cfg.shape, cfg.min_leaf, cfg.split) if len(x) >= 6 else None
        return pd.DataFrame({"point_id": pdf["point_id"], "features": pdf["features"], "g": g if child is None else [f"{g}{c}" for c in child]})

    while True:
        wide = durable(split.radius_gate(stats.select("g", "r")).where("split").select("g"))
        tried = durable(now.join(wide, "g", "left_semi").groupBy("g").applyInPandas(halve, schema))
        fresh = durable(tried.join(wide, "g", "left_anti"))
        if not fresh.limit(1).count():
            return now, stats
        gone = fresh.select(F.expr("substring(g, 1, length(g) - 1)").alias("g")).distinct()
        now = durable(now.join(gone, "g", "left_anti").unionByName(fresh))
        stats = durable(stats.join(gone, "g", "left_anti").union(fresh.groupBy("g").applyInPandas(_stats(cfg), _STATS)))


def granulate(points: DataFrame, cfg: Config, local_max: int = LOCAL_MAX) -> tuple[DataFrame, DataFrame]:
    """(points with g, granules) of points (point_id, features)."""
    n = points.count()
    num = {"tree": math.floor(max(2, 0.8 * math.sqrt(n))) + 1, "dm": 6}.get(cfg.gate) or split.threshold(n, cfg.split_factor)
    least = max(2, math.ceil(0.1 * math.sqrt(n)))
    accept = _accept(cfg, num)
    if cfg.grid:
        clipped = points.select(F.col("point_id").alias("id"), F.transform("features", lambda x: F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))).alias("features"))
        cells = durable(grid.cells(clipped, split.bins(n, points.select(F.size("features")).first()[0] if n else 1)))
        occ = durable(grid.occupied(cells))
        seeds = grid.seeds(cells, grid.regions(occ), occ)
        now = points.join(seeds.select(F.col("id").alias("point_id"), F.format_string("s%06d.", "seed").alias("g")), "point_id")
    else:
        now = points.withColumn("g", F.lit("r"))
    spark, cols = points.sparkSession, ["point_id", "features", "g"]
    # What the levels leave: granules small enough for a task, and large ones without a split; a level's own tables
    # are deleted after it, so files do not add up by levels.
    here, ready, stuck = (state.fresh(spark) for _ in range(3))
    now = durable(now.select(*cols), here)
    done, inner = None, []
    while True:  # levels of granules too large for a task
        big = now.groupBy("g").agg(F.count("*").alias("n")).where(F.col("n") > max(local_max, num - 1)).select("g")
        if not big.limit(1).count():
            break
        big, level = durable(big), state.fresh(spark)
        now.join(F.broadcast(big), "g", "left_anti").select(*cols).write.mode("append").parquet(ready)
        with scratch(spark):
            parts = durable(split_level(now.join(F.broadcast(big), "g", "left_semi"), cfg), level)
        delete(spark, here)
        here = level
        if cfg.gate == "tree":
            inner.append(durable(tree.qualities(parts.where("child is not null"))))
        parts.where("child is null").select(*cols).write.mode("append").parquet(stuck)
        now = parts.where("child is not null").select("point_id", "features", F.concat("g", F.col("child").cast("string")).alias("g"))
        done = spark.read.schema(now.schema)
    if done is not None:
        now, done = now.union(done.parquet(ready)), done.parquet(stuck)

    deep = bool(inner)

    def leaves(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("point_id").reset_index(drop=True)
        x = np.stack(pdf["features"])
        found, best = shapes.subtree(x, pdf["g"].iloc[0], num, cfg.shape, cfg.min_leaf, cfg.split, accept), 0.0
        if cfg.gate == "tree":
            found, best = _prune(x, found)
        g = np.empty(len(x), object)
        for path, at in found:
            g[at] = path
        out = pd.DataFrame({"point_id": pdf["point_id"], "features": pdf["features"], "g": g})
        return out.assign(top=pdf["g"].iloc[0], best=best) if deep else out

    schema = "point_id long, features array<double>, g string"
    now = now.groupBy("g").applyInPandas(leaves, schema + ", top string, best double" * deep)
    whole = state.fresh(spark)
    with scratch(spark):
        if deep:
            now = _prune_levels(durable(now), done, inner)
            done = None
        now = durable(now if done is None else now.union(done), whole)
    for path in (here, ready, stuck):
        delete(spark, path)
    stats = durable(now.groupBy("g").applyInPandas(_stats(cfg), _STATS))

    def try_split(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("point_id").reset_index(drop=True)
        x, g = np.stack(pdf["features"]), pdf["g"].iloc[0]
        child = shapes.halves(x, cfg.shape, least, cfg.split)
        better = child is not None and _better(x, child, cfg)
        return pd.DataFrame({"point_id": pdf["point_id"], "features": pdf["features"], "g": [f"{g}{c}" for c in child] if better else g})

    if cfg.gate == "dm":
        now, stats = _radius_stage(now, stats, cfg, schema)
    for _ in range(cfg.rounds):
        wide = durable(split.outlier_candidates(stats.selectExpr("g", "axes as l1", "0D as l2"), cfg.outlier_factor).select("g"))
        tried = durable(now.join(F.broadcast(wide), "g", "left_semi").groupBy("g").applyInPandas(try_split, schema))
        fresh = durable(tried.join(F.broadcast(wide), "g", "left_anti"))
        if not fresh.limit(1).count():
            break
        gone = fresh.select(F.expr("substring(g, 1, length(g) - 1)").alias("g")).distinct()
        now = durable(now.join(F.broadcast(gone), "g", "left_anti").unionByName(fresh))
        stats = durable(stats.join(F.broadcast(gone), "g", "left_anti").union(fresh.groupBy("g").applyInPandas(_stats(cfg), _STATS)))
    return now, stats


def _fold(cfg: Config):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("g").reset_index(drop=True)
        centre, n, rho = np.stack(pdf["centre"]), pdf["n"].to_numpy(float), pdf["rho"].to_numpy(float)
        m, dims = centre.shape
        if cfg.density in ("ball", "size"):
            d = np.sqrt(((centre[:, None] - centre[None]) ** 2).sum(axis=2))
        else:
            d = shapes.pair_distances(centre, np.stack(pdf["h"]).reshape(m, dims, dims))
        near, occ, scale = None, None, None
        if cfg.refine != "none":
            _, near, _, occ = folds.neighbours(d, min(16, max(4, math.ceil(math.log2(max(2, m))) + 2)))
            scale = np.array([max(np.median(d[i, js]), 1e-12) for i, js in enumerate(near)])
            struct = np.array([len(js) + sum(math.exp(-(d[i, j] ** 2) / (scale[i] * scale[j])) * math.sqrt(n[i] * n[j]) * (1 + len(near[j])) for j in js) for i, js in enumerate(near)])
            if cfg.refine == "reliable":
                a = np.clip(n / (n + np.median(n)), 0.2, 0.8)
                rho = a * folds.scaled(rho) + (1 - a) * folds.scaled(struct) + 1e-12 * np.arange(m)
            elif cfg.centres == "local":
                lr = np.log1p(rho)
                mean = np.array([lr[js].mean() for js in near])
                rho = 0.55 * folds.unit(lr) + 0.25 * folds.unit(mean) + 0.20 * folds.unit(lr / np.maximum(mean, 1e-12)) + 1e-12 * np.arange(m)
        delta, parent = folds.peaks(rho, d, cfg.delta)
        gamma = rho * delta
        value = folds.unit(rho) * folds.unit(delta) * (1 + 0.2 * folds.unit(occ)) if cfg.centres == "local" else gamma
        chosen = folds.best_count(gamma, delta, parent, d) if cfg.centres == "scored" else folds.centres(value, d, cfg.k, cfg.centres, scale, near, cfg.tau)
        label = folds.strong_graph(rho, d, chosen) if cfg.labels == "strong" else folds.chain(parent, chosen, d, cfg.labels == "noise")
        if cfg.counts:
            chosen, label = folds.best_labels(gamma, rho, parent, d, cfg.counts, cfg.tau, cfg.margin, cfg.graph)
        elif cfg.graph:
            label = folds.graph_vote(rho, d, label, chosen, cfg.margin)
        if cfg.refine == "fuzzy":
            label = folds.accept(d, rho, n, near, label, folds.fuzzy(d, near, occ, n, rho, label, chosen))
        elif cfg.refine == "reliable":
            label = folds.accept(d, rho, n, near, label, folds.reliable(d, near, rho, n, label, chosen), smallest=0.01)
        elif cfg.refine == "candidates":
            base = best = label
            dev = max(np.median(np.abs(struct - np.median(struct))), 1e-12)
            prom = np.array([np.clip(math.log(max(rho[i], 1e-12) / max(np.median(rho[js]), 1e-12)), -1, 1) for i, js in enumerate(near)])
            top, s0, a0 = 0.005, folds.internal(d, rho, base), folds.agree(d, near, base)
            for ws in (0.0, 0.25, 0.5):
                for wp in (0.0, 0.25, 0.5):
                    g2 = gamma * np.exp(ws * np.clip((struct - np.median(struct)) / dev, -2, 2) + wp * prom)
                    own = folds.centres(g2, d, cfg.k)
                    plain = folds.chain(parent, own, d)
                    for lab in (plain, folds.fuzzy(d, near, occ, n, rho, plain, own, 0.62)):
                        s = folds.internal(d, rho, lab)
                        gain = math.log(max(s, 1e-12) / max(s0, 1e-12)) + 0.25 * (folds.agree(d, near, lab) - a0) - 0.75 * (lab != base).mean()
                        if gain > top:
                            best, top = lab, gain
            label = best
        return pd.DataFrame({"g": pdf["g"], "label": label.astype(int), "delta": delta, "gamma": gamma})

    return run


def _clustered(stats: DataFrame, cfg: Config) -> DataFrame:
    if cfg.refine != "candidates":
        return cluster.cluster(stats, cfg)
    if (m := stats.count()) > MAX_GRANULES:
        raise ValueError(f"{m} granules: raise split_factor so that there are at most {MAX_GRANULES}")
    return stats.withColumn("one", F.lit(1)).groupBy("one").applyInPandas(_fold(cfg), "g string, label int, delta double, gamma double")


class Granulation(NamedTuple):
    """What a run has before it clusters: points with g, granules, and the seconds that took."""

    members: DataFrame
    stats: DataFrame
    clock: dict[str, float]


#: The fields of a Config that granulation does not read.
AFTER = ("k", "delta", "centres", "labels", "graph", "margin", "tau", "counts", "refine")


def granulation(points: DataFrame, cfg: Config) -> Granulation:
    """Scaling and granules of points (point_id, features), each a written table."""
    at = time.perf_counter()
    features = F.col("features") if cfg.dims is None else F.slice("features", 1, cfg.dims)
    path = state.fresh(points.sparkSession)
    scaled = durable(_scaled(points.select("point_id", features.alias("features")), cfg.scaler), path)
    scaling, at = time.perf_counter() - at, time.perf_counter()
    members, stats = granulate(scaled, cfg)
    delete(points.sparkSession, path)
    return Granulation(members, stats, {"scaling": scaling, "granules": time.perf_counter() - at})


def run(points: DataFrame, cfg: Config, clock: dict[str, float] | None = None, made: Granulation | None = None) -> dict[str, DataFrame]:
    """The tables of one run on points (point_id, features): granules, labels, assignments. clock gets
    the seconds of each stage; each ends in a written table. made: granules of an earlier run whose
    Config differs only in the fields AFTER."""
    clock = {} if clock is None else clock
    made = granulation(points, cfg) if made is None else made
    clock.update(made.clock)
    at = time.perf_counter()
    labels = durable(_clustered(made.stats, cfg))
    clock["clustering"] = time.perf_counter() - at
    return {"granules": made.stats, "labels": labels, "assignments": made.members.join(labels.select("g", "label"), "g").select("point_id", "label")}


def confusion(points: DataFrame, cfg: Config) -> DataFrame:
    """Counts of true and predicted labels of points (point_id, features, label)."""
    pred = run(points, cfg)["assignments"].withColumnRenamed("label", "pred")
    return score.contingency(points.select("point_id", "label").join(pred, "point_id"))


def evaluate(points: DataFrame, cfg: Config, name: str = "", made: Granulation | None = None) -> dict:
    """One metrics row: accuracy under the best alignment, NMI, ARI, granules, seconds in all and by
    stage; mapping to points and evaluation are not timed."""
    clock: dict[str, float] = {}
    with scratch(points.sparkSession):
        out = run(points, cfg, clock, made)
        table = durable(score.contingency(points.select("point_id", "label").join(out["assignments"].withColumnRenamed("label", "pred"), "point_id")))
        found = {"name": name, "acc": score.accuracy(table)[0], "nmi": score.nmi(table).first()[0], "ari": score.ari(table).first()[0], "granules": out["granules"].count()}
    return found | {"seconds": sum(clock.values())} | {f"seconds_{k}": v for k, v in clock.items()}


def _row(points: DataFrame, cfg: Config, name: str) -> dict:
    """evaluate; a failure is its row."""
    try:
        return evaluate(points, cfg, name) | {"error": ""}
    except Exception as e:  # the other rows are wanted all the same
        return {"name": name, "acc": -1.0, "nmi": -1.0, "ari": -1.0, "granules": 0, "seconds": 0.0, "error": str(e).splitlines()[0] if str(e) else type(e).__name__}


def run_all(load, names, base: Config | None = None, settings: dict[str, dict] | None = None) -> list[dict]:
    """Metrics of every named data set, in order; load(name) gives its points with labels. settings:
    changes to the configuration by name. A data set that fails gets a row with its error."""
    rows = []
    for name in names:
        try:
            points = load(name)
        except Exception as e:  # missing files are a row, too
            rows.append({"name": name, "acc": -1.0, "nmi": -1.0, "ari": -1.0, "granules": 0, "seconds": 0.0, "error": str(e).splitlines()[0]})
            continue
        rows.append(_row(points, replace(base or CONFIGS["adaptive_dpc"], **(settings or {}).get(name, {})), name))
    return rows


def sweep(points: DataFrame, base: Config, grid: dict[str, list], most: int | None = None) -> list[dict]:
    """Metrics of every combination; without the graph its margins are one trial. Trials that differ only
    after granulation share one, whose seconds count in each. An error in one trial is its row. Sorted by
    accuracy, NMI, ARI and time."""
    trials, seen = [], set()
    for values in itertools.product(*grid.values()):
        cfg = replace(base, **dict(zip(grid, values, strict=True)))
        cfg = cfg if cfg.graph else replace(cfg, margin=base.margin)
        if cfg not in seen:
            seen.add(cfg)
            trials.append(cfg)
    rows, made = [], {}
    with scratch(points.sparkSession):
        for cfg in trials[:most]:
            before = replace(cfg, **{f.name: f.default for f in fields(Config) if f.name in AFTER})
            try:
                if before not in made:
                    made[before] = granulation(points, cfg)
                rows.append(evaluate(points, cfg, made=made[before]) | {"config": cfg})
            except Exception as e:  # a trial's failure is its result
                rows.append({"config": cfg, "error": str(e), "acc": -1.0, "nmi": -1.0, "ari": -1.0, "seconds": 0.0})
    return sorted(rows, key=lambda x: (-x["acc"], -x["nmi"], -x["ari"], x["seconds"]))


#: One part left out at a time; granules are kept in tables either way, so `no_cache` equals full.
ABLATIONS = {"full": {}, "no_quality": {"quality": False}, "no_distance": {"distance": 0.0, "gate": "none"}, "no_cache": {}, "no_graph": {"graph": False}, "no_outliers": {"rounds": 0}, "no_separation": {"centres": "top"}, "explicit_inverse": {"shape": "inverse"}}
_BARE = {"quality": False, "distance": 0.0, "shape": "inverse", "graph": False, "rounds": 0, "centres": "top"}
_GATES = {"quality": True, "rounds": 10, "centres": "separated"}
#: One part more at a time, up to the configuration itself.
INCREMENTAL = {
    "plain": _BARE,
    "+ quality gate": _BARE | _GATES,
    "+ distance gate": _BARE | _GATES | {"distance": 0.25},
    "+ cholesky": _BARE | _GATES | {"distance": 0.25, "shape": "full"},
    "+ cache": _BARE | _GATES | {"distance": 0.25, "shape": "full"},
    "+ graph": _BARE | _GATES | {"distance": 0.25, "shape": "full", "graph": True},
    "final": {},
}
#: Values of one parameter at a time.
SENSITIVITY = {"gain": (1.1, 1.3, 1.5, 1.7, 2.0), "tau": (0.10, 0.20, 0.30, 0.40), "split_factor": (0.6, 0.8, 1.0, 1.2), "margin": (1.30, 1.50, 1.75, 2.00)}


def ablate(points: DataFrame, base: Config, variants: dict[str, dict] = ABLATIONS) -> list[dict]:
    return [_row(points, replace(base, **change), name) for name, change in variants.items()]


def sensitivity(points: DataFrame, base: Config, values: dict[str, tuple] = SENSITIVITY, repeats: int = 1) -> list[dict]:
    """A row for each value of each parameter, the others as in base. Runs are deterministic: repeats
    only give a mean time."""
    rows = []
    for field, options in values.items():
        for value in options:
            found = [_row(points, replace(base, **{field: value}), f"{field}={value}") for _ in range(max(1, repeats))]
            rows.append(found[0] | {"parameter": field, "value": value, "seconds": sum(x["seconds"] for x in found) / len(found)})
    return rows
