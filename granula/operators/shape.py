"""Granules in any dimension: moments, shapes of every kind, distances, pairs.

Points are (point_id, features, g). Moments are summed where the points are read and merged by granule,
so a granule of any size is a few rows. What needs the points again runs over salted groups of a
granule, beside its shape.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granula.functions import shapes
from granula.functions.state import durable
from granula.operators.dpc import mirror, two_sides

#: Points of one salted group.
SALT_ROWS = 20_000


def moments(points: DataFrame) -> DataFrame:
    """g, n, v: the number of points, then their sums and the sums of products of each granule."""
    key = next(k for c, k in points.dtypes if c == "g")

    def run(batches):
        sums: dict = {}
        for pdf in batches:
            for g, rows in pdf.groupby("g", sort=False)["features"]:
                x = np.stack(rows.to_numpy())
                n, v = sums.get(g, (0, 0.0))
                sums[g] = n + len(x), v + np.concatenate([x.sum(axis=0), (x.T @ x).ravel()])
            if len(sums) > 4096:  # what a task holds is bounded
                yield _partial(sums)
                sums = {}
        if sums:
            yield _partial(sums)

    part = points.select("g", "features").mapInPandas(run, f"g {key}, n long, v array<double>")
    flat = part.select("g", "n", F.posexplode("v").alias("p", "x")).groupBy("g", "p").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
    return flat.groupBy("g").agg(F.max("n").alias("n"), F.transform(F.sort_array(F.collect_list(F.struct("p", "x"))), lambda t: t["x"]).alias("v"))


def _partial(sums: dict) -> pd.DataFrame:
    return pd.DataFrame({"g": list(sums), "n": [n for n, _ in sums.values()], "v": [v for _, v in sums.values()]})


def fits(points: DataFrame, kind: str = "full", rank: int = 5, eps: float = shapes.EPS) -> DataFrame:
    """g, n, centre, precision (the matrix of the squared distance, row by row), spectrum (descending),
    basis and eig of the kept axes (low-rank kinds), tail, flat."""
    m = moments(points)
    key = next(k for c, k in points.dtypes if c == "g")

    def run(batches):
        for pdf in batches:
            rows = []
            for g, n, v in zip(pdf["g"], pdf["n"], pdf["v"], strict=True):
                d = int((np.sqrt(1 + 4 * len(v)) - 1) / 2)
                c = v[:d] / n
                s = shapes.Shape.of_moments(int(n), c, v[d:].reshape(d, d) / n - np.outer(c, c), kind, eps, rank)
                low = s.basis is not None
                rows.append((g, n, c, s.precision().ravel(), s.spectrum(), s.basis.T.ravel() if low else [], s.eig if low else [], s.tail, bool(s.flat)))
            yield pd.DataFrame(rows, columns=["g", "n", "centre", "precision", "spectrum", "basis", "eig", "tail", "flat"])

    return m.mapInPandas(run, f"g {key}, n long, centre array<double>, precision array<double>, spectrum array<double>, basis array<double>, eig array<double>, tail double, flat boolean")


def _beside(points: DataFrame, fitted: DataFrame, run, schema: str) -> DataFrame:
    """run(points, shape) on groups of about SALT_ROWS points of a granule."""
    salts = fitted.select("g", F.ceil(F.col("n") / SALT_ROWS).cast("int").alias("salts"))
    left = points.join(salts, "g").withColumn("salt", F.pmod(F.xxhash64("point_id"), F.col("salts")).cast("int")).select("g", "salt", "point_id", "features")
    right = fitted.join(salts, "g").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).select("g", "salt", "centre", "precision")

    def both(x: pd.DataFrame, s: pd.DataFrame) -> pd.DataFrame:
        if not len(x):
            return run(x, np.zeros(0))
        c = np.asarray(s["centre"].iloc[0])
        diff = np.stack(x["features"].to_numpy()) - c
        return run(x, np.maximum(((diff @ np.asarray(s["precision"].iloc[0]).reshape(len(c), len(c))) * diff).sum(axis=1), 0))

    return left.groupBy("g", "salt").cogroup(right.groupBy("g", "salt")).applyInPandas(both, schema)


def mahalanobis(points: DataFrame, fitted: DataFrame) -> DataFrame:
    """point_id, g, m2: squared distances to the own granule's centre in its shape."""
    key = next(k for c, k in points.dtypes if c == "g")
    return _beside(points, fitted, lambda x, m2: pd.DataFrame({"point_id": x["point_id"], "g": x["g"], "m2": m2}), f"point_id long, g {key}, m2 double")


def granules(points: DataFrame, kind: str = "full", rank: int = 5, small: int = 4) -> DataFrame:
    """g, n, centre, precision, rho (covering radius), lengths, density, penalised, outer."""
    fitted = durable(fits(points, kind, rank))
    key = next(k for c, k in points.dtypes if c == "g")
    part = _beside(points, fitted, lambda x, m2: pd.DataFrame({"g": x["g"].iloc[:1], "top": m2[:0] if not len(x) else [m2.max()], "ms": m2[:0] if not len(x) else [np.sqrt(m2).sum()]}), f"g {key}, top double, ms double")
    per = part.groupBy("g").agg(F.sqrt(F.max("top")).alias("rho"), F.sum("ms").alias("ms"))
    t = fitted.join(per, "g").withColumn("lengths", F.expr("transform(spectrum, e -> rho * sqrt(greatest(e, 1e-12)))"))
    t = t.withColumn("sum", F.expr("aggregate(lengths, 0D, (s, e) -> s + e)")).withColumn("density", F.expr("n * n / (greatest(sum, 1e-12) * greatest(ms, 1e-12))"))
    few = F.col("n") < small
    capped = F.when(few, F.least("density", F.greatest(F.lit(1.0), F.col("n").cast("double")))).otherwise(F.col("density"))
    t = t.withColumn("penalised", capped * F.when(F.col("flat"), 0.05).otherwise(1.0) * F.when(few, 0.2).otherwise(1.0))
    return t.select("g", "n", "centre", "precision", "rho", "lengths", "density", "penalised", F.array_max("lengths").alias("outer"))


def lowrank_pairs(fitted: DataFrame, eps: float = shapes.EPS) -> DataFrame:
    """i, j, d in the mean of two low-rank shapes eps * I + U diag(e) U', without a d by d matrix."""
    both = two_sides(fitted, ["g", "centre", "basis", "eig"])
    key = next(k for c, k in fitted.dtypes if c == "g")

    def run(batches):
        for pdf in batches:
            out = []
            for c, b, e, c2, b2, e2 in zip(*(pdf[f"{x}{h}"] for h in ("", "_h") for x in ("centre", "basis", "eig")), strict=True):
                out.append(shapes.lowrank_distance(c - c2, [(b.reshape(len(e), -1), e), (b2.reshape(len(e2), -1), e2)], eps))
            yield pdf[["g", "h"]].assign(d=out)

    return mirror(both.select("g", "h", *(f"{x}{h}" for h in ("", "_h") for x in ("centre", "basis", "eig"))).mapInPandas(run, f"g {key}, h {key}, d double"))
