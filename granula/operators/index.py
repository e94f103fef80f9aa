"""Exact nearest granules without all pairs, in any dimension.

At most MAX_PIVOTS granules, about the root of their number, are pivots; every granule belongs to the
cell of its nearest pivot. By the triangle inequality no granule of a cell is nearer to x than x's
distance to the pivot less the cell's radius. In the mean of two shapes a distance is at least the plain
one over the root of the mean of both shapes' largest eigenvalues, so the same bound, divided by that of
the cell, holds for Mahalanobis distances, which are no metric themselves.

A granule is first held against its own cell; then against the next cells in the order of their
bounds, a few, more, all, each time only those whose bound is not over the k-th best distance yet (and, if
denser ones are looked for, that have a denser granule). If the bounds leave much open, the rest is looked at
at once, in bundles of cells. So what is left out can't be among the k
nearest, ties included: equal distances go to the smaller id. Cells meet queries in groups of
BLOCK rows either side, so a cell with most granules is many tasks.

The pivots and one row for each cell are all that reaches the driver and the tasks as a whole:
MAX_PIVOTS vectors at most.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granula.functions.joins import merge
from granula.functions.state import durable

MAX_PIVOTS, BLOCK = 4096, 2000
#: Rows either side of a group where distances are in shapes; each one is a system of equations there.
SHAPED = 128
#: How many cells beyond the own one are looked at by the end of each round; then all others.
STEPS = (3, 12, 48)
#: Blocks in a bundle of cells.
BUNDLE = 4
#: Bounds are loosened by this share, for they are rounded too.
SLACK = 1e-9

_ROW = "g long, rho double, centre array<double>, cov array<double>, top double"


class Nearest(NamedTuple):
    """links: i, j, d, r (1 for the nearest); touched: pairs whose distance could have been computed."""

    links: DataFrame
    touched: int


def block(rows: DataFrame) -> int:
    """Rows of one side of a group of pairs."""
    one = rows.select(F.size("cov").alias("n")).first()
    return min(BLOCK, SHAPED) if one and one["n"] > 16 else BLOCK


def plane(g: DataFrame) -> DataFrame:
    """The index' rows of granules in the plane (g, density, cx, cy, a, b, c), in their shapes."""
    top = F.expr("(a + c) / 2 + sqrt((a - c) * (a - c) / 4 + b * b)")
    return g.select("g", F.col("density").alias("rho"), F.array("cx", "cy").alias("centre"), F.array("a", "b", "b", "c").alias("cov"), top.alias("top"))


def balls(g: DataFrame, centre: str = "centre", rho: str = "density") -> DataFrame:
    """The index' rows for plain distances."""
    return g.select(F.col("g").cast("long"), F.col(rho).cast("double").alias("rho"), F.col(centre).cast("array<double>").alias("centre"), F.array().cast("array<double>").alias("cov"), F.lit(1.0).alias("top"))


def _stack(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()) if len(column) else np.zeros((0, 0))


def _gaps(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Plain distances of all rows of x and y, from differences: as exact as one by one."""
    out = np.empty((len(x), len(y)))
    step = max(1, (1 << 18) // max(1, y.size))  # stays in a core's cache
    for a in range(0, len(x), step):
        out[a : a + step] = np.sqrt(((x[a : a + step, None, :] - y[None]) ** 2).sum(axis=2))
    return out


def _deal(pivots: np.ndarray):
    """Adds to each granule its nearest pivot's number and distance."""

    def run(batches):
        for pdf in batches:
            gap = _gaps(_stack(pdf["centre"]), pivots)
            cell = gap.argmin(axis=1)
            yield pdf.assign(cell=cell, far=gap[np.arange(len(cell)), cell])

    return run


def _meet(k: int, denser: bool):
    """The k best of a group of data for each query of a group, as (i, j, d)."""

    def run(q: pd.DataFrame, data: pd.DataFrame) -> pd.DataFrame:
        data = data.sort_values("g")  # the first of equal distances has the smallest id
        step = max(1, (1 << 22) // max(1, len(data)))
        parts = [some(q.iloc[a : a + step], data) for a in range(0, len(q), step)] if len(data) else []
        return pd.concat(parts) if parts else pd.DataFrame({"i": [], "j": [], "d": []})

    def some(q: pd.DataFrame, data: pd.DataFrame) -> pd.DataFrame:
        x, y = _stack(q["centre"]), _stack(data["centre"])
        gap = _gaps(x, y)
        qid, did = q["g"].to_numpy(), data["g"].to_numpy()
        ok = qid[:, None] != did[None]
        if denser:
            ok &= data["rho"].to_numpy()[None] > q["rho"].to_numpy()[:, None]
        d = np.where(ok, gap, np.inf)
        if len(q["cov"].iloc[0]):
            low = gap / np.sqrt((q["top"].to_numpy()[:, None] + data["top"].to_numpy()[None]) / 2)
            at = np.nonzero(ok & (low <= q["best"].to_numpy()[:, None] * (1 + SLACK)))
            d = np.full(gap.shape, np.inf)
            n = x.shape[1]
            qc, dc = _stack(q["cov"]).reshape(-1, n, n), _stack(data["cov"]).reshape(-1, n, n)
            step = max(1, (1 << 20) // (n * n))
            for a in range(0, len(at[0]), step):
                i, j = at[0][a : a + step], at[1][a : a + step]
                diff = x[i] - y[j]
                d[i, j] = np.sqrt(np.maximum((diff * np.linalg.solve((qc[i] + dc[j]) / 2, diff[:, :, None])[:, :, 0]).sum(axis=1), 0))
        order = d.argmin(axis=1)[:, None] if k == 1 else np.argsort(d, axis=1, kind="stable")[:, :k]
        row = np.repeat(np.arange(len(q)), order.shape[1])
        col = order.ravel()
        found = np.isfinite(d[row, col])
        return pd.DataFrame({"i": qid[row[found]], "j": did[col[found]], "d": d[row[found], col[found]]})

    return run


def _open(pdf: pd.DataFrame, cells: pd.DataFrame, pivots: np.ndarray, denser: bool) -> np.ndarray:
    """Bounds of each granule's other cells; infinite where the cell can hold none of its nearest."""
    number = cells["cell"].to_numpy()
    low = np.maximum(_gaps(_stack(pdf["centre"]), pivots[number]) - cells["radius"].to_numpy()[None], 0)
    low = low / np.sqrt((pdf["top"].to_numpy()[:, None] + cells["top"].to_numpy()[None]) / 2)
    ok = low <= pdf["best"].to_numpy()[:, None] * (1 + SLACK) + SLACK * low
    if denser:
        ok &= cells["dense"].to_numpy()[None] > pdf["rho"].to_numpy()[:, None]
    return np.where(ok & (pdf["cell"].to_numpy()[:, None] != number[None]), low, np.inf)


def _slices(batches, rows: int = 500):
    """Batches in parts: each row may become one for each cell."""
    for pdf in batches:
        for a in range(0, len(pdf), rows):
            yield pdf.iloc[a : a + rows]


def _asks(cells: pd.DataFrame, pivots: np.ndarray, start: int, end: int | None, denser: bool):
    """Of each granule's other cells in the order of bounds, the places start to end that are still open."""
    number = cells["cell"].to_numpy()

    def run(batches):
        for pdf in _slices(batches):
            low = _open(pdf, cells, pivots, denser)
            order = np.argsort(low, axis=1, kind="stable")[:, start:end]
            row = np.repeat(np.arange(len(pdf)), order.shape[1])
            col = order.ravel()
            go = np.isfinite(low[row, col])
            yield pdf.iloc[row[go]].drop(columns="cell").assign(cell=number[col[go]])[["g", "rho", "centre", "cov", "top", "best", "cell"]]

    return run


def _asks_rest(cells: pd.DataFrame, pivots: np.ndarray, bundle: np.ndarray, denser: bool):
    """The bundles of cells in which a granule has an open one."""
    first = np.flatnonzero(np.diff(bundle, prepend=-1))

    def run(batches):
        for pdf in _slices(batches):
            low = np.minimum.reduceat(_open(pdf, cells, pivots, denser), first, axis=1)
            row, col = np.nonzero(np.isfinite(low))
            yield pdf.iloc[row].drop(columns="cell").assign(cell=bundle[first][col])[["g", "rho", "centre", "cov", "top", "best", "cell"]]

    return run


def _share_open(now: DataFrame, cells: pd.DataFrame, pivots: np.ndarray, denser: bool) -> int:
    """Pairs of granules in cells that are still open to each other."""
    size = cells["n"].to_numpy()

    def run(batches):
        for pdf in _slices(batches, 5000):
            yield pd.DataFrame({"n": [int((np.isfinite(_open(pdf, cells, pivots, denser)) @ size).sum())]})

    return now.mapInPandas(run, "n long").agg(F.sum("n")).first()[0] or 0


def _ask(dealt: DataFrame, queries: DataFrame, k: int, denser: bool, side: int) -> DataFrame:
    """(i, j, d): the k best of the cells that queries (row, best, cell) name."""
    per = queries.groupBy("cell").agg(F.ceil(F.count("*") / side).cast("int").alias("qs"))
    spans = merge(per, dealt.groupBy("cell").agg(F.ceil(F.count("*") / side).cast("int").alias("ds")), "cell")
    spans = F.broadcast(spans)  # a row for each cell
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = queries.join(spans, "cell").withColumn("q", F.pmod(F.xxhash64("g"), F.col("qs")).cast("int")).withColumn("s", every("ds"))
    right = dealt.join(spans, "cell").withColumn("s", F.pmod(F.xxhash64("g"), F.col("ds")).cast("int")).withColumn("q", every("qs"))
    right = right.toDF(*right.columns)  # columns of its own, for both sides come from one table
    return left.groupBy("cell", "q", "s").cogroup(right.groupBy("cell", "q", "s")).applyInPandas(_meet(k, denser), "i long, j long, d double")


def _cut(found: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("i").orderBy("d", "j")
    return found.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k)


def nearest(rows: DataFrame, k: int, denser: bool = False) -> Nearest:
    """The k nearest granules of each one, or the k nearest of higher rho; fewer where there are fewer.

    rows: g, rho, centre, cov (the shape, row by row; empty for plain distances), top (its largest
    eigenvalue); see `plane` and `balls`. Equal distances go to the smaller id.
    """
    rows = durable(rows.select(F.col("g").cast("long").alias("g"), "rho", "centre", "cov", "top"))
    m = rows.count()
    none = rows.sparkSession.createDataFrame([], "i long, j long, d double, r int")
    if m < 2:
        return Nearest(none, 0)
    side = block(rows)
    size = min(MAX_PIVOTS, int(np.ceil(np.sqrt(m)))) if m > BLOCK else 1  # so few are one group anyway
    if size == 1:
        dealt = rows.select("*", F.lit(0).alias("cell"))
        links = durable(_cut(_ask(dealt, dealt.withColumn("best", F.lit(float("inf"))), k, denser, side), k))
        return Nearest(links, m * m)
    pivots = np.array([r["centre"] for r in rows.orderBy(F.xxhash64("g"), "g").limit(size).select("centre").collect()])
    dealt = durable(rows.mapInPandas(_deal(pivots), f"{_ROW}, cell int, far double"))
    cells = dealt.groupBy("cell").agg(F.max("far").alias("radius"), F.max("rho").alias("dense"), F.max("top").alias("top"), F.count("*").alias("n")).orderBy("cell").toPandas()

    far = F.lit(float("inf"))
    queries = dealt.select("g", "rho", "centre", "cov", "top", far.alias("best"), "cell")
    of_cell = rows.sparkSession.createDataFrame([(int(c), int(n)) for c, n in zip(cells["cell"], cells["n"], strict=True)], "cell int, n long")
    touched = int((cells["n"] ** 2).sum())
    links = durable(_cut(_ask(dealt, queries, k, denser, side), k))
    # Bundles of cells for what stays open: a granule goes to each bundle once, not to each cell.
    bundle = (cells["n"].cumsum().to_numpy() - 1) // (BUNDLE * side)
    starts = [*zip((0, *STEPS), STEPS, strict=False), (STEPS[-1], None)]
    while starts and starts[0][0] < len(cells) - 1:
        start, end = starts.pop(0)
        kth = links.where(F.col("r") == k).select(F.col("i").alias("g"), F.col("d").alias("best"))
        now = durable(dealt.select("g", "rho", "centre", "cov", "top", "cell").join(kth, "g", "left").withColumn("best", F.coalesce("best", far)))
        # Where bounds tell little apart, as in many dimensions, all that is open is looked at now.
        if not start or _share_open(now, cells, pivots, denser) <= m * m / 2:
            queries = durable(now.mapInPandas(_asks(cells, pivots, start, end, denser), f"{_ROW}, best double, cell int"))
            touched += queries.join(F.broadcast(of_cell), "cell").agg(F.sum("n")).first()[0] or 0
            links = durable(_cut(links.drop("r").union(_ask(dealt, queries, k, denser, side)), k))
            continue
        starts = []
        names = rows.sparkSession.createDataFrame([(int(c), int(b), int(n)) for c, b, n in zip(cells["cell"], bundle, cells["n"], strict=True)], "cell int, bundle int, n long")
        data = dealt.join(F.broadcast(names.select("cell", "bundle")), "cell").drop("cell").withColumnRenamed("bundle", "cell")
        queries = durable(now.mapInPandas(_asks_rest(cells, pivots, bundle, denser), f"{_ROW}, best double, cell int"))
        touched += queries.join(F.broadcast(names.groupBy(F.col("bundle").alias("cell")).agg(F.sum("n").alias("n"))), "cell").agg(F.sum("n")).first()[0] or 0
        again = links.drop("r").union(_ask(data, queries, k, denser, BUNDLE * side))
        links = durable(_cut(again.groupBy("i", "j").agg(F.min("d").alias("d")), k))
    return Nearest(links, touched)


def zero_based(links: DataFrame) -> DataFrame:
    """i, j, d, r with 0 for the nearest."""
    return links.withColumn("r", F.col("r") - 1)


def attributes(rows: DataFrame) -> DataFrame:
    """g, rho, delta, parent, gamma as `dpc.attributes` in its mode strict, without all pairs: the densest
    granule takes the largest delta, a tied maximum 0. No window over all granules."""
    near = nearest(rows, 1, denser=True).links.select(F.col("i").alias("g"), F.col("j").alias("parent"), F.col("d").alias("near"))
    top = rows.agg(F.min(F.struct((-F.col("rho")).alias("n"), "g")).getField("g").alias("first"))
    most = near.agg(F.max("near").alias("most"))
    all_ = rows.select("g", "rho").join(near, "g", "left").crossJoin(F.broadcast(top.crossJoin(most)))
    delta = F.coalesce("near", F.when(F.col("g") == F.col("first"), F.col("most")), F.lit(0.0))
    return all_.select("g", "rho", delta.alias("delta"), "parent").withColumn("gamma", F.col("rho") * F.col("delta"))
