"""A uniform grid over points in any dimension: occupied cells, touching cells, seed regions.

A cell's key is an array of integers; its id is the smallest point id in it. Touching cells, those whose
keys differ by at most 1 everywhere, are found by descending a trie of key prefixes: the prefixes of
STEP more components of pairs of prefixes that touch are joined by their parents and compared. So no
cell enumerates its 3 ** d neighbours, and a pair of cells is looked at once its prefixes touch. As soon
as prefixes tell all cells apart the rest of the keys is compared at once.

Regions need no list of touching cells, which in many dimensions is quadratic: `regions` holds blocks of
cells against each other and writes only which cells of two blocks hang together.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granula.functions.joins import merge
from granula.functions.state import durable

STEP = 4
#: Cells of one side of a task that compares cells, and of the sample that all cells are held against first.
BLOCK = 4000


def unit(points: DataFrame) -> DataFrame:
    """id, features scaled to [0, 1] by column; constant columns become 0."""
    ends = points.select(F.posexplode("features").alias("p", "x")).groupBy("p").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    one = ends.agg(F.sort_array(F.collect_list(F.struct("p", "lo", "hi"))).alias("t"))
    return points.crossJoin(F.broadcast(one)).select("id", F.zip_with("features", "t", lambda x, t: F.when(t["hi"] > t["lo"], (x - t["lo"]) / (t["hi"] - t["lo"])).otherwise(0.0)).alias("features"))


def cells(points: DataFrame, bins: int) -> DataFrame:
    """points (id, features in [0, 1]) with their cell."""
    return points.withColumn("cell", F.transform("features", lambda x: F.least(F.lit(bins - 1), F.greatest(F.lit(0), F.floor(x * bins).cast("int")))))


def occupied(celled: DataFrame) -> DataFrame:
    """cell, node (its id), n, centre of each cell with points."""
    each = celled.select("cell", "id", F.posexplode("features").alias("p", "x"))
    means = each.groupBy("cell", "p").agg(F.avg("x").alias("x"), F.min("id").alias("node"), F.count("*").alias("n"))
    return means.groupBy("cell").agg(F.min("node").alias("node"), F.max("n").alias("n"), F.transform(F.sort_array(F.collect_list(F.struct("p", "x"))), lambda t: t["x"]).alias("centre"))


def adjacent(occ: DataFrame) -> DataFrame:
    """u, v: the ids of touching cells, both ways."""
    keys = durable(occ.select("cell", "node"))
    size = keys.agg(F.max(F.size("cell")).alias("d"), F.count("*").alias("n")).first()
    dims, total = size["d"] or 0, size["n"]
    close = F.expr("not exists(zip_with(cu, cv, (a, b) -> abs(a - b)), t -> t > 1)")

    def level(start: int, end: int) -> DataFrame:
        """node, parent, chunk of the prefixes of `end` components; a prefix has its smallest cell's id."""
        own = keys.groupBy(F.slice("cell", 1, end).alias("key")).agg(F.min("node").alias("node"))
        if not start:
            return own.select("node", F.lit(-1).cast("long").alias("parent"), F.col("key").alias("chunk"))
        up = keys.groupBy(F.slice("cell", 1, start).alias("key")).agg(F.min("node").alias("parent"))
        return own.select("node", F.slice("key", 1, start).alias("up"), F.slice("key", start + 1, end - start).alias("chunk")).join(up.withColumnRenamed("key", "up"), "up").select("node", "parent", "chunk")

    at = min(STEP, dims)
    first = durable(level(0, at))
    near = first.withColumn("lead", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda s: F.col("chunk")[0] + s)))
    pairs = merge(near.selectExpr("node as u", "chunk as cu", "lead"), first.selectExpr("node as v", "chunk as cv", "chunk[0] as lead"), "lead").where(close).select("u", "v")
    distinct = first.count()
    while at < dims:
        end = dims if distinct == total else min(at + STEP, dims)
        now = durable(level(at, end))
        left = merge(pairs.withColumnRenamed("u", "parent"), now, "parent").select(F.col("node").alias("u"), F.col("chunk").alias("cu"), F.col("v").alias("parent"))
        pairs = durable(merge(left, now.select("parent", F.col("node").alias("v"), F.col("chunk").alias("cv")), "parent").where(close).select("u", "v"))
        at, distinct = end, now.count()
    return pairs.where("u != v")


def components(occ: DataFrame, touching: DataFrame) -> DataFrame:
    """node, component: the smallest cell id reachable; minimum labels and pointer jumping to a fixpoint."""
    edges = durable(touching)
    lab = durable(occ.select("node", F.col("node").alias("component")))
    while True:
        best = merge(edges, lab.select(F.col("node").alias("v"), "component"), "v").groupBy(F.col("u").alias("node")).agg(F.min("component").alias("m"))
        step = lab.join(best, "node", "left").select("node", F.col("component").alias("old"), F.least("component", F.coalesce("m", "component")).alias("c"))
        up = lab.select(F.col("node").alias("c"), F.col("component").alias("up"))
        new = durable(step.join(up, "c").select("node", "old", F.least("c", "up").alias("component")))
        if not new.where("old != component").limit(1).count():
            return new.select("node", "component")
        lab = new.select("node", "component")


def _clash(cells: np.ndarray, bins: int) -> tuple[np.ndarray, np.ndarray]:
    """0/1 rows whose product, of the first with another's second, counts what keeps two cells apart: the
    steps t with one component at most t and the other's over t + 1."""
    low = np.concatenate([cells <= t for t in range(bins - 2)], axis=1)
    high = np.concatenate([cells >= t + 2 for t in range(bins - 2)], axis=1)
    return np.concatenate([low, high], axis=1).astype(np.float32), np.concatenate([high, low], axis=1).astype(np.float32)


def _touching(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the touching cells of two blocks of keys; components in which all touch are left out."""
    both = np.concatenate([x, y])
    lo, hi = both.min(axis=0, initial=1 << 30), both.max(axis=0, initial=-1)
    wide = np.flatnonzero(hi - lo > 1)
    bins = int((hi - lo)[wide].max(initial=0)) + 1
    if not len(wide):
        return np.repeat(np.arange(len(x)), len(y)), np.tile(np.arange(len(y)), len(x))
    if len(wide) * (bins - 2) > 1024:  # few dimensions' worth of steps, else plain differences
        step, out = max(1, (1 << 22) // max(1, y.size)), []
        for a in range(0, len(x), step):
            i, j = np.nonzero((np.abs(x[a : a + step, None] - y[None]) <= 1).all(axis=2))
            out.append((i + a, j))
        return np.concatenate([i for i, _ in out]), np.concatenate([j for _, j in out])
    a, b = _clash(x[:, wide] - lo[wide], bins)[0], _clash(y[:, wide] - lo[wide], bins)[1]
    step, out = max(1, (1 << 24) // max(1, len(y))), []
    for s in range(0, len(x), step):
        i, j = np.nonzero(a[s : s + step] @ b.T == 0)
        out.append((i + s, j))
    return np.concatenate([i for i, _ in out]), np.concatenate([j for _, j in out])


def _roots(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest member of each one's component under edges i, j among n."""
    root = np.arange(n)
    while len(i):
        a, b = root[i], root[j]
        go = a != b
        i, j, a, b = i[go], j[go], a[go], b[go]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (up := root[root] != root).any():
            root[up] = root[root[up]]
    return root


def _join_blocks(p: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
    """u, v: components (named by a cell) that touching cells of two blocks join, as stars about their smallest.
    Cells of the component that most cells of either block are in are not held against each other."""
    if not len(p) or not len(q):
        return pd.DataFrame({"u": [], "v": []})
    names, at = np.unique(np.concatenate([p["component"], q["component"]]), return_inverse=True)
    most = np.bincount(at).argmax()
    a, b = at[: len(p)], at[len(p) :]
    x, y = np.stack(p["cell"].to_numpy()), np.stack(q["cell"].to_numpy())
    edges = []
    for rows, cols in ((np.flatnonzero(a != most), np.arange(len(y))), (np.flatnonzero(a == most), np.flatnonzero(b != most))):
        if len(rows) and len(cols):
            i, j = _touching(x[rows], y[cols])
            edges.append(np.unique(a[rows[i]] * len(names) + b[cols[j]]))
    pairs = np.concatenate(edges) if edges else np.zeros(0, np.int64)
    root = _roots(len(names), pairs // len(names), pairs % len(names))
    moved = np.flatnonzero(root != np.arange(len(names)))
    return pd.DataFrame({"u": names[moved], "v": names[root[moved]]})


def _renamed(cells_: DataFrame, edges: DataFrame) -> DataFrame:
    """cells_ with the components that edges between components leave."""
    edges = durable(edges.distinct())
    both = edges.union(edges.select("v", "u"))
    to = components(both.select(F.col("u").alias("node")).distinct(), both)
    return durable(cells_.join(to.select(F.col("node").alias("component"), F.col("component").alias("to")), "component", "left").select("cell", "node", F.coalesce("to", "component").alias("component"), "block"))


def regions(occ: DataFrame) -> DataFrame:
    """node, component: as `components` of `adjacent`, without a list of touching cells.

    Blocks hold about BLOCK cells that follow each other by key. First all are held against one sample of
    cells, which joins most cells of dense regions; then every two blocks whose boxes touch. Two
    blocks give at most a row for each component they hold, and cells of one large component are not compared.
    """
    n = occ.count()
    now = durable(occ.select("cell", "node", F.col("node").alias("component")))
    blocks = max(1, -(-n // BLOCK))
    key = now.select("cell").first() if n else None
    order = [F.col("cell")[i] for i in range(len(key["cell"]))] if key else [F.col("node")]
    now = durable(now.repartitionByRange(blocks, *order).withColumn("block", F.spark_partition_id()))
    schema = "u long, v long"
    if blocks > 1:
        few = F.broadcast(durable(now.orderBy(F.xxhash64("node"), "node").limit(BLOCK)).select("cell", "component").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))))
        few = few.toDF(*few.columns)
        now = _renamed(now, now.select("cell", "component", "block").groupBy("block").cogroup(few.groupBy("block")).applyInPandas(_join_blocks, schema))
    ends = now.groupBy("block").agg(*(F.array(*(f(c) for c in order)).alias(name) for f, name in ((F.min, "lo"), (F.max, "hi")))) if key else now.select("block", F.array().alias("lo"), F.array().alias("hi"))
    boxes = durable(ends)
    close = F.expr("forall(zip_with(xhi, ylo, (a, b) -> a + 1 >= b), t -> t) and forall(zip_with(yhi, xlo, (a, b) -> a + 1 >= b), t -> t)")
    tasks = boxes.select(F.col("block").alias("a"), F.col("lo").alias("xlo"), F.col("hi").alias("xhi")).join(F.broadcast(boxes.select(F.col("block").alias("b"), F.col("lo").alias("ylo"), F.col("hi").alias("yhi"))), close & (F.col("a") <= F.col("b"))).select("a", "b")
    tasks = F.broadcast(durable(tasks))
    rows = now.select("cell", "component", "block")
    left = rows.withColumnRenamed("block", "a").join(tasks, "a")
    right = rows.withColumnRenamed("block", "b").join(tasks, "b")
    right = right.toDF(*right.columns)
    now = _renamed(now, left.groupBy("a", "b").cogroup(right.groupBy("a", "b")).applyInPandas(_join_blocks, schema))
    return _smallest(now)


def _smallest(cells_: DataFrame) -> DataFrame:
    name = cells_.groupBy("component").agg(F.min("node").alias("name"))
    return cells_.join(name, "component").select("node", F.col("name").alias("component"))


def seeds(celled: DataFrame, comps: DataFrame, occ: DataFrame, least: int = 1) -> DataFrame:
    """id, seed: one region per component of at least `least` points, larger ones first (ties: the
    first point); points of smaller components have the seed -1."""
    comp = occ.select("cell", "node").join(comps, "node").select("cell", "component")
    size = occ.join(comps, "node").groupBy("component").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    order = durable(size.repartitionByRange(F.desc("n"), "component").withColumn("_p", F.spark_partition_id()))
    before = order.groupBy("_p").agg(F.count("*").alias("_n")).select("_p", (F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).alias("_o"))
    ranked = order.join(F.broadcast(before), "_p").withColumn("seed", F.row_number().over(Window.partitionBy("_p").orderBy(F.desc("n"), "component")) + F.col("_o") - 1)
    of_cell = comp.join(ranked.select("component", "seed"), "component", "left").select("cell", F.coalesce("seed", F.lit(-1)).cast("long").alias("seed"))
    return celled.select("id", "cell").join(of_cell, "cell").select("id", "seed")
