"""The farthest-pair split of granules of any size, and the bottom-up choice between a node and its children."""

from __future__ import annotations

import itertools
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granula.functions import shapes
from granula.functions.state import durable

#: Points of a row of bytes, shells by distance to the centre, and partitions of such rows at most.
BLOCK, SHELLS, MOST_PARTS = 4000, 16, 512
#: What rounding may take from a bound.
SLACK = 1e-9


def centres(points: DataFrame, *keys: str) -> DataFrame:
    """Keys (g), n, c: the number of points and their mean. Sums are made where the points are read."""
    keys = list(keys or ("g",))
    types = ", ".join(f"{k} {dict(points.dtypes)[k]}" for k in keys)

    def run(batches):
        sums: dict = {}
        for pdf in batches:
            for key, rows in pdf.groupby(keys, sort=False)["features"]:
                x = np.stack(rows.to_numpy())
                n, v = sums.get(key, (0, 0.0))
                sums[key] = n + len(x), v + x.sum(axis=0)
            if len(sums) > 4096:  # what a task holds is bounded
                yield frame(sums)
                sums = {}
        if sums:
            yield frame(sums)

    def frame(sums):
        return pd.DataFrame(list(sums), columns=keys).assign(n=[n for n, _ in sums.values()], v=[v for _, v in sums.values()])

    part = points.select(*keys, "features").mapInPandas(run, f"{types}, n long, v array<double>")
    per = part.select(*keys, "n", F.posexplode("v").alias("p", "x")).groupBy(*keys, "p").agg((F.sum("x") / F.sum("n")).alias("x"), F.sum("n").alias("n"))
    return per.groupBy(*keys).agg(F.max("n").alias("n"), F.transform(F.sort_array(F.collect_list(F.struct("p", "x"))), lambda t: t["x"]).alias("c"))


def _known(points: DataFrame) -> dict:
    """g -> (n, c), the size and mean of each granule, on the driver: for granules too large for a task."""
    return {r["g"]: (r["n"], np.array(r["c"])) for r in centres(points).collect()}


def _by_granule(batches):
    """(g, rows, their points) of each granule in a batch."""
    for pdf in batches:
        for g, rows in pdf.groupby("g", sort=False):
            yield g, rows, np.stack(rows["features"].to_numpy())


def _gaps(x: np.ndarray, to: np.ndarray) -> np.ndarray:
    return ((x - to) ** 2).sum(axis=1)


def _seek(points: DataFrame, to: dict, near: bool = False) -> dict:
    """g -> (point, squared distance) of the granule's point that is farthest from (or nearest to) to[g], ties: the
    smallest id, and the largest squared distance."""
    sign = -1.0 if near else 1.0

    def run(batches):
        found: dict = {}
        for g, rows, x in _by_granule(batches):
            d, ids = _gaps(x, to[g]), rows["point_id"].to_numpy()
            at = np.flatnonzero(sign * d == (sign * d).max())
            at = at[ids[at].argmin()]
            here, most = (sign * d[at], -ids[at], x[at]), d.max()
            if g in found:
                here, most = max(here, found[g][0], key=lambda t: t[:2]), max(most, found[g][1])
            found[g] = here, most
        if found:
            yield pd.DataFrame([(g, s, i, v, most) for g, ((s, i, v), most) in found.items()], columns=["g", "s", "i", "x", "most"])

    best = points.select("g", "point_id", "features").mapInPandas(run, f"g {dict(points.dtypes)['g']}, s double, i long, x array<double>, most double")
    best = best.groupBy("g").agg(F.max(F.struct("s", "i", "x")).alias("f"), F.max("most").alias("most"))
    return {r["g"]: (np.array(r["f"]["x"]), sign * r["f"]["s"], r["most"]) for r in best.collect()}


def _blocks(kept: DataFrame, parts: int) -> DataFrame:
    """g, k, out, apart, ids, x: points (point_id, features, g, away, apart, r) as bytes, up to BLOCK of a granule and a
    shell in a row, copies once, as the smallest id. k numbers the rows, out is the largest away.
    Equal points go to the same partition."""

    def cut(g, pdfs):
        pdf = pd.concat(pdfs).sort_values("point_id", ignore_index=True)
        x, apart = np.stack(pdf["features"].to_numpy()), pdf["apart"].iloc[0]
        at = shapes.distinct(x)
        away, r = pdf["away"].to_numpy()[at], pdf["r"].iloc[0]
        at, away = at[(order := np.argsort(away, kind="stable"))], away[order]
        # Shells of equal width hold the outermost points of a large granule together.
        ends = np.flatnonzero(np.diff(np.floor(away / max(r, 1e-300) * SHELLS))) + 1
        for a, b in itertools.pairwise([0, *ends.tolist(), len(at)]):
            for s in range(a, b, BLOCK):
                part = at[s : min(b, s + BLOCK)]
                yield pd.DataFrame({"g": [g], "out": [away[min(b, s + BLOCK) - 1]], "apart": [apart], "ids": [pdf["point_id"].to_numpy()[part].tobytes()], "x": [x[part].tobytes()]})

    def run(batches):
        held: dict = {}
        for pdf in batches:
            for g, rows in pdf.groupby("g", sort=False):
                held.setdefault(g, []).append(rows)
                if sum(map(len, held[g])) >= SHELLS * BLOCK:  # what a task holds is bounded
                    yield from cut(g, held.pop(g))
        for g, pdfs in held.items():
            yield from cut(g, pdfs)

    dealt = kept.repartitionById(parts, F.pmod(F.xxhash64("features"), F.lit(parts)).cast("int"))
    rows = dealt.mapInPandas(run, f"g {dict(kept.dtypes)['g']}, out double, apart double, ids binary, x binary")
    return durable(rows.withColumn("k", F.monotonically_increasing_id()))


def _of_blocks(batches):
    """The farthest pair of each granule, as far as a task sees it, from pairs of blocks; ties: the smallest ids."""
    best: dict = {}
    for batch in batches:
        for g, apart, pi, x, qi, y in zip(*(batch.column(c) for c in range(6)), strict=True):
            g, apart = g.as_py(), apart.as_py()
            (pi, x), (qi, y) = ((np.frombuffer(i.as_buffer(), np.int64), np.frombuffer(v.as_buffer())) for i, v in ((pi, x), (qi, y)))
            x, y = x.reshape(len(pi), -1), y.reshape(len(qi), -1)
            least = best[g][0] if g in best else apart * apart * (1 - SLACK)
            for at, to, d in shapes.farthest(x, y, least=least):
                i, j = shapes.first_pair(pi[at], qi[to])
                found = (float(d[0]), -i, -j)
                if g not in best or found > best[g][:3]:
                    a, b = (np.concatenate([x[pi == t], y[qi == t]])[0] for t in (i, j))
                    best[g] = (*found, a, b)
    if best:
        d, i, j, a, b = zip(*best.values(), strict=True)
        yield pa.RecordBatch.from_pydict({"g": list(best), "d": d, "i": i, "j": j, "a": a, "b": b})


def farthest_pairs(points: DataFrame) -> DataFrame:
    """g, a, b: the farthest two points of each granule (ties: the smallest ids, a being the smaller).

    points: point_id, features, g; granules too large for a task, for the driver holds their means and end points. A point
    is in the pair only if its distance to the centre is at least the end points' distance less the granule's
    radius. The points left are written once, as blocks; two blocks meet only if their outer
    distances together reach the end points' distance. Partitions of blocks meet where they are read:
    pairs of blocks are neither written nor shuffled, so files grow as the points do.
    """
    known = _known(points)
    mid = {g: c for g, (_, c) in known.items()}
    low = _seek(points, mid, near=True)
    ends = _seek(points, {g: q for g, (q, _, _) in _seek(points, {g: q for g, (q, _, _) in low.items()}).items()})
    apart = {g: math.sqrt(d) for g, (_, d, _) in ends.items()}
    r = {g: math.sqrt(most) for g, (_, _, most) in low.items()}

    def outer(batches):
        for g, rows, x in _by_granule(batches):
            away = np.sqrt(_gaps(x, mid[g]))
            ok = away >= apart[g] - r[g] - SLACK * r[g]
            yield rows[ok].assign(away=away[ok], apart=apart[g], r=r[g])

    key = dict(points.dtypes)["g"]
    rows = points.select("point_id", "features", "g")
    kept = rows.mapInPandas(outer, f"point_id long, features array<double>, g {key}, away double, apart double, r double")
    n = sum(n for n, _ in known.values())
    # Enough partitions for all cores to have pairs of them, few enough for pairs of partitions to be tasks.
    cores = points.sparkSession.sparkContext.defaultParallelism
    parts = min(MOST_PARTS, max(1, -(-n // (8 * BLOCK)), min(n // BLOCK, math.ceil(math.sqrt(8 * cores)))))
    p = _blocks(kept, parts)
    q = p.select(*(F.col(c).alias(f"q{c}") for c in ("g", "k", "out", "ids", "x")))
    two = p.join(q.hint("shuffle_replicate_nl"), F.expr("g = qg and k <= qk and out + qout >= apart * (1 - 1e-9)"))
    found = two.select("g", "apart", "ids", "x", "qids", "qx").mapInArrow(_of_blocks, f"g {key}, d double, i long, j long, a array<double>, b array<double>")
    best = found.groupBy("g").agg(F.max(F.struct("d", "i", "j", "a", "b")).alias("f"))
    return best.select("g", F.col("f.a").alias("a"), F.col("f.b").alias("b"))


def split(points: DataFrame) -> DataFrame:
    """points with child: 0 if no farther from the farthest pair's first point than from its second."""
    ends = {r["g"]: (np.array(r["a"]), np.array(r["b"])) for r in farthest_pairs(points).collect()}

    def run(batches):
        for g, rows, x in _by_granule(batches):
            a, b = ends[g]
            yield rows.assign(child=(_gaps(x, a) > _gaps(x, b)).astype(np.int32))

    return points.mapInPandas(run, T.StructType([*points.schema.fields, T.StructField("child", T.IntegerType())]))


def qualities(points: DataFrame, gamma: float = 0.5) -> DataFrame:
    """g, quality = n * exp(-gamma * radius), of granules too large for a task."""
    mid = _known(points)

    def run(batches):
        far: dict = {}
        for g, _, x in _by_granule(batches):
            far[g] = max(far.get(g, 0.0), _gaps(x, mid[g][1]).max())
        if far:
            yield pd.DataFrame({"g": list(far), "n": [mid[g][0] for g in far], "r": list(far.values())})

    per = points.select("g", "features").mapInPandas(run, f"g {dict(points.dtypes)['g']}, n long, r double")
    return per.groupBy("g").agg(F.max("n").alias("n"), F.sqrt(F.max("r")).alias("r")).select("g", (F.col("n") * F.exp(-gamma * F.col("r"))).alias("quality"))


def prune(tops: DataFrame, inner: DataFrame) -> DataFrame:
    """top, node: the node that a subtree's root goes to (itself, or the highest ancestor that stands for all below).

    tops: top, best, the roots of finished subtrees, by their paths, with the best sum of qualities
    below them; inner: g, quality of the nodes above. A node stands for its children iff its
    quality reaches the sum of their best. Level by level from the bottom, by the parent's path.
    """
    now = durable(tops.select(F.col("top").alias("node"), "best"))
    depths = inner.agg(F.max(F.length("g")).alias("low"), F.min(F.length("g")).alias("high")).first()
    whole = []
    for depth in range(depths["low"] or 0, (depths["high"] or 1) - 1, -1):
        here = inner.where(F.length("g") == depth)
        below = now.withColumn("g", F.substring("node", 1, depth)).where(F.length("node") == depth + 1).groupBy("g").agg(F.sum("best").alias("below"))
        judged = durable(here.join(below, "g").select(F.col("g").alias("node"), F.greatest("quality", "below").alias("best"), (F.col("quality") >= F.col("below")).alias("whole")))
        whole.append(judged.where("whole").select("node"))
        now = durable(now.where(F.length("node") != depth + 1).union(judged.select("node", "best")))
    if not whole:
        return tops.select("top", F.col("top").alias("node"))
    kept = whole[0]
    for t in whole[1:]:
        kept = kept.union(t)
    prefixes = tops.select("top", F.explode(F.transform(F.sequence(F.lit(1), F.length("top")), lambda n: F.substring("top", F.lit(1), n))).alias("node"))
    high = prefixes.join(kept, "node", "left_semi").groupBy("top").agg(F.min(F.struct(F.length("node").alias("n"), "node")).getField("node").alias("high"))
    return tops.select("top").join(high, "top", "left").select("top", F.coalesce("high", "top").alias("node"))
