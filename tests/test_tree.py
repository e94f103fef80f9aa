"""The farthest-pair tree by levels against the whole tree in one task."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from granula.functions import shapes
from granula.operators import tree
from granula.plans import pipelines


def points(spark, m, dims, seed):
    r = np.random.default_rng(seed)
    x = np.round(r.normal(size=(m, dims)) * 2 + 9 * r.integers(0, 4, size=(m, 1)), 2)
    return x, spark.createDataFrame([(i, [float(v) for v in x[i]]) for i in range(m)], "point_id long, features array<double>")


@pytest.mark.parametrize("dims", [1, 3])
def test_farthest_pairs_by_blocks(spark, monkeypatch, dims):
    monkeypatch.setattr(tree, "BLOCK", 11)
    x, p = points(spark, 300, dims, dims)
    p = p.withColumn("g", F.col("point_id") % 3)
    got = {r.g: (r.a, r.b) for r in tree.farthest_pairs(p).collect()}
    for g in range(3):
        y = x[g::3]
        i, j = shapes.farthest_pair(y)
        assert got[g] == (list(y[i]), list(y[j]))


def test_levels_give_the_leaves_of_one_task(spark):
    _, p = points(spark, 500, 3, 5)
    cfg = pipelines.CONFIGS["ball_dpc_tree"]
    leaves = lambda most: sorted(tuple(sorted(r.ids)) for r in pipelines.granulate(p, cfg, most)[0].groupBy("g").agg(F.collect_list("point_id").alias("ids")).collect())
    whole = leaves(50_000)
    assert len(whole) > 4 and leaves(60) == whole


def test_prune_takes_the_highest_node_that_reaches_its_children(spark):
    tops = spark.createDataFrame([("r00", 2.0), ("r01", 3.0), ("r10", 1.0), ("r11", 1.5)], "top string, best double")
    inner = spark.createDataFrame([("r", 6.9), ("r0", 5.0), ("r1", 2.0)], "g string, quality double")
    assert {r.top: r.node for r in tree.prune(tops, inner).collect()} == {"r00": "r0", "r01": "r0", "r10": "r10", "r11": "r11"}
    high = inner.withColumn("quality", F.when(F.col("g") == "r", 99.0).otherwise(F.col("quality")))
    assert {r.node for r in tree.prune(tops, high).collect()} == {"r"}
