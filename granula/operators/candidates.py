"""Lists of centres by five rules, labelled and scored in one plan.

All lists are prefixes of one order, gamma descending, thinned by one distance; so they are prefixes of
one greedy choice, and a list is its number of centres. The number goes along as a column: all lists'
chains are followed together, and all are scored by the same joins.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window
from pyspark.sql import functions as F

from granula.functions.state import durable
from granula.operators.dpc import greedy

TINY = 1e-12


def sizes(dpc: DataFrame, pairs: DataFrame) -> tuple[list[int], float]:
    """How many of the first granules by gamma each rule takes, and the least distance of centres, the
    median positive delta: the largest relative drop, all of a fifth of the first, all over mean + half a
    deviation of the scaled ones, the elbow, the first two if the second is half as large and far."""
    by = Window.orderBy(F.desc("gamma"), "g")
    every = Window.partitionBy()
    r = dpc.select("g", "gamma", "delta").withColumn("pick", F.row_number().over(by)).withColumn("next", F.lead("gamma").over(by))
    r = r.withColumn("lo", F.min("gamma").over(every)).withColumn("hi", F.max("gamma").over(every)).withColumn("m", F.count("*").over(every))
    r = durable(r.withColumn("norm", F.expr(f"(gamma - lo) / (hi - lo + {TINY})")))
    first = lambda e, c=None: F.max(F.when(c if c is not None else F.lit(True), F.struct(F.round(F.expr(e), 12).alias("v"), (-F.col("pick")).alias("n")))).getField("n")
    ends = r.agg(F.max(F.when(F.col("pick") == 1, F.col("norm"))).alias("a"), F.max(F.when(F.col("pick") == F.col("m"), F.col("norm"))).alias("z"), (F.avg("norm") + 0.5 * F.stddev_pop("norm")).alias("over"), F.median(F.when(F.col("delta") > 0, F.col("delta"))).alias("tau"))
    one = r.crossJoin(F.broadcast(ends)).agg(
        F.max("m").alias("m"), F.max("hi").alias("hi"), F.max("lo").alias("lo"), F.first("tau").alias("tau"),
        (-first(f"greatest((gamma - next) / (abs(gamma) + {TINY}), 0)", F.col("next").isNotNull())).alias("drop"),
        F.max(F.when(F.expr("gamma >= 0.2 * hi"), F.col("pick"))).alias("head"), F.max(F.when(F.col("norm") >= F.col("over"), F.col("pick"))).alias("high"),
        (-first("abs((pick - 1) / greatest(m - 1, 1) * (z - a) - (norm - a))")).alias("elbow"),
        F.max(F.when(F.col("pick") == 1, F.col("g"))).alias("g1"), F.max(F.when(F.col("pick") == 2, F.col("g"))).alias("g2"), F.max(F.when(F.col("pick") == 2, F.col("gamma"))).alias("second"),
    ).first()
    tau = one["tau"] or 0.0
    if (one["m"] or 0) < 2 or abs(one["hi"] - one["lo"]) <= 1e-8 + 1e-5 * abs(one["hi"]):
        return [1], tau
    gap = pairs.where((F.col("i") == one["g1"]) & (F.col("j") == one["g2"])).first()["d"]
    strong = one["second"] / (one["hi"] + TINY) >= 0.5 and gap > tau
    return [one["drop"], one["head"] or 1, one["high"] or 1, one["elbow"] if one["m"] > 2 else 1, 1 + strong], tau


def scored(dpc: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(lists, centres): k, score, chosen of each list of centres; g, label of the best one's.

    A list's score: the mean distance of its centres over the mean distance to the own centre, + 0.35 of
    the centres' share of gamma, less 0.60 of the share of clusters of one granule, 0.25 of the sizes'
    variation and 0.20 of the centres' share of all. The first rule's list wins a tie.
    """
    asked, tau = sizes(dpc, pairs)
    spark, m = dpc.sparkSession, dpc.count()
    order = durable(dpc.select("g", "gamma", F.row_number().over(Window.orderBy(F.desc("gamma"), "g")).alias("pick")).orderBy("pick").limit(max(asked)))
    near = pairs.where(F.col("d") <= tau).select(F.col("i").alias("g"), F.col("j").alias("h"))
    head = order.select("g")
    near = near.join(head, "g", "left_semi").join(head.withColumnRenamed("g", "h"), "h", "left_semi")
    kept = greedy(order, near, max(asked)).join(order.select("g", "gamma"), "g").withColumn("label", F.row_number().over(Window.orderBy("pick")) - 1)
    kept = durable(kept.select("g", "pick", "gamma", "label"))
    found = kept.agg(*(F.count_if(F.col("pick") <= n).alias(f"n{o}") for o, n in enumerate(asked))).first()
    counts = list(dict.fromkeys(int(x) for x in found))  # equal lists count once, at their first rule
    lists = spark.createDataFrame(list(enumerate(counts)), "o int, k int")
    own = durable(F.broadcast(lists).join(kept, F.col("label") < F.col("k")).select("o", "k", "g", "label", "gamma"))

    ptr = F.broadcast(lists).crossJoin(dpc.select("g", "parent")).join(own.select("o", "g", F.lit(True).alias("c")), ["o", "g"], "left")
    ptr = durable(ptr.select("o", "g", F.when(F.col("c"), F.col("g")).otherwise(F.coalesce("parent", "g")).alias("root")))
    for _ in range(math.ceil((math.ceil(math.log2(max(2, m))) + 1) / 2)):
        up = ptr.select("o", F.col("g").alias("root"), F.col("root").alias("up"))
        hop = lambda t: t.join(up, ["o", "root"]).select("o", "g", F.col("up").alias("root"))  # noqa: B023, E731
        ptr = durable(hop(hop(hop(ptr))))
    to = pairs.join(own.select("o", F.col("g").alias("j"), "label"), "j")
    nearest = to.groupBy("o", F.col("i").alias("g")).agg(F.min(F.struct("d", "label")).getField("label").alias("near"))
    lab = ptr.join(own.select("o", F.col("g").alias("root"), "label"), ["o", "root"], "left").join(nearest, ["o", "g"], "left")
    lab = durable(lab.select("o", "g", F.coalesce("label", "near", F.lit(0)).alias("label")))
    centre = own.select("o", "label", F.col("g").alias("j"))
    inner = lab.join(centre, ["o", "label"]).join(pairs.select(F.col("i").alias("g"), "j", "d"), ["g", "j"], "left").groupBy("o").agg(F.avg(F.coalesce("d", F.lit(0.0))).alias("inner"))
    a, b = own.select("o", F.col("g").alias("i"), F.col("label").alias("li")), own.select("o", F.col("g").alias("j"), F.col("label").alias("lj"))
    outer = a.join(b, "o").where("li < lj").join(pairs, ["i", "j"]).groupBy("o").agg(F.avg("d").alias("outer"))
    shape = lab.groupBy("o", "label").agg(F.count("*").alias("s")).groupBy("o").agg(F.avg((F.col("s") <= 1).cast("double")).alias("tiny"), (F.stddev_pop("s") / (F.avg("s") + TINY)).alias("vary"), F.count("*").alias("n"))
    total = dpc.agg(F.sum("gamma").alias("all"))
    part = own.groupBy("o").agg(F.sum("gamma").alias("g_sum"))
    t = lists.join(inner, "o").join(outer, "o", "left").join(shape, "o").join(part, "o").crossJoin(F.broadcast(total))
    t = t.withColumn("score", F.expr(f"coalesce(outer, 0) / (inner + {TINY}) + 0.35 * g_sum / (all + {TINY}) - 0.60 * tiny - 0.25 * if(k > 1, vary, 0) - 0.20 * k / {m}"))
    t = durable(t.select("o", "k", "score"))
    best = t.agg(F.max(F.struct("score", (-F.col("o")).alias("n"))).alias("b")).select((-F.col("b.n")).alias("best"))
    out = t.crossJoin(F.broadcast(best)).select("k", "score", (F.col("o") == F.col("best")).alias("chosen"))
    return out, own.join(F.broadcast(best), F.col("o") == F.col("best")).select("g", "label")
