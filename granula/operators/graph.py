"""Order-dependent label propagation over neighbour graphs, in rounds.

Both rules walk the granules in the order of density, and a granule's label depends on labels given
before. Such labels are the only solution of "each label is what the rule makes of its inputs", for
the inputs are earlier granules and so there is no cycle. The rounds start from a guess and ask again
only granules with an input that changed, until nothing changes: what stands then is that solution,
the sequential labels, whatever the guess. A good guess saves rounds.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granula.functions.joins import merge, spread
from granula.functions.state import durable
from granula.operators import index
from granula.operators.labels import chains


def strong_links(rows: DataFrame) -> DataFrame:
    """i, j, d, r, rho_j: the ceil(log2 M), at least 2, nearest denser granules; rows as for `index.nearest`."""
    m = rows.count()
    links = index.nearest(rows, max(2, math.ceil(math.log2(max(2, m)))), denser=True).links
    return links.join(rows.select(F.col("g").alias("j"), F.col("rho").alias("rho_j")), "j").select("i", "j", "d", "r", "rho_j")


def _into(links: DataFrame) -> DataFrame:
    """j, size: how many granules ask j."""
    return durable(links.groupBy("j").agg(F.count("*").alias("size")))


def _put(state: DataFrame, moved: DataFrame, columns: list[str]) -> DataFrame:
    """state (g, ...) with the columns of moved's rows in place of its own."""
    new = moved.select("g", F.struct(*columns).alias("_new"))
    kept = [F.when(F.col("_new").isNotNull(), F.col(f"_new.{c}")).otherwise(F.col(c)).alias(c) if c in columns else c for c in state.columns]
    return state.join(new, "g", "left").select(*kept)


def _best(votes: DataFrame) -> DataFrame:
    """g, label, share, total of votes (i, r, w, label): most weight; ties to the label with the nearest voter."""
    per = votes.groupBy("i", "label").agg(F.sum("w").alias("v"), F.min("r").alias("first"))
    top = per.groupBy(F.col("i").alias("g")).agg(F.max(F.struct("v", (-F.col("first")).alias("f"), "label")).alias("b"), F.sum("v").alias("total"))
    return top.select("g", F.col("b.label").alias("label"), (F.col("b.v") / (F.col("total") + 1e-12)).alias("share"), "total")


def strong_graph(links: DataFrame, rows: DataFrame, centres: DataFrame, near: DataFrame) -> DataFrame:
    """g, label: each granule takes the vote, rho / distance, of its nearest denser ones as labelled.

    links: `strong_links`; rows: g, ... of all granules; centres: g, label; near: g, near, the nearest
    centre's label, for granules that are no centres and have no denser ones. Distances are kept
    from 0 by 1e-9 of the links' median positive one.
    """
    mid = links.where("d > 0").agg(F.coalesce(F.median("d"), F.lit(1e-3)).alias("mid"))
    # Centres take no votes, so they have no inputs here.
    asked = links.join(centres.select(F.col("g").alias("i")), "i", "left_anti").crossJoin(F.broadcast(mid))
    asked = durable(asked.select("i", "j", "r", (F.col("rho_j") / (F.col("d") + 1e-9 * F.col("mid"))).alias("w")))
    into, total = _into(asked), asked.count()
    # The guess: labels run down the chains of nearest denser granules.
    first = rows.select("g").join(asked.where("r = 1").select(F.col("i").alias("g"), F.col("j").alias("parent")), "g", "left")
    roots = chains(first, centres).join(centres.select(F.col("g").alias("root"), "label"), "root", "left")
    roots = roots.join(near.select(F.col("g").alias("root"), "near"), "root", "left")
    now = durable(roots.select("g", F.coalesce("label", "near", F.lit(0)).cast("int").alias("label")))
    moved = None
    while True:
        ask = asked if moved is None else merge(asked, merge(asked, moved.select(F.col("g").alias("j")), "j", "left_semi").select("i").distinct(), "i", "left_semi")
        votes = spread(ask, merge(now.withColumnRenamed("g", "j"), into, "j"), ["j"], "size", F.col("i"), total)
        new = _best(votes).select("g", F.col("label").alias("new"))
        moved = durable(new.join(now, "g").where("new != label").select("g", F.col("new").alias("label")))
        if not moved.limit(1).count():
            return now
        now = durable(_put(now, moved, ["label"]))


def vote_weights(edges: DataFrame, granules: DataFrame) -> DataFrame:
    """i, j, r, w, early of natural neighbours (i, j, d, r): exp(-(d / scale)^2) * rho * root of n of the
    neighbour, scale being the median positive distance of i's neighbours; early: j comes before i."""
    scale = edges.groupBy("i").agg(F.greatest(F.coalesce(F.median(F.when(F.col("d") > 0, F.col("d"))), F.lit(1.0)), F.lit(1e-12)).alias("scale"))
    side = granules.select(F.col("g").alias("j"), F.col("rho").alias("rho_j"), "n")
    both = edges.join(scale, "i").join(side, "j").join(granules.select(F.col("g").alias("i"), "rho"), "i")
    w = F.exp(-F.pow(F.col("d") / F.col("scale"), 2)) * F.greatest("rho_j", F.lit(1e-12)) * F.sqrt(F.greatest("n", F.lit(1)))
    return both.select("i", "j", "r", w.alias("w"), ((F.col("rho_j") > F.col("rho")) | ((F.col("rho_j") == F.col("rho")) & (F.col("j") < F.col("i")))).alias("early"))


def reliable(edges: DataFrame, granules: DataFrame, centres: DataFrame, share: float = 0.70, least: float = 0.0) -> DataFrame:
    """g, label, confidence: sweeps in the order of density label what its labelled neighbours agree on.

    A granule without label takes the neighbours' vote (`vote_weights`) if their weights are over
    `least` and the winner has `share` of them; it sees labels given earlier in the same sweep. Labels
    stay; sweeps go on until one gives none. A granule nobody vouches for has no label and confidence 0.

    edges: i, j, d, r, both ways; granules: g, rho, n; centres: g, label.
    """
    asked = durable(vote_weights(edges, granules))
    into, total = _into(asked), asked.count()
    known = granules.select("g").join(centres.select("g", F.col("label").cast("int").alias("now")), "g", "left")
    state = durable(known.select("g", F.col("now").alias("was"), "now", F.when(F.col("now").isNull(), 0.0).otherwise(1.0).alias("confidence")))
    fresh = None  # what the last sweep labelled; before the first, all
    while True:
        moved = fresh
        while True:
            open_ = state.where("was is null").select(F.col("g").alias("i"))
            ask = merge(asked, open_, "i", "left_semi")
            if moved is not None:
                ask = merge(ask, merge(ask, moved.select(F.col("g").alias("j")), "j", "left_semi").select("i").distinct(), "i", "left_semi")
            seen = spread(ask, merge(state.select(F.col("g").alias("j"), "was", "now"), into, "j"), ["j"], "size", F.col("i"), total)
            votes = seen.select("i", "r", "w", F.when(F.col("early"), F.col("now")).otherwise(F.col("was")).alias("label")).where("label is not null")
            good = (F.col("total") > least) & (F.col("share") >= share)
            new = _best(votes).select("g", F.when(good, F.col("label")).alias("new"), F.when(good, F.col("share")).otherwise(0.0).alias("sure"))
            # Asked, but without any vote (a guess was taken back): no label.
            new = ask.select(F.col("i").alias("g")).distinct().join(new, "g", "left").select("g", "new", F.coalesce("sure", F.lit(0.0)).alias("sure"))
            moved = durable(new.join(state, "g").where("not (new <=> now) or abs(sure - confidence) > 1e-9").select("g", F.col("new").alias("now"), F.col("sure").alias("confidence")))
            if not moved.limit(1).count():
                break
            state = durable(_put(state, moved, ["now", "confidence"]))
        fresh = durable(state.where("was is null and now is not null").select("g"))
        if not fresh.limit(1).count():
            return state.select("g", F.col("now").alias("label"), "confidence")
        state = durable(state.withColumn("was", F.col("now")))
