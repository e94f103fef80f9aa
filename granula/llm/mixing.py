"""Mixing sources to target weights, in DataFrame functions only.

Sources in code point order (null last) weigh 1, 2, 3, repeating, and share 100% of all words by
weight; a target stops at 3 times its source's words, and what is over is shared anew by weight
until no target is above. A target is met by complete epochs of its source, then by a fraction of
one: an Efraimidis-Spirakis sample in the order of -ln(u) / w, where u is a uniform hash of the
doc_id and w the document's quality weight (the share of letters among its characters, at least
1/20), cut by prefix sums at the word budget. The last place goes to the document behind the cut
that brings the words nearest to the budget (ties: first in the order), or to none.

The order is cut into key ranges whose sums give each range its offset, so a source that holds a
third of all rows is never sorted in one task: only the range in which the budget ends is sorted.

Defined cases: null or empty text has size 0 and is taken 0 words; a null source is one of its own,
after the others; a source without words has target 0; repeated rows count one by one, ordered by
doc_id; a row without doc_id is ignored; an empty table gives an empty result. The columns of docs
other than doc_id, text and source are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granula.llm.common import WS, durable

#: Rows of a source that one key range holds on average.
RANGE_ROWS = 2_000
#: Weights, each twice the last, that stand for all between 1/20 and 1 in the cut of key ranges.
WEIGHTS = (0.05, 0.1, 0.2, 0.4, 0.8)
CAP = 3


def word_count(text: F.Column) -> F.Column:
    """Words of a text, without making an array of them."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    marks = F.regexp_replace(text, rf"[{WS}]*+[^{WS}]++[{WS}]*+", "x")
    return F.when(text.rlike(rf"[^{WS}]"), F.length(marks)).otherwise(0).cast("long")


def quality_weight(text: F.Column) -> F.Column:
    text = F.coalesce(text.cast("string"), F.lit(""))
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]++", ""))
    return F.greatest(F.lit(0.05), letters / F.greatest(F.length(text), F.lit(1)))


def uniform(doc_id: F.Column) -> F.Column:
    """A number in (0, 1) from the MD5 of a document's id: 52 of its bits."""
    return (F.conv(F.substring(F.md5(doc_id.cast("string").cast("binary")), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))


def targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, n, target) of a table of (source, size); one row per source."""
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    all_ = Window.partitionBy(F.lit(1))
    by = by.select("*", F.row_number().over(all_.orderBy(F.col("source").isNull(), "source")).alias("at"))
    by = by.select("*", ((F.col("at") - 1) % 3 + 1).alias("w"), (CAP * F.col("source_size")).alias("cap"), F.sum("source_size").over(all_).alias("total"))
    # Water level: sources in the order in which they fill up; the first level that the next can hold.
    fill = all_.orderBy(F.col("cap") / F.col("w"), "at")
    upto = fill.rowsBetween(Window.unboundedPreceding, -1)
    by = by.select("*", F.coalesce(F.sum("cap").over(upto), F.lit(0)).alias("full"), F.coalesce(F.sum("w").over(upto), F.lit(0)).alias("gone"), F.sum("w").over(all_).alias("weights"), F.row_number().over(fill).alias("nth"))
    level = (F.col("total") - F.col("full")) / (F.col("weights") - F.col("gone"))
    by = by.select("*", F.min(F.when(level * F.col("w") <= F.col("cap"), F.struct("nth", level.alias("level")))).over(all_)["level"].alias("level"))
    share = F.least(F.col("cap").cast("double"), F.coalesce("level", F.lit(0.0)) * F.col("w"))
    return by.select("source", "source_size", "n", share.alias("target"))


def sort_key(doc_id: F.Column, w: F.Column) -> F.Column:
    """Efraimidis-Spirakis: an exponential number, smaller for heavier documents."""
    return -F.log(uniform(doc_id)) / w


def key_range(key: F.Column, ranges: F.Column) -> F.Column:
    """The key's place in the mean distribution of weights 1/20 to 1, cut evenly: a range holds at most
    about ten times its share of a source, whatever its documents weigh."""
    below = sum(((1 - F.exp(-key * w)) for w in WEIGHTS[1:]), 1 - F.exp(-key * WEIGHTS[0])) / len(WEIGHTS)
    return F.least(ranges - 1, F.floor(ranges * below))


def _place(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(per source, rows in ranges that go in or stay out whole, rows of the ranges in which the
    budgets end with `in`, last documents)."""
    rows = durable(
        docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), F.col("source").cast("string"), word_count(F.col("text")).alias("size"), quality_weight(F.col("text")).alias("w"))
    )
    per = targets(rows)
    per = per.select("*", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).alias("epochs"))
    per = durable(per.select("*", (F.col("target") - F.col("epochs") * F.col("source_size")).alias("budget"), F.greatest(F.lit(1), F.ceil(F.col("n") / RANGE_ROWS)).alias("ranges")))
    key = sort_key(F.col("doc_id"), F.col("w"))
    keyed = rows.join(per, rows["source"].eqNullSafe(per["source"])).select(
        "doc_id", rows["source"], "size", "source_size", "target", "epochs", "budget", key.alias("key"), key_range(key, F.col("ranges")).alias("r")
    )
    keyed = durable(keyed)
    source = Window.partitionBy("source")
    sums = keyed.groupBy("source", "r").agg(F.sum("size").alias("words"), F.max("budget").alias("b"))
    sums = sums.select("source", "r", "words", "b", F.coalesce(F.sum("words").over(source.orderBy("r").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    state = F.when(F.col("before") + F.col("words") <= F.col("b"), 1).when(F.col("before") >= F.col("b"), 0)
    sums = durable(sums.select("source", "r", "before", state.alias("whole")))
    placed = keyed.join(sums, keyed["source"].eqNullSafe(sums["source"]) & (keyed["r"] == sums["r"])).drop(sums["source"]).drop(sums["r"])
    # Only the range in which a source's budget ends is sorted.
    order = Window.partitionBy("source", "r").orderBy("key", "doc_id")
    cut = durable(placed.where("whole is null").select("*", (F.col("before") + F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0))).alias("upto")))
    cut = cut.withColumn("in", F.col("upto") <= F.col("budget"))
    reached = cut.groupBy("source").agg(F.max("budget").alias("b"), F.max(F.when(F.col("in"), F.col("upto")).otherwise(F.col("before"))).alias("have"))
    rest = placed.where("whole = 0").select("doc_id", "source", "size", "key").union(cut.where("not in").select("doc_id", "source", "size", "key"))
    gap = rest.join(reached, rest["source"].eqNullSafe(reached["source"])).select(rest["source"], "doc_id", "size", "key", (F.col("b") - F.col("have")).alias("gap"))
    last = (
        gap.groupBy("source")
        .agg(F.min(F.struct(F.abs(F.col("gap") - F.col("size")).alias("off"), "key", "doc_id", "gap")).alias("best"))
        .where("best.off < best.gap")
        .select(F.col("source").alias("ls"), F.col("best.doc_id").alias("last"))
    )
    return per, placed.where("whole is not null"), cut, last


def mix(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken."""
    _, whole, cut, last = _place(docs)
    cols = ["doc_id", "source", "size", "source_size", "target", "epochs"]
    chosen = whole.select(*cols, F.col("whole").alias("sel")).union(cut.select(*cols, F.col("in").cast("int").alias("sel")))
    taken = F.col("size") * (F.col("epochs") + F.when(F.col("doc_id") == F.col("last"), 1).otherwise(F.col("sel")))
    return chosen.join(F.broadcast(last), chosen["source"].eqNullSafe(last["ls"]), "left").select("doc_id", "size", "source_size", "target", taken.cast("long").alias("taken"))


def materialise(docs: DataFrame) -> DataFrame:
    """The mix itself: every row of docs as often as it is taken; rows without words stay once, for
    they cost no budget and only selection may drop documents with words.

    A source's selection is one point in its order: a row is placed where it is read, by its key, and
    texts are not shuffled. Repeated rows at that point go in together. A row without doc_id goes.
    """
    per, whole, cut, last = _place(docs)
    top = whole.where("whole = 1").groupBy(F.col("source").alias("ts")).agg(F.max("r").alias("top"))
    end = cut.groupBy(F.col("source").alias("es")).agg(F.max("r").alias("end"), F.max(F.when(F.col("in"), F.struct("key", "doc_id"))).alias("point"))
    plan = per.select("source", "epochs", "ranges")
    for other, key in ((top, "ts"), (end, "es"), (last, "ls")):
        plan = plan.join(other, plan["source"].eqNullSafe(other[key]), "left").drop(key)
    plan = durable(plan)  # its size decides whether it is broadcast
    rows = docs.where("doc_id is not null").select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    text = F.col("row.text")
    rows = rows.select("row", F.col("row.doc_id").cast("long").alias("doc_id"), F.col("row.source").cast("string").alias("own"), sort_key(F.col("row.doc_id").cast("long"), quality_weight(text)).alias("key"))
    rows = rows.join(plan, rows["own"].eqNullSafe(plan["source"])).withColumn("r", key_range(F.col("key"), F.col("ranges")))
    inside = (F.col("r") <= F.col("top")) | ((F.col("r") == F.col("end")) & (F.struct("key", "doc_id") <= F.col("point"))) | (F.col("doc_id") == F.col("last"))
    times = F.when(text.cast("string").rlike(rf"[^{WS}]"), F.col("epochs").cast("int") + F.coalesce(inside, F.lit(False)).cast("int")).otherwise(1)
    return rows.withColumn("times", times).where("times > 0").select("row", F.explode(F.array_repeat(F.lit(1), F.col("times")))).select("row.*")


ORACLE = rf"""
WITH d AS (
  SELECT doc_id, source,
    CASE WHEN regexp_matches(coalesce(text, ''), '[^{WS}]') THEN length(regexp_replace(coalesce(text, ''), '[{WS}]*[^{WS}]+[{WS}]*', 'x', 'g')) ELSE 0 END AS size,
    greatest(0.05::DOUBLE, length(regexp_replace(coalesce(text, ''), '[^\p{{L}}]+', '', 'g'))::DOUBLE / greatest(length(coalesce(text, '')), 1)) AS w
  FROM documents WHERE doc_id IS NOT NULL),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
a AS (SELECT *, (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1 AS sw FROM s),
f AS (SELECT *, 3 * source_size AS cap, (SELECT sum(source_size) FROM a) AS total, (SELECT sum(sw) FROM a) AS weights,
    coalesce(sum(3 * source_size) OVER k, 0) AS filled, coalesce(sum(sw) OVER k, 0) AS gone, count(*) OVER k AS nth
  FROM a WINDOW k AS (ORDER BY 3 * source_size::DOUBLE / sw, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT arg_min((total - filled)::DOUBLE / (weights - gone), nth) AS lev FROM f WHERE (total - filled)::DOUBLE / (weights - gone) * sw <= cap),
t AS (SELECT source, source_size, least(cap::DOUBLE, coalesce(lev, 0) * sw) AS target FROM f, l),
e AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM t),
k AS (SELECT d.doc_id, d.size, d.source, source_size, target, epochs, target - epochs * source_size AS budget,
    -ln((('0x' || substr(md5(d.doc_id::VARCHAR), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0) / w AS key
  FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source),
c AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY key, doc_id ROWS UNBOUNDED PRECEDING) AS upto FROM k),
h AS (SELECT source, coalesce(max(upto) FILTER (WHERE upto <= budget), 0) AS have FROM c GROUP BY source),
g AS (SELECT c.doc_id, row_number() OVER (PARTITION BY c.source ORDER BY abs(budget - have - size), key, c.doc_id) AS r, abs(budget - have - size) < budget - have AS ok
  FROM c JOIN h ON c.source IS NOT DISTINCT FROM h.source WHERE upto > budget)
SELECT c.doc_id, size::BIGINT AS size, source_size, target,
  (size * (epochs + CASE WHEN upto <= budget OR g.doc_id IS NOT NULL THEN 1 ELSE 0 END))::BIGINT AS taken
FROM c LEFT JOIN g ON g.doc_id = c.doc_id AND g.r = 1 AND g.ok
"""
