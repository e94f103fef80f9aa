"""Closed frequent itemsets of baskets and their rules, by breadth-first closure extension.

Items are ordered by support, then id, rare ones first. A candidate is a closed set P and one item i
beyond P's core item; its occurrences are the baskets that hold P and i. A level joins the occurrences
of all its candidates to the baskets and counts items. Items that all occurrences of a candidate hold
are absorbed: they make up its closure Q. Q stays if it keeps the prefix, that is, if it has the same
items before i as P; so each closed set comes from one candidate only and no set needs to be looked up.
The counts of the same join are the supports of Q's extensions, which are the next level's candidates.
Every level's tables are written, so a level's plan starts from files.

Long baskets would make the square of their length in pairs. If b of the baskets are set apart and b is
under the least support, an itemset with that support is in some other basket too. So the longest ones
are set apart, fewer than the least support of them: item counts come from the others, those that can
still reach the least support (what lacks is at most the long baskets of the candidate) are looked up in
the long ones, item by item. This is exact whatever the lengths.

Nothing that grows is broadcast or fetched: joins are sort-merge joins; of keys with more than
1 / 512 of the rows, at most 512, the rows are salted, and that list alone is broadcast.

A rule takes one item c from a closed set Q; a is the support of the rest. The closure of the rest lies
between the rest and Q, so it is the rest itself, then in the result, or Q, with Q's support: one join.

Defined cases: rows with a null sale or item are in no basket; a null flag is not `returned`; repeated
lines count once; without baskets or frequent items the result is empty. Other columns do not matter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granula.functions.joins import merge, spread
from granula.functions.state import durable, fresh, scratch

MIN_SUPPORT, PER_BASKETS = 12, 10_000


def baskets_of(lines: DataFrame) -> DataFrame:
    """(sale_id, item_id), each pair once, of the lines that were not returned."""
    kept = lines.where("not (flag <=> 'returned') and sale_id is not null and item_id is not null")
    return kept.select(F.col("sale_id").cast("long"), F.col("item_id").cast("long")).distinct()


def cut_of(sizes: DataFrame, least: int) -> int:
    """A size that fewer than `least` baskets exceed, about the smallest: from counts by sixteenths of octaves."""
    bins = sizes.groupBy(F.floor(F.log2("size") * 16).alias("bin")).agg(F.max("size").alias("top"), F.count("*").alias("n")).orderBy(F.desc("top")).collect()
    above, cut = 0, None
    for b in bins:
        if above >= least:
            break
        above, cut = above + b["n"], b["top"]
    return cut or 0


def closed_itemsets(pairs: DataFrame, least: int, total: int) -> DataFrame:
    """(items array<struct<s, item>>, support) of all closed itemsets with support >= least.

    pairs: durable (sale_id, item_id), each once; total: the number of baskets. s is the item's support.
    """
    items = durable(pairs.groupBy("item_id").agg(F.count("*").alias("s")).where(F.col("s") >= least))
    rows_total = pairs.count()
    rows = durable(spread(pairs, items, ["item_id"], "s", F.col("sale_id"), rows_total).select("sale_id", F.struct("s", F.col("item_id").alias("item")).alias("y")))
    sizes = durable(rows.groupBy("sale_id").agg(F.count("*").alias("size")))
    cut = cut_of(sizes, least)
    rows = durable(spread(rows, sizes, ["sale_id"], "size", F.col("y.item"), rows_total))
    small = durable(rows.where(F.col("size") <= cut).groupBy("sale_id").agg(F.sort_array(F.collect_list("y")).alias("items")))
    big = durable(rows.where(F.col("size") > cut).select("sale_id", "y"))

    everywhere = [r["item_id"] for r in items.where(F.col("s") == total).orderBy("item_id").limit(10_001).collect()] if total else []
    if len(everywhere) > 10_000:
        raise ValueError("over 10,000 items are in every basket")
    root = F.array(*(F.struct(F.lit(total).cast("long").alias("s"), F.lit(x).cast("long").alias("item")) for x in everywhere)).cast("array<struct<s:bigint,item:bigint>>")
    out = [items.where(F.col("s") == total).limit(1).select(root.alias("items"), F.col("s").alias("support"))] if everywhere else []

    # Level 1: the items themselves; a candidate's id is its item.
    in_big = big.groupBy(F.col("y.item").alias("cid")).agg(F.count("*").alias("sup_big"))
    first = items.where(F.col("s") < total).select(F.col("item_id").alias("cid"), F.struct("s", F.col("item_id").alias("item")).alias("core"), F.col("s").alias("sup"))
    cand = durable(merge(first, in_big, "cid", "left").select("cid", root.alias("parent"), "core", "sup", F.coalesce("sup_big", F.lit(0).cast("long")).alias("sup_big")))
    one = lambda t: t.where(F.col("y.s") < total).select("sale_id", F.col("y.item").alias("cid"), F.col("y.s").alias("sup"))
    occ_big = one(big).select("sale_id", "cid")
    # The occurrences of single items are the baskets' own rows: there the join is with the row itself.
    held = small.select("sale_id", "items", F.explode("items").alias("y")).where(F.col("y.s") < total).select("sale_id", "items", F.col("y.item").alias("cid"), F.col("y.s").alias("sup"))

    while True:
        # Items that are rarer than the candidate cannot be absorbed, and are before its core.
        joined = held.select("cid", "sale_id", "sup", F.explode(F.expr("filter(items, y -> y.s >= sup)")).alias("y"))
        counts = joined.groupBy("cid", "y").agg(F.count("*").alias("n"))
        counts = durable(merge(counts, cand.select("cid", "core", "sup", "sup_big"), "cid").where(F.col("n") + F.col("sup_big") >= least).where((F.col("y") > F.col("core")) | (F.col("n") + F.col("sup_big") >= F.col("sup"))))
        asked = merge(counts.where("sup_big > 0").select("cid", "y"), occ_big, "cid")
        more = merge(asked, big, ["sale_id", "y"]).groupBy("cid", "y").agg(F.count("*").alias("n_big"))
        tops = merge(counts, more, ["cid", "y"], "left").withColumn("n_big", F.coalesce("n_big", F.lit(0).cast("long"))).withColumn("total", F.col("n") + F.col("n_big"))
        tops = durable(tops.where(F.col("total") >= least))

        full = tops.where("total = sup").groupBy("cid").agg(F.sort_array(F.collect_list("y")).alias("items"))
        kept = merge(full, cand, "cid").where("size(array_except(filter(items, y -> y < core), parent)) = 0")
        kept = durable(kept.select("cid", "items", "sup"))
        out.append(kept.select("items", F.col("sup").alias("support")))

        grown = merge(tops.where("total < sup and y > core"), kept.select("cid", "items"), "cid")
        grown = durable(grown.select("cid", F.col("items").alias("parent"), "y", "n", "n_big", "total").withColumn("new", F.monotonically_increasing_id()))
        size = grown.agg(F.count("*").alias("c"), F.sum("n").alias("n")).first()
        if not size["c"]:
            break
        onward = spread(joined.drop("sup"), grown.select("cid", "y", "n", "new", "total"), ["cid", "y"], "n", F.col("sale_id"), size["n"])
        occ = durable(onward.select("sale_id", F.col("new").alias("cid"), F.col("total").alias("sup")))
        asked = merge(grown.where("n_big > 0").select("cid", "y", "new"), occ_big, "cid")
        held = merge(occ, small, "sale_id")
        occ_big = durable(merge(asked, big, ["sale_id", "y"]).select("sale_id", F.col("new").alias("cid")))
        cand = grown.select(F.col("new").alias("cid"), "parent", F.col("y").alias("core"), F.col("total").alias("sup"), F.col("n_big").alias("sup_big"))
    got = out[0]
    for t in out[1:]:
        got = got.union(t)
    return got


def with_rules(closed: DataFrame, total: int) -> DataFrame:
    """The contract's columns of (items array<struct<s, item>>, support)."""
    ids = lambda a: F.concat_ws(",", F.transform(F.array_sort(F.transform(a, lambda y: y["item"])), lambda i: i.cast("string")))
    sets = durable(closed.select(ids(F.col("items")).alias("items"), F.col("items").alias("ys"), "support"))
    taken = sets.where(F.size("ys") > 1).select(F.col("items").alias("of"), "support", F.explode("ys").alias("c"), "ys")
    taken = taken.select("of", "support", "c", ids(F.array_except("ys", F.array("c"))).alias("items"))
    rest = merge(taken, sets.select("items", F.col("support").alias("a")), "items", "left")
    rest = rest.select("of", "support", F.col("c.item").alias("c"), F.coalesce("a", "support").alias("a"), F.col("c.s").alias("s"))
    rules = rest.where(f"100 * support >= 30 * a and support * {total}L > a * s").groupBy(F.col("of").alias("items")).agg(F.sort_array(F.collect_list(F.struct("c", "a", "s"))).alias("r"))
    got = merge(sets, rules, "items", "left").withColumn("r", F.expr("coalesce(r, array())"))
    text = F.array_join(F.transform("r", lambda x: F.concat_ws(":", x["c"], x["a"], x["s"])), ";")
    return got.select(
        "items", F.size("ys").cast("long").alias("n_items"), "support", F.size("r").cast("long").alias("n_rules"),
        F.expr("array_min(transform(r, x -> struct(x.a as a, x.c as c))).c").alias("best_item"), F.sha2(text, 256).alias("rules_sha256"),
    )


def itemsets(lines: DataFrame) -> DataFrame:
    """items, n_items, support, n_rules, best_item, rules_sha256: see the module's text."""
    spark = lines.sparkSession
    path = fresh(spark)
    with scratch(spark):
        pairs = durable(baskets_of(lines))
        total = pairs.select("sale_id").distinct().count()
        least = max(MIN_SUPPORT, -(-total // PER_BASKETS))
        with_rules(closed_itemsets(pairs, least, total), total).write.parquet(path)
    return spark.read.parquet(path)


#: All frequent itemsets level by level, then those without an equally frequent set of one item more.
ORACLE = """
WITH RECURSIVE b AS (SELECT DISTINCT sale_id, item_id FROM sale_lines WHERE flag IS DISTINCT FROM 'returned' AND sale_id IS NOT NULL AND item_id IS NOT NULL),
t AS (SELECT count(DISTINCT sale_id) AS total FROM b),
s AS (SELECT item_id, count(*) AS s FROM b GROUP BY item_id HAVING count(*) >= 12 AND count(*) * 10000 >= (SELECT total FROM t)),
f AS (SELECT sale_id, item_id FROM b JOIN s USING (item_id)),
o AS (SELECT [item_id] AS x, sale_id FROM f
  UNION ALL SELECT x, sale_id FROM (SELECT list_append(o.x, f.item_id) AS x, f.sale_id, count(*) OVER (PARTITION BY o.x, f.item_id) AS n FROM o JOIN f ON f.sale_id = o.sale_id AND f.item_id > o.x[-1])
  WHERE n >= 12 AND n * 10000 >= (SELECT total FROM t)),
a AS (SELECT x, count(*) AS n FROM o GROUP BY x),
r AS (SELECT x, n, c, [i FOR i IN x IF i <> c] AS rest FROM (SELECT x, n, unnest(x) AS c FROM a WHERE len(x) > 1)),
q AS (SELECT r.x, r.n, r.c, r.rest, a.n AS a, s.s FROM r JOIN a ON a.x = r.rest JOIN s ON s.item_id = r.c),
k AS (SELECT x, n FROM a WHERE x NOT IN (SELECT rest FROM q WHERE a = n)),
g AS (SELECT x, count(*) AS m, arg_min(c, (a, c)) AS best, string_agg(c || ':' || a || ':' || s, ';' ORDER BY c) AS txt FROM q WHERE 100 * n >= 30 * a AND n * (SELECT total FROM t) > a * s GROUP BY x)
SELECT array_to_string(k.x, ',') AS items, len(k.x)::BIGINT AS n_items, k.n::BIGINT AS support, coalesce(m, 0)::BIGINT AS n_rules, best AS best_item, sha256(coalesce(txt, '')) AS rules_sha256
FROM k LEFT JOIN g ON g.x = k.x
"""
