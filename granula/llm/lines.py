"""Line dedup by a suffix array over line ids, built by distributed prefix doubling.

A text's lines are what stands between its line feeds, unchanged. All documents' line ids, document
after document, are one sequence in which no run crosses a document's end. Prefix doubling ranks the
suffixes by their first 1, 2, 4, ... lines: a round counts the pairs (rank, rank of the suffix half a
prefix further), orders the distinct pairs by range partitions and numbers them by partition offsets.
Suffixes whose prefix nobody shares drop out, for all longer prefixes of theirs are unique too, and
doubling goes on until none is left: then the order of all suffixes is known.

The suffixes of one rank at a length are an interval of the suffix array whose longest common prefix
has that length at least. In each interval from MIN_LINES lines on, the first suffix by (doc_id, line)
keeps its lines, and every later one loses its prefix: of a suffix's intervals the deepest in which it
is not the first counts. Together these prefixes are the later copies of all maximal repeated runs, so a
line goes when it lies in a run of MIN_LINES or more lines that also starts earlier, in an earlier
document or further up in its own. Line ids are 64-bit hashes: two different lines of n in all share one
with a chance of about n * n / 2**65.

Counts are summed where the rows are, distinct keys alone are ordered, and keys of over a ten-thousandth
of all rows meet their rows by broadcast (there are at most ten thousand): a very common line is no hot
spot anywhere.

With min_words a run of fewer lines also counts, down to a single one, if it has so many words. Such
a run is the union of its least parts: those that have too few words without their last line, and
those that have too few without their first. So only these, two a line at most, meet by their hash.

Defined cases: null text counts as empty, one empty line; a document with fewer lines than MIN_LINES
loses none; ties in doc_id (repeated rows) are one document whose rows come in the order of their
text's hash; a row without doc_id is ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granula.llm.common import U64, WS, durable, mix, partitions, range_hash

MIN_LINES = 4
#: Words from which a run of fewer lines counts in `op6_line_dedup_words`.
MIN_WORDS = 50


def _positions(docs: DataFrame) -> DataFrame:
    """(doc_id, th, i, n, line): the lines' ids; th tells apart rows of one doc_id."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lines = F.split(text, "\n", -1)
    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), F.xxhash64(text).alias("th"), lines.alias("l")).select("doc_id", "th", F.size("l").alias("n"), F.posexplode("l").alias("i", "x"))
    return rows.select("doc_id", "th", "n", "i", F.xxhash64("x", F.lit(3)).alias("line")).dropDuplicates(["doc_id", "th", "i"])


#: Keys that are broadcast, at most; a key of fewer than MIN_HOT rows is never hot.
HOT_KEYS, MIN_HOT = 10_000, 1_000


def _meet(rows: DataFrame, found: DataFrame, keys: list[str], n: int) -> DataFrame:
    """rows (n of them at most) joined by keys with found (keys, size, ...), size being a key's rows."""
    cut = max(MIN_HOT, n // HOT_KEYS + 1)
    if n < cut:
        return rows.join(found, keys)
    hot = found.where(F.col("size") >= cut)
    cold = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(found.where(F.col("size") < cut), keys)
    return rows.join(F.broadcast(hot), keys).select(cold.columns).union(cold)


def _ranked(rows: DataFrame, keys: list[str], parts: int, n: int | None = None) -> DataFrame:
    """The rows (n at most) whose key others share, with `rank`: the place of the key's first row in the
    order of those. The keys go."""
    rows = durable(rows)
    n = rows.count() if n is None else n
    counts = rows.groupBy(*keys).agg(F.count("*").alias("size")).where("size > 1")
    placed = durable(counts.repartitionByRange(parts, *keys).withColumn("p", F.spark_partition_id()))
    upto = F.sum("m").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, 0)) - F.col("m")
    offset = placed.groupBy("p").agg(F.sum("size").alias("m")).select("p", upto.alias("offset"))
    inside = F.sum("size").over(Window.partitionBy("p").orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    ranks = placed.withColumn("inside", inside).join(F.broadcast(offset), "p").select(*keys, "size", (F.col("offset") + F.col("inside") + 1).alias("rank"))
    return _meet(rows, ranks, keys, n).drop(*keys, "size")


def intervals(docs: DataFrame, min_lines: int = MIN_LINES):
    """(length, suffixes, their number) of each round from min_lines on: the suffixes (doc_id, th, i, rank)
    that share their first `length` lines with others."""
    parts = partitions(docs)
    now = durable(_ranked(_positions(docs).where(F.col("n") >= min_lines).drop("n"), ["line"], parts))
    done = 1
    while n := now.count():
        if done >= min_lines:
            yield done, now, n
        step = min(done, min_lines - done) if done < min_lines else done
        ahead = now.select("doc_id", "th", (F.col("i") - step).alias("i"), F.col("rank").alias("next"))
        now = durable(_ranked(now.join(ahead, ["doc_id", "th", "i"]).withColumnRenamed("rank", "r"), ["r", "next"], parts, n))
        done += step


def repeated(docs: DataFrame, min_lines: int = MIN_LINES) -> DataFrame:
    """(doc_id, th, i, m): the suffixes that go, with their first m lines."""
    out = docs.sparkSession.createDataFrame([], "doc_id long, th long, i int, m int")
    for length, now, n in intervals(docs, min_lines):
        first = now.groupBy("rank").agg(F.min(F.struct("doc_id", "th", "i")).alias("f"), F.count("*").alias("size"))
        late = _meet(now, first, ["rank"], n).where(F.struct("doc_id", "th", "i") != F.col("f"))
        out = out.union(durable(late.select("doc_id", "th", "i", F.lit(length).alias("m"))))
    return out


def _least_parts(min_words: int):
    def run(batches):
        for batch in batches:
            out = []
            ids, th, lines, counts = batch.columns
            for d in range(batch.num_rows):
                line = lines[d].values.to_numpy().view(U64)
                sums = np.concatenate([[0], np.cumsum(counts[d].values.to_numpy().astype(np.int64))])
                if sums[-1] < min_words:
                    continue
                n = len(line)
                a = np.flatnonzero(sums[:-1] + min_words <= sums[-1])  # starts, with their first ends
                b = np.searchsorted(sums, sums[a] + min_words)
                e = np.flatnonzero(sums >= min_words)  # ends, with their last starts
                part = np.unique(np.concatenate([a * (n + 1) + b, (np.searchsorted(sums, sums[e] - min_words, "right") - 1) * (n + 1) + e]))
                a, b = part // (n + 1), part % (n + 1)
                key = mix(range_hash(mix(line), a, b) ^ mix((b - a).astype(U64)))
                out.append(pa.record_batch([pa.array(np.full(len(a), ids[d].as_py())), pa.array(np.full(len(a), th[d].as_py())), pa.array(a.astype(np.int32)), pa.array((b - a).astype(np.int32)), pa.array(key.view(np.int64))], ["doc_id", "th", "i", "m", "key"]))
            yield from out

    return run


def repeated_words(docs: DataFrame, min_words: int) -> DataFrame:
    """(doc_id, th, i, m): the least parts of min_words words that go, m lines from line i."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lines = F.split(text, "\n", -1)
    ids = F.transform("l", lambda x: F.xxhash64(x, F.lit(3)))
    words = F.transform("l", lambda x: F.size(F.regexp_extract_all(x, F.lit(f"[^{WS}]+"), F.lit(0))))
    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), F.xxhash64(text).alias("th"), lines.alias("l")).select("doc_id", "th", ids.alias("ids"), words.alias("words"))
    parts = durable(rows.mapInArrow(_least_parts(min_words), "doc_id long, th long, i int, m int, key long"))
    parts = parts.dropDuplicates(["doc_id", "th", "i", "m"])
    first = parts.groupBy("key").agg(F.min(F.struct("doc_id", "th", "i")).alias("f"), F.count("*").alias("c")).where("c > 1").drop("c")
    return parts.join(first, "key").where(F.struct("doc_id", "th", "i") != F.col("f")).select("doc_id", "th", "i", "m")


def remove(docs: DataFrame, min_lines: int = MIN_LINES, min_words: int | None = None) -> DataFrame:
    """doc_id, n_lines, n_removed, kept: the texts without the later copies of repeated runs."""
    starts = repeated(docs, min_lines)
    if min_words is not None:
        starts = starts.union(repeated_words(docs, min_words))
    # A start covers its lines up to the next start, as far as any start up to it reaches: no line twice.
    starts = starts.groupBy("doc_id", "th", "i").agg(F.max(F.col("i") + F.col("m")).alias("end"))
    order = Window.partitionBy("doc_id", "th").orderBy("i")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, 0))
    starts = starts.select("doc_id", "th", "i", F.least(reach, F.lead("i").over(order)).alias("end"))
    gone = starts.groupBy("doc_id", "th").agg(F.sort_array(F.collect_list(F.struct("i", "end"))).alias("at"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), text.alias("text"), F.xxhash64(text).alias("th"))
    # The lines that go, as one mark each; marks of a whole text make the test of a line cheap.
    rows = rows.join(gone, ["doc_id", "th"], "left").withColumn("l", F.split("text", "\n", -1))
    rows = rows.withColumn("cut", F.expr("flatten(transform(at, a -> sequence(a.i, a.end - 1)))"))
    kept = F.expr("array_join(transform(array_except(sequence(0, size(l) - 1), cut), j -> l[j]), '\n')")
    return rows.select(
        "doc_id", F.size("l").alias("n_lines"), F.coalesce(F.size("cut"), F.lit(0)).alias("n_cut"), F.when(F.col("cut").isNull(), F.col("text")).otherwise(kept).alias("kept")
    ).select("doc_id", F.col("n_lines").cast("long").alias("n_lines"), F.greatest("n_cut", F.lit(0)).cast("long").alias("n_removed"), "kept")


def digests(docs: DataFrame, min_words: int | None = None) -> DataFrame:
    return remove(docs, min_words=min_words).select("doc_id", "n_lines", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE = f"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents WHERE doc_id IS NOT NULL),
x AS (SELECT doc_id, i, l[i:i + {MIN_LINES - 1}] AS w FROM (SELECT doc_id, l, unnest(range(1, len(l) - {MIN_LINES - 2})) AS i FROM d WHERE len(l) >= {MIN_LINES})),
f AS (SELECT doc_id, i, row_number() OVER (PARTITION BY w ORDER BY doc_id, i) AS r FROM x),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + {MIN_LINES})) AS j FROM f WHERE r > 1),
k AS (SELECT doc_id, len(l) AS n, unnest(range(1, len(l) + 1)) AS j, unnest(l) AS x FROM d),
m AS (SELECT k.doc_id, any_value(n) AS n, count(c.j) AS cut, coalesce(string_agg(CASE WHEN c.j IS NULL THEN x END, chr(10) ORDER BY k.j), '') AS kept
  FROM k LEFT JOIN c ON c.doc_id = k.doc_id AND c.j = k.j GROUP BY k.doc_id)
SELECT doc_id, n::BIGINT AS n_lines, cut::BIGINT AS n_removed, sha256(kept) AS kept_sha256 FROM m
"""
