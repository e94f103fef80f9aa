"""Quality: a sparse ensemble of rules over statistics of a text.

Every text is read once, in Arrow batches, for its STATISTICS (shares of kinds of characters, shapes of
words, repetition, lines). A forest of shallow trees is grown on labelled rows; every path from a root to
a node is a rule, a conjunction of bounds on statistics. Equal rules are one. A logistic regression with
a lasso penalty weighs the rules, most get weight 0. The others are compiled into Spark column
expressions, so scoring is a projection of the table of statistics.

Bounds: the fit uses at most about SAMPLE labelled rows, chosen by a hash of doc_id; statistics and
scores cover all rows and whole texts. The model is at most TREES * 2 ** (DEPTH + 1) rules.

Defined cases: null or empty text has statistics 0 and a score; labels that are null, or whose doc_id is
null or unknown, are not used; a document with contradicting label rows counts once as of low quality;
without labelled rows the score is 0.5, with labels of one kind it is that label; repeated rows each get
a result, rows without doc_id too (they are never learned from). Other columns do not matter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granula.functions.state import durable
from granula.llm.common import U64, Chunk, chunks, mix

SAMPLE, TREES, DEPTH, LASSO = 50_000, 24, 3, 0.001

#: Kinds of bytes: a row of flags for each.
_BYTE = np.arange(256)
_UPPER = (_BYTE >= 65) & (_BYTE <= 90)
_LETTER = _UPPER | ((_BYTE >= 97) & (_BYTE <= 122)) | (_BYTE >= 128)
_DIGIT = (_BYTE >= 48) & (_BYTE <= 57)
_SPACE = (_BYTE == 32) | ((_BYTE >= 9) & (_BYTE <= 13))
_STOP = np.isin(_BYTE, list(b".!?"))
_PUNCT = np.isin(_BYTE, list(b".,;:!?'\"()-"))
_SIGN = (_BYTE > 32) & (_BYTE < 127) & ~_LETTER & ~_DIGIT & ~_PUNCT
_CONTROL = ((_BYTE < 32) | (_BYTE == 127)) & ~_SPACE
_HEAD = (_BYTE & 0xC0) != 0x80
_KINDS = np.stack([_HEAD, _LETTER, _UPPER, _DIGIT, _SPACE, _PUNCT, _SIGN, _CONTROL, _STOP, _BYTE == 44, _BYTE == 10, _BYTE >= 128], axis=1).astype(float)

STATISTICS = (
    "chars", "words", "word_chars", "longest_word", "letters", "upper", "digits", "spaces", "punct", "signs", "controls", "high_bytes", "entropy",
    "stops_a_word", "commas_a_word", "words_a_line", "sign_words", "sign_ends", "caps_words", "digit_words", "short_words",
    "distinct_words", "top_word", "echoed_words", "repeated_pairs", "repeated_fives",
)


def _distinct(doc: np.ndarray, keys: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each of n documents: its number of distinct keys, and how often its most frequent key occurs."""
    if not len(keys):
        return np.zeros(n), np.zeros(n)
    order = np.lexsort((keys, doc))
    d, k = doc[order], keys[order]
    at = np.flatnonzero(np.concatenate(([True], (d[1:] != d[:-1]) | (k[1:] != k[:-1]))))
    runs, most = np.diff(np.append(at, len(k))), np.zeros(n)
    np.maximum.at(most, d[at], runs)
    return np.bincount(d[at], minlength=n).astype(float), most


def statistics(c: Chunk) -> np.ndarray:
    """One row of STATISTICS for each document of c."""
    n, sizes = len(c.ids), np.diff(c.offsets)
    of_byte = np.repeat(np.arange(n), sizes)
    hist = np.bincount(of_byte * 256 + c.buf, minlength=n * 256).reshape(n, 256).astype(float)
    chars, letters, upper, digits, spaces, punct, signs, controls, stops, commas, breaks, high = (hist @ _KINDS).T
    words = np.diff(c.first).astype(float)
    doc = np.repeat(np.arange(n), np.diff(c.first))
    per = lambda a, b: np.divide(a, b, out=np.zeros(n), where=b > 0)
    total = hist.sum(axis=1, keepdims=True)
    share = np.divide(hist, total, out=np.zeros_like(hist), where=total > 0)
    entropy = -np.sum(share * np.log2(np.where(share > 0, share, 1)), axis=1)

    def inside(flags: np.ndarray) -> np.ndarray:
        """For each word, its bytes that have the flag."""
        sums = np.concatenate(([0], np.cumsum(flags[c.buf])))
        return sums[c.ends] - sums[c.starts]

    each = lambda word_flags: per(np.bincount(doc, weights=word_flags, minlength=n), words)
    length, letter = inside(_HEAD), inside(_LETTER)
    longest = np.zeros(n)
    np.maximum.at(longest, doc, length)
    h = c.hashes()
    distinct, top = _distinct(doc, h, n)

    def repeated(width: int) -> np.ndarray:
        """The share of runs of `width` words that occurred before in the document."""
        if len(h) < width:
            return np.zeros(n)
        runs, owner = h[: len(h) - width + 1].copy(), doc[: len(h) - width + 1]
        for i in range(1, width):
            runs = mix(runs * U64(0x9E3779B97F4A7C15) + h[i : len(h) - width + 1 + i])
        whole = owner == doc[width - 1 :]
        count = np.bincount(owner[whole], minlength=n).astype(float)
        return per(count - _distinct(owner[whole], runs[whole], n)[0], count)

    echo = np.zeros(len(h), bool)
    echo[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    last = _SIGN[c.buf[c.ends - 1]] | np.isin(c.buf[c.ends - 1], list(b"!?")) if len(h) else echo
    return np.stack([
        chars, words, each(length), longest, per(letters, total[:, 0]), per(upper, letters), per(digits, chars), per(spaces, chars), per(punct, chars), per(signs, chars), per(controls, chars), per(high, total[:, 0]), entropy,
        per(stops, words), per(commas, words), per(words, breaks + 1), each(inside(_SIGN) > 0), each(last), each((letter > 1) & (inside(_UPPER) + inside(_BYTE >= 128) == letter) & (inside(_UPPER) > 0)), each(inside(_DIGIT) > 0), each(length == 1),
        per(distinct, words), per(top, words), each(echo), repeated(2), repeated(5),
    ], axis=1)


def describe(docs: DataFrame) -> DataFrame:
    """doc_id and the STATISTICS of each row's text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = pa.record_batch([pa.array(np.arange(batch.num_rows)), batch.column(1)], ["i", "text"])
            for c in chunks(iter([rows])):
                got = statistics(c)
                yield pa.record_batch([batch.column(0).slice(int(c.ids[0]), len(c.ids)), *(pa.array(got[:, j]) for j in range(len(STATISTICS)))], ["doc_id", *STATISTICS])

    schema = "doc_id long, " + ", ".join(f"{s} double" for s in STATISTICS)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, schema)


#: A rule: bounds (statistic, low, high), each meaning low < value <= high.
Rule = tuple[tuple[str, float, float], ...]


class Ensemble(NamedTuple):
    base: float  # the score's logit without any rule
    rules: tuple[tuple[Rule, float], ...] = ()

    def logit(self) -> Column:
        out = F.lit(self.base)
        for rule, weight in self.rules:
            out = out + F.when(holds(rule), weight).otherwise(0.0)
        return out

    def score(self) -> Column:
        return 1 / (1 + F.exp(-self.logit()))


def holds(rule: Rule) -> Column:
    """The rule as a condition on the table of statistics."""
    parts = [c for name, low, high in rule for c in ([F.col(name) > low] * (low > -math.inf) + [F.col(name) <= high] * (high < math.inf))]
    out = parts[0]
    for c in parts[1:]:
        out = out & c
    return out


def paths(tree) -> Iterator[Rule]:
    """The rules of a fitted tree: one for each node but the root."""

    def walk(node, bounds: dict[str, tuple[float, float]]) -> Iterator[Rule]:
        if bounds:
            yield tuple((name, *bounds[name]) for name in sorted(bounds))
        if node.subtreeDepth() == 0:
            return
        split = node.split()
        name, cut = STATISTICS[split.featureIndex()], float(split.threshold())
        low, high = bounds.get(name, (-math.inf, math.inf))
        yield from walk(node.leftChild(), {**bounds, name: (low, min(high, cut))})
        yield from walk(node.rightChild(), {**bounds, name: (max(low, cut), high)})

    return walk(tree._call_java("rootNode"), {})


def fit(stats: DataFrame, labels: DataFrame, train: Column, sample: int = SAMPLE) -> Ensemble:
    """The rules and weights from the label rows that train admits; stats is a durable table."""
    from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import array_to_vector

    known = labels.where(train & F.col("quality").isNotNull() & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.min("quality").cast("double").alias("label"))
    n = known.count()
    chosen = known.where((F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 30)) / F.lit(1 << 30)) < min(1.0, sample / max(1, n)))
    rows = durable(stats.join(F.broadcast(chosen), "doc_id"))
    seen = rows.agg(F.count("*").alias("n"), F.avg("label").alias("share")).first()
    if not seen["n"]:
        return Ensemble(0.0)
    if seen["share"] in (0.0, 1.0):
        return Ensemble(40.0 if seen["share"] else -40.0)
    table = VectorAssembler(inputCols=list(STATISTICS), outputCol="features").transform(rows).select("features", "label", *STATISTICS)
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, maxBins=64, minInstancesPerNode=5, bootstrap=False, subsamplingRate=1.0, featureSubsetStrategy="onethird", seed=42).fit(table)
    rules = sorted({rule for tree in forest.trees for rule in paths(tree)})
    if not rules:
        return Ensemble(math.log(seen["share"] / (1 - seen["share"])))
    flags = rows.select("label", array_to_vector(F.array(*(holds(r).cast("double") for r in rules))).alias("features"))
    model = LogisticRegression(elasticNetParam=1.0, regParam=LASSO, maxIter=60, tol=1e-5, standardization=False).fit(durable(flags))
    return Ensemble(float(model.intercept), tuple((r, float(w)) for r, w in zip(rules, model.coefficients.toArray(), strict=True) if w))


def held_out() -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2


def judge(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted; learned from the rows that are not held out."""
    stats = durable(describe(docs))
    model = fit(stats, labels, ~held_out())
    found = stats.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), model.score().alias("score"))
    return found.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
