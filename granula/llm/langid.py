"""Language ID: multinomial naive Bayes over hashed character n-grams.

A text is lower-cased code points, with everything that is not a letter as a space. Its features
are the 1- to 3-grams (no n-gram that is spaces alone), hashed to 2**15 buckets. The model is one
matrix of log probabilities, buckets by languages, broadcast to the workers; a batch of texts is a
sparse matrix in row form (rows: documents, columns: buckets, each occurrence an entry), and scoring
is its product with the model: gathered rows, summed per document.

The model is fitted on a bounded sample of the labelled rows: SAMPLE documents of each language
(expected number; all, if there are fewer), chosen by a hash of doc_id. Every text is then scored
whole. At most MAX_LANGS languages, else it raises: that bounds the matrix.

Defined cases: null text, empty text or text without a letter is `und` with score 0; ties go to the
smaller language name; without any labelled row every text is `und`; null lang is not learned;
repeated rows each get a result; other columns are not read.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granula.llm.common import U64, keep_only, mix, release

BUCKETS = 1 << 15
SAMPLE = 2000
MAX_LANGS = 500
SMOOTHING = 0.5
#: Letters have smaller code points than this.
_TOP = 0x32400
#: Code points of a text that are turned to n-grams at a time, and n-grams that are scored together.
_PART, _TOGETHER = 1 << 18, 1 << 18
_SALT = [U64(0x9E3779B97F4A7C15 * (2 * i + 1) & (1 << 64) - 1) for i in range(4)]


@lru_cache(1)
def _fold() -> np.ndarray:
    """The lower-case letter of each code point that is a letter, else 0."""
    out = np.zeros(_TOP + 1, np.uint32)
    for c in range(_TOP):
        x = chr(c)
        if x.isalpha():
            y = x.lower()
            out[c] = ord(y) if len(y) == 1 else c
    return out


def _buckets(tail: np.ndarray, new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams that end in new letters, which stand after tail; and the new tail."""
    t, x = len(tail), np.concatenate([tail, new])
    keep = np.ones(len(x), bool)
    keep[t:] = (x[t:] > 0) | (x[t - 1 : -1] > 0)  # one space between words
    x = x[keep]
    last, x = x[-2:], x.astype(U64)
    one = x * _SALT[0]
    two = one[:-1] + x[1:] * _SALT[1]
    three = two[:-1] + x[2:] * _SALT[2]
    found = [one[t:][x[t:] > 0], two[t - 1 :][(x[t - 1 : -1] > 0) | (x[t:] > 0)], three[max(t - 2, 0) :][x[max(t - 2, 0) + 1 : -1] > 0]]
    return (mix(np.concatenate([g + _SALT[3] * U64(n) for n, g in enumerate(found)])) & U64(BUCKETS - 1)).astype(np.int32), last


def _parts(text: str):
    """Buckets of all n-grams of a text, which has a space at either end, part by part."""
    tail = np.zeros(1, np.uint32)
    for a in range(0, len(text), _PART):
        points = np.frombuffer(text[a : a + _PART].encode("utf-32-le", "surrogatepass"), np.uint32)
        new = _fold()[np.minimum(points, _TOP)]
        if a + _PART >= len(text):
            new = np.append(new, np.uint32(0))
        found, tail = _buckets(tail, new)
        yield found


def held_out() -> F.Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1


def _count(batches):
    """(lang, bucket, n) of this task's share of the sample."""
    keep_only("langid")
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        for text, lang in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
            counts = sums.setdefault(lang, np.zeros(BUCKETS, np.int64))
            for part in _parts(text.as_py()):
                counts += np.bincount(part, minlength=BUCKETS)
    for lang, counts in sums.items():
        at = np.flatnonzero(counts)
        yield pa.record_batch([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(counts[at])], ["lang", "bucket", "n"])


def fit(docs: DataFrame, train: F.Column, sample: int = SAMPLE) -> tuple[list[str], np.ndarray]:
    """(languages, log probabilities [bucket, language]) from the labelled rows that `train` admits."""
    rows = docs.where(train & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy("lang").limit(MAX_LANGS + 1).collect()}
    if len(sizes) > MAX_LANGS:
        raise ValueError(f"over {MAX_LANGS} languages")
    langs = sorted(sizes)
    if not langs:
        return [], np.zeros((BUCKETS, 0), np.float32)
    share = F.create_map(*(F.lit(x) for lang in langs for x in (lang, min(1.0, sample / sizes[lang]))))
    chosen = rows.where((F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 30)) / F.lit(1 << 30)) < share[F.col("lang")])
    found = chosen.select("text", "lang").mapInArrow(_count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros((BUCKETS, len(langs)))
    counts[found["bucket"].to_numpy(), found["lang"].map({x: i for i, x in enumerate(langs)}).to_numpy()] = found["n"].to_numpy()
    counts += SMOOTHING
    return langs, np.log(counts / counts.sum(axis=0)).astype(np.float32)


def _score(langs: list[str], model):
    def run(batches):
        keep_only("langid")
        weights = model.value
        for batch in batches:
            text = batch.column(1)
            total, grams, letters = np.zeros((len(text), len(langs))), np.zeros(len(text)), np.zeros(len(text), bool)
            held, rows, size = [], [], 0

            def flush():
                if rows:
                    at = np.concatenate(held)
                    cuts = np.cumsum([0, *(len(h) for h in held[:-1])])
                    np.add.at(total, rows, np.add.reduceat(weights[at], cuts, axis=0, dtype=np.float64))
                    held.clear()
                    rows.clear()

            for i, value in enumerate(text):
                for part in _parts(value.as_py() or ""):
                    if len(part):
                        held.append(part)
                        rows.append(i)
                        grams[i] += len(part)
                        letters[i] = True
                        size += len(part)
                    if size > _TOGETHER:
                        flush()
                        size = 0
            flush()
            if langs:
                best = total.argmax(axis=1)
                with np.errstate(over="ignore"):
                    score = 1 / np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
                pred = [langs[b] if ok else "und" for b, ok in zip(best, letters, strict=True)]
            else:
                score, pred, letters = np.zeros(len(text)), ["und"] * len(text), np.zeros(len(text), bool)
            yield pa.record_batch([batch.column(0), pa.array(pred, pa.string()), pa.array(np.where(letters, score, 0.0))], ["doc_id", "lang_pred", "score"])
        release()

    return run


# The posterior of the whole text under the bag-of-n-grams model nears 0 and 1 fast: documents of
# one language get scores of almost 1, mixed or foreign ones may get less.
def predict(docs: DataFrame, model: tuple[list[str], np.ndarray]) -> DataFrame:
    """Per row: doc_id, lang_pred, score (posterior probability of lang_pred)."""
    langs, weights = model
    shared = docs.sparkSession.sparkContext.broadcast(weights)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(_score(langs, shared), "doc_id long, lang_pred string, score double")


def identify(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score; learned from the rows that are not held out."""
    found = predict(docs, fit(docs, ~held_out()))
    return found.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score")


def keep_known(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """The documents whose language is found with at least this score; docs' columns. Rows are judged
    one by one where they are read, without a shuffle; a row without doc_id goes."""
    langs, weights = fit(docs, ~held_out())
    shared, names = docs.sparkSession.sparkContext.broadcast(weights), [c.lower() for c in docs.columns]
    at, text = names.index("doc_id"), names.index("text")
    judge = _score(langs, shared)

    def run(batches):
        for batch in batches:
            pair = pa.record_batch([batch.column(at), batch.column(text).cast(pa.string())], ["doc_id", "text"])
            for found in judge([pair]):
                ok = np.array([x != "und" for x in found.column(1).to_pylist()], bool) & (found.column(2).to_numpy() >= least)
                yield batch.filter(pa.array(ok))

    return docs.where("doc_id is not null").mapInArrow(run, docs.schema)
