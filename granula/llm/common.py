"""What the corpus operators share: durable tables, word splitting and hashing, bit sets of ids.

A row without ``doc_id`` is not a document: the operators that relate documents to each other
ignore it. Null text counts as empty text everywhere.
"""

from __future__ import annotations

import ctypes
import math
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granula.functions.state import delete, durable, scratch, shared_dir  # noqa: F401  for the operators

#: White space of all word contracts: space and U+0009 to U+000D. As a Java/RE2 character class.
WS = r"\x20\x09-\x0D"
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

U64 = np.uint64
_M1, _M2, _BASE = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB), 0x9E3779B97F4A7C15
_SPAN = 1 << 18


def partitions(df: DataFrame, target_bytes: int = 64 << 20) -> int:
    """Shuffle partitions: the session's number, or more if the input is large."""
    spark = df.sparkSession
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(n, min(200_000, size // target_bytes)) if size < 1 << 60 else n


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> U64(30))) * _M1
    x = (x ^ (x >> U64(27))) * _M2
    return x ^ (x >> U64(31))


class _Powers:
    """Powers of an odd base modulo 2**64 and of its inverse; grown on demand."""

    def __init__(self, base: int):
        self.base, self.up, self.down = base, np.ones(1, U64), np.ones(1, U64)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = 1 << (n - 1).bit_length()
            both = []
            for b in (self.base, pow(self.base, -1, 1 << 64)):
                a = np.full(n, b, U64)
                a[0] = 1
                both.append(np.multiply.accumulate(a))
            self.up, self.down = both
        return self.up, self.down


_POW = _Powers(_BASE)
_SYMBOL = mix(np.arange(1, 257, dtype=U64) * U64(_BASE))


def range_hash(symbols: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Polynomial hash of symbols[a:b] for arrays a, b (b >= a); equal ranges hash alike."""
    up, down = _POW(len(symbols) + 1)
    sums = np.zeros(len(symbols) + 1, U64)
    np.cumsum(symbols * up[: len(symbols)], out=sums[1:])
    return (sums[b] - sums[a]) * down[a]


class Chunk:
    """Some documents' UTF-8 bytes with their words.

    ids: doc_id of each document; first[d]:first[d+1] are document d's words, and word i is
    buf[starts[i]:ends[i]].
    """

    def __init__(self, ids: np.ndarray, buf: np.ndarray, offsets: np.ndarray, lower: bool):
        self.ids, self.buf, self.offsets = ids, (_LOWER[buf] if lower else buf), offsets
        word = ~_SPACE[buf]
        begin, end = word.copy(), word.copy()
        if len(buf):
            begin[1:] &= ~word[:-1]
            end[:-1] &= ~word[1:]
            edges = offsets[(offsets > 0) & (offsets < len(buf))]  # documents abut without a space
            begin[edges] |= word[edges]
            end[edges - 1] |= word[edges - 1]
        self.starts, self.ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
        self.first = np.searchsorted(self.starts, offsets)

    def raw(self, d: int) -> bytes:
        return self.buf[self.offsets[d] : self.offsets[d + 1]].tobytes()

    def hashes(self) -> np.ndarray:
        """64-bit hash of each word."""
        out, g, n = np.empty(len(self.starts), U64), 0, len(self.starts)
        up, down = _POW(_SPAN + 1)
        while g < n:
            at = self.starts[g]
            e = max(int(np.searchsorted(self.ends, at + _SPAN, "right")), g + 1)
            part = self.buf[at : self.ends[e - 1]]
            if len(part) > _SPAN:  # one word longer than a span
                h = 0
                for k in range(0, len(part), _SPAN):
                    v = _SYMBOL[part[k : k + _SPAN]]
                    h += int(np.sum(v * up[: len(v)], dtype=U64)) * pow(_BASE, k, 1 << 64)
                out[g] = U64(h % (1 << 64))
            else:
                sums = np.zeros(len(part) + 1, U64)
                np.cumsum(_SYMBOL[part] * up[: len(part)], out=sums[1:])
                s = self.starts[g:e] - at
                out[g:e] = (sums[self.ends[g:e] - at] - sums[s]) * down[s]
            g = e
        return mix(out ^ (self.ends - self.starts).astype(U64))


@lru_cache(1)
def _libc():
    try:
        return ctypes.CDLL("libc.so.6")
    except OSError:  # another C library: it keeps what it keeps
        return None


#: What a worker keeps from task to task: the operator that it is for, and how it is dropped.
_KEPT: dict[str, Callable[[], None]] = {}


def keep_only(name: str, forget: Callable[[], None] | None = None) -> None:
    """At the start of an operator's task: drops what other operators kept in this worker. forget
    drops what this one keeps. So a worker that serves one after the other holds one's models alone."""
    for other in [x for x in _KEPT if x != name]:
        _KEPT.pop(other)()
    if forget:
        _KEPT[name] = forget


def release() -> None:
    """Gives freed memory back to the system: a worker stays, idle, after its task."""
    pa.default_memory_pool().release_unused()
    if _libc() is not None:
        _libc().malloc_trim(0)


def chunks(batches: Iterator[pa.RecordBatch], lower: bool = False, size: int = 1 << 20, keep=None) -> Iterator[Chunk]:
    """Chunks of about `size` bytes of whole documents from batches of (doc_id, text).

    keep: a mask of the documents to take, made from their ids.
    """
    keep_only("chunks")
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        text = batch.column(1).cast(pa.large_binary())
        if keep is not None:
            mask = keep(ids)
            if not mask.any():
                continue
            ids, text = ids[mask], text.filter(pa.array(mask))
        if text.null_count:
            text = text.fill_null(b"")
        _, offs, data = text.buffers()
        offs = np.frombuffer(offs, np.int64, len(text) + 1, text.offset * 8)
        data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        a = 0
        while a < len(ids):
            b = max(a + 1, int(np.searchsorted(offs, offs[a] + size, "right")) - 1)
            yield Chunk(ids[a:b], data[offs[a] : offs[b]], offs[a : b + 1] - offs[a], lower)
            a = b
    release()


def texts(docs: DataFrame) -> DataFrame:
    """(doc_id, text) of the documents, whatever other columns there are."""
    return docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long"), F.col("text").cast("string"))


#: Bits of an id set: 2 MB, however many ids; with very many ids it only lets more rows through.
ID_BITS = 1 << 24


def id_bits(ids: DataFrame, column: str) -> bytes:
    """A one-hash Bloom filter of a long column, folded to words by Spark before it is fetched."""
    return fold_bits(ids.select(F.pmod(F.xxhash64(F.col(column).cast("long")), F.lit(ID_BITS)).alias("b")))


def fold_bits(places: DataFrame) -> bytes:
    """The set of bits at places (b), each under ID_BITS."""
    words = (
        places.groupBy(F.floor(F.col("b") / 32).alias("w"))
        .agg(F.expr("bit_or(shiftleft(1L, cast(b % 32 as int)))").alias("v"))
        .toPandas()
    )
    out = np.zeros(ID_BITS // 32, np.uint32)
    out[words["w"].to_numpy(np.int64)] = words["v"].to_numpy(np.int64).astype(np.uint32)
    return out.tobytes()


def with_bit(docs: DataFrame, bits) -> DataFrame:
    """Adds the position of each doc_id in an id set as column `bit`."""
    return docs.withColumn("bit", F.pmod(F.xxhash64("doc_id"), F.lit(ID_BITS)))


def only_bits(batches: Iterator[pa.RecordBatch], bits: bytes) -> Iterator[pa.RecordBatch]:
    """Rows of (doc_id, text, bit, ...) whose bit is set."""
    table = np.frombuffer(bits, np.uint32)
    for batch in batches:
        bit = batch.column(2).to_numpy().astype(np.int64)
        hit = (table[bit >> 5] >> (bit & 31).astype(np.uint32)) & 1
        if hit.any():
            yield batch.filter(pa.array(hit.astype(bool)))


#: Bits of the largest id filter of `by_ids`: 4 MB.
FILTER_BITS = 1 << 25


def by_ids(docs: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """docs' rows as (doc_id, row), row being all of docs' columns, in two tables: those whose doc_id
    is surely not among ids, and the others. A row without doc_id is in neither.

    So a few ids can be looked up without a shuffle of all texts. The ids are broadcast as a Bloom
    filter of FILTER_BITS bits at most; with very many ids only more rows are in the second table.
    """
    ids = durable(ids.select(F.col("doc_id").cast("long")).distinct())
    bits = min(FILTER_BITS, pow2(16 * max(4096, ids.count())))
    bit = lambda c: F.pmod(F.xxhash64(c, F.lit(5)), F.lit(bits))
    words = ids.select(bit("doc_id").alias("b")).groupBy(F.expr("b div 64").alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(b % 64 as int)))").alias("v"))
    all_ = docs.sparkSession.range(bits // 64).withColumnRenamed("id", "w").join(words, "w", "left")
    one = durable(all_.agg(F.transform(F.sort_array(F.collect_list(F.struct("w", F.coalesce("v", F.lit(0)).alias("v")))), lambda x: x["v"]).alias("words")))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row")).where("doc_id is not null")
    rows = rows.withColumn("b", bit("doc_id")).crossJoin(F.broadcast(one))
    hit = F.expr("(shiftright(words[cast(b div 64 as int)], cast(b % 64 as int)) & 1) = 1")
    return rows.where(~hit).select("doc_id", "row"), rows.where(hit).select("doc_id", "row")


def without_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """docs without the rows whose doc_id is in ids (doc_id) or null."""
    ids = durable(ids.select(F.col("doc_id").cast("long")).distinct())
    safe, other = by_ids(docs, ids)
    return safe.select("row.*").union(other.join(ids, "doc_id", "left_anti").select("row.*"))


#: Rows of a key up to which they may meet in one task, and most keys that may have more.
HOT_ROWS, HOT_KEYS = 256, 50_000


def hot_rows(total: int) -> int:
    """The rows above which a key of a table of so many rows is hot: at most HOT_KEYS keys are."""
    return max(HOT_ROWS, total // HOT_KEYS)


def join_hot(rows: DataFrame, found: DataFrame, key: str, size: str) -> DataFrame:
    """rows joined with found, which has one row for each key and, as size, its number of rows.

    What found has of hot keys, HOT_KEYS rows at most, is broadcast, so no task gets all rows of one
    key. Both tables are read more than once: they should be durable.
    """
    most = hot_rows(rows.count())
    hot = F.broadcast(found.where(F.col(size) > most))
    cold = rows.join(hot.select(key), key, "left_anti").join(found.where(F.col(size) <= most), key)
    return cold.union(rows.join(hot, key))


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of edges (u, v): root is its component's smallest node.

    Minimum labels with pointer jumping; all by partial aggregation and equi-joins, so that a
    node with very many edges is no hot spot. The state goes to the shared folder every round.
    """
    both = durable(edges.select("u", "v").union(edges.select(F.col("v"), F.col("u"))).distinct())
    labels = durable(both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("m")).select("node", F.least("node", "m").alias("root")))
    while True:
        near = both.join(labels.select(F.col("node").alias("v"), "root"), "v").groupBy(F.col("u").alias("node")).agg(F.min("root").alias("m"))
        step = labels.join(near, "node").select("node", F.col("root").alias("old"), F.least("root", "m").alias("root"))
        up = labels.select(F.col("node").alias("root"), F.col("root").alias("up"))
        new = durable(step.join(up, "root", "left").select("node", "old", F.least("root", F.coalesce("up", "root")).alias("root")))
        if not new.where("old != root").limit(1).count():
            return new.select("node", "root")
        labels = new.select("node", "root")


def pow2(n: float) -> int:
    return 1 << max(0, math.ceil(math.log2(max(1, n))))
