"""Exact top-k search by inner product with block-max pruning.

Vectors are integers: floor(256 * x) of each component. Candidates lie in blocks of document ranges;
a block keeps its forward index (the vectors) and each component's maximum and minimum. For a query
a block's bound is the sum over the components of the largest product that the block can reach.
A batch of queries walks the blocks in the order of their bounds, a block at a time through its
forward index, and a query leaves off when the next bound is below its k-th score.

A first pass scores every query against the same few vectors; their k-th score is a floor that no task
need go below. Then queries are sent to all tasks in batches of QUERIES at most, a fixed size, one job
over the blocks for each batch, whose result is written, so that neither the plan nor what is sent at
once grows with the queries. Each task returns at most k rows per query from its share of the blocks,
none below the floor, and a window over the query keeps k.

Defined cases: a null vector or one with a null, NaN or infinite component takes no part, neither
does a null vec_id; a vector shorter than the longest counts as 0 in the missing components; of
rows with the same vec_id each is a candidate for other queries, and a query's own id is never its
candidate; ties go to the smaller vec_id; fewer candidates than k give fewer rows; an empty table
gives an empty result; other columns are not read. Scores are whole numbers held as doubles: where they
could reach 2**53 the search raises.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from granula.functions.state import fresh
from granula.llm.common import durable

#: Rows of a block, queries sent at once and taken through the blocks at once, vectors of the first pass.
BLOCK, QUERIES, SLICE, FIRST = 512, 1 << 16, 4096, 2048
#: Blocks that a task holds and orders at a time.
HELD = 32


def vectors(embeddings: DataFrame) -> DataFrame:
    """(vec_id, v array<long>) of the rows that take part."""
    v = F.transform("embedding", lambda x: F.floor(F.lit(256.0) * x.cast("double")))
    good = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & ~F.exists("embedding", lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == float("inf")))
    return embeddings.where(F.coalesce(good, F.lit(False))).select(F.col("vec_id").cast("long"), v.alias("v"))


def _matrix(column, dims: int) -> np.ndarray:
    """Rows of an array column as a matrix of doubles (whole numbers, exact up to 2**53)."""
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), dims))
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if len(flat) and (lengths == dims).all():
        return flat.reshape(-1, dims).astype(np.float64)
    out[np.arange(dims) < lengths[:, None]] = flat
    return out


def _blocks(batches, dims: int):
    """(ids, forward index, maxima, minima) of up to BLOCK vectors of a range of ids."""
    for batch in batches:
        ids = batch.column(0).to_numpy()
        order = np.argsort(ids, kind="stable")
        matrix = _matrix(batch.column(1), dims)
        for a in range(0, len(ids), BLOCK):
            at = order[a : a + BLOCK]
            m = matrix[at]
            yield ids[at], m, m.max(axis=0), m.min(axis=0)


class _Best:
    """The k best of each query so far, by score, then smaller id."""

    def __init__(self, n: int, k: int):
        self.score, self.ids = np.full((n, k), -np.inf), np.full((n, k), np.iinfo(np.int64).max)
        self.k = k

    def add(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        if scores.shape[1] > self.k:  # everything that reaches the k-th score, ties too
            kth = -np.partition(-scores, self.k - 1, axis=1)[:, self.k - 1 : self.k]
            width = int((scores >= kth).sum(axis=1).max())
            at = np.argpartition(-scores, width - 1, axis=1)[:, :width]
            scores, ids = np.take_along_axis(scores, at, 1), ids[at]
        else:
            ids = np.broadcast_to(ids, scores.shape)
        scores, ids = np.concatenate([self.score[rows], scores], axis=1), np.concatenate([self.ids[rows], ids], axis=1)
        order = np.lexsort((ids, -scores))[:, : self.k]
        self.score[rows], self.ids[rows] = np.take_along_axis(scores, order, 1), np.take_along_axis(ids, order, 1)


class _Slice:
    """Some queries on their way through a task's blocks."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, floor: np.ndarray, k: int):
        self.ids, self.q, self.floor = ids, q, floor
        self.plus, self.minus = np.maximum(q, 0), np.minimum(q, 0)
        self.best = _Best(len(ids), k)

    def walk(self, held: list) -> None:
        bound = self.plus @ np.array([b[2] for b in held]).T + self.minus @ np.array([b[3] for b in held]).T
        order = np.argsort(-bound, axis=1, kind="stable")
        live = np.arange(len(self.ids))
        for step in range(len(held)):
            nxt = order[live, step]
            go = bound[live, nxt] >= np.maximum(self.best.score[live, -1], self.floor[live])  # at an equal bound a smaller id may win
            live, nxt = live[go], nxt[go]
            for b in np.unique(nxt):
                rows = live[nxt == b]
                ids, m = held[b][:2]
                scores = self.q[rows] @ m.T
                scores[self.ids[rows, None] == ids[None, :]] = -np.inf
                self.best.add(rows, scores, ids)

    def found(self) -> pa.RecordBatch:
        row, col = np.nonzero(np.isfinite(self.best.score) & (self.best.score >= self.floor[:, None]))
        score = self.best.score[row, col].astype(np.int64)
        return pa.record_batch([pa.array(self.ids[row]), pa.array(self.best.ids[row, col]), pa.array(score)], ["query_id", "vec_id", "score"])


def _search(queries, k: int):
    def run(batches):
        ids, q, floor = queries.value
        slices = [_Slice(ids[a : a + SLICE], q[a : a + SLICE], floor[a : a + SLICE], k) for a in range(0, len(ids), SLICE)]
        held = []
        for block in _blocks(batches, q.shape[1]):
            held.append(block)
            if len(held) >= HELD:
                for s in slices:
                    s.walk(held)
                held.clear()
        for s in slices:
            if held:
                s.walk(held)
            yield s.found()

    return run


def _floors(first, k: int):
    """Rows (vec_id, v) with the k-th score among the first vectors, their own id aside."""

    def run(batches):
        ids, m = first.value
        for batch in batches:
            qids, q = batch.column(0).to_numpy(), _matrix(batch.column(1), m.shape[1])
            floor = np.full(len(qids), -np.inf)
            for a in range(0, len(qids) if len(ids) >= k else 0, SLICE):
                scores = q[a : a + SLICE] @ m.T
                scores[qids[a : a + SLICE, None] == ids[None, :]] = -np.inf
                floor[a : a + SLICE] = -np.partition(-scores, k - 1, axis=1)[:, k - 1]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(floor)], ["vec_id", "v", "floor"])

    return run


_FOUND = "query_id long, rank int, vec_id long, score long"


def search(base: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: the k best of base for each vec_id of queries (both from `vectors`).

    Rows are searched as rows; what the rows of one vec_id find is ranked together, a row that is
    there twice counting twice."""
    spark = base.sparkSession
    base = durable(base)
    size = base.agg(F.max(F.size("v")).alias("dims"), F.max(F.array_max(F.transform("v", lambda x: F.abs(x.cast("double"))))).alias("top")).first()
    dims, top = size.dims or 0, size.top or 0.0
    if dims * top * top >= 1 << 53:
        raise ValueError(f"components up to {top:.0f} in {dims} dimensions: products are whole only below 2**53")
    if not dims:
        return spark.createDataFrame([], _FOUND)

    def sent(rows: DataFrame, *more: str):
        got = rows.toArrow()
        column = lambda c: got.column(c).combine_chunks()
        return spark.sparkContext.broadcast((column("vec_id").to_numpy(), _matrix(column("v"), dims), *(column(c).to_numpy() for c in more)))

    # Of equal rows k can be among the k best. Different rows of one id may go in different batches.
    times = queries.groupBy("vec_id", "v").agg(F.count("*").cast("int").alias("times")).withColumn("th", F.explode(F.sequence(F.lit(1), F.least("times", F.lit(k)))))
    queries = durable(times.select("vec_id", "v").mapInArrow(_floors(sent(base.limit(FIRST)), k), "vec_id long, v array<long>, floor double"))
    batches = -(-2 * queries.count() // QUERIES)  # half full on average: by a hash, so none is over QUERIES
    if not batches:
        return spark.createDataFrame([], _FOUND)
    by, path = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"), fresh(spark)
    best = lambda found: found.withColumn("rank", F.row_number().over(by).cast("int")).where(F.col("rank") <= k)
    for i in range(batches):
        shared = sent(queries.where(F.pmod(F.xxhash64("vec_id", "v"), F.lit(batches)) == i), "floor")
        found = base.mapInArrow(_search(shared, k), "query_id long, vec_id long, score long")
        best(found).select("query_id", "rank", "vec_id", "score").write.parquet(f"{path}/batch={i}")
        shared.unpersist()
    got = spark.read.schema(_FOUND).parquet(path).select("query_id", "rank", "vec_id", "score")
    return got if batches == 1 else best(got)


def every_50th(embeddings: DataFrame) -> DataFrame:
    v = vectors(embeddings)
    return search(v, v.where("vec_id % 50 = 0"))


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x::DOUBLE))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""
