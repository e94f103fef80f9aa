"""Vector code compression: product codes by Lloyd's rounds whose sums are maintained by differences.

A vector of integers is cut into PARTS equal parts; each part position has a codebook of up to ENTRIES
entries. The table of vectors holds each one's last assignment. A round maps over it with the codebooks
(of a size fixed by ENTRIES and the dimensions) and writes the new assignments beside the old ones; the
running sums and counts of the entries change only by the parts that moved: minus at the old entry, plus
at the new one. A task adds these up before anything is shuffled, so at most two rows for each entry
and component leave it. Sums are integers, so rounds don't depend on the order of rows. Rounds end early
when nothing moves, for then nothing would change any more.

Distances are exact: by matrix products in doubles where they stay under 2**53, otherwise by differences in
64-bit integers.

Defined cases: rows without a vector or with a component that is null or not finite are dropped; rows
with one vec_id are rows of their own, ordered by their vectors; a null vec_id is a row, the last in
order; with fewer than ENTRIES rows there are fewer entries; vectors of no components have code 00 in each
part; without rows the result is empty. Vectors of different lengths, of a length that PARTS does not
divide, or too large for distances in 63 bits raise a ValueError. Other columns do not matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granula.functions.state import durable, fresh, scratch
from granula.llm.common import join_hot

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024

_STATE = "vec_id long, label string, v array<long>, was binary, code binary"
_SUMS = "part int, entry int, pos int, value long"


def integers(rows: DataFrame, vector: str = "embedding") -> DataFrame:
    """vec_id, label (as text, `n` for none), v: the rows with finite vectors, in integers."""
    e = F.col(vector).cast("array<double>")
    bad = F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    label = F.coalesce(F.concat(F.lit("v"), F.col("label").cast("string")), F.lit("n"))
    return rows.where(e.isNotNull() & ~F.coalesce(bad, F.lit(False))).select(F.col("vec_id").cast("long"), label.alias("label"), F.transform(e, lambda x: F.floor(x * float(SCALE)).cast("long")).alias("v"))


def _matrix(column: pa.ListArray, dims: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), dims)


def nearest(x: np.ndarray, book: np.ndarray, small: bool) -> tuple[np.ndarray, np.ndarray]:
    """For each row of x its nearest row of book, ties to the first, and the squared distance."""
    if small:
        f, b = x.astype(float), book.astype(float)
        d = (b * b).sum(axis=1) - 2 * (f @ b.T)
        at = d.argmin(axis=1)
        return at, (d[np.arange(len(x)), at] + (f * f).sum(axis=1)).astype(np.int64)
    at, best = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
    step = max(1, (1 << 22) // max(1, book.size))
    for i in range(0, len(x), step):
        d = ((x[i : i + step, None, :] - book[None]) ** 2).sum(axis=2)
        at[i : i + step] = d.argmin(axis=1)
        best[i : i + step] = d.min(axis=1)
    return at, best


class Codebooks:
    """The entries of all parts, array (PARTS, entries, width); sums and counts are kept in a table."""

    def __init__(self, entries: np.ndarray, largest: int):
        self.entries = entries
        self.parts, self.k, self.width = entries.shape
        self.dims = self.parts * self.width
        self.small = 4 * max(1, self.width) * max(1, largest) ** 2 < 1 << 53

    def assign(self, state: DataFrame) -> DataFrame:
        """state with new codes; the codes it had become `was`."""
        return state.mapInArrow(self._assign, _STATE)

    def _assign(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = _matrix(b.column(2), self.dims)
            codes = np.stack([nearest(v[:, p * self.width : (p + 1) * self.width], self.entries[p], self.small)[0] for p in range(self.parts)], axis=1).astype(np.uint8)
            yield pa.record_batch([b.column(0), b.column(1), b.column(2), b.column(4), pa.array([r.tobytes() for r in codes], pa.binary())], ["vec_id", "label", "v", "was", "code"])

    def moves(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """What a task's moved parts take from entries and add to them: position -1 is the count."""
        sums = np.zeros((self.parts, self.k, self.width + 1), np.int64)
        for b in batches:
            v = _matrix(b.column(0), self.dims)
            new = np.frombuffer(b"".join(b.column(2).to_pylist()), np.uint8).reshape(-1, self.parts)
            had = np.array([x is not None for x in b.column(1).to_pylist()], bool)
            old = np.zeros_like(new)
            old[had] = np.frombuffer(b"".join(x for x in b.column(1).to_pylist() if x is not None), np.uint8).reshape(-1, self.parts)
            for p in range(self.parts):
                part = np.concatenate((v[:, p * self.width : (p + 1) * self.width], np.ones((len(v), 1), np.int64)), axis=1)
                moved = ~had | (old[:, p] != new[:, p])
                np.add.at(sums[p], new[moved, p], part[moved])
                np.subtract.at(sums[p], old[moved & had, p], part[moved & had])
        p, e, i = np.nonzero(sums)
        yield pa.record_batch([pa.array(p.astype(np.int32)), pa.array(e.astype(np.int32)), pa.array(np.where(i == self.width, -1, i).astype(np.int32)), pa.array(sums[p, e, i])], ["part", "entry", "pos", "value"])

    def updated(self, sums: DataFrame, largest: int) -> Codebooks:
        """Entries as the floors of their means; those without parts stay. sums has parts * k * (width + 1) rows at most."""
        t = sums.toPandas()
        whole = np.zeros((self.parts, self.k, self.width + 1), np.int64)
        whole[t["part"], t["entry"], t["pos"]] = t["value"]
        count = whole[:, :, -1:]
        return Codebooks(np.where(count > 0, whole[:, :, :-1] // np.maximum(count, 1), self.entries), largest)

    def errors(self, state: DataFrame) -> DataFrame:
        """vec_id, label, code (hex digits) and error of each row by these entries."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                v = _matrix(b.column(2), self.dims)
                got = [nearest(v[:, p * self.width : (p + 1) * self.width], self.entries[p], self.small) for p in range(self.parts)]
                codes = np.stack([a for a, _ in got], axis=1).astype(np.uint8)
                yield pa.record_batch([b.column(0), b.column(1), pa.array([r.tobytes().hex() for r in codes], pa.string()), pa.array(sum(d for _, d in got))], ["vec_id", "label", "code", "error"])

        return state.mapInArrow(run, "vec_id long, label string, code string, error long")

    def sha256(self) -> str:
        return hashlib.sha256(",".join(map(str, self.entries.reshape(-1).tolist())).encode()).hexdigest()


def fit(rows: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, Codebooks | None]:
    """The durable table of assigned vectors and the codebooks after the rounds; rows are of `integers`."""
    state = durable(rows.select("vec_id", "label", "v", F.lit(None).cast("binary").alias("was"), F.lit(None).cast("binary").alias("code")))
    seen = state.agg(F.min(F.size("v")), F.max(F.size("v")), F.min(F.array_min("v")), F.max(F.array_max("v"))).first()
    dims, longest, low, high = seen
    if dims is None:
        return state, None
    largest = max(abs(low or 0), abs(high or 0))
    if dims != longest or dims % PARTS:
        raise ValueError(f"vectors of {dims} to {longest} components: one length is needed, and a multiple of {PARTS}")
    if dims * (2 * largest) ** 2 >= 1 << 63:
        raise ValueError(f"a component of {largest} / {SCALE}: squared distances would not fit")
    seeds = state.select("vec_id", "v").orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(ENTRIES).collect()
    entries = np.array([r["v"] for r in seeds], np.int64).reshape(len(seeds), PARTS, dims // PARTS).transpose(1, 0, 2)
    books, sums = Codebooks(entries, largest), None
    for _ in range(rounds):
        state = durable(books.assign(state))
        delta = state.where("not (was <=> code)").select("v", "was", "code").mapInArrow(books.moves, _SUMS)
        delta = durable(delta.groupBy("part", "entry", "pos").agg(F.sum("value").alias("value")))
        if not delta.limit(1).count():
            break
        sums = delta if sums is None else durable(sums.union(delta).groupBy("part", "entry", "pos").agg(F.sum("value").alias("value")))
        books = books.updated(sums, largest)
    return state, books


def compress(rows: DataFrame) -> DataFrame:
    """vec_id, code, error, label_error, codebooks_sha256 of the rows with finite vectors."""
    spark = rows.sparkSession
    path = fresh(spark)
    with scratch(spark):
        state, books = fit(integers(rows))
        if books is None:
            found = state.select("vec_id", F.lit("").alias("code"), F.lit(0).cast("long").alias("error"), F.lit(0).cast("long").alias("label_error"), F.lit("").alias("codebooks_sha256"))
        else:
            coded = durable(books.errors(state))
            of_label = durable(coded.groupBy("label").agg(F.sum("error").alias("label_error"), F.count("*").alias("n")))
            found = join_hot(coded, of_label, "label", "n").select("vec_id", "code", "error", "label_error", F.lit(books.sha256()).alias("codebooks_sha256"))
        found.write.parquet(path)
    return spark.read.parquet(path)


def _oracle() -> str:
    """The rounds written out; lists of doubles hold integers, whose inner products are exact."""
    near = "SELECT r, part, arg_min(e, (d, e)) AS e, min(d) AS d FROM (SELECT p.r, p.part, c.e, p.xx + c.yy - 2 * list_inner_product(p.x, c.y) AS d FROM p JOIN c{i} c ON c.part = p.part) GROUP BY r, part"
    step = """a{i} AS MATERIALIZED ({near}),
s{i} AS MATERIALIZED (SELECT part, e, list(m ORDER BY i) AS y FROM (SELECT a.part, a.e, i, floor(sum(p.x[i + 1]) / count(*)) AS m FROM a{i} a JOIN p ON p.r = a.r AND p.part = a.part, range(0, (SELECT w FROM k)) t(i) GROUP BY a.part, a.e, i) GROUP BY part, e),
c{j} AS MATERIALIZED (SELECT part, e, y, list_inner_product(y, y) AS yy FROM (SELECT c.part, c.e, coalesce(s.y, c.y) AS y FROM c{i} c LEFT JOIN s{i} s ON s.part = c.part AND s.e = c.e))"""
    rounds = ",\n".join(step.format(i=i, j=i + 1, near=near.format(i=i)) for i in range(ROUNDS))
    return f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST, v) AS r, vec_id, label, v FROM
  (SELECT vec_id, label, [floor({SCALE} * x::DOUBLE) FOR x IN embedding] AS v FROM embeddings WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0)),
k AS MATERIALIZED (SELECT min(len(v)) // {PARTS} AS w FROM v),
p AS MATERIALIZED (SELECT r, part, x, list_inner_product(x, x) AS xx FROM (SELECT r, part, v[part * w + 1 : part * w + w] AS x FROM v, k, range(0, {PARTS}) t(part))),
c0 AS MATERIALIZED (SELECT part, r - 1 AS e, x AS y, xx AS yy FROM p WHERE r <= {ENTRIES}),
{rounds},
f AS MATERIALIZED ({near.format(i=ROUNDS)}),
h AS (SELECT sha256(string_agg(z, ',' ORDER BY part, e)) AS codebooks_sha256 FROM (SELECT part, e, array_to_string([t::BIGINT FOR t IN y], ',') AS z FROM c{ROUNDS})),
g AS (SELECT r, string_agg(printf('%02x', e), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM f GROUP BY r)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM v JOIN g USING (r), h
"""


ORACLE = _oracle()
