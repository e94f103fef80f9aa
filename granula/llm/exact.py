"""Exact dedup by a minimal perfect hash over historical distinct digests.

Texts are equal when their normalised forms are: every space and U+0009 to U+000D deleted. Of equal
texts the one with the most code points in the original stays, then the smallest doc_id.

The history's distinct digests are cut into shards by their first bits. Each shard gets a minimal
perfect hash (levels of bit arrays; a digest's slot is the rank of its bit), whose slots hold the
full digests and the locators of their winners. A new batch's distinct digests are looked up in
their shard and compared byte for byte with the slot: members join the history's group, nonmembers
group on their own. Copies are folded before anything is shuffled by digest, so a digest that a
third of all rows share is one row from each task.

Defined cases: null counts as empty, and all empty texts are one group; of identical rows each gets
the same result, and `keep_one` keeps one of them; a row without doc_id is ignored; empty tables
(history, batch or both) work; other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granula.llm.common import U64, WS, by_ids, durable, join_hot, mix, partitions

#: Bits per digest still without a slot, at each level.
GAMMA = 2
_SPACE = rf"[{WS}]+"


def digest(text: F.Column) -> F.Column:
    """SHA-256 of the normalised text, in hex."""
    return F.sha2(F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), _SPACE, ""), 256)


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars (code points of the original), sha."""
    n = F.length(F.coalesce(F.col("text").cast("string"), F.lit("")))
    return docs.where("doc_id is not null").select(F.col("doc_id").cast("long"), n.cast("long").alias("n_chars"), digest(F.col("text")).alias("sha"))


def winners(rows: DataFrame) -> DataFrame:
    """One row per digest: its winner's n_chars and doc_id, and the number of rows."""
    best = F.max(F.struct("n_chars", (-F.col("doc_id")).alias("d")))
    return rows.groupBy("sha").agg(best.alias("w"), F.count("*").alias("rows")).select("sha", F.col("w.n_chars").alias("n_chars"), (-F.col("w.d")).alias("doc_id"), "rows")


class PerfectHash:
    """A minimal perfect hash of distinct 32-byte digests."""

    def __init__(self, digests: np.ndarray):
        """digests: an (n, 4) array of 64-bit words."""
        self.levels: list[tuple[np.ndarray, np.ndarray, int]] = []
        left, base = digests, 0
        while len(left):
            size = max(64, GAMMA * len(left) + 63 & ~63)
            at = self._hash(left, len(self.levels), size)
            hits = np.bincount(at, minlength=size)
            bits = hits == 1
            self.levels.append((bits, np.cumsum(bits) - bits, base))
            base += int(bits.sum())
            left = left[hits[at] > 1]

    @staticmethod
    def _hash(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        salt = U64(level * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019 & (1 << 64) - 1)
        h = salt
        for c in range(4):
            h = mix(h ^ keys[:, c])
        return (h % U64(size)).astype(np.int64)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key; -1 or any slot for keys not in the set."""
        out = np.full(len(keys), -1, np.int64)
        open_ = np.arange(len(keys))
        for level, (bits, rank, base) in enumerate(self.levels):
            at = self._hash(keys[open_], level, len(bits))
            hit = bits[at]
            out[open_[hit]] = base + rank[at[hit]]
            open_ = open_[~hit]
        return out


_SIDE = {"n_chars": pa.int64(), "doc_id": pa.int64(), "rows": pa.int64(), "sha": pa.string()}


def _side(table: pa.Table, prefix: str = "") -> pa.Table:
    """One side of a shard; Spark may send no columns for a side without rows."""
    if not table.num_rows:
        return pa.schema(list(_SIDE.items())).empty_table()
    lost = [c for c in _SIDE if prefix + c not in table.column_names]
    if lost:
        raise ValueError(f"rows without {lost} reached a shard")
    return table.select([prefix + c for c in _SIDE]).rename_columns(list(_SIDE))


def _words(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(bytes.fromhex("".join(column.to_pylist())), "<u8").reshape(-1, 4)


def _look_up(history: pa.Table, batch: pa.Table) -> pa.Table:
    """Winner and rows of each digest of a shard, from the history's slots and the new digests."""
    history, batch = _side(history), _side(batch, "new_")
    old, new = _words(history.column("sha")), _words(batch.column("sha"))
    index = PerfectHash(old)
    slot = index.slots(old)
    full = np.empty_like(old)
    full[slot] = old
    locator = np.empty((len(old), 3), np.int64)  # winner's code points and doc_id, rows
    for c, name in enumerate(("n_chars", "doc_id", "rows")):
        locator[slot, c] = history.column(name).to_numpy()
    mine = np.stack([batch.column(c).to_numpy() for c in ("n_chars", "doc_id", "rows")], axis=1).astype(np.int64).reshape(-1, 3)
    found = index.slots(new)
    member = found >= 0
    member[member] = (full[found[member]] == new[member]).all(axis=1)
    at, got = found[member], mine[member]
    better = (got[:, 0] > locator[at, 0]) | ((got[:, 0] == locator[at, 0]) & (got[:, 1] < locator[at, 1]))
    locator[at[better], :2] = got[better, :2]
    locator[at, 2] += got[:, 2]
    keys, rows = np.concatenate([full, new[~member]]), np.concatenate([locator, mine[~member]])
    text = keys.astype("<u8").tobytes().hex()
    return pa.table(
        {
            "sha": pa.array([text[i : i + 64] for i in range(0, len(text), 64)], pa.string()),
            "keep_id": pa.array(rows[:, 1], pa.int64()),
            "group_size": pa.array(rows[:, 2], pa.int64()),
        }
    )


def groups(history: DataFrame, batch: DataFrame) -> DataFrame:
    """(sha, keep_id, group_size) of all digests of two `digests` tables."""
    n = partitions(history)
    shard = F.conv(F.substring("sha", 1, 8), 16, 10).cast("long") % n
    one, two = (winners(x).withColumn("shard", shard) for x in (history, batch))
    # Both may come from one table: under names of their own the batch's columns are never taken for the history's.
    two = two.select("shard", *(F.col(c).alias(f"new_{c}") for c in _SIDE))
    return one.groupBy("shard").cogroup(two.groupBy("shard")).applyInArrow(_look_up, "sha string, keep_id long, group_size long")


def dedup(docs: DataFrame, is_history) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256.

    is_history: a condition on doc_id for the rows that the index is built from; the others are the
    new batch. The result does not depend on where that line is drawn.
    """
    rows = durable(digests(docs).withColumn("old", F.coalesce(is_history, F.lit(False))))
    found = durable(groups(rows.where("old"), rows.where("not old")))
    return join_hot(rows, found, "sha", "group_size").select("doc_id", "keep_id", "group_size", (F.col("doc_id") == F.col("keep_id")).alias("kept"), F.col("sha").alias("text_sha256"))


def history_half() -> F.Column:
    """The production split: documents whose crc32(doc_id as text) is even came earlier."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0


def keep_one(docs: DataFrame) -> DataFrame:
    """One document of each group of equal texts, with docs' columns; of identical rows one. Only
    rows of a doc_id that loses rows, or may, are shuffled. A row without doc_id goes."""
    found = durable(dedup(docs, history_half()).groupBy("doc_id", "text_sha256", "kept").agg(F.count("*").alias("rows")))
    safe, other = by_ids(docs, found.where("not kept or rows > 1").select("doc_id"))
    # Rows that are equal but for other columns fold first, so a row that comes very often is no hot spot.
    other = other.select("doc_id", digest(F.col("row.text")).alias("text_sha256"), "row").groupBy("doc_id", "text_sha256").agg(F.first("row").alias("row"))
    stay = other.join(found.where("not kept"), ["doc_id", "text_sha256"], "left_anti")
    return safe.select("row.*").union(stay.select("row.*"))
