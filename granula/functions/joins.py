"""Joins whose hot keys are dealt out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOT_PARTS, SALTS = 512, 64


def merge(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """A sort-merge join, whatever the sizes: nothing is broadcast."""
    return left.join(right.hint("merge"), on, how)


def spread(rows: DataFrame, found: DataFrame, keys: list[str], size: str, by: Column, total: int, parts: int = HOT_PARTS, least: int = 1000) -> DataFrame:
    """rows joined with found, which has one row for each key and, as size, its number of rows, of total.

    Keys with over 1 / parts of the rows are hot: their rows are dealt out by `by`, found's rows of these
    keys go to each of the SALTS parts. Only the list of hot keys, at most `parts` of them, is broadcast.
    """
    is_hot = F.col(size) > max(total // parts, least)
    hot = F.broadcast(found.where(is_hot).select(*keys, F.lit(True).alias("_hot")))
    none = F.lit(0).cast("long")
    rows = rows.join(hot, keys, "left").withColumn("_salt", F.when(F.col("_hot"), F.pmod(F.xxhash64(by), F.lit(SALTS))).otherwise(none)).drop("_hot")
    found = found.withColumn("_salt", F.explode(F.when(is_hot, F.sequence(none, F.lit(SALTS - 1).cast("long"))).otherwise(F.array(none))))
    return rows.join(found.hint("shuffle_hash"), [*keys, "_salt"]).drop("_salt")
