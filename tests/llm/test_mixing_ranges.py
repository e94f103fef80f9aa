"""Key ranges of the mix: no range holds much of a source, whatever its documents weigh."""

import pytest
from pyspark.sql import functions as F

from granula.llm import mixing


@pytest.mark.parametrize("w", [0.05, 0.07, 0.3, 0.8, 1.0])
def test_a_range_holds_a_bounded_share_in_the_order_of_keys(spark, w):
    n, ranges = 40_000, 200
    keyed = spark.range(n).select(mixing.sort_key(F.col("id"), F.lit(w)).alias("key")).select("key", mixing.key_range(F.col("key"), F.lit(ranges)).alias("r"))
    per = keyed.groupBy("r").agg(F.count("*").alias("m"), F.min("key").alias("lo"), F.max("key").alias("hi")).orderBy("r").collect()
    assert max(x.m for x in per) <= 11 * n / ranges
    assert all(a.hi < b.lo for a, b in zip(per, per[1:], strict=False))
