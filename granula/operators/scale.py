"""Scalers and column transforms (P1-P14): one aggregate row, joined back to every row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TINY = 1e-12


def _fit(df: DataFrame, cols: list[str], **stats) -> DataFrame:
    """df with columns <col>_<stat> of whole-table statistics: a one-row broadcast."""
    one = df.agg(*(make(F.col(c)).alias(f"{c}_{name}") for c in cols for name, make in stats.items()))
    return df.crossJoin(F.broadcast(one))


def _put(df: DataFrame, fitted: DataFrame, cols: list[str], value) -> DataFrame:
    return fitted.select(*(value(c).alias(c) if c in cols else F.col(c) for c in df.columns))


def standard(df, cols):
    """(x - mean) / population deviation; a constant column is only centred."""
    f = _fit(df, cols, m=F.avg, s=F.stddev_pop)
    return _put(df, f, cols, lambda c: (F.col(c) - F.col(f"{c}_m")) / F.when(F.col(f"{c}_s") == 0, 1.0).otherwise(F.col(f"{c}_s")))


def minmax(df, cols):
    """(x - min) / (max - min); a constant column is 0."""
    f = _fit(df, cols, lo=F.min, hi=F.max)
    return _put(df, f, cols, lambda c: F.when(F.col(f"{c}_hi") == F.col(f"{c}_lo"), 0.0).otherwise((F.col(c) - F.col(f"{c}_lo")) / (F.col(f"{c}_hi") - F.col(f"{c}_lo"))))


def robust(df, cols):
    """(x - median) / interquartile range (linear interpolation); a range of 0 counts as 1."""
    f = _fit(df, cols, q=lambda c: F.percentile(c, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))))
    spread = lambda c: F.col(f"{c}_q")[2] - F.col(f"{c}_q")[0]
    return _put(df, f, cols, lambda c: (F.col(c) - F.col(f"{c}_q")[1]) / F.when(spread(c) == 0, 1.0).otherwise(spread(c)))


def scale(df: DataFrame, cols: list[str], how: str) -> DataFrame:
    """Dispatch: none, standard, minmax or robust."""
    found = {"none": lambda d, _: d, "standard": standard, "minmax": minmax, "robust": robust}
    key = how.strip().lower()
    if key not in found:
        raise ValueError(f"unknown scaler {how}")
    return found[key](df, cols)


def fit_minmax_clip(train: DataFrame, df: DataFrame, cols: list[str]) -> DataFrame:
    """Ranges of train (below 1e-12: 1) applied to df, clipped to [0, 1]."""
    one = train.agg(*(f(c).alias(f"{c}_{n}") for c in cols for n, f in (("lo", F.min), ("hi", F.max))))
    f = df.crossJoin(F.broadcast(one))
    width = lambda c: F.col(f"{c}_hi") - F.col(f"{c}_lo")
    return _put(df, f, cols, lambda c: F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col(c) - F.col(f"{c}_lo")) / F.when(width(c) < TINY, 1.0).otherwise(width(c)))))


def column_minmax(df, cols):
    """min-max by column, 0 where the range is below 1e-12."""
    f = _fit(df, cols, lo=F.min, hi=F.max)
    width = lambda c: F.col(f"{c}_hi") - F.col(f"{c}_lo")
    return _put(df, f, cols, lambda c: F.when(width(c) < TINY, 0.0).otherwise((F.col(c) - F.col(f"{c}_lo")) / width(c)))


def vector_minmax(v: Column, over=None) -> Column:
    over = over or Window.partitionBy()
    lo, hi = F.min(v).over(over), F.max(v).over(over)
    return (v - lo) / F.greatest(hi - lo, F.lit(TINY))


def vector_minmax_or_zero(v: Column, over=None) -> Column:
    over = over or Window.partitionBy()
    lo, hi = F.min(v).over(over), F.max(v).over(over)
    return F.when(hi - lo <= 1e-15, 0.0).otherwise((v - lo) / (hi - lo))


def unit_scale(v: Column, over=None) -> Column:
    """Between the 5% and 95% quantiles, clipped; else between the extremes; else 1."""
    over = over or Window.partitionBy()
    q = F.percentile(v, F.array(F.lit(0.05), F.lit(0.95))).over(over)
    lo, hi = F.min(v).over(over), F.max(v).over(over)
    clip = lambda a, b: F.least(F.lit(1.0), F.greatest(F.lit(0.0), (v - a) / (b - a)))
    return F.when(q[1] - q[0] > TINY, clip(q[0], q[1])).when(hi - lo > TINY, clip(lo, hi)).otherwise(1.0)


def mad(df: DataFrame, column: str) -> DataFrame:
    """Median and median absolute deviation of a column."""
    med = df.agg(F.median(column).alias("median"))
    return df.crossJoin(F.broadcast(med)).agg(F.first("median").alias("median"), F.median(F.abs(F.col(column) - F.col("median"))).alias("mad"))


def relative_margin(best: Column, second: Column, eps: float = TINY) -> Column:
    best, second = F.greatest(best, F.lit(0.0)), F.greatest(second, F.lit(0.0))
    return (best - second) / (best + eps)


def recode(df: DataFrame, column: str, to: str) -> DataFrame:
    """Codes 0..k-1 of the sorted distinct values; the values are few."""
    codes = df.select(column).distinct().select(column, (F.dense_rank().over(Window.orderBy(column)) - 1).cast("int").alias(to))
    return df.join(F.broadcast(codes), column)


def pca2(points: DataFrame) -> DataFrame:
    """Centred principal components 1 and 2 of `features` (for plots): point_id, pc1, pc2."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    v = points.select("point_id", array_to_vector("features").alias("v"))
    mean = v.agg(vector_to_array(Summarizer.mean(F.col("v"))).alias("m"))
    centred = points.crossJoin(F.broadcast(mean)).select("point_id", array_to_vector(F.zip_with("features", "m", lambda a, b: a - b)).alias("v"))
    out = PCA(k=2, inputCol="v", outputCol="pc").fit(centred).transform(centred).withColumn("pc", vector_to_array("pc"))
    return out.select("point_id", F.col("pc")[0].alias("pc1"), F.col("pc")[1].alias("pc2"))


def check_distances(pairs: DataFrame) -> DataFrame:
    """Counts of faults in a distance relation (i, j, d); distances are clamped at 0 by users."""
    other = pairs.select(F.col("i").alias("j"), F.col("j").alias("i"), F.col("d").alias("e"))
    return pairs.join(other, ["i", "j"], "left").agg(
        F.count("*").alias("n"), F.count_if(F.col("d") < -TINY).alias("negative"), F.count_if(F.isnan("d") | F.col("d").isNull()).alias("not_finite"), F.count_if(F.col("e").isNull() | (F.abs(F.col("d") - F.col("e")) > 1e-9)).alias("uneven")
    )
