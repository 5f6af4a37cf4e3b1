"""Column functions over inclusive intervals, and a keyed overlap join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def overlap(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    return F.greatest(F.least(a1, b1) - F.greatest(a0, b0) + 1, F.lit(0))


def iou(a0: Column, a1: Column, b0: Column, b1: Column) -> Column:
    """Overlap over hull: 0 where the intervals are apart."""
    hull = F.greatest(a1, b1) - F.least(a0, b0) + 1
    return F.when(hull > 0, overlap(a0, a1, b0, b1) / hull).otherwise(0.0)


def rounded(x: Column, places: int) -> Column:
    """Half up by floor, which every engine does alike."""
    return F.floor(x * 10**places + 0.5) / 10**places


def overlap_join(left: DataFrame, right: DataFrame, keys: list[str], a: tuple[str, str], b: tuple[str, str], bin_size: int = 1 << 14) -> DataFrame:
    """Pairs of rows with equal keys whose intervals a and b meet.

    Both sides are dealt by key and bin, so one long record is many partitions; the pair is kept in the bin in which its
    overlap begins, so it appears once.
    """
    def bins(df, low, high, name):
        return df.withColumn(name, F.explode(F.sequence(F.floor(F.col(low) / bin_size), F.floor(F.col(high) / bin_size))))

    x, y = bins(left.where(F.col(a[0]) <= F.col(a[1])), *a, "_bin"), bins(right.where(F.col(b[0]) <= F.col(b[1])), *b, "_bin")
    both = x.join(y, [*keys, "_bin"]).where((F.col(a[0]) <= F.col(b[1])) & (F.col(b[0]) <= F.col(a[1])))
    return both.where(F.col("_bin") == F.floor(F.greatest(F.col(a[0]), F.col(b[0])) / bin_size)).drop("_bin")
