"""Range joins with an equal key: values are dealt to bins, intervals to all bins that they touch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def band_join(intervals: DataFrame, points: DataFrame, on: list[str], low: Column, high: Column, value: Column, width: int) -> DataFrame:
    """Rows of points with low <= value <= high for rows of intervals with equal `on` columns.

    `width` should be near the intervals' usual length: an interval then touches one or two bins, and no join is
    without an equal key. Other columns of the two sides must differ in name.
    """
    left = intervals.withColumns({"__low": low.cast("long"), "__high": high.cast("long")}).where("__low <= __high")
    left = left.withColumn("__bin", F.explode(F.sequence(F.floor(F.col("__low") / width), F.floor(F.col("__high") / width))))
    right = points.withColumn("__value", value.cast("long")).withColumn("__bin", F.floor(F.col("__value") / width))
    joined = left.join(right, [*on, "__bin"]).where(F.col("__value").between(F.col("__low"), F.col("__high")))
    return joined.drop("__low", "__high", "__bin", "__value")


def scaffold_lookup(positions: DataFrame, scaffolds: DataFrame, width: int = 65536) -> DataFrame:
    """Scaffold and local position for global positions(gno): an as-of join by bins."""
    spans = scaffolds.select("scaffold_id", F.col("start").alias("__start"), "length").where("length > 0")
    found = band_join(spans, positions, [], F.col("__start"), F.col("__start") + F.col("length") - 1, F.col("gno"), width)
    return found.withColumn("local_pos", F.col("gno") - F.col("__start")).drop("__start", "length")
