"""Seeded query workloads, and fixed-size windows around given points."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..model import Extent, int_


def _draw(n: int, seed: int):
    return int_(F.floor(F.rand(seed) * n))


def random_points(spark: SparkSession, extent: Extent, n: int, seed: int = 1, series: bool = False) -> DataFrame:
    t = [_draw(extent.n_times, seed + 2).alias("t")] if series else []
    return spark.range(n).select(F.col("id").alias("query_id"), _draw(extent.n_rows, seed).alias("row"), _draw(extent.n_cols, seed + 1).alias("col"), *t)


def random_regions(spark: SparkSession, extent: Extent, n: int, seed: int = 1, values: tuple[int, int] | None = None, series: bool = False) -> DataFrame:
    """Windows between two draws of each bound; value bounds only if a range is given."""
    axes = [("xini", "xend", extent.n_rows), ("yini", "yend", extent.n_cols)]
    axes += [("tini", "tend", extent.n_times)] if series else []
    axes += [("valini", "valend", values[1] - values[0] + 1)] if values else []
    out = spark.range(n).withColumnRenamed("id", "query_id")
    for i, (a, b, size) in enumerate(axes):
        base = values[0] if a == "valini" else 0
        out = out.withColumn("_p", _draw(size, seed + 2 * i) + base).withColumn("_q", _draw(size, seed + 2 * i + 1) + base)
        out = out.withColumn(a, F.least("_p", "_q")).withColumn(b, F.greatest("_p", "_q")).drop("_p", "_q")
    return out


def fixed_windows(points: DataFrame, extent: Extent, rows: int, cols: int) -> DataFrame:
    """points (query_id, row, col) -> windows of rows x cols from there, moved inside the extent."""
    x = F.greatest(F.lit(0), F.least(F.col("row"), F.lit(extent.n_rows - rows)))
    y = F.greatest(F.lit(0), F.least(F.col("col"), F.lit(extent.n_cols - cols)))
    return points.select("query_id", int_(x).alias("xini"), int_(x + rows - 1).alias("xend"), int_(y).alias("yini"), int_(y + cols - 1).alias("yend"))
