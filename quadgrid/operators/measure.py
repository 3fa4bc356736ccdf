"""Timed runs and their history: how long a batch took, for each query and for each cell it gave."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_HISTORY = "at timestamp, name string, seconds double, n_queries bigint, n_rows bigint, n_cells bigint"


@dataclass(frozen=True)
class Run:
    name: str
    seconds: float
    n_queries: int
    n_rows: int
    n_cells: int

    @property
    def us_per_query(self) -> float:
        return 1e6 * self.seconds / max(1, self.n_queries)

    @property
    def us_per_cell(self) -> float:
        return 1e6 * self.seconds / max(1, self.n_cells)


def timed(name: str, df: DataFrame, n_queries: int = 1, write=None) -> Run:
    """Run df once and count its rows on the way (`DataFrame.observe`, no second pass). Cells are the sum of
    a column n_cells where there is one, else the rows. write: a function of df that runs it, in
    place of writing nothing."""
    seen = Observation()
    cells = F.sum(F.col("n_cells").cast("bigint")) if "n_cells" in df.columns else F.count(F.lit(1))
    watched = df.observe(seen, F.count(F.lit(1)).alias("n_rows"), F.coalesce(cells, F.lit(0)).alias("n_cells"))
    began = time.perf_counter()
    if write is None:
        watched.write.format("noop").mode("overwrite").save()
    else:
        write(watched)
    took = time.perf_counter() - began
    return Run(name, took, n_queries, seen.get["n_rows"], seen.get["n_cells"])


def remember(spark: SparkSession, path: str, *runs: Run) -> None:
    """Append runs to the history table below path."""
    rows = [(r.name, r.seconds, r.n_queries, r.n_rows, r.n_cells) for r in runs]
    df = spark.createDataFrame(rows, "name string, seconds double, n_queries bigint, n_rows bigint, n_cells bigint").coalesce(1)
    df.select(F.current_timestamp().alias("at"), "*").write.mode("append").parquet(path)


def history(spark: SparkSession, path: str) -> DataFrame:
    """All runs, the latest first, with microseconds for each query and each cell."""
    us = lambda n: F.col("seconds") * 1e6 / F.greatest(F.lit(1), n)
    return spark.read.schema(_HISTORY).parquet(path).withColumns({"us_per_query": us(F.col("n_queries")), "us_per_cell": us(F.col("n_cells"))}).orderBy(F.desc("at"), "name")


def summary(spark: SparkSession, path: str) -> DataFrame:
    """(name, n_runs, least_seconds, mean_seconds, last_seconds) over the history."""
    by = history(spark, path).groupBy("name")
    return by.agg(F.count("*").alias("n_runs"), F.min("seconds").alias("least_seconds"), F.avg("seconds").alias("mean_seconds"), F.max_by("seconds", "at").alias("last_seconds"))
