"""Raster series: cells with t. Layouts by snapshots and differences give the same answers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.keys import in_window, zigzag
from ..model import int_, long_


def info(cells: DataFrame) -> DataFrame:
    return cells.agg(
        int_(F.countDistinct("t")).alias("n_times"),
        int_(F.max("row") + 1).alias("n_rows"),
        int_(F.max("col") + 1).alias("n_cols"),
        F.min("value").alias("min_value"),
        F.max("value").alias("max_value"),
    )


def snapshot_steps(cells: DataFrame, every: int) -> DataFrame:
    """(t, snap_t): a row for each step that has cells. Steps divisible by `every` are snapshots, as
    is the first; any other step refers to the last snapshot that there is."""
    steps = cells.select("t").distinct()
    by = Window.orderBy("t")  # a row for each step
    is_snapshot = (F.col("t") % every == 0) | (F.row_number().over(by) == 1)
    last = F.max(F.when(is_snapshot, F.col("t"))).over(by.rowsBetween(Window.unboundedPreceding, 0))
    return steps.select("t", int_(last).alias("snap_t"))


def snapshot_deltas(cells: DataFrame, every: int) -> DataFrame:
    """(t, snap_t, row, col, delta): values at snapshots, else the difference from the last one, where
    a cell that it lacks counts as 0."""
    steps = snapshot_steps(cells, every)
    at = cells.join(steps, "t")
    snap = at.where("t = snap_t").select("snap_t", "row", "col", F.col("value").alias("base"))
    joined = at.join(snap, ["snap_t", "row", "col"], "left")
    delta = F.when(F.col("t") == F.col("snap_t"), F.col("value")).otherwise(F.col("value") - F.coalesce("base", F.lit(0)))
    return joined.select("t", "snap_t", "row", "col", long_(delta).alias("delta"))


def zigzag_deltas(deltas: DataFrame) -> DataFrame:
    return deltas.where("t <> snap_t").select("t", "snap_t", "row", "col", zigzag(F.col("delta")).alias("code"))


def reconstruct(deltas: DataFrame) -> DataFrame:
    """(t, row, col, value) from snapshots and differences."""
    snap = deltas.where("t = snap_t").select("snap_t", "row", "col", F.col("delta").alias("base"))
    joined = deltas.join(snap, ["snap_t", "row", "col"], "left")
    value = F.when(F.col("t") == F.col("snap_t"), F.col("delta")).otherwise(F.coalesce("base", F.lit(0)) + F.col("delta"))
    return joined.select("t", "row", "col", long_(value).alias("value"))


def window(deltas: DataFrame, xini: int, xend: int, yini: int, yend: int, tini: int, tend: int) -> DataFrame:
    """(t, row, col, value) of a window and time range from snapshots and differences: only the steps
    asked for and their snapshots are read, and only in the window."""
    inside = deltas.where(in_window(F.col("row"), F.col("col"), xini, xend, yini, yend) & (F.col("snap_t") <= tend))
    steps = inside.where(F.col("t").between(tini, tend))
    return reconstruct(inside.where("t = snap_t").unionByName(steps.where("t <> snap_t"))).where(F.col("t").between(tini, tend))


def verify(cells: DataFrame, deltas: DataFrame) -> DataFrame:
    """(t, n_cells, n_mismatch): each step against its reconstruction."""
    keys = ["t", "row", "col"]
    both = cells.select(*keys, F.col("value").alias("va")).join(reconstruct(deltas).select(*keys, F.col("value").alias("vb")), keys, "full_outer")
    return both.groupBy("t").agg(F.count("*").alias("n_cells"), F.count_if(~F.col("va").eqNullSafe(F.col("vb"))).alias("n_mismatch"))


def changed_cells(cells: DataFrame) -> DataFrame:
    """(t, n_changed, n_cells): what a difference against the step before would hold, the
    figure on which a choice between snapshot and difference rests."""
    before = F.lag("value").over(Window.partitionBy("row", "col").orderBy("t"))
    marked = cells.withColumn("changed", F.coalesce(~(F.col("value") == before), F.lit(True)))
    return marked.groupBy("t").agg(F.count_if("changed").alias("n_changed"), F.count("*").alias("n_cells"))


def adaptive_snapshots(cells: DataFrame, share: float = 0.5) -> DataFrame:
    """(t, is_snapshot, snap_t): a step is a snapshot if more than `share` of its cells changed."""
    by = Window.orderBy("t")  # a row for each step
    marked = changed_cells(cells).select("t", ((F.col("n_changed") > share * F.col("n_cells")) | (F.row_number().over(by) == 1)).alias("is_snapshot"))
    last = F.max(F.when(F.col("is_snapshot"), F.col("t"))).over(by.rowsBetween(Window.unboundedPreceding, 0))
    return marked.withColumn("snap_t", last)


def space_per_step(spark: SparkSession, path: str) -> DataFrame:
    """(t, n_files, n_bytes) of stored tiles that are partitioned by t, from the files' metadata."""
    files = spark.read.parquet(path).select("t", F.col("_metadata.file_path").alias("f"), F.col("_metadata.file_size").alias("b")).distinct()
    return files.groupBy("t").agg(F.count("*").alias("n_files"), F.sum("b").alias("n_bytes"))
