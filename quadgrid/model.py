"""Rasters as relations: cells(row, col, value), with a leading t for series; and the rasters
that the registered queries derive from the given tables."""

from __future__ import annotations

import tempfile
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CELLS = "row int, col int, value bigint"
CELLS_T = "t int, row int, col int, value bigint"
QUERIES = "query_id bigint, xini int, xend int, yini int, yend int, tini int, tend int, valini bigint, valend bigint"


@dataclass(frozen=True)
class Extent:
    n_rows: int
    n_cols: int
    n_times: int = 1


DEMAND, SUPPLY, EVENTS = Extent(64, 64), Extent(64, 48), Extent(16, 24, 31)
EMBEDDING_COLS = 64
_ROOTS: set[str] = set()  # scratch folders of this driver


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder's name below spark.checkpoint.dir, which the driver and all executors share.

    What is written there goes when the driver's JVM ends. Where the setting is missing, a temporary
    folder is set if all tasks run in this process; on a cluster it is an error, as other machines
    couldn't see the folder.
    """
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and (found := sc._jsc.sc().getCheckpointDir()).isDefined():
        base = found.get()
    if not base:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="quadgrid-")
        sc.setCheckpointDir(base)
    root = f"{base.rstrip('/')}/quadgrid-{sc.applicationId}"
    if root not in _ROOTS:
        at = sc._jvm.org.apache.hadoop.fs.Path(root)
        fs = at.getFileSystem(sc._jsc.hadoopConfiguration())
        fs.mkdirs(at)
        fs.deleteOnExit(at)
        _ROOTS.add(root)
    return f"{root}/{label}-{uuid.uuid4().hex[:12]}"


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write df as a table in a scratch folder and read it again: lineage ends here."""
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def int_(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("int")


def long_(c: Column | str) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("bigint")


def grid(spark: SparkSession, extent: Extent, series: bool = False) -> DataFrame:
    """All positions of an extent, by arithmetic on a range."""
    per = extent.n_rows * extent.n_cols
    n = per * (extent.n_times if series else 1)
    pos = F.col("id") % per
    cells = [int_(F.floor(pos / extent.n_cols)).alias("row"), int_(pos % extent.n_cols).alias("col")]
    return spark.range(n).select(*([int_(F.floor(F.col("id") / per)).alias("t")] if series else []), *cells)


def densify(sparse: DataFrame, extent: Extent, series: bool = False) -> DataFrame:
    """Every position of the extent; 0 where sparse has none."""
    keys = ["t", "row", "col"] if series else ["row", "col"]
    full = grid(sparse.sparkSession, extent, series)
    return full.join(sparse, keys, "left").select(*keys, F.coalesce("value", F.lit(0)).cast("bigint").alias("value"))


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def embedding_cells(spark: SparkSession, sf_dir: str, rows: tuple[int, int] | None = None) -> DataFrame:
    """A dense signed raster: a row for each vector, in thousandths; `rows`, the first and the last
    wanted, reach the scan."""
    e = _table(spark, sf_dir, "embeddings")
    e = e if rows is None else e.where(F.col("vec_id").between(*rows))
    e = e.select(int_("vec_id").alias("row"), F.posexplode("embedding").alias("col", "x"))
    return e.select("row", "col", int_(F.floor(F.col("x").cast("double") * 1000)).alias("value"))


def label_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The embeddings' labels as a zone raster of the same extent."""
    e = _table(spark, sf_dir, "embeddings")
    return e.select(int_("vec_id").alias("row"), F.posexplode("embedding").alias("col", "x"), int_("label").alias("value")).drop("x")


def zone_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The labels as a series of four zone rasters: vectors are dealt to the steps in turn."""
    e = _table(spark, sf_dir, "embeddings")
    at = [int_(F.col("vec_id") % 4).alias("t"), int_(F.floor(F.col("vec_id") / 4)).alias("row")]
    return e.select(*at, F.posexplode("embedding").alias("col", "x"), long_("label").alias("value")).drop("x")


def demand_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ordered quantity by part and order group, 64 x 64."""
    li = _table(spark, sf_dir, "lineitem")
    row, col = int_(F.col("l_partkey") % 64), int_(F.floor(F.col("l_orderkey") / 7) % 64)
    found = li.groupBy(row.alias("row"), col.alias("col")).agg(long_(F.sum("l_quantity")).alias("value"))
    return densify(found, DEMAND)


def supply_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items by part and supplier group, 64 x 48."""
    li = _table(spark, sf_dir, "lineitem")
    found = li.groupBy(int_(F.col("l_partkey") % 64).alias("row"), int_(F.col("l_suppkey") % 48).alias("col")).agg(F.count("*").alias("value"))
    return densify(found, SUPPLY)


def _block_zones(cells: DataFrame, side: int, per: int) -> DataFrame:
    """A zone raster, even over blocks: the mean of the block's cells by `per`, rounded down."""
    at = [F.floor(F.col(x) / side).alias(f"_{x}") for x in ("row", "col")]
    numbered = cells.select("row", "col", "value", *at)
    means = numbered.groupBy("_row", "_col").agg(long_(F.floor(F.avg("value") / per)).alias("zone"))
    return numbered.join(means, ["_row", "_col"]).select("row", "col", F.col("zone").alias("value"))


def supply_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _block_zones(supply_cells(spark, sf_dir), 8, 1)


def demand_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _block_zones(demand_cells(spark, sf_dir), 32, 4)


def event_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events by day, user group and hour: a series of 31 rasters of 16 x 24."""
    ev = _table(spark, sf_dir, "events")
    keys = [int_(F.dayofmonth("ts") - 1).alias("t"), int_(F.col("user_id") % 16).alias("row"), int_(F.hour("ts")).alias("col")]
    return densify(ev.groupBy(*keys).agg(F.count("*").alias("value")), EVENTS, series=True)


def access_queries(spark: SparkSession, n: int = 200) -> DataFrame:
    """Points in and out of the embeddings' raster."""
    i = F.col("id")
    return spark.range(n).select(i.alias("query_id"), int_(i * 37 % 508).alias("row"), int_(i * 11 % 68).alias("col"))


def region_queries(spark: SparkSession, n: int = 64) -> DataFrame:
    """Windows with value ranges over the 64 x 64 raster; every eighth takes all values."""
    i, low = F.col("id"), F.col("id") * 17 % 400
    every = i % 8 == 0
    return spark.range(n).select(
        i.alias("query_id"),
        int_(i * 7 % 64).alias("xini"),
        int_(F.least(F.lit(63), i * 7 % 64 + i % 9)).alias("xend"),
        int_(i * 13 % 64).alias("yini"),
        int_(F.least(F.lit(63), i * 13 % 64 + i % 5)).alias("yend"),
        long_(F.when(every, 0).otherwise(low)).alias("valini"),
        long_(F.when(every, 100000).otherwise(low + 20 + i * 5 % 200)).alias("valend"),
    )


def large_queries(spark: SparkSession, n: int = 48) -> DataFrame:
    """Windows of up to 36 x 42 cells over the 64 x 64 raster: narrow value ranges, wide ones, and all values."""
    i = F.col("id")
    kind = lambda a, b, c: long_(F.when(i % 3 == 0, a).when(i % 3 == 1, b).otherwise(c))
    return spark.range(n).select(
        i.alias("query_id"),
        int_(i * 5 % 24).alias("xini"),
        int_(i * 5 % 24 + 8 + i % 5 * 7).alias("xend"),
        int_(i * 11 % 20).alias("yini"),
        int_(i * 11 % 20 + 6 + i % 7 * 6).alias("yend"),
        kind(i * 3, F.lit(0), i * 9).alias("valini"),
        kind(i * 3 + 12, F.lit(100000), i * 9 + 60).alias("valend"),
    )


def series_queries(spark: SparkSession, n: int = 32) -> DataFrame:
    """Boxes of time, row, column and value over the event series."""
    i = F.col("id")
    every = i % 4 == 0
    return spark.range(n).select(
        i.alias("query_id"),
        int_(i * 7 % 16).alias("xini"),
        int_(F.least(F.lit(15), i * 7 % 16 + i % 4)).alias("xend"),
        int_(i * 13 % 24).alias("yini"),
        int_(F.least(F.lit(23), i * 13 % 24 + i % 5)).alias("yend"),
        int_(i % 30).alias("tini"),
        int_(F.least(F.lit(29), i % 30 + i % 6)).alias("tend"),
        long_(F.when(every, 0).otherwise(i % 3)).alias("valini"),
        long_(F.when(every, 1000).otherwise(i % 3 + 1)).alias("valend"),
    )


def zone_queries(spark: SparkSession, n: int = 40) -> DataFrame:
    """Boxes of time, row, column and label over the zone series; every fifth takes all labels."""
    i = F.col("id")
    every = i % 5 == 0
    return spark.range(n).select(
        i.alias("query_id"),
        int_(i * 7 % 110).alias("xini"),
        int_(i * 7 % 110 + i % 9).alias("xend"),
        int_(i * 13 % 60).alias("yini"),
        int_(i * 13 % 60 + i % 7).alias("yend"),
        int_(i % 4).alias("tini"),
        int_(F.least(F.lit(3), i % 4 + i % 2)).alias("tend"),
        long_(F.when(every, 0).otherwise(i % 8)).alias("valini"),
        long_(F.when(every, 1000).otherwise(i % 8 + i % 3)).alias("valend"),
    )
