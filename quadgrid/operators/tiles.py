"""Tiles and the min/max pyramid: the physical form that queries prune on.

A tile holds its values in row order as one array, or a single value where all are equal, and the
places of its cells where some of its box are missing.
Stored tiles are Parquet partitioned by raster and time and sorted by a Morton key, so that
row-group statistics of tile_row, tile_col, min_value and max_value skip what a query can't use.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keys import morton
from ..model import int_

TILE = 16


def build_tiles(cells: DataFrame, tile: int = TILE, keys: Sequence[str] = ()) -> DataFrame:
    """cells -> tiles, in one shuffle on the tile's key. The arrays are bounded by the tile.

    A tile that lacks cells of its bounding box has their places in `positions` (row * w + col
    within the box), beside its values; other tiles have null there.
    """
    at = cells.select("*", int_(F.floor(F.col("row") / tile)).alias("tile_row"), int_(F.floor(F.col("col") / tile)).alias("tile_col"))
    grouped = at.groupBy(*keys, "tile_row", "tile_col").agg(
        F.min("row").alias("base_row"),
        F.min("col").alias("base_col"),
        int_(F.max("row") - F.min("row") + 1).alias("h"),
        int_(F.max("col") - F.min("col") + 1).alias("w"),
        F.min("value").alias("min_value"),
        F.max("value").alias("max_value"),
        F.count("*").alias("n_cells"),
        F.sort_array(F.collect_list(F.struct("row", "col", "value"))).alias("_v"),
    )
    uniform = F.col("min_value") == F.col("max_value")
    values = F.col("_v.value")
    places = F.transform("_v", lambda v: int_((v["row"] - F.col("base_row")) * F.col("w") + v["col"] - F.col("base_col")))
    whole = places == F.sequence(F.lit(0), F.col("h") * F.col("w") - 1)
    grouped = grouped.withColumn("is_uniform", uniform).withColumn("values", F.when(uniform, F.slice(values, 1, 1)).otherwise(values))
    return grouped.withColumn("positions", F.when(~whole, places)).drop("_v")


def tile_cells(tiles: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """tiles -> cells: uniform tiles are repeated, others unpacked, sparse ones at their positions."""
    n = F.when(F.col("positions").isNull(), F.col("h") * F.col("w")).otherwise(F.size("positions")).cast("int")
    full = F.when(F.col("is_uniform"), F.array_repeat(F.col("values")[0], n)).otherwise(F.col("values"))
    out = tiles.select(*keys, "base_row", "base_col", "w", "positions", F.posexplode(full).alias("at", "value"))
    pos = F.coalesce(F.get("positions", F.col("at")), F.col("at"))
    row, col = F.col("base_row") + F.floor(pos / F.col("w")), F.col("base_col") + pos % F.col("w")
    return out.select(*keys, int_(row).alias("row"), int_(col).alias("col"), "value")


def merge_parts(tiles: DataFrame, tile: int = TILE, keys: Sequence[str] = (), order: str | None = None) -> DataFrame:
    """One row for each tile, where parts of a tile stand in several (those of two stream batches,
    say). Only such tiles are unpacked; of two cells at one place the one with the greater `order`
    (or the greater value) stays."""
    on = [*keys, "tile_row", "tile_col"]
    plain = [c for c in tiles.columns if c != order]
    parts = tiles.groupBy(*on).count().where("count > 1").drop("count")
    single = tiles.join(parts, on, "left_anti").select(*plain)
    many = tile_cells(tiles.join(parts, on, "left_semi"), [*keys, *([order] if order else [])])
    best = F.max(F.struct(*([order] if order else []), "value"))["value"]
    again = many.groupBy(*keys, "row", "col").agg(best.alias("value"))
    return single.unionByName(build_tiles(again, tile, keys).select(*plain))


def pyramid(tiles: DataFrame, levels: int, factor: int = 2, keys: Sequence[str] = ()) -> DataFrame:
    """Nodes of every level in one aggregation: level 0 is the tiles, each further one has factor² children.
    A node knows the box of its cells; it is full if it has as many cells as the box."""
    far = [(F.col("base_row") + F.col("h")).alias("far_row"), (F.col("base_col") + F.col("w")).alias("far_col")]
    up = tiles.select(*keys, "tile_row", "tile_col", "base_row", "base_col", *far, "min_value", "max_value", "n_cells", F.explode(F.sequence(F.lit(0), F.lit(levels - 1))).alias("level"))
    side = F.pow(F.lit(float(factor)), F.col("level"))
    node = [int_(F.floor(F.col(f"tile_{x}") / side)).alias(f"node_{x}") for x in ("row", "col")]
    least = [F.min(c).alias(c) for c in ("min_value", "base_row", "base_col")]
    out = up.groupBy(*keys, "level", *node).agg(*least, *[F.max(c).alias(c) for c in ("max_value", "far_row", "far_col")], F.sum("n_cells").alias("n_cells"))
    box = {"h": int_(F.col("far_row") - F.col("base_row")), "w": int_(F.col("far_col") - F.col("base_col"))}
    return out.withColumns(box).drop("far_row", "far_col").withColumn("is_uniform", F.col("min_value") == F.col("max_value"))


def children(nodes: DataFrame, factor: int = 2) -> DataFrame:
    """Each node with its children's rows (child_row, child_col), by an equi-join of levels."""
    p = nodes.select((F.col("level")).alias("level"), "node_row", "node_col")
    c = nodes.select(
        (F.col("level") + 1).alias("level"),
        int_(F.floor(F.col("node_row") / factor)).alias("node_row"),
        int_(F.floor(F.col("node_col") / factor)).alias("node_col"),
        F.col("node_row").alias("child_row"),
        F.col("node_col").alias("child_col"),
        F.col("min_value").alias("child_min"),
        F.col("max_value").alias("child_max"),
    )
    return p.join(c, ["level", "node_row", "node_col"])


def write_tiles(tiles: DataFrame, path: str, partition: Sequence[str] = (), mode: str = "overwrite") -> None:
    """Write tiles in Morton order within each file."""
    sorted_ = tiles.withColumn("_z", morton(F.col("tile_row"), F.col("tile_col"))).sortWithinPartitions(*partition, "_z").drop("_z")
    sorted_.write.mode(mode).partitionBy(*partition).parquet(path)


def last_level(tiles: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """How far each cell lies below its tile's greatest value: what the leaves of the pyramid add."""
    deep = tile_cells(tiles, [*keys, "tile_row", "tile_col", "max_value"])
    return deep.select(*keys, "tile_row", "tile_col", "row", "col", (F.col("max_value") - F.col("value")).cast("bigint").alias("delta"))


def info(cells: DataFrame) -> DataFrame:
    return cells.agg(
        int_(F.max("row") + 1).alias("n_rows"),
        int_(F.max("col") + 1).alias("n_cols"),
        F.count("*").alias("n_cells"),
        F.min("value").alias("min_value"),
        F.max("value").alias("max_value"),
    )


def mismatches(a: DataFrame, b: DataFrame, keys: Sequence[str] = ("row", "col")) -> DataFrame:
    """Cells that differ or are on one side only."""
    joined = a.select(*keys, F.col("value").alias("va")).join(b.select(*keys, F.col("value").alias("vb")), list(keys), "full_outer")
    return joined.where(~F.col("va").eqNullSafe(F.col("vb")))
