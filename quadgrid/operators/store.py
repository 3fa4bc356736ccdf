"""Stored rasters: tiles in Parquet, laid out so that a batch of queries reads its own tiles only.

Tiles are partitioned by time and by region (a square of tiles, numbered in Morton order) and
sorted by Morton key within. A batch of windows is expanded to tile numbers with their regions and
broadcast, behind a count of those rows; the join on the region prunes partitions at run time, plain
bounds of the whole batch reach the row groups' statistics, and tiles never move. A store with
buckets serves batches too large for that: it is bucketed by tile, so a join shuffles the queries
to the buckets and leaves the tiles where they are.

Beside the tiles lies their pyramid, partitioned by level, and a table of the store's properties, so
that no caller has to know the tile size.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import in_window, morton
from ..model import int_
from . import query as q
from .tiles import TILE, pyramid, tile_cells

REGION, LEVELS, FACTOR = 8, 4, 2
_PROPERTIES = "tile int, region int, levels int, factor int, keys string, bucketed string"


def region_of(tile_row: Column, tile_col: Column, region: int) -> Column:
    return morton(F.floor(tile_row / region), F.floor(tile_col / region))


@dataclass(frozen=True)
class TileStore:
    """tiles may be narrowed by `replace` (to some times, say); keys are () or ("t",)."""

    tiles: DataFrame
    nodes: DataFrame
    tile: int
    region: int
    levels: int
    factor: int
    keys: tuple[str, ...]
    bucketed: bool

    def on(self, queries: DataFrame) -> DataFrame:
        """Each query with each stored tile that its window touches."""
        wide = q.touched_tiles(queries, self.tile, self.keys)
        return self.join(wide, self._sizes(queries))

    def _sizes(self, queries: DataFrame):
        """How many tiles the batch touches, and the bounds of all its windows, in one row."""
        span = lambda a, b: F.floor(F.col(b) / self.tile) - F.floor(F.col(a) / self.tile) + 1
        n = span("xini", "xend") * span("yini", "yend")
        if "t" in self.keys:
            n = n * F.greatest(F.lit(0), F.col("tend") - F.col("tini") + 1)
        bounds = [F.min("xini").alias("xini"), F.max("xend").alias("xend"), F.min("yini").alias("yini"), F.max("yend").alias("yend")]
        return queries.where("xini <= xend AND yini <= yend").agg(F.sum(n).alias("n"), *bounds).first()

    def join(self, wide: DataFrame, sizes=None, on: Sequence[str] = ()) -> DataFrame:
        """Rows with tile_row, tile_col and the keys, joined to the tiles of these numbers."""
        tiles, on = self.tiles, [*self.keys, "tile_row", "tile_col"]
        n = wide.count() if sizes is None else sizes["n"] or 0
        if not self.bucketed:
            wide = wide.withColumn("region", region_of(F.col("tile_row"), F.col("tile_col"), self.region))
            on = ["region", *on]
        if sizes is not None and sizes["n"]:
            for axis, a, b in (("tile_row", "xini", "xend"), ("tile_col", "yini", "yend")):
                tiles = tiles.where(F.col(axis).between(sizes[a] // self.tile, sizes[b] // self.tile))
        return q.broadcast_if_small(wide, n).join(tiles, on)

    def get_cells(self, points: DataFrame) -> DataFrame:
        """points (query_id, row, col[, t]) with value, 0 outside: a tile is read and one element taken."""
        return q.picked(points, self.join(self.tiles_of(points)), self.keys, self.kind)

    def tiles_of(self, points: DataFrame) -> DataFrame:
        return points.withColumns({f"tile_{x}": int_(F.floor(F.col(x) / self.tile)) for x in ("row", "col")}).where("row >= 0 AND col >= 0")

    @property
    def kind(self):
        return self.tiles.schema["values"].dataType.elementType

    def window(self, xini: int, xend: int, yini: int, yend: int, values: tuple[int, int] | None = None) -> DataFrame:
        """([t,] row, col, value) of one window, and value range: partitions and row groups are
        pruned by constants."""
        near = F.col("tile_row").between(xini // self.tile, xend // self.tile) & F.col("tile_col").between(yini // self.tile, yend // self.tile)
        hits = self.tiles.where(near)
        if values is not None:
            hits = hits.where((F.col("max_value") >= values[0]) & (F.col("min_value") <= values[1]))
        cells = tile_cells(hits, self.keys).where(in_window(F.col("row"), F.col("col"), xini, xend, yini, yend))
        return cells if values is None else cells.where(F.col("value").between(*values))

    def cells_by_value(self, queries: DataFrame) -> DataFrame:
        return q.matching_cells(self.on(queries), self.keys)

    def count_by_value(self, queries: DataFrame) -> DataFrame:
        return q.matching_counts(queries, self.on(queries), self.keys)

    def check(self, queries: DataFrame, strong: bool) -> DataFrame:
        return q.checked(queries, self.on(queries), strong, self.keys)

    def times(self, first: int, last: int) -> TileStore:
        """The steps from first to last."""
        return replace(self, tiles=self.tiles.where(F.col("t").between(first, last)), nodes=self.nodes.where(F.col("t").between(first, last)))


def save(
    tiles: DataFrame, path: str, tile: int = TILE, keys: Sequence[str] = (), region: int = REGION, levels: int = LEVELS, factor: int = FACTOR, buckets: int = 0
) -> TileStore:
    """Store tiles (built with this tile size), their pyramid and their properties below path.

    Tasks are rebalanced by region: small regions share a task, one with many tiles is spread over
    several; within a file tiles lie in Morton order. With buckets, the tiles are a bucketed table."""
    spark, name = tiles.sparkSession, ""
    if buckets:
        name = f"tiles_{uuid.uuid4().hex[:12]}"
        by = [*keys, "tile_row", "tile_col"]
        tiles.repartition(buckets, *by).write.bucketBy(buckets, *by).sortBy(*by).option("path", f"{path}/tiles").saveAsTable(name)
    else:
        at = tiles.withColumn("region", region_of(F.col("tile_row"), F.col("tile_col"), region))
        by = [*keys, "region"]
        order = [*by, morton(F.col("tile_row"), F.col("tile_col"))]
        at.hint("rebalance", *by).sortWithinPartitions(*order).write.partitionBy(*by).parquet(f"{path}/tiles")
    stored = spark.table(name) if buckets else spark.read.parquet(f"{path}/tiles")
    pyramid(stored, levels, factor, keys).write.partitionBy("level").parquet(f"{path}/nodes")
    row = (tile, region, levels, factor, ",".join(keys), name)
    spark.createDataFrame([row], _PROPERTIES).coalesce(1).write.parquet(f"{path}/properties")
    return load(spark, path)


def load(spark: SparkSession, path: str) -> TileStore:
    """A store as it was saved; its tile size and layout are read from its properties. Bucketed
    tiles are found by the name of their table where this session knows it, else by their files."""
    p = spark.read.parquet(f"{path}/properties").first()
    bucketed = bool(p["bucketed"]) and spark.catalog.tableExists(p["bucketed"])
    tiles = spark.table(p["bucketed"]) if bucketed else spark.read.parquet(f"{path}/tiles")
    keys = tuple(k for k in p["keys"].split(",") if k)
    return TileStore(tiles, spark.read.parquet(f"{path}/nodes"), p["tile"], p["region"], p["levels"], p["factor"], keys, bool(p["bucketed"]))
