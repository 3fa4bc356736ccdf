"""New time steps as a stream: files of cells (t, row, col, value) become tiles by time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..model import CELLS_T
from ..operators.tiles import TILE, build_tiles, write_tiles


def append_steps(spark: SparkSession, source: str, target: str, checkpoint: str, tile: int = TILE):
    """Start the stream; each micro-batch writes its time steps below a partition of its own, so a
    batch that runs again replaces what it wrote. A step that comes in two batches has tiles in
    both, each with the cells of its batch; `tiles.merge_parts(..., order="batch")` makes one of them."""

    def write(batch: DataFrame, number: int) -> None:
        write_tiles(build_tiles(batch, tile, ["t"]), f"{target}/batch={number}", ["t"])

    cells = spark.readStream.schema(CELLS_T).parquet(source)
    return cells.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
