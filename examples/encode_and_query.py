"""Reads a binary raster, stores its tiles, writes all of it as a window and keeps a history of runs.

    spark-submit examples/encode_and_query.py raster.bin 640 640 OUT
"""

import sys

from pyspark.sql import SparkSession

from quadgrid.operators import measure, store, tiles
from quadgrid.sources import files


def main(path: str, n_rows: str, n_cols: str, out: str) -> None:
    spark = SparkSession.builder.getOrCreate()
    rows, cols = int(n_rows), int(n_cols)
    cells = files.read_raster(spark, path, rows, cols)
    built = measure.timed("encode", tiles.build_tiles(cells), write=lambda df: store.save(df, f"{out}/raster"))
    everything = spark.createDataFrame([(0, 0, rows - 1, 0, cols - 1)], "query_id long, xini int, xend int, yini int, yend int")
    window = store.load(spark, f"{out}/raster").window(0, rows - 1, 0, cols - 1).selectExpr("0L AS query_id", "row", "col", "value")
    got = measure.timed("window", window, write=lambda df: files.write_windows(df, everything, f"{out}/window"))
    measure.remember(spark, f"{out}/history", built, got)
    measure.history(spark, f"{out}/history").show(truncate=False)


if __name__ == "__main__":
    main(*sys.argv[1:])
