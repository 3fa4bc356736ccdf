"""Lookups, windows, value searches and checks, for one query or a table of them.

A batch of windows is joined to tiles by tile id: each window is expanded to the tiles that it
touches, so the join is an equi-join however many windows there are. Tiles are pruned on their
least and greatest values before anything is unpacked, and tiles wholly inside a window and a
value range are accepted as they are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.keys import in_window
from ..model import int_
from .tiles import TILE, tile_cells

BOUNDS = ("xini", "xend", "yini", "yend")
#: Query rows (bounds and a few numbers each) up to this count are broadcast to the raster.
BROADCAST_ROWS = 200_000


def get_cell(cells: DataFrame, row: int, col: int) -> DataFrame:
    """The value at a position, 0 outside."""
    return cells.where((F.col("row") == row) & (F.col("col") == col)).agg(F.coalesce(F.max("value"), F.lit(0)).alias("value"))


def get_cell_batch(queries: DataFrame, cells: DataFrame, keys: Sequence[str] = ("row", "col")) -> DataFrame:
    """queries (query_id and keys) with value; 0 outside. The cells are filtered by the points and
    stay where they are; only what was found is joined back to the queries."""
    kind = cells.schema["value"].dataType
    points = queries.select(*keys).distinct()
    found = cells.join(broadcast_if_small(points), list(keys)).select(*keys, "value")
    return queries.join(found, list(keys), "left").select("query_id", *keys, F.coalesce("value", F.lit(0)).cast(kind).alias("value"))


def broadcast_if_small(df: DataFrame, rows: int | None = None) -> DataFrame:
    """df to be broadcast if it has at most BROADCAST_ROWS rows; they are counted unless given."""
    n = df.count() if rows is None else rows
    return F.broadcast(df) if n <= BROADCAST_ROWS else df


def values_window(cells: DataFrame, xini: int, xend: int, yini: int, yend: int) -> DataFrame:
    return cells.where(in_window(F.col("row"), F.col("col"), xini, xend, yini, yend))


def values_window_dense(cells: DataFrame, xini: int, xend: int, yini: int, yend: int) -> DataFrame:
    """(pos, value), pos counting the window's cells row by row."""
    pos = (F.col("row") - xini) * (yend - yini + 1) + F.col("col") - yini
    return values_window(cells, xini, xend, yini, yend).select(int_(pos).alias("pos"), "value")


def window_array(cells: DataFrame, xini: int, xend: int, yini: int, yend: int) -> DataFrame:
    """The window as one array in row order; its length is that of the window."""
    dense = values_window_dense(cells, xini, xend, yini, yend)
    return dense.agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "value"))), lambda x: x["value"]).alias("values"))


def cells_by_value(cells: DataFrame, xini: int, xend: int, yini: int, yend: int, valini: int, valend: int) -> DataFrame:
    """Positions in a window with a value in a range; on stored cells all six bounds reach the Parquet scan."""
    return values_window(cells, xini, xend, yini, yend).where(F.col("value").between(valini, valend)).select("row", "col")


def touched_tiles(queries: DataFrame, tile: int = TILE, keys: Sequence[str] = ()) -> DataFrame:
    """Each query with the numbers of each tile that its window touches (and, with keys ("t",), its times)."""
    ids = lambda a, b: F.explode(F.sequence(int_(F.floor(F.col(a) / tile)), int_(F.floor(F.col(b) / tile))))
    wide = queries.where("xini <= xend AND yini <= yend").withColumn("tile_row", ids("xini", "xend")).withColumn("tile_col", ids("yini", "yend"))
    if "t" in keys:
        wide = wide.where("tini <= tend").withColumn("t", F.explode(F.sequence("tini", "tend")))
    return wide


def windows_on_tiles(queries: DataFrame, tiles: DataFrame, tile: int = TILE, keys: Sequence[str] = ()) -> DataFrame:
    """Each query with each tile that its window touches."""
    return touched_tiles(queries, tile, keys).join(tiles, [*keys, "tile_row", "tile_col"])


def inside() -> Column:
    """The tile (or node) lies wholly in the window."""
    return (
        (F.col("base_row") >= F.col("xini"))
        & (F.col("base_row") + F.col("h") - 1 <= F.col("xend"))
        & (F.col("base_col") >= F.col("yini"))
        & (F.col("base_col") + F.col("w") - 1 <= F.col("yend"))
    )


def touches() -> Column:
    """The tile's box and the window have places in common."""
    return (F.col("base_row") <= F.col("xend")) & (F.col("base_row") + F.col("h") > F.col("xini")) & (F.col("base_col") <= F.col("yend")) & (F.col("base_col") + F.col("w") > F.col("yini"))


def full() -> Column:
    """Every place of the box has its cell."""
    return F.col("n_cells") == F.col("h").cast("bigint") * F.col("w")


def all_match() -> Column:
    return (F.col("min_value") >= F.col("valini")) & (F.col("max_value") <= F.col("valend"))


def some_may_match() -> Column:
    return (F.col("max_value") >= F.col("valini")) & (F.col("min_value") <= F.col("valend"))


def unpacked(hits: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The cells of the given query-tile pairs that lie in the window."""
    carry = ["query_id", *keys, *BOUNDS, "valini", "valend"]
    return tile_cells(hits, carry).where(in_window(F.col("row"), F.col("col"), F.col("xini"), F.col("xend"), F.col("yini"), F.col("yend")))


def matching_cells(hits: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(query_id, [t,] row, col) of every match in query-tile pairs."""
    return unpacked(hits.where(some_may_match()), keys).where(F.col("value").between(F.col("valini"), F.col("valend"))).select("query_id", *keys, "row", "col")


def matching_counts(queries: DataFrame, hits: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(query_id, n_cells); tiles wholly inside window and range are counted without unpacking."""
    hits = hits.where(some_may_match())
    whole = hits.where(inside() & all_match()).select("query_id", F.col("n_cells").cast("bigint").alias("n"))
    part = unpacked(hits.where(~(inside() & all_match())), keys).where(F.col("value").between(F.col("valini"), F.col("valend")))
    return counts_of(queries, whole.unionByName(part.groupBy("query_id").agg(F.count("*").alias("n"))))


def counts_of(queries: DataFrame, found: DataFrame) -> DataFrame:
    """(query_id, n_cells): the sum of found (query_id, n), 0 where there is none."""
    n = found.groupBy("query_id").agg(F.sum("n").alias("n"))
    return queries.select("query_id").join(n, "query_id", "left").select("query_id", F.coalesce("n", F.lit(0)).cast("bigint").alias("n_cells"))


def sure_of_cells() -> Column:
    """The tile has a cell in the window for sure."""
    return touches() & (full() | inside())


def checked(queries: DataFrame, hits: DataFrame, strong: bool, keys: Sequence[str] = ()) -> DataFrame:
    """(query_id, result) from query-tile pairs; see check_batch."""
    decided = sure_of_cells() & ((inside() & all_match()) | ~some_may_match())
    if not strong:  # that a tile has no match says nothing of a weak check, with cells or without
        hits = hits.where(some_may_match())
    sure = hits.where(decided).select("query_id", some_may_match().alias("match"))
    rest = unpacked(hits.where(~decided), keys).select("query_id", F.col("value").between(F.col("valini"), F.col("valend")).alias("match"))
    both = sure.unionByName(rest)
    found = both.groupBy("query_id").agg((F.bool_and if strong else F.bool_or)("match").alias("result"))
    return queries.select("query_id").join(found, "query_id", "left").select("query_id", F.coalesce("result", F.lit(strong)).alias("result"))


def picked(points: DataFrame, hits: DataFrame, keys: Sequence[str], kind) -> DataFrame:
    """points (query_id, row, col and keys) with value, 0 outside; hits has each point beside its tile."""
    r, c = F.col("row") - F.col("base_row"), F.col("col") - F.col("base_col")
    place = F.when((r >= 0) & (r < F.col("h")) & (c >= 0) & (c < F.col("w")), int_(r * F.col("w") + c))
    place = F.when(F.col("positions").isNull(), place).otherwise(F.nullif(F.array_position("positions", place), F.lit(0)) - 1)
    value = F.when(F.col("is_uniform") & place.isNotNull(), F.col("values")[0]).otherwise(F.get("values", place))
    found = hits.select("query_id", value.alias("value"))
    return points.join(found, "query_id", "left").select("query_id", *keys, "row", "col", F.coalesce("value", F.lit(0)).cast(kind).alias("value"))


def cells_by_value_batch(queries: DataFrame, tiles: DataFrame, tile: int = TILE, keys: Sequence[str] = ()) -> DataFrame:
    """(query_id, [t,] row, col) of every match."""
    return matching_cells(windows_on_tiles(queries, tiles, tile, keys), keys)


def count_by_value_batch(queries: DataFrame, tiles: DataFrame, tile: int = TILE, keys: Sequence[str] = ()) -> DataFrame:
    """(query_id, n_cells) of the matches."""
    return matching_counts(queries, windows_on_tiles(queries, tiles, tile, keys), keys)


def check_batch(queries: DataFrame, tiles: DataFrame, strong: bool, tile: int = TILE, keys: Sequence[str] = ()) -> DataFrame:
    """(query_id, result): whether all cells (strong) or any cell (weak) of the window match.

    A window without cells is true for strong and false for weak. Tiles whose least and greatest
    value decide them aren't unpacked.
    """
    return checked(queries, windows_on_tiles(queries, tiles, tile, keys), strong, keys)


def check_window(cells: DataFrame, xini: int, xend: int, yini: int, yend: int, valini: int, valend: int, strong: bool) -> bool:
    """One check, by whether a counter-example (strong) or an example (weak) exists."""
    inside = values_window(cells, xini, xend, yini, yend)
    match = F.col("value").between(valini, valend)
    return inside.where(~match).isEmpty() if strong else not inside.where(match).isEmpty()
