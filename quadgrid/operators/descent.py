"""Descent of a stored pyramid: batches of queries settle regions at coarse nodes first.

A frontier of (query, node) pairs starts at the top level. Each round joins it to that level's
nodes: a node without a possible match is dropped, one that lies in the window with all values in
the range is taken as it is, and only the others hand their children to the next round. What is
left at the bottom are the tiles to open. Each round is written to a scratch table, so its size is
known before the next one is planned, and lineage stays short.

Checks also end early: a query that a node has settled leaves the frontier at once, and the tiles
that are left are opened in rounds of 1, 2, 4, ... a query, from which settled queries are dropped.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..model import cut, int_
from . import query as q
from .store import TileStore


@dataclass
class Descent:
    """What a descent found, and for each level that it reached how many pairs it looked at, dropped, took and left open."""

    taken: list[DataFrame] = field(default_factory=list)  # query rows with the box of a node that matches as a whole
    failed: list[DataFrame] = field(default_factory=list)  # (query_id) with a node in the window that has no match
    open: DataFrame | None = None  # query rows with the numbers of tiles to open
    levels: list[tuple[int, int, int, int, int]] = field(default_factory=list)


def _query_columns(store: TileStore) -> list[str]:
    return ["query_id", *store.keys, *q.BOUNDS, "valini", "valend"]


def _children(open_: DataFrame, store: TileStore, size: int) -> DataFrame:
    """The children (of `size` cells a side) of open nodes that the window touches."""
    part = F.sequence(F.lit(0), F.lit(store.factor - 1))
    out = open_.withColumn("_i", F.explode(part)).withColumn("_j", F.explode(part))
    out = out.withColumns({"node_row": int_(F.col("node_row") * store.factor + F.col("_i")), "node_col": int_(F.col("node_col") * store.factor + F.col("_j"))})
    touch = (F.col("node_row") * size <= F.col("xend")) & ((F.col("node_row") + 1) * size > F.col("xini"))
    touch &= (F.col("node_col") * size <= F.col("yend")) & ((F.col("node_col") + 1) * size > F.col("yini"))
    return out.where(touch).select(*_query_columns(store), "node_row", "node_col")


def descend(queries: DataFrame, store: TileStore, strong: bool | None = None, full_only: bool = False) -> Descent:
    """strong: None for searches, else the kind of check, whose settled queries leave the frontier.
    full_only: nodes are taken only if every place of their box has a cell."""
    out, columns = Descent(), _query_columns(store)
    size = store.tile * store.factor ** (store.levels - 1)
    frontier = q.touched_tiles(queries, size, store.keys).withColumnsRenamed({"tile_row": "node_row", "tile_col": "node_col"})
    frontier, most = frontier.select(*columns, "node_row", "node_col"), None
    for level in range(store.levels - 1, -1, -1):
        nodes = store.nodes.where(F.col("level") == level).drop("level")
        hits = q.broadcast_if_small(frontier, most).join(nodes, [*store.keys, "node_row", "node_col"]).where(q.touches())
        takes = q.inside() & q.all_match() & (q.full() if full_only else F.lit(True))
        # A check fails by a node without match only if the node has a cell in the window.
        none = ~q.some_may_match() & (q.sure_of_cells() if strong else F.lit(True))
        state = F.when(none, "none").when(takes, "all").otherwise("open")
        hits = cut(hits.select(*columns, "node_row", "node_col", "base_row", "base_col", "h", "w", "n_cells", state.alias("state")), f"level-{level}")
        n = {r["state"]: r["count"] for r in hits.groupBy("state").count().collect()}  # three rows
        if n:
            out.levels.append((level, sum(n.values()), n.get("none", 0), n.get("all", 0), n.get("open", 0)))
        taken, open_ = hits.where("state = 'all'"), hits.where("state = 'open'")
        if strong is None:
            out.taken.append(taken)
        else:
            settled = hits.where("state = 'none'" if strong else "state = 'all'").select("query_id").distinct()
            (out.failed if strong else out.taken).append(settled)
            open_ = open_.join(settled, "query_id", "left_anti")
        if not n.get("open"):  # all pairs are settled: no level below has any
            break
        if level:
            size //= store.factor
            frontier, most = _children(open_, store, size), n.get("open", 0) * store.factor**2
    out.open = open_.select(*columns, F.col("node_row").alias("tile_row"), F.col("node_col").alias("tile_col"))
    return out


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def cells_by_value(queries: DataFrame, store: TileStore) -> DataFrame:
    """(query_id, [t,] row, col): cells of nodes taken whole are counted out, without reading a tile."""
    found = descend(queries, store, full_only=True)
    places = F.explode(F.sequence(F.lit(0), F.col("h").cast("bigint") * F.col("w") - 1))
    whole = _union(found.taken).select("query_id", *store.keys, "base_row", "base_col", "w", places.alias("at"))
    row, col = F.col("base_row") + F.floor(F.col("at") / F.col("w")), F.col("base_col") + F.col("at") % F.col("w")
    whole = whole.select("query_id", *store.keys, int_(row).alias("row"), int_(col).alias("col"))
    return whole.unionByName(q.matching_cells(store.join(found.open), store.keys))


def count_by_value(queries: DataFrame, store: TileStore) -> DataFrame:
    """(query_id, n_cells)"""
    found = descend(queries, store)
    whole = _union(found.taken).select("query_id", F.col("n_cells").cast("bigint").alias("n"))
    part = q.matching_cells(store.join(found.open), store.keys).groupBy("query_id").agg(F.count("*").alias("n"))
    return q.counts_of(queries, whole.unionByName(part))


@dataclass
class Check:
    results: DataFrame  # query_id, result
    opened: int  # tiles unpacked, over all rounds and queries
    levels: list[tuple[int, int, int, int, int]]


def check(queries: DataFrame, store: TileStore, strong: bool) -> Check:
    """Checks by descent; queries leave as soon as they are settled."""
    found = descend(queries, store, strong)
    settled = found.failed if strong else found.taken
    by = Window.partitionBy("query_id").orderBy(*store.keys, "tile_row", "tile_col")
    left = cut(found.open.withColumn("place", F.row_number().over(by)), "open-tiles")
    opened, first, many = 0, 0, 1
    while (n := left.where(F.col("place") <= first + many).count()):
        now = left.where(F.col("place") <= first + many)
        cells = q.unpacked(store.join(now), store.keys)
        match = F.col("value").between(F.col("valini"), F.col("valend"))
        ended = cut(cells.where(~match if strong else match).select("query_id").distinct(), "settled")
        settled.append(ended)
        opened += n
        first, many = first + many, many * 2
        left = cut(left.where(F.col("place") > first).join(ended, "query_id", "left_anti"), "open-tiles")
    over = _union(settled).select("query_id").distinct().withColumn("_over", F.lit(True))
    results = queries.select("query_id").join(over, "query_id", "left").select("query_id", (F.col("_over").isNull() if strong else F.col("_over").isNotNull()).alias("result"))
    return Check(results, opened, found.levels)


def trace(queries: DataFrame, store: TileStore) -> DataFrame:
    """(level, n_pairs, n_none, n_all, n_open) of a search's descent; a level without pairs has no row."""
    rows = descend(queries, store).levels
    return queries.sparkSession.createDataFrame(rows, "level int, n_pairs bigint, n_none bigint, n_all bigint, n_open bigint")
