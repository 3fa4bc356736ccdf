"""The registered queries and their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import model as m
from ..functions.keys import color_ramp
from ..operators import algebra, coded, delta_store, descent, measure, query, series, stats, store, tiles, workload
from ..sources import files

_W = (40, 160, 8, 40)  # the window of the single queries
LEVELS = 4


_STORES: dict[tuple, object] = {}


def _once(s, d, name: str, make):
    """What make(folder) stores, which a session writes once and then queries often."""
    key = (s.sparkContext.applicationId, d, name)
    if key not in _STORES:
        _STORES[key] = make(m.scratch(s, name))
    return _STORES[key]


def stored(s, d, name: str) -> store.TileStore:
    """A raster's tile store."""
    cells, tile, keys, region = {
        "embeddings": (m.embedding_cells, tiles.TILE, (), 8),
        "demand": (m.demand_cells, 8, (), 2),
        "events": (m.event_cells, 8, ("t",), 4),
        "small_events": (m.event_cells, 2, ("t",), 16),
    }[name]
    return _once(s, d, name, lambda path: store.save(tiles.build_tiles(cells(s, d), tile, keys), path, tile, keys, region))


def _deltas(s, d) -> delta_store.DeltaStore:
    """The events' series by a snapshot every four steps."""
    at = stored(s, d, "small_events").tiles
    return _once(s, d, "deltas", lambda path: delta_store.save(at, series.snapshot_steps(at, 4), path, 2, 16))


def _coded(s, d) -> coded.CodedBlocks:
    """The zone series in blocks of 2 x 2, by the vocabulary of all its steps."""
    blocks = lambda: tiles.build_tiles(m.zone_series(s, d), 2, ["t"])
    return _once(s, d, "coded", lambda path: coded.save(coded.encode(blocks(), 2, ["t"]), path))


def _sink(s, d):
    """All windows of the batch, written as part files and read again."""
    q, path = m.region_queries(s), m.scratch(s, "windows")
    cells = query.unpacked(stored(s, d, "demand").on(q), ()).select("query_id", "row", "col", "value")
    files.write_windows(cells, q, path, 500)
    return files.read_windows(s, path)


def _text_file(lines, path: str) -> str:
    """The one text file of lines (order, value)."""
    lines.coalesce(1).sortWithinPartitions("order").select("value").write.text(path)
    return lines.sparkSession.read.text(path).inputFiles()[0]


def _manifest(s, d):
    """The series as a binary file for each step, named by a manifest and read as one scan."""
    e, folder = m.EVENTS, m.scratch(s, "steps")
    whole = s.range(e.n_times).select(F.col("id").alias("query_id"), F.lit(0).alias("xini"), F.lit(e.n_rows - 1).alias("xend"), F.lit(0).alias("yini"), F.lit(e.n_cols - 1).alias("yend"))
    cells = m.event_cells(s, d).select(F.col("t").cast("bigint").alias("query_id"), "row", "col", "value")
    files.write_windows(cells, whole, folder, e.n_rows * e.n_cols)
    names = [x.rpartition("/")[2] for x in files.window_files(s, folder)]
    lines = s.createDataFrame(list(enumerate([f"{e.n_rows} {e.n_cols} 2 2 0 0", *names])), "order int, value string")
    return files.read_manifest(s, _text_file(lines, f"{folder}/list"), folder)


def _ascii(s, d):
    """A raster's quarters as an ASCII grid, read at scale 2: 25 times the raster."""
    lines = m.demand_cells(s, d).groupBy("row").agg(F.transform(F.array_sort(F.collect_list(F.struct("col", "value"))), lambda x: (x["value"] / 4).cast("string")).alias("v"))
    lines = lines.select(F.col("row").alias("order"), F.array_join("v", " ").alias("value"))
    head = [f"ncols {m.DEMAND.n_cols}", f"nrows {m.DEMAND.n_rows}", "xllcorner 0", "yllcorner 0", "cellsize 1", "NODATA_value -9999"]
    header = s.createDataFrame([(i - len(head), x) for i, x in enumerate(head)], "order int, value string")
    return files.read_asc(s, _text_file(header.unionByName(lines), m.scratch(s, "grid")), 2)


def _query_file(s, d):
    """The batch's queries as a text file with their number in its first line."""
    q = m.region_queries(s)
    lines = q.select(F.col("query_id").cast("int").alias("order"), F.concat_ws(" ", "xini", "xend", "yini", "yend", "valini", "valend").alias("value"))
    lines = lines.unionByName(q.agg(F.lit(-1).alias("order"), F.count("*").cast("string").alias("value")))
    read = files.read_regions(s, _text_file(lines, m.scratch(s, "queries")), values=True, header=True)
    return stored(s, d, "demand").cells_by_value(read.withColumn("query_id", F.col("query_id") - 1))


def _history(s, d):
    """A batch is timed and counted, remembered, and read from the history."""
    path, q = m.scratch(s, "history"), m.region_queries(s)
    found = stored(s, d, "demand")
    measure.remember(s, path, measure.timed("search", found.cells_by_value(q), 64), measure.timed("count", found.count_by_value(q), 64))
    return measure.history(s, path).select("name", "n_queries", "n_rows", "n_cells")


def _tiles(cells, tile=tiles.TILE):
    return tiles.build_tiles(cells, tile)


def _summary(s, d):
    strong = stored(s, d, "demand").check(m.region_queries(s), True)
    return strong.agg(F.count_if("result").alias("n_true"), F.count_if(~F.col("result")).alias("n_false"))


def _ts_dense(s, d):
    c = m.event_cells(s, d).where(F.col("t").between(3, 9))
    return query.values_window(c, 2, 9, 5, 17)


def _ts_points(s):
    i = F.col("id")
    return s.range(200).select(i.alias("query_id"), m.int_(i * 7 % 33).alias("t"), m.int_(i * 5 % 18).alias("row"), m.int_(i * 11 % 26).alias("col"))


def _roundtrip(s, d):
    cells = m.embedding_cells(s, d)
    return tiles.mismatches(cells, tiles.tile_cells(_tiles(cells))).agg(F.count("*").alias("n_mismatch"))


def _zigzag(s, d):
    return series.zigzag_deltas(series.snapshot_deltas(m.event_cells(s, d), 4))


def _fixed(s, d):
    o = s.read.parquet(f"{d}/orders.parquet")
    points = o.select(F.col("o_orderkey").cast("bigint").alias("query_id"), m.int_(F.col("o_orderkey") % 64).alias("row"), m.int_(F.col("o_custkey") % 64).alias("col"))
    return workload.fixed_windows(points, m.DEMAND, 9, 5)


def _children(s, d):
    return tiles.children(tiles.pyramid(_tiles(m.demand_cells(s, d), 8), LEVELS))


def _encoded(s, d):
    zones = m.label_zones(s, d)
    return stats.encode_blocks(zones, stats.dictionary_blocks(zones, 2), 2)


def _decoded(s, d):
    zones = m.label_zones(s, d)
    dictionary = stats.dictionary_blocks(zones, 2)
    return stats.decode_blocks(stats.encode_blocks(zones, dictionary, 2), dictionary, 2, m.EMBEDDING_COLS)


def _ts_window(s, d):
    return series.window(series.snapshot_deltas(m.event_cells(s, d), 4), 2, 9, 5, 17, 3, 9)


def _pointwise(op):
    return lambda s, d: algebra.pointwise(m.demand_cells(s, d), m.supply_cells(s, d), op)


QUERIES = {
    "raster_info": lambda s, d: tiles.info(m.embedding_cells(s, d)),
    "get_cell_batch": lambda s, d: stored(s, d, "embeddings").get_cells(m.access_queries(s)),
    "get_cell_total": lambda s, d: stored(s, d, "embeddings").get_cells(m.access_queries(s)).agg(m.long_(F.sum("value")).alias("total")),
    "values_window": lambda s, d: query.values_window(m.embedding_cells(s, d, _W[:2]), *_W),
    "values_window_dense": lambda s, d: query.values_window_dense(m.embedding_cells(s, d, _W[:2]), *_W),
    "cells_by_value": lambda s, d: query.cells_by_value(m.embedding_cells(s, d, _W[:2]), *_W, 50, 200),
    "stored_cells_by_value": lambda s, d: stored(s, d, "embeddings").window(*_W, (50, 200)),
    "cells_by_value_batch": lambda s, d: stored(s, d, "demand").cells_by_value(m.region_queries(s)),
    "cells_by_value_count": lambda s, d: stored(s, d, "demand").count_by_value(m.region_queries(s)),
    "check_strong_batch": lambda s, d: stored(s, d, "demand").check(m.region_queries(s), True),
    "check_weak_batch": lambda s, d: stored(s, d, "demand").check(m.region_queries(s), False),
    "check_summary": _summary,
    "descent_cells_by_value": lambda s, d: descent.cells_by_value(m.large_queries(s), stored(s, d, "demand")),
    "descent_count": lambda s, d: descent.count_by_value(m.large_queries(s), stored(s, d, "demand")),
    "descent_check_strong": lambda s, d: descent.check(m.large_queries(s), stored(s, d, "demand"), True).results,
    "descent_check_weak": lambda s, d: descent.check(m.large_queries(s), stored(s, d, "demand"), False).results,
    "descent_levels": lambda s, d: descent.trace(m.large_queries(s), stored(s, d, "demand")),
    "ts_descent_cells_by_value": lambda s, d: descent.cells_by_value(m.series_queries(s), stored(s, d, "events")),
    "tile_stats": lambda s, d: _tiles(m.embedding_cells(s, d)).select("tile_row", "tile_col", "min_value", "max_value", "is_uniform", "n_cells"),
    "last_level": lambda s, d: tiles.last_level(_tiles(m.demand_cells(s, d), 8)),
    "pyramid": lambda s, d: tiles.pyramid(_tiles(m.demand_cells(s, d), 8), LEVELS).select("level", "node_row", "node_col", "min_value", "max_value"),
    "pyramid_children": _children,
    "algebra_sum": _pointwise("sum"),
    "algebra_sub": _pointwise("sub"),
    "algebra_mul": _pointwise("mul"),
    "algebra_tiles_sum": lambda s, d: tiles.tile_cells(algebra.pointwise_tiles(_tiles(m.embedding_cells(s, d)), _tiles(m.label_zones(s, d)), "sum")),
    "algebra_tiles_unequal": lambda s, d: tiles.tile_cells(algebra.pointwise_tiles(_tiles(m.demand_cells(s, d), 10), _tiles(m.supply_cells(s, d), 10), "mul")),
    "scalar_sum": lambda s, d: algebra.scalar(m.embedding_cells(s, d), 17, "sum"),
    "scalar_sub": lambda s, d: algebra.scalar(m.embedding_cells(s, d), 17, "sub"),
    "scalar_mul": lambda s, d: algebra.scalar(m.embedding_cells(s, d), -3, "mul"),
    "scalar_tiles_mul": lambda s, d: algebra.scalar_tiles(_tiles(m.embedding_cells(s, d)), -3, "mul").select("tile_row", "tile_col", "min_value", "max_value"),
    "threshold": lambda s, d: algebra.threshold(m.embedding_cells(s, d), 100),
    "threshold_tiles": lambda s, d: tiles.tile_cells(algebra.threshold_tiles(_tiles(m.demand_cells(s, d), 4), 30)),
    "threshold_pct": lambda s, d: algebra.ones_percent(algebra.threshold(m.embedding_cells(s, d), 100)),
    "zonal_totals": lambda s, d: algebra.zonal_totals(m.embedding_cells(s, d), m.label_zones(s, d)),
    "zonal_tiles_sum": lambda s, d: tiles.tile_cells(algebra.zonal_sum_tiles(_tiles(m.embedding_cells(s, d)), _tiles(m.label_zones(s, d)))),
    "zonal_tiles_totals": lambda s, d: algebra.zonal_totals_tiles(_tiles(m.demand_cells(s, d), 8), _tiles(m.supply_zones(s, d), 8)),
    "zonal_tiles_cases": lambda s, d: algebra.zonal_pairs(_tiles(m.supply_zones(s, d), 16), _tiles(m.demand_zones(s, d), 16)),
    "zonal_sum": lambda s, d: algebra.zonal_sum(m.embedding_cells(s, d), m.label_zones(s, d)),
    "weighted_sum": lambda s, d: algebra.weighted_sum(_tiles(m.supply_cells(s, d), 2)),
    "ts_get_cell": lambda s, d: stored(s, d, "events").get_cells(_ts_points(s)),
    "ts_values_window": _ts_dense,
    "ts_cells_by_value": lambda s, d: stored(s, d, "events").cells_by_value(m.series_queries(s)),
    "ts_check_strong": lambda s, d: stored(s, d, "events").check(m.series_queries(s), True),
    "ts_check_weak": lambda s, d: stored(s, d, "events").check(m.series_queries(s), False),
    "ts_info": lambda s, d: series.info(m.event_cells(s, d)),
    "ts_delta_snapshot": lambda s, d: series.snapshot_deltas(m.event_cells(s, d), 4),
    "ts_delta_zigzag": _zigzag,
    "ts_reconstruct": lambda s, d: series.reconstruct(series.snapshot_deltas(m.event_cells(s, d), 4)),
    "ts_delta_window": _ts_window,
    "ts_delta_cells_by_value": lambda s, d: _ts_window(s, d).where(F.col("value").between(1, 2)).select("t", "row", "col"),
    "ts_delta_get_cell": lambda s, d: _deltas(s, d).get_cells(_ts_points(s)),
    "ts_delta_batch": lambda s, d: _deltas(s, d).cells_by_value(m.series_queries(s)),
    "ts_delta_count": lambda s, d: _deltas(s, d).count_by_value(m.series_queries(s)),
    "ts_delta_check_strong": lambda s, d: _deltas(s, d).check(m.series_queries(s), True),
    "ts_delta_check_weak": lambda s, d: _deltas(s, d).check(m.series_queries(s), False),
    "ts_delta_settled": lambda s, d: _deltas(s, d).settled(m.series_queries(s)),
    "ts_snapshot_costs": lambda s, d: delta_store.step_costs(stored(s, d, "events").tiles, 6),
    "ts_optimal_snapshots": lambda s, d: delta_store.optimal_snapshots(stored(s, d, "events").tiles, 6),
    "coded_vocabulary": lambda s, d: _coded(s, d).vocabulary.select("codeword", F.array_join(F.col("word").cast("array<string>"), ",").alias("word"), "n"),
    "coded_cells": lambda s, d: _coded(s, d).cells(),
    "coded_cells_by_value": lambda s, d: _coded(s, d).cells_by_value(m.zone_queries(s)),
    "coded_get_cell": lambda s, d: _coded(s, d).get_cells(_ts_points(s)),
    "coded_settled": lambda s, d: _coded(s, d).settled(m.zone_queries(s)),
    "ts_verify": lambda s, d: series.verify(m.event_cells(s, d), series.snapshot_deltas(m.event_cells(s, d), 4)),
    "ts_adaptive_snapshots": lambda s, d: series.adaptive_snapshots(m.event_cells(s, d), 0.4),
    "value_frequency": lambda s, d: stats.value_frequency(m.event_cells(s, d)),
    "value_entropy": lambda s, d: stats.entropy(stats.value_frequency(m.event_cells(s, d))).select(F.round("entropy", 6).alias("entropy")),
    "block_frequency": lambda s, d: stats.block_frequency(m.event_cells(s, d), 2, ["t"]),
    "dictionary_blocks": lambda s, d: stats.dictionary_blocks(m.zone_series(s, d), 2, ["t"]),
    "dictionary_blocks_zones": lambda s, d: stats.dictionary_blocks(m.label_zones(s, d), 2),
    "encoded_blocks_zones": _encoded,
    "decoded_blocks_zones": _decoded,
    "block_mean_levels": lambda s, d: stats.block_means(m.demand_cells(s, d), (2, 4, 8, 16, 32, 64)),
    "block_mean": lambda s, d: stats.block_mean(m.demand_cells(s, d), 8),
    "color_ramp": lambda s, d: m.demand_cells(s, d).select("row", "col", *[c.alias(k) for k, c in color_ramp(F.col("value")).items()]),
    "verify_roundtrip": _roundtrip,
    "fixed_windows": _fixed,
    "file_windows": _sink,
    "file_manifest": _manifest,
    "file_ascii": _ascii,
    "file_queries": _query_file,
    "run_history": _history,
}

# The derived rasters in DuckDB; each query's WITH takes the ones it needs.
_CTE = {
    "emb": """emb AS (SELECT cast(vec_id AS INTEGER) AS "row", cast(i - 1 AS INTEGER) AS col, cast(floor(cast(embedding[i] AS DOUBLE) * 1000) AS INTEGER) AS value
        FROM (SELECT *, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings))""",
    "zones": """zones AS (SELECT cast(vec_id AS INTEGER) AS "row", cast(i - 1 AS INTEGER) AS col, label AS value
        FROM (SELECT *, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings))""",
    "demand": """demand AS (SELECT cast(a.i AS INTEGER) AS "row", cast(b.i AS INTEGER) AS col, cast(coalesce(v, 0) AS BIGINT) AS value
        FROM range(64) a(i) CROSS JOIN range(64) b(i) LEFT JOIN (SELECT l_partkey % 64 AS x, (l_orderkey // 7) % 64 AS y, cast(sum(l_quantity) AS BIGINT) AS v FROM lineitem GROUP BY 1, 2) ON x = a.i AND y = b.i)""",
    "supply": """supply AS (SELECT cast(a.i AS INTEGER) AS "row", cast(b.i AS INTEGER) AS col, cast(coalesce(v, 0) AS BIGINT) AS value
        FROM range(64) a(i) CROSS JOIN range(48) b(i) LEFT JOIN (SELECT l_partkey % 64 AS x, l_suppkey % 48 AS y, count(*) AS v FROM lineitem GROUP BY 1, 2) ON x = a.i AND y = b.i)""",
    "ev": """ev AS (SELECT cast(t.i AS INTEGER) AS t, cast(a.i AS INTEGER) AS "row", cast(b.i AS INTEGER) AS col, cast(coalesce(v, 0) AS BIGINT) AS value
        FROM range(31) t(i) CROSS JOIN range(16) a(i) CROSS JOIN range(24) b(i) LEFT JOIN (SELECT day(ts) - 1 AS z, user_id % 16 AS x, hour(ts) AS y, count(*) AS v FROM events GROUP BY 1, 2, 3) ON z = t.i AND x = a.i AND y = b.i)""",
    "q": """q AS (SELECT i AS query_id, i * 7 % 64 AS xini, least(63, i * 7 % 64 + i % 9) AS xend, i * 13 % 64 AS yini, least(63, i * 13 % 64 + i % 5) AS yend,
        CASE WHEN i % 8 = 0 THEN 0 ELSE i * 17 % 400 END AS valini, CASE WHEN i % 8 = 0 THEN 100000 ELSE i * 17 % 400 + 20 + i * 5 % 200 END AS valend FROM range(64) r(i))""",
    "lq": """lq AS (SELECT i AS query_id, i * 5 % 24 AS xini, i * 5 % 24 + 8 + i % 5 * 7 AS xend, i * 11 % 20 AS yini, i * 11 % 20 + 6 + i % 7 * 6 AS yend,
        CASE i % 3 WHEN 0 THEN i * 3 WHEN 1 THEN 0 ELSE i * 9 END AS valini, CASE i % 3 WHEN 0 THEN i * 3 + 12 WHEN 1 THEN 100000 ELSE i * 9 + 60 END AS valend FROM range(48) r(i))""",
    "tq": """tq AS (SELECT i AS query_id, i * 7 % 16 AS xini, least(15, i * 7 % 16 + i % 4) AS xend, i * 13 % 24 AS yini, least(23, i * 13 % 24 + i % 5) AS yend,
        i % 30 AS tini, least(29, i % 30 + i % 6) AS tend, CASE WHEN i % 4 = 0 THEN 0 ELSE i % 3 END AS valini, CASE WHEN i % 4 = 0 THEN 1000 ELSE i % 3 + 1 END AS valend FROM range(32) r(i))""",
    "zs": """zs AS (SELECT cast(vec_id % 4 AS INTEGER) AS t, cast(vec_id // 4 AS INTEGER) AS "row", cast(i - 1 AS INTEGER) AS col, cast(label AS BIGINT) AS value
        FROM (SELECT *, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings))""",
    "zq": """zq AS (SELECT i AS query_id, i * 7 % 110 AS xini, i * 7 % 110 + i % 9 AS xend, i * 13 % 60 AS yini, i * 13 % 60 + i % 7 AS yend, i % 4 AS tini, least(3, i % 4 + i % 2) AS tend,
        CASE WHEN i % 5 = 0 THEN 0 ELSE i % 8 END AS valini, CASE WHEN i % 5 = 0 THEN 1000 ELSE i % 8 + i % 3 END AS valend FROM range(40) r(i))""",
    # Blocks of 2 x 2 cells as their greatest value and how far each cell lies below it.
    "zb": """zb AS (SELECT t, "row" // 2 AS block_row, col // 2 AS block_col, max(value) AS top, min(value) AS low, count(*) AS size, list(value ORDER BY "row", col) AS v FROM zs GROUP BY 1, 2, 3)""",
    "zw": """zw AS (SELECT *, array_to_string([top - x for x in v], ',') AS word FROM zb)""",
    "zvoc": """zf AS (SELECT word, count(*) AS n, max(size) AS size FROM zw GROUP BY 1),
        zhw AS (SELECT log2(sum(n)) - sum(n * log2(n)) / sum(n) AS h FROM (SELECT cast(n AS DOUBLE) AS n FROM zf)),
        zhv AS (SELECT log2(sum(n)) - sum(n * log2(n)) / sum(n) AS h FROM (SELECT cast(count(*) AS DOUBLE) AS n FROM (SELECT top - unnest(v) AS x FROM zb) GROUP BY x)),
        zvoc AS (SELECT row_number() OVER (ORDER BY n DESC, word) AS codeword, word, n FROM zf, zhw, zhv WHERE floor(32 * size + n * zhw.h) <= floor(n * size * zhv.h))""",
    # Tiles of 8 x 8 at each step and as differences from every other step up to six before.
    "bits": """tile_bits AS (SELECT t, t AS snap_t, "row" // 8 AS a, col // 8 AS b, 64 + count(*) * CASE WHEN max(value) = min(value) THEN 0 ELSE length(bin(max(value) - min(value))) END AS n FROM ev GROUP BY 1, 3, 4
        UNION ALL SELECT e.t, s.t, e."row" // 8, e.col // 8, 64 + count(*) * CASE WHEN max(e.value - s.value) = min(e.value - s.value) THEN 0 ELSE length(bin(max(e.value - s.value) - min(e.value - s.value))) END
        FROM ev e JOIN ev s ON s.t BETWEEN e.t - 6 AND e.t - 1 AND s."row" = e."row" AND s.col = e.col GROUP BY 1, 2, 3, 4),
        bits AS (SELECT t, snap_t, cast(sum(n) AS BIGINT) AS bits FROM tile_bits GROUP BY 1, 2)""",
    "points": """points AS (SELECT i AS query_id, cast(i * 37 % 508 AS INTEGER) AS "row", cast(i * 11 % 68 AS INTEGER) AS col FROM range(200) r(i))""",
    "delta": """delta AS (SELECT e.t, cast(e.t - e.t % 4 AS INTEGER) AS snap_t, e."row", e.col, cast(CASE WHEN e.t % 4 = 0 THEN e.value ELSE e.value - s.value END AS BIGINT) AS delta
        FROM ev e JOIN ev s ON s.t = e.t - e.t % 4 AND s."row" = e."row" AND s.col = e.col)""",
    "szones": """szones AS (SELECT "row", col, cast(floor(avg(value) OVER (PARTITION BY "row" // 8, col // 8)) AS BIGINT) AS value FROM supply)""",
    "dzones": """dzones AS (SELECT "row", col, cast(floor(avg(value) OVER (PARTITION BY "row" // 32, col // 32) / 4) AS BIGINT) AS value FROM demand)""",
    "nodes": """nodes AS (SELECT cast(l.i AS INTEGER) AS level, cast(("row" // 8) // cast(2 ** l.i AS INTEGER) AS INTEGER) AS node_row, cast((col // 8) // cast(2 ** l.i AS INTEGER) AS INTEGER) AS node_col,
        min(value) AS min_value, max(value) AS max_value FROM demand CROSS JOIN range(4) l(i) GROUP BY 1, 2, 3)""",
    "blocks": """blocks AS (SELECT string_agg(cast(value AS VARCHAR), ',' ORDER BY "row", col) AS block, count(*) AS size FROM ev GROUP BY t, "row" // 2, col // 2)""",
}


def _sql(needs: str, body: str) -> str:
    return "WITH " + ",\n".join(_CTE[n] for n in needs.split()) + "\n" + body


_IN_W = '"row" BETWEEN 40 AND 160 AND col BETWEEN 8 AND 40'
_MATCH = '"row" BETWEEN xini AND xend AND col BETWEEN yini AND yend'
_CELL = 'SELECT query_id, p."row", p.col, coalesce(value, 0) AS value FROM points p LEFT JOIN emb USING ("row", col)'


def _check(on: str, cells: str, agg: str, empty: str, extra: str = "") -> str:
    return f"SELECT query_id, coalesce({agg}(value BETWEEN valini AND valend), {empty}) AS result FROM {on} LEFT JOIN {cells} ON {_MATCH}{extra} GROUP BY query_id"


def _algebra(op: str) -> str:
    return _sql("demand supply", f'SELECT a."row", a.col, a.value {op} b.value AS value FROM demand a JOIN supply b ON a."row" = b."row" AND a.col = b.col')


_TIME = " AND t BETWEEN tini AND tend"
_ZONE_STATE = "CASE WHEN top < valini OR low > valend THEN 'none' WHEN low >= valini AND top <= valend THEN 'all' ELSE 'open' END"
ORACLES = {
    "file_windows": _sql(
        "demand q",
        f"""SELECT cast(b + ("row" - xini) * (yend - yini + 1) + col - yini AS BIGINT) AS place, cast(value AS INTEGER) AS value FROM
        (SELECT *, coalesce(sum((xend - xini + 1) * (yend - yini + 1)) OVER (ORDER BY query_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM q) JOIN demand ON {_MATCH}""",
    ),
    "file_manifest": _sql("ev", 'SELECT t, "row", col, cast(value AS INTEGER) AS value FROM ev'),
    "file_ascii": _sql("demand", 'SELECT "row", col, cast(value * 25 AS INTEGER) AS value FROM demand'),
    "file_queries": _sql("demand q", f'SELECT query_id, "row", col FROM q JOIN demand ON {_MATCH} AND value BETWEEN valini AND valend'),
    "run_history": _sql(
        "demand q",
        f"""SELECT 'search' AS name, cast(64 AS BIGINT) AS n_queries, count(*) AS n_rows, count(*) AS n_cells FROM q JOIN demand ON {_MATCH} AND value BETWEEN valini AND valend
        UNION ALL SELECT 'count', 64, 64, count(*) FROM q JOIN demand ON {_MATCH} AND value BETWEEN valini AND valend""",
    ),
    "ts_delta_get_cell": _sql(
        "ev",
        'SELECT i AS query_id, cast(i * 7 % 33 AS INTEGER) AS t, cast(i * 5 % 18 AS INTEGER) AS "row", cast(i * 11 % 26 AS INTEGER) AS col, coalesce(value, 0) AS value FROM range(200) r(i) LEFT JOIN ev ON t = i * 7 % 33 AND "row" = i * 5 % 18 AND col = i * 11 % 26',
    ),
    "ts_delta_batch": _sql("ev tq", f'SELECT query_id, t, "row", col FROM tq JOIN ev ON {_MATCH}{_TIME} AND value BETWEEN valini AND valend'),
    "ts_delta_count": _sql("ev tq", f"SELECT query_id, count(value) AS n_cells FROM tq LEFT JOIN ev ON {_MATCH}{_TIME} AND value BETWEEN valini AND valend GROUP BY query_id"),
    "ts_delta_check_strong": _sql("ev tq", _check("tq", "ev", "bool_and", "true", _TIME)),
    "ts_delta_check_weak": _sql("ev tq", _check("tq", "ev", "bool_or", "false", _TIME)),
    # The bounds of a tile are those of its snapshot's tile and of its differences, added.
    "ts_delta_settled": _sql(
        "ev delta tq",
        """, tb AS (SELECT t, snap_t, "row" // 2 AS a, col // 2 AS b, min(delta) AS lo, max(delta) AS hi FROM delta GROUP BY 1, 2, 3, 4),
        tv AS (SELECT x.t, x.snap_t, x.a, x.b, x.lo + CASE WHEN x.t = x.snap_t THEN 0 ELSE s.lo END AS lo, x.hi + CASE WHEN x.t = x.snap_t THEN 0 ELSE s.hi END AS hi
            FROM tb x JOIN tb s ON s.t = x.snap_t AND s.a = x.a AND s.b = x.b),
        p AS (SELECT t <> snap_t AS relative, hi < valini OR lo > valend AS none, lo >= valini AND hi <= valend AND a * 2 >= xini AND a * 2 + 1 <= xend AND b * 2 >= yini AND b * 2 + 1 <= yend AS whole
            FROM tv JOIN tq ON t BETWEEN tini AND tend AND a * 2 <= xend AND a * 2 + 1 >= xini AND b * 2 <= yend AND b * 2 + 1 >= yini)
        SELECT relative, count(*) AS n_pairs, count(*) FILTER (WHERE none) AS n_none, count(*) FILTER (WHERE whole AND NOT none) AS n_all FROM p GROUP BY 1""",
    ).replace("\n, tb", ", tb"),
    "ts_snapshot_costs": _sql("ev bits", "SELECT * FROM bits"),
    # The cheapest way to each step, from the ways to the steps before; then back along the choices.
    "ts_optimal_snapshots": _sql(
        "ev bits",
        """, seg AS (SELECT cast(snap_t AS INTEGER) AS s, cast(t AS INTEGER) AS j, cast(sum(bits) OVER (PARTITION BY snap_t ORDER BY t) AS BIGINT) AS c FROM bits),
        dp AS (SELECT -1 AS j, [0::BIGINT] AS best, []::INTEGER[] AS pick
            UNION ALL SELECT dp.j + 1, list_append(any_value(best), min(best[s + 1] + c)), list_append(any_value(pick), -(min(struct_pack(c := best[s + 1] + c, s := -s))).s) FROM dp JOIN seg ON seg.j = dp.j + 1 GROUP BY dp.j),
        picks AS (SELECT pick FROM dp ORDER BY j DESC LIMIT 1),
        back AS (SELECT cast(len(pick) - 1 AS INTEGER) AS j, pick FROM picks UNION ALL SELECT cast(pick[j + 1] - 1 AS INTEGER), pick FROM back WHERE pick[j + 1] > 0)
        SELECT t, t = snap_t AS is_snapshot, snap_t, bits FROM bits JOIN back ON snap_t = pick[j + 1] AND t <= j""",
    ).replace("\n, seg", ", seg").replace("WITH ", "WITH RECURSIVE ", 1),
    "coded_vocabulary": _sql("zs zb zw zvoc", "SELECT codeword, word, n FROM zvoc"),
    "coded_cells": _sql("zs", "SELECT * FROM zs"),
    "coded_cells_by_value": _sql("zs zq", f'SELECT query_id, t, "row", col FROM zq JOIN zs ON {_MATCH}{_TIME} AND value BETWEEN valini AND valend'),
    "coded_get_cell": _sql(
        "zs",
        'SELECT i AS query_id, cast(i * 7 % 33 AS INTEGER) AS t, cast(i * 5 % 18 AS INTEGER) AS "row", cast(i * 11 % 26 AS INTEGER) AS col, coalesce(value, 0) AS value FROM range(200) r(i) LEFT JOIN zs ON t = i * 7 % 33 AND "row" = i * 5 % 18 AND col = i * 11 % 26',
    ),
    "coded_settled": _sql(
        "zs zb zw zvoc zq",
        f"""SELECT zvoc.word IS NOT NULL AS coded, count(*) AS n_pairs, count(*) FILTER (WHERE {_ZONE_STATE} = 'none') AS n_none, count(*) FILTER (WHERE {_ZONE_STATE} = 'all') AS n_all, count(*) FILTER (WHERE {_ZONE_STATE} = 'open') AS n_open
        FROM zw LEFT JOIN zvoc USING (word) JOIN zq ON t BETWEEN tini AND tend AND block_row * 2 <= xend AND block_row * 2 + 1 >= xini AND block_col * 2 <= yend AND block_col * 2 + 1 >= yini GROUP BY 1""",
    ),
    "raster_info": _sql("emb", 'SELECT cast(max("row") + 1 AS INTEGER) AS n_rows, cast(max(col) + 1 AS INTEGER) AS n_cols, count(*) AS n_cells, min(value) AS min_value, max(value) AS max_value FROM emb'),
    "get_cell_batch": _sql("points emb", _CELL),
    "get_cell_total": _sql("points emb", f"SELECT cast(sum(value) AS BIGINT) AS total FROM ({_CELL})"),
    "values_window": _sql("emb", f'SELECT "row", col, value FROM emb WHERE {_IN_W}'),
    "values_window_dense": _sql("emb", f'SELECT cast(("row" - 40) * 33 + col - 8 AS INTEGER) AS pos, value FROM emb WHERE {_IN_W}'),
    "cells_by_value": _sql("emb", f'SELECT "row", col FROM emb WHERE {_IN_W} AND value BETWEEN 50 AND 200'),
    "cells_by_value_batch": _sql("demand q", f'SELECT query_id, "row", col FROM q JOIN demand ON {_MATCH} AND value BETWEEN valini AND valend'),
    "cells_by_value_count": _sql("demand q", f"SELECT query_id, count(value) AS n_cells FROM q LEFT JOIN demand ON {_MATCH} AND value BETWEEN valini AND valend GROUP BY query_id"),
    "check_strong_batch": _sql("demand q", _check("q", "demand", "bool_and", "true")),
    "check_weak_batch": _sql("demand q", _check("q", "demand", "bool_or", "false")),
    "check_summary": _sql("demand q", f"SELECT count(*) FILTER (WHERE result) AS n_true, count(*) FILTER (WHERE NOT result) AS n_false FROM ({_check('q', 'demand', 'bool_and', 'true')})"),
    "stored_cells_by_value": _sql("emb", f'SELECT "row", col, value FROM emb WHERE {_IN_W} AND value BETWEEN 50 AND 200'),
    "descent_cells_by_value": _sql("demand lq", f'SELECT query_id, "row", col FROM lq JOIN demand ON {_MATCH} AND value BETWEEN valini AND valend'),
    "descent_count": _sql("demand lq", f"SELECT query_id, count(value) AS n_cells FROM lq LEFT JOIN demand ON {_MATCH} AND value BETWEEN valini AND valend GROUP BY query_id"),
    "descent_check_strong": _sql("demand lq", _check("lq", "demand", "bool_and", "true")),
    "descent_check_weak": _sql("demand lq", _check("lq", "demand", "bool_or", "false")),
    # A pair is looked at where its parent was left open; the top level's pairs are those of the windows.
    "descent_levels": _sql(
        "demand nodes lq",
        """, pairs AS (SELECT query_id, level, node_row, node_col, CASE WHEN max_value < valini OR min_value > valend THEN 'none'
            WHEN min_value >= valini AND max_value <= valend AND node_row * side >= xini AND (node_row + 1) * side - 1 <= xend AND node_col * side >= yini AND (node_col + 1) * side - 1 <= yend THEN 'all' ELSE 'open' END AS state
            FROM (SELECT *, cast(8 * 2 ** level AS BIGINT) AS side FROM nodes) JOIN lq ON node_row * side <= xend AND (node_row + 1) * side > xini AND node_col * side <= yend AND (node_col + 1) * side > yini)
        SELECT c.level, count(*) AS n_pairs, count(*) FILTER (WHERE c.state = 'none') AS n_none, count(*) FILTER (WHERE c.state = 'all') AS n_all, count(*) FILTER (WHERE c.state = 'open') AS n_open
        FROM pairs c LEFT JOIN pairs p ON p.query_id = c.query_id AND p.level = c.level + 1 AND p.node_row = c.node_row // 2 AND p.node_col = c.node_col // 2
        WHERE c.level = 3 OR p.state = 'open' GROUP BY c.level""",
    ).replace("\n, pairs", ", pairs"),
    "ts_descent_cells_by_value": _sql("ev tq", f'SELECT query_id, t, "row", col FROM tq JOIN ev ON {_MATCH} AND t BETWEEN tini AND tend AND value BETWEEN valini AND valend'),
    "algebra_tiles_unequal": _algebra("*"),
    "decoded_blocks_zones": _sql("zones", 'SELECT "row", col, cast(value AS BIGINT) AS value FROM zones'),
    "block_mean_levels": _sql(
        "demand",
        'SELECT s.side, cast("row" // s.side AS INTEGER) AS block_row, cast(col // s.side AS INTEGER) AS block_col, cast(floor(avg(value) + 0.5) AS BIGINT) AS value FROM demand CROSS JOIN (VALUES (2), (4), (8), (16), (32), (64)) s(side) GROUP BY 1, 2, 3',
    ),
    "ts_delta_window": _sql("ev", 'SELECT t, "row", col, value FROM ev WHERE t BETWEEN 3 AND 9 AND "row" BETWEEN 2 AND 9 AND col BETWEEN 5 AND 17'),
    "ts_delta_cells_by_value": _sql("ev", 'SELECT t, "row", col FROM ev WHERE t BETWEEN 3 AND 9 AND "row" BETWEEN 2 AND 9 AND col BETWEEN 5 AND 17 AND value BETWEEN 1 AND 2'),
    "ts_verify": _sql("ev", "SELECT t, count(*) AS n_cells, count(*) FILTER (WHERE value IS NULL) AS n_mismatch FROM ev GROUP BY t"),
    "tile_stats": _sql("emb", 'SELECT cast("row" // 16 AS INTEGER) AS tile_row, cast(col // 16 AS INTEGER) AS tile_col, min(value) AS min_value, max(value) AS max_value, min(value) = max(value) AS is_uniform, count(*) AS n_cells FROM emb GROUP BY 1, 2'),
    "last_level": _sql("demand", 'SELECT cast("row" // 8 AS INTEGER) AS tile_row, cast(col // 8 AS INTEGER) AS tile_col, "row", col, max(value) OVER (PARTITION BY "row" // 8, col // 8) - value AS delta FROM demand'),
    "pyramid": _sql("demand nodes", "SELECT * FROM nodes"),
    "pyramid_children": _sql(
        "demand nodes",
        "SELECT p.level, p.node_row, p.node_col, c.node_row AS child_row, c.node_col AS child_col, c.min_value AS child_min, c.max_value AS child_max FROM nodes p JOIN nodes c ON c.level + 1 = p.level AND c.node_row // 2 = p.node_row AND c.node_col // 2 = p.node_col",
    ),
    "algebra_sum": _algebra("+"),
    "algebra_sub": _algebra("-"),
    "algebra_mul": _algebra("*"),
    "algebra_tiles_sum": _sql("emb zones", 'SELECT a."row", a.col, cast(a.value AS BIGINT) + b.value AS value FROM emb a JOIN zones b ON a."row" = b."row" AND a.col = b.col'),
    "scalar_sum": _sql("emb", 'SELECT "row", col, cast(value AS BIGINT) + 17 AS value FROM emb'),
    "scalar_sub": _sql("emb", 'SELECT "row", col, cast(value AS BIGINT) - 17 AS value FROM emb'),
    "scalar_mul": _sql("emb", 'SELECT "row", col, cast(value AS BIGINT) * -3 AS value FROM emb'),
    "scalar_tiles_mul": _sql("emb", 'SELECT cast("row" // 16 AS INTEGER) AS tile_row, cast(col // 16 AS INTEGER) AS tile_col, min(cast(value AS BIGINT) * -3) AS min_value, max(cast(value AS BIGINT) * -3) AS max_value FROM emb GROUP BY 1, 2'),
    "threshold": _sql("emb", 'SELECT "row", col, CASE WHEN value >= 100 THEN 1 ELSE 0 END AS value FROM emb'),
    "threshold_tiles": _sql("demand", 'SELECT "row", col, CASE WHEN value >= 30 THEN 1 ELSE 0 END AS value FROM demand'),
    "threshold_pct": _sql("emb", "SELECT cast(floor(count(*) FILTER (WHERE value >= 100) * 100 / count(*)) AS BIGINT) AS pct FROM emb"),
    "zonal_totals": _sql("emb zones", 'SELECT z.value AS zone, cast(sum(a.value) AS BIGINT) AS total FROM emb a JOIN zones z ON a."row" = z."row" AND a.col = z.col GROUP BY 1'),
    "zonal_sum": _sql("emb zones", 'SELECT a."row", a.col, cast(sum(a.value) OVER (PARTITION BY z.value) AS BIGINT) AS value FROM emb a JOIN zones z ON a."row" = z."row" AND a.col = z.col'),
    "zonal_tiles_sum": _sql("emb zones", 'SELECT a."row", a.col, cast(sum(a.value) OVER (PARTITION BY z.value) AS BIGINT) AS value FROM emb a JOIN zones z ON a."row" = z."row" AND a.col = z.col'),
    "zonal_tiles_totals": _sql("demand supply szones", 'SELECT z.value AS zone, cast(sum(a.value) AS BIGINT) AS total FROM demand a JOIN szones z ON a."row" = z."row" AND a.col = z.col GROUP BY 1'),
    "zonal_tiles_cases": _sql(
        "demand supply szones dzones",
        """, p AS (SELECT a.value AS v, z.value AS z, min(a.value) OVER w = max(a.value) OVER w AS ua, min(z.value) OVER w = max(z.value) OVER w AS uz
            FROM szones a JOIN dzones z ON a."row" = z."row" AND a.col = z.col WINDOW w AS (PARTITION BY a."row" // 16, a.col // 16))
        SELECT CASE WHEN ua AND uz THEN 'uniform' WHEN uz THEN 'zone' WHEN ua THEN 'value' ELSE 'mixed' END AS kind, z AS zone, cast(sum(v) AS BIGINT) AS total FROM p GROUP BY 1, 2""",
    ).replace("\n, p AS", ", p AS"),
    "weighted_sum": _sql("supply", "SELECT cast(sum(value) AS BIGINT) AS total FROM supply"),
    "ts_get_cell": _sql(
        "ev",
        'SELECT i AS query_id, cast(i * 7 % 33 AS INTEGER) AS t, cast(i * 5 % 18 AS INTEGER) AS "row", cast(i * 11 % 26 AS INTEGER) AS col, coalesce(value, 0) AS value FROM range(200) r(i) LEFT JOIN ev ON t = i * 7 % 33 AND "row" = i * 5 % 18 AND col = i * 11 % 26',
    ),
    "ts_values_window": _sql("ev", 'SELECT t, "row", col, value FROM ev WHERE t BETWEEN 3 AND 9 AND "row" BETWEEN 2 AND 9 AND col BETWEEN 5 AND 17'),
    "ts_cells_by_value": _sql("ev tq", f'SELECT query_id, t, "row", col FROM tq JOIN ev ON {_MATCH}{_TIME} AND value BETWEEN valini AND valend'),
    "ts_check_strong": _sql("ev tq", _check("tq", "ev", "bool_and", "true", _TIME)),
    "ts_check_weak": _sql("ev tq", _check("tq", "ev", "bool_or", "false", _TIME)),
    "ts_info": _sql("ev", 'SELECT cast(count(DISTINCT t) AS INTEGER) AS n_times, cast(max("row") + 1 AS INTEGER) AS n_rows, cast(max(col) + 1 AS INTEGER) AS n_cols, min(value) AS min_value, max(value) AS max_value FROM ev'),
    "ts_delta_snapshot": _sql("ev delta", "SELECT * FROM delta"),
    "ts_delta_zigzag": _sql("ev delta", 'SELECT t, snap_t, "row", col, cast(CASE WHEN delta <= 0 THEN -2 * delta ELSE 2 * delta - 1 END AS BIGINT) AS code FROM delta WHERE t <> snap_t'),
    "ts_reconstruct": _sql("ev", "SELECT * FROM ev"),
    "ts_adaptive_snapshots": _sql(
        "ev",
        'SELECT t, s AS is_snapshot, max(CASE WHEN s THEN t END) OVER (ORDER BY t) AS snap_t FROM (SELECT t, t = 0 OR count(*) FILTER (WHERE value <> before) > 0.4 * count(*) AS s FROM (SELECT *, lag(value) OVER (PARTITION BY "row", col ORDER BY t) AS before FROM ev) GROUP BY t)',
    ),
    "value_frequency": _sql("ev", "SELECT value, count(*) AS n FROM ev GROUP BY value"),
    "value_entropy": _sql("ev", "SELECT round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 6) AS entropy FROM (SELECT cast(count(*) AS DOUBLE) AS n FROM ev GROUP BY value)"),
    "block_frequency": _sql("ev blocks", "SELECT block, count(*) AS n FROM blocks GROUP BY block"),
    "block_mean": _sql("demand", 'SELECT cast("row" // 8 AS INTEGER) AS block_row, cast(col // 8 AS INTEGER) AS block_col, cast(floor(avg(value) + 0.5) AS BIGINT) AS value FROM demand GROUP BY 1, 2'),
    "color_ramp": _sql(
        "demand",
        'SELECT "row", col, cast(floor(255 * (least(greatest(value, 0), 100) / 100.0::DOUBLE) + 0.5) AS INTEGER) AS r, 0 AS g, cast(floor(255 * (1 - least(greatest(value, 0), 100) / 100.0::DOUBLE) + 0.5) AS INTEGER) AS b FROM demand',
    ),
    "verify_roundtrip": "SELECT cast(0 AS BIGINT) AS n_mismatch",
    "fixed_windows": """SELECT cast(o_orderkey AS BIGINT) AS query_id, x AS xini, x + 8 AS xend, y AS yini, y + 4 AS yend FROM (
        SELECT o_orderkey, cast(least(o_orderkey % 64, 55) AS INTEGER) AS x, cast(least(o_custkey % 64, 59) AS INTEGER) AS y FROM orders)""",
}


def _dictionary(cells: str, by: str) -> str:
    """The vocabulary of 2 x 2 blocks of values, as text."""
    return _sql(
        cells,
        f"""SELECT row_number() OVER (ORDER BY n DESC, block) AS codeword, block, n FROM (
        SELECT *, log2(sum(n) OVER ()) - sum(n * log2(n)) OVER () / sum(n) OVER () AS hw FROM (SELECT block, count(*)::DOUBLE AS k, count(*) AS n, max(size) AS size
            FROM (SELECT string_agg(cast(value AS VARCHAR), ',' ORDER BY "row", col) AS block, count(*) AS size FROM {cells} GROUP BY {by}"row" // 2, col // 2) GROUP BY block)),
        (SELECT log2(sum(n)) - sum(n * log2(n)) / sum(n) AS hv FROM (SELECT count(*)::DOUBLE AS n FROM {cells} GROUP BY value))
        WHERE floor(32 * size + n * hw) <= floor(n * size * hv)""",
    )


ORACLES["dictionary_blocks"] = _dictionary("zs", "t, ")
ORACLES["dictionary_blocks_zones"] = _dictionary("zones", "")
ORACLES["encoded_blocks_zones"] = f"""WITH dict AS ({ORACLES["dictionary_blocks_zones"]}),
    b AS (SELECT cast(vec_id // 2 AS INTEGER) AS block_row, cast((i - 1) // 2 AS INTEGER) AS block_col, string_agg(cast(label AS VARCHAR), ',' ORDER BY vec_id, i) AS block
        FROM (SELECT *, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings) GROUP BY 1, 2)
    SELECT block_row, block_col, coalesce(codeword, 0) AS codeword, CASE WHEN codeword IS NULL THEN block END AS raw FROM b LEFT JOIN dict USING (block)"""
