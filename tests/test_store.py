"""Stored tiles, the descent of their pyramid, and sparse tiles, against brute force."""

import random
import re

import pytest
from pyspark.sql import functions as F

from quadgrid import model as m
from quadgrid.operators import algebra, descent, query, series, store, tiles
from quadgrid.streaming.append import append_steps

ROWS, COLS = 37, 45


def raster(seed, share=1.0, t=None):
    rng = random.Random(seed)
    out = {}
    for i in range(ROWS):
        for j in range(COLS):
            if rng.random() < share:
                out[(i, j) if t is None else (t, i, j)] = (i // 9) * 10 if j < 20 else rng.randint(-40, 90)
    return out


def frame(spark, cells, schema=m.CELLS):
    return spark.createDataFrame([(*k, v) for k, v in cells.items()], schema).repartition(5)


def queries(spark, n=40, seed=3, times=None):
    rng, rows = random.Random(seed), []
    for i in range(n):
        x, y, lo = rng.randrange(ROWS + 4), rng.randrange(COLS + 4), rng.randint(-45, 90)
        tini = rng.randrange(times) if times else None
        rows.append((i, x, x + rng.randrange(30), y, y + rng.randrange(30), tini, tini + rng.randrange(3) if times else None, lo, lo + rng.choice([3, 20, 200])))
    rows += [(n, 0, ROWS - 1, 0, COLS - 1, 0 if times else None, times, -1000, 1000), (n + 1, 5, 3, 0, 9, 0, 1, 0, 9), (n + 2, 0, 8, 0, 19, 0, 0, 0, 0)]
    return spark.createDataFrame(rows, m.QUERIES), rows


def inside(rows, cells, timed=False):
    fits = lambda r, k: r[1] <= k[-2] <= r[2] and r[3] <= k[-1] <= r[4] and (not timed or r[5] <= k[0] <= r[6])
    return {r[0]: [(k, v) for k, v in cells.items() if fits(r, k)] for r in rows}


def brute(rows, cells, timed=False):
    held = inside(rows, cells, timed)
    match = {r[0]: {k for k, v in held[r[0]] if r[7] <= v <= r[8]} for r in rows}
    strong = {q: len(match[q]) == len(held[q]) for q in match}
    return match, strong, {q: bool(x) for q, x in match.items()}


def pairs(df, keys=("row", "col")):
    return {(r["query_id"], *[r[k] for k in keys]) for r in df.collect()}


@pytest.fixture(scope="module", params=[1.0, 0.3, 0.02])
def stored(spark, request, tmp_path_factory):
    cells = raster(1, request.param)
    path = str(tmp_path_factory.mktemp("store") / "s")
    store.save(tiles.build_tiles(frame(spark, cells), 4), path, 4, region=2, levels=4)
    return cells, store.load(spark, path)


def test_batches_and_descent_match_brute_force(spark, stored):
    cells, s = stored
    q, rows = queries(spark)
    match, strong, weak = brute(rows, cells)
    want = {(k, *p) for k, ps in match.items() for p in ps}
    assert pairs(s.cells_by_value(q)) == want and pairs(descent.cells_by_value(q, s)) == want
    n = {k: len(v) for k, v in match.items()}
    assert dict(map(tuple, s.count_by_value(q).collect())) == n and dict(map(tuple, descent.count_by_value(q, s).collect())) == n
    assert dict(map(tuple, s.check(q, True).collect())) == strong and dict(map(tuple, s.check(q, False).collect())) == weak
    assert dict(map(tuple, descent.check(q, s, True).results.collect())) == strong
    assert dict(map(tuple, descent.check(q, s, False).results.collect())) == weak


def test_lookups(spark, stored):
    cells, s = stored
    rng = random.Random(8)
    points = [(i, rng.randrange(-2, ROWS + 3), rng.randrange(-2, COLS + 3)) for i in range(300)] + [(300, 0, 0), (301, 0, 0)]
    got = {r["query_id"]: r["value"] for r in s.get_cells(spark.createDataFrame(points, "query_id long, row int, col int")).collect()}
    assert got == {i: cells.get((r, c), 0) for i, r, c in points}


def test_descent_opens_fewer_tiles_than_windows_touch(spark, tmp_path):
    """On a raster with large even regions, most pairs are settled above the tiles."""
    cells = {(i, j): (i // 16) * 10 + (j // 16) for i in range(64) for j in range(64)}
    s = store.save(tiles.build_tiles(frame(spark, cells), 4), str(tmp_path / "s"), 4, levels=4)
    q = spark.createDataFrame([(0, 0, 63, 0, 63, None, None, 0, 15), (1, 0, 63, 0, 63, None, None, 22, 22), (2, 5, 58, 3, 60, None, None, 0, 99)], m.QUERIES)
    found = descent.descend(q, s)
    opened = [n for _, _, _, _, n in found.levels]
    touched = query.touched_tiles(q, 4).count()
    assert [x[0] for x in found.levels] == [3, 2, 1, 0] and found.open.count() == opened[-1] < touched / 4
    assert sum(x[2] + x[3] for x in found.levels[:-1]) > 0
    assert pairs(descent.cells_by_value(q, s)) == pairs(query.cells_by_value_batch(q, s.tiles, 4))
    mixed = {(i, j): (i * 7 + j * 3) % 50 for i in range(64) for j in range(64)}
    s = store.save(tiles.build_tiles(frame(spark, mixed), 4), str(tmp_path / "m"), 4, levels=2)
    early = descent.check(q.where("query_id < 2"), s, True)
    assert early.opened < 20 and touched > 600  # a counter-example lies in almost every tile
    assert dict(map(tuple, early.results.collect())) == {0: False, 1: False}
    assert dict(map(tuple, descent.check(q, s, True).results.collect())) == {0: False, 1: False, 2: True}


def test_descent_ends_where_all_pairs_are_settled(spark, tmp_path):
    """Levels that no pair reaches have no row in the trace."""
    cells = {(i, j): 1000 + i for i in range(32) for j in range(32)}
    s = store.save(tiles.build_tiles(frame(spark, cells), 4), str(tmp_path / "s"), 4, levels=4)
    none = spark.createDataFrame([(0, 0, 20, 0, 20, None, None, 0, 99), (1, 3, 9, 0, 31, None, None, 2000, 3000)], m.QUERIES)
    assert list(map(tuple, descent.trace(none, s).collect())) == [(3, 2, 2, 0, 0)]
    whole = spark.createDataFrame([(0, 0, 31, 0, 31, None, None, 0, 9999), (1, 0, 15, 0, 15, None, None, 1000, 1015)], m.QUERIES)
    assert sorted(map(tuple, descent.trace(whole, s).collect())) == [(2, 1, 0, 1, 0), (3, 2, 0, 1, 1)]
    assert descent.trace(none.where("query_id > 1"), s).count() == 0
    for q, n, strong in ((none, {0: 0, 1: 0}, False), (whole, {0: 1024, 1: 256}, True)):
        assert dict(map(tuple, descent.count_by_value(q, s).collect())) == n and descent.cells_by_value(q, s).count() == sum(n.values())
        for kind in (True, False):
            assert dict(map(tuple, descent.check(q, s, kind).results.collect())) == {0: strong, 1: strong}


def _plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_batches_leave_tiles_where_they_are(spark, tmp_path):
    cells = raster(2)
    s = store.save(tiles.build_tiles(frame(spark, cells), 4), str(tmp_path / "s"), 4, region=2)
    q, _ = queries(spark, 5)
    for df in (s.cells_by_value(q), s.get_cells(q.selectExpr("query_id", "xini row", "yini col"))):
        plan = _plan(df)
        scan = next(x for x in plan.split("\n") if "dynamicpruning" in x)
        assert "region" in scan.split("PartitionFilters")[1] and "tile_row" in scan or "region" in scan
        assert "NestedLoop" not in plan and "SortMergeJoin" not in plan.split("Initial Plan")[0].split("tile_row")[0]
    plan = _plan(s.cells_by_value(q))
    assert len(re.findall(r"(?<!Broadcast)Exchange hashpartitioning", plan)) == 0
    few = spark.createDataFrame([(0, 0, 3, 0, 3, None, None, -99, 99)], m.QUERIES)
    got = s.cells_by_value(few)
    assert got.count() == 16
    assert got._jdf.queryExecution().executedPlan().toString().count("dynamicpruning") >= 1


def test_bucketed_tiles_are_not_shuffled(spark, tmp_path, monkeypatch):
    cells = raster(2)
    s = store.save(tiles.build_tiles(frame(spark, cells), 4), str(tmp_path / "s"), 4, buckets=3)
    assert s.bucketed and store.load(spark, str(tmp_path / "s")).bucketed
    q, rows = queries(spark)
    monkeypatch.setattr(query, "BROADCAST_ROWS", 0)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        found = s.cells_by_value(q)
        plan = _plan(found).split("== Initial Plan ==")[0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert len(re.findall("Exchange hashpartitioning", plan)) == 1 and "SelectedBucketsCount: 3 out of 3" in plan and "SortMergeJoin" in plan
    assert pairs(found) == {(k, *p) for k, ps in brute(rows, cells)[0].items() for p in ps}


def test_series_store(spark, tmp_path):
    cells = {k: v + k[0] for t in (1, 2, 4) for k, v in raster(t, 0.6, t).items()}
    s = store.save(tiles.build_tiles(frame(spark, cells, m.CELLS_T), 4, ["t"]), str(tmp_path / "s"), 4, ["t"])
    q, rows = queries(spark, 25, times=5)
    match, strong, weak = brute(rows, cells, True)
    want = {(k, *p) for k, ps in match.items() for p in ps}
    keys = ("t", "row", "col")
    assert pairs(s.cells_by_value(q), keys) == want and pairs(descent.cells_by_value(q, s), keys) == want
    assert dict(map(tuple, descent.check(q, s, True).results.collect())) == strong and dict(map(tuple, s.check(q, False).collect())) == weak
    assert {r["t"] for r in s.times(2, 3).window(0, 9, 0, 9).select("t").distinct().collect()} == {2}


@pytest.mark.parametrize("cells", [{(0, 0): 5, (1, 1): 5}, {(0, 0): 1, (1, 1): 2}, {(3, 3): 0}, {(0, 1): 4, (0, 3): 4, (2, 0): -1}])
def test_small_sparse_tiles(spark, cells):
    t = tiles.build_tiles(frame(spark, cells), 4)
    assert {(r["row"], r["col"]): r["value"] for r in tiles.tile_cells(t).collect()} == cells
    assert algebra.weighted_sum(t).first()[0] == sum(cells.values())


@pytest.mark.parametrize("share", [0.05, 0.5, 0.97])
def test_sparse_round_trip_and_algebra(spark, share):
    a, b = raster(5, share), raster(6, share)
    ta, tb = (tiles.build_tiles(frame(spark, x), 4) for x in (a, b))
    assert {(r["row"], r["col"]): r["value"] for r in tiles.tile_cells(ta).collect()} == a
    got = {(r["row"], r["col"]): r["value"] for r in tiles.tile_cells(algebra.pointwise_tiles(ta, tb, "sub")).collect()}
    assert got == {k: a[k] - b[k] for k in a.keys() & b.keys()}
    assert {(r["row"], r["col"]): r["value"] for r in tiles.tile_cells(algebra.threshold_tiles(ta, 10)).collect()} == {k: int(v >= 10) for k, v in a.items()}


def test_stream_batches_of_one_tile(spark, tmp_path):
    """Two batches bring cells of one step and tile; the later one's value stays where both have one."""
    source, target = str(tmp_path / "in"), str(tmp_path / "tiles")
    first, second = {(0, 0, 0): 1, (0, 1, 1): 2, (0, 9, 9): 7}, {(0, 0, 1): 3, (0, 1, 1): 9, (1, 0, 0): 4}
    for part in (first, second):
        frame(spark, part, m.CELLS_T).coalesce(1).write.mode("append").parquet(source)
        append_steps(spark, source, target, str(tmp_path / "cp"), 4).awaitTermination()
    back = spark.read.parquet(target)
    assert tiles.tile_cells(back, ["t"]).count() == 6
    merged = tiles.merge_parts(back, 4, ["t"], "batch")
    assert merged.count() == 3
    got = {(r["t"], r["row"], r["col"]): r["value"] for r in tiles.tile_cells(merged, ["t"]).collect()}
    assert got == first | second


@pytest.mark.parametrize("steps", [[1, 2, 3, 4, 5], [5, 6, 7], [0, 1, 9, 10], [3]])
def test_series_that_lack_snapshots_or_cells(spark, steps):
    cells = {k: v * (k[0] + 1) for t in steps for k, v in raster(t, 0.5, t).items()}
    c = frame(spark, cells, m.CELLS_T)
    deltas = series.snapshot_deltas(c, 4)
    assert tiles.mismatches(c, series.reconstruct(deltas), ("t", "row", "col")).count() == 0
    assert series.verify(c, deltas).agg(F.sum("n_mismatch")).first()[0] == 0
    assert series.adaptive_snapshots(c, 1.0).where("snap_t IS NULL").count() == 0


def test_scratch_needs_a_shared_folder_on_clusters(spark, monkeypatch):
    class Conf:
        get = staticmethod(lambda *a: None)

    class Context:
        master, applicationId, _jsc = "spark://host:7077", "a", spark.sparkContext._jsc

    class Session:
        conf, sparkContext = Conf, Context

    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            m.scratch(Session, "x")
