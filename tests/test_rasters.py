"""Hand-made rasters against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quadgrid import model as m
from quadgrid.functions import keys
from quadgrid.operators import algebra, query, series, stats, store, tiles, workload
from quadgrid.sources import files
from quadgrid.streaming.append import append_steps


def cells(spark, values):
    rows = [(i, j, v) for i, line in enumerate(values) for j, v in enumerate(line)]
    return spark.createDataFrame(rows, m.CELLS)


def as_dict(df):
    return {(r["row"], r["col"]): r["value"] for r in df.collect()}


@pytest.mark.parametrize("values", [[[5]], [[1, 2], [3, 4]], [[9] * 7] * 5, [[(i * j) % 11 - 5 for j in range(7)] for i in range(5)]])
def test_tiles_round_trip(spark, values):
    c = cells(spark, values)
    t = tiles.build_tiles(c, 4)
    assert tiles.mismatches(c, tiles.tile_cells(t)).count() == 0
    flat = [v for line in values for v in line]
    top = tiles.pyramid(t, 4).where("level = 3").collect()
    assert [(r["min_value"], r["max_value"], r["n_cells"]) for r in top] == [(min(flat), max(flat), len(flat))]
    assert algebra.weighted_sum(t).first()[0] == sum(flat)


def test_lookup_outside_is_zero(spark):
    c = cells(spark, [[1, 2], [3, 4]])
    assert query.get_cell(c, 1, 1).first()[0] == 4
    assert query.get_cell(c, 2, 0).first()[0] == 0
    assert query.window_array(c, 0, 1, 1, 1).first()[0] == [2, 4]


def test_batches_match_brute_force(spark):
    rng = random.Random(4)
    values = [[rng.randint(-9, 9) for _ in range(21)] for _ in range(13)]
    t = tiles.build_tiles(cells(spark, values), 4)
    rows = []
    for i in range(40):
        x, y = rng.randrange(15), rng.randrange(23)
        lo = rng.randint(-10, 9)
        rows.append((i, x, x + rng.randrange(9), y, y + rng.randrange(9), None, None, lo, lo + rng.randrange(12)))
    rows.append((40, 0, 12, 0, 20, None, None, -9, 9))
    q = spark.createDataFrame(rows, m.QUERIES)
    inside = {r[0]: [(i, j, values[i][j]) for i in range(13) for j in range(21) if r[1] <= i <= r[2] and r[3] <= j <= r[4]] for r in rows}
    match = {r[0]: [(i, j) for i, j, v in inside[r[0]] if r[7] <= v <= r[8]] for r in rows}
    found = {(r["query_id"], r["row"], r["col"]) for r in query.cells_by_value_batch(q, t, 4).collect()}
    assert found == {(k, i, j) for k, cs in match.items() for i, j in cs}
    assert {r[0]: r[1] for r in query.count_by_value_batch(q, t, 4).collect()} == {k: len(v) for k, v in match.items()}
    assert {r[0]: r[1] for r in query.check_batch(q, t, True, 4).collect()} == {k: len(v) == len(inside[k]) for k, v in match.items()}
    assert {r[0]: r[1] for r in query.check_batch(q, t, False, 4).collect()} == {k: bool(v) for k, v in match.items()}
    assert "NestedLoop" not in query.cells_by_value_batch(q, t, 4)._jdf.queryExecution().toString()


def test_checks_of_two_values(spark):
    c = cells(spark, [[0 if (i + j) % 2 else 10 for j in range(7)] for i in range(5)])
    assert not query.check_window(c, 0, 4, 0, 6, 4, 6, strong=False)
    assert query.check_window(c, 0, 4, 0, 6, 0, 10, strong=True)


def test_algebra_near_the_int_bounds(spark):
    big = cells(spark, [[2**31 - 1, -(2**31)], [7, 7]])
    assert as_dict(algebra.pointwise(big, big, "mul"))[0, 1] == 2**62
    assert as_dict(algebra.scalar(big, -3, "mul"))[0, 0] == -3 * (2**31 - 1)
    t = algebra.scalar_tiles(tiles.build_tiles(big, 1), -3, "mul")
    assert {r["min_value"] for r in t.collect()} == {-3 * (2**31 - 1), 3 * 2**31, -21}
    both = algebra.pointwise_tiles(tiles.build_tiles(big, 2), tiles.build_tiles(cells(spark, [[1, 1], [1, 1]]), 2), "sum")
    assert as_dict(tiles.tile_cells(both)) == {(0, 0): 2**31, (0, 1): 1 - 2**31, (1, 0): 8, (1, 1): 8}


def test_zones_aligned_to_blocks_and_uniform(spark):
    a = cells(spark, [[i * 8 + j for j in range(8)] for i in range(8)])
    z = cells(spark, [[i // 4 * 2 + j // 4 for j in range(8)] for i in range(8)])
    want = {k: sum(i * 8 + j for i in range(8) for j in range(8) if i // 4 * 2 + j // 4 == k) for k in range(4)}
    assert {r[0]: r[1] for r in algebra.zonal_totals(a, z).collect()} == want
    assert as_dict(algebra.zonal_sum(a, z))[7, 0] == want[2]
    assert set(as_dict(algebra.zonal_sum(a, cells(spark, [[1] * 9] * 9))).values()) == {sum(range(64))}
    assert algebra.ones_percent(algebra.threshold(a, 48)).first()[0] == 25


def test_series_of_a_constant_shift(spark):
    rows = [(t, i, j, i + j + 3 * t) for t in range(5) for i in range(3) for j in range(4)]
    c = spark.createDataFrame(rows, m.CELLS_T)
    deltas = series.snapshot_deltas(c, 2)
    assert tiles.mismatches(c, series.reconstruct(deltas), ("t", "row", "col")).count() == 0
    assert {r["code"] for r in series.zigzag_deltas(deltas).collect()} == {5}
    assert [r["snap_t"] for r in series.adaptive_snapshots(c, 1.0).orderBy("t").collect()] == [0] * 5


def test_functions(spark):
    df = spark.range(-6, 7).select(F.col("id").alias("d"))
    assert df.where(keys.unzigzag(keys.zigzag(F.col("d"))) != F.col("d")).count() == 0
    k = spark.range(64).select((F.col("id") / 8).cast("int").alias("r"), (F.col("id") % 8).cast("int").alias("c"))
    assert k.select(keys.morton(F.col("r"), F.col("c"))).distinct().count() == 64
    assert stats.entropy(stats.value_frequency(cells(spark, [[0, 1], [1, 0]]))).first()[0] == 1.0


def test_files(spark, tmp_path):
    values = [[-3, 4, 5], [6, -7, 8]]
    for name in ("a.bin", "b.bin"):
        (tmp_path / name).write_bytes(b"".join(v.to_bytes(4, "little", signed=True) for line in values for v in line))
    (tmp_path / "a.asc").write_text("ncols 3\nnrows 2\nx 0\ny 0\ncellsize 1\nnodata -1\n1.25 -1.259 3\n4 5 6\n")
    (tmp_path / "list").write_text("2 3 2 2 0 0\na.bin\nb.bin")
    (tmp_path / "q").write_text("0 1 0 2 -5 5\n1 1 1 1 0 9")
    want = {(i, j): v for i, line in enumerate(values) for j, v in enumerate(line)}
    assert as_dict(files.read_raster(spark, str(tmp_path / "a.bin"), 2, 3)) == want
    assert as_dict(files.read_raster(spark, str(tmp_path / "a.asc"), scale=2)) == {(0, 0): 125, (0, 1): -125, (0, 2): 300, (1, 0): 400, (1, 1): 500, (1, 2): 600}
    s = files.read_manifest(spark, str(tmp_path / "list"))
    assert s.count() == 12 and as_dict(s.where("t = 1")) == want
    q = files.read_regions(spark, str(tmp_path / "q"), values=True)
    assert sorted(tuple(r)[1:] for r in q.collect()) == [(0, 1, 0, 2, -5, 5), (1, 1, 1, 1, 0, 9)]
    window = spark.createDataFrame([(0, 0, 1, 1, 2)], "query_id long, xini int, xend int, yini int, yend int")
    n = files.write_windows(files.read_bin(spark, str(tmp_path / "a.bin"), 2, 3).selectExpr("0L query_id", "row", "col", "value"), window, str(tmp_path / "out"))
    (part,) = files.window_files(spark, str(tmp_path / "out"))
    assert n == 4 and np.fromfile(part, "<i4").tolist() == [4, 5, -7, 8]


def test_workloads_stay_inside(spark):
    e = m.Extent(20, 30, 5)
    bad = workload.random_regions(spark, e, 200, values=(-5, 5), series=True).where("xini > xend OR xend >= 20 OR yend >= 30 OR tend >= 5 OR valini < -5 OR valend > 5")
    assert bad.count() == 0 and workload.random_points(spark, e, 50).where("row >= 20 OR col >= 30").count() == 0
    w = workload.fixed_windows(workload.random_points(spark, e, 50), e, 7, 4)
    assert w.where("xend - xini <> 6 OR yend - yini <> 3 OR xini < 0 OR xend >= 20 OR yend >= 30").count() == 0
    assert files.random_raster(spark, 4, 5, -2, 2).where("value < -2 OR value > 2").count() == 0
    assert files.gradient(spark, 8).agg(F.max("value")).first()[0] == 100


def test_stored_tiles_and_stream(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "tiles")
    rows = [(t, i, j, t + i * j) for t in range(3) for i in range(6) for j in range(6)]
    c = spark.createDataFrame(rows, m.CELLS_T)
    c.write.parquet(source)
    append_steps(spark, source, target, str(tmp_path / "cp"), 4).awaitTermination()
    back = spark.read.parquet(target)
    assert tiles.mismatches(c, tiles.tile_cells(back, ["t"]), ("t", "row", "col")).count() == 0
    assert {(r["t"], r["n_bytes"] > 0) for r in series.space_per_step(spark, target).collect()} == {(0, True), (1, True), (2, True)}
    assert "PartitionFilters: [isnotnull(t" in back.where("t = 1").select("min_value")._jdf.queryExecution().toString()


@pytest.mark.parametrize("a_size, b_size", [((7, 9), (5, 11)), ((4, 4), (4, 4)), ((9, 3), (2, 8))])
def test_tile_algebra_on_other_extents(spark, a_size, b_size):
    rng = random.Random(sum(a_size))
    raster = lambda size: [[rng.choice([3, 3, 3, -7]) if i < 4 else 5 for _ in range(size[1])] for i in range(size[0])]
    a, b = raster(a_size), raster(b_size)
    both = algebra.pointwise_tiles(tiles.build_tiles(cells(spark, a), 4), tiles.build_tiles(cells(spark, b), 4), "sub")
    want = {(i, j): a[i][j] - b[i][j] for i in range(min(a_size[0], b_size[0])) for j in range(min(a_size[1], b_size[1]))}
    assert as_dict(tiles.tile_cells(both)) == want


def test_stored_window_skips_by_statistics(spark, tmp_path):
    c = cells(spark, [[i * 40 + j for j in range(40)] for i in range(40)])
    found = store.save(tiles.build_tiles(c, 8), str(tmp_path / "t"), 8).window(3, 12, 5, 20, (300, 420))
    assert as_dict(found) == {(i, j): i * 40 + j for i in range(3, 13) for j in range(5, 21) if 300 <= i * 40 + j <= 420}
    plan = found._jdf.queryExecution().toString()
    assert all(x in plan.split("PushedFilters: [")[1].split("]")[0] for x in ("tile_row", "tile_col", "max_value", "min_value"))


def test_block_codes_of_edge_blocks(spark):
    c = cells(spark, [[(i // 2 + j // 2) % 2 for j in range(5)] for i in range(7)])
    dictionary = stats.block_frequency(c, 2).where("n > 2").select(F.expr("CAST(length(block) AS BIGINT) + ascii(block)").alias("codeword"), "block")
    encoded = stats.encode_blocks(c, dictionary, 2)
    assert encoded.where("codeword = 0").count() > 0 and encoded.where("codeword > 0").count() > 0
    assert tiles.mismatches(c, stats.decode_blocks(encoded, dictionary, 2, 5)).count() == 0


def test_query_file_with_a_count(spark, tmp_path):
    (tmp_path / "q").write_text("2\n0 1 0 2\n1 1 1 1\n")
    assert sorted(tuple(r)[1:] for r in files.read_regions(spark, str(tmp_path / "q"), header=True).collect()) == [(0, 1, 0, 2), (1, 1, 1, 1)]
    (tmp_path / "p").write_text("3\n4 5\n6 7")
    assert sorted(tuple(r)[1:] for r in files.read_points(spark, str(tmp_path / "p"), header=True).collect()) == [(4, 5), (6, 7)]


def test_stream_batch_that_runs_again(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "tiles")
    c = spark.createDataFrame([(t, i, j, t + i * j) for t in range(2) for i in range(6) for j in range(6)], m.CELLS_T)
    c.write.parquet(source)
    for run in range(2):  # without its checkpoint the stream does its first batch again
        append_steps(spark, source, target, str(tmp_path / f"cp{run}"), 4).awaitTermination()
    assert tiles.tile_cells(spark.read.parquet(target), ["t"]).count() == 72
