"""Series on stored differences, snapshots by size, coded blocks and zonal sums on tiles, against brute force."""

import itertools
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from quadgrid import model as m
from quadgrid.operators import algebra, coded, delta_store, series, stats, tiles

SIZE = (11, 14)


def steps(times, seed=1, share=1.0, change=0.1):
    """A series whose steps change few cells; with a share below 1 each step lacks cells of its own."""
    rng, now, out = random.Random(seed), {}, {}
    for i, j in itertools.product(range(SIZE[0]), range(SIZE[1])):
        now[i, j] = rng.choice([0, 0, 0, 7, -20, 300])
    for t in times:
        for k in now:
            if rng.random() < change:
                now[k] += rng.randint(-3, 3)
            if rng.random() < share:
                out[(t, *k)] = now[k]
    return out


def frame(spark, cells, schema=m.CELLS_T):
    return spark.createDataFrame([(*k, v) for k, v in cells.items()], schema).repartition(4)


def boxes(spark, times, n=30, seed=2):
    rng, rows = random.Random(seed), []
    for i in range(n):
        x, y, t, lo = rng.randrange(SIZE[0]), rng.randrange(SIZE[1]), rng.choice(times), rng.choice([-25, -3, 0, 5, 290])
        rows.append((i, x, x + rng.randrange(9), y, y + rng.randrange(9), t, t + rng.randrange(3), lo, lo + rng.choice([0, 6, 400])))
    rows.append((n, 0, 99, 0, 99, min(times), max(times), -1000, 1000))
    return spark.createDataFrame(rows, m.QUERIES), rows


def matches(rows, cells):
    inside = {r[0]: {k: v for k, v in cells.items() if r[5] <= k[0] <= r[6] and r[1] <= k[1] <= r[2] and r[3] <= k[2] <= r[4]} for r in rows}
    return inside, {r[0]: {k for k, v in inside[r[0]].items() if r[7] <= v <= r[8]} for r in rows}


@pytest.mark.parametrize("times, share", [([0, 1, 2, 3, 4, 5], 1.0), ([1, 2, 5, 6], 1.0), ([0, 1, 2, 3], 0.6)])
def test_queries_on_differences(spark, tmp_path, times, share):
    cells = steps(times, share=share)
    t = tiles.build_tiles(frame(spark, cells), 4, ["t"])
    s = delta_store.save(t, series.snapshot_steps(t, 3), str(tmp_path / "s"), 4, region=2)
    q, rows = boxes(spark, times)
    inside, match = matches(rows, cells)
    assert {(r["query_id"], r["t"], r["row"], r["col"]) for r in s.cells_by_value(q).collect()} == {(k, *c) for k, cs in match.items() for c in cs}
    assert dict(map(tuple, s.count_by_value(q).collect())) == {k: len(v) for k, v in match.items()}
    assert dict(map(tuple, s.check(q, True).collect())) == {k: len(match[k]) == len(inside[k]) for k in match}
    assert dict(map(tuple, s.check(q, False).collect())) == {k: bool(match[k]) for k in match}
    rng = random.Random(3)
    points = [(i, rng.randrange(-1, 8), rng.randrange(-1, SIZE[0] + 2), rng.randrange(-1, SIZE[1] + 2)) for i in range(200)]
    got = {r["query_id"]: r["value"] for r in s.get_cells(spark.createDataFrame(points, "query_id long, t int, row int, col int")).collect()}
    assert got == {i: cells.get((a, b, c), 0) for i, a, b, c in points}


def test_bounds_settle_pairs_and_differences_are_small(spark, tmp_path):
    cells = steps(range(6), change=0.02)
    t = tiles.build_tiles(frame(spark, cells), 4, ["t"])
    s = delta_store.save(t, series.snapshot_steps(t, 6), str(tmp_path / "s"), 4, region=2)
    kept = s.store.tiles.where("t <> snap_t")
    assert kept.count() == 5 * 12 and kept.where("is_uniform AND min_value = 0").count() > 10
    q = spark.createDataFrame([(0, 0, 99, 0, 99, 0, 5, 1000, 2000), (1, 0, 99, 0, 99, 0, 5, -1000, 1000)], m.QUERIES)
    found = {r["relative"]: r for r in s.settled(q).collect()}
    assert found[True]["n_none"] == found[True]["n_all"] == 60 and found[True]["n_pairs"] == 120


def brute_costs(cells, times, horizon, tile):
    def bits(values):
        span = max(values) - min(values)
        return 64 + len(values) * span.bit_length()

    parts = defaultdict(dict)
    for (t, i, j), v in cells.items():
        parts[t, i // tile, j // tile][i, j] = v
    out = Counter()
    for (t, a, b), held in parts.items():
        out[t, t] += bits(list(held.values()))
        at = times.index(t)
        for s in times[max(0, at - horizon) : at]:
            out[t, s] += bits([v - parts[s, a, b][k] for k, v in held.items()])
    return dict(out)


@pytest.mark.parametrize("times, horizon", [([0, 1, 2, 3, 4, 5, 6], 3), ([2, 3, 7, 9], 9), ([4], 2)])
def test_snapshots_by_size(spark, times, horizon):
    cells = steps(times, seed=9, change=0.3)
    t = tiles.build_tiles(frame(spark, cells), 4, ["t"])
    cost = brute_costs(cells, times, horizon, 4)
    assert {(r["t"], r["snap_t"]): r["bits"] for r in delta_store.step_costs(t, horizon).collect()} == cost
    chosen = delta_store.optimal_snapshots(t, horizon).collect()
    total, n = sum(r["bits"] for r in chosen), len(times)
    assert sorted(r["t"] for r in chosen) == times and all(r["is_snapshot"] == (r["t"] == r["snap_t"]) for r in chosen)

    def price(snaps):
        at = [max(s for s in snaps if s <= i) for i in range(n)]
        return sum(cost[times[i], times[s]] for i, s in enumerate(at)) if all(i - s <= horizon for i, s in enumerate(at)) else float("inf")

    ways = [[0, *c] for k in range(n) for c in itertools.combinations(range(1, n), k)]
    assert total == min(map(price, ways))


def test_optimal_snapshots_feed_a_store(spark, tmp_path):
    """A jump in mid-series becomes a snapshot, and queries are right on that choice."""
    cells = {k: v + (1000 * (k[1] * 7 + k[2]) if k[0] >= 3 else 0) for k, v in steps(range(6), change=0.01).items()}
    t = tiles.build_tiles(frame(spark, cells), 4, ["t"])
    chosen = delta_store.optimal_snapshots(t, 6)
    assert {r["t"] for r in chosen.where("is_snapshot").collect()} == {0, 3}
    s = delta_store.save(t, chosen, str(tmp_path / "s"), 4)
    q, rows = boxes(spark, list(range(6)))
    assert dict(map(tuple, s.count_by_value(q).collect())) == {k: len(v) for k, v in matches(rows, cells)[1].items()}


@pytest.mark.parametrize("side", [2, 3])
def test_coded_blocks(spark, tmp_path, side):
    rng = random.Random(side)
    cells = {(t, i, j): (i // 4) * 5 + t + (rng.random() < 0.08) * rng.randint(1, 9) for t in range(4) for i in range(SIZE[0]) for j in range(SIZE[1])}
    c = coded.save(coded.encode(tiles.build_tiles(frame(spark, cells), side, ["t"]), side, ["t"]), str(tmp_path / "c"))
    n_coded, n_raw = c.blocks.where("codeword > 0").count(), c.blocks.where("codeword = 0").count()
    assert (n_coded > n_raw > 0 or side == 3 and not n_coded) and c.blocks.where("codeword > 0 AND raw IS NOT NULL").count() == 0
    assert {(r["t"], r["row"], r["col"]): r["value"] for r in c.cells().collect()} == cells
    q, rows = boxes(spark, [0, 1, 2, 3])
    want = {(k, *p) for k, ps in matches(rows, cells)[1].items() for p in ps}
    assert {(r["query_id"], r["t"], r["row"], r["col"]) for r in c.cells_by_value(q).collect()} == want
    for r in c.settled(q).collect():
        assert r["n_none"] + r["n_all"] + r["n_open"] == r["n_pairs"] and r["n_none"] + r["n_all"] > 0
    points = [(i, rng.randrange(5), rng.randrange(13), rng.randrange(16)) for i in range(100)]
    got = {r["query_id"]: r["value"] for r in c.get_cells(spark.createDataFrame(points, "query_id long, t int, row int, col int")).collect()}
    assert got == {i: cells.get(p, 0) for i, *p in points for p in [tuple(p)]}


def test_codewords_are_numbered_without_a_hot_frequency(spark):
    kept = spark.range(2000).select(F.concat(F.lit("b"), F.lpad(F.col("id").cast("string"), 5, "0")).alias("block"), F.when(F.col("id") % 50 == 0, 9).otherwise(1).cast("bigint").alias("n"))
    got = [(r["n"], r["block"]) for r in stats.numbered(kept).orderBy("codeword").collect()]
    assert got == sorted(((r["n"], r["block"]) for r in kept.collect()), key=lambda x: (-x[0], x[1]))
    assert stats.numbered(kept).agg(F.min("codeword"), F.max("codeword"), F.countDistinct("codeword")).first()[:] == (1, 2000, 2000)


def zone_rasters(spark, kind):
    rng = random.Random(kind)
    values = {(i, j): 5 if i < 8 else rng.randint(-50, 50) for i in range(19) for j in range(18)}
    zones = {(i, j): (i // 4) * 10 + j // 4 if j < 8 else rng.randint(0, 3) for i in range(17) for j in range(22)}
    if kind == 2:
        values, zones = ({k: v for k, v in x.items() if rng.random() < 0.7} for x in (values, zones))
    return values, zones, frame(spark, values, m.CELLS), frame(spark, zones, m.CELLS)


@pytest.mark.parametrize("kind", [1, 2])
def test_zonal_sums_on_tiles(spark, kind):
    values, zones, a, z = zone_rasters(spark, kind)
    ta, tz = tiles.build_tiles(a, 4), tiles.build_tiles(z, 4)
    want = Counter()
    for k in values.keys() & zones.keys():
        want[zones[k]] += values[k]
    assert {r["zone"]: r["total"] for r in algebra.zonal_totals_tiles(ta, tz).collect()} == {k: want[k] for k in {zones[k] for k in values.keys() & zones.keys()}}
    got = {(r["row"], r["col"]): r["value"] for r in tiles.tile_cells(algebra.zonal_sum_tiles(ta, tz)).collect()}
    assert got == {k: want[zones[k]] for k in values.keys() & zones.keys()}
    kinds = {r["kind"] for r in algebra.zonal_pairs(ta, tz).collect()}
    assert kinds == {"uniform", "zone", "value", "mixed"} if kind == 1 else "cells" in kinds
    assert {(r["row"], r["col"]): r["value"] for r in algebra.zonal_sum(a, z).collect()} == got


def test_uniform_pairs_are_never_unpacked(spark):
    even = frame(spark, {(i, j): i // 4 for i in range(8) for j in range(8)}, m.CELLS)
    out = algebra.zonal_sum_tiles(tiles.build_tiles(even, 4), tiles.build_tiles(even, 4))
    assert all(r["is_uniform"] and len(r["values"]) == 1 for r in out.collect())
