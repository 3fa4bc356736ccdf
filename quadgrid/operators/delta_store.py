"""Series stored as snapshot tiles and difference tiles, queried as they are.

A tile of a step is kept as the differences from the same tile of the step's snapshot, or as it is
where it is a snapshot's, has no counterpart there, or has other cells than it. A query reads the
tiles of its own steps and the snapshots' tiles behind them. The bounds of a sum lie between the
sums of the bounds, so the least and greatest values of the two tiles settle most pairs before
either is unpacked; only open pairs are added up, element by element.

The steps' snapshots come from `series.snapshot_steps` (every so many) or from `optimal_snapshots`,
which chooses them by size.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..model import int_, long_
from . import query as q
from . import store as stored
from .store import TileStore

_AT = ["tile_row", "tile_col"]
_BOX = ["base_row", "base_col", "h", "w"]
HEADER_BITS, POSITION_BITS = 64, 32


def _spread(values: Column, uniform: Column, n: Column) -> Column:
    return F.when(uniform, F.array_repeat(values[0], n.cast("int"))).otherwise(values)


def _differences(pairs: DataFrame) -> DataFrame:
    """pairs of a tile and its candidate (columns with _s): `same` if their cells correspond, and then
    their differences, one only where both are uniform."""
    same = F.col("n_cells") == F.col("n_cells_s")
    for c in [*_BOX, "positions"]:
        same &= F.col(c).eqNullSafe(F.col(f"{c}_s"))
    even = F.col("is_uniform") & F.col("is_uniform_s")
    minus = lambda x, y: x.cast("bigint") - y.cast("bigint")
    apart = F.zip_with(_spread(F.col("values"), F.col("is_uniform"), F.col("n_cells")), _spread(F.col("values_s"), F.col("is_uniform_s"), F.col("n_cells")), minus)
    apart = F.when(even, F.array(minus(F.col("values")[0], F.col("values_s")[0]))).otherwise(apart)
    return pairs.withColumn("same", F.coalesce(same, F.lit(False))).withColumn("apart", F.when(F.col("same"), apart))


def _beside(tiles: DataFrame) -> DataFrame:
    """Tiles as candidates: their step as snap_t, other columns with _s."""
    columns = [*_BOX, "n_cells", "is_uniform", "values", "positions"]
    return tiles.select(F.col("t").alias("snap_t"), *_AT, *[F.col(c).alias(f"{c}_s") for c in columns])


def delta_tiles(tiles: DataFrame, steps: DataFrame) -> DataFrame:
    """Tiles of a series, with steps (t, snap_t) -> tiles with snap_t; those with another snap_t than
    t hold differences. A tile of a snapshot has itself as snap_t."""
    at = tiles.join(steps.select("t", "snap_t"), "t")
    pairs = _differences(at.where("t <> snap_t").join(_beside(at.where("t = snap_t").drop("snap_t")), ["snap_t", *_AT], "left"))
    values = F.coalesce("apart", F.transform("values", lambda v: v.cast("bigint")))
    out = pairs.withColumn("snap_t", F.when(F.col("same"), F.col("snap_t")).otherwise(F.col("t"))).withColumn("values", values)
    out = out.withColumns({"min_value": F.array_min("values"), "max_value": F.array_max("values")})
    out = out.withColumn("is_uniform", F.col("min_value") == F.col("max_value"))
    out = out.withColumn("values", F.when(F.col("is_uniform"), F.slice("values", 1, 1)).otherwise(F.col("values"))).select(*at.columns)
    own = at.where("t = snap_t").withColumns({c: F.col(c).cast(out.schema[c].dataType) for c in ("values", "min_value", "max_value")})
    return own.select(*out.columns).unionByName(out)


@dataclass(frozen=True)
class DeltaStore:
    store: TileStore  # of tiles with snap_t
    steps: DataFrame  # (t, snap_t)

    def _sums(self, wide: DataFrame) -> DataFrame:
        """Rows with t and a tile's numbers, beside that tile's bounds and values at t. Bounds come from
        the two tiles' own; values are added only where they are used."""
        wide = wide.join(F.broadcast(self.steps.select("t", F.col("snap_t").alias("_snap"))), "t")  # a row for each step
        hits = self.store.join(wide.drop("_snap"))
        need = wide.where("t <> _snap").select(F.col("_snap").alias("t"), *_AT).distinct()
        base = self.store.join(need).select(F.col("t").alias("snap_t"), *_AT, *[F.col(c).alias(f"{c}_s") for c in ("min_value", "max_value", "is_uniform", "values")])
        pairs = hits.join(base, ["snap_t", *_AT], "left")
        apart = F.col("t") != F.col("snap_t")
        even = F.col("is_uniform") & F.col("is_uniform_s")
        plus = F.zip_with(_spread(F.col("values"), F.col("is_uniform"), F.col("n_cells")), _spread(F.col("values_s"), F.col("is_uniform_s"), F.col("n_cells")), lambda x, y: x + y)
        plus = F.when(even, F.array(F.col("values")[0] + F.col("values_s")[0])).otherwise(plus)
        return pairs.withColumns({
            "min_value": F.when(apart, F.col("min_value") + F.col("min_value_s")).otherwise(F.col("min_value")),
            "max_value": F.when(apart, F.col("max_value") + F.col("max_value_s")).otherwise(F.col("max_value")),
            "values": F.when(apart, plus).otherwise(F.col("values")),
            "is_uniform": F.when(apart, even).otherwise(F.col("is_uniform")),
        })

    def on(self, queries: DataFrame) -> DataFrame:
        return self._sums(q.touched_tiles(queries, self.store.tile, ("t",)))

    def get_cells(self, points: DataFrame) -> DataFrame:
        return q.picked(points, self._sums(self.store.tiles_of(points)), ("t",), "bigint")

    def cells_by_value(self, queries: DataFrame) -> DataFrame:
        return q.matching_cells(self.on(queries), ("t",))

    def count_by_value(self, queries: DataFrame) -> DataFrame:
        return q.matching_counts(queries, self.on(queries), ("t",))

    def check(self, queries: DataFrame, strong: bool) -> DataFrame:
        return q.checked(queries, self.on(queries), strong, ("t",))

    def settled(self, queries: DataFrame) -> DataFrame:
        """(relative, n_pairs, n_none, n_all): how many query-tile pairs the bounds alone settle, of
        difference tiles (relative) and of tiles kept as they are."""
        hits = self.on(queries).where(q.touches())
        none, all_ = ~q.some_may_match(), q.inside() & q.all_match()
        return hits.groupBy((F.col("t") != F.col("snap_t")).alias("relative")).agg(F.count("*").alias("n_pairs"), F.count_if(none).alias("n_none"), F.count_if(all_ & ~none).alias("n_all"))


def save(tiles: DataFrame, steps: DataFrame, path: str, tile: int, region: int = stored.REGION) -> DeltaStore:
    """Store the tiles of a series by snapshots and differences; steps is (t, snap_t)."""
    stored.save(delta_tiles(tiles, steps), path, tile, ("t",), region, levels=1)
    steps.select("t", "snap_t").write.parquet(f"{path}/steps")
    return load(tiles.sparkSession, path)


def load(spark: SparkSession, path: str) -> DeltaStore:
    return DeltaStore(stored.load(spark, path), spark.read.parquet(f"{path}/steps"))


# --- snapshots by size -----------------------------------------------------------------------


def _bits(n: Column, values: Column, positions: Column) -> Column:
    """The size of a packed tile: a header, and for each cell the bits that its range needs."""
    span = F.array_max(values) - F.array_min(values)
    each = F.when(span == 0, 0).otherwise(F.length(F.bin(span)))
    return (HEADER_BITS + n * each + POSITION_BITS * F.coalesce(F.array_size(positions), F.lit(0))).cast("bigint")


def step_costs(tiles: DataFrame, horizon: int) -> DataFrame:
    """(t, snap_t, bits): the size of each step as a snapshot (snap_t = t), and as differences from each
    of the `horizon` steps before it. Every pair of tiles is measured in its own row."""
    number = F.row_number().over(Window.orderBy("t"))  # a row for each step
    steps = tiles.select("t").distinct().withColumn("i", number)
    a, b = steps.alias("a"), steps.alias("b")
    back = F.explode(F.sequence(F.col("i") - horizon, F.col("i") - 1))
    candidates = a.select("t", back.alias("i")).join(b.select(F.col("t").alias("snap_t"), "i"), "i").select("t", "snap_t")
    own = tiles.groupBy("t").agg(F.sum(_bits(F.col("n_cells"), F.col("values"), F.col("positions"))).alias("bits")).select("t", F.col("t").alias("snap_t"), "bits")
    pairs = _differences(tiles.join(candidates, "t").join(_beside(tiles), ["snap_t", *_AT], "left"))
    # A tile whose cells don't correspond is kept as it is.
    cost = F.when(F.col("same"), _bits(F.col("n_cells"), F.col("apart"), F.lit(None).cast("array<int>"))).otherwise(_bits(F.col("n_cells"), F.col("values"), F.col("positions")))
    return own.unionByName(pairs.groupBy("t", "snap_t").agg(F.sum(cost).alias("bits"))).select(int_("t").alias("t"), int_("snap_t").alias("snap_t"), long_("bits").alias("bits"))


def optimal_snapshots(tiles: DataFrame, horizon: int) -> DataFrame:
    """(t, is_snapshot, snap_t, bits): the choice of least total size where a step lies at most
    `horizon` steps behind its snapshot; of equal choices the one with the later last snapshot.

    The costs are a table of Spark's; the choice walks along time on the driver, over
    steps x (horizon + 1) numbers."""
    spark = tiles.sparkSession
    cost = {(r["t"], r["snap_t"]): r["bits"] for r in step_costs(tiles, horizon).collect()}
    steps = sorted({t for t, _ in cost})
    best, pick = [0], []
    for j in range(len(steps)):
        found = []
        for i in range(max(0, j - horizon), j + 1):  # the last snapshot; those after it are differences from it
            found.append((best[i] + sum(cost[steps[u], steps[i]] for u in range(i, j + 1)), -i))
        total, i = min(found)
        best.append(total)
        pick.append(-i)
    rows, j = [], len(steps) - 1
    while j >= 0:
        i = pick[j]
        rows += [(steps[u], u == i, steps[i], cost[steps[u], steps[i]]) for u in range(i, j + 1)]
        j = i - 1
    return spark.createDataFrame(rows, "t int, is_snapshot boolean, snap_t int, bits bigint")
