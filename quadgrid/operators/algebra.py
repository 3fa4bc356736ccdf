"""Map algebra: pointwise, scalar, threshold and zonal, on cells and on tiles. Results are BIGINT."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..model import cut, long_
from .query import broadcast_if_small
from .tiles import build_tiles, tile_cells

OPS = {"sum": lambda a, b: a + b, "sub": lambda a, b: a - b, "mul": lambda a, b: a * b}


def pointwise(a: DataFrame, b: DataFrame, op: str, keys: Sequence[str] = ("row", "col")) -> DataFrame:
    """On the common extent, which the inner join is."""
    joined = a.select(*keys, long_("value").alias("va")).join(b.select(*keys, long_("value").alias("vb")), list(keys))
    return joined.select(*keys, OPS[op](F.col("va"), F.col("vb")).alias("value"))


def _tile_pairs(a: DataFrame, b: DataFrame):
    """Tiles of one place side by side (columns with _a and _b), the condition that their arrays
    correspond from the same corner on, and a function that unpacks one side of the other pairs."""
    on, box = ["tile_row", "tile_col"], ["base_row", "base_col", "h", "w", "is_uniform", "positions"]
    side = lambda t, s: t.select(*on, *[F.col(c).alias(f"{c}_{s}") for c in box], F.transform("values", lambda x: x.cast("bigint")).alias(f"values_{s}"))
    joined = side(a, "a").join(side(b, "b"), on)
    aligned = F.col("positions_a").isNull() & F.col("positions_b").isNull() & (F.col("base_row_a") == F.col("base_row_b")) & (F.col("base_col_a") == F.col("base_col_b"))
    back = lambda s: tile_cells(joined.where(~aligned).select(*on, *[F.col(f"{c}_{s}").alias(c) for c in [*box, "values"]]), on)
    return joined, aligned, back, on


def _common(joined: DataFrame) -> tuple[DataFrame, Column]:
    """Corresponding pairs with the height and width that both have, and that box's size."""
    same = joined.withColumns({"h": F.least("h_a", "h_b"), "w": F.least("w_a", "w_b")})
    return same, (F.col("h") * F.col("w")).cast("int")


def _cropped(s: str, n: Column) -> Column:
    """A side's values in the common box; a uniform side has its one."""
    v, w, uniform = F.col(f"values_{s}"), F.col(f"w_{s}"), F.col(f"is_uniform_{s}")
    cut_ = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(v, (F.floor(i / F.col("w")) * w + i % F.col("w")).cast("int")))
    whole = (w == F.col("w")) & (F.col(f"h_{s}") == F.col("h"))
    return F.when(uniform | whole, v).otherwise(cut_)


def zonal_pairs(a: DataFrame, zones: DataFrame) -> DataFrame:
    """(kind, zone, total): each pair of tiles' part in the zones' totals, by its case.

    uniform: two uniform tiles give value times count; zone: an array under one zone is folded; value:
    one value under several zones is multiplied with their counts; mixed: only here cells meet, in the
    pair's own arrays. Pairs that don't correspond (sparse tiles, other corners) are joined by cell."""
    joined, aligned, back, on = _tile_pairs(a, zones)
    same, n = _common(joined.where(aligned))
    ua, uz, va, vz = F.col("is_uniform_a"), F.col("is_uniform_b"), _cropped("a", n), _cropped("b", n)
    zero = F.lit(0).cast("bigint")
    whole = same.where(uz).select(
        F.when(ua, "uniform").otherwise("zone").alias("kind"), vz[0].alias("zone"), F.when(ua, va[0] * n).otherwise(F.aggregate(va, zero, lambda s, v: s + v)).alias("total")
    )
    many = same.where(~uz)
    zone_counts = many.where(ua).select(F.lit("value").alias("kind"), va[0].alias("v"), F.explode(vz).alias("zone")).groupBy("kind", "zone", "v").agg((F.col("v") * F.count("*")).alias("total")).select("kind", "zone", "total")
    cells = many.where(~ua).select(F.lit("mixed").alias("kind"), F.explode(F.zip_with(va, vz, lambda v, z: F.struct(v.alias("v"), z.alias("z")))).alias("c")).select("kind", F.col("c.z").alias("zone"), F.col("c.v").alias("total"))
    apart = _in_zones(back("a"), back("b"), [*on, "row", "col"]).select(F.lit("cells").alias("kind"), long_("zone").alias("zone"), long_("value").alias("total"))
    out = whole.unionByName(zone_counts).unionByName(cells).unionByName(apart)
    return out.groupBy("kind", "zone").agg(long_(F.sum("total")).alias("total"))


def zonal_totals_tiles(a: DataFrame, zones: DataFrame) -> DataFrame:
    """(zone, total) from tiles; equal to zonal_totals of their cells."""
    return zonal_pairs(a, zones).groupBy("zone").agg(long_(F.sum("total")).alias("total"))


def zonal_sum_tiles(a: DataFrame, zones: DataFrame) -> DataFrame:
    """Each zone's total in all its cells, as tiles: a tile of one zone becomes uniform without unpacking;
    another one looks its few zones up. a only bounds the extent here, by its boxes."""
    totals = broadcast_if_small(cut(zonal_totals_tiles(a, zones), "totals"))  # a row for each zone
    joined, aligned, back, on = _tile_pairs(a, zones)
    same, n = _common(joined.where(aligned))
    box = [*on, F.col("base_row_a").alias("base_row"), F.col("base_col_a").alias("base_col"), "h", "w", n.cast("bigint").alias("n_cells"), F.lit(None).cast("array<int>").alias("positions")]
    one = same.where("is_uniform_b").select(*box, F.col("values_b")[0].alias("zone")).join(totals, "zone").withColumn("values", F.array("total")).drop("zone", "total")
    held = same.where("NOT is_uniform_b").select(*box, _cropped("b", n).alias("zones"))
    looked = held.select(*on, F.explode(F.array_distinct("zones")).alias("zone")).join(totals, "zone").groupBy(*on).agg(F.map_from_entries(F.collect_list(F.struct("zone", "total"))).alias("totals"))
    many = held.join(looked, on).withColumn("values", F.transform("zones", lambda z: F.col("totals")[z])).drop("zones", "totals")
    met = _in_zones(back("a"), back("b"), [*on, "row", "col"]).join(totals, "zone").select(*on, "row", "col", F.col("total").alias("value"))
    out = _bounds(one.unionByName(many))
    return out.unionByName(_tiles_of(met, on).select(*out.columns))


def pointwise_tiles(a: DataFrame, b: DataFrame, op: str) -> DataFrame:
    """On the common extent, where tiles of one place may differ in height and width: two uniform
    tiles make a uniform one without unpacking, and a larger one is cropped in its array. Pairs with
    a sparse tile, or with different corners, are joined by cell."""
    joined, aligned, back, on = _tile_pairs(a, b)
    same, n = _common(joined.where(aligned))
    both = F.col("is_uniform_a") & F.col("is_uniform_b")
    wide = lambda s: F.when(F.col(f"is_uniform_{s}") & ~both, F.array_repeat(F.col(f"values_{s}")[0], n)).otherwise(_cropped(s, n))
    out = _bounds(same.withColumn("values", F.zip_with(wide("a"), wide("b"), OPS[op])))
    columns = [*on, F.col("base_row_a").alias("base_row"), F.col("base_col_a").alias("base_col"), "h", "w", "min_value", "max_value", n.cast("bigint").alias("n_cells"), "is_uniform", "values", F.lit(None).cast("array<int>").alias("positions")]
    out = out.select(*columns)
    met = pointwise(back("a"), back("b"), op, [*on, "row", "col"])
    return out.unionByName(_tiles_of(met, on).select(*out.columns))


def _tiles_of(cells: DataFrame, on: Sequence[str]) -> DataFrame:
    """Tiles of cells that know their tile; the corner of the common part is that of its cells."""
    built = build_tiles(cells.withColumnsRenamed({c: f"own_{c}" for c in on}), 1 << 30, [f"own_{c}" for c in on])
    return built.drop(*on).withColumnsRenamed({f"own_{c}": c for c in on})


def _bounds(tiles: DataFrame) -> DataFrame:
    out = tiles.withColumn("min_value", F.array_min("values")).withColumn("max_value", F.array_max("values"))
    out = out.withColumn("is_uniform", F.col("min_value") == F.col("max_value"))
    return out.withColumn("values", F.when(F.col("is_uniform"), F.slice("values", 1, 1)).otherwise(F.col("values")))


def scalar(a: DataFrame, s: int, op: str) -> DataFrame:
    keys = [c for c in a.columns if c != "value"]
    return a.select(*keys, OPS[op](long_("value"), F.lit(s).cast("bigint")).alias("value"))


def scalar_tiles(tiles: DataFrame, s: int, op: str) -> DataFrame:
    """Least and greatest values follow from the old ones; a negative factor changes their roles."""
    f = lambda x: OPS[op](x.cast("bigint"), F.lit(s).cast("bigint"))
    lo, hi = f(F.col("min_value")), f(F.col("max_value"))
    return tiles.withColumns({"values": F.transform("values", f), "min_value": F.least(lo, hi), "max_value": F.greatest(lo, hi)}).withColumn(
        "is_uniform", F.col("min_value") == F.col("max_value")
    )


def threshold(a: DataFrame, at: int) -> DataFrame:
    """1 where value >= at, else 0."""
    keys = [c for c in a.columns if c != "value"]
    return a.select(*keys, F.when(F.col("value") >= at, 1).otherwise(0).alias("value"))


def threshold_tiles(tiles: DataFrame, at: int) -> DataFrame:
    """Tiles on one side of the threshold become uniform without unpacking."""
    one = lambda x: F.when(x >= at, 1).otherwise(0)
    values = F.when((F.col("min_value") >= at) | (F.col("max_value") < at), F.array(one(F.col("min_value")))).otherwise(F.transform("values", one))
    return _bounds(tiles.withColumn("values", values))


def ones_percent(binary: DataFrame) -> DataFrame:
    return binary.agg(F.floor(F.sum(long_("value")) * 100 / F.count("*")).cast("bigint").alias("pct"))


def zonal_totals(a: DataFrame, zones: DataFrame, keys: Sequence[str] = ("row", "col")) -> DataFrame:
    """(zone, total) on the common extent: partial sums first, so hot zones don't matter."""
    return _totals(_in_zones(a, zones, keys))


def _in_zones(a: DataFrame, zones: DataFrame, keys: Sequence[str]) -> DataFrame:
    return a.select(*keys, "value").join(zones.select(*keys, F.col("value").alias("zone")), list(keys))


def _totals(in_zones: DataFrame) -> DataFrame:
    return in_zones.groupBy("zone").agg(long_(F.sum(long_("value"))).alias("total"))


def zonal_sum(a: DataFrame, zones: DataFrame, keys: Sequence[str] = ("row", "col")) -> DataFrame:
    """Each zone's total in all its cells: one join of values and zones, whose totals join back to it."""
    common = _in_zones(a, zones, keys)
    return common.join(_totals(common), "zone").select(*keys, F.col("total").alias("value"))


def weighted_sum(tiles: DataFrame) -> Column | DataFrame:
    """The sum of all cells, uniform tiles as value times count."""
    whole = tiles.where("is_uniform").select((long_(F.col("values")[0]) * F.col("n_cells")).alias("v"))
    rest = tile_cells(tiles.where("NOT is_uniform")).select(long_("value").alias("v"))
    return whole.unionByName(rest).agg(long_(F.sum("v")).alias("total"))
