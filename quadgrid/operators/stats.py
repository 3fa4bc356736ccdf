"""Frequencies, entropy, the block dictionary and block means."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.keys import half_up
from ..model import cut, int_, long_


def value_frequency(cells: DataFrame) -> DataFrame:
    return cells.groupBy("value").agg(F.count("*").alias("n"))


def entropy(frequencies: DataFrame) -> DataFrame:
    """Bits for each of the counted things: log2(N) - sum(n log2 n) / N."""
    n = F.col("n").cast("double")
    return frequencies.agg((F.log2(F.sum(n)) - F.sum(n * F.log2(n)) / F.sum(n)).alias("entropy"))


def blocks(cells: DataFrame, side: int, keys: Sequence[str] = ()) -> DataFrame:
    """The values of each side x side block as text, in row order; `size` cells."""
    at = cells.withColumn("block_row", int_(F.floor(F.col("row") / side))).withColumn("block_col", int_(F.floor(F.col("col") / side)))
    listed = F.sort_array(F.collect_list(F.struct("row", "col", "value")))
    out = at.groupBy(*keys, "block_row", "block_col").agg(listed.alias("v"))
    return out.select(*keys, "block_row", "block_col", F.array_join(F.col("v.value").cast("array<string>"), ",").alias("block"), F.size("v").alias("size"))


def block_frequency(cells: DataFrame, side: int, keys: Sequence[str] = ()) -> DataFrame:
    return blocks(cells, side, keys).groupBy("block").agg(F.count("*").alias("n"))


def worth_a_codeword(found: DataFrame, values: DataFrame) -> DataFrame:
    """Of found (block, n, size, ...) the blocks that are cheaper as codewords: a block of S cells and
    frequency f stays if floor(32 S + f Hw) <= floor(f S Hv), with the entropies Hw of blocks and Hv of
    values (value, n)."""
    hw, hv = entropy(found).scalar(), entropy(values).scalar()
    return found.where(F.floor(32 * F.col("size") + F.col("n") * hw) <= F.floor(F.col("n") * F.col("size") * hv))


def numbered(kept: DataFrame, more: Sequence[str] = ()) -> DataFrame:
    """(codeword, block, n, ...): codewords from 1 by falling frequency, then by block.

    Rows are range-partitioned in that order and ranked within their partition; the counts of the
    partitions before give the base. Equal frequencies, which most entries have, are spread too."""
    order = [F.desc("n"), F.asc("block")]
    ranged = cut(kept.select("block", "n", *more).repartitionByRange(*order).withColumn("part", F.spark_partition_id()), "codewords")
    sizes = ranged.groupBy("part").agg(F.count("*").alias("k"))
    before = F.coalesce(F.sum("k").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row for each partition
    base = sizes.select("part", before.alias("base"))
    code = F.row_number().over(Window.partitionBy("part").orderBy(*order)) + F.col("base")
    return ranged.join(base, "part").select(long_(code).alias("codeword"), "block", "n", *more)


def dictionary_blocks(cells: DataFrame, side: int, keys: Sequence[str] = ()) -> DataFrame:
    """(codeword, block, n): the blocks that are cheaper as codewords, numbered by frequency. Blocks are
    counted once, into a table; entropies and the choice read that. Values are counted from it too."""
    found = cut(blocks(cells, side, keys).groupBy("block").agg(F.count("*").alias("n"), F.max("size").alias("size")), "blocks")
    values = found.select(F.explode(F.split("block", ",")).alias("value"), "n").groupBy("value").agg(F.sum("n").alias("n"))
    return numbered(worth_a_codeword(found, values))


def encode_blocks(cells: DataFrame, dictionary: DataFrame, side: int, keys: Sequence[str] = ()) -> DataFrame:
    """([keys,] block_row, block_col, codeword, raw): each block by its codeword; 0 where the
    dictionary lacks it, with the block itself in `raw`."""
    found = blocks(cells, side, keys).join(dictionary.select("codeword", "block"), "block", "left")
    return found.select(*keys, "block_row", "block_col", F.coalesce("codeword", F.lit(0).cast("bigint")).alias("codeword"), F.when(F.col("codeword").isNull(), F.col("block")).alias("raw"))


def decode_blocks(encoded: DataFrame, dictionary: DataFrame, side: int, n_cols: int, keys: Sequence[str] = ()) -> DataFrame:
    """The cells of encoded blocks; n_cols is the raster's width, where edge blocks end."""
    full = encoded.join(dictionary.select("codeword", "block"), "codeword", "left")
    width = F.least(F.lit(side), n_cols - F.col("block_col") * side)
    out = full.select(*keys, "block_row", "block_col", width.alias("w"), F.posexplode(F.split(F.coalesce("raw", "block"), ",")).alias("pos", "v"))
    row, col = F.col("block_row") * side + F.floor(F.col("pos") / F.col("w")), F.col("block_col") * side + F.col("pos") % F.col("w")
    return out.select(*keys, int_(row).alias("row"), int_(col).alias("col"), long_("v").alias("value"))


def block_mean(cells: DataFrame, side: int) -> DataFrame:
    at = [int_(F.floor(F.col(x) / side)).alias(f"block_{x}") for x in ("row", "col")]
    return cells.groupBy(*at).agg(half_up(F.avg("value")).alias("value"))


def block_means(cells: DataFrame, sides: Sequence[int]) -> DataFrame:
    """(side, block_row, block_col, value) for several sides, multiples of the least: the cells are
    summed to its blocks once, and these to all others."""
    least = min(sides)
    at = lambda step: [int_(F.floor(F.col(x) / step)).alias(x) for x in ("row", "col")]
    fine = cells.groupBy(*at(least)).agg(F.sum("value").alias("s"), F.count("*").alias("n"))
    levels = fine.select("row", "col", "s", "n", F.explode(F.array(*[F.lit(s) for s in sides])).alias("side"))
    node = [int_(F.floor(F.col(x) * least / F.col("side"))).alias(f"block_{x}") for x in ("row", "col")]
    return levels.groupBy("side", *node).agg(half_up(F.sum("s") / F.sum("n")).alias("value"))
