"""Value searches on blocks encoded by a dictionary.

A block is its greatest value and a word: how far each of its cells lies below that. Words repeat
more than blocks do, over space and over all steps of a series, and those worth it have codewords
in one vocabulary (`stats.dictionary_blocks` on words). A search looks at the vocabulary first: a
word knows its deepest cell, so (codeword, greatest value) bounds a block's values, and a block is
dropped or taken whole without its word. Only mixed blocks meet the vocabulary again, which a join
on the codeword gives them, and are opened.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keys import in_window
from ..model import int_, long_
from . import query as q
from . import stats

_BLOCK = ["block_row", "block_col"]


@dataclass(frozen=True)
class CodedBlocks:
    """blocks: [t,] block_row, block_col, base_row, base_col, h, w, n_cells, top, codeword (0: none), raw
    (the word where there is no codeword), deep (its deepest cell); vocabulary: codeword, word, deep, n."""

    blocks: DataFrame
    vocabulary: DataFrame
    side: int
    keys: tuple[str, ...]

    def _pairs(self, queries: DataFrame) -> DataFrame:
        """Each query with each block that its window touches and the block's least and greatest value."""
        wide = q.touched_tiles(queries, self.side, self.keys).withColumnsRenamed({"tile_row": "block_row", "tile_col": "block_col"})
        hits = q.broadcast_if_small(wide).join(self.blocks, [*self.keys, *_BLOCK])
        known = self.vocabulary.select("codeword", F.col("deep").alias("word_deep"))
        hits = hits.join(known, "codeword", "left").withColumns({"max_value": F.col("top"), "min_value": F.col("top") - F.coalesce("word_deep", "deep")})
        return hits.where(q.touches())

    def cells_by_value(self, queries: DataFrame) -> DataFrame:
        """(query_id, [t,] row, col)"""
        may = self._pairs(queries).where(q.some_may_match())
        whole = q.all_match()
        carry = ["query_id", *self.keys, *q.BOUNDS, "valini", "valend", "base_row", "base_col", "w", "top"]
        taken = may.where(whole).select(*carry, F.explode(F.sequence(F.lit(0), F.col("n_cells") - 1)).alias("at"))
        mixed = may.where(~whole).select(*carry, "codeword", "raw").join(self.vocabulary.select("codeword", "word"), "codeword", "left")
        opened = mixed.select(*carry, F.posexplode(F.coalesce("raw", "word")).alias("at", "below"))
        opened = opened.where((F.col("top") - F.col("below")).between(F.col("valini"), F.col("valend"))).drop("below")
        row, col = F.col("base_row") + F.floor(F.col("at") / F.col("w")), F.col("base_col") + F.col("at") % F.col("w")
        out = taken.unionByName(opened).withColumns({"row": int_(row), "col": int_(col)})
        return out.where(in_window(F.col("row"), F.col("col"), F.col("xini"), F.col("xend"), F.col("yini"), F.col("yend"))).select("query_id", *self.keys, "row", "col")

    def settled(self, queries: DataFrame) -> DataFrame:
        """(coded, n_pairs, n_none, n_all, n_open): what the bounds of words settle, for blocks with a
        codeword and others."""
        hits = self._pairs(queries)
        none, all_ = ~q.some_may_match(), q.all_match()
        return hits.groupBy((F.col("codeword") > 0).alias("coded")).agg(F.count("*").alias("n_pairs"), F.count_if(none).alias("n_none"), F.count_if(all_).alias("n_all"), F.count_if(~none & ~all_).alias("n_open"))

    def get_cells(self, points: DataFrame) -> DataFrame:
        """points (query_id, row, col[, t]) with value, 0 outside: one element of one word."""
        wide = points.withColumns({f"block_{x}": int_(F.floor(F.col(x) / self.side)) for x in ("row", "col")})
        hits = q.broadcast_if_small(wide).join(self.blocks, [*self.keys, *_BLOCK]).join(self.vocabulary.select("codeword", "word"), "codeword", "left")
        r, c = F.col("row") - F.col("base_row"), F.col("col") - F.col("base_col")
        place = F.when((r >= 0) & (r < F.col("h")) & (c >= 0) & (c < F.col("w")), int_(r * F.col("w") + c))
        found = hits.select("query_id", (F.col("top") - F.get(F.coalesce("raw", "word"), place)).alias("value"))
        return points.join(found, "query_id", "left").select("query_id", *self.keys, "row", "col", long_(F.coalesce("value", F.lit(0))).alias("value"))

    def cells(self) -> DataFrame:
        """([t,] row, col, value) of everything."""
        full = self.blocks.join(self.vocabulary.select("codeword", "word"), "codeword", "left")
        out = full.select(*self.keys, "base_row", "base_col", "w", "top", F.posexplode(F.coalesce("raw", "word")).alias("at", "below"))
        row, col = F.col("base_row") + F.floor(F.col("at") / F.col("w")), F.col("base_col") + F.col("at") % F.col("w")
        return out.select(*self.keys, int_(row).alias("row"), int_(col).alias("col"), long_(F.col("top") - F.col("below")).alias("value"))


def words(tiles: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Tiles of one block each -> their greatest value and word. Sparse tiles aren't blocks and are an error."""
    spread = F.when(F.col("is_uniform"), F.array_repeat(F.col("values")[0], F.col("n_cells").cast("int"))).otherwise(F.col("values"))
    word = F.transform(spread, lambda v: long_(F.col("max_value") - v))
    word = F.when(F.col("positions").isNull(), word).otherwise(F.raise_error(F.lit("a block lacks cells")))
    at = [F.col("tile_row").alias("block_row"), F.col("tile_col").alias("block_col")]
    return tiles.select(*keys, *at, "base_row", "base_col", "h", "w", "n_cells", long_("max_value").alias("top"), word.alias("word"))


def encode(tiles: DataFrame, side: int, keys: Sequence[str] = ()) -> CodedBlocks:
    """Blocks are tiles of `side` cells a side; the vocabulary is that of all steps."""
    found = words(tiles, keys)
    text = F.array_join(F.col("word").cast("array<string>"), ",")
    frequency = found.groupBy(text.alias("block")).agg(F.count("*").alias("n"), F.first("word").alias("word"), long_(F.max("n_cells")).alias("size"))
    values = found.select(F.explode("word").alias("value")).groupBy("value").agg(F.count("*").alias("n"))
    kept = stats.worth_a_codeword(frequency, values)
    vocabulary = stats.numbered(kept, ["word"]).select("codeword", "word", F.array_max("word").alias("deep"), "n")
    coded = found.withColumn("block", text).join(vocabulary.select("codeword", F.array_join(F.col("word").cast("array<string>"), ",").alias("block")), "block", "left")
    raw = F.when(F.col("codeword").isNull(), F.col("word"))
    blocks = coded.select(*keys, *_BLOCK, "base_row", "base_col", "h", "w", "n_cells", "top", F.coalesce("codeword", F.lit(0)).cast("bigint").alias("codeword"), raw.alias("raw"), F.array_max(raw).alias("deep"))
    return CodedBlocks(blocks, vocabulary, side, tuple(keys))


def save(coded: CodedBlocks, path: str) -> CodedBlocks:
    """Both tables in Parquet, blocks by step; queries read these."""
    spark = coded.blocks.sparkSession
    coded.vocabulary.write.parquet(f"{path}/vocabulary")
    coded.blocks.write.partitionBy(*coded.keys).parquet(f"{path}/blocks")
    return CodedBlocks(spark.read.parquet(f"{path}/blocks"), spark.read.parquet(f"{path}/vocabulary"), coded.side, coded.keys)
