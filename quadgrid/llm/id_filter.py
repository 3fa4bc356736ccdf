"""Rows whose key is, or isn't, in a large set of keys, without moving the rows."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, free_name
from .line_dedup import LineIndex, index_keys


def key_index(ids: DataFrame) -> LineIndex:
    """The perfect-hash files of one column of integers, which tasks probe; nulls are left out."""
    (name,) = ids.columns
    return index_keys(ids.select(F.col(name).cast("bigint").alias("doc_id")).where("doc_id IS NOT NULL").distinct())


def rows_by_id(docs: DataFrame, ids: DataFrame | LineIndex, inside: bool, key: Column | None = None) -> DataFrame:
    """The rows of docs whose key (by default doc_id) is in `ids` (one column, or its key_index), or isn't; a null is in no set.

    Each task probes the ids' index in the shared folder; neither side is shuffled to the other,
    whatever their sizes.
    """
    index, n = ids if isinstance(ids, LineIndex) else key_index(ids), len(docs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = index.holds(batch.column(n))
                yield batch.select(range(n)).filter(found if inside else pc.invert(found))

    key = F.col("doc_id") if key is None else key
    return arrow_map(docs.select("*", key.cast("bigint").alias(free_name(docs, "_key"))), run, docs.schema)
