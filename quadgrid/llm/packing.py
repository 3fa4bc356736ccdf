"""Packing: concatenate and cut.

Pass one encodes the documents where they lie and writes, for each partition, the ids with
their place in that partition. The partitions' token totals give, by prefix sum, each
partition's place in one endless sequence. Pass two cuts that sequence at every multiple of
the window and returns a record for each piece between two boundaries.

Defined results: null and empty texts are the end id alone; repeated rows are documents of
their own; only the last sequence may be shorter than the window.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, chunks, cut, table
from .tokens import TextEncoder, id_type

WINDOW, END_ID, VOCABULARY = 1024, 0, "byte_bpe_50k.json"
_TOKENS = "part int, local_start long, doc_id long, ids binary"
_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def encode_partitions(docs: DataFrame, vocabulary: str, end_id: int) -> DataFrame:
    """Pass one: the ids of each document and where they start in its partition, as a table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, total = TextEncoder(vocabulary), TaskContext.get().partitionId(), 0
        end = np.array([end_id], enc.dtype).tobytes()
        for batch in batches:
            for piece in chunks(batch):
                ids = [(enc.ids(t) if t else b"") + end for t in piece.column(1).to_pylist()]
                ends = total + np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)) // enc.dtype.itemsize)
                starts = np.concatenate([[total], ends[:-1]])
                total = int(ends[-1])
                yield pa.RecordBatch.from_pydict(
                    {"part": pa.array(np.full(len(ids), part, np.int32)), "local_start": pa.array(starts), "doc_id": piece.column(0), "ids": pa.array(ids, pa.binary())}
                )

    return cut(arrow_map(docs.select(F.col("doc_id").cast("bigint"), "text"), run, _TOKENS), "packing")


def cut_windows(tokens: DataFrame, window: int, dtype: str, with_ids: bool = False) -> DataFrame:
    """Pass two: the pieces; with_ids adds each piece's ids as little-endian integers."""
    width = np.dtype(dtype).itemsize
    # One total for each partition, summed where the rows are.
    totals = tokens.groupBy("part").agg(F.sum(F.octet_length("ids") / F.lit(width)).cast("bigint").alias("n")).collect()
    bases, at = {}, 0
    for row in sorted(totals, key=lambda r: r["part"]):
        bases[row["part"]] = at
        at += row["n"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                rows = {k: [] for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")}
                slices = []
                for part, local, doc_id, raw in zip(*(c.to_pylist() for c in batch.slice(at, 2000).columns)):
                    ids, first = np.frombuffer(raw, dtype), bases[part] + local
                    n = len(ids)
                    wide = ids.astype("<u4")
                    cuts = [0, *range(window - first % window, n, window), n]
                    for a, b in zip(cuts[:-1], cuts[1:]):
                        rows["doc_id"].append(doc_id)
                        rows["start"].append(a)
                        rows["length"].append(b - a)
                        rows["ids_crc32"].append(zlib.crc32(wide[a:b].tobytes()))
                        rows["doc_tokens"].append(n)
                        rows["sequence_id"].append((first + a) // window)
                        rows["offset"].append((first + a) % window)
                        if with_ids:
                            slices.append(ids[a:b].tobytes())
                columns = {k: pa.array(v, pa.int64()) for k, v in rows.items()}
                if with_ids:
                    columns["ids"] = pa.array(slices, pa.binary())
                yield pa.RecordBatch.from_pydict(columns)

    return arrow_map(tokens, run, _PIECES + ", ids binary" * with_ids)


def pack(docs: DataFrame, vocabulary: str, window: int = WINDOW, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    tokens = encode_partitions(docs, vocabulary, end_id)
    return cut_windows(tokens, window, id_type(vocabulary).str, with_ids)


def sequences(pieces: DataFrame) -> DataFrame:
    """The windows themselves from pieces with ids: sequence_id, ids (little-endian integers).

    A window holds at most `window` pieces, so a group is never larger than a window.
    """
    part = F.struct("offset", "ids")
    return pieces.groupBy("sequence_id").agg(F.sort_array(F.collect_list(part)).alias("p")).select(
        "sequence_id", F.aggregate(F.col("p.ids"), F.lit(b""), lambda a, x: F.concat(a, x)).alias("ids")
    )


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return pack(docs, public_tokenizers.path(VOCABULARY))


QUERIES = {"op6_packing": op6_packing}
SQL: dict[str, str] = {}
