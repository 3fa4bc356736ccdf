"""Token-ID output: flat files of unsigned integers and 64-bit document offsets.

Documents are dealt out in ranges of ascending doc_id. Each task writes one part: `.bin` (the
ids of its documents one after another) and `.idx` (doc ids, then the document offsets within
the part, as 64-bit integers). A prefix sum over the parts' totals gives each part's base in
the whole sequence. Readers memory-map both files.

Defined results: null and empty texts hold the end id alone; a repeated doc_id has a document
for each row, in the order of a hash of the text; rows without doc_id come first.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import AtomicWriter, arrow_map, chunks, make_dir, open_map, shared_dir, table
from .tokens import TextEncoder, id_type

NO_ID = -(1 << 63)


@dataclass(frozen=True)
class TokenFiles:
    folder: str
    dtype: str
    #: (file name without suffix, ids before it, ids in it, documents in it), in order
    parts: tuple[tuple[str, int, int, int], ...]


def n_parts(spark: SparkSession) -> int:
    return max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))


def write_token_files(docs: DataFrame, vocabulary: str, end_id: int, folder: str | None = None) -> TokenFiles:
    """Encode docs (doc_id, text) and write them in ascending doc_id order."""
    spark = docs.sparkSession
    folder = folder or shared_dir(spark, "tokens")
    make_dir(folder)
    dtype = id_type(vocabulary).str

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, out = TextEncoder(vocabulary), TaskContext.get().partitionId(), None
        end = np.array([end_id], enc.dtype).tobytes()
        ids, ends, total = [], [], 0
        name = f"part-{part:06d}-{uuid.uuid4().hex[:8]}"
        for batch in batches:
            for piece in chunks(batch):
                out = out or AtomicWriter(f"{folder}/{name}.bin")
                doc_ids, texts = (piece.column(i).to_pylist() for i in (0, 1))
                made = [(enc.ids(t) if t else b"") + end for t in texts]
                out.write(b"".join(made))
                sizes = np.fromiter(map(len, made), np.int64, len(made)) // enc.dtype.itemsize
                ends.append(total + np.cumsum(sizes))
                total = int(ends[-1][-1])
                ids.append(np.array([NO_ID if d is None else d for d in doc_ids], np.int64))
        if out is None:
            return
        out.commit()
        index = AtomicWriter(f"{folder}/{name}.idx")
        index.write(np.concatenate(ids).tobytes())
        index.write(np.concatenate([[0], *ends]).astype("<i8").tobytes())
        index.commit()
        n = sum(map(len, ids))
        yield pa.RecordBatch.from_pydict({"part": [part], "name": [name], "n_tokens": [total], "n_docs": [n]})

    dealt = (
        docs.select(F.col("doc_id").cast("bigint"), "text")
        .repartitionByRange(n_parts(spark), "doc_id", F.xxhash64("text"))
        .sortWithinPartitions("doc_id", F.xxhash64("text"))
    )
    # One row for each part: the totals whose prefix sums are the bases.
    totals = arrow_map(dealt, write, "part long, name string, n_tokens long, n_docs long").collect()
    parts, base = [], 0
    for row in sorted(totals, key=lambda r: r["part"]):
        parts.append((row["name"], base, row["n_tokens"], row["n_docs"]))
        base += row["n_tokens"]
    return TokenFiles(folder, dtype, tuple(parts))


def read_token_files(spark: SparkSession, files: TokenFiles) -> DataFrame:
    """A row for each document: doc_id, start, n_tokens, ids_crc32, from the mapped files."""
    folder, dtype = files.folder, files.dtype
    parts = spark.createDataFrame(list(files.parts), "name string, base long, total long, n_docs long")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, base, total, n in zip(*(c.to_pylist() for c in batch.columns)):
                ids, index = open_map(f"{folder}/{name}.bin", dtype), open_map(f"{folder}/{name}.idx", "<i8")
                if len(ids) != total or len(index) != 2 * n + 1:
                    raise ValueError(f"{name}: {len(ids)} ids for {total}, {len(index)} index entries for {n} documents")
                doc_ids, offsets = index[:n], index[n:]
                for at in range(0, n, 4096):
                    ends = offsets[at : at + 4097]
                    crc = [zlib.crc32(ids[a:b].astype("<u4").tobytes()) for a, b in zip(ends[:-1], ends[1:])]
                    own = np.array(doc_ids[at : at + 4096])
                    yield pa.RecordBatch.from_pydict(
                        {
                            "doc_id": pa.array(own, mask=own == NO_ID),
                            "start": pa.array(base + ends[:-1]),
                            "n_tokens": pa.array(np.diff(ends)),
                            "ids_crc32": pa.array(crc, pa.int64()),
                        }
                    )

    dealt = parts.repartition(max(1, len(files.parts)))
    return arrow_map(dealt, read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document by word_bpe_49k.json with the end id 1, written and read back."""
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    files = write_token_files(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return read_token_files(spark, files)


QUERIES = {"op4_token_files": op4_token_files}
SQL: dict[str, str] = {}
