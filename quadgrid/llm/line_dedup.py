"""Line dedup: frequent lines go, except from the document with the largest id.

Line keys are hashed to 128 bits where the documents lie and counted by Spark. All distinct
hashes are dealt out over shards. Each shard is a minimal perfect hash (levels of bit arrays, a
key sits at the first level where no other key wants its bit) that indexes flat arrays of
fingerprints and counts, and of the keeping documents of counts from `min_docs` on, written as
one file in the shared folder. The documents then probe the files, memory-mapped, page by page,
and drop a line by the count found there: lines are never joined, and the index needs no
broadcast however large it grows.

Defined results: a null or empty text is one empty line; each row counts as a document (equal
doc_ids share the kept copy); a row without doc_id ranks below all others; a column of docs that
is named like a result (n_lines, n_dropped, kept_sha256) is replaced by it.
"""

from __future__ import annotations

import hashlib
import uuid
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import AtomicWriter, arrow_map, chunks, cut, encode, end_with_driver, make_dir, mix, open_map, shared_dir, table

SPACE = b" \t\n\x0b\x0c\r"
MIN_CHARS, MIN_DOCS = 40, 5
SHARD_ROWS = 250_000
NO_ID = -(1 << 63)


def line_key(line: bytes, min_chars: int) -> bytes | None:
    key = line.strip(SPACE).lower()
    if len(key) < min_chars or not key.isascii() and len(key.decode("utf-8", "surrogatepass")) < min_chars:
        return None
    return key


def _hash_pairs(keys: list[bytes]) -> np.ndarray:
    """The keys' 128-bit hashes, as rows of two 64-bit values."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, keys)), "<u8").reshape(-1, 2)


def line_counts(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """(h1, h2, n_docs, keep_id) of every key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in chunks(batch):
                ids, owners, keys = piece.column(0).to_pylist(), [], []
                for doc_id, text in zip(ids, piece.column(1).to_pylist()):
                    if text and len(text) >= min_chars:
                        own = {k for line in encode(text).split(b"\n") if (k := line_key(line, min_chars)) is not None}
                        keys += own
                        owners += [NO_ID if doc_id is None else doc_id] * len(own)
                if keys:
                    h = _hash_pairs(keys).view("<i8")
                    yield pa.RecordBatch.from_pydict({"h1": pa.array(h[:, 0]), "h2": pa.array(h[:, 1]), "doc_id": pa.array(owners, pa.int64())})

    found = arrow_map(docs.select(F.col("doc_id").cast("bigint"), "text"), run, "h1 long, h2 long, doc_id long")
    return found.groupBy("h1", "h2").agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("keep_id"))


def build_shard(h1: np.ndarray) -> tuple[np.ndarray, list[int], np.ndarray]:
    """A minimal perfect hash of distinct 64-bit keys: bit words of all levels, the level sizes
    in bits, and each key's index. A key that shares its h1 with another ends at a level of
    its own only if the two differ, so h1 must be distinct."""
    left, sizes, words = np.arange(len(h1)), [], []
    index, placed = np.zeros(len(h1), np.int64), 0
    while len(left):
        bits = max(64, -(-2 * len(left) // 64) * 64)
        want = _level_position(h1[left], len(sizes), bits)
        count = np.bincount(want, minlength=bits)
        alone = count[want] == 1
        taken = count == 1
        rank = np.cumsum(taken) - 1
        index[left[alone]] = placed + rank[want[alone]]
        placed += int(taken.sum())
        words.append(np.packbits(taken, bitorder="little").view("<u8"))
        sizes.append(bits)
        left = left[~alone]
    return np.concatenate(words) if words else np.empty(0, "<u8"), sizes, index


def _level_position(h: np.ndarray, level: int, bits: int) -> np.ndarray:
    return (mix(h + np.uint64((level + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) % np.uint64(bits)).astype(np.int64)


def shard_bytes(h1: np.ndarray, h2: np.ndarray, n_docs: np.ndarray, keep_id: np.ndarray, min_docs: int) -> bytes:
    """Header (keys, levels, keys apart, kept ids, bits of each level), bit words, ranks, fingerprints,
    counts (of 32 bits), the places of counts from min_docs on and their ids.

    Keys whose h1 is equal but h2 differs are apart: a short list behind the arrays.
    """
    _, first = np.unique(h1, return_index=True)
    rest = np.setdiff1d(np.arange(len(h1)), first)
    words, sizes, index = build_shard(h1[first])
    order = np.empty(len(first), np.int64)
    order[index] = first
    ranks = np.concatenate([[0], np.cumsum(np.bitwise_count(words).astype(np.int64))[:-1]]) if len(words) else np.empty(0, np.int64)
    counts = np.minimum(n_docs[order], 0xFFFFFFFF).astype("<u4")
    kept = np.flatnonzero(counts >= min_docs)
    head = np.array([len(first), len(sizes), len(rest), len(kept), *sizes], "<i8")
    columns = [head, words, ranks, h2[order], np.append(counts, np.zeros(len(counts) % 2, "<u4")), kept, keep_id[order][kept], *(c[rest] for c in (h1, h2, n_docs, keep_id))]
    return b"".join(np.ascontiguousarray(x).tobytes() for x in columns)


class Shard:
    def __init__(self, uri: str):
        a = open_map(uri, "<u8")
        n, levels, n_rest, n_kept = (int(x) for x in a[:4])
        self.sizes = [int(x) for x in a[4 : 4 + levels]]
        n_words, self.at = sum(self.sizes) // 64, 4 + levels

        def take(k: int) -> np.ndarray:
            self.at += k
            return a[self.at - k : self.at]

        self.words, self.ranks, self.h2 = take(n_words), take(n_words), take(n)
        self.counts = take((n + 1) // 2).view("<u4")
        self.kept, self.keep = take(n_kept).view("<i8"), take(n_kept).view("<i8")
        self.rest = np.array(take(4 * n_rest)).reshape(4, n_rest)

    def probe(self, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The count of each pair (0: no key of this shard) and the id kept with it, if any."""
        count, keep = np.zeros(len(h1), np.int64), np.zeros(len(h1), np.int64)
        left, base = np.arange(len(h1)), 0
        for level, bits in enumerate(self.sizes):
            if not len(left):
                break
            at = _level_position(h1[left], level, bits)
            word, bit = base + (at >> 6), (at & 63).astype(np.uint64)
            w = self.words[word]
            hit = (w >> bit) & np.uint64(1) == 1
            below = np.bitwise_count(w & ((np.uint64(1) << bit) - np.uint64(1))).astype(np.int64)
            index = (self.ranks[word].astype(np.int64) + below)[hit]
            who = left[hit]
            same = self.h2[index] == h2[who]
            index, who = index[same], who[same]
            count[who] = self.counts[index]
            if len(self.kept):
                place = np.minimum(np.searchsorted(self.kept, index), len(self.kept) - 1)
                has = self.kept[place] == index
                keep[who[has]] = self.keep[place[has]]
            left, base = left[~hit], base + bits // 64
        for r1, r2, n, k in self.rest.T:
            same = (h1 == r1) & (h2 == r2)
            count[same], keep[same] = int(n), k.astype(np.int64)
        return count, keep


class LineIndex:
    """The shards' files, opened as they are needed; at most OPEN stay open."""

    OPEN = 256

    def __init__(self, folder: str, names: dict[int, str], n_shards: int):
        self.folder, self.names, self.n, self.open = folder, names, n_shards, OrderedDict()

    def shard(self, s: int) -> Shard:
        if s not in self.open:
            if len(self.open) >= self.OPEN:
                self.open.popitem(last=False)
            self.open[s] = Shard(f"{self.folder}/{self.names[s]}")
        self.open.move_to_end(s)
        return self.open[s]

    def probe(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The counts (0: absent) and kept ids of rows (h1, h2)."""
        count, keep = np.zeros(len(h), np.int64), np.zeros(len(h), np.int64)
        which = h[:, 0].view(np.int64) % self.n
        order = np.argsort(which, kind="stable")
        for group in np.split(order, np.flatnonzero(np.diff(which[order])) + 1):
            if len(group) and (s := int(which[group[0]])) in self.names:
                count[group], keep[group] = self.shard(s).probe(h[group, 0], h[group, 1])
        return count, keep

    def contains(self, keys: np.ndarray) -> np.ndarray:
        """For an index of plain 64-bit keys (index_keys)."""
        keys = keys.view(np.uint64)
        return self.probe(np.stack([keys, keys], axis=1))[0] > 0

    def holds(self, column: pa.Array) -> pa.Array:
        """contains() of an integer column; a null is in no index."""
        keys = np.ascontiguousarray(column.fill_null(0).to_numpy(zero_copy_only=False))
        return pa.array(self.contains(keys) & column.is_valid().to_numpy(zero_copy_only=False))


def index_keys(keys: DataFrame) -> LineIndex:
    """The index of one column of distinct 64-bit integers."""
    (name,) = keys.columns
    key = F.col(name)
    return build_index(keys.select(key.alias("h1"), key.alias("h2"), F.lit(1).cast("bigint").alias("n_docs"), key.alias("keep_id")), min_docs=2)


def build_index(counted: DataFrame, min_docs: int = 1) -> LineIndex:
    """Write the shards' files from distinct rows (h1, h2, n_docs, keep_id); ids are kept for counts from min_docs on."""
    spark = counted.sparkSession
    folder = shared_dir(spark, "index")
    make_dir(folder)
    end_with_driver(spark, folder)
    counted = cut(counted, "counted-keys")
    n = max(1, -(-counted.count() // SHARD_ROWS))

    def write(pdf: pd.DataFrame) -> pd.DataFrame:
        s = int(pdf["shard"].iloc[0])
        out = AtomicWriter(f"{folder}/{(name := f'shard-{s:06d}-{uuid.uuid4().hex[:8]}')}")
        out.write(shard_bytes(*(pdf[c].to_numpy().view("<u8") for c in ("h1", "h2", "n_docs", "keep_id")), min_docs))
        out.commit()
        return pd.DataFrame({"shard": [s], "name": [name]})

    sharded = counted.withColumn("shard", F.pmod("h1", F.lit(n)))
    # One name for each shard: a row for each 250,000 keys.
    names = {r["shard"]: r["name"] for r in sharded.groupBy("shard").applyInPandas(write, "shard long, name string").collect()}
    return LineIndex(folder, names, n)


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, report: bool = True) -> DataFrame:
    """docs with the kept text in `text`, and n_lines, n_dropped and kept_sha256 beside it if `report`."""
    if report:
        docs = docs.drop("n_lines", "n_dropped", "kept_sha256")
    index = build_index(line_counts(docs, min_chars), min_docs)
    names = docs.columns
    at_id, at_text = names.index("doc_id"), names.index("text")
    schema = ", ".join(f"`{f.name}` {'string' if f.name == 'text' else f.dataType.simpleString()}" for f in docs.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in chunks(batch):
                lines_of, keys, where = [], [], []
                for i, text in enumerate(piece.column(at_text).to_pylist()):
                    lines_of.append(encode(text).split(b"\n"))
                    for j, line in enumerate(lines_of[i]):
                        if len(line) >= min_chars and (k := line_key(line, min_chars)) is not None:
                            keys.append(k)
                            where.append((i, j))
                ids = piece.column(at_id).to_pylist()
                n_lines, drop = [len(x) for x in lines_of], [set() for _ in lines_of]
                if keys:
                    count, keep = index.probe(_hash_pairs(keys))
                    for f in np.flatnonzero(count >= min_docs):
                        i, j = where[f]
                        if keep[f] != (NO_ID if ids[i] is None else ids[i]):
                            drop[i].add(j)
                kept = [b"\n".join([x for j, x in enumerate(ls) if j not in d]) if d else b"\n".join(ls) for ls, d in zip(lines_of, drop)]
                texts = pa.array([k.decode("utf-8", "surrogatepass") if d else None for k, d in zip(kept, drop)], pa.string())
                changed = pa.array([bool(d) for d in drop])
                old = piece.column(at_text).cast(pa.string())
                columns = list(piece.columns)
                columns[at_text] = pc.if_else(changed, texts, old)
                if not report:
                    yield pa.RecordBatch.from_arrays(columns, names=names)
                    continue
                extra = [pa.array(n_lines, pa.int64()), pa.array([len(d) for d in drop], pa.int64()), pa.array([hashlib.sha256(k).hexdigest() for k in kept])]
                yield pa.RecordBatch.from_arrays(columns + extra, names=[*names, "n_lines", "n_dropped", "kept_sha256"])

    return arrow_map(docs, run, schema + ", n_lines long, n_dropped long, kept_sha256 string" * report)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", "kept_sha256")


_SQL = """
WITH s AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT r, doc_id, generate_subscripts(lines, 1) AS i, unnest(lines) AS line FROM s),
k AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (
  SELECT key, max(coalesce(doc_id, -9223372036854775808)) AS keep_id FROM k WHERE length(key) >= 40
  GROUP BY key HAVING count(DISTINCT r) >= 5),
d AS (SELECT k.*, keep_id IS NOT NULL AND keep_id <> coalesce(doc_id, -9223372036854775808) AS dropped FROM k LEFT JOIN f USING (key))
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM d GROUP BY r
"""

QUERIES = {"op9_line_dedup": op9_line_dedup}
SQL = {"op9_line_dedup": _SQL}
