"""Benchmark decontamination by SimHash of item-sized windows.

Words are runs of letters and digits in lower case; a window has as many words as an item (or
the whole text, if that is shorter), and both are multisets of 5-word shingles (fewer words
make one shingle). A 64-bit SimHash is taken of every item and of every window that has
a shingle of some item of its size; other windows have similarity 0. Fingerprints are cut
into eight blocks of eight bits: two within the radius differ in three bits or fewer in one
block at least, so looking up each block's neighbourhood finds all of them. What is within the
radius is then compared exactly: the similarity is the sum of the lesser over the sum of the
greater counts. Every shingle weighs 1, so neither the result nor the votes for a fingerprint
depend on how often an item stands in the benchmark, or on how the items are dealt into blocks. (The radius is
an estimate: a window that passes, but has one unknown shingle many times, may lie outside it.)

The items are the stated query set. Tasks turn them into a table of shingles and fingerprints in
the shared folder, dealt by a hash into blocks of about `ITEMS` items and `ITEM_BYTES` of text.
With one block, each task reads that table and scans its documents. With more, the documents are read
once still: a perfect-hash index of all benchmark shingles says which blocks a document shares a
shingle with, and the document goes to the tasks of those blocks, a block's documents to many.

Defined results: null and empty texts and items have no windows and match nothing; an item of
any length counts (an item longer than ITEM_BYTES makes its block as large as itself); repeated
documents are judged alike; items of equal text and other ids each give a row, equal rows of the
benchmark one; of windows that tie in similarity the first is given; a null doc_id stays null.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs as pafs
import pyarrow.parquet as pq
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, chunks, end_with_driver, filesystem, mix, shared_dir, shingle_hashes, table
from .line_dedup import build_index

SIZE, LEAST, RADIUS = 5, 0.75, 24
BLOCK_BITS, N_BLOCKS = 8, 8
ITEMS, ITEM_BYTES = 20_000, 8 << 20
FILTER_BITS = 22
MASK_BITS = 63  # blocks are told apart by the bit that their number leaves
_WORD = regex.compile(r"[\p{L}\p{M}\p{N}]+")


class Words(dict):
    LIMIT = 400_000

    def __missing__(self, word: str) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, text: str | None) -> np.ndarray:
        found = _WORD.findall(text.lower()) if text else []
        return np.fromiter(map(self.__getitem__, found), np.uint64, len(found))


def bit_signs(shingles: np.ndarray) -> np.ndarray:
    """[shingles, 64] of +1 and -1: the bits that each shingle votes for."""
    h = mix(shingles ^ np.uint64(0xA5A5A5A55A5A5A5A))
    return np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.int8) * 2 - 1


def pack_bits(votes: np.ndarray) -> np.ndarray:
    return np.packbits(votes > 0, axis=1, bitorder="little").view(np.uint64).ravel()


def fingerprint(shingles: np.ndarray) -> np.ndarray:
    votes = np.zeros((1, 64), np.int64)
    for at in range(0, len(shingles), 1 << 16):
        votes += bit_signs(shingles[at : at + (1 << 16)]).sum(axis=0, keepdims=True, dtype=np.int64)
    return pack_bits(votes)


def neighbourhood() -> np.ndarray:
    """[256, n]: for each value of a block, the n values within RADIUS // N_BLOCKS bits of it."""
    x = np.arange(1 << BLOCK_BITS)
    near = np.bitwise_count(x[:, None] ^ x[None, :]) <= RADIUS // N_BLOCKS
    return np.nonzero(near)[1].astype(np.uint8).reshape(len(x), -1)


class Group:
    """The items of one word count, indexed by the blocks of their fingerprints when first asked."""

    def __init__(self, n_words: int, items: np.ndarray, fingerprints: np.ndarray):
        self.n_words, self.items, self.fingerprints = n_words, items, fingerprints
        self.tables: list[tuple[np.ndarray, np.ndarray]] = []  # items by near value of a block, where each value starts

    def index(self) -> None:
        near = neighbourhood()
        blocks = self.fingerprints.view(np.uint8).reshape(-1, N_BLOCKS)
        for b in range(N_BLOCKS):
            values = near[blocks[:, b]].ravel()
            order = np.argsort(values, kind="stable")
            starts = np.searchsorted(values[order], np.arange((1 << BLOCK_BITS) + 1))
            self.tables.append(((order // near.shape[1]).astype(np.int32), starts))

    def within(self, fingerprint: np.uint64) -> np.ndarray:
        """The items (positions in this group) within RADIUS of a fingerprint."""
        if not self.tables:
            self.index()
        blocks = np.array([fingerprint]).view(np.uint8).tolist()
        at = np.unique(np.concatenate([t[starts[v] : starts[v + 1]] for (t, starts), v in zip(self.tables, blocks)]))
        return at[np.bitwise_count(self.fingerprints[at] ^ fingerprint) <= RADIUS]


class Benchmark:
    """One block of items, from its rows (item_id, n_words, shingles, fingerprint)."""

    def __init__(self, rows: pa.Table):
        lists = rows["shingles"].combine_chunks()
        sizes = pc.list_value_length(lists).to_numpy()
        self.ids, lengths = rows["item_id"].to_pylist(), rows["n_words"].to_numpy()
        self.shingles, self.ends = lists.flatten().to_numpy().view(np.uint64), np.append(0, np.cumsum(sizes))
        self.counts: dict[int, Counter] = {}
        prints = rows["fingerprint"].to_numpy().view(np.uint64)
        self.groups = {int(n): Group(int(n), at := np.flatnonzero(lengths == n), prints[at]) for n in np.unique(lengths)}
        # Each shingle once, with the word counts of the items that have it.
        owner = np.repeat(lengths, sizes)
        order = np.lexsort((owner, self.shingles))
        shingle, owner = self.shingles[order], owner[order]
        new = np.ones(len(order), bool)
        new[1:] = (shingle[1:] != shingle[:-1]) | (owner[1:] != owner[:-1])
        shingle, self.owners = shingle[new], owner[new]
        self.known, first = np.unique(shingle, return_index=True)
        self.owned = np.append(first, len(shingle))
        self.filter = np.zeros(1 << FILTER_BITS, bool)
        self.filter[(self.known >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True
        self.short = sorted({n for n in self.groups if n < SIZE})

    def hits(self, shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where a shingle of the benchmark stands, once for each word count of items that have it, and that count."""
        at = np.flatnonzero(self.filter[(shingles >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])
        if not len(at):
            return at, at
        place = np.minimum(np.searchsorted(self.known, shingles[at]), len(self.known) - 1)
        same = self.known[place] == shingles[at]
        at, place = at[same], place[same]
        n = self.owned[place + 1] - self.owned[place]
        nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return np.repeat(at, n), self.owners[np.repeat(self.owned[place], n) + nth]

    def count(self, item: int) -> Counter:
        if item not in self.counts:
            self.counts[item] = Counter(self.shingles[self.ends[item] : self.ends[item + 1]].tolist())
        return self.counts[item]

    def similarity(self, item: int, window: np.ndarray) -> float:
        mine, other = self.count(item), Counter(window.tolist())
        less = sum(min(n, other[s]) for s, n in mine.items() if s in other)
        return less / (mine.total() + len(window) - less)

    def matches(self, words: np.ndarray) -> list[tuple[int, int, int, float]]:
        """(item, first word, words, similarity) of the best window for each item found."""
        best: dict[int, tuple[float, int, int]] = {}
        for size in [SIZE, *self.short]:
            n = len(words)
            if n < size and size != SIZE:
                continue
            k = min(size, n)
            if not k:
                continue
            shingles = shingle_hashes(words, size)
            hits, lengths = self.hits(shingles)
            fit = (np.minimum(lengths, SIZE) == size) | ((lengths > n) & (k < SIZE))
            order = np.flatnonzero(fit)[np.argsort(lengths[fit], kind="stable")]
            for at in np.split(order, np.flatnonzero(np.diff(lengths[order])) + 1):
                if len(at):
                    self._windows(self.groups[int(lengths[at[0]])], shingles, hits[at], n, k, best)
        return [(i, start, length, s) for i, (s, start, length) in best.items()]

    def _windows(self, group: Group, shingles: np.ndarray, hits: np.ndarray, n: int, k: int, best: dict) -> None:
        length = min(group.n_words, n)
        per = length - k + 1  # shingles in a window
        edge = np.zeros(n - length + 2, np.int64)  # window starts that hold a hit
        np.add.at(edge, np.maximum(hits - per + 1, 0), 1)
        np.add.at(edge, np.minimum(hits, n - length) + 1, -1)
        starts = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
        for run in np.split(starts, np.flatnonzero(np.diff(starts) > 1) + 1):
            for at in range(0, len(run), 4096):
                part = run[at : at + 4096]
                lo, hi = int(part[0]), int(part[-1]) + per
                sums = np.concatenate([np.zeros((1, 64), np.int64), np.cumsum(bit_signs(shingles[lo:hi]), axis=0, dtype=np.int64)])
                prints = pack_bits(sums[part - lo + per] - sums[part - lo])
                for start, fp in zip(part.tolist(), prints):
                    for i in group.within(fp).tolist():
                        item = int(group.items[i])
                        s = self.similarity(item, shingles[start : start + per])
                        if s >= LEAST - 1e-12 and (item not in best or s > best[item][0] + 1e-12):
                            best[item] = (s, start, length)


_ITEM = "item_id long, n_words long, shingles array<bigint>, fingerprint long, block int"


def _prepared(items: DataFrame) -> DataFrame:
    """Items (item_id, text, block) as their shingles and fingerprint; those without a word are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            for piece in chunks(batch):
                rows = []
                for item_id, text, block in zip(*(c.to_pylist() for c in piece.columns)):
                    if len(w := words.of(text)):
                        s = shingle_hashes(w, SIZE)
                        rows.append((item_id, len(w), s.view(np.int64), fingerprint(s).view(np.int64)[0], block))
                if rows:
                    item, n, shingles, prints, block = zip(*rows)
                    yield pa.RecordBatch.from_pydict(
                        {"item_id": pa.array(item, pa.int64()), "n_words": pa.array(n, pa.int64()), "shingles": pa.array(shingles, pa.list_(pa.int64())), "fingerprint": pa.array(prints, pa.int64()), "block": pa.array(block, pa.int32())}
                    )

    return arrow_map(items, run, _ITEM)


def _read_block(folder: str, block: int) -> Benchmark:
    """A block of the table that `_prepared` was written to; without items it has no folder of its own."""
    fs, path = filesystem(folder)
    columns = ["item_id", "n_words", "shingles", "fingerprint"]
    own = f"{path}/block={block}"
    if fs.get_file_info(own).type == pafs.FileType.NotFound and fs.get_file_info(f"{path}/_SUCCESS").type == pafs.FileType.File:
        kinds = [pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int64()]
        return Benchmark(pa.schema(list(zip(columns, kinds))).empty_table())
    return Benchmark(pq.read_table(own, filesystem=fs, partitioning=None, columns=columns))


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, start_word, n_words, similarity): an item's best window in each document that has one."""
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("bigint"), "text").where("text IS NOT NULL").distinct()
    size = items.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes")).first()
    n_blocks = max(1, -(-size["n"] // ITEMS), -(-(size["bytes"] or 0) // ITEM_BYTES))
    block = F.pmod(F.xxhash64("item_id", "text"), F.lit(n_blocks)).cast("int").alias("block")
    folder = shared_dir(spark, "benchmark")
    _prepared(items.select("item_id", "text", block)).write.partitionBy("block").parquet(folder)
    end_with_driver(spark, folder)
    docs = docs.select(F.col("doc_id").cast("bigint"), "text").where("text IS NOT NULL")
    if n_blocks == 1:
        return _scan(docs.withColumn("block", F.lit(0)), folder)
    return _scan(_by_block(docs, spark.read.schema(_ITEM).parquet(folder), n_blocks), folder)


def _by_block(docs: DataFrame, prepared: DataFrame, n_blocks: int) -> DataFrame:
    """(doc_id, text, block): each document in every block that it may share a shingle with, a block's rows
    next to each other in their tasks. A block's documents are split over tasks by their hash."""
    bit = F.expr(f"shiftleft(1L, block % {MASK_BITS})")
    masks = prepared.select(F.explode("shingles").alias("s"), bit.alias("bit")).groupBy("s").agg(F.bit_or("bit").alias("mask"))
    index = build_index(masks.select(F.col("s").alias("h1"), F.col("s").alias("h2"), F.lit(1).cast("bigint").alias("n_docs"), F.col("mask").alias("keep_id")))
    sizes = [SIZE, *(r[0] for r in prepared.where(F.col("n_words") < SIZE).select("n_words").distinct().collect())]
    bits = np.arange(n_blocks) % MASK_BITS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()
        for batch in batches:
            for piece in chunks(batch):
                mask = np.zeros(piece.num_rows, np.int64)
                for i, text in enumerate(piece.column(1).to_pylist()):
                    w = words.of(text)
                    keys = np.concatenate([shingle_hashes(w, k) for k in sizes if k <= len(w) or k == SIZE])
                    found, masks = index.probe(np.stack([keys, keys], axis=1))
                    mask[i] = np.bitwise_or.reduce(masks[found > 0])
                row, block = np.nonzero(mask[:, None] >> bits[None, :] & 1)
                for at in range(0, len(row), 256):
                    part = pa.RecordBatch.from_arrays([c.take(pa.array(row[at : at + 256])) for c in piece.columns], names=["doc_id", "text"])
                    yield part.append_column("block", pa.array(block[at : at + 256], pa.int32()))

    spread = arrow_map(docs, run, "doc_id long, text string, block int")
    return spread.repartition("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(1024))).sortWithinPartitions("block")


def _scan(docs: DataFrame, folder: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bench, opened, words = None, None, Words()
        for batch in batches:
            for piece in chunks(batch):
                rows = []
                for doc_id, text, block in zip(*(c.to_pylist() for c in piece.columns)):
                    if block != opened:
                        bench, opened = _read_block(folder, block), block
                    rows += [(doc_id, bench.ids[i], start, n, s) for i, start, n, s in bench.matches(words.of(text))]
                if rows:
                    doc, item, start, n, s = zip(*rows)
                    yield pa.RecordBatch.from_pydict(
                        {"doc_id": pa.array(doc, pa.int64()), "item_id": pa.array(item, pa.int64()), "start_word": pa.array(start, pa.int64()), "n_words": pa.array(n, pa.int64()), "similarity": pa.array(s, pa.float64())}
                    )

    return arrow_map(docs, run, "doc_id long, item_id long, start_word long, n_words long, similarity double")


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents that hold a benchmark item, with the item and the place."""
    return contaminated(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))


QUERIES = {"op10_decontaminate": op10_decontaminate}
SQL: dict[str, str] = {}
