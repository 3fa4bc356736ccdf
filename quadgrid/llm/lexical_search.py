"""Ranked lexical search: each item's best documents, by a trie of restricted term vectors.

A first pass cuts every document down to the terms that items have, and counts all its terms; the
vectors go to a table, from which Spark counts documents, lengths and document frequencies. Then
each task turns its vectors, ordered by falling frequency, into tries (at most `ENTRIES` vector
entries each), where documents that begin alike share a path. A node keeps the greatest count of
each term and the least length factor m in its subtree, and these bound the score of all documents
below it. Per item a task goes down the trie depth first, the best child first, and leaves out
subtrees whose bound lies below the item's tenth score so far; what stays is scored exactly.

One in `SLICE` vectors (by a hash) is searched first: its tenth scores are floors for the search
of all other vectors, so most tasks return few rows. Floors only prune; every vector is searched.
Items are dealt into blocks of about `PAIRS` (item, term) pairs, which bounds what is broadcast and
collected; each block reads the texts once. Nothing else passes through the driver.

Defined results: a null or termless text has no score and isn't counted; a null doc_id counts as a
document and comes last among equal scores; rows sharing a doc_id are documents of their own;
texts sharing an item_id (null included) are one item with the terms of all; items without
terms, empty tables and items that no document fits give no rows. Other columns don't matter. A
long text is split in pieces of 1 MB between terms.
"""

from __future__ import annotations

import bisect
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow_map, cut, end_with_driver, shared_dir, table

TOP = 10
PAIRS = 200_000
ENTRIES = 200_000
LEAF = 32
SLICE = 64
PIECE = 1 << 20
#: ASCII letters (in lower case) and digits stay, as do all bytes of other characters.
_SPACED = bytes(ord(chr(b).lower()) if chr(b).isascii() and chr(b).isalnum() or b > 127 else 32 for b in range(128)) + bytes(range(128, 256))


def term_counts(text: bytes) -> tuple[int, Counter]:
    """How many terms a text has, and how often each."""
    spaced, counts, n, at = text.translate(_SPACED), Counter(), 0, 0
    while at < len(spaced):
        end = spaced.find(b" ", at + PIECE)
        end = len(spaced) if end < 0 else end
        words = spaced[at:end].split()
        counts.update(words)
        n, at = n + len(words), end
    return n, counts


def _texts(column: pa.Array) -> Iterator[bytes]:
    return (x or b"" for x in column.cast(pa.binary()).to_pylist())


def item_terms(items: DataFrame) -> DataFrame:
    """(item_id, term), each once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for one, text in zip(batch.column(0).to_pylist(), _texts(batch.column(1))):
                found = list(term_counts(text)[1])
                yield pa.RecordBatch.from_pydict({"item_id": pa.array([one] * len(found), pa.int64()), "term": pa.array(found, pa.binary())})

    rows = items.select(F.col("item_id").cast("bigint").alias("item_id"), "text")
    return arrow_map(rows, run, "item_id bigint, term binary").distinct()


def restricted_vectors(docs: DataFrame, vocabulary: list[bytes]) -> DataFrame:
    """(doc_id, n, terms, tfs): a document's terms in the vocabulary by their places there, and the
    count of all its terms; documents without any term are left out."""
    held = docs.sparkSession.sparkContext.broadcast({t: i for i, t in enumerate(vocabulary)})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = held.value
        for batch in batches:
            ids, ns, terms, tfs = [], [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), _texts(batch.column(1))):
                n, counts = term_counts(text)
                if n:
                    own = [t for t in counts if t in number]
                    ids.append(doc_id)
                    ns.append(n)
                    terms.append([number[t] for t in own])
                    tfs.append([counts[t] for t in own])
            yield pa.RecordBatch.from_pydict({"doc_id": pa.array(ids, pa.int64()), "n": pa.array(ns, pa.int64()), "terms": pa.array(terms, pa.list_(pa.int32())), "tfs": pa.array(tfs, pa.list_(pa.int64()))})

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return arrow_map(rows, run, "doc_id bigint, n bigint, terms array<int>, tfs array<bigint>")


@dataclass
class Questions:
    """Items and what scores need; terms are numbered by falling document frequency."""

    ids: list  # item_id of each item
    terms: list[np.ndarray]  # its terms
    rank: np.ndarray  # vocabulary place -> number
    weight: np.ndarray  # int64 by number
    n_docs: int
    length: int


def shares(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    """A term's part of a score before its weight; it grows with tf and falls with m."""
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


class Trie:
    """Documents in the order of their frequency-ordered vectors, and the nodes above them.

    A node is a range of documents with a common path; its children part the range where the path
    branches. Neighbouring small branches make one leaf of at most LEAF documents.
    """

    def __init__(self, doc: np.ndarray, term: np.ndarray, tf: np.ndarray, m: np.ndarray, ids: list):
        n = len(m)
        by = np.lexsort((term, doc))
        doc, term, tf = doc[by], term[by], tf[by]
        start = np.searchsorted(doc, np.arange(n + 1))
        raw = term.astype(">u4").tobytes()
        paths = [raw[4 * start[i] : 4 * start[i + 1]] for i in range(n)]
        order = sorted(range(n), key=paths.__getitem__)
        common = np.zeros(n, np.int64)  # terms shared with the document before
        for i in range(1, n):
            a, b = (np.frombuffer(paths[order[j]], ">u4") for j in (i - 1, i))
            k = min(len(a), len(b))
            other = np.flatnonzero(a[:k] != b[:k])
            common[i] = other[0] if len(other) else k
        order = np.array(order, np.int64)
        size = np.diff(start)[order]
        self.start = np.concatenate([[0], np.cumsum(size)])
        take = np.repeat(start[order] - self.start[:-1], size) + np.arange(len(term))
        self.term, self.m, self.ids = term[take], m[order], [ids[i] for i in order]
        self.doc = np.repeat(np.arange(n), size)
        self.tf = tf[take]
        self.share = shares(self.tf, self.m[self.doc])
        self._grow(common, n)
        self._bound()

    def _grow(self, common: np.ndarray, n: int) -> None:
        self.lo, self.hi, self.children = [0], [n], [[]]
        open_ = [0]
        while open_:
            node = open_.pop()
            lo, hi = self.lo[node], self.hi[node]
            if hi - lo <= LEAF:
                continue
            inner = common[lo + 1 : hi]
            ends = [*(lo + 1 + np.flatnonzero(inner == inner.min())).tolist(), hi]
            at = lo
            while at < hi:
                k = bisect.bisect_right(ends, at + LEAF) - 1  # as many branches as a leaf holds, or one
                end = ends[max(k, bisect.bisect_right(ends, at))]
                self.lo.append(at)
                self.hi.append(end)
                self.children.append([])
                self.children[node].append(len(self.lo) - 1)
                if end - at > LEAF:
                    open_.append(len(self.lo) - 1)
                at = end

    def _bound(self) -> None:
        """For each node its terms' greatest counts and its least m, kept by term."""
        nodes = len(self.lo)
        tops: list = [None] * nodes
        least = np.zeros(nodes, np.int64)
        for node in range(nodes - 1, -1, -1):  # children have greater numbers
            if below := self.children[node]:
                term, tf = (np.concatenate([tops[c][i] for c in below]) for i in (0, 1))
                least[node] = least[below].min()
            else:
                a, b = self.start[self.lo[node]], self.start[self.hi[node]]
                term, tf = self.term[a:b], self.tf[a:b]
                least[node] = self.m[self.lo[node] : self.hi[node]].min()
            if len(term):
                by = np.argsort(term, kind="stable")
                term, tf = term[by], tf[by]
                first = np.flatnonzero(np.concatenate([[True], term[1:] != term[:-1]]))
                term, tf = term[first], np.maximum.reduceat(tf, first)
            tops[node] = (term, tf)
        node = np.repeat(np.arange(nodes), [len(t) for t, _ in tops])
        term, tf = (np.concatenate([x[i] for x in tops]) for i in (0, 1))
        by = np.argsort(term, kind="stable")
        self.of_term, self.node = term[by], node[by]
        self.limit = shares(tf[by], least[self.node])

    def search(self, terms: np.ndarray, weight: np.ndarray, best: Best) -> None:
        """Offer best all documents that may belong to it. weight: by term, 0 for others."""
        a, b = np.searchsorted(self.of_term, terms), np.searchsorted(self.of_term, terms, side="right")
        at = np.concatenate([np.arange(x, y) for x, y in zip(a, b)]) if len(a) else a
        bound = np.bincount(self.node[at], weight[self.of_term[at]] * self.limit[at], len(self.lo))  # integers below 2^53
        open_ = [0]
        while open_:
            node = open_.pop()
            if bound[node] < best.floor:
                continue
            if below := self.children[node]:
                open_ += sorted(below, key=bound.__getitem__)  # the best one is popped first
                continue
            lo, hi = self.lo[node], self.hi[node]
            a, b = self.start[lo], self.start[hi]
            w = weight[self.term[a:b]]
            mine = np.flatnonzero(w)
            score = np.bincount(self.doc[a:b][mine] - lo, w[mine] * self.share[a:b][mine], hi - lo)
            for i in np.flatnonzero(score >= best.floor).tolist():
                best.offer(int(score[i]), self.ids[lo + i])


class Best:
    """The TOP documents so far; floor: the least score that may still enter."""

    def __init__(self, floor: int = 1):
        self.floor, self.rows = max(1, floor), []

    def offer(self, score: int, doc_id) -> None:
        if score < self.floor:
            return
        bisect.insort(self.rows, (-score, doc_id is None, doc_id or 0))
        if len(self.rows) >= TOP:
            del self.rows[TOP:]
            self.floor = max(self.floor, -self.rows[-1][0])


def search(vectors: DataFrame, asked: Questions, floors: dict[int, int]) -> DataFrame:
    """(item, doc_id, score): from each task its best documents of each item, by the item's place."""
    held = vectors.sparkSession.sparkContext.broadcast((asked, floors))  # bounded by PAIRS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, floor = held.value
        best = [Best(floor.get(i, 1)) for i in range(len(q.ids))]
        weight = np.zeros(len(q.weight), np.int64)

        def flush(parts: list[pa.RecordBatch]) -> None:
            rows = pa.Table.from_batches(parts).combine_chunks()
            sizes = np.asarray(rows["terms"].combine_chunks().value_lengths())
            term, tf = (rows[c].combine_chunks().flatten().to_numpy() for c in ("terms", "tfs"))
            m = np.array([10 + 90 * n * q.n_docs // q.length for n in rows["n"].to_pylist()], np.int64)
            trie = Trie(np.repeat(np.arange(len(m)), sizes), q.rank[term], tf, m, rows["doc_id"].to_pylist())
            for terms, found in zip(q.terms, best):
                weight[terms] = q.weight[terms]
                trie.search(terms, weight, found)
                weight[terms] = 0

        kept, n = [], 0
        for batch in batches:
            at = 0
            while at < batch.num_rows:  # tries of about ENTRIES entries
                ends = np.cumsum(np.asarray(batch.column(2).slice(at).value_lengths()) + 1)
                k = max(1, int(np.searchsorted(ends, ENTRIES - n, side="right")))
                kept.append(batch.slice(at, k))
                n, at = n + int(ends[k - 1]), at + k
                if n >= ENTRIES or at < batch.num_rows:
                    flush(kept)
                    kept, n = [], 0
        if kept:
            flush(kept)
        rows = [(i, None if none else doc_id, -score) for i, x in enumerate(best) for score, none, doc_id in x.rows]
        item, doc_id, score = zip(*rows) if rows else ((), (), ())
        yield pa.RecordBatch.from_pydict({"item": pa.array(item, pa.int32()), "doc_id": pa.array(doc_id, pa.int64()), "score": pa.array(score, pa.int64())})

    return arrow_map(vectors.select("doc_id", "n", "terms", "tfs"), run, "item int, doc_id bigint, score bigint")


def top(found: DataFrame, key: str) -> DataFrame:
    by = Window.partitionBy(key).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= TOP)


def _block(docs: DataFrame, pairs: DataFrame) -> DataFrame | None:
    """The ranking of one block of items."""
    spark = docs.sparkSession
    mine: dict = {}
    for r in pairs.collect():  # about PAIRS rows
        mine.setdefault(r["item_id"], []).append(bytes(r["term"]))
    vocabulary = sorted({t for terms in mine.values() for t in terms})
    sliced = F.pmod(F.xxhash64("doc_id", "n"), F.lit(SLICE)) == 0
    path = shared_dir(spark, "term-vectors")
    restricted_vectors(docs, vocabulary).withColumn("first", sliced).write.partitionBy("first").parquet(path)
    end_with_driver(spark, path)
    vectors = spark.read.schema("doc_id bigint, n bigint, terms array<int>, tfs array<bigint>, first boolean").parquet(path)
    n_docs, length = vectors.agg(F.count("*"), F.sum("n")).first()
    if not n_docs:
        return None
    df = np.zeros(len(vocabulary), np.int64)
    for r in vectors.select(F.explode("terms").alias("term")).groupBy("term").count().collect():  # a row for each term of the vocabulary
        df[r["term"]] = r["count"]
    by = np.lexsort((np.arange(len(df)), -df))
    rank = np.empty(len(df), np.int64)
    rank[by] = np.arange(len(df))
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * x + 1))) for x in df[by].tolist()], np.int64)
    number = {t: i for i, t in enumerate(vocabulary)}
    ids = sorted(mine, key=lambda x: (x is None, x or 0))
    terms = [np.sort(rank[[number[t] for t in mine[i]]]) for i in ids]
    asked = Questions(ids, terms, rank, weight, n_docs, length)
    first = top(cut(search(vectors.where("first"), asked, {}), "first-hits"), "item").drop("rank")
    first = cut(first, "first-top")
    floors = {r["item"]: r["score"] for r in first.groupBy("item").agg(F.count("*").alias("k"), F.min("score").alias("score")).where(F.col("k") >= TOP).collect()}  # a row for each item
    rest = search(vectors.where("NOT first"), asked, floors)
    names = spark.createDataFrame(list(enumerate(ids)), "item int, item_id bigint")
    ranked = top(first.unionByName(rest), "item").join(F.broadcast(names), "item")
    return ranked.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def ranked_search(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(item_id, rank, doc_id, score): each item's TOP best documents."""
    pairs = cut(item_terms(items), "item-terms")
    blocks = max(1, -(-pairs.count() // PAIRS))
    out = None
    for b in range(blocks):
        mine = pairs.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == b) if blocks > 1 else pairs
        one = _block(docs, mine)
        if one is not None:
            out = one if out is None else out.unionByName(one)
    return docs.sparkSession.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint") if out is None else out


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "benchmark", "item_id", "text"))


_SQL_TERMS = r"""unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'))"""
SQL = {
    "op12_ranked_search": f"""WITH d AS (SELECT doc_id, {_SQL_TERMS} AS term FROM documents),
    tf AS (SELECT doc_id, term, count(*) AS tf FROM d GROUP BY 1, 2),
    n AS (SELECT doc_id, cast(sum(tf) AS BIGINT) AS n FROM tf GROUP BY 1),
    s AS (SELECT count(*) AS n_docs, cast(sum(n) AS BIGINT) AS length FROM n),
    w AS (SELECT term, cast(floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM tf, s GROUP BY term, n_docs),
    q AS (SELECT DISTINCT item_id, {_SQL_TERMS} AS term FROM benchmark),
    scored AS (SELECT item_id, doc_id, cast(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * n_docs) // length)))) AS BIGINT) AS score
        FROM q JOIN tf USING (term) JOIN w USING (term) JOIN n USING (doc_id), s GROUP BY 1, 2)
    SELECT item_id, cast(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
    FROM scored WHERE score > 0 QUALIFY rank <= {TOP}"""
}
QUERIES = {"op12_ranked_search": op12_ranked_search}
