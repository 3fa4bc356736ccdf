"""Near-duplicate documents by min-max hashing.

Each permutation of a document's shingle hashes gives two signature values, the minimum and
the maximum. Five permutations make a group, whose minima are one band and whose maxima are
another, so that 110 hash evaluations give 44 bands of five: two documents at a similarity of
0.75 share no band with a chance of about 7 in a million.

1. Documents with equal shingle sets are one class; its smallest doc_id stands for it.
2. In each bucket of the first bands every class is paired with the least one. Pairs whose
   sketches (a byte of each signature value) are clearly apart go; the others are compared on
   their full sets. The links' components are found.
3. In each bucket of any band that holds several components, the classes are paired with the
   least and the greatest where these are of another component (a bucket of up to three is
   then done), compared, and joined to components again.
4. Where a bucket of four or more still holds several components, the documents outside the
   largest are held against all others, in blocks of bounded size: first by sketch, to find
   the components they may link to, then on full sets with these components' documents, until
   a link is found. So no link between different components is missed, and no table of all
   pairs is made.

Defined results: a null, empty or blank text has no shingles and is linked with nothing; with
fewer than five words the whole text is the one shingle; rows that share a doc_id are one node
that has the links of all its texts; a row without doc_id has no component and is kept.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import MIX_A, WordHashes, arrow_map, chunks, cut, encode, mix, shingle_hashes, table
from .components import connected_components, join_components
from .id_filter import key_index

GROUPS, ROWS = 22, 5
PERMUTATIONS = GROUPS * ROWS
PERCENT = 75
#: Sketches further apart than this estimate can't be at 0.75 (six standard deviations below).
SKETCH_LEAST = 0.57
BLOCK = 2048
#: Bands whose buckets are paired first; most near copies share one of them.
FIRST_BANDS = 8

_RNG = np.random.default_rng(20240229)
_XOR = _RNG.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64) * np.uint64(2)
_MUL = _RNG.integers(0, 1 << 63, PERMUTATIONS, dtype=np.uint64) | np.uint64(1)


def shingle_set(text: str | None, hashes: WordHashes) -> np.ndarray:
    """The sorted distinct hashes of a text's 5-word shingles."""
    return np.unique(shingle_hashes(hashes.of(encode(text).lower().split())))


def min_max(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Minima and maxima of non-empty sets: two arrays [sets, permutations]."""
    flat = np.concatenate(sets)
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]]).astype(np.int64)
    low, high = (np.empty((len(sets), PERMUTATIONS), np.uint64) for _ in range(2))
    for p in range(PERMUTATIONS):
        x = (flat ^ _XOR[p]) * _MUL[p]
        low[:, p] = np.minimum.reduceat(x, starts)
        high[:, p] = np.maximum.reduceat(x, starts)
    return low, high


def band_keys(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """[sets, 2 * GROUPS] keys; a key holds the number of its band."""
    out = np.empty((len(low), 2 * GROUPS), np.uint64)
    for g in range(GROUPS):
        for side, values in ((0, low), (1, high)):
            h = np.full(len(low), 2 * g + side + 1, np.uint64)
            for p in range(g * ROWS, (g + 1) * ROWS):
                h = mix(h * MIX_A + values[:, p])
            out[:, 2 * g + side] = h
    return out


def sketch(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    return np.concatenate([mix(low), mix(high)], axis=1).astype(np.uint8)


def similarity_estimate(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """From sketches: the share of equal bytes, less what is equal by chance."""
    same = (x == y).mean(axis=-1)
    return (same - 1 / 256) / (1 - 1 / 256)


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, d1, d2, keys, sketch) of each row, as a table; d1, d2 name the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for piece in chunks(batch, max_bytes=2 << 20):
                sets = [shingle_set(t, hashes) for t in piece.column(1).to_pylist()]
                full = [i for i, s in enumerate(sets) if len(s)]
                d = np.zeros((len(sets), 2), "<i8")
                keys, sketches = [[]] * len(sets), [b""] * len(sets)
                if full:
                    d[full] = np.frombuffer(b"".join(xxhash.xxh3_128_digest(sets[i].tobytes()) for i in full), "<i8").reshape(-1, 2)
                    low, high = min_max([sets[i] for i in full])
                    for i, k, s in zip(full, band_keys(low, high).view(np.int64), sketch(low, high)):
                        keys[i], sketches[i] = k, s.tobytes()
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": piece.column(0),
                        "n_shingles": pa.array(list(map(len, sets)), pa.int64()),
                        "d1": pa.array(d[:, 0]),
                        "d2": pa.array(d[:, 1]),
                        "keys": pa.array(keys, pa.list_(pa.int64())),
                        "sketch": pa.array(sketches, pa.binary()),
                    }
                )

    schema = "doc_id long, n_shingles long, d1 long, d2 long, keys array<bigint>, sketch binary"
    return cut(arrow_map(docs.select(F.col("doc_id").cast("bigint"), "text"), run, schema), "signatures")


def groups(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[pa.Table]:
    """Rows sorted by their first n_keys columns (64-bit integers), as tables that hold whole groups."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        k = np.stack([batch.column(i).to_numpy() for i in range(n_keys)])
        edges = np.flatnonzero((k[:, 1:] != k[:, :-1]).any(axis=0)) + 1
        if held and [held[-1].column(i)[-1].as_py() for i in range(n_keys)] != list(k[:, 0]):
            yield pa.Table.from_batches(held)
            held = []
        if len(edges):
            yield pa.Table.from_batches([*held, batch.slice(0, int(edges[-1]))])
            held, batch = [], batch.slice(int(edges[-1]))
        held.append(batch)
    if held:
        yield pa.Table.from_batches(held)


def _sketch_rows(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)


def drop_clearly_apart(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sketches allow the threshold."""
    x = sketches.select(F.col("doc_id").alias("a"), F.col("sketch").alias("sa"))
    y = sketches.select(F.col("doc_id").alias("b"), F.col("sketch").alias("sb"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                near = similarity_estimate(_sketch_rows(batch.column(2)), _sketch_rows(batch.column(3))) >= SKETCH_LEAST
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(near))

    joined = pairs.join(y.hint("merge"), "b").join(x.hint("merge"), "a").select("a", "b", "sa", "sb")
    return cut(arrow_map(joined, run, "a long, b long").distinct(), "near-pairs")


def _in_blocks(base: DataFrame, probe: DataFrame, key: str, block: int) -> DataFrame:
    """Rows (key, p, q, probe, ...) of both tables, which have the same columns, dealt out so that
    each block p of a key's probes meets each block q of its base rows in one group."""
    count = lambda df, n: df.groupBy(key).agg(F.ceil(F.count("*") / block).cast("bigint").alias(n))
    size = count(base, "_q").join(count(probe, "_p"), key)
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))
    own = lambda n: F.pmod(F.xxhash64("doc_id"), F.col(n))
    rest = [c for c in base.columns if c != key]
    rows = base.join(size, key).select(key, every("_p").alias("p"), own("_q").alias("q"), F.lit(0).cast("bigint").alias("probe"), *rest)
    rows = rows.unionByName(probe.join(size, key).select(key, own("_p").alias("p"), every("_q").alias("q"), F.lit(1).cast("bigint").alias("probe"), *rest))
    return rows.repartition(key, "p", "q").sortWithinPartitions(key, "p", "q")


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray]]:
    """The groups of _in_blocks: the rows, and the places of probes and of base rows among them."""
    for t in groups(batches, 3):
        k = np.stack([t.column(i).to_numpy() for i in range(3)])
        starts = np.concatenate([[0], np.flatnonzero((k[:, 1:] != k[:, :-1]).any(axis=0)) + 1, [k.shape[1]]])
        is_probe = t.column(3).to_numpy() == 1
        for lo, hi in zip(starts[:-1].tolist(), starts[1:].tolist()):
            yield t.slice(lo, hi - lo), np.flatnonzero(is_probe[lo:hi]), np.flatnonzero(~is_probe[lo:hi])


def components_near(members: DataFrame, sketches: DataFrame) -> DataFrame:
    """(x, component): the documents and the other components of which a bucket holds a member
    whose sketch allows the threshold. members: (key, doc_id, component).

    The members outside a bucket's largest component probe all its members.
    """
    per = members.groupBy("key", "component").agg(F.count("*").alias("n"))
    stats = per.groupBy("key").agg(F.max_by("component", F.struct("n", "component")).alias("major"), F.count("*").alias("parts"))
    rows = members.join(cut(stats.where("parts > 1"), "bucket-parts").hint("merge"), "key")
    rows = cut(rows.join(sketches.hint("merge"), "doc_id"), "open-rows")  # counted and dealt out from one table
    columns = ("key", "doc_id", "component", "sketch")
    dealt = _in_blocks(rows.select(*columns), rows.where("component <> major").select(*columns), "key", BLOCK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, probes, rest in _blocks(batches):
            ids, comp, sk = t.column(4).to_numpy(), t.column(5).to_numpy(), _sketch_rows(t.column(6))
            found = []
            for x in probes:
                near = rest[comp[rest] != comp[x]]
                near = near[similarity_estimate(sk[near], sk[x]) >= SKETCH_LEAST]
                found += [(ids[x], c) for c in np.unique(comp[near])]
            if found:
                x, c = zip(*found)
                yield pa.RecordBatch.from_pydict({"x": pa.array(x, pa.int64()), "component": pa.array(c, pa.int64())})

    return cut(arrow_map(dealt, run, "x long, component long").distinct(), "near-components")


def links_into(near: DataFrame, label: DataFrame, sketches: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """One link (a, b) for each (x, component) of `near` in which x has a link, as a table.

    x is compared with all of the component's documents, sketches first; the pairs are never
    rows of a table, only the links are.
    """
    data = sets.join(sketches.hint("merge"), "doc_id")
    wanted = near.select("component").distinct()
    listed = label.join(wanted, "component", "left_semi").select("component", "doc_id")
    single = wanted.join(label.select(F.col("doc_id").alias("component")), "component", "left_anti").select("component", F.col("component").alias("doc_id"))
    columns = ("component", "doc_id", "sketch", "shingles")
    base = listed.unionByName(single).join(data, "doc_id").select(*columns)
    probe = near.withColumnRenamed("x", "doc_id").join(data, "doc_id").select(*columns)
    dealt = _in_blocks(cut(base, "components"), cut(probe, "probes"), "component", BLOCK // 4)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, probes, rest in _blocks(batches):
            ids, sk = t.column(4).to_numpy(), _sketch_rows(t.column(5))
            sets_ = [np.frombuffer(x.as_buffer(), np.uint64) for x in t.column(6)]
            a, b = [], []
            for x in probes:
                estimate = similarity_estimate(sk[rest], sk[x])
                by = np.argsort(-estimate, kind="stable")
                for y in rest[by[: np.count_nonzero(estimate >= SKETCH_LEAST)]]:
                    if similar(sets_[x], sets_[y], percent):
                        a.append(min(ids[x], ids[y]))
                        b.append(max(ids[x], ids[y]))
                        break
            if a:
                yield pa.RecordBatch.from_pydict({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return cut(arrow_map(dealt, run, "a long, b long").where("a < b").distinct(), "links")


def similar(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets have 100 * intersection >= percent * union."""
    small, large = (x, y) if len(x) <= len(y) else (y, x)
    if not len(small):
        return False
    at = np.minimum(np.searchsorted(large, small), len(large) - 1)
    both = int((large[at] == small).sum())
    return 100 * both >= percent * (len(x) + len(y) - both)


def shingle_sets(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """(doc_id, shingles): the full sets of the documents that some bucket pairs, as a table."""

    index = key_index(ids)

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for piece in chunks(batch.filter(index.holds(batch.column(0))), max_bytes=2 << 20):
                found = [shingle_set(t, hashes).tobytes() for t in piece.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(found, pa.binary())], names=["doc_id", "shingles"])

    return cut(arrow_map(docs.select(F.col("doc_id").cast("bigint"), "text"), sets_of, "doc_id long, shingles binary"), "shingles")


def confirm(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs whose full shingle sets have 100 * intersection >= percent * union, as a table."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # A doc_id may have several sets, so each row is read by itself.
            good = [similar(np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64), percent) for x, y in zip(batch.column(2), batch.column(3))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    x = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa"))
    y = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb"))
    joined = pairs.join(y.hint("merge"), "b").join(x.hint("merge"), "a").select("a", "b", "sa", "sb")
    return cut(arrow_map(joined, compare, "a long, b long").distinct(), "links")


def near_duplicates(docs: DataFrame, percent: int = PERCENT, tell: Callable[[str, DataFrame], None] | None = None) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of docs (doc_id, text)."""
    tell = tell or (lambda name, df: None)
    rows = signatures(docs)
    full = rows.where("n_shingles > 0 AND doc_id IS NOT NULL")
    # Classes of equal sets; only those of two or more rows take part in joins.
    classes = full.groupBy("d1", "d2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("copies")).where("copies > 1").drop("copies")
    marked = cut(full.select("doc_id", "d1", "d2").join(classes, ["d1", "d2"]).where("rep <> doc_id").select("doc_id", "d1", "d2", "rep").distinct(), "copies")
    # Only the copy's row goes; other sets of its doc_id stay, as they may stand for classes too.
    # A table of its own: its wide rows are moved once, and read for the buckets and the sketches.
    nodes = cut(full.join(marked.select("doc_id", "d1", "d2"), ["doc_id", "d1", "d2"], "left_anti").select("doc_id", "keys", "sketch"), "nodes")
    bands = nodes.select("doc_id", F.posexplode("keys").alias("band", "key"))
    buckets = bands.groupBy("key").agg(F.count("*").alias("n"), F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi")
    # A table of its own, so that a join's hot key can be split (an aggregate's partition can't be).
    members = cut(bands.join(cut(buckets, "bucket-ends").hint("merge"), "key"), "buckets")
    sketches = nodes.select("doc_id", "sketch")
    sets = shingle_sets(docs, members.select("doc_id"))
    # Copies set apart above are links too; a doc_id may have several rows and so several sets.
    copies = marked.select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    tested, label = None, None

    def join_links(found: DataFrame) -> None:
        nonlocal label
        if label is None:
            label = connected_components(copies.unionByName(found))
        elif found.limit(1).count():
            label = join_components(label.withColumnRenamed("doc_id", "node"), found)
        label = label.withColumnRenamed("node", "doc_id")

    def go_on(name: str, pairs: DataFrame) -> None:
        nonlocal tested
        pairs = pairs.distinct()
        near = drop_clearly_apart(pairs if tested is None else pairs.join(tested, ["a", "b"], "left_anti"), sketches)
        tell(name, near)
        tested = near if tested is None else tested.unionByName(near)
        join_links(confirm(near, sets, percent))

    def still_open(rows: DataFrame) -> DataFrame:
        """The rows of buckets with several components, with the components of the bucket's ends."""
        rows = rows.select("key", "doc_id", "lo", "hi").join(label, "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))
        ends = rows.groupBy("key").agg(
            F.min("component").alias("x"), F.max("component").alias("y"), F.min_by("component", "doc_id").alias("lo_component"), F.max_by("component", "doc_id").alias("hi_component")
        )
        return cut(rows.join(cut(ends.where("x < y").drop("x", "y"), "open-ends").hint("merge"), "key"), "open-buckets")

    pair = lambda a, b: (F.col(a).alias("a"), F.col(b).alias("b"))
    go_on("first", members.where(F.col("band") < FIRST_BANDS).where("doc_id <> lo").select(*pair("lo", "doc_id")))
    mixed = still_open(members)
    ends = mixed.where("component <> lo_component").select(*pair("lo", "doc_id"))
    go_on("ends", ends.unionByName(mixed.where("component <> hi_component").select(*pair("doc_id", "hi"))))
    near = components_near(still_open(members.where("n > 3")).select("key", "doc_id", "component"), sketches)
    tell("across", near)
    if near.limit(1).count():
        found = links_into(near, label, sketches, sets, percent)
        tell("across links", found)
        join_links(found)
    out = rows.select("doc_id", "n_shingles").join(label, "doc_id", "left")
    component = F.when(F.col("n_shingles") > 0, F.coalesce("component", "doc_id")).otherwise(F.col("doc_id"))
    out = out.withColumn("component_id", component)
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents", "doc_id", "text"))


QUERIES = {"op2_near_dedup": op2_near_dedup}
SQL: dict[str, str] = {}
