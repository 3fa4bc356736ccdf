"""Exact substring dedup: bytes covered by a string of WIDTH bytes that starts elsewhere too.

1. Of a text that several rows have, one row goes on; all of them are covered if they are
   WIDTH bytes or longer.
2. Every window of WIDTH bytes has an anchor, its leftmost k-mer of least hash. Equal windows
   have equal anchors at equal places, so only anchors that occur twice in the corpus matter.
   They are counted by Spark, and an index of them in the shared folder is probed in place.
3. The windows of one anchor are next to each other: they are one segment of less than twice
   WIDTH bytes. Spark counts equal segments by name (a 128-bit hash); the texts are read once
   more, and of each name whose anchor has another one, found once, its bytes go out from one
   place. A segment stands for all its copies with their number as its weight.
4. The segments of an anchor go, a bounded number of bytes at a time, into a collection
   transform built column by column; runs of common prefixes of WIDTH or more with a weight
   of two or more are the windows that repeat.
   Segments found twice repeat as wholes and need no ranges of the transform, only others learn
   from them. Ranges that touch are merged at each step: a segment has one row with all of its
   ranges, however many groups found them, so joins to segments and their parts give no more
   rows than there are segments.
5. An anchor with more than GROUP distinct segments would be too much for one task. Its
   segments are parted by more context: half of what the windows hold besides the anchor lies
   before it or after it, and windows that are equal have that half in common. So each part has
   a longer anchor and fewer windows; anchors found once drop out, and the others go on with
   step 3. After ten rounds an anchor is the whole window, and its group one string.

Defined results: a null text is empty; texts shorter than WIDTH lose nothing; each row counts
as a document, so a repeated row is covered by its copy; rows without doc_id are as others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .collection_bwt import repeated_windows
from .common import arrow_map, chunks, cut, encode, mix, table
from .id_filter import key_index, rows_by_id
from .line_dedup import LineIndex, build_index, index_keys
from .near_dedup import groups

WIDTH, K, GROUP, COLLECTION = 400, 32, 96, 56_000
_NAMES = "h long, s1 long, s2 long"
_KEY = ["h", "s1", "s2"]
_PIECE = _NAMES + ", copies long, n long, at int, size int, segment binary"
NO_ID = -(1 << 63)
_BYTES = np.random.default_rng(20240301).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def kmer_hashes(buf: np.ndarray, k: int = K) -> np.ndarray:
    """The hash of the k bytes (a power of two) from each place on."""
    h, p, step = _BYTES[buf], 0x9E3779B97F4A7C15, 1
    while step < k:
        h = h[:-step] * np.uint64(p) + h[step:]
        p, step = p * p & 0xFFFFFFFFFFFFFFFF, 2 * step
    return mix(h)


def sliding_min(h: np.ndarray, w: int) -> np.ndarray:
    """min(h[i : i + w]) for each i: from running minima within blocks of w."""
    n = len(h)
    padded = np.full(-(-n // w) * w, np.iinfo(h.dtype).max, h.dtype)
    padded[:n] = h
    blocks = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - w + 1], ahead[w - 1 : n])


def segments(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, ...]:
    """(anchor hash, anchor, first window, last window) of each run of windows that have one anchor;
    the documents are buf[starts:ends], each of `width` bytes or more."""
    h = kmer_hashes(buf)
    w = width - K + 1
    least = sliding_min(h, w)
    valid, new = np.zeros(len(least) + 1, np.int8), np.ones(len(least), bool)
    np.add.at(valid, starts, 1)
    np.add.at(valid, ends - width + 1, -1)
    inside = np.cumsum(valid[:-1]) > 0
    new[1:] = least[1:] != least[:-1]
    new[starts] = True
    first = np.flatnonzero(new & inside)
    doc = np.searchsorted(starts, first, side="right") - 1
    last = np.minimum(np.append(first[1:], len(least)) - 1, ends[doc] - width)
    anchor = np.concatenate([np.empty(0, np.int64), *(f + h[f[:, None] + np.arange(w)].argmin(axis=1) for f in np.array_split(first, max(1, len(first) // 4096)))])
    plain = last <= anchor
    out = [(least[first[plain]], anchor[plain], first[plain], last[plain])]
    for f, z in zip(first[~plain].tolist(), last[~plain].tolist()):
        # The least k-mer occurs again before the run ends: each occurrence is an anchor of its own.
        at = f + np.flatnonzero(h[f : z + w] == least[f])
        at = at[: np.searchsorted(at, z) + 1]
        out.append((np.full(len(at), least[f]), at, np.concatenate([[f], at[:-1] + 1]), np.minimum(at, z)))
    return tuple(np.concatenate(x) for x in zip(*out))


def _rows(docs: DataFrame) -> DataFrame:
    """doc_id, text and a key of the row."""
    return docs.select(F.coalesce(F.col("doc_id").cast("bigint"), F.lit(NO_ID)).alias("doc_id"), "text").withColumn("rk", F.xxhash64("doc_id", "text"))


def _documents(batches: Iterator[pa.RecordBatch], skip: LineIndex, width: int):
    """Joined long documents of (doc_id, text, rk) rows that aren't to be skipped, about 256 KB at a time."""
    for batch in batches:
        for piece in chunks(batch, max_bytes=256 << 10):
            rk = piece.column(2).to_numpy()
            skipped = skip.contains(rk)
            texts = [encode(t) for t in piece.column(1).to_pylist()]
            at = [i for i, t in enumerate(texts) if len(t) >= width and not skipped[i]]
            if at:
                ends = np.cumsum([len(texts[i]) for i in at])
                buf = np.frombuffer(b"".join(texts[i] for i in at), np.uint8)
                yield buf, np.concatenate([[0], ends[:-1]]), ends, piece.column(0).to_numpy(zero_copy_only=False)[at], rk[at]


def _named(strings: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, strings)), "<i8").reshape(-1, 2)


def _twice(h: DataFrame) -> LineIndex:
    """The index of the anchors (h, weight) that occur at least twice."""
    return index_keys(h.groupBy("h").agg(F.sum("weight").alias("n")).where("n > 1").select("h"))


def anchor_index(rows: DataFrame, skip: LineIndex, width: int) -> LineIndex:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for buf, starts, ends, _, _ in _documents(batches, skip, width):
            h = segments(buf, starts, ends, width)[0].view(np.int64)
            yield pa.RecordBatch.from_pydict({"h": pa.array(h), "weight": pa.array(np.ones(len(h), np.int64))})

    return _twice(arrow_map(rows, run, "h long, weight long"))


def named_segments(rows: DataFrame, skip: LineIndex, anchors: LineIndex, width: int) -> DataFrame:
    """(h, s1, s2, doc_id, rk, at, n): s1 and s2 name the segment, which has n windows and starts at `at`; as a table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for buf, starts, ends, ids, rk in _documents(batches, skip, width):
            h, _, first, last = segments(buf, starts, ends, width)
            hit = anchors.contains(h)
            h, first, last = h[hit], first[hit], last[hit]
            data = buf.tobytes()
            name = _named([data[f : z + width] for f, z in zip(first.tolist(), last.tolist())])
            doc = np.searchsorted(starts, first, side="right") - 1
            yield pa.RecordBatch.from_pydict(
                {"h": pa.array(h.view(np.int64)), "s1": pa.array(name[:, 0]), "s2": pa.array(name[:, 1]), "doc_id": pa.array(ids[doc]), "rk": pa.array(rk[doc]),
                 "at": pa.array(first - starts[doc]), "n": pa.array(last - first + 1)}
            )

    return cut(arrow_map(rows, run, _NAMES + ", doc_id long, rk long, at long, n long"), "segments")


def contested(distinct: DataFrame, group: int) -> DataFrame:
    """Those of distinct segments (h, s1, s2, copies, ...) whose anchor has others, one of them found once,
    and whether they are `crowded`. A segment found twice repeats as a whole; others need the transform."""
    per_anchor = distinct.groupBy("h").agg(F.count("*").alias("kinds"), F.min("copies").alias("least")).where("kinds > 1 AND least = 1")
    per_anchor = cut(per_anchor.select("h", (F.col("kinds") > group).alias("crowded")), "anchors")
    return cut(distinct.join(per_anchor.hint("merge"), "h"), "contested")


def contested_pieces(rows: DataFrame, skip: LineIndex, names: DataFrame, width: int) -> DataFrame:
    """The pieces of contested segments (h, s1, s2, copies, rk, crowded), cut from the row that each names, as a table."""
    index = build_index(names.select(F.col("s1").alias("h1"), F.col("s2").alias("h2"), F.col("copies").alias("n_docs"), F.col("rk").alias("keep_id")))
    crowds = index_keys(names.where("crowded").select("h").distinct())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for buf, starts, ends, _, rk in _documents(batches, skip, width):
            h, anchor, first, last = segments(buf, starts, ends, width)
            data = buf.tobytes()
            found = [data[f : z + width] for f, z in zip(first.tolist(), last.tolist())]
            name = _named(found)
            doc = np.searchsorted(starts, first, side="right") - 1
            copies, where = index.probe(name.view(np.uint64))
            out = np.flatnonzero((copies > 0) & (where == rk[doc]))
            # A row may hold a segment several times.
            out = out[np.sort(np.unique(np.column_stack([doc[out], name[out]]), axis=0, return_index=True)[1])]
            yield pa.RecordBatch.from_pydict(
                {"h": pa.array(h[out].view(np.int64)), "s1": pa.array(name[out, 0]), "s2": pa.array(name[out, 1]), "copies": pa.array(copies[out]), "n": pa.array((last - first + 1)[out]),
                 "at": pa.array((anchor - first)[out].astype(np.int32)), "size": pa.array(np.full(len(out), K, np.int32)), "segment": pa.array([found[i] for i in out.tolist()], pa.binary()),
                 "crowded": pa.array(crowds.contains(h[out]))}
            )

    return cut(arrow_map(rows, run, _PIECE + ", crowded boolean"), "pieces")


def _ranges(starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.diff(starts) != 1)
    return starts[np.concatenate([[0], edge + 1])], starts[np.concatenate([edge, [len(starts) - 1]])]


def repeats_in_groups(pieces: DataFrame, width: int) -> DataFrame:
    """(h, s1, s2, lo, hi): ranges of repeated windows of pieces found once, by collection transforms over whole groups of equal h."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for whole in groups(batches, 1):
            h = whole.column(0).to_numpy()
            edges = np.concatenate([[0], np.flatnonzero(np.diff(h)) + 1, [len(h)]])
            for lo, hi in zip(edges[:-1], edges[1:]):
                held.append(whole.slice(int(lo), int(hi - lo)))
                n += int(whole.column(5).slice(int(lo), int(hi - lo)).to_numpy().sum())
                if n >= COLLECTION:
                    yield from found(held)
                    held, n = [], 0
        if held:
            yield from found(held)

    def found(held: list[pa.Table]) -> Iterator[pa.RecordBatch]:
        t = pa.concat_tables(held)
        strings = t.column(4).to_pylist()
        copies = t.column(3).to_numpy()
        keys, rows = [t.column(i).to_numpy() for i in range(3)], []
        for i, starts in enumerate(repeated_windows(strings, copies, width)):
            if len(starts) and copies[i] == 1:
                rows += [(i, int(a), int(b)) for a, b in zip(*_ranges(starts))]
        if rows:
            at, lo, hi = map(np.array, zip(*rows))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (*(k[at] for k in keys), lo, hi)], names=["h", "s1", "s2", "lo", "hi"])

    dealt = pieces.select("h", "s1", "s2", "copies", "segment", F.octet_length("segment").cast("bigint").alias("size")).repartition("h").sortWithinPartitions("h")
    return arrow_map(dealt, run, _NAMES + ", lo long, hi long")


def parts(segment: bytes, n: int, at: int, size: int, width: int) -> Iterator[tuple[int, int, int, int, int]]:
    """(side, first window, windows, place of the longer anchor, its size) of a piece's parts; the anchor
    is segment[at : at + size], and every window holds it."""
    half = -(-(width - size) // 2)
    split = min(n, max(0, at - half + 1))  # windows with `half` bytes before the anchor come first
    if split:
        yield 0, 0, split, at - half, size + half
    if split < n:
        yield 1, split, n - split, at - split, width - half + 1


def split_pieces(pieces: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
    """The pieces with longer anchors of crowded ones, and (h, s1, s2, up_h, up_s1, up_s2, shift): whose
    parts they are, of pieces found once. A longer anchor that is found once has no repeated window and drops out."""

    def cut_up(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                rows, out = batch.slice(i, 512).to_pylist(), []
                for r in rows:
                    s = r["segment"]
                    for side, first, n, at, size in parts(s, r["n"], r["at"], r["size"], width):
                        h = xxhash.xxh3_64_intdigest(s[first + at : first + at + size], seed=1 + side)
                        out.append((h - (1 << 64) if h >> 63 else h, r, first, n, at, size, s[first : first + n - 1 + width]))
                yield out

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in cut_up(batches):
            yield pa.RecordBatch.from_pydict({"h": pa.array([x[0] for x in out], pa.int64()), "weight": pa.array([x[1]["copies"] for x in out], pa.int64())})

    index = _twice(arrow_map(pieces, anchors, "h long, weight long"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in cut_up(batches):
            if out and (hit := index.contains(np.array([x[0] for x in out], np.int64))).any():
                h, up, first, n, at, size, segment = zip(*(x for x, ok in zip(out, hit) if ok))
                name = _named(segment)
                yield pa.RecordBatch.from_pydict(
                    {"h": pa.array(h, pa.int64()), "s1": pa.array(name[:, 0]), "s2": pa.array(name[:, 1]), "copies": pa.array([u["copies"] for u in up], pa.int64()), "n": pa.array(n, pa.int64()),
                     "at": pa.array(at, pa.int32()), "size": pa.array(size, pa.int32()), "segment": pa.array(segment, pa.binary()),
                     **{f"up_{k}": pa.array([u[k] for u in up], pa.int64()) for k in ("h", "s1", "s2")}, "shift": pa.array(first, pa.int64())}
                )

    made = cut(arrow_map(pieces, run, _PIECE + ", up_h long, up_s1 long, up_s2 long, shift long"), "parts")
    whose = made.where("copies = 1").select("h", "s1", "s2", "up_h", "up_s1", "up_s2", "shift")
    same = made.groupBy("h", "s1", "s2").agg(F.sum("copies").alias("copies"), *[F.first(c).alias(c) for c in ("n", "at", "size", "segment")])
    return cut(same, "distinct-parts"), whose


def _whole(distinct: DataFrame) -> DataFrame:
    """The ranges of segments that are found twice: all their windows."""
    return distinct.where("copies > 1").select(*_KEY, F.array(F.struct(F.lit(0).cast("bigint").alias("lo"), (F.col("n") - 1).alias("hi"))).alias("ranges"))


def _merged(ranges: DataFrame) -> DataFrame:
    """(h, s1, s2, ranges), a row for each segment, of rows (h, s1, s2, lo, hi): ranges that touch are one."""
    last = lambda done: F.element_at(done, -1)

    def add(done, r):
        longer = F.struct(last(done)["lo"].alias("lo"), F.greatest(last(done)["hi"], r["hi"]).alias("hi"))
        touch = F.coalesce(F.try_element_at(done, F.lit(-1))["hi"] + 1 >= r["lo"], F.lit(False))
        return F.when(touch, F.concat(F.slice(done, 1, F.size(done) - 1), F.array(longer))).otherwise(F.concat(done, F.array(r)))

    found = ranges.groupBy(*_KEY).agg(F.array_sort(F.collect_set(F.struct("lo", "hi"))).alias("found"))
    return found.select(*_KEY, F.aggregate("found", F.slice("found", 1, 0), add).alias("ranges"))


def repeated_ranges(pieces: DataFrame, width: int, group: int) -> DataFrame:
    """(h, s1, s2, ranges): the ranges of repeated windows of contested pieces found once, a row for each that has any."""
    found = repeats_in_groups(pieces.where("NOT crowded"), width)
    crowded = pieces.where("crowded").drop("crowded")
    if not crowded.limit(1).count():
        return _merged(found)
    distinct, whose = split_pieces(crowded, width)
    below = _whole(distinct).unionByName(repeated_ranges(contested(distinct, group), width, group))
    up = whose.join(cut(below, "part-ranges").hint("merge"), _KEY)
    up = up.select(*[F.col(f"up_{c}").alias(c) for c in _KEY], "shift", F.explode("ranges").alias("r"))
    shifted = [(F.col(f"r.{c}") + F.col("shift")).alias(c) for c in ("lo", "hi")]
    return _merged(found.unionByName(up.select(*_KEY, *shifted)))


def repeated_spans(docs: DataFrame, width: int = WIDTH, group: int = GROUP) -> DataFrame:
    """(doc_id, rk, spans): the byte ranges [from, to) of each row that are covered; unmerged."""
    rows = _rows(docs)
    names = rows.select("doc_id", "rk", F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(7), "text").alias("t2"), F.octet_length("text").alias("size"))
    names = cut(names.where(F.col("size") >= width), "texts")
    classes = cut(names.groupBy("t1", "t2").agg(F.min("rk").alias("first"), F.count("*").alias("copies")).where("copies > 1"), "copied")
    copied = cut(names.join(classes.hint("merge"), ["t1", "t2"]), "copies")
    skip = index_keys(copied.where("rk <> first").select("rk").distinct())
    found = named_segments(rows, skip, anchor_index(rows, skip, width), width)
    distinct = cut(found.groupBy("h", "s1", "s2").agg(F.count("*").alias("copies"), F.min("n").alias("n"), F.min("rk").alias("rk")), "distinct-segments")
    pieces = contested_pieces(rows, skip, contested(distinct, group), width)
    ranges = cut(_whole(distinct).unionByName(repeated_ranges(pieces, width, group)), "ranges")
    placed = found.select(*_KEY, "doc_id", "rk", "at").join(ranges.hint("merge"), _KEY).select("doc_id", "rk", "at", F.explode("ranges").alias("r"))
    spans = placed.select("doc_id", "rk", (F.col("at") + F.col("r.lo")).alias("a"), (F.col("at") + F.col("r.hi") + width).alias("b"))
    spans = spans.unionByName(copied.select("doc_id", "rk", F.lit(0).cast("bigint").alias("a"), F.col("size").cast("bigint").alias("b")))
    return cut(spans.groupBy("doc_id", "rk").agg(F.collect_set(F.struct("a", "b")).alias("spans")), "spans")


def merge_spans(spans: list[dict], size: int) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s in sorted((s["a"], s["b"]) for s in spans):
        if out and s[0] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], s[1])
        else:
            out.append([*s])
    return [(a, min(b, size)) for a, b in out]


def dedup_substrings(docs: DataFrame, width: int = WIDTH, group: int = GROUP) -> DataFrame:
    """(doc_id, n_bytes, n_removed, spans, kept): the covered byte ranges and what remains.

    Only texts that have spans are joined to them; tasks find these, and the others, by an index
    of the rows' keys, and the others stay where they are.
    """
    spans = repeated_spans(docs, width, group)
    rows, covered = _rows(docs), key_index(spans.select("rk").distinct())

    def remains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (doc_id, text, spans), or (doc_id, text, rk) of which those with spans are passed over."""
        for batch in batches:
            whole = batch.schema.names[2] == "rk"
            if whole:
                batch = batch.filter(pc.invert(covered.holds(batch.column(2))))
            for piece in chunks(batch):
                out = []
                for doc_id, text, found in zip(*(c.to_pylist() for c in piece.columns)):
                    raw = encode(text)
                    merged = [] if whole else merge_spans(found or [], len(raw))
                    edges = [0, *(x for s in merged for x in s), len(raw)]
                    kept = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2]))
                    out.append((None if doc_id == NO_ID else doc_id, len(raw), len(raw) - len(kept), [x for s in merged for x in s], kept))
                ids, size, removed, places, kept = zip(*out)
                yield pa.RecordBatch.from_pydict(
                    {"doc_id": pa.array(ids, pa.int64()), "n_bytes": pa.array(size, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "spans": pa.array(places, pa.list_(pa.int64())), "kept": pa.array(kept, pa.binary())}
                )

    schema = "doc_id long, n_bytes long, n_removed long, spans array<bigint>, kept binary"
    joined = rows_by_id(rows, covered, inside=True, key=F.col("rk")).join(spans.hint("merge"), ["doc_id", "rk"], "left")
    return arrow_map(rows, remains, schema).unionByName(arrow_map(joined.select("doc_id", "text", "spans"), remains, schema))


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_substrings(table(spark, sf_dir, "documents", "doc_id", "text"))
    runs = (F.size("spans") / 2).cast("bigint")
    return out.select("doc_id", "n_bytes", "n_removed", runs.alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {"op1_substring_dedup": op1_substring_dedup}
SQL: dict[str, str] = {}
