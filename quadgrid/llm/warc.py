"""WARC archives with payload deduplication, and one global index of their captures.

Each task writes one archive (a gzip member for each record) and runs: files of up to
`run_entries` index entries, sorted by URL key and timestamp. Merging is external: while there
are more than FAN_IN runs, groups of them are merged to longer runs; the last ones are merged
in ranges of the key, each by a task that streams every run's entries from the range's start
on. A tree of losers picks the next entry; of each run one batch of BATCH entries is in memory.
The ranges one after another are the capture history in global order.

Of records with equal payloads of at least `min_bytes` the one with the largest page_id is
the response, the others are revisits of it. Payloads stay where they lie: the digests that
occur twice go into an index that the writing tasks probe. A revisit has the HTTP header of
the whole payload (its Content-Length) but no payload.

Defined results: null html is an empty payload; a null URL has an empty key and target; of
rows with equal payload and page_id each is a response if the id is the largest; rows
without page_id are revisits where any row with the same payload has one, else responses;
captures that tie in key, time and id come in the order of their archives' names and places;
other columns are left out.
"""

from __future__ import annotations

import base64
import datetime
import hashlib
import uuid
import zlib
from collections.abc import Iterable, Iterator
from itertools import islice, takewhile

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import AtomicWriter, arrow_map, chunks, cut, encode, filesystem, make_dir, shared_dir, table
from .line_dedup import LineIndex, build_index

EPOCH = datetime.datetime(2024, 1, 1)
NO_ID = -(1 << 63)
RUN_ENTRIES, BATCH, FAN_IN, SAMPLES = 50_000, 512, 256, 256
RANGE_ENTRIES, MAX_RANGES = 100_000, 4096
_ENTRY = "urlkey string, ts long, page_id long, file string, at long, length long"
_ENTRY_TYPES = pa.schema([("urlkey", pa.string()), ("ts", pa.int64()), ("page_id", pa.int64()), ("file", pa.string()), ("at", pa.int64()), ("length", pa.int64())])
_RUN = "run string, n long, keys array<struct<urlkey: string, ts: bigint, page_id: bigint>>, file string, folder string"
_RUN_TYPES = pa.schema([("run", pa.string()), ("n", pa.int64()), ("keys", pa.list_(pa.struct(list(_ENTRY_TYPES)[:3]))), ("file", pa.string()), ("folder", pa.string())])


def url_key(url: str | None) -> str:
    """Host labels in reverse order, then path and query; without scheme and fragment."""
    if not url:
        return ""
    rest = url.partition("://")[2] or url
    rest = rest.partition("#")[0]
    cut_at = min([i for c in "/?" if (i := rest.find(c)) >= 0], default=len(rest))
    host = rest[:cut_at].lower()
    return ",".join(reversed(host.split("."))) + ")" + (rest[cut_at:] or "/")


def record(page_id: int | None, url: str | None, payload: bytes, digest: bytes, refers_to: int | None, ts: int) -> bytes:
    """One WARC/1.1 record, not yet compressed."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    kind, block = (b"response", http + payload) if refers_to is None else (b"revisit", http)
    target = encode(url).replace(b"\r", b"%0D").replace(b"\n", b"%0A")
    head = [
        b"WARC/1.1",
        b"WARC-Type: " + kind,
        b"WARC-Record-ID: <urn:page:%s>" % (b"" if page_id is None else b"%d" % page_id),
        b"WARC-Date: " + (EPOCH + datetime.timedelta(seconds=ts)).strftime("%Y-%m-%dT%H:%M:%SZ").encode(),
        b"WARC-Target-URI: " + target,
        b"WARC-Payload-Digest: sha1:" + base64.b32encode(digest),
        b"Content-Type: application/http; msgtype=response",
    ]
    if refers_to is not None:
        head += [b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", b"WARC-Refers-To: <urn:page:%d>" % refers_to]
    return b"\r\n".join([*head, b"Content-Length: %d" % len(block), b"", block, b"", b""])


def parse_record(raw: bytes) -> dict:
    """The fields of a record; the payload's length and digest are recomputed for responses."""
    head, _, block = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(b": ", 1) for line in head.split(b"\r\n")[1:])
    block = block[: int(fields[b"Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(dict(line.split(b": ", 1) for line in http.split(b"\r\n")[1:])[b"Content-Length"])
    digest = fields[b"WARC-Payload-Digest"].removeprefix(b"sha1:").decode()
    kind = fields[b"WARC-Type"].decode()
    if kind == "response" and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
        raise ValueError(f"payload of {fields[b'WARC-Record-ID']!r} doesn't match its header")
    number = lambda key: int(x) if (x := fields.get(key, b"").strip(b"<>").removeprefix(b"urn:page:")) else None
    return {
        "page_id": number(b"WARC-Record-ID"),
        "url": fields[b"WARC-Target-URI"].decode("utf-8", "surrogatepass"),
        "payload_bytes": size,
        "payload_digest": digest,
        "record_type": kind,
        "refers_to": number(b"WARC-Refers-To"),
        "payload": payload if kind == "response" else None,
    }


def repeated_payloads(pages: DataFrame, min_bytes: int = 0) -> LineIndex:
    """The index of digests that several pages have, by 128 of their bits, with the largest page_id of each."""
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    digests = pages.where(F.octet_length(payload) >= min_bytes).select("page_id", F.unhex(F.sha1(payload)).alias("digest"))
    groups = digests.groupBy("digest").agg(F.max("page_id").alias("keep_id"), F.count("*").alias("n_docs")).where("n_docs > 1 AND keep_id IS NOT NULL")

    def halves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            h = _halves(batch.column(0).to_pylist()).view("<i8")
            yield pa.RecordBatch.from_arrays([pa.array(h[:, 0]), pa.array(h[:, 1]), batch.column(2), batch.column(1)], names=["h1", "h2", "n_docs", "keep_id"])

    return build_index(arrow_map(groups, halves, "h1 long, h2 long, n_docs long, keep_id long"))


def _halves(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(d[:16] for d in digests), "<u8").reshape(-1, 2)


def write_run(folder: str, entries: Iterator[tuple], n: int) -> tuple[str, int, list[dict]]:
    """Write n sorted entries as a run; returns its name, n and evenly spaced keys."""
    name, keys, step = f"run-{uuid.uuid4().hex}", [], max(1, n // SAMPLES)
    out = AtomicWriter(f"{folder}/{name}")
    with pa.ipc.new_file(out.out, _ENTRY_TYPES) as writer:
        for at in range(0, n, BATCH):
            part = list(islice(entries, BATCH))
            writer.write_batch(pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*part), _ENTRY_TYPES)], schema=_ENTRY_TYPES))
            keys += [dict(zip(("urlkey", "ts", "page_id"), e)) for i, e in enumerate(part, at) if i % step == 0]
    out.commit()
    return name, n, keys


def read_run(uri: str, low: tuple | None = None) -> Iterator[tuple]:
    """The entries of a run in order, from the first that isn't below `low` on, a batch at a time."""
    fs, path = filesystem(uri)
    with fs.open_input_file(path) as f:
        reader = pa.ipc.open_file(f)
        batch = lambda i: list(zip(*(c.to_pylist() for c in reader.get_batch(i).columns)))
        first = 0
        if low is not None:  # the last batch that begins below low
            lo, hi = 0, reader.num_record_batches
            while lo < hi:
                mid = (lo + hi) // 2
                lo, hi = (mid + 1, hi) if batch(mid)[0][:3] < low else (lo, mid)
            first = max(0, lo - 1)
        for i in range(first, reader.num_record_batches):
            for entry in batch(i):
                if low is None or entry[:3] >= low:
                    yield entry


def write_archives(pages: DataFrame, folder: str | None = None, min_bytes: int = 0, run_entries: int = RUN_ENTRIES) -> DataFrame:
    """Write pages (page_id, url, html) where they lie and return the runs (run, n, keys, file, folder), as a table."""
    spark = pages.sparkSession
    folder = folder or shared_dir(spark, "warc")
    make_dir(folder)
    pages = pages.select(F.col("page_id").cast("bigint"), "url", "html")
    repeated = repeated_payloads(pages, min_bytes)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = f"captures-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex[:8]}.warc.gz"
        out, entries, runs = None, [], []

        def flush() -> None:
            entries.sort()
            runs.append((*write_run(folder, iter(entries), len(entries)), name, folder))
            entries.clear()

        for batch in batches:
            for piece in chunks(batch, "html"):
                ids, urls = (piece.column(i).to_pylist() for i in (0, 1))
                payloads = [encode(x) for x in piece.column(2).to_pylist()]
                digests = [hashlib.sha1(x).digest() for x in payloads]
                copies, keep = repeated.probe(_halves(digests))
                for page_id, url, payload, digest, n, last in zip(ids, urls, payloads, digests, copies.tolist(), keep.tolist()):
                    out = out or AtomicWriter(f"{folder}/{name}")
                    refers_to = last if n and len(payload) >= min_bytes and page_id != last else None
                    ts = (page_id or 0) % (1 << 31)  # the pages have no capture time of their own
                    packer = zlib.compressobj(1, wbits=31)
                    data = packer.compress(record(page_id, url, payload, digest, refers_to, ts)) + packer.flush()
                    entries.append((url_key(url), ts, NO_ID if page_id is None else page_id, name, out.size, len(data)))
                    out.write(data)
                    if len(entries) == run_entries:
                        flush()
        if out is None:
            return
        if entries:
            flush()
        out.commit()
        yield pa.RecordBatch.from_pylist([dict(zip(("run", "n", "keys", "file", "folder"), r)) for r in runs], _RUN_TYPES)

    return cut(arrow_map(pages, write, _RUN), "capture-runs")


class LoserTree:
    """Merges sorted iterables: an inner node keeps the loser of its match, the winner is on top."""

    def __init__(self, runs: Iterable[Iterable]):
        self.runs = [iter(r) for r in runs]
        self.heads = [next(r, None) for r in self.runs]
        self.k = max(1, len(self.runs))
        self.tree = [-1] * self.k
        for i in range(len(self.runs)):
            self._play(i)

    def _beats(self, i: int, j: int) -> bool:
        a, b = self.heads[i], self.heads[j]
        return b is None and (a is not None or i < j) or a is not None and b is not None and (a, i) < (b, j)

    def _play(self, i: int) -> None:
        node = (i + self.k) // 2
        while node > 0:
            if self.tree[node] == -1:
                self.tree[node] = i
                return
            if self._beats(self.tree[node], i):
                self.tree[node], i = i, self.tree[node]
            node //= 2
        self.tree[0] = i

    def __iter__(self):
        while self.runs:
            i = self.tree[0]
            if (head := self.heads[i]) is None:
                return
            yield i, head
            self.heads[i] = next(self.runs[i], None)
            node = (i + self.k) // 2
            while node > 0:
                if self._beats(self.tree[node], i):
                    self.tree[node], i = i, self.tree[node]
                node //= 2
            self.tree[0] = i


def fewer_runs(runs: DataFrame, fan_in: int) -> DataFrame:
    """Runs merged in groups of about fan_in until there are no more than that."""
    while (n := runs.count()) > fan_in:
        group = F.pmod(F.xxhash64("run"), F.lit(-(-n // fan_in)))
        grouped = runs.groupBy(group.alias("g")).agg(F.collect_list(F.struct("run", "n")).alias("runs"), F.first("folder").alias("folder"))

        def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in batch.to_pylist():
                    folder = row["folder"]
                    merged = (e for _, e in LoserTree(read_run(f"{folder}/{r['run']}") for r in row["runs"]))
                    made = (*write_run(folder, merged, sum(r["n"] for r in row["runs"])), "", folder)
                    yield pa.RecordBatch.from_pylist([dict(zip(("run", "n", "keys", "file", "folder"), made))], _RUN_TYPES)

        runs = cut(arrow_map(grouped, merge, _RUN), "merged-runs")
    return runs


def merge_runs(runs: DataFrame, fan_in: int = FAN_IN, range_entries: int = RANGE_ENTRIES) -> DataFrame:
    """The runs' entries in one global order of (urlkey, ts, page_id), as a table with index_pos."""
    spark = runs.sparkSession
    last = fewer_runs(runs, fan_in).collect()  # at most fan_in runs with SAMPLES keys or so each
    places = [f"{r['folder']}/{r['run']}" for r in sorted(last, key=lambda r: r["run"])]
    weighed = sorted((tuple(k), r["n"] / len(r["keys"])) for r in last for k in r["keys"])
    total = sum(r["n"] for r in last)
    n_ranges = min(MAX_RANGES, max(1, -(-total // range_entries)))
    bounds, at = [], 0.0
    for key, weight in weighed:
        if at >= (len(bounds) + 1) * total / n_ranges and (not bounds or key > bounds[-1]):
            bounds.append(key)
        at += weight
    ranges = [(i, *(lo or (None,) * 3), *(hi or (None,) * 3)) for i, (lo, hi) in enumerate(zip([None, *bounds], [*bounds, None]))]
    schema = "range long, k1 string, k2 long, k3 long, e1 string, e2 long, e3 long"
    dealt = spark.createDataFrame(ranges, schema).repartition(len(ranges), "range")

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, *ends in zip(*(c.to_pylist() for c in batch.columns)):
                low, high = (None if e[0] is None else tuple(e) for e in (ends[:3], ends[3:]))
                tree = (e for _, e in LoserTree(read_run(p, low) for p in places))
                wanted = takewhile(lambda e: high is None or e[:3] < high, tree)  # noqa: B023
                at = 0
                while part := list(islice(wanted, 4096)):
                    columns = [pa.array(c, t.type) for c, t in zip(zip(*part), _ENTRY_TYPES)]
                    ids = np.array([e[2] for e in part], np.int64)
                    columns[2] = pa.array(ids, mask=ids == NO_ID)
                    yield pa.RecordBatch.from_arrays([*columns, pa.array([i] * len(part), pa.int64()), pa.array(range(at, at + len(part)), pa.int64())], names=[*_ENTRY_TYPES.names, "range", "range_pos"])
                    at += len(part)

    merged = cut(arrow_map(dealt, merge, _ENTRY + ", range long, range_pos long"), "capture-index")
    # One count for each range; their prefix sums give the ranges' places.
    bases, at = [], 0
    for row in sorted(merged.groupBy("range").count().collect(), key=lambda r: r["range"]):
        bases.append((row["range"], at))
        at += row["count"]
    base = spark.createDataFrame(bases or [(-1, 0)], "range long, base long")
    return merged.join(F.broadcast(base), "range").withColumn("index_pos", F.col("base") + F.col("range_pos")).select(*_ENTRY_TYPES.names, "index_pos")


def read_archives(runs: DataFrame, with_payload: bool = False) -> DataFrame:
    """A row for each record of the archives that the runs name, read from end to end."""
    files = runs.select("folder", "file").distinct()
    kinds = {"page_id": "long", "url": "string", "payload_bytes": "long", "payload_digest": "string", "record_type": "string", "refers_to": "long"}
    kinds |= {"payload": "binary"} if with_payload else {}
    kinds |= {"file": "string", "at": "long"}
    types = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for folder, file in zip(*(c.to_pylist() for c in batch.columns)):
                fs, path = filesystem(f"{folder}/{file}")
                with fs.open_input_stream(path, compression=None) as f:
                    rows, size = [], 0
                    for at, raw in members(f):
                        rows.append(parse_record(raw) | {"file": file, "at": at})
                        size += len(raw)
                        if size > 4 << 20:
                            yield pa.RecordBatch.from_pydict({k: pa.array([r[k] for r in rows], types[t]) for k, t in kinds.items()})
                            rows, size = [], 0
                    if rows:
                        yield pa.RecordBatch.from_pydict({k: pa.array([r[k] for r in rows], types[t]) for k, t in kinds.items()})

    dealt = files.repartition(max(8, int(runs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    return arrow_map(dealt, read, ", ".join(f"{k} {t}" for k, t in kinds.items()))


def members(stream, read: int = 4 << 20, step: int = 1 << 15) -> Iterator[tuple[int, bytes]]:
    """Where each gzip member of a stream starts, and what it holds; every byte is inflated once."""
    at, start, member, parts = 0, 0, None, []
    while data := stream.read(read):
        for i in range(0, len(data), step):
            piece = data[i : i + step]
            while piece:
                if member is None:
                    member, start, parts = zlib.decompressobj(31), at, []
                parts.append(member.decompress(piece))
                rest = member.unused_data
                at += len(piece) - len(rest)
                if member.eof:
                    yield start, b"".join(parts)
                    member = None
                piece = rest
    if member is not None:
        raise ValueError("an archive ends within a record")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page is written and read back; index_pos is its place in the merged index."""
    runs = write_archives(table(spark, sf_dir, "pages", "page_id", "url", "html"))
    index = merge_runs(runs).select("file", "at", "urlkey", "index_pos")
    back = read_archives(runs).drop("url")
    return back.join(index, ["file", "at"], "left").drop("file", "at")


QUERIES = {"op8_warc": op8_warc}
SQL: dict[str, str] = {}
