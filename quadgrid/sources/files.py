"""Raster, manifest and query files as DataFrames, and the window sink."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

_CELLS = "row int, col int, value int"
#: Bytes of a file that one task reads.
PIECE = 32 << 20


def _file_system(path: str) -> tuple[pafs.FileSystem, str]:
    if path.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def _sizes(paths: list[str]) -> list[int]:
    """The files' sizes; a missing file is an error."""
    out = []
    for path in paths:
        fs, at = _file_system(path)
        info = fs.get_file_info(at)
        if info.type != pafs.FileType.File:
            raise FileNotFoundError(path)
        out.append(info.size)
    return out


@dataclass
class Piece(InputPartition):
    """A byte range of one file. Binary: `first` is the number of its first cell. Text: `first` is the
    number of its first word, and a word belongs to the piece in which it begins."""

    path: str
    t: int
    start: int
    end: int
    first: int
    n_rows: int
    n_cols: int
    scale: int
    text: bool

    def __post_init__(self) -> None:
        super().__init__(None)


class RasterSource(DataSource):
    """Raster files as cells: `spark.read.format("quadgrid_raster").option("pieces", ...)`.

    The option lists byte ranges (see `binary_pieces` and `text_pieces`), so a series of any number
    of steps is one scan with a task for each range."""

    @classmethod
    def name(cls) -> str:
        return "quadgrid_raster"

    def schema(self) -> str:
        return f"t int, {_CELLS}"

    def reader(self, schema) -> DataSourceReader:
        return _PieceReader([Piece(**p) for p in json.loads(self.options["pieces"])])


class _PieceReader(DataSourceReader):
    def __init__(self, pieces: list[Piece]):
        self.pieces = pieces

    def partitions(self) -> list[InputPartition]:
        return self.pieces

    def read(self, piece: Piece) -> Iterator[pa.RecordBatch]:
        values = _text_values(piece) if piece.text else _binary_values(piece)
        pos = max(0, piece.first)
        for v in values:
            at = np.arange(pos, pos + len(v))
            columns = [np.full(len(v), piece.t, np.int32), (at // piece.n_cols).astype(np.int32), (at % piece.n_cols).astype(np.int32), v]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["t", "row", "col", "value"])
            pos += len(v)


def _binary_values(piece: Piece, step: int = 4 << 20) -> Iterator[np.ndarray]:
    fs, path = _file_system(piece.path)
    with fs.open_input_file(path) as f:
        for at in range(piece.start, piece.end, step):
            data = f.read_at(min(step, piece.end - at), at)
            if len(data) != min(step, piece.end - at):
                raise EOFError(f"{piece.path} ends before byte {piece.end}")
            yield np.frombuffer(data, "<i4")


def _words(path: str, start: int, end: int, step: int = 1 << 20) -> Iterator[list[bytes]]:
    """The words that begin in a byte range, some at a time; the last one is read to its end."""
    fs, at = _file_system(path)
    with fs.open_input_file(at) as f:
        size = f.size()
        rest = b"x" if start and f.read_at(1, start - 1).strip() else b""  # a word from before the range
        skip = bool(rest)
        for pos in range(start, end, step):
            data = rest + f.read_at(min(step, end - pos), pos)
            whole = data[-1:].strip() == b""
            words = data.split()
            rest = b"" if whole or not words else words.pop()
            if skip and words:
                words, skip = words[1:], False
            elif skip and whole:
                skip = False
            yield words
        pos = end
        while rest and pos < size:
            more = f.read_at(min(4096, size - pos), pos)
            head = more[:1].strip() and more.split()[0]
            rest += head or b""
            if not head or len(head) < len(more):
                break
            pos += len(more)
        if rest and not skip:
            yield [rest]


def _text_values(piece: Piece) -> Iterator[np.ndarray]:
    """The piece's words as cells, scaled and truncated; of the first piece without the header, whose
    words have negative numbers."""
    skip = max(0, -piece.first)
    for words in _words(piece.path, piece.start, piece.end):
        drop = min(skip, len(words))
        skip -= drop
        if words := words[drop:]:
            yield np.trunc(np.array(words, float) * 10.0**piece.scale).astype(np.int32)


def _scan(spark: SparkSession, pieces: list[dict]) -> DataFrame:
    spark.dataSource.register(RasterSource)
    return spark.read.format("quadgrid_raster").option("pieces", json.dumps(pieces)).load()


def binary_pieces(paths: list[str], n_rows: int, n_cols: int) -> list[dict]:
    """Ranges of whole cells; a file must have n_rows x n_cols cells of four bytes exactly."""
    out = []
    for t, (path, size) in enumerate(zip(paths, _sizes(paths))):
        if size != 4 * n_rows * n_cols:
            raise ValueError(f"{path} has {size} bytes instead of {4 * n_rows * n_cols}")
        for start in range(0, size, PIECE):
            out.append({"path": path, "t": t, "start": start, "end": min(size, start + PIECE), "first": start // 4, "n_rows": n_rows, "n_cols": n_cols, "scale": 0, "text": False})
    return out


def text_pieces(spark: SparkSession, paths: list[str], scale: int) -> list[dict]:
    """Ranges of ASCII grids: words are counted by range in tasks, and prefix sums give each range the
    number of its first cell. The header's size and the number of cells must agree."""
    ranges = [(t, path, a, min(size, a + PIECE)) for t, (path, size) in enumerate(zip(paths, _sizes(paths))) for a in range(0, max(1, size), PIECE)]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pylist()
            n = [sum(map(len, _words(r["path"], r["start"], r["end"]))) for r in rows]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n, pa.int64())], names=[*batch.schema.names, "n"])

    df = spark.createDataFrame(ranges, "t int, path string, start bigint, end bigint").repartition(max(1, min(len(ranges), 10_000)))
    counted = sorted(map(tuple, df.mapInArrow(count, "t int, path string, start bigint, end bigint, n bigint").collect()), key=lambda r: (r[0], r[2]))  # a row for each range
    out, seen, shape = [], {}, {}
    for t, path, start, end, n in counted:
        if t not in shape:
            shape[t] = _header(path)
        first = seen.get(t, 0)
        seen[t] = first + n
        out.append({"path": path, "t": t, "start": start, "end": end, "first": first - 12, "n_rows": shape[t][0], "n_cols": shape[t][1], "scale": scale, "text": True})
    for t, (rows, cols) in shape.items():
        if seen[t] - 12 != rows * cols:
            raise ValueError(f"{paths[t]} has {seen[t] - 12} cells instead of {rows * cols}")
    return out


def _header(path: str) -> tuple[int, int]:
    """(rows, columns) from `ncols N` and `nrows N` at the beginning, in either order."""
    fs, at = _file_system(path)
    with fs.open_input_file(at) as f:
        words = f.read(1 << 16).split()[:4]
    head = {words[i].decode().lower(): words[i + 1] for i in range(0, len(words) - 1, 2)}
    if not {"ncols", "nrows"} <= head.keys():
        raise ValueError(f"{path} doesn't begin with ncols and nrows")
    return int(head["nrows"]), int(head["ncols"])


def read_bin(spark: SparkSession, path: str, n_rows: int, n_cols: int) -> DataFrame:
    """Little-endian 32-bit integers in row order, without a header; a file of another size is an error."""
    return _scan(spark, binary_pieces([path], n_rows, n_cols)).drop("t")


def read_asc(spark: SparkSession, path: str, scale: int = 0) -> DataFrame:
    """An ASCII grid: `ncols`, `nrows`, four more key and value lines, then the values, which
    are multiplied by 10^scale and truncated. Another number of values than ncols x nrows is an error."""
    return _scan(spark, text_pieces(spark, [path], scale)).drop("t")


def read_raster(spark: SparkSession, path: str, n_rows: int | None = None, n_cols: int | None = None, scale: int = 0) -> DataFrame:
    """By the file's ending: `.asc` names its extent, other files need it."""
    if path.endswith(".asc"):
        return read_asc(spark, path, scale)
    if n_rows is None or n_cols is None:
        raise ValueError("a binary raster needs n_rows and n_cols")
    return read_bin(spark, path, n_rows, n_cols)


def read_manifest(spark: SparkSession, path: str, folder: str | None = None, scale: int = 0) -> DataFrame:
    """A series (t, row, col, value): the first line has rows and columns first, the other words are
    file names in the order of t. All files are one scan; a file's name is all that the driver holds of it."""
    lines = [r["value"] for r in spark.read.text(path).collect()]
    n_rows, n_cols = (int(x) for x in lines[0].split()[:2])
    folder = folder or path.rpartition("/")[0]
    paths = [f"{folder}/{name}" for name in " ".join(lines[1:]).split()]
    if not paths:
        raise ValueError(f"{path} names no raster")
    texts = [t for t, p in enumerate(paths) if p.endswith(".asc")]
    plain = [t for t in range(len(paths)) if t not in set(texts)]
    pieces = [p | {"t": plain[p["t"]]} for p in binary_pieces([paths[t] for t in plain], n_rows, n_cols)]
    pieces += [p | {"t": texts[p["t"]]} for p in (text_pieces(spark, [paths[t] for t in texts], scale) if texts else [])]
    return _scan(spark, pieces)


def read_points(spark: SparkSession, path: str, series: bool = False, header: bool = False) -> DataFrame:
    """`row col [t]` a line; with header, the first line (a count) is left out."""
    return _numbers(spark, path, ["row", "col", *(["t"] if series else [])], header)


def read_regions(spark: SparkSession, path: str, series: bool = False, values: bool = False, header: bool = False) -> DataFrame:
    """`xini xend yini yend [tini tend] [valini valend]` a line."""
    names = ["xini", "xend", "yini", "yend", *(["tini", "tend"] if series else []), *(["valini", "valend"] if values else [])]
    return _numbers(spark, path, names, header)


def _numbers(spark: SparkSession, path: str, names: list[str], header: bool) -> DataFrame:
    words = F.split(F.trim("value"), r"\s+")
    lines = spark.read.text(path).where(F.trim("value") != "").select(F.monotonically_increasing_id().alias("query_id"), words.alias("w"))
    if header:
        lines = lines.where("query_id <> 0")
    return lines.select("query_id", *[F.col("w")[i].cast("int").alias(n) for i, n in enumerate(names)])


# --- the window sink -------------------------------------------------------------------------

#: Cells of one part file.
CHUNK = 1 << 20


def write_windows(cells: DataFrame, queries: DataFrame, path: str, chunk: int = CHUNK) -> int:
    """The windows of queries (query_id, xini, xend, yini, yend) in the order of query_id, row by row, as
    little-endian 32-bit integers; cells is (query_id, row, col, value). Returns how many were written.

    Prefix sums over the windows' sizes give each cell its place in the whole; a task fills the part
    files of its places, and `manifest` names these in order. Places without a cell are 0.
    """
    spark = cells.sparkSession
    size = (F.col("xend") - F.col("xini") + 1).cast("bigint") * (F.col("yend") - F.col("yini") + 1)
    sized = queries.where("xini <= xend AND yini <= yend").withColumn("size", size)
    ranged = sized.repartitionByRange("query_id").withColumn("part", F.spark_partition_id()).persist()
    try:
        sums = ranged.groupBy("part").agg(F.sum("size").alias("n")).orderBy("part").collect()  # a row for each partition
        bases, total = [], 0
        for r in sums:
            bases.append((r["part"], total))
            total += r["n"]
        if not total:
            spark.createDataFrame([], "place bigint, file string, n bigint").coalesce(1).write.json(f"{path}/manifest")
            return 0
        base = F.broadcast(spark.createDataFrame(bases, "part int, base bigint"))
        within = F.coalesce(F.sum("size").over(Window.partitionBy("part").orderBy("query_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        begins = ranged.join(base, "part").withColumn("begin", F.col("base") + within).select("query_id", "begin", "xini", "xend", "yini", "yend")
        width = F.col("yend") - F.col("yini") + 1
        inside = F.col("row").between(F.col("xini"), F.col("xend")) & F.col("col").between(F.col("yini"), F.col("yend"))
        place = F.col("begin") + (F.col("row") - F.col("xini")).cast("bigint") * width + F.col("col") - F.col("yini")
        placed = cells.join(begins, "query_id").where(inside).select(place.alias("place"), F.col("value").cast("int").alias("value"))
        n_chunks = -(-total // chunk)
        marks = spark.range(n_chunks).select((F.col("id") * chunk).alias("place"), F.lit(None).cast("int").alias("value"))
        both = placed.unionByName(marks).withColumn("chunk", F.floor(F.col("place") / chunk))

        def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, held = None, None

            def flush() -> pa.RecordBatch:
                n = min(chunk, total - now * chunk)
                file = _write_part(path, now, held[:n])
                return pa.RecordBatch.from_pydict({"place": pa.array([now * chunk], pa.int64()), "file": pa.array([file]), "n": pa.array([n], pa.int64())})

            for batch in batches:
                chunks, places, values = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2)
                known = np.asarray(values.is_valid())
                values = values.fill_null(0).to_numpy()
                for c in np.unique(chunks).tolist():
                    if c != now:
                        if now is not None:
                            yield flush()
                        now, held = c, np.zeros(chunk, "<i4")
                    mine = (chunks == c) & known
                    held[places[mine] - c * chunk] = values[mine]
            if now is not None:
                yield flush()

        parts = both.repartitionByRange("chunk").sortWithinPartitions("chunk").select("chunk", "place", "value")
        parts.mapInArrow(fill, "place bigint, file string, n bigint").write.json(f"{path}/manifest")
        return total
    finally:
        ranged.unpersist()


def _write_part(path: str, number: int, values: np.ndarray) -> str:
    """A part file, which appears under its name only when whole; a task that runs again replaces it."""
    fs, folder = _file_system(path)
    fs.create_dir(folder, recursive=True)
    name = f"part-{number:08d}.bin"
    with fs.open_output_stream(f"{folder}/_{name}.tmp", compression=None) as out:
        out.write(values.astype("<i4").tobytes())
    fs.move(f"{folder}/_{name}.tmp", f"{folder}/{name}")
    return name


def _parts(spark: SparkSession, path: str) -> list:
    """The manifest's rows (place of the first cell, file, n) in order: one for each part file."""
    return spark.read.schema("place bigint, file string, n bigint").json(f"{path}/manifest").orderBy("place").collect()


def window_files(spark: SparkSession, path: str) -> list[str]:
    """The part files of a sink in their order."""
    return [f"{path}/{r['file']}" for r in _parts(spark, path)]


def read_windows(spark: SparkSession, path: str) -> DataFrame:
    """(place, value) of all that a sink wrote; a part of another size than the manifest says is an error."""
    rows, wide = _parts(spark, path), 1 << 30
    files = [f"{path}/{r['file']}" for r in rows]
    pieces = []
    for r, file, size in zip(rows, files, _sizes(files)):
        if size != 4 * r["n"]:
            raise ValueError(f"{file} has {size} bytes instead of {4 * r['n']}")
        pieces.append({"path": file, "t": 0, "start": 0, "end": size, "first": r["place"], "n_rows": 0, "n_cols": wide, "scale": 0, "text": False})
    return _scan(spark, pieces).select((F.col("row").cast("bigint") * wide + F.col("col")).alias("place"), "value")


def gradient(spark: SparkSession, n: int, top: int = 100) -> DataFrame:
    """The demonstration raster: (y + x) / 2 over 0..top, truncated."""
    row, col = F.floor(F.col("id") / n), F.col("id") % n
    value = (row * top / (n - 1) + col * top / (n - 1)) / 2
    return spark.range(n * n).select(row.cast("int").alias("row"), col.cast("int").alias("col"), F.floor(value).cast("int").alias("value"))


def random_raster(spark: SparkSession, n_rows: int, n_cols: int, low: int, high: int, seed: int = 1) -> DataFrame:
    value = F.floor(F.rand(seed) * (high - low + 1)) + low
    return spark.range(n_rows * n_cols).select(F.floor(F.col("id") / n_cols).cast("int").alias("row"), (F.col("id") % n_cols).cast("int").alias("col"), value.cast("int").alias("value"))
