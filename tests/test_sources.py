"""Raster files, the window sink and measured runs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quadgrid import model as m
from quadgrid.operators import measure
from quadgrid.sources import files


def as_dict(df):
    return {(r["row"], r["col"]): r["value"] for r in df.collect()}


def test_binary_file_in_pieces(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "PIECE", 64)
    values = np.random.default_rng(1).integers(-(2**31), 2**31, (13, 17)).astype("<i4")
    values.tofile(tmp_path / "a.bin")
    df = files.read_raster(spark, str(tmp_path / "a.bin"), 13, 17)
    assert df.rdd.getNumPartitions() == -(-13 * 17 * 4 // 64)
    assert as_dict(df) == {(i, j): int(values[i, j]) for i in range(13) for j in range(17)}
    for rows in (12, 14):
        with pytest.raises(ValueError, match="bytes instead of"):
            files.read_bin(spark, str(tmp_path / "a.bin"), rows, 17)
    with pytest.raises(FileNotFoundError):
        files.read_bin(spark, str(tmp_path / "b.bin"), 1, 1)


@pytest.mark.parametrize("piece", [1, 3, 7, 50, 1 << 20])
def test_ascii_grid_in_pieces(spark, tmp_path, monkeypatch, piece):
    """Cuts may fall anywhere, within words and between them."""
    monkeypatch.setattr(files, "PIECE", piece)
    rng = random.Random(piece)
    rows, cols = 4, 5
    values = [round(rng.uniform(-99, 99), 2) for _ in range(rows * cols)]
    text = f"ncols {cols}\nnrows {rows}\nxllcorner 0\nyllcorner 0\ncellsize 1\nNODATA_value -9999\n"
    text += "".join(f"{v}{rng.choice([' ', chr(10), '  ', chr(13) + chr(10)])}" for v in values).rstrip(rng.choice(["", "\r\n "]))
    (tmp_path / "a.asc").write_text(text)
    got = as_dict(files.read_asc(spark, str(tmp_path / "a.asc"), 1))
    assert got == {(i // cols, i % cols): int(np.trunc(v * 10.0)) for i, v in enumerate(values)}


@pytest.mark.parametrize("change", [lambda w: w[:-1], lambda w: w + ["7"], lambda w: ["rows", *w[1:]]])
def test_ascii_grid_of_another_size_is_an_error(spark, tmp_path, change):
    words = "ncols 2 nrows 2 x 0 y 0 c 1 n 0 1 2 3 4".split()
    (tmp_path / "a.asc").write_text(" ".join(change(words)))
    with pytest.raises(ValueError):
        files.read_asc(spark, str(tmp_path / "a.asc"))


def test_manifest_is_one_scan(spark, tmp_path):
    n = 300
    for t in range(n):
        np.arange(t, t + 6, dtype="<i4").tofile(tmp_path / f"{t}.bin")
    (tmp_path / "x.asc").write_text("ncols 3 nrows 2 x 0 y 0 c 1 n 0 1 2 3 4 5 6")
    (tmp_path / "list").write_text("2 3 2 2 0 0\n" + "\n".join([*(f"{t}.bin" for t in range(n)), "x.asc", "0.bin"]))
    s = files.read_manifest(spark, str(tmp_path / "list"))
    plan = s._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BatchScan") == 1 and "Union" not in plan
    sums = {r["t"]: r["s"] for r in s.groupBy("t").agg(F.sum("value").alias("s")).collect()}
    assert sums == {t: 6 * t + 15 for t in range(n)} | {n: 21, n + 1: 15}
    assert s.where("t = 5 AND row = 1 AND col = 2").first()["value"] == 10
    (tmp_path / "7.bin").write_bytes(b"\0" * 20)
    with pytest.raises(ValueError, match="7.bin"):
        files.read_manifest(spark, str(tmp_path / "list"))


@pytest.mark.parametrize("chunk", [1, 7, 64, 10_000])
def test_window_sink(spark, tmp_path, chunk):
    rng = random.Random(chunk)
    rows = [(i, x := rng.randrange(10), x + rng.randrange(6), y := rng.randrange(10), y + rng.randrange(6)) for i in range(25)] + [(30, 5, 4, 0, 3)]
    cells = {(i, j): rng.randint(-(2**31), 2**31 - 1) for i in range(13) for j in range(13) if rng.random() < 0.8}
    q = spark.createDataFrame(rows, "query_id long, xini int, xend int, yini int, yend int")
    c = spark.createDataFrame([(k, i, j, v) for k, x, x2, y, y2 in rows for (i, j), v in cells.items() if x <= i <= x2 and y <= j <= y2], "query_id long, row int, col int, value int").repartition(4)
    n = files.write_windows(c, q, str(tmp_path / "out"), chunk)
    want = [cells.get((i, j), 0) for _, x, x2, y, y2 in rows for i in range(x, x2 + 1) for j in range(y, y2 + 1)]
    parts = files.window_files(spark, str(tmp_path / "out"))
    assert n == len(want) and len(parts) == -(-n // chunk)
    assert np.concatenate([np.fromfile(p, "<i4") for p in parts]).tolist() == want


def test_window_sink_without_windows(spark, tmp_path):
    none = spark.createDataFrame([], "query_id long, xini int, xend int, yini int, yend int, row int, col int, value int")
    assert files.write_windows(none, none, str(tmp_path / "out")) == 0 and files.window_files(spark, str(tmp_path / "out")) == []


def test_history(spark, tmp_path):
    path = str(tmp_path / "history")
    df = spark.range(100).select(F.col("id").alias("query_id"), F.lit(3).alias("n_cells"))
    a = measure.timed("count", df, n_queries=100)
    assert (a.n_rows, a.n_cells) == (100, 300) and a.seconds > 0 and a.us_per_cell < a.us_per_query
    b = measure.timed("cells", spark.range(7), write=lambda x: x.write.parquet(str(tmp_path / "r")))
    assert (b.n_rows, b.n_cells) == (7, 7) and spark.read.parquet(str(tmp_path / "r")).count() == 7
    measure.remember(spark, path, a, b)
    measure.remember(spark, path, measure.timed("count", df.where("false"), n_queries=100))
    found = measure.history(spark, path).collect()
    assert len(found) == 3 and found[0]["n_rows"] == 0 and found[1]["us_per_query"] == pytest.approx(found[1]["seconds"] * 1e6 / found[1]["n_queries"])
    assert {r["name"]: r["n_runs"] for r in measure.summary(spark, path).collect()} == {"count": 2, "cells": 1}


def test_model_cells_query_on_files(spark, tmp_path):
    """A file's cells go through the library like any others."""
    np.arange(12, dtype="<i4").tofile(tmp_path / "a.bin")
    cells = files.read_bin(spark, str(tmp_path / "a.bin"), 3, 4)
    assert cells.schema.simpleString() == "struct<row:int,col:int,value:int>"
    assert m.cut(cells, "cells").count() == 12
