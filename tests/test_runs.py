"""Picture files with every filter and failure, records of runs, configuration, roots."""

import json
import math
import struct
import zlib

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from lodestone.operators import mil as M
from lodestone.sources import pictures as P
from lodestone.sources import runs


def png(values, depth=8, kind=0, filters=(0, 1, 2, 3, 4)):
    """A PNG of values (height, width, channels), its lines filtered in turn."""
    height, width, channels = values.shape
    step = channels * depth // 8
    lines = values.astype(">u2" if depth == 16 else "u1").tobytes()
    size, above, out = width * step, bytes(width * step), b""
    for y in range(height):
        line, f = lines[y * size : (y + 1) * size], filters[y % len(filters)]
        left = lambda i, row: row[i - step] if i >= step else 0

        def guess(i):
            a, b, c = left(i, line), above[i], left(i, above)
            if f < 4:
                return (0, a, b, (a + b) // 2)[f]
            p = a + b - c
            pa, pb, pc = abs(p - a), abs(p - b), abs(p - c)
            return a if pa <= pb and pa <= pc else b if pb <= pc else c

        out += bytes([f]) + bytes((line[i] - guess(i)) % 256 for i in range(size))
        above = line
    chunk = lambda name, data: struct.pack(">I", len(data)) + name + data + struct.pack(">I", zlib.crc32(name + data))
    body = zlib.compress(out)
    return P.SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, depth, kind, 0, 0, 0)) + chunk(b"IDAT", body[:7]) + chunk(b"IDAT", body[7:]) + chunk(b"IEND", b"")


@pytest.fixture(scope="module")
def made():
    rng = np.random.default_rng(2)
    return {(d, k): rng.integers(0, 2**d, (11, 7, c)) for d, k, c in ((8, 0, 1), (16, 0, 1), (8, 2, 3), (8, 4, 2), (8, 6, 4), (16, 6, 4))}


def test_pictures(spark, tmp_path, made):
    good = {f"{d}-{k}": png(v, d, k) for (d, k), v in made.items()}
    bad = {"text": b"hello", "empty-ish": b"\x89PNG", "cut": good["8-0"][:50], "flipped": good["8-2"].replace(b"IDAT", b"IDAX", 1), "palette": png(made[8, 0], 8, 3)}
    rows = spark.createDataFrame([(n, bytearray(c)) for n, c in (good | bad).items()] + [("null", None)], "name string, content binary")
    heads = {r.name: r for r in P.headers(rows).collect()}
    for (d, k), v in made.items():
        r = heads[f"{d}-{k}"]
        assert (r.width, r.height, r.bit_depth, r["mode"], r.channels, r.format, r.read_ok) == (7, 11, d, P.MODES[k], v.shape[2], "PNG", True)
    assert [heads[n].read_ok for n in ("text", "empty-ish", "null", "palette")] == [False, False, False, True] and heads["text"].width is None
    got = {r.name: r for r in P.pixels(rows).collect()}
    assert len(got) == len(rows.collect())
    for (d, k), v in made.items():
        grey = v[..., 0] if v.shape[2] < 3 else (v[..., 0] * 19595 + v[..., 1] * 38470 + v[..., 2] * 7471 + 0x8000) >> 16
        assert got[f"{d}-{k}"].grey == grey.ravel().astype(float).tolist() and got[f"{d}-{k}"].grey_error is None
    assert all(got[n].grey is None and got[n].grey_error for n in [*bad, "null"])


def test_records(spark):
    rows = spark.createDataFrame([("file:/d (1)/train/benign/x-y.png",), ("file:/d (1)/odd.png",), ("file:/d (1)/a/b/c/d.png",)], "path string")
    got = {r.rel: (r.split, r.class_dir, r.name, r.warning) for r in P.records(rows, "file:/d (1)/").collect()}
    assert got == {"train/benign/x-y.png": ("train", "benign", "x-y", None), "odd.png": (None, None, "odd", "depth 1: odd.png"), "a/b/c/d.png": (None, None, "d", "depth 4: a/b/c/d.png")}


def test_roots(spark, tmp_path, monkeypatch):
    a, b, none = str(tmp_path / "a"), str(tmp_path / "b"), str(tmp_path / "none")
    for p in (a, b):
        (tmp_path / p).mkdir()
    monkeypatch.delenv("DATA_ROOT", raising=False)
    assert runs.find_root(spark, a, "DATA_ROOT", [b]) == (a, "argument", [a])
    assert runs.find_root(spark, None, "DATA_ROOT", [none, b]) == (b, "cache", [none, b])
    assert runs.find_root(spark, none, None, [b]) == (None, "argument", [none]) and runs.find_root(spark) == (None, "none", [])
    monkeypatch.setenv("DATA_ROOT", b)
    assert runs.find_root(spark, None, "DATA_ROOT", [a]) == (b, "environment", [b])


def test_config_and_predictions(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"version": 3,\n "x": 1}')
    assert runs.load_config(spark, str(tmp_path / "c.json"), "3")["x"] == 1
    with pytest.raises(ValueError, match="version"):
        runs.load_config(spark, str(tmp_path / "c.json"), "4")
    assert runs.read_split_predictions(spark, str(tmp_path / "none.csv"), "val").isEmpty()
    (tmp_path / "p.csv").write_text("bag_id,source_group_id,y_true,probability,prediction,split\nb1,g,1,0.25,0,val\nb2,g,,,,val\nb3,g,1,0.5,1,train\n")
    assert sorted(map(tuple, runs.read_split_predictions(spark, str(tmp_path / "p.csv"), "val").collect())) == [("b1", 1, 0.25, 0), ("b2", None, None, None)]


def test_experiment(spark, tmp_path):
    log = spark.createDataFrame([(0, 0.1), (1, 0.30000000000000004)], "epoch int, auc double")
    rows = spark.range(50).withColumn("t", F.lit('a"b'))
    found = runs.write_experiment(spark, str(tmp_path / "e"), {"lr": 0.1}, log, {"auc": 0.3}, 7, {"rows": rows, "less": rows.limit(49)})
    assert found["rows"] != found["less"] and found["rows"] == runs.write_experiment(spark, str(tmp_path / "f"), {}, log, {}, 7, {"rows": rows.orderBy(F.desc("id")).repartition(3)})["rows"]
    assert json.loads(spark.read.text(str(tmp_path / "e" / "provenance")).first().value) == found
    assert spark.read.option("header", True).schema(log.schema).csv(str(tmp_path / "e" / "log")).collect() == log.collect()
    with pytest.raises(FileExistsError):
        runs.write_experiment(spark, str(tmp_path / "e"), {}, log, {}, 7, {})


def test_attention_sinks_and_checks(spark, tmp_path):
    rows = spark.createDataFrame([("a", i, 1 / 3, [float(i), 0.1]) for i in range(3)] + [("b", 0, 1.0, [5.0, 6.0])], "bag string, at int, attention double, h array<double>")
    runs.write_attention(rows, str(tmp_path / "x"), "bag", "at", "h")
    assert spark.read.option("header", True).csv(str(tmp_path / "x" / "instances")).count() == 4
    assert {r.bag: r.h for r in spark.read.json(str(tmp_path / "x" / "vectors")).collect()} == {"a": [[0.0, 0.1], [1.0, 0.1], [2.0, 0.1]], "b": [[5.0, 6.0]]}
    assert {r.bag: (r.n, math.isclose(r.total, 1)) for r in M.checked_attention(rows, "bag", "attention", "h", 2).collect()} == {"a": (3, True), "b": (1, True)}
    for bad, says in ((("b", 1, float("nan"), [1.0, 1.0]), "not finite"), (("b", 1, 0.5, [1.0, 1.0]), "add up"), (("b", 1, 0.0, [1.0]), "another kind"), (("b", 1, 0.0, [1.0, float("inf")]), "another kind")):
        with pytest.raises(PySparkException, match=says):
            M.checked_attention(rows.union(spark.createDataFrame([bad], rows.schema)), "bag", "attention", "h", 2).collect()
