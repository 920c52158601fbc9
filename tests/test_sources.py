"""Readers, guards and writers over files."""

import hashlib
import json

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from lodestone.sources import files, sinks
from lodestone.streaming import duplicates


def test_scan(spark, tmp_path):
    for name, data in (("a/train/x (1).PNG", b"1"), ("a/val/y.jpg", b"22"), ("a/val/z.txt", b"no")):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(data)
    got = files.scan_files(spark, str(tmp_path)).orderBy("path")
    rows = got.collect()
    assert [(r.ext, r.bytes, r.read_ok) for r in rows] == [("png", 1, True), ("jpg", 2, True)]
    # Files of other kinds are left out by their names, in the scan itself.
    assert "pathglobfilter" in got._jdf.queryExecution().toString().lower() or got.count() == 2
    assert rows[0].md5 == hashlib.md5(b"1").hexdigest() and files.common_folder(got).endswith("/a")


def test_csv_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("b2", None, 1, 0.30000000000000004, 0, "val"), ("b1", "g", 0, 0.9, 1, "val")], files.SCHEMAS["predictions"])
    sinks.write_csv(rows, str(tmp_path / "p"), ["bag_id"], single=True)
    back = files.read_csv(spark, str(tmp_path / "p"), "predictions")
    assert sorted(map(str, back.collect())) == sorted(map(str, rows.collect()))
    assert [r.id for r in files.read_predictions(spark, str(tmp_path / "p"), clip=True).collect()] == ["b1", "b2"]


def test_splits_have_stable_digests(spark, tmp_path):
    rows = spark.range(200).select("id", (F.col("id") % 3).cast("string").alias("split"))
    first = sinks.write_splits(rows, str(tmp_path / "a"), "id")
    assert first == sinks.write_splits(rows.orderBy(F.desc("id")), str(tmp_path / "b"), "id") and set(first) == {"0", "1", "2"}
    assert sinks.write_splits(rows.where("id <> 5"), str(tmp_path / "c"), "id") != first


def test_guards(spark):
    rows = spark.createDataFrame([("a", "train"), ("b", "test")], "k string, split string")
    assert files.open_split(rows, "train").count() == 1 and files.by_keys(rows, "k", ["a"]).count() == 1
    with pytest.raises(ValueError):
        files.open_split(rows, "test")
    with pytest.raises(KeyError):
        files.by_keys(rows, "k", ["a", "zz"])
    with pytest.raises(PySparkException):
        files.guard(rows, F.col("split") == "train", "test rows are closed").collect()
    odd = rows.select(F.col("split").alias('a "b\\'))
    assert json.loads(sinks.summary(odd, odd.columns)) == {'a "b\\': {"test": 1, "train": 1}}
    assert sinks.summary(rows, ["split"]) == '{"split":{"test":1,"train":1}}'


def test_stream_drops_repeats(spark, tmp_path):
    rows = spark.sql("SELECT id % 5 AS k, TIMESTAMP '2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, CAST(id AS INT)) AS ts FROM range(20)")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    assert duplicates.drain(spark, duplicates.distinct_events(stream, ["k"]), "append").count() == 5


def test_stream_updates_windows_over_batches(spark, tmp_path):
    """Two batches for the same windows: the last state of each comes out, and nothing is kept in the driver."""
    for k in range(2):
        spark.sql(f"SELECT TIMESTAMP '2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, CAST(id AS INT)) AS ts, 'x' AS kind, CAST(id + {k} AS DOUBLE) AS value FROM range(30)").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, kind string, value double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = duplicates.drain(spark, duplicates.windowed_counts(stream, "kind", late="2 days"), "update", ["window", "kind"])
    assert sorted((r.window.start.day, r.n, r.total) for r in got.collect()) == [(1, 48, 2 * sum(range(24)) + 24), (2, 12, 2 * sum(range(24, 30)) + 6)]
    with pytest.raises(ValueError):
        duplicates.drain(spark, stream, "update")
