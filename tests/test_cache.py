"""The cache: round trips, and every way in which it can be broken raises."""

import json
import shutil

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from lodestone.sources import cache

ID = {"model": "trunk-1", "split": "train", "seed": 7}


@pytest.fixture
def rows(spark):
    return spark.range(40).select("id", F.when(F.col("id") > 0, F.concat(F.lit("p"), "id")).alias("path"), F.array(F.col("id").cast("float"), F.lit(0.5).cast("float")).alias("v")).repartition(3)


def test_round_trip(spark, rows, tmp_path):
    key = cache.write_cache(rows, str(tmp_path), ID)
    assert key == cache.cache_key({k: ID[k] for k in reversed(ID)}) and (tmp_path / key).is_dir()
    back = cache.read_cache(spark, str(tmp_path), ID, {"v": 2})
    assert sorted(map(str, back.collect())) == sorted(map(str, rows.collect())) and back.dtypes == rows.dtypes
    # A second writer of the same key changes nothing, and no staging folder stays.
    cache.write_cache(rows.limit(3), str(tmp_path), ID)
    assert cache.read_cache(spark, str(tmp_path), ID).count() == 40 and [p.name for p in tmp_path.iterdir()] == [key]
    with pytest.raises(cache.CacheError, match="no cache"):
        cache.read_cache(spark, str(tmp_path), ID | {"seed": 8})
    with pytest.raises(cache.CacheError, match="can still learn"):
        cache.write_cache(rows, str(tmp_path), ID, frozen=False)


def test_broken_caches(spark, rows, tmp_path):
    whole = tmp_path / "whole"
    key = cache.write_cache(rows, str(whole), ID)

    def copy(name):
        shutil.copytree(whole, tmp_path / name)
        return tmp_path / name / key

    at = copy("no-manifest")
    shutil.rmtree(at / "manifest")
    with pytest.raises(cache.CacheError, match="half-written"):
        cache.read_cache(spark, str(at.parent), ID)

    at = copy("no-success")
    (at / "rows" / "_SUCCESS").unlink()
    with pytest.raises(cache.CacheError, match="half-written"):
        cache.read_cache(spark, str(at.parent), ID)

    at = copy("lost")
    next(p for p in (at / "rows").glob("part-*") if spark.read.parquet(str(p)).count()).unlink()
    with pytest.raises(cache.CacheError, match="lost or gained"):
        cache.read_cache(spark, str(at.parent), ID)

    at = copy("edited")
    part = next((at / "manifest").glob("part-*"))
    text = part.read_text().replace('"seed": 7', '"seed": 9')
    for crc in (at / "manifest").glob(".*.crc"):
        crc.unlink()
    part.write_text(text)
    with pytest.raises(cache.CacheError, match="broken manifest"):
        cache.read_cache(spark, str(at.parent), ID)

    # A changed row with its old digest: found while it is read.
    at = copy("changed")
    was = spark.read.parquet(str(at / "rows"))
    changed = was.withColumn("path", F.when(F.col("id") == 5, F.lit("other")).otherwise(F.col("path")))
    changed.write.parquet(str(tmp_path / "changed-rows"))
    shutil.rmtree(at / "rows")
    shutil.copytree(tmp_path / "changed-rows", at / "rows")
    with pytest.raises(PySparkException, match="not what was written"):
        cache.read_cache(spark, str(at.parent), ID).collect()


@pytest.mark.parametrize("bad", ["array(cast('NaN' as float), 1f)", "array(1f)", "array(cast(null as float), 1f)", "cast(null as array<float>)", "array(cast('Infinity' as float), 1f)"])
def test_vectors_are_checked(spark, tmp_path, bad):
    rows = spark.sql(f"SELECT 1 AS id, array(1f, 2f) AS v UNION ALL SELECT 2, {bad}")
    cache.write_cache(rows, str(tmp_path), ID)
    assert cache.read_cache(spark, str(tmp_path), ID).count() == 2
    with pytest.raises(PySparkException, match="another width or a number"):
        cache.read_cache(spark, str(tmp_path), ID, {"v": 2}).collect()


def test_empty_and_digests(spark, rows, tmp_path):
    cache.write_cache(rows.limit(0), str(tmp_path / "c"), ID)
    assert cache.read_cache(spark, str(tmp_path / "c"), ID, {"v": 2}).isEmpty()
    (tmp_path / "w").mkdir()
    (tmp_path / "w" / "weights.bin").write_bytes(json.dumps(ID).encode())
    found = cache.file_digests(spark, str(tmp_path / "w"))
    cache.digest_guard(found, dict(found))
    for pinned in ({"weights.bin": "0" * 32}, {"other.bin": found["weights.bin"]}):
        with pytest.raises(cache.CacheError, match="pinned"):
            cache.digest_guard(found, pinned)
