"""A cache of computed rows under the digest of what they are, with a commit that is whole or absent.

Rows are written to a staging folder with a digest each.  The manifest (identity, row
count, sum of the digests, and a digest of itself) is written last, and the folder then takes
its final name by one rename: a writer that dies leaves a staging folder that no reader looks at.
A reader compares the identity, counts rows and sums digests before it hands out
the rows, and checks every row's digest, shape and finiteness while it is read.
"""

from __future__ import annotations

import hashlib
import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.integrity import must

ROWS, MANIFEST = "rows", "manifest"


class CacheError(RuntimeError):
    """A cache that is absent, half written, of other content or broken."""


def cache_key(identity: dict) -> str:
    """sha256 of the identity as JSON with sorted keys."""
    return hashlib.sha256(json.dumps(identity, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def _path(spark: SparkSession, name: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(name)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def row_digest(columns: list[str]) -> Column:
    """63 bits of the md5 of a row as JSON, its columns by name."""
    return F.conv(F.substring(F.md5(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"})), 1, 15), 16, 10).cast("bigint")


def _sums(rows: DataFrame) -> tuple[int, str]:
    n, total = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("_digest").cast("decimal(38,0)")), F.lit(0))).first()
    return n, str(int(total))


def write_cache(rows: DataFrame, root: str, identity: dict, frozen: bool = True) -> str:
    """Write `rows` under `root` by the key of `identity`, and return the key; one that is there stays as it is.

    Rows of a model that is still learning must not be kept: `frozen` False raises.
    """
    if not frozen:
        raise CacheError("rows of a model that can still learn are not cached")
    spark, key = rows.sparkSession, cache_key(identity)
    final, fs = _path(spark, f"{root}/{key}")
    if fs.exists(final):
        return key
    stage = f"{root}/_staging-{key}-{uuid.uuid4().hex}"
    rows.withColumn("_digest", row_digest(rows.columns)).write.parquet(f"{stage}/{ROWS}")
    n, total = _sums(spark.read.parquet(f"{stage}/{ROWS}"))
    manifest = {"identity": identity, "columns": [f"{c} {t}" for c, t in rows.dtypes], "rows": n, "digests": total}
    manifest["self"] = cache_key(manifest)
    spark.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "value string").coalesce(1).write.text(f"{stage}/{MANIFEST}")
    if not fs.rename(_path(spark, stage)[0], final):
        # Another writer of the same key came first; its rows are the same.
        fs.delete(_path(spark, stage)[0], True)
    return key


def read_cache(spark: SparkSession, root: str, identity: dict, vectors: dict[str, int] | None = None) -> DataFrame:
    """The rows of an identity; raises if they are absent, half written, of another identity, or not what was written.

    `vectors` names array columns and their width: reading a row with another width, a
    null or a number that is not finite raises, as does one whose digest differs.
    """
    key = cache_key(identity)
    at = f"{root}/{key}"
    found, fs = _path(spark, at)
    if not fs.exists(found):
        raise CacheError(f"no cache {key[:12]}")
    for part in (ROWS, MANIFEST):
        if not fs.exists(_path(spark, f"{at}/{part}/_SUCCESS")[0]):
            raise CacheError(f"half-written cache {key[:12]}: {part}")
    lines = spark.read.text(f"{at}/{MANIFEST}").take(2)
    try:
        manifest = json.loads(lines[0].value) if len(lines) == 1 else {}
    except ValueError:
        manifest = {}
    if manifest.pop("self", None) != cache_key(manifest):
        raise CacheError(f"broken manifest of cache {key[:12]}")
    if manifest["identity"] != identity:
        raise CacheError(f"cache {key[:12]} holds another identity")
    rows = spark.read.parquet(f"{at}/{ROWS}")
    columns = [c for c in rows.columns if c != "_digest"]
    if [f"{c} {t}" for c, t in rows.select(columns).dtypes] != manifest["columns"]:
        raise CacheError(f"cache {key[:12]} has other columns")
    # One pass over the digests only.
    if _sums(rows) != (manifest["rows"], manifest["digests"]):
        raise CacheError(f"cache {key[:12]} has lost or gained rows")
    rows = rows.where(must(row_digest(columns) == F.col("_digest"), f"a row of cache {key[:12]} is not what was written"))
    for name, width in (vectors or {}).items():
        sound = (F.size(name) == width) & F.forall(name, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf")))
        rows = rows.where(must(sound, f"cache {key[:12]}: {name} has another width or a number that is not finite"))
    return rows.select(columns)


def file_digests(spark: SparkSession, path: str) -> dict[str, str]:
    """md5 of every file under a path, by its name from there."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    rows = files.select(F.element_at(F.split("path", "/"), -1).alias("name"), F.md5("content").alias("md5"))
    return {r.name: r.md5 for r in rows.collect()}  # as many as there are files of a checkpoint


def digest_guard(found: dict[str, str], pinned: dict[str, str]) -> None:
    """Raise where a pinned digest is missing or another."""
    for name, want in sorted(pinned.items()):
        if found.get(name) != want:
            raise CacheError(f"{name}: digest {found.get(name)} is not the pinned {want}")
