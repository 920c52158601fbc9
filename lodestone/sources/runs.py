"""What stands around a run: where the data is, its configuration, and the folder that records it."""

from __future__ import annotations

import hashlib
import json
import os
import platform
from collections.abc import Iterable

import pyspark
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import files, sinks


def _exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def find_root(spark: SparkSession, given: str | None = None, variable: str | None = None, caches: Iterable[str] = ()) -> tuple[str | None, str, list[str]]:
    """(root, how, searched): the first that exists of the path given, the one in an environment variable, and the caches in their order.

    A path that is given and does not exist is an answer: nothing else is searched.
    """
    tried: list[str] = []
    named = [("argument", given), ("environment", os.environ.get(variable) if variable else None)]
    for how, path in named:
        if path:
            tried.append(path)
            return (path, how, tried) if _exists(spark, path) else (None, how, tried)
    for path in caches:
        tried.append(path)
        if _exists(spark, path):
            return path, "cache", tried
    return None, "none", tried


def load_config(spark: SparkSession, path: str, version: str) -> dict:
    """A JSON configuration; raises if its version is another."""
    (row,) = spark.read.text(path, wholetext=True).collect()
    config = json.loads(row.value)
    if str(config.get("version")) != version:
        raise ValueError(f"{path} has version {config.get('version')}, not {version}")
    return config


def read_split_predictions(spark: SparkSession, path: str, split: str) -> DataFrame:
    """(bag_id, y_true, probability, prediction) of a split, one row a bag; a file that is not there gives no rows."""
    if not _exists(spark, path):
        return spark.createDataFrame([], files.SCHEMAS["predictions"]).select("bag_id", "y_true", "probability", "prediction")
    rows = files.read_csv(spark, path, "predictions").where(F.col("split") == split)
    return rows.groupBy("bag_id").agg(*[F.max_by(c, F.struct("source_group_id", "y_true", "probability")).alias(c) for c in ("y_true", "probability", "prediction")])


def write_attention(rows: DataFrame, path: str, bag: str, instance: str, vector: str) -> None:
    """Two sinks of one computation: a CSV row an instance, in order, and a JSON line a bag with the vectors of its instances in chunks of 256."""
    from ..operators.chunks import chunked
    from .scratch import written

    kept = written(rows, "attention")
    sinks.write_csv(kept.drop(vector), f"{path}/instances", [bag, instance])
    chunked(kept, [bag], [instance], 256, [instance, vector]).write.mode("overwrite").json(f"{path}/vectors")


def _write_text(spark: SparkSession, text: str, path: str) -> None:
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)


def write_experiment(spark: SparkSession, path: str, config: dict, log: DataFrame, metrics: dict, seed: int, manifests: dict[str, DataFrame]) -> dict[str, str]:
    """A folder with config, log, metrics, seed, environment and the digests of the manifests; returns the digests.

    A digest is that of the rows, whatever their order.  A folder that is there raises.
    """
    if _exists(spark, path):
        raise FileExistsError(path)
    found = {}
    for name, rows in manifests.items():
        line = F.md5(F.to_json(F.struct(*sorted(rows.columns)), {"ignoreNullFields": "false"}))
        parts = [F.sum(F.conv(F.substring(line, at, 8), 16, 10).cast("decimal(38,0)")).cast("string") for at in (1, 9, 17, 25)]
        sums = rows.agg(F.count(F.lit(1)).cast("string"), *parts).first()
        found[name] = hashlib.sha256(":".join(map(str, sums)).encode()).hexdigest()
    env = {"python": platform.python_version(), "spark": pyspark.__version__, "system": platform.system()}
    for name, value in {"config": config, "metrics": metrics, "seed": {"seed": seed}, "environment": env, "provenance": found}.items():
        _write_text(spark, json.dumps(value, sort_keys=True), f"{path}/{name}")
    log.coalesce(1).write.option("header", True).csv(f"{path}/log")
    return found
