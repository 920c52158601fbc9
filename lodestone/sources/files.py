"""Files as tables: recursive scans, manifests and predictions with declared schemas, guards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Columns of the artefacts, as DDL.
SCHEMAS = {
    "manifest": "path string, split string, class_dir string, ext string, bytes bigint, read_ok boolean, width int, height int, md5 string, sha256 string, source_key string, chain string, lineage_class string, duplicate_group string",
    "pairs": "file_a string, file_b string, hamming int, same_split boolean, same_source_key boolean",
    "bags": "bag_id string, source_group_id string, bag_label string, instance_count int, instance_list string, instance_md5_list string, source_key string, splits string, multi_split boolean, original_candidate_path string",
    "split": "split string, source_group_id string, bag_id string, bag_label string, image_path string, md5 string, allocation_unit_id string",
    "predictions": "bag_id string, source_group_id string, y_true int, probability double, prediction int, split string",
}


def scan_files(spark: SparkSession, root: str, extensions: tuple[str, ...] = ("png", "jpg", "jpeg")) -> DataFrame:
    """path, ext, bytes, md5, sha256 of every file under `root` with one of the extensions, whatever their case.

    Spark's scan has no rows for files without content.
    """
    # By the name, before anything is read: other files are not opened.
    either = lambda x: "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in x)
    glob = "*.{" + ",".join(map(either, extensions)) + "}"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(root)
    ext = F.lower(F.element_at(F.split("path", r"\."), -1))
    rows = files.where(ext.isin(list(extensions)))
    return rows.select("path", ext.alias("ext"), F.col("length").alias("bytes"), F.md5("content").alias("md5"), F.sha2("content", 256).alias("sha256"), F.col("content").isNotNull().alias("read_ok"), F.col("modificationTime").alias("modified"))


def common_folder(files: DataFrame) -> str | None:
    """The deepest folder that all paths share: what the least and the greatest path share."""
    low, high = files.agg(F.min("path"), F.max("path")).first()
    if low is None:
        return None
    a, b = low.split("/")[:-1], high.split("/")[:-1]
    same = [x for x, y in zip(a, b) if x == y]
    n = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(same))
    return "/".join(a[:n])


def read_csv(spark: SparkSession, path: str, artefact: str) -> DataFrame:
    """A CSV artefact by its declared schema; empty fields are null, and a row that does not fit raises."""
    return spark.read.schema(SCHEMAS[artefact]).option("header", True).option("nullValue", "").option("mode", "FAILFAST").csv(path)


def read_predictions(spark: SparkSession, path: str, score: str = "probability", clip: bool = False) -> DataFrame:
    """id, y_true, probability of a prediction file: other names of the label and the id are taken too."""
    raw = spark.read.option("header", True).option("nullValue", "").csv(path)
    first = lambda *names: F.coalesce(*[F.col(n) for n in names if n in raw.columns])
    p = F.col(score).cast("double")
    return raw.select(first("bag_id", "image_path").alias("id"), first("y_true", "true_label").cast("int").alias("y_true"), (F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0)) if clip else p).alias("probability"))


def guard(rows: DataFrame, ok: Column, message: str) -> DataFrame:
    """`rows`, with an error in the first row that breaks the rule when it is read; no extra pass."""
    return rows.where(F.when(F.coalesce(ok, F.lit(False)), True).otherwise(F.raise_error(F.lit(message)).cast("boolean")))


def open_split(rows: DataFrame, split: str, allowed: tuple[str, ...] = ("train", "val")) -> DataFrame:
    """The rows of a split that may be opened; others raise at once."""
    if split not in allowed:
        raise ValueError(f"split {split!r} is closed")
    return rows.where(F.col("split") == split)


def by_keys(rows: DataFrame, key: str, keys: list) -> DataFrame:
    """The rows of named keys; an unknown key raises."""
    found = {r[0] for r in rows.where(F.col(key).isin(keys)).select(key).distinct().collect()}  # as many as were named
    if unknown := set(keys) - found:
        raise KeyError(f"unknown {key}: {sorted(unknown)}")
    return rows.where(F.col(key).isin(keys))
