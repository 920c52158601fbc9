"""Readers of the input tables and the manifest that the audit operators work on.

A document stands for a file of a labelled collection.  Its name follows a
grammar (class, number, chain of operations), its class comes from the labels,
and its split, size and shape follow from its id, so that every rule of the
audit has rows that meet it and rows that do not.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Operations that a chain may name.
KNOWN_OPS = ("rotated1", "rotated2", "sharpened")
#: Labels that may be sent to every task: 61 bytes each as Spark sends them.
LABELS = 100_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """An input table; Catalyst prunes its columns and pushes filters into the scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a file: doc_id, path, name, split, class_dir, bytes, width, height, md5, sha256, read_ok."""
    # What the text says is taken before the join, so that no text moves if the join shuffles.
    digests = {"bytes": F.octet_length("text").cast("bigint"), "md5": F.md5("text"), "sha256": F.sha2("text", 256), "read_ok": F.col("text").isNotNull()}
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", *[c.alias(n) for n, c in digests.items()])
    labels = table(spark, sf_dir, "labels")
    toxic = labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    if labels.count() > LABELS:
        # Spark takes the packed file for the labels' size, and would send them all through the driver.
        toxic = toxic.hint("merge")
    member, family = F.col("doc_id") % 4, F.floor(F.col("doc_id") / 4).cast("bigint")
    chain = F.when(member == 0, "").when(member == 1, "-rotated1").when(member == 2, "-rotated1-sharpened").otherwise("-zz9")
    name = F.when(F.col("doc_id") % 50 == 49, F.concat(F.lit("scan_"), F.col("doc_id").cast("string"))).otherwise(F.concat("lang", F.lit(" ("), family.cast("string"), F.lit(")"), chain))
    rows = docs.join(toxic, "doc_id", "left").select(
        "doc_id",
        name.alias("name"),
        F.when(F.col("doc_id") % 7 == 0, "val").otherwise("train").alias("split"),
        F.when(F.col("toxic") == 1, "malignant").otherwise("benign").alias("class_dir"),
        "bytes",
        F.when((member == 0) & (family % 5 != 0), 227).otherwise(300 + F.col("doc_id") % 7).cast("int").alias("width"),
        "md5",
        "sha256",
        "read_ok",
    )
    return rows.withColumns({"height": F.col("width"), "path": F.concat_ws("/", "split", "class_dir", F.concat("name", F.lit(".png")))})


MANIFEST_SQL = """
m AS (
  SELECT doc_id, name, split, class_dir, bytes, width, width AS height, md5, sha256, read_ok,
         split || '/' || class_dir || '/' || name || '.png' AS path
  FROM (
    SELECT d.doc_id,
      CASE WHEN d.doc_id % 50 = 49 THEN 'scan_' || d.doc_id
           ELSE lang || ' (' || (d.doc_id // 4) || ')' || CASE d.doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN '-rotated1' WHEN 2 THEN '-rotated1-sharpened' ELSE '-zz9' END END AS name,
      CASE WHEN d.doc_id % 7 = 0 THEN 'val' ELSE 'train' END AS split,
      CASE WHEN toxic = 1 THEN 'malignant' ELSE 'benign' END AS class_dir,
      octet_length(encode(text))::BIGINT AS bytes,
      (CASE WHEN d.doc_id % 4 = 0 AND (d.doc_id // 4) % 5 <> 0 THEN 227 ELSE 300 + d.doc_id % 7 END)::INT AS width,
      md5(text) AS md5, sha256(text) AS sha256, text IS NOT NULL AS read_ok
    FROM documents d LEFT JOIN (SELECT doc_id, max(toxic) AS toxic FROM labels GROUP BY doc_id) l ON d.doc_id = l.doc_id
  )
)"""
