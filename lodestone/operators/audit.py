"""Audit of a labelled collection: names, lineage, exact duplicates, overlap, digests."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar as S


def parse_names(files: DataFrame, known: Iterable[str]) -> DataFrame:
    """Adds source_key, chain, unknown_ops, depth and stem_parsed from the column name."""
    rows = files.withColumns({"source_key": S.source_key(F.col("name")), "chain": S.chain(F.col("name"))})
    return rows.withColumns({"unknown_ops": S.unknown_ops(F.col("chain"), known), "depth": F.size("chain").cast("bigint"), "stem_parsed": F.col("chain").isNotNull()})


def lineage(parsed: DataFrame) -> DataFrame:
    """Adds lineage_class: confirmed, strong (a variant of the key exists), candidate or unparsed."""
    varied = parsed.where(F.size("chain") > 0).select("source_key", F.lit(True).alias("_varied")).distinct()
    rows = parsed.join(varied, "source_key", "left")
    how = F.when(F.col("chain").isNull(), "unparsed").when(F.size("chain") > 0, "confirmed").when(F.col("_varied"), "strong").otherwise("candidate")
    return rows.withColumn("lineage_class", how).drop("_varied")


def exact_duplicates(files: DataFrame, split: str = "split") -> DataFrame:
    """Groups of files with one md5: duplicate_group, md5, n_files, n_splits, crosses."""
    groups = files.groupBy("md5").agg(F.count(F.lit(1)).alias("n_files"), F.countDistinct(split).alias("n_splits")).where("n_files > 1")
    return groups.select(F.concat(F.lit("exact-"), F.substring("md5", 1, 12)).alias("duplicate_group"), "md5", "n_files", "n_splits", (F.col("n_splits") > 1).alias("crosses"))


def frequencies(rows: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """(dimension, value, n) of several columns in one pass."""
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("dimension"), c.cast("string").alias("value")) for k, c in columns.items()]))
    return rows.select(pairs.alias("p")).groupBy("p.dimension", "p.value").agg(F.count(F.lit(1)).alias("n"))


def key_overlap(parsed: DataFrame) -> DataFrame:
    """Keys in more than one split: splits, files a split, chains that both have, whether a member has an exact copy."""
    copies = parsed.groupBy("md5").agg((F.count(F.lit(1)) > 1).alias("copied"))
    rows = parsed.where("source_key IS NOT NULL").join(copies, "md5")
    text = F.array_join("chain", "|")
    both = rows.groupBy("source_key", text.alias("chain_text")).agg(F.countDistinct("split").alias("n"), F.collect_set("split").alias("splits"), F.sum(F.when(F.col("split") == "train", 1).otherwise(0)).alias("t"), F.sum(F.when(F.col("split") == "val", 1).otherwise(0)).alias("v"), F.bool_or("copied").alias("copied"))
    keys = both.groupBy("source_key").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("splits")))).alias("splits"), F.sum("t").alias("train_files"), F.sum("v").alias("val_files"),
        F.array_join(F.array_sort(F.collect_list(F.when(F.col("n") > 1, F.col("chain_text")))), ",").alias("shared_chains"), F.bool_or("copied").alias("has_exact_duplicate_member"),
    )
    return keys.where(F.size("splits") > 1).withColumn("splits", F.array_join("splits", "|"))


def vocabulary_scan(rows: DataFrame, name: str, hints: Iterable[str], suffix: str) -> DataFrame:
    """One row: how many names hold a hint or end in the suffix, and the state that follows (B found, C not)."""
    low = F.lower(F.col(name))
    hit = low.rlike("|".join(hints)) | low.endswith(suffix)
    return rows.agg(F.count_if(hit).alias("n_hits"), F.count(F.lit(1)).alias("n_names")).withColumn("state", F.when(F.col("n_hits") > 0, "B").otherwise("C"))


def fingerprint(files: DataFrame) -> DataFrame:
    """sha256 over the lines path:bytes:md5 in order of their paths.

    The digest is defined over one text, so the lines (not the contents) of all
    files meet in one row; `fingerprint_tree` has no such row.
    """
    line = F.concat_ws(":", "path", F.col("bytes").cast("string"), "md5")
    rows = files.select(F.struct("path", line.alias("line")).alias("s"))
    ordered = F.transform(F.array_sort(F.collect_list("s")), lambda s: F.concat(s["line"], F.lit("\n")))
    return rows.agg(F.sha2(F.array_join(ordered, ""), 256).alias("fingerprint"), F.count(F.lit(1)).alias("n_files"))


def tree_digits(n: int, leaf: int = 1 << 16) -> int:
    """Hex digits that give buckets of about `leaf` files at most; two at least."""
    digits = 2
    while n > leaf * 16**digits:
        digits += 1
    return digits


def fingerprint_tree(files: DataFrame, digits: int = 2) -> DataFrame:
    """sha256 over the digests of buckets by the first hex digits of the md5 of a path: a bucket is a task's work, and `tree_digits` keeps it bounded."""
    line = F.concat_ws(":", "path", F.col("bytes").cast("string"), "md5")
    rows = files.select(F.substring(F.md5("path"), 1, digits).alias("bucket"), F.struct("path", line.alias("line")).alias("s"))
    lines = F.transform(F.array_sort(F.collect_list("s")), lambda s: F.concat(s["line"], F.lit("\n")))
    leaves = rows.groupBy("bucket").agg(F.sha2(F.array_join(lines, ""), 256).alias("digest"), F.count(F.lit(1)).alias("n"))
    return leaves.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("bucket", "digest"))), lambda s: s["digest"]), ""), 256).alias("fingerprint"), F.sum("n").alias("n_files"))


def last_by_key(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The row of each key with the greatest `order`."""
    return rows.withColumn("_rn", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order)))).where("_rn = 1").drop("_rn")
