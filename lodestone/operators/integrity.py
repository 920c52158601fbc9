"""Joins that raise where a key dangles, invariants by name, drift and content keys, and clusters by content only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .explain import offsets
from .graph import components, star_edges


def must(ok: Column, message: Column | str) -> Column:
    """True where `ok` holds; an error with the message elsewhere, null included."""
    text = F.lit(message) if isinstance(message, str) else message
    return F.when(F.coalesce(ok, F.lit(False)), True).otherwise(F.raise_error(text).cast("boolean"))


def unique_by(rows: DataFrame, key: str) -> DataFrame:
    """`rows`; reading them raises if two share a key."""
    n = F.count(F.lit(1)).over(Window.partitionBy(key))
    return rows.withColumn("_n", n).where(must(F.col("_n") == 1, F.concat(F.lit(f"two rows of {key} "), F.col(key).cast("string")))).drop("_n")


def lookup(rows: DataFrame, key: str, known: DataFrame, other: str) -> DataFrame:
    """`rows` with the columns of `known`, whose key `other` is unique; a row without a partner raises."""
    found = rows.join(unique_by(known, other).withColumn("_found", F.lit(True)), F.col(key) == F.col(other), "left")
    return found.where(must(F.col("_found"), F.concat(F.lit(f"no {other} for {key} "), F.coalesce(F.col(key).cast("string"), F.lit("null"))))).drop("_found")


def pairs_to_bags(pairs: DataFrame, bag_of: DataFrame) -> DataFrame:
    """(a, b, bag_a, bag_b) of pairs of paths by rows (path, bag_id); a path in two bags or in none raises."""
    out = pairs.select("a", "b")
    for side in ("a", "b"):
        names = bag_of.select(F.col("path").alias(f"_p{side}"), F.col("bag_id").alias(f"bag_{side}"))
        out = lookup(out, side, names, f"_p{side}").drop(f"_p{side}")
    return out


def validated_instances(splits: DataFrame, files: DataFrame, bags: DataFrame) -> DataFrame:
    """Split rows with their file and their bag: paths are one to one, md5 and label agree, every id is known; else it raises.

    splits: (split, bag_id, image_path, md5, bag_label), files: (path, md5, width, height), bags: (bag_id, bag_label, instance_count).
    """
    f = files.select(F.col("path").alias("_path"), F.col("md5").alias("_md5"), "width", "height")
    b = bags.select(F.col("bag_id").alias("_bag"), F.col("bag_label").alias("_label"), "instance_count")
    rows = lookup(lookup(unique_by(splits, "image_path"), "image_path", f, "_path"), "bag_id", b, "_bag")
    rows = rows.where(must(F.col("md5") == F.col("_md5"), F.concat(F.lit("other content in "), "image_path")))
    rows = rows.where(must(F.col("bag_label") == F.col("_label"), F.concat(F.lit("other label in bag "), "bag_id")))
    return rows.select("split", "bag_id", "image_path", "md5", "bag_label", "width", "height", "instance_count")


def violations(checks: dict[str, tuple[DataFrame, Column]]) -> DataFrame:
    """(invariant, n): for each name the rows of its table that meet its condition; all 0 in a sound collection.

    The checks of one table are counted in one aggregation, so each table is read once.
    """
    tables: dict[int, tuple[DataFrame, dict[str, Column]]] = {}
    for name, (rows, broken) in checks.items():
        tables.setdefault(id(rows), (rows, {}))[1][name] = broken
    out = None
    for rows, named in tables.values():
        counts = rows.agg(*[F.count_if(F.coalesce(broken, F.lit(True))).alias(f"_{k}") for k, broken in enumerate(named.values())])
        each = F.explode(F.array(*[F.struct(F.lit(name).alias("invariant"), F.col(f"_{k}").alias("n")) for k, name in enumerate(named)]))
        part = counts.select(each.alias("r")).select("r.*")
        out = part if out is None else out.unionAll(part)
    return out


def placements(files: DataFrame, bag_of: DataFrame, splits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What files (path, md5), bags (bag_id, source_group_id, bag_label, instance_count) and split rows (image_path, md5, bag_id, source_group_id, bag_label, split) say of each path and of each bag, one row each.

    By path: n_files, n_rows, n_md5, n_splits, n_bags.  By bag: n_bags, listed, n_rows, n_splits, n_labels, n_groups.
    """
    text = lambda: F.lit(None).cast("string")
    paths = files.select("path", "md5", F.lit(1).alias("file"), text().alias("bag"), text().alias("split")).unionByName(splits.select(F.col("image_path").alias("path"), "md5", F.lit(0).alias("file"), F.col("bag_id").alias("bag"), "split"))
    by_path = paths.groupBy("path").agg(F.sum("file").alias("n_files"), F.sum(1 - F.col("file")).alias("n_rows"), F.countDistinct("md5").alias("n_md5"), F.countDistinct("split").alias("n_splits"), F.countDistinct("bag").alias("n_bags"))
    bags = bag_of.select("bag_id", "source_group_id", "bag_label", F.col("instance_count").alias("listed"), F.lit(1).alias("bag"), text().alias("split")).unionByName(splits.select("bag_id", "source_group_id", "bag_label", F.lit(0).cast("bigint").alias("listed"), F.lit(0).alias("bag"), "split"))
    by_bag = bags.groupBy("bag_id").agg(F.sum("bag").alias("n_bags"), F.sum("listed").alias("listed"), F.sum(1 - F.col("bag")).alias("n_rows"), F.countDistinct("split").alias("n_splits"), F.countDistinct("bag_label").alias("n_labels"), F.countDistinct("source_group_id").alias("n_groups"))
    return by_path, by_bag


def assert_none(counted: DataFrame) -> DataFrame:
    """The rows of `violations`; reading them raises at the first broken invariant."""
    return counted.where(must(F.col("n") == 0, F.concat(F.lit("broken invariant: "), "invariant")))


def cache_name(path: Column) -> Column:
    """A flat file name for a path."""
    return F.concat(F.replace(path, F.lit("/"), F.lit("__")), F.lit(".png"))


def rows_in_order(rows: DataFrame, bag: str, order: str) -> DataFrame:
    """Adds instance_index, the place in the bag, and row_index, the place in all rows by bag and order, both from 0.

    Bags get their starts from sums over ranges of bags, so no task counts all rows.
    """
    sizes = rows.groupBy(bag).agg(F.count(F.lit(1)).alias("_size"))
    starts = offsets(sizes, bag, "_size").select(bag, F.col("begin").alias("_begin"))
    at = F.row_number().over(Window.partitionBy(bag).orderBy(order)) - 1
    out = rows.withColumn("instance_index", at).join(starts, bag)
    return out.withColumn("row_index", F.col("_begin") + F.col("instance_index")).drop("_begin")


def drift(found: DataFrame, frozen: dict[str, float], tolerance: float = 1e-6) -> DataFrame:
    """(statistic, found, frozen, ok) of a row of statistics against frozen values."""
    row = F.explode(F.array(*[F.struct(F.lit(k).alias("statistic"), F.col(k).cast("double").alias("found"), F.lit(float(v)).alias("frozen")) for k, v in frozen.items()]))
    rows = found.select(row.alias("r")).select("r.*")
    return rows.withColumn("ok", F.coalesce(F.abs(F.col("found") - F.col("frozen")) <= tolerance, F.lit(False)))


def drift_guard(found: DataFrame, frozen: dict[str, float], tolerance: float = 1e-6) -> DataFrame:
    """The rows of `drift`; reading them raises where a statistic has moved."""
    return drift(found, frozen, tolerance).where(must(F.col("ok"), F.concat(F.lit("drift of "), "statistic")))


def content_clusters(files: DataFrame, bucket: list[str]) -> DataFrame:
    """(path, root): files (path, md5, hash) that equal md5s or hashes up to one bit apart tie together inside a bucket.

    Equal values make stars; distinct hashes meet those one bit away by 64 flipped
    copies of each, of which one side is enough.
    """
    stars = star_edges(files, [*bucket, "md5"], "path").union(star_edges(files, [*bucket, "hash"], "path"))
    heads = files.where("hash IS NOT NULL").groupBy(*bucket, "hash").agg(F.min("path").alias("head"))
    flips = F.explode(F.array(*[F.lit(1 << k if k < 63 else -(1 << 63)) for k in range(64)]))
    near = heads.select(*bucket, F.col("head").alias("a"), F.col("hash").alias("_h"), flips.alias("_flip")).select(*bucket, "a", F.col("_h").bitwiseXOR(F.col("_flip")).alias("hash"))
    edges = stars.union(near.join(heads, [*bucket, "hash"]).select("a", F.col("head").alias("b")))
    return files.select("path").join(components(edges).withColumnRenamed("node", "path"), "path", "left").select("path", F.coalesce("root", "path").alias("root"))


def best_pairs(pairs: DataFrame) -> DataFrame:
    """Of the pairs (ka, kb: keys, hamming, a, b; n of which (a, b) is the least) of two keys, in either order, the least by hamming, a and b."""
    low, high = F.least("ka", "kb").alias("key_a"), F.greatest("ka", "kb").alias("key_b")
    return pairs.groupBy(low, high).agg(F.min(F.struct("hamming", "a", "b")).alias("m"), F.sum("n").alias("n_pairs")).select("key_a", "key_b", "m.hamming", "m.a", "m.b", "n_pairs")


def near_dup_summary(counts: DataFrame, roots: DataFrame, group_of: DataFrame) -> DataFrame:
    """One row: pairs (counts: hamming, n), groups and files in them, groups over several values of the column `group`."""
    by = roots.join(group_of, "node").groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("group").alias("g"))
    sums = by.agg(F.count(F.lit(1)).alias("n_groups"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_files"), F.count_if(F.col("g") > 1).alias("n_cross"), F.max("n").alias("largest"))
    return counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_pairs"), F.min("hamming").alias("least"), F.max("hamming").alias("most")).crossJoin(F.broadcast(sums))  # one row each


def hex_key(*parts: Column) -> Column:
    """16 hex digits over parts that say what is cached and how."""
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 16)
