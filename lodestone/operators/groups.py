"""Groups of files, bags of instances, allocation to splits, leakage checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as S
from .graph import components, star_edges
from .integrity import must
from .order import OrderIndex

SPLITS = ("train", "val", "test")
SHARES = {"train": 0.70, "val": 0.15, "test": 0.15}


def identity_groups(files: DataFrame, node: str = "path") -> DataFrame:
    """Adds source_group_id: files of one class joined by source key or md5, through any number of files.

    The class is part of both keys, so that a group never crosses it.  Files
    without company are groups of their own.
    """
    edges = star_edges(files, ["source_key", "class_dir"], node).union(star_edges(files, ["md5", "class_dir"], node))
    roots = components(edges).toDF(node, "_root")
    rows = files.join(roots, node, "left").withColumn("_root", F.coalesce("_root", node))
    names = rows.groupBy("_root").agg(S.content_id("grp-", F.collect_list("md5")).alias("source_group_id"))
    return rows.join(names, "_root").drop("_root")


def label_conflicts(files: DataFrame, key: str) -> DataFrame:
    """Keys that hold files of more than one class."""
    return files.where(F.col(key).isNotNull()).groupBy(key).agg(F.countDistinct("class_dir").alias("n_classes"), F.count(F.lit(1)).alias("n_files")).where("n_classes > 1")


def merge_edges(files: DataFrame, groups: DataFrame) -> DataFrame:
    """One row: merges by name, by md5, those that joined nothing new, and pairs of a key that the class kept apart."""
    full = files.where("source_key IS NOT NULL")
    tied = lambda rows, keys: rows.groupBy(*keys).agg((F.count(F.lit(1)) - 1).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    by_name, by_md5 = tied(full, ["source_key", "class_dir"]), tied(files, ["md5", "class_dir"])
    spanning = groups.agg((F.count(F.lit(1)) - F.countDistinct("source_group_id")).alias("n"))
    blocked = full.groupBy("source_key").agg((F.countDistinct("class_dir") - 1).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    parts = [x.select(F.lit(1).alias("_one"), F.col("n").alias(c)) for x, c in ((by_name, "filename_edges"), (by_md5, "md5_edges"), (spanning, "spanning_edges"), (blocked, "blocked_by_class"))]
    out = parts[0]
    for x in parts[1:]:  # one row each
        out = out.join(x, "_one")
    return out.withColumn("redundant_edges", F.col("filename_edges") + F.col("md5_edges") - F.col("spanning_edges")).drop("_one")


def roles(grouped: DataFrame, side: int = 227) -> DataFrame:
    """Adds role, role_confidence and role_rule from chain and size, within the group."""
    square = (F.col("width") == side) & (F.col("height") == side)
    sized = grouped.where(square).select("source_group_id", F.lit(True).alias("_sized")).distinct()
    rows = grouped.join(sized, "source_group_id", "left")
    varied = F.coalesce(F.size("chain"), F.lit(0)) > 0
    return rows.withColumns(
        {
            # The names of roles, confidences and rules.
            "role": F.when(varied, "augmented_variant").otherwise("original_candidate"),
            "role_confidence": F.when(varied, "high").when(square & F.col("_sized"), "high").otherwise("medium"),
            "role_rule": F.when(varied, "filename_chain_explicit").when(square, f"chain_free+base_dimension_{side}x{side}").otherwise("chain_free_only(off_base_dimension)"),
        }
    ).drop("_sized")


def group_confidence(grouped: DataFrame) -> DataFrame:
    """(source_group_id, level, lineage, exact): what the group rests on."""
    copies = grouped.groupBy("md5").agg((F.count(F.lit(1)) > 1).alias("_copied"))
    rows = grouped.join(copies, "md5").groupBy("source_group_id").agg(F.bool_or(F.col("source_key").isNotNull()).alias("lineage"), F.bool_or("_copied").alias("exact"))
    return rows.withColumn("level", F.when(F.col("lineage"), "high").when(F.col("exact"), "medium").otherwise("low"))


def bags(grouped: DataFrame) -> DataFrame:
    """One row a group: bag_id, label, instances in order of their paths, keys, splits; a group id of another form raises.

    The instances of a group stand in one array; `chunks.bag_chunks` has them in bounded ones.
    """
    named = grouped.where(must(F.startswith("source_group_id", F.lit("grp-")), F.concat(F.lit("no group id: "), F.coalesce("source_group_id", F.lit("null")))))
    return named.groupBy("source_group_id").agg(
        F.concat(F.lit("bag-"), F.substring("source_group_id", 5, 12)).alias("bag_id"), F.min("class_dir").alias("bag_label"), F.countDistinct("class_dir").alias("n_labels"),
        F.count(F.lit(1)).alias("instance_count"), F.array_sort(F.collect_list(F.struct("path", "md5"))).alias("instances"), F.countDistinct("source_key").alias("n_keys"),
        F.array_sort(F.collect_set("split")).alias("splits"), F.min(F.when(F.size("chain") == 0, F.col("path"))).alias("original_candidate_path"),
    )


def size_stats(rows: DataFrame, by: str, n: str, *more: Column) -> DataFrame:
    """For each value of `by` other aggregates, and smallest, largest, mean, median and sum of the sizes `n`; the exact median comes from an index of counts."""
    index = OrderIndex(rows, [by], [n])
    stats = index.rows.groupBy(by).agg(*more, F.min(n).alias("least"), F.max(n).alias("most"), F.round(F.avg(n), 4).alias("mean"), F.sum(n).alias("instances"))
    medians = index.medians(n).withColumnRenamed(by, "_by")
    return stats.join(medians, F.col(by).eqNullSafe(F.col("_by"))).drop("_by")


def coverage(files: DataFrame, bag_rows: DataFrame) -> DataFrame:
    """One row of counts that must be 0: files in no bag, instances without a file, paths in two bags, other digests."""
    inst = bag_rows.select("bag_id", F.explode("instances").alias("i")).select("bag_id", F.col("i.path").alias("path"), F.col("i.md5").alias("bag_md5"))
    both = files.select("path", "md5", F.lit(1).alias("f")).join(inst, "path", "full_outer")
    one = both.groupBy("path").agg(F.countDistinct("bag_id").alias("n_bags"), F.bool_or(F.col("f").isNull()).alias("no_file"), F.bool_or(F.col("bag_id").isNull()).alias("no_bag"), F.bool_or(F.col("md5") != F.col("bag_md5")).alias("other"))
    return one.agg(F.count_if("no_bag").alias("files_without_bag"), F.count_if("no_file").alias("instances_without_file"), F.count_if(F.col("n_bags") > 1).alias("paths_in_two_bags"), F.count_if("other").alias("digest_mismatches"))


def allocation_units(bag_rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """Units of bags that near-duplicate pairs (a, b: paths) tie together: unit_id, bag_ids, counts by class."""
    inst = bag_rows.select("bag_id", F.explode("instances.path").alias("path"))
    edges = pairs.join(inst.toDF("ba", "a"), "a").join(inst.toDF("bb", "b"), "b").select(F.col("ba").alias("a"), F.col("bb").alias("b"))
    rows = bag_rows.join(components(edges).toDF("bag_id", "_root"), "bag_id", "left").withColumn("_root", F.coalesce("_root", "bag_id"))
    units = rows.groupBy("_root").agg(
        F.array_sort(F.collect_list("bag_id")).alias("bag_ids"), F.sum("instance_count").alias("instance_count"),
        F.sum(F.when(F.col("bag_label") == "benign", F.col("instance_count")).otherwise(0)).alias("benign"), F.sum(F.when(F.col("bag_label") == "malignant", F.col("instance_count")).otherwise(0)).alias("malignant"),
    )
    return units.select(F.concat(F.lit("unit-"), F.substring(F.sha2(F.array_join("bag_ids", ","), 256), 1, 12)).alias("unit_id"), "bag_ids", "instance_count", "benign", "malignant")


def allocate(units: DataFrame) -> DataFrame:
    """(unit_id, split): largest unit first, to the split whose worst class is filled least, ties to train, val, test.

    Every choice depends on all before it, so one task takes the units (one for each
    component of bags, not their instances) in order; it sorts them with spill and
    streams over them with six sums in hand.
    """
    classes = ("benign", "malignant")
    ordered = units.select("unit_id", F.element_at("bag_ids", 1).alias("bag"), "instance_count", *classes)
    sums = ordered.agg(*[F.sum(c).cast("double").alias(c) for c in classes]).first()
    total = {c: max(sums[c] or 0.0, 1e-9) for c in classes}

    def run(batches):
        fill = {s: [0.0, 0.0] for s in SPLITS}
        room = {s: [total[c] * SHARES[s] for c in classes] for s in SPLITS}
        for pdf in batches:
            out = []
            for own in zip(pdf["benign"].tolist(), pdf["malignant"].tolist()):
                best, least = None, None
                for s in SPLITS:
                    gap = max((f + u) / r for f, u, r in zip(fill[s], own, room[s]))
                    if best is None or gap < least - 1e-12:
                        best, least = s, gap
                fill[best] = [f + u for f, u in zip(fill[best], own)]
                out.append(best)
            yield pdf[["unit_id"]].assign(split=out)

    return ordered.repartition(1).sortWithinPartitions(F.desc("instance_count"), "bag", "unit_id").mapInPandas(run, "unit_id string, split string")


def split_manifest(bag_rows: DataFrame, units: DataFrame, allocated: DataFrame) -> DataFrame:
    """One row an instance: split, unit, bag, group, label, path, md5."""
    by_bag = units.join(allocated, "unit_id").select("unit_id", "split", F.explode("bag_ids").alias("bag_id"))
    return bag_rows.select("bag_id", "source_group_id", "bag_label", F.explode("instances").alias("i")).join(by_bag, "bag_id").select("split", "unit_id", "bag_id", "source_group_id", "bag_label", F.col("i.path").alias("image_path"), F.col("i.md5").alias("md5"))


def spread(rows: DataFrame, key: str) -> DataFrame:
    """One row: how many values of `key` stand in more than one split."""
    return rows.groupBy(key).agg((F.countDistinct("split") > 1).alias("x")).agg(F.count_if("x").alias("n_leaks"), F.count(F.lit(1)).alias("n_keys"))


def pair_leaks(pairs: DataFrame, split_rows: DataFrame, strict: bool = True) -> DataFrame:
    """One row: pairs (a, b: paths) whose ends are in different splits; an end without a split raises, or is counted if not `strict`."""
    s = split_rows.select("image_path", "split")
    both = pairs.join(s.toDF("a", "sa"), "a", "left").join(s.toDF("b", "sb"), "b", "left")
    if strict:
        both = both.where(must(F.col("sa").isNotNull() & F.col("sb").isNotNull(), F.concat(F.lit("no split for an end of "), "a", F.lit(", "), "b")))
    return both.agg(F.count_if(F.col("sa") != F.col("sb")).alias("n_leaks"), F.count_if(F.col("sa").isNull() | F.col("sb").isNull()).alias("n_unmapped"), F.count(F.lit(1)).alias("n_pairs"))


def leak_counts(counts: DataFrame, strict: bool = True) -> DataFrame:
    """The row of `pair_leaks` from counted pairs (same: both ends in one split, null where an end has none; n)."""
    n = lambda when: F.coalesce(F.sum(F.when(when, F.col("n"))), F.lit(0)).alias
    row = counts.agg(n(~F.col("same"))("n_leaks"), n(F.col("same").isNull())("n_unmapped"), n(F.lit(True))("n_pairs"))
    return row.where(must(F.col("n_unmapped") == 0, "no split for an end of a pair")) if strict else row
