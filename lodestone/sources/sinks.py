"""Writers: ordered CSV, one folder a split with digests, summaries as JSON."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_csv(rows: DataFrame, path: str, order: list[str], single: bool = False) -> None:
    """CSV in the order of `order` with plain line ends; part files follow the order, or one file if asked (small tables)."""
    ordered = rows.orderBy(*order)
    (ordered.coalesce(1) if single else ordered).write.option("header", True).option("lineSep", "\n").option("emptyValue", "").mode("overwrite").csv(path)


def write_splits(rows: DataFrame, path: str, key: str, split: str = "split") -> dict[str, str]:
    """Parquet with a folder for each split, and the digest of each split's rows in the order of `key`."""
    rows.repartition(split, F.pmod(F.xxhash64(key), F.lit(64))).sortWithinPartitions(key).write.partitionBy(split).mode("overwrite").parquet(path)
    return digests(rows.sparkSession.read.parquet(path), key, split)


def digests(rows: DataFrame, key: str, split: str = "split") -> dict[str, str]:
    """sha256 for each split over digests of buckets of rows: the same rows give the same digest in any order."""
    names = sorted(c for c in rows.columns if c != split)
    line = F.sha2(F.to_json(F.struct(*names)), 256)
    leaves = rows.select(split, F.substring(line, 1, 2).alias("b"), line.alias("line")).groupBy(split, "b").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("line")), ""), 256).alias("d"))
    tops = leaves.groupBy(split).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat("b", "d"))), ""), 256).alias("d"))
    return {str(r[split]): r["d"] for r in tops.collect()}


def summary(rows: DataFrame, columns: list[str]) -> str:
    """Counts of the values of some columns, as one JSON text."""
    pairs = F.explode(F.array(*[F.struct(F.lit(json.dumps(c)).alias("c"), F.coalesce(F.col(c).cast("string"), F.lit("null")).alias("v")) for c in columns]))
    counts = rows.select(pairs.alias("p")).groupBy("p.c", "p.v").agg(F.count(F.lit(1)).alias("n"))
    one = counts.groupBy("c").agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("v", "n"))))).alias("m"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("c", "m"))), lambda s: F.concat(s["c"], F.lit(":"), s["m"]))
    return one.agg(F.concat(F.lit("{"), F.array_join(parts, ","), F.lit("}"))).first()[0]
