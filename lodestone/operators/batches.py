"""Seeded orders without a sort: a keyed bijection of row numbers, batches by it, samples by hash."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .order import OrderIndex

#: Rounds of the bijection; each halves what is left of the old order.
ROUNDS = 32


def round_keys(seed: int, rounds: int = ROUNDS) -> list[int]:
    """A key for each round: the first 60 bits of the md5 of `seed:round`."""
    return [int(hashlib.md5(f"{seed}:{r}".encode()).hexdigest()[:15], 16) for r in range(rounds)]


def permuted(place: Column, n: Column, seed: int, rounds: int = ROUNDS) -> Column:
    """Where a place of 0 to n - 1 goes in the order of a seed, by itself: a bijection of these numbers for any n.

    Every round pairs x with (key - x) mod n and swaps the pair or not, by one bit of a
    hash of the larger of the two, which both ends of a pair agree on.
    """
    keys = F.array(*[F.struct(F.lit(k).cast("bigint").alias("k"), F.lit(str(r)).alias("r")) for r, k in enumerate(round_keys(seed, rounds))])

    def swap(x: Column, key: Column) -> Column:
        other = F.pmod(key["k"] - x, n)
        coin = F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), key["r"], F.greatest(x, other).cast("string"))), 1, 1)
        return F.when(coin < "8", x).otherwise(other)

    return F.aggregate(keys, place.cast("bigint"), swap)


def numbered_batches(rows: DataFrame, order: list[str], size: int, seed: int) -> DataFrame:
    """Rows with row_index (their place in `order`), permuted, batch, slot, and flip (a coin for each place)."""
    placed = OrderIndex(rows.withColumn("_all", F.lit(0)), ["_all"], order)
    counted = placed.places().join(F.broadcast(placed.totals().withColumnRenamed("_all", "_one")), F.col("_all") == F.col("_one"))  # one row
    coin = F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit("flip"), F.col("place").cast("string"))), 1, 1) < "8"
    out = counted.withColumn("permuted", permuted(F.col("place"), F.col("total"), seed))
    return out.select(*rows.columns, F.col("place").alias("row_index"), "permuted", F.floor(F.col("permuted") / size).alias("batch"), (F.col("permuted") % size).alias("slot"), coin.alias("flip"))


def stacked(batches: DataFrame, columns: list[str]) -> DataFrame:
    """(batch, n, and the columns as arrays in the order of the slots): a batch is as large as it was asked."""
    rows = batches.groupBy("batch").agg(F.array_sort(F.collect_list(F.struct("slot", *columns))).alias("_rows"))
    return rows.select("batch", F.size("_rows").alias("n"), *[F.col(f"_rows.{c}").alias(c) for c in columns])


def seeded_sample(bags: DataFrame, bag: str, size: str, n: int, seed: int) -> DataFrame:
    """n bags by a hash of id and seed; if the smallest bag (then least id) is not among them it takes the place of the least id.

    Fewer bags than asked raise.
    """
    ids = bags.select(F.col(bag).alias("id"), F.col(size).alias("size"))
    if (have := ids.count()) < n:
        raise ValueError(f"{n} bags asked of {have}")
    drawn = ids.orderBy(F.md5(F.concat_ws(":", F.col("id").cast("string"), F.lit(str(seed)))), "id").limit(n).select("id", F.lit(1).alias("drawn"), F.lit(0).alias("small"))
    small = ids.agg(F.min(F.struct("size", "id")).alias("m")).select("m.id", F.lit(0).alias("drawn"), F.lit(1).alias("small"))
    # n + 1 rows at most from here.
    both = drawn.union(small).groupBy("id").agg(F.max("drawn").alias("drawn"), F.max("small").alias("small"))
    every = Window.partitionBy(F.lit(0))
    known = F.max(F.col("drawn") * F.col("small")).over(every) == 1
    least = F.min(F.when(F.col("drawn") == 1, F.col("id"))).over(every)
    kept = both.withColumns({"known": known, "least": least}).where((F.col("small") == 1) | F.col("known") | (F.col("id") != F.col("least")))
    return kept.select(F.col("id").alias(bag))
