"""Groups of any size as chunks of bounded size, with what must hold of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .integrity import must
from .order import OrderIndex, meet


def chunked(rows: DataFrame, group: list[str], order: list[str], size: int, columns: list[str]) -> DataFrame:
    """(group, chunk, first, n, and the columns as arrays): the rows of a group in order, `size` in each chunk; first is the place of the chunk's first row.

    A row finds its place by an index of counts, so no task and no array holds more
    of a group than a range or a chunk.
    """
    placed = OrderIndex(rows.select(*group, *dict.fromkeys([*order, *columns])), group, order).places()
    at = placed.withColumn("chunk", F.floor(F.col("place") / size))
    out = at.groupBy(*group, "chunk").agg(F.array_sort(F.collect_list(F.struct("place", *columns))).alias("_rows"))
    return out.select(*group, "chunk", (F.col("chunk") * size).alias("first"), F.size("_rows").alias("n"), *[F.col(f"_rows.{c}").alias(c) for c in columns])


def bag_chunks(grouped: DataFrame, size: int, guards: tuple[str, ...] = ("label", "key", "original")) -> DataFrame:
    """(source_group_id, bag_id, bag_label, chunk, first, n, path, md5): bags of files in chunks.

    Reading raises where a group's id has another form, and by the guards asked where
    a group holds two labels, two source keys or two originals (files without a chain, by digest).
    """
    alone = lambda c: F.coalesce(F.min(c).eqNullSafe(F.max(c)), F.lit(True))
    one = grouped.groupBy("source_group_id").agg(F.min("class_dir").alias("bag_label"), alone("class_dir").alias("label"), alone("source_key").alias("key"), alone(F.when(F.size("chain") == 0, F.col("md5"))).alias("original"))
    says = lambda text: F.concat(F.lit(text), F.coalesce("source_group_id", F.lit("null")))
    sound = one.where(must(F.startswith("source_group_id", F.lit("grp-")), says("no group id: ")))
    for guard in guards:
        sound = sound.where(must(F.col(guard), says(f"more than one {guard} in ")))
    named = sound.select("source_group_id", F.concat(F.lit("bag-"), F.substring("source_group_id", 5, 12)).alias("bag_id"), "bag_label")
    return meet(chunked(grouped, ["source_group_id"], ["path"], size, ["path", "md5"]), named, ["source_group_id"])


def collated(bags: DataFrame, bag: str, values: str, width: int, slots: int) -> DataFrame:
    """(bag, slot_chunk, padded, mask): each bag's vectors in chunks of `slots`, the last filled up with zero vectors; mask is true for its own.

    A vector of another width raises, and so does a batch without any row.
    """
    if bags.isEmpty():
        raise ValueError("an empty batch has no shape")
    shaped = bags.where(must(F.size(values) == width, F.concat(F.lit("another shape in bag "), F.coalesce(F.col(bag).cast("string"), F.lit("null")))))
    key = [c for c in bags.columns if c not in (bag, values)]
    out = chunked(shaped, [bag], key, slots, [values])
    missing = F.lit(slots) - F.col("n")
    zero = F.array_repeat(F.lit(0.0), width)
    mask = F.concat(F.array_repeat(F.lit(True), F.col("n")), F.array_repeat(F.lit(False), missing))
    return out.select(bag, F.col("chunk").alias("slot_chunk"), F.concat(values, F.array_repeat(zero, missing)).alias("padded"), mask.alias("mask"))


def masked_sums(padded: DataFrame, bag: str) -> DataFrame:
    """(bag, channel, n, total) over the own slots of every chunk."""
    slots = padded.select(bag, F.explode(F.arrays_zip("padded", "mask")).alias("s")).where("s.mask")
    return slots.select(bag, F.posexplode("s.padded").alias("channel", "x")).groupBy(bag, "channel").agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("total"))


def digest(values: Column) -> Column:
    """16 digits over the texts of an array, in its order."""
    return F.substring(F.md5(F.array_join(values, "|")), 1, 16)
