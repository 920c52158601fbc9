"""Array kernels: training statistics, quantising, quality figures, padding, flips, samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as S


def train_stats(rows: DataFrame, values: str) -> DataFrame:
    """One row over all values of all rows, in one pass: count, mean, population standard deviation, least, most.

    Spark merges means and squared distances from them, so that large means do not cancel.
    """
    x = F.col("x")
    return rows.select(F.explode(values).alias("x")).agg(F.count("x").alias("n"), F.round(F.avg(x), 6).alias("mean"), F.round(F.stddev_pop(x), 6).alias("std"), F.min(x).alias("least"), F.max(x).alias("most"))


def quantize(values: Column, mean: float, std: float, offset: float = 8.0, scale: float = 4096.0) -> Column:
    """16-bit codes of normalised values, rounded half to even; a code out of range raises."""

    def code(x: Column) -> Column:
        q = F.rint(((x - mean) / std + offset) * scale)
        return F.when((q >= 0) & (q <= 65535), q.cast("int")).otherwise(F.raise_error(F.lit("quantization overflow")).cast("int"))

    return F.transform(values, code)


def dequantize(codes: Column, offset: float = 8.0, scale: float = 4096.0) -> Column:
    return F.transform(codes, lambda q: q / scale - offset)


def quality(values: Column) -> list[Column]:
    """Least, most, mean, standard deviation, and flags for blank and clipped arrays."""
    n = F.size(values).cast("double")
    mean = S.total(values) / n
    # The mean is bound once, and the squares are of distances from it.
    apart = F.transform(F.array(F.struct(values.alias("v"), mean.alias("m"))), lambda s: F.aggregate(s["v"], F.lit(0.0), lambda t, x: t + (x - s["m"]) * (x - s["m"])))
    std = F.sqrt(F.get(apart, F.lit(0)) / n)
    low, high = F.array_min(values), F.array_max(values)
    return [low.alias("qa_min"), high.alias("qa_max"), F.round(mean, 6).alias("qa_mean"), F.round(std, 6).alias("qa_std"), (low == high).alias("blank"), ((low <= 0) | (high >= 255)).alias("clipped")]


def padded(values: Column, longest: Column, filler: Column | None = None) -> list[Column]:
    """The array filled up with zeros (or `filler`, as a vector of zeros), and the mask of what is its own."""
    missing = longest - F.size(values)
    pad = F.concat(values, F.array_repeat(F.lit(0.0) if filler is None else filler, missing))
    return [pad.alias("padded"), F.concat(F.array_repeat(F.lit(True), F.size(values)), F.array_repeat(F.lit(False), missing)).alias("mask")]


def flip(values: Column, key: Column, split: Column, seed: int) -> Column:
    """Rows of training data reversed for about half of the keys, by a hash of key and seed; rows of other splits stay as they are."""
    coin = F.substring(F.md5(F.concat_ws(":", key.cast("string"), F.lit(str(seed)))), 1, 1) < F.lit("8")
    return F.when((split == "train") & coin, F.reverse(values)).otherwise(values)


def hashed_sample(rows: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n rows in the order of a hash of key and seed."""
    return rows.orderBy(F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed)))), key).limit(n)
