"""Pooling over bags of instance vectors: mean, attention, channel gates, and heads."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as S
from .integrity import must


def checked_attention(rows: DataFrame, bag: str, attention: str, vector: str, width: int, tolerance: float = 1e-6) -> DataFrame:
    """(bag, n, total, least, most): what attention over instances adds up to; reading raises where a number is not finite, a vector has another width or the sum is not one."""
    name = F.coalesce(F.col(bag).cast("string"), F.lit("null"))
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    sound = rows.where(must(finite(F.col(attention)), F.concat(F.lit("attention is not finite in bag "), name)))
    sound = sound.where(must((F.size(vector) == width) & F.forall(vector, finite), F.concat(F.lit("a vector of another kind in bag "), name)))
    one = sound.groupBy(bag).agg(F.count(F.lit(1)).alias("n"), F.sum(attention).alias("total"), F.min(attention).alias("least"), F.max(attention).alias("most"))
    return one.where(must(F.abs(F.col("total") - 1) <= tolerance, F.concat(F.lit("attention does not add up in bag "), name))).where(must((F.col("least") >= 0) & (F.col("most") <= 1), F.concat(F.lit("attention out of range in bag "), name)))


def literal(rows: Sequence) -> Column:
    """A vector or matrix as a literal."""
    return F.array(*[literal(r) if isinstance(r, Sequence) else F.lit(float(r)) for r in rows])


def matvec(m: Column, v: Column) -> Column:
    return F.transform(m, lambda row: S.dot(row, v))


def linear_head(v: Column, w: Column, b: float) -> Column:
    return S.dot(v, w) + b


def tanh_score(v: Column, m: Column, b: Column, w: Column) -> Column:
    """w . tanh(M v + b)."""
    return S.dot(w, F.transform(F.zip_with(matvec(m, v), b, lambda x, y: x + y), F.tanh))


def channel_gates(v: Column, w1: Column, w2: Column) -> Column:
    """sigmoid(W2 relu(W1 v)): a gate for each channel."""
    hidden = F.transform(matvec(w1, v), lambda x: F.greatest(x, F.lit(0.0)))
    return F.transform(matvec(w2, hidden), S.sigmoid)


def pool_mean(rows: DataFrame, bag: str, vector: str) -> DataFrame:
    """(bag, z): means of the vectors, channel by channel; sums move, not vectors."""
    cells = rows.select(bag, F.posexplode(vector).alias("channel", "x"))
    means = cells.groupBy(bag, "channel").agg(F.avg("x").alias("m"))
    return means.groupBy(bag).agg(F.transform(F.array_sort(F.collect_list(F.struct("channel", "m"))), lambda s: s["m"]).alias("z"))


def softmax(rows: DataFrame, bag: str, score: str) -> DataFrame:
    """Adds attention: exp(score - largest) over the bag's sum of it."""
    top = rows.groupBy(bag).agg(F.max(score).alias("_top"))
    shifted = rows.join(top, bag).withColumn("_e", F.exp(F.col(score) - F.col("_top")))
    total = shifted.groupBy(bag).agg(F.sum("_e").alias("_sum"))
    return shifted.join(total, bag).withColumn("attention", F.col("_e") / F.col("_sum")).drop("_top", "_e", "_sum")


def pool_attention(rows: DataFrame, bag: str, vector: str, score: str) -> DataFrame:
    """(bag, z): sums of the vectors weighted by the softmax of their scores."""
    weighted = softmax(rows, bag, score)
    cells = weighted.select(bag, "attention", F.posexplode(vector).alias("channel", "x"))
    sums = cells.groupBy(bag, "channel").agg(F.sum(F.col("attention") * F.col("x")).alias("m"))
    return sums.groupBy(bag).agg(F.transform(F.array_sort(F.collect_list(F.struct("channel", "m"))), lambda s: s["m"]).alias("z"))
