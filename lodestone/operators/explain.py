"""Ranking of instances, evidence, case selection, decision records, ordered logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar as S

# Labels of the decision record.
POSITIVE, NEGATIVE = "Malignant model prediction", "Benign model prediction"
BORDERLINE, CLEAR = "borderline (within uncertainty margin)", "high"
MARGIN = 0.1


def ranked(rows: DataFrame, bag: str, weight: str, position: str) -> DataFrame:
    """Adds rank: from 1, largest weight first, ties by position."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(bag).orderBy(F.desc(weight), position)))


def top_k(rows: DataFrame, bag: str, weight: str, position: str, k: int) -> DataFrame:
    """The k first ranks of each bag; k below 1 raises, more than there are gives all."""
    if k <= 0:
        raise ValueError("k must be positive")
    return ranked(rows, bag, weight, position).where(F.col("rank") <= k)


def representative_cases(rows: DataFrame, key: str, n_uncertain: int = 2) -> DataFrame:
    """(key, category): the first key of each outcome and the first uncertain ones; an earlier category takes a key.

    Every category is a minimum or a short list by itself, so that no task sees
    all rows of one.
    """
    outcome = {"tn": (0, "correct_benign"), "tp": (1, "correct_malignant"), "fp": (2, "false_positive"), "fn": (3, "false_negative")}
    first = rows.groupBy("outcome").agg(F.min(key).alias(key))
    names = F.create_map(*[F.lit(x) for k, v in outcome.items() for x in (k, v[1])])
    order = F.create_map(*[F.lit(x) for k, v in outcome.items() for x in (k, v[0])])
    picked = first.select(key, names[F.col("outcome")].alias("category"), order[F.col("outcome")].alias("priority"))
    near = rows.where(S.is_uncertain(F.col("probability"), MARGIN, 0.0)).orderBy(key).limit(n_uncertain).select(key, F.lit("uncertain").alias("category"), F.lit(4).alias("priority"))
    return picked.union(near).groupBy(key).agg(F.min(F.struct("priority", "category")).alias("c")).select(key, "c.category")


def decision_record(score: Column, evidence: Column, provenance: Column) -> Column:
    """The nested record of one bag; `evidence` may be empty."""
    unsure = S.is_uncertain(score, MARGIN)
    return F.struct(
        F.when(score >= 0.5, POSITIVE).otherwise(NEGATIVE).alias("prediction"), score.alias("model_score"), F.when(unsure, BORDERLINE).otherwise(CLEAR).alias("prediction_confidence"),
        unsure.alias("uncertainty_flag"), F.lit(MARGIN).alias("uncertainty_margin"), evidence.alias("top_k_evidence"), (F.size(evidence) > 0).alias("attention_available"), provenance.alias("provenance"),
    )


def early_stopping(log: DataFrame, epoch: str, metric: str, patience: int) -> DataFrame:
    """Adds improved (strictly above all before), best_epoch so far, and stopped (the gap has reached `patience`).

    A log has a row an epoch: it is the model's, not the data's, and is ordered in one task.
    """
    w = Window.orderBy(epoch)
    rows = log.withColumn("_best", F.max(metric).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    rows = rows.withColumn("improved", F.col("_best").isNull() | (F.col(metric) > F.col("_best")))
    rows = rows.withColumn("best_epoch", F.max(F.when(F.col("improved"), F.col(epoch))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.withColumn("stopped", F.col(epoch) - F.col("best_epoch") >= patience).drop("_best")


def offsets(sizes: DataFrame, key: str, size: str, ranges: int = 256) -> DataFrame:
    """Adds begin and end of each key's slice in the order of the keys.

    Keys are cut into ranges by quantiles and the ranges' sums give each its
    start, so that no task sums over all keys.
    """
    bounds = sorted(set(sizes.approxQuantile(key, [k / ranges for k in range(1, ranges)], 0.001)))
    cuts = F.size(F.filter(F.array(*[F.lit(int(b)) for b in bounds]).cast("array<bigint>"), lambda b: b <= F.col(key)))
    rows = sizes.withColumn("_cut", cuts)
    starts = rows.groupBy("_cut").agg(F.sum(size).alias("_n"))  # `ranges` rows at most
    starts = starts.select("_cut", F.coalesce(F.sum("_n").over(Window.orderBy("_cut").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"))
    w = Window.partitionBy("_cut").orderBy(key).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.join(starts, "_cut").withColumn("end", F.col("_start") + F.sum(size).over(w))
    return rows.withColumn("begin", F.col("end") - F.col(size)).drop("_cut", "_start")
