"""Evaluation of classifiers: metrics, curves, slices, disagreement, integrity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalar as S

#: In this order: the names of metrics and the counts that divide them.
RATIOS = {"accuracy": ("tp + tn", "tp + tn + fp + fn"), "sensitivity": ("tp", "tp + fn"), "specificity": ("tn", "tn + fp"), "precision": ("tp", "tp + fp"), "f1": ("2 * tp", "2 * tp + fp + fn")}


def predicted(rows: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Adds prediction (score at the threshold or above) and outcome."""
    rows = rows.withColumn("prediction", (F.col("probability") >= threshold).cast("int"))
    hit, yes = F.col("prediction") == F.col("y_true"), F.col("prediction") == 1
    return rows.withColumn("outcome", F.when(hit & yes, "tp").when(hit, "tn").when(yes, "fp").otherwise("fn"))


def confusion(*group: str):
    """Counts of the four outcomes, by group or overall."""

    def run(rows: DataFrame) -> DataFrame:
        return rows.groupBy(*group).agg(*[F.count_if(F.col("outcome") == k).alias(k) for k in ("tp", "tn", "fp", "fn")])

    return run


def with_ratios(counts: DataFrame) -> DataFrame:
    """Adds the ratios, null where undefined, and the names of those in `undefined`."""
    rows = counts.withColumns({k: F.round(F.try_divide(F.expr(a).cast("double"), F.expr(b).cast("double")), 6) for k, (a, b) in RATIOS.items()})
    return rows.withColumn("undefined", F.array_join(F.filter(F.array(*[F.when(F.col(k).isNull(), F.lit(k)) for k in RATIOS]), lambda x: x.isNotNull()), ","))


def by_score(rows: DataFrame, group: list[str]) -> DataFrame:
    """Positives and negatives at each distinct score: ties move together, and only distinct scores are ranked."""
    return rows.groupBy(*group, "probability").agg(F.sum(F.when(F.col("y_true") == 1, 1).otherwise(0)).alias("pos"), F.sum(F.when(F.col("y_true") == 0, 1).otherwise(0)).alias("neg"))


def _running(rows: DataFrame, group: list[str]) -> DataFrame:
    """Adds tp and fp (counts at the score or above), p and n (all of the group).

    The scores of a group are cut into 256 ranges first: sums over the ranges give
    every range its start, so that no task has to rank more than one range.
    """
    rows = rows.withColumn("_cut", F.floor(S.clip01(F.col("probability")) * 255).cast("int"))
    cuts = rows.groupBy(*group, "_cut").agg(F.sum("pos").alias("_p"), F.sum("neg").alias("_n"))
    w = Window.partitionBy(*group).orderBy(F.desc("_cut")).rowsBetween(Window.unboundedPreceding, -1)
    all_of = Window.partitionBy(*group)
    starts = cuts.select(*group, "_cut", F.coalesce(F.sum("_p").over(w), F.lit(0)).alias("_p0"), F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_n0"), F.sum("_p").over(all_of).alias("p"), F.sum("_n").over(all_of).alias("n"))
    inner = Window.partitionBy(*group, "_cut").orderBy(F.desc("probability")).rowsBetween(Window.unboundedPreceding, 0)
    return rows.join(starts, [*group, "_cut"]).withColumns({"tp": F.col("_p0") + F.sum("pos").over(inner), "fp": F.col("_n0") + F.sum("neg").over(inner)}).drop("_cut", "_p0", "_n0")


def areas(rows: DataFrame, group: list[str]) -> DataFrame:
    """ROC-AUC with tie midpoints and average precision of each group, null with one class only."""
    r = _running(by_score(rows, group), group)
    p, n = F.max("p"), F.max("n")
    # A positive beats the negatives below it, and half of those tied with it.
    roc = F.sum(F.col("pos") * (F.col("n") - F.col("fp") + F.col("neg") / 2))
    ap = F.sum(F.when(F.col("pos") > 0, F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))).otherwise(0.0))
    both = (p > 0) & (n > 0)
    return r.groupBy(*group).agg(F.round(F.when(both, F.try_divide(roc, (p * n).cast("double"))), 6).alias("roc_auc"), F.round(F.when(both, F.try_divide(ap, p.cast("double"))), 6).alias("pr_auc"))


def roc_points(rows: DataFrame, group: list[str]) -> DataFrame:
    """(fpr, tpr, threshold) at each distinct score; none with one class only."""
    r = _running(by_score(rows, group), group).where("p > 0 AND n > 0")
    return r.select(*group, S.rounded(F.col("fp") / F.col("n"), 6).alias("fpr"), S.rounded(F.col("tp") / F.col("p"), 6).alias("tpr"), F.col("probability").alias("threshold"))


def roc_curve(rows: DataFrame, group: list[str]) -> DataFrame:
    """(fpr, tpr, threshold) as libraries give the curve: from (0, 0) at an infinite threshold, without the points between two equal steps; none with one class only.

    A point stays if the next lower score takes another step.  The step after the last
    score of a range is the first one of the next range that has any, so no task sees more than a range.
    """
    r = by_score(rows, group).withColumn("_range", F.floor(S.clip01(F.col("probability")) * 255).cast("int"))
    heads = r.groupBy(*group, "_range").agg(F.max(F.struct("probability", "pos", "neg")).alias("_head"))
    down = Window.partitionBy(*group).orderBy(F.desc("_range"))
    heads = heads.select(*group, "_range", F.lead("_head").over(down).alias("_next"), F.lag("_range").over(down).isNull().alias("_top"))
    inner = Window.partitionBy(*group, "_range").orderBy(F.desc("probability"))
    r = r.withColumns({"_pos": F.lead("pos").over(inner), "_neg": F.lead("neg").over(inner), "_place": F.row_number().over(inner)}).join(heads, [*group, "_range"])
    r = r.withColumns({"_pos": F.coalesce("_pos", "_next.pos"), "_neg": F.coalesce("_neg", "_next.neg")})
    kept = (F.col("_top") & (F.col("_place") == 1)) | F.col("_pos").isNull() | (F.col("pos") != F.col("_pos")) | (F.col("neg") != F.col("_neg"))
    points = _running(r, group).where("p > 0 AND n > 0")
    ends = points.select(*group).distinct().select(*group, F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"), F.lit(float("inf")).alias("threshold"))
    return points.where(kept).select(*group, S.rounded(F.col("fp") / F.col("n"), 6).alias("fpr"), S.rounded(F.col("tp") / F.col("p"), 6).alias("tpr"), F.col("probability").alias("threshold")).unionByName(ends)


def clipped(rows: DataFrame) -> DataFrame:
    """Scores inside [0, 1], predictions again from them, and whether one was outside."""
    inside = S.clip01(F.col("probability"))
    return predicted(rows.withColumns({"outside": F.col("probability") != inside, "probability": inside}))


def pr_points(rows: DataFrame, group: list[str]) -> DataFrame:
    """(recall, precision, threshold) at each distinct score; none with one class only."""
    r = _running(by_score(rows, group), group).where("p > 0 AND n > 0")
    return r.select(*group, S.rounded(F.col("tp") / F.col("p"), 6).alias("recall"), S.rounded(F.col("tp") / (F.col("tp") + F.col("fp")), 6).alias("precision"), F.col("probability").alias("threshold"))


def nearest_threshold(rows: DataFrame, key: str, k: int, farthest: bool = False, threshold: float = 0.5) -> DataFrame:
    """k rows by their distance from the threshold, ties by key, with the distance."""
    away = F.abs(F.col("probability") - threshold)
    rows = rows.withColumn("distance", F.round(away, 9))
    return rows.orderBy(F.desc("distance") if farthest else F.asc("distance"), key).limit(k)


def disagreements(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Rows of both models whose predictions differ; rows without a score in either are left out."""
    left = a.where("probability IS NOT NULL").select(key, "y_true", F.col("probability").alias("probability_a"), F.col("prediction").alias("prediction_a"))
    right = b.where("probability IS NOT NULL").select(key, F.col("probability").alias("probability_b"), F.col("prediction").alias("prediction_b"))
    return left.join(right, key).where("prediction_a <> prediction_b")


def close(a: Column, b: Column, tolerance: float = 1e-9) -> Column:
    """Both null, or as near as the tolerance."""
    return F.coalesce(F.abs(a - b) < tolerance, a.isNull() & b.isNull())
