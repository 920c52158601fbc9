"""Queries of the evaluation operators, with the SQL that checks them.

Predictions: labelled documents with a score that follows from the text.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import evaluate as E
from ..sources import files, sinks
from ..sources.scratch import shared_dir, written
from ..sources.tables import table


def predictions(s, d, model="a"):
    docs = table(s, d, "documents").select("doc_id", "text", "source", "lang")
    labels = table(s, d, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    text = F.col("text") if model == "a" else F.concat("text", F.lit(model))
    noise = S.unit_score(text)
    # Toxic rows score higher on average, so that the curves have a shape; four digits make ties.
    p = F.round(F.when(F.col("toxic") == 1, 0.35 + 0.65 * noise).otherwise(0.8 * noise), 4)
    rows = docs.join(labels, "doc_id").select("doc_id", "source", "lang", F.col("toxic").alias("y_true"), (F.col("doc_id") % 9).alias("bag_size"), p.alias("probability"))
    return E.predicted(rows)


def both_models(s, d):
    return predictions(s, d).withColumn("model", F.lit("a")).unionByName(predictions(s, d, "b").withColumn("model", F.lit("b")))


def comparative(rows, *more):
    """The table of models; the predictions are planned once for its three parts."""
    rows = written(rows, "predictions")
    counts = E.with_ratios(E.confusion("model")(rows))
    spread = rows.groupBy("model").agg(*more, F.count(F.lit(1)).alias("n"), F.min("probability").alias("p_min"), F.max("probability").alias("p_max"))
    return counts.join(E.areas(rows, ["model"]), "model").join(spread, "model")


def tolerance(s, d):
    a = E.areas(predictions(s, d), ["lang"]).toDF("lang", "r1", "p1")
    b = E.areas(predictions(s, d).withColumn("probability", F.col("probability") / 2), ["lang"]).toDF("lang", "r2", "p2")
    return a.join(b, "lang").select("lang", E.close(F.col("r1"), F.col("r2")).alias("roc_equal"), E.close(F.col("p1"), F.col("p2")).alias("pr_equal"))


def comparative_clipped(s, d):
    """The same of scores that leave [0, 1]: the table clips them, and counts how many it had to."""
    raw = both_models(s, d).withColumn("probability", F.round(F.col("probability") * 1.2 - 0.1, 6))
    return comparative(E.clipped(raw), F.count_if("outside").alias("n_outside"))


def metrics_from_csv(s, d):
    """Metrics of a prediction file: written as CSV, read back by its reader."""
    rows = predictions(s, d).select(F.col("doc_id").cast("string").alias("bag_id"), F.lit(None).cast("string").alias("source_group_id"), F.col("y_true").cast("int").alias("y_true"), "probability", "prediction", F.lit("val").alias("split"))
    path = f"{shared_dir(s)}/predictions-{uuid.uuid4().hex}"
    sinks.write_csv(rows, path, ["bag_id"])
    return E.with_ratios(E.confusion()(E.predicted(files.read_predictions(s, path, clip=True))))


def by_size(s, d):
    rows = written(predictions(s, d), "predictions")
    return E.with_ratios(E.confusion("bag_size")(rows)).join(E.areas(rows, ["bag_size"]), "bag_size")


QUERIES = {
    "prediction_scan": lambda s, d: predictions(s, d).select("doc_id", "y_true", S.clip01(F.col("probability")).alias("probability"), "prediction"),
    "confusion": lambda s, d: E.confusion()(predictions(s, d)),
    "classification_metrics": lambda s, d: E.with_ratios(E.confusion()(predictions(s, d))),
    "roc_auc": lambda s, d: E.areas(predictions(s, d), ["lang"]).select("lang", "roc_auc"),
    "pr_auc": lambda s, d: E.areas(predictions(s, d), ["lang"]).select("lang", "pr_auc"),
    "roc_points": lambda s, d: E.roc_points(predictions(s, d), ["lang"]),
    "pr_points": lambda s, d: E.pr_points(predictions(s, d), ["lang"]),
    "roc_curve": lambda s, d: E.roc_curve(predictions(s, d).withColumn("probability", S.rounded(F.col("probability"), 2)), ["lang"]),
    "comparative_table": lambda s, d: comparative(both_models(s, d)),
    "comparative_table_clipped": comparative_clipped,
    "metrics_from_csv": metrics_from_csv,
    "error_cases": lambda s, d: predictions(s, d).where("outcome IN ('fp', 'fn')").join(table(s, d, "documents").select("doc_id", "n_chars"), "doc_id", "left").select("doc_id", "outcome", "probability", "source", "n_chars"),
    "correct_masks": lambda s, d: predictions(s, d).select("doc_id", (F.col("prediction") == F.col("y_true")).alias("correct"), "outcome"),
    "uncertain_cases": lambda s, d: predictions(s, d).where(S.is_uncertain(F.col("probability"))).select("doc_id", "probability", S.is_uncertain(F.col("probability"), tolerance=0.0).alias("strict")),
    "topk_confidence": lambda s, d: E.nearest_threshold(predictions(s, d), "doc_id", 15).select("doc_id", "probability", "distance"),
    "topk_confident_errors": lambda s, d: E.nearest_threshold(predictions(s, d).where("outcome IN ('fp', 'fn')"), "doc_id", 15, farthest=True).select("doc_id", "outcome", "probability", "distance"),
    "class_wise": lambda s, d: E.with_ratios(E.confusion("y_true")(predictions(s, d))),
    "probability_ranges": lambda s, d: predictions(s, d).groupBy("y_true").agg(F.min("probability").alias("p_min"), F.max("probability").alias("p_max")),
    "stratify_size": by_size,
    "stratify_group": lambda s, d: E.with_ratios(E.confusion("group")(predictions(s, d).withColumn("group", F.coalesce("source", F.lit("unknown"))))).select("group", "tp", "tn", "fp", "fn", "sensitivity", "specificity"),
    "model_disagreement": lambda s, d: E.disagreements(predictions(s, d), predictions(s, d, "b"), "doc_id"),
    "metric_tolerance_match": tolerance,
}


def _pred(model):
    text = "text" if model == "a" else f"text || '{model}'"
    noise = f"(('0x' || substr(md5({text}), 1, 8))::BIGINT::DOUBLE / 4294967296.0::DOUBLE)"
    return f"""SELECT *, CASE WHEN prediction = y_true THEN CASE prediction WHEN 1 THEN 'tp' ELSE 'tn' END ELSE CASE prediction WHEN 1 THEN 'fp' ELSE 'fn' END END AS outcome FROM (
  SELECT *, (probability >= 0.5)::INT AS prediction FROM (SELECT d.doc_id, source, lang, toxic AS y_true, d.doc_id % 9 AS bag_size,
    round(CASE WHEN toxic = 1 THEN 0.35::DOUBLE + 0.65::DOUBLE * {noise} ELSE 0.8::DOUBLE * {noise} END, 4) AS probability
    FROM documents d JOIN (SELECT doc_id, max(toxic) AS toxic FROM labels GROUP BY 1) l ON l.doc_id = d.doc_id))"""


PRED = f"pa AS MATERIALIZED ({_pred('a')}), pb AS MATERIALIZED ({_pred('b')})"
COUNTS = "count(*) FILTER (WHERE outcome = 'tp') AS tp, count(*) FILTER (WHERE outcome = 'tn') AS tn, count(*) FILTER (WHERE outcome = 'fp') AS fp, count(*) FILTER (WHERE outcome = 'fn') AS fn"
_RATIO = {k: f"round(({a})::DOUBLE / nullif({b}, 0), 6)" for k, (a, b) in E.RATIOS.items()}
RATIOS = ", ".join(f"{v} AS {k}" for k, v in _RATIO.items()) + ", concat_ws(',', " + ", ".join(f"CASE WHEN {v} IS NULL THEN '{k}' END" for k, v in _RATIO.items()) + ") AS undefined"


def _metrics(rows, group=""):
    g = f"{group}, " if group else ""
    return f"SELECT *, {RATIOS} FROM (SELECT {g}{COUNTS} FROM {rows}{f' GROUP BY {group}' if group else ''})"


def _areas(rows, g, scale="probability"):
    """Every positive against every negative, and a rank for each positive: no cumulative sums."""
    return f"""SELECT g.{g}, round(CASE WHEN np > 0 AND nn > 0 THEN roc / (np * nn) END, 6) AS roc_auc, round(CASE WHEN np > 0 AND nn > 0 THEN ap / np END, 6) AS pr_auc
      FROM (SELECT {g}, count(*) FILTER (WHERE y_true = 1) AS np, count(*) FILTER (WHERE y_true = 0) AS nn FROM {rows} GROUP BY 1) g
      LEFT JOIN (SELECT x.{g}, sum(CASE WHEN x.probability > y.probability THEN 1.0::DOUBLE WHEN x.probability = y.probability THEN 0.5 ELSE 0 END) AS roc FROM {rows} x JOIN {rows} y ON x.{g} = y.{g} AND x.y_true = 1 AND y.y_true = 0 GROUP BY 1) r ON r.{g} = g.{g}
      LEFT JOIN (SELECT {g}, sum(t::DOUBLE / a) AS ap FROM (SELECT x.{g}, x.doc_id, count(*) FILTER (WHERE y.y_true = 1) AS t, count(*) AS a FROM {rows} x JOIN {rows} y ON x.{g} = y.{g} AND y.probability >= x.probability WHERE x.y_true = 1 GROUP BY 1, 2) GROUP BY 1) q ON q.{g} = g.{g}"""


POINTS = """pt AS (SELECT x.lang, x.probability, count(*) FILTER (WHERE y.y_true = 1) AS tp, count(*) FILTER (WHERE y.y_true = 0) AS fp FROM (SELECT DISTINCT lang, probability FROM pa) x JOIN pa y ON x.lang = y.lang AND y.probability >= x.probability GROUP BY 1, 2),
tot AS (SELECT lang, count(*) FILTER (WHERE y_true = 1) AS p, count(*) FILTER (WHERE y_true = 0) AS n FROM pa GROUP BY 1)"""

SQL = {
    "prediction_scan": f"WITH {PRED} SELECT doc_id, y_true, least(greatest(probability, 0), 1) AS probability, prediction FROM pa",
    "confusion": f"WITH {PRED} SELECT {COUNTS} FROM pa",
    "classification_metrics": f"WITH {PRED} {_metrics('pa')}",
    "roc_auc": f"WITH {PRED} SELECT lang, roc_auc FROM ({_areas('pa', 'lang')})",
    "pr_auc": f"WITH {PRED} SELECT lang, pr_auc FROM ({_areas('pa', 'lang')})",
    "roc_points": f"WITH {PRED}, {POINTS} SELECT lang, round(fp / n, 6) AS fpr, round(tp / p, 6) AS tpr, probability AS threshold FROM pt JOIN tot USING (lang) WHERE p > 0 AND n > 0",
    "pr_points": f"WITH {PRED}, {POINTS} SELECT lang, round(tp / p, 6) AS recall, round(tp / (tp + fp), 6) AS precision, probability AS threshold FROM pt JOIN tot USING (lang) WHERE p > 0 AND n > 0",
    "metrics_from_csv": f"WITH {PRED} {_metrics('pa')}",
    "roc_curve": f"""WITH {PRED}, s AS MATERIALIZED (SELECT lang, round(probability, 2) AS probability, count(*) FILTER (WHERE y_true = 1) AS pos, count(*) FILTER (WHERE y_true = 0) AS neg FROM pa GROUP BY 1, 2),
      c AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER (PARTITION BY lang) AS p, sum(neg) OVER (PARTITION BY lang) AS n, lag(pos) OVER w IS NULL OR lead(pos) OVER w IS NULL OR lead(pos) OVER w <> pos OR lead(neg) OVER w <> neg AS kept FROM s WINDOW w AS (PARTITION BY lang ORDER BY probability DESC))
      SELECT lang, round(fp::DOUBLE / n, 6) AS fpr, round(tp::DOUBLE / p, 6) AS tpr, probability AS threshold FROM c WHERE kept AND p > 0 AND n > 0 UNION ALL SELECT DISTINCT lang, 0.0::DOUBLE, 0.0::DOUBLE, 'Infinity'::DOUBLE FROM c WHERE p > 0 AND n > 0""",
    "comparative_table_clipped": f"""WITH {PRED}, raw AS (SELECT *, 'a' AS model FROM pa UNION ALL SELECT *, 'b' FROM pb), cl AS (SELECT * EXCLUDE (prediction, outcome), probability <> x AS outside FROM (SELECT * REPLACE (least(greatest(round(probability * 1.2::DOUBLE - 0.1::DOUBLE, 6), 0), 1) AS probability), round(probability * 1.2::DOUBLE - 0.1::DOUBLE, 6) AS x FROM raw)),
      u AS MATERIALIZED (SELECT *, CASE WHEN prediction = y_true THEN CASE prediction WHEN 1 THEN 'tp' ELSE 'tn' END ELSE CASE prediction WHEN 1 THEN 'fp' ELSE 'fn' END END AS outcome FROM (SELECT *, (probability >= 0.5)::INT AS prediction FROM cl))
      SELECT m.*, roc_auc, pr_auc, n, n_outside, p_min, p_max FROM ({_metrics('u', 'model')}) m JOIN ({_areas('u', 'model')}) a USING (model) JOIN (SELECT model, count(*) FILTER (WHERE outside) AS n_outside, count(*) AS n, min(probability) AS p_min, max(probability) AS p_max FROM u GROUP BY 1) USING (model)""",
    "comparative_table": f"""WITH {PRED}, u AS MATERIALIZED (SELECT *, 'a' AS model FROM pa UNION ALL SELECT *, 'b' FROM pb)
      SELECT m.*, roc_auc, pr_auc, n, p_min, p_max FROM ({_metrics('u', 'model')}) m JOIN ({_areas('u', 'model')}) a USING (model) JOIN (SELECT model, count(*) AS n, min(probability) AS p_min, max(probability) AS p_max FROM u GROUP BY 1) USING (model)""",
    "error_cases": f"WITH {PRED} SELECT doc_id, outcome, probability, source, n_chars FROM pa JOIN (SELECT doc_id, n_chars FROM documents) USING (doc_id) WHERE outcome IN ('fp', 'fn')",
    "correct_masks": f"WITH {PRED} SELECT doc_id, prediction = y_true AS correct, outcome FROM pa",
    "uncertain_cases": f"WITH {PRED} SELECT doc_id, probability, abs(probability - 0.5) <= 0.1::DOUBLE AS strict FROM pa WHERE abs(probability - 0.5) <= 0.1::DOUBLE + 1e-9",
    "topk_confidence": f"WITH {PRED} SELECT doc_id, probability, round(abs(probability - 0.5), 9) AS distance FROM pa ORDER BY distance, doc_id LIMIT 15",
    "topk_confident_errors": f"WITH {PRED} SELECT doc_id, outcome, probability, round(abs(probability - 0.5), 9) AS distance FROM pa WHERE outcome IN ('fp', 'fn') ORDER BY distance DESC, doc_id LIMIT 15",
    "class_wise": f"WITH {PRED} {_metrics('pa', 'y_true')}",
    "probability_ranges": f"WITH {PRED} SELECT y_true, min(probability) AS p_min, max(probability) AS p_max FROM pa GROUP BY 1",
    "stratify_size": f"WITH {PRED} SELECT m.*, roc_auc, pr_auc FROM ({_metrics('pa', 'bag_size')}) m JOIN ({_areas('pa', 'bag_size')}) USING (bag_size)",
    "stratify_group": f"""WITH {PRED} SELECT "group", tp, tn, fp, fn, sensitivity, specificity FROM ({_metrics("(SELECT *, coalesce(source, 'unknown') AS grp FROM pa)", 'grp').replace('SELECT *,', 'SELECT *, grp AS "group",', 1)})""",
    "model_disagreement": f"WITH {PRED} SELECT pa.doc_id, pa.y_true, pa.probability AS probability_a, pa.prediction AS prediction_a, pb.probability AS probability_b, pb.prediction AS prediction_b FROM pa JOIN pb ON pa.doc_id = pb.doc_id WHERE pa.prediction <> pb.prediction",
    "metric_tolerance_match": f"WITH {PRED} SELECT DISTINCT lang, true AS roc_equal, true AS pr_equal FROM pa",
}
