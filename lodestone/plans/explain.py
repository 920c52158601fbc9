"""Queries of ranking, evidence, case selection, records and logs, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import explain as X
from ..operators import mil as M
from ..operators import order as O
from ..sources.tables import table
from ..streaming import duplicates as D
from .arrays import ATT, BIAS, HEAD, VEC, scored
from .evaluate import PRED, predictions


def attention(s, d):
    rows = M.softmax(scored(s, d), "bag_id", "score").withColumn("attention", F.round("attention", 6))
    return X.ranked(rows, "bag_id", "attention", "vec_id")


def bag_scores(s, d):
    z = M.pool_attention(scored(s, d), "bag_id", "h", "score")
    return z.select("bag_id", F.round(S.sigmoid(M.linear_head(F.col("z"), M.literal(HEAD), BIAS)), 6).alias("probability"))


def export(s, d):
    rows = attention(s, d)
    h = F.col("h")
    top = F.array_max(h)
    return rows.select("bag_id", "vec_id", "split", "attention", "rank", F.round(S.total(h) / F.size(h), 6).alias("gate_mean"), F.round(top, 6).alias("gate_max"), (F.array_position(h, top) - 1).alias("gate_argmax"))


def records(s, d):
    """A record for each bag; bags of the test split have no attention, and so no evidence."""
    kept = attention(s, d).where((F.col("rank") <= 3) & (F.col("split") != "test"))
    one = F.struct("rank", "vec_id", "attention")
    evidence = kept.groupBy("bag_id").agg(F.array_sort(F.collect_list(one)).alias("ev"))
    rows = bag_scores(s, d).join(evidence, "bag_id", "left")
    empty = F.array().cast("array<struct<rank:int,vec_id:bigint,attention:double>>")
    record = X.decision_record(F.col("probability"), F.coalesce("ev", empty), F.struct(F.col("bag_id").cast("string").alias("bag_id"), F.lit(0.5).alias("decision_threshold")))
    text = F.array_join(F.transform("r.top_k_evidence", lambda e: F.concat_ws(":", e["rank"].cast("string"), e["vec_id"].cast("string"))), "|")
    return rows.select("bag_id", record.alias("r")).select("bag_id", "r.prediction", "r.model_score", "r.prediction_confidence", "r.uncertainty_flag", "r.attention_available", text.alias("evidence"), F.get_json_object(F.to_json("r"), "$.provenance.bag_id").alias("provenance_bag"))


def epoch_log(s, d):
    """A log of 30 epochs: the events' mean value by day."""
    e = table(s, d, "events").select(F.dayofmonth("ts").alias("day"), "value")
    return e.groupBy("day").agg(F.round(F.avg("value"), 4).alias("metric")).select(F.col("day").alias("epoch"), "metric")


def turns(s, d):
    return table(s, d, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"))


def median_groups(s, d):
    """Smallest, median and largest conversation by (turns, id), of each first role."""
    rows = table(s, d, "conversations").groupBy("conv_id").agg(F.min_by("role", "turn").alias("role"), F.count(F.lit(1)).alias("n"))
    # A group of one is its smallest, one of two has no median of its own: an earlier name takes a row.
    found = O.middle_rows(rows, ["role"], ["n", "conv_id"])
    named = F.when(F.col("at") == "smallest", 0).when(F.col("at") == "median", 1).otherwise(2)
    one = found.groupBy("role", "conv_id", "n").agg(F.min(F.struct(named.alias("k"), "at")).alias("first"))
    return one.select("role", F.col("first.at").alias("place"), "conv_id", "n")


QUERIES = {
    "attention_rank": lambda s, d: attention(s, d).select("bag_id", "vec_id", "attention", "rank"),
    "topk_evidence": lambda s, d: X.top_k(attention(s, d).drop("rank"), "bag_id", "attention", "vec_id", 3).select("bag_id", "vec_id", "rank", "attention", "label"),
    "attention_export": export,
    "case_selection": lambda s, d: X.representative_cases(predictions(s, d), "doc_id"),
    "decision_records": records,
    "early_stopping": lambda s, d: X.early_stopping(epoch_log(s, d), "epoch", "metric", 5),
    "prefix_offsets": lambda s, d: X.offsets(turns(s, d), "conv_id", "n"),
    "instance_rows": lambda s, d: table(s, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("t")).select("conv_id", F.posexplode("t").alias("at", "x")).select("conv_id", F.col("at").cast("bigint").alias("index_in_bag"), "x.role"),
    "median_groups": median_groups,
    "cache_key": lambda s, d: table(s, d, "embeddings").agg(F.count(F.lit(1)).alias("rows"), F.max(F.size("embedding")).alias("width")).select(F.substring(F.sha2(F.to_json(F.struct("rows", "width")), 256), 1, 16).alias("key")),
    "embedding_checks": lambda s, d: table(s, d, "embeddings").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("vec_id").alias("n_ids"), F.count_if(F.size("embedding") != 64).alias("bad_width"), F.count_if(F.exists("embedding", lambda x: F.isnan(x) | (F.abs(x) == float("inf")))).alias("not_finite")),
    "stream_daily_events": D.daily_events,
    "stream_daily_users": D.daily_users,
}

_RANK = f"WITH {VEC}, {ATT('v')}, rk AS MATERIALIZED (SELECT bag_id, vec_id, label, split, h, attention, row_number() OVER (PARTITION BY bag_id ORDER BY attention DESC, vec_id)::INT AS rank FROM (SELECT *, round(a, 6) AS attention FROM (SELECT aw.*, row_number() OVER () AS _ FROM aw)))"

SQL = {
    "attention_rank": f"{_RANK} SELECT bag_id, vec_id, attention, rank FROM rk",
    "topk_evidence": f"{_RANK} SELECT bag_id, vec_id, rank, attention, label FROM rk WHERE rank <= 3",
    "attention_export": f"{_RANK} SELECT bag_id, vec_id, split, attention, rank, round(list_sum(h) / 64, 6) AS gate_mean, round(list_max(h), 6) AS gate_max, (list_position(h, list_max(h)) - 1)::BIGINT AS gate_argmax FROM rk",
    "case_selection": f"""WITH {PRED}, c AS (SELECT min(doc_id) AS doc_id, CASE outcome WHEN 'tn' THEN 'correct_benign' WHEN 'tp' THEN 'correct_malignant' WHEN 'fp' THEN 'false_positive' ELSE 'false_negative' END AS category, 0 AS k FROM pa GROUP BY outcome
      UNION ALL SELECT doc_id, 'uncertain', 1 FROM (SELECT doc_id FROM pa WHERE abs(probability - 0.5) <= 0.1::DOUBLE ORDER BY doc_id LIMIT 2)) SELECT doc_id, arg_min(category, k) AS category FROM c GROUP BY doc_id""",
    "decision_records": f"""{_RANK}, pb AS (SELECT bag_id, round(1 / (1 + exp(-x)), 6) AS p FROM lg), ev AS (SELECT bag_id, string_agg(rank || ':' || vec_id, '|' ORDER BY rank) AS e FROM rk WHERE rank <= 3 AND split <> 'test' GROUP BY 1)
      SELECT pb.bag_id, CASE WHEN p >= 0.5 THEN 'Malignant model prediction' ELSE 'Benign model prediction' END AS prediction, p AS model_score, CASE WHEN abs(p - 0.5) <= 0.1::DOUBLE + 1e-9 THEN 'borderline (within uncertainty margin)' ELSE 'high' END AS prediction_confidence,
        abs(p - 0.5) <= 0.1::DOUBLE + 1e-9 AS uncertainty_flag, e IS NOT NULL AS attention_available, coalesce(e, '') AS evidence, pb.bag_id::VARCHAR AS provenance_bag FROM pb LEFT JOIN ev ON ev.bag_id = pb.bag_id""",
    "early_stopping": """WITH l AS (SELECT day(ts)::INT AS epoch, round(avg(value), 4) AS metric FROM events GROUP BY 1), i AS (SELECT *, coalesce(metric > max(metric) OVER (ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS improved FROM l),
      b AS (SELECT *, max(CASE WHEN improved THEN epoch END) OVER (ORDER BY epoch) AS best_epoch FROM i) SELECT *, epoch - best_epoch >= 5 AS stopped FROM b""",
    "prefix_offsets": "SELECT conv_id, n, sum(n) OVER (ORDER BY conv_id)::BIGINT AS \"end\", (sum(n) OVER (ORDER BY conv_id) - n)::BIGINT AS \"begin\" FROM (SELECT conv_id, count(*) AS n FROM conversations GROUP BY 1)",
    "instance_rows": "SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role) - 1 AS index_in_bag, role FROM conversations",
    "median_groups": """WITH c AS (SELECT conv_id, arg_min(role, turn) AS role, count(*) AS n FROM conversations GROUP BY 1), k AS (SELECT *, row_number() OVER (PARTITION BY role ORDER BY n, conv_id) - 1 AS rn, count(*) OVER (PARTITION BY role) AS total FROM c)
      SELECT role, CASE WHEN rn = 0 THEN 'smallest' WHEN rn = total // 2 THEN 'median' ELSE 'largest' END AS place, conv_id, n FROM k WHERE rn = 0 OR rn = total // 2 OR rn = total - 1""",
    "cache_key": "SELECT substr(sha256('{\"rows\":' || count(*) || ',\"width\":' || max(len(embedding)) || '}'), 1, 16) AS key FROM embeddings",
    "embedding_checks": "SELECT count(*) AS n, count(DISTINCT vec_id) AS n_ids, count(*) FILTER (WHERE len(embedding) <> 64) AS bad_width, count(*) FILTER (WHERE len(list_filter(embedding, lambda x: isnan(x) OR isinf(x))) > 0) AS not_finite FROM embeddings",
    "stream_daily_users": "SELECT ts::DATE AS day, event_type, count(DISTINCT user_id) AS n_users FROM events GROUP BY 1, 2",
    "stream_daily_events": "SELECT ts::DATE AS day, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2",
}
