"""Queries of seeded orders, batches and samples, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import batches as B
from ..operators import explain as X
from ..sources.tables import table
from .evaluate import predictions
from .explain import SQL as EXPLAIN_SQL
from .groups import GROUP_SQL, bag_rows

SEED, SIZE = 20260918, 32
BAGS = 20


def numbered(s, d):
    return B.numbered_batches(table(s, d, "embeddings").select("vec_id", "label"), ["vec_id"], SIZE, SEED)


def stacked(s, d):
    out = B.stacked(numbered(s, d), ["vec_id", "flip"])
    return out.select("batch", "n", F.array_join(F.transform("vec_id", lambda x: x.cast("string")), ",").alias("ids"), F.size(F.filter("flip", lambda x: x)).alias("n_flipped"))


def train_bags(s, d):
    """Bags that lie in the train split only."""
    return bag_rows(s, d).where((F.size("splits") == 1) & (F.get("splits", F.lit(0)) == "train")).select("bag_id", "instance_count")


def cases(s, d):
    """Cases of the predictions, and a train bag that no prediction has."""
    found = X.representative_cases(predictions(s, d), "doc_id").select(F.col("doc_id").cast("string").alias("key"), F.lit("val").alias("split"), "category")
    spare = B.seeded_sample(train_bags(s, d), "bag_id", "instance_count", 1, SEED).select(F.col("bag_id").alias("key"), F.lit("train").alias("split"), F.lit("train_fallback").alias("category"))
    return found.unionByName(spare.join(found.select("key"), "key", "left_anti"))


QUERIES = {
    "seeded_permutation": lambda s, d: numbered(s, d).select("vec_id", "row_index", "permuted", "batch", "slot", "flip"),
    "train_batches": stacked,
    "seeded_bag_sample": lambda s, d: B.seeded_sample(bag_rows(s, d), "bag_id", "instance_count", BAGS, SEED),
    "seeded_train_sample": lambda s, d: B.seeded_sample(train_bags(s, d), "bag_id", "instance_count", 5, SEED),
    "case_selection_fallback": cases,
}

_KEYS = ", ".join(map(str, B.round_keys(SEED)))
_SWAP = f"CASE WHEN substr(md5('{SEED}:' || (r - 1) || ':' || greatest(x, ((k[r] - x) % n + n) % n)), 1, 1) < '8' THEN x ELSE ((k[r] - x) % n + n) % n END"
_ORDER = f"""WITH i AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS row_index, count(*) OVER () AS n FROM embeddings), k AS (SELECT [{_KEYS}]::BIGINT[] AS k),
b AS (SELECT vec_id, row_index, list_reduce(range(1, {B.ROUNDS + 1}), lambda x, r: {_SWAP}, row_index) AS permuted, substr(md5('{SEED}:flip:' || row_index), 1, 1) < '8' AS flip FROM i, k)"""
_TRAIN = "tb AS (SELECT bag_id, instance_count FROM bg WHERE splits = 'train')"


def _sample(source: str, n: int) -> str:
    """(bag_id) of the sample with the exchange."""
    return f"""dr AS (SELECT bag_id FROM {source} ORDER BY md5(bag_id || ':{SEED}'), bag_id LIMIT {n}), sm AS (SELECT bag_id FROM {source} ORDER BY instance_count, bag_id LIMIT 1),
      sp AS (SELECT bag_id FROM sm UNION SELECT bag_id FROM dr WHERE bag_id <> (SELECT min(bag_id) FROM dr) OR (SELECT count(*) FROM dr JOIN sm USING (bag_id)) > 0)"""


SQL = {
    "seeded_permutation": f"{_ORDER} SELECT vec_id, row_index, permuted, permuted // {SIZE} AS batch, permuted % {SIZE} AS slot, flip FROM b",
    "train_batches": f"{_ORDER} SELECT permuted // {SIZE} AS batch, count(*)::INT AS n, string_agg(vec_id::VARCHAR, ',' ORDER BY permuted) AS ids, count(*) FILTER (WHERE flip)::INT AS n_flipped FROM b GROUP BY 1",
    "seeded_bag_sample": f"{GROUP_SQL}, {_sample('bg', BAGS)} SELECT bag_id FROM sp",
    "seeded_train_sample": f"{GROUP_SQL}, {_TRAIN}, {_sample('tb', 5)} SELECT bag_id FROM sp",
    "case_selection_fallback": f"SELECT doc_id::VARCHAR AS key, 'val' AS split, category FROM ({EXPLAIN_SQL['case_selection']}) UNION ALL SELECT bag_id, 'train', 'train_fallback' FROM ({GROUP_SQL}, {_TRAIN}, {_sample('tb', 1)} SELECT bag_id FROM sp)",
}
