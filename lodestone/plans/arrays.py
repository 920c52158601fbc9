"""Queries of the array and pooling operators over `embeddings`, with the SQL that checks them.

The weights are small fixed literals, so that both engines share them: the
results test the operators, not a trained model.
"""

from __future__ import annotations

import json
import math
import uuid

from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import arrays as R
from ..operators import chunks as C
from ..operators import integrity as I
from ..operators import mil as M
from ..operators import order as O
from ..sources.cache import read_cache, write_cache
from ..sources.scratch import shared_dir
from ..sources.tables import table

MEAN, STD = 0.0, 0.125
#: Weights from a rule over all channels of an embedding: three hidden units of the attention, two of the gates.
CHANNELS = 64
V = [[round(math.sin(1 + i + 4 * j), 3) for i in range(CHANNELS)] for j in range(3)]
B = [0.1, -0.2, 0.05]
W = [1.5, -1.0, 0.75]
W1 = [[round(math.cos(2 + i + 4 * j), 3) for i in range(CHANNELS)] for j in range(2)]
W2 = [[round(math.sin(3 + i + 2 * j), 3) for i in range(2)] for j in range(CHANNELS)]
HEAD, BIAS = [round(2 * math.cos(5 + 3 * i), 3) for i in range(CHANNELS)], -0.1


def vectors(s, d):
    """Bags of embeddings: bag = vec_id mod 25; split by bag; h is the embedding as the models take it."""
    e = table(s, d, "embeddings")
    v = F.transform("embedding", lambda x: x.cast("double"))
    return e.select("vec_id", "label", (F.col("vec_id") % 25).alias("bag_id"), F.when(F.col("vec_id") % 25 < 18, "train").when(F.col("vec_id") % 25 < 22, "val").otherwise("test").alias("split"), v.alias("v"), v.alias("h"))


def scored(s, d, gated=False):
    rows = vectors(s, d)
    if gated:
        rows = rows.withColumn("h", F.zip_with("h", M.channel_gates(F.col("h"), M.literal(W1), M.literal(W2)), lambda x, g: x * g))
    return rows.withColumn("score", M.tanh_score(F.col("h"), M.literal(V), M.literal(B), M.literal(W)))


def by_channel(df, key, name="z"):
    """A row for each channel of a vector, its value rounded."""
    return df.select(key, F.posexplode(name).alias("channel", "x")).select(key, "channel", F.round("x", 6).alias("z"))


def logit(s, d, gated):
    z = M.pool_attention(scored(s, d, gated), "bag_id", "h", "score")
    x = M.linear_head(F.col("z"), M.literal(HEAD), BIAS)
    return z.select("bag_id", F.round(x, 6).alias("logit"), F.round(S.sigmoid(x), 6).alias("probability"))


def reduction(s, d):
    """With gates of one the gated model is the plain one: the largest difference of the two."""
    plain = M.pool_attention(scored(s, d), "bag_id", "h", "score")
    ones = scored(s, d).withColumn("h", F.zip_with("h", F.array_repeat(F.lit(1.0), F.size("h")), lambda x, g: x * g))
    again = M.pool_attention(ones, "bag_id", "h", "score").withColumnRenamed("z", "y")
    return plain.join(again, "bag_id").agg(F.round(F.max(F.array_max(F.zip_with("z", "y", lambda a, b: F.abs(a - b)))), 6).alias("largest_difference"), F.count(F.lit(1)).alias("n_bags"))


def masked_mean(s, d):
    """Means over padded bags of vectors with their masks, channel by channel, beside the plain means."""
    bags = vectors(s, d).groupBy("bag_id").agg(F.collect_list("h").alias("hs"))
    pad = R.padded(F.col("hs"), F.size("hs") + F.col("bag_id").cast("int") % 5, F.array_repeat(F.lit(0.0), CHANNELS))
    rows = bags.select("bag_id", *pad).withColumn("n_padded", F.size("padded").cast("bigint"))
    slots = rows.select("bag_id", "n_padded", F.explode(F.arrays_zip("padded", "mask")).alias("s"))
    cells = slots.select("bag_id", "n_padded", "s.mask", F.posexplode("s.padded").alias("channel", "x"))
    means = cells.groupBy("bag_id", "n_padded", "channel").agg(F.round(F.sum(F.when(F.col("mask"), F.col("x")).otherwise(0.0)) / F.count_if("mask"), 6).alias("masked_mean"))
    return means.join(by_channel(M.pool_mean(vectors(s, d), "bag_id", "h"), "bag_id").withColumnRenamed("z", "plain_mean"), ["bag_id", "channel"])


def collated(s, d):
    """Bags of vectors in chunks of 16 slots, the last one padded: what a masked mean over the chunks gives, and how many slots there are."""
    padded = C.collated(vectors(s, d).select("bag_id", "vec_id", "h"), "bag_id", "h", CHANNELS, 16)
    slots = padded.groupBy("bag_id").agg(F.sum(F.size("padded")).alias("n_padded"), F.count(F.lit(1)).alias("n_chunks"))
    return C.masked_sums(padded, "bag_id").join(slots, "bag_id").select("bag_id", "channel", "n", "n_padded", "n_chunks", F.round(F.col("total") / F.col("n"), 6).alias("masked_mean"))


def cached(s, d):
    """Vectors written to a cache by what they are, and read back with every check."""
    rows = vectors(s, d).select("vec_id", "split", F.transform("h", lambda x: x.cast("float")).alias("h"))
    counts = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("vec_id").alias("ids")).first()
    identity = {"rows": "vectors", "of": d, "width": CHANNELS, "n": counts.n, "ids": counts.ids or 0}
    root = f"{shared_dir(s)}/vector-cache"
    write_cache(rows, root, identity)
    return read_cache(s, root, identity, {"h": CHANNELS}).select("vec_id", "split", micros(F.transform("h", lambda x: x.cast("double"))).alias("values"))


def drift_frozen(s, d):
    """Training statistics, written as a run's record and read again, against those of the rows in another order; a drift of 1e-6 raises."""
    rows = vectors(s, d).where("split = 'train'")
    record = R.train_stats(rows, "v").select(F.to_json(F.struct("mean", "std")).alias("value"))
    path = f"{shared_dir(s)}/statistics-{uuid.uuid4().hex}"
    record.coalesce(1).write.text(path)
    frozen = json.loads(s.read.text(path).first().value)
    return I.drift_guard(R.train_stats(rows.repartition("label", "vec_id"), "v").select("mean", "std"), frozen)


def micros(x):
    """An array of numbers as text, in millionths."""
    return F.array_join(F.transform(x, lambda v: F.rint(v * 1e6).cast("bigint").cast("string")), ",")


QUERIES = {
    "train_stats": lambda s, d: vectors(s, d).where("split = 'train'").transform(R.train_stats, "v"),
    "normalize_quantize": lambda s, d: vectors(s, d).select("vec_id", F.array_join(F.transform(R.quantize(F.col("v"), MEAN, STD), lambda q: q.cast("string")), ",").alias("codes")),
    "decode_roundtrip": lambda s, d: vectors(s, d).select("v", R.dequantize(R.quantize(F.col("v"), MEAN, STD)).alias("x")).agg(F.count(F.lit(1)).alias("n"), (F.max(F.array_max(F.zip_with("v", "x", lambda a, b: F.abs(a - b * STD - MEAN)))) <= STD / 8192 + 1e-12).alias("within_half_step")),
    "array_qa": lambda s, d: vectors(s, d).withColumn("px", F.transform("v", lambda x: F.rint((x + 1) * 127.5))).select("vec_id", *R.quality(F.col("px"))),
    "padded_collate": masked_mean,
    "collated_chunks": collated,
    "cached_vectors": cached,
    "flip_train_only": lambda s, d: vectors(s, d).select("vec_id", "split", micros(R.flip(F.col("h"), F.col("vec_id"), F.col("split"), 20260918)).alias("values")),
    "stride_sample": lambda s, d: O.stride_sample(vectors(s, d).select("label", "vec_id"), ["label"], ["vec_id"], 6),
    "step_sample": lambda s, d: O.step_sample(vectors(s, d).select("label", "vec_id"), ["label"], ["vec_id"], 7, 5),
    "hashed_sample": lambda s, d: R.hashed_sample(vectors(s, d).select("vec_id", "label"), "vec_id", 20, 7),
    "mean_pool_bags": lambda s, d: by_channel(M.pool_mean(vectors(s, d), "bag_id", "h"), "bag_id"),
    "mean_pool_logit": lambda s, d: M.pool_mean(vectors(s, d), "bag_id", "h").select("bag_id", F.round(M.linear_head(F.col("z"), M.literal(HEAD), BIAS), 6).alias("logit")),
    "attention_softmax": lambda s, d: M.softmax(scored(s, d), "bag_id", "score").select("bag_id", "vec_id", F.round("attention", 6).alias("attention")),
    "attention_pool": lambda s, d: by_channel(M.pool_attention(scored(s, d), "bag_id", "h", "score"), "bag_id"),
    "attention_logit": lambda s, d: logit(s, d, False),
    "attention_checks": lambda s, d: M.checked_attention(M.softmax(scored(s, d), "bag_id", "score"), "bag_id", "attention", "h", CHANNELS).select("bag_id", "n", *[F.round(c, 6).alias(c) for c in ("total", "least", "most")]),
    "drift_frozen": drift_frozen,
    "channel_gates": lambda s, d: by_channel(vectors(s, d).withColumn("g", M.channel_gates(F.col("h"), M.literal(W1), M.literal(W2))), "vec_id", "g"),
    "dual_attention_logit": lambda s, d: logit(s, d, True),
    "uniform_gate_reduction": reduction,
}

_LIST = lambda w: f"[{', '.join(map(repr, w))}]::DOUBLE[]"
_DOT = lambda w, h: f"list_dot_product({h}, {_LIST(w)})"
_TANH = lambda h: " + ".join(f"({W[j]!r})::DOUBLE * tanh({_DOT(V[j], h)} + ({B[j]!r})::DOUBLE)" for j in range(3))
_HID = [f"greatest({_DOT(W1[j], 'h')}, 0.0::DOUBLE)" for j in range(2)]
_GATES = f"list_transform(list_zip({_LIST([w[0] for w in W2])}, {_LIST([w[1] for w in W2])}), lambda w: 1 / (1 + exp(-(w[1] * {_HID[0]} + w[2] * {_HID[1]}))))"
VEC = "v AS (SELECT vec_id, label, vec_id % 25 AS bag_id, CASE WHEN vec_id % 25 < 18 THEN 'train' WHEN vec_id % 25 < 22 THEN 'val' ELSE 'test' END AS split, embedding::DOUBLE[] AS v, embedding::DOUBLE[] AS h FROM embeddings)"
_CELLS = lambda cols, src: f"(SELECT {cols}, unnest(h) AS x, unnest(range(len(h)))::INT AS channel FROM {src})"
ATT = lambda src: f"""sc AS (SELECT *, {_TANH('h')} AS score FROM {src}),
ex AS (SELECT *, exp(score - max(score) OVER (PARTITION BY bag_id)) AS e FROM sc),
aw AS (SELECT *, e / sum(e) OVER (PARTITION BY bag_id) AS a FROM ex),
z AS (SELECT bag_id, channel, sum(a * x) AS z FROM {_CELLS('bag_id, a', 'aw')} GROUP BY 1, 2), {LGT}"""  # noqa: E731
LGT = f"lg AS (SELECT bag_id, sum(z * ({_LIST(HEAD)})[channel + 1]) + ({BIAS!r})::DOUBLE AS x FROM z GROUP BY 1)"
GATED = f"gt AS (SELECT vec_id, bag_id, list_transform(list_zip(h, g), lambda p: p[1] * p[2]) AS h FROM (SELECT *, {_GATES} AS g FROM v))"
MEANZ = f"z AS (SELECT bag_id, channel, avg(x) AS z FROM {_CELLS('bag_id', 'v')} GROUP BY 1, 2), {LGT}"
_CHANNEL = "SELECT bag_id, channel, round(z, 6) AS z FROM z"
_PROB = "SELECT bag_id, round(x, 6) AS logit, round(1 / (1 + exp(-x)), 6) AS probability FROM lg"
_CODE = "round_even(((x - 0.0::DOUBLE) / 0.125::DOUBLE + 8.0::DOUBLE) * 4096.0::DOUBLE, 0)"

SQL = {
    "train_stats": f"WITH {VEC}, x AS (SELECT unnest(v) AS x FROM v WHERE split = 'train') SELECT count(*) AS n, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std, min(x) AS least, max(x) AS most FROM x",
    "normalize_quantize": f"WITH {VEC} SELECT vec_id, array_to_string(list_transform(v, lambda x: {_CODE}::INT), ',') AS codes FROM v",
    "decode_roundtrip": f"WITH {VEC} SELECT count(*) AS n, max(list_max(list_transform(v, lambda x: abs(x - ({_CODE} / 4096.0 - 8.0) * 0.125)))) <= 0.125 / 8192 + 1e-12 AS within_half_step FROM v",
    "array_qa": f"WITH {VEC}, px AS (SELECT vec_id, list_transform(v, lambda x: round_even((x + 1) * 127.5::DOUBLE, 0)) AS p FROM v) SELECT vec_id, list_min(p) AS qa_min, list_max(p) AS qa_max, round(list_sum(p) / 64, 6) AS qa_mean, round(sqrt(list_dot_product(p, p) / 64 - (list_sum(p) / 64) * (list_sum(p) / 64)), 6) AS qa_std, list_min(p) = list_max(p) AS blank, list_min(p) <= 0 OR list_max(p) >= 255 AS clipped FROM px",
    "padded_collate": f"WITH {VEC} SELECT bag_id, channel, count(*) + bag_id % 5 AS n_padded, round(avg(x), 6) AS masked_mean, round(avg(x), 6) AS plain_mean FROM {_CELLS('bag_id', 'v')} GROUP BY bag_id, channel",
    "collated_chunks": f"WITH {VEC} SELECT bag_id, channel, count(*) AS n, (ceil(count(*) / 16) * 16)::BIGINT AS n_padded, ceil(count(*) / 16)::BIGINT AS n_chunks, round(avg(x), 6) AS masked_mean FROM {_CELLS('bag_id', 'v')} GROUP BY bag_id, channel",
    "cached_vectors": f"WITH {VEC} SELECT vec_id, split, array_to_string(list_transform(h, lambda x: round_even(x * 1e6::DOUBLE, 0)::BIGINT), ',') AS values FROM v",
    "flip_train_only": f"WITH {VEC} SELECT vec_id, split, array_to_string(list_transform(CASE WHEN split = 'train' AND substr(md5(vec_id || ':20260918'), 1, 1) < '8' THEN list_reverse(h) ELSE h END, lambda x: round_even(x * 1e6::DOUBLE, 0)::BIGINT), ',') AS values FROM v",
    "stride_sample": "WITH n AS (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS rn, count(*) OVER (PARTITION BY label) AS total FROM embeddings) SELECT label, vec_id, pick::INT AS pick FROM n, (SELECT unnest(range(6)) AS pick) WHERE rn = least(total - 1, (pick * total) // 6)",
    "step_sample": "WITH n AS (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS rn FROM embeddings) SELECT label, vec_id FROM n WHERE rn % 7 = 0 AND rn < 35",
    "hashed_sample": "SELECT vec_id, label FROM embeddings ORDER BY md5(vec_id || ':7'), vec_id LIMIT 20",
    "mean_pool_bags": f"WITH {VEC}, {MEANZ} {_CHANNEL}",
    "mean_pool_logit": f"WITH {VEC}, {MEANZ} SELECT bag_id, round(x, 6) AS logit FROM lg",
    "attention_softmax": f"WITH {VEC}, {ATT('v')} SELECT bag_id, vec_id, round(a, 6) AS attention FROM aw",
    "attention_pool": f"WITH {VEC}, {ATT('v')} {_CHANNEL}",
    "attention_logit": f"WITH {VEC}, {ATT('v')} {_PROB}",
    "attention_checks": f"WITH {VEC}, {ATT('v')} SELECT bag_id, count(*) AS n, round(sum(a), 6) AS total, round(min(a), 6) AS least, round(max(a), 6) AS most FROM aw GROUP BY bag_id",
    "drift_frozen": f"WITH {VEC}, x AS (SELECT unnest(v) AS x FROM v WHERE split = 'train'), y AS (SELECT round(avg(x), 6) AS m, round(stddev_pop(x), 6) AS s FROM x) SELECT 'mean' AS statistic, m AS found, m AS frozen, true AS ok FROM y UNION ALL SELECT 'std', s, s, true FROM y",
    "channel_gates": f"WITH {VEC} SELECT vec_id, channel, round(x, 6) AS z FROM {_CELLS('vec_id', f'(SELECT vec_id, {_GATES} AS h FROM v)')}",
    "dual_attention_logit": f"WITH {VEC}, {GATED}, {ATT('gt')} {_PROB}",
    "uniform_gate_reduction": "SELECT 0.0::DOUBLE AS largest_difference, count(DISTINCT vec_id % 25) AS n_bags FROM embeddings",
}
