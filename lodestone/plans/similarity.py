"""Queries of the similarity operators, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scalar as S
from ..operators import similarity as X
from ..operators.graph import components
from ..sources.scratch import written
from ..sources.tables import table


def contents(spark, d):
    """One row for each distinct text: the least doc_id, and the least source as its group."""
    docs = table(spark, d, "documents").select("doc_id", "text", "source")
    least = docs.groupBy(F.md5("text").alias("md5")).agg(F.min("doc_id").alias("doc_id"))
    return least.join(docs, "doc_id").select("doc_id", "text", "source", "md5")


def hashes(spark, d):
    """(doc_id, hash) of the distinct texts: every text is hashed where it is read, and only its sums move."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    least = docs.groupBy(F.md5("text").alias("md5")).agg(F.min("doc_id").alias("doc_id"))
    return X.word_simhash(docs, "doc_id", "text").join(least.select("doc_id"), "doc_id", "left_semi")


def kept_hashes(spark, d):
    """`hashes`, written once for the joins, which read them several times."""
    return written(hashes(spark, d), "hashes")


def grouped_hashes(spark, d, h=None):
    return (hashes(spark, d) if h is None else h).join(contents(spark, d).select("doc_id", "source"), "doc_id")


def bands(spark, d, most=7):
    """Bands for as many hashes as there are documents; the count comes from the files' footers."""
    return X.band_plan(table(spark, d, "documents").count(), most)


def pairs(spark, d, h=None):
    return X.banded_pairs(kept_hashes(spark, d) if h is None else h, "doc_id", **bands(spark, d))


def cells(spark, d):
    """The pairs, counted between the texts of one hash and source."""
    rows = written(grouped_hashes(spark, d), "hashes")
    return rows, X.cell_pairs(rows, "doc_id", "source", **bands(spark, d))


def histogram(spark, d, h=None):
    """(hamming, n): pairs by their distance."""
    return X.distance_counts(kept_hashes(spark, d) if h is None else h, "doc_id", **bands(spark, d))


def edges(spark, d, h=None):
    return X.near_edges(kept_hashes(spark, d) if h is None else h, "doc_id", **bands(spark, d))


def crosstab(spark, d):
    """Pairs by source from the counted ones; those of one key, four rows at most, are looked at one by one."""
    rows, found = cells(spark, d)
    same = found.select((F.col("ka") == F.col("kb")).alias("same_split"), F.lit(False).alias("same_key"), "n")
    keyed = rows.withColumn("k", F.floor(F.col("doc_id") / 4))
    a, b = keyed.select("k", *[F.col(c).alias(f"{c}_a") for c in ("doc_id", "source", "hash")]), keyed.select("k", *[F.col(c).alias(f"{c}_b") for c in ("doc_id", "source", "hash")])
    of_key = a.join(b, "k").where((F.col("doc_id_a") < F.col("doc_id_b")) & (S.hamming(F.col("hash_a"), F.col("hash_b")) <= 7)).select((F.col("source_a") == F.col("source_b")).alias("same_split"))
    # What lies in one key moves from the one count to the other.
    moved = of_key.select("same_split", F.explode(F.array(F.struct(F.lit(True).alias("same_key"), F.lit(1).cast("bigint").alias("n")), F.struct(F.lit(False).alias("same_key"), F.lit(-1).cast("bigint").alias("n")))).alias("m")).select("same_split", "m.*")
    return same.union(moved).groupBy("same_split", "same_key").agg(F.sum("n").alias("n")).where("n > 0")


def within_group(spark, d, h=None):
    h = kept_hashes(spark, d) if h is None else h
    # Pairs up to 9 bits inside a source that the join up to 7, which has every pair up to 7 bits, has not found.
    rows = written(grouped_hashes(spark, d, h), "hashes")
    return X.pairs_in_groups(rows, "doc_id", "source", None, 9, **bands(spark, d, 9), above=7)


def near_components(spark, d):
    roots = components(edges(spark, d))
    members = roots.join(contents(spark, d).select(F.col("doc_id").alias("node"), "md5", "source"), "node")
    return members.groupBy("root").agg(S.content_id("near-", F.collect_list("md5")).alias("near_group"), F.count(F.lit(1)).alias("n_files"), (F.countDistinct("source") > 1).alias("crosses"))


def pictures(spark, d):
    """Vectors as grey values (0 to 255), each beside the next one of its label."""
    e = table(spark, d, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: F.rint((x.cast("double") + 1) * 127.5)).alias("px"))
    w = Window.partitionBy("label").orderBy("vec_id")
    return e.select("vec_id", "px", F.lead("vec_id").over(w).alias("next_id"), F.lead("px").over(w).alias("next_px")).where("next_id IS NOT NULL")


def ssim(spark, d):
    return pictures(spark, d).select("vec_id", "next_id", F.round(X.ssim_center(F.col("px"), F.col("next_px")), 6).alias("ssim_center"))


def hash_rows(kind):
    return lambda s, d: table(s, d, "embeddings").select("vec_id", S.hex16(kind(F.col("embedding"))).alias("hash"))


QUERIES = {
    "ahash_bits": hash_rows(X.average_hash),
    "dhash_bits": hash_rows(X.difference_hash),
    "simhash_bits": lambda s, d: hashes(s, d).select("doc_id", S.hex16(F.col("hash")).alias("hash")),
    "hamming_pairs_banded": pairs,
    "distance_histogram": histogram,
    "pair_combo_crosstab": crosstab,
    "within_group_new_pairs": within_group,
    "near_dup_components": near_components,
    "ssim_pairs": ssim,
    "ssim_buckets": lambda s, d: ssim(s, d).groupBy(X.ssim_bucket(F.col("ssim_center")).alias("bucket")).agg(F.count(F.lit(1)).alias("n"), F.min("ssim_center").alias("least"), F.max("ssim_center").alias("most")),
    "lowest_ssim": lambda s, d: ssim(s, d).orderBy("ssim_center", "vec_id").limit(10),
}

_BIT = lambda i: f"(('0x' || substr(md5(w), {1 + 8 * (i // 32)}, 8))::BIGINT >> {31 - i % 32}) & 1"
SIM_SQL = f"""
c AS MATERIALIZED (SELECT md5(text) AS md5, min(doc_id) AS doc_id FROM documents GROUP BY 1),
ct AS MATERIALIZED (SELECT c.doc_id, c.md5, text, source FROM c JOIN documents d ON c.doc_id = d.doc_id),
h AS MATERIALIZED (
  SELECT doc_id, {" || ".join(f"(CASE WHEN v{i} > 0 THEN '1' ELSE '0' END)" for i in range(64))} AS bits
  FROM (SELECT doc_id, {", ".join(f"sum(2 * ({_BIT(i)}) - 1) AS v{i}" for i in range(64))}
        FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), ' ')) AS w FROM ct) WHERE w <> '' GROUP BY doc_id)
),
hb AS MATERIALIZED (SELECT doc_id, bits::BIT AS b FROM h),
pr AS MATERIALIZED (SELECT x.doc_id AS a, y.doc_id AS b, bit_count(xor(x.b, y.b))::INT AS hamming FROM hb x JOIN hb y ON x.doc_id < y.doc_id WHERE bit_count(xor(x.b, y.b)) <= 9),
p7 AS (SELECT * FROM pr WHERE hamming <= 7)"""
_HEX = lambda bits: " || ".join(f"substr('0123456789abcdef', 1 + 8 * substr({bits}, {4 * k + 1}, 1)::INT + 4 * substr({bits}, {4 * k + 2}, 1)::INT + 2 * substr({bits}, {4 * k + 3}, 1)::INT + substr({bits}, {4 * k + 4}, 1)::INT, 1)" for k in range(16))
PX_SQL = """
px AS (SELECT vec_id, label, list_transform(embedding, lambda x: round_even((x::DOUBLE + 1) * 127.5, 0)) AS p FROM embeddings),
nx AS (SELECT vec_id, p, lead(vec_id) OVER w AS next_id, lead(p) OVER w AS q FROM px WINDOW w AS (PARTITION BY label ORDER BY vec_id)),
mo AS (SELECT vec_id, next_id, list_sum(p) / 64 AS ma, list_sum(q) / 64 AS mb, list_dot_product(p, p) / 64 AS aa, list_dot_product(q, q) / 64 AS bb, list_dot_product(p, q) / 64 AS ab FROM nx WHERE next_id IS NOT NULL),
ss AS (SELECT vec_id, next_id, round(((2 * ma * mb + 6.5025) * (2 * (ab - ma * mb) + 58.5225)) / ((ma * ma + mb * mb + 6.5025) * (aa - ma * ma + bb - mb * mb + 58.5225)), 6) AS ssim_center FROM mo)"""

SQL = {
    "ahash_bits": f"SELECT vec_id, {_HEX('bits')} AS hash FROM (SELECT vec_id, array_to_string(list_transform(embedding, lambda x: CASE WHEN x::DOUBLE >= m THEN '1' ELSE '0' END), '') AS bits FROM (SELECT vec_id, embedding, list_sum(list_transform(embedding, lambda x: x::DOUBLE)) / 64 AS m FROM embeddings))",
    "dhash_bits": f"SELECT vec_id, {_HEX('bits')} AS hash FROM (SELECT vec_id, array_to_string(list_transform(range(1, 65), lambda i: CASE WHEN embedding[i] > embedding[i % 64 + 1] THEN '1' ELSE '0' END), '') AS bits FROM embeddings)",
    "simhash_bits": f"WITH {SIM_SQL} SELECT doc_id, {_HEX('bits')} AS hash FROM h",
    "hamming_pairs_banded": f"WITH {SIM_SQL} SELECT * FROM p7",
    "distance_histogram": f"WITH {SIM_SQL} SELECT hamming, count(*) AS n FROM p7 GROUP BY 1",
    "pair_combo_crosstab": f"WITH {SIM_SQL} SELECT x.source = y.source AS same_split, a // 4 = p7.b // 4 AS same_key, count(*) AS n FROM p7 JOIN ct x ON x.doc_id = a JOIN ct y ON y.doc_id = p7.b GROUP BY 1, 2",
    "within_group_new_pairs": f"WITH {SIM_SQL} SELECT a, pr.b, hamming FROM pr JOIN ct x ON x.doc_id = a JOIN ct y ON y.doc_id = pr.b WHERE x.source = y.source AND hamming > 7",
    "near_dup_components": f"""WITH RECURSIVE {SIM_SQL}, e AS MATERIALIZED (SELECT a, b FROM p7 UNION ALL SELECT b, a FROM p7), r(node, root) AS (SELECT DISTINCT a, a FROM e UNION SELECT e.b, r.root FROM r JOIN e ON r.node = e.a),
      l AS (SELECT node, min(root) AS root FROM r GROUP BY node)
      SELECT root, 'near-' || substr(md5(string_agg(md5, '|' ORDER BY md5)), 1, 12) AS near_group, count(*) AS n_files, count(DISTINCT source) > 1 AS crosses FROM l JOIN ct ON ct.doc_id = node GROUP BY root""",
    "ssim_pairs": f"WITH {PX_SQL} SELECT * FROM ss",
    "ssim_buckets": f"WITH {PX_SQL} SELECT CASE WHEN ssim_center >= 1 - 1e-9 THEN '=1' WHEN ssim_center >= 0.9 THEN '>=.90' WHEN ssim_center >= 0.8 THEN '.80-.90' WHEN ssim_center >= 0.6 THEN '.60-.80' ELSE '<.60' END AS bucket, count(*) AS n, min(ssim_center) AS least, max(ssim_center) AS most FROM ss GROUP BY 1",
    "lowest_ssim": f"WITH {PX_SQL} SELECT * FROM ss ORDER BY ssim_center, vec_id LIMIT 10",
}
