"""Queries of the audit operators over the input tables, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import audit as A
from ..sources.tables import KNOWN_OPS, MANIFEST_SQL, manifest, table

PARSED_SQL = MANIFEST_SQL + r""",
p AS (
  SELECT *, CASE WHEN ok THEN regexp_extract(name, '^([A-Za-z]+ \(\d+\))((?:-[A-Za-z0-9 ]+)*)$', 1) END AS source_key,
    CASE WHEN ok THEN CASE WHEN tail = '' THEN []::VARCHAR[] ELSE string_split(substr(tail, 2), '-') END END AS chain
  FROM (SELECT *, regexp_matches(name, '^([A-Za-z]+ \(\d+\))((?:-[A-Za-z0-9 ]+)*)$') AS ok, regexp_extract(name, '^([A-Za-z]+ \(\d+\))((?:-[A-Za-z0-9 ]+)*)$', 2) AS tail FROM m)
)"""


def parsed(spark, d):
    return A.parse_names(manifest(spark, d), KNOWN_OPS)


URL = r"^(https?)://([^/]+)/([a-z]{2})/(\d+)(/|\.html)?(\?[^#]*)?(#.*)?$"


def url_grammar(spark, d):
    u = F.col("url")
    part = lambda k: F.regexp_extract(u, URL, k)
    marks = F.array(F.when(part(5) == ".html", "html"), F.when(part(5) == "/", "slash"), F.when(part(6) != "", "query"), F.when(part(7) != "", "frag"))
    return table(spark, d, "pages").select(
        "page_id", F.when(u.rlike(URL), part(2)).alias("host"), F.when(u.rlike(URL), F.concat(part(3), F.lit(" ("), part(4), F.lit(")"))).alias("source_key"),
        F.when(u.rlike(URL), F.array_join(F.array_compact(marks), "|")).alias("chain"), u.rlike(URL).alias("stem_parsed"),
    )


HINTS = ("thesh", "onand", "queré", "lichkeit", "ciónes")

QUERIES = {
    "manifest_scan": lambda s, d: manifest(s, d),
    "last_row_wins": lambda s, d: A.last_by_key(manifest(s, d).select("md5", "path", "split"), "md5", "path"),
    "name_grammar": lambda s, d: parsed(s, d).select("path", "source_key", F.array_join("chain", "|").alias("chain"), F.array_join("unknown_ops", "|").alias("unknown_ops"), "depth", "stem_parsed"),
    "url_grammar": url_grammar,
    "lineage_class": lambda s, d: A.lineage(parsed(s, d)).select("path", "source_key", "lineage_class"),
    "exact_duplicate_groups": lambda s, d: A.exact_duplicates(manifest(s, d)),
    "dup_size_histogram": lambda s, d: A.exact_duplicates(manifest(s, d)).groupBy("n_files").agg(F.count(F.lit(1)).alias("n_groups")),
    "cross_split_dups": lambda s, d: A.exact_duplicates(manifest(s, d)).where("crosses").select("duplicate_group", "n_files", "n_splits"),
    "frequency_tables": lambda s, d: A.frequencies(manifest(s, d), {"split_class": F.concat_ws("/", "split", "class_dir"), "dims": F.concat_ws("x", "width", "height"), "read_ok": F.col("read_ok"), "kilobytes": F.floor(F.col("bytes") / 1024)}),
    "top_dimensions": lambda s, d: manifest(s, d).groupBy("width", "height").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "width", "height").limit(5),
    "key_split_overlap": lambda s, d: A.key_overlap(parsed(s, d)),
    "vocab_scan": lambda s, d: A.vocabulary_scan(table(s, d, "documents"), "text", HINTS, ".dcm"),
    "dataset_fingerprint": lambda s, d: A.fingerprint(manifest(s, d)),
    "dataset_fingerprint_tree": lambda s, d: A.fingerprint_tree(manifest(s, d), A.tree_digits(table(s, d, "documents").count())),
    "dataset_provenance": lambda s, d: manifest(s, d).agg(F.count(F.lit(1)).alias("n_files"), F.sum("bytes").alias("n_bytes"), F.countDistinct("md5").alias("n_md5"), F.countDistinct("class_dir").alias("n_classes"), F.min("path").alias("first_path"), F.max("path").alias("last_path")),
}

DUPS = f"WITH {MANIFEST_SQL}, g AS (SELECT 'exact-' || substr(md5, 1, 12) AS duplicate_group, md5, count(*) AS n_files, count(DISTINCT split) AS n_splits FROM m GROUP BY md5 HAVING count(*) > 1)"

SQL = {
    "manifest_scan": f"WITH {MANIFEST_SQL} SELECT * FROM m",
    "last_row_wins": f"WITH {MANIFEST_SQL} SELECT md5, path, split FROM (SELECT *, row_number() OVER (PARTITION BY md5 ORDER BY path DESC) AS rn FROM m) WHERE rn = 1",
    "name_grammar": f"WITH {PARSED_SQL} SELECT path, source_key, array_to_string(chain, '|') AS chain, array_to_string(list_filter(chain, lambda x: x NOT IN ('rotated1', 'rotated2', 'sharpened')), '|') AS unknown_ops, len(chain)::BIGINT AS depth, chain IS NOT NULL AS stem_parsed FROM p",
    "url_grammar": r"""SELECT page_id, CASE WHEN ok THEN regexp_extract(url, r, 2) END AS host, CASE WHEN ok THEN regexp_extract(url, r, 3) || ' (' || regexp_extract(url, r, 4) || ')' END AS source_key,
      CASE WHEN ok THEN concat_ws('|', CASE regexp_extract(url, r, 5) WHEN '.html' THEN 'html' WHEN '/' THEN 'slash' END, CASE WHEN regexp_extract(url, r, 6) <> '' THEN 'query' END, CASE WHEN regexp_extract(url, r, 7) <> '' THEN 'frag' END) END AS chain, ok AS stem_parsed
      FROM (SELECT *, '^(https?)://([^/]+)/([a-z]{2})/(\d+)(/|\.html)?(\?[^#]*)?(#.*)?$' AS r, regexp_matches(url, '^(https?)://([^/]+)/([a-z]{2})/(\d+)(/|\.html)?(\?[^#]*)?(#.*)?$') AS ok FROM pages)""".replace("regexp_extract(url, r,", r"regexp_extract(url, '^(https?)://([^/]+)/([a-z]{2})/(\d+)(/|\.html)?(\?[^#]*)?(#.*)?$',"),
    "lineage_class": f"WITH {PARSED_SQL} SELECT path, source_key, CASE WHEN chain IS NULL THEN 'unparsed' WHEN len(chain) > 0 THEN 'confirmed' WHEN source_key IN (SELECT source_key FROM p WHERE len(chain) > 0) THEN 'strong' ELSE 'candidate' END AS lineage_class FROM p",
    "exact_duplicate_groups": f"{DUPS} SELECT *, n_splits > 1 AS crosses FROM g",
    "dup_size_histogram": f"{DUPS} SELECT n_files, count(*) AS n_groups FROM g GROUP BY n_files",
    "cross_split_dups": f"{DUPS} SELECT duplicate_group, n_files, n_splits FROM g WHERE n_splits > 1",
    "frequency_tables": f"""WITH {MANIFEST_SQL} SELECT dimension, value, count(*) AS n FROM (
      SELECT 'split_class' AS dimension, split || '/' || class_dir AS value FROM m UNION ALL SELECT 'dims', width || 'x' || height FROM m
      UNION ALL SELECT 'read_ok', read_ok::VARCHAR FROM m UNION ALL SELECT 'kilobytes', (bytes // 1024)::VARCHAR FROM m) GROUP BY 1, 2""",
    "top_dimensions": f"WITH {MANIFEST_SQL} SELECT width, height, count(*) AS n FROM m GROUP BY 1, 2 ORDER BY n DESC, width, height LIMIT 5",
    "key_split_overlap": f"""WITH {PARSED_SQL}, c AS (SELECT md5, count(*) > 1 AS copied FROM m GROUP BY md5),
      b AS (SELECT source_key, array_to_string(chain, '|') AS ct, count(DISTINCT split) AS n FROM p WHERE source_key IS NOT NULL GROUP BY 1, 2)
      SELECT p.source_key, string_agg(DISTINCT split, '|' ORDER BY split) AS splits, count(*) FILTER (WHERE split = 'train') AS train_files, count(*) FILTER (WHERE split = 'val') AS val_files,
        (SELECT coalesce(string_agg(ct, ',' ORDER BY ct), '') FROM b WHERE b.source_key = p.source_key AND b.n > 1) AS shared_chains, bool_or(copied) AS has_exact_duplicate_member
      FROM p JOIN c USING (md5) WHERE p.source_key IS NOT NULL GROUP BY p.source_key HAVING count(DISTINCT split) > 1""",
    "vocab_scan": f"SELECT n_hits, n_names, CASE WHEN n_hits > 0 THEN 'B' ELSE 'C' END AS state FROM (SELECT count(*) FILTER (WHERE regexp_matches(lower(text), '{'|'.join(HINTS)}') OR ends_with(lower(text), '.dcm')) AS n_hits, count(*) AS n_names FROM documents)",
    "dataset_fingerprint": f"WITH {MANIFEST_SQL} SELECT sha256(string_agg(path || ':' || bytes || ':' || md5 || chr(10), '' ORDER BY path)) AS fingerprint, count(*) AS n_files FROM m",
    "dataset_fingerprint_tree": f"WITH {MANIFEST_SQL}, b AS (SELECT substr(md5(path), 1, 2) AS bucket, sha256(string_agg(path || ':' || bytes || ':' || md5 || chr(10), '' ORDER BY path)) AS digest, count(*) AS n FROM m GROUP BY 1) SELECT sha256(string_agg(digest, '' ORDER BY bucket)) AS fingerprint, sum(n)::BIGINT AS n_files FROM b",
    "dataset_provenance": f"WITH {MANIFEST_SQL} SELECT count(*) AS n_files, sum(bytes)::BIGINT AS n_bytes, count(DISTINCT md5) AS n_md5, count(DISTINCT class_dir) AS n_classes, min(path) AS first_path, max(path) AS last_path FROM m",
}
