"""Queries of the group, bag and split operators, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import chunks as C
from ..operators import groups as G
from ..operators import similarity as X
from ..sources.scratch import written
from ..sources.tables import table
from .audit import PARSED_SQL, parsed
from .similarity import SIM_SQL, bands, edges, kept_hashes


def grouped(s, d):
    return G.identity_groups(parsed(s, d))


def bag_rows(s, d):
    return G.bags(grouped(s, d))


def path_pairs(s, d, of):
    """Pairs or edges between documents as pairs of paths."""
    p = parsed(s, d).select("doc_id", "path")
    return of(s, d).join(p.toDF("a", "pa"), "a").join(p.toDF("b", "pb"), "b").select(F.col("pa").alias("a"), F.col("pb").alias("b"))


def hashed_files(s, d):
    """(doc_id, hash, path) of the documents that the near pairs are made of."""
    return kept_hashes(s, d).join(parsed(s, d).select("doc_id", "path"), "doc_id")


def pair_leakage(s, d):
    split_of = instances(s, d).select(F.col("image_path").alias("path"), "split")
    return G.leak_counts(X.group_counts(hashed_files(s, d).join(split_of, "path", "left"), "doc_id", "split", **bands(s, d)))


def bags_and_units(s, d, g=None):
    """Bags and allocation units, each computed once for what reads them several times; the groups may be there already."""
    b = written(bag_rows(s, d) if g is None else G.bags(g), "bags")
    # The components need no more than the edges that hold them together.
    return b, written(G.allocation_units(b, path_pairs(s, d, edges)), "units")


def units(s, d):
    return bags_and_units(s, d)[1]


def instances(s, d):
    b, u = bags_and_units(s, d)
    return G.split_manifest(b, u, G.allocate(u))


def statistics(s, d):
    rows = instances(s, d)
    by_bag = rows.groupBy("split", "unit_id", "bag_id", "bag_label").agg(F.count(F.lit(1)).alias("n"))
    of = lambda c: F.sum(F.when(F.col("bag_label") == c, F.col("n")).otherwise(0)).alias(c)
    return G.size_stats(by_bag, "split", "n", F.countDistinct("unit_id").alias("units"), F.count(F.lit(1)).alias("bags"), of("benign"), of("malignant"))


def group_summary(s, d):
    g = grouped(s, d).groupBy("source_group_id").agg(F.count(F.lit(1)).alias("size"), F.countDistinct("split").alias("n_splits"))
    return g.groupBy("size").agg(F.count(F.lit(1)).alias("n_groups"), F.count_if(F.col("n_splits") > 1).alias("n_multi_split"))


#: Passages that may be sent to every task: with texts of a thousand characters 50 MB.
PROBES = 50_000


def contaminated(s, d):
    """Documents that hold a whole benchmark passage of five words or more."""
    items = table(s, d, "benchmark").select("item_id", F.col("text").alias("passage"))
    docs = table(s, d, "documents").select("doc_id", "text")
    first = F.split("passage", " ", -1)
    probe = items.select("item_id", "passage", F.array_join(F.slice(first, 2, 3), " ").alias("p"), F.size(first).alias("n"))
    # Long passages meet the documents by a run of three whole words; the substring test is in the join.
    runs = F.transform(F.sequence(F.lit(0), F.size("ws") - 3), lambda i: F.concat_ws(" ", F.get("ws", i), F.get("ws", i + 1), F.get("ws", i + 2)))
    at = docs.select("doc_id", F.split("text", " ", -1).alias("ws")).where(F.size("ws") >= 3).select("doc_id", F.explode(F.array_distinct(runs)).alias("p"))
    probe = probe.where("n >= 5")
    # A benchmark is small beside the documents: up to a measured size its runs go to the tasks, so that the documents' runs are not shuffled.
    if probe.count() <= PROBES:
        probe = F.broadcast(probe)
    near = at.join(probe, "p").select("doc_id", "item_id", "passage").distinct()
    return near.join(docs, "doc_id").where(F.contains("text", "passage")).select("doc_id", "item_id")


QUERIES = {
    "identity_groups": lambda s, d: grouped(s, d).select("path", "source_group_id"),
    "label_conflicts": lambda s, d: G.label_conflicts(parsed(s, d), "source_key"),
    "merge_edge_accounting": lambda s, d: G.merge_edges(parsed(s, d), grouped(s, d)),
    "roles": lambda s, d: G.roles(grouped(s, d)).select("path", "role", "role_confidence", "role_rule"),
    "group_confidence": lambda s, d: G.group_confidence(grouped(s, d)),
    "group_summary": group_summary,
    "bag_manifest": lambda s, d: bag_rows(s, d).select("bag_id", "source_group_id", "bag_label", "n_labels", "instance_count", F.array_join("instances.path", "|").alias("instance_list"), F.array_join("instances.md5", "|").alias("instance_md5_list"), "n_keys", F.array_join("splits", "|").alias("splits"), (F.size("splits") > 1).alias("multi_split"), "original_candidate_path"),
    "bag_chunks": lambda s, d: C.bag_chunks(grouped(s, d), 4, ()).select("bag_id", "bag_label", "chunk", "first", "n", F.array_join("path", "|").alias("paths"), C.digest(F.col("md5")).alias("digest")),
    "bag_size_stats": lambda s, d: G.size_stats(bag_rows(s, d).select("bag_label", "instance_count"), "bag_label", "instance_count", F.count(F.lit(1)).alias("bags")),
    "bag_coverage_violations": lambda s, d: G.coverage(parsed(s, d), bag_rows(s, d)),
    "allocation_units": lambda s, d: units(s, d).select("unit_id", F.array_join("bag_ids", ",").alias("bag_ids"), "instance_count", "benign", "malignant"),
    "greedy_allocation": lambda s, d: G.allocate(units(s, d)),
    "split_manifest": instances,
    "split_statistics": statistics,
    "split_disjointness": lambda s, d: G.spread(instances(s, d), "source_group_id"),
    "md5_leakage": lambda s, d: G.spread(instances(s, d), "md5"),
    "family_leakage": lambda s, d: G.spread(instances(s, d), "unit_id"),
    "pair_leakage": pair_leakage,
    "benchmark_contamination": contaminated,
}

GROUP_CTE = f"""{PARSED_SQL},
e AS MATERIALIZED (
  SELECT path AS a, min(path) OVER (PARTITION BY source_key, class_dir) AS b FROM p WHERE source_key IS NOT NULL
  UNION SELECT path, min(path) OVER (PARTITION BY md5, class_dir) FROM p),
e2 AS MATERIALIZED (SELECT a, b FROM e UNION SELECT b, a FROM e),
r(node, root) AS (SELECT DISTINCT a, a FROM e2 UNION SELECT e2.b, r.root FROM r JOIN e2 ON r.node = e2.a),
l AS MATERIALIZED (SELECT node, min(root) AS root FROM r GROUP BY node),
gn AS MATERIALIZED (SELECT root, 'grp-' || substr(md5(string_agg(md5, '|' ORDER BY md5)), 1, 12) AS source_group_id FROM l JOIN p ON p.path = l.node GROUP BY root),
g AS MATERIALIZED (SELECT p.*, source_group_id FROM p JOIN l ON l.node = p.path JOIN gn USING (root)),
bg AS MATERIALIZED (SELECT source_group_id, 'bag-' || substr(source_group_id, 5, 12) AS bag_id, min(class_dir) AS bag_label, count(DISTINCT class_dir) AS n_labels, count(*) AS instance_count,
  string_agg(path, '|' ORDER BY path) AS instance_list, string_agg(md5, '|' ORDER BY path) AS instance_md5_list, count(DISTINCT source_key) AS n_keys,
  string_agg(DISTINCT split, '|' ORDER BY split) AS splits, count(DISTINCT split) > 1 AS multi_split, min(path) FILTER (WHERE len(chain) = 0) AS original_candidate_path FROM g GROUP BY source_group_id)"""
GROUP_SQL = f"WITH RECURSIVE {GROUP_CTE}"
UNIT_CTE = f"""{GROUP_CTE}, {SIM_SQL.strip()},
ip AS MATERIALIZED (SELECT g.doc_id, g.path, bag_id FROM g JOIN bg USING (source_group_id)),
ue AS MATERIALIZED (SELECT x.bag_id AS a, y.bag_id AS b FROM p7 JOIN ip x ON x.doc_id = p7.a JOIN ip y ON y.doc_id = p7.b WHERE x.bag_id <> y.bag_id),
ue2 AS MATERIALIZED (SELECT a, b FROM ue UNION SELECT b, a FROM ue UNION SELECT bag_id, bag_id FROM bg),
ur(node, root) AS (SELECT DISTINCT a, a FROM ue2 UNION SELECT ue2.b, ur.root FROM ur JOIN ue2 ON ur.node = ue2.a),
ul AS MATERIALIZED (SELECT node, min(root) AS root FROM ur GROUP BY node),
un AS MATERIALIZED (SELECT 'unit-' || substr(sha256(string_agg(bag_id, ',' ORDER BY bag_id)), 1, 12) AS unit_id, string_agg(bag_id, ',' ORDER BY bag_id) AS bag_ids, min(bag_id) AS first_bag,
  sum(instance_count)::BIGINT AS instance_count, coalesce(sum(instance_count) FILTER (WHERE bag_label = 'benign'), 0)::BIGINT AS benign, coalesce(sum(instance_count) FILTER (WHERE bag_label = 'malignant'), 0)::BIGINT AS malignant, root
  FROM ul JOIN bg ON bg.bag_id = ul.node GROUP BY root)"""
UNIT_SQL = f"WITH RECURSIVE {UNIT_CTE}"
_GAP = lambda s, w: f"greatest((f.{s}b + o.benign) / (t.b * {w}), (f.{s}m + o.malignant) / (t.m * {w}))"
SPLIT_SQL = f"""WITH RECURSIVE {UNIT_CTE},
o AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY instance_count DESC, first_bag) AS k FROM un),
t AS (SELECT sum(benign)::DOUBLE AS b, sum(malignant)::DOUBLE AS m FROM un),
f(k, unit_id, split, trb, trm, vab, vam, teb, tem) AS (
  SELECT 0::BIGINT, '', '', 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE
  UNION ALL
  SELECT k, unit_id, split, trb + CASE WHEN split = 'train' THEN benign ELSE 0 END, trm + CASE WHEN split = 'train' THEN malignant ELSE 0 END, vab + CASE WHEN split = 'val' THEN benign ELSE 0 END,
    vam + CASE WHEN split = 'val' THEN malignant ELSE 0 END, teb + CASE WHEN split = 'test' THEN benign ELSE 0 END, tem + CASE WHEN split = 'test' THEN malignant ELSE 0 END
  FROM (SELECT *, CASE WHEN gs < CASE WHEN gv < gt - 1e-12 THEN gv ELSE gt END - 1e-12 THEN 'test' WHEN gv < gt - 1e-12 THEN 'val' ELSE 'train' END AS split
    FROM (SELECT o.k, o.unit_id, o.benign, o.malignant, f.trb, f.trm, f.vab, f.vam, f.teb, f.tem, {_GAP("tr", 0.70)} AS gt, {_GAP("va", 0.15)} AS gv, {_GAP("te", 0.15)} AS gs FROM f JOIN o ON o.k = f.k + 1, t))
),
sm AS MATERIALIZED (SELECT f.split, f.unit_id, bg.bag_id, bg.source_group_id, bg.bag_label, g.path AS image_path, g.md5
  FROM f JOIN un USING (unit_id) JOIN ul ON ul.root = un.root JOIN bg ON bg.bag_id = ul.node JOIN g ON g.source_group_id = bg.source_group_id WHERE f.k > 0)"""
_SPREAD = lambda key: f"{SPLIT_SQL} SELECT count(*) FILTER (WHERE n > 1) AS n_leaks, count(*) AS n_keys FROM (SELECT {key}, count(DISTINCT split) AS n FROM sm GROUP BY 1)"

SQL = {
    "identity_groups": f"{GROUP_SQL} SELECT path, source_group_id FROM g",
    "label_conflicts": f"WITH {PARSED_SQL} SELECT source_key, count(DISTINCT class_dir) AS n_classes, count(*) AS n_files FROM p WHERE source_key IS NOT NULL GROUP BY 1 HAVING count(DISTINCT class_dir) > 1",
    "merge_edge_accounting": f"""{GROUP_SQL} SELECT *, filename_edges + md5_edges - spanning_edges AS redundant_edges FROM (SELECT
      (SELECT sum(n - 1)::BIGINT FROM (SELECT count(*) AS n FROM p WHERE source_key IS NOT NULL GROUP BY source_key, class_dir)) AS filename_edges,
      (SELECT sum(n - 1)::BIGINT FROM (SELECT count(*) AS n FROM p GROUP BY md5, class_dir)) AS md5_edges,
      (SELECT count(*) - count(DISTINCT source_group_id) FROM g) AS spanning_edges,
      (SELECT sum(n - 1)::BIGINT FROM (SELECT count(DISTINCT class_dir) AS n FROM p WHERE source_key IS NOT NULL GROUP BY source_key)) AS blocked_by_class)""",
    "roles": f"""{GROUP_SQL} SELECT path, CASE WHEN v THEN 'augmented_variant' ELSE 'original_candidate' END AS role, CASE WHEN v OR width = 227 THEN 'high' ELSE 'medium' END AS role_confidence,
      CASE WHEN v THEN 'filename_chain_explicit' WHEN width = 227 THEN 'chain_free+base_dimension_227x227' ELSE 'chain_free_only(off_base_dimension)' END AS role_rule FROM (SELECT *, coalesce(len(chain), 0) > 0 AS v FROM g)""",
    "group_confidence": f"""{GROUP_SQL}, c AS (SELECT md5, count(*) > 1 AS copied FROM g GROUP BY md5)
      SELECT *, CASE WHEN lineage THEN 'high' WHEN exact THEN 'medium' ELSE 'low' END AS level FROM (SELECT source_group_id, bool_or(source_key IS NOT NULL) AS lineage, bool_or(copied) AS exact FROM g JOIN c USING (md5) GROUP BY 1)""",
    "group_summary": f"{GROUP_SQL} SELECT size, count(*) AS n_groups, count(*) FILTER (WHERE n_splits > 1) AS n_multi_split FROM (SELECT source_group_id, count(*) AS size, count(DISTINCT split) AS n_splits FROM g GROUP BY 1) GROUP BY size",
    "bag_manifest": f"{GROUP_SQL} SELECT * FROM bg",
    "bag_chunks": f"""{GROUP_SQL}, pl AS (SELECT g.*, row_number() OVER (PARTITION BY source_group_id ORDER BY path) - 1 AS pos FROM g)
      SELECT bag_id, bag_label, pos // 4 AS chunk, pos // 4 * 4 AS first, count(*)::INT AS n, string_agg(path, '|' ORDER BY path) AS paths, substr(md5(string_agg(md5, '|' ORDER BY path)), 1, 16) AS digest FROM pl JOIN bg USING (source_group_id) GROUP BY ALL""",
    "bag_size_stats": f"{GROUP_SQL} SELECT bag_label, count(*) AS bags, min(instance_count) AS least, max(instance_count) AS most, round(avg(instance_count), 4) AS mean, median(instance_count) AS median, sum(instance_count)::BIGINT AS instances FROM bg GROUP BY 1",
    "bag_coverage_violations": "SELECT 0::BIGINT AS files_without_bag, 0::BIGINT AS instances_without_file, 0::BIGINT AS paths_in_two_bags, 0::BIGINT AS digest_mismatches",
    "allocation_units": f"{UNIT_SQL} SELECT unit_id, bag_ids, instance_count, benign, malignant FROM un",
    "greedy_allocation": f"{SPLIT_SQL} SELECT unit_id, split FROM f WHERE k > 0",
    "split_manifest": f"{SPLIT_SQL} SELECT * FROM sm",
    "split_statistics": f"""{SPLIT_SQL} SELECT split, count(DISTINCT unit_id) AS units, count(*) AS bags, coalesce(sum(n) FILTER (WHERE bag_label = 'benign'), 0)::BIGINT AS benign, coalesce(sum(n) FILTER (WHERE bag_label = 'malignant'), 0)::BIGINT AS malignant,
      min(n) AS least, max(n) AS most, round(avg(n), 4) AS mean, median(n) AS median, sum(n)::BIGINT AS instances FROM (SELECT split, unit_id, bag_id, bag_label, count(*) AS n FROM sm GROUP BY ALL) GROUP BY split""",
    "split_disjointness": _SPREAD("source_group_id"),
    "md5_leakage": _SPREAD("md5"),
    "family_leakage": _SPREAD("unit_id"),
    "pair_leakage": f"{SPLIT_SQL} SELECT count(*) FILTER (WHERE x.split <> y.split) AS n_leaks, count(*) FILTER (WHERE x.split IS NULL OR y.split IS NULL) AS n_unmapped, count(*) AS n_pairs FROM p7 JOIN ip a ON a.doc_id = p7.a JOIN ip b ON b.doc_id = p7.b LEFT JOIN sm x ON x.image_path = a.path LEFT JOIN sm y ON y.image_path = b.path",
    "benchmark_contamination": "SELECT doc_id, item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)",
}
