"""Hand-computed cases, properties and edge cases of the core operators."""

import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from lodestone.functions import scalar as S
from lodestone.operators import arrays as R
from lodestone.operators import audit as A
from lodestone.operators import evaluate as E
from lodestone.operators import explain as X
from lodestone.operators import groups as G
from lodestone.operators import integrity as I
from lodestone.operators import mil as M
from lodestone.operators import similarity as Y
from lodestone.operators import graph
from lodestone.operators.graph import components
from lodestone.sources.scratch import written


def scored(spark, y, p):
    return E.predicted(spark.createDataFrame([(i, a, float(b)) for i, (a, b) in enumerate(zip(y, p))], "id int, y_true int, probability double"))


def metrics(spark, y, p):
    return E.with_ratios(E.confusion()(scored(spark, y, p))).first()


def test_metrics(spark):
    r = metrics(spark, [0, 0, 1, 1, 1, 0, 1, 0], [0, 1, 0, 1, 1, 0, 1, 0])
    assert (r.tp, r.fn, r.tn, r.fp) == (3, 1, 3, 1)
    assert {r[k] for k in E.RATIOS} == {0.75} and r.undefined == ""


def test_undefined_metrics(spark):
    r = metrics(spark, [0, 0], [0.2, 0.8])
    assert r.sensitivity is None and "sensitivity" in r.undefined
    assert metrics(spark, [1, 1], [0, 1]).specificity is None
    assert E.areas(scored(spark, [0, 0], [0.2, 0.8]), []).first().roc_auc is None


@pytest.mark.parametrize(("y", "p", "roc", "ap"), [([0, 0, 1, 1], [0.1, 0.1, 0.8, 0.9], 1, 1), ([0, 1, 1, 0], [0.5, 0.9, 0.4, 0.2], 0.75, 0.833333)])
def test_areas(spark, y, p, roc, ap):
    assert tuple(E.areas(scored(spark, y, p), []).first()) == (roc, ap)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 1), st.integers(0, 6)), min_size=1, max_size=30))
def test_areas_match_pairs(spark, rows):
    y, p = [a for a, _ in rows], [b / 6 for _, b in rows]
    pos, neg = [q for a, q in zip(y, p) if a], [q for a, q in zip(y, p) if not a]
    got = E.areas(scored(spark, y, p), []).first().roc_auc
    want = sum((a > b) + (a == b) / 2 for a in pos for b in neg) / (len(pos) * len(neg)) if pos and neg else None
    assert got == want or math.isclose(got, want, abs_tol=1e-6)


def test_thresholds_and_margins(spark):
    rows = spark.createDataFrame([(x,) for x in (0.4999999999, 0.5, 0.5000000001, 0.4, 0.6, 0.39, 0.3999999, 0.61)], "p double")
    got = [tuple(r) for r in rows.select((F.col("p") >= 0.5).cast("int"), S.is_uncertain(F.col("p"))).collect()]
    assert [g[0] for g in got[:3]] == [0, 1, 1] and [g[1] for g in got] == [True] * 5 + [False] * 3


def test_top_k(spark):
    rows = spark.createDataFrame([("b", i, w) for i, w in enumerate((0.05, 0.4, 0.4, 0.15))], "bag string, i int, w double")
    assert [r.i for r in X.top_k(rows, "bag", "w", "i", 3).orderBy("rank").collect()] == [1, 2, 3]
    assert X.top_k(rows, "bag", "w", "i", 99).count() == 4
    with pytest.raises(ValueError):
        X.top_k(rows, "bag", "w", "i", 0)


def test_disagreement(spark):
    a, b = scored(spark, [0, 1], [0.2, 0.9]), scored(spark, [0, 1], [0.7, 0.1])
    assert E.disagreements(a, b, "id").count() == 2 and E.disagreements(a, a, "id").count() == 0


def test_names(spark):
    rows = spark.createDataFrame([("benign (1)",), ("benign (1)-rotated1-zz",), ("nothing",), (None,)], "name string")
    got = [(r.source_key, r.chain, r.unknown_ops) for r in A.parse_names(rows, ["rotated1"]).collect()]
    assert got == [("benign (1)", [], []), ("benign (1)", ["rotated1", "zz"], ["zz"]), (None, None, None), (None, None, None)]


def test_softmax(spark):
    rows = spark.createDataFrame([(b, i, float(s)) for b, n in enumerate((1, 2, 14, 53)) for i, s in enumerate(np.random.default_rng(b).normal(0, 30, n))], "bag int, i int, s double")
    got = M.softmax(rows, "bag", "s").groupBy("bag").agg(F.sum("attention").alias("t"), F.count(F.lit(1)).alias("n"), F.max("attention").alias("m")).collect()
    assert all(abs(r.t - 1) < 1e-9 for r in got) and next(r.m for r in got if r.n == 1) == 1.0


def test_quantize(spark):
    one = spark.range(1).select(R.quantize(F.array(F.lit(0.0), F.lit(1.0)), 0.316515, 0.245010).alias("q")).first().q
    assert one == [27477, 44194]
    with pytest.raises(PySparkException):
        spark.range(1).select(R.quantize(F.array(F.lit(1e9)), 0.0, 1.0)).collect()


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), max_size=40))
def test_components(spark, edges):
    root = {n: n for e in edges for n in e}
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a int, b int")).collect()))
    assert all(got.get(n, n) == r for n, r in root.items())


def test_long_chain(spark):
    n = 300
    got = components(spark.range(n).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")))
    assert got.count() == n + 1 and got.where("root <> 0").count() == 0


@pytest.mark.parametrize("kind", ["int", "string"])
def test_components_of_many_slices(spark, monkeypatch, kind):
    """A path in no order, a hub and triangles, with slices far smaller than the graph: few rounds, least roots."""
    monkeypatch.setattr(graph, "SLICE", 100)
    n, rounds, rng = 3000, [], np.random.default_rng(3)
    ids = rng.permutation(n)
    path = list(zip(ids[:-1].tolist(), ids[1:].tolist()))
    hub = [(10000, 10000 + k) for k in range(1, 1000)]
    small = [e for k in range(20000, 20600, 3) for e in ((k, k + 1), (k + 1, k + 2), (k + 2, k))]
    edges = [(a, b) if rng.random() < 0.5 else (b, a) for a, b in path + hub + small]
    rng.shuffle(edges)
    name = (lambda x: f"n{int(x):06d}") if kind == "string" else int
    rows = spark.createDataFrame([(name(a), name(b)) for a, b in edges], f"a {kind}, b {kind}").repartition(7)
    want = {name(k): name(0) for k in range(n)} | {name(10000 + k): name(10000) for k in range(1000)} | {name(k): name(20000 + (k - 20000) // 3 * 3) for k in range(20000, 20600)}
    got = components(rows, rounds).collect()
    assert len(got) == len(want) and {r.node: r.root for r in got} == want
    # Every round leaves half of the edges at most, the last one a slice.
    assert len(rounds) <= math.log2(len(edges)) and all(b <= a / 2 for a, b in zip(rounds, rounds[1:])) and rounds[-1] <= 100


def test_forest_is_bounded_by_nodes(spark, monkeypatch):
    """A dense graph shrinks to less than its nodes in each task before anything is shuffled."""
    rng = np.random.default_rng(1)
    edges = spark.createDataFrame([(int(a), int(b)) for a, b in rng.integers(0, 60, (5000, 2))], "a int, b int").coalesce(2)
    assert graph.forests(edges).count() <= 2 * 59


def test_banded_pairs(spark):
    rng = np.random.default_rng(1)
    base = rng.integers(-(2**63), 2**63, 12, dtype=np.int64)
    h = np.concatenate([base, *[base ^ np.int64(1 << int(rng.integers(0, 63))) ^ np.int64(1 << int(rng.integers(0, 63))) for _ in range(3)], base[:2]])
    rows = spark.createDataFrame([(i, int(x)) for i, x in enumerate(h)], "id int, hash long")
    got = sorted(map(tuple, Y.banded_pairs(rows, "id").collect()))
    u = h.view(np.uint64)
    want = [(i, j, int(np.bitwise_count(u[i] ^ u[j]))) for i in range(len(u)) for j in range(i + 1, len(u)) if np.bitwise_count(u[i] ^ u[j]) <= 7]
    assert got == want
    with pytest.raises(ValueError):
        Y.banded_pairs(rows, "id", most=8)


@pytest.mark.parametrize(("n", "most"), [(10, 7), (10**5, 7), (10**7, 7), (10**9, 7), (10**4, 9), (10**9, 9)])
def test_band_plans(spark, n, most):
    rng = np.random.default_rng(n % 97)
    base = np.repeat(rng.integers(-(2**63), 2**63, 6, dtype=np.int64), 4)
    for k in range(len(base)):
        for bit in rng.integers(0, 64, k % 6):
            base[k] ^= np.int64(-(2**63)) if bit == 63 else np.int64(1 << int(bit))
    rows = spark.createDataFrame([(i, i % 2, int(x)) for i, x in enumerate(base)], "id int, g int, hash long")
    u = base.view(np.uint64)
    want = [(i, j, int(np.bitwise_count(u[i] ^ u[j]))) for i in range(len(u)) for j in range(i + 1, len(u)) if np.bitwise_count(u[i] ^ u[j]) <= most]
    plan = Y.band_plan(n, most)
    assert sorted(map(tuple, Y.banded_pairs(rows.drop("g"), "id", most, **plan).collect())) == want
    none = rows.select(F.col("id").alias("a"), F.col("id").alias("b")).limit(0)
    assert sorted(map(tuple, Y.pairs_in_groups(rows, "id", "g", none, most, **plan).collect())) == [p for p in want if p[0] % 2 == p[1] % 2]


def test_class_guard(spark):
    rows = spark.createDataFrame([("a", "k", "benign", "1"), ("b", "k", "malignant", "2"), ("c", "k", "benign", "3"), ("d", None, "benign", "3"), ("e", None, "benign", "4")], "path string, source_key string, class_dir string, md5 string")
    got = {r.path: r.source_group_id for r in G.identity_groups(rows).collect()}
    assert got["a"] == got["c"] == got["d"] and len(set(got.values())) == 3


def test_early_stopping(spark):
    log = spark.createDataFrame([(i, v) for i, v in enumerate((0.5, 0.7, 0.7, 0.6, 0.65))], "epoch int, auc double")
    got = X.early_stopping(log, "epoch", "auc", 3).orderBy("epoch").collect()
    assert [r.improved for r in got] == [True, True, False, False, False] and [r.stopped for r in got] == [False] * 4 + [True]


def test_empty_tables(spark):
    none = spark.createDataFrame([], "id int, y_true int, probability double")
    assert E.roc_points(E.predicted(none), []).count() == 0
    assert components(spark.createDataFrame([], "a int, b int")).count() == 0
    assert Y.banded_pairs(spark.createDataFrame([], "id int, hash long"), "id").count() == 0


def test_dangling_keys_raise(spark):
    bag_of = spark.createDataFrame([("x", "b1"), ("y", "b2")], "path string, bag_id string")
    pairs = spark.createDataFrame([("x", "y")], "a string, b string")
    assert [tuple(r) for r in I.pairs_to_bags(pairs, bag_of).collect()] == [("x", "y", "b1", "b2")]
    for bad in (spark.createDataFrame([("x", "z")], pairs.schema), spark.createDataFrame([("x", None)], pairs.schema)):
        with pytest.raises(PySparkException):
            I.pairs_to_bags(bad, bag_of).collect()
    with pytest.raises(PySparkException):
        I.pairs_to_bags(pairs, bag_of.union(bag_of.limit(1))).collect()


def test_validated_instances_raise(spark):
    splits = spark.createDataFrame([("train", "b1", "p1", "m1", "benign")], "split string, bag_id string, image_path string, md5 string, bag_label string")
    files = spark.createDataFrame([("p1", "m1", 1, 1)], "path string, md5 string, width int, height int")
    bags = spark.createDataFrame([("b1", "benign", 1)], "bag_id string, bag_label string, instance_count int")
    assert I.validated_instances(splits, files, bags).count() == 1
    for broken in ((splits.union(splits), files, bags), (splits, files.where("path = 'q'"), bags), (splits, files.withColumn("md5", F.lit("m2")), bags), (splits, files, bags.withColumn("bag_label", F.lit("malignant"))), (splits, files, bags.limit(0))):
        with pytest.raises(PySparkException):
            I.validated_instances(*broken).collect()


def test_guards_raise(spark):
    found = spark.createDataFrame([(0.3165, 0.245)], "mean double, std double")
    assert I.drift_guard(found, {"mean": 0.3165, "std": 0.245}).count() == 2
    with pytest.raises(PySparkException):
        I.drift_guard(found, {"mean": 0.3165, "std": 0.2451}).collect()
    rows = spark.createDataFrame([(1,), (None,)], "v int")
    with pytest.raises(PySparkException):
        I.assert_none(I.violations({"v is one": (rows, F.col("v") != 1)})).collect()
    with pytest.raises(PySparkException):
        I.unique_by(spark.createDataFrame([("a/b",), ("a/b",)], "p string"), "p").collect()


def test_allocation_by_hand(spark):
    units = spark.createDataFrame([(f"u{i}", [f"b{i:02d}"], n, b, n - b) for i, (n, b) in enumerate([(40, 20), (30, 10), (20, 20), (10, 0), (10, 5), (5, 5), (1, 0)])], "unit_id string, bag_ids array<string>, instance_count int, benign int, malignant int")
    total, fill, want = (60, 56), {s: [0, 0] for s in G.SPLITS}, {}
    for u, b, m in [("u0", 20, 20), ("u1", 10, 20), ("u2", 20, 0), ("u3", 0, 10), ("u4", 5, 5), ("u5", 5, 0), ("u6", 0, 1)]:
        gap = {s: max((fill[s][0] + b) / (total[0] * G.SHARES[s]), (fill[s][1] + m) / (total[1] * G.SHARES[s])) for s in G.SPLITS}
        best = min(G.SPLITS, key=lambda s: gap[s])
        fill[best] = [fill[best][0] + b, fill[best][1] + m]
        want[u] = best
    assert dict(map(tuple, G.allocate(units).collect())) == want
    assert G.allocate(units.limit(0)).count() == 0


def test_broken_placements_are_counted(spark):
    """Each way in which files, bags and splits can disagree has its invariant."""
    files = spark.createDataFrame([("f1", "1"), ("f2", "2"), ("f3", "3"), ("f3", "3")], "path string, md5 string")
    bags = spark.createDataFrame([("b1", "g1", "x", 2), ("b2", "g2", "y", 1)], "bag_id string, source_group_id string, bag_label string, instance_count bigint")
    splits = spark.createDataFrame([("f1", "1", "b1", "g1", "x", "train"), ("f2", "9", "b1", "g1", "x", "val"), ("f9", "9", "b2", "g3", "z", "val"), ("f9", "9", "b7", "g3", "z", "train")], "image_path string, md5 string, bag_id string, source_group_id string, bag_label string, split string")
    by_path, by_bag = I.placements(files, bags, splits)
    paths = {r.path: (r.n_files, r.n_rows, r.n_md5, r.n_splits, r.n_bags) for r in by_path.collect()}
    assert paths == {"f1": (1, 1, 1, 1, 1), "f2": (1, 1, 2, 1, 1), "f3": (2, 0, 1, 0, 0), "f9": (0, 2, 1, 2, 2)}
    of = {r.bag_id: (r.n_bags, r.listed, r.n_rows, r.n_splits, r.n_labels, r.n_groups) for r in by_bag.collect()}
    assert of == {"b1": (1, 2, 2, 2, 1, 1), "b2": (1, 1, 1, 1, 2, 2), "b7": (0, 0, 1, 1, 1, 1)}
    # Checks of one table are one aggregation.
    counted = I.violations({"one": (by_bag, F.col("n_splits") > 1), "two": (by_bag, F.col("n_bags") != 1), "three": (by_path, F.col("n_md5") > 1)})
    assert {r.invariant: r.n for r in counted.collect()} == {"one": 1, "two": 1, "three": 1}
    assert counted._jdf.queryExecution().optimizedPlan().toString().count("Union") == 3  # of the two tables, and of the results
    with pytest.raises(PySparkException, match="broken invariant"):
        I.assert_none(counted).collect()


def test_pairs_without_a_split_raise(spark):
    pairs = spark.createDataFrame([("p", "q"), ("p", "z")], "a string, b string")
    rows = spark.createDataFrame([("p", "train"), ("q", "val")], "image_path string, split string")
    assert tuple(G.pair_leaks(pairs, rows, strict=False).first()) == (1, 1, 2)
    with pytest.raises(PySparkException, match="no split"):
        G.pair_leaks(pairs, rows).collect()
    with pytest.raises(PySparkException, match="no group id"):
        G.bags(spark.createDataFrame([("x-1", "p", "m", "c", "k", "train", ["r"])], "source_group_id string, path string, md5 string, class_dir string, source_key string, split string, chain array<string>")).collect()


def test_curve_of_the_library(spark):
    """Points between two equal steps go, over the borders of ranges too; by hand and by second differences."""
    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, 400)
    p = np.round(rng.random(400), 2)
    p[:6] = [1.5, -0.5, 0.0, 1.0, 1.0, 0.0]
    got = sorted(((r.threshold, r.fpr, r.tpr) for r in E.roc_curve(scored(spark, y.tolist(), p).withColumn("g", F.lit(1)), ["g"]).collect()), reverse=True)
    scores = np.unique(p)[::-1]
    tps, fps = np.array([[((p >= s) & (y == k)).sum() for s in scores] for k in (1, 0)])
    keep = np.r_[True, (np.diff(fps, 2) != 0) | (np.diff(tps, 2) != 0), True]
    want = [(np.inf, 0.0, 0.0)] + [(s, round(f / fps[-1], 6), round(t / tps[-1], 6)) for s, f, t in zip(scores[keep], fps[keep], tps[keep])]
    assert np.allclose(got[1:], want[1:]) and got[0] == want[0] and len(got) < len(scores) + 1
    assert E.roc_curve(scored(spark, [1, 1], [0.2, 0.3]).withColumn("g", F.lit(1)), ["g"]).isEmpty()
    out = E.clipped(scored(spark, [1, 0, 1], [1.2, -0.1, 0.5])).orderBy("id").collect()
    assert [(r.probability, r.outside, r.outcome) for r in out] == [(1.0, True, "tp"), (0.0, True, "tn"), (0.5, False, "tp")]


def test_statistics_of_large_means(spark):
    """Values a million from zero keep their spread."""
    rows = spark.createDataFrame([([1e8, 1e8 + 1, 1e8 + 2],), ([1e8 + 3],)], "v array<double>")
    r = R.train_stats(rows, "v").first()
    assert (r.n, r["std"]) == (4, 1.118034) and r["mean"] == 1e8 + 1.5
    assert rows.select(*R.quality(F.col("v"))).first().qa_std == 0.816497


def test_rounding_as_in_sql(spark):
    """Every number of four digits to two, halves among them (0.575 and the like)."""
    import duckdb

    got = [r.r for r in spark.range(10001).orderBy("id").select(S.rounded(F.col("id") / F.lit(10000.0), 2).alias("r")).collect()]
    assert got == [r for (r,) in duckdb.sql("SELECT round(id / 10000.0::DOUBLE, 2) FROM range(10001) t(id) ORDER BY id").fetchall()]


def test_word_simhash_counts_repeats(spark):
    """Rows of one key count together, as before; empty and null texts have no hash."""
    import hashlib

    texts = [(1, "a b  a c"), (1, "b d"), (2, ""), (3, None), (4, " é x\ty "), (5, "w " * 5000 + "v"), (6, " ")]
    want = {}
    for k in (1, 4, 5):
        words = [w for i, t in texts if i == k and t for w in t.split(" ") if w]
        bits = np.unpackbits(np.array([np.frombuffer(hashlib.md5(w.encode()).digest()[:8], np.uint8) for w in words]), axis=1).sum(0)
        want[k] = int(np.packbits(bits * 2 > len(words)).view(">i8")[0])
    rows = spark.createDataFrame(texts, "id int, t string")
    out = Y.word_simhash(rows, "id", "t")
    assert out.dtypes == [("id", "int"), ("hash", "bigint")]
    assert {r.id: r.hash for r in out.collect()} == want
    # No word leaves its row: one exchange, of sums, is all there is.
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "MapInArrow" in plan


@pytest.mark.parametrize(("n", "most"), [(10, 7), (10**5, 7), (10**7, 7), (10**9, 9)])
def test_near_pairs_counted_not_expanded(spark, n, most):
    """Distances, cells and components against all pairs; no pair of hashes is shuffled to find its repeats."""
    rng = np.random.default_rng(n % 89)
    base = np.repeat(rng.integers(-(2**63), 2**63, 5, dtype=np.int64), 6)
    for k in range(len(base)):
        for bit in rng.integers(0, 63, k % 6):
            base[k] ^= np.int64(1 << int(bit))
    rows = spark.createDataFrame([(i, f"g{i % 3}" if i % 7 else None, int(x)) for i, x in enumerate(base)], "id int, g string, hash long")
    u = base.view(np.uint64)
    want = [(i, j, int(np.bitwise_count(u[i] ^ u[j]))) for i in range(len(u)) for j in range(i + 1, len(u)) if np.bitwise_count(u[i] ^ u[j]) <= most]
    plan = Y.band_plan(n, most)
    near = Y.near_hashes(rows.select("hash").distinct(), most, **plan)
    assert near.count() == near.distinct().count()
    assert "MapInArrow" in (edges := Y.near_edges(rows, "id", most, **plan))._jdf.queryExecution().executedPlan().toString()
    got = {r.hamming: r.n for r in Y.distance_counts(rows, "id", most, **plan).collect()}
    assert got == {k: sum(h == k for _, _, h in want) for k in {h for _, _, h in want}}
    group = [f"g{i % 3}" if i % 7 else "" for i in range(len(u))]
    cells = {}
    for i, j, h in want:
        key = (h, u[i], u[j]) if u[i] < u[j] else (h, u[j], u[i])
        ends = tuple(sorted([(u[i], group[i]), (u[j], group[j])]))
        low, m = cells.get((key, ends), ((i, j), 0))
        cells[key, ends] = (min(low, (i, j)), m + 1)
    found = sorted((r.hamming, r.a, r.b, r.n) for r in Y.cell_pairs(rows, "id", "g", most, **plan).collect())
    assert found == sorted((k[0][0], *low, m) for k, (low, m) in cells.items())
    direct = spark.createDataFrame([(i, j) for i, j, _ in want], "a int, b int")
    assert sorted(map(tuple, components(edges).collect())) == sorted(map(tuple, components(direct).collect()))


def test_turned_hashes_are_not_broadcast(spark):
    """A table of few bytes has many turned rows: they must not be taken for small and sent through the driver."""
    few = written(spark.range(3000).select(F.xxhash64("id").alias("hash"), F.col("id").alias("head")), "few")
    for plan in ({"bands": 4, "radius": 1}, {"bands": 3, "radius": 2}):
        near = Y.near_hashes(few, carried=("head",), **plan)
        assert "Broadcast" not in near._jdf.queryExecution().executedPlan().toString()
        apart = {(a, b): (a ^ b).bit_count() for a, b in near.select("hash", "other").collect()}
        assert all(n <= 7 for n in apart.values())


def test_large_written_tables_are_not_broadcast(spark):
    """Packed files look small to Spark; only a small table is sent through the driver."""
    from lodestone.sources.scratch import written

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10m")
    try:
        plans = []
        for n in (1_000, 300_000):
            rows = written(spark.range(n).selectExpr("id", "xxhash64(id) AS v"), "rows").where("v <> 0")
            joined = spark.range(10**8).join(rows, "id")
            plans.append(joined._jdf.queryExecution().executedPlan().toString())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "BroadcastHashJoin" in plans[0] and "BroadcastHashJoin" not in plans[1]


def test_many_pictures_are_not_broadcast(spark, tmp_path):
    """Repeated pictures pack into a small file, but not into small rows: 20,000 of them are merged, not sent; 1,000 may be."""
    from lodestone.plans.integrity import pictured

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10m")
    try:
        plans = []
        for n in (1_000, 20_000):
            spark.range(n).selectExpr("id AS vec_id", "array_repeat(cast(0.5 AS float), 64) AS embedding").coalesce(1).write.parquet(f"{tmp_path}/{n}/embeddings.parquet")
            pairs = spark.range(0, 10**5, 1, 1).selectExpr("id AS a", "id + 1 AS b")
            found = pictured(spark, f"{tmp_path}/{n}", pairs)
            plans.append(found._jdf.queryExecution().executedPlan().toString())
            assert found.count() == 10**5 and found.where("pa IS NOT NULL AND pb IS NOT NULL").count() == n - 1
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "BroadcastHashJoin" in plans[0] and "BroadcastHashJoin" not in plans[1]


def test_many_labels_are_not_broadcast(spark, tmp_path):
    """Labels of repeated values pack into a small file: 200,000 of them are merged, not sent, and the documents' texts do not move for it."""
    from lodestone.sources.tables import manifest

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10m")
    try:
        plans = []
        for n in (1_000, 200_000):
            spark.range(n).selectExpr("id AS doc_id", "1 AS quality", "cast(id % 2 AS int) AS toxic").coalesce(1).write.parquet(f"{tmp_path}/{n}/labels.parquet")
            spark.range(2_000).selectExpr("id AS doc_id", "concat('text ', id) AS text", "'en' AS lang").write.parquet(f"{tmp_path}/{n}/documents.parquet")
            rows = manifest(spark, f"{tmp_path}/{n}").select("doc_id", "class_dir", "md5")
            plans.append(rows._jdf.queryExecution().executedPlan().toString())
            assert rows.count() == 2_000 and rows.where("class_dir = 'malignant'").count() == min(n, 2_000) // 2
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "BroadcastHashJoin" in plans[0] and "BroadcastHashJoin" not in plans[1]
