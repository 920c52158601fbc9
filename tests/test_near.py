"""Near pairs whose rows do not move with every pair: copies, carried columns, counts by group."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestone.operators import similarity as Y

PLAN = {"bands": 3, "radius": 2}


@pytest.fixture(scope="module")
def close(spark):
    """Rows (id, g, hash, extra) with near and equal hashes, some keys twice, and the pairs that a loop finds."""
    rng = np.random.default_rng(5)
    base = np.repeat(rng.integers(-(2**62), 2**62, 5, dtype=np.int64), 8)
    for k in range(len(base)):
        for bit in rng.integers(0, 62, (k % 5) * 2):
            base[k] ^= np.int64(1 << int(bit))
    data = [(i, f"g{i % 3}" if i % 7 else None, int(x), f"e{i}") for i, x in enumerate(base)]
    far = lambda x, y: ((x ^ y) & (2**64 - 1)).bit_count()
    pairs = [(x, y, n) for x in data for y in data if x[0] < y[0] and (n := far(x[2], y[2])) <= 9]
    return spark.createDataFrame(data, "id int, g string, hash long, extra string"), pairs


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_pairs_carry_columns_of_both(close):
    rows, pairs = close
    got = sorted(map(tuple, Y.banded_pairs(rows.drop("g"), "id", **PLAN, also=("extra",)).collect()))
    assert got == sorted((x[0], y[0], n, x[3], y[3]) for x, y, n in pairs if n <= 7)


def test_pairs_above_some_bits_need_no_others(close):
    rows, pairs = close
    found = Y.pairs_in_groups(rows, "id", "g", None, 9, bands=4, radius=2, above=7)
    assert sorted(map(tuple, found.collect())) == sorted((x[0], y[0], n) for x, y, n in pairs if n > 7 and x[1] == y[1] is not None)


def test_pairs_within_groups_are_not_compared_with_all_pairs(spark):
    from lodestone.plans.similarity import within_group

    assert "LeftAnti" not in plan_of(within_group(spark, "/root/testdata/sf0.001"))


def test_cells_are_found_where_hashes_meet(close):
    assert "hashpartitioning(other#" not in plan_of(Y.cell_pairs(close[0], "id", "g", **PLAN))


@pytest.mark.parametrize("twice", [False, True])
def test_counts_by_group(close, twice):
    rows, pairs = close
    if twice:  # a key with rows in two groups
        rows = rows.union(rows.where("id % 4 = 1").withColumn("g", F.lit("g1")))
    n = lambda x: [x[1], "g1"] if twice and x[0] % 4 == 1 else [x[1]]
    want = {}
    for x, y, bits in pairs:
        for p in n(x):
            for q in n(y):
                if bits <= 7:
                    same = None if p is None or q is None else p == q
                    want[same] = want.get(same, 0) + 1
    assert {r.same: r.n for r in Y.group_counts(rows, "id", "g", **PLAN).collect()} == want


def test_pictures_come_with_hashes(spark, tmp_path):
    """As joining pictures to pairs: two pictures of one id, values that are no byte, none; and no pair is shuffled to its picture."""
    from lodestone.plans import integrity as Q

    spark.range(40).selectExpr("id AS doc_id", "'x' AS text").write.parquet(f"{tmp_path}/documents.parquet")
    values = "transform(sequence(1, 64), i -> cast(CASE WHEN id = 4 THEN 3 WHEN id = 5 AND i = 9 THEN NULL ELSE (id * i % 17) / 17 END AS float))"
    once = spark.range(12).selectExpr("id AS vec_id", f"CASE WHEN id <> 6 THEN {values} END AS embedding")
    once.union(once.where("vec_id = 2")).write.parquet(f"{tmp_path}/embeddings.parquet")
    h = spark.range(20).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN 1 ELSE (1L << id) END AS hash")
    plan = Q.bands(spark, str(tmp_path))
    old = Q.pictured(spark, str(tmp_path), Y.banded_pairs(h, "doc_id", **plan)).select("a", "b", "hamming", "pa", "pb")
    has = old.join(spark.range(12).select(F.col("id").alias("a")), "a", "left_semi").join(spark.range(12).select(F.col("id").alias("b")), "b", "left_semi")
    rows = lambda df, *c: sorted(map(repr, df.select(*c).collect()))
    both = Q.pictured_pairs(spark, str(tmp_path), h)
    assert rows(both, "a", "b", "hamming", "pa", "pb") == rows(has, "a", "b", "hamming", "pa", "pb")
    others = Q.unpictured_pairs(spark, str(tmp_path), h)
    assert both.count() + others.count() == old.count()
    assert rows(both.union(others.select("a", "b", "hamming", F.expr("CAST(NULL AS array<double>)").alias("pa"), F.expr("CAST(NULL AS array<double>)").alias("pb"))), "a", "b", "hamming") == rows(old, "a", "b", "hamming")


def test_forest_of_a_slice():
    """Stars to the least node of each tree, as a search finds them."""
    from lodestone.operators.graph import _forest

    rng = np.random.default_rng(3)
    for n, m in ((3, 2), (50, 30), (50, 200), (400, 399)):
        a, b = (np.arange(m), np.arange(1, m + 1)) if m == 399 else rng.integers(0, n, (2, m))
        least = dict.fromkeys([*a.tolist(), *b.tolist()])
        least = {x: x for x in least}
        for _ in range(n):
            for x, y in zip(a.tolist(), b.tolist()):
                least[x] = least[y] = min(least[x], least[y])
        node, root = _forest(a, b)
        assert dict(zip(node.tolist(), root.tolist())) == {x: r for x, r in least.items() if x != r}
