"""Seeded orders and samples, chunks of groups, sections."""

import hashlib

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from lodestone.operators import batches as B
from lodestone.operators import chunks as C
from lodestone.operators.sections import sections


@pytest.mark.parametrize("n", [1, 2, 3, 10, 97, 1024, 5000])
def test_permutation_is_a_bijection_of_any_length(spark, n):
    got = {r.id: r.p for r in spark.range(n).select("id", B.permuted(F.col("id"), F.lit(n), 5).alias("p")).collect()}
    assert sorted(got.values()) == list(range(n))
    if n >= 1000:
        p = np.array([got[i] for i in range(n)])
        # No trace of the old order: places correlate with neither the old ones nor their neighbours'.
        assert abs(np.corrcoef(np.arange(n), p)[0, 1]) < 0.08 and abs(np.corrcoef(p[:-1], p[1:])[0, 1]) < 0.08
        other = np.array([r.p for r in spark.range(n).select("id", B.permuted(F.col("id"), F.lit(n), 6).alias("p")).orderBy("id").collect()])
        assert (other == p).mean() < 0.01


def test_batches(spark):
    rows = spark.createDataFrame([(f"k{i:03d}", i) for i in range(101)], "key string, v int").repartition(4)
    numbered = B.numbered_batches(rows, ["key"], 16, 3)
    got = sorted(numbered.collect(), key=lambda r: r.permuted)
    assert [r.permuted for r in got] == list(range(101)) and all(r.row_index == r.v and (r.batch, r.slot) == divmod(r.permuted, 16) for r in got)
    stacks = {r.batch: r.v for r in B.stacked(numbered, ["v"]).collect()}
    assert [len(stacks[k]) for k in range(7)] == [16] * 6 + [5] and [v for k in range(7) for v in stacks[k]] == [r.v for r in got]
    assert 20 < sum(r.flip for r in got) < 80


def test_sample_takes_the_smallest(spark):
    sizes = {f"b{i:02d}": 30 - i for i in range(30)}
    bags = spark.createDataFrame(list(sizes.items()), "bag string, n int")
    order = lambda seed: sorted(sizes, key=lambda b: hashlib.md5(f"{b}:{seed}".encode()).hexdigest())
    met = set()
    for seed in range(8):
        for k in (1, 4, 30):
            picked = set(order(seed)[:k])
            met.add("b29" in picked)
            if "b29" not in picked:
                picked = picked - {min(picked)} | {"b29"}
            assert {r.bag for r in B.seeded_sample(bags, "bag", "n", k, seed).collect()} == picked
    assert met == {True, False}
    with pytest.raises(ValueError):
        B.seeded_sample(bags, "bag", "n", 31, 0)


def files(spark, rows):
    return spark.createDataFrame(rows, "source_group_id string, path string, md5 string, class_dir string, source_key string, chain array<string>")


def test_a_group_of_any_size_in_chunks(spark):
    big = spark.range(200_000).select(F.lit("grp-1").alias("source_group_id"), F.format_string("p%07d", "id").alias("path"), F.md5(F.col("id").cast("string")).alias("md5"), F.lit("benign").alias("class_dir"), F.lit("k").alias("source_key"), F.array(F.lit("x")).alias("chain"))
    rows = C.bag_chunks(big, 1000).select("bag_id", "chunk", "first", "n", F.get("path", F.lit(0)).alias("low"), F.element_at("path", -1).alias("high")).orderBy("chunk").collect()
    assert [(r.bag_id, r.chunk, r["first"], r.n, r.low, r.high) for r in rows] == [("bag-1", k, 1000 * k, 1000, f"p{1000 * k:07d}", f"p{1000 * k + 999:07d}") for k in range(200)]


@pytest.mark.parametrize(("row", "says"), [(("grp-1", "b", "2", "malignant", "k", ["x"]), "label"), (("grp-1", "b", "2", "benign", "q", ["x"]), "key"), (("grp-1", "b", "2", "benign", "k", []), "original"), (("bag-2", "b", "2", "benign", "k", ["x"]), "no group id")])
def test_bags_that_break_a_rule_raise(spark, row, says):
    sound = ("grp-1", "a", "1", "benign", "k", [])
    assert C.bag_chunks(files(spark, [sound, ("grp-1", "c", "1", "benign", None, None)]), 5).count() == 1
    with pytest.raises(PySparkException, match=says):
        C.bag_chunks(files(spark, [sound, row]), 5).collect()


def test_collated(spark):
    rows = spark.createDataFrame([("a", i, [float(i), 1.0]) for i in range(5)] + [("b", 0, [7.0, 8.0])], "bag string, k int, v array<double>")
    got = {(r.bag, r.slot_chunk): (r.padded, r.mask) for r in C.collated(rows, "bag", "v", 2, 3).collect()}
    assert got["a", 1] == ([[3.0, 1.0], [4.0, 1.0], [0.0, 0.0]], [True, True, False]) and got["b", 0][1] == [True, False, False] and len(got) == 3
    sums = {(r.bag, r.channel): (r.n, r.total) for r in C.masked_sums(C.collated(rows, "bag", "v", 2, 3), "bag").collect()}
    assert sums == {("a", 0): (5, 10.0), ("a", 1): (5, 5.0), ("b", 0): (1, 7.0), ("b", 1): (1, 8.0)}
    for bad in ("array(1D)", "cast(null as array<double>)"):
        with pytest.raises(PySparkException, match="another shape"):
            C.collated(rows.union(spark.sql(f"SELECT 'c', 1, {bad}")), "bag", "v", 2, 3).collect()
    with pytest.raises(ValueError):
        C.collated(rows.limit(0), "bag", "v", 2, 3)


def test_sections(spark):
    """Families of 1 to 5 files and hand-made pairs: every section's rows in order."""
    family = lambda g, n, split: [(f"{g}{i}", g, i, "original_candidate" if i == 0 else "augmented_variant", "val" if split and i else "train", f"m{g}{min(i, 2)}") for i in range(n)]
    rows = family("b", 3, False) + family("a", 5, True) + family("c", 1, False) + family("d", 2, False)
    table = spark.createDataFrame(rows, "path string, group_id string, depth int, role string, split string, md5 string")
    pair = "a string, b string, hamming int, ssim double, same_split boolean, same_key boolean, key_a string, key_b string"
    twos = [("p1", "p2", 3, 0.9, False, True, "k", "k"), ("p0", "p2", 3, None, False, True, "k", "k"), ("p3", "p4", 5, 0.5, False, False, "y", "x"), ("p5", "p6", 2, 0.7, False, False, "x", "y"), ("q1", "q2", 6, 0.2, True, False, "u", "v")]
    twos += [(f"z{i:02d}", "zz", 0, 1.0, True, False, "u", "v") for i in range(30)]
    got = {}
    for r in sections(table, spark.createDataFrame(twos, pair), most=4).collect():
        got.setdefault(r.section, []).append((r.place, r.path))
    got = {s: [p for _, p in sorted(x)] for s, x in got.items()}
    assert got == {
        "S1": ["a0", "a1", "a2", "a3"], "S2": ["a2", "a3", "a4"], "S3": ["b0", "b1", "b2"], "S4": ["a0", "a1", "a2", "a3"], "S5": ["c0"],
        "S6": ["p0", "p1"], "S7": ["p5"], "S8": ["z00", "z07", "z14", "z21"], "S9": ["q1", "p3"], "S10": ["a0", "a1", "a2", "a3", "a4"],
    }
    assert sections(table.limit(0), spark.createDataFrame([], pair)).isEmpty()
