"""Perceptual hashes, banded Hamming joins, near-duplicate groups, structural similarity."""

from __future__ import annotations

import hashlib
import itertools
import math
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalar as S
from .graph import forests


def average_hash(values: Column) -> Column:
    """64 bits: value at or above the mean, the first value the highest bit."""
    mean = S.total(F.transform(values, lambda x: x.cast("double"))) / F.size(values)
    bound = F.transform(F.array(F.struct(values.alias("v"), mean.alias("m"))), lambda s: F.transform(s["v"], lambda x: x.cast("double") >= s["m"]))
    return S.bits_to_long(F.get(bound, F.lit(0)))


def difference_hash(values: Column) -> Column:
    """64 bits: value above the next one, the last against the first."""
    following = F.concat(F.slice(values, 2, F.size(values) - 1), F.slice(values, 1, 1))
    return S.bits_to_long(F.zip_with(values, following, lambda a, b: a > b))


#: Rows of one batch, and words whose digests a task remembers.
BATCH, WORDS = 512, 1 << 16


def word_simhash(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, hash): bit i is set if more words than not have it set in the first 64 bits of their md5.

    A text's words are counted and hashed in its row, so that no word is shuffled and
    a task holds one batch of texts; rows of one key add up afterwards.  Two bits share a sum, in
    the halves of a 64-bit number, which holds for up to 2**31 words a text.
    """
    texts.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, bytes] = {}

        def digest(w: str) -> bytes:
            found = known.get(w)
            if found is None:
                if len(known) >= WORDS:
                    known.clear()
                found = known[w] = hashlib.md5(w.encode("utf-8", "surrogatepass")).digest()[:8]
            return found

        for batch in batches:
            at, sums = [], []
            for i, t in enumerate(batch.column(1).to_pylist()):
                words = Counter((t or "").split(" "))
                del words[""]
                if words:
                    n = np.fromiter(words.values(), np.int64, len(words))
                    bytes_of = np.frombuffer(b"".join(map(digest, words)), np.uint8).reshape(-1, 8)
                    v = sum(n[k : k + 8192] @ np.unpackbits(bytes_of[k : k + 8192], axis=1) for k in range(0, len(n), 8192))
                    # Lane k holds bit k of the first half in its upper 32 bits and bit k of the second in its lower ones.
                    at.append(i)
                    sums.append(np.append(v[:32] << 32 | v[32:], n.sum()))
            if at:
                lanes = np.array(sums, np.int64)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), *[pa.array(lanes[:, k]) for k in range(33)]], names=[key, *[f"v{k}" for k in range(32)], "n"])

    kind = texts.select(key).schema[0].dataType.simpleString()
    counted = texts.select(key, text).mapInArrow(run, f"`{key}` {kind}, {', '.join(f'v{k} long' for k in range(32))}, n long")
    sums = counted.groupBy(key).agg(F.sum("n").alias("n"), *[F.sum(f"v{k}").alias(f"v{k}") for k in range(32)])
    upper = [F.shiftright(f"v{k}", 32) * 2 > F.col("n") for k in range(32)]
    lower = [F.col(f"v{k}").bitwiseAND(F.lit((1 << 32) - 1)) * 2 > F.col("n") for k in range(32)]
    return sums.select(key, S.bits_to_long(F.array(*upper, *lower)).alias("hash"))


def band_plan(n: int, most: int = 7) -> dict[str, int]:
    """bands and radius for n hashes: few rows and candidates, so wider bands for more hashes.

    With b bands some band of a near pair differs in at most most // b bits.
    """
    ball = lambda width, r: sum(math.comb(width, k) for k in range(r + 1))

    def cost(b: int) -> float:
        width, r = 64 // b, most // b
        return b * n * (ball(width, r // 2) + ball(width, r - r // 2) + n * ball(width, r) / 2**width)

    bands = min(range(2, most + 2), key=cost)
    return {"bands": bands, "radius": most // bands}


def banded_pairs(hashes: DataFrame, key: str, most: int = 7, bands: int = 4, radius: int = 1, also: tuple[str, ...] = ()) -> DataFrame:
    """(a, b, hamming) of rows (key, hash) with at most `most` differing bits, a < b; columns `also` come along as <name>_a and <name>_b.

    The candidates are those of `near_hashes`.  Equal hashes are joined once: the
    bands are those of distinct hashes.
    """
    return _pairs(hashes, key, most, bands, radius, (), also)


def _pairs(rows: DataFrame, key: str, most: int, bands: int, radius: int, within: tuple[str, ...] = (), also: tuple[str, ...] = (), above: int = -1) -> DataFrame:
    """(a, b, hamming, *also of both) of rows (*within, key, hash, *also) of one group with more than `above` and at most `most` differing bits.

    A hash that one row has carries that row through the join of the bands, so its pairs are ready where they
    meet.  Only pairs with a hash of several rows move once more, to these rows: no shuffle holds the other pairs.
    """
    at, own = [*within, "hash"], ("_one", *also)
    rows = rows.select(*at, F.col(key).alias("_one"), *also)
    many = rows.groupBy(*at).agg(F.count(F.lit(1)).alias("_n"), F.min("_one").alias("_one"), *[F.any_value(c).alias(c) for c in also])
    heads = many.select(*at, *[F.when(F.col("_n") == 1, F.col(c)).alias(c) for c in own])
    one, several = "_one IS NOT NULL", "_one IS NULL"
    others = {"hash": "other", **{c: f"other_{c}" for c in own}}

    def near(left: str, right: str) -> DataFrame:
        return near_hashes(heads, most, bands, radius, within, own, (left, right)).where(F.col("hamming") > above)

    def left_rows(pairs: DataFrame) -> DataFrame:
        return pairs.drop(*own).join(rows.hint("merge"), at)

    def right_rows(pairs: DataFrame) -> DataFrame:
        return pairs.drop(*[others[c] for c in own]).join(rows.withColumnsRenamed(others).hint("merge"), [*within, "other"])

    columns = [*own, *[others[c] for c in own], "hamming"]
    parts = [near(one, one), left_rows(near(several, one)), right_rows(near(one, several)), right_rows(left_rows(near(several, several)))]
    if above < 0:
        copied = rows.join(many.where("_n > 1").select(*at), at)
        equal = copied.join(rows.withColumnsRenamed({c: others[c] for c in own}).hint("merge"), at).where(F.col("_one") < F.col("other__one"))
        parts.append(equal.withColumn("hamming", F.lit(0)))
    out = parts[0].select(*columns)
    for part in parts[1:]:
        out = out.union(part.select(*columns))
    turned = F.col("_one") > F.col("other__one")
    ends = [F.when(turned, F.col(y)).otherwise(F.col(x)).alias(f"{c}_{side}") for c in also for side, x, y in (("a", c, others[c]), ("b", others[c], c))]
    return out.select(F.least("_one", "other__one").alias("a"), F.greatest("_one", "other__one").alias("b"), "hamming", *ends)


def near_edges(hashes: DataFrame, key: str, most: int = 7, bands: int = 4, radius: int = 1) -> DataFrame:
    """(a, b): edges with the components of `banded_pairs`: near distinct hashes by their least rows, and a star for the rows of one hash.

    A task that finds near pairs turns them into forests at once, so that no more edges than rows of a slice leave it.
    """
    heads = hashes.groupBy("hash").agg(F.min(key).alias("head"))
    near = near_hashes(heads, most, bands, radius, carried=("head",))
    stars = hashes.join(heads, "hash").where(F.col(key) != F.col("head")).select(F.col(key).alias("a"), F.col("head").alias("b"))
    return forests(near.select(F.col("head").alias("a"), F.col("other_head").alias("b"))).union(stars)


def distance_counts(hashes: DataFrame, key: str, most: int = 7, bands: int = 4, radius: int = 1) -> DataFrame:
    """(hamming, n): how many pairs of `banded_pairs` are so far apart, counted between hashes where they meet."""
    sizes = hashes.groupBy("hash").agg(F.count(F.lit(1)).alias("size"))
    near = near_hashes(sizes, most, bands, radius, carried=("size",)).select("hamming", (F.col("size") * F.col("other_size")).alias("n"))
    equal = sizes.where("size > 1").select(F.lit(0).alias("hamming"), F.expr("size * (size - 1) div 2").alias("n"))
    return near.union(equal).groupBy("hamming").agg(F.sum("n").alias("n"))


def group_counts(rows: DataFrame, key: str, group: str, most: int = 7, bands: int = 4, radius: int = 1) -> DataFrame:
    """(same, n): how many pairs of rows (key, group, hash) have one group, or two; null where a row has none.

    They are the pairs that `banded_pairs` has of keys, as often as a key has rows.  Rows of one hash and group are
    counted and the counts multiplied where they meet, so that no pair is made or moved.
    """
    number = lambda x: x.cast("bigint").alias("n")
    each = rows.groupBy("hash", group, key).agg(F.count(F.lit(1)).alias("m"))
    cells = each.groupBy("hash", F.col(group).alias("g")).agg(F.sum("m").alias("size"), F.sum(F.col("m") * F.col("m")).alias("squares"))
    near = near_hashes(cells.select("hash", "g", "size"), most, bands, radius, carried=("g", "size")).select((F.col("g") == F.col("other_g")).alias("same"), number(F.col("size") * F.col("other_size")))
    # Of one hash: all pairs of two keys, those with two groups, and of these those with one group, which move from the one count to the other.
    whole = rows.groupBy("hash", key).agg(F.count(F.lit(1)).alias("m"), F.count(group).alias("k"))
    whole = whole.groupBy("hash").agg(F.expr("(sum(m) * sum(m) - sum(m * m)) div 2").alias("every"), F.expr("(sum(k) * sum(k) - sum(k * k)) div 2").alias("known"))
    split = lambda *parts: F.explode(F.array(*[F.struct(F.lit(same).cast("boolean").alias("same"), number(n)) for same, n in parts])).alias("r")
    equal = whole.select(split((False, F.col("known")), (None, F.col("every") - F.col("known")))).select("r.*")
    inside = F.expr("(size * size - squares) div 2")
    moved = cells.where("g IS NOT NULL").select(split((True, inside), (False, -inside))).select("r.*")
    return near.union(equal).union(moved).groupBy("same").agg(F.sum("n").alias("n")).where("n > 0")


def cell_pairs(hashes: DataFrame, key: str, group: str, most: int = 7, bands: int = 4, radius: int = 1) -> DataFrame:
    """(hamming, ka, kb, a, b, n): what `banded_pairs` has for two cells, the rows (key, group, hash) of one hash and group each.

    n is the number of pairs between the cells (or inside one) and (a, b) the least of them by a, then b.  Copies are
    counted, not expanded into their pairs.
    """
    cells = hashes.groupBy("hash", group).agg(F.min(key).alias("low"), F.count(F.lit(1)).alias("size"))
    # The cells themselves meet by the bands, so that no pair of hashes is shuffled to find its cells.
    near = near_hashes(cells.select("hash", F.col(group).alias("k"), "low", "size"), most, bands, radius, carried=("k", "low", "size"))
    apart = near.select("hamming", F.col("k").alias("ka"), F.col("other_k").alias("kb"), F.col("low").alias("x"), F.col("other_low").alias("y"), F.col("size").alias("nx"), F.col("other_size").alias("ny"))
    one = cells.select("hash", F.col(group).alias("ka"), F.col("low").alias("x"), F.col("size").alias("nx"))
    two = cells.select("hash", F.col(group).alias("kb"), F.col("low").alias("y"), F.col("size").alias("ny"))
    # Cells of one hash meet once, in the order of their least rows.
    both = apart.union(one.join(two, "hash").where("x < y").select(F.lit(0).alias("hamming"), "ka", "kb", "x", "y", "nx", "ny"))
    between = both.select("hamming", "ka", "kb", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), (F.col("nx") * F.col("ny")).alias("n"))
    rows = hashes.select(F.col("hash").alias("_h"), F.col(group).alias("_g"), F.col(key).alias("b"))
    many = cells.where("size > 1").select("hash", F.col(group).alias("_k"), "low", "size")
    inside = rows.join(many, F.expr("_h = hash AND _g <=> _k AND b > low"))
    second = inside.groupBy("hash", "_k").agg(F.min("low").alias("a"), F.min("b").alias("b"), F.min("size").alias("size"))
    within = second.select(F.lit(0).alias("hamming"), F.col("_k").alias("ka"), F.col("_k").alias("kb"), "a", "b", F.expr("size * (size - 1) div 2").alias("n"))
    return between.union(within)


def near_hashes(distinct: DataFrame, most: int = 7, bands: int = 4, radius: int = 1, within: tuple[str, ...] = (), carried: tuple[str, ...] = (), sides: tuple[str, str] = ("true", "true")) -> DataFrame:
    """(*within, hash, other, hamming) of distinct rows (*within, hash) with at most `most` differing bits, hash < other; columns `carried` come along from both, the other's as other_<name>.  `sides` are conditions on the row of hash and on that of other.

    64 / bands bits make a band.  Rows that differ in fewer bits than (radius + 1)
    times the bands agree in some band but for `radius` bits: one side is joined by
    its band values with half of these turned, the other with the rest.  Two rows may meet in
    several bands, and in one by several turns; they count in the first of the bands, where the left
    side has turned the lowest bits that the right side could not.  So no pair is shuffled to find its repeats.
    """
    if most >= (radius + 1) * bands:
        raise ValueError("the bands are complete for fewer differing bits than (radius + 1) times the bands only")
    edges = [64 * k // bands for k in range(bands + 1)]
    width = max(b - a for a, b in itertools.pairwise(edges))
    parts = lambda x: [F.shiftrightunsigned(x, a).bitwiseAND(F.lit((1 << (b - a)) - 1).cast("bigint")) for a, b in itertools.pairwise(edges)]

    def turned(bits: int, side: str) -> DataFrame:
        """Rows by their band values with up to `bits` bits turned; band and value share one number, so that little moves."""
        flips = [sum(1 << i for i in c) for k in range(bits + 1) for c in itertools.combinations(range(width), k)]
        turns = F.explode(F.lit(flips).cast("array<bigint>")) if bits else F.lit(0).cast("bigint")
        banded = distinct.where(side).select(*within, "hash", *carried, F.posexplode(F.array(*parts(F.col("hash")))).alias("band", "value"))
        met = F.col("value").bitwiseXOR(F.col("_turn")) * bands + F.col("band")
        return banded.withColumn("_turn", turns).select(*within, met.alias("_met"), "hash", *carried)

    left, most_right = radius // 2, radius - radius // 2
    right = turned(most_right, sides[1]).withColumnsRenamed({"hash": "other", **{c: f"other_{c}" for c in carried}})
    # Spark takes the turned rows for as few as the hashes that they come from, and would send them all through the driver.
    near = turned(left, sides[0]).join(right.hint("merge"), [*within, "_met"]).where(F.col("hash") < F.col("other"))
    near = near.withColumn("band", (F.col("_met") % bands).cast("int")).withColumn("_turn", F.expr(f"_met div {bands}").bitwiseXOR(F.get(F.array(*parts(F.col("hash"))), F.col("band"))))
    near = near.withColumn("hamming", S.hamming(F.col("hash"), F.col("other"))).where(F.col("hamming") <= most)
    apart = parts(F.col("hash").bitwiseXOR(F.col("other")))
    earlier = F.coalesce(*[F.when((F.col("band") > k) & (F.bit_count(x) <= radius), True) for k, x in enumerate(apart)], F.lit(False))
    here, lowest, rest = F.get(F.array(*apart), F.col("band")), F.lit(0).cast("bigint"), F.get(F.array(*apart), F.col("band"))
    for k in range(left):
        one = F.when(F.bit_count(here) > most_right + k, rest.bitwiseAND(-rest)).otherwise(F.lit(0).cast("bigint"))
        lowest, rest = lowest.bitwiseOR(one), rest.bitwiseXOR(one)
    near = near.where(~earlier & (F.col("_turn") == lowest))
    return near.select(*within, "hash", "other", "hamming", *carried, *[f"other_{c}" for c in carried])


def pairs_in_groups(rows: DataFrame, key: str, group: str, found: DataFrame | None, most: int = 7, bands: int = 4, radius: int = 1, above: int = -1) -> DataFrame:
    """(a, b, hamming) of close rows (key, group, hash) of one group that `found` lacks, by bands inside the groups.

    Where `found` has every pair up to `above` bits, it is not needed: pairs with more bits are those it lacks.
    """
    pairs = _pairs(rows, key, most, bands, radius, (group,), above=above)
    return pairs if found is None else pairs.join(found.select("a", "b"), ["a", "b"], "left_anti")


def ssim_center(a: Column, b: Column, span: float = 255.0) -> Column:
    """Structural similarity of two value arrays over one window."""
    c1, c2 = (0.01 * span) ** 2, (0.03 * span) ** 2
    n = F.size(a).cast("double")
    ma, mb = S.total(a) / n, S.total(b) / n
    moment = lambda x, y: S.dot(x, y) / n
    va, vb, cov = moment(a, a) - ma * ma, moment(b, b) - mb * mb, moment(a, b) - ma * mb
    return ((2 * ma * mb + c1) * (2 * cov + c2)) / ((ma * ma + mb * mb + c1) * (va + vb + c2))


def ssim_bucket(s: Column) -> Column:
    """The five buckets of the cross-check."""
    return F.when(s >= 1 - 1e-9, "=1").when(s >= 0.9, ">=.90").when(s >= 0.8, ".80-.90").when(s >= 0.6, ".60-.80").otherwise("<.60")
