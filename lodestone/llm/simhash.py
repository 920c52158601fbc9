"""SimHash near-dedup by a self-join of a binary trie.

Distinct fingerprints are the leaves of a binary trie of depth 64.  Two copies
of it are traversed together: a pair of nodes carries the number of bits in
which its paths differ, and is dropped once that exceeds the budget.  Two
fingerprints that differ in at most k bits differ in at most k // 2 of the first
half or in at most k - k // 2 - 1 of the second, so the trie is walked twice,
once by the halves as they are and once by the halves swapped, with that smaller
budget for the first 32 levels; no link is lost.  The top levels are walked in
the plan: every surviving pair of nodes there is one group of rows, and a node
with more than `leaf` fingerprints is dealt into chunks that meet pair by pair,
so no task gets an unbounded group.  Each group returns a spanning forest of its
links.  Components come from alternating large and small stars.

`keep_one` is the wide form for a corpus: two texts are a link if their fingerprints over
five-word shingles differ in 13 bits or fewer and their shingle sets have an exact Jaccard
similarity of 0.8 or more (two texts of that similarity differ in about ten bits on average;
nine of ten such pairs are within 13, nearly all of 0.85 and more).  Walking the trie with
that budget lets nearly all top nodes meet, so that its time grows with the square of the texts.
Instead texts meet by their least shingle hashes: of n hashes the n - 0.8 n + 1 least, of which
two texts of that similarity share one, so no link is lost.  Where they meet, 512 parities of each set
tell most pairs that are not alike: those cannot differ in more places than the sets do in hashes.  First
each text is compared with the likest of the least texts of its hashes; then all pairs that meet, may be a link
and are not in one component yet are compared, so that components are those of all links.

Defined cases: null and empty texts have fingerprint zero and link like others;
rows with a null doc_id belong to their component without naming it (a component
of such rows only has a null component_id); repeated rows each come out; an empty
table gives no rows.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, small_batches

#: Leaf pairs that are compared and node pairs that are split at a time.
SLICE, CHUNK = 1 << 19, 1 << 16


def shingle_hashes(text: str | None, shingle: int, seed: int) -> np.ndarray:
    """XXH64 of each shingle, repeats included; of the whole sequence if it has fewer words; none without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    n = max(1, len(words) - shingle + 1)
    last = ends[len(words) - n :].tolist()
    first = [0, *(ends[: n - 1] + 1).tolist()]
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], seed) for a, b in zip(first, last)], np.uint64)


def majority(h: np.ndarray) -> int:
    """The bits that more than half of the hashes have set, as a signed 64-bit number."""
    ones = np.zeros(64, np.int64)
    for k in range(0, len(h), 8192):
        ones += np.unpackbits(h[k : k + 8192].astype(">u8").view(np.uint8)).reshape(-1, 64).sum(0, np.int64)
    return int(np.packbits(ones * 2 > len(h)).view(">i8")[0])


def simhash(text: str | None, shingle: int = 4, seed: int = 42) -> int:
    """The fingerprint of a text, as a signed 64-bit number."""
    return majority(shingle_hashes(text, shingle, seed))


def fingerprints(docs: DataFrame, shingle: int = 4, seed: int = 42) -> DataFrame:
    """(doc_id, fp) for every row."""
    small_batches(docs.sparkSession)

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "fp": [simhash(t, shingle, seed) for t in pdf["text"]]})

    return docs.select("doc_id", "text").mapInPandas(run, "doc_id long, fp long")


def _hook(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Merge the trees of i and j; label stays the root of every node."""
    while True:
        a, b = label[i], label[j]
        apart = a != b
        if not apart.any():
            return
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(up := label[label], label):
            label[:] = up


def walk(a: np.ndarray, b: np.ndarray | None, budget: int, half: int, depth: int, near) -> None:
    """Traverse two copies of a trie together and call near(i, j) with the places of leaves at most `budget` bits apart.

    `a` and `b` are sorted (b None: `a` with itself, pairs with i < j); `depth`
    levels are common to all of `a` and to all of `b`.  Node pairs are taken depth
    first, a bounded number at a time.
    """
    same = b is None
    b = a if same else b
    if not len(a) or not len(b):
        return
    err = int(np.bitwise_count((a[0] ^ b[0]) >> np.uint64(64 - depth))) if depth else 0

    def compare(p: np.ndarray) -> None:
        """Every leaf of one node against every leaf of the other, for small nodes."""
        size = (p[:, 1] - p[:, 0]) * (p[:, 3] - p[:, 2])
        for s in np.split(p, np.flatnonzero(np.diff(np.cumsum(size) // SLICE)) + 1) if len(p) else []:
            nb = s[:, 3] - s[:, 2]
            size = (s[:, 1] - s[:, 0]) * nb
            row = np.repeat(np.arange(len(s)), size)
            at = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
            up, over = np.divmod(at, nb[row])
            i, j = s[row, 0] + up, s[row, 2] + over
            hit = np.bitwise_count(a[i] ^ b[j]) <= budget
            if same:
                hit &= i < j
            if hit.any():
                near(i[hit], j[hit])

    # A row for each pair of nodes: the leaves [a0, a1) and [b0, b1), and the bits in which their paths differ.
    stack = [(depth, np.array([[0, len(a), 0, len(b), err]], np.int64))]
    while stack:
        level, pairs = stack.pop()
        if len(pairs) > CHUNK:
            stack += [(level, pairs[CHUNK:]), (level, pairs[:CHUNK])]
            continue
        size = (pairs[:, 1] - pairs[:, 0]) * (pairs[:, 3] - pairs[:, 2])
        compare(pairs[size <= 64])
        pairs = pairs[size > 64]
        if not len(pairs):
            continue
        if level == 64:  # equal leaves only, many of them: slices of one side meet the other in turn
            for a0, a1, b0, b1, _ in pairs:
                step = max(1, SLICE // int(b1 - b0))
                compare(np.array([[k, min(k + step, a1), b0, b1, 0] for k in range(a0, a1, step)]))
            continue
        bit = np.uint64(63 - level)

        def middle(x: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
            """Where the leaves with the bit set begin in each node."""
            top = (x[lo] >> bit | np.uint64(1)) << bit  # noqa: B023
            return np.clip(np.searchsorted(x, top), lo, hi)

        a0, a1, b0, b1, e = pairs.T
        am, bm = middle(a, a0, a1), middle(b, b0, b1)
        limit = half if level < 32 else budget
        children = [np.stack(c, 1) for c in ((a0, am, b0, bm, e), (am, a1, bm, b1, e), (a0, am, bm, b1, e + 1), (am, a1, b0, bm, e + 1))]
        if same:  # a node with itself: its children meet once
            children[3] = children[3][(a0 != b0) | (a1 != b1)]
        pairs = np.concatenate(children)
        stack.append((level + 1, pairs[(pairs[:, 0] < pairs[:, 1]) & (pairs[:, 2] < pairs[:, 3]) & (pairs[:, 4] <= limit)]))


def trie_join(a: np.ndarray, b: np.ndarray | None, budget: int, half: int, depth: int = 0) -> np.ndarray:
    """Root of each leaf of the sorted distinct `a` (then `b`; None: join `a` with itself)."""
    shift = 0 if b is None else len(a)
    label = np.arange(len(a) + (0 if b is None else len(b)))
    walk(a, b, budget, half, depth, lambda i, j: _hook(label, i, j + shift))
    return label


def deal(nodes: DataFrame, payload: list[str], budget: int, leaf: int) -> tuple[DataFrame, int, dict[int, int]]:
    """Rows (fp, *payload) dealt to pairs of top nodes (view, n0, c0, n1, c1), the depth of these nodes, and the first half's budget in each view.

    A row goes to as many groups as nodes are within the budget of its own; a node
    with more than `leaf` rows is dealt into chunks that meet pair by pair.
    """
    depth = min(20, math.ceil(math.log2(max(1, nodes.count() / leaf))))
    halves = {0: budget // 2, 1: budget - budget // 2 - 1}
    view = F.explode(F.array(F.struct(F.lit(0).alias("view"), F.col("fp").alias("key")), F.struct(F.lit(1).alias("view"), F.shiftleft("fp", 32).bitwiseOR(F.shiftrightunsigned("fp", 32)).alias("key"))))
    top = F.shiftrightunsigned("key", 64 - depth) if depth else F.lit(0).cast("long")
    keys = nodes.select(view.alias("v"), *payload).select("v.view", "v.key", top.alias("node"), *payload)
    counts = keys.groupBy("view", "node").agg(F.ceil(F.count(F.lit(1)) / leaf).cast("int").alias("chunks"))
    if depth <= 14:  # 2 ** 15 rows at most
        counts = F.broadcast(counts)
    masks = {v: [m for m in range(1 << depth) if m.bit_count() <= h] if h >= 0 else [] for v, h in halves.items()}
    mask = F.when(F.col("view") == 0, F.lit(masks[0])).otherwise(F.lit(masks[1]).cast("array<int>"))
    met = keys.join(counts.withColumnRenamed("chunks", "own"), ["view", "node"]).withColumn("chunk", F.pmod(F.xxhash64("key", *payload[:1]), F.col("own")).cast("int"))
    met = met.withColumn("mask", F.explode(mask)).withColumn("other", F.col("node").bitwiseXOR(F.col("mask").cast("long")))
    met = met.join(counts.withColumnRenamed("node", "other"), ["view", "other"])
    met = met.withColumn("their", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    own, their = F.struct(F.col("node").alias("node"), F.col("chunk").alias("chunk")), F.struct(F.col("other").alias("node"), F.col("their").alias("chunk"))
    met = met.select("view", "key", *payload, F.least(own, their).alias("lo"), F.greatest(own, their).alias("hi"), (own > their).alias("right"))
    return met.select("view", "key", *payload, "right", F.col("lo.node").alias("n0"), F.col("lo.chunk").alias("c0"), F.col("hi.node").alias("n1"), F.col("hi.chunk").alias("c1")), depth, halves


GROUP = ["view", "n0", "c0", "n1", "c1"]


def trie_links(nodes: DataFrame, budget: int = 4, leaf: int = 4096) -> DataFrame:
    """(a, b): a spanning forest of the links between distinct fingerprints, from each pair of top nodes."""
    met, depth, halves = deal(nodes, [], budget, leaf)

    def join(group: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        at, n0, c0, n1, c1 = group
        key, right = pdf["key"].to_numpy().view(np.uint64), pdf["right"].to_numpy(bool)
        a, b = np.sort(key[~right]), np.sort(key[right])
        alone = (n0, c0) == (n1, c1)
        label = trie_join(a, None if alone else b, budget, halves[int(at)], depth)
        leaves = a if alone else np.concatenate([a, b])
        if at:
            leaves = leaves << np.uint64(32) | leaves >> np.uint64(32)
        linked = label != np.arange(len(label))
        return pd.DataFrame({"a": leaves[linked].view(np.int64), "b": leaves[label[linked]].view(np.int64)})

    return met.groupBy(*GROUP).applyInPandas(join, "a long, b long")


def least_hashes(h: np.ndarray, similarity: float) -> np.ndarray:
    """The least of the sorted distinct hashes of a text, so many that two texts of `similarity` or more share one of theirs; one zero for none.

    Such texts share at least that part of the hashes of either, so all but those, and one more, cannot miss them.
    Of each hash the upper 40 bits stay: equal ones stay equal, and less moves.
    """
    n = len(h)
    return ((h[: n - math.ceil(similarity * n - 1e-9) + 1] if n else np.zeros(1, np.uint64)) >> np.uint64(24)).astype(np.int64)


#: 64-bit numbers of a text's parities.
WORDS = 8


def parities(h: np.ndarray) -> np.ndarray:
    """For each value of the lowest 9 bits whether an odd number of the distinct hashes has it, as 8 signed numbers.

    Two texts' parities differ in no more places than their sets differ in hashes.
    """
    odd = np.bincount((h & np.uint64(64 * WORDS - 1)).astype(np.int64), minlength=64 * WORDS) & 1
    return np.packbits(odd.astype(bool)).view(">i8").astype(np.int64)


def meetings(classes: DataFrame) -> DataFrame:
    """(h, k): the texts that share one of their least hashes."""
    rows = classes.select(F.explode(F.array_distinct("least")).alias("h"), "k").repartition("h")
    shared = rows.groupBy("h").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select("h")
    return rows.join(shared.hint("merge"), "h", "left_semi")


def _near(budget: int, similarity: float):
    """The condition for texts with fp, n and other_fp, other_n: fingerprints in the budget, and sizes that the similarity allows."""
    sizes = F.least("n", "other_n") >= F.greatest("n", "other_n") * similarity - 1e-9
    return sizes & (F.bit_count(F.col("fp").bitwiseXOR(F.col("other_fp"))) <= budget)


def _parted():
    """In how many places the parities odd and other_odd differ."""
    apart = [F.bit_count(F.get("odd", F.lit(i)).bitwiseXOR(F.get("other_odd", F.lit(i)))) for i in range(WORDS)]
    return sum(apart[1:], apart[0])


def _may_be_alike(similarity: float):
    """True unless the parities show more different hashes than two sets of the similarity have: of n and m hashes (n + m) (1 - s) / (1 + s)."""
    return _parted() <= (F.col("n") + F.col("other_n")) * ((1 - similarity) / (1 + similarity)) + 1e-6


def first_pairs(meeting: DataFrame, classes: DataFrame, budget: int, similarity: float) -> DataFrame:
    """(a, b): each text of rows (h, k) with the likest of the least texts of its hashes, if it may be a link; as many pairs as texts at most, however many meet.

    `classes` has k, fp, n and odd.
    """
    heads = meeting.groupBy("h").agg(F.min("k").alias("head"))
    pairs = meeting.join(heads.hint("merge"), "h").where("k <> head").select("k", "head").distinct()
    small = classes.select("k", "fp", "n")
    near = pairs.join(small.hint("merge"), "k").join(small.toDF("head", "other_fp", "other_n").hint("merge"), "head").where(_near(budget, similarity))
    odd = classes.select("k", "odd")
    like = near.join(odd, "k").join(odd.toDF("head", "other_odd"), "head").where(_may_be_alike(similarity))
    likest = like.groupBy("k").agg(F.min(F.struct(_parted().alias("parted"), "head"))["head"].alias("head"))
    return likest.select(F.least("k", "head").alias("a"), F.greatest("k", "head").alias("b")).distinct()


def pairs_apart(meeting: DataFrame, classes: DataFrame, roots: DataFrame, budget: int, similarity: float) -> DataFrame:
    """(a, b), a < b: all pairs of texts of different components that meet and may be a link."""
    rooted = materialise(classes.join(roots.toDF("k", "root"), "k", "left").withColumn("root", F.coalesce("root", "k")), "roots")
    split = meeting.join(rooted.select("k", "root").hint("merge"), "k").groupBy("h").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("h")
    rows = meeting.join(split.hint("merge"), "h", "left_semi").join(rooted.hint("merge"), "k").select("h", "k", "root", "fp", "n", "odd")
    rows = materialise(rows, "apart")
    other = rows.toDF("h", *[f"other_{c}" for c in rows.columns[1:]])
    met = rows.join(other.hint("merge"), "h").where((F.col("k") < F.col("other_k")) & (F.col("root") != F.col("other_root")) & _near(budget, similarity) & _may_be_alike(similarity))
    return met.select(F.col("k").alias("a"), F.col("other_k").alias("b")).distinct()


def with_texts(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """(a, b, ta, tb): pairs with their texts, of rows (k, t) that may repeat."""
    ends = pairs.select(F.col("a").alias("k")).union(pairs.select("b")).distinct()
    if pairs.count() <= 1 << 18:  # half a million numbers at most
        ends = F.broadcast(ends)
    asked = texts.join(ends, "k", "left_semi").dropDuplicates(["k"])
    return pairs.join(asked.toDF("a", "ta"), "a").join(asked.toDF("b", "tb"), "b")


def like_enough(pairs: DataFrame, shingle: int, seed: int, similarity: float) -> DataFrame:
    """(a, b) of rows (a, b, ta, tb) whose shingle sets have a Jaccard similarity of `similarity` or more."""

    def run(batches):
        for pdf in batches:
            keep = []
            for x, y in zip(pdf["ta"], pdf["tb"]):
                p, q = (np.unique(shingle_hashes(t, shingle, seed)) for t in (x, y))
                both = len(np.intersect1d(p, q, assume_unique=True))
                union = len(p) + len(q) - both
                keep.append(both >= similarity * union)  # two texts without words are alike
            yield pdf.loc[np.array(keep, bool), ["a", "b"]]

    return pairs.mapInPandas(run, "a long, b long")


def connected(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of `edges` (a, b) but the roots; a root is the least node of its component."""
    state = None
    now = materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while True:
        seen = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first()
        if seen == state:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state = seen
        both = now.union(now.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least)
        # Never more rows than before: few parts for few links.
        now = materialise(small.distinct().coalesce(1 + seen[0] // 200_000), "edges")


def near_dups(docs: DataFrame, budget: int = 4, shingle: int = 4, seed: int = 42, leaf: int = 4096) -> DataFrame:
    """(doc_id, fp, component_id) for every row: fingerprints link at `budget` or fewer differing bits."""
    prints = materialise(fingerprints(docs, shingle, seed), "prints")
    nodes = materialise(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")), "nodes")
    roots = connected(trie_links(nodes.select("fp"), budget, leaf))
    rooted = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))
    named = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    names = rooted.select("fp", "root").join(named, "root").select("fp", "component_id")
    return prints.join(names, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, budget: int = 13, shingle: int = 5, seed: int = 42, similarity: float = 0.8, leaf: int = 1 << 18) -> DataFrame:
    """`docs` without near copies: of each component of links one document stays, the one with the least doc_id.

    A link: fingerprints that differ in `budget` bits or fewer, and a similarity of
    `similarity` or more.  Rows without a doc_id come after all others, and of rows
    that repeat the doc_id and the text of the one that stays one stays.  Equal texts
    are told by 64 bits of a hash.  `leaf` belonged to the walk of a trie and has no effect.
    """
    spark = docs.sparkSession
    small_batches(spark)
    of_text = F.xxhash64(F.coalesce("text", F.lit("")))

    def run(batches):
        for pdf in batches:
            h = [shingle_hashes(t, shingle, seed) for t in pdf["text"]]
            sets = [np.unique(x) for x in h]
            fp = [majority(x) if len(x) else 0 for x in h]
            yield pd.DataFrame({"doc_id": pdf["doc_id"].astype("Int64"), "k": pdf["k"], "fp": fp, "n": [len(x) for x in sets], "odd": [parities(x) for x in sets], "least": [least_hashes(x, similarity) for x in sets]})

    prints = materialise(docs.select("doc_id", "text", of_text.alias("k")).mapInPandas(run, "doc_id long, k long, fp long, n long, odd array<long>, least array<long>"), "prints")
    classes = materialise(prints.groupBy("k").agg(*[F.first(c).alias(c) for c in ("fp", "n", "odd", "least")]), "texts")
    meeting = materialise(meetings(classes), "meetings")
    classes = classes.select("k", "fp", "n", "odd")
    texts = docs.select(of_text.alias("k"), F.coalesce("text", F.lit("")).alias("t"))
    alike = lambda pairs: materialise(like_enough(with_texts(pairs, texts), shingle, seed, similarity), "alike")
    first = materialise(first_pairs(meeting, classes, budget, similarity), "first")
    links = alike(first)
    roots = connected(links)
    # What the first links have not joined meets in full: every pair of two components that may be a link.
    rest = materialise(pairs_apart(meeting, classes, roots, budget, similarity).join(first, ["a", "b"], "left_anti"), "rest")
    if not rest.isEmpty():
        roots = connected(links.union(alike(rest)))
    ids = prints.groupBy("doc_id", "k").agg(F.count(F.lit(1)).alias("n"))
    rooted = materialise(ids.join(roots.withColumnRenamed("node", "k"), "k", "left").withColumn("root", F.coalesce("root", "k")), "rooted")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "k")
    # Rows of components with one row need no mark.
    many = materialise(rooted.groupBy("root").agg(F.min(order).alias("best"), F.sum("n").alias("rows")).where("rows > 1"), "components")
    if many.count() <= 1 << 18:
        many = F.broadcast(many)
    marked = rooted.join(many, "root").select(F.col("doc_id").alias("_id"), F.col("k").alias("_k"), (order == F.col("best")).alias("_best"), "n")
    marked = materialise(marked, "marked")
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (of_text == F.col("_k"))
    gone = marked.where("NOT _best")
    if gone.count() <= 1 << 20:  # two million numbers at most, so that the texts stay where they are
        gone = F.broadcast(gone)
    repeated = marked.where("_best AND n > 1").select("_id", "_k")
    out = docs.join(gone.select("_id", "_k"), same, "left_anti")
    if repeated.isEmpty():
        return out
    # One of each repeated row: only these rows move.
    key = f"_{uuid.uuid4().hex}"
    twice = out.join(repeated, same, "left_semi").withColumn(key, of_text).dropDuplicates(["doc_id", key]).drop(key)
    return out.join(repeated, same, "left_anti").unionByName(twice)


def op4_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's fingerprints and components over whole `documents`."""
    out = near_dups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
