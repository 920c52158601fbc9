"""Document fingerprints by locally consistent parsing.

A text is a sequence of code points.  At every level runs of one name become one
name, deterministic coin tossing (the lowest bit in which a name differs from the
one before it, and its value there) shortens the names to six labels in a few
rounds, and local maxima of the labels begin phrases.  A phrase is named by a
hash of what it holds, and the phrase names are the sequence of the next level.
Where a phrase begins depends on a few neighbours only, so that equal substrings
get equal names inside, wherever they stand.  Levels go on until one name is left,
the name of the whole text.  The names of the levels from the second up are the
signature of a text, and its fingerprint is the `KEEP` smallest of them, 32 bits each;
the likeness of two fingerprints estimates the Jaccard similarity of the signatures
from the smallest names of their union, with a standard error of 0.0625 at most.

Defined cases: a null text is an empty text; empty texts have an empty
fingerprint, and two of them have likeness 1; repeated rows each come out, and
rows with one doc_id follow one another in the order of their texts; a null
doc_id comes after all others; a single document is its own successor; an empty
table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import small_batches

KEEP, FIRST_LEVEL = 64, 2
#: Code points that are parsed together; a longer text is parsed alone.
CHUNK = 1 << 19
MIX = np.uint64(0x9E3779B97F4A7C15)
POWERS = np.multiply.accumulate(np.full(1 << 12, 0xD6E8FEB86659FD93, np.uint64))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * MIX
    return x ^ (x >> np.uint64(29))


def _tosses() -> np.ndarray:
    """The label of a name under 256 after another one (in the rows)."""
    before, name = np.meshgrid(np.arange(256), np.arange(256), indexing="ij")
    low = (before ^ name) & -(before ^ name)
    bit = np.bitwise_count(np.maximum(low, 1) - 1)
    return (2 * bit + (name >> bit & 1)).astype(np.uint8)


TOSS = _tosses()


def _level(names: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The phrase names of a level, and which of them begin a text."""
    if not len(names):
        return names, begins
    fresh = begins.copy()
    fresh[1:] |= names[1:] != names[:-1]
    at = np.flatnonzero(fresh)
    run = np.diff(at, append=len(names)).astype(np.uint64)
    names, begins = np.where(run > 1, _mix(names[at] ^ run * MIX), names[at]), begins[at]
    # A text begins as after a name that differs from its first in the lowest bit.
    differs = np.ones_like(names)
    differs[1:] = names[1:] ^ names[:-1]
    differs[begins] = 1
    low = differs & (~differs + np.uint64(1))
    bit = np.bitwise_count(low - np.uint64(1))
    label = (2 * bit + ((names & low) != 0)).astype(np.uint8)
    for _ in range(3):
        before = np.empty_like(label)
        before[1:] = label[:-1]
        before[begins] = label[begins] ^ 1
        label = TOSS[before, label]
    top = begins.copy()
    top[1:-1] |= (label[1:-1] > label[:-2]) & (label[1:-1] > label[2:]) & ~begins[2:]
    at = np.flatnonzero(top)
    place = np.arange(len(names)) - np.repeat(at, np.diff(at, append=len(names)))
    return _mix(np.add.reduceat(names * POWERS[place % len(POWERS)], at)), begins[at]


def signatures(texts: list[str]) -> list[np.ndarray]:
    """The KEEP least names of each text, sorted."""
    sizes = np.array([len(t) for t in texts], np.int64)
    full = np.flatnonzero(sizes)
    out = [np.zeros(0, np.uint32)] * len(texts)
    if not len(full):
        return out
    names = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
    begins = np.zeros(len(names), bool)
    begins[(np.cumsum(sizes) - sizes)[full]] = True
    found, owner, live, level = [], [], np.arange(len(full)), 0
    while len(names):
        level += 1
        names, begins = _level(names, begins)
        if level >= FIRST_LEVEL:
            own = np.cumsum(begins) - 1
            found.append(_mix(names + np.uint64(level)) >> np.uint64(32))
            owner.append(live[own])
            # A text that is one name is done; the others lose at least half of their names at the next level.
            several = np.bincount(own) > 1
            names, begins, live = names[several[own]], begins[several[own]], live[several]
    both = np.unique(np.concatenate(owner).astype(np.uint64) << np.uint64(32) | np.concatenate(found))
    owner = (both >> np.uint64(32)).astype(np.int64)
    first = np.searchsorted(owner, np.arange(len(full) + 1))
    for k, at in enumerate(full):
        out[at] = (both[first[k] : min(first[k + 1], first[k] + KEEP)] & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated Jaccard similarity from two sorted sketches."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.concatenate([a, b])
    both.sort()
    twice = np.flatnonzero(both[1:] == both[:-1])
    size = min(KEEP, len(both) - len(twice))
    # The place of a name among the distinct ones: its place less the doubles before it.
    return float(np.count_nonzero(twice - np.arange(len(twice)) < size) / size)


def edited(text: str, following: str) -> str:
    """The text with its last half replaced by the beginning of the next one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


#: Bytes of text that make a part, and the most parts: their bounds stand in the plan.
PART, MOST_PARTS = 128 << 20, 4096


def with_next(docs: DataFrame) -> DataFrame:
    """(part, head, doc_id, text) in partitions: by descending doc_id, each part closed by a copy of the document that follows it (head)."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    # Parts follow the texts' size; what is more than MOST_PARTS of them is streamed in longer ones.
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = min(max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // PART)), MOST_PARTS)
    bounds = sorted(set(docs.approxQuantile("doc_id", [k / n for k in range(1, n)], 1 / (8 * n)))) if n > 1 else []
    edges = F.array(*[F.lit(int(b)) for b in bounds]).cast("array<bigint>")
    part = F.coalesce(F.size(F.filter(edges, lambda b: b <= F.col("doc_id"))), F.lit(-1)) if bounds else F.lit(0)
    dealt = docs.select(part.alias("part"), F.lit(False).alias("head"), "doc_id", "text")
    # One row for each part, n + 1 at most.
    tops = sorted((r["part"], r["top"]) for r in dealt.groupBy("part").agg(F.max("doc_id").alias("top")).collect())
    heads = None
    for (_, top), above in zip(tops, [*[p for p, _ in tops[1:]], tops[0][0]] if tops else []):
        mine = F.col("doc_id").eqNullSafe(F.lit(top).cast("long"))
        heads = F.when(mine, F.lit(above)) if heads is None else heads.when(mine, F.lit(above))
    if heads is None:
        return dealt
    copies = dealt.select(heads.alias("part"), F.lit(True).alias("head"), "doc_id", "text").where(F.col("part").isNotNull())
    return dealt.union(copies).repartition(n, "part").sortWithinPartitions("part", "head", F.col("doc_id").desc_nulls_last(), "text")


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every document."""
    small_batches(docs.sparkSession)

    def rows(pairs: list) -> pd.DataFrame:
        own = signatures([t for _, t, _ in pairs] + [pairs[-1][2]])
        changed = [edited(t, f) for _, t, f in pairs]
        marks = signatures(changed)
        # Pairs of a part follow one another; the last of a part has a head after it that is not the next pair.
        after = [own[k + 1] if k + 1 == len(pairs) or pairs[k + 1][1] is pairs[k][2] else signatures([pairs[k][2]])[0] for k in range(len(pairs))]
        text = lambda s: s.astype(">u4").tobytes().hex()
        return pd.DataFrame({"doc_id": pd.array([i for i, _, _ in pairs], "Int64"), "n_chars": [len(t) for _, t, _ in pairs], "edited_sha256": [hashlib.sha256(c.encode("utf-8", "surrogatepass")).hexdigest() for c in changed], "fingerprint": [text(s) for s in own[:-1]], "edited_fingerprint": [text(s) for s in marks], "near_edited": [likeness(a, b) for a, b in zip(own, marks)], "near_next": [likeness(a, b) for a, b in zip(own, after)]})

    def run(batches):
        pairs, size, last, closed = [], 0, None, True
        for pdf in batches:
            ids = pdf["doc_id"].astype("Int64")
            for part, head, doc_id, text in zip(pdf["part"], pdf["head"], ids, pdf["text"]):
                if last is not None and not closed and last[0] == part:
                    pairs.append((last[1], last[2], text))
                    size += len(last[2])
                    closed = bool(head)
                if not head:
                    last, closed = (part, None if doc_id is pd.NA else int(doc_id), text), False
                if size >= CHUNK:
                    yield rows(pairs)
                    pairs, size = [], 0
        if pairs:
            yield rows(pairs)

    return with_next(docs).mapInPandas(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op10_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's fingerprints over whole `documents`."""
    return fingerprint_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
