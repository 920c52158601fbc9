"""Conflict-constrained best-fit packing of documents into sequences.

A document is cut into full sequences and a rest; the rests are packed.  Rests go
in descending length to the fullest sequence that has room and no conflict.  Open
bins stand in the order of their residual; the search begins at the least
residual that fits and steps on to the next bin until one is compatible.  A bin
carries two bitmaps: one of its duplicate clusters (no cluster twice) and one of
its sources (no source more than `max_per_source` times: a source has that many
bits).  Copies of a cluster follow one another in the order, and the search for a
copy goes on where the last one ended, as every bin before that has the cluster.

Documents are dealt to shards by a hash, and a shard is packed in one task; the
number of shards follows the number of rows, so a shard stays small whatever the
share of one source or cluster.

Defined cases: a null or empty text has no tokens and gets no bin (a row with
null bin and place); a null source is a source of its own; equal texts are one
cluster; repeated rows each get a place; an empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

CAPACITY, MAX_PER_SOURCE, SHARD = 2048, 4, 4096


def n_tokens(text: Column) -> Column:
    """Words by blanks and the codes 9 to 13, and one end; none for an empty text."""
    words = F.size(F.filter(F.split(text, "[\\x20\\x09-\\x0D]+", -1), lambda w: w != "")).cast("long")
    return F.when(F.length(F.coalesce(text, F.lit(""))) > 0, words + 1).otherwise(F.lit(0).cast("long"))


def best_fit(rests: list[tuple[int, str, int]], capacity: int, max_per_source: int) -> list[tuple[int, int]]:
    """Bin and offset of each rest (length, source, cluster), by descending length; bins are numbered from 0."""
    order = sorted(range(len(rests)), key=lambda i: (-rests[i][0], rests[i][2], rests[i][1], i))
    cluster_bit, source_bit = {}, {}
    ring: list[tuple[int, int]] = []  # (residual, bin)
    clusters: list[int] = []
    sources: list[int] = []
    out = [(0, 0)] * len(rests)
    last, resume = None, (0, 0)
    for i in order:
        size, source, cluster = rests[i]
        c = 1 << cluster_bit.setdefault(cluster, len(cluster_bit))
        first = source_bit.setdefault(source, len(source_bit)) * max_per_source
        slots = ((1 << max_per_source) - 1) << first
        at = bisect_left(ring, resume if last == (size, cluster, source) else (size, -1))
        while at < len(ring) and (clusters[ring[at][1]] & c or sources[ring[at][1]] & slots == slots):
            at += 1
        if at < len(ring):
            residual, b = ring.pop(at)
        else:
            residual, b = capacity, len(clusters)
            clusters.append(0)
            sources.append(0)
        # Bins before this one in the order hold the cluster or are full of the source.
        last, resume = (size, cluster, source), (residual, b)
        out[i] = (b, capacity - residual)
        clusters[b] |= c
        sources[b] |= (sources[b] >> first & ((1 << max_per_source) - 1)) + 1 << first
        if residual > size:
            insort(ring, (residual - size, b))
    return out


def pack(docs: DataFrame, capacity: int = CAPACITY, max_per_source: int = MAX_PER_SOURCE, shard: int = SHARD) -> DataFrame:
    """(doc_id, source, piece, first_token, n_tokens, bin, place): the pieces of every document and where they stand."""
    rows = docs.select("doc_id", "source", n_tokens(F.col("text")).alias("tokens"), F.xxhash64("text").alias("cluster"))
    shards = max(1, -(-docs.count() // shard))
    own = F.xxhash64(F.coalesce("doc_id", F.monotonically_increasing_id()), "cluster")
    rows = rows.withColumn("shard", F.pmod(own, F.lit(shards)).cast("int"))

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        shard = int(key[0]) << 32  # the key is a 32-bit number, which a shift by 32 would leave at 0
        pdf = pdf.sort_values(["doc_id", "cluster"], kind="stable").reset_index(drop=True)
        tokens = pdf["tokens"].tolist()
        sources = [str(s) if s is not None else "" for s in pdf["source"]]
        rests = [(t % capacity, f"{s is None}{x}", c) for t, s, x, c in zip(tokens, pdf["source"], sources, pdf["cluster"])]
        full = [i for i, r in enumerate(rests) if r[0]]
        packed = dict(zip(full, best_fit([rests[i] for i in full], capacity, max_per_source)))
        free = max((b for b, _ in packed.values()), default=-1) + 1
        out = []
        for i, (doc_id, source, t) in enumerate(zip(pdf["doc_id"].astype("Int64"), pdf["source"], tokens)):
            doc_id = None if doc_id is pd.NA else int(doc_id)
            for piece in range(t // capacity):
                out.append((doc_id, source, piece, piece * capacity, capacity, shard + free, 0))
                free += 1
            if i in packed:
                b, place = packed[i]
                out.append((doc_id, source, t // capacity, t - t % capacity, t % capacity, shard + b, place))
            elif not t:
                out.append((doc_id, source, 0, 0, 0, None, None))
        got = pd.DataFrame(out, columns=["doc_id", "source", "piece", "first_token", "n_tokens", "bin", "place"])
        return got.astype({"doc_id": "Int64", "bin": "Int64", "place": "Int64"})

    return rows.groupBy("shard").applyInPandas(run, "doc_id long, source string, piece int, first_token long, n_tokens long, bin long, place long")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document of `documents` with its bin and place."""
    return pack(table(spark, sf_dir, "documents"))
