"""Connected components over edge tables."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.scratch import Scratch

#: Edges that one task joins at once in its memory.
SLICE = 1 << 18


def _forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) for the nodes of edges of one slice that are not the least of their tree."""
    codes, names = pd.factorize(np.concatenate([a, b]))
    names = np.asarray(names)
    # Numbers in the order of the names, so that the least number is the least name.
    order = np.argsort(names, kind="stable")
    rank = np.empty(len(names), dtype=np.int64)
    rank[order] = np.arange(len(names))
    up = np.arange(len(names))
    x, y = np.split(rank[codes], [len(a)])
    # The edges join roots: the greater goes to its least neighbour, all go on to where that leads, and the edges follow.
    while len(x):
        np.minimum.at(up, np.maximum(x, y), np.minimum(x, y))
        while not np.array_equal(up, further := up[up]):
            up = further
        x, y = up[x], up[y]
        left = x != y
        x, y = x[left], y[left]
    moved = np.flatnonzero(up != np.arange(len(up)))
    names = names[order]
    return names[moved], names[up[moved]]


def forests(edges: DataFrame) -> DataFrame:
    """Edges (a, b) with the same components: in every task each slice of SLICE edges becomes stars, of a node and the least of its tree.

    No more rows come out than nodes are in the slice, less one a tree; a task holds one slice.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def stars() -> pa.RecordBatch:
            schema = held[0].schema
            rows = pa.Table.from_batches(held)
            node, root = _forest(rows.column("a").to_numpy(), rows.column("b").to_numpy())
            return pa.RecordBatch.from_arrays([pa.array(node, type=schema.field("a").type), pa.array(root, type=schema.field("b").type)], schema=schema)

        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= SLICE:
                yield stars()
                held, n = [], 0
        if n:
            yield stars()

    kinds = dict(edges.dtypes)
    return edges.select("a", "b").mapInArrow(run, f"a {kinds['a']}, b {kinds['b']}")


def components(edges: DataFrame, rounds: list[int] | None = None) -> DataFrame:
    """(node, root) for every node of `edges` (a, b): root is the least node that can be reached.

    A round makes forests of the slices inside the tasks.  What is more than a slice is
    then contracted: every node goes to its least neighbour, and on to where that
    goes, twice; the edges follow.  A node and where it goes are in one component, so the ends
    of what is left are connected as before, and a round leaves the nodes that others went to,
    half of them at most.  When a slice holds all that is left, one task finishes it.
    The moves of the rounds are undone backwards, by one join each.  Ids may be numbers or texts.
    `rounds`, if given, takes the number of edges at the start of each round.
    """
    scratch, moves = Scratch(edges.sparkSession, "components"), []
    edges = scratch.write(forests(edges.where("a <> b")).distinct())
    while True:
        n = edges.count()
        if rounds is not None:
            rounds.append(n)
        if n <= SLICE:
            break
        both = edges.union(edges.select("b", "a"))
        up = scratch.write(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("up")))
        for _ in range(2):
            # Where a node goes is in the table itself, as it has edges too.
            up = scratch.write(up.join(up.select(F.col("a").alias("up"), F.col("up").alias("further")), "up").select("a", F.col("further").alias("up")))
        moves.append(up)
        moved = edges.join(up.select("a", F.col("up").alias("x")), "a").join(up.select(F.col("a").alias("b"), F.col("up").alias("y")), "b")
        edges = scratch.write(forests(moved.where("x <> y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct()))
    # One slice: a single task, in bounded memory.
    stars = scratch.write(forests(edges.coalesce(1)))
    root = stars.toDF("node", "root")
    for up in reversed(moves):
        # A node without an edge in the later rounds is the root itself.
        root = up.join(root.withColumnRenamed("node", "up"), "up", "left").select(F.col("a").alias("node"), F.coalesce("root", "up").alias("root"))
    # Written in any case, so that its size is known to what joins it.
    return scratch.write(root if moves else root.union(root.select(F.col("root").alias("node"), "root")).distinct())


def star_edges(rows: DataFrame, key: list[str], node: str) -> DataFrame:
    """Edges (a, b) from every row to the least node of its key; rows with a null in the key have none."""
    full = rows.dropna(subset=key)
    least = full.groupBy(*key).agg(F.min(node).alias("b"))
    return full.join(least, key).select(F.col(node).alias("a"), "b").where("a <> b")
