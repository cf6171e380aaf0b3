"""Connected components of a link table, by alternating large-star and small-star steps.

Each step is one grouped minimum (combined before the shuffle) and one join on a
node, by broadcast up to a counted size and else by a shuffle whose hot keys Spark can split; every round's edges are written to the
shared folder.  Before the steps of a round, each task replaces runs of its edges by
those of a forest that joins the same nodes, which shortens chains.  Nothing but two
numbers a round is sent to the driver.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from kinfold.shared import bounded, drop_shared, python_ready, tidy, write_shared

#: Edges that a task replaces by a forest at a time.
RUN = 500_000


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges from each node to the smallest one that these edges join it to."""
    nodes, ends = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(nodes))
    while True:
        p, q = label[x], label[y]
        if (p == q).all():
            break
        np.minimum.at(label, np.maximum(p, q), np.minimum(p, q))
        while (label[label] != label).any():
            label = label[label]
    far = label != np.arange(len(nodes))
    return nodes[far], nodes[label[far]]


def _forests(batches):
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def rows():
        a, b = forest(*(np.concatenate([h[i] for h in held]) for i in range(2)))
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    size = 0
    for batch in batches:
        held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
        size += batch.num_rows
        if size >= RUN:
            yield rows()
            size = 0
    if size:
        yield rows()


def _star(pairs: DataFrame, large: bool, nodes: int) -> DataFrame:
    """pairs (u, v) of so many nodes u at most: large joins u's larger neighbours to the smallest of u and its neighbours; small its smaller ones and u."""
    least = pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = pairs.join(bounded(least, nodes), "u")
    out = joined.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b")) if large else joined.where("v != m").select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.where("a != b") if large else out.where("a != b").distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component) for every node of a link between different nodes; component: the smallest node reachable.

    Null ends and links from a node to itself are left out; no links give no rows.
    """
    spark = links.sparkSession
    python_ready(spark)

    def write(df: DataFrame) -> tuple[DataFrame, str, dict]:
        """The edges as written, with their number and a sum of hashes, taken while they are written."""
        seen = Observation()
        out, path = write_shared(df.observe(seen, F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")), "links")
        return out, path, seen.get

    edges, path, state = write(links.select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).where("a != b and a is not null and b is not null").select(F.col("a").cast("long"), F.col("b").cast("long")))
    while state["n"]:
        edges = edges.mapInArrow(tidy(_forests), "a long, b long")
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = _star(both, True, 2 * state["n"])
        # After the large step a > b, so each node's smaller neighbours are its rows by a.
        small = _star(large.select(F.col("a").alias("u"), F.col("b").alias("v")), False, state["n"])
        edges, later, now = write(small)
        drop_shared(spark, path)
        path = later
        if now == state:
            break
        state = now
    # All edges now go from a node to the smallest one of its component.
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
