"""Connected components of an edge table by alternating star contraction, written as joins and aggregates."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contourlake.llm.common import join_stats, materialize, record_batch

_EDGES = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def local_roots(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """The smallest number in each number's component of a small graph over 0..n-1."""
    root = np.arange(n)
    while len(left):
        new = root.copy()
        np.minimum.at(new, left, root[right])
        np.minimum.at(new, right, root[left])
        new = new[new]
        if (new == root).all():
            break
        root = new
    return root


def contract(batches):
    """Replace the edges of each batch by a star per component; pre-aggregates before the shuffle."""
    for batch in batches:
        u, v = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
        root = local_roots(len(nodes), at[: len(u)], at[len(u) :])
        some = root != np.arange(len(nodes))
        yield record_batch(_EDGES, [nodes[some], nodes[root[some]]])


def connected_components(edges: DataFrame, left: str, right: str, *, contracted: bool = False) -> DataFrame:
    """node, component (its smallest node) for every node that has an edge; both columns are long.

    Each round hangs every larger neighbour and then every smaller neighbour of a node on the smallest
    one, so that the depth shrinks by a constant factor; it ends when a round changes nothing, however many
    rounds that takes. Nodes with very many edges meet their smallest neighbour by broadcast (see ``join_stats``).
    ``contracted`` edges have been through ``contract`` already.
    """
    e = edges.select(F.col(left).alias("u"), F.col(right).alias("v")).filter("u != v")
    e = materialize((e if contracted else e.mapInArrow(contract, "u long, v long")).distinct(), "edges")
    state = e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
    while True:
        both = e.select("u", "v").unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n")
        larger = join_stats(both.filter("v > u"), least, "u", 2 * state[0]).select(F.col("v").alias("u"), F.col("m").alias("v"))
        larger = materialize(larger, "edges-larger")
        least = larger.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        smaller = join_stats(larger, least, "u", 2 * state[0]).select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e"))
        e = materialize(smaller.select(F.col("e.v").alias("u"), F.col("e.m").alias("v")).filter("u != v").distinct(), "edges")
        now = e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == state:
            break
        state = now
    roots = e.select(F.col("v").alias("node")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots.select("node", F.col("node").alias("component")))
