"""Connected components by contraction.

A round gives every node a representative, the first of itself and its
neighbours in an order that changes from round to round, and keeps what edges
representatives have to each other. That about halves the nodes of a chain and
leaves few of a denser graph, so that all rounds together read little more
than the first. Labels then go back down the rounds.

Every step is a grouped minimum, combined within tasks before the shuffle, and
an equi-join of edges with one row a node, where adaptive execution splits a
hub's edges. The number of rounds is logarithmic.
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelweave.plans.storage import durable, durable_with

#: By how many bits the order of a round is turned against the one before.
TURN = 13


def _joined(rows: DataFrame, nodes: DataFrame, key: str) -> DataFrame:
    """rows with what nodes, one row a node, have for key.

    The key is wrapped, so that rows of nodes are shuffled anew: adaptive
    execution can split a hub's edges only if both sides come from a shuffle.
    """
    wrapped = nodes.withColumn("k", F.struct(key)).drop(key)
    return rows.withColumn("k", F.struct(key)).join(wrapped.hint("merge"), "k").drop("k")


def _turned(ident: Column, by: int) -> Column:
    """ident with its bits turned, which loses nothing."""
    return F.shiftleft(ident, by).bitwiseOR(F.shiftrightunsigned(ident, 64 - by))


def _identified(nodes: DataFrame) -> tuple[DataFrame, int]:
    """(nodes with id, seed): hashes that no two nodes share, with the first seed that has it so."""
    for seed in count():
        known = nodes.withColumn("id", _hash("node", seed))
        if known.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1").isEmpty():
            return known, seed


def _hash(node: str, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), F.col(node))


def _representatives(edges: DataFrame, by: int) -> DataFrame:
    """(u, r): the first of u and its neighbours in the order of turned ids."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    first = both.groupBy("u").agg(F.min(_turned(F.col("v"), by)).alias("m"))
    return first.select("u", _turned(F.least("m", _turned(F.col("u"), by)), 64 - by).alias("r"))


def connected_components(edges: DataFrame, left: str = "u", right: str = "v") -> DataFrame:
    """Rows (node, component) for every node of an edge; component is the least node it reaches.

    Edges are undirected; repeated edges count once. Edges with a null end are
    ignored; a self edge yields its node as its own component. An empty table
    gives an empty result.
    """
    pairs = durable(edges.select(F.col(left).alias("u"), F.col(right).alias("v")).dropna(), "edges")
    nodes, seed = _identified(durable(pairs.select("u").unionByName(pairs.select(F.col("v").alias("u"))).distinct().withColumnRenamed("u", "node"), "nodes"))
    now = pairs.filter("u <> v").select(_hash("u", seed).alias("u"), _hash("v", seed).alias("v"))
    rounds, open_ = [], not now.isEmpty()
    while open_:
        rounds.append(durable(_representatives(now, TURN * len(rounds) % 64), "representatives"))
        moved = _joined(now, rounds[-1], "u").select(F.col("r").alias("w"), F.col("v").alias("u"))
        moved = _joined(moved, rounds[-1], "u").filter("w <> r").select(F.least("w", "r").alias("u"), F.greatest("w", "r").alias("v"))
        now, seen = durable_with(moved.distinct(), "contracted", {"edges": F.count(F.lit(1))})
        open_ = seen["edges"] > 0
    roots = None
    for level in reversed(rounds):
        if roots is not None:
            level = level.join(roots.select(F.col("u").alias("r"), F.col("r").alias("root")).hint("merge"), "r", "left").select("u", F.coalesce("root", "r").alias("r"))
        roots = durable(level, "roots")
    named = nodes.select("node", F.col("id").alias("u"))
    named = named.withColumn("root", F.col("u")) if roots is None else named.join(roots.hint("merge"), "u", "left").withColumn("root", F.coalesce("r", "u"))
    named = durable(named.select("node", "root"), "named")
    least = named.groupBy("root").agg(F.min("node").alias("component"))
    return _joined(named, least, "root").select("node", "component")


def extend_components(components: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, component) after more edges (u, v): only edges between different components are worked through."""
    moved = edges
    for end in ("u", "v"):
        root = components.select(F.col("node").alias(end), F.col("component").alias(f"{end}_root"))
        moved = moved.join(root.hint("merge"), end, "left")
    moved = moved.select(F.coalesce("u_root", "u").alias("u"), F.coalesce("v_root", "v").alias("v")).filter("u <> v")
    joined = durable(connected_components(moved), "joined")
    kept = components.join(joined.select(F.col("node").alias("component"), F.col("component").alias("root")).hint("merge"), "component", "left")
    fresh = joined.join(components.select("node").hint("merge"), "node", "left_anti")
    return kept.select("node", F.coalesce("root", "component").alias("component")).unionByName(fresh.select("node", "component"))
