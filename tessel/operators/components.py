"""Connected components of edges, by large-star and small-star rounds.

Every node ends up with the least node of its component.  A round is two aggregations and two joins; there are about
log(n)**2 of them at worst and few on star-like graphs.  Each round's edges are written to the shared folder, so lineage
stays short and lost executors cost one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import Stored, exchanged


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's greater neighbours are joined to its least neighbour."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(exchanged(least), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Each node and its lesser neighbours are joined to the least of these."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    joined = down.join(exchanged(least), "u")
    return joined.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def connected_components(edges: DataFrame, u: str = "u", v: str = "v", most_rounds: int = 60) -> DataFrame:
    """(node, component) of every node that occurs in an edge; the component is its least node.

    Self loops name a node without joining it to others; edges with a null end are left out.
    """
    store = Stored(edges.sparkSession, "components")
    given = store.put(edges.select(F.col(u).alias("u"), F.col(v).alias("v")).where("u is not null and v is not null"), "given")
    now = given.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    last = None
    for k in range(most_rounds):
        now = store.put(_small_star(_large_star(now)), f"edges{k}")
        # forests of stars are the rounds' fixed points: edge count and sum stay as they were
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).head())
        if k:
            store.drop(f"edges{k - 1}")
        if state == last:
            break
        last = state
    else:
        raise RuntimeError(f"components are not stable after {most_rounds} rounds")
    roots = now.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
    nodes = given.select(F.col("u").alias("node")).unionByName(given.select(F.col("v").alias("node"))).distinct()
    return nodes.join(exchanged(roots), "node", "left").select("node", F.coalesce("component", "node").alias("component"))
