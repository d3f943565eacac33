"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinsift.operators.joins import join_counted
from twinsift.plans.storage import dealt, materialize


def connected_components(edges: DataFrame, left: str = "a", right: str = "b", max_rounds: int = 60) -> DataFrame:
    """``(id, component)`` of every node that has an edge to another; ``component`` is its smallest node.

    Alternates large-star and small-star steps: each hangs a node's neighbours
    under the node's smallest neighbour, so paths halve and a round moves at most
    as many rows as there are edges. Minima are combined before the shuffle, so a
    node with very many neighbours is no hot spot there, and the joins back to the
    edges deal such a node's rows into parts (``join_counted``). Every round is
    written to shared storage, which cuts the lineage.
    """
    smallest = [F.min("v").alias("m"), F.count("*").alias("n")]
    e = edges.select(F.greatest(left, right).alias("u"), F.least(left, right).alias("v")).where("u <> v")
    e, before = materialize(dealt(materialize(e, "links"), "u", "v").distinct(), "edges"), None
    for _ in range(max_rounds):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = materialize(both.groupBy("u").agg(*smallest).select("u", F.least("u", "m").alias("m"), "n"), "low")
        e = join_counted(both.where("v > u"), low, ["u"], ["v"]).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        e = materialize(e, "edges")
        low = materialize(e.groupBy("u").agg(*smallest), "low")
        e = join_counted(e, low, ["u"], ["v"]).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        e = materialize(e, "edges")
        now = e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
