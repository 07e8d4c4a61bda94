"""Connected components of an edge table, without a driver-side union-find."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchloom.session import materialize, shuffled


def connected_components(edges: DataFrame, a: str, b: str, max_rounds: int = 60) -> DataFrame:
    """(node, component): each node of an edge with the smallest node it can reach.

    Alternates large and small stars: every node's larger neighbours, then its smaller ones, are linked to
    the smallest neighbour. Rounds grow with the logarithm of the diameter. Each round is written to the
    shared folder, so lineage stays short; a table that still changes after ``max_rounds`` is an error. Null ends and loops are left out."""
    e = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter(F.col(a).isNotNull() & F.col(b).isNotNull()).filter("u <> v").distinct()
    e = materialize(e, "edges")
    nodes = e.select(F.col("u").alias("node")).union(e.select("v")).distinct()
    before = None
    for _ in range(max_rounds):
        both = e.unionAll(e.select(F.col("v"), F.col("u")).toDF("u", "v"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("x"), F.least("u", "m").alias("m"))
        large = both.join(shuffled(low), both["u"] == low["x"]).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "x")
        both = large.join(shuffled(least), large["u"] == least["x"])
        small = both.select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v").filter("u <> v").distinct()
        e = materialize(small, "edges")
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == before:
            break
        before = tuple(now)
    else:
        raise RuntimeError(f"components still changed after {max_rounds} rounds")
    found = e.groupBy("u").agg(F.min("v").alias("component"))
    return nodes.join(shuffled(found), nodes["node"] == found["u"], "left").select("node", F.coalesce("component", "node").alias("component"))
