"""Connected components of an undirected graph, distributed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plexora.session import materialize


def min_labels(edges: DataFrame, u: str, v: str, max_rounds: int = 60) -> DataFrame:
    """``(node, label)``: every node of ``edges`` with the smallest node of its
    component (in the order of the node type).

    Alternates large-star and small-star steps until the edge set no longer
    changes, a logarithmic number of rounds. Each step is a map-side combined
    minimum per node and an equi-join, which adaptive execution splits where a
    hub has many edges. Every round is written to the shared folder. Null ends
    and self-loops link nothing (a node with only a self-loop is its own
    component); no edges give no rows.
    """
    e = edges.select(F.col(u).alias("u"), F.col(v).alias("v")).where("u is not null and v is not null")
    cur = materialize(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "cc")
    loops = cur.where("u = v").select("u")
    cur, seen = cur.where("u <> v"), None
    for _ in range(max_rounds):
        # large-star: a node links its larger neighbours to the smallest of itself and its neighbours
        both = cur.union(cur.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = materialize(large, "cc")
        # small-star: a node links its smaller neighbours and itself to the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        cur = materialize(small.distinct(), "cc")
        sign = cur.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if sign == seen:
            break
        seen = sign
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    labels = cur.select(F.col("u").alias("node"), F.col("v").alias("label"))
    roots = cur.select(F.col("v").alias("node"), F.col("v").alias("label"))
    alone = loops.select(F.col("u").alias("node"), F.col("u").alias("label"))
    return labels.union(roots.union(alone).join(labels.select("node"), "node", "left_anti").distinct())
