"""Per-key results when a few keys hold most rows."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Stands for an endpoint that names no feature (null or negative index).
NO_KEY = -1


def endpoint_pairs(edges: DataFrame, u: str, v: str, w: str) -> DataFrame:
    """Rows and summed weight of each unordered endpoint pair ``(a, b)``, a <= b.

    Null and negative endpoints become :data:`NO_KEY`; null, NaN weights count
    as rows but add nothing to the weight. The aggregate is algebraic, so Spark
    combines it in bounded hash tables on the map side, and the pair key spreads
    the rows of any one feature over all partitions. An empty table gives none.
    """
    x = F.when(F.col(u) >= 0, F.col(u).cast("long")).otherwise(F.lit(NO_KEY).cast("long"))
    y = F.when(F.col(v) >= 0, F.col(v).cast("long")).otherwise(F.lit(NO_KEY).cast("long"))
    weight = F.col(w).cast("double")
    return (
        edges.select(F.least(x, y).alias("a"), F.greatest(x, y).alias("b"), F.when(~F.isnan(weight), weight).alias("w"))
        .groupBy("a", "b")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("s"))
    )


def feature_totals(edges: DataFrame, u: str, v: str, w: str) -> DataFrame:
    """``(expanded_idx, n_rows, sum_weight, n_partners)`` for every feature.

    A row counts once for each feature it touches (a self-loop once); partners
    are the distinct other features. ``sum_weight`` is null where no usable
    weight exists. Two aggregations, both combined on the map side: the first
    on the pair (salts any hot feature by its partners), the second sums at most
    one state per pair and feature. No join, no window, no Python.
    """
    pairs = endpoint_pairs(edges, u, v, w)
    sides = pairs.select(
        "n",
        "s",
        F.explode(
            F.when(F.col("a") == F.col("b"), F.array(F.struct(F.col("a").alias("k"), F.lit(0).alias("p")))).otherwise(
                F.array(
                    F.struct(F.col("a").alias("k"), (F.col("b") >= 0).cast("int").alias("p")),
                    F.struct(F.col("b").alias("k"), (F.col("a") >= 0).cast("int").alias("p")),
                )
            )
        ).alias("e"),
    )
    return (
        sides.where(F.col("e.k") >= 0)
        .groupBy(F.col("e.k").alias("expanded_idx"))
        .agg(F.sum("n").alias("n_rows"), F.sum("s").alias("sum_weight"), F.sum("e.p").alias("n_partners"))
    )


def heavy_features(edges: DataFrame, u: str, v: str, w: str, share: float = 0.01) -> DataFrame:
    """Features that are an endpoint of at least ``share`` of all rows, with
    their :func:`feature_totals`. Every row counts in the total."""
    total = edges.agg(F.count(F.lit(1)).alias("rows")).scalar()
    return feature_totals(edges, u, v, w).where(F.col("n_rows") >= F.lit(Decimal(str(share))) * total)
