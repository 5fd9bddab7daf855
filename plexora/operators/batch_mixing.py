"""Batch mixing among nearest neighbours."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plexora.operators.pairwise import nearest_rows
from plexora.session import small_side


def chi2_tail(x: float, k: int) -> float:
    """Upper tail of the chi-squared distribution with ``k`` degrees of freedom,
    by the series or continued fraction of the incomplete gamma function."""
    if x <= 0 or k <= 0:
        return 1.0
    a, x = k / 2, x / 2
    scale = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-15:
            n += 1
            term *= x / n
            total += term
        return max(0.0, 1 - total * scale)
    b = x + 1 - a
    c, d = 1e300, 1 / b
    h = d
    for i in range(1, 100_000):  # about the square root of the degrees of freedom is enough
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h * scale


def neighbourhood_chi2(points: DataFrame, k: int, alpha: float = 0.05) -> DataFrame:
    """One row ``(n, rejected, acceptance)``: for every row ``(node, batch, vec)``
    the batches among its ``k`` nearest rows are tested against the overall
    shares; ``acceptance`` is the share of rows not rejected at ``alpha``.

    The neighbours are exact, found block by block.
    """
    label = points.select(F.col("node").alias("v"), "batch")
    near = nearest_rows(points, k).join(small_side(label), "v")
    seen = near.groupBy("u", "batch").agg(F.count(F.lit(1)).alias("o"))
    total = points.agg(F.count(F.lit(1)).alias("n")).first()["n"]
    batches = points.groupBy("batch").agg((F.count(F.lit(1)) / F.lit(max(total, 1)) * k).alias("e"))
    free = batches.count() - 1
    seen = seen.join(small_side(batches.withColumnRenamed("batch", "b_")), F.col("batch").eqNullSafe(F.col("b_")))
    # sum over seen batches of o^2 / e, less k, is the statistic over all batches
    stat = seen.groupBy("u").agg((F.sum(F.col("o") * F.col("o") / F.col("e")) - F.sum("o")).alias("x"))
    low, high = 0.0, max(1e4, 2.0 * free + 1e3)
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_tail(mid, free) > alpha else (low, mid)
    return stat.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("x") > high).alias("rejected"), F.avg((F.col("x") <= high).cast("double")).alias("acceptance"))
