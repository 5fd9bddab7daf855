"""Reproducible splits and class balancing.

Order comes from ``md5(seed:id)``, the same in any engine, so a split depends
on the data and the seed alone. A stratum with many rows is ranked by counting
hash buckets first, never in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plexora.session import small_side


def hash_order(key: str, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))


def ranked(df: DataFrame, key: str, seed: int, strata: Sequence[str] = ()) -> DataFrame:
    """``df`` with ``rank_`` from 1 in hash order and ``size_``, per stratum.

    The leading three hash digits are 4,096 buckets: their counts give each
    bucket its offset, and only rows of one bucket are sorted together. A hot
    stratum is thus spread over 4,096 groups.
    """
    h = df.withColumn("h_", hash_order(key, seed)).withColumn("b_", F.substring("h_", 1, 3))
    by = list(strata)
    counts = h.groupBy(*by, "b_").agg(F.count(F.lit(1)).alias("c_"))
    within = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))
    before = F.coalesce(F.sum("c_").over(within.orderBy("b_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select(*by, "b_", before.alias("o_"), F.sum("c_").over(within).alias("size_"))
    renamed = offsets.withColumnsRenamed({c: f"{c}__" for c in [*by, "b_"]})
    on = F.lit(True)
    for c in [*by, "b_"]:
        on = on & F.col(c).eqNullSafe(F.col(f"{c}__"))
    local = F.row_number().over(Window.partitionBy(*by, "b_").orderBy("h_", key))
    out = h.withColumn("l_", local).join(small_side(renamed), on)
    return out.withColumn("rank_", F.col("l_") + F.col("o_")).drop("h_", "b_", "l_", "o_", *(f"{c}__" for c in [*by, "b_"]))


def _check(names: Sequence[str], ratios: Sequence[float]) -> None:
    if len(names) != len(ratios) or not names or min(ratios) < 0 or abs(sum(ratios) - 1) > 1e-9:
        raise ValueError("ratios must be as many as names and sum to 1")


def random_split(df: DataFrame, key: str, seed: int, names: Sequence[str] = ("trn", "val", "tst"), ratios: Sequence[float] = (0.8, 0.1, 0.1), strata: Sequence[str] = ()) -> DataFrame:
    """``df`` with ``split``, cut at ``int(cumulative ratio * rows)``, within each
    stratum if any are named; the last split takes the rest."""
    _check(names, ratios)
    out, total = F.lit(names[-1]), 0.0
    cuts = []
    for n, r in zip(names[:-1], ratios[:-1]):
        total += r
        cuts.append((n, total))
    for n, t in reversed(cuts):
        out = F.when(F.col("rank_") <= F.floor(F.col("size_") * F.lit(round(t, 12)) + 1e-9), n).otherwise(out)
    return ranked(df, key, seed, strata).withColumn("split", out).drop("rank_", "size_")


def joint_split(df: DataFrame, key: str, seed: int, strata: Sequence[str], names: Sequence[str] = ("trn", "val", "tst"), ratios: Sequence[float] = (0.8, 0.1, 0.1)) -> DataFrame:
    """Split within the combination of several strata; each size is the rounded
    ratio (halves to even), the last split the rest, none where that is negative."""
    _check(names, ratios)
    out, at = F.lit(names[-1]), F.lit(0)
    cuts = []
    for n, r in zip(names[:-1], ratios[:-1]):
        at = at + F.bround(F.col("size_") * F.lit(r), 0)
        cuts.append((n, at))
    for n, c in reversed(cuts):
        out = F.when(F.col("rank_") <= c, n).otherwise(out)
    return ranked(df, key, seed, strata).withColumn("split", out).drop("rank_", "size_")


def retain(df: DataFrame, key: str, seed: int, strata: Sequence[str], ratio: float) -> DataFrame:
    """``max(1, int(rows * ratio))`` rows of every stratum."""
    k = F.greatest(F.lit(1), F.floor(F.col("size_") * F.lit(ratio) + 1e-9))
    return ranked(df, key, seed, strata).where(F.col("rank_") <= k).drop("rank_", "size_")


def balance(df: DataFrame, key: str, seed: int, strata: Sequence[str], how: str) -> DataFrame:
    """Rows of every stratum brought to one size: ``over`` repeats rows up to the
    largest stratum, ``under`` cuts to the smallest, ``combined`` does both to
    the whole part of the mean. ``copy_`` numbers a row's repeats from 0."""
    pick = {"over": F.max, "under": F.min, "combined": F.avg}
    if how not in pick:
        raise ValueError(f"no strategy named {how}")
    rows = ranked(df, key, seed, strata)
    goal = rows.select(*strata, "size_").distinct().agg(F.floor(pick[how]("size_")).alias("goal_"))
    rows = rows.join(F.broadcast(goal))
    times = F.floor((F.col("goal_") - F.col("rank_")) / F.col("size_"))
    return rows.where(F.col("rank_") <= F.col("goal_")).withColumn("copy_", F.explode(F.sequence(F.lit(0).cast("long"), times))).drop("rank_", "size_", "goal_")


def balanced_split(df: DataFrame, key: str, seed: int, strata: Sequence[str], how: str, first_split: bool = True, **kw) -> DataFrame:  # noqa: ANN003
    """Split, then balance within each split; with ``first_split`` false in the
    other order, where repeats of one row may land in several splits."""
    if first_split:
        return balance(random_split(df, key, seed, strata=strata, **kw), key, seed + 1, ["split", *strata], how)
    tagged = balance(df, key, seed, strata, how).withColumn("unit_", F.concat_ws("#", F.col(key).cast("string"), F.col("copy_").cast("string")))
    return random_split(tagged, "unit_", seed + 1, **kw).drop("unit_")
