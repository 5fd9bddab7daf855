"""Statistics of long-form matrices ``(obs, feat, value)``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plexora.functions.scalar import finite
from plexora.operators.running import largest, running
from plexora.session import materialize, small_side

QUANTILES = (0.0, 0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99, 1.0)


def feature_stats(long: DataFrame) -> DataFrame:
    """Per feature ``mean, var, std`` (population), ``cv`` (std / mean where the
    mean exceeds 1e-8, else 0), ``n_nonzero`` (values other than 0) and
    ``nonzero_ratio`` (share above 0). Null values count in neither."""
    v = F.col("value")
    cv = F.when(F.col("mean") > 1e-8, F.col("std") / F.col("mean")).otherwise(F.lit(0.0))
    return (
        long.groupBy("feat")
        .agg(
            F.avg(v).alias("mean"),
            F.var_pop(v).alias("var"),
            F.stddev_pop(v).alias("std"),
            F.count_if(v != 0).alias("n_nonzero"),
            F.avg((v > 0).cast("double")).alias("nonzero_ratio"),
        )
        .withColumn("cv", cv)
    )


def moments(long: DataFrame) -> DataFrame:
    """``(feat, mu, n)``: mean and number of the known values, written once."""
    known = long.where(F.col("value").isNotNull())
    return materialize(known.groupBy("feat").agg(F.avg(F.col("value").cast("double")).alias("mu"), F.count(F.lit(1)).alias("n")), "moments")


def windowed_cv(long: DataFrame, spans: Sequence[tuple[int, int]], per: DataFrame | None = None) -> DataFrame:
    """``(feat, cv)``: the largest coefficient of variation (sample deviation
    over absolute mean) over windows of the sorted values and the full range.

    A window mean below 1e-4 or a full mean below 0.01 counts as 0. Prefix sums
    of centred values give each window from two rows, so the work is the sort
    plus one row per window and feature, whatever the window lengths. The last
    window is the full range even where ``spans`` is empty. ``per`` are the
    :func:`moments` where they are known.
    """
    known = long.where(F.col("value").isNotNull()).select("feat", "obs", F.col("value").cast("double").alias("value"))
    per = moments(long) if per is None else per
    c = F.col("value") - F.col("mu")
    terms = known.join(small_side(per), "feat").select("feat", "obs", "value", "mu", "n", F.lit(1).cast("long").alias("one"), c.alias("c"), (c * c).alias("cc"))
    sums = {"r": (F.sum, "one"), "s1": (F.sum, "c"), "s2": (F.sum, "cc")}
    ranked = running(terms, ["feat"], ["value", "obs"], sums, True, largest(per)).select("feat", "mu", "n", "r", "s1", "s2")
    # the ends of the windows and of the range: the only rows that count
    ends = sorted({e for _, e in spans} | {s for s, _ in spans if s})
    ranked = materialize(ranked.where((F.col("r") == F.col("n")) | F.col("r").isin(*ends)) if ends else ranked.where("r = n"), "marks")
    full = ranked.where("r = n").select("feat", "mu", F.col("n").alias("k"), "s1", "s2", F.lit(0.01).alias("floor"))
    if spans:
        marks = ranked
        wins = F.broadcast(long.sparkSession.createDataFrame([(int(s), int(e)) for s, e in spans], "s int, e int"))
        hi = marks.join(wins, F.col("r") == F.col("e")).select("feat", "mu", "s", "e", "s1", "s2")
        lo = marks.select("feat", F.col("r").alias("s"), F.col("s1").alias("t1"), F.col("s2").alias("t2"))
        part = hi.join(lo, ["feat", "s"], "left").select(
            "feat",
            "mu",
            (F.col("e") - F.col("s")).alias("k"),
            (F.col("s1") - F.coalesce("t1", F.lit(0.0))).alias("s1"),
            (F.col("s2") - F.coalesce("t2", F.lit(0.0))).alias("s2"),
            F.lit(1e-4).alias("floor"),
        )
        full = full.union(part)
    mean = F.abs(F.col("mu") + F.col("s1") / F.col("k"))
    var = F.greatest((F.col("s2") - F.col("s1") * F.col("s1") / F.col("k")) / (F.col("k") - 1), F.lit(0.0))
    one = F.when(mean < F.col("floor"), F.lit(0.0)).otherwise(F.sqrt(var) / mean)
    return full.groupBy("feat").agg(F.max(F.when(F.col("k") > 1, one).otherwise(F.lit(0.0))).alias("cv"))


def top_features(cv: DataFrame, n: int = 5000, least: float = 0.1) -> DataFrame:
    """Features with the ``n`` highest ``cv`` (the smaller feature first among
    equals), or with ``cv >= least`` where ``n`` is 0, in order of the feature."""
    if n <= 0:
        return cv.where(F.col("cv") >= least).orderBy("feat")
    return cv.orderBy(F.desc("cv"), "feat").limit(n).orderBy("feat")


def cv_weights(long: DataFrame, log: bool = True) -> DataFrame:
    """``(feat, cv_weight)`` in [0.5, 1]: population cv of ``log1p`` values,
    scaled to 0..1 (0.5 where all are equal), halved, lifted by 0.5 and clipped
    at the 99th percentile. One row per feature reaches the global step."""
    x = F.log1p(F.col("value")) if log else F.col("value")
    per = long.groupBy("feat").agg(F.stddev_pop(x).alias("s"), F.avg(x).alias("m")).select("feat", F.when(F.col("m") > 1e-8, F.col("s") / F.col("m")).otherwise(F.lit(0.0)).alias("cv"))
    span = per.agg(F.min("cv").alias("lo"), F.max("cv").alias("hi"))
    scaled = F.when(F.col("hi") > F.col("lo"), (F.col("cv") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(F.lit(0.5))
    w = per.join(F.broadcast(span)).select("feat", (0.5 + 0.5 * scaled).alias("w"))
    top = w.agg(F.percentile("w", 0.99).alias("p99"))
    return w.join(F.broadcast(top)).select("feat", F.least("w", "p99").alias("cv_weight"))


def summary(df: DataFrame, value: str, exact: bool = True) -> DataFrame:
    """One row: counts, moments, zero and negative share and nine quantiles of
    the finite values. ``exact=False`` takes mergeable sketches for quantiles."""
    v = F.when(finite(value), F.col(value).cast("double"))
    one = df.agg(
        F.count(F.lit(1)).alias("n"),
        F.count(v).alias("n_finite"),
        F.min(v).alias("min"),
        F.avg(v).alias("mean"),
        F.stddev_pop(v).alias("std"),
        F.max(v).alias("max"),
        F.avg((v == 0).cast("double")).alias("zero_ratio"),
        F.avg((v < 0).cast("double")).alias("negative_ratio"),
        *([] if exact else [F.percentile_approx(v, list(QUANTILES), 10_000).alias("quantiles")]),
    )
    return one.join(F.broadcast(quantiles(df, value, QUANTILES).withColumnRenamed("q", "quantiles")), how="left") if exact else one


def perturbation_plan(long: DataFrame, points: int) -> DataFrame:
    """``(feat, step, value)``: ``points`` even values from two deviations below
    the mean to two above, within the observed range; with ``points`` 1 the
    lower end alone. A feature with one value has deviation 0."""
    if points < 1:
        raise ValueError("one point at least")
    s = F.coalesce(F.stddev_samp("value"), F.lit(0.0))
    per = long.groupBy("feat").agg(F.avg("value").alias("m"), s.alias("s"), F.min("value").alias("lo"), F.max("value").alias("hi"))
    lo, hi = F.greatest("lo", F.col("m") - 2 * F.col("s")), F.least("hi", F.col("m") + 2 * F.col("s"))
    step = F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("step")
    return per.select("feat", lo.alias("a"), hi.alias("b"), step).select(
        "feat", "step", (F.col("a") + (F.col("b") - F.col("a")) * F.col("step") / max(points - 1, 1)).alias("value")
    )


def value_counts(df: DataFrame, *columns: str) -> DataFrame:
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))


def missing_report(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per column: rows, distinct values, nulls and their share."""
    if not columns:
        raise ValueError("no columns")
    one = df.agg(
        F.count(F.lit(1)).alias("n"),
        *(F.count_distinct(c).alias(f"d_{i}") for i, c in enumerate(columns)),
        *(F.count_if(F.col(c).isNull()).alias(f"m_{i}") for i, c in enumerate(columns)),
    )
    rows = F.array(*(F.struct(F.lit(c).alias("column"), F.col("n").alias("n_rows"), F.col(f"d_{i}").alias("n_unique"), F.col(f"m_{i}").alias("n_null")) for i, c in enumerate(columns)))
    share = F.when(F.col("n_rows") > 0, F.col("n_null") / F.col("n_rows"))
    return one.select(F.explode(rows).alias("r")).select("r.*").withColumn("missing_rate", share)


def null_cells(df: DataFrame) -> DataFrame:
    """One row: nulls over all columns."""
    total = F.lit(0).cast("long")
    for c in df.columns:
        total = total + F.count_if(F.col(c).isNull())
    return df.agg(total.alias("n_null"))


def class_weights(onehot: DataFrame, columns: Sequence[str]) -> DataFrame:
    """``(class, n, weight)``: inverse frequencies that sum to 1. The last class
    (the unknown one) counts as the mean of all classes, itself included."""
    per = onehot.agg(*(F.sum(c).alias(c) for c in columns))
    rows = per.select(F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(c).alias("class"), F.col(c).cast("double").alias("n")) for i, c in enumerate(columns)))).alias("r")).select("r.*")
    # one row per class: the windows below see no data rows
    every = Window.partitionBy(F.lit(1))
    n = F.when(F.col("i") == len(columns) - 1, F.avg("n").over(every)).otherwise(F.col("n"))
    inv = rows.select("class", n.alias("n")).withColumn("inv", F.when(F.col("n") > 0, 1 / F.col("n")))
    return inv.select("class", "n", (F.col("inv") / F.sum("inv").over(every)).alias("weight"))


def quantiles(df: DataFrame, value: str, qs: Sequence[float], group: Sequence[str] = ()) -> DataFrame:
    """``(group..., q)``: the exact ``qs``-quantiles (linear) of the finite values
    of every group as an array; a null is a group like others, an empty table
    gives no row.

    Values are counted per distinct value (combined on the map side), and running
    counts over range partitions give the order statistics: unlike an exact
    percentile aggregate, no task holds the values of a group.
    """
    # as a struct, a null group is a key like others
    key = F.struct(*group) if group else F.lit(0)
    v = df.where(finite(value)).select(key.alias("g_"), F.col(value).cast("double").alias("v"))
    per = materialize(v.groupBy("g_", "v").agg(F.count(F.lit(1)).alias("k")), "distinct")
    n = per.groupBy("g_").agg(F.sum("k").alias("n"))
    seen = running(per, ["g_"], ["v"], {"before": (F.sum, "k")}).join(small_side(n), "g_")
    place = [(F.col("n") - 1) * F.lit(float(q)) for q in qs]
    at = lambda i: F.max(F.when((F.col("before") <= i) & (i < F.col("before") + F.col("k")), F.col("v")))
    ends = [(at(F.floor(p)), at(F.least(F.floor(p) + 1, F.col("n") - 1))) for p in place]
    got = seen.groupBy("g_", "n").agg(F.array(*(a for a, _ in ends)).alias("a"), F.array(*(b for _, b in ends)).alias("b"))
    rest = F.array(*(p - F.floor(p) for p in place))
    out = F.zip_with(F.zip_with("a", "b", lambda a, b: F.struct(a.alias("a"), b.alias("b"))), rest, lambda e, r: F.when(e["a"] == e["b"], e["a"]).otherwise((1 - r) * e["a"] + r * e["b"]))
    return got.select(*(["g_.*"] if group else []), out.alias("q"))


def first_rows(df: DataFrame, value: str, ties: Sequence[str], k: int) -> DataFrame:
    """The ``k`` rows of highest ``value``, by ``ties`` among equals, nulls last.

    A mergeable sketch leaves out what lies below the cut for certain; running
    counts over range partitions number the rest, so no task gathers ``k`` rows.
    """
    n = df.agg(F.count(F.lit(1)).alias("n"), F.count(value).alias("known")).first()
    if k >= n["n"]:
        return df
    rows = df
    if k <= n["known"] and k > 0:
        share = 1 - k / n["known"] - 2e-4 - 2 / n["known"]
        if share > 0:
            rows = df.where(F.col(value) >= df.agg(F.percentile_approx(value, share, 10_000)).first()[0])
    ranked = running(rows.withColumn("one_", F.lit(1).cast("long")), [], [F.desc(value), *ties], {"r_": (F.sum, "one_")})
    return ranked.where(F.col("r_") < k).select(*df.columns)


def linear_quantile(df: DataFrame, value: str, q: float, rank_error: float = 1e-4) -> float | None:
    """The exact ``q``-quantile with linear interpolation of the finite values,
    null of none.

    A mergeable sketch brackets it, one pass counts the values below the bracket
    and the distinct values inside, whose running counts over range partitions
    give the two order statistics. Unlike an exact percentile aggregate, no task
    holds all distinct values.
    """
    if not 0 <= q <= 1:
        raise ValueError("a quantile lies in [0, 1]")
    v = df.where(finite(value)).select(F.col(value).cast("double").alias("v"))
    got = v.agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).first()
    if not got["n"]:
        return None
    pad = 2 * rank_error + 2 / got["n"]  # sketches count ranks from one, quantiles between ranks
    edges = [max(0.0, q - pad), min(1.0, q + pad)]
    tails = v.agg(F.percentile_approx("v", edges, round(1 / rank_error)).alias("q")).first()["q"]
    low = tails[0] if edges[0] > 0 else got["lo"]
    high = tails[1] if edges[1] < 1 else got["hi"]
    place = (got["n"] - 1) * q
    at = int(place)
    below = v.where(F.col("v") < low).count()
    inside = v.where(F.col("v").between(low, high)).groupBy("v").agg(F.count(F.lit(1)).alias("k"))
    seen = running(inside, [], ["v"], {"before": (F.sum, "k")}).withColumn("before", F.col("before") + below)
    hit = seen.where((F.col("before") <= at + 1) & (F.col("before") + F.col("k") > at)).collect()
    pick = lambda i: next((r["v"] for r in hit if r["before"] <= i < r["before"] + r["k"]), None)
    first, second = pick(at), pick(at + 1)
    if first is None:
        raise ArithmeticError("the sketch did not bracket the quantile")
    if place == at:
        return first
    if second is None:  # the next value lies beyond the bracket
        second = v.where(F.col("v") > high).agg(F.min("v")).first()[0]
    return first + (place - at) * (second - first)


def quantile_filter(df: DataFrame, value: str, threshold: float | None = None, q: float | None = None, group: Sequence[str] = ()) -> DataFrame:
    """Rows with ``value`` at or above the threshold, or, without one, at or
    above its ``q``-quantile (linear) over all rows or each group; all rows
    where neither is given. Null and NaN values are dropped by either."""
    if threshold is None and q is None:
        return df
    good = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    if threshold is not None:
        return good.where(F.col(value) >= threshold)
    if not group:
        return good.where(F.col(value) >= F.lit(linear_quantile(good, value, q)))
    cuts = quantiles(good, value, [q], group).select(*group, F.get("q", F.lit(0)).alias("cut_"))
    return good.join(small_side(cuts), list(group)).where(F.col(value) >= F.col("cut_")).drop("cut_")


def strongest_of(df: DataFrame, value: str, thresholds: Sequence[float | None], q: float | None) -> DataFrame:
    """Rows at or above the highest of several thresholds and the quantile."""
    known = [t for t in thresholds if t is not None]
    good = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    if q is not None:
        good = good.where(F.col(value) >= F.lit(linear_quantile(good, value, q)))
    return good.where(F.col(value) >= max(known)) if known else good


def standardized(df: DataFrame, value: str, train: Column, out: str) -> DataFrame:
    """``out = (value - mean) / deviation`` by the population moments of the
    labelled training rows; a deviation below 1e-8 counts as 1."""
    fit = df.where(train & finite(value)).agg(F.avg(value).alias("m_"), F.stddev_pop(value).alias("s_"))
    scale = F.when(F.col("s_") < 1e-8, F.lit(1.0)).otherwise(F.greatest("s_", F.lit(1e-8)))
    return df.join(F.broadcast(fit)).withColumn(out, (F.col(value) - F.col("m_")) / scale).drop("m_", "s_")


def upper_bins(long: DataFrame) -> DataFrame:
    """``(feat, n, lo, hi, width, n_bins)``: the binning rule of the information
    measure over a feature's whole range. The width is twice the distance from
    the median to the upper quartile (as order statistics) over the cube root of
    the count; ``n_bins`` is null where it is below 3 or above the count."""
    v = long.where(finite("value")).select("feat", "obs", "value", F.lit(1).cast("long").alias("one"))
    per = materialize(v.groupBy("feat").agg(F.count(F.lit(1)).alias("n")), "counts")
    r = running(v, ["feat"], ["value", "obs"], {"r_": (F.sum, "one")}, True, largest(per)).join(small_side(per.withColumnRenamed("n", "n_")), "feat")
    at = lambda q: F.max(F.when(F.col("r_") == F.floor(F.col("n_") * F.lit(q) + 0.5), F.col("value")))
    s = r.groupBy("feat").agg(F.max("n_").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"), (at(0.75) - at(0.5)).alias("d"))
    s = s.withColumn("width", 2 * F.col("d") / F.cbrt(F.col("n").cast("double")))
    k = F.ceil(F.try_divide(F.col("hi") - F.col("lo"), F.col("width")))
    return s.select("feat", "n", "lo", "hi", "width", F.when(k.between(3, F.col("n")), k).cast("int").alias("n_bins"))
