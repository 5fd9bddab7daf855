"""Regression, classification and clustering metrics over long predictions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plexora.functions.scalar import finite, pearson
from plexora.operators.pairwise import label_distances
from plexora.operators.running import LOCAL_ROWS, largest, running
from plexora.session import materialize, small_side


def with_rank(df: DataFrame, value: str, group: list[str], out: str, most: int | None = None) -> DataFrame:
    """``df`` with the average rank (from 0) of ``value`` within ``group``; nulls
    come first. ``most`` is the size of the largest group where it is known.

    Groups that a task may go through in order are ranked by windows; with a
    larger one, ranks come from running counts of the distinct values."""
    key = F.struct(*group) if group else F.lit(0)  # as a struct, a null is a group like others
    most = largest(df.groupBy(key.alias("g_")).agg(F.count(F.lit(1)).alias("n"))) if most is None else most
    if group and most <= LOCAL_ROWS:
        low = F.rank().over(Window.partitionBy(*group).orderBy(value)) - 1
        ties = F.count(F.lit(1)).over(Window.partitionBy(*group, value))
        return df.withColumn(out, low + (ties - 1) / 2)
    per = df.groupBy(key.alias("g_"), F.col(value).alias("v_")).agg(F.count(F.lit(1)).alias("k_"))
    rank = running(per, ["g_"], ["v_"], {"b_": (F.sum, "k_")}).select("g_", "v_", (F.col("b_") + (F.col("k_") - 1) / 2).alias(out))
    return df.join(rank, key.eqNullSafe(F.col("g_")) & F.col(value).eqNullSafe(F.col("v_"))).drop("g_", "v_")


def guarded_corr(x: str, y: str) -> Column:
    """Pearson correlation as an aggregate; NaN where a side is constant."""
    flat = (F.stddev_pop(x) < 1e-12) | (F.stddev_pop(y) < 1e-12)
    return F.when(flat, F.lit(float("nan"))).otherwise(pearson(x, y))


def errors(pairs: DataFrame, axis: str) -> DataFrame:
    """``(axis, mse, mae, pearson)`` of rows ``(obs, feat, t, p)``."""
    d = F.col("p") - F.col("t")
    return pairs.groupBy(axis).agg(F.avg(d * d).alias("mse"), F.avg(F.abs(d)).alias("mae"), guarded_corr("t", "p").alias("pearson"))


def jsd(pairs: DataFrame, axis: str) -> DataFrame:
    """``(axis, jsd)``: Jensen-Shannon divergence (natural logarithm) of the
    softmaxes of truth and prediction along the axis."""
    by = Window.partitionBy(axis)
    e = pairs.select(axis, F.exp(F.col("t") - F.max("t").over(by)).alias("a"), F.exp(F.col("p") - F.max("p").over(by)).alias("b"))
    q = e.select(axis, (F.col("a") / F.sum("a").over(by)).alias("a"), (F.col("b") / F.sum("b").over(by)).alias("b"))
    m = (F.col("a") + F.col("b")) / 2
    term = lambda x: F.when(F.col(x) > 0, F.col(x) * F.ln(F.col(x) / m)).otherwise(0.0)
    return q.groupBy(axis).agg(((F.sum(term("a")) + F.sum(term("b"))) / 2).alias("jsd"))


def spearman(pairs: DataFrame, axis: str) -> DataFrame:
    """``(axis, spearman)``: correlation of average ranks; NaN for constants."""
    most = largest(pairs.groupBy(axis).agg(F.count(F.lit(1)).alias("n")))
    r = with_rank(with_rank(pairs, "t", [axis], "rt_", most), "p", [axis], "rp_", most)
    return r.groupBy(axis).agg(guarded_corr("rt_", "rp_").alias("spearman"))


def regression_table(pairs: DataFrame) -> DataFrame:
    """``(metric, sample_mean, feature_mean)``: every metric per observation and
    per feature, then averaged; NaN of a constant carries through."""
    sides = []
    for axis, name in (("obs", "sample_mean"), ("feat", "feature_mean")):
        per = errors(pairs, axis).join(jsd(pairs, axis), axis).join(spearman(pairs, axis), axis)
        names = ["mse", "mae", "pearson", "jsd", "spearman"]
        one = per.agg(*(F.avg(c).alias(c) for c in names))
        rows = F.array(*(F.struct(F.lit(c).alias("metric"), F.col(c).alias(name)) for c in names))
        sides.append(one.select(F.explode(rows).alias("r")).select("r.*"))
    return sides[0].join(sides[1], "metric")


def regression_scores(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """One row: n, mse, rmse, mae, r2 (NaN where the truth is constant), Pearson
    and Spearman over rows where both are finite."""
    ok = df.where(finite(truth) & finite(pred)).select(F.col(truth).cast("double").alias("t"), F.col(pred).cast("double").alias("p"))
    d = F.col("p") - F.col("t")
    base = ok.agg(F.count(F.lit(1)).alias("n"), F.avg(d * d).alias("mse"), F.avg(F.abs(d)).alias("mae"), F.sum(d * d).alias("sse"), F.var_pop("t").alias("vt"), guarded_corr("t", "p").alias("pearson"))
    rank = spearman_global(ok)
    out = base.join(F.broadcast(rank))
    r2 = F.when(F.col("vt") * F.col("n") <= 1e-12, F.lit(float("nan"))).otherwise(1 - F.col("sse") / (F.col("vt") * F.col("n")))
    return out.select("n", "mse", F.sqrt("mse").alias("rmse"), "mae", r2.alias("r2"), "pearson", "spearman")


def spearman_global(ok: DataFrame) -> DataFrame:
    """One row: Spearman over all rows. Ranks come from running counts of the
    distinct values, over range partitions."""
    ranks = {}
    for c in ("t", "p"):
        n = ok.groupBy(c).agg(F.count(F.lit(1)).alias("k"))
        ranks[c] = running(n, [], [c], {"before": (F.sum, "k")}).select(c, (F.col("before") + (F.col("k") - 1) / 2).alias(f"r{c}"))
    return ok.join(ranks["t"], "t").join(ranks["p"], "p").agg(guarded_corr("rt", "rp").alias("spearman"))


def softmaxed(scores: DataFrame) -> DataFrame:
    """Rows ``(obs, class, score)`` with ``prob``, stable per observation."""
    by = Window.partitionBy("obs")
    e = scores.withColumn("e_", F.exp(F.col("score") - F.max("score").over(by)))
    return e.withColumn("prob", F.col("e_") / F.sum("e_").over(by)).drop("e_")


def require_distribution(probs: DataFrame, tolerance: float = 1e-3) -> None:
    """An error if some observation's ``prob`` do not sum to 1."""
    bad = probs.groupBy("obs").agg(F.sum("prob").alias("s")).where((F.abs(F.col("s") - 1) > tolerance) | F.isnan("s") | F.col("s").isNull())
    if not bad.isEmpty():
        raise ValueError("probabilities do not sum to 1")


def best_class(probs: DataFrame, score: str = "prob") -> DataFrame:
    """``(obs, pred)``: the class of highest score, the first class among equals."""
    return probs.groupBy("obs").agg(F.min_by("class", F.struct(-F.col(score), F.col("class"))).alias("pred"))


def confusion(df: DataFrame, truth: str = "truth", pred: str = "pred") -> DataFrame:
    return df.groupBy(F.col(truth).alias("truth"), F.col(pred).alias("pred")).agg(F.count(F.lit(1)).alias("n"))


def class_scores(counts: DataFrame) -> DataFrame:
    """One row of accuracy, F1 (macro, micro, weighted), weighted precision and
    recall, from confusion counts; a class without rows on a side scores 0."""
    t = counts.groupBy(F.col("truth").alias("c")).agg(F.sum("n").alias("support"))
    p = counts.groupBy(F.col("pred").alias("c")).agg(F.sum("n").alias("called"))
    h = counts.where("truth = pred").select(F.col("truth").alias("c"), F.col("n").alias("hits"))
    per = t.join(p, "c", "full").join(h, "c", "left").select("c", *(F.coalesce(x, F.lit(0)).alias(x) for x in ("support", "called", "hits")))
    prec = F.when(F.col("called") > 0, F.col("hits") / F.col("called")).otherwise(0.0)
    rec = F.when(F.col("support") > 0, F.col("hits") / F.col("support")).otherwise(0.0)
    f1 = F.when(F.col("called") + F.col("support") > 0, 2 * F.col("hits") / (F.col("called") + F.col("support"))).otherwise(0.0)
    s = F.sum("support")
    return per.agg(
        (F.sum("hits") / s).alias("accuracy"),
        F.avg(f1).alias("f1_macro"),
        (F.sum("hits") / s).alias("f1_micro"),
        (F.sum(f1 * F.col("support")) / s).alias("f1_weighted"),
        (F.sum(prec * F.col("support")) / s).alias("precision_weighted"),
        (F.sum(rec * F.col("support")) / s).alias("recall_weighted"),
    )


def auroc(probs: DataFrame, truth: DataFrame) -> DataFrame:
    """``(class, support, auroc, auprc)`` one against the rest, from rows
    ``(obs, class, prob)`` and ``(obs, truth)``; null for a class without
    positives or negatives. Scores are first counted per distinct value."""
    rows = probs.join(truth, "obs").select("class", "prob", (F.col("class") == F.col("truth")).cast("int").alias("y"))
    n = rows.groupBy("class", "prob").agg(F.count(F.lit(1)).alias("k"), F.sum("y").alias("pos"))
    seen = running(n, ["class"], ["prob"], {"k_before": (F.sum, "k"), "pos_before": (F.sum, "pos")})
    sums = n.groupBy("class").agg(F.sum("pos").alias("np"), F.sum("k").alias("n"))
    w = seen.join(small_side(sums), "class").select(
        "class", "pos", "np", "n",
        (F.col("k_before") + (F.col("k") + 1) / 2).alias("rank"),
        (F.col("np") - F.col("pos_before")).alias("tp"),
        (F.col("n") - F.col("k_before")).alias("called"),
    )
    npos, nneg = F.max("np"), F.max("n") - F.max("np")
    area = F.try_divide(F.sum(F.col("pos") * F.col("rank")) - npos * (npos + 1) / 2, npos * nneg)
    ap = F.sum(F.try_divide("pos", "np") * F.col("tp") / F.col("called"))
    return w.groupBy("class").agg(npos.alias("support"), F.when((npos > 0) & (nneg > 0), area).alias("auroc"), F.when(npos > 0, ap).alias("auprc"))


def weighted_auc(per: DataFrame) -> DataFrame:
    """One row: the means of :func:`auroc` weighted by support; NaN if undefined."""
    m = lambda c: F.coalesce(F.sum(F.col(c) * F.col("support")) / F.sum(F.when(F.col(c).isNotNull(), F.col("support"))), F.lit(float("nan")))
    return per.agg(m("auroc").alias("auroc"), m("auprc").alias("auprc"))


def clustering_scores(counts: DataFrame) -> DataFrame:
    """One row: adjusted Rand index and normalised mutual information (arithmetic
    mean) of two labelings, from their contingency ``(truth, pred, n)``."""
    two = lambda x: x * (x - 1) / 2
    n = F.col("n").cast("double")
    a = counts.groupBy("truth").agg(F.sum("n").cast("double").alias("a"))
    b = counts.groupBy("pred").agg(F.sum("n").cast("double").alias("b"))
    tot = counts.agg(F.sum("n").cast("double").alias("tot"), F.sum(two(n)).alias("sij"))
    sa = a.join(F.broadcast(tot)).agg(F.sum(two(F.col("a"))).alias("sa"), F.sum(-F.col("a") / F.col("tot") * F.ln(F.col("a") / F.col("tot"))).alias("ha"))
    sb = b.join(F.broadcast(tot)).agg(F.sum(two(F.col("b"))).alias("sb"), F.sum(-F.col("b") / F.col("tot") * F.ln(F.col("b") / F.col("tot"))).alias("hb"))
    mi = counts.join(a, "truth").join(b, "pred").join(F.broadcast(tot)).agg(F.sum(n / F.col("tot") * F.ln(n * F.col("tot") / (F.col("a") * F.col("b")))).alias("mi"))
    one = tot.join(F.broadcast(sa)).join(F.broadcast(sb)).join(F.broadcast(mi))
    want = F.coalesce(F.try_divide(F.col("sa") * F.col("sb"), two(F.col("tot"))), F.lit(0.0))
    mean = (F.col("sa") + F.col("sb")) / 2
    ari = F.when(mean == want, F.lit(1.0)).otherwise((F.col("sij") - want) / (mean - want))
    h = (F.col("ha") + F.col("hb")) / 2
    return one.select(ari.alias("ari"), F.when(h < 1e-15, F.lit(1.0)).otherwise(F.greatest(F.col("mi"), F.lit(0.0)) / h).alias("nmi"))


def _log_factorial(n: np.ndarray) -> np.ndarray:
    """Natural logarithms of factorials: a table below 256, else Stirling's series
    (relative error below 1e-16 there)."""
    x = np.asarray(n, float)
    table = np.concatenate([[0.0], np.cumsum(np.log(np.arange(1, 256)))])
    big = np.maximum(x, 255.0)
    series = (big + 0.5) * np.log(big) - big + 0.5 * np.log(2 * np.pi) + 1 / (12 * big) - 1 / (360 * big**3)
    return np.where(x < 256, table[np.minimum(x, 255).astype(np.int64)], series)


def _expected_information(sizes: np.ndarray, times: np.ndarray, total: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Per size of a class of one labeling, its part of the information that
    chance gives with all sizes of the other. A shared count lies within forty
    deviations of its mean; what is beyond adds less than double precision."""

    def work(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tail = _log_factorial(np.array([total]))[0]
        for p in parts:
            out = []
            for x in p["x"].to_numpy(np.int64):
                acc = 0.0
                for y, t in zip(sizes, times):
                    mean = x * (y / total)
                    dev = np.sqrt(max(mean * (1 - x / total) * (total - y) / max(total - 1, 1), 0.0))
                    low = max(1, x + y - total, int(mean - 40 * dev - 40))
                    high = min(x, y, int(mean + 40 * dev + 40))
                    n = np.arange(low, high + 1, dtype=np.int64)
                    lf = _log_factorial
                    e = lf(np.array([x, y, total - x, total - y])).sum() - tail - lf(n) - lf(x - n) - lf(y - n) - lf(total - x - y + n)
                    acc += t * float((n / total * (np.log(total) + np.log(n) - np.log(float(x)) - np.log(float(y))) * np.exp(e)).sum())
                out.append(acc)
            yield pd.DataFrame({"x": p["x"], "e": out})

    return work


def adjusted_mutual_information(counts: DataFrame) -> float:
    """AMI (arithmetic mean) of a contingency ``(truth, pred, n)``; 1 of none or
    where both sides have one class.

    What chance gives depends on the sizes of the classes only, so distinct sizes
    are compared, in tasks over those of one side. Those of the other (fewer than
    the root of twice the rows, 11 MB at a million millions) are the only numbers
    that reach the driver besides sums.
    """
    counts = materialize(counts.where("n > 0").select("truth", "pred", F.col("n").cast("long").alias("n")), "cells")
    sides = {c: materialize(counts.groupBy(c).agg(F.sum("n").alias("x")), "sizes") for c in ("truth", "pred")}
    total = counts.agg(F.sum("n")).first()[0]
    if not total or all(s.limit(2).count() == 1 for s in sides.values()):
        return 1.0
    share = lambda c: F.col(c) / F.lit(float(total))
    entropy = {c: s.agg(F.sum(-share("x") * F.ln(share("x")))).first()[0] for c, s in sides.items()}
    cells = counts.join(sides["truth"].withColumnRenamed("x", "a"), "truth").join(sides["pred"].withColumnRenamed("x", "b"), "pred")
    mi = cells.agg(F.sum(share("n") * F.ln(F.col("n").cast("double") / F.col("a") / F.col("b") * float(total)))).first()[0]
    distinct = {c: s.groupBy("x").agg(F.count(F.lit(1)).alias("t")) for c, s in sides.items()}
    other = distinct["pred"].orderBy("x").toPandas()
    tasks = counts.sparkSession.sparkContext.defaultParallelism * 4
    part = distinct["truth"].repartition(tasks, "x")
    want = part.select("x").mapInPandas(_expected_information(other["x"].to_numpy(np.int64), other["t"].to_numpy(np.int64), int(total)), "x long, e double")
    expected = want.join(distinct["truth"], "x").agg(F.sum(F.col("t") * F.col("e"))).first()[0]
    mean = (entropy["truth"] + entropy["pred"]) / 2
    return (mi - expected) / (mean - expected) if abs(mean - expected) > 1e-15 else 1.0


def silhouette(points: DataFrame) -> DataFrame:
    """``(silhouette, silhouette_label)``: the mean silhouette width of rows
    ``(obs, label, vec)`` and its rescaling to 0..1, by Euclidean distance.

    Every row is compared with every other, the definition of the measure, in
    blocks of which only sums per label leave a task. Labels with one member
    score 0; rows with a null part take no part.
    """
    per = label_distances(points)
    own = F.max(F.when(F.col("li") == F.col("lj"), F.col("d")))
    other = F.min(F.when(F.col("li") != F.col("lj"), F.col("d")))
    s = per.groupBy("i").agg(own.alias("a"), other.alias("b"))
    wide = F.greatest("a", "b")
    s = s.select(F.when(F.col("a").isNull() | F.col("b").isNull() | (wide == 0), F.lit(0.0)).otherwise(F.try_divide(F.col("b") - F.col("a"), wide)).alias("s"))
    return s.agg(F.avg("s").alias("silhouette")).select("silhouette", ((F.col("silhouette") + 1) / 2).alias("silhouette_label"))


# Fragments of metric names and whether a higher value is better.
DIRECTIONS = (("loss", False), ("mse", False), ("mae", False), ("rmse", False), ("jsd", False), ("f1", True), ("acc", True), ("auc", True), ("auroc", True), ("auprc", True), ("pearson", True), ("spearman", True), ("r2", True), ("precision", True), ("recall", True))


# The names under which metrics are shown.
TITLES = {
    "jsd": "1 - JSD",
    "mae": "1 - MAE",
    "mse": "1 - MSE",
    "pcc": "PCC",
    "spearman": "Spearman",
    "weighted_recall": "Recall (weighted)",
    "weighted_precision": "Precision (weighted)",
    "weighted_f1": "F1 Score (weighted)",
    "macro_f1": "F1 Score (macro)",
    "micro_f1": "F1 Score (micro)",
    "auprc": "AUPRC",
    "auroc": "AUROC",
    "accuracy": "ACC",
    "kbet": "kBET",
    "asw": "ASW",
    "ari": "ARI",
    "nmi": "NMI",
    "ami": "AMI",
}


def titled(df: DataFrame, metric: str = "metric", value: str = "value") -> DataFrame:
    """``df`` with ``title`` and ``shown``: the name under which a metric is shown
    (its own name without one) and its value, 1 less the value of an error."""
    names = F.create_map(*(F.lit(x) for pair in TITLES.items() for x in pair))
    title = F.coalesce(F.try_element_at(names, F.col(metric)), F.col(metric))
    return df.withColumn("title", title).withColumn("shown", F.when(F.startswith("title", F.lit("1 - ")), 1 - F.col(value)).otherwise(F.col(value)))


def metric_deltas(before: DataFrame, after: DataFrame) -> DataFrame:
    """``(metric, before, after, delta, improved)`` of metrics in both tables,
    ``improved`` by the first fragment that the name contains, null without one."""
    d = F.col("after") - F.col("before")
    good = F.lit(None).cast("boolean")
    for part, up in reversed(DIRECTIONS):
        good = F.when(F.contains(F.lower("metric"), F.lit(part)), d > 0 if up else d < 0).otherwise(good)
    both = before.select("metric", F.col("value").alias("before")).join(after.select("metric", F.col("value").alias("after")), "metric")
    return both.select("metric", "before", "after", d.alias("delta"), good.alias("improved"))
