"""Dataflow of graph models: message passing, dense layers, losses, perturbation.

Weights are given or learned by ``pyspark.ml``; training a graph network is not
part of the engine.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plexora.functions.scalar import col, focal_loss
from plexora.session import materialize, small_side


def matvec(rows: Sequence[Sequence[float]], vec: Column | str) -> Column:
    """A constant matrix times an array column, as an expression."""
    v = col(vec)
    return F.array(*(F.aggregate(F.zip_with(v, F.array(*map(F.lit, map(float, r))), lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x) for r in rows))


def attention_layer(nodes: DataFrame, edges: DataFrame, left: Sequence[Sequence[float]], right: Sequence[Sequence[float]], score: Sequence[float], slope: float = 0.2) -> DataFrame:
    """``(g, node, vec)`` after one attention layer over nodes ``(g, node, vec)``
    and edges ``(g, u, v)``, messages going from u to v, each node also to itself.

    The score of an edge is ``score . leaky(left h_v + right h_u)``; a softmax
    over a node's incoming edges weighs ``right h_u``. Two joins and two
    aggregations keyed by (graph, node); a graph is never gathered in one task.
    """
    h = nodes.select("g", "node", matvec(left, "vec").alias("l_"), matvec(right, "vec").alias("r_"))
    links = edges.select("g", "u", "v").where("u <> v").union(nodes.select("g", F.col("node"), F.col("node"))).distinct()
    src = h.select("g", F.col("node").alias("u"), "r_")
    dst = h.select("g", F.col("node").alias("v"), "l_")
    leaky = F.zip_with("l_", "r_", lambda a, b: F.greatest(a + b, F.lit(slope) * (a + b)))
    e = F.aggregate(F.zip_with(leaky, F.array(*map(F.lit, map(float, score))), lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    msg = links.join(src, ["g", "u"]).join(dst, ["g", "v"]).select("g", "v", "r_", e.alias("e"))
    top = msg.groupBy("g", "v").agg(F.max("e").alias("m"))
    w = msg.join(top, ["g", "v"]).select("g", "v", F.exp(F.col("e") - F.col("m")).alias("w"), F.posexplode("r_").alias("pos", "x"))
    out = w.groupBy("g", "v", "pos").agg((F.sum(F.col("w") * F.col("x")) / F.sum("w")).alias("y"))
    return out.groupBy("g", F.col("v").alias("node")).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "y"))), lambda r: r["y"]).alias("vec"))


def mean_pool(nodes: DataFrame, group: str = "g") -> DataFrame:
    """``(group, vec, n)``: the mean over each graph's node vectors."""
    from plexora.operators.network import mean_vectors

    return mean_vectors(nodes, group, "vec")


def gated_pool(nodes: DataFrame, ratio: float) -> DataFrame:
    """Each graph's ``ceil(n * ratio)`` nodes ``(g, node, vec, score)`` of highest
    score, their vectors scaled by ``tanh(score)``."""
    from pyspark.sql import Window

    by = Window.partitionBy("g")
    r = nodes.withColumn("r_", F.row_number().over(by.orderBy(F.desc("score"), "node"))).withColumn("n_", F.count(F.lit(1)).over(by))
    kept = r.where(F.col("r_") <= F.ceil(F.col("n_") * F.lit(ratio)))
    gate = F.tanh("score")
    return kept.withColumn("gate_", gate).select("g", "node", F.transform("vec", lambda x: x * F.col("gate_")).alias("vec"))


def _silu(x: np.ndarray) -> np.ndarray:
    return x / (1 + np.exp(-x))


def _dense(layers: list[tuple[np.ndarray, np.ndarray]], key: str, vec: str) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            if not len(p):
                continue
            x = np.vstack([np.asarray(v, float) for v in p[vec]])
            for i, (w, b) in enumerate(layers):
                x = x @ w + b
                if i < len(layers) - 1:
                    x = _silu(x)
            yield pd.DataFrame({key: p[key], "out": list(x)})

    return run


def dense(rows: DataFrame, key: str, vec: str, layers: Sequence[tuple[Sequence, Sequence]]) -> DataFrame:
    """``(key, out)``: a multilayer perceptron over an array column, in Arrow
    batches. Used as decoder (outputs for the whole vocabulary as one array a
    row) or as class head; weights are a few matrices in the task itself."""
    kind = dict(rows.dtypes)[key]
    mats = [(np.asarray(w, float), np.asarray(b, float)) for w, b in layers]
    return rows.where(F.col(vec).isNotNull()).select(key, vec).mapInPandas(_dense(mats, key, vec), f"{key} {kind}, out array<double>")


def by_presence(preds: DataFrame, nodes: DataFrame) -> DataFrame:
    """Predictions ``(obs, feat, p)`` with ``present`` and the true ``value`` where
    the sample's graph has the node, matched by name and not by position."""
    have = nodes.select("obs", "feat", "value", F.lit(True).alias("present"))
    return preds.join(have, ["obs", "feat"], "left").withColumn("present", F.coalesce("present", F.lit(False)))


def focal(probs: DataFrame, truth: DataFrame, weights: DataFrame | None = None, gamma: float = 2.0) -> DataFrame:
    """One row ``(n, loss)``: the mean focal loss over rows ``(obs, class, prob)``
    at the true class, weighted by ``(class, weight)`` if given."""
    hit = probs.join(truth.select("obs", F.col("truth").alias("class")), ["obs", "class"])
    alpha: Column | float = 1.0
    if weights is not None:
        hit = hit.join(small_side(weights.select("class", "weight")), "class", "left")
        alpha = F.coalesce("weight", F.lit(1.0))
    return hit.agg(F.count(F.lit(1)).alias("n"), F.avg(focal_loss(F.greatest("prob", F.lit(1e-12)), alpha, gamma)).alias("loss"))


def balanced_weights(history: Sequence[Sequence[float]], momentum: float = 0.9, cycle: int = 3) -> list[float]:
    """Weights of several losses from their values epoch by epoch: at the end of
    each ``cycle`` a running mean of inverse losses, normalised to their number."""
    if not history:
        return []
    n = len(history[0])
    w = [1.0] * n
    for start in range(0, len(history) - cycle + 1, cycle):
        mean = [sum(h[i] for h in history[start : start + cycle]) / cycle for i in range(n)]
        inv = [1.0 / max(m, 1e-12) for m in mean]
        new = [n * x / sum(inv) for x in inv]
        w = [momentum * a + (1 - momentum) * b for a, b in zip(w, new)]
    return w


def overlays(long: DataFrame, plan: DataFrame) -> DataFrame:
    """``(obs, target, step, value)``: what each planned ``(feat, step, value)``
    overwrites in every sample that has the feature. The sweep without copies of
    the samples: what it leaves alone is read from ``long``."""
    p = plan.select(F.col("feat").alias("target"), "step", F.col("value").alias("new_"))
    return long.select("obs", F.col("feat").alias("target")).join(small_side(p), "target").select("obs", "target", "step", F.col("new_").alias("value"))


def perturbed(long: DataFrame, plan: DataFrame) -> DataFrame:
    """``(obs, feat, value, target, step)``: for every planned ``(feat, step,
    value)`` each sample that has the feature once more, with it overwritten. The
    result is the sweep itself, samples times plan; samples travel as one row
    each and open up behind the join with their :func:`overlays`."""
    rows = long.groupBy("obs").agg(F.collect_list(F.struct("feat", "value")).alias("x_"))
    cell = overlays(long, plan).withColumnRenamed("value", "new_").join(rows, "obs").select("obs", "target", "step", "new_", F.explode("x_").alias("x"))
    value = F.when(F.col("x.feat") == F.col("target"), F.col("new_")).otherwise(F.col("x.value"))
    return cell.select("obs", F.col("x.feat").alias("feat"), value.alias("value"), "target", "step")


def class_head(old: DataFrame, classes: DataFrame) -> DataFrame:
    """``(class, weights, found)`` for wanted classes from an old head ``(class,
    weights)``: by name, zeros for a class that it lacks."""
    size = old.agg(F.max(F.size("weights")).alias("n_"))
    j = classes.select("class").distinct().join(small_side(old), "class", "left").join(F.broadcast(size))
    return j.select("class", F.coalesce("weights", F.array_repeat(F.lit(0.0), F.col("n_"))).alias("weights"), F.col("weights").isNotNull().alias("found"))


def extended_embeddings(old: DataFrame, names: DataFrame, seed: int = 1) -> DataFrame:
    """``(name, idx, vec, old_or_new)``: an embedding table ``(name, idx, vec)``
    with unseen names appended in alphabetical order. Old rows stay as they are;
    new ones are uniform within the root of 6 over rows and width, by md5 draws,
    so they repeat."""
    from plexora.operators.edges import expand_vocabulary

    head = old.agg(F.max(F.size("vec")).alias("d")).first()
    every = materialize(expand_vocabulary(old.select("name", "idx"), names), "vocabulary")
    bound = (6.0 / (every.count() + (head["d"] or 0) or 1)) ** 0.5
    bits = lambda i: F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), "name", i.cast("string"))), 1, 13), 16, 10).cast("double")
    fresh = F.transform(F.sequence(F.lit(1), F.lit(int(head["d"] or 1))), lambda i: ((bits(i) + 0.5) / float(1 << 52) * 2 - 1) * bound)
    return every.join(old.select("name", "vec"), "name", "left").select("name", "idx", F.coalesce("vec", fresh).alias("vec"), "old_or_new")


def highly_variable(long: DataFrame, n: int, bins: int = 20) -> DataFrame:
    """``(feat, mean, dispersion, score)`` of the ``n`` features that vary most for
    their mean; the smaller feature first among scores that agree to nine places.

    Dispersion is the logarithm of sample variance over mean; the score is its
    distance from the mean of its bin (of equal width over ``log1p`` of the mean)
    in sample deviations of the bin. A feature alone in its bin scores 1; one
    without spread or of mean 0 is left out. One row per feature is ranked.
    """
    per = long.groupBy("feat").agg(F.avg("value").alias("m"), F.var_samp("value").alias("v")).where("m > 0 and v > 0")
    per = per.select("feat", F.log1p("m").alias("mean"), F.ln(F.col("v") / F.col("m")).alias("dispersion"))
    span = per.agg(F.min("mean").alias("lo"), F.max("mean").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    per = per.join(F.broadcast(span)).withColumn("b", F.when(width > 0, F.greatest(F.ceil((F.col("mean") - F.col("lo")) / width) - 1, F.lit(0))).otherwise(F.lit(0)))
    per = materialize(per.select("feat", "mean", "dispersion", "b"), "dispersions")
    of_bin = per.groupBy("b").agg(F.avg("dispersion").alias("a_"), F.stddev_samp("dispersion").alias("s_"))
    score = F.when(F.col("s_").isNull(), F.lit(1.0)).otherwise(F.try_divide(F.col("dispersion") - F.col("a_"), F.col("s_")))
    return per.join(small_side(of_bin), "b").select("feat", "mean", "dispersion", F.coalesce(score, F.lit(0.0)).alias("score")).orderBy(F.desc(F.round("score", 9)), "feat").limit(n)


def batches(rows: DataFrame, order: Sequence[str], size: int) -> DataFrame:
    """``rows`` with ``batch``: consecutive runs of ``size`` in a total order."""
    from plexora.operators.reshape import numbered

    return numbered(rows, order, "n_").withColumn("batch", F.floor(F.col("n_") / size)).drop("n_")


def label_predictor(train: DataFrame, vec: str, label: str, hidden: Sequence[int] = (32,), seed: int = 1, iterations: int = 60):  # noqa: ANN201
    """A fitted multilayer perceptron over array columns and integer labels."""
    from pyspark.ml.classification import MultilayerPerceptronClassifier
    from pyspark.ml.functions import array_to_vector

    rows = train.select(array_to_vector(vec).alias("features"), F.col(label).cast("double").alias("label"))
    shape = train.agg(F.max(F.size(vec)).alias("d"), F.max(label).alias("k")).first()
    net = MultilayerPerceptronClassifier(layers=[shape["d"], *hidden, int(shape["k"]) + 1], seed=seed, maxIter=iterations)
    return net.fit(rows)


def search(train: DataFrame, vec: str, label: str, penalties: Sequence[float], folds: int = 3, seed: int = 1):  # noqa: ANN201
    """The best softmax regression over a grid of penalties by cross-validation."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.evaluation import MulticlassClassificationEvaluator
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.tuning import CrossValidator, ParamGridBuilder

    lr = LogisticRegression(maxIter=40)
    grid = ParamGridBuilder().addGrid(lr.regParam, list(penalties)).build()
    cv = CrossValidator(estimator=lr, estimatorParamMaps=grid, evaluator=MulticlassClassificationEvaluator(metricName="f1"), numFolds=folds, seed=seed)
    return cv.fit(train.select(array_to_vector(vec).alias("features"), F.col(label).cast("double").alias("label")))


def normalized_total(long: DataFrame, target: float = 1e4) -> DataFrame:
    """``log1p`` of values scaled so that each observation sums to ``target``."""
    s = long.groupBy("obs").agg(F.sum("value").alias("s_"))
    v = F.when(F.col("s_") > 0, F.log1p(F.col("value") * target / F.col("s_"))).otherwise(F.lit(0.0))
    return long.join(s, "obs").select("obs", "feat", v.alias("value"))


def scaled(long: DataFrame, limit: float | None = 10.0) -> DataFrame:
    """Values as deviations from their feature's mean in sample deviations,
    clipped; 0 for a constant feature."""
    s = long.groupBy("feat").agg(F.avg("value").alias("m_"), F.stddev_samp("value").alias("s_"))
    z = F.when(F.col("s_") > 0, (F.col("value") - F.col("m_")) / F.col("s_")).otherwise(F.lit(0.0))
    z = z if limit is None else F.greatest(F.least(z, F.lit(limit)), F.lit(-limit))
    return long.join(small_side(s), "feat").select("obs", "feat", z.alias("value"))


def principal_components(rows: DataFrame, key: str, vec: str, k: int) -> DataFrame:
    """``(key, pc)``: the first ``k`` principal components of an array column."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    x = rows.select(key, array_to_vector(vec).alias("x"))
    return PCA(k=k, inputCol="x", outputCol="pc").fit(x).transform(x).select(key, vector_to_array("pc").alias("pc"))
