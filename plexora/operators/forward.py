"""The forward pass of a graph network over given weights, as dataflow.

Training is not part of the engine; weights come as plain matrices and an
embedding table. Every step is a join, an aggregation or an Arrow batch keyed by
graph and node, so graphs spread over all tasks.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plexora.operators.model import attention_layer, dense, mean_pool
from plexora.session import materialize, small_side

Matrix = Sequence[Sequence[float]]


@dataclass(frozen=True)
class Weights:
    """``project`` turns a value into a vector (weights, biases); ``fuse`` are the
    dense layers over id vector and projection; ``attention`` holds ``(left,
    right, score)`` per layer; ``scale`` and ``shift`` belong to the norm."""

    project: tuple[Sequence[float], Sequence[float]]
    fuse: Sequence[tuple[Matrix, Sequence[float]]]
    attention: Sequence[tuple[Matrix, Matrix, Sequence[float]]] = field(default_factory=tuple)
    scale: Sequence[float] = ()
    shift: Sequence[float] = ()


def layer_norm(vec: str, scale: Sequence[float], shift: Sequence[float], eps: float = 1e-5) -> Column:
    """An array column less its mean, over its population deviation, scaled and
    shifted element by element; null for null."""
    n = F.size(vec)
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x)
    # bound by outer transforms, mean and deviation are computed once a row
    by_mean = lambda m: F.transform(F.array(total(F.transform(vec, lambda x: (x - m) * (x - m))) / n), lambda v: F.transform(vec, lambda x: (x - m) / F.sqrt(v + eps)))
    out = F.get(F.flatten(F.transform(F.array(total(F.col(vec)) / n), by_mean)), F.lit(0))
    out = F.zip_with(out, F.array(*map(F.lit, map(float, scale))), lambda x, g: x * g)
    return F.when(F.col(vec).isNotNull(), F.zip_with(out, F.array(*map(F.lit, map(float, shift))), lambda x, b: x + b))


def node_vectors(nodes: DataFrame, edges: DataFrame, ids: DataFrame, weights: Weights, edgeless: str = "keep") -> DataFrame:
    """``(g, node, vec)`` of nodes ``(g, node, x)`` in graphs with edges ``(g, u, v)``.

    The id vector ``(node, vec)`` and the projected value are fused by dense
    layers; the attention layers follow in graphs that have an edge between two
    of their nodes, then the norm. Graphs without one get the norm alone, or with
    ``edgeless`` ``skip`` no rows. Nodes without an id vector are dropped.
    """
    if edgeless not in ("keep", "skip"):
        raise ValueError(f"no way named {edgeless}")
    w, b = weights.project
    value = F.array(*(F.col("x").cast("double") * F.lit(float(p)) + F.lit(float(q)) for p, q in zip(w, b)))
    rows = nodes.join(small_side(ids.select("node", F.col("vec").alias("id_"))), "node")
    fused = dense(rows.select(F.struct("g", "node").alias("k_"), F.concat("id_", value).alias("vec")), "k_", "vec", weights.fuse)
    h = materialize(fused.select("k_.g", "k_.node", F.col("out").alias("vec")), "fused")
    known = h.select("g", "node")
    inner = edges.select("g", "u", "v").where("u <> v").join(known.withColumnRenamed("node", "u"), ["g", "u"], "left_semi").join(known.withColumnRenamed("node", "v"), ["g", "v"], "left_semi")
    inner = materialize(inner.select("g", "u", "v"), "inner")
    linked = inner.select("g").distinct()
    out = h.join(linked, "g", "left_semi")
    for left, right, score in weights.attention:
        out = materialize(attention_layer(out, inner, left, right, score), "layer")
    if edgeless == "keep":
        out = out.select("g", "node", "vec").unionByName(h.join(linked, "g", "left_anti").select("g", "node", "vec"))
    return out.select("g", "node", layer_norm("vec", weights.scale, weights.shift).alias("vec"))


def graph_vectors(vectors: DataFrame, edges: DataFrame, hops: int = 2) -> DataFrame:
    """``(g, vec)``: the mean over the multi-scale subgraphs of each graph, each
    the mean of its nodes' vectors; zeros for a graph without edges or subgraphs."""
    from plexora.operators.edges import centrality
    from plexora.operators.greedy import multiscale_subgraphs

    size = vectors.agg(F.max(F.size("vec"))).first()[0] or 0
    kept, nodes = centrality(edges, vectors)
    parts = multiscale_subgraphs(nodes, kept.select("g", "u", "v"), hops)
    member = parts.join(vectors, ["g", "node"]).select(F.struct("g", "subgraph").alias("g"), "vec")
    pooled = mean_pool(member, "g").select("g.g", "vec")
    whole = mean_pool(pooled, "g")
    zero = F.array_repeat(F.lit(0.0), int(size))
    return vectors.select("g").distinct().join(whole, "g", "left").select("g", F.coalesce("vec", zero).alias("vec"))


def predictions(graphs: DataFrame, decoder: Sequence[tuple[Matrix, Sequence[float]]], head: Sequence[tuple[Matrix, Sequence[float]]]) -> DataFrame:
    """``(g, embedding, recon, logits, label)`` of graph vectors ``(g, vec)``: the
    values of the whole vocabulary, the class scores and the best class (the
    first among equals)."""
    from plexora.functions.scalar import argmax

    g = graphs.select("g", F.col("vec").alias("embedding"))
    recon = dense(graphs, "g", "vec", decoder).withColumnRenamed("out", "recon")
    scores = dense(graphs, "g", "vec", head).withColumnRenamed("out", "logits")
    return g.join(recon, "g", "left").join(scores, "g", "left").withColumn("label", argmax("logits"))
