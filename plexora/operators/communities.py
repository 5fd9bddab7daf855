"""Communities of weighted undirected graphs by modularity."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plexora.operators.edges import endpoints
from plexora.session import materialize, small_side

#: Edges that one task moves nodes over in sequence.
LOCAL_EDGES = 1_000_000


def modularity(edges: DataFrame, modules: DataFrame, resolution: float = 1.0) -> DataFrame:
    """One row ``(modularity)`` of modules ``(node, module)`` over edges ``(u, v,
    w)``, by absolute weights: the inner share of the weight less ``resolution``
    times what the strengths of the modules let expect. A self-loop counts twice
    for its node. Nodes without a module are no part of any; null without weight."""
    e = edges.select("u", "v", F.abs("w").alias("w")).where("w > 0")
    m = small_side(modules.select("node", "module"))
    a = e.join(m.withColumnsRenamed({"node": "u", "module": "mu_"}), "u", "left").join(m.withColumnsRenamed({"node": "v", "module": "mv_"}), "v", "left")
    total = e.agg(F.sum("w").alias("m_"))
    inner = a.where("mu_ = mv_").groupBy(F.col("mu_").alias("module")).agg(F.sum("w").alias("inner_"))
    side = a.select(F.explode(F.array("mu_", "mv_")).alias("module"), "w").where("module is not null").groupBy("module").agg(F.sum("w").alias("d_"))
    per = side.join(inner, "module", "left").join(F.broadcast(total))
    part = F.coalesce("inner_", F.lit(0.0)) / F.col("m_") - resolution * F.pow(F.col("d_") / (2 * F.col("m_")), F.lit(2))
    return per.agg(F.sum(part).alias("modularity"))


def louvain(u: np.ndarray, v: np.ndarray, w: np.ndarray, resolution: float) -> tuple[np.ndarray, np.ndarray]:
    """``(nodes, module of each)``: nodes in falling order of their place move to
    the neighbouring module of highest gain (the first among equals) until a pass
    gains nothing; modules become nodes, and so on until none joins another. A
    module is named by its first node."""
    nodes, flat = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = flat[: len(u)], flat[len(u) :]
    place = np.arange(len(nodes))
    two_m = 2.0 * float(w.sum())
    while True:
        n = int(max(a.max(initial=-1), b.max(initial=-1))) + 1
        loop = np.bincount(a[a == b], w[a == b], minlength=n)
        x, y, s = a[a != b], b[a != b], w[a != b]
        src, dst, val = np.concatenate([x, y]), np.concatenate([y, x]), np.concatenate([s, s])
        order = np.lexsort((dst, src))
        start = np.searchsorted(src[order], np.arange(n + 1)).tolist()
        dst, val = dst[order].tolist(), val[order].tolist()
        strength = (np.bincount(src, np.concatenate([s, s]), minlength=n) + 2 * loop).tolist()
        module, total = list(range(n)), list(strength)
        moved, first = True, True
        while moved:
            moved = False
            for i in range(n):
                own = module[i]
                near: dict[int, float] = {own: 0.0}
                for k in range(start[i], start[i + 1]):
                    c = module[dst[k]]
                    near[c] = near.get(c, 0.0) + val[k]
                total[own] -= strength[i]
                rate = resolution * strength[i] / two_m
                best, gain = own, near[own] - rate * total[own] + 1e-12 * two_m
                for c in sorted(near):
                    g = near[c] - rate * total[c]
                    if g > gain:
                        best, gain = c, g
                total[best] += strength[i]
                if best != own:
                    module[i] = best
                    moved = True
            first = first and not moved
        if first:
            break
        _, new = np.unique(module, return_inverse=True)
        place = new[place]
        pair = np.sort(np.stack([new[a], new[b]]), 0)
        key, at = np.unique(pair[0] * (new.max() + 1) + pair[1], return_inverse=True)
        a, b, w = key // (new.max() + 1), key % (new.max() + 1), np.bincount(at, w)
    head = np.full(place.max(initial=0) + 1, len(nodes))
    np.minimum.at(head, place, np.arange(len(nodes)))
    return nodes, nodes[head[place]]


def _local(resolution: float) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["u", "v"], ignore_index=True)
        nodes, module = louvain(pdf["u"].to_numpy(), pdf["v"].to_numpy(), pdf["w"].to_numpy(float), resolution)
        return pd.DataFrame({"node": nodes, "module": module})

    return work


def _level(edges: DataFrame, resolution: float) -> DataFrame:
    """``(node, module)`` after rounds of joint moves over edges of any number.

    In every round the nodes of one half by hash move at once, each to the
    neighbouring module of highest gain; a round that does not raise the
    modularity is taken back. Two such rounds in a row, one for each half, end it.
    """
    sides = materialize(endpoints(edges.where("u <> v"), "w"), "sides")
    loops = edges.where("u = v").select(F.col("u").alias("node"), F.col("w").alias("l_"))
    strength = sides.groupBy("node").agg(F.sum("w").alias("k_")).join(loops, "node", "full").select("node", (F.coalesce("k_", F.lit(0.0)) + 2 * F.coalesce("l_", F.lit(0.0))).alias("k_"))
    strength = materialize(strength, "strength")
    two_m = 2.0 * edges.agg(F.sum("w")).first()[0]
    cur = materialize(strength.select("node", F.col("node").alias("module")), "modules")
    score = modularity(edges, cur, resolution).first()[0]
    failed, rnd = 0, 0
    while failed < 2:
        total = strength.join(cur, "node").groupBy("module").agg(F.sum("k_").alias("t_"))
        turn = F.pmod(F.xxhash64("node", F.lit(rnd // 2)), F.lit(2)) == rnd % 2
        near = sides.where(turn).join(cur.withColumnRenamed("node", "other"), "other").groupBy("node", "module").agg(F.sum("w").alias("s_"))
        stay = cur.where(turn).withColumn("s_", F.lit(0.0)).select("node", "module", "s_")
        near = near.union(stay).groupBy("node", "module").agg(F.sum("s_").alias("s_"))
        own = cur.withColumnRenamed("module", "own_").join(strength, "node")
        gain = F.col("s_") - resolution * F.col("k_") / two_m * (F.col("t_") - F.when(F.col("module") == F.col("own_"), F.col("k_")).otherwise(F.lit(0.0)))
        scored = near.join(own, "node").join(total, "module").select("node", "module", "own_", gain.alias("g_"))
        best = scored.groupBy("node").agg(F.min_by("module", F.struct(-F.col("g_"), F.col("module") != F.col("own_"), F.col("module"))).alias("best_"))
        new = materialize(cur.join(best, "node", "left").select("node", F.coalesce("best_", "module").alias("module")), "modules")
        got = modularity(edges, new, resolution).first()[0]
        if got > score + 1e-9:
            cur, score, failed = new, got, 0
        else:
            failed += 1
        rnd += 1
    return cur


def communities(edges: DataFrame, resolution: float = 1.3, local_edges: int = LOCAL_EDGES) -> DataFrame:
    """``(node, module)``: modules of edges ``(u, v, w)`` by modularity at a
    resolution, each named by its smallest node.

    Absolute weights count, parallel edges add up, edges without weight and
    self-loops of the input are left out. Above ``local_edges`` edges joint moves
    join nodes to modules, which become nodes; the graph that is left then goes
    through the sequential search in one task. Deterministic: no random order, so
    it stands for the randomised optimisers, whose order cannot be matched.
    """
    weight = F.abs(F.col("w").cast("double"))
    pairs = edges.where("u is not null and v is not null and u <> v and w is not null and not isnan(w) and w <> 0")
    kind = dict(pairs.dtypes)["u"]
    graph = materialize(pairs.groupBy(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).agg(F.sum(weight).alias("w")), "graph")
    found = None
    while graph.count() > local_edges:
        step = _level(graph, resolution)
        shrunk = step.select("module").distinct().count() < step.count()
        found = step if found is None else materialize(found.join(step.toDF("module", "up_"), "module").select("node", F.col("up_").alias("module")), "found")
        if not shrunk:
            break
        a = graph.join(step.toDF("u", "mu_"), "u").join(step.toDF("v", "mv_"), "v")
        graph = materialize(a.groupBy(F.least("mu_", "mv_").alias("u"), F.greatest("mu_", "mv_").alias("v")).agg(F.sum("w").alias("w")), "graph")
    else:
        last = graph.groupBy(F.lit(0).alias("all_")).applyInPandas(_local(resolution), f"node {kind}, module {kind}")
        found = last if found is None else found.join(last.toDF("module", "up_"), "module").select("node", F.col("up_").alias("module"))
    found = materialize(found, "communities")
    name = found.groupBy("module").agg(F.min("node").alias("name_"))
    return found.join(small_side(name), "module").select("node", F.col("name_").alias("module"))
