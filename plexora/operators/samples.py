"""Per-sample active subgraphs over a long matrix and a shared edge table."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plexora.functions.scalar import finite
from plexora.operators.edges import endpoints
from plexora.session import materialize, small_side

#: Edges that go along with the samples' tasks (24 bytes each).
MAX_EDGES = 2_000_000


def active(long: DataFrame, eps: float = 1e-6) -> DataFrame:
    """Rows whose absolute value exceeds ``eps``; null and NaN are inactive."""
    return long.where(finite("value") & (F.abs("value") > eps))


def _sample_rows(long: DataFrame) -> DataFrame:
    """``(obs, feats, values)``: a sample's rows as two arrays in order of the feature."""
    x = F.array_sort(F.collect_list(F.struct("feat", "value")))
    return long.groupBy("obs").agg(x.alias("x_")).select("obs", F.transform("x_", lambda r: r["feat"]).alias("feats"), F.transform("x_", lambda r: r["value"].cast("double")).alias("values"))


def _edge_arrays(edges: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
    """``(names, u, v, w)`` of an edge table on the driver, the ends as places in
    the sorted ``names``, in order of ``u``; none beyond :data:`MAX_EDGES`."""
    e = materialize(edges.select("u", "v", F.col("w").cast("double").alias("w")), "edges")
    if e.limit(MAX_EDGES + 1).count() > MAX_EDGES:
        return None
    got = e.toPandas()
    names = np.unique(np.concatenate([got["u"].to_numpy(), got["v"].to_numpy()]))
    u, v = np.searchsorted(names, got["u"].to_numpy()), np.searchsorted(names, got["v"].to_numpy())
    order = np.lexsort((v, u))
    return names, u[order], v[order], got["w"].to_numpy(float)[order]


def _inner_edges(names: np.ndarray, u: np.ndarray, v: np.ndarray, sample: np.ndarray, feat: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(edge, row of u, row of v)`` for the edges of which both ends are rows of
    the same sample. Rows come by sample, then feature."""
    place = np.searchsorted(names, feat)
    known = place < len(names)
    known[known] = names[place[known]] == feat[known]
    rows = np.flatnonzero(known)
    key = sample[rows] * np.int64(len(names)) + place[rows]
    first, last = np.searchsorted(u, place[rows]), np.searchsorted(u, place[rows], "right")
    out = []
    # a bounded number of candidates at a time
    parts = np.searchsorted(np.cumsum(last - first), np.arange(4_000_000, (last - first).sum() + 4_000_000, 4_000_000))
    for a, b in zip(np.r_[0, parts], np.r_[parts, len(rows)]):
        n = (last - first)[a:b]
        own = np.repeat(np.arange(a, b), n)
        edge = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[a:b], n)
        want = sample[rows[own]] * np.int64(len(names)) + v[edge]
        at = np.minimum(np.searchsorted(key, want), max(len(key) - 1, 0))
        hit = key[at] == want if len(key) else np.zeros(0, bool)
        out.append((edge[hit], rows[own[hit]], rows[at[hit]]))
    return tuple(np.concatenate(x) if out else np.zeros(0, np.int64) for x in zip(*out)) if out else (np.zeros(0, np.int64),) * 3


def _subgraph_task(arrays: tuple, threshold: float, top: np.ndarray, ranked: np.ndarray, min_features: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Nodes and edges of whole samples; ``ranked`` lists features by falling cv."""
    names, u, v, w = arrays
    strong = w > threshold
    order = np.argsort(ranked, kind="stable")

    def work(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            n = p["feats"].map(len).to_numpy()
            if not n.sum():
                continue
            sample = np.repeat(np.arange(len(p)), n)
            feat, value = np.concatenate(p["feats"].to_numpy()), np.concatenate(p["values"].to_numpy()).astype(float)
            chosen = np.isin(feat, top)
            _, a, b = _inner_edges(names, u[strong], v[strong], sample, feat)
            chosen[a] = chosen[b] = True
            if min_features > 0:
                # chosen ones first, then by cv; features without one last, by name
                at = np.searchsorted(ranked[order], feat)
                at = np.minimum(at, max(len(ranked) - 1, 0))
                rank = np.where(ranked[order][at] == feat, order[at], len(ranked)) if len(ranked) else np.zeros(len(feat), np.int64)
                line = np.lexsort((np.arange(len(feat)), rank, ~chosen, sample))
                place = np.empty(len(feat), np.int64)
                place[line] = np.arange(len(feat)) - np.repeat(np.cumsum(n) - n, n)
                chosen |= place < min_features
            rows = np.flatnonzero(chosen)
            s, f = sample[rows], feat[rows]
            count = np.bincount(s, minlength=len(p))
            idx = (np.arange(len(rows)) - (np.cumsum(count) - count)[s]).astype(np.int32)
            edge, a, b = _inner_edges(names, u, v, s, f)
            obs = p["obs"].to_numpy()
            yield pd.DataFrame({"obs": obs[s], "kind": np.int8(0), "u": f, "v": None, "x": value[rows], "iu": idx, "iv": np.int32(-1)})
            yield pd.DataFrame({"obs": obs[s[a]], "kind": np.int8(1), "u": f[a], "v": f[b], "x": w[edge], "iu": idx[a], "iv": idx[b]})

    return work


def active_subgraphs(long: DataFrame, edges: DataFrame, cv: DataFrame, threshold: float, n_top: int, min_features: int, eps: float = 1e-6) -> tuple[DataFrame, DataFrame]:
    """``(nodes, edges)`` of every sample: ``(obs, feat, value, idx)`` and
    ``(obs, u, v, w, iu, iv)``.

    Nodes are the active ends of edges above ``threshold`` of which both ends
    are active, and the active among the ``n_top`` features of highest ``cv``;
    below ``min_features`` nodes the active features of highest ``cv`` fill up.
    The edges are all those between chosen nodes, also weaker ones. ``idx``
    numbers a sample's nodes from 0 in order of the feature. A sample without
    active features gives no rows. Works unchanged for held-out samples with the
    training vocabulary, edges and cv.

    The matrix is shuffled once, into one row per sample; both ends of an edge
    are looked up there, in Arrow batches, so no sample is multiplied by the
    neighbours of its nodes. The edge table goes along up to :data:`MAX_EDGES`
    rows; beyond that samples and edges meet by joins on both ends.
    """
    live = active(long, eps).select("obs", "feat", "value")
    cv = materialize(cv.select("feat", "cv"), "cv")
    arrays = _edge_arrays(edges)
    if arrays is None:
        return _joined_subgraphs(live, edges, cv, threshold, n_top, min_features)
    ranked = cv.orderBy(F.desc_nulls_last("cv"), "feat").toPandas()["feat"].to_numpy()
    kinds = dict(live.dtypes)
    task = _subgraph_task(arrays, threshold, ranked[:n_top], ranked, min_features)
    schema = f"obs {kinds['obs']}, kind byte, u {kinds['feat']}, v {kinds['feat']}, x double, iu int, iv int"
    both = materialize(_sample_rows(live).mapInPandas(task, schema), "subgraphs")
    nodes = both.where("kind = 0").select("obs", F.col("u").alias("feat"), F.col("x").alias("value"), F.col("iu").alias("idx"))
    return nodes, both.where("kind = 1").select("obs", "u", "v", F.col("x").alias("w"), "iu", "iv")


def _joined_subgraphs(live: DataFrame, edges: DataFrame, cv: DataFrame, threshold: float, n_top: int, min_features: int) -> tuple[DataFrame, DataFrame]:
    """:func:`active_subgraphs` by joins, for edge tables of any size."""
    here = live.select("obs", "feat")
    strong = edges.where(F.col("w") > threshold).select("u", "v")
    both = (
        here.withColumnRenamed("feat", "u")
        .join(small_side(strong), "u")
        .join(here.withColumnRenamed("feat", "v"), ["obs", "v"])
        .select("obs", F.explode(F.array("u", "v")).alias("feat"))
    )
    top = cv.orderBy(F.desc("cv"), "feat").limit(n_top).select("feat")
    chosen = both.union(here.join(small_side(top), "feat").select("obs", "feat")).distinct().withColumn("in_", F.lit(1))
    ranked = live.join(chosen, ["obs", "feat"], "left").join(small_side(cv), "feat", "left")
    by = Window.partitionBy("obs")
    fill = F.row_number().over(by.orderBy(F.col("in_").desc_nulls_last(), F.col("cv").desc_nulls_last(), "feat"))
    nodes = ranked.withColumn("r_", fill).where((F.col("in_") == 1) | (F.col("r_") <= min_features))
    nodes = materialize(nodes.withColumn("idx", F.row_number().over(by.orderBy("feat")) - 1).select("obs", "feat", "value", "idx"), "nodes")
    return nodes, induced(nodes, edges)


def _induced_task(arrays: tuple) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    names, u, v, w = arrays

    def work(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            n = p["feats"].map(len).to_numpy()
            if not n.sum():
                continue
            sample, feat = np.repeat(np.arange(len(p)), n), np.concatenate(p["feats"].to_numpy())
            idx = np.concatenate(p["values"].to_numpy()).astype(np.int32)
            edge, a, b = _inner_edges(names, u, v, sample, feat)
            yield pd.DataFrame({"obs": p["obs"].to_numpy()[sample[a]], "u": feat[a], "v": feat[b], "w": w[edge], "iu": idx[a], "iv": idx[b]})

    return work


def induced(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``(obs, u, v, w, iu, iv)``: edges of which both ends are among a sample's
    nodes, with the ends' numbers; see :func:`active_subgraphs` for the plan."""
    arrays = _edge_arrays(edges)
    if arrays is None:
        a = nodes.select("obs", F.col("feat").alias("u"), F.col("idx").alias("iu"))
        b = nodes.select("obs", F.col("feat").alias("v"), F.col("idx").alias("iv"))
        return a.join(edges.select("u", "v", "w"), "u").join(b, ["obs", "v"]).select("obs", "u", "v", "w", "iu", "iv")
    kinds = dict(nodes.dtypes)
    rows = _sample_rows(nodes.select("obs", "feat", F.col("idx").alias("value")))
    return rows.mapInPandas(_induced_task(arrays), f"obs {kinds['obs']}, u {kinds['feat']}, v {kinds['feat']}, w double, iu int, iv int")


def top_absolute(long: DataFrame, cap: int, eps: float = 1e-8, policy: str = "nonzero_top_abs") -> DataFrame:
    """``(obs, feat, value, idx)``: a sample's ``cap`` features of highest absolute
    value, the smaller feature first among equals, numbered in order of the
    feature. ``all`` keeps every feature, ``top_abs`` also inactive ones."""
    if policy not in ("all", "top_abs", "nonzero_top_abs"):
        raise ValueError(f"no policy named {policy}")
    rows = long.where(finite("value")).select("obs", "feat", "value")
    if policy == "nonzero_top_abs":
        rows = active(rows, eps)
    by = Window.partitionBy("obs")
    if policy != "all":
        rows = rows.withColumn("r_", F.row_number().over(by.orderBy(F.desc(F.abs("value")), "feat"))).where(F.col("r_") <= cap)
    return rows.select("obs", "feat", "value", (F.row_number().over(by.orderBy("feat")) - 1).alias("idx"))


def require_active(long: DataFrame, eps: float = 1e-8) -> DataFrame:
    """``long`` as it is; reading it fails if some sample has no active feature."""
    some = F.max((finite("value") & (F.abs("value") > eps)).cast("int")).over(Window.partitionBy("obs"))
    bad = F.raise_error(F.concat(F.lit("no active feature in sample "), F.col("obs").cast("string"))).cast("boolean")
    return long.withColumn("some_", some).where(F.when(F.col("some_") == 0, bad).otherwise(F.lit(True))).drop("some_")


def drop_isolated(nodes: DataFrame, edges: DataFrame, forced: DataFrame | None = None) -> DataFrame:
    """A sample's nodes with an edge, and those of ``forced (feat)``, renumbered."""
    ends = endpoints(edges, "obs").select("obs", F.col("node").alias("feat")).distinct()
    kept = nodes.join(ends, ["obs", "feat"], "left_semi")
    if forced is not None:
        kept = kept.union(nodes.join(small_side(forced.select("feat").distinct()), "feat", "left_semi").select(*nodes.columns)).distinct()
    by = Window.partitionBy("obs").orderBy("feat")
    return kept.withColumn("idx", F.row_number().over(by) - 1)


def _draw(seed: int) -> Column:
    """A number in (0, 1) per sample and feature, from 52 bits of an md5."""
    bits = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("obs").cast("string"), F.col("feat").cast("string"))), 1, 13), 16, 10)
    return (bits.cast("double") + 0.5) / float(1 << 52)


def _coverage_key(seed: int) -> Column:
    """Keys of Efraimidis and Spirakis: the smallest are a weighted draw without
    replacement. The weight is ``rarity * abs(value) ** 0.25``, rarity being one
    over the root of the samples that have the feature, plus one."""
    return -F.ln(_draw(seed)) / (F.pow(F.abs("value"), F.lit(0.25)) / F.sqrt(F.col("n_") + 1))


def coverage_sample(long: DataFrame, n: int, seed: int, eps: float = 1e-8) -> DataFrame:
    """``(obs, feat, value)``: ``n`` active features of a sample drawn by
    :func:`_coverage_key`; the draws come from a hash, so they repeat."""
    live = active(long, eps).select("obs", "feat", "value")
    seen = live.groupBy("feat").agg(F.count(F.lit(1)).alias("n_"))
    rank = F.row_number().over(Window.partitionBy("obs").orderBy(_coverage_key(seed), "feat"))
    return live.join(small_side(seen), "feat").withColumn("r_", rank).where(F.col("r_") <= n).select("obs", "feat", "value")


def budgets(cap: int, n_forced: int, coverage: float = 0.0, bridge: float = 0.0, least: int = 0) -> tuple[int, int, int]:
    """``(base, coverage, bridge)``: how the nodes of a sample that are not forced
    are shared out. Shares are clipped to 0.8 each and together; the base takes
    what they leave and at least ``least``, first from the coverage, then from
    the bridges."""
    room = max(1, cap - n_forced)
    coverage, bridge = min(max(coverage, 0.0), 0.8), min(max(bridge, 0.0), 0.8)
    if coverage + bridge > 0.8:
        coverage, bridge = 0.8 * coverage / (coverage + bridge), 0.8 * bridge / (coverage + bridge)
    n_cover, n_bridge = round(room * coverage), round(room * bridge)
    base = max(room - n_cover - n_bridge, 0, min(least, room))
    over = max(base + n_cover + n_bridge - room, 0)
    cut = min(n_cover, over)
    return base, n_cover - cut, max(n_bridge - (over - cut), 0)


def select_nodes(long: DataFrame, cap: int, bridge_nodes: DataFrame | None = None, forced: Sequence = (), coverage: float = 0.0, bridge: float = 0.0, least: int = 0, seed: int = 1, policy: str = "nonzero_top_abs", eps: float = 1e-8) -> DataFrame:
    """``(obs, feat, value, part, idx)``: at most ``cap`` nodes of every sample.

    Base nodes are those of highest absolute value (the smaller feature first
    among equals), active ones only unless ``policy`` is ``top_abs`` or a sample
    has none; then ``coverage`` and ``bridge`` shares of the budget
    (:func:`budgets`) are drawn by :func:`_coverage_key` from other active
    features and taken by absolute value from active ``bridge_nodes (feat)``.
    Features ``forced`` are added whatever their value. A sample with fewer than
    ``least`` nodes is filled by absolute value with what is left; one with more
    than ``cap`` loses the weakest that are not forced. ``part`` tells where a
    node comes from. Null and NaN values are no candidates, a feature that a
    sample lacks cannot be forced.

    Every step is a rank within the sample over one shuffle by the sample.
    """
    if policy not in ("all", "top_abs", "nonzero_top_abs"):
        raise ValueError(f"no policy named {policy}")
    rows = long.where(finite("value")).select("obs", "feat", "value")
    seen = active(rows, eps).groupBy("feat").agg(F.count(F.lit(1)).alias("n_"))
    rows = rows.join(small_side(seen), "feat", "left").withColumn("n_", F.coalesce("n_", F.lit(0)))
    known = bridge_nodes is not None and bridge > 0
    if known:
        marks = bridge_nodes.select("feat", F.lit(True).alias("b_")).distinct()
        rows = rows.join(small_side(marks), "feat", "left")
    forced = list(forced)
    n_base, n_cover, n_bridge = budgets(cap, len(set(forced)), coverage, bridge, least)
    by = Window.partitionBy("obs")
    strength = (F.desc(F.abs("value")), F.col("feat").asc())
    live = F.abs("value") > eps
    some = F.max(live.cast("int")).over(by) == 1
    x = rows.withColumn("live_", live).withColumn("f_", F.col("feat").isin(forced) if forced else F.lit(False))
    # candidates: active features, or all of them
    x = x.withColumn("c_", F.lit(True) if policy != "nonzero_top_abs" else F.col("live_") | ~some)
    if policy == "all":
        x = x.withColumn("part", F.when(F.row_number().over(by.orderBy(*strength)) <= cap, "base").when(F.col("f_"), "forced"))
    else:
        free = ~F.col("f_") & F.col("c_")
        x = x.withColumn("part", F.when(F.col("c_") & (F.row_number().over(by.orderBy(F.desc("c_"), *strength)) <= n_base), "base"))
        open_ = F.col("part").isNull() & free & F.col("live_")
        x = x.withColumn("k_", F.when(open_, _coverage_key(seed)))
        x = x.withColumn("part", F.coalesce("part", F.when(F.col("k_").isNotNull() & (F.row_number().over(by.orderBy(F.asc_nulls_last("k_"), "feat")) <= n_cover), "coverage")))
        if known:
            x = x.withColumn("o_", F.col("part").isNull() & free & F.col("live_") & F.coalesce("b_", F.lit(False)))
            x = x.withColumn("part", F.coalesce("part", F.when(F.col("o_") & (F.row_number().over(by.orderBy(F.desc("o_"), *strength)) <= n_bridge), "bridge")))
        x = x.withColumn("part", F.coalesce("part", F.when(F.col("f_"), "forced")))
        want = F.lit(max(least, len(set(forced))))
        gone = F.when(F.col("part").isNull(), 1).otherwise(0)
        x = x.withColumn("have_", F.count("part").over(by)).withColumn("g_", gone)
        x = x.withColumn("part", F.coalesce("part", F.when(F.row_number().over(by.orderBy(F.desc("g_"), *strength)) <= want - F.col("have_"), "fill")))
        kept = x.where("part is not null")
        # forced ones stay, the weakest others go
        x = kept.withColumn("r_", F.row_number().over(by.orderBy(F.desc("f_"), *strength))).where((F.col("r_") <= cap) | F.col("f_"))
    x = x.where("part is not null")
    return x.select("obs", "feat", "value", "part", (F.row_number().over(by.orderBy("feat")) - 1).alias("idx"))


def seed_fallback(long: DataFrame, edges: DataFrame, n: int) -> DataFrame:
    """``(obs, feat)``: a sample's ``n`` features of highest absolute value and
    the ends of its strongest edge (smaller ends first among equals)."""
    rows = long.where(finite("value")).select("obs", "feat", "value")
    rank = F.row_number().over(Window.partitionBy("obs").orderBy(F.desc(F.abs("value")), "feat"))
    top = rows.withColumn("r_", rank).where(F.col("r_") <= n).select("obs", "feat")
    here = rows.select("obs", "feat")
    inner = here.withColumnRenamed("feat", "u").join(small_side(edges.select("u", "v", "w")), "u").join(here.withColumnRenamed("feat", "v"), ["obs", "v"])
    best = inner.groupBy("obs").agg(F.max(F.struct("w", (-F.col("u")).alias("nu"), (-F.col("v")).alias("nv"))).alias("b"))
    return top.union(best.select("obs", F.explode(F.array(-F.col("b.nu"), -F.col("b.nv"))).alias("feat"))).distinct()


def as_rows(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row per sample: ``(obs, x, edges)`` with arrays of structs in order."""
    x = nodes.groupBy("obs").agg(F.array_sort(F.collect_list(F.struct("idx", "feat", "value"))).alias("x"))
    e = edges.groupBy("obs").agg(F.array_sort(F.collect_list(F.struct("iu", "iv", "w"))).alias("edges"))
    return x.join(e, "obs", "left").select("obs", "x", F.coalesce("edges", F.array()).alias("edges"))


def size_summary(nodes: DataFrame) -> DataFrame:
    """One row over all samples: number and spread of the graph sizes."""
    n = nodes.groupBy("obs").agg(F.count(F.lit(1)).alias("n"))
    return n.agg(
        F.count(F.lit(1)).alias("graphs"),
        F.min("n").alias("min"),
        F.percentile("n", 0.5).alias("median"),
        F.avg("n").alias("mean"),
        F.percentile("n", 0.9).alias("p90"),
        F.percentile("n", 0.95).alias("p95"),
        F.max("n").alias("max"),
    )
