"""Embedding networks, their changes, modules and hubs."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plexora.functions.scalar import cosine, delta_sign, norm
from plexora.operators.edges import endpoints
from plexora.operators.pairwise import nearest_rows
from plexora.operators.stats import quantiles
from plexora.session import materialize, small_side


def mean_vectors(rows: DataFrame, key: str, vec: str) -> DataFrame:
    """``(key, vec, n)``: the element-wise mean and the number of a key's vectors.
    The sums combine on the map side, element by element; null vectors and
    elements are left out. Vectors of other lengths meet by position."""
    n = rows.where(F.col(vec).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    per = rows.select(key, F.posexplode(vec).alias("pos", "x")).groupBy(key, "pos").agg(F.avg(F.col("x").cast("double")).alias("m"))
    vecs = per.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda r: r["m"]).alias("vec"))
    return vecs.join(n, key).select(key, "vec", "n")


def cosine_edges(edges: DataFrame, vectors: DataFrame, node: str = "node") -> DataFrame:
    """``(u, v, w)``: the cosine of the ends' vectors on observed edges; 0 where a
    norm vanishes. Edges with an end that has no vector are dropped."""
    a = small_side(vectors.select(F.col(node).alias("u"), F.col("vec").alias("a_")))
    b = small_side(vectors.select(F.col(node).alias("v"), F.col("vec").alias("b_")))
    return edges.select("u", "v").distinct().join(a, "u").join(b, "v").select("u", "v", cosine("a_", "b_").alias("w"))


def delta_network(before: DataFrame, after: DataFrame) -> DataFrame:
    """``(u, v, w_pre, w_ft, delta_w, abs_delta_w, delta_sign)`` of common edges,
    the change rounded to 8 places, strongest change first."""
    d = F.round(F.col("w_ft") - F.col("w_pre"), 8)
    both = before.select("u", "v", F.col("w").alias("w_pre")).join(after.select("u", "v", F.col("w").alias("w_ft")), ["u", "v"])
    out = both.withColumn("delta_w", d).withColumn("abs_delta_w", F.abs("delta_w")).withColumn("delta_sign", delta_sign("delta_w"))
    return out.orderBy(F.desc("abs_delta_w"), "u", "v")


def delta_summary(delta: DataFrame) -> DataFrame:
    """One row of edge counts, mean, population deviation, median and signs."""
    delta = materialize(delta.select("delta_w"), "delta")
    one = delta.agg(
        F.count(F.lit(1)).alias("n_edges"),
        F.avg("delta_w").alias("mean"),
        F.stddev_pop("delta_w").alias("std"),
        F.avg((F.col("delta_w") > 0).cast("double")).alias("positive_fraction"),
        F.avg((F.col("delta_w") < 0).cast("double")).alias("negative_fraction"),
    )
    mid = quantiles(delta, "delta_w", [0.5]).select(F.get("q", F.lit(0)).alias("median"))
    return one.join(F.broadcast(mid), how="left").select("n_edges", "mean", "std", "median", "positive_fraction", "negative_fraction")


def gene_table(before: DataFrame, after: DataFrame, names: DataFrame) -> DataFrame:
    """``(gene_id, gene_name, node_type, count_pre, count_ft, embedding_norm_pre,
    embedding_norm_ft, embedding_norm_delta)`` of genes with vectors in both."""
    a = before.select("node", F.col("n").alias("count_pre"), F.col("vec").alias("a_"))
    b = after.select("node", F.col("n").alias("count_ft"), F.col("vec").alias("b_"))
    diff = norm(F.zip_with("b_", "a_", lambda y, x: y - x))
    return (
        a.join(b, "node")
        .join(small_side(names.select(F.col("idx").alias("node"), F.col("name").alias("gene_name"), F.col("old_or_new").alias("node_type"))), "node", "left")
        .select(F.col("node").alias("gene_id"), "gene_name", "node_type", "count_pre", "count_ft", norm("a_").alias("embedding_norm_pre"), norm("b_").alias("embedding_norm_ft"), diff.alias("embedding_norm_delta"))
    )


def load_edges(df: DataFrame) -> DataFrame:
    """A trait network made fit for modules: required ends and weight, absent
    delta and type columns filled, self-loops, null weights and edges without
    strength dropped. ``strength`` is the absolute weight."""
    missing = {"u", "v", "w"} - set(df.columns)
    if missing:
        raise ValueError(f"missing columns: {sorted(missing)}")
    for c, kind in (("delta_w", "double"), ("type_u", "string"), ("type_v", "string")):
        fill = F.lit(0.0) if kind == "double" else F.lit("unknown")
        df = df.withColumn(c, F.coalesce(F.col(c).cast(kind), fill) if c in df.columns else fill)
    ok = df.where("u <> v and w is not null and not isnan(w)").withColumn("strength", F.abs("w"))
    return ok.where("strength > 0")


def normalized_modules(modules: DataFrame, least: int) -> DataFrame:
    """``(node, module_id)``: modules below ``least`` nodes joined to the largest,
    named M01, M02... by size; one M01 where none is large enough. Sizes are
    counted per module; only the table of modules is ranked."""
    size = modules.groupBy("module").agg(F.count(F.lit(1)).alias("n"))
    rank = F.row_number().over(Window.orderBy(F.desc("n"), "module"))
    ranked = size.withColumn("r", rank).withColumn("keep", F.col("n") >= least)
    # the joined rows go to the largest, which stays first
    place = F.when(F.col("keep"), F.col("r")).otherwise(F.lit(1))
    named = ranked.select("module", F.format_string("M%02d", place).alias("module_id"))
    return modules.join(small_side(named), "module").select("node", "module_id")


def module_edges(edges: DataFrame, modules: DataFrame) -> DataFrame:
    """Edges with both ends in one module, with ``module_id``."""
    m = small_side(modules)
    a = edges.join(m.withColumnsRenamed({"node": "u", "module_id": "mu_"}), "u")
    b = a.join(m.withColumnsRenamed({"node": "v", "module_id": "mv_"}), "v")
    return b.where("mu_ = mv_").withColumnRenamed("mu_", "module_id").drop("mv_")


def hubs(edges: DataFrame, modules: DataFrame, fraction: float = 0.1, least: int = 1, most: int = 100_000) -> DataFrame:
    """``(module_id, node, strength, degree, rank, is_hub)`` by strength, then
    degree inside the module, the smaller node first among equals. Hubs are the
    first ``clip(ceil(n * fraction), least, most, n)``. Nodes without an inner
    edge rank last with 0."""
    inner = endpoints(module_edges(edges, modules), "module_id", "w").groupBy("module_id", "node").agg(F.sum(F.abs("w")).alias("strength"), F.count(F.lit(1)).alias("degree"))
    every = modules.join(inner, ["module_id", "node"], "left").select("module_id", "node", F.coalesce("strength", F.lit(0.0)).alias("strength"), F.coalesce("degree", F.lit(0)).alias("degree"))
    rank = F.row_number().over(Window.partitionBy("module_id").orderBy(F.desc("strength"), F.desc("degree"), "node"))
    n = modules.groupBy("module_id").agg(F.count(F.lit(1)).alias("n"))
    count = F.least(F.greatest(F.ceil(F.col("n") * F.lit(fraction)), F.lit(least)), F.lit(most), F.col("n"))
    return every.withColumn("rank", rank).join(small_side(n), "module_id").withColumn("is_hub", F.col("rank") <= count).drop("n")


def module_summary(edges: DataFrame, modules: DataFrame, types: DataFrame, ranked: DataFrame, top: int = 10) -> DataFrame:
    """One row per module: nodes, inner edges, density, weights, changes, old, new
    and unknown nodes and the names of its first ``top`` hubs."""
    inner = materialize(module_edges(edges, modules), "inner")
    mid = quantiles(inner.withColumn("a_", F.abs("w")), "a_", [0.5], ["module_id"]).select("module_id", F.get("q", F.lit(0)).alias("median_abs_w"))
    e = inner.groupBy("module_id").agg(
        F.count(F.lit(1)).alias("n_edges"),
        F.avg(F.abs("w")).alias("mean_abs_w"),
        F.avg("w").alias("mean_w"),
        F.avg("delta_w").alias("mean_delta"),
        F.avg((F.col("delta_w") > 0).cast("double")).alias("positive_fraction"),
    )
    t = F.coalesce("old_or_new", F.lit("unknown"))
    n = (
        modules.join(small_side(types.select(F.col("idx").alias("node"), "old_or_new")), "node", "left")
        .groupBy("module_id")
        .agg(F.count(F.lit(1)).alias("n_nodes"), F.count_if(t == "old").alias("n_old"), F.count_if(t == "new").alias("n_new"), F.count_if(~t.isin("old", "new")).alias("n_unknown"))
    )
    h = ranked.where(F.col("rank") <= top).groupBy("module_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "node"))), lambda r: r["node"].cast("string")), ";").alias("top_hubs"))
    pairs = F.col("n_nodes") * (F.col("n_nodes") - 1) / 2
    out = n.join(e, "module_id", "left").join(mid, "module_id", "left").join(h, "module_id", "left").withColumn("n_edges", F.coalesce("n_edges", F.lit(0)))
    return out.withColumn("density", F.when(pairs > 0, F.col("n_edges") / pairs).otherwise(F.lit(0.0)))


def summary_rows(summary: DataFrame) -> DataFrame:
    """``(metric, value)`` texts over a module summary."""
    one = summary.agg(F.count(F.lit(1)).alias("n_modules"), F.sum("n_nodes").alias("n_nodes"), F.sum("n_edges").alias("n_edges"), F.max("n_nodes").alias("largest"), F.min("n_nodes").alias("smallest"))
    rows = F.array(*(F.struct(F.lit(c).alias("metric"), F.col(c).cast("string").alias("value")) for c in one.columns))
    return one.select(F.explode(rows).alias("r")).select("r.*")


def node_types(edges: DataFrame, order: str) -> DataFrame:
    """``(node, type)``: the type of an end where it is first seen by ``order``."""
    sides = edges.select(order, F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("u").alias("node"), F.col("type_u").alias("type")), F.struct(F.lit(1).alias("side"), F.col("v").alias("node"), F.col("type_v").alias("type")))).alias("e"))
    return sides.groupBy(F.col("e.node").alias("node")).agg(F.min_by("e.type", F.struct(order, "e.side", "e.type")).alias("type"))


def initial_vectors(new: DataFrame, edges: DataFrame, old_vectors: DataFrame) -> DataFrame:
    """``(node, vec)`` for new nodes: the mean of their old neighbours' vectors
    weighted by the edge (over the sum of absolute weights), or the mean of all
    old vectors without one. The random part of the original is left out."""
    old = old_vectors.select("node", "vec")
    sides = endpoints(edges, "w").join(small_side(new.select("node")), "node").join(old.select(F.col("node").alias("other"), "vec"), "other")
    per = sides.select("node", "w", F.posexplode("vec").alias("pos", "x")).groupBy("node", "pos").agg(F.try_divide(F.sum(F.col("w") * F.col("x")), F.sum(F.abs("w"))).alias("m"))
    near = per.groupBy("node").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda r: r["m"]).alias("near"))
    every = old.select(F.posexplode("vec").alias("pos", "x")).groupBy("pos").agg(F.avg("x").alias("m")).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "m"))), lambda r: r["m"]).alias("all_"))
    return new.select("node").distinct().join(near, "node", "left").join(F.broadcast(every)).select("node", F.coalesce("near", "all_").alias("vec"))


def with_isolated(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``(node, degree)`` of all given nodes and all ends, 0 without an edge."""
    ends = endpoints(edges).groupBy("node").agg(F.count(F.lit(1)).alias("degree"))
    every = nodes.select("node").union(ends.select("node")).distinct()
    return every.join(ends, "node", "left").select("node", F.coalesce("degree", F.lit(0)).alias("degree"))


def knn_graph(points: DataFrame, k: int) -> DataFrame:
    """``(u, v, w)``: each row ``(node, vec)`` linked with its ``k`` nearest by
    Euclidean distance (the smaller node first among equals), made symmetric:
    the weight 1 or 2 counts the directions. Exact, block by block."""
    near = nearest_rows(points, k)
    return near.groupBy(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).agg(F.count(F.lit(1)).alias("w"))
