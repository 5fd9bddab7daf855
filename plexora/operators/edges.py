"""Undirected edge tables: canonical form, fusion of sources, pruning, completion."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plexora.functions.scalar import edge_class, finite, pearson
from plexora.operators.running import running
from plexora.session import materialize, small_side

#: The fixed form of a fused edge table.
EDGE_SCHEMA = T.StructType(
    [
        T.StructField("src_expanded_idx", T.LongType()),
        T.StructField("dst_expanded_idx", T.LongType()),
        T.StructField("src", T.StringType()),
        T.StructField("dst", T.StringType()),
        T.StructField("edge_weight", T.FloatType()),
        T.StructField("edge_source", T.StringType()),
        T.StructField("edge_type", T.StringType()),
    ]
)


def _usable(u: str, v: str, w: str) -> Column:
    return (F.col(u) >= 0) & (F.col(v) >= 0) & (F.col(u) != F.col(v)) & F.col(w).isNotNull() & ~F.isnan(F.col(w).cast("double"))


def canonical(edges: DataFrame, u: str, v: str, w: str) -> DataFrame:
    """``(u, v, w)`` with u < v: one row per unordered pair with its highest
    weight. Self-loops, null or negative ends and null or NaN weights are left
    out; applying it again changes nothing."""
    a, b = F.col(u).cast("long"), F.col(v).cast("long")
    return (
        edges.where(_usable(u, v, w))
        .select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v"), F.col(w).alias("w"))
        .groupBy("u", "v")
        .agg(F.max("w").alias("w"))
    )


def canonical_best(edges: DataFrame, u: str, v: str, w: str, keep: Sequence[str]) -> DataFrame:
    """:func:`canonical` with the attributes ``keep`` of the strongest row; among
    rows of equal weight those that sort last."""
    a, b = F.col(u).cast("long"), F.col(v).cast("long")
    best = F.max(F.struct(F.col(w).alias("w"), *keep)).alias("best")
    return edges.where(_usable(u, v, w)).groupBy(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).agg(best).select("u", "v", "best.*")


def fuse(edges: DataFrame, u: str, v: str, w: str, source: str, kind: str) -> DataFrame:
    """Two-level fusion: the highest weight of a pair within a source and type,
    then the sum over them. ``source`` and ``kind`` are the alphabetically first,
    ``n_sources`` the number of distinct sources."""
    a, b = F.col(u).cast("long"), F.col(v).cast("long")
    per = (
        edges.where(_usable(u, v, w))
        .groupBy(F.least(a, b).alias("u"), F.greatest(a, b).alias("v"), F.col(source).alias("source"), F.col(kind).alias("kind"))
        .agg(F.max(F.col(w).cast("double")).alias("w"))
    )
    return per.groupBy("u", "v").agg(F.sum("w").alias("w"), F.min("source").alias("source"), F.min("kind").alias("kind"), F.count_distinct("source").alias("n_sources"))


def support(edges: DataFrame, u: str, v: str, observation: str | None = None) -> DataFrame:
    """``(u, v, n)``: rows, or distinct observations, in which a pair occurs."""
    a, b = F.col(u).cast("long"), F.col(v).cast("long")
    n = F.count(F.lit(1)) if observation is None else F.count_distinct(observation)
    return edges.where((a >= 0) & (b >= 0) & (a != b)).groupBy(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).agg(n.alias("n"))


def endpoints(edges: DataFrame, *columns: str) -> DataFrame:
    """Each edge ``(u, v)`` once for either end: ``(node, other, *columns)``."""
    both = F.explode(F.array(F.struct(F.col("u").alias("node"), F.col("v").alias("other")), F.struct(F.col("v").alias("node"), F.col("u").alias("other"))))
    return edges.select(*columns, both.alias("e")).select("e.node", "e.other", *columns)


def weighted_degree(edges: DataFrame) -> DataFrame:
    """``(node, degree, strength)`` of edges ``(u, v, w)``; both ends count."""
    return endpoints(edges, "w").groupBy("node").agg(F.count(F.lit(1)).alias("degree"), F.sum(F.col("w").cast("double")).alias("strength"))


def directed_top(edges: DataFrame, k: int, source: str = "u", weight: str = "w", tie: str = "v") -> DataFrame:
    """The ``k`` strongest edges of every source, the smaller target first among
    equals. The rank limit is applied on the map side before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(source).orderBy(F.desc(weight), tie))
    return edges.withColumn("rank_", rank).where(F.col("rank_") <= k).drop("rank_")


def undirected_top(edges: DataFrame, k: int) -> DataFrame:
    """Edges ``(u, v, w)`` among the ``k`` strongest of either end, one copy each."""
    sides = endpoints(edges, "w")
    rank = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("w"), "other"))
    kept = sides.withColumn("r_", rank).where(F.col("r_") <= k)
    return kept.select(F.least("node", "other").alias("u"), F.greatest("node", "other").alias("v"), "w").distinct()


def global_top(edges: DataFrame, cap: int) -> DataFrame:
    """The ``cap`` strongest edges, smaller ends first among equals."""
    from plexora.operators.stats import first_rows

    return first_rows(edges, "w", ("u", "v"), cap)


def top_fraction(edges: DataFrame, fraction: float, weight: str = "w") -> DataFrame:
    """The strongest ``max(1, ceil(rows * fraction))`` edges; none of none."""
    if not 0 < fraction <= 1:
        raise ValueError("a fraction in (0, 1]")
    from plexora.operators.stats import first_rows

    n = edges.count()
    return first_rows(edges, weight, ("u", "v"), max(1, -int(-n * fraction // 1)) if n else 0)


def expand_vocabulary(old: DataFrame, names: DataFrame, name: str = "name", index: str = "idx") -> DataFrame:
    """``(name, idx, old_or_new)``: the old vocabulary with its indexes, unseen
    names appended in alphabetical order. Fails unless old indexes are 0..n-1."""
    check = old.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max(index) + 1, F.lit(0)).alias("m"), F.count_distinct(index).alias("d")).first()
    if not check["n"] == check["m"] == check["d"]:
        raise ValueError("the old vocabulary is not numbered 0..n-1")
    fresh = names.select(F.col(name).alias("name")).where("name is not null").distinct().join(old.select(F.col(name).alias("name")), "name", "left_anti")
    numbered = running(fresh.withColumn("one_", F.lit(1).cast("long")), [], ["name"], {"r_": (F.sum, "one_")}).select("name", (F.col("r_") + check["n"]).cast("long").alias("idx"), F.lit("new").alias("old_or_new"))
    return old.select(F.col(name).alias("name"), F.col(index).cast("long").alias("idx"), F.lit("old").alias("old_or_new")).union(numbered)


def mapped(edges: DataFrame, mapping: DataFrame, old: str = "old", new: str = "new") -> DataFrame:
    """Edges ``(u, v, ...)`` with both ends renamed by ``mapping``; an edge with an
    unknown end is dropped. A small mapping is broadcast after a count."""
    m = small_side(mapping.select(F.col(old).alias("o_"), F.col(new).alias("n_")).distinct())
    one = edges.join(m, F.col("u") == F.col("o_")).withColumn("u", F.col("n_")).drop("o_", "n_")
    return one.join(m, F.col("v") == F.col("o_")).withColumn("v", F.col("n_")).drop("o_", "n_")


def index_space(edges: DataFrame, listed: DataFrame, n_local: int, share: float = 0.99) -> DataFrame:
    """One row ``(space, share_listed, max_idx)``: ``mat`` if more than ``share``
    of all ends are listed indexes, else ``local`` if all are below ``n_local``,
    else ``unknown``. All rows count, none is sampled."""
    ends = endpoints(edges).select("node")
    known = small_side(listed.select(F.col(listed.columns[0]).alias("node"), F.lit(1).alias("hit_")).distinct())
    got = ends.join(known, "node", "left").agg(F.avg(F.coalesce("hit_", F.lit(0)).cast("double")).alias("share_listed"), F.max("node").alias("max_idx"))
    space = F.when(F.col("share_listed") > share, "mat").when(F.col("max_idx") < n_local, "local").otherwise("unknown")
    return got.select(space.alias("space"), "share_listed", "max_idx")


def typed_edges(edges: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Edges ``(u, v, ...)`` with ``edge_type`` by the vocabulary's
    ``(idx, old_or_new)``; unknown ends drop the edge."""
    tag = small_side(vocabulary.select("idx", (F.col("old_or_new") == "new").alias("new_")).distinct())
    a = edges.join(tag.withColumnsRenamed({"idx": "u", "new_": "nu_"}), "u")
    b = a.join(tag.withColumnsRenamed({"idx": "v", "new_": "nv_"}), "v")
    return b.withColumn("edge_type", edge_class(F.col("nu_"), F.col("nv_"))).drop("nu_", "nv_")


def bridge_edges(edges: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Edges between an old and a new feature."""
    return typed_edges(edges, vocabulary).where("edge_type = 'old-new'")


def forced_pairs(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """``(u, v, w)`` of wanted pairs ``(u, v)`` in either orientation, with the
    highest weight found; null where the edges lack the pair."""
    want = pairs.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    have = edges.join(small_side(want), ["u", "v"], "left_semi")
    return want.join(have.groupBy("u", "v").agg(F.max("w").alias("w")), ["u", "v"], "left")


def canonical_table(edges: DataFrame) -> DataFrame:
    """The fixed seven columns with the smaller index first, names exchanged
    along with it; a NaN weight is null. A missing column is an error, columns
    beside the seven are dropped. Null indexes and self-loops give no row."""
    missing = set(EDGE_SCHEMA.names) - set(edges.columns)
    if missing:
        raise ValueError(f"missing columns: {sorted(missing)}")
    swap = F.col("src_expanded_idx") > F.col("dst_expanded_idx")
    picked = {
        "src_expanded_idx": F.least("src_expanded_idx", "dst_expanded_idx"),
        "dst_expanded_idx": F.greatest("src_expanded_idx", "dst_expanded_idx"),
        "src": F.when(swap, F.col("dst")).otherwise(F.col("src")),
        "dst": F.when(swap, F.col("src")).otherwise(F.col("dst")),
        "edge_weight": F.when(~F.isnan(F.col("edge_weight").cast("double")), F.col("edge_weight")),
        "edge_source": F.col("edge_source"),
        "edge_type": F.col("edge_type"),
    }
    rows = edges.where("src_expanded_idx is not null and dst_expanded_idx is not null and src_expanded_idx <> dst_expanded_idx")
    return rows.select(*(picked[f.name].cast(f.dataType).alias(f.name) for f in EDGE_SCHEMA))


def build_edges(raw: DataFrame, mapping: DataFrame, threshold: float | None, q: float | None, k: int, cap: int, scale: float, forced: DataFrame | None = None) -> DataFrame:
    """The edge build as one plan: filter, rename ends, canonical form, top
    ``k`` of either end, the ``cap`` strongest, scale, then forced pairs by their
    highest unfiltered weight (scaled as well) joined in."""
    from plexora.operators.stats import quantile_filter

    kept = canonical(mapped(quantile_filter(raw, "w", threshold, q), mapping), "u", "v", "w")
    if k > 0:
        kept = undirected_top(kept, k)
    if cap > 0:
        kept = global_top(kept, cap)
    out = kept.withColumn("w", F.col("w") * scale)
    if forced is not None:
        extra = forced_pairs(canonical(mapped(raw, mapping), "u", "v", "w"), forced).where("w is not null")
        out = out.unionByName(extra.withColumn("w", F.col("w") * scale)).groupBy("u", "v").agg(F.max("w").alias("w"))
    return out


def prior_edges(edges: DataFrame, thresholds: Sequence[float | None] = (), q: float = 0.995, scale: float = 0.30) -> DataFrame:
    """Old edges at or above the strongest threshold, weakened by ``scale``."""
    from plexora.operators.stats import strongest_of

    return strongest_of(edges, "w", thresholds, q).withColumn("w", F.col("w") * scale)


def knn_completion(long: DataFrame, vocabulary: DataFrame, edges: DataFrame, k: int = 5, least: float = 0.15, scale: float = 0.25) -> DataFrame:
    """``(u, v, w)`` for new features without an old neighbour: the ``k`` old
    features of highest absolute correlation, of which those at or above
    ``least`` are linked with ``scale`` times it.

    ``long`` is ``(obs, feat, value)`` over vocabulary indexes. Only the lonely
    features meet the old ones, over shared observations.
    """
    tag = vocabulary.select(F.col("idx").alias("feat"), "old_or_new")
    touched = bridge_edges(edges, vocabulary)
    linked = endpoints(touched).select(F.col("node").alias("feat")).distinct()
    lonely = tag.where("old_or_new = 'new'").join(linked, "feat", "left_anti").select("feat")
    z = long.where(finite("value"))
    a = z.join(small_side(lonely), "feat").select("obs", F.col("feat").alias("new_"), F.col("value").alias("x"))
    b = z.join(small_side(tag.where("old_or_new = 'old'").select("feat")), "feat").select("obs", F.col("feat").alias("old_"), F.col("value").alias("y"))
    r = a.join(b, "obs").groupBy("new_", "old_").agg(pearson("x", "y").alias("r"), F.stddev_pop("x").alias("sx"), F.stddev_pop("y").alias("sy"))
    c = r.where("sx > 1e-12 and sy > 1e-12").select("new_", "old_", F.abs("r").alias("c"))
    rank = F.row_number().over(Window.partitionBy("new_").orderBy(F.desc("c"), "old_"))
    near = c.withColumn("r_", rank).where((F.col("r_") <= k) & (F.col("c") >= least))
    return near.select(F.least("new_", "old_").alias("u"), F.greatest("new_", "old_").alias("v"), (F.col("c") * scale).alias("w"))


def centrality(edges: DataFrame, vectors: DataFrame, graph: str = "g", base: float = 0.03) -> tuple[DataFrame, DataFrame]:
    """``(kept edges, nodes)`` of every graph.

    Edges ``(g, u, v)`` get the absolute inner product of the ends' vectors
    ``(g, node, vec)`` and stay if it exceeds ``base * (1 + 2 density)``, or the
    graph's median where that exceeds the graph's maximum. A node's centrality
    is the sum over its kept edges, 0 without any. The order in which the
    original works through an edge list has no part here.
    """
    from plexora.functions.scalar import dot
    from plexora.operators.stats import quantiles

    n = vectors.groupBy(graph).agg(F.count(F.lit(1)).alias("n"))
    a = vectors.select(graph, F.col("node").alias("u"), F.col("vec").alias("hu"))
    b = vectors.select(graph, F.col("node").alias("v"), F.col("vec").alias("hv"))
    sim = edges.select(graph, "u", "v").join(a, [graph, "u"]).join(b, [graph, "v"]).select(graph, "u", "v", F.abs(dot("hu", "hv")).alias("sim"))
    sim = materialize(sim, "similarities")
    mid = quantiles(sim, "sim", [0.5], [graph]).select(graph, F.get("q", F.lit(0)).alias("mid"))
    per = sim.groupBy(graph).agg(F.count(F.lit(1)).alias("e"), F.max("sim").alias("top")).join(n, graph).join(mid, graph, "left")
    pairs = F.greatest(F.floor(F.col("n") * (F.col("n") - 1) / 2), F.lit(1))
    cut = F.lit(base) * (1 + 2 * F.col("e") / pairs)
    per = per.select(graph, F.when(cut > F.col("top"), F.col("mid")).otherwise(cut).alias("cut"))
    kept = sim.join(small_side(per), graph).where(F.col("sim") > F.col("cut")).select(graph, "u", "v", "sim")
    mass = endpoints(kept, graph, "sim").groupBy(graph, "node").agg(F.sum("sim").alias("c"))
    return kept, vectors.select(graph, "node").join(mass, [graph, "node"], "left").select(graph, "node", F.coalesce("c", F.lit(0.0)).alias("centrality"))


def k_hop(edges: DataFrame, seeds: DataFrame, hops: int) -> DataFrame:
    """``(seed, node)``: nodes from which a seed is reached over at most ``hops``
    directed edges ``u -> v``, the seed itself included. One join a hop, over
    the new nodes of the hop before."""
    reached = seeds.select(F.col("node").alias("seed"), "node").distinct()
    edge = edges.select(F.col("u").alias("from_"), F.col("v").alias("node")).distinct()
    front = reached
    for _ in range(hops):
        front = front.join(edge, "node").select("seed", F.col("from_").alias("node")).distinct().join(reached, ["seed", "node"], "left_anti")
        reached = reached.union(front)
    return reached


def fd_histogram(df: DataFrame, value: str, group: str, most: int = 1000) -> DataFrame:
    """``(group, bin, lower, upper, n)``: equal bins by the rule of Freedman and
    Diaconis with linear quartiles; one bin where all values are equal. The last
    bin is closed above; empty bins have ``n`` 0."""
    from plexora.operators.stats import quantiles

    per = df.where(finite(value)).groupBy(group).agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.count(F.lit(1)).alias("n_"))
    per = per.join(quantiles(df, value, [0.25, 0.75], [group]), group)
    iqr = F.get("q", F.lit(1)) - F.get("q", F.lit(0))
    span = F.col("hi") - F.col("lo")
    width = F.when(iqr > 0, 2 * iqr / F.pow("n_", F.lit(1 / 3))).otherwise(span)
    bins = F.when(width > 0, F.greatest(F.lit(1), F.least(F.lit(most), F.floor(span / width)))).otherwise(F.lit(1)).cast("int")
    per = per.select(group, F.col("lo").cast("double").alias("lo"), F.col("hi").cast("double").alias("hi"), bins.alias("k"))
    place = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col(value) - F.col("lo")) * F.col("k") / (F.col("hi") - F.col("lo"))), F.col("k") - 1)).otherwise(F.lit(0))
    got = df.where(finite(value)).join(small_side(per), group).groupBy(group, place.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    grid = per.select(group, "lo", "hi", "k", F.explode(F.sequence(F.lit(0), F.col("k") - 1)).alias("bin"))
    step = (F.col("hi") - F.col("lo")) / F.col("k")
    return grid.join(got, [group, "bin"], "left").select(
        group, "bin", (F.col("lo") + F.col("bin") * step).alias("lower"), (F.col("lo") + (F.col("bin") + 1) * step).alias("upper"), F.coalesce("n", F.lit(0)).alias("n")
    )


def super_edges(members: DataFrame, edges: DataFrame, group: str = "g", nodes: str = "super_node") -> DataFrame:
    """Edges in both directions, and a clique over each graph's super nodes."""
    both = edges.select(group, "u", "v").union(edges.select(group, F.col("v"), F.col("u")))
    a, b = members.select(group, F.col(nodes).alias("u")), members.select(group, F.col(nodes).alias("v"))
    return both.union(a.join(b, group).where("u <> v").select(group, "u", "v")).distinct()
