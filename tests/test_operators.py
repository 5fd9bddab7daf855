"""Hand-computed cases and properties of the core operators."""

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from plexora.functions import scalar as S
from plexora.operators import edges as E
from plexora.operators import greedy, intervals, metrics, model, network, nmic, reshape, samples, sampling, stats
from plexora.operators.components import min_labels
from plexora.operators.running import running
from plexora.operators.communities import LOCAL_EDGES, communities, louvain, modularity
from plexora.operators.batch_mixing import chi2_tail, neighbourhood_chi2
from plexora.operators.windows import ratio_windows, windows

NAN = float("nan")


def rows(df, *cols):
    return sorted((tuple(r[c] for c in (cols or df.columns)) for r in df.collect()), key=repr)


# ------------------------------------------------------------------ windows


def test_windows_micro():
    w = ratio_windows(20)
    assert len(w) == 91 and w[0] == (0, 7) and w[-1] == (0, 19)
    assert ratio_windows(20, 0.33, 0.5, 0.15, 0.15) == [(0, 7), (3, 10), (6, 13), (9, 16), (12, 19), (0, 10), (3, 13), (6, 16), (9, 19)]


@given(st.integers(11, 200), st.floats(0.05, 0.5), st.floats(0.51, 0.98), st.floats(0.06, 0.4), st.floats(0.06, 0.4))
@settings(max_examples=100, deadline=None)
def test_windows_never_reach_the_last_value(n, lo, hi, grow, slide):
    try:
        w = ratio_windows(n, lo, hi, grow, slide)
    except ValueError:
        return
    assert all(0 <= s < e <= n - 1 for s, e in w)


@pytest.mark.parametrize("bad", [(10, 1, 5, 1, 1), (10, 6, 5, 1, 1), (10, 2, 11, 1, 1), (10, 2, 5, 0, 1), (10, 2, 5, 1, 0)])
def test_windows_refuse(bad):
    with pytest.raises(ValueError):
        windows(*bad)


# --------------------------------------------------------------------- nmic


def test_bins_micro():
    x = np.arange(1.0, 13)
    ids, k = nmic.bin_ids(x, x)
    assert k == 5 and ids.min() == 0
    assert nmic.bin_ids(np.ones(12), np.ones(12)) is None


def full(x, y):
    order = np.argsort(x, kind="stable")
    terms = nmic._entropy_terms(len(x))
    return nmic.nmic(np.array(y, float), order, nmic._first_parts(np.array(x, float), order, [], terms), [], terms)


def test_information_micro():
    x = np.arange(1.0, 13)
    y = np.array([2, 1, 4, 3, 6, 5, 8, 7, 10, 9, 12, 11], float)
    assert round(full(x, y), 6) == 0.646015
    assert full(x, np.ones(12)) == 0.0
    # adding a constant or reordering rows changes nothing
    assert math.isclose(full(x + 5, y), full(x, y))
    p = np.random.RandomState(1).permutation(12)
    assert math.isclose(full(x[p], y[p]), full(x, y))


def test_all_pairs_blocks_agree(spark):
    rng = np.random.RandomState(3)
    m = rng.randn(40, 7)
    m[:, 6] = m[:, 0] * 2 + 1
    long = spark.createDataFrame([(i, j, float(m[i, j])) for i in range(40) for j in range(7)], "obs long, feat int, value double")
    spans = ratio_windows(40)
    one, many = nmic.all_pairs(long, spans), nmic.all_pairs(long, spans, block=2)
    a, b = rows(one), rows(many)
    assert len(a) == 21 and a == b
    kept, pairs = nmic.without_redundant(long, [], 0.99)
    assert rows(pairs) == [(0, 6)] and {r["feat"] for r in kept.select("feat").distinct().collect()} == {1, 2, 3, 4, 5, 6}


def test_undefined_window_is_dissimilar():
    x = np.array([1.0, 1, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10])
    order = np.argsort(x, kind="stable")
    assert nmic.similar(x, x, order, [(3, 8)], 0.9)
    assert not nmic.similar(x, x, order, [(0, 3), (3, 8)], 0.9)


def test_threshold_compat(spark):
    e = spark.createDataFrame([(1, 2, 0.9), (1, 3, 0.5), (1, 4, 0.2)], "src int, dst int, w double")
    assert [r["w"] for r in nmic.above(e, 0.3).collect()] == [0.9, 0.5]
    assert [r["w"] for r in nmic.above(e, 0.3, drop_last=True).collect()] == [0.9]
    assert nmic.above(e, 0.8, drop_last=True).collect() == []


# -------------------------------------------------------------------- stats


def test_windowed_cv_matches_numpy(spark):
    rng = np.random.RandomState(0)
    m = rng.gamma(2, 2, (50, 3))
    m[:, 2] = 0
    long = spark.createDataFrame([(i, j, float(m[i, j])) for i in range(50) for j in range(3)], "obs long, feat int, value double")
    spans = ratio_windows(50)
    got = dict(rows(stats.windowed_cv(long, spans)))
    for j in range(3):
        s = np.sort(m[:, j])
        want = max(0 if s[a:b].mean() < f else s[a:b].std(ddof=1) / s[a:b].mean() for a, b, f in [*((a, b, 1e-4) for a, b in spans), (0, 50, 0.01)])
        assert math.isclose(got[j], want, rel_tol=1e-9, abs_tol=1e-12)


def test_class_and_cv_weights(spark):
    hot = spark.createDataFrame([(1, 0, 0)] * 3 + [(0, 1, 0)], "a int, b int, c int")
    got = {r["class"]: round(r["weight"], 6) for r in stats.class_weights(hot, ["a", "b", "c"]).collect()}
    assert got == {"a": 0.16, "b": 0.48, "c": 0.36}
    data = [(i, f, float(v)) for i, r in enumerate([(0, 1, 3), (0, 1, 0), (0, 1, 0)]) for f, v in enumerate(r)]
    w = dict(rows(stats.cv_weights(spark.createDataFrame(data, "obs int, feat int, value double"))))
    assert w[0] == w[1] == 0.5 and math.isclose(w[2], 0.99)


def test_summary_of_nothing_and_dirt(spark):
    df = spark.createDataFrame([(1.0,), (NAN,), (None,), (float("inf"),), (-3.0,), (0.0,)], "x double")
    r = stats.summary(df, "x").first()
    assert (r["n"], r["n_finite"], r["min"], r["max"]) == (6, 3, -3.0, 1.0)
    assert stats.summary(df.limit(0), "x").first()["n"] == 0
    assert stats.summary(df, "x", exact=False).first()["quantiles"][4] == 0.0


def test_quantile_filter_per_group(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", 10.0), ("b", None), ("b", NAN)], "g string, x double")
    assert rows(stats.quantile_filter(df, "x", q=0.9, group=["g"])) == [("a", 2.0), ("b", 10.0)]
    assert stats.quantile_filter(df, "x").count() == 5


# -------------------------------------------------------------------- edges

EDGES = [(2, 1, 0.3), (1, 2, 0.5), (3, 3, 0.9), (1, 4, 0.2), (None, 4, 1.0), (-1, 4, 1.0), (5, 6, NAN), (5, 6, None)]


def test_canonical(spark):
    e = spark.createDataFrame(EDGES, "u long, v long, w double")
    c = E.canonical(e, "u", "v", "w")
    assert rows(c) == [(1, 2, 0.5), (1, 4, 0.2)]
    assert rows(E.canonical(c, "u", "v", "w")) == rows(c)
    assert E.canonical(e.limit(0), "u", "v", "w").collect() == []


def test_fuse(spark):
    e = spark.createDataFrame([(1, 2, 0.3, "A", "t"), (2, 1, 0.5, "A", "t"), (1, 2, 0.1, "B", "t")], "u long, v long, w double, s string, k string")
    r = E.fuse(e, "u", "v", "w", "s", "k").first()
    assert (r["u"], r["v"], round(r["w"], 9), r["source"], r["n_sources"]) == (1, 2, 0.6, "A", 2)


def test_undirected_top(spark):
    e = spark.createDataFrame([(1, 2, 0.9), (2, 3, 0.8), (3, 4, 0.1)], "u long, v long, w double")
    assert len(rows(E.undirected_top(e, 1))) == 3
    star = spark.createDataFrame([(0, i, float(i)) for i in range(1, 9)], "u long, v long, w double")
    assert len(rows(E.undirected_top(star, 2))) == 8  # either end keeps
    assert rows(E.directed_top(star, 2)) == [(0, 7, 7.0), (0, 8, 8.0)]


def test_top_fraction(spark):
    e = spark.createDataFrame([(i, i + 1, float(i)) for i in range(5)], "u long, v long, w double")
    assert E.top_fraction(e, 0.5).count() == 3 and E.top_fraction(e.limit(0), 0.5).count() == 0


def test_vocabulary_must_be_dense(spark):
    old = spark.createDataFrame([("a", 0), ("b", 2)], "name string, idx long")
    with pytest.raises(ValueError):
        E.expand_vocabulary(old, old)
    ok = spark.createDataFrame([("b", 0), ("a", 1)], "name string, idx long")
    new = spark.createDataFrame([("z",), ("a",), ("c",), (None,), ("c",)], "name string")
    assert rows(E.expand_vocabulary(ok, new)) == [("a", 1, "old"), ("b", 0, "old"), ("c", 2, "new"), ("z", 3, "new")]


def test_canonical_table(spark):
    data = [(3, 1, "x", "y", 0.5), (1, 1, "a", "a", 1.0), (None, 1, "a", "a", 1.0), (4, 5, None, "b", float("nan"))]
    e = spark.createDataFrame([(*r, "s", None, 7) for r in data], "src_expanded_idx long, dst_expanded_idx long, src string, dst string, edge_weight double, edge_source string, edge_type string, w int")
    t = E.canonical_table(e)
    assert t.schema == E.EDGE_SCHEMA and rows(t) == [(1, 3, "y", "x", 0.5, "s", None), (4, 5, None, "b", None, "s", None)]
    for c in ("edge_weight", "src", "edge_type"):
        with pytest.raises(ValueError):
            E.canonical_table(e.drop(c))


def test_k_hop_goes_against_the_edges(spark):
    e = spark.createDataFrame([(1, 2), (2, 3), (3, 4)], "u long, v long")
    s = spark.createDataFrame([(4,)], "node long")
    assert {r["node"] for r in E.k_hop(e, s, 2).collect()} == {2, 3, 4}


def test_components(spark):
    rng = np.random.RandomState(7)
    pairs = [(int(a), int(b)) for a, b in rng.randint(0, 300, (220, 2))] + [(1000, i) for i in range(1001, 1100)] + [(i, i + 1) for i in range(2000, 2200)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        parent[max(x, y)] = min(x, y)
    e = spark.createDataFrame([*pairs, (None, 5), (7777, 7777)], "a long, b long")
    assert dict(rows(min_labels(e, "a", "b"))) == {**{x: find(x) for x in list(parent)}, 7777: 7777}
    assert min_labels(e.limit(0), "a", "b").collect() == []


# ------------------------------------------------------------------ samples


def test_weak_edges_come_back_between_chosen_nodes(spark):
    long = spark.createDataFrame([(1, f, 1.0) for f in "abc"] + [(2, "a", 0.0), (3, "c", None), (4, "d", 5.0)], "obs int, feat string, value double")
    edges = spark.createDataFrame([("a", "b", 0.9), ("b", "c", 0.1), ("a", "c", 0.8)], "u string, v string, w double")
    cv = spark.createDataFrame([("a", 0.1), ("b", 0.2), ("c", 0.3), ("d", 0.0)], "feat string, cv double")
    nodes, inner = samples.active_subgraphs(long, edges, cv, 0.5, 0, 1)
    assert rows(nodes, "obs", "feat", "idx") == [(1, "a", 0), (1, "b", 1), (1, "c", 2), (4, "d", 0)]
    assert rows(inner, "obs", "u", "v") == [(1, "a", "b"), (1, "a", "c"), (1, "b", "c")]
    got = {r["obs"]: (len(r["x"]), len(r["edges"])) for r in samples.as_rows(nodes, inner).collect()}
    assert got == {1: (3, 3), 4: (1, 0)}


def test_require_active(spark):
    long = spark.createDataFrame([(1, "a", 1.0), (2, "a", 0.0)], "obs int, feat string, value double")
    assert samples.require_active(long.where("obs = 1")).count() == 1
    with pytest.raises(Exception, match="no active feature"):
        samples.require_active(long).collect()


def test_coverage_sample_repeats(spark):
    long = spark.createDataFrame([(o, f, float(o + f)) for o in range(20) for f in range(1, 15)], "obs int, feat int, value double")
    a, b = (rows(samples.coverage_sample(long, 4, 3)) for _ in range(2))
    assert a == b and len(a) == 80 and a != rows(samples.coverage_sample(long, 4, 4))


def test_multiscale_micro(spark):
    # two triangles, one bridge: one-hop reaches of the hub merge with their likes
    r = np.array([0, 1, 2, 3, 4, 5])
    c = np.array([1, 2, 0, 4, 5, 3])
    got = greedy.multiscale(6, r, c, np.array([3.0, 1, 1, 2, 1, 1]), 2, 0.85)
    assert [sorted(np.flatnonzero(m)) for _, m in got] == [[0, 1, 2], [3, 4, 5]]
    assert greedy.multiscale(3, np.array([], int), np.array([], int), np.zeros(3), 2, 0.85) == []


# ---------------------------------------------------------------- intervals


def test_intervals_micro(spark):
    iv = spark.createDataFrame([("c", 1, 5), ("c", 5, 8), ("c", 7, 9)], "chr string, start long, end long")
    m = intervals.merge(iv)
    assert rows(m, "chr", "start", "end") == [("c", 1, 5), ("c", 5, 9)]
    assert intervals.has_overlap(iv).first()[0] and not intervals.has_overlap(m).first()[0]
    assert not intervals.has_overlap(iv.limit(0)).first()[0]
    q = spark.createDataFrame([("c", 5, 5)], "chr string, start long, end long")
    assert intervals.align(q, m).count() == 2


@given(st.lists(st.tuples(st.sampled_from("ab"), st.integers(0, 400), st.integers(0, 90)), max_size=30))
@settings(max_examples=10, deadline=None)
def test_interval_properties(spark, data):
    iv = spark.createDataFrame([(c, s, s + n) for c, s, n in data], "chr string, start long, end long")
    m = intervals.merge(iv)
    assert rows(m, "chr", "start", "end") == rows(intervals.merge(iv, 16), "chr", "start", "end")
    assert not intervals.has_overlap(m).first()[0]
    ref = rows(m, "chr", "start", "end")
    got = rows(intervals.align(iv, m, 16), "chr", "start", "end", "ref_start", "ref_end")
    want = sorted(((c, s, s + n, a, b) for c, s, n in data for k, a, b in ref if k == c and s <= b and s + n >= a), key=repr)
    assert got == want


def test_parse_and_remap(spark):
    p = intervals.parse(spark.createDataFrame([("chr1:5-9",), ("bad",), (None,), ("x:1-2-3",)], "peak string"))
    assert rows(p) == [("chr1", 5, 9, "chr1:5-9")]
    counts = spark.createDataFrame([("o", "p1", 1.0), ("o", "p2", 2.0)], "obs string, peak string, value double")
    mapping = spark.createDataFrame([("p1", "m"), ("p2", "m"), ("p2", "n")], "peak string, merged string")
    assert rows(intervals.remap(counts, mapping, strict=False), "obs", "merged", "value") == [("o", "m", 3.0), ("o", "n", 2.0)]
    with pytest.raises(ValueError):
        intervals.remap(counts, mapping)


# ----------------------------------------------------------------- sampling


def test_split_sizes(spark):
    df = spark.range(7).withColumn("g", F.lit("a")).withColumn("h", F.lit(None).cast("string"))
    n = {r["split"]: r["count"] for r in sampling.joint_split(df, "id", 1, ["g", "h"]).groupBy("split").count().collect()}
    assert n == {"trn": 6, "val": 1}
    with pytest.raises(ValueError):
        sampling.random_split(df, "id", 1, ratios=(0.5, 0.4, 0.2))


def test_balance_and_leakage(spark):
    df = spark.range(110).withColumn("g", F.when(F.col("id") < 100, "big").otherwise("small"))
    for how, want in (("over", 100), ("under", 10), ("combined", 55)):
        n = {r["g"]: r["count"] for r in sampling.balance(df, "id", 3, ["g"], how).groupBy("g").count().collect()}
        assert n == {"big": want, "small": want}
    safe = sampling.balanced_split(df, "id", 3, ["g"], "over")
    assert safe.groupBy("id").agg(F.count_distinct("split").alias("k")).where("k > 1").count() == 0


# ------------------------------------------------------------------ reshape


def test_tolerant_scan(spark):
    df = spark.createDataFrame([("c1", "b", 5, 1.5, "x")], ["barcode", "Batch", "n_genes", "gene.1", "note"])
    assert rows(reshape.to_long(df)) == [("c1", "gene.1", 1.5)]


def test_one_hot_round_trip(spark):
    df = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", None)], "id string, l string")
    hot = reshape.one_hot(df, "id", "l")
    assert hot.columns == ["obs", "ct_x", "ct_y", "ct_unknown"]
    assert rows(reshape.from_one_hot(hot)) == [("a", "x"), ("b", "y")]


def test_coverage_gate(spark):
    long = spark.createDataFrame([("o", "a", 1.0)], "obs string, feat string, value double")
    voc = spark.createDataFrame([("a",), ("b",)], "feat string")
    assert reshape.require_coverage(long, voc, 0.5) == 0.5
    with pytest.raises(ValueError):
        reshape.require_coverage(long, voc)
    assert rows(reshape.aligned(long, voc)) == [("o", "a", 1.0), ("o", "b", 0.0)]


def test_numbered_is_dense(spark):
    df = spark.range(1000).repartition(7)
    got = sorted((r["id"], r["row"]) for r in reshape.numbered(df, ["id"]).collect())
    assert got == [(i, i) for i in range(1000)]


# ------------------------------------------------------------------ metrics


def test_metrics_micro(spark):
    pairs = spark.createDataFrame([("o", i, float(t), float(p)) for i, (t, p) in enumerate(zip((1, 2, 3), (1, 3, 2)))], "obs string, feat int, t double, p double")
    r = metrics.errors(pairs, "obs").first()
    assert round(r["mse"], 6) == 0.666667 and round(r["mae"], 6) == 0.666667 and round(r["pearson"], 9) == 0.5
    assert round(metrics.jsd(pairs, "obs").first()["jsd"], 8) == 0.10095571
    flat = pairs.withColumn("t", F.lit(1.0))
    assert math.isnan(metrics.errors(flat, "obs").first()["pearson"]) and math.isnan(metrics.regression_scores(flat, "t", "p").first()["r2"])


def test_clustering_micro(spark):
    df = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (1, 1)], "truth int, pred int")
    c = metrics.confusion(df)
    assert abs(metrics.clustering_scores(c).first()["ari"]) < 1e-12
    same = metrics.confusion(spark.createDataFrame([(0, 5), (1, 6), (1, 6)], "truth int, pred int"))
    r = metrics.clustering_scores(same).first()
    assert math.isclose(r["ari"], 1) and math.isclose(r["nmi"], 1) and math.isclose(metrics.adjusted_mutual_information(same), 1)


def test_perfect_scores_and_missing_classes(spark):
    p = spark.createDataFrame([(o, c, 1.0 if c == o % 2 else 0.0) for o in range(6) for c in range(3)], "obs int, class int, prob double")
    t = spark.createDataFrame([(o, o % 2) for o in range(6)], "obs int, truth int")
    got = {r["class"]: (r["auroc"], r["auprc"]) for r in metrics.auroc(p, t).collect()}
    assert got == {0: (1.0, 1.0), 1: (1.0, 1.0), 2: (None, None)}
    assert metrics.weighted_auc(metrics.auroc(p, t)).first()["auroc"] == 1.0
    with pytest.raises(ValueError):
        metrics.require_distribution(p.withColumn("prob", F.lit(0.7)))


def test_chi2_tail():
    assert math.isclose(chi2_tail(3.841458820694124, 1), 0.05, rel_tol=1e-9)
    assert math.isclose(chi2_tail(18.307038053275146, 10), 0.05, rel_tol=1e-9)
    assert chi2_tail(0, 3) == 1


def test_batch_mixing_of_many_batches(spark):
    # every row its own batch: x is n - 1 with n - 1 degrees of freedom, so none is rejected
    n = 10_050
    points = spark.createDataFrame([(i, f"b{i}", [float(i)]) for i in range(n)], "node long, batch string, vec array<double>")
    assert tuple(neighbourhood_chi2(points, 1).first()) == (n, 0, 1.0)


# ------------------------------------------------------------------ network


def test_modules_micro(spark):
    sizes = {1: 60, 2: 55, 3: 10}
    m = spark.createDataFrame([(k * 1000 + i, k) for k, n in sizes.items() for i in range(n)], "node long, module int")
    n = {r["module_id"]: r["count"] for r in network.normalized_modules(m, 50).groupBy("module_id").count().collect()}
    assert n == {"M01": 70, "M02": 55}
    assert {r[0] for r in network.normalized_modules(m, 500).select("module_id").distinct().collect()} == {"M01"}


def test_hub_count(spark):
    m = spark.createDataFrame([(i, "M01") for i in range(7)], "node long, module_id string")
    e = spark.createDataFrame([(0, i, 1.0) for i in range(1, 4)], "u long, v long, w double")
    h = network.hubs(e, m)
    assert [r["node"] for r in h.where("is_hub").collect()] == [0] and h.count() == 7


def test_communities_joint_moves_and_dirt(spark):
    rng = np.random.RandomState(2)
    part = np.repeat(np.arange(6), 20)
    data = [(int(i), int(j), float(rng.rand() + 0.1)) for i in range(120) for j in range(i + 1, 120) if rng.rand() < (0.5 if part[i] == part[j] else 0.03)]
    dirt = [(5, 5, 3.0), (1, None, 1.0), (2, 3, None), (2, 4, float("nan")), (2, 9, 0.0)]
    e = spark.createDataFrame(data + dirt, "u long, v long, w double")
    whole = communities(e)
    truth = spark.createDataFrame([(i, int(p)) for i, p in enumerate(part)], "node long, module int")
    ok = e.where("u <> v and w > 0 and not isnan(w)")
    q = lambda m: modularity(ok, m, 1.3).first()[0]
    assert whole.count() == 120 and q(whole) >= q(truth) - 1e-9
    joint = communities(e, local_edges=100)
    assert joint.count() == 120 and q(joint) > 0.9 * q(truth)
    assert communities(e.limit(0)).collect() == [] and LOCAL_EDGES > 0


def test_modularity_by_hand(spark):
    e = spark.createDataFrame([(1, 2, 1.0), (2, 3, -1.0), (1, 3, 1.0), (3, 4, 1.0)], "u long, v long, w double")
    m = spark.createDataFrame([(1, "a"), (2, "a"), (3, "a"), (4, "b")], "node long, module string")
    assert math.isclose(modularity(e, m).first()[0], 3 / 4 - (7 / 8) ** 2 - (1 / 8) ** 2)
    nodes, module = louvain(np.array([1, 2, 1, 3]), np.array([2, 3, 3, 4]), np.ones(4), 1.0)
    assert list(nodes) == [1, 2, 3, 4] and len(set(module[:2])) == 1


def test_sample_graphs_by_joins_equal_those_by_lookup(spark, monkeypatch):
    rng = np.random.RandomState(8)
    long = spark.createDataFrame([(int(o), f"f{f}", float(rng.randint(0, 3))) for o in range(40) for f in range(12) if rng.rand() < 0.6] + [(99, "zz", 1.0), (98, "f1", None), (97, "f1", float("nan"))], "obs long, feat string, value double")
    edges = spark.createDataFrame([(f"f{i}", f"f{j}", float(rng.rand())) for i in range(12) for j in range(i + 1, 12) if rng.rand() < 0.4], "u string, v string, w double")
    cv = spark.createDataFrame([(f"f{i}", float(rng.randint(0, 4))) for i in range(10)], "feat string, cv double")
    one = [rows(x) for x in samples.active_subgraphs(long, edges, cv, 0.5, 2, 3)]
    ind = rows(samples.induced(samples.top_absolute(long, 5), edges))
    monkeypatch.setattr(samples, "MAX_EDGES", 3)
    two = [rows(x) for x in samples.active_subgraphs(long, edges, cv, 0.5, 2, 3)]
    assert one == two and len(one[1]) > 20
    assert ind == rows(samples.induced(samples.top_absolute(long, 5), edges))
    none = samples.active_subgraphs(long.limit(0), edges, cv, 0.5, 2, 3)
    assert [x.collect() for x in none] == [[], []]


def test_budgets():
    assert samples.budgets(1200, 0) == (1200, 0, 0)
    assert samples.budgets(10, 2, 0.5, 0.5) == (2, 3, 3)
    assert samples.budgets(10, 0, 0.4, 0.4, 6) == (6, 0, 4)
    assert samples.budgets(1, 5, 0.3, 0.3) == (1, 0, 0)


def test_select_nodes_cases(spark):
    data = [(1, "a", 5.0), (1, "b", -4.0), (1, "c", 0.0), (1, "d", 1.0), (2, "a", 0.0), (2, "b", 0.0), (3, "a", None), (1, "e", float("nan"))]
    long = spark.createDataFrame(data, "obs long, feat string, value double")
    got = rows(samples.select_nodes(long, 2), "obs", "feat", "part", "idx")
    assert got == [(1, "a", "base", 0), (1, "b", "base", 1), (2, "a", "base", 0), (2, "b", "base", 1)]
    got = rows(samples.select_nodes(long, 3, forced=["c", "nowhere"]), "obs", "feat", "part")
    # two forced leave room for one; the sample that has neither is filled up to two
    assert got == [(1, "a", "base"), (1, "c", "forced"), (2, "a", "base"), (2, "b", "fill")]
    assert {r["feat"] for r in samples.select_nodes(long, 4, policy="all").where("obs = 1").collect()} == {"a", "b", "c", "d"}
    with pytest.raises(ValueError):
        samples.select_nodes(long, 2, policy="none")


def test_quantiles_and_first_rows(spark):
    rng = np.random.RandomState(4)
    data = [(int(rng.randint(3)) if rng.rand() < 0.9 else None, float(rng.randint(0, 40)), i) for i in range(3000)] + [(7, None, 1), (7, float("nan"), 1)]
    df = spark.createDataFrame(data, "g long, x double, i long")
    for r in stats.quantiles(df, "x", [0.0, 0.25, 0.333, 1.0], ["g"]).collect():
        want = np.quantile([x for g, x, _ in data if g == r["g"] and x is not None and x == x], [0.0, 0.25, 0.333, 1.0])
        assert np.allclose(r["q"], want, atol=1e-12)
    assert stats.quantiles(df, "x", [0.5], ["g"]).count() == 4 and stats.quantiles(df.limit(0), "x", [0.5]).collect() == []
    clean = [(x, i) for _, x, i in data[:3000]]
    for k in (1, 100, 2999, 3000, 5000):
        got = {(r["x"], r["i"]) for r in stats.first_rows(df.limit(3000).where("x is not null"), "x", ["i"], k).collect()}
        assert got == set(sorted(clean, key=lambda r: (-r[0], r[1]))[:k])
    assert len(stats.first_rows(df, "x", ["i"], 3001).collect()) == 3001


def test_running_plain_windows_equal_range_sort(spark):
    rng = np.random.RandomState(6)
    df = spark.createDataFrame([(int(rng.randint(4)), int(rng.randint(50)), i, float(rng.rand())) for i in range(2000)], "g long, o long, i long, x double")
    values = {"s": (F.sum, "x"), "m": (F.max, "x")}
    for inc in (True, False):
        a = rows(running(df, ["g"], ["o", "i"], values, inclusive=inc), "g", "i", "m")
        assert a == rows(running(df, ["g"], ["o", "i"], values, inclusive=inc, most=2000), "g", "i", "m")


def test_adjusted_information_by_brute_force(spark):
    rng = np.random.RandomState(9)
    t, p = rng.randint(4, size=90), rng.randint(5, size=90)
    p[:40] = t[:40]
    df = spark.createDataFrame([(int(a), int(b)) for a, b in zip(t, p)], "truth int, pred int").groupBy("truth", "pred").agg(F.count(F.lit(1)).alias("n"))
    info = lambda a, b: sum(c / 90 * math.log(c * 90 / (np.sum(a == x) * np.sum(b == y))) for x in set(a) for y in set(b) if (c := int(np.sum((a == x) & (b == y)))))
    chance = np.mean([info(t, rng.permutation(p)) for _ in range(4000)])
    want = (info(t, p) - chance) / ((info(t, t) + info(p, p)) / 2 - chance)
    assert abs(metrics.adjusted_mutual_information(df) - want) < 0.003
    assert metrics.adjusted_mutual_information(df.limit(0)) == 1.0


def test_communities_find_cliques(spark):
    cl = [(b + i, b + j, 1.0) for b in (0, 10) for i in range(5) for j in range(i + 1, 5)]
    e = spark.createDataFrame([*cl, (4, 10, 0.1)], "u long, v long, w double")
    got = dict(rows(communities(e), "node", "module"))
    assert len({got[i] for i in range(5)}) == 1 and len({got[i] for i in range(10, 15)}) == 1 and got[0] != got[10]


def test_delta_and_initial_vectors(spark):
    a = spark.createDataFrame([(1, 2, 0.5), (1, 3, 0.1)], "u long, v long, w double")
    b = spark.createDataFrame([(1, 2, 0.25), (2, 3, 0.1)], "u long, v long, w double")
    r = network.delta_network(a, b).collect()
    assert [(x["u"], x["v"], x["delta_w"], x["delta_sign"]) for x in r] == [(1, 2, -0.25, "negative")]
    new = spark.createDataFrame([(7,), (8,)], "node long")
    old = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "node long, vec array<double>")
    e = spark.createDataFrame([(1, 7, 3.0), (2, 7, -1.0)], "u long, v long, w double")
    assert rows(network.initial_vectors(new, e, old)) == [(7, [0.75, -0.25]), (8, [0.5, 0.5])]


def test_zero_norm_cosine(spark):
    v = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 0.0])], "node long, vec array<double>")
    e = spark.createDataFrame([(1, 2)], "u long, v long")
    assert network.cosine_edges(e, v).first()["w"] == 0.0


# ---------------------------------------------------------- functions, model


def test_scalars(spark):
    df = spark.createDataFrame([(2.5,), (-2.5,), (None,), (NAN,)], "x double")
    assert [r[0] for r in df.select(S.safe_float("x")).collect()] == [2.5, -2.5, 0.0, 0.0]
    assert [r[0] for r in df.limit(2).select(S.round_half_away("x")).collect()] == [3, -3]
    t = spark.createDataFrame([("a--b",), ("a , b",), ("a:b",), ("ab",), (None,), ("a--b--c",)], "x string")
    assert [r[0] for r in t.select(S.pair_of("x")).collect()] == [["a", "b"], ["a", "b"], ["a", "b"], None, None, None]
    n = spark.createDataFrame([("10",), ("9",), ("b",), ("a",)], "x string")
    assert [r[0] for r in n.orderBy(*S.natural_order("x")).collect()] == ["9", "10", "a", "b"]
    with pytest.raises(Exception, match="negative"):
        df.select(S.log1p_strict("x")).collect()
    p = spark.createDataFrame([([1.0, 2.0],), ([1.0, 2.5],)], "p array<double>")
    assert len({r[0] for r in p.select(S.param_hash("p")).collect()}) == 2


def test_gated_pool_and_balanced_weights(spark):
    n = spark.createDataFrame([(1, i, [1.0], float(i)) for i in range(5)], "g int, node int, vec array<double>, score double")
    assert [r["node"] for r in model.gated_pool(n, 0.5).orderBy("node").collect()] == [2, 3, 4]
    assert model.mean_pool(n).first()["vec"] == [1.0]
    w = model.balanced_weights([[1.0, 4.0]] * 3)
    assert w[0] > 1 > w[1] and math.isclose(sum(w), 2)
    assert model.balanced_weights([]) == []


def test_learned_heads(spark):
    rng = np.random.RandomState(1)
    data = [([float(x) for x in rng.randn(4) + 4 * (i % 2)], i % 2) for i in range(80)]
    df = spark.createDataFrame(data, "vec array<double>, label int")
    from pyspark.ml.functions import array_to_vector

    feats = df.select(array_to_vector("vec").alias("features"), "label")
    for fitted in (model.label_predictor(df, "vec", "label", (4,)), model.search(df, "vec", "label", [0.0, 0.1], 2)):
        assert fitted.transform(feats).where("prediction = label").count() >= 76


def test_config():
    from plexora.plans.config import merged, shown

    assert merged({"a": {"b": 1, "c": 2}, "d": 1}, {"a": {"b": 3}, "d": {"e": 1}}) == {"a": {"b": 3, "c": 2}, "d": {"e": 1}}
    assert shown("JSD", 0.25) == ("1 - JSD", 0.75) and shown("f1", 0.5) == ("f1", 0.5)


def test_small_side_stops_at_its_bound(spark):
    from plexora.session import small_side

    plan = lambda df: df._jdf.queryExecution().toString()
    a = spark.range(100)
    assert "broadcast" in plan(small_side(a, 100)) and "broadcast" not in plan(small_side(a, 99))


@given(st.lists(st.one_of(st.floats(-5, 5), st.sampled_from([0.5, 1.0, NAN, None])), max_size=40), st.sampled_from([0.0, 0.1, 0.5, 0.9, 0.995, 1.0]))
@settings(max_examples=8, deadline=None)
def test_linear_quantile(spark, data, q):
    df = spark.createDataFrame([(x,) for x in data], "x double")
    good = [x for x in data if x is not None and x == x]
    got = stats.linear_quantile(df, "x", q)
    assert got is None if not good else math.isclose(got, float(np.quantile(good, q)), rel_tol=1e-12, abs_tol=1e-12)


def test_linear_quantile_of_many(spark):
    df = spark.range(200_001).selectExpr("cast(pmod(xxhash64(id), 100000) as double) as x")
    x = [r[0] for r in df.collect()]
    for q in (0.003, 0.5, 0.87654):
        assert math.isclose(stats.linear_quantile(df, "x", q), float(np.quantile(x, q)), rel_tol=1e-12)


def test_pairwise_blocks_agree(spark):
    from plexora.operators import pairwise

    rng = np.random.RandomState(9)
    data = [(i, i % 3, [float(x) for x in rng.randint(0, 4, 3)]) for i in range(40)] + [(99, 1, None)]
    p = spark.createDataFrame(data, "node long, label int, vec array<double>")
    m = {i: np.array(v) for i, _, v in data if v}
    want = sorted((i, j) for i in m for _, j in sorted((float(np.sqrt(((m[i] - m[j]) ** 2).sum())), j) for j in m if j != i)[:4])
    for block in (1000, 7):
        assert sorted((r["u"], r["v"]) for r in pairwise.nearest_rows(p, 4, block).collect()) == want
    q = p.withColumnRenamed("node", "obs")
    a, b = (rows(pairwise.label_distances(q, n).withColumn("d", F.round("d", 9))) for n in (1000, 7))
    assert a == b and len(a) == 120


def test_ranks_by_counts_equal_those_by_windows(spark, monkeypatch):
    rng = np.random.RandomState(3)
    data = [(int(g) if g else None, float(x) if x < 6 else None, i) for i, (g, x) in enumerate(zip(rng.randint(4, size=400), rng.randint(7, size=400)))]
    df = spark.createDataFrame(data, "g long, x double, i long")
    a = rows(metrics.with_rank(df, "x", ["g"], "r"), "i", "r")
    monkeypatch.setattr(metrics, "LOCAL_ROWS", 5)
    assert a == rows(metrics.with_rank(df, "x", ["g"], "r"), "i", "r")


def test_forward_against_numpy(spark):
    from plexora.operators.forward import Weights, graph_vectors, layer_norm, node_vectors, predictions

    rng = np.random.RandomState(5)
    ids = rng.randn(6, 3)
    nodes = [(g, i, float(rng.rand())) for g in (1, 2, 3) for i in range(4 if g < 3 else 1)]
    edges = [(1, 0, 1), (1, 1, 2), (1, 2, 0), (1, 3, 3), (3, 0, 5)]
    fuse = [(rng.randn(5, 4), rng.randn(4)), (rng.randn(4, 3), rng.randn(3))]
    left, right, score = rng.randn(3, 3), rng.randn(3, 3), rng.randn(3)
    w = Weights((rng.randn(2).tolist(), [0.1, 0.2]), fuse, [(left.tolist(), right.tolist(), score.tolist())], [1.0, 2.0, 0.5], [0.0, 1.0, -1.0])

    def norm(y):
        return (y - y.mean()) / np.sqrt(y.var() + 1e-5) * np.array([1.0, 2.0, 0.5]) + np.array([0.0, 1.0, -1.0])

    want = {}
    for g in (1, 2, 3):
        own = [(i, x) for h, i, x in nodes if h == g]
        h = {}
        for i, x in own:
            z = np.concatenate([ids[i], x * np.array(w.project[0]) + np.array([0.1, 0.2])]) @ fuse[0][0] + fuse[0][1]
            h[i] = (z / (1 + np.exp(-z))) @ fuse[1][0] + fuse[1][1]
        links = [(u, v) for k, u, v in edges if k == g and u != v and u in h and v in h]
        for i in h:
            y = h[i]
            if links:
                src = [u for u, v in links if v == i] + [i]
                e = np.array([(lambda a: score @ np.maximum(a, 0.2 * a))(left @ h[i] + right @ h[u]) for u in src])
                a = np.exp(e - e.max())
                y = sum(x * (right @ h[u]) for x, u in zip(a / a.sum(), src))
            want[g, i] = norm(y)
    n = spark.createDataFrame(nodes, "g int, node int, x double")
    e = spark.createDataFrame(edges, "g int, u int, v int")
    table = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(ids)], "node int, vec array<double>")
    vectors = node_vectors(n, e, table, w)
    got = {(r["g"], r["node"]): r["vec"] for r in vectors.collect()}
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k]) for k in want)
    assert {r["g"] for r in node_vectors(n, e, table, w, "skip").select("g").collect()} == {1}
    graphs = graph_vectors(vectors, e.where("g = 1 and u <> v"))
    per = {r["g"]: r["vec"] for r in graphs.collect()}
    assert set(per) == {1, 2, 3} and per[2] == [0.0] * 3 and any(per[1])
    out = predictions(graphs, [(np.eye(3), np.zeros(3))], [(-np.eye(3), np.zeros(3))]).where("g = 1").first()
    assert np.allclose(out["recon"], per[1]) and out["label"] == int(np.argmin(per[1]))
    assert spark.createDataFrame([(None,)], "v array<double>").select(layer_norm("v", [1.0], [0.0])).first()[0] is None


def test_extended_embeddings_and_variable_features(spark):
    old = spark.createDataFrame([("b", 0, [1.0, 2.0]), ("a", 1, [3.0, 4.0])], "name string, idx long, vec array<double>")
    got = {r["name"]: r for r in model.extended_embeddings(old, spark.createDataFrame([("z",), ("c",), ("a",), (None,)], "name string")).collect()}
    assert {k: r["idx"] for k, r in got.items()} == {"b": 0, "a": 1, "c": 2, "z": 3} and got["b"]["vec"] == [1.0, 2.0]
    bound = math.sqrt(6 / (4 + 2))
    assert all(len(got[k]["vec"]) == 2 and all(abs(x) <= bound for x in got[k]["vec"]) for k in "cz") and got["c"]["vec"] != got["z"]["vec"]
    rng = np.random.RandomState(1)
    long = spark.createDataFrame([(o, f"f{f}", float(rng.poisson(5) * (20 if f == 3 and o % 2 else 1))) for o in range(60) for f in range(12)] + [(0, "flat", 2.0), (1, "flat", 2.0)], "obs int, feat string, value double")
    top = model.highly_variable(long, 3)
    assert top.columns == ["feat", "mean", "dispersion", "score"] and "f3" in {r["feat"] for r in top.collect()} and "flat" not in {r["feat"] for r in model.highly_variable(long, 99).collect()}
    with pytest.raises(ValueError):
        reshape.from_columns(spark, {"a": [1], "b": [1, 2]})
