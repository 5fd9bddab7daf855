"""Brute force, round trips and awkward inputs for the training-data operators."""

import itertools
import math
import random

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from plexora.llm import cutoffs, encoding, mixing, neighbors, overlap, packing, splits, topn

NAN = float("nan")


def rows(df, *cols):
    return sorted((tuple(r[c] for c in cols) for r in df.collect()), key=repr)


# ------------------------------------------------------------------- cutoffs

EDGES = "edge_id long, s string, w double, source_ string, score_ int, cutoff int"


def brute_cut(values, f):
    best = None
    for v in sorted(set(values), reverse=True):
        if sum(x >= v for x in values) <= f * len(values):
            best = v
    return best


def cut_case(spark, data, targets):
    df = spark.createDataFrame([(i, s, w, "x", 1, 2) for i, (s, w) in enumerate(data)], EDGES)
    t = spark.createDataFrame(targets, "s string, f double")
    cuts = cutoffs.cutoffs(df, t, "s", "w", "s", "f")
    kept = cutoffs.kept_rows(df, cuts, "s", "w", "edge_id")
    return {r["source_"]: r for r in cuts.collect()}, {r[0] for r in kept.collect()}


def test_cutoffs_against_brute_force(spark):
    rng = random.Random(3)
    data = [("A " if i % 3 else "a", rng.choice([rng.random(), round(rng.random(), 1), 0.5])) for i in range(3000)]
    data += [("b", float(i % 4)) for i in range(1000)] + [("c", 1.0)] * 50
    targets = [("a", 0.3), ("B", 0.26), ("c", 0.5), ("d", 0.5), ("e", 1.0)]
    data += [("e", x) for x in (3.0, 1.0, 2.0)]
    cuts, kept = cut_case(spark, data, targets)
    for s, f in targets:
        s = s.lower()
        vals = [w for x, w in data if x.strip().lower() == s]
        c = brute_cut(vals, f) if vals else None
        assert cuts[s]["cutoff"] == c, s
        assert cuts[s]["n_kept"] == (sum(v >= c for v in vals) if c is not None else 0)
        assert cuts[s]["n_tied"] == (sum(v == c for v in vals) if c is not None else 0)
        assert {i for i, (x, w) in enumerate(data) if x.strip().lower() == s and c is not None and w >= c} == {i for i in kept if data[i][0].strip().lower() == s}


def test_cutoffs_ties_fill_the_bracket(spark):
    data = [("a", 0.5)] * 990 + [("a", 0.9)] * 6 + [("a", 0.95)] * 4
    cuts, kept = cut_case(spark, data, [("a", 0.5)])
    assert cuts["a"]["cutoff"] == 0.9 and len(kept) == 10 and cuts["a"]["n_tied"] == 6


def test_cutoffs_nulls_and_empty(spark):
    data = [(None, 1.0), ("a", None), ("a", NAN), (" ", 3.0), ("a", 1.0), ("a", 2.0)]
    cuts, kept = cut_case(spark, data, [("a", 0.5), (None, 0.5), ("z", None)])
    assert set(cuts) == {"a"} and cuts["a"]["n_usable"] == 2 and kept == {5}
    cuts, kept = cut_case(spark, [], [("a", 0.5)])
    assert cuts["a"]["n_usable"] == 0 and cuts["a"]["cutoff"] is None and not kept
    assert cut_case(spark, data, []) == ({}, set())


# -------------------------------------------------------------------- splits

OBS = "obs_id long, batch string, obs_names string, tissue string, group_ string, n int"
TARGET = [("trn", 0.8), ("val", 0.1), ("tst", 0.1)]


def brute_groups(data):
    """Sets of rows tied directly or through others."""
    parent = list(range(len(data)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    def red(x):
        y = "".join(c for c in (x or "").lower() if c.isascii() and c.isalnum())
        return None if y in ("", "na", "unknown") else y

    keys = [(red(b), red(n.rpartition("_")[2]) if n and "_" in n else None) for _, b, n, _ in data]
    for i, j in itertools.combinations(range(len(data)), 2):
        if any(x is not None and x == y for x, y in zip(keys[i], keys[j])):
            parent[find(i)] = find(j)
    out = {}
    for i in range(len(data)):
        out.setdefault(find(i), []).append(i)
    return [(sorted(data[i][0] for i in g), min((keys[i][0] for i in g if keys[i][0]), default=None)) for g in out.values()]


def test_splits_keep_groups_whole(spark):
    rng = random.Random(5)
    data = [(i, rng.choice([f"B-{rng.randint(0, 60)}", "na", None, " N/A", "unknown"]), rng.choice([f"x_L{rng.randint(0, 90)}", "plain", None, "y_", "z_NA"]), rng.choice(["t1", "t2", None])) for i in range(400)]
    df = spark.createDataFrame([(*r, "x", 0) for r in data], OBS)
    t = spark.createDataFrame(TARGET, "split string, proportion double")
    got = splits.assign_splits(df, t, "obs_id", "batch", "obs_names", "tissue", "split", "proportion")
    where = {r["obs_id"]: r["split"] for r in got.collect()}
    assert len(where) == 400
    want = set()
    for members, batch in brute_groups(data):
        assert len({where[m] for m in members}) == 1
        if len(members) > 1 and batch:
            want |= {(m, batch) for m in members}
    assert set(rows(splits.found_groups(got, "obs_id"), "obs_id", "group_batch")) == want


def test_splits_hit_the_proportions(spark):
    # one batch holds a third of all rows
    data = [(i, "hot" if i % 3 == 0 else f"b{i // 7}", None, f"t{i % 4}", "x", 0) for i in range(3000)]
    df = spark.createDataFrame(data, OBS)
    t = spark.createDataFrame(TARGET, "split string, proportion double")
    got = splits.assign_splits(df, t, "obs_id", "batch", "obs_names", "tissue", "split", "proportion").groupBy("split").count()
    share = {r["split"]: r["count"] / 3000 for r in got.collect()}
    assert all(abs(share[s] - p) < 0.01 for s, p in TARGET)


def test_splits_balance_every_label(spark):
    # more labels than any table of measures would hold singly, one component with a third of the rows
    data = [(i, f"batch{i // 6}", None, f"t{i % 200}", 1) for i in range(12_000)] + [(20_000 + i, "hot", None, f"t{i % 200}", 1) for i in range(6_000)]
    df = spark.createDataFrame(data, "obs_id long, batch string, obs_names string, tissue string, split long")
    goal = spark.createDataFrame([("trn", 0.6), ("val", 0.2), ("tst", 0.2)], "split string, proportion double")
    got = splits.assign_splits(df.drop("split"), goal, "obs_id", "batch", "obs_names", "tissue", "split", "proportion")
    per = got.groupBy("label_", "split").count().toPandas().pivot(index="label_", columns="split", values="count").fillna(0)
    share = per.div(per.sum(1), axis=0)
    assert len(per) == 200 and abs(share["trn"].mean() - 0.6) < 0.01
    assert (share["trn"] - 0.6).abs().max() < 0.12 and (share["val"] - 0.2).abs().max() < 0.12


def test_splits_too_many_targets(spark):
    goal = spark.createDataFrame([(f"s{i}", 1.0) for i in range(splits.MAX_SPLITS + 1)], "split string, proportion double")
    with pytest.raises(ValueError):
        splits._targets(goal, "split", "proportion")


def test_splits_empty(spark):
    t = spark.createDataFrame(TARGET, "split string, proportion double")
    df = spark.createDataFrame([], OBS)
    assert splits.assign_splits(df, t, "obs_id", "batch", "obs_names", "tissue", "split", "proportion").collect() == []
    with pytest.raises(ValueError):
        splits.split_components(df.select("group_", "tissue"), t.limit(0), "split", "proportion")


def test_anneal_improves():
    rng = np.random.RandomState(0)
    size = np.column_stack([rng.randint(1, 30, 500)] * 2).astype(float)
    props = np.array([0.8, 0.1, 0.1])
    start = rng.randint(3, size=500)
    w = np.ones(2)

    def cost(at):
        d = np.zeros((3, 2))
        np.add.at(d, at, size)
        return (((d - props[:, None] * size.sum(0)) ** 2) * w).sum()

    end = splits.anneal(size, start, props, np.zeros((3, 2)), w, 5000, 1)
    assert cost(end) < cost(start) * 1e-3
    assert (end == splits.anneal(size, start, props, np.zeros((3, 2)), w, 5000, 1)).all()


# ----------------------------------------------------------------- neighbours

VEC = "emb_id long, v array<float>, vec_ string, id_ int"


def brute_near(data, k):
    ids = [i for i, v in data if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    if not ids:
        return {}
    known = dict(data)
    ids = np.array(sorted(ids))
    m = np.array([np.array(known[i], np.float32) for i in ids], float)
    m /= np.sqrt((m * m).sum(1))[:, None]
    out = {}
    for n, i in enumerate(ids):
        s = (m @ m[n]).round(12)
        s[n] = -np.inf
        order = np.lexsort((ids, -s))[: min(k, len(ids) - 1)]
        out[int(i)] = [int(j) for j in ids[order]]
    return out


def clustered_vectors(n, seed):
    rng = np.random.RandomState(seed)
    c = rng.randn(40, 64)
    return [(i, [float(x) for x in (c[i % 40] + rng.randn(64) * 0.6) * rng.choice([0.1, 1, 50])]) for i in range(n)]


def test_neighbours_recall(spark):
    data = clustered_vectors(4000, 1)
    df = spark.createDataFrame([(i, v, "x", 0) for i, v in data], VEC)
    got = {}
    for r in neighbors.similar(df, "emb_id", "v", probes=8).collect():
        got.setdefault(r["id_"], set()).add(r["nbr_"])
    want = brute_near(data, 10)
    assert set(got) == set(want)
    recall = sum(len(got[i] & set(want[i])) for i in want) / (10 * len(want))
    assert recall >= 0.9, recall


def table_of_vectors(spark, path, n, seed, centres):
    rng = np.random.RandomState(seed)
    c = rng.randn(centres, 64).astype(np.float32)
    x = c[rng.randint(centres, size=n)] + rng.randn(n, 64).astype(np.float32) * 0.7
    pd.DataFrame({"emb_id": np.arange(n), "v": list(x)}).to_parquet(path)
    return spark.read.parquet(str(path)), x.astype(float)


def recall_of_queries(found, x, k=10):
    x = x / np.sqrt((x * x).sum(1))[:, None]
    got = {}
    for r in found.collect():
        got.setdefault(r["id_"], set()).add(r["nbr_"])
    hits = 0
    for i, near in got.items():
        s = x @ x[i]
        s[i] = -np.inf
        hits += len(near & set(np.argpartition(-s, k)[:k].tolist()))
    return len(got), hits / (k * len(got))


def test_neighbours_recall_with_many_lists(spark, tmp_path):
    # 128 lists, of which 24 are searched
    df, x = table_of_vectors(spark, tmp_path / "v.parquet", 100_000, 3, 3000)
    n, recall = recall_of_queries(neighbors.similar(df, "emb_id", "v", queries="id_ % 200 = 0"), x)
    assert n == 500 and recall >= 0.95, recall


def test_neighbours_recall_with_two_levels(spark, tmp_path, monkeypatch):
    # few centroids: the second level makes 64 lists of 16, in four groups
    monkeypatch.setattr(neighbors, "MAX_LISTS", 16)
    monkeypatch.setattr(neighbors, "GROUP", 4)
    df, x = table_of_vectors(spark, tmp_path / "v.parquet", 20_000, 4, 1000)
    n, recall = recall_of_queries(neighbors.similar(df, "emb_id", "v", queries="id_ % 100 = 0"), x)
    assert n == 200 and recall >= 0.9, recall


def test_neighbours_copies_and_dirt(spark):
    one = [1.0] + [0.0] * 63
    data = [(i, one) for i in range(30)] + [(100 + i, [1.0, 0.01 * i] + [0.0] * 62) for i in range(5)]
    data += [(200, None), (201, [1.0] * 63), (202, [0.0] * 64), (203, [NAN] + [1.0] * 63), (204, [None] + [1.0] * 63), (205, [float("inf")] + [1.0] * 63)]
    df = spark.createDataFrame([(i, v, "x", 0) for i, v in data] + [(None, one, "x", 0)], VEC)
    got = {}
    for r in neighbors.similar(df, "emb_id", "v", k=4).orderBy("id_", "rank_").collect():
        got.setdefault(r["id_"], []).append(r["nbr_"])
    # vectors 100 and 0..29 point the same way
    want = brute_near([(i, v) for i, v in data if v], 4)
    assert got == want


def test_neighbours_copies_of_other_lengths(spark, monkeypatch):
    # a third of the rows point one way at many lengths, and some rows lie beside them
    monkeypatch.setattr(neighbors, "BLOCK", 256)
    rng = np.random.RandomState(5)
    one = rng.randn(64)
    data = [(i, [float(x) for x in one * rng.uniform(0.1, 50)]) if i % 3 == 0 else (i, [float(x) for x in rng.randn(64)]) for i in range(3000)]
    data += [(3000 + i, [float(x) for x in one + rng.randn(64) * 0.2]) for i in range(20)]
    df = spark.createDataFrame([(i, v, "x", 0) for i, v in data], VEC)
    want = brute_near(data, 10)
    got = {}
    for r in neighbors.similar(df, "emb_id", "v").orderBy("id_", "rank_").collect():
        got.setdefault(r["id_"], []).append(r["nbr_"])
    assert set(got) == set(want)
    assert all(got[i] == want[i] for i in range(0, 3000, 3))
    assert all(len(set(got[i]) & set(want[i])) == 10 for i in range(3000, 3020))


def test_neighbours_few_rows(spark):
    empty = spark.createDataFrame([], VEC)
    assert neighbors.similar(empty, "emb_id", "v").collect() == []
    single = spark.createDataFrame([(7, [1.0] * 64, "x", 0)], VEC)
    assert neighbors.similar_pairs(neighbors.similar(single, "emb_id", "v")).collect() == []
    two = spark.createDataFrame([(7, [1.0] * 64, "x", 0), (3, [2.0] * 64, "x", 0)], VEC)
    assert rows(neighbors.similar_pairs(neighbors.similar(two, "emb_id", "v")), "a", "b") == [(3, 7)]


def test_neighbours_blocks(spark, monkeypatch):
    monkeypatch.setattr(neighbors, "BLOCK", 16)
    data = clustered_vectors(300, 2)
    df = spark.createDataFrame([(i, v, "x", 0) for i, v in data], VEC)
    got = {}
    for r in neighbors.similar(df, "emb_id", "v", k=5, probes=64, rerank=300, queries="id_ % 20 = 0").orderBy("id_", "rank_").collect():
        got.setdefault(r["id_"], []).append(r["nbr_"])
    want = brute_near(data, 5)
    assert got == {i: want[i] for i in want if i % 20 == 0}


# ------------------------------------------------------------------- overlaps

NAMES = "obs_id long, obs_names string, split string, tissue string, name_ string, k_ long"


def edits(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        p, d[0] = d[0], i
        for j, y in enumerate(b, 1):
            p, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, p + (x != y))
    return d[-1]


def overlap_case(spark, data):
    df = spark.createDataFrame([(*r, "x", 1) for r in data], NAMES)
    return overlap.overlaps(overlap.canonical_rows(df, "obs_id", "obs_names", "split", "tissue"), "trn", ("val", "tst"))


def brute_pairs(data):
    def red(x):
        y = "".join(c for c in x.lower() if c.isascii() and c.isalnum())
        return None if y in ("", "na", "unknown") else y

    ok = [(i, red(n), s.strip().lower(), g) for i, n, s, g in data if n is not None and s is not None and red(n)]
    t, e = [r for r in ok if r[2] == "trn"], [r for r in ok if r[2] in ("val", "tst")]
    return sorted({(min(a[0], b[0]), max(a[0], b[0])) for a in t for b in e if edits(a[1], b[1]) <= 2})


def mutated(rng, s, alphabet="ACGT"):
    for _ in range(rng.randint(0, 3)):
        i = rng.randrange(len(s) + 1)
        s = rng.choice([s[:i] + rng.choice(alphabet) + s[i:], s[:i] + s[i + 1 :], s[:i] + rng.choice(alphabet) + s[i + 1 :]])
    return s


@pytest.mark.parametrize("bucket", [256, 2])
def test_overlaps_against_brute_force(spark, monkeypatch, bucket):
    monkeypatch.setattr(overlap, "BUCKET", bucket)
    rng = random.Random(11)
    base = ["".join(rng.choice("ACGT") for _ in range(rng.choice([3, 5, 9, 20, 33]))) for _ in range(40)]
    data = []
    for i in range(500):
        n = mutated(rng, rng.choice(base)) + rng.choice(["", "_EC1", "-ec1"])
        data.append((i, rng.choice([n, n.lower(), n[:3] + "." + n[3:]]), rng.choice(["trn", " TRN", "val", "Tst ", None]), rng.choice(["a", None])))
    data += [(900, None, "trn", "a"), (901, "", "val", "a"), (902, "!!", "trn", "a"), (903, "NA", "trn", "a"), (904, "a", "val", "a"), (905, "b", "trn", "a"), (906, "x" * 2000, "trn", "a"), (907, "x" * 1999 + "y", "val", "a")]
    links, t, e = overlap_case(spark, data)
    assert sorted((r["a"], r["b"]) for r in overlap.overlap_pairs(links, t, e).collect()) == brute_pairs(data)


@pytest.mark.parametrize("n_edits", [1, 2])
def test_deletion_hashes_meet(n_edits):
    rng = random.Random(3)
    cut = overlap._deletions(n_edits)
    keys = lambda names: {n: set(p["k_"]) for n in names for p in [pd.concat(list(cut(iter([pd.DataFrame({"name_": [n]})]))))]}
    for n in ("", "a", "ab", "abcabc", "x" * 9, "é𝛽c" * 4, "sample00012345"):
        near = n
        for _ in range(n_edits):
            at, kind = rng.randint(0, max(len(near) - 1, 0)), rng.choice("idr")
            near = near[:at] + ("z" if kind != "d" else "") + near[at + (kind != "i") :]
        got = keys({n, near})
        assert got[n] & got[near]
    assert not keys({"abcdef"})["abcdef"] & keys({"uvwxyz"})["uvwxyz"]


def test_overlaps_one_edit_and_refusals(spark, monkeypatch):
    monkeypatch.setattr(overlap, "BUCKET", 2)
    rng = random.Random(12)
    t = list({"ref" + "".join(rng.choice("ab") for _ in range(rng.randint(2, 7))) for _ in range(60)})
    e = list({"ref" + "".join(rng.choice("ab") for _ in range(rng.randint(2, 7))) for _ in range(60)})
    a, b = spark.createDataFrame([(x,) for x in t], "name_ string"), spark.createDataFrame([(x,) for x in e], "name_ string")
    want = {(x, y) for x in t for y in e if edits(x, y) <= 1}
    assert {tuple(r) for r in overlap.near_names(a, b, 1).collect()} == want
    with pytest.raises(ValueError):
        overlap.near_names(a, b, 3)


def test_overlap_counts_and_empty(spark):
    data = [(1, "aaaa", "trn", "r"), (2, "aaaa", "trn", "r"), (3, "AA-AA", "val", None), (4, "aaab", "val", None), (5, "zzzzzz", "tst", "r")]
    links, t, e = overlap_case(spark, data)
    assert rows(overlap.overlap_counts(links, t, e), "split_", "group_", "n_rows", "n_exact", "n_pairs") == [("val", None, 2, 1, 4)]
    links, t, e = overlap_case(spark, [])
    assert overlap.overlap_pairs(links, t, e).collect() == [] and overlap.overlap_counts(links, t, e).collect() == []


@pytest.mark.parametrize("bucket", [256, 2])
def test_overlaps_broadcast_nothing_of_unknown_size(spark, monkeypatch, bucket):
    # a few names are small, what their substrings and deletions give is not; files of links tell as little
    monkeypatch.setattr(overlap, "BUCKET", bucket)
    monkeypatch.setattr(overlap, "BROADCAST_ROWS", 3, raising=False)
    data = [(i, f"sample{i % 7}{i:04d}ec", "trn" if i % 2 else "val", "r") for i in range(40)]
    df = spark.createDataFrame([(*r, "x", 1) for r in data], NAMES)
    inner = lambda x: [y for y in x._jdf.queryExecution().executedPlan().toString().split("\n") if "BroadcastHashJoin" in y and "Inner" in y]
    found, write = [], overlap.materialize
    monkeypatch.setattr(overlap, "materialize", lambda x, *a, **k: (found.extend(inner(x)), write(x, *a, **k))[1])
    pairs = overlap.overlap_pairs(*overlap.overlaps(overlap.canonical_rows(df, "obs_id", "obs_names", "split", "tissue"), "trn", ("val",)))
    assert not found and not inner(pairs)
    assert sorted((r["a"], r["b"]) for r in pairs.collect()) == brute_pairs(data)


# ---------------------------------------------------------------------- top n

PAIRS = "npz_id string, u long, v long, w double, rank_ int, run_ string"


def brute_top(data, n):
    best = {}
    for r, u, v, w in data:
        if r is None or u is None or v is None or w is None or w != w or u < 0 or v < 0 or u == v:
            continue
        k = (r, min(u, v), max(u, v))
        best[k] = max(best.get(k, -math.inf), w)
    per = {}
    for (r, a, b), w in best.items():
        per.setdefault((r, a), []).append((-w, b))
        per.setdefault((r, b), []).append((-w, a))
    return sorted(((r, i, o, -w, k + 1) for (r, i), x in per.items() for k, (w, o) in enumerate(sorted(x)[:n])), key=repr)


@pytest.mark.parametrize("tiny", [False, True])
def test_top_items_against_brute_force(spark, monkeypatch, tiny):
    if tiny:
        monkeypatch.setattr(topn, "ROW_GROUP_BYTES", 1024)
    rng = random.Random(2)
    data = [("r1", 0, i, rng.choice([0.5, 0.5, round(rng.random(), 2)])) for i in range(1, 3000)]
    data += [(rng.choice(["r1", "r2"]), rng.randint(0, 40), rng.randint(0, 40), round(rng.random(), 1)) for _ in range(1500)]
    data += [(None, 1, 2, 0.5), ("r1", None, 2, 0.5), ("r1", 1, None, 9.0), ("r1", -1, 3, 9.0), ("r1", 3, 3, 9.0), ("r1", 1, 2, NAN), ("r1", 1, 2, None), ("r1", 7, 8, -0.0), ("r1", 8, 7, 0.0)]
    df = spark.createDataFrame([(*r, 1, "x") for r in data], PAIRS)
    got = topn.top_items(df, "npz_id", "u", "v", "w", 3, file_rows=400 if tiny else 500_000)
    assert rows(got, "run_", "item_", "other_", "w_", "rank_") == brute_top(data, 3)


def test_top_items_skips_by_statistics(spark, monkeypatch):
    monkeypatch.setattr(topn, "ROW_GROUP_BYTES", 1024)
    df = spark.createDataFrame([("r", 0, i, float(i % 5000), 1, "x") for i in range(1, 20000)], PAIRS)
    path = topn.clustered(topn.unordered_pairs(df, "npz_id", "u", "v", "w"), 2000)
    every = topn.planned_groups(path, spark, 10**9).count()
    assert topn.planned_groups(path, spark, 3).count() < every * 0.7


def test_top_items_empty(spark):
    df = spark.createDataFrame([], PAIRS)
    assert topn.kept_pairs(topn.top_items(df, "npz_id", "u", "v", "w")).collect() == []


# -------------------------------------------------------------------- packing


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=120), st.integers(0, 3))
def test_pack_sizes_fits(sizes, window):
    counts = {}
    for s in sizes:
        counts[s] = counts.get(s, 0) + 1
    recipes = packing.plan(counts, 64, 16, window)
    box = packing.pack_sizes(np.array(sizes, np.int64), recipes, 1.0, 64, 16)
    used = {}
    for s, b in zip(sizes, box):
        assert b >= 0
        used[b] = used.get(b, 0) + s
    assert all(v <= 64 for v in used.values())
    # best fit leaves no two containers that would go into one
    small = sorted(used.values())[:2]
    assert len(small) < 2 or sum(small) > 64


def test_nnls_matches_known_solution():
    rng = np.random.RandomState(4)
    a = rng.rand(12, 30)
    x = np.where(rng.rand(30) < 0.2, rng.rand(30), 0)
    got = packing.nnls(a, a @ x)
    assert (got >= 0).all() and np.allclose(a @ got, a @ x, atol=1e-8)
    b = -np.ones(12)
    assert (packing.nnls(a, b) == 0).all()


def test_pack_round_trip(spark):
    rng = random.Random(6)
    texts = [(i, "x" * rng.choice([1, 5, 99, 100, 101, 250, 1000, rng.randint(1, 90)]), "t", 1) for i in range(600)]
    texts += [(1000, None, "t", 1), (1001, "", "t", 1), (1002, "é" * 60, "t", 1), (1003, "y" * 100_000, "t", 1), (5, "again", "t", 1)]
    df = spark.createDataFrame(texts, "doc_id long, text string, box_ string, size_ int")
    got = packing.pack(df, "doc_id", "text", 100).collect()
    used, per = {}, {}
    for r in got:
        used[r["box_"]] = used.get(r["box_"], 0) + r["size_"]
        per.setdefault(r["id_"], []).append(r["size_"])
    assert max(used.values()) <= 100
    want = {}
    for i, t, *_ in texts:
        n = len((t or "").encode())
        if n:
            want[i] = want.get(i, 0) + n
    assert {i: sum(x) for i, x in per.items()} == want
    assert sorted(per[1002]) == [20, 100] and len(per[1003]) == 1000
    assert len(used) <= -(-sum(want.values()) // 100) * 1.05


def test_pack_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    packed = packing.pack(df, "doc_id", "text")
    assert packed.collect() == [] and packing.fill_report(packed).first()["n_containers"] == 0


# --------------------------------------------------------------------- mixing


def mix_case(spark, docs, goals, size=None):
    df = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, text string, source string, n_ int, source_ string")
    sizes = mixing.document_sizes(df, "doc_id", "text", "source")
    plan, total, e = mixing.mix_plan(sizes, spark.createDataFrame(goals, "s string, t double, r int"), "s", "t", "r", size)
    mixed = mixing.mix(sizes, plan)
    return {p.name: p for p in plan}, total, e, mixed, {r["source"]: r for r in mixing.mix_report(mixed, plan).collect()}


def test_mix_reaches_targets(spark):
    rng = random.Random(8)
    docs = [(i, "x" * rng.randint(1, 200), rng.choice(["A", " a ", "b", "B", "c"])) for i in range(4000)] + [(9000, None, "a"), (9001, "", "a"), (9002, "xx", None)]
    plan, total, e, mixed, rep = mix_case(spark, docs, [("a", 0.5, 1), ("b", 0.3, 3), ("c", 0.2, 2)])
    assert e == 1.0 and total == sum(len(t or "") for _, t, _ in docs)
    for s, t in (("a", 0.5), ("b", 0.3), ("c", 0.2)):
        assert abs(rep[s]["share"] - t) < 0.002
        assert rep[s]["most_uses"] <= plan[s].repeats
    again = mix_case(spark, docs, [("a", 0.5, 1), ("b", 0.3, 3), ("c", 0.2, 2)])[3]
    assert rows(mixed, "id_", "uses_") == rows(again, "id_", "uses_")


def test_mix_infeasible_and_empty(spark):
    docs = [(i, "x" * 10, "big") for i in range(90)] + [(100 + i, "x" * 10, "small") for i in range(10)]
    plan, total, e, _, rep = mix_case(spark, docs, [("big", 0.5, 1), ("small", 0.5, 2), ("none", 0.1, 4)], 1000)
    assert not plan["small"].fillable and not plan["none"].fillable and plan["big"].fillable
    assert 0 < e < 1 and rep["small"]["mix_tokens"] <= 200 and rep["none"]["mix_tokens"] == 0
    plan, total, _, mixed, rep = mix_case(spark, [], [("a", 1.0, 1)])
    assert total == 0 and mixed.collect() == [] and rep["a"]["share"] == 0
    assert mix_case(spark, docs, [(None, 1.0, 1)])[4] == {}


def test_mix_without_tempering_shows_what_cannot_be_filled(spark):
    docs = [(i, "x" * 10, "big") for i in range(90)] + [(100 + i, "x" * 10, "small") for i in range(10)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    sizes = mixing.document_sizes(df, "doc_id", "text", "source")
    goal = spark.createDataFrame([("big", 0.5, 1), ("small", 0.5, 2), ("none", 0.1, 4)], "s string, t double, r int")
    plan, total, e = mixing.mix_plan(sizes, goal, "s", "t", "r", 1000.0, tempering=False)
    rep = {r["source"]: r["mix_tokens"] for r in mixing.mix_report(mixing.mix(sizes, plan), plan).collect()}
    assert e == 1.0 and rep == {"big": 500, "small": 200, "none": 0}


def test_exponent_meets_entropy():
    p, t = [0.7, 0.2, 0.1], [1 / 3] * 3
    e = mixing.exponent_for(p, t, [9, 9, 9])
    assert e == 1.0
    assert mixing.exponent_for(p, t, [0.7, 0.2, 0.1]) < 1e-9
    peaked = mixing.exponent_for(t, [0.98, 0.01, 0.01], [9, 9, 9], entropy=0.9)
    w = mixing.tempered(t, [0.98, 0.01, 0.01], peaked)
    assert abs(-sum(x * math.log(x) for x in w) - 0.9) < 1e-6


# ------------------------------------------------------------------- encoding

SENTENCES = [
    "Die Proben wurden gekühlt und anschließend gezählt, häufiger als zufällig.",
    "Après une nuit fraîche, l’arête a été divisée, à vérifier.",
    "El tamaño de la ventana cambió y la expresión media subió.",
    "Срок цветения записан для линий, остальные пришли поздно.",
    "Błędnie połączenia krawędzi spóźniona była częste źródło.",
    "試料は低温で保存した。開花時期は系統で記録された。",
    "Kept at 5 °C – “naïve” baseline ≥ 0.5, β ± 3 µl × 2",
]


def wrong(t, chain):
    for enc, dec in chain:
        b = t.encode(enc, "replace")
        t = "".join(bytes([x]).decode(dec, "ignore") or chr(x) for x in b) if dec not in ("utf-8",) else b.decode(dec, "replace")
    return t


CHAINS = [
    [("utf-8", "cp1252")], [("utf-8", "latin-1")], [("utf-8", "cp1250")], [("utf-8", "cp1251")], [("utf-8", "mac-roman")], [("utf-8", "cp437")],
    [("utf-8", "cp1252"), ("utf-8", "cp1252")],
]


def test_encoding_found_and_restored(spark):
    clean = [(i, SENTENCES[i % 7] + f" {i}") for i in range(140)]
    broken = {1000 + 10 * c + s: (SENTENCES[s], wrong(SENTENCES[s], chain)) for c, chain in enumerate(CHAINS) for s in range(7)}
    marked = [(5000, "Die Proben wurden gek&#252;hlt."), (5001, "Die Proben wurden gek&#195;&#188;hlt."), (5002, None), (5003, ""), (5004, "plain ascii"), (5005, "Tray Å3, Ã4 and Â5"), (5006, "REGIÃO É… « Ü“ »"), (5007, "lost: gek�hlt")]
    docs = [(i, t) for i, t in clean] + [(i, g) for i, (_, g) in broken.items()] + marked
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in docs], "doc_id long, text string, form string, word string")
    evidence, _ = encoding.garbled_words(df, "doc_id", "text")
    found = {r[0] for r in evidence.select("id_").distinct().collect()}
    assert found == {i for i, (a, b) in broken.items() if a != b} | {5001, 5007}
    fixed = {r["id_"]: r for r in encoding.restored(df, "doc_id", "text").collect()}
    whole = sum(fixed[i]["text_"] == a for i, (a, b) in broken.items())
    assert whole >= 0.9 * len(broken), whole
    assert fixed[5001]["text_"] == "Die Proben wurden gekühlt."
    assert fixed[5007]["text_"] == "lost: gekühlt"


def test_encoding_part_of_a_word_and_long_texts(spark):
    clean = [(i, "été modérée " * 50) for i in range(20)]
    df = spark.createDataFrame(clean + [(50, "l’étÃ© fini"), (51, "modérÃ©e " + "x" * 200_000)], "doc_id long, text string")
    out = {r["id_"]: r["text_"] for r in encoding.restored(df, "doc_id", "text").collect()}
    assert set(out) == {50, 51} and out[50] == "l’été fini" and out[51].startswith("modérée x") and len(out[51]) == 200_008


@pytest.mark.parametrize("chain", [("cp1251", "cp1252"), ("koi8-r", "cp1251"), ("cp1251", "mac-roman")])
def test_encoding_copies_of_one_garbled_text(spark, chain):
    # single-byte chains have the word match only; a third of the rows are one such text
    clean = [(i, SENTENCES[i % 7] + f" {i}") for i in range(140)]
    # an original with as many texts as its garbled form: copies must not turn the two round
    clean.append((900, SENTENCES[3] + " Редкостный случай"))
    hot = wrong(clean[-1][1], [chain])
    df = spark.createDataFrame(clean + [(1000 + i, hot) for i in range(70)], "doc_id long, text string")
    fixed = {r["id_"]: r["text_"] for r in encoding.restored(df, "doc_id", "text").collect()}
    assert set(fixed) == set(range(1000, 1070))
    assert all(t.startswith(SENTENCES[3]) for t in fixed.values())


def test_encoding_leaves_clean_words_alone(spark):
    # two capitals are the bytes of an East Asian character that the corpus has
    docs = [(i, SENTENCES[i % 7] + f" {i}") for i in range(140)]
    docs += [(500 + i, "A ESTAÇÃO DA SEÇÃO") for i in range(30)] + [(600, "ESTAÇÃO"), (601, "Редкие клетки РЁБРА Рёбра"), (602, "INFORMAÇÕES E AÇÃO")]
    docs += [(700 + i, "開花のЫ時期 " + c) for i, c in enumerate("のЫがは")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    assert encoding.restored(df, "doc_id", "text").collect() == []


def test_encoding_lossy_forms_follow_the_text(spark):
    docs = [(i, SENTENCES[i % 7] + f" {i}") for i in range(140)] + [(300 + i, f"die Dichte ρl ist {i}") for i in range(30)]
    lossy = "9 µl gekühlt und häufiger gezählt".encode("cp1252").decode("utf-8", "replace")
    df = spark.createDataFrame(docs + [(900, lossy), (901, "nur l\ufffd")], "doc_id long, text string")
    got = {r["id_"]: (r["text_"], r["n_lost"]) for r in encoding.restored(df, "doc_id", "text").collect()}
    assert got[900] == ("9 µl gekühlt und häufiger gezählt", 0)
    assert set(got) == {900, 901} and got[901] == ("nur l\ufffd", 1)


def test_encoding_words_of_one_document_are_originals(spark):
    # neither text is repeated; the garbled one holds a word that stands nowhere else
    clean = SENTENCES[3] + " Редкостный случай наблюдали"
    docs = [(i, SENTENCES[i % 7] + f" {i}") for i in range(140)] + [(900, clean)]
    bad = wrong(clean + " позднейший", [("koi8-r", "cp1251")])
    df = spark.createDataFrame(docs + [(901, bad), (902, wrong("Wüstenläufer", [("utf-8", "cp1252")])), (903, "Wüstenläufer")], "doc_id long, text string")
    got = {r["id_"]: r["text_"] for r in encoding.restored(df, "doc_id", "text").collect()}
    assert got == {901: clean + " позднейший", 902: "Wüstenläufer"}


def test_undone_leads_back():
    tables = encoding._tables()
    inverse = {n: {c: b for b, c in enumerate(row)} for n, row in tables.items()}
    for word in ("größer", "клетка", "ρ°"):
        for form, chain in encoding.garbled_forms(word, tables):
            back = encoding.undone(form, chain, tables, inverse)
            assert back is None or (form, chain) in encoding.garbled_forms(back, tables)
    assert encoding.undone("grÃ¶ÃŸer", "utf-8>cp1252", tables, inverse) == "größer"
    assert encoding.undone("größer", "utf-8>cp1252", tables, inverse) is None


def test_encoding_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert encoding.restored(df, "doc_id", "text").collect() == []
