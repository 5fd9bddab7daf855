"""Readers, writers and streams: round trips in temporary folders."""

import datetime as dt
import json
import sqlite3

import numpy as np
import pytest
from pyspark.sql import functions as F

from plexora.operators.network import delta_network
from plexora.plans.guide_graph import guide_graph
from plexora.sources import graphs, tables
from plexora.streaming import updates


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_guide_graph_plan_and_store(spark, tmp_path):
    rng = np.random.RandomState(0)
    m = rng.gamma(2, 2, (60, 6))
    m[:, 5] = m[:, 0] * 3
    long = spark.createDataFrame([(i, j, float(m[i, j])) for i in range(60) for j in range(6)], "obs long, feat long, value double")
    g = guide_graph(long, n_features=5, mi=0.1, check_similar=True, pcc=0.999)
    assert g.similar.count() <= 1 and all(r["w"] > 0.1 for r in g.edges.collect())
    path = graphs.write_guide_graph(g.edges, g.matrix, str(tmp_path / "g"), g.params, g.similar)
    edges, matrix, params = graphs.read_guide_graph(spark, path)
    assert rows(edges) == rows(g.edges) and matrix.count() == g.matrix.count() and params["mi"] == 0.1
    again = graphs.write_guide_graph(g.edges, g.matrix, str(tmp_path / "g"), g.params)
    assert again != path and again.startswith(path + "_")
    with pytest.raises(Exception):
        graphs.read_guide_graph(spark, str(tmp_path / "none"))


def test_fresh_path_keeps_the_ending(spark, tmp_path):
    p = tmp_path / "a.npz"
    assert graphs.fresh_path(spark, str(p)) == str(p)
    p.write_text("")
    assert graphs.fresh_path(spark, str(p), dt.datetime(2020, 1, 2, 3, 4, 5)).endswith("a_20200102030405.npz")


def test_npz_round_trip(spark, tmp_path):
    e = spark.createDataFrame([(1, 2, 0.5), (3, 4, 0.9)], "src long, dst long, w double")
    graphs.write_npz(e, str(tmp_path / "run_b.npz"), {"thr": 0.1})
    np.savez(tmp_path / "run_a.npz", mi_values=np.array([0.1]), feat_pairs=np.array([[7, 8]]), processed_mat=np.eye(2), mat_feat_indices=np.array([5, 9]))
    got = rows(graphs.read_npz(spark, str(tmp_path / "run_*.npz"), chunk=1))
    assert got == [("run_a", 7, 8, 0.1), ("run_b", 1, 2, 0.5), ("run_b", 3, 4, 0.9)]
    assert graphs.latest(spark, str(tmp_path / "run_*.npz")).endswith("run_b.npz")
    assert rows(graphs.read_npz_matrix(spark, str(tmp_path / "run_a.npz"))) == [("run_a", 5, [1.0, 0.0]), ("run_a", 9, [0.0, 1.0])]
    np.savez(tmp_path / "bad.npz", mi_values=np.array([0.1]))
    with pytest.raises(Exception, match="lacks"):
        graphs.read_npz(spark, str(tmp_path / "bad.npz")).collect()
    with pytest.raises(ValueError):
        graphs.write_npz(e, str(tmp_path / "x.npz"), limit=1)


def test_csv_readers(spark, tmp_path):
    (tmp_path / "l.csv").write_text("x,y,z\na,1,q\nb,2,q\n")
    assert rows(tables.label_csv(spark, str(tmp_path / "l.csv"))) == [("a", "1"), ("b", "2")]
    (tmp_path / "f.csv").write_text("name\ng1\n007\n")
    assert rows(tables.feature_csv(spark, str(tmp_path / "f.csv"))) == [("007",), ("g1",)]
    with pytest.raises(ValueError):
        tables.feature_csv(spark, "f.txt")
    (tmp_path / "c.csv").write_text("barcode,annotation\na,T\n")
    assert rows(tables.cell_type_csv(spark, str(tmp_path / "c.csv"))) == [("a", "T")]
    with pytest.raises(ValueError):
        tables.cell_type_csv(spark, str(tmp_path / "f.csv"))
    obs = spark.createDataFrame([("a",), ("zz",)], "obs string")
    assert rows(tables.attach_labels(obs, tables.cell_type_csv(spark, str(tmp_path / "c.csv")), "obs")) == [("a", "T"), ("zz", "Unknown")]


def test_discovery(spark, tmp_path):
    for n in ("x+seed_3+ct+tst.h5", "seed_1+ct+val.h5", ".seed_1+ct+val.h5", "seed_1.h5", "x+seed_3+ct+tst.txt"):
        (tmp_path / n).write_text("x")
    f = tables.prediction_files(tables.file_names(spark, str(tmp_path), "*"))
    assert [(r["seed_num"], r["task"], r["split"]) for r in f.orderBy("seed_num").collect()] == [(1, "ct", "val"), (3, "ct", "tst")]
    assert tables.prediction_files(tables.file_names(spark, str(tmp_path), "*"), split="val").count() == 1
    c = spark.createDataFrame([("a/val_loss=0.5.ckpt",), ("a/val_loss=0.25-v1.ckpt",), ("a/last.ckpt",)], "path string")
    assert tables.best_checkpoint(c).first()["path"] == "a/val_loss=0.25-v1.ckpt"
    assert tables.best_checkpoint(c.limit(0)).collect() == []


def test_logs_and_studies(spark, tmp_path):
    d = tmp_path / "logs" / "bulk" / "seed_1" / "ct"
    d.mkdir(parents=True)
    (d / "a.json").write_text(json.dumps({"loss": 0.5}))
    (d / "b.json").write_text(json.dumps({"f1": 0.9}))
    got = {r["log_name"]: (r["data"], r["seed"], r["task"], r["loss"], r["f1"]) for r in tables.run_logs(spark, str(tmp_path / "logs")).collect()}
    assert got == {"a": ("bulk", "seed_1", "ct", 0.5, None), "b": ("bulk", "seed_1", "ct", None, 0.9)}
    con = sqlite3.connect(tmp_path / "s.db")
    con.executescript("create table studies(study_id int, study_name text); create table trials(trial_id int, number int, study_id int, state text, datetime_start text, datetime_complete text); create table trial_values(trial_id int, value real); insert into studies values (1, 's'); insert into trials values (1, 0, 1, 'COMPLETE', 'a', 'b'), (2, 1, 1, 'FAIL', 'a', 'b'), (3, 2, 1, 'COMPLETE', 'a', 'b'); insert into trial_values values (1, 0.5), (2, 0.1), (3, 0.3)")
    con.commit()
    con.close()
    best = tables.best_trials(tables.study_databases(spark, str(tmp_path)), "study", "value", "trial").first()
    assert (best["study"], best["best_value"], best["best_params"], best["n_trials"]) == ("s", 0.3, 2, 2)


def test_sample_network_and_prediction_stores(spark, tmp_path):
    s = spark.createDataFrame([("o1", "trn"), ("o2", "tst"), ("o3", "trn")], "obs string, split string")
    graphs.write_samples(s, str(tmp_path / "s"))
    assert rows(graphs.read_samples(spark, str(tmp_path / "s"), "trn", 3)) == [("o1",), ("o3",)]
    graphs.write_samples(s, str(tmp_path / "t"), test_only=True)
    assert spark.read.parquet(str(tmp_path / "t")).count() == 1
    e = spark.createDataFrame([(1, 2, 0.5)], "u long, v long, w double")
    graphs.write_network(delta_network(e, e), spark.createDataFrame([(1, "a")], "gene_id long, gene_name string"), str(tmp_path / "n"))
    assert spark.read.json(str(tmp_path / "n" / "summary")).first()["n_edges"] == 1
    m = spark.createDataFrame([(1, "M01"), (2, "M01")], "node long, module_id string")
    names = spark.createDataFrame([(1, "b"), (2, "a"), (2, "a")], "idx long, name string")
    graphs.write_modules(m, names, m, str(tmp_path / "m"))
    assert [r[0] for r in spark.read.text(str(tmp_path / "m" / "gene_sets" / "module_id=M01")).collect()] == ["a", "b"]
    graphs.write_predictions(s.select("obs"), str(tmp_path / "p"), "r1")
    graphs.write_predictions(s.select("obs"), str(tmp_path / "p"), "r2")
    assert graphs.read_predictions(spark, str(tmp_path / "p"), "r1").count() == 3
    assert "obs" in graphs.describe(s)
    with pytest.raises((RuntimeError, NotImplementedError)):
        graphs.write_hdf5()


def test_streams(spark, tmp_path):
    src = str(tmp_path / "events")
    ts = [dt.datetime(2024, 1, 1, h) for h in (0, 0, 1, 5, 5)]
    spark.createDataFrame([(t, "a", float(i)) for i, t in enumerate(ts)], "ts timestamp, event_type string, value double").coalesce(1).write.parquet(src)
    stream = updates.event_windows(updates.read_table(spark, src))
    updates.run_to_end(stream, str(tmp_path / "out"), str(tmp_path / "ck"))
    got = spark.read.parquet(str(tmp_path / "out")).groupBy("start").agg(F.sum("n").alias("n")).orderBy("start").collect()
    assert [r["n"] for r in got][:2] == [2, 1]

    edges = str(tmp_path / "edges")
    spark.createDataFrame([(1, 2, 0.5), (2, 3, 0.25)], "u long, v long, w double").write.parquet(edges)
    seen = {}
    updates.upsert_to_end(updates.degree_counts(updates.read_table(spark, edges, 10)), lambda df, _: seen.update({r["node"]: (r["degree"], r["strength"]) for r in df.collect()}), str(tmp_path / "ck2"))
    assert seen == {1: (1, 0.5), 2: (2, 0.75), 3: (1, 0.25)}

    obs = str(tmp_path / "obs")
    spark.createDataFrame([("o", [1, 2, 9])], "obs string, feats array<long>").write.parquet(obs)
    updates.run_to_end(updates.induced_edges(updates.read_table(spark, obs), spark.read.parquet(edges)), str(tmp_path / "out3"), str(tmp_path / "ck3"))
    assert rows(spark.read.parquet(str(tmp_path / "out3"))) == [("o", 1, 2, 0.5)]


def test_command_line(spark, tmp_path):
    from plexora.cli import main, parser

    a = parser().parse_args(["guide-graph", "-i", "x", "-o", "y"])
    assert (a.nfeat, a.cv, a.pcc, a.mi, a.maxwin, a.minwin, a.stepwin, a.stepslide, a.chksim) == (5000, 0.1, 0.95, 0.05, 0.98, 0.33, 0.07, 0.07, False)
    rng = np.random.RandomState(5)
    m = rng.gamma(2, 2, (40, 4))
    df = spark.createDataFrame([(f"o{i}", *map(float, r)) for i, r in enumerate(m)], ["obs_names", "a", "b", "c", "d"])
    df.write.parquet(str(tmp_path / "x.parquet"))
    out = main(["guide-graph", "-i", str(tmp_path / "x.parquet"), "-o", str(tmp_path / "g"), "--mi", "0.0"])
    edges, matrix, params = graphs.read_guide_graph(spark, out)
    assert {(r["src"], r["dst"]) for r in edges.collect()} <= {(x, y) for x in "abcd" for y in "abcd" if x < y} and params["mi"] == 0.0
