"""Sinks and sources of guide graphs, sample graphs and networks."""

from __future__ import annotations

import datetime as dt
import io

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def fresh_path(spark: SparkSession, path: str, now: dt.datetime | None = None) -> str:
    """``path``, or with ``_%Y%m%d%H%M%S`` added where it exists already."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        return path
    stem, dot, end = path.rpartition(".")
    stamp = (now or dt.datetime.now()).strftime("%Y%m%d%H%M%S")
    return f"{stem}_{stamp}.{end}" if dot and "/" not in end else f"{path}_{stamp}"


def write_guide_graph(edges: DataFrame, matrix: DataFrame, path: str, params: dict[str, float], similar: DataFrame | None = None) -> str:
    """Edges, long matrix, similar pairs and parameters as tables below a folder;
    never overwrites. Returns the folder used."""
    spark = edges.sparkSession
    path = fresh_path(spark, path)
    edges.write.parquet(f"{path}/edges")
    matrix.write.parquet(f"{path}/matrix")
    if similar is not None:
        similar.write.parquet(f"{path}/similar")
    spark.createDataFrame([(k, float(v)) for k, v in params.items()], "name string, value double").coalesce(1).write.parquet(f"{path}/params")
    return path


def read_guide_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, dict[str, float]]:
    """``(edges, matrix, params)`` of a folder; an error if a table is missing."""
    edges, matrix = spark.read.parquet(f"{path}/edges"), spark.read.parquet(f"{path}/matrix")
    return edges, matrix, {r["name"]: r["value"] for r in spark.read.parquet(f"{path}/params").collect()}


#: Arrays that a guide-graph archive must have (fixed values).
NPZ_KEYS = ("mi_values", "feat_pairs")


def write_npz(edges: DataFrame, path: str, params: dict[str, float] | None = None, limit: int = 50_000_000) -> None:
    """Edges ``(src, dst, w)`` over integer ids as one NumPy archive, strongest
    first, in any file system that Spark writes to. An archive passes through the
    driver, so the edges are counted first and more than ``limit`` are refused."""
    n = edges.limit(limit + 1).count()
    if n > limit:
        raise ValueError(f"more than {limit} edges do not go into one archive")
    got = edges.orderBy(F.desc("w"), "src", "dst").toPandas()
    extra = {k: np.array([v], float) for k, v in (params or {}).items()}
    archive = io.BytesIO()
    np.savez_compressed(archive, mi_values=got["w"].to_numpy(float), feat_pairs=got[["src", "dst"]].to_numpy(np.int64).reshape(-1, 2), **extra)
    spark = edges.sparkSession
    target = spark._jvm.org.apache.hadoop.fs.Path(path if path.endswith(".npz") else f"{path}.npz")
    out = target.getFileSystem(spark._jsc.hadoopConfiguration()).create(target, True)
    try:
        whole = archive.getbuffer()
        for i in range(0, len(whole), 8 << 20):
            out.write(bytes(whole[i : i + (8 << 20)]))
    finally:
        out.close()


def read_npz(spark: SparkSession, path: str, chunk: int = 1_000_000) -> DataFrame:
    """``(npz_id, u, v, w)`` of all archives that a path or glob names, each read
    in one task, in pieces. An archive without a required array is an error; pickled
    content is refused."""
    names = spark.read.format("binaryFile").load(path).select("path", "content")

    def read(parts):  # noqa: ANN001, ANN202
        for p in parts:
            for f, content in zip(p["path"], p["content"]):
                with np.load(io.BytesIO(content), allow_pickle=False) as z:
                    missing = [k for k in NPZ_KEYS if k not in z.files]
                    if missing:
                        raise KeyError(f"{f} lacks {missing}")
                    w, pairs = z["mi_values"], z["feat_pairs"]
                name = f.rpartition("/")[2].removesuffix(".npz")
                for i in range(0, len(w), chunk):
                    yield pd.DataFrame({"npz_id": name, "u": pairs[i : i + chunk, 0].astype("int64"), "v": pairs[i : i + chunk, 1].astype("int64"), "w": w[i : i + chunk].astype(float)})

    return names.mapInPandas(read, "npz_id string, u long, v long, w double")


def read_npz_matrix(spark: SparkSession, path: str) -> DataFrame:
    """``(npz_id, feat, vec)`` of an archive's ``processed_mat``, rows keyed by
    ``mat_feat_indices`` (or their place without it)."""
    names = spark.read.format("binaryFile").load(path).select("path", "content")

    def read(parts):  # noqa: ANN001, ANN202
        for p in parts:
            for f, content in zip(p["path"], p["content"]):
                with np.load(io.BytesIO(content), allow_pickle=False) as z:
                    m = z["processed_mat"]
                    ids = z["mat_feat_indices"] if "mat_feat_indices" in z.files else np.arange(len(m))
                yield pd.DataFrame({"npz_id": f.rpartition("/")[2].removesuffix(".npz"), "feat": ids.astype("int64"), "vec": list(m.astype(float))})

    return names.mapInPandas(read, "npz_id string, feat long, vec array<double>")


def latest(spark: SparkSession, pattern: str) -> str:
    """The alphabetically last path that a glob names; an error without one."""
    row = spark.read.format("binaryFile").load(pattern).agg(F.max("path")).first()
    if row[0] is None:
        raise FileNotFoundError(pattern)
    return row[0]


def write_samples(rows: DataFrame, path: str, test_only: bool = False) -> None:
    """Sample graphs as zstd parquet, a folder per split."""
    rows = rows.where("split = 'tst'") if test_only else rows
    rows.write.partitionBy("split").option("compression", "zstd").parquet(path)


def read_samples(spark: SparkSession, path: str, split: str, shuffle_seed: int | None = None) -> DataFrame:
    """The graphs of a split, read from its folder only; in a repeatable random
    order if a seed is given."""
    rows = spark.read.parquet(path).where(F.col("split") == split).drop("split")
    return rows if shuffle_seed is None else rows.orderBy(F.xxhash64(F.lit(shuffle_seed), "obs"), "obs")


def write_network(delta: DataFrame, genes: DataFrame, path: str) -> None:
    """Edge parquet, gene CSV and a one-row summary below a folder."""
    from plexora.operators.network import delta_summary

    delta.write.parquet(f"{path}/edges")
    genes.write.option("header", True).csv(f"{path}/genes")
    delta_summary(delta).coalesce(1).write.json(f"{path}/summary")


def write_modules(modules: DataFrame, names: DataFrame, hubs: DataFrame, path: str) -> None:
    """Module and hub tables, and per module the sorted distinct names as text."""
    modules.write.parquet(f"{path}/modules")
    hubs.write.parquet(f"{path}/hubs")
    named = modules.join(names.select(F.col("idx").alias("node"), "name"), "node").select("module_id", "name").distinct()
    named.repartition("module_id").sortWithinPartitions("module_id", "name").write.partitionBy("module_id").text(f"{path}/gene_sets")


def write_hdf5(*_: object) -> None:
    """HDF5 needs a package that may be absent; the tables' form is parquet."""
    try:
        import h5py  # noqa: F401
    except ImportError as e:
        raise RuntimeError("HDF5 needs h5py; write parquet instead") from e
    raise NotImplementedError("predictions are kept as parquet tables")


def write_predictions(preds: DataFrame, path: str, run: str) -> None:
    """Predictions ``(obs, embedding, recon, logits...)`` below a run's folder."""
    preds.withColumn("run", F.lit(run)).write.mode("append").partitionBy("run").parquet(path)


def read_predictions(spark: SparkSession, path: str, run: str | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df if run is None else df.where(F.col("run") == run)


def describe(df: DataFrame) -> str:
    """The schema as a tree."""
    return df._jdf.schema().treeString()
