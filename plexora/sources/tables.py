"""Readers for labels, feature lists and run files; discovery by file name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plexora.operators.reshape import BATCH_NAMES, CLASS_NAMES, OBS_NAMES


def label_csv(spark: SparkSession, path: str) -> DataFrame:
    """A label file's first two columns as ``(bc, ct)``; further ones are dropped."""
    df = spark.read.csv(path, header=True, inferSchema=False)
    return df.select(F.col(df.columns[0]).alias("bc"), F.col(df.columns[1]).alias("ct"))


def feature_csv(spark: SparkSession, path: str) -> DataFrame:
    """``(feat)``: the first column of a CSV file, as text."""
    if not path.endswith(".csv"):
        raise ValueError("a feature list is a .csv file")
    df = spark.read.csv(path, header=True, inferSchema=False)
    return df.select(F.col(df.columns[0]).alias("feat")).where("feat is not null")


def cell_type_csv(spark: SparkSession, path: str) -> DataFrame:
    """``(obs, label)`` of a CSV file whose columns go by one of the known names."""
    df = spark.read.csv(path, header=True, inferSchema=False)
    obs = next((c for c in OBS_NAMES if c in df.columns), None)
    cls = next((c for c in CLASS_NAMES if c in df.columns), None)
    if obs is None or cls is None:
        raise ValueError("no observation or class column")
    return df.select(F.col(obs).alias("obs"), F.col(cls).alias("label"))


def attach_labels(obs: DataFrame, labels: DataFrame, key: str, unknown: str = "Unknown") -> DataFrame:
    """``obs`` with ``label``: the first label of its key, ``unknown`` without one."""
    value = next(c for c in labels.columns if c != key)
    one = labels.where(F.col(value).isNotNull()).groupBy(key).agg(F.min(value).alias("label"))
    return obs.join(one, key, "left").withColumn("label", F.coalesce("label", F.lit(unknown)))


def batch_column(df: DataFrame) -> str:
    """The first batch column that the table has."""
    for c in BATCH_NAMES:
        if c in df.columns:
            return c
    raise ValueError("no batch column")


def file_names(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """``(path)`` of the files below a folder; their contents are not read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("path")


def prediction_files(files: DataFrame, task: str | None = None, split: str | None = None) -> DataFrame:
    """``(fname, seed, seed_num, task, split, path)`` of prediction files named
    ``<x>+seed_<n>+<task>+<split>.h5`` (or without ``<x>+``). Hidden files, other
    endings and other forms are skipped."""
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    parts = F.split(F.regexp_replace("fname", r"\.h5$", ""), r"\+")
    p = files.select(name.alias("fname"), "path").where(F.endswith("fname", F.lit(".h5")) & ~F.startswith("fname", F.lit("."))).withColumn("p", parts)
    p = p.where(F.size("p").isin(3, 4)).withColumn("p", F.slice("p", -3, 3))
    out = p.select("fname", F.get("p", F.lit(0)).alias("seed"), F.regexp_extract(F.get("p", F.lit(0)), r"^seed_(-?[0-9]+)$", 1).try_cast("int").alias("seed_num"), F.get("p", F.lit(1)).alias("task"), F.get("p", F.lit(2)).alias("split"), "path")
    if task is not None:
        out = out.where(F.col("task") == task)
    return out if split is None else out.where(F.col("split") == split)


def first_per_seed(files: DataFrame) -> DataFrame:
    """``(seed, path)``: the first path of each seed."""
    return files.groupBy("seed").agg(F.min("path").alias("path"))


def best_checkpoint(files: DataFrame, group: str | None = None) -> DataFrame:
    """``(path, val_loss)``: the file with the lowest ``val_loss=`` in its name, a
    name without one counting as infinite, the first path among equals."""
    loss = F.regexp_extract("path", r"val_loss=([0-9]*\.?[0-9]+(?:[eE][-+]?[0-9]+)?)", 1).try_cast("double")
    f = files.withColumn("val_loss", F.coalesce(loss, F.lit(float("inf"))))
    best = F.min(F.struct("val_loss", "path")).alias("b")
    out = (f.groupBy(group) if group else f.groupBy()).agg(best)
    return out.select(*([group] if group else []), "b.path", "b.val_loss").where("path is not null")


def done_keys(done: DataFrame, todo: DataFrame, key: str) -> DataFrame:
    """Rows of ``todo`` whose key is not done yet, for resuming."""
    return todo.join(done.select(key).distinct(), key, "left_anti")


def run_logs(spark: SparkSession, path: str) -> DataFrame:
    """Scalars of JSON run logs ``.../<data>/<seed>/<task>/<log>.json`` with the
    parts of their path; logs may have different columns."""
    df = spark.read.option("recursiveFileLookup", "true").json(path)
    p = F.split(F.input_file_name(), "/")
    return df.select("*", *(F.element_at(p, -i).alias(n) for i, n in ((4, "data"), (3, "seed"), (2, "task"))), F.regexp_replace(F.element_at(p, -1), r"\.json$", "").alias("log_name"))


def best_trials(trials: DataFrame, study: str, value: str, params: str) -> DataFrame:
    """``(study, best_value, best_params, n_trials)``: the lowest finite value."""
    ok = trials.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    return ok.groupBy(study).agg(F.min(value).alias("best_value"), F.min_by(params, F.struct(F.col(value), F.col(params))).alias("best_params"), F.count(F.lit(1)).alias("n_trials"))


def study_databases(spark: SparkSession, path: str) -> DataFrame:
    """``(study, trial, value, start, complete)`` of completed trials in the SQLite
    files below a folder, wherever Spark reads it from."""
    import pandas as pd

    def read(parts):  # noqa: ANN001, ANN202
        import sqlite3

        for p in parts:
            out = []
            for content in p["content"]:
                con = sqlite3.connect(":memory:")
                con.deserialize(content)
                q = "SELECT s.study_name, t.number, v.value, t.datetime_start, t.datetime_complete FROM trials t JOIN studies s USING (study_id) JOIN trial_values v USING (trial_id) WHERE t.state = 'COMPLETE'"
                out += con.execute(q).fetchall()
                con.close()
            yield pd.DataFrame(out, columns=["study", "trial", "value", "start", "complete"]).astype({"start": str, "complete": str})

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.db").load(path).select("content")
    return files.mapInPandas(read, "study string, trial int, value double, start string, complete string")
