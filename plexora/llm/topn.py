"""The N highest-scoring items of every group, by skipping on file statistics."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plexora.session import materialize, scratch_path

#: Bytes of a row group: about ten thousand rows of the clustered table.
ROW_GROUP_BYTES = 256 << 10
#: Rows that one clustered file is meant to hold.
FILE_ROWS = 500_000


def unordered_pairs(df: DataFrame, run: str, u: str, v: str, w: str) -> DataFrame:
    """``(run_, a_, b_, w_)``, a < b: the highest score of each unordered pair of
    a run. Rows with a null or NaN value, a negative index or equal ends are
    not used; repeats collapse on the map side."""
    x, y, s = F.col(u).cast("long"), F.col(v).cast("long"), F.col(w).cast("double")
    ok = F.col(run).isNotNull() & (x >= 0) & (y >= 0) & (x != y) & s.isNotNull() & ~F.isnan(s)
    # a zero with a sign would order as another score
    return (
        df.where(ok)
        .select(F.col(run).alias("run_"), F.least(x, y).alias("a_"), F.greatest(x, y).alias("b_"), (s + F.lit(0.0)).alias("s_"))
        .groupBy("run_", "a_", "b_")
        .agg(F.max("s_").alias("w_"))
    )


def _open(path: str):  # noqa: ANN202
    import pyarrow.parquet as pq
    from pyarrow import fs

    where, name = fs.FileSystem.from_uri(path.replace("s3a://", "s3://", 1))
    return pq.ParquetFile(where.open_input_file(name))


def _statistics() -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            out = []
            for path in p["path"]:
                meta = _open(path).metadata
                names = [meta.schema.column(i).name for i in range(meta.num_columns)]
                for g in range(meta.num_row_groups):
                    rg = meta.row_group(g)
                    st = {n: rg.column(i).statistics for i, n in enumerate(names)}
                    whole = all(s is not None and s.has_min_max for s in st.values())
                    lo = {n: st[n].min if whole else None for n in st}
                    hi = {n: st[n].max if whole else None for n in st}
                    single = whole and lo["run_"] == hi["run_"] and lo["item_"] == hi["item_"]
                    out.append((path, g, rg.num_rows, single, lo["run_"] if single else None, lo["item_"] if single else None, lo["w_"], hi["w_"], lo["other_"], hi["other_"]))
            yield pd.DataFrame(out, columns=["path", "rg", "n", "single", "run_", "item_", "w_lo", "w_hi", "o_lo", "o_hi"]).astype({"item_": "Int64", "o_lo": "Int64", "o_hi": "Int64"})

    return read


def _reader(n: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Reads the planned row groups of each file in descending maximum score and
    passes those strictly below the current N-th score of their only group."""

    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            for path, groups in zip(p["path"], p["groups"]):
                file, nth = _open(path), {}
                for g in sorted(groups, key=lambda g: (-g["w_hi"] if g["w_hi"] is not None else float("-inf"), g["rg"])):
                    key = (g["run_"], g["item_"])
                    if g["single"] and key in nth and g["w_hi"] < nth[key]:
                        continue
                    t = file.read_row_group(g["rg"], columns=["run_", "item_", "other_", "w_"]).to_pandas()
                    # rows lie in order of run, item, falling score and rising partner
                    rank = t.groupby(["run_", "item_"], sort=False).cumcount()
                    top = t[rank < n]
                    if g["single"] and len(top) == n:
                        nth[key] = max(nth.get(key, float("-inf")), float(top["w_"].iloc[-1]))
                    yield top

    return read


def clustered(pairs: DataFrame, file_rows: int = FILE_ROWS) -> str:
    """Write both sides of every pair clustered by group: files and row groups in
    order of run, item, falling score and rising partner. The score is part of
    the range key, so one item with a third of all rows spans many files."""
    spark = pairs.sparkSession
    sides = pairs.select(
        "run_",
        F.explode(F.array(F.struct(F.col("a_").alias("item_"), F.col("b_").alias("other_")), F.struct(F.col("b_").alias("item_"), F.col("a_").alias("other_")))).alias("e"),
        "w_",
    ).select("run_", "e.item_", "e.other_", "w_")
    files = max(1, -(-2 * pairs.count() // file_rows))
    order = ["run_", "item_", F.desc("w_"), "other_"]
    path = scratch_path(spark, "clustered")
    sides.repartitionByRange(files, *order).sortWithinPartitions(*order).write.option("parquet.block.size", ROW_GROUP_BYTES).option("parquet.block.size.row.check.min", 1000).parquet(path)
    return path


def planned_groups(path: str, spark, n: int) -> DataFrame:  # noqa: ANN001
    """Row groups that may hold a top-``n`` row, from their statistics alone.

    For a group with rows in many row groups, the first ones in falling score
    that hold ``n`` rows bound its N-th score from below; a later row group is
    skipped when its maximum is strictly below that bound, or equals it while
    all its partners come after those already counted. Row groups of several
    groups, or without statistics, are always read.
    """
    names = spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").load(path).select("path")
    stats = names.mapInPandas(
        _statistics(), "path string, rg int, n long, single boolean, run_ string, item_ long, w_lo double, w_hi double, o_lo long, o_hi long"
    )
    stats = materialize(stats, "stats")
    w = Window.partitionBy("run_", "item_")
    line = w.orderBy(F.desc("w_hi"), F.desc("w_lo"), "o_lo").rowsBetween(Window.unboundedPreceding, 0)
    reach = F.when(F.col("cum") >= n, F.struct(F.col("w_lo").alias("w"), (-F.col("o_hi")).alias("o")))
    single = (
        stats.where("single")
        .withColumn("cum", F.sum("n").over(line))
        .withColumn("first", F.max(F.when(F.col("cum") - F.col("n") < n, reach)).over(w))
    )
    later = F.col("cum") - F.col("n") >= n
    below = (F.col("w_hi") < F.col("first.w")) | ((F.col("w_hi") == F.col("first.w")) & (F.col("o_lo") > -F.col("first.o")))
    return single.where(~(later & F.coalesce(below, F.lit(False)))).select(*stats.columns).union(stats.where("not single"))


def top_items(df: DataFrame, run: str, u: str, v: str, w: str, n: int = 3, file_rows: int = FILE_ROWS) -> DataFrame:
    """``(run_, item_, other_, w_, rank_)``: of every item of a run, on either
    side of its pairs, the ``n`` partners of highest score, the smaller partner
    first among equals; fewer where it has fewer."""
    pairs = materialize(unordered_pairs(df, run, u, v, w), "pairs")
    path = clustered(pairs, file_rows)
    spark = df.sparkSession
    planned = planned_groups(path, spark, n)
    per_file = planned.groupBy("path").agg(F.collect_list(F.struct("rg", "single", "run_", "item_", "w_hi")).alias("groups"))
    tasks = max(spark.sparkContext.defaultParallelism, min(10_000, -(-2 * pairs.count() // file_rows)))
    part = per_file.repartition(tasks, "path").mapInPandas(_reader(n), "run_ string, item_ long, other_ long, w_ double")
    rank = F.row_number().over(Window.partitionBy("run_", "item_").orderBy(F.desc("w_"), "other_"))
    return part.withColumn("rank_", rank).where(F.col("rank_") <= n)


def kept_pairs(top: DataFrame) -> DataFrame:
    """``(run_, a_, b_)``, a < b: pairs that at least one of their items keeps."""
    return top.select("run_", F.least("item_", "other_").alias("a_"), F.greatest("item_", "other_").alias("b_")).distinct()
