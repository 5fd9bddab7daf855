"""Every row against every row, block by block, for exact neighbours and distances.

The measures are defined over all pairs, so the work is quadratic; rows meet as
arrays in blocks of bounded size and only the result of a block leaves its task,
never its pairs. Meant for evaluation sets; the search for very many vectors is
approximate and lives elsewhere.
"""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a block, at most; every row is copied once for each block.
BLOCK = 4_096


def blockwise(points: DataFrame, key: str, task: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame], schema: str, block: int = BLOCK) -> DataFrame:
    """``task(asking, answering)`` for every pair of blocks of the rows."""
    n = points.count()
    # blocks enough for all cores, but not of a few rows
    k = max(1, -(-n // block), min(-(-n // 256), math.isqrt(points.sparkSession.sparkContext.defaultParallelism) + 1))
    own = F.pmod(F.xxhash64(key), F.lit(k)).cast("int")
    every = F.explode(F.sequence(F.lit(0), F.lit(k - 1)))
    cols = [F.col(c).alias(c) for c in points.columns]
    ask = points.select(*cols, own.alias("bi"), every.alias("bj")).repartition(k * k, "bi", "bj")
    answer = points.select(*cols, own.alias("bj"), every.alias("bi")).repartition(k * k, "bi", "bj")
    return ask.groupBy("bi", "bj").cogroup(answer.groupBy("bi", "bj")).applyInPandas(task, schema)


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean distances by differences, a few rows at a time."""
    out = np.empty((len(x), len(y)))
    step = max(1, 2_000_000 // max(1, y.size))
    for i in range(0, len(x), step):
        d = x[i : i + step, None, :] - y[None, :, :]
        out[i : i + step] = np.sqrt((d * d).sum(-1))
    return out


def _matrix(col: pd.Series) -> np.ndarray:
    return np.vstack([np.asarray(v, float) for v in col])


def _near_task(k: int) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    def work(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(a) and len(b):
            b = b.sort_values("node", ignore_index=True)
            d = distances(_matrix(a["vec"]), _matrix(b["vec"]))
            ids = b["node"].to_numpy()
            for n, u in enumerate(a["node"]):
                row = np.where(ids == u, np.inf, d[n])
                out.extend((u, ids[j], row[j]) for j in np.argsort(row, kind="stable")[:k] if row[j] < np.inf)
        return pd.DataFrame(out, columns=["u", "v", "d"])

    return work


def nearest_rows(points: DataFrame, k: int, block: int = BLOCK) -> DataFrame:
    """``(u, v, d)``: the ``k`` nearest rows of each row ``(node, vec)``, the smaller
    node first among equals. Rows without a vector take no part."""
    kind = dict(points.dtypes)["node"]
    rows = points.select("node", "vec").where("node is not null and vec is not null")
    near = blockwise(rows, "node", _near_task(k), f"u {kind}, v {kind}, d double", block)
    rank = F.row_number().over(Window.partitionBy("u").orderBy("d", "v"))
    return near.withColumn("r_", rank).where(F.col("r_") <= k).select("u", "v", "d")


def _sum_task(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
    out = []
    if len(a) and len(b):
        d = distances(_matrix(a["vec"]), _matrix(b["vec"]))
        ids, labels = b["obs"].to_numpy(), b["label"].to_numpy()
        own, other = a["obs"].to_numpy(), a["label"].to_numpy()
        differ = own[:, None] != ids[None, :]
        for x in pd.unique(labels):
            at = labels == x
            n = differ[:, at].sum(1)
            s = np.where(differ[:, at], d[:, at], 0).sum(1)
            out.extend(zip(own, other, [x] * len(a), s, n))
    return pd.DataFrame(out, columns=["i", "li", "lj", "s", "n"])


def label_distances(points: DataFrame, block: int = BLOCK) -> DataFrame:
    """``(i, li, lj, d)``: the mean distance of each row ``(obs, label, vec)`` to the
    other rows of every label."""
    kinds = dict(points.dtypes)
    rows = points.select("obs", "label", "vec").dropna()
    part = blockwise(rows, "obs", _sum_task, f"i {kinds['obs']}, li {kinds['label']}, lj {kinds['label']}, s double, n long", block)
    return part.groupBy("i", "li", "lj").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).where("n > 0").select("i", "li", "lj", (F.col("s") / F.col("n")).alias("d"))
