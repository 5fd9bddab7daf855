"""All-pairs normalised mutual information, maximised over sliding windows."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plexora.session import materialize

#: Bytes of a block of vectors, at most; a task holds and compares two blocks.
BLOCK_BYTES = 128 << 20
#: Pairs of blocks for each core, at least, where there are features enough.
TASKS = 2
#: Values that one step of a task bins at once.
STEP = 1 << 18


def feature_vectors(long: DataFrame) -> DataFrame:
    """``(feat, vec)``: the values of a feature in order of the observation. A
    vector has one value per observation, the unit that a kernel works on."""
    return long.groupBy("feat").agg(F.array_sort(F.collect_list(F.struct("obs", "value"))).alias("x")).select("feat", F.transform("x", lambda r: r["value"].cast("double")).alias("vec"))


def _places(n: int) -> tuple[int, int]:
    """Order statistics that stand for the median and the upper quartile."""
    return int(np.floor(0.5 * n + 0.5)) - 1, int(np.floor(0.75 * n + 0.5)) - 1


def bin_ids(values: np.ndarray, ordered: np.ndarray) -> tuple[np.ndarray, int] | None:
    """Bin of every value and the number of bins, or None where the rule finds
    fewer than 3 bins or more than values.

    The width is twice the distance from the median to the upper quartile over
    the cube root of the count; a value's bin is its rounded distance from the
    minimum less one, so the first bin is half as wide again.
    """
    n = len(ordered)
    mid, upper = _places(n)
    width = 2.0 * (ordered[upper] - ordered[mid]) / np.cbrt(float(n))
    span = ordered[-1] - ordered[0]
    if not width > 0:
        return None
    k = np.ceil(span / width)
    if not 3 <= k <= n:
        return None
    ids = np.floor((values - ordered[0]) / width + 0.5).astype(np.int64) - 1
    return np.maximum(ids, 0), int(k)


def _entropy_terms(n: int) -> np.ndarray:
    """``k log2 k`` of all counts up to ``n``."""
    k = np.arange(n + 1, dtype=float)
    k[1:] *= np.log2(k[1:])
    return k


def _mi(a: tuple[np.ndarray, int], mass: float, b: tuple[np.ndarray, int], terms: np.ndarray) -> float:
    """Normalised information of two binnings; ``mass`` is the sum of the terms
    of the first one's counts. Cells of at most 1e-7 of the rows do not count,
    which only ten million rows can bring about."""
    n = len(a[0])
    joint = np.bincount(a[0] * b[1] + b[0], minlength=a[1] * b[1])
    if n < 10_000_000:
        own = np.bincount(b[0], minlength=b[1])
        info = (terms[joint].sum() - mass - terms[own].sum()) / n + np.log2(n)
    else:
        p = joint.reshape(a[1], b[1]) / n
        pa, pb = p.sum(1), p.sum(0)
        i, j = np.nonzero(p > 1e-7)
        info = (p[i, j] * np.log2(p[i, j] / (pa[i] * pb[j]))).sum()
    return float(info / np.log2(np.sqrt(a[1] * float(b[1]))))


def _first_parts(x: np.ndarray, order: np.ndarray, spans: Sequence[tuple[int, int]], terms: np.ndarray) -> list:
    """Binning and sum of terms of the first feature in every window and the whole."""
    s = x[order]
    out = []
    for a, b in [*spans, (0, len(s))]:
        got = bin_ids(s[a:b], s[a:b])
        out.append(None if got is None else (got, float(terms[np.bincount(got[0])].sum())))
    return out


def _many_bins(cut: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """:func:`bin_ids` of every row of a matrix: ``(usable rows, ids, bins)``."""
    n = cut.shape[1]
    mid, upper = _places(n)
    part = np.partition(cut, sorted({0, mid, upper, n - 1}), axis=1)
    low = part[:, 0]
    width = 2.0 * (part[:, upper] - part[:, mid]) / np.cbrt(float(n))
    with np.errstate(divide="ignore", invalid="ignore"):
        k = np.ceil((part[:, n - 1] - low) / width)
        good = np.flatnonzero((width > 0) & (k >= 3) & (k <= n))
    ids = np.floor((cut[good] - low[good, None]) / width[good, None] + 0.5).astype(np.int64) - 1
    return good, np.maximum(ids, 0, out=ids), k[good].astype(np.int64)


def nmic_many(ys: np.ndarray, parts: list, spans: Sequence[tuple[int, int]], terms: np.ndarray) -> np.ndarray:
    """The highest information of one feature with each row of ``ys`` over the
    windows and the full range; ``ys`` and the parts of :func:`_first_parts` are
    in the order of that feature. Unusable bins count as 0."""
    best = np.full(len(ys), 0.0 if not spans else -np.inf)
    for (a, b), first in zip([*spans, (0, ys.shape[1])], parts):
        if first is None:
            np.maximum(best, 0.0, out=best)
            continue
        (ids, k1), mass = first
        n = b - a
        step = max(1, STEP // n)
        for at in range(0, len(ys), step):
            good, second, k2 = _many_bins(ys[at : at + step, a:b])
            got = np.zeros(min(step, len(ys) - at))
            if len(good) and n >= 10_000_000:
                got[good] = [_mi((ids, k1), mass, (x, int(k)), terms) for x, k in zip(second, k2)]
            elif len(good):
                # every row's table of counts behind the other in one array
                size = k1 * k2
                start = np.cumsum(size) - size
                joint = np.bincount((start[:, None] + ids[None, :] * k2[:, None] + second).ravel(), minlength=int(size.sum()))
                first2 = np.cumsum(k2) - k2
                own = np.bincount((first2[:, None] + second).ravel(), minlength=int(k2.sum()))
                info = (np.add.reduceat(terms[joint], start) - mass - np.add.reduceat(terms[own], first2)) / n + np.log2(n)
                got[good] = info / np.log2(np.sqrt(k1 * k2.astype(float)))
            np.maximum(best[at : at + step], got, out=best[at : at + step])
    return best


def nmic(y: np.ndarray, order: np.ndarray, parts: list, spans: Sequence[tuple[int, int]], terms: np.ndarray) -> float:
    """:func:`nmic_many` of a single pair."""
    return float(nmic_many(y[order][None, :], parts, spans, terms)[0])


def _pearson(a: np.ndarray, b: np.ndarray) -> float:
    da, db = a - a.mean(), b - b.mean()
    with np.errstate(invalid="ignore", divide="ignore"):
        return abs(float((da * db).sum() / (np.sqrt((da * da).sum()) * np.sqrt((db * db).sum()))))


def similar(x: np.ndarray, y: np.ndarray, order: np.ndarray, spans: Sequence[tuple[int, int]], least: float) -> bool:
    """Whether the absolute correlation of a pair exceeds ``least`` in a window
    ordered by the first feature or over the full range. An undefined window
    makes the pair dissimilar by itself; an undefined full range says nothing."""
    xs, ys = x[order], y[order]
    inner = [_pearson(xs[a:b], ys[a:b]) for a, b in spans]
    full = _pearson(xs, ys)
    top = np.nan if any(np.isnan(v) for v in inner) else max(inner, default=-np.inf)
    return bool((not np.isnan(top) and top > least) or (not np.isnan(top) and full > least))


def _blocks(count: int, width: int, cores: int, block: int | None) -> int:
    """Into how many blocks ``count`` vectors of ``width`` values are parted: as
    few as their bytes allow, since every vector is copied once for each block,
    but enough for all cores."""
    size = block or max(1, BLOCK_BYTES // (8 * max(width, 1)))
    return max(1, -(-count // size), min(count, math.isqrt(2 * TASKS * cores) + 1))


def _blocked(vectors: DataFrame, k: int) -> DataFrame:
    """Every vector once for each of the ``k`` blocks, as part of a pair of blocks.

    The pairs are spread over a fixed number of partitions: adaptive execution
    would join them by their bytes, while it is the comparisons that take the time.
    """
    own = F.pmod(F.xxhash64("feat"), F.lit(k)).cast("int")
    rows = vectors.select("feat", "vec", own.alias("own"), F.explode(F.sequence(F.lit(0), F.lit(k - 1))).alias("other"))
    out = rows.select("feat", "vec", "own", F.least("own", "other").alias("bi"), F.greatest("own", "other").alias("bj"))
    return out.repartition(k * (k + 1) // 2, "bi", "bj")


def _pair_task(spans: list[tuple[int, int]], mode: str, least: float) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("feat", ignore_index=True)
        bi, bj = int(pdf["bi"][0]), int(pdf["bj"][0])
        names, own = pdf["feat"].to_numpy(), pdf["own"].to_numpy()
        lengths = {len(v) for v in pdf["vec"]}
        if len(lengths) > 1:
            raise ValueError("every observation needs a value of every feature")
        x = np.vstack(pdf["vec"].to_numpy()).astype(float)
        terms = _entropy_terms(x.shape[1])
        src, dst, w = [], [], []
        for i in range(len(x)):
            todo = np.flatnonzero((np.arange(len(x)) > i) & ((bi == bj) | (own != own[i])))
            if not len(todo):
                continue
            order = np.argsort(x[i], kind="stable")
            if mode == "nmic":
                parts = _first_parts(x[i], order, spans, terms)
                # rows of second features, some at a time, in the order of the first
                step = max(1, 4 * STEP // x.shape[1])
                got = np.concatenate([nmic_many(x[todo[a : a + step]][:, order], parts, spans, terms) for a in range(0, len(todo), step)])
            else:
                todo = np.array([j for j in todo if similar(x[i], x[j], order, spans, least)], np.int64)
                got = np.ones(len(todo))
            src.append(np.repeat(names[i : i + 1], len(todo)))
            dst.append(names[todo])
            w.append(got)
        if not src:
            return pd.DataFrame({"src": names[:0], "dst": names[:0], "w": np.zeros(0)})
        return pd.DataFrame({"src": np.concatenate(src), "dst": np.concatenate(dst), "w": np.concatenate(w)})

    return work


def all_pairs(long: DataFrame, spans: Sequence[tuple[int, int]], mode: str = "nmic", least: float = 0.95, block: int | None = None) -> DataFrame:
    """``(src, dst, w)`` over all feature pairs ``src < dst``.

    ``mode`` ``nmic`` gives the information of every pair, ``similar`` only the
    pairs whose correlation exceeds ``least``, with ``w`` 1. Every observation
    needs a value of every feature. Vectors meet in pairs of blocks of at most
    :data:`BLOCK_BYTES` (or ``block`` features), so no task holds more than two
    blocks, a vector is copied once for each block, and nothing is broadcast; the
    number of tasks grows with the square of the features, as the work does.
    """
    kind = dict(long.dtypes)["feat"]
    vectors = materialize(feature_vectors(long), "vectors")
    head = vectors.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vec")).alias("width")).first()
    cores = vectors.sparkSession.sparkContext.defaultParallelism
    blocked = _blocked(vectors, _blocks(head["n"], head["width"] or 0, cores, block))
    task = _pair_task([(int(a), int(b)) for a, b in spans], mode, least)
    return blocked.groupBy("bi", "bj").applyInPandas(task, f"src {kind}, dst {kind}, w double")


def without_redundant(long: DataFrame, spans: Sequence[tuple[int, int]], least: float = 0.95) -> tuple[DataFrame, DataFrame]:
    """``(kept long, similar pairs)``: of each similar pair the first feature is
    removed, whether or not another pair removed the second."""
    pairs = materialize(all_pairs(long, spans, "similar", least).select("src", "dst"), "similar")
    return long.join(pairs.select(F.col("src").alias("feat")).distinct(), "feat", "left_anti"), pairs


def above(edges: DataFrame, least: float, drop_last: bool = False) -> DataFrame:
    """Edges with ``w > least`` in falling order; ``drop_last`` leaves out the
    weakest of them, as the compatible mode does."""
    kept = edges.where(F.col("w") > least)
    if drop_last:
        weakest = kept.orderBy("w", F.desc("src"), F.desc("dst")).limit(1).select("src", "dst")
        kept = kept.join(F.broadcast(weakest), ["src", "dst"], "left_anti")
    return kept.orderBy(F.desc("w"), "src", "dst")
