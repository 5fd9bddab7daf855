"""The most similar vectors of every vector: inverted lists, product-quantised
residuals, asymmetric distances and exact reranking."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plexora.session import materialize, small_side

#: Vectors the index is fitted on, at most; every vector is indexed.
SAMPLE = 131_072
#: Rows of the sample that the codebooks of the residuals are fitted on, at most.
CODEBOOK_SAMPLE = 32_768
#: Coarse centroids, at most (4,096 x 64 floats are one megabyte). Where more
#: lists are wanted, a second level parts every centroid's list further.
MAX_LISTS = 4_096
#: Neighbouring centroids whose lists are searched by one task, about.
GROUP = 16
#: Members and queries that one task compares at once, at most.
BLOCK = 32_768
_SUBSPACES, _CODES = 16, 256


@dataclass(frozen=True)
class Index:
    """Coarse centroids, centroids of their residuals (the second level, one
    zero where a single level suffices), the group of every coarse centroid and
    one codebook per subspace of what the two leave. List ``c * len(fine) + f``
    has the centre ``coarse[c] + fine[f]``."""

    coarse: np.ndarray
    fine: np.ndarray
    group: np.ndarray
    books: np.ndarray
    probes: int
    rerank: int

    def centres(self, lists: np.ndarray) -> np.ndarray:
        return self.coarse[lists // len(self.fine)] + self.fine[lists % len(self.fine)]

    def groups(self, lists: np.ndarray) -> np.ndarray:
        return self.group[lists // len(self.fine)]

    def nearest_lists(self, x: np.ndarray, k: int) -> np.ndarray:
        """Row by row the ``k`` lists with the nearest centres, nearest first."""
        near = nearest(x, self.coarse, k)
        r = len(self.fine)
        if r == 1:
            return near
        out = np.empty((len(x), min(k, near.shape[1] * r)), np.int32)
        for i in range(0, len(x), 1024):
            part = near[i : i + 1024]
            rest = x[i : i + 1024, None, :] - self.coarse[part]
            d = ((rest * rest).sum(2)[:, :, None] - 2 * rest @ self.fine.T + (self.fine * self.fine).sum(1)).reshape(len(part), -1)
            top = np.argpartition(d, out.shape[1] - 1, axis=1)[:, : out.shape[1]]
            top = np.take_along_axis(top, np.take_along_axis(d, top, 1).argsort(1, kind="stable"), 1)
            out[i : i + 1024] = np.take_along_axis(part, top // r, 1) * r + top % r
        return out


def usable_vectors(df: DataFrame, key: str, vec: str, dim: int) -> DataFrame:
    """``(id_, vec_)`` of vectors with ``dim`` finite values, not all zero. Rows
    with null ids or vectors, other lengths, null, NaN or infinite values take
    no part."""
    v = F.col(vec).cast("array<float>")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = F.exists(v, lambda x: x != 0)
    # + 0.0 turns a negative zero into a plain one, so that equal vectors group
    plus = F.transform(v, lambda x: x + F.lit(0.0).cast("float"))
    return df.where(F.col(key).isNotNull() & F.col(vec).isNotNull() & (F.size(v) == dim) & ~bad & some).select(
        F.col(key).cast("long").alias("id_"), plus.alias("vec_")
    )


def kmeans(x: np.ndarray, k: int, rounds: int, rng: np.random.RandomState) -> np.ndarray:
    """Plain Lloyd iterations; an empty cluster takes a random row."""
    if len(x) <= k:
        return x.copy()
    c = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        at = nearest(x, c, 1)[:, 0]
        order = np.argsort(at, kind="stable")
        starts = np.searchsorted(at[order], np.arange(k))
        count = np.bincount(at, minlength=k)
        sums = np.add.reduceat(np.vstack([x[order], np.zeros((1, x.shape[1]), x.dtype)]), starts, axis=0)
        full = count > 0
        c[full] = sums[full] / count[full, None]
        c[~full] = x[rng.randint(len(x), size=int((~full).sum()))]
    return c


def nearest(x: np.ndarray, c: np.ndarray, k: int) -> np.ndarray:
    """Row by row the ``k`` nearest centroids, nearest first."""
    k = min(k, len(c))
    out = np.empty((len(x), k), np.int32)
    half = (c * c).sum(1) / 2
    for i in range(0, len(x), 4096):
        d = half[None, :] - x[i : i + 4096] @ c.T
        if k == 1:
            out[i : i + 4096, 0] = d.argmin(1)
            continue
        top = np.argpartition(d, k - 1, axis=1)[:, :k]
        out[i : i + 4096] = np.take_along_axis(top, np.take_along_axis(d, top, 1).argsort(1, kind="stable"), 1)
    return out


def _unit(v: np.ndarray) -> np.ndarray:
    x = v.astype(np.float64)
    return (x / np.sqrt((x * x).sum(1))[:, None]).astype(np.float32)


def _stack(col: pd.Series, dim: int) -> np.ndarray:
    return np.concatenate(col.to_numpy()).astype(np.float32).reshape(-1, dim) if len(col) else np.zeros((0, dim), np.float32)


def fit(vectors: DataFrame, n: int, dim: int, probes: int, rerank: int, seed: int = 11) -> Index:
    """Fit the index on a hashed sample of at most :data:`SAMPLE` vectors, as many
    as the driver holds in 32 megabytes."""
    keep = min(1.0, SAMPLE / max(n, 1))
    cut = int(keep * 0.95 * (1 << 30)) if keep < 1 else 1 << 30
    part = vectors.where(F.pmod(F.xxhash64("id_", F.lit(seed)), F.lit(1 << 30)) < cut).select("id_", "vec_").limit(SAMPLE)
    got = part.toPandas().sort_values("id_", ignore_index=True)
    x = _unit(_stack(got["vec_"], dim))
    rng = np.random.RandomState(seed)
    # about half the square root of the rows
    wanted = int(2 ** round(np.log2(max(np.sqrt(n) / 2, 1))))
    lists = int(np.clip(wanted, 1, min(MAX_LISTS, max(1, len(x) // 24))))
    coarse = kmeans(x, lists, 12, rng)
    groups = -(-len(coarse) // GROUP)
    group = nearest(coarse, kmeans(coarse, groups, 12, rng), 1)[:, 0]
    x = x[rng.permutation(len(x))[:CODEBOOK_SAMPLE]]
    rest = x - coarse[nearest(x, coarse, 1)[:, 0]]
    levels = wanted // lists if lists == MAX_LISTS else 1
    fine = kmeans(rest, levels, 12, rng) if levels > 1 else np.zeros((1, dim), np.float32)
    rest = rest - fine[nearest(rest, fine, 1)[:, 0]]
    sub = dim // _SUBSPACES
    books = np.zeros((_SUBSPACES, _CODES, sub), np.float32)
    for m in range(_SUBSPACES):
        c = kmeans(rest[:, m * sub : (m + 1) * sub], _CODES, 8, rng)
        books[m, : len(c)] = c
        books[m, len(c) :] = np.inf
    return Index(coarse, fine, group, books, min(probes, len(coarse) * len(fine)), rerank)


def _encoder(ix: Index, dim: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    def encode(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sub = dim // _SUBSPACES
        for p in parts:
            x = _unit(_stack(p["vec_"], dim))
            near = ix.nearest_lists(x, ix.probes)
            rest = x - ix.centres(near[:, 0])
            codes = np.empty((len(x), _SUBSPACES), np.uint8)
            for m in range(_SUBSPACES):
                b = ix.books[m]
                b = b[np.isfinite(b[:, 0])]
                codes[:, m] = nearest(rest[:, m * sub : (m + 1) * sub], b, 1)[:, 0]
            yield pd.DataFrame({"id_": p["id_"], "vec_": p["vec_"], "asks_": p["asks_"], "code_": [c.tobytes() for c in codes], "near_": list(near), "groups_": list(ix.groups(near))})

    return encode


def _first(sims: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Similarities and ids of the ``k`` most similar of each row, the smaller id
    first among equals; ``ids`` ascend along the last axis, a row's own id comes last."""
    ids = np.broadcast_to(ids, sims.shape)
    sims = np.where(ids == own[:, None], -np.inf, np.clip(sims, -1, 1).round(12))
    n = sims.shape[1]
    if n > 4 * k:
        # whole numbers that order by similarity, then place: no two are equal
        place = np.where(np.isinf(sims), 2e12, -sims * 1e12).round().astype(np.int64) * n + np.arange(n)
        some = np.sort(np.argpartition(place, k - 1, axis=1)[:, :k], 1)
        sims, ids = np.take_along_axis(sims, some, 1), np.take_along_axis(ids, some, 1)
    order = np.argsort(-sims, axis=1, kind="stable")[:, :k]
    return np.take_along_axis(sims, order, 1), np.take_along_axis(ids, order, 1)


def _searcher(ix: Index, dim: int, k: int) -> Callable[[tuple, pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    empty = pd.DataFrame({"id_": pd.Series([], dtype="int64"), "ids": [], "sims": []})

    def units(col: pd.Series) -> np.ndarray:
        v = _stack(col, dim).astype(np.float64)
        return v / np.sqrt((v * v).sum(1))[:, None]

    def search(key: tuple, queries: pd.DataFrame, members: pd.DataFrame) -> pd.DataFrame:
        if queries.empty or members.empty:
            return empty
        sub = dim // _SUBSPACES
        members = members.sort_values(["list_", "id_"], ignore_index=True)
        mid, of_list = members["id_"].to_numpy(np.int64), members["list_"].to_numpy(np.int64)
        mv = units(members["vec_"])
        codes = np.frombuffer(b"".join(members["code_"]), np.uint8).reshape(-1, _SUBSPACES)
        # a product with the decoded members sums the entries of the asymmetric distance tables
        approx = np.concatenate([np.where(np.isfinite(ix.books[m]), ix.books[m], 0)[codes[:, m]] for m in range(_SUBSPACES)], 1) + ix.centres(of_list)
        half = (approx * approx).sum(1) / 2
        names, starts = np.unique(of_list, return_index=True)
        ends = np.r_[starts[1:], len(of_list)]
        qid = queries["id_"].to_numpy(np.int64)
        near = np.stack(queries["near_"].to_numpy())
        wide = ix.rerank + 1
        out_i, out_s = [], []
        # queries of the same lists side by side, so that a list is compared in large products
        order = np.lexsort(near[:, :2].T)
        for i in range(0, len(qid), 1024):
            rows = order[i : i + 1024]
            q, own, lists = units(queries["vec_"].iloc[rows]), qid[rows], near[rows]
            q32 = q.astype(np.float32)
            picked = [np.zeros((len(rows), 0), np.int64)]
            dist = [np.zeros((len(rows), 0), np.float32)]
            for name, a, b in zip(names, starts, ends):
                who = np.flatnonzero((lists == name).any(1))
                if not len(who):
                    continue
                n = b - a
                idx = np.full((len(rows), min(n, wide)), -1, np.int64)
                far = np.full(idx.shape, np.inf, np.float32)
                if n <= wide:
                    idx[who], far[who] = np.arange(a, b), half[a:b] - q32[who] @ approx[a:b].T
                else:
                    d = half[a:b] - q32[who] @ approx[a:b].T
                    cand = np.argpartition(d, wide - 1, axis=1)[:, :wide]
                    near_d = np.take_along_axis(d, cand, 1)
                    last = near_d.max(1)
                    idx[who], far[who] = cand + a, near_d
                    # more members at the cut than fit: codes cannot tell them apart, so the
                    # whole list is compared exactly and its best come first
                    full = (d <= (last + 1e-6 * (1 + np.abs(last)))[:, None]).sum(1) > wide
                    for w in who[full]:
                        sims, ids = _first(q[w : w + 1] @ mv[a:b].T, mid[a:b], own[w : w + 1], k)
                        ids = ids[0][sims[0] > -np.inf]
                        idx[w], far[w] = -1, np.inf
                        idx[w, : len(ids)] = a + np.searchsorted(mid[a:b], ids)
                        far[w, : len(ids)] = -np.inf
                picked.append(idx)
                dist.append(far)
            idx, far = np.concatenate(picked, 1), np.concatenate(dist, 1)
            if not idx.shape[1]:
                continue
            if idx.shape[1] > wide:
                top = np.argpartition(far, wide - 1, axis=1)[:, :wide]
                top_d = np.take_along_axis(far, top, 1)
                last = top_d.max(1)
                with np.errstate(invalid="ignore"):
                    crowd = (far <= (last + 1e-6 * (1 + np.abs(last)))[:, None]).sum(1) > wide
                crowd = (crowd & np.isfinite(last)) | ((far == -np.inf).sum(1) > wide)
            else:
                top, crowd = np.broadcast_to(np.arange(idx.shape[1]), idx.shape), np.zeros(len(rows), bool)
            # exact cosines of the candidates; of all of them where the cut parts equals
            for part, cols in ((~crowd, top), (crowd, None)):
                if not part.any():
                    continue
                cand = idx[part] if cols is None else np.take_along_axis(idx[part], cols[part], 1)
                # in order of the id, absent ones last
                ids = np.where(cand < 0, np.iinfo(np.int64).max, mid[cand])
                by_id = ids.argsort(1, kind="stable")
                cand, ids = np.take_along_axis(cand, by_id, 1), np.take_along_axis(ids, by_id, 1)
                sims = np.einsum("qd,qcd->qc", q[part], mv[cand])
                sims[cand < 0] = -np.inf
                for r, s, t in zip(own[part], *_first(sims, ids, own[part], k)):
                    good = s > -np.inf
                    out_i.append((r, t[good]))
                    out_s.append(s[good])
        return pd.DataFrame({"id_": pd.Series([r for r, _ in out_i], dtype="int64"), "ids": [t for _, t in out_i], "sims": out_s})

    return search


def _cosine(a: str, b: str) -> Column:
    def dot(x: str, y: str) -> Column:
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda t, z: t + z)

    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def similar(df: DataFrame, key: str, vec: str, k: int = 10, dim: int = 64, probes: int = 24, rerank: int = 48, queries: str | None = None) -> DataFrame:
    """``(id_, nbr_, sim_, rank_)``: the ``k`` most similar rows of every row by
    cosine, the smaller id first among equals; fewer where the table is smaller.

    Unusable vectors (see :func:`usable_vectors`) neither ask nor answer. Of
    copies, at whatever length, only the ``k + 1`` smallest ids ask; every
    further copy has the same first ``k`` as the last of these and takes them
    over. All copies answer: a row beside them ranks them by the last digits
    that scaling left. ``queries`` (an SQL predicate on ``id_``) limits the
    rows that ask, never the rows that answer. Recall is set by ``probes`` and
    ``rerank``; with as many probes as lists the search is exact.

    The lists of neighbouring centroids form a group, which a query visits once
    for all of its lists there. Members and queries of a group meet in blocks of
    at most :data:`BLOCK` x :data:`BLOCK`, so a list with a third of all rows is
    many tasks.
    """
    rows = usable_vectors(df, key, vec, dim)
    # lengths apart, copies meet in one cell of a fine grid; one that rounding parts forms a further group
    length = F.sqrt(F.aggregate("vec_", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    # bound by an outer transform, the length is computed once a row, not once a value
    cell = F.transform(F.array(length), lambda n: F.transform("vec_", lambda x: F.floor(x.cast("double") / n * 1e5 + 0.5)))
    rows = materialize(rows.select("id_", "vec_", F.xxhash64(cell).alias("cell_")), "members")
    n = rows.count()
    ask = F.expr(queries) if queries else F.lit(True)
    if n == 0:
        return rows.select("id_", F.col("id_").alias("nbr_"), F.lit(0.0).alias("sim_"), F.lit(1).alias("rank_")).limit(0)
    by_cell = ["cell_"]
    big = materialize(rows.groupBy(*by_cell).agg(F.count(F.lit(1)).alias("c_")).where(F.col("c_") > k + 1).select(*by_cell), "cells")
    crowd = rows.join(small_side(big), by_cell)
    heads = materialize(crowd.groupBy(*by_cell).agg(F.min_by("vec_", "id_").alias("head_")), "heads")
    # a cell may hold more than copies: only rows at cosine 1 with its first row are a group
    copies = crowd.join(small_side(heads), by_cell).where(_cosine("vec_", "head_") >= 1 - 1e-13).select("id_", *by_cell)
    rank = F.row_number().over(Window.partitionBy(*by_cell).orderBy("id_"))
    # rank <= k + 1 is cut on the map side, before the shuffle
    firsts = copies.withColumn("copy_", rank).where(F.col("copy_") <= k + 1)
    lasts = materialize(firsts.groupBy(*by_cell).agg(F.max("id_").alias("last_"), F.count(F.lit(1)).alias("c_")).where(F.col("c_") == k + 1).select(*by_cell, "last_"), "lasts")
    further = materialize(copies.join(small_side(lasts), by_cell).where(F.col("id_") > F.col("last_")).select("id_", "last_"), "further")
    state = rows.select("id_", "vec_").join(small_side(further.select("id_", F.lit(True).alias("further_"))), "id_", "left")
    state = state.join(small_side(lasts.select(F.col("last_").alias("id_"), F.lit(True).alias("leads_"))), "id_", "left")
    asking = (ask | F.col("leads_").isNotNull()) & F.col("further_").isNull()
    members = materialize(state.select("id_", "vec_", F.coalesce(asking, F.lit(False)).alias("asks_"), F.col("further_").isNull().alias("fits_")), "state")
    fitted = members.where("fits_").select("id_", "vec_")
    ix = fit(fitted, fitted.count(), dim, probes, rerank)
    kinds = "id_ long, vec_ array<float>, asks_ boolean, code_ binary, near_ array<int>, groups_ array<int>"
    coded = members.select("id_", "vec_", "asks_").mapInPandas(_encoder(ix, dim), kinds)
    coded = materialize(coded.withColumn("group_", F.get("groups_", F.lit(0))), "coded")
    visited = F.explode(F.array_distinct("groups_"))
    # members and visits of each group: at most MAX_LISTS / GROUP rows
    cores = df.sparkSession.sparkContext.defaultParallelism
    least = -(-2 * cores // (int(ix.group.max()) + 1))  # blocks enough for all cores
    parts = lambda few: F.greatest(F.floor((F.count(F.lit(1)) - 1) / BLOCK) + 1, F.least(F.lit(few), F.floor(F.count(F.lit(1)) / 512) + 1)).cast("int")
    sizes = coded.groupBy("group_").agg(parts(1).alias("m_"))
    visits = coded.where("asks_").select(visited.alias("group_")).groupBy("group_").agg(parts(least).alias("q_"))
    grid = small_side(materialize(sizes.join(visits, "group_"), "groups"), MAX_LISTS)
    asks = (
        coded.where("asks_")
        .select("id_", "vec_", "near_", visited.alias("group_"))
        .join(grid, "group_")
        .select("id_", "vec_", "near_", "group_", F.pmod(F.xxhash64("id_"), F.col("q_")).cast("int").alias("qb_"), F.explode(F.sequence(F.lit(0), F.col("m_") - 1)).alias("mb_"))
    )
    answers = (
        coded.select("id_", "vec_", "code_", F.get("near_", F.lit(0)).alias("list_"), "group_")
        .join(grid, "group_")
        .select("id_", "vec_", "code_", "list_", "group_", F.pmod(F.xxhash64("id_"), F.col("m_")).cast("int").alias("mb_"), F.explode(F.sequence(F.lit(0), F.col("q_") - 1)).alias("qb_"))
    )
    by = ("group_", "mb_", "qb_")
    asks = asks.select(*(F.col(c).alias(c) for c in ("id_", "vec_", "near_", *by)))  # other attributes than those of the answers
    found = asks.groupBy(*by).cogroup(answers.groupBy(*by)).applyInPandas(_searcher(ix, dim, k), "id_ long, ids array<long>, sims array<double>")
    best = (
        found.groupBy("id_")
        .agg(F.flatten(F.collect_list(F.arrays_zip(F.transform("sims", lambda s: -s).alias("neg"), F.col("ids").alias("id")))).alias("all_"))
        .select("id_", F.posexplode(F.slice(F.array_sort("all_"), 1, k)))
        .select("id_", F.col("col.id").alias("nbr_"), (-F.col("col.neg")).alias("sim_"), (F.col("pos") + 1).alias("rank_"))
    )
    best = materialize(best, "best")
    own = best.where(ask).select("id_", "nbr_", "sim_", "rank_")
    more = further.where(ask).join(small_side(best.withColumnRenamed("id_", "last_").join(small_side(lasts.select("last_")), "last_")), "last_")
    return own.unionByName(more.select("id_", "nbr_", "sim_", "rank_"))


def similar_pairs(neighbors: DataFrame, least: float = 0.9) -> DataFrame:
    """``(a, b, sim)``, a < b: pairs of which one is among the other's most
    similar rows, with a similarity of at least ``least``."""
    return (
        neighbors.where(F.col("sim_") >= least)
        .select(F.least("id_", "nbr_").alias("a"), F.greatest("id_", "nbr_").alias("b"), "sim_")
        .groupBy("a", "b")
        .agg(F.max("sim_").alias("sim"))
    )
