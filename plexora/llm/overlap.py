"""Same or near-same records across splits."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plexora.llm.cutoffs import label
from plexora.llm.splits import reduced
from plexora.session import BROADCAST_BYTES, BROADCAST_ROWS, materialize

#: Training names a segment may have before its names go by deletions instead.
BUCKET = 256


def canonical_rows(df: DataFrame, key: str, name: str, split: str, group: str) -> DataFrame:
    """``(id_, name_, split_, group_)``: names without case, punctuation and
    blanks, splits without case and outer blanks. Null, empty and placeholder
    names and null splits take no part; null groups do, as null."""
    return df.select(
        F.col(key).cast("long").alias("id_"), reduced(F.col(name)).alias("name_"), label(split).alias("split_"), label(group).alias("group_")
    ).where("id_ is not null and name_ is not null and split_ is not null")


def _segment(i: int, n: Column, parts: int) -> tuple[Column, Column]:
    """Start (from 0) and length of segment ``i`` of an even cut of length ``n``:
    the first segments are the shorter ones."""
    base, extra = F.floor(n / parts), n % parts
    longer = F.greatest(F.lit(0), F.lit(i) - (F.lit(parts) - extra))
    return (base * i + longer).cast("int"), (base + F.when(F.lit(i) >= F.lit(parts) - extra, 1).otherwise(0)).cast("int")


def _place(i: int, at: Column, size: Column) -> Column:
    """A segment's number, start and length in one long."""
    return (F.lit(i).cast("long") * (1 << 30) + at) * (1 << 30) + size


def _index_places(edits: int, parts: Iterable[int]) -> Column:
    """Those segments of a training name: one of all survives ``edits`` edits."""
    return F.array(*(_place(i, *_segment(i, F.length("name_"), edits + 1)) for i in parts))


def _probe_places(edits: int, parts: Iterable[int]) -> Column:
    """The substrings of an evaluation name that can equal those segments of a
    training name within ``edits``: for segment i only shifts that at most i
    edits before it and ``edits - i`` after it can cause. Training names of
    different lengths mostly ask for the same substrings, which count once."""
    l = F.length("name_")
    places = []
    for d in range(-edits, edits + 1):
        n = l - d  # length of the training name
        for i in parts:
            at, size = _segment(i, n, edits + 1)
            for shift in range(max(-i, d - (edits - i)), min(i, d + (edits - i)) + 1):
                start = at + shift
                places.append(F.when((n >= 0) & (start >= 0) & (start + size <= l), _place(i, start, size)))
    return F.array_distinct(F.array_compact(F.array(*places)))


def _keys(names: DataFrame, places: Column, alias: str) -> DataFrame:
    """``(alias, k_)``: the hashed substrings of every name at its ``places``."""
    at, size, i = F.shiftright("p_", 30).bitwiseAND((1 << 30) - 1), F.col("p_").bitwiseAND((1 << 30) - 1), F.shiftright("p_", 60)
    part = F.substring(F.col("name_"), at.cast("int") + 1, size.cast("int"))
    return names.select("name_", F.explode(places).alias("p_")).select(F.col("name_").alias(alias), F.xxhash64(i, part).alias("k_"))


def _written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """``df`` as a table of the shared folder. The shuffle files behind it are
    then of no more use, but stay on disk until the driver collects its garbage."""
    df = materialize(df, name, **options)
    df.sparkSession.sparkContext._jvm.System.gc()
    return df


def _deletions(edits: int) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """Hashes of every string that up to ``edits`` (one or two) deletions leave of
    a name: two names at most ``edits`` apart share one.

    The hash is a polynomial over the characters modulo 2**64, so prefix, middle
    and suffix of a name give the hash of what is left of it without building
    it: one step a string. A chance agreement only adds a candidate.
    """
    base = np.uint64(0x9E3779B97F4A7C15)

    def hashes(name: str) -> np.ndarray:
        x = np.frombuffer(name.encode("utf-32-le"), np.uint32).astype(np.uint64) + np.uint64(1)
        n = len(x)
        power = np.cumprod(np.r_[np.uint64(1), np.full(n, base)], dtype=np.uint64)
        # head[i] is the hash of the first i characters
        head = np.zeros(n + 1, np.uint64)
        for i in range(n):
            head[i + 1] = head[i] * base + x[i]
        span = lambda a, b: head[b] - head[a] * power[b - a]
        i = np.arange(n)
        whole, one = head[n:], head[i] * power[n - 1 - i] + span(i + 1, np.full(n, n))
        two = []
        if edits > 1:
            for a in range(n - 1):
                b = np.arange(a + 1, n)
                two.append((head[a] * power[b - a - 1] + span(np.full(len(b), a + 1), b)) * power[n - 1 - b] + span(b + 1, np.full(len(b), n)))
        return np.unique(np.concatenate([whole, one, *two]))

    def work(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        with np.errstate(over="ignore"):
            for p in parts:
                out, size = [], 0
                for name in p["name_"]:
                    h = hashes(name).astype(np.int64)
                    out.append(pd.DataFrame({"name_": name, "k_": h}))
                    size += len(h)
                    if size > 500_000:
                        yield pd.concat(out)
                        out, size = [], 0
                if out:
                    yield pd.concat(out)

    return work


def near_names(train: DataFrame, other: DataFrame, edits: int = 2) -> DataFrame:
    """``(a_, b_)``: distinct training and evaluation names at most ``edits``
    (one or two) single-character insertions, deletions or replacements apart.

    Equal names meet by the hash of the canonical name. For the others the
    training names are cut into ``edits + 1`` segments, of which one must stay
    whole; hashes of segments join hashes of the substrings that can match
    them, and the built-in bounded Levenshtein distance decides. A segment that
    more than :data:`BUCKET` training names share would pair too many; the names
    that meet there join by the hashes of what deletions leave of them instead.
    That is exact as well and linear in the names; a name of length L gives
    about L or, for two edits, L * L / 2 hashes.
    """
    if edits not in (1, 2):
        raise ValueError("one or two edits")
    return _near(train.select("name_").distinct(), other.select("name_").distinct(), edits)


def _near(t: DataFrame, e: DataFrame, edits: int) -> DataFrame:
    """:func:`near_names` of names that are distinct already."""
    close = F.levenshtein("a_", "b_", edits) >= 0
    keys = lambda *i: _keys(t, _index_places(edits, i), "a_")
    probes = lambda *i: _keys(e, _probe_places(edits, i), "b_")
    # Spark sizes both sides as if a name gave one row; a side it thinks small may be hundreds of MB in the driver, so none is broadcast
    meet = lambda x, y: x.hint("merge").join(y, "k_").where(close).select("a_", "b_")
    every = range(edits + 1)
    hot = _written(keys(*every).groupBy("k_").agg(F.count(F.lit(1)).alias("c_")).where(F.col("c_") > BUCKET).select("k_"), "hot")
    some = not hot.isEmpty()
    # one segment at a time, so that the names lie on disk under the keys of one only; the same pair may come by several
    met = [_written(meet(keys(i).join(hot, "k_", "left_anti") if some else keys(i), probes(i)), "near") for i in every]
    cold = reduce(DataFrame.union, met)
    if not some:
        return cold.distinct()
    ht = keys(*every).join(hot, "k_", "left_semi").select(F.col("a_").alias("name_")).distinct()
    he = probes(*every).join(hot, "k_", "left_semi").select(F.col("b_").alias("name_")).distinct()
    # many hashes a name: adaptive execution would put the few bytes of the names into one task
    tasks = t.sparkSession.sparkContext.defaultParallelism * 4
    cut = lambda x: x.repartition(tasks, "name_").mapInPandas(_deletions(edits), "name_ string, k_ long")
    rest = meet(cut(ht).withColumnRenamed("name_", "a_"), cut(he).withColumnRenamed("name_", "b_"))
    return cold.union(rest).distinct()


def overlaps(rows: DataFrame, train: str, evals: tuple[str, ...], edits: int = 2) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(links, training rows, evaluation rows)`` over :func:`canonical_rows`.

    Links hold distinct names only, ``(a_, b_, exact_)``; copies are members of
    their name, so a name that a third of all rows bear is one row here.
    """
    t, e = rows.where(F.col("split_") == train), rows.where(F.col("split_").isin(*evals))
    sides = rows.where(F.col("split_").isin(train, *evals)).groupBy("name_")
    sides = sides.agg(F.max(F.col("split_") == train).alias("t_"), F.max(F.col("split_").isin(*evals)).alias("e_"))
    names = _written(sides, "names", compression="zstd")
    equal = names.where("t_ and e_").select(F.col("name_").alias("a_"), F.col("name_").alias("b_"))
    near = _near(names.where("t_").select("name_"), names.where("e_").select("name_"), edits)
    links = near.where(F.col("a_") != F.col("b_")).withColumn("exact_", F.lit(False)).union(equal.withColumn("exact_", F.lit(True)))
    return _written(links, "links"), t, e


def _joined(links: DataFrame) -> DataFrame:
    """``links`` to be broadcast if they are few and short, else never: Spark
    would go by their files, in which repeated names take next to nothing."""
    n, size = links.agg(F.count(F.lit(1)), F.sum(F.octet_length("a_") + F.octet_length("b_") + 64)).first()
    return F.broadcast(links) if n <= BROADCAST_ROWS and (size or 0) <= BROADCAST_BYTES else links.hint("merge")


def overlap_pairs(links: DataFrame, train: DataFrame, other: DataFrame) -> DataFrame:
    """``(a, b)``, a < b: every pair of a training and an evaluation row whose
    names are linked, the form in which the pairs are asked for."""
    x = train.select(F.col("name_").alias("a_"), F.col("id_").alias("t_"))
    y = other.select(F.col("name_").alias("b_"), F.col("id_").alias("e_"))
    out = _joined(links).join(x, "a_").hint("merge").join(y, "b_").where(F.col("t_") != F.col("e_"))
    return out.select(F.least("t_", "e_").alias("a"), F.greatest("t_", "e_").alias("b")).distinct()


def overlap_counts(links: DataFrame, train: DataFrame, other: DataFrame) -> DataFrame:
    """Overlaps per evaluation split and group: ``n_rows`` evaluation rows with
    an exact or near training record, ``n_exact`` of them with an equal one and
    ``n_pairs`` pairs of rows, counted from the sizes of the names, not from
    expanded pairs."""
    per_t = train.groupBy(F.col("name_").alias("a_")).agg(F.count(F.lit(1)).alias("t_"))
    per_e = other.groupBy(F.col("name_").alias("b_"), "split_", "group_").agg(F.count(F.lit(1)).alias("e_"))
    name = _joined(links).join(per_t, "a_").groupBy("b_").agg(F.sum("t_").alias("t_"), F.max(F.col("exact_").cast("int")).alias("x_"))
    return (
        name.join(per_e, "b_")
        .groupBy("split_", "group_")
        .agg(
            F.sum("e_").alias("n_rows"),
            F.sum(F.col("e_") * F.col("x_")).alias("n_exact"),
            F.sum(F.col("e_") * F.col("t_")).alias("n_pairs"),
        )
    )
