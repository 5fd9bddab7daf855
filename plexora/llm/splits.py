"""Train, validation and test splits that keep related records together."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plexora.operators.components import min_labels
from plexora.session import materialize, small_side

#: Names that stand for no label once reduced.
PLACEHOLDERS = ("", "na", "unknown")
#: Components that one task anneals together.
BLOCK = 20_000
#: Splits that a table of targets may have.
MAX_SPLITS = 1_000


def reduced(c: Column) -> Column:
    """Lower case, only ASCII letters and digits; null where that names nothing."""
    x = F.regexp_replace(F.lower(c), "[^a-z0-9]", "")
    return F.when(~x.isin(*PLACEHOLDERS), x)


def line_of(name: str) -> Column:
    """What follows the last ``_``; null for a name without one."""
    c = F.col(name)
    return F.when(F.contains(c, F.lit("_")), F.substring_index(c, "_", -1))


def tied_groups(df: DataFrame, key: str, batch: str, name: str, label: str) -> DataFrame:
    """Observations with their group: ``(key, tie_, label_, group_, group_size_)``.

    Two rows are tied if they share the reduced batch or the reduced line of
    ``name``. ``group_`` is the smallest node of the group, ``b:<batch>`` if it
    has any batch, else ``l:<line>``; a row with neither forms its own group
    ``o:<key>``. Links are aggregated to distinct (batch, line) pairs first, so
    the components are found over labels and a hot batch is a single node.
    Null names and batches tie nothing; repeated keys stay as rows, untied rows
    of one key (or of none) are one group.
    """
    rows = df.select(
        F.col(key).alias("key_"),
        reduced(F.col(batch)).alias("b_"),
        reduced(line_of(name)).alias("l_"),
        F.coalesce(F.lower(F.trim(F.col(label))), F.lit("")).alias("label_"),
    )
    node_b, node_l = F.concat(F.lit("b:"), F.col("b_")), F.concat(F.lit("l:"), F.col("l_"))
    rows = rows.select(
        "key_",
        "label_",
        F.coalesce(F.concat_ws("|", node_b, node_l), F.lit("")).alias("pair_"),
        node_b.alias("nb_"),
        node_l.alias("nl_"),
    ).withColumn("pair_", F.when(F.col("pair_") == "", F.concat(F.lit("o:"), F.coalesce(F.col("key_").cast("string"), F.lit("")))).otherwise(F.col("pair_")))
    pairs = materialize(rows.groupBy("pair_", "nb_", "nl_").agg(F.count(F.lit(1)).alias("n_")), "pairs")
    links = pairs.where("nb_ is not null and nl_ is not null").select(F.col("nb_").alias("u"), F.col("nl_").alias("v"))
    labels = min_labels(links, "u", "v")
    grouped = pairs.withColumn("node", F.coalesce("nb_", "nl_")).join(labels, "node", "left").select(
        "pair_", "n_", F.coalesce("label", "node", "pair_").alias("group_")
    )
    sizes = grouped.groupBy("group_").agg(F.sum("n_").alias("group_size_"))
    info = materialize(grouped.select("pair_", "group_").join(sizes, "group_"), "groups")
    return rows.select("key_", "label_", "pair_").join(info, "pair_").select(F.col("key_").alias(key), "label_", "group_", "group_size_")


#: A component as ``(measure, size)`` pairs; measure 0 is its rows.
Sizes = list[list[tuple[int, float]]]


def anneal(sizes: np.ndarray | Sizes, start: np.ndarray, props: np.ndarray, offset: np.ndarray, weight: np.ndarray, steps: int, seed: int) -> np.ndarray:
    """Swap search over one block of components.

    ``sizes`` is components x measures (rows, then rows per label), dense or as
    the pairs that are not 0; ``start`` the split of each; ``offset`` the
    deviation that the other blocks leave to this one, splits x measures. Moves
    a component or exchanges two, accepts by the Metropolis rule under a falling
    temperature and returns the best assignment seen.
    """
    if isinstance(sizes, np.ndarray):
        sizes = [[(int(m), float(row[m])) for m in np.flatnonzero(row)] for row in sizes]
    rng = np.random.RandomState(seed & 0x7FFFFFFF)
    n, k = len(sizes), len(props)
    at = [int(x) for x in start]
    if n == 0 or k < 2:
        return np.array(at, np.int64)
    dev = np.array(offset, float)
    for c, part in zip(at, sizes):
        for m, x in part:
            dev[c, m] += x
            dev[:, m] -= props * x
    cost = float((dev * dev * weight).sum())
    dev, weight = dev.tolist(), weight.tolist()

    def move(part: list[tuple[int, float]], a: int, b: int) -> float:
        """Carry a component from ``a`` to ``b``; what that adds to the cost."""
        da, db, change = dev[a], dev[b], 0.0
        for m, x in part:
            change += weight[m] * x * (x + db[m] - da[m])
            da[m] -= x
            db[m] += x
        return 2 * change

    best_cost = cost
    undo: list[tuple[int, int]] = []  # what happened since the best assignment
    heat = max(cost / n, 1e-12)
    picks, others, moves, luck = (x.tolist() for x in (rng.randint(n, size=steps), rng.randint(n, size=steps), rng.randint(1, k, size=steps), rng.random_sample(steps)))
    for t in range(steps):
        i = picks[t]
        a = at[i]
        if t & 1:
            j = others[t]
            b = at[j]
            if a == b:
                continue
        else:
            j, b = -1, (a + moves[t]) % k
        change = move(sizes[i], a, b)
        if j >= 0:
            change += move(sizes[j], b, a)
        temp = heat * (1 - t / steps) ** 3
        if change > 0 and (temp <= 0 or luck[t] >= math.exp(-change / temp)):
            move(sizes[i], b, a)
            if j >= 0:
                move(sizes[j], a, b)
            continue
        at[i] = b
        undo.append((i, a))
        if j >= 0:
            at[j] = a
            undo.append((j, b))
        cost += change
        if cost < best_cost:
            best_cost = cost
            undo.clear()
    for i, a in reversed(undo):
        at[i] = a
    return np.array(at, np.int64)


def _block_work(props: np.ndarray, total: float, labels: int, dev: np.ndarray, blocks: int, seed: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """The task that anneals one block of one replica; ``dev`` is the deviation
    of the rows per replica and split."""

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["group_", "label_"], ignore_index=True)
        rep, block = int(pdf["replica"][0]), int(pdf["block"][0])
        comp, _ = pd.factorize(pdf["group_"])
        names, first = np.unique(pdf["label_"].to_numpy(str), return_index=True)
        code = np.searchsorted(names, pdf["label_"].to_numpy(str)) + 1
        n = pdf["n"].to_numpy(float)
        heads = np.flatnonzero(np.r_[True, comp[1:] != comp[:-1]])
        at = pdf["at"].to_numpy(np.int64)[heads]
        sizes = [[(0, float(x))] for x in np.add.reduceat(n, heads)]
        for c, m, x in zip(comp.tolist(), code.tolist(), n.tolist()):
            sizes[c].append((m, x))
        # deviations of the replica by its own splits and by this block's part of them
        whole = np.column_stack([dev[rep], np.vstack(pdf["dev_"].to_numpy()[first]).T])
        per = np.r_[total, pdf["total_"].to_numpy(float)[first]]
        weight = np.r_[4.0, np.full(len(names), 1.0 / labels)] / np.maximum(per, 1) ** 2
        local = np.zeros_like(whole)
        for c, part in zip(at.tolist(), sizes):
            for m, x in part:
                local[c, m] += x
                local[:, m] -= props * x
        # this block takes its own deviation and an even part of the others'
        done = anneal(sizes, at, props, (whole - local) / blocks, weight, 2_000 + 8 * len(sizes), seed + rep * 101 + block)
        pdf["at"] = done[comp].astype("int32")
        return pdf[["replica", "group_", "label_", "n", "at"]]

    return work


def split_components(groups: DataFrame, targets: DataFrame, split: str, proportion: str, replicas: int = 3, rounds: int = 3, seed: int = 7) -> DataFrame:
    """``(group_, split)``: whole components assigned near the target proportions.

    Starts from a hashed assignment. In each round the components are hashed
    anew into blocks of about :data:`BLOCK`; every block of every replica is
    annealed in its own task, each correcting its part of the deviation that
    the replica has over all blocks. Every label is balanced by itself, however
    many there are: sizes are rows per component and label, and a block sees the
    deviations of its own labels. Only the rows per split and one cost for each
    replica reach the driver. The assignment with the smallest deviation of any
    replica and round is kept. Deterministic for given data.
    """
    names, props = _targets(targets, split, proportion)
    per = materialize(groups.groupBy("group_", "label_").agg(F.count(F.lit(1)).cast("double").alias("n")), "components")
    totals = materialize(per.groupBy("label_").agg(F.sum("n").alias("total_")), "labels")
    head = totals.agg(F.count(F.lit(1)).alias("labels"), F.sum("total_").alias("n")).first()
    if not head["labels"]:
        return per.select("group_", F.lit(None).cast("string").alias("split")).limit(0)
    total, labels = float(head["n"]), int(head["labels"])
    blocks = max(1, -(-per.select("group_").distinct().count() // BLOCK))
    bounds = np.cumsum(props)
    u = F.pmod(F.xxhash64("group_", "replica"), F.lit(1 << 30)) / float(1 << 30)
    first = F.lit(len(names) - 1)
    for i in reversed(range(len(names) - 1)):
        first = F.when(u < float(bounds[i]), i).otherwise(first)
    state = per.withColumn("replica", F.explode(F.array(*(F.lit(r) for r in range(replicas))))).withColumn("at", first)
    state = materialize(state.select("replica", "group_", "label_", "n", "at"), "start")
    share = F.array(*(F.lit(float(x)) for x in props))

    def deviations(s: DataFrame) -> tuple[DataFrame, np.ndarray, list[float]]:
        """Per replica and label the deviations of the splits; those of all rows; costs."""
        got = s.groupBy("replica", "label_", "at").agg(F.sum("n").alias("n"))
        got = got.groupBy("replica", "label_").agg(F.map_from_entries(F.collect_list(F.struct("at", "n"))).alias("m_"))
        gap = F.transform(share, lambda p, i: F.coalesce(F.try_element_at("m_", i), F.lit(0.0)) - p * F.col("total_"))
        per_label = materialize(got.join(small_side(totals), "label_").select("replica", "label_", "total_", gap.alias("dev_")), "deviations")
        square = F.aggregate("dev_", F.lit(0.0), lambda a, x: a + x * x) / F.pow(F.greatest("total_", F.lit(1.0)), F.lit(2)) / labels
        sums = per_label.groupBy("replica").agg(F.sum(square).alias("cost"), *(F.sum(F.get("dev_", F.lit(k))).alias(f"d{k}") for k in range(len(names)))).collect()
        rows, costs = np.zeros((replicas, len(names))), [0.0] * replicas
        for r in sums:
            rows[r["replica"]] = [r[f"d{k}"] for k in range(len(names))]
            costs[r["replica"]] = r["cost"] + 4.0 * float((rows[r["replica"]] ** 2).sum()) / max(total, 1) ** 2
        return per_label, rows, costs

    per_label, dev, costs = deviations(state)
    best = (min(costs), state, int(np.argmin(costs)))
    for rnd in range(rounds):
        tagged = state.withColumn("block", F.pmod(F.xxhash64("group_", F.lit(rnd + seed)), F.lit(blocks)).cast("int"))
        work = _block_work(props, total, labels, dev, blocks, seed * 1_000_003 + rnd * 10_007)
        known = tagged.join(small_side(per_label), ["replica", "label_"])
        state = materialize(known.groupBy("replica", "block").applyInPandas(work, state.schema), f"round{rnd}")
        per_label, dev, costs = deviations(state)
        if min(costs) < best[0]:
            best = (min(costs), state, int(np.argmin(costs)))
    names_of = F.array(*(F.lit(x) for x in names))
    # a component has one row per label here, all of one split
    done = best[1].where(F.col("replica") == best[2]).groupBy("group_").agg(F.min("at").alias("a_"), F.max("at").alias("b_"))
    parted = F.raise_error(F.concat(F.lit("a component in two splits: "), F.col("group_"))).cast("int")
    return done.select("group_", F.get(names_of, F.when(F.col("a_") == F.col("b_"), F.col("a_")).otherwise(parted)).alias("split"))


def _targets(targets: DataFrame, split: str, proportion: str) -> tuple[list[str], np.ndarray]:
    got = targets.where(F.col(split).isNotNull() & (F.col(proportion) > 0)).orderBy(F.desc(proportion), split).limit(MAX_SPLITS + 1).collect()
    if len(got) > MAX_SPLITS:
        raise ValueError(f"more than {MAX_SPLITS} splits")
    if not got:
        raise ValueError("no split has a positive proportion")
    p = np.array([r[proportion] for r in got], dtype=float)
    return [r[split] for r in got], p / p.sum()


def assign_splits(df: DataFrame, targets: DataFrame, key: str, batch: str, name: str, label: str, split: str, proportion: str) -> DataFrame:
    """``(key, label_, group_, group_size_, split)``: one row per row of ``df``,
    tied rows together (see :func:`tied_groups`), the split as chosen by
    :func:`split_components`. An empty table gives no rows."""
    groups = materialize(tied_groups(df, key, batch, name, label), "tied")
    return groups.join(split_components(groups, targets, split, proportion), "group_")


def found_groups(assigned: DataFrame, key: str) -> DataFrame:
    """``(key, group_batch)`` of the assigned rows whose group has two rows or
    more and a batch. Reading it fails if the assignment left a row without a
    split; :func:`split_components` fails if it parted a component."""
    bad = F.raise_error(F.concat(F.lit("without a split: "), F.col("group_"))).cast("boolean")
    kept = assigned.where((F.col("group_size_") >= 2) & F.startswith("group_", F.lit("b:"))).where(F.when(F.col("split").isNull(), bad).otherwise(F.lit(True)))
    return kept.select(key, F.substring("group_", 3, 1 << 30).alias("group_batch"))
