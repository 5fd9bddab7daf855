"""Fixed-capacity containers filled with items of varying length."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plexora.session import materialize

#: Length classes of the plan; a class stands for its longest length.
CLASSES = 128
#: A planned combination may leave so many classes free, for short items.
WINDOW = 6
#: Items that one task packs.
BLOCK = 20_000


def pieces(df: DataFrame, key: str, text: str, capacity: int) -> DataFrame:
    """``(id_, piece_, start_, size_)`` in tokens of the byte-level tokenizer.

    An item of at most ``capacity`` tokens is one piece; a longer one is cut
    into full pieces and a rest. Null and empty texts have no tokens and give no
    piece; a repeated id gives its pieces again.
    """
    n = F.octet_length(text).cast("long")
    sized = df.select(F.col(key).cast("long").alias("id_"), n.alias("n_")).where("n_ > 0")
    cut = sized.select("id_", "n_", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n_") - 1) / capacity))).alias("piece_"))
    return cut.select(
        "id_",
        F.col("piece_").cast("int").alias("piece_"),
        (F.col("piece_") * capacity).alias("start_"),
        F.least(F.lit(capacity).cast("long"), F.col("n_") - F.col("piece_") * capacity).cast("int").alias("size_"),
    )


def combinations(classes: int, window: int) -> np.ndarray:
    """All multisets of up to three length classes whose sum fills a container up
    to ``window`` classes, as columns of counts per class."""
    out = []
    for a in range(classes, 0, -1):
        if classes - window <= a:
            out.append((a,))
        for b in range(min(a, classes - a), 0, -1):
            if classes - window <= a + b:
                out.append((a, b))
            low = max(1, classes - window - a - b)
            out.extend((a, b, c) for c in range(min(b, classes - a - b), low - 1, -1))
    m = np.zeros((classes + 1, len(out)))
    for j, combo in enumerate(out):
        for c in combo:
            m[c, j] += 1
    return m


def nnls(a: np.ndarray, b: np.ndarray, rounds: int = 0) -> np.ndarray:
    """Non-negative least squares by the active-set method of Lawson and Hanson."""
    n = a.shape[1]
    x, free = np.zeros(n), np.zeros(n, bool)
    tol = 1e-9 * max(1.0, float(np.abs(a.T @ b).max(initial=0)))
    for _ in range(rounds or 6 * a.shape[0]):
        g = a.T @ (b - a @ x)
        g[free] = -np.inf
        j = int(g.argmax())
        if g[j] <= tol:
            break
        free[j] = True
        while True:
            idx = np.flatnonzero(free)
            s = np.linalg.lstsq(a[:, idx], b, rcond=None)[0]
            if len(s) == 0 or s.min() > 0:
                break
            neg = s <= 0
            with np.errstate(divide="ignore", invalid="ignore"):
                t = np.where(neg, x[idx] / (x[idx] - s), np.inf)
            x[idx] += np.nanmin(t) * (s - x[idx])
            x[idx[(x[idx] <= 1e-12) | (neg & (t <= np.nanmin(t) + 1e-15))]] = 0
            free[:] = x > 0
            if not free.any():
                s, idx = np.zeros(0), np.zeros(0, int)
                break
        x[:] = 0
        x[idx] = s
    return x


def plan(histogram: dict[int, int], capacity: int, classes: int = CLASSES, window: int = WINDOW) -> list[tuple[tuple[int, ...], float]]:
    """Repeat counts of shallow length combinations against the histogram.

    ``histogram`` maps size to number of items, at most ``capacity`` entries.
    Classes are weighted by their length: long items need a planned partner,
    short ones find room anywhere.
    """
    classes = min(classes, capacity)
    b = np.zeros(classes + 1)
    for size, n in histogram.items():
        b[-(-size * classes // capacity)] += n
    used = np.flatnonzero(b)
    if not len(used):
        return []
    m = combinations(classes, window)
    present = b > 0
    m = m[:, (m[~present] == 0).all(0)]
    if not m.shape[1]:
        return []
    scale = float(b.sum())
    w = np.arange(classes + 1) / classes
    x = nnls((m * w[:, None])[used], (b * w / scale)[used]) * scale
    found = []
    for j in np.flatnonzero(x > 0):
        combo = tuple(int(c) for c in np.flatnonzero(m[:, j]) for _ in range(int(m[c, j])))
        found.append((combo[::-1], float(x[j])))
    return sorted(found, reverse=True)


def pack_sizes(sizes: np.ndarray, recipes: list[tuple[tuple[int, ...], float]], share: float, capacity: int, classes: int = CLASSES) -> np.ndarray:
    """The container of each item: the rounded recipes first, then best-fit
    decreasing over what is left, into planned and new containers alike."""
    classes = min(classes, capacity)
    order = np.argsort(-sizes, kind="stable")
    into = np.full(len(sizes), -1, np.int64)
    rooms: dict[int, list[int]] = {}
    mask, made = 0, 0

    def leave(box: int, room: int) -> None:
        nonlocal mask
        if room:
            rooms.setdefault(room, []).append(box)
            mask |= 1 << room

    queue: dict[int, list[int]] = {}
    for i in order[::-1]:  # the longest of a class is taken first
        queue.setdefault(int(-(-int(sizes[i]) * classes // capacity)), []).append(int(i))
    carry = 0.0
    for combo, count in recipes:
        carry += count * share
        times = int(carry + 0.5)
        carry -= times
        for _ in range(times):
            need: dict[int, int] = {}
            for c in combo:
                need[c] = need.get(c, 0) + 1
            if any(len(queue.get(c, ())) < k for c, k in need.items()):
                break
            room = capacity
            for c in combo:
                i = queue[c].pop()
                into[i] = made
                room -= int(sizes[i])
            leave(made, room)
            made += 1
    for i in order:
        if into[i] >= 0:
            continue
        s = int(sizes[i])
        fits = mask >> s
        if fits:
            room = s + (fits & -fits).bit_length() - 1
            box = rooms[room].pop()
            if not rooms[room]:
                mask &= ~(1 << room)
        else:
            box, room = made, capacity
            made += 1
        into[i] = box
        leave(box, room - s)
    return into


def _packer(recipes: list[tuple[tuple[int, ...], float]], total: int, capacity: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["id_", "piece_"], ignore_index=True)
        box = pack_sizes(pdf["size_"].to_numpy(np.int64), recipes, len(pdf) / total, capacity)
        pdf["box_"] = pdf["block_"].astype("int64") * (1 << 24) + box
        return pdf.drop(columns="block_")

    return work


def pack(df: DataFrame, key: str, text: str, capacity: int = 4096) -> DataFrame:
    """``(id_, piece_, start_, size_, box_)``: every piece with its container.

    The histogram of piece sizes (at most ``capacity`` numbers) is counted over
    all rows; non-negative least squares over shallow combinations of length
    classes gives how often each should be filled. Pieces are hashed into blocks
    of about :data:`BLOCK`; each block rounds its share of the plan and packs
    the rest greedily in its own task, so a block leaves about one container
    partly filled. Only ids and sizes are shuffled, never texts.
    """
    all_pieces = materialize(pieces(df, key, text, capacity), "pieces")
    counts = {r["size_"]: r["n"] for r in all_pieces.groupBy("size_").agg(F.count(F.lit(1)).alias("n")).collect()}
    total = sum(counts.values())
    recipes = plan(counts, capacity)
    blocks = max(1, round(total / BLOCK))
    tagged = all_pieces.withColumn("block_", F.pmod(F.xxhash64("id_", "piece_"), F.lit(blocks)).cast("int"))
    return tagged.groupBy("block_").applyInPandas(_packer(recipes, max(total, 1), capacity), "id_ long, piece_ int, start_ long, size_ int, box_ long")


def fill_report(packed: DataFrame, capacity: int = 4096) -> DataFrame:
    """One row: containers, the fewest that the tokens need, their fill, items cut."""
    boxes = packed.groupBy("box_").agg(F.sum("size_").alias("used"), F.count_if(F.col("piece_") == 1).alias("cut"))
    return boxes.agg(
        F.count(F.lit(1)).alias("n_containers"),
        F.ceil(F.sum("used") / capacity).alias("n_least"),
        F.coalesce(F.max("used"), F.lit(0)).alias("max_used"),
        (F.sum("used") / (F.count(F.lit(1)) * capacity)).alias("fill"),
        F.coalesce(F.sum("cut"), F.lit(0)).alias("n_cut"),
    )
