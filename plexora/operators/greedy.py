"""Order-dependent graph kernels: one graph is one task."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _bin_edges(c: np.ndarray, most: int = 1000) -> np.ndarray:
    """Edges of equal bins by the rule of Freedman and Diaconis."""
    low, high = float(c.min()), float(c.max())
    q75, q25 = np.quantile(c, [0.75, 0.25])
    width = 2 * (q75 - q25) / len(c) ** (1 / 3) if q75 > q25 else high - low
    k = int((high - low) / width) if width > 0 else 1
    return np.linspace(low, high, max(1, min(k, most)) + 1)


def _reach(n: int, rows: np.ndarray, cols: np.ndarray, centre: int, hops: int) -> np.ndarray:
    """Nodes from which ``centre`` is reached over at most ``hops`` edges."""
    mask = np.zeros(n, bool)
    mask[centre] = True
    front = mask
    for _ in range(hops):
        step = np.zeros(n, bool)
        step[rows[front[cols]]] = True
        front = step & ~mask
        if not front.any():
            break
        mask = mask | step
    return mask


def multiscale(n: int, rows: np.ndarray, cols: np.ndarray, centrality: np.ndarray, hops: int, overlap: float) -> list[tuple[int, np.ndarray]]:
    """``(centre, members)`` of the subgraphs of one graph, largest first.

    Centres are tried from the most central bin down. Each one's reach, if it
    has two nodes, takes up every subgraph with which it shares more than
    ``overlap`` of the smaller of both, until all nodes are covered.
    """
    if n == 0 or len(rows) == 0:
        return []
    edges = _bin_edges(centrality)
    found: list[tuple[int, np.ndarray]] = []
    covered = np.zeros(n, bool)
    for b in range(len(edges) - 2, -1, -1):
        if covered.all():
            break
        for centre in np.flatnonzero((centrality >= edges[b]) & (centrality <= edges[b + 1])):
            mask = _reach(n, rows, cols, int(centre), hops)
            size = int(mask.sum())
            if size < 2:
                continue
            whole, rest = mask, []
            for c, other in found:
                if (other & mask).sum() / (min(int(other.sum()), size) + 1e-8) > overlap:
                    whole = whole | other
                else:
                    rest.append((c, other))
            found = [*rest, (int(centre), whole)]
            covered |= whole
            if covered.all():
                break
    return sorted(found, key=lambda x: -int(x[1].sum()))


def _task(hops: int, overlap: float) -> Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame]:
    def work(nodes: pd.DataFrame, edges: pd.DataFrame) -> pd.DataFrame:
        nodes = nodes.sort_values("node", ignore_index=True)
        ids = nodes["node"].to_numpy()
        at = {x: i for i, x in enumerate(ids)}
        rows = np.array([at[x] for x in edges["u"]], dtype=int)
        cols = np.array([at[x] for x in edges["v"]], dtype=int)
        out = [
            (nodes["g"][0], k, ids[c], x)
            for k, (c, mask) in enumerate(multiscale(len(ids), rows, cols, nodes["centrality"].to_numpy(float), hops, overlap))
            for x in ids[mask]
        ]
        return pd.DataFrame(out, columns=["g", "subgraph", "centre", "node"])

    return work


def multiscale_subgraphs(nodes: DataFrame, edges: DataFrame, hops: int = 2, overlap: float = 0.85) -> DataFrame:
    """``(g, subgraph, centre, node)`` of every graph, from nodes ``(g, node,
    centrality)`` and edges ``(g, u, v)`` whose ends are among them. Graphs are
    independent; a graph is a sample with a capped number of nodes, so it fits a
    task. A graph without edges gives no rows."""
    kinds = {**dict(nodes.dtypes)}
    # renamed anew, as both sides may come from one table
    nodes = nodes.select(*(F.col(c).alias(c) for c in ("g", "node", "centrality")))
    e = edges.select(*(F.col(c).alias(c) for c in ("g", "u", "v"))).where(F.col("u").isNotNull() & F.col("v").isNotNull())
    return nodes.groupBy("g").cogroup(e.groupBy("g")).applyInPandas(_task(hops, overlap), f"g {kinds['g']}, subgraph int, centre {kinds['node']}, node {kinds['node']}")
