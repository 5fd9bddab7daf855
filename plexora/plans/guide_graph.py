"""From a long matrix to a guide graph: filters, all-pairs information, threshold."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from plexora.operators import nmic, stats
from plexora.operators.running import largest
from plexora.operators.windows import ratio_windows
from plexora.session import materialize, small_side


@dataclass(frozen=True)
class GuideGraph:
    """Edges ``(src, dst, w)``, the matrix of their features, similar pairs and
    the parameters used."""

    edges: DataFrame
    matrix: DataFrame
    similar: DataFrame | None
    params: dict[str, float]


def guide_graph(
    long: DataFrame,
    n_features: int = 5000,
    cv: float = 0.1,
    check_similar: bool = False,
    pcc: float = 0.95,
    mi: float = 0.05,
    most: float = 0.98,
    least: float = 0.33,
    grow: float = 0.07,
    slide: float = 0.07,
    drop_last: bool = False,
) -> GuideGraph:
    """Keep the features that vary most, optionally drop redundant ones, measure
    all pairs and keep those above ``mi``. Every observation needs a value of
    every feature. Features keep their own names or numbers throughout."""
    per = stats.moments(long)
    spans = ratio_windows(largest(per), least, most, grow, slide)
    chosen = stats.top_features(stats.windowed_cv(long, spans, per), n_features, cv)
    kept = long.join(small_side(chosen.select("feat")), "feat").select("obs", "feat", "value")
    similar = None
    if check_similar:
        kept, similar = nmic.without_redundant(kept, spans, pcc)
    # a sort samples its input first: the pairs are written before it, or they would be measured twice
    edges = materialize(nmic.above(materialize(nmic.all_pairs(kept, spans), "pairs"), mi, drop_last), "edges")
    ends = edges.selectExpr("src as feat").union(edges.selectExpr("dst as feat")).distinct()
    params = {"n_features": n_features, "cv": cv, "pcc": pcc, "mi": mi, "max_window": most, "min_window": least, "step_window": grow, "step_slide": slide}
    return GuideGraph(edges, kept.join(ends, "feat", "left_semi"), similar, params)
