"""Queries of problem 1 (a few keys holding most records)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plexora.operators import hotkeys
from plexora.plans.registry import Registry
from plexora.session import table

REG = Registry()
_EDGES = ("src_expanded_idx", "dst_expanded_idx", "edge_weight")

_SIDES = """
WITH s AS (
  SELECT edge_id, src_expanded_idx AS k, dst_expanded_idx AS p, edge_weight AS w FROM edge_source
  UNION ALL
  SELECT edge_id, dst_expanded_idx, src_expanded_idx, edge_weight FROM edge_source
  WHERE src_expanded_idx IS DISTINCT FROM dst_expanded_idx)
"""


@REG.add("p1_found", _SIDES + """
SELECT k AS expanded_idx FROM s WHERE k >= 0 GROUP BY k
HAVING count(*) * 100 >= (SELECT count(*) FROM edge_source)""")
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return hotkeys.heavy_features(table(spark, d, "edge_source", *_EDGES), *_EDGES).select("expanded_idx")


@REG.add("p1_features", _SIDES + """
SELECT k AS expanded_idx, count(*) AS n_rows,
       round(sum(CAST(w AS DOUBLE)) FILTER (WHERE NOT isnan(w)), 3) AS sum_weight,
       count(DISTINCT p) FILTER (WHERE p >= 0 AND p <> k) AS n_partners
FROM s WHERE k >= 0 GROUP BY k""")
def p1_features(spark: SparkSession, d: str) -> DataFrame:
    out = hotkeys.feature_totals(table(spark, d, "edge_source", *_EDGES), *_EDGES)
    return out.withColumn("sum_weight", F.round("sum_weight", 3))
