"""The tables' columns as the engine's model: long matrices, edges, labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plexora.session import small_side, table

# The same inputs as common table expressions of the oracles.
EMB = """emb AS (
  SELECT vec_id AS obs, CAST(unnest(range(len(embedding))) AS INTEGER) AS feat, CAST(unnest(embedding) AS DOUBLE) AS value FROM embeddings)"""
ORDER_BRAND = """ob AS (
  SELECT l_orderkey AS obs, p_brand AS feat, CAST(sum(l_quantity) AS DOUBLE) AS value FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)"""
SUPPLIER_BRAND = """sb AS (
  SELECT l_suppkey AS obs, p_brand AS feat, CAST(sum(l_quantity) AS DOUBLE) AS value FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL)"""
NMIC_EDGES = """nm AS (
  SELECT least(u, v) AS u, greatest(u, v) AS v, max(w) AS w FROM bulk_nmic
  WHERE u >= 0 AND v >= 0 AND u <> v AND w IS NOT NULL AND NOT isnan(w) GROUP BY ALL)"""
FUSED_EDGES = """fe AS (
  SELECT least(src_expanded_idx, dst_expanded_idx) AS u, greatest(src_expanded_idx, dst_expanded_idx) AS v, max(CAST(edge_weight AS DOUBLE)) AS w
  FROM edge_source WHERE src_expanded_idx >= 0 AND dst_expanded_idx >= 0 AND src_expanded_idx <> dst_expanded_idx
    AND edge_weight IS NOT NULL AND NOT isnan(edge_weight) GROUP BY ALL)"""
VOCABULARY = """vo AS (
  SELECT expanded_idx AS idx, min(feature_name) AS name, min(old_or_new) AS old_or_new FROM feature_mapping WHERE expanded_idx IS NOT NULL GROUP BY ALL)"""
EXPRESSION = """ex AS (
  SELECT obs_id AS obs, 'qt1g00335' AS feat, qt1g00335 AS value FROM expression UNION ALL
  SELECT obs_id, 'qt1g00445', qt1g00445 FROM expression UNION ALL
  SELECT obs_id, 'qt1g00825', qt1g00825 FROM expression UNION ALL
  SELECT obs_id, 'qt1g00950', qt1g00950 FROM expression)"""


def embedding_long(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings", "vec_id", "embedding")
    return e.select(F.col("vec_id").alias("obs"), F.posexplode("embedding").alias("feat", "v")).select("obs", "feat", F.col("v").cast("double").alias("value"))


def _brand_sum(spark: SparkSession, d: str, by: str) -> DataFrame:
    part = small_side(table(spark, d, "part", "p_partkey", "p_brand"))
    lines = table(spark, d, "lineitem", by, "l_partkey", "l_quantity")
    return lines.join(part, F.col("l_partkey") == F.col("p_partkey")).groupBy(F.col(by).alias("obs"), F.col("p_brand").alias("feat")).agg(F.sum("l_quantity").cast("double").alias("value"))


def order_brand(spark: SparkSession, d: str) -> DataFrame:
    return _brand_sum(spark, d, "l_orderkey")


def supplier_brand(spark: SparkSession, d: str) -> DataFrame:
    return _brand_sum(spark, d, "l_suppkey")


def raw_edges(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "edge_source", "src_expanded_idx", "dst_expanded_idx", "src", "dst", "edge_weight", "edge_source", "edge_type")


def fused_edges(spark: SparkSession, d: str) -> DataFrame:
    from plexora.operators.edges import canonical

    e = table(spark, d, "edge_source", "src_expanded_idx", "dst_expanded_idx", "edge_weight")
    return canonical(e.withColumn("edge_weight", F.col("edge_weight").cast("double")), "src_expanded_idx", "dst_expanded_idx", "edge_weight")


def nmic_edges(spark: SparkSession, d: str) -> DataFrame:
    from plexora.operators.edges import canonical

    return canonical(table(spark, d, "bulk_nmic", "u", "v", "w"), "u", "v", "w")


def vocabulary(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "feature_mapping", "expanded_idx", "feature_name", "old_or_new").where("expanded_idx is not null")
    return m.groupBy(F.col("expanded_idx").alias("idx")).agg(F.min("feature_name").alias("name"), F.min("old_or_new").alias("old_or_new"))


def expression_long(spark: SparkSession, d: str) -> DataFrame:
    from plexora.operators.reshape import to_long

    genes = ["qt1g00335", "qt1g00445", "qt1g00825", "qt1g00950"]
    return to_long(table(spark, d, "expression", "obs_id", *genes), "obs_id", genes)
