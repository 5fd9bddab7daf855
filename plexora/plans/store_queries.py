"""Stores and streams: written to the shared folder and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plexora.operators import network, nmic, reshape, stats
from plexora.plans.graph_queries import _STATES, _delta
from plexora.plans.inputs import EMB, NMIC_EDGES, ORDER_BRAND, SUPPLIER_BRAND, embedding_long, nmic_edges, order_brand, supplier_brand
from plexora.plans.registry import Registry
from plexora.session import scratch_path, table
from plexora.sources import graphs, tables
from plexora.streaming import updates

REG = Registry()


@REG.add("io02_guide_graph_store", f"WITH {NMIC_EDGES} SELECT u AS src, v AS dst, w FROM nm")
def io02(spark: SparkSession, d: str) -> DataFrame:
    edges = nmic_edges(spark, d).select(F.col("u").alias("src"), F.col("v").alias("dst"), "w")
    path = graphs.write_guide_graph(edges, supplier_brand(spark, d), scratch_path(spark, "graph"), {"mi": 0.05})
    return graphs.read_guide_graph(spark, path)[0]


@REG.add("io04_guide_graph_matrix", f"WITH {SUPPLIER_BRAND} SELECT * FROM sb")
def io04(spark: SparkSession, d: str) -> DataFrame:
    edges = nmic_edges(spark, d).select(F.col("u").alias("src"), F.col("v").alias("dst"), "w")
    path = graphs.write_guide_graph(edges, supplier_brand(spark, d), scratch_path(spark, "graph"), {"mi": 0.05})
    return graphs.read_guide_graph(spark, path)[1]


@REG.add("io07_sampled_features", f"WITH {ORDER_BRAND} SELECT * FROM ob WHERE feat IN (SELECT feat FROM (SELECT DISTINCT feat FROM ob) ORDER BY md5('7:' || feat), feat LIMIT 8)")
def io07(spark: SparkSession, d: str) -> DataFrame:
    """The operator draws features; every row of a drawn feature is kept."""
    return reshape.sample_features(order_brand(spark, d), 8, 7)


@REG.add("io07_densified", f"""
WITH {EMB} SELECT obs, feat, CASE WHEN abs(value) > 0.1 THEN value ELSE 0 END AS value FROM emb WHERE obs IN (SELECT obs FROM emb WHERE abs(value) > 0.1)""")
def io07_dense(spark: SparkSession, d: str) -> DataFrame:
    long = embedding_long(spark, d)
    sparse = long.where(F.abs("value") > 0.1).groupBy("obs").agg(F.collect_list(F.struct("feat", "value")).alias("c"))
    sparse = sparse.select("obs", F.transform("c", lambda x: x["feat"]).alias("indices"), F.transform("c", lambda x: x["value"]).alias("values"))
    return reshape.densified(sparse, spark.range(64).select(F.col("id").cast("int").alias("idx"), F.col("id").cast("int").alias("feat")))


@REG.add("io09_label_csv", "SELECT CAST(c_custkey AS VARCHAR) AS bc, c_mktsegment AS ct FROM customer")
def io09(spark: SparkSession, d: str) -> DataFrame:
    path = scratch_path(spark, "labels")
    table(spark, d, "customer", "c_custkey", "c_mktsegment", "c_name").write.option("header", True).csv(path)
    return tables.label_csv(spark, path)


@REG.add("io10_feature_csv", "SELECT DISTINCT p_brand AS feat FROM part")
def io10(spark: SparkSession, d: str) -> DataFrame:
    path = scratch_path(spark, "features") + ".csv"
    table(spark, d, "part", "p_brand").distinct().write.option("header", True).csv(path)
    return tables.feature_csv(spark, path)


@REG.add("io13_latest_run", "SELECT max(npz_id) AS npz_id FROM bulk_nmic")
def io13(spark: SparkSession, d: str) -> DataFrame:
    """Runs as files of their own; the alphabetically last one is taken."""
    path = scratch_path(spark, "runs")
    table(spark, d, "bulk_nmic", "npz_id", "u", "v", "w").where("npz_id is not null").repartition("npz_id").write.partitionBy("npz_id").parquet(path)
    last = graphs.latest(spark, f"{path}/*/*.parquet")
    return spark.createDataFrame([(last.rpartition("/")[0].rpartition("npz_id=")[2],)], "npz_id string")


@REG.add("io16_predictions", "SELECT vec_id AS obs, CAST(embedding AS DOUBLE[]) AS embedding, 'b' AS run FROM embeddings")
def io16(spark: SparkSession, d: str) -> DataFrame:
    path = scratch_path(spark, "predictions")
    e = table(spark, d, "embeddings", "vec_id", "embedding").select(F.col("vec_id").alias("obs"), F.col("embedding").cast("array<double>").alias("embedding"))
    for run in ("a", "b"):
        graphs.write_predictions(e, path, run)
    return graphs.read_predictions(spark, path, "b")


@REG.add("io21_vocabulary_matrix", f"WITH {SUPPLIER_BRAND} SELECT obs, " + ", ".join(f"coalesce(max(value) FILTER (WHERE feat = 'Brand#{i}'), 0) AS \"Brand#{i}\"" for i in (30, 5, 12, 99)) + " FROM sb GROUP BY obs")
def io21(spark: SparkSession, d: str) -> DataFrame:
    """A matrix written again in a vocabulary's order, absent features 0."""
    names = [f"Brand#{i}" for i in (30, 5, 12, 99)]
    voc = spark.createDataFrame([(n,) for n in names], "feat string")
    return reshape.to_wide(reshape.aligned(supplier_brand(spark, d), voc), names)


@REG.add("io27_network_store", f"WITH {_STATES} SELECT count(*) AS n_edges, round(avg(delta_w), 6) AS mean, round(quantile_cont(delta_w, 0.5), 6) AS median FROM dl")
def io27(spark: SparkSession, d: str) -> DataFrame:
    path = scratch_path(spark, "network")
    genes = supplier_brand(spark, d).select(F.col("feat").alias("gene_name")).distinct()
    graphs.write_network(_delta(spark, d), genes, path)
    return spark.read.json(f"{path}/summary").select("n_edges", F.round("mean", 6).alias("mean"), F.round("median", 6).alias("median"))


@REG.add("io28_gene_sets", "SELECT n_name AS name, r_name AS module_id FROM nation JOIN region ON n_regionkey = r_regionkey")
def io28(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation", "n_nationkey", "n_name", "n_regionkey")
    m = n.join(table(spark, d, "region", "r_regionkey", "r_name"), F.expr("n_regionkey = r_regionkey")).select(F.col("n_nationkey").alias("node"), F.col("r_name").alias("module_id"))
    path = scratch_path(spark, "modules")
    graphs.write_modules(m, n.select(F.col("n_nationkey").alias("idx"), F.col("n_name").alias("name")), m, path)
    return spark.read.option("basePath", f"{path}/gene_sets").text(f"{path}/gene_sets").select(F.col("value").alias("name"), "module_id")


@REG.add("nm02_bins", f"""
WITH {EMB}, r AS (SELECT feat, value, row_number() OVER (PARTITION BY feat ORDER BY value, obs) AS r, count(*) OVER (PARTITION BY feat) AS n FROM emb),
s AS (SELECT feat, any_value(n) AS n, min(value) AS lo, max(value) AS hi, 2 * (max(value) FILTER (WHERE r = floor(n * 0.75 + 0.5)) - max(value) FILTER (WHERE r = floor(n * 0.5 + 0.5))) / cbrt(CAST(any_value(n) AS DOUBLE)) AS width FROM r GROUP BY feat)
SELECT feat, n, lo, hi, round(width, 9) AS width, CAST(CASE WHEN ceil((hi - lo) / width) BETWEEN 3 AND n THEN ceil((hi - lo) / width) END AS INTEGER) AS n_bins FROM s""")
def nm02(spark: SparkSession, d: str) -> DataFrame:
    return stats.upper_bins(embedding_long(spark, d)).withColumn("width", F.round("width", 9))


@REG.add("nm04_full_information", f"""
WITH {EMB}, r AS (SELECT feat, obs, value, row_number() OVER (PARTITION BY feat ORDER BY value, obs) AS r, count(*) OVER (PARTITION BY feat) AS n FROM emb),
s AS (SELECT feat, any_value(n) AS n, min(value) AS lo, max(value) AS hi, 2 * (max(value) FILTER (WHERE r = floor(n * 0.75 + 0.5)) - max(value) FILTER (WHERE r = floor(n * 0.5 + 0.5))) / cbrt(CAST(any_value(n) AS DOUBLE)) AS w FROM r GROUP BY feat),
b AS (SELECT *, ceil((hi - lo) / w) AS k FROM s WHERE w > 0 AND ceil((hi - lo) / w) BETWEEN 3 AND n),
c AS (SELECT feat, obs, k, b.n, greatest(floor((value - lo) / w + 0.5) - 1, 0) AS c FROM emb JOIN b USING (feat)),
j AS (SELECT x.feat AS i, y.feat AS j, x.c AS cx, y.c AS cy, any_value(x.k) AS kx, any_value(y.k) AS ky, any_value(x.n) AS n, count(*) AS m FROM c x JOIN c y ON x.obs = y.obs AND x.feat < y.feat GROUP BY x.feat, y.feat, x.c, y.c),
p AS (SELECT *, sum(m) OVER (PARTITION BY i, j, cx) AS mx, sum(m) OVER (PARTITION BY i, j, cy) AS my FROM j)
SELECT i AS src, j AS dst, round(sum(m / n * log2(m * n / (mx * my))) / any_value(log2(sqrt(kx * ky))), 6) AS w FROM p GROUP BY i, j""")
def nm04(spark: SparkSession, d: str) -> DataFrame:
    """Information over the full range alone; pairs without usable bins are 0 and
    left out here, as in the oracle."""
    out = nmic.all_pairs(embedding_long(spark, d), [])
    return out.where("w <> 0").withColumn("w", F.round("w", 6))


@REG.add("st01_event_windows", "SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def st01(spark: SparkSession, d: str) -> DataFrame:
    """Event-time windows by Structured Streaming, run to the end of the table."""
    path, ck = scratch_path(spark, "stream"), scratch_path(spark, "progress")
    src = scratch_path(spark, "events")
    table(spark, d, "events", "ts", "event_type", "value").write.parquet(src)
    updates.complete_to_end(updates.event_windows(updates.read_table(spark, src, 1000), "1 day"), path, ck)
    return spark.read.parquet(path).select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@REG.add("st02_streamed_degrees", f"WITH {NMIC_EDGES}, e AS (SELECT u AS node FROM nm UNION ALL SELECT v FROM nm) SELECT node, count(*) AS degree FROM e GROUP BY node")
def st02(spark: SparkSession, d: str) -> DataFrame:
    path, ck, src = scratch_path(spark, "stream"), scratch_path(spark, "progress"), scratch_path(spark, "edges")
    nmic_edges(spark, d).repartition(4, "u").write.parquet(src)
    updates.complete_to_end(updates.degree_counts(updates.read_table(spark, src, 2)), path, ck)
    return spark.read.parquet(path).select("node", "degree")


@REG.add("so07_degrees_of_all", "SELECT n_nationkey AS node, 0 AS degree FROM nation")
def so07(spark: SparkSession, d: str) -> DataFrame:
    """Nodes of a graph without any edge are kept."""
    none = spark.createDataFrame([], "u long, v long")
    return network.with_isolated(none, table(spark, d, "nation", "n_nationkey").select(F.col("n_nationkey").cast("long").alias("node")))
