"""Graph operators: edges, samples, networks, modules, intervals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plexora.functions import scalar as S
from plexora.operators.communities import communities, modularity
from plexora.operators import edges as E
from plexora.operators import greedy, intervals, network, reshape, samples, stats
from plexora.plans.inputs import FUSED_EDGES, NMIC_EDGES, ORDER_BRAND, VOCABULARY, fused_edges, nmic_edges, order_brand, raw_edges, vocabulary
from plexora.plans.registry import Registry
from plexora.session import materialize, small_side, table

REG = Registry()
_RAW = ("src_expanded_idx", "dst_expanded_idx", "edge_weight")
_OK = "src_expanded_idx >= 0 AND dst_expanded_idx >= 0 AND src_expanded_idx <> dst_expanded_idx AND edge_weight IS NOT NULL AND NOT isnan(edge_weight)"


def _r(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


# --------------------------------------------------------------------- edges


@REG.add("ag05_canonical_edges", f"WITH {FUSED_EDGES} SELECT u, v, w FROM fe")
def ag05(spark: SparkSession, d: str) -> DataFrame:
    return fused_edges(spark, d)


@REG.add("ag06_fused_sources", f"""
WITH p AS (SELECT least(src_expanded_idx, dst_expanded_idx) AS u, greatest(src_expanded_idx, dst_expanded_idx) AS v, edge_source, edge_type, max(CAST(edge_weight AS DOUBLE)) AS w FROM edge_source WHERE {_OK} GROUP BY ALL)
SELECT u, v, round(sum(w), 6) AS w, min(edge_source) AS source, min(edge_type) AS kind, count(DISTINCT edge_source) AS n_sources FROM p GROUP BY u, v""")
def ag06(spark: SparkSession, d: str) -> DataFrame:
    return _r(E.fuse(raw_edges(spark, d), *_RAW, "edge_source", "edge_type"), 6, "w")


@REG.add("ag10_edge_support", "SELECT least(u, v) AS u, greatest(u, v) AS v, count(DISTINCT npz_id) AS n FROM bulk_nmic WHERE u >= 0 AND v >= 0 AND u <> v GROUP BY ALL")
def ag10(spark: SparkSession, d: str) -> DataFrame:
    return E.support(table(spark, d, "bulk_nmic", "npz_id", "u", "v"), "u", "v", "npz_id")


_DEGREE = "dg AS (SELECT node, count(*) AS degree, sum(w) AS strength FROM (SELECT u AS node, w FROM {t} UNION ALL SELECT v, w FROM {t}) GROUP BY node)"


@REG.add("ag12_weighted_degree", f"WITH {NMIC_EDGES}, {_DEGREE.format(t='nm')} SELECT node, degree, round(strength, 6) AS strength FROM dg")
def ag12(spark: SparkSession, d: str) -> DataFrame:
    return _r(E.weighted_degree(nmic_edges(spark, d)), 6, "strength")


@REG.add("ag22_quantile_threshold", f"WITH {NMIC_EDGES} SELECT round(quantile_cont(w, 0.9), 9) AS cut FROM nm")
def ag22(spark: SparkSession, d: str) -> DataFrame:
    cut = stats.linear_quantile(materialize(nmic_edges(spark, d), "edges"), "w", 0.9)
    return spark.createDataFrame([(cut,)], "cut double").select(F.round("cut", 9).alias("cut"))


@REG.add("pr04_edge_threshold", f"WITH {NMIC_EDGES} SELECT * FROM nm WHERE w > 0.3")
def pr04(spark: SparkSession, d: str) -> DataFrame:
    return nmic_edges(spark, d).where("w > 0.3")


@REG.add("pr06_quantile_filter", f"WITH {NMIC_EDGES} SELECT * FROM nm WHERE w >= (SELECT quantile_cont(w, 0.8) FROM nm)")
def pr06(spark: SparkSession, d: str) -> DataFrame:
    return stats.quantile_filter(nmic_edges(spark, d), "w", q=0.8)


@REG.add("pr06_inclusive_threshold", f"WITH {NMIC_EDGES} SELECT * FROM nm WHERE w >= 0.25")
def pr06_threshold(spark: SparkSession, d: str) -> DataFrame:
    return stats.quantile_filter(nmic_edges(spark, d), "w", threshold=0.25, q=0.99)


@REG.add("pr07_strongest_threshold", f"WITH {NMIC_EDGES} SELECT u, v, round(w * 0.30, 9) AS w FROM nm WHERE w >= greatest(0.2, (SELECT quantile_cont(w, 0.95) FROM nm))")
def pr07(spark: SparkSession, d: str) -> DataFrame:
    return _r(E.prior_edges(nmic_edges(spark, d), [0.2, None], 0.95, 0.30), 9, "w")


@REG.add("pr09_loaded_edges", f"""
SELECT src_expanded_idx AS u, dst_expanded_idx AS v, CAST(edge_weight AS DOUBLE) AS w, coalesce(edge_type, 'unknown') AS type_u, 0.0::DOUBLE AS delta_w, 'unknown' AS type_v, abs(CAST(edge_weight AS DOUBLE)) AS strength
FROM edge_source WHERE src_expanded_idx <> dst_expanded_idx AND edge_weight IS NOT NULL AND NOT isnan(edge_weight) AND edge_weight <> 0""")
def pr09(spark: SparkSession, d: str) -> DataFrame:
    e = raw_edges(spark, d).select(F.col("src_expanded_idx").alias("u"), F.col("dst_expanded_idx").alias("v"), F.col("edge_weight").cast("double").alias("w"), F.col("edge_type").alias("type_u"))
    return network.load_edges(e)


_TYPED = f"""{VOCABULARY}, ty AS (SELECT e.*, CASE WHEN a.old_or_new = 'new' AND b.old_or_new = 'new' THEN 'new-new' WHEN a.old_or_new = 'new' OR b.old_or_new = 'new' THEN 'old-new' ELSE 'old-old' END AS edge_type
  FROM nm e JOIN vo a ON a.idx = e.u JOIN vo b ON b.idx = e.v)"""


@REG.add("pr13_edge_types", f"WITH {NMIC_EDGES}, {_TYPED} SELECT * FROM ty")
def pr13(spark: SparkSession, d: str) -> DataFrame:
    return E.typed_edges(nmic_edges(spark, d), vocabulary(spark, d))


@REG.add("gr15_bridge_edges", f"WITH {NMIC_EDGES}, {_TYPED} SELECT * FROM ty WHERE edge_type = 'old-new'")
def gr15(spark: SparkSession, d: str) -> DataFrame:
    return E.bridge_edges(nmic_edges(spark, d), vocabulary(spark, d))


@REG.add("wn07_directed_top", f"WITH {NMIC_EDGES} SELECT u, v, w FROM nm QUALIFY row_number() OVER (PARTITION BY u ORDER BY w DESC, v) <= 3")
def wn07(spark: SparkSession, d: str) -> DataFrame:
    return E.directed_top(nmic_edges(spark, d), 3)


_UNDIRECTED = """ut AS (SELECT DISTINCT least(node, other) AS u, greatest(node, other) AS v, w FROM (
  SELECT * FROM (SELECT u AS node, v AS other, w FROM {t} UNION ALL SELECT v, u, w FROM {t}) QUALIFY row_number() OVER (PARTITION BY node ORDER BY w DESC, other) <= {k}))"""


@REG.add("wn08_undirected_top", f"WITH {NMIC_EDGES}, {_UNDIRECTED.format(t='nm', k=2)} SELECT * FROM ut")
def wn08(spark: SparkSession, d: str) -> DataFrame:
    return E.undirected_top(nmic_edges(spark, d), 2)


@REG.add("sl01_sorted_edges", f"WITH {NMIC_EDGES} SELECT u, v, w FROM nm ORDER BY w DESC, u, v")
def sl01(spark: SparkSession, d: str) -> DataFrame:
    return nmic_edges(spark, d).orderBy(F.desc("w"), "u", "v")


@REG.add("sl02_multi_key_sort", "SELECT edge_source, edge_type, edge_id FROM edge_source ORDER BY edge_source, edge_type DESC, edge_id")
def sl02(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "edge_source", "edge_source", "edge_type", "edge_id").orderBy("edge_source", F.desc("edge_type"), "edge_id")


@REG.add("sl03_global_top", f"WITH {NMIC_EDGES} SELECT u, v, w FROM nm ORDER BY w DESC, u, v LIMIT 100")
def sl03(spark: SparkSession, d: str) -> DataFrame:
    return E.global_top(nmic_edges(spark, d), 100)


@REG.add("sl04_top_fraction", f"WITH {NMIC_EDGES} SELECT u, v, w FROM nm QUALIFY row_number() OVER (ORDER BY w DESC, u, v) <= ceil((SELECT count(*) FROM nm) * 0.05)")
def sl04(spark: SparkSession, d: str) -> DataFrame:
    return E.top_fraction(nmic_edges(spark, d), 0.05)


@REG.add("sl05_highest_value", "SELECT npz_id, max(w) FILTER (WHERE NOT isnan(w)) AS w, bool_or(isnan(w)) AS has_nan FROM bulk_nmic GROUP BY npz_id")
def sl05(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "bulk_nmic", "npz_id", "w").groupBy("npz_id")
    return g.agg(F.max(F.when(~F.isnan("w"), F.col("w"))).alias("w"), F.isnan(F.max("w")).alias("has_nan"))


@REG.add("gr04_feature_mapping", """
WITH m AS (SELECT DISTINCT processed_local_idx, mat_feat_idx, feature_name, expanded_idx FROM feature_mapping),
f AS (SELECT DISTINCT mat_feat_idx AS i FROM feature_mapping), s AS (SELECT i, row_number() OVER (ORDER BY i) - 1 AS r FROM f)
SELECT m.feature_name, m.expanded_idx, m.mat_feat_idx AS full_index, s.r AS selected_local FROM m JOIN s ON s.i = m.mat_feat_idx""")
def gr04(spark: SparkSession, d: str) -> DataFrame:
    """Features by their index in the whole matrix and by their place in the selection."""
    m = table(spark, d, "feature_mapping", "processed_local_idx", "mat_feat_idx", "feature_name", "expanded_idx").distinct()
    place = reshape.numbered(m.where("mat_feat_idx is not null").select("mat_feat_idx").distinct(), ["mat_feat_idx"], "selected_local")
    return m.join(place, "mat_feat_idx").select("feature_name", "expanded_idx", F.col("mat_feat_idx").alias("full_index"), "selected_local")


@REG.add("gr05_mapping_agreement", """
WITH e AS (SELECT DISTINCT src_expanded_idx AS i, lower(trim(src)) AS n FROM edge_source WHERE src_expanded_idx >= 0 AND src IS NOT NULL),
m AS (SELECT DISTINCT expanded_idx AS i, lower(trim(feature_name)) AS n FROM feature_mapping)
SELECT count(*) AS n_pairs, count(m.n) AS n_agree, count(*) - count(m.n) AS n_differ FROM e LEFT JOIN m USING (i, n)""")
def gr05(spark: SparkSession, d: str) -> DataFrame:
    """How far names and indexes of edge ends agree with the mapping."""
    name = lambda c: F.lower(F.trim(c))
    e = table(spark, d, "edge_source", "src_expanded_idx", "src").where("src_expanded_idx >= 0 and src is not null").select(F.col("src_expanded_idx").alias("i"), name("src").alias("n")).distinct()
    m = table(spark, d, "feature_mapping", "expanded_idx", "feature_name").select(F.col("expanded_idx").alias("i"), name("feature_name").alias("n"), F.lit(1).alias("hit")).distinct()
    j = e.join(m, ["i", "n"], "left")
    return j.agg(F.count(F.lit(1)).alias("n_pairs"), F.count("hit").alias("n_agree"), F.count_if(F.col("hit").isNull()).alias("n_differ"))


@REG.add("gr06_expanded_vocabulary", f"""
WITH {VOCABULARY}, o AS (SELECT name, row_number() OVER (ORDER BY name) - 1 AS idx FROM (SELECT DISTINCT name FROM vo WHERE old_or_new = 'old')),
n AS (SELECT name, row_number() OVER (ORDER BY name) - 1 + (SELECT count(*) FROM o) AS idx FROM (SELECT DISTINCT feature_name AS name FROM feature_mapping WHERE feature_name IS NOT NULL AND feature_name NOT IN (SELECT name FROM o)))
SELECT name, idx, 'old' AS old_or_new FROM o UNION ALL SELECT name, idx, 'new' FROM n""")
def gr06(spark: SparkSession, d: str) -> DataFrame:
    old = vocabulary(spark, d).where("old_or_new = 'old'").select("name").distinct()
    old = reshape.numbered(old, ["name"], "idx")
    return E.expand_vocabulary(old, table(spark, d, "feature_mapping", "feature_name").withColumnRenamed("feature_name", "name"))


@REG.add("gr07_index_space", """
WITH e AS (SELECT u AS node FROM bulk_nmic WHERE u >= 0 AND v >= 0 UNION ALL SELECT v FROM bulk_nmic WHERE u >= 0 AND v >= 0),
s AS (SELECT avg(CASE WHEN node IN (SELECT mat_feat_idx FROM feature_mapping) THEN 1.0 ELSE 0 END) AS share_listed, max(node) AS max_idx FROM e)
SELECT CASE WHEN share_listed > 0.99 THEN 'mat' WHEN max_idx < 4800 THEN 'local' ELSE 'unknown' END AS space, round(share_listed, 9) AS share_listed, max_idx FROM s""")
def gr07(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "bulk_nmic", "u", "v").where("u >= 0 and v >= 0")
    return _r(E.index_space(e, table(spark, d, "feature_mapping", "mat_feat_idx").where("mat_feat_idx is not null"), 4800), 9, "share_listed")


_BUILD = f"""
WITH r AS (SELECT u, v, w FROM bulk_nmic WHERE w IS NOT NULL AND NOT isnan(w)), q AS (SELECT quantile_cont(w, 0.5) AS q FROM r),
m AS (SELECT DISTINCT expanded_idx AS o, expanded_idx AS n FROM feature_mapping),
k AS (SELECT least(a.n, b.n) AS u, greatest(a.n, b.n) AS v, max(w) AS w FROM r JOIN m a ON a.o = r.u JOIN m b ON b.o = r.v WHERE w >= (SELECT q FROM q) AND a.n >= 0 AND b.n >= 0 AND a.n <> b.n GROUP BY ALL),
{_UNDIRECTED.format(t='k', k=5)},
c AS (SELECT u, v, w FROM ut ORDER BY w DESC, u, v LIMIT 5000),
a AS (SELECT least(u, v) AS u, greatest(u, v) AS v, max(w) AS w FROM r WHERE u >= 0 AND v >= 0 AND u <> v GROUP BY ALL),
f AS (SELECT DISTINCT least(src_expanded_idx, dst_expanded_idx) AS u, greatest(src_expanded_idx, dst_expanded_idx) AS v FROM edge_source WHERE lower(trim(edge_source)) = 'bulk_force_keep' AND src_expanded_idx <> dst_expanded_idx),
x AS (SELECT u, v, w FROM a JOIN f USING (u, v))
"""


@REG.add("gr08_bulk_edges", _BUILD + "SELECT u, v, round(max(w) * 0.5, 9) AS w FROM (SELECT * FROM c UNION ALL SELECT * FROM x) GROUP BY u, v")
def gr08(spark: SparkSession, d: str) -> DataFrame:
    """The whole edge build: quantile, renaming, canonical form, top 5 of either
    end, 5,000 strongest, scale, forced pairs."""
    ids = table(spark, d, "feature_mapping", "expanded_idx").where("expanded_idx is not null").select(F.col("expanded_idx").alias("old"), F.col("expanded_idx").alias("new"))
    return _r(E.build_edges(table(spark, d, "bulk_nmic", "u", "v", "w"), ids, None, 0.5, 5, 5000, 0.5, _forced(spark, d)), 9, "w")


def _forced(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "edge_source", "src_expanded_idx", "dst_expanded_idx", "edge_source")
    f = e.where((F.lower(F.trim("edge_source")) == "bulk_force_keep") & (F.col("src_expanded_idx") != F.col("dst_expanded_idx")))
    return f.select(F.col("src_expanded_idx").alias("u"), F.col("dst_expanded_idx").alias("v"))


@REG.add("gr09_prior_edges", f"WITH {NMIC_EDGES} SELECT u, v, round(w * 0.30, 9) AS w FROM nm WHERE w >= (SELECT quantile_cont(w, 0.995) FROM nm)")
def gr09(spark: SparkSession, d: str) -> DataFrame:
    return _r(E.prior_edges(nmic_edges(spark, d)), 9, "w")


@REG.add("gr10_forced_pairs", f"""
WITH {NMIC_EDGES}, f AS (SELECT DISTINCT least(src_expanded_idx, dst_expanded_idx) AS u, greatest(src_expanded_idx, dst_expanded_idx) AS v FROM edge_source WHERE lower(trim(edge_source)) = 'bulk_force_keep' AND src_expanded_idx <> dst_expanded_idx)
SELECT f.u, f.v, nm.w FROM f LEFT JOIN nm USING (u, v)""")
def gr10(spark: SparkSession, d: str) -> DataFrame:
    return E.forced_pairs(nmic_edges(spark, d), _forced(spark, d))


@REG.add("gr11_knn_completion", f"""
WITH x AS (SELECT l_suppkey AS obs, p_size AS feat, CAST(sum(l_quantity) AS DOUBLE) AS value FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL),
lo AS (SELECT DISTINCT feat FROM x WHERE feat > 40), ol AS (SELECT DISTINCT feat FROM x WHERE feat <= 40),
r AS (SELECT a.feat AS n, b.feat AS o, abs(corr(a.value, b.value)) AS c FROM x a JOIN lo ON lo.feat = a.feat JOIN x b ON b.obs = a.obs JOIN ol ON ol.feat = b.feat GROUP BY ALL HAVING stddev_pop(a.value) > 1e-12 AND stddev_pop(b.value) > 1e-12),
k AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY n ORDER BY c DESC, o) <= 5)
SELECT CAST(least(n, o) AS BIGINT) AS u, CAST(greatest(n, o) AS BIGINT) AS v, round(c * 0.25, 6) AS w FROM k WHERE c >= 0.05""")
def gr11(spark: SparkSession, d: str) -> DataFrame:
    """New features (part sizes above 40) without any link to the old ones."""
    part = table(spark, d, "part", "p_partkey", "p_size")
    x = table(spark, d, "lineitem", "l_suppkey", "l_partkey", "l_quantity").join(small_side(part), F.expr("l_partkey = p_partkey"))
    long = materialize(x.groupBy(F.col("l_suppkey").alias("obs"), F.col("p_size").cast("long").alias("feat")).agg(F.sum("l_quantity").cast("double").alias("value")), "long")
    voc = long.select(F.col("feat").alias("idx")).distinct().withColumn("old_or_new", F.when(F.col("idx") > 40, "new").otherwise("old"))
    none = spark.createDataFrame([], "u long, v long, w double")
    return _r(E.knn_completion(long, voc, none, 5, 0.05, 0.25), 6, "w")


@REG.add("gr12_canonical_table", """
SELECT least(src_expanded_idx, dst_expanded_idx) AS src_expanded_idx, greatest(src_expanded_idx, dst_expanded_idx) AS dst_expanded_idx,
  CASE WHEN src_expanded_idx > dst_expanded_idx THEN dst ELSE src END AS src, CASE WHEN src_expanded_idx > dst_expanded_idx THEN src ELSE dst END AS dst, CASE WHEN NOT isnan(edge_weight) THEN edge_weight END AS edge_weight, edge_source, edge_type
FROM edge_source WHERE src_expanded_idx <> dst_expanded_idx""")
def gr12(spark: SparkSession, d: str) -> DataFrame:
    return E.canonical_table(raw_edges(spark, d))


@REG.add("gr25_strongest_edge", f"""
WITH e AS (SELECT least(src_expanded_idx, dst_expanded_idx) AS u, greatest(src_expanded_idx, dst_expanded_idx) AS v, edge_weight AS w, edge_source, edge_type FROM edge_source WHERE {_OK})
SELECT u, v, CAST(w AS DOUBLE) AS w, edge_source, edge_type FROM e QUALIFY row_number() OVER (PARTITION BY u, v ORDER BY w DESC, edge_source DESC NULLS LAST, edge_type DESC NULLS LAST) = 1""")
def gr25(spark: SparkSession, d: str) -> DataFrame:
    return E.canonical_best(raw_edges(spark, d), *_RAW, ["edge_source", "edge_type"]).withColumn("w", F.col("w").cast("double"))


@REG.add("jn06_index_lookup", f"""
WITH {NMIC_EDGES}, m AS (SELECT DISTINCT expanded_idx AS o, expanded_idx * 2 AS n FROM feature_mapping WHERE old_or_new = 'old')
SELECT a.n AS u, b.n AS v, w FROM nm JOIN m a ON a.o = nm.u JOIN m b ON b.o = nm.v""")
def jn06(spark: SparkSession, d: str) -> DataFrame:
    """Ends renamed through a lookup; edges of dropped features go."""
    m = table(spark, d, "feature_mapping", "expanded_idx", "old_or_new").where("old_or_new = 'old'").select(F.col("expanded_idx").alias("old"), (F.col("expanded_idx") * 2).alias("new"))
    return E.mapped(nmic_edges(spark, d), m)


@REG.add("so07_isolated_nodes", f"""
WITH {NMIC_EDGES}, e AS (SELECT u AS node FROM nm UNION ALL SELECT v FROM nm), c AS (SELECT node, count(*) AS degree FROM e GROUP BY node)
SELECT node, coalesce(degree, 0) AS degree FROM (SELECT DISTINCT expanded_idx AS node FROM feature_mapping UNION SELECT node FROM c) LEFT JOIN c USING (node)""")
def so07(spark: SparkSession, d: str) -> DataFrame:
    nodes = table(spark, d, "feature_mapping", "expanded_idx").where("expanded_idx is not null").select(F.col("expanded_idx").alias("node"))
    return network.with_isolated(nmic_edges(spark, d), nodes)


@REG.add("so05_node_union", f"WITH {NMIC_EDGES} SELECT u AS node FROM nm UNION SELECT v FROM nm UNION SELECT expanded_idx FROM feature_mapping WHERE old_or_new = 'new'")
def so05(spark: SparkSession, d: str) -> DataFrame:
    e = nmic_edges(spark, d)
    new = table(spark, d, "feature_mapping", "expanded_idx", "old_or_new").where("old_or_new = 'new'").select("expanded_idx")
    return e.select(F.col("u").alias("node")).union(e.select("v")).union(new).distinct()


@REG.add("gr20_k_hop", f"""
WITH {NMIC_EDGES}, s AS (SELECT u AS node FROM nm ORDER BY w DESC, u, v LIMIT 1), h1 AS (SELECT node AS seed, node FROM s UNION SELECT s.node, nm.u FROM s JOIN nm ON nm.v = s.node)
SELECT * FROM h1 UNION SELECT h1.seed, nm.u FROM h1 JOIN nm ON nm.v = h1.node""")
def gr20(spark: SparkSession, d: str) -> DataFrame:
    """Two hops back from the smaller end of the strongest edge."""
    e = materialize(nmic_edges(spark, d), "edges")
    return E.k_hop(e, e.orderBy(F.desc("w"), "u", "v").limit(1).select(F.col("u").alias("node")), 2)


_MEANS = """uv AS (SELECT node_gene_ids AS node, model_state AS st, node_embeddings AS vec FROM node_embeddings
  WHERE node_gene_ids IS NOT NULL AND len(node_embeddings) = 64 AND len(list_filter(node_embeddings, lambda y: y IS NULL OR isnan(y))) = 0),
lv AS (SELECT node, st, unnest(range(64)) AS pos, CAST(unnest(vec) AS DOUBLE) AS x FROM uv),
mv AS (SELECT node, st, list(m ORDER BY pos) AS vec FROM (SELECT node, st, pos, avg(x) AS m FROM lv GROUP BY ALL) GROUP BY ALL),
nv AS (SELECT node, st, count(*) AS n FROM uv GROUP BY ALL)"""


# ------------------------------------------------------------------- samples

# order x brand values, brands that occur together as edges
_BRANDS = f"""{ORDER_BRAND},
co AS (SELECT a.feat AS u, b.feat AS v, CAST(count(*) AS DOUBLE) AS n FROM ob a JOIN ob b ON a.obs = b.obs AND a.feat < b.feat GROUP BY ALL),
ed AS (SELECT u, v, n / (SELECT max(n) FROM co) AS w FROM co),
cv AS (SELECT feat, CASE WHEN avg(value) > 1e-8 THEN stddev_pop(value) / avg(value) ELSE 0 END AS cv FROM ob GROUP BY feat)"""


# the key of a weighted draw from 52 bits of an md5
_DRAWN = "-ln((CAST(('0x' || substr(md5('17:' || CAST(obs AS VARCHAR) || ':' || feat), 1, 13)) AS BIGINT) + 0.5) / 4503599627370496) / (pow(abs(value), 0.25) / sqrt(n + 1))"


def _brand_graph(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    long = materialize(order_brand(spark, d), "orders")
    a = long.select("obs", F.col("feat").alias("u"))
    b = long.select("obs", F.col("feat").alias("v"))
    co = materialize(a.join(b, "obs").where("u < v").groupBy("u", "v").agg(F.count(F.lit(1)).cast("double").alias("n")), "together")
    edges = co.select("u", "v", (F.col("n") / co.agg(F.max("n")).scalar()).alias("w"))
    return long, edges, stats.feature_stats(long).select("feat", "cv")


_SAMPLE = f"""WITH {_BRANDS},
lv AS (SELECT * FROM ob WHERE abs(value) > 1e-6),
tp AS (SELECT feat FROM cv ORDER BY cv DESC, feat LIMIT 3),
ch AS MATERIALIZED (SELECT DISTINCT a.obs, unnest([u, v]) AS feat FROM lv a JOIN lv b ON b.obs = a.obs AND b.feat > a.feat JOIN ed ON ed.u = a.feat AND ed.v = b.feat AND ed.w > 0.9 UNION SELECT obs, feat FROM lv WHERE feat IN (SELECT feat FROM tp)),
rk AS MATERIALIZED (SELECT lv.obs, lv.feat, lv.value, ch.feat IS NOT NULL AS chosen, row_number() OVER (PARTITION BY lv.obs ORDER BY CASE WHEN ch.feat IS NOT NULL THEN 0 ELSE 1 END, cv.cv DESC NULLS LAST, lv.feat) AS r
       FROM lv LEFT JOIN ch ON ch.obs = lv.obs AND ch.feat = lv.feat LEFT JOIN cv ON cv.feat = lv.feat),
nd AS MATERIALIZED (SELECT obs, feat, value, CAST(row_number() OVER (PARTITION BY obs ORDER BY feat) - 1 AS INTEGER) AS idx FROM rk WHERE chosen OR r <= 2),
ie AS (SELECT a.obs, u, v, w, a.idx AS iu, b.idx AS iv FROM nd a JOIN nd b ON b.obs = a.obs AND b.feat > a.feat JOIN ed ON ed.u = a.feat AND ed.v = b.feat)
"""


@REG.add("gr01_sample_nodes", _SAMPLE + "SELECT obs, feat, value, idx FROM nd")
def gr01_nodes(spark: SparkSession, d: str) -> DataFrame:
    return samples.active_subgraphs(*_brand_graph(spark, d), 0.9, 3, 2)[0]


@REG.add("gr01_sample_edges", _SAMPLE + "SELECT obs, u, v, round(w, 9) AS w, iu, iv FROM ie")
def gr01_edges(spark: SparkSession, d: str) -> DataFrame:
    return _r(samples.active_subgraphs(*_brand_graph(spark, d), 0.9, 3, 2)[1], 9, "w")


@REG.add("wn15_minimum_fill", f"""
WITH {_BRANDS} SELECT obs, feat, value, CAST(row_number() OVER (PARTITION BY obs ORDER BY feat) - 1 AS INTEGER) AS idx FROM (
  SELECT ob.*, row_number() OVER (PARTITION BY obs ORDER BY cv.cv DESC, ob.feat) AS r FROM ob JOIN cv USING (feat) WHERE abs(value) > 1e-6) WHERE r <= 3""")
def wn15(spark: SparkSession, d: str) -> DataFrame:
    """No edge is strong enough and no feature preset: the fill alone chooses."""
    return samples.active_subgraphs(*_brand_graph(spark, d), 2.0, 0, 3)[0]


@REG.add("gr02_heldout_samples", _SAMPLE.replace("lv AS (SELECT * FROM ob WHERE abs(value) > 1e-6)", "lv AS (SELECT ob.* FROM ob JOIN orders ON o_orderkey = obs WHERE abs(value) > 1e-6 AND o_orderstatus = 'F')") + "SELECT obs, count(*) AS n_nodes FROM nd GROUP BY obs")
def gr02(spark: SparkSession, d: str) -> DataFrame:
    """Held-out samples (closed orders) with the edges and cv of all of them."""
    long, edges, cv = _brand_graph(spark, d)
    held = table(spark, d, "orders", "o_orderkey", "o_orderstatus").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("obs"))
    nodes, _ = samples.active_subgraphs(long.join(held, "obs", "left_semi"), edges, cv, 0.9, 3, 2)
    return nodes.groupBy("obs").agg(F.count(F.lit(1)).alias("n_nodes"))


@REG.add("ag20_graph_sizes", _SAMPLE + """, n AS (SELECT obs, count(*) AS n FROM nd GROUP BY obs)
SELECT count(*) AS graphs, min(n) AS min, quantile_cont(n, 0.5) AS median, round(avg(n), 6) AS mean, quantile_cont(n, 0.9) AS p90, quantile_cont(n, 0.95) AS p95, max(n) AS max FROM n""")
def ag20(spark: SparkSession, d: str) -> DataFrame:
    return _r(samples.size_summary(samples.active_subgraphs(*_brand_graph(spark, d), 0.9, 3, 2)[0]), 6, "mean")


@REG.add("wn14_top_absolute", f"WITH {ORDER_BRAND}, r AS (SELECT *, row_number() OVER (PARTITION BY obs ORDER BY abs(value) DESC, feat) AS r FROM ob WHERE abs(value) > 1e-8) SELECT obs, feat, value, CAST(row_number() OVER (PARTITION BY obs ORDER BY feat) - 1 AS INTEGER) AS idx FROM r WHERE r <= 3")
def wn14(spark: SparkSession, d: str) -> DataFrame:
    return samples.top_absolute(order_brand(spark, d), 3)


@REG.add("gr13_strict_selection", f"WITH {ORDER_BRAND}, r AS (SELECT *, row_number() OVER (PARTITION BY obs ORDER BY abs(value) DESC, feat) AS r FROM ob) SELECT obs, feat, value, CAST(row_number() OVER (PARTITION BY obs ORDER BY feat) - 1 AS INTEGER) AS idx FROM r WHERE r <= 2")
def gr13(spark: SparkSession, d: str) -> DataFrame:
    return samples.top_absolute(samples.require_active(order_brand(spark, d)), 2, policy="top_abs")


@REG.add("gr13_budgeted_selection", f"""
WITH {_BRANDS}, sn AS (SELECT feat, count(*) AS n FROM ob WHERE abs(value) > 1e-8 GROUP BY feat),
br AS (SELECT u AS feat FROM ed WHERE w > 0.95 UNION SELECT v FROM ed WHERE w > 0.95),
a AS (SELECT obs, feat, value, abs(value) > 1e-8 AS live, feat = 'Brand#13' AS f, feat IN (SELECT feat FROM br) AS b, {_DRAWN} AS k FROM ob JOIN sn USING (feat)),
s1 AS (SELECT *, CASE WHEN live AND row_number() OVER (PARTITION BY obs, live ORDER BY abs(value) DESC, feat) <= 2 THEN 'base' END AS p1 FROM a),
s2 AS (SELECT *, coalesce(p1, CASE WHEN NOT f AND live AND row_number() OVER (PARTITION BY obs, p1 IS NULL AND NOT f AND live ORDER BY k, feat) <= 1 THEN 'coverage' END) AS p2 FROM s1),
s3 AS (SELECT *, coalesce(p2, CASE WHEN NOT f AND live AND b AND row_number() OVER (PARTITION BY obs, p2 IS NULL AND NOT f AND live AND b ORDER BY abs(value) DESC, feat) <= 1 THEN 'bridge' END, CASE WHEN f THEN 'forced' END) AS p3 FROM s2),
s4 AS (SELECT *, count(p3) OVER (PARTITION BY obs) AS h FROM s3),
s5 AS (SELECT *, coalesce(p3, CASE WHEN row_number() OVER (PARTITION BY obs, p3 IS NULL ORDER BY abs(value) DESC, feat) <= 2 - h THEN 'fill' END) AS part FROM s4),
s6 AS (SELECT * FROM s5 WHERE part IS NOT NULL QUALIFY f OR row_number() OVER (PARTITION BY obs ORDER BY f DESC, abs(value) DESC, feat) <= 5)
SELECT obs, feat, value, part, CAST(row_number() OVER (PARTITION BY obs ORDER BY feat) - 1 AS INTEGER) AS idx FROM s6""")
def gr13_budgeted(spark: SparkSession, d: str) -> DataFrame:
    """Five nodes: two base, one drawn for coverage, one bridge, one forced."""
    long, edges, _ = _brand_graph(spark, d)
    ends = edges.where("w > 0.95").select(F.explode(F.array("u", "v")).alias("feat")).distinct()
    return samples.select_nodes(long, 5, ends, ["Brand#13"], 0.25, 0.25, 2, 17)


@REG.add("gr14_coverage_sample", f"""
WITH {ORDER_BRAND}, sn AS (SELECT feat, count(*) AS n FROM ob WHERE abs(value) > 1e-8 GROUP BY feat), r AS (SELECT obs, feat, value, {_DRAWN} AS k FROM ob JOIN sn USING (feat) WHERE abs(value) > 1e-8)
SELECT obs, feat, value FROM r QUALIFY row_number() OVER (PARTITION BY obs ORDER BY k, feat) <= 2""")
def gr14(spark: SparkSession, d: str) -> DataFrame:
    return samples.coverage_sample(order_brand(spark, d), 2, 17)


_TOP3 = f"{_BRANDS}, tn AS (SELECT obs, feat, value, CAST(row_number() OVER (PARTITION BY obs ORDER BY feat) - 1 AS INTEGER) AS idx FROM (SELECT * FROM ob QUALIFY row_number() OVER (PARTITION BY obs ORDER BY abs(value) DESC, feat) <= 3)), te AS (SELECT a.obs, u, v, w, a.idx AS iu, b.idx AS iv FROM tn a JOIN (SELECT * FROM ed WHERE w > 0.9) e ON e.u = a.feat JOIN tn b ON b.obs = a.obs AND b.feat = e.v)"


@REG.add("jn14_induced_edges", f"WITH {_TOP3} SELECT obs, u, v, round(w, 9) AS w, iu, iv FROM te")
def jn14(spark: SparkSession, d: str) -> DataFrame:
    long, edges, _ = _brand_graph(spark, d)
    return _r(samples.induced(samples.top_absolute(long, 3), edges.where("w > 0.9")), 9, "w")


@REG.add("gr16_without_isolated", f"WITH {_TOP3}, k AS (SELECT obs, u AS feat FROM te UNION SELECT obs, v FROM te) SELECT obs, feat, value, CAST(row_number() OVER (PARTITION BY obs ORDER BY feat) - 1 AS INTEGER) AS idx FROM tn JOIN k USING (obs, feat)")
def gr16(spark: SparkSession, d: str) -> DataFrame:
    long, edges, _ = _brand_graph(spark, d)
    nodes = samples.top_absolute(long, 3)
    return samples.drop_isolated(nodes, samples.induced(nodes, edges.where("w > 0.9")))


@REG.add("gr17_seed_fallback", f"""
WITH {_BRANDS}, t AS (SELECT obs, feat FROM ob QUALIFY row_number() OVER (PARTITION BY obs ORDER BY abs(value) DESC, feat) <= 1),
e AS (SELECT a.obs, u, v FROM ob a JOIN ed ON ed.u = a.feat JOIN ob b ON b.obs = a.obs AND b.feat = ed.v QUALIFY row_number() OVER (PARTITION BY a.obs ORDER BY w DESC, u, v) = 1)
SELECT obs, feat FROM t UNION SELECT obs, u FROM e UNION SELECT obs, v FROM e""")
def gr17(spark: SparkSession, d: str) -> DataFrame:
    long, edges, _ = _brand_graph(spark, d)
    # the fallback orders numbers, so ranks of the names stand for them
    ids = long.select("feat").distinct()
    ids = materialize(reshape.numbered(ids, ["feat"], "k"), "ids")
    coded = long.join(small_side(ids), "feat").select("obs", F.col("k").alias("feat"), "value")
    pairs = E.mapped(edges, ids.select(F.col("feat").alias("old"), F.col("k").alias("new")))
    out = samples.seed_fallback(coded, pairs, 1)
    return out.join(small_side(ids.withColumnRenamed("feat", "name")), F.col("feat") == F.col("k")).select("obs", F.col("name").alias("feat"))


@REG.add("io19_sample_rows", _SAMPLE + "SELECT obs, count(*) AS n_nodes, coalesce((SELECT count(*) FROM ie WHERE ie.obs = nd.obs), 0) AS n_edges FROM nd GROUP BY obs")
def io19(spark: SparkSession, d: str) -> DataFrame:
    """Samples as one row each, written and read again as the loaders do."""
    from plexora.sources.graphs import read_samples, write_samples
    from plexora.session import scratch_path

    nodes, edges = samples.active_subgraphs(*_brand_graph(spark, d), 0.9, 3, 2)
    path = scratch_path(spark, "samples")
    write_samples(samples.as_rows(nodes, edges).withColumn("split", F.lit("trn")), path)
    return read_samples(spark, path, "trn").select("obs", F.size("x").cast("long").alias("n_nodes"), F.size("edges").cast("long").alias("n_edges"))


@REG.add("gr18_centrality", f"""
WITH {_MEANS}, e0 AS (SELECT DISTINCT npz_id AS g, least(u, v) AS u, greatest(u, v) AS v FROM bulk_nmic WHERE npz_id IS NOT NULL AND u >= 0 AND v >= 0 AND u <> v AND w IS NOT NULL AND NOT isnan(w)),
v AS (SELECT g, node, vec FROM (SELECT g, u AS node FROM e0 UNION SELECT g, v FROM e0) JOIN mv USING (node) WHERE st = 'pre'), n AS (SELECT g, count(*) AS n FROM v GROUP BY g),
e AS (SELECT e0.g, u, v, abs(list_inner_product(a.vec, b.vec)) AS sim FROM e0 JOIN v a ON a.g = e0.g AND a.node = u JOIN v b ON b.g = e0.g AND b.node = v),
s AS (SELECT g, count(*) AS e, max(sim) AS top, quantile_cont(sim, 0.5) AS mid FROM e GROUP BY g),
c AS (SELECT g, CASE WHEN t > top THEN mid ELSE t END AS cut FROM (SELECT s.*, 0.03 * (1 + 2 * e / greatest(n * (n - 1) // 2, 1)) AS t FROM s JOIN n USING (g))),
k AS (SELECT e.* FROM e JOIN c USING (g) WHERE sim > cut), m AS (SELECT g, node, sum(sim) AS c FROM (SELECT g, u AS node, sim FROM k UNION ALL SELECT g, v, sim FROM k) GROUP BY ALL)
SELECT v.g, v.node, round(coalesce(c, 0), 5) AS centrality FROM v LEFT JOIN m USING (g, node)""")
def gr18(spark: SparkSession, d: str) -> DataFrame:
    return _r(E.centrality(*_run_graphs(spark, d))[1], 5, "centrality")


def _run_graphs(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The delivered pairs of every run as a graph, with the mean vectors of
    their ends; an end without a vector is no node."""
    rows = table(spark, d, "bulk_nmic", "npz_id", "u", "v", "w").where("npz_id is not null and u >= 0 and v >= 0 and u <> v and w is not null and not isnan(w)")
    edges = materialize(rows.select(F.col("npz_id").alias("g"), F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "pairs")
    ends = edges.select("g", F.explode(F.array("u", "v")).alias("node")).distinct()
    return edges, materialize(ends.join(_state_vectors(spark, d, "pre"), "node").select("g", "node", "vec"), "vectors")


@REG.add("gr21_multiscale")
def gr21(spark: SparkSession, d: str) -> DataFrame:
    kept, nodes = E.centrality(*_run_graphs(spark, d))
    return greedy.multiscale_subgraphs(nodes, kept.select("g", "u", "v"), 1)


@REG.add("gr19_fd_histogram", """
WITH s AS (SELECT o_orderpriority AS g, min(o_totalprice) AS lo, max(o_totalprice) AS hi, count(*) AS n, quantile_cont(o_totalprice, 0.25) AS a, quantile_cont(o_totalprice, 0.75) AS b FROM orders GROUP BY ALL),
k AS (SELECT *, CAST(greatest(1, least(1000, floor((hi - lo) / (2 * (b - a) / pow(n, 1.0 / 3))))) AS INTEGER) AS k FROM s),
c AS (SELECT g, CAST(least(floor((o_totalprice - lo) * k / (hi - lo)), k - 1) AS INTEGER) AS bin, count(*) AS n FROM orders JOIN k ON g = o_orderpriority GROUP BY ALL),
r AS (SELECT g, lo, hi, k, unnest(range(k)) AS bin FROM k)
SELECT r.g AS o_orderpriority, CAST(r.bin AS INTEGER) AS bin, round(lo + r.bin * (hi - lo) / k, 3) AS lower, round(lo + (r.bin + 1) * (hi - lo) / k, 3) AS upper, coalesce(c.n, 0) AS n FROM r LEFT JOIN c ON c.g = r.g AND c.bin = r.bin""")
def gr19(spark: SparkSession, d: str) -> DataFrame:
    return _r(E.fd_histogram(table(spark, d, "orders", "o_orderpriority", "o_totalprice"), "o_totalprice", "o_orderpriority"), 3, "lower", "upper")


@REG.add("gr32_super_edges", """
WITH e AS (SELECT r_regionkey AS g, n_nationkey AS u, n_nationkey + 5 AS v FROM nation JOIN region ON n_regionkey = r_regionkey), s AS (SELECT n_regionkey AS g, n_nationkey + 100 AS x FROM nation)
SELECT g, u, v FROM e UNION SELECT g, v, u FROM e UNION SELECT a.g, a.x, b.x FROM s a JOIN s b ON a.g = b.g AND a.x <> b.x""")
def gr32(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation")
    e = n.select(F.col("n_regionkey").alias("g"), F.col("n_nationkey").alias("u"), (F.col("n_nationkey") + 5).alias("v"))
    return E.super_edges(n.select(F.col("n_regionkey").alias("g"), (F.col("n_nationkey") + 100).alias("super_node")), e)


# ------------------------------------------------------------------ networks

def _state_vectors(spark: SparkSession, d: str, state: str) -> DataFrame:
    e = table(spark, d, "node_embeddings", "node_gene_ids", "node_embeddings", "model_state").where(F.col("model_state") == state)
    v = F.col("node_embeddings")
    ok = F.col("node_gene_ids").isNotNull() & (F.size(v) == 64) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x))
    return network.mean_vectors(e.where(ok).select(F.col("node_gene_ids").alias("node"), v.alias("vec")), "node", "vec")


@REG.add("ag09_mean_embeddings", f"WITH {_MEANS} SELECT mv.node, nv.n, list_transform(mv.vec, lambda x: round(x, 6) + 0.0) AS vec FROM mv JOIN nv USING (node, st) WHERE st = 'pre'")
def ag09(spark: SparkSession, d: str) -> DataFrame:
    return _state_vectors(spark, d, "pre").select("node", "n", F.transform("vec", lambda x: F.round(x, 6) + F.lit(0.0)).alias("vec"))


@REG.add("ag11_sample_embeddings", f"""
WITH s AS (SELECT obs_names, node_embeddings AS vec FROM node_embeddings WHERE obs_names IS NOT NULL AND len(node_embeddings) = 64 AND len(list_filter(node_embeddings, lambda y: y IS NULL OR isnan(y))) = 0),
l AS (SELECT obs_names, unnest(range(64)) AS pos, CAST(unnest(vec) AS DOUBLE) AS x FROM s), a AS (SELECT obs_names, pos, avg(x) AS m FROM l GROUP BY ALL)
SELECT obs_names, list(round(m, 6) + 0.0 ORDER BY pos) AS vec, any_value(n) AS n FROM a JOIN (SELECT obs_names, count(*) AS n FROM s GROUP BY ALL) USING (obs_names) GROUP BY obs_names""")
def ag11(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "node_embeddings", "obs_names", "node_embeddings")
    v = F.col("node_embeddings")
    ok = F.col("obs_names").isNotNull() & (F.size(v) == 64) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x))
    return network.mean_vectors(e.where(ok), "obs_names", "node_embeddings").withColumn("vec", F.transform("vec", lambda x: F.round(x, 6) + F.lit(0.0)))


# two states of the brands: quantities per nation of the supplier before and from 1998
_STATES = """q AS (SELECT CAST(substr(p_brand, 7) AS BIGINT) AS node, CASE WHEN l_shipdate < TIMESTAMP '1998-01-01' THEN 'pre' ELSE 'ft' END AS st, s_nationkey AS pos, sum(l_quantity) AS x
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL),
g AS (SELECT * FROM (SELECT DISTINCT node, st FROM q), (SELECT DISTINCT CAST(n_nationkey AS BIGINT) AS pos FROM nation)),
mv AS (SELECT g.node, g.st, list(coalesce(CAST(x AS DOUBLE), 0) ORDER BY g.pos) AS vec FROM g LEFT JOIN q ON q.node = g.node AND q.st = g.st AND q.pos = g.pos GROUP BY ALL),
fe AS (SELECT DISTINCT a.node AS u, b.node AS v FROM (SELECT l_orderkey, CAST(substr(p_brand, 7) AS BIGINT) AS node FROM lineitem JOIN part ON l_partkey = p_partkey) a
  JOIN (SELECT l_orderkey, CAST(substr(p_brand, 7) AS BIGINT) AS node FROM lineitem JOIN part ON l_partkey = p_partkey) b ON a.l_orderkey = b.l_orderkey AND a.node < b.node),
cw AS (SELECT fe.u, fe.v, a.st, CASE WHEN sqrt(list_inner_product(a.vec, a.vec)) < 1e-8 OR sqrt(list_inner_product(b.vec, b.vec)) < 1e-8 THEN 0 ELSE list_cosine_similarity(a.vec, b.vec) END AS w
  FROM fe JOIN mv a ON a.node = fe.u JOIN mv b ON b.node = fe.v AND b.st = a.st),
dl AS (SELECT p.u, p.v, p.w AS w_pre, f.w AS w_ft, round(f.w - p.w, 8) AS delta_w FROM cw p JOIN cw f USING (u, v) WHERE p.st = 'pre' AND f.st = 'ft')"""


def _brand_states(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """``(edges, vectors)``: brands sold in one order, and ``(node, st, vec)``."""
    brand = F.substring("p_brand", 7, 10).cast("long").alias("node")
    part = small_side(table(spark, d, "part", "p_partkey", "p_brand").select("p_partkey", brand))
    li = table(spark, d, "lineitem", "l_orderkey", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity").join(part, F.expr("l_partkey = p_partkey"))
    sup = small_side(table(spark, d, "supplier", "s_suppkey", "s_nationkey"))
    st = F.when(F.col("l_shipdate") < F.lit("1998-01-01").cast("timestamp"), "pre").otherwise("ft").alias("st")
    q = li.join(sup, F.expr("l_suppkey = s_suppkey")).groupBy("node", st).pivot("s_nationkey", list(range(25))).agg(F.sum("l_quantity"))
    vec = materialize(q.select("node", "st", F.array(*(F.coalesce(F.col(f"`{i}`").cast("double"), F.lit(0.0)) for i in range(25))).alias("vec")), "states")
    in_order = li.select("l_orderkey", "node").distinct()
    pairs = in_order.select("l_orderkey", F.col("node").alias("u")).join(in_order.select("l_orderkey", F.col("node").alias("v")), "l_orderkey").where("u < v")
    return materialize(pairs.select("u", "v").distinct(), "pairs"), vec


@REG.add("gr22_cosine_edges", f"WITH {_STATES} SELECT u, v, round(w, 6) AS w FROM cw WHERE st = 'ft'")
def gr22(spark: SparkSession, d: str) -> DataFrame:
    e, v = _brand_states(spark, d)
    return _r(network.cosine_edges(e, v.where("st = 'ft'")), 6, "w")


@REG.add("gr22_gene_cosines", f"""WITH {FUSED_EDGES}, {_MEANS} SELECT fe.u, fe.v, round(list_cosine_similarity(a.vec, b.vec), 6) AS w
FROM fe JOIN mv a ON a.node = fe.u JOIN mv b ON b.node = fe.v WHERE a.st = 'ft' AND b.st = 'ft'""")
def gr22_genes(spark: SparkSession, d: str) -> DataFrame:
    return _r(network.cosine_edges(fused_edges(spark, d), _state_vectors(spark, d, "ft")), 6, "w")


def _delta(spark: SparkSession, d: str) -> DataFrame:
    e, v = _brand_states(spark, d)
    return network.delta_network(*(network.cosine_edges(e, v.where(F.col("st") == s)) for s in ("pre", "ft")))


@REG.add("gr23_delta_network", f"WITH {_STATES} SELECT u, v, round(w_pre, 6) AS w_pre, round(w_ft, 6) AS w_ft, round(delta_w, 6) AS delta_w, round(abs(delta_w), 6) AS abs_delta_w, CASE WHEN delta_w > 0 THEN 'positive' WHEN delta_w < 0 THEN 'negative' ELSE 'zero' END AS delta_sign FROM dl")
def gr23(spark: SparkSession, d: str) -> DataFrame:
    return _r(_delta(spark, d), 6, "w_pre", "w_ft", "delta_w", "abs_delta_w")


@REG.add("jn09_common_edges", f"WITH {_STATES} SELECT u, v FROM dl")
def jn09(spark: SparkSession, d: str) -> DataFrame:
    return _delta(spark, d).select("u", "v")


@REG.add("sl06_strongest_changes", f"WITH {_STATES} SELECT u, v, round(abs(delta_w), 6) AS abs_delta_w FROM dl ORDER BY abs(delta_w) DESC, u, v LIMIT 20")
def sl06(spark: SparkSession, d: str) -> DataFrame:
    return _r(_delta(spark, d).limit(20), 6, "abs_delta_w").select("u", "v", "abs_delta_w")


@REG.add("pr14_delta_signs", f"WITH {_STATES} SELECT CASE WHEN delta_w > 0 THEN 'positive' WHEN delta_w < 0 THEN 'negative' ELSE 'zero' END AS delta_sign, count(*) AS n FROM dl GROUP BY ALL")
def pr14(spark: SparkSession, d: str) -> DataFrame:
    return _delta(spark, d).groupBy("delta_sign").agg(F.count(F.lit(1)).alias("n"))


@REG.add("ag21_delta_summary", f"WITH {_STATES} SELECT count(*) AS n_edges, round(avg(delta_w), 6) AS mean, round(stddev_pop(delta_w), 6) AS std, round(quantile_cont(delta_w, 0.5), 6) AS median, round(avg(CASE WHEN delta_w > 0 THEN 1.0 ELSE 0 END), 6) AS positive_fraction, round(avg(CASE WHEN delta_w < 0 THEN 1.0 ELSE 0 END), 6) AS negative_fraction FROM dl")
def ag21(spark: SparkSession, d: str) -> DataFrame:
    return _r(network.delta_summary(_delta(spark, d)), 6, "mean", "std", "median", "positive_fraction", "negative_fraction")


@REG.add("gr24_gene_table", f"""WITH {_MEANS}, {VOCABULARY}
SELECT a.node AS gene_id, vo.name AS gene_name, vo.old_or_new AS node_type, p.n AS count_pre, f.n AS count_ft, round(sqrt(list_inner_product(a.vec, a.vec)), 5) AS embedding_norm_pre, round(sqrt(list_inner_product(b.vec, b.vec)), 5) AS embedding_norm_ft, round(list_distance(b.vec, a.vec), 5) AS embedding_norm_delta
FROM mv a JOIN mv b ON a.node = b.node AND a.st = 'pre' AND b.st = 'ft' JOIN nv p ON p.node = a.node AND p.st = 'pre' JOIN nv f ON f.node = a.node AND f.st = 'ft' LEFT JOIN vo ON vo.idx = a.node""")
def gr24(spark: SparkSession, d: str) -> DataFrame:
    t = network.gene_table(_state_vectors(spark, d, "pre"), _state_vectors(spark, d, "ft"), vocabulary(spark, d))
    return _r(t, 5, "embedding_norm_pre", "embedding_norm_ft", "embedding_norm_delta")


# modules by the last digit of the feature index, of uneven size
_MODULES = f"""{NMIC_EDGES}, md0 AS (SELECT node, CASE WHEN node % 10 < 5 THEN 0 WHEN node % 10 < 8 THEN 1 ELSE node % 10 END AS module FROM (SELECT u AS node FROM nm UNION SELECT v FROM nm)),
sz AS (SELECT module, count(*) AS n FROM md0 GROUP BY ALL), rk AS (SELECT *, row_number() OVER (ORDER BY n DESC, module) AS r FROM sz),
md AS (SELECT node, printf('M%02d', CASE WHEN n >= {{least}} THEN r ELSE 1 END) AS module_id FROM md0 JOIN rk USING (module)),
me AS (SELECT nm.*, a.module_id FROM nm JOIN md a ON a.node = nm.u JOIN md b ON b.node = nm.v AND b.module_id = a.module_id),
dg AS (SELECT module_id, node, sum(abs(w)) AS strength, count(*) AS degree FROM (SELECT module_id, u AS node, w FROM me UNION ALL SELECT module_id, v, w FROM me) GROUP BY ALL),
hb AS (SELECT md.module_id, md.node, coalesce(strength, 0) AS strength, coalesce(degree, 0) AS degree, row_number() OVER (PARTITION BY md.module_id ORDER BY coalesce(strength, 0) DESC, coalesce(degree, 0) DESC, md.node) AS rank, count(*) OVER (PARTITION BY md.module_id) AS n
       FROM md LEFT JOIN dg ON dg.node = md.node AND dg.module_id = md.module_id)"""
_LEAST = 50


def _modules(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    # weights in thousandths, so that sums do not depend on the order
    e = materialize(nmic_edges(spark, d).withColumn("w", F.round("w", 3)), "edges")
    part = F.expr("CASE WHEN node % 10 < 5 THEN 0 WHEN node % 10 < 8 THEN 1 ELSE node % 10 END")
    nodes = E.endpoints(e).select("node").distinct().select("node", part.alias("module"))
    return e, materialize(network.normalized_modules(nodes, _LEAST), "modules")


_MOD = "WITH " + _MODULES.format(least=_LEAST).replace("max(w) AS w FROM bulk_nmic", "round(max(w), 3) AS w FROM bulk_nmic")


@REG.add("gr27_modules", _MOD + " SELECT node, module_id FROM md")
def gr27(spark: SparkSession, d: str) -> DataFrame:
    return _modules(spark, d)[1]


@REG.add("gr29_module_edges", _MOD + " SELECT u, v, w, module_id FROM me")
def gr29(spark: SparkSession, d: str) -> DataFrame:
    return network.module_edges(*_modules(spark, d)).select("u", "v", "w", "module_id")


@REG.add("gr29_node_types", """
WITH s AS (SELECT edge_id, 0 AS side, src_expanded_idx AS node, src AS type FROM edge_source UNION ALL SELECT edge_id, 1, dst_expanded_idx, dst FROM edge_source)
SELECT node, type FROM s WHERE node IS NOT NULL AND type IS NOT NULL QUALIFY row_number() OVER (PARTITION BY node ORDER BY edge_id, side, type) = 1""")
def gr29_types(spark: SparkSession, d: str) -> DataFrame:
    """The name with which a feature is first delivered."""
    e = table(spark, d, "edge_source", "edge_id", "src_expanded_idx", "dst_expanded_idx", "src", "dst").toDF("edge_id", "u", "v", "type_u", "type_v")
    sides = e.select("edge_id", F.when(F.col("type_u").isNotNull(), F.col("u")).alias("u"), F.when(F.col("type_v").isNotNull(), F.col("v")).alias("v"), "type_u", "type_v")
    return network.node_types(sides, "edge_id").where("node is not null")


@REG.add("wn13_hubs", _MOD.replace("round(max(w), 3) AS w", "CAST(round(max(w), 3) AS DECIMAL(20, 3)) AS w") + " SELECT module_id, node, CAST(strength AS DOUBLE) AS strength, degree, CAST(rank AS INTEGER) AS rank, rank <= least(greatest(ceil(n * 0.1), 3), 20, n) AS is_hub FROM hb")
def wn13(spark: SparkSession, d: str) -> DataFrame:
    """Ranks by whole thousandths, as sums of doubles depend on their order."""
    e, m = _modules(spark, d)
    return _r(network.hubs(e.withColumn("w", F.col("w").cast("decimal(20,3)")), m, 0.1, 3, 20).withColumn("strength", F.col("strength").cast("double")), 3, "strength")


@REG.add("ag13_module_summary", _MOD + f""", {VOCABULARY},
e AS (SELECT module_id, count(*) AS n_edges, round(avg(abs(w)), 6) AS mean_abs_w, round(quantile_cont(abs(w), 0.5), 6) AS median_abs_w, round(avg(w), 6) AS mean_w, 0.0::DOUBLE AS mean_delta, 0.0::DOUBLE AS positive_fraction FROM me GROUP BY ALL),
n AS (SELECT module_id, count(*) AS n_nodes, count(*) FILTER (WHERE old_or_new = 'old') AS n_old, count(*) FILTER (WHERE old_or_new = 'new') AS n_new, count(*) FILTER (WHERE coalesce(old_or_new, 'unknown') NOT IN ('old', 'new')) AS n_unknown FROM md LEFT JOIN vo ON vo.idx = md.node GROUP BY ALL)
SELECT module_id, n_nodes, n_old, n_new, n_unknown, coalesce(n_edges, 0) AS n_edges, mean_abs_w, median_abs_w, mean_w, mean_delta, positive_fraction,
  round(coalesce(n_edges, 0) / (n_nodes * (n_nodes - 1) / 2), 9) AS density FROM n LEFT JOIN e USING (module_id)""")
def ag13(spark: SparkSession, d: str) -> DataFrame:
    return _r(_r(_summary(spark, d).drop("top_hubs"), 6, "mean_abs_w", "median_abs_w", "mean_w", "mean_delta", "positive_fraction"), 9, "density")


def _summary(spark: SparkSession, d: str) -> DataFrame:
    e, m = _modules(spark, d)
    e = network.load_edges(e)
    return network.module_summary(e, m, vocabulary(spark, d), network.hubs(e, m))


@REG.add("ag14_module_counts", _MOD + """, e AS (SELECT module_id, count(*) AS n FROM me GROUP BY ALL), n AS (SELECT module_id, count(*) AS n FROM md GROUP BY ALL)
SELECT 'n_modules' AS metric, CAST(count(*) AS VARCHAR) AS value FROM n UNION ALL SELECT 'n_nodes', CAST(CAST(sum(n) AS BIGINT) AS VARCHAR) FROM n UNION ALL SELECT 'n_edges', CAST(CAST(sum(n) AS BIGINT) AS VARCHAR) FROM e
UNION ALL SELECT 'largest', CAST(max(n) AS VARCHAR) FROM n UNION ALL SELECT 'smallest', CAST(min(n) AS VARCHAR) FROM n""")
def ag14(spark: SparkSession, d: str) -> DataFrame:
    return network.summary_rows(_summary(spark, d))


@REG.add("gr26_components", """
WITH RECURSIVE e AS (SELECT DISTINCT l_orderkey * 2 AS a, l_suppkey * 2 + 1 AS b FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'P'),
ee AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e), w(node, label) USING KEY (node) AS (SELECT DISTINCT a, a FROM ee UNION SELECT ee.b, min(w.label) FROM w JOIN ee ON ee.a = w.node JOIN recurring.w r ON r.node = ee.b WHERE w.label < r.label GROUP BY ee.b)
SELECT node, label FROM w""")
def gr26_components(spark: SparkSession, d: str) -> DataFrame:
    """Components of the bipartite graph of urgent pending orders and suppliers."""
    from plexora.operators.components import min_labels

    o = table(spark, d, "orders", "o_orderkey", "o_orderpriority", "o_orderstatus").where("o_orderpriority = '1-URGENT' and o_orderstatus = 'P'")
    e = table(spark, d, "lineitem", "l_orderkey", "l_suppkey").join(o, F.expr("l_orderkey = o_orderkey"), "left_semi")
    return min_labels(e.selectExpr("l_orderkey * 2 as u", "l_suppkey * 2 + 1 as v"), "u", "v")


@REG.add("gr26_modularity", f"""
WITH {NMIC_EDGES}, {VOCABULARY}, x AS (SELECT abs(w) AS w, a.old_or_new AS mu, b.old_or_new AS mv FROM nm JOIN vo a ON a.idx = u JOIN vo b ON b.idx = v WHERE w <> 0), t AS (SELECT sum(w) AS m FROM x),
i AS (SELECT mu AS k, sum(w) AS i FROM x WHERE mu = mv GROUP BY ALL), s AS (SELECT k, sum(w) AS d FROM (SELECT mu AS k, w FROM x UNION ALL SELECT mv, w FROM x) GROUP BY ALL)
SELECT round(sum(coalesce(i, 0) / m - 1.3 * pow(d / (2 * m), 2)), 9) AS modularity FROM s LEFT JOIN i USING (k), t""")
def gr26_modularity(spark: SparkSession, d: str) -> DataFrame:
    """Of the parting into old and new features."""
    parts = vocabulary(spark, d).select(F.col("idx").alias("node"), F.col("old_or_new").alias("module"))
    return _r(modularity(nmic_edges(spark, d), parts, 1.3), 9, "modularity")


@REG.add("gr26_communities")
def gr26(spark: SparkSession, d: str) -> DataFrame:
    return communities(E.undirected_top(nmic_edges(spark, d), 3))


@REG.add("gr26_communities_report", f"""
WITH {NMIC_EDGES} SELECT count(DISTINCT node) AS n_nodes, TRUE AS beats_old_new, TRUE AS beats_one_module FROM (SELECT u AS node FROM nm WHERE w <> 0 UNION ALL SELECT v FROM nm WHERE w <> 0)""")
def gr26_report(spark: SparkSession, d: str) -> DataFrame:
    """Every node is in one module, and the modules have more modularity than the
    old and new features or all features as modules."""
    edges = materialize(nmic_edges(spark, d), "edges")
    found = communities(edges)
    parts = vocabulary(spark, d).select(F.col("idx").alias("node"), F.col("old_or_new").alias("module"))
    one = found.select("node", F.lit(0).alias("module"))
    got = [modularity(edges, m, 1.3).withColumnRenamed("modularity", c) for m, c in ((found, "q_"), (parts, "p_"), (one, "o_"))]
    n = found.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where("n = 1").agg(F.count(F.lit(1)).alias("n_nodes"))
    return n.join(got[0]).join(got[1]).join(got[2]).select("n_nodes", (F.col("q_") > F.col("p_")).alias("beats_old_new"), (F.col("q_") > F.col("o_")).alias("beats_one_module"))


@REG.add("gr28_initial_vectors", f"""
WITH {NMIC_EDGES}, {_MEANS}, {VOCABULARY}, ov AS (SELECT mv.node, vec FROM mv JOIN vo ON vo.idx = mv.node WHERE st = 'pre' AND old_or_new = 'old'), nw AS (SELECT idx AS node FROM vo WHERE old_or_new = 'new'),
s AS (SELECT u AS node, v AS other, w FROM nm UNION ALL SELECT v, u, w FROM nm), l AS (SELECT s.node, w, unnest(range(64)) AS pos, unnest(vec) AS x FROM s JOIN nw USING (node) JOIN ov ON ov.node = s.other),
a AS (SELECT node, list(m ORDER BY pos) AS vec FROM (SELECT node, pos, sum(w * x) / sum(abs(w)) AS m FROM l GROUP BY ALL) GROUP BY node),
g AS (SELECT list(m ORDER BY pos) AS vec FROM (SELECT pos, avg(x) AS m FROM (SELECT unnest(range(64)) AS pos, unnest(vec) AS x FROM ov) GROUP BY pos))
SELECT nw.node, list_transform(coalesce(a.vec, g.vec), lambda x: round(x, 6)) AS vec FROM nw LEFT JOIN a USING (node), g""")
def gr28(spark: SparkSession, d: str) -> DataFrame:
    voc = vocabulary(spark, d)
    old = _state_vectors(spark, d, "pre").join(voc.where("old_or_new = 'old'").select(F.col("idx").alias("node")), "node", "left_semi")
    new = voc.where("old_or_new = 'new'").select(F.col("idx").alias("node"))
    return network.initial_vectors(new, nmic_edges(spark, d), old).withColumn("vec", F.transform("vec", lambda x: F.round(x, 6)))


@REG.add("gr30_knn_graph", """
WITH v AS (SELECT vec_id AS node, CAST(embedding AS DOUBLE[]) AS vec FROM embeddings), p AS (SELECT a.node AS u, b.node AS v, list_distance(a.vec, b.vec) AS d FROM v a JOIN v b ON a.node <> b.node),
k AS (SELECT u, v FROM p QUALIFY row_number() OVER (PARTITION BY u ORDER BY d, v) <= 5) SELECT least(u, v) AS u, greatest(u, v) AS v, count(*) AS w FROM k GROUP BY ALL""")
def gr30(spark: SparkSession, d: str) -> DataFrame:
    return network.knn_graph(table(spark, d, "embeddings", "vec_id", "embedding").toDF("node", "vec"), 5)


# ----------------------------------------------------------------- intervals

_IV = """iv AS (SELECT CAST(l_suppkey AS VARCHAR) AS chr, date_diff('day', TIMESTAMP '1970-01-01', l_shipdate) AS "start", date_diff('day', TIMESTAMP '1970-01-01', l_shipdate) + CAST(l_quantity AS BIGINT) AS "end" FROM lineitem),
o AS (SELECT *, max("end") OVER (PARTITION BY chr ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM iv),
i AS (SELECT *, sum(CASE WHEN b IS NULL OR "start" >= b THEN 1 ELSE 0 END) OVER (PARTITION BY chr ORDER BY "start", "end" ROWS UNBOUNDED PRECEDING) AS k FROM o),
mg AS (SELECT chr, min("start") AS "start", max("end") AS "end" FROM i GROUP BY chr, k)"""


def _intervals(spark: SparkSession, d: str) -> DataFrame:
    day = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    li = table(spark, d, "lineitem", "l_suppkey", "l_shipdate", "l_quantity")
    return li.select(F.col("l_suppkey").cast("string").alias("chr"), day.alias("start"), (day + F.col("l_quantity").cast("long")).alias("end"))


@REG.add("wn10_merged_intervals", f"WITH {_IV} SELECT * FROM mg")
def wn10(spark: SparkSession, d: str) -> DataFrame:
    return intervals.merge(_intervals(spark, d))


@REG.add("wn11_overlap_check", f"""WITH {_IV}, s AS (SELECT "start" < lag("end") OVER (PARTITION BY chr ORDER BY "start", "end") AS h FROM mg) SELECT coalesce(bool_or(h), false) AS overlapping FROM s""")
def wn11(spark: SparkSession, d: str) -> DataFrame:
    return intervals.has_overlap(intervals.merge(_intervals(spark, d)))


@REG.add("jn04_interval_join", f"""WITH {_IV}, q AS (SELECT DISTINCT chr, "start", "end" FROM iv)
SELECT q.chr, q."start", q."end", mg."start" AS ref_start, mg."end" AS ref_end FROM q JOIN mg ON mg.chr = q.chr AND q."start" <= mg."end" AND q."end" >= mg."start\"""")
def jn04(spark: SparkSession, d: str) -> DataFrame:
    iv = _intervals(spark, d)
    return intervals.align(iv.distinct(), intervals.merge(iv), 256)


@REG.add("fn02_interval_parse", f"""WITH {_IV} SELECT DISTINCT chr, "start", "end", chr || ':' || "start" || '-' || "end" AS peak FROM iv""")
def fn02(spark: SparkSession, d: str) -> DataFrame:
    iv = _intervals(spark, d).distinct()
    return intervals.parse(iv.select(S.interval_key("chr", "start", "end").alias("peak")))


@REG.add("gr31_remapped_peaks", f"""
WITH {_IV}, c AS (SELECT o_orderpriority AS obs, chr, "start", "end", CAST(count(*) AS DOUBLE) AS value FROM (
  SELECT o_orderpriority, CAST(l_suppkey AS VARCHAR) AS chr, date_diff('day', TIMESTAMP '1970-01-01', l_shipdate) AS "start", date_diff('day', TIMESTAMP '1970-01-01', l_shipdate) + CAST(l_quantity AS BIGINT) AS "end" FROM lineitem JOIN orders ON l_orderkey = o_orderkey) GROUP BY ALL)
SELECT obs, mg.chr || ':' || mg."start" || '-' || mg."end" AS merged, sum(value) AS value FROM c JOIN mg ON mg.chr = c.chr AND c."start" <= mg."end" AND c."end" >= mg."start" GROUP BY ALL""")
def gr31(spark: SparkSession, d: str) -> DataFrame:
    """Counts per interval summed over the merged ones; a touching interval counts
    in both neighbours, which the strict form refuses."""
    day = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    li = table(spark, d, "lineitem", "l_orderkey", "l_suppkey", "l_shipdate", "l_quantity").join(table(spark, d, "orders", "o_orderkey", "o_orderpriority"), F.expr("l_orderkey = o_orderkey"))
    c = li.groupBy(F.col("o_orderpriority").alias("obs"), F.col("l_suppkey").cast("string").alias("chr"), day.alias("start"), (day + F.col("l_quantity").cast("long")).alias("end")).agg(F.count(F.lit(1)).cast("double").alias("value"))
    c = materialize(c.withColumn("peak", S.interval_key("chr", "start", "end")), "peaks")
    hit = intervals.align(c.select("chr", "start", "end").distinct(), intervals.merge(_intervals(spark, d)), 256)
    mapping = hit.select(S.interval_key("chr", "start", "end").alias("peak"), S.interval_key("chr", "ref_start", "ref_end").alias("merged"))
    return intervals.remap(c.select("obs", "peak", "value"), mapping, strict=False)
