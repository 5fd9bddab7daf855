"""Matrix operators: sources, projections, statistics, windows, reshaping."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plexora.functions import scalar as S
from plexora.operators import nmic, reshape, stats
from plexora.operators.windows import ratio_windows, windows
from plexora.plans.inputs import EMB, EXPRESSION, ORDER_BRAND, SUPPLIER_BRAND, embedding_long, expression_long, order_brand, supplier_brand
from plexora.plans.registry import Registry
from plexora.session import small_side, table

REG = Registry()


def _r(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


# ------------------------------------------------------- sources and reshaping


@REG.add("io01_wide_to_long", f"WITH {EXPRESSION} SELECT obs, feat, value FROM ex")
def io01(spark: SparkSession, d: str) -> DataFrame:
    return expression_long(spark, d)


@REG.add("io03_long_to_wide", f"WITH {EMB} SELECT obs, " + ", ".join(f"max(value) FILTER (WHERE feat = {i}) AS f{i:02d}" for i in range(64)) + " FROM emb GROUP BY obs")
def io03(spark: SparkSession, d: str) -> DataFrame:
    long = embedding_long(spark, d).withColumn("feat", F.format_string("f%02d", "feat"))
    return reshape.to_wide(long, [f"f{i:02d}" for i in range(64)])


@REG.add("io05_guide_graph_summary", """
SELECT npz_id, count(*) AS n, min(w) AS w_min, max(w) FILTER (WHERE NOT isnan(w)) AS w_max, min(least(u, v)) AS id_min, max(greatest(u, v)) AS id_max FROM bulk_nmic GROUP BY npz_id""")
def io05(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "bulk_nmic", "npz_id", "u", "v", "w")
    w = F.when(~F.isnan("w"), F.col("w"))
    return g.groupBy("npz_id").agg(F.count(F.lit(1)).alias("n"), F.min(w).alias("w_min"), F.max(w).alias("w_max"), F.min(F.least("u", "v")).alias("id_min"), F.max(F.greatest("u", "v")).alias("id_max"))


@REG.add("io08_unique_names", """
SELECT obs_id, CASE WHEN n = 0 THEN obs_names ELSE obs_names || '_' || n END AS unique_name
FROM (SELECT obs_id, obs_names, row_number() OVER (PARTITION BY obs_names ORDER BY obs_id) - 1 AS n FROM expression)""")
def io08(spark: SparkSession, d: str) -> DataFrame:
    return reshape.unique_names(table(spark, d, "expression", "obs_id", "obs_names"), "obs_names", "obs_id").select("obs_id", "unique_name")


@REG.add("io11_tolerant_scan", f"""WITH e AS (SELECT obs_names, cell_type, qt1g00335, qt1g00445, qt1g00825, qt1g00950 FROM expression)
SELECT obs_names AS obs, feat, value FROM (
  SELECT obs_names, 'qt1g00335' AS feat, qt1g00335 AS value FROM e UNION ALL SELECT obs_names, 'qt1g00445', qt1g00445 FROM e UNION ALL
  SELECT obs_names, 'qt1g00825', qt1g00825 FROM e UNION ALL SELECT obs_names, 'qt1g00950', qt1g00950 FROM e)""")
def io11(spark: SparkSession, d: str) -> DataFrame:
    """The observation column and the features are found by name and type."""
    return reshape.to_long(table(spark, d, "expression").drop("obs_id"))


@REG.add("io12_cell_types", """
WITH t AS (SELECT obs_names, min(cell_type) AS c FROM expression WHERE cell_type IS NOT NULL GROUP BY ALL)
SELECT e.obs_id, coalesce(t.c, 'Unknown') AS cell_type FROM expression e LEFT JOIN t USING (obs_names)""")
def io12(spark: SparkSession, d: str) -> DataFrame:
    from plexora.sources.tables import attach_labels

    e = table(spark, d, "expression", "obs_id", "obs_names", "cell_type")
    return attach_labels(e.select("obs_id", "obs_names"), e.select("obs_names", "cell_type"), "obs_names").select("obs_id", F.col("label").alias("cell_type"))


@REG.add("io18_batch_column", "SELECT obs_id, batch FROM expression")
def io18(spark: SparkSession, d: str) -> DataFrame:
    from plexora.sources.tables import batch_column

    e = table(spark, d, "expression")
    return e.select("obs_id", F.col(batch_column(e)).alias("batch"))


@REG.add("rs01_one_hot", """
SELECT vec_id AS obs, """ + ", ".join(f"CAST(max(CASE WHEN label = {i} THEN 1 ELSE 0 END) AS TINYINT) AS ct_{i}" for i in range(10)) + """, CAST(0 AS TINYINT) AS ct_unknown
FROM embeddings GROUP BY vec_id""")
def rs01(spark: SparkSession, d: str) -> DataFrame:
    return reshape.one_hot(table(spark, d, "embeddings", "vec_id", "label"), "vec_id", "label", list(range(10)))


@REG.add("rs02_one_hot_sorted", """
SELECT obs_id AS obs, """ + ", ".join(f"CAST(max(CASE WHEN split IS NOT NULL AND lower(trim(split)) = '{s}' THEN 1 ELSE 0 END) AS TINYINT) AS ct_{s}" for s in ("trn", "tst", "val")) + """
FROM expression GROUP BY obs_id""")
def rs02(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "expression", "obs_id", "split").withColumn("split", F.lower(F.trim("split")))
    return reshape.one_hot(e, "obs_id", "split", unknown=False)


@REG.add("rs03_from_one_hot", "SELECT vec_id AS obs, CAST(label AS VARCHAR) AS label FROM embeddings WHERE label BETWEEN 0 AND 9")
def rs03(spark: SparkSession, d: str) -> DataFrame:
    return reshape.from_one_hot(rs01(spark, d))


@REG.add("rs04_transpose", f"WITH {SUPPLIER_BRAND} SELECT feat, list(value ORDER BY obs) AS vec FROM sb GROUP BY feat")
def rs04(spark: SparkSession, d: str) -> DataFrame:
    return nmic.feature_vectors(supplier_brand(spark, d))


@REG.add("rs05_from_columns", "SELECT * FROM (VALUES (CAST(1 AS BIGINT), 'a', CAST(0.5 AS DOUBLE)), (2, NULL, 1.5), (3, 'c', NULL)) t(id, name, w)")
def rs05(spark: SparkSession, d: str) -> DataFrame:
    return reshape.from_columns(spark, {"id": [1, 2, 3], "name": ["a", None, "c"], "w": [0.5, 1.5, None]}, "id long, name string, w double")


@REG.add("rs06_flattened", "SELECT p_brand, CAST(count(*) AS BIGINT) AS m_n, min(p_size) AS m_low, max(p_size) AS m_high FROM part GROUP BY p_brand")
def rs06(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part", "p_brand", "p_size").groupBy("p_brand")
    nested = p.agg(F.struct(F.count(F.lit(1)).alias("n"), F.min("p_size").alias("low"), F.max("p_size").alias("high")).alias("m"))
    return reshape.flattened(nested, "m", "m_")


@REG.add("rs07_feature_blocks", """
SELECT edge_type, count(*) AS n, count(DISTINCT edge_source) AS n_sources FROM edge_source WHERE edge_type = 'old-old' GROUP BY ALL
UNION ALL SELECT edge_type, count(*), count(DISTINCT edge_source) FROM edge_source WHERE edge_type <> 'old-old' GROUP BY ALL""")
def rs07(spark: SparkSession, d: str) -> DataFrame:
    """A table parted by a column block, treated apart and put together again."""
    e = table(spark, d, "edge_source", "edge_type", "edge_source")
    one = lambda x: x.groupBy("edge_type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("edge_source").alias("n_sources"))
    return reshape.stacked([one(e.where("edge_type = 'old-old'")), one(e.where("edge_type <> 'old-old'"))])


# ------------------------------------------------------------- projections


@REG.add("pr01_numeric_columns", "SELECT * FROM (VALUES ('n_genes'), ('n_counts'), ('pct_counts_mt'), ('qt1g00335'), ('qt1g00445'), ('qt1g00825'), ('qt1g00950'), ('obs_id')) t(col)")
def pr01(spark: SparkSession, d: str) -> DataFrame:
    names = reshape.numeric_columns(table(spark, d, "expression"), exclude=())
    return spark.createDataFrame([(n,) for n in names], "col string")


@REG.add("pr02_allow_list", f"WITH {SUPPLIER_BRAND} SELECT * FROM sb WHERE feat IN (SELECT p_brand FROM part WHERE p_size >= 49)")
def pr02(spark: SparkSession, d: str) -> DataFrame:
    allow = table(spark, d, "part", "p_brand", "p_size").where("p_size >= 49").select(F.col("p_brand").alias("feat"))
    return supplier_brand(spark, d).join(allow, "feat", "left_semi")


@REG.add("pr03_vocabulary_order", "SELECT obs_id, qt1g00950, qt1g00335 FROM expression")
def pr03(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "expression", "obs_id", "qt1g00950", "qt1g00335")


@REG.add("pr08_labelled", "SELECT obs_names, ft16 FROM phenotype WHERE obs_names IS NOT NULL AND ft16 IS NOT NULL AND NOT isnan(ft16)")
def pr08(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "phenotype", "obs_names", "ft16").where(S.finite("ft16") & F.col("obs_names").isNotNull())


@REG.add("pr10_log1p", f"WITH {EXPRESSION} SELECT obs, feat, round(least(greatest(ln(1 + greatest(value, 0)), 0), 2), 9) AS value FROM ex")
def pr10(spark: SparkSession, d: str) -> DataFrame:
    return _r(expression_long(spark, d).withColumn("value", S.log1p_clipped("value", 0.0, 2.0)), 9, "value")


@REG.add("pr11_standardized", """
WITH t AS (SELECT o_orderkey, o_totalprice, o_orderstatus = 'F' AS trn FROM orders),
m AS (SELECT avg(o_totalprice) AS m, stddev_pop(o_totalprice) AS s FROM t WHERE trn)
SELECT o_orderkey, round((o_totalprice - m) / CASE WHEN s < 1e-8 THEN 1 ELSE s END, 6) AS y FROM t, m""")
def pr11(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders", "o_orderkey", "o_totalprice", "o_orderstatus")
    return _r(stats.standardized(o, "o_totalprice", F.col("o_orderstatus") == "F", "y"), 6, "y").select("o_orderkey", "y")


@REG.add("pr12_active_mask", f"WITH {EMB} SELECT obs, feat, value FROM emb WHERE abs(value) > 0.05")
def pr12(spark: SparkSession, d: str) -> DataFrame:
    from plexora.operators.samples import active

    return active(embedding_long(spark, d), 0.05)


@REG.add("pr15_training_names", "SELECT obs_id FROM expression WHERE obs_names IN (SELECT obs_names FROM expression WHERE lower(trim(split)) = 'trn')")
def pr15(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "expression", "obs_id", "obs_names", "split")
    return e.join(e.where(F.lower(F.trim("split")) == "trn").select("obs_names"), "obs_names", "left_semi").select("obs_id")


@REG.add("pr16_pair_parsing", """
SELECT n_name, CASE WHEN contains(t, '--') THEN CASE WHEN len(string_split(t, '--')) = 2 THEN list_transform(string_split(t, '--'), lambda x: trim(x)) END
  WHEN contains(t, ',') THEN CASE WHEN len(string_split(t, ',')) = 2 THEN list_transform(string_split(t, ','), lambda x: trim(x)) END
  WHEN contains(t, ':') THEN CASE WHEN len(string_split(t, ':')) = 2 THEN list_transform(string_split(t, ':'), lambda x: trim(x)) END END AS pair
FROM (SELECT n_name, n_name || CASE n_nationkey % 4 WHEN 0 THEN ' -- ' WHEN 1 THEN ', ' WHEN 2 THEN ':' ELSE ' ' END || r_name AS t FROM nation JOIN region ON n_regionkey = r_regionkey)""")
def pr16(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").join(small_side(table(spark, d, "region")), F.expr("n_regionkey = r_regionkey"))
    sep = F.expr("CASE n_nationkey % 4 WHEN 0 THEN ' -- ' WHEN 1 THEN ', ' WHEN 2 THEN ':' ELSE ' ' END")
    return n.select("n_name", S.pair_of(F.concat("n_name", sep, "r_name")).alias("pair"))


# -------------------------------------------------------------- aggregations


@REG.add("ag01_feature_stats", f"""
WITH {ORDER_BRAND}, s AS (SELECT feat, avg(value) AS mean, var_pop(value) AS var, stddev_pop(value) AS std, count(*) FILTER (WHERE value <> 0) AS n_nonzero, avg(CASE WHEN value > 0 THEN 1.0 ELSE 0 END) AS nonzero_ratio FROM ob GROUP BY feat)
SELECT feat, round(mean, 6) AS mean, round(var, 5) AS var, round(std, 6) AS std, n_nonzero, round(nonzero_ratio, 6) AS nonzero_ratio, round(CASE WHEN mean > 1e-8 THEN std / mean ELSE 0 END, 6) AS cv FROM s""")
def ag01(spark: SparkSession, d: str) -> DataFrame:
    return _r(_r(stats.feature_stats(order_brand(spark, d)), 6, "mean", "std", "nonzero_ratio", "cv"), 5, "var")


def _spans(long: DataFrame) -> list[tuple[int, int]]:
    return ratio_windows(long.select("obs").distinct().count(), 0.3, 0.9, 0.2, 0.2)


# windows of the oracle: sizes 30, 50, 70 and 90 percent, starts every 20 percent
_WINDOWS = """n AS (SELECT count(DISTINCT obs) AS n FROM emb),
p AS (SELECT n, CAST(floor(n * 0.3 + 0.5) AS BIGINT) AS lo, CAST(floor(n * 0.9 + 0.5) AS BIGINT) AS hi, CAST(floor(n * 0.2 + 0.5) AS BIGINT) AS st FROM n),
sz AS (SELECT n, st, unnest(generate_series(lo, hi, st)) AS size FROM p),
ws AS (SELECT n, size, unnest(generate_series(0, n - size - 1, st)) AS s FROM sz),
win AS (SELECT s, s + size AS e, 1e-4 AS floor FROM ws WHERE s + size <= n - 1 UNION ALL SELECT 0, n, 0.01 FROM n)"""


@REG.add("ag02_windowed_cv", f"""
WITH {EMB}, {_WINDOWS},
r AS (SELECT feat, value, row_number() OVER (PARTITION BY feat ORDER BY value, obs) - 1 AS r FROM emb),
c AS (SELECT feat, s, e, floor, abs(avg(value)) AS m, stddev_samp(value) AS sd FROM r JOIN win ON r >= s AND r < e GROUP BY ALL)
SELECT feat, round(max(CASE WHEN m < floor THEN 0 ELSE sd / m END), 6) AS cv FROM c GROUP BY feat""")
def ag02(spark: SparkSession, d: str) -> DataFrame:
    long = embedding_long(spark, d)
    return _r(stats.windowed_cv(long, _spans(long)), 6, "cv")


@REG.add("ag03_class_weights", """
WITH c AS (SELECT cls, n FROM (SELECT 'ct_' || CAST(label AS VARCHAR) AS cls, CAST(count(*) AS DOUBLE) AS n FROM embeddings GROUP BY label UNION ALL SELECT 'ct_unknown', 0.0)),
m AS (SELECT cls, CASE WHEN cls = 'ct_unknown' THEN avg(n) OVER () ELSE n END AS n FROM c)
SELECT cls AS class, round(n, 6) AS n, round((1 / n) / sum(1 / n) OVER (), 9) AS weight FROM m""")
def ag03(spark: SparkSession, d: str) -> DataFrame:
    hot = rs01(spark, d)
    return _r(_r(stats.class_weights(hot, [c for c in hot.columns if c.startswith("ct_")]), 6, "n"), 9, "weight")


@REG.add("ag04_phenotype_means", """
SELECT regexp_extract(obs_names, '([^_]+)$', 1) AS ecotype, round(avg(ft16), 6) AS ft16, count(*) AS n_records FROM phenotype
WHERE obs_names IS NOT NULL AND ft16 IS NOT NULL AND NOT isnan(ft16) GROUP BY ALL""")
def ag04(spark: SparkSession, d: str) -> DataFrame:
    ok = table(spark, d, "phenotype", "obs_names", "ft16").where(S.finite("ft16") & F.col("obs_names").isNotNull())
    return ok.groupBy(F.regexp_extract("obs_names", "([^_]+)$", 1).alias("ecotype")).agg(F.round(F.avg("ft16"), 6).alias("ft16"), F.count(F.lit(1)).alias("n_records"))


@REG.add("ag07_summary", """
WITH v AS (SELECT CASE WHEN NOT isnan(w) AND NOT isinf(w) THEN w END AS w FROM bulk_nmic)
SELECT count(*) AS n, count(w) AS n_finite, min(w) AS min, round(avg(w), 9) AS mean, round(stddev_pop(w), 9) AS std, max(w) AS max,
  round(avg(CASE WHEN w IS NOT NULL THEN CASE WHEN w = 0 THEN 1.0 ELSE 0 END END), 9) AS zero_ratio, round(avg(CASE WHEN w IS NOT NULL THEN CASE WHEN w < 0 THEN 1.0 ELSE 0 END END), 9) AS negative_ratio,
  list_transform(quantile_cont(w, [0, 0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99, 1]), lambda x: round(x, 9)) AS quantiles FROM v""")
def ag07(spark: SparkSession, d: str) -> DataFrame:
    s = stats.summary(table(spark, d, "bulk_nmic", "w"), "w")
    return _r(s, 9, "mean", "std", "zero_ratio", "negative_ratio").withColumn("quantiles", F.transform("quantiles", lambda x: F.round(x, 9)))


@REG.add("ag08_perturbation_plan", f"""
WITH {SUPPLIER_BRAND}, s AS (SELECT feat, avg(value) AS m, coalesce(stddev_samp(value), 0) AS s, min(value) AS lo, max(value) AS hi FROM sb GROUP BY feat),
b AS (SELECT feat, greatest(lo, m - 2 * s) AS a, least(hi, m + 2 * s) AS b FROM s)
SELECT feat, CAST(k AS INTEGER) AS step, round(a + (b - a) * k / 4, 6) AS value FROM b, range(5) t(k)""")
def ag08(spark: SparkSession, d: str) -> DataFrame:
    return _r(stats.perturbation_plan(supplier_brand(spark, d), 5), 6, "value")


@REG.add("ag15_value_counts", "SELECT cell_type, count(*) AS n FROM expression GROUP BY cell_type")
def ag15(spark: SparkSession, d: str) -> DataFrame:
    return stats.value_counts(table(spark, d, "expression", "cell_type"), "cell_type")


_MISSING = ("cell_type", "batch", "donor", "tissue", "split")


@REG.add("ag16_missing_report", " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) AS n_rows, count(DISTINCT {c}) AS n_unique, count(*) FILTER (WHERE {c} IS NULL) AS n_null, round(avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0 END), 9) AS missing_rate FROM expression" for c in _MISSING))
def ag16(spark: SparkSession, d: str) -> DataFrame:
    return _r(stats.missing_report(table(spark, d, "expression", *_MISSING), _MISSING), 9, "missing_rate")


@REG.add("ag17_null_cells", "SELECT CAST(count(*) FILTER (WHERE cell_type IS NULL) + count(*) FILTER (WHERE batch IS NULL) + count(*) FILTER (WHERE tissue IS NULL) + count(*) FILTER (WHERE n_genes IS NULL) AS BIGINT) AS n_null FROM expression")
def ag17(spark: SparkSession, d: str) -> DataFrame:
    return stats.null_cells(table(spark, d, "expression", "cell_type", "batch", "tissue", "n_genes"))


@REG.add("ag18_histogram_2d", f"""
WITH {EMB}, a AS (SELECT obs, value AS x FROM emb WHERE feat = 0), b AS (SELECT obs, value AS y FROM emb WHERE feat = 1),
h AS (SELECT CAST(floor(x * 10) AS BIGINT) AS bx, CAST(floor(y * 10) AS BIGINT) AS by_, count(*) AS n FROM a JOIN b USING (obs) GROUP BY ALL)
SELECT bx, by_ AS "by", n, CAST(sum(n) OVER (PARTITION BY bx) AS BIGINT) AS nx, CAST(sum(n) OVER (PARTITION BY by_) AS BIGINT) AS ny FROM h""")
def ag18(spark: SparkSession, d: str) -> DataFrame:
    """Joint counts and marginals of the first two dimensions in bins of 0.1."""
    e = table(spark, d, "embeddings", "embedding").select(*(F.floor(F.get("embedding", F.lit(i)).cast("double") * 10).alias(n) for i, n in enumerate(("bx", "by"))))
    h = e.groupBy("bx", "by").agg(F.count(F.lit(1)).alias("n"))
    return h.withColumn("nx", F.sum("n").over(Window.partitionBy("bx"))).withColumn("ny", F.sum("n").over(Window.partitionBy("by")))


@REG.add("ag19_cv_weights", f"""
WITH {ORDER_BRAND}, s AS (SELECT feat, avg(ln(1 + value)) AS m, stddev_pop(ln(1 + value)) AS sd FROM ob GROUP BY feat),
c AS (SELECT feat, CASE WHEN m > 1e-8 THEN sd / m ELSE 0 END AS cv FROM s), r AS (SELECT min(cv) AS lo, max(cv) AS hi FROM c),
w AS (SELECT feat, 0.5 + 0.5 * CASE WHEN hi > lo THEN (cv - lo) / (hi - lo) ELSE 0.5 END AS w FROM c, r)
SELECT feat, round(least(w, (SELECT quantile_cont(w, 0.99) FROM w)), 6) AS cv_weight FROM w""")
def ag19(spark: SparkSession, d: str) -> DataFrame:
    return _r(stats.cv_weights(order_brand(spark, d)), 6, "cv_weight")


# --------------------------------------------------------- windows and ranks


@REG.add("wn01_argsort", f"WITH {SUPPLIER_BRAND} SELECT feat, obs, CAST(row_number() OVER (PARTITION BY feat ORDER BY value, obs) AS INTEGER) AS r FROM sb")
def wn01(spark: SparkSession, d: str) -> DataFrame:
    return supplier_brand(spark, d).select("feat", "obs", F.row_number().over(Window.partitionBy("feat").orderBy("value", "obs")).alias("r"))


@REG.add("wn02_sorted_by_first", f"""
WITH {EMB}, a AS (SELECT obs, row_number() OVER (ORDER BY value, obs) AS r FROM emb WHERE feat = 0)
SELECT feat, list(value ORDER BY r) AS vec FROM emb JOIN a USING (obs) WHERE feat > 0 GROUP BY feat""")
def wn02(spark: SparkSession, d: str) -> DataFrame:
    """Every other feature in the order of the first one's values."""
    long = embedding_long(spark, d)
    key = long.where("feat = 0").select("obs", F.col("value").alias("k_"))
    return long.where("feat > 0").join(key, "obs").groupBy("feat").agg(F.transform(F.array_sort(F.collect_list(F.struct("k_", "obs", "value"))), lambda r: r["value"]).alias("vec"))


@REG.add("wn03_windows", """
WITH sz AS (SELECT unnest(generate_series(165, 490, 35)) AS size), w AS (SELECT unnest(generate_series(0, 500 - size - 1, 35)) AS s, size FROM sz)
SELECT CAST(s AS INTEGER) AS s, CAST(s + size AS INTEGER) AS e FROM w WHERE s + size <= 499""")
def wn03(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame(windows(500, 165, 490, 35, 35), "s int, e int")


@REG.add("wn04_ratio_windows", """
WITH sz AS (SELECT unnest(generate_series(165, 490, 35)) AS size), w AS (SELECT unnest(generate_series(0, 500 - size - 1, 35)) AS s, size FROM sz)
SELECT CAST(s AS INTEGER) AS s, CAST(s + size AS INTEGER) AS e FROM w WHERE s + size <= 499""")
def wn04(spark: SparkSession, d: str) -> DataFrame:
    """The default shares of 500 values."""
    return spark.createDataFrame(ratio_windows(500), "s int, e int")


_CV = f"WITH {ORDER_BRAND}, c AS (SELECT feat, CASE WHEN avg(value) > 1e-8 THEN stddev_pop(value) / avg(value) ELSE 0 END AS cv FROM ob GROUP BY feat) "


@REG.add("wn05_top_cv", _CV + "SELECT feat, round(cv, 9) AS cv FROM c ORDER BY c.cv DESC, feat LIMIT 10")
def wn05(spark: SparkSession, d: str) -> DataFrame:
    cv = stats.feature_stats(order_brand(spark, d)).select("feat", "cv")
    return _r(stats.top_features(cv, 10), 9, "cv")


@REG.add("wn05_cv_threshold", _CV + "SELECT feat, round(cv, 9) AS cv FROM c WHERE cv >= 0.5")
def wn05_threshold(spark: SparkSession, d: str) -> DataFrame:
    cv = stats.feature_stats(order_brand(spark, d)).select("feat", "cv")
    return _r(stats.top_features(cv, 0, 0.5), 9, "cv")


@REG.add("wn06_min_features", _CV + "SELECT feat FROM c ORDER BY cv DESC, feat LIMIT 5")
def wn06(spark: SparkSession, d: str) -> DataFrame:
    return stats.top_features(stats.feature_stats(order_brand(spark, d)).select("feat", "cv"), 5).select("feat")


@REG.add("wn09_average_rank", """
WITH r AS (SELECT l_orderkey, l_linenumber, l_suppkey, rank() OVER (PARTITION BY l_suppkey ORDER BY l_quantity) - 1 AS r, count(*) OVER (PARTITION BY l_suppkey, l_quantity) AS k FROM lineitem)
SELECT l_orderkey, l_linenumber, l_suppkey, r + (k - 1) / 2 AS rank FROM r""")
def wn09(spark: SparkSession, d: str) -> DataFrame:
    from plexora.operators.metrics import with_rank

    li = table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_suppkey", "l_quantity")
    return with_rank(li, "l_quantity", ["l_suppkey"], "rank").drop("l_quantity")


@REG.add("wn12_row_index", "SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS row FROM orders")
def wn12(spark: SparkSession, d: str) -> DataFrame:
    return reshape.numbered(table(spark, d, "orders", "o_orderkey", "o_orderdate"), ["o_orderdate", "o_orderkey"]).select("o_orderkey", "row")


@REG.add("wn16_best_label", f"WITH {EMB}, m AS (SELECT obs, max(value) AS m FROM emb GROUP BY obs) SELECT obs, min(feat) AS best FROM emb JOIN m USING (obs) WHERE value = m GROUP BY obs")
def wn16(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings", "vec_id", "embedding").select(F.col("vec_id").alias("obs"), S.argmax("embedding").alias("best"))


# --------------------------------------------------------------- guide graph


@REG.add("nm06_nmic", f"""
WITH {EMB}, {_WINDOWS},
r AS (SELECT feat, obs, value, row_number() OVER (PARTITION BY feat ORDER BY value, obs) - 1 AS r FROM emb),
x AS (SELECT a.feat AS i, b.feat AS j, s, e, e - s AS n, a.value AS x, b.value AS y FROM r a JOIN win ON a.r >= s AND a.r < e JOIN emb b ON b.obs = a.obs AND b.feat > a.feat),
k AS (SELECT *, row_number() OVER (PARTITION BY i, j, s, e ORDER BY x) AS rx, row_number() OVER (PARTITION BY i, j, s, e ORDER BY y) AS ry FROM x),
q AS (SELECT i, j, s, e, n, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1,
  max(x) FILTER (WHERE rx = floor(0.5 * n + 0.5)) AS xm, max(x) FILTER (WHERE rx = floor(0.75 * n + 0.5)) AS xu,
  max(y) FILTER (WHERE ry = floor(0.5 * n + 0.5)) AS ym, max(y) FILTER (WHERE ry = floor(0.75 * n + 0.5)) AS yu FROM k GROUP BY ALL),
w AS (SELECT *, 2 * (xu - xm) / cbrt(CAST(n AS DOUBLE)) AS wx, 2 * (yu - ym) / cbrt(CAST(n AS DOUBLE)) AS wy FROM q),
b AS (SELECT *, ceil((x1 - x0) / wx) AS bx, ceil((y1 - y0) / wy) AS by_ FROM w WHERE wx > 0 AND wy > 0),
g AS (SELECT * FROM b WHERE bx BETWEEN 3 AND n AND by_ BETWEEN 3 AND n),
c AS (SELECT x.i, x.j, x.s, x.e, g.n, bx, by_, greatest(floor((x - x0) / wx + 0.5) - 1, 0) AS cx, greatest(floor((y - y0) / wy + 0.5) - 1, 0) AS cy, count(*) AS k
      FROM x JOIN g USING (i, j, s, e) GROUP BY ALL),
m AS (SELECT *, sum(k) OVER (PARTITION BY i, j, s, e, cx) AS kx, sum(k) OVER (PARTITION BY i, j, s, e, cy) AS ky FROM c),
v AS (SELECT i, j, s, e, sum(k / n * log2(k * n / (kx * ky))) / any_value(log2(sqrt(bx * by_))) AS v FROM m GROUP BY i, j, s, e),
pr AS (SELECT DISTINCT i, j FROM x)
SELECT i AS src, j AS dst, round(greatest(coalesce(max(v), 0), 0), 6) AS w FROM pr LEFT JOIN v USING (i, j) GROUP BY i, j""")
def nm06(spark: SparkSession, d: str) -> DataFrame:
    """All pairs of all features over coarse windows and the full range."""
    long = embedding_long(spark, d)
    return _r(nmic.all_pairs(long, _spans(long)), 6, "w")


@REG.add("nm01_guide_graph", f"""
WITH {EMB}, t AS (SELECT count(DISTINCT obs) AS n FROM emb),
z AS (SELECT n, unnest(generate_series(CAST(floor(0.33 * n + 0.5) AS BIGINT), CAST(floor(0.98 * n + 0.5) AS BIGINT), CAST(floor(0.07 * n + 0.5) AS BIGINT))) AS size FROM t),
wi AS (SELECT s, s + size AS e FROM (SELECT n, size, unnest(generate_series(0, n - size - 1, CAST(floor(0.07 * n + 0.5) AS BIGINT))) AS s FROM z) WHERE s + size <= n - 1 UNION ALL SELECT 0, n FROM t),
r AS MATERIALIZED (SELECT feat, obs, value, row_number() OVER (PARTITION BY feat ORDER BY value, obs) - 1 AS r FROM emb),
fx AS MATERIALIZED (SELECT feat AS i, s, e, e - s AS n, min(value) AS x0, max(value) AS x1, max(value) FILTER (WHERE r - s + 1 = floor(0.5 * (e - s) + 0.5)) AS xm, max(value) FILTER (WHERE r - s + 1 = floor(0.75 * (e - s) + 0.5)) AS xu
  FROM r JOIN wi ON r >= s AND r < e GROUP BY ALL),
fb AS MATERIALIZED (SELECT *, ceil((x1 - x0) / wx) AS bx FROM (SELECT *, 2 * (xu - xm) / cbrt(CAST(n AS DOUBLE)) AS wx FROM fx) WHERE wx > 0),
ys AS MATERIALIZED (SELECT a.feat AS i, b.feat AS j, list(b.value ORDER BY a.r) AS y FROM r a JOIN emb b ON b.obs = a.obs AND b.feat > a.feat GROUP BY ALL),
xs AS MATERIALIZED (SELECT feat AS i, list(value ORDER BY r) AS x FROM r GROUP BY ALL),
p AS (SELECT ys.i, j, s, e, n, x0, wx, bx, y[s + 1 : e] AS y, list_sort(y[s + 1 : e]) AS o FROM ys JOIN fb ON fb.i = ys.i WHERE bx BETWEEN 3 AND n),
q AS (SELECT *, o[1] AS y0, 2 * (o[CAST(floor(0.75 * n + 0.5) AS BIGINT)] - o[CAST(floor(0.5 * n + 0.5) AS BIGINT)]) / cbrt(CAST(n AS DOUBLE)) AS wy, o[n] - o[1] AS h FROM p),
g AS (SELECT i, j, s, e, n, x0, wx, bx, y, y0, wy, ceil(h / wy) AS by_ FROM q WHERE wy > 0 AND ceil(h / wy) BETWEEN 3 AND n),
u AS (SELECT g.i, j, s, e, n, bx, by_, x0, wx, y0, wy, unnest(xs.x[s + 1 : e]) AS x, unnest(y) AS y FROM g JOIN xs ON xs.i = g.i),
c AS (SELECT i, j, s, e, n, bx, by_, greatest(floor((x - x0) / wx + 0.5) - 1, 0) AS cx, greatest(floor((y - y0) / wy + 0.5) - 1, 0) AS cy, count(*) AS k FROM u GROUP BY ALL),
m AS (SELECT *, sum(k) OVER (PARTITION BY i, j, s, e, cx) AS kx, sum(k) OVER (PARTITION BY i, j, s, e, cy) AS ky FROM c),
v AS (SELECT i, j, s, e, sum(k / n * log2(k * n / (kx * ky))) / any_value(log2(sqrt(bx * by_))) AS v FROM m GROUP BY i, j, s, e)
SELECT i AS src, j AS dst, round(max(v), 6) AS w FROM v GROUP BY i, j HAVING max(v) > 0.05""")
def nm01(spark: SparkSession, d: str) -> DataFrame:
    """The whole guide-graph plan with its default windows and filters."""
    from plexora.plans.guide_graph import guide_graph

    return _r(guide_graph(embedding_long(spark, d), n_features=5000, pcc=0.95, mi=0.05).edges, 6, "w")


_CORR = f"""WITH {EMB}, p AS (SELECT a.feat AS src, b.feat AS dst, corr(a.value, b.value) AS r FROM emb a JOIN emb b ON a.obs = b.obs AND a.feat < b.feat GROUP BY ALL)"""


@REG.add("nm07_pearson", _CORR + " SELECT src, dst, round(r, 6) AS r FROM p")
def nm07(spark: SparkSession, d: str) -> DataFrame:
    long = embedding_long(spark, d)
    a = long.select("obs", F.col("feat").alias("src"), F.col("value").alias("x"))
    b = long.select("obs", F.col("feat").alias("dst"), F.col("value").alias("y"))
    return a.join(b, "obs").where("src < dst").groupBy("src", "dst").agg(F.round(S.pearson("x", "y"), 6).alias("r"))


@REG.add("nm08_similar_pairs", _CORR + " SELECT src, dst FROM p WHERE abs(r) > 0.1")
def nm08(spark: SparkSession, d: str) -> DataFrame:
    """Without windows the test is the full-range correlation."""
    return nmic.all_pairs(embedding_long(spark, d), [], "similar", 0.1).select("src", "dst")


@REG.add("nm09_without_redundant", _CORR + " SELECT DISTINCT feat FROM emb WHERE feat NOT IN (SELECT src FROM p WHERE abs(r) > 0.1)")
def nm09(spark: SparkSession, d: str) -> DataFrame:
    return nmic.without_redundant(embedding_long(spark, d), [], 0.1)[0].select("feat").distinct()


@REG.add("pr05_threshold", "WITH e AS (SELECT u AS src, v AS dst, max(w) AS w FROM bulk_nmic WHERE u >= 0 AND v >= 0 AND NOT isnan(w) GROUP BY ALL) SELECT src, dst, w FROM e WHERE w > 0.5")
def pr05(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "bulk_nmic", "u", "v", "w").where("u >= 0 and v >= 0 and not isnan(w)")
    return nmic.above(g.groupBy(F.col("u").alias("src"), F.col("v").alias("dst")).agg(F.max("w").alias("w")), 0.5)


@REG.add("pr05_threshold_compat", """
WITH e AS (SELECT u AS src, v AS dst, max(w) AS w FROM bulk_nmic WHERE u >= 0 AND v >= 0 AND NOT isnan(w) GROUP BY ALL)
SELECT src, dst, w FROM (SELECT *, row_number() OVER (ORDER BY w, src DESC, dst DESC) AS r FROM e WHERE w > 0.5) WHERE r > 1""")
def pr05_compat(spark: SparkSession, d: str) -> DataFrame:
    g = table(spark, d, "bulk_nmic", "u", "v", "w").where("u >= 0 and v >= 0 and not isnan(w)")
    return nmic.above(g.groupBy(F.col("u").alias("src"), F.col("v").alias("dst")).agg(F.max("w").alias("w")), 0.5, drop_last=True)
