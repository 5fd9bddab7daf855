"""Joins, set operations, functions, sampling, metrics and model dataflow."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from plexora.functions import scalar as S
from plexora.operators import metrics as M
from plexora.operators import model, reshape, sampling, stats
from plexora.plans.inputs import EMB, NMIC_EDGES, SUPPLIER_BRAND, VOCABULARY, embedding_long, nmic_edges, supplier_brand, vocabulary
from plexora.plans.registry import Registry
from plexora.session import materialize, small_side, table
from plexora.sources import tables

REG = Registry()


def _r(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


# --------------------------------------------------------------------- joins

_LINE = "regexp_extract(obs_names, '([^_]+)$', 1)"
_PHENO = f"ph AS (SELECT {_LINE} AS ecotype, avg(ft16) AS ft16, count(*) AS n_records FROM phenotype WHERE obs_names IS NOT NULL AND ft16 IS NOT NULL AND NOT isnan(ft16) GROUP BY ALL)"


@REG.add("jn01_phenotype_join", f"WITH {_PHENO} SELECT e.obs_id, round(ph.ft16, 6) AS ft16, ph.n_records FROM expression e LEFT JOIN ph ON ph.ecotype = CASE WHEN e.obs_names IS NOT NULL THEN regexp_extract(e.obs_names, '([^_]+)$', 1) END")
def jn01(spark: SparkSession, d: str) -> DataFrame:
    """Observations with the mean phenotype of their line, null without one."""
    eco = F.regexp_extract("obs_names", "([^_]+)$", 1).alias("ecotype")
    p = table(spark, d, "phenotype", "obs_names", "ft16").where(S.finite("ft16") & F.col("obs_names").isNotNull())
    p = p.groupBy(eco).agg(F.avg("ft16").alias("ft16"), F.count(F.lit(1)).alias("n_records"))
    e = table(spark, d, "expression", "obs_id", "obs_names").select("obs_id", eco)
    return _r(e.join(small_side(p), "ecotype", "left").select("obs_id", "ft16", "n_records"), 6, "ft16")


@REG.add("jn02_labels_in_sample_order", "SELECT o_orderkey, c_mktsegment FROM customer RIGHT JOIN orders ON c_custkey = o_custkey ORDER BY o_orderkey")
def jn02(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer", "c_custkey", "c_mktsegment")
    o = table(spark, d, "orders", "o_orderkey", "o_custkey")
    return c.join(o, F.expr("c_custkey = o_custkey"), "right").select("o_orderkey", "c_mktsegment").orderBy("o_orderkey")


@REG.add("jn03_run_identity", "WITH m AS (SELECT npz_id, count(*) AS n, round(avg(w), 6) AS mean FROM bulk_nmic WHERE w IS NOT NULL AND NOT isnan(w) GROUP BY ALL) SELECT m.npz_id, n, mean, CAST(substr(m.npz_id, 11) AS INTEGER) AS run FROM m")
def jn03(spark: SparkSession, d: str) -> DataFrame:
    """Metric summaries with the identity of their run."""
    g = table(spark, d, "bulk_nmic", "npz_id", "w")
    m = g.where("w is not null and not isnan(w)").groupBy("npz_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("w"), 6).alias("mean"))
    run = g.select("npz_id").distinct().withColumn("run", F.substring("npz_id", 11, 9).cast("int"))
    return m.join(run, "npz_id", "left")


@REG.add("jn05_feature_pairs", f"WITH {SUPPLIER_BRAND}, f AS (SELECT DISTINCT feat FROM sb) SELECT a.feat AS i, b.feat AS j FROM f a JOIN f b ON a.feat < b.feat")
def jn05(spark: SparkSession, d: str) -> DataFrame:
    """All ordered pairs of features, as blocks of one sorted list."""
    f = supplier_brand(spark, d).agg(F.array_sort(F.collect_set("feat")).alias("f"))
    i = f.select("f", F.posexplode("f").alias("p", "i"))
    return i.select("i", F.explode(F.slice("f", F.col("p") + 2, F.size("f"))).alias("j"))


_SETS = "o AS (SELECT DISTINCT feature_name AS feat FROM feature_mapping WHERE old_or_new = 'old'), e AS (SELECT DISTINCT src AS feat FROM edge_source WHERE src IS NOT NULL)"


def _name_sets(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    old = table(spark, d, "feature_mapping", "feature_name", "old_or_new").where("old_or_new = 'old'").select(F.col("feature_name").alias("feat"))
    return table(spark, d, "edge_source", "src").where("src is not null").select(F.col("src").alias("feat")), old


@REG.add("jn07_coverage", f"WITH {_SETS} SELECT (SELECT count(*) FROM o JOIN e USING (feat)) AS n_common, (SELECT count(*) FROM o ANTI JOIN e USING (feat)) AS n_missing, (SELECT count(*) FROM e ANTI JOIN o USING (feat)) AS n_extra, round((SELECT count(*) FROM o JOIN e USING (feat)) / (SELECT count(*) FROM o), 9) AS coverage")
def jn07(spark: SparkSession, d: str) -> DataFrame:
    return _r(reshape.coverage(*_name_sets(spark, d)), 9, "coverage")


@REG.add("jn08_missing_per_split", """
WITH s AS (SELECT DISTINCT lower(trim(split)) AS split, cell_type FROM expression WHERE split IS NOT NULL AND cell_type IS NOT NULL), c AS (SELECT DISTINCT cell_type FROM s), p AS (SELECT DISTINCT split FROM s)
SELECT p.split, count(*) FILTER (WHERE s.cell_type IS NULL) AS n_missing FROM p CROSS JOIN c LEFT JOIN s ON s.split = p.split AND s.cell_type = c.cell_type GROUP BY p.split""")
def jn08(spark: SparkSession, d: str) -> DataFrame:
    """How many of all classes each split lacks."""
    e = table(spark, d, "expression", "split", "cell_type").where("split is not null and cell_type is not null").select(F.lower(F.trim("split")).alias("split"), "cell_type")
    n = e.agg(F.count_distinct("cell_type")).scalar()
    return e.groupBy("split").agg(F.count_distinct("cell_type").alias("k")).select("split", (n - F.col("k")).alias("n_missing"))


@REG.add("jn10_label_pick", "SELECT o.o_orderkey, e.label FROM orders o LEFT JOIN (SELECT vec_id, label FROM embeddings) e ON e.vec_id = o.o_orderkey")
def jn10(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders", "o_orderkey")
    e = table(spark, d, "embeddings", "vec_id", "label")
    return o.join(e, F.expr("vec_id = o_orderkey"), "left").select("o_orderkey", "label")


@REG.add("jn11_positional_join", """
WITH a AS (SELECT s_name, row_number() OVER (ORDER BY s_suppkey) - 1 AS r FROM supplier), b AS (SELECT n_name, row_number() OVER (ORDER BY n_nationkey) - 1 AS r FROM nation) SELECT 'run' AS kind, r, s_name, n_name FROM a JOIN b USING (r)""")
def jn11(spark: SparkSession, d: str) -> DataFrame:
    a = reshape.numbered(table(spark, d, "supplier", "s_suppkey", "s_name"), ["s_suppkey"], "r")
    b = reshape.numbered(table(spark, d, "nation", "n_nationkey", "n_name"), ["n_nationkey"], "r")
    return a.join(b, "r").select(F.lit("run").alias("kind"), "r", "s_name", "n_name")


@REG.add("jn12_aligned_matrix", f"WITH {SUPPLIER_BRAND}, v AS (SELECT 'Brand#' || k AS feat FROM range(11, 40) t(k)), o AS (SELECT DISTINCT obs FROM sb) SELECT o.obs, v.feat, coalesce(sb.value, 0) AS value FROM o CROSS JOIN v LEFT JOIN sb ON sb.obs = o.obs AND sb.feat = v.feat")
def jn12(spark: SparkSession, d: str) -> DataFrame:
    """A matrix in a vocabulary's terms: absent features 0, others dropped."""
    voc = spark.range(11, 40).select(F.concat(F.lit("Brand#"), F.col("id").cast("string")).alias("feat"))
    return reshape.aligned(supplier_brand(spark, d), voc)


# truth: one dimension; prediction: the next one
_PAIRS = f"WITH {EMB}, pr AS (SELECT a.obs, a.feat, a.value AS t, b.value AS p FROM emb a JOIN emb b ON a.obs = b.obs AND b.feat = (a.feat + 1) % 64)"


def _pairs(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings", "vec_id", "embedding")
    z = F.transform("embedding", lambda x, i: F.struct(i.alias("feat"), x.cast("double").alias("t"), F.get("embedding", (i + 1) % 64).cast("double").alias("p")))
    return e.select(F.col("vec_id").alias("obs"), F.explode(z).alias("r")).select("obs", "r.*")


@REG.add("jn13_aligned_predictions", _PAIRS + " SELECT obs, feat, t, p FROM pr")
def jn13(spark: SparkSession, d: str) -> DataFrame:
    long = embedding_long(spark, d)
    pred = long.select("obs", F.pmod(F.col("feat") - 1, F.lit(64)).alias("feat"), F.col("value").alias("p"))
    return long.withColumnRenamed("value", "t").join(pred, ["obs", "feat"])


@REG.add("pr17_present_absent", f"""
WITH {EMB}, k AS (SELECT obs, feat, value FROM emb WHERE abs(value) > 0.1) SELECT emb.obs, k.feat IS NOT NULL AS present, count(*) AS n, round(avg(emb.value), 6) AS mean_p FROM emb LEFT JOIN k USING (obs, feat) GROUP BY ALL""")
def pr17(spark: SparkSession, d: str) -> DataFrame:
    long = embedding_long(spark, d)
    out = model.by_presence(long.withColumnRenamed("value", "p"), long.where(F.abs("value") > 0.1))
    return out.groupBy("obs", "present").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("p"), 6).alias("mean_p"))


# ------------------------------------------------------------- set operations


@REG.add("so01_stacked", "SELECT npz_id AS kind, u AS a, v AS b FROM bulk_nmic UNION ALL SELECT edge_source, src_expanded_idx, dst_expanded_idx FROM edge_source")
def so01(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "bulk_nmic", "npz_id", "u", "v").toDF("kind", "a", "b")
    return reshape.stacked([a, table(spark, d, "edge_source", "edge_source", "src_expanded_idx", "dst_expanded_idx").toDF("kind", "a", "b")])


@REG.add("so02_diagonal", "SELECT n_name AS name, n_regionkey, CAST(NULL AS DOUBLE) AS s_acctbal FROM nation UNION ALL SELECT s_name, NULL, s_acctbal FROM supplier")
def so02(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "nation", "n_name", "n_regionkey").withColumnRenamed("n_name", "name")
    return reshape.stacked([a, table(spark, d, "supplier", "s_name", "s_acctbal").withColumnRenamed("s_name", "name")], diagonal=True)


@REG.add("so03_intersection", f"WITH {_SETS} SELECT feat FROM o INTERSECT SELECT feat FROM e")
def so03(spark: SparkSession, d: str) -> DataFrame:
    e, o = _name_sets(spark, d)
    return reshape.name_sets(o, e, "feat")["common"]


@REG.add("so04_difference", f"WITH {_SETS} SELECT feat FROM o EXCEPT SELECT feat FROM e")
def so04(spark: SparkSession, d: str) -> DataFrame:
    e, o = _name_sets(spark, d)
    return reshape.name_sets(o, e, "feat")["missing"]


@REG.add("so06_first_seen", "SELECT src, min(edge_id) AS edge_id FROM edge_source GROUP BY src")
def so06(spark: SparkSession, d: str) -> DataFrame:
    return reshape.first_seen(table(spark, d, "edge_source", "src", "edge_id"), "src", "edge_id")


@REG.add("sl08_groups_by_size", "SELECT cell_type, count(*) AS n FROM expression GROUP BY cell_type ORDER BY n DESC, cell_type")
def sl08(spark: SparkSession, d: str) -> DataFrame:
    return stats.value_counts(table(spark, d, "expression", "cell_type"), "cell_type").orderBy(F.desc("n"), "cell_type")


# ------------------------------------------------------- functions and files

_FILES = """f AS (SELECT 'dir/' || CASE c_custkey % 5 WHEN 0 THEN '' WHEN 1 THEN '.' ELSE 'x+' END || 'seed_' || (c_custkey % 10) || '+' || c_mktsegment || '+' || (c_custkey % 3) || CASE WHEN c_custkey % 7 = 0 THEN '.txt' ELSE '.h5' END AS path FROM customer)"""


def _files(spark: SparkSession, d: str) -> DataFrame:
    sql = "concat('dir/', CASE c_custkey % 5 WHEN 0 THEN '' WHEN 1 THEN '.' ELSE 'x+' END, 'seed_', c_custkey % 10, '+', c_mktsegment, '+', c_custkey % 3, CASE WHEN c_custkey % 7 = 0 THEN '.txt' ELSE '.h5' END)"
    return table(spark, d, "customer", "c_custkey", "c_mktsegment").select(F.expr(sql).alias("path"))


@REG.add("io17_prediction_files", f"""
WITH {_FILES}, n AS (SELECT path, regexp_extract(path, '([^/]+)$', 1) AS fname FROM f), p AS (SELECT *, list_reverse(string_split(regexp_replace(fname, '\\.h5$', ''), '+')) AS x FROM n WHERE fname LIKE '%.h5' AND fname NOT LIKE '.%')
SELECT fname, x[3] AS seed, TRY_CAST(regexp_extract(x[3], '^seed_(-?[0-9]+)$', 1) AS INTEGER) AS seed_num, x[2] AS task, x[1] AS split, path FROM p WHERE len(x) IN (3, 4)""")
def io17(spark: SparkSession, d: str) -> DataFrame:
    return tables.prediction_files(_files(spark, d))


@REG.add("sl07_first_per_seed", f"WITH {_FILES} SELECT regexp_extract(path, 'seed_[0-9]+') AS seed, min(path) AS path FROM f WHERE path LIKE '%.h5' AND path NOT LIKE 'dir/.%' GROUP BY ALL")
def sl07(spark: SparkSession, d: str) -> DataFrame:
    return tables.first_per_seed(tables.prediction_files(_files(spark, d)))


@REG.add("io25_best_checkpoint", """
WITH f AS (SELECT c_mktsegment AS run, 'epoch=' || c_custkey || CASE WHEN c_custkey % 4 = 0 THEN '' ELSE '-val_loss=' || printf('%.3f', abs(c_acctbal) / 1000) END || '.ckpt' AS path FROM customer),
l AS (SELECT run, path, coalesce(TRY_CAST(regexp_extract(path, 'val_loss=([0-9]*\\.?[0-9]+)', 1) AS DOUBLE), 'inf'::DOUBLE) AS val_loss FROM f)
SELECT run, path, val_loss FROM l QUALIFY row_number() OVER (PARTITION BY run ORDER BY val_loss, path) = 1""")
def io25(spark: SparkSession, d: str) -> DataFrame:
    sql = "concat('epoch=', c_custkey, CASE WHEN c_custkey % 4 = 0 THEN '' ELSE concat('-val_loss=', printf('%.3f', abs(c_acctbal) / 1000)) END, '.ckpt')"
    f = table(spark, d, "customer", "c_custkey", "c_mktsegment", "c_acctbal").select(F.col("c_mktsegment").alias("run"), F.expr(sql).alias("path"))
    return tables.best_checkpoint(f, "run")


@REG.add("io15_resume", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def io15(spark: SparkSession, d: str) -> DataFrame:
    done = table(spark, d, "lineitem", "l_orderkey", "l_returnflag").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return tables.done_keys(done, table(spark, d, "orders", "o_orderkey"), "o_orderkey")


@REG.add("io23_event_logs", "SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, min(ts) AS first_ts, max(ts) AS last_ts FROM events GROUP BY event_type")
def io23(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events", "event_type", "value", "ts").groupBy("event_type")
    return e.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@REG.add("io24_best_trials", "SELECT user_id, min(value) AS best_value, arg_min(event_id, (value, event_id)) AS best_params, count(*) AS n_trials FROM events WHERE value IS NOT NULL GROUP BY user_id")
def io24(spark: SparkSession, d: str) -> DataFrame:
    return tables.best_trials(table(spark, d, "events", "user_id", "value", "event_id"), "user_id", "value", "event_id")


@REG.add("io26_natural_order", "SELECT x, row_number() OVER (ORDER BY TRY_CAST(x AS BIGINT) IS NULL, TRY_CAST(x AS BIGINT), x) AS r FROM (SELECT DISTINCT CAST(p_size AS VARCHAR) AS x FROM part UNION SELECT DISTINCT p_brand FROM part)")
def io26(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part", "p_size", "p_brand")
    x = p.select(F.col("p_size").cast("string").alias("x")).union(p.select("p_brand")).distinct()
    return x.select("x", F.row_number().over(Window.orderBy(*S.natural_order("x"))).cast("long").alias("r"))


@REG.add("fn01_math", """
SELECT o_orderkey, round(ln(1 + o_totalprice), 9) AS l, round(cbrt(o_totalprice), 9) AS c, round(log2(o_totalprice), 9) AS g, CAST(sign(o_totalprice / 7 - 5000) * floor(abs(o_totalprice / 7 - 5000) + 0.5) AS BIGINT) AS r,
  round(exp(-o_totalprice / 1e6), 9) AS e, least(greatest(o_totalprice, 1000), 200000) AS k FROM orders""")
def fn01(spark: SparkSession, d: str) -> DataFrame:
    x = F.col("o_totalprice")
    return table(spark, d, "orders", "o_orderkey", "o_totalprice").select(
        "o_orderkey", F.round(F.log1p(x), 9).alias("l"), F.round(F.cbrt(x), 9).alias("c"), F.round(F.log2(x), 9).alias("g"), S.round_half_away(x / 7 - 5000).alias("r"), F.round(F.exp(-x / 1e6), 9).alias("e"), F.least(F.greatest(x, F.lit(1000.0)), F.lit(200000.0)).alias("k")
    )


@REG.add("fn02_strings", """
SELECT obs_id, CASE WHEN obs_names IS NULL THEN NULL ELSE list_last(string_split(obs_names, '_')) END AS token, regexp_replace(obs_names, '[^A-Za-z0-9._-]+', '_', 'g') AS clean, replace(tissue, 'root', '') AS cut, lower(batch) AS low FROM expression""")
def fn02_strings(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "expression", "obs_id", "obs_names", "tissue", "batch")
    return e.select("obs_id", S.suffix_token("obs_names").alias("token"), S.sanitized("obs_names").alias("clean"), S.without_prefix("tissue", "root").alias("cut"), F.lower("batch").alias("low"))


@REG.add("fn03_arrays", """
SELECT vec_id, round(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])), 5) AS dot, CAST(list_position(embedding, list_max(embedding)) - 1 AS INTEGER) AS best, len(embedding[1:8]) AS n FROM embeddings""")
def fn03(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings", "vec_id", "embedding")
    return e.select("vec_id", F.round(S.dot("embedding", "embedding"), 5).alias("dot"), S.argmax("embedding").alias("best"), F.size(F.slice("embedding", 1, 8)).cast("long").alias("n"))


@REG.add("fn04_maps", f"WITH {VOCABULARY} SELECT old_or_new, count(*) AS n, max(idx) AS last FROM vo GROUP BY ALL")
def fn04(spark: SparkSession, d: str) -> DataFrame:
    """A vocabulary as one map per kind, looked up again."""
    v = vocabulary(spark, d).groupBy("old_or_new").agg(F.map_from_entries(F.collect_list(F.struct("name", "idx"))).alias("m"))
    return v.select("old_or_new", F.size("m").cast("long").alias("n"), F.array_max(F.map_values("m")).alias("last"))


@REG.add("fn05_json", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events")
def fn05(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events", "event_id", "props").select("event_id", F.get_json_object("props", "$.k").alias("k"))


@REG.add("fn06_run_stamps", "SELECT event_id, strftime(ts, '%Y%m%d%H%M%S') AS stamp FROM events")
def fn06(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events", "event_id", "ts").select("event_id", F.date_format("ts", "yyyyMMddHHmmss").alias("stamp"))


@REG.add("fn07_safe_floats", "SELECT edge_id, CASE WHEN edge_weight IS NULL OR isnan(edge_weight) OR isinf(edge_weight) THEN 0 ELSE CAST(edge_weight AS DOUBLE) END AS w FROM edge_source")
def fn07(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "edge_source", "edge_id", "edge_weight").select("edge_id", S.safe_float("edge_weight").alias("w"))


@REG.add("fn08_hashes", "SELECT o_orderkey, md5('7:' || o_orderkey) AS h FROM orders")
def fn08(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders", "o_orderkey").select("o_orderkey", sampling.hash_order("o_orderkey", 7).alias("h"))


# ------------------------------------------------------ splits and balancing

_ORDERS = "SELECT o_orderkey, o_orderpriority, o_orderstatus, row_number() OVER (PARTITION BY {by} ORDER BY md5('7:' || o_orderkey), o_orderkey) AS r, count(*) OVER (PARTITION BY {by}) AS n FROM orders"
_PRI = _ORDERS.format(by="o_orderpriority")


def _orders(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders", "o_orderkey", "o_orderpriority", "o_orderstatus")


@REG.add("sp01_random_split", f"SELECT o_orderkey, CASE WHEN r <= floor(n * 0.8 + 1e-9) THEN 'trn' WHEN r <= floor(n * 0.9 + 1e-9) THEN 'val' ELSE 'tst' END AS split FROM ({_ORDERS.format(by='1')})")
def sp01(spark: SparkSession, d: str) -> DataFrame:
    return sampling.random_split(_orders(spark, d), "o_orderkey", 7).select("o_orderkey", "split")


@REG.add("sp02_stratified_split", f"SELECT o_orderkey, CASE WHEN r <= floor(n * 0.8 + 1e-9) THEN 'trn' WHEN r <= floor(n * 0.9 + 1e-9) THEN 'val' ELSE 'tst' END AS split FROM ({_PRI})")
def sp02(spark: SparkSession, d: str) -> DataFrame:
    return sampling.random_split(_orders(spark, d), "o_orderkey", 7, strata=["o_orderpriority"]).select("o_orderkey", "split")


@REG.add("sp03_joint_split", f"SELECT o_orderkey, CASE WHEN r <= round_even(n * 0.8, 0) THEN 'trn' WHEN r <= round_even(n * 0.8, 0) + round_even(n * 0.1, 0) THEN 'val' ELSE 'tst' END AS split FROM ({_ORDERS.format(by='o_orderpriority, o_orderstatus')})")
def sp03(spark: SparkSession, d: str) -> DataFrame:
    return sampling.joint_split(_orders(spark, d), "o_orderkey", 7, ["o_orderpriority", "o_orderstatus"]).select("o_orderkey", "split")


def _balance_sql(goal: str) -> str:
    return f"WITH b AS ({_PRI}), g AS (SELECT {goal} AS g FROM (SELECT DISTINCT o_orderpriority, n FROM b)) SELECT o_orderkey, CAST(unnest(generate_series(0, CAST((g - r) // n AS BIGINT))) AS BIGINT) AS copy FROM b, g WHERE r <= g"


def _balanced(spark: SparkSession, d: str, how: str) -> DataFrame:
    return sampling.balance(_orders(spark, d), "o_orderkey", 7, ["o_orderpriority"], how).select("o_orderkey", F.col("copy_").alias("copy"))


@REG.add("sp04_oversampled", _balance_sql("max(n)"))
def sp04(spark: SparkSession, d: str) -> DataFrame:
    return _balanced(spark, d, "over")


@REG.add("sp05_undersampled", _balance_sql("min(n)"))
def sp05(spark: SparkSession, d: str) -> DataFrame:
    return _balanced(spark, d, "under")


@REG.add("sp06_combined", _balance_sql("CAST(floor(avg(n)) AS BIGINT)"))
def sp06(spark: SparkSession, d: str) -> DataFrame:
    return _balanced(spark, d, "combined")


@REG.add("sp07_retained", f"SELECT o_orderkey FROM ({_PRI}) WHERE r <= greatest(1, floor(n * 0.3 + 1e-9))")
def sp07(spark: SparkSession, d: str) -> DataFrame:
    return sampling.retain(_orders(spark, d), "o_orderkey", 7, ["o_orderpriority"], 0.3).select("o_orderkey")


@REG.add("sp08_balanced_split", f"""WITH b AS ({_PRI}), g AS (SELECT max(n) AS g FROM b), u AS (SELECT o_orderkey, CAST(unnest(generate_series(0, CAST((g - r) // n AS BIGINT))) AS BIGINT) AS copy FROM b, g WHERE r <= g),
k AS (SELECT *, row_number() OVER (ORDER BY md5('8:' || o_orderkey || '#' || copy), o_orderkey || '#' || copy) AS r, count(*) OVER () AS n FROM u)
SELECT o_orderkey, copy, CASE WHEN r <= floor(n * 0.8 + 1e-9) THEN 'trn' WHEN r <= floor(n * 0.9 + 1e-9) THEN 'val' ELSE 'tst' END AS split FROM k""")
def sp08(spark: SparkSession, d: str) -> DataFrame:
    """The compatible order: balanced first, so repeats may straddle splits."""
    out = sampling.balanced_split(_orders(spark, d), "o_orderkey", 7, ["o_orderpriority"], "over", first_split=False)
    return out.select("o_orderkey", F.col("copy_").alias("copy"), "split")


# ------------------------------------------------------------------- metrics


@REG.add("mt01_errors", _PAIRS + " SELECT feat, round(avg((p - t) * (p - t)), 6) AS mse, round(avg(abs(p - t)), 6) AS mae, round(corr(t, p), 6) AS pearson FROM pr GROUP BY feat")
def mt01(spark: SparkSession, d: str) -> DataFrame:
    return _r(M.errors(_pairs(spark, d), "feat"), 6, "mse", "mae", "pearson")


_JSD = "e AS (SELECT {a}, exp(t - max(t) OVER (PARTITION BY {a})) AS x, exp(p - max(p) OVER (PARTITION BY {a})) AS y FROM pr), q AS (SELECT {a}, x / sum(x) OVER (PARTITION BY {a}) AS x, y / sum(y) OVER (PARTITION BY {a}) AS y FROM e), js AS (SELECT {a}, (sum(x * ln(x / ((x + y) / 2))) + sum(y * ln(y / ((x + y) / 2)))) / 2 AS jsd FROM q GROUP BY {a})"
_SPEAR = "k AS (SELECT {a}, rank() OVER (PARTITION BY {a} ORDER BY t) + (count(*) OVER (PARTITION BY {a}, t) - 1) / 2 AS rt, rank() OVER (PARTITION BY {a} ORDER BY p) + (count(*) OVER (PARTITION BY {a}, p) - 1) / 2 AS rp FROM pr), sp AS (SELECT {a}, corr(rt, rp) AS spearman FROM k GROUP BY {a})"


@REG.add("mt02_jsd", _PAIRS + ", " + _JSD.format(a="obs") + " SELECT obs, round(jsd, 9) AS jsd FROM js")
def mt02(spark: SparkSession, d: str) -> DataFrame:
    return _r(M.jsd(_pairs(spark, d), "obs"), 9, "jsd")


@REG.add("mt03_pearson", _PAIRS + " SELECT obs, round(corr(t, p), 6) AS pearson FROM pr GROUP BY obs")
def mt03(spark: SparkSession, d: str) -> DataFrame:
    return _r(M.errors(_pairs(spark, d), "obs").select("obs", "pearson"), 6, "pearson")


@REG.add("mt04_spearman", _PAIRS + ", " + _SPEAR.format(a="obs") + " SELECT obs, round(spearman, 6) AS spearman FROM sp")
def mt04(spark: SparkSession, d: str) -> DataFrame:
    return _r(M.spearman(_pairs(spark, d), "obs"), 6, "spearman")


def _side(a: str, n: str) -> str:
    return (
        f"{n} AS (WITH " + _JSD.format(a=a) + ", " + _SPEAR.format(a=a) + f", b AS (SELECT {a}, avg((p - t) * (p - t)) AS mse, avg(abs(p - t)) AS mae, corr(t, p) AS pearson FROM pr GROUP BY {a}), "
        f"o AS (SELECT avg(mse) AS mse, avg(mae) AS mae, avg(pearson) AS pearson, avg(jsd) AS jsd, avg(spearman) AS spearman FROM b JOIN js USING ({a}) JOIN sp USING ({a})) UNPIVOT o ON mse, mae, pearson, jsd, spearman INTO NAME metric VALUE {n}_mean)"
    )


@REG.add("mt05_regression_table", _PAIRS + ", " + _side("obs", "sample") + ", " + _side("feat", "feature") + " SELECT metric, round(sample_mean, 6) AS sample_mean, round(feature_mean, 6) AS feature_mean FROM sample JOIN feature USING (metric)")
def mt05(spark: SparkSession, d: str) -> DataFrame:
    return _r(M.regression_table(materialize(_pairs(spark, d), "pairs")), 6, "sample_mean", "feature_mean")


# scores of a class: negative squared distance to its centroid
_SCORES = """WITH v AS (SELECT vec_id AS obs, label AS truth, unnest(range(64)) AS pos, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),
c AS (SELECT truth AS cls, pos, avg(x) AS m FROM v GROUP BY ALL), s AS (SELECT obs, truth, cls, round(-sum((x - m) * (x - m)), 9) AS score FROM v JOIN c USING (pos) GROUP BY ALL),
pb AS (SELECT *, exp(score - max(score) OVER (PARTITION BY obs)) / sum(exp(score)) OVER (PARTITION BY obs) * exp(max(score) OVER (PARTITION BY obs)) AS prob FROM s),
bs AS (SELECT obs, truth, cls AS pred FROM s QUALIFY row_number() OVER (PARTITION BY obs ORDER BY score DESC, cls) = 1)"""


def _scores(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """``(obs, class, score)`` and ``(obs, truth)`` of the embeddings."""
    from plexora.operators.network import mean_vectors

    e = table(spark, d, "embeddings", "vec_id", "embedding", "label").toDF("obs", "vec", "truth")
    c = small_side(mean_vectors(e, "truth", "vec").select(F.col("truth").alias("class"), F.col("vec").alias("m")))
    every = c.groupBy().agg(F.collect_list(F.struct("class", "m")).alias("c_"))
    dist = F.aggregate(F.zip_with("vec", F.col("c.m"), lambda x, y: F.pow(x.cast("double") - y, F.lit(2))), F.lit(0.0), lambda a, b: a + b)
    s = e.join(F.broadcast(every)).select("obs", "vec", F.explode("c_").alias("c")).select("obs", F.col("c.class").alias("class"), F.round(-dist, 9).alias("score"))
    return materialize(s, "scores"), e.select("obs", "truth")


@REG.add("mt10_softmax", _SCORES + " SELECT obs, cls AS class, round(prob, 9) AS prob FROM pb")
def mt10(spark: SparkSession, d: str) -> DataFrame:
    p = materialize(M.softmaxed(_scores(spark, d)[0]), "probs")
    M.require_distribution(p)
    return _r(p.select("obs", "class", "prob"), 9, "prob")


def _confusion(spark: SparkSession, d: str) -> DataFrame:
    s, t = _scores(spark, d)
    return materialize(M.confusion(M.best_class(s, "score").join(t, "obs")), "confusion")


@REG.add("mt09_confusion", _SCORES + " SELECT truth, pred, count(*) AS n FROM bs GROUP BY ALL")
def mt09(spark: SparkSession, d: str) -> DataFrame:
    return _confusion(spark, d)


@REG.add("mt06_class_scores", _SCORES + """, t AS (SELECT truth AS c, count(*) AS s FROM bs GROUP BY ALL), p AS (SELECT pred AS c, count(*) AS k FROM bs GROUP BY ALL), h AS (SELECT truth AS c, count(*) AS h FROM bs WHERE truth = pred GROUP BY ALL),
a AS (SELECT c, coalesce(s, 0) AS s, coalesce(k, 0) AS k, coalesce(h, 0) AS h FROM (SELECT c FROM t UNION SELECT c FROM p) LEFT JOIN t USING (c) LEFT JOIN p USING (c) LEFT JOIN h USING (c))
SELECT round(sum(h) / sum(s), 9) AS accuracy, round(avg(2 * h / (s + k)), 9) AS f1_macro, round(sum(h) / sum(s), 9) AS f1_micro, round(sum(2 * h / (s + k) * s) / sum(s), 9) AS f1_weighted,
  round(sum(CASE WHEN k > 0 THEN h / k ELSE 0 END * s) / sum(s), 9) AS precision_weighted, round(sum(CASE WHEN s > 0 THEN h / s ELSE 0 END * s) / sum(s), 9) AS recall_weighted FROM a""")
def mt06(spark: SparkSession, d: str) -> DataFrame:
    out = M.class_scores(_confusion(spark, d))
    return _r(out, 9, *out.columns)


_AUC = _SCORES + """, r AS (SELECT cls, score, truth = cls AS y FROM s), g AS (SELECT cls, score, count(*) AS k, count(*) FILTER (WHERE y) AS pos FROM r GROUP BY ALL),
w AS (SELECT *, coalesce(sum(k) OVER (PARTITION BY cls ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (k + 1) / 2 AS rk, sum(pos) OVER (PARTITION BY cls ORDER BY score DESC) AS tp, sum(k) OVER (PARTITION BY cls ORDER BY score DESC) AS called,
  sum(pos) OVER (PARTITION BY cls) AS np, sum(k) OVER (PARTITION BY cls) AS n FROM g),
au AS (SELECT cls AS class, CAST(max(np) AS BIGINT) AS support, (sum(pos * rk) - max(np) * (max(np) + 1) / 2) / (max(np) * (max(n) - max(np))) AS auroc, sum(pos / np * tp / called) AS auprc FROM w GROUP BY cls)"""


@REG.add("mt07_auroc", _AUC + " SELECT class, support, round(auroc, 9) AS auroc, round(auprc, 9) AS auprc FROM au")
def mt07(spark: SparkSession, d: str) -> DataFrame:
    """Areas per class, by ranks of the scores before any rounding."""
    s, t = _scores(spark, d)
    return _r(M.auroc(s.withColumnRenamed("score", "prob"), t), 9, "auroc", "auprc")


@REG.add("mt08_weighted_areas", _AUC + " SELECT round(sum(auroc * support) / sum(support), 9) AS auroc, round(sum(auprc * support) / sum(support), 9) AS auprc FROM au")
def mt08(spark: SparkSession, d: str) -> DataFrame:
    s, t = _scores(spark, d)
    return _r(M.weighted_auc(M.auroc(s.withColumnRenamed("score", "prob"), t)), 9, "auroc", "auprc")


@REG.add("mt11_clustering", _SCORES + """, k AS (SELECT truth, pred, CAST(count(*) AS DOUBLE) AS n FROM bs GROUP BY ALL), a AS (SELECT truth, sum(n) AS a FROM k GROUP BY ALL), b AS (SELECT pred, sum(n) AS b FROM k GROUP BY ALL), t AS (SELECT sum(n) AS t, sum(n * (n - 1) / 2) AS sij FROM k),
x AS (SELECT sum(a * (a - 1) / 2) AS sa, sum(-a / t * ln(a / t)) AS ha FROM a, t), y AS (SELECT sum(b * (b - 1) / 2) AS sb, sum(-b / t * ln(b / t)) AS hb FROM b, t), m AS (SELECT sum(n / t * ln(n * t / (a * b))) AS mi FROM k JOIN a USING (truth) JOIN b USING (pred), t)
SELECT round((sij - sa * sb / (t * (t - 1) / 2)) / ((sa + sb) / 2 - sa * sb / (t * (t - 1) / 2)), 9) AS ari, round(mi / ((ha + hb) / 2), 9) AS nmi FROM t, x, y, m""")
def mt11(spark: SparkSession, d: str) -> DataFrame:
    return _r(M.clustering_scores(_confusion(spark, d)), 9, "ari", "nmi")


@REG.add("mt11_ami", _SCORES + """, kk AS (SELECT truth, pred, CAST(count(*) AS DOUBLE) AS n FROM bs GROUP BY ALL), aa AS (SELECT truth, sum(n) AS a FROM kk GROUP BY ALL), bb AS (SELECT pred, sum(n) AS b FROM kk GROUP BY ALL), tt AS (SELECT sum(n) AS t FROM kk),
hh AS (SELECT (SELECT sum(-a / t * ln(a / t)) FROM aa, tt) AS ha, (SELECT sum(-b / t * ln(b / t)) FROM bb, tt) AS hb, (SELECT sum(n / t * ln(n * t / (a * b))) FROM kk JOIN aa USING (truth) JOIN bb USING (pred), tt) AS mi),
ci AS (SELECT a, b, t, CAST(unnest(generate_series(CAST(greatest(1, a + b - t) AS BIGINT), CAST(least(a, b) AS BIGINT))) AS DOUBLE) AS n FROM aa, bb, tt),
em AS (SELECT sum(n / t * ln(t * n / (a * b)) * exp(lgamma(a + 1) + lgamma(b + 1) + lgamma(t - a + 1) + lgamma(t - b + 1) - lgamma(t + 1) - lgamma(n + 1) - lgamma(a - n + 1) - lgamma(b - n + 1) - lgamma(t - a - b + n + 1))) AS e FROM ci)
SELECT round((mi - e) / ((ha + hb) / 2 - e), 6) AS ami FROM hh, em""")
def mt11_ami(spark: SparkSession, d: str) -> DataFrame:
    return _r(spark.createDataFrame([(M.adjusted_mutual_information(_confusion(spark, d)),)], "ami double"), 6, "ami")


@REG.add("mt12_silhouette", """
WITH v AS (SELECT vec_id AS i, label AS l, CAST(embedding AS DOUBLE[]) AS x FROM embeddings), d AS (SELECT a.i, a.l AS li, b.l AS lj, avg(list_distance(a.x, b.x)) AS d FROM v a JOIN v b ON a.i <> b.i GROUP BY ALL),
s AS (SELECT i, max(d) FILTER (WHERE li = lj) AS a, min(d) FILTER (WHERE li <> lj) AS b FROM d GROUP BY i), m AS (SELECT avg(CASE WHEN a IS NULL OR b IS NULL OR greatest(a, b) = 0 THEN 0 ELSE (b - a) / greatest(a, b) END) AS s FROM s)
SELECT round(s, 6) AS silhouette, round((s + 1) / 2, 6) AS silhouette_label FROM m""")
def mt12(spark: SparkSession, d: str) -> DataFrame:
    return _r(M.silhouette(table(spark, d, "embeddings", "vec_id", "label", "embedding").toDF("obs", "label", "vec")), 6, "silhouette", "silhouette_label")


# 16.918977604620448 is the upper 5 % point of chi-squared with nine degrees of freedom: ten labels
@REG.add("mt13_batch_mixing", """
WITH v AS (SELECT vec_id AS i, label AS b, CAST(embedding AS DOUBLE[]) AS x FROM embeddings), p AS (SELECT a.i, b.b, list_distance(a.x, b.x) AS d, b.i AS j FROM v a JOIN v b ON a.i <> b.i),
k AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY i ORDER BY d, j) <= 20), o AS (SELECT i, b, count(*) AS o FROM k GROUP BY ALL),
e AS (SELECT b, count(*) / (SELECT count(*) FROM v) * 20 AS e FROM v GROUP BY b), s AS (SELECT i, sum(o * o / e) - sum(o) AS x FROM o JOIN e USING (b) GROUP BY i)
SELECT count(*) AS n, count(*) FILTER (WHERE x > 16.918977604620448) AS rejected, round(avg(CASE WHEN x <= 16.918977604620448 THEN 1.0 ELSE 0.0 END), 9) AS acceptance FROM s""")
def mt13(spark: SparkSession, d: str) -> DataFrame:
    from plexora.operators.batch_mixing import neighbourhood_chi2

    e = table(spark, d, "embeddings", "vec_id", "label", "embedding").toDF("node", "batch", "vec")
    return _r(neighbourhood_chi2(e, 20), 9, "acceptance")


@REG.add("mt14_regression_scores", """
WITH r AS (SELECT l_extendedprice AS t, l_quantity * 1500 AS p FROM lineitem), k AS (SELECT *, rank() OVER (ORDER BY t) + (count(*) OVER (PARTITION BY t) - 1) / 2 AS rt, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2 AS rp FROM r)
SELECT count(*) AS n, round(avg((p - t) * (p - t)), 1) AS mse, round(sqrt(avg((p - t) * (p - t))), 4) AS rmse, round(avg(abs(p - t)), 4) AS mae, round(1 - sum((p - t) * (p - t)) / (var_pop(t) * count(*)), 6) AS r2, round(corr(t, p), 6) AS pearson, round(corr(rt, rp), 6) AS spearman FROM k""")
def mt14(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem", "l_extendedprice", "l_quantity").select(F.col("l_extendedprice").alias("t"), (F.col("l_quantity") * 1500).alias("p"))
    return _r(_r(_r(M.regression_scores(li, "t", "p"), 1, "mse"), 4, "rmse", "mae"), 6, "r2", "pearson", "spearman")


@REG.add("mt15_metric_summary", """
WITH x AS (SELECT event_type, count(*) AS n, avg(value) AS mean FROM events GROUP BY ALL) SELECT 'n' AS metric, event_type AS run, CAST(n AS DOUBLE) AS value FROM x UNION ALL SELECT 'mean', event_type, round(mean, 6) FROM x""")
def mt15(spark: SparkSession, d: str) -> DataFrame:
    """Metrics of all runs stacked, with the identity of their run."""
    x = table(spark, d, "events", "event_type", "value").groupBy(F.col("event_type").alias("run")).agg(F.count(F.lit(1)).cast("double").alias("n"), F.round(F.avg("value"), 6).alias("mean"))
    return x.unpivot("run", ["n", "mean"], "metric", "value")


@REG.add("mt16_metric_deltas", """
WITH x AS (SELECT CASE o_orderpriority WHEN '1-URGENT' THEN 'val_loss' WHEN '2-HIGH' THEN 'test_F1' WHEN '3-MEDIUM' THEN 'MSE' WHEN '5-LOW' THEN 'auroc' ELSE 'other' END AS metric, o_orderdate < TIMESTAMP '1998-01-01' AS early, o_totalprice AS v FROM orders),
a AS (SELECT metric, round(avg(v) FILTER (WHERE early), 2) AS before, round(avg(v) FILTER (WHERE NOT early), 2) AS after FROM x GROUP BY ALL)
SELECT metric, before, after, round(after - before, 2) AS delta, CASE WHEN metric IN ('val_loss', 'MSE') THEN after < before WHEN metric IN ('test_F1', 'auroc') THEN after > before END AS improved FROM a""")
def mt16(spark: SparkSession, d: str) -> DataFrame:
    name = F.expr("CASE o_orderpriority WHEN '1-URGENT' THEN 'val_loss' WHEN '2-HIGH' THEN 'test_F1' WHEN '3-MEDIUM' THEN 'MSE' WHEN '5-LOW' THEN 'auroc' ELSE 'other' END").alias("metric")
    o = table(spark, d, "orders", "o_orderpriority", "o_orderdate", "o_totalprice").select(name, (F.col("o_orderdate") < F.lit("1998-01-01").cast("timestamp")).alias("early"), "o_totalprice")
    side = lambda c: o.where(c).groupBy("metric").agg(F.round(F.avg("o_totalprice"), 2).alias("value"))
    return _r(M.metric_deltas(side("early"), side("not early")), 2, "delta")


# --------------------------------------------------------------------- model


@REG.add("md01_attention_layer", """
WITH n AS (SELECT n_regionkey AS g, n_nationkey AS node, [CAST(n_nationkey AS DOUBLE) / 10, 1.0] AS h FROM nation),
l AS (SELECT a.g, a.node AS u, b.node AS v, a.h AS hu, b.h AS hv FROM n a JOIN n b ON a.g = b.g AND (b.node - a.node IN (0, 5))),
e AS (SELECT *, 0.5 * hv[1] + 0.1 * hv[2] + 0.3 * hu[1] AS a1, -0.2 * hv[1] + 0.4 * hv[2] + 0.1 * hu[1] + 0.2 * hu[2] AS a2, 0.3 * hu[1] AS r1, 0.1 * hu[1] + 0.2 * hu[2] AS r2 FROM l),
s AS (SELECT *, 1.0 * greatest(a1, 0.2 * a1) + -0.5 * greatest(a2, 0.2 * a2) AS z FROM e)
SELECT g, v AS node, [round(sum(exp(z) * r1) / sum(exp(z)), 6), round(sum(exp(z) * r2) / sum(exp(z)), 6)] AS vec FROM s GROUP BY g, v""")
def md01(spark: SparkSession, d: str) -> DataFrame:
    """One attention layer over the nations of a region, linked in steps of five."""
    n = table(spark, d, "nation", "n_regionkey", "n_nationkey")
    nodes = n.select(F.col("n_regionkey").alias("g"), F.col("n_nationkey").alias("node"), F.array(F.col("n_nationkey").cast("double") / 10, F.lit(1.0)).alias("vec"))
    nodes = materialize(nodes, "nodes")
    edges = nodes.select("g", F.col("node").alias("u")).join(nodes.select("g", F.col("node").alias("v")), "g").where("v - u = 5")
    out = model.attention_layer(nodes, edges, [[0.5, 0.1], [-0.2, 0.4]], [[0.3, 0.0], [0.1, 0.2]], [1.0, -0.5])
    return out.withColumn("vec", F.transform("vec", lambda x: F.round(x, 6)))


# id vector and projected value fused, one attention layer, the norm
_NODES = """
WITH f AS (SELECT n_regionkey AS g, n_nationkey AS node, n_nationkey / 10 AS e1, 0.3 * n_nationkey / 5 + 0.1 AS p FROM nation),
n AS (SELECT g, node, [0.4 * e1 + 0.1 + 0.2 * p + 0.05, -0.3 * e1 + 0.2 + 0.5 * p] AS h FROM f),
l AS (SELECT a.g, a.node AS u, b.node AS v, a.h AS hu, b.h AS hv FROM n a JOIN n b ON a.g = b.g AND (b.node - a.node = 0 OR b.node - a.node = 5 AND a.g < 4)),
e AS (SELECT *, 0.5 * hv[1] + 0.1 * hv[2] + 0.3 * hu[1] AS a1, -0.2 * hv[1] + 0.4 * hv[2] + 0.1 * hu[1] + 0.2 * hu[2] AS a2, 0.3 * hu[1] AS r1, 0.1 * hu[1] + 0.2 * hu[2] AS r2 FROM l),
s AS (SELECT *, 1.0 * greatest(a1, 0.2 * a1) + -0.5 * greatest(a2, 0.2 * a2) AS z FROM e),
y0 AS (SELECT g, v AS node, sum(exp(z) * r1) / sum(exp(z)) AS y1, sum(exp(z) * r2) / sum(exp(z)) AS y2 FROM s GROUP BY g, v),
ln AS (SELECT DISTINCT a.g FROM n a JOIN n b ON a.g = b.g AND b.node - a.node = 5 WHERE a.g < 4),
y AS (SELECT g, node, y1, y2 FROM y0 WHERE g IN (SELECT g FROM ln) UNION ALL SELECT g, node, h[1], h[2] FROM n WHERE g NOT IN (SELECT g FROM ln)),
m AS (SELECT g, node, y1, y2, (y1 + y2) / 2 AS mu FROM y), q AS (SELECT *, sqrt((pow(y1 - mu, 2) + pow(y2 - mu, 2)) / 2 + 1e-5) AS sd FROM m),
nv AS (SELECT g, node, (y1 - mu) / sd * 2 + 0.5 AS v1, (y2 - mu) / sd * 3 - 1 AS v2 FROM q)
"""


def _forward(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Node vectors and edges: the nations of a region as a graph, linked in steps
    of five in all regions but the last."""
    from plexora.operators.forward import Weights, node_vectors

    n = table(spark, d, "nation", "n_regionkey", "n_nationkey")
    nodes = materialize(n.select(F.col("n_regionkey").alias("g"), F.col("n_nationkey").alias("node"), (F.col("n_nationkey") / 5).alias("x")), "nodes")
    ids = nodes.select("node", F.array(F.col("node") / 10, F.lit(1.0)).alias("vec"))
    edges = nodes.select("g", F.col("node").alias("u")).where("g < 4").join(nodes.select("g", F.col("node").alias("v")), "g").where("v - u = 5")
    fuse = [([[0.4, -0.3], [0.1, 0.2], [0.2, 0.5]], [0.05, 0.0])]
    layer = ([[0.5, 0.1], [-0.2, 0.4]], [[0.3, 0.0], [0.1, 0.2]], [1.0, -0.5])
    return node_vectors(nodes, edges, ids, Weights(([0.3], [0.1]), fuse, [layer], [2.0, 3.0], [0.5, -1.0])), edges


@REG.add("md15_node_embeddings", _NODES + "SELECT g, node, [round(v1, 6), round(v2, 6)] AS vec FROM nv")
def md15(spark: SparkSession, d: str) -> DataFrame:
    return _forward(spark, d)[0].withColumn("vec", F.transform("vec", lambda x: F.round(x, 6)))


@REG.add("md02_graph_vectors")
def md02(spark: SparkSession, d: str) -> DataFrame:
    from plexora.operators.forward import graph_vectors

    vectors, edges = _forward(spark, d)
    return graph_vectors(materialize(vectors, "vectors"), edges)


@REG.add("md11_predictions", _NODES + """, gv AS (SELECT g, avg(v1) AS a, avg(v2) AS b FROM nv GROUP BY g)
SELECT g, [round(a, 6), round(b, 6)] AS embedding, [round(a, 6), round(b, 6), round(a + b + 1, 6)] AS recon, [round(a, 6), round(0.5 * b, 6)] AS logits, CAST(CASE WHEN a >= 0.5 * b THEN 0 ELSE 1 END AS INTEGER) AS label FROM gv""")
def md11(spark: SparkSession, d: str) -> DataFrame:
    """Graph means through a decoder over a vocabulary of three and a head of two classes."""
    from plexora.operators.forward import predictions

    graphs = materialize(model.mean_pool(_forward(spark, d)[0]).select("g", "vec"), "graphs")
    got = predictions(graphs, [([[1.0, 0.0, 1.0], [0.0, 1.0, 1.0]], [0.0, 0.0, 1.0])], [([[1.0, 0.0], [0.0, 0.5]], [0.0, 0.0])])
    return got.withColumns({c: F.transform(c, lambda x: F.round(x, 6)) for c in ("embedding", "recon", "logits")})


@REG.add("md10_extended_embeddings", """
WITH o AS (SELECT n_name AS name, n_nationkey AS idx, [n_nationkey / 10, 0.5] AS vec FROM nation WHERE n_nationkey < 20), w AS (SELECT n_name AS name, 20 + row_number() OVER (ORDER BY n_name) - 1 AS idx FROM nation WHERE n_nationkey >= 20),
b AS (SELECT name, idx, list_transform([1, 2], lambda i: round((((CAST(('0x' || substr(md5('1:' || name || ':' || i), 1, 13)) AS BIGINT) + 0.5) / 4503599627370496) * 2 - 1) * sqrt(6.0 / 27), 9)) AS vec FROM w)
SELECT name, CAST(idx AS BIGINT) AS idx, CAST(vec AS DOUBLE[]) AS vec, 'old' AS old_or_new FROM o UNION ALL SELECT name, idx, vec, 'new' FROM b""")
def md10(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation", "n_name", "n_nationkey")
    old = n.where("n_nationkey < 20").select(F.col("n_name").alias("name"), F.col("n_nationkey").cast("long").alias("idx"), F.array(F.col("n_nationkey") / 10, F.lit(0.5)).alias("vec"))
    return model.extended_embeddings(old, n.select(F.col("n_name").alias("name"))).withColumn("vec", F.transform("vec", lambda x: F.round(x, 9)))


@REG.add("mt17_titles", "WITH t(metric, value) AS (VALUES ('jsd', 0.25), ('pcc', 0.5), ('ari', 0.75), ('other', 0.1)) SELECT metric, CAST(value AS DOUBLE) AS value, CASE metric WHEN 'jsd' THEN '1 - JSD' WHEN 'pcc' THEN 'PCC' WHEN 'ari' THEN 'ARI' ELSE metric END AS title, CAST(CASE metric WHEN 'jsd' THEN 0.75 ELSE value END AS DOUBLE) AS shown FROM t")
def mt17(spark: SparkSession, d: str) -> DataFrame:
    return M.titled(spark.createDataFrame([("jsd", 0.25), ("pcc", 0.5), ("ari", 0.75), ("other", 0.1)], "metric string, value double"))


@REG.add("mt19_highly_variable", f"""
WITH {SUPPLIER_BRAND}, p AS (SELECT feat, ln(1 + avg(value)) AS mean, ln(var_samp(value) / avg(value)) AS dispersion FROM sb GROUP BY feat HAVING avg(value) > 0 AND var_samp(value) > 0),
b AS (SELECT *, greatest(ceil((mean - min(mean) OVER ()) / ((max(mean) OVER () - min(mean) OVER ()) / 20)) - 1, 0) AS b FROM p),
s AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY b) = 1 THEN 1.0 ELSE (dispersion - avg(dispersion) OVER (PARTITION BY b)) / stddev_samp(dispersion) OVER (PARTITION BY b) END AS score FROM b)
SELECT feat, round(mean, 9) AS mean, round(dispersion, 9) AS dispersion, round(score, 6) AS score FROM s ORDER BY round(s.score, 9) DESC, feat LIMIT 10""")
def mt19_variable(spark: SparkSession, d: str) -> DataFrame:
    return _r(_r(model.highly_variable(materialize(supplier_brand(spark, d), "long"), 10), 9, "mean", "dispersion"), 6, "score")


@REG.add("md04_decoder", f"WITH {EMB}, p AS (SELECT obs, sum(CASE WHEN feat % 2 = 0 THEN value ELSE 0 END) AS a, sum(CASE WHEN feat % 2 = 1 THEN value ELSE 0 END) AS b FROM emb GROUP BY obs) SELECT obs, list_transform([a, b, a + b], lambda x: round(x, 6)) AS out FROM p")
def md04(spark: SparkSession, d: str) -> DataFrame:
    """A linear decoder from every embedding to a vocabulary of three."""
    w = [[float(i % 2 == 0), float(i % 2 == 1), 1.0] for i in range(64)]
    e = table(spark, d, "embeddings", "vec_id", "embedding").toDF("obs", "vec")
    return model.dense(e, "obs", "vec", [(w, [0.0, 0.0, 0.0])]).withColumn("out", F.transform("out", lambda x: F.round(x, 6)))


@REG.add("md06_focal_loss", _SCORES + " SELECT count(*) AS n, round(avg(-pow(1 - greatest(prob, 1e-12), 2) * ln(greatest(prob, 1e-12))), 6) AS loss FROM pb WHERE cls = truth")
def md06(spark: SparkSession, d: str) -> DataFrame:
    s, t = _scores(spark, d)
    return _r(model.focal(M.softmaxed(s), t), 6, "loss")


@REG.add("md12_perturbation_sweep", f"""
WITH {SUPPLIER_BRAND}, s AS (SELECT feat, avg(value) AS m, coalesce(stddev_samp(value), 0) AS s, min(value) AS lo, max(value) AS hi FROM sb GROUP BY feat),
p AS (SELECT feat AS target, CAST(k AS INTEGER) AS step, greatest(lo, m - 2 * s) + (least(hi, m + 2 * s) - greatest(lo, m - 2 * s)) * k / 2 AS v FROM s, range(3) t(k))
SELECT target, step, count(*) AS n, round(sum(CASE WHEN sb.feat = target THEN v ELSE sb.value END), 2) AS total FROM sb h JOIN p ON h.feat = target JOIN sb ON sb.obs = h.obs GROUP BY ALL""")
def md12(spark: SparkSession, d: str) -> DataFrame:
    """Totals of the whole sweep: every sample under every planned value."""
    long = materialize(supplier_brand(spark, d), "long")
    sweep = model.perturbed(long, stats.perturbation_plan(long, 3))
    return sweep.groupBy("target", "step").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))


@REG.add("md13_class_head", "WITH o AS (SELECT n_name AS class, [CAST(n_nationkey AS DOUBLE), 1.0] AS weights FROM nation WHERE n_regionkey < 3) SELECT n.n_name AS class, coalesce(weights, [0.0, 0.0]::DOUBLE[]) AS weights, o.class IS NOT NULL AS found FROM nation n LEFT JOIN o ON o.class = n.n_name")
def md13(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation", "n_name", "n_nationkey", "n_regionkey")
    old = n.where("n_regionkey < 3").select(F.col("n_name").alias("class"), F.array(F.col("n_nationkey").cast("double"), F.lit(1.0)).alias("weights"))
    return model.class_head(old, n.select(F.col("n_name").alias("class")))


@REG.add("md17_batches", "SELECT o_orderkey, CAST((row_number() OVER (ORDER BY o_orderkey) - 1) // 32 AS BIGINT) AS batch FROM orders")
def md17(spark: SparkSession, d: str) -> DataFrame:
    return model.batches(table(spark, d, "orders", "o_orderkey"), ["o_orderkey"], 32)


@REG.add("mt19_normalized", f"WITH {SUPPLIER_BRAND}, t AS (SELECT *, ln(1 + value * 10000 / sum(value) OVER (PARTITION BY obs)) AS y FROM sb), z AS (SELECT obs, feat, (y - avg(y) OVER (PARTITION BY feat)) / stddev_samp(y) OVER (PARTITION BY feat) AS z FROM t) SELECT obs, feat, round(least(greatest(z, -10), 10), 6) AS value FROM z")
def mt19(spark: SparkSession, d: str) -> DataFrame:
    return _r(model.scaled(model.normalized_total(materialize(supplier_brand(spark, d), "long"))), 6, "value")


@REG.add("mt19_components")
def mt19_pca(spark: SparkSession, d: str) -> DataFrame:
    return model.principal_components(table(spark, d, "embeddings", "vec_id", "embedding"), "vec_id", "embedding", 8)


@REG.add("gr03_dataset_checks", f"WITH {NMIC_EDGES}, {VOCABULARY} SELECT (SELECT count(*) FROM vo) AS n_features, (SELECT count(DISTINCT name) FROM vo) AS n_names, (SELECT count(*) FROM nm) AS n_edges, (SELECT count(*) FROM nm WHERE u NOT IN (SELECT idx FROM vo) OR v NOT IN (SELECT idx FROM vo)) AS n_dangling")
def gr03(spark: SparkSession, d: str) -> DataFrame:
    """What a dataset checks before it is used: features, unique names, edges and
    edges with an unknown end."""
    v = materialize(vocabulary(spark, d), "vocabulary")
    e = nmic_edges(spark, d)
    k = small_side(v.select("idx", F.lit(1).alias("k")))
    j = e.join(k.withColumnsRenamed({"idx": "u", "k": "ku"}), "u", "left").join(k.withColumnsRenamed({"idx": "v", "k": "kv"}), "v", "left")
    a = v.agg(F.count(F.lit(1)).alias("n_features"), F.count_distinct("name").alias("n_names"))
    b = j.agg(F.count(F.lit(1)).alias("n_edges"), F.count_if(F.col("ku").isNull() | F.col("kv").isNull()).alias("n_dangling"))
    return a.join(F.broadcast(b))
