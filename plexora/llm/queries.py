"""Queries of the training-data problems and the SQL they are checked against."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plexora.llm import cutoffs, encoding, encoding_sql, mixing, neighbors, overlap, packing, splits, topn
from plexora.plans.registry import Registry
from plexora.session import materialize, table

REG = Registry()

# ---------------------------------------------------------------- problem 2

_USABLE = """
WITH r AS (
  SELECT edge_id, lower(trim(edge_source, ' \t\n\r')) AS s, CAST(edge_weight AS DOUBLE) AS w FROM edge_source
  WHERE edge_source IS NOT NULL AND edge_weight IS NOT NULL AND NOT isnan(edge_weight)),
n AS (SELECT s, count(*) AS n FROM r GROUP BY s),
v AS (SELECT s, w, sum(count(*)) OVER (PARTITION BY s ORDER BY w DESC) AS c, count(*) AS k FROM r GROUP BY s, w),
c AS (
  SELECT t.edge_source AS s, t.keep_fraction AS f, coalesce(any_value(n.n), 0) AS n_usable, min(v.w) AS cutoff,
         CAST(coalesce(max(v.c), 0) AS BIGINT) AS n_kept, coalesce(arg_min(v.k, v.w), 0) AS n_tied
  FROM source_target t LEFT JOIN n ON n.s = t.edge_source
  LEFT JOIN v ON v.s = t.edge_source AND v.c <= t.keep_fraction * n.n GROUP BY ALL)
"""


def _cuts(spark: SparkSession, d: str) -> DataFrame:
    edges = table(spark, d, "edge_source", "edge_source", "edge_weight")
    return cutoffs.cutoffs(edges, table(spark, d, "source_target"), "edge_source", "edge_weight", "edge_source", "keep_fraction")


@REG.add("p2_cutoffs", _USABLE + "SELECT s AS edge_source, f AS keep_fraction, n_usable, cutoff, n_kept, n_tied FROM c")
def p2_cutoffs(spark: SparkSession, d: str) -> DataFrame:
    return _cuts(spark, d).withColumnsRenamed({"source_": "edge_source", "fraction_": "keep_fraction"})


@REG.add("p2_found", _USABLE + "SELECT DISTINCT r.edge_id FROM r JOIN c ON r.s = c.s AND r.w >= c.cutoff")
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    edges = table(spark, d, "edge_source", "edge_id", "edge_source", "edge_weight")
    return cutoffs.kept_rows(edges, _cuts(spark, d), "edge_source", "edge_weight", "edge_id")


# ---------------------------------------------------------------- problem 3

_TIED = r"""
WITH RECURSIVE r AS (
  SELECT obs_id, tissue, regexp_replace(lower(batch), '[^a-z0-9]', '', 'g') AS b0,
         CASE WHEN contains(obs_names, '_') THEN regexp_replace(lower(regexp_extract(obs_names, '([^_]*)$')), '[^a-z0-9]', '', 'g') END AS l0
  FROM expression),
q AS (SELECT obs_id, CASE WHEN b0 NOT IN ('', 'na', 'unknown') THEN b0 END AS b, CASE WHEN l0 NOT IN ('', 'na', 'unknown') THEN l0 END AS l FROM r),
e AS (SELECT DISTINCT 'b' || b AS x, 'l' || l AS y FROM q WHERE b IS NOT NULL AND l IS NOT NULL),
ee AS (SELECT x, y FROM e UNION ALL SELECT y, x FROM e),
w(node, root) AS (
  SELECT DISTINCT x, x FROM ee WHERE x LIKE 'b%'
  UNION
  SELECT ee.y, w.root FROM w JOIN ee ON ee.x = w.node),
m AS (SELECT node, min(root) AS root FROM w GROUP BY node),
g AS (SELECT obs_id, coalesce(m.root, CASE WHEN b IS NOT NULL THEN 'b' || b WHEN l IS NOT NULL THEN 'l' || l ELSE 'o' || obs_id END) AS grp
      FROM q LEFT JOIN m ON m.node = CASE WHEN b IS NOT NULL THEN 'b' || b ELSE 'l' || l END),
s AS (SELECT grp FROM g GROUP BY grp HAVING count(*) >= 2)
"""
_EXPR = ("obs_id", "batch", "obs_names", "tissue")


def _assigned(spark: SparkSession, d: str) -> DataFrame:
    return splits.assign_splits(table(spark, d, "expression", *_EXPR), table(spark, d, "split_target"), *_EXPR, "split", "proportion")


@REG.add("p3_found", _TIED + "SELECT obs_id, substr(grp, 2) AS group_batch FROM g JOIN s USING (grp) WHERE grp LIKE 'b%'")
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return splits.found_groups(_assigned(spark, d), "obs_id")


@REG.add("p3_assign")
def p3_assign(spark: SparkSession, d: str) -> DataFrame:
    return _assigned(spark, d).select("obs_id", "split")


@REG.add("p3_report")
def p3_report(spark: SparkSession, d: str) -> DataFrame:
    """Rows and share of every split, in all and per tissue."""
    per = _assigned(spark, d).rollup("split", "label_").agg(F.count(F.lit(1)).alias("n_rows")).where("split is not null")
    target = table(spark, d, "split_target")
    every = per.where("label_ is null").agg(F.sum("n_rows").alias("n")).scalar()
    return per.join(F.broadcast(target), "split").select(
        "split", F.col("label_").alias("tissue"), "n_rows", "proportion", (F.col("n_rows") / F.when(F.col("label_").isNull(), every)).alias("share")
    )


@REG.add(
    "p3_checks",
    _TIED + """, z AS (SELECT max(n) AS top FROM (SELECT count(*) AS n FROM g GROUP BY grp))
SELECT p.split, (SELECT count(*) FROM g) AS n_rows, (SELECT count(DISTINCT grp) FROM g) AS n_groups, CAST(0 AS BIGINT) AS n_parted, TRUE AS near_target FROM split_target p""",
)
def p3_checks(spark: SparkSession, d: str) -> DataFrame:
    """What an assignment must fulfil: every row and group assigned, no group in
    two splits, and every split within 1 % of all rows, or the largest group, of
    its proportion."""
    rows = materialize(_assigned(spark, d).select("group_", "split"), "assigned")
    per = materialize(rows.groupBy("group_").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("split").alias("k")), "groups")
    head = per.agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_groups"), F.count_if(F.col("k") != 1).alias("n_parted"), F.max("n").alias("top_"))
    share = rows.groupBy("split").agg(F.count(F.lit(1)).alias("have_"))
    out = table(spark, d, "split_target").join(share, "split", "left").join(F.broadcast(head))
    near = F.abs(F.coalesce("have_", F.lit(0)) - F.col("proportion") * F.col("n_rows")) <= F.greatest(F.col("n_rows") * 0.01, F.col("top_"))
    return out.select("split", "n_rows", "n_groups", "n_parted", near.alias("near_target"))


# ---------------------------------------------------------------- problem 4

_COSINE = """
WITH x AS (
  SELECT emb_id, node_gene_ids, CAST(node_embeddings AS DOUBLE[]) AS v FROM node_embeddings
  WHERE node_embeddings IS NOT NULL AND len(node_embeddings) = 64
    AND len(list_filter(node_embeddings, lambda y: y IS NULL OR isnan(y) OR isinf(y))) = 0
    AND len(list_filter(node_embeddings, lambda y: y <> 0)) > 0),
p AS (SELECT a.emb_id AS i, b.emb_id AS j, b.node_gene_ids AS g, round(list_cosine_similarity(a.v, b.v), 12) AS sim
      FROM x a JOIN x b ON a.emb_id <> b.emb_id {where}),
r AS (SELECT *, row_number() OVER (PARTITION BY i ORDER BY sim DESC, j) AS rk FROM p),
t AS (SELECT * FROM r WHERE rk <= 10)
"""


def _nodes(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "node_embeddings", "emb_id", "node_gene_ids", "node_embeddings")


@REG.add("p4_found", _COSINE.format(where="") + "SELECT DISTINCT least(i, j) AS emb_id_a, greatest(i, j) AS emb_id_b FROM t WHERE sim >= 0.9")
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    near = neighbors.similar(_nodes(spark, d), "emb_id", "node_embeddings")
    return neighbors.similar_pairs(near).select(F.col("a").alias("emb_id_a"), F.col("b").alias("emb_id_b"))


@REG.add(
    "p4_similar",
    _COSINE.format(where="AND a.emb_id % 20 = 0") + "SELECT i AS emb_id, CAST(rk AS INTEGER) AS rank, j AS neighbour, g AS neighbour_gene, round(sim, 6) AS cosine FROM t",
)
def p4_similar(spark: SparkSession, d: str) -> DataFrame:
    """Every row whose id is divisible by 20 asks; all rows answer."""
    nodes = _nodes(spark, d)
    near = neighbors.similar(nodes, "emb_id", "node_embeddings", queries="id_ % 20 = 0")
    genes = nodes.select(F.col("emb_id").alias("nbr_"), F.col("node_gene_ids").alias("neighbour_gene"))
    return near.join(genes, "nbr_").select(
        F.col("id_").alias("emb_id"), F.col("rank_").alias("rank"), F.col("nbr_").alias("neighbour"), "neighbour_gene", F.round("sim_", 6).alias("cosine")
    )


# ---------------------------------------------------------------- problem 5

_NAMES = """
WITH r AS (
  SELECT obs_id, regexp_replace(lower(obs_names), '[^a-z0-9]', '', 'g') AS x, lower(trim(split, ' \t\n\r')) AS s, lower(trim(tissue, ' \t\n\r')) AS g
  FROM expression WHERE obs_names IS NOT NULL AND split IS NOT NULL),
q AS (SELECT * FROM r WHERE x NOT IN ('', 'na', 'unknown')),
t AS (SELECT * FROM q WHERE s = 'trn'),
e AS (SELECT * FROM q WHERE s IN ('val', 'tst')),
m AS (SELECT DISTINCT a.x AS a, b.x AS b FROM (SELECT DISTINCT x FROM t) a JOIN (SELECT DISTINCT x FROM e) b
      ON abs(length(a.x) - length(b.x)) <= 2 AND levenshtein(a.x, b.x) <= 2),
p AS (SELECT t.obs_id AS i, e.obs_id AS j, e.s, e.g, t.x = e.x AS same FROM m JOIN t ON t.x = m.a JOIN e ON e.x = m.b)
"""
_OBS = ("obs_id", "obs_names", "split", "tissue")


def _overlaps(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return overlap.overlaps(overlap.canonical_rows(table(spark, d, "expression", *_OBS), *_OBS), "trn", ("val", "tst"))


@REG.add("p5_found", _NAMES + "SELECT DISTINCT least(i, j) AS obs_id_a, greatest(i, j) AS obs_id_b FROM p WHERE i <> j")
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return overlap.overlap_pairs(*_overlaps(spark, d)).select(F.col("a").alias("obs_id_a"), F.col("b").alias("obs_id_b"))


@REG.add(
    "p5_counts",
    _NAMES + "SELECT s AS split, g AS tissue, count(DISTINCT j) AS n_rows, count(DISTINCT j) FILTER (WHERE same) AS n_exact, count(*) AS n_pairs FROM p GROUP BY ALL",
)
def p5_counts(spark: SparkSession, d: str) -> DataFrame:
    return overlap.overlap_counts(*_overlaps(spark, d)).withColumnsRenamed({"split_": "split", "group_": "tissue"})


# ---------------------------------------------------------------- problem 6

_TOP = """
WITH p AS (
  SELECT npz_id, least(u, v) AS a, greatest(u, v) AS b, max(w) AS w FROM bulk_nmic
  WHERE npz_id IS NOT NULL AND u >= 0 AND v >= 0 AND u <> v AND w IS NOT NULL AND NOT isnan(w) GROUP BY ALL),
s AS (SELECT npz_id, a AS feature, b AS partner, w FROM p UNION ALL SELECT npz_id, b, a, w FROM p),
t AS (SELECT *, row_number() OVER (PARTITION BY npz_id, feature ORDER BY w DESC, partner) AS rk FROM s QUALIFY rk <= 3)
"""


def _top(spark: SparkSession, d: str) -> DataFrame:
    return topn.top_items(table(spark, d, "bulk_nmic", "npz_id", "u", "v", "w"), "npz_id", "u", "v", "w", 3)


@REG.add("p6_top", _TOP + "SELECT npz_id, feature, partner, w, CAST(rk AS INTEGER) AS rank FROM t")
def p6_top(spark: SparkSession, d: str) -> DataFrame:
    return _top(spark, d).withColumnsRenamed({"run_": "npz_id", "item_": "feature", "other_": "partner", "w_": "w", "rank_": "rank"})


@REG.add("p6_found", _TOP + "SELECT DISTINCT npz_id, least(feature, partner) AS u, greatest(feature, partner) AS v FROM t")
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return topn.kept_pairs(_top(spark, d)).withColumnsRenamed({"run_": "npz_id", "a_": "u", "b_": "v"})


# ---------------------------------------------------------------- problem 7


@REG.add("p7_found", "SELECT DISTINCT doc_id FROM documents WHERE strlen(text) > 4096")
def p7_found(spark: SparkSession, d: str) -> DataFrame:
    packed = packing.pack(table(spark, d, "documents", "doc_id", "text"), "doc_id", "text")
    return packed.where("piece_ = 1").select(F.col("id_").alias("doc_id")).distinct()


@REG.add("p7_packed")
def p7_packed(spark: SparkSession, d: str) -> DataFrame:
    packed = packing.pack(table(spark, d, "documents", "doc_id", "text"), "doc_id", "text")
    return packed.withColumnsRenamed({"id_": "doc_id", "piece_": "piece", "start_": "start_token", "size_": "n_tokens", "box_": "container"})


@REG.add("p7_report")
def p7_report(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_report(packing.pack(table(spark, d, "documents", "doc_id", "text"), "doc_id", "text"))


@REG.add(
    "p7_checks",
    """SELECT doc_id, CAST(strlen(text) AS BIGINT) AS n_tokens, CAST(ceil(strlen(text) / 4096) AS BIGINT) AS n_pieces, TRUE AS gapless, TRUE AS fits FROM documents WHERE strlen(text) > 0""",
)
def p7_checks(spark: SparkSession, d: str) -> DataFrame:
    """Per document what a packing must fulfil: all of its tokens once and without
    gaps, no more pieces than needed, and no container of it overfull."""
    packed = materialize(packing.pack(table(spark, d, "documents", "doc_id", "text"), "doc_id", "text"), "packed")
    full = packed.groupBy("box_").agg((F.sum("size_") <= 4096).alias("fits_"))
    per = packed.join(full, "box_").groupBy(F.col("id_").alias("doc_id")).agg(
        F.sum("size_").alias("n_tokens"),
        F.count(F.lit(1)).alias("n_pieces"),
        ((F.max(F.col("start_") + F.col("size_")) == F.sum("size_")) & (F.min("start_") == 0) & (F.count_distinct("start_") == F.count(F.lit(1)))).alias("gapless"),
        F.min("fits_").alias("fits"),
    )
    return per


# ---------------------------------------------------------------- problem 8

_SOURCES = """
WITH x AS (SELECT lower(trim(source, ' \t\n\r')) AS s, coalesce(strlen(text), 0) AS n FROM documents),
p AS (
  SELECT t.source, t.target_share, t.max_repeats, CAST(coalesce(sum(x.n), 0) AS BIGINT) AS tokens, count(x.s) AS n_docs
  FROM mix_target t LEFT JOIN x ON x.s = t.source GROUP BY ALL)
"""


def _mix(spark: SparkSession, d: str, whole: bool, tempering: bool = True) -> tuple[DataFrame, list[mixing.Source]]:
    """Sizes and plan; of a mix as large as the corpus if ``whole``."""
    sizes = materialize(mixing.document_sizes(table(spark, d, "documents", "doc_id", "text", "source"), "doc_id", "text", "source"), "sizes")
    total = sizes.agg(F.sum("n_")).first()[0] if whole else None
    plan, _, _ = mixing.mix_plan(sizes, table(spark, d, "mix_target"), "source", "target_share", "max_repeats", total, tempering=tempering)
    return sizes, plan


@REG.add(
    "p8_found",
    _SOURCES + "SELECT source FROM p WHERE target_share * (SELECT sum(n) FROM x) > max_repeats * tokens",
)
def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Sources of which the mix uses every document as often as allowed and that
    stay below their share nevertheless."""
    sizes, plan = _mix(spark, d, whole=True, tempering=False)
    report = mixing.mix_report(mixing.mix(sizes, plan), plan)
    total = sizes.agg(F.coalesce(F.sum("n_"), F.lit(0))).first()[0]
    spent = F.col("mix_tokens") >= F.col("max_repeats") * F.col("tokens")
    return report.where(spent & (F.col("mix_tokens") < F.col("target_share") * F.lit(total))).select("source")


@REG.add(
    "p8_sources",
    _SOURCES + "SELECT source, target_share, max_repeats, tokens, n_docs, NOT target_share * (SELECT sum(n) FROM x) > max_repeats * tokens AS fillable FROM p",
)
def p8_sources(spark: SparkSession, d: str) -> DataFrame:
    sizes, plan = _mix(spark, d, whole=True)
    return mixing.mix_report(mixing.mix(sizes, plan), plan).select("source", "target_share", "max_repeats", "tokens", "n_docs", "fillable")


@REG.add("p8_mix")
def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    """The largest mix in which every source with tokens has its target share."""
    sizes, plan = _mix(spark, d, whole=False)
    return mixing.mix(sizes, plan).withColumnsRenamed({"id_": "doc_id", "source_": "source", "n_": "n_tokens", "uses_": "n_uses"})


@REG.add("p8_report")
def p8_report(spark: SparkSession, d: str) -> DataFrame:
    sizes, plan = _mix(spark, d, whole=False)
    return mixing.mix_report(mixing.mix(sizes, plan), plan)


@REG.add("p8_checks", _SOURCES + "SELECT source, TRUE AS within_repeats, TRUE AS near_share, TRUE AS even FROM p WHERE tokens > 0 AND target_share > 0")
def p8_checks(spark: SparkSession, d: str) -> DataFrame:
    """Per source with tokens what a mix must fulfil: no document used too often,
    its share of the mix within one document of the target, and uses that differ
    by one at most."""
    sizes, plan = _mix(spark, d, whole=False)
    mixed = materialize(mixing.mix(sizes, plan), "mix")
    present = [p for p in plan if p.tokens and p.target > 0]
    scale = sum(p.target for p in present) or 1.0
    goal = spark.createDataFrame([(p.name, p.target / scale, p.repeats, p.docs) for p in present], "source string, goal_ double, cap_ int, docs_ long")
    used = mixed.groupBy(F.col("source_").alias("source")).agg(F.sum(F.col("n_") * F.col("uses_")).alias("t_"), F.max("uses_").alias("hi_"), F.min("uses_").alias("lo_"), F.count(F.lit(1)).alias("c_"), F.max("n_").alias("top_"))
    some = sizes.where("n_ > 0").groupBy(F.col("source_").alias("source")).agg(F.count(F.lit(1)).alias("full_"))
    every = mixed.agg(F.sum(F.col("n_") * F.col("uses_")).alias("all_"), F.max("n_").alias("longest_"))
    low = F.when(F.col("c_") < F.col("full_"), 0).otherwise(F.col("lo_"))
    return goal.join(used, "source", "left").join(some, "source").join(F.broadcast(every)).select(
        "source",
        (F.coalesce("hi_", F.lit(0)) <= F.col("cap_")).alias("within_repeats"),
        # every source may end one document early or late
        (F.abs(F.coalesce("t_", F.lit(0)) - F.col("goal_") * F.col("all_")) <= F.col("longest_") * (1 + len(present))).alias("near_share"),
        (F.coalesce("hi_", F.lit(0)) - F.coalesce(low, F.lit(0)) <= 1).alias("even"),
    )


@REG.add("p8_tempered_report")
def p8_tempered_report(spark: SparkSession, d: str) -> DataFrame:
    """A mix as large as the corpus, tempered towards the targets as far as the repeats allow."""
    sizes, plan = _mix(spark, d, whole=True)
    return mixing.mix_report(mixing.mix(sizes, plan), plan)


# ---------------------------------------------------------------- problem 9


@REG.add("p9_found", encoding_sql.FOUND)
def p9_found(spark: SparkSession, d: str) -> DataFrame:
    evidence, _ = encoding.garbled_words(table(spark, d, "documents", "doc_id", "text"), "doc_id", "text")
    return evidence.select(F.col("id_").alias("doc_id")).distinct()


@REG.add("p9_restored")
def p9_restored(spark: SparkSession, d: str) -> DataFrame:
    out = encoding.restored(table(spark, d, "documents", "doc_id", "text"), "doc_id", "text")
    return out.withColumnsRenamed({"id_": "doc_id", "text_": "text"})


@REG.add("p9_words")
def p9_words(spark: SparkSession, d: str) -> DataFrame:
    """Distinct garbled words with their originals and the chains of encodings."""
    return encoding.garbled_words(table(spark, d, "documents", "doc_id", "text"), "doc_id", "text")[1]
