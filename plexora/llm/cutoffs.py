"""Score cutoffs that keep a target fraction of each source's records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plexora.operators.running import running
from plexora.session import materialize, small_side

#: Rank error of the first sketch, as a share of a source's rows.
RANK_ERROR = 1e-4


def label(c: str) -> Column:
    """A label read without case and outer blanks; an empty one is null."""
    x = F.lower(F.regexp_replace(F.col(c), r"^\s+|\s+$", ""))
    return F.when(x != "", x)


def usable_scores(df: DataFrame, source: str, score: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """``(*keep, source_, score_)`` of rows whose label and score are not null
    and whose score is not NaN. Repeated rows stay."""
    w = F.col(score).cast("double")
    return df.select(*keep, label(source).alias("source_"), w.alias("score_")).where(
        F.col("source_").isNotNull() & F.col("score_").isNotNull() & ~F.isnan("score_")
    )


def fractions(targets: DataFrame, source: str, fraction: str) -> DataFrame:
    """One row per label of ``targets``; of a label given twice the larger share."""
    return (
        targets.select(label(source).alias("source_"), F.col(fraction).cast("double").alias("fraction_"))
        .where(F.col("source_").isNotNull() & F.col("fraction_").isNotNull() & ~F.isnan("fraction_"))
        .groupBy("source_")
        .agg(F.max("fraction_").alias("fraction_"))
    )


def _brackets(rows: DataFrame, targets: DataFrame, rank_error: float) -> DataFrame:
    """Per source a score interval that surely holds its cutoff.

    ``rows`` has ``source_, score_``; ``targets`` has ``source_`` and
    ``above_``: how many of these rows may lie at or above the cutoff, as a
    share. The sketch is Spark's mergeable Greenwald-Khanna summary, built on
    the map side, with an error of ``rank_error`` ranks a row; two such errors
    on either side of the target rank bound the interval.
    """
    grid = max(100, round(1 / rank_error))
    steps = 200  # summaries are asked for a fixed grid and for the tails around the target
    sketch = rows.groupBy("source_").agg(
        F.count(F.lit(1)).alias("n_"),
        F.min("score_").alias("min_"),
        F.max("score_").alias("max_"),
        F.percentile_approx("score_", F.lit([i / steps for i in range(steps + 1)]), F.lit(grid)).alias("q_"),
    )
    p = (1 - F.col("above_")) * steps
    pad = 2 * rank_error * steps + 1e-9
    i = F.greatest(F.floor(p - pad), F.lit(0)).cast("int")
    j = F.least(F.ceil(p + pad), F.lit(steps)).cast("int")
    return sketch.join(small_side(targets), "source_").select(
        "source_",
        "n_",
        "above_",
        # the outermost steps are the exact extremes; percentile_approx may miss them
        F.when(i <= 0, F.col("min_")).otherwise(F.get("q_", i)).alias("lo_"),
        F.when(j >= steps, F.col("max_")).otherwise(F.get("q_", j)).alias("hi_"),
    )


def cutoffs(df: DataFrame, targets: DataFrame, source: str, score: str, t_source: str, t_fraction: str, rank_error: float = RANK_ERROR) -> DataFrame:
    """``(source_, fraction_, n_usable, cutoff, n_kept, n_tied)`` per target source.

    The cutoff is the lowest occurring score for which the rows with it or a
    higher one are at most ``fraction * n_usable``; null (and nothing kept)
    where even the highest score has more rows, or the source has no usable
    row. ``n_tied`` counts the rows at the cutoff itself.

    Passes: (1) a mergeable rank-bounded quantile sketch per source brackets
    the cutoff within about a hundredth of its rows; (2) a second sketch over the
    rows inside the bracket narrows that to about a ten-thousandth; (3) one exact
    pass counts the rows above the bracket and, value by value, those inside it;
    (4) a last one counts the rows kept and tied. All aggregate on the map side,
    so a source with a third of all rows costs its reducer one state a map task;
    the running count in step 3 sees each distinct score of the narrow bracket
    once and is spread over range partitions.
    """
    goals = fractions(targets, t_source, t_fraction)
    rows = usable_scores(df, source, score).select("source_", "score_")

    first = materialize(_brackets(rows, goals.withColumn("above_", F.least(F.greatest("fraction_", F.lit(0.0)), F.lit(1.0))), rank_error), "bracket1")
    inside = rows.join(small_side(first), "source_")
    # where the target lies among the rows of the first bracket
    tallied = inside.groupBy("source_").agg(
        F.count_if(F.col("score_") > F.col("hi_")).alias("over_"),
        F.count_if(F.col("score_").between(F.col("lo_"), F.col("hi_"))).alias("in_"),
        F.first("n_").alias("n_"),
        F.first("above_").alias("share_"),
    )
    second_goal = tallied.where("in_ > 0").select(
        "source_",
        F.least(F.greatest((F.col("share_") * F.col("n_") - F.col("over_")) / F.col("in_"), F.lit(0.0)), F.lit(1.0)).alias("above_"),
    )
    narrow = inside.where(F.col("score_").between(F.col("lo_"), F.col("hi_"))).select("source_", "score_")
    second = materialize(
        _brackets(narrow, materialize(second_goal, "goal2"), rank_error).select("source_", F.col("lo_").alias("lo"), F.col("hi_").alias("hi")), "bracket2"
    )

    bounds = small_side(second)
    exact = (
        rows.join(bounds, "source_")
        .where(F.col("score_") >= F.col("lo"))
        # all rows above the bracket share one bin; a tie that fills the whole
        # bracket leaves the lowest score of that bin as the cutoff
        .select("source_", "score_", F.when(F.col("score_") <= F.col("hi"), F.col("score_")).alias("v_"))
        .groupBy("source_", "v_")
        .agg(F.count(F.lit(1)).alias("k_"), F.min("score_").alias("low_"))
    )
    totals = first.select("source_", F.col("n_").alias("n_usable"))
    chosen = materialize(
        # in falling order of the scores; the bin above the bracket comes first
        running(exact.select("source_", "low_", "k_"), ["source_"], [F.desc("low_")], {"cum_": (F.sum, "k_")}, inclusive=True)
        .join(small_side(goals.join(totals, "source_")), "source_")
        .where(F.col("cum_") <= F.col("fraction_") * F.col("n_usable"))
        .groupBy("source_")
        .agg(F.min("low_").alias("cutoff")),
        "cutoffs",
    )
    counted = (
        rows.join(small_side(chosen), "source_")
        .where(F.col("score_") >= F.col("cutoff"))
        .groupBy("source_")
        .agg(F.count(F.lit(1)).alias("n_kept"), F.count_if(F.col("score_") == F.col("cutoff")).alias("n_tied"))
    )
    return (
        goals.join(totals, "source_", "left")
        .join(chosen, "source_", "left")
        .join(counted, "source_", "left")
        .select("source_", "fraction_", *(F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_usable", "n_kept", "n_tied")), "cutoff")
    )


def kept_rows(df: DataFrame, cuts: DataFrame, source: str, score: str, key: str) -> DataFrame:
    """``key`` of the rows at or above their source's cutoff (another pass)."""
    rows = usable_scores(df, source, score, (key,))
    at = small_side(cuts.where(F.col("cutoff").isNotNull()).select("source_", "cutoff"))
    return rows.join(at, "source_").where(F.col("score_") >= F.col("cutoff")).select(key)
