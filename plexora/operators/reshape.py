"""Wide and long matrices, one-hot labels, name handling, set operations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Columns of a wide table that describe an observation and are no features.
# Fixed values.
METADATA = ("batch", "sample", "donor", "condition", "tissue", "n_genes", "n_counts", "pct_counts_mt")
OBS_NAMES = ("obs_names", "obs_name", "barcode", "cell_id", "index")
CLASS_NAMES = ("celltype", "cell_type", "label", "annotation")
BATCH_NAMES = ("batch", "orig.ident", "Orig.ident")
#: Columns that a table may get, and features of a vocabulary that is broadcast as one row.
MAX_COLUMNS, MAX_VOCABULARY = 10_000, 1_000_000


def numeric_columns(df: DataFrame, exclude: Sequence[str] = (*OBS_NAMES, *METADATA)) -> list[str]:
    """Names of numeric columns, without the excluded ones (case ignored)."""
    no = {c.lower() for c in exclude}
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType) and f.name.lower() not in no]


def observation_column(df: DataFrame) -> str:
    """The observation column: the first of the known names, else the first text
    column, else the first column."""
    for c in OBS_NAMES:
        if c in df.columns:
            return c
    texts = [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]
    return (texts or df.columns)[0]


def quoted(c: str) -> str:
    return "`" + c.replace("`", "``") + "`"


def to_long(df: DataFrame, obs: str | None = None, features: Sequence[str] | None = None) -> DataFrame:
    """``(obs, feat, value)`` of a wide table; features are its numeric columns."""
    obs = obs or observation_column(df)
    features = list(features) if features is not None else [c for c in numeric_columns(df) if c != obs]
    wide = df.select(F.col(quoted(obs)).alias("obs"), *(F.col(quoted(c)).cast("double").alias(c) for c in features))
    return wide.unpivot("obs", [F.col(quoted(c)) for c in features], "feat", "value")


def to_wide(long: DataFrame, features: Sequence[str]) -> DataFrame:
    """One row per observation with ``features`` as columns in that order; null
    where an observation has no value, the last value where it has several."""
    return long.groupBy("obs").pivot("feat", list(features)).agg(F.max("value"))


def aligned(long: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """``(obs, feat, value)`` with every vocabulary feature for every observation,
    0 where the matrix lacks it; other features are dropped. The grid is the
    result asked for: observations times vocabulary. A vocabulary of more than
    :data:`MAX_VOCABULARY` features, which each row carries, is an error."""
    if vocabulary.limit(MAX_VOCABULARY + 1).count() > MAX_VOCABULARY:
        raise ValueError(f"more than {MAX_VOCABULARY} features")
    have = long.join(vocabulary.select("feat"), "feat", "left_semi").select("obs", "feat", "value")
    obs = long.select("obs").distinct()
    names = vocabulary.agg(F.array_sort(F.collect_set("feat")).alias("f_"))
    grid = obs.join(F.broadcast(names)).select("obs", F.explode("f_").alias("feat"))
    return grid.join(have, ["obs", "feat"], "left").select("obs", "feat", F.coalesce("value", F.lit(0.0)).alias("value"))


def coverage(long: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """One row: common, missing and extra features and the common share."""
    have, want = long.select("feat").distinct(), vocabulary.select("feat").distinct()
    both = have.withColumn("h", F.lit(1)).join(want.withColumn("w", F.lit(1)), "feat", "full")
    return both.agg(
        F.count_if(F.col("h").isNotNull() & F.col("w").isNotNull()).alias("n_common"),
        F.count_if(F.col("h").isNull()).alias("n_missing"),
        F.count_if(F.col("w").isNull()).alias("n_extra"),
    ).withColumn("coverage", F.when(F.col("n_common") + F.col("n_missing") > 0, F.col("n_common") / (F.col("n_common") + F.col("n_missing"))))


def require_coverage(long: DataFrame, vocabulary: DataFrame, least: float = 0.80) -> float:
    """The common share of the vocabulary; an error below ``least``."""
    share = coverage(long, vocabulary).first()["coverage"] or 0.0
    if share < least:
        raise ValueError(f"only {share:.3f} of the vocabulary is present, {least} is needed")
    return share


def one_hot(labels: DataFrame, obs: str, label: str, classes: Sequence[str] | None = None, unknown: bool = True) -> DataFrame:
    """``(obs, ct_<class>...)`` of 0 and 1 in order of the class, ``ct_unknown``
    of zeros last if asked for; one row per observation. More than
    :data:`MAX_COLUMNS` classes are an error: columns are part of a plan."""
    if classes is None:
        classes = [r[0] for r in labels.where(F.col(label).isNotNull()).select(label).distinct().orderBy(label).limit(MAX_COLUMNS + 1).collect()]
        if len(classes) > MAX_COLUMNS:
            raise ValueError(f"more than {MAX_COLUMNS} classes")
    wide = labels.groupBy(F.col(obs).alias("obs")).agg(*(F.max(F.coalesce((F.col(label) == c).cast("byte"), F.lit(0).cast("byte"))).alias(f"ct_{c}") for c in classes))
    return wide.withColumn("ct_unknown", F.lit(0).cast("byte")) if unknown else wide


def from_one_hot(onehot: DataFrame, obs: str = "obs", prefix: str = "ct_") -> DataFrame:
    """``(obs, label)`` of the columns that are 1, without the prefix."""
    cols = [c for c in onehot.columns if c.startswith(prefix)]
    rows = onehot.unpivot(obs, [F.col(quoted(c)) for c in cols], "label", "on_").where("on_ = 1")
    return rows.select(F.col(obs).alias("obs"), F.replace("label", F.lit(prefix), F.lit("")).alias("label"))


def sample_features(long: DataFrame, k: int, seed: int) -> DataFrame:
    """The rows of ``k`` features drawn without replacement, by the order of
    ``md5(seed:feature)``; all of them where there are fewer."""
    from plexora.operators.sampling import hash_order

    names = long.select("feat").distinct().orderBy(hash_order("feat", seed), "feat").limit(k)
    return long.join(F.broadcast(names) if k <= 10_000 else names, "feat", "left_semi")


def densified(sparse: DataFrame, features: DataFrame) -> DataFrame:
    """``(obs, feat, value)`` of sparse rows ``(obs, indices, values)``: the stored
    cells with the names ``(idx, feat)``, zeros elsewhere."""
    cells = sparse.select("obs", F.explode(F.arrays_zip("indices", "values")).alias("c")).select("obs", F.col("c.indices").alias("idx"), F.col("c.values").cast("double").alias("value"))
    return aligned(cells.join(features, "idx").select("obs", "feat", "value"), features)


def unique_names(df: DataFrame, name: str, order: str, out: str = "unique_name") -> DataFrame:
    """Repeated names made unique by ``_1``, ``_2``... in order of ``order``; the
    first keeps its name."""
    from plexora.operators.running import running

    keyed = df.withColumn("k_", F.struct(name)).withColumn("one_", F.lit(1).cast("long"))  # as a struct, a null name is a key
    n = running(keyed, ["k_"], [order], {"n_": (F.sum, "one_")}).select(*df.columns, "n_")
    return n.withColumn(out, F.when(F.col("n_") == 0, F.col(name)).otherwise(F.concat(F.col(name), F.lit("_"), F.col("n_").cast("string")))).drop("n_")


def first_seen(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key, the first by ``order``."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(order))
    return df.withColumn("n_", n).where("n_ = 1").drop("n_")


def numbered(df: DataFrame, order: Sequence[str], out: str = "row") -> DataFrame:
    """Row numbers from 0 in a total order, spread over range partitions."""
    from plexora.operators.running import running

    return running(df.withColumn("one_", F.lit(1).cast("long")), [], order, {out: (F.sum, "one_")}).drop("one_")


def from_columns(spark: SparkSession, columns: dict[str, Sequence], schema: str | None = None) -> DataFrame:
    """A table of columns given as lists; lists of other lengths are an error."""
    if len({len(v) for v in columns.values()}) > 1:
        raise ValueError("columns of other lengths")
    return spark.createDataFrame(list(zip(*columns.values())), schema or list(columns))


def stacked(dfs: Sequence[DataFrame], diagonal: bool = False) -> DataFrame:
    """Rows of several tables by column name; with ``diagonal`` the union of their
    columns, null where a table lacks one."""
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d, allowMissingColumns=diagonal)
    return out


def name_sets(a: DataFrame, b: DataFrame, column: str) -> dict[str, DataFrame]:
    """Distinct names in both, only in the first and only in the second."""
    x, y = a.select(column), b.select(column)
    return {"common": x.intersect(y), "missing": x.subtract(y), "extra": y.subtract(x)}


def flattened(df: DataFrame, struct: str, prefix: str) -> DataFrame:
    """The fields of a struct as columns with a prefix."""
    fields = df.schema[struct].dataType.names
    return df.select(*[c for c in df.columns if c != struct], *(F.col(f"{struct}.{f}").alias(f"{prefix}{f}") for f in fields))
