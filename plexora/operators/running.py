"""Running totals and maxima in a total order, spread over range partitions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plexora.session import materialize


#: Rows of a group that one task may go through in order.
LOCAL_ROWS = 2_000_000


def largest(per: DataFrame, n: str = "n") -> int:
    """The size of the largest group of a table of counts."""
    return per.agg(F.max(n)).first()[0] or 0


def _combined(fn: Callable, a: Column, b: Column) -> Column:
    if fn is F.sum:
        return F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))
    return F.greatest(a, b) if fn is F.max else F.least(a, b)


def ordered(df: DataFrame, by: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """``df`` sorted by range of ``by`` and ``order`` and written, with ``p_`` and
    ``q_``, the partition and place of every row. Rows whose group has a null
    are dropped."""
    keys = [*by, *order]
    rows = df.dropna(subset=list(by)) if by else df
    tagged = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("p_", F.spark_partition_id()).withColumn("q_", F.monotonically_increasing_id())
    return materialize(tagged, "ordered")


def carried(tagged: DataFrame, by: Sequence[str], values: dict[str, tuple[Callable, str]], inclusive: bool = False) -> DataFrame:
    """:func:`running` over a table with marks ``p_`` (ordered parts of a group)
    and ``q_`` (the order within a part), which stay. The carry joins on the
    keys by which the windows have parted the rows already."""
    cols = tagged.columns
    local = Window.partitionBy(*by, "p_").orderBy("q_").rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    across = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))
    across = across.orderBy("p_").rowsBetween(Window.unboundedPreceding, -1)
    part = tagged.groupBy(*by, "p_").agg(*(fn(c).alias(f"{o}__") for o, (fn, c) in values.items()))
    base = part.select(*by, "p_", *(fn(f"{o}__").over(across).alias(f"{o}__") for o, (fn, _) in values.items()))
    here = tagged.withColumns({o: fn(c).over(local) for o, (fn, c) in values.items()})
    done = here.join(base, [*by, "p_"])
    return done.select(*(c for c in cols if c not in values), *(_combined(fn, F.col(o), F.col(f"{o}__")).alias(o) for o, (fn, _) in values.items()))


def running(df: DataFrame, by: Sequence[str], order: Sequence[str | Column], values: dict[str, tuple[Callable, str]], inclusive: bool = False, most: int | None = None) -> DataFrame:
    """``df`` with columns ``out: (fn, column)`` over the rows before each one
    (and itself, if ``inclusive``) of its group ``by`` in ``order``; ``fn`` is
    ``F.sum``, ``F.max`` or ``F.min``.

    A sort by range puts a group with a third of all rows into many partitions;
    each of them works out its own rows, and a table of one row per group and
    partition carries the result of those before. Sums start at 0, maxima and
    minima at null. Rows whose group has a null are dropped. Where the caller knows that no
    group has more than ``most`` rows and that is at most :data:`LOCAL_ROWS`, a
    plain window per group gives the same rows without the sort by range.
    """
    if by and most is not None and most <= LOCAL_ROWS:
        line = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
        rows = df.dropna(subset=list(by))
        outs = [(F.coalesce(fn(c).over(line), F.lit(0)) if fn is F.sum else fn(c).over(line)).alias(o) for o, (fn, c) in values.items()]
        return rows.select(*(c for c in df.columns if c not in values), *outs)
    return carried(ordered(df, by, order), by, values, inclusive).drop("p_", "q_")
