"""Column expressions shared by the operators; all of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def round_half_away(x: Column | str) -> Column:
    """The integer nearest to ``x``, halves away from zero; null for null."""
    c = col(x)
    return (F.signum(c) * F.floor(F.abs(c) + 0.5)).cast("long")


def finite(x: Column | str) -> Column:
    """Whether ``x`` is neither null, NaN nor infinite; never null itself."""
    c = col(x).cast("double")
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))


def safe_float(x: Column | str) -> Column:
    """``x`` as a double, 0 where it is null, NaN, infinite or no number."""
    c = col(x).try_cast("double")
    return F.when(finite(c), c).otherwise(F.lit(0.0))


def log1p_clipped(x: Column | str, low: float | None = None, high: float | None = None) -> Column:
    """``log(1 + x)`` with negative values taken as 0, then clipped."""
    y = F.log1p(F.greatest(col(x).cast("double"), F.lit(0.0)))
    if low is not None:
        y = F.greatest(y, F.lit(low))
    return y if high is None else F.least(y, F.lit(high))


def log1p_strict(x: Column | str) -> Column:
    """``log(1 + x)``; a negative value raises an error."""
    c = col(x).cast("double")
    return F.when(c < 0, F.raise_error(F.lit("negative value before log1p")).cast("double")).otherwise(F.log1p(c))


def expm1(x: Column | str) -> Column:
    return F.expm1(col(x))


def dot(a: Column | str, b: Column | str) -> Column:
    """Inner product of two arrays; null if either is null."""
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(F.aggregate(col(a), F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column | str, b: Column | str, least: float = 1e-8) -> Column:
    """Cosine of two arrays; 0 where a norm is below ``least``."""
    n = norm(a), norm(b)
    return F.when((n[0] < least) | (n[1] < least), F.lit(0.0)).otherwise(dot(a, b) / (n[0] * n[1]))


def pearson(x: Column | str, y: Column | str) -> Column:
    """Correlation as an aggregate over rows where both sides are known; null
    where a side is constant. (The built-in one fails there in ANSI mode.)"""
    a, b = (F.when(col(q).isNotNull(), col(p).cast("double")) for p, q in ((x, y), (y, x)))
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def argmax(a: Column | str) -> Column:
    """0-based place of the first maximum of an array; null for an empty one."""
    c = col(a)
    return F.when(F.size(c) > 0, F.array_position(c, F.array_max(c)) - 1).cast("int")


def suffix_token(x: Column | str) -> Column:
    """What follows the last ``_``; the whole text without one; null for null."""
    return F.substring_index(col(x), "_", -1)


def interval_key(chrom: Column | str, start: Column | str, end: Column | str) -> Column:
    return F.concat(col(chrom), F.lit(":"), col(start).cast("string"), F.lit("-"), col(end).cast("string"))


def sanitized(x: Column | str) -> Column:
    """Every run of characters unfit for a file name as one ``_``."""
    return F.regexp_replace(col(x), r"[^A-Za-z0-9._-]+", "_")


def without_prefix(x: Column | str, prefix: str) -> Column:
    return F.replace(col(x), F.lit(prefix), F.lit(""))


def natural_order(x: Column | str) -> list[Column]:
    """Sort keys: texts that are integers first, by value; then the others."""
    n = col(x).try_cast("long")
    return [n.isNull(), n, col(x)]


def focal_loss(p: Column | str, alpha: Column | float = 1.0, gamma: float = 2.0) -> Column:
    """``-alpha (1 - p)^gamma ln p`` of the probability of the true class."""
    c = col(p)
    return -(alpha if isinstance(alpha, Column) else F.lit(float(alpha))) * F.pow(1 - c, F.lit(gamma)) * F.ln(c)


def delta_sign(d: Column | str) -> Column:
    c = col(d)
    return F.when(c > 0, "positive").when(c < 0, "negative").when(c.isNotNull(), "zero")


def edge_class(a_new: Column, b_new: Column) -> Column:
    """``old-old``, ``old-new`` or ``new-new``."""
    return F.when(a_new & b_new, "new-new").when(a_new | b_new, "old-new").otherwise("old-old")


def param_hash(values: Column | str) -> Column:
    """md5 of an array's decimal texts, to tell whether parameters changed."""
    return F.md5(F.concat_ws(",", F.transform(col(values), lambda x: F.format_string("%.6f", x.cast("double")))))


def pair_of(x: Column | str) -> Column:
    """Array of the two trimmed names of ``A--B``, ``A,B`` or ``A:B``, tried in
    that order; null for any other text."""
    c = col(x)
    out = F.lit(None).cast("array<string>")
    for sep in (":", ",", "--"):
        parts = F.split(c, sep, -1)
        out = F.when(F.contains(c, F.lit(sep)), F.when(F.size(parts) == 2, F.transform(parts, lambda y: F.trim(y)))).otherwise(out)
    return out
