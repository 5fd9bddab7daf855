"""Genomic intervals: parsing, merging, overlap joins and matrix remapping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plexora.operators.running import carried


def parse(df: DataFrame, peak: str = "peak") -> DataFrame:
    """``(chr, start, end, peak)`` of texts ``chr:start-end``; other texts are dropped."""
    p = F.col(peak)
    x = df.where(p.rlike(r"^[^:]+:-?[0-9]+--?[0-9]+$")).select(
        F.regexp_extract(p, r"^([^:]+):", 1).alias("chr"),
        F.regexp_extract(p, r":(-?[0-9]+)-", 1).try_cast("long").alias("start"),
        F.regexp_extract(p, r":-?[0-9]+-(-?[0-9]+)$", 1).try_cast("long").alias("end"),
        p.alias("peak"),
    )
    return x.where("start is not null and end is not null")


def _swept(ivs: DataFrame, width: int) -> DataFrame:
    """Distinct intervals with the running end ``before`` of those before them; the
    sweep is parted by bins of the start, so a chromosome is many tasks."""
    rows = ivs.select("chr", "start", "end").dropna().distinct()
    marked = rows.select("*", F.floor(F.col("start") / width).alias("p_"), F.struct("start", "end").alias("q_"))
    return carried(marked, ["chr"], {"before": (F.max, "end")})


def merge(ivs: DataFrame, width: int = 1 << 14) -> DataFrame:
    """``(chr, start, end)``: intervals joined while one starts strictly before
    the running end; touching ones stay apart. Repeated intervals count once,
    intervals with a null part are dropped."""
    fresh = F.when(F.col("before").isNull() | (F.col("start") >= F.col("before")), 1).otherwise(0).cast("long")
    island = carried(_swept(ivs, width).withColumn("f_", fresh), ["chr"], {"i_": (F.sum, "f_")}, inclusive=True)
    return island.groupBy("chr", "i_").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("i_")


def has_overlap(ivs: DataFrame, width: int = 1 << 14) -> DataFrame:
    """One row ``(overlapping)``: whether neighbours in order of start overlap
    strictly, which is so exactly if some interval starts before the running end
    of those before it. A repeated interval of some length overlaps itself."""
    twice = ivs.select("chr", "start", "end").dropna().groupBy("chr", "start", "end").agg(F.count(F.lit(1)).alias("n")).where("n > 1 and start < end")
    hit = _swept(ivs, width).where(F.col("start") < F.col("before")).select("chr").union(twice.select("chr"))
    return hit.agg((F.count(F.lit(1)) > 0).alias("overlapping"))


def align(query: DataFrame, ref: DataFrame, width: int = 1 << 14) -> DataFrame:
    """``(chr, start, end, ref_start, ref_end)`` of all overlapping pairs, ends
    inclusive. Both sides are cut into bins of ``width``; pairs meet by equality
    of (chromosome, bin), in the first bin they share only, so neither a long
    chromosome nor a skewed one becomes a cross product."""
    bins = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / width), F.floor(F.col(b) / width)))
    q = query.where(F.col("start") <= F.col("end")).select("chr", "start", "end", bins("start", "end").alias("bin"))
    r = ref.where(F.col("start") <= F.col("end")).select("chr", F.col("start").alias("ref_start"), F.col("end").alias("ref_end"), bins("start", "end").alias("bin"))
    hit = q.join(r, ["chr", "bin"]).where((F.col("start") <= F.col("ref_end")) & (F.col("end") >= F.col("ref_start")))
    first = F.floor(F.greatest("start", "ref_start") / width)
    return hit.where(F.col("bin") == first).select("chr", "start", "end", "ref_start", "ref_end")


def remap(counts: DataFrame, mapping: DataFrame, strict: bool = True) -> DataFrame:
    """``(obs, merged, value)``: values ``(obs, peak, value)`` summed over the
    peaks of each merged interval ``(peak, merged)``. ``strict`` fails unless
    the mapping has as many rows as distinct peaks."""
    if strict:
        rows, peaks = mapping.count(), counts.select("peak").distinct().count()
        if rows != peaks:
            raise ValueError(f"{rows} mapping rows for {peaks} peaks")
    return counts.join(mapping, "peak").groupBy("obs", "merged").agg(F.sum("value").alias("value"))
