"""Mixing sources to target weights."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plexora.llm.cutoffs import label
from plexora.session import materialize

#: Hash bits that one pass of the block permutation resolves.
_BITS, _DEPTH = 12, 5
#: Sources a mix may have.
MAX_SOURCES = 10_000


@dataclass(frozen=True)
class Source:
    """A row of the plan; sizes in tokens."""

    name: str
    target: float
    repeats: int
    tokens: int
    docs: int
    weight: float
    budget: float
    fillable: bool


def document_sizes(df: DataFrame, key: str, text: str, source: str) -> DataFrame:
    """``(id_, source_, n_, h_)``: label, size in byte tokens (0 for null text)
    and place in the hashed permutation of every document."""
    return df.select(
        F.col(key).cast("long").alias("id_"),
        label(source).alias("source_"),
        F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_"),
        F.pmod(F.xxhash64(F.lit(17), key), F.lit(1 << (_BITS * _DEPTH))).alias("h_"),
    )


def tempered(shares: list[float], targets: list[float], exponent: float) -> list[float]:
    """Token shares ``p`` pulled towards the targets ``t``: ``p * (t / p) **
    exponent``, normalised. 0 leaves the shares, 1 gives the targets; a source
    without tokens has no weight."""
    raw = [p * (t / p) ** exponent if p > 0 and t > 0 else 0.0 for p, t in zip(shares, targets)]
    s = sum(raw)
    return [x / s if s else 0.0 for x in raw]


def exponent_for(shares: list[float], targets: list[float], caps: list[float], entropy: float | None = None) -> float:
    """The largest exponent in [0, 1] at which no weight exceeds its cap and, if
    an entropy is named, the weights still have at least it; by bisection."""

    def ok(e: float) -> bool:
        w = tempered(shares, targets, e)
        if any(x > c * (1 + 1e-12) for x, c in zip(w, caps)):
            return False
        return entropy is None or -sum(x * math.log(x) for x in w if x > 0) >= entropy - 1e-12

    if ok(1.0):
        return 1.0
    low, high = 0.0, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if ok(mid) else (low, mid)
    return low


def mix_plan(sizes: DataFrame, targets: DataFrame, source: str, share: str, repeats: str, mix_tokens: float | None = None, entropy: float | None = None, tempering: bool = True) -> tuple[list[Source], int, float]:
    """``(plan, tokens of all documents, exponent)``.

    ``mix_tokens`` is the size of the mix; without it the largest at which every
    source with tokens reaches its target within its repeats, so the exponent is
    1. ``fillable`` says whether the source could fill its target share of a mix
    as large as the corpus. Without ``tempering`` the exponent stays 1 and every
    source gets its own target share or, if that is less, all its repeats; the
    mix is then smaller than asked for. A label given twice counts once, with its larger
    share; shares below 0 and null ones count as 0.
    """
    goal = {}
    for r in targets.select(label(source).alias("s"), F.col(share).alias("t"), F.col(repeats).alias("r")).where("s is not null").limit(MAX_SOURCES + 1).collect():
        t = max(float(r["t"] or 0), 0.0)
        if t == t and t >= goal.get(r["s"], (-1.0, 0))[0]:
            goal[r["s"]] = (t, int(r["r"] or 0))
    if len(goal) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    per = sizes.groupBy("source_").agg(F.sum("n_").alias("n"), F.count(F.lit(1)).alias("c"))
    per = per.join(F.broadcast(sizes.sparkSession.createDataFrame([(s,) for s in goal], "source_ string")), "source_")
    have = {r["source_"]: (r["n"], r["c"]) for r in per.collect()}
    total = sizes.agg(F.coalesce(F.sum("n_"), F.lit(0)).alias("n")).first()["n"]
    names = sorted(goal)
    tokens = [have.get(s, (0, 0))[0] for s in names]
    known = sum(tokens)
    shares = [n / known if known else 0.0 for n in tokens]
    want = [goal[s][0] for s in names]
    present = sum(t for t, n in zip(want, tokens) if n)
    norm = [t / present if n and present else 0.0 for t, n in zip(want, tokens)]
    limit = [goal[s][1] * n for s, n in zip(names, tokens)]
    if mix_tokens is None:
        mix_tokens = min([c / t for c, t in zip(limit, norm) if t > 0], default=0.0)
    caps = [c / mix_tokens if mix_tokens else 0.0 for c in limit]
    e = exponent_for(shares, norm, caps, entropy) if tempering else 1.0
    weights = tempered(shares, norm, e) if tempering else want
    plan = [
        Source(s, t, goal[s][1], n, have.get(s, (0, 0))[1], w, min(w * mix_tokens, c), not t * total > c)
        for s, t, n, w, c in zip(names, want, tokens, weights, limit)
    ]
    return plan, total, e


def _thresholds(sizes: DataFrame, need: dict[str, float]) -> dict[str, int]:
    """Per source the hash below which a permutation holds its token budget.

    The permutation's blocks are the leading hash bits. Each pass sums the
    tokens per block inside the one block in which the budget ends (map-side
    combined, 4,096 sums a source, of which one row reaches the driver) and goes
    down into it, until that block is a single document, which is taken if the sum then
    comes nearer to the budget.
    """
    low, left = {s: 0 for s in need}, dict(need)
    done: dict[str, int] = {s: 0 for s, n in need.items() if n <= 0}
    spark = sizes.sparkSession
    for depth in range(_DEPTH):
        open_ = [s for s in need if s not in done]
        if not open_:
            break
        width = 1 << (_BITS * (_DEPTH - depth - 1))
        at = F.broadcast(spark.createDataFrame([(s, low[s]) for s in open_], "source_ string, low_ long"))
        inside = sizes.join(at, "source_").where((F.col("h_") >= F.col("low_")) & (F.col("h_") < F.col("low_") + (width << _BITS)))
        per = inside.groupBy("source_", F.floor((F.col("h_") - F.col("low_")) / width).alias("bin")).agg(F.sum("n_").alias("n"), F.count(F.lit(1)).alias("c"))
        # the block of every source in which its budget ends: one row a source leaves the executors
        budget = F.broadcast(spark.createDataFrame([(s, float(left[s])) for s in open_], "source_ string, left_ double"))
        upto = F.sum("n").over(Window.partitionBy("source_").orderBy("bin"))
        ends = per.withColumn("upto_", upto).join(budget, "source_").where("upto_ > left_").groupBy("source_").agg(F.min_by(F.struct("bin", "n", "c", "upto_"), "bin").alias("e"))
        hit = {r["source_"]: r["e"] for r in ends.collect()}
        for s in open_:
            if s not in hit:
                done[s] = low[s] + (width << _BITS)
                continue
            b, n, c, upto_ = hit[s]
            left[s] -= upto_ - n
            if c == 1 or depth == _DEPTH - 1:
                # one document, or several of one hash, end the budget
                done[s] = low[s] + (b + 1) * width if n - left[s] < left[s] else low[s] + b * width
            else:
                low[s] += b * width
    return done


def mix(sizes: DataFrame, plan: list[Source]) -> DataFrame:
    """``(id_, source_, n_, uses_)``: how often each document of the mix is used.

    A source's budget is as many whole passes over its documents as fit, then
    the first blocks of its hashed permutation; so uses differ by one at most
    within a source and never exceed its repeats.
    """
    spark = sizes.sparkSession
    whole = {p.name: (int(p.budget // p.tokens) if p.tokens else 0) for p in plan}
    rest = {p.name: p.budget - whole[p.name] * p.tokens for p in plan}
    # a budget that is the cap but for rounding needs no further pass
    rest = {p.name: 0.0 if whole[p.name] >= p.repeats else rest[p.name] for p in plan}
    ends = _thresholds(sizes, rest)
    rows = [(p.name, whole[p.name], ends.get(p.name, 0)) for p in plan]
    at = F.broadcast(spark.createDataFrame(rows, "source_ string, whole_ int, end_ long"))
    uses = F.col("whole_") + (F.col("h_") < F.col("end_")).cast("int")
    return sizes.join(at, "source_").where("n_ > 0").select("id_", "source_", "n_", uses.alias("uses_")).where("uses_ > 0")


def mix_report(mixed: DataFrame, plan: list[Source]) -> DataFrame:
    """Target and reached share of every source, with the most uses of a document."""
    spark = mixed.sparkSession
    rows = [(p.name, p.target, p.repeats, p.tokens, p.docs, p.weight, p.fillable) for p in plan]
    base = spark.createDataFrame(
        rows, "source string, target_share double, max_repeats int, tokens long, n_docs long, planned_share double, fillable boolean"
    )
    per = mixed.groupBy(F.col("source_").alias("source")).agg(F.sum(F.col("n_") * F.col("uses_")).alias("mix_tokens"), F.max("uses_").alias("most_uses"))
    every = materialize(per, "mixed")
    total = every.agg(F.sum("mix_tokens")).scalar()
    return base.join(every, "source", "left").select(
        *base.columns,
        F.coalesce("mix_tokens", F.lit(0)).alias("mix_tokens"),
        F.coalesce("most_uses", F.lit(0)).alias("most_uses"),
        F.coalesce(F.col("mix_tokens") / total, F.lit(0.0)).alias("share"),
    )
