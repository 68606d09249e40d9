"""Statistics and quality of sampled sequences: well logs, trajectories, lattices."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import distance, exact_mean, finite, histogram_bin
from .scan import ranged


def masked(value: str, is_null: str) -> Column:
    """A value where it is finite and not masked."""
    v = F.col(value)
    return F.when(~F.col(is_null) & finite(v), v)


def statistics(rows: DataFrame, keys: Sequence[str], value: Column, places: int = 6) -> DataFrame:
    """Count, minimum, maximum, mean and population deviation of a column; nulls where nothing counts."""
    return rows.withColumn("v", value).groupBy(*keys).agg(
        F.count("*").alias("samples"),
        F.count("v").alias("valid"),
        F.min("v").alias("least"),
        F.max("v").alias("most"),
        exact_mean(F.col("v")).alias("mean"),
        F.round(F.stddev_pop("v"), places).alias("deviation"),
    )


def histogram(rows: DataFrame, keys: Sequence[str], value: Column, bins: int = 40) -> DataFrame:
    """Counts of every bin of each key, empty ones too. Range and counts are partial aggregations; the ranges, a row per
    key, are joined back."""
    kept = rows.select(*keys, value.alias("v")).where("v is not null")
    ranges = kept.groupBy(*keys).agg(F.min("v").alias("low"), F.max("v").alias("high"))
    counted = (
        kept.join(ranges, list(keys))
        .groupBy(*keys, histogram_bin(F.col("v"), F.col("low"), F.col("high"), bins).alias("bin"))
        .agg(F.count("*").alias("n"))
    )
    every = ranges.select(*keys, F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    return every.join(counted, [*keys, "bin"], "left").select(*keys, "bin", F.coalesce("n", F.lit(0)).alias("n"))


def _stepped(rows: DataFrame, keys: Sequence[str], order: Sequence[str], depth: str) -> DataFrame:
    """Rows with the difference of their depth and the one before, null for the first; an object may fill any number of tasks."""
    narrow = rows.select(*dict.fromkeys((*keys, *order, depth)))
    return ranged(narrow, keys, order).previous({"was": F.col(depth)}).withColumn("step", F.col(depth) - F.col("was"))


def sequence_quality(rows: DataFrame, keys: Sequence[str], order: Sequence[str], depth: str) -> DataFrame:
    """Rows, non-finite, negative and repeated depths, and whether they run one way."""
    return _stepped(rows, keys, order, depth).groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.count_if(~finite(F.col(depth))).alias("nonfinite"),
        F.count_if(F.col(depth) < 0).alias("negative"),
        F.count_if(F.col("step") == 0).alias("repeated"),
        F.coalesce(F.bool_and(F.col("step") >= 0) | F.bool_and(F.col("step") <= 0), F.lit(True)).alias("monotonic"),
        (F.count("*") < 3).alias("too_sparse"),
    )


def station_statistics(rows: DataFrame, keys: Sequence[str], order: Sequence[str], depth: str) -> DataFrame:
    """Step evidence of a trajectory; null where there are too few stations."""
    return _stepped(rows, keys, order, depth).groupBy(*keys).agg(
        F.count("*").alias("stations"),
        F.count_if(F.col(depth) < 0).alias("negative_md"),
        F.count_if(F.col("step") == 0).alias("equal_pairs"),
        F.count_if(F.col("step") < 0).alias("decreasing_pairs"),
        F.min("step").alias("least_step"),
        F.max("step").alias("most_step"),
        F.when(F.count("*") >= 3, F.min("step") == F.max("step")).alias("uniform"),
    )


def regularity(rows: DataFrame, keys: Sequence[str], order: Sequence[str], depth: str) -> DataFrame:
    found = _stepped(rows, keys, order, depth).groupBy(*keys).agg(F.count("step").alias("steps"), F.count_distinct("step").alias("distinct"))
    kind = F.when(F.col("steps") == 0, "insufficient").when(F.col("distinct") == 1, "regular").otherwise("irregular")
    return found.select(*keys, "steps", kind.alias("sampling"))


def path_length(rows: DataFrame, keys: Sequence[str], order: Sequence[str], axes: Sequence[str], places: int = 4) -> DataFrame:
    """Length along a path up to each row."""
    dealt = ranged(rows, keys, order)
    before = dealt.previous({f"was_{a}": F.col(a) for a in axes})
    leg = F.coalesce(distance(*[(F.col(a), F.col(f"was_{a}")) for a in axes]), F.lit(0.0))
    legs = before.withColumn("leg", leg).drop(*(f"was_{a}" for a in axes))
    summed = dealt.of(legs).running({"length": F.col("leg")})
    return dealt.undealt(summed.withColumn("length", F.round("length", places)).drop("leg"))


def runs(rows: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, index: str) -> DataFrame:
    """Run lengths of equal neighbours: keys, start index, length, value."""
    dealt = ranged(rows.select(*dict.fromkeys((*keys, *order, value, index))), keys, order)
    before = dealt.previous({"was": F.col(value), "there": F.lit(True)})
    change = F.when(F.col("there") & F.col(value).eqNullSafe(F.col("was")), 0).otherwise(1)
    islands = dealt.of(before.withColumn("change", change)).running({"island": F.col("change")})
    return (
        islands.groupBy(*keys, "island")
        .agg(F.min(index).alias("start"), F.count("*").alias("length"), F.first(value).alias(value))
        .drop("island")
    )


def segments(rows: DataFrame, keys: Sequence[str], order: Sequence[str], missing: str, least: int = 2) -> DataFrame:
    """Polylines cut at missing vertices: (keys, segment, vertices) of those with enough vertices."""
    dealt = ranged(rows.select(*dict.fromkeys((*keys, *order, missing))), keys, order)
    return (
        dealt.running({"segment": F.col(missing).cast("int")})
        .where(~F.col(missing))
        .groupBy(*keys, "segment")
        .agg(F.count("*").alias("vertices"))
        .where(F.col("vertices") >= least)
    )


def _placed(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows with ``at``, their place in the group from 0, and ``total``, how many it has."""
    dealt = ranged(rows, keys, order)
    totals = dealt.rows.groupBy(*(F.col(k).alias(f"of_{k}") for k in keys)).agg(F.count("*").alias("total"))
    met = F.lit(True)
    for k in keys:
        met = met & F.col(k).eqNullSafe(F.col(f"of_{k}"))
    return dealt.undealt(dealt.numbered("at").join(totals, met).drop(*(f"of_{k}" for k in keys)))


def decimated(rows: DataFrame, keys: Sequence[str], order: Sequence[str], most: int) -> DataFrame:
    """Every k-th row and the last, k being the least stride that keeps ``most`` rows."""
    marked = _placed(rows, keys, order)
    stride = F.greatest(F.lit(1), F.ceil(F.col("total") / most))
    return marked.where((F.col("at") % stride == 0) | (F.col("at") == F.col("total") - 1)).drop("total")


def evenly(rows: DataFrame, keys: Sequence[str], order: Sequence[str], k: int) -> DataFrame:
    """k rows spread evenly from the first to the last (all, if there are fewer)."""
    marked = _placed(rows, keys, order)
    picks = F.transform(
        F.sequence(F.lit(0), F.least(F.col("total"), F.lit(k)) - 1),
        lambda s: F.floor(s * (F.col("total") - 1) / F.greatest(F.lit(1), F.least(F.col("total"), F.lit(k)) - 1)).cast("long"),
    )
    return marked.where(F.array_contains(picks, F.col("at").cast("long"))).drop("total")


def bounds(rows: DataFrame, keys: Sequence[str], axes: Sequence[str], missing: Column) -> DataFrame:
    kept = [F.when(~missing, F.col(a)) for a in axes]
    pairs = [f(v).alias(f"{n}_{a}") for a, v in zip(axes, kept, strict=True) for n, f in (("least", F.min), ("most", F.max))]
    return rows.groupBy(*keys).agg(F.count_if(~missing).alias("present"), *pairs)


def trailing_envelope(rows: DataFrame, keys: Sequence[str], order: Sequence[str], axes: Sequence[str], last: int = 100, wide: float = 1.0) -> DataFrame:
    """Whether each row lies in the box of the rows before it, widened: two axes outside make it implausible."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(-last, -1)
    out = rows
    outside = F.lit(0)
    for a in axes:
        low, high = F.min(a).over(w), F.max(a).over(w)
        out = out.withColumn(f"low_{a}", low).withColumn(f"high_{a}", high)
        span = (F.col(f"high_{a}") - F.col(f"low_{a}")) * wide
        is_out = (F.col(a) < F.col(f"low_{a}") - span) | (F.col(a) > F.col(f"high_{a}") + span)
        outside = outside + F.coalesce(is_out, F.lit(False)).cast("int")
    return out.withColumn("outside", outside).withColumn("plausible", F.col("outside") < 2).drop(*[f"{s}_{a}" for s in ("low", "high") for a in axes])
