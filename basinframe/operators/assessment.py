"""Assessments over a catalogue: qualification along dependencies, declarations, legends, summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .catalogue import contracted
from .scan import ranged


def qualified(assessed: DataFrame, levels: DataFrame, edges: DataFrame, node: str, needs: str, ok: str) -> DataFrame:
    """An entity qualifies if it passes and everything it needs qualifies, which ``contracted`` finds with those that do not pass as failures; entities
    without a level (cycles, dangling needs) do not qualify."""
    state = assessed.select(node, F.coalesce(ok, F.lit(False)).alias(ok))
    failing = state.where(~F.col(ok)).select(node)
    found = contracted(edges, node, needs, failing).where("level is not null").select(node, F.lit(True).alias("qualified"))
    return state.join(levels.hint("merge"), node, "left").join(found.hint("merge"), node, "left").select(node, "level", (F.col(ok) & F.coalesce("qualified", F.lit(False))).alias("qualified"))


def declarations(rows: DataFrame, owner: str, fields: Sequence[tuple[str, Column]]) -> DataFrame:
    """For each owner and field: absent, recorded or duplicate, from how many declarations say something."""
    counted = rows.groupBy(owner).agg(*[F.count_if(F.coalesce(c, F.lit(False))).alias(n) for n, c in fields])
    long = counted.unpivot(owner, [n for n, _ in fields], "field", "n")
    return long.withColumn("status", F.when(F.col("n") == 0, "absent").when(F.col("n") == 1, "recorded").otherwise("duplicate"))


def first_seen(rows: DataFrame, keys: Sequence[str], order: str, value: str) -> DataFrame:
    """Distinct values of each key in the order they were first seen."""
    firsts = rows.groupBy(*keys, value).agg(F.min(order).alias("at"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("at", value))), lambda x: x[value])
    return firsts.groupBy(*keys).agg(F.array_join(listed, ",").alias("seen"))


def reconciled(parts: DataFrame, totals: DataFrame, key: str, n: str) -> DataFrame:
    """Whether counts of parts add up to the declared total."""
    summed = parts.groupBy(key).agg(F.sum(n).alias("counted"))
    both = totals.select(key, F.col(n).alias("declared")).join(summed, key, "full").fillna(0, ["declared", "counted"])
    return both.withColumn("reconciled", F.col("declared") == F.col("counted"))


def clipped(rows: DataFrame, keys: Sequence[str], order: Sequence[str], inside: Column, least: int = 2) -> DataFrame:
    """Runs of neighbours inside a region: an exit starts a new run; short runs go."""
    marked = rows.withColumn("inside", F.coalesce(inside, F.lit(False)))
    kept = ranged(marked.select(*dict.fromkeys((*keys, *order, "inside"))), keys, order).running({"run": (~F.col("inside")).cast("int")}).where("inside")
    return kept.groupBy(*keys, "run").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def legend(codes: DataFrame, key: str, code: str, label: str, low: int, high: int) -> DataFrame:
    """Labels of codes: one label is recorded, several conflict, a code outside the bounds is rejected."""
    one = codes.groupBy(key, code).agg(F.count_distinct(label).alias("labels"), F.min(label).alias("one"))
    status = (
        F.when((F.col(code) < low) | (F.col(code) > high), "out_of_bounds").when(F.col("labels") == 1, "recorded")
        .when(F.col("labels") == 0, "unlabelled").otherwise("conflict")
    )
    return one.select(key, code, status.alias("status"), F.when(status == "recorded", F.col("one")).alias("label"))


def state(priority: Sequence[tuple[str, Column]], otherwise: str) -> Column:
    """The first state whose condition holds."""
    out = F.lit(otherwise)
    for name, condition in reversed(list(priority)):
        out = F.when(F.coalesce(condition, F.lit(False)), name).otherwise(out)
    return out


def keyed_name(*columns: str, digits: int = 16) -> Column:
    """A representation key: a hash of named values as canonical JSON."""
    return F.substring(F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256), 1, digits)


def quarantine_checked(accepted: DataFrame, quarantined: DataFrame, listing: DataFrame, key: str, digest: str, reason: str) -> DataFrame:
    """A finding for each quarantined object: also accepted, without a reason, not there, or other bytes than were quarantined; else held."""
    own = quarantined.select(key, F.col(digest).alias("_held"), reason)
    taken = accepted.select(key).distinct().withColumn("_taken", F.lit(True))
    there = listing.select(key, F.col(digest).alias("_found"))
    found = own.join(taken, key, "left").join(there, key, "left")
    states = [
        ("accepted_and_quarantined", F.col("_taken")), ("without_reason", ~F.coalesce(F.length(F.trim(reason)) > 0, F.lit(False))),
        ("missing", F.col("_found").isNull()), ("changed", ~F.col("_found").eqNullSafe(F.col("_held"))),
    ]
    return found.select(key, state(states, "held").alias("finding"))


def shards_checked(rows: DataFrame, shard: str, key: str, declared: DataFrame) -> DataFrame:
    """Shards of a table against what is declared of them (shard, rows): counts, and that keys follow each other from shard to shard without
    overlap."""
    found = rows.groupBy(shard).agg(F.count("*").alias("found"), F.min(key).alias("first"), F.max(key).alias("last"))
    both = declared.select(shard, F.col("rows").alias("declared")).join(found, shard, "full")
    dealt = ranged(both, [], [shard])
    states = [
        ("undeclared", F.col("declared").isNull()), ("missing", F.col("found").isNull() & (F.col("declared") > 0)),
        ("row_count", F.coalesce("found", F.lit(0)) != F.col("declared")), ("overlap", F.col("first") <= F.col("before")),
    ]
    return dealt.running({"before": F.col("last")}, False, F.max).select(shard, "declared", "found", state(states, "ok").alias("status"))
