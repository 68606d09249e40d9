"""Versions, blobs and manifests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The row of each key that is last by ``order``: one aggregation with a map-side part, no sort of the rows."""
    rest = [c for c in rows.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*order)).alias("best")
    return rows.groupBy(*keys).agg(best).select(*keys, *[F.col(f"best.{c}").alias(c) for c in rest])


def latest_then_filter(rows: DataFrame, keys: Sequence[str], order: Sequence[str], condition: Column) -> DataFrame:
    """Latest first, then the filter: an object whose latest version does not qualify is absent."""
    return latest(rows, keys, order).where(condition)


def reassembled(parts: DataFrame, key: str, ordinal: str, blob: str) -> DataFrame:
    """Parts in order as one blob; null and ``gap`` where ordinals are not contiguous from 0 or repeat."""
    grouped = parts.groupBy(key).agg(
        F.count("*").alias("parts"),
        F.min(ordinal).alias("low"),
        F.max(ordinal).alias("high"),
        F.count_distinct(ordinal).alias("distinct"),
        F.array_sort(F.collect_list(F.struct(ordinal, blob))).alias("all"),
    )
    whole = (F.col("low") == 0) & (F.col("high") - F.col("low") + 1 == F.col("parts")) & (F.col("distinct") == F.col("parts"))
    joined = F.array_join(F.transform("all", lambda p: p[blob]), "")
    return grouped.select(
        key, "parts", F.when(whole, joined).alias(blob), F.when(whole, "complete").otherwise("gap").alias("status")
    )


def keyed_diff(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """added, removed, changed or unchanged for each key of either side."""
    a = before.select(key, F.col(value).alias("was"), F.lit(True).alias("in_a"))
    b = after.select(key, F.col(value).alias("now"), F.lit(True).alias("in_b"))
    status = (
        F.when(F.col("in_a").isNull(), "added")
        .when(F.col("in_b").isNull(), "removed")
        .when(F.col("was").eqNullSafe(F.col("now")), "unchanged")
        .otherwise("changed")
    )
    return a.join(b, key, "full").select(key, "was", "now", status.alias("status"))


def upsert(base: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """Rows of ``base`` replaced by key, and new ones."""
    return base.join(changes.select(key), key, "left_anti").unionByName(changes)


def content_groups(files: DataFrame, path: str, cheap: Sequence[str], full: str) -> DataFrame:
    """Duplicates in two stages: only files whose cheap key is shared compare by the full hash. One row per file with its
    group's survivor, the smallest path, and the group's size."""
    shared = files.groupBy(*cheap).agg(F.count("*").alias("n")).where("n > 1").drop("n")
    candidates = files.join(shared, list(cheap), "left_semi")
    groups = candidates.groupBy(*cheap, full).agg(F.min(path).alias("survivor"), F.count("*").alias("copies"))
    return files.join(groups, [*cheap, full], "left").select(
        path, F.coalesce("survivor", path).alias("survivor"), F.coalesce("copies", F.lit(1)).alias("copies")
    )


def shared_owner_conflicts(declarations: DataFrame, path: str, owner: str, values: Sequence[str]) -> DataFrame:
    """Every owner of a path that is declared with different values; a distinct count, not a list, is carried."""
    spread = declarations.groupBy(path).agg(F.count_distinct(F.struct(*values)).alias("declared"))
    return declarations.join(spread, path).select(
        path, owner, "declared", F.when(F.col("declared") > 1, "conflict").otherwise("pass").alias("status")
    )


def fingerprint(files: DataFrame, group: str, path: str, bucket: Column, *values: str) -> DataFrame:
    """A hash for each group of its ordered (path, values) lines. Lines are hashed in the buckets that ``bucket`` makes of
    neighbouring paths, then the buckets in order, so a large group is not listed whole."""
    def ordered(key: str, value: str) -> Column:
        return F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key, value))), lambda x: x[value]), ""), 256)

    line = F.sha2(F.concat_ws(" ", *[F.col(c).cast("string") for c in (path, *values)]), 256)
    lines = files.select(group, path, bucket.alias("bucket"), line.alias("line"))
    parts = lines.groupBy(group, "bucket").agg(ordered(path, "line").alias("part"))
    return parts.groupBy(group).agg(ordered("bucket", "part").alias("fingerprint"))


def first_of_repeats(events: DataFrame, key: str, order: Sequence[str], body: Column) -> DataFrame:
    """The first row of each key, and whether its repeats say something else."""
    rest = [c for c in events.columns if c != key]
    return (
        events.groupBy(key)
        .agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("first"), F.count("*").alias("seen"), F.count_distinct(body).alias("bodies"))
        .select(key, *[F.col(f"first.{c}").alias(c) for c in rest], "seen", (F.col("bodies") > 1).alias("conflict"))
    )


def numbered(rows: DataFrame, keys: Sequence[str], order: Sequence[str], into: str = "record_index") -> DataFrame:
    return rows.withColumn(into, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1)
