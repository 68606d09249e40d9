"""Joins that carry a status instead of dropping or guessing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import exact_mean, normalised_name
from ..sources.scratch import settle
from .scan import ranged


def unique_match(left: DataFrame, right: DataFrame, key: str, left_id: str, right_id: str) -> DataFrame:
    """A match only where the key is unique on both sides. Counts are aggregated first, so no many-to-many pairs arise."""
    a = left.groupBy(key).agg(F.count("*").alias("in_left"))
    b = right.groupBy(key).agg(F.count("*").alias("in_right"), F.min(right_id).alias("candidate"))
    status = (
        F.when(F.col(key).isNull(), "no_key")
        .when(F.col("in_right").isNull(), "unresolved")
        .when((F.col("in_left") > 1) & (F.col("in_right") > 1), "ambiguous_both")
        .when(F.col("in_left") > 1, "ambiguous_left")
        .when(F.col("in_right") > 1, "ambiguous_right")
        .otherwise("matched")
    )
    found = left.select(left_id, key).join(a, key, "left").join(b, key, "left").withColumn("status", status)
    return found.select(left_id, key, "status", F.when(F.col("status") == "matched", F.col("candidate")).alias("match"))


def nearest_in_band(left: DataFrame, right: DataFrame, key: str, at: str, name: str, band: int, left_id: str) -> DataFrame:
    """The name nearest to each left row within a band of positions; a tie between different names is null.

    Positions, not pairs, meet: names at one position are summed up first, then left rows and positions are dealt into ranges together and
    each left row sees the last position at or before it and the first after it. Where both are equally near, names that are at both are
    counted once, by a join of the names at neighbouring positions. So work grows with the rows, however many lie within a band. Rows with no
    key or position have no name; of rows that share a ``left_id`` the nearest decides, and what ties between them is put together.
    """
    names = right.where(F.col(key).isNotNull() & F.col(at).isNotNull()).select(key, F.col(at).alias("p"), F.col(name).alias("name")).distinct()
    names = settle(names, "names")
    here = names.groupBy(key, "p").agg(F.count("*").alias("n"), F.min("name").alias("least"))
    ids = left.select(left_id, key, F.col(at).alias("p"))
    asked = ids.where(F.col(key).isNotNull() & F.col("p").isNotNull())
    places = here.select(key, "p", F.struct(F.col("p").alias("at"), "n", "least").alias("there"), F.lit(None).cast(left.schema[left_id].dataType).alias(left_id), F.lit(0).alias("side"))
    both = places.unionByName(asked.select(key, "p", F.lit(None).alias("there"), left_id, F.lit(1).alias("side")))
    # places stand before the left rows of an equal position, so those see them as the last ones
    dealt = ranged(both, [key], ["p", "side"])
    present = F.col("there").isNotNull()
    below = dealt.of(dealt.previous({"low": F.col("there")}, present))
    met = below.following({"high": F.col("there")}, present).where("side = 1")
    gaps = [F.when(F.abs(F.col(f"{side}.at") - F.col("p")) <= band, F.abs(F.col(f"{side}.at") - F.col("p"))) for side in ("low", "high")]
    met = met.select(left_id, key, "low", "high", gaps[0].alias("under"), gaps[1].alias("over")).withColumn("gap", F.least("under", "over")).where("gap is not null")
    near = F.array_compact(F.array(*(F.when(F.col(g) == F.col("gap"), F.col(f"{side}.at")) for g, side in (("under", "low"), ("over", "high")))))
    met = settle(met.select(left_id, key, "gap", "low", "high", near.alias("near")), "met")
    best = met.groupBy(left_id).agg(F.count("*").alias("rows"), F.min("gap").alias("best"))
    met = met.join(best, left_id).where("gap = best")
    alone = (F.col("rows") == 1) & (F.size("near") == 1)
    one = F.when(F.element_at("near", 1) == F.col("low.at"), F.col("low")).otherwise(F.col("high"))
    single = met.where(alone).select(left_id, "best", one["n"].alias("names"), one["least"].alias("name"))
    # rows that tie between two positions: their names, those of a pair of neighbours once for all rows between them
    tied = met.where((F.col("rows") == 1) & (F.size("near") == 2)).select(left_id, key, "best", "low", "high")
    pairs = tied.select(key, F.col("low.at").alias("a"), F.col("high.at").alias("b")).distinct()
    sides = [names.select(key, F.col("p").alias(x), "name") for x in "ab"]
    first = pairs.join(sides[0], [key, "a"]).alias("x")
    shared = first.join(sides[1].alias("y"), (F.col(f"x.{key}") == F.col(f"y.{key}")) & (F.col("x.b") == F.col("y.b")) & F.col("x.name").eqNullSafe(F.col("y.name")))
    shared = shared.groupBy(F.col(f"x.{key}").alias(key), F.col("x.a").alias("a"), F.col("x.b").alias("b")).agg(F.count("*").alias("shared"))
    tied = tied.withColumns({"a": F.col("low.at"), "b": F.col("high.at")}).join(shared, [key, "a", "b"], "left")
    tied = tied.select(
        left_id, "best", (F.col("low.n") + F.col("high.n") - F.coalesce("shared", F.lit(0))).alias("names"), F.least("low.least", "high.least").alias("name")
    )
    again = met.where("rows > 1").select(left_id, key, "best", F.explode("near").alias("p")).distinct().join(names, [key, "p"])
    again = again.select(left_id, "best", "name").distinct().groupBy(left_id, "best").agg(F.count("*").alias("names"), F.min("name").alias("name"))
    found = single.unionByName(tied).unionByName(again)
    return ids.select(left_id).join(found, left_id, "left").select(
        left_id, F.when(F.col("names") == 1, F.col("name")).alias("name"), F.col("best").alias("gap"), F.coalesce("names", F.lit(0)).alias("names")
    )


def similar_sets(sets: DataFrame, references: DataFrame, group: str, candidate: str, ordinal: str, axes: Sequence[str], tolerance: float) -> DataFrame:
    """Point sets that lie on one reference set: same count, each ordinal within the tolerance, one candidate only. Sets
    meet candidates of their own count and first point's cell, not all candidates."""
    cell = lambda c: F.floor(c / tolerance)
    n_a = sets.groupBy(group).agg(F.count("*").alias("n"), F.min_by(F.col(axes[0]), F.col(ordinal)).alias("first"))
    n_b = references.groupBy(candidate).agg(F.count("*").alias("n"), F.min_by(F.col(axes[0]), F.col(ordinal)).alias("first"))
    beside = F.explode(F.array(*[cell(F.col("first")) + k for k in (-1, 0, 1)])).alias("cell")
    pairs = n_a.select(group, "n", cell(F.col("first")).alias("cell")).join(n_b.select(candidate, "n", beside), ["n", "cell"])
    a = sets.select(group, ordinal, *[F.col(x).alias(f"a_{x}") for x in axes])
    b = references.select(candidate, ordinal, *[F.col(x).alias(f"b_{x}") for x in axes])
    gap = F.greatest(*[F.abs(F.col(f"a_{x}") - F.col(f"b_{x}")) for x in axes], F.lit(0.0))
    close = (
        pairs.select(group, candidate).join(a, group).join(b, [candidate, ordinal]).groupBy(group, candidate).agg(F.max(gap).alias("gap"))
    ).where(F.col("gap") <= tolerance)
    found = close.groupBy(group).agg(F.count("*").alias("candidates"), F.min(candidate).alias("one"))
    status = F.when(F.col("candidates").isNull(), "unmatched").when(F.col("candidates") == 1, "matched").otherwise("ambiguous")
    return sets.select(group).distinct().join(found, group, "left").select(
        group, status.alias("status"), F.when(F.col("candidates") == 1, F.col("one")).alias("match")
    )


def bijection(pairs: DataFrame, keys: Sequence[str], code: str, label: str) -> DataFrame:
    """Whether codes and labels of each key stand one to one."""
    one = pairs.select(*keys, code, label).distinct()
    codes = one.groupBy(*keys, code).agg(F.count("*").alias("n")).groupBy(*keys).agg(F.max("n").alias("labels_per_code"), F.count("*").alias("codes"))
    labels = one.groupBy(*keys, label).agg(F.count("*").alias("n")).groupBy(*keys).agg(F.max("n").alias("codes_per_label"), F.count("*").alias("labels"))
    both = codes.join(labels, list(keys))
    return both.withColumn("bijective", (F.col("labels_per_code") == 1) & (F.col("codes_per_label") == 1))


def gate(rows: DataFrame, key: str, ok: Column) -> DataFrame:
    """All or nothing: each object's rows are accepted only if every one is."""
    seen = rows.groupBy(key).agg(F.bool_and(F.coalesce(ok, F.lit(False))).alias("accepted"), F.count("*").alias("n"))
    return seen.select(key, "n", "accepted")


def names_contained(rows: DataFrame, inventory: DataFrame, row_id: str, name: str, item: str, order: str, least: int = 3) -> DataFrame:
    """The first inventory item whose normalised name contains a row's name or lies in it.

    Names meet by their 3-grams: of two names, one contains the other only if every 3-gram of the shorter is in the longer,
    so its first 3-gram is a join key on that side and all 3-grams are on the other. Names, not rows, are joined.
    """
    grams = lambda c: F.transform(F.sequence(F.lit(1), F.length(c) - least + 1), lambda k: F.substring(c, k, F.lit(least)))
    a = rows.select(normalised_name(F.col(name)).alias("a")).where(F.length("a") >= least).distinct()
    b = inventory.groupBy(normalised_name(F.col(item)).alias("b")).agg(F.min(order).alias("first")).where(F.length("b") >= least)
    head = lambda c: F.substring(F.col(c), 1, least).alias("gram")
    each = lambda c: F.explode(F.array_distinct(grams(F.col(c)))).alias("gram")
    inside = a.select("a", head("a")).join(b.select("b", "first", each("b")), "gram").where(F.col("b").contains(F.col("a")))
    around = a.select("a", each("a")).join(b.select("b", "first", head("b")), "gram").where(F.col("a").contains(F.col("b")))
    best = inside.select("a", "first").union(around.select("a", "first")).groupBy("a").agg(F.min("first").alias("first"))
    keyed = rows.select(row_id, normalised_name(F.col(name)).alias("a"))
    return keyed.join(best, "a", "left").select(row_id, F.col("first").alias("match"))


def longest_root(paths: DataFrame, roots: DataFrame, path: str, root: str) -> DataFrame:
    """Each path's longest root. A path is cut into its ancestors, so roots are found by equality."""
    parts = F.split(F.col(path), "/")
    above = F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))).alias(root)
    hit = paths.select(path, above).join(roots.select(root), root).groupBy(path).agg(F.max_by(root, F.length(root)).alias(root))
    return paths.select(path).join(hit, path, "left")


def cross_check(heads: DataFrame, first: DataFrame, key: str, axes: Sequence[str], tolerance: float) -> DataFrame:
    """Heads against the first station of their track."""
    b = first.select(key, *[F.col(x).alias(f"track_{x}") for x in axes])
    gap = F.sqrt(sum(((F.col(x) - F.col(f"track_{x}")) ** 2 for x in axes), F.lit(0.0)))
    joined = heads.join(b, key, "left").withColumn("gap", F.round(gap, 6))
    status = (
        F.when(F.col(f"track_{axes[0]}").isNull(), "no_track").when(F.col("gap").isNull(), "no_position")
        .when(F.col("gap") <= tolerance, "confirmed").otherwise("conflict")
    )
    return joined.select(key, "gap", status.alias("status"))


def zipped(a: DataFrame, b: DataFrame, key: Sequence[str], ordinal: str, value: str) -> DataFrame:
    """Rows side by side by ordinal; where one side is short, its value is null and the row says so."""
    left = a.select(*key, ordinal, F.col(value).alias("left"), F.lit(True).alias("in_left"))
    right = b.select(*key, ordinal, F.col(value).alias("right"), F.lit(True).alias("in_right"))
    return left.join(right, [*key, ordinal], "full").select(
        *key, ordinal, "left", "right", (F.col("in_left").isNotNull() & F.col("in_right").isNotNull()).alias("paired")
    )


def agreement(pairs: DataFrame, keys: Sequence[str], a: str, b: str, tolerance: float) -> DataFrame:
    """Error statistics of two columns whose nulls must agree."""
    gap = F.abs(F.col(a) - F.col(b))
    return pairs.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.bool_and(F.col(a).isNull() == F.col(b).isNull()).alias("nulls_agree"),
        F.round(F.max(gap), 6).alias("most_error"),
        exact_mean(F.round(gap, 6)).alias("mean_error"),
        (F.coalesce(F.max(gap), F.lit(0.0)) <= tolerance).alias("within"),
    )


def exactly_one_target(changes: DataFrame, rows: DataFrame, key: str, into: str) -> DataFrame:
    """Changes apply only if each hits exactly one row and no two make the same value: a status for each and one for all."""
    hits = rows.groupBy(key).agg(F.count("*").alias("hits"))
    per = changes.join(hits, key, "left").withColumn("hits", F.coalesce("hits", F.lit(0)))
    twice = changes.groupBy(into).agg(F.count("*").alias("uses"))
    checked = per.join(twice, into).withColumn("ok", (F.col("hits") == 1) & (F.col("uses") == 1))
    whole = checked.agg(F.bool_and("ok").alias("applied"))
    return checked.crossJoin(F.broadcast(whole)).select(key, into, "hits", "uses", "ok", "applied")  # one row


def latest_before(left: DataFrame, right: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """As-of: the last right value of the key at or before each left row, by one union dealt into ranges and no pairs: a key may fill any number of tasks."""
    rest = [c for c in left.columns if c not in (key, at)]
    a = left.select(key, at, F.struct(*rest).alias("row"), F.lit(None).alias(value), F.lit(1).alias("side"))
    b = right.select(key, at, F.lit(None).alias("row"), value, F.lit(0).alias("side"))
    dealt = ranged(b.unionByName(a), [key], [at, "side"])
    both = dealt.previous({"last": F.col(value)}, F.col(value).isNotNull()).where("side = 1")
    return both.select(key, at, *[F.col(f"row.{c}").alias(c) for c in rest], F.col("last").alias(value))
