"""Bindings between declared, found and earlier outputs: exact keys, conflicts and precedence as statuses."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def typed_link(rows: DataFrame, nodes: DataFrame, keys: Sequence[str], row_id: str, value: str) -> DataFrame:
    """A link on all of several keys; rows whose first key exists under another class say so."""
    exact = nodes.select(*keys, F.col(value).alias("linked"))
    first = nodes.select(keys[0]).distinct().withColumn("seen", F.lit(True))
    out = rows.join(exact, list(keys), "left").join(first, keys[0], "left")
    status = F.when(F.col("linked").isNotNull(), "linked").when(F.col("seen"), "class_mismatch").otherwise("missing_metadata")
    return out.select(row_id, *keys, "linked", status.alias("status"))


def registered(listing: DataFrame, manifest: DataFrame, path: str, fields: Sequence[str], default: str = "not_registered") -> DataFrame:
    """Files found on disk with what the manifest says; paths meet without regard to case."""
    m = manifest.select(F.lower(path).alias("_key"), *[F.col(f).alias(f) for f in fields], F.lit("registered").alias("_there"))
    joined = listing.withColumn("_key", F.lower(path)).join(m.dropDuplicates(["_key"]), "_key", "left")
    return joined.withColumn("registration", F.coalesce("_there", F.lit(default))).drop("_key", "_there")


def reusable(wanted: DataFrame, committed: DataFrame, keys: Sequence[str], bound: Sequence[str]) -> DataFrame:
    """Which outputs of an earlier run can stay: same key and equal bindings, nulls equal."""
    c = committed.select(*keys, *[F.col(b).alias(f"was_{b}") for b in bound], F.lit(True).alias("done"))
    same = F.lit(True)
    for b in bound:
        same = same & F.col(b).eqNullSafe(F.col(f"was_{b}"))
    status = F.when(F.col("done").isNull(), "new").when(same, "reuse").otherwise("stale")
    return wanted.join(c, list(keys), "left").select(*keys, status.alias("status"))


def decided(entities: DataFrame, decisions: DataFrame, key: str, value: str) -> DataFrame:
    """Decisions on entities: none, one, agreeing or in conflict; a conflict decides nothing."""
    d = decisions.groupBy(key).agg(F.count("*").alias("decisions"), F.min(value).alias("low"), F.max(value).alias("high"))
    agreed = F.col("low").eqNullSafe(F.col("high"))
    status = F.when(F.col("decisions").isNull(), "undecided").when(agreed, "decided").otherwise("conflict")
    out = entities.select(key).join(d, key, "left").withColumn("status", status)
    return out.select(key, F.coalesce("decisions", F.lit(0)).alias("decisions"), "status", F.when(F.col("status") == "decided", F.col("low")).alias(value))


def merged_checkpoint(final: DataFrame, checkpoint: DataFrame, listing: DataFrame, keys: Sequence[str], path: str, size: str, digest: str) -> DataFrame:
    """Final rows, and checkpoint rows that no final row has and whose file still is what they say; others are findings."""
    f = final.withColumn("origin", F.lit("final"))
    rest = checkpoint.join(final.select(*keys), list(keys), "left_anti")
    now = listing.select(path, F.col(size).alias("_size"), F.col(digest).alias("_digest"))
    proven = F.col(size).eqNullSafe(F.col("_size")) & F.col(digest).eqNullSafe(F.col("_digest"))
    kind = F.when(F.coalesce(proven, F.lit(False)), "checkpoint_only_partial").otherwise("finding")
    kept = rest.join(now, path, "left").withColumn("origin", kind).drop("_size", "_digest")
    return f.unionByName(kept.select(*f.columns))


def one_to_one(declared: DataFrame, indexed: DataFrame, keys: Sequence[str], gap: str) -> DataFrame:
    """Keys that exactly one declaration and exactly one index row have; others carry the gap's code."""
    a = declared.groupBy(*keys).agg(F.count("*").alias("declared"))
    b = indexed.groupBy(*keys).agg(F.count("*").alias("indexed"))
    both = a.join(b, list(keys), "full").fillna(0, ["declared", "indexed"])
    return both.withColumn("status", F.when((F.col("declared") == 1) & (F.col("indexed") == 1), "bound").otherwise(gap))


def by_precedence(sources: Sequence[DataFrame], key: str, value: str) -> DataFrame:
    """The value of the first source that has the key; sources are given in order of trust."""
    rows = None
    for k, s in enumerate(sources):
        one = s.select(key, value, F.lit(k).alias("precedence"))
        rows = one if rows is None else rows.unionByName(one)
    best = F.min(F.struct("precedence", value)).alias("best")
    return rows.groupBy(key).agg(best, F.count_distinct("precedence").alias("sources")).select(
        key, F.col(f"best.{value}").alias(value), "best.precedence", "sources"
    )


def profiled(rows: DataFrame, profiles: DataFrame, keys: Sequence[str], fields: str) -> DataFrame:
    """Rows whose type, version and field set are an allowed profile; nothing else is accepted."""
    p = profiles.select(*keys, F.array_sort(fields).alias("_fields"), F.lit(True).alias("_known"))
    ok = F.coalesce(F.array_sort(fields).eqNullSafe(F.col("_fields")), F.lit(False))
    status = F.when(F.col("_known").isNull(), "unsupported").when(ok, "supported").otherwise("field_mismatch")
    return rows.join(p, list(keys), "left").withColumn("profile", status).drop("_fields", "_known")


def safe_path(path: Column) -> Column:
    """Relative, without a drive, a parent step or an empty step."""
    bad = path.rlike(r"^[/\\]|^[A-Za-z]:|(^|[/\\])\.\.([/\\]|$)|[/\\]{2}") | (F.length(path) == 0)
    return F.coalesce(~bad, F.lit(False))


def retained(view: DataFrame, artifacts: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """Whether a view covers exactly the artifacts, every field equal: covered, missing, surplus or different."""
    a = artifacts.select(key, F.struct(*fields).alias("a"))
    b = view.select(key, F.struct(*fields).alias("b"))
    status = (
        F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "surplus").when(F.col("a").eqNullSafe(F.col("b")), "covered").otherwise("different")
    )
    return a.join(b, key, "full").select(key, status.alias("status"))


def heads_matched(heads: DataFrame, wells: DataFrame, keys: Sequence[str], fallback: str, well: str) -> DataFrame:
    """Head rows and the one typed well that agrees in all keys, nulls being equal; else the one that has the same value of ``fallback``. Several are
    ambiguous. Both sides are joined on hashes of all keys, so it is one equi-join each."""
    one = F.when(F.min(well) == F.max(well), F.min(well))
    mark = F.xxhash64(*[F.coalesce(F.col(k).cast("string"), F.lit("\u0000")) for k in keys])
    exact = wells.groupBy(mark.alias("_mark"), *keys).agg(one.alias("_exact"), F.count("*").alias("_n"))
    spare = wells.where(F.col(fallback).isNotNull()).groupBy(F.col(fallback).alias("_key")).agg(one.alias("_spare"))
    same = F.col("l._mark") == F.col("r._mark")
    for k in keys:
        same = same & F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}"))
    joined = heads.withColumn("_mark", mark).alias("l").join(exact.alias("r"), same, "left").select("l.*", "_exact", "_n")
    joined = joined.join(spare, F.col(fallback) == F.col("_key"), "left")
    status = (
        F.when(F.col("_exact").isNotNull(), "exact").when(F.col("_n") > 1, "ambiguous").when(F.col("_spare").isNotNull(), "fallback_identity")
        .when(F.col("_key").isNotNull(), "ambiguous").otherwise("unresolved")
    )
    target = F.when(status == "exact", F.col("_exact")).when(status == "fallback_identity", F.col("_spare"))
    return joined.withColumn(well, target).withColumn("status", status).drop("_mark", "_exact", "_n", "_key", "_spare")


def roles_of(files: DataFrame, path: str, digest: str, roles: Column) -> DataFrame:
    """The file that plays each role: a role that several different contents claim is an error, one that none does is missing."""
    claims = files.select(F.explode(roles).alias("role"), path, digest)
    found = claims.groupBy("role").agg(F.count_distinct(digest).alias("contents"), F.min(path).alias("path"), F.min(digest).alias("digest"))
    status = F.when(F.col("contents") == 1, "resolved").otherwise("ambiguous")
    return found.select("role", "contents", status.alias("status"), F.when(status == "resolved", F.col("path")).alias("path"), F.when(status == "resolved", F.col("digest")).alias("digest"))


def bounds_state(*pairs: tuple[Column, Column, Column, Column], tolerance: float = 1e-3) -> Column:
    """How declared bounds (least, most) stand to measured ones (least, most) on all axes: exact, tolerance, enclosing, sign_flipped (equal once the
    declared ones change sign), else conflict; unresolved where a number is missing."""
    exact = close = round_ = flipped = F.lit(True)
    known = F.lit(True)
    for low, high, least, most in pairs:
        known = known & low.isNotNull() & high.isNotNull() & least.isNotNull() & most.isNotNull()
        exact = exact & (low == least) & (high == most)
        close = close & (F.abs(low - least) <= tolerance) & (F.abs(high - most) <= tolerance)
        round_ = round_ & (low <= least + tolerance) & (high >= most - tolerance)
        flipped = flipped & (F.abs(-high - least) <= tolerance) & (F.abs(-low - most) <= tolerance)
    return (
        F.when(~known, "unresolved").when(exact, "exact").when(close, "tolerance").when(round_, "enclosing").when(flipped, "sign_flipped")
        .otherwise("conflict")
    )


def metadata_checked(left: DataFrame, right: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """Pairs of objects that are to be calculated with: fields in which both say something and differ, and fields that one of them does not
    say. Conflicts forbid the calculation, unknown fields are listed."""
    from ..functions.exprs import known

    both = left.select(key, *[F.col(f).alias(f"{f}_l") for f in fields]).join(right.select(key, *[F.col(f).alias(f"{f}_r") for f in fields]), key)
    said = lambda f: known(F.col(f"{f}_l")) & known(F.col(f"{f}_r"))
    conflicts = F.array_compact(F.array(*[F.when(said(f) & (F.col(f"{f}_l") != F.col(f"{f}_r")), f) for f in sorted(fields)]))
    unknown = F.array_compact(F.array(*[F.when(~said(f), f) for f in sorted(fields)]))
    status = F.when(F.size(conflicts) > 0, "conflict").when(F.size(unknown) > 0, "unknown_fields").otherwise("compatible")
    return both.select(key, status.alias("status"), F.array_join(conflicts, ",").alias("conflicts"), F.array_join(unknown, ",").alias("unknown"))
