"""Regular lattices and seismic arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import finite, rotated


def coordinates(nodes: DataFrame, origin: tuple[float, float], step: tuple[float, float], degrees: float, places: int = 6) -> DataFrame:
    x, y = rotated(*[F.lit(float(v)) for v in (*origin, *step)], F.col("i"), F.col("j"), degrees)
    return nodes.withColumn("x", F.round(x, places)).withColumn("y", F.round(y, places))


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """a - b on equal (i, j); undefined on either side is undefined. Nodes of one side only are absent."""
    left = a.select("i", "j", F.when(F.col("defined"), F.col("raw")).alias("a"))
    right = b.select("i", "j", F.when(F.col("defined"), F.col("raw")).alias("b"))
    return left.join(right, ["i", "j"]).select("i", "j", (F.col("a") - F.col("b")).alias("difference"))


def cells(nodes: DataFrame) -> DataFrame:
    """A cell for each four corners: its mean and whether all are defined. Corners meet by one aggregation, no self-join."""
    shift = F.array(*[F.struct((F.col("i") - di).alias("i"), (F.col("j") - dj).alias("j")) for di in (0, 1) for dj in (0, 1)])
    corners = nodes.select(F.explode(shift).alias("cell"), "raw", "defined").select("cell.i", "cell.j", "raw", "defined")
    grouped = corners.groupBy("i", "j").agg(
        F.count("*").alias("corners"), F.bool_and("defined").alias("valid"), F.avg(F.when(F.col("defined"), F.col("raw"))).alias("mean")
    )
    return grouped.where("corners = 4").select("i", "j", "valid", F.when(F.col("valid"), F.round("mean", 6)).alias("mean"))


def same_descriptor(children: DataFrame, parents: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Whether a property's lattice is its parent's: parent absent, equal or different."""
    p = parents.select(F.col(key).alias("parent_key"), F.struct(*fields).alias("of_parent"))
    status = (
        F.when(F.col("of_parent").isNull(), "parent_missing")
        .when(F.struct(*fields).eqNullSafe(F.col("of_parent")), "same_lattice")
        .otherwise("different_lattice")
    )
    return children.join(p, children[key] == p["parent_key"], "left").select(*children.columns, status.alias("status"))


def amplitude_mask(samples: Column, low: float, high: float) -> Column:
    """Samples strictly inside the interval, others null; NaN is outside."""
    return F.transform(samples, lambda v: F.when((v > low) & (v < high) & finite(v), v))


def trace_headers(traces: DataFrame, crosslines: int, origin: tuple[float, float], inline_step: tuple[float, float], crossline_step: tuple[float, float]) -> DataFrame:
    """Inline, crossline and affine coordinates from the trace number."""
    i, j = F.floor(F.col("trace") / crosslines), F.col("trace") % crosslines
    return traces.select(
        "trace", i.alias("line"), j.alias("crossline"),
        (F.lit(origin[0]) + i * inline_step[0] + j * crossline_step[0]).alias("x"),
        (F.lit(origin[1]) + i * inline_step[1] + j * crossline_step[1]).alias("y"),
    )


def affine_closure(corners: DataFrame, tolerance: float = 1e-3) -> DataFrame:
    """Whether the fourth corner of a cube is what the other three make it."""
    dx = F.col("x1") + F.col("x2") - F.col("x0") - F.col("x3")
    dy = F.col("y1") + F.col("y2") - F.col("y0") - F.col("y3")
    det = (F.col("x1") - F.col("x0")) * (F.col("y2") - F.col("y0")) - (F.col("x2") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    return corners.withColumn("closed", (F.abs(dx) <= tolerance) & (F.abs(dy) <= tolerance)).withColumn("degenerate", det == 0)
