"""Ordered work over groups of any size: running sums, previous rows, numbers and carried values without a task that holds a group.

A plain window sorts all rows of a group in one task. Here rows are first dealt into ranges of (keys, order), so that a large group fills many
ranges and small groups share one. Each range gives a summary for each group it touches, the few summaries of a group are scanned in the order
of the ranges, and what they carry is joined to the rows of the next range. A group has as many summaries as there are ranges at most.

``ranged`` writes the dealt table, so the sample that sets the bounds is taken once and every later step sees the same ranges. Equal rows, which any order
fits, are spread by a salt. Null keys are a group of their own, null order values come last. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import settle

RANGE, SALT = "range_no", "range_salt"


@dataclass(frozen=True)
class Ranges:
    """Rows dealt into ranges, with columns ``range_no`` and ``range_salt``."""

    rows: DataFrame
    keys: tuple[str, ...]
    order: tuple[str, ...]

    @property
    def _by(self) -> list[Column]:
        return [*(F.asc_nulls_last(c) for c in self.order), F.asc(SALT)]

    def within(self) -> Window:
        """A window over the rows of one group in one range."""
        return Window.partitionBy(RANGE, *self.keys).orderBy(*self._by)

    def _between(self):
        return Window.partitionBy(*self.keys).orderBy(RANGE)

    def _joined(self, carried: DataFrame, names: Sequence[str]) -> DataFrame:
        side = carried.select(*(F.col(k).alias(f"carry_{k}") for k in (*self.keys, RANGE)), *names)
        met = F.lit(True)
        for k in (*self.keys, RANGE):
            met = met & self.rows[k].eqNullSafe(side[f"carry_{k}"])
        return self.rows.join(side, met, "left").drop(*(f"carry_{k}" for k in (*self.keys, RANGE)))

    def numbered(self, name: str) -> DataFrame:
        """The rows with their place in the group, from 0."""
        return self.running({name: F.lit(1)}, inclusive=False)

    def running(self, values: dict[str, Column], inclusive: bool = True, by=F.sum) -> DataFrame:
        """The rows with sums (``by``: or greatest values, ``F.max``) over all rows of the group up to this one, or before it. Sums before the first row are 0,
        greatest values null."""
        summed = by is F.sum
        ends = self.rows.groupBy(*self.keys, RANGE).agg(*(by(e).alias(f"before_{n}") for n, e in values.items()))
        past = self._between().rowsBetween(Window.unboundedPreceding, -1)
        carried = ends.select(*self.keys, RANGE, *(by(f"before_{n}").over(past).alias(f"before_{n}") for n in values))
        to = self.within().rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
        out = self._joined(carried, [f"before_{n}" for n in values])
        for n, e in values.items():
            own, before = by(e).over(to), F.col(f"before_{n}")
            both = own + before if summed else F.greatest(own, before)
            out = out.withColumn(n, F.when(own.isNull(), before).when(before.isNull(), own).otherwise(both))
            if summed and not inclusive:
                out = out.withColumn(n, F.coalesce(n, F.lit(0)))
        return out.drop(*(f"before_{n}" for n in values))

    def previous(self, values: dict[str, Column], present: Column | None = None) -> DataFrame:
        """The rows with values of the row before in the group (null for the first). With ``present``, of the last row before or at this one for
        which it holds."""
        one = F.struct(*(e.alias(n) for n, e in values.items()))
        held = one if present is None else F.when(present, one)
        at = F.struct(*(x for c in self.order for x in (F.col(c).isNull().alias(f"{c}_null"), F.col(c))), SALT)
        last = F.max_by(held, at) if present is None else F.max_by(held, F.when(present, at))
        ends = self.rows.groupBy(*self.keys, RANGE).agg(last.alias("carried"))
        past = self._between().rowsBetween(Window.unboundedPreceding, -1)
        carried = ends.select(*self.keys, RANGE, F.last("carried", ignorenulls=True).over(past).alias("carried"))
        out = self._joined(carried, ["carried"])
        if present is None:
            own = F.lag(one).over(self.within())
        else:
            own = F.last(held, ignorenulls=True).over(self.within().rowsBetween(Window.unboundedPreceding, 0))
        out = out.withColumn("carried", F.coalesce(own, F.col("carried")))
        return out.select(*self.rows.columns, *(F.col(f"carried.{n}").alias(n) for n in values))

    def following(self, values: dict[str, Column], present: Column | None = None) -> DataFrame:
        """The rows with values of the row after in the group, null for the last. With ``present``, of the first row after or at this one for
        which it holds."""
        one = F.struct(*(e.alias(n) for n, e in values.items()))
        held = one if present is None else F.when(present, one)
        at = F.struct(*(x for c in self.order for x in (F.col(c).isNull().alias(f"{c}_null"), F.col(c))), SALT)
        first = F.min_by(held, at) if present is None else F.min_by(held, F.when(present, at))
        ends = self.rows.groupBy(*self.keys, RANGE).agg(first.alias("carried"))
        # backwards: a frame that ends with the group is summed anew for each row
        back = Window.partitionBy(*self.keys).orderBy(F.desc(RANGE)).rowsBetween(Window.unboundedPreceding, -1)
        carried = ends.select(*self.keys, RANGE, F.last("carried", ignorenulls=True).over(back).alias("carried"))
        out = self._joined(carried, ["carried"])
        backwards = Window.partitionBy(RANGE, *self.keys).orderBy(*(F.desc_nulls_first(c) for c in self.order), F.desc(SALT))
        if present is None:
            own = F.lag(one).over(backwards)
        else:
            own = F.last(held, ignorenulls=True).over(backwards.rowsBetween(Window.unboundedPreceding, 0))
        out = out.withColumn("carried", F.coalesce(own, F.col("carried")))
        return out.select(*self.rows.columns, *(F.col(f"carried.{n}").alias(n) for n in values))

    def of(self, rows: DataFrame) -> Ranges:
        """The same ranges over these rows with further columns."""
        return Ranges(rows, self.keys, self.order)

    def undealt(self, rows: DataFrame) -> DataFrame:
        return rows.drop(RANGE, SALT)


def ranged(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> Ranges:
    """Deal ``rows`` into ranges of (keys, order): one shuffle by range, written once. Carry only columns that are needed."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by = [*(F.asc_nulls_last(c) for c in (*keys, *order)), F.asc(SALT)]
    spread = rows.withColumn(SALT, F.monotonically_increasing_id()).repartitionByRange(n, *by)
    return Ranges(settle(spread.withColumn(RANGE, F.spark_partition_id()), "ranges"), tuple(keys), tuple(order))
