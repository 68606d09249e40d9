"""Issues, retries, stages and other event analytics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.exprs import exact_sum
from .scan import ranged


def issue_groups(issues: DataFrame, signature: str, case: str, recovered: Column, examples: int = 3) -> DataFrame:
    """Occurrences, cases, recovered and open counts, and the first cases as examples. Cases are counted before they are
    listed, and only the first few are kept while listing."""
    per_case = issues.groupBy(signature, case).agg(F.count("*").alias("n"), F.count_if(recovered).alias("recovered"))
    rank = F.row_number().over(Window.partitionBy(signature).orderBy(case))
    return (
        per_case.withColumn("rank", rank)
        .groupBy(signature)
        .agg(
            F.sum("n").alias("occurrences"),
            F.count("*").alias("cases"),
            F.sum("recovered").alias("recovered"),
            (F.sum("n") - F.sum("recovered")).alias("open"),
            F.array_join(F.array_sort(F.collect_list(F.when(F.col("rank") <= examples, F.col(case)))), ",").alias("examples"),
        )
    )


def intervals(events: DataFrame, scope: Sequence[str], order: Sequence[str], clock: str) -> DataFrame:
    """Time to the next event of the scope; null for the last."""
    w = Window.partitionBy(*scope).orderBy(*order)
    return events.withColumn("interval", F.lead(clock).over(w) - F.col(clock))


def retry_pairs(attempts: DataFrame, identity: Sequence[str], order: Sequence[str], failed: Column) -> DataFrame:
    """Runs of failures and what ended them: attempts of each run, and ``recovered`` if a success followed, else ``open``."""
    w = Window.partitionBy(*identity).orderBy(*order)
    marked = attempts.withColumn("failed", failed)
    # a run ends with the success that follows its failures
    ends = F.coalesce(F.sum(F.when(F.col("failed"), 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    found = marked.withColumn("run", ends).groupBy(*identity, "run").agg(F.count_if("failed").alias("failures"), F.bool_and("failed").alias("open"))
    status = F.when(F.col("open"), "open").otherwise("recovered")
    return found.where("failures > 0").select(*identity, "run", "failures", status.alias("status"))


def counter_peaks(samples: DataFrame, scope: str, process: Sequence[str], sample: str, counter: str, gauge: str) -> DataFrame:
    """Counters only grow: the maximum of each process, summed. Gauges: the sum of each sample, its maximum."""
    grown = samples.groupBy(scope, *process).agg(F.max(counter).alias("m")).groupBy(scope).agg(exact_sum(F.col("m")).alias("total"))
    peak = samples.groupBy(scope, sample).agg(exact_sum(F.col(gauge)).alias("s")).groupBy(scope).agg(F.max("s").alias("peak"))
    return grown.join(peak, scope)


def top_with_rest(rows: DataFrame, keys: Sequence[str], value: str, k: int) -> DataFrame:
    """The k most frequent values of each key and how many rows the others have."""
    counts = rows.groupBy(*keys, value).agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n"), value))
    ranked = counts.withColumn("rank", rank)
    rest = ranked.where(F.col("rank") > k).groupBy(*keys).agg(F.sum("n").alias("omitted"))
    return ranked.where(F.col("rank") <= k).join(rest, list(keys), "left").withColumn("omitted", F.coalesce("omitted", F.lit(0)))


def running_budget(attempts: DataFrame, lane: Sequence[str], order: Sequence[str], cost: str, budget: float) -> DataFrame:
    """Cost used before each attempt, what is left, and whether it may run."""
    dealt = ranged(attempts, lane, order)
    summed = dealt.running({"used": F.col(cost).cast("decimal(18,6)")}, inclusive=False)
    out = dealt.undealt(summed.withColumn("used", F.col("used").cast("double")))
    return out.withColumn("remaining", F.greatest(F.lit(0.0), F.round(budget - F.col("used"), 4))).withColumn("runs", F.col("remaining") > 0)


def merged_order(parts: Sequence[DataFrame], sequence: str, *ties: str) -> DataFrame:
    """Several ordered event files as one, rows without a sequence last."""
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p, allowMissingColumns=True)
    return rows.orderBy(F.asc_nulls_last(sequence), *ties)
