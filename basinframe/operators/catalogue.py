"""Evidence, rules and order in a catalogue of entities."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.exprs import known
from ..sources.scratch import settle


def resolved(observations: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """recorded if all known values agree, conflict if they differ, unresolved if none is known. Values are made distinct, then counted: no list of
    them is built, so a field may have any number."""
    one = observations.groupBy(*keys, value).agg(F.count("*").alias("n"))
    usable = F.when(known(F.col(value)), F.col(value))
    grouped = one.groupBy(*keys).agg(F.sum("n").alias("observations"), F.count(usable).alias("values"), F.min(usable).alias("least"))
    status = F.when(F.col("values") == 0, "unresolved").when(F.col("values") == 1, "recorded").otherwise("conflict")
    only = F.when(F.col("values") == 1, F.col("least"))
    return grouped.select(*keys, "observations", status.alias("status"), only.alias("value"), F.col("values").cast("int").alias("alternatives"))


def long_evidence(rows: DataFrame, entity: str, fields: Sequence[str]) -> DataFrame:
    """One row for each field that is not null."""
    return rows.unpivot(entity, list(fields), "field", "value").where("value is not null")


def blockers(rules: Sequence[tuple[str, DataFrame]], entity: str) -> DataFrame:
    """(code, entities it blocks) to the codes of each blocked entity."""
    rows = None
    for code, found in rules:
        one = found.select(entity, F.lit(code).alias("code"))
        rows = one if rows is None else rows.unionByName(one)
    return rows.groupBy(entity).agg(F.array_join(F.array_sort(F.collect_set("code")), ",").alias("codes"), F.count_distinct("code").alias("n_codes"))


def availability(artifacts: DataFrame, listing: DataFrame, key: str, size: str) -> DataFrame:
    there = listing.select(key, F.col(size).alias("found"))
    status = (
        F.when(F.col("found").isNull(), "missing").when(F.col("found") != F.col(size), "size_mismatch").otherwise("available")
    )
    return artifacts.join(there, key, "left").select(key, status.alias("status"))


#: What an edge of ``contracted`` leads to: a node, the end of all needs, or a failure.
OPEN, END, BAD = 0, 1, 2


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("node", "to", "sink", "w").cast("decimal(20,0)"))).first())


def contracted(edges: DataFrame, node: str, needs: str, failing: DataFrame | None = None) -> DataFrame:
    """(node, level): the longest chain of needs below each node, 0 for those that need nothing; null for nodes on or behind a cycle, of a need that does not exist, or on or behind one of the
    ``failing`` nodes.

    Every edge has a length. A round takes each edge that leads to a node with one edge over that edge's end, so chains halve, and of edges with one end it keeps the longest; what
    meets a failure fails. A chain of n nodes takes log2(n) rounds; only levels at which nodes keep several open needs take a round each. A cycle either meets itself, outgrows the number
    of nodes, or stays when nothing moves any more. Joins are merges: a broadcast in each round sends the driver the nodes many times over."""
    own = edges.select(F.col(node).alias("node"), F.col(needs).alias("to")).distinct()
    nodes = own.select("node").distinct()
    there = nodes.select(F.col("node").alias("to"), F.lit(True).alias("there"))
    linked = own.where("to is not null").join(there.hint("merge"), "to", "left")
    sink = F.when(F.col("there").isNull() | (F.col("to") == F.col("node")), BAD).otherwise(OPEN)
    linked = linked.select("node", F.when(sink == OPEN, F.col("to")).alias("to"), sink.alias("sink"), F.lit(1).cast("long").alias("w"))
    none = F.lit(None).cast(own.schema["to"].dataType)
    leaves = nodes.join(linked.select("node").distinct().hint("merge"), "node", "left_anti")
    now = linked.unionByName(leaves.select("node", none.alias("to"), F.lit(END).alias("sink"), F.lit(0).cast("long").alias("w")))
    if failing is not None:
        bad = failing.select(F.col(node).alias("node")).distinct().hint("merge")
        now = now.join(bad, "node", "left_anti").unionByName(
            nodes.join(bad, "node", "left_semi").select("node", none.alias("to"), F.lit(BAD).alias("sink"), F.lit(0).cast("long").alias("w"))
        )
    now, most = settle(now, "edges"), nodes.count()
    mark = _mark(now)
    while now.where(F.col("sink") == OPEN).limit(1).count():
        one = now.groupBy("node").agg(F.count("*").alias("n"), F.max(F.struct("sink", "to", "w")).alias("e"), F.max("sink").alias("worst"))
        one = one.where((F.col("n") == 1) | (F.col("worst") == BAD)).select(F.col("node").alias("via"), "e")
        met = now.join(one.hint("merge"), now["to"] == one["via"], "left")
        # an end that failed fails whatever leads to it, whichever its longest edge
        sink = F.when(F.col("via").isNull(), F.col("sink")).otherwise(F.col("e.sink"))
        length = F.col("w") + F.coalesce("e.w", F.lit(0))
        met = met.select("node", F.when(F.col("via").isNull(), F.col("to")).otherwise(F.col("e.to")).alias("to"), sink.alias("sink"), length.alias("w"))
        lost = (F.col("sink") == BAD) | (F.col("to") == F.col("node")) | (F.col("w") > most)
        met = met.withColumn("sink", F.when(F.coalesce(lost, F.lit(False)), BAD).otherwise(F.col("sink")))
        to = F.when(F.col("sink") == OPEN, F.col("to"))
        now = settle(met.withColumn("to", to).groupBy("node", "to", "sink").agg(F.max("w").alias("w")), "edges")
        was, mark = mark, _mark(now)
        if was == mark:
            break
    state = now.groupBy("node").agg(F.min("sink").alias("low"), F.max("sink").alias("high"), F.max("w").alias("w"))
    whole = (F.col("low") == END) & (F.col("high") == END)
    return state.select(F.col("node").alias(node), F.when(whole, F.col("w")).cast("int").alias("level"))


def levels(edges: DataFrame, node: str, needs: str) -> DataFrame:
    """Dependency levels: 0 for nodes that need nothing, else one more than the highest need. Nodes on or behind a cycle, or of a
    need that does not exist, have null."""
    return contracted(edges, node, needs)


def ancestry(edges: DataFrame, child: str, parent: str) -> DataFrame:
    """Path from the root, depth, and a status: ``rooted``, ``dangling`` (a parent that is no node) or ``cycle``. A round is one join of the walks that go on, so there are as many as
    the deepest path is long; finished walks are written apart."""
    step = edges.select(F.col(child).alias("at"), F.col(parent).alias("up"))
    open_ = edges.select(F.col(child).alias("node"), F.col(child).alias("at"), F.col(child).cast("string").alias("path"), F.lit(0).alias("depth"))
    done = None
    for k in count(1):
        met = settle(
            open_.join(step.withColumn("there", F.lit(True)), "at", "left").withColumn(
                "status",
                F.when(F.col("there").isNull(), "dangling")
                .when(F.col("up").isNull(), "rooted")
                .when(F.array_contains(F.split("path", "/"), F.col("up").cast("string")), "cycle"),
            ),
            "walks",
        )
        ended = met.where("status is not null").select("node", "path", "depth", "status")
        done = ended if done is None else done.unionByName(ended)
        if k % 16 == 0:  # a deep graph's plan stays short
            done = settle(done, "done")
        open_ = met.where("status is null").select(
            "node", F.col("up").alias("at"), F.concat_ws("/", F.col("up").cast("string"), "path").alias("path"), (F.col("depth") + 1).alias("depth")
        )
        if open_.isEmpty():
            return done


def coverage(rows: DataFrame, dimensions: Sequence[str], measures: Sequence[Column], how: str = "groupBy") -> DataFrame:
    """Counts by dimensions; with ``rollup`` or ``cube`` margins have null dimensions and a grouping number."""
    if how == "groupBy":
        return rows.groupBy(*dimensions).agg(*measures)
    return getattr(rows, how)(*dimensions).agg(F.grouping_id().cast("int").alias("grouping"), *measures)


def chosen_wave(candidates: DataFrame, budget: int, weights: DataFrame | None = None) -> DataFrame:
    """Greedy cover: the candidates that add most uncovered weight, one of each group, within a byte budget; ties go to the
    smaller and then the lower id. Columns: id, group, bytes, features (array); ``weights`` (feature, weight) has the weight of a feature, else
    one. A turn is one aggregation over what is still open, and only the candidate chosen comes to the driver, so the number of
    candidates is not bounded; there are as many turns as are chosen. Candidates without a null in id, bytes or features count."""
    own = candidates.select("id", "group", "bytes", F.explode(F.array_distinct("features")).alias("feature")).dropna(subset=["id", "bytes", "feature"])
    own = own.join(weights, "feature", "left") if weights is not None else own.withColumn("weight", F.lit(None))
    open_ = settle(own.withColumn("weight", F.coalesce(F.col("weight").cast("double"), F.lit(1.0))), "open")
    left, out, covered = budget, [], None
    while True:
        gains = open_.where(F.col("bytes") <= left).groupBy("id", "group", "bytes").agg(F.sum("weight").alias("gained")).where("gained > 0")
        best = gains.agg(F.min_by(F.struct("id", "group", "bytes", "gained"), F.struct(-F.col("gained"), "bytes", "id")).alias("best")).first()["best"]
        if best is None:
            break
        out.append((len(out), best["id"], best["gained"], best["bytes"]))
        left -= best["bytes"]
        covered = open_.where(F.col("id") == F.lit(best["id"])).select("feature").distinct()
        rest = open_.where(~F.col("group").eqNullSafe(F.lit(best["group"])) & (F.col("bytes") <= left))
        open_ = settle(rest.join(covered, "feature", "left_anti").select(*open_.columns), "open")
    kinds = dict(candidates.dtypes)
    schema = f"turn int, id {kinds['id']}, gained double, bytes {kinds['bytes']}"
    return candidates.sparkSession.createDataFrame(out, schema)
