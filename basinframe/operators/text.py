"""Scans of text for registry entries, identifiers and layout."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def pattern_scan(texts: DataFrame, text_id: str, text: str, pattern: str, group: int = 0) -> DataFrame:
    """Each distinct match of a text: occurrences and the character offset of the first. Matches are sorted and counted as runs where
    the text is, so only they leave it and nothing is shuffled."""
    found = F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(group))
    run_starts = F.filter(F.sequence(F.lit(0), F.size("all")), lambda k: (k == 0) | ~F.get("all", k).eqNullSafe(F.get("all", k - 1)))
    counted = F.transform(
        "starts",
        lambda s, k: F.struct(
            F.get("all", s).alias("found"), (F.coalesce(F.get("starts", k + 1), F.size("all")) - s).cast("long").alias("occurrences"),
            F.position(F.get("all", s), F.col(text)).alias("first"),
        ),
    )
    ordered = texts.select(text_id, text, F.array_sort(found).alias("all")).where(F.size("all") > 0)
    return ordered.withColumn("starts", F.filter(run_starts, lambda k: k < F.size("all"))).select(text_id, F.inline(counted))


def profile(texts: DataFrame, text_id: str, text: str, lines: int = 50) -> DataFrame:
    """Lines, blank lines, and the delimiter that most of the first non-blank lines have."""
    every = F.split(F.col(text), "\n")
    filled = F.slice(F.filter(every, lambda x: F.length(F.trim(x)) > 0), 1, lines)
    votes = [
        F.struct(F.size(F.filter(filled, _has(d))).alias("n"), F.lit(-k).alias("first"), F.lit(name).alias("name"))
        for k, (name, d) in enumerate((("comma", ","), ("semicolon", ";"), ("tab", "\t"), ("space", " ")))
    ]
    best = F.array_max(F.array(*votes))
    return texts.select(
        text_id,
        F.size(every).alias("lines"),
        F.size(F.filter(every, lambda x: F.length(F.trim(x)) == 0)).alias("blank"),
        F.when(best["n"] > 0, best["name"]).otherwise("none").alias("delimiter"),
    )


def _has(delimiter: str):
    return lambda x: x.contains(delimiter)


def property_pairs(texts: DataFrame, text_id: str, text: str) -> DataFrame:
    """Files of alternating key and value lines, after an optional line that counts them, as rows."""
    every = F.split(F.col(text), "\n")
    body = F.when(F.element_at(every, 1).rlike(r"^\s*[0-9]+\s*$"), F.slice(every, F.lit(2), F.size(every))).otherwise(every)
    pairs = F.transform(
        F.sequence(F.lit(0), F.floor(F.size("body") / 2).cast("int") - 1),
        lambda k: F.struct(F.trim(F.get("body", 2 * k)).alias("key"), F.trim(F.get("body", 2 * k + 1)).alias("value")),
    )
    split = texts.select(text_id, body.alias("body")).where("size(body) >= 2")
    return split.select(text_id, F.explode(pairs).alias("pair")).select(text_id, "pair.key", "pair.value")


def located_matches(texts: DataFrame, text_id: str, text: str, pattern: str, window: int = 40) -> DataFrame:
    """Each match of a text: its number, its character offset from 0, and what stands before and after it, up to ``window`` characters
    but not beyond the neighbouring match."""
    matches, between = F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0)), F.split(F.col(text), pattern, -1)
    cut = texts.select(text_id, matches.alias("matches"), between.alias("between")).where(F.size("matches") > 0)
    after = F.slice("between", F.lit(2), F.size("matches"))
    rows = cut.select(text_id, F.posexplode(F.arrays_zip(F.col("matches").alias("match"), F.slice("between", F.lit(1), F.size("matches")).alias("ahead"), after.alias("behind"))).alias("k", "z"))
    upto = Window.partitionBy(text_id).orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    ends = F.sum(F.char_length("z.ahead") + F.char_length("z.match")).over(upto)
    return rows.select(
        text_id, "k", (ends - F.char_length("z.match")).cast("long").alias("offset"), F.col("z.match").alias("match"),
        F.right("z.ahead", F.lit(window)).alias("before"), F.left("z.behind", F.lit(window)).alias("after"),
    )


def registry_entries(located: DataFrame, text_id: str, pattern: str, groups: dict[str, int], most: int) -> DataFrame:
    """Distinct entries of ``located_matches``, told apart by the pattern's groups: occurrences, first offset and what stands round it; of
    each text the ``most`` that come first."""
    named = located.select("*", *[F.regexp_extract("match", pattern, g).alias(n) for n, g in groups.items()])
    round_it = F.concat("before", "match", "after")
    found = named.groupBy(text_id, *groups).agg(F.count("*").alias("occurrences"), F.min("offset").alias("first"), F.min_by(round_it, "offset").alias("context"))
    order = Window.partitionBy(text_id).orderBy("first", *groups)
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most).drop("rank")
