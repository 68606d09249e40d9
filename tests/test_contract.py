"""How rules are evaluated."""

from pyspark.sql import functions as F

from basinframe.operators import contract as K


def test_rules_are_not_within_a_function_that_takes_a_lambda(spark):
    rules = [("B", F.col("id") > 0), ("A", F.col("id") > 1), ("C", F.lit(None).cast("boolean")), ("B", F.col("id") > 1)]
    frame = spark.range(3).select(K._codes(rules).alias("codes"))
    assert [r.codes for r in frame.orderBy(F.size("codes")).collect()] == [[], ["B"], ["A", "B"]]
    assert "lambda" not in frame._jdf.queryExecution().optimizedPlan().toString()
