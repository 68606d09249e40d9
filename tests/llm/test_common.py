from basinframe.llm import common


def test_batch_bound_keeps_smaller_ones(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    was = spark.conf.get(name)
    try:
        for given, want in (("64m", str(common.BATCH_BYTES)), ("1m", "1m"), ("100b", "100b"), ("67108864", str(common.BATCH_BYTES)), ("1gb", str(common.BATCH_BYTES))):
            spark.conf.set(name, given)
            common.bounded(spark)
            assert spark.conf.get(name) == want
    finally:
        spark.conf.set(name, was)


def test_unused_names_ignore_case(spark):
    df = spark.createDataFrame([(1, 2)], "Match int, _match int")
    assert common.unused(df, "match", "other") == ["__match", "other"]


def test_settled_tables_keep_rows_and_schema(spark):
    df = spark.createDataFrame([(1, None), (None, "x")], "a long, b string")
    back = common.settle(df, "t")
    assert back.schema == df.schema and sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, df.collect()), key=str)
    assert common.settle(df.limit(0), "t").collect() == []
