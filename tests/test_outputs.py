from cuefold.streaming import progress

ROWS = [
    ("finished", "b", "2024-01-03T00:00:00.000Z", "j"), ("finished", "a", "2024-01-02T00:00:00.000Z", "j"), ("finished", "b", "2024-01-01T00:00:00.000Z", "j"),
    ("started", "x", "2023-01-01T00:00:00.000Z", "j"), ("failed", "y", "2023-01-01T00:00:00.000Z", "j"), ("finished", None, "2024-01-01T00:00:00.000Z", "j"),
    ("finished", "", "2024-01-01T00:00:00.000Z", "j"), ("finished", "z", None, "j"), ("finished", "b", "2024-01-05T00:00:00.000Z", "k"), ("finished", "n", "2024-01-05T00:00:00.000Z", None),
]


def events(spark):
    df = spark.createDataFrame(ROWS, "type string, output string, timestamp string, job string")
    return df.withColumn("timestamp", df.timestamp.cast("timestamp"))


def test_outputs_are_distinct_and_in_order_of_first_finish(spark):
    got = {(r.job, r.position): r.output for r in progress.in_order(progress.job_outputs(events(spark))).collect()}
    assert got == {("j", 1): "b", ("j", 2): "a", ("j", 3): "z", ("k", 1): "b", (None, 1): "n"}


def test_outputs_are_exact(spark):
    """An estimated count is off for a job of many outputs."""
    df = spark.range(20_000).selectExpr("'finished' type", "'j' job", "cast(id % 10000 as string) output", "timestamp_seconds(id * 60) timestamp")
    rows = progress.in_order(progress.job_outputs(df)).orderBy("position").collect()
    assert [(r.position, r.output) for r in rows] == [(k + 1, str(k)) for k in range(10_000)]
    assert "outputs" not in progress.job_progress(df.selectExpr("*", "1.0D duration_ms")).columns
