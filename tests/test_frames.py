from pyspark.sql import functions as F

from cuefold.streaming import progress


def test_frames_are_parsed_and_their_name_overrides_the_type(spark):
    frames = [
        'event: bridge-error\ndata: {"type":"finished","job":"a"}', 'data: {"type":"started","job":"b"}', "event: complete", "event: failed\ndata: {no json",
        "data: {no json", ": ping", 'data: {"job":"c"}',
    ]
    df = spark.createDataFrame([("\n\n".join(frames) + "\n\n",), (None,)], "value string")
    got = [(r.type, r.job) for r in progress.parse_frames(df).collect()]
    assert got == [("bridge-error", "a"), ("started", "b"), ("complete", None), ("failed", None)]


def test_frame_and_back(spark):
    line = '{"type":"finished","timestamp":"2025-01-01T00:00:00.000Z","job":"a","output":"o","duration_ms":5.0}'
    df = spark.createDataFrame([(line,)], "value string")
    framed = df.select(progress.sse_frame(F.col("value")).alias("value"))
    assert framed.first().value == f"event: finished\ndata: {line}\n\n"
    assert progress.parse_frames(framed).collect() == progress.parse_events(df).collect()
