"""Progress of jobs from a stream of JSON lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuefold.operators.blocked import numbered

EVENT = "type string, timestamp string, job string, input string, output string, duration_ms double"


def format_event(kind: Column, timestamp: Column, **fields: Column) -> Column:
    """One event as a JSON line."""
    iso = F.date_format(timestamp, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")
    return F.to_json(F.struct(kind.alias("type"), iso.alias("timestamp"), *[c.alias(n) for n, c in fields.items()]))


def sse_frame(line: Column) -> Column:
    """The event as a frame of a server-sent stream."""
    return F.concat(F.lit("event: "), F.get_json_object(line, "$.type"), F.lit("\ndata: "), line, F.lit("\n\n"))


def parse_frames(frames: DataFrame, value: str = "value") -> DataFrame:
    """Events of server-sent frames, parted by blank lines; the event name of a frame overrides the type of its data.

    Data that are no JSON leave an event of its name alone; frames with neither name nor type are
    left out.  A frame must not be spread over rows: read a stream with ``lineSep`` of a blank line.
    """
    part = lambda name: F.nullif(F.regexp_extract("f", rf"(?m)^{name}:\s*(.+)$", 1), F.lit(""))
    rows = frames.select(F.explode(F.split(F.col(value), "\n\n")).alias("f")).select(part("event").alias("name"), part("data").alias("data"))
    e = F.when(F.try_parse_json("data").isNotNull(), F.from_json("data", EVENT))
    rows = rows.select("name", e.alias("e")).select(F.coalesce("name", "e.type").alias("type"), *[F.col(f"e.{c}") for c in ("timestamp", "job", "input", "output", "duration_ms")])
    return rows.where("type is not null").withColumn("timestamp", F.to_timestamp("timestamp"))


def parse_events(lines: DataFrame, value: str = "value") -> DataFrame:
    """Events of lines that are JSON with a type; other lines are left out."""
    e = F.from_json(F.trim(F.col(value)), EVENT)
    return lines.select(e.alias("e")).where("e.type is not null").select("e.*").withColumn("timestamp", F.to_timestamp("timestamp"))


def job_progress(events: DataFrame) -> DataFrame:
    """Per job: how many started, finished and failed, and whether it ever failed.

    Works on a stream (update or complete mode) and on a batch alike.  The outputs are
    rows of :func:`job_outputs`.
    """
    kind = F.col("type")
    return events.groupBy("job").agg(
        F.count_if(kind == "started").alias("started"), F.count_if(kind == "finished").alias("finished"), F.count_if(kind == "failed").alias("failed"),
        F.max(kind == "failed").alias("has_failed"), F.max("timestamp").alias("last_event"), F.sum("duration_ms").alias("duration_ms"),
    )


def job_outputs(events: DataFrame) -> DataFrame:
    """``job, output, first_finished``: each distinct non-empty output of a job's finished events.

    Exact; works on a stream (update or complete mode) and on a batch alike.  Rows, as a job
    may have any number of outputs.
    """
    done = events.where("type = 'finished' and output <> ''")
    return done.groupBy("job", "output").agg(F.min("timestamp").alias("first_finished"))


def in_order(outputs: DataFrame) -> DataFrame:
    """Rows of :func:`job_outputs` (a batch) with ``position``, from 1, in order of first finish.

    Outputs of the same instant follow by name; those without a time come last.
    """
    last = F.lit(2**62)
    rows = outputs.withColumn("_at", F.coalesce(F.unix_micros("first_finished"), last)).withColumn(
        "_job", F.coalesce(F.concat(F.lit("="), "job"), F.lit(""))
    )
    day = F.floor(F.col("_at") / 86_400_000_000)
    return numbered(rows, ["_job"], day, ["_at", "output"], "position").drop("_at", "_job")


def eta_ms(done: Column, total: Column, elapsed_ms: Column) -> Column:
    """Remaining time at the throughput so far, null before the first result."""
    return F.when(done > 0, F.floor(elapsed_ms / done * (total - done) + 0.5))
