"""Listings, metadata and reports around a comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

METADATA = "map<string,map<string,struct<status:string,knownReferenceGaps:array<struct<start:double,end:double>>,notes:array<string>>>>"


def find_files(spark, path: str, extension: str) -> DataFrame:
    """``path, length`` of the files of a folder by extension, whatever its case; no contents are read."""
    ext = "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in extension)
    return spark.read.format("binaryFile").option("pathGlobFilter", f"*.{ext}").load(path).select("path", "length")


def fixture_metadata(json: Column, group: Column, name: Column) -> Column:
    """What the metadata declares for a fixture in its own group; no other group is looked at."""
    folder = F.regexp_extract(F.replace(group, F.lit("\\"), F.lit("/")), r"([^/]*)/*\z", 1)
    return F.try_element_at(F.try_element_at(F.from_json(json, METADATA), folder), name)


def pair_listing(streams: DataFrame, references: DataFrame, candidates: DataFrame) -> DataFrame:
    """Streams with their reference and candidate files; ``complete`` tells whether both are there.

    All inputs have ``name``; the reference of ``x.sup`` is ``x-eng.srt``, its candidate the same
    or ``x.srt``.
    """
    s = streams.select("name", F.regexp_replace("name", r"(?i)\.(sup|idx)\z", "").alias("base")).distinct()
    ref = references.select(F.col("name").alias("reference"), F.regexp_extract("name", r"\A(.*)-eng\.srt\z", 1).alias("base")).where("base <> ''").distinct()
    cand = candidates.select(F.col("name").alias("c"), F.regexp_extract("name", r"\A(.*?)(-eng)?\.srt\z", 1).alias("base"), F.col("name").endswith("-eng.srt").alias("lang")).where("base <> ''")
    best = cand.groupBy("base").agg(F.max_by("c", "lang").alias("candidate"))
    out = s.join(ref, "base", "left").join(best, "base", "left")
    return out.withColumn("complete", F.col("reference").isNotNull() & F.col("candidate").isNotNull())


def csv_line(*values: Column) -> Column:
    """A CSV line; only values with comma, quote or line feed are quoted, null is empty."""
    cells = []
    for v in values:
        s = F.coalesce(v.cast("string"), F.lit(""))
        cells.append(F.when(s.rlike('[,"\n]'), F.concat(F.lit('"'), F.replace(s, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(s))
    return F.concat_ws(",", *cells)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV files with header; quotes are doubled."""
    df.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(path)


def report_line(df: DataFrame) -> DataFrame:
    """Each row as one JSON line."""
    return df.select(F.to_json(F.struct("*")).alias("line"))


def detail_rows(json_lines: DataFrame, value: str, schema: str) -> DataFrame:
    """Rows of a report: its ``rows`` if that is an array, else none."""
    return json_lines.select(F.explode(F.from_json(F.col(value), f"rows array<{schema}>")["rows"]).alias("r")).select("r.*")


def stream_path(name: Column, reference: Column, examples: str | None) -> Column:
    """Where the stream of a fixture is: in the examples folder, else beside its reference."""
    if examples:
        return F.concat(F.lit(examples + "/"), name, F.lit(".sup"))
    return F.regexp_replace(reference, r"(?i)-eng\.srt\z", ".sup")


def reading_order(boxes: Column, tolerance: float = 0.03) -> Column:
    """Boxes ``struct<y, x, id>`` in reading order: rows from the top (largest y), left to right.

    A box belongs to a row if its y is within the tolerance of the row's first box.
    """
    by_height = F.array_sort(F.transform(boxes, lambda b: F.struct((-b["y"]).alias("d"), b["x"].alias("x"), b["id"].alias("id"))))
    zero = F.struct(F.lit(None).cast("double").alias("top"), F.lit(-1).alias("row"), F.array().cast("array<struct<row:int,x:double,id:int>>").alias("out"))

    def place(acc: Column, b: Column) -> Column:
        new = acc["top"].isNull() | (F.abs(b["d"] - acc["top"]) > tolerance)
        row = F.when(new, acc["row"] + 1).otherwise(acc["row"])
        return F.struct(
            F.when(new, b["d"]).otherwise(acc["top"]).alias("top"), row.alias("row"),
            F.array_append(acc["out"], F.struct(row.alias("row"), b["x"].alias("x"), b["id"].alias("id"))).alias("out"),
        )

    return F.transform(F.array_sort(F.aggregate(by_height, zero, place)["out"]), lambda b: b["id"])
