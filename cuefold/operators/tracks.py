"""Subtitle tracks of video containers: scan, selection, naming, extraction plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Codecs of image subtitles, and names of languages.
CODECS = ["S_VOBSUB", "S_HDMV/PGS"]
LANGUAGES = {
    "eng": "English", "fre": "French", "fra": "French", "ger": "German", "deu": "German", "spa": "Spanish", "ita": "Italian",
    "dut": "Dutch", "nld": "Dutch", "jpn": "Japanese", "und": "Unknown",
}
INFO = (
    "tracks array<struct<id:int,type:string,codec:string,properties:struct<codec_id:string,language:string,language_ietf:string,"
    "forced_track:boolean,default_track:boolean>>>"
)


def language_label(code: Column) -> Column:
    pairs = [F.lit(x) for kv in LANGUAGES.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), code), code)


def subtitle_format(codec: Column) -> Column:
    return F.when(F.startswith(F.coalesce(codec, F.lit("")), F.lit("S_VOBSUB")), "sub + idx").otherwise("sup")


def stem_suffix(code: Column, forced: Column) -> Column:
    return F.concat(
        F.when(code.isNull() | code.isin("", "eng"), "").otherwise(F.concat(F.lit("-"), code)), F.when(forced, "-forced").otherwise("")
    )


def parse_tracks(df: DataFrame, info: str, keep: str) -> DataFrame:
    """Image subtitle tracks of a container's JSON description.

    ``index`` counts them, ``stem_index`` those of the same name suffix, both over the
    whole list, so that names don't change when only some are extracted.  Text that is no
    JSON and containers without such tracks give no rows.
    """
    t = df.select(F.col(keep), F.posexplode(F.from_json(F.col(info), INFO)["tracks"]).alias("pos", "t")).where("t.type = 'subtitles'")
    t = t.select(
        keep, "pos", F.col("t.id").alias("track_id"), F.coalesce("t.properties.codec_id", "t.codec", F.lit("")).alias("codec"),
        F.coalesce("t.properties.language", F.lit("und")).alias("language_code"), F.col("t.properties.language_ietf").alias("language_ietf"),
        F.coalesce("t.properties.default_track", F.lit(False)).alias("default_track"), F.coalesce("t.properties.forced_track", F.lit(False)).alias("forced_track"),
    ).where(F.col("codec").isin(CODECS))
    suffix = stem_suffix(F.col("language_code"), F.col("forced_track"))
    # The tracks of one container are few.
    return (
        t.withColumn("index", F.row_number().over(Window.partitionBy(keep).orderBy("pos")) - 1)
        .withColumn("stem_index", F.row_number().over(Window.partitionBy(keep, suffix).orderBy("pos")) - 1)
        .withColumn("label", F.concat(language_label(F.col("language_code")), F.lit(" ("), F.col("language_code"), F.lit(")"), F.when(F.col("forced_track"), " forced").otherwise("")))
        .withColumn("format", subtitle_format(F.col("codec"))).drop("pos")
    )


def parse_languages(text: Column) -> Column:
    """Codes of a comma-separated list, English if it is empty."""
    codes = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), ",", -1), lambda x: F.lower(F.trim(x))), lambda x: x != "")
    return F.when(F.size(codes) == 0, F.array(F.lit("eng"))).otherwise(codes)


def wanted(languages: list[str], code: Column, ietf: Column) -> Column:
    """Whether a track has one of the languages, by its code or its IETF primary tag."""
    if not languages or "all" in languages:
        return F.lit(True)
    primary = F.lower(F.split(F.coalesce(ietf, F.lit("")), "-")[0])
    return F.coalesce(F.lower(code).isin(languages), F.lit(False)) | primary.isin(languages)


def extract_plan(tracks: DataFrame, out_dir: str) -> DataFrame:
    """``output``, ``outputs`` and ``spec`` of each track; ``.sub`` brings its ``.idx``."""
    ext = F.when(subtitle_format(F.col("codec")) == "sub + idx", "sub").otherwise("sup")
    stem = F.concat("file", F.when(F.col("stem_index") > 0, F.col("stem_index").cast("string")).otherwise(""), stem_suffix(F.col("language_code"), F.col("forced_track")))
    output = F.concat(F.lit(out_dir + "/"), stem, F.lit("."), ext)
    return (
        tracks.withColumn("output", output)
        .withColumn("outputs", F.when(ext == "sub", F.array("output", F.regexp_replace("output", r"\.sub\z", ".idx"))).otherwise(F.array("output")))
        .withColumn("spec", F.concat(F.col("track_id").cast("string"), F.lit(":"), F.col("output")))
    )


def clashes(plan: DataFrame) -> DataFrame:
    """Output files that several tracks of a plan would write."""
    return plan.select(F.explode("outputs").alias("path")).groupBy("path").agg(F.count("*").alias("tracks")).where("tracks > 1")


def checked_plan(tracks: DataFrame, out_dir: str) -> DataFrame:
    """The plan, failing if two tracks resolve to one file."""
    plan = extract_plan(tracks, out_dir)
    if not clashes(plan).isEmpty():
        raise ValueError("two tracks resolve to the same output file")
    return plan


def without_outputs(plan: DataFrame, existing: DataFrame) -> DataFrame:
    """Tracks of which some output is not there yet; ``existing`` has ``path``."""
    todo = plan.select("file", "track_id", F.explode("outputs").alias("path")).join(existing.select("path").distinct(), "path", "left_anti")
    return plan.join(todo.select("file", "track_id").distinct(), ["file", "track_id"], "left_semi")


def pair_idx_sub(files: DataFrame) -> DataFrame:
    """Complete pairs of ``.idx`` and ``.sub`` files by base name; ``files`` has ``path``.

    The only two files of a folder, one of each kind, are a pair whatever their names.
    """
    f = files.select("path", F.regexp_extract("path", r"\A(.*/)?", 1).alias("dir"), F.regexp_extract("path", r"([^/]*)\.[^./]*\z", 1).alias("base"),
                     F.lower(F.regexp_extract("path", r"\.([^./]*)\z", 1)).alias("ext")).where("ext in ('idx', 'sub')").distinct()
    idx = f.where("ext = 'idx'").select("dir", "base", F.col("path").alias("idx"))
    sub = f.where("ext = 'sub'").select("dir", "base", F.col("path").alias("sub"))
    named = idx.join(sub, ["dir", "base"], "full")
    two = f.groupBy("dir").agg(F.count("*").alias("n"), F.max(F.when(F.col("ext") == "idx", F.col("path"))).alias("idx"), F.max(F.when(F.col("ext") == "sub", F.col("path"))).alias("sub"))
    odd = two.where("n = 2 and idx is not null and sub is not null").select("idx", "sub")
    return named.where("idx is not null and sub is not null").select("idx", "sub").union(odd).distinct()
