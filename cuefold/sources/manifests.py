"""Manifests, metadata, probes, review sheets and file listings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuefold.functions import layout

MANIFEST = "video_id string, title string, channel string, url string, overall_status string, subtitle_clean_status string, candidate_file string, errors array<string>"
INFO = "id string, title string, channel string, uploader string, description string, categories array<string>, tags array<string>, duration double, webpage_url string, original_url string, upload_date string"
STREAM = (
    "index:int,codec_type:string,codec_name:string,width:int,height:int,avg_frame_rate:string,r_frame_rate:string,pix_fmt:string,channels:int,channel_layout:string,sample_rate:string,duration:string,"
    "tags:map<string,string>,disposition:map<string,int>,side_data_list:array<struct<rotation:string>>"
)
PROBE = f"streams array<struct<{STREAM}>>, format struct<format_name:string,duration:string,size:string,bit_rate:string>, chapters array<struct<id:bigint,start_time:string,end_time:string,tags:map<string,string>>>"
REVIEW = ("id", "start", "end", "duration", "english", "chinese_raw", "chinese_clean", "reviewed_translation", "qc_flags", "source", "reviewer_note")


def scan_manifests(spark: SparkSession, root: str, name: str = "download_manifest.json", schema: str = MANIFEST) -> DataFrame:
    """(task, manifest columns, error) of every file of that name below `root`, those below stage4 folders left out; a file that is no JSON object is a row with an error."""
    whole = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", name).text(root, wholetext=True).withColumn("__p", F.col("_metadata.file_path")).where(~F.lower("__p").contains("/stage4/"))
    parsed = F.from_json(F.regexp_replace("value", "^﻿", ""), f"{schema}, __bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__bad"})
    task = F.regexp_replace(F.regexp_extract("__p", r"^(.*)/[^/]*$", 1), "^.*/", "")
    df = whole.select(task.alias("task"), parsed.alias("j"))
    return df.select("task", "j.*").withColumn("error", F.when(F.col("__bad").isNotNull(), "invalid_json")).drop("__bad")


def media_metadata(manifests: DataFrame, info: DataFrame, descriptions: DataFrame) -> DataFrame:
    """(task, title, channel, topic, duration, description, tags, source_url): info fields before those of the manifest, the description file before info's."""
    i = info.select("task", *[F.col(c).alias(f"i_{c}") for c in ("title", "channel", "uploader", "description", "categories", "tags", "duration", "webpage_url", "original_url")])
    df = manifests.join(i, "task", "left").join(descriptions.select("task", F.col("description").alias("d")), "task", "left")
    first = lambda *c: F.coalesce(*[F.nullif(x, F.lit("")) for x in c], F.lit(""))
    return df.select(
        "task", first("i_title", "title").alias("title"), first("i_channel", "i_uploader", "channel").alias("channel"), F.coalesce(F.get("i_categories", F.lit(0)), F.lit("")).alias("topic"), F.nullif("i_duration", F.lit(0.0)).alias("duration"),
        F.coalesce("d", "i_description", F.lit("")).alias("description"), F.coalesce("i_tags", F.array().cast("array<string>")).alias("tags"), first("i_webpage_url", "i_original_url", "url").alias("source_url"),
    )


def read_review(spark: SparkSession, path: str) -> DataFrame:
    """A review sheet with the file it came from; a sheet without all columns fails the read."""
    df = spark.read.csv(path, sep="\t", header=True, multiLine=True, quote='"', escape='"')
    if not set(REVIEW) <= set(df.columns):
        raise ValueError("INVALID_REVIEW_COLUMNS")
    return df.select(*REVIEW).withColumn("id", F.col("id").try_cast("int"))


def file_hashes(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """(path, size, hash): SHA-256 of every file below `root`."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    return files.select("path", F.col("length").alias("size"), F.sha2("content", 256).alias("hash"))


def parse_probes(rows: DataFrame) -> DataFrame:
    """(video_id, probe) from (video_id, content): the facts of a media probe's JSON. Upright pictures by rotation have width and height swapped; the longest duration counts."""
    df = rows.select("video_id", F.from_json("content", PROBE).alias("p"))
    streams = F.coalesce("p.streams", F.array().cast(f"array<struct<{STREAM}>>"))
    of = lambda kind: F.filter(streams, lambda s: s["codec_type"] == kind)
    main = F.get(of("video"), F.lit(0))
    turned = F.coalesce(layout.rotation(F.try_element_at(main["tags"], F.lit("rotate")), F.get(main["side_data_list"], F.lit(0))["rotation"]), F.lit(0))
    rate = F.coalesce(F.nullif(main["avg_frame_rate"], F.lit("")), main["r_frame_rate"])
    longest = F.greatest(layout.number(F.col("p.format.duration")), F.coalesce(F.array_max(F.transform(streams, lambda s: layout.number(s["duration"]))), F.lit(0.0)))
    df = df.withColumns({"r": turned, "d": longest, "w": F.coalesce(main["width"], F.lit(0)), "h": F.coalesce(main["height"], F.lit(0))})
    side = F.col("r").isin(90, 270)
    sound = F.transform(of("audio"), lambda s: F.struct(s["index"].alias("index"), F.coalesce(s["codec_name"], F.lit("")).alias("codec"), F.coalesce(s["channels"], F.lit(0)).alias("channels"), F.coalesce(F.nullif(layout.number(s["duration"]), F.lit(0.0)), F.col("d")).alias("duration")))
    subs = F.transform(of("subtitle"), lambda s: F.struct(s["index"].alias("index"), F.coalesce(s["codec_name"], F.lit("")).alias("codec"), F.coalesce(s["tags"], F.expr("cast(map() AS map<string,string>)")).alias("tags"), F.coalesce(s["disposition"], F.expr("cast(map() AS map<string,int>)")).alias("disposition")))
    return df.select("video_id", F.struct(
        F.coalesce("p.format.format_name", F.lit("")).alias("format_name"), F.col("d").alias("duration"), layout.number(F.col("p.format.size")).cast("bigint").alias("size"), F.size(of("video")).alias("video_stream_count"), F.coalesce(main["codec_name"], F.lit("")).alias("video_codec"),
        F.col("w").alias("width"), F.col("h").alias("height"), F.when(side, F.col("h")).otherwise(F.col("w")).alias("display_width"), F.when(side, F.col("w")).otherwise(F.col("h")).alias("display_height"), F.coalesce(rate, F.lit("")).alias("frame_rate"),
        layout.fraction(rate).alias("frame_rate_value"), F.coalesce(main["pix_fmt"], F.lit("")).alias("pixel_format"), F.col("r").alias("rotation"), F.size(of("audio")).alias("audio_stream_count"), sound.alias("audio_streams"),
        F.size(of("subtitle")).alias("subtitle_stream_count"), subs.alias("subtitle_streams"), F.coalesce(F.size("p.chapters"), F.lit(0)).alias("chapter_count"),
    ).alias("probe"))
