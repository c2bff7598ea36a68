"""Candidate inputs: video resources, discovery hits, feeds, candidate files, categories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

VIDEO = (
    "video_id string, snippet struct<title:string,description:string,channelTitle:string,categoryId:string,publishedAt:string,liveBroadcastContent:string,"
    "defaultAudioLanguage:string,defaultLanguage:string,tags:array<string>,thumbnails:map<string,struct<url:string>>>, contentDetails struct<duration:string,caption:string>, "
    "statistics struct<viewCount:string,likeCount:string,commentCount:string>, status struct<privacyStatus:string,license:string,embeddable:boolean>"
)


def read_videos(spark: SparkSession, path: str) -> DataFrame:
    """One row an id from JSON lines: that of the newest file, and the last line of it, counts."""
    raw = spark.read.schema(f"id string, {VIDEO}").json(path).select("*", F.col("_metadata.file_modification_time").alias("__t"), F.col("_metadata.file_path").alias("__f"), F.monotonically_increasing_id().alias("__n"))
    raw = raw.withColumn("video_id", F.coalesce("video_id", "id")).where("video_id is not null")
    last = F.row_number().over(W.partitionBy("video_id").orderBy(F.desc("__t"), F.desc("__f"), F.desc("__n")))
    return raw.withColumn("__r", last).where("__r = 1").drop("__t", "__f", "__n", "__r", "id")


def parse_hits(packed: DataFrame) -> DataFrame:
    """(video_id, kind, mode, query_group, rank, query_text, feed) from (video_id, hit) strings: `search::mode::group::rank::query` or `mostPopular:feed`; others go."""
    p = F.split("hit", "::", 5)
    search = (F.size(p) == 5) & (F.get(p, F.lit(0)) == "search") & F.get(p, F.lit(3)).try_cast("int").isNotNull()
    feed = F.col("hit").startswith("mostPopular:")
    at = lambda i: F.when(search, F.get(p, F.lit(i)))
    out = packed.where(search | feed)
    return out.select("video_id", F.when(search, "search").otherwise("popular").alias("kind"), at(1).alias("mode"), at(2).alias("query_group"), at(3).try_cast("int").alias("rank"), at(4).alias("query_text"), F.when(~search, F.substring("hit", 13, 1_000_000)).alias("feed"))


def feed_topics(hits: DataFrame, topics: DataFrame) -> DataFrame:
    """(video_id, topics): topics of the feeds that a video stands in, by the dimension (feed, topic)."""
    joined = hits.where("kind = 'popular'").join(topics, "feed")
    return joined.groupBy("video_id").agg(F.array_sort(F.collect_set("topic")).alias("topics"))


def read_candidates(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Candidate rows of a JSON file that is an array of rows or an object with `candidates`; any other shape fails the read."""
    whole = spark.read.text(path, wholetext=True).select(F.trim("value").alias("v"), F.col("_metadata.file_path").alias("file"))
    rows = F.when(F.col("v").startswith("["), F.from_json("v", f"array<struct<{schema}>>")).otherwise(F.from_json("v", f"candidates array<struct<{schema}>>")["candidates"])
    checked = F.coalesce(rows, F.raise_error(F.concat(F.lit("no candidate records in "), F.col("file"))).cast(f"array<struct<{schema}>>"))
    return whole.select("file", F.inline(checked))


def latest_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """(file): the candidate file with the greatest date in its name, then modification time, then name."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.col("modificationTime").alias("t"))
    name = F.element_at(F.split("path", "/"), -1)
    return files.agg(F.max_by("path", F.struct(F.regexp_extract(name, r"^(\d{4}-\d{2}-\d{2})", 1), F.col("t"), name)).alias("file"))


def read_categories(spark: SparkSession, path: str) -> DataFrame:
    """(tid, name, parent_tid, parent_name, path, is_fallback) of a category file; a repeated or bad tid, an empty name or a missing fallback fails the read."""
    whole = spark.read.text(path, wholetext=True).select(F.from_json(F.regexp_replace("value", "^﻿", ""), "fallback_tid int, categories array<struct<tid:int,name:string,parent_tid:int,parent_name:string>>").alias("j"))
    rows = whole.select("j.fallback_tid", F.inline("j.categories"))
    n = F.count("*").over(W.partitionBy("tid"))
    found = F.max((F.col("tid") == F.col("fallback_tid")).cast("int")).over(W.partitionBy("fallback_tid"))
    bad = F.when((F.col("tid") < 1) | (n > 1), "bad or repeated tid").when((F.trim("name") == "") | (F.trim("parent_name") == ""), "empty name").when(found == 0, "fallback not in the map")
    checked = F.when(bad.isNull(), F.col("tid")).otherwise(F.raise_error(bad).cast("int"))
    return rows.select(checked.alias("tid"), F.trim("name").alias("name"), "parent_tid", F.trim("parent_name").alias("parent_name"), F.concat_ws(" / ", F.trim("parent_name"), F.trim("name")).alias("path"), (F.col("tid") == F.col("fallback_tid")).alias("is_fallback"))
