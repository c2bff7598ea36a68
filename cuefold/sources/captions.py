"""Caption files as tables. All readers take a table (video_id, track, content) of whole files, as `read_files` makes it, and parse with array functions in each row."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cuefold.functions import text as T
from cuefold.functions import times



def read_files(spark: SparkSession, path: str, pattern: str = "*.{vtt,srt}") -> DataFrame:
    """(video_id, track, content): the folder two above a file names the video, the file the track."""
    whole = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(path, wholetext=True)
    parts = F.split(F.col("_metadata.file_path"), "/")
    return whole.select(F.element_at(parts, -3).alias("video_id"), F.element_at(parts, -1).alias("track"), F.regexp_replace("value", "^﻿", "").alias("content"))


def _lines(files: DataFrame) -> DataFrame:
    return files.select("video_id", "track", F.posexplode(F.split("content", r"\r\n|\r|\n")).alias("n", "line")).withColumn("blank", F.trim("line") == "")


def _cues(lines: DataFrame, leading_blanks: bool) -> DataFrame:
    """Cues of lines with `head`: text runs from a time line to the first blank line after it, or, with leading blanks, after some text."""
    w = W.partitionBy("video_id", "track").orderBy("n")
    cue = F.sum(F.col("head").cast("int")).over(w)
    df = lines.withColumn("cue_id", cue.cast("int")).where("cue_id > 0")
    own = W.partitionBy("video_id", "track", "cue_id").orderBy("n")
    text = ~F.col("head") & ~F.col("blank")
    begun = F.max(text.cast("int")).over(own.rowsBetween(W.unboundedPreceding, W.currentRow)) == 1
    closing = ~F.col("head") & F.col("blank") & (begun if leading_blanks else F.lit(True))
    closed = F.coalesce(F.max(closing.cast("int")).over(own.rowsBetween(W.unboundedPreceding, W.currentRow)), F.lit(0))
    df = df.withColumn("__closed", closed)
    body = F.when(text & (F.col("__closed") == 0), F.struct("n", "line"))
    head = F.max(F.when(F.col("head"), F.col("line")))
    out = df.groupBy("video_id", "track", "cue_id").agg(head.alias("head"), F.array_sort(F.collect_list(body)).alias("body"))
    start, stop = (times.parse_timestamp(F.regexp_extract("head", times.TIME_LINE, k)) for k in (1, 2))
    return out.select("video_id", "track", "cue_id", start.alias("start"), stop.alias("end"), F.transform("body", lambda x: x["line"]).alias("lines"))


def parse_vtt(files: DataFrame) -> DataFrame:
    """(video_id, track, cue_id, start, end, text, raw): cues of WebVTT files. Blank lines before a cue's text are passed over; NOTE, STYLE and REGION blocks, up to the next blank line, do not count."""
    lines = _lines(files)
    w = W.partitionBy("video_id", "track").orderBy("n").rowsBetween(W.unboundedPreceding, W.currentRow)
    opens = F.trim("line").rlike("^(NOTE|STYLE|REGION)")
    last_open = F.max(F.when(opens, F.col("n"))).over(w)
    last_blank = F.coalesce(F.max(F.when(F.col("blank"), F.col("n"))).over(w), F.lit(-1))
    lines = lines.withColumn("__skip", F.coalesce(last_open > last_blank, F.lit(False)))
    # a block that opens inside a cue's text is text: it stands right below a time line or its text
    before = F.lag("line").over(W.partitionBy("video_id", "track").orderBy("n"))
    inside = opens & F.coalesce(F.trim(before) != "", F.lit(False))
    first = F.max(F.when(inside, F.col("n"))).over(w)
    lines = lines.withColumn("__skip", F.col("__skip") & ~F.coalesce(first > last_blank, F.lit(False))).where("not __skip")
    cues = _cues(lines.withColumn("head", F.col("line").rlike(times.TIME_LINE)), True).withColumn("raw", F.array_join("lines", "\n"))
    return cues.select("video_id", "track", "cue_id", "start", "end", T.clean_timed(F.col("raw")).alias("text"), "raw")


def parse_srt(files: DataFrame) -> DataFrame:
    """(video_id, track, cue_id, start, end, text, raw): cues of SRT files by their time lines, numbered anew; a cue ends at the first blank line."""
    cues = _cues(_lines(files).withColumn("head", F.col("line").rlike(times.TIME_LINE)), False)
    text = F.array_join(F.transform("lines", lambda x: F.trim(x)), " ")
    return cues.select("video_id", "track", "cue_id", "start", "end", text.alias("text"), F.array_join("lines", "\n").alias("raw"))


def _blocks(files: DataFrame, separator: str) -> DataFrame:
    blocks = F.filter(F.split(F.regexp_replace("content", r"^\s+|\s+$", ""), separator), lambda b: F.trim(b) != "")
    return files.select("video_id", "track", F.posexplode(blocks).alias("block_no", "block")).withColumns({"block_no": F.col("block_no") + 1, "rows": F.split("block", r"\r\n|\r|\n")})


def parse_srt_strict(files: DataFrame) -> DataFrame:
    """(video_id, track, block_no, cue_id, identifier, start, end, text, lines, malformed, control) of each block: a block without an id or a lawful time line is malformed."""
    df = _blocks(files, r"\r?\n[ \t]*\r?\n+")
    line = F.trim(F.get("rows", F.lit(1)))
    pattern = r"^(\d+:\d{1,2}:\d{1,2}[.,]\d{3})\s*-->\s*(\d+:\d{1,2}:\d{1,2}[.,]\d{3})"
    df = df.withColumns({"identifier": F.trim(F.get("rows", F.lit(0))), "start": times.parse_strict(F.regexp_extract(line, pattern, 1)), "end": times.parse_strict(F.regexp_extract(line, pattern, 2))})
    bad = (F.size("rows") < 2) | (F.col("identifier") == "") | F.col("start").isNull() | F.col("end").isNull()
    kept = F.filter(F.transform(F.slice("rows", 3, 1_000_000), lambda x: F.trim(x)), lambda x: x != "")
    text = F.array_join(kept, "\n")
    df = df.select("video_id", "track", "block_no", "identifier", "start", "end", text.alias("text"), kept.alias("lines"), F.coalesce(bad, F.lit(True)).alias("malformed"), text.rlike(r"[\p{Cc}&&[^\n\t]]").alias("control"))
    return df.withColumn("cue_id", F.col("block_no"))


def strict_diagnostics(blocks: DataFrame) -> DataFrame:
    """One row a track: malformed block numbers, repeated ids, ids with control characters."""
    n = F.count("*").over(W.partitionBy("video_id", "track", "malformed", "identifier"))
    df = blocks.withColumn("__n", n)
    some = lambda c, v: F.array_sort(F.collect_set(F.when(c, F.col(v))))
    return df.groupBy("video_id", "track").agg(some(F.col("malformed"), "block_no").alias("malformed_blocks"), some(~F.col("malformed") & (F.col("__n") > 1), "identifier").alias("duplicate_ids"), some(~F.col("malformed") & F.col("control"), "identifier").alias("illegal_control_ids"))


def inspect_srt(files: DataFrame, width: int = 42, most: int = 2) -> DataFrame:
    """One row a track: blocks, invalid and repeated ids, invalid time lines, empty blocks, lines over `width`, blocks over `most` lines."""
    df = _blocks(files, r"\r?\n\s*\r?\n")
    first = F.trim(F.get("rows", F.lit(0)))
    has_id = first.rlike(r"^\d+$")
    at = F.when(has_id, 1).otherwise(0)
    line = F.coalesce(F.get("rows", at), F.lit(""))
    timed = line.contains("-->")
    text = F.when(timed, F.filter(F.transform(F.slice("rows", at + 2, F.lit(1_000_000)), lambda x: F.trim(x)), lambda x: x != "")).otherwise(F.array().cast("array<string>"))
    df = df.withColumns({"id": F.when(has_id, first.try_cast("bigint")), "has_id": has_id, "timed": timed & F.trim(line).rlike(f"^{times.TIME_LINE}$"), "text": text})
    n = lambda c: F.count_if(c)
    ids = F.col("id").isNotNull()
    return df.groupBy("video_id", "track").agg(
        F.count("*").alias("blocks"), n(~F.col("has_id")).alias("invalid_ids"), (n(ids) - F.count_distinct("id")).alias("duplicate_ids"), n(~F.col("timed")).alias("invalid_timing_lines"), n(F.size("text") == 0).alias("empty_blocks"),
        F.sum(F.size(F.filter("text", lambda x: F.length(x) > width))).cast("bigint").alias("long_lines"), n(F.size("text") > most).alias("too_many_lines"),
    )


def asr_words(segments: DataFrame) -> DataFrame:
    """(video_id, cue_id, n, text, start, end, probability, timestamps_approximated) of recogniser segments (video_id, id, start, end, text, words).

    Where every word has times they count; else the segment's words share its time, 0.01 s at least, evenly, and are marked.
    """
    real = F.forall("words", lambda w: w["start"].isNotNull() & w["end"].isNotNull()) & (F.size("words") > 0)
    some = F.coalesce(real & F.exists("words", lambda w: (T.recognised(w["word"]) != "") & (w["end"] > w["start"])), F.lit(False))
    given = F.transform("words", lambda w: F.struct(T.recognised(w["word"]).alias("text"), w["start"].alias("start"), w["end"].alias("end"), w["probability"].alias("probability"), F.lit(False).alias("timestamps_approximated")))
    tokens = T.tokens(T.recognised(F.coalesce("text", F.lit(""))))
    start = F.coalesce("start", F.lit(0.0))
    long = F.greatest(F.coalesce(F.col("end"), start) - start, F.lit(0.01))
    even = T.let(tokens, lambda own: F.transform(own, lambda t, i: F.struct(t.alias("text"), (start + long * i / F.size(own)).alias("start"), (start + long * (i + 1) / F.size(own)).alias("end"), F.lit(None).cast("double").alias("probability"), F.lit(True).alias("timestamps_approximated"))))
    return segments.select("video_id", F.col("id").alias("cue_id"), F.posexplode(F.when(some, given).otherwise(even)).alias("n", "w")).select("video_id", "cue_id", "n", "w.*")


def srt_words(cues: DataFrame) -> DataFrame:
    """Cues with `words`: the text's words sharing its time evenly."""
    tokens = T.tokens(F.col("text"))
    long = F.greatest(F.lit(0.01), F.col("end") - F.col("start"))
    at = lambda own, i: F.col("start") + long * i / F.size(own)
    return cues.withColumn("words", T.let(tokens, lambda own: F.transform(own, lambda t, i: F.struct(t.alias("text"), at(own, i).alias("start"), at(own, i + 1).alias("end"), F.col("start").alias("first_seen_at")))))


