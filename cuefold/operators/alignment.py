"""Two tracks of one video, or two tables of one corpus, put side by side."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cuefold.functions import text as T
from cuefold.operators.captions import strict_order
from cuefold.operators.intervals import nearest, overlap_join

KEYS = ["video_id"]


def by_id(left: DataFrame, right: DataFrame, how: str = "left", keys: list[str] = KEYS) -> DataFrame:
    """(keys, identifier, start, end, text, other): cues of two tracks with the same identifier."""
    return left.join(right.select(*keys, "identifier", F.col("text").alias("other")), [*keys, "identifier"], how).select(*keys, "identifier", "start", "end", "text", "other")


def assign_by_overlap(targets: DataFrame, pieces: DataFrame, keys: list[str] = KEYS, bucket: float | None = 60.0) -> DataFrame:
    """(keys, piece_id, cue_id): the target cue with which each piece overlaps most, the first of equals; without overlap that of nearest middle. Pieces of keys without targets are left out."""
    parts = pieces.select(*keys, F.col("cue_id").alias("piece_id"), "start", "end")
    pairs = overlap_join(parts, targets.select(*keys, "cue_id", "start", "end"), keys, bucket)
    best = F.max_by("r_cue_id", F.struct(F.least("end", "r_end") - F.greatest("start", "r_start"), -F.col("r_cue_id")))
    won = pairs.groupBy(*keys, "piece_id").agg(best.alias("cue_id"))
    middle = ((F.col("start") + F.col("end")) / 2).alias("at")
    lost = parts.join(won.select(*keys, "piece_id"), [*keys, "piece_id"], "left_anti").select(*keys, "piece_id", middle)
    near = nearest(lost, targets.select(*keys, middle, F.col("cue_id").alias("target")), keys).where("target is not null")
    return won.unionByName(near.select(*keys, "piece_id", F.col("target").alias("cue_id")))


def align_translation(english: DataFrame, fragments: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """(keys, cue_id, start, end, text): for each English cue the translated fragments assigned to it, joined in order; cues without text go."""
    owner = assign_by_overlap(english, fragments, keys)
    texts = owner.join(fragments.select(*keys, F.col("cue_id").alias("piece_id"), "text"), [*keys, "piece_id"])
    whole = texts.groupBy(*keys, "cue_id").agg(F.array_sort(F.collect_list(F.struct("piece_id", "text"))).alias("p"))
    joined = whole.select(*keys, "cue_id", T.drop_repeats(T.smart_join(F.transform("p", lambda x: x["text"]))).alias("text")).where("text <> ''")
    return english.select(*keys, "cue_id", "start", "end").join(joined, [*keys, "cue_id"])


def pair_by_times(english: DataFrame, chinese: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """(keys, cue_id, start, end, text, other): cues with equal start and end, the first with the first, the second with the second, and so on."""
    n = F.row_number().over(W.partitionBy(*keys, "start", "end").orderBy("cue_id"))
    right = chinese.select(*keys, "start", "end", F.col("text").alias("other"), n.alias("n"))
    return english.withColumn("n", n).join(right, [*keys, "start", "end", "n"]).select(*keys, "cue_id", "start", "end", "text", "other")


def clip_pairs(pairs: DataFrame, durations: DataFrame) -> DataFrame:
    """Pairs (start, end, other_start, other_end) cut to the video: those that start at its end or later go; both sides start at the later start and end at the earliest end; 0.05 s or less goes."""
    d = pairs.join(durations.select("video_id", "duration"), "video_id")
    d = d.withColumns({"e": F.least("end", "other_end", "duration"), "s": F.greatest("start", "other_start")})
    return d.where((F.col("start") < F.col("duration")) & (F.col("other_start") < F.col("duration")) & (F.col("e") - F.col("s") > 0.05)).select(*[c for c in pairs.columns if c not in ("start", "end", "other_start", "other_end")], F.col("s").alias("start"), F.col("e").alias("end"))


def validate_pair(english: DataFrame, chinese: DataFrame, diagnostics: DataFrame | None = None, durations: DataFrame | None = None, tolerance_ms: int = 20, end_tolerance: float = 0.001) -> DataFrame:
    """One row a video: ids missing, extra, off in time, empty, invalid, duplicate, of both tracks (video_id, cue_id, identifier, start, end, text), and `validation_status`.

    `diagnostics` is (video_id, malformed, controls): faults that the file readers found. Of repeated ids the last cue counts. The status
    is the first that holds of SUBTITLE_TIMELINE_MISMATCH, SUBTITLE_ID_MISMATCH, SUBTITLE_VALIDATION_FAILED, else PASSED.
    """
    tol = max(0, tolerance_ms) / 1000
    sides = {}
    for side, cues in (("english", english), ("chinese", chinese)):
        flagged = strict_order(cues, durations, KEYS, end_tolerance)
        sides[side] = flagged.groupBy("video_id", "identifier").agg(
            F.max_by("start", "cue_id").alias(f"{side}_start"), F.max_by("end", "cue_id").alias(f"{side}_end"), F.bool_or(F.trim("text") == "").alias(f"{side}_empty"),
            F.bool_or("invalid").alias(f"{side}_invalid"), F.count("*").alias(f"{side}_n"),
        )
    both = sides["english"].join(sides["chinese"], ["video_id", "identifier"], "full_outer")
    off = lambda c: F.round(F.abs(F.col(f"english_{c}") - F.col(f"chinese_{c}")), 9) > tol
    ids = lambda c, name: F.array_sort(F.collect_list(F.when(F.coalesce(c, F.lit(False)), F.col("identifier")))).alias(name)
    out = both.groupBy("video_id").agg(
        ids(F.col("chinese_n").isNull(), "missing_chinese_ids"), ids(F.col("english_n").isNull(), "extra_chinese_ids"), ids(off("start") | off("end"), "timestamp_mismatch_ids"),
        ids(F.col("english_empty"), "empty_english_ids"), ids(F.col("chinese_empty"), "empty_chinese_ids"), ids(F.coalesce("english_invalid", F.lit(False)) | F.coalesce("chinese_invalid", F.lit(False)), "invalid_timestamp_ids"),
        ids(F.col("english_n") > 1, "english_duplicate_ids"), ids(F.col("chinese_n") > 1, "chinese_duplicate_ids"),
        F.coalesce(F.sum("english_n"), F.lit(0)).alias("english_segment_count"), F.coalesce(F.sum("chinese_n"), F.lit(0)).alias("chinese_segment_count"),
    )
    some = lambda *cols: sum((F.size(c) for c in cols), F.lit(0)) > 0
    extra = F.lit(False)
    if diagnostics is not None:
        bad = diagnostics.groupBy("video_id").agg((F.max("malformed") + F.max("controls") > 0).alias("__bad"))
        out = out.join(bad, "video_id", "left").withColumn("__bad", F.coalesce("__bad", F.lit(False)))
        extra = F.col("__bad")
    content = some("empty_english_ids", "empty_chinese_ids", "invalid_timestamp_ids", "english_duplicate_ids", "chinese_duplicate_ids") | (F.col("english_segment_count") == 0) | (F.col("chinese_segment_count") == 0) | extra
    lost = some("missing_chinese_ids", "extra_chinese_ids") | (F.col("english_segment_count") != F.col("chinese_segment_count"))
    status = F.when(some("timestamp_mismatch_ids"), "SUBTITLE_TIMELINE_MISMATCH").when(lost, "SUBTITLE_ID_MISMATCH").when(content, "SUBTITLE_VALIDATION_FAILED").otherwise("PASSED")
    return out.withColumn("validation_status", status).drop("__bad")


def review_violations(source: DataFrame, reviewed: DataFrame) -> DataFrame:
    """(video_id, id, code) for each fault of reviewed rows (video_id, id, start, end, english, reviewed) against the source (video_id, id, start, end, english).

    Codes: EXTRA_ID, MISSING_IDS, DUPLICATE_IDS, ENGLISH_CHANGED, TIMELINE_CHANGED, EMPTY_REVIEWED_TRANSLATION.
    """
    r = reviewed.groupBy("video_id", "id").agg(*[F.first(c).alias(f"r_{c}") for c in ("start", "end", "english", "reviewed")], F.count("*").alias("n"))
    both = source.withColumn("here", F.lit(True)).join(r, ["video_id", "id"], "full_outer")
    known = F.col("here") & F.col("n").isNotNull()
    moved = (F.abs(F.col("start") - F.col("r_start")) > 0.001) | (F.abs(F.col("end") - F.col("r_end")) > 0.001)
    codes = F.array_compact(F.array(
        F.when(F.col("here").isNull(), F.lit("EXTRA_ID")), F.when(F.col("n").isNull(), F.lit("MISSING_IDS")), F.when(F.col("n") > 1, F.lit("DUPLICATE_IDS")), F.when(known & (F.col("english") != F.col("r_english")), F.lit("ENGLISH_CHANGED")),
        F.when(known & moved, F.lit("TIMELINE_CHANGED")), F.when(known & (F.trim(F.coalesce("r_reviewed", F.lit(""))) == ""), F.lit("EMPTY_REVIEWED_TRANSLATION")),
    ))
    return both.select("video_id", "id", F.explode(codes).alias("code"))


def accept_reviews(source: DataFrame, reviewed: DataFrame) -> DataFrame:
    """Reviewed rows of the videos without any violation: all or nothing for each video."""
    return reviewed.join(review_violations(source, reviewed).select("video_id").distinct(), "video_id", "left_anti")


def missing_and_extra(source: DataFrame, other: DataFrame) -> DataFrame:
    """(video_id, id, side): ids of one table that the other lacks."""
    a, b = source.select("video_id", "id").distinct(), other.select("video_id", "id").distinct()
    return a.join(b, ["video_id", "id"], "left_anti").withColumn("side", F.lit("missing")).unionByName(b.join(a, ["video_id", "id"], "left_anti").withColumn("side", F.lit("extra")))


def low_confidence_cues(cues: DataFrame, words: DataFrame, below: float = 0.5) -> DataFrame:
    """Cues that a word of low probability overlaps."""
    weak = words.where(F.col("probability") < below).select("video_id", "start", "end")
    hit = overlap_join(cues.select("video_id", "cue_id", "start", "end"), weak, KEYS).select("video_id", "cue_id").distinct()
    return cues.join(hit, ["video_id", "cue_id"], "left_semi")


def pending(requests: DataFrame, answered: DataFrame, on: list[str]) -> DataFrame:
    """Requests without an answer."""
    return requests.join(answered.select(*on).distinct(), on, "left_anti")
