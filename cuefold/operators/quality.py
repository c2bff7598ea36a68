"""Scores and quality reports of caption tracks, recogniser output and translations, and the choice between tracks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cuefold.functions import text as T
from cuefold.functions.udfs import seq_ratio
from cuefold.operators import captions, intervals
from cuefold.operators.alignment import pair_by_times
from cuefold.operators.captions import duration

TRACK = ["video_id", "track"]
# Weights of the six dimensions.
WEIGHTS = {"structure": 0.15, "timeline": 0.2, "coverage": 0.2, "stability": 0.15, "readability": 0.1, "source_confidence": 0.2}
LIMITS = {"hard_max_segment_duration": 8.0, "minimum_gap_ms": 20, "english_max_cps": 20, "english_max_chars_per_line": 42, "max_lines": 2, "max_segment_duration": 7.0, "min_segment_duration": 0.8, "minimum_speech_coverage": 0.65}


def speech_intervals(segments: DataFrame) -> DataFrame:
    """(video_id, start, end) of recognised segments that last and are not likely silence."""
    return segments.where((F.col("end") > F.col("start")) & (F.coalesce("no_speech_prob", F.lit(0.0)) <= 0.6)).select("video_id", "start", "end")


def repeated_runs(cues: DataFrame, keys: list[str] = ["video_id"]) -> DataFrame:  # noqa: B006
    """(keys, continuous_repeated_phrases): neighbours where the last three to eight words of the one begin the other."""
    words = T.tokens(T.comparable(F.col("text")))
    df = cues.withColumn("__w", words).withColumn("__p", F.lag("__w").over(W.partitionBy(*keys).orderBy("cue_id")))
    most = F.least(F.size("__p"), F.size("__w"), F.lit(8))
    sizes = F.when(most >= 3, F.sequence(F.lit(3), most)).otherwise(F.array().cast("array<int>"))
    hit = F.exists(sizes, lambda k: F.slice("__p", -k, k) == F.slice("__w", F.lit(1), k))
    return df.groupBy(*keys).agg(F.count_if(F.coalesce(hit, F.lit(False))).alias("continuous_repeated_phrases"))


def recogniser_qc(clean: DataFrame, raw: DataFrame, words: DataFrame, audio: DataFrame, max_cps: float = 20.0) -> DataFrame:
    """One row a video: counts over clean cues, means over raw segments and words, coverage, tail gap and status. `audio` is (video_id, duration)."""
    keys = ["video_id"]
    a, d = captions.adjacent(clean, keys), duration()
    n = lambda c, name: F.count_if(c).alias(name)
    per = a.groupBy("video_id").agg(
        n(F.trim("text") == "", "empty_segments"), n(F.col("start") >= F.col("end"), "invalid_timestamps"), n(F.col("reversed"), "reversed_timestamps"), n(F.col("overlap"), "overlaps"),
        n(d < 0.3, "under_0_3_seconds"), n(d > 8.0, "over_8_seconds"), n(F.coalesce(F.try_divide(F.length("text"), d), F.lit(0.0)) > max_cps, "over_max_cps"),
        n(F.col("duplicate") & (F.trim("text") != ""), "adjacent_duplicates"), F.sum(d).alias("cover"), F.max_by("end", "cue_id").alias("final_end"), F.count("*").alias("segment_count"),
    )
    rawq = raw.groupBy("video_id").agg(
        n(F.coalesce("no_speech_prob", F.lit(0.0)) > 0.6, "high_no_speech_segments"), F.round(F.avg("avg_logprob"), 6).alias("average_log_probability"),
        F.round(F.avg("no_speech_prob"), 6).alias("average_no_speech_probability"), F.count("*").alias("raw_segment_count"),
    )
    approximated = F.coalesce(F.col("timestamps_approximated"), F.lit(False)) if "timestamps_approximated" in words.columns else F.lit(False)
    wordq = words.groupBy("video_id").agg(
        F.round(F.coalesce(F.avg("probability"), F.lit(0.0)), 6).alias("average_word_probability"), n(F.col("probability") < 0.5, "low_confidence_words"),
        F.round(F.avg((F.col("start").isNull() | F.col("end").isNull() | approximated).cast("int")), 6).alias("word_timestamp_missing_rate"), F.count("*").alias("word_count"),
    )
    out = per.join(rawq, keys, "full_outer").join(wordq, keys, "full_outer").join(repeated_runs(clean), keys, "left").join(audio.select("video_id", F.col("duration").alias("audio")), keys, "left")
    counts = [c for c, t in out.dtypes if t == "bigint"]
    out = out.fillna(0, counts).fillna(0.0, ["cover", "final_end", "audio", "average_word_probability", "word_timestamp_missing_rate"])
    gap = F.greatest(F.lit(0.0), F.col("audio") - F.col("final_end"))
    good = (F.col("empty_segments") + F.col("invalid_timestamps") + F.col("overlaps") + F.col("adjacent_duplicates") == 0) & (F.col("segment_count") > 0)
    return out.withColumns({
        "coverage_seconds": F.round("cover", 3), "coverage_ratio": F.round(F.when(F.col("audio") > 0, F.col("cover") / F.col("audio")).otherwise(0.0), 6), "audio_tail_gap_seconds": F.round(gap, 3),
        "audio_end_may_be_truncated": (F.col("segment_count") > 0) & (F.col("audio") > 0) & (gap > F.greatest(F.lit(5.0), F.col("audio") * 0.1)), "status": F.when(good, "QC_PASSED").otherwise("REVIEW_REQUIRED"),
    }).drop("cover", "final_end", "audio")


def recogniser_score() -> Column:
    """100 less weighted faults over the columns of recogniser_qc; null without segments."""
    p = F.coalesce("average_word_probability", F.lit(0.0))
    score = 100.0 - F.col("empty_segments") * 5 - F.col("invalid_timestamps") * 10 - F.col("overlaps") * 8 - F.col("adjacent_duplicates") * 5 - F.least(F.lit(20.0), F.col("word_timestamp_missing_rate") * 20)
    score = score - F.when(p != 0, F.greatest(F.lit(0.0), 0.7 - p) * 30).otherwise(0.0)
    return F.when(F.col("segment_count") > 0, F.round(F.greatest(F.lit(0.0), score), 2))


def source_quality(cues: DataFrame, keys: list[str] = TRACK, ratio: bool = True) -> DataFrame:
    """One row a track: shares of empty, very short, equal, rolling and overlapping cues, quality 0 to 100 and the route. Rolling counts a text ratio from 0.82 on too, unless `ratio` is off."""
    w = W.partitionBy(*keys).orderBy("cue_id")
    df = cues.withColumn("now", T.comparable(F.col("text"))).withColumns({"prev": F.lag("now").over(w), "pe": F.lag("end").over(w)})
    both = F.coalesce((F.col("now") != "") & (F.col("prev") != "") & (F.col("now") != F.col("prev")), F.lit(False))
    plain = both & (F.col("now").startswith(F.col("prev")) | F.col("prev").endswith(F.col("now")))
    df = df.withColumn("rolling", F.coalesce(plain, F.lit(False)))
    if ratio:
        df = df.withColumn("rolling", F.when(both & ~F.col("rolling"), seq_ratio("prev", "now") >= 0.82).otherwise(F.col("rolling")))
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    out = df.groupBy(*keys).agg(
        F.count("*").alias("cue_count"), n(F.trim("text") == "").alias("e"), n(F.col("end") - F.col("start") <= 0.05).alias("s"), n((F.col("now") != "") & (F.col("now") == F.col("prev"))).alias("x"), n(F.col("rolling")).alias("r"),
        n(F.col("start") < F.col("pe")).alias("overlap_count"),
    )
    share = lambda c: F.col(c) / F.greatest(F.col("cue_count"), F.lit(1))
    lost = share("e") * 20 + share("s") * 15 + share("x") * 20 + share("r") * 25 + share("overlap_count") * 20
    route = F.when(F.col("track").endswith(".auto.vtt"), "YOUTUBE_VTT_RECONSTRUCTION").otherwise("DIRECT_CLEANING") if "track" in keys else F.lit("DIRECT_CLEANING")
    return out.select(*keys, "cue_count", F.round(share("e"), 6).alias("empty_ratio"), F.round(share("s"), 6).alias("very_short_ratio"), F.round(share("x"), 6).alias("exact_duplicate_ratio"), F.round(share("r"), 6).alias("rolling_duplicate_ratio"), "overlap_count", F.round(F.greatest(F.lit(0.0), 100 - lost), 2).alias("quality_score"), route.alias("route"))


def agreement(a: DataFrame, b: DataFrame) -> DataFrame:
    """(video_id, agreement): similarity of two tracks' texts where they overlap, weighted by seconds, 0 to 100; without any overlap that of the whole texts; 0 if one is empty."""
    order = lambda cols: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*cols))), lambda x: x[cols[1]]), " ")
    pairs = intervals.overlap_join(a, b, ["video_id"])
    per = pairs.groupBy("video_id", "cue_id").agg(F.first("text").alias("x"), order(["r_cue_id", "r_text"]).alias("y"), F.sum(F.least("end", "r_end") - F.greatest("start", "r_start")).alias("o"))
    weight = F.greatest(F.lit(0.01), F.col("o"))
    near = per.withColumns({"r": seq_ratio(T.comparable(F.col("x")), T.comparable(F.col("y"))), "w": weight}).groupBy("video_id").agg((F.sum(F.col("r") * F.col("w")) / F.sum("w")).alias("near"))
    whole = lambda t, name: t.groupBy("video_id").agg(order(["cue_id", "text"]).alias(name))
    rest = whole(a, "x").join(whole(b, "y"), "video_id", "full_outer").join(near, "video_id", "left")
    lone = rest.where("near is null and x is not null and y is not null").withColumn("near", seq_ratio(T.comparable(F.col("x")), T.comparable(F.col("y"))))
    done = rest.where("near is not null or x is null or y is null").unionByName(lone)
    return done.select("video_id", F.round(F.coalesce("near", F.lit(0.0)) * 100, 3).alias("agreement"))


def _stack(groups: dict[str, list[tuple[str, Column, Column]]]) -> Column:
    rows = [F.struct(F.lit(d).alias("dimension"), F.lit(reason).alias("reason"), F.round(raw.cast("double"), 6).alias("raw_value"), F.round(points.cast("double"), 3).alias("points")) for d, items in groups.items() for reason, raw, points in items]
    return F.explode(F.array(*rows))


def deductions(cues: DataFrame, inspection: DataFrame, speech: DataFrame, audio: DataFrame, qc: DataFrame, limits: dict = LIMITS) -> tuple[DataFrame, DataFrame]:
    """(long deductions, wide measures) of each track: (video_id, track, dimension, reason, raw_value, points), and one row a track with what hard failures need.

    cues: (video_id, track, cue_id, start, end, text). inspection: (video_id, track, duplicate_ids, invalid_ids, invalid_timing_lines,
    empty_blocks, long_lines, too_many_lines) of the file. speech: (video_id, start, end). audio: (video_id, duration). qc: (video_id,
    track, source, source_type, continuous_repeated_phrases, under_0_3_seconds, high_no_speech_segments, average_word_probability,
    average_log_probability, average_no_speech_probability, word_timestamp_missing_rate, coverage_ratio, low_confidence_words,
    word_count, agreement); missing values are null.
    """
    a, d = captions.adjacent(cues, TRACK, float(limits["minimum_gap_ms"]) / 1000), duration()
    a = a.join(audio.select("video_id", F.col("duration").alias("audio")), "video_id", "left").withColumn("audio", F.coalesce("audio", F.lit(0.0)))
    n = lambda c, name: F.count_if(F.coalesce(c, F.lit(False))).alias(name)
    size = F.length("text")
    per = a.groupBy(*TRACK).agg(
        F.count("*").alias("segments"), n(F.trim("text") == "", "empty_text"), n(F.col("text").rlike(T.CAPTION_TAG), "tags"), n(F.col("text").rlike(T.CONTROL), "controls"), n(F.col("text").rlike(T.INVISIBLE), "invisibles"),
        n(T.comparable(F.col("text")) == "", "invalid_text"), n(F.col("start") >= F.col("end"), "bad_times"), n(F.col("reversed"), "reverse"), n(F.col("overlap"), "overlaps"), n(d < 0.3, "under"),
        n(d > float(limits["hard_max_segment_duration"]), "over"), n(F.col("small_gap"), "bad_gaps"), n((F.col("audio") > 0) & (F.col("end") > F.col("audio") + 0.25), "beyond"),
        n(F.col("duplicate") & (T.comparable(F.col("text")) != ""), "adjacent"), n(F.col("contained"), "cumulative"), n(F.try_divide(size, d) > float(limits["english_max_cps"]), "fast"), n(d > float(limits["max_segment_duration"]), "too_long"),
        n((d < float(limits["min_segment_duration"])) & (size < 18), "fragments"), n(~F.trim("text").rlike(r"[.?!…:;\"'，。！？；：”)】\]]$") & (F.length(F.trim("text")) > 84), "unnatural"),
        F.min_by("start", "cue_id").alias("first_start"), F.max_by("end", "cue_id").alias("last_end"), F.first("audio").alias("audio"),
    )
    tracks = cues.select(*TRACK).distinct()
    talk = tracks.join(speech, "video_id")
    ends = speech.groupBy("video_id").agg(F.min_by("start", F.struct("start", "end")).alias("s0"), F.max_by("end", F.struct("start", "end")).alias("s1"))
    touch = cues.join(ends, "video_id").groupBy(*TRACK).agg(F.bool_or((F.col("start") <= F.col("s0") + 1.0) & (F.col("end") >= F.col("s0"))).alias("c0"), F.bool_or((F.col("start") <= F.col("s1")) & (F.col("end") >= F.col("s1") - 1.0)).alias("c1"))
    wide = per.join(intervals.length(talk, TRACK, "speech"), TRACK, "left").join(intervals.intersection_length(talk, cues, TRACK).withColumnRenamed("seconds", "covered"), TRACK, "left")
    wide = wide.join(intervals.longest_gap(talk, cues, TRACK).withColumnRenamed("seconds", "gap"), TRACK, "left").join(intervals.length(cues, TRACK, "shown"), TRACK, "left").join(touch, TRACK, "left")
    wide = wide.join(inspection, TRACK, "left").join(qc, TRACK, "left")
    zero = lambda *names: {c: F.coalesce(c, F.lit(0)) for c in names}
    wide = wide.withColumns(zero("duplicate_ids", "invalid_ids", "invalid_timing_lines", "empty_blocks", "long_lines", "too_many_lines", "continuous_repeated_phrases", "under_0_3_seconds", "high_no_speech_segments", "low_confidence_words", "covered", "shown"))
    has = F.col("speech").isNotNull()
    timed = F.col("audio") > 0
    some = F.col("segments") > 0
    ratio = F.when(has, F.col("covered") / F.col("speech")).when(timed, F.least("shown", "audio") / F.col("audio")).otherwise(F.when(some, 1.0).otherwise(0.0))
    wide = wide.withColumns({
        "has_speech": has, "coverage_ratio_own": ratio, "max_uncovered": F.when(has, F.coalesce("gap", F.lit(0.0))).when(timed, F.greatest(F.lit(0.0), F.col("audio") - F.least("shown", "audio"))).otherwise(0.0),
        "first_ok": F.when(has, F.coalesce("c0", F.lit(False))).otherwise(some & (F.col("first_start") <= 2.0)), "last_ok": F.when(has, F.coalesce("c1", F.lit(False))).otherwise(some & (~timed | (F.col("last_end") >= F.col("audio") - 5.0))),
        "empty": F.greatest("empty_text", "empty_blocks"), "invalid_times": F.col("bad_times") + F.col("invalid_timing_lines"),
    })
    c, up, down = F.col, lambda x, y: F.least(F.lit(float(x)), y), lambda x: F.greatest(F.lit(0.0), x)
    yt = c("source") == "youtube"
    base_yt = F.when(c("source_type") == "manual", 95.0).otherwise(78.0)
    p = F.coalesce("average_word_probability", F.lit(0.0))
    base_asr = F.when(p != 0, p * 100).otherwise(65.0)
    missing, vad = F.coalesce("word_timestamp_missing_rate", F.lit(0.0)), F.coalesce("coverage_ratio", F.lit(0.0))
    low = c("low_confidence_words") / F.greatest(F.coalesce("word_count", F.lit(0)), F.lit(1))
    off = lambda cond, x: F.when(F.coalesce(cond, F.lit(False)), F.coalesce(x, F.lit(0.0))).otherwise(F.lit(0.0))
    transitions = F.when(yt, c("under_0_3_seconds")).otherwise(0)
    simple = lambda reason, col, by, most=None: (reason, c(col), up(most, c(col) * by) if most else c(col) * by)
    groups = {
        "structure": [simple("EMPTY_SUBTITLE", "empty", 15), simple("TAG_RESIDUAL", "tags", 8), simple("CONTROL_CHARACTER", "controls", 10), simple("INVISIBLE_CHARACTER", "invisibles", 5), simple("DUPLICATE_ID", "duplicate_ids", 15), simple("INVALID_ID", "invalid_ids", 10), simple("INVALID_TEXT", "invalid_text", 10)],
        "timeline": [simple("INVALID_TIMESTAMP", "invalid_times", 25), simple("REVERSED_TIMELINE", "reverse", 15), simple("OVERLAP", "overlaps", 20), simple("UNDER_0_3_SECONDS", "under", 2, 20), simple("OVER_8_SECONDS", "over", 8), simple("UNREASONABLE_GAP", "bad_gaps", 1, 10), simple("BEYOND_AUDIO_DURATION", "beyond", 10)],
        "coverage": [("UNCOVERED_SPEECH", 1 - c("coverage_ratio_own"), down(1 - c("coverage_ratio_own")) * 100), ("FIRST_SPEECH_NOT_COVERED", (~c("first_ok")).cast("int"), F.when(c("first_ok"), 0).otherwise(5)), ("LAST_SPEECH_NOT_COVERED", (~c("last_ok")).cast("int"), F.when(c("last_ok"), 0).otherwise(5)), ("LONG_UNCOVERED_SPEECH_GAP", c("max_uncovered"), up(15, c("max_uncovered") / 2))],
        "stability": [simple("ADJACENT_DUPLICATE", "adjacent", 15), simple("CUMULATIVE_TEXT_RESIDUAL", "cumulative", 8), simple("REPEATED_PHRASE", "continuous_repeated_phrases", 5), ("TRANSITION_CUE_RESIDUAL", transitions, transitions * 2), simple("HIGH_NO_SPEECH", "high_no_speech_segments", 4)],
        "readability": [simple("HIGH_CPS", "fast", 2, 30), simple("LONG_LINE", "long_lines", 2, 20), simple("TOO_MANY_LINES", "too_many_lines", 5), simple("LONG_DURATION", "too_long", 3), simple("SHORT_FRAGMENT", "fragments", 2, 20), simple("UNNATURAL_BREAK", "unnatural", 2, 15)],
        "source_confidence": [
            ("SOURCE_BASE_CONFIDENCE", off(yt, 100 - base_yt), off(yt, 100 - base_yt)), ("ROLLING_RESIDUAL", off(yt, c("cumulative")), off(yt, c("cumulative") * 4.0)), ("MODEL_CONFIDENCE", off(~yt, 100 - base_asr), off(~yt, down(100 - base_asr))), ("MISSING_WORD_TIMESTAMPS", off(~yt, missing), off(~yt, missing * 30)),
            ("LOW_VAD_COVERAGE", off(~yt, vad), off(~yt, down(0.9 - vad) * 50)), ("LOW_CONFIDENCE_WORDS", off(~yt, low), off(~yt, low * 20)), ("HIGH_NO_SPEECH_CONFIDENCE", off(~yt, c("high_no_speech_segments") * 1.0), off(~yt, c("high_no_speech_segments") * 2.0)),
            ("LOW_AVERAGE_LOGPROB", off(~yt, c("average_log_probability")), off(~yt, up(15, down(-c("average_log_probability") - 0.5) * 15))), ("AVERAGE_NO_SPEECH_PROBABILITY", off(~yt, c("average_no_speech_probability")), off(~yt, up(10, down(c("average_no_speech_probability")) * 10))),
            ("LOW_CROSS_SOURCE_AGREEMENT", F.coalesce(100 - c("agreement"), F.lit(0.0)), F.coalesce(down(70 - c("agreement")) * 0.25, F.lit(0.0))),
        ],
    }
    return wide.select(*TRACK, _stack(groups).alias("d")).select(*TRACK, "d.*"), wide


def caption_scores(cues: DataFrame, inspection: DataFrame, speech: DataFrame, audio: DataFrame, qc: DataFrame, limits: dict = LIMITS, weights: dict = WEIGHTS) -> DataFrame:
    """One row a track: the six dimension scores, final_score, hard_fail, hard_fail_reasons, flags, max_uncovered, source, source_type."""
    long, wide = deductions(cues, inspection, speech, audio, qc, limits)
    scores = long.groupBy(*TRACK).pivot("dimension", list(weights)).agg(F.round(F.greatest(F.lit(0.0), 100.0 - F.sum("points")), 3))
    final = F.round(reduce(lambda a, b: a + b, [F.round(F.col(k) * float(w), 3) for k, w in weights.items()]), 3)
    why = F.array_compact(F.array(
        F.when(F.col("segments") == 0, F.lit("SEGMENT_COUNT_ZERO")), F.when(F.col("invalid_times") > 0, F.lit("INVALID_TIMESTAMPS")), F.when(F.col("overlaps") > 0, F.lit("OVERLAPS_REMAIN")), F.when(F.col("empty") > 0, F.lit("EMPTY_SUBTITLES_REMAIN")),
        F.when(F.col("coverage_ratio_own") < float(limits["minimum_speech_coverage"]), F.lit("SPEECH_COVERAGE_BELOW_MINIMUM")),
    ))
    flags = F.concat(F.when(F.col("has_speech"), F.array().cast("array<string>")).otherwise(F.array(F.lit("SPEECH_INTERVALS_UNAVAILABLE"))), why)
    more = wide.select(*TRACK, "source", "source_type", (F.size(why) > 0).alias("hard_fail"), why.alias("hard_fail_reasons"), flags.alias("flags"), F.round("max_uncovered", 3).alias("max_uncovered"))
    return scores.withColumn("final_score", final).join(more, TRACK)


def choose_source(scores: DataFrame, mode: str = "auto", **rules) -> DataFrame:
    """(video_id, selected_source, selection_reason, warnings, selection_failed, score_difference) from caption_scores rows of sources `youtube` and `whisper`; `rules` as in `choose_sources`."""
    return choose_sources(scores, [mode], **rules).drop("mode")


def choose_sources(scores: DataFrame, modes: list[str], parts: int | None = None, **rules) -> DataFrame:
    """The rows of `choose_source` for each of the modes, with `mode`: both sources of a video meet once for all of them.

    Rows are dealt out by video before they are put together: a task sorts its own videos' rows once, and none in the reading task, where
    two rows a video leave nothing to sum up. `parts` is the number of tasks, for tables that hold more than the session's number can sort.
    """
    cols = ["final_score", "hard_fail", "source_type", "coverage", "timeline", "readability", "max_uncovered", "flags"]
    dealt = scores.select("video_id", "source", *cols).repartition(*([parts] if parts else []), "video_id")
    two = dealt.groupBy("video_id").pivot("source", ["youtube", "whisper"]).agg(*[F.first(c).alias(c) for c in cols])
    made = [F.struct(F.lit(m).alias("mode"), picked.alias("p"), F.round(diff, 3).alias("score_difference")) for m in modes for picked, diff in [_choice(m, **rules)]]
    return two.select("video_id", F.inline(F.array(*made))).select("mode", "video_id", "p.*", "score_difference")


def _choice(mode: str, minimum: float = 70, margin: float = 6, coverage_margin: float = 3, gap_margin: float = 3, preferred: str = "whisper", below_minimum: bool = True) -> tuple[Column, Column]:
    """The choice between the two sources of a row, and the difference of their scores."""
    y, w = (lambda c: F.col(f"youtube_{c}")), (lambda c: F.col(f"whisper_{c}"))
    safe = lambda s: F.coalesce(~s("hard_fail"), F.lit(False))
    usable = lambda s: safe(s) & (s("final_score") >= minimum)
    out = lambda source, reason, *warn: F.struct(
        (source if isinstance(source, Column) else F.lit(source)).alias("selected_source"), F.lit(reason).alias("selection_reason"), F.array(*[F.lit(x) for x in warn]).cast("array<string>").alias("warnings"), F.lit(source == "" if isinstance(source, str) else False).alias("selection_failed"))
    diff = F.abs(y("final_score") - w("final_score"))
    higher = lambda c: F.when(y(c) > w(c), "youtube").otherwise("whisper")
    if mode != "auto":
        name = "youtube" if mode == "manual" else mode
        s = y if name == "youtube" else w
        warn = F.array_distinct(F.concat(F.coalesce(s("flags"), F.array().cast("array<string>")), F.array_compact(F.array(F.when(s("hard_fail"), F.lit("USER_OVERRIDE_HARD_FAIL")), F.when(s("final_score") < minimum, F.lit("USER_OVERRIDE_BELOW_MINIMUM"))))))
        picked = F.when(s("final_score").isNull(), out("", "requested_source_missing")).otherwise(F.struct(F.lit(name).alias("selected_source"), F.lit("user_override").alias("selection_reason"), warn.alias("warnings"), F.lit(False).alias("selection_failed")))
    else:
        better = F.when(safe(y) & ~safe(w), "youtube").when(safe(w) & ~safe(y), "whisper").when(y("final_score") == w("final_score"), preferred).otherwise(higher("final_score"))
        picked = (
            F.when(usable(y) & ~usable(w), out("youtube", "only_usable")).when(usable(w) & ~usable(y), out("whisper", "only_usable"))
            .when(usable(y) & usable(w), F.when(diff >= margin, out(higher("final_score"), "score_margin")).when(y("source_type") == "manual", out("youtube", "tiebreak_manual", "AUTO_TIEBREAK_MANUAL_YOUTUBE"))
                .when(F.abs(y("coverage") - w("coverage")) >= coverage_margin, out(higher("coverage"), "tiebreak_coverage", "AUTO_TIEBREAK_COVERAGE"))
                .when(F.abs(y("max_uncovered") - w("max_uncovered")) >= gap_margin, out(F.when(y("max_uncovered") < w("max_uncovered"), "youtube").otherwise("whisper"), "tiebreak_uncovered_gap", "AUTO_TIEBREAK_UNCOVERED_GAP"))
                .when(F.abs(y("timeline") - w("timeline")) > 1e-9, out(higher("timeline"), "tiebreak_timeline", "AUTO_TIEBREAK_TIMELINE")).when(F.abs(y("readability") - w("readability")) > 1e-9, out(higher("readability"), "tiebreak_readability", "AUTO_TIEBREAK_READABILITY"))
                .when(diff > 1e-9, out(higher("final_score"), "tiebreak_final_score", "AUTO_TIEBREAK_FINAL_SCORE")).otherwise(out(preferred, "tiebreak_exact", "AUTO_TIEBREAK_EXACT_TIE")))
            .when(F.lit(below_minimum) & (safe(y) | safe(w)), out(better, "below_minimum", "AUTO_SELECTED_BELOW_MINIMUM")).otherwise(out("", "no_safe_source", "NO_HARD_SAFE_SUBTITLE_SOURCE"))
        )
    return picked, diff


def usable(scores: DataFrame, minimum: float = 70) -> DataFrame:
    """Adds hard_safe and usable."""
    return scores.withColumn("hard_safe", ~F.col("hard_fail")).withColumn("usable", ~F.col("hard_fail") & (F.col("final_score") >= minimum))


# Translations and bilingual tracks


def translation_qc(source: DataFrame, translated: DataFrame) -> DataFrame:
    """One row a video: faults of translated rows (video_id, id, start, end, translation, qc_flags) against source rows (video_id, id, start, end)."""
    w = W.partitionBy("video_id").orderBy("id")
    t = translated.withColumns({"here": F.lit(True), "dup": (F.trim("translation") != "") & (F.trim("translation") == F.trim(F.lag("translation").over(w))), "over": F.col("start") < F.lag("end").over(w)})
    both = source.select("video_id", "id", F.col("start").alias("s"), F.col("end").alias("e"), F.lit(True).alias("src")).join(t, ["video_id", "id"], "full_outer")
    ids = lambda c, name: F.array_sort(F.collect_list(F.when(F.coalesce(c, F.lit(False)), F.col("id")))).alias(name)
    moved = (F.abs(F.col("s") - F.col("start")) > 0.001) | (F.abs(F.col("e") - F.col("end")) > 0.001)
    n = lambda c, name: F.count_if(F.coalesce(c, F.lit(False))).alias(name)
    out = both.groupBy("video_id").agg(
        n(F.col("src"), "english_ids"), n(F.col("here"), "chinese_ids"), ids(F.col("src") & F.col("here").isNull(), "missing_ids"), ids(F.col("here") & F.col("src").isNull(), "extra_ids"), ids(F.col("here") & (F.trim("translation") == ""), "empty_translation_ids"),
        ids(F.col("dup"), "adjacent_duplicate_ids"), n(F.col("over"), "timeline_overlaps"), n(moved, "timeline_changed"), ids(F.col("translation").rlike(T.CONTROL), "illegal_control_character_ids"),
        ids(F.col("translation").rlike(r"([，。！？])\1+"), "unnatural_punctuation_ids"),
    )
    bad = sum((F.size(c) for c in ("missing_ids", "extra_ids", "empty_translation_ids", "illegal_control_character_ids")), F.col("timeline_overlaps") + F.col("timeline_changed"))
    return out.withColumn("status", F.when(bad == 0, "QC_PASSED").otherwise("REVIEW_REQUIRED"))


def flag_histogram(rows: DataFrame, keys: list[str] = ["video_id"], column: str = "qc_flags") -> DataFrame:  # noqa: B006
    """(keys, flag, n)."""
    return rows.select(*keys, F.explode(column).alias("flag")).groupBy(*keys, "flag").agg(F.count("*").alias("n"))


def reading_metrics(cues: DataFrame, keys: list[str] = TRACK, max_chars: int = 26, max_cps: float = 12.0) -> DataFrame:
    """One row a track: Chinese and Latin letters and their shares, overlong lines, fast cues, equal neighbours, repeated punctuation."""
    w = W.partitionBy(*keys).orderBy("cue_id")
    cjk, latin = T.cjk_count(F.col("text")), F.regexp_count("text", F.lit("[A-Za-z]"))
    df = cues.withColumns({
        "cjk": cjk, "latin": latin, "long": F.size(F.filter(F.split("text", "\n"), lambda x: F.length(F.regexp_replace(x, r"(?U)\s+", "")) > max_chars)), "fast": F.coalesce((F.col("end") > F.col("start")) & (cjk / (F.col("end") - F.col("start")) > max_cps), F.lit(False)),
        "dup": F.coalesce((F.trim("text") != "") & (F.trim("text") == F.trim(F.lag("text").over(w))), F.lit(False)), "rep": F.regexp_count("text", F.lit(r"([，。！？])\1+")),
    })
    out = df.groupBy(*keys).agg(
        F.count("*").alias("segment_count"), F.sum("cjk").cast("bigint").alias("cjk_character_count"), F.sum("latin").cast("bigint").alias("ascii_letter_count"), F.sum("long").cast("bigint").alias("overlong_line_count"), F.count_if("fast").alias("fast_reading_cue_count"),
        F.count_if("dup").alias("adjacent_duplicate_count"), F.sum("rep").cast("bigint").alias("repeated_punctuation_count"),
    )
    real = F.greatest(F.col("cjk_character_count") + F.col("ascii_letter_count"), F.lit(1))
    return out.withColumns({"cjk_ratio": F.round(F.col("cjk_character_count") / real, 6), "english_leakage_ratio": F.round(F.col("ascii_letter_count") / real, 6)})


def source_bonus(name: Column) -> Column:
    n = F.lower(name)
    return F.when(n == "zh.clean.srt", 6.0).when(n == "zh.raw.srt", 1.0).when(n.isin("zh.auto.srt", "zh.youtube.clean.srt"), -6.0).otherwise(0.0)


def chinese_score(metrics: DataFrame, qc: DataFrame | None = None) -> DataFrame:
    """Adds `score`, 0 to 120, to reading metrics of tracks; `qc` (video_id, status, critical_flags) counts for the cleaned track."""
    n = F.greatest(F.col("segment_count"), F.lit(1))
    cut = lambda most, x: F.least(F.lit(float(most)), x)
    score = 100.0 + source_bonus(F.col("track")) - F.col("english_leakage_ratio") * 30.0 - cut(20, F.col("overlong_line_count") / n * 40.0) - cut(20, F.col("fast_reading_cue_count") / n * 35.0)
    score = score - cut(10, F.col("adjacent_duplicate_count") * 2.5) - cut(10, F.col("repeated_punctuation_count") * 1.5)
    if qc is not None:
        metrics = metrics.join(qc.select("video_id", F.col("status").alias("__s"), F.col("critical_flags").alias("__f")), "video_id", "left")
        own = F.lower("track") == "zh.clean.srt"
        score = score + F.when(own & (F.col("__s") == "QC_PASSED"), 4.0).otherwise(0.0) - F.when(own, cut(30, F.coalesce("__f", F.lit(0)) * 5.0)).otherwise(0.0)
    return metrics.withColumn("score", F.round(F.greatest(F.lit(0.0), F.least(F.lit(120.0), score)), 3)).drop("__s", "__f")


def best_chinese(candidates: DataFrame) -> DataFrame:
    """One row a video from (video_id, track, ordinal, exists, validation_status, score): the best eligible track, ties by order, or an error code."""
    fit = F.col("exists") & (F.col("validation_status") == "PASSED")
    out = candidates.groupBy("video_id").agg(F.max(F.when(fit, F.struct("score", (-F.col("ordinal")).alias("o"), "track"))).alias("b"), F.bool_or("exists").alias("any"))
    return out.select("video_id", F.col("b.track").alias("track"), F.col("b.score").alias("score"), F.when(F.col("b").isNotNull(), F.lit(None).cast("string")).when(F.col("any"), "NO_VALID_CHINESE_SUBTITLE").otherwise("CHINESE_SUBTITLE_NOT_FOUND").alias("error"))


def track_pairs(tracks: DataFrame) -> DataFrame:
    """(video_id, english, english_order, chinese, chinese_order): every English with every Chinese track of a video, from (video_id, track, language, ordinal): a handful each."""
    side = lambda code, name: tracks.where(F.col("language") == code).select("video_id", F.col("track").alias(name), F.col("ordinal").alias(f"{name}_order"))
    return side("en", "english").join(side("zh", "chinese"), "video_id")


def recovery_scores(pairs: DataFrame, cues: DataFrame, minimum_pairs: float = 0.85, minimum_cjk: float = 0.5) -> DataFrame:
    """track_pairs with paired counts, ratios, eligibility, score (at most 105) and reject reason; `cues` is (video_id, track, cue_id, start, end, text), translations aligned."""
    keys = ["video_id", "english", "chinese"]
    en = pairs.join(cues.withColumnRenamed("track", "english"), ["video_id", "english"]).select(*keys, "cue_id", "start", "end", "text")
    zh = pairs.join(cues.withColumnRenamed("track", "chinese"), ["video_id", "chinese"]).select(*keys, "cue_id", "start", "end", "text")
    paired = pair_by_times(en, zh, keys).groupBy(*keys).agg(F.count("*").alias("paired"), F.sum(T.cjk_count(F.col("other"))).alias("cjk"), F.sum(F.regexp_count("other", F.lit("[A-Za-z]"))).alias("latin"))
    total = en.groupBy(*keys).agg(F.count("*").alias("english_segments"))
    out = pairs.join(total, keys, "left").join(paired, keys, "left").fillna(0, ["english_segments", "paired", "cjk", "latin"])
    share, cjk = F.col("paired") / F.greatest(F.col("english_segments"), F.lit(1)), F.col("cjk") / F.greatest(F.col("cjk") + F.col("latin"), F.lit(1))
    why = F.when(F.col("paired") == 0, "NO_ALIGNED_SEGMENTS").when(share < minimum_pairs, "PAIR_COVERAGE_BELOW_MINIMUM").when(cjk < minimum_cjk, "CHINESE_CONTENT_RATIO_BELOW_MINIMUM").otherwise("")
    bonus = F.greatest(F.lit(0.0), 4.0 - F.col("english_order") - F.col("chinese_order")) + F.least(F.lit(5.0), F.log10(F.col("paired") + 1.0) * 2.5)
    return out.withColumns({"pair_ratio": F.round(share, 6), "cjk_ratio": F.round(cjk, 6), "rejection_reason": why, "eligible": why == "", "score": F.when(why == "", F.round(F.least(F.lit(105.0), 70.0 + share * 15.0 + cjk * 10.0 + bonus), 3))})


def resolve_inputs(flags: DataFrame) -> DataFrame:
    """Adds `resolution` to (video_id, english_exists, reviewed_exists, best_track, recovered): reviewed, then a valid candidate, then recovery, else an error code."""
    r = F.when(F.col("english_exists") & F.col("reviewed_exists"), "reviewed").when(F.col("english_exists") & F.col("best_track").isNotNull(), "candidate").when(F.col("recovered"), "recovered")
    return flags.withColumn("resolution", r.when(~F.col("english_exists"), "ENGLISH_SUBTITLE_NOT_FOUND").otherwise("CHINESE_SUBTITLE_NOT_FOUND"))
