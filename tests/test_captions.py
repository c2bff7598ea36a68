import random

from pyspark.sql import functions as F

from cuefold.operators import alignment, captions, folds, intervals, quality
from cuefold.sources import captions as files
from cuefold.sources import sinks

CUE = "video_id string, cue_id int, start double, end double, text string"


def cues(spark, *texts, step=2.0):
    return spark.createDataFrame([("v", i, i * step, (i + 1) * step, t) for i, t in enumerate(texts)], CUE)


def test_rolling_increment(spark):
    rows = captions.rolling_increment(cues(spark, "hello there", "hello there my friend", "my friend how are you", "my friend how are you", "are you", "你好世界", "世界和平", "x")).orderBy("cue_id").collect()
    assert [(r["delta"], r["removed"], r["reason"]) for r in rows] == [
        ("hello there", 0, "new"), ("my friend", 2, "prefix"), ("how are you", 2, "words"), ("", 5, "exact"), ("", 2, "suffix"), ("你好世界", 0, "new"), ("和平", 2, "characters"), ("x", 0, "new"),
    ]


def test_short_and_empty_cues_are_passed_over(spark):
    df = spark.createDataFrame([("v", 0, 0.0, 2.0, "one two"), ("v", 1, 2.0, 2.01, "one two three"), ("v", 2, 2.0, 4.0, " "), ("v", 3, 4.0, 6.0, "one two three")], CUE)
    assert [r["delta"] for r in captions.rolling_increment(df).orderBy("cue_id").collect()] == ["one two", "three"]
    stats = captions.cleaning_stats(df).first()
    assert (stats["input_cues"], stats["empty_removed"], stats["transition_removed"], stats["rolling_cues_reduced"], stats["rolling_units_removed"]) == (4, 1, 1, 1, 2)


def test_timed_and_fuzzy_increment(spark):
    texts = ["we go now", "we go now to the shop", "", "go now to the shop", "the shop today", "alpha beta gamma delta", "beta gamma delta epsilon zeta"]
    rows = captions.timed_increment(cues(spark, *texts)).orderBy("cue_id").collect()
    assert [(r["increment"], r["reason"]) for r in rows] == [("we go now", "new"), ("to the shop", "prefix"), ("", "empty"), ("", "contained"), ("today", "suffix_prefix"), ("alpha beta gamma delta", "new"), ("epsilon zeta", "suffix_prefix")]
    near = spark.createDataFrame([("v", 0, 0.0, 2.0, "one two three four five six"), ("v", 1, 2.0, 2.5, "other"), ("v", 2, 2.1, 4.0, "one two three four five sixx six")], CUE)
    assert captions.fuzzy_increment(near).orderBy("cue_id").collect()[2]["reason"] == "fuzzy"


def test_word_times(spark):
    df = spark.createDataFrame([("v", 0, 1.0, 3.0, "so<00:00:02.000><c> we go</c>"), ("v", 1, 3.0, 5.0, "plain words")], CUE)
    got = captions.cue_words(df).orderBy("cue_id").collect()
    assert [(w["text"], w["start"], w["end"]) for w in got[0]["words"]] == [("so", 1.0, 2.0), ("we", 2.0, 2.5), ("go", 2.5, 3.0)]
    assert [(w["text"], w["start"], w["end"]) for w in got[1]["words"]] == [("plain", 3.0, 4.0), ("words", 4.0, 5.0)]
    events = captions.word_events(captions.cue_words(df)).orderBy("cue_id", "n").collect()
    assert [e["text"] for e in events] == ["so", "we", "go", "plain", "words"]


def pushed(rows):
    """Cues pushed apart one after the other."""
    out, end = [], 0.0
    for s, e in rows:
        s = max(s, end)
        end = max(s + 0.05, e)
        out.append([s, end])
    for i, x in enumerate(out):
        if x[1] - x[0] < 1.0:
            x[1] = max(x[1], min(x[0] + 1.0, out[i + 1][0] if i + 1 < len(out) else x[0] + 1.0))
    return out


def test_fix_timeline_is_the_fold(spark):
    rng = random.Random(4)
    rows, want = [], {}
    for v in range(60):
        own = sorted((round(rng.uniform(0, 20), 3), 0) for _ in range(rng.randrange(1, 12)))
        own = sorted((s, round(s + rng.uniform(-0.2, 4), 3)) for s, _ in own)
        rows += [(f"v{v}", i, s, e, f"w{i}") for i, (s, e) in enumerate(own)]
        want[f"v{v}"] = pushed(own)
    got = {}
    for r in captions.fix_timeline(spark.createDataFrame(rows, CUE)).orderBy("video_id", "cue_id").collect():
        got.setdefault(r["video_id"], []).append([r["start"], r["end"]])
    assert all(abs(a - b) < 1e-6 for v in want for x, y in zip(want[v], got[v], strict=True) for a, b in zip(x, y, strict=True))


def test_long_cues_split(spark):
    df = spark.createDataFrame([("v", 0, 0.0, 15.0, "a b c d e"), ("v", 1, 15.0, 30.0, "xy")], CUE)
    rows = captions.split_long(df).orderBy("cue_id").collect()
    assert [(r["text"], r["start"], r["end"]) for r in rows] == [("a b", 0.0, 5.0), ("c", 5.0, 10.0), ("d e", 10.0, 15.0), ("x", 15.0, 20.0), ("y", 25.0, 30.0)]


def test_folds(spark):
    out = folds.fragments(cues(spark, "one two", "one two", "one two three", "three", "new thing")).orderBy("cue_id").collect()
    assert [(r["text"], r["start"], r["end"]) for r in out] == [("one two", 0.0, 4.0), ("three", 4.0, 8.0), ("new thing", 8.0, 10.0)]
    merged = folds.merge_fragments(cues(spark, "we went", "to town.", "Then home.", "Done", step=2.0)).orderBy("cue_id").collect()
    assert [r["text"] for r in merged] == ["we went to town.", "Then home.", "Done"]
    words = [("v", 0, i, w, s, s + 0.3) for i, (w, s) in enumerate([("Hello", 0.0), ("world.", 0.4), ("And", 0.8), ("then", 2.0), ("more", 2.4)])]
    df = spark.createDataFrame(words, "video_id string, cue_id int, n int, text string, start double, end double")
    seg = folds.segment_sentences(df).orderBy("cue_id")
    assert [r["text"] for r in seg.collect()] == ["Hello world.", "And", "then more"]
    again = folds.rebuild_timeline(seg).orderBy("cue_id").collect()
    assert [r["cue_id"] for r in again] == list(range(1, len(again) + 1)) and all(r["end"] > r["start"] for r in again)
    assert all(b["start"] >= a["end"] for a, b in zip(again, again[1:], strict=False))


def long_track(rng, n):
    """Words with pauses of many lengths, sentence ends, commas, repeats, tags and tiny words, in a few cues each."""
    words, at = [], 0.0
    for i in range(n):
        at += rng.choice([0.0, 0.05, 0.05, 0.3, 0.7, 1.5])
        last = at + rng.choice([0.05, 0.2, 0.5, 1.2])
        words.append(("v", i // 7, i % 7, rng.choice(["one", "Two", "<i>three</i>", "four,", "five.", "no!", "a", "und", "so;"]), round(at, 3), round(last, 3)))
        at = last - rng.choice([0.0, 0.0, 0.1])
    return words


def test_stretches_of_long_tracks(spark):
    """A long track cut in stretches gives what the fold over the whole track gives, for all four folds, beside a short track."""
    rng = random.Random(13)
    rows = long_track(rng, 1_500) + [("w", *r[1:]) for r in long_track(rng, 20)]
    words = spark.createDataFrame(rows, "video_id string, cue_id int, n int, text string, start double, end double").repartition(3)
    got = lambda df: sorted(map(str, df.collect()))
    assert got(folds.segment_sentences(words, long=40)) == got(folds.segment_sentences(words))
    cues_ = words.groupBy("video_id", "cue_id").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "text"))), lambda x: x["text"]), " ").alias("text"))
    shifted = cues_.withColumns({"start": F.col("start") + F.floor(F.col("cue_id") / 3), "end": F.col("end") + F.floor(F.col("cue_id") / 3)})
    for c in (cues_, shifted):
        assert got(folds.fragments(c, long=20)) == got(folds.fragments(c))
        assert got(folds.merge_fragments(c, long=20)) == got(folds.merge_fragments(c))
    seg = folds.segment_sentences(words)
    late = F.col("start") + F.floor(F.col("cue_id") / 2) * 1.3 - F.col("start")
    moved = seg.withColumns({k: F.round(F.col(k) + late, 3) for k in ("start", "end", "word_start", "word_end")})
    media = spark.createDataFrame([("v", 500.0), ("w", 9.0)], "video_id string, duration double")
    for x in (seg, moved):
        for durations in (None, media):
            assert got(folds.rebuild_timeline(x, durations=durations, long=30)) == got(folds.rebuild_timeline(x, durations=durations))
    cut = folds._cut(words, ["video_id"], ["cue_id", "n"], lambda before, top, after: F.col("start") - before["end"] > 0.6)
    assert cut.select("video_id", "_stretch").distinct().count() > 200 and cut.where("_stretch IS NULL OR _stretch < 1").count() == 0


def test_intervals_against_points(spark):
    rng = random.Random(6)
    a = [(f"v{rng.randrange(5)}", float(s), float(s + rng.randrange(0, 30))) for s in (rng.randrange(-5, 200) for _ in range(120))]
    b = [(f"v{rng.randrange(5)}", float(s), float(s + rng.randrange(0, 9))) for s in (rng.randrange(0, 200) for _ in range(120))]
    left, right = (spark.createDataFrame(x, "video_id string, start double, end double") for x in (a, b))
    points = lambda rows, v: {p for k, s, e in rows if k == v for p in range(max(0, int(s)), int(e))}
    total = {r["video_id"]: r["seconds"] for r in intervals.length(left, ["video_id"]).collect()}
    for bucket, stretch in ((None, None), (7.0, 10.0), (1000.0, 45.0)):
        both = {r["video_id"]: r["seconds"] for r in intervals.intersection_length(left, right, ["video_id"], bucket, stretch).collect()}
        gaps = {r["video_id"]: r["seconds"] for r in intervals.longest_gap(left, right, ["video_id"], bucket, stretch).collect()}
        for v in {k for k, _, _ in a}:
            mine, other = points(a, v), points(b, v)
            assert total[v] == len(mine) and both.get(v, 0) == len(mine & other)
            run = best = 0
            for p in range(300):
                run = run + 1 if p in mine and p not in other else 0
                best = max(best, run)
            assert gaps[v] == best
    pairs = intervals.overlap_join(left.withColumn("i", F.monotonically_increasing_id()), right.withColumn("i", F.monotonically_increasing_id()), ["video_id"], 7.0)
    assert pairs.count() == pairs.distinct().count() == sum(1 for k, s, e in a for m, x, y in b if k == m and min(e, y) > max(s, x))


def test_union_by_stretches(spark):
    """Intervals over many stretches, touching ones, ones inside others and empty stretches give the islands of the plain union."""
    rng = random.Random(8)
    rows = []
    for v in range(40):
        span = rng.choice([1, 5, 40, 900])
        rows += [(f"v{v}", float(s), float(s + rng.choice([0, 1, rng.randrange(1, span + 1)]))) for s in (rng.randrange(-3, 1000) for _ in range(rng.choice([1, 3, 60])))]
    df = spark.createDataFrame(rows, "video_id string, start double, end double")
    plain = {}
    for v, s, e in sorted((v, max(0.0, s), max(0.0, e)) for v, s, e in rows if e > s):
        own = plain.setdefault(v, [])
        if own and s <= own[-1][1]:
            own[-1][1] = max(own[-1][1], e)
        else:
            own.append([s, e])
    want = sorted((v, *x) for v, own in plain.items() for x in own)
    for stretch in (None, 1.0, 10.0, 333.0, 1e6):
        assert sorted(map(tuple, intervals.union(df, ["video_id"], stretch).collect())) == want


def test_no_task_holds_a_hot_track(spark):
    df = spark.range(40_000).selectExpr("concat('v', id % 1) AS video_id", "cast(id AS double) AS start", "id + if(id % 10 = 0, 0.5, 1D) AS end")
    out = intervals.union(df, ["video_id"], 1000.0)
    plan = out._jdf.queryExecution().executedPlan().toString()
    windows = [x for x in plan.split("\n") if "windowspecdefinition" in x]
    assert out.count() == 4_001 and windows and all("stretch" in x for x in windows)


def test_assignment(spark):
    en = spark.createDataFrame([("v", 0, 0.0, 2.0, "a"), ("v", 1, 2.0, 4.0, "b"), ("v", 2, 10.0, 12.0, "c")], CUE)
    zh = spark.createDataFrame([("v", 0, 0.5, 2.5, "甲"), ("v", 1, 1.0, 3.0, "乙"), ("v", 2, 7.5, 8.0, "丙"), ("v", 3, 5.0, 6.0, "丁"), ("w", 0, 0.0, 1.0, "x")], CUE)
    got = {r["piece_id"]: r["cue_id"] for r in alignment.assign_by_overlap(en, zh).collect()}
    assert got == {0: 0, 1: 0, 2: 2, 3: 1}
    assert {r["cue_id"]: r["text"] for r in alignment.align_translation(en, zh).collect()} == {0: "甲乙", 1: "丁", 2: "丙"}


def strict(spark, en, zh, **options):
    both = files.parse_srt_strict(spark.createDataFrame([("v", "en", en), ("v", "zh", zh)], "video_id string, track string, content string"))
    good = both.where("not malformed")
    bad = both.groupBy("video_id").agg(F.max(F.col("malformed").cast("int")).alias("malformed"), F.max(F.col("control").cast("int")).alias("controls"))
    return alignment.validate_pair(good.where("track = 'en'"), good.where("track = 'zh'"), bad, **options).first()


def test_pair_validation(spark):
    a = "1\n00:00:00,000 --> 00:00:01,000\nHello\n\n2\n00:00:01,100 --> 00:00:02,000\nWorld\n"
    z = a.replace("Hello", "你好").replace("World", "世界")
    assert strict(spark, a, z)["validation_status"] == "PASSED"
    assert strict(spark, a, z.replace("01,100", "01,120"))["validation_status"] == "PASSED"
    assert strict(spark, a, z.replace("01,100", "01,121"))["validation_status"] == "SUBTITLE_TIMELINE_MISMATCH"
    lost = strict(spark, a, z.split("\n\n")[0])
    assert lost["validation_status"] == "SUBTITLE_ID_MISMATCH" and lost["missing_chinese_ids"] == ["2"]
    assert strict(spark, a, z.replace("世界", ""))["empty_chinese_ids"] == ["2"]
    assert strict(spark, a, z.replace("世界", "\x07界"))["validation_status"] == "SUBTITLE_VALIDATION_FAILED"
    late = spark.createDataFrame([("v", 1.5)], "video_id string, duration double")
    assert strict(spark, a, z, durations=late)["invalid_timestamp_ids"] == ["2"]
    assert strict(spark, a, z.replace("\n2\n", "\n1\n"))["chinese_duplicate_ids"] == ["1"]


def test_caption_files(spark):
    vtt = "WEBVTT\n\nNOTE 00:00:00.000 --> 00:00:09.000\nnot a cue\n\n00:00:00.500 --> 00:00:02.000 align:start\n\nfirst &amp; line\nmore<00:00:01.000><c> words</c>\n\n00:01.500 --> 00:02.000\n00:02.000 --> 00:03.000\nlast\n"
    rows = files.parse_vtt(spark.createDataFrame([("v", "en.vtt", vtt)], "video_id string, track string, content string")).orderBy("cue_id").collect()
    assert [(r["cue_id"], r["start"], r["end"], r["text"]) for r in rows] == [(1, 0.5, 2.0, "first & line more words"), (2, 1.5, 2.0, ""), (3, 2.0, 3.0, "last")]
    srt = "7\r\n00:00:00,000 --> 00:00:01,000\r\none\r\ntwo\r\n\r\nx\n00:00:02.000 --> 00:00:03.000\n\nlost\n"
    files_df = spark.createDataFrame([("v", "en.srt", srt)], "video_id string, track string, content string")
    rows = files.parse_srt(files_df).orderBy("cue_id").collect()
    assert [(r["cue_id"], r["start"], r["text"]) for r in rows] == [(1, 0.0, "one two"), (2, 2.0, "")]
    seen = files.inspect_srt(files_df).first()
    assert (seen["blocks"], seen["invalid_ids"], seen["invalid_timing_lines"], seen["empty_blocks"]) == (3, 2, 2, 2)
    blocks = files.parse_srt_strict(files_df)
    assert files.strict_diagnostics(blocks).first()["malformed_blocks"] == [3]


def test_round_trip_of_written_files(spark, tmp_path):
    df = cues(spark, "hello world", "and now a much longer text that needs to be broken in two lines", "end")
    sinks.write_texts(sinks.srt_texts(df, ["video_id"]).withColumn("track", F.lit("en.srt")).select("video_id", "track", "content"), str(tmp_path / "out"), ["video_id", "track"])
    back = spark.read.text(str(tmp_path / "out"), wholetext=True).select("video_id", "track", F.col("value").alias("content"))
    again = files.parse_srt(back).orderBy("cue_id").select("start", "end", "text").collect()
    assert [tuple(r) for r in again] == [tuple(r) for r in df.orderBy("cue_id").select("start", "end", "text").collect()]


def test_recogniser_words(spark):
    schema = "video_id string, id int, start double, end double, text string, words array<struct<word:string,start:double,end:double,probability:double>>"
    rows = [("v", 0, 0.1, 1.0, "Hello world .", [("Hello", 0.1, 0.5, 0.9), ("world .", 0.5, 1.0, 0.8)]), ("v", 1, 1.0, 3.0, "no times here", None), ("v", 2, 3.0, 4.0, "half", [("half", None, 4.0, 0.5)])]
    got = files.asr_words(spark.createDataFrame(rows, schema)).orderBy("cue_id", "n").collect()
    assert [(r["text"], r["timestamps_approximated"]) for r in got] == [("Hello", False), ("world.", False), ("no", True), ("times", True), ("here", True), ("half", True)]
    assert abs(got[2]["end"] - (1 + 2 / 3)) < 1e-9


def scored(spark, rows, speech, source="youtube", kind="manual", extra=None):
    c = spark.createDataFrame(rows, "video_id string, track string, cue_id int, start double, end double, text string")
    empty = spark.createDataFrame([], "video_id string, track string, duplicate_ids int, invalid_ids int, invalid_timing_lines int, empty_blocks int, long_lines int, too_many_lines int")
    qc = spark.createDataFrame([(rows[0][0], rows[0][1], source, kind)], "video_id string, track string, source string, source_type string")
    for name in ("continuous_repeated_phrases", "under_0_3_seconds", "high_no_speech_segments", "low_confidence_words", "word_count"):
        qc = qc.withColumn(name, F.lit(0))
    for name in ("average_word_probability", "average_log_probability", "average_no_speech_probability", "word_timestamp_missing_rate", "coverage_ratio", "agreement"):
        qc = qc.withColumn(name, F.lit((extra or {}).get(name)).cast("double"))
    talk = spark.createDataFrame(speech, "video_id string, start double, end double")
    audio = spark.createDataFrame([(rows[0][0], 10.0)], "video_id string, duration double")
    return quality.caption_scores(c, empty, talk, audio, qc)


def test_caption_scores(spark):
    good = scored(spark, [("v", "en", 1, 0.0, 2.0, "A good caption.")], [("v", 0.0, 2.0)]).first()
    assert not good["hard_fail"] and (good["structure"], good["coverage"], good["source_confidence"]) == (100.0, 100.0, 95.0) and good["final_score"] == 99.0
    bad = scored(spark, [("v", "en", 1, 0.0, 0.2, "a"), ("v", "en", 2, 0.1, 0.3, "b")], [("v", 0.0, 10.0)]).first()
    assert bad["hard_fail"] and bad["hard_fail_reasons"] == ["OVERLAPS_REMAIN", "SPEECH_COVERAGE_BELOW_MINIMUM"]
    assert bad["timeline"] == 76.0 and bad["readability"] == 96.0 and bad["max_uncovered"] == 9.7


def decision(spark, youtube, whisper, **options):
    cols = ["final_score", "hard_fail", "source_type", "coverage", "timeline", "readability", "max_uncovered", "flags"]
    rows = [("v", s, *[{"final_score": 80.0, "hard_fail": False, "source_type": "auto", "coverage": 90.0, "timeline": 90.0, "readability": 90.0, "max_uncovered": 1.0, "flags": []}[c] if c not in d else d[c] for c in cols]) for s, d in (("youtube", youtube), ("whisper", whisper)) if d is not None]
    schema = "video_id string, source string, final_score double, hard_fail boolean, source_type string, coverage double, timeline double, readability double, max_uncovered double, flags array<string>"
    r = quality.choose_source(spark.createDataFrame(rows, schema), **options).first()
    return r["selected_source"], r["selection_reason"], r["warnings"]


def test_source_choice(spark):
    assert decision(spark, {"final_score": 90.0}, {})[:2] == ("youtube", "score_margin") and decision(spark, {"hard_fail": True}, {})[:2] == ("whisper", "only_usable")
    assert decision(spark, {"source_type": "manual"}, {"final_score": 84.0})[0] == "youtube" and decision(spark, {}, {"coverage": 93.5})[:2] == ("whisper", "tiebreak_coverage")
    assert decision(spark, {"max_uncovered": 5.0}, {})[:2] == ("whisper", "tiebreak_uncovered_gap") and decision(spark, {"timeline": 91.0}, {})[:2] == ("youtube", "tiebreak_timeline")
    assert decision(spark, {"readability": 89.0}, {})[:2] == ("whisper", "tiebreak_readability") and decision(spark, {"final_score": 81.0}, {})[:2] == ("youtube", "tiebreak_final_score") and decision(spark, {}, {})[:2] == ("whisper", "tiebreak_exact")
    assert decision(spark, {"final_score": 60.0}, {"final_score": 65.0}) == ("whisper", "below_minimum", ["AUTO_SELECTED_BELOW_MINIMUM"])
    assert decision(spark, {"hard_fail": True}, None) == ("", "no_safe_source", ["NO_HARD_SAFE_SUBTITLE_SOURCE"])
    assert decision(spark, {"final_score": 50.0, "hard_fail": True, "flags": ["X"]}, {}, mode="youtube")[2] == ["X", "USER_OVERRIDE_HARD_FAIL", "USER_OVERRIDE_BELOW_MINIMUM"]


def test_agreement(spark):
    a, b = cues(spark, "same words", "other text"), cues(spark, "same words", "other text")
    assert quality.agreement(a, b).first()["agreement"] == 100.0
    far = b.withColumns({"start": F.col("start") + 100, "end": F.col("end") + 100})
    assert quality.agreement(a, far).first()["agreement"] == 100.0
    assert quality.agreement(a, b.limit(0)).first()["agreement"] == 0.0


def test_sources_meet_once(spark):
    """Three modes of one table: one exchange, nothing put together before it, as many tasks as asked for; before, each reading task sorted its rows for a sum of nothing."""
    rows = [(i, s, float(60 + (i * k) % 40), False, "auto", 90.0, 80.0, 70.0, 1.0, ["LOW"]) for i in range(40) for k, s in ((7, "youtube"), (11, "whisper")) if (i + k) % 9]
    df = spark.createDataFrame(rows, "video_id int, source string, final_score double, hard_fail boolean, source_type string, coverage double, timeline double, readability double, max_uncovered double, flags array<string>")
    got = quality.choose_sources(df, ["auto", "manual", "whisper"], 7)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and plan.rindex("Aggregate") < plan.index("Exchange") and got.rdd.getNumPartitions() == 7
    for mode in ("auto", "manual", "whisper"):
        assert sorted(map(repr, got.where(F.col("mode") == mode).drop("mode").collect())) == sorted(map(repr, quality.choose_source(df, mode).collect()))
