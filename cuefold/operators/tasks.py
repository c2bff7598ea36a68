"""Tasks, manifests, jobs, checkpoints and renders: states, joins and roll-ups.

A task is a folder of one video. manifests: (task, stage, video_id, title, channel, overall_status, ..., errors); files: (task, path, size).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cuefold.functions import layout
from cuefold.functions import publishing as P

STAGES = ("download", "english", "translation", "render", "publish")
REQUIRED = ("video/source.mp4", "metadata/info.json", "audio/source_audio.wav")
VIDEO_FILES = r"(?i)\.(mp4|mkv|mov|webm|m4v)$"


def file_flags(files: DataFrame, names: list[str]) -> DataFrame:
    """(task, names...): true where a file of that path is there and not empty."""
    return files.where(F.col("path").isin(names)).groupBy("task").agg(*[F.bool_or((F.col("path") == n) & (F.col("size") > 0)).alias(n) for n in names])


def completeness(manifests: DataFrame, files: DataFrame, require_audio: bool = True) -> DataFrame:
    """manifests with `complete`: status success, captions cleaned or missing, all required files there."""
    names = [*REQUIRED[: 3 if require_audio else 2]]
    some = files.groupBy("task").agg(F.count_if(F.col("path").isin(names) & (F.col("size") > 0)).alias("__n"), F.bool_or(F.col("path") == "metadata/description.txt").alias("__d"))
    good = (F.col("overall_status") == "success") & F.col("subtitle_clean_status").isin("success", "missing") & (F.col("__n") == len(names)) & F.col("__d")
    return manifests.join(some, "task", "left").withColumn("complete", F.coalesce(good, F.lit(False))).drop("__n", "__d")


def manifest_join(download: DataFrame, *others: DataFrame) -> DataFrame:
    """The download manifests with those of the later stages, by task."""
    out = download
    for other in others:
        out = out.join(other, "task", "left")
    return out


def _state(complete: Column, failed: Column) -> Column:
    return F.when(F.coalesce(complete, F.lit(False)), "complete").when(F.coalesce(failed, F.lit(False)), "failed").otherwise("pending")


def stage_states(rows: DataFrame) -> DataFrame:
    """Adds the five stage states, `progress` and `overall` to joined manifests: (task, download_status, english_ready, translation_ready, selected_output, translation_status, stage3_errors, stage4_status, stage4_qc, publish_status)."""
    failed3 = F.size(F.coalesce("stage3_errors", F.array().cast("array<string>"))) > 0
    review = (F.col("stage4_status") == "REVIEW_REQUIRED") | (F.col("stage4_qc") == "REVIEW_REQUIRED")
    out = rows.withColumns({
        "download": _state(F.col("download_status").isin("success", "skipped"), F.col("download_status").isin("failed", "partial_success")),
        "english": _state(F.col("english_ready"), failed3 & (F.coalesce("selected_output", F.lit("")) == "")),
        "translation": _state(F.col("translation_ready"), failed3 & F.col("translation_status").startswith("FAILED")),
        "render": F.when(F.coalesce(review, F.lit(False)), "review").otherwise(_state(F.col("stage4_status") == "STAGE4_COMPLETED", F.col("stage4_status") == "FAILED")),
        "publish": F.when(F.col("publish_status") == "RUNNING", "active").otherwise(_state(F.col("publish_status") == "PUBLISHED", F.col("publish_status") == "FAILED")),
    })
    done = sum((F.col(s).isin("complete", "review").cast("int") for s in STAGES), F.lit(0))
    label = (
        F.when(F.col("publish") == "complete", "published").when(F.col("publish") == "active", "publishing").when(F.col("publish") == "failed", "publish_failed").when(F.col("render") == "complete", "rendered").when(F.col("render") == "review", "needs_review")
        .when(F.array_contains(F.array(*STAGES), "failed"), "failed").when(F.col("translation") == "complete", "bilingual").when(F.col("english") == "complete", "english").when(F.col("download") == "complete", "downloaded").otherwise("waiting")
    )
    return out.withColumns({"progress": (done * 20).cast("int"), "overall": label})


def download_status(metadata_only: Column, subtitles_only: Column, require_audio: Column) -> Column:
    """The overall status from the part statuses (metadata_status, video_status, probe_status, audio_status, subtitle_status, subtitle_clean_status, srt_status, track_srt_failed)."""
    ok = F.col("metadata_status") == "success"
    captions = (F.col("subtitle_clean_status") == "failed") | (F.col("srt_status") == "failed") | F.col("track_srt_failed")
    subs = F.when(~ok, "failed").when(captions, "partial_success").when(F.col("subtitle_status").isin("success", "missing"), "success").otherwise("partial_success")
    full = F.when(~ok | (F.col("video_status") != "success"), "failed").when((F.col("probe_status") != "success") | (require_audio & (F.col("audio_status") != "success")) | captions, "partial_success").otherwise("success")
    return F.when(metadata_only, F.when(ok, "success").otherwise("failed")).when(subtitles_only, subs).otherwise(full)


def translation_ready(stage3: DataFrame, files: DataFrame) -> DataFrame:
    """(task, translation_ready): a good status and a finished Chinese file that is not empty."""
    some = files.where(F.col("path").isin("subtitles/zh.reviewed.srt", "subtitles/zh.clean.srt") & (F.col("size") > 0)).select("task").distinct().withColumn("__f", F.lit(True))
    good = F.upper(F.coalesce("translation_status", F.lit(""))).isin("QC_PASSED", "REVIEW_REQUIRED", "TRANSLATION_COMPLETED") & F.col("__f").isNotNull()
    return stage3.join(some, "task", "left").select("task", good.alias("translation_ready"))


def auto_captions(download: DataFrame, files: DataFrame) -> DataFrame:
    """(task, auto_path): the first automatic Chinese track that is there, where the manifest or a raw file says that there is one."""
    order = ["subtitles/zh.youtube.clean.srt", "subtitles/zh.auto.srt", "subtitles/zh.auto.vtt"]
    best = first_existing(files, order).withColumnRenamed("path", "auto_path")
    raw = files.where(F.col("path").isin(order[1:]) & (F.col("size") > 0)).select("task").distinct().withColumn("__raw", F.lit(True))
    known = (F.lower(F.coalesce("zh_source", F.lit(""))) == "auto") | F.col("__raw").isNotNull()
    return download.join(raw, "task", "left").join(best, "task", "left").select("task", F.when(known, F.col("auto_path")).alias("auto_path"))


def first_existing(files: DataFrame, order: list[str]) -> DataFrame:
    """(task, path): of the paths of `order` the first that is there and not empty."""
    place = F.array_position(F.array(*[F.lit(p) for p in order]), F.col("path"))
    return files.where(F.col("path").isin(order) & (F.col("size") > 0)).groupBy("task").agg(F.min_by("path", place).alias("path"))


def unique_source(files: DataFrame) -> DataFrame:
    """(task, path, error) from (task, level, path): the one video of the first level that names any; several of a level are ambiguous. Rendered files and those of stage4 do not count."""
    real = files.where(F.col("path").rlike(VIDEO_FILES) & ~F.lower("path").contains("stage4/") & ~F.lower("path").rlike("hardsub|softsub|bilingual"))
    per = real.groupBy("task", "level").agg(F.count_distinct("path").alias("n"), F.min("path").alias("p"))
    first = per.groupBy("task").agg(F.min_by(F.struct("n", "p"), "level").alias("b"))
    every = files.select("task").distinct().join(first, "task", "left")
    return every.select("task", F.when(F.col("b.n") == 1, F.col("b.p")).alias("path"), F.when(F.col("b").isNull(), "SOURCE_VIDEO_NOT_FOUND").when(F.col("b.n") > 1, "AMBIGUOUS_SOURCE_VIDEO").alias("error"))


def last_errors(*columns: str, most: int = 5) -> Column:
    """The last `most` errors that are not blank, over arrays in the order of the stages."""
    every = F.filter(F.concat(*[F.coalesce(c, F.array().cast("array<string>")) for c in columns]), lambda e: F.trim(e) != "")
    return F.slice(every, F.greatest(F.size(every) - (most - 1), F.lit(1)), most)


def active_jobs(tasks: DataFrame, jobs: DataFrame) -> DataFrame:
    """tasks (task, video_id, ...) with active_id, active_status, active_step: the newest queued or running job for the task, else for the video."""
    live = jobs.where(F.col("status").isin("queued", "running")).groupBy("target").agg(F.max_by(F.struct("id", "status", "step"), F.struct("created_at", "id")).alias("j"))
    a, b = live.select(F.col("target").alias("task"), F.col("j").alias("ja")), live.select(F.col("target").alias("video_id"), F.col("j").alias("jb"))
    j = F.coalesce("ja", "jb")
    return tasks.join(a, "task", "left").join(b, "video_id", "left").select(*tasks.columns, *[j[c].alias(f"active_{c}") for c in ("id", "status", "step")])


def latest_jobs(jobs: DataFrame, limit: int = 50) -> DataFrame:
    """The newest jobs, 1 to 200 of them."""
    return jobs.orderBy(F.desc("created_at"), F.desc("id")).limit(max(1, min(200, limit)))


def next_queued(jobs: DataFrame) -> DataFrame:
    """The queued job that has waited longest."""
    return jobs.where("status = 'queued'").orderBy("created_at", "id").limit(1)


def latest_state(events: DataFrame) -> DataFrame:
    """(id, status): the newest status of each job; an interrupted `running` counts as queued."""
    s = F.max_by("status", "updated_at")
    return events.groupBy("id").agg(F.when(s == "running", "queued").otherwise(s).alias("status"))


def dashboard(tasks: DataFrame, jobs: DataFrame) -> DataFrame:
    """One row: tasks, queued, running, failed, rendered, published."""
    n = lambda c, name: F.count_if(c).alias(name)
    t = tasks.agg(F.count("*").alias("tasks"), n(F.col("render") == "complete", "rendered"), n(F.col("publish") == "complete", "published"))
    j = jobs.agg(*[n(F.col("status") == s, s) for s in ("queued", "running", "failed")])
    return t.join(F.broadcast(j))  # one row with one row


def batch_rollup(outcomes: DataFrame) -> DataFrame:
    """(batch, status, n): counts for each batch and status, each batch and all."""
    return outcomes.rollup("batch", "status").agg(F.count("*").alias("n"))


def recover_candidate(tasks: DataFrame, local: DataFrame, listed: DataFrame) -> DataFrame:
    """tasks (task, video_id, candidate_file) with `candidate` and `error`: a local copy (task, id, candidate) with the same id, else the record (candidate_file, id, candidate) of the file that the manifest names."""
    a = local.select("task", F.col("id").alias("__lid"), F.col("candidate").alias("__local"))
    b = listed.groupBy("candidate_file", F.col("id").alias("video_id")).agg(F.min("candidate").alias("__listed"))
    known = listed.select("candidate_file").distinct().withColumn("__file", F.lit(True))
    df = tasks.join(a, "task", "left").join(b, ["candidate_file", "video_id"], "left").join(known, "candidate_file", "left")
    own = F.when(F.col("__lid") == F.col("video_id"), F.col("__local"))
    error = F.when(own.isNotNull() | F.col("__listed").isNotNull(), F.lit(None)).when(F.col("__file").isNull(), "candidate_file_missing").otherwise("video_id_not_in_file")
    return df.select(*tasks.columns, F.coalesce(own, "__listed").alias("candidate"), error.alias("error"))


def checkpoint_match(outputs: DataFrame, checkpoints: DataFrame, hashes: DataFrame, optional: tuple[str, ...] = ()) -> DataFrame:
    """outputs (task, step, fingerprint, legacy_fingerprint) with `action`: reused, migrated or rebuild.

    A checkpoint (task, step, fingerprint, qc_status, outputs: map of path to hash) holds if its fingerprint is the current or the legacy
    one, its QC passed and each recorded hash is that of the file now (task, path, hash). Paths of `optional` may be missing from it.
    """
    c = checkpoints.groupBy("task", "step").agg(F.max_by(F.struct("fingerprint", "qc_status", "outputs"), "fingerprint").alias("c"))
    files = c.select("task", "step", F.explode("c.outputs").alias("path", "want")).join(hashes, ["task", "path"], "left")
    same = files.groupBy("task", "step").agg(F.every(F.coalesce(F.col("hash") == F.col("want"), F.lit(False)) | (F.col("path").isin(*optional) & F.col("hash").isNull()) if optional else F.coalesce(F.col("hash") == F.col("want"), F.lit(False))).alias("same"))
    df = outputs.join(c, ["task", "step"], "left").join(same, ["task", "step"], "left")
    good = (F.col("c.qc_status") == "QC_PASSED") & F.col("same")
    action = F.when(F.coalesce(good & (F.col("c.fingerprint") == F.col("fingerprint")), F.lit(False)), "reused").when(F.coalesce(good & (F.col("c.fingerprint") == F.col("legacy_fingerprint")), F.lit(False)), "migrated").otherwise("rebuild")
    return df.select(*outputs.columns, action.alias("action"))


def usage_cost(usage: DataFrame, input_price: float | None, output_price: float | None, keys: list[str] = ["video_id"]) -> DataFrame:  # noqa: B006
    """(keys, prompt_tokens, completion_tokens, total_tokens, estimated_cost): no cost without both prices."""
    out = usage.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in ("prompt_tokens", "completion_tokens", "total_tokens")])
    cost = F.lit(None).cast("double") if input_price is None or output_price is None else F.round(F.col("prompt_tokens") / 1e6 * input_price + F.col("completion_tokens") / 1e6 * output_price, 6)
    return out.withColumn("estimated_cost", cost)


def parse_responses(responses: DataFrame) -> DataFrame:
    """(video_id, id, translation) from (video_id, content): JSON segments by id, blank ones dropped, the last of repeated ids by batch."""
    parsed = responses.select("video_id", "batch", F.explode(F.from_json("content", "segments array<struct<id:int,translation:string>>")["segments"]).alias("s"))
    real = parsed.select("video_id", "batch", F.col("s.id").alias("id"), F.trim("s.translation").alias("translation")).where("id is not null and translation <> ''")
    return real.groupBy("video_id", "id").agg(F.max_by("translation", "batch").alias("translation"))


def log_storage(jobs: DataFrame, files: DataFrame) -> DataFrame:
    """(state, logs, bytes): log files (path, size) of active jobs and of all others."""
    live = jobs.where(F.col("status").isin("queued", "running")).select(F.col("log_path").alias("path")).distinct().withColumn("__a", F.lit(True))
    state = F.when(F.col("__a").isNotNull(), "active").otherwise("inactive").alias("state")
    return files.join(live, "path", "left").groupBy(state).agg(F.count("*").alias("logs"), F.sum("size").alias("bytes"))


def render_qc(pairs: DataFrame, tolerance: float = 0.5) -> DataFrame:
    """pairs (video_id, mode, size, returncode, transcoded, cleaned, source: probe, output: probe) with failed_checks, qc_status and duration_difference."""
    s, o = (lambda c: F.col(f"source.{c}")), (lambda c: F.col(f"output.{c}"))
    near = lambda c, t: F.abs(F.coalesce(s(c), F.lit(0.0)) - F.coalesce(o(c), F.lit(0.0))) <= t
    codecs = lambda p: F.transform(p("audio_streams"), lambda a: a["codec"])
    added = F.filter(o("subtitle_streams"), lambda x: (F.try_element_at(x["tags"], F.lit("title")) == "English / 中文") & (F.try_element_at(x["tags"], F.lit("language")) == "mul"))
    times = lambda p: F.transform(p("audio_streams"), lambda a: F.coalesce(F.nullif(a["duration"], F.lit(0.0)), p("duration"), F.lit(0.0)))
    soft, hard = F.col("mode") == "softsub", F.col("mode") != "softsub"
    checks = [
        ("output_exists", F.col("size").isNotNull()), ("output_size_valid", F.col("size") > 1024), ("ffprobe_parsed", F.col("output").isNotNull()), ("video_stream_exists", o("video_stream_count") > 0), ("audio_stream_exists", o("audio_stream_count") > 0),
        ("duration_matches", near("duration", tolerance)), ("resolution_matches", (s("display_width") == o("display_width")) & (s("display_height") == o("display_height"))), ("frame_rate_matches", near("frame_rate_value", 0.02)),
        ("audio_stream_count_matches", s("audio_stream_count") == o("audio_stream_count")), ("ffmpeg_returned_zero", F.col("returncode") == 0), ("temporary_files_cleaned", F.col("cleaned")),
        ("video_stream_copied", hard | (s("video_codec") == o("video_codec"))), ("audio_streams_copied", hard | (codecs(s) == codecs(o))), ("ass_subtitle_exists", hard | F.exists(added, lambda x: x["codec"].isin("ass", "ssa"))),
        ("subtitle_title_and_language", hard | (F.size(added) > 0)), ("subtitle_default", hard | F.exists(added, lambda x: F.coalesce(F.try_element_at(x["disposition"], F.lit("default")), F.lit(0)) == 1)),
        ("hardsub_video_encoded", soft | (F.coalesce(o("video_codec"), F.lit("")) != "")), ("audio_content_present", soft | (o("audio_stream_count") > 0)),
        ("audio_duration_matches", soft | ((F.size(times(s)) == F.size(times(o))) & F.forall(F.zip_with(times(s), times(o), lambda a, b: F.abs(a - b) <= tolerance), lambda x: x))),
        ("audio_transcode_recorded", soft | (codecs(s) == codecs(o)) | F.col("transcoded")),
    ]
    failed = F.array_compact(F.array(*[F.when(~F.coalesce(c, F.lit(False)), F.lit(name)) for name, c in checks]))
    return pairs.withColumn("failed_checks", failed).withColumns({"qc_status": F.when(F.size("failed_checks") == 0, "QC_PASSED").otherwise("FAILED"), "duration_difference": F.round(F.coalesce(o("duration"), F.lit(0.0)) - F.coalesce(s("duration"), F.lit(0.0)), 6)})


def font_sizes(pairs: DataFrame, sizes: DataFrame) -> DataFrame:
    """Bilingual cues (video_id, identifier, start, end, text, other) with english_size, chinese_size, adjusted and crowded for pictures of (video_id, width, height)."""
    w, h = F.col("width"), F.col("height")
    lines = layout.line_count(F.col("text")) + layout.line_count(F.col("other"))
    room, base_en, base_zh = layout.safe_width(w, h), layout.scaled("english", w, h), layout.scaled("chinese", w, h)
    df = pairs.join(sizes.select("video_id", "width", "height"), "video_id")
    df = df.withColumns({"base_en": base_en, "base_zh": base_zh, "english_size": layout.font_size(F.col("text"), base_en, layout.scaled("english_min", w, h), room, lines), "chinese_size": layout.font_size(F.col("other"), base_zh, layout.scaled("chinese_min", w, h), room, lines)})
    df = df.withColumn("chinese_size", F.least("base_zh", F.greatest(F.col("chinese_size"), F.col("english_size") + 3)))
    return df.withColumns({"adjusted": (F.col("english_size") != F.col("base_en")) | (F.col("chinese_size") != F.col("base_zh")), "crowded": layout.too_many_lines(F.col("text"), F.col("other"))})


def font_summary(sized: DataFrame) -> DataFrame:
    """One row a video: adjusted cues, least and base sizes, crowded cues."""
    least = lambda c, base: F.coalesce(F.min(F.when(F.col("adjusted"), F.col(c))), F.first(base))
    return sized.groupBy("video_id").agg(F.count_if("adjusted").alias("adjusted_segments"), least("english_size", "base_en").alias("english_min_used"), F.first("base_en").alias("english_max_used"), least("chinese_size", "base_zh").alias("chinese_min_used"), F.first("base_zh").alias("chinese_max_used"), F.count_if("crowded").alias("crowded_cues"))


def publish_rows(tasks: DataFrame, recommendations: DataFrame, categories: DataFrame, fallback_tid: int, default_tid: int | None, disclaimer: str, heading: str) -> DataFrame:
    """One row a task (task, video_id, title, url, description, translation_ready, media_ready, cover_available): what a submission would hold.

    recommendations: (task, title_zh, tags, tid, reason, status); categories: (tid, name, parent_name), a dimension of about a hundred rows.
    """
    cats = categories.select(F.col("tid").alias("__tid"), F.col("name").alias("category_name"), F.concat_ws(" / ", "parent_name", "name").alias("category_path"))
    spare = F.broadcast(categories.where(F.col("tid") == fallback_tid).select(F.lit(1).alias("__one"), F.col("name").alias("__name"), F.concat_ws(" / ", "parent_name", "name").alias("__path")))
    df = tasks.join(recommendations, "task", "left").withColumn("wanted", F.coalesce(F.nullif("tid", F.lit(0)), F.lit(default_tid or fallback_tid)))
    df = df.join(cats, F.col("wanted") == F.col("__tid"), "left").withColumn("__one", F.lit(1)).join(spare, "__one", "left")
    name = F.coalesce("category_name", "__name")
    url = F.coalesce(F.nullif(F.trim("url"), F.lit("")), F.concat(F.lit("https://www.youtube.com/watch?v="), F.nullif("video_id", F.lit(""))))
    return df.select(
        "task", "video_id", P.bilingual_title(F.col("title_zh"), F.col("title")).alias("title"), F.coalesce("title_zh", F.lit("")).alias("title_zh"), F.col("title").alias("original_title"), P.description(F.col("description"), disclaimer, heading).alias("description"),
        url.alias("source"), F.when(F.col("__tid").isNull(), fallback_tid).otherwise(F.col("wanted")).alias("tid"), name.alias("category_name"), F.coalesce("category_path", "__path").alias("category_path"),
        P.normalised_tags(P.split_tags(F.col("tags")), F.array(name)).alias("tags"), F.coalesce("reason", F.lit("")).alias("recommendation_reason"), F.coalesce("status", F.lit("MISSING")).alias("metadata_status"), "translation_ready", "media_ready", "cover_available",
    )


def metadata_prompts(tasks: DataFrame, samples: DataFrame, categories: DataFrame) -> DataFrame:
    """(video_id, payload): the JSON that a title and category request would carry. No request is made."""
    options = categories.agg(F.array_sort(F.collect_list(F.struct("tid", F.concat_ws(" / ", "parent_name", "name").alias("category")))).alias("allowed_categories"))
    cues = samples.groupBy("video_id").agg(F.array_sort(F.collect_list(F.struct("id", "start", "text"))).alias("subtitle_sample"))
    df = tasks.join(cues, "video_id", "left").join(F.broadcast(options))  # one row
    cut = lambda c, n: F.substring(F.coalesce(c, F.lit("")), 1, n)
    body = F.struct(cut("title", 500).alias("original_title"), cut("channel", 200).alias("channel"), F.slice(F.coalesce("tags", F.array().cast("array<string>")), 1, 30).alias("original_tags"), cut("description", 6000).alias("original_description"), "subtitle_sample", "allowed_categories")
    return df.select("video_id", F.to_json(body).alias("payload"))


def recommended(payloads: DataFrame, tasks: DataFrame, categories: DataFrame, fallback_tid: int) -> DataFrame:
    """One row a video: the checked recommendation, or the fallback record with the reason why. payloads: (video_id, payload); tasks: (video_id, title, tags)."""
    known = categories.select(F.col("tid").alias("__tid"), "name", "parent_name")
    spare = F.broadcast(categories.where(F.col("tid") == fallback_tid).select(F.lit(1).alias("__one"), F.col("name").alias("__name"), F.col("parent_name").alias("__parent")))
    df = tasks.join(payloads, "video_id", "left").withColumn("__want", F.get_json_object("payload", "$.tid").try_cast("int"))
    df = df.join(known, F.col("__want") == F.col("__tid"), "left").withColumn("__one", F.lit(1)).join(spare, "__one", "left")
    df = df.withColumn("r", P.recommendation(F.col("payload"), F.col("title"), F.col("tags"), F.col("__tid").isNotNull()))
    good = F.col("r.problem").isNull() & F.col("payload").isNotNull()
    pick = lambda a, b: F.when(good, a).otherwise(b)
    spare_title = P.fallback_title(F.coalesce("title", F.lit("")))
    return df.select(
        "video_id", pick(F.lit("RECOMMENDED"), F.lit("FALLBACK")).alias("status"), pick(F.col("r.title_zh"), spare_title).alias("title_zh"), pick(F.col("r.upload_title"), P.bilingual_title(spare_title, F.col("title"))).alias("upload_title"),
        pick(F.col("r.tags"), P.normalised_tags(F.col("tags"), F.array("__name"))).alias("tags"), pick(F.col("r.tid"), F.lit(fallback_tid)).alias("tid"), pick(F.concat_ws(" / ", "parent_name", "name"), F.concat_ws(" / ", "__parent", "__name")).alias("category_path"),
        pick(F.lit(""), F.coalesce("r.problem", F.lit("NO_RECOMMENDATION"))).alias("warning"),
    )
