"""Candidate videos: discovery hits, rules, scores and counts.

Videos have the nested columns of `cuefold.sources.videos.VIDEO`; hits are (video_id, kind, mode, query_group, rank, query_text, feed), kind
`search` or `popular`.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cuefold.functions import text as T
from cuefold.functions import times
from cuefold.functions.udfs import detect_language
from cuefold.plans.settings import CandidateSettings

THUMBNAILS = ("maxres", "standard", "high", "medium", "default")


def _map(values: dict, cast: str = "double") -> Column:
    pairs = [F.lit(x) for k, v in values.items() for x in (k, float(v) if cast == "double" else str(v))]
    return F.create_map(*pairs) if pairs else F.expr(f"cast(map() AS map<string,{cast}>)")


def hit_rollup(hits: DataFrame) -> DataFrame:
    """One row a video: its distinct modes, groups and queries joined, the least rank (0 without a search), and its details."""
    search, popular = F.col("kind") == "search", F.col("kind") == "popular"
    joined = lambda c, sep: F.array_join(F.array_sort(F.collect_set(F.when(search, F.col(c)))), sep)
    detail = F.when(search, F.struct("query_group", F.col("mode").alias("search_mode"), F.col("rank").alias("search_rank"), "query_text"))
    return hits.groupBy("video_id").agg(
        joined("mode", "|").alias("search_mode"), joined("query_group", "|").alias("query_group"), joined("query_text", " || ").alias("query_text"),
        F.coalesce(F.min(F.when(search, F.col("rank"))), F.lit(0)).alias("search_rank"), F.array_sort(F.collect_set(detail)).alias("search_source_details"),
        F.array_sort(F.collect_set(F.when(popular, F.col("feed")))).alias("popular_source_details"),
    )


def discovery_counts(hits: DataFrame) -> DataFrame:
    """(popular, search, overlap, merged): videos by how they were found."""
    flags = hits.groupBy("video_id").agg(F.bool_or(F.col("kind") == "popular").alias("p"), F.bool_or(F.col("kind") == "search").alias("s"))
    return flags.agg(F.count_if("p").alias("popular"), F.count_if("s").alias("search"), F.count_if(F.col("p") & F.col("s")).alias("overlap"), F.count("*").alias("merged"))


def merge_resources(popular: DataFrame, details: DataFrame) -> DataFrame:
    """Both tables of videos, one row an id: a detail row stands before a popular one."""
    both = details.withColumn("__order", F.lit(0)).unionByName(popular.withColumn("__order", F.lit(1)), allowMissingColumns=True)
    return both.withColumn("__n", F.row_number().over(W.partitionBy("video_id").orderBy("__order"))).where("__n = 1").drop("__n", "__order")


def found_both_ways(hits: DataFrame) -> DataFrame:
    """(video_id): found by search and by a popular feed."""
    return hits.where("kind = 'popular'").select("video_id").intersect(hits.where("kind = 'search'").select("video_id"))


def language(audio: Column, declared: Column, title: Column, description: Column, has_caption: Column, markers: list, detected: Column | None = None) -> Column:
    """struct(detected_language, language_confidence, language_source, language_filter_reason): audio, then marker, then declared, then detection."""
    audio, declared = T.normalized(audio), T.normalized(declared)
    hits = T.phrase_hits(T.normalized(F.concat_ws(" ", F.coalesce(title, F.lit("")), F.substring(F.coalesce(description, F.lit("")), 1, 1000))), markers)
    found = F.lit("unknown") if detected is None else detected
    row = lambda lang, sure, source, reason: F.struct(*[(x if isinstance(x, Column) else F.lit(x)).alias(n) for x, n in ((lang, "detected_language"), (sure, "language_confidence"), (source, "language_source"), (reason, "language_filter_reason"))])
    return (
        F.when(audio.startswith("en"), row("en", "high", "defaultAudioLanguage", "")).when(audio != "", row(audio, "high", "defaultAudioLanguage", "non_english_audio"))
        .when(F.size(hits) > 0, row(F.get(hits, F.lit(0)), "high", "explicit_marker", "non_english_marker"))
        .when(declared.startswith("en"), row("en", "medium", "defaultLanguage", "")).when(declared != "", row(declared, "medium", "defaultLanguage", "non_english_declared"))
        .when(found == "en", row("en", "medium", F.when(has_caption, "text_detection+caption").otherwise("text_detection"), ""))
        .otherwise(row(found, "low", "text_detection", "english_not_confirmed"))
    )


def interest(text: Column, topic: Column, s: CandidateSettings) -> Column:
    """struct(interest_score, interest_hits, boring_penalty, boring_hits) of a normalised text."""
    none = F.array().cast("array<string>")
    by_topic = lambda lists: reduce(lambda acc, kv: F.when(topic == kv[0], T.phrase_hits(text, kv[1])).otherwise(acc), lists.items(), none)
    found = F.struct(*[T.phrase_hits(text, v).alias(k) for k, v in s.interest_phrases.items()], by_topic(s.topic_interest_phrases).alias("__own"), F.array_sort(F.array_union(T.phrase_hits(text, s.boring_penalty_phrases), by_topic(s.topic_penalty_phrases))).alias("__boring"))

    def scored(f: Column) -> Column:
        hits = F.concat(none, *[f[k] for k in s.interest_phrases])
        more = F.array_except(f["__own"], hits)
        score = reduce(lambda a, b: a + b, [F.size(f[k]) * float(s.interest_phrase_weights[k]) for k in s.interest_phrases], F.lit(0.0))
        return F.struct(
            F.round(score + F.size(more) * float(s.topic_interest_bonus_per_hit), 3).alias("interest_score"), F.array_sort(F.array_union(hits, more)).alias("interest_hits"),
            (F.size(f["__boring"]) * float(s.boring_penalty_per_hit)).alias("boring_penalty"), f["__boring"].alias("boring_hits"),
        )

    return T.let(found, scored)


def relevance(title: Column, description: Column, tags: Column, channel: Column, source_topics: Column, category: Column, s: CandidateSettings) -> Column:
    """struct(primary_topic, all_topics, topic_relevance_score, topic_keyword_hits).

    Each keyword counts once, where it is first found: title 6, tags 3, description 2, channel 0.5 (and then it is no hit). Topics come by
    score, then number of hits, then the order of the settings.
    """
    texts = F.struct(
        T.normalized(title).alias("title"), T.normalized(F.array_join(F.coalesce(tags, F.array().cast("array<string>")), " ")).alias("tags"),
        T.normalized(F.substring(F.coalesce(description, F.lit("")), 1, 1500)).alias("description"), T.normalized(channel).alias("channel"),
    )

    def marks(t: Column) -> Column:
        """For each topic its keywords with the points of the place where each is first found."""
        place = lambda k: F.when(T.has_phrase(t["title"], k), 6.0).when(T.has_phrase(t["tags"], k), 3.0).when(T.has_phrase(t["description"], k), 2.0).when(T.has_phrase(t["channel"], k), 0.5).otherwise(0.0)
        own = lambda keywords: F.array(*[F.struct(F.lit(k).alias("k"), place(k).alias("p")) for k in keywords]) if keywords else F.expr("cast(array() AS array<struct<k:string,p:double>>)")
        return F.array(*[F.struct(F.lit(n).alias("n"), F.lit(topic).alias("topic"), own(keywords).alias("marks"), (T.phrase_hits(t["title"], s.priority_games) if topic == s.priority_topic else F.array().cast("array<string>")).alias("first")) for n, (topic, keywords) in enumerate(s.topic_keywords.items())])

    def ranked(m: Column) -> Column:
        mapped = F.coalesce(F.try_element_at(_map(s.category_to_topic, "string"), category) == m["topic"], F.lit(False))
        score = F.aggregate(m["marks"], F.lit(0.0), lambda acc, x: acc + x["p"]) + F.when(F.array_contains(source_topics, m["topic"]), 3.0).otherwise(0.0) + F.when(mapped, 2.0).otherwise(0.0) + F.when(F.size(m["first"]) > 0, 12.0).otherwise(0.0)
        hits = F.concat(F.transform(F.filter(m["marks"], lambda x: x["p"] > 0.5), lambda x: x["k"]), m["first"])
        return F.struct((-score).alias("a"), (-F.size(hits)).alias("b"), m["n"].alias("c"), m["topic"].alias("topic"), score.alias("score"), F.array_sort(F.array_distinct(hits)).alias("hits"))

    def chosen(ordered: Column) -> Column:
        good = F.filter(ordered, lambda r: r["score"] >= float(s.topic_relevance_min))
        best, top = F.get(good, F.lit(0)), F.get(ordered, F.lit(0))
        return F.struct(
            F.coalesce(best["topic"], F.lit("other")).alias("primary_topic"), F.transform(good, lambda r: r["topic"]).alias("all_topics"),
            F.round(F.coalesce(F.when(best["score"].isNotNull(), F.least(best["score"], F.lit(100.0))), top["score"], F.lit(0.0)), 3).alias("topic_relevance_score"),
            F.map_from_entries(F.transform(good, lambda r: F.struct(r["topic"], r["hits"]))).alias("topic_keyword_hits"),
        )

    if not s.topic_keywords:
        return F.struct(F.lit("other").alias("primary_topic"), F.array().cast("array<string>").alias("all_topics"), F.lit(0.0).alias("topic_relevance_score"), F.expr("cast(map() AS map<string,array<string>>)").alias("topic_keyword_hits"))
    return T.let(texts, lambda t: T.let(F.array_sort(F.transform(marks(t), ranked)), chosen))


def copyright_risk(category: Column, text: Column, license_name: Column, hard_hits: Column, s: CandidateSettings) -> Column:
    risky = category.isin(*s.risky_categories) | (F.size(T.phrase_hits(text, s.risky_phrases)) > 0)
    return F.when(F.size(hard_hits) > 0, "very_high").when(license_name == "creativeCommon", "low").when(risky, "high").otherwise("medium")


def rates(df: DataFrame, s: CandidateSettings) -> DataFrame:
    """Adds views_per_hour, like_rate and comment_rate, rounded before they are scored; rates are 0 without views."""
    hours = F.greatest(F.col("age_hours"), F.lit(float(s.min_age_hours_for_rate)))
    share = lambda c: T.rounded(F.coalesce(F.try_divide(F.col(c), F.col("view_count")), F.lit(0.0)), 6)
    return df.withColumns({"views_per_hour_exact": F.col("view_count") / hours, "views_per_hour": T.rounded(F.col("view_count") / hours, 3), "like_rate": share("like_count"), "comment_rate": share("comment_count"), "age_hours": T.rounded(hours, 3)})


def metric_scores(df: DataFrame, s: CandidateSettings) -> DataFrame:
    """Growth, engagement, freshness, suitability, diversity, caption, raw and final score of rows with rates and rule columns."""
    up = lambda c: F.least(c, F.lit(100.0))
    sure = F.coalesce(F.element_at(_map({"high": 100, "medium": 75, "low": 25}), F.col("language_confidence")), F.lit(0.0))
    interest_n, topic_n = up(F.col("interest_score") * 4), up(F.col("topic_relevance_score") * 4)
    lo, hi = s.tutorial_preferred_duration_seconds
    fits = (F.col("primary_topic") == s.tutorial_topic) & F.col("duration_seconds").between(int(lo), int(hi))
    suit = sure * 0.45 + interest_n * 0.35 + F.when(F.col("has_caption"), 100.0).otherwise(40.0) * 0.2
    suit = suit + F.when(fits, float(s.tutorial_localization_bonus)).otherwise(0.0) - F.least(F.col("boring_penalty"), F.lit(40.0))
    df = df.withColumns({
        "growth_score": T.rounded(up(20.0 * F.log10(F.col("views_per_hour") + 1)), 3),
        "engagement_score": T.rounded(up(F.col("like_rate") * 900 + F.col("comment_rate") * 4500), 3),
        "freshness_score": T.rounded(F.greatest(F.lit(0.0), 100.0 * (1.0 - F.col("age_hours") / 72.0)), 3),
        "localization_suitability_score": T.rounded(F.greatest(F.lit(0.0), up(suit)), 3),
        "localization_suitability": F.when(suit >= 70, "high").when(suit >= 45, "medium").otherwise("low"),
        "source_diversity_score": up((F.size("popular_source_details") + F.size("search_source_details")) * 20.0),
        "caption_score": F.when(F.col("has_caption"), 100.0).otherwise(0.0), "interest_score_normalized": interest_n, "topic_relevance_normalized": topic_n,
    })
    raw = reduce(lambda a, b: a + b, [F.col(name) * float(w) for name, w in s.final_score_weights.items()])
    risk = F.element_at(_map({k.removeprefix("copyright_"): v for k, v in s.penalties.items() if k.startswith("copyright_")}), F.col("copyright_risk"))
    unsure = F.coalesce(F.try_element_at(_map({k.removeprefix("language_"): v for k, v in s.penalties.items() if k.startswith("language_")}), F.col("language_confidence")), F.lit(0.0))
    df = df.withColumns({"copyright_penalty": risk, "language_uncertainty_penalty": unsure, "raw_exact": raw})
    final = T.rounded(F.greatest(F.lit(0.0), F.col("raw_exact") - F.col("boring_penalty") - F.col("copyright_penalty") - F.col("language_uncertainty_penalty")), 3)
    return df.withColumns({"raw_score": T.rounded(F.col("raw_exact"), 3), "final_score": final, "event_duplicate_penalty": F.lit(0.0)}).drop("raw_exact")


def _once(df: DataFrame, costly: list[str]) -> DataFrame:
    """`df` with its costly columns behind a generator of one row: a later filter on them reads them, where it would else be moved down with all that they are made of copied into it, once for each mention."""
    return df.select(*[c for c in df.columns if c not in costly], F.inline(F.array(F.struct(*costly))))


def build(videos: DataFrame, hits: DataFrame, source_topics: DataFrame, categories: DataFrame, window_end: Column, s: CandidateSettings, detect=None) -> DataFrame:
    """One row a video with all scores, `eligible` and `filter_reason`: the first of the ordered rules that rejects it, else ''.

    `source_topics` is (video_id, topics); `categories` (category_id, title) is a dimension of a few dozen rows. Videos and hits meet by
    id, the only shuffle. A null or missing field counts as the rule's default.
    """
    empty = F.array().cast("array<string>")
    base = videos.join(hit_rollup(hits), "video_id", "left").join(source_topics, "video_id", "left")
    base = base.join(F.broadcast(categories.select(F.col("category_id").alias("__cat"), F.col("title").alias("__category"))), F.col("snippet.categoryId") == F.col("__cat"), "left")
    title, channel = F.trim(T.unescape(F.coalesce("snippet.title", F.lit("")))), F.trim(T.unescape(F.coalesce("snippet.channelTitle", F.lit(""))))
    text = T.normalized(F.concat_ws(" ", title, F.coalesce("snippet.description", F.lit(""))))
    published = F.try_to_timestamp(F.col("snippet.publishedAt"))
    df = base.select(
        "video_id", title.alias("title"), channel.alias("channel_title"), "snippet", text.alias("text"), F.coalesce("topics", empty).alias("source_topics"),
        F.coalesce("popular_source_details", empty).alias("popular_source_details"),
        F.coalesce("search_source_details", F.expr("cast(array() AS array<struct<query_group:string,search_mode:string,search_rank:int,query_text:string>>)")).alias("search_source_details"),
        *[F.coalesce(c, F.lit("")).alias(c) for c in ("search_mode", "query_group", "query_text")], F.coalesce("search_rank", F.lit(0)).alias("search_rank"),
        published.alias("published_at"), F.coalesce("status.privacyStatus", F.lit("public")).alias("privacy"), F.coalesce("status.license", F.lit("unknown")).alias("license"), F.col("status.embeddable").alias("embeddable"),
        times.iso_duration(F.coalesce("contentDetails.duration", F.lit(""))).alias("duration_seconds"), F.coalesce(F.col("contentDetails.caption") == "true", F.lit(False)).alias("has_caption"),
        *[T.safe_int(F.col(f"statistics.{k}Count")).alias(f"{k}_count") for k in ("view", "like", "comment")],
        F.coalesce("snippet.categoryId", F.lit("")).alias("category_id"), F.coalesce("__category", "snippet.categoryId", F.lit("")).alias("category_title"),
        ((F.unix_micros(window_end) - F.unix_micros(published)) / 3_600_000_000.0).alias("age_hours"),
    )
    undeclared = (T.normalized(F.col("snippet.defaultAudioLanguage")) == "") & (T.normalized(F.col("snippet.defaultLanguage")) == "")
    told = F.when(undeclared, F.concat_ws(" ", "title", F.substring(F.coalesce("snippet.description", F.lit("")), 1, 1000)))  # what is declared goes first: no text is read there
    detected = None if detect is None else detect_language(detect)(told)
    df = df.withColumns({
        "hard_exclude_hits": T.phrase_hits(F.col("text"), s.hard_exclude_phrases), "popular_age": F.col("age_hours"), "duration": times.clock(F.col("duration_seconds")),
        "lang": language(F.col("snippet.defaultAudioLanguage"), F.col("snippet.defaultLanguage"), F.col("snippet.title"), F.col("snippet.description"), F.col("has_caption"), s.language_markers, detected),
        "topic": relevance(F.col("snippet.title"), F.col("snippet.description"), F.col("snippet.tags"), F.col("snippet.channelTitle"), F.col("source_topics"), F.col("category_title"), s),
    })
    df = _once(df.withColumn("interest", interest(F.col("text"), F.col("topic.primary_topic"), s)), ["hard_exclude_hits", "lang", "topic", "interest"]).select("*", "lang.*", "topic.*", "interest.*")
    wild = (F.col("primary_topic") == "other") & (F.size("popular_source_details") > 0) & (F.col("interest_score") >= float(s.wildcard_interest_min))
    df = df.withColumns({"all_topics": F.when(wild, F.array(F.lit("wildcard_popular"))).otherwise(F.col("all_topics")), "primary_topic": F.when(wild, "wildcard_popular").otherwise(F.col("primary_topic"))})
    df = rates(df, s).withColumn("copyright_risk", copyright_risk(F.col("category_title"), F.col("text"), F.col("license"), F.col("hard_exclude_hits"), s))
    df = metric_scores(df, s)
    popular, search = F.size("popular_source_details") > 0, F.size("search_source_details") > 0
    least = lambda values: F.coalesce(F.try_element_at(_map(values), F.col("primary_topic")), F.lit(0.0))
    rules = [
        (F.lower("channel_title").isin([c.lower() for c in s.blacklist_channels]), "blacklist_channel"),
        (F.coalesce(F.col("snippet.publishedAt"), F.lit("")) == "", "missing_published_at"), (F.col("published_at").isNull(), "invalid_published_at"),
        (popular & ((F.col("popular_age") < 0) | (F.col("popular_age") > float(s.popular_max_age_hours))), "outside_popular_age_window"), (~popular & ~search, "missing_discovery_source"),
        (F.coalesce("snippet.liveBroadcastContent", F.lit("none")) != "none", "live_or_upcoming"), (F.col("privacy") != "public", "not_public"),
        (~F.col("duration_seconds").between(s.min_duration_seconds, s.max_duration_seconds), "duration_out_of_range"),
        (F.lit(s.exclude_shorts) & (F.col("duration_seconds") <= s.shorts_max_duration_seconds) & F.col("text").contains("#shorts"), "shorts"),
        (F.size("hard_exclude_hits") > 0, "hard_exclude"), (F.lit(s.english_only) & (F.col("language_filter_reason") != ""), F.col("language_filter_reason")),
        (F.col("primary_topic") == "other", "low_topic_relevance"),
        ((F.col("view_count") < least(s.topic_min_view_count)) | (F.col("views_per_hour_exact") < least(s.topic_min_views_per_hour)), "low_absolute_heat"),
        (popular & ~search & ((F.col("copyright_risk") == "very_high") | (F.col("localization_suitability") == "low")), "popular_not_localizable"),
    ]
    reason = F.lit("")
    for condition, name in reversed(rules):
        reason = F.when(F.coalesce(condition, F.lit(False)), name).otherwise(reason)
    thumbnail = F.coalesce(*[F.nullif(F.try_element_at("snippet.thumbnails", F.lit(n))["url"], F.lit("")) for n in THUMBNAILS], F.lit(""))
    df = df.withColumns({"filter_reason": reason, "thumbnail_url": thumbnail, "youtube_url": video_url(F.col("video_id")), "published_at_local": F.from_utc_timestamp("published_at", s.timezone)})
    return df.withColumn("eligible", F.col("filter_reason") == "").drop("lang", "topic", "interest", "text", "snippet", "views_per_hour_exact", "popular_age", "privacy")


def video_url(video_id: Column) -> Column:
    return F.concat(F.lit("https://www.youtube.com/watch?v="), video_id)


def candidate_url(*fields: Column, video_id: Column) -> Column:
    """The first of the url fields that is not empty, else one made from the id."""
    return F.coalesce(*[F.nullif(F.trim(f), F.lit("")) for f in fields], F.when(F.coalesce(video_id, F.lit("")) != "", video_url(video_id)), F.lit(""))


def rejection_counts(built: DataFrame) -> DataFrame:
    """(reason, n): rows by rule, `accepted` for those that passed."""
    return built.groupBy(F.when(F.col("eligible"), "accepted").otherwise(F.col("filter_reason")).alias("reason")).agg(F.count("*").alias("n"))


def topic_funnel(built: DataFrame, selected: DataFrame, s: CandidateSettings) -> DataFrame:
    """(topic, before, after, selected, target, maximum)."""
    stages = built.groupBy(F.col("primary_topic").alias("topic")).agg(F.count("*").alias("before"), F.count_if("eligible").alias("after"))
    chosen = selected.groupBy(F.col("selection_topic").alias("topic")).agg(F.count("*").alias("selected"))
    joined = stages.join(chosen, "topic", "full_outer").fillna(0, ["before", "after", "selected"])
    return joined.withColumns({"target": F.coalesce(F.try_element_at(_map(s.topic_quotas), F.col("topic")), F.lit(0.0)).cast("int"), "maximum": F.coalesce(F.try_element_at(_map(s.topic_max_counts), F.col("topic")), F.lit(0.0)).cast("int")})


def wildcard_pool(rows: DataFrame, s: CandidateSettings) -> DataFrame:
    """Popular rows of acceptable risk, suitability and interest."""
    return rows.where((F.size("popular_source_details") > 0) & (F.col("copyright_risk") != "very_high") & F.col("localization_suitability").isin("medium", "high") & (F.col("interest_score") >= float(s.wildcard_interest_min)))


def rights_gate(rows: DataFrame, approved: list[str]) -> DataFrame:
    """Adds `outcome`: skipped_unselected unless `selected` is true, 1 or '1'; skipped_rights unless the status is approved; else approved."""
    picked = F.lower(F.trim(F.col("selected").cast("string"))).isin("true", "1")
    allowed = F.upper(F.trim(F.coalesce("rights_status", F.lit("")))).isin(approved)
    return rows.withColumn("outcome", F.when(~F.coalesce(picked, F.lit(False)), "skipped_unselected").when(~allowed, "skipped_rights").otherwise("approved"))


def requested(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows whose video_id is asked for."""
    return rows.join(ids.select("video_id").distinct(), "video_id", "left_semi")


def gate_stats(gated: DataFrame) -> DataFrame:
    """One row: total, approved and skipped rows."""
    n = lambda name: F.count_if(F.col("outcome") == name).alias(name)
    return gated.agg(F.count("*").alias("total"), n("approved"), n("skipped_unselected"), n("skipped_rights"))
