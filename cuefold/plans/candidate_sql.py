"""DuckDB SQL of the candidate, task and publishing queries."""

from __future__ import annotations

from cuefold.plans import views as V
from cuefold.plans.candidate_queries import CATEGORIES, SETTINGS
from cuefold.plans.views import CUES, HITS, JOBS

TITLE = "array_to_string(string_split(text, ' ')[1:8], ' ')"
TOKENS = r"list_filter(list_distinct(list_filter(string_split(trim(regexp_replace(regexp_replace(lower(trim(regexp_replace({0}, '\s+', ' ', 'g'))), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '\s+', ' ', 'g')), ' '), lambda t: length(t) > 1)), lambda t: t NOT IN ('the', 'of', 'and'))"
FILES = """
files AS (SELECT l_orderkey % 400 AS task, ['video/source.mp4', 'metadata/info.json', 'audio/source_audio.wav', 'metadata/description.txt', 'subtitles/zh.clean.srt', 'subtitles/zh.auto.srt', 'subtitles/zh.auto.vtt'][l_partkey % 7 + 1] AS path, l_suppkey % 4 AS size FROM lineitem)
"""
STATES = """
o AS (SELECT o_orderkey AS task, o_orderkey % 13 AS k FROM orders),
s AS (SELECT task, CASE WHEN k = 0 THEN 'failed' ELSE 'complete' END AS download, CASE WHEN k > 2 THEN 'complete' ELSE 'pending' END AS english, CASE WHEN k > 4 THEN 'complete' ELSE 'pending' END AS translation,
  CASE WHEN k = 9 THEN 'review' WHEN k > 9 THEN 'complete' WHEN k = 8 THEN 'failed' ELSE 'pending' END AS render, CASE WHEN k = 11 THEN 'active' WHEN k = 12 THEN 'complete' ELSE 'pending' END AS publish FROM o),
states AS (SELECT *, CAST(20 * ((download IN ('complete', 'review'))::INT + (english IN ('complete', 'review'))::INT + (translation IN ('complete', 'review'))::INT + (render IN ('complete', 'review'))::INT + (publish IN ('complete', 'review'))::INT) AS INTEGER) AS progress,
  CASE WHEN publish = 'complete' THEN 'published' WHEN publish = 'active' THEN 'publishing' WHEN publish = 'failed' THEN 'publish_failed' WHEN render = 'complete' THEN 'rendered' WHEN render = 'review' THEN 'needs_review'
    WHEN 'failed' IN (download, english, translation, render, publish) THEN 'failed' WHEN translation = 'complete' THEN 'bilingual' WHEN english = 'complete' THEN 'english' WHEN download = 'complete' THEN 'downloaded' ELSE 'waiting' END AS overall FROM s)
"""


def has(column: str, phrase: str) -> str:
    return rf"regexp_matches({column}, '(^|[^\p{{L}}\p{{N}}_]){phrase}([^\p{{L}}\p{{N}}_]|$)')"


def hits(column: str, phrases: list[str]) -> str:
    return "list_filter([" + ", ".join(f"CASE WHEN {has(column, p)} THEN '{p}' END" for p in phrases) + "]::VARCHAR[], lambda h: h IS NOT NULL)"


def normal(column: str) -> str:
    for entity, sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&apos;", "''"), ("&amp;", "&")):
        column = f"replace({column}, '{entity}', '{sign}')"
    return rf"lower(trim(regexp_replace({column}, '\s+', ' ', 'g')))"


def points(topic: str) -> str:
    """(score, hits) of a topic over the normalised columns t, g, d, c."""
    place = lambda k: f"CASE WHEN {has('t', k)} THEN 6.0 WHEN {has('g', k)} THEN 3.0 WHEN {has('d', k)} THEN 2.0 WHEN {has('c', k)} THEN 0.5 ELSE 0.0 END"
    marks = "[" + ", ".join(f"({place(k)})::DOUBLE" for k in SETTINGS.topic_keywords[topic]) + "]"
    mapped = [c for c, x in SETTINGS.category_to_topic.items() if x == topic]
    extra = " OR ".join(f"category = '{c}'" for c in mapped) or "FALSE"
    first = len_first = ""
    if topic == SETTINGS.priority_topic:
        games = hits("t", SETTINGS.priority_games)
        first, len_first = f" + CASE WHEN len({games}) > 0 THEN 12.0 ELSE 0.0 END", f" + len({games})"
    return f"struct_pack(score := list_sum({marks}) + CASE WHEN list_contains(topics, '{topic}') THEN 3.0 ELSE 0.0 END + CASE WHEN {extra} THEN 2.0 ELSE 0.0 END{first}, hits := len(list_filter({marks}, lambda m: m > 0.5)){len_first})"


S = SETTINGS
TOPICS = list(S.topic_keywords)
CASE_TOPIC = lambda lists: "CASE " + " ".join(f"WHEN topic0 = '{k}' THEN {hits('x', v)}" for k, v in lists.items()) + " ELSE []::VARCHAR[] END"
LEAST = lambda values: "CASE primary_topic " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in values.items()) + " ELSE 0 END"
BUILT = f"""
{HITS},
roll AS (SELECT video_id, count(DISTINCT (mode, query_group, rank, query_text)) FILTER (kind = 'search') AS searches, count(DISTINCT feed) FILTER (kind = 'popular') AS populars FROM hits GROUP BY 1),
top AS (SELECT video_id, list(DISTINCT CASE feed WHEN 'feed0' THEN 'alpha' ELSE 'beta' END) AS topics FROM hits WHERE feed IN ('feed0', 'feed1') GROUP BY 1),
ev AS (SELECT event_id % (SELECT count(*) FROM documents) AS video_id, count(*) FILTER (event_type = 'view') * 1000 AS views, count(*) FILTER (event_type = 'click') * 20 AS likes, count(*) FILTER (event_type = 'signup') AS comments, date_trunc('second', min(ts)) AS published FROM events GROUP BY 1),
v0 AS (SELECT doc_id AS video_id, doc_id % 10 AS k, {TITLE} AS title, text AS description, source, lang, 30 + n_chars % 3000 AS duration_seconds, CASE doc_id % 6 {' '.join(f"WHEN {i} THEN '{t}'" for i, t in CATEGORIES)} ELSE CAST(doc_id % 6 AS VARCHAR) END AS category,
  coalesce(views, 0) AS view_count, coalesce(likes, 0) AS likes, coalesce(comments, 0) AS comments, published, coalesce(searches, 0) AS searches, coalesce(populars, 0) AS populars, coalesce(topics, []::VARCHAR[]) AS topics
  FROM documents LEFT JOIN ev ON doc_id = ev.video_id LEFT JOIN roll ON doc_id = roll.video_id LEFT JOIN top ON doc_id = top.video_id),
v1 AS (SELECT *, {normal("title || ' ' || description")} AS x, {normal("title || ' ' || substr(description, 1, 1000)")} AS y, {normal("title")} AS t, {normal("source")} AS g, {normal("substr(description, 1, 1500)")} AS d, {normal("source")} AS c,
  (epoch_us((SELECT max(ts) FROM events)) - epoch_us(published)) / 3600000000.0 AS age FROM v0),
v2 AS (SELECT *, {', '.join(f'{points(t)} AS p_{t}' for t in TOPICS)}, CASE WHEN k < 3 THEN lower(lang) ELSE '' END AS audio, CASE WHEN k < 8 THEN lower(lang) ELSE '' END AS declared, {has('y', S.language_markers[0])} AS marker FROM v1),
v3 AS (SELECT *, list_sort([{', '.join(f"(-p_{t}.score, -p_{t}.hits, {n}, '{t}')" for n, t in enumerate(TOPICS))}]) AS ranked FROM v2),
v4 AS (SELECT *, CASE WHEN -ranked[1][1] >= {S.topic_relevance_min} THEN ranked[1][4] ELSE 'other' END AS topic0, round(CASE WHEN -ranked[1][1] >= {S.topic_relevance_min} THEN least(-ranked[1][1], 100.0) ELSE -ranked[1][1] END, 3) AS topic_relevance_score FROM v3),
v5 AS (SELECT *, {', '.join(f'{hits("x", p)} AS h_{k}' for k, p in S.interest_phrases.items())}, {CASE_TOPIC(S.topic_interest_phrases)} AS own, len(list_distinct(list_concat({hits("x", S.boring_penalty_phrases)}, {CASE_TOPIC(S.topic_penalty_phrases)}))) * 5.0 AS boring_penalty FROM v4),
v6 AS (SELECT *, round({' + '.join(f'len(h_{k}) * {float(S.interest_phrase_weights[k])}' for k in S.interest_phrases)} + len(list_filter(own, lambda h: NOT list_contains(list_concat(list_concat(h_strong, h_medium), h_normal), h))) * 1.5, 3)::DOUBLE AS interest_score FROM v5),
v7 AS (SELECT *, CASE WHEN topic0 = 'other' AND populars > 0 AND interest_score >= {S.wildcard_interest_min} THEN 'wildcard_popular' ELSE topic0 END AS primary_topic, greatest(age, 0.5) AS hours,
  CASE WHEN starts_with(audio, 'en') OR audio <> '' OR marker THEN 'high' WHEN declared <> '' THEN 'medium' ELSE 'low' END AS language_confidence,
  CASE WHEN starts_with(audio, 'en') THEN '' WHEN audio <> '' THEN 'non_english_audio' WHEN marker THEN 'non_english_marker' WHEN starts_with(declared, 'en') THEN '' WHEN declared <> '' THEN 'non_english_declared' ELSE 'english_not_confirmed' END AS language_reason FROM v6),
v8 AS (SELECT *, round(view_count / hours, 3) AS views_per_hour, round(CASE WHEN view_count > 0 THEN likes / view_count ELSE 0 END, 6) AS like_rate, round(CASE WHEN view_count > 0 THEN comments / view_count ELSE 0 END, 6) AS comment_rate, round(hours, 3) AS age_hours,
  {' OR '.join(has('x', p) for p in S.hard_exclude_phrases)} AS hard FROM v7),
v9 AS (SELECT *, CASE WHEN hard THEN 'very_high' WHEN k = 4 THEN 'low' WHEN category IN ('Music', 'Film & Animation') OR {' OR '.join(has('x', p) for p in S.risky_phrases)} THEN 'high' ELSE 'medium' END AS copyright_risk,
  round(least(20.0 * log10(views_per_hour + 1), 100.0), 3) AS growth_score, round(least(like_rate * 900 + comment_rate * 4500, 100.0), 3) AS engagement_score, round(greatest(0.0, 100.0 * (1.0 - age_hours / 72.0)), 3) AS freshness_score,
  least((searches + populars) * 20.0, 100.0)::DOUBLE AS source_diversity_score, CASE WHEN k % 2 = 0 THEN 100.0 ELSE 0.0 END AS caption_score,
  CASE language_confidence WHEN 'high' THEN 100.0 WHEN 'medium' THEN 75.0 ELSE 25.0 END * 0.45::DOUBLE + least(interest_score * 4, 100.0) * 0.35 + CASE WHEN k % 2 = 0 THEN 100.0 ELSE 40.0 END * 0.2::DOUBLE
    + CASE WHEN primary_topic = 'beta' AND duration_seconds BETWEEN 240 AND 1200 THEN 10.0 ELSE 0.0 END - least(boring_penalty, 40.0)::DOUBLE AS suit FROM v8),
v10 AS (SELECT *, round(greatest(0.0, least(suit, 100.0)), 3) AS localization_suitability_score, CASE WHEN suit >= 70 THEN 'high' WHEN suit >= 45 THEN 'medium' ELSE 'low' END AS suitability FROM v9),
v11 AS (SELECT *, growth_score * 0.25::DOUBLE + least(interest_score * 4, 100.0) * 0.2::DOUBLE + least(topic_relevance_score::DOUBLE * 4, 100.0) * 0.18::DOUBLE + engagement_score * 0.12::DOUBLE + freshness_score * 0.08::DOUBLE + localization_suitability_score * 0.08::DOUBLE + caption_score::DOUBLE * 0.05::DOUBLE + source_diversity_score * 0.04::DOUBLE AS raw FROM v10),
built AS (SELECT *, round(greatest(0.0, raw - boring_penalty::DOUBLE - CASE copyright_risk WHEN 'low' THEN 0 WHEN 'medium' THEN 3 WHEN 'high' THEN 10 ELSE 30 END - CASE language_confidence WHEN 'medium' THEN 2 WHEN 'low' THEN 10 ELSE 0 END), 3) AS final_score,
  CASE WHEN lower(source) = 'src19' THEN 'blacklist_channel' WHEN published IS NULL THEN 'missing_published_at' WHEN populars > 0 AND (age < 0 OR age > {S.popular_max_age_hours}) THEN 'outside_popular_age_window' WHEN populars = 0 AND searches = 0 THEN 'missing_discovery_source'
    WHEN k = 9 THEN 'live_or_upcoming' WHEN k = 7 THEN 'not_public' WHEN duration_seconds NOT BETWEEN 60 AND 2700 THEN 'duration_out_of_range' WHEN duration_seconds <= 180 AND contains(x, '#shorts') THEN 'shorts' WHEN hard THEN 'hard_exclude' WHEN language_reason <> '' THEN language_reason
    WHEN primary_topic = 'other' THEN 'low_topic_relevance' WHEN view_count < {LEAST(S.topic_min_view_count)} OR view_count / hours < {LEAST(S.topic_min_views_per_hour)} THEN 'low_absolute_heat'
    WHEN populars > 0 AND searches = 0 AND (copyright_risk = 'very_high' OR suitability = 'low') THEN 'popular_not_localizable' ELSE '' END AS filter_reason FROM v11)
"""

ORACLE_SQL = {
    "candidate_scores": f"""WITH {BUILT} SELECT video_id, filter_reason, primary_topic, topic_relevance_score::DOUBLE AS topic_relevance_score, interest_score, boring_penalty::DOUBLE AS boring_penalty, view_count, views_per_hour, like_rate, growth_score, engagement_score, freshness_score, localization_suitability_score, source_diversity_score, copyright_risk, language_confidence, duration_seconds, round(final_score, 1) AS final_score FROM built""",
    "rejection_counts": f"WITH {BUILT} SELECT CASE WHEN filter_reason = '' THEN 'accepted' ELSE filter_reason END AS reason, count(*) AS n FROM built GROUP BY 1",
    "wildcard_pool": f"WITH {BUILT} SELECT video_id, interest_score FROM built WHERE populars > 0 AND copyright_risk <> 'very_high' AND suitability IN ('medium', 'high') AND interest_score >= {S.wildcard_interest_min}",
    "topic_quota": f"""WITH {BUILT}, q AS (SELECT video_id, 'r' || (video_id % 3) AS region, primary_topic, row_number() OVER (PARTITION BY video_id % 3, primary_topic ORDER BY searches > 0 DESC, final_score DESC, video_id) AS topic_rank FROM built WHERE primary_topic <> 'other')
      SELECT video_id, region, primary_topic, CAST(topic_rank AS INTEGER) AS topic_rank FROM q WHERE topic_rank <= CASE primary_topic WHEN 'alpha' THEN 12 WHEN 'beta' THEN 8 WHEN 'gaming' THEN 6 ELSE 0 END""",
    "hit_rollup": f"""WITH {HITS} SELECT video_id, coalesce(string_agg(DISTINCT mode, '|' ORDER BY mode), '') AS search_mode, coalesce(string_agg(DISTINCT query_group, '|' ORDER BY query_group), '') AS query_group, coalesce(string_agg(DISTINCT query_text, ' || ' ORDER BY query_text), '') AS query_text,
      coalesce(min(rank), 0) AS search_rank, list_sort(coalesce(list(DISTINCT feed) FILTER (feed IS NOT NULL), [])) AS popular_source_details, CAST(count(DISTINCT (mode, query_group, rank, query_text)) FILTER (kind = 'search') AS INTEGER) AS details FROM hits GROUP BY video_id""",
    "discovery_counts": f"WITH {HITS}, f AS (SELECT video_id, bool_or(kind = 'popular') AS p, bool_or(kind = 'search') AS s FROM hits GROUP BY 1) SELECT count(*) FILTER (p) AS popular, count(*) FILTER (s) AS search, count(*) FILTER (p AND s) AS overlap, count(*) AS merged FROM f",
    "found_both_ways": f"WITH {HITS} SELECT video_id FROM hits WHERE kind = 'popular' INTERSECT SELECT video_id FROM hits WHERE kind = 'search'",
    "merged_resources": "SELECT doc_id AS video_id, CASE WHEN doc_id % 3 = 0 THEN 'details' ELSE 'popular' END AS lang FROM documents WHERE doc_id % 2 = 0 OR doc_id % 3 = 0",
    "parsed_hits": """SELECT event_id AS video_id, CASE event_type WHEN 'view' THEN 'search' ELSE 'popular' END AS kind, CASE WHEN event_type = 'view' THEN 'fresh' END AS mode, CASE WHEN event_type = 'view' THEN 'g' || (user_id % 5) END AS query_group,
      CASE WHEN event_type = 'view' THEN CAST(event_id % 50 AS INTEGER) END AS rank, CASE WHEN event_type = 'view' THEN 'a::b' END AS query_text, CASE WHEN event_type = 'click' THEN 'feed' || (user_id % 3) END AS feed FROM events WHERE event_type IN ('view', 'click')""",
    "feed_topics": f"WITH {HITS} SELECT video_id, list_sort(list(DISTINCT CASE feed WHEN 'feed0' THEN 'alpha' ELSE 'beta' END)) AS topics FROM hits WHERE feed IN ('feed0', 'feed1') GROUP BY 1",
    "rights_gate": """WITH r AS (SELECT CASE WHEN o_orderkey % 3 <> 1 THEN 'u' WHEN o_orderstatus <> 'O' THEN 'r' ELSE 'a' END AS x FROM orders) SELECT count(*) AS total, count(*) FILTER (x = 'a') AS approved, count(*) FILTER (x = 'u') AS skipped_unselected, count(*) FILTER (x = 'r') AS skipped_rights FROM r""",
    "requested_rows": "SELECT o_orderkey AS video_id FROM orders WHERE o_orderkey IN (SELECT doc_id FROM documents)",
    "title_pairs": f"""WITH t AS (SELECT DISTINCT list_sort({TOKENS.format(TITLE)}) AS w FROM documents), k AS (SELECT w, array_to_string(w, ' ') AS key FROM t)
      SELECT l.key AS a, r.key AS b FROM k l JOIN k r ON l.key < r.key WHERE len(list_intersect(l.w, r.w)) / len(list_distinct(list_concat(l.w, r.w))) >= 0.65""",
    "ranked_candidates": "SELECT doc_id AS video_id, lang, (n_chars % 101)::DOUBLE AS final_score, CAST(row_number() OVER (PARTITION BY lang ORDER BY n_chars % 101 DESC, doc_id) AS INTEGER) AS rank FROM documents",
    "query_plan": """WITH days AS (SELECT DISTINCT CAST(ts AS DATE) AS day FROM events), o AS (SELECT day, datediff('day', DATE '0001-01-01', day) + 1 AS n FROM days),
      fixed AS (SELECT day, unnest([(1, 'alpha', 'core_01', 'a1'), (2, 'alpha', 'core_02', 'a2'), (3, 'beta', 'core_01', 'b1'), (4, 'gaming', 'core_01', 'g1')]) AS p FROM o),
      turn AS (SELECT day, n, unnest([(0, 'alpha', 2, ['x1', 'x2', 'x3']), (1, 'beta', 2, ['y1', 'y2', 'y3', 'y4', 'y5']), (2, 'gaming', 0, ['z1', 'z2'])]) AS p FROM o),
      tail AS (SELECT day, p, (n * greatest(p[3], 1)) % len(p[4]) AS start, unnest(range(0, p[3])) AS i FROM turn)
      SELECT day, p[1] AS position, p[2] AS topic, p[3] AS name, p[4] AS query FROM fixed UNION ALL
      SELECT day, CAST(4 + row_number() OVER (PARTITION BY day ORDER BY p[1], i) AS INTEGER), p[2], 'tail_' || lpad(CAST((start + i) % len(p[4]) + 1 AS VARCHAR), 2, '0'), p[4][(start + i) % len(p[4]) + 1] FROM tail""",
    "stage_states": f"WITH {STATES} SELECT * FROM states",
    "download_status": """WITH s AS (SELECT l_orderkey, l_linenumber, l_orderkey % 3 AS k, (l_suppkey + 1) % 7 = 0 AS m, (l_suppkey + 2) % 7 = 0 AS v, (l_suppkey + 3) % 7 = 0 AS p, (l_suppkey + 4) % 7 = 0 AS a, l_suppkey % 7 = 0 AS t FROM lineitem)
      SELECT l_orderkey, l_linenumber, CASE WHEN k = 0 THEN CASE WHEN m THEN 'failed' ELSE 'success' END WHEN k = 1 THEN CASE WHEN m THEN 'failed' WHEN t THEN 'partial_success' ELSE 'success' END WHEN m OR v THEN 'failed' WHEN p OR a OR t THEN 'partial_success' ELSE 'success' END AS overall_status FROM s""",
    "active_jobs": f"""WITH {JOBS}, t AS (SELECT DISTINCT 't' || (c_custkey % 500) AS task, 't' || c_nationkey AS video_id FROM customer), live AS (SELECT target, arg_max(struct_pack(id := id, status := status, step := step), (created_at, id)) AS j FROM jobs WHERE status IN ('queued', 'running') GROUP BY 1)
      SELECT t.task, t.video_id, coalesce(a.j, b.j).id AS active_id, coalesce(a.j, b.j).status AS active_status, coalesce(a.j, b.j).step AS active_step FROM t LEFT JOIN live a ON a.target = t.task LEFT JOIN live b ON b.target = t.video_id""",
    "dashboard": f"""WITH {STATES}, {JOBS} SELECT (SELECT count(*) FROM states) AS tasks, (SELECT count(*) FROM states WHERE render = 'complete') AS rendered, (SELECT count(*) FROM states WHERE publish = 'complete') AS published,
      count(*) FILTER (status = 'queued') AS queued, count(*) FILTER (status = 'running') AS running, count(*) FILTER (status = 'failed') AS failed FROM jobs""",
    "batch_rollup": f"WITH {JOBS} SELECT id % 10 AS batch, status, count(*) AS n FROM jobs GROUP BY ROLLUP (id % 10, status)",
    "latest_jobs": f"WITH {JOBS} SELECT id, status FROM jobs ORDER BY created_at DESC, id DESC LIMIT 20",
    "next_queued": f"WITH {JOBS} SELECT id, target FROM jobs WHERE status = 'queued' ORDER BY created_at, id LIMIT 1",
    "latest_state": f"WITH {JOBS}, l AS (SELECT target AS id, arg_max(status, (created_at, id)) AS s FROM jobs GROUP BY 1) SELECT id, CASE WHEN s = 'running' THEN 'queued' ELSE s END AS status FROM l",
    "log_storage": f"""WITH {JOBS}, f AS (SELECT 'log' || (l_orderkey % 1200) AS path, CAST(sum(l_quantity) AS BIGINT) AS size FROM lineitem GROUP BY 1), live AS (SELECT DISTINCT log_path FROM jobs WHERE status IN ('queued', 'running'))
      SELECT CASE WHEN log_path IS NULL THEN 'inactive' ELSE 'active' END AS state, count(*) AS logs, CAST(sum(size) AS BIGINT) AS bytes FROM f LEFT JOIN live ON path = log_path GROUP BY 1""",
    "completeness": f"""WITH {FILES}, n AS (SELECT DISTINCT o_orderkey % 400 AS task FROM orders), g AS (SELECT task, path, max(size) AS size FROM files GROUP BY 1, 2), s AS (SELECT task, count(*) FILTER (path IN ('video/source.mp4', 'metadata/info.json', 'audio/source_audio.wav') AND size > 0) AS c, bool_or(path = 'metadata/description.txt') AS d FROM g GROUP BY 1)
      SELECT task, task % 5 <> 0 AND task % 7 <> 0 AND coalesce(c, 0) = 3 AND coalesce(d, FALSE) AS complete FROM n LEFT JOIN s USING (task)""",
    "first_existing": f"WITH {FILES} SELECT task, arg_min(path, CASE path WHEN 'subtitles/zh.auto.vtt' THEN 1 WHEN 'subtitles/zh.clean.srt' THEN 2 ELSE 3 END) AS path FROM files WHERE size > 0 AND path IN ('subtitles/zh.auto.vtt', 'subtitles/zh.clean.srt', 'video/source.mp4') GROUP BY 1",
    "translation_ready": f"WITH {FILES}, n AS (SELECT DISTINCT o_orderkey % 400 AS task FROM orders) SELECT task, task % 3 <> 0 AND EXISTS (SELECT 1 FROM files f WHERE f.task = n.task AND f.task % 4 <> 1 AND size > 0 AND path = 'subtitles/zh.clean.srt') AS translation_ready FROM n",
    "auto_captions": f"""WITH {FILES}, n AS (SELECT DISTINCT o_orderkey % 450 AS task FROM orders), g AS (SELECT task, bool_or(path = 'subtitles/zh.auto.srt') AS a, bool_or(path = 'subtitles/zh.auto.vtt') AS b FROM files WHERE size > 0 AND task % 6 <> 1 GROUP BY 1)
      SELECT task, CASE WHEN a THEN 'subtitles/zh.auto.srt' WHEN b THEN 'subtitles/zh.auto.vtt' END AS auto_path FROM n LEFT JOIN g USING (task)""",
    "unique_source": """WITH r AS (SELECT l_orderkey % 900 AS task, l_linenumber AS level, 'video/' || (l_suppkey % 3) || CASE WHEN l_partkey % 5 = 0 THEN '.txt' ELSE '.mp4' END AS path FROM lineitem WHERE l_linenumber > 2), p AS (SELECT task, level, count(DISTINCT path) AS n, min(path) AS p FROM r WHERE ends_with(path, '.mp4') GROUP BY 1, 2),
      f AS (SELECT task, arg_min(n, level) AS n, arg_min(p, level) AS p FROM p GROUP BY 1) SELECT t.task, CASE WHEN n = 1 THEN p END AS path, CASE WHEN n IS NULL THEN 'SOURCE_VIDEO_NOT_FOUND' WHEN n > 1 THEN 'AMBIGUOUS_SOURCE_VIDEO' END AS error FROM (SELECT DISTINCT task FROM r) t LEFT JOIN f USING (task)""",
    "last_errors": """WITH e AS (SELECT o_orderkey, list_filter(list_concat(list_concat(list_transform(range(0, o_orderkey % 2 + 1), lambda i: CASE WHEN i % 3 = 2 THEN '' ELSE 'e2-' || i END), list_transform(range(0, o_orderkey % 3 + 1), lambda i: CASE WHEN i % 3 = 2 THEN '' ELSE 'e3-' || i END)), list_transform(range(0, o_orderkey % 5 + 1), lambda i: CASE WHEN i % 3 = 2 THEN '' ELSE 'e5-' || i END)), lambda x: x <> '') AS a FROM orders)
      SELECT o_orderkey, array_to_string(a[greatest(len(a) - 4, 1):], '|') AS errors FROM e""",
    "checkpoint_match": "SELECT o_orderkey AS task, CASE WHEN o_orderkey % 5 = 3 THEN 'reused' WHEN o_orderkey % 5 = 0 THEN 'migrated' ELSE 'rebuild' END AS action FROM orders",
    "usage_cost": "SELECT l_orderkey % 50 AS video_id, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS prompt_tokens, CAST(sum(l_linenumber) AS BIGINT) AS completion_tokens, CAST(sum(CAST(l_quantity AS BIGINT) + l_linenumber) AS BIGINT) AS total_tokens, round(sum(CAST(l_quantity AS BIGINT)) / 1e6 * 2.0 + sum(l_linenumber) / 1e6 * 8.0, 6)::DOUBLE AS estimated_cost FROM lineitem GROUP BY 1",
    "parsed_responses": f"WITH {CUES} SELECT video_id, cue_id AS id, trim(text) AS translation FROM cues WHERE cue_id % 4 <> 1 AND trim(text) <> ''",
    "snapshot_dates": "SELECT o_orderkey, CASE WHEN o_orderkey % 3 < 2 THEN CAST(o_orderdate AS DATE) ELSE DATE '2000-01-01' END AS day FROM orders",
    "video_links": """WITH p AS (SELECT page_id, url, substr(md5(CAST(page_id AS VARCHAR)), 1, 11) AS i, page_id % 6 AS k FROM pages) SELECT page_id, CASE WHEN k < 4 THEN i END AS found FROM p""",
    "redacted_logs": "SELECT page_id, 'GET ' || regexp_replace(url, '[?#].*$', '') || ' <redacted> --cookies <cookies_file> see https://h.example/p?v=1' AS line FROM pages",
    "error_classes": """SELECT CASE o_orderkey % 5 WHEN 0 THEN 'transient' WHEN 1 THEN 'sign_in' WHEN 2 THEN 'rejected' ELSE 'other' END AS class, CASE WHEN o_orderkey % 5 = 2 THEN 21010 END AS code, CASE WHEN o_orderkey % 5 = 2 THEN 'no' END AS message, count(*) AS n FROM orders GROUP BY 1, 2, 3""",
    "fingerprints": """SELECT n_nationkey, sha256('{"n_name":"' || n_name || '","n_nationkey":' || n_nationkey || '}') AS fingerprint FROM nation""",
    "candidate_links": "SELECT page_id, CASE page_id % 3 WHEN 0 THEN url WHEN 1 THEN 'https://www.youtube.com/watch?v=' || page_id ELSE '' END AS link FROM pages",
    "candidate_recovery": """WITH t AS (SELECT o_orderkey AS task, o_custkey AS video_id, o_orderkey % 9 AS f FROM orders), listed AS (SELECT DISTINCT f, video_id FROM t WHERE task % 3 = 0 AND f <> 6), known AS (SELECT DISTINCT f FROM listed)
      SELECT t.task, CASE WHEN t.task % 8 = 0 THEN 'local' WHEN l.f IS NOT NULL THEN 'listed' END AS candidate, CASE WHEN t.task % 8 = 0 OR l.f IS NOT NULL THEN NULL WHEN k.f IS NULL THEN 'candidate_file_missing' ELSE 'video_id_not_in_file' END AS error
      FROM t LEFT JOIN listed l ON l.f = t.f AND l.video_id = t.video_id LEFT JOIN known k ON k.f = t.f""",
    "time_helpers": """WITH o AS (SELECT *, CAST(round(o_totalprice / 10 * 1000, 0) AS BIGINT) AS ms, CAST(round(o_totalprice / 10 * 100, 0) AS BIGINT) AS cs, CAST(floor(o_totalprice / 10) AS BIGINT) AS s FROM orders)
      SELECT o_orderkey, lpad(CAST(ms // 3600000 AS VARCHAR), 2, '0') || ':' || lpad(CAST(ms // 60000 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(ms // 1000 % 60 AS VARCHAR), 2, '0') || ',' || lpad(CAST(ms % 1000 AS VARCHAR), 3, '0') AS srt,
        (cs // 360000) || ':' || lpad(CAST(cs // 6000 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(cs // 100 % 60 AS VARCHAR), 2, '0') || '.' || lpad(CAST(cs % 100 AS VARCHAR), 2, '0') AS ass,
        CASE WHEN s >= 3600 THEN lpad(CAST(s // 3600 AS VARCHAR), 2, '0') || ':' ELSE '' END || lpad(CAST(s // 60 % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(s % 60 AS VARCHAR), 2, '0') AS clock, o_orderkey / 8 AS back,
        (o_orderkey % 100) * 60 + o_custkey % 60 AS seconds, CASE WHEN o_orderkey % 2 = 0 THEN o_custkey ELSE 0 END AS number FROM o""",
    "day_windows": """WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders) SELECT day, epoch_us(timezone('America/New_York', CAST(day AS TIMESTAMP))) AS first, epoch_us(timezone('America/New_York', CAST(day + 1 AS TIMESTAMP))) - 1 AS last FROM d""",
    "probe_facts": """WITH p AS (SELECT page_id AS video_id, page_id % 4 * 90 AS rotation, length(html) AS n FROM pages)
      SELECT video_id, greatest(n % 500 + 0.5, n % 400)::DOUBLE AS duration, CAST(CASE WHEN rotation IN (90, 270) THEN 1080 ELSE 1920 END AS INTEGER) AS display_width, CAST(CASE WHEN rotation IN (90, 270) THEN 1920 ELSE 1080 END AS INTEGER) AS display_height, round(video_id % 60 * 1000 / 1001, 6) AS rate, CAST(rotation AS INTEGER) AS rotation, 'copy' AS audio FROM p""",
}

ORACLE_SQL["detected_languages"] = r"""WITH t AS (SELECT doc_id, lang, regexp_replace(lower(coalesce(text, '')), '[ \t\n\x0B\f\r]+', ' ', 'g') AS t FROM documents),
  o AS (SELECT doc_id, lang, list_transform(string_split(t, ''), lambda c: ord(c)) AS o FROM t),
  p AS (SELECT doc_id, lang, unnest(list_transform(range(1, len(o) - 1), lambda i: (o[i] * 961 + o[i + 1] * 31 + o[i + 2]) % 4096)) AS p FROM o),
  c AS (SELECT doc_id, lang, p, count(*) AS n FROM p GROUP BY ALL), langs AS (SELECT DISTINCT lang AS l FROM documents WHERE doc_id % 4 <> 0 AND lang IS NOT NULL),
  places AS (SELECT l, p FROM langs, (SELECT unnest(range(4096)) AS p)), seen AS (SELECT lang AS l, p, sum(n) AS n FROM c WHERE doc_id % 4 <> 0 GROUP BY ALL), totals AS (SELECT l, sum(n) AS total FROM seen GROUP BY l),
  w AS (SELECT places.l, places.p, ln((coalesce(n, 0) + 1) / (total + 4096)) AS w FROM places JOIN totals USING (l) LEFT JOIN seen ON seen.l = places.l AND seen.p = places.p),
  s AS (SELECT doc_id, w.l, sum(c.n * w.w) AS s FROM c JOIN w ON w.p = c.p GROUP BY ALL), best AS (SELECT doc_id, first(l ORDER BY s DESC, l) AS l FROM s GROUP BY doc_id)
  SELECT t.doc_id, t.lang, CASE WHEN length(t.t) >= 5 THEN best.l ELSE 'unknown' END AS detected, t.doc_id % 4 = 0 AS held_out FROM t LEFT JOIN best USING (doc_id)"""

_PLAIN = r"regexp_replace(regexp_replace(trim(regexp_replace(coalesce({0}, ''), '\s+', ' ', 'g')), '^\s*【\s*中英双语\s*】\s*', ''), '^[ ｜|+\-]+|[ ｜|+\-]+$', '', 'g')"
ORACLE_SQL["bilingual_titles"] = f"""WITH g AS (SELECT doc_id, CASE doc_id % 8 WHEN 0 THEN '' WHEN 1 THEN ' 【 中英双语 】' || repeat('题', (doc_id % 45)::INTEGER) || '｜' WHEN 2 THEN text WHEN 3 THEN repeat('中 文', (doc_id % 30)::INTEGER) ELSE '猫和狗' END AS z,
    CASE doc_id % 8 WHEN 4 THEN '猫和狗' WHEN 5 THEN source WHEN 6 THEN array_to_string(string_split(text, ' ')[1:11], ' ') WHEN 7 THEN NULL ELSE text END AS e FROM documents),
  p AS (SELECT doc_id, CASE WHEN {_PLAIN.format("z")} = '' THEN '中英双语精选' ELSE {_PLAIN.format("z")} END AS zh, {_PLAIN.format("e")} AS en FROM g),
  o AS (SELECT doc_id, zh, CASE WHEN en <> '' AND lower(en) <> lower(zh) THEN en END AS en FROM p),
  c AS (SELECT *, length(zh) + length(en) > 73 AS crowded FROM o), f AS (SELECT *, CASE WHEN crowded THEN rtrim(zh[1:36]) ELSE zh END AS head FROM c), r AS (SELECT *, 73 - length(head) AS room FROM f),
  s AS (SELECT *, CASE WHEN NOT crowded THEN en WHEN room > 1 THEN CASE WHEN length(rtrim(en[1:room])) < length(en) THEN rtrim(rtrim(en[1:room])[1 : length(rtrim(en[1:room])) - 1]) || '…' ELSE en END END AS tail FROM r)
  SELECT doc_id, ('【中英双语】' || head || coalesce('｜' || tail, ''))[1:80] AS title FROM s"""

_CHECKS = (
    ("output_exists", "k <> 18"), ("output_size_valid", "k NOT IN (17, 18)"), ("ffprobe_parsed", "there"), ("video_stream_exists", "there AND k <> 16"), ("audio_stream_exists", "there AND k <> 7"), ("duration_matches", "there AND k <> 8"),
    ("resolution_matches", "there AND k <> 10"), ("frame_rate_matches", "there AND k <> 11"), ("audio_stream_count_matches", "there AND k NOT IN (5, 7)"), ("ffmpeg_returned_zero", "k <> 19"), ("temporary_files_cleaned", "k <> 20"),
    ("video_stream_copied", "hard OR (there AND k NOT IN (13, 14))"), ("audio_streams_copied", "hard OR (there AND k NOT IN (4, 5, 7))"), ("ass_subtitle_exists", "hard OR (there AND k NOT IN (1, 2, 15))"), ("subtitle_title_and_language", "hard OR (there AND k NOT IN (1, 15))"),
    ("subtitle_default", "hard OR (there AND k NOT IN (1, 3, 15))"), ("hardsub_video_encoded", "NOT hard OR (there AND k <> 14)"), ("audio_content_present", "NOT hard OR (there AND k <> 7)"), ("audio_duration_matches", "NOT hard OR (there AND k NOT IN (5, 6, 7))"),
    ("audio_transcode_recorded", "NOT hard OR (there AND k NOT IN (4, 5, 7)) OR page_id % 48 = 28"),
)
ORACLE_SQL["render_checks"] = f"""WITH p AS (SELECT page_id, page_id % 24 AS k, page_id // 24 % 2 = 1 AS hard, page_id % 24 <> 21 AS there FROM pages),
  f AS (SELECT *, list_filter([{", ".join(f"CASE WHEN NOT ({test}) THEN '{name}' END" for name, test in _CHECKS)}], lambda x: x IS NOT NULL) AS failed FROM p)
  SELECT page_id AS video_id, array_to_string(failed, ',') AS failed, CASE WHEN len(failed) = 0 THEN 'QC_PASSED' ELSE 'FAILED' END AS qc_status,
    round(CASE WHEN NOT there THEN -60.0 WHEN k = 8 THEN 0.6 WHEN k = 9 THEN 0.4 ELSE 0.0 END::DOUBLE, 6) AS duration_difference FROM f"""

_CLOCK = "lpad((({0}) // 3600000)::VARCHAR, 2, '0') || ':' || lpad((({0}) // 60000 % 60)::VARCHAR, 2, '0') || ':' || lpad((({0}) // 1000 % 60)::VARCHAR, 2, '0') || ',' || lpad((({0}) % 1000)::VARCHAR, 3, '0')"
ORACLE_SQL["review_sheet"] = f"""WITH {V.TRANSLATIONS}, j AS (SELECT s.*, round(s.start * 1000)::BIGINT AS a, round(s."end" * 1000)::BIGINT AS b, t.translation AS raw, c.translation AS clean FROM src s LEFT JOIN tr t ON t.video_id = s.video_id AND t.id = s.id
    LEFT JOIN (SELECT * FROM tr WHERE id % 2 = 0) c ON c.video_id = s.video_id AND c.id = s.id)
  SELECT video_id, id, {_CLOCK.format("a")} AS start, {_CLOCK.format("b")} AS "end", format('{{:.3f}}', greatest("end" - start, 0.0)) AS duration, text AS english, coalesce(raw, '') AS chinese_raw, coalesce(clean, raw, '') AS chinese_clean,
    coalesce(clean, raw, '') AS reviewed_translation, 'A|B' AS qc_flags, 'whisper' AS source, '' AS reviewer_note FROM j"""
