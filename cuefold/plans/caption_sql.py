"""DuckDB SQL of the caption queries. Queries that need text ratios, ordered folds or look-behind have none."""

from __future__ import annotations

from cuefold.plans.caption_queries import COMP, KEY, W1, WORDS
from cuefold.plans.views import CUES, INTERVALS, ROLLING, SPOKEN, TRACKS, TRANSLATED, TRANSLATIONS, UNION_SQL

PAIRS = ROLLING + f""",
p AS (SELECT *, {COMP.format("text")} AS now FROM rolling),
q AS (SELECT *, lag(now) OVER w AS prev, lag(start) OVER w AS ps, lag("end") OVER w AS pe, greatest("end" - start, 0.0) AS d FROM p {W1}),
adj AS (SELECT *, coalesce(now = prev, FALSE) AS duplicate, coalesce(now <> '' AND prev <> '' AND starts_with(now, prev), FALSE) AS prefix,
  coalesce(now <> '' AND prev <> '' AND contains(now, prev), FALSE) AS contained, coalesce(start < ps, FALSE) AS reversed, coalesce(start < pe, FALSE) AS overlap, coalesce(start - pe > 0 AND start - pe < 0.02, FALSE) AS small_gap FROM q)
"""
LENGTHS = 'lengths AS (SELECT video_id, max("end") AS m FROM cues GROUP BY video_id)'
OVER = """
pairs AS (SELECT l.video_id, l.cue_id, r.cue_id AS r_cue_id, round(least(l."end", r."end") - greatest(l.start, r.start), 3) AS seconds
  FROM left_track l JOIN right_track r ON l.video_id = r.video_id AND least(l."end", r."end") > greatest(l.start, r.start))
"""
MERGED = UNION_SQL.format(name="va", source="(SELECT * FROM spans WHERE track = 'view')") + "," + UNION_SQL.format(name="vb", source="(SELECT * FROM spans WHERE track <> 'view')")
ROUGH = """
rough AS (SELECT video_id, cue_id, track, floor(start / 20) * 20.0 AS start, floor("end" / 20) * 20.0 AS "end", text FROM cues)
"""
INCREMENT = ROLLING + f""",
seen AS (SELECT *, coalesce(last_value(CASE WHEN trim(text) <> '' THEN text END IGNORE NULLS) OVER (PARTITION BY video_id ORDER BY cue_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS prev FROM rolling),
toks AS (SELECT *, {COMP.format("prev")} AS a, {COMP.format("text")} AS b, {WORDS.format("text")} AS words, {WORDS.format("prev")} AS before FROM seen),
keyed AS (SELECT *, list_transform(words, lambda t: {KEY.format("t")}) AS wk, list_transform(before, lambda t: {KEY.format("t")}) AS bk FROM toks),
sized AS (SELECT *, coalesce(list_max(list_filter(range(2, least(len(wk), len(bk)) + 1), lambda k: bk[len(bk) - k + 1:len(bk)] = wk[1:k] AND NOT list_contains(wk[1:k], ''))), 0) AS size FROM keyed),
kinds AS (SELECT *, CASE WHEN trim(text) = '' THEN 'empty' WHEN a = '' THEN 'new' WHEN a = b THEN 'exact' WHEN starts_with(b, a) THEN 'prefix'
  WHEN contains(a, b) AND length(b) >= greatest(4, CAST(floor(length(a) * 0.6) AS INTEGER)) THEN 'contained' WHEN size >= 2 THEN 'suffix_prefix' ELSE 'new' END AS reason FROM sized)
"""
ASR = ROLLING + """,
raw AS (SELECT video_id, start, "end", (cue_id * 13 % 10) / 10 AS no_speech_prob, (-(cue_id % 5)) / 4 AS avg_logprob FROM rolling),
words AS (SELECT video_id, start, CASE WHEN cue_id % 6 <> 0 THEN "end" END AS "end", (cue_id * 7 % 10) / 10 AS probability FROM cues),
audio AS (SELECT video_id, max("end") * 1.2 AS duration FROM cues GROUP BY video_id)
"""

ONE_LINE = r"regexp_replace(trim(regexp_replace(text, '\s+', ' ', 'g')), '\s+([,.;:!?])', '\1', 'g')"


def flags_sql(source: str, translation: str, ratio: str) -> str:
    """The list of a cue's flags, with one glossary term."""
    numbers = lambda c: rf"regexp_extract_all({c}, '\d+(?:[.,]\d+)?')"
    checks = [
        (f"{ratio} > 1.25", "TTS_TOO_LONG"), (f"{ratio} > 1.25", "TOO_LONG_FOR_DURATION"), (f"{ratio} > 1.15 AND {ratio} <= 1.25", "TTS_LENGTH_WARNING"),
        (f"trim({translation}) = ''", "EMPTY_TRANSLATION"), (f"length({translation}) > 40", "CHINESE_TOO_LONG"), (f"contains(lower({source}), 'the') AND NOT contains({translation}, '该')", "GLOSSARY_MISMATCH:the"),
        (f"len(list_filter({numbers(source)}, lambda n: NOT list_contains({numbers(translation)}, n))) > 0", "NUMBER_MISMATCH"),
        (rf"regexp_matches({source}, '(?i)\b(?:no|not|never|without|n''t)\b') AND NOT regexp_matches({translation}, '不|没|无|未|别|从不')", "NEGATION_MISMATCH"),
        (f"len(regexp_extract_all({translation}, '[A-Za-z]')) > greatest(8.0, length({translation}) * 0.35::DOUBLE)", "ENGLISH_LEAKAGE"),
        (f"regexp_matches({translation}, '进行一个|对于.*来说|值得注意的是')", "TRANSLATIONESE"), (f"regexp_matches({translation}, '，，|。。|！！|？？')", "UNNATURAL_PUNCTUATION"),
    ]
    cases = ", ".join(f"CASE WHEN {test} THEN '{name}' END" for test, name in checks)
    return f"list_filter([{cases}], lambda f: f IS NOT NULL)"


def spoken_sql(translation: str) -> str:
    return rf"round(len(regexp_extract_all({translation}, '[\x{{3400}}-\x{{9fff}}A-Za-z0-9]')) / 4.5::DOUBLE, 3)"


ORACLE_SQL = {
    "caption_qc": f"""WITH {PAIRS}, g AS (SELECT video_id, count(*) FILTER (trim(text) = '') AS empty_segments, count(*) FILTER (duplicate) AS adjacent_duplicates, count(*) FILTER (prefix) AS rolling_duplicate_residuals, count(*) FILTER (overlap) AS "overlaps",
      count(*) FILTER (start >= "end") AS invalid_timestamps, count(*) FILTER (reversed) AS reversed_timestamps, count(*) FILTER (d < 0.3) AS under_0_3_seconds, count(*) FILTER (d > 8.0) AS over_8_seconds,
      count(*) FILTER (d > 0 AND length(text) / d > 22) AS over_22_cps, round(sum(d), 3) AS coverage_seconds, count(*) AS output_segments FROM adj GROUP BY video_id)
      SELECT *, CASE WHEN empty_segments + adjacent_duplicates + "overlaps" + invalid_timestamps = 0 THEN 'QC_PASSED' ELSE 'REVIEW_REQUIRED' END AS status FROM g""",
    "adjacent_pairs": f"WITH {PAIRS} SELECT video_id, cue_id, duplicate, prefix, contained, reversed, overlap, small_gap FROM adj",
    "strict_order": f"""WITH {ROLLING}, {LENGTHS}, q AS (SELECT r.*, m - 5.0 AS duration, coalesce(lag(start) OVER w, -1.0) AS ps, coalesce(lag("end") OVER w, -1.0) AS pe FROM rolling r JOIN lengths USING (video_id) {W1})
      SELECT video_id, cue_id, start < 0 OR "end" <= start OR start < ps OR "end" < pe OR "end" > duration + 0.001 AS invalid FROM q""",
    "timeline_summary": f"""WITH {PAIRS} SELECT video_id, arg_min(start, cue_id) AS first_start, arg_max("end", cue_id) AS last_end, round(sum(d), 3) AS cue_seconds, count(*) FILTER (overlap) AS overlaps, count(*) AS segments FROM adj GROUP BY video_id""",
    "translation_preflight": "SELECT conv_id AS video_id, count(*) AS segments, CAST(ceil(count(*) / 3) AS BIGINT) AS batches FROM conversations GROUP BY 1",
    "timed_increment": f"""WITH {INCREMENT} SELECT video_id, cue_id, reason, CASE reason WHEN 'new' THEN trim(text) WHEN 'prefix' THEN array_to_string(words[len(before) + 1:], ' ') WHEN 'suffix_prefix' THEN array_to_string(words[size + 1:], ' ') ELSE '' END AS increment,
      CAST(CASE WHEN reason IN ('exact', 'contained') THEN len(words) WHEN reason = 'prefix' THEN len(before) WHEN reason = 'suffix_prefix' THEN size ELSE 0 END AS INTEGER) AS removed FROM kinds""",
    "split_long": f"""WITH {CUES}, k AS (SELECT *, greatest(0.05, "end" - start) AS long, CAST(greatest(ceil(greatest(0.05, "end" - start) / 7.0), 1) AS INTEGER) AS k, {WORDS.format("text")} AS words FROM cues),
      i AS (SELECT *, unnest(range(0, k)) AS i FROM k),
      t AS (SELECT *, CASE WHEN k = 1 THEN text WHEN len(words) >= k THEN array_to_string(words[CAST(round_even(i * len(words) / k, 0) AS INTEGER) + 1:CAST(round_even((i + 1) * len(words) / k, 0) AS INTEGER)], '')
        ELSE trim(substr(text, CAST(round_even(i * length(text) / k, 0) AS INTEGER) + 1, CAST(round_even((i + 1) * length(text) / k, 0) - round_even(i * length(text) / k, 0) AS INTEGER))) END AS part FROM i)
      SELECT video_id, CAST(row_number() OVER (PARTITION BY video_id ORDER BY start, "end", cue_id, i) AS INTEGER) AS cue_id, round(1e-7::DOUBLE + CASE WHEN k = 1 THEN start ELSE start + long * i / k END, 3) AS start,
        round(1e-7::DOUBLE + CASE WHEN k = 1 THEN "end" ELSE start + long * (i + 1) / k END, 3) AS "end", replace(part, ' ', '') AS signs FROM t WHERE k = 1 OR part <> ''""",
    "translation_batches": f"""WITH {CUES}, r AS (SELECT *, row_number() OVER w AS row FROM cues {W1}), b AS (SELECT *, CAST(floor((row - 1) / 3) + 1 AS INTEGER) AS batch FROM r), g AS (SELECT video_id, batch, count(*) AS cues, min(row) AS lo, max(row) AS hi FROM b GROUP BY ALL)
      SELECT g.video_id, g.batch, CAST(cues AS INTEGER) AS cues, coalesce((SELECT list(cue_id ORDER BY row) FROM b WHERE b.video_id = g.video_id AND row BETWEEN lo - 3 AND lo - 1), []) AS before,
        coalesce((SELECT list(cue_id ORDER BY row) FROM b WHERE b.video_id = g.video_id AND row BETWEEN hi + 1 AND hi + 2), []) AS after FROM g""",
    "subtitle_sample": r"""WITH w AS (SELECT doc_id AS video_id, regexp_split_to_array(text, '[ \n]+') AS t FROM documents), u AS (SELECT video_id, unnest(t) AS text, unnest(range(0, len(t))) AS n FROM w), s AS (SELECT * FROM u),
      r AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY n) AS r, count(*) OVER (PARTITION BY video_id) AS c FROM s)
      SELECT video_id, CAST(n AS INTEGER) AS id, round(n * 0.3::DOUBLE, 2) AS start, substr(text, 1, 300) AS text FROM r WHERE c <= 30 OR r <= 12 OR r > c - 10 OR (r > c // 2 - 4 AND r <= c // 2 + 4)""",
    "interval_union": f"WITH {INTERVALS}, {UNION_SQL.format(name='u', source='spans')} SELECT video_id, count(*) AS n, round(sum(\"end\" - start), 3) AS seconds FROM u GROUP BY video_id",
    "interval_intersection": f"""WITH {INTERVALS}, {MERGED} SELECT a.video_id, round(sum(least(a."end", b."end") - greatest(a.start, b.start)), 3) AS seconds FROM va a JOIN vb b ON a.video_id = b.video_id AND least(a."end", b."end") > greatest(a.start, b.start) GROUP BY 1""",
    "longest_gap": f"""WITH {INTERVALS}, {MERGED},
      parts AS (SELECT a.video_id, a.start AS s, a."end" AS e, greatest(a.start, b.start) AS x, least(a."end", b."end") AS y FROM va a JOIN vb b ON a.video_id = b.video_id AND least(a."end", b."end") > greatest(a.start, b.start)),
      edges AS (SELECT * FROM parts UNION ALL SELECT video_id, start, "end", "end", "end" FROM va),
      gaps AS (SELECT video_id, greatest(x - coalesce(max(y) OVER (PARTITION BY video_id, s ORDER BY x, y ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), s), 0.0) AS gap FROM edges)
      SELECT video_id, round(max(gap), 3) AS seconds FROM gaps GROUP BY video_id""",
    "overlap_join": f"WITH {TRACKS}, {OVER} SELECT * FROM pairs",
    "best_overlap": f"""WITH {TRACKS}, pieces AS (SELECT video_id, cue_id AS piece_id, start * 3 AS start, "end" * 3 AS "end" FROM right_track),
      every AS (SELECT p.video_id, piece_id, l.cue_id, greatest(0.0, least(p."end", l."end") - greatest(p.start, l.start)) AS o, abs((p.start + p."end") / 2 - (l.start + l."end") / 2) AS off FROM pieces p JOIN left_track l USING (video_id)),
      ranked AS (SELECT *, max(o) OVER (PARTITION BY video_id, piece_id) AS best FROM every)
      SELECT video_id, piece_id, CASE WHEN max(best) > 0 THEN arg_max(cue_id, (o, -cue_id)) ELSE arg_min(cue_id, (off, cue_id)) END AS cue_id FROM ranked GROUP BY 1, 2""",
    "id_join": f"WITH {CUES} SELECT video_id, CAST(cue_id AS VARCHAR) AS identifier, CAST(length(text) AS INTEGER) AS n, CASE WHEN cue_id % 3 <> 0 THEN CAST(length(text) + 1 AS INTEGER) END AS m FROM cues",
    "times_pairs": f"""WITH {CUES}, {ROUGH}, n AS (SELECT *, cue_id % 2 AS side, row_number() OVER (PARTITION BY video_id, cue_id % 2, start, "end" ORDER BY cue_id) AS n FROM rough)
      SELECT a.video_id, a.cue_id, a.start, a."end", CAST(length(b.text) AS INTEGER) AS m FROM n a JOIN n b ON a.video_id = b.video_id AND a.start = b.start AND a."end" = b."end" AND a.n = b.n AND a.side = 0 AND b.side = 1""",
    "clipped_pairs": f"""WITH {TRACKS}, {LENGTHS}, p AS (SELECT l.video_id, l.cue_id, l.start AS a, l."end" AS b, r.start AS c, r."end" AS d, m * 0.75 AS z FROM left_track l JOIN right_track r ON l.video_id = r.video_id AND r.cue_id - 1 = l.cue_id JOIN lengths n ON n.video_id = l.video_id)
      SELECT video_id, cue_id, round(greatest(a, c), 6) AS start, round(least(b, d, z), 6) AS "end" FROM p WHERE a < z AND c < z AND least(b, d, z) - greatest(a, c) > 0.05""",
    "pair_validation": f"""WITH {TRANSLATIONS}, b AS (SELECT coalesce(s.video_id, t.video_id) AS video_id, CAST(coalesce(s.id, t.id) AS VARCHAR) AS id, s.id IS NOT NULL AS en, t.id IS NOT NULL AS zh, s.start AS ss, t.start AS ts, s."end" AS se, t."end" AS te, t.translation FROM src s FULL JOIN tr t ON s.video_id = t.video_id AND s.id = t.id),
      z AS (SELECT video_id, id, start, "end", coalesce(lag(start) OVER w, -1.0) AS ps, coalesce(lag("end") OVER w, -1.0) AS pe FROM tr WINDOW w AS (PARTITION BY video_id ORDER BY id)),
      bad AS (SELECT video_id, count(*) FILTER (start < 0 OR "end" <= start OR start < ps OR "end" < pe) AS n FROM z GROUP BY 1), bad_en AS (SELECT video_id, count(*) FILTER ("end" <= start) AS n FROM src GROUP BY 1),
      g AS (SELECT video_id, coalesce(list(id ORDER BY id) FILTER (en AND NOT zh), []) AS missing_chinese_ids, coalesce(list(id ORDER BY id) FILTER (zh AND NOT en), []) AS extra_chinese_ids,
        coalesce(list(id ORDER BY id) FILTER (en AND zh AND (round(abs(ss - ts), 9) > 0.02 OR round(abs(se - te), 9) > 0.02)), []) AS timestamp_mismatch_ids, coalesce(list(id ORDER BY id) FILTER (zh AND trim(translation) = ''), []) AS empty_chinese_ids,
        count(*) FILTER (en) AS english_segment_count, count(*) FILTER (zh) AS chinese_segment_count FROM b GROUP BY video_id)
      SELECT g.*, CASE WHEN len(timestamp_mismatch_ids) > 0 THEN 'SUBTITLE_TIMELINE_MISMATCH' WHEN len(missing_chinese_ids) > 0 OR len(extra_chinese_ids) > 0 OR english_segment_count <> chinese_segment_count THEN 'SUBTITLE_ID_MISMATCH'
        WHEN len(empty_chinese_ids) > 0 OR coalesce(bad.n, 0) > 0 OR coalesce(bad_en.n, 0) > 0 OR EXISTS (SELECT 1 FROM src WHERE src.video_id = g.video_id AND trim(text) = '') THEN 'SUBTITLE_VALIDATION_FAILED' ELSE 'PASSED' END AS validation_status
      FROM g LEFT JOIN bad USING (video_id) LEFT JOIN bad_en USING (video_id)""",
    "review_import": f"""WITH {TRANSLATIONS}, b AS (SELECT coalesce(s.video_id, t.video_id) AS video_id, coalesce(s.id, t.id) AS id, s.id IS NOT NULL AS here, t.id IS NOT NULL AS there, abs(s.start - t.start) > 0.001 OR abs(s."end" - t."end") > 0.001 AS moved, t.translation FROM src s FULL JOIN tr t ON s.video_id = t.video_id AND s.id = t.id)
      SELECT video_id, id, 'EXTRA_ID' AS code FROM b WHERE NOT here UNION ALL SELECT video_id, id, 'MISSING_IDS' FROM b WHERE NOT there UNION ALL SELECT video_id, id, 'TIMELINE_CHANGED' FROM b WHERE here AND there AND moved
      UNION ALL SELECT video_id, id, 'EMPTY_REVIEWED_TRANSLATION' FROM b WHERE here AND there AND trim(coalesce(translation, '')) = ''""",
    "missing_and_extra": f"""WITH {TRANSLATIONS} SELECT video_id, id, 'missing' AS side FROM (SELECT video_id, id FROM src EXCEPT SELECT video_id, id FROM tr) UNION ALL SELECT video_id, id, 'extra' FROM (SELECT video_id, id FROM tr EXCEPT SELECT video_id, id FROM src)""",
    "pending_rows": f"WITH {TRANSLATIONS} SELECT video_id, id FROM src ANTI JOIN tr USING (video_id, id)",
    "low_confidence": f"""WITH {TRACKS} SELECT video_id, cue_id FROM right_track r WHERE EXISTS (SELECT 1 FROM cues c WHERE c.video_id = r.video_id AND (c.cue_id % 4) / 4 < 0.5 AND least(r."end", round(c.start + 0.4, 3)) > greatest(r.start, c.start))""",
    "repeated_runs": f"""WITH {ROLLING}, w AS (SELECT *, {WORDS.format(COMP.format("text"))} AS words FROM rolling), q AS (SELECT *, lag(words) OVER w AS p FROM w {W1})
      SELECT video_id, count(*) FILTER (len(list_filter(range(3, least(len(p), len(words), 8) + 1), lambda k: p[len(p) - k + 1:len(p)] = words[1:k])) > 0) AS continuous_repeated_phrases FROM q GROUP BY video_id""",
    "source_quality": f"""WITH {PAIRS}, f AS (SELECT *, coalesce(now <> '' AND prev <> '' AND now <> prev AND (starts_with(now, prev) OR ends_with(prev, now)), FALSE) AS rolls FROM adj),
      g AS (SELECT video_id, count(*) AS n, count(*) FILTER (trim(text) = '') AS e, count(*) FILTER ("end" - start <= 0.05) AS s, count(*) FILTER (now <> '' AND now = prev) AS x, count(*) FILTER (rolls) AS r, count(*) FILTER (overlap) AS o FROM f GROUP BY video_id)
      SELECT video_id, n AS cue_count, round(e / n, 6) AS empty_ratio, round(s / n, 6) AS very_short_ratio, round(x / n, 6) AS exact_duplicate_ratio, round(r / n, 6) AS rolling_duplicate_ratio, o AS overlap_count,
        round(greatest(0.0, 100 - (e / n * 20 + s / n * 15 + x / n * 20 + r / n * 25 + o / n * 20)), 2) AS quality_score, 'DIRECT_CLEANING' AS route FROM g""",
    "speech_intervals": f"WITH {ASR} SELECT video_id, start, \"end\" FROM raw WHERE \"end\" > start AND no_speech_prob <= 0.6",
    "translation_qc": f"""WITH {TRANSLATIONS}, t AS (SELECT *, lag(trim(translation)) OVER w AS pt, lag("end") OVER w AS pe FROM tr WINDOW w AS (PARTITION BY video_id ORDER BY id)),
      b AS (SELECT coalesce(s.video_id, t.video_id) AS video_id, coalesce(s.id, t.id) AS id, s.id IS NOT NULL AS en, t.id IS NOT NULL AS zh, abs(s.start - t.start) > 0.001 OR abs(s."end" - t."end") > 0.001 AS moved, trim(t.translation) AS x, pt, t.start < pe AS over, t.translation FROM src s FULL JOIN t ON s.video_id = t.video_id AND s.id = t.id),
      g AS (SELECT video_id, count(*) FILTER (en) AS english_ids, count(*) FILTER (zh) AS chinese_ids, coalesce(list(id ORDER BY id) FILTER (en AND NOT zh), []) AS missing_ids, coalesce(list(id ORDER BY id) FILTER (zh AND NOT en), []) AS extra_ids,
        coalesce(list(id ORDER BY id) FILTER (zh AND x = ''), []) AS empty_translation_ids, coalesce(list(id ORDER BY id) FILTER (x <> '' AND x = pt), []) AS adjacent_duplicate_ids, count(*) FILTER (over) AS timeline_overlaps, count(*) FILTER (en AND zh AND moved) AS timeline_changed,
        coalesce(list(id ORDER BY id) FILTER (regexp_matches(translation, '[\\x00-\\x08\\x0b\\x0c\\x0e-\\x1f\\x7f]')), []) AS illegal_control_character_ids, coalesce(list(id ORDER BY id) FILTER (regexp_matches(translation, '，，|。。|！！|？？')), []) AS unnatural_punctuation_ids FROM b GROUP BY video_id)
      SELECT *, CASE WHEN len(missing_ids) + len(extra_ids) + len(empty_translation_ids) + len(illegal_control_character_ids) + timeline_overlaps + timeline_changed = 0 THEN 'QC_PASSED' ELSE 'REVIEW_REQUIRED' END AS status FROM g""",
    "best_chinese": """WITH t AS (SELECT o_orderkey % 300 AS video_id, 'zh.' || (o_orderkey % 4) AS track, o_orderkey % 4 AS o, o_orderstatus <> 'P' AS ok, o_orderstatus = 'O' AS passed, round(o_totalprice / 1000, 2) AS score FROM orders),
      g AS (SELECT video_id, arg_max(track, (score, -o)) FILTER (ok AND passed) AS track, max(score) FILTER (ok AND passed) AS score, bool_or(ok) AS a FROM t GROUP BY 1)
      SELECT video_id, track, score, CASE WHEN track IS NOT NULL THEN NULL WHEN a THEN 'NO_VALID_CHINESE_SUBTITLE' ELSE 'CHINESE_SUBTITLE_NOT_FOUND' END AS error FROM g""",
    "resolved_inputs": """WITH o AS (SELECT o_orderkey AS video_id, o_orderkey % 8 AS k FROM orders), f AS (SELECT video_id, k <> 0 AS english_exists, k % 3 = 1 AS reviewed_exists, CASE WHEN k % 4 = 2 THEN 'zh.clean.srt' END AS best_track, k = 3 AS recovered FROM o)
      SELECT *, CASE WHEN english_exists AND reviewed_exists THEN 'reviewed' WHEN english_exists AND best_track IS NOT NULL THEN 'candidate' WHEN recovered THEN 'recovered' WHEN NOT english_exists THEN 'ENGLISH_SUBTITLE_NOT_FOUND' ELSE 'CHINESE_SUBTITLE_NOT_FOUND' END AS resolution FROM f""",
    "srt_round_trip": f"""WITH {CUES} SELECT video_id, CAST(row_number() OVER w AS INTEGER) AS cue_id, start, "end", regexp_replace(text, '\\s+', '', 'g') AS signs FROM cues {W1}""",
    "vtt_round_trip": f"""WITH {CUES} SELECT video_id, CAST(row_number() OVER w AS INTEGER) AS cue_id, start, "end", regexp_replace(text, '\\s+', '', 'g') AS signs FROM cues {W1}""",
    "text_helpers": f"""SELECT doc_id, CAST(len({WORDS.format("text")}) AS INTEGER) AS words, CAST(length(regexp_replace(text, '[^\\x{{3400}}-\\x{{9fff}}]', '', 'g')) AS INTEGER) AS cjk,
      round(length(regexp_replace(text, '[^\\s]', '', 'g')) * 0.32 + length(regexp_replace(text, '[^A-Za-z0-9]', '', 'g')) * 0.56 + (length(text) - length(regexp_replace(text, '[^\\s]', '', 'g')) - length(regexp_replace(text, '[^A-Za-z0-9]', '', 'g'))) * 0.52, 2)::DOUBLE AS width,
      CAST(length(text) AS INTEGER) AS units, CAST(strlen(text) AS INTEGER) AS bytes FROM documents""",
    "fix_timeline": f"""WITH {ROLLING}, k AS (SELECT *, greatest(0.05, "end" - start) AS long, CAST(greatest(ceil(greatest(0.05, "end" - start) / 7.0), 1) AS INTEGER) AS k, {WORDS.format("text")} AS words FROM rolling),
      i AS (SELECT *, unnest(range(0, k)) AS i FROM k),
      t AS (SELECT *, k = 1 OR (len(words) >= k AND CAST(round_even((i + 1) * len(words) / k, 0) AS INTEGER) > CAST(round_even(i * len(words) / k, 0) AS INTEGER))
        OR (len(words) < k AND trim(substr(text, CAST(round_even(i * length(text) / k, 0) AS INTEGER) + 1, CAST(round_even((i + 1) * length(text) / k, 0) - round_even(i * length(text) / k, 0) AS INTEGER))) <> '') AS kept FROM i),
      s AS (SELECT video_id, row_number() OVER (PARTITION BY video_id ORDER BY start, "end", cue_id, i) AS n, greatest(CASE WHEN k = 1 THEN start ELSE start + long * i / k END, 0.0) AS a, CASE WHEN k = 1 THEN "end" ELSE start + long * (i + 1) / k END AS b FROM t WHERE kept),
      p AS (SELECT *, max(greatest(b, a + 0.05) - n * 0.05::DOUBLE) OVER (PARTITION BY video_id ORDER BY n) + n * 0.05::DOUBLE AS e FROM s),
      q AS (SELECT *, greatest(a, coalesce(lag(e) OVER (PARTITION BY video_id ORDER BY n), 0.0)) AS c FROM p),
      r AS (SELECT *, coalesce(lead(c) OVER (PARTITION BY video_id ORDER BY n), c + 1.0) AS nxt FROM q)
      SELECT video_id, CAST(n AS INTEGER) AS cue_id, round(c + 1e-7::DOUBLE, 3) AS start, round(1e-7::DOUBLE + CASE WHEN e - c >= 1.0 THEN e ELSE greatest(e, least(c + 1.0, nxt)) END, 3) AS "end" FROM r""",
    "accepted_reviews": f"""WITH {TRANSLATIONS}, b AS (SELECT coalesce(s.video_id, t.video_id) AS video_id FROM src s FULL JOIN tr t ON s.video_id = t.video_id AND s.id = t.id
      WHERE s.id IS NULL OR t.id IS NULL OR abs(s.start - t.start) > 0.001 OR abs(s."end" - t."end") > 0.001 OR trim(coalesce(t.translation, '')) = '') SELECT video_id, id FROM tr WHERE video_id NOT IN (SELECT video_id FROM b)""",
    "strict_srt": "SELECT conv_id AS video_id, count(*) AS blocks, 0::INTEGER AS malformed_blocks, 0::INTEGER AS duplicate_ids, 0::INTEGER AS illegal_control_ids FROM conversations GROUP BY 1",
    "asr_words": rf"""WITH {CUES}, w AS (SELECT video_id, cue_id, start, greatest("end" - start, 0.01) AS long, {WORDS.format(ONE_LINE)} AS t FROM cues), u AS (SELECT *, unnest(range(0, len(t))) AS n FROM w)
      SELECT video_id, cue_id, CAST(n AS INTEGER) AS n, round(start + long * n / len(t) + 1e-7::DOUBLE, 3) AS start, round(start + long * (n + 1) / len(t) + 1e-7::DOUBLE, 3) AS "end" FROM u""",
    "reading_metrics": rf"""WITH {ROLLING}, c AS (SELECT *, length(regexp_replace(text, '[^\x{{3400}}-\x{{9fff}}]', '', 'g')) AS cjk, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS latin,
        len(list_filter(string_split(text, chr(10)), lambda x: length(regexp_replace(x, '\s+', '', 'g')) > 26)) AS long, coalesce(trim(text) <> '' AND trim(text) = trim(lag(text) OVER w), FALSE) AS dup, len(regexp_extract_all(text, '，，+|。。+|！！+|？？+')) AS rep FROM rolling {W1}),
      g AS (SELECT video_id, count(*) AS n, CAST(sum(cjk) AS BIGINT) AS cjk, CAST(sum(latin) AS BIGINT) AS latin, CAST(sum(long) AS BIGINT) AS long, count(*) FILTER ("end" > start AND cjk / ("end" - start) > 12) AS fast, count(*) FILTER (dup) AS dup, CAST(sum(rep) AS BIGINT) AS rep FROM c GROUP BY video_id),
      m AS (SELECT *, round(cjk / greatest(cjk + latin, 1), 6) AS cr, round(latin / greatest(cjk + latin, 1), 6) AS er FROM g)
      SELECT video_id, 'zh.clean.srt' AS track, n AS segment_count, cjk AS cjk_character_count, latin AS ascii_letter_count, long AS overlong_line_count, fast AS fast_reading_cue_count, dup AS adjacent_duplicate_count, rep AS repeated_punctuation_count, cr AS cjk_ratio, er AS english_leakage_ratio,
        round(greatest(0.0, least(120.0, 106.0::DOUBLE - er * 30.0 - least(20.0, long / n * 40.0) - least(20.0, fast / n * 35.0) - least(10.0, dup * 2.5::DOUBLE) - least(10.0, rep * 1.5::DOUBLE))), 3) AS score FROM m""",
    "translation_flags": f"""WITH {TRANSLATED}, a AS (SELECT *, {spoken_sql("translation")} AS speech_seconds FROM translated),
      b AS (SELECT *, round(speech_seconds / greatest(0.05::DOUBLE, seconds), 3) AS ratio FROM a)
      SELECT video_id, cue_id, speech_seconds, ratio, array_to_string({flags_sql("text", "translation", "ratio")}, '|') AS flags FROM b""",
    "flag_histogram": f"""WITH {TRANSLATED}, a AS (SELECT *, {spoken_sql("translation")} AS spoken FROM translated),
      b AS (SELECT *, round(spoken / greatest(0.05::DOUBLE, seconds), 3) AS ratio FROM a), f AS (SELECT video_id, unnest({flags_sql("text", "translation", "ratio")}) AS flag FROM b)
      SELECT video_id, flag, count(*) AS n FROM f GROUP BY ALL""",
}

#: All events as one track.
ORACLE_SQL |= {f"long_track_{k}": ORACLE_SQL[name].replace("user_id AS video_id", "0::BIGINT AS video_id") for k, name in (("union", "interval_union"), ("gap", "longest_gap"))}

#: The ordered folds over words, row by row: the state of a track is its open segment or fragment.
ORACLE_SQL |= {
    "word_sentences": f"""WITH RECURSIVE {SPOKEN},
      fold AS (
        SELECT video_id, i, 1 AS cue_id, start AS since, length(text) AS signs, text, start, "end", regexp_matches(text, '[.!?]$') AS over FROM words WHERE i = 0
        UNION ALL SELECT video_id, i, cue_id + new::INTEGER, CASE WHEN new THEN start ELSE since END, CASE WHEN new THEN length(text) ELSE signs + 1 + length(text) END, text, start, "end",
          regexp_matches(text, '[.!?]$') OR (NOT new AND regexp_matches(text, '[,;:]$') AND "end" - since >= 7.0::DOUBLE * 0.72::DOUBLE)
        FROM (SELECT f.video_id, w.i, f.cue_id, f.since, f.signs, w.text, w.start, w."end", f.over OR w.start - f."end" > 0.6::DOUBLE OR w."end" - f.since > 7.0 OR f.signs + 1 + length(w.text) > 84 AS new FROM fold f JOIN words w ON w.video_id = f.video_id AND w.i = f.i + 1)
      ) SELECT video_id, cue_id, min(start) AS start, max("end") AS "end", string_agg(text, ' ' ORDER BY i) AS text FROM fold GROUP BY video_id, cue_id""",
    "word_fragments": f"""WITH {SPOKEN}, seen AS (SELECT *, lag(lower(text)) OVER (PARTITION BY video_id ORDER BY i) AS before FROM words),
      told AS (SELECT *, sum(CASE WHEN before = lower(text) THEN 0 ELSE 1 END) OVER (PARTITION BY video_id ORDER BY i) AS cue_id FROM seen)
      SELECT video_id, cue_id::INTEGER AS cue_id, min(start) AS start, max("end") AS "end", first(text ORDER BY i) AS text FROM told GROUP BY video_id, cue_id""",
    "merged_words": f"""WITH RECURSIVE {SPOKEN},
      fold AS (
        SELECT video_id, i, 1 AS cue_id, start AS since, "end" AS until, text AS so_far, lower(rtrim(text, '.,;!')) AS last FROM words WHERE i = 0
        UNION ALL SELECT video_id, i, cue_id + (NOT joins)::INTEGER, CASE WHEN joins THEN since ELSE start END, CASE WHEN joins THEN greatest(until, "end") ELSE "end" END,
          CASE WHEN NOT joins THEN text WHEN key = last THEN so_far ELSE so_far || ' ' || text END, key
        FROM (SELECT f.*, w.text, w.start, w."end", w.i AS j, lower(rtrim(w.text, '.,;!')) AS key,
          w.start - f.until <= 0.45::DOUBLE AND greatest(f.until, w."end") - f.since <= 7.0 AND (NOT regexp_matches(f.so_far, '[.!?]$') OR f.until - f.since < 1.0 OR regexp_matches(w.text, '^[a-z]')) AS joins
          FROM fold f JOIN words w ON w.video_id = f.video_id AND w.i = f.i + 1) AS n(video_id, i_, cue_id, since, until, so_far, last, text, start, "end", i, key, joins)
      ), ends AS (SELECT *, row_number() OVER (PARTITION BY video_id, cue_id ORDER BY i DESC) AS back FROM fold)
      SELECT video_id, cue_id, since AS start, until AS "end", so_far AS text FROM ends WHERE back = 1""",
}

ORACLE_SQL["incremental_run"] = f"""WITH {CUES} SELECT video_id, CASE WHEN bool_or(video_id % 5 = 0 AND cue_id = 0) THEN 'computed' ELSE 'reused' END AS action, count(*) AS cues,
  sum(length(text) + (video_id % 5 = 0 AND cue_id = 0)::INTEGER)::BIGINT AS signs FROM cues GROUP BY video_id"""

ORACLE_SQL["broken_srt"] = f"""WITH {CUES}, c AS (SELECT video_id, cue_id, (cue_id + video_id) % 8 AS k FROM cues), n AS (SELECT video_id, count(*) AS blocks, count(*) FILTER (k IN (1, 2)) AS invalid_ids, count(*) FILTER (k = 7 AND cue_id > 0) AS repeated_ids,
    count(*) FILTER (k IN (2, 3)) AS invalid_timing_lines, count(*) FILTER (k IN (2, 3, 4)) AS empty_blocks, count(*) FILTER (k = 5) AS long_lines, count(*) FILTER (k = 6) AS too_many_lines, count(*) FILTER (k IN (1, 3))::INTEGER AS malformed_blocks FROM c GROUP BY video_id)
  SELECT *, repeated_ids::INTEGER AS duplicate_ids, long_lines::INTEGER AS illegal_control_ids FROM n"""
