"""DuckDB SQL of the caption scores: measures of each track, deductions by dimension, and the choice between two sources."""

from __future__ import annotations

from cuefold.plans.caption_queries import COMP
from cuefold.plans.views import CUES, UNION_SQL

ORDER = "WINDOW w AS (PARTITION BY video_id, track ORDER BY cue_id)"
#: A track's number: the unions of intervals go by one key.
NUMBER = "video_id * 2 + CAST(track = 'user' AS INTEGER)"
TAG = r"</?(?:c(?:\.[^ >]+)?|v|lang|b|i|u|ruby|rt)[^>]*>|<\d{2}:\d{2}[^>]*>"
CLOSED = r"""[.?!…:;"''，。！？；：”)】\]]$"""
COUNTS = {
    "empty_text": "trim(text) = ''", "tags": f"regexp_matches(text, '{TAG}')", "controls": r"regexp_matches(text, '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]')",
    "invisibles": r"regexp_matches(text, '[\x{200b}-\x{200f}\x{202a}-\x{202e}\x{2060}\x{feff}]')", "invalid_text": "now = ''", "bad_times": 'start >= "end"', "reverse": "start < ps",
    "overlapped": "start < pe", "under": "d < 0.3", "over8": "d > 8.0", "bad_gaps": "start - pe > 0 AND start - pe < 0.02", "beyond": 'audio > 0 AND "end" > audio + 0.25',
    "adjacent": "now = prev AND now <> ''", "cumulative": "now <> '' AND prev <> '' AND contains(now, prev)", "fast": "d > 0 AND length(text) / d > 20.0", "too_long": "d > 7.0",
    "fragments": "d < 0.8 AND length(text) < 18", "unnatural": f"length(trim(text)) > 84 AND NOT regexp_matches(trim(text), '{CLOSED}')",
}
MEASURES = CUES + f""",
c AS (SELECT video_id, track, cue_id + 1 AS cue_id, start, "end", text FROM cues WHERE track IN ('user', 'assistant')),
tracks AS (SELECT DISTINCT video_id, track FROM c),
heard AS (SELECT video_id, start, "end" FROM cues WHERE cue_id % 3 <> 1),
talk AS (SELECT {NUMBER.replace("video_id", "t.video_id")} AS video_id, start, "end" FROM tracks t JOIN heard h ON t.video_id = h.video_id),
seen AS (SELECT {NUMBER} AS video_id, start, "end" FROM c),
{UNION_SQL.format(name="va", source="talk")}, {UNION_SQL.format(name="vb", source="seen")},
parts AS (SELECT a.video_id, a.start AS s, a."end" AS e, greatest(a.start, b.start) AS x, least(a."end", b."end") AS y FROM va a JOIN vb b ON a.video_id = b.video_id AND least(a."end", b."end") > greatest(a.start, b.start)),
edges AS (SELECT * FROM parts UNION ALL SELECT video_id, start, "end", "end", "end" FROM va),
gaps AS (SELECT video_id, greatest(x - coalesce(max(y) OVER (PARTITION BY video_id, s ORDER BY x, y ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), s), 0.0) AS gap FROM edges),
lengths AS (SELECT n AS number, (SELECT sum("end" - start) FROM va WHERE video_id = n) AS speech, (SELECT sum(y - x) FROM parts WHERE video_id = n) AS covered, (SELECT max(gap) FROM gaps WHERE video_id = n) AS gap,
  (SELECT sum("end" - start) FROM vb WHERE video_id = n) AS shown FROM (SELECT {NUMBER} AS n FROM tracks)),
audio AS (SELECT video_id, max("end") AS audio FROM cues GROUP BY video_id),
bounds AS (SELECT video_id, min(start) AS s0, last("end" ORDER BY start, "end") AS s1 FROM heard GROUP BY video_id),
touch AS (SELECT video_id, track, bool_or(start <= s0 + 1.0 AND "end" >= s0) AS c0, bool_or(start <= s1 AND "end" >= s1 - 1.0) AS c1 FROM c JOIN bounds USING (video_id) GROUP BY ALL),
p AS (SELECT c.*, audio, {COMP.format("text")} AS now, greatest("end" - start, 0.0) AS d FROM c JOIN audio USING (video_id)),
q AS (SELECT *, lag(now) OVER w AS prev, lag(start) OVER w AS ps, lag("end") OVER w AS pe FROM p {ORDER}),
per AS (SELECT video_id, track, count(*) AS segments, {", ".join(f"count(*) FILTER ({test}) AS {name}" for name, test in COUNTS.items())},
  arg_min(start, cue_id) AS first_start, arg_max("end", cue_id) AS last_end, any_value(audio) AS audio FROM q GROUP BY ALL),
joined AS (SELECT per.*, l.*, c0, c1, video_id % 7 AS k, track = 'user' AS yt, CAST(video_id % 7 AS DOUBLE) AS kd, speech IS NOT NULL AS has FROM per LEFT JOIN lengths l ON l.number = {NUMBER} LEFT JOIN touch USING (video_id, track)),
wide AS (SELECT *, CASE WHEN has THEN coalesce(covered, 0) / speech WHEN audio > 0 THEN least(coalesce(shown, 0), audio) / audio WHEN segments > 0 THEN 1.0 ELSE 0.0 END AS own,
  CASE WHEN has THEN coalesce(gap, 0.0) WHEN audio > 0 THEN greatest(0.0, audio - least(coalesce(shown, 0), audio)) ELSE 0.0 END AS uncovered,
  CASE WHEN has THEN coalesce(c0, FALSE) ELSE segments > 0 AND first_start <= 2.0 END AS first_ok, CASE WHEN has THEN coalesce(c1, FALSE) ELSE segments > 0 AND (audio <= 0 OR last_end >= audio - 5.0) END AS last_ok,
  greatest(empty_text, CAST(k = 3 AS INTEGER)) AS empty, bad_times + CAST(k = 2 AS INTEGER) AS invalid_times FROM joined)
"""


def _count(reason: str, value: str, by: float, most: float | None = None) -> tuple[str, str, str]:
    return reason, value, f"least({most}, {value} * {by})" if most else f"{value} * {by}"


def _if(test: str, value: str) -> str:
    return f"CASE WHEN {test} THEN {value} ELSE 0 END"


BASE_YT, BASE_ASR = "CASE WHEN k < 2 THEN 95.0 ELSE 78.0 END", "((0.5 + kd / 20) * 100)"
FAULTS = {
    "structure": [
        _count("EMPTY_SUBTITLE", "empty", 15), _count("TAG_RESIDUAL", "tags", 8), _count("CONTROL_CHARACTER", "controls", 10), _count("INVISIBLE_CHARACTER", "invisibles", 5),
        _count("DUPLICATE_ID", "CAST(k = 0 AS INTEGER)", 15), _count("INVALID_ID", "CAST(k = 1 AS INTEGER)", 10), _count("INVALID_TEXT", "invalid_text", 10),
    ],
    "timeline": [
        _count("INVALID_TIMESTAMP", "invalid_times", 25), _count("REVERSED_TIMELINE", "reverse", 15), _count("OVERLAP", "overlapped", 20), _count("UNDER_0_3_SECONDS", "under", 2, 20),
        _count("OVER_8_SECONDS", "over8", 8), _count("UNREASONABLE_GAP", "bad_gaps", 1, 10), _count("BEYOND_AUDIO_DURATION", "beyond", 10),
    ],
    "coverage": [
        ("UNCOVERED_SPEECH", "1 - own", "greatest(0.0, 1 - own) * 100"), ("FIRST_SPEECH_NOT_COVERED", _if("NOT first_ok", "1"), _if("NOT first_ok", "5")),
        ("LAST_SPEECH_NOT_COVERED", _if("NOT last_ok", "1"), _if("NOT last_ok", "5")), ("LONG_UNCOVERED_SPEECH_GAP", "uncovered", "least(15, uncovered / 2)"),
    ],
    "stability": [
        _count("ADJACENT_DUPLICATE", "adjacent", 15), _count("CUMULATIVE_TEXT_RESIDUAL", "cumulative", 8), _count("REPEATED_PHRASE", "k % 3", 5),
        ("TRANSITION_CUE_RESIDUAL", _if("yt", "k % 2"), _if("yt", "k % 2 * 2")), _count("HIGH_NO_SPEECH", "k % 4", 4),
    ],
    "readability": [
        _count("HIGH_CPS", "fast", 2, 30), _count("LONG_LINE", "CAST(k = 4 AS INTEGER)", 2, 20), _count("TOO_MANY_LINES", "CAST(k = 5 AS INTEGER)", 5), _count("LONG_DURATION", "too_long", 3),
        _count("SHORT_FRAGMENT", "fragments", 2, 20), _count("UNNATURAL_BREAK", "unnatural", 2, 15),
    ],
    "source_confidence": [
        ("SOURCE_BASE_CONFIDENCE", _if("yt", f"100 - {BASE_YT}"), _if("yt", f"100 - {BASE_YT}")), ("ROLLING_RESIDUAL", _if("yt", "cumulative"), _if("yt", "cumulative * 4")),
        ("MODEL_CONFIDENCE", _if("NOT yt", f"100 - {BASE_ASR}"), _if("NOT yt", f"greatest(0.0, 100 - {BASE_ASR})")), ("MISSING_WORD_TIMESTAMPS", _if("NOT yt", "kd / 70"), _if("NOT yt", "kd / 70 * 30")),
        ("LOW_VAD_COVERAGE", _if("NOT yt", "0.6 + kd / 20"), _if("NOT yt", "greatest(0.0, 0.9 - (0.6 + kd / 20)) * 50")), ("LOW_CONFIDENCE_WORDS", _if("NOT yt", "kd / 20"), _if("NOT yt", "kd / 20 * 20")),
        ("HIGH_NO_SPEECH_CONFIDENCE", _if("NOT yt", "k % 4"), _if("NOT yt", "k % 4 * 2")), ("LOW_AVERAGE_LOGPROB", _if("NOT yt", "-kd / 5"), _if("NOT yt", "least(15, greatest(0.0, kd / 5 - 0.5) * 15)")),
        ("AVERAGE_NO_SPEECH_PROBABILITY", _if("NOT yt", "kd / 10"), _if("NOT yt", "least(10, kd / 10 * 10)")), ("LOW_CROSS_SOURCE_AGREEMENT", "100 - (60.0 + kd * 4)", "greatest(0.0, 70 - (60.0 + kd * 4)) * 0.25"),
    ],
}
WEIGHTS = {"structure": 0.15, "timeline": 0.2, "coverage": 0.2, "stability": 0.15, "readability": 0.1, "source_confidence": 0.2}
ROWS = ", ".join(
    f"{{'dimension': '{dimension}', 'reason': '{reason}', 'raw_value': round(CAST({raw} AS DOUBLE), 6), 'points': round(CAST({points} AS DOUBLE), 3)}}" for dimension, items in FAULTS.items() for reason, raw, points in items
)
DEDUCTIONS = MEASURES + f", stacked AS (SELECT video_id, track, unnest([{ROWS}]) AS f FROM wide), faults AS (SELECT video_id, track, f.dimension AS dimension, f.reason AS reason, f.raw_value AS raw_value, f.points AS points FROM stacked)"
WHY = (
    "list_filter([CASE WHEN segments = 0 THEN 'SEGMENT_COUNT_ZERO' END, CASE WHEN invalid_times > 0 THEN 'INVALID_TIMESTAMPS' END, CASE WHEN overlapped > 0 THEN 'OVERLAPS_REMAIN' END,"
    " CASE WHEN empty > 0 THEN 'EMPTY_SUBTITLES_REMAIN' END, CASE WHEN own < 0.65 THEN 'SPEECH_COVERAGE_BELOW_MINIMUM' END], lambda x: x IS NOT NULL)"
)
SCORES = DEDUCTIONS + f""",
dims AS (SELECT video_id, track, {", ".join(f"round(greatest(0.0, 100.0 - sum(points) FILTER (dimension = '{k}')), 3) AS {k}" for k in WEIGHTS)} FROM faults GROUP BY ALL),
told AS (SELECT video_id, track, CASE WHEN yt THEN 'youtube' ELSE 'whisper' END AS source, CASE WHEN k < 2 THEN 'manual' ELSE 'auto' END AS source_type, {WHY} AS hard_fail_reasons, has, round(uncovered, 3) AS max_uncovered FROM wide),
scores AS (SELECT dims.*, round({" + ".join(f"round({k} * {w}::DOUBLE, 3)" for k, w in WEIGHTS.items())}, 3) AS final_score, source, source_type, len(hard_fail_reasons) > 0 AS hard_fail, hard_fail_reasons,
  list_concat(CASE WHEN has THEN [] ELSE ['SPEECH_INTERVALS_UNAVAILABLE'] END, hard_fail_reasons) AS flags, max_uncovered FROM dims JOIN told USING (video_id, track))
"""


def _higher(column: str, sign: str = ">") -> str:
    return f"CASE WHEN y.{column} {sign} w.{column} THEN 'youtube' ELSE 'whisper' END"


def _picked(source: str, reason: str, warning: str = "") -> str:
    source = source if source.startswith("CASE") else f"'{source}'"
    return f"{{'s': {source}, 'r': '{reason}', 'w': '{warning}'}}"


SAFE_Y, SAFE_W = "coalesce(NOT y.hard_fail, FALSE)", "coalesce(NOT w.hard_fail, FALSE)"
USE_Y, USE_W = f"coalesce({SAFE_Y} AND y.final_score >= 70, FALSE)", f"coalesce({SAFE_W} AND w.final_score >= 70, FALSE)"
BETTER = f"CASE WHEN {SAFE_Y} AND NOT {SAFE_W} THEN 'youtube' WHEN {SAFE_W} AND NOT {SAFE_Y} THEN 'whisper' WHEN y.final_score > w.final_score THEN 'youtube' ELSE 'whisper' END"
LADDER = f""",
ids AS (SELECT DISTINCT video_id FROM scores),
two AS (SELECT ids.video_id, round(abs(y.final_score - w.final_score), 3) AS score_difference, CASE
  WHEN {USE_Y} AND NOT {USE_W} THEN {_picked("youtube", "only_usable")} WHEN {USE_W} AND NOT {USE_Y} THEN {_picked("whisper", "only_usable")}
  WHEN {USE_Y} AND {USE_W} AND abs(y.final_score - w.final_score) >= 6 THEN {_picked(_higher("final_score"), "score_margin")}
  WHEN {USE_Y} AND {USE_W} AND y.source_type = 'manual' THEN {_picked("youtube", "tiebreak_manual", "AUTO_TIEBREAK_MANUAL_YOUTUBE")}
  WHEN {USE_Y} AND {USE_W} AND abs(y.coverage - w.coverage) >= 3 THEN {_picked(_higher("coverage"), "tiebreak_coverage", "AUTO_TIEBREAK_COVERAGE")}
  WHEN {USE_Y} AND {USE_W} AND abs(y.max_uncovered - w.max_uncovered) >= 3 THEN {_picked(_higher("max_uncovered", "<"), "tiebreak_uncovered_gap", "AUTO_TIEBREAK_UNCOVERED_GAP")}
  WHEN {USE_Y} AND {USE_W} AND abs(y.timeline - w.timeline) > 1e-9 THEN {_picked(_higher("timeline"), "tiebreak_timeline", "AUTO_TIEBREAK_TIMELINE")}
  WHEN {USE_Y} AND {USE_W} AND abs(y.readability - w.readability) > 1e-9 THEN {_picked(_higher("readability"), "tiebreak_readability", "AUTO_TIEBREAK_READABILITY")}
  WHEN {USE_Y} AND {USE_W} AND abs(y.final_score - w.final_score) > 1e-9 THEN {_picked(_higher("final_score"), "tiebreak_final_score", "AUTO_TIEBREAK_FINAL_SCORE")}
  WHEN {USE_Y} AND {USE_W} THEN {_picked("whisper", "tiebreak_exact", "AUTO_TIEBREAK_EXACT_TIE")}
  WHEN {SAFE_Y} OR {SAFE_W} THEN {_picked(BETTER, "below_minimum", "AUTO_SELECTED_BELOW_MINIMUM")}
  ELSE {_picked("", "no_safe_source", "NO_HARD_SAFE_SUBTITLE_SOURCE")} END AS p
  FROM ids LEFT JOIN scores y ON y.video_id = ids.video_id AND y.source = 'youtube' LEFT JOIN scores w ON w.video_id = ids.video_id AND w.source = 'whisper')
"""
DECISION = SCORES + LADDER
#: Score rows of two sources for each order, so that every rule of the choice decides somewhere.
ORDER_SCORES = """
base AS (SELECT o_orderkey AS k, o_custkey AS c FROM orders),
scores AS (
  SELECT k AS video_id, 'youtube' AS source, 62.0::DOUBLE + k % 37 AS final_score, c % 11 = 0 AS hard_fail, CASE WHEN k % 5 = 0 THEN 'manual' ELSE 'auto' END AS source_type,
    90.0::DOUBLE AS coverage, 80.0::DOUBLE AS timeline, 70.0::DOUBLE AS readability, 1.0::DOUBLE AS max_uncovered, ['LOW'] AS flags FROM base WHERE c % 19 <> 0
  UNION ALL SELECT k, 'whisper', 62.0::DOUBLE + (k + [0, 0, 0, 1, 3, 9, 20][c % 7 + 1]) % 37, c % 13 = 0, 'asr', 90.0::DOUBLE + k // 2 % 3 * 2, 80.0::DOUBLE + k // 4 % 2, 70.0::DOUBLE + c // 7 % 2, 1.0::DOUBLE + c // 2 % 3 * 2,
    CASE WHEN k % 3 = 0 THEN ['LOW', 'USER_OVERRIDE_HARD_FAIL'] ELSE [] END FROM base WHERE c % 17 <> 0)"""


def _override(name: str, source: str) -> str:
    """The choice where the user has asked for a source."""
    given = f"(SELECT * FROM scores WHERE source = '{source}')"
    warn = "list_concat(flags, CASE WHEN hard_fail THEN ['USER_OVERRIDE_HARD_FAIL'] ELSE [] END, CASE WHEN final_score < 70 THEN ['USER_OVERRIDE_BELOW_MINIMUM'] ELSE [] END)"
    return f"""SELECT '{name}' AS mode, two.video_id, CASE WHEN g.final_score IS NULL THEN '' ELSE '{source}' END AS selected_source,
      CASE WHEN g.final_score IS NULL THEN 'requested_source_missing' ELSE 'user_override' END AS selection_reason,
      CASE WHEN g.final_score IS NULL THEN '' ELSE array_to_string(list_filter({warn}, lambda x, i: list_position({warn}, x) = i), '|') END AS warnings, g.final_score IS NULL AS selection_failed, score_difference
      FROM two LEFT JOIN {given} g ON g.video_id = two.video_id"""


ORACLE_SQL = {
    "source_ladder": f"""WITH {ORDER_SCORES}{LADDER} SELECT 'auto' AS mode, video_id, p.s AS selected_source, p.r AS selection_reason, p.w AS warnings, p.s = '' AS selection_failed, score_difference FROM two
      UNION ALL {_override("manual", "youtube")} UNION ALL {_override("whisper", "whisper")}""",
    "score_deductions": f"WITH {DEDUCTIONS} SELECT * FROM faults",
    "caption_scores": f"WITH {SCORES} SELECT *, NOT hard_fail AS hard_safe, NOT hard_fail AND final_score >= 70 AS usable FROM scores",
    "source_decision": f"WITH {DECISION} SELECT video_id, p.s AS selected_source, p.r AS selection_reason, list_filter([p.w], lambda x: x <> '') AS warnings, p.s = '' AS selection_failed, score_difference FROM two",
}
