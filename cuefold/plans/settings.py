"""Settings of the candidate run. Lists of phrases, topics and quotas are the user's: `load` reads them from a JSON file."""

from __future__ import annotations

import json
from dataclasses import dataclass, field, fields
from pathlib import Path

# Fixed value: searches that a day allows.
DAILY_CALLS = 100


@dataclass(frozen=True)
class CandidateSettings:
    """Defaults are fixed values of the candidate rules; phrase lists are empty until a file or the caller gives them."""

    timezone: str = "America/New_York"
    candidate_limit: int = 50
    english_only: bool = True
    min_duration_seconds: int = 60
    max_duration_seconds: int = 2700
    min_age_hours_for_rate: float = 0.5
    popular_max_age_hours: float = 72
    popular_target: int = 2
    popular_max: int = 5
    max_per_channel: int = 2
    max_per_event: int = 2
    max_per_query_group: int = 6
    exclude_shorts: bool = True
    shorts_max_duration_seconds: int = 180
    search_daily_budget: int = 60
    search_reserve_calls: int = 20
    min_search_share: float = 0.8
    search_core_query_groups_per_day: int = 24
    search_modes: dict = field(default_factory=lambda: {"fresh": {}, "growth": {}})
    topic_quotas: dict = field(default_factory=dict)
    topic_max_counts: dict = field(default_factory=dict)
    core_queries: dict = field(default_factory=dict)
    topic_groups: dict = field(default_factory=dict)
    rotating_queries_per_topic: dict = field(default_factory=dict)
    priority_topic: str = "gaming"
    priority_games: list = field(default_factory=list)
    category_to_topic: dict = field(default_factory=dict)
    topic_keywords: dict = field(default_factory=dict)
    topic_interest_phrases: dict = field(default_factory=dict)
    topic_penalty_phrases: dict = field(default_factory=dict)
    interest_phrases: dict = field(default_factory=dict)
    interest_phrase_weights: dict = field(default_factory=lambda: {"strong": 6, "medium": 4, "normal": 2})
    topic_interest_bonus_per_hit: float = 1.5
    hard_exclude_phrases: list = field(default_factory=list)
    boring_penalty_phrases: list = field(default_factory=list)
    boring_penalty_per_hit: float = 5
    language_markers: list = field(default_factory=list)
    blacklist_channels: list = field(default_factory=list)
    topic_relevance_min: float = 10
    wildcard_interest_min: float = 12
    tutorial_topic: str = "tutorials"
    tutorial_preferred_duration_seconds: tuple = (240, 1200)
    tutorial_localization_bonus: float = 10
    topic_min_view_count: dict = field(default_factory=dict)
    topic_min_views_per_hour: dict = field(default_factory=dict)
    risky_categories: tuple = ("Music", "Film & Animation")
    risky_phrases: tuple = ("performance", "concert", "broadcast", "highlights")
    final_score_weights: dict = field(default_factory=lambda: {
        "growth_score": 0.25, "interest_score_normalized": 0.20, "topic_relevance_normalized": 0.18, "engagement_score": 0.12,
        "freshness_score": 0.08, "localization_suitability_score": 0.08, "caption_score": 0.05, "source_diversity_score": 0.04,
    })
    penalties: dict = field(default_factory=lambda: {
        "copyright_low": 0, "copyright_medium": 3, "copyright_high": 10, "copyright_very_high": 30, "language_medium": 2, "language_low": 10, "event_duplicate": 3,
    })
    event_similarity: dict = field(default_factory=lambda: {"jaccard_threshold": 0.65, "sequence_threshold": 0.78, "stop_words": []})


def load(path: str | Path) -> CandidateSettings:
    """Settings from a JSON file with the same names; names that the rules do not use are left out."""
    given = json.loads(Path(path).read_text(encoding="utf-8-sig"))
    names = {f.name for f in fields(CandidateSettings)}
    return CandidateSettings(**{k: v for k, v in given.items() if k in names})


def problems(s: CandidateSettings) -> list[str]:
    """What makes settings unusable, by name; none if they can be used. `DAILY_CALLS` is the limit of the search service."""
    planned = s.search_core_query_groups_per_day * len(s.search_modes)
    queries = sum(map(len, s.core_queries.values())) + sum(map(int, s.rotating_queries_per_topic.values()))
    rules = {
        "topic_quotas": s.candidate_limit >= 1 and sum(map(int, s.topic_quotas.values())) == s.candidate_limit,
        "topic_max_counts": all(int(s.topic_max_counts.get(t, -1)) >= int(n) for t, n in s.topic_quotas.items()),
        "final_score_weights": abs(sum(map(float, s.final_score_weights.values())) - 1.0) <= 0.0001,
        "max_per_channel": s.max_per_channel >= 1, "max_per_event": s.max_per_event >= 1, "max_per_query_group": s.max_per_query_group >= 1,
        "search_reserve_calls": s.search_daily_budget >= 1 and s.search_reserve_calls >= 0 and s.search_daily_budget + s.search_reserve_calls <= DAILY_CALLS,
        "search_daily_budget": planned < s.search_daily_budget, "search_core_query_groups_per_day": queries <= s.search_core_query_groups_per_day,
    }
    return [name for name, fine in rules.items() if not fine]
