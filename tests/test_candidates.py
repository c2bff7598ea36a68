import itertools
import random
import re
from collections import Counter
from dataclasses import replace
from difflib import SequenceMatcher

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cuefold.functions import text as T
from cuefold.operators import candidates, clustering, near_titles, selection, tasks
from cuefold.plans.candidate_queries import SETTINGS
from cuefold.plans.settings import CandidateSettings, problems
from cuefold.sources import manifests, sinks, videos
from cuefold.streaming import job_states, streams


def tokens(title):
    return sorted({w for w in "".join(c if c.isalnum() or c.isspace() else " " for c in title.lower()).split() if len(w) > 1 and w not in {"the", "new"}})


def alike(a, b, ratio):
    x, y = set(tokens(a)), set(tokens(b))
    return (len(x & y) / len(x | y) if x | y else 0.0) >= 0.65 or ratio is not None and SequenceMatcher(None, " ".join(sorted(x)), " ".join(sorted(y))).ratio() >= ratio or tokens(a) == tokens(b)


@pytest.mark.parametrize("ratio", [None, 0.78])
def test_leaders_are_the_greedy_ones(spark, ratio):
    rng = random.Random(9)
    words = ["minecraft", "garden", "update", "secret", "tomato", "harvest", "speedrun", "challenge", "hundred", "days", "the", "new"]
    rows = [(f"v{i:03d}", " ".join(rng.sample(words, rng.randrange(2, 6))) + rng.choice(["", "!", " s"]), float(rng.randrange(40))) for i in range(90)]
    leaders, want = [], {}
    for v, title, _ in sorted(rows, key=lambda r: (-r[2], r[0])):
        found = next((n for n, t in leaders if alike(title, t, ratio)), None)
        if found is None:
            found = f"event_{len(leaders) + 1:04d}"
            leaders.append((found, title))
        want[v] = found
    df = spark.createDataFrame(rows, "video_id string, title string, final_score double")
    got = {r["video_id"]: r["semantic_duplicate_group"] for r in clustering.leader_clusters(df, ["the", "new"], 0.65, ratio).collect()}
    assert got == want
    days = df.withColumn("day", F.lit(None).cast("string")).unionByName(df.withColumn("day", F.lit("d")))
    for limits in ({"rounds": 1, "stream": 1}, {"rounds": 20, "stream": 2}, {}):  # rounds, then one pass; rounds alone; one pass alone
        apart = clustering.leader_clusters(days, ["the", "new"], 0.65, ratio, ["day"], **limits).collect()
        for day in (None, "d"):
            assert {r["video_id"]: r["semantic_duplicate_group"] for r in apart if r["day"] == day} == want
        assert len(apart) == 2 * len(rows)


def test_titles_of_a_kind_meet_their_leader_alone(spark, monkeypatch):
    """Greedy groups where most titles are of a few kinds, found by many small tiles and a few nodes at a time; before, each two titles of a kind were an edge."""
    rng = random.Random(12)
    words = ["minecraft", "garden", "update", "secret", "tomato", "harvest", "speedrun", "challenge", "hundred", "days"]
    kinds = [" ".join(rng.sample(words, 5)) for _ in range(3)]
    title = lambda: f"{rng.choice(kinds)} {rng.choice('abcdefgh')}{rng.randrange(40)}" if rng.random() < 0.8 else " ".join(rng.sample(words, rng.randrange(1, 5)))
    rows = [(f"v{i:03d}", "b" if i < 40 else None, title(), float(rng.randrange(30))) for i in range(260)]
    want = {}
    for day in ("b", None):
        leaders = []
        for v, _, t, _ in sorted((r for r in rows if r[1] == day), key=lambda r: (-r[3], r[0])):
            found = next((n for n, other in leaders if alike(t, other, 0.78)), None)
            if found is None:
                found = f"event_{len(leaders) + 1:04d}"
                leaders.append((found, t))
            want[v] = found
    edges, real = [], clustering.staged

    def spied(df, name):
        out = real(df, name)
        if name == "edges":
            edges.append(out.count())
        return out

    monkeypatch.setattr(clustering, "staged", spied)
    df = spark.createDataFrame(rows, "video_id string, day string, title string, final_score double")
    got = {r["video_id"]: r["semantic_duplicate_group"] for r in clustering.leader_clusters(df, ["the", "new"], 0.65, 0.78, ["day"], tile=900, first=10).collect()}
    assert got == want
    assert sum(edges) < 1_000  # all alike pairs are thousands


def test_few_comparisons_find_the_first_leader(monkeypatch):
    """The first leader of many, compared with few; a title is the first side."""
    rng = random.Random(3)
    calls, real = [], near_titles.reaches
    monkeypatch.setattr(near_titles, "reaches", lambda *x: calls.append(x[:2]) or real(*x))
    leaders = [(k, f"harvest garden update number {rng.randrange(10**6)}") for k in rng.sample(range(500), 80)] + [(900, "z" * 70 + "q" * 60)]
    rows = [(1_000 + k, f"harvest garden update numbers {rng.randrange(10**6)}") for k in range(60)] + [(2_000, "another thing"), (2_001, "z" * 71 + "q" * 60)]
    first = lambda t: min((k for k, x in leaders if SequenceMatcher(None, t, x).ratio() >= 0.78), default=None)
    want = {k: first(t) for k, t in rows}
    assert near_titles.first_leaders(leaders, rows, 0.78) == {k: x for k, x in want.items() if x is not None}
    assert len(calls) < 10 * len(rows) and all(b in dict(leaders).values() for _, b in calls)
    keys = [(k, t) for k, t in leaders + rows]
    pairs = {(a, b) for a, x in keys for b, y in keys if a < b and SequenceMatcher(None, y, x).ratio() >= 0.78}
    assert set(near_titles.followed(keys, None, 0.78)) == pairs
    assert set(near_titles.followed(keys[::2], keys[1::2], 0.78)) == {(a, b) for a, b in pairs if (a in dict(keys[::2])) != (b in dict(keys[::2]))}


def test_penalty_by_place(spark):
    rows = [(f"v{i}", "one title told again", float(50 - i % 7)) for i in range(300)] + [("w", "quite another thing", 3.0), ("x", None, 2.0), ("y", "", 2.0)]
    got = clustering.leader_clusters(spark.createDataFrame(rows, "video_id string, title string, final_score double"), []).collect()
    first = sorted(rows[:300], key=lambda r: (-r[2], r[0]))
    want = {r[0]: round(max(0.0, r[2] - 3.0 * k), 3) for k, r in enumerate(first)} | {"w": 3.0, "x": 2.0, "y": 0.0}
    assert {r["video_id"]: r["final_score"] for r in got} == want


def test_ranks_within_groups(spark):
    rows = spark.range(5_000).selectExpr("id AS video_id", "if(id % 3 > 0, 'a', if(id % 7 = 0, null, 'b')) AS g", "cast(id * 7919 % 613 AS double) AS final_score").repartition(5)
    got = selection.by_score(rows, ["g"]).collect()
    assert len(got) == 5_000
    for g in ("a", "b", None):
        own = sorted((r for r in got if r["g"] == g), key=lambda r: (-r["final_score"], r["video_id"]))
        assert [r["rank"] for r in own] == list(range(1, len(own) + 1)) and own


def test_filters_do_not_copy_the_text_columns(spark):
    """A filter on scores reads them; before, 340 of the patterns on whole texts stood in the filter of wildcard_pool."""
    from cuefold.plans import candidate_queries

    df = candidate_queries.wildcard_pool(spark, "/root/testdata/sf0.001")
    filters = [x for x in df._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Filter" in x.split("(")[0]]
    assert filters and not any("regexp_replace(" in x for x in filters)


def test_declared_languages_are_not_detected(spark):
    """The detector gets the text of a video without a declared language alone; before, it read those of all."""
    from cuefold.plans import candidate_queries

    def detect(text):
        assert text in ("", "t1 d1"), text
        return "en" if text else "never"

    row = lambda i, audio, declared: (f"v{i}", (f"t{i}", f"d{i}", "c", "1", "2024-01-01T00:00:00Z", "none", audio, declared, [], {}), ("PT5M", "true"), ("1", "1", "1"), ("public", "youtube", True))
    rows = spark.createDataFrame([row(0, "en", None), row(1, None, " "), row(2, None, "de"), row(3, "fr", "en")], videos.VIDEO)
    hits = spark.createDataFrame([], "video_id string, kind string, mode string, query_group string, rank int, query_text string, feed string")
    topics, cats = spark.createDataFrame([], "video_id string, topics array<string>"), spark.createDataFrame([("1", "one")], "category_id string, title string")
    built = candidates.build(rows, hits, topics, cats, F.lit("2024-01-02 00:00:00").cast("timestamp"), candidate_queries.SETTINGS, detect)
    got = {r[0]: r[1:] for r in built.select("video_id", "detected_language", "language_source").collect()}
    assert got == {"v0": ("en", "defaultAudioLanguage"), "v1": ("en", "text_detection+caption"), "v2": ("de", "defaultLanguage"), "v3": ("fr", "defaultAudioLanguage")}


def test_whole_phrases(spark):
    texts = ["of the", "xof the", "of thex", "xof the of the", "of thé of the,", "-of the-", "of_the", "ofof the", "of the_", "日of the", "", "1of the 2 of the3"]
    got = [r[0] for r in spark.createDataFrame(list(enumerate(texts)), "i int, t string").orderBy("i").select(T.has_phrase(F.col("t"), " Of  THE ")).collect()]
    assert got == [bool(re.search(r"(?<!\w)of the(?!\w)", t)) for t in texts]


def test_title_pairs_against_all_pairs(spark):
    parts = spark.read.parquet("/root/testdata/sf0.001/part.parquet").collect()
    keys = {(r["p_type"], " ".join(tokens(f"{r['p_name']} {r['p_brand']}"))) for r in parts}
    want, by_ratio = set(), 0
    for (g, a), (h, b) in itertools.combinations(sorted(keys), 2):
        x, y = set(a.split()), set(b.split())
        same = len(x & y) / len(x | y) >= 0.65
        ratio = max(SequenceMatcher(None, a, b).ratio(), SequenceMatcher(None, b, a).ratio()) >= 0.78
        if g == h and (same or ratio):
            want.add((g, *sorted((a, b))))
            by_ratio += not same
    rows = spark.createDataFrame([(r["p_type"], f"{r['p_name']} {r['p_brand']}") for r in parts], "p_type string, title string")
    got = {(r["p_type"], r["a"], r["b"]) for r in clustering.similar_titles(rows, ["the", "new"], 0.65, 0.78, ["p_type"]).collect()}
    assert got == want and by_ratio > 50
    few = clustering.similar_titles(rows, ["the", "new"], 0.65, 0.78, ["p_type"], tile=60).collect()  # a few titles a tile
    assert {(r["p_type"], r["a"], r["b"]) for r in few} == want and len(few) == len(want)


def test_bounds_lose_no_pair():
    """Titles of any script and length, near each other by small changes, against all pairs."""
    rng = random.Random(4)
    keys = {"".join(rng.choice("abcde é日本") for _ in range(rng.choice([1, 3, 30, 64, 65, 130]))) for _ in range(60)}
    for k in list(keys):
        c = list(k)
        for _ in range(rng.randrange(1, 1 + max(1, len(c) // 6))):
            c[rng.randrange(len(c))] = rng.choice("xyz 語")
        keys.add("".join(c))
    keys = sorted(keys) + ["z" * 300 + "q", "q" + "z" * 300]
    hit = lambda a, b: SequenceMatcher(None, a, b).ratio() >= 0.78
    want = {(a, b, hit(a, b), hit(b, a)) for a, b in itertools.combinations(sorted(keys), 2) if hit(a, b) or hit(b, a)}
    assert set(near_titles.alike(keys, None, 0.78)) == want and len(want) > 30
    assert set(near_titles.alike(keys[::2], keys[1::2], 0.78)) == {x for x in want if (x[0] in keys[::2]) != (x[1] in keys[::2])}


def test_ranks_over_the_whole_table(spark):
    rows = spark.range(5_000).selectExpr("id AS video_id", "cast(id * 7919 % 613 AS double) AS final_score").repartition(5)
    got = selection.by_score(rows).orderBy("rank").collect()
    assert [r["rank"] for r in got] == list(range(1, 5_001))
    assert [(r["final_score"], r["video_id"]) for r in got] == sorted(((r["final_score"], r["video_id"]) for r in got), key=lambda x: (-x[0], x[1]))


def row(i, topic="alpha", channel=None, event=None, groups=("g",), popular=(), score=None):
    details = [{"query_group": g, "search_mode": "fresh", "search_rank": 1, "query_text": "q"} for g in groups]
    return ("d", f"v{i:03d}", float(100 - i if score is None else score), topic, channel or f"c{i}", event or f"e{i}", 13.0, 10.0, details, list(popular), "medium", "high")


ROW = "day string, video_id string, final_score double, primary_topic string, channel_title string, semantic_duplicate_group string, interest_score double, growth_score double, search_source_details array<struct<query_group:string,search_mode:string,search_rank:int,query_text:string>>, popular_source_details array<string>, copyright_risk string, localization_suitability string"


def chosen(spark, rows, limit=50, **changes):
    s = CandidateSettings(topic_quotas={"alpha": 14, "beta": 8, "wildcard_popular": 2}, topic_max_counts={"alpha": 16, "beta": 10, "wildcard_popular": 2}, **changes)
    return selection.greedy_select(spark.createDataFrame(rows, ROW), s, ["day"], limit).collect()


def test_caps(spark):
    many = lambda n, **k: [row(i, groups=(f"g{i}",), **k) for i in range(n)]
    assert len(chosen(spark, many(8, channel="one"))) == 2
    assert len(chosen(spark, many(8, event="one"))) == 2
    assert len(chosen(spark, [row(i) for i in range(8)])) == 6
    assert len(chosen(spark, [row(i, groups=(), popular=("f",)) for i in range(12)])) == 5
    wild = chosen(spark, [row(i, groups=(f"g{i}",), popular=("f",)) for i in range(30)])
    assert sum(r["selection_topic"] == "wildcard_popular" for r in wild) == 2 and len(wild) == 18
    two = chosen(spark, [row(i, groups=(f"g{i}",)) for i in range(20)] + [row(100 + i, topic="beta", groups=(f"h{i}",), score=0.5) for i in range(10)], 24)
    assert len(two) == 24 and sum(r["selection_topic"] == "beta" for r in two) == 8
    assert [r["rank"] for r in sorted(two, key=lambda r: -r["final_score"])] == list(range(1, 25))
    assert chosen(spark, [row(0, groups=("a", "b"))])[0]["contributing_query_group"] == "a"


class Plain:
    """The selection as a list of rounds over one group's rows in order."""

    def __init__(self, rows, s, limit):
        self.s, self.limit, self.out, self.no = s, limit, {}, Counter()
        rows = sorted(rows, key=lambda r: (-r["final_score"], r["video_id"]))
        rows = [r for r in rows if r["primary_topic"] in s.topic_max_counts]
        self.wild = min(int(s.topic_quotas.get("wildcard_popular", 0)), s.popular_target)
        regular = limit - self.wild
        for t, quota in s.topic_quotas.items():
            if t != "wildcard_popular":
                own = [r for r in rows if r["primary_topic"] == t]
                self.round(sorted(own, key=lambda r: not r["search_source_details"]), regular, int(quota), lambda r: "topic_quota")
        growth = lambda r: "multi_query_match" if len(r["search_source_details"]) > 1 else "high_interest" if r["interest_score"] >= 12 else "high_growth" if r["growth_score"] >= 60 else "global_backfill"
        self.round([r for r in rows if r["search_source_details"] and r["primary_topic"] != "wildcard_popular"], regular, limit, growth)
        self.round([r for r in rows if r["popular_source_details"] and r["interest_score"] >= s.wildcard_interest_min], limit, self.wild, lambda r: "wildcard_popular", "wildcard_popular")
        self.round(rows, limit, limit, lambda r: "global_backfill")

    def round(self, rows, in_all, own, reason, topic=None):
        before = len(self.out)
        for r in rows:
            if len(self.out) >= in_all or len(self.out) - before >= own:
                return
            if r["video_id"] not in self.out:
                self.offer(r, reason(r), topic or r["primary_topic"])

    def offer(self, r, reason, topic):
        of = lambda f: sum(map(f, self.out.values()))
        s, groups = self.s, list(dict.fromkeys(d["query_group"] for d in r["search_source_details"]))
        group = next((g for g in groups if of(lambda x: x[4] == g) < s.max_per_query_group), None)
        alone = bool(r["popular_source_details"]) and not groups
        tests = [
            ("topic", of(lambda x: x[3] == topic) < s.topic_max_counts[topic]), ("wildcard", topic != "wildcard_popular" or of(lambda x: x[3] == topic) < self.wild),
            ("channel", of(lambda x: x[0]["channel_title"].lower() == r["channel_title"].lower()) < s.max_per_channel),
            ("event", of(lambda x: x[0]["semantic_duplicate_group"] == r["semantic_duplicate_group"]) < s.max_per_event), ("query", group is not None or not groups), ("popular", not alone or of(lambda x: x[5]) < s.popular_max),
        ]
        for name, fine in tests:
            if not fine:
                self.no[name] += 1
                return
        self.out[r["video_id"]] = (r, r["video_id"], reason, topic, group or "", alone)


def hostile(rng, n, day):
    """Rows of few channels, events and query groups, so that most are refused."""
    few = rng.choice([2, 5, 40])
    out = []
    for i in range(n):
        groups, popular = [f"g{rng.randrange(few)}" for _ in range(rng.choice([0, 1, 1, 3]))], ["f"] * rng.randrange(2)
        r = row(i, rng.choice(["alpha", "alpha", "beta", "wildcard_popular", "none"]), f"C{rng.randrange(few)}", f"e{rng.randrange(2 * few)}", groups, popular, float(rng.randrange(9)))
        out.append((day, *r[1:6], float(rng.randrange(20)), float(rng.randrange(100)), *r[8:]))
    return out


@pytest.mark.parametrize("best", [None, 3])
def test_selection_against_plain_rounds(spark, best):
    """With three rows of each pass hardly any group has its certificate; both ways give what whole lists give."""
    rng = random.Random(7)
    rows = [r for k in range(24) for r in hostile(rng, rng.choice([1, 6, 40, 150]), f"d{k}")]
    df = spark.createDataFrame(rows, ROW).repartition(3)
    refused = Counter()
    for caps in ({}, {"max_per_channel": 20, "max_per_event": 20, "max_per_query_group": 2, "popular_max": 1}):
        s = CandidateSettings(topic_quotas={"alpha": 7, "beta": 4, "wildcard_popular": 2}, topic_max_counts={"alpha": 9, "beta": 5, "wildcard_popular": 4}, min_search_share=0.5, **caps)
        refused.update(compared(df, s, best))
    assert set(refused) == set(selection.REFUSALS)


def compared(df, s, best):
    """What the caps refused, after each day's rows and counts have been compared."""
    chosen, counts = selection.select(df, s, ["day"], 13, best)
    got, told = {}, {r["day"]: r for r in counts.collect()}
    for r in chosen.collect():
        got.setdefault(r["day"], {})[r["video_id"]] = (r["rank"], r["selection_reason"], r["selection_topic"], r["contributing_query_group"])
    by_day = {}
    for r in df.collect():
        by_day.setdefault(r["day"], []).append(r)
    refused = Counter()
    for day, own in by_day.items():
        want = Plain(own, s, 13)
        order = sorted(want.out.values(), key=lambda x: (-x[0]["final_score"], x[1]))
        assert got.get(day, {}) == {x[1]: (k, *x[2:5]) for k, x in enumerate(order, 1)}
        if day in told:
            t = told[day].asDict()
            assert [t[f"{k}_limit"] for k in selection.REFUSALS] == [want.no[k] for k in selection.REFUSALS]
            assert (t["selected"], t["selected_with_search"], t["selected_popular_only"]) == (len(order), sum(bool(x[0]["search_source_details"]) for x in order), sum(x[5] for x in order))
            assert t["search_share_low"] == ((t["selected_with_search"] / t["selected"] if order else 0.0) < 0.5)
        refused.update(want.no)
    return refused


def test_selection_clusters_few_rows(spark):
    """Chosen rows and refusals of the whole groups' clusters, with a few of the best rows clustered; some groups need all."""
    rng = random.Random(11)
    words = ["minecraft", "garden", "update", "secret", "tomato", "harvest", "speedrun", "challenge", "hundred", "days"]
    rows = [(*r, " ".join(rng.sample(words, rng.randrange(2, 6)))) for k, n in enumerate([1, 6, 40, 150, 150, 300, 300]) for r in hostile(rng, n, f"d{k}")]
    rows = [(*r[:2], rng.choice([None, -3.0]) if rng.random() < 0.01 else round(rng.random() * 300, rng.randrange(1, 4)), *r[3:5], *r[6:]) for r in rows]
    df = spark.createDataFrame(rows, f"{ROW}, title string".replace(" semantic_duplicate_group string,", "")).repartition(3)
    s, given = CandidateSettings(topic_quotas={"alpha": 7, "beta": 4, "wildcard_popular": 2}, topic_max_counts={"alpha": 9, "beta": 5, "wildcard_popular": 4}), []

    def cluster(part):
        given.append(part.groupBy("day").count().collect())
        return clustering.leader_clusters(part, [], 0.65, None, ["day"])

    plain = lambda tables: [sorted(map(repr, (r.asDict() for r in t.collect()))) for t in tables]
    want = plain(selection.select(cluster(df), s, ["day"], 6))
    for depths in ((4,), (20, 120), (999,)):
        given.clear()
        assert plain(selection.select_clustered(df, s, ["day"], cluster, 6, depths)) == want
        assert all(r["count"] <= depth for depth, step in zip(depths, given, strict=False) for r in step)
        assert len(given) <= len(depths) + 1
    given.clear()
    selection.select_clustered(df, s, ["day"], cluster, 6, (120, 200))
    assert {r["day"] for r in given[0]} == {f"d{k}" for k in range(7)} and all(len(x) < 5 for x in given[1:])


def test_best_rows_alone_are_shuffled(spark):
    """A region of any size sends some rows a pass and task."""
    sizes = []
    for n in (4_000, 16_000):
        rows = spark.range(n).selectExpr("'d' AS day", "concat('v', id) AS video_id", "cast(hash(id) AS double) AS final_score", "if(id % 2 = 0, 'alpha', 'beta') AS primary_topic", "concat('c', id) AS channel_title", "concat('e', id) AS semantic_duplicate_group", "1D AS interest_score", "1D AS growth_score", "array(named_struct('query_group', concat('g', id % 50))) AS search_source_details", "array('f') AS popular_source_details", "'low' AS copyright_risk", "'high' AS localization_suitability").coalesce(2)
        s = CandidateSettings(topic_quotas={"alpha": 3, "beta": 2, "wildcard_popular": 1}, topic_max_counts={"alpha": 4, "beta": 4, "wildcard_popular": 1})
        offers = selection._offers(rows, s, selection._passes(s, 6), ["day"])
        place = F.row_number().over(W.partitionBy("day", "step").orderBy(*selection.PLACE[1:]))
        best = offers.withColumn("place", place).where(F.col("place") <= 96)
        best.collect()
        assert "WindowGroupLimit" in best._jdf.queryExecution().executedPlan().toString()
        sizes.append(shuffled_rows(best))
        assert len(selection.greedy_select(rows, s, ["day"], 6).collect()) == 6
    assert sizes[0] == sizes[1] <= 2 * 5 * 96


def shuffled_rows(df):
    """Rows that the exchanges of a plan that has run have written, by its own counts."""
    plan, total = df._jdf.queryExecution().executedPlan(), 0
    todo = [plan.finalPhysicalPlan() if "Adaptive" in plan.nodeName() else plan]
    while todo:
        node = todo.pop()
        if node.nodeName() == "Exchange":
            total += node.metrics().apply("shuffleRecordsWritten").value()
        if "QueryStage" in node.nodeName():
            todo.append(node.plan())
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return total


def test_settings_problems():
    good = CandidateSettings(candidate_limit=5, topic_quotas={"alpha": 3, "wildcard_popular": 2}, topic_max_counts={"alpha": 3, "wildcard_popular": 2})
    assert problems(good) == []
    bad = replace(good, topic_max_counts={"alpha": 1}, search_reserve_calls=50, max_per_event=0, candidate_limit=6, search_core_query_groups_per_day=30)
    assert problems(bad) == ["topic_quotas", "topic_max_counts", "max_per_event", "search_reserve_calls", "search_daily_budget"]


def test_groups_of_days_run_apart(spark):
    rows = [(f"d{i % 3}", *row(i, channel="one")[1:]) for i in range(12)]
    assert len(chosen(spark, rows)) == 6


def test_plan_moves_on_each_day(spark):
    days = spark.createDataFrame([("2026-07-20",), ("2026-07-21",)], "d string").select(F.col("d").cast("date").alias("day"))
    rows = selection.query_plan(days, SETTINGS).orderBy("day", "position").collect()
    assert len(rows) == 16 and len({(r["day"], r["query"]) for r in rows}) == 16
    by_day = {}
    for r in rows:
        by_day.setdefault(r["day"], []).append(r["query"])
    one, two = by_day.values()
    assert one[:4] == two[:4] == ["a1", "a2", "b1", "g1"] and one != two


def test_video_scan_keeps_the_last_row(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"id":"x","snippet":{"title":"old"}}\n{"id":"x","snippet":{"title":"new","tags":["t"]},"statistics":{"viewCount":"7"}}\n{"id":"y"}\n')
    rows = {r["video_id"]: r for r in videos.read_videos(spark, str(tmp_path)).collect()}
    assert rows["x"]["snippet"]["title"] == "new" and rows["x"]["statistics"]["viewCount"] == "7" and rows["y"]["snippet"] is None


def test_candidate_files(spark, tmp_path):
    for name, text in (("2026-07-20_a.json", '[{"video_id":"a"}]'), ("2026-07-21_b.json", '{"candidates":[{"video_id":"b"},{"video_id":"c"}]}')):
        (tmp_path / name).write_text(text)
    assert {r["video_id"] for r in videos.read_candidates(spark, str(tmp_path), "video_id:string").collect()} == {"a", "b", "c"}
    assert videos.latest_snapshot(spark, str(tmp_path)).first()["file"].endswith("2026-07-21_b.json")
    (tmp_path / "bad.json").write_text('"x"')
    with pytest.raises(Exception, match="no candidate records"):
        videos.read_candidates(spark, str(tmp_path / "bad.json"), "video_id:string").collect()


def test_categories(spark, tmp_path):
    path = tmp_path / "c.json"
    path.write_text('{"fallback_tid":2,"categories":[{"tid":1,"name":"A","parent_tid":9,"parent_name":"P"},{"tid":2,"name":"B","parent_name":"P"}]}')
    assert {(r["tid"], r["path"], r["is_fallback"]) for r in videos.read_categories(spark, str(path)).collect()} == {(1, "P / A", False), (2, "P / B", True)}
    path.write_text('{"fallback_tid":2,"categories":[{"tid":2,"name":"A","parent_name":"P"},{"tid":2,"name":"B","parent_name":"P"}]}')
    with pytest.raises(Exception, match="repeated"):
        videos.read_categories(spark, str(path)).collect()


def test_manifest_scan(spark, tmp_path):
    for name, text in (("t1", '{"video_id":"a","overall_status":"success"}'), ("t2", "{broken"), ("t3/stage4", '{"video_id":"z"}')):
        (tmp_path / name).mkdir(parents=True)
        (tmp_path / name / "download_manifest.json").write_text(text)
    rows = {r["task"]: r for r in manifests.scan_manifests(spark, str(tmp_path)).collect()}
    assert set(rows) == {"t1", "t2"} and rows["t1"]["video_id"] == "a" and rows["t1"]["error"] is None and rows["t2"]["error"] == "invalid_json"
    hashes = manifests.file_hashes(spark, str(tmp_path), "*.json").collect()
    assert len(hashes) == 3 and all(len(r["hash"]) == 64 for r in hashes)


def test_review_round_trip(spark, tmp_path):
    src = spark.createDataFrame([("v", 1, 0.0, 1.5, 'say "hi"\tnow'), ("v", 2, 1.5, 2.0, "two")], "video_id string, id int, start double, end double, text string")
    flags = src.select("video_id", "id", F.array(F.lit("A"), F.lit("B")).alias("qc_flags"))
    rows = sinks.review_rows(src, src.select("video_id", "id", F.lit("raw").alias("text")), src.where("id = 2").select("video_id", "id", F.lit("clean").alias("text")), flags, spark.createDataFrame([("v", "whisper")], "video_id string, source string"))
    sinks.write_review(rows, str(tmp_path / "r"))
    back = {r["id"]: r for r in manifests.read_review(spark, str(tmp_path / "r")).collect()}
    assert back[1]["english"] == 'say "hi"\tnow' and back[1]["reviewed_translation"] == "raw" and back[2]["chinese_clean"] == "clean" and back[2]["qc_flags"] == "A|B" and back[1]["duration"] == "1.500"
    src.select("id").write.csv(str(tmp_path / "bad"), sep="\t", header=True)
    with pytest.raises(ValueError, match="INVALID_REVIEW_COLUMNS"):
        manifests.read_review(spark, str(tmp_path / "bad"))


def test_table_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", [1, 2], {"k": "v"})], "id string, xs array<int>, m map<string,string>")
    sinks.write_csv(df, str(tmp_path / "c"), ["m", "id", "xs"])
    assert spark.read.csv(str(tmp_path / "c"), header=True, escape='"').first().asDict() == {"m": '{"k":"v"}', "id": "a", "xs": "[1,2]"}
    sinks.write_envelope(df, str(tmp_path / "j"), {"region": "US"})
    assert spark.read.json(str(tmp_path / "j/metadata")).first().asDict() == {"region": "US", "count": 1}
    cp = spark.createDataFrame([("t", "s1", "f", "QC_PASSED", {"a": "h"})], "task string, step string, fingerprint string, qc_status string, outputs map<string,string>")
    sinks.write_checkpoints(cp, str(tmp_path / "k"))
    sinks.write_checkpoints(cp, str(tmp_path / "k"))
    assert spark.read.parquet(str(tmp_path / "k")).count() == 2
    assert sinks.qc_text(spark.createDataFrame([("v", 1, None)], "video_id string, n int, s string"), ["video_id"]).first()["content"] == "n: 1\ns: None\n"
    report = spark.createDataFrame([("v", "youtube")], "video_id string, selected_source string")
    with pytest.raises(ValueError, match="empty"):
        sinks.write_selection(report, spark.createDataFrame([], "video_id string, cue_id int"), str(tmp_path / "s"))
    sinks.write_selection(report, spark.createDataFrame([("v", 1)], "video_id string, cue_id int"), str(tmp_path / "s2"))


def test_ass_file(spark):
    pairs = spark.createDataFrame([("v", "1", 0.0, 1.0, "Hello {x}", "你好")], "video_id string, identifier string, start double, end double, text string, other string")
    sizes = spark.createDataFrame([("v", 1080, 1920)], "video_id string, width int, height int")
    text = sinks.ass_texts(tasks.font_sizes(pairs, sizes), sizes).first()["content"]
    assert "PlayResX: 1080\nPlayResY: 1920" in text and text.endswith("\n") and text.count("Dialogue:") == 1
    assert text.splitlines()[-1] == "Dialogue: 0,0:00:00.00,0:00:01.00,Bilingual,,0,0,0,,{\\fnArial\\fs60\\b0}Hello \\{x\\}\\N{\\fnMicrosoft YaHei\\fs85\\b0}你好"


def test_stages_and_progress(spark):
    cols = "task string, download_status string, english_ready boolean, translation_ready boolean, selected_output string, translation_status string, stage3_errors array<string>, stage4_status string, stage4_qc string, publish_status string"
    rows = [("a", "success", True, True, "x", "QC_PASSED", [], "STAGE4_COMPLETED", None, None), ("b", "success", True, True, "x", "QC_PASSED", [], "STAGE4_COMPLETED", None, "PUBLISHED"), ("c", "failed", None, None, None, None, None, None, None, None), ("d", "success", False, False, "", "FAILED_X", ["e"], None, "REVIEW_REQUIRED", None)]
    got = {r["task"]: (r["progress"], r["overall"]) for r in tasks.stage_states(spark.createDataFrame(rows, cols)).collect()}
    assert got == {"a": (80, "rendered"), "b": (100, "published"), "c": (0, "failed"), "d": (40, "needs_review")}


def test_streams(spark, tmp_path):
    rows = [("a", "g", "fresh", "2026-01-01 00:00:00", 1.0), ("a", "g", "fresh", "2026-01-01 01:00:00", 2.0), ("b", "g", "fresh", "2026-01-01 02:00:00", 3.0), ("b", "g", "growth", "2026-01-05 02:00:00", 4.0), ("z", "g", "fresh", "2026-01-09 00:00:00", 5.0)]
    df = spark.createDataFrame(rows, "video_id string, query_group string, mode string, ts string, value double").withColumn("ts", F.to_timestamp("ts"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    source = lambda: spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    once = streams.drain(streams.discovery(source()), "once", str(tmp_path / "c1"))
    assert {(r["video_id"], r["mode"]) for r in once.collect()} == {("a", "fresh"), ("b", "fresh"), ("b", "growth"), ("z", "fresh")}
    funnel = streams.drain(streams.daily_funnel(source().withColumnRenamed("mode", "event_type")), "funnel", str(tmp_path / "c2"))
    assert {(str(r["day_start"])[:10], r["n"]) for r in funnel.collect()} == {("2026-01-01", 3), ("2026-01-05", 1)}
    talk = df.where("video_id <> 'z'").withColumns({"seconds": F.lit(1800.0)})
    assert sorted(r["n"] for r in streams.utterances(talk, ["query_group"], 1800.0).collect()) == [1, 3]
    assert sorted(r["n"] for r in streams.utterances(talk, ["query_group"], 1799.0).collect()) == [1, 1, 1, 1]
    events = spark.createDataFrame([(1, "queued", 1), (1, "running", 2), (2, "done", 1)], "id int, status string, updated_at int")
    events.repartition(1).write.parquet(str(tmp_path / "jobs"))
    path = str(tmp_path / "state")
    query = spark.readStream.schema(events.schema).parquet(str(tmp_path / "jobs")).writeStream.foreachBatch(job_states.upsert(path)).option("checkpointLocation", str(tmp_path / "c3")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert {tuple(r) for r in job_states.read(spark, path).collect()} == {(1, "queued"), (2, "done")}
