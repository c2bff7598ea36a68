"""Caption tracks as tables of cues: (keys, cue_id, start, end, text), keys ["video_id"] or ["video_id", "track"].

Every operator takes all tracks at once. Windows run by key in order of cue_id, so tracks are independent and the one shuffle is by key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cuefold.functions import text as T

KEYS = ["video_id"]


def _order(keys: list[str]):
    return W.partitionBy(*keys).orderBy("cue_id")


def duration() -> Column:
    return F.greatest(F.col("end") - F.col("start"), F.lit(0.0))


def adjacent(cues: DataFrame, keys: list[str] = KEYS, minimum_gap: float = 0.02) -> DataFrame:
    """Each cue with what it is to the cue before: duplicate, prefix, contained, reversed, overlap, small_gap; false for the first."""
    w = _order(keys)
    now = T.comparable(F.col("text"))
    df = cues.withColumns({"__now": now, "__prev": F.lag(now).over(w), "__start": F.lag("start").over(w), "__end": F.lag("end").over(w)})
    both = (F.col("__now") != "") & (F.col("__prev") != "")
    flag = lambda c: F.coalesce(c, F.lit(False))
    gap = F.col("start") - F.col("__end")
    return df.withColumns({
        "duplicate": flag(F.col("__now") == F.col("__prev")), "prefix": flag(both & F.col("__now").startswith(F.col("__prev"))),
        "contained": flag(both & (F.col("__now").startswith(F.col("__prev")) | F.col("__now").contains(F.col("__prev")))),
        "reversed": flag(F.col("start") < F.col("__start")), "overlap": flag(F.col("start") < F.col("__end")), "small_gap": flag((gap > 0) & (gap < minimum_gap)),
    }).drop("__now", "__prev", "__start", "__end")


def strict_order(cues: DataFrame, durations: DataFrame | None = None, keys: list[str] = KEYS, tolerance: float = 0.001) -> DataFrame:
    """Each cue with `invalid`: negative, empty, before its predecessor's start or end, or past the video's end."""
    w = _order(keys)
    df = cues if durations is None else cues.join(durations.select("video_id", F.col("duration").alias("__d")), "video_id", "left")
    late = F.lit(False) if durations is None else F.coalesce(F.col("end") > F.col("__d") + max(0.0, tolerance), F.lit(False))
    back = (F.col("start") < F.coalesce(F.lag("start").over(w), F.lit(-1.0))) | (F.col("end") < F.coalesce(F.lag("end").over(w), F.lit(-1.0)))
    return df.withColumn("invalid", (F.col("start") < 0) | (F.col("end") <= F.col("start")) | back | late).drop("__d")


def caption_qc(cues: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """One row a track: counts of empty, duplicate, rolling, overlapping, invalid, reversed, short, long and fast cues, covered seconds and status."""
    a = adjacent(cues, keys)
    d = duration()
    n = lambda c, name: F.count_if(c).alias(name)
    out = a.groupBy(*keys).agg(
        n(F.trim("text") == "", "empty_segments"), n(F.col("duplicate"), "adjacent_duplicates"), n(F.col("prefix"), "rolling_duplicate_residuals"), n(F.col("overlap"), "overlaps"),
        n(F.col("start") >= F.col("end"), "invalid_timestamps"), n(F.col("reversed"), "reversed_timestamps"), n(d < 0.3, "under_0_3_seconds"), n(d > 8.0, "over_8_seconds"),
        n(F.coalesce(F.try_divide(F.length("text"), d), F.lit(0.0)) > 22, "over_22_cps"), F.round(F.sum(d), 3).alias("coverage_seconds"), F.count("*").alias("output_segments"),
    )
    good = (F.col("empty_segments") + F.col("adjacent_duplicates") + F.col("overlaps") + F.col("invalid_timestamps")) == 0
    return out.withColumn("status", F.when(good, "QC_PASSED").otherwise("REVIEW_REQUIRED"))


def timeline_summary(cues: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """One row a track: first start, last end, seconds of cues, overlaps."""
    w = _order(keys)
    df = cues.withColumn("__over", F.coalesce(F.col("start") < F.lag("end").over(w), F.lit(False)))
    return df.groupBy(*keys).agg(
        F.min_by("start", "cue_id").alias("first_start"), F.max_by("end", "cue_id").alias("last_end"), F.round(F.sum(duration()), 3).alias("cue_seconds"), F.count_if("__over").alias("overlaps"), F.count("*").alias("segments"),
    )


def translation_preflight(cues: DataFrame, batch: int = 24, keys: list[str] = KEYS) -> DataFrame:
    """One row a track: the timeline summary and the number of batches that a translation takes; nothing is called."""
    return timeline_summary(cues, keys).withColumn("batches", F.ceil(F.col("segments") / batch).cast("bigint"))


# Rolling captions


def rolling_increment(cues: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Visible cues with `delta`, what is new against the last visible one before, `removed` units and `reason`; empty cues and those under 0.05 s are left out.

    In turn: equal; begins with the previous text (the rest is new); the previous ends with it; the longest run of two or more words that
    ends the one and begins the other; for Chinese the same by characters; else all is new.
    """
    full = T.clean_visible(F.col("text"))
    seen = cues.withColumn("full", full).where((F.col("full") != "") & (F.col("end") - F.col("start") >= 0.05))
    df = seen.withColumn("__prev", F.coalesce(F.lag("full").over(_order(keys)), F.lit("")))
    df = df.withColumns({"__cur": F.lower("full"), "__low": F.lower("__prev"), "__words": T.tokens(F.col("full"))})
    df = df.withColumns({"__size": T.overlap_size(F.transform(T.tokens(F.col("__prev")), T.token_key), F.transform("__words", T.token_key)), "__chars": F.least(F.length("__cur"), F.length("__low"))})
    sizes = F.when(F.concat("__prev", "full").rlike(T.CJK) & (F.col("__chars") >= 2), F.sequence(F.lit(2), F.col("__chars"))).otherwise(F.array().cast("array<int>"))
    cjk = F.coalesce(F.array_max(F.filter(sizes, lambda k: F.right("__low", k) == F.left("__cur", k))), F.lit(0))
    df = df.withColumn("__cjk", F.when(F.col("__size") >= 2, 0).otherwise(cjk))
    strip = lambda c: F.regexp_replace(c, "^[ \\t–—-]+|[ \\t–—-]+$", "")
    n_cur, n_prev = F.greatest(F.size("__words"), F.lit(1)), F.greatest(F.size(T.tokens(F.col("__prev"))), F.lit(1))
    row = lambda delta, removed, reason: F.struct(delta.alias("delta"), removed.cast("int").alias("removed"), F.lit(reason).alias("reason"))
    found = (
        F.when(F.col("__prev") == "", row(F.col("full"), F.lit(0), "new")).when(F.col("__cur") == F.col("__low"), row(F.lit(""), n_cur, "exact"))
        .when(F.col("__cur").startswith(F.col("__low")), row(strip(F.substring("full", F.length("__prev") + 1, F.length("full"))), n_prev, "prefix"))
        .when(F.col("__low").endswith(F.col("__cur")), row(F.lit(""), n_cur, "suffix"))
        .when(F.col("__size") >= 2, row(T.smart_join(F.slice("__words", F.col("__size") + 1, F.greatest(F.size("__words") - F.col("__size"), F.lit(0)))), F.col("__size"), "words"))
        .when(F.col("__cjk") >= 2, row(F.trim(F.substring("full", F.col("__cjk") + 1, F.length("full"))), F.col("__cjk"), "characters"))
        .otherwise(row(F.col("full"), F.lit(0), "new"))
    )
    return df.withColumn("__r", found).select(*[c for c in cues.columns], "full", "__r.*").withColumn("delta", T.drop_repeats(F.col("delta")))


def timed_increment(cues: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Cues with `increment`, `removed` and `reason` (exact, prefix, contained, suffix_prefix, new) against the last cue with text; short cues stay, empty ones give an empty increment.

    A text within the previous one counts as contained from four signs and six tenths of its length on.
    """
    w = _order(keys)
    has = F.trim("text") != ""
    df = cues.withColumn("__prev", F.coalesce(F.last(F.when(has, F.col("text")), ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit("")))
    df = df.withColumns({"__a": T.comparable(F.col("__prev")), "__b": T.comparable(F.col("text")), "__words": T.tokens(F.col("text")), "__before": T.tokens(F.col("__prev"))})
    df = df.withColumn("__size", T.overlap_size(F.transform("__before", T.token_key), F.transform("__words", T.token_key)))
    rest = lambda n: F.array_join(F.slice("__words", n + 1, F.greatest(F.size("__words") - n, F.lit(0))), " ")
    row = lambda text, removed, reason: F.struct(text.alias("increment"), removed.cast("int").alias("removed"), F.lit(reason).alias("reason"))
    found = (
        F.when(~has, row(F.lit(""), F.lit(0), "empty")).when(F.col("__a") == "", row(F.trim("text"), F.lit(0), "new"))
        .when(F.col("__a") == F.col("__b"), row(F.lit(""), F.size("__words"), "exact")).when(F.col("__b").startswith(F.col("__a")), row(rest(F.size("__before")), F.size("__before"), "prefix"))
        .when(F.col("__a").contains(F.col("__b")) & (F.length("__b") >= F.greatest(F.lit(4), F.floor(F.length("__a") * 0.6).cast("int"))), row(F.lit(""), F.size("__words"), "contained"))
        .when(F.col("__size") >= 2, row(rest(F.col("__size")), F.col("__size"), "suffix_prefix")).otherwise(row(F.trim("text"), F.lit(0), "new"))
    )
    return df.withColumn("__r", found).select(*cues.columns, "__r.*")


def fuzzy_increment(cues: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """timed_increment with one more look at those that are new: the last three cues, newest first, at most 0.75 s before.

    A run of two or more words, six tenths of the shorter side, goes (`fuzzy`); so does a whole cue of four or more words whose word ratio
    to one of them reaches 0.9 and that begins at most 0.25 s after its end.
    """
    from cuefold.functions.udfs import token_ratio

    w = _order(keys).rowsBetween(-3, -1)
    mine = F.transform(T.tokens(F.col("increment")), T.token_key)
    df = timed_increment(cues, keys).withColumn("mine", mine)
    df = df.withColumn("recent", F.collect_list(F.struct(F.col("end").alias("end"), F.transform(T.tokens(F.col("text")), T.token_key).alias("k"))).over(w))
    look = (F.col("reason") == "new") & (F.col("increment") != "")
    for i in (1, 2, 3):
        past = F.when(look & (F.size("recent") >= i), F.get("recent", F.size("recent") - i))
        keysof = F.coalesce(past["k"], F.array().cast("array<string>"))
        near = F.coalesce(F.col("start") - past["end"] <= 0.75, F.lit(False))
        size = T.overlap_size(keysof, F.col("mine"))
        enough = (size >= 2) & (F.try_divide(size, F.greatest(F.least(F.size(keysof), F.size("mine")), F.lit(1))) >= 0.6)
        df = df.withColumns({f"near{i}": near, f"size{i}": F.when(near & enough, size).otherwise(0), f"keys{i}": keysof, f"late{i}": F.coalesce(F.col("start") <= past["end"] + 0.25, F.lit(False))})
        df = df.withColumn(f"same{i}", F.col(f"near{i}") & F.col(f"late{i}") & (F.size("mine") >= 4) & (token_ratio(f"keys{i}", "mine") >= 0.9))
    cut = F.lit(None).cast("int")
    for i in (3, 2, 1):
        hit, same = F.col(f"size{i}") > 0, F.col(f"same{i}")
        cut = F.when(hit, F.col(f"size{i}")).when(same, F.size("mine")).otherwise(cut)
    df = df.withColumn("__cut", F.when(look, cut))
    rest = F.array_join(F.slice(T.tokens(F.col("increment")), F.col("__cut") + 1, F.greatest(F.size("mine") - F.col("__cut"), F.lit(0))), " ")
    hit = F.col("__cut").isNotNull()
    return df.select(*cues.columns, F.when(hit, rest).otherwise(F.col("increment")).alias("increment"), F.when(hit, F.col("__cut")).otherwise(F.col("removed")).alias("removed"), F.when(hit, "fuzzy").otherwise(F.col("reason")).alias("reason"))


def cue_words(cues: DataFrame) -> DataFrame:
    """Cues with `words`: array of (text, start, end, first_seen_at) from the raw text. Inline times begin chunks; words share a chunk's time, 0.01 s at least, evenly."""
    raw = F.col("text")
    marks = F.regexp_extract_all(raw, F.lit(r"<(\d{1,2}:\d{2}:\d{2}[.,]\d{3})>"), F.lit(1))
    from cuefold.functions.times import parse_timestamp

    times = F.transform(marks, parse_timestamp)
    parts = F.split(raw, T.INLINE_TIME, -1)
    starts = F.concat(F.array(F.col("start")), F.transform(times, lambda t: F.greatest(F.col("start"), t)))
    ends = F.concat(F.transform(times, lambda t, i: F.when(i == 0, t).otherwise(F.least(F.col("end"), t))), F.array(F.col("end")))
    chunks = F.zip_with(F.arrays_zip(starts.alias("a"), ends.alias("b")), parts, lambda x, p: F.struct(x["a"].alias("a"), x["b"].alias("b"), T.tokens(T.clean_timed(p)).alias("t")))

    def spread(c: Column) -> Column:
        long = F.greatest(F.lit(0.01), c["b"] - c["a"])
        n = F.size(c["t"])
        return F.transform(c["t"], lambda t, i: F.struct(t.alias("text"), (c["a"] + long * i / n).alias("start"), (c["a"] + long * (i + 1) / n).alias("end"), c["a"].alias("first_seen_at")))

    return cues.withColumn("words", F.flatten(F.transform(chunks, spread)))


def word_events(cues: DataFrame, keys: list[str] = KEYS, fuzzy: bool = True) -> DataFrame:
    """(keys, cue_id, n, text, start, end): the words of `cues` (with `words`) that are new, numbered in a cue.

    The increment's words are matched with the cue's timed words: the first run of equal keys, else the last so many, else all.
    """
    inc = (fuzzy_increment if fuzzy else timed_increment)(cues, keys).where(F.trim("increment") != "")
    want = F.transform(T.tokens(F.col("increment")), T.token_key)
    have = F.transform("words", lambda x: T.token_key(x["text"]))
    df = inc.withColumns({"want": want, "have": have})
    n, m = F.size("want"), F.size("have")
    places = F.when(m >= n, F.sequence(F.lit(1), m - n + 1)).otherwise(F.array().cast("array<int>"))
    at = F.array_min(F.filter(places, lambda i: F.slice("have", i, n) == F.col("want")))
    took = F.when(at.isNotNull(), F.slice("words", at, n)).when(n <= m, F.slice("words", m - n + 1, n)).otherwise(F.col("words"))
    return df.select(*keys, "cue_id", F.posexplode(took).alias("n", "w")).select(*keys, "cue_id", "n", "w.*")


def cleaning_stats(cues: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """One row a track: input, empty, transition, exact and rolling cues, rolling units, and increments that are left."""
    full = T.clean_visible(F.col("text"))
    base = cues.withColumns({"e": full == "", "t": (F.col("end") - F.col("start")) < 0.05}).groupBy(*keys).agg(
        F.count("*").alias("input_cues"), F.count_if("e").alias("empty_removed"), F.count_if(~F.col("e") & F.col("t")).alias("transition_removed"))
    rolled = rolling_increment(cues, keys).groupBy(*keys).agg(
        F.count_if(F.col("delta") == "").alias("without_increment"), F.count_if(F.col("removed") > 0).alias("rolling_cues_reduced"), F.sum("removed").alias("rolling_units_removed"))
    return base.join(rolled, keys, "left").fillna(0, ["without_increment", "rolling_cues_reduced", "rolling_units_removed"])


# Timelines


def split_long(cues: DataFrame, keys: list[str] = KEYS, most: float = 7.0) -> DataFrame:
    """Cues over `most` seconds in as many equal parts as it takes, words (or signs, if there are fewer words than parts) dealt evenly; parts without text go. cue_id is renumbered."""
    long = F.greatest(F.lit(0.05), F.col("end") - F.col("start"))
    df = cues.withColumns({"__long": long, "__k": F.greatest(F.ceil(long / most).cast("int"), F.lit(1)), "__t": T.tokens(F.col("text"))})
    df = df.withColumn("__i", F.explode(F.sequence(F.lit(0), F.col("__k") - 1)))
    bound = lambda i, n: F.bround(i * n / F.col("__k")).cast("int")
    words, signs = F.size("__t"), F.length("text")
    a, b = bound(F.col("__i"), words), bound(F.col("__i") + 1, words)
    c, d = bound(F.col("__i"), signs), bound(F.col("__i") + 1, signs)
    part = F.when(words >= F.col("__k"), T.smart_join(F.slice("__t", a + 1, b - a))).otherwise(F.trim(F.substring("text", c + 1, d - c)))
    one = F.col("__k") == 1
    at = lambda i: F.col("start") + F.col("__long") * i / F.col("__k")
    df = df.withColumns({"__text": F.when(one, F.col("text")).otherwise(part), "__s": F.when(one, F.col("start")).otherwise(at(F.col("__i"))), "__e": F.when(one, F.col("end")).otherwise(at(F.col("__i") + 1))})
    df = df.where(one | (F.col("__text") != "")).withColumn("cue_id", F.row_number().over(W.partitionBy(*keys).orderBy("start", "end", "cue_id", "__i")))
    return df.select(*keys, "cue_id", F.col("__s").alias("start"), F.col("__e").alias("end"), F.col("__text").alias("text"))


def fix_timeline(cues: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Cues ordered, split and pushed apart: each starts at the end of the one before or later and lasts 0.05 s or more; those under one second then grow to one second or the next start.

    The pushed end is a running maximum: end_i = 0.05 i + max over j <= i of (max(end_j, start_j + 0.05) - 0.05 j).
    """
    df = split_long(cues, keys).withColumn("start", F.greatest("start", F.lit(0.0)))
    w = W.partitionBy(*keys).orderBy("cue_id")
    i = F.col("cue_id") * 0.05
    pushed = F.max(F.greatest(F.col("end"), F.col("start") + 0.05) - i).over(w.rowsBetween(W.unboundedPreceding, W.currentRow)) + i
    df = df.withColumn("__e", pushed).withColumn("start", F.greatest(F.col("start"), F.coalesce(F.lag("__e").over(w), F.lit(0.0))))
    nxt = F.coalesce(F.lead("start").over(w), F.col("start") + 1.0)
    grown = F.when(F.col("__e") - F.col("start") >= 1.0, F.col("__e")).otherwise(F.greatest(F.col("__e"), F.least(F.col("start") + 1.0, nxt)))
    return df.withColumn("end", grown).drop("__e")


# Batches and samples


def translation_batches(cues: DataFrame, keys: list[str] = KEYS, size: int = 24) -> DataFrame:
    """Cues with `row` and `batch`, both from 1."""
    row = F.row_number().over(_order(keys))
    return cues.withColumn("row", row).withColumn("batch", (F.floor((F.col("row") - 1) / size) + 1).cast("int"))


def batch_context(batched: DataFrame, keys: list[str] = KEYS, before: int = 3, after: int = 2) -> DataFrame:
    """One row a batch: its cues, the `before` cues ahead of it and the `after` behind it, as arrays of (cue_id, text)."""
    w = W.partitionBy(*keys).orderBy("row")
    item = F.struct("cue_id", "text")
    df = batched.withColumns({"__b": F.collect_list(item).over(w.rowsBetween(-before, -1)), "__a": F.collect_list(item).over(w.rowsBetween(1, after)), "__item": item})
    return df.groupBy(*keys, "batch").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("row", "__item"))), lambda x: x["__item"]).alias("cues"), F.min_by("__b", "row").alias("context_before"), F.max_by("__a", "row").alias("context_after"))


def prompt_payloads(batched: DataFrame, metadata: DataFrame | None = None, keys: list[str] = KEYS) -> DataFrame:
    """(keys, batch, payload): the JSON that a translation request for each batch would carry. No request is made. `metadata` is (keys, title, channel, ...)."""
    ctx = batch_context(batched, keys)
    fields = [F.col("context_before"), F.col("cues").alias("segments"), F.col("context_after")]
    if metadata is not None:
        rest = [c for c in metadata.columns if c not in keys]
        ctx = ctx.join(metadata.select(*keys, F.struct(*rest).alias("metadata")), keys, "left")
        fields.append(F.col("metadata"))
    return ctx.select(*keys, "batch", F.to_json(F.struct(*fields)).alias("payload"))


def subtitle_sample(cues: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Up to 30 cues a track: all of a short one, else the first 12, 8 around the middle and the last 10; start to two places, text to 300 signs."""
    w = _order(keys)
    df = cues.withColumns({"__r": F.row_number().over(w), "__n": F.count("*").over(W.partitionBy(*keys))})
    middle = F.floor(F.col("__n") / 2)
    keep = (F.col("__n") <= 30) | (F.col("__r") <= 12) | (F.col("__r") > F.col("__n") - 10) | ((F.col("__r") > middle - 4) & (F.col("__r") <= middle + 4))
    return df.where(keep).select(*keys, F.col("cue_id").alias("id"), F.round("start", 2).alias("start"), F.substring("text", 1, 300).alias("text"))
