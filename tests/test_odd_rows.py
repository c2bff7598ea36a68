"""Queries on small tables with odd rows, against their SQL in DuckDB."""

import random
import re
import time
from collections import Counter
from datetime import datetime

import duckdb
from pyspark.sql import functions as F

import __spark_entry__ as entry
from cuefold.functions import times
from cuefold.functions import translation as R
from cuefold.operators import clustering, folds, near_titles

from .test_queries import plain

ORDERS = "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, o_orderpriority string"
CONVERSATIONS = "conv_id long, turn long, role string, text string"


def agrees(spark, folder, name, **tables):
    """The rows of a query over the tables, which are those of its SQL."""
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{folder}/{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet/*.parquet')")
    df = entry.queries()[name](spark, str(folder))
    cols = sorted(df.columns)
    found = con.execute(entry.oracle_sql()[name])
    place = [[d[0] for d in found.description].index(c) for c in cols]
    got = sorted(repr(tuple(plain(r[c]) for c in cols)) for r in df.collect())
    assert got == sorted(repr(tuple(plain(r[i]) for i in place)) for r in found.fetchall())
    return got


def turns(*texts):
    return [(v, 0, "user", t) for v, t in enumerate(texts)], CONVERSATIONS


def test_negation_before_a_letter_beyond_ascii(spark, tmp_path):
    got = agrees(spark, tmp_path, "translation_flags", conversations=turns(*["adoja no\u00edtaga ment"] * 12, *["un ano tago", "\u00e9not x", "no\u00e9"] * 4))
    assert any("NEGATION_MISMATCH" in r for r in got[:12])
    flags = lambda s, **k: spark.range(1).select(R.negation_mismatch(F.lit(s), F.lit("x"), **k)).first()[0]
    assert not flags("no\u00ed") and flags("no\u00ed", negation=R.NEGATION_ASCII) and flags("No, no") and not flags("nota", negation=R.NEGATION_ASCII)


def test_negations_counted_as_in_sql(spark, tmp_path):
    got = agrees(spark, tmp_path, "flag_histogram", conversations=turns(*["adoja noítaga ment"] * 12))
    assert any("NEGATION_MISMATCH" in r for r in got)


def test_hours_of_three_digits(spark, tmp_path):
    keys = [0, 1, 2_879_999, 2_880_000, 2_880_001, 8_999_999]  # the eighths of the later ones pass 100 hours
    agrees(spark, tmp_path, "time_helpers", orders=([(k, k % 77, "O", 1234.5 + k % 9, datetime(2024, 1, 1), "1") for k in keys], ORDERS))
    back = lambda t: spark.range(1).select(times.parse_timestamp(F.lit(t))).first()[0]
    assert (back("100:00:00,125"), back("1:02:03.004"), back("02:03.004"), back(":02:03.004")) == (360000.125, 3723.004, 123.004, None)


def test_tags_and_cuts_of_texts_with_many_tags(spark, tmp_path):
    """Against plain Python; a text of 100,000 tags took squares of their number, and cuts parted whole texts."""
    texts = ["a, b", "abé" * 30, "\U0001f600" * 60, "x " * 40, "", ",".join(f"t{k % 70_000}" for k in range(100_000)), "A,a,B,b;#c、C"]
    spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    began = time.monotonic()
    rows = {r["doc_id"]: r for r in entry.queries()["tags_and_cuts"](spark, str(tmp_path)).collect()}
    assert time.monotonic() - began < 60

    def tags(text):
        own = ["中英双语", "中文翻译"] + [t.strip(" ").lstrip("#").strip() for t in re.split(r"[,，、;\n]+", "#One,one、 two en;" + text)]
        own = [t[:20].rstrip(" ") for t in own if t]
        return ",".join([t for i, t in enumerate(own) if t.lower() not in [x.lower() for x in own[:i]]][:10]) if len(own) < 1_000 else tags(",".join(text.split(",")[:20]))

    def cut(text, size, most=50):
        if size(text) <= most:
            return text
        kept = next(n for n in range(len(text), -1, -1) if size(text[:n]) <= most - size("…"))
        return text[:kept].rstrip(" ") + "…"

    for i, t in enumerate(texts):
        assert (rows[i]["tags"], rows[i]["cut16"], rows[i]["cut8"]) == (tags(t), cut(t, lambda x: len(x.encode("utf-16-le")) // 2), cut(t, lambda x: len(x.encode())))


def test_folds_read_many_short_tracks_as_one_stream(spark):
    """Tracks that go on over several batches, in tasks that start no group a track."""
    rows = [(v, i, i * 1.0, i + 0.9, "ab"[(i // (1 + v % 3)) % 2] + "x") for v in range(40) for i in range(v % 9 + 1)]
    cues = spark.createDataFrame(rows, "video_id long, cue_id int, start double, end double, text string").repartition(4, "start")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        told = folds.merge_fragments(cues, ["video_id"])
        got = {(r["video_id"], r["cue_id"]): (r["start"], r["end"], r["text"]) for r in told.collect()}
        assert "InPandas" not in told._jdf.queryExecution().toString()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {}
    for v in range(40):
        own = []
        for _, i, start, end, text in (r for r in rows if r[0] == v):
            if own and end - own[-1][0] <= 7.0:
                own[-1] = (own[-1][0], end, own[-1][2] if own[-1][2].split()[-1] == text else f"{own[-1][2]} {text}")
            else:
                own.append((start, end, text))
        want |= {(v, k): x for k, x in enumerate(own, 1)}
    assert got == want


def test_pairs_of_token_sets_come_out_once(spark):
    """Against all pairs; before, a pair came out once for each rare token in common and was told apart by its texts."""
    rng = random.Random(5)
    keys = sorted({" ".join(sorted(rng.sample("aa bb cc dd ee ff gg hh ii jj".split(), rng.randint(1, 7)))) for _ in range(120)})
    found = clustering._jaccard_pairs(spark.createDataFrame([(k,) for k in keys], "key string"), 0.65, []).select("a", "b").collect()
    share = lambda a, b: len({*a.split()} & {*b.split()}) / len({*a.split()} | {*b.split()})
    assert sorted(map(tuple, found)) == [(a, b) for a in keys for b in keys if a < b and share(a, b) >= 0.65]


def test_bound_of_common_letters(spark):
    for extra in ([], ["x" * 300, "x" * 290 + "y"]):  # sums over 255 too
        own = near_titles.Titles(["abc def", "abd def", "zzz", "a" * 120, "a" * 100 + "b", *extra])
        i, j = near_titles.by_letters(own, own, 0.78)
        common = lambda a, b: sum((Counter(a) & Counter(b)).values())
        want = {(p, q) for p, a in enumerate(own.keys) for q, b in enumerate(own.keys) if common(a, b) >= (len(a) + len(b)) * 0.39 - 1e-9}
        assert set(zip(i.tolist(), j.tolist(), strict=True)) == want


def test_scores_written_like_ties(spark, tmp_path):
    """7 views, 21 clicks and 17 sign-ups give an engagement of 64.9305, which is less than that as a double."""
    kinds = ["view"] * 7 + ["click"] * 21 + ["signup"] * 17
    events = [(i, datetime(2024, 1, 1, 0, i), i % 5, kind, 1.0, "{}") for i, kind in enumerate(kinds)]
    got = agrees(
        spark, tmp_path, "candidate_scores", documents=([(0, "the and of the in that is on to it", "en", "src1", 200)], "doc_id long, text string, lang string, source string, n_chars long"),
        events=(events, "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"),
    )
    assert "64.93," in got[0]
