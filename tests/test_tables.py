"""Small cases of joins and helpers that no registered query covers."""

import pandas as pd
from pyspark.sql import functions as F

from cuefold.functions import logs, udfs
from cuefold.operators import tasks
from cuefold.sources import manifests
from cuefold.streaming import streams


def test_manifests_of_all_stages_join_by_task(spark):
    download = spark.createDataFrame([("a", "success"), ("b", "failed"), ("c", "success")], "task string, download_status string")
    third = spark.createDataFrame([("a", "QC_PASSED"), ("x", "QC_PASSED")], "task string, translation_status string")
    fourth = spark.createDataFrame([("a", "STAGE4_COMPLETED"), ("b", "FAILED")], "task string, stage4_status string")
    got = sorted(map(tuple, tasks.manifest_join(download, third, fourth).collect()), key=str)
    assert got == [("a", "success", "QC_PASSED", "STAGE4_COMPLETED"), ("b", "failed", None, "FAILED"), ("c", "success", None, None)]


def test_media_metadata_prefers_the_info_file(spark):
    made = spark.createDataFrame([("a", "old", "chan", "u"), ("b", "only", "chan", "v")], "task string, title string, channel string, url string")
    info = "task string, title string, channel string, uploader string, description string, categories array<string>, tags array<string>, duration double, webpage_url string, original_url string"
    infos = spark.createDataFrame([("a", "new", "", "up", "from info", ["Gaming", "x"], ["t"], 0.0, "", "o")], info)
    texts = spark.createDataFrame([("b", "from file")], "task string, description string")
    a, b = manifests.media_metadata(made, infos, texts).orderBy("task").collect()
    assert (a["title"], a["channel"], a["topic"], a["duration"], a["description"], a["tags"], a["source_url"]) == ("new", "up", "Gaming", None, "from info", ["t"], "o")
    assert (b["title"], b["channel"], b["topic"], b["description"], b["tags"], b["source_url"]) == ("only", "chan", "", "from file", [], "v")


def test_lists_of_videos_keep_each_once(spark):
    text = "aaaaaaaaaaa, https://youtu.be/bbbbbbbbbbb;aaaaaaaaaaa nonsense https://www.youtube.com/watch?v=aaaaaaaaaaa"
    row = spark.createDataFrame([(text,)], "t string").select(logs.video_ids(F.col("t")).alias("v")).select("v.*").first()
    assert row["ids"] == ["aaaaaaaaaaa", "bbbbbbbbbbb"] and row["rejected"] == ["nonsense"]


def test_a_detector_that_is_passed_in(spark):
    detect = udfs.detect_language(lambda text: "zh" if any("一" <= c <= "鿿" for c in text) else "en")
    rows = spark.createDataFrame(pd.DataFrame({"i": [0, 1, 2], "t": ["中文", "words", ""]}))
    assert [r[0] for r in rows.orderBy("i").select(detect(F.col("t"))).collect()] == ["zh", "en", "en"]
    assert {r[0] for r in rows.select(udfs.detect_language()(F.col("t"))).collect()} == {"unknown"}


def test_job_states_survive_a_fresh_checkpoint(spark, tmp_path):
    path, put = str(tmp_path / "states"), streams.upsert_states(str(tmp_path / "states"), buckets=1, deltas=1)
    batch = lambda *rows: spark.createDataFrame(rows, "id int, status string, updated_at int")
    for number, rows in enumerate([[(1, "running", 1)], [(1, "done", 2), (2, "queued", 2)], [(3, "running", 3)]]):
        put(batch(*rows), number)
    put(batch((2, "done", 9)), 0)  # a new checkpoint counts its batches from 0 again
    put(batch((2, "done", 9)), 0)
    assert {tuple(r) for r in streams.read_states(spark, path).collect()} == {(1, "done"), (2, "done"), (3, "queued")}
    assert len(list((tmp_path / "states").glob("v=*"))) <= 6  # the last base, the one before it, and the deltas since that one
    for number in range(12):
        put(batch((4, "queued", number)), number)
    assert len(list((tmp_path / "states").glob("v=*"))) <= 6  # they do not pile up
    assert len(list((tmp_path / "states/claims").iterdir())) <= 12
