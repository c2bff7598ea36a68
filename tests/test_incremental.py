from pathlib import Path

from pyspark.sql import functions as F

from cuefold.operators import incremental


def files(path, table):
    return {str(p) for p in Path(path, table).rglob("*.parquet")}


def test_only_what_changed_runs_again(spark, tmp_path):
    path, seen = str(tmp_path), []

    def compute(df):
        seen.append(sorted(r["video_id"] for r in df.select("video_id").distinct().collect()))
        return df.groupBy("video_id").agg(F.count("*").alias("cues"), F.concat_ws("|", F.sort_array(F.collect_list("text"))).alias("texts"))

    def step(rows, version="1"):
        told = incremental.run(spark.createDataFrame(rows, "video_id string, cue_id int, text string"), ["video_id"], path, compute, version, parts=8)
        return {r["video_id"]: r["action"] for r in told.collect()}, {r["video_id"]: (r["cues"], r["texts"]) for r in incremental.results(spark, path).collect()}

    rows = [(f"v{k}", i, f"t{k}{i}") for k in range(20) for i in range(3)]
    actions, found = step(rows)
    assert set(actions.values()) == {"computed"} and len(found) == 20 and len(seen[0]) == 20
    actions, again = step(list(reversed(rows)))  # another order is no change
    assert set(actions.values()) == {"reused"} and again == found and len(seen) == 1
    before = files(path, "results"), files(path, "fingerprints")
    changed = [(v, i, "new" if (v, i) == ("v7", 1) else t) for v, i, t in rows]
    actions, found = step(changed)
    assert actions == {f"v{k}": "computed" if k == 7 else "reused" for k in range(20)} and seen[-1] == ["v7"] and found["v7"] == (3, "new|t70|t72")
    for old, table in zip(before, ("results", "fingerprints"), strict=True):
        parts = lambda names: {Path(n).parent.name for n in names}
        assert len(parts(files(path, table) - old)) == 1 and len(parts(old - files(path, table))) == 1  # one part written anew, the others as they were
    actions, found = step([r for r in changed if r[0] not in ("v3", "v4")])  # rows gone, whole keys gone
    assert actions["v3"] == actions["v4"] == "removed" and len(found) == 18 and "v3" not in found
    actions, found = step([("v1", 0, "x")])
    assert list(found) == ["v1"] and found["v1"] == (1, "x")
    actions, _ = step([("v1", 0, "x")], "2")  # other rules
    assert actions == {"v1": "computed"}


def test_repeated_rows_and_nulls_count(spark):
    rows = [("a", None), ("a", "x"), ("b", "x"), ("b", "x"), ("c", "x"), (None, "x")]
    prints = {r["k"]: r["fingerprint"] for r in incremental.fingerprints(spark.createDataFrame(rows, "k string, t string"), ["k"], "1").collect()}
    assert len(set(prints.values())) == 4
