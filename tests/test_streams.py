import random

import pytest
from pyspark.sql import functions as F

from cuefold.streaming import job_states, requests

ANSWERS = "query_group string, mode string, day string, attempt string, status string, video_id string, rank int, query_text string, ts string"


def answer(group, mode, day, attempt, hour, videos, status="ok", ranks=None):
    return [(group, mode, day, attempt, status, v, k, "q", f"{day} {hour:02d}:00:00") for k, v in zip(ranks or range(1, len(videos) + 1), videos, strict=True)]


@pytest.fixture
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", requests.STATE_STORE)
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def test_requests_are_answered_once(spark, rocks, tmp_path):
    """Restarts in mid-day, attempts sent again, quota stops, days that overlap, and rows that come days after."""
    schema = spark.createDataFrame([], ANSWERS).schema
    found = []

    def step(number, rows):
        spark.createDataFrame(rows, ANSWERS).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        stream = spark.readStream.schema(schema).json(str(tmp_path / "in")).withColumn("ts", F.to_timestamp("ts"))
        out = requests.resumable(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check"))
        out.trigger(availableNow=True).start().awaitTermination()  # each step is a start of its own
        now = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()), key=str)
        new = list(now)
        for x in found:
            new.remove(x)
        found[:] = now
        return sorted((r[0], r[1], r[2], r[3], r[4], r[5], r[6], r[8]) for r in new) if not any(r[5] is None for r in new) else sorted((str((r[0], r[1], r[2], r[3], r[4], r[5], r[6], r[8])) for r in new))

    hit = lambda g, m, d, a, v, k: (g, m, d, "hit", a, v, k, 1)
    d1, d2, d9 = "2026-03-01", "2026-03-02", "2026-03-09"
    assert step(1, answer("g1", "fresh", d1, "a", 1, ["x", "y"], ranks=[1, 3]) + answer("g2", "fresh", d1, "b", 2, ["z"], "quota")) == [hit("g1", "fresh", d1, "a", "x", 1), hit("g1", "fresh", d1, "a", "y", 3)]
    # the rest of the answer, one rank twice; the request that was stopped is made again; another attempt at what is done
    second = answer("g1", "fresh", d1, "a", 3, ["w", "y"], ranks=[2, 3]) + answer("g2", "fresh", d1, "c", 4, ["z"]) + answer("g1", "growth", d1, "e", 4, ["x"])
    assert step(2, second) == [hit("g1", "fresh", d1, "a", "w", 2), hit("g1", "growth", d1, "e", "x", 1), hit("g2", "fresh", d1, "c", "z", 1)]
    assert step(3, answer("g1", "fresh", d1, "again", 5, ["x", "new"]) + answer("g2", "fresh", d1, "c", 5, ["z"])) == [str(("g1", "fresh", d1, "resumed", "again", None, None, 1))]
    # the next day is a request of its own while the first is still open
    assert step(4, answer("g1", "fresh", d2, "f", 1, ["x"])) == [hit("g1", "fresh", d2, "f", "x", 1)]
    # a week later the first days are closed, and what comes for them again is passed over
    late = step(5, answer("g9", "fresh", d9, "h", 1, ["v"])) + step(6, answer("g9", "fresh", d9, "h", 2, ["v"]))
    closed = {x for x in late if "closed" in str(x)}
    assert {str(("g1", "fresh", d1, "closed", "a", None, None, 3)), str(("g1", "fresh", d2, "closed", "f", None, None, 1)), str(("g2", "fresh", d1, "closed", "c", None, None, 1))} <= closed and len(closed) == 4
    again = [(*r[:8], "2026-03-09 05:00:00") for r in answer("g1", "fresh", d1, "k", 5, ["x", "u"]) + answer("g1", "fresh", d2, "f", 5, ["x"])]
    assert step(7, again) == []
    hits = spark.read.parquet(str(tmp_path / "out")).where("kind = 'hit'")
    assert hits.count() == hits.select("query_group", "mode", "day", "rank").distinct().count() == 7


def batches(rng, n, jobs):
    return [[(rng.randrange(jobs), rng.choice(["queued", "running", "done", "failed"]), t * 10 + rng.randrange(10)) for _ in range(rng.randrange(1, 12))] for t in range(n)]


def test_states_against_the_newest_event(spark, tmp_path):
    rng, path = random.Random(3), str(tmp_path / "states")
    put = job_states.upsert(path, buckets=4, deltas=2)
    want = {}
    for k, rows in enumerate(batches(rng, 9, 30)):
        batch = spark.createDataFrame(rows, "id int, status string, updated_at int")
        put(batch, k)
        if k % 3 == 0:
            put(batch, k)  # a batch that comes again
        for i, status, at in rows:
            want[i] = max(want.get(i, (-1, "")), (at, status))
    got = {r["id"]: r["status"] for r in job_states.read(spark, path).collect()}
    assert got == {i: "queued" if s == "running" else s for i, (_, s) in want.items()}
    log = job_states.Log(spark, path)
    assert all(len(deltas) <= 3 for _, deltas in log.parts().values()) and any(base is not None for base, _ in log.parts().values())
    assert len(log._names("v=*/kind=*/bucket=*")) <= 4 * (2 + 2 * 3)  # what bases replaced goes


def test_a_batch_writes_its_buckets_alone(spark, tmp_path):
    path = str(tmp_path / "states")
    put = job_states.upsert(path, buckets=32)
    put(spark.range(5_000).selectExpr("cast(id AS int) AS id", "'queued' AS status", "1 AS updated_at"), 0)
    log = job_states.Log(spark, path)
    before = set(log._names("v=*/kind=*/bucket=*/*.parquet"))
    put(spark.range(10).selectExpr("cast(id AS int) AS id", "'done' AS status", "2 AS updated_at"), 1)
    new = set(log._names("v=*/kind=*/bucket=*/*.parquet")) - before
    assert before <= set(log._names("v=*/kind=*/bucket=*/*.parquet")) and len(new) <= 10
    assert spark.read.parquet(*new).count() == 10
    assert job_states.read(spark, path).groupBy("status").count().collect() and job_states.read(spark, path).where("status = 'done'").count() == 10


def test_writers_take_numbers_of_their_own(spark, tmp_path):
    path = str(tmp_path / "states")
    log = job_states.Log(spark, path)
    first, second = log.claim(), log.claim()  # a writer that died, and the next one
    assert (first, second) == (0, 1)
    job_states.upsert(path)(spark.createDataFrame([(1, "done", 1)], "id int, status string, updated_at int"), 0)
    assert log.versions() == [2] and [tuple(r) for r in job_states.read(spark, path).collect()] == [(1, "done")]
    (tmp_path / "states/v=7/kind=delta/bucket=0").mkdir(parents=True)  # not whole: nobody reads it
    assert log.versions() == [2]
