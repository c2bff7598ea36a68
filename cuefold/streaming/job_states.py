"""The newest state of each job as a log of deltas in hash buckets, compacted bucket by bucket."""

from __future__ import annotations

import re
from collections import defaultdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PART = re.compile(r".*/v=(\d+)/kind=(delta|base)/bucket=(\d+)$")


class Log:
    """`path`/v=<number>/kind=<delta or base>/bucket=<number>. A bucket's rows are those of its newest base and of the deltas after it.

    A version counts once it was written to its end. Each writer takes a number of its own by making `path`/claims/<number>, which a file system
    does for one of two writers only; a number that was claimed by a writer that died stays unused.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.fs = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def _names(self, pattern: str) -> list[str]:
        return [f.getPath().toString() for f in self.fs.globStatus(self._at(pattern)) or []]

    def versions(self) -> list[int]:
        """The versions that are whole, ascending."""
        return sorted(int(n.split("/v=")[1].split("/")[0]) for n in self._names("v=*/_SUCCESS"))

    def claim(self) -> int:
        taken = [*self.versions(), *(int(n.rsplit("/", 1)[1]) for n in self._names("claims/*")), -1]
        number = max(taken) + 1
        while not self.fs.createNewFile(self._at(f"claims/{number}")):
            number += 1
        return number

    def parts(self) -> dict[int, tuple[int | None, list[int]]]:
        """For each bucket its newest base, if any, and the deltas after it."""
        whole, found = set(self.versions()), defaultdict(lambda: defaultdict(list))
        for name in self._names("v=*/kind=*/bucket=*"):
            version, kind, bucket = PART.match(name).groups()
            if int(version) in whole:
                found[int(bucket)][kind].append(int(version))
        out = {}
        for bucket, kinds in found.items():
            base = max(kinds["base"], default=None)
            out[bucket] = base, sorted(v for v in kinds["delta"] if base is None or v > base)
        return out

    def rows(self, buckets: dict[int, tuple[int | None, list[int]]], schema) -> DataFrame:
        """(id, status, updated_at, bucket) of the newest event of each job in some buckets."""
        dirs = [f"{self.path}/v={v}/kind={kind}/bucket={b}" for b, (base, deltas) in buckets.items() for kind, v in [("base", base)] * (base is not None) + [("delta", v) for v in deltas]]
        read = self.spark.read.schema(schema).option("basePath", self.path)
        rows = read.parquet(*dirs) if dirs else self.spark.createDataFrame([], schema)
        return newest(rows, "bucket") if dirs else rows.withColumn("bucket", F.lit(0))

    def write(self, rows: DataFrame, kind: str) -> int:
        number = self.claim()
        rows.withColumn("kind", F.lit(kind)).write.mode("errorifexists").partitionBy("kind", "bucket").parquet(f"{self.path}/v={number}")
        return number

    def drop(self, buckets: dict[int, tuple[int | None, list[int]]]) -> None:
        """Deletes what the bases of some buckets have replaced, and the claims and versions that nothing is left of."""
        for name in self._names("v=*/kind=*/bucket=*"):
            version, _, bucket = PART.match(name).groups()
            base = buckets.get(int(bucket), (None,))[0]
            if base is not None and int(version) < base:
                self.fs.delete(self._at(name.removeprefix(f"{self.path}/") if name.startswith(self.path) else name.split(f"{self._at('').getName()}/", 1)[1]), True)
        last = max(self.versions(), default=-1)
        full = {n.split("/v=")[1].split("/")[0] for n in self._names("v=*/kind=*/bucket=*")}
        for name in self._names("claims/*") + self._names("v=*"):
            number = name.rsplit("/", 1)[1].removeprefix("v=")
            if int(number) < last and ("/claims/" in name or number not in full and int(number) in set(self.versions())):
                self.fs.delete(self.spark._jvm.org.apache.hadoop.fs.Path(name), True)


def newest(rows: DataFrame, *more: str) -> DataFrame:
    """The newest event of each id; of events of one time the one of the last status by name."""
    best = F.max(F.struct("updated_at", "status")).alias("best")
    return rows.groupBy("id", *more).agg(best).select("id", "best.status", "best.updated_at", *more)


def upsert(path: str, buckets: int = 64, deltas: int = 8):
    """A foreachBatch function that keeps (id, status, updated_at) of the newest event of each job in `path`.

    A batch adds its own newest rows to their buckets, whatever the size of the rest. A bucket with more than `deltas` deltas is rewritten
    as one base; what was there before the base before it goes, so that readers of the state before are not cut off. A batch that
    comes twice, under any checkpoint, changes nothing: the newest event of a job stays the same. `buckets` must not change for a path.
    """

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        log = Log(spark, path)
        rows = newest(batch.select("id", "status", "updated_at")).withColumn("bucket", F.pmod(F.xxhash64("id"), F.lit(buckets)).cast("int"))
        if rows.isEmpty():
            return
        log.write(rows.repartition("bucket"), "delta")
        before = log.parts()
        long = {b: x for b, x in before.items() if len(x[1]) > deltas}
        if long:
            log.write(log.rows(long, batch.select("id", "status", "updated_at").schema).repartition("bucket"), "base")
            log.drop(before)

    return run


def read(spark: SparkSession, path: str) -> DataFrame:
    """(id, status) of the newest event of each job; an interrupted `running` counts as queued."""
    log = Log(spark, path)
    parts = log.parts()
    first = next(iter(parts.items()))
    base, deltas = first[1]
    kind, version = ("base", base) if base is not None else ("delta", deltas[0])
    schema = spark.read.parquet(f"{log.path}/v={version}/kind={kind}/bucket={first[0]}").schema
    rows = log.rows(parts, schema)
    return rows.select("id", F.when(F.col("status") == "running", "queued").otherwise(F.col("status")).alias("status"))
