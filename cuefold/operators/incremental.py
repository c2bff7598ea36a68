"""Runs that work out again what has changed alone: fingerprints of inputs, and results in parts that are overwritten one by one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuefold.operators.ranks import drop_staged, same, staged


def fingerprints(inputs: DataFrame, keys: list[str], version: str) -> DataFrame:
    """(keys, fingerprint) of all rows of a key, in any order, and of the version of the rules. Sums of hashes, so that rows meet as numbers, not as lists."""
    row = F.struct(*inputs.columns)
    total = lambda salt: F.sum(F.xxhash64(F.lit(salt), row).cast("decimal(20,0)")).cast("string")
    return inputs.groupBy(*keys).agg(F.concat_ws(":", F.lit(version), F.count("*"), total(1), total(2)).alias("fingerprint"))


def _stored(like: DataFrame, path: str) -> DataFrame:
    """The table at `path`, or an empty one of the columns of `like` and `part`."""
    spark = like.sparkSession
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    schema = like.withColumn("part", F.lit(0)).schema
    if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.read.schema(schema).parquet(path)
    return spark.createDataFrame([], schema)


def _replace(rows: DataFrame, path: str, touched: list[int]) -> None:
    """Writes rows (with `part`) in place of the touched parts; a part that has no rows left goes."""
    spark = rows.sparkSession
    own = staged(rows, "parts")
    own.repartition("part").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(path)
    left = {r["part"] for r in own.select("part").distinct().collect()}  # at most as many as there are parts
    for part in set(touched) - left:
        at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/part={part}")
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    drop_staged(own)


def run(inputs: DataFrame, keys: list[str], path: str, compute: Callable[[DataFrame], DataFrame], version: str = "1", parts: int = 256) -> DataFrame:
    """(keys, action) of a run over `inputs`: `computed` for keys whose rows, or whose version, are not those of the last run, `removed` for keys that are gone, else `reused`.

    `compute` gets the rows of changed keys and gives results with the same keys; `path`/results holds them by `part`, a hash of the keys, and
    `path`/fingerprints what they were made from. Only parts with a change are read and written. Results come before fingerprints, so a
    run that breaks off is made again for the same keys. `parts` must not change for a path; one run at a time.
    """
    part = F.pmod(F.xxhash64(*keys), F.lit(parts)).cast("int").alias("part")
    now = staged(fingerprints(inputs, keys, version).select("*", part), "fingerprints")
    before = _stored(now.drop("part"), f"{path}/fingerprints")
    match = lambda how, left, right, names: left.alias("l").join(right.alias("r"), same("l", "r", names), how)
    changed = match("left_anti", now, before, [*keys, "fingerprint"])
    removed = match("left_anti", before, now, keys)
    action = staged(
        changed.select(*keys, "part", F.lit("computed").alias("action")).unionByName(removed.select(*keys, "part", F.lit("removed").alias("action"))), "changes"
    )
    touched = [r["part"] for r in action.select("part").distinct().collect()]  # at most `parts`
    if touched:
        computed = action.where("action = 'computed'")
        results = compute(match("left_semi", inputs, computed, keys)).withColumn("part", part)
        stored = _stored(results.drop("part"), f"{path}/results").where(F.col("part").isin(touched))
        _replace(match("left_anti", stored, action, keys).unionByName(results), f"{path}/results", touched)
        old = match("left_anti", before.where(F.col("part").isin(touched)), action, keys)
        _replace(old.unionByName(match("left_semi", now, computed, keys)), f"{path}/fingerprints", touched)
    reused = match("left_anti", now, action, keys).select(*keys, F.lit("reused").alias("action"))
    return action.select(*keys, "action").unionByName(reused)


def results(spark, path: str) -> DataFrame:
    """What the runs at `path` have worked out so far."""
    return spark.read.parquet(f"{path}/results").drop("part")
