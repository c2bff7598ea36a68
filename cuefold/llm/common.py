"""What the operators of this subpackage share: staged tables and text basics."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Inner columns start so, so that no column of a caller's table clashes with them.
OWN = "__cf_"
#: Tables below this many rows, of a few dozen bytes each, may be broadcast once they have been counted.
BROADCAST_ROWS = 200_000


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which driver and executors share. A temporary one stands in where it is unset, in local mode alone."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.fullmatch(r"local(\[[^-]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        found = f"file://{tempfile.mkdtemp(prefix='cuefold-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/cuefold/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """`df` written as a Parquet table in the shared folder and read again: lineage ends there and a lost executor costs nothing."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def drop_staged(df: DataFrame) -> None:
    """Deletes the table behind what `staged` returned, once nothing reads it any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._staged_at)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_or_empty(text: str = "text"):
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def small(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """`df` marked for broadcast if it has been counted and is below `limit` rows; else as it is, for a shuffled join."""
    return F.broadcast(df) if df.count() <= limit else df


def least_hashed(df: DataFrame, key: str, most: int) -> DataFrame:
    """At most `most` rows of `df`, those whose xxhash64 of `key` is least. Only hashes below a bound that some more rows than that stay below are
    sorted, so that the task which takes the first ones reads as many rows at any size."""
    n = max(1, df.count())
    below = -(2**63) + min(2**64 - 1, int(2**64 * (2 * most + 1_000) / n))
    h = F.xxhash64(key)
    return df.where(h <= F.lit(below)).orderBy(h, key).limit(most)


def salted_join(rows: DataFrame, one: DataFrame, key: str, salt: Column, heavy: int = 20_000) -> DataFrame:
    """`rows` left-joined by `key` with `one`, a table of one row for each key, so that no key's rows all meet in one task.

    A key with more than a `heavy`th of all rows is dealt out over parts of that many rows, and its row of `one` goes to each part. There
    are fewer than `heavy` such keys, whose list is broadcast, and fewer than 2 * `heavy` such copies, whatever the input.
    """
    most = max(1, -(-rows.count() // heavy))
    large = rows.groupBy(key).count().where(F.col("count") > most).select(F.col(key).alias(f"{OWN}key"), F.ceil(F.col("count") / most).cast("int").alias(f"{OWN}parts"))
    large = F.broadcast(staged(large, "heavy"))
    parts, part = F.coalesce(F.col(f"{OWN}parts"), F.lit(1)), f"{OWN}part"
    left = rows.join(large, F.col(key) == F.col(f"{OWN}key"), "left").withColumn(part, F.pmod(F.xxhash64(salt), parts).cast("int"))
    right = one.join(large, F.col(key) == F.col(f"{OWN}key"), "left").withColumn(part, F.explode(F.sequence(F.lit(0), parts - 1)))
    own = [f"{OWN}key", f"{OWN}parts"]
    return left.drop(*own).join(right.drop(*own), [key, part], "left").drop(part)
