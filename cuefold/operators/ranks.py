"""Staged tables, and row numbers over a whole table without one task that sorts it."""

from __future__ import annotations

import re
import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def new_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder of spark.checkpoint.dir; a temporary folder stands in where that is unset, in local mode alone."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        if not re.fullmatch(r"local(\[[^-]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        where = f"file://{tempfile.mkdtemp(prefix='cuefold-')}"
        spark.conf.set("spark.checkpoint.dir", where)
    return f"{where.rstrip('/')}/cuefold/{name}-{uuid.uuid4().hex}"


def staged(df: DataFrame, name: str) -> DataFrame:
    """`df` written to the shared folder and read again."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def drop_staged(*tables: DataFrame) -> None:
    """Deletes the tables behind what `staged` returned, once nothing reads them any more."""
    for df in tables:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._staged_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def same(left: str, right: str, names: list[str]) -> Column:
    """Equality of two aliases' columns, null like null; true without any."""
    return reduce(lambda a, b: a & b, [F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}")) for c in names], F.lit(True))


def numbered(df: DataFrame, name: str, order: list[str | Column]) -> DataFrame:
    """`df` with the long column `name`, 1 for the first row by `order`: range partitions are sorted, and only their row counts are summed up."""
    dealt = df.repartitionByRange(*order).sortWithinPartitions(*order)
    dealt = staged(dealt.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))), "ordered")
    sizes = dealt.groupBy("_part").count().agg(F.array_sort(F.collect_list(F.struct("_part", "count"))).alias("all"))  # a row a partition
    before = F.expr("transform(all, (x, i) -> struct(x._part AS _part, aggregate(slice(all, 1, i), 0L, (s, y) -> s + y.count) AS _before))")
    offsets = sizes.select(F.explode(before).alias("p")).select("p.*")
    return dealt.join(F.broadcast(offsets), "_part").withColumn(name, F.col("_before") + F.col("_at") + 1).drop("_part", "_at", "_before")


def numbered_within(df: DataFrame, name: str, within: list[str], order: list[str | Column]) -> DataFrame:
    """`df` with the integer column `name`, 1 for the first row of each group of `within` by `order`.

    Rows are dealt out by range of group and order, so a group of any size is spread over as many partitions as its rows need; what a
    group has in the partitions before is summed up from counts, one for each partition and group in it.
    """
    dealt = staged(df.repartitionByRange(*within, *order).withColumn("_part", F.spark_partition_id()), "ordered")
    local = dealt.withColumn("_at", F.row_number().over(W.partitionBy("_part", *within).orderBy(*order)))
    sizes = dealt.groupBy("_part", *within).count()
    before = F.sum("count").over(W.partitionBy(*within).orderBy("_part").rowsBetween(W.unboundedPreceding, -1))
    offsets = sizes.withColumn("_before", F.coalesce(before, F.lit(0)))
    both = local.alias("l").join(offsets.alias("r"), (F.col("l._part") == F.col("r._part")) & same("l", "r", within))
    return both.select(*[F.col(f"l.`{c}`") for c in df.columns], (F.col("l._at") + F.col("r._before")).cast("int").alias(name))
