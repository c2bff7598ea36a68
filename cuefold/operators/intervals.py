"""Intervals by key: union, intersection, uncovered gaps and the overlap join. All are windows and equi-joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _started(rows: DataFrame, keys: list[str], stretch: float) -> DataFrame:
    """rows with `stretch` and `no`: how many islands of the union have begun in the row's stretch of time up to it; 0 goes on from a stretch before.

    A row begins an island if it starts after the ends of all rows before it. Those in its own stretch are a window there; of the stretches before
    one row each is known, its last end.
    """
    own = [*keys, "stretch"]
    rows = rows.withColumn("stretch", F.floor(F.col("start") / stretch).cast("bigint"))
    ends = rows.groupBy(*own).agg(F.max("end").alias("last_end"))
    carried = ends.select(*own, F.max("last_end").over(W.partitionBy(*keys).orderBy("stretch").rowsBetween(W.unboundedPreceding, -1)).alias("carried"))
    order = W.partitionBy(*own).orderBy("start", "end")
    before = F.greatest(F.max("end").over(order.rowsBetween(W.unboundedPreceding, -1)), "carried")
    found = rows.join(carried, own).withColumn("before", before)
    begins = F.when(F.col("before").isNull() | (F.col("start") > F.col("before")), 1).otherwise(0)
    return found.withColumn("no", F.sum(begins).over(order))


def union(rows: DataFrame, keys: list[str], stretch: float | None = None) -> DataFrame:
    """(keys, start, end): the union of each key's intervals, touching ones joined; starts below 0 count as 0, empty intervals go.

    By itself a key is one window. With `stretch` (seconds) no task holds more of a key than what starts in one stretch of that length, and one or
    two rows for each of its stretches: islands are found within stretches, and those that a stretch carries on are joined to the last one
    before by the seams alone.
    """
    rows = rows.where(F.col("end") > F.col("start")).select(*keys, F.greatest("start", F.lit(0.0)).alias("start"), F.greatest("end", F.lit(0.0)).alias("end"))
    if stretch is None:
        order = W.partitionBy(*keys).orderBy("start", "end")
        before = F.max("end").over(order.rowsBetween(W.unboundedPreceding, -1))
        island = F.sum(F.when(before.isNull() | (F.col("start") > F.col("before")), 1).otherwise(0)).over(order)
        return rows.withColumn("before", before).withColumn("island", island).groupBy(*keys, "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")
    own = [*keys, "stretch"]
    local = _started(rows, keys, stretch).groupBy(*own, "no").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    local = local.withColumn("last", F.max("no").over(W.partitionBy(*own)) == F.col("no"))
    # at most two rows a stretch: what goes on from before, and the last island
    seams = local.where("no = 0 OR last")
    begun = F.last(F.when(F.col("no") > 0, F.col("start")), ignorenulls=True)
    seams = seams.withColumn("island", begun.over(W.partitionBy(*keys).orderBy("stretch", "no").rowsBetween(W.unboundedPreceding, W.currentRow)))
    joined = seams.groupBy(*keys, "island").agg(F.max("end").alias("end")).select(*keys, F.col("island").alias("start"), "end")
    return local.where("no > 0 AND NOT last").select(*keys, "start", "end").unionByName(joined)


def length(rows: DataFrame, keys: list[str], name: str = "seconds", stretch: float | None = None) -> DataFrame:
    """(keys, seconds) of the union."""
    return union(rows, keys, stretch).groupBy(*keys).agg(F.sum(F.col("end") - F.col("start")).alias(name))


def overlap_join(left: DataFrame, right: DataFrame, keys: list[str], bucket: float | None = 60.0) -> DataFrame:
    """Pairs of rows of one key with min(end) > max(start): the keys, left columns, right columns with the prefix `r_`.

    With a bucket each row stands in every stretch of that many seconds that it touches, and a pair is made in the first stretch both
    touch alone: a long track is dealt out over its stretches, and no pair comes twice.
    """
    right = right.select(*keys, *[F.col(c).alias(f"r_{c}") for c in right.columns if c not in keys])
    cross = F.least("end", "r_end") > F.greatest("start", "r_start")
    if bucket is None:
        return left.join(right, keys).where(cross)
    spread = lambda a, b: F.explode(F.sequence(F.floor(F.col(a) / bucket).cast("bigint"), F.greatest(F.floor(F.col(a) / bucket), F.floor(F.col(b) / bucket)).cast("bigint")))
    left, right = left.withColumn("__b", spread("start", "end")), right.withColumn("__b", spread("r_start", "r_end"))
    first = F.floor(F.greatest("start", "r_start") / bucket).cast("bigint")
    return left.join(right, [*keys, "__b"]).where(cross & (F.col("__b") == first)).drop("__b")


def intersection_length(left: DataFrame, right: DataFrame, keys: list[str], bucket: float | None = 60.0, stretch: float | None = None) -> DataFrame:
    """(keys, seconds) that the unions of both tables have in common; keys without any are left out."""
    pairs = overlap_join(union(left, keys, stretch), union(right, keys, stretch), keys, bucket)
    return pairs.groupBy(*keys).agg(F.sum(F.least("end", "r_end") - F.greatest("start", "r_start")).alias("seconds"))


def _after(islands: DataFrame, keys: list[str], stretch: float | None) -> DataFrame:
    """Islands of a union with `previous`, the end of the one before."""
    if stretch is None:
        return islands.withColumn("previous", F.lag("end").over(W.partitionBy(*keys).orderBy("start")))
    own = [*keys, "stretch"]
    rows = islands.withColumn("stretch", F.floor(F.col("start") / stretch).cast("bigint"))
    ends = rows.groupBy(*own).agg(F.max("end").alias("last_end"))
    carried = ends.select(*own, F.max("last_end").over(W.partitionBy(*keys).orderBy("stretch").rowsBetween(W.unboundedPreceding, -1)).alias("carried"))
    before = F.coalesce(F.lag("end").over(W.partitionBy(*own).orderBy("start")), "carried")
    return rows.join(carried, own).withColumn("previous", before).select(*keys, "start", "end", "previous")


def longest_gap(speech: DataFrame, cover: DataFrame, keys: list[str], bucket: float | None = 60.0, stretch: float | None = None) -> DataFrame:
    """(keys, seconds): the longest stretch of merged speech in which no merged cover lies; one row a key of speech.

    Such a stretch lies before a part of the cover, after the cover's part before it or the begin of the speech, or at the end of the speech: both are
    told of single rows and by maxima.
    """
    talk = union(speech, keys, stretch)
    over = _after(union(cover, keys, stretch), keys, stretch)
    start = F.greatest("start", "r_start")
    gap = start - F.greatest("start", F.coalesce("r_previous", "start"))
    parts = overlap_join(talk, over, keys, bucket).select(*keys, "start", "end", F.least("end", "r_end").alias("b"), gap.alias("gap"))
    alone = talk.select(*keys, "start", "end", F.col("start").alias("b"), F.lit(0.0).alias("gap"))
    by_talk = parts.unionByName(alone).groupBy(*keys, "start", "end").agg(F.max("b").alias("b"), F.max("gap").alias("gap"))
    return by_talk.groupBy(*keys).agg(F.max(F.greatest("gap", F.col("end") - F.col("b"), F.lit(0.0))).alias("seconds"))


def nearest(points: DataFrame, targets: DataFrame, keys: list[str]) -> DataFrame:
    """points (keys, at, ...) with the `target` (keys, at, target) of least distance, the smaller target first among equals: the neighbours before and after by time."""
    cols = [c for c in points.columns if c not in keys]
    both = points.select(*keys, F.struct(*cols).alias("p"), "at", F.lit(None).cast("struct<at:double,target:int>").alias("t"))
    marks = targets.groupBy(*keys, "at").agg(F.min("target").alias("target")).select(*keys, F.lit(None).cast(both.schema["p"].dataType).alias("p"), "at", F.struct("at", "target").alias("t"))
    order = W.partitionBy(*keys).orderBy("at")
    seen = both.unionByName(marks).withColumns({
        "before": F.last("t", ignorenulls=True).over(order.rangeBetween(W.unboundedPreceding, W.currentRow)),
        "after": F.first("t", ignorenulls=True).over(order.rangeBetween(W.currentRow, W.unboundedFollowing)),
    }).where("p is not null")
    off = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.abs(F.col(c)["at"] - F.col("at")).alias("off"), F.col(c)["target"].alias("target")))
    best = F.array_min(F.array_compact(F.array(off("before"), off("after"))))
    return seen.select(*keys, "p.*", best["target"].alias("target"))
