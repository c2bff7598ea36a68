"""Sharding by a Feistel permutation of global row numbers, in DataFrame functions only."""

from __future__ import annotations

from math import isqrt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuefold.llm.common import staged

ROUNDS = 6
PRIME = 2_147_483_647


def _constants(seed: int) -> list[tuple[int, int]]:
    out, x = [], seed * 2 + 1
    for _ in range(2 * ROUNDS):
        x = (x * 6364136223846793005 + 1442695040888963407) % 2**64
        out.append(((x >> 33) % PRIME, (x >> 3) % PRIME))
    return out


def _mix(x, c0, c1):
    """A cubic of x over a prime field; all products stay below 2**62."""
    y = (x + c0) % PRIME
    return (y * y % PRIME) * ((x + c1) % PRIME) % PRIME


def _grid(n: int) -> tuple[int, int]:
    """The least grid of a rows, a**2 >= n, with at least n cells."""
    a = max(1, isqrt(max(0, n - 1)) + 1)
    return a, max(1, -(-n // a))


def permuted(x: int, n: int, seed: int) -> int:
    """One pass of the permutation of the grid's cells: in each round the row is moved by a function of the column, then the column by one of the row."""
    a, b = _grid(n)
    left, right, k = x // b, x % b, _constants(seed)
    for i in range(ROUNDS):
        left = (left + _mix(right, *k[2 * i])) % a
        right = (right + _mix(left, *k[2 * i + 1])) % b
    return left * b + right


def permuted_column(x: Column, n: int, seed: int) -> Column:
    """The same as a column."""
    a, b = (F.lit(v).cast("long") for v in _grid(n))
    flat = [v for pair in _constants(seed) for v in pair]
    rounds = F.array(*[F.struct(*[F.lit(v).cast("long").alias(f"c{j}") for j, v in enumerate(flat[at : at + 4])]) for at in range(0, len(flat), 4)])
    zero = F.struct(F.floor(x / b).cast("long").alias("left"), (x % b).alias("right"))

    def step(acc: Column, k: Column) -> Column:
        left = (acc["left"] + _mix(acc["right"], k["c0"], k["c1"])) % a
        return F.struct(left.alias("left"), ((acc["right"] + _mix(left, k["c2"], k["c3"])) % b).alias("right"))

    return F.aggregate(rounds, zero, step, lambda acc: acc["left"] * b + acc["right"])


def place(row: int, n: int, shards: int, seed: int = 42) -> tuple[int, int]:
    """(shard, slot) of a row number, by plain arithmetic: the same as `shard` gives it."""
    x = permuted(row, n, seed)
    while x >= n:
        x = permuted(x, n, seed)
    return x % shards, x // shards


def numbered(light: DataFrame, order: list[str]) -> DataFrame:
    """`light` with `row_number` from 0 in the order of `order`: range partitions, sorted; the rows of each are counted, and only those counts are summed up."""
    part = staged(light.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))), "ordered")
    counts = part.groupBy("part").count()  # as many rows as partitions
    before = counts.select("part", F.col("count").alias("rows"))
    lists = before.agg(F.array_sort(F.collect_list(F.struct("part", "rows"))).alias("all"))
    sums = lists.select(F.explode(F.expr("transform(all, (x, i) -> struct(x.part AS part, aggregate(slice(all, 1, i), 0L, (s, y) -> s + y.rows) AS offset))")).alias("p")).select("p.*")
    return part.join(F.broadcast(sums), "part").withColumn("row_number", F.col("offset") + F.col("at")).drop("part", "at", "offset")


def shard(docs: DataFrame, shards: int = 24, seed: int = 42) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard, row_number) for each row of `docs` (doc_id, text).

    Rows are numbered by doc_id, then size and text_crc32, nulls first, and the number is permuted: shard and slot follow from the number,
    the row count, the shard count and the seed alone. The law is `rows`: counts differ by at most one, slots are gapless from 0,
    grown_shard is null. A null text has no bytes, crc 0 and size 8. Rows alike in all three are interchangeable. Equal texts, or a source
    with a third of all rows, spread evenly, as the permutation sees row numbers only. An empty table gives none.

    A number beyond the row count is permuted again until it is within; fewer than 2 * sqrt(rows) + 1 cells are beyond it.
    """
    data = F.encode(F.coalesce(F.col("text").cast("string"), F.lit("")), "UTF-8")
    light = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.length(data) + 8).cast("long").alias("size"), F.crc32(data).cast("long").alias("text_crc32"))
    rows = numbered(light, ["doc_id", "size", "text_crc32"])
    n = rows.count()
    spots = rows.withColumn("x", permuted_column(F.col("row_number"), n, seed))
    while n and spots.where(F.col("x") >= n).limit(1).count():
        spots = spots.withColumn("x", F.when(F.col("x") < n, F.col("x")).otherwise(permuted_column(F.col("x"), n, seed)))
    return spots.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), (F.col("x") % shards).cast("int").alias("shard"),
        F.floor(F.col("x") / shards).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "row_number",
    )
