"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuefold.llm.common import OWN, small, staged, text_or_empty

#: A mean above this is the sum of so many equal smaller means: exp(-mean) stays far from underflow and the inversion short.
PART = 16.0
#: Up to so many sources, of about 600 bytes each, are broadcast.
SOURCES = 20_000


def uniform(seed: int, *keys: Column) -> Column:
    """A number in [0, 1) from the first 52 bits of an MD5 over the seed and the keys; the same on any engine and in any order."""
    text = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(k.cast("string"), F.lit("null")) for k in keys])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") / float(2**52)


def poisson_table(mean: Column) -> Column:
    """The values of the Poisson distribution function from 0 on, as far as they still grow in doubles. Means up to PART: past 128 terms they do not."""
    start = F.struct(F.exp(-mean).alias("p"), F.array(F.exp(-mean)).alias("cdf"))

    def step(acc: Column, i: Column) -> Column:
        p = acc["p"] * mean / i
        more = F.element_at(acc["cdf"], -1) + p
        grows = more > F.element_at(acc["cdf"], -1)
        return F.struct(p.alias("p"), F.when(grows, F.concat(acc["cdf"], F.array(more))).otherwise(acc["cdf"]).alias("cdf"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(128)), start, step, lambda acc: acc["cdf"])


def poisson_parts(mean: Column) -> Column:
    return F.greatest(F.ceil(mean / PART).cast("int"), F.lit(1))


def poisson_count(seed: int, key: Column, mean: Column, table: Column | None = None) -> Column:
    """A Poisson count for each key, by inverting hash-seeded uniforms: the least k whose distribution function exceeds each; large means are summed from independent
    equal parts, and `table` is the distribution function of one part."""
    table = poisson_table(mean / poisson_parts(mean)) if table is None else table
    drawn = F.transform(F.sequence(F.lit(1), poisson_parts(mean)), lambda j: uniform(seed, key, j))
    counts = F.transform(drawn, lambda u: F.size(F.filter(table, lambda c: c <= u)))
    return F.when(mean > 0, F.aggregate(counts, F.lit(0), lambda acc, k: acc + k)).otherwise(F.lit(0))


def rates(docs: DataFrame, targets: DataFrame | None = None, temperature: float = 0.5, epochs: float = 1.0) -> DataFrame:
    """(source, source_docs, source_bytes, weight, rate): the mean number of times each document of a source is to be repeated.

    rate = epochs * share of the source's weight * bytes of all sources / bytes of the source. Weights come from `targets` (source,
    weight); a source that it leaves out has weight 0. Without it they are bytes ** temperature. A null source is a source of its own;
    one without any bytes counts as having one.
    """
    sizes = docs.select(F.col("source").cast("string").alias("source"), F.octet_length(text_or_empty()).cast("long").alias("b")).groupBy("source")
    sizes = sizes.agg(F.count("*").alias("source_docs"), F.greatest(F.sum("b"), F.lit(1)).alias("source_bytes"))
    if targets is None:
        sizes = sizes.withColumn("weight", F.pow(F.col("source_bytes").cast("double"), F.lit(temperature)))
    else:
        given = targets.groupBy(F.col("source").cast("string").alias("t")).agg(F.sum(F.col("weight").cast("double")).alias("weight"))
        sizes = sizes.join(given, F.col("source").eqNullSafe(F.col("t")), "left").drop("t").withColumn("weight", F.coalesce("weight", F.lit(0.0)))
    total = sizes.agg(F.sum("weight").alias("w"), F.sum("source_bytes").alias("t"))
    share = F.coalesce(F.try_divide(F.col("weight"), F.col("w")), F.lit(0.0))
    # one row of totals against one row a source
    return sizes.join(F.broadcast(total)).select("source", "source_docs", "source_bytes", "weight", (share * F.col("t") * epochs / F.col("source_bytes")).alias("rate"))


def mix(docs: DataFrame, targets: DataFrame | None = None, temperature: float = 0.5, epochs: float = 1.0, seed: int = 42) -> DataFrame:
    """`docs` with each row repeated by its Poisson count, in one global shuffle: all its columns, `__cf_copy` (from 1), `__cf_copies`, `__cf_rate`
    and `__cf_order`, the hash by which rows are dealt over partitions and sorted in them.

    A row's count depends on the seed, its doc_id and its source's rate alone, so repeated rows get equal counts and a rerun gives the
    same rows. Rows of a null source or doc_id take part. An empty table gives none. The rates are one row a source; they are broadcast
    only below a counted number of sources. Rows of one source stay where they are until the shuffle, which goes by a hash of doc_id and
    copy and so splits any source.
    """
    mean = F.col("rate") / poisson_parts(F.col("rate"))
    found = rates(docs, targets, temperature, epochs).select(F.col("source").alias(f"{OWN}source"), F.col("rate").alias(f"{OWN}rate"), poisson_table(mean).alias(f"{OWN}table"))
    by_source = small(staged(found, "rates"), SOURCES)
    joined = docs.join(by_source, docs["source"].cast("string").eqNullSafe(by_source[f"{OWN}source"])).drop(f"{OWN}source")
    counted = joined.withColumn(f"{OWN}copies", poisson_count(seed, F.col("doc_id"), F.col(f"{OWN}rate"), F.col(f"{OWN}table"))).where(F.col(f"{OWN}copies") > 0).drop(f"{OWN}table")
    copies = counted.withColumn(f"{OWN}copy", F.explode(F.sequence(F.lit(1), F.col(f"{OWN}copies"))))
    order = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(f"{seed}:order"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.col(f"{OWN}copy"))), 1, 15), 16, 10).cast("long")
    return copies.withColumn(f"{OWN}order", order).repartition(F.col(f"{OWN}order")).sortWithinPartitions(f"{OWN}order")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The same without the added columns."""
    return mix(docs, **options).select(*[docs[c] for c in docs.columns])


ORACLE = """
WITH RECURSIVE b AS (SELECT doc_id, source, strlen(coalesce(text, '')) AS bytes, strlen(text) AS text_bytes FROM documents),
s AS (SELECT source, greatest(sum(bytes), 1) AS source_bytes FROM b GROUP BY source),
t AS (SELECT sum(source_bytes) AS total, sum(sqrt(CAST(source_bytes AS DOUBLE))) AS w FROM s),
r AS (SELECT source, sqrt(CAST(source_bytes AS DOUBLE)) / w * total * 1.0 / source_bytes AS rate FROM s, t),
d AS (SELECT doc_id, b.source, text_bytes, rate, greatest(CAST(ceil(rate / 16.0) AS INTEGER), 1) AS parts FROM b JOIN r ON b.source IS NOT DISTINCT FROM r.source),
p AS (SELECT *, unnest(range(1, parts + 1)) AS j FROM d),
u AS (SELECT doc_id, source, text_bytes, j, rate / parts AS mean, CAST(CAST('0x' || substr(md5(concat('42:', coalesce(CAST(doc_id AS VARCHAR), 'null'), ':', j)), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0 AS u FROM p),
k AS (
  SELECT doc_id, source, text_bytes, j, mean, u, 0 AS k, exp(-mean) AS p, exp(-mean) AS cdf FROM u
  UNION ALL
  SELECT doc_id, source, text_bytes, j, mean, u, k + 1, p * mean / (k + 1), cdf + p * mean / (k + 1) FROM k WHERE u >= cdf AND k < 128
),
n AS (SELECT doc_id, source, text_bytes, j, max(k) AS k FROM k GROUP BY ALL),
c AS (SELECT doc_id, source, text_bytes, CAST(sum(k) AS INTEGER) AS copies FROM n GROUP BY ALL),
x AS (SELECT *, unnest(range(1, copies + 1)) AS copy FROM c)
SELECT doc_id, source, CAST(copy AS INTEGER) AS copy, copies,
  CAST('0x' || substr(md5(concat('42:order:', coalesce(CAST(doc_id AS VARCHAR), 'null'), ':', copy)), 1, 15) AS BIGINT) AS shuffle_key, text_bytes
FROM x
"""
