"""Exact duplicates by two Bloom passes, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuefold.llm.common import drop_staged, new_path, staged, text_or_empty

#: Bits of the filter for each row, at least; and the part of the filter that is broadcast at once.
BITS_A_ROW, BROADCAST_BYTES = 16, 256 << 20
#: Bits of one row of the filter, as bitmap_construct_agg makes them.
PAGE = 32_768
#: Groups with more than rows / HEAVY copies are fewer than HEAVY: such a list may be broadcast.
HEAVY = 20_000


def normalised(text):
    return F.regexp_replace(text, "[ \\x09-\\x0D]+", "")


def _slot(h: str, bits: int):
    """(page, bit): the leading bits of a hash name a page of the filter, the next 15 a bit in it."""
    lead = (bits // PAGE).bit_length() - 1
    page = F.shiftrightunsigned(h, 64 - lead) if lead else F.lit(0).cast("long")
    return page, F.shiftrightunsigned(h, 49 - lead).bitwiseAND(F.lit(PAGE - 1))


def repeated_filter(hashes: DataFrame, bits: int) -> DataFrame:
    """(page, bitmap): the filter of the slots that rows of `hashes` (h) with equal hashes may have fallen into, `bits` slots in all, a power of two.

    A slot with two rows is left out if the trailing 15 bits of their hashes, a second hash, differ. Slots are counted map side first, so
    a hash that a third of all rows have leaves each task as one row; what moves is a slot and its counts, not the rows.
    """
    page, bit = _slot("h", bits)
    tag = F.col("h").bitwiseAND(F.lit(PAGE - 1)).cast("int")
    slots = hashes.select(page.alias("page"), bit.alias("bit"), tag.alias("tag")).groupBy("page", "bit")
    slots = slots.agg(F.count("*").alias("n"), F.min("tag").alias("low"), F.max("tag").alias("high"))
    return slots.where("n > 2 or n = 2 and low = high").groupBy("page").agg(F.expr("bitmap_construct_agg(bit)").alias("bitmap"))


def _marked(rows: DataFrame, pages: DataFrame, bits: int) -> DataFrame:
    page, bit = _slot("h", bits)
    byte = F.conv(F.hex(F.substring("bitmap", F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    hit = byte.bitwiseAND(F.element_at(F.array(*[F.lit(1 << k) for k in range(8)]), (bit % 8 + 1).cast("int"))) != 0
    joined = rows.withColumn("page", page).join(F.broadcast(pages), "page", "left")  # at most BROADCAST_BYTES of bitmaps
    return joined.withColumn("again", F.coalesce(hit, F.lit(False))).drop("page", "bitmap")


def possibly_repeated(rows: DataFrame, bits: int | None = None) -> DataFrame:
    """`rows` (h, ...) with `again`: false if no other row has the same h; true for all others and for few more.

    Rows are never shuffled, whatever their number. The filter has a proven size, bits / 8 bytes. Up to BROADCAST_BYTES of it go to every
    executor at once; a larger filter is written and goes out in ranges of the hash, one after the other. Each range reads its own rows
    alone where `rows` are a Parquet table whose files are sorted by h.
    """
    if bits is None:
        bits = max(PAGE, 1 << (BITS_A_ROW * max(1, rows.count()) - 1).bit_length())
    pages = staged(repeated_filter(rows, bits).repartitionByRange("page").sortWithinPartitions("page"), "filter")
    ranges = min(bits // PAGE, max(1, bits // 8 // BROADCAST_BYTES))
    if ranges == 1:
        return _marked(rows, pages, bits)
    spark, width, per = rows.sparkSession, 2**64 // ranges, bits // PAGE // ranges
    path = new_path(spark, "marked")
    for k in range(ranges):
        low = k * width - (2**64 if k * width >= 2**63 else 0)
        own = rows.where(F.col("h").between(low, low + width - 1))
        out = _marked(own, pages.where(F.col("page").between(k * per, (k + 1) * per - 1)), bits)
        out.write.mode("append").parquet(path)
    drop_staged(pages)
    return spark.read.schema(out.schema).parquet(path)


def exact_duplicates(docs: DataFrame, bits: int | None = None, heavy: int = HEAVY) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256) for each row of `docs` (doc_id, text).

    Texts are equal when they are so without space and \\x09-\\x0D; a null text is empty. Of equal texts the row with the most code points
    stays, then that with the smallest doc_id; a null doc_id comes last, and rows equal in both are all marked kept. The whole texts are
    read once, for digest, hash and length. Only rows whose hash the filter finds possibly repeated are shuffled by their digest, and the
    groups are made by sums that combine before the shuffle; all others pass straight through. The largest groups, fewer than `heavy` of
    them, meet their rows where these lie, so no task gets more than a `heavy`th of all rows for one digest.
    """
    text = text_or_empty()
    digest = F.sha2(normalised(text), 256)
    light = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.length(text).alias("chars"), digest.alias("text_sha256"))
    light = staged(light.withColumn("h", F.xxhash64("text_sha256")).sortWithinPartitions("h"), "digests")
    marked = possibly_repeated(light, bits)
    once = marked.where("not again").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    again = marked.where("again").drop("h", "again")
    rank = F.struct((-F.col("chars")).alias("less"), F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("doc_id"))
    groups = staged(again.groupBy("text_sha256").agg(F.min(rank).alias("best"), F.count("*").alias("group_size")), "groups")
    most = -(-light.count() // heavy)
    large = F.broadcast(groups.where(F.col("group_size") > most))
    kept = (F.col("chars") == -F.col("best.less")) & F.col("doc_id").eqNullSafe(F.col("best.doc_id"))
    told = lambda df: df.select("doc_id", F.col("best.doc_id").alias("keep_id"), "group_size", kept.alias("kept"), "text_sha256")
    few = again.join(large.select("text_sha256"), "text_sha256", "left_anti").join(groups.where(F.col("group_size") <= most), "text_sha256")
    return once.unionByName(told(again.join(large, "text_sha256"))).unionByName(told(few))


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_replace(coalesce(text, ''), '[ \x09-\x0D]', '', 'g') AS n FROM documents),
r AS (SELECT doc_id, length(t) AS chars, sha256(n) AS text_sha256 FROM d)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
  row_number() OVER w = 1 AS kept, text_sha256
FROM r WINDOW w AS (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id)
"""
