"""Views of the driver's tables in the shape of the library's inputs, each with the SQL of the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cuefold.functions import text as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of a conversation as cues that follow each other, 15 signs a second."""
    t = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("video_id"), F.col("turn").cast("int").alias("cue_id"), F.col("role").alias("track"), F.coalesce("text", F.lit("")).alias("text"))
    w = W.partitionBy("video_id").orderBy("cue_id")
    t = t.withColumn("end", F.round(F.sum(F.length("text")).over(w) / 15.0, 3))
    return t.select("video_id", "track", "cue_id", F.coalesce(F.lag("end").over(w), F.lit(0.0)).alias("start"), "end", "text")


CUES = """
base AS (SELECT conv_id AS video_id, CAST(turn AS INTEGER) AS cue_id, role AS track, coalesce(text, '') AS text FROM conversations),
ends AS (SELECT *, round(sum(length(text)) OVER w / 15.0, 3) AS "end" FROM base WINDOW w AS (PARTITION BY video_id ORDER BY cue_id)),
cues AS (SELECT video_id, track, cue_id, coalesce(lag("end") OVER w, 0.0) AS start, "end", text FROM ends WINDOW w AS (PARTITION BY video_id ORDER BY cue_id))
"""


def rolling_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cues, of which some begin with the one before, repeat it or begin too soon."""
    w = W.partitionBy("video_id").orderBy("cue_id")
    before, kind = F.coalesce(F.lag("text").over(w), F.lit("")), F.col("cue_id") % 4
    text = F.when(kind == 2, F.concat(before, F.lit(" "), "text")).when(kind == 3, before).otherwise(F.col("text"))
    return cues(spark, sf_dir).withColumns({"text": text, "start": F.when(kind == 1, F.round(F.greatest(F.col("start") - 0.5, F.lit(0.0)), 3)).otherwise(F.col("start"))})


ROLLING = CUES + """,
rolling AS (
  SELECT video_id, track, cue_id, CASE WHEN cue_id % 4 = 1 THEN round(greatest(start - 0.5, 0.0), 3) ELSE start END AS start, "end",
    CASE cue_id % 4 WHEN 2 THEN coalesce(lag(text) OVER w, '') || ' ' || text WHEN 3 THEN coalesce(lag(text) OVER w, '') ELSE text END AS text
  FROM cues WINDOW w AS (PARTITION BY video_id ORDER BY cue_id))
"""


def tracks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """User turns as one track, assistant turns two seconds earlier as the other."""
    c = cues(spark, sf_dir)
    shift = lambda x: F.round(F.greatest(F.col(x) - 2.0, F.lit(0.0)), 3)
    return c.where("track = 'user'").drop("track"), c.where("track = 'assistant'").withColumns({"start": shift("start"), "end": shift("end")}).drop("track")


TRACKS = CUES + """,
left_track AS (SELECT video_id, cue_id, start, "end", text FROM cues WHERE track = 'user'),
right_track AS (SELECT video_id, cue_id, round(greatest(start - 2.0, 0.0), 3) AS start, round(greatest("end" - 2.0, 0.0), 3) AS "end", text FROM cues WHERE track = 'assistant')
"""


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as stretches of a minute times their value, by user."""
    e = table(spark, sf_dir, "events")
    start = F.unix_micros(F.col("ts").cast("timestamp")) / 1e6
    return e.select(F.col("user_id").alias("video_id"), F.col("event_type").alias("track"), "event_id", start.alias("start"), (start + 60 * F.col("value")).alias("end"))


INTERVALS = """
spans AS (SELECT user_id AS video_id, event_type AS track, event_id, epoch_us(ts) / 1e6 AS start, epoch_us(ts) / 1e6 + 60 * value AS "end" FROM events)
"""
UNION_SQL = """
{name}_b AS (SELECT *, max(e) OVER (PARTITION BY video_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM (SELECT video_id, greatest(start, 0.0) AS s, greatest("end", 0.0) AS e FROM {source} WHERE "end" > start)),
{name}_i AS (SELECT *, sum(CASE WHEN before IS NULL OR s > before THEN 1 ELSE 0 END) OVER (PARTITION BY video_id ORDER BY s, e) AS island FROM {name}_b),
{name} AS (SELECT video_id, min(s) AS start, max(e) AS "end" FROM {name}_i GROUP BY video_id, island)
"""


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as discovery hits on documents: views and clicks are searches, sign-ups popular feeds; events of other types are no hits."""
    d = table(spark, sf_dir, "documents").agg(F.count("*").alias("n"))
    e = table(spark, sf_dir, "events").join(F.broadcast(d))  # one row
    mode = F.when(F.col("event_type") == "view", "fresh").when(F.col("event_type") == "click", "growth")
    kind = F.when(F.col("event_type") == "signup", "popular").otherwise("search")
    base = e.where("event_type IN ('view', 'click', 'signup')").select((F.col("event_id") % F.col("n")).alias("video_id"), kind.alias("kind"), mode.alias("mode"), F.concat(F.lit("g"), F.col("user_id") % 24).alias("query_group"), (F.col("event_id") % 50 + 1).cast("int").alias("rank"), F.concat(F.lit("q"), F.col("user_id") % 7).alias("query_text"), F.concat(F.lit("feed"), F.col("user_id") % 5).alias("feed"))
    search = F.col("kind") == "search"
    return base.select("video_id", "kind", "mode", *[F.when(search, F.col(c)).alias(c) for c in ("query_group", "rank", "query_text")], F.when(~search, F.col("feed")).alias("feed"))


HITS = """
hits AS (
  SELECT event_id % (SELECT count(*) FROM documents) AS video_id, CASE WHEN event_type = 'signup' THEN 'popular' ELSE 'search' END AS kind,
    CASE event_type WHEN 'view' THEN 'fresh' WHEN 'click' THEN 'growth' END AS mode, CASE WHEN event_type <> 'signup' THEN 'g' || (user_id % 24) END AS query_group,
    CASE WHEN event_type <> 'signup' THEN CAST(event_id % 50 + 1 AS INTEGER) END AS rank, CASE WHEN event_type <> 'signup' THEN 'q' || (user_id % 7) END AS query_text, CASE WHEN event_type = 'signup' THEN 'feed' || (user_id % 5) END AS feed
  FROM events WHERE event_type IN ('view', 'click', 'signup'))
"""


def videos(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as videos, with counts and publication from the events on them."""
    d = table(spark, sf_dir, "documents")
    e = table(spark, sf_dir, "events").join(F.broadcast(d.agg(F.count("*").alias("n"))))  # one row
    n = lambda kind: F.count_if(F.col("event_type") == kind)
    stats = e.groupBy((F.col("event_id") % F.col("n")).alias("video_id")).agg((n("view") * 1000).cast("string").alias("viewCount"), (n("click") * 20).cast("string").alias("likeCount"), n("signup").cast("string").alias("commentCount"), F.date_format(F.min("ts"), "yyyy-MM-dd'T'HH:mm:ss").alias("p"))
    title = T.first_words(F.col("text"), 8)
    df = d.withColumnRenamed("doc_id", "video_id").join(stats, "video_id", "left")
    k = F.col("video_id") % 10
    return df.select(
        "video_id", F.struct(
            title.alias("title"), F.col("text").alias("description"), F.col("source").alias("channelTitle"), (F.col("video_id") % 6).cast("string").alias("categoryId"), F.concat("p", F.lit("Z")).alias("publishedAt"), F.when(k == 9, "live").otherwise("none").alias("liveBroadcastContent"),
            F.when(k < 3, F.col("lang")).alias("defaultAudioLanguage"), F.when(k < 8, F.col("lang")).alias("defaultLanguage"), F.array(F.col("source")).alias("tags"), F.expr("cast(map() AS map<string,struct<url:string>>)").alias("thumbnails"),
        ).alias("snippet"),
        F.struct(F.concat(F.lit("PT"), F.floor((F.lit(30) + F.col("n_chars") % 3000) / 60), F.lit("M"), (F.lit(30) + F.col("n_chars") % 3000) % 60, F.lit("S")).alias("duration"), F.when(k % 2 == 0, "true").otherwise("false").alias("caption")).alias("contentDetails"),
        F.struct("viewCount", "likeCount", "commentCount").alias("statistics"), F.struct(F.when(k == 7, "unlisted").otherwise("public").alias("privacyStatus"), F.when(k == 4, "creativeCommon").otherwise("youtube").alias("license"), F.lit(True).alias("embeddable")).alias("status"),
    )


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as jobs."""
    o = table(spark, sf_dir, "orders")
    status = F.when(F.col("o_orderstatus") == "O", "queued").when(F.col("o_orderstatus") == "P", "running").when(F.col("o_orderkey") % 5 == 0, "failed").otherwise("done")
    return o.select(F.col("o_orderkey").alias("id"), F.concat(F.lit("t"), F.col("o_custkey") % 500).alias("target"), status.alias("status"), F.col("o_orderpriority").alias("step"), F.col("o_orderdate").cast("timestamp").alias("created_at"), F.concat(F.lit("log"), F.col("o_orderkey") % 1000).alias("log_path"))


JOBS = """
jobs AS (SELECT o_orderkey AS id, 't' || (o_custkey % 500) AS target, CASE WHEN o_orderstatus = 'O' THEN 'queued' WHEN o_orderstatus = 'P' THEN 'running' WHEN o_orderkey % 5 = 0 THEN 'failed' ELSE 'done' END AS status,
  o_orderpriority AS step, o_orderdate AS created_at, 'log' || (o_orderkey % 1000) AS log_path FROM orders)
"""


def translations(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Cues as source rows, and as translated rows some of which are missing, extra, empty or moved."""
    c = cues(spark, sf_dir).select("video_id", F.col("cue_id").alias("id"), "start", "end", "text")
    k = (F.col("video_id") * 7 + F.col("id")) % 11
    translated = c.where(k != 0).select("video_id", F.when(k == 1, F.col("id") + 1000).otherwise(F.col("id")).alias("id"), F.when(k == 2, F.col("start") + 0.5).otherwise(F.col("start")).alias("start"), "end", F.when(k == 3, "").when(k == 4, F.concat("text", F.lit("。。"))).otherwise(F.col("text")).alias("translation"))
    return c, translated


TRANSLATIONS = CUES + """,
src AS (SELECT video_id, cue_id AS id, start, "end", text FROM cues),
tr AS (SELECT video_id, CASE WHEN k = 1 THEN id + 1000 ELSE id END AS id, CASE WHEN k = 2 THEN start + 0.5 ELSE start END AS start, "end",
  CASE WHEN k = 3 THEN '' WHEN k = 4 THEN text || '。。' ELSE text END AS translation FROM (SELECT *, (video_id * 7 + id) % 11 AS k FROM src) WHERE k <> 0)
"""


def translated_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cues with numbers and negations, and Chinese for them: as long as the time allows, too long, changed, stilted, empty or left in English."""
    c = cues(spark, sf_dir)
    k = (F.col("video_id") * 7 + F.col("cue_id")) % 12
    seconds = F.round(F.col("end") - F.col("start"), 3)
    n = F.floor(seconds * 4.5 * F.when(k == 4, 1.5).when(k == 5, 1.2).otherwise(0.8)).cast("int")
    plain = F.concat(F.lit("该"), F.repeat(F.lit("好"), n))
    text = F.concat(F.regexp_replace("text", "[0-9]", ""), F.when(k < 2, " 12 and 3.5").when(k.isin(2, 3), " do not go").otherwise(""))
    told = (
        F.when(k == 0, F.concat(plain, F.lit("12，3.5"))).when(k == 1, F.concat(plain, F.lit("12，3.6"))).when(k == 3, F.concat(F.lit("不"), plain)).when(k == 6, "").when(k == 7, F.col("text"))
        .when(k == 8, F.concat(F.lit("进行一个"), plain)).when(k == 9, F.concat(plain, F.lit("，，"))).when(k == 10, F.repeat(F.lit("好"), n)).otherwise(plain)
    )
    return c.select("video_id", "cue_id", text.alias("text"), told.alias("translation"), seconds.alias("seconds"))


TRANSLATED = CUES + """,
timed AS (SELECT video_id, cue_id, text AS t, (video_id * 7 + cue_id) % 12 AS k, round("end" - start, 3) AS seconds FROM cues),
sized AS (SELECT *, floor(seconds * 4.5::DOUBLE * CASE k WHEN 4 THEN 1.5::DOUBLE WHEN 5 THEN 1.2::DOUBLE ELSE 0.8::DOUBLE END)::INTEGER AS n FROM timed),
translated AS (
  SELECT video_id, cue_id, seconds, regexp_replace(t, '[0-9]', '', 'g') || CASE WHEN k < 2 THEN ' 12 and 3.5' WHEN k IN (2, 3) THEN ' do not go' ELSE '' END AS text,
    CASE k WHEN 0 THEN '该' || repeat('好', n) || '12，3.5' WHEN 1 THEN '该' || repeat('好', n) || '12，3.6' WHEN 3 THEN '不该' || repeat('好', n) WHEN 6 THEN '' WHEN 7 THEN t
      WHEN 8 THEN '进行一个该' || repeat('好', n) WHEN 9 THEN '该' || repeat('好', n) || '，，' WHEN 10 THEN repeat('好', n) ELSE '该' || repeat('好', n) END AS translation FROM sized)
"""


def spoken_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as words that follow each other, with pauses, sentence ends, commas and repeats; seven words a cue, times in thousandths exact in doubles of seconds."""
    li = table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") * 7 + F.col("l_partkey") % 7).alias("video_id"), "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", F.col("l_quantity").cast("bigint").alias("q"))
    w = W.partitionBy("video_id").orderBy("l_orderkey", "l_linenumber", "l_partkey", "q", "l_extendedprice")
    pick = lambda values, at: F.element_at(F.array(*[F.lit(x) for x in values]), (at + 1).cast("int"))
    long, pause = 100 + F.col("q") % 5 * 150, pick((0, 50, 100, 300, 700, 1500), F.col("l_partkey") % 6)
    ends = F.sum(long + pause).over(w)
    rows = li.select("video_id", (F.row_number().over(w) - 1).alias("i"), ends.alias("stop"), long.alias("long"), pick(("one", "Two", "four,", "five.", "no!", "so;", "and", "and"), F.col("l_orderkey") % 8).alias("text"))
    second = lambda x: x.cast("double") / 1000
    return rows.select("video_id", F.floor(F.col("i") / 7).cast("int").alias("cue_id"), (F.col("i") % 7).cast("int").alias("n"), "text", second(F.col("stop") - F.col("long")).alias("start"), second(F.col("stop")).alias("end"), "i")


SPOKEN = """
lines AS (SELECT l_suppkey * 7 + l_partkey % 7 AS video_id, l_orderkey, l_linenumber, l_partkey, l_quantity::BIGINT AS q, l_extendedprice, 100 + l_quantity::BIGINT % 5 * 150 AS long, [0, 50, 100, 300, 700, 1500][l_partkey % 6 + 1] AS pause,
  ['one', 'Two', 'four,', 'five.', 'no!', 'so;', 'and', 'and'][l_orderkey % 8 + 1] AS text FROM lineitem),
placed AS (SELECT *, row_number() OVER w - 1 AS i, sum(long + pause) OVER w AS stop FROM lines WINDOW w AS (PARTITION BY video_id ORDER BY l_orderkey, l_linenumber, l_partkey, q, l_extendedprice)),
words AS (SELECT video_id, i, text, (stop - long)::DOUBLE / 1000 AS start, stop::DOUBLE / 1000 AS "end" FROM placed)
"""
