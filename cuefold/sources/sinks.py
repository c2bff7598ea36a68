"""Writers. All of them write with Spark's own writers, one folder for each call."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuefold.functions import layout, times
from cuefold.functions import text as T
from cuefold.sources.manifests import REVIEW

# The head of an ASS file.
ASS_HEAD = """[Script Info]
Title: English / 中文
ScriptType: v4.00+
WrapStyle: 0
ScaledBorderAndShadow: yes
PlayResX: {x}
PlayResY: {y}
YCbCr Matrix: TV.709

[V4+ Styles]
Format: Name, Fontname, Fontsize, PrimaryColour, SecondaryColour, OutlineColour, BackColour, Bold, Italic, Underline, StrikeOut, ScaleX, ScaleY, Spacing, Angle, BorderStyle, Outline, Shadow, Alignment, MarginL, MarginR, MarginV, Encoding
Style: Bilingual,{font},{size},&H00FFFFFF,&H000000FF,&H00000000,&H80000000,0,0,0,0,100,100,0,0,1,{outline},{shadow},2,{lr},{lr},{v},1

[Events]
Format: Layer, Start, End, Style, Name, MarginL, MarginR, MarginV, Effect, Text
"""


def write_csv(rows: DataFrame, path: str, fields: list[str]) -> None:
    """CSV with a header, columns in the order of `fields`, nested ones as JSON."""
    nested = {c for c, t in rows.dtypes if t.startswith(("array", "map", "struct"))}
    rows.select(*[F.to_json(c).alias(c) if c in nested else F.col(c) for c in fields]).write.csv(path, header=True, escape='"')


def write_envelope(rows: DataFrame, path: str, metadata: dict[str, str]) -> None:
    """JSON lines of the rows and, beside them, one row of run metadata with their number."""
    rows.write.json(f"{path}/rows")
    extra = [F.lit(v).alias(k) for k, v in metadata.items()]
    rows.agg(F.count("*").alias("count")).select(*extra, "count").write.json(f"{path}/metadata")


def srt_texts(cues: DataFrame, keys: list[str], width: int | None = 44, wrap_at_width: bool = False) -> DataFrame:
    """(keys, content): whole SRT files, blocks numbered from 1 in the order of cue_id."""
    body = F.col("text") if width is None else T.two_lines(F.col("text"), width, wrap_at_width)
    block = F.struct("cue_id", F.concat(times.srt_time(F.col("start")), F.lit(" --> "), times.srt_time(F.col("end")), F.lit("\n"), body).alias("b"))
    out = cues.groupBy(*keys).agg(F.array_sort(F.collect_list(block)).alias("x"))
    numbered = F.transform("x", lambda b, i: F.concat((i + 1).cast("string"), F.lit("\n"), b["b"]))
    return out.select(*keys, F.concat(F.array_join(numbered, "\n\n"), F.lit("\n")).alias("content"))


def write_texts(texts: DataFrame, path: str, keys: list[str]) -> None:
    """One text file for each row of (keys, content), in folders by key."""
    texts.select(*keys, F.col("content").alias("value")).repartition(*keys).write.partitionBy(*keys).option("lineSep", "\n").option("maxRecordsPerFile", 1).text(path)


def ass_texts(sized: DataFrame, sizes: DataFrame, english_font: str = "Arial", chinese_font: str = "Microsoft YaHei") -> DataFrame:
    """(video_id, content): whole bilingual ASS files from tasks.font_sizes rows and (video_id, width, height): English above Chinese, a size for each cue."""
    text = F.concat(
        F.lit(f"{{\\fn{english_font}\\fs"), F.col("english_size"), F.lit("\\b0}"), layout.escape_ass(F.col("text")), F.lit("\\N"), F.lit(f"{{\\fn{chinese_font}\\fs"), F.col("chinese_size"), F.lit("\\b0}"), layout.escape_ass(F.col("other")),
    )
    line = F.concat(F.lit("Dialogue: 0,"), times.ass_time(F.col("start")), F.lit(","), times.ass_time(F.col("end")), F.lit(",Bilingual,,0,0,0,,"), text)
    events = sized.groupBy("video_id").agg(F.array_sort(F.collect_list(F.struct("start", "identifier", line.alias("l")))).alias("e"))
    w, h = F.col("width"), F.col("height")
    factor = F.greatest(F.lit(0.1), h / 1080.0) * layout.orientation_factor(w, h)
    values = {"{x}": w, "{y}": h, "{font}": F.lit(english_font), "{size}": layout.scaled("english", w, h), "{outline}": F.greatest(F.lit(0.1), F.round(layout.STYLE["outline"] * factor, 2)), "{shadow}": F.greatest(F.lit(0.0), F.round(layout.STYLE["shadow"] * factor, 2)), "{lr}": layout.scaled("margin_lr", w, h), "{v}": layout.scaled("margin_v", w, h)}
    head = F.lit(ASS_HEAD)
    for name, value in values.items():
        head = F.replace(head, F.lit(name), value.cast("string"))
    return events.join(sizes.select("video_id", "width", "height"), "video_id").select("video_id", F.concat(head, F.array_join(F.transform("e", lambda x: x["l"]), "\n"), F.lit("\n")).alias("content"))


def review_rows(selected: DataFrame, raw: DataFrame, clean: DataFrame, flags: DataFrame, source: DataFrame) -> DataFrame:
    """(video_id, review columns): the sheet of each video; a cue without a cleaned translation shows the raw one. All tables by (video_id, id), `source` by video_id."""
    df = selected.join(raw.select("video_id", "id", F.col("text").alias("r")), ["video_id", "id"], "left").join(clean.select("video_id", "id", F.col("text").alias("c")), ["video_id", "id"], "left")
    df = df.join(flags.select("video_id", "id", "qc_flags"), ["video_id", "id"], "left").join(source.select("video_id", "source"), "video_id", "left")
    best = F.coalesce("c", "r", F.lit(""))
    values = [F.col("id"), times.srt_time(F.col("start")), times.srt_time(F.col("end")), F.format_string("%.3f", F.greatest(F.col("end") - F.col("start"), F.lit(0.0))), F.col("text"), F.coalesce("r", F.lit("")), best, best, F.coalesce(F.array_join("qc_flags", "|"), F.lit("")), F.coalesce("source", F.lit("")), F.lit("")]
    return df.select("video_id", *[v.alias(n) for n, v in zip(REVIEW, values, strict=True)])


def write_review(rows: DataFrame, path: str) -> None:
    """Tab-separated sheets in folders by video."""
    rows.repartition("video_id").sortWithinPartitions("video_id", "id").write.partitionBy("video_id").csv(path, sep="\t", header=True, escape='"')


def write_checkpoints(rows: DataFrame, path: str) -> None:
    """Appends (task, step, fingerprint, qc_status, outputs) by step."""
    rows.write.mode("append").partitionBy("step").parquet(path)


def selection_report(decisions: DataFrame, scores: DataFrame) -> DataFrame:
    """One row a video: decision, difference, both final scores and a fingerprint."""
    two = scores.groupBy("video_id").pivot("source", ["youtube", "whisper"]).agg(F.first("final_score"))
    out = decisions.join(two.withColumnsRenamed({"youtube": "youtube_score", "whisper": "whisper_score"}), "video_id")
    return out.withColumn("fingerprint", F.sha2(F.to_json(F.struct("selected_source", "whisper_score", "youtube_score")), 256))


def write_selection(report: DataFrame, selected_cues: DataFrame, path: str) -> None:
    """Writes the report and the chosen tracks; a chosen track without cues, or other than as many rows as were given, fails the write."""
    spark = report.sparkSession
    picked = report.where("selected_source <> ''").select("video_id")
    if picked.join(selected_cues.select("video_id").distinct(), "video_id", "left_anti").limit(1).count():
        raise ValueError("a selected track is empty")
    report.write.json(f"{path}/report")
    selected_cues.write.parquet(f"{path}/cues")
    if spark.read.parquet(f"{path}/cues").count() != selected_cues.count():
        raise ValueError("the selected tracks were not written whole")


def qc_text(report: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, content): `name: value` lines of a report row."""
    rest = [c for c in report.columns if c not in keys]
    line = lambda c: F.concat(F.lit(f"{c}: "), F.coalesce((F.to_json(c) if dict(report.dtypes)[c].startswith(("array", "map", "struct")) else F.col(c).cast("string")), F.lit("None")), F.lit("\n"))
    return report.select(*keys, F.concat(*[line(c) for c in rest]).alias("content"))
