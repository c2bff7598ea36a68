"""Layout of bilingual captions and facts of media streams, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cuefold.functions import text as T

# Sizes at a height of 1080.
STYLE = {"chinese": 48, "english": 34, "chinese_min": 34, "english_min": 25, "margin_v": 75, "margin_lr": 80, "width_ratio": 0.88, "outline": 2.2, "shadow": 0.6}
MP4_AUDIO = ("aac", "mp3", "ac3", "eac3", "alac")


def orientation_factor(width: Column, height: Column) -> Column:
    """1 for upright pictures, else 1.5, 1.6 from 16:9 and 1.75 from 2:1 on."""
    ratio = width / F.greatest(F.lit(1), height)
    return F.when(width <= height, 1.0).when(ratio >= 2.0, 1.75).when(ratio >= 16 / 9, 1.6).otherwise(1.5)


def scaled(name: str, width: Column, height: Column) -> Column:
    """A font size or margin in the picture's pixels; margins do not follow the orientation."""
    scale = F.greatest(F.lit(0.1), height / 1080.0)
    factor = F.lit(1.0) if name.startswith("margin") else orientation_factor(width, height)
    return F.bround(STYLE[name] * scale * factor).cast("int")


def safe_width(width: Column, height: Column) -> Column:
    return (width - 2 * scaled("margin_lr", width, height)) * STYLE["width_ratio"]


def line_count(text: Column) -> Column:
    return F.greatest(F.size(F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")), F.lit(1))


def font_size(text: Column, base: Column, least: Column, room: Column, lines: Column) -> Column:
    """The base size, smaller for wide lines and for three or more lines together, never below the least."""
    real = F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x)), lambda x: x != "")
    widest = F.array_max(F.transform(real, T.width_units))
    scale = F.least(F.lit(1.0), room / F.greatest(F.lit(1.0), widest * base))
    dense = F.when(lines >= 4, 0.92).when(lines == 3, 0.97).otherwise(1.0)
    return F.when(F.size(real) == 0, base).otherwise(F.greatest(least, F.least(base, F.bround(base * scale * dense).cast("int"))))


def escape_ass(text: Column) -> Column:
    """Text that cannot become a command; line ends become \\N."""
    plain = F.replace(F.replace(F.replace(F.regexp_replace(text, "\r\n?", "\n"), F.lit("\\"), F.lit("\\\\")), F.lit("{"), F.lit("\\{")), F.lit("}"), F.lit("\\}"))
    lines = F.transform(F.split(plain, "\n"), lambda x: F.trim(F.regexp_replace(x, "[ \t]+", " ")))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\\N")


def too_many_lines(english: Column, chinese: Column) -> Column:
    a, b = line_count(english), line_count(chinese)
    return (a > 2) | (b > 2) | (a + b > 4)


def number(value: Column) -> Column:
    return F.coalesce(value.try_cast("double"), F.lit(0.0))


def fraction(text: Column) -> Column:
    """`a/b` or a plain number; 0 for anything else."""
    parts = F.split(F.coalesce(text, F.lit("0/0")), "/", 2)
    return F.when(F.size(parts) == 2, F.coalesce(F.try_divide(number(F.get(parts, F.lit(0))), number(F.get(parts, F.lit(1)))), F.lit(0.0))).otherwise(number(text))


def rotation(*candidates: Column) -> Column:
    """The first number among the candidates, in degrees from 0 to 359."""
    return F.coalesce(*[F.pmod(F.bround(c.try_cast("double")).cast("int"), F.lit(360)) for c in candidates], F.lit(0))


def audio_mode(codecs: Column) -> Column:
    """struct(mode, warning): copy if there is audio and all of it fits the container, else transcode."""
    fits = (F.size(codecs) > 0) & F.forall(codecs, lambda c: F.lower(c).isin(*MP4_AUDIO))
    return F.struct(F.when(fits, "copy").otherwise("aac").alias("mode"), F.when(~fits, "AUDIO_TRANSCODE_REQUIRED").alias("warning"))
