"""Flags of one translated cue, as columns over its source text, translation and duration."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cuefold.functions import text as T

# Reading speed, warning and rewrite ratios, line limits, and the patterns of the checks.
SPEED, WARN, REWRITE, LINE, LINES = 4.5, 1.15, 1.25, 20, 2
SPOKEN = r"[\x{3400}-\x{9fff}A-Za-z0-9]"
NUMBER = r"\d+(?:[.,]\d+)?"
NEGATION_SOURCE = r"(?i)\b(?:no|not|never|without|n't)\b"
# The same where only ASCII letters, digits and the underscore make words, as in SQL engines: `noé` holds a `no` there.
NEGATION_ASCII = r"(?i)(?<![A-Za-z0-9_])(?:no|not|never|without|n't)(?![A-Za-z0-9_])"
NEGATION_TARGET = "(不|没|无|未|别|从不)"
STILTED = "(进行一个|对于.*来说|值得注意的是)"
REPEATED = r"([，。！？])\1+"


def speech_seconds(translation: Column) -> Column:
    """How long the translation takes to speak."""
    return F.round(F.regexp_count(translation, F.lit(SPOKEN)) / SPEED, 3)


def duration_ratio(translation: Column, seconds: Column) -> Column:
    return F.round(speech_seconds(translation) / F.greatest(F.lit(0.05), seconds), 3)


def _flags(*pairs: tuple[Column, str]) -> Column:
    return F.array_compact(F.array(*[F.when(c, F.lit(name)) for c, name in pairs]))


def length_flags(translation: Column, seconds: Column) -> Column:
    ratio = duration_ratio(translation, seconds)
    return _flags(
        (ratio > REWRITE, "TTS_TOO_LONG"), (ratio > REWRITE, "TOO_LONG_FOR_DURATION"), ((ratio > WARN) & (ratio <= REWRITE), "TTS_LENGTH_WARNING"),
        (F.trim(translation) == "", "EMPTY_TRANSLATION"), (F.length(translation) > LINE * LINES, "CHINESE_TOO_LONG"),
    )


def glossary_flags(source: Column, translation: Column, terms: dict[str, str]) -> Column:
    """GLOSSARY_MISMATCH:term for each term of the source whose fixed translation is missing."""
    if not terms:
        return F.array().cast("array<string>")
    return _flags(*[(F.lower(source).contains(k.lower()) & ~translation.contains(v), f"GLOSSARY_MISMATCH:{k}") for k, v in terms.items()])


def number_mismatch(source: Column, translation: Column) -> Column:
    """A number of the source is missing from the translation."""
    found = lambda c: F.regexp_extract_all(c, F.lit(NUMBER), F.lit(0))
    return F.size(F.array_except(found(source), found(translation))) > 0


def negation_mismatch(source: Column, translation: Column, negation: str = NEGATION_SOURCE) -> Column:
    return source.rlike(negation) & ~translation.rlike(NEGATION_TARGET)


def english_leakage(translation: Column) -> Column:
    return F.regexp_count(translation, F.lit("[A-Za-z]")) > F.greatest(F.lit(8.0), F.length(translation) * 0.35)


def translation_flags(source: Column, translation: Column, seconds: Column, terms: dict[str, str] | None = None, negation: str = NEGATION_SOURCE) -> Column:
    """All flags of a cue in the order of the checks, each once; `negation` finds the negations of a source."""
    content = _flags(
        (number_mismatch(source, translation), "NUMBER_MISMATCH"), (negation_mismatch(source, translation, negation), "NEGATION_MISMATCH"), (english_leakage(translation), "ENGLISH_LEAKAGE"),
        (translation.rlike(STILTED), "TRANSLATIONESE"), (translation.rlike(REPEATED), "UNNATURAL_PUNCTUATION"),
    )
    return F.array_distinct(F.concat(length_flags(translation, seconds), glossary_flags(source, translation, terms or {}), content))


def faults(text: Column) -> Column:
    """struct(control, invisible, tag): what must not stand in a finished caption."""
    return F.struct(text.rlike(T.CONTROL).alias("control"), text.rlike(T.INVISIBLE).alias("invisible"), text.rlike(T.CAPTION_TAG).alias("tag"))
