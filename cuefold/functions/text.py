"""Text helpers as columns. All of them are native expressions; null in gives null out unless a helper says otherwise.

Letters, digits and the underscore are `WORD` here, whatever the script. Lower case stands for case folding, so `ß` and `ss` differ.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_]"
NOT_WORD = r"[^\p{L}\p{N}_]"
SPACE = r"(?U)\s+"
OTHER_SPACE = r"(?U)[\s&&[^ ]]"
# The entities that captions and titles use, the ampersand last.
ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&amp;", "&"))
# Ranges of Chinese characters.
CJK = r"[\x{3400}-\x{4dbf}\x{4e00}-\x{9fff}\x{f900}-\x{faff}]"
CJK_SPAN = r"[\x{3400}-\x{9fff}]"
# Signs before which no space goes.
NO_SPACE_BEFORE = "'’,.!?:;，。！？"
NO_SPACE_AFTER = "-—/"
INLINE_TIME = r"<\d{1,2}:\d{2}:\d{2}[.,]\d{3}>"
ANY_TAG = "<[^>]*>"
CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f]"
INVISIBLE = r"[\x{200b}-\x{200f}\x{202a}-\x{202e}\x{2060}\x{feff}]"
CAPTION_TAG = r"</?(?:c(?:\.[^ >]+)?|v|lang|b|i|u|ruby|rt)[^>]*>|<\d{2}:\d{2}[^>]*>"
HIDDEN = r"[\p{Cc}\p{Cf}&&[^\n\t]]"
JOINT = "\u0001"


def let(value: Column, body) -> Column:
    """body(value) with the value worked out once: inside functions over arrays an expression is worked out for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def unescape(text: Column) -> Column:
    for entity, sign in ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(sign))
    return text


def squeeze(text: Column) -> Column:
    """White space runs to one space, none at the ends."""
    return F.trim(F.regexp_replace(text, SPACE, " "))


def first_words(text: Column, n: int) -> Column:
    """The first n parts between single spaces; what follows them is not parted."""
    return F.array_join(F.slice(F.split(text, " ", n + 1), 1, n), " ")


def normalized(text: Column) -> Column:
    """Entities resolved, lower case, single spaces; null is empty.

    Most texts hold neither entities nor white space but lone spaces and line ends, so a cheap search tells whether the costly steps are due.
    """
    spaced = F.replace(F.coalesce(text, F.lit("")), F.lit("\n"), F.lit(" "))
    plain = let(spaced, lambda own: F.when(own.contains("&"), unescape(own)).otherwise(own))
    return F.lower(F.trim(let(plain, lambda own: F.when(own.contains("  ") | own.rlike(OTHER_SPACE), F.regexp_replace(own, SPACE, " ")).otherwise(own))))


def phrase_pattern(phrase: str) -> str:
    """The phrase first, then what may not stand before and after it: a search goes by its first sign, not by a look back at each place."""
    plain = re.escape(" ".join(phrase.lower().split()))
    return f"{plain}(?<!{WORD}{plain})(?!{WORD})"


def has_phrase(text: Column, phrase: str) -> Column:
    """The whole phrase stands in the normalised text: no word sign touches it. The cheap search goes first."""
    plain = " ".join(phrase.lower().split())
    return F.lit(False) if not plain else text.contains(plain) & text.rlike(phrase_pattern(phrase))


def phrase_hits(text: Column, phrases: Sequence[str]) -> Column:
    """The phrases that stand in the normalised text, in the order of the list."""
    if not phrases:
        return F.array().cast("array<string>")
    return F.array_compact(F.array(*[F.when(has_phrase(text, p), F.lit(p)) for p in phrases]))


def tokens(text: Column) -> Column:
    """Words between white space."""
    return F.filter(F.split(squeeze(text), " "), lambda t: t != "")


def token_key(token: Column) -> Column:
    return F.lower(F.regexp_replace(token, f"^{NOT_WORD}+|{NOT_WORD}+$", ""))


def event_tokens(title: Column, stop_words: Sequence[str]) -> Column:
    """Distinct words of two or more signs, in order of first use, punctuation and stop words left out."""
    clean = F.regexp_replace(normalized(title), r"[^\p{L}\p{N}_\s]", " ")
    return F.array_except(F.array_distinct(F.filter(tokens(clean), lambda t: F.length(t) > 1)), F.array(*[F.lit(w.lower()) for w in stop_words]).cast("array<string>"))


def jaccard(left: Column, right: Column) -> Column:
    """Share of the union that two arrays have in common; 0 if both are empty."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(left, right)), F.size(F.array_union(left, right))), F.lit(0.0))


def smart_join(parts: Column) -> Column:
    """Parts joined with spaces, except between Chinese characters, after a dash or slash and before punctuation."""
    joined = F.array_join(F.filter(F.transform(parts, lambda p: squeeze(p)), lambda p: p != ""), JOINT)
    joined = F.regexp_replace(joined, f"(?<={CJK}){JOINT}(?={CJK})", "")
    joined = F.regexp_replace(joined, f"(?<=[{NO_SPACE_AFTER}]){JOINT}|{JOINT}(?=[{NO_SPACE_BEFORE}])", "")
    return squeeze(F.replace(joined, F.lit(JOINT), F.lit(" ")))


def drop_repeats(text: Column) -> Column:
    """Words equal to the word before, but for case and outer punctuation, go; words without any key stay."""

    def kept(words: Column, keys: Column) -> Column:
        pairs = F.zip_with(words, keys, lambda t, k: F.struct(t.alias("t"), k.alias("k")))
        return F.transform(F.filter(pairs, lambda p, i: (i == 0) | (p["k"] == "") | (p["k"] != F.get(keys, i - 1))), lambda p: p["t"])

    return let(tokens(text), lambda words: let(F.transform(words, token_key), lambda keys: smart_join(kept(words, keys))))


def _distinct_lines(text: Column, key) -> Column:
    """Lines squeezed, empty ones left out, and those equal to the line kept before by `key`."""
    lines = F.filter(F.transform(F.split(text, r"\r\n|\r|\n"), lambda x: squeeze(x)), lambda x: x != "")
    return let(lines, lambda own: let(F.transform(own, key), lambda keys: F.filter(own, lambda x, i: (i == 0) | (F.get(keys, i) != F.get(keys, i - 1)))))


def clean_visible(text: Column) -> Column:
    """What a viewer sees: tags and inline times out, entities resolved, hidden characters out, equal neighbouring lines once."""
    bare = F.regexp_replace(F.regexp_replace(text, INLINE_TIME, ""), ANY_TAG, "")
    return smart_join(_distinct_lines(F.regexp_replace(unescape(bare), HIDDEN, ""), lambda x: x))


def clean_timed(text: Column) -> Column:
    """The same for captions with word times: an inline time separates words, and neighbouring lines are compared in normal form."""
    bare = F.regexp_replace(F.regexp_replace(text, INLINE_TIME, " "), ANY_TAG, "")
    return F.array_join(_distinct_lines(F.regexp_replace(unescape(bare), HIDDEN, ""), comparable), " ")


def comparable(text: Column) -> Column:
    """Straight quotes, no tags, single spaces, lower case."""
    straight = F.translate(unescape(text), "“”’", "\"\"'")
    return F.lower(squeeze(F.regexp_replace(straight, ANY_TAG, "")))


def recognised(text: Column) -> Column:
    """Recogniser text: single spaces, none before punctuation."""
    return F.regexp_replace(squeeze(text), r"\s+([,.;:!?])", "$1")


def cjk_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(CJK_SPAN))


def utf16_units(text: Column) -> Column:
    return (F.octet_length(F.encode(text, "UTF-16BE")) / 2).cast("int")


def utf8_bytes(text: Column) -> Column:
    return F.octet_length(text)


def _truncate(text: Column, most: int | Column, size, suffix: str) -> Column:
    most = F.lit(most) if isinstance(most, int) else most
    return let(text, lambda own: _cut(own, most, size, suffix))


def _cut(text: Column, most: Column, size, suffix: str) -> Column:
    ending = F.when(size(F.lit(suffix)) <= most, F.lit(suffix)).otherwise(F.lit(""))
    budget = most - size(ending)
    step = lambda acc, ch: F.when(acc["full"] | (acc["used"] + size(ch) > budget), F.struct(acc["used"].alias("used"), acc["n"].alias("n"), F.lit(True).alias("full"))).otherwise(
        F.struct((acc["used"] + size(ch)).alias("used"), (acc["n"] + 1).alias("n"), F.lit(False).alias("full"))
    )
    # a sign takes one unit at least, so the first `most` signs decide; the rest of a long text is not parted
    signs = F.filter(F.split(F.substring(text, F.lit(1), F.greatest(most, F.lit(0))), ""), lambda c: c != "")
    kept = F.aggregate(signs, F.struct(F.lit(0).alias("used"), F.lit(0).alias("n"), F.lit(False).alias("full")), step, lambda acc: acc["n"])
    cut = F.concat(F.rtrim(F.substring(text, F.lit(1), kept)), ending)
    return F.when(most <= 0, F.lit("")).when(size(text) <= most, text).otherwise(cut)


def truncate_utf16(text: Column, most: int | Column, suffix: str = "…") -> Column:
    """At most `most` UTF-16 units, never half a character, the suffix included."""
    return _truncate(text, most, utf16_units, suffix)


def truncate_utf8(text: Column, most: int | Column, suffix: str = "…") -> Column:
    """At most `most` UTF-8 bytes, never part of a character, the suffix included."""
    return _truncate(text, most, utf8_bytes, suffix)


def two_lines(text: Column, width: int = 44, at_width: bool = False) -> Column:
    """Texts over `width` break once, at the space nearest the middle (the first of equals); without a space in the middle, or at `width` if `at_width`."""

    def broken(text: Column) -> Column:
        n = F.length(text)
        middle = (n / 2) if at_width else F.floor(n / 2)
        spaces = F.filter(F.transform(F.split(text, ""), lambda c, i: F.when(c == " ", i)), lambda i: i.isNotNull())
        nearest = F.array_min(F.transform(spaces, lambda p: F.struct(F.abs(p - middle).alias("off"), p.alias("at"))))["at"]
        cut = F.coalesce(nearest, F.least(F.lit(width), n) if at_width else middle).cast("int")
        return F.when(n <= width, text).otherwise(F.concat(F.trim(F.substring(text, F.lit(1), cut)), F.lit("\n"), F.trim(F.substring(text, cut + 1, n))))

    return let(squeeze(text), broken)


def overlap_size(left: Column, right: Column) -> Column:
    """The most keys, two or more, that end `left` and begin `right`, none of them empty; 0 if there are none."""

    def most(pair: Column) -> Column:
        a, b = pair["a"], pair["b"]
        n = F.least(F.size(a), F.size(b))
        sizes = F.when(n >= 2, F.sequence(F.lit(2), n)).otherwise(F.array().cast("array<int>"))
        # a run can only fit where its first key begins `b`, which few places do
        fits = F.filter(sizes, lambda k: (F.element_at(a, -k) == F.element_at(b, 1)) & (F.slice(a, -k, k) == F.slice(b, F.lit(1), k)) & ~F.array_contains(F.slice(b, F.lit(1), k), ""))
        return F.coalesce(F.array_max(fits), F.lit(0))

    return let(F.struct(left.alias("a"), right.alias("b")), most)


def width_units(text: Column) -> Column:
    """Display width: a Chinese character 1, a space 0.32, an ASCII letter or digit 0.56, all else 0.52."""
    cjk, space, latin = (F.regexp_count(text, F.lit(p)) for p in (CJK_SPAN, r"(?U)\s", "[A-Za-z0-9]"))
    return cjk * 1.0 + space * 0.32 + latin * 0.56 + (F.length(text) - cjk - space - latin) * 0.52


def safe_int(value: Column) -> Column:
    """A whole number, 0 for null or anything else."""
    return F.coalesce(value.try_cast("bigint"), F.lit(0).cast("bigint"))


def rounded(value: Column, places: int) -> Column:
    """A double rounded by its scaled value, half away from zero, as engines of doubles do; `F.round` takes the shortest decimal form instead, which differs where a value is written like a tie."""
    return F.round(value * float(10**places)) / float(10**places)
