"""Ids, links, log lines and fingerprints, as columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

ID = r"[A-Za-z0-9_-]{11}"
# Marks of errors that pass by themselves and of those that ask for a sign-in.
TRANSIENT = (
    "eof occurred in violation of protocol", "ssl", "tls", "connection reset", "connection aborted", "remote end closed", "incompleteread", "timed out", "timeout",
    "temporary failure", "http error 429", "http error 500", "http error 502", "http error 503", "http error 504",
)
SIGN_IN = ("sign in", "login", "age-restricted", "age restricted", "confirm you're not a bot", "cookies")
RESPONSE = r'(?s)ResponseData\s*\{\s*code:\s*(-?\d+).*?message:\s*"([^"]*)"'
PUBLISHED_ID = r"\b(BV[0-9A-Za-z]{10})\b"


def _some(found: Column) -> Column:
    return F.when(found != "", found)


def video_id(text: Column) -> Column:
    """The id in a bare id or a watch, short, embed, live or shortened link; null for anything else."""
    t = F.trim(text)
    host = r"^(?:https?://)?(?:www\.|m\.|music\.)?youtube\.com"
    return F.coalesce(
        _some(F.regexp_extract(t, f"^({ID})$", 1)), _some(F.regexp_extract(t, rf"^(?i)(?:https?://)?(?:www\.)?youtu\.be/({ID})(?:[/?#].*)?$", 1)),
        _some(F.regexp_extract(t, rf"^(?i){host[1:]}/watch/?\?(?:[^#]*&)?v=({ID})(?:[&#].*)?$", 1)), _some(F.regexp_extract(t, rf"^(?i){host[1:]}/(?:shorts|embed|live)/({ID})(?:[/?#].*)?$", 1)),
    )


def video_ids(text: Column) -> Column:
    """struct(ids, rejected) of a list parted by white space, commas or semicolons: ids in order of first use."""
    items = F.filter(F.split(text, r"[\s,，;；]+"), lambda x: x != "")
    return F.struct(F.array_distinct(F.array_compact(F.transform(items, video_id))).alias("ids"), F.filter(items, lambda x: video_id(x).isNull()).alias("rejected"))


def redacted(line: Column) -> Column:
    """Cookie paths and values of keys, tokens and signatures masked, links cut to host, path and video."""
    out = F.regexp_replace(line, r"(?i)(--cookies\s+)(\S+)", "$1<cookies_file>")
    out = F.regexp_replace(out, r"(?i)\S*(?:api[_-]?key|token|signature)=\S*", "<redacted>")
    out = F.regexp_replace(out, r"(?i)(https?://[^\s?#]+)\?(?:[^\s#]*&)?v=([^\s&#]+)[^\s]*", "$1\u0001v=$2")
    return F.replace(F.regexp_replace(out, r"(?i)(https?://[^\s?#\x01]+)[?#]\S*", "$1"), F.lit("\u0001"), F.lit("?"))


def error_class(text: Column) -> Column:
    """transient, sign_in, rejected or other."""
    low = F.lower(text)
    has = lambda marks: reduce(lambda a, b: a | b, [low.contains(m) for m in marks])
    return F.when(text.rlike(RESPONSE), "rejected").when(has(TRANSIENT), "transient").when(has(SIGN_IN), "sign_in").otherwise("other")


def response(text: Column) -> Column:
    """struct(code, message, published_id) of an upload log."""
    return F.struct(_some(F.regexp_extract(text, RESPONSE, 1)).cast("int").alias("code"), _some(F.regexp_extract(text, RESPONSE, 2)).alias("message"), _some(F.regexp_extract(text, PUBLISHED_ID, 1)).alias("published_id"))


def fingerprint(*columns: str) -> Column:
    """SHA-256 of the columns as JSON, in the order of their names: only what affects an output goes in."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)
