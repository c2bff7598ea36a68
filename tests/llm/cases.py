"""Rows that every operator has to stand: nulls, empty and blank texts, ties, repeated rows, one very long text and clashing columns."""

import random

import duckdb

SF = "/root/testdata/sf0.001"
LONG = " ".join(f"w{i % 977}{chr(97 + i % 26)}" for i in range(40_000))
ROWS = [
    (1, "The same text here, told once and then again.", "a"), (2, "The same text here, told once and then again.", "a"), (2, "The same text here, told once and then again.", "a"),
    (3, None, "a"), (4, "", None), (5, " \t\n", "b"), (None, "A text without an id stands here for once.", "b"), (None, None, None),
    (6, "one two", "c"), (7, LONG, "c"), (8, LONG + " tail", "c"), (9, "ſtraße 😀 ça va İ <|endoftext|>", "d"), (10, "THE SAME text here, told once and then again.", "a"),
]


def edge_docs(spark):
    """documents with extra columns whose names clash with those of the operators."""
    rows = [(*r, "x", 1, 2, True, 3) for r in ROWS]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, fp int, h int, kept boolean, label int")


def corpus(n=200):
    return duckdb.sql(f"SELECT doc_id, text, source FROM '{SF}/documents.parquet' ORDER BY doc_id LIMIT {n}").fetchall()


def near_copies(n, seed=1):
    """Chains of small changes to one text."""
    rng = random.Random(seed)
    words = [f"{rng.choice('abcdefgh')}{rng.randrange(500)}" for _ in range(400)]
    out = []
    for _ in range(n):
        words = list(words)
        words[rng.randrange(len(words))] = f"z{rng.randrange(10**6)}"
        out.append(" ".join(words))
    return out


def empty(spark, schema="doc_id long, text string, source string"):
    return spark.createDataFrame([], schema)
