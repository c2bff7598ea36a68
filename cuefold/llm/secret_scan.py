"""Secret scans: fixed patterns, and character Markov models of random strings and ordinary identifiers. DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuefold.llm.common import drop_staged, least_hashed, staged, text_or_empty

ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_HEAD = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]"""
ACCESS = r"AKIA[A-Z0-9]+"
#: A maximal run of 16 or more: what [0-9a-f]+ finds, less its shorter matches.
HEX = r"[0-9a-f]{16,}"
SIGNS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}+"
LEAST = 16
#: Words as they stand in texts; longer ones may be what is searched for.
WORD = r"(?<![A-Za-z0-9+/_=-])[A-Za-z]{2,15}+(?![A-Za-z0-9+/_=-])"
#: Strings of a fixed shape that are no secrets: UUIDs, and rules of one or two signs over and over.
SHAPES = r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$|^(..?)\2*.?$"
#: What a pair of signs that was rarely seen is taken from, instead of its own count: pairs of these kinds of signs.
SORTS = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", "+/_=-")
#: How much of a pair's probability comes from its kinds: letters of a language that the samples lack go with others of their kind.
BELIEF = 0.15
KINDS = ("assign", "access", "hex", "markov")
#: Matches of a text whose places are summed up together.
CHUNK = 128
#: The least mean ratio of a random string.
LOWEST = 0.1
SPAN = "array<struct<start:int,stop:int,value:string>>"


def _let(value: Column, body) -> Column:
    """`body` of `value`, which is worked out once however often the body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def spans(text: Column, pattern: str, group: int = 0) -> Column:
    """start, stop (code points, end exclusive) and the value of `group` for each match, leftmost first, none overlapping.

    The pieces between the matches and the matches together are the text, so places are sums of their lengths, made chunk by chunk, since
    each step copies the array it adds to.
    """
    gaps, whole = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = whole if not group else F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    zipped = F.arrays_zip(F.slice(gaps, F.lit(1), F.size(whole)).alias("gap"), whole.alias("hit"), values.alias("value"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        stop = start + F.length(x["hit"])
        return F.struct(stop.alias("at"), F.concat(acc["out"], F.array(F.struct(start.alias("start"), stop.alias("stop"), x["value"].alias("value")))).alias("out"))

    def placed(c: Column) -> Column:
        return F.aggregate(c["own"], F.struct(c["begin"].alias("at"), F.array().cast(SPAN).alias("out")), step, lambda acc: acc["out"])

    def all_placed(chunks: Column) -> Column:
        sizes = F.transform(chunks, lambda own: F.aggregate(own, F.lit(0), lambda acc, x: acc + F.length(x["gap"]) + F.length(x["hit"])))
        begins = F.aggregate(sizes, F.array(F.lit(0)), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))
        return F.flatten(F.transform(F.zip_with(chunks, F.slice(begins, F.lit(1), F.size(chunks)), lambda own, n: F.struct(own.alias("own"), n.alias("begin"))), placed))

    def cut(z: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor(F.size(z) / CHUNK).cast("int")), lambda k: F.slice(z, k * CHUNK + 1, F.lit(CHUNK)))

    return _let(zipped, lambda z: _let(cut(z), all_placed))


def _only_if(condition: Column, found: Column) -> Column:
    return F.when(condition, found).otherwise(F.array().cast(SPAN))


def findings(docs: DataFrame) -> DataFrame:
    """(doc_id, assign, access, hex, others): the base matches of each row's whole text, and the runs of 16 or more signs, which the models judge."""
    text = text_or_empty()
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    t = F.col("text")
    assign = F.filter(_only_if((F.instr(t, "=") > 0) | (F.instr(t, ":") > 0), _only_if(t.rlike(ASSIGN_HEAD), spans(t, ASSIGN, 2))), lambda s: F.length(s["value"]) >= 12)
    access = F.filter(_only_if(F.instr(t, "AKIA") > 0, spans(t, ACCESS)), lambda s: F.length(s["value"]) >= 18)
    hexes = _only_if(t.rlike(HEX), spans(t, HEX))
    others = _only_if(t.rlike(CANDIDATE), spans(t, CANDIDATE))
    return base.select("doc_id", assign.alias("assign"), access.alias("access"), hexes.alias("hex"), others.alias("others"))


def _pairs(value: Column) -> Column:
    """For each pair of neighbouring signs its place in a (n + 1) x (n + 1) table; a sign outside the alphabet counts as 0, the others from 1."""
    n = len(SIGNS) + 1
    places = F.transform(F.split(value, ""), lambda c: F.instr(F.lit(SIGNS), c))
    size = F.greatest(F.size(places) - 1, F.lit(0))
    return F.zip_with(F.slice(places, F.lit(1), size), F.slice(places, F.lit(2), size), lambda a, b: a * n + b)


def _identifiers(text: Column) -> tuple[Column, Column]:
    """(words, names): the words of a text, and, of a column `words`, names as programs and addresses have them, made of each four words of a text that follow each other: snake, kebab and camel case, paths, dates and numbers in them, by a hash of the words."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))

    def name(k: Column) -> Column:
        own = [F.get(words_, k * 4 + i) for i in range(4)]
        low, big = [F.lower(w) for w in own], [F.initcap(w) for w in own]
        h = F.pmod(F.xxhash64(*own), F.lit(1_000_000))
        year, month, day = F.lit(1990) + h % 40, F.lpad((h % 12 + 1).cast("string"), 2, "0"), F.lpad((h % 28 + 1).cast("string"), 2, "0")
        made = [
            F.concat_ws("_", *low), F.concat_ws("-", *low), F.concat(F.lit("/"), F.concat_ws("/", *low)), F.concat(low[0], *big[1:]), F.concat(*big), F.concat_ws("/", *low[:2], F.concat(*big[2:])), F.upper(F.concat_ws("_", *own)),
            F.concat_ws("/", low[0], year, month, day, F.concat_ws("-", *low[1:])), F.concat(F.concat_ws("_", *low), F.lit("_v"), h % 20), F.concat_ws("-", low[0], year, month, day, low[1], low[2]), F.concat(F.lit("//"), F.concat_ws("/", *low[:3]), F.lit("="), low[3]),
            F.concat(low[0], h % 100, F.lit("_"), *big[1:3], h % 10),
        ]
        return F.element_at(F.array(*made), (F.floor(h / 97) % len(made) + 1).cast("int"))

    words_ = F.col("words")
    return words, F.transform(F.sequence(F.lit(0), F.greatest(F.floor(F.size(words_) / 4).cast("int"), F.lit(1)) - 1), name)


def _keys(value: Column) -> Column:
    """A random string made of a string: its SHA-512 in base64, the letters and digits or the letters of that, in capitals too, or its SHA-256 in hex, by a hash."""
    base64 = F.regexp_replace(F.base64(F.unhex(F.sha2(value, 512))), r"\s", "")
    joined = F.regexp_replace(base64, "[+/=]", "")
    made = [F.left(base64, F.lit(40)), F.left(joined, F.lit(32)), F.left(F.regexp_replace(joined, "[0-9]", ""), F.lit(32)), F.upper(F.left(joined, F.lit(24))), F.lower(F.left(joined, F.lit(24))), F.left(F.sha2(value, 256), F.lit(32))]
    return F.element_at(F.array(*made), (F.pmod(F.xxhash64(value), F.lit(len(made))) + 1).cast("int"))


def labelled(docs: DataFrame, found: DataFrame, samples: int = 20_000, sample_docs: int = 2_000) -> DataFrame:
    """(label, value, held_out): 1, at most `samples` secret values of the base matches, those of least hash, and a random string made of a fourth of the others; 0, in at most `sample_docs` documents of least hash of doc_id
    the words, and the identifiers made of them, at most twice `samples` of least hash. A fifth of both, by hash, is held out."""
    values = found.select(F.explode(F.concat(*[F.transform(k, lambda s: s["value"]) for k in KINDS[:3]])).alias("value"))
    random = least_hashed(values.distinct(), "value", samples).select(F.lit(1).alias("label"), "value")
    ids = least_hashed(docs.select(F.col("doc_id").cast("long").alias("i")).where("i is not null").distinct(), "i", sample_docs)
    chosen = docs.join(F.broadcast(ids), docs["doc_id"].cast("long") == ids["i"], "left_semi")  # at most sample_docs ids
    words, names = _identifiers(text_or_empty())
    names = chosen.select(words.alias("words")).select(F.explode(F.concat(names, F.filter("words", lambda w: F.length(w) >= 4))).alias("value")).where("value is not null")
    ordinary = least_hashed(names, "value", 2 * samples).select(F.lit(0).alias("label"), "value")
    made = ordinary.where(F.pmod(F.xxhash64("value", F.lit(2)), F.lit(4)) == 0).select(F.lit(1).alias("label"), _keys(F.col("value")).alias("value"))
    return random.unionByName(made).unionByName(ordinary).withColumn("held_out", F.pmod(F.xxhash64("value", F.lit(1)), F.lit(5)) == 0)


def log_ratios(counts: dict[tuple[int, int], int]) -> list[float]:
    """For each pair of signs the log-likelihood ratio of random strings (label 1) to ordinary ones (0), from {(label, pair): n}.

    A pair's probability is that of its own counts, and for a part of `BELIEF`, or where there are none, what the kinds of both signs tell:
    how often a sign of the one kind follows one of the other, and how often it is this one of its kind.
    """
    n = len(SIGNS) + 1
    sort = [len(SORTS), *(next(k for k, x in enumerate(SORTS) if c in x) for c in SIGNS)]
    size = [sort.count(k) for k in range(len(SORTS) + 1)]
    logs = []
    for label in (1, 0):
        table = [[counts.get((label, a * n + b), 0) for b in range(n)] for a in range(n)]
        follows = [[1 + sum(table[a][b] for a in range(n) if sort[a] == x for b in range(n) if sort[b] == y) for y in range(len(size))] for x in range(len(size))]
        seen = [1 + sum(table[a][b] for a in range(n)) for b in range(n)]
        of_kind = [sum(seen[b] for b in range(n) if sort[b] == k) for k in range(len(size))]
        by_kind = lambda a, b: follows[sort[a]][sort[b]] / sum(follows[sort[a]]) * seen[b] / of_kind[sort[b]]  # noqa: B023, E731
        own = lambda a, b: table[a][b] / sum(table[a]) if sum(table[a]) else by_kind(a, b)  # noqa: B023, E731
        logs.append([math.log((1 - BELIEF) * own(a, b) + BELIEF * by_kind(a, b)) for a in range(n) for b in range(n)])
    return [x - y for x, y in zip(*logs, strict=True)]


def train(docs: DataFrame, found: DataFrame, samples: int = 20_000, sample_docs: int = 2_000) -> tuple[list[float], float]:
    """(model, threshold) of `labelled` samples: the ratio of each pair of signs, and the mean ratio above which a string is called random.

    The threshold is what one in a thousand of the held-out ordinary strings of 16 or more signs exceeds, `LOWEST` at least, as a string with
    a mean ratio of 0 is as likely the one as the other. Tables have a fixed size, whatever the input.
    """
    rows = staged(labelled(docs, found, samples, sample_docs), "labelled")
    pairs = rows.where("not held_out").select("label", F.explode(_pairs(F.col("value"))).alias("pair"))
    model = log_ratios({(r["label"], r["pair"]): r["count"] for r in pairs.groupBy("label", "pair").count().collect()})  # at most 2 n * n rows
    held = rows.where("held_out").where(F.length("value") >= LEAST).withColumn("ratio", ratio(F.col("value"), model))
    high = held.where("label = 0").agg(F.percentile_approx("ratio", 0.999, 10_000)).first()[0]
    drop_staged(rows)
    return model, max(LOWEST, high if high is not None else LOWEST)


def ratio(value: Column, model: list[float]) -> Column:
    """The mean log-likelihood ratio of a string's sign pairs."""
    pairs = _pairs(value)
    weights = F.lit(model)
    return F.aggregate(pairs, F.lit(0.0), lambda acc, p: acc + F.element_at(weights, p + 1)) / F.greatest(F.size(pairs), F.lit(1))


def _free(run: Column, base: Column) -> Column:
    """The parts of a run, of 16 or more signs each, that no base match covers."""
    zero = F.struct(run["start"].alias("at"), F.array().cast(SPAN).alias("out"))

    def part(start: Column, stop: Column) -> Column:
        value = F.substring(run["value"], start - run["start"] + 1, stop - start)
        return F.when(stop - start >= LEAST, F.array(F.struct(start.alias("start"), stop.alias("stop"), value.alias("value")))).otherwise(F.array().cast(SPAN))

    def step(acc: Column, b: Column) -> Column:
        return F.struct(F.greatest(acc["at"], b["stop"]).alias("at"), F.concat(acc["out"], part(acc["at"], b["start"])).alias("out"))

    hit = F.filter(base, lambda b: (b["start"] < run["stop"]) & (run["start"] < b["stop"]))
    return F.aggregate(F.array_sort(hit), zero, step, lambda acc: F.concat(acc["out"], part(acc["at"], run["stop"])))


def _placed(found: Column, kind: int) -> Column:
    return F.transform(found, lambda s: F.struct(s["start"].alias("start"), F.lit(kind).alias("k"), s["stop"].alias("stop")))


def secrets(docs: DataFrame, threshold: float | None = None, samples: int = 20_000, sample_docs: int = 2_000) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_markov) for each row of `docs` (doc_id, text).

    The base matches are those of the three patterns. A string of 16 or more signs, or a part of one outside the base matches of that
    length, whose mean log-likelihood ratio exceeds the threshold of training (or `threshold`) is a further span of kind `markov`; base ones stay.
    UUIDs are none. A null or empty text has none.
    A text's time grows with its length, and with the product of its long runs and its base matches.
    Repeated rows give repeated rows; an empty table gives none.
    """
    found = staged(findings(docs), "findings")
    model, learnt = train(docs, found, samples, sample_docs)
    least = learnt if threshold is None else threshold
    base = F.concat(*[_placed(F.col(k), n) for n, k in enumerate(KINDS[:3])])
    parts = F.flatten(F.transform("others", lambda o: _free(o, F.col("base"))))
    more = F.filter(parts, lambda o: (ratio(o["value"], model) > least) & ~o["value"].rlike(SHAPES))
    more = _placed(more, 3)
    names = F.array(*[F.lit(k) for k in KINDS])
    told = lambda a: F.array_join(F.transform(F.array_sort(a), lambda s: F.concat_ws(":", F.element_at(names, s["k"] + 1), s["start"], s["stop"])), ",")
    out = found.withColumn("base", base).withColumn("more", more)
    size = lambda c: F.size(c).cast("long")
    return out.select(
        "doc_id", size("assign").alias("n_assign"), size("access").alias("n_access"), size("hex").alias("n_hex"),
        F.sha2(told(F.col("base")), 256).alias("base_sha256"), told(F.concat("base", "more")).alias("spans"), size("more").alias("n_markov"),
    )
