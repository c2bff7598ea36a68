import hashlib
import itertools
import math
import random
import re
import time
from collections import Counter

from cuefold.llm import secret_scan
from tests.llm.cases import corpus

LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
KEYED = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"


def test_letters_only_keys_and_parts_beside_base_matches(spark):
    rng = random.Random(3)
    key = lambda signs, n: "".join(rng.choices(signs, k=n))
    rows = [(i, t) for i, t, _ in corpus(200)]
    rows += [(1000 + i, f'some words token = "{key(KEYED, 32)}" and more words') for i in range(150)]
    letters = {3000 + i: key(LETTERS, 20) for i in range(20)}
    rows += [(i, f"key id {k} here") for i, k in letters.items()]
    names = ["international_conversation", "see_the_other_documentation", "http_request_handler_for_page_2", "----------------------------"]
    rows += [(4000 + i, f"see {n} there") for i, n in enumerate(names)]
    rest = key(LETTERS, 24)
    rows += [(5000, f"x {rest}-{hashlib.md5(b'x').hexdigest()} y")]
    found = {r["doc_id"]: r["spans"] for r in secret_scan.secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(found[i] == "markov:7:27" for i in letters) >= 18, [found[i] for i in letters]
    assert [found[4000 + i] for i in range(len(names))] == [""] * len(names)
    assert "markov:2:27" in found[5000] and "hex:27:59" in found[5000]


def test_very_long_texts(spark):
    """One unbroken string of a million signs, and one text of thousands of matches, take seconds."""
    rng = random.Random(4)
    whole = "".join(rng.choices(KEYED, k=1_000_000))
    many = " ".join(f"token={''.join(rng.choices(KEYED, k=20))} x" for _ in range(4_000))
    rows = [(i, t) for i, t, _ in corpus(100)] + [(5_000, whole), (5_001, many)] + [(6_000 + i, f'token = "{"".join(rng.choices(KEYED, k=32))}"') for i in range(100)]
    started = time.monotonic()
    found = {r["doc_id"]: r for r in secret_scan.secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found[5_000]["spans"].endswith("markov:0:1000000") and found[5_001]["n_assign"] == 4_000
    assert found[5_001]["base_sha256"] == hashlib.sha256(",".join(f"assign:{m.start()}:{m.end()}" for m in re.finditer(r"token=\w+", many)).encode()).hexdigest()
    assert time.monotonic() - started < 120


ORDINARY = [
    "/usr/share/local/bin/python", "src/main/java/com/example/App", "org/wiki/some_page_name", "//www/en-us/articles/about-us", "get_user_name_by_id_v2", "AbstractSingletonProxyFactoryBean",
    "550e8400-e29b-41d4-a716-446655440000", "my-first-blog-post-about-cats", "2024-05-17-release-notes", "----------------------------", "=-=-=-=-=-=-=-=-=-=", "internationalization_and_localization",
    "application/x-www-form-urlencoded", "HTTP_RESPONSE_STATUS_CODE_404", "thisIsACamelCaseVariableName", "usr/lib/x86_64-linux-gnu/libc", "Wirtschaftswissenschaften", "20240517-123456-backup-file", "node_modules/react-dom/umd/react-dom",
]


def test_paths_and_identifiers_are_no_secrets(spark):
    """Ordinary strings of many shapes, none of them in the training texts, and random keys of several alphabets."""
    rng = random.Random(11)
    rows = [(i, t) for i, t, _ in corpus(200)] + [(10_000 + i, f"see {x} there") for i, x in enumerate(ORDINARY)]
    for k, (signs, n) in enumerate(((KEYED, 20), (KEYED + "+/", 40), (LETTERS, 24), (KEYED[26:], 24), ("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", 20))):
        rows += [(20_000 + 1_000 * k + i, f"see {''.join(rng.choices(signs, k=n))} there") for i in range(60)]
    found = {r["doc_id"]: r["spans"] for r in secret_scan.secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [x for i, x in enumerate(ORDINARY) if "markov" in found[10_000 + i]] == []
    for k in range(5):
        assert sum("markov:4:" in found[20_000 + 1_000 * k + i] for i in range(60)) >= 58, k


def plain_ratios(samples):
    """The model of labelled strings by counting dictionaries, sign by sign."""
    kinds = lambda c: next((k for k, x in enumerate(secret_scan.SORTS) if c in x), 4)
    signs = ["", *secret_scan.SIGNS]
    model = {}
    for label in (0, 1):
        pairs = Counter((a if a in secret_scan.SIGNS else "", b if b in secret_scan.SIGNS else "") for k, v in samples if k == label for a, b in zip(v, v[1:], strict=False))
        first, follow, seen = Counter(), Counter(), Counter(signs)
        for (a, b), n in pairs.items():
            first[a] += n
            seen[b] += n
            follow[kinds(a) if a else 4, kinds(b) if b else 4] += n
        kind = lambda c: kinds(c) if c else 4
        for a in signs:
            for b in signs:
                total = sum(follow[kind(a), k] + 1 for k in range(5))
                back = (follow[kind(a), kind(b)] + 1) / total * seen[b] / sum(seen[c] for c in signs if kind(c) == kind(b))
                own = pairs[a, b] / first[a] if first[a] else back
                model[label, a, b] = math.log(0.85 * own + 0.15 * back)
    return {(a, b): model[1, a, b] - model[0, a, b] for a in signs for b in signs}


def test_spans_against_plain_ratios(spark):
    """Which runs the models call, from the same labelled strings, by dictionaries instead of columns."""
    rng = random.Random(12)
    rows = [(i, t) for i, t, _ in corpus(120)] + [(9_000 + i, f'token="{"".join(rng.choices(KEYED, k=24))}" {"".join(rng.choices(KEYED, k=18))} some-other_words/here') for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = secret_scan.findings(docs)
    samples = [tuple(r) for r in secret_scan.labelled(docs, found).select("label", "value", "held_out").collect()]
    assert {x[0] for x in samples} == {0, 1} and 0.1 < sum(x[2] for x in samples) / len(samples) < 0.3
    want = plain_ratios([x[:2] for x in samples if not x[2]])
    model, threshold = secret_scan.train(docs, found)
    n = len(secret_scan.SIGNS) + 1
    signs = ["", *secret_scan.SIGNS]
    assert all(abs(model[i * n + j] - want[a, b]) < 1e-9 for i, a in enumerate(signs) for j, b in enumerate(signs))
    for r in secret_scan.secrets(docs).collect():
        text, spans = dict(rows)[r["doc_id"]], [s.split(":") for s in r["spans"].split(",") if s]
        base = [(int(a), int(b)) for k, a, b in spans if k != "markov"]
        runs = []
        for m in re.finditer(secret_scan.CANDIDATE, text):
            free = [i for i in range(m.start(), m.end()) if not any(a <= i < b for a, b in base)]
            for _, g in itertools.groupby(enumerate(free), lambda x: x[1] - x[0]):
                part = [i for _, i in g]
                value = text[part[0] : part[-1] + 1]
                mean = sum(want[a, b] for a, b in zip(value, value[1:], strict=False)) / max(1, len(value) - 1)
                if len(value) >= 16 and mean > threshold and not re.search(secret_scan.SHAPES, value):
                    runs.append((part[0], part[-1] + 1))
        assert runs == [(int(a), int(b)) for k, a, b in spans if k == "markov"], r["doc_id"]
