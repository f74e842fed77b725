import hashlib
import math
import random
import re
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from millrace.llm import secrets
from millrace.llm.columns import cut_spans, prefix_sums, running_max

SCHEMA = "doc_id bigint, text string, id string, found string, n_chars bigint"
ASSIGN = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def peak(s):
    return max(sum(-c / secrets.WINDOW * math.log2(c / secrets.WINDOW) for c in Counter(s[i : i + secrets.WINDOW]).values()) for i in range(len(s) - secrets.WINDOW + 1))


def brute(text):
    text = text or ""
    base = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    base += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    base += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    fresh = []
    for m in re.finditer(secrets.CANDIDATE, text):
        s = m[0]
        if any(re.search(p, s) for p in secrets.ALLOWED) or not all(re.search(p, s) for p in secrets.MIXED):
            continue
        hexa = re.fullmatch("(0[xX])?[0-9A-Fa-f]+", s)
        if peak(s.lower() if hexa else s) >= (3.0 if hexa else 4.0) - 1e-12 and not any(a <= m.start() and m.end() <= b for a, _, b in base):
            fresh.append((m.start(), 3, m.end()))
    names = ["assign", "access", "hex", "entropy"]
    form = lambda spans: ",".join(f"{names[k]}:{a}:{b}" for a, k, b in sorted(spans))
    return (*[sum(k == n for _, k, _ in base) for n in range(3)], hashlib.sha256(form(base).encode()).hexdigest(), form(base + fresh))


def sample():
    rng = random.Random(8)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    key = lambda n, a=alphabet: "".join(rng.choice(a) for _ in range(n))
    texts = [
        None, "", "plain words", "password: token: abcdefgh", "TOKEN='abcdef' é日本 Api_Key=\"" + key(30) + '"', "password = short", "secret=" + "a" * 5 + " secret=" + "b" * 6,
        "AKIA" + "Q7" * 8 + " AKIAAKIA" + "Z" * 13 + " AKIAshort", "f" * 23 + " " + "0f" * 12 + " " + key(40, "0123456789abcdef"), "x" + key(44), key(32, "0123456789ABCDEF"),
        "123e4567-e89b-12d3-a456-426614174000", "sha256-" + key(43) + "=", "EXAMPLE" + key(30), "0" * 40 + "a", "thequickbrownfoxjumpsoverthelazydog99", "/usr/local/lib/python3/dist-packages/foo",
        "0x" + key(40, "0123456789ABCDEF"), "SAMPLE_NAME=" + key(40), "NAME=sample" + key(40) + "==", key(40) + "A" * 9 + key(40), key(40) + "A" * 12 + key(40),
        "token = \"" + key(40, "0123456789abcdef") + "\"" * 2, "apikey:" + key(8) + "\npasswd" + " " * 9 + "=" + key(8), " ".join(key(rng.randrange(20, 60)) for _ in range(40)), "password=" * 30,
        "a1" * 4000, key(3000), "".join(key(24, "0123456789abcdef") + "é " for _ in range(700)), "ſecret=abcdefg toKen=abcdefg",
    ]
    return [*texts, *("".join(rng.choice(["token", "=", "'", " ", ":", "secret", key(7), key(26), "AKIA", key(20, "ABCDEFG0123"), "é"]) for _ in range(25)) for _ in range(60))]


def test_report_equals_brute_force(spark):
    rows = [(i if i != 3 else None, t, "x", "y", 0) for i, t in enumerate(sample())] + [(5, sample()[4], "x", "y", 0)]
    got = sorted(((str(r.id), r.n_assign, r.n_access, r.n_hex, r.base_sha256, r.spans) for r in secrets.report(spark.createDataFrame(rows, SCHEMA)).collect()))
    want = sorted((str(r[0]), *brute(r[1])) for r in rows)
    for g, w in zip(got, want, strict=True):
        assert g == w
    assert secrets.report(spark.createDataFrame([], SCHEMA)).collect() == []


def test_what_is_suppressed(spark):
    rng = random.Random(5)
    key = lambda n, a="ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789": "".join(rng.sample(a, n) if n <= len(a) else rng.choices(a, k=n))
    found = ["0x" + key(16, "0123456789ABCDEF") * 3, "SAMPLE_NAME=" + key(40), key(40) + "A" * 9 + key(40), "key=" + key(40) + "=="]
    clean = ["NAME=sample" + key(40) + "==", "EXAMPLE" + key(40), key(40) + "A" * 12 + key(40), "sha256-" + key(43) + "="]
    docs = spark.createDataFrame([(i, t, "x", "y", 0) for i, t in enumerate(found + clean)], SCHEMA)
    got = {r.id: r.n_entropy for r in secrets.report(docs).collect()}
    assert [got[i] for i in range(8)] == [1] * 4 + [0] * 4


def test_window_counts_equal_counting_anew(spark):
    rng = random.Random(2)
    alphabet = secrets.CLASSES[1][2]
    words = ["".join(rng.choice(alphabet[: rng.randrange(2, 60)]) for _ in range(rng.randrange(24, 90))) for _ in range(30)]
    got = spark.createDataFrame([(w,) for w in words], "w string").select("w", secrets.peak_entropy(F.col("w"), alphabet).alias("h")).collect()
    for r in got:
        assert r.h == pytest.approx(peak(r.w), abs=1e-9)


def test_prefixes(spark):
    rng = random.Random(0)
    for n in (0, 1, 255, 256, 257, 1500):
        items = [rng.randrange(100 * n + 1) for _ in range(n)]
        got = spark.createDataFrame([(items,)], "a array<bigint>").select(prefix_sums(F.col("a")).alias("s"), running_max(F.col("a")).alias("m")).first()
        assert got.s == [sum(items[: i + 1]) for i in range(n)]
        assert got.m == [max(items[: i + 1]) for i in range(n)]


def test_pieces_of_a_text(spark):
    text = "".join(chr(0x1F600 + i % 50) if i % 7 == 0 else "\n" if i % 5 == 0 else "x" for i in range(20_000))
    spans = [(0, 0), (0, 20_000), (4095, 4097), (4096, 8192), (19_999, 20_000), (20_000, 20_000), (5, 17_000)]
    got = spark.createDataFrame([(text, spans)], "t string, s array<struct<start: bigint, end: bigint>>").select(cut_spans(F.col("t"), F.col("s")).alias("p")).first().p
    assert got == [text[a:b] for a, b in spans]


def test_long_candidates(spark):
    """Megabytes in one candidate: judged in one pass, without recursion, and a text of many secrets is redacted in one pass."""
    rng = random.Random(4)
    blob = "".join(rng.choice("abcdefghij0123456789ABCDEFGH") for _ in range(1_000_000))
    dull = "".join(f"{c}x1" * 10 for c in "abcdefghijklmnopqrstuvwABCDEFGHIJKLMNOPQRST") * 800  # every window is looked at
    path = "/usr/lib" * 100_000
    many = " ".join("%032x" % rng.getrandbits(128) for _ in range(20_000))
    docs = spark.createDataFrame([(1, blob, "i", "f", 0), (2, dull, "i", "f", 0), (3, path, "i", "f", 0), (4, many, "i", "f", 0)], SCHEMA)
    began = time.time()
    got = {r.id: r.spans for r in secrets.report(docs).collect()}
    assert got[1] == f"entropy:0:{len(blob)}" and got[2] == got[3] == "" and got[4].count("hex") == 20_000
    out = {r.doc_id: r.text for r in secrets.redact(docs).collect()}
    assert out[1] == "[SECRET]" and out[2] == dull and out[4] == " ".join(["[SECRET]"] * 20_000)
    assert time.time() - began < 120


def test_redaction_keeps_columns_of_any_name(spark):
    names = ["doc_id", "text", "row", "spans", "clean", "n", "_millrace_clean"]
    docs = spark.createDataFrame([(1, "secret=abcdefgh", "r", "s", "c", 5, "m")], names)
    assert [tuple(r) for r in secrets.redact(docs).collect()] == [(1, "[SECRET]", "r", "s", "c", 5, "m")]


def test_redaction(spark):
    rows = [(1, "é token=abcdefgh and password: zzzzzz9 end", "i", "f", 5), (2, "clean", "i", "f", 77), (3, None, "i", "f", None), (4, "secret=" + "0f" * 15, "i", "f", 1), (5, "AKIA" + "A1" * 9 + "token=abcdef", "i", "f", 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    out = secrets.redact(docs)
    assert out.columns == docs.columns and out.dtypes == docs.dtypes
    assert {r.doc_id: (r.text, r.n_chars) for r in out.collect()} == {
        1: ("é [SECRET] and [SECRET] end", 27), 2: ("clean", 77), 3: (None, None), 4: ("[SECRET]", 8), 5: ("[SECRET]", 8)
    }
