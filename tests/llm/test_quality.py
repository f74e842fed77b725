import random
import re
from collections import Counter, defaultdict

import pytest

from millrace.llm import quality

SCHEMA = "doc_id bigint, text string, source string, host string, row string, n_chars bigint"
SPACE = " \t\n\x0b\x0c\r"


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t)


def base(text):
    t = text or ""
    w = words(t)
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    n = Counter(grams)
    repeated = len({i + k for i, g in enumerate(grams) if n[g] > 1 for k in range(5)})
    lines = [x for x in t.split("\n") if words(x)]
    return (len(w), sum(map(len, w)), sum(c in quality.SYMBOLS for c in t), len(lines) - len(set(lines)), repeated, len(w) < 10 or 100 * repeated > 20 * len(w))


def norm(line):
    return re.sub("[0-9]+", "0", "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(SPACE)))


def brute(rows):
    texts, holders = defaultdict(set), defaultdict(set)
    for _, t, host in rows:
        if t is not None and len(t) >= 10:
            texts[host].add(t)
            for x in t.split("\n"):
                holders[host, norm(x)].add(t)
    out = []
    for i, t, host in rows:
        limit = max(quality.MAX_LINE_DOCS, int(len(texts[host]) * quality.MAX_LINE_SHARE))
        stay = [x for x in (t or "").split("\n") if len(norm(x)) < 10 or len(holders[host, norm(x)]) <= limit]
        b = base(t)
        depleted = len(stay) < len((t or "").split("\n")) and (len(words("\n".join(stay))) < 10 or sum(map(len, words("\n".join(stay)))) < 0.3 * b[1])
        out.append((str(i), *b, not b[-1] and not depleted, None if t is None else "\n".join(stay)))
    return out


def sample():
    rng = random.Random(11)
    vocabulary = [f"word{i}" for i in range(300)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    rows = []
    for i in range(60):
        parts = [prose(rng.randrange(1, 30)) for _ in range(rng.randrange(1, 5))]
        if i % 2:
            parts.insert(rng.randrange(len(parts) + 1), f"  Copyright {i} by the Owners of this host ")
        rows.append((i, "\n".join(parts), "a" if i < 45 else "b"))
    same = prose(40)
    rows += [(100 + i, same, "a") for i in range(40)]
    loop = "one two three four five six "
    rows += [(200, None, "a"), (201, "", None), (202, " \n\t\n", "a"), (203, loop * 30, "b"), (None, prose(15), None), (204, "x" * 50_000, "a"), (205, ("line of words here\n" * 500), "a"), (206, prose(12) + " # | <b> $%&*", "a")]
    rows += [(207, "copyright 9 by the owners of this host\nshort one", "a"), (208, "one two three four five", "a"), (209, "a b c d e a b c d e f g h", "a"), (210, " ".join(vocabulary * 5), "b"), (3, rows[3][1], "a")]
    return rows


@pytest.mark.parametrize("broadcast", [0, 200_000])
def test_equals_brute_force(spark, monkeypatch, broadcast):
    monkeypatch.setattr(quality, "MAX_BROADCAST_LINES", broadcast)
    rows = sample()
    docs = spark.createDataFrame([(i, t, h, "x", "y", 0) for i, t, h in rows], SCHEMA).repartition(3)
    want = brute(rows)
    assert {w[7] for w in want} == {True, False} and any(not w[6] and not w[7] for w in want)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    got = sorted((str(r.id), *(r[n] for n in names)) for r in quality.judge(docs).collect())
    assert got == sorted(w[:-1] for w in want)
    kept = quality.accepted(docs)
    assert kept.columns == docs.columns and kept.dtypes == docs.dtypes
    assert sorted((str(r.doc_id), r.text, r.n_chars) for r in kept.collect()) == sorted((w[0], w[-1], len(w[-1])) for w in want if w[7])


def test_without_boilerplate_and_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert quality.judge(empty).collect() == [] and quality.accepted(empty).collect() == []
    rows = [(1, "a few words that are enough to pass the limit of ten", "h"), (2, None, None)]
    got = quality.judge(spark.createDataFrame([(i, t, h, "", "", 0) for i, t, h in rows], SCHEMA)).collect()
    assert {r.id: r.kept for r in got} == {1: True, 2: False}


def test_copies_count_by_id_where_asked(spark):
    text = "a line that all copies of this text hold\nand a second line with words enough to pass"
    rows = [(i, text, "h", "", "", 0) for i in range(30)] + [(i, f"one of its own {'abcdefghij'[i % 10] * (i - 90)} and so on", "h", "", "", 0) for i in range(100, 200)]
    docs = spark.createDataFrame(rows, SCHEMA)
    kept = lambda **how: {r.id for r in quality.judge(docs, **how).where("kept").collect()}
    assert set(range(30)) <= kept() and not set(range(30)) & kept(copies_count=True)
