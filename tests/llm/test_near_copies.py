"""Near copies against all pairs' exact Jaccard similarity."""

import random
from collections import Counter

import pytest

from millrace.llm import simhash
from tests.llm.test_simhash import brute_fp

SCHEMA = "doc_id bigint, text string"


def shingles(text, words=5):
    parts = (text or "").lower().split()
    return {tuple(parts[i : i + words]) for i in range(len(parts) - words + 1)} or ({tuple(parts)} if parts else set())


def jaccard_groups(rows, similarity=0.8):
    """{id: smallest id of its group}, by all pairs."""
    sets = [shingles(t) for _, t in rows]
    root = {i: i for i, _ in rows}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for x in range(len(rows)):
        for y in range(x):
            common = len(sets[x] & sets[y])
            if sets[x] == sets[y] or common >= similarity * (len(sets[x]) + len(sets[y]) - common) - 1e-9:
                a, b = sorted((top(rows[x][0]), top(rows[y][0])))
                root[b] = a
    return {i: top(i) for i, _ in rows}


def grouped(spark, rows):
    return {r.id: r.component_id for r in simhash.near_copies(spark.createDataFrame(rows, SCHEMA)).collect()}


def narrow(pairs=40, words=800, vocabulary=100):
    """Pairs of texts over one narrow vocabulary: the word sets of all are nearly equal."""
    rng = random.Random(5)
    rows = []
    for i in range(pairs):
        text = [f"w{rng.randrange(vocabulary)}" for _ in range(words)]
        other = list(text)
        for _ in range(10):
            other[rng.randrange(words)] = f"w{rng.randrange(vocabulary)}"
        rows += [(2 * i, " ".join(text)), (2 * i + 1, " ".join(other))]
    return rows


def test_narrow_vocabulary_is_not_too_crowded(spark):
    rows = narrow()
    want = jaccard_groups(rows)
    assert sum(i != c for i, c in want.items()) == 40
    assert grouped(spark, rows) == want


@pytest.mark.parametrize("crowd", [1, 8])
def test_crowded_keys_lose_no_link(spark, monkeypatch, crowd):
    """A family of drifting copies and strangers, all with one common passage: links that only chains of members make."""
    monkeypatch.setattr(simhash, "CROWD", crowd)
    rng = random.Random(9)
    word = lambda: f"v{rng.randrange(5000)}"
    text, passage, rows = [word() for _ in range(120)], [word() for _ in range(40)], []
    for i in range(70):
        text = list(text)
        text[rng.randrange(120)] = word()
        if i % 3 == 0:
            text[rng.randrange(120)] = word()
        rows.append((i, " ".join(passage + text)))
        rows.append((1000 + i, " ".join(passage + [word() for _ in range(rng.randrange(5, 60))])))
    assert grouped(spark, rows) == jaccard_groups(rows)


def blocks(pairs=60, words=150):
    """Isolated pairs: one text is the other with a block appended, deleted or replaced, at similarities from 0.8."""
    rng = random.Random(11)
    rows = []
    for i in range(pairs):
        word = lambda: f"p{i}x{rng.randrange(3000)}"
        text = [word() for _ in range(words)]
        block = [word() for _ in range(words // 5 - 1)]
        at = rng.randrange(words // 2)
        other = [text + block, text[:at] + text[at + 24 :], text[:at] + block[:11] + text[at + 11 :]][i % 3]
        rows += [(2 * i, " ".join(text)), (2 * i + 1, " ".join(other))]
    return rows


def test_changed_blocks_are_found(spark):
    rows = blocks()
    want = jaccard_groups(rows)
    assert sum(i != c for i, c in want.items()) == 42
    assert grouped(spark, rows) == want


def around_the_threshold(pairs=120, words=200):
    """Isolated pairs with a tail replaced, at similarities of 0.7 to 0.9, some at exactly 0.8."""
    rng = random.Random(13)
    rows = []
    for i in range(pairs):
        text = [f"q{i}x{k}" for k in range(words)]
        other = text + [f"r{i}x{k}" for k in range(49)] if i % 10 == 0 else text[: -rng.randrange(10, 35)]
        while i % 10 and len(other) < words:
            other.append(f"r{i}x{len(other)}")
        rows += [(2 * i, " ".join(text)), (2 * i + 1, " ".join(other))]
    rows.append((1000, " ".join(f"q0x{k}" for k in range(200)) + " same"))
    return rows


def test_links_are_those_of_the_exact_similarity(spark):
    rows = around_the_threshold()
    want = jaccard_groups(rows)
    assert 20 < sum(i != c for i, c in want.items()) < 100
    assert grouped(spark, rows) == want


def family(size=1400, words=120):
    """One large group: copies of a text, each with edits of its own, so that two of them are often less similar than either is to the text; and strangers."""
    rng = random.Random(23)
    base = [f"b{rng.randrange(4000)}" for _ in range(words)]
    rows = []
    for i in range(size):
        text = list(base)
        for _ in range(rng.randrange(0, 3)):
            text[rng.randrange(words)] = f"e{rng.randrange(10**6)}"
        rows.append((i, " ".join(text + [f"t{i}x{k}" for k in range(rng.randrange(0, 12))])))
    return rows + [(size + i, " ".join(base[:40] + [f"s{i}x{k}" for k in range(60)])) for i in range(300)]


def test_a_group_of_over_a_thousand(spark):
    rows = family()
    want = jaccard_groups(rows)
    sizes = sorted(Counter(want.values()).values())
    assert sizes[-1] > 1000
    assert grouped(spark, rows) == want


def same_prints(size=40):
    """Texts that one shingle, many times repeated, gives one fingerprint; some are copies, most have hardly a shingle in common."""
    rng = random.Random(31)
    rows = []
    for i in range(size):
        own = [f"z{i}x{k}" for k in range(rng.randrange(10, 40))]
        rows.append((i, " ".join(["same"] * 500 + own)))
        if i % 5 == 0:
            rows.append((1000 + i, " ".join(["same"] * 400 + own + ["end"])))
    return rows


@pytest.mark.parametrize("crowd", [1, 8])
def test_near_copies_go_through_simhash(spark, monkeypatch, crowd):
    """The index gets the fingerprint of every text; its links are confirmed, and what they join the exact join leaves alone."""
    monkeypatch.setattr(simhash, "CROWD", crowd)
    rows = same_prints() + around_the_threshold(20) + family(60)
    rows = [(k, t) for k, (_, t) in enumerate(rows)] + [(5000, None), (5001, " \n")]
    seen, compared, links, verified = [], [], simhash.links, simhash._verified

    def linked(fps):
        seen.extend(r.fp & (2**64 - 1) for r in fps.collect())
        return links(fps)

    def confirmed(pairs, sets, similarity, sifted=False):
        found = verified(pairs, sets, similarity, sifted)
        compared.append(({tuple(r) for r in pairs.collect()}, {tuple(r) for r in found.collect()}))
        return found

    monkeypatch.setattr(simhash, "links", linked)
    monkeypatch.setattr(simhash, "_verified", confirmed)
    want = jaccard_groups(rows)
    assert grouped(spark, rows) == want
    assert sorted(seen) == sorted({brute_fp(t, 5) for _, t in rows})
    candidates, near = compared[0]
    assert 10 < len(near) < len(candidates) - 10
    root = {}
    top = lambda i: top(root[i]) if i in root else i
    for a, b in near:
        if top(a) != top(b):
            root[top(b)] = top(a)
    assert all(top(a) != top(b) for pairs, _ in compared[1:] for a, b in pairs)
    assert any(found for _, found in compared[1:])  # links that SimHash lacks
