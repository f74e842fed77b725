import random
import re

import pytest
import xxhash

from millrace.llm import simhash
from millrace.llm.components import star_components

SCHEMA = "doc_id bigint, text string, fp string, component_id string"


def brute_fp(text, words):
    parts = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    grams = [b" ".join(parts[i : i + words]) for i in range(len(parts) - words + 1)] or ([b" ".join(parts)] if parts else [])
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(fps):
    """fps: list of (id, unsigned fp) -> list of component ids."""
    root = list(range(len(fps)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i][1] ^ fps[j][1]).bit_count() <= 2:
                root[top(i)] = top(j)
    least = {}
    for i, (x, _) in enumerate(fps):
        if x is not None:
            least[top(i)] = min(x, least.get(top(i), x))
    return [least.get(top(i)) for i in range(len(fps))]


def rows_of(spark, texts):
    return spark.createDataFrame([(i, t, "x", "y") for i, t in texts], SCHEMA)


def test_fingerprints_equal_brute_force():
    rng = random.Random(3)
    for n in (0, 1, 2, 3, 4, 300, 1200):
        text = " \t".join(rng.choice(["Ab", "é", "The", "x" * 9, "0"]) for _ in range(n))
        for words in (1, 3, 5):
            assert simhash.fingerprint(simhash.shingle_hashes(text.encode(), words)) & (2**64 - 1) == brute_fp(text, words)


def test_groups_equal_brute_force(spark):
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(50)]
    base = [" ".join(rng.choice(vocabulary) for _ in range(80)) for _ in range(6)]
    texts = [(None, base[0]), (5, None), (6, ""), (7, " \n"), (8, "one"), (8, "one"), (9, "one two"), (4, "w" * 100_000)]
    for i in range(60):
        words = rng.choice(base).split()
        if rng.random() < 0.8:
            words[rng.randrange(80)] = rng.choice(vocabulary)
        texts.append((100 + i, " ".join(words)))
    expected = brute_groups([(i, brute_fp(t, 3)) for i, t in texts])
    got = simhash.near_groups(rows_of(spark, texts)).collect()
    want = sorted((str(i), brute_fp(t, 3), str(c)) for (i, t), c in zip(texts, expected, strict=True))
    assert sorted((str(r.id), r.fp & (2**64 - 1), str(r.component_id)) for r in got) == want


@pytest.mark.parametrize("heavy", [0, 3, 64])
def test_links_join_the_same_components(spark, monkeypatch, heavy):
    monkeypatch.setattr(simhash, "HEAVY", heavy)
    rng = random.Random(heavy)
    centres = [rng.getrandbits(64) for _ in range(4)]
    fps = {0, 1, 2**64 - 1}
    for _ in range(260):
        x = rng.choice(centres)
        for _ in range(rng.randrange(7)):
            x ^= 1 << rng.randrange(64)
        fps.add(x)
    signed = sorted(x - 2**64 if x >= 2**63 else x for x in fps)
    found = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp bigint"))
    roots = {r.node: r.root for r in star_components(found, "a", "b").collect()}
    got = {x: roots.get(x, x) for x in signed}
    want = brute_groups([(x, x & (2**64 - 1)) for x in signed])
    assert [got[x] for x in signed] == want


def test_components_of_chains_hubs_and_odd_edges(spark):
    edges = [(i, i + 1) for i in range(40)] + [(1000, 1000 + i) for i in range(1, 50)] + [(7, 7), (None, 3), (2, 1), (2, 1)]
    got = {r.node: r.root for r in star_components(spark.createDataFrame(edges, "a bigint, b bigint"), "a", "b").collect()}
    assert got == {i: 0 for i in range(1, 41)} | {1000 + i: 1000 for i in range(1, 50)}


def test_empty_table_and_keep_one(spark):
    empty = rows_of(spark, [])
    assert simhash.near_groups(empty).collect() == []
    docs = rows_of(spark, [(2, "a b c d e f"), (1, "a b c d e f"), (3, "g h i j k l m"), (None, "a b c d e f")])
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "3", "None"]


def copies():
    """Texts of 200 words with up to two words changed, texts of their own, and odd ones."""
    rng = random.Random(21)
    vocabulary = [f"word{i}" for i in range(2000)]
    base = [[rng.choice(vocabulary) for _ in range(200)] for _ in range(5)]
    rows, group = [], {}
    for i in range(60):
        words = list(base[i % 5])
        for _ in range(i % 3):
            words[rng.randrange(200)] = rng.choice(vocabulary)
        rows.append((100 + i, " ".join(words)))
        group[100 + i] = 100 + i % 5
    for i in range(20):
        rows.append((i + 1, " ".join(rng.choice(vocabulary) for _ in range(150))))
        group[i + 1] = i + 1
    return [*rows, (50, None), (51, ""), (None, rows[0][1]), (100, rows[0][1])], group | {50: 50, 51: 50}


@pytest.mark.parametrize("crowd", [1, 8])
def test_near_copies_are_grouped(spark, monkeypatch, crowd):
    monkeypatch.setattr(simhash, "CROWD", crowd)
    rows, group = copies()
    got = simhash.near_copies(rows_of(spark, rows)).collect()
    assert len(got) == len(rows)
    assert {r.id: r.component_id for r in got if r.id is not None} == group
    assert [r.component_id for r in got if r.id is None] == [100]
