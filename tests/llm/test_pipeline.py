"""The pipeline against a brute-force version of each stage, in plain Python."""

import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from millrace.llm import word_tokens
from tests.llm import test_line_dedup, test_near_copies, test_quality, test_secrets

COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def sample():
    rng = random.Random(17)
    vocabulary = [f"{a}{b}" for a in ("ka", "lo", "mi", "ne", "ru", "so", "tu") for b in ("ra", "se", "ti", "vo", "xa", "ze", "bo", "di", "fu", "ge")]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    texts = []
    for i in range(40):
        parts = [prose(rng.randrange(12, 40)) for _ in range(rng.randrange(1, 4))]
        if i % 2:
            parts.append("Read more at the host's own front page")
        if i % 7 == 0:
            parts[0] += ' token = "' + "".join(rng.choice("0123456789abcdef") for _ in range(40)) + '" ' + prose(5)
        texts.append("\n".join(parts))
    texts += [texts[3]] * 3 + [texts[4]]
    long = prose(300).split()
    for i in range(4):  # near copies of one line each
        other = list(long)
        other[50 * i] = "changed"
        texts.append(" ".join(other))
    texts += [None, "", "too short", "one two three four five six " * 30, prose(3000), "é ü " + prose(30)]
    return [(i, t, "en", "a" if i % 3 else "b", None if t is None else len(t)) for i, t in enumerate(texts)]


def lines_deduped(rows):
    holders = defaultdict(set)
    for i, t in rows:
        for line in t.split("\n"):
            holders[test_line_dedup.key_of(line)].add(i)
    stays = lambda i, k: len(k) < 10 or len(holders[k]) < 2 or min(holders[k]) == i
    return [(i, "\n".join(x for x in t.split("\n") if stays(i, test_line_dedup.key_of(x)))) for i, t in rows]


def one_of_each(rows):
    least = test_near_copies.jaccard_groups(rows)
    return [row for row in rows if least[row[0]] == row[0]]


def redacted(text):
    spans = sorted((int(a), int(b)) for _, a, b in (s.split(":") for s in test_secrets.brute(text)[-1].split(",") if s))
    out, at = "", 0
    for a, b in spans:
        if a > at or a == 0 and not out:
            out += text[at:a] + "[SECRET]"
        elif a == at and not out.endswith("[SECRET]"):
            out += "[SECRET]"
        at = max(at, b)
    return out + text[at:]


def test_stages_equal_brute_force(spark, tmp_path):
    rows = sample()
    spark.createDataFrame(rows, COLUMNS).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    kept = [(int(w[0]), w[-1]) for w in test_quality.brute([(i, t, s) for i, t, _, s, _ in rows]) if w[7]]
    assert 30 < len(kept) < len(rows)
    wanted = [kept, lines_deduped(kept)]
    wanted.append(one_of_each(wanted[-1]))
    assert len(wanted[-1]) < len(kept) - 5
    wanted.append([(i, redacted(t)) for i, t in wanted[-1]])
    assert any("[SECRET]" in t for _, t in wanted[-1])

    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    dtypes = docs.dtypes
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, docs, str(tmp_path))
        assert out.dtypes == dtypes, name
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        got = sorted((r.doc_id, r.text, r.n_chars, r.lang) for r in docs.collect())
        assert got == sorted((i, t, len(t), "en") for i, t in wanted[k]), name

    whole = Tokenizer.from_file(word_tokens.default_path())
    want = []
    for i, t in wanted[-1]:
        ids = np.array([*whole.encode(t, add_special_tokens=False).ids, 0], "<u4")
        want += [(i, p // 2048, p, len(ids[p : p + 2048]), zlib.crc32(ids[p : p + 2048].tobytes())) for p in range(0, len(ids), 2048)]
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed) == sorted(want)
    bins = defaultdict(list)
    for r in packed:
        bins[r.sequence_id].append((r.offset, r.length))
    for spans in bins.values():
        assert [o for o, _ in sorted(spans)] == [sum(n for _, n in sorted(spans)[:k]) for k in range(len(spans))] and sum(n for _, n in spans) <= 2048


def test_empty_documents(spark, tmp_path):
    spark.createDataFrame([], COLUMNS).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


@pytest.mark.parametrize("name", ["op4_byte_bpe", "op9_token_files", "op10_media", "op7_packing", "op1_simhash"])
def test_registered_queries_cover_the_table(spark, sf, name):
    import __spark_entry__

    rows = __spark_entry__.queries()[name](spark, sf).collect()
    ids = {r.doc_id for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert {r.doc_id for r in rows} == ids
