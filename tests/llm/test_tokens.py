import io
import random
import time
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from millrace.llm import byte_bpe, packing, token_files, word_tokens
from millrace.session import work_path

SCHEMA = "doc_id bigint, text string, id string, ids string, length string"
ODD = [
    "", " ", "\n", "a", "Hello, WORLD. It's  fine\n\n  we'll see...x.,y., <|endoftext|> <|STARTOFTEXT|>x<|startoftext|>", "ΑΣ ΟΔΟΣ İstanbul éé é ﬁ ½   x　y",
    "tab\tand\x0b\x0c\rother \x1c\x1d\x85​᠎", "日本語 テキスト 123,456.78", "don't 'S 's 'RE", "a" * 300, "x.y. z, ,. ., .", "́ ́a", "A.B.C. é. É.", "#$%&' '",
]


def texts(spark, sf):
    return [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").limit(60).collect()]


def test_word_encoder_equals_the_library(spark, sf, monkeypatch):
    monkeypatch.setattr(word_tokens, "CACHE", 500)
    path = word_tokens.default_path()
    whole, ours = Tokenizer.from_file(path), word_tokens.WordEncoder(path)
    for text in ODD + texts(spark, sf) + ODD:
        assert word_tokens.ids32(ours.ids(text)).tolist() == whole.encode(text, add_special_tokens=False).ids, text


@pytest.fixture(scope="module")
def reference():
    tool = byte_bpe.encoder(byte_bpe.default_path(), byte_bpe.default_pattern())
    return tool, tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=dict(tool.encoding._mergeable_ranks), special_tokens={})


def chunked(tool, text, chunk, overlap):
    return byte_bpe.stitch([(start, part, *tool.pieces(part)) for _, start, part in byte_bpe.cut(text, chunk, overlap)], tool).tolist()


@pytest.mark.parametrize(("chunk", "overlap"), [(7, 3), (16, 8), (64, 16), (300, 40)])
def test_stitched_chunks_equal_whole_texts(reference, chunk, overlap):
    tool, whole = reference
    rng = random.Random(chunk)
    parts = ["word", " ", "  ", "   ", "\n", "\n\n", "'re", "'", "s", "'ll", "12", "!", "?!", " x", "é", "\t", "long" * 30, " " * 50, " ", "日本", "'r", "e"]
    for _ in range(150):
        text = "".join(rng.choice(parts) for _ in range(rng.randrange(1, 80)))
        assert chunked(tool, text, chunk, overlap) == whole.encode_ordinary(text), repr(text)
    for text in ["a" * 500, " " * 500, "'re" * 200, " a" * 300, "a" * 200 + " " * 200 + "b" * 200]:
        assert chunked(tool, text, chunk, overlap) == whole.encode_ordinary(text)


def test_byte_bpe_tables(spark, sf, reference):
    tool, whole = reference
    rows = [(i, t, "x", "y", "z") for i, t in enumerate([None, *ODD, *texts(spark, sf)[:20]])] + [(None, "null id", "x", "y", "z"), (3, "twice", "x", "y", "z"), (3, "twice", "x", "y", "z")]
    docs = spark.createDataFrame(rows, SCHEMA)
    for dealt in (1, 4, 1000):
        encoded = byte_bpe.encode(docs, chunk=200, overlap=30, dealt=dealt)
        got = sorted((str(r.id), np.frombuffer(r.ids, tool.kind).tolist()) for r in encoded.collect())
        assert got == sorted((str(r[0]), whole.encode_ordinary(r[1] or "")) for r in rows)
    decoded = sorted((str(r.id), bytes(r.bytes)) for r in byte_bpe.decode(encoded).collect())
    assert decoded == sorted((str(r[0]), (r[1] or "").encode()) for r in rows)
    assert byte_bpe.digests(byte_bpe.encode(spark.createDataFrame([], SCHEMA))).collect() == []
    odd = spark.createDataFrame([(1, None), (2, b"")], "id bigint, ids binary")
    assert [r.bytes for r in byte_bpe.decode(odd).orderBy("id").collect()] == [None, b""]
    assert [(r.n_tokens, r.ids_sha256 is None, r.decoded_sha256 is None) for r in byte_bpe.digests(odd).orderBy("id").collect()] == [(None, True, True), (0, False, False)]


def test_words_longer_than_the_overlap_cost_in_proportion(reference):
    tool, whole = reference
    text = " ".join("x" * (300 + k % 7) for k in range(8000))  # no chunk has a boundary in common with the next
    began = time.time()
    assert chunked(tool, text, 2048, 256) == whole.encode_ordinary(text)
    assert time.time() - began < 60


def test_token_file_is_seekable_and_checked(monkeypatch):
    monkeypatch.setattr(token_files, "FRAME_BYTES", 64)
    rng = random.Random(1)
    docs = [(i, rng.randbytes(2 * rng.randrange(90))) for i in range(30)] + [(None, b"ab")]
    out = io.BytesIO()
    writer = token_files.TokenFileWriter(out)
    for d in docs:
        writer.add(*d)
    writer.close()

    class Source(io.BytesIO):
        reads = 0

        def size(self):
            return len(self.getvalue())

    source = Source(out.getvalue())
    file = token_files.TokenFile(source)
    assert [(i, raw) for i, _, raw in file.documents()] == docs
    opened = []
    frame = file.frame
    file.frame = lambda k: opened.append(k) or frame(k)
    assert [(i, raw) for i, _, raw in file.documents([7])] == [docs[7]]
    first = sum(len(r) for _, r in docs[:7]) // 64
    assert set(opened) <= set(range(first, first + len(docs[7][1]) // 64 + 2))
    import zstandard

    assert zstandard.ZstdDecompressor().stream_reader(io.BytesIO(out.getvalue()), read_across_frames=True).read().startswith(b"".join(r for _, r in docs))
    bad = bytearray(out.getvalue())
    bad[len(bad) - 9 - 12 * len(writer.frames) + 8] ^= 1  # the first frame's checksum
    with pytest.raises(ValueError):
        list(token_files.TokenFile(Source(bytes(bad))).documents())
    with pytest.raises(ValueError):
        token_files.TokenFile(Source(b"short"))


def test_token_files_tables(spark, sf):
    whole = Tokenizer.from_file(word_tokens.default_path())
    rows = [(i * 3 - 50, t, "x", "y", "z") for i, t in enumerate([None, *ODD, *texts(spark, sf)])] + [(None, "null id", "x", "y", "z"), (7, "b", "x", "y", "z"), (7, "a", "x", "y", "z"), (7, "a", "x", "y", "z")]
    random.Random(1).shuffle(rows)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    manifest = token_files.write_token_files(docs, work_path(spark, "test"))
    got = sorted(token_files.checksums(token_files.read_token_files(spark, manifest)).collect(), key=lambda r: r.start)
    start, want = 0, []
    for r in got:
        assert r.start == start
        start += r.n_tokens
    assert [r.id for r in got] == sorted((r[0] for r in rows), key=lambda i: (i is not None, i or 0))
    for row in rows:
        ids = np.array([*whole.encode(row[1] or "", add_special_tokens=False).ids, 1], "<u4")
        want.append((str(row[0]), len(ids), zlib.crc32(ids.tobytes())))
    assert sorted((str(r.id), r.n_tokens, r.crc) for r in got) == sorted(want)
    assert token_files.read_token_files(spark, manifest, [10**9]).collect() == []
    some = token_files.read_token_files(spark, manifest, [7, -50]).collect()
    assert sorted(r.id for r in some) == sorted(r[0] for r in rows if r[0] in (7, -50))
    assert token_files.round_trip(spark.createDataFrame([], SCHEMA)).collect() == []


def test_plan_uses_all_pieces_and_fits():
    rng = np.random.default_rng(3)
    for size, n in ((10, 30), (50, 400), (2048, 3000)):
        counts = np.zeros(size + 1, np.int64)
        np.add.at(counts, rng.integers(1, size + 1, n), 1)
        bins = packing.plan(counts)
        used = np.zeros_like(counts)
        for lengths, times in bins:
            assert sum(lengths) <= size and times > 0
            for x in lengths:
                used[x] += times
        assert (used == counts).all()
        least = -(-int((np.arange(size + 1) * counts).sum()) // size)
        assert sum(t for _, t in bins) <= 1.15 * least + 2


def test_two_fit_is_the_best_pair():
    rng = random.Random(6)
    for _ in range(300):
        counts = np.array([0, *(rng.choice([0, 0, 1, 2]) for _ in range(12))])
        room, least = rng.randrange(1, 13), rng.randrange(0, 12)
        stock = [x for x in range(1, 13) for _ in range(counts[x])]
        sums = [a + b for i, a in enumerate(stock) for b in stock[:i] if least < a + b <= room]
        got = packing.two_fit(counts, room, least)
        assert (sum(got) if got else None) == max(sums, default=None)
        if got:
            assert counts[got[0]] >= 1 + (got[0] == got[1]) and counts[got[1]] >= 1


def test_two_replace_the_smallest():
    counts = np.zeros(11, np.int64)
    counts[[6, 3]] = 1
    counts[2] = 2
    assert packing.plan(counts)[0] == ([6, 2, 2], 1)  # 6 + 3 leaves 1; 2 + 2 fill it


def test_pack_tables(spark, sf):
    whole = Tokenizer.from_file(word_tokens.default_path())
    rows = [(i, t, "x", "y", "z") for i, t in enumerate([None, *ODD, *texts(spark, sf), *["same old text"] * 90, "word " * 500])] + [(None, "null id", "x", "y", "z"), (3, "twice", "x", "y", "z"), (3, "twice", "x", "y", "z")]
    size = 128
    got = packing.pack(spark.createDataFrame(rows, SCHEMA).repartition(3), size=size).collect()
    want = []
    for i, t, *_ in rows:
        ids = np.array([*whole.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want += [(str(i), k // size, k, len(ids[k : k + size]), zlib.crc32(ids[k : k + size].tobytes())) for k in range(0, len(ids), size)]
    assert sorted((str(r.id), r.piece, r.start, r.length, r.crc) for r in got) == sorted(want)
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for spans in bins.values():
        end = 0
        for offset, length in sorted(spans):
            assert offset == end
            end += length
        assert end <= size
    assert len(bins) <= 1.1 * sum(r.length for r in got) / size + 2
    assert packing.pack(spark.createDataFrame([], SCHEMA)).collect() == []
