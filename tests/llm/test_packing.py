import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from convolens.llm import packing
from convolens.llm.queries import QUERIES

TOKENIZER = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def check(docs, rows, limit, waste):
    ids = [(d, [*TOKENIZER.encode(t or "", add_special_tokens=False).ids, 0]) for d, t in docs]
    expected = Counter()
    for doc, found in ids:
        sizes = [len(found)] if len(found) <= limit else [len(found) % limit] * (len(found) % limit > 0) + [limit] * (len(found) // limit)
        start = 0
        for number, size in enumerate(sizes):
            crc = zlib.crc32(np.array(found[start:start + size], "<u4").tobytes())
            expected[doc, number, start, size, crc] += 1
            start += size
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == expected
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for content in sequences.values():
        at = 0
        for offset, length in sorted(content):
            assert offset == at
            at += length
        assert at <= limit
    least = -(-sum(len(f) for _, f in ids) // limit)
    assert len(sequences) <= least * (1 + waste) + 2
    return len(sequences), least


def test_encoder_equals_tokenizer():
    encode = packing.load_encoder()
    for text in ["", " a  b\n\n c", "It's 12 o'clock, ÄÖ é 漢字 🙂", "x<|endoftext|>y", "é   \t\r\n", "zz" * 3000]:
        assert encode(text) == TOKENIZER.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", [" " * 1_000_000, "\n" * 1_000_000 + "x", "a  b" + " \t" * 600_000 + "c<|endoftext|>d"])
def test_long_runs_of_white_space(spark, text):
    expected = TOKENIZER.encode(text, add_special_tokens=False).ids
    assert packing.load_encoder()(text) == expected
    frame = spark.createDataFrame([(1, text), (2, "x y")], "doc_id long, text string")
    rows = packing.pieces(frame).where("doc_id = 1").collect()
    assert sum(r.length for r in rows) == len(expected) + 1


@pytest.mark.parametrize("shape", ["spread", "one", "long", "two"])
def test_plan_uses_every_piece(shape):
    r = np.random.default_rng(1)
    histogram = np.zeros(513, np.int64)
    lengths = {"spread": np.minimum(512, r.pareto(1.0, 20_000) * 40 + 1), "one": np.full(1000, 200),
               "long": r.integers(300, 513, 3000), "two": np.r_[np.full(5000, 300), np.full(5000, 212)]}[shape]
    np.add.at(histogram, lengths.astype(int), 1)
    planned = packing.plan(histogram, 512)
    used = np.zeros_like(histogram)
    for content, count in planned:
        assert sum(content) <= 512 and count > 0
        for size in content:
            used[size] += count
    assert (used == histogram).all()
    total = sum(c for _, c in planned)
    best = {"spread": -(-int(lengths.astype(int).sum()) // 512), "one": 500, "long": 2900, "two": 5000}[shape]
    assert total <= best * 1.02 + 1 or shape == "long"


def test_odd_rows(spark):
    r = random.Random(2)
    docs = [(1, None), (2, ""), (None, "a b"), (None, "a b"), (3, "tok " * 70_000), (4, "x")]
    docs += [(10 + i, " ".join("word" for _ in range(r.randrange(1, 300)))) for i in range(200)]
    frame = spark.createDataFrame([(*d, "e", 1) for d in docs], "doc_id long, text string, piece string, length int")
    check(docs, packing.pack(frame).collect(), 2048, 0.05)
    check(docs, packing.pack(frame, limit=64).collect(), 64, 0.05)
    assert packing.pack(frame.limit(0)).count() == 0


def test_query(spark):
    folder = "/root/testdata/sf0.01"
    docs = [tuple(r) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]
    check(docs, QUERIES["op8_packing"][0](spark, folder).collect(), 2048, 0.02)
