"""Packing against the tokenizer file's own library: an exact round trip."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sparkwell.llm.packing import default_tokenizer, encoder, pack, sequences

TEXTS = ["", None, "Hello world", "a<|endoftext|>b", "  \n\n\t x  ", "naïve façade — 你好 🙂", "it's we'll I'd", "x" * 5000, " " * 3000 + "y", "word " * 3000, "Hello world", "1234567 89"]


def test_encoder_matches_the_files_library():
    own, enc = Tokenizer.from_file(default_tokenizer()), encoder(default_tokenizer())
    for t in TEXTS:
        assert enc(t or "").tolist() == own.encode(t or "", add_special_tokens=False).ids


def test_other_tokenizer_files_use_their_library():
    path = public_tokenizers.path("word_bpe_49k.json")
    assert encoder(path)("Hello, World").tolist() == Tokenizer.from_file(path).encode("Hello, World", add_special_tokens=False).ids


@pytest.mark.parametrize("length", [7, 2048])
def test_round_trip(spark, length):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, ids string").repartition(3)
    pieces = pack(spark, df, length).withColumn("crc", F.crc32("ids")).collect()
    own = Tokenizer.from_file(default_tokenizer())
    want = {i: [*own.encode(t or "", add_special_tokens=False).ids, 1] for i, t in enumerate(TEXTS)}
    got = {}
    for p in sorted(pieces, key=lambda p: (p.doc_id, p.start)):
        ids = np.frombuffer(p.ids, "<u4").tolist()
        assert len(ids) == p.length and p.start == len(got.setdefault(p.doc_id, []))
        assert p.begins == (p.start == 0) and p.crc == zlib.crc32(p.ids)
        got[p.doc_id] += ids
        assert p.doc_tokens == len(want[p.doc_id]) and p.ends == (len(got[p.doc_id]) == p.doc_tokens)
    assert got == want
    by = {}
    for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
        assert p.offset == by.get(p.sequence_id, 0)
        by[p.sequence_id] = p.offset + p.length
    total = sum(map(len, want.values()))
    assert sorted(by) == list(range(len(by))) and sum(by.values()) == total
    assert all(by[s] == length for s in range(len(by) - 1)) and by[len(by) - 1] <= length


def test_sequences_and_empty(spark):
    df = spark.createDataFrame([(1, "a b c"), (None, "d"), (1, "a b c")], "doc_id long, text string")
    pieces = pack(spark, df, 4)
    s = {r.sequence_id: np.frombuffer(r.ids, "<u4") for r in sequences(pieces).collect()}
    assert sum(map(len, s.values())) == sum(p.length for p in pieces.collect()) and max(map(len, s.values())) == 4
    assert pack(spark, df.limit(0), 4).count() == 0
