"""Packing: exact round trips, the placement rule, little padding, and the edge cases."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from pulseframe.llm import packing as K

public_tokenizers = pytest.importorskip("public_tokenizers")
PATH = public_tokenizers.path("word_bpe_49k.json")
ODD = ["", " ", "<|endoftext|> a", "<|ENDOFTEXT|> A.", "É. x. A.́", "é É.", "a b　c", "ΑΣ. ΣΑΣ", "don't. I'LL, x.y.", "it's", "A" * 9000, "́ x", "İstanbul. ßẞ", "a.\x85b", "x!? y;: ...", "K.̸ ≠ a= ̸", "3.14, 2!", None]


def rows_at_random(n, seed=3):
    rng = random.Random(seed)
    words = ["alpha", "Beta,", "gamma.", "δέλτα", "x1y2", "don't", "中文字", "#!?", "É"]
    texts = [" ".join(rng.choices(words, k=int(rng.choice([1, 5, 40, 300, 900, 2500])))) for _ in range(n)]
    return list(enumerate(texts + ODD))


def encoded(text):
    from tokenizers import Tokenizer

    encoded.own = getattr(encoded, "own", None) or Tokenizer.from_file(PATH)
    return encoded.own.encode(text or "", add_special_tokens=False).ids + [2]


def checked(rows, pieces, size=4096, ids=True):
    """Each document whole, each sequence gapless; returns the share of padding."""
    docs, sequences = {}, {}
    for p in pieces:
        docs.setdefault(p.doc_id, []).append(p)
        sequences.setdefault(p.sequence_id, []).append(p)
    for key, text in rows:
        want, at = encoded(text), 0
        for p in sorted(docs.pop(key), key=lambda p: p.start):
            part = want[at : at + p.length]
            assert p.start == at and len(part) == p.length > 0 and p.doc_tokens == len(want)
            assert p.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes()) and (not ids or list(p.ids) == part)
            at += p.length
        assert at == len(want)
    assert not docs
    padded = 0
    for own in sequences.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= size
        padded += 0 if at & (at - 1) == 0 else size - at
    return padded / (size * len(sequences))


@pytest.mark.parametrize("by_chunk,size", [(True, 4096), (False, 4096), (True, 64)])
def test_round_trip(spark, by_chunk, size):
    rows = rows_at_random(150)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    pieces = K.pack(df, PATH, size=size, by_chunk=by_chunk).collect()
    assert checked(rows, pieces, size) == 0
    assert len({p.sequence_id for p in pieces}) <= -(-sum(p.length for p in pieces) // size) + 3 * 13


def test_chunks_are_encoded_as_whole_texts(monkeypatch):
    monkeypatch.setattr(K, "SLICE", 50)
    monkeypatch.setattr(K, "MAX_KNOWN", 20)
    texts = [t for _, t in rows_at_random(30, 8)]
    encoder = K.Encoder(PATH, True)
    for text, parts in zip(texts, encoder.of(pa.array(texts)), strict=True):
        assert [*np.concatenate([np.zeros(0, np.int32), *parts]).tolist(), 2] == encoded(text)


def test_levels_take_the_least_sum_of_squares():
    rng, size = random.Random(4), 50
    levels, counts = K.Levels(size), [0] * (size + 1)
    full = 0
    for k in range(4000):
        n = rng.randrange(1, size)
        choices = []
        for h in [0, *(h for h in range(1, size - n + 1) if counts[h])]:
            after = counts.copy()
            if h:
                after[h] -= 1
            if h + n < size:
                after[h + n] += 1
            choices.append((sum(x * x for x in after), -h, after))
        _, h, counts = min(choices, key=lambda c: c[:2])
        assert levels.level_for(n) == -h
        full += levels.place((k, 0, np.zeros(n, np.int32), n)) is not None
        assert levels.count.tolist() == counts
    closed = list(levels.close())
    assert full > 1500 and all((n := sum(len(p[2]) for p in w)) == size or n & (n - 1) == 0 for w in closed)


def test_query_and_edges(spark, tmp_path):
    rows = rows_at_random(40)
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("start", F.lit(1)).withColumn("ids", F.lit("x"))
    df.write.parquet(str(tmp_path / "documents.parquet"))
    got = K.op12_packing(spark, str(tmp_path))
    assert got.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    first = got.collect()
    assert checked(rows, first, ids=False) == 0 and sorted(map(tuple, first)) == sorted(map(tuple, got.collect()))
    none = K.pack(df.limit(0), PATH)
    assert none.count() == 0 and "ids" in none.columns
    odd = spark.createDataFrame([(None, "a"), (None, None), (1, "a"), (1, "a")], "doc_id long, text string")
    assert sorted((p.doc_id or 0, p.doc_tokens) for p in K.pack(odd, PATH, by_chunk=True).collect()) == [(0, 1), (0, 2), (1, 2), (1, 2)]
