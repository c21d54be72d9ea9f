"""Ranked search against brute force and the SQL, block boundaries against all partitions, and the edge cases."""

import itertools
import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from pulseframe.llm import ranked as R
from pulseframe.llm.oracles import OP13_SQL

WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
DOCS, ITEMS = "doc_id long, text string", "item_id long, text string"


def terms(text):
    return [w.translate(str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})) for w in WORD.findall(text or "")]


def brute(docs, items, k=10):
    own = [(key, Counter(terms(text))) for key, text in docs]
    n, total = sum(bool(c) for _, c in own), sum(sum(c.values()) for _, c in own)
    df = Counter(w for _, c in own for w in c)
    out = []
    for item, text in items:
        found = []
        for key, c in own:
            size = sum(c.values())
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * (1_000_000_000 * c[w] // (1000 * c[w] + 8 * (10 + 90 * size * n // total))) for w in set(terms(text)) if w in c)
            if score > 0:
                found.append((-score, key is not None, key or 0, key))
        out += [(item, rank, key, -score) for rank, (score, _, _, key) in enumerate(sorted(found)[:k], 1)]
    return out


def corpus(n, seed=2):
    rng = random.Random(seed)
    words = [f"w{int(rng.paretovariate(0.7))}" for _ in range(900)] + ["Äpfel", "äpfel", "ÄPFEL", "antidisestablishmentarianism", "antidisestablishmentarianisn", "中文"]
    docs = [(k, rng.choice([" ", "-", "\n"]).join(rng.choices(words, k=rng.choice([1, 3, 20, 80, 400])))) for k in range(n)]
    docs += [(n + k, docs[k % 9][1]) for k in range(40)] + [(None, docs[0][1]), (n + 50, None), (n + 51, ""), (n + 52, " .,!"), (3, docs[3][1])]
    items = [(k, " ".join(rng.choices(words, k=rng.choice([1, 2, 8, 60])))) for k in range(25)]
    return docs, items + [(100, None), (101, "..."), (102, "nobodysaysthis"), (None, "W1 w2"), (5, items[5][1]), (103, "antidisestablishmentarianism Äpfel")]


@pytest.mark.parametrize("shard,max_terms,most", [(8192, 500_000, 64), (50, 500_000, 4), (200, 120, 64)])
def test_search_matches_brute_force(spark, shard, max_terms, most, monkeypatch):
    monkeypatch.setattr(R, "FIRST", 16)
    docs, items = corpus(700)
    df = spark.createDataFrame(docs, DOCS).withColumn("rank", F.lit("x")).withColumn("score", F.lit(1)).repartition(3)
    asked = spark.createDataFrame(items, ITEMS).withColumn("terms", F.lit(0))
    got = [tuple(r) for r in R.search(df, asked, shard=shard, max_terms=max_terms).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, brute(docs, items)))


def test_query_matches_the_sql(spark, tmp_path):
    docs, items = corpus(300, 6)
    spark.createDataFrame(docs, DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, ITEMS).write.parquet(str(tmp_path / "benchmark.parquet"))
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    got, want = R.op13_ranked_search(spark, str(tmp_path)), con.sql(OP13_SQL)
    assert got.columns == list(want.columns)
    rows = sorted(map(repr, map(tuple, got.collect())))
    assert len(rows) > 150 and rows == sorted(map(repr, want.fetchall()))


def test_blocks_are_the_best_partition():
    rng = np.random.default_rng(3)
    lists = [rng.integers(0, 30, n) for n in (9, 1, 0, 7, 9, 3)]
    first = np.cumsum([0, *map(len, lists)])
    ends = R.block_ends(np.concatenate(lists), first, cost=1.5, most=4)
    for k, values in enumerate(lists):
        own = [0, *(e - first[k] for e in ends if first[k] < e <= first[k + 1])]
        if not len(values):
            continue
        each = int(1.5 * (values.max() - values.mean()))
        loss = lambda cuts, values=values, each=each: sum((b - a) * values[a:b].max() - values[a:b].sum() + each for a, b in itertools.pairwise(cuts))
        every = [[0, *cuts, len(values)] for m in range(len(values)) for cuts in itertools.combinations(range(1, len(values)), m)]
        assert own[-1] == len(values) and loss(own) == min(loss(c) for c in every if max(b - a for a, b in itertools.pairwise(c)) <= 4)


def test_blocks_are_skipped():
    """A rare term and a common one: most of the common one's postings stay closed."""
    rng = np.random.default_rng(5)
    n = 8000
    common, rare = np.arange(n), np.sort(rng.choice(n, 12, replace=False))
    gains = np.concatenate([rng.integers(100, 200, n), np.full(12, 100_000)])
    shard = R.Shard(np.arange(n), np.array([0, 1]), np.array([0, n, n + 12]), np.concatenate([common, rare]), gains)
    at, scores, opened = shard.best([0, 1], 10)
    whole = np.zeros(n, np.int64)
    np.add.at(whole, np.concatenate([common, rare]), gains)
    assert scores.tolist() == np.sort(whole)[::-1][:10].tolist() and opened < n // 2 and set(at) <= set(rare)


def test_empty(spark):
    docs, items = corpus(20)
    some, asked = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)
    for a, b in ((some.limit(0), asked), (some, asked.limit(0)), (some.filter("text is null"), asked)):
        out = R.search(a, b)
        assert out.count() == 0 and out.columns == ["item_id", "rank", "doc_id", "score"]
