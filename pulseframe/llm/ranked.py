"""Ranked lexical search: BM25-like integer scores, found by variable-block-max WAND in shards of documents.

A shard is some thousand consecutive documents of one task. Its index has, for each query term, the places of the documents
that hold it and how often; the index of all shards is written to the shared folder once, and counts of documents, terms and
document frequencies come from it, over all documents. Then each shard is searched for every query:

- A term's postings are cut into blocks of up to `MOST` postings where dynamic programming makes the sum of (block maximum -
  contribution) plus `BLOCK_COST` for each block least: blocks vary in length, and their maxima are close bounds. All lists of
  a shard are cut side by side.
- Between the ends of a query's blocks the sum of their maxima bounds the score of every document. The documents of the
  highest bounds are scored first; the k-th best score is the threshold. Only documents whose bound reaches it are scored,
  and only blocks that hold one of them are opened. Scores are exact 64-bit integers, and bounds are never below them, so that
  nothing that belongs among the first k is left out (a bound that equals the threshold is opened, as ties go by id).

The best k of each shard meet in one window for each query, limited before the shuffle. Queries are sent to all tasks up to
`MAX_TERMS` pairs of query and term; more are dealt into parts, searched one after the other.

Words that match a query term by hash are compared with it byte by byte. Defined cases: a null or empty text has no terms, and
is no document to the counts; a query without terms, or whose terms nobody holds, has no rows; repeated rows, and rows with a
null id (before all others among equal scores), are ranked one by one; repeated queries are too; extra columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .spark import cut, small_batches, unused
from .textscan import ALNUM, LOWER, Words, chunks, eights, hash_ranges, ids_of

SHARD = 8192
MOST = 64
BLOCK_COST = 8.0
MAX_TERMS = 500_000
FIRST = 64
_NO_ID = np.iinfo(np.int64).min
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=np.uint64)
#: A shard's rows: first the documents (term -1; n null ids as the least long), then each term's postings.
_INDEX = "shard long, term int, docs array<long>, counts array<int>"


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, Words, np.ndarray, np.ndarray]:
    words = Words(LOWER[data], offsets, ALNUM)
    eight = eights(LOWER[data])
    return eight, words, hash_ranges(eight, words.start, words.end), words.end - words.start


class Terms:
    """Query terms by number, and which words of a text they are."""

    def __init__(self, terms: list[bytes]):
        self.terms = sorted(set(terms))
        self.size = np.array([len(t) for t in self.terms], np.int64)
        room = b"".join(t + bytes(-len(t) % 8 + 8) for t in self.terms)
        self.at = np.cumsum([0, *(len(t) + -len(t) % 8 + 8 for t in self.terms)])[:-1] // 8
        self.eight = np.frombuffer(room, np.uint64)
        joined = np.frombuffer(b" ".join(self.terms), np.uint8)
        start = np.cumsum([0, *(len(t) + 1 for t in self.terms)])[:-1]
        hashes = hash_ranges(eights(joined), start, start + self.size)
        order = np.argsort(hashes, kind="stable")
        self.hash, self.number = hashes[order], order
        if len(np.unique(hashes)) < len(hashes):
            raise ValueError("two query terms have one hash")

    def of(self, eight: np.ndarray, start: np.ndarray, size: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """The term's number of each word, -1 for other words."""
        at = ids_of(hashes, self.hash, -1)
        out = np.where(at >= 0, self.number[at] if len(self.number) else -1, -1)
        live = np.flatnonzero(out >= 0)
        same = self.size[out[live]] == size[live]
        out[live[~same]], live, done = -1, live[same], 0
        while len(live):  # eight bytes at a time
            left = np.minimum(size[live] - done, 8)
            same = eight[start[live] + done] & _MASK[left] == self.eight[self.at[out[live]] + done // 8]
            out[live[~same]] = -1
            live, done = live[same & (size[live] - done > 8)], done + 8
        return out


def query_terms(queries: DataFrame, text: str) -> DataFrame:
    """queries with `terms`, each text's distinct terms."""
    lower = F.translate(F.coalesce(F.col(text), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return queries.withColumn("terms", F.array_distinct(F.regexp_extract_all(lower, F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), F.lit(0))))


def build_index(documents: DataFrame, terms: list[str], *, id_col: str = "doc_id", text_col: str = "text", shard: int = SHARD) -> DataFrame:
    """The postings of the given terms (numbered in the order of their bytes) in every document, by shard."""
    held = documents.sparkSession.sparkContext.broadcast(Terms([t.encode() for t in terms]))
    kinds = [pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int32())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, number = held.value, TaskContext.get().partitionId() << 33
        ids, sizes, found, n = [], [], [], 0  # of the shard; found: (term, place, times)

        def rows() -> Iterator[pa.RecordBatch]:
            nonlocal number, n
            term, place, times = (np.concatenate([np.zeros(0, np.int64), *(f[k] for f in found)]) for k in range(3))
            order = np.lexsort((place, term))
            term, place, times = term[order], place[order], times[order]
            first = np.flatnonzero(np.diff(term, prepend=-1))
            offsets = np.append(first, len(term)).astype(np.int32)
            docs = pa.ListArray.from_arrays(pa.array(np.append([0], n + offsets).astype(np.int32)), pa.array(np.concatenate([*ids, place])))
            counts = pa.ListArray.from_arrays(pa.array(np.append([0], n + offsets).astype(np.int32)), pa.array(np.concatenate([*sizes, times]).astype(np.int32)))
            made = pa.RecordBatch.from_arrays([pa.array(np.full(len(docs), number)), pa.array(np.append([-1], term[first]).astype(np.int32)), docs, counts], names=["shard", "term", "docs", "counts"])
            for k in range(0, len(docs), 2000):
                yield made.slice(k, 2000)
            number, n = number + 1, 0
            for x in (ids, sizes, found):
                x.clear()

        for batch in batches:
            keys = batch.column(0).cast(pa.int64()).fill_null(_NO_ID).to_numpy(zero_copy_only=False)
            for low, high, data, offsets in chunks(batch.column(1)):
                eight, words, hashes, size = _words(data, offsets)
                own = known.of(eight, words.start, size, hashes)
                hit = np.flatnonzero(own >= 0)
                pair, times = np.unique(words.row()[hit] * (len(known.terms) + 1) + own[hit], return_counts=True)
                place, term = np.divmod(pair, len(known.terms) + 1)
                some = np.flatnonzero(words.count)  # documents without a term are left out
                where = np.cumsum(words.count > 0) - 1
                ids.append(keys[low:high][some])
                sizes.append(words.count[some])
                found.append((term, where[place] + n, times))
                n += len(some)
                if n >= shard:
                    yield from rows()
        if n:
            yield from rows()

    return documents.select(F.col(id_col).cast("long"), text_col).mapInArrow(run, StructType.fromDDL(_INDEX))


def block_ends(values: np.ndarray, first: np.ndarray, cost: float = BLOCK_COST, most: int = MOST) -> np.ndarray:
    """The ends of the blocks of all lists (values[first[k]:first[k + 1]]) for which the sum of (block maximum - value), plus
    `cost` times the list's mean distance from its own maximum for each block, is least. Costs are in whole numbers."""
    sizes = np.diff(first)
    order = np.argsort(-sizes, kind="stable")  # those that are still open stand in front
    start, size, n = first[:-1][order], sizes[order], len(sizes)
    if not n or not size[0]:
        return np.zeros(0, np.int64)
    sums = np.append(0, np.cumsum(values))
    top = np.maximum.reduceat(values, start[size > 0]) if len(values) else values
    each = np.zeros(n, np.int64)
    each[: len(top)] = cost * (top - (sums[start + size] - sums[start])[: len(top)] / size[: len(top)])
    most = min(most, int(size[0]))
    lengths = np.arange(1, most + 1)
    best = np.full((n, most + 1), np.iinfo(np.int64).max // 4)  # [:, l]: the least cost of all but the last l postings
    best[:, 0] = 0
    highest = np.zeros((n, most), values.dtype)  # [:, l - 1]: the highest of the last l
    took = np.zeros(len(values), np.int64)
    alive = np.searchsorted(-size, -np.arange(1, size[0] + 1), side="right")
    for p in range(int(size[0])):
        a = int(alive[p])
        at = start[:a] + p
        v = values[at]
        highest[:a, 1:] = np.maximum(highest[:a, :-1], v[:, None])
        highest[:a, 0] = v
        reach = min(most, p + 1)
        loss = lengths[:reach] * highest[:a, :reach] - (sums[at + 1][:, None] - sums[at[:, None] + 1 - lengths[:reach]]) + best[:a, :reach]
        choice = np.argmin(loss, axis=1)
        took[at] = choice + 1
        best[:a, 1:] = best[:a, :-1]
        best[:a, 0] = loss[np.arange(a), choice] + each[:a]
    ends, open_ = [], start + size
    while len(open_):
        live = open_ > start
        start, open_ = start[live], open_[live]
        ends.append(open_)
        open_ = open_ - took[open_ - 1]
    return np.sort(np.concatenate(ends))


class Shard:
    """Postings with their contributions to scores, in blocks."""

    def __init__(self, ids: np.ndarray, terms: np.ndarray, first: np.ndarray, docs: np.ndarray, gains: np.ndarray):
        self.ids, self.docs, self.gains, self.place = ids, docs, gains, {int(t): k for k, t in enumerate(terms)}
        self.ends = block_ends(gains, first)
        self.starts = np.append(0, self.ends[:-1]) if len(self.ends) else self.ends
        self.low, self.high = docs[self.starts], docs[self.ends - 1]
        self.most = np.maximum.reduceat(gains, self.starts) if len(gains) else gains
        self.blocks = np.searchsorted(self.starts, first)

    def best(self, terms: list[int], k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Places and scores of the k best documents for some terms, best first; how many postings were opened."""
        lists = [self.place[t] for t in terms if t in self.place]
        if not lists:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), 0
        blocks = np.concatenate([np.arange(self.blocks[x], self.blocks[x + 1]) for x in lists])
        low, high, n = self.low[blocks], self.high[blocks], len(self.ids)
        steps = np.zeros(n + 1, np.int64)
        np.add.at(steps, low, self.most[blocks])
        np.subtract.at(steps, high + 1, self.most[blocks])
        bound = np.cumsum(steps[:-1])
        scores, opened = np.full(n, -1, np.int64), 0

        def score(wanted: np.ndarray) -> None:
            nonlocal opened
            up_to = np.append(0, np.cumsum(wanted))
            some = blocks[up_to[high + 1] > up_to[low]]
            size = self.ends[some] - self.starts[some]
            at = np.repeat(self.starts[some] - np.append(0, np.cumsum(size)[:-1]), size) + np.arange(size.sum())
            opened += len(at)
            at = at[wanted[self.docs[at]]]
            scores[wanted] = 0
            np.add.at(scores, self.docs[at], self.gains[at])

        wanted = np.zeros(n, bool)
        wanted[np.argpartition(-bound, min(n, FIRST) - 1)[:FIRST]] = True
        score(wanted & (bound > 0))
        threshold = max(1, int(np.partition(scores, n - k)[n - k])) if n > k else 1
        score((scores < 0) & (bound >= threshold))
        some = np.flatnonzero(scores >= threshold)
        some = some[np.lexsort((self.ids[some], -scores[some]))][:k]
        return some, scores[some], opened


def weights(n_docs: int, df: np.ndarray) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)


def _shards(batches: Iterator[pa.RecordBatch], weight: np.ndarray, n_docs: int, n_terms: int) -> Iterator[Shard]:
    """The shards of a task's rows, which stand together."""

    def made(held: list[pa.RecordBatch]) -> Shard:
        table = pa.Table.from_batches(held).combine_chunks()
        terms, docs, counts = (table.column(c).chunk(0) for c in ("term", "docs", "counts"))
        first, docs, counts = docs.offsets.to_numpy().astype(np.int64) - docs.offsets[0].as_py(), docs.flatten().to_numpy(), counts.flatten().to_numpy().astype(np.int64)
        n = int(first[1])
        m = 10 + 90 * counts[:n] * n_docs // n_terms
        docs, times, terms = docs[n:], counts[n:], terms.to_numpy()[1:]
        gains = np.repeat(weight[terms], np.diff(first[1:])) * (1_000_000_000 * times // (1000 * times + 8 * m[docs]))
        return Shard(table.column("docs").chunk(0).flatten().to_numpy()[:n], terms, first[1:] - n, docs, gains)

    held: list[pa.RecordBatch] = []
    for batch in batches:
        heads = np.flatnonzero(batch.column(1).to_numpy() == -1).tolist()
        for a, b in zip([0, *heads], [*heads, batch.num_rows], strict=True):
            if a in heads and held:
                yield made(held)
                held = []
            if b > a:
                held.append(batch.slice(a, b - a))
    if held:
        yield made(held)


def _searched(index: DataFrame, queries: list[list[int]], weight: np.ndarray, n_docs: int, n_terms: int, k: int) -> DataFrame:
    """(query, doc, score): the k best of each shard, by the queries' numbers."""
    held = index.sparkSession.sparkContext.broadcast((queries, weight))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked, weight = held.value
        for shard in _shards(batches, weight, n_docs, n_terms):
            number, docs, scores = [], [], []
            for q, terms in enumerate(asked):
                at, score, _ = shard.best(terms, k)
                number.append(np.full(len(at), q, np.int64))
                docs.append(shard.ids[at])
                scores.append(score)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(number)), pa.array(np.concatenate(docs)), pa.array(np.concatenate(scores))], names=["query", "doc", "score"])

    return index.mapInArrow(run, "query long, doc long, score long")


def _parts(queries: DataFrame, id_col: str, text_col: str, most: int) -> Iterator[list]:
    """The queries (id, terms) with terms, as many at once as `most` allows; one query alone may have more."""
    asked = cut(query_terms(queries.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "text").filter("size(terms) > 0").select("id", "terms"))
    total = asked.agg(F.sum(F.size("terms"))).first()[0] or 0
    n = max(1, -(-total // most))
    asked = asked.withColumn("part", F.pmod(F.xxhash64("id", "terms"), F.lit(n)))
    for part in range(n):
        if rows := asked.filter(F.col("part") == part).collect():  # bounded: `most` pairs, as the hash deals them
            yield rows


def search(documents: DataFrame, queries: DataFrame, *, k: int = 10, id_col: str = "doc_id", text_col: str = "text", query_col: str = "item_id", query_text_col: str = "text", shard: int = SHARD, max_terms: int = MAX_TERMS) -> DataFrame:
    """(query id, rank from 1, document id, score): each query's k best documents of a score above 0, equal ones by id."""
    spark, kind, out = documents.sparkSession, queries.schema[query_col].dataType, None
    names = [query_col, "rank", id_col if id_col != query_col else unused(queries, id_col)[0], "score"]
    for rows in _parts(queries, query_col, query_text_col, max_terms):
        terms = sorted({t for r in rows for t in r.terms}, key=str.encode)
        number = {t: i for i, t in enumerate(terms)}
        index = cut(build_index(documents, terms, id_col=id_col, text_col=text_col, shard=shard))
        counts = index.filter("term = -1").agg(F.sum(F.size("counts")), F.sum(F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x))).first()
        if not counts[0]:
            continue
        df = np.zeros(len(terms), np.int64)
        for r in index.filter("term >= 0").groupBy("term").agg(F.sum(F.size("docs")).alias("n")).collect():  # a row for each query term
            df[r.term] = r.n
        best = _searched(index, [[number[t] for t in r.terms] for r in rows], weights(counts[0], df), counts[0], counts[1], k)
        place = F.row_number().over(Window.partitionBy("query").orderBy(F.col("score").desc(), "doc"))
        best = best.withColumn("rank", place).filter(F.col("rank") <= k)
        ids = spark.createDataFrame([(q, r.id) for q, r in enumerate(rows)], StructType([*StructType.fromDDL("query long").fields, StructField("item", kind)]))
        best = best.join(F.broadcast(ids), "query").select(F.col("item").alias(names[0]), F.col("rank").cast("int").alias(names[1]), F.when(F.col("doc") != _NO_ID, F.col("doc")).alias(names[2]), F.col("score").alias(names[3]))  # as many as were collected
        out = best if out is None else out.unionByName(best)
    if out is None:
        return spark.createDataFrame([], StructType([StructField(names[0], kind), *StructType.fromDDL(f"{names[1]} int, {names[2]} long, {names[3]} long").fields]))
    return out


def op13_ranked_search(spark, sf_dir: str) -> DataFrame:
    small_batches(spark)
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return search(documents, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text"))
