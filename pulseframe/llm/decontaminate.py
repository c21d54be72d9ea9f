"""Benchmark decontamination: a broadcast hash set of benchmark word windows, scanned over every text, verified, removed.

A word is a run of digits, ASCII letters (A-Z lower-cased) and non-ASCII characters. A window is `size` consecutive
words of a benchmark item; an item of fewer words (but not none) is one window. The windows' hashes are broadcast to the
scanning tasks; every hash hit is compared with the window's own words before it counts. The set's size is checked
first: beyond `max_windows` the benchmark is dealt into parts by hash, and one part after the other is sent out and scanned
for, each part alone on the driver and in the tasks. What a part finds is kept by the digest of the text that holds it;
the parts' finds are merged by digest and joined to the rows, so that every row has its own result, whatever its id and
however large the benchmark is. Documents are never shuffled in the one-part case.

Defined cases: a null or empty text has no words and no hits; a null item text has no windows; the windows of an item
with a null id hit, but name no item; repeated rows, and rows with a null id, are judged one by one; extra columns are
carried by `remove`; an empty benchmark leaves everything clean; an empty table gives none.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from .spark import cut, small, small_batches, unused
from .textscan import ALNUM, LOWER, Words, buffers, chunks, windows_of, word_hashes

WINDOW = 10
MAX_WINDOWS = 1_000_000
_WINDOWS = "item string, size int, hash long, words binary"
_FOUND = "n_words long, hits array<struct<start:long,end:long>>, items array<string>"
_BY_TEXT = "digest binary, hits array<struct<start:long,end:long>>, items array<string>"
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, Words, np.ndarray]:
    data = LOWER[data]
    words = Words(data, offsets, ALNUM)
    return data, words, word_hashes(data, words)


def _window_bytes(data: np.ndarray, words: Words, at: int, size: int) -> bytes:
    return b" ".join(data[words.start[i] : words.end[i]].tobytes() for i in range(at, at + size))


def benchmark_windows(benchmark: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """(item, size, hash, words) of every distinct window of every item."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            items, out = batch.column(0).to_pylist(), []
            for row, _, data, offsets in chunks(batch.column(1)):
                data, words, hashed = _words(data, offsets)
                every = {m: windows_of(hashed, m).view(np.int64) for m in {min(n, size) for n in words.count.tolist()} if m}
                for k, n in enumerate(words.count.tolist()):
                    if not n:
                        continue
                    first, m = int(words.first[k]), min(n, size)
                    starts = np.arange(first, first + n - m + 1)
                    hashes = every[m][starts]
                    out += [(items[row + k], m, h, _window_bytes(data, words, s, m)) for s, h in zip(starts.tolist(), hashes.tolist(), strict=True)]
            cols = list(zip(*out, strict=True)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.binary())], names=["item", "size", "hash", "words"])

    return benchmark.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).alias("text")).mapInArrow(scan, _WINDOWS).distinct()


class WindowSet:
    """Windows by length: sorted hashes behind a bitmap, and each hash's windows with their items."""

    BITS = 22

    def __init__(self, rows: list):
        by_size: dict[int, dict[int, dict[bytes, set[str]]]] = defaultdict(lambda: defaultdict(lambda: defaultdict(set)))
        for item, size, h, words in rows:
            by_size[size][h][bytes(words)].add(item)
        self.sizes = {}
        for size, windows in by_size.items():
            keys = np.sort(np.array(list(windows), dtype=np.int64))
            bitmap = np.zeros(1 << self.BITS, dtype=bool)
            bitmap[self.slot(keys)] = True
            self.sizes[size] = keys, bitmap, {h: {w: sorted(x for x in i if x is not None) for w, i in v.items()} for h, v in windows.items()}

    @classmethod
    def slot(cls, hashes: np.ndarray) -> np.ndarray:
        return (hashes.view(np.uint64) >> np.uint64(64 - cls.BITS)).astype(np.int64)

    def scan(self, data: np.ndarray, words: Words, hashed: np.ndarray) -> tuple[np.ndarray, list[set[str]]]:
        """Which words are hit, and each row's items."""
        change = np.zeros(len(words.start) + 1, dtype=np.int32)
        items: list[set[str]] = [set() for _ in words.count]
        for size, (keys, bitmap, windows) in self.sizes.items():
            at = words.windows(size)
            if not len(at):
                continue
            hashes = windows_of(hashed, size)[at].view(np.int64)
            near = np.flatnonzero(bitmap[self.slot(hashes)])
            near = near[np.isin(hashes[near], keys)]
            rows = np.searchsorted(words.first, at[near], side="right") - 1
            for i, h, row in zip(at[near].tolist(), hashes[near].tolist(), rows.tolist(), strict=True):
                found = windows[h].get(_window_bytes(data, words, i, size))
                if found is not None:
                    change[i] += 1
                    change[i + size] -= 1
                    items[row].update(found)
        return np.cumsum(change[:-1]) > 0, items


def _found(windows: WindowSet, column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, Words, int, list[tuple[int, int]], list[str]]]:
    """For each row of a text column: (row, its chunk's bytes and offsets, words, place in the chunk, hit spans, items)."""
    for row, _, data, offsets in chunks(column):
        lower, words, hashed = _words(data, offsets)
        hit, items = windows.scan(lower, words, hashed)
        any_hit = np.zeros(len(hit) + 1, dtype=np.int64)
        np.cumsum(hit, out=any_hit[1:])
        some = any_hit[words.first[1:]] > any_hit[words.first[:-1]]
        for k, own in enumerate(items):
            spans: list[tuple[int, int]] = []
            if some[k]:
                low, high = int(words.first[k]), int(words.first[k + 1])
                edges = np.diff(np.concatenate([[0], hit[low:high].astype(np.int8), [0]]))
                spans = list(zip(np.flatnonzero(edges == 1).tolist(), np.flatnonzero(edges == -1).tolist(), strict=True))
            yield row + k, data, offsets, words, k, spans, sorted(own)


def _spans(values: list[list[tuple[int, int]]]) -> pa.Array:
    return pa.array([[{"start": a, "end": b} for a, b in v] for v in values], _SPANS)


def _lacking(text: bytes, words: Words, offset: int, low: int, spans: list[tuple[int, int]]) -> bytes:
    """A text without its hit spans, each with what stands between its words."""
    pieces, done = [], 0
    for a, b in spans:
        pieces.append(text[done : int(words.start[low + a]) - offset])
        done = int(words.end[low + b - 1]) - offset
    return b"".join([*pieces, text[done:]])


def _digest(text: bytes) -> bytes:
    return hashlib.blake2b(text, digest_size=16).digest()


class Finder:
    """The hits of texts, by one broadcast set, or by the merged finds of its parts joined to the rows."""

    def __init__(self, documents: DataFrame, benchmark: DataFrame, text_col: str, item_col: str, item_text_col: str, size: int, max_windows: int):
        table = benchmark_windows(benchmark, item_col, item_text_col, size)
        parts = max(1, -(-table.count() // max_windows))
        self.text, context = text_col, documents.sparkSession.sparkContext
        if parts == 1:
            self.held, self.rows, self.extra = context.broadcast(WindowSet(table.collect())), documents, []
            return
        table = cut(table)
        texts, found = documents.select(F.col(text_col).alias("text")).filter("text is not null"), None
        for part in range(parts):
            held = context.broadcast(WindowSet(table.filter(F.pmod("hash", F.lit(parts)) == part).collect()))
            one = cut(texts.mapInArrow(self._by_text(held), _BY_TEXT).dropDuplicates(["digest"]))
            held.destroy()
            found = one if found is None else found.unionByName(one)
        every = found.groupBy("digest").agg(F.flatten(F.collect_list("hits")).alias("hits"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))  # at most a row for each part
        digest, hits, items = unused(documents, "digest", "hits", "items")
        every = small(cut(every), 20_000).select(F.col("digest").alias(digest), F.col("hits").alias(hits), F.col("items").alias(items))
        keyed = documents.mapInArrow(self._keyed(documents.columns.index(text_col), digest), StructType([*documents.schema.fields, StructField(digest, BinaryType())]))
        self.held, self.rows, self.extra = None, keyed.join(every, digest, "left").select(*documents.columns, hits, items), [hits, items]

    @staticmethod
    def _by_text(held):
        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = [(_digest(data[offsets[k] : offsets[k + 1]].tobytes()), spans, items) for _, data, offsets, _, k, spans, items in _found(held.value, batch.column(0)) if spans]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.binary()), _spans([x[1] for x in out]), pa.array([x[2] for x in out], pa.list_(pa.string()))], names=["digest", "hits", "items"])

        return scan

    @staticmethod
    def _keyed(at: int, name: str):
        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                data, offsets = buffers(batch.column(at))
                digests = [_digest(data[a:b].tobytes()) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(digests, pa.binary())], names=[*batch.schema.names, name])

        return scan

    def apply(self, make, schema) -> DataFrame:
        """make(batch, list of (row, data, offsets, words, place, spans, items)) over all rows."""
        held, at, extra = self.held, self.rows.columns.index(self.text), len(self.extra)

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if held is not None:
                    yield make(batch, _found(held.value, batch.column(at)))
                    continue
                hits, items = batch.column(batch.num_columns - 2).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()
                yield make(batch.select(range(batch.num_columns - extra)), _merged(batch.column(at), hits, items))

        return self.rows.mapInArrow(scan, schema)


def _merged(column: pa.Array, hits: list, items: list) -> Iterator[tuple]:
    """As _found, from what the parts found."""
    for row, _, data, offsets in chunks(column):
        _, words, _ = _words(data, offsets)
        for k in range(len(offsets) - 1):
            spans: list[tuple[int, int]] = []
            for a, b in sorted((x["start"], x["end"]) for x in hits[row + k] or ()):
                if spans and spans[-1][1] >= a:
                    spans[-1] = spans[-1][0], max(b, spans[-1][1])
                else:
                    spans.append((a, b))
            yield row + k, data, offsets, words, k, spans, sorted(items[row + k] or ())


def find(documents: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", size: int = WINDOW, max_windows: int = MAX_WINDOWS) -> DataFrame:
    """One row per document: id, n_words, hits (array of word ranges, end exclusive, disjoint), items (sorted)."""
    docs = documents.select(F.col(id_col).alias("row_id"), F.col(text_col).alias("text"))

    def make(batch: pa.RecordBatch, found: Iterator[tuple]) -> pa.RecordBatch:
        rows = [(int(words.count[k]), spans, items) for _, _, _, words, k, spans, items in found]
        cols = list(zip(*rows, strict=True)) or [(), (), ()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(cols[0], pa.int64()), _spans(cols[1]), pa.array(cols[2], pa.list_(pa.string()))], names=[id_col, "n_words", "hits", "items"])

    schema = StructType([StructField(id_col, documents.schema[id_col].dataType), *StructType.fromDDL(_FOUND).fields])
    return Finder(docs, benchmark, "text", item_col, item_text_col, size, max_windows).apply(make, schema)


def remove(documents: DataFrame, benchmark: DataFrame, *, mode: str = "documents", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", size: int = WINDOW, max_windows: int = MAX_WINDOWS) -> DataFrame:
    """documents without contaminated rows (mode "documents"), or with every hit span cut out of the text ("spans").

    Rows keep all their columns. In "spans" a hit run of words goes together with what stands between its words.
    """
    if mode not in ("documents", "spans"):
        raise ValueError(f"mode: {mode}")
    names, at = documents.columns, documents.columns.index(text_col)

    def make(batch: pa.RecordBatch, found: Iterator[tuple]) -> pa.RecordBatch:
        if mode == "documents":
            return batch.filter(pa.array([not spans for *_, spans, _ in found], pa.bool_()))
        texts = [_lacking(data[offsets[k] : offsets[k + 1]].tobytes(), words, int(offsets[k]), int(words.first[k]), spans).decode() if batch.column(at)[row].is_valid else None for row, data, offsets, words, k, spans, _ in found]
        return batch.set_column(at, names[at], pa.array(texts, batch.column(at).type))

    return Finder(documents, benchmark, text_col, item_col, item_text_col, size, max_windows).apply(make, documents.schema)


def op5_decontaminate(spark, sf_dir: str) -> DataFrame:
    small_batches(spark)
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text")
    found = find(documents, benchmark)
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda total, x: total + x["end"] - x["start"])
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))
