"""Sum-of-squares packing: documents' token ids in sequences of one size, with next to no padding.

Each task tokenizes its rows and packs them online. A document's full windows are sequences of their own; what is left
of it goes to the fill level that makes the sum of squared counts of partly filled windows least (an array holds the count of
each level; of equal choices the fullest window is taken, a new window last). Full windows are written at once. When the
task's rows end, the fullest open windows are filled up with ids cut from the emptiest ones, and the one that then remains
is cut into sequences whose lengths are powers of two, which need no padding. Nothing is shuffled, and a task holds its open
windows only; a task that is run again gives the same sequences, as its rows and their order are the same.

A sequence's id is the task's number and the sequence's within it. Tokenizers are read from a path that every executor has.
For one that drops white space (`by_chunk`), the ids of a text are those of its stretches between ASCII white space, also with
a space before a mark that ends a stretch and follows an ASCII letter, and, if it lower-cases, in lower case: so each
different stretch is encoded once. Texts with "<|", which may begin a special token, are not lower-cased before.

Defined cases: a null or empty text has the end id alone; rows with a null id, and repeated rows, are packed one by one; extra
columns are not read; very long texts are tokenized slice by slice (by_chunk); an empty table gives none.
"""

from __future__ import annotations

import functools
import os
import zlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.types import StructField, StructType

from .spark import small_batches

SIZE = 4096
END = 2
SLICE = 1 << 22
MAX_KNOWN = 1_000_000
_WHITE = " \t\n\v\f\r"


class Encoder:
    """Token ids of texts, by a tokenizer file."""

    def __init__(self, path: str, by_chunk: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer, self.by_chunk = Tokenizer.from_file(path), by_chunk
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}  # a stretch's place in the next two
        self.first, self.flat, self.n, self.used = np.zeros(1 << 16, np.int64), np.zeros(1 << 18, np.int32), 0, 0

    def _learn(self, stretches: list[str]) -> None:
        found = [x.ids for x in self.tokenizer.encode_batch_fast(stretches, add_special_tokens=False)]
        sizes = np.fromiter(map(len, found), np.int64, len(found))
        total = int(sizes.sum())
        if self.n + len(found) + 1 > len(self.first):
            self.first = np.concatenate([self.first, np.zeros(max(len(found) + 1, len(self.first)), np.int64)])
        if self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(max(total, len(self.flat)), np.int32)])
        self.flat[self.used : self.used + total] = np.fromiter((x for ids in found for x in ids), np.int32, total)
        np.cumsum(sizes, out=self.first[self.n + 1 : self.n + len(found) + 1])
        self.first[self.n + 1 : self.n + len(found) + 1] += self.used
        self.known.update(zip(stretches, range(self.n, self.n + len(found)), strict=True))
        self.n, self.used = self.n + len(found), self.used + total

    def _chunked(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, and where each one's begin."""
        if not pc.any(pc.match_substring(texts, "<|")).as_py():
            texts = pc.ascii_lower(texts)
        stretches = pc.ascii_split_whitespace(pc.replace_substring_regex(texts, r"([A-Za-z])([.,;:!?])([ \t\n\v\f\r]|$)", r"\1 \2\3"))
        offsets, coded = stretches.offsets.to_numpy(), stretches.flatten().dictionary_encode()
        offsets = offsets - offsets[0]
        own = coded.dictionary.to_pylist()
        if len(self.known) > MAX_KNOWN:
            self._forget()
        if fresh := [x for x in own if x not in self.known]:
            self._learn(fresh)
        at = np.fromiter(map(self.known.__getitem__, own), np.int64, len(own))[coded.indices.to_numpy()]
        low, size = self.first[at], self.first[at + 1] - self.first[at]
        ends = np.zeros(len(at) + 1, np.int64)
        np.cumsum(size, out=ends[1:])
        return self.flat[np.repeat(low - ends[:-1], size) + np.arange(ends[-1])], ends[offsets]

    def _slices(self, text: str) -> Iterator[str]:
        start = 0
        while start < len(text):
            stop = start + SLICE
            while stop < len(text) and text[stop] not in _WHITE:
                stop += 1
            yield text[start:stop]
            start = stop

    def of(self, texts: pa.Array) -> Iterator[list[np.ndarray]]:
        """Each text's ids, in parts."""
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        texts = pc.fill_null(texts, "")
        if not self.by_chunk:
            for text in texts:
                yield [np.array(self.tokenizer.encode(text.as_py(), add_special_tokens=False).ids, np.int32)]
            return
        row, ends = 0, np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
        while row < len(texts):
            before = int(ends[row - 1]) if row else 0
            stop = max(row + 1, int(np.searchsorted(ends, before + SLICE, side="right")))
            if stop == row + 1:
                yield [self._chunked(pa.array([x]))[0] for x in self._slices(texts[row].as_py())]
            else:
                ids, first = self._chunked(texts[row:stop])
                yield from ([ids[a:b]] for a, b in zip(first[:-1], first[1:], strict=True))
            row = stop


@functools.lru_cache(maxsize=1)
def encoder(path: str, by_chunk: bool) -> Encoder:
    """One for each Python worker, whose tasks share what it knows."""
    return Encoder(path, by_chunk)


Piece = tuple[object, int, np.ndarray, int]  # document, start, ids, ids of the document


class Levels:
    """Open windows by fill level, and how many there are of each."""

    def __init__(self, size: int):
        self.size, self.count, self.open = size, np.zeros(size + 1, np.int64), {}

    def level_for(self, n: int) -> int:
        """The fill level (0 a new window) that n ids are put on."""
        levels = np.append(0, np.flatnonzero(self.count[1 : self.size - n + 1]) + 1)
        grown = levels + n
        change = np.where(grown < self.size, 2 * self.count[grown] + 1, 0) + np.where(levels > 0, 1 - 2 * self.count[levels], 0)
        return int(levels[np.flatnonzero(change == change.min())[-1]])

    def place(self, piece: Piece) -> list[Piece] | None:
        """Puts a piece down; returns the window if it is full now."""
        n = len(piece[2])
        level = self.level_for(n)
        window = self.open[level].pop() if level else []
        self.count[level] -= level > 0
        window.append(piece)
        if level + n == self.size:
            return window
        self.count[level + n] += 1
        self.open.setdefault(level + n, []).append(window)
        return None

    def close(self) -> Iterator[list[Piece]]:
        """What is open: full windows, and a few whose lengths are powers of two."""
        rest = deque(window for level in sorted(self.open, reverse=True) for window in self.open[level])
        self.open, self.count[:] = {}, 0
        while rest:
            window = rest.popleft()
            lacks = self.size - sum(len(p[2]) for p in window)
            while lacks and rest:
                ids = rest[-1][-1][2]
                if len(ids) <= lacks:
                    window.append(rest[-1].pop())
                else:  # its end stays behind
                    window.append(_part(rest[-1][-1], 0, lacks))
                    rest[-1][-1] = _part(rest[-1][-1], lacks, len(ids))
                lacks -= len(window[-1][2])
                if not rest[-1]:
                    rest.pop()
            while window:
                n, now = min(self.size, 1 << (sum(len(p[2]) for p in window).bit_length() - 1)), []
                while n:
                    piece = window.pop(0)
                    if len(piece[2]) > n:
                        window.insert(0, _part(piece, n, len(piece[2])))
                        piece = _part(piece, 0, n)
                    now.append(piece)
                    n -= len(piece[2])
                yield now


def _part(piece: Piece, low: int, high: int) -> Piece:
    return piece[0], piece[1] + low, piece[2][low:high], piece[3]


def _pieces(key: object, parts: list[np.ndarray], size: int, end: int) -> Iterator[Piece]:
    ids = np.concatenate([*parts, np.array([end], np.int32)])
    for start in range(0, len(ids), size):
        yield key, start, ids[start : start + size], len(ids)


_COLUMNS = "start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(documents: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, end: int = END, by_chunk: bool = False, ids: bool = True) -> DataFrame:
    """One row per piece of a document: its id, start (ids of the document before it), length, the CRC-32 of its ids (as little
    endian unsigned 32-bit numbers), the document's ids (its end included), the sequence and the offset there; with `ids`
    the ids themselves. Sequences have `size` ids, or fewer by a power of two."""
    schema = StructType([StructField(id_col, documents.schema[id_col].dataType), *StructType.fromDDL(_COLUMNS + (", ids array<int>" if ids else "")).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels, made, out, kinds = Levels(size), TaskContext.get().partitionId() << 33, [], None

        def written(window: list[Piece]) -> None:
            nonlocal made
            offset = 0
            for key, start, part, total in window:
                out.append((key, start, len(part), zlib.crc32(np.ascontiguousarray(part, "<u4")), total, made, offset, *([part] if ids else [])))
                offset += len(part)
            made += 1

        def batch() -> pa.RecordBatch:
            done = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=schema.names)
            out.clear()
            return done

        most = 500 if ids else 20_000
        for rows in batches:
            kinds = kinds or [rows.schema.field(0).type, *[pa.int64()] * 6, *([pa.list_(pa.int32())] if ids else [])]
            for key, parts in zip(rows.column(0).to_pylist(), encoder(tokenizer, by_chunk).of(rows.column(1)), strict=True):
                for piece in _pieces(key, parts, size, end):
                    full = [piece] if len(piece[2]) == size else levels.place((piece[0], piece[1], piece[2].copy(), piece[3]))  # copied: a view would keep the batch's ids
                    if full:
                        written(full)
                    if len(out) >= most:
                        yield batch()
        for window in levels.close():
            written(window)
        if out:
            yield batch()

    return documents.select(id_col, text_col).mapInArrow(run, schema)


def op12_packing(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    small_batches(spark)
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pack(documents, public_tokenizers.path("word_bpe_49k.json"), by_chunk=True, ids=False)
