"""Near-duplicate lines by a deletion-neighbourhood join; the earliest of them stays.

Lines are what line feeds separate, read as lower-cased (A-Z) words between spaces. A line goes if an earlier line (in a
smaller id, or earlier in the same text) has the same words, or, for lines of at least `near_words` words, differs by one
word put in, taken out or exchanged. Lines of fewer than `min_words` words repeat by chance and always stay. Lines are
judged on the texts as they came in.

1. Equal lines: each batch settles its own, then one shuffle by the line's hash settles the rest. Lines count as equal
   when two independent hashes of their words agree (124 bits; see textscan.Powers).
2. Of two lines within one edit, the first or the last half agrees word by word. A shuffle of four hashed halves a line
   finds the lines that have a partner at all (a loss-free filter).
3. Those emit the whole deletion neighbourhood, hashed: the line itself, and the line without each of its words. Equal
   variants meet: lines of one length with the same place deleted, or a whole line with a longer one.
4. The words of each pair that met are fetched, and their edit distance is verified before the later line goes.

No step collects a group: a hot line, half or variant streams past one or two held rows, and each line that is to go
brings one pair for each variant that told so.

Defined cases: null and empty texts have one line, which stays; blank lines stay (they have fewer than `min_words` words);
an id must name one text (repeated rows with equal id and text get equal results, and neither counts as earlier than the
other, so their lines stay unless a smaller id or an earlier line has them); rows with a null id keep all their lines;
extra columns are carried, whatever their names; an empty table gives none.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spark import bitmap, cut, rows_in, small_batches, texts_in, unused
from .textscan import LOWER, NOT_SPACE, Powers, Words, buffers, chunks, mix, word_hashes

MIN_WORDS = 5
NEAR_WORDS = 10
_LINES = "kind int, hash long, check long, id long, line int, a1 long, b1 long, a2 long, b2 long"
_PLACES = "id long, line int"
_PAIRS = "id long, line int, other long, at int"
_HALVES = ("a1", "b1", "a2", "b2")


class Lines:
    """Lines of a chunk: row, number within the row, and the index of the first word."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        data = LOWER[data]
        self.words = words = Words(data, offsets, NOT_SPACE)
        self.data, self.hashes = data, word_hashes(data, words)
        self.powers = Powers(self.hashes)
        feeds = np.flatnonzero(data == 10)
        start = np.concatenate([offsets[:-1], feeds + 1])
        row = np.concatenate([np.arange(len(offsets) - 1), np.searchsorted(offsets, feeds, side="right") - 1])
        order = np.lexsort((row, start))
        self.row, start = row[order], start[order]
        self.number = np.arange(len(start)) - np.searchsorted(self.row, self.row)
        self.first = np.append(np.searchsorted(words.start, start), len(words.start))
        self.count = np.diff(self.first)


def _earlier(id_a: np.ndarray, line_a: np.ndarray, id_b: np.ndarray, line_b: np.ndarray) -> np.ndarray:
    return (id_a < id_b) | (id_a == id_b) & (line_a < line_b)


def _lines(kind: int, cols: list[np.ndarray]) -> pa.RecordBatch:
    """Of hash, check, id, line and halves."""
    h, check, ids, line, *halves = cols
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(h), kind, np.int32)), pa.array(h.view(np.int64)), pa.array(check.view(np.int64)), pa.array(ids), pa.array(line.astype(np.int32)), *(pa.array(x.view(np.int64)) for x in halves)], names=["kind", "hash", "check", "id", "line", *_HALVES])


def _mark(min_words: int, near_words: int):
    """Lines of kind 0 (the earliest of its hash in the batch), and of kind 1 (to go)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, parts = batch.column(0).to_numpy(), []
            for row, _, data, offsets in chunks(batch.column(1)):
                lines = Lines(data, offsets)
                long = np.flatnonzero(lines.count >= min_words)
                a, n = lines.first[long], lines.count[long]
                of, near, halves = lines.powers.of, n >= near_words, []
                for most in (n, n + 1):
                    half = most // 2
                    for side, (s, e) in enumerate(((a, a + half), (a + n - half, a + n))):
                        salt = mix((most * 2 + side).astype(np.uint64))
                        halves.append(np.where(near, mix(of(s, e) ^ salt) | np.uint64(1), np.uint64(0)))
                parts.append((of(a, a + n), Powers(lines.hashes, 1).of(a, a + n), ids[row + lines.row[long]], lines.number[long], *halves))
            if not parts:
                continue
            cols = [np.concatenate(x) for x in zip(*parts, strict=True)]
            h, check, own, line = cols[:4]
            order = np.lexsort((line, own, check, h))
            cols = [x[order] for x in cols]
            h, check, own, line = cols[:4]
            first = np.ones(len(h), dtype=bool)
            first[1:] = (h[1:] != h[:-1]) | (check[1:] != check[:-1])
            yield _lines(0, [x[first] for x in cols])
            top = np.maximum.accumulate(np.where(first, np.arange(len(h)), 0))
            gone = _earlier(own[top], line[top], own, line)
            if gone.any():
                zero = np.zeros(int(gone.sum()), np.uint64)
                yield _lines(1, [mix(own[gone].view(np.uint64)), zero, own[gone], line[gone], *([zero] * 4)])

    return scan


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over lines sorted by kind, hash, check, id, number: kind 0 for the earliest of each hash, kind 1 for those to go. A
    repeated row's line that is the earliest itself is passed once. Holds that line."""
    held = None
    for batch in batches:
        cols = [batch.column(k).to_numpy() for k in range(5)]
        if not len(cols[0]):
            continue
        if held is not None:
            cols = [np.concatenate([x, c]) for x, c in zip(held, cols, strict=True)]
        kind, h, check, ids, number = cols
        first = np.concatenate([[True], (h[1:] != h[:-1]) | (check[1:] != check[:-1]) | (kind[1:] != 0)])
        top = np.maximum.accumulate(np.where(first, np.arange(len(h)), 0))
        later = ~first & _earlier(ids[top], number[top], ids, number)
        skip = 0 if held is None else 1
        held = [x[top[-1:]] for x in cols]
        out = batch.set_column(0, "kind", pa.array(np.where(later, 1, kind)[skip:].astype(np.int32)))
        yield out.filter(pa.array((first | later)[skip:]))


def _partners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over (half, id, line) sorted by half: the lines whose half another line has. Holds one row."""
    held = None
    for batch in batches:
        half, ids, line = (batch.column(k).to_numpy() for k in range(3))
        if not len(half):
            continue
        if held is not None:
            half, ids, line = (np.concatenate([h, c]) for h, c in zip(held, (half, ids, line), strict=True))
        same = half[1:] == half[:-1]
        some = np.concatenate([[False], same]) | np.concatenate([same, [False]])
        held = half[-1:], ids[-1:], line[-1:]
        if some.any():
            yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(line[some])], names=["id", "line"])


def _neighbourhood(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over (id, text, lines): (variant, place, id, line) for the whole line (place -1) and for each deleted word."""
    for batch in batches:
        ids = batch.column(0).to_numpy()
        for row, stop, data, offsets in chunks(batch.column(1)):
            lines = Lines(data, offsets)
            lists = batch.column(2).slice(row, stop - row)
            bounds = lists.offsets.to_numpy()
            wanted = lists.values.to_numpy(zero_copy_only=False)[bounds[0] : bounds[-1]]
            owner = np.repeat(np.arange(stop - row), np.diff(bounds))
            at = np.searchsorted(lines.row, owner) + wanted
            for s in range(0, len(at), 4096):
                k = at[s : s + 4096]
                first, n = lines.first[k], lines.count[k]
                which = np.repeat(np.arange(len(k)), n)
                place = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
                a, b = first[which], (first + n)[which]
                key = np.concatenate([lines.powers.without(a, b, a + place), lines.powers.of(first, first + n)])
                which = np.concatenate([which, np.arange(len(k))])
                places = np.concatenate([place, np.full(len(k), -1)])
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(places.astype(np.int32)), pa.array(ids[row + lines.row[k]][which]), pa.array(lines.number[k][which].astype(np.int32))], names=["variant", "place", "id", "line"])


def _meeting(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over variants sorted by variant, place, id, line: each line that an earlier one seems one edit from, with that one.

    A variant's row of place -1 (there is one at most, lines being distinct, but for repeated rows) is a shorter line; all
    others were longer by the word at their place. A repeated row's line is not earlier than itself. Holds two rows: that
    one, and the earliest of the place in hand.
    """
    held: list[np.ndarray] | None = None
    for batch in batches:
        cols = [batch.column(k).to_numpy() for k in range(4)]
        if not len(cols[0]):
            continue
        if held is not None:
            cols = [np.concatenate([h, c]) for h, c in zip(held, cols, strict=True)]
        variant, place, ids, line = cols
        new = np.concatenate([[True], variant[1:] != variant[:-1]])
        first = new | np.concatenate([[True], place[1:] != place[:-1]])
        before = np.maximum.accumulate(np.where(first, np.arange(len(first)), 0))  # the first row of the variant's place
        later = np.flatnonzero((place >= 0) & _earlier(ids[before], line[before], ids, line))
        start = np.flatnonzero(new)
        top = start[np.cumsum(new) - 1]  # the first row of the variant
        whole = place[top] == -1
        longer = np.flatnonzero(first & whole & (place >= 0))
        short = _earlier(ids[top[longer]], line[top[longer]], ids[longer], line[longer])
        gone = np.concatenate([later, longer[short], top[longer[~short]]])
        told = np.concatenate([before[later], top[longer[short]], longer[~short]])
        if len(gone):
            yield pa.RecordBatch.from_arrays([pa.array(ids[gone]), pa.array(line[gone]), pa.array(ids[told]), pa.array(line[told])], names=["id", "line", "other", "at"])
        keep = [int(np.flatnonzero(first)[-1])]
        if whole[-1] and top[-1] != keep[0]:
            keep.insert(0, int(top[-1]))
        held = [x[keep] for x in cols]


def _said(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over (id, text, lines): (id, line, words), the words of each listed line between single spaces."""
    for batch in batches:
        ids, wanted = batch.column(0).to_pylist(), batch.column(2).to_pylist()
        for row, _, data, offsets in chunks(batch.column(1)):
            lower = LOWER[data]
            for k in range(len(offsets) - 1):
                text = lower[offsets[k] : offsets[k + 1]].tobytes().split(b"\n")
                said = [b" ".join(text[n].split()) for n in wanted[row + k]]
                yield pa.RecordBatch.from_arrays([pa.array([ids[row + k]] * len(said), pa.int64()), pa.array(wanted[row + k], pa.int32()), pa.array(said, pa.binary())], names=["id", "line", "words"])


def one_edit(a: list[bytes], b: list[bytes]) -> bool:
    """Whether one word put in, taken out or exchanged makes a of b (or nothing does)."""
    if len(a) < len(b):
        a, b = b, a
    k = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(b))
    return a[k + 1 :] == b[k + 1 :] if len(a) == len(b) else a[k + 1 :] == b[k:]


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over (id, line, words, other's words): the lines that are within one edit of the other."""
    for batch in batches:
        pairs = zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)
        yield batch.select([0, 1]).filter(pa.array([one_edit(a.split(b" "), b.split(b" ")) for a, b in pairs], pa.bool_()))


def _listed(places: DataFrame) -> DataFrame:
    return places.groupBy("id").agg(F.sort_array(F.collect_set("line")).alias("lines"))


def _within_one_edit(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """(id, line) of the pairs (id, line, other, at) whose words are within one edit of each other."""
    ends = _listed(pairs.select("id", "line").unionByName(pairs.select(F.col("other").alias("id"), F.col("at").alias("line"))))
    ends = cut(ends)
    words = texts_in(docs, bitmap(ends)).join(ends, "id").select("id", "text", "lines").mapInArrow(_said, "id long, line int, words binary").dropDuplicates(["id", "line"])
    words = cut(words)
    theirs = words.select(F.col("id").alias("other"), F.col("line").alias("at"), F.col("words").alias("others"))
    both = pairs.join(words, ["id", "line"]).join(theirs, ["other", "at"])
    return both.select("id", "line", "words", "others").mapInArrow(_verified, _PLACES)


def repeated_lines(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, near_words: int = NEAR_WORDS) -> DataFrame:
    """(id, lines): the numbers, from 0, of the lines to go, for each text that has any."""
    docs = documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).filter("id is not null")
    rows = docs.mapInArrow(_mark(min_words, near_words), _LINES).repartition("hash").sortWithinPartitions("kind", "hash", "check", "id", "line").mapInArrow(_settle, _LINES)
    rows = cut(rows)
    halves = rows.filter("kind = 0 and a1 <> 0").select(F.explode(F.array_distinct(F.array(*_HALVES))).alias("half"), "id", "line")
    partners = halves.repartition("half").sortWithinPartitions("half").mapInArrow(_partners, _PLACES)
    listed = cut(_listed(partners))
    variants = texts_in(docs, bitmap(listed)).join(listed, "id").select("id", "text", "lines").mapInArrow(_neighbourhood, "variant long, place int, id long, line int")
    pairs = cut(variants.repartition("variant").sortWithinPartitions("variant", "place", "id", "line").mapInArrow(_meeting, _PAIRS).distinct())
    return _listed(rows.filter("kind = 1").select("id", "line").unionByName(_within_one_edit(pairs, docs)))


def without(text: bytes, lines: list[int]) -> bytes:
    drop = set(lines)
    return b"\n".join(x for k, x in enumerate(text.split(b"\n")) if k not in drop)


def remove(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """documents without the repeated lines; a row that nothing but blank lines remains of goes altogether.

    Rows that lose no line are returned as they are, whatever they hold.
    """
    own, drop = unused(documents, "own", "drop")
    lines = cut(repeated_lines(documents, id_col=id_col, text_col=text_col, **options))
    bits = bitmap(lines)  # only texts that may lose a line are shuffled
    lines = lines.select(F.col("id").alias(own), F.col("lines").alias(drop))
    named = rows_in(documents, id_col, bits).join(lines, F.col(id_col).cast("long") == F.col(own), "left").select(*documents.columns, drop)
    at, names = documents.columns.index(text_col), documents.columns

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            keep = [True] * len(texts)
            for k, gone in enumerate(batch.column(len(names)).to_pylist()):
                if gone:
                    texts[k] = without(texts[k].encode(), gone).decode()
                    keep[k] = bool(texts[k].strip())
            out = [pa.array(texts, batch.column(at).type) if c == at else batch.column(c) for c in range(len(names))]
            yield pa.RecordBatch.from_arrays(out, names=names).filter(pa.array(keep, pa.bool_()))

    return named.mapInArrow(scan, documents.schema).unionByName(rows_in(documents, id_col, bits, inside=False))


def _report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = buffers(batch.column(1))
        out = []
        for k, drop in enumerate(batch.column(2).to_pylist()):
            text = data[offsets[k] : offsets[k + 1]].tobytes()
            out.append((text.count(b"\n") + 1, len(drop or ()), hashlib.sha256(without(text, drop or [])).hexdigest()))
        cols = list(zip(*out, strict=True)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string())], names=["doc_id", "n_lines", "n_removed", "kept_sha256"])


def op1_line_dedup(spark, sf_dir: str) -> DataFrame:
    """One row per document: n_lines, n_removed, and the SHA-256 of the text that is left."""
    small_batches(spark)
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    docs = documents.select(F.col("doc_id").cast("long").alias("id"), "text")
    lines = cut(repeated_lines(documents))
    bits = bitmap(lines)
    hit = texts_in(docs, bits).join(lines, "id", "left").select("id", "text", "lines")
    rest = texts_in(docs, bits, inside=False).withColumn("lines", F.lit(None).cast("array<int>"))
    return hit.unionByName(rest).mapInArrow(_report, "doc_id long, n_lines long, n_removed long, kept_sha256 string")
