"""Exact removal of repeated passages by enhanced suffix arrays over anchored contexts.

Every byte covered by a `least`-byte string that also starts earlier (in a smaller id, or earlier in the same text) goes.
Strings are judged on the texts as they came in, never across texts.

1. Anchors. Every string of `least` bytes selects the first of its GRAM-byte grams of least hash as its anchor. That
   depends on the string alone, so all its occurrences select the same gram. An anchor's context is what the strings that
   select it cover together.
2. Equal contexts (two 64-bit hashes: of the gram and of the context) are settled at once: all but the earliest are
   covered. Each batch settles its own before anything is shuffled, so a group of copies of any size sends one row per
   batch and anchor.
3. Grams left with several different contexts are gathered by gram. A shared string of `least` bytes holds one of SPLITS
   shorter stretches around the gram whole; contexts that share none of these (16 bits of each are compared) are let go
   without loss. The others' suffixes go into an enhanced suffix
   array (prefix doubling, longest common prefixes); a stack scan walks the tree of its common-prefix intervals, and the
   intervals whose occurrences differ in the byte before them are the maximal repeats. Of each, all occurrences but the
   earliest are covered. A gram with more than `max_group` different contexts never meets in one task: its strings are
   grouped by hash, with the earliest found by partial aggregation (the same result, without the tree).
4. The covered stretches are merged per text and cut out.

Defined cases: null is an empty text; an empty or short text loses nothing; an id must name one text (repeated rows with
equal id and text get equal results); rows with a null id lose nothing and cover nothing; extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spark import bitmap, cut, small_batches, texts_in
from .textscan import CHUNK, buffers, chunks, eights, hash_ranges, mix, windows_of

LEAST = 100
GRAM = 32
SPLITS = 4
MAX_GROUP = 20_000
HELD = 200_000
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
_ROWS = "kind int, fp long, ctx long, id long, pos int, ext int, near long"
_SALT = np.uint64(0x452821E638D01377)


def sliding(x: np.ndarray, width: int, best: np.ufunc) -> np.ndarray:
    """best of x[i : i + width] for each i at which that many follow."""
    done, out = 1, x
    while done < width:
        step = min(done, width - done)
        out = best(out[: len(out) - step], out[step:])
        done += step
    return out


def _smaller(place: np.ndarray, h: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """For each anchor the place of the nearest one before with a hash no larger, and after with a smaller one, as far as
    they stand within `width`; otherwise a place out of reach."""
    n, out = len(place), []
    for step in (-1, 1):
        found = np.full(n, -(1 << 40) if step < 0 else 1 << 40, dtype=np.int64)
        open_, other = np.arange(n), np.arange(n) + step
        while len(open_):
            inside = (other >= 0) & (other < n)
            open_, other = open_[inside], other[inside]
            near = np.abs(place[other] - place[open_]) < width
            open_, other = open_[near], other[near]
            hit = h[other] <= h[open_] if step < 0 else h[other] < h[open_]
            found[open_[hit]] = place[other[hit]]
            open_, other = open_[~hit], other[~hit] + step
        out.append(found)
    return out[0], out[1]


def anchors(data: np.ndarray, offsets: np.ndarray, least: int, gram: int) -> tuple[np.ndarray, ...]:
    """(row, place, hash, hash of the context, bytes of context before, bytes from the place on, hashes of the stretches)
    of a chunk's anchors. The last are SPLITS times 16 bits, 0 for a stretch that the text's edge cuts."""
    n, width = len(data), least - gram + 1
    empty = np.zeros(0, np.int64)
    if n < least:
        return empty, empty, empty.astype(np.uint64), empty.astype(np.uint64), empty, empty, empty.astype(np.uint64)
    eight = eights(data)
    end = np.repeat(offsets[1:], np.diff(offsets))
    at = np.arange(n - gram + 1)
    h = windows_of(eight[: n - 7], gram, 8)
    h[at + gram > end[: len(at)]] = _NONE
    low = sliding(h, width, np.minimum)
    low[np.arange(len(low)) + least > end[: len(low)]] = 0
    high = sliding(np.concatenate([np.zeros(width - 1, np.uint64), low, np.zeros(width - 1, np.uint64)]), width, np.maximum)
    place = np.flatnonzero((high == h) & (h != _NONE))
    row = np.searchsorted(offsets, place, side="right") - 1
    # Each string belongs to the first of its grams of least hash: an anchor's strings stop short of smaller neighbours.
    before, after = _smaller(place, h[place], width)
    first = np.maximum(np.maximum(offsets[row], place - width + 1), before + 1)
    last = np.minimum(np.minimum(offsets[row + 1] - least, place), after - width)
    own = last >= first
    place, row, first, last = place[own], row[own], first[own], last[own] + least
    ctx = mix(hash_ranges(eight, first, last) + (place - first).astype(np.uint64) * _SALT)
    near, free = np.zeros(len(place), np.uint64), least - gram
    for k in range(SPLITS):
        a, b = place - free * k // SPLITS, place + gram + free - free * (k + 1) // SPLITS
        whole = (a >= first) & (b <= last)
        a, b = np.where(whole, a, place), np.where(whole, b, place)
        near |= np.where(whole, (hash_ranges(eight, a, b, 1) & np.uint64(0xFFFF)) | np.uint64(1), np.uint64(0)) << np.uint64(16 * k)
    return row, place - offsets[row], h[place], ctx, place - first, last - place, near


def merged(ids: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The union of stretches per id."""
    if not len(ids):
        return ids, low, high
    order = np.lexsort((low, ids))
    ids, low, high = ids[order], low[order].astype(np.int64), high[order].astype(np.int64)
    fresh = np.concatenate([[True], ids[1:] != ids[:-1]])
    shift = np.cumsum(fresh) << 40
    reach = np.maximum.accumulate(high + shift)
    begin = np.flatnonzero(np.concatenate([[True], (low + shift)[1:] > reach[:-1]]))
    stop = np.append(begin[1:], len(ids)) - 1
    return ids[begin], low[begin], reach[stop] - shift[stop]


def _rows(kind: int, fp: np.ndarray, ctx: np.ndarray, ids: np.ndarray, pos: np.ndarray, ext: np.ndarray, near: np.ndarray) -> pa.RecordBatch:
    kinds = np.full(len(ids), kind, dtype=np.int32)
    return pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(fp.view(np.int64)), pa.array(ctx.view(np.int64)), pa.array(ids), pa.array(pos.astype(np.int32)), pa.array(ext.astype(np.int32)), pa.array(near.view(np.int64))], names=["kind", "fp", "ctx", "id", "pos", "ext", "near"])


def _covered(ids: np.ndarray, low: np.ndarray, high: np.ndarray) -> pa.RecordBatch:
    """Stretches as rows of kind 1, spread by id."""
    ids, low, high = merged(ids, low, high)
    return _rows(1, mix(ids.view(np.uint64)), np.zeros(len(ids), np.uint64), ids, low, high, np.zeros(len(ids), np.uint64))


def _mark(least: int, gram: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for row, _, data, offsets in chunks(batch.column(1), CHUNK // 2):  # a dozen arrays of eight bytes for each byte
                own, *rest = anchors(data, offsets, least, gram)
                parts.append((ids[row + own], *rest))
            if not parts:
                continue
            doc, pos, fp, ctx, left, right, near = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.lexsort((pos, doc, ctx, fp))
            doc, pos, fp, ctx, left, right, near = (x[order] for x in (doc, pos, fp, ctx, left, right, near))
            first = np.ones(len(fp), dtype=bool)
            first[1:] = (fp[1:] != fp[:-1]) | (ctx[1:] != ctx[:-1])
            yield _rows(0, fp[first], ctx[first], doc[first], pos[first], (left * 1024 + right)[first], near[first])
            top = np.maximum.accumulate(np.where(first, np.arange(len(fp)), 0))
            later = ~first & ((doc != doc[top]) | (pos != pos[top]))  # a repeated row's context is not later than itself
            if later.any():
                yield _covered(doc[later], (pos - left)[later], (pos + right)[later])

    return scan


def _partnered(fp: np.ndarray, near: np.ndarray) -> np.ndarray:
    """Which of some rows share a stretch with another row of their gram."""
    group = np.cumsum(np.concatenate([[0], fp[1:] != fp[:-1]])) if len(fp) else np.zeros(0, np.int64)
    some = np.zeros(len(fp), dtype=bool)
    near = near.view(np.uint64)
    for k in range(SPLITS):
        part = ((near >> np.uint64(16 * k)) & np.uint64(0xFFFF)).astype(np.int64)
        _, at, count = np.unique(group << 16 | part, return_inverse=True, return_counts=True)
        some |= (count[at] > 1) & (part > 0)
    return some


def _settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over rows sorted by kind, gram, context, id, place: stretches pass, later equal contexts become stretches, and the
    first of each context stays if another context of its gram may share a string with it. Holds the contexts of one gram;
    beyond HELD of them they go out unfiltered and one row is held."""
    held: list[np.ndarray] | None = None  # the first rows of the latest gram
    loose = False  # whether they went out already, but for the order of what follows

    def out(cols: list[np.ndarray], keep: np.ndarray) -> Iterator[pa.RecordBatch]:
        if keep.any():
            yield _rows(0, *(x[keep] for x in cols))

    for batch in batches:
        kind, *cols = (batch.column(k).to_numpy() for k in range(7))
        stretch = kind == 1
        if stretch.any():
            yield _covered(cols[2][stretch], cols[3][stretch], cols[4][stretch])
        cols = [x[~stretch] for x in cols]
        if not len(cols[0]):
            continue
        if held is not None:
            cols = [np.concatenate([h, c]) for h, c in zip(held, cols, strict=True)]
        fp, ctx, ids, pos, ext, _ = cols
        first = np.concatenate([[True], (fp[1:] != fp[:-1]) | (ctx[1:] != ctx[:-1])])
        top = np.maximum.accumulate(np.where(first, np.arange(len(fp)), 0))
        later = ~first & ((ids != ids[top]) | (pos != pos[top]))
        if later.any():
            yield _covered(ids[later], (pos - ext // 1024)[later], (pos + ext % 1024)[later])
        cols = [x[first] for x in cols]
        begin = int(np.searchsorted(cols[0], cols[0][-1]))
        if loose:
            told = int(np.searchsorted(cols[0], cols[0][0], side="right"))
            yield from out([x[1:told] for x in cols], np.ones(told - 1, dtype=bool))
            if begin == 0:
                held = [x[-1:] for x in cols]
                continue
            cols, begin, loose = [x[told:] for x in cols], begin - told, False
        done = [x[:begin] for x in cols]
        yield from out(done, _partnered(done[0], done[5]))
        held = [x[begin:] for x in cols]
        if len(held[0]) > HELD:
            yield from out(held, np.ones(len(held[0]), dtype=bool))
            held, loose = [x[-1:] for x in held], True
    if held is not None and not loose:
        yield from out(held, _partnered(held[0], held[5]))


class SuffixArray:
    """Suffixes (of at least `least` bytes) of some stretches of a buffer, ordered within groups, with their longest common prefixes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, starts: np.ndarray, groups: np.ndarray):
        """starts: the suffixes wanted; groups: their groups. A suffix ends with its stretch."""
        n = len(data)
        size = int(np.diff(offsets).max()) if len(offsets) > 1 else 0
        end = np.repeat(offsets[1:], np.diff(offsets))
        value = np.zeros(n + 8, dtype=np.uint64)
        room = end - np.arange(n)
        for k in range(7):  # 7 bytes to a key, each a byte value + 1, 0 behind the end (9 bits each)
            byte = np.zeros(n, dtype=np.uint64)
            byte[: n - k] = data[k:].astype(np.uint64) + 1
            byte[room <= k] = 0
            value[:n] = (value[:n] << np.uint64(9)) | byte
        depth, rank = 7, np.unique(value[:n], return_inverse=True)[1].astype(np.int64) + 1
        levels = [(7, rank)]
        while depth < size:
            ahead = np.zeros(n, dtype=np.int64)
            ahead[: n - depth] = rank[depth:] if depth < n else 0
            ahead[room <= depth] = 0
            rank = np.unique(rank * (n + 2) + ahead, return_inverse=True)[1].astype(np.int64) + 1
            depth *= 2
            levels.append((depth, rank))
        order = np.lexsort((starts, rank[starts], groups))
        self.at, self.group = starts[order], groups[order]
        p, q = self.at[:-1].copy(), self.at[1:].copy()
        common = np.zeros(len(p), dtype=np.int64)
        alive = self.group[1:] == self.group[:-1]
        most = np.minimum(end[p], end[p]) - p if n else common
        most = np.minimum(most, end[q] - q) if n else common
        for depth, rank in reversed(levels):
            a, b = np.minimum(p + common, n - 1), np.minimum(q + common, n - 1)
            same = alive & (common + depth <= most) & (rank[a] == rank[b])
            common[same] += depth
        for _ in range(6):
            a, b = np.minimum(p + common, n - 1), np.minimum(q + common, n - 1)
            same = alive & (common < most) & (data[a] == data[b])
            going = same.copy()
            common[going] += 1
            alive = alive & same
        self.common = np.where(self.group[1:] == self.group[:-1], common, 0)
        self.before = np.where(np.isin(self.at, offsets), -1, data[np.maximum(self.at - 1, 0)].astype(np.int64)) if n else np.zeros(0, np.int64)

    def maximal_repeats(self, least: int) -> Iterator[tuple[int, int, int]]:
        """(length, first, last) of the common-prefix intervals of at least `least` bytes whose occurrences are preceded
        by different bytes (or by the edge of their stretch)."""
        common, before = self.common, self.before.tolist()
        runs = np.flatnonzero(np.diff(np.concatenate([[False], common >= least, [False]]).astype(np.int8)))
        for a, b in zip(runs[::2].tolist(), runs[1::2].tolist(), strict=True):
            stack: list[list[int]] = []  # open intervals: length, first suffix, byte before them or -1 if that differs
            for k, length in enumerate([*common[a:b].tolist(), 0]):
                first, left = a + k, before[a + k]
                while stack and stack[-1][0] > length:
                    closed, first, other = stack.pop()
                    left = left if left == other else -1
                    if left == -1:
                        yield closed, first, a + k
                if length >= least:
                    if stack and stack[-1][0] == length:
                        stack[-1][2] = left if left == stack[-1][2] else -1
                    else:
                        stack.append([length, first, left])


def covered_by_repeats(data: np.ndarray, offsets: np.ndarray, groups: np.ndarray, ids: np.ndarray, places: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stretches (id, start, end) of the given contexts that repeat earlier within their group."""
    room = np.diff(offsets)
    starts = np.flatnonzero(np.repeat(offsets[1:], room) - np.arange(len(data)) >= least)
    none = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    if not len(starts):
        return none
    owner = np.searchsorted(offsets, starts, side="right") - 1
    key = windows_of(eights(data)[: len(data) - 7], least, 8)[starts] ^ mix(groups[owner].view(np.uint64))
    _, inverse, count = np.unique(key, return_inverse=True, return_counts=True)
    some = np.unique(owner[count[inverse] > 1])  # contexts without a string that repeats need no suffixes
    if not len(some):
        return none
    picked = np.concatenate([data[offsets[k] : offsets[k + 1]] for k in some])
    bounds = np.concatenate([[0], np.cumsum(room[some])])
    wanted = np.flatnonzero(np.isin(starts, starts[count[inverse] > 1]) & np.isin(owner, some))
    moved = starts[wanted] - offsets[owner[wanted]] + bounds[np.searchsorted(some, owner[wanted])]
    array = SuffixArray(picked, bounds, moved, groups[owner[wanted]])
    own = np.searchsorted(bounds, array.at, side="right") - 1
    doc, start = ids[some][own], places[some][own] + array.at - bounds[own]
    order = np.lexsort((start, doc))
    fresh = np.concatenate([[False], (doc[order][1:] != doc[order][:-1]) | (start[order][1:] != start[order][:-1])])
    rank = np.empty(len(order), dtype=np.int64)
    rank[order] = np.cumsum(fresh)
    reach = np.zeros(len(rank), dtype=np.int64)
    for length, first, last in array.maximal_repeats(least):
        part = rank[first : last + 1]
        view = reach[first : last + 1]
        later = part > part.min()
        view[later] = np.maximum(view[later], length)
    hit = reach > 0
    return doc[hit], start[hit], start[hit] + reach[hit]


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over (id, text, anchors): the context of each anchor."""
    for batch in batches:
        data, offsets = buffers(batch.column(1))
        ids, lists = batch.column(0).to_numpy(), batch.column(2)
        bounds = lists.offsets.to_numpy().astype(np.int64)
        fp, pos, ext = (x.to_numpy(zero_copy_only=False)[bounds[0] : bounds[-1]].astype(np.int64) for x in lists.values.flatten())
        doc = np.searchsorted(bounds, np.arange(bounds[0], bounds[-1]), side="right") - 1
        low, high = pos - ext // 1024, pos + ext % 1024
        for s in range(0, len(fp), 20_000):
            part = slice(s, s + 20_000)
            a, b = offsets[doc[part]] + low[part], offsets[doc[part]] + high[part]
            texts = [data[x:y].tobytes() for x, y in zip(a.tolist(), b.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(fp[part]), pa.array(ids[doc[part]]), pa.array(low[part].astype(np.int32)), pa.array(texts, pa.binary())], names=["fp", "id", "low", "bytes"])


def _trees(least: int, together: int = 3_000):
    """Over contexts sorted by gram: stretches that repeat earlier."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        rows = 0

        def work(table: pa.Table) -> Iterator[pa.RecordBatch]:
            if table.num_rows:
                data, offsets = buffers(table.column(3))
                fp, ids, low = (table.column(k).to_numpy() for k in range(3))
                doc, start, end = covered_by_repeats(data[offsets[0] : offsets[-1]], offsets - offsets[0], fp, ids, low.astype(np.int64), least)
                if len(doc):
                    doc, start, end = merged(doc, start, end)
                    yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(start, pa.int32()), pa.array(end, pa.int32())], names=["id", "pos", "ext"])

        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows < together:
                continue
            table = pa.Table.from_batches(held)
            fp = table.column(0).to_numpy()
            done = int(np.flatnonzero(fp == fp[-1])[0])  # the last gram may go on
            yield from work(table.slice(0, done))
            held, rows = table.slice(done).to_batches(), table.num_rows - done
        if held:
            yield from work(pa.Table.from_batches(held))

    return scan


def stretches(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, gram: int = GRAM, max_group: int = MAX_GROUP) -> DataFrame:
    """(id, spans): the covered stretches of each text that has any, unmerged, in bytes."""
    if not 8 <= gram <= least < 1024:
        raise ValueError(f"gram {gram} and least {least}: at least 8 bytes, and less than 1024")
    docs = documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).filter("id is not null")
    rows = docs.mapInArrow(_mark(least, gram), _ROWS).repartition("fp").sortWithinPartitions("kind", "fp", "ctx", "id", "pos").mapInArrow(_settle, _ROWS)
    rows = cut(rows)
    known = rows.filter("kind = 1").select("id", "pos", "ext")
    open_ = rows.filter("kind = 0").select("fp", "id", "pos", "ext")
    crowded = open_.groupBy("fp").agg(F.count("*").alias("n")).filter(F.col("n") > max_group).select("fp")
    some = crowded.limit(1).count() > 0
    if some:
        crowded = cut(crowded)
    listed = open_.groupBy("id").agg(F.collect_list(F.struct("fp", "pos", "ext")).alias("anchors"))
    contexts = texts_in(docs, bitmap(open_)).join(listed, "id").select("id", "text", "anchors").mapInArrow(_slices, "fp long, id long, low int, bytes binary")
    usual = contexts.join(crowded, "fp", "left_anti") if some else contexts
    found = usual.repartition("fp").sortWithinPartitions("fp", "id", "low").mapInArrow(_trees(least), "id long, pos int, ext int")
    if some:
        strings = contexts.join(crowded, "fp", "left_semi").select("id", F.explode(F.sequence(F.lit(0), F.length("bytes") - least)).alias("k"), "low", "bytes")
        strings = strings.select("id", (F.col("low") + F.col("k")).alias("pos"), F.sha2(F.substring("bytes", F.col("k") + 1, F.lit(least)), 256).alias("of"))
        first = cut(strings.groupBy("of").agg(F.min(F.struct("id", "pos")).alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n"))
        later = strings.join(first, "of").filter(F.struct("id", "pos") > F.col("first"))
        found = found.unionByName(later.select("id", "pos", (F.col("pos") + least).alias("ext")))
    return known.unionByName(found).groupBy("id").agg(F.collect_list(F.struct("pos", "ext")).alias("spans"))


def _cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = buffers(batch.column(1))
        out = []
        for k, spans in enumerate(batch.column(2)):
            text = data[offsets[k] : offsets[k + 1]]
            removed = n_spans = 0
            kept = hashlib.sha256()
            done = 0
            if spans.is_valid and len(spans.values):
                low, high = (x.to_numpy(zero_copy_only=False).astype(np.int64) for x in spans.values.flatten())
                _, low, high = merged(np.zeros(len(low), np.int64), low, high)
                for a, b in zip(low.tolist(), high.tolist(), strict=True):
                    kept.update(text[done:a].tobytes())
                    removed += b - a
                    n_spans += 1
                    done = b
            kept.update(text[done:].tobytes())
            out.append((len(text), removed, n_spans, kept.hexdigest()))
        cols = list(zip(*out, strict=True)) or [(), (), (), ()]
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, pa.int64()) for c in cols[:3]), pa.array(cols[3], pa.string())], names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def op6_suffix_array_dedup(spark, sf_dir: str) -> DataFrame:
    small_batches(spark)
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    docs = documents.select(F.col("doc_id").cast("long").alias("id"), "text")
    cuts = cut(stretches(documents))
    bits, kind = bitmap(cuts), cuts.schema["spans"].dataType
    hit = texts_in(docs, bits).join(cuts, "id", "left").select("id", "text", "spans")
    rest = texts_in(docs, bits, inside=False).withColumn("spans", F.lit(None).cast(kind))
    out = hit.unionByName(rest).mapInArrow(_cut_out, "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return out.select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")
