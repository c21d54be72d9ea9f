"""Exact n-gram Jaccard join through a token-group matrix.

A document's set is that of its distinct `size`-word shingles (one shingle of all its words if it has fewer). Two
documents link when 100 * intersection >= percent * union.

1. Shingles get a global order: those that are frequent somewhere come last, by their count; the others by their hash.
2. Similar documents share a group: it is named by the document's shingle of least hash, whatever its count (a min-hash).
3. The matrix has a row for each shingle that stands in a document's prefix (its first n - ceil(percent n / 100) + 1
   shingles; two linked documents always share one) with the groups that have it. Groups beyond `group_rows` members are
   dealt into parts.
4. First the members of each group are compared, and documents that come together so form a component. Then documents
   query the other groups with which they share a row of the matrix (of two groups, the one with the smaller name asks;
   both must have enough shingles left from there on) unless all its members there are of their component: first one document of each component for each group, then, with
   the components that this gave, every document that still has something to ask. Rows of the matrix whose documents are
   all of one component are left out before they are compared. Copies of one text thus cost a few queries, not all pairs.
5. A query and the members of its group first meet as sketches (how many shingles fall into each of some cells), which
   bound from above what they can have in common. What is left meets as texts, where the union of the members' shingles
   is stored: a query opens a group only if the union holds as many of its shingles as a link needs, and is compared
   with members that are not of its component already. A group part that many query is met in slices of its queries, each
   with all its members.

No link between different sets is lost: prefixes and bounds are exact, and nothing is capped. Equal sets are found by a
128-bit digest and counted once per batch. Components come from the links.

Defined cases: null and empty texts have no set (n_shingles 0) and are their own component; rows with a null id get a
null component; an id must name one text (repeated rows with equal id and text stay, with equal results). The id must be an
integer column; extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .spark import bitmap, components, cut, small, small_batches, texts_in
from .textscan import LOWER, NOT_SPACE, Words, chunks, ids_of, mix, windows_of, word_hashes

GROUP_ROWS = 256
SLICE = 256
MAX_FREQUENT = 1 << 16
LOCAL_FREQUENT = 4
MEMBER = -1
_TOP = np.uint64(1 << 63)


def shingles(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes (63 bits) of a chunk's rows, sorted by row then hash, and each row's first position."""
    data = LOWER[data]
    words = Words(data, offsets, NOT_SPACE)
    hashed = word_hashes(data, words)
    at = words.windows(size)
    row = np.searchsorted(words.first, at, side="right") - 1
    h = windows_of(hashed, size)[at] >> np.uint64(1) if len(at) else np.zeros(0, np.uint64)
    short = np.flatnonzero((words.count > 0) & (words.count < size))
    if len(short):
        own = np.empty(len(short), dtype=np.uint64)
        for m in range(1, size):
            some = words.count[short] == m
            if some.any():
                own[some] = windows_of(hashed, m)[words.first[short[some]]] >> np.uint64(1)
        h, row = np.concatenate([h, own]), np.concatenate([row, short])
        order = np.argsort(row, kind="stable")
        h, row = h[order], row[order]
    sort_rows(h, np.searchsorted(row, np.arange(len(offsets))))
    fresh = np.ones(len(h), dtype=bool)
    fresh[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    h, row = h[fresh], row[fresh]
    return h, np.searchsorted(row, np.arange(len(offsets)))


def sort_rows(h: np.ndarray, first: np.ndarray) -> None:
    """Sorts each row's stretch in place."""
    for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True):
        h[a:b].sort()


def sketch(h: np.ndarray) -> np.ndarray:
    """How many of a set's shingles fall into each of a power of two of cells, about one cell for two shingles; 255: or more."""
    cells = int(min(4096, max(64, 1 << max(0, (len(h) - 1).bit_length() - 1))))
    counts = np.bincount((h >> np.uint64(63 - cells.bit_length() + 1)).astype(np.int64), minlength=cells)
    return np.minimum(counts, 255).astype(np.uint8)


def most_common(x: np.ndarray, others: np.ndarray) -> np.ndarray:
    """No set of sketch x can have more shingles in common with those of the sketches in `others`' rows."""
    x, others = x.astype(np.int64), others.astype(np.int64)
    x[x == 255] = 1 << 40
    others[others == 255] = 1 << 40
    cells = min(len(x), others.shape[1])
    return np.minimum(x.reshape(cells, -1).sum(1), others.reshape(len(others), cells, -1).sum(2)).sum(1)


def _digests(h: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for salt in (np.uint64(0x243F6A8885A308D3), np.uint64(0x13198A2E03707344)):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(h ^ salt), dtype=np.uint64)])
        out.append((sums[first[1:]] - sums[first[:-1]]).view(np.int64))
    return out[0], out[1]


def _least(n: np.ndarray, percent: int) -> np.ndarray:
    """The smallest intersection with which a set of n can link."""
    return -(-percent * n // 100)


def sets(documents: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """(id, n, d1, d2, sketch): size, digest and sketch of each row's set."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, stop, data, offsets in chunks(batch.column(1)):
                h, first = shingles(data, offsets, size)
                d1, d2 = _digests(h, first)
                cells = pa.array([sketch(h[a:b]).tobytes() for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, stop - row), pa.array(np.diff(first), pa.int64()), pa.array(d1), pa.array(d2), cells], names=["id", "n", "d1", "d2", "sketch"])

    return documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(scan, "id long, n long, d1 long, d2 long, sketch binary")


def frequent_shingles(documents: DataFrame, text_col: str, size: int) -> np.ndarray:
    """Shingles in at least LOCAL_FREQUENT different sets of some batch, rarest first; MAX_FREQUENT of them at most.

    They only shape the order in which prefixes are taken, so that leaving some out costs time but never a link.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for _, _, data, offsets in chunks(batch.column(0)):
                h, first = shingles(data, offsets, size)
                d1, _ = _digests(h, first)
                _, once = np.unique(d1, return_index=True)
                keep = np.zeros(len(d1), dtype=bool)
                keep[once] = True
                parts.append(h[np.repeat(keep, np.diff(first))])
            h = np.sort(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)
            edge = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
            count = np.diff(np.append(edge, len(h)))
            often = count >= LOCAL_FREQUENT
            yield pa.RecordBatch.from_arrays([pa.array(h[edge][often].view(np.int64)), pa.array(count[often], pa.int64())], names=["token", "n"])

    counted = documents.select(F.col(text_col).alias("text")).mapInArrow(scan, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))
    top = counted.orderBy(F.desc("n"), "token").limit(MAX_FREQUENT).toArrow()
    return top.column("token").to_numpy()[::-1].copy().view(np.uint64)


def _matrix(documents: DataFrame, id_col: str, text_col: str, size: int, percent: int, frequent: np.ndarray) -> DataFrame:
    """(token, id, grp, n, rest) for each shingle of each row's prefix, with the number of shingles from it on, and one row
    with rest MEMBER for each document; equal sets of one batch enter once."""
    order = np.argsort(frequent)
    held = documents.sparkSession.sparkContext.broadcast((frequent[order], order.astype(np.uint64)))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, rank = held.value
        for batch in batches:
            ids = batch.column(0).fill_null(0).to_numpy()
            valid = batch.column(0).is_valid().to_numpy(zero_copy_only=False)
            parts, least = [], {}
            for row, stop, data, offsets in chunks(batch.column(1)):
                h, first = shingles(data, offsets, size)
                digests = list(zip(*(d.tolist() for d in _digests(h, first)), strict=True))
                parts.append((row, stop, h, first, digests))
                for k, key in enumerate(digests, row):
                    if valid[k]:  # the smallest id of equal sets, so that the smallest of all batches is among them
                        least[key] = min(least.get(key, (ids[k], k)), (ids[k], k))
            for row, stop, h, first, digests in parts:
                n = np.diff(first)
                group = h[np.minimum(first[:-1], max(len(h) - 1, 0))] if len(h) else np.zeros(len(n), np.uint64)
                at = ids_of(h, table, -1)
                h = np.where(at >= 0, _TOP | rank[at] if len(rank) else h, h)
                doc = np.repeat(np.arange(len(n)), n)
                sort_rows(h, first)
                once = np.array([valid[k] and least[key][1] == k for k, key in enumerate(digests, row)], dtype=bool)
                take = np.where(once & (n > 0), n - _least(n, percent) + 1, 0)
                place = np.arange(len(h)) - first[doc]
                inside = place < take[doc]
                own = doc[inside]
                members = np.flatnonzero(take > 0)
                own, token = np.concatenate([own, members]), np.concatenate([h[inside], group[members]])
                rest = np.concatenate([n[own[: len(own) - len(members)]] - place[inside], np.full(len(members), MEMBER)])
                yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(ids[row:stop][own]), pa.array(group[own].view(np.int64)), pa.array(n[own].astype(np.int32)), pa.array(rest.astype(np.int32))], names=["token", "id", "grp", "n", "rest"])

    return documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(scan, "token long, id long, grp long, n int, rest int")


def _buckets(work, names: list[str], types: list):
    """work over the rows of each stretch of whole tokens, of batches sorted by their first column, the token."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            if len(cols[0]) and (parts := list(work(cols))):
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x), t) for x, t in zip(zip(*parts, strict=True), types, strict=True)], names=names)

        carry = None
        for batch in batches:
            cols = [batch.column(k).to_numpy() for k in range(batch.num_columns)]
            if not len(cols[0]):
                continue
            if carry is not None:
                cols = [np.concatenate([c, x]) for c, x in zip(carry, cols, strict=True)]
            last = int(np.searchsorted(cols[0], cols[0][-1]))
            yield from out([c[:last] for c in cols])
            carry = [c[last:] for c in cols]
        if carry is not None:
            yield from out(carry)

    return scan


def _edges_of(token: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1], [True]]))


def _contested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the matrix, sorted by token: each document once as a member (role 0), and the rows of shingles that several
    documents have (1). Holds one row."""

    def told(role: int, cols: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(cols[0]), role, np.int32)), *(pa.array(c) for c in cols)], names=["role", "token", "grp", "id", "n", "rest"])

    last: int | None = None  # the latest token
    held: list[np.ndarray] | None = None  # its row, if it is the only one so far
    for batch in batches:
        cols = [batch.column(k).to_numpy() for k in range(5)]
        member = cols[4] == MEMBER
        if member.any():
            yield told(0, [c[member] for c in cols])
        rows = [c[~member] for c in cols]
        token = rows[0]
        if not len(token):
            continue
        same = np.concatenate([[last is not None and token[0] == last], token[1:] == token[:-1]])
        if held is not None and same[0]:
            yield told(1, held)
        several = same | np.append(same[1:], False)
        if several.any():
            yield told(1, [c[several] for c in rows])
        last, held = token[-1], None if several[-1] else [c[-1:] for c in rows]


def _asking(percent: int, one_each: bool):
    """Of contested rows (token, grp, part, comp, id, n, rest): who asks which group (id, grp, part).

    A linked pair is found at the first shingle of the order that both have; from there on, either set must still hold as
    many shingles as the link needs.
    """

    def work(cols: list[np.ndarray]) -> Iterator[tuple]:
        token, group, part, comp, ids, n, rest = cols
        edge = _edges_of(token)
        for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            g, p, c, k, size, left = group[a:b], part[a:b], comp[a:b], ids[a:b], n[a:b].astype(np.int64), rest[a:b].astype(np.int64)
            fresh = np.concatenate([[True], (g[1:] != g[:-1]) | (p[1:] != p[:-1])])
            start = np.flatnonzero(fresh)
            if len(start) < 2:
                continue
            mine = np.cumsum(fresh) - 1
            low, high = np.minimum.reduceat(size, start), np.maximum.reduceat(size, start)
            most = np.maximum.reduceat(left, start)
            single = np.minimum.reduceat(c, start) == np.maximum.reduceat(c, start)
            of = c[start]
            others = np.arange(len(start))
            for s in range(0, len(k), 1024):
                rows = slice(s, s + 1024)
                fits = (mine[rows, None] < others) & (percent * size[rows, None] <= 100 * high) & (percent * low <= 100 * size[rows, None]) & ~(single & (c[rows, None] == of))
                fits &= (100 + percent) * np.minimum(left[rows, None], most) >= percent * (size[rows, None] + low)
                q, t = np.nonzero(fits)
                if one_each and len(q):
                    _, first = np.unique(np.stack([c[rows][q], t]), axis=1, return_index=True)
                    q, t = q[first], t[first]
                if len(q):
                    yield k[rows][q], g[start][t], p[start][t]

    return _buckets(work, ["id", "grp", "part"], [pa.int64(), pa.int64(), pa.int32()])


def _bounded(percent: int):
    """Over rows (grp, part, slice, role, id, comp, n, sketch) sorted by the first five: (grp, part, slice, role, id, comp) of
    the queries that the sketches leave, and of the members of their groups."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, members, out = None, [], []
        sent, matrix, least = False, None, None

        def batch_of(rows: list) -> pa.RecordBatch:
            types = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["grp", "part", "slice", "role", "id", "comp"])

        for batch in batches:
            for grp, part, portion, role, k, comp, n, cells in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (grp, part, portion) != key:
                    key, members, sent, matrix = (grp, part, portion), [], False, None
                x = np.frombuffer(cells, dtype=np.uint8)
                if role == 0:
                    members.append((n, x, k, comp))
                    continue
                if not members:
                    continue
                if matrix is None:
                    width = min(len(m[1]) for m in members)
                    matrix = np.stack([np.where((w := m[1].reshape(width, -1)).max(1) == 255, 255, np.minimum(w.sum(1, dtype=np.int64), 255)) for m in members])
                    least = np.array([m[0] for m in members])
                if (most_common(x, matrix) >= _least(np.maximum(least, n), percent)).any():
                    if not sent:
                        out += [(*key, 0, m[2], m[3]) for m in members]
                        sent = True
                    out.append((*key, 1, k, comp))
            if len(out) > 20_000:
                yield batch_of(out)
                out = []
        if out:
            yield batch_of(out)

    return scan


class _Find:
    def __init__(self):
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        p = self.parent.setdefault(x, x)
        while p != self.parent[p]:
            self.parent[p] = p = self.parent[self.parent[p]]
        return p


Member = tuple[int, int, np.ndarray]


def compare(members: list[Member], queries: Iterator[Member], percent: int, within: bool) -> Iterator[tuple[int, int]]:
    """Over (id, component, set): `within`, each member that links connect with a smaller one, with the smallest; and links
    from queries to members, enough to connect what is connected."""
    find = _Find()

    def linked(x: np.ndarray, y: np.ndarray) -> bool:
        small_set, large = (x, y) if len(x) <= len(y) else (y, x)
        if 100 * len(small_set) < percent * len(large):
            return False
        common = int((ids_of(small_set, large, -1) >= 0).sum())
        return 100 * common >= percent * (len(x) + len(y) - common)

    def join(asks: Member, others: list[Member]) -> Iterator[tuple[int, int]]:
        for other in others:
            if find.root(asks[1]) != find.root(other[1]) and linked(asks[2], other[2]):
                find.parent[find.root(asks[1])] = find.root(other[1])
                yield asks[0], other[0]

    if within:
        for i, x in enumerate(members):
            for _ in join(x, members[:i]):
                pass
        least: dict[int, int] = {}
        for k, comp, _ in members:
            least[find.root(comp)] = min(k, least.get(find.root(comp), k))
        yield from ((k, least[find.root(comp)]) for k, comp, _ in members if k != least[find.root(comp)])
    union = np.unique(np.concatenate([x for _, _, x in members])) if members else np.zeros(0, np.uint64)
    for x in queries:
        if int((ids_of(x[2], union, -1) >= 0).sum()) >= int(_least(len(x[2]), percent)):
            yield from join(x, members)


def _verify(size: int, percent: int, within: bool):
    """Over rows (grp, part, slice, role, id, comp, text) sorted by the first five: links (a, b)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int, int], int, Member]]:
        for batch in batches:
            groups, parts, slices, roles, ids, comps = (batch.column(k).to_pylist() for k in range(6))
            for row, _, data, offsets in chunks(batch.column(6)):
                h, first = shingles(data, offsets, size)
                for k in range(len(offsets) - 1):
                    yield (groups[row + k], parts[row + k], slices[row + k]), roles[row + k], (ids[row + k], comps[row + k], h[first[k] : first[k + 1]].copy())

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream = rows(batches)
        item, found = next(stream, None), []

        def queries(key: tuple[int, int, int]) -> Iterator[Member]:
            nonlocal item
            while item is not None and item[0] == key:
                yield item[2]
                item = next(stream, None)

        while item is not None:
            key, members = item[0], []
            while item is not None and item[0] == key and item[1] == 0:
                members.append(item[2])
                item = next(stream, None)
            rest = queries(key)
            found += compare(members, rest, percent, within)
            for _ in rest:
                pass
            if len(found) > 50_000 or item is None:
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], names=["a", "b"])
                found = []

    return scan


def _meet(rows: DataFrame, docs: DataFrame, size: int, percent: int, within: bool) -> DataFrame:
    """Links between the texts of rows (grp, part, slice, role, id, comp)."""
    texts = texts_in(docs, bitmap(rows))
    by = ["grp", "part", "slice"]
    placed = rows.join(texts, "id").select(*by, "role", "id", "comp", "text").repartition(*by).sortWithinPartitions(*by, "role", "id")
    out = placed.mapInArrow(_verify(size, percent, within), "a long, b long")
    return cut(out.distinct() if within else out)  # an id may come twice


def _joined(comps: DataFrame, more: DataFrame) -> DataFrame:
    """comps (id, component) after links (a, b) between documents: only the links between components take rounds."""
    of = comps.withColumnRenamed("component", "c")
    ends = more.join(of.withColumnRenamed("id", "a"), "a", "left").select("b", F.coalesce("c", "a").alias("u")).join(of.withColumnRenamed("id", "b"), "b", "left").select("u", F.coalesce("c", "b").alias("v"))
    moved = cut(components(ends, "u", "v"))
    told = comps.join(moved.select(F.col("node").alias("component"), F.col("component").alias("to")), "component", "left").select("id", F.coalesce("to", "component").alias("component"))
    fresh = moved.select(F.col("node").alias("id"), "component").join(comps.select("id"), "id", "left_anti")
    return cut(told.unionByName(fresh))


def connected(documents: DataFrame, each: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80, group_rows: int = GROUP_ROWS) -> DataFrame:
    """(id, component) of the documents that links connect, each set standing for itself once, as its smallest id. each:
    the documents' sets()."""
    docs = documents.filter(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    frequent = frequent_shingles(docs, "text", size)
    matrix = _matrix(docs, "id", "text", size, percent, frequent).select("token", "grp", "id", "n", "rest")
    rows = matrix.repartition("token").sortWithinPartitions("token", "grp", "id").mapInArrow(_contested, "role int, token long, grp long, id long, n int, rest int")
    firsts = each.filter("n > 0 and id is not null").groupBy("d1", "d2", "n").agg(F.min("id").alias("id")).select("id")
    rows = cut(rows.join(firsts, "id", "left_semi"))
    members, contested = rows.filter("role = 0").select("grp", "id"), rows.filter("role = 1").select("token", "grp", "id", "n", "rest")
    sizes = cut(members.groupBy("grp").agg(F.count("*").alias("rows")).filter("rows > 1"))
    large = small(sizes.filter(F.col("rows") > group_rows).select("grp", F.ceil(F.col("rows") / group_rows).cast("int").alias("parts")), 100_000)
    part = F.coalesce(F.pmod(F.xxhash64("id"), F.col("parts")), F.lit(0)).cast("int").alias("part")
    members = members.join(large, "grp", "left").select("grp", "id", part)
    contested = contested.join(large, "grp", "left").select("token", "grp", "id", "n", "rest", part)
    sized = each.select("id", F.col("n").cast("int").alias("n"), "sketch").filter("n > 0 and id is not null").dropDuplicates(["id"])

    inside = members.join(sizes.select("grp"), "grp", "left_semi").select("grp", "part", F.lit(0).alias("slice"), F.lit(0).alias("role"), "id", F.col("id").alias("comp"))
    found = _meet(inside, docs, size, percent, True)
    done, comps = None, found.select(F.col("a").alias("id"), F.col("b").alias("component"))  # a document has one group, and so one component there
    for one_each in (True, False):
        known = lambda df: df.join(comps, "id", "left").withColumn("comp", F.coalesce("component", "id")).drop("component")  # noqa: B023, E731
        rows = known(contested).select("token", "grp", "part", "comp", "id", "n", "rest")
        own = Window.partitionBy("token")  # in the exchange that gathers the tokens; the window's rows spill
        rows = rows.repartition("token").withColumns({"low": F.min("comp").over(own), "high": F.max("comp").over(own)}).filter("low <> high").drop("low", "high")
        rows = rows.sortWithinPartitions("token", "grp", "part", "comp", "id")
        asks = rows.mapInArrow(_asking(percent, one_each), "id long, grp long, part int").distinct()
        asks = cut(asks if done is None else asks.join(done, ["id", "grp", "part"], "left_anti"))
        done = asks
        if not asks.limit(1).count():
            break
        load = asks.groupBy("grp", "part").agg(F.ceil(F.count("*") / SLICE).cast("int").alias("slices"))
        asked = members.join(load, ["grp", "part"]).select("grp", "part", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), F.lit(0).alias("role"), "id")
        many = small(cut(load.filter("slices > 1")), 100_000)
        slice_of = F.coalesce(F.pmod(F.xxhash64("id"), F.col("slices")), F.lit(0)).cast("int").alias("slice")
        both = asked.unionByName(asks.join(many, ["grp", "part"], "left").select("grp", "part", slice_of, F.lit(1).alias("role"), "id"))
        by = ["grp", "part", "slice"]
        both = known(both).join(sized, "id").select(*by, "role", "id", "comp", "n", "sketch").repartition(*by).sortWithinPartitions(*by, "role", "id")
        left = cut(both.mapInArrow(_bounded(percent), "grp long, part int, slice int, role int, id long, comp long"))
        if left.limit(1).count():
            more = _meet(left, docs, size, percent, False)
            if more.limit(1).count():
                comps = _joined(comps, more)
    return comps


def join_components(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", size: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of documents: id, n_shingles, component_id (smallest id reachable by links, its own included)."""
    each = cut(sets(documents, id_col, text_col, size))
    solid = F.col("id").isNotNull() & (F.col("n") > 0)
    key = ["d1", "d2", "n"]
    same = cut(each.filter(solid).groupBy(*key).agg(F.min("id").alias("rep"), F.count("*").alias("rows")).filter("rows > 1").drop("rows"))
    comps = connected(documents, each, id_col=id_col, text_col=text_col, size=size, percent=percent)
    known = each.select("id", *key).join(same, key, "left").withColumn("rep", F.coalesce(F.when(solid, F.col("rep")), F.col("id")))
    out = known.select("id", "n", "rep").join(comps.withColumnRenamed("id", "rep"), "rep", "left")
    return out.select(F.col("id").cast(documents.schema[id_col].dataType).alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component", "rep").alias("component_id"))


def op9_jaccard_join(spark, sf_dir: str) -> DataFrame:
    small_batches(spark)
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return join_components(documents, size=4, percent=85)
