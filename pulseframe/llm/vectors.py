"""Near-duplicate embeddings: randomised-rotation binary codes estimate inner products, bounds decide what is recomputed.

1. Equal vectors are one class (its smallest id, its number of rows).
2. Each class's unit vector is rotated at random; the signs are its code o, and the correction factor <o, x> is stored
   with it. For another unit vector y, <o, y> / <o, x> estimates <x, y> without bias; it errs by at most
   e0 sqrt((1 - <o, x>^2) / (<o, x>^2 (d - 1))) with high confidence, and by the angle between o and x with certainty.
3. Candidates meet by bands of sign bits from further rotations. With `miss` the chance that a pair at the threshold
   meets in no band, the number of bands follows from the bits, and these from the number of vectors (buckets of about
   `bucket` vectors). A pair is compared in the first band in which it meets.
4. First only sign bits travel: of all bits, a pair at the threshold differs in so many on average, with a binomial
   deviation, and pairs that differ in `confidence` deviations more are let go. Only the vectors that are left, in the
   buckets where they are, follow.
5. Of those, pairs whose upper bound by code and correction factor (the smaller of the two of step 2) reaches the threshold
   are recomputed in double precision, from the vectors themselves. A bucket reports each vector's number of links and a
   spanning forest of them, never all pairs.

Buckets beyond `block` vectors are dealt into blocks, and each pair of blocks is compared in a task of its own.

Nothing is capped: every pair that meets is decided. What bands and sign bits may miss is measured in the tests against all
pairs.

Defined cases: vectors that are null, empty, all zero or hold a null or non-finite component link with nothing; vectors
of different lengths never link; rows with a null id link with nothing and get a null component; repeated rows are
vectors of their own (equal ones are linked); extra columns are not read; an empty table gives none.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spark import components, cut, small
from .textscan import buffers

THRESHOLD = 0.95
MISS = 1e-3
BUCKET = 128
BLOCK = 2048
TILE = 512
CONFIDENCE = 5.0


@functools.lru_cache(maxsize=64)
def rotation(dimension: int, number: int) -> np.ndarray:
    """A random orthogonal matrix, the same everywhere."""
    q, r = np.linalg.qr(np.random.default_rng([number, dimension]).standard_normal((dimension, dimension)))
    return q * np.sign(np.diag(r))


def plan(count: int, threshold: float = THRESHOLD, miss: float = MISS, bucket: int = BUCKET) -> tuple[int, int]:
    """Bits of a band and number of bands for so many vectors."""
    bits = min(30, max(4, math.ceil(math.log2(max(1, count) / bucket)) if count > bucket else 4))
    meet = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(miss) / math.log1p(-meet)))


def moderate(x: np.ndarray) -> np.ndarray:
    """The rows times powers of two, so that squares neither overflow nor vanish; exact, but for entries that are nothing
    beside the row's largest."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1))[1][:, None])


def sign_bits(unit: np.ndarray, count: int) -> np.ndarray:
    """So many signs of each row, from as many rotations as that takes."""
    d = unit.shape[1]
    return np.concatenate([unit @ rotation(d, 1 + k).T > 0 for k in range(-(-count // d))], axis=1)[:, :count]


def band_keys(signs: np.ndarray, bits: int, bands: int) -> np.ndarray:
    """A key for each row and band."""
    return (signs.reshape(len(signs), bands, bits).astype(np.int64) << np.arange(bits)).sum(axis=2)


def most_different(count: int, threshold: float, confidence: float = CONFIDENCE) -> float:
    """In how many of so many sign bits two vectors at the threshold may differ."""
    share = math.acos(min(1.0, max(-1.0, threshold))) / math.pi
    return count * share + confidence * math.sqrt(count * share * (1 - share))


def coded(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rotated vectors, their signs, and the correction factors."""
    turned = unit @ rotation(unit.shape[1], 0).T
    signs = np.where(turned > 0, 1.0, -1.0)
    return turned, signs, (signs * turned).sum(axis=1) / math.sqrt(unit.shape[1])


def upper_bounds(signs: np.ndarray, factor: np.ndarray, turned: np.ndarray, confidence: float = CONFIDENCE) -> np.ndarray:
    """For each coded row and each rotated vector, what their inner product does not exceed."""
    d = turned.shape[1]
    product = signs @ turned.T / math.sqrt(d)
    factor = np.clip(factor, 1e-9, 1.0)[:, None]
    likely = product / factor + confidence * np.sqrt((1 - factor**2) / (factor**2 * max(1, d - 1)))
    certain = np.cos(np.maximum(np.arccos(np.clip(product, -1, 1)) - np.arccos(factor), 0))
    return np.minimum(likely, certain)


def linked_pairs(x: np.ndarray, y: np.ndarray | None, factor: np.ndarray, code: np.ndarray, threshold: float, among: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) with cosine >= threshold between x's rows and y's (or, without y, of x's rows i < j), among those given."""
    norm = np.linalg.norm(x, axis=1)
    other, other_norm = (x, norm) if y is None else (y, np.linalg.norm(y, axis=1))
    turned = (other / other_norm[:, None]) @ rotation(x.shape[1], 0).T
    near = upper_bounds(code, factor, turned) >= threshold - 1e-6
    if y is None:
        near = np.triu(near, 1)
    if among is not None:
        near &= among
    i, j = np.nonzero(near)
    exact = np.empty(len(i))
    for s in range(0, len(i), 65536):
        a, b = i[s : s + 65536], j[s : s + 65536]
        exact[s : s + 65536] = (x[a] * other[b]).sum(axis=1) / (norm[a] * other_norm[b])
    return i[exact >= threshold], j[exact >= threshold]


def _encode(bits: int, bands: int, kind: type):
    """Over (rep, copies, embedding): (rep, copies, d, vector, code, factor, bits)."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = np.diff(batch.column(2).offsets.to_numpy())
            values = batch.column(2).flatten().to_numpy(zero_copy_only=False)
            bounds = np.concatenate([[0], np.cumsum(lengths)])
            for d in np.unique(lengths).tolist():
                rows = np.flatnonzero(lengths == d)
                x = values[bounds[rows][:, None] + np.arange(d)].astype(np.float64)
                scaled = moderate(x)
                unit = scaled / np.linalg.norm(scaled, axis=1)[:, None]
                _, signs, factor = coded(unit)
                packed = np.packbits(sign_bits(unit, bits * bands), axis=1)
                cols = [batch.column(0).take(pa.array(rows)), batch.column(1).take(pa.array(rows)), pa.array(np.full(len(rows), d, np.int32))]
                cols += [_binary(x.astype(kind)), _binary(np.packbits(signs > 0, axis=1)), pa.array(factor), _binary(packed)]
                yield pa.RecordBatch.from_arrays(cols, names=["rep", "copies", "d", "vector", "code", "factor", "bits"])

    return scan


def _binary(rows: np.ndarray) -> pa.Array:
    """A binary value for each row of a matrix."""
    raw, width = np.ascontiguousarray(rows).view(np.uint8), rows.shape[1] * rows.itemsize
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(np.arange(len(rows) + 1, dtype=np.int32) * width), pa.py_buffer(raw)])


def _matrix(column: pa.Array, kind: type = np.uint8) -> np.ndarray:
    """The rows of a binary column of values of one length."""
    data, offsets = buffers(column)
    return data[offsets[0] : offsets[-1]].view(kind).reshape(len(column), -1) if len(column) else np.zeros((0, 1), kind)


def _place(bits: int, bands: int):
    """Over (d, rep, bits): (bucket, rep, bits) for each band."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = band_keys(np.unpackbits(_matrix(batch.column(2)), axis=1)[:, : bits * bands], bits, bands)
            d = batch.column(0).to_numpy().astype(np.int64)
            for band in range(bands):
                yield pa.RecordBatch.from_arrays([pa.array(d << 46 | band << 32 | keys[:, band]), batch.column(1), batch.column(2)], names=["bucket", "rep", "bits"])

    return scan


def _groups(work, names: list[str], types: list, together: int = 20_000):
    """work(table) over each stretch of rows of one (bucket, ij), of batches sorted by these, their first two columns."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(table: pa.Table) -> Iterator[pa.RecordBatch]:
            table = table.combine_chunks()
            at = table.column(0).to_numpy(), table.column(1).to_numpy()
            edge = np.flatnonzero(np.concatenate([[True], (at[0][1:] != at[0][:-1]) | (at[1][1:] != at[1][:-1]), [True]]))
            out = [x for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True) if b - a > 1 for x in work(table.slice(a, b - a))]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

        held, rows = [], 0
        for batch in batches:
            held.append(batch)
            rows += batch.num_rows
            if rows < together:
                continue
            table = pa.Table.from_batches(held)
            at = table.column(0).to_numpy(), table.column(1).to_numpy()
            last = int(np.flatnonzero((at[0] == at[0][-1]) & (at[1] == at[1][-1]))[0])  # the last block may go on
            if last:
                yield from told(table.slice(0, last))
            held, rows = table.slice(last).to_batches(), table.num_rows - last
        if rows:
            yield from told(pa.Table.from_batches(held))

    return scan


def _sides(table: pa.Table) -> tuple[np.ndarray, np.ndarray, bool]:
    """The rows of a block pair's two blocks (twice the same for a block and itself)."""
    ij, part = int(table.column(1)[0].as_py()), table.column(2).to_numpy()
    i, j = ij >> 31, ij & ((1 << 31) - 1)
    return np.flatnonzero(part == i), np.flatnonzero(part == j), i == j


def _fresh(keys: np.ndarray, band: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which pairs meet in no band before this one."""
    out = np.ones(len(a), dtype=bool)
    for k in range(band):
        out &= keys[a, k] != keys[b, k]
    return out


def _band(table: pa.Table) -> int:
    return int(table.column(0)[0].as_py()) >> 32 & ((1 << 14) - 1)


def _sift(bits: int, bands: int, limit: float):
    """Over block rows (bucket, ij, part, rep, bits): those that some pair is left of which first meets here."""

    def work(table: pa.Table) -> Iterator[tuple]:
        left, right, same = _sides(table)
        signs = np.unpackbits(_matrix(table.column(4).combine_chunks()), axis=1)[:, : bits * bands]
        keys, ones = band_keys(signs, bits, bands), signs.astype(np.float32) * 2 - 1
        some = np.zeros(len(signs), dtype=bool)
        for s in range(0, len(left), TILE):
            rows = left[s : s + TILE]
            near = (bits * bands - ones[rows] @ ones[right].T) / 2 <= limit
            if same:
                near &= np.arange(len(right)) > np.arange(s, s + len(rows))[:, None]
            a, b = np.nonzero(near)
            a, b = rows[a], right[b]
            fresh = _fresh(keys, _band(table), a, b)
            some[a[fresh]] = some[b[fresh]] = True
        if some.any():
            yield tuple(table.column(k).to_numpy()[some] for k in range(4))

    return _groups(work, ["bucket", "ij", "part", "rep"], [pa.int64(), pa.int64(), pa.int32(), pa.int64()])


def _forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Each of n nodes' smallest node reachable over the pairs."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        now = label.copy()
        np.minimum.at(now, label[i], low)
        np.minimum.at(now, label[j], low)
        now = np.minimum(now, now[now])
        if (now == label).all():
            return label
        label = now


def _compare(bits: int, bands: int, threshold: float, limit: float, kind: type):
    """Over block rows (bucket, ij, part, rep, copies, d, vector, code, factor, bits): (kind 0, vector, links) and (kind 1,
    vector, vector)."""

    def work(table: pa.Table) -> Iterator[tuple]:
        left, right, same = _sides(table)
        ids, copies, d = table.column(3).to_numpy(), table.column(4).to_numpy(), int(table.column(5)[0].as_py())
        x = moderate(_matrix(table.column(6).combine_chunks(), kind).astype(np.float64))
        code = np.unpackbits(_matrix(table.column(7).combine_chunks()), axis=1)[:, :d] * 2.0 - 1.0
        factor = table.column(8).to_numpy()
        signs = np.unpackbits(_matrix(table.column(9).combine_chunks()), axis=1)[:, : bits * bands]
        keys, ones = band_keys(signs, bits, bands), signs.astype(np.float32) * 2 - 1
        links, label = np.zeros(len(ids), dtype=np.int64), np.arange(len(ids))
        for s in range(0, len(left), TILE):
            rows = left[s : s + TILE]
            near = (bits * bands - ones[rows] @ ones[right].T) / 2 <= limit
            if same:
                near &= np.arange(len(right)) > np.arange(s, s + len(rows))[:, None]
            a, b = linked_pairs(x[rows], x[right], factor[rows], code[rows], threshold, near)
            a, b = rows[a], right[b]
            fresh = _fresh(keys, _band(table), a, b)
            a, b = a[fresh], b[fresh]
            links += np.bincount(a, copies[b], len(ids)).astype(np.int64) + np.bincount(b, copies[a], len(ids)).astype(np.int64)
            label = _forest(len(ids), np.concatenate([a, np.arange(len(ids))]), np.concatenate([b, label]))
        some = links > 0
        yield np.zeros(int(some.sum()), np.int32), ids[some], links[some]
        joined = np.flatnonzero(label != np.arange(len(ids)))
        yield np.ones(len(joined), np.int32), ids[joined], ids[label[joined]]

    return _groups(work, ["kind", "a", "b"], [pa.int32(), pa.int64(), pa.int64()])


def near_duplicates(vectors: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD, miss: float = MISS, block: int = BLOCK) -> DataFrame:
    """One row per row of vectors: id, n_links, component_id, kept. Single-precision columns stay so while they travel."""
    single = vectors.schema[vector_col].dataType.elementType.simpleString() == "float"
    kind = np.float32 if single else np.float64
    v = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast(f"array<{'float' if single else 'double'}>").alias("e"))
    solid = F.coalesce((F.size("e") > 0) & F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("e", lambda x: x != 0), F.lit(False))
    good = v.filter(F.col("id").isNotNull() & solid)
    classes = cut(good.groupBy("e").agg(F.min("id").alias("rep"), F.count("*").alias("copies")))
    bits, bands = plan(classes.count(), threshold, miss)
    limit = most_different(bits * bands, threshold)
    codes = cut(classes.select("rep", "copies", "e").mapInArrow(_encode(bits, bands, kind), "rep long, copies long, d int, vector binary, code binary, factor double, bits binary"))
    placed = codes.select("d", "rep", "bits").mapInArrow(_place(bits, bands), "bucket long, rep long, bits binary")
    crowded = placed.groupBy("bucket").agg(F.count("*").alias("n")).filter(F.col("n") > block).select("bucket", F.ceil(F.col("n") / block).cast("int").alias("parts"))
    own = F.pmod(F.xxhash64("rep"), F.col("parts"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda p: F.shiftleft(F.least(p.cast("long"), own), 31) + F.greatest(p.cast("long"), own))
    dealt = placed.join(small(cut(crowded), 200_000), "bucket", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    dealt = dealt.select("bucket", F.explode(pairs).alias("ij"), own.cast("int").alias("part"), "rep", "bits")
    by = ["bucket", "ij"]
    near = cut(dealt.repartition(*by).sortWithinPartitions(*by, "part").mapInArrow(_sift(bits, bands, limit), "bucket long, ij long, part int, rep long"))
    rows = near.join(codes, "rep").select(*by, "part", "rep", "copies", "d", "vector", "code", "factor", "bits")
    found = cut(rows.repartition(*by).sortWithinPartitions(*by, "part").mapInArrow(_compare(bits, bands, threshold, limit, kind), "kind int, a long, b long"))
    links = found.filter("kind = 0").groupBy(F.col("a").alias("rep")).agg(F.sum("b").alias("links"))
    joined = components(found.filter("kind = 1").select("a", "b")).withColumnRenamed("node", "rep")
    copied = classes.filter("copies > 1").select("e", F.col("rep").alias("of"), "copies")
    known = good.join(copied, "e", "left").select("id", F.coalesce("of", "id").alias("rep"), F.coalesce("copies", F.lit(1)).alias("copies"))
    out = known.join(links, "rep", "left").join(joined, "rep", "left").select("id", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    alone = v.filter(F.col("id").isNull() | ~solid).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    return out.unionByName(alone).select(F.col("id").alias(id_col), "n_links", "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(False)).alias("kept"))


def op4_embedding_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
