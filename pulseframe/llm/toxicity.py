"""Toxicity by class-conditional Kneser-Ney models of the letters of words.

For each class (toxic, ordinary) the bytes of words are modelled with the seven bytes before them in the word (a boundary
stands before and behind each word). With h the bytes before, h' the same without the first, and a the next byte:

    p_c(a | h) = max(c_c(ha) - D_c, 0) / c_c(h.) + D_c N_c(h.) / c_c(h.) p(a | h')       of the class's counts
    p(a | h)   = max(N(.ha) - D, 0) / N(.h.) + D N(h.) / N(.h.) p(a | h')                shared by both classes

N(.ha) is the number of different bytes (or boundaries) seen before ha, in both classes together, N(h.) that of different
bytes behind h; p ends in 1/256 for each byte. A class that never saw h takes p(a | h'). The discounts come from counts
of counts, n1 / (n1 + 2 n2), for each class and each length. So an expression that a class has rarely or never seen falls
back on continuation counts that both share, and new forms of a word are judged by what they begin with.

A word's difference d is its log-likelihood under the toxic model less that under the ordinary one. Toxic texts are mostly
ordinary words: with a share s of their words toxic, a text's length-normalised log-likelihood exceeds the ordinary one by
the mean of log(1 - s + s exp(d)) over its words. That mean is the text's only feature. With s = 1 it is the plain
comparison of the two models, in which the many ordinary words' differences drown the few toxic words' (README has the
figures); s is one of SHARES, chosen like the curve that makes the mean a score: by the loss on calibration rows.

Calibration rows are a fifth of the labelled rows by a hash of their id, `max_calibration` of them at most; all other
labelled rows are counted. The score 0.5 stands where the F1 of the calibration rows is greatest. Counts are distributed
tables of all that the counted rows hold, without bound. Up to `max_held` grams they are sent to all tasks; beyond that
the corpus's different words are joined to them, and the texts' words to the words' differences.

Defined cases: a null or empty text has no words and a mean of 0; rows with a null label do not train; several labels of
one document count as toxic if one is; without rows of both classes every score is the share of toxic labels (0 without
labels), and without calibration rows of both the curve is the plain logistic one. Repeated rows are scored one by one;
extra columns are carried, whatever their names; an empty table gives none.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .spark import bitmap, cut, shared_dir, small_batches, texts_in, unused
from .textscan import ALNUM, LOWER, Words, chunks, ids_of, word_hashes

ORDER = 8
BOUNDARY = 0x20
SHARES = (1.0, 0.1, 0.03, 0.01, 0.003, 0.001)
MAX_HELD = 2_500_000
MAX_CALIBRATION = 8_000
MOST_FREQUENT = 1 << 17
CLASSES = ("c0", "c1")
_FLOOR = 1e-3


def _tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, Words, np.ndarray]:
    data = LOWER[data]
    words = Words(data, offsets, ALNUM)
    return data, words, word_hashes(data, words)


def grams(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word, gram) for each byte of the given words and for their closing boundary: it and up to seven bytes before, the
    boundary before the word included, as one number with the byte itself lowest."""
    size = end - start + 1
    first = np.cumsum(size) - size
    word = np.repeat(np.arange(len(start)), size)
    place = np.arange(len(word)) - first[word]
    byte = np.append(data, np.uint8(0))[start[word] + place].astype(np.uint64)
    byte[first + size - 1] = BOUNDARY
    gram = byte.copy()
    for k in range(1, ORDER):
        before = np.zeros_like(byte)
        before[k:] = byte[:-k]
        gram |= np.where(place >= k, before, np.where(place == k - 1, np.uint64(BOUNDARY), np.uint64(0))) << np.uint64(8 * k)
    return word, gram


def _merged(parts: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
    g, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    both = np.concatenate([p[1] for p in parts])
    return g, np.stack([np.bincount(at, both[:, c], len(g)) for c in (0, 1)], axis=1)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over (text, toxic): (gram, count in each class). Holds some hundred thousand grams of its partition at most."""

    def told(g: np.ndarray, both: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), *(pa.array(both[:, c].astype(np.int64)) for c in (0, 1))], names=["g", *CLASSES])

    parts, rows = [], 0
    for batch in batches:
        toxic = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
        for row, stop, data, offsets in chunks(batch.column(0)):
            data, words, hashes = _tokens(data, offsets)
            _, one, at = np.unique(hashes, return_index=True, return_inverse=True)
            both = np.bincount(at * 2 + toxic[row:stop][words.row()], minlength=2 * len(one)).reshape(-1, 2)
            word, g = grams(data, words.start[one], words.end[one])
            parts.append(_merged([(g, both[word])]))
            rows += len(parts[-1][0])
            if rows > 1_000_000:
                parts = [_merged(parts)]
                rows = len(parts[0][0])
                if rows > 500_000:
                    yield told(*parts[0])
                    parts, rows = [], 0
    if parts:
        yield told(*_merged(parts))


def counts(rows: DataFrame) -> DataFrame:
    """(g, c0, c1) of all grams of (text, toxic): a distributed table, whatever its size."""
    return rows.select("text", "toxic").mapInArrow(_count, "g long, c0 long, c1 long").groupBy("g").agg(*(F.sum(c).alias(c) for c in CLASSES))


def _stored(df: DataFrame) -> DataFrame:
    """df computed once, in the shared folder; columns of numbers take a fraction of a checkpoint there."""
    path = f"{shared_dir(df.sparkSession)}/toxicity-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _before(g: Column) -> Column:
    """The gram without its last byte."""
    return F.shiftrightunsigned(g, 8)


def _shorter(g: Column) -> Column:
    """The gram without its first byte."""
    out = F.lit(0).cast("long")
    for k in range(1, ORDER):
        out = F.when(F.shiftrightunsigned(g, 8 * k) != 0, g.bitwiseAND(F.lit((1 << 8 * k) - 1))).otherwise(out)
    return out


def _length(g: Column) -> Column:
    out = F.lit(1)
    for k in range(1, ORDER):
        out = F.when(F.shiftrightunsigned(g, 8 * k) != 0, k + 1).otherwise(out)
    return out


def discount(ones: int, twos: int) -> float:
    """From how many were counted once and twice; 0.5 if that tells nothing."""
    return ones / (ones + 2 * twos) if ones and twos else 0.5


def shared(counted: DataFrame) -> DataFrame:
    """(g, p): the shared probability of the last byte of each gram of one to seven bytes that a counted one falls back on."""
    g, levels, after = F.col("g"), {}, None
    for k in range(ORDER - 1, 0, -1):
        longer = counted.select("g").filter(_length(g) == k + 1)
        longer = longer if after is None else longer.unionByName(after.select("g"))
        after = levels[k] = cut(longer.groupBy(_shorter(g).alias("g")).agg(F.count("*").alias("n")))
    tallies = [levels[k].agg(F.lit(k).alias("k"), F.count(F.when(F.col("n") == 1, 1)).alias("ones"), F.count(F.when(F.col("n") == 2, 1)).alias("twos")) for k in levels]
    every = tallies[0]
    for t in tallies[1:]:
        every = every.unionByName(t)
    free = {r.k: discount(r.ones, r.twos) for r in every.collect()}  # seven rows
    out, below = None, None
    for k in range(1, ORDER):
        own = Window.partitionBy(_before(g))
        level = levels[k].select("g", "n", F.sum("n").over(own).alias("total"), F.count("*").over(own).alias("kinds"))
        if below is None:
            level = level.withColumn("low", F.lit(1 / 256))
        else:
            level = level.join(below.select(F.col("g").alias("s"), F.col("p").alias("low")), _shorter(g) == F.col("s"))
        d = F.lit(free[k])
        below = cut(level.select("g", ((F.greatest(F.col("n") - d, F.lit(0.0)) + d * F.col("kinds") * F.col("low")) / F.col("total")).alias("p")))
        out = below if out is None else out.unionByName(below)
    return out


def differences(counted: DataFrame) -> DataFrame:
    """(g, value, back): the log-ratio of the toxic and the ordinary probability of each counted gram's last byte, and what
    it is for a byte that never followed the same bytes before."""
    n = counted.agg(*(F.count(F.when(F.col(c) == k, 1)).alias(f"{c}_{k}") for c in CLASSES for k in (1, 2))).first()
    g, own = F.col("g"), Window.partitionBy(_before(F.col("g")))
    t = counted.select("g", *CLASSES, *(F.sum(c).over(own).alias(f"total_{c}") for c in CLASSES), *(F.count(F.when(F.col(c) > 0, 1)).over(own).alias(f"kinds_{c}") for c in CLASSES))
    t = t.join(shared(counted).select(F.col("g").alias("s"), "p"), _shorter(g) == F.col("s"))
    p, back = {}, {}
    for c in CLASSES:
        d, total = discount(n[f"{c}_1"], n[f"{c}_2"]), F.col(f"total_{c}")
        back[c] = F.when(total > 0, d * F.col(f"kinds_{c}") / total).otherwise(1.0)
        p[c] = F.when(total > 0, F.greatest(F.col(c) - d, F.lit(0.0)) / total).otherwise(0.0) + back[c] * F.col("p")
    return t.select("g", F.log(p["c1"] / p["c0"]).cast("float").alias("value"), F.log(back["c1"] / back["c0"]).cast("float").alias("back"))


class Held:
    """The differences of all counted grams, sorted, for one task."""

    def __init__(self, g: np.ndarray, value: np.ndarray, back: np.ndarray):
        order = np.argsort(g)
        self.grams, self.value = g[order], value[order]
        self.histories, one = np.unique(self.grams >> np.uint64(8), return_index=True)
        self.back = back[order][one]

    def words(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Each word's difference."""
        if not len(start):
            return np.zeros(0)
        word, g = grams(data, start, end)
        g, at = np.unique(g, return_inverse=True)
        known, history = ids_of(g, self.grams, -1), ids_of(g >> np.uint64(8), self.histories, -1)
        value = np.where(known >= 0, self.value[known], np.where(history >= 0, self.back[history], 0.0)) if len(self.grams) else np.zeros(len(g))
        return np.bincount(word, value[at], len(start))


def excess(d: np.ndarray, share: float) -> np.ndarray:
    """What words of difference d add to a text's log-likelihood if so large a share of its words is toxic."""
    return d if share == 1 else np.log1p(share * np.expm1(np.minimum(d, 60.0)))


class Memory:
    """Words' differences by their hash, of the words met so far in a task; begins anew when there are many."""

    def __init__(self, held: Held, most: int = 1 << 20):
        self.held, self.most = held, most
        self.keys, self.values = np.zeros(0, np.uint64), np.zeros(0)

    def of(self, data: np.ndarray, words: Words, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Differences of the chunk's different words, and which of these each word is."""
        keys, one, at = np.unique(hashes, return_index=True, return_inverse=True)
        known = ids_of(keys, self.keys, -1)
        d = self.values[known] if len(self.keys) else np.zeros(len(keys))
        new = known < 0
        if new.any():
            d[new] = self.held.words(data, words.start[one[new]], words.end[one[new]])
            if len(self.keys) > self.most:
                self.keys, self.values = keys, d
            else:
                both, values = np.concatenate([self.keys, keys[new]]), np.concatenate([self.values, d[new]])
                order = np.argsort(both)
                self.keys, self.values = both[order], values[order]
        return d, at


def _row_sums(words: Words, x: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0.0], np.cumsum(x)])
    return sums[words.first[1:]] - sums[words.first[:-1]]


class Model:
    """Differences of grams (held, or as a table), the share of toxic words, and the curve."""

    def __init__(self, held: Held | None, table: DataFrame | None):
        self.held, self.table = held, table
        self.share, self.slope, self.bias = SHARES[0], 1.0, 0.0

    def feature(self, mean, log=F.log):
        """Of a mean at the model's share; a column, or an array with log=numpy.log."""
        return mean if self.share == 1 else log(mean - math.log1p(-self.share) + _FLOOR)


def fit_curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float, float]:
    """Slope and bias of a logistic curve, by damped Newton steps with a weak pull to 0, and its loss."""
    centre, spread = x.mean(), x.std() or 1.0
    z = np.column_stack([(x - centre) / spread, np.ones(len(x))])
    a = np.zeros(2)
    for _ in range(200):
        p = 1 / (1 + np.exp(-np.clip(z @ a, -40, 40)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + 1e-2 * np.eye(2), z.T @ (p - y) + 1e-2 * a)
        a -= step * min(1.0, 2.0 / max(1e-12, float(np.abs(step).max())))
        if np.abs(step).max() < 1e-9:
            break
    p = np.clip(1 / (1 + np.exp(-np.clip(z @ a, -40, 40))), 1e-12, 1 - 1e-12)
    return a[0] / spread, a[1] - a[0] * centre / spread, -float(np.mean(y * np.log(p) + (1 - y) * np.log(1 - p)))


def best_cut(x: np.ndarray, y: np.ndarray) -> float:
    """The value between two of x from which on counting as toxic has the greatest F1."""
    order = np.argsort(-x, kind="stable")
    x, right = x[order], np.cumsum(y[order])
    f1 = 2 * right / (np.arange(1, len(x) + 1) + y.sum())
    f1[:-1][x[:-1] == x[1:]] = -1  # equal values go together
    k = int(f1.argmax())
    return float((x[k] + x[min(k + 1, len(x) - 1)]) / 2)


def fit(rows: DataFrame, *, text_col: str = "text", label_col: str = "toxic", split_col: str = "doc_id", max_held: int = MAX_HELD, max_calibration: int = MAX_CALIBRATION) -> Model | float:
    """A model from labelled rows, or the share of toxic labels if a class is missing."""
    rows = rows.select(F.col(text_col).alias("text"), (F.col(label_col) > 0).cast("int").alias("toxic"), F.xxhash64(F.col(split_col).cast("string"), F.lit(7)).alias("draw")).filter("toxic is not null")
    fifth = F.pmod("draw", F.lit(5)) == 0
    last = rows.filter(fifth).select("draw").distinct().orderBy("draw").limit(max_calibration).agg(F.max("draw")).first()[0]  # of draws alone
    aside = fifth & (F.col("draw") <= F.lit(last)) if last is not None else F.lit(False)
    classes = rows.filter(~aside).agg(F.count(F.when(F.col("toxic") == 0, 1)).alias("c0"), F.count(F.when(F.col("toxic") == 1, 1)).alias("c1")).first()
    if not classes.c0 or not classes.c1:
        return classes.c1 / max(1, classes.c0 + classes.c1)
    model = _held(_stored(differences(_stored(counts(rows.filter(~aside))))), max_held)
    told = means(rows.filter(aside), model, SHARES, "text", "m").groupBy("draw").agg(F.max("toxic").alias("toxic"), *(F.first(f"m_{k}").alias(f"m_{k}") for k in range(len(SHARES)))).toArrow()
    y, best = told.column("toxic").to_numpy().astype(float), None
    if len(set(y)) < 2:
        return model
    for k, share in enumerate(SHARES):
        model.share = share
        x = model.feature(told.column(f"m_{k}").to_numpy(), np.log)
        slope, bias, loss = fit_curve(x, y)
        if best is None or loss < best[0]:
            best = loss, share, slope, -slope * best_cut(x, y) if slope > 0 else bias
    model.loss, model.share, model.slope, model.bias = best
    return model


def _held(table: DataFrame, max_held: int) -> Model:
    if table.count() > max_held:
        return Model(None, table)
    t = table.toArrow()
    return Model(Held(*(t.column(k).to_numpy() if k else t.column(0).to_numpy().view(np.uint64) for k in range(3))), None)


def means(rows: DataFrame, model: Model, shares: Sequence[float], text_col: str, name: str) -> DataFrame:
    """rows without the text, with name_0, ...: the mean excess of its words at each share."""
    return _by_held(rows, model.held, shares, text_col, name) if model.table is None else _by_table(rows, model.table, shares, text_col, name)


def _by_held(rows: DataFrame, held: Held, shares: Sequence[float], text_col: str, name: str) -> DataFrame:
    sent, at = rows.sparkSession.sparkContext.broadcast(held), rows.columns.index(text_col)
    rest = [k for k in range(len(rows.columns)) if k != at]
    names = [f"{name}_{k}" for k in range(len(shares))]
    schema = rows.drop(text_col).schema
    for x in names:
        schema = schema.add(x, "double")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = Memory(sent.value)
        for batch in batches:
            parts = [np.zeros((len(shares), 0))]
            for _, _, data, offsets in chunks(batch.column(at)):
                data, words, hashes = _tokens(data, offsets)
                d, which = memory.of(data, words, hashes)
                parts.append(np.stack([_row_sums(words, excess(d, s)[which]) for s in shares]) / np.maximum(words.count, 1))
            values = np.concatenate(parts, axis=1)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in rest), *(pa.array(x) for x in values)], names=[*schema.names])

    return rows.mapInArrow(scan, schema)


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over (text): each chunk's different words (hash, word, occurrences)."""
    for batch in batches:
        for _, _, data, offsets in chunks(batch.column(0)):
            data, words, hashes = _tokens(data, offsets)
            keys, one, n = np.unique(hashes, return_index=True, return_counts=True)
            said = [data[a:b].tobytes() for a, b in zip(words.start[one].tolist(), words.end[one].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(said, pa.binary()), pa.array(n)], names=["w", "word", "n"])


def _spelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over (w, word): (w, gram)."""
    for batch in batches:
        w, at = batch.column(0).to_numpy(), 0
        for row, stop, data, offsets in chunks(batch.column(1)):
            word, g = grams(data, offsets[:-1], offsets[1:])
            for at in range(0, len(g), 1 << 20):
                yield pa.RecordBatch.from_arrays([pa.array(w[row:stop][word[at : at + (1 << 20)]]), pa.array(g[at : at + (1 << 20)].view(np.int64))], names=["w", "g"])


def _by_table(rows: DataFrame, table: DataFrame, shares: Sequence[float], text_col: str, name: str) -> DataFrame:
    """The same means when the grams are more than a task holds. The corpus's different words get their differences by a
    join of their grams. The most frequent words' are sent to all tasks and added up in one scan; the others are joined to
    the words of each text, which go by the text's digest. Equal texts have equal means of these, however many they are."""
    words = rows.select(text_col).mapInArrow(_met, "w long, word binary, n long").groupBy("w").agg(F.first("word").alias("word"), F.sum("n").alias("n"))
    words = _stored(words)
    spelled = words.select("w", "word").mapInArrow(_spelled, "w long, g long").withColumn("h", _before(F.col("g")))
    backs = table.groupBy(_before(F.col("g")).alias("h")).agg(F.first("back").alias("back"))
    found = spelled.join(table.select("g", "value"), "g", "left").join(backs, "h", "left")
    d = found.groupBy("w").agg(F.sum(F.coalesce(F.col("value"), F.col("back"), F.lit(0.0)).cast("double")).alias("d"))
    d = _stored(words.select("w", "n").join(d, "w"))
    top = d.orderBy(F.desc("n"), "w").limit(MOST_FREQUENT).toArrow()
    order = np.argsort(top.column("w").to_numpy().view(np.uint64))
    sent = rows.sparkSession.sparkContext.broadcast((top.column("w").to_numpy().view(np.uint64)[order], np.append(top.column("d").to_numpy()[order], 0.0)))
    digest, own, far, count = unused(rows, "digest", "own", "far", "count")
    at, rest = rows.columns.index(text_col), [k for k, c in enumerate(rows.columns) if c != text_col]
    sums = unused(rows, *(f"sum{k}" for k in range(len(shares))))
    schema = rows.drop(text_col).schema.add(digest, "string")
    for x in (*sums, far, count):
        schema = schema.add(x, "double")

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [np.zeros((len(shares) + 2, 0))]
            for _, _, data, offsets in chunks(batch.column(at)):
                _, words, hashes = _tokens(data, offsets)
                k = ids_of(hashes, sent.value[0], -1)
                some = k >= 0
                d = sent.value[1][k]  # 0 behind the last one
                parts.append(np.stack([*(_row_sums(words, np.where(some, excess(d, s), 0.0)) for s in shares), _row_sums(words, ~some), words.count.astype(float)]))
            values = np.concatenate(parts, axis=1)
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in rest), batch.column(batch.num_columns - 1), *(pa.array(x) for x in values)], names=schema.names)

    def apart(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, _, data, offsets in chunks(batch.column(1)):
                _, words, hashes = _tokens(data, offsets)
                some = ids_of(hashes, sent.value[0], -1) < 0
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row + words.row()[some])), pa.array(hashes[some].view(np.int64))], names=["a", "w"])

    keyed = rows.withColumn(digest, F.md5(F.coalesce(F.col(text_col), F.lit(""))))
    other = keyed.select(F.col(digest).alias("a"), text_col).mapInArrow(apart, "a string, w long").groupBy("a", "w").agg(F.count("*").alias("n")).join(d.select("w", "d"), "w")
    value = lambda s: F.col("d") if s == 1 else F.log1p(F.lit(s) * F.expm1(F.least(F.col("d"), F.lit(60.0))))
    tails = unused(rows, *(f"tail{k}" for k in range(len(shares))))
    other = other.groupBy(F.col("a").alias(own)).agg(*((F.sum(F.col("n") * value(s)) / F.sum("n")).alias(t) for s, t in zip(shares, tails, strict=True)))
    both = keyed.select(*rows.columns, digest).mapInArrow(near, schema).join(other, F.col(digest) == F.col(own), "left")
    mean = lambda x, t: (F.col(x) + F.coalesce(F.col(t) * F.col(far), F.lit(0.0))) / F.greatest(F.col(count), F.lit(1.0))
    return both.select(*(c for c in rows.columns if c != text_col), *(mean(x, t).alias(f"{name}_{k}") for k, (x, t) in enumerate(zip(sums, tails, strict=True))))


def score(rows: DataFrame, model: Model | float, text_col: str = "text", name: str = "score") -> DataFrame:
    """rows without the text, with the score of each text."""
    if isinstance(model, float):
        return rows.drop(text_col).withColumn(name, F.lit(model))
    rest = [c for c in rows.columns if c != text_col]
    mean = unused(rows, "mean")[0]
    z = F.lit(float(model.slope)) * model.feature(F.col(f"{mean}_0")) + F.lit(float(model.bias))
    z = F.greatest(F.lit(-60.0), F.least(F.lit(60.0), z))
    return means(rows, model, (model.share,), text_col, mean).select(*rest, (1 / (1 + F.exp(-z))).alias(name))


def kept(rows: DataFrame, model: Model | float, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """rows, with all their columns, that score below the threshold."""
    text, value = unused(rows, "scanned", "score")
    return score(rows.withColumn(text, F.col(text_col)), model, text, value).filter(F.col(value) < threshold).select(*rows.columns)


def crc_fold(column: str = "doc_id", folds: int = 5) -> Column:
    return F.crc32(F.col(column).cast("string").cast("binary")) % folds


def labelled(documents: DataFrame, labels: DataFrame, max_rows: int = 500_000) -> DataFrame:
    """doc_id, text, toxic of the labelled documents outside the held-out fold. Up to `max_rows` labels (12 bytes each) are
    sent to all tasks; beyond that, the texts that may have one meet them in a shuffle."""
    marks = labels.filter("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).filter(crc_fold() != 0)
    docs = documents.select("doc_id", "text")
    if marks.limit(max_rows + 1).count() <= max_rows:
        return docs.join(F.broadcast(marks), "doc_id")
    near = texts_in(docs.select(F.col("doc_id").cast("long").alias("id"), "text"), bitmap(marks.select(F.col("doc_id").cast("long").alias("id"))))
    return near.withColumnRenamed("id", "doc_id").join(marks, "doc_id")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = fit(labelled(documents, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    fold = crc_fold()
    return score(documents, model).select("doc_id", (F.coalesce(fold, F.lit(-1)) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
