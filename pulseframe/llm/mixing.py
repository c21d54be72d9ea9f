"""Mixing documents to target weights by soft domain membership. DataFrame functions only.

1. A naive Bayes classifier learns the domains' words from a labelled table: from at most `max_labelled` of the labelled
   documents (taken by the order of their ids' hash; a bound on the classifier's sample alone, and only ids are ordered).
   Every word of theirs counts, in one of BUCKETS buckets by its hash, so that the table of smoothed log-probabilities has a
   bounded size whatever the vocabulary, and is broadcast. Words in no bucket that the sample filled tell nothing.
2. Every document gets posteriors of the domains. The evidence of its words is averaged and counts as `evidence` words,
   so that long texts keep soft memberships.
3. Rates r >= 0 of the documents are fitted by accelerated projected gradients: with t tokens and posteriors p, the
   domain totals sum(r t p) shall match the targets, in least squares weighted by the domains' sizes, starting from
   rate 1. A round sums one number per domain over all documents; only these reach the driver. The step is the inverse of
   the largest eigenvalue of the (domains x domains) Gram matrix. It ends when the totals match to `tolerance` of all
   tokens, when the loss stands still (targets out of reach), or after `rounds`.

Tokens are runs without white space and ASCII punctuation. Words are exploded and summed again within the task that read
the document, so that one row per document is shuffled.

Defined cases: a null or empty text has no tokens and the prior as posteriors; rows with one id (or a null id) count as
one document (for the classifier, one of their texts); without labels all domains are alike; an empty table gives none;
extra columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spark import cut

MAX_LABELLED = 20_000
BUCKETS = 1 << 17
EVIDENCE = 20.0
ROUNDS = 200
TOLERANCE = 1e-6
#: Domains by label: quality 0, quality 1, toxic; the shares that each shall have, and of all tokens how many are kept.
DOMAINS = ("low", "high", "toxic")
TARGETS = (0.20, 0.78, 0.02)
BUDGET = 0.5


def words(text: str) -> Column:
    return F.split(F.lower(F.col(text)), r"[\s\p{Punct}]+")


def domain_of(toxic: str = "toxic", quality: str = "quality") -> Column:
    """The number of a label's domain; null if it tells none."""
    return F.when(F.col(toxic) > 0, 2).when(F.col(quality) > 0, 1).when(F.col(quality) == 0, 0)


def bucket(word: str = "word") -> Column:
    """The bucket of a word; null for none."""
    return F.when(F.col(word) != "", F.pmod(F.xxhash64(word), F.lit(BUCKETS)).cast("int"))


def learn(documents: DataFrame, marks: DataFrame, domains: int, *, max_labelled: int = MAX_LABELLED, smoothing: float = 0.5) -> tuple[DataFrame, list[float]]:
    """(bucket, w0, w1, ...) with log-probabilities, and the log-priors, from documents (id, text) and marks (id, domain)."""
    present = marks.join(documents.select("id").distinct(), "id", "left_semi")
    chosen = present.orderBy(F.xxhash64(F.col("id").cast("string")), "id").limit(max_labelled)  # ids alone: no texts are ordered
    sample = cut(documents.join(F.broadcast(chosen), "id").dropDuplicates(["id"]).select("text", "domain"))
    marks_of = [F.coalesce(F.sum((F.col("domain") == k).cast("long")), F.lit(0)).alias(f"c{k}") for k in range(domains)]
    rows = sample.agg(*marks_of).first()
    counts = sample.select("domain", F.explode(words("text")).alias("word")).select("domain", bucket().alias("bucket")).filter("bucket is not null").groupBy("bucket").agg(*marks_of)
    counts = cut(counts)
    mass = counts.agg(*(F.coalesce(F.sum(f"c{k}"), F.lit(0)) for k in range(domains)), F.count("*")).first()
    logs = [F.log((F.col(f"c{k}") + smoothing) / F.lit(float(mass[k] + smoothing * max(1, mass[domains])))).alias(f"w{k}") for k in range(domains)]
    n = sum(rows) + domains
    return counts.select("bucket", *logs), [math.log((c + 1) / n) for c in rows]


def posteriors(documents: DataFrame, weights: DataFrame, priors: list[float], *, evidence: float = EVIDENCE) -> DataFrame:
    """(id, tokens, p0, p1, ...) of documents (id, text). weights has at most BUCKETS rows."""
    k = len(priors)
    spread = documents.select("id", F.explode_outer(words("text")).alias("word")).select("id", bucket().alias("bucket")).join(F.broadcast(weights), "bucket", "left")
    sums = spread.groupBy("id").agg(F.count("bucket").alias("tokens"), F.count("w0").alias("known"), *(F.coalesce(F.sum(f"w{j}"), F.lit(0.0)).alias(f"s{j}") for j in range(k)))
    z = [F.col(f"s{j}") / F.greatest("known", F.lit(1)) * evidence + F.lit(priors[j]) for j in range(k)]
    scored = sums.select("id", "tokens", *(x.alias(f"z{j}") for j, x in enumerate(z)))
    top = F.greatest(*(F.col(f"z{j}") for j in range(k))) if k > 1 else F.col("z0")
    powers = scored.select("id", "tokens", *(F.exp(F.col(f"z{j}") - top).alias(f"e{j}") for j in range(k)))
    every = sum((F.col(f"e{j}") for j in range(1, k)), F.col("e0"))
    return powers.select("id", "tokens", *((F.col(f"e{j}") / every).alias(f"p{j}") for j in range(k)))


def _largest_eigenvalue(g: list[list[float]]) -> float:
    """Of a small symmetric matrix without negative entries, by power iteration (an upper bound by row sums at the end)."""
    n = len(g)
    v = [1.0] * n
    for _ in range(200):
        w = [sum(g[i][j] * v[j] for j in range(n)) for i in range(n)]
        size = math.sqrt(sum(x * x for x in w)) or 1.0
        v = [x / size for x in w]
    return max(sum(g[i][j] * v[j] for j in range(n)) / max(v[i], 1e-12) if v[i] > 1e-9 else 0.0 for i in range(n)) or 1.0


def rates(members: DataFrame, targets: list[float], *, rounds: int = ROUNDS, tolerance: float = TOLERANCE, cut_every: int = 10) -> DataFrame:
    """members (id, tokens, p0, ...) with rate; targets: tokens wanted of each domain."""
    k, names = len(targets), members.columns
    p, t = [F.col(f"p{j}") for j in range(k)], F.col("tokens")
    first = members.agg(*(F.coalesce(F.sum(t * p[i]), F.lit(0.0)) for i in range(k)), *(F.coalesce(F.sum(t * p[i] * p[j]), F.lit(0.0)) for i in range(k) for j in range(i + 1))).first()
    mass = [max(x, 1e-9) for x in first[:k]]
    whole, gram, at = sum(mass), [[0.0] * k for _ in range(k)], k
    for i in range(k):
        for j in range(i + 1):
            gram[i][j] = gram[j][i] = first[at] / math.sqrt(mass[i] * mass[j])
            at += 1
    step = 1 / _largest_eigenvalue(gram)
    state = members.withColumn("rate", F.lit(1.0)).withColumn("ahead", F.lit(1.0))
    momentum, last, best, still = 1.0, math.inf, math.inf, 0
    for n in range(rounds):
        totals = state.agg(*(F.coalesce(F.sum(t * F.col("ahead") * x), F.lit(0.0)) for x in p)).first()
        miss = [a - b for a, b in zip(totals, targets, strict=True)]
        loss = sum(e * e / m for e, m in zip(miss, mass, strict=True)) / whole
        if max(map(abs, miss)) <= tolerance * whole:
            state = state.withColumn("rate", F.col("ahead"))
            break
        still = still + 1 if loss > best * (1 - 1e-6) else 0
        best = min(best, loss)
        if still >= 15:
            break
        grown = 1.0 if loss > last else (1 + math.sqrt(1 + 4 * momentum * momentum)) / 2
        beta, momentum, last = 0.0 if loss > last else (momentum - 1) / grown, grown, loss
        move = sum((F.lit(step * miss[j] / mass[j]) * p[j] for j in range(1, k)), F.lit(step * miss[0] / mass[0]) * p[0])
        state = state.select(*names, F.col("rate").alias("was"), F.greatest(F.lit(0.0), F.col("ahead") - move).alias("rate"))
        state = state.select(*names, "rate", F.greatest(F.lit(0.0), F.col("rate") + F.lit(beta) * (F.col("rate") - F.col("was"))).alias("ahead"))
        if (n + 1) % cut_every == 0:
            state = cut(state)
    return state.select(*names, "rate")


def mix(documents: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shares: tuple = TARGETS, budget: float = BUDGET) -> DataFrame:
    """One row per document: id, tokens, p_low, p_high, p_toxic, rate. labels: doc_id, quality, toxic."""
    docs = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    marks = labels.withColumn("domain", domain_of()).filter("domain is not null and doc_id is not null").groupBy(F.col("doc_id").alias("id")).agg(F.max("domain").alias("domain"))
    weights, priors = learn(docs, marks, len(shares))
    members = cut(posteriors(docs, weights, priors))
    whole = members.agg(F.coalesce(F.sum("tokens"), F.lit(0))).first()[0]
    out = rates(members, [x * budget * whole for x in shares])
    return out.select(F.col("id").alias(id_col), "tokens", *(F.col(f"p{j}").alias(f"p_{name}") for j, name in enumerate(DOMAINS)), "rate")


def op3_source_mixing(spark, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return mix(documents, spark.read.parquet(f"{sf_dir}/labels.parquet"))
