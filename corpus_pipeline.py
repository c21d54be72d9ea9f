"""A training corpus from raw documents: five stages, each by one operator of pulseframe.llm.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes it as Parquet in the shared folder and reads
it again as the next stage's docs. All but the last return the columns of documents, whatever these are besides doc_id and
text. Cases that all stages share: repeated rows are judged alike, an empty table gives an empty one, texts are read whole.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pulseframe.llm import decontaminate, jaccard, line_dedup, mixing, toxicity
from pulseframe.llm.spark import cut, lacking, shared_dir, small_batches

#: SQL can express neither the classifiers nor the fitted rates; the stages are tested against brute force instead.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity models reject go.

    Null and empty texts have the score of a text without words; rows with a null id are scored like any other. Without
    labels of both classes, all stay unless every label is toxic."""
    small_batches(spark)
    model = toxicity.fit(toxicity.labelled(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return toxicity.kept(docs, model)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that repeat an earlier one go (copies of any length, near copies from five words), and documents of which nothing
    but blank lines is left after that.

    Documents that lose no line stay as they are, with null, empty and blank texts; so do rows with a null id. Repeated rows
    keep the lines that no other id has."""
    small_batches(spark)
    return line_dedup.remove(docs, min_words=1, near_words=5)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that near-duplication connects (five-word shingles, Jaccard 0.8), that with the smallest id stays.

    Null and empty texts, and rows with a null id, are in no group and stay; repeated rows stay or go together."""
    small_batches(spark)
    found = jaccard.join_components(docs, size=5, percent=80)
    others = cut(found.filter("component_id <> doc_id").select(F.col("doc_id").cast("long").alias("id")).distinct())
    return lacking(docs, others, "doc_id")


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go. Null and empty texts stay; so does all without a benchmark."""
    small_batches(spark)
    return decontaminate.remove(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sampling rate for each document that is left, so that expected domain totals match the targets.

    One row for each id (a null one too); null and empty texts have no tokens and the prior as posteriors."""
    return mixing.mix(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("ngram_jaccard", keep_one_of_each_group),
    ("decontaminate", drop_contaminated),
    ("mixing", mix_to_targets),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder, before = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}", None
    for k, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if before:  # the next stage's table is written: nothing reads this one again
            place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(before)
            place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
        before = path
    return docs
