"""A training corpus from ``documents``, in stages that each write what the next one reads.

Quality, near copies, repeated passages, benchmark passages, packing: each stage calls one
operator of ``quillion.llm`` on all that its predecessor kept, and its decisions take
effect. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillion.llm import decontaminate, packing, quality, simhash, suffix_dedup
from quillion.llm.common import bounded_batches, materialize
from quillion.llm.tokens import public_path


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier scores at 0.3 or more. Null and empty texts are scored
    as one empty line, very long ones whole; rows that share an id or a text are scored each;
    other columns are kept as they are; an empty table gives an empty one."""
    bounded_batches(spark)
    model = quality.fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return docs.where(quality.quality_score(F.col("text"), model) >= 0.3)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group of copies: texts linked by pairs
    that share 0.8 or more of their five-word shingles. Rows that share an id stay or go
    together."""
    gone = simhash.near_copies(docs, words=5, similarity=0.8, bits=3)
    return docs.join(gone.select(F.col("id").alias("__gone")), F.col("doc_id") == F.col("__gone"), "left_anti")


def without_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the bytes of 100-byte strings that also start earlier in the corpus;
    documents of which nothing but white space is left go."""
    found = suffix_dedup.without_repeats(docs, 100)
    found = found.where((F.col("n_removed") == 0) | F.col("text").rlike(r"\S"))
    return found.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of whose words fewer than a twentieth lie in 13-word windows of the benchmark. A
    text without words (null too) stays; rows that share an id are judged each; other columns are
    kept as they are; an empty table gives an empty one."""
    found = decontaminate.contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    hit = decontaminate.span_words(F.col("spans"))
    return found.where((hit == 0) | (20 * hit < F.col("n_words"))).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens with their places in training sequences. A null or empty text
    is one piece of the end id; only texts longer than a sequence are cut; rows that share an id
    are packed each; other columns play no part; an empty table gives an empty one."""
    found = packing.pack_documents(docs, public_path("word_bpe_49k.json"), 0, 2048)
    return found.withColumnRenamed("id", "doc_id")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", good_quality),
    ("SimHash near-dedup", without_near_copies),
    ("suffix-array dedup", without_repeats),
    ("benchmark decontamination", without_benchmark),
    ("best-fit packing", packed),
]

#: Four of the stages are beyond SQL; the tests hold the pipeline against a brute-force one.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written to the shared folder. Nulls, empty and
    very long texts, repeated rows and other columns are treated as each stage says; an empty
    table gives an empty one."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{k}")
    return docs
