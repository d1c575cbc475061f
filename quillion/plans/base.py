"""How queries are put together: inputs they share and the registry."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillion.operators import chunking, vectors
from quillion.plans.fixtures import POOL, view, with_views
from quillion.sources.store import keep

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, views: str = "", sql: str = ""):
    """Register a query; ``sql`` follows a WITH clause of the named views."""

    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = f"{with_views(*views.split())}\n{sql}" if views else sql
        return f

    return add


def rx(pattern: str) -> str:
    """A pattern as a SQL literal."""
    return "'" + pattern.replace("'", "''") + "'"


def lines(spark: SparkSession, d: str) -> DataFrame:
    return chunking.lines_of(view(spark, d, "v_headed"))


def question_vectors(spark: SparkSession, d: str) -> DataFrame:
    e = view(spark, d, "embeddings").select(F.col("vec_id").alias("question_id"), "embedding")
    return view(spark, d, "v_questions").join(e, "question_id")


def chunk_vectors(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "embeddings").select(F.col("vec_id").alias("rid"), "embedding")


def top(spark: SparkSession, d: str, k: int = POOL) -> DataFrame:
    """Vector hits of every question, ``pos`` from 1."""
    w = Window.partitionBy("question_id").orderBy(F.desc("score"), "rid")
    return vectors.vector_topk(question_vectors(spark, d), chunk_vectors(spark, d), k).withColumn("pos", F.row_number().over(w))


def hits(spark: SparkSession, d: str, k: int = POOL) -> DataFrame:
    rows = vectors.hits_to_chunks(top(spark, d, k), view(spark, d, "v_chunks"))
    return keep(rows.join(view(spark, d, "v_questions"), "question_id"), "hits")
