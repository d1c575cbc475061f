"""Conversation memory."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillion.functions.text import token_estimate


def _said():
    return F.concat(F.coalesce("q", F.lit("")), F.coalesce("a", F.lit("")))


def recent_turns(turns: DataFrame, limit: int = 1200) -> DataFrame:
    """The newest turns of each conversation whose token estimates fit ``limit`` (0: all)."""
    newest = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    rows = turns.withColumn("used", F.sum(token_estimate(_said())).over(newest))
    return rows if not limit else rows.where(F.col("used") <= limit)


def pair_turns(messages: DataFrame) -> DataFrame:
    """User messages with the assistant's message right after them."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = messages.withColumns({"a": F.lead("text").over(w), "__next": F.lead("role").over(w)})
    return rows.where("role = 'user' and __next = 'assistant'").select("conv_id", "turn", F.col("text").alias("q"), "a")


def append_turns(turns: DataFrame, path: str) -> DataFrame:
    turns.write.mode("append").parquet(path)
    return turns.sparkSession.read.parquet(path)


def clear_turns(spark: SparkSession, path: str) -> DataFrame:
    """Forget all turns of a store, which stays readable."""
    none = spark.read.parquet(path).limit(0)
    spark.createDataFrame([], none.schema).write.mode("overwrite").parquet(path)
    return spark.read.schema(none.schema).parquet(path)


def prune_turns(turns: DataFrame, max_bytes: int) -> DataFrame:
    """The newest turns of a conversation until their bytes, a line end each, reach the limit;
    the one that crosses it is kept."""
    newest = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    size = F.octet_length(_said()) + 1
    return turns.withColumn("before", F.sum(size).over(newest) - size).where(F.col("before") < max_bytes).drop("before")


def recall(turns: DataFrame) -> DataFrame:
    """Questions after the previous question or answer, with what they ask for."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    q = F.lower(F.trim("q"))
    question = q.rlike(r"what\s+(?:was|is)\s+(?:my|the)\s+(?:last|previous)\s+question")
    answer = q.rlike(r"(what\s+(?:was|is)\s+(?:your|the)\s+(?:last|previous)\s+answer|repeat\s+your\s+(?:last|previous)\s+answer)")
    rows = turns.withColumns({"prev_q": F.lag("q").over(w), "prev_a": F.lag("a").over(w)})
    return rows.withColumn("recalled", F.when(question, F.col("prev_q")).when(answer, F.col("prev_a")))


def memory_chunks(turns: DataFrame, n: int = 3) -> DataFrame:
    """The last n turns of each conversation as evidence rows, the oldest of them page 1."""
    newest = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    rows = turns.withColumn("k", F.row_number().over(newest)).where(F.col("k") <= n)
    page = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn"))
    q, a = F.nullif(F.trim("q"), F.lit("")), F.nullif(F.trim("a"), F.lit(""))
    text = F.concat_ws("\n", F.concat(F.lit("Prev question: "), q), F.concat(F.lit("Prev answer: "), a))
    return rows.select("conv_id", page.alias("page_start"), text.alias("text"), F.lit("memory").alias("section_tag"), F.lit(0.55).alias("score")).where("text <> ''")
