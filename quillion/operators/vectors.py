"""Text vectors and exact vector search."""

from __future__ import annotations

import math
from collections.abc import Callable
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.ml.feature import IDF, ElementwiseProduct, HashingTF, Normalizer
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillion.functions.text import ascii_tokens
from quillion.sources import commits
from quillion.sources.store import ensure_ns, keep


class Vectorizer(NamedTuple):
    """A fitted model of texts: weights of hashed words, from the texts counted up to a version."""

    dim: int
    version: int
    weights: list[float]


def _hashed(df: DataFrame, dim: int, binary: bool = False) -> DataFrame:
    words = df.withColumn("__words", ascii_tokens("text"))
    return HashingTF(inputCol="__words", outputCol="__tf", numFeatures=dim, binary=binary).transform(words)


def add_texts(df: DataFrame, path: str, ns: str, dim: int = 256, name: str | None = None) -> int:
    """Count the texts of ``df`` for the model at ``path`` and ``ns``: for each bucket of hashed
    words the texts that have one. Counts of texts that were added before stay, so a model is
    fitted in steps; adding the ``name`` of an earlier step again does nothing. A model of
    another width starts anew. Returns the version."""
    spark = df.sparkSession
    ensure_ns(spark, path, ns, dim, "hashed")
    found = _hashed(df.select("text"), dim, binary=True).select(F.posexplode(vector_to_array("__tf")).alias("bucket", "there")).where("there > 0")
    counts = found.groupBy("bucket").agg(F.count("*").alias("n")).unionByName(df.agg(F.lit(-1).alias("bucket"), F.count("*").alias("n")))
    commits.append(counts.withColumn("place", F.lit(0).cast("long")), path, ns, n=0, name=name)
    return commits.state(spark, path, ns)["version"]


def vectorizer(spark: SparkSession, path: str, ns: str, version: int | None = None) -> Vectorizer:
    """The model of all texts added, or of those added up to a version. A row for each bucket
    reaches the driver."""
    now = commits.state(spark, path, ns)
    version = now["version"] if version is None else version
    rows = commits.read(spark, path, ns, upto=version).groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    n = {r["bucket"]: r["n"] for r in rows}
    weights = [math.log((n.get(-1, 0) + 1) / (n.get(k, 0) + 1)) for k in range(now["dim"])]
    return Vectorizer(now["dim"], version, weights)


def embed(df: DataFrame, model: Vectorizer | Callable | None = None, dim: int = 256) -> DataFrame:
    """Add ``embedding``: hashed TF-IDF of unit length by a fitted :class:`Vectorizer`, or what a
    plugged-in column function ``model`` makes of the text column. Without a model one is fitted
    on the table itself, whose vectors can be compared with each other only."""
    if model is not None and not isinstance(model, Vectorizer):
        return df.withColumn("embedding", model(F.col("text")))
    if model is None:
        counted = _hashed(df, dim)
        weighed = IDF(inputCol="__tf", outputCol="__idf").fit(counted).transform(counted)
    else:
        weights = Vectors.dense(model.weights)
        weighed = ElementwiseProduct(scalingVec=weights, inputCol="__tf", outputCol="__idf").transform(_hashed(df, model.dim))
    out = Normalizer(inputCol="__idf", outputCol="__unit").transform(weighed)
    return out.withColumn("embedding", vector_to_array("__unit")).drop("__words", "__tf", "__idf", "__unit")


def dot(a: Column | str, b: Column | str) -> Column:
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def l2_normalize(c: Column | str) -> Column:
    """A vector over its length, to which 1e-9 is added."""
    c = F.col(c) if isinstance(c, str) else c
    length = F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))) + 1e-9
    return F.transform(c, lambda x: x.cast("double") / length)


QUERY_BLOCK = 2_000_000  # numbers of query vectors that go to every task at a time


def vector_topk(queries: DataFrame, corpus: DataFrame, k: int) -> DataFrame:
    """``question_id, rid, score``: the k largest inner products for each query, ties by rid.

    Queries go to the tasks in blocks of bounded size, one block after another: what a block
    found is written and its vectors are dropped before the next is sent. A task multiplies
    stretches of the corpus with the block and keeps its own k best of each query, so that only
    those are shuffled. It takes rows by length, the longest of a batch first: no product is
    larger than that of the lengths, so a query whose k-th score is above that for what is left
    of the batch needs none of it."""
    q = queries.select("question_id", F.col("embedding").cast("array<double>").alias("v")).where("v is not null")
    width = q.agg(F.max(F.size("v")), F.count("*")).first()
    n = max(1, -(-int(width[1]) * int(width[0] or 1) // QUERY_BLOCK))
    sc, found, kind = queries.sparkSession.sparkContext, None, q.schema["question_id"].dataType.simpleString()
    w = Window.partitionBy("question_id").orderBy(F.desc("score"), "rid")
    for block in range(n):
        rows = q.where(F.pmod(F.xxhash64("question_id"), F.lit(n)) == block).collect()
        if rows:
            sent = sc.broadcast(([r[0] for r in rows], np.array([r[1] for r in rows])))
            best = _topk_block(sent, corpus, k, kind).withColumn("n", F.row_number().over(w)).where(F.col("n") <= k).drop("n")
            if n > 1:
                best = keep(best, "hits")
                sent.destroy()
            found = best if found is None else found.unionByName(best)
    if found is None:
        return q.select("question_id", F.lit(0).cast("long").alias("rid"), F.lit(0.0).alias("score")).limit(0)
    return found


STRETCH = 2048  # rows of the corpus that are multiplied at a time


def _topk_block(block, corpus: DataFrame, k: int, kind: str) -> DataFrame:
    def best(batches):
        names, q = block.value
        held: pd.DataFrame | None = None
        lengths, cut = np.linalg.norm(q, axis=1), np.full(len(q), -np.inf)
        for batch in batches:
            x = np.stack(batch["v"].to_numpy()) if len(batch) else np.zeros((0, q.shape[1]))
            norms, rids = np.linalg.norm(x, axis=1), batch["rid"].to_numpy()
            order = np.argsort(-norms, kind="stable")
            for at in range(0, len(x), STRETCH):
                own = order[at : at + STRETCH]
                # Scores are rounded to six places; what is even near the cut is worked out.
                asks = np.flatnonzero(~(lengths * norms[own[0]] * (1 + 1e-9) + 1e-6 < cut))
                if not len(asks):
                    break
                score = np.round(q[asks] @ x[own].T, 6)
                part = min(k, score.shape[1])
                edge = np.partition(score, -part, axis=1)[:, -part]
                i, j = np.nonzero(score >= np.maximum(edge, cut[asks])[:, None])
                new = pd.DataFrame({"query": asks[i], "rid": rids[own][j], "score": score[i, j]})
                held = new if held is None else pd.concat([held, new])
                held = held.sort_values(["query", "score", "rid"], ascending=[True, False, True]).groupby("query").head(k)
                last = held.groupby("query")["score"].agg(["size", "min"])
                full = last[last["size"] >= k]
                cut[full.index.to_numpy()] = full["min"].to_numpy()
        if held is not None:
            yield pd.DataFrame({"question_id": np.array(names)[held["query"].to_numpy()], "rid": held["rid"], "score": held["score"]})

    rows = corpus.select(F.col("rid").cast("long").alias("rid"), F.col("embedding").cast("array<double>").alias("v")).where("v is not null")
    return rows.mapInPandas(best, f"question_id {kind}, rid long, score double")


def hits_to_chunks(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunk rows of hits; hits without a chunk are dropped."""
    return hits.join(chunks, "rid")


def max_normalize(df: DataFrame, key: str, col: str) -> DataFrame:
    """Scores clamped at 0 and, where a key has one above 0, divided by its largest."""
    top = F.max(F.greatest(F.lit(0.0), F.col(col))).over(Window.partitionBy(key))
    score = F.greatest(F.lit(0.0), F.col(col))
    return df.withColumn(col, F.when(top > 0, score / top).otherwise(score))


def fetch_vectors(hits: DataFrame, vectors: DataFrame) -> DataFrame:
    return hits.join(vectors.select("rid", "embedding"), "rid")
