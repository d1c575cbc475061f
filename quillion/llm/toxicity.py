"""Operator 5: toxicity from averaged subword embeddings and a linear softmax, by the worst window.

A departure from one mean over the whole text: a document is as toxic as its most toxic window
of 8 words, since a few words among thousands would not move the mean of all.

A word is the bag of its 3- to 5-byte n-grams, its ends marked, hashed into one table of
vectors; a window is the mean of the vectors of its words' n-grams; a softmax of two outputs
on that mean says toxic or not. Vectors and softmax are learned together, each by the
gradient of the same loss. A misspelt word shares most of its n-grams with the word it is from.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import flat_bytes, held_out, once, release, slices

BUCKET_BITS, DIM, SIZES, WINDOW = 16, 12, (3, 4, 5), 8
#: Lower-cases A-Z; white space, controls and punctuation between words become blanks.
FOLD = np.array(
    [c + 32 if 65 <= c <= 90 else 32 if c <= 32 or chr(c) in '.,;:!?"()|[]{}' else c for c in range(256)], np.uint8
)


def grams_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words per text, n-grams per word, bucket of each n-gram) in order of words."""
    raw, ends = flat_bytes(column)
    n = len(ends) - 1
    # Every text between blanks, so that no n-gram reaches into the next.
    spaced = np.full(len(raw) + n + 1, 32, np.uint8)
    spaced[np.arange(len(raw)) + np.repeat(np.arange(1, n + 1), np.diff(ends))] = FOLD[raw]
    inside = spaced != 32
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    word = np.cumsum(begins, dtype=np.int64) - 1
    starts = ends[:-1] + np.arange(n) + 1
    at = np.flatnonzero(begins)
    per_text = np.diff(np.append(np.searchsorted(at, starts), len(at)))
    owners, buckets = [], []
    for size in SIZES:
        m = len(spaced) - size + 1
        if m <= 0:
            continue
        whole = np.ones(m, bool)
        hashed = np.full(m, size * 2654435761 & 0xFFFFFFFF, np.uint32)
        for k in range(size):
            hashed = (hashed ^ spaced[k : k + m]) * np.uint32(16777619)
            if 0 < k < size - 1:
                whole &= inside[k : k + m]
        p = np.flatnonzero(whole)
        owners.append(word[p + 1])
        buckets.append((hashed[p] * np.uint32(2654435769)) >> np.uint32(32 - BUCKET_BITS))
    owner = np.concatenate(owners) if owners else np.zeros(0, np.int64)
    bucket = np.concatenate(buckets) if buckets else np.zeros(0, np.uint32)
    # A word right after itself adds nothing to its window.
    count = np.bincount(owner, minlength=len(at))
    mark = np.bincount(owner, bucket.astype(np.float64) ** 2, minlength=len(at))
    fresh = np.ones(len(at), bool)
    fresh[1:] = (mark[1:] != mark[:-1]) | (count[1:] != count[:-1])
    fresh[np.searchsorted(at, starts)[per_text > 0]] = True
    kept = fresh[owner]
    owner, bucket = owner[kept], bucket[kept]
    per_text = np.bincount(np.searchsorted(starts, at[fresh], side="right") - 1, minlength=n)
    order = np.argsort(owner, kind="stable")
    return per_text, count[fresh], bucket[order].astype(np.uint16)


def means(vectors: np.ndarray, rows: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Mean vector of each window; ``rows`` are the n-grams of all windows, ``sizes`` of each."""
    return np.add.reduceat(vectors[rows], np.cumsum(sizes) - sizes, axis=0) / sizes[:, None]


def probabilities(mean: np.ndarray, soft: np.ndarray, bias: np.ndarray) -> np.ndarray:
    logit = mean @ soft.T + bias
    logit -= logit.max(1, keepdims=True)
    return np.exp(logit) / np.exp(logit).sum(1, keepdims=True)


def gradients(vectors, soft, bias, rows, sizes, label, weight) -> tuple:
    """Of the weighted log-likelihood of windows' labels: n-grams and the gradient of each one's
    vector, the gradient of the softmax and of its bias."""
    mean = means(vectors, rows, sizes)
    off = (np.eye(2)[label] - probabilities(mean, soft, bias)) * weight[:, None]
    used, where = np.unique(rows, return_inverse=True)
    push = np.repeat(off @ soft / sizes[:, None], sizes, axis=0)
    moved = np.stack([np.bincount(where, push[:, k], len(used)) for k in range(push.shape[1])], 1)
    return used, moved, off.T @ mean, off.sum(0)


def train(docs: list[tuple[int, np.ndarray, np.ndarray]], epochs: int = 16, seed: int = 7) -> tuple:
    """``vectors, soft, bias`` from (label, windows' sizes, n-grams of all windows) of each
    document, by Adagrad. In the first epochs each window bears its document's label, later only
    the highest one."""
    rng = np.random.default_rng(seed)
    vectors, soft, bias = rng.normal(0, 0.1, (1 << BUCKET_BITS, DIM)), rng.normal(0, 0.3, (2, DIM)), np.zeros(2)
    docs = [d for d in docs if len(d[1])]
    toxic = sum(d[0] for d in docs)
    if not toxic or toxic == len(docs):
        bias[:] = (-4.5, 4.5) if docs and toxic else (4.5, -4.5)
        return 0 * vectors, soft, bias
    balance = min(4.0, (len(docs) - toxic) / toxic)
    squares = [np.full(x.shape, 1e-6) for x in (vectors, soft, bias)]
    for epoch in range(epochs):
        rate = 0.15 * (1 - epoch / epochs) + 0.01
        for batch in np.array_split(rng.permutation(len(docs)), max(1, len(docs) // 64)):
            some = [docs[i] for i in batch]
            sizes, rows = np.concatenate([d[1] for d in some]).astype(np.int64), np.concatenate([d[2] for d in some])
            owner = np.repeat(np.arange(len(some)), [len(d[1]) for d in some])
            label = np.array([d[0] for d in some])
            first = np.cumsum(sizes) - sizes
            if epoch >= 3:
                turn = (vectors @ (soft[1] - soft[0])).astype(np.float32)
                order = np.lexsort((np.add.reduceat(turn[rows], first) / sizes, owner))
                pick = order[np.append(owner[order][1:] != owner[order][:-1], True)]
                n = sizes[pick]
                rows = rows[np.repeat(first[pick] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
                sizes, y, share = n, label[owner[pick]], 1.0
            else:
                y, share = label[owner], 1 / np.bincount(owner)[owner]
            used, *steps = gradients(vectors, soft, bias, rows, sizes, y, np.where(y > 0, balance, 1.0) * share)
            squares[0][used] += steps[0] ** 2
            vectors[used] += rate * steps[0] / np.sqrt(squares[0][used])
            for x, total, step in ((soft, squares[1], steps[1]), (bias, squares[2], steps[2])):
                total += step**2
                x += rate * step / np.sqrt(total)
    return vectors, soft, bias


def fit_toxicity(docs: DataFrame, labels: DataFrame, max_docs: int = 4000, id_col="doc_id", text_col="text", label_col="toxic") -> tuple:
    """The model from at most ``max_docs`` labelled documents that are not held out, a quarter of
    them toxic ones, chosen by the hash of their id, and all windows of each. Labels other than
    0 and 1, and ids that are null or bear both, are left out. Without labels of both kinds the
    score is the same for all."""
    key = F.col(f"`{id_col}`")
    usable = (
        labels.where(F.col(label_col).isin(0, 1) & key.isNotNull() & ~held_out(key))
        .groupBy(key.cast("long").alias("key"))
        .agg(F.min(label_col).alias("y"), F.max(label_col).alias("y2"))
        .where("y = y2")
        .select("key", "y")
    )
    by_hash = [F.xxhash64("key"), F.col("key")]
    chosen = [usable.where(F.col("y") == y).orderBy(*by_hash).limit(max_docs // 4 if y else max_docs * 3 // 4) for y in (0, 1)]
    chosen = chosen[0].unionByName(chosen[1])

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, 100):
            per_text, per_word, bucket = grams_of(piece.column(0))
            cut = np.concatenate([[0], np.cumsum(per_word)])
            first = np.cumsum(per_text) - per_text
            sizes, grams = [], []
            for a, n in zip(first.tolist(), per_text.tolist()):
                edge = cut[a + np.append(np.arange(0, n, WINDOW), n)]
                size = np.diff(edge)
                sizes.append(size[size > 0].astype(np.uint32).tobytes())
                grams.append(bucket[edge[0] : edge[-1]].tobytes())
            yield pa.RecordBatch.from_arrays([piece.column(1), pa.array(sizes, pa.binary()), pa.array(grams, pa.binary())], names=["y", "sizes", "grams"])

    texts = docs.select(F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"), key.cast("long").alias("key"))
    rows = texts.join(F.broadcast(chosen), "key").select("text", F.col("y").cast("int").alias("y"))
    found = sorted((r.y, bytes(r.sizes), bytes(r.grams)) for r in rows.mapInArrow(windows, "y int, sizes binary, grams binary").toLocalIterator())
    return train([(y, np.frombuffer(n, np.uint32), np.frombuffer(g, np.uint16)) for y, n, g in found])


def toxicity_score(text, model: tuple, stride: int = 4):
    """Column of scores from 0 to 1; windows start at every ``stride``-th word and the last
    ends with the text, however long it is. A text without words (null too) scores as the bias
    alone does; equal texts score alike. Only the column given is read, so other columns of any
    name play no part; an empty table has no scores."""
    vectors, soft, bias = model
    # A linear softmax of a mean is the mean of what each vector adds to the difference of logits.
    scalar, bias = (vectors @ (soft[1] - soft[0])).astype(np.float32), float(bias[1] - bias[0])

    def score(column: pa.Array) -> pa.Array:
        out = np.full(len(column), bias)
        for at in range(0, len(column), 100):
            per_text, per_word, bucket = grams_of(column.slice(at, 100))
            total = np.concatenate([[0], np.cumsum(scalar[bucket], dtype=np.float64)])
            cut = np.concatenate([[0], np.cumsum(per_word)])
            first = np.cumsum(per_text) - per_text
            count = np.maximum(1, -(-(per_text - WINDOW) // stride) + 1) * (per_text > 0)
            owner = np.repeat(np.arange(len(per_text)), count)
            nth = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
            a = first[owner] + np.minimum(nth * stride, np.maximum(per_text[owner] - WINDOW, 0))
            b = np.minimum(a + WINDOW, first[owner] + per_text[owner])
            logit = (total[cut[b]] - total[cut[a]]) / np.maximum(cut[b] - cut[a], 1) + bias
            if len(owner):
                begin = np.flatnonzero(np.diff(owner, prepend=-1))
                out[at + owner[begin]] = np.maximum.reduceat(logit, begin)
        release()
        return pa.array(1 / (1 + np.exp(-np.clip(out, -30, 30))))

    return once(score, "double")(text)
