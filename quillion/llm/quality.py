"""Operator 1: document quality from a linear-chain conditional random field over lines.

Every line is good or bad. Its features are binned shares of kinds of bytes and of repeated
words, word and line length and whether the line repeats, of the line itself and of both neighbours; the states of
neighbouring lines are tied by transition weights. Forward-backward marginals, weighted by
line length, add up to the quality of the document.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import flat_bytes, held_out, once, release, slices

#: Kinds of bytes: 1 lower case, 2 upper case, 3 digit, 4 space, 5 prose punctuation, 6 bar, 7 other symbol, 8 beyond ASCII.
KIND = np.full(256, 7, np.uint8)
KIND[128:] = 8
KIND[97:123], KIND[65:91], KIND[48:58] = 1, 2, 3
KIND[list(b" \t\r\x0b\x0c")] = 4
KIND[list(b".,;:!?'\"()-")] = 5
KIND[ord("|")] = 6
SHARES = np.array([1e-9, 0.005, 0.02, 0.05, 0.1, 0.2, 0.4])
WORD_LENGTHS = np.array([1.5, 2.5, 3.5, 4.5, 5.5, 6.5, 8, 10, 14, 20])
FEATURES, BINS = 11, 16  # bin 0 stands for no such line


def lines_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lines per text, bytes per line, bins per line) of all texts; an empty or null text has
    one empty line."""
    raw, ends = flat_bytes(column)
    breaks = np.flatnonzero(raw == 10)
    per_text = np.diff(np.searchsorted(breaks, ends)) + 1
    n = int(per_text.sum())
    first = np.cumsum(per_text) - per_text
    starts = np.zeros(n, np.int64)
    is_first = np.zeros(n, bool)
    is_first[first] = True
    starts[first] = ends[:-1]
    starts[~is_first] = breaks + 1
    stops = np.zeros(n, np.int64)
    is_last = np.zeros(n, bool)
    is_last[first + per_text - 1] = True
    stops[is_last] = ends[1:]
    stops[~is_last] = breaks
    size = stops - starts
    kind = KIND[raw]

    def count(flags: np.ndarray) -> np.ndarray:
        total = np.zeros(len(raw) + 1, np.int32)
        np.cumsum(flags, out=total[1:], dtype=np.int32)
        return total[stops] - total[starts]

    bins = np.zeros((n, FEATURES), np.uint8)
    bins[:, 0] = np.minimum(np.bitwise_count((1 << np.ceil(np.log2(size + 1)).astype(np.int64)) - 1), 14)
    for k, c in enumerate((2, 3, 4, 5, 6, 7, 8), 1):
        bins[:, k] = np.searchsorted(SHARES, count(kind == c) / np.maximum(size, 1), side="right")
    inside = (kind != 4) & (raw != 10)
    begins, closes = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    closes[:-1] &= ~inside[1:]
    edge = starts[size > 0]
    begins[edge] |= inside[edge]
    edge = stops[size > 0] - 1
    closes[edge] |= inside[edge]
    words = count(begins)
    bins[:, 8] = np.searchsorted(WORD_LENGTHS, count(inside) / np.maximum(words, 1))
    # A word of the same bytes as the one before it in the line, whatever their order.
    mark = np.concatenate([[0], np.cumsum(raw.astype(np.int64) ** 3)])
    at = np.flatnonzero(begins)
    mark = mark[np.flatnonzero(closes) + 1] - mark[at]
    same = np.zeros(len(raw), bool)
    same[at[1:][mark[1:] == mark[:-1]]] = True
    same[starts[size > 0]] = False
    bins[:, 10] = np.searchsorted(SHARES, count(same) / np.maximum(words, 1), side="right")
    data = memoryview(np.ascontiguousarray(raw))
    marks = np.fromiter((zlib.crc32(data[a:b]) for a, b in zip(starts.tolist(), stops.tolist())), np.int64, n)
    key = np.repeat(np.arange(len(per_text)), per_text) << 32 | marks
    _, back, times = np.unique(key, return_inverse=True, return_counts=True)
    bins[:, 9] = np.minimum(np.bitwise_count((1 << np.ceil(np.log2(times[back])).astype(np.int64)) - 1), 6)
    return per_text, size, bins + 1


def with_neighbours(per_text: np.ndarray, bins: np.ndarray) -> np.ndarray:
    """Bins of each line, the line before and the line after; 0 beyond the text's ends."""
    first = np.cumsum(per_text) - per_text
    before, after = np.zeros_like(bins), np.zeros_like(bins)
    before[1:], after[:-1] = bins[:-1], bins[1:]
    before[first], after[first + per_text - 1] = 0, 0
    return np.concatenate([bins, before, after], axis=1)


def emissions(bins: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Log-odds of good over bad that the features of each line give."""
    out = np.full(len(bins), weights[-1])
    for k in range(bins.shape[1]):
        out += weights[k * BINS : (k + 1) * BINS][bins[:, k]]
    return out


def marginals(per_text: np.ndarray, score: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """P(good) of each line, the expected 2 x 2 transition counts, and the sum of log partition
    functions. Texts run side by side; shorter ones leave early."""
    n = len(per_text)
    order = np.argsort(-per_text, kind="stable")
    lengths = per_text[order]
    first = (np.cumsum(per_text) - per_text)[order]
    steps = int(lengths.max(initial=0))
    open_ = np.searchsorted(-lengths, -np.arange(steps), side="left")
    move = np.exp(turn)
    local = np.stack([np.zeros_like(score), score], 1)
    shift = local.max(1)
    local = np.exp(local - shift[:, None])
    ahead = np.zeros((len(score), 2))
    log_z = shift.sum()
    state = np.zeros((n, 2))
    for t in range(steps):
        k = open_[t]
        at = first[:k] + t
        state = local[at] * (state[:k] @ move if t else 1)
        total = state.sum(1, keepdims=True)
        log_z += np.log(total).sum()
        state = state / total
        ahead[at] = state
    good, moves = np.zeros(len(score)), np.zeros((2, 2))
    back = np.ones((n, 2))
    for t in range(steps - 1, -1, -1):
        k = open_[t]
        at = first[:k] + t
        if t + 1 < steps and (k2 := open_[t + 1]):
            after = local[at[:k2] + 1] * back[:k2]
            pair = ahead[at[:k2]][:, :, None] * move[None] * after[:, None, :]
            moves += (pair / pair.sum((1, 2), keepdims=True)).sum(0)
            new = after @ move.T
            back[:k2] = new / new.sum(1, keepdims=True)
        both = ahead[at] * back[:k]
        good[at] = both[:, 1] / both.sum(1)
    return good, moves, log_z


def train(per_text: np.ndarray, bins: np.ndarray, label: np.ndarray, rounds: int = 200, penalty: float = 1e-3) -> tuple:
    """Weights by maximum likelihood (full-batch Adam); every line bears its text's label."""
    x = with_neighbours(per_text, bins).astype(np.int64) + np.arange(3 * FEATURES) * BINS
    y = np.repeat(label.astype(float), per_text)
    width = 3 * FEATURES * BINS
    theta = np.zeros(width + 1 + 4)
    inside = np.ones(len(y), bool)
    inside[np.cumsum(per_text) - per_text] = False
    states = y.astype(int)
    told = np.zeros((2, 2))
    np.add.at(told, (states[:-1][inside[1:]], states[1:][inside[1:]]), 1)
    m, v, n = np.zeros_like(theta), np.zeros_like(theta), max(len(y), 1)
    for step in range(1, rounds + 1):
        score = theta[x].sum(1) + theta[width]
        good, moves, _ = marginals(per_text, score, theta[width + 1 :].reshape(2, 2))
        off = y - good
        grad = np.bincount(x.ravel(), np.repeat(off, x.shape[1]), minlength=len(theta)) / n
        grad[width] = off.mean() if len(off) else 0
        grad[width + 1 :] = (told - moves).ravel() / n
        grad -= penalty * theta
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        theta += 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return theta[: width + 1], theta[width + 1 :].reshape(2, 2)


def fit_quality(
    docs: DataFrame, labels: DataFrame, max_docs: int = 4000, id_col="doc_id", text_col="text", label_col="quality"
) -> tuple:
    """The model from at most ``max_docs`` labelled documents that are not held out, chosen by
    the hash of their id, and all lines of each. Labels other than 0 and 1, and ids that are null or bear both labels, are left out.
    Without labels every line is equally likely good or bad."""
    key = F.col(f"`{id_col}`")
    chosen = (
        labels.where(F.col(label_col).isin(0, 1) & key.isNotNull() & ~held_out(key))
        .groupBy(key.cast("long").alias("key"))
        .agg(F.min(label_col).alias("y"), F.max(label_col).alias("y2"))
        .where("y = y2")
        .orderBy(F.xxhash64("key"), "key")
        .limit(max_docs)
        .select("key", "y")
    )

    def lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 200):
            per_text, _, bins = lines_of(batch.column(0))
            cut = np.concatenate([[0], np.cumsum(per_text)]).tolist()
            parts = [bins[a:b].tobytes() for a, b in zip(cut, cut[1:])]
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.binary()), batch.column(1)], names=["bins", "y"])

    texts = docs.select(F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"), key.cast("long").alias("key"))
    rows = texts.join(F.broadcast(chosen), "key").select("text", F.col("y").cast("int").alias("y"))
    found = sorted((r.y, bytes(r.bins)) for r in rows.mapInArrow(lines, "bins binary, y int").collect())
    if not found:
        return np.zeros(3 * FEATURES * BINS + 1), np.zeros((2, 2))
    per_text = np.array([len(b) // FEATURES for _, b in found])
    bins = np.frombuffer(b"".join(b for _, b in found), np.uint8).reshape(-1, FEATURES)
    return train(per_text, bins, np.array([y for y, _ in found]))


def quality_score(text, model: tuple):
    """Column of scores from 0 to 1 for a text column, over all lines of each text, however long.
    Null counts as empty, which is one empty line; equal texts score alike. Only the column given
    is read, so other columns of any name play no part; an empty table has no scores."""
    weights, turn = model

    def score(column: pa.Array) -> pa.Array:
        out = []
        for at in range(0, len(column), 200):
            per_text, size, bins = lines_of(column.slice(at, 200))
            good, _, _ = marginals(per_text, emissions(with_neighbours(per_text, bins), weights), turn)
            first = np.cumsum(per_text) - per_text
            out.append(np.add.reduceat(good * (size + 1), first) / np.add.reduceat(size + 1.0, first))
        release()
        return pa.array(np.concatenate(out) if out else np.zeros(0))

    return once(score, "double")(text)
