"""Operator 4: token counts of unigram segmentation, computed along a trie of words.

The best segmentation of a word's first k characters depends on those characters alone, so
words that share a prefix share its scores. Distinct words are visited in the order of a
depth-first walk of their trie (sorted), each prefix scored once; the count at a word's last
node is stored and looked up for every occurrence.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from .common import once, release

MARK = "▁"  # stands for the blank before a word


def unigram_scores(path: str) -> tuple[dict[str, float], float]:
    """Pieces of a sentencepiece file with log-probabilities that follow Zipf's law in the
    order of ids, and the score of one byte of a character that no piece covers."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    kept = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    total = sum(1 / (k + 10) for k in range(len(kept)))
    scores = {model.id_to_piece(i): -math.log((k + 10) * total) for k, i in enumerate(kept)}
    return scores, min(scores.values(), default=0.0) - 10


def trie_counts(words: Iterable[str], scores: dict[str, float], byte_score: float) -> dict[str, int]:
    """Tokens in the best segmentation of each distinct word; of equally good ones the one
    with the fewest. A character may also be its UTF-8 bytes, a token each."""
    longest = max(map(len, scores), default=1)
    get, out = scores.get, {}
    best, count, before = [0.0], [0], ""
    for word in sorted(words):
        text = MARK + word
        shared, top = 0, min(len(text), len(before))
        while shared < top and text[shared] == before[shared]:
            shared += 1
        del best[shared + 1 :], count[shared + 1 :]
        for end in range(shared + 1, len(text) + 1):
            size = len(text[end - 1].encode())
            score, n = best[end - 1] + size * byte_score, count[end - 1] + size
            for start in range(max(0, end - longest), end):
                piece = get(text[start:end])
                if piece is not None:
                    new = best[start] + piece
                    if new > score or new == score and count[start] + 1 < n:
                        score, n = new, count[start] + 1
            best.append(score)
            count.append(n)
        out[word], before = count[-1], text
    return out


_workers: dict = {}
KNOWN_WORDS = 300_000  # counts that a worker keeps


def token_counts(text, path: str):
    """Column of ``struct<n_words, n_tokens>`` for a text column; words are what white space
    separates. Null and empty texts have none, very long ones are counted whole, and rows that
    agree in their text, repeated rows among them, in their counts; other columns play no part."""

    def count(column: pa.Array) -> pa.Array:
        if path not in _workers:
            _workers[path] = (*unigram_scores(path), {})
        scores, byte_score, known = _workers[path]
        n_words, n_tokens = [], []
        for at in range(0, len(column), 500):
            split = [(x or "").split() for x in column.slice(at, 500).to_pylist()]
            new = set().union(*split).difference(known)
            if len(known) + len(new) > KNOWN_WORDS:
                known.clear()
                new = set().union(*split)
            known.update(trie_counts(new, scores, byte_score))
            n_words += map(len, split)
            n_tokens += [sum(map(known.__getitem__, x)) for x in split]
        release()
        return pa.StructArray.from_arrays(
            [pa.array(np.array(n_words, np.int64)), pa.array(np.array(n_tokens, np.int64))], names=["n_words", "n_tokens"]
        )

    return once(count, "struct<n_words:bigint,n_tokens:bigint>")(text)
