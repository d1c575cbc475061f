"""Operator 10: repeated byte strings by common-prefix intervals of enhanced suffix arrays.

Every byte that a ``length``-byte string covers which also starts earlier is found, wherever
the other occurrence is. One suffix array of a whole corpus does not fit anywhere, so the
strings are dealt out first, by their *anchor*: the least hash among the k-byte grams of a
string, the last of equal ones. Equal strings have equal anchors at equal places, so they
meet in one bucket. Neighbouring strings with one anchor form a *context*, which is all
that leaves a document:

1. Contexts that are equal as a whole, most of what copies share, need only their hashes: three
   of 64 bits each, of the anchor and two independent ones of the whole context. All but the
   first are repeats; each task keeps the first of its own before the shuffle.
2. Anchors left with contexts that differ get the bytes of those contexts. In each bucket an
   enhanced suffix array is built over them, a stack scan of its common prefixes walks the
   interval tree, and intervals whose occurrences differ in the byte before are the
   maximal repeats; all their occurrences but the first are marked.
3. An anchor with more than HOT such contexts (the edge of a passage that very many documents
   share) would be too much for one suffix array. Its strings are dealt out one by one, by two
   hashes of 64 bits, and the first of equal ones stays, as with contexts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import flat_bytes, materialize, once, release, shuffled, slices

GRAM = 24
STEP = np.uint64(0x9E3779B97F4A7C15)
_random = np.random.default_rng(20).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def gram_hashes(raw: np.ndarray) -> np.ndarray:
    """64-bit hash of the GRAM bytes from each place on (24 = 16 + 8), by doubling."""
    parts, size, h = {}, 1, _random[raw]
    while size < 16:
        h = h[: max(0, len(h) - size)] * (STEP + np.uint64(2 * size)) + h[size:]
        size *= 2
        parts[size] = h
    n = max(0, len(raw) - GRAM + 1)
    return _mix(parts[16][:n] * STEP + parts[8][16 : 16 + n])


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        x = np.minimum(x[: max(0, len(x) - size)], x[size:])
        size *= 2
    rest = width - size
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


BASES = (0xD6E8FEB86659FD93, 0x8CB92BA72F3D8DD7)
_second = np.random.default_rng(21).integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def rolling(raw: np.ndarray, which: int):
    """Function of the hash, one of two, of bytes ``lo`` to ``hi`` (arrays) wherever they stand: a
    sum of powers, divided by the power of its first place, whose inverse is a power too."""
    base, table = BASES[which], (_random, _second)[which]
    power = np.full(len(raw) + 1, base, np.uint64)
    power[0] = 1
    power = np.cumprod(power, dtype=np.uint64)
    total = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(table[raw] * power[:-1], out=total[1:])
    inverse = pow(base, -1, 1 << 64)
    return lambda lo, hi: (total[hi] - total[lo]) * power_of(inverse, lo)


def contexts(raw: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Of all texts in ``raw``: (text, anchor's hash, both hashes of the context, anchor's place in
    its text, first and last start of its strings before it), in order of text and place."""
    none = tuple(np.zeros(0, t) for t in (np.int64, np.uint64, np.uint64, np.uint64, np.int64, np.int64, np.int64))
    width = length - GRAM + 1
    if len(raw) < length:
        return none
    grams = gram_hashes(raw)
    mask = np.uint64((1 << 27) - 1)
    key = (grams & ~mask) | (mask - np.arange(len(grams), dtype=np.uint64))
    anchor = (mask - (sliding_min(key, width) & mask)).astype(np.int64)
    size = np.diff(ends)
    usable = np.maximum(size - length + 1, 0)
    text = np.repeat(np.arange(len(size)), usable)
    if not len(text):
        return none
    start = np.arange(len(text)) + np.repeat(ends[:-1] - (np.cumsum(usable) - usable), usable)
    anchor = anchor[start]
    change = np.flatnonzero(np.diff(anchor, prepend=-1))
    last = np.append(change[1:], len(anchor)) - 1
    at, lo, hi, text = anchor[change], start[change], start[last], text[change]
    shape = _mix(((at - lo) << 8 | (at - hi)).astype(np.uint64))
    one, other = (_mix(rolling(raw, k)(lo, hi + length) + shape) for k in range(2))
    first = ends[text]
    return text, grams[at], one, other, at - first, at - lo, at - hi


def power_of(base: int, exponents: np.ndarray) -> np.ndarray:
    """base ** exponent modulo 2 ** 64, by two tables of powers."""
    low = np.ones(4096, np.uint64)
    low[1:] = np.uint64(base)
    low = np.cumprod(low, dtype=np.uint64)
    n = int(exponents.max(initial=0)) // 4096 + 1
    high = np.ones(n, np.uint64)
    high[1:] = np.uint64(pow(base, 4096, 1 << 64))
    high = np.cumprod(high, dtype=np.uint64)
    return low[exponents & 4095] * high[exponents >> 12]


# --- enhanced suffix array -------------------------------------------------------------------


def suffix_array(raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes of all texts in order (a text's end comes before any byte), and the length of
    the common prefix of each with the one before. By prefix doubling; the ranks of each
    round also give the common prefixes."""
    n = len(raw)
    stop = np.repeat(ends[1:], np.diff(ends))
    place = np.arange(n)
    ranks, size = [raw.astype(np.int64)], 1
    longest = int(np.diff(ends).max(initial=0))
    while True:
        r = ranks[-1]
        ahead = np.full(n, -1, np.int64)
        inside = np.flatnonzero(place + size < stop)
        ahead[inside] = r[inside + size]
        key = r * (n + 258) + ahead + 1
        order = np.argsort(key, kind="stable")
        new = np.zeros(n, np.int64)
        new[order] = np.cumsum(np.diff(key[order], prepend=key[order[:1]]) != 0)
        size *= 2
        if size >= longest or new[order[-1]] == n - 1:
            break
        ranks.append(new)
    lcp = np.zeros(n, np.int64)
    i, j = order[:-1].copy(), order[1:].copy()
    for level in range(len(ranks) - 1, -1, -1):
        for _ in range(2 if level == len(ranks) - 1 else 1):
            ok = np.flatnonzero((i + (1 << level) <= stop[order[:-1]]) & (j + (1 << level) <= stop[order[1:]]))
            ok = ok[ranks[level][i[ok]] == ranks[level][j[ok]]]
            lcp[ok + 1] += 1 << level
            i[ok] += 1 << level
            j[ok] += 1 << level
    return order, lcp


def maximal_repeats(raw: np.ndarray, ends: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, int]]:
    """(places of all occurrences, length of the string) of each maximal repeat of at least
    ``length`` bytes: an interval of the suffix array whose suffixes share that prefix and no
    longer one, and are not all preceded by the same byte of their text."""
    if not len(raw):
        return
    order, lcp = suffix_array(raw, ends)
    left = np.empty(len(raw), np.int64)
    left[1:] = raw[:-1]
    first = ends[:-1][np.diff(ends) > 0]
    left[first] = -1 - np.arange(len(first))  # unlike any other
    deep = lcp >= length
    begin = np.flatnonzero(deep & ~np.append(False, deep[:-1]))
    end = np.flatnonzero(deep & ~np.append(deep[1:], False))
    many = -(1 << 40)  # more than one byte stands before
    for a, b in zip(begin.tolist(), end.tolist()):
        common, before = lcp[a : b + 1].tolist(), left[order[a - 1 : b + 1]].tolist()
        stack: list[list[int]] = []  # depth, first leaf, byte before
        for k, depth in enumerate([*common, 0]):
            leaf, lowest, byte = k, k, before[k]
            while stack and stack[-1][0] > depth:
                top = stack.pop()
                byte = byte if byte == top[2] else many
                lowest = top[1]
                if byte == many:
                    yield order[a - 1 + lowest : a + leaf], top[0]
                if stack and stack[-1][0] >= depth and stack[-1][2] != byte:
                    stack[-1][2] = many
            if stack and stack[-1][0] == depth:
                stack[-1][2] = stack[-1][2] if stack[-1][2] == byte else many
            elif depth:
                stack.append([depth, lowest, byte])


# --- dealing out -----------------------------------------------------------------------------

NO_ID = -(1 << 63)  # stands for a null id, and comes first
PIECE = 500_000  # bytes hashed at a time; longer texts are cut with an overlap


def _pieces(ends: np.ndarray, length: int) -> Iterator[tuple[int, int, int, int]]:
    """(first text, texts, first byte, end) of stretches of at most about PIECE bytes."""
    at, n = 0, len(ends) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + PIECE, side="right")) - 1)
        if to == at + 1 and ends[to] - ends[at] > 2 * PIECE:
            for begin in range(int(ends[at]), int(ends[to]) - length + 1, PIECE):
                yield at, 1, begin, min(begin + PIECE + length - 1, int(ends[to]))
        else:
            yield at, to - at, int(ends[at]), int(ends[to])
        at = to


def _runs(cover: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of stretches where a sum of opened and closed spans is above zero."""
    on = np.diff((np.cumsum(cover) > 0).astype(np.int8), prepend=0, append=0)
    return np.flatnonzero(on > 0), np.flatnonzero(on < 0)


DEALT = "bucket int, kind int, blob binary"
FOUND = "key long, sub int, kind int, x long, y long"


def _dealt(buckets: list, kinds: list, blobs: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(buckets, pa.int32()), pa.array(kinds, pa.int32()), pa.array(blobs, pa.binary())], names=["bucket", "kind", "blob"]
    )


def _found(key, sub, kind, x, y) -> pa.RecordBatch:
    n = len(key)
    columns = [np.asarray(key, np.int64), np.asarray(sub, np.int32), np.full(n, kind, np.int32), np.asarray(x, np.int64), np.asarray(y, np.int64)]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["key", "sub", "kind", "x", "y"])


def _split(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[order])) + 1
    for part in np.split(order, cuts) if len(order) else []:
        yield int(bucket[part[0]]), part


def _firsts(hashes: list[np.ndarray], key, at) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by hashes, document and place; where new hashes begin; and whether a row is another
    occurrence than their first (a repeated row is not)."""
    order = np.lexsort((at, key, *hashes[::-1]))
    key, at, begins = key[order], at[order], np.zeros(len(order), bool)
    begins[:1] = True
    for h in hashes:
        begins[1:] |= h[order[1:]] != h[order[:-1]]
    head = np.flatnonzero(begins)[np.cumsum(begins) - 1] if len(order) else np.zeros(0, np.int64)
    return order, begins, (key != key[head]) | (at >> np.uint64(14) != at[head] >> np.uint64(14))


def _span(at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    place = (at >> np.uint64(14) & np.uint64((1 << 31) - 1)).astype(np.int64)
    a, b = (at >> np.uint64(7) & np.uint64(127)).astype(np.int64), (at & np.uint64(127)).astype(np.int64)
    return place - a, place - b + length


def _dealt_hashes(hashes: list[np.ndarray], key: np.ndarray, at: np.ndarray, buckets: int) -> pa.RecordBatch | None:
    """First occurrences by bucket of their first hash (kind 0: five columns), and what is known
    to come later (kind 1: document and place), which may go anywhere."""
    order, begins, again = _firsts(hashes, key, at)
    kept, rest, rows = np.sort(order[begins]), order[again], []
    for bucket, k in _split((hashes[0][kept] >> np.uint64(40)).astype(np.int64) % buckets):
        k = kept[k]
        rows.append((bucket, 0, b"".join(c[k].tobytes() for c in (*hashes, key, at))))
    if len(rest):
        rest = rest[np.lexsort((at[rest], key[rest]))]
        rows.append((int(hashes[0][rest[0]] >> np.uint64(40)) % buckets, 1, key[rest].tobytes() + at[rest].tobytes()))
    return _dealt(*map(list, zip(*rows))) if rows else None


def _deal_contexts(buckets: int, length: int):
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2000):
            keys, subs = batch.column("key").to_numpy(), batch.column("sub").to_numpy().astype(np.uint64)
            raw, ends = flat_bytes(batch.column("text"))
            parts = []
            for first, n, begin, end in _pieces(ends, length):
                local = np.clip(ends[first : first + n + 1], begin, end) - begin
                text, hm, one, other, place, a, b = contexts(raw[begin:end], local, length)
                if n == 1:
                    place = place + (begin - ends[first])
                at = subs[first + text] << np.uint64(45) | place.astype(np.uint64) << np.uint64(14)
                parts.append((hm, one, other, keys[first + text], at | (a << 7 | b).astype(np.uint64)))
            if parts:
                *hashes, key, at = (np.concatenate(x) for x in zip(*parts))
                if (dealt := _dealt_hashes(hashes, key, at, buckets)) is not None:
                    yield dealt

    return deal


HOT = 10_000  # contexts of one anchor up to which a suffix array is built over them
HELD = 1_000_000  # rows of a bucket after which repeats are settled before more are read


def _meet(length: int, whole: bool):
    """Equal hashes of one bucket: all but the first occurrence are spans (kind 1). Unless
    ``whole``, that is all strings are the same as their hash, the first contexts of anchors
    that have several go on (kind 2, or 3 of a hot anchor: anchor's hash and place).

    A bucket comes whole, one after the other. A row that is known not to be the first never will
    be, so repeats can be settled before the bucket ends; and all contexts of an anchor that has
    turned hot go on at once."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows, now, hot = [], 0, None, np.zeros(0, np.uint64)

        def settle(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held, rows, hot
            *hashes, key, at = np.concatenate(held, axis=1)
            key = key.view(np.int64)
            order, begins, again = _firsts(hashes, key, at)
            rest, heads = order[again], order[begins]
            if len(rest):
                yield _spans(key[rest], at[rest], length)
            if not whole:
                anchors = hashes[0][heads]
                new = np.append(True, anchors[1:] != anchors[:-1])
                group = np.cumsum(new) - 1
                many = np.bincount(group)[group]
                burning = (many > HOT) | np.isin(anchors, hot)
                hot = np.union1d(hot, anchors[burning])
                going = [(3, heads[burning])] + ([(2, heads[~burning & (many > 1)])] if last else [])
                for kind, k in going:
                    if len(k):
                        yield _found(key[k], at[k] >> np.uint64(45), kind, hashes[0][k].view(np.int64), at[k].view(np.int64))
                heads = heads[~burning]
            held, rows = [np.stack([*(h[heads] for h in hashes), key[heads].view(np.uint64), at[heads]])], len(heads)

        for batch in batches:
            for bucket, kind, blob in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if kind:
                    key, at = np.frombuffer(blob, np.int64).reshape(2, -1)
                    yield _spans(key, at.view(np.uint64), length)
                    continue
                if bucket != now:
                    if held:
                        yield from settle(True)
                    held, rows, now, hot = [], 0, bucket, hot[:0]
                held.append(np.frombuffer(blob, np.uint64).reshape(5, -1))
                rows += held[-1].shape[1]
                if rows > max(HELD, 2 * held[0].shape[1]):
                    yield from settle(False)
        if held:
            yield from settle(True)
        release()

    return meet


def _spans(key: np.ndarray, at: np.ndarray, length: int) -> pa.RecordBatch:
    """Contexts, or strings, as spans (kind 1), those that touch made one."""
    order = np.lexsort((at, key))
    key, at = key[order], at[order]
    sub = (at >> np.uint64(45)).astype(np.int64)
    start, end = _span(at, length)
    new = np.append(True, (key[1:] != key[:-1]) | (sub[1:] != sub[:-1]) | (start[1:] > end[:-1]))
    last = np.append(np.flatnonzero(new)[1:], len(new)) - 1
    return _found(key[new], sub[new], 1, start[new], end[last])


def _opened(batch: pa.RecordBatch) -> tuple:
    """Of the contexts that documents' ``open`` lists name: all texts' bytes and ends; for each
    context its text, document, anchor's hash, place, and first and last byte in its text."""
    keys, opened = batch.column("key").to_numpy(), batch.column("open")
    raw, ends = flat_bytes(batch.column("text"))
    n = opened.value_lengths().to_numpy(zero_copy_only=False)
    flat = opened.flatten()
    hm, at = (flat.field(c).to_numpy(zero_copy_only=False).view(np.uint64) for c in ("x", "y"))
    text = np.repeat(np.arange(len(n)), n)
    return raw, ends, text, keys[text], hm, at


def _cut_contexts(buckets: int, length: int):
    """The bytes of contexts, dealt by anchor."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 2000):
            raw, ends, text, key, hm, at = _opened(batch)
            start, end = _span(at, length)
            rows = []
            for bucket, k in _split((hm >> np.uint64(40)).astype(np.int64) % buckets):
                first, size = ends[text[k]] + start[k], end[k] - start[k]
                index = np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())
                head = np.array([len(k)], np.uint64).tobytes() + hm[k].tobytes() + key[k].tobytes() + at[k].tobytes()
                rows.append((bucket, 2, head + raw[index].tobytes()))
            if rows:
                yield _dealt(*map(list, zip(*rows)))

    return cut


def _cut_strings(buckets: int, length: int):
    """Hashes of the strings of hot anchors' contexts, dealt by the first of them."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 500):
            raw, ends, text, key, _, at = _opened(batch)
            start, end = _span(at, length)
            n = end - start - length + 1
            owner = np.repeat(np.arange(len(n)), n)
            place = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n) + start[owner]
            lo = ends[text[owner]] + place
            one, other = (_mix(rolling(raw, k)(lo, lo + length)) for k in range(2))
            spot = at[owner] >> np.uint64(45) << np.uint64(45) | place.astype(np.uint64) << np.uint64(14)
            if len(lo):
                yield _dealt_hashes([one, other, np.zeros(len(lo), np.uint64)], key[owner], spot, buckets)

    return cut


CHUNK = 300_000  # bytes of contexts in one suffix array, more only if one anchor has more


def _compare(length: int):
    """Maximal repeats among the contexts of each anchor; spans of all but the first occurrence.
    A bucket comes whole, one after the other."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], None
        for batch in batches:
            for bucket, blob in zip(batch.column("bucket").to_pylist(), batch.column("blob").to_pylist()):
                if bucket != now:
                    yield from _compare_blobs(held, length)
                    held, now = [], bucket
                held.append(blob)
        yield from _compare_blobs(held, length)
        release()

    return compare


def _compare_blobs(blobs: list[bytes], length: int) -> Iterator[pa.RecordBatch]:
    columns: list[list[np.ndarray]] = [[], [], [], []]
    for blob in blobs:
        n = int(np.frombuffer(blob, np.uint64, 1)[0])
        for k in range(3):
            columns[k].append(np.frombuffer(blob, np.uint64, n, 8 + 8 * n * k))
        columns[3].append(np.frombuffer(blob, np.uint8, -1, 8 + 24 * n))
    if blobs:
        hm, key, at, raw = map(np.concatenate, columns)
        yield from _compare_bucket(hm, key.view(np.int64), at, raw, length)


def _compare_bucket(hm, key, at, raw, length) -> Iterator[pa.RecordBatch]:
    start, end = _span(at, length)
    size = end - start
    first = np.cumsum(size) - size
    # Only contexts with a string that occurs again need a suffix array; equal hashes find them.
    n = size - length + 1
    owner = np.repeat(np.arange(len(n)), n)
    where = np.arange(len(owner)) + np.repeat(first - (np.cumsum(n) - n), n)
    marks = rolling(raw, 0)(where, where + length)
    order = np.argsort(marks, kind="stable")
    same = marks[order][1:] == marks[order][:-1]
    hit = np.zeros(len(n), bool)
    hit[owner[order[np.append(same, False) | np.append(False, same)]]] = True
    kept = np.flatnonzero(hit)
    kept = kept[np.argsort(hm[kept], kind="stable")]
    if not len(kept):
        return
    new = np.append(True, hm[kept][1:] != hm[kept][:-1])
    chunk = (np.cumsum(size[kept]) - size[kept]) // CHUNK
    chunk = chunk[np.flatnonzero(new)][np.cumsum(new) - 1]  # an anchor stays together
    for _, k in _split(chunk):
        k = kept[k]
        index = np.repeat(first[k] - (np.cumsum(size[k]) - size[k]), size[k]) + np.arange(size[k].sum())
        ends = np.concatenate([[0], np.cumsum(size[k])])
        owner = np.repeat(np.arange(len(k)), size[k])
        document = np.unique(np.stack([key[k], (at[k] >> np.uint64(45)).astype(np.int64)]), axis=1, return_inverse=True)[1].ravel()
        age = document[owner].astype(np.int64) << 32 | (start[k][owner] + np.arange(len(owner)) - ends[owner])
        cover = np.zeros(len(owner) + 1, np.int64)
        for places, depth in maximal_repeats(raw[index], ends, length):
            ages = age[places]
            later = places[ages > ages.min()]
            np.add.at(cover, later, 1)
            np.add.at(cover, later + depth, -1)
        lo, hi = _runs(cover[:-1])
        # A run may go over into the next context's bytes: cut it where contexts end.
        for a, b in _cut_runs(lo, hi, ends):
            c = owner[a]
            shift = start[k][c] - ends[c]
            yield _found(key[k][c], at[k][c] >> np.uint64(45), 1, a + shift, b + shift)


def _cut_runs(lo: np.ndarray, hi: np.ndarray, ends: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    if len(lo):
        inner = ends[1:-1]
        inner = inner[(np.searchsorted(lo, inner, side="left") - np.searchsorted(hi, inner, side="right")) > 0]
        yield np.sort(np.concatenate([lo, inner])), np.sort(np.concatenate([hi, inner]))


def _with_spans(docs: DataFrame, length: int, id_col: str, text_col: str) -> DataFrame:
    """``docs`` with ``__spans``: repeated stretches in any order, which may meet and overlap."""
    if not 32 <= length <= 150:
        raise ValueError("length must be from 32 to 150")
    spark = docs.sparkSession
    buckets = 8 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    key, sub = F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(NO_ID)), F.crc32(text).bitwiseAND(F.lit(0xFFFF)).cast("int")
    rows = docs.select(key.alias("key"), sub.alias("sub"), text.alias("text"))

    def gathered(dealt: DataFrame) -> DataFrame:
        return dealt.repartition("bucket").sortWithinPartitions("bucket")

    found = materialize(gathered(rows.mapInArrow(_deal_contexts(buckets, length), DEALT)).mapInArrow(_meet(length, False), FOUND), "repeats")
    parts = [found]
    for kind, cut, meet in ((2, _cut_contexts(buckets, length), _compare(length)), (3, _cut_strings(buckets, length), _meet(length, True))):
        opened = found.where(F.col("kind") == kind).groupBy("key", "sub").agg(F.collect_list(F.struct("x", "y")).alias("open"))
        if kind == 2 or found.where("kind = 3").limit(1).count():
            parts.append(materialize(gathered(rows.join(shuffled(opened), ["key", "sub"]).mapInArrow(cut, DEALT)).mapInArrow(meet, FOUND), "repeats"))
    spans = reduce(DataFrame.unionByName, parts).where("kind = 1").groupBy(F.col("key").alias("__key"), F.col("sub").alias("__sub"))
    spans = spans.agg(F.collect_list(F.struct(F.col("x").cast("int").alias("start"), F.col("y").cast("int").alias("end"))).alias("__spans"))
    return docs.join(shuffled(spans), (key == F.col("__key")) & (sub == F.col("__sub")), "left").drop("__key", "__sub")


def repeated_spans(docs: DataFrame, length: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``spans array<struct<start int, end int>>``: the maximal stretches of bytes
    of the text's UTF-8 form that a ``length``-byte string covers which also starts earlier (in
    a document with a smaller id, or in the same one before).

    Null and short texts have none, very long ones are taken whole, an empty table gives an
    empty one, and a column ``spans`` is replaced. Null ids come before all others; of texts that
    share an id the order is by a checksum of 16 bits, and rows that agree in id and checksum,
    repeated rows among them, count as one document and get the same spans. ``length`` may be
    from 32 to 150.

    A bucket holds the contexts of an anchor: of those that all differ, ``HOT`` at most at once
    (about 6 KB each), whatever the number of documents."""
    docs = docs.drop(*{"spans"}.difference((id_col, text_col)))
    return _with_spans(docs, length, id_col, text_col).withColumn("spans", once(_merged, SPANS)("__spans")).drop("__spans")


def without_repeats(docs: DataFrame, length: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` whose texts lack the bytes of :func:`repeated_spans`, with ``n_removed long``, how
    many those were; characters cut in half are dropped. Null texts stay null; a column
    ``n_removed`` is replaced; else as for the spans."""

    def rest(texts: pa.Array, found: pa.Array) -> pa.Array:
        kept, removed = [], []
        for t, spans in zip(texts.to_pylist(), _merged(found).to_pylist()):
            data, n = _rest(t, spans)
            kept.append(None if t is None else t if not spans else data.decode(errors="ignore"))
            removed.append(n - len(data))
        return pa.StructArray.from_arrays([pa.array(kept, pa.string()), pa.array(removed, pa.int64())], names=["text", "n"])

    found = _with_spans(docs.drop(*{"n_removed"}.difference((id_col, text_col))), length, id_col, text_col)
    cut = once(rest, "struct<text:string,n:bigint>")(F.col(f"`{text_col}`"), F.col("__spans"))
    found = found.withColumn("__rest", cut).withColumn(text_col, F.col("__rest.text")).withColumn("n_removed", F.col("__rest.n"))
    return found.drop("__rest", "__spans")


SPANS = "array<struct<start:int,end:int>>"


def _merged(column: pa.Array) -> pa.Array:
    out = []
    for spans in column.to_pylist():
        kept: list[list[int]] = []
        for a, b in sorted((x["start"], x["end"]) for x in spans or ()):
            if kept and a <= kept[-1][1]:
                kept[-1][1] = max(b, kept[-1][1])
            else:
                kept.append([a, b])
        out.append([{"start": a, "end": b} for a, b in kept])
    return pa.array(out, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))


def _rest(text: str | None, spans: list[dict]) -> tuple[bytes, int]:
    data = (text or "").encode()
    at, parts = 0, []
    for s in spans or ():
        parts.append(data[at : s["start"]])
        at = s["end"]
    return b"".join([*parts, data[at:]]), len(data)


def span_digest(text, spans):
    """``struct<n_bytes, n_removed, n_spans, kept_sha256>`` of a text and its spans."""

    def digest(texts: pa.Array, spans: pa.Array) -> pa.Array:
        out = []
        for t, s in zip(texts.to_pylist(), spans.to_pylist()):
            kept, n = _rest(t, s)
            out.append({"n_bytes": n, "n_removed": n - len(kept), "n_spans": len(s or ()), "kept_sha256": hashlib.sha256(kept).hexdigest()})
        kinds = [("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())]
        return pa.array(out, pa.struct(kinds))

    return once(digest, "struct<n_bytes:bigint,n_removed:bigint,n_spans:bigint,kept_sha256:string>")(text, spans)
