"""Adaptive context-mixing range coder for token ids, in independently reset blocks.

Every block starts from an empty model, so any block decodes alone; the blocks of a batch
are coded side by side, one numpy lane each. A block first gives its distinct ids in the
order they arrive, by a fixed prior over the vocabulary; from then on an id is its number in
that order, and the model predicts the next one by mixing three distributions:

- order 0: how often each id has occurred in the block, with a share for an id that has not
  (as many halves as there have been new ones);
- order 1 and order 2: the id seen last after the one before, and after the two before, each
  with a count of how often it has held.

The share of orders 1 and 2 is learned within the block for each pair of such counts. The
mixture drives a carry-propagating range coder with 32-bit digits.
"""

from __future__ import annotations

import zlib
from functools import cache

import numpy as np

UNIT = 64  # weights are in 64ths
PAIR_BITS = 11  # slots of the order-2 table
RATE = 4  # how fast weights follow
RUN, PRIOR_BITS, PRIOR_FLAT = 256, 15, 300
FLOOR = np.uint64(1 << 31)
WHOLE = np.uint64((1 << 63) - 1)
MOST = 8192  # ids in a block
ROWS = 64  # blocks numbered at a time


class CorruptBlock(ValueError):
    """A block's checksum or length does not hold."""


@cache
def _prior(vocab: int) -> np.ndarray:
    """Cumulative weights of runs of RUN ids, which fall with the id as in a vocabulary that
    was merged in order of frequency; ids of a run weigh the same."""
    runs = -(-vocab // RUN)
    edges = np.log(np.arange(runs + 1) * RUN + PRIOR_FLAT)
    spare = (1 << PRIOR_BITS) - runs
    if spare < 0:
        raise ValueError(f"a vocabulary of {vocab} ids is too large")
    return np.arange(runs + 1) + np.floor((edges - edges[0]) / (edges[-1] - edges[0]) * spare).astype(np.int64)


class _Model:
    """State of ``lanes`` blocks with at most ``distinct`` ids each; ``look`` before and
    ``learn`` after each id. Tables by id are slot by lane, those of order 2 and of trust lane by
    slot. Numpy is quick on flat arrays of one type only, so orders 1 and 2 have arrays of their
    own, ids are int16, weights and intervals int32, and places int64.

    The sums of order-0 weights are renewed every ``stay`` steps. Until then a number that has
    just arrived has a weight of one: as many as can arrive are given theirs in advance."""

    def __init__(self, lanes: int, distinct: int, steps: int):
        self.lanes, self.lane = lanes, np.arange(lanes)
        rows = distinct + _stay(steps) + 2
        self.weight = np.zeros((rows, lanes), np.int16)  # twice the occurrences less one
        self.sums = np.full((1 << rows.bit_length(), lanes), 32767, np.int16)
        self.flat_weight, self.flat_sums = self.weight.ravel(), self.sums.ravel()
        self.rows = list(zip(self.sums, self.weight, self.sums[1:]))
        self.last1 = np.zeros(rows * lanes, np.int16)  # an id, then 2 bits of sureness
        self.last2 = np.zeros(lanes << PAIR_BITS, np.int16)
        self.trust1, self.trust2 = np.full((2, lanes << 5), 1 << 13, np.int32)
        self.known = np.zeros(lanes, np.int16)
        self.gates, self.pairs = self.lane << 5, self.lane << PAIR_BITS
        self.at1, self.at2 = self.lane, self.pairs
        self.one, self.renew, self.end = np.zeros(lanes, np.int32), 0, np.zeros(lanes, np.int64)

    def look(self, n: int, t: int) -> None:
        """Predictions and weights of the first ``n`` lanes, which shrink but never grow."""
        if t == self.renew:
            self._sum(t)
        self.at1, self.at2 = self.at1[:n], self.at2[:n]
        self.e1, self.e2 = e1, e2 = self.last1.take(self.at1), self.last2.take(self.at2)
        self.p1, self.p2 = e1 >> 2, e2 >> 2
        same = self.p1 == self.p2
        gate = (e2 & 3) << 3
        gate += (e1 & 3) << 1
        gate += same
        self.gate = gate.astype(np.int64)
        self.gate += self.gates[:n]
        self.t1, self.t2 = self.trust1.take(self.gate), self.trust2.take(self.gate)
        self.w2 = np.minimum(self.t2 >> 10, 56)
        self.w1 = np.minimum(np.minimum(self.t1 >> 10, 56), 60 - self.w2)
        self.w1 *= ~same
        self.rest = UNIT - self.w1 - self.w2
        self.top2, self.wide1 = self.w2 * self.total, self.w1 * self.total
        self.top1 = self.top2 + self.wide1

    def _sum(self, t: int) -> None:
        stay = _stay(t)
        end, row = self.known + stay, int(self.end.min())
        top = int(end.max())
        slots = np.arange(row, top)[:, None]
        self.weight[row:top] |= (slots >= self.end) & (slots < end)
        self.sums[0] = 0
        for below, weight, above in self.rows[:top]:  # row by row: cumsum would go down each lane
            np.add(below, weight, above)
        self.total, self.fresh = 2 * t + 2 + stay, self.known.astype(np.int32) + 2
        self.end, self.renew, self.top = end, t + stay, top

    def find(self, weight: np.ndarray, lane: np.ndarray) -> np.ndarray:
        """The number whose order-0 weights hold ``weight`` (int16) in each of some lanes, as
        slot by lane."""
        at = lane.copy()
        step = 1 << self.top.bit_length() - 1
        while step:
            further = at + step * self.lanes
            np.copyto(at, further, where=self.flat_sums.take(further) <= weight)
            step >>= 1
        return at

    def interval(self, at: np.ndarray, old: np.ndarray, one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the number at ``at`` begins of ``UNIT * total``, and how wide it is: by order 2
        or order 1 where these are told to hold, else by order 0, where the new come first."""
        fresh = self.fresh[: len(at)]
        under = self.flat_sums.take(at)
        freq = (self.flat_sums.take(at + self.lanes) - under).astype(np.int32)
        np.copyto(freq, fresh, where=~old)
        freq *= self.rest
        cum = under + fresh
        cum *= old
        cum *= self.rest
        cum += self.top1
        np.copyto(cum, self.top2, where=one)
        np.copyto(freq, self.wide1, where=one)
        np.copyto(cum, 0, where=two)
        np.copyto(freq, self.top2, where=two)
        return cum, freq

    def learn(self, x: np.ndarray, at: np.ndarray, hit1: np.ndarray, hit2: np.ndarray, n: int) -> None:
        """``at`` is ``x`` as slot by lane; ``hit1`` and ``hit2`` are where ``x`` was foretold."""
        known = self.known[:n]
        old = x < known
        self.trust1[self.gate] = self.t1 + (hit1 * np.int32(65535) - self.t1 >> RATE)
        self.trust2[self.gate] = self.t2 + (hit2 * np.int32(65535) - self.t2 >> RATE)
        first = (x << 2) + np.int16(1)
        self.last1[self.at1] = np.where(hit1, np.minimum(self.e1 + np.int16(1), self.e1 | 3), first)
        self.last2[self.at2] = np.where(hit2, np.minimum(self.e2 + np.int16(1), self.e2 | 3), first)
        self.flat_weight[at] = self.flat_weight.take(at) + old * np.int16(2)
        known += ~old
        self.at1, wide = at, x.astype(np.int32)
        pair = wide * 40503
        pair += self.one[:n]
        pair >>= 5
        pair &= (1 << PAIR_BITS) - 1
        self.at2 = pair.astype(np.int64)
        self.at2 += self.pairs[:n]
        self.one = wide * 69621


def _stay(t: int) -> int:
    return max(1, t >> 4)


def _active(sizes: np.ndarray) -> list[int]:
    """How many lanes are still open at each step; sizes must not increase."""
    return np.searchsorted(-sizes, -np.arange(sizes.max(initial=0)), side="left").tolist()


def _by_size(sizes: np.ndarray) -> np.ndarray:
    return np.argsort(-sizes, kind="stable")


def _numbered(ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of rows of ids: each id's number in order of arrival, and which are new; beyond a row's
    size nothing counts."""
    number, new = np.zeros(ids.shape, np.int16), np.zeros(ids.shape, bool)
    steps = ids.shape[1]
    for a in range(0, len(ids) if steps else 0, ROWS):
        some = ids[a : a + ROWS]
        order = np.argsort(some, axis=1, kind="stable")
        order += np.arange(len(some))[:, None] * steps
        order = order.ravel()
        ranked = some.ravel().take(order).reshape(some.shape)
        begins = np.ones(some.shape, bool)
        np.not_equal(ranked[:, 1:], ranked[:, :-1], begins[:, 1:])
        first = order[begins.ravel()]  # where each id of each row is seen first
        new[a : a + ROWS].ravel()[first] = True
        count = np.cumsum(new[a : a + ROWS], 1, np.int16).ravel()
        count -= 1
        number[a : a + ROWS].ravel()[order] = count.take(first).take(np.cumsum(begins.ravel()) - 1)
    new &= np.arange(steps) < sizes[:, None]
    return number, new


class _Writer:
    """Digits of a lane lie in a row of ``out``; ``used`` is where its next one goes."""

    def __init__(self, lanes: int, steps: int):
        self.wide = steps + 2
        self.low, self.span = np.zeros(lanes, np.uint64), np.full(lanes, WHOLE)
        self.out, self.used = np.zeros(lanes * self.wide, np.uint64), np.arange(lanes) * self.wide

    def put(self, n: int, cum: np.ndarray, freq: np.ndarray, total: int) -> None:
        low, span = self.low[:n], self.span[:n]
        r = span // np.uint64(total)
        low += cum.astype(np.uint64) * r
        np.multiply(freq.astype(np.uint64), r, out=span)
        k = np.flatnonzero(span < FLOOR)
        if len(k):
            some, to = low.take(k), self.used.take(k)
            self.out[to] = some >> np.uint64(31)
            self.used[k] = to + 1
            low[k] = (some & np.uint64((1 << 31) - 1)) << np.uint64(32)
            span[k] = span.take(k) << np.uint64(32)

    def digits(self) -> tuple[np.ndarray, np.ndarray]:
        """Each lane's row of digits, and how many it has."""
        for _ in range(2):
            self.out[self.used] = self.low >> np.uint64(31)
            self.used += 1
            self.low = (self.low & np.uint64((1 << 31) - 1)) << np.uint64(32)
        row = (self.used - 1) // self.wide
        used = self.used - row * self.wide
        out = np.ascontiguousarray(self.out.reshape(-1, self.wide)[:, : used.max(initial=0)].T)
        over = np.zeros(len(row), np.uint64)
        for digit in out[::-1]:
            digit += over
            over = digit >> np.uint64(32)
        return out.astype("<u4").T[row], used


class _Reader:
    """The value read so far less the low end of the interval: 63 bits, as the writer's low."""

    def __init__(self, digits: np.ndarray):
        self.digits = digits.ravel()
        self.code = (digits[:, 0].astype(np.uint64) << np.uint64(31)) + (digits[:, 1] >> 1)
        self.spare = digits[:, 1].astype(np.uint64) & np.uint64(1)
        self.used = np.arange(len(digits)) * digits.shape[1] + 2
        self.span = np.full(len(digits), WHOLE)

    def look(self, n: int, total: int) -> np.ndarray:
        self.r = self.span[:n] // np.uint64(total)
        v = (self.code[:n] // self.r).astype(np.int32)
        return np.minimum(v, np.int32(total - 1), out=v)

    def take(self, n: int, cum: np.ndarray, freq: np.ndarray) -> None:
        code, span = self.code[:n], self.span[:n]
        code -= cum.astype(np.uint64) * self.r
        np.multiply(freq.astype(np.uint64), self.r, out=span)
        k = np.flatnonzero(span < FLOOR)
        if len(k):
            at = self.used.take(k)
            new = self.digits.take(at, mode="clip").astype(np.uint64)
            code[k] = (code.take(k) << np.uint64(32)) + (self.spare.take(k) << np.uint64(31)) + (new >> np.uint64(1))
            self.spare[k] = new & np.uint64(1)
            self.used[k] = at + 1
            span[k] = span.take(k) << np.uint64(32)


HEAD = 3  # numbers before a block's digits: ids, distinct ids, crc32 of the digits


def encode_blocks(blocks: list[np.ndarray], vocab: int) -> list[bytes]:
    """Each block of at most MOST ids (0 to vocab - 1) as bytes."""
    if not blocks:
        return []
    sizes = np.array([len(b) for b in blocks], np.int64)
    order = _by_size(sizes)
    sizes, lanes, steps = sizes[order], len(blocks), int(sizes.max(initial=0))
    if steps > MOST:
        raise ValueError(f"a block of {steps} ids; {MOST} is the most")
    ids = np.zeros((lanes, steps), np.uint16 if vocab <= 1 << 16 else np.uint32)
    for k, b in enumerate(order):
        ids[k, : sizes[k]] = blocks[b]
    number, new = _numbered(ids, sizes)
    distinct = new.sum(1)
    w = _Writer(lanes, steps + int(distinct.max(initial=0)))
    # The distinct ids; lanes go by how many they have.
    rank = _by_size(distinct)
    words = np.zeros((lanes, int(distinct.max(initial=0))), ids.dtype)
    words[np.arange(words.shape[1]) < distinct[:, None]] = ids[new]
    del ids, new
    words, prior = np.ascontiguousarray(words[rank].T), _prior(vocab)
    width = np.diff(prior)
    for t, n in enumerate(_active(distinct[rank])):
        word = words[t, :n].astype(np.int64)
        run = word // RUN
        freq = width.take(run)
        w.put(n, prior.take(run) * RUN + word % RUN * freq, freq, RUN << PRIOR_BITS)
    for x in (w.low, w.span, w.used):
        x[rank] = x.copy()
    m, number = _Model(lanes, int(distinct.max(initial=0)), steps), np.ascontiguousarray(number.T)
    for t, n in enumerate(_active(sizes)):
        x = number[t, :n]
        m.look(n, t)
        at = x.astype(np.int64)
        at *= lanes
        at += m.lane[:n]
        hit1, hit2 = x == m.p1, x == m.p2
        cum, freq = m.interval(at, x < m.known[:n], hit1 & (m.w1 > 0), hit2 & (m.w2 > 0))
        w.put(n, cum, freq, UNIT * m.total)
        m.learn(x, at, hit1, hit2, n)
    (digits, used), done = w.digits(), [b""] * lanes
    for k, b in enumerate(order):
        body = digits[k, : used[k]].tobytes() if sizes[k] else b""
        done[b] = np.array([sizes[k], distinct[k], zlib.crc32(body)], "<u4").tobytes() + body
    return done


def decode_blocks(blocks: list[bytes], vocab: int) -> list[np.ndarray]:
    """The ids of each block; :class:`CorruptBlock` where a checksum does not hold."""
    if not blocks:
        return []
    heads = [np.frombuffer(b, "<u4", HEAD) for b in blocks if len(b) >= 4 * HEAD]
    if len(heads) < len(blocks) or any(zlib.crc32(b[4 * HEAD :]) != h[2] for b, h in zip(blocks, heads, strict=True)):
        raise CorruptBlock("checksum of a block")
    sizes, distinct = np.array(heads, np.int64)[:, :2].T
    order = _by_size(sizes)
    sizes, distinct, lanes, steps = sizes[order], distinct[order], len(blocks), int(sizes.max(initial=0))
    if steps > MOST or (distinct > sizes).any():
        raise CorruptBlock("length of a block")
    rank, prior = _by_size(distinct), _prior(vocab)
    digits = np.zeros((lanes, max(len(b) // 4 for b in blocks) - HEAD + 2), np.uint32)
    for k, b in enumerate(order[rank]):
        got = np.frombuffer(blocks[b], "<u4")[HEAD:]
        digits[k, : len(got)] = got
    r, most = _Reader(digits), int(distinct.max(initial=0))
    del digits
    words = np.zeros((most, lanes), np.uint32)
    width, run_of = np.diff(prior), np.repeat(np.arange(len(prior) - 1), np.diff(prior))
    for t, n in enumerate(_active(distinct[rank])):
        v = r.look(n, RUN << PRIOR_BITS)
        run = run_of.take(v // RUN)
        freq, low = width.take(run), prior.take(run) * RUN
        inner = (v - low) // freq
        words[t, :n] = run * RUN + inner
        r.take(n, low + inner * freq, freq)
    for x in (r.code, r.span, r.spare, r.used):
        x[rank] = x.copy()
    words[:, rank] = words.copy()
    ids, words = np.zeros((steps, lanes), np.uint32), words.ravel()
    m = _Model(lanes, most, steps)
    for t, n in enumerate(_active(sizes)):
        m.look(n, t)
        v, known = r.look(n, UNIT * m.total), m.known[:n]
        inner = np.maximum(v - m.top1, 0)
        inner //= m.rest
        inner -= m.fresh[:n]
        two, one = v < m.top2, v < m.top1
        some = np.flatnonzero((inner >= 0) & ~one)
        one &= ~two
        x = known.copy()
        x[some] = m.find(inner.astype(np.int16).take(some), some) // lanes
        np.copyto(x, m.p1, where=one)
        np.copyto(x, m.p2, where=two)
        at = x.astype(np.int64)
        at *= lanes
        at += m.lane[:n]
        cum, freq = m.interval(at, x < known, one, two)
        r.take(n, cum, freq)
        ids[t, :n] = words.take(at, mode="clip")
        m.learn(x, at, x == m.p1, x == m.p2, n)
    ids, done = np.ascontiguousarray(ids.T), [np.zeros(0, np.uint32)] * lanes
    for k, b in enumerate(order):
        done[b] = ids[k, : sizes[k]]
    return done
