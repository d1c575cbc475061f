"""Operator 13: phrases whose words stick together, counted in quotient filters.

1. Each task numbers the words of some texts; a *chunk* is those texts as word numbers, with a 0
   where no phrase may reach over. Words are counted, and the frequent ones get an id.
2. A chunk's distinct words meet the ids in a join, so no vocabulary is ever sent out whole.
3. For phrases of two words, then three, then four: a phrase is its ids packed into one whole
   number, and an invertible permutation of such numbers spreads them evenly. The upper bits of
   the permuted number are the *quotient*, the rest the *remainder*, kept in full. A task's
   counting quotient filter holds remainders sorted by quotient, how many each quotient has,
   and a count each: nothing is lost, and a quotient costs no bits of its own.
4. Filters are cut by quotient and merged, a range of quotients a task. Phrases that are frequent
   come back as ids through the inverse permutation.
5. Cuts, scores and the phrases that are parts of others are joins of what is frequent.

A phrase is frequent only if both phrases of one word less within it are. Those found are
marked in a bit table, which goes to the tasks and is of a bounded size: a mark that two phrases
share costs work and no more.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from .common import materialize, release
from .terms import Runs, numbered, small_batches

MAX_WORDS = 4
GATHER = 1_500_000  # phrases that a task holds before it adds equal ones up
SEGMENT = 1_000_000  # phrases of the corpus for each range of quotients
BITS_MOST = 1 << 27  # of a bit table: 16 MB

BREAK = np.zeros(256, bool)
BREAK[list(b".,;:!?\n\x0b\x0c\r")] = True
WORD = ~BREAK
WORD[[0x20, 0x09]] = False

CHUNK = "chunk long, lang string, words array<string>, counts array<long>, codes binary"


def _pack_codes(codes: np.ndarray) -> bytes:
    return zlib.compress(codes.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def _codes(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(data), np.uint8)
    return np.ascontiguousarray(planes.reshape(4, -1).T).view("<u4")[:, 0] if len(planes) else np.zeros(0, np.uint32)


def chunks(rows: DataFrame) -> DataFrame:
    """Texts as numbers of their words, from 1 on within the chunk; 0 between pieces and texts.
    A chunk is of one language. Its number comes from the task's and is only used once
    the table is written."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in small_batches(batches, 1):
            langs, lang = numbered(batch.column(0))
            for k, name in enumerate(langs.to_pylist()):
                own = batch.filter(pa.array(lang == k)) if len(langs) > 1 else batch
                runs = Runs(own.column(1), WORD)
                piece = np.append(0, np.cumsum(BREAK[runs.raw]))[runs.start]
                apart = np.append(False, (np.diff(piece) > 0) | (np.diff(runs.row) > 0))[: len(runs.code)]
                codes = np.zeros(len(runs.code) + apart.sum(), np.uint32)
                codes[np.arange(len(runs.code)) + np.cumsum(apart)] = runs.code + 1
                counts = np.bincount(runs.code, minlength=len(runs.words))
                one = [pa.array([number], pa.int64()), pa.array([name]), _list(runs.words), _list(pa.array(counts, pa.int64())), pa.array([_pack_codes(codes)])]
                yield pa.RecordBatch.from_arrays(one, names=["chunk", "lang", "words", "counts", "codes"])
                number += 1

    return rows.mapInArrow(cut, CHUNK)


def _list(values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def frequent_words(cut: DataFrame, least: int) -> DataFrame:
    """``lang, word, n, id``: ids from 1 on, over all languages. Words are dealt out by range and
    numbered within; each task's numbers begin after those of the tasks before."""
    seen = Observation()
    words = cut.select("lang", F.explode(F.arrays_zip("words", "counts")).alias("w")).groupBy("lang", F.col("w.words").alias("word")).agg(F.sum("w.counts").alias("n"))
    words = materialize(words.where(F.col("n") >= least).observe(seen, F.count(F.lit(1)).alias("n")), "words")
    parts = max(1, -(-seen.get["n"] // 500_000))
    part = words.repartitionByRange(parts, "lang", "word").withColumn("part", F.spark_partition_id())
    part = materialize(part.withColumn("at", F.row_number().over(Window.partitionBy("part").orderBy("lang", "word"))), "words")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # over a row for each part
    sizes = part.groupBy("part").agg(F.count("*").alias("size")).select("part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("before"))
    return materialize(part.join(F.broadcast(sizes), "part").select("lang", "word", "n", (F.col("at") + F.col("before")).alias("id")), "words")


def with_ids(cut: DataFrame, words: DataFrame) -> DataFrame:
    """``codes, ids``: the chunks, and the ids of those of their words that are frequent, as pairs."""
    distinct = cut.select("chunk", "lang", F.posexplode("words").alias("at", "word"))
    met = distinct.join(words.select("lang", "word", "id"), ["lang", "word"])
    met = met.groupBy("chunk").agg(F.collect_list(F.struct((F.col("at") + 1).alias("code"), "id")).alias("ids"))
    return cut.select("chunk", "codes").join(met, "chunk").drop("chunk")


def _mix(x: np.ndarray, k: int) -> np.ndarray:
    """A hash of 64-bit numbers."""
    x = x + np.uint64(0x9E3779B97F4A7C15 * k & (1 << 64) - 1)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Permuted:
    """Phrases of ``n`` ids of ``width`` bits, permuted: ``n * width`` bits in an upper and a lower
    half of up to 64 bits. Each round adds to one half a hash of the other without carry,
    so the rounds in reverse undo them."""

    def __init__(self, n: int, width: int):
        self.n, self.width = n, width
        self.bits = n * width
        if self.bits > 128:
            raise ValueError(f"{n} ids of {width} bits do not fit 128 bits")
        self.low = self.bits // 2
        self.masks = [np.uint64((1 << k) - 1) for k in (self.bits - self.low, self.low)]

    def _rounds(self, upper: np.ndarray, lower: np.ndarray, order) -> tuple[np.ndarray, np.ndarray]:
        for k in order:
            if k % 2:
                upper = upper ^ (_mix(lower, k) & self.masks[0])
            else:
                lower = lower ^ (_mix(upper, k) & self.masks[1])
        return upper, lower

    def of(self, ids: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        upper, lower = np.zeros(len(ids[0]), np.uint64), np.zeros(len(ids[0]), np.uint64)
        for k, x in enumerate(ids):
            self._put(upper, lower, x.astype(np.uint64), self.bits - (k + 1) * self.width)
        return self._rounds(upper, lower, (1, 2, 3))

    def _put(self, upper, lower, x, at: int) -> None:
        """Add ``x`` at ``at`` bits from the right."""
        if at >= self.low:
            upper |= x << np.uint64(at - self.low)
            return
        lower |= (x << np.uint64(at)) & self.masks[1]
        if at + self.width > self.low:
            upper |= x >> np.uint64(self.low - at)

    def ids(self, upper: np.ndarray, lower: np.ndarray) -> list[np.ndarray]:
        upper, lower = self._rounds(upper, lower, (3, 2, 1))
        mask, out = np.uint64((1 << self.width) - 1), []
        for k in range(self.n):
            at = self.bits - (k + 1) * self.width
            if at >= self.low:
                out.append((upper >> np.uint64(at - self.low)) & mask)
            elif at + self.width > self.low:
                out.append(((lower >> np.uint64(at)) | (upper << np.uint64(self.low - at))) & mask)
            else:
                out.append((lower >> np.uint64(at)) & mask)
        return out


def summed(upper: np.ndarray, lower: np.ndarray, counts: np.ndarray, low: int, bits: int):
    """Equal phrases added up, in order of their permuted numbers."""
    if not len(upper):
        return upper, lower, counts
    if bits <= 64:
        whole = (upper << np.uint64(low)) | lower
        order = np.argsort(whole, kind="stable")  # merges what is sorted in stretches
    else:
        order = np.lexsort((lower, upper))
    upper, lower, counts = upper[order], lower[order], counts[order]
    first = np.append(True, (np.diff(upper) != 0) | (np.diff(lower) != 0))
    return upper[first], lower[first], np.add.reduceat(counts, np.flatnonzero(first))


class Filter:
    """A counting quotient filter, or what a range of quotients has of one, as bytes: how many
    remainders each quotient has, remainders in full, counts. Numbers are stored by
    planes of bytes, as many as the largest needs."""

    @staticmethod
    def _planes(x: np.ndarray, size: int) -> bytes:
        return np.ascontiguousarray(x.astype("<u8")[:, None].view(np.uint8).reshape(-1, 8).T[:size]).tobytes()

    @staticmethod
    def _number(data: bytes, at: int, n: int, size: int) -> tuple[np.ndarray, int]:
        out = np.zeros((n, 8), np.uint8)
        out[:, :size] = np.frombuffer(data, np.uint8, n * size, at).reshape(size, n).T
        return out.view("<u8")[:, 0], at + n * size

    @staticmethod
    def pack(upper: np.ndarray, lower: np.ndarray, counts: np.ndarray, above: int, rest: int, low: int) -> bytes:
        """Sorted phrases that share all but ``above`` of the quotient's bits and have ``rest`` bits
        of ``upper`` in the remainder."""
        runs = np.bincount((upper >> np.uint64(rest)).astype(np.int64) & ((1 << above) - 1), minlength=1 << above).astype(np.uint64)
        sizes = [max(1, -(-int(x.max()).bit_length() // 8)) for x in (runs, counts)]
        halves = [-(-rest // 8), -(-low // 8)]
        head = np.array([len(upper), above, rest, *sizes], "<u4").tobytes()
        kept = upper & np.uint64((1 << rest) - 1)
        return head + Filter._planes(runs, sizes[0]) + Filter._planes(kept, halves[0]) + Filter._planes(lower, halves[1]) + Filter._planes(counts, sizes[1])

    @staticmethod
    def unpack(data: bytes, segment: int, low: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n, above, rest, *sizes = (int(x) for x in np.frombuffer(data, "<u4", 5))
        runs, at = Filter._number(data, 20, 1 << above, sizes[0])
        kept, at = Filter._number(data, at, n, -(-rest // 8))
        lower, at = Filter._number(data, at, n, -(-low // 8))
        counts, at = Filter._number(data, at, n, sizes[1])
        quotient = np.repeat(np.arange(1 << above, dtype=np.uint64), runs.astype(np.int64))
        return (np.uint64(segment << above) | quotient) << np.uint64(rest) | kept, lower, counts


def _segments(upper: np.ndarray, lower: np.ndarray, counts: np.ndarray, cut: int, perm: Permuted) -> pa.RecordBatch:
    """A task's filter, cut by the first ``cut`` bits of the quotient; about two phrases a quotient."""
    high = perm.bits - perm.low
    above = min(max(0, int(len(upper) >> cut).bit_length() - 1), high - cut)
    rest = high - cut - above
    edges = np.append(np.searchsorted(upper, np.arange(1 << cut, dtype=np.uint64) << np.uint64(high - cut)), len(upper))
    some = [k for k in range(1 << cut) if edges[k] < edges[k + 1]]
    blobs = [Filter.pack(*(x[edges[k] : edges[k + 1]] for x in (upper, lower, counts)), above, rest, perm.low) for k in some]
    return pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(blobs, pa.binary())], names=["segment", "filter"])


def _marked(table: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> np.ndarray:
    """Which phrases have both their bits in a table."""
    bits, found = len(table) * 64 - 1, np.ones(len(upper), bool)
    for k in (1, 2):
        at = _mix(upper ^ _mix(lower, 7), 10 + k) & np.uint64(bits)
        found &= (table[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) > 0
    return found


def _marks(upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, ...]:
    """The places of a phrase's two bits in the largest table; smaller ones take them modulo."""
    return tuple((_mix(upper ^ _mix(lower, 7), 10 + k) & np.uint64(BITS_MOST - 1)).astype(np.int64) for k in (1, 2))


def frequent_phrases(coded: DataFrame, n: int, width: int, least: int, cut: int, parts: tuple | None) -> DataFrame:
    """``ids, n, marks`` of the phrases of ``n`` words that occur ``least`` times or more. ``parts``
    is the broadcast bit table of the frequent phrases of one word less, and None for two words."""
    perm, shorter = Permuted(n, width), Permuted(n - 1, width)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        table = parts.value if parts is not None else None
        for batch in batches:
            for codes, ids in zip(batch.column(0), batch.column(1)):
                codes = _codes(codes.as_py())
                code, its = (ids.values.field(k).to_numpy() for k in (0, 1))
                known = np.zeros(int(max(codes.max(initial=0), code.max(initial=0))) + 1, np.uint32)
                known[code] = its
                seq = known[codes]
                if n > 2:
                    good = _windows(seq, n - 1)
                    good = good[_marked(table, *shorter.of([seq[good + k] for k in range(n - 1)]))]
                    at = good[:-1][np.diff(good) == 1]  # both the first and the last n - 1 words
                else:
                    at = _windows(seq, 2)
                upper, lower = perm.of([seq[at + k] for k in range(n)])
                held.append(summed(upper, lower, np.ones(len(upper), np.uint64), perm.low, perm.bits))
                size += len(held[-1][0])
                if size > GATHER:
                    held = [summed(*map(np.concatenate, zip(*held)), perm.low, perm.bits)]
                    size = len(held[0][0])
                    if size > GATHER // 2:
                        yield _segments(*held[0], cut, perm)
                        held, size = [], 0
        if size:
            yield _segments(*summed(*map(np.concatenate, zip(*held)), perm.low, perm.bits), cut, perm)
        release()

    def merge(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        found = [Filter.unpack(x.as_py(), key[0].as_py(), perm.low) for x in table["filter"]]
        upper, lower, counts = summed(*map(np.concatenate, zip(*found)), perm.low, perm.bits)
        often = counts >= least
        upper, lower, counts = upper[often], lower[often], counts[often]
        ids = np.stack(perm.ids(upper, lower), axis=1).astype(np.int64) if len(upper) else np.zeros((0, n), np.int64)
        marks = np.stack(_marks(upper, lower), axis=1) if len(upper) else np.zeros((0, 2), np.int64)
        return pa.table({k: _lists(v) for k, v in (("ids", ids), ("marks", marks))} | {"n": pa.array(counts.astype(np.int64))})

    counted = coded.mapInArrow(count, "segment long, filter binary")
    return counted.groupBy("segment").applyInArrow(merge, "ids array<long>, marks array<long>, n long")


def _lists(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.reshape(-1)))


def _windows(seq: np.ndarray, n: int) -> np.ndarray:
    """Where ``n`` ids follow each other without a 0."""
    bad = np.append(0, np.cumsum(seq == 0))
    return np.flatnonzero(bad[n:] == bad[:-n]) if len(seq) >= n else np.zeros(0, np.int64)


def _bit_table(found: DataFrame, count: int) -> np.ndarray:
    """Sixteen bits for each phrase, between a thousand and :data:`BITS_MOST` in all; words of it are
    put together on Spark."""
    bits = min(BITS_MOST, max(1024, 1 << (16 * max(count, 1) - 1).bit_length()))
    at = found.select(F.explode("marks").alias("at")).select(F.col("at").bitwiseAND(bits - 1).alias("at"))
    words = at.groupBy(F.shiftright("at", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits")).toArrow()
    table = np.zeros(bits // 64, np.uint64)
    table[words["word"].to_numpy()] = words["bits"].to_numpy().view(np.uint64)
    return table


def _cut_scores(found: DataFrame, freq: DataFrame, scale: int) -> DataFrame:
    """``ids, a, l, r, score`` of each candidate by its lowest cut. Frequencies are the unique side
    of both joins, so Spark can split the candidates that begin or end alike."""
    cuts = found.withColumn("k", F.explode(F.sequence(F.lit(1), F.size("ids") - 1)))
    cuts = cuts.select("ids", F.col("n").alias("a"), "k", F.expr("slice(ids, 1, k)").alias("first"), F.expr("slice(ids, k + 1, size(ids) - k)").alias("rest"))
    cuts = cuts.join(freq.select(F.col("ids").alias("first"), F.col("n").alias("l")), "first")
    cuts = cuts.join(freq.select(F.col("ids").alias("rest"), F.col("n").alias("r")), "rest")
    score = F.expr(f"(cast({scale} as decimal(10,0)) * cast(a as decimal(20,0))) div (cast(l as decimal(20,0)) + cast(r as decimal(20,0)))")
    best = cuts.withColumn("score", score).groupBy("ids", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("c"))
    return best.select("ids", "a", "c.l", "c.r", "c.score")


def _parts(longer: DataFrame) -> DataFrame:
    """The frequency of the most frequent longer phrase around each phrase of two or more words."""
    inner = F.expr("flatten(transform(sequence(2, size(ids) - 1), m -> transform(sequence(1, size(ids) - m + 1), i -> slice(ids, i, m))))")
    return longer.where(F.size("ids") > 2).select(F.explode(inner).alias("ids"), "n").groupBy("ids").agg(F.max("n").alias("around"))


def collocations(docs: DataFrame, least: int = 30, cover: int = 80, top: int = 2000, scale: int = 2_000_000, lang_col="lang", text_col="text") -> DataFrame:
    """``lang, rank, phrase, a, l, r, n, score``: each language's ``top`` phrases of two to four words.

    Texts are cut at ``.,;:!?`` and line ends and into words at spaces and tabs; A-Z count as a-z.
    Candidates occur ``a >= least`` times, overlaps included; ``l`` and ``r`` are the occurrences
    of the two parts at the cut with the lowest ``score``, ``scale * a / (l + r)`` rounded down
    (the first of equal ones); ``n`` is all words of the language. A candidate inside a longer
    one that occurs at least ``cover`` percent as often is dropped. Order: score, a, then phrase
    by UTF-8 bytes.

    A null text is empty, a null language is ``und``; repeated rows and rows that share an id
    count each; very long texts are whole, one at a time; other columns play no part; an
    empty table gives an empty one."""
    lang = F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und")).alias("lang")
    cut = materialize(chunks(docs.select(lang, F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))), "chunks")
    sizes = materialize(cut.select("lang", F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x).alias("n")).groupBy("lang").agg(F.sum("n").alias("n")), "sizes")
    words = frequent_words(cut, least)
    largest, total = words.agg(F.max("id")).first()[0] or 1, sizes.agg(F.sum("n")).first()[0] or 0
    width, cut_bits = largest.bit_length(), max(0, (total // SEGMENT).bit_length())
    coded = materialize(with_ids(cut, words), "coded")

    spark, levels, table = docs.sparkSession, [], None
    for n in range(2, MAX_WORDS + 1):
        seen = Observation()
        bits = min(cut_bits, Permuted(n, width).bits - Permuted(n, width).low)
        found = frequent_phrases(coded, n, width, least, bits, table)
        found = materialize(found.observe(seen, F.count(F.lit(1)).alias("n")), "phrases")
        levels.append(found.select("ids", "n"))
        if table is not None:
            table.unpersist()
        if n < MAX_WORDS:
            table = spark.sparkContext.broadcast(_bit_table(found, seen.get["n"]))
    found = levels[0].unionByName(levels[1]).unionByName(levels[2])
    freq = found.unionByName(words.select(F.array("id").alias("ids"), "n"))

    scored = _cut_scores(found, freq, scale).join(_parts(found), "ids", "left")
    scored = scored.where(F.col("around").isNull() | (F.col("around").cast("decimal(20,0)") * 100 < F.col("a").cast("decimal(20,0)") * cover))
    # The language of a phrase is that of its words.
    named = scored.withColumn("word", F.col("ids")[0]).join(words.select(F.col("id").alias("word"), "lang"), "word").drop("word")
    by = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"))
    some = materialize(named.withColumn("at", F.rank().over(by)).where(F.col("at") <= top).drop("at"), "scored")  # with all ties of the last
    spelled = some.select("ids", F.posexplode("ids").alias("at", "id")).join(words.select("id", "word"), "id")
    spelled = spelled.groupBy("ids").agg(_joined(F.sort_array(F.collect_list(F.struct("at", "word")))).alias("phrase"))
    last = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = some.join(spelled, "ids").withColumn("rank", F.row_number().over(last).cast("long")).where(F.col("rank") <= top)
    return ranked.join(sizes, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def _joined(words: Column) -> Column:
    return F.array_join(F.transform(words, lambda w: w.word), " ")
