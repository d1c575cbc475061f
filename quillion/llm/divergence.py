"""Operator 12: how far the sources of a language are from each other and from it.

The terms that enough documents of a language have are its vocabulary. Sorted, they are built
into minimal acyclic transducers: arcs carry numbers whose sum along a term is its ordinal, its
place among all terms of the language. Texts are counted again through the transducers, and
from there on a term is its ordinal, which also breaks ties; terms come back for the rows that
are returned. A transducer covers at most :data:`SHARD` terms; they are built in parallel
and go to the tasks in blocks of at most :data:`BLOCK_BYTES`, one block after another.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from .common import materialize
from .terms import Runs, numbered, small_batches

SHARD = 50_000  # terms of one transducer
BLOCK_BYTES = 32 << 20  # transducers that are broadcast together
CELL, SOURCES = 4096, 128  # ordinals and sources that one task compares
UNIT = 1_000_000_000  # what probabilities are counted in
ALPHA = 5  # added to each count

#: ASCII letters, and all that is not ASCII.
TERM = np.zeros(256, bool)
TERM[65:91] = TERM[97:123] = TERM[128:] = True


class Transducer:
    """Ordinals of sorted terms by a minimal acyclic automaton.

    States are merged as the sorted terms go in: once a term leaves a prefix, what hangs below
    it is final and is replaced by an equal state if there is one. The arc to a child carries
    the number of terms that end at this state or leave it by an earlier arc."""

    def __init__(self, keys: np.ndarray, to: np.ndarray, out: np.ndarray, final: np.ndarray):
        self.keys, self.to, self.out, self.final = keys, to, out, final

    @staticmethod
    def build(terms: list[bytes]) -> Transducer:
        """From distinct terms in byte order."""
        known: dict[tuple, int] = {}
        counts: list[int] = []
        path: list[tuple[bool, list]] = [(False, [])]

        def freeze() -> int:
            final, arcs = path.pop()
            state = known.setdefault((final, tuple(arcs)), len(known))
            if state == len(counts):
                counts.append(final + sum(counts[child] for _, child in arcs))
            return state

        def leave(before: bytes, depth: int) -> None:
            while len(path) > depth + 1:
                label = before[len(path) - 2]
                state = freeze()
                path[-1][1].append((label, state))

        before = b""
        for term in terms:
            shared = next((k for k, (a, b) in enumerate(zip(before, term)) if a != b), min(len(before), len(term)))
            leave(before, shared)
            path += [(False, []) for _ in term[shared:]]
            path[-1] = (True, path[-1][1])
            before = term
        leave(before, 0)
        freeze()  # the root, the last state
        keys, to, out = [], [], []
        for (final, arcs), state in known.items():
            earlier = int(final)
            for label, child in arcs:
                keys.append(state * 256 + label)
                to.append(child)
                out.append(earlier)
                earlier += counts[child]
        return Transducer(np.array(keys, np.int64), np.array(to, np.int32), np.array(out, np.int32), np.array([final for final, _ in known], np.uint8))

    def pack(self) -> bytes:
        return struct.pack("<qq", len(self.keys), len(self.final)) + b"".join(x.tobytes() for x in (self.keys, self.to, self.out, self.final))

    @staticmethod
    def unpack(data: bytes) -> Transducer:
        arcs, states = struct.unpack_from("<qq", data)
        parts, at = [], 16
        for n, kind in ((arcs, np.int64), (arcs, np.int32), (arcs, np.int32), (states, np.uint8)):
            parts.append(np.frombuffer(data, kind, n, at))
            at += n * np.dtype(kind).itemsize
        return Transducer(*parts)

    def ordinals(self, words: pa.Array) -> np.ndarray:
        """The ordinal of each word, -1 for those that are no terms. All words walk abreast, a
        byte a step, until they end or find no arc."""
        found = np.full(len(words), -1, np.int64)
        offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
        data = np.frombuffer(words.buffers()[2], np.uint8) if words.buffers()[2] is not None else np.zeros(0, np.uint8)
        at, end, who = offsets[:-1], offsets[1:], np.arange(len(words))
        state, total = np.full(len(words), len(self.final) - 1), np.zeros(len(words), np.int64)
        while len(who):
            done = at == end
            ended = done & (self.final[state] > 0)
            found[who[ended]] = total[ended]
            going = ~done
            at, end, who, state, total = (x[going] for x in (at, end, who, state, total))
            if not len(who) or not len(self.keys):
                break
            key = state * 256 + data[at]
            arc = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = self.keys[arc] == key
            arc, at, end, who = arc[hit], at[hit] + 1, end[hit], who[hit]
            state, total = self.to[arc].astype(np.int64), total[hit] + self.out[arc]
        return found


def _rows(docs: DataFrame, lang_col: str, source_col: str, text_col: str) -> DataFrame:
    return docs.select(*(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(a) for c, a in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))))


def kept_terms(rows: DataFrame, min_docs: int) -> DataFrame:
    """``lang, term`` of the terms that at least ``min_docs`` rows of the language have. Each task
    counts the distinct terms of some texts together; Spark adds the counts before it
    shuffles them."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 1):
            langs, lang = numbered(batch.column(0))
            runs = Runs(batch.column(1), TERM)
            words = max(len(runs.words), 1)
            once = np.unique(runs.row * words + runs.code)
            pair, n = np.unique(lang[once // words] * words + once % words, return_counts=True)
            yield pa.RecordBatch.from_arrays([langs.take(pa.array(pair // words)), runs.words.take(pa.array(pair % words)), pa.array(n)], names=["lang", "term", "n"])

    counted = rows.select("lang", "text").mapInArrow(count, "lang string, term string, n long")
    return counted.groupBy("lang", "term").agg(F.sum("n").alias("n")).where(F.col("n") >= min_docs).select("lang", "term")


def vocabulary(kept: DataFrame) -> DataFrame:
    """``lang, base, n, terms, transducer, block``: the transducers, each for ``n`` consecutive
    terms of a language from ordinal ``base`` on. The terms are range-sorted, so each
    task has a stretch of them; numbers before a stretch come from a row for each transducer."""
    seen = Observation()
    kept = materialize(kept.observe(seen, F.count(F.lit(1)).alias("n")), "terms")
    parts = max(1, -(-seen.get["n"] // SHARD))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done() -> pa.RecordBatch:
            blob = Transducer.build(terms).pack()
            columns = [pa.array([lang]), pa.array([terms[0].decode()]), pa.array([len(terms)], pa.int64()), pa.array([[t.decode() for t in terms]], pa.list_(pa.string())), pa.array([blob])]
            return pa.RecordBatch.from_arrays(columns, names=["lang", "first", "n", "terms", "transducer"])

        lang, terms = None, []
        for batch in batches:
            for its, term in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                if terms and (its != lang or len(terms) == SHARD):
                    yield done()
                    terms = []
                lang = its
                terms.append(term)
        if terms:
            yield done()

    order = kept.repartitionByRange(parts, "lang", "term").sortWithinPartitions("lang", "term")
    shards = materialize(order.mapInArrow(build, "lang string, first string, n long, terms array<string>, transducer binary"), "transducers")
    before = Window.orderBy("lang", "first").rowsBetween(Window.unboundedPreceding, -1)  # over a row for each transducer
    places = shards.select("lang", "first", "n", F.octet_length("transducer").alias("size")).select(
        "lang", "first", F.coalesce(F.sum("n").over(before.partitionBy("lang")), F.lit(0)).alias("base"),
        F.floor(F.coalesce(F.sum("size").over(before), F.lit(0)) / BLOCK_BYTES).alias("block"),
    )
    return materialize(shards.join(places, ["lang", "first"]).drop("first"), "vocabulary")


def term_counts(rows: DataFrame, words: DataFrame) -> DataFrame:
    """``lang, source, ord, n``: occurrences of kept terms in each group; a row with ``ord`` -1 and
    ``n`` 0 for every group. Texts go through the transducers of one block after another; the
    distinct words of some texts walk once each."""
    spark, out = rows.sparkSession, None
    blocks = words.agg(F.max("block")).first()[0]
    for block in range((blocks or 0) + 1):
        loaded: dict[str, list] = {}
        for x in words.where(F.col("block") == block).select("lang", "base", "transducer").collect():  # at most BLOCK_BYTES and one more
            loaded.setdefault(x.lang, []).append((x.base, bytes(x.transducer)))
        sent = spark.sparkContext.broadcast(loaded)
        got = materialize(rows.mapInArrow(_recount(sent), "lang string, source string, ord long, n long").groupBy("lang", "source", "ord").agg(F.sum("n").alias("n")), "counts")
        sent.unpersist()
        out = got if out is None else out.unionByName(got)
    return out.distinct() if blocks else out  # each block has the row of a group


def _recount(sent):
    def recount(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = {lang: [(base, Transducer.unpack(x)) for base, x in found] for lang, found in sent.value.items()}
        for batch in small_batches(batches, 2):
            langs, lang = numbered(batch.column(0))
            sources, source = numbered(batch.column(1))
            group = lang * len(sources) + source
            runs = Runs(batch.column(2), TERM)
            words = max(len(runs.words), 1)
            pair, n = np.unique(group[runs.row] * words + runs.code, return_counts=True)
            its_group, its_word = pair // words, pair % words
            names = [langs.take(pa.array(its_group // len(sources))), sources.take(pa.array(its_group % len(sources)))]
            ordinal = np.full(len(pair), -1, np.int64)
            for k, name in enumerate(langs.to_pylist()):
                own = np.flatnonzero(its_group // len(sources) == k)
                for base, transducer in ready.get(name, ()) if len(own) else ():
                    distinct, where = np.unique(its_word[own], return_inverse=True)
                    found = transducer.ordinals(runs.words.take(pa.array(distinct)))[where]
                    ordinal[own] = np.where(found >= 0, found + base, ordinal[own])
            kept = pa.array(ordinal >= 0)
            here = np.unique(group)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.concat_arrays([names[0].filter(kept), langs.take(pa.array(here // len(sources)))]),
                    pa.concat_arrays([names[1].filter(kept), sources.take(pa.array(here % len(sources)))]),
                    pa.array(np.append(ordinal[ordinal >= 0], np.full(len(here), -1))), pa.array(np.append(n[ordinal >= 0], np.zeros(len(here), np.int64))),
                ],
                names=["lang", "source", "ord", "n"],
            )

    return recount


def _probability(n: str) -> str:
    """In units of a :data:`UNIT`-th, by decimals, since products may pass 64 bits."""
    return f"1 + (cast({UNIT} as decimal(10,0)) * (cast({n} as decimal(20,0)) + {ALPHA})) div nullif(cast(total as decimal(20,0)) + {ALPHA} * cast(v as decimal(20,0)), 0)"


def _compare(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """Sums over a cell of ordinals of the differences between its sources, two blocks of them."""
    lang, cell, one, other = (k.as_py() for k in key)
    width = max(0, min(CELL, table["v"][0].as_py() - cell * CELL))
    names, source = numbered(table["source"].combine_chunks())
    block, ord_, p = np.zeros(len(names), np.int64), table["ord"].to_numpy(), table["p"].to_numpy()
    block[source] = table["own"].to_numpy()
    grid = np.zeros((len(names), width), np.int64)
    if width:
        unseen = ord_ < 0
        grid[source[unseen]] = p[unseen, None]
        grid[source[~unseen], ord_[~unseen] - cell * CELL] = p[~unseen]
    a, b = np.flatnonzero(block == one), np.flatnonzero(block == other)
    first, second, value = [], [], []
    for i in a:
        gap = np.abs(grid[b] - grid[i]).sum(axis=1)
        there = b != i
        first.append(np.full(there.sum(), i))
        second.append(b[there])
        value.append(gap[there])
    if not first:
        return pa.table({"lang": pa.array([], pa.string()), "source": pa.array([], pa.string()), "item": pa.array([], pa.string()), "value": pa.array([], pa.int64())})
    first, second, value = np.concatenate(first), np.concatenate(second), np.concatenate(value)
    if one != other:
        first, second, value = np.append(first, second), np.append(second, first), np.append(value, value)
    return pa.table({"lang": pa.array([lang] * len(first), pa.string()), "source": names.take(pa.array(first)), "item": names.take(pa.array(second)), "value": pa.array(value, pa.int64())})


def source_divergence(docs: DataFrame, min_docs: int = 30, top: int = 50, lang_col="lang", source_col="source", text_col="text") -> DataFrame:
    """``lang, source, part, item, value, rank`` for each source of each language.

    Part ``pair``: the other sources, by the summed difference of smoothed term probabilities, all
    of them. Part ``term``: the ``top`` terms that the source has more of than the language.
    Probabilities are whole numbers of 1/1,000,000,000 from add-5 counts of the language's kept
    terms, those that ``min_docs`` of its rows have. Ties go by UTF-8 order.

    Null text, language and source are empty strings; an empty text still makes its group occur;
    repeated rows, and rows that share an id, count each; a language without kept terms has
    pairs of value 0 and no terms. Very long texts are whole, one at a time. Columns other than
    the three play no part; an empty table gives an empty one.

    Tasks compare :data:`SOURCES` sources with as many over :data:`CELL` ordinals, so a language
    that holds all rows is dealt out as well."""
    rows = _rows(docs, lang_col, source_col, text_col)
    words = vocabulary(kept_terms(rows, min_docs))
    counts = materialize(term_counts(rows, words), "counts")
    sizes = words.groupBy("lang").agg(F.sum("n").alias("v"))
    group = counts.groupBy("lang", "source").agg(F.sum("n").alias("total")).join(sizes, "lang", "left").withColumn("v", F.coalesce("v", F.lit(0)))
    own = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    group = group.withColumn("own", F.floor(own / SOURCES)).withColumn("blocks", F.max("own").over(Window.partitionBy("lang")) + 1)
    group = materialize(group.withColumn("unseen", F.expr(_probability("0"))), "groups")
    seen = counts.where("ord >= 0").join(group, ["lang", "source"]).withColumn("p", F.expr(_probability("n")))

    cells = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(F.col("v") / CELL) - 1, F.lit(0)).cast("long")))
    columns = ["lang", "source", "own", "blocks", "v", "cell", "ord", "p"]
    base = group.withColumn("cell", cells).withColumn("ord", F.lit(-1).cast("long")).withColumnRenamed("unseen", "p").select(*columns)
    met = seen.withColumn("cell", F.expr(f"ord div {CELL}")).select(*columns).unionByName(base)
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    met = met.withColumns({"one": F.least("own", "other"), "two": F.greatest("own", "other")}).select("lang", "cell", "one", "two", "source", "own", "v", "ord", "p")
    pair = met.groupBy("lang", "cell", "one", "two").applyInArrow(_compare, "lang string, source string, item string, value long")
    pair = pair.groupBy("lang", "source", "item").agg(F.sum("value").alias("value"))
    by = Window.partitionBy("lang", "source")
    pair = pair.withColumn("rank", F.row_number().over(by.orderBy(F.desc("value"), "item"))).withColumn("part", F.lit("pair"))

    whole = seen.groupBy("lang", "ord").agg(F.sum("n").alias("n"))
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total")).join(sizes, "lang")
    whole = whole.join(totals, "lang").select("lang", "ord", F.expr(_probability("n")).alias("q"))
    term = seen.select("lang", "source", "ord", "p").join(whole, ["lang", "ord"]).where("p > q").withColumn("value", F.col("p") - F.col("q"))
    term = term.withColumn("rank", F.row_number().over(by.orderBy(F.desc("value"), "ord"))).where(F.col("rank") <= top)
    names = words.select("lang", "base", F.posexplode("terms").alias("at", "item")).select("lang", (F.col("base") + F.col("at")).alias("ord"), "item")
    term = term.join(names, ["lang", "ord"]).withColumn("part", F.lit("term"))
    out = ["lang", "source", "part", "item", "value", "rank"]
    return pair.select(*out).unionByName(term.select(*out))
