"""Operator 6: benchmark decontamination as a prefix-filtered set join.

A *window* is ``size`` consecutive words of a benchmark item (a shorter item is one window).
Words are ordered by how rare they are in the corpus, and each window is joined through its
rarest word alone: a text can hold the window only where that word stands, with the
window's words at fixed places around it. Length and position bounds drop places too close
to an end, and equality of all words in the window decides.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, once, release, slices, texts_of

#: Bytes that are part of words once A-Z are lower-cased: digits, a-z, and all of non-ASCII.
_WORD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_WORD).split()


def windows_of(words: list[bytes], size: int) -> Iterator[list[bytes]]:
    if words:
        for k in range(max(1, len(words) - size + 1)):
            yield words[k : k + size]


def prefix_index(items: list[tuple[str, bytes]], counts: dict[bytes, int], size: int) -> dict:
    """rarest word -> {(its place in the window, window's length): {window: item ids}}."""
    index: dict = {}
    for name, text in items:
        for window in windows_of(words_of(text), size):
            at = min(range(len(window)), key=lambda k: (counts.get(window[k], 0), window[k], k))
            found = index.setdefault(window[at], {}).setdefault((at, len(window)), {})
            names = found.setdefault(b" ".join(window), [])
            if name not in names[-1:]:
                names.append(name)
    return index


def occurrences(words: list[bytes], index: dict) -> tuple[list[int], set[str]]:
    """Places of windows as merged spans (start, end, start, end, ...), and the items' ids."""
    places, items, n = [], set(), len(words)
    for k, word in enumerate(words):
        if word in index:
            for (at, length), windows in index[word].items():
                start = k - at
                if start >= 0 and start + length <= n:
                    names = windows.get(b" ".join(words[start : start + length]))
                    if names:
                        places.append((start, start + length))
                        items.update(names)
    return merge(places), items


def merge(places: list[tuple[int, int]]) -> list[int]:
    spans: list[int] = []
    for a, b in sorted(places):
        if spans and a <= spans[-1]:
            spans[-1] = max(b, spans[-1])
        else:
            spans += [a, b]
    return spans


_built: dict = {}


def _index(block, size: int) -> dict:
    """The index of a broadcast block, built once for a task; only the last block's is kept."""
    key = (id(block.value), size)
    if key not in _built:
        _built.clear()
        _built[key] = (block.value, prefix_index(*block.value, size))
    return _built[key][1]


VOCABULARY = 500_000  # distinct benchmark words up to which the words of the corpus are picked before they are counted


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    size: int = 13,
    block_bytes: int = 4_000_000,
) -> DataFrame:
    """``docs`` with ``n_words long``, ``spans array<int>`` (merged start, end word places of
    benchmark windows) and ``items array<string>`` (ids of the items they are of, sorted);
    columns of these names are replaced.

    The corpus is read once to count the benchmark's words. The benchmark is then taken in
    blocks of at most about ``block_bytes`` of text (one item may be longer), one after the
    other: a block and the counts of its words are broadcast, and dropped before the next. With
    one block the corpus is read once more, and nothing is shuffled; with several its rows are
    written with a number first, and each block's finds are joined to them by it.

    Null texts and texts without words have no spans; items without words or id never match;
    very long texts are scanned whole; repeated rows, of items too, count each; an empty
    benchmark finds nothing."""
    spark = docs.sparkSession
    bench = benchmark.select(
        F.col(f"`{item_col}`").cast("string").alias("item"), F.col(f"`{item_text_col}`").cast("string").alias("text")
    ).where("item is not null and text is not null")
    docs = docs.drop(*(c for c in ("n_words", "spans", "items") if c != text_col))
    held = bench.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-held // block_bytes))
    counts = corpus_counts(docs.select(F.col(f"`{text_col}`").alias("text")), bench)

    def block(k: int):
        part = bench.where(F.pmod(F.xxhash64("item", F.lit(7)), F.lit(n)) == k)
        items = sorted((r.item, r.text.encode()) for r in part.collect())
        wanted = part.select(F.explode(_words(F.col("text"))).alias("word")).distinct()
        return spark.sparkContext.broadcast((items, {bytes(r.word): r.n for r in counts.join(wanted, "word").collect()}))

    if n == 1:
        found = docs.withColumn("__found", _scan(block(0), size)(F.col(f"`{text_col}`")))
        return found.withColumns({c: F.col(f"__found.{c}") for c in ("n_words", "spans", "items")}).drop("__found")
    rows = materialize(docs.withColumn("__row", F.monotonically_increasing_id()), "decontaminate")
    hits = []
    for k in range(n):
        now = block(k)
        found = rows.select("__row", _scan(now, size)(F.col(f"`{text_col}`")).alias("f")).where(F.size("f.spans") > 0)
        hits.append(materialize(found.select("__row", "f.spans", "f.items"), "decontaminate"))
        now.destroy()
    merged = reduce(DataFrame.unionByName, hits).groupBy("__row").agg(F.collect_list(F.struct("spans", "items")).alias("found"))
    merged = merged.select("__row", once(_union, UNITED)("found").alias("u")).select("__row", "u.spans", "u.items")
    out = rows.join(merged, "__row", "left").drop("__row")
    none = {"spans": F.array().cast("array<int>"), "items": F.array().cast("array<string>")}
    out = out.withColumns({k: F.coalesce(k, v) for k, v in none.items()})
    return out.withColumn("n_words", F.size(_words(F.col(f"`{text_col}`"))).cast("long"))


KIND = "struct<n_words:bigint,spans:array<int>,items:array<string>>"
ARROW = pa.struct([("n_words", pa.int64()), ("spans", pa.list_(pa.int32())), ("items", pa.list_(pa.string()))])
UNITED = "struct<spans:array<int>,items:array<string>>"


def _words(text):
    """Column of the words of a text, as ``words_of`` takes them; null has none."""
    low = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.transform(F.regexp_extract_all(low, F.lit("[0-9a-z\\x{80}-\\x{10FFFF}]+"), 0), lambda w: w.cast("binary"))


def _scan(block, size: int):
    def scan(column: pa.Array) -> pa.Array:
        index, n_words, spans, items = _index(block, size), [], [], []
        for text in texts_of(column):
            words = words_of(text)
            places, names = occurrences(words, index)
            n_words.append(len(words))
            spans.append(places)
            items.append(sorted(names))
        columns = [pa.array(n_words, pa.int64()), pa.array(spans, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string()))]
        release()
        return pa.StructArray.from_arrays(columns, names=["n_words", "spans", "items"])

    return once(scan, KIND)


def _union(column: pa.Array) -> pa.Array:
    """Spans and items that several blocks have found in a text, as one."""
    out = []
    for parts in column.to_pylist():
        places = [p for x in parts for p in zip(x["spans"][::2], x["spans"][1::2])]
        out.append({"spans": merge(places), "items": sorted({i for x in parts for i in x["items"]})})
    return pa.array(out, pa.struct([ARROW.field("spans"), ARROW.field("items")]))


def corpus_counts(texts: DataFrame, bench: DataFrame) -> DataFrame:
    """``word binary, n long``: how often words of the benchmark occur in all texts, from one
    pass over them. Each task sums up its own words before they are shuffled."""
    words = materialize(bench.select(F.explode(_words(F.col("text"))).alias("word")).distinct(), "decontaminate")
    few = words.count() <= VOCABULARY
    wanted = texts.sparkSession.sparkContext.broadcast({bytes(r.word) for r in words.collect()} if few else None)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        picked, seen = wanted.value, Counter()

        def told() -> pa.RecordBatch:
            columns = [pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())]
            return pa.RecordBatch.from_arrays(columns, names=["word", "n"])

        for batch in slices(batches, 1000):
            for text in texts_of(batch.column(0)):
                found = words_of(text)
                seen.update(found if picked is None else filter(picked.__contains__, found))
                if len(seen) > VOCABULARY:
                    yield told()
                    seen.clear()
        yield told()

    found = texts.mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return materialize(found if few else found.join(words, "word", "left_semi"), "decontaminate")


def span_words(spans):
    """Number of words in a ``spans`` column."""
    odd = F.transform(spans, lambda x, k: F.when(k % 2 == 0, -x).otherwise(x))
    return F.aggregate(odd, F.lit(0).cast("long"), lambda a, x: a + x)


def items_digest(items):
    return F.sha2(F.array_join(items, ","), 256)
