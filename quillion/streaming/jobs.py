"""Incremental forms: page ingest, usage windows, rolling conversation memory."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from quillion.functions.text import normalize_text
from quillion.operators.chunking import chunk_rows, count_ends, math_pages, with_budget, with_ends
from quillion.operators.labels import label_formulas
from quillion.sources import commits
from quillion.sources.store import keep, with_row_ids

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def stateful_session(spark: SparkSession) -> SparkSession:
    """A session beside ``spark``, whose options stay as they are, for streams that keep state by
    key; such state needs the RocksDB store."""
    own = spark.newSession()
    for name in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        own.conf.set(name, spark.conf.get(name))
    own.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    return own


#: Pages as an ingest keeps them, one row for a page in each batch that brings it.
PAGES = "doc_name string, page int, text string, math_page boolean, chars int, ends array<struct<side:string,line:string>>, batch long"
#: How a document's pages are chunked, one row for each batch that brings pages of it.
RULES = "doc_name string, target int, overlap int, dropped array<string>, batch long"


def _kept(spark: SparkSession, path: str, schema: str, batch_id: int) -> DataFrame:
    """The rows of batches up to this one; those of a later try are not there yet."""
    return spark.read.schema(schema).option("basePath", path).parquet(path).where(F.col("batch") <= batch_id)


def _newest(pages: DataFrame, *columns: str) -> DataFrame:
    """Each page once, as the last batch that brought it has it."""
    found = pages.groupBy("doc_name", "page").agg(F.max_by(F.struct("batch", *columns), "batch").alias("p"))
    return found.select("doc_name", "page", "p.*")


def _meet(a: DataFrame, b: DataFrame, names: list[str], how: str = "inner") -> DataFrame:
    """A join on columns of both sides in which nulls are equal."""
    for n in names:
        b = b.withColumnRenamed(n, f"__{n}")
    met = a.join(b, reduce(lambda x, y: x & y, [F.col(n).eqNullSafe(F.col(f"__{n}")) for n in names]), how)
    return met.drop(*[f"__{n}" for n in names])


def _rules(pages: DataFrame, batch_id: int) -> DataFrame:
    """Budget and repeated lines of the documents that a batch brings pages of, over all of their
    pages. Lines are counted by line and sizes by document, both first where they are read."""
    here = _meet(pages, pages.where(F.col("batch") == batch_id).select("doc_name").distinct(), ["doc_name"], "left_semi")
    sizes = with_budget(_newest(here, "chars").groupBy("doc_name").agg(F.count("*").alias("n_pages"), F.sum("chars").alias("n_chars")))
    often = _meet(count_ends(_newest(here, "ends")), sizes.select("doc_name", "n_pages"), ["doc_name"]).where(F.col("n") / F.col("n_pages") >= 0.6)
    dropped = often.groupBy("doc_name").agg(F.sort_array(F.collect_set("line")).alias("dropped"))  # ten lines at most
    none = F.array().cast("array<string>")
    return _meet(sizes, dropped, ["doc_name"], "left").select("doc_name", "target", "overlap", F.coalesce("dropped", none).alias("dropped"))


def changed_chunks(spark: SparkSession, batch: DataFrame, batch_id: int, state: str, blocks: DataFrame | None = None) -> DataFrame:
    """:data:`~quillion.operators.chunking.CHUNKS` of the pages (doc_name, page, text) that a batch
    brings and, where it changes a document's budget or repeated lines, of all pages of that
    document; ``n`` is 0 and the text null for a page that has none. Pages and rules are kept
    below ``state`` by batch, so one that is replayed writes the same folders. A page is a row,
    and documents of any number of pages are many tasks' work."""
    rows = batch.select("doc_name", F.col("page").cast("int").alias("page"), normalize_text(F.coalesce("text", F.lit(""))).alias("text"))
    # A page that comes twice in a batch is as the last row of it.
    arrival = Window.partitionBy("doc_name", "page").orderBy(F.desc("__at"))
    rows = rows.withColumn("__at", F.monotonically_increasing_id()).withColumn("__at", F.row_number().over(arrival)).where("__at = 1").drop("__at")
    if blocks is None:
        rows = rows.withColumn("math_page", F.lit(False))
    else:
        rows = rows.join(math_pages(blocks).withColumn("math_page", F.lit(True)), ["doc_name", "page"], "left").withColumn("math_page", F.coalesce("math_page", F.lit(False)))
    with_ends(rows.withColumn("chars", F.length("text"))).write.mode("overwrite").parquet(f"{state}/pages/batch={batch_id}")
    pages = _kept(spark, f"{state}/pages", PAGES, batch_id)
    _rules(pages, batch_id).write.mode("overwrite").parquet(f"{state}/rules/batch={batch_id}")
    rules = _kept(spark, f"{state}/rules", RULES, batch_id)
    now, as_was = rules.where(F.col("batch") == batch_id).drop("batch"), F.struct("target", "overlap", "dropped")
    was = rules.where(F.col("batch") < batch_id).groupBy("doc_name").agg(F.max_by(as_was, "batch").alias("was"))
    changed = _meet(now, was, ["doc_name"]).where(as_was != F.col("was")).select("doc_name")
    due = pages.where(F.col("batch") == batch_id)
    if not changed.isEmpty():
        # Which rows are due is found without their texts; pages meet them by number.
        old = _newest(_meet(pages.select("doc_name", "page", "batch"), changed, ["doc_name"], "left_semi")).where(F.col("batch") < batch_id)
        due = due.unionByName(_meet(pages, old, ["doc_name", "page", "batch"], "left_semi"))
    due = _meet(due.drop("batch"), now, ["doc_name"])
    return chunk_rows(due, blank=True)


def stream_ingest(pages: DataFrame, store: str, checkpoint: str, scorer=None, blocks: DataFrame | None = None, ns: str = "default") -> DataStreamWriter:
    """Chunk, label and append pages as they arrive, in any order or again; :func:`ingested` reads
    what stands. Each batch is one append to the store, named by its number, so one that is
    replayed is there once, and its ids start after those of the appends before. ``blocks`` is
    a table, as for ``chunk_pages``. What batches leave for later ones lies in ``checkpoint``."""
    spark = pages.sparkSession

    def append(batch: DataFrame, batch_id: int) -> None:
        found = changed_chunks(spark, batch, batch_id, f"{checkpoint.rstrip('/')}/ingest", blocks)
        labelled = label_formulas(keep(found, "chunks"), scorer, stamp=F.lit("1970-01-01T00:00:00Z"))
        commits.append(with_row_ids(labelled, ["doc_name", "page_start", "n"], name="place"), store, ns, name=f"b{batch_id}")

    return pages.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(availableNow=True)


def ingested(spark: SparkSession, store: str, ns: str = "default") -> DataFrame:
    """The chunks of an ingest: of each page those that were appended last."""
    rows = commits.read(spark, store, ns)
    last = F.max("version").over(Window.partitionBy("doc_name", "page_start"))
    return rows.withColumn("__last", last).where("version = __last and n > 0").drop("__last", "version", "commit")


def usage_windows(requests: DataFrame, tpm: int, rpm: int, late: str = "10 minutes") -> DataFrame:
    """Tokens and requests of each minute against caps; works on a stream and on a table."""
    rows = requests.withColumn("ts", F.col("ts").cast("timestamp"))
    if rows.isStreaming:
        rows = rows.withWatermark("ts", late)
    per = rows.groupBy(F.window("ts", "60 seconds").alias("w")).agg(F.sum("tokens").alias("tokens"), F.count("*").alias("requests"))
    return per.select(
        F.col("w.start").cast("timestamp_ntz").alias("start"), "tokens", "requests", ((F.col("tokens") > tpm) | (F.col("requests") > rpm)).alias("over")
    )


class RollingMemory(StatefulProcessor):
    """Keeps the newest turns of a conversation that fit a token budget. With ``ttl`` (seconds
    since a conversation's turns were last written) state goes by the clock; with ``idle``
    (seconds of event time after its newest turn) a timer empties the conversation once
    the watermark has passed."""

    def __init__(self, limit: int, ttl: float | None = None, idle: float | None = None):
        self.limit, self.ttl, self.idle = limit, ttl, idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.turns = handle.getListState("turns", "turn long, cost long", int(self.ttl * 1000) if self.ttl else None)
        self.newest = handle.getValueState("newest", "ms long") if self.idle else None

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held, latest = {int(t): int(c) for t, c in self.turns.get()}, None
        for batch in rows:
            for r in batch.itertuples(index=False):
                held[int(r.turn)] = max(1, len((r.q or "") + (r.a or "")) // 4)
                if self.idle:
                    ms = int(pd.Timestamp(r.ts).timestamp() * 1000)
                    latest = ms if latest is None else max(latest, ms)
        if self.idle:
            self._wait(latest)
        kept, fits, used = [], [], 0
        for turn, cost in sorted(held.items(), reverse=True):
            used += cost
            kept.append((turn, cost))  # the first that does not fit stays too: it bars older ones
            if used > self.limit:
                break
            fits.append(turn)
        self.turns.put(kept)
        yield self._told(key, fits)

    def _wait(self, latest: int) -> None:
        """One timer a conversation, after its newest turn; late turns do not move it."""
        before = self.newest.get()[0] if self.newest.exists() else None
        if before is not None and before >= latest:
            return
        if before is not None:
            self.handle.deleteTimer(before + int(self.idle * 1000))
        self.handle.registerTimer(latest + int(self.idle * 1000))
        self.newest.update((latest,))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.turns.clear()
        self.newest.clear()
        yield self._told(key, [])

    def _told(self, key, fits: list[int]) -> pd.DataFrame:
        turns = pd.array(fits or [None], "Int64")  # a null turn says that none is kept
        return pd.DataFrame({"conv_id": [key[0]] * len(turns), "turn": turns, "n_kept": [len(fits)] * len(turns)})

    def close(self) -> None:
        pass


def stream_memory(turns: DataFrame, limit: int = 1200, ttl: float | None = None, idle: float | None = None, late: str = "10 minutes") -> DataFrame:
    """For every conversation that got turns, those it keeps now (conv_id, turn, n_kept), or a
    null turn if it keeps none. Turns may come in any order, and a turn that comes again
    replaces itself.

    ``ttl`` forgets a conversation that many seconds of clock time after its last batch; such a
    stream always has another batch to run, so ``availableNow`` does not end it. ``idle``
    needs a column ``ts``: a conversation is emptied that many seconds after its newest turn, by
    the watermark, which lies ``late`` behind the newest ``ts`` of all; turns older than the
    watermark are dropped. The session must be a :func:`stateful_session`."""
    if ttl and idle:
        raise ValueError("a stream has one kind of time: give ttl or idle")
    slim = turns.select("conv_id", "turn", "q", "a", *(["ts"] if idle else []))
    if idle:
        slim = slim.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    mode = "EventTime" if idle else "ProcessingTime" if ttl else "None"
    return slim.groupBy("conv_id").transformWithStateInPandas(
        statefulProcessor=RollingMemory(limit, ttl, idle), outputStructType="conv_id long, turn long, n_kept int", outputMode="Update", timeMode=mode
    )
