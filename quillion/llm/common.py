"""Helpers shared by the training-data operators."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


_OWN: dict[str, str] = {}  # folders of local applications that name none


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``. Where that is unset
    a local session (one process, as in tests) gets a temporary folder, and a cluster an error."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = _OWN.get(spark.sparkContext.applicationId) or _OWN.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="quillion-"))
    return path.rstrip("/")


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back. Cuts the lineage with
    files that outlive any executor, and lets one result feed several jobs."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def shuffled(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that sorts and merges both sides. Spark sizes what comes of an explode,
    a Python step or an aggregate by its input, and a Parquet table by its compressed files, so where
    rows grow with the input it may else broadcast, through the driver, a table that is many times larger."""
    return df.hint("merge")


BATCH_ROWS = 1000


def bounded_batches(spark: SparkSession) -> None:
    """For applications: send texts to Python tasks at most 1000 rows at a time for the rest of the
    session. At Spark's default of 10000, long texts make a batch larger than a worker's share
    of memory. Operators leave the session as it is."""
    conf = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(conf)) <= BATCH_ROWS:
        spark.conf.set(conf, str(BATCH_ROWS))


def release() -> None:
    """Give memory that a task has freed back to the system; Python workers outlive tasks, and
    what one holds on to is missing for the next operator's."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only where the C library can
        ctypes.CDLL(None).malloc_trim(0)


def slices(batches, rows: int):
    """Record batches of at most ``rows`` rows, so that a task works on few texts at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    release()


def gathered(batches, size: int) -> Iterator[pa.RecordBatch]:
    """Record batches put together, in order, until one holds ``size`` bytes or more."""
    held, n = [], 0
    for batch in batches:
        held.append(batch)
        n += batch.nbytes
        if n >= size:
            yield pa.concat_batches(held)
            held, n = [], 0
    if held:
        yield pa.concat_batches(held)
    release()


def texts_of(column: pa.Array | pa.ChunkedArray) -> Iterator[bytes]:
    """UTF-8 bytes of each value; null counts as empty."""
    for at in range(0, len(column), 500):
        for x in column.slice(at, 500).cast(pa.binary()).to_pylist():
            yield x or b""


def flat_bytes(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """All values end to end as uint8, and the n + 1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[ends[0] : ends[-1]], ends - ends[0]


def once(f, kind: str):
    """An Arrow UDF that a plan evaluates where it stands and nowhere else. Spark would else work
    it out again for each filter and column that uses it, and every Python node of a stage holds
    a worker process for each running task."""
    return F.arrow_udf(f, kind).asNondeterministic()


def held_out(id_col):
    """True for the fifth of the rows, by crc32 of the id as text, that no model learns from."""
    return F.pmod(F.crc32(id_col.cast("string")), F.lit(5)) == 0


def components(edges: DataFrame, tag: str = "components") -> DataFrame:
    """Connected components by alternating large-star and small-star steps.

    ``edges`` has two long columns ``u`` and ``v``; returns ``node, root`` for every node that
    has an edge to another, root being the smallest node of its component. Each step is
    aggregates and joins, written to the shared folder; only a count and a checksum of the
    edges reach the driver. Nulls and self-loops are ignored."""
    def told(e: DataFrame) -> tuple[DataFrame, tuple]:
        seen = Observation()
        e = materialize(e.observe(seen, F.count(F.lit(1)).alias("n"), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0)).alias("sum")), tag)
        return e, (seen.get["n"], seen.get["sum"])

    e, now = told(edges.where("u <> v").select(F.greatest("u", "v").alias("a"), F.least("u", "v").alias("b")).distinct())
    before = None
    while now != before and now[0]:
        before = now
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(shuffled(least), "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = materialize(large.distinct(), tag)
        small = large.groupBy("a").agg(F.min("b").alias("m"))
        pulled = large.join(shuffled(small), "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        e, now = told(pulled.unionByName(small.select("a", F.col("m").alias("b"))).distinct())
    return e.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        e.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct()
    )
