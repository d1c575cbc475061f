"""Operator 3: token-id files, coded block by block with an adaptive range coder.

A file is a Parquet table of *segments*. A segment holds whole documents and is

    magic "QTID", version, block length, vocabulary size, documents, ids  (header)
    document ids (int64, with a null mask) and their token counts         (directory)
    crc32 of header and directory
    length of each block, then the blocks of :mod:`range_coder`

Segments lie in ascending document order over the files, and documents in ascending order
in a segment, so offsets in the whole collection follow from the counts alone.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import gathered, materialize, release
from .range_coder import CorruptBlock, decode_blocks, encode_blocks
from .tokens import drop_encoders, encoder

HEAD = struct.Struct("<4sHIIIQ")
BLOCK = 2048
SEGMENT = 8_000_000  # ids after which a segment ends with the document it is in; as many are coded side by side
TEXT = 8_000_000  # bytes of text, and what one batch adds, encoded at a time


def pack_segment(doc_ids: list, counts: np.ndarray, ids: np.ndarray, vocab: int, block: int = BLOCK) -> bytes:
    """One segment; a null document id is kept as null."""
    known = np.array([x is not None for x in doc_ids], np.uint8)
    head = HEAD.pack(b"QTID", 1, block, vocab, len(doc_ids), len(ids))
    names = np.array([0 if x is None else x for x in doc_ids], "<i8")
    head += names.tobytes() + known.tobytes() + np.asarray(counts, "<u4").tobytes()
    blocks = encode_blocks([ids[k : k + block] for k in range(0, len(ids), block)], vocab)
    sizes = np.array([len(b) for b in blocks], "<u4").tobytes()
    return head + struct.pack("<I", zlib.crc32(head)) + sizes + b"".join(blocks)


def unpack_segment(data: bytes) -> tuple[list, np.ndarray, np.ndarray]:
    """Document ids, token counts and ids; :class:`CorruptBlock` if anything does not hold."""
    magic, version, block, vocab, n, total = HEAD.unpack_from(data)
    end = HEAD.size + 13 * n
    if magic != b"QTID" or version != 1 or zlib.crc32(data[:end]) != struct.unpack_from("<I", data, end)[0]:
        raise CorruptBlock("header of a segment")
    names = np.frombuffer(data, "<i8", n, HEAD.size)
    known = np.frombuffer(data, np.uint8, n, HEAD.size + 8 * n)
    counts = np.frombuffer(data, "<u4", n, HEAD.size + 9 * n)
    sizes = np.frombuffer(data, "<u4", -(-total // block), end + 4)
    cuts = end + 4 + sizes.nbytes + np.concatenate([[0], np.cumsum(sizes, dtype=np.int64)])
    blocks = decode_blocks([data[a:b] for a, b in zip(cuts, cuts[1:])], vocab)
    ids = np.concatenate(blocks) if blocks else np.zeros(0, np.uint32)
    if len(ids) != total or counts.sum(dtype=np.int64) != total:
        raise CorruptBlock("length of a segment")
    return [int(x) if k else None for x, k in zip(names, known)], counts, ids


SEGMENTS = "part int, seq int, before long, n_docs int, n_tokens long, data binary"


def write_token_files(
    docs: DataFrame,
    vocabulary: str,
    end_id: int | None,
    vocab_size: int,
    id_col: str = "doc_id",
    text_col: str = "text",
    segment: int = SEGMENT,
) -> DataFrame:
    """Encode every text and write segments in ascending id order; returns the written table
    (:data:`SEGMENTS`). Rows are range-partitioned by id, so ``part`` and ``seq`` order the
    segments. Null text counts as empty, null ids come first, rows that share an id follow
    each other by text. A very long text is encoded whole and lies in as many segments as it
    fills. Columns other than the two play no part, whatever their names; an empty table gives
    an empty one. Workers keep the words they have met until they read segments: tasks share
    most words, and asking the library for them is half of a first task's encoding."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, seq, tail = encoder(vocabulary), TaskContext.get().partitionId(), 0, int(end_id is not None)
        names, sizes, held, size, before = [], [], [], 0, 0

        def done() -> pa.RecordBatch:
            ids = np.concatenate(held)
            held.clear()
            data = pack_segment(names, np.concatenate(sizes), ids, vocab_size)
            row = [[part], [seq], [before], [len(names)], [len(ids)], [data]]
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary())
            return pa.RecordBatch.from_arrays(
                [pa.array(v, t) for v, t in zip(row, kinds)], names=["part", "seq", "before", "n_docs", "n_tokens", "data"]
            )

        for batch in gathered(batches, TEXT):
            ids, ends = enc.encode(batch.column(1))
            n = np.diff(ends) + tail
            whole = np.full(n.sum(), end_id or 0, np.uint32)
            mask = np.ones(len(whole), bool)
            mask[np.cumsum(n)[: len(n) * tail] - 1] = False
            whole[mask] = ids
            del ids, mask
            texts, cut = batch.column(0).to_pylist(), np.concatenate([[0], np.cumsum(n)])
            at = 0
            while at < len(n):  # a segment ends with the document that fills it
                to = min(len(n), int(np.searchsorted(cut, cut[at] + segment - size)))
                to = max(to, at + 1)
                names += texts[at:to]
                sizes.append(n[at:to])
                held.append(whole[cut[at] : cut[to]])
                size, at = size + int(cut[to] - cut[at]), to
                if size >= segment:
                    yield done()
                    names, sizes, held, size, seq, before = [], [], [], 0, seq + 1, before + size
        if names:
            yield done()
        release()

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    rows = rows.repartitionByRange("id").sortWithinPartitions("id", "text")
    return materialize(rows.mapInArrow(pack, SEGMENTS), "token-files")


def read_token_files(segments: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids`` of a written table; start counts the ids of all
    documents before. ``ids`` are little-endian unsigned 32-bit integers."""
    return _read(segments, False)


def read_token_digests(segments: DataFrame) -> DataFrame:
    """As :func:`read_token_files`, with ``ids_crc32`` in place of the ids."""
    return _read(segments, True)


def _read(segments: DataFrame, digest: bool) -> DataFrame:
    last = "ids_crc32" if digest else "ids"

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        drop_encoders()
        for batch in batches:
            for first, data in zip(batch.column("first").to_pylist(), batch.column("data")):
                names, counts, ids = unpack_segment(data.as_py())
                cuts = np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])
                raw = memoryview(ids.astype("<u4", copy=False).view(np.uint8))
                parts = [raw[4 * a : 4 * b] for a, b in zip(cuts.tolist(), cuts[1:].tolist())]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(names, pa.int64()),
                        pa.array(cuts[:-1] + first),
                        pa.array(counts.astype(np.int64)),
                        pa.array([zlib.crc32(x) for x in parts], pa.int64()) if digest else pa.array([bytes(x) for x in parts], pa.binary()),
                    ],
                    names=["doc_id", "start", "n_tokens", last],
                )

    # One number for each task of the writer: that many rows are broadcast, whatever the input.
    totals = segments.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("part_first"))
    rows = segments.select("part", "before", "data").join(F.broadcast(totals), "part")
    rows = rows.select((F.col("part_first") + F.col("before")).alias("first"), "data")
    kind = "long" if digest else "binary"
    return rows.mapInArrow(unpack, f"doc_id long, start long, n_tokens long, {last} {kind}")
