"""Operator 8: bulk-synchronous best-fit packing of token sequences.

Pieces of one length are alike, and so are gaps of one size, so rounds work on *runs* (size,
first, count): of pieces, ranks within a length; of gaps, numbers of sequences. A run table
has at most a row for each length and a few for each match of a run, so its size depends on
``capacity`` and not on the number of documents. In each round, all of it on Spark:

1. Pieces longer than the round's cut take part, so that long ones go first: those above half
   a sequence in the first round, then those down to a fourteenth less in each round after.
2. Runs of pieces and gaps are sorted by size together and swept once: the *successor* of a
   piece is the first gap, in order of size, that holds it.
3. Pieces that have the same successor are in conflict. Rank resolves it: each takes the first
   gap from its successor on that no piece before it in the order has taken, a running maximum.
4. For pieces beyond the last gap new sequences are opened: one each if longer than half a
   sequence, as many as the tokens of those fill that no gap is large enough for, else no more
   than all that is left needs beside the gaps.
5. A gap is replaced by what is left of it, and what was placed leaves the table.

Once all pieces take part, a gap takes a *bundle* in a round: as many pieces of one length as go
into half the largest gap (or into a whole sequence, where no gap holds any). So the
largest gap shrinks by a share each round, however short the pieces are.

A piece's place follows from its rank within its length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from .common import materialize, release, slices
from .tokens import drop_encoders, encoder

PART = 200_000  # pieces of one length that one task numbers
SHRINK, LEAST = 1.07, 16  # a round's cut is a SHRINKth of the last; below a LEASTth of a sequence all take part

PIECES = "id long, piece int, start long, length long, ids_crc32 long"


def token_pieces(docs: DataFrame, vocabulary: str, end_id: int, capacity: int, id_col="doc_id", text_col="text") -> DataFrame:
    """Every document's ids and the end id, cut into pieces of at most ``capacity``. A null
    text counts as empty, so each row has at least one piece; a null id stays null."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for batch in slices(batches, 1000):
            ids, ends = enc.encode(batch.column(1))
            n = np.diff(ends) + 1
            whole = np.full(n.sum(), end_id, "<u4")
            whole[np.arange(len(ids)) + np.repeat(np.arange(len(n)), n - 1)] = ids
            first, pieces = np.cumsum(n) - n, -(-n // capacity)
            nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            start = nth * capacity
            length = np.minimum(np.repeat(n, pieces) - start, capacity)
            raw, at = memoryview(whole.tobytes()), 4 * (np.repeat(first, pieces) + start)
            crc = [zlib.crc32(raw[a:b]) for a, b in zip(at.tolist(), (at + 4 * length).tolist())]
            names = batch.column(0).take(pa.array(np.repeat(np.arange(len(n)), pieces)))
            columns = [names, pa.array(nth, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "piece", "start", "length", "ids_crc32"])
        drop_encoders()
        release()

    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return rows.mapInArrow(cut, PIECES)


PIECE, GAP, PLACED, OPENED = "piece", "gap", "placed", "opened"
#: Pieces: length, first rank, count, and rounds until they take part. Gaps: size, first sequence,
#: count. Placed: length, first rank, sequences, first sequence, gap's size before, and how many
#: pieces each sequence takes. One row counts the sequences opened so far.
RUN = "kind string, size long, first long, n long, start long, room long, wait int, times long"
ROUNDS_A_JOB = 2


def cuts(capacity: int) -> list[int]:
    """The rounds' cuts: pieces longer than it take part, and after the last all pieces."""
    out, cut = [], capacity / 2
    while cut > capacity / LEAST:
        out.append(int(cut))
        cut /= SHRINK
    return out


def _run(kind: str, **fields: str) -> str:
    kinds = dict(x.split() for x in RUN.split(", "))
    return f"named_struct({', '.join(f"'{k}', cast({fields.get(k, f"'{kind}'" if k == 'kind' else 'null')} as {t})" for k, t in kinds.items())})"


def one_round(runs: DataFrame, capacity: int) -> DataFrame:
    """The run table after a round (steps 2 to 5 above). Its columns are SQL text: a round has
    too many of them to be built one by one."""
    piece, gap, order = f"kind = '{PIECE}'", f"kind = '{GAP}'", "over (order by size, kind desc, first rows between unbounded preceding and"
    active = f"({piece} and wait <= 0)"

    def total(flag: str, what: str, window: str = "over ()") -> str:
        return f"coalesce(sum(if({flag}, {what}, null)) {window}, 0)"

    # Bundles, once all pieces take part; what does not make one up waits for the next round.
    own = ["kind", "size", "first", "n", "start", "room", "wait"]
    # Rounds in which no piece would take part are skipped.
    soonest = f"wait - greatest(0, min(if({piece}, wait, null)) over ())"
    runs = runs.selectExpr(*own[:-1], "times", f"if({piece}, {soonest}, null) as wait")
    runs = runs.selectExpr(*own, "times", f"{total(f'{piece} and wait > 0', 'n')} as later", f"coalesce(max(if({gap}, size, null)) over (), 0) as widest", f"min(if({active}, size, null)) over () as least")
    half = f"if(later > 0, 0, if(widest >= least, (widest + 1) div 2, {capacity}))"
    runs = runs.selectExpr(*own, "times", "later", "widest", f"if({active}, least(n, greatest(1, {half} div size)), coalesce(times, 1)) as many")
    bundle = _run(PIECE, size="size * many", first="first", n="n div many", wait="wait", times="many")
    over = _run(PIECE, size="size", first="first + n - n % many", n="n % many", wait="1", times="1")
    same = f"named_struct({', '.join(f"'{k}', {k}" for k in (*own, 'times'))})"
    runs = runs.selectExpr("later", "widest", f"inline(if({active}, array({bundle}, {over}), array({same})))").where(f"not {piece} or n > 0")

    # The sweep: gaps and pieces before each run, and the successors' running maximum.
    own = ["kind", "size", "first", "n", "room", "wait", "times"]
    runs = runs.selectExpr(
        *own, "start", f"{total(gap, 'n', order + ' 1 preceding)')} as gaps", f"{total(active, 'n', order + ' 1 preceding)')} as pieces", f"{total(gap, 'n')} as all_gaps",
        f"{total(gap, 'size * n')} as free", f"{total(piece, 'size * n')} as left", f"{total(f'{active} and size div times > widest', 'size * n')} as homeless",
    )
    ahead = f"max(if({active}, gaps - pieces, null)) {order} current row)"
    runs = runs.selectExpr("*", f"case when {gap} then gaps when {active} then pieces + {ahead} else start end as at")
    over = "least(greatest(at + n - all_gaps, 0), n)"
    runs = runs.selectExpr(*own, "start", "at", "all_gaps", "free", "left", "homeless", f"{total(active, over + ' * size')} as over", f"{total(f'{active} and 2 * size > {capacity} and times = 1', over)} as long")
    # New sequences, but no more than all pieces, those of later rounds too, need beside the gaps.
    new, need = f"ceil(over / {capacity})", f"ceil(greatest(left - free, 0) / {capacity})"
    runs = runs.selectExpr(*own, "start", "at", "all_gaps", f"cast(greatest(long, ceil(homeless / {capacity}), least({new}, {need})) as long) as new")

    # Marks along the gaps, in order of size: from here on this run of gaps, or of pieces.
    def span(size: str, first: str, start: str, times: str = "1") -> str:
        return f"named_struct({', '.join(f"'{k}', cast({v} as long)" for k, v in (('size', size), ('first', first), ('start', start), ('times', times)))})"

    def mark(at: str, turn: int, taker: str = "null", of: str = "null", kept: str = "null") -> str:
        kind = "struct<size:long,first:long,start:long,times:long>"
        fields = (("at", at, "long"), ("turn", turn, "int"), ("taker", taker, kind), ("gap", of, kind), ("kept", kept, f"struct<{RUN}>"), ("end_", "all_gaps + new", "long"))
        return f"named_struct({', '.join(f"'{k}', cast({v} as {t})" for k, v, t in fields)})"

    here, nobody = span("size", "first", "at", "times"), span("0", "0", "at + n")
    done = "greatest(least(all_gaps + new - at, n), 0)"
    waits = mark("null", 3, kept=_run(PIECE, size="size div times", first="first", n="n * times", wait="wait - 1", times="1"))
    rest = mark("null", 3, kept=_run(PIECE, size="size div times", first=f"first + {done} * times", n=f"(n - {done}) * times", wait="wait - 1", times="1"))
    count = mark("null", 3, kept=_run(OPENED, n="n + new"))
    marks = f"""inline(case
        when {gap} then array({mark("at", 2, of=here)})
        when {active} and {done} > 0 then array({mark("at + n", 0, nobody)}, {mark("at", 1, here)}, {rest})
        when {piece} then array({waits})
        when kind = '{OPENED}' then array({mark("all_gaps", 2, of=span(str(capacity), "n", "all_gaps"))}, {count})
        else array({mark("null", 3, kept=_run(PLACED, size="size", first="first", n="n", start="start", room="room", times="times"))}) end)"""
    order = "over (order by at, turn rows between unbounded preceding and current row)"
    marks = runs.selectExpr(marks).selectExpr(
        "at", "kept", f"last(taker, true) {order} as taker", f"last(gap, true) {order} as gap", "least(lead(at) over (order by at, turn), end_) as stop"
    )

    # What each stretch between marks becomes.
    length = "coalesce(taker.size, 0)"
    left = _run(GAP, size=f"gap.size - {length}", first="gap.first + at - gap.start", n="stop - at")
    put = _run(PLACED, size=f"{length} div taker.times", first="taker.first + (at - taker.start) * taker.times", n="stop - at", start="gap.first + at - gap.start", room="gap.size", times="taker.times")
    became = f"inline(case when at is null then array(kept) when at < stop and gap is not null then array({left}, {put}) end)"
    return marks.selectExpr(became).where(f"kind = '{OPENED}' or n > 0 and size > 0")


def bundled_rounds(lengths: DataFrame, capacity: int) -> DataFrame:
    """Where the pieces of each length go: ``length, rank, n, times, sequence, size``. Piece
    ``rank + k`` of the length, with ``k`` below ``n * times``, goes to sequence
    ``sequence + k % n``, which has ``size - k div n * length`` left before.

    ``lengths`` has ``length`` (1 to ``capacity``) and ``n``. :data:`ROUNDS_A_JOB` rounds are one
    job, whose run table is written to the shared folder; whether any piece is left is all that
    reaches the driver."""
    wait = "+".join(["0", *(f"if(length <= {cut}, 1, 0)" for cut in cuts(capacity))])
    first = lengths.selectExpr(f"inline(array({_run(PIECE, size='length', first='0', n='n', wait=wait, times='1')}))")
    runs = first.unionByName(lengths.sparkSession.range(1).selectExpr(f"inline(array({_run(OPENED, n='0')}))"))
    left = True
    while left:
        for _ in range(ROUNDS_A_JOB):
            runs = one_round(runs, capacity)
        seen = Observation()
        runs = materialize(runs.observe(seen, F.count(F.when(F.col("kind") == PIECE, 1)).alias("left")), "runs")
        left = seen.get["left"]
    placed = runs.where(F.col("kind") == PLACED)
    return placed.select(F.col("size").alias("length"), F.col("first").alias("rank"), "n", "times", F.col("start").alias("sequence"), F.col("room").alias("size"))


def best_fit_rounds(lengths: DataFrame, capacity: int) -> DataFrame:
    """:func:`bundled_rounds` with a row for each of the ``times``: ``length, rank, n, sequence,
    size``; piece ``rank + k`` of the length goes to sequence ``sequence + k``, which has ``size``
    left before."""
    each = bundled_rounds(lengths, capacity).withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("times") - 1)))
    return each.select("length", (F.col("rank") + F.col("i") * F.col("n")).alias("rank"), "n", "sequence", (F.col("size") - F.col("i") * F.col("length")).alias("size"))


def pack(pieces: DataFrame, capacity: int) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to a table with ``id``, ``piece`` and ``length`` (1 to
    ``capacity``); columns of these names are replaced. The table must give the same rows each
    time it is read. Rows that share id and piece are numbered in any order; an empty table
    gives an empty one.

    Pieces are numbered within their length in parts of about :data:`PART`, so that a length
    which a third of all pieces share is not one task's work."""
    lengths = materialize(pieces.groupBy("length").agg(F.count("*").alias("n")), "lengths")  # at most ``capacity`` rows
    parts = lengths.select("length", F.ceil(F.col("n") / PART).cast("int").alias("parts"))
    rows = pieces.drop("sequence_id", "offset").join(F.broadcast(parts), "length")
    rows = rows.withColumn("part", F.pmod(F.xxhash64("id", "piece"), F.col("parts")).cast("int")).drop("parts")
    counts = rows.groupBy("length", "part").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = materialize(counts.select("length", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before")), "lengths")
    placed = bundled_rounds(lengths, capacity)
    run = F.struct(F.col("rank").alias("lo"), (F.col("rank") + F.col("n") * F.col("times")).alias("hi"), "n", "sequence", (capacity - F.col("size")).alias("offset"))
    table = materialize(placed.groupBy("length").agg(F.collect_list(run).alias("runs")).coalesce(1), "runs")
    w = Window.partitionBy("length", "part").orderBy("id", "piece")
    ranked = rows.withColumn("n", F.row_number().over(w) - 1).join(counts, ["length", "part"])
    ranked = ranked.withColumn("rank", F.col("n") + F.col("before")).drop("n", "before", "part")
    at = F.filter("runs", lambda r: (r.lo <= F.col("rank")) & (F.col("rank") < r.hi))[0]
    # Bounded by ``capacity``: a row for each length.
    found = ranked.join(F.broadcast(table), "length").withColumn("run", at)
    k = F.col("rank") - F.col("run.lo")
    found = found.withColumns({"sequence_id": F.col("run.sequence") + k % F.col("run.n"), "offset": F.col("run.offset") + F.expr("(rank - run.lo) div run.n") * F.col("length")})
    return found.select(*[c for c in pieces.columns if c not in ("sequence_id", "offset")], "sequence_id", "offset")


def pack_documents(docs: DataFrame, vocabulary: str, end_id: int, capacity: int, id_col="doc_id", text_col="text") -> DataFrame:
    """``id, piece, start, length, ids_crc32, sequence_id, offset`` of every piece of every row.

    Null and empty texts are one piece of the end id alone; very long texts are cut, and only
    they are; rows that share an id, repeated rows among them, are packed each; other columns
    play no part; an empty table gives an empty one."""
    return pack(materialize(token_pieces(docs, vocabulary, end_id, capacity, id_col, text_col), "pieces"), capacity)
