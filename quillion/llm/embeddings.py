"""Operator 7: near-duplicate vectors by sorted projection passes.

Each pass draws random hyperplanes, turns every vector into the bits of its sides, sorts
all vectors by them and compares each with a bounded window of neighbours; pairs whose
cosine holds are united over all passes. Vectors equal in every component are one row
throughout.

How many passes it takes depends on how crowded the directions are, which no formula knows:
vectors that are close but below the threshold push the true pairs out of each other's
windows. So passes run in groups, each of which writes its links and no more, until a group
joins next to nothing that was apart before; what a group finds of the links still missing,
the next one would find of the rest.

Which vectors belong together is what the passes say. How many links each has is counted
afterwards by an all-pairs step within each component, tile by tile: a component of m
distinct vectors costs m * m products, as a group of many near copies has that many links.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import components, materialize, release, slices

BITS = 48
TILE = 4096  # vectors of a component that are compared at once with as many others
GROUP = 8  # passes between two looks at what they have joined
SETTLED = 500  # a group that joins fewer than one in so many of all joined vectors is the last
BROADCAST_ROWS = 100_000


def passes_for(rows: int, window: int, threshold: float, miss: float = 0.01) -> int:
    """Passes after which a pair at the threshold has been missed with probability ``miss`` if
    vectors spread evenly over all directions; where they do not, further groups follow.

    Two vectors at angle a share a bit with probability 1 - a/pi and meet in a window once they
    share about log2(rows / window) leading bits."""
    share = (1 - math.acos(threshold) / math.pi) ** max(1.0, math.log2(max(rows, 2) / window))
    return max(4, math.ceil(math.log(miss) / math.log(1 - share)) if share < 1 else 4)


def unit(vectors: pa.Array) -> np.ndarray:
    """Rows of length one; dividing by the largest component first keeps squares in range."""
    x = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _hashed(first: int, count: int, seed: int):
    """Rows ``pass, key, node, root, v`` of passes from ``first`` on."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[tuple[int, int], np.ndarray] = {}
        for piece in slices(batches, 1000):
            size = piece.column("v").value_lengths().to_numpy(zero_copy_only=False)
            for dim in np.unique(size).tolist():
                rows = piece.filter(pa.array(size == dim))
                x = unit(rows.column("v"))
                for k in range(first, first + count):
                    if (dim, k) not in planes:
                        planes[dim, k] = np.random.default_rng([seed, dim, k]).normal(size=(dim, BITS))
                    key = (x @ planes[dim, k] > 0) @ (1 << np.arange(BITS - 1, -1, -1, dtype=np.int64))
                    columns = [pa.array(np.full(len(x), k, np.int32)), pa.array(key), *(rows.column(c) for c in ("node", "root", "v"))]
                    yield pa.RecordBatch.from_arrays(columns, names=["pass", "key", "node", "root", "v"])

    return keys


def _windows(window: int, threshold: float):
    """Links ``u, v`` between vectors of a window whose roots no link of this task has joined."""

    def links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        joined: dict[int, int] = {}

        def find(a: int) -> int:
            while (b := joined.get(a, a)) != a:
                joined[a] = joined.get(b, b)
                a = b
            return a

        held = None
        for piece in slices(batches, 512):
            size = piece.column("v").value_lengths().to_numpy(zero_copy_only=False)
            new: list[tuple[int, int]] = []
            for dim in np.unique(size).tolist():
                rows = piece if (size == dim).all() else piece.filter(pa.array(size == dim))
                x = unit(rows.column("v"))
                node, root, step = (rows.column(c).to_numpy() for c in ("node", "root", "pass"))
                if held is not None and held[0].shape[1] == dim:
                    x, node, root, step = (np.concatenate(both) for both in zip(held, (x, node, root, step)))
                near = np.arange(len(x))[None] - np.arange(len(x))[:, None]
                a, b = np.nonzero((x @ x.T >= threshold) & (near > 0) & (near <= window) & (step[:, None] == step[None]))
                names = np.array([find(k) for k in root.tolist()])
                far = names[a] != names[b]
                for i, j in zip(a[far].tolist(), b[far].tolist()):
                    one, other = find(int(root[i])), find(int(root[j]))
                    if one != other:
                        joined[max(one, other)] = min(one, other)
                        new.append((int(node[i]), int(node[j])))
                held = tuple(c[-window:] for c in (x, node, root, step))
            u, v = zip(*new) if new else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])

    return links


def _linked(distinct: DataFrame, window: int, threshold: float, passes: int | None, seed: int) -> DataFrame:
    """``node, root`` of all nodes that passes have joined to another."""
    planned = passes or max(4, passes_for(distinct.count(), window, threshold) - GROUP)
    kept, roots, done = distinct.select("node", "v"), None, 0
    links = None
    while True:
        some = min(GROUP, planned - done) if done < planned else GROUP
        rows = kept.withColumn("root", F.col("node")) if roots is None else kept.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
        shape = rows.select(F.lit(0).alias("pass"), F.lit(0).cast("long").alias("key"), "node", "root", "v").schema
        spread = rows.select("node", "root", "v").mapInArrow(_hashed(done, some, seed), shape)
        ordered = spread.repartitionByRange("pass", "key", "node").sortWithinPartitions("pass", "key", "node")
        found = materialize(ordered.mapInArrow(_windows(window, threshold), "u long, v long"), "vectors")
        links, done = found if links is None else links.unionByName(found), done + some
        if done < planned:
            continue
        settled = roots is not None and found.count() * SETTLED <= roots.count()
        roots = materialize(components(links, "vectors"), "vectors")
        if passes or settled:
            return roots


def _counts(linked: DataFrame, threshold: float) -> DataFrame:
    """``node, n``: links of each vector to vectors of its component, copies counted. ``linked``
    has ``root, node, v, copies``."""
    # Only components larger than a tile are looked up, so that no task gathers all rows of one.
    sizes = linked.groupBy("root").agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles")).where("tiles > 1")
    sizes = materialize(sizes, "vectors")
    sizes = F.broadcast(sizes) if sizes.count() <= BROADCAST_ROWS else sizes
    spread = linked.join(sizes, "root", "left").withColumn("tiles", F.coalesce("tiles", F.lit(1)))
    spread = spread.withColumn("mine", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int"))
    spread = spread.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1)))
    tiles = spread.select("root", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "node", "v", "copies")

    def count(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        x, mine, copies = unit(rows.column("v").combine_chunks()), rows.column("mine").to_numpy(), rows.column("copies").to_numpy()
        same, found = key[1].as_py() == key[2].as_py(), np.zeros(len(x), np.int64)
        for at in range(0, len(x), 512):
            close = x[at : at + 512] @ x.T >= threshold
            if not same:
                close &= mine[at : at + 512, None] != mine[None]
            found[at : at + 512] = close @ copies
            if same:  # all but the copies of the vector itself
                own = np.arange(at, min(at + 512, len(x)))
                found[own] -= np.where(close[own - at, own], copies[own], 0)
        return pa.table({"node": rows.column("node"), "n": found})

    return tiles.groupBy("root", "i", "j").applyInArrow(count, "node long, n long").groupBy("node").agg(F.sum("n").alias("n"))


def embedding_duplicates(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vec_col: str = "embedding",
    threshold: float = 0.9,
    window: int = 64,
    passes: int | None = None,
    seed: int = 11,
) -> DataFrame:
    """``vectors`` with ``n_links long`` (other rows at cosine ``threshold`` or more that are in
    the same component), ``component_id long`` (smallest id reachable) and ``kept boolean``;
    columns of these names are replaced.

    Vectors that are null, empty, zero or hold null or non-finite components link with
    nothing, nor do rows with a null id, whose component is null; vectors of different lengths
    never link; the size of a vector, however extreme, plays no part. Rows with equal vectors,
    repeated rows among them, are linked. Rows that share an id are told apart by their vectors,
    each with its own links. Windows end at the borders of sorted partitions. ``passes`` fixes
    their number; by default it follows from the number of vectors and from what they find."""
    vectors = vectors.drop(*(c for c in ("n_links", "component_id", "kept") if c not in (id_col, vec_col)))
    key, vec = F.col(f"`{id_col}`").cast("long"), F.col(f"`{vec_col}`")
    sound = F.coalesce(F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    sound &= F.coalesce(F.exists(vec, lambda x: x != 0), F.lit(False)) & key.isNotNull()
    distinct = vectors.where(sound).groupBy(vec.alias("v")).agg(F.min(key).alias("id"), F.count("*").alias("copies"))
    distinct = materialize(distinct.withColumn("node", F.monotonically_increasing_id()), "vectors")
    roots = _linked(distinct, window, threshold, passes, seed)
    linked = materialize(distinct.join(roots, "node").select("root", "node", "id", "v", "copies"), "vectors")
    counted = _counts(linked.select("root", "node", "v", "copies"), threshold)
    least = materialize(linked.groupBy("root").agg(F.min("id").alias("least")), "vectors")
    named = (
        distinct.join(linked.select("node", "root"), "node", "left").join(counted, "node", "left").join(least, "root", "left")
        .select(F.col("v").alias("__v"), F.coalesce("least", "id").alias("__least"), (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("__n"))
    )
    met = vectors.withColumn("__sound", sound)
    out = met.join(materialize(named, "vectors"), F.col("__sound") & (vec == F.col("__v")), "left")
    own = F.when(F.col("__sound"), F.col("__least")).otherwise(key)
    return (
        out.withColumn("n_links", F.coalesce("__n", F.lit(0)).cast("long"))
        .withColumn("component_id", own)
        .withColumn("kept", F.coalesce(key == F.col("component_id"), F.lit(False)))
        .drop("__v", "__least", "__n", "__sound")
    )
