"""Operator 2: SimHash near-duplicates by anchor-point covering.

The 64 bits are cut into blocks, and the anchors are the words of a product of repetition
codes: all-zero or all-one in each block. A repetition code of odd length is perfect, so
every fingerprint has exactly one anchor within the covering radius, its *home*: the
majority in each block. If x and y differ in at most t bits, the home of x is an anchor
within covering radius plus t of y, counted block by block. So y is copied to every such
anchor, x is kept at home only, and they meet there. Equal fingerprints are one row.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import components, materialize, once, shuffled, texts_of


def _shingle_hashes(found: list[bytes], words: int) -> np.ndarray:
    """Big-endian XXH64 hashes (seed 42) of the shingles of a text's words, repeats included."""
    from xxhash import xxh64_intdigest

    if len(found) < words:
        grams: Iterator[bytes] = iter([b" ".join(found)])
        n = 1
    else:
        grams, n = map(b" ".join, zip(*(found[k:] for k in range(words)))), len(found) - words + 1
    return np.fromiter(map(xxh64_intdigest, grams, repeat(42)), ">u8", n)


def _majority(hashes: np.ndarray) -> int:
    n = len(hashes)
    if n < 64:
        ones = np.unpackbits(hashes.view(np.uint8).reshape(n, 8), axis=1).sum(0)
    else:
        octets = np.arange(256, dtype=np.uint8)
        table = np.unpackbits(octets[:, None], axis=1).astype(np.int64)
        counts = [np.bincount(hashes.view(np.uint8)[k::8], minlength=256) @ table for k in range(8)]
        ones = np.concatenate(counts)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprint(text: bytes, words: int) -> int:
    """Unsigned 64-bit SimHash of a text's word shingles, repeats included; 0 without words.
    A bit is set if it is in more than half of the XXH64 hashes (seed 42)."""
    found = text.lower().split()  # bytes: A-Z and ASCII white space only
    return _majority(_shingle_hashes(found, words)) if found else 0


BANDS, LEAST = 20, 5
_draw = np.random.default_rng(8)
_turn, _factor = _draw.integers(0, 1 << 32, (2, BANDS * LEAST), dtype=np.uint32)
_factor |= np.uint32(1)
_fold = _draw.integers(0, 1 << 63, (BANDS, LEAST + 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def band_keys(distinct: np.ndarray) -> np.ndarray:
    """A key for each of BANDS groups of LEAST least hashes of distinct shingle hashes. Sets at
    Jaccard j share a key with probability 1 - (1 - j**LEAST)**BANDS: 0.9996 at 0.8."""
    short, least = distinct.astype(np.uint32), np.full(BANDS * LEAST, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(short), 1024):
        np.minimum(least, ((short[at : at + 1024, None] ^ _turn) * _factor).min(0), out=least)
    x = (least.reshape(BANDS, LEAST).astype(np.uint64) * _fold[:, :-1]).sum(1, dtype=np.uint64) + _fold[:, -1]
    return (x ^ (x >> np.uint64(32))) * _fold[0, 0]


def simhash(text, words: int = 3):
    """Column of fingerprints as (signed) longs; null text has no words. A very long text is taken
    whole, its shingles hashed some at a time; only the column given is read."""

    def hashed(column: pa.Array) -> pa.Array:
        return pa.array(np.array([fingerprint(x, words) for x in texts_of(column)], np.uint64).view(np.int64))

    return once(hashed, "long")(text)


def _blocks(width: int) -> list[tuple[int, int]]:
    """Odd blocks of 64 bits: (first bit, bits)."""
    found, at = [], 0
    while at < 64:
        n = min(width, 64 - at)
        n -= n % 2 == 0
        found.append((at, n))
        at += n
    return found


def _flips(prints: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Home of each fingerprint, one bit a block, and how many bits turn each block's majority."""
    home, cost = np.zeros(len(prints), np.int64), []
    for k, (at, n) in enumerate(_blocks(width)):
        part = (prints >> np.uint64(at)) & np.uint64((1 << n) - 1)
        ones = np.bitwise_count(part).astype(np.int64)
        major = ones > n // 2
        home |= major.astype(np.int64) << k
        cost.append(np.where(major, ones - n // 2, n // 2 + 1 - ones))
    return home, np.array(cost)


def replicas(prints: np.ndarray, bits: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(index of fingerprint, anchor) for every anchor within covering radius plus ``bits``."""
    home, cost = _flips(prints, width)
    index, anchor, spent, last = [np.arange(len(prints))], [home], [np.zeros(len(prints), np.int64)], [np.full(len(prints), -1)]
    i, a, s, top = index[0], anchor[0], spent[0], last[0]
    while len(i):
        more = [[], [], [], []]
        for k in range(len(cost)):
            now = s + cost[k][i]
            ok = np.flatnonzero((now <= bits) & (top < k))
            for to, x in zip(more, (i[ok], a[ok] ^ (1 << k), now[ok], np.full(len(ok), k))):
                to.append(x)
        i, a, s, top = map(np.concatenate, more)
        index.append(i)
        anchor.append(a)
    return np.concatenate(index), np.concatenate(anchor)


COPY = 100  # what a copy that is shuffled costs, in comparisons


def copies_of(bits: int, width: int) -> float:
    """Anchors, on average, within covering radius plus ``bits`` of a random fingerprint."""
    ways = np.zeros(bits + 1)
    ways[0] = 1
    for _, n in _blocks(width):
        turns = np.zeros(bits + 1)
        turns[0] = 1
        for ones in range(n // 2 + 1, n + 1):
            if ones - n // 2 <= bits:
                turns[ones - n // 2] += 2 * math.comb(n, ones) / 2**n
        ways = np.convolve(ways, turns)[: bits + 1]
    return float(ways.sum())


def width_for(prints: int, bits: int, near: int = 0) -> int:
    """The odd width of blocks with the least work: copies, and comparisons of each copy with the
    fingerprints that are at home at its anchor. For 2 bits that is width 5, 2 ** 14 anchors, up
    to about three million fingerprints, then width 3, 2 ** 22 anchors, up to some 10 ** 9."""

    def work(width: int) -> float:
        homes = copies_of(near, width) if near else 1
        return copies_of(bits - near, width) * (COPY + prints * homes / 2 ** len(_blocks(width))) + COPY * homes

    return min((1, 3, 5), key=work)


def covering_links(prints: DataFrame, bits: int = 2, width: int | None = None, near: int = 0) -> DataFrame:
    """``x, y`` (x < y) for all pairs at ``bits`` or fewer differing bits of a table with one
    column ``fp`` of distinct fingerprints. Exact for any ``bits`` and odd ``width``; wider
    blocks make fewer anchors and fewer copies, but more comparisons at each, so the number of
    fingerprints decides (``width_for``) where ``width`` is not given.

    With two more long columns, the least and the greatest of groups that a fingerprint's rows
    are in, pairs within one group are left out where they meet, so that a group of many near
    copies that is known already does not send out all its pairs.

    With ``near`` above 0, x goes to the anchors within covering radius plus ``near`` and y to
    those within covering radius plus ``bits - near``: some word between x and y has its home
    in both. That takes far fewer copies for larger ``bits``, but finds a pair more than once."""

    width = width or width_for(prints.count(), bits, near)
    kept = prints.columns[1:]

    def copies(bits):
        return lambda batches: _copies(batches, bits, width)

    def copied(bits: int, *names: str) -> DataFrame:
        shape = "anchor long, fp long" + "".join(f", {c} long" for c in kept)
        return prints.mapInArrow(copies(bits), shape).toDF("anchor", *names)

    close = (F.col("x") < F.col("y")) & (F.bit_count(F.col("x").bitwiseXOR(F.col("y"))) <= bits)
    if kept:
        close &= (F.col("xa") != F.col("ya")) | (F.col("xa") != F.col("xb")) | (F.col("ya") != F.col("yb"))
    mine, theirs = (["x", "xa", "xb"], ["y", "ya", "yb"]) if kept else (["x"], ["y"])
    homes = copied(near, *mine) if near else prints.select(_home("fp", width).alias("anchor"), *prints.columns).toDF("anchor", *mine)
    spread = copied(bits - near, *theirs)
    found = homes.join(shuffled(spread), (homes.anchor == spread.anchor) & close).select("x", "y")
    return found.distinct() if near else found


def _copies(batches: Iterator[pa.RecordBatch], bits: int, width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 4096):
            some = batch.slice(at, 4096)
            i, anchor = replicas(some.column(0).to_numpy(zero_copy_only=False).view(np.uint64), bits, width)
            rows = some.take(pa.array(i))
            yield pa.RecordBatch.from_arrays([pa.array(anchor), *rows.columns], names=["anchor", *rows.schema.names])


def _home(fp: str, width: int):
    return sum(
        F.when(F.bit_count(F.shiftrightunsigned(fp, at).bitwiseAND(F.lit((1 << n) - 1))) > n // 2, F.lit(1 << k)).otherwise(F.lit(0))
        for k, (at, n) in enumerate(_blocks(width))
    ).cast("long")


def simhash_components(rows: DataFrame, id_col: str, fp_col: str, bits: int = 2, width: int | None = None, near: int = 0) -> DataFrame:
    """Add ``component_id``: the smallest id reachable over fingerprints that differ in ``bits``
    or fewer bits; a column of that name is replaced. Rows with equal fingerprints, repeated
    rows and all empty texts among them, are linked; a null id joins its component but never
    names it; an empty table gives an empty one."""
    rows = materialize(rows if "component_id" in (id_col, fp_col) else rows.drop("component_id"), "simhash")
    firsts = materialize(rows.groupBy(F.col(fp_col).alias("fp")).agg(F.min(id_col).alias("first")), "simhash")
    links = covering_links(firsts.select("fp"), bits, width, near)
    roots = components(links.select(F.col("x").alias("u"), F.col("y").alias("v")), "simhash")
    firsts = firsts.join(shuffled(roots), firsts.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    # Fingerprints of one component are few beside its rows, and their minimum is a partial aggregate.
    firsts = materialize(firsts, "simhash")
    least = firsts.groupBy("root").agg(F.min("first").alias("component_id"))
    named = firsts.join(shuffled(least), "root").select(F.col("fp").alias("__fp"), "component_id")
    return rows.join(shuffled(named), rows[fp_col] == named["__fp"]).drop("__fp")


def near_copies(docs: DataFrame, words: int = 5, similarity: float = 0.8, bits: int = 3, id_col="doc_id", text_col="text") -> DataFrame:
    """``id, first``: documents to drop, each with the smallest id of its group. Groups are the
    components over pairs of texts that share ``similarity`` or more (Jaccard) of their distinct
    word shingles; every link is checked on the texts, so one that agrees by chance drops nothing.

    Equal texts (but for case and white space) are one node from the start. Nodes meet where
    their fingerprints differ in ``bits`` or fewer bits or where they share a key of
    ``band_keys``. Each is first compared with one node of every key it has, its fingerprint
    among them, that which meets most others over all its keys. Nodes of keys that this leaves in
    several components are compared where they share one of their rarest shingles
    (``_prefix_pairs``), and by the covering nodes of near fingerprints, if they are not in one
    component yet. Null ids are never dropped; an id with several texts goes only if it is first
    for none of them."""
    spark = docs.sparkSession
    key = F.col(f"`{id_col}`").cast("long").alias("id")
    text = F.col(f"`{text_col}`").alias("text")
    rows = docs.where(key.isNotNull()).select(key, text_keys(text, words).alias("s")).select("id", "s.*")
    rows = materialize(rows, "simhash")
    nodes = rows.groupBy("node").agg(F.min("id").alias("first"), F.min("fp").alias("fp"), F.min("n").alias("n"), F.first("keys").alias("keys"))
    nodes = materialize(nodes, "simhash")
    info = nodes.select("node", "first", "n", "fp")

    members = nodes.select("node", "n", F.explode(F.concat("keys", F.array(F.xxhash64("fp")))).alias("key"))
    shared = members.groupBy("key").agg(F.count("*").alias("many")).where("many > 1")
    members = materialize(members.join(shuffled(shared), "key"), "simhash")
    # What the others of a key are copies of shares most keys with most nodes, so it leads.
    degree = members.groupBy("node").agg(F.sum("many").alias("degree"))
    leads = members.join(shuffled(degree), "node").groupBy("key").agg(F.max_by("node", F.struct("degree", "node")).alias("lead"))
    members = materialize(members.drop("many").join(shuffled(leads), "key"), "simhash")
    tried = materialize(_ordered(members.select(F.col("node").alias("u"), F.col("lead").alias("v"))), "simhash")
    links = _verified(docs.select(key, text), info, tried, words, similarity)

    roots = materialize(components(links, "simhash"), "simhash")
    rooted = info.join(shuffled(roots), "node", "left").select("node", "first", "n", "fp", F.coalesce("root", "node").alias("root"))
    rooted = materialize(rooted, "simhash")
    prints = materialize(rooted.groupBy("fp").agg(F.min("root").alias("lo"), F.max("root").alias("hi")), "simhash")
    near = materialize(covering_links(prints, bits, near=bits // 2), "simhash")
    members = members.select("key", "node").join(shuffled(rooted), "node")
    mixed = members.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi")
    met = members.join(shuffled(mixed), "key", "left_semi").select("node", "first", "n", "root").distinct()
    within = _prefix_pairs(docs.select(key, text), materialize(met, "simhash"), words, similarity)
    fits = (F.col("root") != F.col("root2")) & (F.least("n", "n2") >= similarity * F.greatest("n", "n2"))
    left = near.join(shuffled(rooted.select(F.col("fp").alias("x"), F.col("node").alias("u"), "n", "root")), "x")
    right = rooted.select(F.col("fp").alias("y2"), F.col("node").alias("v"), F.col("n").alias("n2"), F.col("root").alias("root2"))
    across = left.join(shuffled(right), (F.col("y") == F.col("y2")) & fits).select("u", "v")
    rest = _ordered(within.unionByName(across)).join(shuffled(tried), ["u", "v"], "left_anti")
    rest = materialize(rest, "simhash")
    if rest.limit(1).count():
        more = _verified(docs.select(key, text), info, rest, words, similarity)
        if more.limit(1).count():
            roots = components(links.unionByName(more), "simhash")
    named = materialize(info.join(shuffled(roots), "node", "left").select("node", "first", F.coalesce("root", "node").alias("root")), "simhash")
    least = named.groupBy("root").agg(F.min("first").alias("first"))
    named = named.select("node", "root").join(shuffled(least), "root").select("node", "first")
    gone = rows.select("id", "node").join(shuffled(named), "node").groupBy("id").agg(F.min("first").alias("first"), F.max(F.col("id") == F.col("first")).alias("leads"))
    return materialize(gone.where("not leads").select("id", "first"), "simhash")


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()


def _texts_of_nodes(texts: DataFrame, wanted: DataFrame) -> DataFrame:
    """``node, text`` of the ``wanted`` rows ``node, id``; a node has one of its equal texts."""
    # An id may have several texts, and a text several rows.
    texts = texts.join(shuffled(wanted.select("id").distinct()), "id", "left_semi").select(text_node(F.col("text")).alias("node"), "text")
    return materialize(texts.join(shuffled(wanted), "node", "left_semi").dropDuplicates(["node"]), "simhash")


def _prefix_pairs(texts: DataFrame, nodes: DataFrame, words: int, similarity: float) -> DataFrame:
    """``u, v`` (u < v): a superset of the pairs of ``nodes`` (``node, first, n, root``) that have
    different roots and share ``similarity`` or more (Jaccard) of their distinct shingles.

    In one order of all shingles, rarest first, two such texts of n shingles share one of their
    first ``n - ceil(similarity * n) + 1``, and at the first one shared enough shingles follow in
    both. A passage that many texts hold comes last in each, so it brings none of them together
    unless little else is in them. Shingles of one node alone take places, but no rows."""

    def hashed(column: pa.Array) -> pa.Array:
        found = [x.lower().split() for x in texts_of(column)]
        sets = [np.unique(_shingle_hashes(x, words).astype(np.uint64)).view(np.int64) if x else np.zeros(0, np.int64) for x in found]
        ends = np.cumsum([0, *map(len, sets)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets) if sets else np.zeros(0, np.int64)))

    found = _texts_of_nodes(texts, nodes.select("node", F.col("first").alias("id")))
    held = found.select("node", F.explode(once(hashed, "array<long>")("text")).alias("h"))
    many = held.groupBy("h").agg(F.count("*").alias("many")).where("many > 1")
    each = Window.partitionBy("node")
    placed = held.join(shuffled(many), "h").select("node", "h", F.count("*").over(each).alias("shared"), F.row_number().over(each.orderBy("many", "h")).alias("k"))
    placed = placed.join(shuffled(nodes.select("node", "n", "root")), "node").withColumn("k", F.col("n") - F.col("shared") + F.col("k"))
    slack = 1 - 1e-12  # products like 0.8 * n may end just above a whole number
    placed = placed.where(F.col("k") <= F.col("n") - F.ceil(F.col("n") * (similarity * slack)) + 1)
    placed = materialize(placed.select("h", "node", "n", "root", "k"), "simhash")
    one, other = placed.toDF("h", "u", "n", "root", "k"), placed.toDF("h2", "v", "n2", "root2", "k2")
    fits = (F.col("root") != F.col("root2")) & (F.least("n", "n2") >= similarity * F.greatest("n", "n2"))
    follow = 1 + F.least(F.col("n") - F.col("k"), F.col("n2") - F.col("k2"))
    enough = follow >= (F.col("n") + F.col("n2")) * (similarity / (1 + similarity) * slack)
    return one.join(shuffled(other), (F.col("h") == F.col("h2")) & (F.col("u") < F.col("v")) & fits & enough).select("u", "v")


def _verified(texts: DataFrame, info: DataFrame, pairs: DataFrame, words: int, similarity: float) -> DataFrame:
    """Those of the pairs ``u, v`` of nodes whose texts share enough shingles."""
    one, other = info.select("node", "first", "n").toDF("u", "first", "n"), info.select("node", "first", "n").toDF("v", "first2", "n2")
    pairs = pairs.join(shuffled(one), "u").join(shuffled(other), "v").where(F.least("n", "n2") >= similarity * F.greatest("n", "n2"))
    pairs = materialize(pairs, "simhash")
    wanted = pairs.select(F.col("u").alias("node"), F.col("first").alias("id")).unionByName(pairs.select(F.col("v").alias("node"), F.col("first2").alias("id"))).distinct()
    texts = _texts_of_nodes(texts, materialize(wanted, "simhash"))

    def alike(a: pa.Array, b: pa.Array) -> pa.Array:
        out, last = [], (None, None)
        for x, y in zip(texts_of(a), texts_of(b)):
            if last[0] != x:
                last = x, shingles(x, words)
            mine, other = last[1], shingles(y, words)
            out.append(len(mine & other) >= similarity * len(mine | other))
        return pa.array(out, pa.bool_())

    met = pairs.select("u", "v").join(shuffled(texts.toDF("v", "b")), "v").join(shuffled(texts.toDF("u", "a")), "u")
    return materialize(met.where(once(alike, "boolean")("a", "b")).select("u", "v"), "simhash")


def _node(found: list[bytes]) -> int:
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(b" ".join(found), 7)


def text_node(text):
    """Column of hashes of a text's words; texts that differ only in case or white space agree."""

    def hashed(column: pa.Array) -> pa.Array:
        return pa.array(np.array([_node(x.lower().split()) for x in texts_of(column)], np.uint64).view(np.int64))

    return once(hashed, "long")(text)


def text_keys(text, words: int):
    """Column of ``node`` (``text_node``), ``fp`` (``simhash``), ``n`` (distinct shingles) and
    ``keys`` (``band_keys``)."""

    def keyed(column: pa.Array) -> pa.Array:
        node, fp, n, keys = [], [], [], []
        for x in texts_of(column):
            found = x.lower().split()
            hashes = _shingle_hashes(found, words) if found else np.zeros(0, ">u8")
            distinct = np.unique(hashes.astype(np.uint64))
            node.append(_node(found))
            fp.append(_majority(hashes) if found else 0)
            n.append(len(distinct))
            keys.append(band_keys(distinct).view(np.int64))
        longs = [pa.array(np.array(v, np.uint64).view(np.int64)) for v in (node, fp)]
        flat = pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64))
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(keys) + 1, dtype=np.int32) * BANDS), flat)
        return pa.StructArray.from_arrays([*longs, pa.array(n, pa.int32()), lists], names=["node", "fp", "n", "keys"])

    return once(keyed, "node long, fp long, n int, keys array<long>")(text)


def shingles(text: bytes, words: int) -> set[bytes]:
    found = text.lower().split()
    if len(found) < words:
        return {b" ".join(found)} if found else set()
    return set(map(b" ".join, zip(*(found[k:] for k in range(words)))))
