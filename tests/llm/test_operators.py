"""The training-data operators against brute force, with nulls, empty and repeated rows."""

import base64
import bisect
import hashlib
import re
import tracemalloc
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillion.llm import decontaminate, embeddings, packing, quality, simhash, suffix_dedup, token_counts, token_files, toxicity, warc
from quillion.llm.common import components
from quillion.llm.range_coder import HEAD, MOST, CorruptBlock, decode_blocks, encode_blocks
from quillion.llm.tokens import WordEncoder, public_path

VOCAB = public_path("word_bpe_49k.json")
PASSAGE = "the quick brown fox jumps over the lazy dog while twelve green birds sing of summer rain and nobody minds"
TEXTS = [
    PASSAGE + " first ending here", "intro words " + PASSAGE + " other ending", "", None, "   ", "Tiny", "tiny",
    "Ünïcödé wörds ÀÉ — naïve café 東京 𝒳 'll don't <|endoftext|> <|ENDOFTEXT|> é H̱ İ Σς", "ab" * 300, "x " * 2000 + PASSAGE,
    PASSAGE + " first ending here", "trash idiot " + PASSAGE,
]
SCHEMA = "doc_id long, text string, spans string, id int, fp string, component_id string"


@pytest.fixture(scope="module")
def docs(spark):
    """Null id, repeated row, extra columns with names that operators use themselves."""
    rows = [(i, t, "s", 1, "f", "c") for i, t in enumerate(TEXTS)] + [(None, "no id", "s", 1, "f", "c"), (5, "Tiny", "s", 1, "f", "c")]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_range_coder_round_trip():
    rng = np.random.default_rng(0)
    for sizes in ([0], [1], [5, 0, 3], [300] * 5, [2048, 7], [2500]):
        for top in (1, 2, 300, 49408):
            blocks = [rng.integers(0, top, n) for n in sizes]
            coded = encode_blocks(blocks, 49408)
            assert all(np.array_equal(a, b) for a, b in zip(blocks, decode_blocks(coded, 49408), strict=True))
            assert all(np.array_equal(a, decode_blocks([c], 49408)[0]) for a, c in zip(blocks, coded))  # each block alone
    for bad in range(4 * HEAD, 40, 5):
        data = bytearray(encode_blocks([rng.integers(0, 99, 50)], 100)[0])
        data[bad] ^= 1
        with pytest.raises(CorruptBlock):
            decode_blocks([bytes(data)], 100)
    assert decode_blocks(encode_blocks([np.array([70000, 3])], 100_000), 100_000)[0].tolist() == [70000, 3]
    with pytest.raises(ValueError):
        encode_blocks([np.zeros(MOST + 1, np.int64)], 100)


def test_range_coder_predicts_ids():
    """Blocks of 2048 ids of prose, coded apart, beat adaptive counts of ids and a general packer."""
    texts = duckdb.sql("select text from '/root/testdata/sf0.01/documents.parquet' order by doc_id limit 300").fetchall()
    ids = np.array([i for x in library_ids([t for (t,) in texts], 2) for i in x])
    bits = 8 * sum(map(len, encode_blocks([ids[k : k + 2048] for k in range(0, len(ids), 2048)], 49408))) / len(ids)
    assert bits < 8.8 < 8 * len(zlib.compress(ids.astype("<u2").tobytes())) / len(ids)
    again = np.tile(rng_ids := np.random.default_rng(1).integers(0, 49408, 64), 32)  # order 2 finds what repeats
    assert 8 * len(encode_blocks([again], 49408)[0]) / len(again) < 1.5 < np.log2(len(set(rng_ids.tolist()))) / 2


def test_range_coder_memory():
    """Blocks coded side by side take few bytes an id, so that a whole task's can be."""
    rng = np.random.default_rng(2)
    blocks, peaks = [rng.zipf(1.3, 2048) % 3000 for _ in range(200)], []
    for step, given in ((encode_blocks, blocks), (decode_blocks, encode_blocks(blocks, 49408))):
        tracemalloc.start()
        step(given, 49408)
        peaks.append(tracemalloc.get_traced_memory()[1] / (200 * 2048))
        tracemalloc.stop()
    assert max(peaks) < 28


def library_ids(texts, end=None):
    """Ids of whole texts, asked of the tokenizers library itself."""
    library = Tokenizer.from_file(VOCAB)
    return [x.ids + ([] if end is None else [end]) for x in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


PARTS = [
    "a", "The", "don't", "'s", "'LL", ".", ",", "..", "<|endoftext|>", "<|ENDOFTEXT|>", "<|", "|>", " ", "  ", "\n", "\t", "\x1c", "\x85", "\xa0",
    "\u2003", "\u3000", "é", "É", "İ", "Σ", "ς", "\u0301", "\u0331", "H\u0331", "東京", "—", "1", "23", "½", "\u200b", "ß", "ﬁ", "\x00", "🙂", "\r\n", "'", "-", "_",
]


@pytest.mark.parametrize("cache", [300_000, 40])
def test_tokens_are_the_librarys(cache):
    enc, rng = WordEncoder(VOCAB, cache), np.random.default_rng(1)
    made = ["".join(rng.choice(PARTS, rng.integers(0, 14))) for _ in range(4000)]
    for texts in (TEXTS, [], made[:2000], made[2000:]):
        ids, ends = enc.encode(pa.array(texts, pa.string()))
        assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:])] == library_ids(texts)
    assert enc.by_pieces and len(enc.words) <= max(cache, 9000)


def test_latin_words_go_to_the_model_alone(monkeypatch):
    """Only words that may be normalised or cut go through all of the library's steps."""
    enc, asked = WordEncoder(VOCAB), []
    library = enc._library
    monkeypatch.setattr(enc, "_library", lambda texts: asked.extend(texts) or library(texts))
    texts = ["çouré, leèê. Éa ÿàß, plain Words", "øre\u0301 naïve, çouré,", "ÀÉ.. x,y é.é ß. çouré."]
    ids, ends = enc.encode(pa.array(texts))
    assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:])] == library_ids(texts)
    assert set(asked) - set(".,") == {"øre\u0301", "ÀÉ..", "é.é"}


def test_tokens_of_other_vocabularies():
    path = public_path("byte_bpe_50k.json")  # keeps white space, so texts go whole
    ids, ends = WordEncoder(path).encode(pa.array(TEXTS, pa.string()))
    want = Tokenizer.from_file(path).encode_batch([t or "" for t in TEXTS], add_special_tokens=False)
    assert [ids[a:b].tolist() for a, b in zip(ends, ends[1:])] == [x.ids for x in want]


def test_token_files(spark, docs, empty):
    written = token_files.write_token_files(docs, VOCAB, 2, 49408, segment=500)
    got = token_files.read_token_files(written).sort(F.col("doc_id").asc_nulls_first(), "start").collect()
    start, order = 0, [(None, "no id")] + sorted([*enumerate(TEXTS), (5, "Tiny")], key=lambda x: x[0])
    for (i, t), r in zip(order, got, strict=True):
        ids = library_ids([t], 2)[0]
        assert (r.doc_id, r.start, r.n_tokens, bytes(r.ids)) == (i, start, len(ids), np.array(ids, "<u4").tobytes())
        start += len(ids)
    assert token_files.read_token_digests(token_files.write_token_files(empty, VOCAB, 2, 49408)).count() == 0


def test_packing(spark, docs, empty):
    got = packing.pack_documents(docs, VOCAB, 0, 64).toPandas().sort_values(["sequence_id", "offset"])
    assert len(set(got["id"].dropna())) == len(TEXTS)
    for _, g in got.groupby("sequence_id"):
        assert g["offset"].tolist() == [0, *g["length"].cumsum()[:-1]] and g["length"].sum() <= 64
    want = []
    for i, ids in zip([*range(len(TEXTS)), -1, 5], library_ids([*TEXTS, "no id", "Tiny"], 0)):
        want += [(i, k // 64, k, len(ids[k : k + 64]), crc(ids[k : k + 64])) for k in range(0, len(ids), 64)]
    assert sorted((int(i) if i == i else -1, p, at, n, c) for i, p, at, n, c in got[["id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False)) == sorted(want)
    assert packing.pack_documents(empty, VOCAB, 0, 64).count() == 0


def best_fit_one_by_one(lengths, capacity):
    gaps: list[int] = []
    for n in sorted((n for n, c in lengths.items() for _ in range(c)), reverse=True):
        at = bisect.bisect_left(gaps, n)
        left = gaps.pop(at) - n if at < len(gaps) else capacity - n
        bisect.insort(gaps, left)
    return len(gaps)


@pytest.mark.parametrize("case", ["mixed", "halves", "ties", "full", "tiny", "none"])
def test_best_fit_rounds(spark, case):
    rng = np.random.default_rng(3)
    lengths = {
        "mixed": {n: int(rng.integers(1, 40)) for n in range(1, 101)}, "halves": {50: 31, 51: 7, 49: 7}, "ties": {40: 500, 30: 1, 7: 300},
        "full": {100: 9}, "tiny": {1: 1000}, "none": {},
    }[case]
    table = spark.createDataFrame(list(lengths.items()), "length long, n long")
    placed, fill, ranks = packing.best_fit_rounds(table, 100).collect(), {}, {n: [] for n in lengths}
    for r in sorted(placed, key=lambda r: -r.size):
        ranks[r.length] += range(r["rank"], r["rank"] + r.n)
        for k in range(r.sequence, r.sequence + r.n):
            assert fill.get(k, 0) == 100 - r.size  # no gap between pieces, and no overlap
            fill[k] = 100 - r.size + r.length
    assert all(sorted(v) == list(range(lengths[n])) for n, v in ranks.items())
    assert max(fill.values(), default=0) <= 100 and sorted(fill) == list(range(len(fill)))
    assert len(fill) <= 1.06 * best_fit_one_by_one(lengths, 100) + 1


@pytest.mark.parametrize("lengths", [{10: 20_000}, {100: 5000}, {127: 3000, 60: 6000, 30: 9000}, {700: 300, 100: 2000}, {2048: 3, 1: 1, 2047: 2}, {900: 500, 11: 90_000, 3: 7}])
def test_short_pieces_fill_sequences(spark, lengths):
    table = spark.createDataFrame(list(lengths.items()), "length long, n long")
    placed, best = packing.bundled_rounds(table, 2048).collect(), best_fit_one_by_one(lengths, 2048)
    used = 1 + max(r.sequence + r.n - 1 for r in placed)
    assert sum(r.n * r.times for r in placed) == sum(lengths.values())
    assert used <= 1.02 * best + 1
    taken = np.zeros(used)
    for r in placed:
        taken[r.sequence : r.sequence + r.n] += r.length * r.times
    assert taken.max() <= 2048 and taken.sum() == sum(n * c for n, c in lengths.items())


def test_simhash(spark, docs, empty):
    rows = docs.select("doc_id", simhash.simhash(F.col("text"), 3).alias("__f"), "fp", "component_id").drop("component_id")
    got = simhash.simhash_components(rows, "doc_id", "__f").toPandas()
    by = {i: (f, c) for i, f, c in got[["doc_id", "__f", "component_id"]].itertuples(index=False) if i == i}
    assert by[0][1] == by[10][1] == 0 and by[2] == by[3] == by[4] == (0, 2.0) and by[6][1] == by[5][1] == 5
    assert simhash.simhash_components(empty.select("doc_id", F.lit(1).cast("long").alias("__f")), "doc_id", "__f").count() == 0
    assert {(r.id, r.first) for r in simhash.near_copies(docs).collect()} >= {(10, 0), (3, 2), (4, 2), (6, 5)}


def test_copies_far_from_the_first_leave_one(spark):
    words = [f"word{i}" for i in range(2000)]
    chain = []
    for k in range(121):  # neighbours share nearly all shingles, the ends fewer than 0.8
        words[k * 16] = "other"
        chain.append((k, " ".join(words)))
    docs = spark.createDataFrame([*chain, (500, chain[-1][1]), (501, chain[-1][1] + " more")], "doc_id long, text string")
    gone = {r.id: r["first"] for r in simhash.near_copies(docs).collect()}
    assert 0 not in gone and {500, 501} <= set(gone)
    assert len(gone) == 122 and set(gone.values()) == {0}


def test_near_copies_reach_the_threshold(spark):
    rng = np.random.default_rng(6)
    texts = []
    for k in range(60):  # one text and one with some of its words changed, at Jaccard 0.8 to 1 or below
        words = [f"w{k}x{j}" for j in range(300)]
        texts.append(" ".join(words))
        for at in rng.choice(300, 1 + k % 8, replace=False):
            words[at] = "changed"
        texts.append(" ".join(words))
    sets = [simhash.shingles(t.encode(), 5) for t in texts]
    near = [len(a & b) / len(a | b) for a, b in zip(sets[::2], sets[1::2])]
    assert sum(0.8 <= j < 0.9 for j in near) > 15 and min(near) < 0.8
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    gone = {(r.id, r["first"]) for r in simhash.near_copies(docs).collect()}
    assert gone == {(2 * k + 1, 2 * k) for k, j in enumerate(near) if j >= 0.8}


@pytest.mark.parametrize(("bits", "width", "near"), [(2, 5, 0), (3, 5, 1), (2, 3, 0), (4, 7, 2)])
def test_covering_links_are_complete(spark, bits, width, near):
    rng = np.random.default_rng(bits)
    base = rng.integers(0, 1 << 63, 60, dtype=np.int64)
    flipped = [int(b) ^ sum(1 << int(k) for k in rng.choice(63, rng.integers(0, bits + 2), replace=False)) for b in base for _ in range(3)]
    prints = sorted({*map(int, base), *flipped})
    want = {(x, y) for i, x in enumerate(prints) for y in prints[i + 1 :] if (x ^ y).bit_count() <= bits}
    got = simhash.covering_links(spark.createDataFrame([(p,) for p in prints], "fp long"), bits, width, near)
    assert {tuple(r) for r in got.collect()} == want


@pytest.mark.parametrize("near", [0, 1])
def test_copies_of_fingerprints_are_not_broadcast(spark, near, tmp_path):
    # Spark takes copies, some 67 a fingerprint, for as large as the fingerprints.
    spark.range(2000).selectExpr("xxhash64(id) as fp").write.parquet(f"{tmp_path}/prints")
    links = simhash.covering_links(spark.read.parquet(f"{tmp_path}/prints"), 2, width=5, near=near)
    assert "Broadcast" not in links._jdf.queryExecution().executedPlan().toString()


def test_spans_of_many_documents_are_not_broadcast(spark, tmp_path):
    docs = spark.createDataFrame([(i, PASSAGE * 2) for i in range(40)], "doc_id long, text string")
    plan = suffix_dedup.repeated_spans(docs, 100)._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 101), (7, 7), (None, 3), (200, 150), (150, 101)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 150: 100, 200: 100}


def test_decontamination(spark, docs, empty):
    bench = spark.createDataFrame([(1, PASSAGE.upper()), (2, "tiny"), (3, ""), (4, None), (None, PASSAGE), (10, "brown fox jumps")], "item_id long, text string")
    words, low = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+"), lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x or "")
    windows: dict = {}
    for r in bench.where("item_id is not null").collect():
        w = words.findall(low(r.text))
        for k in range(max(1, len(w) - 12) if w else 0):
            windows.setdefault(tuple(w[k : k + 13]), set()).add(str(r.item_id))
    for block in (4_000_000, 40):
        got = decontaminate.contamination(docs.select("doc_id", "text", "id"), bench, block_bytes=block)
        for r in got.withColumn("hit", decontaminate.span_words(F.col("spans"))).collect():
            w, hit, items = words.findall(low(r.text)), set(), set()
            for n in {len(x) for x in windows}:
                for k in range(len(w) - n + 1):
                    if found := windows.get(tuple(w[k : k + n])):
                        hit.update(range(k, k + n))
                        items |= found
            assert (r.n_words, r.hit, r["items"]) == (len(w), len(hit), sorted(items))
    assert decontaminate.contamination(docs.select("doc_id", "text"), bench.limit(0)).where("size(items) > 0").count() == 0
    assert decontaminate.contamination(empty.select("text"), bench).count() == 0


def test_suffix_array_repeats():
    rng = np.random.default_rng(3)
    for _ in range(60):
        texts = [bytes(rng.integers(97, 97 + rng.integers(1, 4), rng.integers(0, 30)).astype(np.uint8)) for _ in range(rng.integers(1, 5))]
        raw, ends = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        seen: dict = {}
        for t, text in enumerate(texts):
            for i in range(len(text)):
                for j in range(i + 3, len(text) + 1):
                    seen.setdefault(text[i:j], []).append((t, i))
        want = set()
        for w, at in seen.items():
            left = {texts[t][i - 1] if i else ("start", t) for t, i in at}
            right = {texts[t][i + len(w)] if i + len(w) < len(texts[t]) else ("end", t) for t, i in at}
            if len(at) > 1 and len(left) > 1 and len(right) > 1:
                want.add((len(w), tuple(sorted(int(ends[t]) + i for t, i in at))))
        assert {(n, tuple(sorted(map(int, p)))) for p, n in suffix_dedup.maximal_repeats(raw, ends, 3)} == want


@pytest.mark.parametrize("hot", [10_000, 1])
def test_repeated_spans(spark, docs, empty, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    monkeypatch.setattr(suffix_dedup, "HELD", 1000 if hot > 1 else 3)
    monkeypatch.setattr(suffix_dedup, "PIECE", 1500)  # longer texts are hashed in pieces
    rng = np.random.default_rng(5)
    shared = "".join(chr(97 + c) for c in rng.integers(0, 3, 400))
    more = [(100 + k, shared[a:b] + f" {k} é " + shared[c:], "s", 1, "f", "c") for k, (a, b, c) in enumerate([(0, 250, 300), (100, 399, 200), (50, 90, 0), (0, 400, 400)])]
    edge = "".join(chr(97 + c) for c in rng.integers(0, 26, 180))  # shared by many, each time with other bytes around
    more += [(200 + k, "".join(chr(65 + c) for c in rng.integers(0, 26, 90)) + edge + str(k) * 60, "s", 1, "f", "c") for k in range(25)]
    table = docs.where("doc_id is null or doc_id <> 5").unionByName(spark.createDataFrame(more, SCHEMA))
    got = suffix_dedup.repeated_spans(table).withColumn("d", suffix_dedup.span_digest(F.col("text"), F.col("spans")))
    seen: set = set()
    for r in got.sort(F.col("doc_id").asc_nulls_first()).collect():
        data = (r.text or "").encode()
        cover = bytearray(len(data))
        for k in range(len(data) - 99):
            if data[k : k + 100] in seen:
                cover[k : k + 100] = b"\1" * 100
            seen.add(data[k : k + 100])
        kept = bytes(c for c, gone in zip(data, cover) if not gone)
        runs = len(re.findall(b"\1+", bytes(cover)))
        assert (r.d.n_bytes, r.d.n_removed, r.d.n_spans, r.d.kept_sha256) == (len(data), sum(cover), runs, hashlib.sha256(kept).hexdigest())
    assert suffix_dedup.repeated_spans(empty.select("doc_id", "text")).count() == 0
    twice = spark.createDataFrame([(1, shared), (1, shared)], "doc_id long, text string")
    assert [r.spans for r in suffix_dedup.repeated_spans(twice).collect()] == [[], []]


def test_warc(spark):
    rows = [(3, "http://a/ b", "same é"), (1, None, "same é"), (2, "u", ""), (7, "u", None), (4, "u", "long é\r\n\r\n" * 5000), (None, "u", "same é"), (5, "u", "once")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    path = warc.write_warc(pages, segment=4096, chunk=1000)
    records = warc.read_warc(spark, path)
    got = {r.page_id: r for r in warc.warc_digests(records).collect()}
    for page, _, html in rows:
        data = (html or "").encode()
        assert (got[page].payload_bytes, got[page].payload_digest) == (len(data), base64.b32encode(hashlib.sha1(data).digest()).decode())
    assert {i: (r.record_type, r.refers_to) for i, r in got.items() if r.refers_to} == {3: ("revisit", 1), 7: ("revisit", 2), None: ("revisit", 1)}
    assert bytes(records.where("page_id = 4").first().payload) == rows[4][2].encode()
    big = warc.warc_digests(warc.read_warc(spark, warc.write_warc(pages, min_bytes=5)))
    assert big.where("record_type = 'revisit'").count() == 2
    assert warc.read_warc(spark, warc.write_warc(pages.limit(0))).count() == 0
    with pytest.raises(ValueError):
        warc.unframe(b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n5\r\nab\r\n0\r\n\r\n")


def vector_truth(x, threshold=0.9):
    unit = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    close = unit @ unit.T >= threshold
    root = np.arange(len(x))
    while True:
        new = np.where(close, root[None], len(x)).min(1)
        if (new == root).all():
            return close.sum(1) - 1, root
        root = new


def test_embeddings(spark):
    rng = np.random.default_rng(2)
    centre = rng.normal(size=(20, 16))
    x = np.concatenate([centre, centre[:5] + 0.05 * rng.normal(size=(5, 16)), centre[[0] * 90] + 0.02 * rng.normal(size=(90, 16)), centre[:2]]).astype(np.float32)
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)]
    odd = [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] * 16, 1), (903, [1.0, None], 1), (904, [], 1), (None, x[0].tolist(), 1), (905, [1.0, 2.0], 1)]
    table = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>, n_links int").repartition(3)
    got = {r.vec_id: r for r in embeddings.embedding_duplicates(table, window=32).collect() if r.vec_id is not None}
    links, root = vector_truth(x)
    assert [(got[i].n_links, got[i].component_id, got[i].kept) for i in range(len(x))] == [(int(links[i]), int(root[i]), int(root[i]) == i) for i in range(len(x))]
    assert all((got[i].n_links, got[i].component_id) == (0, i) for i in (900, 901, 902, 903, 904, 905))
    assert embeddings.embedding_duplicates(table.limit(0)).count() == 0


def test_vectors_that_share_an_id_or_are_of_extreme_size(spark):
    e = np.eye(4)
    rows = [(1, e[0]), (1, e[1]), (2, e[0] * 1e200), (3, e[1] * 1e-300), (4, e[1] + 0.01), (7, e[2]), (7, e[2])]
    table = spark.createDataFrame([(i, v.tolist()) for i, v in rows], "vec_id long, embedding array<double>")
    got = sorted((r.vec_id, r.embedding.index(max(r.embedding)), r.n_links, r.component_id) for r in embeddings.embedding_duplicates(table).collect())
    assert got == [(1, 0, 1, 1), (1, 1, 2, 1), (2, 0, 1, 1), (3, 1, 2, 1), (4, 1, 2, 1), (7, 2, 1, 7), (7, 2, 1, 7)]


def test_a_crowded_direction_hides_few_pairs(spark, monkeypatch):
    """3000 vectors at mutual cosines about 0.78, among them 40 pairs above 0.9."""
    rng, dim = np.random.default_rng(4), 64
    x = rng.normal(size=dim)[None] * 1.9 + rng.normal(size=(3000, dim))
    x = np.concatenate([x, x[:40] + 0.9 * rng.normal(size=(40, dim))])
    links, root = vector_truth(x)
    assert (links > 0).sum() >= 60 and links.max() < 20
    monkeypatch.setattr(embeddings, "TILE", 8)
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.embedding_duplicates(table).collect()}
    found = sum(got[i] == (links[i], root[i]) for i in range(len(x)) if links[i]) / (links > 0).sum()
    assert found >= 0.9 and all(got[i][0] <= links[i] for i in range(len(x)))


def test_token_counts(spark, docs):
    path = public_path("piece_bpe_32k.model")
    scores, byte_score = token_counts.unigram_scores(path)

    def brute(word):
        text = "▁" + word
        best = [(0.0, 0)]
        for end in range(1, len(text) + 1):
            n = len(text[end - 1].encode())
            options = [(best[end - 1][0] + n * byte_score, -(-best[end - 1][1] + n))]
            options += [(best[k][0] + scores[text[k:end]], best[k][1] - 1) for k in range(end) if text[k:end] in scores]
            best.append(max(options))
        return -best[-1][1]

    for r in docs.select("text", token_counts.token_counts(F.col("text"), path).alias("c")).collect():
        words = (r.text or "").split()
        assert (r.c.n_words, r.c.n_tokens) == (len(words), sum(brute(w) for w in words))


def labelled(spark, field):
    rng = np.random.default_rng(1)
    word = lambda: "".join(rng.choice(list("abcdefghij"), rng.integers(2, 8)))
    rows, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        lines = [" ".join(word() for _ in range(9)).capitalize() + "." for _ in range(6)]
        if bad and field == "quality":
            lines = [" ".join(word() + "***" for _ in range(9)) for _ in range(6)]
        if bad and field == "toxic":
            lines[2] += " you worthless zzqqx " + ("wrothless" if i % 8 else "zzqqxx")
        rows.append((i, "\n".join(lines)))
        labels.append((i, int(bad if field == "toxic" else not bad)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, f"doc_id long, {field} int")


@pytest.mark.parametrize("field", ["quality", "toxic"])
def test_classifiers_learn(spark, docs, empty, field):
    table, labels = labelled(spark, field)
    fit, score = (quality.fit_quality, quality.quality_score) if field == "quality" else (toxicity.fit_toxicity, toxicity.toxicity_score)
    model = fit(table, labels)
    got = table.select("doc_id", score(F.col("text"), model).alias("s"), (F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0).alias("held")).join(labels, "doc_id")
    rows = got.where("held").collect()
    assert np.mean([(r.s >= 0.5) == (r[field] == 1) for r in rows]) > 0.95
    odd = docs.select(score(F.col("text"), model).alias("s")).collect()
    assert all(0 <= r.s <= 1 for r in odd)
    assert empty.select(score(F.col("text"), fit(empty, labels.limit(0)))).count() == 0


def test_gradients_of_the_joint_model():
    rng = np.random.default_rng(9)
    parts = [rng.normal(size=(30, 4)), rng.normal(size=(2, 4)), rng.normal(size=2)]
    sizes, label, weight = np.array([3, 1, 5, 2]), np.array([1, 0, 1, 0]), np.array([1.0, 2.0, 0.5, 1.0])
    rows = rng.integers(0, 30, sizes.sum())

    def loss():
        p = toxicity.probabilities(toxicity.means(parts[0], rows, sizes), *parts[1:])
        return (weight * np.log(p[np.arange(4), label])).sum()

    used, *got = toxicity.gradients(*parts, rows, sizes, label, weight)
    for part, step, at in ((parts[0], got[0], used), (parts[1], got[1], range(2)), (parts[2], got[2], range(2))):
        for k, i in enumerate(at):
            for j in np.ndindex(part[i].shape):
                old = part[(i, *j)]
                part[(i, *j)] = old + 1e-6
                up = loss()
                part[(i, *j)] = old - 1e-6
                assert np.isclose((up - loss()) / 2e-6, step[(k, *j)], atol=1e-6)
                part[(i, *j)] = old


def test_marginals_against_enumeration():
    rng = np.random.default_rng(4)
    per_text, turn = np.array([3, 1, 4]), rng.normal(size=(2, 2))
    score = rng.normal(size=8)
    good, _, log_z = quality.marginals(per_text, score, turn)
    at, total = 0, 0.0
    for n in per_text:
        weight, marks = 0.0, np.zeros(n)
        for code in range(1 << n):
            y = [(code >> k) & 1 for k in range(n)]
            w = np.exp(sum(score[at + k] * y[k] for k in range(n)) + sum(turn[a, b] for a, b in zip(y, y[1:])))
            weight += w
            marks += w * np.array(y)
        assert np.allclose(good[at : at + n], marks / weight)
        total += np.log(weight)
        at += n
    assert np.isclose(log_z, total)


def test_crc_of_ids_is_unsigned(spark, docs):
    rows = packing.token_pieces(docs.where("doc_id = 5"), VOCAB, 0, 64).collect()
    assert {r.ids_crc32 for r in rows} == {crc(library_ids(["Tiny"], 0)[0])}


def test_rarest_shingles_find_all_pairs(spark):
    rng = np.random.default_rng(12)
    passage = " ".join(f"common{j}" for j in range(80))
    texts = []
    for k in range(150):  # one long passage in all; near copies, some at exactly 0.8, among texts that share only it
        own = [f"w{k}x{j}" for j in range(int(rng.integers(60, 90)))]
        texts.append(passage + " " + " ".join(own))
        if k % 3 == 0:
            for at in rng.choice(len(own), 1 + k % 5, replace=False):
                own[at] = "changed"
            texts.append(passage + " " + " ".join(own))
    texts += [" ".join(f"s{k}" for k in range(n)) for n in (5, 8, 9, 12, 14, 16, 17, 19)] + ["", "two words"]  # 0.8 lies at whole numbers
    rows = [(i, t, simhash._node(t.encode().lower().split()), len(simhash.shingles(t.encode(), 5))) for i, t in enumerate(texts)]
    signed = [(i, t, int(np.uint64(x).view(np.int64)), n) for i, t, x, n in rows]
    table = spark.createDataFrame(signed, "id long, text string, node long, n int")
    nodes = table.select("node", F.col("id").alias("first"), "n", F.col("node").alias("root"))
    found = {frozenset(r) for r in simhash._prefix_pairs(table.select("id", "text"), nodes, 5, 0.8).collect()}
    sets = [(x, simhash.shingles(t.encode(), 5)) for _, t, x, _ in signed]
    true = {frozenset((x, y)) for k, (x, a) in enumerate(sets) for y, b in sets[:k] if a | b and len(a & b) >= 0.8 * len(a | b)}
    assert len(true) > 25 and true <= found and len(found) < 3 * len(true)
