"""Every opN query against a brute-force version of its contract, over tables with nulls, empty
and very long texts, ties, repeated rows and columns that clash with an operator's own."""

import base64
import hashlib
import itertools
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillion.llm import queries, quality, toxicity
from quillion.llm.tokens import public_path

CLASH = "spans string, n_words int, component_id string, kept string, id int, text_ string"
PASSAGE = "the quick brown fox jumps over the lazy dog while twelve green birds sing of summer rain and nobody minds it"


def made_texts():
    rng = np.random.default_rng(12)
    word = lambda: "".join(rng.choice(list("abcdefghijklmnop"), rng.integers(2, 9)))
    prose = [" ".join(word() for _ in range(60)).capitalize() + ".\n" + " ".join(word() for _ in range(30)) + "." for _ in range(40)]
    long = " ".join(word() for _ in range(90_000))  # about 570 kB, twice: longer than any piece hashed at once
    odd = ["", None, "   ", "Tiny", "tiny", PASSAGE + " one", "x " + PASSAGE + " two", "Ünï — 東京 é́ <|endoftext|> 'll", "ab" * 200, "=" * 300]
    copies = [prose[0], prose[0], prose[1].replace("a", "A"), prose[2] + " more", " ".join(prose[3].split()[5:]) + prose[4]]
    bad = ["you worthless idiot trash\n" + p for p in prose[:6]] + ["||| 12 ||| 34 |||\n" * 8 for _ in range(6)]
    return prose + odd + copies + bad + [long + " \n" + long]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("sf"))
    rng, texts = np.random.default_rng(5), made_texts()
    docs = [(7 * i % 101 + 200 * (i // 101), t, "en", "s", *"abc", "k", 1, "x") for i, t in enumerate(texts)]
    docs = [(i, t, a, b, "s", 1, "c", "k", 1, "t") for i, t, a, b, *_ in docs]
    spark.createDataFrame(docs, f"doc_id long, text string, lang string, source string, {CLASH}").repartition(4).write.parquet(f"{d}/documents.parquet")
    labels = [(i, int("idiot" not in (t or "") and "|||" not in (t or "")), int("idiot" in (t or ""))) for i, t, *_ in docs]
    spark.createDataFrame([*labels, (None, 1, 0), (99999, 0, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    bench = [(1, PASSAGE.upper()), (2, "tiny"), (3, ""), (4, None), (None, PASSAGE), (10, "brown fox jumps")]
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    x = rng.normal(size=(30, 8))
    vectors = np.concatenate([x, x[:6] + 0.1 * rng.normal(size=(6, 8)), x[[0] * 5], x[:3] * 1e-30])
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)] + [(100, None), (101, [0.0] * 8), (102, [float("nan")] * 8)]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3).write.parquet(f"{d}/embeddings.parquet")
    pages = [(i, f"http://h/{i}", h) for i, h in enumerate(["same é", "", None, "same é", "once", "long é\r\n\r\n" * 4000, "same é"])]
    spark.createDataFrame(pages, "page_id long, url string, html string").repartition(2).write.parquet(f"{d}/pages.parquet")
    return d, {i: t for i, t, *_ in docs}, vectors, {i: h or "" for i, _, h in pages}


def run(spark, name, d, kinds):
    got = getattr(queries, name)(spark, d)
    found = dict(got.dtypes)
    assert {k: found[k] for k in kinds} == kinds
    return got.collect()


def components(n, linked):
    root = list(range(n))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, b in linked:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return [find(a) for a in range(n)]


def held(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def test_op1(spark, tables):
    d, texts, *_ = tables
    rows = run(spark, "op1_quality_classifier", d, {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"})
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    assert all(r.held_out == held(r.doc_id) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    docs = spark.read.parquet(f"{d}/documents.parquet")
    weights, turn = quality.fit_quality(docs, spark.read.parquet(f"{d}/labels.parquet"))
    got = {r.doc_id: r.score for r in rows}
    import pyarrow as pa

    for i, t in texts.items():  # all labellings of the lines, weighed one by one
        if len((t or "").split("\n")) > 9:
            continue
        per_text, size, bins = quality.lines_of(pa.array([t]))
        seen = quality.with_neighbours(per_text, bins)
        odds = [weights[-1] + sum(weights[k * quality.BINS + b] for k, b in enumerate(line)) for line in seen.tolist()]
        total, good = 0.0, np.zeros(len(odds))
        for y in itertools.product((0, 1), repeat=len(odds)):
            w = np.exp(sum(o * s for o, s in zip(odds, y)) + sum(turn[a, b] for a, b in zip(y, y[1:])))
            total, good = total + w, good + w * np.array(y)
        assert [int(s) for s in size] == [len(x.encode()) for x in (t or "").split("\n")]
        assert np.isclose(got[i], (good / total * (size + 1)).sum() / (size + 1).sum())


def test_op2(spark, tables):
    d, texts, *_ = tables
    rows = run(spark, "op2_simhash_near_dedup", d, {"doc_id": "bigint", "fingerprint": "string", "component_id": "bigint"})
    prints = {}
    for i, t in texts.items():
        low = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        w = re.findall("[^\x20\x09-\x0d]+", low)
        shingles = [" ".join(w[k : k + 3]) for k in range(len(w) - 2)] or ([" ".join(w)] if w else [])
        hashes = np.array([xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles], np.uint64)
        ones = [int(((hashes >> np.uint64(b)) & np.uint64(1)).sum()) for b in range(64)]
        prints[i] = sum(1 << b for b in range(64) if 2 * ones[b] > len(hashes))
    ids = sorted(prints)
    root = components(len(ids), [(a, b) for a in range(len(ids)) for b in range(a) if (prints[ids[a]] ^ prints[ids[b]]).bit_count() <= 2])
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in rows) == [(i, f"{prints[i]:016x}", ids[root[k]]) for k, i in enumerate(ids)]


def library(texts, end):
    found = Tokenizer.from_file(public_path("word_bpe_49k.json")).encode_batch([t or "" for t in texts], add_special_tokens=False)
    return [x.ids + [end] for x in found]


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_op3(spark, tables):
    d, texts, *_ = tables
    rows = run(spark, "op3_token_files", d, {"doc_id": "bigint", "start": "bigint", "n_tokens": "bigint", "ids_crc32": "bigint"})
    want, start = [], 0
    for i, ids in zip(sorted(texts), library([texts[i] for i in sorted(texts)], 2)):
        want.append((i, start, len(ids), crc(ids)))
        start += len(ids)
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in rows) == want


def test_op4(spark, tables):
    d, texts, *_ = tables
    rows = run(spark, "op4_token_counts", d, {"doc_id": "bigint", "n_words": "bigint", "n_tokens": "bigint"})
    assert sorted((r.doc_id, r.n_words) for r in rows) == sorted((i, len((t or "").split())) for i, t in texts.items())
    assert all(r.n_tokens >= r.n_words for r in rows)


def test_op5(spark, tables):
    import pyarrow as pa

    d, texts, *_ = tables
    rows = run(spark, "op5_toxicity", d, {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"})
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    assert all(r.held_out == held(r.doc_id) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    vectors, soft, bias = toxicity.fit_toxicity(spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet"))
    got = {r.doc_id: r.score for r in rows}
    for i, t in texts.items():
        if len(t or "") > 5000:
            continue
        per_text, per_word, bucket = toxicity.grams_of(pa.array([t]))
        words = np.split(bucket, np.cumsum(per_word)[:-1]) if len(per_word) else []
        starts = sorted({*range(0, max(len(words) - 7, 1), 4), max(len(words) - 8, 0)})
        windows = [np.concatenate(words[a : a + 8]) for a in starts if words]
        scores = [toxicity.probabilities(vectors[w].mean(0)[None], soft, bias)[0, 1] for w in windows if len(w)]
        alone = toxicity.probabilities(np.zeros((1, vectors.shape[1])), soft, bias)[0, 1]
        assert np.isclose(got[i], max(scores, default=alone), atol=1e-5)


def test_op6(spark, tables):
    d, texts, *_ = tables
    kinds = {"doc_id": "bigint", "n_words": "bigint", "n_hit": "bigint", "n_items": "bigint", "items_sha256": "string", "contaminated": "boolean"}
    rows = {r.doc_id: r for r in run(spark, "op6_benchmark_decontamination", d, kinds)}
    find = lambda t: re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows: dict = {}
    for r in spark.read.parquet(f"{d}/benchmark.parquet").where("item_id is not null").collect():
        w = find(r.text)
        for k in range(max(1, len(w) - 12) if w else 0):
            windows.setdefault(tuple(w[k : k + 13]), set()).add(str(r.item_id))
    assert sorted(rows) == sorted(texts)
    for i, t in texts.items():
        w, hit, items = find(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if found := windows.get(tuple(w[k : k + n])):
                    hit.update(range(k, k + n))
                    items |= found
        digest = hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
        want = (len(w), len(hit), len(items), digest, bool(hit) and 20 * len(hit) >= len(w))
        assert (rows[i].n_words, rows[i].n_hit, rows[i].n_items, rows[i].items_sha256, rows[i].contaminated) == want


def test_op7(spark, tables):
    d, _, x, _ = tables
    rows = run(spark, "op7_embedding_near_dedup", d, {"vec_id": "bigint", "n_links": "bigint", "component_id": "bigint", "kept": "boolean"})
    unit = x / np.abs(x).max(1, keepdims=True)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    close = unit @ unit.T >= 0.9
    root = components(len(x), [(a, b) for a in range(len(x)) for b in range(a) if close[a, b]])
    want = [(i, int(close[i].sum()) - 1, root[i], root[i] == i) for i in range(len(x))] + [(i, 0, i, True) for i in (100, 101, 102)]
    assert sorted((r.vec_id, r.n_links, r.component_id, r.kept) for r in rows) == want


def test_op8(spark, tables):
    d, texts, *_ = tables
    kinds = {"doc_id": "bigint", "piece": "int", "start": "bigint", "length": "bigint", "ids_crc32": "bigint", "sequence_id": "bigint", "offset": "bigint"}
    rows = run(spark, "op8_best_fit_packing", d, kinds)
    want = []
    for i, ids in zip(sorted(texts), library([texts[i] for i in sorted(texts)], 0)):
        want += [(i, k // 2048, k, len(ids[k : k + 2048]), crc(ids[k : k + 2048])) for k in range(0, len(ids), 2048)]
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    sequences: dict = {}
    for r in rows:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in sequences.values():
        end = 0
        for at, n in sorted(parts):
            assert at == end
            end += n
        assert end <= 2048
    assert len(sequences) <= 1.05 * sum(n for _, _, _, n, _ in want) / 2048 + 2


def test_op9(spark, tables):
    d, _, _, pages = tables
    kinds = {"page_id": "bigint", "payload_bytes": "bigint", "payload_digest": "string", "record_type": "string", "refers_to": "bigint"}
    rows = run(spark, "op9_warc", d, kinds)
    want = []
    for i, html in sorted(pages.items()):
        data, first = html.encode(), min(k for k, h in pages.items() if h == html)
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        want.append((i, len(data), digest, "response" if first == i else "revisit", None if first == i else first))
    assert sorted((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows) == want


def test_op10(spark, tables):
    d, texts, *_ = tables
    kinds = {"doc_id": "bigint", "n_bytes": "bigint", "n_removed": "bigint", "n_spans": "bigint", "kept_sha256": "string"}
    rows = {r.doc_id: r for r in run(spark, "op10_suffix_array_dedup", d, kinds)}
    assert sorted(rows) == sorted(texts)
    seen: set = set()
    for i in sorted(texts):
        data = (texts[i] or "").encode()
        cover = np.zeros(len(data) + 1, np.int64)
        for k in range(len(data) - 99):
            mark = hashlib.blake2b(data[k : k + 100], digest_size=12).digest()
            if mark in seen:
                cover[k] += 1
                cover[k + 100] -= 1
            seen.add(mark)
        gone = np.cumsum(cover[:-1]) > 0
        kept = bytes(np.frombuffer(data, np.uint8)[~gone])
        runs = int((np.diff(gone.astype(int), prepend=0) > 0).sum())
        assert (rows[i].n_bytes, rows[i].n_removed, rows[i].n_spans, rows[i].kept_sha256) == (len(data), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest())


def test_empty_tables(spark, tables, tmp_path):
    d = tables[0]
    for name in ("documents", "labels", "benchmark", "embeddings", "pages"):
        spark.read.parquet(f"{d}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    for name, query in queries.queries().items():
        assert query(spark, str(tmp_path)).count() == 0, name


def test_columns_that_clash(spark, tables):
    from quillion.llm import decontaminate, embeddings, packing, simhash, suffix_dedup

    d = tables[0]
    docs = spark.read.parquet(f"{d}/documents.parquet").where(F.length("text") < 5000).limit(20)
    clash = docs.withColumns({c: F.lit("old") for c in ("n_links", "items", "n_removed", "sequence_id", "offset", "piece", "first", "__row")})
    assert suffix_dedup.repeated_spans(clash).columns.count("spans") == 1
    assert dict(suffix_dedup.without_repeats(clash).dtypes)["n_removed"] == "bigint"
    assert dict(decontaminate.contamination(clash.drop("__row"), spark.read.parquet(f"{d}/benchmark.parquet")).dtypes)["items"] == "array<string>"
    prints = clash.withColumn("fp", F.lit(1).cast("long"))
    assert dict(simhash.simhash_components(prints, "doc_id", "fp").dtypes)["component_id"] == "bigint"
    vectors = spark.read.parquet(f"{d}/embeddings.parquet").withColumns({"n_links": F.lit("old"), "kept": F.lit("old")})
    assert dict(embeddings.embedding_duplicates(vectors).dtypes)["kept"] == "boolean"
    assert packing.pack_documents(clash, public_path("word_bpe_49k.json"), 0, 64).columns.count("offset") == 1
    assert simhash.near_copies(clash).count() >= 0
