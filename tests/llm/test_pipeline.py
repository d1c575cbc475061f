"""The pipeline on a small table, its filters against brute force."""

import re

from tokenizers import Tokenizer

import corpus_pipeline
from quillion.llm.tokens import public_path

DATA = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs = stage(spark, docs, DATA).cache()
        assert docs.columns == before.columns, name
        assert {r.doc_id for r in docs.select("doc_id").collect()} <= {r.doc_id for r in before.select("doc_id").collect()}
    kept = {r.doc_id: r.text for r in docs.collect()}
    words = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    windows = set()
    for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect():
        w = words.findall(r.text.lower())
        windows |= {tuple(w[k : k + 13]) for k in range(max(1, len(w) - 12))}
    for text in kept.values():
        w = words.findall(text.lower())
        hit = {j for k in range(len(w) - 12) if tuple(w[k : k + 13]) in windows for j in range(k, k + 13)}
        assert not hit or 20 * len(hit) < len(w)
    seen = set()
    for i in sorted(kept):
        data = kept[i].encode()
        own = {data[k : k + 100] for k in range(len(data) - 99)}
        # Cutting joins bytes that were apart, so a few strings may match anew.
        assert len(own & seen) <= 0.1 * len(own)
        seen |= own
    pieces = corpus_pipeline.packed(spark, docs, DATA).toPandas()
    library = Tokenizer.from_file(public_path("word_bpe_49k.json"))
    assert pieces["length"].sum() == sum(len(x.ids) + 1 for x in library.encode_batch(list(kept.values()), add_special_tokens=False))


def test_copies_leave_one(spark):
    text = " ".join(f"word{i}" for i in range(400))
    rows = [(3, text), (1, text), (2, text.replace("word200", "other")), (9, "quite another text of few words")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id for r in corpus_pipeline.without_near_copies(spark, docs, DATA).collect()}
    assert {1, 9} <= kept and 3 not in kept


def test_near_copies_leave_one(spark):
    text = " ".join(f"word{i}" for i in range(400))
    rows = [(1, text), (2, text.replace("word200", "other")), (4, text.replace("word9", "other")), (9, "quite another text of few words")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r.doc_id for r in corpus_pipeline.without_near_copies(spark, docs, DATA).collect()}
    assert kept == {1, 9}
