"""What a step moves, holds or repeats as its input grows."""

import random
import re
import time
import tracemalloc

import pyarrow as pa
from pyspark.sql import functions as F

from quillion.operators import context as X
from quillion.operators import formulas as M
from quillion.operators import retrieval as R
from quillion.operators import training as TR
from quillion.streaming import jobs


def shuffled(spark, run) -> tuple[object, float]:
    """What ``run`` returns, and the megabytes that it shuffled."""
    store = spark.sparkContext._jsc.sc().statusStore()

    def total():
        time.sleep(0.5)
        found = store.executorList(False)
        return sum(found.apply(i).totalShuffleWrite() for i in range(found.size())) / 2**20

    before = total()
    out = run()
    return out, total() - before


def largest(spark, run) -> float:
    """The most megabytes that one task reads from a shuffle while ``run`` runs."""
    store, jvm = spark.sparkContext._jsc.sc().statusStore(), spark._jvm
    every = lambda: store.stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    listed = lambda seq: [seq.apply(i) for i in range(seq.size())]
    before = max((s.stageId() for s in listed(every())), default=-1)
    run()
    time.sleep(0.5)
    stages = [s for s in listed(every()) if s.stageId() > before and s.shuffleReadBytes()]
    tasks = [t for s in stages for t in listed(store.taskList(s.stageId(), s.attemptId(), 1000))]
    reads = [t.taskMetrics().get().shuffleReadMetrics() for t in tasks if t.taskMetrics().isDefined()]
    return max(r.localBytesRead() + r.remoteBytesRead() for r in reads) / 2**20


def test_pages_of_one_document_are_many_tasks_work(spark, tmp_path):
    rng = random.Random(5)
    body = lambda: "\n".join("".join(rng.choice("abcdefghij .") for _ in range(400)) for _ in range(50))
    rows = [("one", k, f"HEAD OF ALL\n{body()}\nfoot") for k in range(1, 61)]
    own = jobs.stateful_session(spark)
    own.conf.set("spark.sql.adaptive.enabled", "false")
    own.conf.set("spark.sql.shuffle.partitions", "16")
    spark.createDataFrame(rows, "doc_name string, page int, text string").repartition(4).write.parquet(f"{tmp_path}/in")
    stream = own.readStream.schema("doc_name string, page int, text string").parquet(f"{tmp_path}/in")
    most = largest(spark, lambda: jobs.stream_ingest(stream, f"{tmp_path}/store", f"{tmp_path}/cp").start().awaitTermination())
    assert most < sum(f.stat().st_size for f in (tmp_path / "in").glob("*.parquet")) / 2**20 / 2
    found = jobs.ingested(own, f"{tmp_path}/store")
    assert found.select("page_start").distinct().count() == 60 and not found.where("text like '%HEAD OF ALL%'").count()


def test_negatives_are_drawn_without_their_texts(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice("abcdefghij ") for _ in range(20_000)) for _ in range(60)] + ["same"] * 4
    rows = [(i, t, f"d{i % 3}", f"Definition {i % 5}", False) for i, t in enumerate(texts)]
    chunks = spark.createDataFrame(rows, "rid long, text string, doc_name string, heading_path string, is_formula boolean")
    qa = TR.make_questions(chunks)
    some = TR.sample_negatives(qa, chunks, texts=False).where("k <= rid % 4")
    pairs, moved = shuffled(spark, lambda: TR.expand_pairs(qa, some, chunks).select("rid", "k", F.md5("chunk_text").alias("t"), "score").collect())
    assert moved < 4  # 1.1 MB of text, of which a question draws 36
    full = TR.expand_pairs(qa, TR.sample_negatives(qa, chunks).where("k <= rid % 4"), chunks).select("rid", "k", F.md5("chunk_text").alias("t"), "score")
    assert sorted(map(tuple, pairs)) == sorted(map(tuple, full.collect()))
    own = {r.rid: r.t for r in pairs if r.k == 0}
    assert len(own) == 64 and all(r.t != own[r.rid] for r in pairs if r.k)


def test_lines_are_trimmed_and_searched_once(spark):
    texts = ["• x = 1 –\nplain words\n(i) y^2 = z\nsin(a) and |b|", "no sign\n\tprove = it", "Caf\u00e9 \u00c5\n A\u030a = \u00bd", ""]
    df = spark.createDataFrame([(i, t, "h", "", 0) for i, t in enumerate(texts)], "rid long, text string, heading_path string, section_tag string, context_score int")
    plain, signed = M.candidate_lines(df), M.candidate_lines(df, wanted=F.col("line").rlike(M.SIGNED))
    all_, some = M.extract_spans(plain, composed=True), M.extract_spans(signed, composed=True)
    rows = lambda x: sorted(tuple(r) for r in x.select("rid", "line_no", "k", "span").collect())
    assert rows(all_) == rows(some) and {"x = 1", "sin(a)", "|b|"} <= {r[3] for r in rows(some)}
    assert (2, 1, 0, "\u00c5 = 1\u20442") in rows(some)
    plan = plain._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_replace" not in plan and plan.count("trim(") == 1
    assert some._jdf.queryExecution().optimizedPlan().toString().count("sin|cos|tan|cot") == 1


def test_split_is_by_rank_also_with_repeated_keys(spark):
    for keys in ([*range(37)], [5] * 30, [], [1]):
        found = TR.split_train_valid(spark.createDataFrame([(k, n) for n, k in enumerate(keys)], "k int, n int"), "k").collect()
        assert len(found) == len(keys) and sum(r.is_valid for r in found) == len(keys) - int(len(keys) * 0.9)


def test_long_text_of_many_aliases(spark):
    pairs = [(f"word{i}", f"word{i + 1}!" if i % 3 else f"n{i}") for i in range(6000)] + [("x y", "xy"), ("xy", "z")]
    rng = random.Random(2)
    text = " ".join(f"word{rng.randrange(9000)}" for _ in range(30_000)) + " x y, x  y word1x"
    start, want = time.time(), []
    for word in re.split(r"(\w+)", text.replace("x y,", "z,")):
        out = ""
        while word.startswith("word") and word[4:].isdigit() and int(word[4:]) < 6000:
            i = int(word[4:])
            word, out = (f"word{i + 1}", "!" + out) if i % 3 else (f"n{i}", out)
        want.append(word + out)
    got = X.apply_aliases(spark.createDataFrame([(text,)], "text string"), pairs).first()[0]
    assert got == "".join(want)
    assert time.time() - start < 30


def test_shared_words_hold_little(spark, monkeypatch):
    rows = [(f"u{i:05}", [f"w{i % 50}", f"w{(i * 7) % 50}", "all"]) for i in range(3000)] + [(None, ["all"]), ("u1", None), ("u2", [])]
    asked = [(i, [f"w{i % 50}", "all", f"w{(i + 1) % 50}"]) for i in range(40)] + [(99, ["none"]), (98, [])]
    r, q = spark.createDataFrame(rows, "name string, words array<string>"), spark.createDataFrame(asked, "question_id int, words array<string>")
    r = r.withColumn("words", F.array_distinct("words"))
    want = set()
    for i, w in asked:
        near = sorted((-len(set(w) & set(x)), n) for n, x in rows if n and x and set(w) & set(x))
        want |= {(i, n, -s) for s, n in near[:4]}
    for held, block in ((1_000_000, 2_000_000), (10, 50)):
        monkeypatch.setattr(R, "HELD", held)
        monkeypatch.setattr(R, "WORD_BLOCK", block)
        assert {(x.question_id, x.name, x.shared) for x in R.shared_words(q, r.repartition(3), ["question_id"], 4).collect()} == want

    class Sent:
        value = ([pa.array(range(2000))], pa.array(["a", "b"]), [0, 10, 20], pa.array([*range(10), *range(5, 15)], pa.int32()).to_numpy())

    batch = pa.RecordBatch.from_arrays([pa.array([f"u{i:05}" for i in range(20_000)]), pa.array([["a", "b"]] * 20_000)], names=["name", "words"])
    tracemalloc.start()
    (out,) = R._shared(Sent, 4, ["q", "name", "shared"])(batch.slice(i, 1000) for i in range(0, 20_000, 1000))
    assert tracemalloc.get_traced_memory()[1] < 40 * 2**20  # 300,000 counts
    tracemalloc.stop()
    assert out.num_rows == 60 and out.column(1)[0].as_py() == "u00000"


def test_pages_are_numbered_without_their_texts(spark, tmp_path):
    from quillion.plans import fixtures as V

    rows = [(i * 7 % 40, f"text {i % 36}", "en", [None, "a", "b", "b"][i % 4], 5) for i in range(40)] + [(None, "x", "en", "a", 1), (None, "x", None, None, 1), (3, "text 29", "de", "b", 5)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    docs.limit(1).write.parquet(f"{tmp_path}/pages.parquet")  # which v_chunks names, though it reads none
    want = spark.sql(V.VIEWS["v_pages"].replace("FROM documents", "FROM {docs}"), docs=docs)
    # Which of two rows of one id comes first is open, so their number and the rest are compared apart.
    found = V.view(spark, str(tmp_path), "v_pages")
    assert found.dtypes == want.dtypes
    for cols in (["doc_name", "page", "doc_id"], ["doc_name", "doc_id", "lang", "text"]):
        assert sorted(map(repr, found.select(*cols).collect())) == sorted(map(repr, want.select(*cols).collect()))
    plan = V.view(spark, str(tmp_path), "v_chunks").select("rid", "text")._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Join" not in plan


def test_sheets_send_few_lines(spark):
    from quillion.operators import formulas as M

    rows = [("d", 1, i, 1, f"[d p.{i:06}]", "x = y") for i in range(9000)]
    lines = spark.createDataFrame(rows, "doc_name string, page int, rid int, span_rank int, source string, span string")
    sheet = M.formula_sheet(lines, "doc_name", budget=300)
    found = sheet.first()
    assert found.n == 300 // len("[d p.000001] x = y ") and found.sheet.split("\n")[-1] == f"[d p.{found.n - 1:06}] x = y"
    assert "WindowGroupLimit" in sheet._jdf.queryExecution().executedPlan().toString()
