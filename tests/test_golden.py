"""Hand-written rows for rules that the generated prose does not reach, and properties."""

import numpy as np
from pyspark.sql import functions as F

from quillion.functions import text as T
from quillion.operators import chunking as C
from quillion.operators import context as X
from quillion.operators import formulas as M
from quillion.operators import labels as L
from quillion.operators import quality as P
from quillion.operators import retrieval as R
from quillion.operators import vectors as V
from quillion.streaming import jobs


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "text string").select(f(F.col("text")).alias("x")).first()[0]


def test_text_expressions(spark):
    assert one(spark, "a b­c ﬁn \n  ﬂy  ", T.normalize_text) == "a bc fin\nfly"
    assert one(spark, "It is. 2 more; (b) no: yes! x", T.sentences) == ["It is.", "2 more;", "(b) no: yes! x"]
    assert one(spark, "ﬁ²", T.nfkc) == "fi2"
    assert one(spark, "What does the unit circle say about trig", T.keywords) == sorted({"unit", "circle", "trig", "unit circle", *T.TRIGONOMETRY})
    assert one(spark, None, T.ascii_tokens) == []


def test_page_rules(spark):
    df = spark.createDataFrame([("d", 1, ""), ("d", 2, "Plain text here"), ("d", 3, "text 中 with CJK"), ("d", 4, "glyph  of a font")], "doc_name string, page int, text string")
    assert [r.suspect for r in P.suspicious(df).sort("page").collect()] == [True, False, True, True]
    spans = spark.createDataFrame([("d", 1, 0, "F", "xy"), ("d", 1, 1, "G", "")], "doc_name string, page int, pos int, font string, text string")
    fonts = spark.createDataFrame([("f", 0xE001, "ab")], "font string, code int, repl string")
    assert [r.text for r in P.repair_glyphs(spans, fonts).sort("pos").collect()] == ["xaby", ""]


def test_chunk_page():
    page = "INTRODUCTION TO SETS\nA set is a collec-\ntion of things. It has members.\n- first item\n2.1 Exercises for Review\nProve x = y."
    got = C.chunk_page(page, 750, 90, set())
    assert [c["heading_path"] for c in got] == ["INTRODUCTION TO SETS", "2.1 Exercises for Review"]
    assert got[0]["text"].endswith("- first item") and got[1]["section_tag"] == "exercises" and got[1]["has_math"]
    long = " ".join(f"Sentence number {i} is here." for i in range(200))
    chunks = C.chunk_page(long, 100, 20, set())
    assert all(len(c["text"]) // 4 <= 100 + 20 + 10 for c in chunks) and len(chunks) > 10
    assert chunks[1]["text"].startswith(chunks[0]["text"][-80:])


def test_equation_flag(spark, monkeypatch):
    page = "Area of a disc\nA = r^2 holds.\nPlain words only here."
    assert [C.chunk_page(page, 750, 90, set(), m)[0]["is_equation"] for m in (False, True)] == [False, True]
    wordy = "x = y and " + " ".join(["word"] * 41)
    assert not C.chunk_page(wordy, 750, 90, set(), True)[0]["is_equation"]
    pages = spark.createDataFrame([("d1", 1, page), ("d2", 1, page), ("d3", 1, page)], "doc_name string, page int, text string")
    blocks = spark.createDataFrame([("d1", 1, "A = r^2", "cmmi"), ("d2", 1, "A = r^2", "times"), ("d3", 1, "A = r^2 " * 40, "cmmi")], "doc_name string, page int, text string, font string")
    monkeypatch.setattr(C, "repeat_lines", lambda pages: pages.where("false").select("doc_name", F.col("text").alias("line")))  # one page repeats all
    got = {r.doc_name: r.is_equation for r in C.chunk_pages(pages, blocks).collect()}
    assert got == {"d1": True, "d2": False, "d3": False}
    assert not any(r.is_equation for r in C.chunk_pages(pages).collect())


def test_one_column_pages_keep_their_order(spark):
    rows = [("d", 1, 0, 40.0, 30.0), ("d", 1, 1, 90.0, 10.0), ("d", 1, 2, 60.0, 10.0), ("d", 2, 0, 40.0, 5.0), ("d", 2, 1, 200.0, 1.0), ("d", 3, 0, 1.0, 1.0)]
    blocks = spark.createDataFrame(rows, "doc_name string, page int, pos int, x0 double, y0 double")
    got = {(r.page, r.pos): r["rank"] for r in C.reading_order(blocks).collect()}
    assert got == {(1, 2): 1, (1, 1): 2, (1, 0): 3, (2, 0): 1, (2, 1): 2, (3, 0): 1}


def test_spans_of_a_model(spark):
    rows = [(1, 0, k, f"x = y{k}", 0, 0.55, p) for k, p in enumerate([0.9, 0.5, 0.44, 0.1])]
    spans = spark.createDataFrame(rows, "rid long, line_no int, k int, span string, context_score int, density double, p double")
    good = [r.good for r in M.good_span(spans, F.col("p")).sort("k").collect()]
    assert good == [True, True, False, False]
    kept = lambda soft: sorted(r.k for r in M.rank_spans(spans.withColumn("good", F.lit(True)), prob=F.col("p"), soft=F.lit(soft)).collect())
    assert kept(False) == [0, 1, 2] and kept(True) == [0, 1, 2]  # three at least stay
    more = spans.unionByName(spans.select((F.col("rid") * 1).alias("rid"), "line_no", (F.col("k") + 10).alias("k"), "span", "context_score", "density", F.lit(0.5).alias("p")))
    kept = lambda soft: sorted(r.k for r in M.rank_spans(more.withColumn("good", F.lit(True)), prob=F.col("p"), soft=F.lit(soft)).collect())
    assert kept(False) == [0, 1, 10, 11, 12, 13] and len(kept(True)) == 4


def test_negatives_are_topped_up(spark):
    from quillion.operators import training as R2

    chunks = spark.createDataFrame([(i, f"text {i % 7}", f"d{i % 3}", f"h{i % 2}") for i in range(30)], "rid long, text string, doc_name string, heading_path string")
    qa = chunks.select("rid", F.lit("q").alias("question"), F.col("text").alias("positive"), "doc_name", "heading_path")
    negatives = R2.sample_negatives(qa, chunks)
    rows = negatives.join(qa, "rid").collect()
    assert rows and all(r.negative != r.positive and r.k <= 4 for r in rows)
    pairs = R2.expand_pairs(qa, negatives.where("k <= rid % 3"), chunks).collect()
    per: dict = {}
    for r in pairs:
        per.setdefault(r.rid, []).append((r.k, r.chunk_text, r.score))
    assert all(sorted(k for k, _, _ in v) == [0, 1, 2, 3] for v in per.values())
    assert all(t != chosen for v in per.values() for _, chosen, s in v if s for _, t, s2 in v if not s2)
    assert R2.sample_negatives(qa, chunks.limit(0)).count() == 0


def test_markdown_and_scores(spark):
    assert one(spark, " ```md\n– a  \n  • b \n``` ", T.normalize_markdown) == "a\n- b"
    got = spark.range(1).select(T.softmax(F.array(F.lit(1.0), F.lit(1.0), F.lit(800.0))), T.sigmoid(F.lit(0.0))).first()
    assert got[0][2] == 1.0 and got[1] == 0.5


def test_shared_words_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(R, "WORD_BLOCK", 3)
    queries = spark.createDataFrame([(1, ["a", "b", "c"]), (2, ["z"]), (3, []), (4, ["a"])], "id long, words array<string>")
    rows = spark.createDataFrame([("n2", ["a", "b"]), ("n1", ["a", "b"]), ("n3", ["a", "c", "b"]), (None, ["z"]), ("n4", ["q"])], "name string, words array<string>")
    got = sorted(tuple(r) for r in R.shared_words(queries, rows, ["id"], 2).collect())
    assert got == [(1, "n1", 2), (1, "n3", 3), (4, "n1", 1), (4, "n2", 1)]


def greedy(gain, first, like, k, penalty):
    """Maximal marginal relevance written out, one candidate at a time."""
    chosen = []
    while len(chosen) < min(k, len(gain)):
        best = None
        for i in range(len(gain)):
            if i not in chosen:
                value = gain[i] - penalty * max(like[i][j] for j in chosen) if chosen else first[i]
                if best is None or value > best[0]:
                    best = (value, i)
        chosen.append(best[1])
    return chosen


def test_pack_keeps_budget(spark):
    rows = spark.createDataFrame([("k", i, n) for i, n in enumerate([5, 5, 20, 3, 3, 3, 9])], "k string, pos int, n int")
    got = {r.pos: r.batch for r in C.pack(rows.repartition(3), ["k"], "pos", "n", 10).collect()}
    assert got == {0: 0, 1: 0, 2: 1, 3: 2, 4: 2, 5: 2, 6: 3}


def test_citations_and_aliases(spark):
    tags = ["[A b p.3]", "[A b p.1-2]", "[A b p.7]", "odd", "[C p.?]"]
    df = spark.createDataFrame([(1, t) for t in tags], "k int, citation string")
    assert sorted(r.citation for r in X.compress_citations(df, "k").collect()) == ["[A b p.1–3, 7]", "[[C p.?]]", "[odd]"]
    turns = spark.createDataFrame([(1, 1, "call foo as bar. use 'new x' instead of foo"), (1, 2, "refer to foo as baz")], "conv_id int, turn int, q string")
    assert {r.src: r.dst for r in X.learn_aliases(turns).collect()} == {"foo": "baz"}
    text = spark.createDataFrame([("a cat, concat $1",)], "text string")
    assert X.apply_aliases(text, [("cat", "dog$1")]).first()[0] == "a dog$1, concat $1"
    wide = spark.createDataFrame([(1, "[D p.1-99999999]"), (1, "[D p.5]"), (1, "[D p.100000000-100000002]"), (1, "[D p.100000009]")], "k int, citation string")
    assert [r.citation for r in X.compress_citations(wide, "k").collect()] == ["[D p.1–100000002, 100000009]"]


def test_many_aliases_are_the_fold(spark):
    import random
    import re

    rng = random.Random(5)
    words = ["".join(rng.choice("abcé") for _ in range(rng.randint(1, 3))) for _ in range(80)] + ["a b", "b.c", "$1"]
    pairs = [(rng.choice(words), rng.choice([*words, "", "\\1"])) for _ in range(10_000)]
    texts = [" ".join(rng.choice(words) for _ in range(25)) for _ in range(40)] + ["", None]

    def fold(text):
        for src, dst in pairs:
            if src and src != dst and text is not None:
                text = re.sub(rf"\b{re.escape(src)}\b", lambda _: dst, text)  # noqa: B023
        return text

    df = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    got = [r.text for r in X.apply_aliases(df, pairs).sort("k").collect()]
    assert got == [fold(t) for t in texts]
    assert len(X.apply_aliases(df, pairs)._jdf.queryExecution().toString()) < 4000


def test_composition_only_where_it_matters(spark):
    import unicodedata

    texts = ["plain", "é ü ß — “quoted” … ×÷≤", "ｆ（ｘ）＝½", "A\u030a", "\u1112\u1161\u11ab", "中文 текст ελ", "a\u0301\u0323", "\uff76\uff9e ㍿", "", "x²\u00a0y\u2028z", "क\u093c", "😀🄰"]
    df = spark.createDataFrame(list(enumerate([*texts, None])), "k int, text string")
    got = [r.x for r in df.select("k", T.nfkc("text").alias("x")).sort("k").collect()]
    assert got == [unicodedata.normalize("NFKC", t) for t in texts] + [None]
    rows = spark.createDataFrame([(1, 0, "㍿"), (1, 1, "fine"), (2, 0, "\u3000\u2028"), (2, 1, "ﾡ")], "k int, i int, text string")
    assert sorted((r.k, r.i) for r in P.language_gate(rows, "k").collect()) == [(1, 1), (2, 0), (2, 1)]
    page = spark.createDataFrame([(1, "", "", "ｙ ＝ x² + １\u2028z\x0bw = ∬ v")], "rid int, heading_path string, section_tag string, text string")
    assert [(r.line_no, r.line) for r in M.candidate_lines(page).sort("line_no").collect()] == [(0, "y = x2 + 1"), (1, "z"), (2, "w = ∫∫ v")]


def test_ranker_scores_are_the_models(spark):
    from pyspark.ml.functions import vector_to_array

    from quillion.operators import training as R2

    rows = [("q cat dog", "cat dog here", 1.0), ("q cat", "fish", 0.0), ("one two", "one two three", 1.0), ("one", "four five six", 0.0)] * 5
    pairs = spark.createDataFrame(rows, "question string, chunk_text string, score double")
    model = R2.train_ranker(pairs)
    seen = R.pair_features(pairs.withColumn("text", F.col("chunk_text")))
    theirs = [round(r.p, 6) for r in model.transform(seen).select(vector_to_array("probability")[1].alias("p")).collect()]
    mine = [r.pair_score for r in R2.rank_scorer(model)(seen).collect()]
    assert np.allclose(mine, theirs, atol=1.1e-6)
    assert min(m for m, r in zip(mine, rows) if r[2]) > max(m for m, r in zip(mine, rows) if not r[2])


def test_pair_features_are_of_whole_texts(spark):
    from quillion.operators import training as R2

    long = "filler " * 400
    rows = [(1, 1, "cat dog", long + "Cat  dog", "d"), (1, 2, "cat dog", "cat", "d"), (1, 3, "cat dog", None, "d")]
    df = spark.createDataFrame(rows, "question_id int, pos int, question string, text string, doc_name string")
    got = [(round(r.f_jaccard, 6), r.f_cover, round(r.f_length, 6)) for r in R.pair_features(df).sort("pos").collect()]
    assert got == [(round(2 / 3, 6), 1.0, round(float(np.log(403)), 6)), (0.5, 0.5, round(float(np.log(2)), 6)), (0.0, 0.0, 0.0)]
    # A model reranks by whole texts, the plain score by what its SQL takes.
    by_cover = R.rerank(df, lambda x: x.withColumn("pair_score", F.col("f_cover")))
    assert [r.pos for r in by_cover.sort("new_rank").collect()] == [1, 2, 3]
    assert [r.pos for r in R.rerank(df).sort("new_rank").collect()] == [2, 1, 3]
    far = [(long + "cat dog", 1.0), (long + "fish", 0.0)] * 5
    pairs = spark.createDataFrame([("cat dog", t, s) for t, s in far], "question string, chunk_text string, score double")
    score = R2.rank_scorer(R2.train_ranker(pairs))(R.pair_features(pairs.withColumn("text", F.col("chunk_text"))))
    assert score.where("score = 1").agg(F.min("pair_score")).first()[0] > score.where("score = 0").agg(F.max("pair_score")).first()[0]


def test_models_learn_their_fixtures(spark):
    from quillion import plans

    report = plans.queries()["tr5_train_classifier"](spark, "/root/testdata/sf0.001").first()
    assert report.accuracy > 0.5  # five labels
    pairs = plans.queries()["tr6_train_ranker"](spark, "/root/testdata/sf0.001").toPandas()
    right, wrong = pairs[pairs.score == 1].pair_score, pairs[pairs.score == 0].pair_score
    assert np.mean([a > b for a in right for b in wrong]) > 0.9


def test_topk_in_blocks_with_cuts(spark, monkeypatch):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(600, 6)) * np.exp(rng.normal(size=(600, 1)))  # lengths that differ much
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "rid long, embedding array<double>")
    q = df.where("rid < 30").select(F.col("rid").alias("question_id"), "embedding")
    want = {(i, int(j)) for i in range(30) for j in np.lexsort((np.arange(600), -np.round(x @ x[i], 6)))[:7]}
    for block, stretch in ((2_000_000, 2048), (40, 16)):
        monkeypatch.setattr(V, "QUERY_BLOCK", block)
        monkeypatch.setattr(V, "STRETCH", stretch)
        found = V.vector_topk(q, df.repartition(3), 7)
        assert {(r.question_id, r.rid) for r in found.collect()} == want
    assert V.vector_topk(q.limit(0), df, 3).count() == 0


def test_formula_items_and_veto(spark):
    sheet = spark.createDataFrame([(1, "Area — $$ a^2 $$ [d p.1] — side\n- no — $$x$$\nBare — $$b$$")], "k int, sheet string")
    got = M.parse_formula_items(sheet, "k").sort("number").collect()
    assert [(r.number, r.label, r.formula, r.citation, r.note) for r in got] == [(1, "Area", "a^2", "[d p.1]", "side"), (2, "Bare", "b", "", "")]
    texts = spark.createDataFrame([("x = 1",), ("plain words",), ("ISBN 978-0-306-40615-7 = x",), ("",), ("sin of it",), ("sinful",)], "text string")
    assert [r[0] for r in texts.select(L.formula_veto("text")).collect()] == [False, True, True, True, False, True]


def test_mmr_is_a_permutation_and_topk_exact(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(30, 8))
    rows = [(1, i, i + 1, float(i % 5), x[0].tolist(), x[i].tolist()) for i in range(30)]
    df = spark.createDataFrame(rows, "question_id long, rid long, pos int, base double, q_vec array<double>, embedding array<double>")
    for parts in (1, 4):
        order = R.mmr_order(df.repartition(parts), cap=20).sort("mmr_rank").collect()
        assert sorted(r.rid for r in order) == list(range(30)) and [r.rid for r in order[20:]] == list(range(20, 30))
        assert order[0].rid == 0
    picked = [r.rid for r in R.mmr(df, 4).sort("mmr_rank").collect()]
    base, sims, like = [float(i % 5) for i in range(30)], (x @ x[0]).tolist(), (x @ x.T).tolist()
    assert picked == greedy([0.75 * b for b in base], [0.75 * b + 0.25 * s for b, s in zip(base, sims)], like, 4, 0.25)
    u = x[:20] / (np.linalg.norm(x[:20], axis=1, keepdims=True) + 1e-8)
    near = (u @ u[0]).tolist()
    assert [r.rid for r in order[:20]] == greedy([0.7 * s for s in near], near, (u @ u.T).tolist(), 20, 0.3)
    q = df.where("rid < 3").select(F.col("rid").alias("question_id"), "embedding")
    got = [(r.question_id, r.rid) for r in V.vector_topk(q, df.select("rid", "embedding").repartition(5), 4).sort("question_id", F.desc("score")).collect()]
    assert got == [(i, int(j)) for i in range(3) for j in np.argsort(-(x @ x[i]))[:4]]


def test_usage_windows_batch_equals_stream(spark):
    rows = spark.sql("SELECT timestamp'2024-01-01 00:00:10' AS ts, 5L AS tokens UNION ALL SELECT timestamp'2024-01-01 00:00:50', 6L UNION ALL SELECT timestamp'2024-01-01 00:01:00', 1L")
    got = [(r.tokens, r.requests, r.over) for r in jobs.usage_windows(rows, 10, 5).sort("start").collect()]
    assert got == [(11, 2, True), (1, 1, False)]
