"""Lexical and hybrid ranking, diversity, scoping and merging of hits."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from quillion.functions.text import ascii_tokens, collapse, set_overlap, word_tokens
from quillion.operators.vectors import hits_to_chunks, max_normalize, vector_topk
from quillion.sources.store import keep

# Word lists that scores depend on.
FORMULA_KEYS = "(formula|equation|equations|law|laws|rule|rules|identity|identities|theorem|theorems|lemma|lemmas|corollary|corollaries)"
FORMULA_WORDS = "(formula|formulas|identity|identities|equation|equations|rule|rules|laws|law)"
EXPLAIN_KEYS = "(explain|why|proof|prove|derivation|derive|intuition)"
EXPLAIN_WORDS = "(explain|why|derive|derivation|proof|prove|show)"
SURFACE = r"(=|\+|-|\*|/|×|÷|≤|≥|√|∑|∫|f\(|g\(|h\()"
BAD_SECTIONS = "(answers|supplementary exercises|references|bibliography)"
KEY_TERMS = "(theorem|lemma|corollary|axiom|law|rule|identity|property|postulate|proposition)"
PENALTY_STARTS = "^(determine|how many|prove that)"


def term_stats(df: DataFrame, key: str) -> DataFrame:
    """``key, rid, term, tf, dl, df, n_docs, avgdl`` of the candidates (key, rid, text) of each
    key. Tokens are counted once a row, before anything is shuffled by term."""
    rows = df.select(key, "rid", ascii_tokens("text").alias("w")).withColumn("dl", F.size("w"))
    sizes = rows.groupBy(key).agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avgdl"))
    tf = rows.select(key, "rid", "dl", F.explode("w").alias("term")).groupBy(key, "rid", "dl", "term").agg(F.count("*").alias("tf"))
    found = tf.groupBy(key, "term").agg(F.count("*").alias("df"))
    return tf.join(found, [key, "term"]).join(sizes, key)


def bm25(questions: DataFrame, candidates: DataFrame, k1: float = 1.5, b: float = 0.75) -> DataFrame:
    """``question_id, rid, bm25`` of each question's candidates (question_id, rid, text), over
    the question's largest. Statistics are those of the question's candidates, repeated
    question words count each time, and candidates that share no word score 0."""
    words = questions.select("question_id", F.explode(ascii_tokens("question")).alias("term"))
    words = words.groupBy("question_id", "term").agg(F.count("*").alias("times"))
    rows = candidates.select("question_id", "rid", ascii_tokens("text").alias("w")).withColumn("dl", F.size("w"))
    sizes = rows.groupBy("question_id").agg(F.count("*").alias("n_docs"), F.avg("dl").alias("avgdl"))
    # Only words of the question are counted, so each candidate sends few rows to the shuffle.
    tf = rows.select("question_id", "rid", "dl", F.explode("w").alias("term")).join(words, ["question_id", "term"])
    tf = tf.groupBy("question_id", "rid", "dl", "term", "times").agg(F.count("*").alias("tf"))
    found = tf.groupBy("question_id", "term").agg(F.count("*").alias("df"))
    scored = tf.join(found, ["question_id", "term"]).join(sizes, "question_id")
    idf = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = F.col("times") * idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    total = scored.groupBy("question_id", "rid").agg(F.sum(part).alias("bm25"))
    every = candidates.select("question_id", "rid").join(total, ["question_id", "rid"], "left").na.fill(0.0, ["bm25"])
    return max_normalize(every, "question_id", "bm25")


def question_intent(q: DataFrame) -> DataFrame:
    s = F.lower(F.coalesce("question", F.lit("")))
    return q.withColumns(
        {
            "is_formula_query": s.rlike(FORMULA_KEYS),
            "wants_explanation": s.rlike(EXPLAIN_KEYS),
            "has_formula_word": s.rlike(FORMULA_WORDS),
            "has_explain_word": s.rlike(EXPLAIN_WORDS),
            "is_task": F.trim(s).rlike(PENALTY_STARTS),
        }
    )


def _pure() -> Column:
    return F.col("is_formula_query") & ~F.col("wants_explanation")


def section_filter(hits: DataFrame) -> DataFrame:
    """For formula questions that want no explanation: no answer or reference sections, and
    both scores at 0.85 if the question sets a task. ``hits`` bear intent flags."""
    bad = F.lower(F.coalesce("section_tag", F.lit(""))).rlike(BAD_SECTIONS)
    less = F.when(_pure() & F.col("is_task"), 0.85).otherwise(1.0)
    return hits.where(~(_pure() & bad)).withColumns({"score": F.col("score") * less, "bm25": F.col("bm25") * less})


def strict_formula(hits: DataFrame, confidence: float = 0.75) -> DataFrame:
    """For such questions only rows labelled formula with confidence or a mathematical surface;
    a question that would lose all its rows keeps them."""
    strict = F.coalesce(F.col("is_formula") & ((F.coalesce("formula_confidence", F.lit(0.0)) >= confidence) | F.col("text").rlike(SURFACE)), F.lit(False))
    some = F.max("__strict").over(Window.partitionBy("question_id"))
    marked = hits.withColumn("__strict", strict).withColumn("__some", some)
    return marked.where(~_pure() | F.col("__strict") | ~F.col("__some")).drop("__strict", "__some")


def rank_bonus(hits: DataFrame) -> DataFrame:
    """Add ``bonus``: equation, exercises, key terms, semantic label, and for formula questions
    the formula label."""
    label = F.lower(F.coalesce("semantic_label", F.lit("")))
    semantic = F.when(label == "definition", 0.10).when(label.isin("theorem", "rule"), 0.08).when(label == "example", -0.04).when(label == "exercise", -0.08).otherwise(0.0)
    p = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce("formula_confidence", F.lit(0.0))))
    formula = F.when(~F.col("is_formula_query"), 0.0).when(F.col("is_formula"), 0.35 * p).otherwise(-0.5)
    bonus = (
        F.when(F.col("is_equation"), 0.12).otherwise(0.0)
        + F.when(F.lower("section_tag") == "exercises", -0.10).otherwise(0.0)
        + F.when(F.lower("text").rlike(KEY_TERMS), 0.08).otherwise(0.0)
        + semantic
        + formula
    )
    return hits.withColumn("bonus", bonus)


def hybrid_search(questions: DataFrame, chunks: DataFrame, vectors: DataFrame, k: int = 5, pool: int | None = None) -> DataFrame:
    """The k best chunks of each question by 0.7 vector + 0.3 BM25 + bonuses, ``rank`` from 1.
    ``questions`` (question_id, question, embedding), ``chunks`` (rid, text, ...), ``vectors``
    (rid, embedding); vectors without a chunk take places of the pool and then drop."""
    hits = vector_topk(questions, vectors, pool or max(128, k))
    # The pool of each question is searched once; its rows feed scores, statistics and ranks.
    rows = keep(max_normalize(hits_to_chunks(hits, chunks), "question_id", "score"), "pool")
    lexical = bm25(questions, rows)
    rows = rows.join(lexical, ["question_id", "rid"]).join(question_intent(questions.drop("embedding")), "question_id")
    rows = rank_bonus(strict_formula(section_filter(rows)))
    total = 0.7 * F.col("score") + 0.3 * F.col("bm25") + F.col("bonus")
    # What only the order of additions tells apart is a tie.
    w = Window.partitionBy("question_id").orderBy(F.desc(F.round("hybrid", 9)), "rid")
    return rows.withColumn("hybrid", total).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-8)


def _greedy(gain: np.ndarray, first: np.ndarray, like: np.ndarray, k: int, penalty: float) -> list[int]:
    """Indices picked one by one: the largest ``first``, then the largest gain less penalty
    times the closest likeness to those picked; the first of equals."""
    chosen, nearest, free = [], np.full(len(gain), -np.inf), np.ones(len(gain), bool)
    while len(chosen) < min(k, len(gain)):
        value = gain - penalty * nearest if chosen else first
        at = int(np.argmax(np.where(free, value, -np.inf)))
        chosen.append(at)
        free[at] = False
        nearest = np.maximum(nearest, like[at])
    return chosen


def mmr(hits: DataFrame, k: int, lam: float = 0.75) -> DataFrame:
    """Add ``mmr_rank`` to the k hits of each question that maximal marginal relevance picks.
    ``hits`` (question_id, rid, base, q_vec, embedding); a question's hits are a bounded pool."""

    def pick(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("rid").reset_index(drop=True)
        x, q, base = np.stack(rows["embedding"]).astype(float), np.asarray(rows["q_vec"][0], float), rows["base"].to_numpy(float)
        chosen = _greedy(lam * base, lam * base + (1 - lam) * (x @ q), x @ x.T, k, 1 - lam)
        return pd.DataFrame({"question_id": rows["question_id"][0], "rid": rows["rid"].to_numpy()[chosen], "mmr_rank": range(1, len(chosen) + 1)})

    slim = hits.select("question_id", "rid", "base", "q_vec", "embedding")
    return slim.groupBy("question_id").applyInPandas(pick, "question_id long, rid long, mmr_rank int")


def mmr_order(hits: DataFrame, top_n: int = 200, cap: int = 60, alpha: float = 0.7) -> DataFrame:
    """Add ``mmr_rank`` to all rows of a ranked list (question_id, rid, pos from 1): the first
    rows are reordered for diversity, the rest follow; two rows or fewer stay as they are."""
    n = min(top_n, cap)

    def order(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pos").reset_index(drop=True)
        chosen = list(range(len(rows)))
        if len(rows) > 2:
            x, q = _unit(np.stack(rows["embedding"]).astype(float)), _unit(np.asarray(rows["q_vec"][0], float)[None])[0]
            sims = x @ q
            chosen = _greedy(alpha * sims, sims, x @ x.T, len(rows), 1 - alpha)
        return pd.DataFrame({"question_id": rows["question_id"][0], "rid": rows["rid"].to_numpy()[chosen], "mmr_rank": range(1, len(chosen) + 1)})

    head = hits.where(F.col("pos") <= n).select("question_id", "rid", "pos", "q_vec", "embedding")
    head = head.groupBy("question_id").applyInPandas(order, "question_id long, rid long, mmr_rank int")
    tail = hits.where(F.col("pos") > n).select("question_id", "rid", F.col("pos").cast("int").alias("mmr_rank"))
    return head.unionByName(tail)


HEAD = 800  # characters of a text that the plain pair score of ``rerank`` sees


def pair_features(df: DataFrame, head: int | None = None) -> DataFrame:
    """Add overlap and likeness of question and text, for pair models: of the whole text, or of
    its first ``head`` characters."""
    q, t = word_tokens("question"), word_tokens("text" if head is None else F.substring(collapse("text"), 1, head))
    return df.withColumns(
        {
            "f_jaccard": set_overlap(q, t),
            "f_cover": F.size(F.array_intersect(q, t)) / F.greatest(F.lit(1), F.size(F.array_distinct(q))),
            "f_length": F.log(1.0 + F.size(t)),
        }
    )


def rerank(hits: DataFrame, model=None, top_n: int = 200) -> DataFrame:
    """Add ``new_rank``: the first ``top_n`` hits (``pos`` from 1) by a pair model's score, the
    rest in order after them. ``model`` adds ``pair_score`` from features of whole texts; by
    default it is 0.7 cover + 0.3 Jaccard of the question and the text's first ``HEAD`` characters."""
    scored = pair_features(hits, None if model else HEAD)
    scored = model(scored) if model else scored.withColumn("pair_score", F.round(0.7 * F.col("f_cover") + 0.3 * F.col("f_jaccard"), 6))
    tail = F.col("pos") > top_n
    w = Window.partitionBy("question_id").orderBy(tail, F.when(tail, 0.0).otherwise(-F.col("pair_score")), "pos")
    return scored.withColumn("new_rank", F.row_number().over(w))


def scope_docs(hits: DataFrame, strict: bool = True) -> DataFrame:
    """Hits (question_id, question, doc_name, pos) of the document that the question names: by a
    course code, else by any token of four characters and more, at the first hit that fits;
    else of the document with most hits. Without ``strict`` that document goes first."""
    code = F.lower(F.regexp_extract("question", r"\b([A-Z]{2,}[0-9]{2,})\b", 1))
    words = F.regexp_extract_all(F.lower("question"), F.lit("([a-z0-9_.\\-]{4,})"), 1)
    name = F.lower(F.trim(F.coalesce("doc_name", F.lit(""))))
    marked = hits.withColumns(
        {"__code": (code != "") & F.contains(name, code), "__word": (name != "") & F.exists(words, lambda w: F.contains(name, w))}
    )
    q = Window.partitionBy("question_id")
    counted = marked.where(name != "").groupBy("question_id", "doc_name").agg(F.count("*").alias("n"), F.min("pos").alias("first"))
    common = counted.groupBy("question_id").agg(F.max_by("doc_name", F.struct("n", -F.col("first"))).alias("common"))
    named = marked.groupBy("question_id").agg(
        F.min_by("doc_name", F.when(F.col("__code"), F.col("pos"))).alias("by_code"),
        F.min_by("doc_name", F.when(F.col("__word"), F.col("pos"))).alias("by_word"),
        F.max("__code").alias("any_code"),
        F.max("__word").alias("any_word"),
    )
    target = named.join(common, "question_id", "left").select(
        "question_id", F.when(F.col("any_code"), F.col("by_code")).when(F.col("any_word"), F.col("by_word")).otherwise(F.col("common")).alias("target")
    )
    found = hits.join(target, "question_id").withColumn("in_target", F.coalesce(F.trim("doc_name") == F.col("target"), F.lit(False)))
    if strict:
        return found.where(F.col("in_target") | F.col("target").isNull()).drop("in_target")
    return found.withColumn("pos", F.row_number().over(q.orderBy(~F.col("in_target"), "pos"))).drop("in_target")


def filter_chapter(hits: DataFrame, window: int = 40) -> DataFrame:
    """Where a question names a chapter or section, hits whose heading bears it and those within
    ``window`` pages of the middle of their pages; where none does, all, those with most
    heading words of the request first (``pos`` renumbered)."""
    number = lambda c, rx: F.nullif(F.regexp_extract(c, rx, 1), F.lit(""))
    hp = F.lower(F.coalesce(F.nullif(F.col("heading_path"), F.lit("")), F.col("section_tag"), F.lit("")))
    want_ch = number("question", r"(?i)\b(?:chapter|chap|ch)\s*([0-9]{1,3})\b").cast("int")
    want_sec = number("question", r"(?i)(?:\bsection|\bsec|§)\s*([0-9]+(?:\.[0-9]+)*)")
    has_ch = F.coalesce(number(hp, r"\bchapter\s*([0-9]{1,3})\b"), number(hp, r"^\s*([0-9]{1,3})(?:\.[0-9]+)*\b")).cast("int")
    has_sec = number(hp, r"\bsection\s*([0-9]+(?:\.[0-9]+)*)\b")
    rows = hits.withColumns({"__ch": want_ch, "__sec": want_sec, "__hit": F.coalesce(F.when(want_ch.isNotNull(), has_ch == want_ch).otherwise(has_sec.startswith(want_sec)), F.lit(False))})
    q = Window.partitionBy("question_id")
    mid = F.floor(F.median(F.when(F.col("__hit") & (F.col("page_start") > 0), F.col("page_start"))).over(q))
    rows = rows.withColumns({"__some": F.max("__hit").over(q), "__mid": mid})
    asked = F.col("__ch").isNotNull() | F.col("__sec").isNotNull()
    near = F.col("page_start").between(F.greatest(F.lit(1), F.col("__mid") - window), F.col("__mid") + window)
    kept = rows.where(~asked | ~F.col("__some") | F.col("__hit") | F.coalesce(near, F.lit(False)))
    words = F.filter(F.array(F.lit("chapter"), F.col("__ch").cast("string"), F.col("__sec")), lambda w: w.isNotNull())
    score = F.size(F.filter(words, lambda w: F.contains(F.lower(F.coalesce("heading_path", F.lit(""))), w)))
    group = F.when(~asked, 0).when(F.col("__some"), F.when(F.col("__hit"), 0).otherwise(1)).otherwise(-score)
    return kept.withColumn("pos", F.row_number().over(q.orderBy(group, "pos"))).drop("__ch", "__sec", "__hit", "__some", "__mid")


def page_num(*cols: str) -> Column:
    """The first positive number of the columns, else 0."""
    return F.coalesce(*[F.when(F.col(c) > 0, F.col(c)) for c in cols], F.lit(0))


WORD_BLOCK = 2_000_000  # query words that go to every task at a time


def shared_words(queries: DataFrame, rows: DataFrame, key: list[str], k: int) -> DataFrame:
    """Key, ``name, shared``: for each query (key, words) the k rows (name, words) that share most
    of its words, ties by name, none that shares no word; words are distinct.

    A word that all have would bring all pairs to one task of a join. Instead queries go to the
    tasks in blocks of bounded size, one block after the other, as an index of their words; a
    task counts for each of its rows and keeps its own k best of each query. What it holds are
    whole numbers, and of those only what the k-th best so far does not rule out."""
    q = keep(queries.select(*key, F.posexplode_outer("words").alias("__n", "w")).where("w is not null").drop("__n"), "words")
    spark, sc = queries.sparkSession, queries.sparkSession.sparkContext
    n = max(1, -(-q.count() // WORD_BLOCK))
    slim = rows.select("name", "words").where("name is not null")
    shape = StructType([*(f for f in q.schema.fields if f.name in key), *slim.select("name").schema.fields, StructField("shared", LongType())])
    found = spark.createDataFrame([], shape)
    for block in range(n):
        part = q.where(F.pmod(F.xxhash64(*key), F.lit(n)) == block).groupBy(*key).agg(F.collect_list("w").alias("words")).toArrow().combine_chunks()
        words = pc.list_flatten(part["words"]).combine_chunks().dictionary_encode()
        code, at = words.indices.to_numpy(), np.repeat(np.arange(len(part), dtype=np.int32), pc.list_value_length(part["words"]).to_numpy())
        starts = np.concatenate([[0], np.cumsum(np.bincount(code, minlength=len(words.dictionary)))])
        names = [part[c].combine_chunks() for c in key]
        sent = sc.broadcast((names, words.dictionary, starts, at[np.argsort(code, kind="stable")]))
        found = found.unionByName(keep(slim.mapInArrow(_shared(sent, k, shape.names), shape), "shared"))
        sent.destroy()
    w = Window.partitionBy(*key).orderBy(F.desc("shared"), "name")
    return found.withColumn("n", F.row_number().over(w)).where(F.col("n") <= k).drop("n")


HELD = 1_000_000  # counts that a task gathers before it drops all but the best


def _shared(sent, k: int, columns: list[str]):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, vocabulary, starts, queries = sent.value
        cut = np.ones(len(names[0]), np.int64)  # what a count of each query must reach
        held: list[tuple[np.ndarray, ...]] = []  # queries, counts and places of the row's name
        texts: list = []
        size, kind = 0, pa.string()

        def best() -> None:
            nonlocal held, texts, size
            at, shared, who = (np.concatenate(x) for x in zip(*held))
            _, rank = np.unique(np.array(texts, object), return_inverse=True)
            order = np.lexsort((rank[who], -shared, at))
            at, shared, who = at[order], shared[order], who[order]
            first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
            place = np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))
            cut[at[place == k - 1]] = shared[place == k - 1]
            used, new = np.unique(who[place < k], return_inverse=True)
            texts = [texts[x] for x in used]
            held, size = [(at[place < k], shared[place < k], new)], int((place < k).sum())

        for batch in batches:
            kind = batch.column(0).type
            code = pc.fill_null(pc.index_in(batch.column(1).flatten(), value_set=vocabulary), -1).to_numpy(zero_copy_only=False)
            ends = np.cumsum(pc.fill_null(pc.list_value_length(batch.column(1)), 0).to_numpy(zero_copy_only=False))
            earlier = len(held)
            for row, own in enumerate(np.split(code, ends[:-1])):
                hits = [queries[starts[c] : starts[c + 1]] for c in own[own >= 0]]
                if hits:
                    shared = np.bincount(np.concatenate(hits), minlength=len(cut))
                    at = np.flatnonzero(shared >= cut)
                    if len(at):
                        held.append((at, shared[at], np.full(len(at), len(texts), np.int32)))
                        texts.append(batch.column(0)[row].as_py())
                        size += len(at)
                if size > HELD + 2 * k * len(cut):
                    best()
                    earlier = 1
            if len(held) > earlier:  # the arrays of a batch as one, since rows may bring few counts each
                held[earlier:] = [tuple(np.concatenate(x) for x in zip(*held[earlier:]))]
        if held:
            best()
            at, shared, who = held[0]
            yield pa.RecordBatch.from_arrays([*(x.take(pa.array(at)) for x in names), pa.array([texts[x] for x in who], kind), pa.array(shared, pa.int64())], names=columns)

    return count


def relevance_gate(questions: DataFrame, topics: DataFrame, thr: float = 0.20) -> DataFrame:
    """Add ``relevance``, the largest share of a question's words that one topic (name, text)
    has, null where either side has none, and ``keep``."""
    q = questions.withColumn("__w", F.array_distinct(word_tokens("question", 2)))
    t = topics.select("name", F.array_distinct(word_tokens("text", 2)).alias("words")).where(F.size("words") > 0)
    best = shared_words(q.select("question_id", F.col("__w").alias("words")), t, ["question_id"], 1).select("question_id", F.col("shared").alias("n"))
    any_topic = t.limit(1).select(F.lit(True).alias("any_topic"))
    out = q.join(best, "question_id", "left").join(F.broadcast(any_topic), F.lit(True), "left")
    score = F.when((F.size("__w") > 0) & F.col("any_topic"), F.coalesce("n", F.lit(0)) / F.size("__w"))
    named = F.lower("question").rlike(r"(textbook|chapter|section|lecture|notes|\.(pdf|docx))")
    out = out.withColumn("relevance", F.round(score, 6)).drop("__w", "n", "any_topic")
    return out.withColumn("keep", F.col("relevance").isNull() | (F.col("relevance") >= thr) | named)


def token_overlap(df: DataFrame) -> DataFrame:
    """Add the share of the question's words, repeats included, that the text has."""
    q, t = word_tokens("question", 2), word_tokens("text", 2)
    return df.withColumn("overlap", F.size(F.filter(q, lambda w: F.array_contains(t, w))) / F.greatest(F.lit(1), F.size(q)))


def expand_queries(q: DataFrame, k: int = 3) -> DataFrame:
    base = F.trim("question")
    forms = F.array(
        base,
        F.concat(base, F.lit(" key formulas")),
        F.concat(base, F.lit(" canonical definitions")),
        F.concat(base, F.lit(" symbols and variables list")),
        F.concat(F.lit("core formulas for "), base),
    )
    return q.where(base != "").select("question_id", F.posexplode(F.array_distinct(F.slice(forms, 1, k))).alias("n", "query"))


def cluster_hits(hits: DataFrame) -> DataFrame:
    key = F.concat_ws("|", F.coalesce("doc_name", F.lit("unknown")), F.coalesce("heading_path", F.lit("")), F.concat_ws("-", "page_start", "page_start"))
    return hits.groupBy("question_id", key.alias("cluster")).agg(F.count("*").alias("n"), F.array_join(F.sort_array(F.collect_list("rid")).cast("array<string>"), ",").alias("rids"))


def chapter_ranges(hits: DataFrame) -> DataFrame:
    chapter = F.coalesce("heading_path", F.lit("unknown"))
    return hits.groupBy("doc_name", chapter.alias("chapter")).agg(F.min("page_start").alias("first_page"), F.max("page_start").alias("last_page"))


def jaccard_judge(hits: DataFrame) -> DataFrame:
    task = F.lower("text").rlike("(exercise|show that|prove that|find the value)")
    score = set_overlap(word_tokens("question"), word_tokens("text")) - F.when(task, 0.1).otherwise(0.0)
    return hits.withColumn("judge", F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)), 6))


def merge_evidence(web: DataFrame, hits: DataFrame, memory: DataFrame, k: int, overlap: float = 0.45) -> DataFrame:
    """Rows (question_id, pos, text, ...) of search results, then the k first hits, then memory,
    as ``place`` from 1. Hits are left out where results overlap the question enough and it
    names no document. ``web`` bears question and overlap."""
    rich = web.groupBy("question_id").agg(F.max("overlap").alias("o"), F.max(F.lower("question").rlike(r"(textbook|chapter|section|lecture|notes|\.(pdf|docx))")).alias("names"))
    local = hits.where(F.col("pos") <= k).join(rich, "question_id", "left").where(F.col("o").isNull() | F.col("names") | (F.col("o") < overlap))
    cols = ["question_id", "pos", "text"]
    rows = [df.select(*cols, F.lit(n).alias("kind")) for n, df in enumerate((web, local, memory))]
    w = Window.partitionBy("question_id").orderBy("kind", "pos")
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).withColumn("place", F.row_number().over(w))


def pre_order(hits: DataFrame) -> DataFrame:
    """Add ``order_score``: the score, 0.1 more for mathematics, 0.05 less for a table."""
    score = F.col("score") + F.when(F.col("has_math"), 0.1).otherwise(0.0) - F.when(F.col("has_table"), 0.05).otherwise(0.0)
    return hits.withColumn("order_score", F.round(score, 6))
