"""Checking answers sentence by sentence against evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillion.functions.text import sentences, trim_sentence, word_tokens
from quillion.operators.context import joined, source_tag
from quillion.operators.retrieval import expand_queries, hybrid_search, shared_words
from quillion.sources.store import keep

TASKS = r"(?i)\b(exercise|prove|show\s+that|determine|find\s+the\s+value|question)\b"
FORMULAISH = r"([=≤≥<>±×÷∑∏∫√∂∞∇≈≃≅≡→↦↔∝∈∉∩∪⊂⊆⊇∧∨¬∀∃°]|\b[0-9]+/[0-9]+\b)"


def answer_sentences(answers: DataFrame, key: list[str]) -> DataFrame:
    return answers.select(*key, F.posexplode(sentences("draft", "c")).alias("n", "sentence"))


def support(rows: DataFrame, evidence: DataFrame, key: list[str], on: list[str] | None = None) -> DataFrame:
    """Add ``score``, the best token-set Jaccard of a sentence (key, n, sentence) over the
    evidence (``on``, by default the first key column; pos, source, text) of its question, and
    its ``source``; the first of equals, none at 0. Shared tokens are counted by an equi-join on the token."""
    q = on or key[:1]
    s = rows.select(*key, "n", F.array_distinct(word_tokens("sentence")).alias("w")).withColumn("ns", F.size("w"))
    e = evidence.select(*q, "pos", "source", F.array_distinct(word_tokens("text")).alias("w")).withColumn("ne", F.size("w"))
    st = s.select(*key, "n", "ns", F.explode("w").alias("t"))
    et = e.select(*q, "pos", "source", "ne", F.explode("w").alias("t"))
    shared = st.join(et, [*q, "t"]).groupBy(*key, "n", "ns", "pos", "source", "ne").agg(F.count("*").alias("both"))
    score = F.round(F.col("both") / (F.col("ns") + F.col("ne") - F.col("both")), 6)
    shared = shared.withColumn("score", score)
    best = shared.groupBy(*key, "n").agg(F.max_by(F.struct("score", "source"), F.struct("score", -F.col("pos"))).alias("b"))
    out = rows.join(best, [*key, "n"], "left")
    return out.select(*rows.columns, F.coalesce("b.score", F.lit(0.0)).alias("score"), F.coalesce("b.source", F.lit("")).alias("source"))


def support_status(df: DataFrame, formula_mode: bool = False, threshold: float = 0.08, strong: float = 0.2) -> DataFrame:
    """Add ``status``: supported from ``threshold`` on; in formula mode tasks are skipped and
    sentences like formulas count; else weak from ``strong`` on, which says something only
    where ``strong`` is the lower of the two, and missing below."""
    score, sentence = F.col("score"), F.col("sentence")
    status = F.when(score >= threshold, "supported").when(score >= strong, "weak").otherwise("missing")
    if formula_mode:
        status = F.when(sentence.rlike(TASKS), "skipped").when(score >= threshold, "supported").when(sentence.rlike(FORMULAISH), "formula").otherwise("missing")
    return df.withColumn("status", status)


def prune_answers(df: DataFrame, key: list[str]) -> DataFrame:
    """Supported and formula sentences of each answer in order, or else its first sentence."""
    good = F.col("status").isin("supported", "formula")
    some = F.max(good).over(Window.partitionBy(*key))
    rows = df.withColumn("__good", good).withColumn("__some", some).where(F.col("__good") | (~F.col("__some") & (F.col("n") == 0)))
    return rows.groupBy(*key).agg(joined("sentence", "n", " ").alias("answer"), F.count("*").alias("kept"))


def second_pass(df: DataFrame, pruned: DataFrame, answers: DataFrame, more: DataFrame, key: list[str], on: list[str] | None = None) -> DataFrame:
    """Sentences of answers cut to under max(48, 40 %) of the draft are scored again against
    ``more`` evidence (see ``second_search``); the better score and its source stay."""
    short = too_short(pruned, answers, key)
    again = df.where("status = 'missing'").join(short, key, "left_semi").select(*key, "n", "sentence")
    again = support(again, more, key, on).select(*key, "n", F.col("score").alias("s2"), F.col("source").alias("src2"))
    out = df.join(again, [*key, "n"], "left")
    better = F.coalesce(F.col("s2") > F.col("score"), F.lit(False))
    return out.withColumn("source", F.when(better, F.col("src2")).otherwise(F.col("source"))).withColumn("score", F.greatest("score", F.coalesce("s2", F.lit(0.0)))).drop("s2", "src2")


def merge_citations(supported: DataFrame, given: DataFrame, key: list[str]) -> DataFrame:
    """``citation, place``: sources of supported sentences, then the citations given (pos),
    distinct in order."""
    a = supported.where("status in ('supported', 'formula') and source <> ''").select(*key, F.col("source").alias("citation"), F.lit(0).alias("kind"), F.col("n").cast("long").alias("pos"))
    b = given.where("coalesce(citation, '') <> ''").select(*key, "citation", F.lit(1).alias("kind"), F.col("pos").cast("long").alias("pos"))
    first = a.unionByName(b).groupBy(*key, "citation").agg(F.min(F.struct("kind", "pos")).alias("at"))
    return first.withColumn("place", F.row_number().over(Window.partitionBy(*key).orderBy("at", "citation"))).drop("at")


def citation_guard(citations: DataFrame, answers: DataFrame, evidence: DataFrame, key: list[str]) -> DataFrame:
    """Citations that the draft contains or that are sources of the question's evidence."""
    tags = evidence.select(key[0], F.col("source").alias("citation")).distinct().withColumn("hit", F.lit(True))
    rows = citations.join(answers.select(*key, "draft"), key).join(tags, [key[0], "citation"], "left")
    return rows.where(F.contains("draft", F.col("citation")) | F.col("hit")).drop("draft", "hit")


def judge_answers(df: DataFrame) -> DataFrame:
    """Add ``judge`` from draft and ``citations array``: 0.3; 0.6 with citations; 0.9 if the
    draft has them all; 0.1 less for task words; 0 for an empty draft."""
    base = F.when(F.size("citations") == 0, 0.3).when(F.forall("citations", lambda c: F.contains("draft", c)), 0.9).otherwise(0.6)
    score = base - F.when(F.lower("draft").rlike("(exercise|prove|show that|find the value)"), 0.1).otherwise(0.0)
    return df.withColumn("judge", F.when(F.coalesce("draft", F.lit("")) == "", 0.0).otherwise(F.round(score, 6)))


def self_consistency(cands: DataFrame, key: str) -> DataFrame:
    """Of the candidates (pos, citations, score) of a key the best of the largest group that
    cite the same; groups seen earlier, and earlier candidates, win ties."""
    cites = F.array_join(F.array_sort(F.array_distinct("citations")), "|")
    group = Window.partitionBy(key, "cites")
    rows = cands.withColumn("cites", cites).withColumns({"size": F.count("*").over(group), "first": F.min("pos").over(group)})
    w = Window.partitionBy(key).orderBy(F.desc("size"), "first", F.desc("score"), "pos")
    return rows.withColumn("n", F.row_number().over(w)).where("n = 1").drop("n", "first")


def excerpts(evidence: DataFrame, key: str, n: int = 5, limit: int = 220) -> DataFrame:
    """The first n texts, long ones cut at the last full stop within ``limit`` characters."""
    q = F.trim("text")
    cut = F.substring(q, 1, limit)
    whole = F.when(F.contains(cut, F.lit(".")), F.regexp_extract(cut, r"^([\s\S]*\.)", 1)).otherwise(cut)
    rows = evidence.where(q != "").withColumn("quote", F.when(F.length(q) > limit, whole).otherwise(q))
    w = Window.partitionBy(key).orderBy("pos")
    return rows.withColumn("n", F.row_number().over(w)).where(F.col("n") <= n).select(key, "n", "quote", "source")


def support_report(df: DataFrame, key: list[str]) -> DataFrame:
    by = {s: F.count_if(F.col("status") == s).alias(f"n_{s}") for s in ("supported", "formula", "weak", "missing", "skipped")}
    report = df.groupBy(*key).agg(F.count("*").alias("total"), *by.values())
    kept = F.greatest(F.lit(1), F.col("n_supported") + F.col("n_formula"))
    return report.withColumn("kept", kept).withColumn("verdict", F.when(F.col("kept") < F.col("total"), "trimmed").otherwise("validated"))


def report_table(df: DataFrame, key: list[str], n: int = 12) -> DataFrame:
    """The first n sentences of each answer, trimmed."""
    w = Window.partitionBy(*key).orderBy("n")
    rows = df.withColumn("row", F.row_number().over(w)).where(F.col("row") <= n)
    return rows.select(*key, "row", trim_sentence("sentence", 160).alias("sentence"), "score", F.coalesce(F.nullif("source", F.lit("")), F.lit("-")).alias("source"), "status")


def second_search(short: DataFrame, questions: DataFrame, chunks: DataFrame, vectors: DataFrame, key: list[str], queries: int = 2, k: int = 6, pool: int | None = None) -> DataFrame:
    """More evidence (key, pos, source, text) for answers cut too short: the question in
    ``queries`` forms, the ``k`` best chunks of each. ``questions`` has key, question and
    embedding; all forms of a question search with its vector."""
    asked = short.select(*key).join(questions, key).select(F.struct(*key).alias("__key"), "question", "embedding")
    asked = asked.withColumn("question_id", F.to_json("__key"))
    forms = expand_queries(asked, queries).withColumnRenamed("question_id", "__of")
    forms = forms.join(asked.withColumnRenamed("question_id", "__of").drop("question"), "__of")
    forms = keep(forms.select(F.concat_ws("#", "__of", "n").alias("question_id"), F.col("query").alias("question"), "embedding", F.col("n").alias("__n"), "__key"), "forms")
    found = hybrid_search(forms.select("question_id", "question", "embedding"), chunks, vectors, k, pool)
    found = found.join(forms.select("question_id", "__n", "__key"), "question_id")
    return found.select("__key.*", (F.col("__n") * k + F.col("rank")).alias("pos"), source_tag().alias("source"), "text")


def too_short(pruned: DataFrame, answers: DataFrame, key: list[str]) -> DataFrame:
    """Keys of answers cut to under max(48, 40 %) of the draft."""
    return pruned.join(answers, key).where(F.length("answer") < F.greatest(F.lit(48), F.floor(F.length("draft") * 0.4))).select(*key)


def resolve_from_table(df: DataFrame, results: DataFrame, key: list[str], per_query: int = 4, enough: int = 6, questions: DataFrame | None = None) -> DataFrame:
    """Results (url, title, text) for the first two unsupported sentences of each answer, or else
    for its question (``questions``: key, question), found by shared words of more than four
    characters: the ``per_query`` best of each, distinct by url, and none from the second once
    the first gave ``enough``."""
    w = Window.partitionBy(*key).orderBy("n")
    asked = df.where("status in ('weak', 'missing')").withColumn("q", F.row_number().over(w)).where("q <= 2").select(*key, "q", "sentence")
    if questions is not None:
        rest = questions.join(asked.select(*key).distinct(), key, "left_anti").select(*key, F.lit(1).alias("q"), F.col("question").alias("sentence"))
        asked = asked.unionByName(rest)
    wanted = asked.select(*key, "q", F.array_distinct(word_tokens("sentence", 4)).alias("words"))
    terms = results.select(F.col("url").alias("name"), F.array_distinct(word_tokens("text", 4)).alias("words"))
    met = shared_words(wanted, terms, [*key, "q"], per_query).withColumnRenamed("name", "url")
    first = met.groupBy(*key, "url").agg(F.min("q").alias("q"), F.max("shared").alias("shared"))
    early = F.count_if(F.col("q") == 1).over(Window.partitionBy(*key))
    return first.withColumn("early", early).where((F.col("q") == 1) | (F.col("early") < enough)).drop("early")
