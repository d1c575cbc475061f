"""Rule and model labels of chunks."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.feature import StringIndexerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillion.functions.text import collapse

# Patterns that the labels depend on.
B, E = r"(?:^|[^\p{L}\p{N}_])", r"(?:$|[^\p{L}\p{N}_])"  # word boundaries, beyond ASCII too
ISBN13 = r"\b97[89][\- ]?[0-9]{1,5}[\- ]?[0-9]+[\- ]?[0-9]+[\- ]?[0-9]\b"
ISBN10 = r"\b(?:[0-9][\- ]?){9}[0-9X]\b"
MATH_TOKENS = (
    r"(?i)(=|\+|−|\-|×|÷|/|\^|\\|∑|∫|√|≤|≥|<|>|≈|≠|→|⇒|⇔|∧|∨|¬|⊕|⊢|⊨|⊥|⊤|∀|∃|∴|∵|∈|∉|∩|∪|∂|Δ|∇|"
    rf"{B}(sin|cos|tan|log|ln|exp|lim){E}|dx|dt|{B}(for all|there exists){E})"
)
THEOREM_HEADING = rf"{B}(theorem|lemma|corollary|proposition|axiom){E}"
RULE_WORDS = rf"{B}(rule|law|identity|formula){E}"
EXAMPLE_HEADING = rf"{B}(example|worked example){E}"
DEFINITION_TEXT = r"(?i)^(definition\b|let\s+.*\s+be\s+the\s+definition|is\s+defined\s+as)"
EXERCISE_WORDS = rf"(?i)(exercise|problem|practice|show\s+that|compute|determine|find){E}"


def formula_veto(text: Column | str) -> Column:
    """Whether a text cannot be a formula: blank, a book number, or without a sign of mathematics."""
    t = collapse(text)
    return (t == "") | F.contains(F.lower(t), F.lit("isbn")) | t.rlike(ISBN13) | t.rlike(ISBN10) | ~t.rlike(MATH_TOKENS)


def label_formulas(df: DataFrame, scorer=None, tag: str = "disabled", stamp: Column | None = None) -> DataFrame:
    """Add formula label, flag, confidence, model tag and time. ``scorer`` gives a probability
    column for a text column; without one no text is a formula, at confidence one half. The
    veto overrides the label and leaves the confidence."""
    t = F.substring(collapse("text"), 1, 4000)
    p = scorer(t) if scorer else F.lit(None).cast("double")
    found = F.coalesce(p >= 0.5, F.lit(False))
    confidence = F.coalesce(F.when(found, p).otherwise(1 - p), F.lit(0.5))
    is_formula = found & ~formula_veto(t)
    return df.withColumns(
        {
            "is_formula": is_formula,
            "formula_label": F.when(is_formula, "FORMULA").otherwise("NOT_FORMULA"),
            "formula_confidence": confidence,
            "formula_model": F.lit(tag),
            "formula_timestamp": F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'") if stamp is None else stamp,
        }
    )


def refresh_labels(df: DataFrame, tag: str, always: bool = False, scorer=None) -> DataFrame:
    """Label again the rows that have no label or one of another model; keep the rest."""
    stale = F.lit(always) | F.col("is_formula").isNull() | (F.coalesce("formula_model", F.lit("")) != tag)
    again = label_formulas(df.where(stale), scorer, tag)
    return df.where(~stale).unionByName(again, allowMissingColumns=True)


def label_semantics(df: DataFrame, model: PipelineModel | None, labels: list[str] | None = None) -> DataFrame:
    """Add the most likely label and its probability, from the first 1200 characters as the
    model takes them; without a model the columns are absent."""
    if model is None:
        return df
    names = labels or model.stages[0].labels
    steps = PipelineModel([s for s in model.stages if not isinstance(s, StringIndexerModel)])  # rows to label bear no label
    scored = steps.transform(df.withColumn("chunk_text", F.substring(collapse("text"), 1, 1200)))
    p = vector_to_array("probability")
    named = F.array(*map(F.lit, names))
    return scored.select(
        *df.columns,
        F.element_at(named, F.col("prediction").cast("int") + 1).alias("semantic_label"),
        F.array_max(p).alias("semantic_confidence"),
    )


def weak_label(df: DataFrame, min_chars: int = 60, limit: int = 0) -> DataFrame:
    """Labels by the first rule that matches heading, section or text; rows that are short or
    match none are dropped. ``limit`` keeps the first rows by rid."""
    t, h = F.trim(F.coalesce("text", F.lit(""))), F.lower(F.coalesce("heading_path", F.lit("")))
    label = (
        F.when(h.rlike(THEOREM_HEADING), "theorem")
        .when(h.rlike(RULE_WORDS), "rule")
        .when(h.startswith("definition") | t.rlike(DEFINITION_TEXT), "definition")
        .when(h.rlike(EXAMPLE_HEADING) | F.lower(t).startswith("example"), "example")
        .when((F.lower("section_tag") == "exercises") | h.rlike(EXERCISE_WORDS) | t.rlike(EXERCISE_WORDS), "exercise")
        .when(F.col("is_equation") & F.col("has_math") & F.lower(t).rlike(RULE_WORDS), "rule")
        .when(F.col("is_formula") & (F.coalesce("formula_confidence", F.lit(0.0)) >= 0.8), "rule")
    )
    found = df.where(F.length(t) >= min_chars).select(
        "rid", F.col("text").alias("chunk_text"), "doc_name", F.col("page_start").alias("page"), label.alias("label")
    ).where("label is not null")
    return found.orderBy("rid").limit(limit) if limit else found


def label_sample(df: DataFrame, n: int = 500, seed: int = 11, keep_math: bool = False) -> DataFrame:
    """``n`` rows in the order of a hash of seed and rid, with a blank label."""
    rows = df.where("has_math") if keep_math else df
    order = F.md5(F.concat(F.lit(f"{seed}-"), F.col("rid").cast("string")))
    return rows.orderBy(order, "rid").limit(n).withColumn("label", F.lit(""))
