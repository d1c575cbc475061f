"""Formula mining: scope, line vetoes, spans, scores, sheets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillion.functions.text import collapse, nfkc
from quillion.operators.context import joined, source_tag

# Patterns and word lists that results depend on.
HINT = r"(?i)(=|≈|≅|≤|≥|≠|±|∝|∑|∏|∫|√|∞|∇|∂|d/dx|\bdy/dx\b|\be\^|\^\s*\w|\|.+\||\b(sin|cos|tan|cot|sec|csc|log|ln|exp)\s*\()"
FORMULA_HEADINGS = "(formula|formulas|identity|identities|theorem|rule|laws)"
POSITIVE = ["key formula", "formulas", "identities", "identity", "law", "laws", "rule", "rules", "theorem", "definition", "properties", "summary"]
NEGATIVE = ["exercise", "exercises", "problems", "examples", "answers", "solution", "review"]
HEADING_VETO = "(?i)(answers to odd|supplementary exercises|references|bibliography)"
BOOK = "(?i)(ISBN|Prentice|Wiley|Springer|Addison|Pearson|McGraw|Elsevier|Englewood|Cliffs|NJ|NY:)"
YEAR = r"\b(19|20)[0-9]{2}\b"
LINE_VETO = r"(?i)^(we write|often we give|this function is defined|if f\(a\) = b|answers to odd|supplementary exercises)\b"
USING = r"(?i)^\s*using\b"
QUESTION = r"(?i)(\?\s*$|^\s*(what|which|find|show|prove|compute|determine)\b)"
# Two patterns are written without branches that cannot change what they match.
ENUMERATED = r"(?i)^\s*(?:\(?[a-z]\)|[ivxlcdm]+\)|\(?[0-9]+\))\s+"
TASK = r"(?i)\b(determine|how many|prove|show|find|compute|evaluate|solve)\b"
LINE_OPERATORS = r"[=≤≥≠≈∑∏∫√∞∇∂\^→↔⇔]"
LINE_ENDS = r"\r\n|[\n\x0b\x0c\r\x1c-\x1e\x{85}\x{2028}\x{2029}]"
SPANS = [
    r"([^.;:\n]{1,120}(?:=|≈|≅|≤|≥|≠|∝)[^.;:\n]{1,120})",
    r"(?i)(\b(?:sin|cos|tan|cot|sec|csc|log|ln|exp)\s*\([^)(\n]{1,80}\))",
    r"(?i)((?:d\s*[a-z]\s*/\s*d\s*[a-z]|∂\s*[a-z]\s*/\s*∂\s*[a-z]))",
    r"(∫[^.;:\n]{1,160})",
    r"((?:∑|∏)[^.;:\n]{1,160})",
    r"(\|[^|\n]{1,160}\|)",
    r"(\b[a-zA-Z]\s*\^\s*[0-9a-zA-Z]+)",
]
SIGNS = ["[=≈≅≤≥≠∝]", r"\(", "/", "∫", "[∑∏]", r"\|", r"\^"]
NOT_FORMULA = r"(?i)\b(proof|example|exercise|problem|show that|find|assume|consider|let then|hence|therefore|solution|answer)\b"
SPAN_OPERATORS = r"[=<>±∑∏∫√∞∇∂\^*/+\-|]"


def formula_scope(chunks: DataFrame, key: str, ratio: float = 0.25) -> DataFrame:
    """Labelled chunks of each key; where they are under ``ratio`` of its chunks also those with
    mathematics, a hint of it, or a formula heading."""
    share = F.avg(F.col("is_formula").cast("double")).over(Window.partitionBy(key))
    more = F.col("has_math") | F.col("text").rlike(HINT) | F.lower("heading_path").rlike(FORMULA_HEADINGS)
    rows = chunks.withColumn("__share", share)
    return rows.where(F.col("is_formula") | ((F.col("__share") < ratio) & more)).drop("__share")


def formula_tiers(df: DataFrame) -> DataFrame:
    """Add ``tier``: equations, then mathematics, outside exercises and then within; others drop."""
    exercise = F.coalesce("section_tag", F.lit("")) == "exercises"
    base = F.when(F.col("is_equation"), 0).when(F.col("has_math"), 1)
    return df.withColumn("tier", base + F.when(exercise, 2).otherwise(0)).where("tier is not null")


def context_score(df: DataFrame) -> DataFrame:
    hp = F.lower(F.coalesce("heading_path", F.lit("")))
    points = [F.when(F.contains(hp, F.lit(w)), n).otherwise(0) for words, n in ((POSITIVE, 3), (NEGATIVE, -4)) for w in words]
    total = sum(points[1:], points[0])
    return df.withColumn("context_score", total - F.when(F.col("section_tag") == "exercises", 2).otherwise(0))


#: What a line has that any of SPANS can be found in.
SIGNED = "[=≈≅≤≥≠∝(/∫∑∏|^]"


def candidate_lines(df: DataFrame, wants_explain: bool = False, wanted: Column | None = None) -> DataFrame:
    """Lines (``line_no`` from 0) that may hold formulas, of texts after compatibility composition;
    a vetoed heading drops the chunk. Where only some lines are ``wanted``, such as those with a
    sign that a span needs (``SIGNED``), the patterns run over these alone."""
    kept = df if wants_explain else df.where(~F.coalesce("heading_path", F.lit("")).rlike(HEADING_VETO) & ~F.coalesce("section_tag", F.lit("")).rlike(HEADING_VETO))
    # Trimmed before they are rows: Spark would else trim a line again for each pattern that it is held against.
    trimmed = F.transform(F.split("text", LINE_ENDS), lambda x: F.trim(x, F.lit(" \t\r•-—–·")))
    rows = kept.withColumn("text", nfkc("text")).select(*[c for c in df.columns if c != "text"], F.posexplode(trimmed).alias("line_no", "line"))
    rows = rows.where("line <> ''")
    rows = rows if wanted is None else rows.where(wanted)
    ln, plain = F.col("line"), ~F.col("line").rlike(LINE_OPERATORS)
    veto = ln.rlike(LINE_VETO) | ln.rlike(USING) | ln.rlike(QUESTION) | (ln.rlike(ENUMERATED) & plain)
    if not wants_explain:
        veto = veto | ln.rlike(BOOK) | ln.rlike(YEAR) | (ln.rlike(TASK) & plain)
    return rows.where(~veto)


def extract_spans(lines: DataFrame, composed: bool = False) -> DataFrame:
    """Spans of seven kinds in the order of kinds, trimmed and cut at 200 characters; of spans
    of a line that differ only in case the first stays. Lines are composed first; those of
    :func:`candidate_lines` are ``composed`` already."""
    lines = lines if composed else lines.withColumn("line", nfkc("line"))
    none = F.array().cast("array<string>")
    # A pattern runs only over lines with a sign it cannot do without; an equation, which no full
    # stop, colon or semicolon interrupts, only over the parts between them that have one.
    parts = F.filter(F.split("line", "[.;:]"), lambda x: x.rlike(SIGNS[0]))
    equations = F.flatten(F.transform(parts, lambda x: F.regexp_extract_all(x, F.lit(SPANS[0]), 1)))
    others = [F.when(F.col("line").rlike(sign), F.regexp_extract_all("line", F.lit(p), 1)).otherwise(none) for sign, p in zip(SIGNS[1:], SPANS[1:])]
    found = F.concat(F.when(F.col("line").rlike(SIGNS[0]), equations).otherwise(none), *others)
    clean = lambda s: F.substring(F.regexp_replace(F.regexp_replace(s, r"\s+", " "), "^[ ,;.]+|[ ,;.]+$", ""), 1, 200)
    rows = lines.withColumn("__spans", F.filter(F.transform(found, lambda s, k: F.struct(k.alias("k"), clean(s).alias("span"))), lambda x: x["span"] != ""))
    rows = rows.withColumn("__low", F.transform("__spans", lambda x: F.lower(x["span"])))
    first = F.filter("__spans", lambda x, n: F.array_position(F.col("__low"), F.lower(x["span"])) == n + 1)
    return rows.select(*[c for c in lines.columns if c != "line"], F.inline(first))


def density(span: Column) -> Column:
    ops, words = F.regexp_count(span, F.lit(SPAN_OPERATORS)), F.regexp_count(span, F.lit("[A-Za-z]{3,}"))
    return ops / F.greatest(F.lit(1), ops + words)


def good_span(spans: DataFrame, prob: Column | None = None, min_prob: float = 0.45) -> DataFrame:
    """Add ``density`` and ``good``. With a probability column spans below ``min_prob`` are not
    good, nor those below 0.08 more under a heading that speaks against formulas."""
    s, bare = F.col("span"), F.regexp_replace("span", r"\s+", "")
    numbers = F.size(F.array_distinct(F.regexp_extract_all(s, F.lit(r"(\b[0-9]+(?:\.[0-9]+)?\b)"), 1)))
    digits = F.length(F.regexp_replace(bare, "[^0-9]", "")) / F.greatest(F.lit(1), F.length(bare))
    dens = F.col("density")
    bad = (
        s.rlike(r"(?i)\bfor\s+i\s*=\s*[0-9]")
        | ((numbers >= 3) & ~s.rlike("[A-Za-zα-ωΑ-Ω]{2,}"))
        | s.rlike(r"^[01\s]{24,}$")
        | (digits > 0.7)
        | ((F.col("context_score") <= -1) & (dens < 0.45))
        | (s.rlike(NOT_FORMULA) & (dens < 0.35))
        | ((F.length(s) > 160) & (dens < 0.30))
        | ~s.rlike("[=≤≥≠∑∏∫√∞∇∂^∀∃¬∧∨→⇒⇔↔]")
        | ~s.rlike("[A-Za-zα-ωΑ-Ω]")
    )
    if prob is not None:
        needed = min_prob + F.when(F.col("context_score") <= -1, 0.08).otherwise(0.0)
        bad = bad | F.coalesce(prob < needed, F.lit(False))
    return spans.withColumn("density", density(s)).withColumn("good", ~bad)


def without_hint(text: Column | str = "text") -> Column:
    """Whether a page's text lacks any hint of a formula."""
    return ~F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")).rlike(HINT)


def rank_spans(spans: DataFrame, max_per_page: int = 200, prob: Column | None = None, min_prob: float = 0.45, strong: float = 0.55, soft: Column | None = None) -> DataFrame:
    """Spans worth keeping with ``span_score``, the first ``max_per_page`` of a chunk in reading
    order. With a probability column only likely ones stay, but half of them and three at least;
    where ``soft`` holds (pages without a hint, when not all pages are scanned alike) likely is
    0.08 more."""
    needed = F.lit(min_prob) + (F.lit(0.0) if soft is None else F.when(soft, 0.08).otherwise(0.0))
    p = prob if prob is not None else F.lit(None).cast("double")
    dense = F.col("density") >= strong
    count = lambda c: F.length("span") - F.length(F.replace(F.col("span"), F.lit(c), F.lit("")))
    symbols = count("=") * 0.35 + (count("∑") + count("∫")) * 0.45 + (count("→") + count("↔")) * 0.25
    score = F.coalesce(3 * p, 1.5 + F.when(dense, 0.2).otherwise(0.0)) + 0.8 * F.col("context_score") + F.least(F.lit(1.4), symbols)
    score = score - F.when(F.length("span") > 140, 0.15).otherwise(0.0)
    rows = spans.withColumns({"p": p, "span_score": F.round(score, 6)}).where(F.col("good") | dense | F.coalesce(p >= needed, F.lit(False)))
    reading = Window.partitionBy("rid").orderBy("line_no", "k")
    rows = rows.withColumn("n", F.row_number().over(reading)).where(F.col("n") <= max_per_page)
    best = Window.partitionBy("rid").orderBy(F.desc("span_score"), "n")
    rows = rows.withColumn("span_rank", F.row_number().over(best))
    page = Window.partitionBy("rid")
    likely = F.count_if(F.col("p").isNull() | (F.col("p") >= needed)).over(page)
    least = F.greatest(F.lit(3), F.floor(F.count("*").over(page) / 2))
    rows = rows.withColumns({"likely": likely, "least": least})
    kept = F.when(F.col("likely") < F.col("least"), F.col("span_rank") <= F.col("least")).otherwise(F.col("p").isNull() | (F.col("p") >= needed))
    return rows.where(kept).drop("n", "likely", "least")


def mining_stats(chunks: DataFrame, spans: DataFrame, ranked: DataFrame) -> DataFrame:
    a = chunks.agg(F.count("*").alias("pages"))
    b = spans.agg(F.count("*").alias("spans"), F.countDistinct("rid").alias("scanned"))
    c = ranked.agg(F.count("*").alias("kept"), F.count("p").alias("scored"), F.avg("p").alias("avg_p"))
    return a.crossJoin(b).crossJoin(c)  # one row each


def formula_sheet(formulas: DataFrame, key: str, budget: int = 14000) -> DataFrame:
    """Lines "source formula" of each key by source, page and rank, while they fit the budget."""
    w = Window.partitionBy(key).orderBy("source", "page", "rid", "span_rank")
    rows = formulas.withColumn("line", collapse(F.concat_ws(" ", "source", "span"))).withColumn("place", F.row_number().over(w))
    # A line takes one character at least, so later ones cannot fit; tasks send no more than these.
    rows = rows.where(F.col("place") <= budget).withColumn("used", F.sum(F.length(F.col("line")) + 1).over(w))
    return rows.where(F.col("used") <= budget).groupBy(key).agg(joined("line", "place", "\n").alias("sheet"), F.count("*").alias("n"))


def with_source(df: DataFrame) -> DataFrame:
    return df.withColumn("source", source_tag()).withColumn("page", F.col("page_start"))


def formula_lines(df: DataFrame, col: str = "text") -> DataFrame:
    """Texts reduced to lines like equations or ending in a colon, without task lines; a text
    of which nothing would be left stays whole."""
    line = lambda x: F.trim(x)
    keep = lambda x: (line(x) != "") & ~line(x).rlike(r"(?i)\b(exercise|prove|show\s+that|find\s+the\s+value|question)\b") & line(x).rlike("(=|[≡≈]|:$)")
    kept = F.array_join(F.filter(F.split(F.coalesce(col, F.lit("")), "\n"), keep), "\n")
    return df.withColumn("formula_lines", F.when(kept == "", F.coalesce(col, F.lit(""))).otherwise(kept))


ITEM = r"^\s*(?![#>\-])(.+?)\s+—\s+\$\$([\s\S]*?)\$\$(?:\s*(\[[^\]]+\]))?(?:\s+—\s+(.+))?\s*$"


def parse_formula_items(sheets: DataFrame, key: str, col: str = "sheet") -> DataFrame:
    """Label, formula, citation and note of lines "label — $$ f $$ [cite] — note", numbered."""
    rows = sheets.select(key, F.posexplode(F.split(col, "\n")).alias("pos", "line")).where(F.col("line").rlike(ITEM))
    part = lambda n: F.trim(F.regexp_extract("line", ITEM, n))
    w = Window.partitionBy(key).orderBy("pos")
    return rows.select(key, F.row_number().over(w).alias("number"), part(1).alias("label"), part(2).alias("formula"), part(3).alias("citation"), part(4).alias("note"))
