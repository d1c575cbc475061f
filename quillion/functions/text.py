"""Column expressions over text that several operators share."""

from __future__ import annotations

import functools
import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Character classes, word lists and patterns that results depend on.
CJK = "[\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uac00-\ud7a3\u1100-\u11ff\u3130-\u318f]"
PRIVATE_USE = "[\ue000-\uf8ff]"
HEADING = r"^([A-Z][A-Z0-9 \-:&]{3,}|([0-9]+(\.[0-9]+){0,3})\s+[A-Z].+)$"
BULLET = r"^\s*([\-–—•·▪‣]\s+|[0-9]+\.\s+|\([0-9]+\)\s+|\([a-zA-Z]\)\s+)"
MATH = "[=±×÷≤≥∑∏∫√∞≈≠⊂⊆⊃⊇∈∉∧∨⇒⇔αβγδΔεζηθικλμνξπρστυφχψωΩ]"
OPERATORS = "[=±×÷≤≥∑∏∫√∞∇∂^]"
TABLE_HINT = r"(?i)\b(Table|tabular|columns?|rows?)\b"
EXERCISE_HEADING = r"(?i)\b(exercises?|problems?|answers?|solution|review)\b"
STOP_WORDS = [
    "what", "which", "this", "that", "about", "were", "does", "with", "from", "your", "their", "into",
    "there", "when", "where", "many", "show", "give", "tell", "list",
]
SHORT_MATH = ["sin", "cos", "tan", "sec", "csc", "cot", "pi", "π", "ln", "log", "rad", "deg", "e", "ix", "dx", "dt"]
MATH_PHRASES = [
    "pythagorean", "double-angle", "half-angle", "sum and difference", "product-to-sum", "sum-to-product",
    "angle addition", "angle subtraction", "unit circle", "euler", "complex exponential", "radian", "degree",
    "identity", "identities", "formula", "formulas",
]
TRIGONOMETRY = ["sin", "cos", "tan", "identity", "identities", "pythagorean", "double-angle", "half-angle"]


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def collapse(c: Column | str) -> Column:
    """White space runs as one blank, none at the ends; null as empty."""
    return F.trim(F.regexp_replace(F.coalesce(col(c), F.lit("")), r"\s+", " "))


def normalize_text(c: Column | str) -> Column:
    """No-break blanks, soft hyphens and ligatures replaced; blanks and line ends tidied."""
    c = col(c)
    for pattern, to in ((" ", " "), ("­", ""), ("ﬁ", "fi"), ("ﬂ", "fl"), ("[ \t]+", " "), (r"\s+\n", "\n"), (r"\n\s+", "\n")):
        c = F.regexp_replace(c, pattern, to)
    return F.trim(F.regexp_replace(c, r"^\s+|\s+$", ""))


def ascii_tokens(c: Column | str) -> Column:
    """Lower-case runs of a-z and 0-9, in order."""
    return F.filter(F.split(F.regexp_replace(F.lower(F.coalesce(col(c), F.lit(""))), "[^a-z0-9]+", " "), " "), lambda x: x != "")


def word_tokens(c: Column | str, longer_than: int = 0) -> Column:
    """Lower-case runs of letters, digits and underscores, in order."""
    found = F.regexp_extract_all(F.lower(F.coalesce(col(c), F.lit(""))), F.lit("([a-z0-9_]+)"), 1)
    return F.filter(found, lambda x: F.length(x) > longer_than) if longer_than else found


SENTENCE_ENDS = {"a": r"([.!?;:])\s+([A-Z0-9(])", "b": r"([.!?;:])\s+([A-Za-z0-9\\(])", "c": r"([.!?])\s+(.)"}


def sentences(c: Column | str, variant: str = "a") -> Column:
    """Array of sentences. Variant a ends one before A-Z, 0-9 or (; b also before a-z and a
    backslash; c after . ! ? before anything."""
    marked = F.regexp_replace(collapse(c), SENTENCE_ENDS[variant], "$1\u0001$2")
    return F.filter(F.transform(F.split(marked, "\u0001"), lambda x: F.trim(x)), lambda x: x != "")


def token_estimate(c: Column | str) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(col(c)) / 4).cast("int"))


def keywords(c: Column | str) -> Column:
    """Sorted distinct keywords of a question: words of four letters and more that are no stop
    words, short mathematical words, known phrases, and what trigonometry brings along."""
    q = F.regexp_replace(F.lower(col(c)), "[^a-z0-9\\sπ]", " ")
    words = F.filter(F.split(q, r"\s+"), lambda w: (w != "") & ~w.isin(STOP_WORDS) & ((F.length(w) >= 4) | w.isin(SHORT_MATH)))
    phrases = F.filter(F.array(*[F.when(F.contains(q, F.lit(p.replace("-", " "))) | F.contains(q, F.lit(p)), F.lit(p)) for p in MATH_PHRASES]), lambda p: p.isNotNull())
    trig = F.when(F.contains(q, F.lit("trig")), F.array(*map(F.lit, TRIGONOMETRY))).otherwise(F.array().cast("array<string>"))
    return F.array_sort(F.array_distinct(F.concat(words, phrases, trig)))


def truthy(c: Column | str) -> Column:
    return F.coalesce(F.lower(F.trim(col(c).cast("string"))).isin("1", "true", "yes", "on"), F.lit(False))


def trim_sentence(c: Column | str, limit: int = 140) -> Column:
    s = F.trim(F.coalesce(col(c), F.lit("")))
    return F.when(F.length(s) <= limit, s).otherwise(F.concat(F.rtrim(F.substring(s, 1, limit - 1)), F.lit("…")))


def safe_token(c: Column | str) -> Column:
    return F.regexp_replace(F.coalesce(col(c), F.lit("")), "[^a-zA-Z0-9._-]+", "_")


# Characters that compatibility composition leaves alone: Western letters, dashes, quotes, operators.
WESTERN = r"\A[\x00-\x7f\xc0-\xff\u2012-\u2016\u2018-\u2023\u2200-\u222b\u2231-\u22ff]*+\z"
STRETCH = 64  # texts that are composed at a time


@functools.lru_cache(1)
def _plain_class() -> str:
    """A pattern for a character outside the long runs of code points that NFKC leaves alone,
    alone or next to others. The class holds few runs, so that it is fast on prose."""
    moves = lambda c: not unicodedata.is_normalized("NFKC", chr(c)) or unicodedata.combining(chr(c)) or 0x1160 <= c < 0x1200
    runs, start = [], 0
    for low, high, least in ((0, 0x600, 24), (0x2000, 0x2300, 4), (0x3040, 0x3100, 24), (0x4E00, 0xA000, 24), (0xAC00, 0xD7A4, 24)):
        start = low
        for c in range(low, high + 1):
            if c == high or moves(c):
                if c - start >= least:
                    runs.append(f"\\x{{{start:x}}}-\\x{{{c - 1:x}}}")
                start = c + 1
    return f"[^{''.join(runs)}]"


def nfkc(c: Column | str) -> Column:
    """Unicode compatibility composition, which Spark has not. Only texts with a character that
    may change are handed to Python; ASCII is not even searched for one. A batch is composed in
    short stretches, so that few of its texts are Python's at a time."""

    @F.arrow_udf("string")
    def normal(s: pa.Array) -> pa.Array:
        parts = (s.slice(at, STRETCH).to_pylist() for at in range(0, len(s), STRETCH))
        done = [pa.array([x if x is None else unicodedata.normalize("NFKC", x) for x in part], pa.string()) for part in parts]
        return pa.concat_arrays(done) if done else pa.array([], pa.string())

    c = col(c)
    # The class is slow over long texts; most that are not ASCII have none but these.
    may_change = (F.octet_length(c) > F.length(c)) & ~c.rlike(WESTERN) & c.rlike(_plain_class())
    return F.coalesce(normal(F.when(may_change, c)), c)


def normalize_markdown(c: Column | str) -> Column:
    """An answer without the fence around it, bullets as hyphens, no blanks at line ends, and no
    bullet before its first line."""
    s = F.regexp_replace(F.regexp_replace(col(c), "\u00a0", " "), r"^\s+|\s+$", "")
    s = F.regexp_replace(s, r"^```[\w\-]*\s*\n?([\s\S]*?)\n?\s*```$", "$1")
    s = F.regexp_replace(F.regexp_replace(s, r"^\s+|\s+$", ""), r"(?m)^\s*[\u2013\u2014\u2022]\s+", "- ")
    s = F.regexp_replace(F.regexp_replace(s, r"(?m)[ \t]+$", ""), r"^\s*- \s*", "")
    return F.regexp_replace(s, r"^\s+|\s+$", "")


def sigmoid(c: Column | str) -> Column:
    return 1 / (1 + F.exp(-col(c)))


def softmax(c: Column | str) -> Column:
    """An array of scores as shares that add up to 1."""
    top = F.array_max(col(c))
    total = F.aggregate(col(c), F.lit(0.0), lambda s, x: s + F.exp(x - top))
    return F.transform(col(c), lambda x: F.exp(x - top) / total)


def epoch_seconds(c: Column | str) -> Column:
    return F.unix_seconds(col(c).cast("timestamp"))


def set_overlap(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays as sets."""
    inter = F.size(F.array_intersect(a, b))
    return inter / F.greatest(F.lit(1), F.size(F.array_distinct(a)) + F.size(F.array_distinct(b)) - inter)
