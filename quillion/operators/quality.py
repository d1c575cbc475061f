"""Page quality, choice among extractions, parse reports, language gate."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillion.functions.text import CJK, PRIVATE_USE, nfkc


def page_quality(df: DataFrame) -> DataFrame:
    """Add ascii_ratio (0 for an empty text), has_cjk, has_private, n_letters and n_digits."""
    t = F.coalesce("text", F.lit(""))
    ascii_ = F.length(F.regexp_replace(t, "[^\\x00-\\x7F]", ""))
    return df.withColumns(
        {
            "ascii_ratio": F.when(F.length(t) == 0, 0.0).otherwise(ascii_ / F.length(t)),
            "has_cjk": t.rlike(CJK),
            "has_private": t.rlike(PRIVATE_USE),
            "n_letters": F.length(F.regexp_replace(t, "[^\\p{L}]", "")),
            "n_digits": F.length(F.regexp_replace(t, "[^\\p{Nd}]", "")),
        }
    )


def suspicious(df: DataFrame) -> DataFrame:
    """Add ``suspect``: under 10 characters, CJK, private-use glyphs, or mostly beyond ASCII."""
    q = page_quality(df)
    bad = (F.length(F.coalesce("text", F.lit(""))) < 10) | F.col("has_cjk") | F.col("has_private") | (F.col("ascii_ratio") < 0.55)
    return q.withColumn("suspect", bad)


def pick_extraction(df: DataFrame) -> DataFrame:
    """Of several extractions of a page (``ord`` breaks ties) the one with the best score."""
    t = F.coalesce("text", F.lit(""))
    score = 5 * F.col("ascii_ratio") + 0.001 * F.length(t) + 0.0005 * F.col("n_letters") + 0.0003 * F.col("n_digits")
    score = F.when(t == "", -1e9).when(F.col("has_cjk"), -1e6).otherwise(F.round(score, 6))
    rows = page_quality(df).withColumn("score", score)
    # The best row of a page is a running maximum, taken before anything is shuffled.
    best = rows.groupBy("doc_name", "page").agg(F.max_by(F.struct(*[c for c in rows.columns if c not in ("doc_name", "page")]), F.struct("score", -F.col("ord"))).alias("b"))
    return best.select("doc_name", "page", "b.*").select(*rows.columns)


def repair_glyphs(spans: DataFrame, font_map: DataFrame) -> DataFrame:
    """Replace private-use characters by their font's map (font, code, repl), after compatibility
    composition; others stay. A map is one value beside the span, at most as many entries as
    there are private-use code points, and characters are replaced where they stand; only
    spans with such characters are taken apart."""
    each = font_map.select(F.lower("font").alias("__font"), "code", "repl").where("code is not null and repl is not null")
    each = each.groupBy("__font", "code").agg(F.max("repl").alias("repl"))
    maps = each.groupBy("__font").agg(F.map_from_entries(F.collect_list(F.struct("code", "repl"))).alias("__map"))
    rows = spans.withColumn("text", nfkc("text")).join(maps, F.lower("font") == F.col("__font"), "left")
    fixed = F.array_join(F.transform(F.split("text", ""), lambda c: F.coalesce(F.col("__map")[F.ascii(c)], c)), "")
    return rows.withColumn("text", F.when(F.col("__map").isNotNull() & F.col("text").rlike(PRIVATE_USE), fixed).otherwise(F.col("text"))).drop("__font", "__map")


def parse_report(pages: DataFrame, chunks: DataFrame) -> DataFrame:
    """Pages, suspect pages and chunks of each document."""
    n_chunks = chunks.groupBy("doc_name").agg(F.count("*").alias("n_chunks"))
    report = suspicious(pages).groupBy("doc_name").agg(
        F.count("*").alias("n_pages"),
        F.count_if("suspect").alias("n_suspect"),
        F.array_join(F.sort_array(F.collect_list(F.when(F.col("suspect"), F.col("page")))).cast("array<string>"), ",").alias("suspect_pages"),
        F.count_if(F.length(F.coalesce("text", F.lit(""))) < 10).alias("n_short"),
    )
    return report.join(n_chunks, "doc_name", "left").withColumn("n_chunks", F.coalesce("n_chunks", F.lit(0)))


def language_gate(df: DataFrame, key: str) -> DataFrame:
    """Drop blank and CJK texts, as they are after compatibility composition; a key that would
    lose all its rows keeps them. The texts themselves stay as they are."""
    t = nfkc(F.coalesce("text", F.lit("")))
    good = t.rlike(r"[^\s\u001c-\u001f\u0085\u2028\u2029]") & ~t.rlike(CJK)
    some = F.max(good).over(Window.partitionBy(key))
    return df.withColumn("__good", good).withColumn("__some", some).where(F.col("__good") | ~F.col("__some")).drop("__good", "__some")
