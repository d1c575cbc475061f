"""Operator 11: lines that many documents share.

Texts are cut into lines, lines are normalised and hashed, the distinct documents of each hash
are counted, lines over the threshold are dropped, and texts are put together again by the
positions of the lines that stay. All of it is DataFrame functions: what is shuffled for the
counts is 128-bit hashes and ids, and the lines themselves only where a text is put together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

BLANK = " \t\n\x0b\f\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """The line without ASCII white space at its ends, A-Z in lower case and nothing else."""
    line = F.btrim(line, F.lit(BLANK))
    # ``lower`` changes other letters too, but a line of ASCII has none.
    return F.when(F.octet_length(line) == F.length(line), F.lower(line)).otherwise(F.translate(line, UPPER, LOWER))


def hash_pair(value: Column, names: tuple[str, str]) -> list[Column]:
    """128 bits in two columns: the second hash starts from another seed."""
    return [F.xxhash64(value).alias(names[0]), F.xxhash64(F.lit(1), value).alias(names[1])]


def line_dedup(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, id_col="doc_id", text_col="text") -> DataFrame:
    """``docs`` with what stays of each text, and ``n_lines`` (before) and ``n_dropped``.

    A line goes if its key (:func:`line_key`) has ``min_chars`` code points or more and occurs in
    ``min_docs`` or more documents, except in that of the largest id. Rows that share an id are
    one document in this, each put together for itself; rows without an id are one document
    before all others. A null text is an empty one, which is one empty line, and stays empty.
    Other columns are kept; ``n_lines`` and ``n_dropped`` of the input are replaced. Lines are
    equal if 128 bits of hash are. An empty table gives an empty one.

    Counting pre-aggregates by hash and id, then by hash, so that a line of all documents is a
    few rows a task. Where lines meet the counts, the counts are the unique side, and Spark
    splits the lines of a hash that is too frequent for one task."""
    doc, text = F.col(f"`{id_col}`"), F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    row, key = ("__a", "__b"), ("__h", "__k")
    lines = docs.select(doc.alias("__id"), *hash_pair(text, row), F.posexplode(F.split(text, "\n", -1)).alias("__pos", "__line"))
    lines = lines.withColumn("__line", line_key(F.col("__line"))).where(F.length("__line") >= min_chars)
    lines = lines.select("__id", *row, "__pos", *hash_pair(F.col("__line"), key))
    found = lines.select("__id", *key).distinct().groupBy(*key).agg(F.count("*").alias("__n"), F.max("__id").alias("__last"))
    found = materialize(found.where(F.col("__n") >= min_docs), "lines")
    gone = lines.join(found, list(key)).where(~F.col("__id").eqNullSafe(F.col("__last")))
    gone = gone.groupBy(F.col("__id").alias("__gone_id"), *(F.col(c).alias(f"{c}_gone") for c in row)).agg(F.collect_set("__pos").alias("__gone"))

    rest = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    row_of = F.struct(*(F.col(f"`{c}`") for c in rest if c != text_col), F.lit(0).alias("__any"))  # where no name can clash
    whole = docs.select(row_of.alias("row"), doc.alias("__id"), *hash_pair(text, row), F.split(text, "\n", -1).alias("__lines"))
    same = F.col("__id").eqNullSafe(F.col("__gone_id")) & (F.col("__a") == F.col("__a_gone")) & (F.col("__b") == F.col("__b_gone"))
    both = whole.join(gone, same, "left").withColumn("__gone", F.coalesce("__gone", F.array().cast("array<int>")))
    stay = F.array_except(F.sequence(F.lit(0), F.size("__lines") - 1), "__gone")
    kept = F.array_join(F.transform(stay, lambda i: F.col("__lines")[i]), "\n").alias(text_col)
    columns = [kept if c == text_col else F.col(f"row.`{c}`") for c in rest]
    return both.select(*columns, F.size("__lines").cast("long").alias("n_lines"), F.size("__gone").cast("long").alias("n_dropped"))
