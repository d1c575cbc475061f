"""Queries and their SQL over rows that the driver tables do not have."""

import duckdb
import pytest

from quillion import plans

TEXTS = [
    "", " ", "\n", "\r", "\t \n", "-", "- ", "- - x", "–", "• a\n  — b", "plain words here", "  leading words", "\n\n  leading lines", "trailing \t\nlines \n",
    "a \r\nb\t\r\nc \r", "\x0b a \x0b\n", "x  y \u0085z  ", "  word and words  ", "```\n- one\n```", "a\n```", "```md\nb", "`", "–––\n– – x", "\f a\f",
    "日本語", "ééé", "Ünïcode words, words_5 wordswords words5", "Kelvin İstanbul istanbul kelvin", "hello Hello HELLO_hello hello2 hello", "🙂 hello\x00hello 🙂", "x" * 5000 + " hello", None,
]
SAID = ["hello words and plain leading", "Kelvin İstanbul trailing", "", None, "HELLO Ünïcode", "x" * 5000]


def same(spark, duck, name, d):
    mine, theirs = plans.queries()[name](spark, d), duck.sql(plans.oracle_sql()[name])
    got, want = (sorted((tuple(map(str, r)) for r in found)) for found in (mine.select(*theirs.columns).collect(), theirs.fetchall()))
    assert got == want


def made(spark, d, docs):
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i // 2, i % 2, "user", t) for i, t in enumerate(SAID)], "conv_id long, turn int, role string, text string").write.parquet(f"{d}/conversations.parquet")
    duck = duckdb.connect()
    for name in ("documents", "conversations"):
        duck.sql(f"CREATE VIEW {name} AS SELECT * FROM '{d}/{name}.parquet/*.parquet'")
    return duck


@pytest.mark.parametrize("name", ["fn_markdown", "cx12_many_aliases"])
def test_odd_texts(spark, tmp_path, name):
    # Each text under an id of each remainder by 3, and some under no id.
    docs = [(3 * i + k, t, "en", f"s{i % 3}") for i, t in enumerate(TEXTS) for k in range(3)] + [(None, "hello", "en", "s0"), (-1, "words", "en", None)]
    duck = made(spark, tmp_path, docs)
    same(spark, duck, name, str(tmp_path))


def test_rows_of_one_document_are_one_text(spark, tmp_path):
    # Equal rows only: which of two different ones comes first, the SQL leaves open.
    docs = [(7, "hello words, hello", "en", "s0")] * 3 + [(8, "leading", "en", "s1"), (None, "plain leading", "en", "s1"), (None, "plain leading", "en", "s1"), (9, "é", "en", "s1")]
    same(spark, made(spark, tmp_path, docs), "cx12_many_aliases", str(tmp_path))
