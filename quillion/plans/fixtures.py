"""Views that queries and their SQL start from: one text for both engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

VIEWS = {
    "v_pages": """SELECT source AS doc_name, CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) AS INT) AS page,
  doc_id, lang, text FROM documents""",
    "v_chunks": """SELECT p.doc_id AS rid, p.doc_name, p.page AS page_start,
  p.text || CASE WHEN p.doc_id % 3 = 0 THEN '. f(x) = x^2 + 1' ELSE '' END AS text,
  CASE p.doc_id % 8 WHEN 0 THEN 'Chapter 1 Definition of terms' WHEN 1 THEN 'Theorem 2'
    WHEN 2 THEN 'Section 3.1 Rule of sums' WHEN 3 THEN 'Chapter 4 Example' WHEN 4 THEN 'Chapter 5 Exercises'
    WHEN 5 THEN 'Key formulas' WHEN 6 THEN '' ELSE '7 Summary' END AS heading_path,
  CASE WHEN p.doc_id % 8 = 4 THEN 'exercises' ELSE '' END AS section_tag,
  p.doc_id % 3 = 0 AS has_math, p.doc_id % 9 = 0 AS is_equation, p.doc_id % 3 = 0 AS is_formula,
  CAST(p.doc_id % 100 AS DOUBLE)/100 AS formula_confidence,
  CASE p.doc_id % 6 WHEN 0 THEN 'definition' WHEN 1 THEN 'theorem' WHEN 2 THEN 'rule'
    WHEN 3 THEN 'example' WHEN 4 THEN 'exercise' END AS semantic_label
FROM v_pages p""",
    "v_questions": """SELECT item_id AS question_id, CASE item_id % 4 WHEN 0 THEN 'determine the formula: ' || text
  WHEN 1 THEN text || ' in chapter 4' WHEN 2 THEN text || ' see section 3.1 of SRC5' ELSE text END AS question FROM benchmark""",
    "v_headed": """SELECT doc_name, page, doc_id, 'SECTION ' || upper(doc_name) || chr(10) || text || chr(10) || '- item of ' || doc_name || chr(10) || 'Running foot' AS text FROM v_pages""",
    "v_turns": """SELECT conv_id, turn, q, a FROM (SELECT conv_id, turn, role, text AS q,
  lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS a, lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS nr
  FROM conversations) t WHERE role = 'user' AND nr = 'assistant'""",
    "v_extractions": """SELECT doc_name, page, doc_id, 'a' AS extractor, 0 AS ord,
  text || CASE WHEN doc_id % 3 = 0 THEN '中' ELSE '' END AS text FROM v_pages
UNION ALL SELECT doc_name, page, doc_id, 'b', 1, lower(text) FROM v_pages
UNION ALL SELECT doc_name, page, doc_id, 'c', 2, text || CASE WHEN doc_id % 4 = 0 THEN '中' ELSE ' 0' END FROM v_pages""",
    "v_answers": """SELECT conv_id AS question_id, turn, text AS draft FROM conversations WHERE role = 'assistant'""",
    "v_evidence": """SELECT conv_id AS question_id, turn AS pos, '[conversation ' || CAST(conv_id AS VARCHAR(20)) || ' p.' || CAST(turn AS VARCHAR(20)) || ']' AS source, text
  FROM conversations WHERE role <> 'assistant'""",
    "v_requests": "SELECT event_id, ts, user_id, CAST(floor(value * 10) AS BIGINT) AS tokens FROM events",
}

#: Compatibility composition in SQL, of the characters that the fixtures add; the tables' own
#: texts have none that it changes.
NFKC = "nfc_normalize(translate(replace(replace(replace(replace(replace({}, '½', '1⁄2'), 'ﬁ', 'fi'), '∬', '∫∫'), '…', '...'), '㍿', '株式会社'), 'ｆｘ（）＝３²\u00a0\uffa1', 'fx()=32 \u1100'))".format

POOL, WIDE = 128, 256  # hits of a question that are ranked, and that are reranked

#: Views that only the SQL side takes from here; the Spark side makes them with operators.
DUCK = {
    "v_lines": """SELECT doc_name, page, doc_id, CAST(unnest(generate_series(0, len(l)-1)) AS INT) AS pos, unnest(l) AS line
  FROM (SELECT *, string_split(text, chr(10)) AS l FROM v_headed)""",
    "v_qv": "SELECT q.question_id, q.question, e.embedding FROM v_questions q JOIN embeddings e ON e.vec_id = q.question_id",
    "v_top": f"""SELECT question_id, rid, score, pos FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, rid) AS pos FROM
  (SELECT q.question_id, e.vec_id AS rid, round(list_dot_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) AS score FROM v_qv q, embeddings e)) WHERE pos <= {POOL}""",
    "v_wide": f"""SELECT t.question_id, q.question, t.score, t.pos, c.* FROM (SELECT question_id, rid, score, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, rid) AS pos FROM
  (SELECT q.question_id, e.vec_id AS rid, round(list_dot_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[]), 6) AS score FROM v_qv q, embeddings e)) t JOIN v_chunks c USING (rid) JOIN v_questions q USING (question_id) WHERE t.pos <= {WIDE}""",
    "v_hits": "SELECT t.question_id, q.question, t.score, t.pos, c.* FROM v_top t JOIN v_chunks c USING (rid) JOIN v_questions q USING (question_id)",
}
VIEWS |= DUCK

NEEDS = {
    "v_chunks": ["v_pages"], "v_extractions": ["v_pages"], "v_headed": ["v_pages"], "v_lines": ["v_headed"],
    "v_qv": ["v_questions"], "v_top": ["v_qv"], "v_hits": ["v_top", "v_chunks"], "v_wide": ["v_qv", "v_chunks"],
}


def _names(name: str) -> list[str]:
    return [*(x for n in NEEDS.get(name, []) for x in _names(n)), name]


def with_views(*names: str) -> str:
    """``WITH`` clause that defines views for DuckDB, whose tables are views already."""
    wanted = dict.fromkeys(x for n in names for x in _names(n))
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({VIEWS[n]})" for n in wanted)


#: Views that Spark numbers another way than their text says, with the same rows. A source can hold a
#: third of all texts, so pages are numbered over ids and counts alone; texts are read by all tasks, and
#: meet their numbers by id only where a query asks for them.
SPARK = {
    "v_pages": """SELECT d.source AS doc_name, CAST(b.before + d.nth AS INT) AS page, d.doc_id, d.lang, d.text
  FROM (SELECT *, row_number() OVER (PARTITION BY place ORDER BY doc_id) AS nth FROM (SELECT {hint} *, struct(source, doc_id) AS place FROM documents)) d
  LEFT JOIN (SELECT place, coalesce(sum(n) OVER (PARTITION BY place.source ORDER BY place.doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
    FROM (SELECT struct(source, doc_id) AS place, count(*) AS n FROM documents GROUP BY 1)) b ON d.place = b.place""",
}

TABLES = ("documents", "embeddings", "benchmark", "conversations", "pages", "labels", "events")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A driver table or a view over them as a DataFrame."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    chain = _names(name)
    used = [t for t in TABLES if any(t in VIEWS[n] for n in chain)]
    parts = [f"{t} AS (SELECT * FROM parquet.`{sf_dir}/{t}.parquet`)" for t in used]
    # A table of few files is read by few tasks, so its rows are dealt out first.
    few = "documents" in used and len(spark.read.parquet(f"{sf_dir}/documents.parquet").inputFiles()) < spark.sparkContext.defaultParallelism
    text = {n: SPARK[n].format(hint="/*+ REPARTITION(place) */" if few else "") if n in SPARK else VIEWS[n] for n in chain}
    return spark.sql("WITH " + ",\n".join([*parts, *(f"{n} AS ({text[n]})" for n in chain)]) + f" SELECT * FROM {name}")
