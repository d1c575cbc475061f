"""Queries over vectors, search and ranking."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillion.operators import retrieval as R
from quillion.operators import vectors as V
from quillion.plans.base import chunk_vectors, hits, query, question_vectors, rx, top
from quillion.plans.fixtures import WIDE, view
from quillion.sources import store as S


@query("ve1_embed", "v_chunks", "SELECT rid, 256 AS dim, CASE WHEN regexp_matches(lower(text), '[a-z0-9]') THEN 1 ELSE 0 END::DOUBLE AS norm FROM v_chunks")
def _(spark, d):
    rows = V.embed(view(spark, d, "v_chunks").select("rid", "text"))
    return rows.select("rid", F.size("embedding").alias("dim"), F.round(V.dot("embedding", "embedding"), 6).alias("norm"))


@query("ve1_shared_model", "v_chunks", "SELECT rid, 1.0::DOUBLE AS cosine, true AS as_one FROM v_chunks WHERE rid % 3 = 0 AND regexp_matches(lower(text), '[a-z0-9]')")
def _(spark, d):
    # A model counted in two steps and stored; chunks and questions are embedded apart by it.
    chunks, path = view(spark, d, "v_chunks").select("rid", "text"), S.scratch(spark, "model")
    for k in (0, 1):
        V.add_texts(chunks.where(F.col("rid") % 2 == k), path, "steps")
    V.add_texts(chunks, path, "once")
    as_one = V.vectorizer(spark, path, "steps").weights == V.vectorizer(spark, path, "once").weights
    stored = V.embed(chunks, V.vectorizer(spark, path, "steps"))
    asked = V.embed(chunks.where("rid % 3 = 0"), V.vectorizer(spark, path, "steps")).select("rid", F.col("embedding").alias("q"))
    cosine = V.dot("embedding", "q") / F.sqrt(V.dot("embedding", "embedding") * V.dot("q", "q"))
    return stored.join(asked, "rid").select("rid", F.round(cosine, 6).alias("cosine"), F.lit(as_one).alias("as_one")).where("cosine is not null")


@query("ve2_l2_normalize", "", """SELECT vec_id, round(embedding[1]::DOUBLE / n, 6) AS first, round(embedding[64]::DOUBLE / n, 6) AS last FROM
  (SELECT *, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) + 1e-9 AS n FROM embeddings)""")
def _(spark, d):
    rows = view(spark, d, "embeddings").select("vec_id", V.l2_normalize("embedding").alias("v"))
    return rows.select("vec_id", F.round(F.col("v")[0], 6).alias("first"), F.round(F.col("v")[63], 6).alias("last"))


@query("ve3_vector_topk", "v_top", "SELECT question_id, rid, score, pos FROM v_top")
def _(spark, d):
    return top(spark, d).select("question_id", "rid", "score", F.col("pos").cast("long").alias("pos"))


@query("ve4_hits_to_chunks", "v_hits", "SELECT question_id, rid, doc_name, page_start FROM v_hits")
def _(spark, d):
    return V.hits_to_chunks(top(spark, d), view(spark, d, "v_chunks")).select("question_id", "rid", "doc_name", "page_start")


@query("ve5_max_normalize", "v_top", """SELECT question_id, rid, round(CASE WHEN m > 0 THEN greatest(0, score) / m ELSE greatest(0, score) END, 6) AS score FROM
  (SELECT *, max(greatest(0, score)) OVER (PARTITION BY question_id) AS m FROM v_top)""")
def _(spark, d):
    return V.max_normalize(top(spark, d), "question_id", "score").select("question_id", "rid", F.round("score", 6).alias("score"))


@query("ve6_fetch_vectors", "v_top", "SELECT question_id, rid, round(embedding[1]::DOUBLE, 6) AS first FROM v_top JOIN embeddings ON vec_id = rid")
def _(spark, d):
    rows = V.fetch_vectors(top(spark, d), chunk_vectors(spark, d))
    return rows.select("question_id", "rid", F.round(F.col("embedding")[0].cast("double"), 6).alias("first"))


TOK = "list_filter(string_split(regexp_replace(lower(coalesce({}, '')), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: x <> '')".format
WORDS = "list_filter(regexp_extract_all(lower(coalesce({}, '')), '[a-z0-9_]+'), lambda x: length(x) > {})".format


@query("rt1_term_stats", "", f"""WITH r AS (SELECT conv_id, turn AS rid, {TOK('text')} AS w FROM conversations), t AS (SELECT conv_id, rid, len(w) AS dl, unnest(w) AS term FROM r),
  tf AS (SELECT conv_id, rid, dl, term, count(*) AS tf FROM t GROUP BY ALL)
  SELECT tf.*, df, n_docs, round(avgdl, 6) AS avgdl FROM tf JOIN (SELECT conv_id, term, count(*) AS df FROM tf GROUP BY ALL) USING (conv_id, term)
  JOIN (SELECT conv_id, count(*) AS n_docs, avg(len(w)) AS avgdl FROM r GROUP BY 1) USING (conv_id)""")
def _(spark, d):
    rows = view(spark, d, "conversations").select("conv_id", F.col("turn").alias("rid"), "text")
    return R.term_stats(rows, "conv_id").select("conv_id", "rid", F.col("dl").cast("long").alias("dl"), "term", "tf", "df", "n_docs", F.round("avgdl", 6).alias("avgdl"))


BM25 = f""", qt AS (SELECT question_id, term, count(*) AS times FROM (SELECT question_id, unnest({TOK('question')}) AS term FROM v_questions) GROUP BY ALL),
  cr AS (SELECT question_id, rid, {TOK('text')} AS w FROM v_hits), cs AS (SELECT question_id, count(*) AS n, avg(len(w)) AS avgdl FROM cr GROUP BY 1),
  ct AS (SELECT question_id, rid, dl, term, count(*) AS tf FROM (SELECT question_id, rid, len(w) AS dl, unnest(w) AS term FROM cr) SEMI JOIN qt USING (question_id, term) GROUP BY ALL),
  cd AS (SELECT question_id, term, count(*) AS df FROM ct GROUP BY ALL),
  cb AS (SELECT question_id, rid, sum(times * ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.5::DOUBLE / (tf + 1.5::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl))) AS s FROM ct JOIN cd USING (question_id, term) JOIN cs USING (question_id) JOIN qt USING (question_id, term) GROUP BY ALL),
  b AS (SELECT question_id, rid, CASE WHEN m > 0 THEN s / m ELSE s END AS bm25 FROM (SELECT h.question_id, h.rid, coalesce(s, 0) AS s, max(coalesce(s, 0)) OVER (PARTITION BY h.question_id) AS m FROM v_hits h LEFT JOIN cb USING (question_id, rid)))"""


@query("rt2_bm25", "v_hits", BM25 + " SELECT question_id, rid, round(bm25, 6) AS bm25 FROM b")
def _(spark, d):
    return R.bm25(view(spark, d, "v_questions"), hits(spark, d)).withColumn("bm25", F.round("bm25", 6))


INTENT = f"""SELECT question_id, regexp_matches(lower(question), {rx(R.FORMULA_KEYS)}) AS is_formula_query, regexp_matches(lower(question), {rx(R.EXPLAIN_KEYS)}) AS wants_explanation,
  regexp_matches(lower(question), {rx(R.FORMULA_WORDS)}) AS has_formula_word, regexp_matches(lower(question), {rx(R.EXPLAIN_WORDS)}) AS has_explain_word, regexp_matches(trim(lower(question)), {rx(R.PENALTY_STARTS)}) AS is_task FROM v_questions"""


@query("rt3_question_intent", "v_questions", INTENT)
def _(spark, d):
    return R.question_intent(view(spark, d, "v_questions")).drop("question")


def flagged(spark, d):
    rows = hits(spark, d)
    rows = rows.join(R.bm25(view(spark, d, "v_questions"), rows), ["question_id", "rid"])
    return rows.join(R.question_intent(view(spark, d, "v_questions")).drop("question"), "question_id")


PURE = "is_formula_query AND NOT wants_explanation"
FLAGGED = BM25 + f", f AS (SELECT h.*, b.bm25, i.* EXCLUDE (question_id) FROM v_hits h JOIN b USING (question_id, rid) JOIN ({INTENT}) i USING (question_id))"
FILTERED = FLAGGED + f""", sf AS (SELECT * EXCLUDE (score, bm25), score * less AS score, bm25 * less AS bm25 FROM (SELECT *, CASE WHEN {PURE} AND is_task THEN 0.85 ELSE 1 END::DOUBLE AS less FROM f
  WHERE NOT ({PURE} AND regexp_matches(lower(section_tag), {rx(R.BAD_SECTIONS)}))))"""
STRICT = FILTERED + f""", st AS (SELECT * FROM (SELECT *, max(strict::INT) OVER (PARTITION BY question_id) AS has_strict FROM (SELECT *, is_formula AND (formula_confidence >= 0.75 OR regexp_matches(text, {rx(R.SURFACE)})) AS strict FROM sf))
  WHERE NOT ({PURE}) OR strict OR has_strict = 0)"""
BONUS = STRICT + f""", bo AS (SELECT *, (CASE WHEN is_equation THEN 0.12 ELSE 0 END + CASE WHEN section_tag = 'exercises' THEN -0.10 ELSE 0 END + CASE WHEN regexp_matches(lower(text), {rx(R.KEY_TERMS)}) THEN 0.08 ELSE 0 END
  + CASE semantic_label WHEN 'definition' THEN 0.10 WHEN 'theorem' THEN 0.08 WHEN 'rule' THEN 0.08 WHEN 'example' THEN -0.04 WHEN 'exercise' THEN -0.08 ELSE 0 END
  + CASE WHEN NOT is_formula_query THEN 0 WHEN is_formula THEN 0.35 * greatest(0, least(1, formula_confidence)) ELSE -0.5 END)::DOUBLE AS bonus FROM st)"""


@query("rt4_section_filter", "v_hits", FILTERED + " SELECT question_id, rid, round(score, 8) AS score, round(bm25, 6) AS bm25 FROM sf")  # six places times 0.85
def _(spark, d):
    return R.section_filter(flagged(spark, d)).select("question_id", "rid", F.round("score", 8).alias("score"), F.round("bm25", 6).alias("bm25"))


@query("rt5_strict_formula", "v_hits", STRICT + " SELECT question_id, rid FROM st")
def _(spark, d):
    return R.strict_formula(R.section_filter(flagged(spark, d))).select("question_id", "rid")


@query("rt6_rank_bonus", "v_hits", BONUS + " SELECT question_id, rid, round(bonus, 6) AS bonus FROM bo")
def _(spark, d):
    return R.rank_bonus(R.strict_formula(R.section_filter(flagged(spark, d)))).select("question_id", "rid", F.round("bonus", 6).alias("bonus"))


def search(spark, d, k=5):
    return R.hybrid_search(question_vectors(spark, d), view(spark, d, "v_chunks"), chunk_vectors(spark, d), k)


HYBRID = BONUS.replace(", bo AS", ", nb AS", 1).replace("h.*, b.bm25", "h.* EXCLUDE (score), CASE WHEN max(greatest(0, h.score)) OVER (PARTITION BY h.question_id) > 0 THEN greatest(0, h.score) / max(greatest(0, h.score)) OVER (PARTITION BY h.question_id) ELSE 0 END AS score, b.bm25") + """, hy AS (SELECT * FROM
  (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY round(hybrid, 9) DESC, rid) AS rank FROM (SELECT *, 0.7::DOUBLE * score + 0.3::DOUBLE * bm25 + bonus AS hybrid FROM nb)) WHERE rank <= 5)"""


@query("rt7_hybrid_search", "v_hits", HYBRID + " SELECT question_id, rid, round(hybrid, 6) AS hybrid, rank FROM hy")
def _(spark, d):
    return search(spark, d).select("question_id", "rid", F.round("hybrid", 6).alias("hybrid"), F.col("rank").cast("long").alias("rank"))


def vectored(spark, d):
    rows = V.fetch_vectors(top(spark, d), chunk_vectors(spark, d)).withColumn("base", F.col("score"))
    return rows.join(question_vectors(spark, d).select("question_id", F.col("embedding").alias("q_vec")), "question_id")


#: A greedy choice is a recursion: each step joins what is picked with the rest of the pool.
GREEDY = """, c AS ({pool}), g AS (
  SELECT question_id, 1 AS k, rid, [rid] AS picked, [e] AS vs FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY {first} DESC, {tie}) AS n FROM c) WHERE n = 1
  UNION ALL SELECT question_id, k, rid, picked, vs FROM (SELECT g.question_id, g.k + 1 AS k, c.rid, list_append(g.picked, c.rid) AS picked, list_append(g.vs, c.e) AS vs,
    row_number() OVER (PARTITION BY g.question_id ORDER BY {gain} - {penalty}::DOUBLE * list_max(list_transform(g.vs, lambda v: list_dot_product(v, c.e))) DESC, {tie}) AS n
    FROM g JOIN c ON c.question_id = g.question_id WHERE g.k < {k} AND NOT list_contains(g.picked, c.rid)) WHERE n = 1)""".format
POOLED = "SELECT t.question_id, t.rid, t.score AS base, t.pos, e.embedding::DOUBLE[] AS e, q.embedding::DOUBLE[] AS q FROM v_top t JOIN embeddings e ON e.vec_id = t.rid JOIN v_qv q ON q.question_id = t.question_id"
UNIT = "list_transform({0}, lambda x: x / (sqrt(list_dot_product({0}, {0})) + 1e-8))".format


@query("rt8_mmr", "v_top", GREEDY(pool=POOLED, first="0.75::DOUBLE * base + 0.25::DOUBLE * list_dot_product(e, q)", gain="0.75::DOUBLE * c.base", penalty=0.25, k=5, tie="c.rid").replace("list_dot_product(e, q) DESC, c.rid", "list_dot_product(e, q) DESC, rid") + " SELECT question_id, rid, k::INT AS mmr_rank FROM g")
def _(spark, d):
    return R.mmr(vectored(spark, d), 5)


ALIKE = f"SELECT *, list_dot_product(e, q) AS alike FROM (SELECT question_id, rid, pos, {UNIT('e')} AS e, {UNIT('q')} AS q FROM ({POOLED}) WHERE pos <= 60)"


@query("rt9_mmr_order", "v_top", GREEDY(pool=ALIKE, first="alike", gain="0.7::DOUBLE * alike", penalty=1 - 0.7, k=60, tie="c.pos").replace("alike DESC, c.pos", "alike DESC, pos") + " SELECT question_id, rid, k::INT AS mmr_rank FROM g UNION ALL SELECT question_id, rid, pos::INT FROM v_top WHERE pos > 60")
def _(spark, d):
    return R.mmr_order(vectored(spark, d))


OVERLAP_SQL = "len(list_intersect({a}, {b}))"
FEATURES = f"""SELECT *, {WORDS('question', 0)} AS qw, {WORDS("substr(trim(regexp_replace(text, '\\s+', ' ', 'g')), 1, 800)", 0)} AS tw FROM v_wide"""


@query("rt10_rerank", "v_wide", f"""SELECT question_id, rid, new_rank FROM (SELECT question_id, rid, row_number() OVER (PARTITION BY question_id ORDER BY pos > 200, CASE WHEN pos > 200 THEN 0 ELSE s END DESC, pos) AS new_rank FROM
  (SELECT *, round(0.7 * shared / greatest(1, nq) + 0.3 * shared / greatest(1, nq + nt - shared), 6) AS s FROM (SELECT *, len(list_intersect(qw, tw)) AS shared, len(list_distinct(qw)) AS nq, len(list_distinct(tw)) AS nt FROM ({FEATURES}))))""")
def _(spark, d):
    return R.rerank(hits(spark, d, WIDE)).select("question_id", "rid", F.col("new_rank").cast("long").alias("new_rank"))


@query("rt11_scope_docs", "v_hits", r"""SELECT question_id, rid FROM (SELECT h.*, CASE WHEN by_code IS NOT NULL THEN by_code WHEN by_word IS NOT NULL THEN by_word ELSE common END AS target FROM v_hits h JOIN (
  SELECT question_id, min_by(doc_name, pos) FILTER (code <> '' AND contains(name, code)) AS by_code, min_by(doc_name, pos) FILTER (len(list_filter(words, lambda w: contains(name, w))) > 0) AS by_word FROM
  (SELECT *, lower(regexp_extract(question, '\b([A-Z]{2,}[0-9]{2,})\b', 1)) AS code, regexp_extract_all(lower(question), '[a-z0-9_.\-]{4,}') AS words, lower(doc_name) AS name FROM v_hits) GROUP BY 1) USING (question_id)
  JOIN (SELECT question_id, max_by(doc_name, n * 1000 - first) AS common FROM (SELECT question_id, doc_name, count(*) AS n, min(pos) AS first FROM v_hits GROUP BY ALL) GROUP BY 1) USING (question_id)) WHERE doc_name = target""")
def _(spark, d):
    return R.scope_docs(hits(spark, d)).select("question_id", "rid")


@query("rt11_scope_docs_first", "v_hits", r"""SELECT question_id, rid, row_number() OVER (PARTITION BY question_id ORDER BY doc_name <> target, pos) AS place FROM (SELECT h.*, CASE WHEN by_code IS NOT NULL THEN by_code WHEN by_word IS NOT NULL THEN by_word ELSE common END AS target FROM v_hits h JOIN (
  SELECT question_id, min_by(doc_name, pos) FILTER (code <> '' AND contains(name, code)) AS by_code, min_by(doc_name, pos) FILTER (len(list_filter(words, lambda w: contains(name, w))) > 0) AS by_word FROM
  (SELECT *, lower(regexp_extract(question, '\b([A-Z]{2,}[0-9]{2,})\b', 1)) AS code, regexp_extract_all(lower(question), '[a-z0-9_.\-]{4,}') AS words, lower(doc_name) AS name FROM v_hits) GROUP BY 1) USING (question_id)
  JOIN (SELECT question_id, max_by(doc_name, n * 1000 - first) AS common FROM (SELECT question_id, doc_name, count(*) AS n, min(pos) AS first FROM v_hits GROUP BY ALL) GROUP BY 1) USING (question_id))""")
def _(spark, d):
    return R.scope_docs(hits(spark, d), strict=False).select("question_id", "rid", F.col("pos").cast("long").alias("place"))


@query("rt12_filter_chapter", "v_hits", r""", n AS (SELECT *, nullif(regexp_extract(question, '(?i)\b(?:chapter|chap|ch)\s*([0-9]{1,3})\b', 1), '')::INT AS wc, nullif(regexp_extract(question, '(?i)(?:\bsection|\bsec|§)\s*([0-9]+(?:\.[0-9]+)*)', 1), '') AS ws,
    coalesce(nullif(regexp_extract(lower(hp), '\bchapter\s*([0-9]{1,3})\b', 1), ''), nullif(regexp_extract(hp, '^\s*([0-9]{1,3})(?:\.[0-9]+)*\b', 1), ''))::INT AS hc, nullif(regexp_extract(lower(hp), '\bsection\s*([0-9]+(?:\.[0-9]+)*)\b', 1), '') AS hs FROM (SELECT *, coalesce(nullif(heading_path, ''), section_tag, '') AS hp FROM v_hits)),
  m AS (SELECT *, coalesce(CASE WHEN wc IS NOT NULL THEN hc = wc ELSE starts_with(hs, ws) END, false) AS hit FROM n),
  w AS (SELECT *, max(hit::INT) OVER q AS found, floor(median(CASE WHEN hit AND page_start > 0 THEN page_start END) OVER q) AS mid FROM m WINDOW q AS (PARTITION BY question_id))
  SELECT question_id, rid FROM w WHERE (wc IS NULL AND ws IS NULL) OR found = 0 OR hit OR page_start BETWEEN greatest(1, mid - 40) AND mid + 40""")
def _(spark, d):
    return R.filter_chapter(hits(spark, d), window=40).select("question_id", "rid")


@query("rt13_page_num", "v_chunks", "SELECT rid, CASE WHEN rid % 4 > 0 THEN rid % 4 WHEN page_start > 0 THEN page_start ELSE 0 END AS page FROM v_chunks")
def _(spark, d):
    return view(spark, d, "v_chunks").withColumn("page_num", F.col("rid") % 4).select("rid", R.page_num("page_num", "page_start").cast("long").alias("page"))


@query("rt14_relevance_gate", "v_questions", f""", t AS (SELECT DISTINCT page_id, unnest({WORDS("regexp_extract(html, '<title>([^<]*)</title>', 1)", 2)}) AS w FROM pages),
  q AS (SELECT question_id, question, list_distinct({WORDS('question', 2)}) AS w FROM v_questions), b AS (SELECT question_id, max(n) AS n FROM (SELECT question_id, page_id, count(*) AS n FROM (SELECT question_id, unnest(w) AS w FROM q) JOIN t USING (w) GROUP BY ALL) GROUP BY 1),
  r AS (SELECT question_id, question, CASE WHEN len(w) > 0 THEN round(coalesce(n, 0) / len(w), 6) END AS relevance FROM q LEFT JOIN b USING (question_id))
  SELECT question_id, relevance, relevance IS NULL OR relevance >= 0.2 OR regexp_matches(lower(question), '(textbook|chapter|section|lecture|notes|\\.(pdf|docx))') AS keep FROM r""")
def _(spark, d):
    topics = view(spark, d, "pages").select(F.col("page_id").alias("name"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("text"))
    return R.relevance_gate(view(spark, d, "v_questions"), topics).select("question_id", "relevance", "keep")


@query("rt15_token_overlap", "v_turns", f"""SELECT conv_id, turn, round(len(list_filter(qw, lambda x: list_contains(tw, x))) / greatest(1, len(qw)), 6) AS overlap FROM (SELECT conv_id, turn, {WORDS('q', 2)} AS qw, {WORDS('a', 2)} AS tw FROM v_turns)""")
def _(spark, d):
    rows = view(spark, d, "v_turns").select("conv_id", "turn", F.col("q").alias("question"), F.col("a").alias("text"))
    return R.token_overlap(rows).select("conv_id", "turn", F.round("overlap", 6).alias("overlap"))


@query("rt16_expand_queries", "v_questions", """SELECT question_id, 0 AS n, trim(question) AS query FROM v_questions UNION ALL SELECT question_id, 1, trim(question) || ' key formulas' FROM v_questions UNION ALL SELECT question_id, 2, trim(question) || ' canonical definitions' FROM v_questions""")
def _(spark, d):
    return R.expand_queries(view(spark, d, "v_questions"))


@query("rt17_cluster_hits", "v_hits", """SELECT question_id, doc_name || '|' || heading_path || '|' || page_start || '-' || page_start AS cluster, count(*) AS n, string_agg(rid::VARCHAR, ',' ORDER BY rid) AS rids FROM v_hits GROUP BY 1, 2""")
def _(spark, d):
    return R.cluster_hits(hits(spark, d))


@query("rt18_chapter_ranges", "v_hits", "SELECT doc_name, heading_path AS chapter, min(page_start) AS first_page, max(page_start) AS last_page FROM v_hits GROUP BY ALL")
def _(spark, d):
    return R.chapter_ranges(hits(spark, d))


@query("rt19_jaccard_judge", "v_hits", f"""SELECT question_id, rid, round(greatest(0, least(1, shared / greatest(1, nq + nt - shared) - CASE WHEN regexp_matches(lower(text), '(exercise|show that|prove that|find the value)') THEN 0.1 ELSE 0 END)), 6)::DOUBLE AS judge FROM
  (SELECT *, len(list_intersect(qw, tw)) AS shared, len(list_distinct(qw)) AS nq, len(list_distinct(tw)) AS nt FROM (SELECT *, {WORDS('question', 0)} AS qw, {WORDS('text', 0)} AS tw FROM v_hits))""")
def _(spark, d):
    return R.jaccard_judge(hits(spark, d)).select("question_id", "rid", "judge")


@query("rt20_merge_evidence", "v_hits v_turns", f""", web AS (SELECT question_id, pos, text, question, len(list_filter(qw, lambda x: list_contains(tw, x))) / greatest(1, len(qw)) AS overlap FROM (SELECT *, {WORDS('question', 2)} AS qw, {WORDS('text', 2)} AS tw FROM v_hits) WHERE pos > 20),
  rich AS (SELECT question_id, max(overlap) AS o, max(regexp_matches(lower(question), '(textbook|chapter|section|lecture|notes|\\.(pdf|docx))')::INT) AS names FROM web GROUP BY 1),
  e AS (SELECT question_id, pos, text, 0 AS kind FROM web UNION ALL SELECT h.question_id, h.pos, h.text, 1 FROM v_hits h LEFT JOIN rich USING (question_id) WHERE h.pos <= 5 AND (o IS NULL OR names = 1 OR o < 0.05)
  UNION ALL SELECT conv_id, turn, q || a, 2 FROM v_turns)
  SELECT question_id, kind, pos, row_number() OVER (PARTITION BY question_id ORDER BY kind, pos) AS place FROM e""")
def _(spark, d):
    rows = hits(spark, d).select("question_id", F.col("pos").cast("long").alias("pos"), "text", "question")
    turns = view(spark, d, "v_turns").select(F.col("conv_id").alias("question_id"), F.col("turn").alias("pos"), F.concat("q", "a").alias("text"))
    merged = R.merge_evidence(R.token_overlap(rows.where("pos > 20")), rows, turns, 5, overlap=0.05)
    return merged.select("question_id", "kind", "pos", F.col("place").cast("long").alias("place"))


@query("rt21_pre_order", "v_hits", "SELECT question_id, rid, round(score + CASE WHEN has_math THEN 0.1 ELSE 0 END - CASE WHEN is_equation THEN 0.05 ELSE 0 END, 6)::DOUBLE AS order_score FROM v_hits")
def _(spark, d):
    return R.pre_order(hits(spark, d).withColumn("has_table", F.col("is_equation"))).select("question_id", "rid", "order_score")
