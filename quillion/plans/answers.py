"""Queries over context, citations, evidence and memory."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillion.functions import text as T
from quillion.operators import context as X
from quillion.operators import evidence as E
from quillion.operators import memory as M
from quillion.plans.base import chunk_vectors, hits, query, question_vectors, rx
from quillion.plans.fixtures import VIEWS, view, with_views
from quillion.plans.pages import COLLAPSE, results, split_sql
from quillion.plans.ranking import HYBRID, WORDS, search
from quillion.sources import store as S

TAG = "'[' || doc_name || ' p.' || page_start || ']'"


def ranked(spark, d):
    return hits(spark, d).withColumn("rank", F.col("pos"))


@query("cx1_source_tag", "v_chunks", f"SELECT rid, {TAG} AS source FROM v_chunks")
def _(spark, d):
    return view(spark, d, "v_chunks").select("rid", X.source_tag().alias("source"))


@query("cx2_compress_citations", "v_chunks", """, p AS (SELECT semantic_label, doc_name, page_start AS a, page_start + CASE WHEN page_start % 7 = 0 THEN 2 ELSE 0 END AS b FROM v_chunks WHERE semantic_label IS NOT NULL UNION ALL SELECT 'rule', 'src0', 12, 99999999),
  i AS (SELECT *, sum(opens) OVER (PARTITION BY semantic_label, doc_name ORDER BY a, b) AS run FROM (SELECT *, CASE WHEN coalesce(max(b) OVER (PARTITION BY semantic_label, doc_name ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -9) < a - 1 THEN 1 ELSE 0 END AS opens FROM (SELECT DISTINCT * FROM p))),
  r AS (SELECT semantic_label, doc_name, min(a) AS a, max(b) AS b FROM i GROUP BY semantic_label, doc_name, run)
  SELECT semantic_label, '[' || doc_name || ' p.' || string_agg(CASE WHEN a = b THEN a::VARCHAR ELSE a || '–' || b END, ', ' ORDER BY a) || ']' AS citation FROM r GROUP BY semantic_label, doc_name UNION ALL SELECT 'rule', '[odd]'""")
def _(spark, d):
    last = F.when(F.col("page_start") % 7 == 0, F.col("page_start") + 2).otherwise(F.col("page_start"))
    rows = view(spark, d, "v_chunks").where("semantic_label is not null").withColumn("page_end", last)
    rows = rows.select("semantic_label", X.source_tag(last="page_end").alias("citation"))
    more = spark.createDataFrame([("rule", "odd"), ("rule", "[src0 p.99999999-12]")], "semantic_label string, citation string")
    return X.compress_citations(rows.unionByName(more), "semantic_label")


@query("cx3_distinct_sources", "v_hits", f"""SELECT question_id, source, rank FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY pos, source) AS rank FROM (SELECT question_id, '[' || doc_name || ']' AS source, min(pos) AS pos FROM v_hits GROUP BY ALL)) WHERE rank <= 10""")
def _(spark, d):
    rows = hits(spark, d).withColumn("source", F.concat(F.lit("["), "doc_name", F.lit("]")))
    return X.distinct_sources(rows, "question_id", 10).select("question_id", "source", F.col("rank").cast("long").alias("rank"))


@query("cx4_context_table", "v_hits", f"SELECT question_id, md5(string_agg({TAG} || ' ' || substr(text, 1, 1200), chr(10) || '---' || chr(10) ORDER BY pos)) AS digest FROM v_hits GROUP BY 1")
def _(spark, d):
    return X.context_table(ranked(spark, d)).select("question_id", F.md5("context").alias("digest"))


BLOCKS = f", bl AS (SELECT *, length(block) AS size FROM (SELECT question_id, pos, doc_name, page_start, {TAG} || ' ' || {COLLAPSE('text')} AS block FROM v_hits WHERE {COLLAPSE('text')} <> ''))"


@query("cx5_clip_context", "v_hits", BLOCKS + " SELECT question_id, md5(string_agg(substr(block, 1, (14000 - before)::BIGINT), chr(10) ORDER BY pos)) AS digest FROM (SELECT *, sum(size) OVER (PARTITION BY question_id ORDER BY pos) - size AS before FROM bl) WHERE before < 14000 GROUP BY 1")
def _(spark, d):
    return X.clip_context(ranked(spark, d)).select("question_id", F.md5("context").alias("digest"))


BATCHES = BLOCKS + """, nb AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY pos) AS k FROM bl), r AS (SELECT question_id, pos, k, size AS used, 0 AS batch FROM nb WHERE k = 1 UNION ALL
  SELECT n.question_id, n.pos, n.k, CASE WHEN (r.used + n.size > 12000 AND r.used > 0) OR r.used >= 14400 THEN n.size ELSE r.used + n.size END, r.batch + ((r.used + n.size > 12000 AND r.used > 0) OR r.used >= 14400)::INT
  FROM r JOIN nb n ON n.question_id = r.question_id AND n.k = r.k + 1)"""


@query("cx6_batch_context", "v_hits", BATCHES + " SELECT question_id, pos, batch FROM r")
def _(spark, d):
    return X.batch_context(ranked(spark, d)).select("question_id", F.col("pos").cast("long").alias("pos"), "batch")


@query("cx7_select_batches", "v_hits", BATCHES + """, x AS (SELECT r.question_id, r.batch, r.pos, doc_name, greatest(1, size // 4) AS tokens FROM r JOIN bl USING (question_id, pos)),
  p AS (SELECT question_id, batch, sum(new)::BIGINT AS new, sum(tokens)::BIGINT AS tokens FROM (SELECT *, (row_number() OVER (PARTITION BY question_id, doc_name ORDER BY batch, pos) = 1)::INT AS new FROM x) GROUP BY ALL),
  u AS (SELECT *, (sum(tokens) OVER (PARTITION BY question_id ORDER BY batch))::BIGINT AS used, min(CASE WHEN batch >= 1 AND new = 0 THEN batch END) OVER (PARTITION BY question_id) AS stop FROM p)
  SELECT question_id, batch, new, tokens, used FROM u WHERE batch < 6 AND used <= 9000 AND (stop IS NULL OR batch <= stop)""")
def _(spark, d):
    rows = X.batch_context(ranked(spark, d)).withColumns({"source": F.col("doc_name"), "tokens": T.token_estimate("block").cast("long")})
    return X.select_batches(rows, tok_cap=9000)


def _list(words):
    return "[" + ", ".join(rx(w) for w in words) + "]"


KEYWORDS = f"""list_sort(list_distinct(list_concat(list_concat(list_filter(regexp_split_to_array(k, '\\s+'), lambda w: w <> '' AND NOT list_contains({_list(T.STOP_WORDS)}, w) AND (length(w) >= 4 OR list_contains({_list(T.SHORT_MATH)}, w))),
  list_filter({_list(T.MATH_PHRASES)}, lambda p: contains(k, replace(p, '-', ' ')) OR contains(k, p))), CASE WHEN contains(k, 'trig') THEN {_list(T.TRIGONOMETRY)} ELSE [] END)))"""


@query("cx8_keywords", "v_questions", f"SELECT question_id, array_to_string({KEYWORDS}, ',') AS kws FROM (SELECT question_id, regexp_replace(lower(question), '[^a-z0-9\\sπ]', ' ', 'g') AS k FROM v_questions)")
def _(spark, d):
    return view(spark, d, "v_questions").select("question_id", F.array_join(T.keywords("question"), ",").alias("kws"))


@query("cx9_quotes", "v_hits", f""", kq AS (SELECT question_id, {KEYWORDS} AS kws FROM (SELECT question_id, regexp_replace(lower(question), '[^a-z0-9\\sπ]', ' ', 'g') AS k FROM v_questions)),
  s AS (SELECT question_id, hp AS rank, doc_name, page_start, pos, sentence FROM ({split_sql('b', '(SELECT question_id, pos AS hp, doc_name, page_start, text FROM v_hits)', 'question_id, hp, doc_name, page_start')})),
  l AS (SELECT s.*, substr(string_agg(sentence, ' ') OVER (PARTITION BY s.question_id, rank ORDER BY pos ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 1, 500) AS quote,
    len(list_filter(kws, lambda k: contains(lower(substr(sentence, 1, 400)), k))) + regexp_matches(lower(substr(sentence, 1, 400)), '(π|pi|e\\^i)')::INT AS lex FROM s JOIN kq USING (question_id)),
  c AS (SELECT *, round(0.2 * CASE WHEN max(lex) OVER (PARTITION BY question_id) > 0 THEN lex / max(lex) OVER (PARTITION BY question_id) ELSE 0 END, 6) AS score FROM l),
  p AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY question_id, doc_name, page_start ORDER BY score DESC, rank, pos) = 1)
  SELECT question_id, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, rank, pos) AS quote_rank, {TAG} AS source, md5(quote) AS digest, score::DOUBLE AS score FROM p QUALIFY quote_rank <= 5""")
def _(spark, d):
    rows = X.quotes(view(spark, d, "v_questions"), ranked(spark, d))
    return rows.select("question_id", F.col("quote_rank").cast("long").alias("quote_rank"), "source", F.md5("quote").alias("digest"), "score")


SYSTEM = "Answer from the context and cite it."


@query("cx10_prompt_table", "v_hits v_turns", f""", ctx AS (SELECT question_id, string_agg({TAG} || ' ' || substr(text, 1, 1200), chr(10) || '---' || chr(10) ORDER BY pos) AS context FROM v_hits GROUP BY 1),
  hist AS (SELECT conv_id AS question_id, string_agg('user: ' || q || chr(10) || 'assistant: ' || a, chr(10) ORDER BY turn) AS history FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM v_turns) WHERE k <= 8 GROUP BY 1)
  SELECT question_id, md5(concat_ws(chr(10), '{SYSTEM}', history, 'terms: ' || array_to_string(kws, ', '), 'question: ' || question, 'context:' || chr(10) || context)) AS digest FROM
  (SELECT question_id, question, {KEYWORDS} AS kws FROM (SELECT *, regexp_replace(lower(question), '[^a-z0-9\\sπ]', ' ', 'g') AS k FROM v_questions)) LEFT JOIN ctx USING (question_id) LEFT JOIN hist USING (question_id)""")
def _(spark, d):
    turns = view(spark, d, "v_turns").withColumnRenamed("conv_id", "question_id")
    rows = X.prompt_table(view(spark, d, "v_questions"), X.context_table(ranked(spark, d)), turns, SYSTEM)
    return rows.select("question_id", F.md5("prompt").alias("digest"))


NOTES = ("Write notes.", "One section a topic.")


@query("cx10_document_prompts", "v_chunks", f""", b AS (SELECT doc_name, page_start, {TAG} || ' ' || {COLLAPSE('text')} AS block FROM v_chunks WHERE {COLLAPSE('text')} <> ''), c AS (SELECT *, sum(length(block)) OVER (PARTITION BY doc_name ORDER BY page_start) - length(block) AS before FROM b)
  SELECT doc_name, md5(concat_ws(chr(10), '{NOTES[0]}', '{NOTES[1]}', 'context:' || chr(10) || string_agg(substr(block, 1, (14000 - before)::BIGINT), chr(10) ORDER BY page_start))) AS digest FROM c WHERE before < 14000 GROUP BY 1""")
def _(spark, d):
    rows = view(spark, d, "v_chunks").withColumn("rank", F.col("page_start"))
    return X.document_prompts(rows, *NOTES).select("doc_name", F.md5("prompt").alias("digest"))


@query("cx11_clean_citations", "v_chunks", f"""SELECT rid, 'label of ' || rid || chr(10) || '$$x = ' || rid || '$$ ' || {TAG} AS a, '$y$ ' || {TAG} || ' and more' AS b FROM v_chunks""".replace("'label of ' || rid || chr(10) || '$$x = ' || rid || '$$ ' || " + TAG, "'$$x = ' || rid || '$$ ' || " + TAG + " || chr(10) || 'label of ' || rid"))
def _(spark, d):
    a = F.concat(F.lit("label of "), "rid", F.lit("\n$$x = "), "rid", F.lit("$$"), X.source_tag())
    b = F.concat(F.lit("$y "), X.source_tag(), F.lit("$ and more"))
    return view(spark, d, "v_chunks").select("rid", X.clean_citations(a).alias("a"), X.clean_citations(b).alias("b"))


@query("cx12_apply_aliases", "v_pages", r"SELECT doc_id, md5(regexp_replace(regexp_replace(lower(regexp_replace(text, '[^\x00-\x7F]', '', 'g')), '\bthe\b', 'THE', 'g'), '\band\b', 'A&B', 'g')) AS digest FROM v_pages")
def _(spark, d):
    rows = view(spark, d, "v_pages").select("doc_id", F.lower(F.regexp_replace("text", "[^\\x00-\\x7F]", "")).alias("text"))
    return X.apply_aliases(rows, [("the", "THE"), ("and", "A&B")]).select("doc_id", F.md5("text").alias("digest"))


@query("cx12_many_aliases", "v_pages", r""", w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]{5,}')) AS word FROM conversations), t AS (SELECT doc_id, regexp_extract_all(lower(regexp_replace(text, '[^\x00-\x7F]', '', 'g')), '[a-z0-9_]+|[^a-z0-9_]+') AS l FROM v_pages),
  u AS (SELECT doc_id, unnest(l) AS x, generate_subscripts(l, 1) AS i FROM t) SELECT doc_id, md5(string_agg(CASE WHEN word IS NULL THEN x ELSE x || '_' || length(x) END, '' ORDER BY i)) AS digest FROM u LEFT JOIN w ON x = word GROUP BY 1""")
def _(spark, d):
    # Every longer word of the conversations is an alias; whole words only, so none meets another's result.
    said = F.lower(F.translate("text", "\u0130", "i"))  # which Spark would lower to two characters
    words = view(spark, d, "conversations").select(F.explode(F.regexp_extract_all(said, F.lit("([a-z]{5,})"), 1)).alias("src")).distinct()
    aliases = words.withColumn("dst", F.concat("src", F.lit("_"), F.length("src")))
    rows = view(spark, d, "v_pages").select("doc_id", F.lower(F.regexp_replace("text", "[^\\x00-\\x7F]", "")).alias("text"))
    return X.apply_alias_table(rows, "doc_id", aliases).select("doc_id", F.md5("text").alias("digest"))


@query("cx13_learn_aliases", "v_turns", "SELECT 'x' || conv_id AS src, 'later' || max(turn) AS dst FROM v_turns GROUP BY conv_id UNION ALL SELECT 'old' || conv_id, 'new thing' FROM v_turns GROUP BY conv_id")
def _(spark, d):
    said = F.concat(F.lit("please call x"), "conv_id", F.lit(" as later"), "turn", F.lit(" and use 'new thing' instead of old"), "conv_id")
    return X.learn_aliases(view(spark, d, "v_turns").withColumn("q", said))


@query("slice_cited_search", "v_hits", HYBRID + f""", p AS (SELECT DISTINCT question_id, doc_name, page_start AS page FROM hy), i AS (SELECT *, page - row_number() OVER (PARTITION BY question_id, doc_name ORDER BY page) AS island FROM p),
  r AS (SELECT question_id, doc_name, min(page) AS a, max(page) AS b FROM i GROUP BY question_id, doc_name, island),
  c AS (SELECT question_id, '[' || doc_name || ' p.' || string_agg(CASE WHEN a = b THEN a::VARCHAR ELSE a || '–' || b END, ', ' ORDER BY a) || ']' AS citation FROM r GROUP BY question_id, doc_name),
  o AS (SELECT question_id, string_agg(citation, ' ' ORDER BY citation) AS citations FROM c GROUP BY 1) SELECT question_id, rank, rid, hybrid, {TAG} AS source, citations FROM hy JOIN o USING (question_id)""")
def _(spark, d):
    found = search(spark, d).select("question_id", "rank", "rid", "hybrid", X.source_tag().alias("source"))
    found = S.keep(found, "found")  # a few rows a question, which citations and result both read
    cited = X.compress_citations(found, "question_id", "source").groupBy("question_id").agg(F.array_join(F.sort_array(F.collect_list("citation")), " ").alias("citations"))
    return found.join(cited, "question_id").select("question_id", F.col("rank").cast("long").alias("rank"), "rid", "hybrid", "source", "citations")


KEY = ["question_id", "turn"]


def supported(spark, d):
    rows = E.answer_sentences(view(spark, d, "v_answers"), KEY)
    return E.support_status(E.support(rows, view(spark, d, "v_evidence"), KEY))


SUPPORT = f""", se AS (SELECT question_id, turn, pos AS n, sentence, list_distinct({WORDS('sentence', 0)}) AS w FROM ({split_sql('c', 'v_answers', 'question_id, turn', 'draft')})),
  ev AS (SELECT question_id, pos, source, list_distinct({WORDS('text', 0)}) AS w FROM v_evidence),
  be AS (SELECT question_id, turn, n, score, source FROM (SELECT *, row_number() OVER (PARTITION BY question_id, turn, n ORDER BY score DESC, pos) AS k FROM
    (SELECT s.question_id, s.turn, s.n, e.pos, e.source, round(len(list_intersect(s.w, e.w)) / (len(s.w) + len(e.w) - len(list_intersect(s.w, e.w))), 6) AS score FROM se s JOIN ev e USING (question_id) WHERE len(list_intersect(s.w, e.w)) > 0)) WHERE k = 1),
  su AS (SELECT se.question_id, se.turn, se.n, sentence, coalesce(score, 0) AS score, coalesce(source, '') AS source, CASE WHEN coalesce(score, 0) >= 0.08 THEN 'supported' ELSE 'missing' END AS status FROM se LEFT JOIN be ON be.question_id = se.question_id AND be.turn = se.turn AND be.n = se.n)"""


@query("ev1_support", "v_answers v_evidence", SUPPORT + " SELECT question_id, turn, n, score, source FROM su")
def _(spark, d):
    return supported(spark, d).select(*KEY, "n", "score", "source")


@query("ev2_support_status", "v_answers v_evidence", SUPPORT + f""" SELECT question_id, turn, n, CASE WHEN regexp_matches(sentence, {rx(E.TASKS)}) THEN 'skipped' WHEN score >= 0.08 THEN 'supported' WHEN regexp_matches(sentence, {rx(E.FORMULAISH)}) THEN 'formula' ELSE 'missing' END AS status FROM su""")
def _(spark, d):
    return E.support_status(supported(spark, d), formula_mode=True).select(*KEY, "n", "status")


PRUNED = SUPPORT + """, pr AS (SELECT question_id, turn, string_agg(sentence, ' ' ORDER BY n) AS answer, count(*) AS kept FROM (SELECT *, max((status = 'supported')::INT) OVER (PARTITION BY question_id, turn) AS found FROM su) WHERE status = 'supported' OR (found = 0 AND n = 0) GROUP BY ALL)"""


@query("ev3_prune_answers", "v_answers v_evidence", PRUNED + " SELECT question_id, turn, kept, md5(answer) AS digest FROM pr")
def _(spark, d):
    return E.prune_answers(supported(spark, d), KEY).select(*KEY, "kept", F.md5("answer").alias("digest"))


@query("ev4_second_pass", "v_answers v_evidence", PRUNED + f""", sh AS (SELECT question_id, turn FROM pr JOIN v_answers USING (question_id, turn) WHERE length(answer) < greatest(48, floor(length(draft) * 0.4))),
  ml AS (SELECT conv_id AS question_id, turn AS pos, '[more]' AS source, list_distinct({WORDS('text', 0)}) AS w FROM conversations),
  ag AS (SELECT question_id, turn, n, max(round(len(list_intersect(s.w, e.w)) / (len(s.w) + len(e.w) - len(list_intersect(s.w, e.w))), 6)) AS s2 FROM se s SEMI JOIN sh USING (question_id, turn) SEMI JOIN (SELECT * FROM su WHERE status = 'missing') m USING (question_id, turn, n) JOIN ml e USING (question_id) WHERE len(list_intersect(s.w, e.w)) > 0 GROUP BY ALL)
  SELECT su.question_id, su.turn, su.n, CASE WHEN coalesce(s2, 0) > score THEN '[more]' ELSE source END AS source, greatest(score, coalesce(s2, 0)) AS score FROM su LEFT JOIN ag ON ag.question_id = su.question_id AND ag.turn = su.turn AND ag.n = su.n""")
def _(spark, d):
    rows = supported(spark, d)
    more = view(spark, d, "conversations").select(F.col("conv_id").alias("question_id"), F.col("turn").alias("pos"), F.lit("[more]").alias("source"), "text")
    return E.second_pass(rows, E.prune_answers(rows, KEY), view(spark, d, "v_answers"), more, KEY).select(*KEY, "n", "source", "score")


_CHAIN = with_views("v_hits")
_FORMS = f"""v_asked AS ({VIEWS['v_questions']}),
v_questions AS (SELECT question_id * 2 + n AS question_id, trim(question) || CASE n WHEN 1 THEN ' key formulas' ELSE '' END AS question FROM v_asked, (SELECT unnest([0, 1]) AS n) WHERE question_id % 5 = 0)"""
SECOND = _CHAIN.replace(f"v_questions AS ({VIEWS['v_questions']})", _FORMS).replace("e.vec_id = q.question_id", "e.vec_id = q.question_id // 2")


@query("ev4_second_search", "", SECOND + HYBRID.replace("rank <= 5", "rank <= 6") + f" SELECT question_id // 2 AS question_id, (question_id % 2) * 6 + rank AS pos, {TAG} AS source, md5(text) AS digest FROM hy")
def _(spark, d):
    asked = question_vectors(spark, d)
    more = E.second_search(asked.where("question_id % 5 = 0"), asked, view(spark, d, "v_chunks"), chunk_vectors(spark, d), ["question_id"])
    return more.select("question_id", F.col("pos").cast("long").alias("pos"), "source", F.md5("text").alias("digest"))


def given(spark, d):
    rows = view(spark, d, "v_answers")
    tags = F.array(F.concat(F.lit("[conversation "), "question_id", F.lit(" p.0]")), F.lit("[other p.1]"), F.lit(""))
    return rows.select(*KEY, F.posexplode(tags).alias("pos", "citation"))


GIVEN = """, gi AS (SELECT question_id, turn, 0 AS pos, '[conversation ' || question_id || ' p.0]' AS citation FROM v_answers UNION ALL SELECT question_id, turn, 1, '[other p.1]' FROM v_answers)"""


@query("ev5_merge_citations", "v_answers v_evidence", SUPPORT + GIVEN + """, al AS (SELECT question_id, turn, source AS citation, 0 AS kind, n AS pos FROM su WHERE status = 'supported' AND source <> '' UNION ALL SELECT question_id, turn, citation, 1, pos FROM gi)
  SELECT question_id, turn, citation, row_number() OVER (PARTITION BY question_id, turn ORDER BY k, citation) AS place FROM (SELECT question_id, turn, citation, min(kind * 1000000 + pos) AS k FROM al GROUP BY ALL)""")
def _(spark, d):
    rows = E.merge_citations(supported(spark, d), given(spark, d), KEY)
    return rows.select(*KEY, "citation", F.col("place").cast("long").alias("place"))


@query("ev6_citation_guard", "v_answers v_evidence", GIVEN + " SELECT question_id, turn, pos, citation FROM gi g JOIN v_answers USING (question_id, turn) WHERE contains(draft, citation) OR EXISTS (SELECT 1 FROM v_evidence e WHERE e.question_id = g.question_id AND e.source = citation)")
def _(spark, d):
    rows = given(spark, d).where("citation <> ''")
    return E.citation_guard(rows, view(spark, d, "v_answers"), view(spark, d, "v_evidence"), KEY).select(*KEY, "pos", "citation")


@query("ev7_judge_answers", "v_answers", """SELECT question_id, turn, round(CASE WHEN draft = '' THEN 0 WHEN question_id % 3 = 0 THEN 0.3 WHEN question_id % 3 = 1 AND NOT contains(draft, 'the') THEN 0.6 ELSE 0.9 END
  - CASE WHEN draft <> '' AND regexp_matches(lower(draft), '(exercise|prove|show that|find the value)') THEN 0.1 ELSE 0 END, 6)::DOUBLE AS judge FROM v_answers""")
def _(spark, d):
    k = F.col("question_id") % 3
    cites = F.when(k == 0, F.array().cast("array<string>")).when(k == 1, F.array(F.lit("the"))).otherwise(F.array(F.substring("draft", 1, 3)))
    return E.judge_answers(view(spark, d, "v_answers").withColumn("citations", cites)).select(*KEY, "judge")


@query("ev8_self_consistency", "v_answers", """SELECT question_id, turn FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY size DESC, first, length(draft) DESC, turn) AS n FROM
  (SELECT *, count(*) OVER g AS size, min(turn) OVER g AS first FROM v_answers WINDOW g AS (PARTITION BY question_id, length(draft) % 3))) WHERE n = 1""")
def _(spark, d):
    cites = F.array(F.lit("b"), (F.length("draft") % 3).cast("string"), F.lit("b"))
    rows = view(spark, d, "v_answers").withColumns({"pos": F.col("turn"), "citations": cites, "score": F.length("draft")})
    return E.self_consistency(rows, "question_id").select(*KEY)


@query("ev9_excerpts", "v_evidence", """SELECT question_id, n, md5(CASE WHEN length(q) > 220 THEN CASE WHEN contains(substr(q, 1, 220), '.') THEN regexp_extract(substr(q, 1, 220), '^((?s:.)*\\.)', 1) ELSE substr(q, 1, 220) END ELSE q END) AS digest FROM
  (SELECT *, trim(text) AS q, row_number() OVER (PARTITION BY question_id ORDER BY pos) AS n FROM v_evidence WHERE trim(text) <> '') WHERE n <= 5""")
def _(spark, d):
    return E.excerpts(view(spark, d, "v_evidence"), "question_id").select("question_id", F.col("n").cast("long").alias("n"), F.md5("quote").alias("digest"))


@query("ev10_support_report", "v_answers v_evidence", SUPPORT + """ SELECT question_id, turn, count(*) AS total, count_if(status = 'supported')::BIGINT AS n_supported, count_if(status = 'missing')::BIGINT AS n_missing, greatest(1, count_if(status = 'supported'))::BIGINT AS kept,
  CASE WHEN greatest(1, count_if(status = 'supported')) < count(*) THEN 'trimmed' ELSE 'validated' END AS verdict FROM su GROUP BY 1, 2""")
def _(spark, d):
    rows = E.support_report(supported(spark, d), KEY)
    return rows.select(*KEY, "total", "n_supported", "n_missing", F.col("kept").cast("long").alias("kept"), "verdict")


@query("ev10_report_table", "v_answers v_evidence", SUPPORT + """ SELECT question_id, turn, row, CASE WHEN length(s) <= 160 THEN s ELSE rtrim(substr(s, 1, 159)) || '…' END AS sentence, coalesce(nullif(source, ''), '-') AS source, status FROM (SELECT *, trim(sentence) AS s, row_number() OVER (PARTITION BY question_id, turn ORDER BY n) AS row FROM su) WHERE row <= 12""")
def _(spark, d):
    return E.report_table(supported(spark, d), KEY).select(*KEY, F.col("row").cast("long").alias("row"), "sentence", "source", "status")


@query("ev11_resolve_from_table", "v_answers v_evidence", SUPPORT + f""", open AS (SELECT question_id, turn, q, sentence FROM (SELECT *, row_number() OVER (PARTITION BY question_id, turn ORDER BY n) AS q FROM su WHERE score < 0.1) WHERE q <= 2),
  asked AS (SELECT question_id, turn, q, unnest(list_distinct({WORDS('sentence', 4)})) AS t FROM (SELECT * FROM open UNION ALL SELECT question_id, turn, 1, substr(draft, 1, 80) FROM v_answers ANTI JOIN open USING (question_id, turn))),
  te AS (SELECT DISTINCT url, unnest({WORDS("regexp_replace(html, '<[^>]*>', ' ', 'g')", 4)}) AS t FROM pages),
  me AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id, turn, q ORDER BY shared DESC, url) AS n FROM (SELECT question_id, turn, q, url, count(*) AS shared FROM asked JOIN te USING (t) GROUP BY ALL)) WHERE n <= 4),
  fi AS (SELECT question_id, turn, url, min(q) AS q, max(shared) AS shared FROM me GROUP BY ALL)
  SELECT question_id, turn, url, q, shared FROM (SELECT *, count_if(q = 1) OVER (PARTITION BY question_id, turn) AS early FROM fi) WHERE q = 1 OR early < 6""")
def _(spark, d):
    rows = supported(spark, d).withColumn("status", F.when(F.col("score") < 0.1, "weak").otherwise("supported"))
    table = results(spark, d).select("url", F.col("snippet").alias("text"))
    questions = view(spark, d, "v_answers").select(*KEY, F.substring("draft", 1, 80).alias("question"))
    return E.resolve_from_table(rows, table, KEY, questions=questions).select(*KEY, "url", F.col("q").cast("long").alias("q"), "shared")


COST = "greatest(1, length(coalesce(q, '') || coalesce(a, '')) // 4)"


@query("mm1_recent_turns", "v_turns", f"SELECT conv_id, turn, used FROM (SELECT *, sum({COST}) OVER (PARTITION BY conv_id ORDER BY turn DESC)::BIGINT AS used FROM v_turns) WHERE used <= 1200")
def _(spark, d):
    return M.recent_turns(view(spark, d, "v_turns"), 1200).select("conv_id", "turn", "used")


@query("mm2_append_turns", "v_turns", "SELECT conv_id, turn, md5(q || a) AS digest FROM v_turns")
def _(spark, d):
    path = S.scratch(spark, "memory")
    rows = M.pair_turns(view(spark, d, "conversations"))
    M.append_turns(rows.where("conv_id % 2 = 0"), path)
    return M.append_turns(rows.where("conv_id % 2 = 1"), path).select("conv_id", "turn", F.md5(F.concat("q", "a")).alias("digest"))


@query("mm2_clear_turns", "v_turns", "SELECT conv_id, turn FROM v_turns WHERE conv_id % 2 = 1")
def _(spark, d):
    path, rows = S.scratch(spark, "memory"), M.pair_turns(view(spark, d, "conversations"))
    M.append_turns(rows.where("conv_id % 2 = 0"), path)
    M.clear_turns(spark, path)
    return M.append_turns(rows.where("conv_id % 2 = 1"), path).select("conv_id", "turn")


@query("mm3_prune_turns", "v_turns", "SELECT conv_id, turn FROM (SELECT *, sum(strlen(q || a) + 1) OVER (PARTITION BY conv_id ORDER BY turn DESC) - strlen(q || a) - 1 AS before FROM v_turns) WHERE before < 1500")
def _(spark, d):
    return M.prune_turns(view(spark, d, "v_turns"), 1500).select("conv_id", "turn")


@query("mm4_recall", "v_turns", """SELECT conv_id, turn, md5(CASE WHEN turn % 3 = 0 THEN lag(q) OVER w WHEN turn % 3 = 1 THEN lag(a) OVER w END) AS digest FROM v_turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""")
def _(spark, d):
    rows = view(spark, d, "v_turns").withColumns({"was": F.col("q"), "kind": F.col("turn") % 3})
    asks = F.when(F.col("kind") == 0, "What was my last question?").when(F.col("kind") == 1, "repeat your previous answer").otherwise("go on")
    w = Window.partitionBy("conv_id").orderBy("turn")
    found = M.recall(rows.withColumn("q", asks)).withColumn("prev_was", F.lag("was").over(w))
    return found.select("conv_id", "turn", F.md5(F.when(F.col("kind") == 0, F.when(F.col("recalled").isNotNull(), F.col("prev_was"))).otherwise(F.col("recalled"))).alias("digest"))


@query("mm5_memory_chunks", "v_turns", """SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS page_start, md5(concat_ws(chr(10), 'Prev question: ' || nullif(trim(q), ''), 'Prev answer: ' || nullif(trim(a), ''))) AS digest, 0.55::DOUBLE AS score FROM
  (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS k FROM v_turns) WHERE k <= 3""")
def _(spark, d):
    return M.memory_chunks(view(spark, d, "v_turns")).select("conv_id", F.col("page_start").cast("long").alias("page_start"), F.md5("text").alias("digest"), "score")
