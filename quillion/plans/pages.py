"""Queries over pages: sources, quality, chunking, labels."""

from pyspark.sql import functions as F

from quillion.functions import text as T
from quillion.operators import chunking as C
from quillion.operators import labels as L
from quillion.operators import quality as P
from quillion.plans.base import lines, query, rx
from quillion.plans.fixtures import NFKC, view
from quillion.sources import store as S

COLLAPSE = r"trim(regexp_replace(coalesce({}, ''), '\s+', ' ', 'g'))".format


@query("src1_pages", "v_pages", "SELECT doc_name, page, doc_id, length(text) AS n FROM v_pages")
def _(spark, d):
    return S.read_pages(view(spark, d, "documents")).select("doc_name", "page", "doc_id", F.length("text").cast("long").alias("n"))


@query("src2_jsonl_scan", "v_turns", "SELECT conv_id, turn, q, a FROM v_turns")
def _(spark, d):
    path = S.write_jsonl(view(spark, d, "v_turns"), S.scratch(spark, "turns"))
    return S.read_jsonl(spark, path, "conv_id long, turn long, q string, a string")


@query("src3_table_loader", "", "SELECT doc_id, quality, toxic FROM labels")
def _(spark, d):
    path = S.write_csv(view(spark, d, "labels").select("doc_id", "quality", "toxic"), S.scratch(spark, "labels"), sep="\t")
    return S.read_table(spark, path, "doc_id long, quality int, toxic int", kind="tsv")


RESULTS = """SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title,
  regexp_replace(html, '<[^>]*>', ' ', 'g') AS snippet, url FROM pages"""


def results(spark, d):
    html = F.col("html")
    return view(spark, d, "pages").select(
        "page_id", F.regexp_extract(html, "<title>([^<]*)</title>", 1).alias("title"), F.regexp_replace(html, "<[^>]*>", " ").alias("snippet"), "url", F.lit("").alias("source")
    )


@query("src4_web_to_chunks", "", f"""SELECT 'Web:' || coalesce(nullif(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.\\-]*://([^/?#]*)', 1), ''), 'web') AS doc_name,
  url AS web_url, md5(trim(trim(title) || chr(10) || trim(snippet))) AS digest, 0.85::DOUBLE AS score FROM ({RESULTS}) WHERE trim(title) <> '' OR trim(snippet) <> ''""")
def _(spark, d):
    return S.web_to_chunks(results(spark, d)).select("doc_name", "web_url", F.md5("text").alias("digest"), "score")


@query("snk1_append_chunks", "v_chunks", """SELECT row_number() OVER (ORDER BY (rid % 2), rid) - 1 AS new_rid, rid AS src_id, doc_name FROM v_chunks WHERE trim(text) <> ''""")
def _(spark, d):
    rows = view(spark, d, "v_chunks").select(F.col("rid").alias("src_id"), "doc_name", "text")
    path = S.scratch(spark, "store")
    S.append_chunks(rows.where("src_id % 2 = 0"), path, ["src_id"])
    return S.append_chunks(rows.where("src_id % 2 = 1"), path, ["src_id"]).select(F.col("rid").alias("new_rid"), "src_id", "doc_name")


@query("snk2_namespace_key", "", r"""SELECT DISTINCT lang, source, lower(lang) || '_' || regexp_replace(source, '[^a-zA-Z0-9._-]+', '_', 'g') || '_' || substr(sha1(lower(lang) || '|' || source), 1, 8) AS key FROM documents""")
def _(spark, d):
    return view(spark, d, "documents").select("lang", "source").distinct().withColumn("key", S.ns_key(F.col("lang"), F.col("source")))


@query("snk2_reset_ns", "v_chunks", "SELECT 'a' AS ns, 0::BIGINT AS n UNION ALL SELECT 'b', count(*) FROM v_chunks WHERE trim(text) <> '' AND rid % 2 = 1")
def _(spark, d):
    rows, path = view(spark, d, "v_chunks").select("rid", "doc_name", "text"), S.scratch(spark, "store")
    for k, ns in enumerate("ab"):
        S.ensure_ns(spark, path, ns, 64, "m")
        S.append_chunks(rows.where(F.col("rid") % 2 == k).withColumnRenamed("rid", "src"), path, ["src"], ns)
    S.ensure_ns(spark, path, "a", 32, "m")  # another width: emptied
    S.ensure_ns(spark, path, "b", 64, "m")  # the same: kept
    rows = [S.read_store(spark, path, ns).agg(F.lit(ns).alias("ns"), F.count("*").alias("n")) for ns in "ab"]
    return rows[0].unionByName(rows[1])


@query("snk3_jsonl_sink", "", "SELECT quality, toxic, count(*) AS n FROM labels GROUP BY ALL")
def _(spark, d):
    path = S.write_jsonl(view(spark, d, "labels"), S.scratch(spark, "labels"))
    return S.read_jsonl(spark, path, "doc_id long, quality int, toxic int").groupBy("quality", "toxic").agg(F.count("*").alias("n"))


QUALITY = f"""SELECT *, CASE WHEN length(text) = 0 THEN 0.0 ELSE length(regexp_replace(text, '[^\\x00-\\x7F]', '', 'g')) / length(text) END AS ascii_ratio,
  regexp_matches(text, {rx(T.CJK)}) AS has_cjk, regexp_matches(text, {rx(T.PRIVATE_USE)}) AS has_private,
  length(regexp_replace(text, '[^\\p{{L}}]', '', 'g')) AS n_letters, length(regexp_replace(text, '[^\\p{{Nd}}]', '', 'g')) AS n_digits"""
SUSPECT = "length(text) < 10 OR has_cjk OR has_private OR ascii_ratio < 0.55"


@query("pq1_page_quality", "v_pages", f"SELECT doc_id, round(ascii_ratio, 6) AS ascii_ratio, has_cjk, has_private, n_letters, n_digits FROM ({QUALITY} FROM v_pages)")
def _(spark, d):
    q = P.page_quality(view(spark, d, "v_pages"))
    return q.select("doc_id", F.round("ascii_ratio", 6).alias("ascii_ratio"), "has_cjk", "has_private", F.col("n_letters").cast("long").alias("n_letters"), F.col("n_digits").cast("long").alias("n_digits"))


@query("pq2_suspicious", "v_extractions", f"SELECT doc_id, extractor, {SUSPECT} AS suspect FROM ({QUALITY} FROM v_extractions)")
def _(spark, d):
    return P.suspicious(view(spark, d, "v_extractions")).select("doc_id", "extractor", "suspect")


@query("pq3_pick_extraction", "v_extractions", f"""SELECT doc_name, page, extractor, score FROM (SELECT *, row_number() OVER (PARTITION BY doc_name, page ORDER BY score DESC, ord) AS n FROM
  (SELECT *, CASE WHEN text = '' THEN -1e9 WHEN has_cjk THEN -1e6 ELSE round(5 * ascii_ratio + 0.001 * length(text) + 0.0005 * n_letters + 0.0003 * n_digits, 6) END AS score FROM ({QUALITY} FROM v_extractions))) WHERE n = 1""")
def _(spark, d):
    return P.pick_extraction(view(spark, d, "v_extractions")).select("doc_name", "page", "extractor", "score")


@query("pq4_repair_glyphs", "v_lines", "SELECT doc_name, page, pos, CASE WHEN pos % 5 < 4 THEN replace(line, 'e', '<e>') ELSE replace(line, 'e', '\ue001') END AS text FROM v_lines")
def _(spark, d):
    spans = lines(spark, d).select("doc_name", "page", "pos", F.when(F.col("pos") % 5 < 4, "Odd").otherwise("Plain").alias("font"), F.translate("line", "eo", "\ue001\uff4f").alias("text"))
    font_map = spark.createDataFrame([("odd", 0xE001, "<e>"), ("ODD", 0xE002, "?"), ("other", 0xE001, "!")], "font string, code int, repl string")
    return P.repair_glyphs(spans, font_map).select("doc_name", "page", "pos", "text")


@query("pq5_parse_report", "v_pages v_chunks", f"""SELECT doc_name, count(*) AS n_pages, count_if(suspect)::BIGINT AS n_suspect,
  coalesce(string_agg(page::VARCHAR, ',' ORDER BY page) FILTER (suspect), '') AS suspect_pages, count_if(length(text) < 10)::BIGINT AS n_short, min(nc) AS n_chunks
  FROM (SELECT *, {SUSPECT} AS suspect FROM ({QUALITY} FROM v_pages)) JOIN (SELECT doc_name, count(*) AS nc FROM v_chunks GROUP BY 1) USING (doc_name) GROUP BY 1""")
def _(spark, d):
    return P.parse_report(view(spark, d, "v_pages"), view(spark, d, "v_chunks"))


COMPATIBLE = "text || CASE WHEN ord = 1 AND doc_id % 5 = 0 THEN ' ㍿' WHEN ord = 1 AND doc_id % 7 = 0 THEN '\uffa1' ELSE '' END"


@query("pq6_language_gate", "v_extractions", f"""SELECT doc_id, extractor FROM (SELECT *, max(good::INT) OVER (PARTITION BY doc_name) AS has_good FROM
  (SELECT *, trim(text) <> '' AND NOT regexp_matches({NFKC(COMPATIBLE)}, {rx(T.CJK)}) AS good FROM v_extractions)) WHERE good OR has_good = 0""")
def _(spark, d):
    return P.language_gate(view(spark, d, "v_extractions").withColumn("text", F.expr(COMPATIBLE)), "doc_name").select("doc_id", "extractor")


NORMAL = (
    r"regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(replace(replace(replace(text, ' ', ' '), '­', ''), 'ﬁ', 'fi'), 'ﬂ', 'fl'), "
    r"'[ \t]+', ' ', 'g'), '\s+\n', chr(10), 'g'), '\n\s+', chr(10), 'g'), '^\s+|\s+$', '', 'g')"
)


@query("ch1_normalize", "v_pages", f"SELECT doc_id, md5({NORMAL}) AS digest FROM v_pages")
def _(spark, d):
    return view(spark, d, "v_pages").select("doc_id", F.md5(T.normalize_text("text")).alias("digest"))


REPEATS = """SELECT doc_name, side, line, n, n_pages FROM (SELECT doc_name, side, line, count(*) AS n FROM (
    SELECT doc_name, 'head' AS side, unnest(l[1:3]) AS line FROM t UNION ALL SELECT doc_name, 'foot', unnest(l[greatest(1, len(l)-2):]) FROM t) GROUP BY 1, 2, 3)
  JOIN (SELECT doc_name, count(*) AS n_pages FROM t GROUP BY 1) USING (doc_name) WHERE n / n_pages >= 0.6"""
TRIMMED = "t AS (SELECT doc_name, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') AS l FROM v_headed)"


@query("ch2_repeat_lines", "v_headed", f", {TRIMMED} {REPEATS}")
def _(spark, d):
    return C.repeat_lines(view(spark, d, "v_headed"))


@query("ch3_drop_repeat_lines", "v_lines", f", {TRIMMED}, r AS ({REPEATS}) SELECT doc_name, page, pos, md5(line) AS digest FROM v_lines v WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.doc_name = v.doc_name AND r.line = v.line)")
def _(spark, d):
    kept = C.drop_repeat_lines(lines(spark, d), C.repeat_lines(view(spark, d, "v_headed")))
    return kept.select("doc_name", "page", "pos", F.md5("line").alias("digest"))


def blocks(spark, d):
    odd = F.col("pos") % 2
    return lines(spark, d).select(
        "doc_name", "page", "pos", F.col("line").alias("text"), F.when(odd == 0, 40.0).otherwise(340.0).alias("x0"), (12.0 * F.col("pos")).alias("y0"),
        F.when(F.col("pos") % 5 == 0, "cmmi").otherwise("times").alias("font"),
    )


@query("ch4_reading_order", "v_lines", """SELECT doc_name, page, pos, row_number() OVER (PARTITION BY doc_name, page ORDER BY (pos % 2), pos) AS rank FROM v_lines""")
def _(spark, d):
    return C.reading_order(blocks(spark, d)).select("doc_name", "page", "pos", F.col("rank").cast("long").alias("rank"))


@query("ch5_mathiness", "v_lines", f"""SELECT doc_name, page, pos, round(0.6 * (pos % 5 = 0)::INT + 0.4 * least(1.0, 8 * len(regexp_extract_all(line, {rx(T.OPERATORS)})) / greatest(1, length(line))), 6) AS mathiness FROM v_lines""")
def _(spark, d):
    return C.mathiness(blocks(spark, d)).select("doc_name", "page", "pos", F.round("mathiness", 6).alias("mathiness"))


SEGMENTS = f""", k AS (SELECT *, CASE WHEN regexp_matches(line, {rx(T.HEADING)}) THEN 'heading' WHEN regexp_matches(line, {rx(T.BULLET)}) THEN 'bullet' WHEN trim(line) = '' THEN 'blank' ELSE 'para' END AS kind FROM v_lines),
  s AS (SELECT *, sum((kind <> 'para' OR before <> 'para')::INT) OVER (PARTITION BY doc_name, page ORDER BY pos) AS segment FROM
    (SELECT *, lag(kind, 1, 'blank') OVER (PARTITION BY doc_name, page ORDER BY pos) AS before FROM k)),
  g AS (SELECT doc_name, page, segment, kind, string_agg(trim(line), ' ' ORDER BY pos) AS text, min(pos) AS pos FROM s WHERE kind <> 'blank' GROUP BY ALL)"""


@query("ch6_segment_lines", "v_lines", SEGMENTS + " SELECT doc_name, page, pos, kind, md5(text) AS digest FROM g")
def _(spark, d):
    return C.segment_lines(lines(spark, d)).select("doc_name", "page", "pos", "kind", F.md5("text").alias("digest"))


@query("ch7_heading_path", "v_lines", SEGMENTS + " SELECT doc_name, page, pos, coalesce(last_value(CASE WHEN kind = 'heading' THEN text END IGNORE NULLS) OVER (PARTITION BY doc_name, page ORDER BY pos ROWS UNBOUNDED PRECEDING), '') AS heading_path FROM g")
def _(spark, d):
    return C.heading_path(C.segment_lines(lines(spark, d))).select("doc_name", "page", "pos", "heading_path")


@query("ch8_section_tag", "v_chunks", f"SELECT rid, CASE WHEN regexp_matches(heading_path, {rx(T.EXERCISE_HEADING)}) THEN 'exercises' ELSE '' END AS section_tag FROM v_chunks")
def _(spark, d):
    return C.section_tag(view(spark, d, "v_chunks")).select("rid", "section_tag")


def split_sql(variant: str, table: str, key: str, col: str = "text") -> str:
    marked = f"regexp_replace({COLLAPSE(col)}, {rx(T.SENTENCE_ENDS[variant])}, '\\1' || chr(1) || '\\2', 'g')"
    return f"""SELECT {key}, CAST(unnest(generate_series(0, len(l) - 1)) AS INT) AS pos, unnest(l) AS sentence FROM
  (SELECT {key}, list_filter(list_transform(string_split({marked}, chr(1)), lambda x: trim(x)), lambda x: x <> '') AS l FROM {table})"""


def _sentences(variant):
    @query(f"ch9_sentences_{variant}", "v_pages", f"SELECT doc_id, pos, md5(sentence) AS digest FROM ({split_sql(variant, 'v_pages', 'doc_id')})")
    def _(spark, d):
        return C.split_sentences(view(spark, d, "v_pages").select("doc_id", "text"), variant).select("doc_id", "pos", F.md5("sentence").alias("digest"))


for v in "abc":
    _sentences(v)


@query("ch10_dehyphenate", "v_lines", """, h AS (SELECT doc_name, page, pos, CASE WHEN pos % 3 = 0 THEN line || '-' WHEN pos % 3 = 1 THEN lower(line) ELSE line END AS line FROM v_lines),
  w AS (SELECT *, lead(line) OVER p AS following, lag(line) OVER p AS before FROM h WINDOW p AS (PARTITION BY doc_name, page ORDER BY pos)),
  f AS (SELECT *, ends_with(line, '-') AND regexp_matches(coalesce(following, ''), '^[a-zß-öø-ÿ]') AS glues, ends_with(coalesce(before, ''), '-') AND regexp_matches(line, '^[a-zß-öø-ÿ]') AS taken FROM w)
  SELECT doc_name, page, pos, md5(CASE WHEN glues THEN left(line, length(line) - 1) || following ELSE line END) AS digest FROM f WHERE NOT taken OR glues""")
def _(spark, d):
    line = F.when(F.col("pos") % 3 == 0, F.concat("line", F.lit("-"))).when(F.col("pos") % 3 == 1, F.lower("line")).otherwise(F.col("line"))
    return C.dehyphenate(lines(spark, d).withColumn("line", line), ["doc_name", "page"]).select("doc_name", "page", "pos", F.md5("joined").alias("digest"))


@query("ch11_doc_budget", "v_pages", f"""SELECT doc_name, n_pages, n_chars, CASE WHEN n_pages <= 2 AND n_chars < 6000 THEN 520 ELSE 750 END AS target, CASE WHEN n_pages <= 2 AND n_chars < 6000 THEN 70 ELSE 90 END AS overlap
  FROM (SELECT doc_name, count(*) AS n_pages, sum(length({NORMAL}))::BIGINT AS n_chars FROM v_pages GROUP BY 1)""")
def _(spark, d):
    return C.doc_budget(view(spark, d, "v_pages"))


#: Chunking as a recursion over the pieces of each page: what is held (``rest`` and the ``last`` part,
#: its size, start and flags), and what a piece made it give up.
CHUNKED = f""", n AS MATERIALIZED (SELECT doc_name, page, {NORMAL} AS text FROM v_headed), {TRIMMED.replace("v_headed", "n")}, re AS ({REPEATS}),
  bu AS (SELECT doc_name, CASE WHEN count(*) <= 2 AND sum(length(text)) < 6000 THEN 520 ELSE 750 END AS target, CASE WHEN count(*) <= 2 AND sum(length(text)) < 6000 THEN 70 ELSE 90 END AS overlap FROM n GROUP BY 1),
  li AS (SELECT doc_name, page, CAST(unnest(generate_series(0, len(l) - 1)) AS INT) AS pos, unnest(l) AS line FROM (SELECT *, string_split(text, chr(10)) AS l FROM n)),
  ki AS (SELECT *, CASE WHEN regexp_matches(line, {rx(T.HEADING)}) THEN 'heading' WHEN regexp_matches(line, {rx(T.BULLET)}) THEN 'bullet' WHEN trim(line) = '' THEN 'blank' ELSE 'para' END AS kind
    FROM li WHERE NOT EXISTS (SELECT 1 FROM re WHERE re.doc_name = li.doc_name AND re.line = li.line)),
  sg AS (SELECT *, sum((kind <> 'para' OR before <> 'para')::INT) OVER (PARTITION BY doc_name, page ORDER BY pos) AS segment FROM (SELECT *, lag(kind, 1, 'blank') OVER (PARTITION BY doc_name, page ORDER BY pos) AS before FROM ki)),
  se AS (SELECT doc_name, page, segment, kind, trim(string_agg(trim(line), ' ' ORDER BY pos)) AS text FROM sg WHERE kind <> 'blank' GROUP BY ALL),
  un AS (SELECT doc_name, page, segment, kind, CAST(unnest(generate_series(0, len(l) - 1)) AS INT) AS k, unnest(l) AS piece FROM (SELECT *, CASE WHEN kind = 'para' AND length(text) > 20
    THEN list_filter(list_transform(string_split(regexp_replace({COLLAPSE("text")}, {rx(T.SENTENCE_ENDS["a"])}, '\\1' || chr(1) || '\\2', 'g'), chr(1)), lambda x: trim(x)), lambda x: x <> '') ELSE [text] END AS l FROM se)),
  pc AS MATERIALIZED (SELECT doc_name, page, kind, piece, row_number() OVER (PARTITION BY doc_name, page ORDER BY segment, k) AS i FROM un UNION ALL SELECT doc_name, page, 'end', '', 1 + (SELECT count(*) FROM un WHERE un.doc_name = n.doc_name AND un.page = n.page) FROM n),
  mp AS ({{math}}),
  ru AS (SELECT doc_name, page, target, overlap, EXISTS (SELECT 1 FROM mp WHERE mp.doc_name = n.doc_name AND mp.page = n.page) AS math_page, 0::BIGINT AS i, NULL::VARCHAR AS rest, NULL::VARCHAR AS last, 0::BIGINT AS size, 0::BIGINT AS start, 0::BIGINT AS spot, '' AS heading,
      false AS m, false AS t, false AS e, NULL::VARCHAR AS text, '' AS heading_path, 0::BIGINT AS char_start, 0::BIGINT AS char_end, false AS has_math, false AS has_table, false AS is_equation FROM n JOIN bu USING (doc_name)
    UNION ALL SELECT doc_name, page, target, overlap, math_page, i, CASE WHEN fills THEN CASE WHEN full_ THEN tail ELSE held END END, CASE WHEN fills THEN whole END, CASE WHEN fills THEN CASE WHEN full_ THEN greatest(1, length(tail) // 4) ELSE had END + greatest(1, length(whole) // 4) ELSE 0 END,
      CASE WHEN NOT fills OR held IS NULL THEN spot WHEN full_ THEN greatest(0, spot - length(tail)) ELSE start END, spot + CASE WHEN kind = 'end' THEN 0 ELSE length(piece) + 1 END, CASE WHEN kind = 'heading' THEN piece ELSE heading END,
      (fills AND NOT full_ AND m) OR (fills AND regexp_matches(whole, {rx(T.MATH)})), (fills AND NOT full_ AND t) OR (fills AND (regexp_matches(whole, {rx(T.TABLE_HINT)}) OR (contains(whole, '|') AND length(whole) > 10))),
      (fills AND NOT full_ AND e) OR (fills AND math_page AND regexp_matches(whole, {rx(T.OPERATORS)}) AND len(regexp_extract_all(whole, '[A-Za-z]{{3,}}')) <= 40),
      CASE WHEN full_ THEN trim(held) END, heading, start, spot, m, t, e FROM (SELECT *, right(held, 4 * overlap) AS tail FROM (
        SELECT *, held IS NOT NULL AND CASE kind WHEN 'bullet' THEN had > 0.8 * target WHEN 'para' THEN had + greatest(1, length(whole) // 4) > target ELSE true END AS full_ FROM (
          SELECT *, kind IN ('bullet', 'para') AS fills, CASE WHEN pops THEN rest WHEN rest IS NULL THEN last ELSE rest || ' ' || last END AS held, CASE WHEN pops THEN greatest(1, length(coalesce(rest, '')) // 4) ELSE size END AS had,
            CASE WHEN NOT pops THEN piece WHEN regexp_matches(piece, '^[a-zß-öø-ÿ]') THEN left(last, length(last) - 1) || piece ELSE last || ' ' || piece END AS whole FROM (
            SELECT ru.* EXCLUDE (i, text, heading_path, char_start, char_end, has_math, has_table, is_equation), pc.i, pc.kind, pc.piece, pc.kind = 'para' AND coalesce(ends_with(ru.last, '-'), false) AS pops
            FROM ru JOIN pc ON pc.doc_name = ru.doc_name AND pc.page = ru.page AND pc.i = ru.i + 1))))),
  ck AS (SELECT doc_name, page AS page_start, page AS page_end, CAST(row_number() OVER (PARTITION BY doc_name, page ORDER BY i) AS INT) AS n, text, heading_path, CASE WHEN regexp_matches(lower(heading_path), {rx(T.EXERCISE_HEADING)}) THEN 'exercises' ELSE '' END AS section_tag,
    has_math, has_table, is_equation, char_start::INT AS char_start, char_end::INT AS char_end FROM ru WHERE text <> '')"""
MATH_PAGES = "SELECT DISTINCT doc_name, page FROM v_lines WHERE page % 2 = 0 AND pos % 5 = 0 AND length(line) <= 220"


@query("ch12_chunk_pages", "v_lines", CHUNKED.replace("{math}", MATH_PAGES) + " SELECT * FROM ck")
def _(spark, d):
    return C.chunk_pages(view(spark, d, "v_headed"), blocks(spark, d).withColumn("font", F.when(F.col("page") % 2 == 0, F.col("font")).otherwise("times")))


@query("ch13_pack", "v_pages", """, s AS (SELECT doc_name, page, length(text) AS n FROM v_pages), r AS (
  SELECT doc_name, page, n AS used, 0 AS batch FROM s WHERE page = 1 UNION ALL
  SELECT s.doc_name, s.page, CASE WHEN r.used + s.n > 12000 AND r.used > 0 THEN s.n ELSE r.used + s.n END, r.batch + (r.used + s.n > 12000 AND r.used > 0)::INT
  FROM r JOIN s ON s.doc_name = r.doc_name AND s.page = r.page + 1) SELECT doc_name, page, batch FROM r""")
def _(spark, d):
    rows = view(spark, d, "v_pages").select("doc_name", "page", F.length("text").alias("n"))
    return C.pack(rows, ["doc_name"], "page", "n", 12000).select("doc_name", "page", "batch")


@query("ch14_chunk_flags", "v_lines", f"""SELECT doc_name, page, pos, regexp_matches(line, {rx(T.MATH)}) AS has_math, regexp_matches(line, {rx(T.TABLE_HINT)}) OR (contains(line, '|') AND length(line) > 10) AS has_table,
  len(regexp_extract_all(line, {rx(T.OPERATORS)})) AS n_ops, page % 2 = 0 AND len(regexp_extract_all(line, {rx(T.OPERATORS)})) >= 1 AND len(regexp_extract_all(line, '[A-Za-z]{{3,}}')) <= 40 AS is_equation, char_end - length(line) - 1 AS char_start, char_end FROM (SELECT *, sum(length(line) + 1) OVER (PARTITION BY doc_name, page ORDER BY pos)::BIGINT AS char_end FROM v_lines)""")
def _(spark, d):
    rows = lines(spark, d).withColumnRenamed("line", "text").withColumn("math_page", F.col("page") % 2 == 0)
    return C.chunk_flags(rows).select("is_equation", "doc_name", "page", "pos", "has_math", "has_table", F.col("n_ops").cast("long").alias("n_ops"), "char_start", "char_end")


VETO = f"t = '' OR contains(lower(t), 'isbn') OR regexp_matches(t, {rx(L.ISBN13)}) OR regexp_matches(t, {rx(L.ISBN10)}) OR NOT regexp_matches(t, {rx(L.MATH_TOKENS)})"


@query("lb1_formula_veto", "v_chunks", f"SELECT rid, {VETO} AS veto FROM (SELECT rid, {COLLAPSE('text')} AS t FROM v_chunks)")
def _(spark, d):
    return view(spark, d, "v_chunks").select("rid", L.formula_veto("text").alias("veto"))


def surface(t):
    """A stand-in scorer: the share of four signs of mathematics that a text has."""
    return sum(F.contains(t, F.lit(x)).cast("double") for x in "=^+(") / 4


P_SQL = "((contains(t, '=')::INT + contains(t, '^')::INT + contains(t, '+')::INT + contains(t, '(')::INT) / 4.0)"


@query("lb2_label_formulas", "v_chunks", f"""SELECT rid, p >= 0.5 AND NOT ({VETO}) AS is_formula, CASE WHEN p >= 0.5 THEN p ELSE 1 - p END::DOUBLE AS formula_confidence FROM
  (SELECT *, {P_SQL} AS p FROM (SELECT rid, substr({COLLAPSE('text')}, 1, 4000) AS t FROM v_chunks))""")
def _(spark, d):
    rows = view(spark, d, "v_chunks").select("rid", "text")
    return L.label_formulas(rows, surface, "surface").select("rid", "is_formula", "formula_confidence")


@query("lb2_label_formulas_no_model", "v_chunks", "SELECT rid, 'NOT_FORMULA' AS formula_label, 0.5::DOUBLE AS formula_confidence, 'disabled' AS formula_model FROM v_chunks")
def _(spark, d):
    return L.label_formulas(view(spark, d, "v_chunks").select("rid", "text")).select("rid", "formula_label", "formula_confidence", "formula_model")


@query("lb3_refresh_labels", "v_chunks", """SELECT rid, CASE WHEN rid % 2 = 0 THEN is_formula ELSE false END AS is_formula, 'disabled' AS formula_model FROM v_chunks""")
def _(spark, d):
    tag = F.when(F.col("rid") % 2 == 0, "disabled").otherwise("other")
    rows = view(spark, d, "v_chunks").select("rid", "text", "is_formula").withColumn("formula_model", tag)
    return L.refresh_labels(rows, "disabled").select("rid", "is_formula", "formula_model")


@query("lb4_label_semantics")
def _(spark, d):
    from quillion.operators.training import train_classifier

    chunks = view(spark, d, "v_chunks")
    model = train_classifier(L.weak_label(chunks))
    return L.label_semantics(chunks.select("rid", "text"), model).select("rid", "semantic_label", "semantic_confidence")


WEAK = f"""SELECT rid, page_start AS page, CASE WHEN regexp_matches(h, {rx(L.THEOREM_HEADING)}) THEN 'theorem' WHEN regexp_matches(h, {rx(L.RULE_WORDS)}) THEN 'rule'
  WHEN starts_with(h, 'definition') OR regexp_matches(t, {rx(L.DEFINITION_TEXT)}) THEN 'definition' WHEN regexp_matches(h, {rx(L.EXAMPLE_HEADING)}) OR starts_with(lower(t), 'example') THEN 'example'
  WHEN section_tag = 'exercises' OR regexp_matches(h, {rx(L.EXERCISE_WORDS)}) OR regexp_matches(t, {rx(L.EXERCISE_WORDS)}) THEN 'exercise'
  WHEN is_equation AND has_math AND regexp_matches(lower(t), {rx(L.RULE_WORDS)}) THEN 'rule' WHEN is_formula AND formula_confidence >= 0.8 THEN 'rule' END AS label
  FROM (SELECT *, trim(text) AS t, lower(heading_path) AS h FROM v_chunks) WHERE length(t) >= 60"""


@query("lb5_weak_label", "v_chunks", f"SELECT * FROM ({WEAK}) WHERE label IS NOT NULL")
def _(spark, d):
    return L.weak_label(view(spark, d, "v_chunks")).select("rid", "page", "label")


@query("lb6_label_sample", "v_chunks", "SELECT rid, '' AS label FROM v_chunks WHERE has_math ORDER BY md5('11-' || rid), rid LIMIT 500")
def _(spark, d):
    return L.label_sample(view(spark, d, "v_chunks"), keep_math=True).select("rid", "label")
