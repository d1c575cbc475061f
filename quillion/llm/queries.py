"""The queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import collocations, decontaminate, divergence, embeddings, line_dedup, packing, quality, simhash, suffix_dedup, token_counts, token_files, toxicity, warc
from .common import bounded_batches, held_out
from .tokens import public_path

WORD_BPE, WORD_BPE_SIZE = "word_bpe_49k.json", 49_408


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bounded_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = quality.fit_quality(docs, _table(spark, sf_dir, "labels"))
    scored = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), quality.quality_score(F.col("text"), model).alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= 0.3, 1).otherwise(0))


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    rows = docs.select("doc_id", simhash.simhash(F.col("text"), 3).alias("fp"))
    found = simhash.simhash_components(rows, "doc_id", "fp", bits=2)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    written = token_files.write_token_files(docs, public_path(WORD_BPE), 2, WORD_BPE_SIZE)
    return token_files.read_token_digests(written)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    counted = token_counts.token_counts(F.col("text"), public_path("piece_bpe_32k.model"))
    return docs.select("doc_id", counted.alias("c")).select("doc_id", "c.n_words", "c.n_tokens")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.fit_toxicity(docs, _table(spark, sf_dir, "labels"))
    scored = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), toxicity.toxicity_score(F.col("text"), model).alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))


def op6_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, bench = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")
    found = decontaminate.contamination(docs.select("doc_id", "text"), bench)
    hit = decontaminate.span_words(F.col("spans"))
    return found.select("doc_id", "n_words", hit.alias("n_hit"), "items").select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        decontaminate.items_digest(F.col("items")).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
    )


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = warc.write_warc(_table(spark, sf_dir, "pages"))
    return warc.warc_digests(warc.read_warc(spark, path))


def op7_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = embeddings.embedding_duplicates(_table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
    return found.select("vec_id", "n_links", "component_id", "kept")


def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    packed = packing.pack_documents(docs, public_path(WORD_BPE), 0, 2048)
    return packed.withColumnRenamed("id", "doc_id")


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.repeated_spans(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    digest = suffix_dedup.span_digest(F.col("text"), F.col("spans"))
    return found.select("doc_id", digest.alias("d")).select("doc_id", "d.n_bytes", "d.n_removed", "d.n_spans", "d.kept_sha256")


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.line_dedup(_table(spark, sf_dir, "documents").select("doc_id", "text"), min_chars=20, min_docs=3)
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text"), 256).alias("kept_sha256"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_divergence(_table(spark, sf_dir, "documents"), min_docs=30, top=50)


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(_table(spark, sf_dir, "documents"), least=30, cover=80, top=2000)


A_TO_Z = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

LINE_SQL = f"""
with d as (select row_number() over () as row_id, doc_id, string_split(coalesce(text, ''), chr(10)) as parts from documents),
l as (select row_id, doc_id, unnest(parts) as line, generate_subscripts(parts, 1) as pos from d),
k as (select *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), {A_TO_Z}) as key from l),
f as (select key, max(doc_id) as last from k where length(key) >= 20 group by key having count(distinct doc_id) >= 3),
m as (select k.*, f.key is not null and k.doc_id <> f.last as gone from k left join f on k.key = f.key)
select any_value(doc_id) as doc_id, count(*) as n_lines, count(*) filter (where gone) as n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where not gone), '')) as kept_sha256
from m group by row_id
"""

DIVERGENCE_SQL = f"""
with d as (select row_number() over () as row_id, coalesce(lang, '') as lang, coalesce(source, '') as source, coalesce(text, '') as text from documents),
t as (select row_id, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), {A_TO_Z}) as term from d),
k as (select lang, term from t group by lang, term having count(distinct row_id) >= 30),
v as (select lang, count(*) as v from k group by lang),
g as (select distinct lang, source from d),
c as (select lang, source, term, count(*) as n from t semi join k using (lang, term) group by lang, source, term),
gp as (select g.lang, g.source, k.term, coalesce(c.n, 0) as n from g join k using (lang) left join c on c.lang = g.lang and c.source = g.source and c.term = k.term),
p as (select lang, source, term, n, 1 + cast(1000000000 as hugeint) * (n + 5) // (sum(n) over (partition by lang, source) + 5 * v) as p from gp join v using (lang)),
w as (select lang, term, sum(n) as n from gp group by lang, term),
q as (select lang, term, 1 + cast(1000000000 as hugeint) * (n + 5) // (sum(n) over (partition by lang) + 5 * v) as q from w join v using (lang)),
pair as (select a.lang, a.source, b.source as item, sum(abs(a.p - b.p)) as value from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
every as (select a.lang, a.source, 'pair' as part, b.source as item, coalesce(value, 0) as value
  from g a join g b on a.lang = b.lang and a.source <> b.source left join pair on pair.lang = a.lang and pair.source = a.source and pair.item = b.source),
term as (select lang, source, 'term' as part, term as item, p - q as value from p join q using (lang, term) where n > 0 and p > q),
r as (select *, row_number() over (partition by lang, source, part order by value desc, encode(item)) as rank from (select * from every union all select * from term))
select lang, source, part, item, cast(value as bigint) as value, cast(rank as integer) as rank from r where part = 'pair' or rank <= 50
"""

PHRASE_SQL = f"""
with d as (select coalesce(lang, 'und') as lang, translate(coalesce(text, ''), {A_TO_Z}) as text from documents),
p as (select row_number() over () as piece, lang, part from (select lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) as part from d)),
w as (select piece, lang, regexp_extract_all(part, '[^\x20\x09]+') as words from p),
o as (select piece, lang, unnest(words) as word, generate_subscripts(words, 1) as pos from w),
s as (select lang, piece, pos, word as w1, lead(word, 1) over f as w2, lead(word, 2) over f as w3, lead(word, 3) over f as w4 from o window f as (partition by piece order by pos)),
n as (select lang, count(*) as n from o group by lang),
f as (
  select lang, 1 as size, w1, null as w2, null as w3, null as w4, count(*) as n from s group by lang, w1 having count(*) >= 30
  union all select lang, 2, w1, w2, null, null, count(*) from s where w2 is not null group by lang, w1, w2 having count(*) >= 30
  union all select lang, 3, w1, w2, w3, null, count(*) from s where w3 is not null group by lang, w1, w2, w3 having count(*) >= 30
  union all select lang, 4, w1, w2, w3, w4, count(*) from s where w4 is not null group by lang, w1, w2, w3, w4 having count(*) >= 30),
x as (select lang, list_slice([w1, w2, w3, w4], 1, size) as ws, size, n from f),
c as (select lang, ws, n as a, k, ws[1:k] as first, ws[k + 1:size] as rest from x, (select unnest([1, 2, 3]) as k) where k < size),
z as (select c.lang, c.ws, c.a, c.k, l.n as l, r.n as r, cast(2000000 as hugeint) * c.a // (l.n + r.n) as score
  from c join x l on l.lang = c.lang and l.ws = c.first join x r on r.lang = c.lang and r.ws = c.rest),
b as (select * from z qualify row_number() over (partition by lang, ws order by score, k) = 1),
i as (select distinct lang, ws[j:j + m - 1] as ws, n, ws as longer from x, (select unnest([1, 2, 3]) as j), (select unnest([2, 3]) as m) where m < size and j + m - 1 <= size),
e as (select lang, ws, max(n) as around from i group by lang, ws),
h as (select b.*, array_to_string(b.ws, ' ') as phrase from b left join e on e.lang = b.lang and e.ws = b.ws where around is null or 100 * cast(around as hugeint) < 80 * cast(a as hugeint)),
y as (select *, row_number() over (partition by lang order by score desc, a desc, encode(phrase)) as rank from h)
select y.lang, cast(rank as bigint) as rank, phrase, a, l, r, n.n, cast(score as bigint) as score from y join n on n.lang = y.lang where rank <= 2000
"""


def queries() -> dict:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {"op11_line_dedup": LINE_SQL, "op12_source_divergence": DIVERGENCE_SQL, "op13_collocations": PHRASE_SQL}
