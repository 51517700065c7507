"""Queries over the given tables, one per operator, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from priceatlas.llm import language_id, toxicity
from priceatlas.llm.agenda import encode_documents
from priceatlas.llm.audio_match import fingerprints, match, melodies
from priceatlas.llm.chat_format import events_of, format_chats, read_back
from priceatlas.llm.divergence import divergence
from priceatlas.llm.html_extract import extract_main_text
from priceatlas.llm.near_dedup import near_duplicates
from priceatlas.llm.pack import pack_documents
from priceatlas.llm.shard import balanced_shards
from priceatlas.llm.source_mix import poisson_mix
from priceatlas.llm.topk import exact_topk
from priceatlas.llm.whitening import whiten


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_site_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract_main_text(table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op2_poisson_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources at the square root of their size, as many rows out as in on average; globally shuffled."""
    mixed = poisson_mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "source", F.col("__replica").alias("replica"), F.col("__replicas").alias("replicas"), F.col("__order").alias("shuffle_key"))


OP2_SQL = """
WITH n AS (SELECT coalesce('=' || source, '') AS k, count(*) AS n FROM documents GROUP BY 1),
r AS (SELECT k, sqrt(n) / sum(sqrt(n)) OVER () * sum(n) OVER () / n AS rate FROM n),
p AS (SELECT k, rate, CAST(greatest(1, ceil(rate / 16.0)) AS INTEGER) AS parts FROM r),
pmf AS (SELECT k, parts, i, exp(-rate / parts + i * ln(rate / parts) - lgamma(i + 1)) AS p FROM p, range(0, 81) t(i)),
cdf AS (SELECT k, parts, i, sum(p) OVER (PARTITION BY k ORDER BY i) AS c FROM pmf),
u AS (SELECT rowid_, doc_id, source, p.k, j, CAST('0x' || substr(md5('17|' || j || '|' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13) AS BIGINT) / 4503599627370496.0 AS u
      FROM (SELECT *, row_number() OVER () AS rowid_ FROM documents) d JOIN p ON p.k = coalesce('=' || source, ''), LATERAL (SELECT unnest(range(1, p.parts + 1)) AS j)),
c AS (SELECT rowid_, doc_id, source, count(cdf.i) AS replicas FROM u JOIN cdf ON cdf.k = u.k AND cdf.c <= u.u GROUP BY 1, 2, 3),
x AS (SELECT doc_id, source, CAST(replicas AS INTEGER) AS replicas, CAST(unnest(range(1, replicas + 1)) AS INTEGER) AS replica FROM c)
SELECT doc_id, source, replica, replicas, CAST('0x' || substr(md5('17|order|' || coalesce(CAST(doc_id AS VARCHAR), 'null') || '|' || replica), 1, 13) AS BIGINT) AS shuffle_key FROM x
"""

#: The conversation that op3 formats beside the table's: its text holds a heading, a marker and a backslash.
CONTROL = "\\### Assistant: </turn> ok"


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    role = F.when(F.col("id") == 0, "user").otherwise("assistant")
    more = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.lit(CONTROL).alias("text"))
    read = read_back(format_chats(events_of(turns.unionByName(more))))
    all_turns = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    loss = F.array_join("loss", "")
    return read.select(
        "conv_id", "n_turns",
        F.sha2(all_turns, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


_ESC = "replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"
OP3_SQL = f"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, i, CASE i WHEN 0 THEN 'user' ELSE 'assistant' END, '\\### Assistant: </turn> ok' FROM range(0, 2) r(i))
SELECT conv_id, CAST(count(*) AS BIGINT) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length({_ESC.format('role')}) + length({_ESC.format('text')}) + 16) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""


def op4_balanced_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = balanced_shards(table(spark, sf_dir, "documents"))
    return placed.select(F.col("id").alias("doc_id"), "size", "text_crc32", "law", "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "linked")


def op5_vector_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"), with_ids=False)


def fold(folds: int, id_col: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo folds; a null id is in no fold."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % folds


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fitted on labels outside the held-out third; 0.7 is the threshold of predicted."""
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), fold(3) != 1)
    scored = toxicity.score(docs, model, ["doc_id"])
    return scored.select("doc_id", F.coalesce(fold(3) == 1, F.lit(False)).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.7).cast("int").alias("predicted"))


def op7_lsh_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=4).select(F.col("id").alias("doc_id"), "n_shingles", "component_id", "kept")


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = language_id.identify(docs, language_id.fit(docs, fold(5) != 0), ["doc_id"])
    return found.select("doc_id", F.coalesce(fold(5) == 0, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op9_audio_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables hold no media, so each vector is rendered as a recording; queries are the rows whose id is divisible by 50."""
    return match(fingerprints(melodies(table(spark, sf_dir, "embeddings"), "vec_id", "embedding")), F.col("id") % 50 == 0)


def op10_norm_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_topk(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0)


OP10_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM (SELECT DISTINCT * FROM v) q JOIN v c ON c.vec_id <> q.vec_id AND len(c.v) = len(q.v) WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(table(spark, sf_dir, "documents"))


_SHARE = "1 + CAST(1000000000 AS HUGEINT) * ({n} + 2) // ({total} + 2 * v)"
OP11_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
t AS (SELECT id, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term FROM t GROUP BY 1, 2 HAVING count(DISTINCT id) >= 10),
n AS (SELECT lang, source, term, count(*) AS n FROM t JOIN k USING (lang, term) GROUP BY 1, 2, 3),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY 1),
s AS (SELECT lang, source, sum(n) AS total FROM n GROUP BY 1, 2),
g AS (SELECT lang, source, coalesce(total, 0) AS total, coalesce(v, 0) AS v, sum(coalesce(total, 0)) OVER (PARTITION BY lang) AS lang_total
      FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN s USING (lang, source) LEFT JOIN v USING (lang)),
p AS (SELECT g.lang, g.source, k.term, coalesce(n.n, 0) AS n, v, lang_total, {_SHARE.format(n="coalesce(n.n, 0)", total="total")} AS p
      FROM g JOIN k ON k.lang = g.lang LEFT JOIN n ON n.lang = g.lang AND n.source = g.source AND n.term = k.term),
q AS (SELECT lang, term, any_value({_SHARE.format(n="ln", total="lang_total")}) AS q FROM (SELECT *, sum(n) OVER (PARTITION BY lang, term) AS ln FROM p) GROUP BY 1, 2),
a AS (SELECT x.lang, x.source, y.source AS item, sum((x.p - y.p) * (x.p - y.p) // (x.p + y.p)) AS value FROM p x JOIN p y ON y.lang = x.lang AND y.term = x.term AND y.source <> x.source GROUP BY 1, 2, 3),
b AS (SELECT x.lang, x.source, 'pair' AS part, y.source AS item, CAST(coalesce(a.value, 0) AS BIGINT) AS value
      FROM g x JOIN g y ON y.lang = x.lang AND y.source <> x.source LEFT JOIN a ON a.lang = x.lang AND a.source = x.source AND a.item = y.source
      UNION ALL SELECT p.lang, p.source, 'term', p.term, CAST((p - q) * (p - q) // (p + q) AS BIGINT) FROM p JOIN q ON q.lang = p.lang AND q.term = p.term WHERE n > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank FROM b)
SELECT lang, source, part, item, value, CAST(rank AS INTEGER) AS rank FROM r WHERE part = 'pair' OR rank <= 10
"""


def op12_agenda_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = encode_documents(table(spark, sf_dir, "documents"))
    return found.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), "agrees")


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(table(spark, sf_dir, "embeddings"))


QUERIES = {
    "op1_site_templates": op1_site_templates,
    "op2_poisson_mix": op2_poisson_mix,
    "op3_chat_format": op3_chat_format,
    "op4_balanced_shards": op4_balanced_shards,
    "op5_vector_pack": op5_vector_pack,
    "op6_toxicity": op6_toxicity,
    "op7_lsh_forest": op7_lsh_forest,
    "op8_language": op8_language,
    "op9_audio_match": op9_audio_match,
    "op10_norm_buckets": op10_norm_buckets,
    "op11_source_divergence": op11_source_divergence,
    "op12_agenda_encode": op12_agenda_encode,
    "op13_whitening": op13_whitening,
}
SQL = {"op2_poisson_mix": OP2_SQL, "op3_chat_format": OP3_SQL, "op10_norm_buckets": OP10_SQL, "op11_source_divergence": OP11_SQL}
