"""Questions of several clauses: the texts that each is searched by, ranks over them with an early stop, and shares of the answer by clause."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from priceatlas.functions.electrical import normalize_n2, normalize_n2_sql
from priceatlas.functions.once import bound
from priceatlas.functions.stored import stored
from priceatlas.functions.text import normalize_n1, normalize_n1_sql, tokens, tokens_sql
from priceatlas.operators.recall import _rarest, first_members
from priceatlas.plans.entities import PRICE_RECORDS_SQL, price_records, table

# What parts clauses, most texts a question, rows of an answer, least rows of a later text and of a clause, steps of ranks, and words that are read as codes.
PARTS, MOST_SHARDS, LIMIT, LEAST_SHARD, LEAST_CLAUSE, SHARD_STEP, CLAUSE_STEP = r"(?i)\n|,|;|\band\b|&|\+", 24, 20, 5, 3, 100, 1000
CODE = r"[A-Za-z]+[-/]?\d[A-Za-z0-9./-]*|[A-Za-z]*\d[A-Za-z0-9./-]*|[A-Z]{2,}[A-Z0-9./-]*"
CODE_WORDS = ["cat6", "frls", "xlpe", "pvc"]


def clauses_of(question: Column) -> Column:
    """Clauses of two letters at least; a null or empty question has none."""
    parts = F.transform(F.split(F.coalesce(question, F.lit("")), PARTS), lambda p: F.trim(p))
    return F.filter(parts, lambda p: F.length(p) >= 2)


def shards_of(question: Column) -> Column:
    """The texts that a question is searched by, best first, MOST_SHARDS at most: its clauses, these in the second dialect, the whole of a question
    of one clause, all without hyphens and slashes and without blanks, and its codes."""
    whole, clauses = F.coalesce(question, F.lit("")), clauses_of(question)
    return bound(clauses, lambda clauses: bound(F.filter(F.transform(clauses, normalize_n2), lambda t: t != ""), lambda said: _shards(whole, clauses, said)))


def _shards(whole: Column, clauses: Column, said: Column) -> Column:
    normal = lambda texts: F.filter(F.transform(texts, normalize_n2), lambda t: t != "")
    alone = lambda *texts: F.when(F.size(clauses) <= 1, F.array(*texts)).otherwise(F.array().cast("array<string>"))
    bases = F.array_distinct(F.concat(clauses, said, alone(normalize_n2(whole), whole)))
    loose = lambda bases: F.transform(bases, lambda t: F.trim(F.regexp_replace(F.regexp_replace(t, "[-_/]+", " "), r"\s+", " ")))
    tight = lambda bases: F.transform(bases, lambda t: F.regexp_replace(t, r"[-_/\s]+", ""))
    variants = lambda bases: F.filter(F.flatten(F.transform(F.arrays_zip(loose(bases).alias("a"), tight(bases).alias("b")), lambda z: F.array(z["a"], z["b"]))), lambda t: F.length(t) >= 2)
    codes = F.filter(F.regexp_extract_all(whole, F.lit(CODE), F.lit(0)), lambda c: bound(normalize_n2(c), lambda n: (n != "") & (c.rlike(r"[\d./_-]") | (F.length(n) <= 3) | n.isin(CODE_WORDS))))
    found = F.concat(clauses, said, alone(F.trim(whole)), bound(bases, variants), bound(codes, lambda c: F.concat(c, normal(c))))
    return F.slice(F.array_distinct(F.filter(found, lambda t: t != "")), 1, MOST_SHARDS)


def hits_of(texts: DataFrame, items: DataFrame, most: int = LIMIT) -> DataFrame:
    """text, hits: array of (position from 0, item, score, price) of the `most` best items that hold all words of a text.

    texts: text, repeated ones once; items: item, name, price. A score is the share of an item's distinct words; ties go by item. A text
    meets the items that hold its rarest word and is then checked whole; texts without words find nothing.
    """
    words = lambda c: F.array_distinct(tokens(normalize_n1(c)))
    asked = stored(texts.select("text").where("text IS NOT NULL").distinct().withColumn("asked", words(F.col("text"))), "shard-texts")
    # items of one name are met once, as the first of them; of each such class no more than `most` can be asked for
    members = stored(first_members(items.where("name IS NOT NULL").select(F.col("item").alias("id"), "price", "name"), ["name"], [F.col("id")], most), "item-members")
    held = stored(members.where("place = 1").select(F.col("id").alias("item"), "name", words(F.col("name")).alias("held")), "item-words")
    postings = held.select("item", "name", "held", F.explode("held").alias("x"))
    often = postings.groupBy("x").agg(F.count(F.lit(1)).alias("often"))
    first = _rarest(asked, ["text"], "asked", often, F.lit(1)).join(asked, "text")
    met = first.join(postings, "x").where(F.size(F.array_except("asked", "held")) == 0)
    met = met.select("text", "item", "name", (F.size("asked") / F.size("held")).alias("score"))
    place = F.row_number().over(Window.partitionBy("text").orderBy(F.desc("score"), "item")) - 1
    best = met.withColumn("position", place).where(F.col("position") < most).select("text", "name", "score").join(members.select("name", F.col("id").alias("item"), "price"), "name")
    best = best.withColumn("position", place).where(F.col("position") < most)
    return best.groupBy("text").agg(F.sort_array(F.collect_list(F.struct("position", "item", "score", "price"))).alias("hits"))


def search_shards(questions: DataFrame, hits: DataFrame, enough: float, limit: int = LIMIT) -> DataFrame:
    """question, stopped, row (from 1), item, score, rank: the limit best items of each question's texts.

    questions: question (its id, unique), text; hits: those of hits_of for every text of shards_of. The first text gives limit hits, the others half of it, LEAST_SHARD
    at least; hits without a price then go, and keep their places. A rank is SHARD_STEP times the text's number and the place; an item has its
    smallest. A question whose first text gave an item of score `enough` stops there. Items go by score, then rank; where there is one clause, those of the first text
    come first. Questions that find nothing have no row.
    """
    shards = questions.select("question", F.size(clauses_of(F.col("text"))).alias("clauses"), F.posexplode(shards_of(F.col("text"))).alias("no", "text"))
    later = max(LEAST_SHARD, math.ceil(limit / 2))
    found = shards.join(hits, "text").select("question", "clauses", "no", F.inline("hits"))
    found = found.where(F.col("price").isNotNull() & (F.col("position") < F.when(F.col("no") == 0, limit).otherwise(later)))
    found = found.withColumn("rank", F.col("no") * SHARD_STEP + F.col("position"))
    stop = F.max((F.col("no") == 0) & (F.col("score") >= enough)).over(Window.partitionBy("question"))
    found = found.withColumn("stopped", stop).where(~F.col("stopped") | (F.col("no") == 0))
    items = found.groupBy("question", "item").agg(F.first("clauses").alias("clauses"), F.first("stopped").alias("stopped"), F.min(F.struct("rank", "score")).alias("r"))
    behind = F.when(F.col("clauses") <= 1, (F.col("r.rank") >= SHARD_STEP).cast("int")).otherwise(0)
    row = F.row_number().over(Window.partitionBy("question").orderBy(behind, F.desc("r.score"), "r.rank"))
    return items.withColumn("row", row).where(F.col("row") <= limit).select("question", "stopped", "row", "item", "r.score", "r.rank")


def clause_quotas(questions: DataFrame, hits: DataFrame, limit: int = LIMIT) -> DataFrame:
    """question, row (from 1), item, score, rank: the limit first items by clause, each clause with its share of limit, LEAST_CLAUSE at least.

    As search_shards, but every clause is searched by itself: hits without a price are left out before the share is cut, a rank is CLAUSE_STEP
    times the clause's number and the place, and items go by rank. A single clause has the whole limit.
    """
    each = questions.select("question", F.size(clauses_of(F.col("text"))).alias("clauses"), F.posexplode(clauses_of(F.col("text"))).alias("no", "text"))
    share = F.when(F.col("clauses") > 1, F.greatest(F.lit(LEAST_CLAUSE), F.ceil(F.lit(limit) / F.col("clauses")).cast("int"))).otherwise(limit)
    priced = hits.select("text", F.filter("hits", lambda h: h["price"].isNotNull()).alias("hits"))
    found = each.join(priced, "text").select("question", "no", F.posexplode(F.slice("hits", F.lit(1), share)).alias("place", "h"))
    items = found.groupBy("question", "h.item").agg(F.min(F.struct((F.col("no") * CLAUSE_STEP + F.col("place")).alias("rank"), "h.score")).alias("r"))
    row = F.row_number().over(Window.partitionBy("question").orderBy("r.rank"))
    return items.withColumn("row", row).where(F.col("row") <= limit).select("question", "row", "item", "r.score", "r.rank")


#: An early stop of the queries, and their rows an answer.
ENOUGH, ROWS = 0.4, 8


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """question, text: each customer asks, in one line, for the parts of the lines of the last order; every third one for one part only."""
    orders, parts = table(spark, sf_dir, "orders"), table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type")
    last = orders.groupBy("o_custkey").agg(F.max("o_orderkey").alias("o_orderkey"))
    lines = last.join(table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey")).where("o_custkey % 3 <> 0 OR l_linenumber = 1").join(parts, F.col("l_partkey") == F.col("p_partkey"))
    name = F.when(F.col("l_linenumber") % 2 == 0, F.col("p_name")).otherwise(F.concat_ws("-", F.element_at(F.split("p_name", " "), 1), F.element_at(F.split("p_type", " "), 1)))
    listed = F.sort_array(F.collect_list(F.struct(F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("k"), name.alias("name"))))
    joined = lines.groupBy(F.col("o_custkey").alias("question")).agg(listed.alias("l"))
    return joined.select("question", F.array_join(F.col("l")["name"], " and ").alias("text"))


def asked_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """item, name, price; every seventh record is without a price."""
    return price_records(spark, sf_dir).select(F.col("id").alias("item"), F.col("text").alias("name"), F.when(F.col("id") % 7 != 0, F.col("price")).alias("price"))


def shard_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = stored(questions(spark, sf_dir), "questions")
    hits = hits_of(q.select(F.explode(shards_of(F.col("text"))).alias("text")), asked_items(spark, sf_dir), ROWS)
    return search_shards(q, stored(hits, "shard-hits"), ENOUGH, ROWS)


def clause_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = stored(questions(spark, sf_dir), "questions")
    every = 4 * ROWS
    hits = hits_of(q.select(F.explode(clauses_of(F.col("text"))).alias("text")), asked_items(spark, sf_dir), every)
    return clause_quotas(q, hits, ROWS)


_CLAUSES = f"list_filter(list_transform(string_split(regexp_replace(text, '{PARTS}', chr(1), 'g'), chr(1)), lambda p: trim(p)), lambda p: length(p) >= 2)"
_ASKED = f"""
o AS (SELECT o_custkey, max(o_orderkey) AS o_orderkey FROM orders GROUP BY 1),
qs AS (SELECT o_custkey AS question, string_agg(CASE WHEN l_linenumber % 2 = 0 THEN p_name ELSE string_split(p_name, ' ')[1] || '-' || string_split(p_type, ' ')[1] END, ' and ' ORDER BY l_linenumber, l_partkey) AS text
  FROM o JOIN lineitem ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey WHERE o_custkey % 3 <> 0 OR l_linenumber = 1 GROUP BY 1),
qc AS (SELECT question, text, {_CLAUSES} AS c FROM qs),
i AS (SELECT id AS item, CASE WHEN id % 7 <> 0 THEN price END AS price, list_distinct({tokens_sql(normalize_n1_sql('text'))}) AS held FROM ({PRICE_RECORDS_SQL}))"""
_HITS = """
w AS (SELECT text, list_distinct({words}) AS asked FROM (SELECT DISTINCT text FROM {texts})),
h AS (SELECT text, item, price, len(asked) / len(held) AS score, row_number() OVER (PARTITION BY text ORDER BY len(asked) / len(held) DESC, item) - 1 AS position FROM w JOIN i ON len(asked) > 0 AND list_has_all(held, asked))"""
_WORDS = tokens_sql(normalize_n1_sql("text"))
_NORMAL = "list_filter(list_transform({}, lambda x: " + normalize_n2_sql("x") + "), lambda x: x <> '')"
_FIRST = "list_transform(list_filter(list_zip({0}, range(1, len({0}) + 1)), lambda z: list_position({0}, z[1]) = z[2]), lambda z: z[1])"
SHARDS_SQL = f"""WITH {_ASKED},
n AS (SELECT *, {_NORMAL.format('c')} AS n, CASE WHEN len(c) <= 1 THEN [{normalize_n2_sql('text')}, text] ELSE [] END AS alone, regexp_extract_all(text, '{CODE}') AS k0 FROM qc),
nk AS (SELECT *, list_filter(k0, lambda x: {normalize_n2_sql('x')} <> '' AND (regexp_matches(x, '[\\d./_-]') OR length({normalize_n2_sql('x')}) <= 3 OR {normalize_n2_sql('x')} IN ('cat6', 'frls', 'xlpe', 'pvc'))) AS k FROM n),
b0 AS (SELECT *, list_concat(c, n, alone) AS b FROM nk),
b1 AS (SELECT *, list_filter(flatten(list_transform(b, lambda t: [trim(regexp_replace(regexp_replace(t, '[-_/]+', ' ', 'g'), '\\s+', ' ', 'g')), regexp_replace(t, '[-_/\\s]+', '', 'g')])), lambda t: length(t) >= 2) AS v FROM b0),
a AS (SELECT question, len(c) AS clauses, list_filter(list_concat(c, n, CASE WHEN len(c) <= 1 THEN [trim(text)] ELSE [] END, v, k, {_NORMAL.format('k')}), lambda t: t <> '') AS f FROM b1),
s0 AS (SELECT question, clauses, {_FIRST.format('f')}[1:{MOST_SHARDS}] AS f FROM a),
s AS (SELECT question, clauses, unnest(f) AS text, unnest(range(0, len(f))) AS no FROM s0),
{_HITS.format(words=_WORDS, texts='s')},
m AS (SELECT question, clauses, no, item, score, no * {SHARD_STEP} + position AS rank FROM s JOIN h USING (text) WHERE price IS NOT NULL AND position < CASE WHEN no = 0 THEN {ROWS} ELSE {max(LEAST_SHARD, math.ceil(ROWS / 2))} END),
e AS (SELECT *, bool_or(no = 0 AND score >= {ENOUGH}) OVER (PARTITION BY question) AS stopped FROM m),
r AS (SELECT * FROM e WHERE NOT stopped OR no = 0 QUALIFY row_number() OVER (PARTITION BY question, item ORDER BY rank) = 1)
SELECT question, stopped, CAST(row_number() OVER (PARTITION BY question ORDER BY CASE WHEN clauses <= 1 AND rank >= {SHARD_STEP} THEN 1 ELSE 0 END, score DESC, rank) AS INTEGER) AS row, item, score, CAST(rank AS INTEGER) AS rank FROM r QUALIFY row <= {ROWS}"""
QUOTAS_SQL = f"""WITH {_ASKED},
s AS (SELECT question, len(c) AS clauses, unnest(c) AS text, unnest(range(0, len(c))) AS no FROM qc),
{_HITS.format(words=_WORDS, texts='s')},
p AS (SELECT text, item, score, row_number() OVER (PARTITION BY text ORDER BY position) - 1 AS place FROM h WHERE price IS NOT NULL AND position < {4 * ROWS}),
m AS (SELECT question, item, score, no * {CLAUSE_STEP} + place AS rank FROM s JOIN p USING (text) WHERE place < CASE WHEN clauses > 1 THEN greatest({LEAST_CLAUSE}, ceil({ROWS} / clauses)) ELSE {ROWS} END QUALIFY row_number() OVER (PARTITION BY question, item ORDER BY rank) = 1)
SELECT question, CAST(row_number() OVER (PARTITION BY question ORDER BY rank) AS INTEGER) AS row, item, score, CAST(rank AS INTEGER) AS rank FROM m QUALIFY row <= {ROWS}"""
QUERIES = {"shard_search": shard_search, "clause_quotas": clause_shares}
SQL = {"shard_search": SHARDS_SQL, "clause_quotas": QUOTAS_SQL}
